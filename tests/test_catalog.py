"""Every registered query against its SQL on the smallest tables; the rest must at least give rows."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_module
from catalog import ORACLES, QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()
HEAVY = {"evaluate_study", "test_audit", "fit_study"}  # covered by their own tests


def cell(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if not isinstance(v, list) and pd.isna(v):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int) or type(v).__name__ == "Decimal":
        v = float(v)
    if isinstance(v, float):
        return "0.0" if v == 0 else f"{v:.12g}"
    return str(v)


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(cell(v) for v in r) for r in frame.astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return c


def test_names_line_up():
    assert set(ORACLES) <= set(QUERIES)
    assert len(ORACLES) > 90
    assert set(QUERIES) <= set(entry_module.queries()) and set(ORACLES) <= set(entry_module.oracle_sql())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - HEAVY))
def test_query(spark, sf_dir, con, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name not in ORACLES:
        assert len(got)
        return
    want = con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() == 5 and all(not math.isnan(r.blind_fraction) for r in df.collect())
