"""Order statistics of many columns by refining bit histograms."""

import numpy as np
import pytest

from tierlens.operators.selection import exact_column_quantiles, sortable, unsortable


def test_bits_sort_like_numbers():
    x = np.array([-np.inf, -1e300, -2.5, -5e-324, -0.0, 0.0, 5e-324, 1.0, 1.0000000000000002, 1e300, np.inf])
    u = sortable(x)
    assert (np.diff(u.astype(object)) >= 0).all() and u[4] == u[5] and len(set(u.tolist())) == len(x) - 1
    assert [unsortable(int(v)) for v in u] == (x + 0.0).tolist()


@pytest.mark.parametrize("fraction", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_quantiles_of_many_columns(spark, fraction):
    rng = np.random.default_rng(5)
    columns = {"normal": rng.normal(size=401), "ties": rng.integers(-2, 3, 401) * 0.1, "wide": 10.0 ** rng.uniform(-200, 200, 401) * rng.choice([-1, 1], 401),
               "odd.name": np.full(401, -7.25), "empty": np.full(401, np.nan)}
    gaps = rng.random((401, len(columns))) < 0.2
    rows = [tuple(None if gaps[i, k] or np.isnan(v[i]) else float(v[i]) for k, v in enumerate(columns.values())) for i in range(401)]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` double" for n in columns)).repartition(7).withColumnRenamed("odd.name", "constant")
    names = ["normal", "ties", "wide", "constant", "empty"]
    got = exact_column_quantiles(df, names, fraction)
    for k, (n, v) in enumerate(zip(names, columns.values())):
        known = v[~gaps[:, k] & ~np.isnan(v)]
        assert got[n][0] == len(known)
        assert got[n][1] is None if not len(known) else got[n][1] == pytest.approx(np.quantile(known, fraction), rel=1e-12)
    assert exact_column_quantiles(df.where("normal > 1e9"), names)["ties"] == (0, None)
