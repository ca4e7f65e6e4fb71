"""What a ledger with a budget shuffles besides its rounds."""

import pytest

from tierlens.operators import ledger
from test_ledger import make


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_prices_are_told_apart_by_ledger_only_where_they_differ(spark, monkeypatch):
    two = make(spark, {"b": [(0, 1, {"a": 1.0, "x": 2.0})], "c": [(0, 1, {"a": 3.0}), (1, 1, {"x": 2.0})]})
    ledger.refuse_two_prices(two, ["book"])
    with pytest.raises(Exception, match="two prices"):
        ledger.refuse_two_prices(two.selectExpr("'all' as book", "row_no", "step_no", "operations", "seq"), ["book"])
    kept, cut = [], ledger.cut_lineage
    monkeypatch.setattr(ledger, "cut_lineage", lambda df: kept.append(plan(df)) or cut(df))
    ledger.refuse_two_prices(two, ["book"])
    assert len(kept) == 1 and "Aggregate [op#" in kept[0] and "book" not in kept[0].split("Generate")[0]


def test_rows_of_the_result_are_grouped_once(spark):
    bought = make(spark, {"b": [(i, 1, {f"o{i}": 1.0}) for i in range(9)]})
    found = ledger.charge_with_budget(bought, ["book"], 4.0)
    assert plan(found).count("Aggregate [") == 1
    assert sorted((r.row_no, r.cost, r.refused_step_no) for r in found.collect()) == [(i, 1.0, None) if i < 4 else (i, 0.0, 1) for i in range(9)]
