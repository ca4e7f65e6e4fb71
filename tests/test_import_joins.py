"""Logs are not sent through the driver, however small the tables seem that they come from."""

from catalog import QUERIES


def test_import_results_broadcasts_nothing(spark, sf_dir):
    df = QUERIES["import_results"](spark, sf_dir)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
