"""Summaries of whole policies need no row per row and policy."""

from catalog import QUERIES
from tierlens.plans import lineage


def test_replay_summary_writes_no_row_per_policy(spark, sf_dir, monkeypatch):
    from tierlens.operators import lattice, ledger, pair_index, pairs, replay
    import catalog.policies as policies

    written = []

    def noted(df):
        out = lineage.cut_lineage(df)
        written.append((out.columns, out.count()))
        return out

    for module in (lattice, ledger, pair_index, pairs, replay, policies):
        if hasattr(module, "cut_lineage"):
            monkeypatch.setattr(module, "cut_lineage", noted)
    assert QUERIES["replay_summary"](spark, sf_dir).count() == 5
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    wide = [n for columns, n in written if {"operations", "decision_group"} & set(columns) and "reference" in columns]
    assert wide and max(wide) == orders
