"""A report takes its policies from the lattice: no row per row and policy is made, priced or written for it."""

from tierlens.plans import study as P
from tierlens.plans.lineage import cut_lineage
from tierlens.sources.synthetic import synthetic_ids, synthetic_study


def test_report_writes_no_row_per_policy(spark, monkeypatch):
    rows = cut_lineage(synthetic_study(synthetic_ids(spark, 40, 4)))
    config = P.StudyConfig(synthetic=True, bootstrap_repetitions=10, thresholds=(0.25, 0.75))
    artifact = P.fit_study(rows, config, pairwise=False)
    written = []
    monkeypatch.setattr(P, "cut_lineage", lambda df: written.append(df.columns) or cut_lineage(df))
    out = P.evaluate_study(rows, artifact)
    # before: the decisions of every row under every policy, with their ledgers, were written on the way to the report
    assert written and not any("purchased" in columns or "action" in columns for columns in written)
    total = {r.policy: r.cost for r in out.decisions.groupBy("policy").sum("cost").withColumnRenamed("sum(cost)", "cost").collect()}
    said = {r["name"]: r.value for r in out.report.where("section = 'policies' and metric = 'total_cost'").collect()}
    assert said.keys() == total.keys() and all(abs(said[n] - total[n]) < 1e-6 for n in said)
