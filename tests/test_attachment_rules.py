"""Attachments meet the rows they name once, and every rule still fires."""

from tierlens.operators.enrich import attachment_violations

ROWS = "id long, mlip_features map<string,double>, dft_features map<string,double>, operations map<string,map<string,double>>"
ATTACHMENTS = ("row_id long, stage string, features map<string,double>, operations map<string,double>, "
               "provenance struct<method:string,source_sha256:string>")
OK = ("m", "0" * 64)


def test_attachment_rules_in_one_join(spark, tmp_path):
    rows = [(i, {"ensemble_std": None, "ood_distance": 1.0}, {"fod": 2.0 if i == 4 else None}, {"diagnostics": {"run": 8.0}}) for i in range(1, 9)]
    given = [
        (1, "diagnostics", {"fod": 1.0}, {"run": 8.0}, OK), (2, "nowhere", {"fod": 1.0}, {"run": 8.0}, OK),
        (3, "screen", {"fod": 1.0}, {"run": 8.0}, OK), (4, "diagnostics", {"fod": 1.0}, {"run": 8.0}, OK),
        (5, "diagnostics", {"fod": 1.0}, {"run": 9.0}, OK), (6, "diagnostics", {"fod": 1.0}, {"new": 1.0}, OK),
        (6, "diagnostics", {"fod": 1.0}, {"new": 2.0}, OK), (7, "screen", {"ood_distance": 1.0}, {"run": -1.0}, OK),
        (8, "screen", {"ensemble_std": None}, {"run": 1.0}, OK), (9, "diagnostics", {"fod": 1.0}, {"run": 1.0}, OK),
        (9, "diagnostics", {"fod": 1.0}, {"run": 2.0}, ("", "x")), (None, "screen", {"ensemble_std": 1.0}, {"run": 1.0}, OK)]
    spark.createDataFrame(rows, ROWS).write.parquet(str(tmp_path / "rows"))
    spark.createDataFrame(given, ATTACHMENTS).write.parquet(str(tmp_path / "given"))
    out = attachment_violations(spark.read.parquet(str(tmp_path / "rows")), spark.read.parquet(str(tmp_path / "given")))
    assert {(r.row_id, r.rule) for r in out.collect()} == {
        (2, "stage"), (3, "feature_stage"), (4, "overwrites_feature"), (5, "inconsistent_cost"), (6, "inconsistent_cost"),
        (6, "repeated_feature"), (7, "operation_cost"), (7, "overwrites_feature"), (8, "feature_value"), (9, "unknown_row"),
        (9, "repeated_feature"), (9, "provenance"), (None, "unknown_row")}
    # before: seven reads of the attachments and three joins with whole rows
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 1 and "Join Inner" not in plan and "Join LeftAnti" not in plan, plan
    assert sum("given" in f for f in out.inputFiles()) == 0
