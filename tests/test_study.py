"""End to end on a designed table, with partition invariance and tamper checks."""

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tierlens.plans import study as P
from tierlens.plans.lineage import cut_lineage
from tierlens.sources import datasets
from tierlens.sources.synthetic import synthetic_ids, synthetic_study

CONFIG = P.StudyConfig(synthetic=True, bootstrap_repetitions=40, thresholds=(0.25, 0.75))


@pytest.fixture(scope="module")
def rows(spark):
    return cut_lineage(synthetic_study(synthetic_ids(spark, 40, 4)))


@pytest.fixture(scope="module")
def artifact(rows):
    return P.fit_study(rows, CONFIG, pairwise=False)


def test_synthetic_rows_do_not_depend_on_partitions(spark, rows):
    again = synthetic_study(synthetic_ids(spark, 40, 4).repartition(3))
    key = lambda df: sorted((r.id, r.mlip, r.dft, r.reference) for r in df.select("id", "mlip", "dft", "reference").collect())
    assert key(rows) == key(again)


def test_fingerprint_sees_rows_not_order(rows):
    assert P.fingerprint(rows) == P.fingerprint(rows.orderBy(F.desc("ord")).repartition(5))
    assert P.fingerprint(rows) != P.fingerprint(rows.withColumn("mlip", F.col("mlip") + 1))


def test_study_report(rows, artifact):
    assert {d["name"] for d in artifact.selected} == {
        "always_mlip", "always_dft", "always_high_level_observed", "uq_only", "uq_reference", "sequential_reference", "screen_all_reference"}
    out = P.evaluate_study(rows, artifact)
    got = {(r.section, r.name, r.metric): r.value for r in out.report.collect()}
    test_n = got["reference_blind", "all", "n"]
    assert test_n == 24.0  # 6 of 40 groups, 4 rows each
    assert got["policies", "always_mlip", "mean_cost"] == pytest.approx(0.03)
    assert got["policies", "always_high_level_observed", "mean_cost"] == pytest.approx(20.0)
    assert got["detection", "reference_augmented", "auroc"] > 0.9 > got["detection", "reference_mlip_only", "auroc"]
    audit = out.audit.toPandas()
    assert len(audit) == test_n
    assert (audit.total_error - audit.surrogate_error - audit.reference_error).abs().max() < 1e-9
    blind = ((audit.mlip - audit.dft).abs() <= 1) & ((audit.dft - audit.reference).abs() > 3)
    assert blind.sum() == got["reference_blind", "all", "blind_count"]
    decisions = out.decisions.toPandas()
    for name, part in decisions.groupby("policy"):
        assert part.cost.sum() == pytest.approx(got["policies", name, "total_cost"])
        assert part.correct.mean() == pytest.approx(got["policies", name, "accuracy_all_cases"])
        pairs = got["policies", name, "pairs_resolved"] + got["policies", name, "pairs_unresolved"]
        assert pairs == 6 * 6
    frontier = {r.name for r in out.pareto.collect()}
    points = {n: (got["policies", n, "mean_cost"], 1 - got["policies", n, "accuracy_all_cases"]) for n in {d["name"] for d in artifact.selected}}
    want = {n for n, p in points.items() if not any(q[0] <= p[0] and q[1] <= p[1] and q != p for q in points.values())}
    assert frontier == want


def test_changed_table_or_artifact_is_refused(rows, artifact):
    with pytest.raises(ValueError):
        P.verify_artifact(rows.withColumn("mlip", F.col("mlip") + 1), artifact)
    with pytest.raises(ValueError):
        P.verify_artifact(rows, replace(artifact, selected=artifact.selected[:-1]))


def test_eligibility_reasons(spark, rows):
    strict = P.with_eligibility(rows, P.StudyConfig())
    assert strict.where(F.array_contains("reasons", P.EXCLUSIONS["synthetic"])).count() == 160
    marked = rows.limit(5).withColumn("duplicate_of", F.lit("first")).withColumn("mlip", F.lit(None).cast("double"))
    assert all(len(r.reasons) == 2 for r in P.with_eligibility(marked, CONFIG).collect())


def test_models_round_trip(artifact):
    from tierlens.operators.models import RiskModel

    for model in artifact.models.values():
        assert RiskModel.from_dict(model.to_dict()) == model


def test_changed_split_is_refused(spark, rows, artifact):
    swapped = artifact.split.withColumn("partition", F.when(F.col("partition") == "train", "test").when(F.col("partition") == "test", "train").otherwise(F.col("partition")))
    with pytest.raises(ValueError, match="split"):
        P.verify_artifact(rows, replace(artifact, split=swapped))
    first = artifact.split.where("partition = 'train'").agg(F.min("id")).first()[0]
    moved = artifact.split.withColumn("partition", F.when(F.col("id") == first, "test").otherwise(F.col("partition")))
    with pytest.raises(ValueError, match="split"):
        P.verify_artifact(rows, replace(artifact, split=moved))
    with pytest.raises(ValueError, match="validation"):
        P.verify_artifact(rows, replace(artifact, validation=artifact.validation.where("policy_id > 0")))


def test_stored_study_is_the_same_study(spark, rows, artifact, tmp_path):
    P.save_artifact(artifact, str(tmp_path / "frozen"))
    loaded = P.load_artifact(spark, str(tmp_path / "frozen"))
    assert loaded.digest() == loaded.sha256 == artifact.sha256
    P.verify_artifact(rows, loaded)
    assert loaded.config == artifact.config and loaded.models == artifact.models


def test_stored_tables_keep_marks_order_and_unit(spark, tmp_path):
    rows = [{"id": f"r{n}", "group_id": f"g{n}", "mlip": 1.0, "dft": 1.0, "reference": 1.0, "reference_quality": "reviewed",
             "metadata": {"duplicate_of": "r1"} if n == 2 else {}} for n in range(4)]
    for name, part in (("a", rows[:3]), ("b", rows[3:])):
        (tmp_path / f"{name}.json").write_text(json.dumps({"schema_version": "1.0", "cost_unit": "hours", "rows": part}))
    table = datasets.load_study_table(spark, str(tmp_path))
    assert [(r.id, r.ord, r.cost_unit) for r in table.orderBy("ord").collect()] == [(f"r{n}", n, "hours") for n in range(4)]
    config = P.StudyConfig()
    for variant in (table, table.drop("duplicate_of"), table.drop("duplicate_of").withColumn("metadata", F.to_json("metadata"))):
        reasons = {r.id: r.reasons for r in P.with_eligibility(variant, config).collect()}
        assert reasons == {"r0": [], "r1": [], "r2": ["duplicate observable of r1"], "r3": []}
    (tmp_path / "a.json").write_text(json.dumps({"schema_version": "1.0", "energy_unit": "eV", "rows": rows}))
    with pytest.raises(Exception, match="kcal/mol"):
        datasets.load_study_table(spark, str(tmp_path)).collect()


def test_studies_without_eligible_rows_or_with_two_units_are_refused(spark, rows):
    with pytest.raises(ValueError, match="no eligible rows"):
        P.fit_study(rows.withColumn("reference_quality", F.lit("questionable")), CONFIG)
    with pytest.raises(ValueError, match="cost unit"):
        P.fit_study(rows.withColumn("cost_unit", F.when(F.hash("id") % 2 == 0, "hours").otherwise("relative")), CONFIG)
