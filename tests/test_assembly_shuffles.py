"""Terms meet by observable once: methods, keys and lists of an observable need no shuffle of their own."""

import re

from pyspark.sql import functions as F

from catalog import QUERIES, views as S
from catalog.registry import Tables


def shuffles(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange hashpartitioning\(([^)]*?), \d+\)", plan)


def test_one_row_per_method_is_made_behind_the_shuffle(spark, sf_dir):
    for name in ("assemble_observable", "assemble_study", "assembled_study_eligibility", "ensemble_std"):
        keys = shuffles(QUERIES[name](spark, sf_dir))
        assert keys and not any("method_id" in k for k in keys), (name, keys)


def test_unread_keys_are_not_carried(spark, sf_dir):
    plan = QUERIES["assemble_observable"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "_other_hash" not in plan and "_keys" not in plan


def test_lines_of_an_order_meet_once(spark, sf_dir):
    assert len(shuffles(S.terms(Tables(spark, sf_dir)))) == 1


def test_foreign_geometry_keeps_its_own_key(spark):
    from tierlens.operators.observables import assemble_study

    terms = spark.createDataFrame([("o", 0, "r", -1.0), ("o", 1, "ts", 1.0)], "observable_id string, pos int, structure_id string, coefficient double")
    structures = spark.createDataFrame([("r", "h"), ("ts", "h")], "id string, geometry_hash string")
    rows = [(s, m, f, "succeeded", 1.0, "kcal/mol", h, 2.0, "u", "x") for s, m, f, h in (
        ("r", "a", "mlip", "h"), ("ts", "a", "mlip", "other"), ("r", "d", "dft", "h"))]
    calculations = spark.createDataFrame(rows, "structure_id string, method_id string, fidelity string, status string, energy double, "
                                               "energy_unit string, geometry_hash string, cost double, cost_unit string, settings_hash string")
    reference = F.struct(*[F.lit(None).cast("double").alias(n) for n in ("value", "uncertainty")],
                         *[F.lit(None).cast("string").alias(n) for n in ("unit", "quality", "source", "method")])
    observables = spark.createDataFrame([("o", "g", None)], "id string, group_id string, decision_group string").withColumn("reference", reference)
    got = assemble_study(observables, terms, calculations, structures, ["a"], "d").first()
    assert got.operations == {"mlip": {"r/h/a/x": 2.0, "ts/other/a/x": 2.0}, "dft": {"r/h/d/x": 2.0}}
    assert (got.costs["mlip"], got.costs["dft"]) == (4.0, 2.0)
    assert [(f.method, f.reason) for f in got.failures] == [("a", "geometry/state mismatch for ts"), ("d", "missing calculation ts/d")]


def test_balance_sums_behind_a_shuffle_of_its_own(spark, sf_dir):
    plan = QUERIES["check_balance"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    keys = shuffles(QUERIES["check_balance"](spark, sf_dir))
    assert len(keys) == 2 and plan.index("HashAggregate") < plan.index("Exchange hashpartitioning(observable_id"), keys
    assert "partial_sum((coefficient" not in plan.split("Exchange hashpartitioning(observable_id", 1)[1]
