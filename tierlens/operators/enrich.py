"""Updates of existing tables by left join: attachments, reviews, duplicate marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite, is_true, stage_operations
from ..plans.lineage import cut_lineage
from ..records import REFERENCE_QUALITIES, STAGE_1_FEATURES, STAGE_2_FEATURES

_STAGES = {"screen": ("mlip_features", STAGE_1_FEATURES), "diagnostics": ("dft_features", STAGE_2_FEATURES)}


def attachment_violations(rows: DataFrame, attachments: DataFrame) -> DataFrame:
    """(row_id, rule) for every attachment that must be refused."""
    p = F.col("provenance")
    own = (
        F.when(~is_true(F.col("stage").isin(*_STAGES)), F.lit("stage"))
        .when(is_true(F.size("features") > 0) == F.lit(False), F.lit("features_required"))
        .when(~is_true(F.forall(F.map_values("features"), finite)), F.lit("feature_value"))
        .when(is_true(F.size("operations") > 0) == F.lit(False), F.lit("operations_required"))
        .when(~is_true(F.forall(F.map_values("operations"), lambda v: v >= 0)), F.lit("operation_cost"))
        .when(~is_true(F.length(p["method"]) > 0) | ~is_true(p["source_sha256"].rlike("^[0-9a-f]{64}$")),
              F.lit("provenance"))
    )
    bad_name = F.lit(False)
    for stage, (_, known) in _STAGES.items():
        bad_name = bad_name | ((F.col("stage") == stage) & (
            F.size(F.array_except(F.map_keys("features"), F.array(*[F.lit(n) for n in known]))) > 0))
    # one narrow row per attachment, written: it is read for the names that several attachments of a row give, too
    per_record = cut_lineage(attachments.select(
        "row_id", F.array_compact(F.array(own, F.when(bad_name, F.lit("feature_stage")))).alias("_rules"), "stage",
        F.map_keys("features").alias("_names"), "operations", F.lit(False).alias("_differ")))
    crowd = per_record.groupBy(F.col("row_id").alias("_crowd")).agg(F.count("*").alias("_n")).where("_n > 1")
    entries = F.concat(
        F.coalesce(F.transform("_names", lambda n: F.struct(
            F.lit(True).alias("feature"), F.lit(None).cast("string").alias("stage"), n.alias("name"), F.lit(None).cast("double").alias("cost"))), F.array()),
        F.coalesce(F.transform(F.map_entries("operations"), lambda e: F.struct(
            F.lit(False).alias("feature"), F.col("stage").alias("stage"), e["key"].alias("name"), e["value"].alias("cost"))), F.array()))
    given = per_record.join(crowd, F.col("row_id").eqNullSafe(F.col("_crowd")), "left_semi").select("row_id", F.inline(entries)).groupBy(
        "row_id", "feature", "stage", "name").agg(F.count("*").alias("n"), F.min("cost").alias("lo"), F.max("cost").alias("hi"))
    differ = is_true(F.col("lo") != F.col("hi"))
    shared = given.where((F.col("feature") & (F.col("n") > 1)) | differ).select(
        "row_id", F.array_compact(F.array(F.when(F.col("feature"), F.lit("repeated_feature")))).alias("_rules"),
        F.lit(None).cast("string").alias("stage"), F.lit(None).cast("array<string>").alias("_names"),
        F.lit(None).cast("map<string,double>").alias("operations"), differ.alias("_differ"))
    present = lambda c: F.map_keys(F.map_filter(c, lambda _, v: v.isNotNull()))
    # shuffled by themselves: the tasks that make the rows do not hold the join as well
    targets = rows.select(
        F.col("id").alias("row_id"), F.lit(True).alias("_known"), present("mlip_features").alias("_mlip"),
        present("dft_features").alias("_dft"), F.col("operations").alias("_own")).repartition("row_id")
    joined = per_record.unionByName(shared).join(targets, "row_id", "left")
    taken = F.when(F.col("stage") == "screen", F.col("_mlip")).otherwise(F.col("_dft"))
    priced = F.col("_own")[F.col("stage")]
    clash = F.exists(F.map_entries("operations"), lambda e: F.try_element_at(priced, e["key"]) != e["value"])
    rules = F.concat(F.col("_rules"), F.array_compact(F.array(
        F.when(F.col("_known").isNull(), F.lit("unknown_row")),
        F.when(F.arrays_overlap(taken, "_names"), F.lit("overwrites_feature")),
        F.when(F.col("_known") & (F.col("_differ") | is_true(clash)), F.lit("inconsistent_cost")))))
    return joined.select("row_id", F.explode(rules).alias("rule")).repartition("row_id", "rule").distinct()


def _without(pairs: Column, key: str) -> Column:
    return F.map_filter(pairs, lambda k, _: k != key)


def attach_features(rows: DataFrame, attachments: DataFrame) -> DataFrame:
    """Merge accepted attachments into the feature, operation and cost maps, with an audit trail.

    Call :func:`attachment_violations` first; what it reports must be empty.
    """
    entry = "struct<key:string,value:double>"
    per_row = attachments.groupBy("row_id").agg(*[
        F.flatten(F.collect_list(F.when(F.col("stage") == stage, F.map_entries(kind)))).alias(f"_{kind}_{stage}")
        for stage in _STAGES for kind in ("features", "operations")
    ], F.array_sort(F.collect_list(F.struct(
        "row_id", "stage", F.col("provenance.method").alias("method"), F.col("provenance.source_sha256").alias("source_sha256"),
        *[F.array_sort(F.map_entries(kind)).alias(kind) for kind in ("features", "operations")],
    ))).alias("attachments"))
    joined = rows.join(per_row, rows["id"] == per_row["row_id"], "left").drop("row_id")
    updates = {}
    operations = F.col("operations")
    costs = F.col("costs")
    for stage, (column, _) in _STAGES.items():
        new = F.coalesce(F.col(f"_features_{stage}"), F.expr(f"cast(array() as array<{entry}>)"))
        names = F.transform(new, lambda e: e["key"])
        kept = F.map_filter(column, lambda k, v: ~F.array_contains(names, k))
        updates[column] = F.map_concat(kept, F.map_from_entries(new))
        bought = F.array_distinct(F.coalesce(F.col(f"_operations_{stage}"), F.expr(f"cast(array() as array<{entry}>)")))
        existing = F.when(operations[stage].isNotNull(), operations[stage]).when(
            F.col("costs")[stage] != 0, stage_operations(stage)).otherwise(F.expr("cast(map() as map<string,double>)"))
        bought_names = F.transform(bought, lambda e: e["key"])
        merged = F.map_concat(
            F.map_filter(existing, lambda k, v: ~F.array_contains(bought_names, k)), F.map_from_entries(bought))
        changed = F.size(bought) > 0
        total = F.aggregate(F.array_sort(F.map_values(merged)), F.lit(0.0), lambda a, v: a + v)
        operations = F.when(changed, F.map_concat(
            _without(operations, stage), F.create_map(F.lit(stage), merged)
        )).otherwise(operations)
        costs = F.when(changed, F.map_concat(
            _without(costs, stage), F.create_map(F.lit(stage), total)
        )).otherwise(costs)
    updates["operations"], updates["costs"] = operations, costs
    return joined.withColumns(updates).drop(
        *[f"_{kind}_{stage}" for stage in _STAGES for kind in ("features", "operations")])


def review_violations(observables: DataFrame, reviews: DataFrame, synthetic: bool = False) -> DataFrame:
    """(observable_id, rule) for every review that must be refused."""
    count = reviews.groupBy("observable_id").agg(F.count("*").alias("n"))
    twice = count.where("n > 1").select("observable_id", F.lit("repeated_review").alias("rule"))
    known = observables.select(F.col("id").alias("observable_id"), F.col("reference").isNull().alias("_no_ref"))
    joined = reviews.join(known, "observable_id", "left")
    blank = lambda c: ~is_true(F.length(F.col(c)) > 0)
    checks = {
        "unknown_observable": F.col("_no_ref").isNull(),
        "missing_reference": is_true(F.col("_no_ref")),
        "reviewer_and_note": blank("reviewer") | blank("note"),
        "quality": ~is_true(F.col("quality").isin(*REFERENCE_QUALITIES)),
        "synthetic_label": F.lit(not synthetic) & is_true(F.col("quality") == "synthetic"),
        "uncertainty": is_true(F.col("uncertainty") < 0),
    }
    rules = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))
    return joined.select("observable_id", F.explode(rules).alias("rule")).unionByName(twice).distinct()


def apply_reviews(observables: DataFrame, reviews: DataFrame) -> DataFrame:
    """Set quality, note and (only if given) uncertainty of reviewed references; values never change."""
    r = reviews.select(
        F.col("observable_id").alias("_oid"), F.col("quality").alias("_quality"),
        F.concat(F.col("reviewer"), F.lit(": "), F.col("note")).alias("_note"),
        F.col("uncertainty").alias("_uncertainty"),
    )
    ref = F.col("reference")
    changed = F.struct(
        ref["value"].alias("value"), ref["unit"].alias("unit"), ref["method"].alias("method"),
        ref["source"].alias("source"), F.coalesce(F.col("_quality"), ref["quality"]).alias("quality"),
        F.coalesce(F.col("_uncertainty"), ref["uncertainty"]).alias("uncertainty"),
        F.coalesce(F.col("_note"), ref["review_note"]).alias("review_note"),
    )
    return observables.join(r, observables["id"] == r["_oid"], "left").withColumn(
        "reference", F.when(ref.isNotNull(), changed)
    ).drop("_oid", "_quality", "_note", "_uncertainty")


def mark_duplicates(observables: DataFrame, order_by: str = "id", terms: str = "terms") -> DataFrame:
    """``duplicate_of`` = first observable with the same multiset of (species, coefficient), else NULL."""
    key = F.sha2(F.to_json(F.array_sort(terms)), 256)
    keyed = observables.withColumn("_key", key)
    # written, so that a key shared by many observables is a skewed join that AQE splits
    first = cut_lineage(keyed.groupBy("_key").agg(F.min_by("id", order_by).alias("_first")))
    return keyed.join(first, "_key").withColumn(
        "duplicate_of", F.when(F.col("_first") != F.col("id"), F.col("_first"))
    ).drop("_key", "_first")
