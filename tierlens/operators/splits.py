"""Leak-free partitioning: whole groups, connected groups, audits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let
from ..plans.lineage import cut_lineage
from .ordered import running

# fixed values: default partitions in assignment order
DEFAULT_FRACTIONS = {"train": 0.5, "calibration": 0.2, "validation": 0.15, "test": 0.15}


def partition_sizes(groups: int, fractions: dict[str, float]) -> dict[str, int]:
    """One group reserved per partition, the rest by largest remainder (first partition wins ties)."""
    if any(not 0 < f <= 1 for f in fractions.values()) or abs(sum(fractions.values()) - 1) > 1e-10:
        raise ValueError("fractions must be positive and sum to one")
    if groups < len(fractions):
        raise ValueError("fewer independent groups than partitions")
    share = {p: f * (groups - len(fractions)) for p, f in fractions.items()}
    sizes = {p: 1 + math.floor(s) for p, s in share.items()}
    by_remainder = sorted(share, key=lambda p: -(share[p] - math.floor(share[p])))
    for p in by_remainder[: groups - sum(sizes.values())]:
        sizes[p] += 1
    return sizes


def _group_digest(group: str, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}|"), F.col(group).cast("string")), 256)


def grouped_split(rows: DataFrame, row_id="id", group="group_id", seed: int = 42, fractions=None) -> DataFrame:
    """(id, group_id, partition): groups in order of a seeded hash are dealt to the partitions.

    Only the number of groups reaches the driver.  The hash prefix is the bucket of the rank, so ranking is
    spread over up to 4096 tasks and does not depend on input order.
    """
    fractions = dict(fractions or DEFAULT_FRACTIONS)
    groups = cut_lineage(rows.select(F.col(group).alias("_g")).distinct()).withColumn("_one", F.lit(1))
    sizes = partition_sizes(groups.count(), fractions)
    ranked = running(
        groups.withColumn("_h", _group_digest("_g", seed)), "_h", sums={"_rank": "_one"},
        bucket=F.conv(F.substring("_h", 1, 3), 16, 10).cast("double"),
    )
    dealt, cursor = F.lit(None).cast("string"), 0
    for name, size in reversed(list(sizes.items())):
        cursor += size
    upper = cursor
    for name, size in reversed(list(sizes.items())):
        dealt = F.when(F.col("_rank") <= upper, F.lit(name)).otherwise(dealt)
        upper -= size
    assignment = ranked.select("_g", dealt.alias("partition"))
    return rows.select(F.col(row_id).alias("id"), F.col(group).alias("group_id")).join(
        assignment, F.col("group_id") == F.col("_g")).drop("_g")


def partition_of(split: DataFrame, group="group_id", seed: int = 42) -> Column:
    """The partition of any row of a :func:`grouped_split` of that seed, told by its group: no row has to be joined with the split.

    Groups are dealt in order of their digest, so a partition is a range of digests; one row per partition reaches the driver.
    """
    last = split.groupBy("partition").agg(F.max(_group_digest("group_id", seed)).alias("h")).collect()

    def dealt(digest: Column) -> Column:
        out = F.lit(None).cast("string")
        for r in sorted(last, key=lambda r: r["h"], reverse=True):
            out = F.when(digest <= r["h"], F.lit(r["partition"])).otherwise(out)
        return out

    return let(_group_digest(group, seed), dealt)


def split_audit(split: DataFrame, rows: DataFrame, row_id="id", group="group_id", fractions=None) -> DataFrame:
    """(rule, violations): leaking groups, empty partitions, ids present on one side only."""
    fractions = fractions or DEFAULT_FRACTIONS
    leak = split.groupBy("group_id").agg(F.count_distinct("partition").alias("k")).agg(
        F.lit("group_leakage").alias("rule"), F.count(F.when(F.col("k") > 1, 1)).alias("violations"))
    empty = split.agg(
        F.lit("empty_partition").alias("rule"),
        (F.lit(len(fractions)) - F.count_distinct(F.when(F.col("partition").isin(*fractions), F.col("partition")))).alias("violations"))
    ours = split.select("id", F.lit(1).alias("s"), F.lit(0).alias("r"), F.col("group_id").cast("string").alias("g"))
    theirs = rows.select(F.col(row_id).alias("id"), F.lit(0).alias("s"), F.lit(1).alias("r"), F.col(group).cast("string").alias("g"))
    keys = ours.unionByName(theirs).groupBy("id").agg(
        F.sum("s").alias("s"), F.sum("r").alias("r"), F.min("g").alias("lo"), F.max("g").alias("hi")
    ).agg(F.lit("key_mismatch").alias("rule"),
          F.count(F.when((F.col("s") != 1) | (F.col("r") != 1) | (F.col("lo") != F.col("hi")), 1)).alias("violations"))
    return leak.unionByName(empty).unionByName(keys)


def ids_in_partition(split: DataFrame, partition: str) -> DataFrame:
    return split.where(F.col("partition") == partition).select("id").orderBy("id")


def disjoint_ids(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """Ids present on both sides (empty when disjoint)."""
    return left.select(key).distinct().join(right.select(key), key, "left_semi")


def key_differences(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """Keys of one side missing from the other, tagged with the side that has them."""
    marks = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    return marks.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r")).where("l <> r").select(
        key, F.when(F.col("l") == 1, "left").otherwise("right").alias("only_in"))


def connected_groups(links: DataFrame, row_id: str = "row_id", entity: str = "entity") -> DataFrame:
    """(row_id, component): rows sharing any entity, directly or through others, get the smallest row id.

    Every entity first contributes a star from its smallest row (a partial aggregation, never its pairs).
    Alternating star contraction then shortens the graph in O(log^2 n) rounds: each round links a node's
    larger neighbours, then its smaller ones, to the smallest neighbour known.  Until only stars are left,
    a round moves some node to a smaller neighbour, so the rounds end.  Hubs are only ever the group key of a
    ``min`` or the skewed side of an equi-join of two written tables, which AQE splits.  ``links`` rows with a
    NULL entity keep their row in the result as a component of its own.
    """
    nodes = links.select(F.col(row_id).alias("row_id")).distinct()
    linked = cut_lineage(links.where(F.col(entity).isNotNull()).select(F.col(row_id).alias("v"), F.col(entity).alias("_e")).distinct())
    stars = cut_lineage(linked.groupBy("_e").agg(F.min("v").alias("u")))
    edges = linked.join(stars, "_e").where(F.col("u") < F.col("v")).select("u", "v").distinct()
    edges = cut_lineage(edges)
    before = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = cut_lineage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = cut_lineage(both.where(F.col("v") > F.col("u")).join(lowest, "u").select(F.col("m").alias("u"), "v").where("u < v").distinct())
        # small star: each node keeps its smaller neighbours, all tied to the smallest of them
        least = cut_lineage(large.groupBy("v").agg(F.min("u").alias("m")))
        tied = large.join(least, "v").where(F.col("u") > F.col("m")).select(F.col("m").alias("u"), F.col("u").alias("v"))
        edges = cut_lineage(tied.unionByName(least.select(F.col("m").alias("u"), "v")).distinct())
        signature = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(signature) == before:
            break
        before = tuple(signature)
    return nodes.join(edges.select(F.col("v").alias("row_id"), F.col("u").alias("component")), "row_id", "left").select(
        "row_id", F.coalesce("component", "row_id").alias("component"))


def pairing_report(
    table_fingerprint: str, artifact_fingerprint: str, rows: DataFrame, split: DataFrame, development_ids: DataFrame,
) -> DataFrame:
    """(rule, violations) that must all be zero before a frozen model may be evaluated on a table."""
    spark = rows.sparkSession
    fingerprint = spark.range(1).select(
        F.lit("table_fingerprint").alias("rule"),
        F.lit(0 if table_fingerprint == artifact_fingerprint else 1).cast("long").alias("violations"))
    keys = key_differences(rows.select("id"), split.select("id")).agg(
        F.lit("split_keys").alias("rule"), F.count("*").alias("violations"))
    leaked = disjoint_ids(ids_in_partition(split, "test"), development_ids).agg(
        F.lit("test_in_development").alias("rule"), F.count("*").alias("violations"))
    return fingerprint.unionByName(keys).unionByName(leaked)
