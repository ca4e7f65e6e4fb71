"""Designed artificial studies for software tests; never to be mixed with measured data."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import hash_unit

# fixed values: relative stage costs of the design
COSTS = {"mlip": 0.03, "dft": 1.0, "high_level": 20.0, "screen": 0.05, "diagnostics": 0.3}


def _uniform(seed: int, stream: str, *ids) -> Column:
    return hash_unit(F.lit(str(seed)), F.lit(stream), *ids)


def _normal(seed: int, stream: str, *ids) -> Column:
    """Box-Muller on two hash uniforms (the first kept away from zero)."""
    u = _uniform(seed, stream + "/r", *ids)
    v = _uniform(seed, stream + "/a", *ids)
    return F.sqrt(-2 * F.log(u + F.lit(2.0**-33))) * F.cos(F.lit(2 * math.pi) * v)


def _clip(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def synthetic_study(ids: DataFrame, seed: int = 42) -> DataFrame:
    """Study rows for every (group, item) of ``ids``: hidden difficulty per group, noise per item.

    Draws come from hashes of (seed, stream, id): the same row on any partitioning or cluster.
    """
    g, i = F.col("group"), F.col("item")
    per_item = lambda stream: _normal(seed, stream, g, i)
    df = ids.select("group", "item").withColumns({
        "_d": _clip(_uniform(seed, "surrogate", g) + 0.1 * per_item("d")),
        "_rd": _clip(_uniform(seed, "reference", g) + 0.1 * per_item("rd")),
        "reference": 5 + 25 * _uniform(seed, "base", g) + 2 * per_item("ref"),
    })
    df = df.withColumn("_width", 0.08 + 1.8 * F.col("_d") * F.col("_d") * F.col("_d"))
    sign = F.when(_uniform(seed, "sign", g, i) < 0.5, -1.0).otherwise(1.0)
    df = df.withColumn("dft", F.col("reference") + F.when(
        F.col("_rd") > 0.6, sign * (2 + 6 * F.col("_rd"))).otherwise(0.35 * per_item("err")))
    df = df.withColumn("mlip", F.col("dft") + F.col("_width") * per_item("sur"))
    feature = lambda **kw: F.create_map(*[x for k, v in kw.items() for x in (F.lit(k), v)])
    name = F.concat_ws(":", F.lit("SYNTHETIC"), g.cast("string"), i.cast("string"))
    return df.select(
        name.alias("id"), F.concat(F.lit("SYNTHETIC-GROUP:"), g.cast("string")).alias("group_id"),
        "mlip", "dft", "reference",
        feature(
            ensemble_std=F.greatest(F.lit(0.01), F.col("_width") + 0.03 * per_item("uq")),
            ood_distance=F.col("_d") * 3,
            cheap_screen=_clip(F.col("_rd") + 0.2 * per_item("screen")),
        ).alias("mlip_features"),
        feature(
            homo_lumo_gap_ev=F.greatest(F.lit(0.01), 5 * (1 - F.col("_rd")) + 0.4 * per_item("gap")),
            spin_contamination=F.greatest(F.lit(0.0), F.col("_rd") * F.col("_rd") + 0.05 * per_item("spin")),
            scf_cycles=F.round(10 + 45 * F.col("_rd")),
            fod=F.greatest(F.lit(0.0), 2 * F.col("_rd") + 0.1 * per_item("fod")),
        ).alias("dft_features"),
        feature(**{k: F.lit(v) for k, v in COSTS.items()}).alias("costs"),
        F.lit("synthetic").alias("reference_quality"), F.lit(0.0).alias("reference_uncertainty"),
        (F.col("reference") + 0.05 * per_item("hl")).alias("high_level_value"), F.lit(True).alias("high_level_supported"),
        F.concat(F.lit("SYNTHETIC-DECISION:"), g.cast("string")).alias("decision_group"),
        F.expr("cast(map() as map<string,map<string,double>>)").alias("operations"),
        # unique per (group, item) however many items there are: the pairing function of two naturals
        ((g + i).cast("long") * (g + i + 1).cast("long") / 2 + i).cast("long").alias("ord"),
    )


def synthetic_ids(spark: SparkSession, groups: int = 60, rows_per_group: int = 4) -> DataFrame:
    if groups < 4 or rows_per_group < 1:
        raise ValueError("at least four groups and one row per group")
    return spark.range(groups * rows_per_group).select(
        F.expr(f"id div {rows_per_group}").alias("group"), F.expr(f"id % {rows_per_group}").alias("item"))
