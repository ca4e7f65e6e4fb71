"""Sharding by proportional stratified interleaving (operator 9, DataFrame operations only).

Rows are shuffled within their source by a seeded hash and ranked; row r of n has the fractional rank (r + 1/2) / n.
All rows are then ordered by fractional rank and cut into shards of equal row counts, so every shard, and every
stretch of a shard, holds the sources in the proportions of the whole.

No task ranks a whole source or the whole table: a source is ranked in ranges of its hash, the table in ranges of
the fractional rank.  Range totals are exact (the second ones follow from the source sizes alone), so positions are
gapless.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import Scratch, hash_fraction_long, null_safe_key

RANGES = 4096
HASH_BITS = 60
_SOURCE = ["_src_key", "_src_null"]


def shard_rows(docs: DataFrame, shards: int = 40, source: str = "source", identity: list[Column] | None = None, seed: int = 42) -> DataFrame:
    """All columns of ``docs`` plus ``shard`` and ``slot``; shard sizes differ by at most one row.

    ``identity`` (default: doc_id and text) seeds the shuffle.  Rows equal in it are neighbours in the order, and
    rows equal in all columns are interchangeable, so a recomputed task gives the same table.  NULL sources are one
    source.  With fewer rows than shards some shards stay empty; an empty table gives an empty result.  Columns of
    ``docs`` travel inside one struct and cannot clash with the operator's own.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    identity = identity or [F.col("doc_id"), F.crc32(F.col("text").cast("binary"))]
    every = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), every.alias("_tie"),
        *[c.alias(f"_{n}") for n, c in null_safe_key(source, "src").items()],
        hash_fraction_long(F.lit(seed), *identity).alias("_h")).withColumn("_r", F.shiftright("_h", HASH_BITS - 12).cast("int"))
    counts = scratch.keep(keyed.groupBy(*_SOURCE, "_r").agg(F.count("*").alias("_n")))
    in_source = W.partitionBy(*_SOURCE)
    starts = scratch.keep(counts.select(
        *_SOURCE, "_r", (F.sum("_n").over(in_source.orderBy("_r")) - F.col("_n")).alias("_start"),
        F.sum("_n").over(in_source).alias("_size")))
    sizes = scratch.keep(counts.groupBy(*_SOURCE).agg(F.sum("_n").alias("_size")))

    # ranks r with floor((2 r + 1) RANGES / (2 n)) < k: the smallest r at or beyond k is ceil((2 n k - RANGES) / (2 RANGES))
    def below(k: Column) -> Column:
        return F.expr(f"cast(({2 * RANGES - 1} + 2 * _size * {k} - {RANGES}) div {2 * RANGES} as long)")

    spread = sizes.select("_size", F.explode(F.sequence(F.lit(0), F.lit(RANGES - 1))).alias("_k"))
    per_range = spread.select("_k", (below("(_k + 1)") - below("_k")).alias("_n")).groupBy("_k").agg(F.sum("_n").alias("_n"))
    table = scratch.keep(per_range.select(
        "_k", (F.sum("_n").over(W.orderBy("_k")) - F.col("_n")).alias("_first"), F.sum("_n").over(W.partitionBy()).alias("_total")))

    in_range = W.partitionBy(*_SOURCE, "_r").orderBy("_h", "_tie")
    ranked = keyed.join(starts, [*_SOURCE, "_r"]).withColumn("_rank", F.col("_start") + F.row_number().over(in_range) - 1).select(
        "_row", *_SOURCE, "_tie", (2 * F.col("_rank") + 1).alias("_odd"), "_size")
    placed = ranked.withColumn("_k", F.expr(f"cast(_odd * {RANGES} div (2 * _size) as int)")).withColumn(
        "_fraction", F.col("_odd") / (2 * F.col("_size"))).drop("_odd", "_size")
    in_table = W.partitionBy("_k").orderBy("_fraction", "_src_null", "_src_key")
    at = placed.join(table, "_k").withColumn("_at", F.col("_first") + F.row_number().over(in_table) - 1)
    shard = F.expr(f"cast(_at * {shards} div _total as int)")
    return at.withColumn("_shard", shard).withColumn(
        "_slot", F.expr(f"_at - (cast(_shard as long) * _total + {shards - 1}) div {shards}")).select(
        "_row.*", F.col("_shard").alias("shard"), F.col("_slot").alias("slot"))
