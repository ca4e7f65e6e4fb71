"""Bucket joins without hot tasks, and connected components over links that never leave the executors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Scratch


def tile_units(entries: DataFrame, scratch: Scratch, member: str, tile_rows: int = 512) -> DataFrame:
    """Work units for the pairs inside each ``bucket``; buckets of one row drop out.

    A bucket of more than ``tile_rows`` rows is dealt into tiles by a hash of ``member``; a unit is a pair of tiles
    (or one tile), so every pair of the bucket meets in a unit and no unit holds more than about two tiles of rows.
    Adds ``unit`` (sort and group by it), ``tile`` and ``own`` (the unit is one tile paired with itself).
    """
    counts = scratch.keep(entries.groupBy("bucket").agg(F.count("*").alias("_n")).where("_n > 1"))
    tiles = F.ceil(F.col("_n") / tile_rows).cast("int")
    tiled = entries.join(counts, "bucket").withColumn("_g", tiles).withColumn(
        "tile", F.pmod(F.xxhash64(member, F.lit("tile")), F.col("_g")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_g") - 1)).alias("_other")
    paired = tiled.select("*", other)
    unit = F.xxhash64("bucket", F.least("tile", "_other"), F.greatest("tile", "_other"))
    return paired.withColumn("unit", unit).withColumn("own", F.col("tile") == F.col("_other")).drop("_n", "_g", "_other", "bucket")


def sorted_runs(batches: Iterator[pa.RecordBatch], column: str = "unit", rows: int = 1 << 15) -> Iterator[pa.Table]:
    """Regroup batches sorted by ``column`` into tables of whole groups, about ``rows`` rows each."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            keys = table.column(column).to_numpy()
            cut = int(keys.searchsorted(keys[-1]))  # the last group may go on in the next batch
            if cut:
                yield table.slice(0, cut)
            rest = table.slice(cut).combine_chunks()
            held, n = rest.to_batches(), rest.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): the smallest node of the connected component, for every node with a link.

    ``edges`` has two columns of longs.  Alternating star contraction: first every node ties its larger neighbours
    to its smallest neighbour, then every node ties its smaller neighbours to the smallest of them, until only stars
    are left (O(log^2 n) rounds).  A hub is the group key of a ``min`` or one side of a join of two written tables,
    which the adaptive planner splits.
    """
    a, b = edges.columns
    stars = scratch.keep(
        edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).where("v <> u").distinct())
    while True:
        roles = stars.select(F.col("v").alias("x"), F.lit(1).alias("as_v"), F.lit(0).alias("as_u")).unionByName(
            stars.select(F.col("u").alias("x"), F.lit(0).alias("as_v"), F.lit(1).alias("as_u")))
        unsettled = roles.groupBy("x").agg(F.sum("as_v").alias("as_v"), F.max("as_u").alias("as_u")).where(
            "as_v > 1 or (as_v = 1 and as_u = 1)")
        if unsettled.isEmpty():
            break
        both = stars.select(F.col("v").alias("a"), F.col("u").alias("b")).unionByName(
            stars.select(F.col("u").alias("a"), F.col("v").alias("b")))
        low = scratch.keep(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("m")))
        large = scratch.keep(both.join(low, "a").where("b > a").select(F.col("b").alias("v"), F.col("m").alias("u")).distinct())
        least = scratch.keep(large.groupBy("v").agg(F.min("u").alias("m")))
        tied = large.join(least, "v").where("u > m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        again = scratch.keep(tied.unionByName(least.select("v", F.col("m").alias("u"))).distinct())
        scratch.drop(stars, low, large, least)
        stars = again
    nodes = stars.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return nodes.unionByName(stars.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
