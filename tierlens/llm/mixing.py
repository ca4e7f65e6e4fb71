"""Mixing sources to target weights by weighted sampling without replacement (operator 1, DataFrame operations only).

Every row draws an Efraimidis-Spirakis key, an exponential variate divided by its quality weight.  A source whose
target is k complete epochs and a rest takes every row k times, and of the rest the rows with the smallest keys:
sizes are summed in key order up to the rest.  A source is one of a few thousand key ranges per source, summed by
partial aggregation; only the one range in which the rest runs out is sorted row by row.  The outcome is one cut per
source, so applying the mix to the full rows needs no sort and no shuffle of texts beyond a join on that small table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import Scratch, hash_fraction_long, null_safe_key

WORD = r"[^\x20\x09-\x0D]+"
RANGES = 4096  # key ranges per source
_SOURCE = ["src_key", "src_null"]


def word_count(text: str = "text") -> Column:
    """Words of a text, 0 for NULL."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def text_quality(text: str = "text") -> Column:
    """A quality weight from the text alone: the share of letters and white space, at least 0.05."""
    own = F.col(text).cast("string")
    return F.greatest(F.lit(0.05), F.try_divide(F.length(F.regexp_replace(own, r"[^\p{L}\s]+", "")), F.length(own)))


def draws(size: Column, id_column="doc_id", source="source", quality: Column | None = None, seed: int = 42) -> dict[str, Column]:
    """Columns every step needs, as functions of the row alone: size, source key, sampling key, key range.

    The uniform variate is a hash of (seed, id, size), so a rerun or a lost executor draws the same.  A missing or
    non-positive quality weight counts as 1.
    """
    uniform = (hash_fraction_long(F.lit(seed), F.col(id_column), size, digits=13) + 0.5) / F.lit(float(1 << 52))
    weight = F.lit(1.0) if quality is None else F.when(quality > 0, quality.cast("double")).otherwise(1.0)
    key = -F.log(uniform) / weight
    reach = F.least(F.floor(RANGES * (1 - F.exp(-key))), F.lit(RANGES - 1)).cast("int")
    return null_safe_key(source, "src") | {"size": size, "draw": key, "range": reach}


def source_targets(sizes: DataFrame, weights=(3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Adds ``target`` to one row per source (src_key, src_null, source_size).

    Sources in code point order, NULL last, weigh ``weights`` in turn and divide ``share`` of all sizes.  No target
    exceeds ``cap`` times its source's size; the excess goes to the others by weight until none is above.  With caps
    sorted by cap/weight the sources at their cap are a prefix, so one ordered scan finds the level that the rest
    share.  The table has a row per source, which is what a mixture is written down in.
    """
    turn = F.row_number().over(W.orderBy("src_null", "src_key")) - 1
    each = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    capped = sizes.withColumn("weight", each).withColumn("_cap", F.col("source_size") * float(cap))
    by_ratio = W.orderBy(F.col("_cap") / F.col("weight"), "src_null", "src_key")
    everything = W.partitionBy()
    scanned = (
        capped.withColumn("_spent", F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_rest", F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("_total", F.sum("source_size").over(everything) * float(share))
        .withColumn("_level", (F.col("_total") - F.col("_spent")) / F.col("_rest"))
        .withColumn("_open", F.col("_level") * F.col("weight") < F.col("_cap"))
        .withColumn("_at", F.row_number().over(by_ratio))
    )
    level = F.min(F.when(F.col("_open"), F.struct("_at", "_level"))).over(everything)["_level"]
    return scanned.withColumn("target", F.coalesce(F.least("_cap", level * F.col("weight")), F.col("_cap"))).select(
        *_SOURCE, "source_size", "weight", "target")


def mixture_plan(rows: DataFrame, scratch: Scratch, **targets) -> DataFrame:
    """One row per source: source_size, target, ``epochs`` complete passes and the cut of the fractional pass.

    ``rows`` has src_key, src_null, id, size, draw, range.  A row joins the fractional pass if its range lies before
    ``cut_range``, or in it and (draw, id, size) is at most ``cut``.  The last row is taken whole if that brings the
    sum nearer to the target than leaving it, so a source misses its target by at most half a document.
    """
    ranges = scratch.keep(rows.groupBy(*_SOURCE, "range").agg(F.sum("size").alias("total")))
    plan = scratch.keep(
        source_targets(ranges.groupBy(*_SOURCE).agg(F.sum("total").alias("source_size")), **targets)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    running = F.sum("total").over(W.partitionBy(*_SOURCE).orderBy("range"))
    edge = scratch.keep(
        ranges.withColumn("before", running - F.col("total")).join(plan.select(*_SOURCE, "rest"), _SOURCE)
        .where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("total")))
        .select(*_SOURCE, F.col("range").alias("cut_range"), "before", "rest"))
    # equal draws of equal rows are decided together
    near = rows.join(edge.withColumn("range", F.col("cut_range")), [*_SOURCE, "range"]).groupBy(
        *_SOURCE, "cut_range", "draw", "id", "size").agg(
        F.sum("size").alias("own"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    upto = F.sum("own").over(W.partitionBy(*_SOURCE).orderBy("draw", "id", "size")) + F.col("before")
    last = near.withColumn("upto", upto).where(2 * F.col("upto") - F.col("own") <= 2 * F.col("rest"))
    cuts = last.groupBy(*_SOURCE).agg(F.max(F.struct("draw", "id", "size")).alias("cut"))
    return scratch.keep(
        plan.join(edge.select(*_SOURCE, "cut_range"), _SOURCE, "left").join(cuts, _SOURCE, "left"))


def _taken(plan: DataFrame) -> Column:
    """How often the row is taken."""
    in_cut = F.coalesce(F.struct("draw", "id", "size") <= F.col("cut"), F.lit(False))
    extra = (F.col("range") < F.col("cut_range")) | ((F.col("range") == F.col("cut_range")) & in_cut)
    return F.col("epochs") + F.when(extra, 1).otherwise(0)


def mix_sizes(sizes: DataFrame, id_column="doc_id", size="size", source="source", quality: Column | None = None, seed: int = 42, **targets) -> DataFrame:
    """(id, source, size, source_size, target, copies): how often each row enters the mix.

    ``sizes`` has a row per document with its size (``word_count``), so texts need not be carried along.  Rows of
    size 0 are never short of a target; NULL sources are one source.  Rows equal in id and size share a draw and are
    decided together.  An empty table gives an empty result.
    """
    scratch = Scratch(sizes.sparkSession, "mix")
    drawn = draws(F.col(size), id_column, source, quality, seed)
    rows = scratch.keep(sizes.select(F.col(id_column).alias("id"), F.col(source).alias("source"), *[c.alias(n) for n, c in drawn.items()]))
    plan = mixture_plan(rows, scratch, **targets)
    scratch.drop_but(rows, plan)
    return rows.join(plan, _SOURCE).select("id", "source", "size", "source_size", "target", _taken(plan).alias("copies"))


def mix_rows(docs: DataFrame, id_column="doc_id", text="text", source="source", quality: Column | None = None, seed: int = 42, **targets) -> DataFrame:
    """The mix itself: the rows of ``docs`` with all their columns, each as often as it is taken.

    NULL and blank texts have size 0; the rest is as in ``mix_sizes``.  ``quality`` must be a function of the row.
    The draw is one too, so the texts are read again and cut by the one-row-per-source plan.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    drawn = draws(word_count(text), id_column, source, quality, seed)
    rows = scratch.keep(docs.select(F.col(id_column).alias("id"), *[c.alias(n) for n, c in drawn.items()]))
    plan = mixture_plan(rows, scratch, **targets)
    scratch.drop_but(plan)
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_column).alias("id"), *[c.alias(n) for n, c in drawn.items()])
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))
    taken = given.join(plan, _SOURCE).select("_row", _taken(plan).alias("_copies")).where("_copies > 0").select("_row", copies)
    return taken.select("_row.*")
