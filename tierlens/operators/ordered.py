"""Exact ordered scans without a single-partition window.

Recipe: compress the input to one row per distinct value (ties always move together), give every value a
*deterministic* bucket, run the window inside (keys, bucket), and add the totals of the earlier buckets.
Bucket edges come from one approximate-quantile pass and are frozen as literals, so a retried task puts a
row in the same bucket.  No bucket holds more than its share of all rows, whatever the keys: a hot key is
simply spread over more buckets.  The result does not depend on the edges, and there is no other path.

A missing value sorts before all others (Spark's order); NULL keys are a stratum of their own.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import col

ROWS_PER_BUCKET = 500_000
_BUCKET, _SPREAD = "_bucket", "_spread"


def known(column, what: str) -> Column:
    """The column, or an error that names it where a row has none (NULL or NaN)."""
    c = col(column)
    missing = c.isNull() | F.coalesce(F.isnan(c.cast("double")), F.lit(False))
    return F.when(missing, F.raise_error(F.lit(f"{what} is missing"))).otherwise(c)


def value_edges(df: DataFrame, by, rows_per_bucket: int = ROWS_PER_BUCKET) -> list[float]:
    """Split points of ``by`` so that each interval holds about ``rows_per_bucket`` rows, however many that takes."""
    values = df.select(col(by).cast("double").alias("_by")).where("_by is not null and not isnan(_by)")
    buckets = math.ceil(values.count() / rows_per_bucket)
    if buckets <= 1:
        return []
    # a text literal of fractions stays one foldable expression
    fractions = ",".join(repr(i / buckets) for i in range(1, buckets))
    points = values.agg(F.expr(
        f"percentile_approx(_by, cast(split('{fractions}', ',') as array<double>), {20 * buckets})")).first()[0]
    return sorted({p for p in points if math.isfinite(p)})


def with_bucket(df: DataFrame, by: str, edges: Sequence[float], spread: Column | None = None) -> DataFrame:
    """Adds the bucket of ``by``: -1 for a missing value, 0 for all of a key that is not spread."""
    splits = [-math.inf, *(list(edges) or [0.0]), math.inf]  # at least one cut: any cut gives the same result
    placed = Bucketizer(splits=splits, inputCol="_by", outputCol="_at", handleInvalid="keep").transform(
        df.withColumn("_by", F.col(by).cast("double")))
    at = F.when(F.col("_by").isNull(), -1.0).otherwise(F.col("_at"))
    return placed.withColumn(_BUCKET, at if spread is None else F.when(spread, at).otherwise(0.0)).drop("_by", "_at")


def _combine(how: str, column: Column) -> Column:
    return F.sum(column) if how == "sum" else F.min(column)


def running(
    df: DataFrame,
    by: str,
    sums: dict[str, str] | None = None,
    mins: dict[str, str] | None = None,
    totals: dict[str, str] | None = None,
    keys: Sequence[str] = (),
    edges: Sequence[float] = (),
    bucket: Column | None = None,
    descending: bool = False,
    spread: str | None = None,
) -> DataFrame:
    """Add running sums / minima (inclusive) and grand totals of ``df``, one row per (keys, by).

    ``sums``/``mins``/``totals`` map new column -> source column.  ``bucket`` replaces the value edges when
    the ordering column already has a natural monotone prefix (a hash).  ``spread`` names one of the keys, true
    for the keys that need more than one bucket; the others are one bucket each and need no earlier totals.
    """
    keys = list(keys)
    rolling = {n: ("sum", c) for n, c in (sums or {}).items()}
    rolling |= {n: ("min", c) for n, c in (mins or {}).items()}
    whole = dict(totals or {})
    is_spread = F.col(spread) if spread else F.lit(True)
    df = df.withColumn(_BUCKET, bucket) if bucket is not None else with_bucket(df, by, edges, is_spread if spread else None)

    order = F.col(by).desc() if descending else F.col(by).asc()
    inside = W.partitionBy(*keys, _BUCKET).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    own = W.partitionBy(*keys, _BUCKET)
    out = df.withColumns(
        {n: _combine(how, F.col(c)).over(inside) for n, (how, c) in rolling.items()}
        | {f"_o_{n}": F.sum(c).over(own) for n, c in whole.items()})

    # One row per (spread key, bucket).
    per_bucket = df.where(is_spread).groupBy(*keys, _BUCKET).agg(
        *[_combine(how, F.col(c)).alias(f"_b_{n}") for n, (how, c) in rolling.items()],
        *[F.sum(c).alias(f"_t_{n}") for n, c in whole.items()],
    )
    bucket_order = F.col(_BUCKET).desc() if descending else F.col(_BUCKET).asc()
    earlier = W.partitionBy(*keys).orderBy(bucket_order).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(*keys)
    before = per_bucket.select(
        *[F.col(k).alias(f"_k_{k}") for k in (*keys, _BUCKET)],
        *[_combine(how, F.col(f"_b_{n}")).over(earlier).alias(f"_b_{n}") for n, (how, _) in rolling.items()],
        *[F.sum(f"_t_{n}").over(every).alias(f"_t_{n}") for n in whole],
    )
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = out.join(before, same & (F.col(_BUCKET) == F.col(f"_k_{_BUCKET}")), "left")
    merged = {n: F.coalesce(F.col(f"_t_{n}"), F.col(f"_o_{n}")) for n in whole}
    for n, (how, _) in rolling.items():
        prior = F.col(f"_b_{n}")
        merged[n] = F.coalesce(prior, F.lit(0)) + F.col(n) if how == "sum" else F.least(prior, F.col(n))
    helpers = [*(f"_b_{n}" for n in rolling), *(f"_{side}_{n}" for n in whole for side in "ot"), *(f"_k_{k}" for k in (*keys, _BUCKET))]
    return joined.withColumns(merged).drop(_BUCKET, *helpers)


def ranked_counts(df: DataFrame, value: str, keys: Sequence[str] = (), edges=None) -> DataFrame:
    """Distinct values with ``n`` (their count), ``upto`` (rows at or below) and ``total``, per key."""
    edges = value_edges(df, value) if edges is None else edges
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return running(counts, value, sums={"upto": "n"}, totals={"total": "n"}, keys=keys, edges=edges)


def exact_quantiles(df: DataFrame, value: str, fractions: dict[str, float], keys: Sequence[str] = (), edges=None) -> DataFrame:
    """Exact linear-interpolated quantiles per key; no buffer of all values in one task."""
    ranked = ranked_counts(df, value, keys, edges)
    aggs = []
    for name, q in fractions.items():
        place = F.lit(float(q)) * (F.col("total") - 1)
        for side, index in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            aggs.append(F.min(F.when(F.col("upto") > index, F.col(value))).alias(f"_{side}_{name}"))
    cut = ranked.groupBy(*keys).agg(F.max("total").alias("n"), *aggs)
    out = {}
    for name, q in fractions.items():
        place = F.lit(float(q)) * (F.col("n") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out[name] = lo + (hi - lo) * (place - F.floor(place))
    return cut.select(*keys, "n", *[c.alias(n) for n, c in out.items()])


# ---- ranking metrics ---------------------------------------------------------

def _score_table(df: DataFrame, label: str, score: str, keys) -> DataFrame:
    checked = df.select(*keys, known(score, score).alias(score), known(label, label).cast("long").alias("_label"))
    return checked.groupBy(*keys, score).agg(F.sum("_label").alias("pos"), F.count("*").alias("n"))


def score_ranking(df: DataFrame, label: str, score: str, keys: Sequence[str] = (), edges=None) -> DataFrame:
    """One row per distinct score: ``pos``/``n`` at it, ``upto``/``tp_upto`` at or below, ``total``/``total_pos``.

    A missing score or label is an error.  Every ranking and calibration metric is an aggregate of this table.
    """
    edges = value_edges(df, score) if edges is None else edges
    return running(
        _score_table(df, label, score, keys), score, sums={"upto": "n", "tp_upto": "pos"},
        totals={"total": "n", "total_pos": "pos"}, keys=keys, edges=edges)


def ranking_aggregates() -> dict[str, Column]:
    """AUROC (averaged tie ranks) and non-interpolated average precision as aggregates of a score ranking."""
    pos, n, upto = F.col("pos"), F.col("n"), F.col("upto")
    ranksum = F.sum(pos * ((upto - n) + (n + 1) / 2))
    p, t = F.max("total_pos").cast("double"), F.max("total").cast("double")
    # from the top down: positives and rows at or above this score
    above_pos, above = F.col("total_pos") - F.col("tp_upto") + pos, F.col("total") - upto + n
    area = F.sum(pos * (above_pos / above))
    return {
        "auroc": F.when((p > 0) & (t > p), F.try_divide(ranksum - p * (p + 1) / 2, p * (t - p))),
        "average_precision": F.when(p > 0, F.try_divide(area, p)),
    }


def auroc(df: DataFrame, label: str, score: str, keys: Sequence[str] = (), edges=None) -> DataFrame:
    """Rank-sum AUROC per key; NULL when a class is empty."""
    ranked = score_ranking(df, label, score, keys, edges)
    return ranked.groupBy(*keys).agg(ranking_aggregates()["auroc"].alias("auroc"))


def average_precision(df: DataFrame, label: str, score: str, keys: Sequence[str] = (), edges=None) -> DataFrame:
    """Average precision per key, equal scores entering together; NULL without positives."""
    ranked = score_ranking(df, label, score, keys, edges)
    return ranked.groupBy(*keys).agg(ranking_aggregates()["average_precision"].alias("average_precision"))


def risk_coverage(df: DataFrame, loss: str, uncertainty: str, keys: Sequence[str] = (), edges=None) -> DataFrame:
    """Cumulative mean loss while accepting in order of uncertainty; ties are one step.

    A missing uncertainty or loss is an error: it has no place in the order.
    """
    edges = value_edges(df, uncertainty) if edges is None else edges
    df = df.select(*keys, known(uncertainty, uncertainty).alias(uncertainty), known(loss, loss).alias(loss))
    steps = df.groupBy(*keys, uncertainty).agg(F.sum(loss).alias("loss"), F.count("*").alias("n"))
    ranked = running(
        steps, uncertainty, sums={"accepted": "n", "lost": "loss"}, totals={"total": "n"},
        keys=keys, edges=edges,
    )
    return ranked.select(
        *keys,
        (F.col("accepted") / F.col("total")).alias("coverage"),
        (F.col("lost") / F.col("accepted")).alias("risk"),
        F.col(uncertainty).alias("threshold"),
        "accepted",
    )


def pareto_frontier(df: DataFrame, cost: str, risk: str, edges=None) -> DataFrame:
    """Rows no other row dominates (both axes at most, one strictly less); exact copies all stay.

    A missing cost or risk is an error.
    """
    edges = value_edges(df, cost) if edges is None else edges
    df = df.withColumns({cost: known(cost, cost), risk: known(risk, risk)})
    best = df.groupBy(cost).agg(F.min(risk).alias("_best"))
    best = running(best, cost, mins={"_upto": "_best"}, edges=edges)
    # The running minimum includes the row itself; it is on the frontier only when it *sets* the minimum
    # strictly below everything cheaper, i.e. when no cheaper cost already reached this risk.
    marks = best.groupBy("_upto").agg(F.min(cost).alias("_cheapest"))
    corners = marks.select(F.col("_cheapest").alias(cost), F.col("_upto").alias(risk))
    return df.join(corners, [cost, risk], "left_semi")


def kth_smallest(df: DataFrame, value: str, k: int, edges=None) -> DataFrame:
    """One row with the k-th smallest value (1-based), NULL if there are fewer."""
    ranked = ranked_counts(df, value, edges=edges)
    return ranked.agg(F.min(F.when(F.col("upto") >= k, F.col(value))).alias("value"))
