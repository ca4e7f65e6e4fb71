"""Reports over (label, score) and (predicted, reference) columns; ``keys`` gives one report per stratum."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from ..plans.lineage import cut_lineage
from .md5_lanes import LANES, block_words, digit_ranges, digits, leading_60, md5_words
from .ordered import kth_smallest, ranking_aggregates, running, score_ranking, value_edges
from .statistics import Statistic, aggregate_statistic


def regression_report(df: DataFrame, predicted: str, reference: str, keys: Sequence[str] = ()) -> DataFrame:
    error = F.col("_e")
    return df.select(*keys, (col(predicted) - col(reference)).alias("_e")).groupBy(*keys).agg(
        F.count("_e").alias("n"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(error).alias("bias"), F.max(F.abs(error)).alias("max_abs"))


def brier_score(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    miss = col(score) - col(label)
    return df.groupBy(*keys).agg(F.avg(miss * miss).alias("brier"))


def mean_cost(df: DataFrame, cost: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean of non-negative costs; a negative or missing one makes it NULL."""
    bad = F.count(F.when(col(cost).isNull() | (col(cost) < 0), 1))
    return df.groupBy(*keys).agg(F.when(bad == 0, F.avg(cost)).alias("mean_cost"))


def bin_number(score, bins: int) -> Column:
    return F.least(F.floor(col(score) * bins), F.lit(bins - 1)).cast("int")


def _binned(df: DataFrame, label: str, score: str, bins: int, keys) -> DataFrame:
    return df.groupBy(*keys, bin_number(score, bins).alias("bin")).agg(
        F.count("*").alias("count"), F.avg(score).alias("mean_probability"),
        F.avg(F.col(label).cast("double")).alias("event_fraction"))


def calibration_bins(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """All ``bins`` bins, empty ones with NULL means."""
    if bins < 1:
        raise ValueError("bins must be positive")
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    found = _binned(df, label, score, bins, [])
    return every.join(found, "bin", "left").select(
        "bin", (F.col("bin") / bins).alias("lower"), ((F.col("bin") + 1) / bins).alias("upper"),
        F.coalesce("count", F.lit(0)).alias("count"), "mean_probability", "event_fraction")


def calibration_error(df: DataFrame, label: str, score: str, bins: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    gap = F.abs(F.col("mean_probability") - F.col("event_fraction"))
    return _binned(df, label, score, bins, keys).groupBy(*keys).agg(
        (F.sum(F.col("count") * gap) / F.sum("count")).alias("ece"))


def classification_report(
    df: DataFrame, label: str, score: str, threshold: float = 0.5, bins: int = 10, keys: Sequence[str] = (),
) -> DataFrame:
    """Counts, ranking and calibration in one row per stratum; undefined ratios are NULL."""
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be a probability")
    keys = list(keys)
    ranked = score_ranking(df, label, score, keys).withColumn("_bin", bin_number(score, bins))
    s, pos, n = F.col(score), F.col("pos"), F.col("n")
    hit = s >= threshold
    how_many = lambda count, condition: F.coalesce(F.sum(F.when(condition, count)), F.lit(0))
    # a bin's |mean score - event share| weighted by its size is |sum of scores - positives|
    gaps = [F.abs(F.sum(F.when(F.col("_bin") == b, s * n - pos).otherwise(0.0))) for b in range(bins)]
    report = ranked.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("pos").alias("positives"),
        (F.sum("pos") / F.sum("n")).alias("prevalence"),
        *[c.alias(name) for name, c in ranking_aggregates().items()],
        (F.sum(pos * (s - 1) * (s - 1) + (n - pos) * s * s) / F.sum("n")).alias("brier"),
        (sum(gaps[1:], gaps[0]) / F.sum("n")).alias("ece"),
        how_many(pos, hit).alias("tp"), how_many(n - pos, hit).alias("fp"),
        how_many(pos, ~hit).alias("fn"), how_many(n - pos, ~hit).alias("tn"),
    )
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), (F.col(a) + F.col(b)).cast("double"))
    return report.withColumns({"precision": ratio("tp", "fp"), "recall": ratio("tp", "fn")})


def raw_score_report(df: DataFrame, score: str, targets: dict[str, str]) -> DataFrame:
    """Ranking quality of an uncalibrated score against several targets, on rows where it is known."""
    known = df.where(F.col(score).isNotNull())
    long = known.select(F.col(score).alias("_s"), F.explode(F.array(*[
        F.struct(F.lit(t).alias("target"), F.col(c).cast("int").alias("y")) for t, c in targets.items()])).alias("_t"))
    long = long.select("_s", "_t.*").where(F.col("y").isNotNull())
    ranked = score_ranking(long, "y", "_s", ["target"], value_edges(known, score))
    return ranked.groupBy("target").agg(F.sum("n").alias("n"), *[c.alias(name) for name, c in ranking_aggregates().items()])


def class_balance(df: DataFrame, partition: str, targets: dict[str, str]) -> DataFrame:
    """Size, positives and single-class flag per (target, partition)."""
    long = df.select(partition, F.explode(F.array(*[
        F.struct(F.lit(t).alias("target"), F.col(c).cast("int").alias("y")) for t, c in targets.items()])).alias("_t"))
    return long.select(partition, "_t.*").groupBy("target", partition).agg(
        F.count("y").alias("n"), F.sum("y").alias("positives"), (F.min("y") == F.max("y")).alias("single_class"))


def blind_rate(df: DataFrame, flag: str, uncertainty: str = "reference_uncertainty", keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(F.col(flag).cast("long")).alias("blind_count"),
        F.avg(F.col(flag).cast("double")).alias("blind_fraction"),
        F.sum(F.col(uncertainty).isNull().cast("long")).alias("uncertainty_missing"))


def stratified_regression(df: DataFrame, predicted: str, reference: str, strata: Sequence[str]) -> DataFrame:
    """The regression report overall and along each stratum, in one pass of grouping sets."""
    error = F.col("_e")
    base = df.select(*[F.col(s).cast("string").alias(s) for s in strata], (col(predicted) - col(reference)).alias("_e"))
    sets = base.groupingSets([[], *[[F.col(s)] for s in strata]], *[F.col(s) for s in strata])
    out = sets.agg(F.grouping_id().alias("_g"), F.count("_e").alias("n"), F.avg(F.abs(error)).alias("mae"),
                   F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(error).alias("bias"))
    name, value = F.lit("all"), F.lit("all")
    width = len(strata)
    for i, s in enumerate(strata):
        kept = F.col("_g") == (2**width - 1) - 2 ** (width - 1 - i)
        name, value = F.when(kept, F.lit(s)).otherwise(name), F.when(kept, F.col(s)).otherwise(value)
    return out.select(name.alias("stratum"), value.alias("level"), "n", "mae", "rmse", "bias")


# ---- weighted diagnostics ----------------------------------------------------

def weighted_risk(df: DataFrame, weights: dict[str, float], row_id: str = "id", features: str = "features") -> DataFrame:
    """Weighted mean of normalised scores in a map; NULL when keys differ or a score is outside [0, 1]."""
    if not weights or any(w < 0 for w in weights.values()) or sum(weights.values()) <= 0:
        raise ValueError("weights must be non-negative with a positive sum")
    names = sorted(weights)
    value = lambda n: F.try_element_at(features, F.lit(n))
    ok = (F.array_sort(F.map_keys(features)) == F.array(*[F.lit(n) for n in names]))
    for n in names:
        ok = ok & (value(n) >= 0) & (value(n) <= 1)
    top = sum((F.lit(float(weights[n])) * value(n) for n in names[1:]), F.lit(float(weights[names[0]])) * value(names[0]))
    return df.select(row_id, F.when(ok, top / F.lit(float(sum(weights[n] for n in names)))).alias("weighted_risk"))


# ---- group conformal ---------------------------------------------------------

def fit_conformal(df: DataFrame, residual: str, group: str, alpha: float = 0.1) -> DataFrame:
    """One row (groups, rank, quantile, bounded): order statistic of each group's worst absolute residual."""
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie strictly between 0 and 1")
    worst = cut_lineage(df.groupBy(group).agg(F.max(F.abs(residual)).alias("_worst")))  # one row per group
    groups = worst.count()
    rank = math.ceil((groups + 1) * (1 - alpha))
    found = kth_smallest(worst, "_worst", rank)
    return found.select(
        F.lit(groups).cast("long").alias("groups"), F.lit(rank).cast("long").alias("rank"),
        F.col("value").alias("quantile"), F.lit(rank <= groups).alias("bounded"))


def conformal_interval(df: DataFrame, prediction: str, quantile: float | None) -> DataFrame:
    """prediction +- quantile, or an unbounded interval with its reason."""
    if quantile is None:
        return df.withColumns({
            "lower": F.lit(None).cast("double"), "upper": F.lit(None).cast("double"), "bounded": F.lit(False),
            "reason": F.lit("insufficient calibration groups for requested coverage")})
    return df.withColumns({
        "lower": F.col(prediction) - F.lit(quantile), "upper": F.col(prediction) + F.lit(quantile),
        "bounded": F.lit(True), "reason": F.lit(None).cast("string")})


# ---- cluster bootstrap -------------------------------------------------------

GROUPS_PER_BUCKET, REPLICATES_AT_ONCE = 1024, 64
_REPLICATES_A_TASK, _DRAWS_A_TASK = 8, 1 << 23


def draw_index(seed: int, bound, *parts: Column) -> Column:
    """A number below ``bound`` from an md5 prefix of the seed and the parts, identical on any partitioning."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % bound


def _numbered_groups(per_group: DataFrame, group: str) -> DataFrame:
    hashed = per_group.withColumns({"_h": F.md5(F.col(group).cast("string")), "_one": F.lit(1)})
    ranked = running(hashed, "_h", sums={"_n": "_one"}, bucket=F.conv(F.substring("_h", 1, 3), 16, 10).cast("double"))
    return ranked.withColumn("_index", F.col("_n") - 1).drop("_h", "_one", "_n")


def _per_group(df: DataFrame, value: str, group: str) -> DataFrame:
    """(group, _sum, _count), written once: counting, numbering and drawing all start from it."""
    return cut_lineage(df.groupBy(group).agg(F.sum(value).alias("_sum"), F.count(value).alias("_count")))


def bootstrap_replicates(
    df: DataFrame, value: str, group: str, repetitions: int, seed: int,
    statistic: Callable[[Column, Column], Column] | Statistic | None = None, per_group: DataFrame | None = None,
) -> DataFrame:
    """(replicate, statistic): groups drawn with replacement, each draw weighting all rows of its group.

    The mean needs only (sum, count) per group.  Another ``statistic`` is an *aggregate expression* of a value
    column and its weight (times the group was drawn), or a Python :class:`~tierlens.operators.statistics.Statistic`;
    both are distributed aggregations per replicate.
    """
    if repetitions < 2:
        raise ValueError("at least two repetitions are needed")
    per_group = _per_group(df, value, group) if per_group is None else per_group
    groups = per_group.count()
    if groups < 2:
        raise ValueError("bootstrap needs at least two independent clusters")
    numbered = _numbered_groups(per_group, group).withColumn("_bucket_no", F.expr(f"_index div {GROUPS_PER_BUCKET}"))
    met = _bucket_draws(numbered, groups, repetitions, seed)
    if statistic is None:
        sums = met.mapInArrow(_drawn(seed, _sums_of), "replicate long, s double, c long")
        return sums.groupBy("replicate").agg((F.sum("s") / F.sum("c")).alias("statistic"))
    weights = met.mapInArrow(_drawn(seed, _weights_of), "replicate long, _index long, _w long")
    weighted = weights.join(numbered.select("_index", group), "_index").join(df.select(group, value), group)
    return _applied(weighted, ["replicate"], value, F.col("_w"), statistic)


def _bucket_draws(numbered: DataFrame, groups: int, repetitions: int, seed: int) -> DataFrame:
    """(_bucket_no, _values, _counts): the groups of a bucket and how many draws of each replicate fall into it.

    Drawing splits in two.  Of the ``groups`` draws of a replicate each falls into a bucket of 1,024 neighbouring
    groups; only how many do is counted, so what is shuffled is a number per replicate and bucket.  Which groups of the
    bucket they pick is drawn where its groups stand as one array.
    """
    spark = numbered.sparkSession
    blocks, slices = -(-repetitions // _REPLICATES_A_TASK), -(-groups // _DRAWS_A_TASK)
    parts = spark.range(0, blocks * slices, 1, min(blocks * slices, 4 * spark.sparkContext.defaultParallelism))
    fallen = parts.mapInArrow(_fallen(seed, groups, repetitions, slices), "replicate long, _bucket_no long, _m long")
    counts = fallen.groupBy("_bucket_no", "replicate").agg(F.sum("_m").alias("_m")).groupBy(
        "_bucket_no", F.expr(f"replicate div {REPLICATES_AT_ONCE}").alias("_block")).agg(F.collect_list(F.struct("replicate", "_m")).alias("_counts"))
    # at most 1,024 groups
    listed = numbered.groupBy("_bucket_no").agg(F.array_sort(F.collect_list(F.struct("_index", "_sum", "_count"))).alias("_values"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = counts.join(listed, "_bucket_no").repartition(tasks, "_bucket_no", "_block")
    return met.select("_bucket_no", F.col("_values._sum").alias("sums"), F.col("_values._count").alias("counts"),
                      F.col("_counts.replicate").alias("replicates"), F.col("_counts._m").alias("draws"))


def _fallen(seed: int, groups: int, repetitions: int, slices: int):
    """Rows are slices of the draws of some replicates: how many of them fall into each bucket, as ``draw_index`` tells."""
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column(0).to_pylist():
                first = part // slices * _REPLICATES_A_TASK
                replicates = range(first, min(first + _REPLICATES_A_TASK, repetitions))
                heads = [np.frombuffer(f"{seed}|{r}|".encode(), np.uint8) for r in replicates]
                counts = np.zeros((len(replicates), -(-groups // GROUPS_PER_BUCKET)), np.int64)
                lower = part % slices * _DRAWS_A_TASK
                for lo, hi, places in digit_ranges(lower, min(lower + _DRAWS_A_TASK, groups)):
                    tails = digits(np.arange(lo, hi), places)
                    for head, held in zip(heads, counts):
                        text = np.concatenate([np.broadcast_to(head, (hi - lo, len(head))), tails], axis=1)
                        number = leading_60(*md5_words(block_words(text), hi - lo)[:2])
                        index = number - number // np.uint64(groups) * np.uint64(groups)
                        held += np.bincount((index // np.uint64(GROUPS_PER_BUCKET)).astype(np.int64), minlength=len(held))
                row, bucket = np.nonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first + row), pa.array(bucket), pa.array(counts[row, bucket])], ["replicate", "_bucket_no", "_m"])

    return compute


def _picks(seed: int, bucket: int, replicates: list[int], draws: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of the replicate, pick) of all draws inside a bucket, in blocks.

    One md5 of (seed, replicate, bucket, number) gives four picks of 32 bits.
    """
    heads = [f"{seed}|{r}|{bucket}|".encode() for r in replicates]
    sizes, needed = np.array([len(h) for h in heads]), -(-draws // 4)
    for size in np.unique(sizes).tolist():
        mine = np.flatnonzero(sizes == size)
        head = np.frombuffer(b"".join(heads[i] for i in mine), np.uint8).reshape(-1, size)
        for lower, upper, places in digit_ranges(0, int(needed[mine].max())):
            numbers = np.arange(lower, upper)
            tails = digits(numbers, places)
            row, at = np.nonzero(numbers < needed[mine][:, None])
            for s in range(0, len(row), LANES):
                r, k = row[s:s + LANES], at[s:s + LANES]
                picks = np.stack(md5_words(block_words(np.concatenate([head[r], tails[k]], axis=1)), len(r)), axis=1)
                some = 4 * numbers[k][:, None] + np.arange(4) < draws[mine[r]][:, None]
                yield np.broadcast_to(mine[r][:, None], picks.shape)[some], picks[some]


def _sums_of(bucket: int, replicates: np.ndarray, weights: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> tuple:
    return replicates, weights.astype(np.float64) @ sums, weights @ counts


def _weights_of(bucket: int, replicates: np.ndarray, weights: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> tuple:
    row, some = np.nonzero(weights)
    return replicates[row], bucket * GROUPS_PER_BUCKET + some, weights[row, some]


def _drawn(seed: int, of):
    """Draws groups inside their bucket: the weights of a bucket come out as one array per replicate."""
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                bucket, size = row["_bucket_no"], len(row["counts"])
                sums = np.array([0.0 if x is None else x for x in row["sums"]], np.float64)
                replicates, draws = np.array(row["replicates"], np.int64), np.array(row["draws"], np.int64)
                weights = np.zeros(len(replicates) * size, np.int64)
                for at, picks in _picks(seed, bucket, row["replicates"], draws):
                    weights += np.bincount(at * size + picks % np.uint32(size), minlength=len(weights))
                out = of(bucket, replicates, weights.reshape(-1, size), sums, np.array(row["counts"], np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int64()), pa.array(out[1], pa.float64() if of is _sums_of else pa.int64()), pa.array(out[2], pa.int64())],
                    ["replicate", *(("s", "c") if of is _sums_of else ("_index", "_w"))])

    return compute


def _applied(df: DataFrame, keys: list[str], value: str, weight: Column, statistic) -> DataFrame:
    """(keys, statistic), whichever kind of statistic it is."""
    if callable(statistic):
        return df.groupBy(*keys).agg(statistic(F.col(value), weight).alias("statistic"))
    return aggregate_statistic(df, keys, value, statistic, weight)


def cluster_bootstrap(
    df: DataFrame, value: str, group: str, repetitions: int = 1000, confidence: float = 0.95, seed: int = 42,
    statistic: Callable[[Column, Column], Column] | Statistic | None = None,
) -> DataFrame:
    """One row: estimate on the data and the percentile interval over replicates."""
    if not 0 < confidence < 1:
        raise ValueError("confidence must lie strictly between 0 and 1")
    tail = (1 - confidence) / 2
    per_group = _per_group(df, value, group)
    replicates = bootstrap_replicates(df, value, group, repetitions, seed, statistic, per_group)
    # as many values as repetitions, a parameter: the exact built-in percentile holds them
    interval = replicates.agg(
        F.percentile("statistic", F.lit(tail)).alias("lower"), F.percentile("statistic", F.lit(1 - tail)).alias("upper"),
        F.count("*").alias("repetitions"), F.lit(1).alias("_k"))
    sizes = per_group.agg((F.sum("_sum") / F.sum("_count")).alias("estimate"), F.count("*").alias("groups"), F.lit(1).alias("_k"))
    if statistic is not None:
        own = _applied(df, [], value, F.lit(1), statistic).select(F.col("statistic").alias("estimate"), F.lit(1).alias("_k"))
        sizes = sizes.drop("estimate").join(own, "_k")
    return sizes.join(interval, "_k").select(
        "estimate", "lower", "upper", F.lit(confidence).alias("confidence"), "groups", "repetitions")
