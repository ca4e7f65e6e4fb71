"""Pairwise ordering metrics counted without ever forming the pairs.

"How many pairs (x, y) of a group have a(x) > a'(y) and b(x) > b'(y)?" is answered by dominance counting:

1. every row becomes a *query* at a(x) and a *point* at a'(y); positions are dense ranks of those values
   inside the group (an ordered scan, see :mod:`ordered`, that spreads the groups that are large);
2. position p < q exactly when, at one single bit level, both share the higher bits, p has a 0 and q a 1.
   So each event goes to about half of log2(group size) (group, level, prefix) cells, where it meets
   precisely its counterparts;
3. inside a cell the second condition is a running count in order of b.

Cost is n log n rows however large the largest group is, and the running counts are bucketed by value, so a
group holding a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import all_of, col, finite
from ..plans.lineage import cut_lineage
from .ordered import ROWS_PER_BUCKET, known, running, value_edges


LARGE = "_large"  # whether the row's group needs more than one bucket


def sized(df: DataFrame, keys: Sequence[str], rows_per_bucket: int) -> tuple[DataFrame, DataFrame]:
    """(rows, group sizes): the rows written once with ``_large``, whether their group needs more than one bucket."""
    df = cut_lineage(df)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") > rows_per_bucket).select(*[F.col(k).alias(f"_g_{k}") for k in keys], F.lit(True).alias(LARGE))
    same = all_of(*[F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys])
    flagged = df.join(large, same, "left").drop(*[f"_g_{k}" for k in keys])
    return flagged.withColumn(LARGE, F.coalesce(LARGE, F.lit(False))), sizes


def _events(df: DataFrame, keys, query: Column, point: Column, carried: dict[str, tuple[Column, Column]] | None = None) -> DataFrame:
    """Two rows per row: as a query at ``query`` (q = 1) and as a point at ``point`` (q = 0), with what each side carries."""
    carried = carried or {}
    sides = [
        F.struct(place.alias("v"), F.lit(q).alias("q"), *[values[side].alias(n) for n, values in carried.items()])
        for side, (place, q) in enumerate(((query, 1), (point, 0)))
    ]
    return df.select(*keys, F.explode(F.array(*sides)).alias("_e")).select(*keys, "_e.*")


def count_above(df: DataFrame, keys: Sequence[str], query: Column, point: Column, name: str, edges=()) -> DataFrame:
    """Per key: number of ordered pairs with ``query(x) > point(y)``."""
    events = _events(df, keys, query, point)
    table = events.groupBy(*keys, "v").agg(F.sum("q").alias("q"), F.sum(1 - F.col("q")).alias("p"))
    scan = running(table, "v", sums={"seen": "p"}, keys=keys, edges=edges, spread=LARGE)
    return scan.groupBy(*keys).agg(F.sum(F.col("q") * (F.col("seen") - F.col("p"))).alias(name))


def dominance_cells(
    df: DataFrame, keys: Sequence[str], query: Column, point: Column, carried: dict[str, tuple[Column, Column]], edges=(),
) -> DataFrame:
    """Every event in the cells (keys, _level, _cell) in which a query meets exactly the points below it.

    ``carried`` names what a query and what a point takes along; ``q`` tells them apart.
    """
    keys = list(keys)
    events = _events(df, keys, query, point, carried)
    ranks = running(
        events.select(*keys, "v").distinct().withColumn("_one", F.lit(1)), "v",
        sums={"_rank": "_one"}, totals={"_size": "_one"}, keys=keys, edges=edges, spread=LARGE,
    ).select(*keys, "v", (F.col("_rank") - 1).alias("_rank"), "_size")
    placed = events.join(ranks, [*keys, "v"])
    # ranks are 0 .. size-1: levels = bit length of the largest rank
    levels = F.length(F.bin(F.greatest(F.col("_size") - 1, F.lit(1))))
    return (
        placed.withColumn("_level", F.explode(F.sequence(F.lit(0), levels - 1)))
        .withColumn("_digit", F.expr("shiftright(_rank, _level)"))
        .where(F.expr("_digit & 1") == F.col("q"))
        .withColumn("_cell", F.expr("shiftright(_digit, 1)"))
    )


def count_dominating(
    df: DataFrame, keys: Sequence[str], query: Column, point: Column, query_b: Column, point_b: Column,
    name: str, edges=(), edges_b=(),
) -> DataFrame:
    """Per key: number of ordered pairs with ``query(x) > point(y)`` and ``query_b(x) > point_b(y)``."""
    keys = list(keys)
    cells = dominance_cells(df, keys, query, point, {"b": (query_b, point_b)}, edges)
    inner = [*keys, "_level", "_cell"]
    table = cells.groupBy(*inner, "b").agg(F.sum("q").alias("q"), F.sum(1 - F.col("q")).alias("p"))
    scan = running(table, "b", sums={"seen": "p"}, keys=inner, edges=edges_b, spread=LARGE)
    return scan.groupBy(*keys).agg(F.sum(F.col("q") * (F.col("seen") - F.col("p"))).alias(name))


def _add_up(keys, parts: list[DataFrame]) -> DataFrame:
    """Union of (keys, one count) tables summed into one row per key; missing counts are 0."""
    names = [[c for c in p.columns if c not in keys][0] for p in parts]
    zero = {n: F.lit(0).cast("long") for n in names}
    union = None
    for part, own in zip(parts, names):
        part = part.select(*keys, *[F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) if n == own
                                    else zero[n].alias(n) for n in names])
        union = part if union is None else union.unionByName(part)
    return union.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names])



def _pairs(n: Column) -> Column:
    return (n * (n - 1) / 2).cast("long")


def decision_pairs(
    df: DataFrame, group, prediction="prediction", reference="reference",
    uncertainty="reference_uncertainty", rows_per_bucket: int = ROWS_PER_BUCKET, tie_tolerance: float = 0.0,
) -> DataFrame:
    """Per decision group: resolved, unresolved and correctly ordered pairs.

    A pair is unresolved if a prediction or reference is missing or the two reference intervals
    ``reference +- uncertainty`` are no more than ``tie_tolerance`` apart; it is correct if the predictions are in the
    order of the disjoint intervals, by more than ``tie_tolerance``.  ``group`` may be several columns (policy,
    decision group).
    """
    if tie_tolerance < 0:
        raise ValueError("tie_tolerance must be non-negative")
    tolerance = F.lit(float(tie_tolerance))
    keys = [group] if isinstance(group, str) else list(group)
    # read several times below: write the narrow input once
    df, sizes = sized(df.where(all_of(*[F.col(k).isNotNull() for k in keys])).select(
        *keys, col(prediction).cast("double").alias("_c"), col(reference).cast("double").alias("_r"),
        F.coalesce(col(uncertainty), F.lit(0.0)).alias("_u"),
    ), keys, rows_per_bucket)
    usable = df.where(finite("_c") & finite("_r"))
    low, high = F.col("_r") - F.col("_u") - tolerance, F.col("_r") + F.col("_u")
    large = usable.where(LARGE)
    edges, edges_b = value_edges(large, "_r", rows_per_bucket), value_edges(large, "_c", rows_per_bucket)
    inner = [*keys, LARGE]
    counts = _add_up(keys, [
        sizes,
        count_above(usable, inner, low, high, "resolved", edges).drop(LARGE),
        count_dominating(usable, inner, low, high, F.col("_c") - tolerance, F.col("_c"), "correct", edges, edges_b).drop(LARGE),
    ])
    return counts.select(
        *keys, "n", "resolved", (_pairs(F.col("n")) - F.col("resolved")).alias("unresolved"), "correct",
        F.when(F.col("resolved") > 0, F.col("correct") / F.col("resolved")).alias("ordering_accuracy"),
    )


def ordering_accuracy(
    df: DataFrame, group, candidate: str, reference: str, tie_tolerance: float = 1e-8, rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Per group: share of pairs whose relation (<, tied, >) the candidate reproduces; 1.0 for a single row.

    A missing value is an error; a NULL group is a group.
    """
    if tie_tolerance < 0:
        raise ValueError("tie_tolerance must be non-negative")
    keys = [group] if isinstance(group, str) else list(group)
    tol = F.lit(float(tie_tolerance))
    df, sizes = sized(df.select(
        *keys, known(candidate, "candidate").cast("double").alias("_c"), known(reference, "reference").cast("double").alias("_r")),
        keys, rows_per_bucket)
    large, inner = df.where(LARGE), [*keys, LARGE]
    edges, edges_b = value_edges(large, "_r", rows_per_bucket), value_edges(large, "_c", rows_per_bucket)
    c, r = F.col("_c"), F.col("_r")
    # sign flip turns "candidate strictly smaller" into a second dominance count
    mirrored = [-e for e in reversed(edges_b)]
    counts = _add_up(keys, [
        sizes,
        count_above(df, inner, r - tol, r, "ref_untied", edges).drop(LARGE),
        count_above(df, inner, c - tol, c, "cand_untied", edges_b).drop(LARGE),
        count_dominating(df, inner, r - tol, r, c - tol, c, "concordant", edges, edges_b).drop(LARGE),
        count_dominating(df, inner, r - tol, r, -c - tol, -c, "discordant", edges, mirrored).drop(LARGE),
    ])
    pairs = _pairs(F.col("n"))
    both_tied = pairs - F.col("ref_untied") - F.col("cand_untied") + F.col("concordant") + F.col("discordant")
    kept = F.col("concordant") + both_tied
    accuracy = F.coalesce(F.try_divide(kept.cast("double"), pairs.cast("double")), F.lit(1.0))
    return counts.select(
        *keys, "n", pairs.alias("pairs"), kept.alias("preserved"), accuracy.alias("ordering_accuracy"),
        (kept == pairs).alias("ordering_preserved"),
    )
