"""Pairs of a decision group counted for many policies over one index of the reference intervals.

The index is a merge-sort tree laid out as rows: once per decision group the interval ends are ranked, and every row is
put into the cells (bit level, prefix) in which it meets exactly the rows whose interval lies wholly below its own
(see :mod:`pairs`).  Inside a cell the rows' candidate predictions are sorted once.  A policy then only says which
prediction of a row is active; running counts of the active ones, one column per policy, give its correctly ordered
pairs, and the product of totals its resolved pairs.  Neither ranks nor sorting are repeated per policy.

Groups of up to ``PAIRED_ROWS`` rows need no index: the pairs of a group are formed where the group stands, with one bit per
two predictions that says whether a pair is resolved or correct, so a policy reads a bit instead of scanning cells.

The cells of a group of more than ``rows_per_bucket`` rows are cut at prediction values, and what lies in earlier pieces
of a cell joins the piece as one text of counts, so no task holds a whole hot cell.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import finite
from ..plans.lineage import cut_lineage
from .ordered import ROWS_PER_BUCKET, _BUCKET, value_edges, with_bucket
from .pairs import LARGE, dominance_cells, sized

_UNIT = ["_group", "_level", "_cell", _BUCKET]
_RUN_ROWS, _COUNTERS = 1 << 15, 1 << 22
PAIRED_ROWS, _PAIRS_AT_ONCE = 256, 1 << 18  # from about 700 rows on the index takes less time


def interval_index(
    rows: DataFrame, group: str, predictions: Sequence[str], carried: Sequence[str], reference: str = "reference",
    uncertainty: str = "reference_uncertainty", tie_tolerance: float = 0.0, rows_per_bucket: int | None = None,
) -> DataFrame:
    """(unit columns, q, kind, value, below, carried): one row per cell, row and usable prediction, written once.

    ``q`` is 1 where the row asks how many lie below it, 0 where it is one of those; ``value`` is the prediction number
    ``kind``, for an asking row less ``tie_tolerance``, which also widens the reference intervals.
    """
    if tie_tolerance < 0:
        raise ValueError("tie_tolerance must be non-negative")
    rows_per_bucket = rows_per_bucket or ROWS_PER_BUCKET
    narrow = rows.where(finite(reference)).select(
        F.col(group).alias("_group"), F.col(reference).cast("double").alias("_r"), F.coalesce(F.col(uncertainty), F.lit(0.0)).alias("_u"),
        F.array(*[F.col(p).cast("double") for p in predictions]).alias("_values"), *carried)
    narrow, _ = sized(narrow, ["_group"], rows_per_bucket)
    tolerance = F.lit(float(tie_tolerance))
    edges = value_edges(narrow.where(LARGE), "_r", rows_per_bucket)
    low, high = F.col("_r") - F.col("_u") - tolerance, F.col("_r") + F.col("_u")
    both = {c: (F.col(c), F.col(c)) for c in ("_values", *carried)}
    cells = dominance_cells(narrow, ["_group", LARGE], low, high, both, edges)
    events = cells.select("_group", LARGE, "_level", "_cell", "q", F.posexplode("_values").alias("kind", "_value"), *carried)
    value = F.col("_value") - F.when(F.col("q") == 1, tolerance).otherwise(F.lit(0.0))
    events = events.where(finite("_value")).withColumn("value", value)
    # pieces of large cells end at the same values on both sides, or a piece would not know what lies below it
    cuts = value_edges(narrow.where(LARGE).select(F.explode("_values").alias("_v")), "_v", rows_per_bucket)
    placed = with_bucket(events, "value", cuts, F.col(LARGE))
    return cut_lineage(placed.select(*_UNIT, LARGE, "q", "kind", "value", *carried))


def _whole_units(batches: Iterator[pa.RecordBatch], keys: Sequence[str] = _UNIT) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches regrouped into tables of whole units, with the row numbers where units start (and the end)."""
    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= _RUN_ROWS:
            table = pa.Table.from_batches(held).combine_chunks()
            starts = _starts(table, keys)
            last = int(starts[-2])
            if last:
                yield table.slice(0, last), starts[:-1]
            held, rows = table.slice(last).combine_chunks().to_batches(), table.num_rows - last
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, _starts(table, keys)


def _starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    changed = np.zeros(table.num_rows, bool)
    changed[:1] = True
    for name in keys:
        column = table.column(name)
        changed[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    return np.r_[np.flatnonzero(changed), table.num_rows]


class Policies:
    """Which prediction is active: ``active[lattice][slot]`` lists the active kind of each of the lattice's policies."""

    def __init__(self, slots: Sequence[str], active: Sequence[Sequence[Sequence[int]]], ids: Sequence[int]):
        self.slots, self.ids = list(slots), np.array(ids)
        self.active = [np.array(a, np.int8).reshape(len(a), -1) for a in active]

    def blocks(self, table: pa.Table) -> Iterator[tuple[slice, np.ndarray]]:
        """(policies, rows x policies of 0 and 1), a bounded number of policies at a time."""
        kind = table.column("kind").to_numpy()
        at_once = max(1, _COUNTERS // max(1, table.num_rows))
        before = 0
        for name, active in zip(self.slots, self.active):
            slot = table.column(name).to_numpy()
            for start in range(0, active.shape[1], at_once):
                some = active[:, start:start + at_once]
                yield slice(before + start, before + start + some.shape[1]), (some[slot] == kind[:, None]).astype(np.int64)
            before += active.shape[1]


def _totals(shared):
    """Active predictions among the rows that lie below, per unit and policy."""
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        policies = shared.value
        for table, starts in _whole_units(batches):
            below = 1 - table.column("q").to_numpy()
            out = np.zeros((len(starts) - 1, len(policies.ids)), np.int64)
            for where, on in policies.blocks(table):
                out[:, where] = np.add.reduceat(on * below[:, None], starts[:-1], axis=0)
            first = table.take(pa.array(starts[:-1])).select(_UNIT).combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [*[c.combine_chunks() for c in first.columns], pa.array(list(out), pa.list_(pa.int64()))], [*_UNIT, "totals"])

    return compute


def _counted(shared):
    """Per policy: pairs in which both predictions are active, and those among them with the higher one above."""
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        policies = shared.value
        resolved, correct = np.zeros((2, len(policies.ids)), np.int64)
        for table, starts in _whole_units(batches):
            q, value = table.column("q").to_numpy(), table.column("value").to_numpy()
            unit = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            new = np.r_[True, (value[1:] != value[:-1]) | (unit[1:] != unit[:-1])]
            tied = np.maximum.accumulate(np.where(new, np.arange(len(value)), 0))  # first row of the same value
            asks = np.flatnonzero(q)
            heads = table.select(["earlier", "whole"]).take(pa.array(starts[:-1])).combine_chunks()
            cut = np.flatnonzero(heads.column("whole").is_valid().to_numpy(zero_copy_only=False))  # pieces of large cells
            lists = [np.array([text.split(",") for text in heads.column(c).take(pa.array(cut)).to_pylist()], np.int64).reshape(-1, len(policies.ids))
                     for c in ("earlier", "whole")]
            for where, on in policies.blocks(table):
                upto = np.zeros((len(q) + 1, on.shape[1]), np.int64)
                np.cumsum(on * (1 - q)[:, None], axis=0, out=upto[1:])
                begin, whole = upto[starts[:-1]].copy(), upto[starts[1:]] - upto[starts[:-1]]
                begin[cut] -= lists[0][:, where]
                whole[cut] = lists[1][:, where]
                mine, at = on[asks], unit[asks]
                correct[where] += np.einsum("ij,ij->j", mine, upto[tied[asks]] - begin[at])
                resolved[where] += np.einsum("ij,ij->j", mine, whole[at])
        yield pa.RecordBatch.from_arrays([pa.array(policies.ids), pa.array(resolved), pa.array(correct)], ["policy_id", "resolved", "correct"])

    return compute


def policy_pairs(index: DataFrame, slots: Sequence[str], active, ids: Sequence[int]) -> DataFrame:
    """(policy_id, resolved, correct) over all groups of an index (see :class:`Policies`)."""
    shared = index.sparkSession.sparkContext.broadcast(Policies(slots, active, ids))
    # a fixed number of tasks: counting is work for processors, which merging small partitions would leave idle
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = lambda df, *more: df.repartition(tasks, *_UNIT).sortWithinPartitions(*_UNIT, *more)
    columns = [*_UNIT, "q", "kind", *slots]
    group = index.schema["_group"].dataType.simpleString()
    types = f"_group {group}, _level int, _cell long, {_BUCKET} double, totals array<long>"
    pieces = ordered(index.where(LARGE).select(*columns)).mapInArrow(_totals(shared), types)
    each = cut_lineage(pieces).select(*_UNIT, F.posexplode("totals").alias("_p", "_n"))
    cell = W.partitionBy("_group", "_level", "_cell", "_p")
    summed = each.select(
        *_UNIT, "_p", F.coalesce(F.sum("_n").over(cell.orderBy(_BUCKET).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("e"),
        F.sum("_n").over(cell).alias("w"))
    # as texts: the size of an Arrow batch with lists is measured anew for every row, over all its rows
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    listed = summed.groupBy(*_UNIT).agg(F.array_sort(F.collect_list(F.struct("_p", "e", "w"))).alias("_l")).select(
        *[F.col(c).alias(f"_k{c}") for c in _UNIT], joined("_l.e").alias("earlier"), joined("_l.w").alias("whole"))
    same = [F.col(c) == F.col(f"_k{c}") for c in _UNIT]
    # the counts stand on the first row of a unit only
    first = F.row_number().over(W.partitionBy(*_UNIT).orderBy("value", "q")) == 1
    large = index.where(LARGE).withColumn("_first", first)
    with_lists = large.join(listed, same[0] & same[1] & same[2] & same[3] & F.col("_first"), "left")
    none = F.lit(None).cast("string")
    rows = index.where(f"not {LARGE}").select(*columns, "value", none.alias("earlier"), none.alias("whole")).unionByName(
        with_lists.select(*columns, "value", "earlier", "whole"))
    counted = ordered(rows, "value", F.col("earlier").isNull()).mapInArrow(_counted(shared), "policy_id long, resolved long, correct long")
    return counted.groupBy("policy_id").agg(F.sum("resolved").alias("resolved"), F.sum("correct").alias("correct"))


def _paired(shared, kinds: int, tolerance: float):
    """Like :func:`_counted`, from the pairs of whole groups."""
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        policies = shared.value
        resolved, correct = np.zeros((2, len(policies.ids)), np.int64)
        for table, starts in _whole_units(batches, ["_group"]):
            floats = lambda name: table.column(name).to_numpy()
            low, high = floats("_low"), floats("_high")
            below = [floats(f"_value_{k}") for k in range(kinds)]
            asks, usable = [v - tolerance for v in below], [np.isfinite(v) for v in below]
            unclear, endless = np.isnan(low), np.isnan(high)  # in Spark's order NaN is above every number
            slots = [table.column(name).to_numpy() for name in policies.slots]
            size = np.repeat(np.diff(starts), np.diff(starts))
            begin = np.repeat(starts[:-1], np.diff(starts))
            upto = np.cumsum(size)
            cuts = np.searchsorted(upto, np.arange(_PAIRS_AT_ONCE, upto[-1], _PAIRS_AT_ONCE))
            edges = np.unique(np.r_[0, cuts, len(size)])
            for a, b in zip(edges[:-1], edges[1:]):
                n = size[a:b]
                x = np.repeat(np.arange(a, b), n)
                y = np.arange(len(x)) - np.repeat(np.cumsum(n) - n - begin[a:b], n)
                above = (low[x] > high[y]) | (unclear[x] & ~endless[y])
                x, y = x[above], y[above]
                solved, right = np.zeros((2, len(x)), np.uint16)
                for i in range(kinds):
                    for j in range(kinds):
                        both = usable[i][x] & usable[j][y]
                        solved |= both.astype(np.uint16) << (kinds * i + j)
                        right |= (both & (asks[i][x] > below[j][y])).astype(np.uint16) << (kinds * i + j)
                at = 0
                for slot, active in zip(slots, policies.active):
                    mine, other = slot[x], slot[y]
                    for p in range(active.shape[1]):
                        kind = active[:, p].astype(np.uint16)
                        bit = np.uint16(1) << ((kind * np.uint16(kinds))[mine] + kind[other])
                        resolved[at] += np.count_nonzero(solved & bit)
                        correct[at] += np.count_nonzero(right & bit)
                        at += 1
        yield pa.RecordBatch.from_arrays([pa.array(policies.ids), pa.array(resolved), pa.array(correct)], ["policy_id", "resolved", "correct"])

    return compute


def small_group_pairs(
    rows: DataFrame, group: str, predictions: Sequence[str], slots: Sequence[str], active, ids: Sequence[int], reference: str = "reference",
    uncertainty: str = "reference_uncertainty", tie_tolerance: float = 0.0,
) -> DataFrame:
    """(policy_id, resolved, correct) over groups of at most ``PAIRED_ROWS`` rows, as :func:`policy_pairs` counts them over an index."""
    if tie_tolerance < 0:
        raise ValueError("tie_tolerance must be non-negative")
    if len(predictions) > 4:
        raise ValueError("at most four predictions a row")  # a pair has 16 bits
    shared = rows.sparkSession.sparkContext.broadcast(Policies(slots, active, ids))
    r, u = F.col(reference).cast("double"), F.coalesce(F.col(uncertainty), F.lit(0.0)).cast("double")
    nan = F.lit(float("nan"))
    narrow = rows.where(finite(reference)).select(
        F.col(group).alias("_group"), (r - u - F.lit(float(tie_tolerance))).alias("_low"), (r + u).alias("_high"),
        *[F.coalesce(F.col(p).cast("double"), nan).alias(f"_value_{k}") for k, p in enumerate(predictions)], *slots)
    counted = narrow.repartition("_group").sortWithinPartitions("_group").mapInArrow(
        _paired(shared, len(predictions), float(tie_tolerance)), "policy_id long, resolved long, correct long")
    return counted.groupBy("policy_id").agg(F.sum("resolved").alias("resolved"), F.sum("correct").alias("correct"))
