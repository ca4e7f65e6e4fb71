"""Exact order statistics of many columns at once, by refining histograms of their bits.

The bits of a double, turned so that they sort like the numbers, are read from the top, eleven at a time.  A pass counts,
for every wanted rank of every column, the next bits of the values that agree with what is known of that rank's value;
the count that reaches the rank says which bits follow.  Six passes over the rows fix all 64 bits of all ranks: no sort,
no window, and no row per row and column.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 11
PASSES = -(-64 // BITS)


def sortable(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned numbers of the same order; -0.0 and 0.0 are one, NaN is greatest."""
    bits = (np.where(np.isnan(x), np.nan, x) + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def unsortable(u: int) -> float:
    bits = u ^ (1 << 63) if u >> 63 else ~u & ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def _shift(done: int) -> int:
    """Bits that remain below the digit of a pass; the last digit may be shorter."""
    return max(0, 64 - BITS * (done + 1))


def _histograms(shared):
    """(column, wanted, digit, n): next bits of the values under each prefix."""
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, prefixes = shared.value
        above, below = 64 - BITS * done, _shift(done)
        counts = {(c, w): np.zeros(1 << (above - below), np.int64) for c, wanted in enumerate(prefixes) for w in range(len(wanted))}
        for batch in batches:
            for c, wanted in enumerate(prefixes):
                column = batch.column(c)
                u = sortable(column.drop_null().to_numpy(zero_copy_only=False).astype(np.float64))
                digit = (u >> np.uint64(below)) & np.uint64((1 << (above - below)) - 1)
                for w, prefix in enumerate(wanted):
                    # nothing is above the first digit, and numpy leaves a shift by 64 undefined
                    mine = digit if above == 64 else digit[(u >> np.uint64(above)) == np.uint64(prefix)]
                    counts[c, w] += np.bincount(mine.astype(np.int64), minlength=1 << (above - below))
        rows = [(c, w, digit, n[digit]) for (c, w), n in counts.items() for digit in np.flatnonzero(n)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["column", "wanted", "digit", "n"])

    return compute


def exact_column_quantiles(df: DataFrame, columns: Sequence[str], fraction: float = 0.5) -> dict[str, tuple[int, float | None]]:
    """(known values, linear-interpolated quantile) per column; NULLs do not count, a column without values has None.

    The driver sees at most 2,048 counts per column and rank in a pass.  ``df`` is read six times: write it first if it
    is costly.
    """
    if not 0 <= fraction <= 1:
        raise ValueError("fraction must lie between 0 and 1")
    columns = list(columns)
    narrow = df.select(*[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)])
    prefixes: list[list[int]] = [[0] for _ in columns]
    ranks: list[list[int]] = [[] for _ in columns]
    sizes = [0] * len(columns)
    for done in range(PASSES):
        shared = df.sparkSession.sparkContext.broadcast((done, prefixes))
        found = narrow.mapInArrow(_histograms(shared), "column long, wanted long, digit long, n long").groupBy("column", "wanted", "digit").agg(F.sum("n").alias("n"))
        counts: dict[tuple[int, int], dict[int, int]] = {}
        for r in found.collect():  # bounded, see above
            counts.setdefault((r["column"], r["wanted"]), {})[r["digit"]] = r["n"]
        if done == 0:
            for c in range(len(columns)):
                sizes[c] = sum(counts.get((c, 0), {}).values())
                place = fraction * (sizes[c] - 1)
                ranks[c] = [math.floor(place), math.ceil(place)] if sizes[c] else []
        width = 64 - BITS * done - _shift(done)
        following = []
        for c in range(len(columns)):
            chosen = []
            for w, rank in enumerate(ranks[c]):
                own = 0 if done == 0 else w  # the first pass counts one histogram for all ranks
                for digit, n in sorted(counts[c, own].items()):
                    if rank < n:
                        break
                    rank -= n
                ranks[c][w] = rank
                chosen.append((prefixes[c][own] << width) | digit)
            following.append(chosen)
        prefixes = following
        shared.unpersist()
    out = {}
    for c, name in enumerate(columns):
        if not sizes[c]:
            out[name] = 0, None
            continue
        low, high = map(unsortable, prefixes[c])
        place = fraction * (sizes[c] - 1)
        out[name] = sizes[c], low + (high - low) * (place - math.floor(place))
    return out
