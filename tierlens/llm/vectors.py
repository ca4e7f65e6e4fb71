"""Vectors as rows of integers, and blocks of rows small enough to broadcast."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LARGEST = 2 ** 31 - 1


def scaled_floor(column: pa.Array, scale: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(usable row numbers, their components as floor(scale * x)), short vectors padded with zeros to ``dims``.

    Unusable: NULL, or holding a NULL or non-finite component.  A component beyond 32 bits is an error.
    """
    offsets = column.offsets.to_numpy()
    lengths = np.where(np.array(column.is_valid()), np.diff(offsets), 0)
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # NULL components become NaN
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    x = values[np.repeat(offsets[:-1], lengths) + place]
    bad = ~np.array(column.is_valid())
    bad[row[~np.isfinite(x)]] = True
    x = np.floor(np.where(np.isfinite(x), x, 0.0) * scale)
    if (np.abs(x[~bad[row]]) > LARGEST).any():
        raise ValueError(f"a vector component times {scale} does not fit 32 bits")
    out = np.zeros((len(lengths), dims), np.int64)
    out[row, place] = np.where(bad[row], 0, x)
    usable = np.flatnonzero(~bad)
    return usable, out[usable]


def packed_rows(rows: DataFrame, scale: int, dims: int) -> DataFrame:
    """``rows`` with the array column ``v`` replaced by its scaled integers (bytes) and ``peak``, the largest of them.

    Rows with an unusable vector are left out.
    """
    kept = [c for c in rows.columns if c != "v"]
    types = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            usable, x = scaled_floor(batch.column("v"), scale, dims)
            took = batch.take(pa.array(usable))
            peak = np.abs(x).max(axis=1, initial=0)
            yield pa.RecordBatch.from_arrays(
                [*[took.column(c) for c in kept], pa.array([r.tobytes() for r in x.astype(np.int32)], pa.binary()), pa.array(peak)],
                [*kept, "v", "peak"])

    return rows.mapInArrow(pack, f"{types}, v binary, peak long" if types else "v binary, peak long")


def unpack(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """The integer rows of a packed column."""
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(-1, dims)


def numbered_blocks(table: DataFrame, number: str, rows: int) -> list[tuple[int, int]]:
    """Closed ranges of ``number`` that hold ``rows`` rows each.

    ``number`` is a written ``monotonically_increasing_id``: the writing task in the high bits, its rows counted from
    0 below.  So one count per task says where every block begins and ends.
    """
    tasks = table.groupBy(F.shiftright(number, 33).alias("task")).count().orderBy("task").collect()
    cuts, before = [], 0  # cuts: number of the first row of each block
    for task, count in tasks:
        first = -(-before // rows) * rows
        cuts += [(task << 33) + at - before for at in range(first, before + count, rows)]
        before += count
    return [(a, b - 1) for a, b in zip(cuts, [*cuts[1:], 1 << 62])]
