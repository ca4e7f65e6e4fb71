"""Vectors as short codes: per part a codebook, assigned through memoised grid cells (operator 12).

A vector is cut into equal parts and every part is replaced by the number of the nearest entry of its position's
codebook.  To find it, the part is put into a coarse grid cell.  For a cell the distances from its box to every entry
are bounded below and above; an entry whose least distance is greater than the greatest distance of another can be
nearest nowhere in the box.  What is left is remembered per cell, and only those entries are evaluated exactly.

Codebooks are refined in rounds: tasks add up the parts per entry, Spark adds up the tasks, and the driver sees one row
per entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Scratch
from .vectors import packed_rows, unpack


class CellMemo:
    """Nearest entries of one codebook, with the entries that matter remembered per grid cell.

    At most ``most`` cells are remembered; a full memo starts anew, which costs time and changes no result.
    """

    def __init__(self, book: np.ndarray, cell: int, most: int = 1 << 15):
        if cell < 1:
            raise ValueError("cell must be positive")
        self.book, self.cell, self.most = book, cell, most
        self.known: dict[bytes, np.ndarray] = {}
        self.evaluated = 0

    def _undominated(self, cells: np.ndarray) -> np.ndarray:
        """(cells, entries): whether the entry can be nearest somewhere in the cell's box."""
        low = cells[:, None, :] * self.cell
        high = low + (self.cell - 1)
        least = np.maximum(np.maximum(low - self.book, self.book - high), 0)
        most = np.maximum(np.abs(low - self.book), np.abs(high - self.book))
        least, most = (least * least).sum(axis=2), (most * most).sum(axis=2)
        return least <= most.min(axis=1, keepdims=True)

    def candidates(self, x: np.ndarray) -> np.ndarray:
        """(rows, entries): the entries to evaluate for each part."""
        cells = np.ascontiguousarray(x // self.cell)
        keys = cells.view(np.dtype((np.void, cells.dtype.itemsize * cells.shape[1]))).ravel()
        _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        names = [keys[i].tobytes() for i in first]
        if len(self.known) + len(names) > self.most:
            self.known.clear()
        new = [n for n, name in enumerate(names) if name not in self.known]
        for start in range(0, len(new), 2048):
            some = new[start:start + 2048]
            for n, mask in zip(some, self._undominated(cells[first[some]])):
                self.known[names[n]] = mask
        return np.array([self.known[n] for n in names]).reshape(len(names), len(self.book))[inverse]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) per row of integers; equal distances go to the lower entry."""
        may = self.candidates(x)
        best, entry = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int64)
        for e, center in enumerate(self.book):
            rows = np.flatnonzero(may[:, e])
            self.evaluated += len(rows)
            gap = x[rows] - center
            far = (gap * gap).sum(axis=1)
            nearer = far < best[rows]
            best[rows[nearer]], entry[rows[nearer]] = far[nearer], e
        return entry, best


class Codebooks:
    """``books``: (parts, entries, width) integers."""

    def __init__(self, books: np.ndarray, cell: int):
        self.books, self.cell = books, cell
        self.parts, self.entries, self.width = books.shape

    def memos(self) -> list[CellMemo]:
        return [CellMemo(book, self.cell) for book in self.books]

    def refined(self, sums: dict[tuple[int, int], tuple[int, list[int]]]) -> Codebooks:
        """Every entry replaced by floor(sum / count) of its parts; an entry without parts stays."""
        books = self.books.copy()
        for (part, entry), (n, total) in sums.items():
            books[part, entry] = [t // n for t in total]
        return Codebooks(books, self.cell)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def _split(batch: pa.RecordBatch, books: Codebooks) -> np.ndarray:
    """(rows, parts, width)"""
    return unpack(batch.column("v"), books.parts * books.width).astype(np.int64).reshape(-1, books.parts, books.width)


def _sums(shared):
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        memos = books.memos()
        sums = np.zeros((books.parts, books.entries, books.width), np.int64)
        counts = np.zeros((books.parts, books.entries), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _split(batch, books)
                for p, memo in enumerate(memos):
                    entry, _ = memo.nearest(x[:, p])
                    np.add.at(sums[p], entry, x[:, p])
                    counts[p] += np.bincount(entry, minlength=books.entries)
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part), pa.array(entry), pa.array(counts[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))],
            ["part", "entry", "n", "total"])

    return compute


def _codes(shared):
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        memos = books.memos()
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _split(batch, books)
            found = [memo.nearest(x[:, p]) for p, memo in enumerate(memos)]
            code = np.stack([e for e, _ in found], axis=1).astype(np.uint8)
            error = np.sum([d for _, d in found], axis=0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error)],
                ["id", "label", "code", "error"])

    return compute


def compress_vectors(
    vectors: DataFrame, id_column: str = "vec_id", embedding: str = "embedding", label: str = "label",
    parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, cell: int = 512,
) -> tuple[DataFrame, Codebooks]:
    """((id, label, code, error, label_error), codebooks): one byte per part, and the squared distance it costs.

    Components count as floor(scale * x); too large ones for squared distances of 64 bits are an error.  A vector is cut into ``parts`` of equal width; it counts
    as padded with zeros to the longest vector of the table, rounded up to whole parts.  Codebooks start as the parts of
    the rows with the ``entries`` smallest ids (equal ids by their components, NULL ids last; all rows if fewer) and take
    ``rounds`` rounds of refinement.  Rows whose vector is NULL or holds NULL or non-finite components are left out.
    Rows that repeat an id or a whole row count as often as they stand there.  ``label_error`` is the error summed over
    rows of an equal label, NULL labels being equal.  An empty table gives an empty result and books without entries.
    Further columns are not read, whatever their names.
    """
    if parts < 1 or not 1 <= entries <= 256 or rounds < 0:
        raise ValueError("parts must be positive, entries 1 to 256 and rounds not negative")
    spark = vectors.sparkSession
    scratch = Scratch(spark, "codes")
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(label).alias("label"), F.col(embedding).alias("v"))
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 0
    width = max(1, -(-dims // parts))
    ready = scratch.keep(packed_rows(rows, scale, parts * width))
    peak = ready.agg(F.max("peak")).first()[0] or 0
    if parts * width * (2 * peak) ** 2 >= 2 ** 62:
        raise ValueError(f"vector components times {scale} are too large for squared distances of 64 bits")
    first = ready.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").toArrow()
    start = unpack(first.column("v"), parts * width).astype(np.int64).reshape(-1, parts, width)
    books = Codebooks(start.transpose(1, 0, 2), cell)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)
        added = ready.select("v").mapInArrow(_sums(shared), "part long, entry long, n long, total array<long>")
        totals = F.array(*[F.sum(F.col("total")[j]) for j in range(width)])
        # one row per part and entry
        sums = {(r.part, r.entry): (r.n, r.total) for r in added.groupBy("part", "entry").agg(F.sum("n").alias("n"), totals.alias("total")).collect()}
        books = books.refined(sums)
        shared.unpersist()
    shared = spark.sparkContext.broadcast(books)
    label_type = rows.schema["label"].dataType.simpleString()
    coded = scratch.keep(ready.mapInArrow(_codes(shared), f"id long, label {label_type}, code binary, error long"))
    per_label = scratch.keep(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")))
    out = coded.join(per_label, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
    scratch.drop_but(coded, per_label)
    return out, books
