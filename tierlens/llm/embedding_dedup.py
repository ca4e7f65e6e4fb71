"""Embedding near-duplicates through spherical-cap filters (operator 8).

Filter directions are structured random product codes: after a random rotation the vector is cut into two halves, and
a direction is a pair of random unit codewords, one per half.  The scores of all codewords^2 directions are sums of
two short score lists, so a vector is list-decoded to its ``best`` highest directions (the caps it lies deepest in)
from the top of each list, without visiting the others.  Several rotations make independent codes.  Vectors with the
same label that share a filter meet in that filter's bucket and are verified there in double precision.

A pair that shares several filters is counted in the first of them only, so buckets return link counts per vector
and a spanning forest, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitslice import group_ends, spanning_roots
from .grouping import components, sorted_runs, tile_units
from .tables import Scratch

_PAIRS_AT_ONCE = 1 << 16


class ProductCode:
    """Rotations and codewords, drawn from a seed."""

    def __init__(self, dims: int, codewords: int = 512, rotations: int = 3, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.half = (dims + 1) // 2
        self.turns = [np.linalg.qr(rng.normal(size=(2 * self.half, 2 * self.half)))[0] for _ in range(rotations)]
        books = rng.normal(size=(rotations, 2, codewords, self.half))
        self.books = books / np.linalg.norm(books, axis=3, keepdims=True)
        self.codewords = codewords

    def decode(self, vectors: np.ndarray, best: int) -> np.ndarray:
        """(n, rotations x best) filter numbers of the highest directions, for unit vectors."""
        wide = np.zeros((len(vectors), 2 * self.half))
        wide[:, :vectors.shape[1]] = vectors
        best = min(best, self.codewords)
        out = []
        for r, (turn, book) in enumerate(zip(self.turns, self.books)):
            turned = wide @ turn
            left, right = turned[:, :self.half] @ book[0].T, turned[:, self.half:] @ book[1].T
            # the ``best`` highest sums use only the ``best`` highest scores of either half
            a, b = (np.argsort(-s, axis=1, kind="stable")[:, :best] for s in (left, right))
            sums = np.take_along_axis(left, a, 1)[:, :, None] + np.take_along_axis(right, b, 1)[:, None, :]
            top = np.argsort(-sums.reshape(len(vectors), -1), axis=1, kind="stable")[:, :best]
            code = np.take_along_axis(a, top // best, 1) * self.codewords + np.take_along_axis(b, top % best, 1)
            out.append(code + r * self.codewords ** 2)
        return np.concatenate(out, axis=1) if out else np.zeros((len(vectors), 0), np.int64)


def usable_rows(column: pa.Array, kind) -> tuple[np.ndarray, list[bytes]]:
    """Rows of a list column that are usable as directions, and their components as bytes.

    Unusable: NULL, holding a NULL or non-finite component, or zero.
    """
    usable, stored = [], []
    for i, v in enumerate(column.to_pylist()):
        if v is None or any(x is None for x in v):
            continue
        a = np.array(v, kind)
        if np.isfinite(a).all() and a.any():
            usable.append(i)
            stored.append(a.tobytes())
    return np.array(usable, np.int64), stored


def unit_matrix(stored: list[bytes], kind) -> np.ndarray:
    """Unit vectors in double precision of stored components, the shorter ones padded with zeros."""
    rows = [np.frombuffer(v, kind).astype(np.float64) for v in stored]
    out = np.zeros((len(rows), max(map(len, rows), default=1)))
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    out /= np.abs(out).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def filters(vectors: DataFrame, code: ProductCode, best: int, kind) -> DataFrame:
    """(node, label, v, caps) of (node, label, v): components as bytes of type ``kind`` with the sorted filter numbers.

    Unusable rows are left out.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(code)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            usable, stored = usable_rows(batch.column(2), kind)
            unit = unit_matrix(stored, kind)
            caps = np.sort(shared.value.decode(unit, best), axis=1) if len(stored) else np.zeros((0, 0), np.int64)
            took = batch.take(pa.array(usable))
            yield pa.RecordBatch.from_arrays(
                [took.column(0), took.column(1), pa.array(stored, pa.binary()), pa.array(list(caps), pa.list_(pa.int64()))],
                ["node", "label", "v", "caps"])

    return vectors.mapInArrow(decode, f"node long, label {vectors.schema['label'].dataType.simpleString()}, v binary, caps array<long>")


def _bucket_pairs(end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i, j) with i < j < end[i], in blocks."""
    n = end - np.arange(len(end)) - 1
    upto = np.cumsum(n)
    start = 0
    while start < len(n):
        stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + _PAIRS_AT_ONCE)))
        i = np.repeat(np.arange(start, stop), n[start:stop])
        if len(i):
            first = np.cumsum(n[start:stop]) - n[start:stop]
            yield i, i + 1 + np.arange(len(i)) - np.repeat(first, n[start:stop])
        start = stop


def _verify(threshold: float, kind):
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in sorted_runs(batches, rows=1 << 13):
            node, tile, own = (run.column(c).to_numpy(zero_copy_only=False) for c in ("node", "tile", "own"))
            cap, v = run.column("cap").to_numpy(), unit_matrix(run.column("v").to_pylist(), kind)
            caps = np.array(run.column("caps").to_pylist())
            size = run.column("size").to_numpy()
            links = np.zeros(len(node), np.int64)
            hits = []
            for i, j in _bucket_pairs(group_ends(run.column("unit").to_numpy())):
                meet = (own[i] | (tile[i] != tile[j])) & (cap[i] == cap[j])
                i, j = i[meet], j[meet]
                close = np.einsum("ij,ij->i", v[i], v[j]) >= threshold
                i, j = i[close], j[close]
                first = np.zeros(len(i), bool)
                for s in range(0, len(i), 4096):  # the pair belongs to its first common filter
                    a, b = caps[i[s:s + 4096]], caps[j[s:s + 4096]]
                    both = (a[:, :, None] == b[:, None, :]).any(axis=2)
                    first[s:s + 4096] = a[np.arange(len(a)), both.argmax(axis=1)] == cap[i[s:s + 4096]]
                i, j = i[first], j[first]
                np.add.at(links, i, size[j])
                np.add.at(links, j, size[i])
                hits.append((i, j))
            root = spanning_roots(len(node), hits)
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[root[some]]), pa.array(links[some])], ["node", "root", "n"])

    return compute


def embedding_links(
    vectors: DataFrame, id_column: str = "vec_id", embedding: str = "embedding", label: str = "label",
    threshold: float = 0.93, codewords: int = 512, best: int = 8, rotations: int = 3, seed: int = 42, tile_rows: int = 256,
) -> DataFrame:
    """(id, n_links, component, kept) for every row.

    Rows link if their labels are equal and not NULL and their cosine is at least ``threshold``.  Vectors that are
    NULL, zero or hold NULL or non-finite components have no links.  Rows of equal label and vector are compared as one,
    with their number, and every row is counted by itself: rows that repeat an id, and rows without one, link and count
    like any other.  ``component`` is the smallest id reachable (NULL if no row of the group has an id), a row alone has
    its own; ``kept`` says whether it is the row's id, or the row stands alone.  Every link reported is verified; a link
    is missed only if the two vectors share none of their ``best`` x ``rotations`` filters (recall is measured in the
    tests).  An empty table gives an empty result; further columns are not read, whatever their names.
    """
    scratch = Scratch(vectors.sparkSession, "caps")
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(label).alias("label"), F.col(embedding).alias("v"))
    dims = rows.agg(F.max(F.size("v"))).first()[0]
    code = ProductCode(max(2, dims or 2), codewords, rotations, seed)
    kind = np.float32 if rows.schema["v"].dataType.elementType.typeName() == "float" else np.float64
    known = rows.where(F.col("label").isNotNull() & F.col("v").isNotNull())
    # the number is written with the row, so it stays
    nodes = scratch.keep(known.groupBy("label", "v").agg(F.count("*").alias("size"), F.min("id").alias("least")).withColumn(
        "node", F.monotonically_increasing_id()))
    ready = scratch.keep(filters(nodes.select("node", "label", "v"), code, best, kind))
    entries = ready.select(F.col("node").alias("member"), "label", F.explode("caps").alias("cap")).withColumn("bucket", F.xxhash64("label", "cap")).drop("label")
    # buckets are found on numbers alone; only what shares a bucket gets its vector
    units = scratch.keep(tile_units(entries, scratch, "member", tile_rows))
    sized = ready.join(nodes.select("node", "size"), "node")
    met = units.join(sized.select(F.col("node").alias("member"), "node", "size", "v", "caps"), "member").drop("member")
    found = scratch.keep(met.repartition("unit").sortWithinPartitions("unit").mapInArrow(_verify(threshold, kind), "node long, root long, n long"))
    counts = found.groupBy("node").agg(F.sum("n").alias("others"))
    roots = components(found.where("node <> root").select("node", "root"), scratch)
    # usable vectors only: the copies of an unusable one do not link
    grouped = scratch.keep(ready.select("node").join(nodes.select("node", "size", "least"), "node").join(counts, "node", "left").join(
        roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    least = scratch.keep(grouped.groupBy("root").agg(F.min("least").alias("component"), F.sum("size").alias("rows")))
    told = grouped.join(least, "root").select("node", (F.coalesce("others", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component", "rows")
    named = scratch.keep(nodes.select("node", F.col("label").alias("_label"), F.col("v").alias("_v")).join(told, "node").drop("node"))
    scratch.drop_but(named)
    out = rows.join(named, (F.col("label") == F.col("_label")) & (F.col("v") == F.col("_v")), "left")
    alone = F.coalesce(F.col("rows") == 1, F.lit(True))
    component = F.when(alone, F.col("id")).otherwise(F.col("component"))
    return out.select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component"),
                      F.when(alone, True).otherwise(F.coalesce(F.col("id") == F.col("component"), F.lit(False))).alias("kept"))
