"""Exact top-k search by inner product with a three-phase uniform threshold (operator 13).

A score is the sum of ``lists`` partial scores, one per run of components.  Every slice of the table keeps a score list
per query and run:

1. gather: from each list its k highest entries, with their whole scores; the k-th best score found anywhere is a cutoff
   that the true k-th best score cannot fall below;
2. cut off: the cutoffs are broadcast.  A score that reaches the cutoff has at least one partial score that reaches the
   cutoff divided by the number of lists (the uniform threshold), so entries below it in every list are dropped;
3. resolve: the scores of the entries left are summed up exactly, and what reaches the cutoff competes for the ranks.

Queries are broadcast in blocks of bounded size; each block reads the packed table twice and moves only short lists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import Scratch
from .vectors import numbered_blocks, packed_rows, unpack

_TILE = 256  # queries scored at once
_NONE = -2 ** 62  # below every score


class Queries:
    """A block of queries: their row numbers, ids and integer components."""

    def __init__(self, table: pa.Table, dims: int, lists: int, kind):
        self.member = table.column("member").to_numpy()
        self.id = table.column("id").to_numpy()
        self.runs = np.array_split(np.arange(dims), min(lists, dims))
        self.x = unpack(table.column("v"), dims).astype(kind)

    def partial_scores(self, start: int, stop: int, member: np.ndarray, v: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """One matrix (queries, rows) per list, and where a row is the query itself."""
        x = self.x[start:stop]
        parts = [x[:, r] @ v[:, r].T for r in self.runs]
        return parts, self.member[start:stop, None] == member[None, :]


def _tiles(queries: Queries) -> Iterator[tuple[int, int]]:
    for start in range(0, len(queries.member), _TILE):
        yield start, min(start + _TILE, len(queries.member))


def _highest(scores: np.ndarray, k: int) -> np.ndarray:
    """The k highest of each row, in any order."""
    return scores if scores.shape[1] <= k else -np.partition(-scores, k - 1, axis=1)[:, :k]


def _gather(shared, dims: int, k: int, kind):
    """Phase 1: (query, score) of each list's k highest entries, the k best per query and slice."""
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        best = np.full((len(queries.member), k), _NONE)
        for batch in batches:
            if not batch.num_rows:
                continue
            member, v = batch.column("member").to_numpy(), unpack(batch.column("v"), dims).astype(kind)
            for start, stop in _tiles(queries):
                parts, own = queries.partial_scores(start, stop, member, v)
                listed = np.zeros(own.shape, bool)  # an entry on several lists counts once
                for p in parts:
                    p = np.where(own, -np.inf, p)
                    if p.shape[1] > k:
                        np.put_along_axis(listed, np.argpartition(-p, k - 1, axis=1)[:, :k], True, axis=1)
                    else:
                        listed[:] = True
                whole = np.where(listed & ~own, sum(parts).astype(np.int64), _NONE)
                best[start:stop] = _highest(np.concatenate([best[start:stop], _highest(whole, k)], axis=1), k)
        at, _ = np.nonzero(best != _NONE)
        yield pa.RecordBatch.from_arrays([pa.array(queries.member[at]), pa.array(best[best != _NONE])], ["query", "score"])

    return compute


def _first_k(q: np.ndarray, score: np.ndarray, no_id: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among the k best of their query: higher score first, then smaller id, a missing id last."""
    order = np.lexsort((ids, no_id, -score, q))
    ordered = q[order]
    place = np.arange(len(q)) - np.searchsorted(ordered, ordered)
    return order[place < k]


def _resolve(shared, cutoffs, dims: int, k: int, kind):
    """Phases 2 and 3: entries that reach the uniform threshold in some list, resolved; the k best per query and slice."""
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, cutoff = shared.value, cutoffs.value
        # partial scores are whole numbers, and every type here holds them exactly
        least = np.ceil(cutoff / len(queries.runs)).astype(kind) if kind != np.int64 else -(-cutoff // len(queries.runs))
        empty = np.zeros(0, np.int64)
        q, score, no_id, ids = empty, empty, np.zeros(0, bool), empty
        for batch in batches:
            if not batch.num_rows:
                continue
            member, v = batch.column("member").to_numpy(), unpack(batch.column("v"), dims).astype(kind)
            missing = np.array(batch.column("id").is_null())
            row_id = batch.column("id").fill_null(0).to_numpy()
            for start, stop in _tiles(queries):
                parts, own = queries.partial_scores(start, stop, member, v)
                low = least[start:stop, None]
                enough = np.zeros(own.shape, bool)
                for p in parts:
                    enough |= p >= low
                i, j = np.nonzero(enough & ~own)
                s = sum(p[i, j] for p in parts).astype(np.int64)
                take = s >= cutoff[start + i]
                i, j, s = i[take] + start, j[take], s[take]
                q, score = np.concatenate([q, i]), np.concatenate([score, s])
                no_id, ids = np.concatenate([no_id, missing[j]]), np.concatenate([ids, row_id[j]])
            top = _first_k(q, score, no_id, ids, k)
            q, score, no_id, ids = q[top], score[top], no_id[top], ids[top]
        yield pa.RecordBatch.from_arrays(
            [pa.array(queries.member[q]), pa.array(queries.id[q]), pa.array(ids, mask=no_id), pa.array(score)],
            ["query", "query_id", "id", "score"])

    return compute


def _exact_kind(dims: int, peak: int):
    """The narrowest number type in which every sum of products is exact."""
    bound = dims * peak * peak
    if bound >= 2 ** 62:
        raise ValueError("inner products may not fit 64 bits")
    return np.float32 if bound < 2 ** 24 else np.float64 if bound < 2 ** 53 else np.int64


def top_k_search(
    vectors: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", embedding: str = "embedding",
    scale: int = 256, lists: int = 2, block: int = 16_384, slice_rows: int = 1 << 18,
) -> DataFrame:
    """(query_id, rank, id, score): for each row where ``is_query`` holds, the k other rows of the highest inner product.

    Components count as floor(scale * x).  Equal scores are ordered by id, a NULL id last.  Rows whose vector is NULL or
    holds NULL or non-finite components take no part; vectors of different lengths meet as if padded with zeros.  Rows
    that repeat an id or a whole row are rows of their own: each is a query, and a candidate for its copies.  With k
    candidates or fewer all are returned; without queries, or on an empty table, the result is empty.  A NULL
    ``is_query`` is no query.  Further columns are not read, whatever their names.
    """
    if k < 1 or lists < 1:
        raise ValueError("k and lists must be positive")
    spark = vectors.sparkSession
    scratch = Scratch(spark, "top-k")
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.col(embedding).alias("v"))
    count, dims = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    dims = max(1, dims or 1)
    slices = max(spark.sparkContext.defaultParallelism, -(-count // slice_rows))
    ready = scratch.keep(packed_rows(rows, scale, dims).repartition(slices).withColumn("member", F.monotonically_increasing_id()))
    kind = _exact_kind(dims, ready.agg(F.max("peak")).first()[0] or 0)
    queries = scratch.keep(ready.where("asks").select("id", "member", "v").withColumn("number", F.monotonically_increasing_id()))
    candidates = ready.select("id", "member", "v")
    found = f"{scratch.path}/found"
    schema = "query long, query_id long, id long, score long"
    spark.createDataFrame([], schema).write.parquet(found)
    best_first = W.partitionBy("query").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    for first, last in numbered_blocks(queries, "number", block):
        table = queries.where(F.col("number").between(first, last)).toArrow()  # at most ``block`` rows
        shared = spark.sparkContext.broadcast(Queries(table, dims, lists, kind))
        gathered = candidates.mapInArrow(_gather(shared, dims, k, kind), "query long, score long")
        placed = gathered.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy(F.col("score").desc())))
        known = placed.where(F.col("place") <= k).groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("score"))
        # with fewer than k candidates nothing may be cut off; at most ``block`` rows
        low = {r.query: r.score for r in known.where(F.col("n") == k).collect()}
        cutoff = np.array([low.get(m, _NONE) for m in shared.value.member.tolist()], np.int64)
        cutoffs = spark.sparkContext.broadcast(cutoff)
        kept = candidates.mapInArrow(_resolve(shared, cutoffs, dims, k, kind), schema)
        kept.write.mode("append").parquet(found)
        shared.unpersist()
        cutoffs.unpersist()
    entries = spark.read.schema(schema).parquet(found)
    return entries.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
