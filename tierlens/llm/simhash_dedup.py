"""SimHash near-duplicates by bit-sliced comparison (operator 6).

Fingerprints within ``radius`` bits must agree on some ``keep`` of ``keep + radius`` bit blocks, so documents meet in
the buckets of those block choices and nowhere else.  With radius 2 a bucket agrees on about 43 of 64 bits.  Inside a
bucket the fingerprints are compared through vertical bit planes (see ``bitslice``).  Only a spanning forest of each
bucket leaves the task: pairs are counted, never emitted.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitslice import close_pairs, group_ends, spanning_roots
from .grouping import components, sorted_runs, tile_units
from .shingles import MIX, shingle_hashes, simhash, utf8_values
from .tables import Scratch


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): the 64-bit SimHash of each row's whole text as a signed long; 0 for NULL, empty or blank texts."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [simhash(shingle_hashes(t, shingle))[0] for t in utf8_values(batch.column(1))]
            fp = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), fp], ["id", "fp"])

    return rows.mapInArrow(compute, f"id {id_type}, fp long")


def block_masks(radius: int, keep: int = 4) -> list[int]:
    """Signed 64-bit masks, one for each choice of ``keep`` of ``keep + radius`` nearly equal bit blocks."""
    cuts = [round(i * 64 / (keep + radius)) for i in range(keep + radius + 1)]
    blocks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(cuts, cuts[1:])]
    masks = [sum(choice) for choice in itertools.combinations(blocks, keep)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _forest(radius: int):
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in sorted_runs(batches):
            unit, fp = run.column("unit").to_numpy(), run.column("fp").to_numpy()
            words = np.ascontiguousarray(fp).view(np.uint64).reshape(-1, 1)
            root = spanning_roots(len(fp), close_pairs(words, group_ends(unit), radius))
            child = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([pa.array(fp[child]), pa.array(fp[root[child]])], ["a", "b"])

    return compute


def linked_fingerprints(prints: DataFrame, scratch: Scratch, radius: int = 2, tile_rows: int = 512) -> DataFrame:
    """(node, root) for the distinct fingerprints ``fp`` that have a link; root is the smallest of the component."""
    masks = F.array(*[F.lit(m) for m in block_masks(radius)])
    entries = prints.select("fp", F.posexplode(masks).alias("_k", "_mask")).select(
        "fp", F.xxhash64("_k", F.col("fp").bitwiseAND(F.col("_mask"))).alias("bucket"))
    units = tile_units(entries, scratch, "fp", tile_rows).select("unit", "fp")
    edges = units.repartition("unit").sortWithinPartitions("unit").mapInArrow(_forest(radius), "a long, b long")
    return components(edges, scratch)


def simhash_components(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2, tile_rows: int = 512,
) -> DataFrame:
    """(id, fp, component): one row per input row, ``component`` the smallest id that links reach.

    NULL, empty and blank texts have fingerprint 0 and link like any other.  Repeated rows appear as often as given.
    A NULL id never is a component's name unless all its ids are NULL.  An empty table gives an empty result.  Only
    the two named columns are read, so other columns may have any name.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    marks = scratch.keep(fingerprints(docs, id_column, text, shingle))
    prints = scratch.keep(marks.groupBy("fp").agg(F.min("id").alias("first_id")))
    linked = scratch.keep(linked_fingerprints(prints, scratch, radius, tile_rows))
    in_component = prints.join(linked, prints["fp"] == linked["node"]).select("fp", "root", "first_id")
    smallest = scratch.keep(in_component.groupBy("root").agg(F.min("first_id").alias("component")))
    named = scratch.keep(linked.join(smallest, "root").select(F.col("node").alias("fp"), "component"))
    prints = scratch.keep(prints.join(named, "fp", "left").select("fp", F.coalesce("component", "first_id").alias("component")))
    scratch.drop_but(marks, prints)
    return marks.join(prints, "fp").select("id", "fp", "component")


# ---- near duplicates by similarity -------------------------------------------
#
# A word-shingle similarity of 0.8 moves about 15 % of the fingerprint bits, far too many for exact block buckets.
# Here documents meet in buckets of minimal shingle hashes, wide fingerprints are compared bit-sliced with a generous
# radius, and the exact similarity of the shingle sets decides inside each group of close fingerprints.

FP_WORDS = 4
BAND_ROWS = 4


def _sketch(shingle: int, bands: int):
    rng = np.random.default_rng(7)
    factors = rng.integers(1, 1 << 63, bands * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, keys = [], []
            for t in utf8_values(batch.column(1)):
                hashes = np.unique(shingle_hashes(t, shingle))  # the similarity is one of sets, so are the fingerprints
                prints.append(simhash(hashes, FP_WORDS).tobytes())
                spread = hashes ^ (hashes >> np.uint64(29))
                lows = np.array([(spread * f).min(initial=np.uint64(0xFFFFFFFFFFFFFFFF)) for f in factors], np.uint64)
                band = np.arange(1, bands + 1, dtype=np.uint64)
                for low in lows.reshape(bands, BAND_ROWS).T:
                    band = (band ^ low) * MIX
                    band ^= band >> np.uint64(29)
                keys.append(band.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["key", "fp", "buckets"])

    return compute


def _words_matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, FP_WORDS)


def _wide_forest(radius: int):
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in sorted_runs(batches):
            node = run.column("node").to_numpy()
            pairs = close_pairs(_words_matrix(run.column("fp")), group_ends(run.column("unit").to_numpy()), radius)
            root = spanning_roots(len(node), pairs)
            child = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([pa.array(node[child]), pa.array(node[root[child]])], ["a", "b"])

    return compute


def _verified_forest(radius: int, shingle: int, similarity: float):
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in sorted_runs(batches, rows=1 << 10):
            node, texts, sets = run.column("node").to_numpy(), run.column("text"), {}

            def shingles(i):
                if i not in sets:
                    sets[i] = np.unique(shingle_hashes((texts[i].as_py() or "").encode(), shingle))
                return sets[i]

            def similar(i, j):
                a, b = shingles(i), shingles(j)
                shared = len(np.intersect1d(a, b, assume_unique=True))
                return shared >= similarity * (len(a) + len(b) - shared)

            pairs = close_pairs(_words_matrix(run.column("fp")), group_ends(run.column("unit").to_numpy()), radius)
            root = spanning_roots(len(node), pairs, similar)
            child = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([pa.array(node[child]), pa.array(node[root[child]])], ["a", "b"])

    return compute


def drop_near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8,
    bands: int = 10, radius: int = 72, tile_rows: int = 256,
) -> DataFrame:
    """One row of every group of near duplicates, all columns: the one with the smallest id.

    Two texts are near duplicates if the sets of their ``shingle``-word runs have a Jaccard similarity of at least
    ``similarity``; groups are what such links connect.  Texts without words are equal to each other and to nothing
    else; NULL is one more text.  Repeated rows leave one.  ``radius`` bits of 256 are three standard deviations
    above the distance expected at similarity 0.8 of any sets: 48 + 3 x 6 for four shingles against five, 37 + 3 x 6
    for long texts.  Ten bands of four hashes miss one such pair in 200.
    Copies of a text are one node, known by a 64-bit hash.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    own = F.col(text).cast("string")
    given = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_column).alias("id"), own.alias("text"),
        F.xxhash64(own).alias("node"), F.xxhash64(id_column, own).alias("key"))
    # one line per distinct text, known by its node and by the key of one row that has it
    texts = scratch.keep(given.groupBy("node").agg(F.min(F.struct("id", "key")).alias("first")).select("node", "first.id", "first.key"))
    sketch_of = given.select("key", "text").mapInArrow(_sketch(shingle, bands), "key long, fp binary, buckets array<long>")
    sketched = scratch.keep(sketch_of)
    single = texts.join(sketched.groupBy("key").agg(F.first("fp").alias("fp"), F.first("buckets").alias("buckets")), "key")
    single = scratch.keep(single.select("node", "key", "fp", "buckets"))
    entries = single.select("node", "fp", F.explode("buckets").alias("bucket"))
    units = tile_units(entries, scratch, "node", tile_rows).select("unit", "node", "fp")
    close = components(units.repartition("unit").sortWithinPartitions("unit").mapInArrow(_wide_forest(radius), "a long, b long"), scratch)
    members = scratch.keep(single.join(close, "node").select("key", "node", "fp", F.col("root").alias("bucket")))
    with_text = given.select("key", "text").join(members, "key").dropDuplicates(["key"])
    checked = tile_units(scratch.keep(with_text), scratch, "node", tile_rows).select("unit", "node", "fp", "text")
    linked = scratch.keep(components(checked.repartition("unit").sortWithinPartitions("unit").mapInArrow(
        _verified_forest(radius, shingle, similarity), "a long, b long"), scratch))
    keepers = scratch.keep(
        texts.join(linked, "node", "left").groupBy(F.coalesce("root", "node").alias("group"))
        .agg(F.min(F.struct("id", "key")).alias("first")).select(F.col("first.key").alias("key")))
    scratch.drop_but(keepers)
    return given.select("row", "key").join(keepers, "key", "left_semi").dropDuplicates(["key"]).select("row.*")
