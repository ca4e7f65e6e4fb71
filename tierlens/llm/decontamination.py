"""Benchmark decontamination by Wu-Manber multi-pattern search over words (operator 7).

Patterns are the windows of ``window`` consecutive words of the benchmark items (a shorter item is one window).  A
shift table over blocks of up to three words says how far the search may jump: a block that ends no early part of any
pattern lets it skip the whole pattern length.  At shift 0 the block is a pattern's last block, whose bucket lists
the patterns to compare directly.  Patterns of one length form one search.

The test strings are cut into blocks of bounded size; each block is broadcast on its own and the documents pass
through one block after the other, so no broadcast grows with the benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Scratch

# bytes outside [0-9A-Za-z] and below 0x80 separate words, A-Z are lower-cased
_FOLD = bytes((b | 0x20) if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 0x20 for b in range(256))
_BLOCK = 3
_SEGMENT = 1000


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


class Search:
    """Wu-Manber tables for patterns of one length."""

    def __init__(self, length: int, patterns: dict[tuple, set[int]]):
        self.length, self.block = length, min(_BLOCK, length)
        self.skip = length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, list[tuple]] = {}
        self.items = patterns
        for p in patterns:
            for end in range(self.block, length + 1):
                block, left = p[end - self.block:end], length - end
                if self.shift.get(block, self.skip) > left:
                    self.shift[block] = left
            self.buckets.setdefault(p[-self.block:], []).append(p)

    def find(self, words: list[bytes]) -> Iterator[tuple[int, tuple]]:
        """(start, pattern) of every occurrence."""
        at, length, block = self.length, self.length, self.block
        shift, skip = self.shift.get, self.skip
        while at <= len(words):
            key = tuple(words[at - block:at])
            jump = shift(key, skip)
            if jump:
                at += jump
                continue
            start = at - length
            here = tuple(words[start:at])
            for pattern in self.buckets[key]:
                if pattern == here:
                    yield start, pattern
                    break
            at += 1


def searches(segments: list[tuple], window: int) -> list[Search]:
    """One search per pattern length, from (item, words) segments."""
    by_length: dict[int, dict[tuple, set]] = {}
    for item, text in segments:
        words = tuple(text.split())
        length = min(window, len(words))
        found = by_length.setdefault(length, {})
        for i in range(len(words) - length + 1):
            found.setdefault(words[i:i + length], set()).add(item)
    return [Search(length, patterns) for length, patterns in by_length.items() if length]


def item_segments(benchmark: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """(item, words, n): folded item texts, long ones in overlapping segments that keep every window whole."""
    rows = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).cast("binary").alias("text"))

    def cut(batches):
        for batch in batches:
            out = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(text.as_py())
                for s in range(0, max(1, len(words) - window + 1), _SEGMENT):
                    part = words[s:s + _SEGMENT + window - 1]
                    if part:
                        out.append((item, b" ".join(part), len(part)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.binary()), pa.array([r[2] for r in out], pa.int64())],
                ["item", "words", "n"])

    return rows.mapInArrow(cut, "item string, words binary, n long")


_BUILT: dict[str, list[Search]] = {}


def _tables(name: str, shared, window: int) -> list[Search]:
    """The searches of one broadcast block, built once per Python worker; a worker keeps the last block only."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = searches(shared.value, window)
    return _BUILT[name]


def _scan(name, shared, window):
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(name, shared, window)
        for batch in batches:
            n_words, n_hit, marks, items = [], [], [], []
            before_marks, before_items = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for text, mark, seen in zip(batch.column(1), before_marks, before_items):
                words = words_of(text.as_py())
                hit, found = None, set(seen or ())
                for search in tables:
                    for start, pattern in search.find(words):
                        hit = bytearray(mark or bytes(len(words))) if hit is None else hit
                        hit[start:start + search.length] = b"\x01" * search.length
                        found |= search.items[pattern]
                marks.append(bytes(hit) if hit is not None else mark)
                items.append(sorted(x for x in found if x is not None))
                n_words.append(len(words))
                n_hit.append((marks[-1] or b"").count(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(marks, pa.binary()), pa.array(items, pa.list_(pa.string())),
                 pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64())],
                ["row", "text", "marks", "items", "n_words", "n_hit"])

    return compute


def _scanned(rows: DataFrame, benchmark: DataFrame, item_id, item_text, window, words_per_block) -> DataFrame:
    """``rows`` (row, text) through every block of test strings."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "decontaminate")
    # a repeated item is one segment: copies share a hash, so they would all fall into one block
    segments = scratch.keep(item_segments(benchmark, item_id, item_text, window).distinct())
    blocks = max(1, -(-(segments.agg(F.sum("n")).first()[0] or 0) // words_per_block))
    numbered = segments.withColumn("_block", F.pmod(F.xxhash64("item", "words"), F.lit(blocks)))
    state = rows.select("row", "text", F.lit(None).cast("binary").alias("marks"), F.lit(None).cast("array<string>").alias("items"))
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in state.schema)
    for b in range(blocks):
        part = [(r["item"], bytes(r["words"])) for r in numbered.where(F.col("_block") == b).select("item", "words").collect()]
        name, shared = f"{scratch.path}/{b}", spark.sparkContext.broadcast(part)
        state = state.mapInArrow(_scan(name, shared, window), f"{shape}, n_words long, n_hit long")
        if b + 1 < blocks:
            state = scratch.keep(state.drop("n_words", "n_hit"))
    return state


def scan_documents(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = 10, words_per_block: int = 200_000,
) -> DataFrame:
    """(id, n_words, n_hit, items) per row; items are the sorted ids, as text, of items with an occurring window.

    NULL texts have no words; items without words never match; a NULL item id marks words but is not listed.  Rows
    and items may repeat; empty tables give empty results or no hits.  Only the named columns are read.
    """
    rows = docs.select(F.col(id_column).alias("row"), F.col(text).cast("binary").alias("text"))
    found = _scanned(rows, benchmark, item_id, item_text, window, words_per_block)
    return found.select(F.col("row").alias("id"), "n_words", "n_hit", "items")


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = 10, words_per_block: int = 200_000,
) -> DataFrame:
    """The rows of ``docs``, all columns, in which no benchmark window occurs."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text] or [F.lit(0).alias("_")]
    rows = docs.select(F.struct(*others).alias("row"), F.col(text).cast("binary").alias("text"))
    clean = _scanned(rows, benchmark, item_id, item_text, window, words_per_block).where("n_hit = 0")
    return clean.select(*[
        F.col("text").cast(docs.schema[c].dataType).alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
