"""Substring dedup by sliding sentence spans (operator 4).

Every document is cut into sentences, long ones into pieces that end at certain words or after a bounded number.  A span is a run of at
least ``sentences`` consecutive sentences with at least ``words`` words: the shortest one from every sentence on, and
the shortest one up to every sentence.  Spans are joined globally by hash.  Of a repeated span the first occurrence
stays, by smallest id and position; every sentence that another occurrence covers is removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .tables import Scratch

# a sentence ends with one of . ! ? (not a run of them) before white space, or at a line end
_CUT = re.compile(r"(?<![.!?])[.!?]\s+|\n\s*")
_WORD = re.compile(r"\S+\s*")
_CUT_WORDS = 6  # in a long sentence one word in so many ends a piece


_MOST_WORDS = 1 << 17  # remembered per task; a full memory starts anew
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_BACK = pow(_BASE, -1, 1 << 64)


class _Cuts(dict):
    """Whether a word (as it stands, with what white space follows) ends a piece of a long sentence."""

    def __missing__(self, word: str) -> bool:
        if len(self) >= _MOST_WORDS:
            self.clear()
        cut = self[word] = crc32(word.rstrip().encode("utf-8", "surrogatepass")) % _CUT_WORDS == 0
        return cut


class _Hashes(dict):
    """Hash of a lower-cased word."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _MOST_WORDS:
            self.clear()
        h = self[word] = xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42)
        return h


_cuts, _hashes = _Cuts(), _Hashes()


def sentences_of(text: str, longest: int = 16) -> list[tuple[int, int, int]]:
    """(start, end, words): pieces that together are the whole text, separators included."""
    out, start = [], 0
    for end in [*(m.end() for m in _CUT.finditer(text)), len(text)]:
        if end <= start:
            continue
        words = _WORD.findall(text, start, end)
        if len(words) <= longest:
            out.append((start, end, len(words)))
        else:
            # white space before the first word, if any, belongs to the first piece
            at, stop, n = start, end - sum(map(len, words)), 0
            for word in words:
                n += 1
                stop += len(word)
                # the word decides, so copies that begin at different words are cut alike from the next such word on
                if n == longest or stop == end or _cuts[word]:
                    out.append((at, stop, n))
                    at, n = stop, 0
        start = end
    return out


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least the first n powers of the base and of its inverse modulo 2^64; remembered, and doubled when needed."""
    while len(_known_powers[0]) < n:
        for k, table in enumerate(_known_powers):
            # table[m + i] = table[m] * table[i]
            _known_powers[k] = np.concatenate([table, table * (table[-1:] * table[1:2])])
    return _known_powers[0], _known_powers[1]


_known_powers = [np.array([1, _BASE], np.uint64), np.array([1, _BACK], np.uint64)]


def span_arrays(text: str, parts: list[tuple[int, int, int]], least: int = 3, words: int = 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, last) of the spans of a text cut into ``parts``: signed 64-bit hash of a span's words, and its sentences.

    Words are summed up with powers of a base by their place; a span's hash is a difference of two sums, moved to
    place 0, so no span is hashed word by word.
    """
    n = len(parts)
    upto = np.zeros(n + 1, np.int64)
    np.cumsum(np.fromiter((k for *_, k in parts), np.int64, n), out=upto[1:])
    sentence = np.arange(n + 1)
    # shortest run from each sentence on, and shortest run up to each sentence (ends exclusive)
    end = np.maximum(sentence + least, np.searchsorted(upto, upto + words))
    start = np.minimum(sentence - least, np.searchsorted(upto, upto - words, side="right") - 1)
    forward, backward = np.flatnonzero(end <= n), np.flatnonzero(start >= 0)
    runs = np.unique(np.concatenate([forward * (n + 1) + end[forward], start[backward] * (n + 1) + backward]))
    if not len(runs):
        return np.zeros(0, np.int64), runs, runs
    first, stop = runs // (n + 1), runs % (n + 1)
    each = np.fromiter(map(_hashes.__getitem__, text.lower().split()), np.uint64, int(upto[-1]))
    power, undo = _powers(len(each) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each * power[:len(each)], dtype=np.uint64)])
    h = (sums[upto[stop]] - sums[upto[first]]) * undo[upto[first]]
    return h.view(np.int64), first, stop - 1


def spans_of(text: str, least: int = 3, words: int = 20) -> list[tuple[int, int, int]]:
    """(hash, first, last) of every span of a text, see :func:`span_arrays`."""
    return list(zip(*(x.tolist() for x in span_arrays(text, sentences_of(text), least, words))))


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans (h, a, b) of every text, and one row (NULL, sentences, NULL) that counts its sentences."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            found, sizes = [], []
            for text in part.column(2):
                text = text.as_py() or ""
                parts = sentences_of(text)
                found.append(span_arrays(text, parts))
                sizes.append(len(parts))
            rows = np.repeat(np.arange(len(found)), [len(h) for h, *_ in found])
            own = pa.array(np.concatenate([rows, np.arange(len(found))]))
            counts = np.zeros(len(rows) + len(found), bool)
            counts[len(rows):] = True
            h, a, b = (np.concatenate([f[k] for f in found]) for k in range(3))
            none = np.zeros(len(found), np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(own), part.column(1).take(own), pa.array(np.concatenate([h, none]), mask=counts),
                 pa.array(np.concatenate([a, sizes]).astype(np.int32)), pa.array(np.concatenate([b, none]).astype(np.int32), mask=counts)],
                ["id", "key", "h", "a", "b"])


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, gone = [], []
        for text, covered in zip(batch.column(1), batch.column(3)):
            text, covered = text.as_py(), covered.as_py()
            if not covered:
                texts.append(text)
                gone.append(0)
                continue
            parts = sentences_of(text or "")
            drop = bytearray(len(parts))
            for span in covered:
                drop[span["a"]:span["b"] + 1] = b"\x01" * (span["b"] + 1 - span["a"])
            texts.append("".join(text[s:e] for (s, e, _), d in zip(parts, drop) if not d))
            gone.append(sum(drop))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(texts, pa.string()), batch.column(2), pa.array(gone, pa.int64())],
            ["row", "text", "n_sentences", "n_removed"])


def drop_repeated_spans(docs: DataFrame, id_column: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: the id) and text without repeated spans, n_sentences, n_removed; one row per row.

    NULL texts stay NULL, empty ones empty.  Rows equal in id and text are one document: each gets its result.  Case
    and white space do not matter for a span.  Texts are read whole; a span inside one document repeats like any other.
    """
    scratch = Scratch(docs.sparkSession, "spans")
    own = F.col(text).cast("string")
    given = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in (keep or [id_column])]).alias("row"), F.col(id_column).alias("id"),
        F.xxhash64(id_column, own).alias("key"), own.alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    spans = scratch.keep(given.select("id", "key", "text").mapInArrow(_spans, f"id {kind}, key long, h long, a int, b int"))
    # most hashes stand once: they are found by counting alone, and only the others are put in order
    hashed = spans.where("h is not null")
    often = scratch.keep(hashed.groupBy(F.col("h").alias("_h")).agg(F.count("*").alias("n")).where("n > 1").select("_h"))
    ends = F.expr("shiftleft(cast(a as bigint), 32) | b").alias("ends")  # one long in the shuffle of all spans
    # a hash stands once in the table that is built, so no sort of all spans is needed and a hot one can be split
    shared = scratch.keep(hashed.select("h", "id", "key", ends).join(often.hint("shuffle_hash"), F.col("h") == F.col("_h")).drop("_h"))
    place = F.struct("id", "key", "ends")
    firsts = scratch.keep(shared.groupBy(F.col("h").alias("_h")).agg(F.min(place).alias("first")).select(
        "_h", F.col("first.key").alias("_key"), F.expr("shiftright(first.ends, 32)").alias("_a")))
    # a key stands for one id, so key and place tell the first occurrence from the others
    covered = shared.join(firsts.hint("shuffle_hash"), F.col("h") == F.col("_h")).where("key <> _key or shiftright(ends, 32) <> _a").select("key", "ends").distinct().select(
        "key", F.expr("cast(shiftright(ends, 32) as int)").alias("a"), F.expr("cast(ends & 4294967295 as int)").alias("b"))
    counted = covered.unionByName(spans.where("h is null").select("key", "a", "b"))
    per_doc = scratch.keep(counted.groupBy("key").agg(
        F.collect_list(F.when(F.col("b").isNotNull(), F.struct("a", "b"))).alias("covered"),
        F.max(F.when(F.col("b").isNull(), F.col("a"))).cast("long").alias("n_sentences")))
    scratch.drop_but(per_doc)
    marked = given.select("row", "key", "text").join(per_doc, "key").select("row", "text", "n_sentences", "covered")
    shape = f"row {given.schema['row'].dataType.simpleString()}, text string, n_sentences long, n_removed long"
    return marked.mapInArrow(_cut_out, shape).select("row.*", F.col("text").alias("clean_text"), "n_sentences", "n_removed")
