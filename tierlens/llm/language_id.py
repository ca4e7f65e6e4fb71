"""Language identification: multinomial naive Bayes over hashed character n-grams (operator 2).

Texts are lower-cased, everything but letters becomes a blank, and n-grams with at least one letter are hashed into
``FEATURES`` buckets.  Training counts (language, bucket) are partial sums of each task, added up by one aggregation;
the log-probability matrix has a row per language and is broadcast.  Scoring builds the sparse (document, bucket)
counts of a block of documents and multiplies them with the matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDERS = (1, 2, 3)
FEATURES = 1 << 14
UNDETERMINED = "und"
_BLOCK_CHARS = 1 << 18  # characters hashed at once; longer texts are cut into overlapping pieces
_LETTER = np.array([chr(c).isalpha() for c in range(0x10000)])
_SALT = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _pieces(texts: list[str | None]) -> Iterator[list[tuple[int, str]]]:
    """Blocks of (document, piece); a piece that the text goes on after carries the next characters as look-ahead."""
    block, size, ahead = [], 0, max(ORDERS) - 1
    for row, text in enumerate(texts):
        low = (text or "").lower()
        for s in range(0, len(low), _BLOCK_CHARS):
            piece = low[s:s + _BLOCK_CHARS + ahead]
            block.append((row, piece))
            size += len(piece)
            if size >= _BLOCK_CHARS or len(block) == 64:
                yield block
                block, size = [], 0
    if block:
        yield block


def sparse_counts(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, feature, count) of the texts' n-grams, block by block; a long document spans several blocks."""
    for block in _pieces(texts):
        lengths = np.array([len(p) for _, p in block])
        codes = np.frombuffer("".join(p for _, p in block).encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = np.where(codes < 0x10000, _LETTER[np.minimum(codes, 0xFFFF)], True)
        codes = np.where(letter, codes, np.uint32(32))
        slot = np.repeat(np.arange(len(block)), lengths)
        ends = np.repeat(np.cumsum(lengths), lengths)
        # the look-ahead of a piece starts no n-gram of its own
        limit = np.repeat(np.cumsum(lengths) - lengths + np.minimum(lengths, _BLOCK_CHARS), lengths)
        at = np.arange(len(codes))
        cells = np.zeros(len(block) * FEATURES, np.int64)
        hashed, lettered = np.zeros(len(codes), np.uint32), np.zeros(len(codes), bool)
        for k in range(max(ORDERS)):
            n = len(codes) - k
            if n <= 0:
                break
            hashed, lettered = hashed[:n], lettered[:n] | letter[k:]
            hashed = (hashed ^ codes[k:] * _SALT[k % 3]) * _SALT[(k + 1) % 3]
            if k + 1 not in ORDERS:
                continue
            whole = lettered & (at[:n] + k < ends[:n]) & (at[:n] < limit[:n])
            bucket = (hashed[whole] ^ (hashed[whole] >> np.uint32(15))) % np.uint32(FEATURES)
            cells += np.bincount(slot[:n][whole] * FEATURES + bucket, minlength=len(cells))
        filled = np.flatnonzero(cells)
        rows = np.array([r for r, _ in block])
        yield rows[filled // FEATURES], filled % FEATURES, cells[filled]


def train_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, feature, n) over all rows with a text and a language."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            names = sorted(set(langs))
            code = np.array([names.index(x) for x in langs])
            for name in names:
                total.setdefault(name, np.zeros(FEATURES, np.int64))
            for row, feature, n in sparse_counts(batch.column(0).to_pylist()):
                for c in np.unique(code[row]):
                    mine = code[row] == c
                    total[names[c]] += np.bincount(feature[mine], n[mine], FEATURES).astype(np.int64)
        for name, counts in total.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(counts[some])], ["lang", "feature", "n"])

    return rows.mapInArrow(count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))


class NaiveBayes:
    """Languages in sorted order and their log-probabilities, float32 (languages, FEATURES).  The prior is uniform."""

    def __init__(self, counts, alpha: float = 0.5):
        self.langs = sorted(set(counts["lang"]))
        table = np.full((len(self.langs), FEATURES), alpha)
        place = {x: i for i, x in enumerate(self.langs)}
        np.add.at(table, (counts["lang"].map(place).to_numpy(dtype=int), counts["feature"].to_numpy(dtype=int)), counts["n"].to_numpy())
        self.matrix = np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and posterior of each text; ``und`` and 0 without a letter or without any learned language."""
        score = np.zeros((len(texts), len(self.langs)))
        for row, feature, n in sparse_counts(texts):
            products = self.matrix.T[feature] * n[:, None]
            if len(row):
                first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                np.add.at(score, row[first], np.add.reduceat(products, first, axis=0, dtype=np.float64))
        lettered = np.array([has_letter(t) for t in texts], bool)
        if not self.langs or not len(texts):
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        best = score.argmax(axis=1)
        posterior = 1 / np.exp(score - score.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.langs[b] if ok else UNDETERMINED for b, ok in zip(best, lettered)], np.where(lettered, posterior, 0.0)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", alpha: float = 0.5) -> NaiveBayes:
    """The model of the rows given.  What reaches the driver is the model: a row per language and bucket."""
    return NaiveBayes(train_counts(docs, text, lang).toPandas(), alpha)


def predict(docs: DataFrame, model: NaiveBayes, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default all) inside a struct ``row``, with ``lang_pred`` and ``score``.

    Only the text decides.  NULL texts and texts without a letter are ``und`` with score 0; ties go to the language
    that sorts first.  Texts are read whole, however long.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = docs.columns if keep is None else keep
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(text).cast("string").alias("_t"))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, score = shared.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(score)], ["row", "lang_pred", "score"])

    return rows.mapInArrow(label, f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double")


def identify(docs: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score) for every row.

    Learned from the rows with a language whose crc32(id) mod 4 is not 2; the others are held out.  A NULL id counts
    as the text 'null' there.
    """
    remainder = F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("null")).cast("binary")), F.lit(4))
    model = fit(docs.where(remainder != 2), text, lang)
    ids = docs.select(F.struct(F.col(id_column).alias("id"), (remainder == 2).alias("held_out")).alias("_m"), F.col(text).alias("_x"))
    return predict(ids, model, "_x", ["_m"]).select("row._m.*", "lang_pred", "score")


def keep_identified(docs: DataFrame, text: str = "text", lang: str = "lang", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is determined with a posterior of at least ``least``; all columns.

    Rejected: NULL texts, texts without a letter, and texts that no learned language explains better than the rest.
    Without a single labelled row nothing can be learned, and nothing is rejected but texts without a letter.
    """
    model = fit(docs, text, lang)
    found = predict(docs, model, text)
    sure = (F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)
    kept = found.where(sure) if model.langs else docs.where(F.col(text).rlike(r"\p{L}")).select(F.struct("*").alias("row"))
    return kept.select("row.*")
