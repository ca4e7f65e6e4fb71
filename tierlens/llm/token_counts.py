"""Token counts of a byte-level BPE by the whole-token shortcut (operator 10).

Offline, every vocabulary string is run through the merges once; those that come out as a single token are *whole*.
A pre-token equal to a whole string counts 1 without merging.  Only the rest goes through the merges, each distinct
pre-token once per worker.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: the pre-token pattern of this tokenizer family
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ANY = regex.compile(PRE_TOKEN.replace(r"\s", r"\p{White_Space}").replace(r"[^\p{White_Space}", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
# In these characters the standard library's classes agree with \p{L}, \p{N} and \s, and it is three times as fast.
_USUAL = re.compile(r"[\t\n\r -~¡-±´-¸º»¿-ɏ]*\Z")
_FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_MEMO = 500_000  # distinct merged pre-tokens a worker remembers before it starts afresh


_NEVER = 1 << 30


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself if printable in Latin-1, else the next free code point from 256."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


_SYMBOLS = byte_symbols()


def symbols_of(text: str) -> str:
    return "".join(map(_SYMBOLS.__getitem__, text.encode("utf-8", "surrogatepass")))


class _Memo(dict):
    """Pre-token -> tokens: the whole tokens from the start, others once they have been merged."""

    def __init__(self, counter):
        super().__init__(dict.fromkeys(counter.whole, 1))
        self.counter = counter

    def __missing__(self, token: str) -> int:
        n = self.counter.merged(symbols_of(token))
        if len(token) <= 64:
            self[token] = n
        return n


class Counter:
    """Merge ranks, whole tokens and special strings of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        real = {s: chr(b).encode("latin-1") for b, s in enumerate(_SYMBOLS)}
        self.whole = set()
        for token in spec["model"]["vocab"]:
            if self.merged(token) == 1:
                try:
                    self.whole.add(b"".join(real[c] for c in token).decode("utf-8"))
                except UnicodeDecodeError:
                    pass  # part of a character: no pre-token equals it
        self._memo = _Memo(self)

    def __getstate__(self):
        return self.ranks, self.special, self.whole

    def __setstate__(self, state):
        self.ranks, self.special, self.whole = state
        self._memo = _Memo(self)

    def merged(self, symbols: str) -> int:
        """Tokens left after merging the lowest-ranked pair, leftmost first, until no pair has a rank."""
        ranks = self.ranks
        if len(symbols) > 64:
            return self._merged_long(symbols)
        parts, rank = list(symbols), ranks.get
        found = [rank(pair, _NEVER) for pair in zip(parts, parts[1:])]
        while found:
            lowest = min(found)
            if lowest == _NEVER:
                break
            at = found.index(lowest)
            parts[at] += parts[at + 1]
            del parts[at + 1], found[at]
            if at < len(found):
                found[at] = rank((parts[at], parts[at + 1]), _NEVER)
            if at:
                found[at - 1] = rank((parts[at - 1], parts[at]), _NEVER)
        return len(parts)

    def _merged_long(self, symbols: str) -> int:
        """The same with a heap of pairs and linked neighbours: n log n for pre-tokens of any length."""
        parts, n = list(symbols), len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self.ranks
        heap = [(ranks[p], i, p) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, (a, b) = heapq.heappop(heap)
            j = after[i] if parts[i] == a else n
            if j >= n or parts[j] != b:
                continue  # a neighbour has merged meanwhile
            parts[i], parts[j] = a + b, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            left -= 1
            for k in (before[i], i):
                if k >= 0 and after[k] < n:
                    pair = parts[k], parts[after[k]]
                    if pair in ranks:
                        heapq.heappush(heap, (ranks[pair], k, pair))
        return left

    def _plain(self, text: str) -> int:
        if len(self._memo) > len(self.whole) + _MEMO:
            self._memo = _Memo(self)
        return sum(map(self._memo.__getitem__, (_FAST if _USUAL.match(text) else _ANY).findall(text)))

    def count(self, text: str | None) -> int:
        """Tokens of the whole text; a special string inside it is one token, as the library has it by default."""
        if not text:
            return 0
        total = 0
        for special in self.special:
            if special and special in text:
                parts = text.split(special)
                return total + len(parts) - 1 + sum(self.count(p) for p in parts)
        return self._plain(text)


def token_counts(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row.

    NULL and empty texts have no bytes and no tokens.  Texts are never cut; rows may repeat.  ``tokenizer`` is the
    path of a byte-level BPE file on the driver; its ranks and whole tokens are broadcast (their size is the
    vocabulary's).
    """
    shared = docs.sparkSession.sparkContext.broadcast(Counter(tokenizer))
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = shared.value
        for batch in batches:
            n_bytes, n_tokens = [], []
            for t in batch.column(1):
                t = t.as_py()
                n_bytes.append(len((t or "").encode("utf-8")))
                n_tokens.append(counter.count(t))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], ["id", "n_bytes", "n_tokens"])

    counted = rows.mapInArrow(count, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
