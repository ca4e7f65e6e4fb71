"""Word shingles, their hashes and SimHash fingerprints (numpy, inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from xxhash import xxh64_intdigest

SEED = 42
MIX = np.uint64(0x9E3779B97F4A7C15)
_ALL = (1 << 64) - 1
HASHES_AT_ONCE = 1 << 15


def shingle_hashes(text: bytes | None, size: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words, repeats included; the whole sequence if it is shorter, none if empty.

    Words are maximal runs without ASCII white space; A-Z are lower-cased, other letters stay.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= size:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    starts = [0]
    for w in words:
        starts.append(starts[-1] + len(w) + 1)
    return np.fromiter(
        (xxh64_intdigest(joined[s:e - 1], SEED) for s, e in zip(starts, starts[size:])), np.uint64, len(words) - size + 1)


def mixed(hashes: np.ndarray, word: int) -> np.ndarray:
    """Word 0 of a fingerprint uses the hashes as they are, word k an independent mix of them."""
    if not word:
        return hashes
    z = hashes + np.uint64(int(MIX) * word & _ALL)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _set_bits(hashes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set."""
    total = np.zeros(64, np.int64)
    for start in range(0, len(hashes), HASHES_AT_ONCE):
        part = hashes[start:start + HASHES_AT_ONCE]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        blocks = np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8)
        total += blocks.sum(axis=0, dtype=np.int64)
    return total


def simhash(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """``words`` x 64 bits, each set if it is set in over half the hashes; zero without hashes."""
    out = np.zeros(words, np.uint64)
    if len(hashes):
        for k in range(words):
            over = 2 * _set_bits(mixed(hashes, k)) > len(hashes)
            out[k] = np.packbits(over, bitorder="little").view(np.uint64)[0]
    return out


def utf8_values(column) -> Iterator[bytes | None]:
    """The UTF-8 bytes of an Arrow text column, one value at a time."""
    import pyarrow as pa

    binary = column.cast(pa.binary() if column.type == pa.string() else pa.large_binary())
    return (v.as_py() for v in binary)
