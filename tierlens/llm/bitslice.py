"""Bit-sliced comparison of fingerprints (numpy, inside tasks).

Fingerprints of a run are stored as vertical bit planes: bit i of plane b is bit b of fingerprint i, so one 64-bit
word of a plane holds the same bit of 64 fingerprints.  Comparing every fingerprint with the one d places later is
an XOR of the planes with themselves shifted by d lanes; 64 distances per word are counted at once in bit-sliced
carry-save counters, and words in which every lane already exceeds the radius are abandoned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np

ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
CHUNK_WORDS = 1 << 14


def planes_of(words: np.ndarray) -> np.ndarray:
    """(n, k) uint64 fingerprints -> (64 k, ceil(n / 64)) planes."""
    n, k = words.shape
    pad = -n % 64
    if pad:
        words = np.concatenate([words, np.zeros((pad, k), np.uint64)])
    planes = np.empty((64 * k, len(words) // 64), np.uint64)
    for j in range(k):  # one fingerprint word at a time keeps the unpacked bits small
        column = np.ascontiguousarray(words[:, j])
        for start in range(0, len(column), 1 << 16):
            part = column[start:start + (1 << 16)]
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            packed = np.packbits(bits, axis=0, bitorder="little")
            planes[64 * j:64 * j + 64, start // 64:(start + len(part)) // 64] = np.ascontiguousarray(packed.T).view(np.uint64)
    return planes


def _lanes(mask: np.ndarray) -> np.ndarray:
    """A boolean per lane -> words."""
    pad = -len(mask) % 64
    return np.packbits(np.concatenate([mask, np.zeros(pad, bool)]), bitorder="little").view(np.uint64)


def _add(a, b, c):
    """Carry-save adder: three bits of equal weight become a sum and a carry."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def _exceeds(slices: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose bit-sliced count is above ``radius``."""
    above, equal = np.zeros_like(slices[0]), np.full_like(slices[0], ALL)
    for j in range(len(slices) - 1, -1, -1):
        if radius >> j & 1:
            equal &= slices[j]
        else:
            above |= equal & slices[j]
            equal &= ~slices[j]
    return above


def _within(planes, shifted, at, to, alive, radius):
    """Of the lanes in ``alive`` (plane words ``at`` against shifted words ``to``), those within the radius."""
    depth = len(planes).bit_length()
    where = np.arange(len(at))
    out = np.zeros(len(at), np.uint64)
    slices = [np.zeros(len(at), np.uint64) for _ in range(depth)]
    for base in range(0, len(planes), 8):
        x = [planes[b][at] ^ shifted[b][to] for b in range(base, base + 8)]
        one, two, four = slices[:3]
        one, p = _add(one, x[0], x[1])
        one, q = _add(one, x[2], x[3])
        two, r = _add(two, p, q)
        one, p = _add(one, x[4], x[5])
        one, q = _add(one, x[6], x[7])
        two, s = _add(two, p, q)
        four, carry = _add(four, r, s)
        slices[:3] = one, two, four
        for j in range(3, depth):
            slices[j], carry = slices[j] ^ carry, slices[j] & carry
        alive = alive & ~_exceeds(slices, radius)
        left = alive != 0
        n = int(left.sum())
        if not n:
            return out
        if n < 0.7 * len(left):  # abandon the words that are beyond the radius in every lane
            where, at, to, alive = where[left], at[left], to[left], alive[left]
            slices = [c[left] for c in slices]
    out[where] = alive
    return out


def close_pairs(words: np.ndarray, end: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) with i < j < end[i] whose fingerprints differ in at most ``radius`` bits, in blocks.

    ``end[i]`` is the end of the group that row i belongs to; groups are contiguous.
    """
    n = len(words)
    reach = end - np.arange(n) - 1
    longest = int(reach.max(initial=0))
    if longest <= 0:
        return
    planes = planes_of(words)
    planes = np.concatenate([planes, np.zeros((len(planes), longest // 64 + 2), np.uint64)], axis=1)
    for step in [*range(1, min(64, longest + 1)), *([0] if longest >= 64 else [])]:
        low, high = np.uint64(step), np.uint64(64 - step)
        shifted = planes[:, :-1] if step == 0 else (planes[:, :-1] >> low) | (planes[:, 1:] << high)
        at, skip, alive = [], [], []
        for q in range(0 if step else 1, (longest - step) // 64 + 1):
            mask = _lanes(reach >= 64 * q + step)
            some = np.flatnonzero(mask)
            at.append(some)
            skip.append(np.full(len(some), q))
            alive.append(mask[some])
        at, skip, alive = np.concatenate(at), np.concatenate(skip), np.concatenate(alive)
        for s in range(0, len(at), CHUNK_WORDS):
            a, k = at[s:s + CHUNK_WORDS], skip[s:s + CHUNK_WORDS]
            hit = _within(planes, shifted, a, a + k, alive[s:s + CHUNK_WORDS], radius)
            some = np.flatnonzero(hit)
            if len(some):
                bits = np.unpackbits(hit[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                row, bit = np.nonzero(bits)
                i = a[some][row] * 64 + bit
                yield i, i + 64 * k[some][row] + step


def spanning_roots(
    n: int, pairs: Iterable[tuple[np.ndarray, np.ndarray]], holds: Callable[[int, int], bool] | None = None,
    likely: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
) -> np.ndarray:
    """Root (some member) of each row's connected group.

    ``holds(i, j)`` verifies a pair; it is asked only while i and j are not yet connected, so a group of m close
    rows costs about m checks and not m^2, and no link that joins two groups is lost.  ``likely(left, right)`` leaves out
    pairs of a block that cannot hold; it too sees only what the blocks before did not connect.
    """
    root = np.arange(n)

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for left, right in pairs:
        apart = root[left] != root[right]
        left, right = left[apart], right[apart]
        if likely is not None and len(left):
            some = likely(left, right)
            left, right = left[some], right[some]
        if not len(left):
            continue
        for i, j in zip(left.tolist(), right.tolist()):
            a, b = find(i), find(j)
            if a != b and (holds is None or holds(i, j)):
                root[max(a, b)] = min(a, b)
        while True:
            flat = root[root]
            if np.array_equal(flat, root):
                break
            root[:] = flat
    return root


def group_ends(keys: np.ndarray) -> np.ndarray:
    """For sorted keys, the end of each row's run."""
    if not len(keys):
        return np.zeros(0, np.int64)
    last = np.flatnonzero(np.concatenate([keys[1:] != keys[:-1], [True]])) + 1
    return np.repeat(last, np.diff(np.concatenate([[0], last])))
