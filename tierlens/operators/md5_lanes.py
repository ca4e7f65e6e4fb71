"""MD5 of many short texts at once (numpy, inside tasks).

A text of at most 55 bytes is one block of MD5, so all texts of a batch go through the 64 steps side by side, a step being
a few operations on arrays of 32-bit words.
"""

from __future__ import annotations

import math

import numpy as np

LANES = 1 << 15
_SINES = [int(abs(math.sin(i + 1)) * 2 ** 32) for i in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_LONGEST = 55


def md5_words(words: list[np.ndarray | int], lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The four words of the digests, as read from their bytes with the highest first.

    ``words`` are the 16 words of the padded blocks; a number is the same in all lanes.
    """
    a, b, c, d = (np.full(lanes, x, np.uint32) for x in _START)
    f, t = np.empty(lanes, np.uint32), np.empty(lanes, np.uint32)
    for i in range(64):
        if i < 16:
            k = i
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            k = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            k = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            k = 7 * i % 16
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        word = words[k]
        if isinstance(word, np.ndarray):
            np.add(f, word, out=f)
            word = 0
        np.add(f, np.uint32((_SINES[i] + word) & 0xFFFFFFFF), out=f)
        turn = _TURNS[i // 16][i % 4]
        np.left_shift(f, np.uint32(turn), out=t)
        np.right_shift(f, np.uint32(32 - turn), out=f)
        np.bitwise_or(f, t, out=f)
        np.add(f, b, out=f)
        a, b, c, d, f = d, f, b, c, a  # the array of the old ``a`` is free
    return tuple(np.add(x, np.uint32(s)).byteswap() for x, s in zip((a, b, c, d), _START))


def block_words(texts: np.ndarray) -> list[np.ndarray | int]:
    """The 16 words of texts of equal length, a row of bytes each."""
    lanes, size = texts.shape
    if size > _LONGEST:
        raise ValueError(f"texts of more than {_LONGEST} bytes do not fit into one block")
    used = size // 4 + 1
    block = np.zeros((lanes, 4 * used), np.uint8)
    block[:, :size] = texts
    block[:, size] = 0x80
    columns = np.ascontiguousarray(block.view("<u4").T)
    words = [*columns, *[0] * (16 - used)]
    # the length in bits; texts of 52 bytes and more leave it a place too
    words[14] = 8 * size
    return words


def digits(numbers: np.ndarray, places: int) -> np.ndarray:
    """The decimal digits of numbers that have so many, a row of bytes each."""
    out = np.empty((len(numbers), places), np.uint8)
    rest = numbers
    for at in range(places - 1, -1, -1):
        up = rest // 10
        out[:, at] = rest - up * 10 + 48
        rest = up
    return out


def digit_ranges(lower: int, upper: int):
    """(lower, upper, places) of the pieces of a range whose numbers have equally many digits, of at most a batch of lanes."""
    while lower < upper:
        places = len(str(lower))
        until = min(upper, 10 ** places, lower + LANES)
        yield lower, until, places
        lower = until


def leading_60(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first 15 hexadecimal digits of a digest as a number."""
    return a.astype(np.uint64) << np.uint64(28) | (b >> np.uint32(4)).astype(np.uint64)
