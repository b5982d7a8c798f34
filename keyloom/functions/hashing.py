"""Hash functions of keys.

Hash values place rows and feed sketches; they never decide a result.  The
built-in ones run in the JVM.  Those whose values must equal a published
algorithm's are Arrow-batched and off the main path.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

U32 = (1 << 32) - 1


def identity(key: Column) -> Column:
    """The key's low 64 bits."""
    return key.cast("long")


def fast64(key: Column) -> Column:
    """The 64-bit hash used for placement and sketches."""
    return F.xxhash64(key)


def fast32(key: Column) -> Column:
    """Spark's 32-bit Murmur3 with seed 42."""
    return F.hash(key)


def finalizer32(x: Column) -> Column:
    """Murmur3's 32-bit finaliser of an unsigned 32-bit value held in a long."""
    low = lambda c: c.bitwiseAND(F.lit(U32))
    # The finaliser's multipliers and shifts.
    for multiplier, shift in ((0x85EBCA6B, 16), (0xC2B2AE35, 13)):
        x = low(low(x).bitwiseXOR(F.shiftrightunsigned(low(x), shift)))
        # Products are taken in halves, so that none leaves 63 bits.
        high, rest = F.shiftrightunsigned(x, 16), x.bitwiseAND(F.lit(0xFFFF))
        x = low(F.call_function("shiftleft", low(high * F.lit(multiplier)), F.lit(16)) + rest * F.lit(multiplier))
    return x.bitwiseXOR(F.shiftrightunsigned(x, 16))


def portable60(key: Column) -> Column:
    """60 bits of the MD5 of the key written as text: a placement that any engine can repeat."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 15), 16, 10).cast("long")


# The functions below take a matrix of bytes, a key a row, all of one length.


def _rotated32(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint32(by) | x >> np.uint32(32 - by)


def _rotated64(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def _blocks(keys: np.ndarray, width: int, kind: str) -> np.ndarray:
    """Rows of little-endian words, the last block filled up with zeros."""
    n, length = keys.shape
    filled = np.zeros((n, -(-length // width) * width), np.uint8)
    filled[:, :length] = keys
    return filled.view(kind)


def _mix32(x: np.ndarray) -> np.ndarray:
    # The finaliser's multipliers and shifts.
    x = (x ^ x >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    x = (x ^ x >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    return x ^ x >> np.uint32(16)


def _mix64(x: np.ndarray) -> np.ndarray:
    # The finaliser's multipliers and shifts.
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(33)


def murmur3_32(keys: np.ndarray, seed: int = 43) -> np.ndarray:
    """Murmur3 x86_32."""
    words, length = _blocks(keys, 4, "<u4"), keys.shape[1]
    h = np.full(len(keys), seed, np.uint32)
    for i in range(words.shape[1]):
        # The algorithm's multipliers and rotations.
        h ^= _rotated32(words[:, i] * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        if 4 * i + 4 <= length:
            h = _rotated32(h, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    return _mix32(h ^ np.uint32(length)).astype(np.uint64)


def murmur3_x64_words(keys: np.ndarray, seed: int) -> np.ndarray:
    """The two words of Murmur3 x64_128."""
    words, length = _blocks(keys, 16, "<u8"), keys.shape[1]
    # The algorithm's multipliers, rotations and additions.
    a, b = np.uint64(0x87C37B91114253D5), np.uint64(0x4CF5AD432745937F)
    x, y = np.full(len(keys), seed, np.uint64), np.full(len(keys), seed, np.uint64)
    for i in range(0, words.shape[1], 2):
        p = _rotated64(words[:, i] * a, 31) * b
        q = _rotated64(words[:, i + 1] * b, 33) * a
        x, y = x ^ p, y ^ q
        if 8 * i + 16 <= length:
            x = (_rotated64(x, 27) + (y ^ q)) * np.uint64(5) + np.uint64(0x52DCE729)
            y = (_rotated64(y, 31) + x) * np.uint64(5) + np.uint64(0x38495AB5)
    x, y = x ^ np.uint64(length), y ^ np.uint64(length)
    x = x + y
    x, y = _mix64(x), _mix64(y + x)
    return np.stack([x + y, x + y + y], 1)


def murmur3_64(keys: np.ndarray, seed: int = 43) -> np.ndarray:
    """The low word of Murmur3 x64_128."""
    return murmur3_x64_words(keys, seed)[:, 0]


def murmur3_x86_words(keys: np.ndarray, seed: int) -> np.ndarray:
    """The four words of Murmur3 x86_128."""
    words, length = _blocks(keys, 16, "<u4"), keys.shape[1]
    # The algorithm's multipliers, rotations and additions.
    factors = np.array([0x239B961B, 0xAB0E9789, 0x38B34AE5, 0xA1E38B93], np.uint32)
    into, after = (15, 16, 17, 18), (19, 17, 15, 13)
    added = np.array([0x561CCD1B, 0x0BCAA747, 0x96CD1C35, 0x32AC3B17], np.uint32)
    h = [np.full(len(keys), seed, np.uint32) for _ in range(4)]
    for i in range(0, words.shape[1], 4):
        mixed = [_rotated32(words[:, i + k] * factors[k], into[k]) * factors[(k + 1) % 4] for k in range(4)]
        if 4 * i + 16 > length:
            h = [x ^ m for x, m in zip(h, mixed, strict=True)]
            break
        for k in range(4):
            h[k] = (_rotated32(h[k] ^ mixed[k], after[k]) + h[(k + 1) % 4]) * np.uint32(5) + added[k]
    h = [x ^ np.uint32(length) for x in h]
    for last in (False, True):
        h = h if not last else [_mix32(x) for x in h]
        h[0] = h[0] + h[1] + h[2] + h[3]
        h = [h[0], *[x + h[0] for x in h[1:]]]
    return np.stack(h, 1)


def murmur3_x86_128(keys: np.ndarray, seed: int = 43) -> np.ndarray:
    """The first two words of Murmur3 x86_128, the first lowest."""
    words = murmur3_x86_words(keys, seed).astype(np.uint64)
    return words[:, 0] | words[:, 1] << np.uint64(32)


@cache
def _crc_table() -> np.ndarray:
    """The byte table of the Castagnoli polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = table >> np.uint32(1) ^ np.where(table & np.uint32(1), np.uint32(0x82F63B78), np.uint32(0))
    return table


def crc32c(keys: np.ndarray, seed: int = 0) -> np.ndarray:
    """CRC-32 with the Castagnoli polynomial."""
    table = _crc_table()
    crc = np.full(len(keys), ~np.uint32(seed), np.uint32)
    for column in keys.T:
        crc = crc >> np.uint32(8) ^ table[(crc ^ column) & np.uint32(255)]
    return (~crc).astype(np.uint64)


def by_length(keys: list[bytes], function: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The function of each key, keys of one length at a time."""
    lengths = np.fromiter(map(len, keys), np.int64, len(keys))
    out = np.zeros(len(keys), np.uint64)
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        joined = b"".join(keys[i] for i in rows.tolist())
        out[rows] = function(np.frombuffer(joined, np.uint8).reshape(len(rows), length))
    return out


def hashed(key: Column, function: Callable[[np.ndarray], np.ndarray]) -> Column:
    """A published hash of a string or binary key as a long (64-bit values signed)."""

    @F.pandas_udf("long")
    def run(keys: pd.Series) -> pd.Series:
        there = keys.notna().to_numpy()
        values = by_length([bytes(k) for k in keys[there]], function)
        out = pd.Series(pd.NA, index=keys.index, dtype="Int64")
        out[there] = values.view(np.int64)
        return out

    return run(key.cast("binary"))
