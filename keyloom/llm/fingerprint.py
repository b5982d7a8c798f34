"""64-bit SimHash of whole texts over word shingles, in numpy."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

from keyloom.llm.text import ASCII_LOWER, ascii_words, by_size

SEED = 42
#: One low bit in each of a word's eight bytes.
LANES = np.uint64(0x0101010101010101)
#: A byte lane holds the sum of at most this many single bits.
LANE_MAX = 255


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of ``size`` words, repeats included.

    A text of fewer words has one shingle, its whole sequence; none, no shingle.
    """
    return hashes_of(ascii_words(text), size)


def hashes_of(words: list[bytes], size: int) -> np.ndarray:
    """The hashes of the shingles of a list of words."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    runs = zip(*(words[i:] for i in range(size)), strict=False)
    return np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, runs), repeat(SEED)), np.uint64, len(words) - size + 1)


#: Constants of XXH64.
PRIMES = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]
#: Byte strings of equal length fewer than these, or longer, are hashed one by one.
FEW, LONG = 8, 256
#: Lower-cases A-Z and makes every space a plain one.
PLAIN = bytes(32 if 9 <= x <= 13 else ASCII_LOWER[x] for x in range(256))


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return x << np.uint64(bits) | x >> np.uint64(64 - bits)


def _xxh64(at: np.ndarray, length: int, eight: np.ndarray) -> np.ndarray:
    """XXH64 of the strings of one length that begin at the places; ``eight``: the eight bytes from each place on."""
    one, two, three, four, five = PRIMES
    done = 0
    if length >= 32:
        seed = np.uint64(SEED)
        with np.errstate(over="ignore"):
            lanes = [np.full(len(at), x) for x in (seed + one + two, seed + two, seed, seed - one)]
        for done in range(0, length - 31, 32):
            lanes = [_turned(x + eight[at + (done + 8 * i)] * two, 31) * one for i, x in enumerate(lanes)]
        done += 32
        out = sum(_turned(x, bits) for x, bits in zip(lanes, (1, 7, 12, 18), strict=True))
        for x in lanes:
            out = (out ^ _turned(x * two, 31) * one) * one + four
    else:
        out = np.full(len(at), np.uint64(SEED) + five)
    out += np.uint64(length)
    for done in range(done, length - 7, 8):
        out = _turned(out ^ _turned(eight[at + done] * two, 31) * one, 27) * one + four
    done = length & ~7
    if length & 4:
        out = _turned(out ^ (eight[at + done] & np.uint64(0xFFFFFFFF)) * one, 23) * two + three
        done += 4
    for done in range(done, length):
        out = _turned(out ^ (eight[at + done] & np.uint64(0xFF)) * five, 11) * one
    out = (out ^ out >> np.uint64(33)) * two
    out = (out ^ out >> np.uint64(29)) * three
    return out ^ out >> np.uint64(32)


def plain_words(texts: list[str | None]) -> tuple[bytes, np.ndarray]:
    """The words of all texts, A-Z lower-cased, each with one space behind it, and how many each text has."""
    parts = [(text or "").encode("utf-8", "replace") for text in texts]
    data = np.frombuffer((b" ".join(parts) + b" ").translate(PLAIN), np.uint8)
    space = data == 32
    after_space = np.append(True, space[:-1])
    ends = np.flatnonzero(space & ~after_space)
    till = np.searchsorted(ends, np.cumsum([len(x) + 1 for x in parts]))
    return data[~(space & after_space)].tobytes(), np.diff(till, prepend=0)


def block_hashes(words: bytes, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the shingles of several texts one after the other, and how many each text has.

    The same as ``hashes_of`` each, side by side: strings of equal length take the same
    steps.  ``words`` has one space behind each word, ``counts`` the words of each text.
    """
    sizes = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
    data = np.frombuffer(words + bytes(8), np.uint8)
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,)).copy()
    ends = np.flatnonzero(data[:-8] == 32)
    first = np.cumsum(counts) - counts
    word = np.arange(sizes.sum()) + np.repeat(first - np.cumsum(sizes) + sizes, sizes)
    at = np.append(0, ends + 1)[word]
    length = ends[np.minimum(word + size - 1, np.repeat(first + counts - 1, sizes))] - at
    out = np.empty(len(at), np.uint64)
    bounded = np.minimum(length, LONG + 1).astype(np.uint16)
    order = np.argsort(bounded, kind="stable")
    times = np.bincount(bounded, minlength=LONG + 2)
    begins = np.cumsum(times) - times
    single = times < FEW
    single[LONG + 1] = True
    for n in np.flatnonzero(~single).tolist():
        mine = order[begins[n] : begins[n] + times[n]]
        out[mine] = _xxh64(at[mine], n, eight)
    mine = np.flatnonzero(single[bounded])
    out[mine] = [xxhash.xxh64_intdigest(words[i : i + n], SEED) for i, n in zip(at[mine].tolist(), length[mine].tolist(), strict=True)]
    return out, sizes


def majority_bits(hashes: list[np.ndarray]) -> np.ndarray:
    """For each array: the word whose bits are set in over half of its values.

    Bits are summed eight at a time in byte lanes, at most 255 values a lane.
    """
    out = np.zeros(len(hashes), np.uint64)
    sizes = np.array([len(h) for h in hashes], np.int64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    values = np.concatenate([hashes[i] for i in full])
    n = sizes[full]
    first = np.cumsum(n) - n
    parts = -(-n // LANE_MAX)
    part_first = np.cumsum(parts) - parts
    within = np.arange(parts.sum()) - np.repeat(part_first, parts)
    starts = np.repeat(first, parts) + within * LANE_MAX
    found = np.zeros(len(full), np.uint64)
    for shift in range(8):
        lanes = np.add.reduceat((values >> np.uint64(shift)) & LANES, starts)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), part_first, axis=0)
        for byte in range(8):
            found |= (2 * counts[:, byte] > n).astype(np.uint64) << np.uint64(8 * byte + shift)
    out[full] = found
    return out


def simhash(text: Column, size: int, distinct: bool = False) -> Column:
    """SimHash as a long; texts without words (and null) have fingerprint zero.

    With ``distinct`` a shingle counts once however often it occurs.
    """

    @F.pandas_udf("long")
    def fingerprints(texts: pd.Series) -> pd.Series:
        hashes = (shingle_hashes(t, size) for t in texts)
        if distinct:
            hashes = map(np.unique, hashes)
        parts = [majority_bits(held) for held in by_size(hashes, len, 200_000)]
        return pd.Series(np.concatenate([np.empty(0, np.uint64), *parts]).view(np.int64))

    return fingerprints(text)


def shingle_sets(text: Column, size: int) -> Column:
    """The distinct shingle hashes of each text, sorted, as 64-bit words in bytes."""

    @F.pandas_udf("binary")
    def sets(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(t, size)).tobytes() for t in texts], dtype=object)

    return sets(text)


def resemblance(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets of hashes; 1 for two empty ones."""
    if not len(a) and not len(b):
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0.0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    same = int((b[at] == a).sum())
    return same / (len(a) + len(b) - same)
