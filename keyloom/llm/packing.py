"""Best-fit packing of token sequences with swap-based local search.

Documents become pieces of at most ``capacity`` tokens in one pass that keeps no
token ids, only lengths and checksums.  Pieces are dealt out evenly in blocks;
each is packed best fit, longest first, then improved: pieces move, or change
places one for one or two for one, between underfull bins wherever that raises
the sum of squared fills, until the emptiest bin is empty or nothing fits.  Bins
that are still underfull are opened again and packed together in a second round.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.text import stable

CAPACITY = 2048
END_ID = 0
#: Pieces of a block; blocks hold about as many, whatever the number of rows.
BLOCK = 40_000
#: A bin with at most this many free tokens is closed after the first round.
CLOSED = 8
#: Bins in a row that can't be emptied, after which the search ends.
PATIENCE = 16
#: Words remembered by a worker; the memory is emptied when full.
MEMORY = 300_000

# Fixed value: the pre-tokenisation pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary.

    Printable bytes stand for themselves; the others take characters from 256 on.
    """
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder(dict):
    """Ids of a byte-level BPE vocabulary as little-endian 32-bit words.

    The vocabulary merges within words of ``PATTERN`` only, so a word's ids are
    made once and remembered here.  Ids follow the order of merges, so they serve
    as ranks.  A text that holds a special token is left to the tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        symbols = byte_symbols()
        ranks = {bytes(symbols[c] for c in token): i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items()}
        self.merged = Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.split = regex.compile(PATTERN).findall

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMORY:
            self.clear()
        self[word] = ids = array("I", self.merged(word.encode("utf-8", "replace"))).tobytes()
        return ids

    def ids(self, text: str) -> bytes:
        if any(t in text for t in self.special):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.__getitem__, self.split(text)))


@cache
def encoder(path: str) -> Encoder:
    """One encoder for a worker."""
    return Encoder(path)


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """start, length of each piece; only the first may be shorter than the capacity."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's pieces."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        end = array("I", [END_ID]).tobytes()
        encode = encoder(vocabulary).ids
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                raw = encode(text or "") + end
                for k, (start, length) in enumerate(cuts(len(raw) // 4, capacity)):
                    rows.append((doc_id, k, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)])))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indices: longest first, each into the fullest bin with room."""
    bins: list[list[int]] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: a bin with r free tokens is there
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if left := room - n:
            free[left].append(b)
            rooms |= 1 << left
    return bins


class LocalSearch:
    """Moves and swaps that empty the emptiest of the underfull bins.

    Every step takes from the emptiest bin (the source) a larger amount than it
    gives back, so the sum of squared fills rises and the search ends.
    """

    def __init__(self, bins: list[list[int]], lengths: np.ndarray, capacity: int) -> None:
        self.lengths, self.capacity = lengths, capacity
        fill = [int(lengths[b].sum()) for b in bins]
        self.done = [b for b, f in zip(bins, fill, strict=True) if f == capacity]
        self.open = sorted((b for b, f in zip(bins, fill, strict=True) if 0 < f < capacity), key=lambda b: int(lengths[b].sum()))

    def run(self) -> list[list[int]]:
        settled: list[list[int]] = []
        failures = 0
        while len(self.open) + len(settled) > 1 and self.open and failures < PATIENCE:
            source = self.open.pop(0)
            self.open += settled
            if self._room(self.open) < self._fill(source):
                self.open.append(source)
                settled = []
                break
            emptied = self._emptied(source)
            settled = [b for b in settled if self._fill(b) < self.capacity]
            held = {id(b) for b in settled}
            self.done += [b for b in self.open if self._fill(b) == self.capacity]
            self.open = sorted((b for b in self.open if self._fill(b) < self.capacity and id(b) not in held), key=self._fill)
            failures = 0 if emptied else failures + 1
            if not emptied:
                settled.append(source)
        return self.done + self.open + settled

    def _fill(self, one: list[int]) -> int:
        return int(self.lengths[one].sum())

    def _room(self, some: list[list[int]]) -> int:
        return self.capacity * len(some) - sum(map(self._fill, some))

    def _emptied(self, source: list[int]) -> bool:
        """Whether the source's pieces all went to the other open bins."""
        rest = self.open
        room = np.array([self.capacity - int(self.lengths[b].sum()) for b in rest])
        items = np.array([i for b in rest for i in b])
        owner = np.repeat(np.arange(len(rest)), [len(b) for b in rest])
        pairs: tuple[np.ndarray, np.ndarray] | None = None
        while source:
            step = self._move(source, room) or self._one_for_one(source, room, items, owner) or self._two_for_one(source, room, items, owner)
            if step is None:
                if pairs is None:
                    pairs = self._pairs(items, owner)
                step = self._one_for_two(source, room, items, owner, *pairs)
            if step is None:
                return False
            out, back, b = step
            for i in out:
                source.remove(i)
                rest[b].append(i)
            for i in back:
                rest[b].remove(i)
                source.append(i)
            room[b] = self.capacity - int(self.lengths[rest[b]].sum())
            items = np.array([i for x in rest for i in x])
            owner = np.repeat(np.arange(len(rest)), [len(x) for x in rest])
            pairs = None
        return True

    def _move(self, source, room):
        for i in sorted(source, key=lambda i: -self.lengths[i]):
            fits = np.flatnonzero(room >= self.lengths[i])
            if len(fits):
                return [i], [], int(fits[np.argmin(room[fits])])
        return None

    def _given(self, amount: int, room, size, owner) -> int | None:
        """The entry given back such that ``amount`` then fits and the gain is largest."""
        gain = amount - size
        gain = np.where((gain > 0) & (gain <= room[owner]), gain, 0)
        best = int(np.argmax(gain)) if len(gain) else 0
        return best if len(gain) and gain[best] else None

    def _one_for_one(self, source, room, items, owner):
        for i in sorted(source, key=lambda i: -self.lengths[i]):
            if (k := self._given(self.lengths[i], room, self.lengths[items], owner)) is not None:
                return [i], [int(items[k])], int(owner[k])
        return None

    def _two_for_one(self, source, room, items, owner):
        """Two of the source's pieces for one of another bin."""
        for x in range(len(source)):
            for y in range(x):
                amount = self.lengths[source[x]] + self.lengths[source[y]]
                if amount <= self.capacity and (k := self._given(amount, room, self.lengths[items], owner)) is not None:
                    return [source[x], source[y]], [int(items[k])], int(owner[k])
        return None

    def _pairs(self, items, owner):
        """Pairs of places in ``items`` that share a bin."""
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        at, lag = np.arange(len(items)), 1
        while len(at):
            at = at[at + lag < len(items)]
            at = at[owner[at] == owner[at + lag]]
            left.append(at)
            right.append(at + lag)
            lag += 1
        return np.concatenate(left), np.concatenate(right)

    def _one_for_two(self, source, room, items, owner, left, right):
        """One of the source's pieces for two of another bin."""
        size = self.lengths[items[left]] + self.lengths[items[right]]
        for i in sorted(source, key=lambda i: -self.lengths[i]):
            if (k := self._given(self.lengths[i], room, size, owner[left])) is not None:
                return [i], [int(items[left[k]]), int(items[right[k]])], int(owner[left[k]])
        return None


def pack(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indices whose lengths sum to at most the capacity."""
    return LocalSearch(best_fit(lengths, capacity), lengths, capacity).run()


def _packed(frame: pd.DataFrame, number: int, capacity: int) -> pd.DataFrame:
    """The block's rows with sequence_id, offset and the sequence's free tokens."""
    lengths = frame["length"].to_numpy()
    bins = pack(lengths, capacity)
    order = np.array([i for b in bins for i in b], np.int64)
    sizes = np.array([len(b) for b in bins], np.int64)
    of = np.repeat(np.arange(len(bins)), sizes)
    held = lengths[order]
    before = np.cumsum(held) - held
    starts = np.cumsum(sizes) - sizes
    fill = np.add.reduceat(held, starts)
    out = frame.iloc[order].copy()
    out["sequence_id"] = number + of
    out["offset"] = before - np.repeat(before[starts], sizes)
    out["free"] = capacity - np.repeat(fill, sizes)
    return out


def _blocks(round_number: int, capacity: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = (round_number << 60) + (TaskContext.get().partitionId() << 36)
        held: list[pd.DataFrame] = []
        rows = 0
        for frame in frames:
            held.append(frame)
            rows += len(frame)
            if rows >= 2 * BLOCK:
                yield _packed(pd.concat(held, ignore_index=True), number, capacity)
                number, held, rows = number + rows, [], 0
        if rows:
            yield _packed(pd.concat(held, ignore_index=True), number, capacity)

    return run


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Needs doc_id and text; other columns are ignored, whatever their names.  A
    document is the ids of its text under the vocabulary file, then id 0; null is
    the empty text.  Only a document longer than ``capacity`` is cut.  Null ids
    and repeated rows are packed like any other row.  An empty table gives none.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, free long"
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    cut = stable(pieces(docs, vocabulary, capacity))
    blocks = max(1, -(-cut.count() // BLOCK))
    first = stable(cut.repartition(blocks).mapInPandas(_blocks(0, capacity), schema))
    again = first.where(F.col("free") > CLOSED).select(*names)
    blocks = max(1, -(-again.count() // BLOCK))
    second = stable(again.repartition(blocks).mapInPandas(_blocks(1, capacity), schema))
    return first.where(F.col("free") <= CLOSED).unionAll(second).drop("free")
