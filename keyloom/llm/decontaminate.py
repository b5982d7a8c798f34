"""Benchmark decontamination by template canonicalisation.

Numbers, units after a number, and names become typed placeholders; every other
word is lower-cased with its outer punctuation off.  Windows of the resulting
templates are hash-joined between documents and benchmark items.  A document
leaks an item if windows on one alignment cover enough of the item, and enough of
the names there map one to one: the same name in the item meets the same name in
the document.  Numbers and units may coincide or part by chance and are free, and
a passage that is the item's word for word, except at one place or in as few
windows as may be missing, leaks whatever its names.  So a question that only got other numbers or
names is caught, and one whose names fall together otherwise is not.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, reduce
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 5
#: Least share of an item's windows that a document must contain.
SHARE = 0.8
#: Words in no slot that an item shorter than a window must keep if a word that
#: opens it is taken as a name.
LITERAL = 2
#: Benchmark windows in one broadcast table; a larger benchmark is taken in
#: blocks of items, each against all documents.
BLOCK_WINDOWS = 1_000_000
#: Leading bits of a window's hash that tell most windows from the benchmark's.
MARKS = 20
#: Words remembered by a worker between texts; the memory is emptied when full.
MEMORY = 300_000

NUMBER = re.compile(r"[+-]?[$€£]?\d+(?:[.,:/]\d+)*%?(?:st|nd|rd|th)?")
# Number words and units of measure in English, German, French and
# Spanish, but for those that are common words of another kind.
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million billion "
    "null zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig dreißig vierzig fünfzig hundert tausend "
    "zéro deux trois quatre cinq sept huit neuf dix onze douze vingt trente quarante cinquante mille "
    "cero dos tres cuatro cinco seis siete ocho nueve diez doce veinte treinta cuarenta cincuenta cien mil".split()
)
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg t lb oz ml l s sec min h hr hrs day days week weeks month months year years hour hours minute minutes second seconds meter meters metre metres kilometer kilometers kilometre kilometres mile miles foot feet inch inches gram grams kilogram kilograms pound pounds liter liters litre litres dollar dollars euro euros cent cents percent degree degrees "
    "tag tage tagen woche wochen monat monate monaten jahr jahre jahren stunde stunden sekunde sekunden gramm kilogramm pfund grad prozent "
    "jour jours semaine semaines mois ans année années heure heures seconde secondes mètre mètres kilomètre kilomètres gramme grammes kilogramme kilogrammes litre livres degrés "
    "día días semana semanas mes meses año años hora horas minuto minutos segundo segundos metro metros kilómetro kilómetros gramo gramos kilogramo kilogramos litro litros grados".split()
)

EDGE = "\"'`“”‘’«»()[]{}<>.,;:!?¿¡*#&%$|…-"
CLOSERS = "\"'”’)]}"
ENDERS = tuple(".!?:*#&%$")
PLAIN, NUM, UNIT, NAME, ENDS = 0, 1, 2, 4, 8


def _hash(word: str) -> int:
    """A 61-bit hash of a word."""
    return xxhash.xxh64_intdigest(word.encode("utf-8", "replace"), 61) >> 3


#: No word has white space in it, so no word's hash is meant to be one of these.
SLOT = {NUM: _hash("a number"), UNIT: _hash("a unit"), NAME: _hash("a name")}
KINDS = dict.fromkeys(NUMBER_WORDS, NUM) | dict.fromkeys(UNITS, UNIT)


class Words(dict):
    """word -> (hash without case and outer punctuation, flags), up to ``MEMORY`` words."""

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) >= MEMORY:
            self.clear()
        core = word if word.isalpha() else word.strip(EDGE)
        low = core.lower()
        flags = KINDS.get(low, PLAIN)
        if not flags:
            if not core.isalpha() and NUMBER.fullmatch(core):
                flags = NUM
            elif core[:1].isupper() and core[1:].islower():
                flags = NAME
        if core is not word and word.rstrip(CLOSERS)[-1:] in ENDERS:
            flags |= ENDS
        self[word] = out = (_hash(low), flags)
        return out


@cache
def choices(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Non-empty subsets of each word of ``size`` bits in a row, where its own begin, and how many."""
    own = [[m for m in range(1, b + 1) if m & b == m] for b in range(1 << size)]
    count = np.array([len(x) for x in own])
    return np.array(list(chain.from_iterable(own)), np.int64), np.cumsum(count) - count, count


@dataclass
class Template:
    """Hashes of the typed words and of the words, which places are slots, and which
    are names that open a text, a line or a sentence, so that they may be words."""

    words: np.ndarray
    low: np.ndarray
    slot: np.ndarray
    name: np.ndarray
    either: np.ndarray


def template(text: str | None, memory: Words) -> Template:
    """The template of a text.

    A capitalised word is a name; one that opens the text, a line or a sentence
    may be a name.  A unit is one only after a number.  Empty tokens of punctuation stay words.
    """
    lines = (text or "").split("\n")
    split = [line.split() for line in lines]
    words = list(chain.from_iterable(split))
    opens = np.cumsum([0, *map(len, split)])
    n = len(words)
    typed = np.fromiter(chain.from_iterable(map(memory.__getitem__, words)), np.int64, 2 * n).reshape(n, 2)
    flags = typed[:, 1]
    first = np.zeros(n + 1, bool)
    first[1:] = (flags & ENDS) > 0
    first[opens] = True
    after_number = np.zeros(n, bool)
    after_number[1:] = (flags[:-1] & NUM) > 0
    number = (flags & NUM) > 0
    unit = ((flags & UNIT) > 0) & after_number
    capital = (flags & NAME) > 0
    name, either = capital & ~first[:n], capital & first[:n]
    out = typed[:, 0].copy()
    for where, kind in ((number, NUM), (unit, UNIT), (name, NAME)):
        out[where] = SLOT[kind]
    return Template(out.astype(np.uint64), typed[:, 0].copy(), number | unit | name, name, either)


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each window; a shorter text has none."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = (out ^ words[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def all_windows(t: Template, size: int, literal: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the windows, with each choice of names among opening words.

    A choice leaves at least ``literal`` words that are in no slot.
    """
    plain = windows(t.words, size)
    n = len(plain)
    bits = np.zeros(n, np.int64)
    for i in range(size):
        bits |= t.either[i : i + n].astype(np.int64) << i
    some = np.flatnonzero(bits)
    if not len(some):
        return plain, np.arange(n)
    subsets, start, count = choices(size)
    bits = bits[some]
    times = count[bits]
    at = np.repeat(some, times)
    chosen = subsets[np.repeat(start[bits] - np.cumsum(times) + times, times) + np.arange(len(at))]
    if literal:
        fixed = sum((~t.slot[i : i + n])[at].astype(np.int64) for i in range(size)) - np.bitwise_count(chosen)
        at, chosen = at[fixed >= literal], chosen[fixed >= literal]
    out = np.zeros(len(at), np.uint64)
    for i in range(size):
        out = (out ^ np.where(chosen >> i & 1, np.uint64(SLOT[NAME]), t.words[at + i])) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.concatenate([plain, out]), np.concatenate([np.arange(n), at])


class Benchmark:
    """Windows of a block of items as sorted arrays, with the items' templates."""

    def __init__(self, items: list[tuple[int, str]], window: int) -> None:
        memory = Words()
        self.ids = [i for i, _ in items]
        self.templates = [template(t, memory) for _, t in items]
        self.size = window
        hashes, item, place = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        self.totals = np.zeros(len(items), np.int64)
        for i, t in enumerate(self.templates):
            size = min(window, len(t.words))
            h, at = all_windows(t, size, LITERAL if size < window else 0) if size else (np.empty(0, np.uint64), np.empty(0, np.int64))
            self.totals[i] = len(t.words) - size + 1 if size else 0
            hashes.append(h)
            item.append(np.full(len(h), i))
            place.append(at)
        self.lengths = np.array([len(t.words) for t in self.templates], np.int64)
        self.short = sorted({len(t.words) for t in self.templates if 0 < len(t.words) < window})
        h = np.concatenate(hashes)
        order = np.argsort(h, kind="stable")
        #: Whether any window's hash begins with these bits.
        self.marks = np.zeros(1 << MARKS, bool)
        self.marks[(h >> np.uint64(64 - MARKS)).astype(np.int64)] = True
        self.hashes, self.item, self.place = h[order], np.concatenate(item)[order], np.concatenate(place)[order]

    def met(self, doc: Template, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """item, place in the item and place in the document of each window in common."""
        found, where = all_windows(doc, size, LITERAL if size < self.size else 0)
        if not len(found) or not len(self.hashes):
            return (np.empty(0, np.int64),) * 3
        at = np.flatnonzero(self.marks[(found >> np.uint64(64 - MARKS)).astype(np.int64)])
        low = np.searchsorted(self.hashes, found[at])
        hit = low < len(self.hashes)
        at, low = at[hit], low[hit]
        hit = self.hashes[low] == found[at]
        at, low = at[hit], low[hit]
        count = np.searchsorted(self.hashes, found[at], side="right") - low
        rows = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        item = self.item[rows]
        own = self.lengths[item] >= size if size == self.size else self.lengths[item] == size
        return item[own], self.place[rows][own], where[np.repeat(at, count)[own]]

    def leaks(self, text: str | None, memory: Words, share: float) -> list[tuple[int, float, int]]:
        """(item id, share of its windows, differing slot values) of each leaked item.

        Windows of an item may lie on several alignments where words were put in
        or left out; slots are compared on all of them together.
        """
        doc = template(text, memory)
        out: list[tuple[int, float, int]] = []
        for size in {self.size, *self.short}:
            item, place, at = self.met(doc, size)
            for i in np.unique(item).tolist():
                own = item == i
                if len(np.unique(place[own])) < share * self.totals[i]:
                    continue
                best = self._aligned(i, doc, place[own], at[own], min(size, self.size), share)
                if best and best[0] >= share:
                    out.append((self.ids[i], *best))
        return sorted(out)

    def _aligned(self, i: int, doc: Template, place: np.ndarray, at: np.ndarray, size: int, least: float) -> tuple[float, int] | None:
        """Share and differing slots of the best stretch of the document, if one is consistent."""
        length = len(self.templates[i].words)
        order = np.argsort(at, kind="stable")
        place, at = place[order], at[order]
        best: tuple[float, int] | None = None
        shift = at - place
        reach = max(2, length // 5)
        # Only stretches with enough windows can hold the share.
        line = np.sort(shift)
        bases = np.unique(shift)
        held = np.searchsorted(line, bases + reach, side="right") - np.searchsorted(line, bases - reach)
        for base in bases[held >= least * self.totals[i]].tolist():
            near = np.abs(shift - base) <= reach
            share = len(np.unique(place[near])) / self.totals[i]
            if share < least or best is not None and share < best[0]:
                continue
            slots = self._consistent(i, doc, place[near], at[near], size, least)
            if slots is None:
                near = shift == base
                share = len(np.unique(place[near])) / self.totals[i]
                slots = self._consistent(i, doc, place[near], at[near], size, least) if share >= least else None
            if slots is None:
                continue
            if best is None or (share, -slots) > (best[0], -best[1]):
                best = (share, slots)
                if share == 1.0 and not slots:
                    break
        return best

    def _consistent(self, i: int, doc: Template, place: np.ndarray, at: np.ndarray, size: int, share: float) -> int | None:
        """Differing slot values, or None if too few names map one to one and the words aren't the item's."""
        mine = self.templates[i]
        step = np.arange(size)
        where, there = (place[:, None] + step), (at[:, None] + step)
        same = mine.low[where] == doc.low[there]
        met = np.unique(where.ravel() * len(doc.low) + there.ravel())
        w, t = met // len(doc.low), met % len(doc.low)
        spot = mine.slot[w] | mine.either[w]
        w, t = w[spot], t[spot]
        a, b = mine.low[w], doc.low[t]
        apart = a != b
        slots = len(set(zip(a[apart].tolist(), b[apart].tolist(), strict=True)))
        if len(np.unique(where[~same])) <= 1 or len(np.unique(place[same.all(1)])) >= share * self.totals[i]:
            return slots
        # A word that opens a sentence counts as a name if it is one elsewhere or differs.
        names = np.union1d(mine.low[mine.name], a[mine.either[w] & apart])
        named = (mine.name[w] | mine.either[w]) & np.isin(a, names)
        pairs = Counter(zip(a[named].tolist(), b[named].tolist(), strict=True))
        left: set[int] = set()
        right: set[int] = set()
        agree = 0
        for (x, y), n in sorted(pairs.items(), key=lambda p: (-p[1], p[0][0] != p[0][1], p[0])):
            if x not in left and y not in right:
                left.add(x)
                right.add(y)
                agree += n
        return slots if agree >= share * pairs.total() else None


def _blocks(benchmark: DataFrame, most: int) -> list[list[tuple[int, str]]]:
    """Items in blocks of about ``most`` words, streamed from the executors."""
    blocks: list[list[tuple[int, str]]] = [[]]
    held = 0
    for row in benchmark.select("item_id", "text").where("text is not null").orderBy("item_id", "text").toLocalIterator():
        words = len(row.text.split())
        if held and held + words > most:
            blocks.append([])
            held = 0
        blocks[-1].append((row.item_id, row.text))
        held += words
    return blocks


FOUND = "doc_id long, a long, b long, item_ids array<long>, best_share double, changed_slots long"


def leaked(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """doc_id, item_ids, best_share and changed_slots of the rows of ``docs`` with leaks.

    Needs doc_id and text of ``docs`` and item_id and text of ``benchmark``; other
    columns are ignored, whatever their names.  An item leaks into a document that
    contains at least ``share`` of its template windows of ``window`` words, and at
    least that share of the names in them map one to one or the words are the
    item's; an item of fewer words is one window.  Null and empty texts neither
    leak nor are leaked; null ids are kept as null.  item_ids are in order;
    best_share and changed_slots are of the best item.  Each row with a leak gives
    one row, repeated rows too, however many blocks the benchmark is taken in.
    """
    spark = docs.sparkSession
    blocks = _blocks(benchmark, block_windows)
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))
    parts = []
    for number, items in enumerate(blocks):
        shared = spark.sparkContext.broadcast(items)

        def search(frames, shared=shared):
            bench, memory = Benchmark(shared.value, window), Words()
            for frame in frames:
                rows = []
                for doc_id, text, a, b in zip(frame["doc_id"], frame["text"], frame["a"], frame["b"], strict=True):
                    if found := bench.leaks(text, memory, share):
                        best = max(found, key=lambda x: (x[1], -x[2]))
                        rows.append((doc_id, a, b, [x[0] for x in found], best[1], best[2]))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in FOUND.split(", ")])

        parts.append(keyed.mapInPandas(search, FOUND).withColumn("block", F.lit(number)))
    names = ["doc_id", "item_ids", "best_share", "changed_slots"]
    if len(parts) == 1:
        return parts[0].select(*names)
    # Rows of one id and text have the same leaks; there are as many in each block that has any.
    every = reduce(DataFrame.unionAll, parts)
    by_block = every.groupBy("doc_id", "a", "b", "block").agg(F.count("*").alias("n"), F.first("item_ids").alias("item_ids"), F.max(F.struct("best_share", (-F.col("changed_slots")).alias("kept"))).alias("best"))
    by_row = by_block.groupBy("doc_id", "a", "b").agg(F.max("n").alias("n"), F.sort_array(F.flatten(F.collect_list("item_ids"))).alias("item_ids"), F.max("best").alias("best"))
    return by_row.select("doc_id", "item_ids", F.col("best.best_share").alias("best_share"), (-F.col("best.kept")).alias("changed_slots"), F.explode(F.sequence(F.lit(1), F.col("n")))).select(*names)


def _clean(items: Broadcast, window: int, share: float):
    """A column function: whether a text leaks none of the items."""

    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bench, memory = Benchmark(items.value, window), Words()
        for batch in batches:
            yield pd.Series([not bench.leaks(text, memory, share) for text in batch], dtype=bool)

    return clean


def without_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The rows of ``docs``, all columns, whose text leaks no item (see ``leaked``)."""
    for items in _blocks(benchmark, block_windows):
        docs = docs.where(_clean(docs.sparkSession.sparkContext.broadcast(items), window, share)("text"))
    return docs
