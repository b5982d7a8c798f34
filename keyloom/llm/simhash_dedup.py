"""SimHash near-dedup with pivot distance tables.

The pivot table holds each distinct fingerprint's Hamming distances to ``PIVOTS``
reference fingerprints, computed once.  Distances from random 64-bit words to any
reference lie close to 32, so they can't serve as the key of an equi-join.
Fingerprints meet where they agree on blocks of bits: of b blocks, at most
``radius`` hold a differing bit, so two fingerprints that link agree on
b - radius whole blocks.  b follows from the number of distinct fingerprints
alone.  Where fingerprints meet, those whose tables differ by more than
``radius`` in any coordinate are discarded, and what survives is verified.  By
the triangle inequality no link is lost.

A place with over ``CHUNK`` fingerprints is left, and its members meet again on
more and smaller blocks, which agree on more bits; at the last such level, a place
that is still large is compared as pairs of chunks.  Within a place a search goes
from each linked fingerprint to those that are not linked yet, so a group of n
copies costs about n comparisons and gives n - 1 links.

Where texts, not fingerprints, must be similar, the components found so are the
places of a second search: links hold there only between texts whose sets of
shingles are similar enough.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations
from math import comb, log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.components import components, stars
from keyloom.llm.fingerprint import resemblance, shingle_sets, simhash
from keyloom.llm.text import forget, stable

BITS = 64
#: A fingerprint's distances to this many references fill one long.
PIVOTS = 8
#: A place with more fingerprints than this is split.
CHUNK = 16_384
#: Characters of the texts that are compared in one task, on average.
CHUNK_TEXT = 16_000_000
#: Most choices of blocks under which a fingerprint meets others.
MOST_PLACES = 1200
#: Places of at most this many members are compared side by side.
SMALL = 24


def pivots(count: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: pseudo-random words from a fixed seed."""
    return np.random.default_rng(7).integers(0, 2**BITS, count, np.uint64)


def _signed(word: int) -> int:
    return word - (1 << BITS) if word >> (BITS - 1) else word


def pivot_table(fp: Column) -> Column:
    """The fingerprint's distances to the pivots, a byte each, in one long."""
    return reduce(lambda a, b: a.bitwiseOR(b), (F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(_signed(int(p))))).cast("long"), 8 * k) for k, p in enumerate(pivots())))


def blocks_for(fingerprints: int, radius: int) -> int:
    """Blocks such that a place holds at most one unrelated fingerprint on average."""
    wanted = log2(max(2, fingerprints))
    blocks = radius + 1
    while BITS * (blocks - radius) / blocks < wanted and comb(blocks + 1, radius) <= MOST_PLACES:
        blocks += 1
    return blocks


def deeper(blocks: int, radius: int) -> int | None:
    """More blocks, by a third at most; None if any more take too many places."""
    more = [b for b in range(blocks + 1, blocks + blocks // 3 + 2) if comb(b, radius) <= MOST_PLACES]
    return more[-1] if more else None


def block_masks(blocks: int, radius: int) -> list[int]:
    """For each choice of ``blocks - radius`` blocks, a mask of their bits."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    single = [(1 << cuts[i + 1]) - (1 << cuts[i]) for i in range(blocks)]
    return [sum(chosen) for chosen in combinations(single, blocks - radius)]


Alike = Callable[[int, np.ndarray], np.ndarray]


class Place:
    """Fingerprints that meet, with their pivot tables, and what the search did.

    compared: pairs near in the first coordinate; verified: pairs that no other
    coordinate discards.
    """

    def __init__(self, words: np.ndarray, tables: np.ndarray, radius: int, alike: Alike | None = None) -> None:
        self.words, self.radius, self.alike = words.view(np.uint64), radius, alike
        self.tables = np.ascontiguousarray(tables).view(np.int8).reshape(-1, 8)[:, :PIVOTS]
        self.compared = self.verified = 0

    def _linked(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs link."""
        self.compared += len(i)
        at = np.arange(len(i))
        for k in range(1, PIVOTS):
            at = at[np.abs(self.tables[i[at], k] - self.tables[j[at], k]) <= self.radius]
        self.verified += len(at)
        at = at[np.bitwise_count(self.words[i[at]] ^ self.words[j[at]]) <= self.radius]
        if self.alike is None or not len(at):
            return at
        return at[np.fromiter((self.alike(x, y) for x, y in zip(i[at].tolist(), j[at].tolist(), strict=True)), bool, len(at))]

    def side_by_side(self, place: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All links among members of the same small place."""
        order = members[np.lexsort((self.tables[members, 0], place))]
        place = np.sort(place)
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        at, lag = np.arange(len(order)), 1
        while len(at):
            at = at[at + lag < len(order)]
            at = at[place[at] == place[at + lag]]
            at = at[self.tables[order[at + lag], 0] - self.tables[order[at], 0] <= self.radius]
            near = at[self._linked(order[at], order[at + lag])]
            left.append(order[near])
            right.append(order[near + lag])
            lag += 1
        return np.concatenate(left), np.concatenate(right)

    def search(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A spanning forest of a large place: from what is linked to what isn't yet."""
        rest = members[np.argsort(self.tables[members, 0], kind="stable")]
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        while len(rest):
            queue, rest = [int(rest[0])], rest[1:]
            first = self.tables[rest, 0]
            while queue and len(rest):
                x = queue.pop()
                own = int(self.tables[x, 0])
                low, high = np.searchsorted(first, (own - self.radius, own + self.radius + 1))
                near = rest[low:high]
                hit = self._linked(np.full(len(near), x), near)
                if len(hit):
                    left.append(np.full(len(hit), x))
                    right.append(near[hit])
                    queue += near[hit].tolist()
                    stays = np.ones(len(rest), bool)
                    stays[low + hit] = False
                    rest, first = rest[stays], first[stays]
        return np.concatenate(left), np.concatenate(right)

    def links(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links that connect what any links among members of the same place connect."""
        _, number, size = np.unique(place, return_inverse=True, return_counts=True)
        few = size[number] <= SMALL
        parts = [self.side_by_side(place[few], np.flatnonzero(few))]
        many = np.flatnonzero(~few)
        many = many[np.argsort(number[many], kind="stable")]
        cuts = np.flatnonzero(np.diff(number[many])) + 1
        parts += [self.search(own) for own in np.split(many, cuts) if len(own)]
        return np.concatenate([u for u, _ in parts]), np.concatenate([v for _, v in parts])


def _whole_places(found):
    """``found`` applied to frames sorted by place, never with a place cut in two."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            if not len(frame):
                continue
            whole = (frame["place"] != frame["place"].iloc[-1]).to_numpy()
            if held and (whole.any() or frame["place"].iloc[0] != held[-1]["place"].iloc[-1]):
                yield found(pd.concat([*held, frame[whole]], ignore_index=True))
                held = []
            elif whole.any():
                yield found(frame[whole].reset_index(drop=True))
            held.append(frame[~whole])
        if held:
            yield found(pd.concat(held, ignore_index=True))

    return run


#: Links (u, v), or of each batch how many pairs were compared and verified.
LINK = "u long, v long, compared long, verified long"


def _forest(radius: int, name: str, similarity: float | None = None):
    """Links among the members of each place of a frame sorted by place."""

    def found(frame: pd.DataFrame) -> pd.DataFrame:
        names = frame[name].to_numpy()
        alike = None
        if similarity is not None:
            sets = [np.frombuffer(s, np.uint64) for s in frame["shingles"]]
            sizes = [len(s) for s in sets]

            def alike(i: int, j: int) -> bool:
                small, large = min(sizes[i], sizes[j]), max(sizes[i], sizes[j])
                return small >= similarity * large and resemblance(sets[i], sets[j]) >= similarity

        place = Place(frame["fp"].to_numpy(), frame["table"].to_numpy(), radius, alike)
        i, j = place.links(frame["place"].to_numpy())
        u, v = stars(names[i], names[j])
        out = pd.DataFrame({"u": u, "v": v, "compared": np.int64(0), "verified": np.int64(0)}).astype("Int64")
        return pd.concat([out, pd.DataFrame({"u": [pd.NA], "v": [pd.NA], "compared": [place.compared], "verified": [place.verified]}).astype("Int64")], ignore_index=True)

    return _whole_places(found)


def _chunked(members: DataFrame, id_: str) -> DataFrame:
    """Members of place, as pairs of chunks where ``chunks`` is over one."""
    own = F.pmod(F.xxhash64(id_), F.col("chunks")).cast("int")
    pair = F.struct(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return dealt.withColumn("place", F.xxhash64("place", pair)).drop("own", "other", "chunks")


def _width(df: DataFrame) -> int:
    """Partitions of a shuffle, given as a number so that it isn't coalesced before rows multiply."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def links(prints: DataFrame, radius: int) -> DataFrame:
    """u, v (and counts of pairs): links that connect what any fingerprints at most
    ``radius`` apart connect.

    ``prints`` has distinct longs fp.  Of the links within a place, a spanning
    forest is returned, not all pairs.
    """
    spread = _width(prints)
    prints = stable(prints.select("fp", pivot_table(F.col("fp")).alias("table")).repartition(spread, "fp"))
    blocks, out = blocks_for(prints.count(), radius), None
    while True:
        masks = block_masks(blocks, radius)
        places = F.array(*[F.struct(F.lit(i).cast("short").alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for i, m in enumerate(masks)])
        met = prints.select("fp", "table", F.explode(places).alias("p")).select("fp", "table", "p.choice", "p.bits")
        sizes = stable(met.groupBy("choice", "bits").agg(F.count("*").alias("n")).where("n > 1"))
        crowded = sizes.where(F.col("n") > CHUNK).agg(F.count("*")).first()[0]
        further = deeper(blocks, radius) if crowded else None
        members = met.hint("merge").join(sizes.where(F.col("n") <= CHUNK) if further else sizes, ["choice", "bits"])
        members = members.select("fp", "table", F.xxhash64("choice", "bits").alias("place"), F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
        dealt = _chunked(members, "fp") if crowded and not further else members.drop("chunks")
        found = stable(dealt.repartition(spread, "place").sortWithinPartitions("place").mapInPandas(_forest(radius, "fp"), LINK))
        out = found if out is None else out.unionAll(found)
        if further:
            left = stable(met.hint("merge").join(sizes.where(F.col("n") > CHUNK), ["choice", "bits"], "left_semi").select("fp", "table").distinct().repartition(spread, "fp"))
        forget(sizes)
        forget(prints)
        if not further:
            return out
        prints, blocks = left, further


def pruning(found: DataFrame) -> DataFrame:
    """One row for what ``links`` found: compared, the pairs near in the first coordinate,
    and verified, those that no other coordinate of the pivot table discards."""
    return found.agg(F.sum("compared").alias("compared"), F.sum("verified").alias("verified"))


def _key(text: Column) -> list[Column]:
    """Two 64-bit hashes that stand for a text."""
    return [F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b")]


def _fingerprinted(docs: DataFrame, size: int, distinct: bool) -> DataFrame:
    made = docs.select("doc_id", "text").withColumn("fp", simhash(F.col("text"), size, distinct))
    return stable(made.select("doc_id", "fp", *_key(F.col("text")), F.coalesce(F.length("text"), F.lit(0)).alias("length")))


def _text_groups(docs: DataFrame, rows: DataFrame, radius: int, similarity: float, verify_size: int) -> DataFrame:
    """a, b, root, first of each different text; ``rows`` from ``_fingerprinted(docs)``.

    Texts of one root are connected; first: the least (no id, doc_id, times) of the
    text's rows, times: rows that repeat id and text.
    """
    by_id = rows.groupBy("a", "b", "doc_id").agg(F.count("*").alias("times"), F.first("fp").alias("fp"), F.first("length").alias("length"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "times")).alias("first")
    nodes = by_id.groupBy("a", "b").agg(least, F.first("fp").alias("fp"), F.first("length").alias("length"))
    nodes = stable(nodes.withColumn("node", F.monotonically_increasing_id()))
    loose = components(links(nodes.select("fp").distinct(), radius)).withColumnRenamed("node", "fp")
    placed = nodes.hint("merge").join(loose, "fp", "left").withColumn("place", F.coalesce("root", "fp")).drop("root")
    sizes = placed.groupBy("place").agg(F.count("*").alias("n"), F.sum("length").alias("weight")).where("n > 1")
    chunks = F.ceil(F.greatest(F.col("n") / CHUNK, F.col("weight") / CHUNK_TEXT)).cast("int")
    members = placed.hint("merge").join(sizes, "place").select("place", "node", "fp", pivot_table(F.col("fp")).alias("table"), F.col("a").alias("ma"), F.col("b").alias("mb"), F.col("first.doc_id").alias("mid"), chunks.alias("chunks"))
    keyed = docs.select("doc_id", "text").select("doc_id", "text", *_key(F.col("text")))
    met = keyed.hint("merge").join(members, (F.col("a") == F.col("ma")) & (F.col("b") == F.col("mb")) & F.col("doc_id").eqNullSafe(F.col("mid")))
    dealt = _chunked(met.select("node", "fp", "table", "place", "chunks", shingle_sets(F.col("text"), verify_size).alias("shingles")), "node")
    found = dealt.repartition(_width(docs), "place").sortWithinPartitions("place").mapInPandas(_forest(radius, "node", similarity), LINK)
    roots = components(found)
    return nodes.hint("merge").join(roots, "node", "left").select("a", "b", F.coalesce("root", "node").alias("root"), "first")


def simhash_dedup(docs: DataFrame, size: int = 5, radius: int = 4, distinct: bool = False, similarity: float | None = None, verify_size: int = 5) -> DataFrame:
    """doc_id, fingerprint and component_id of each row of ``docs``.

    Needs doc_id and text; other columns are ignored, whatever their names.
    ``size``: words of a shingle, which counts once with ``distinct``.  A text of
    fewer words is one shingle; one without words, or null, has fingerprint zero
    and links like any other.  Fingerprints link at ``radius`` or fewer differing
    bits; with ``similarity``, only if the Jaccard similarity of the texts' distinct
    shingles of ``verify_size`` words is at least that.
    component_id is the smallest doc_id that links reach, null if all ids there
    are null.  Repeated rows each get a row.  An empty table gives none.
    """
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    if similarity is not None:
        rows = _fingerprinted(docs, size, distinct)
        member = _text_groups(docs, rows, radius, similarity, verify_size).withColumn("least", F.col("first.doc_id"))
        least = member.groupBy("root").agg(F.min("least").alias("component_id"))
        named = member.hint("merge").join(least, "root").select("a", "b", "component_id")
        return rows.hint("merge").join(named, ["a", "b"]).select("doc_id", hexed, "component_id")
    rows = stable(docs.select("doc_id", simhash(F.col("text"), size, distinct).alias("fp")))
    nodes = stable(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes.select("fp"), radius)).withColumnRenamed("node", "fp")
    member = nodes.hint("merge").join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    named = member.hint("merge").join(least, "root").select("fp", "component_id")
    return rows.hint("merge").join(named, "fp").select("doc_id", hexed, "component_id")


def one_of_each(docs: DataFrame, size: int = 1, radius: int = 7, distinct: bool = True, similarity: float = 0.8, verify_size: int = 5) -> DataFrame:
    """The rows of ``docs``, all columns, that stay of each group of near copies.

    Groups are the components of ``simhash_dedup`` with these options.  Of a group
    the row with the smallest doc_id stays (null ids come last; of two texts under
    that id, one); of rows that repeat its id and text, one.  Null and empty texts
    are copies of each other.  An empty table gives none.
    """
    rows = _fingerprinted(docs, size, distinct)
    groups = _text_groups(docs, rows, radius, similarity, verify_size)
    kept = groups.groupBy("root").agg(F.min(F.struct("first.no_id", "first.doc_id", "a", "b", "first.times")).alias("k"))
    kept = stable(kept.select(F.col("k.doc_id").alias("kid"), F.col("k.a").alias("ka"), F.col("k.b").alias("kb"), F.col("k.times").alias("times")))
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")
    keyed = docs.select(own).select("own", *_key(F.col("own.text")))
    same = F.col("own.doc_id").eqNullSafe(F.col("kid")) & (F.col("a") == F.col("ka")) & (F.col("b") == F.col("kb"))
    columns = [F.col(f"own.`{c}`").alias(c) for c in docs.columns]
    once = keyed.hint("merge").join(kept.where("times = 1"), same, "left_semi").select(*columns)
    again = keyed.hint("merge").join(kept.where("times > 1"), same).groupBy("kid", "ka", "kb").agg(F.first("own").alias("own")).select(*columns)
    return once.unionAll(again)
