"""Immutable key-value maps over DataFrames.

A map is a frame with unique non-null ``key`` and a ``value``; verbs that would
change it return another map.  Rows without a key are left out on the way in.
Every verb is an aggregation or an equi-join, so that Catalyst chooses the physical
form, partial aggregation included.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIRST, LAST, COUNT, FOLD = "first", "last", "count", "fold"
#: Reductions whose order and grouping don't matter.
REDUCERS: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "product": F.product,
    "bit_and": F.bit_and,
    "bit_or": F.bit_or,
    "bit_xor": F.bit_xor,
    COUNT: F.sum,
}
Predicate = Callable[[Column], Column]
Binary = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class KeyedMap:
    """A map and the reduction that joins a new value to the one it holds.

    ``frame``: key, value, and for first and last also ord, the place of the held
    value in the total order of all insertions.
    """

    frame: DataFrame
    reducer: str
    fold: Binary | None = None

    # --- building -----------------------------------------------------------

    @classmethod
    def build(cls, rows: DataFrame, key: str | Column, value: str | Column | None = None, reducer: str = FIRST, order_by: Iterable[str | Column] = (), where: Column | None = None, fold: Binary | None = None, zero: Column | None = None) -> KeyedMap:
        """A map of ``rows``.

        ``first`` and ``last`` keep the value of the least or greatest ``order_by``
        (ties: of the least or greatest value); ``count`` counts rows, or sums
        ``value`` if given; ``fold`` applies ``fold(held, new)`` in order from
        ``zero``, and holds a key's values in one array.  ``where`` selects rows.
        """
        empty = cls(_typed(rows, key, value, order_by).limit(0), reducer, fold)
        return empty._reduced(_typed(rows if where is None else rows.where(where), key, value, order_by), zero)

    def _reduced(self, rows: DataFrame, zero: Column | None = None) -> KeyedMap:
        """The map of rows (key, value, ord)."""
        if self.reducer in (FIRST, LAST):
            pick, edge = (F.min_by, F.min) if self.reducer == FIRST else (F.max_by, F.max)
            place = F.struct("ord", "value")
            out = rows.groupBy("key").agg(pick("value", place).alias("value"), edge(place)["ord"].alias("ord"))
        elif self.reducer == FOLD:
            if self.fold is None:
                raise ValueError("a fold needs its function")
            listed = rows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ord", "value"))).alias("all"))
            start = F.lit(0).cast("long") if zero is None else zero
            out = listed.select("key", F.aggregate(F.transform("all", lambda x: x["value"]), start, self.fold).alias("value"))
        elif self.reducer in REDUCERS:
            out = rows.groupBy("key").agg(REDUCERS[self.reducer]("value").alias("value"))
        else:
            raise ValueError(f"unknown reducer {self.reducer}")
        return replace(self, frame=out)

    # --- insertion ----------------------------------------------------------

    def insert(self, rows: DataFrame, key: str | Column, value: str | Column | None = None, order_by: Iterable[str | Column] = (), where: Column | None = None) -> KeyedMap:
        """This map with more rows reduced into it.

        The order of first and last spans all insertions.  A fold goes on from the
        held value: ``fold(held, new)``, new keys from zero.
        """
        more = _typed(rows if where is None else rows.where(where), key, value, order_by)
        if self.reducer == FOLD:
            listed = more.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ord", "value"))).alias("all"))
            both = self.frame.join(listed, "key", "full_outer")
            values = F.transform(F.coalesce("all", F.array()), lambda x: x["value"])
            return replace(self, frame=both.select("key", F.aggregate(values, F.coalesce("value", F.lit(0).cast("long")), self.fold).alias("value")))
        if self.reducer in (FIRST, LAST):
            return self._reduced(self.frame.select("key", "value", "ord").unionAll(more.select("key", "value", "ord")))
        return self._reduced(self.frame.select("key", "value").unionAll(self._reduced(more).frame.select("key", "value")))

    def insert_all(self, batches: Iterable[DataFrame], key: str | Column, value: str | Column | None = None, order_by: Iterable[str | Column] = ()) -> KeyedMap:
        """Several batches appended and reduced once."""
        joined = None
        for batch in batches:
            rows = _typed(batch, key, value, order_by)
            joined = rows if joined is None else joined.unionAll(rows)
        if joined is None:
            return self
        return self.insert(joined, "key", "value", ["ord"])

    # --- lookup -------------------------------------------------------------

    def _pairs(self, out_pred: Predicate | None) -> DataFrame:
        rows = self.frame.select("key", "value")
        return rows if out_pred is None else rows.where(out_pred(F.struct("key", "value")))

    @staticmethod
    def _asked(queries: DataFrame, in_pred: Predicate | None, distinct: bool) -> DataFrame:
        queries = queries if in_pred is None else queries.where(in_pred(F.col("key")))
        return queries.dropDuplicates(["key"]) if distinct else queries

    def find(self, queries: DataFrame, default: object = 0, in_pred: Predicate | None = None, out_pred: Predicate | None = None, distinct: bool = False) -> DataFrame:
        """Every query row (column key) with its value, or the default for a miss.

        A query that fails ``in_pred`` is a miss, as is an entry (key, value) that
        fails ``out_pred``; repeated queries each have a row unless ``distinct``.
        """
        asked = self._asked(queries, None, distinct)
        hits = self._pairs(out_pred).withColumn("hit", F.lit(True))
        found = asked.join(hits, "key", "left")
        hit = F.coalesce("hit", F.lit(False))
        if in_pred is not None:
            hit = hit & F.coalesce(in_pred(F.col("key")), F.lit(False))
        kind = self.frame.schema["value"].dataType
        return found.withColumn("value", F.when(hit, F.col("value")).otherwise(F.lit(default).cast(kind))).drop("hit")

    def find_existing(self, queries: DataFrame, in_pred: Predicate | None = None, out_pred: Predicate | None = None, distinct: bool = False) -> DataFrame:
        """The query rows that hit, with their values."""
        return self._asked(queries, in_pred, distinct).join(self._pairs(out_pred), "key")

    def find_where(self, pred: Predicate) -> DataFrame:
        """The entries that satisfy a predicate of (key, value)."""
        return self._pairs(pred)

    def exists(self, queries: DataFrame, in_pred: Predicate | None = None, distinct: bool = False, out_pred: Predicate | None = None, miss: int = 0) -> DataFrame:
        """Every query row with ``found``: 1 if its key is there, else ``miss``.

        Queries that fail ``in_pred`` are left out; an entry that fails
        ``out_pred`` is a miss.
        """
        asked = self._asked(queries, in_pred, distinct)
        keys = self._pairs(out_pred).select("key", F.lit(1).alias("found"))
        return asked.join(keys, "key", "left").withColumn("found", F.coalesce("found", F.lit(miss)))

    count = exists

    def exists_where(self, pred: Predicate) -> DataFrame:
        """Every held key with ``found``: 1 if its entry satisfies the predicate, else 0."""
        return self.frame.select("key", F.coalesce(pred(F.struct("key", "value")), F.lit(False)).cast("int").alias("found"))

    def query(self, queries: DataFrame, functor: Callable[[Column, Column, Column], Column], name: str = "result", in_pred: Predicate | None = None, out_pred: Predicate | None = None) -> DataFrame:
        """Every query row with ``functor(key, value, hit)``; value is null where hit is false."""
        hits = self._pairs(out_pred).withColumn("hit_", F.lit(True))
        found = self._asked(queries, in_pred, False).join(hits, "key", "left")
        return found.withColumn(name, functor(F.col("key"), F.col("value"), F.coalesce("hit_", F.lit(False)))).drop("value", "hit_")

    def hits(self, queries: DataFrame, in_pred: Predicate | None = None, out_pred: Predicate | None = None) -> DataFrame:
        """One row: asked, the queries that satisfy ``in_pred``, and hits, those that find an entry."""
        found = self.exists(queries, in_pred, out_pred=out_pred)
        return found.agg(F.count("*").alias("asked"), F.coalesce(F.sum("found"), F.lit(0)).alias("hits"))

    # --- change -------------------------------------------------------------

    def _changes(self, updates: DataFrame, order_by: Iterable[str | Column]) -> DataFrame:
        """The updates (key, value) as one value a key."""
        reducer = LAST if self.reducer == FOLD else self.reducer
        changes = KeyedMap.build(updates, "key", "value", reducer, order_by).frame
        return changes.select("key", F.col("value").alias("new"))

    def update(self, updates: DataFrame, combine: Binary | None = None, order_by: Iterable[str | Column] = ()) -> KeyedMap:
        """Held keys changed by the updates; other keys of theirs are ignored.

        Without ``combine`` the map's own reduction joins held and new value; a
        first-wins map doesn't change.
        """
        if combine is None and self.reducer == FIRST:
            return self
        combine = combine or self._combine()
        both = self.frame.join(self._changes(updates, order_by), "key", "left")
        value = F.when(F.col("new").isNotNull(), combine(F.col("value"), F.col("new"))).otherwise(F.col("value"))
        return replace(self, frame=both.withColumn("value", value).drop("new"))

    def upsert(self, updates: DataFrame, combine: Binary | None = None, order_by: Iterable[str | Column] = ()) -> KeyedMap:
        """As ``update``, and keys that aren't held are put in; by default the new value stays."""
        combine = combine or (lambda held, new: new)
        columns = [c for c in self.frame.columns if c not in ("key", "value")]
        both = self.frame.join(self._changes(updates, order_by), "key", "full_outer")
        value = F.when(F.col("new").isNull(), F.col("value")).when(F.col("value").isNull(), F.col("new")).otherwise(combine(F.col("value"), F.col("new")))
        return replace(self, frame=both.select("key", value.alias("value"), *columns))

    def _combine(self) -> Binary:
        held: dict[str, Binary] = {
            LAST: lambda a, b: b,
            "sum": lambda a, b: a + b,
            COUNT: lambda a, b: a + b,
            "min": F.least,
            "max": F.greatest,
            "product": lambda a, b: a * b,
            "bit_and": lambda a, b: a.bitwiseAND(b),
            "bit_or": lambda a, b: a.bitwiseOR(b),
            "bit_xor": lambda a, b: a.bitwiseXOR(b),
        }
        if self.reducer == FOLD and self.fold is not None:
            return self.fold
        return held[self.reducer]

    def _doomed(self, keys: DataFrame, in_pred: Predicate | None, out_pred: Predicate | None) -> DataFrame:
        """The keys of entries that an erasure removes."""
        asked = self._asked(keys.select("key"), in_pred, False)
        return asked if out_pred is None else self._pairs(out_pred).select("key").join(asked, "key", "left_semi")

    def erase(self, keys: DataFrame, in_pred: Predicate | None = None, out_pred: Predicate | None = None) -> KeyedMap:
        """This map without the keys (column key) that satisfy ``in_pred`` and whose
        entries (key, value) satisfy ``out_pred``."""
        return replace(self, frame=self.frame.join(self._doomed(keys, in_pred, out_pred), "key", "left_anti"))

    def erased(self, keys: DataFrame, in_pred: Predicate | None = None, out_pred: Predicate | None = None) -> DataFrame:
        """One row, removed: how many entries ``erase`` with these arguments takes out."""
        return self.frame.join(self._doomed(keys, in_pred, out_pred), "key", "left_semi").agg(F.count("*").alias("removed"))

    def erase_where(self, pred: Predicate) -> KeyedMap:
        """This map without the entries that satisfy a predicate of (key, value)."""
        return replace(self, frame=self.frame.where(~F.coalesce(pred(F.struct("key", "value")), F.lit(False))))

    def clear(self) -> KeyedMap:
        return replace(self, frame=self.frame.limit(0))

    # --- facts --------------------------------------------------------------

    def entries(self) -> DataFrame:
        return self.frame.select("key", "value")

    def keys(self) -> DataFrame:
        return self.frame.select("key")

    def size(self) -> int:
        return self.frame.count()

    unique_size = size

    def empty(self) -> bool:
        return self.frame.isEmpty()

    def facts(self) -> DataFrame:
        """One row: size, total and sum_squares of the values."""
        value = F.col("value").cast("long")
        return self.frame.agg(F.count("*").alias("size"), F.coalesce(F.sum(value), F.lit(0)).alias("total"), F.coalesce(F.sum(value * value), F.lit(0)).alias("sum_squares"))

    def local_sizes(self) -> DataFrame:
        """partition, size: entries of each partition as the map lies."""
        return self.frame.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("size"))


def _typed(rows: DataFrame, key: str | Column, value: str | Column | None, order_by: Iterable[str | Column]) -> DataFrame:
    """key, value and ord of the rows that have a key."""
    column = lambda c: F.col(c) if isinstance(c, str) else c
    order = [column(c).alias(f"o{i}") for i, c in enumerate(order_by)]
    ord_ = column(order_by[0]) if isinstance(order_by, list) and order_by == ["ord"] else F.struct(*order) if order else F.struct(F.lit(0).alias("o0"))
    amount = F.lit(1).cast("long") if value is None else column(value)
    return rows.select(column(key).alias("key"), amount.alias("value"), ord_.alias("ord")).where("key IS NOT NULL")


def is_new(rows: DataFrame, held: KeyedMap, order_by: Iterable[str] = ()) -> DataFrame:
    """Rows (column key) with ``is_new``: whether inserting them in order would add the key.

    Only the first row of a key that isn't held is new: the least by ``order_by``
    and then by all columns.  Rows that are equal in every column are one
    insertion after another, of which one is new.
    """
    known = held.keys().withColumn("known", F.lit(True))
    columns = [*order_by, *[c for c in rows.columns if c not in order_by]]
    place = F.struct(*columns)
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("times_"))
    first = rows.groupBy("key").agg(F.min(place).alias("first_"))
    met = counted.join(first, "key", "left").join(known, "key", "left")
    fresh = F.col("known").isNull() & place.eqNullSafe(F.col("first_"))
    return met.select(*rows.columns, fresh.alias("fresh_"), F.explode(F.sequence(F.lit(1), F.col("times_"))).alias("copy_")).select(*rows.columns, (F.col("fresh_") & (F.col("copy_") == 1)).alias("is_new"))
