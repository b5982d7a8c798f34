"""Maps of many values a key: position indexes and equal ranges."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Multimap:
    """Rows with a column key; every row is kept."""

    frame: DataFrame

    def insert(self, rows: DataFrame) -> Multimap:
        return Multimap(self.frame.unionByName(rows))

    def equal_range(self, queries: DataFrame) -> DataFrame:
        """Every query row (column key) with each row of its key."""
        return queries.join(self.frame, "key")

    def count(self, queries: DataFrame) -> DataFrame:
        """Every query row with ``n``, the rows of its key (0 if none)."""
        sizes = self.frame.groupBy("key").agg(F.count("*").alias("n"))
        return queries.join(sizes, "key", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))

    def erase(self, keys: DataFrame) -> Multimap:
        return Multimap(self.frame.join(keys.select("key"), "key", "left_anti"))

    def listed(self, order_by: Iterable[str]) -> DataFrame:
        """key and values, the other columns as an ordered array; for keys of few rows."""
        others = [c for c in self.frame.columns if c != "key"]
        order = [*order_by, *[c for c in others if c not in order_by]]
        return self.frame.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(*order))).alias("values"))

    def multiplicity(self) -> DataFrame:
        """One row: rows, keys and their ratio (null without keys)."""
        counted = self.frame.groupBy("key").agg(F.count("*").alias("n"))
        return counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("keys")).select("rows", "keys", F.expr("try_divide(rows, keys)").alias("multiplicity"))


def aux_filter(rows: DataFrame, kept: Column) -> DataFrame:
    """Rows whose companion column satisfies a predicate."""
    return rows.where(kept)


def aux_filter_by(rows: DataFrame, companions: DataFrame, kept: Column, on: str = "i") -> DataFrame:
    """Rows whose companion, the row of the same place ``on`` in a second sequence, satisfies a predicate.

    Rows without a companion are left out, as the shorter sequence ends the walk.
    """
    return rows.join(companions.where(kept).select(on), on, "left_semi")
