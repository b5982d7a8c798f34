"""Placing rows: hash buckets, range order, splitters and ranks."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.plans.storage import stable


def bucket(key: Column, buckets: int) -> Column:
    """The bucket that a key is placed in."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def distribute(rows: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """Rows with equal keys in one partition."""
    return rows.repartition(key) if parts is None else rows.repartition(parts, key)


def rebalance(rows: DataFrame, parts: int) -> DataFrame:
    """Rows dealt evenly, whatever their keys."""
    return rows.repartition(parts)


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt over all cores if they lie in fewer partitions; else as they are.

    Only a table of few files is moved; the count is read off the plan.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rebalance(rows, cores)


def bucket_sizes(rows: DataFrame, key: Column, buckets: int, hashes: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """bucket, size: rows of each destination of a hash placement."""
    return rows.groupBy(F.pmod(hashes(key), F.lit(buckets)).cast("int").alias("bucket")).agg(F.count("*").alias("size"))


def scatter_compute_gather(rows: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame], qid: str = "qid") -> DataFrame:
    """``compute`` over rows placed by key, results in the order of ``qid``.

    ``compute`` must keep qid; rows carry it, so nothing relies on position.
    """
    return compute(distribute(rows, key)).orderBy(qid)


def undistribute(rows: DataFrame, before: DataFrame, qid: str = "qid") -> DataFrame:
    """Rows back beside those they were made of: each row of ``before`` with its result.

    The inverse of a placement by key: rows meet by ``qid``, whatever partition they
    were computed in; a row of ``before`` without a result stays, with nulls.
    """
    return before.join(rows, qid, "left")


def local_sort(rows: DataFrame, order: Iterable[str]) -> DataFrame:
    return rows.sortWithinPartitions(*order)


def range_sort(rows: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """A global sort: ranges from sampled splitters, each sorted where it lies."""
    placed = rows.repartitionByRange(*order) if parts is None else rows.repartitionByRange(parts, *order)
    return placed.sortWithinPartitions(*order)


def global_rank(rows: DataFrame, order: list[str], rank: str = "rank", parts: int | None = None) -> DataFrame:
    """``rows`` with their place from 1 in the global order, without one big task.

    Rows are sorted in ranges; a row's rank is its place in its range after the
    sizes of the ranges before, of which there is one row a partition.
    """
    position = F.monotonically_increasing_id()
    sorted_ = stable(range_sort(rows, order, parts).withColumn("part_", F.shiftright(position, 33)).withColumn("at_", position.bitwiseAND(F.lit((1 << 33) - 1))))
    starts = _starts(sorted_.groupBy("part_").agg(F.count("*").alias("n"))).select("part_", "before_")
    return sorted_.join(F.broadcast(starts), "part_").withColumn(rank, F.col("before_") + F.col("at_") + 1).drop("part_", "at_", "before_")


def _starts(sizes: DataFrame) -> DataFrame:
    """part_, n with before_, the sum of n over the parts before, and total; a row a partition."""
    earlier = Window.partitionBy(F.lit(0)).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("part_", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before_"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("total"))


def splitters(rows: DataFrame, key: str, parts: int) -> DataFrame:
    """split, value: the key that ends each of ``parts`` - 1 equal shares of the rows.

    Shares are cut by the counts of distinct keys, so a key is never cut in two;
    ties and hot keys give equal splitters.
    """
    counts = rows.groupBy(F.col(key).alias("value")).agg(F.count("*").alias("n"))
    ranked = stable(range_sort(counts, ["value"]).withColumn("part_", F.spark_partition_id()))
    starts = _starts(ranked.groupBy("part_").agg(F.sum("n").alias("n"))).drop("n")
    upto = ranked.join(F.broadcast(starts), "part_").selectExpr("value", "n", "total", "before_ + sum(n) OVER (PARTITION BY part_ ORDER BY value) AS upto_")
    # The shares that end within a key's rows: split s ends at row ceil(total * s / parts).
    reached = lambda row: F.least(F.floor(row * parts / F.col("total")), F.lit(parts - 1))
    first, last = reached(F.col("upto_") - F.col("n")) + 1, reached(F.col("upto_"))
    return upto.where(first <= last).select(F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("split"), "value")


def stable_split(rows: DataFrame, key: str, cuts: list[object]) -> DataFrame:
    """``rows`` with ``part``: the number of splitters below the key; equal splitters raise."""
    if any(not a < b for a, b in zip(cuts, cuts[1:], strict=False)):
        raise ValueError("splitters must rise")
    part = sum((F.when(F.col(key) > F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))
    return rows.withColumn("part", part)
