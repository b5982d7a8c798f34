"""Approximate distinct counts with mergeable sketches.

Two forms: Spark's own sketch as one binary value, and registers as rows, whose
estimate is the harmonic mean with linear counting where registers are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRECISION = 12


def target_error(precision: int = PRECISION) -> float:
    """The relative standard error aimed at with 2 ** precision registers."""
    return 1.04 / 2 ** (precision / 2)


def sketch(key: Column, precision: int = PRECISION) -> Column:
    """Aggregate: the sketch of the keys, by their 64-bit hashes."""
    return F.hll_sketch_agg(F.xxhash64(key), F.lit(precision))


def sketch_of_hashes(hashes: Column, precision: int = PRECISION) -> Column:
    """Aggregate: the sketch of keys that are hashed already."""
    return F.hll_sketch_agg(hashes, F.lit(precision))


def merged(sketches: Column) -> Column:
    """Aggregate: the sketch of the union."""
    return F.hll_union_agg(sketches)


def estimate(sketches: Column) -> Column:
    """The number of distinct keys in each sketch."""
    return F.hll_sketch_estimate(sketches)


def estimates_by_bucket(df: DataFrame, key: Column, buckets: int, precision: int = PRECISION) -> DataFrame:
    """bucket, estimate: distinct keys of each destination of a hash placement."""
    return df.groupBy(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket")).agg(estimate(sketch(key, precision)).alias("estimate"))


def estimates_by_partition(df: DataFrame, key: Column, precision: int = PRECISION) -> DataFrame:
    """partition, estimate: distinct keys of each partition as it lies."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(estimate(sketch(key, precision)).alias("estimate"))


#: Bits of the hashes that registers are made of (see ``hashing.portable60``).
HASH_BITS = 60


def registers(rows: DataFrame, hashes: Column, by: list[str] | None = None, precision: int = PRECISION, ignored: int = 0) -> DataFrame:
    """by, register, rank: the sketch of hashes of ``HASH_BITS`` bits.

    ``ignored`` leading bits are left out (they may have placed the rows); the next
    ``precision`` bits name the register, and rank is the place of the first set
    bit among the rest, from 1.  Null hashes are left out.
    """
    by, rest = by or [], HASH_BITS - ignored - precision
    low = F.col("hash_").bitwiseAND(F.lit((1 << rest) - 1))
    used = F.when(low == 0, F.lit(0)).otherwise(F.length(F.bin(low)))
    register = F.shiftright("hash_", rest).bitwiseAND(F.lit((1 << precision) - 1)).cast("int")
    ranked = rows.select(*by, hashes.alias("hash_")).where("hash_ IS NOT NULL").select(*by, register.alias("register"), (rest + 1 - used).cast("int").alias("rank"))
    return ranked.groupBy(*by, "register").agg(F.max("rank").alias("rank"))


def merged_registers(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The sketch of the union of sketches (register, rank), by other columns."""
    return sketches.groupBy(*(by or []), "register").agg(F.max("rank").alias("rank"))


def register_estimate(sketches: DataFrame, by: list[str] | None = None, precision: int = PRECISION) -> DataFrame:
    """by, estimate: the harmonic mean of the registers, or linear counting below 2.5 registers each."""
    m = 1 << precision
    # The estimator's bias factors.
    alpha = {4: 0.673, 5: 0.697, 6: 0.709}.get(precision, 0.7213 / (1 + 1.079 / m))
    held = sketches.groupBy(*(by or [])).agg(F.count("*").alias("held"), F.coalesce(F.sum(F.pow(F.lit(2.0), -F.col("rank"))), F.lit(0.0)).alias("sum_"))
    raw = F.lit(alpha * m * m) / (F.col("sum_") + m - F.col("held"))
    linear = F.lit(float(m)) * F.log(F.lit(float(m)) / (m - F.col("held")))
    estimate = F.when((raw <= 2.5 * m) & (F.col("held") < m), linear).otherwise(raw)
    return held.select(*(by or []), estimate.alias("estimate"))
