"""Generated keys, pairs and query sets, the same for the same seed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions.alphabets import DNA, Alphabet


def _draw(seed: int, *columns: Column) -> Column:
    """A pseudo-random non-negative long that depends on the columns alone."""
    return F.xxhash64(F.lit(seed), *columns).bitwiseAND(F.lit((1 << 62) - 1))


def unique_keys(spark: SparkSession, count: int, seed: int = 23) -> DataFrame:
    """key: ``count`` different pseudo-random longs, multiples modulo a prime."""
    prime, factor = (1 << 61) - 1, 11400714819323197
    n = F.col("id").cast("decimal(19,0)") + F.lit(seed)
    return spark.range(count).select((n * F.lit(factor) % F.lit(prime)).cast("long").alias("key"))


def repeated_pairs(spark: SparkSession, uniques: int, repeats: float, seed: int = 23) -> DataFrame:
    """key, value: each of ``uniques`` keys 1 to 2 * ``repeats`` times, value a running number."""
    times = 1 + _draw(seed, F.col("id")) % F.lit(max(1, int(2 * repeats)))
    rows = spark.range(uniques).select((_draw(seed + 1, F.col("id"))).alias("key"), F.explode(F.sequence(F.lit(1), times)).alias("copy"))
    return rows.select("key", F.monotonically_increasing_id().alias("value"))


def random_kmers(spark: SparkSession, count: int, k: int, repeats: int = 10, alphabet: Alphabet = DNA, canonical: bool = False, seed: int = 23) -> DataFrame:
    """kmer, idx: random words, each up to ``repeats`` times."""
    n = len(alphabet.symbols)
    letters = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.substring(F.lit(alphabet.symbols), (_draw(seed, F.col("id"), i) % n + 1).cast("int"), F.lit(1)))
    word = F.array_join(letters, "")
    times = 1 + _draw(seed + 1, F.col("id")) % F.lit(max(1, repeats))
    rows = spark.range(count).select(word.alias("kmer"), F.explode(F.sequence(F.lit(1), times)).alias("copy"))
    key = alphabet.canonical(F.col("kmer")) if canonical else F.col("kmer")
    return rows.select(key.alias("kmer"), F.monotonically_increasing_id().alias("idx"))


def query_mix(present: DataFrame, absent: DataFrame, missing: float, hashes: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """key: a share ``missing`` of absent keys and else present ones, by key hash."""
    take = int(round(1000 * missing))
    place = F.pmod(hashes(F.col("key")), F.lit(1000))
    return present.select("key").where(place >= take).unionAll(absent.select("key").where(place < take))


def hash_sample(rows: DataFrame, key: str, ratio: int, hashes: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """Rows of one in ``ratio`` keys, the same keys each time."""
    return rows.where(F.pmod(hashes(F.col(key)), F.lit(ratio)) == 0)
