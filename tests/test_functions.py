"""Hashes, sketches, integers and movement."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.functions import hashing, numbers, sketch
from keyloom.operators import movement
from keyloom.operators.multimap import aux_filter, aux_filter_by


def one(function, key, *seed):
    return int(hashing.by_length([key], lambda rows: function(rows, *seed))[0])


def test_published_hashes():
    assert one(hashing.murmur3_32, b"", 0) == 0
    assert one(hashing.murmur3_32, b"", 1) == 0x514E28B7
    assert one(hashing.murmur3_32, b"hello", 0) == 0x248BFA47
    assert one(hashing.murmur3_32, b"hello, world", 0) == 0x149BBB7F
    assert one(hashing.murmur3_64, b"hello", 0) == 0xCBD8A7B341BD9B02
    assert one(hashing.crc32c, b"123456789") == 0xE3069283


def test_whole_hashes_have_their_published_check_value():
    """Hashes of 0, 0 1, ... with seeds that fall from 256, hashed again."""
    for words, wanted in ((lambda k, s: hashing.murmur3_32(k, s).astype("<u4"), 0xB0F57EE3), (hashing.murmur3_x86_words, 0xB3ECE62A), (hashing.murmur3_x64_words, 0x6384BA69)):
        every = b"".join(words(np.arange(n, dtype=np.uint8).reshape(1, n), 256 - n).tobytes() for n in range(256))
        last = words(np.frombuffer(every, np.uint8).reshape(1, -1), 0).tobytes()
        assert int.from_bytes(last[:4], "little") == wanted


def test_columns_agree(spark):
    words = ["", "a", "abcd", "ACGTACGTACGTACGTACG", None]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = df.select(hashing.hashed(F.col("w"), hashing.murmur3_64), hashing.hashed(F.col("w"), hashing.crc32c)).collect()
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    assert [tuple(r) for r in got] == [(None, None) if w is None else (signed(one(hashing.murmur3_64, w.encode())), one(hashing.crc32c, w.encode())) for w in words]
    four = spark.createDataFrame([("abcd",)], "w string").select(hashing.fast32(F.col("w"))).first()[0]
    assert four & 0xFFFFFFFF == one(hashing.murmur3_32, b"abcd", 42)
    values = [0, 1, 0xFFFFFFFF, 0x12345678]
    ends = spark.createDataFrame([(v,) for v in values], "v long").select(hashing.finalizer32(F.col("v"))).collect()

    def plain(h):
        h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
        h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
        return h ^ h >> 16

    assert [r[0] for r in ends] == [plain(v) for v in values]
    assert spark.range(3).select(hashing.identity(F.col("id"))).count() == 3


@pytest.mark.parametrize("precision", [6, 10, 12, 14])
def test_sketch_error_and_merge(spark, precision):
    df = spark.range(100_000).selectExpr("id % 40000 AS v", "id % 7 AS g")
    parts = df.groupBy("g").agg(sketch.sketch(F.col("v"), precision).alias("s"))
    whole = df.agg(sketch.estimate(sketch.sketch(F.col("v"), precision))).first()[0]
    union = parts.agg(sketch.estimate(sketch.merged(F.col("s")))).first()[0]
    assert abs(whole - 40_000) < 40_000 * 3 * sketch.target_error(precision)
    assert abs(union - whole) <= whole * 0.05
    again = df.agg(sketch.estimate(sketch.sketch_of_hashes(F.xxhash64("v"), precision))).first()[0]
    assert again == whole
    assert sketch.estimates_by_partition(df, F.col("v")).count() >= 1


def test_integers(spark):
    r = random.Random(5)
    rows = [(0, 0), (0, 5), (1, 1), (2**40, 6), *[(r.randrange(2**40), r.randrange(2**20)) for _ in range(50)]]
    df = spark.createDataFrame(rows, "a long, b long")
    got = df.select("a", "b", numbers.gcd(F.col("a"), F.col("b")), numbers.lcm(F.col("a"), F.col("b")), numbers.next_power_of_2(F.col("a")), numbers.leftmost_set_bit(F.col("a"))).collect()
    for a, b, g, m, p, bit in got:
        assert (g, m, bit) == (math.gcd(a, b), math.lcm(a, b), a.bit_length())
        assert p == (1 if a <= 1 else 1 << (a - 1).bit_length())


def test_movement(spark):
    df = spark.range(1000).selectExpr("id % 10 AS k", "id AS qid", "(id * 7919) % 1000 AS v")
    ranked = movement.global_rank(df, ["v"], parts=5)
    assert [r.rank for r in ranked.orderBy("v").collect()] == list(range(1, 1001))
    assert movement.global_rank(df.limit(0), ["v"]).isEmpty()
    cuts = [r.value for r in movement.splitters(df, "v", 4).orderBy("split").collect()]
    assert cuts == [249, 499, 749]
    hot = spark.range(100).selectExpr("least(id, 10) AS v")
    assert [r.value for r in movement.splitters(hot, "v", 4).orderBy("split").collect()] == [10, 10, 10]
    assert [r.part for r in movement.stable_split(df.where("qid < 3"), "qid", [0, 1]).orderBy("qid").collect()] == [0, 1, 2]
    back = movement.scatter_compute_gather(df, "k", lambda d: d.select("qid", (F.col("v") + 1).alias("w"))).collect()
    assert [r.qid for r in back] == list(range(1000))
    assert movement.bucket_sizes(df, F.col("qid"), 8).agg(F.sum("size")).first()[0] == 1000
    one = movement.distribute(df, "k", 5).select("k", F.spark_partition_id().alias("p")).distinct()
    assert one.groupBy("k").count().where("count > 1").isEmpty()
    assert movement.spread(df.coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = df.repartition(50)
    assert movement.spread(many) is many
    assert movement.rebalance(df, 3).rdd.getNumPartitions() == 3
    local = movement.local_sort(df.repartition(2), ["v"]).select(F.spark_partition_id().alias("p"), "v").collect()
    for p in {r.p for r in local}:
        mine = [r.v for r in local if r.p == p]
        assert mine == sorted(mine)


def test_aux_filter(spark):
    df = spark.range(10_000).selectExpr("id + 23 AS base", "id AS aux")
    assert [r.base for r in aux_filter(df, F.col("aux") % 2 == 0).collect()] == list(range(23, 10_023, 2))


@pytest.mark.parametrize("precision", [4, 6, 10, 12, 14])
@pytest.mark.parametrize("ignored", [0, 4])
def test_registers_estimate_and_merge(spark, precision, ignored):
    df = spark.range(60_000).selectExpr("id % 20000 AS v", "id % 7 AS g")
    hashes = hashing.portable60(F.col("v"))
    parts = sketch.registers(df, hashes, ["g"], precision, ignored)
    whole = sketch.register_estimate(sketch.registers(df, hashes, None, precision, ignored), None, precision).first()[0]
    union = sketch.register_estimate(sketch.merged_registers(parts), None, precision).first()[0]
    assert union == whole
    assert abs(whole - 20_000) < 20_000 * 3 * sketch.target_error(precision)
    few = sketch.registers(spark.range(10).select(F.col("id").alias("v")), hashes, None, precision, ignored)
    assert abs(sketch.register_estimate(few, None, precision).first()[0] - 10) < 6
    assert sketch.register_estimate(sketch.registers(df.limit(0), hashes)).first()[0] == 0.0


def test_equal_splitters_raise(spark):
    with pytest.raises(ValueError):
        movement.stable_split(spark.range(3), "id", [1, 1])


def test_aux_filter_of_two_sequences(spark):
    base = spark.range(10_000).selectExpr("id AS i", "id + 23 AS base")
    aux = spark.range(10_000).selectExpr("id AS i", "id AS aux")
    assert [r.base for r in aux_filter_by(base, aux, F.col("aux") % 2 == 1).orderBy("i").collect()] == list(range(24, 10_023, 2))


@pytest.mark.parametrize("parts", [1, 3, 8, 40])
def test_splitters_of_hot_and_few_keys(spark, parts):
    values = [1] * 50 + [2] * 3 + list(range(3, 30))
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(5)
    got = {r.split: r.value for r in movement.splitters(df, "v", parts).collect()}
    assert got == {s: sorted(values)[-(-len(values) * s // parts) - 1] for s in range(1, parts)}
