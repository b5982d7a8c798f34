"""Differential tests of maps against Python dictionaries, and edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from keyloom.operators.keyed_map import COUNT, FIRST, FOLD, LAST, KeyedMap, is_new
from keyloom.operators.multimap import Multimap


def pairs(n=2000, keys=300, seed=1):
    r = random.Random(seed)
    return [(i, r.randrange(2, keys), r.randrange(2, 250)) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "ord long, k long, v long")


def as_dict(held):
    rows = held.entries().collect()
    assert len({r.key for r in rows}) == len(rows)
    return {r.key: r.value for r in rows}


def gold(rows, reducer, start=None):
    out = dict(start or {})
    for _, k, v in rows:
        if k is None:
            continue
        if k not in out:
            out[k] = 1 if reducer == COUNT else v
        elif reducer == LAST:
            out[k] = v
        elif reducer == COUNT:
            out[k] += 1
        elif reducer == "sum":
            out[k] += v
        elif reducer == "max":
            out[k] = max(out[k], v)
    return out


@pytest.mark.parametrize("reducer", [FIRST, LAST, COUNT, "sum", "max"])
def test_build_and_insert(spark, reducer):
    rows = pairs()
    value = None if reducer == COUNT else "v"
    whole = KeyedMap.build(frame(spark, rows), "k", value, reducer, ["ord"])
    assert as_dict(whole) == gold(rows, reducer)
    half = KeyedMap.build(frame(spark, rows[:900]), "k", value, reducer, ["ord"])
    assert as_dict(half.insert(frame(spark, rows[900:]), "k", value, ["ord"])) == gold(rows, reducer)


def test_fold_goes_on(spark):
    fold = lambda a, v: (a * 3 + v) % 1009
    rows = pairs(400, 30)
    half = KeyedMap.build(frame(spark, rows[:200]), "k", "v", FOLD, ["ord"], fold=fold)
    out = {}
    for _, k, v in rows:
        out[k] = fold(out.get(k, 0), v)
    assert as_dict(half.insert(frame(spark, rows[200:]), "k", "v", ["ord"])) == out


def test_hot_key_null_key_and_zero(spark):
    rows = [(i, 7, i % 5) for i in range(3000)] + [(3000, None, 1), (3001, 8, 0)]
    held = KeyedMap.build(frame(spark, rows), "k", "v", LAST, ["ord"])
    assert as_dict(held) == {7: 2999 % 5, 8: 0}
    asked = spark.createDataFrame([(1, 8), (2, 9), (3, 8), (4, None)], "qid long, key long")
    found = {r.qid: r.value for r in held.find(asked, -5).collect()}
    assert found == {1: 0, 2: -5, 3: 0, 4: -5}
    assert sorted(r.qid for r in held.find_existing(asked).collect()) == [1, 3]
    assert held.find_existing(asked, distinct=True).count() == 1
    assert {r.qid: r.found for r in held.exists(asked).collect()} == {1: 1, 2: 0, 3: 1, 4: 0}


def test_predicates(spark):
    held = KeyedMap.build(frame(spark, pairs()), "k", "v", "sum")
    entries = as_dict(held)
    asked = spark.createDataFrame([(k,) for k in range(320)], "key long")
    found = {r.key: r.value for r in held.find(asked, 0, in_pred=lambda k: k % 2 == 0, out_pred=lambda e: e["value"] > 500).collect()}
    assert found == {k: entries[k] if k % 2 == 0 and entries.get(k, 0) > 500 else 0 for k in range(320)}
    assert {r.key for r in held.find_where(lambda e: e["value"] > 500).collect()} == {k for k, v in entries.items() if v > 500}


def test_erase_update_upsert(spark):
    rows = pairs()
    held = KeyedMap.build(frame(spark, rows), "k", "v", "sum")
    entries = as_dict(held)
    gone = spark.createDataFrame([(k,) for k in range(0, 400, 3)], "key long")
    left = held.erase(gone)
    assert as_dict(left) == {k: v for k, v in entries.items() if k % 3}
    assert left.exists(gone).where("found = 1").isEmpty()
    assert as_dict(held.erase(gone.limit(0))) == entries
    assert held.erase(held.keys()).empty()
    new = spark.createDataFrame([(5, 1), (5, 2), (10_000, 4)], "key long, value long")
    assert as_dict(held.update(new)) == {**entries, 5: entries[5] + 3}
    assert as_dict(held.upsert(new)) == {**entries, 5: 3, 10_000: 4}
    assert as_dict(held.upsert(new, F.greatest)) == {**entries, 5: max(3, entries[5]), 10_000: 4}
    first = KeyedMap.build(frame(spark, rows), "k", "v", FIRST, ["ord"])
    assert as_dict(first.update(new)) == as_dict(first)
    assert as_dict(held.erase_where(lambda e: e["value"] % 2 == 0)) == {k: v for k, v in entries.items() if v % 2}
    assert held.clear().size() == 0


def test_facts_and_batches(spark):
    rows = pairs()
    held = KeyedMap.build(frame(spark, []), "k", "v", COUNT)
    assert held.empty() and held.facts().first() == (0, 0, 0)
    batches = [frame(spark, rows[i : i + 500]) for i in range(0, 2000, 500)]
    counted = KeyedMap.build(frame(spark, []), "k", None, COUNT).insert_all(batches, "k")
    entries = as_dict(counted)
    assert entries == gold(rows, COUNT)
    assert counted.facts().first() == (len(entries), 2000, sum(v * v for v in entries.values()))
    assert counted.local_sizes().agg(F.sum("size")).first()[0] == len(entries)
    new = spark.createDataFrame([(5,), (99_999,)], "key long")
    assert {r.key: r.is_new for r in is_new(new, counted).collect()} == {5: False, 99_999: True}


def test_new_keys_within_a_batch(spark):
    held = KeyedMap.build(frame(spark, [(0, 1, 1)]), "k", "v", COUNT)
    batch = spark.createDataFrame([(1, 5), (2, 3), (2, 1), (2, 1), (None, 1)], "key long, at long")
    got = sorted(((r.key or 0), r.at, r.is_new) for r in is_new(batch, held, ["at"]).collect())
    assert [x for x in got if x[0]] == [(1, 5, False), (2, 1, False), (2, 1, True), (2, 3, False)] and len(got) == 5


def test_predicates_and_counts(spark):
    held = KeyedMap.build(frame(spark, pairs()), "k", "v", COUNT)
    entries = as_dict(held)
    keys = sorted(entries)[:10]
    asked = spark.createDataFrame([(k,) for k in [*keys, *keys, -1]], "key long")
    even, big = (lambda k: k % 2 == 0), (lambda e: e["value"] > 100)
    doomed = {k for k in keys if k % 2 == 0 and entries[k] > 100}
    assert as_dict(held.erase(asked, even, big)) == {k: v for k, v in entries.items() if k not in doomed}
    assert held.erased(asked, even, big).first()[0] == len(doomed)
    assert held.erased(asked).first()[0] == len(keys)
    assert held.hits(asked).first() == (21, 20)
    assert {r.key: r.found for r in held.exists_where(big).collect()} == {k: int(v > 100) for k, v in entries.items()}
    assert {r.key: r.found for r in held.exists(asked, out_pred=big, miss=9).collect()} == {**{k: 1 if entries[k] > 100 else 9 for k in keys}, -1: 9}
    seen = held.query(asked, lambda k, v, hit: F.when(hit, v).otherwise(k))
    assert {r.key: r.result for r in seen.collect()} == {**{k: entries[k] for k in keys}, -1: -1}


def test_unknown_reducer(spark):
    with pytest.raises(ValueError):
        KeyedMap.build(frame(spark, []), "k", "v", "median")


def test_multimap(spark):
    held = Multimap(frame(spark, pairs()).withColumnRenamed("k", "key"))
    asked = spark.createDataFrame([(5,), (5,), (-1,)], "key long")
    n = sum(k == 5 for _, k, _ in pairs())
    assert held.equal_range(asked).count() == 2 * n
    assert sorted(r.n for r in held.count(asked).collect()) == [0, n, n]
    assert held.erase(asked).equal_range(asked).isEmpty()
    listed = {r.key: [x.ord for x in r["values"]] for r in held.listed(["ord"]).collect()}
    assert listed[5] == [i for i, k, _ in pairs() if k == 5]
