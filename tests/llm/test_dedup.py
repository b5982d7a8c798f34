"""Exact, SimHash, line and passage dedup against brute force and SQL."""

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
import xxhash
from conftest import rows_of, sql_rows
from pyspark.sql import functions as F

from keyloom.llm import compact_windows as compact_windows_module
from keyloom.llm import components, queries, simhash_dedup
from keyloom.llm.compact_windows import agreed, common, compact_windows, linked, passages, repeated_passages, surroundings
from keyloom.llm.exact_dedup import DIGEST, exact_dedup, merge_round, rounds_for
from keyloom.llm.fingerprint import majority_bits, resemblance, shingle_hashes
from keyloom.llm.line_dedup import line_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (5, "One two  three\tfour five", "en", "a", 24),
    (3, "One two three\nfour five", "en", "a", 23),
    (3, "One two three\nfour five", "en", "a", 23),
    (None, "One two three four five", None, None, None),
    (None, None, None, None, None),
    (7, "", "en", "b", 0),
    (8, " \t\n", "en", "b", 3),
    (9, "ß Éa ﻿x", "de", "b", 7),
    (10, "word " * 20_000, "en", "c", 100_000),
]


def odd(spark):
    """Nulls everywhere, empty and long texts, repeated rows, columns named like results."""
    df = spark.createDataFrame(ODD, SCHEMA)
    for name in ("keep_id", "fingerprint", "component_id", "row", "run", "fp", "node", "key", "host", "lines", "page", "bad", "rid", "tokens", "n_lines", "kept"):
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(name, spark, sf_dir, views):
    assert rows_of(queries.QUERIES[name](spark, sf_dir)) == sql_rows(queries.SQL[name], views)


def test_exact_odd_rows(spark):
    got = exact_dedup(odd(spark)).collect()
    assert len(got) == len(ODD)
    normal = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for r in got:
        same = [x for x in ODD if hashlib.sha256(normal(x[1]).encode()).hexdigest() == r.text_sha256]
        ids = [x[0] for x in same if x[0] is not None]
        assert r.group_size == len(same) and r.keep_id == (min(ids) if ids else None)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in kept)
    assert exact_dedup(odd(spark).limit(0)).isEmpty()


def test_exact_many_runs(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "concat('t', id % 17) AS text").repartition(40)
    got = exact_dedup(df).groupBy("keep_id").agg(F.max("group_size").alias("n"), F.sum(F.col("kept").cast("int")).alias("kept")).collect()
    assert sorted(r.keep_id for r in got) == list(range(17))
    assert all(r.kept == 1 and r.n in (176, 177) for r in got)


def test_exact_more_runs_than_two_rounds_merge(spark):
    """Over 4,096 runs: a fourth round, and no merge of more than FAN_IN rows of a digest."""
    runs = 5000
    rows = spark.range(2 * runs).select(*[F.lit(x).alias(c) for c, x in zip(DIGEST, (b"s", 1, 2), strict=True)], (F.col("id") % runs).cast("int").alias("run"), F.struct(F.lit(False).alias("no_id"), F.col("id").alias("doc_id"), F.col("id").alias("row")).alias("first"), F.lit(1).cast("long").alias("n"))
    assert [rounds_for(n) for n in (1, 16, 17, 256, 4096, 4097, runs)] == [1, 1, 2, 2, 3, 4, 4]
    for k in range(rounds_for(runs)):
        merged = merge_round(rows)
        assert "SortAggregate" in merged._jdf.queryExecution().executedPlan().toString()
        left = merged.count()
        assert left == -(-runs // 16 ** (k + 1))
        rows = spark.createDataFrame(merged.collect(), merged.schema)
    (one,) = rows.collect()
    assert (one.n, one['first'].doc_id, one.run) == (2 * runs, 0, 0)


def slow_fingerprint(text, size):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    values = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def slow_components(prints, radius):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(prints)), 2):
        if bin(prints[i] ^ prints[j]).count("1") <= radius:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_simhash_query_equals_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    prints = [slow_fingerprint(t, 4) for _, t in docs]
    roots = slow_components(prints, 4)
    least = {}
    for (d, _), r in zip(docs, roots, strict=True):
        least[r] = min(d, least.get(r, d))
    wanted = sorted((d, f"{p:016x}", least[r]) for (d, _), p, r in zip(docs, prints, roots, strict=True))
    got = sorted(tuple(r) for r in queries.op1_simhash(spark, sf_dir).select("doc_id", "fingerprint", "component_id").collect())
    assert got == wanted


def test_simhash_odd_rows(spark):
    got = simhash_dedup.simhash_dedup(odd(spark), size=4).collect()
    assert len(got) == len(ODD)
    by_print = {}
    for r in got:
        by_print.setdefault(r.fingerprint, set()).add(r.component_id)
    assert all(len(v) == 1 for v in by_print.values())
    assert by_print["0" * 16] == {7}
    assert simhash_dedup.simhash_dedup(odd(spark).limit(0)).isEmpty()
    only_null = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")
    assert [r.component_id for r in simhash_dedup.simhash_dedup(only_null).collect()] == [None, None]


@pytest.mark.parametrize("count", [5, 300, 40_000, 10**7, 10**10])
def test_blocks_lose_no_link(count):
    blocks = simhash_dedup.blocks_for(count, 4)
    masks = simhash_dedup.block_masks(blocks, 4)
    r = random.Random(count)
    for _ in range(300):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), 4):
            b ^= 1 << bit
        assert any(a & m == b & m for m in masks)


def test_chunks_of_a_large_place_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "CHUNK", 8)
    r = random.Random(2)
    base = r.getrandbits(64)
    prints = {base}
    while len(prints) < 120:
        x = r.choice(sorted(prints))
        for bit in r.sample(range(64), r.randrange(1, 7)):
            x ^= 1 << bit
        prints.add(x)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash_dedup.links(spark.createDataFrame([(p,) for p in signed], "fp long"), 4)
    pairs = simhash_dedup.pruning(edges).first()
    assert pairs.compared >= pairs.verified > 0
    found = {r.node: r.root for r in components.components(edges).collect()}
    roots = slow_components(prints, 4)
    groups = {}
    for s, root in zip(signed, roots, strict=True):
        groups.setdefault(root, set()).add(found.get(s, s))
    assert all(len(v) == 1 for v in groups.values())
    assert len({next(iter(v)) for v in groups.values()}) == len(groups)


def test_components(spark):
    r = random.Random(4)
    nodes = list(range(400))
    chain = [(i, i + 1) for i in range(0, 99)]
    edges = chain + [(r.choice(nodes[150:]), r.choice(nodes[150:])) for _ in range(180)] + [(3, 3), (None, 4)]
    got = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {n: n for n in nodes}
    for _ in range(400):
        for a, b in edges:
            if a is not None:
                root[a] = root[b] = min(root[a], root[b])
    touched = {n for a, b in edges if a is not None and a != b for n in (a, b)}
    assert got == {n: root[n] for n in touched}
    assert components.components(spark.createDataFrame([], "u long, v long")).isEmpty()


def test_majority_bits_of_long_and_tied_inputs():
    r = np.random.default_rng(1)
    sets = [r.integers(0, 2**64, n, np.uint64) for n in (0, 1, 2, 254, 255, 256, 1500)]
    wanted = [sum(1 << b for b in range(64) if 2 * int(((s >> np.uint64(b)) & np.uint64(1)).sum()) > len(s)) for s in sets]
    assert majority_bits(sets).tolist() == wanted


def words(r, n):
    return ["w" + "".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n)]


def jaccard(a, b):
    a, b = set(a.tolist()), set(b.tolist())
    return len(a & b) / len(a | b)


def test_resemblance_is_the_similarity():
    r = random.Random(8)
    for n in (0, 3, 20, 600):
        a = words(r, n)
        b = [w if r.random() > 0.05 else "zz" for w in a]
        x, y = (np.unique(shingle_hashes(" ".join(t), 5)) for t in (a, b))
        assert resemblance(x, y) == pytest.approx(jaccard(x, y) if n else 1.0)
    assert resemblance(np.empty(0, np.uint64), x) == 0.0


def test_pivots_discard_most_pairs_and_no_link():
    r = np.random.default_rng(5)
    fps = r.integers(0, 2**64, 3000, np.uint64)
    fps[1500:] = fps[:1500] ^ (np.uint64(1) << r.integers(0, 64, 1500).astype(np.uint64))
    table = sum(np.bitwise_count(fps ^ p).astype(np.int64) << (8 * k) for k, p in enumerate(simhash_dedup.pivots()))
    place = simhash_dedup.Place(fps.view(np.int64), table, 4)
    u, v = place.links(np.zeros(len(fps), np.int64))
    left, right = components.stars(u, v)
    assert set(zip(left.tolist(), right.tolist(), strict=True)) == {(i + 1500, i) for i in range(1500)}
    assert place.verified < 0.06 * place.compared


def test_a_large_group_of_copies_takes_few_comparisons():
    """100,000 fingerprints around one: neither all pairs nor memory for them."""
    r = np.random.default_rng(6)
    fps = np.full(100_000, 0x123456789ABCDEF0, np.uint64)
    for _ in range(5):
        fps ^= np.uint64(1) << r.integers(0, 64, len(fps)).astype(np.uint64)
    fps = np.unique(fps)
    table = sum(np.bitwise_count(fps ^ p).astype(np.int64) << (8 * k) for k, p in enumerate(simhash_dedup.pivots()))
    place = simhash_dedup.Place(fps.view(np.int64), table, 4)
    u, v = place.links(np.zeros(len(fps), np.int64))
    assert len(u) <= len(fps) - 1 and len(u) > 0.9 * len(fps)
    assert place.compared < 0.05 * len(fps) ** 2


def test_one_of_each(spark):
    r = random.Random(6)
    base = words(r, 300)
    near = list(base)
    near[150] = "changed"
    far = [w if i % 12 else "other" for i, w in enumerate(base)]
    texts = [base, near, far, words(r, 300)]
    rows = [(i + 1, " ".join(t)) for i, t in enumerate(texts)] + [(2, " ".join(near)), (None, " ".join(base)), (6, None), (7, ""), (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("component_id", "a", "own", "fp", "node", "kid", "place", "first", "times"):
        df = df.withColumn(name, F.lit(1))
    got = simhash_dedup.one_of_each(df)
    assert got.columns == df.columns
    assert sorted((x.doc_id or 0, x.text or "") for x in got.collect()) == sorted([(1, " ".join(base)), (3, " ".join(far)), (4, rows[3][1]), (6, "")])
    assert simhash_dedup.one_of_each(df.limit(0)).isEmpty()


def test_one_of_each_tells_rows_of_one_id_apart(spark):
    r = random.Random(9)
    a, b = " ".join(words(r, 60)), " ".join(words(r, 60))
    df = spark.createDataFrame([(1, a), (5, a), (5, b), (None, b), (None, a + " x")], "doc_id long, text string")
    assert sorted(tuple(x) for x in simhash_dedup.one_of_each(df).collect()) == sorted([(1, a), (5, b)])


@pytest.mark.parametrize("chunk", [None, 3])
def test_near_copies_by_brute_force(spark, sf_dir, monkeypatch, chunk):
    """Groups are the components of pairs near in both the fingerprint and the shingles."""
    if chunk:
        monkeypatch.setattr(simhash_dedup, "CHUNK", chunk)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    r = random.Random(3)
    texts = [x.text for x in docs[:120]]
    for t in texts[:30]:
        for share in (0.005, 0.01, 0.02):
            texts.append(" ".join(w if r.random() > share else "edited" for w in t.split()))
    prints = majority_bits([np.unique(shingle_hashes(t, 1)) for t in texts])
    sets = [shingle_hashes(t, 5) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 7
    alike = missed = 0
    for i, j in combinations(range(len(texts)), 2):
        if abs(len(sets[i]) - len(sets[j])) > 0.3 * max(len(sets[i]), len(sets[j])) or not near[i, j] and not np.intersect1d(sets[i][:200], sets[j][:200]).size:
            continue
        if not len(sets[i]) or jaccard(sets[i], sets[j]) >= 0.8:
            alike += 1
            missed += not near[i, j]
            if near[i, j]:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert alike > 50 and missed <= 0.1 * alike
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {x.doc_id: x.component_id for x in simhash_dedup.simhash_dedup(df, 1, 7, True, 0.8).collect()}
    assert got == {i: find(i) for i in range(len(texts))}
    if not chunk:
        kept = sorted(x.doc_id for x in simhash_dedup.one_of_each(df).collect())
        assert kept == sorted({find(i) for i in range(len(texts))})


def test_lines_odd_rows(spark):
    rows = [(i, f"Head\nbody {i}\n\nfoot ", "h", 9) for i in range(20)] + [(50, "Head\nfoot", "h", 9), (51, None, None, None), (52, "", "h", 0), (53, "Head\nx", None, 6)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").withColumn("bad", F.lit(1)).withColumn("n_lines", F.lit(9))
    got = {(r.doc_id): r for r in line_dedup(df).collect()}
    assert line_dedup(df).count() == len(rows)
    assert got[3].text == "body 3\n" and got[3].n_dropped == 2 and got[3].n_chars == 7
    assert got[50].text == "" and got[50].n_dropped == 2 and got[50].n_chars == 0
    whole = {r.doc_id: r for r in line_dedup(df, keep_whole=True).collect()}
    assert whole[50].text == "Head\nfoot" and whole[50].n_dropped == 0 and whole[3] == got[3]
    assert got[51].text is None and got[51].n_lines == 0
    assert got[52].text == "" and got[53].text == "Head\nx"
    assert line_dedup(df.limit(0)).isEmpty()


def test_lines_join_beyond_the_bound(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    some = rows_of(line_dedup(docs, ratio=0.05, min_pages=2))
    monkeypatch.setattr("keyloom.llm.line_dedup.BROADCAST_LINES", 0)
    assert rows_of(line_dedup(docs, ratio=0.05, min_pages=2)) == some


def test_compact_windows_cover_every_subsequence_once():
    r = np.random.default_rng(3)
    for values in (r.permutation(60).astype(np.uint64), r.integers(0, 6, 60).astype(np.uint64), np.zeros(60, np.uint64)):
        for width in (1, 7, 25):
            seen = {}
            for low, c, high in compact_windows(values, width):
                assert high - low + 1 >= width
                for i in range(low, c + 1):
                    for j in range(c, high + 1):
                        assert (i, j) not in seen
                        seen[i, j] = values[c]
            for i in range(60):
                for j in range(i + width - 1, 60):
                    assert seen[i, j] == values[i : j + 1].min()


def test_windows_of_many_texts_are_cut_side_by_side(monkeypatch):
    """Texts without equal tokens, with some and that repeat themselves: the windows are those of each text on its own."""
    module, r = compact_windows_module, random.Random(31)
    texts = [None, "", " \n", "word " * 300, "a b " * 2500, " ".join(f"w{i % 4500}" for i in range(9000)), "Q" * 400 + " end"]
    for _ in range(60):
        body = words(r, r.randrange(1, 200))
        texts.append(r.choice(["  ", "\t", " É \n"]).join(body + body[: r.randrange(0, 60)] + r.choice([[], ["same"] * 70])))
    for width, size, hashes in ((46, 5, 4), (1, 5, 1), (7, 1, 2)):
        wanted = []
        for rid, text in enumerate(texts):
            tokens = shingle_hashes(text, size)
            for k in range(hashes if len(tokens) >= width else 0):
                values = module.mixed(tokens, k)
                for low, c, high in compact_windows(values, width, module.repetitive(tokens)).tolist():
                    key = np.array([int(values[c]) & 2**64 - 16 | k], np.uint64).view(np.int64)[0]
                    wanted.append((key, rid, low, c, high, surroundings(tokens, np.array([c]), width)[0]))
        rounds = []
        mixed = module.mixed
        with monkeypatch.context() as patch:
            patch.setattr(module, "mixed", lambda *x: rounds.append(x) or mixed(*x))  # noqa: B023
            got = module.windows_of(np.arange(len(texts)), texts, width, size, hashes)
        assert sorted(map(tuple, got.tolist())) == sorted(tuple(map(int, x)) for x in wanted)
        assert len(rounds) == hashes + 2


@pytest.mark.parametrize("table", [40, 1 << 17])
def test_links_of_many_pairs_are_joined_in_tables(monkeypatch, table):
    """Each link against each of its pair: those that enough hash functions bear out."""
    module, r = compact_windows_module, np.random.default_rng(32)
    monkeypatch.setattr(module, "TABLE", table)
    pairs = []
    for _ in range(40):
        n = int(r.integers(1, 30))
        c = r.integers(0, 400, n)
        tc = c + r.choice([5, 60], n) + r.integers(-6, 7, n)
        before, after = r.integers(0, 60, (2, n))
        pairs.append(np.column_stack([r.integers(0, 4, n), c - before, c, c + after, tc - before, tc, tc + after]))
    wanted = []
    for mine in pairs:
        for _, low, c, high, to_low, tc, to_high in mine.tolist():
            near = [x[0] for x in mine.tolist() if low <= x[3] and high >= x[1] and to_low <= x[6] and to_high >= x[4] and abs((c - x[2]) - (tc - x[5])) <= 8 + abs(c - x[2]) // 4]
            wanted.append(len(set(near)) >= 2)
    size = np.array([len(x) for x in pairs])
    assert module.borne_out(np.concatenate(pairs), np.cumsum(size) - size, size, 2).tolist() == wanted
    assert 0 < sum(wanted) < len(wanted)


def test_passages(spark):
    r = random.Random(11)
    shared, license_, again = words(r, 70), words(r, 20), words(r, 120)
    near = list(again)
    near[60] = "edit"
    texts = {
        1: words(r, 80) + shared + words(r, 40),
        2: shared + words(r, 90),
        3: words(r, 200) + shared,
        4: words(r, 30) + license_ + words(r, 60),
        5: words(r, 50) + license_ + words(r, 50),
        6: words(r, 25) + again + words(r, 10),
        7: words(r, 5) + near + words(r, 70),
        8: words(r, 300),
        9: ["same"] * 500,
        10: words(r, 49),
    }
    rows = [(i, " ".join(t)) for i, t in texts.items()] + [(1, " ".join(texts[1])), (None, None), (11, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rid", F.lit(0)).withColumn("key", F.lit(0))
    got = repeated_passages(df).collect()
    named = {x for r in got for x in (r.doc_id, r.other_doc_id)}
    assert named == {1, 2, 3, 6, 7}
    for x in got:
        mine, other = " ".join(texts[x.doc_id][x.start_word : x.start_word + x.n_words]), " ".join(texts[x.other_doc_id][x.other_start_word : x.other_start_word + x.other_n_words])
        assert x.n_words >= 50 and x.other_n_words >= 50
        assert jaccard(shingle_hashes(mine, 5), shingle_hashes(other, 5)) == pytest.approx(x.similarity) and x.similarity >= 0.8
    exact = [x for x in got if {x.doc_id, x.other_doc_id} <= {1, 2, 3}]
    assert all(x.n_words == 70 and x.similarity == 1.0 for x in exact) and len(exact) == 2
    assert repeated_passages(df.limit(0)).isEmpty()


def test_passage_query_finds_what_brute_force_finds(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    where = {}
    for d, t in docs.items():
        tokens = shingle_hashes(t, 5)
        if len(set(tokens.tolist())) < len(tokens) // 2:
            continue
        for i in range(len(tokens) - 45):
            where.setdefault(tokens[i : i + 46].tobytes(), set()).add(d)
    wanted = {d for ds in where.values() if len(ds) > 1 for d in ds}
    got = {x for r in queries.op7_passages(spark, sf_dir).collect() for x in (r.doc_id, r.other_doc_id)}
    assert len(wanted - got) <= 0.02 * len(wanted) and len(wanted) > 10
    assert got


def test_interval_join_and_alignment():
    links = np.array([(0, 0, 10, 60, 100, 110, 160), (1, 5, 20, 70, 105, 120, 170), (2, 500, 510, 560, 0, 4, 50)])
    assert agreed(links, 2) == [(10, 110), (20, 120)]
    a = np.arange(200, dtype=np.uint64)
    b = np.concatenate([np.arange(1000, 1030, dtype=np.uint64), a[50:150]])
    assert passages(a, b, [(90, 70), (91, 71)], 46, 0.8) == [(50, 149, 30, 129, 1.0)]
    assert passages(a, b[:60], [(70, 50)], 46, 0.8) == []


def plain_passages(a, b, anchors, width, similarity):
    """Each anchor on its own, aligned with the whole text."""
    out = []
    where = {}
    for k, v in enumerate(b.tolist()):
        where.setdefault(v, []).append(k)
    for c, tc in anchors:
        if any(i <= c <= j and k <= tc <= m for i, j, k, m, _ in out):
            continue
        place = np.full(len(a), -1)
        for h, v in enumerate(a.tolist()):
            ks = sorted(where.get(v, []), key=lambda k: (abs(k - h - tc + c), -k))
            if ks and abs(ks[0] - h - tc + c) <= min(8 + abs(h - c) // 4, len(b)):
                place[h] = ks[0]
        for least in (similarity, 1.0):
            i, j = compact_windows_module.stretch(place >= 0, c, least, width)
            hit = place[i : j + 1][place[i : j + 1] >= 0]
            if j - i + 1 < width or not len(hit) or hit.max() - hit.min() + 1 < width:
                continue
            k, m = int(hit.min()), int(hit.max())
            score = jaccard(a[i : j + 1], b[k : m + 1])
            if score >= similarity:
                out.append((i, j, k, m, score))
                break
    return out


def test_passages_of_many_pairs_equal_a_plain_search(monkeypatch):
    """Edited copies, moved parts and repeats; of anchors without a passage few are aligned with the whole text."""
    r = np.random.default_rng(8)
    pairs, wanted = [], []
    for number in range(80):
        a = r.integers(0, 2**32, int(r.integers(46, 900)), dtype=np.uint32)
        if number % 4 == 1:
            a[r.integers(0, len(a), len(a) // 3)] = a[0]
        part = [a[i : i + 90] for i in range(0, len(a), 90)]
        if number % 3 == 1:
            part = [part[i] for i in r.permutation(len(part))]
        b = np.concatenate([x for y in part for x in (y, r.integers(0, 2**32, int(r.integers(0, 9)), dtype=np.uint32))])
        edited = r.random(len(b)) < r.choice([0, 0.05, 0.12, 0.25])
        b[edited] = r.integers(0, 2**32, int(edited.sum()), dtype=np.uint32)
        where = {v: i for i, v in enumerate(b.tolist())}
        anchors = [(c, where[v]) for c, v in enumerate(a.tolist()) if v in where and r.random() < 0.2]
        pairs.append((a, b, anchors))
        wanted.append(plain_passages(a, b, anchors, 46, 0.8))
    whole = []
    stretch = compact_windows_module.stretch
    monkeypatch.setattr(compact_windows_module, "stretch", lambda *x: whole.append(x) or stretch(*x))
    assert compact_windows_module.passages_of(pairs, 46, 0.8) == wanted
    assert sum(map(len, wanted)) > 80 and sum(len(x[2]) for x in pairs) > 5 * len(whole)
    assert [passages(*pair, 46, 0.8) for pair in pairs] == wanted


def test_tokens_of_spans_are_those_of_the_text(monkeypatch):
    """A text that is in many pairs is cut into words once."""
    r = random.Random(5)
    texts = [" ".join(words(r, 80)) for _ in range(3)]
    spans = [(t, low, low + r.randrange(1, 20)) for t in texts for low in (9, 0, 40, 3)]
    cut = []
    split = compact_windows_module.ascii_words
    monkeypatch.setattr(compact_windows_module, "ascii_words", lambda t: cut.append(t) or split(t))
    got = compact_windows_module.span_tokens(spans, 5)
    assert got == [(shingle_hashes(t, 5)[low : high + 1] >> np.uint64(32)).astype(np.uint32).tobytes() for t, low, high in spans]
    assert len(cut) == 3


def test_recall_of_near_passages(spark):
    """Passages of 60 to 200 words with edits, by similarity: nearly all are found."""
    r = random.Random(21)
    rows, wanted = [], {}
    for pair in range(240):
        base = words(r, r.choice([60, 100, 200]))
        share = r.choice([0.0, 0.005, 0.01, 0.015, 0.02])
        near = [w if r.random() > share else "edit" + str(r.random()) for w in base]
        likeness = jaccard(shingle_hashes(" ".join(base), 5), shingle_hashes(" ".join(near), 5))
        rows += [(2 * pair, " ".join(words(r, 60) + base + words(r, 30))), (2 * pair + 1, " ".join(words(r, 20) + near + words(r, 90)))]
        if likeness >= 0.8:
            wanted[pair] = likeness
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    found = {x.doc_id // 2 for x in repeated_passages(df).collect()}
    recall = lambda low, high: np.mean([p in found for p, s in wanted.items() if low <= s <= high])
    print({k: float(recall(*k)) for k in ((0.8, 0.85), (0.85, 0.9), (0.9, 0.99), (0.99, 1.0))})
    assert recall(0.9, 1.0) >= 0.97 and recall(0.8, 0.9) >= 0.9


def test_a_frequent_phrase_inside_passages(spark):
    """Passages that hold a phrase of 40 words which many other texts hold too."""
    r = random.Random(22)
    phrase = words(r, 40)
    rows = [(i, " ".join(words(r, 40) + phrase + words(r, 30))) for i in range(60)]
    for pair in range(40):
        passage = words(r, r.choice([10, 20])) + phrase + words(r, r.choice([10, 20]))
        rows += [(1000 + 2 * pair + side, " ".join(words(r, 50) + passage + words(r, 50))) for side in (0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    found = {x for row in repeated_passages(df).collect() if {row.doc_id // 2, row.other_doc_id // 2} & set(range(500, 600)) for x in (row.doc_id // 2,)}
    recall = len(found) / 40
    print(recall)
    assert recall >= 0.9


def found_pairs(df, low: int) -> set[int]:
    """Pairs 2n, 2n + 1 of ids from ``low`` on of which a passage is reported."""
    return {x.doc_id // 2 for x in repeated_passages(df).collect() if x.doc_id >= low and x.doc_id // 2 == x.other_doc_id // 2}


@pytest.mark.parametrize("length", [30, 45, 49])
def test_a_phrase_nearly_as_long_as_a_passage_hides_none(spark, length):
    """Many texts hold the phrase, which is no passage; pairs share it and the words around it."""
    r = random.Random(length)
    phrase = words(r, length)
    rows = [(i, " ".join(words(r, 40) + phrase + words(r, 30))) for i in range(100)]
    for pair in range(50, 90):
        before = r.randrange(0, 21)
        passage = words(r, before) + phrase + words(r, 20 - before + max(0, 45 - length))
        rows += [(2 * pair + side, " ".join(words(r, 50) + passage + words(r, 50))) for side in (0, 1)]
    got = found_pairs(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), 100)
    print(len(got) / 40)
    assert len(got) >= 39


def test_a_representative_that_repeats_a_phrase(spark):
    """The first text of a key holds its phrase several times, once within a passage."""
    r = random.Random(23)
    rows = []
    for pair in range(40):
        phrase, before, after = words(r, 30), words(r, 15), words(r, 15)
        often = [x for _ in range(3) for x in words(r, 60) + phrase]
        rows += [(2 * pair, " ".join(often + words(r, 60) + before + phrase + after + words(r, 60))), (2 * pair + 1, " ".join(words(r, 40) + before + phrase + after + words(r, 40)))]
    got = found_pairs(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), 0)
    print(len(got) / 40)
    assert len(got) >= 39


@pytest.mark.parametrize("paired", [2, 32])
def test_links_equal_brute_force(paired):
    """Texts around one place: windows that share a passage are linked, or to one that shares it."""
    r = np.random.default_rng(paired)
    for _ in range(60):
        n, place, width = int(r.integers(2, 14)), 60, 46
        base = r.integers(0, 2**63, 121).astype(np.uint64)
        texts = []
        for rid in range(n):
            own = r.integers(0, 2**63, 121).astype(np.uint64)
            like = texts[r.integers(0, rid)] if rid and r.random() < 0.5 else base
            low, high = place - int(r.integers(0, 60)), place + int(r.integers(1, 60))
            own[low:high] = like[low:high]
            own[place] = base[place]
            texts.append(own)
        windows = np.array([(7, rid, 0, place, 120, int(surroundings(t, np.array([place]), width)[0])) for rid, t in enumerate(texts)])
        got = {(int(x[1]), int(x[6])) for links in linked(windows, paired) for x in links}

        for b in range(n):
            for a in range(b):
                equal = np.append(texts[a] == texts[b], False)
                share = int(np.argmin(equal[place:])) + int(np.argmin(equal[place::-1])) - 1
                like = int(common(windows[[a], 5], windows[[b], 5])[0])
                assert like >= 8 or share < 59
                one, two = sorted(int(np.flatnonzero(windows[:, 5] == windows[t, 5])[0]) for t in (a, b))
                assert all(t == h or (t, h) in got for t, h in ((t, int(np.flatnonzero(windows[:, 5] == windows[t, 5])[0])) for t in (a, b)))
                if like >= 8:
                    assert any({(x, h) for x in (one, two) if x != h} <= got for h in range(one + 1))
                else:
                    assert (two, one) in got or n > paired


def test_edited_copies_around_a_frequent_phrase(spark):
    """Pairs that share a phrase of many texts and more words beyond an edit: no whole passage in a row."""
    r = random.Random(24)
    phrase = words(r, 40)
    rows = [(i, " ".join(words(r, 40) + phrase + words(r, 30))) for i in range(100)]
    for pair in range(50, 90):
        before = words(r, 40)
        rows += [(2 * pair + side, " ".join(words(r, 50) + before + words(r, 1) + phrase + words(r, 50))) for side in (0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {x.doc_id // 2 for x in repeated_passages(df, hashes=2).collect() if x.doc_id // 2 == x.other_doc_id // 2}
    print(len(got) / 40)
    assert len(got) >= 38


@pytest.mark.parametrize("chunk", [7, 1000])
def test_search_of_frequent_keys_equals_brute_force(chunk):
    """Edited copies, some that repeat themselves: classes are those that all pairs give."""
    r = random.Random(chunk)
    base, again = words(r, 150), words(r, 6)
    texts = []
    for _ in range(30):
        edits, cut = r.choice([0.005, 0.02, 0.05]), r.randrange(0, 60)
        body = base[cut:] + (again * r.randrange(6, 12) if r.random() < 0.5 else [])
        texts.append(" ".join(words(r, 30) + [w if r.random() > edits else words(r, 1)[0] for w in body] + words(r, 30)))
    module, width = compact_windows_module, 46
    made = pd.concat(module._windows(width, 5, 4)(iter([pd.DataFrame({"rid": range(30), "text": texts})])))
    windows = made.loc[made["kind"] == module.WINDOW, module.LINK[:6]].to_numpy()
    rest = module.unpaired(windows, 4, chunk)
    assert len(rest)
    tokens = [(shingle_hashes(t, 5) >> np.uint64(32)).astype(np.uint32) for t in texts]
    reach = module.REACH * width
    around = lambda rid, c: tokens[rid][max(0, c - reach) : c + reach + 1]
    frame = pd.DataFrame({"key": rest[:, 0], "one": rest[:, 7], "two": rest[:, 9], "rid": rest[:, 1], "c": rest[:, 3], "class": rest[:, 5], "own": rest[:, 8], "l": rest[:, 2], "r": rest[:, 4]})
    frame["tokens"] = [around(rid, c).tobytes() for rid, c in zip(frame["rid"], frame["c"], strict=True)]
    frame = frame.sort_values(["key", "one", "two"])
    found = pd.concat(module._searching(width, 0.8)(iter([frame[:11], frame[11:]])))
    assert (found["rid"] > found["to"]).all()
    got = {(x.rid, x.c, x.to, x.tc) for x in found.itertuples()}

    joins = 0
    for _, group in frame.drop_duplicates(["key", "rid", "c", "l"]).groupby("key"):
        held = list(zip(group["rid"], group["c"], group["class"], strict=True))
        for some in ({(a[0], a[1], b[0], b[1]) for a in held for b in held}, got):
            label = {x: x[2] for x in held}
            for a in held:
                for b in held:
                    if b[0] < a[0] and (*a[:2], *b[:2]) in some and (some is got or passages(around(*a[:2]), around(*b[:2]), [(min(a[1], reach), min(b[1], reach))], width, 0.8)):
                        old, new = label[a], label[b]
                        label = {x: new if v == old else v for x, v in label.items()}
            parts = sorted(sorted(x for x in held if label[x] == v) for v in set(label.values()))
            if some is not got:
                wanted, joins = parts, joins + len(set(group["class"])) - len(parts)
        assert parts == wanted
    assert joins


@pytest.mark.parametrize("block", [5, 256])
def test_a_search_gives_a_forest(monkeypatch, block):
    """Edited copies of two texts: a link joins two classes, and most pairs are settled without being tested."""
    module, width, n = compact_windows_module, 46, 60
    monkeypatch.setattr(module, "BLOCK", block)
    r = np.random.default_rng(block)
    texts = []
    for i in range(n):
        text = np.arange(185, dtype=np.uint32) + 1000 * np.uint32(i % 2)
        edited = r.random(185) < 0.03
        edited[92] = False
        text[edited] = r.integers(10_000, 2**32, int(edited.sum()), dtype=np.uint32)
        texts.append(text)
    verified = []
    plain = module.passages_of
    monkeypatch.setattr(module, "passages_of", lambda pairs, *x: verified.extend(pairs) or plain(pairs, *x))
    found = module.joined(np.arange(n), np.zeros(n, int), np.arange(n), texts, np.full(n, 92), width, 0.8)
    label = list(range(n))
    for i, j in found:
        assert i > j and label[i] != label[j]
        label = [label[j] if x == label[i] else x for x in label]
    assert len(set(label)) == 2 and len(verified) < 3 * n
