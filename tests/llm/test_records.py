"""WARC archives, chat formatting and the pipeline."""

import gzip
import random

import pytest
from conftest import rows_of, sql_rows
from pyspark.sql import functions as F

from keyloom.llm import queries, warc
from keyloom.llm.chat import perspectives

PAGES = [(1, "http://a/x y", "<p>one</p>"), (2, "u", "<p>one</p>"), (2, "u", "<p>one</p>"), (3, None, None), (4, "u", ""), (None, "u", "<p>one</p>"), (None, None, "ä" * 70_000), (9, "u", "ä" * 70_000), (10, "u", "x" * 5000)]


def pages(spark, rows=PAGES):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in ("row", "payload", "kind", "path", "origin", "refers_to", "size"):
        df = df.withColumn(name, F.lit(1))
    return df


@pytest.mark.parametrize("segment", [50, 1000, 32 * 1024])
def test_round_trip(spark, tmp_path, segment):
    df = pages(spark)
    df.write.parquet(str(tmp_path / "pages"))
    got = warc.warc_round_trip(df, f"file://{tmp_path}/archives", segment)
    assert rows_of(got) == sql_rows(queries.WARC_SQL, {"pages": f"{tmp_path}/pages/*.parquet"})
    assert warc.warc_round_trip(df.limit(0)).isEmpty()


def test_least_revisit(spark):
    got = warc.warc_round_trip(pages(spark), least_revisit=100).collect()
    assert sorted(r.payload_bytes for r in got if r.record_type == "revisit") == [140_000]


def test_archives_are_gzip_members(spark, tmp_path):
    made = warc.write_archives(pages(spark), f"file://{tmp_path}", segment=1000).collect()
    files = list(tmp_path.glob("*.warc.gz"))
    assert len(files) == len(made)
    raw = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    assert raw.count(b"WARC/1.1\r\n") == sum(r.records for r in made)
    assert b"WARC-Segment-Total-Length" in raw and b"Transfer-Encoding: chunked" in raw


def test_framing():
    r = random.Random(1)
    for n in (0, 1, 4095, 4096, 4097, 20_000):
        payload = r.randbytes(n)
        assert warc.dechunked(warc.chunked(payload)) == payload
        assert warc.http_payload(warc.HTTP + warc.chunked(payload, 7)) == payload
    assert warc.dechunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for bad in (b"", b"5\r\nabc\r\n0\r\n\r\n", b"zz\r\nabc\r\n0\r\n\r\n", b"3\r\nabcX0\r\n\r\n"):
        with pytest.raises(warc.WarcError):
            warc.dechunked(bad)


def test_reassembly():
    parts = [(2, None, b"cd"), (1, None, b"ab"), (3, 5, b"e"), (2, None, b"cd")]
    assert warc.reassembled(parts) == b"abcde"
    for bad in ([(1, None, b"ab"), (3, 5, b"e")], [(1, None, b"ab"), (2, 9, b"c")], [(1, None, b"ab"), (2, None, b"c")], [(1, None, b"a"), (1, 2, b"b")]):
        with pytest.raises(warc.WarcError):
            warc.reassembled(bad)
    with pytest.raises(warc.WarcError):
        list(warc.parsed(gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n")))
    with pytest.raises(warc.WarcError):
        list(warc.parsed(gzip.compress(b"x")[:-3]))


TURNS = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo <|im_start|>system"), (1, 1, "assistant", "yo <|im_start|>system"), (1, 1, "bob", "hey"), (1, None, None, None), (1, 70, " ", "late"), (2, 0, "system", "only"), (None, 0, "user", "x"), (None, 1, "user", "ümlaut"), *[(3, 5, "user" if i % 2 else "amy", f"t{i}") for i in range(150)], (3, 6, "user", "after")]


def test_chat_odd_rows_equal_sql(spark, tmp_path):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    df.write.parquet(str(tmp_path / "turns"))
    wide = df
    for name in ("n", "part", "said", "participant", "turns", "at", "range", "row", "span", "c"):
        wide = wide.withColumn(name, F.lit(1))
    assert rows_of(perspectives(wide)) == sql_rows(queries.CHAT_SQL, {"conversations": f"{tmp_path}/turns/*.parquet"})
    assert perspectives(wide.limit(0)).isEmpty()


def test_chat_spans_and_masks(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    rows = perspectives(df).collect()
    assert {r.participant for r in rows if r.conv_id == 1} == {"user", "assistant", "bob", "unknown"}
    assert not [r for r in rows if r.conv_id == 2]
    for r in rows:
        spans = [tuple(map(int, x.split(":"))) for x in r.spans.split(",") if x]
        assert len(spans) == r.n_assistant == r.mask.count("1") and len(r.mask) == r.n_turns
        for start, length in spans:
            assert r.rendered[: start - r.first_char].endswith("<|im_start|>assistant\n")
            assert r.rendered[start - r.first_char + length :].startswith("<|im_end|>\n")


@pytest.mark.parametrize("span", [1024, 2])
def test_chat_parts_make_up_the_whole_dialogue(spark, monkeypatch, span):
    monkeypatch.setattr("keyloom.llm.chat.SPAN", span)
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").repartition(7)
    for size in (64, 7):
        held = {}
        for r in sorted(perspectives(df, size).collect(), key=lambda r: r.part):
            before, mask = held.get((r.conv_id, r.participant), ("", ""))
            assert r.first_char == len(before) and r.first_turn == len(mask) and r.n_turns <= size
            held[r.conv_id, r.participant] = before + r.rendered, mask + r.mask
        whole = {(r.conv_id, r.participant): (r.rendered, r.mask) for r in perspectives(df, 1000).collect()}
        assert held == whole
    amy, mask = whole[3, "amy"]
    assert len(mask) == 151 and mask.count("1") == 75 and amy.count("<|im_start|>assistant\n") == 75
    assert mask == "1" * 75 + "0" * 76


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as pipeline

    from keyloom.llm.decontaminate import leaked
    from keyloom.llm.line_dedup import without_boilerplate
    from keyloom.llm.quality import quality
    from keyloom.llm.simhash_dedup import simhash_dedup
    from keyloom.llm.text import stable

    table = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    docs = table("documents")
    names = [n for n, _ in pipeline.STAGES]
    assert len(names) == 5
    held = [docs]
    for _, stage in pipeline.STAGES:
        held.append(stable(stage(spark, held[-1], sf_dir)))
    assert all(d.columns == docs.columns for d in held[:-1])
    assert ids(held[1]) == ids(quality(docs, table("labels")).where("predicted = 1"))
    assert rows_of(held[2]) == rows_of(without_boilerplate(held[1]))
    groups = simhash_dedup(held[2], size=1, radius=7, distinct=True, similarity=0.8).collect()
    assert ids(held[3]) == sorted(r.doc_id for r in groups if r.doc_id == r.component_id)
    bad = {r.doc_id for r in leaked(held[3], table("benchmark")).collect()}
    assert ids(held[4]) == [d for d in ids(held[3]) if d not in bad]
    assert sorted({r.doc_id for r in held[5].collect()}) == ids(held[4])
    assert pipeline.run(spark, sf_dir).count() == held[5].count()


def test_pipeline_stages_on_odd_rows(spark, sf_dir):
    """Nulls, empty and very long texts, repeated rows and columns named like the stages' own."""
    import corpus_pipeline as pipeline

    long = " ".join(f"word{i % 997} of{i}" for i in range(10_000))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a few words of text here", "en", "s", 24), (None, None, None, None, None), (3, long, "en", "s", len(long)), (3, long, "en", "s", len(long)), (4, "One line\nand another line of it", None, None, 31), (5, " \t\n", "de", "s", 3), (6, "ß Éa \ufeff x", "de", "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clashing = ["quality_score", "score", "own", "n_lines", "n_dropped", "page", "kept", "dropped", "bad", "fp", "node", "a", "b", "times", "kid", "root", "place", "component_id", "item_ids", "label", "all"]
    wide = docs
    for name in clashing:
        wide = wide.withColumn(name, F.lit("as given"))
    for name, stage in pipeline.STAGES[:-1]:
        got = stage(spark, wide, sf_dir)
        assert got.columns == wide.columns, name
        held = got.collect()
        assert all(r[c] == "as given" for r in held for c in clashing), name
        assert stage(spark, wide.limit(0), sf_dir).isEmpty(), name
        plain = stage(spark, docs, sf_dir)
        assert rows_of(got.select(*docs.columns)) == rows_of(plain), name
        if name == "line dedup":
            assert rows_of(plain) == rows_of(docs)
        if name == "SimHash near-dedup":
            assert sorted((r.doc_id or 0, (r.text or "").strip()) for r in held) == sorted([(0, "a few words of text here"), (1, ""), (3, long), (4, rows[6][1]), (6, rows[8][1])])
    packed = pipeline.STAGES[-1][1](spark, wide, sf_dir).collect()
    assert sorted({r.doc_id or 0 for r in packed}) == [0, 1, 2, 3, 4, 5, 6]
    assert sum(r.length for r in packed if r.doc_id == 1) == 1
    assert pipeline.STAGES[-1][1](spark, wide.limit(0), sf_dir).isEmpty()
