"""Maps that grow with a stream."""

from pyspark.sql import functions as F

from keyloom.streaming.incremental import counts, file_stream, merge_batches, run_to_folder, versioned_counts, windowed_counts


def _files(spark, folder, n=4):
    for i in range(n):
        spark.range(i * 100, i * 100 + 100).selectExpr("id % 7 AS k", "timestamp_seconds(id * 60) AS ts").coalesce(1).write.mode("append").parquet(folder)
    return spark.read.parquet(folder)


def test_counts_equal_batch(spark, tmp_path):
    rows = _files(spark, str(tmp_path / "in"))
    got = run_to_folder(counts(file_stream(spark, str(tmp_path / "in"), rows.schema, 1), "k"), str(tmp_path / "out"))
    batch = rows.groupBy(F.col("k").alias("key")).agg(F.count("*").alias("value"))
    assert got.exceptAll(batch).isEmpty()
    assert batch.exceptAll(got).isEmpty()


def test_a_stream_without_rows_gives_none(spark, tmp_path):
    spark.range(0).selectExpr("id AS k").write.parquet(str(tmp_path / "in"))
    stream = counts(file_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema), "k")
    assert run_to_folder(stream, str(tmp_path / "out")).isEmpty()


def test_versions_bear_repeats(spark, tmp_path):
    rows = _files(spark, str(tmp_path / "in"))
    folder = str(tmp_path / "map")
    merge = versioned_counts(spark, "k", folder)
    numbers = []

    def twice(batch, number):
        numbers.append(number)
        merge(batch, number)
        merge(batch, number)

    merge_batches(file_stream(spark, str(tmp_path / "in"), rows.schema, 1), twice, str(tmp_path / "cp"))
    last = spark.read.parquet(f"{folder}/version={max(numbers)}")
    assert len(numbers) > 1
    assert {r.key: r.value for r in last.collect()} == {r.k: r["count"] for r in rows.groupBy("k").count().collect()}


def test_windows(spark, tmp_path):
    rows = _files(spark, str(tmp_path / "in"), 2)
    frame = windowed_counts(file_stream(spark, str(tmp_path / "in"), rows.schema), "ts", "k", "1 hour", "1 day")
    assert run_to_folder(frame, str(tmp_path / "out")).agg(F.sum("value")).first()[0] == 200
