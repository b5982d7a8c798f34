"""Maps that grow with a stream of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """New Parquet files under ``path``; batches are bounded by a number of files."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def counts(stream: DataFrame, key: str) -> DataFrame:
    """key, value: a counting map as a stateful aggregation."""
    return stream.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("value"))


def run_to_folder(frame: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """Everything that is there now: the last result of the stream, written to ``folder``.

    Each micro-batch writes a version of its own, so the state never comes to the
    driver and a repeated batch writes the same version again.
    """
    spark = frame.sparkSession
    last = [-1]

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/version={number}")
        last[0] = number

    query = frame.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}-progress").trigger(availableNow=True).start()
    query.awaitTermination()
    if last[0] < 0:
        return spark.createDataFrame([], frame.schema)
    return spark.read.schema(frame.schema).parquet(f"{folder}/version={last[0]}")


def windowed_counts(stream: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """start, key, value: counts in tumbling windows, rows later than ``late`` dropped."""
    grouped = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), F.col(key).alias("key"))
    return grouped.agg(F.count("*").alias("value")).select(F.col("w.start").alias("start"), "key", "value")


def merge_batches(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch given to ``merge(batch, number)``, which must bear repeats."""
    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def versioned_counts(spark: SparkSession, key: str, folder: str) -> Callable[[DataFrame, int], None]:
    """A merge that keeps a counting map as one Parquet version a batch.

    Version n is made of version n - 1 and batch n alone, so a repeated batch
    writes the same version again.
    """

    def merge(batch: DataFrame, number: int) -> None:
        new = batch.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("value"))
        if number:
            held = batch.sparkSession.read.parquet(f"{folder}/version={number - 1}")
            new = held.select("key", "value").unionAll(new).groupBy("key").agg(F.sum("value").alias("value"))
        new.write.mode("overwrite").parquet(f"{folder}/version={number}")

    return merge
