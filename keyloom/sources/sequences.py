"""Sequence files as DataFrames: FASTA and FASTQ of any size, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """seq_id, header, seq of each record; sequence lines are joined.

    Records are split at line starts with ``>`` by the text source, so a file is
    read in parallel.  seq_id numbers records in no given order; files without
    records give no rows.
    """
    text = spark.read.option("lineSep", "\n>").text(path)
    record = F.regexp_replace("value", "^>", "")
    lines = F.split(record, "\r?\n")
    joined = F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), "")
    rows = text.where(F.trim("value") != "").select(F.trim(lines[0]).alias("header"), F.regexp_replace(joined, r"\s", "").alias("seq"))
    return rows.select(F.monotonically_increasing_id().alias("seq_id"), "header", "seq")


def read_fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """seq_id, header, seq, qual of each record of four lines.

    Lines are numbered by counting the lines of each block of a file, so that a
    large file is read in parallel; nothing depends on what a line looks like.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        F.regexp_replace("value", "\r$", "").alias("line"),
    )
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    starts = blocks.selectExpr("file", "block", "first", "sum(n) OVER (PARTITION BY file ORDER BY block) - n AS before")
    numbered = lines.join(starts, ["file", "block"]).select("file", "line", (F.col("at") - F.col("first") + F.col("before")).alias("number"))
    field = lambda k: F.max(F.when(F.col("number") % 4 == k, F.col("line")))
    records = numbered.where("line <> '' OR number % 4 IN (1, 3)").groupBy("file", F.floor(F.col("number") / 4).alias("record")).agg(field(0).alias("header"), field(1).alias("seq"), field(3).alias("qual"))
    kept = records.where("header IS NOT NULL AND seq IS NOT NULL")
    return kept.select(F.xxhash64("file", "record").alias("seq_id"), F.regexp_replace("header", "^@", "").alias("header"), "seq", "qual")


#: Letters of a FASTA line.
LINE = 60


def write_fasta(reads: DataFrame, folder: str, header: str, sequence: str = "seq") -> None:
    """Records of a header line and lines of ``LINE`` letters, a file a task."""
    lines = F.regexp_replace(F.coalesce(sequence, F.lit("")), f"(.{{{LINE}}})(?=.)", "$1\n")
    reads.select(F.concat(F.lit(">"), F.col(header).cast("string"), F.lit("\n"), lines).alias("value")).write.text(folder)


def write_fastq(reads: DataFrame, folder: str, header: str, sequence: str = "seq", quality: str = "qual") -> None:
    """Records of four lines, a file a task; the quality is as long as the sequence."""
    parts = [F.lit("@"), F.col(header).cast("string"), F.lit("\n"), F.col(sequence), F.lit("\n+\n"), F.col(quality)]
    reads.where(F.col(sequence).isNotNull()).select(F.concat(*parts).alias("value")).write.text(folder)
