"""Exact dedup: tree-merge of sorted digest runs, DataFrame operations only.

Every input partition makes one run of digests, numbered from 0.  In round i the
runs whose numbers agree but for their i-th hexadecimal digit (up to ``FAN_IN``)
are exchanged by digest, sorted and merged: of each digest the smallest identifier
and the number of rows stay.  Rounds follow until one run is left; how many
depends on the number of runs alone.  A digest never brings more than ``FAN_IN``
rows to one merge, however many rows hold it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.text import squeezed, stable

FAN_IN_BITS = 4
FAN_IN = 1 << FAN_IN_BITS
#: SHA-256 with a second hash and the length: rows that differ in any of them
#: never merge, so an identifier is kept for verified equals only.
DIGEST = ("sha", "check", "length")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, row, run and the digest columns of each document."""
    text = docs.select("doc_id", squeezed(F.col("text")).alias("text"))
    return text.select(
        "doc_id",
        F.monotonically_increasing_id().alias("row"),
        F.spark_partition_id().alias("run"),
        F.unhex(F.sha2("text", 256)).alias("sha"),
        F.xxhash64("text").alias("check"),
        F.length("text").alias("length"),
    )


def merge_round(runs: DataFrame) -> DataFrame:
    """Sorted runs merged with their neighbours: the least row and the count of each digest.

    Spark takes the least of a struct by sorting: a run is sorted and combined
    before the exchange, and the sorted pieces are merged after it.
    """
    return runs.groupBy(*DIGEST, F.shiftright("run", FAN_IN_BITS).alias("run")).agg(F.min("first").alias("first"), F.sum("n").alias("n"))


def rounds_for(runs: int) -> int:
    """Rounds until one run is left; one at least, in which a lone run merges its equals."""
    rounds = 1
    while runs > FAN_IN**rounds:
        rounds += 1
    return rounds


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` with the row that stays of its equal texts.

    Needs doc_id and text; other columns are ignored, whatever their names.
    Texts are equal if identical after each run of white space became one space;
    a null text is empty.  The smallest doc_id stays; null ids come after all
    others, and of rows that repeat an id one stays.  An empty table gives none.

    Returns doc_id, keep_id, group_size, kept, text_sha256.
    """
    rows = stable(digests(docs))
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row").alias("first")
    runs = rows.select(*DIGEST, "run", first, F.lit(1).cast("long").alias("n"))
    last = rows.agg(F.max("run")).first()[0]
    for _ in range(rounds_for((last or 0) + 1)):
        runs = merge_round(runs)
    return rows.join(runs.drop("run"), list(DIGEST)).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("first.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
