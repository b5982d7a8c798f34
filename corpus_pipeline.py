"""The corpus pipeline: documents through five stages, each one operator.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's documents.  All but the last return
the columns that they were given, whatever their names, unchanged but for what
the stage is for.

Odd rows have the same outcome in every stage: a null text counts as empty, null
ids and repeated rows are rows like any other unless a stage says otherwise,
texts of any length are read whole, and an empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from keyloom.llm.decontaminate import without_leaks
from keyloom.llm.line_dedup import without_boilerplate
from keyloom.llm.packing import pack_documents
from keyloom.llm.quality import keep_good, train
from keyloom.llm.queries import table, vocabulary
from keyloom.llm.simhash_dedup import one_of_each
from keyloom.llm.text import remove, shared_folder


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject.

    Null and empty texts have a score of their own and go or stay by it.
    """
    return keep_good(docs, train(docs, table(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the boilerplate lines of their source; n_chars follows.

    A document of nothing but such lines is a copy of a document, which the next
    stage is for: it stays as it is.  A null text stays null.
    """
    return without_boilerplate(docs, keep_whole=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id.

    Fingerprints of distinct words within 7 bits propose a link; it holds if the
    texts' shingles of five words are 0.8 alike.  Texts without words are copies
    of each other; null ids come last; of rows that repeat id and text one stays.
    """
    return one_of_each(docs, size=1, radius=7, distinct=True, similarity=0.8, verify_size=5)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark question, re-parameterised or not."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    return pack_documents(docs, vocabulary())


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("best-fit packing", pack),
]

#: Models, fingerprints and tokenizers are beyond SQL; tests/llm has the checks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; a stage's rows are written, and removed
    once the next stage's are."""
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
