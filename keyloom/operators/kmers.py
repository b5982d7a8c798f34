"""Windows of fixed length over sequences, their counts and positions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.plans.keyspec import BIMOLECULE, CANONICAL, SINGLE, KeySpec

#: Windows cut from one piece of a sequence at a time, so that no row holds an
#: array as long as a chromosome.
PIECE = 16_384


def split_pieces(reads: DataFrame, spec: KeySpec, sequence: str = "seq") -> DataFrame:
    """Reads cut at every character outside the alphabet; pos is a piece's start.

    Empty pieces are dropped; null sequences give none.  The cuts of a sequence
    take one pass over it.
    """
    others = [c for c in reads.columns if c not in (sequence, "pos")]
    run = re.compile(f"[{spec.alphabet.symbols}]+")

    @F.pandas_udf("array<struct<pos: int, piece: string>>")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([[(m.start(), m.group()) for m in run.finditer(t or "")] for t in texts], dtype=object)

    pieces = reads.select(*others, F.explode(cut(spec.alphabet.raised(F.col(sequence)))).alias("p"))
    return pieces.select(*others, F.col("p.pos").alias("pos"), F.col("p.piece").alias(sequence))


def windows(reads: DataFrame, spec: KeySpec, sequence: str = "seq", split: bool = False) -> DataFrame:
    """Other columns of ``reads`` with pos (from 0) and kmer of every window.

    Slices are taken from bytes, at constant cost each, and the other strand is
    made once a piece, not once a window.  Sequences must be in the alphabet
    (``Alphabet.clean`` or ``split_pieces``), or any with ``split``, which leaves
    out every window that spans another character.  With mode canonical kmer is the
    lesser strand; with bimolecule there is also canon, the key both strands share.
    """
    k, n = spec.k, F.length("seq_")
    offset = F.col("pos") if "pos" in reads.columns else F.lit(0)
    others = [c for c in reads.columns if c not in (sequence, "pos", "kmer", "canon")]
    text = F.regexp_replace(spec.alphabet.raised(F.col(sequence)), f"[^{spec.alphabet.symbols}]", " ") if split else F.col(sequence)
    long = reads.select(*others, text.alias("seq_"), offset.alias("off_")).where(n >= k)
    pieces = long.select(*others, "off_", "seq_", F.explode(F.sequence(F.lit(0), n - k, F.lit(PIECE))).alias("at_"))
    bytes_ = F.substring(F.col("seq_").cast("binary"), F.col("at_") + 1, F.lit(PIECE + k - 1))
    pieces = pieces.select(*others, (F.col("off_") + F.col("at_")).alias("off_"), bytes_.alias("piece_"))
    other = spec.alphabet.reverse_complement(F.col("piece_").cast("string")).cast("binary")
    if spec.mode != SINGLE:
        pieces = pieces.withColumn("other_", other)
    last = F.octet_length("piece_") - k
    cut = pieces.withColumn("i_", F.explode(F.sequence(F.lit(0), last)))
    read = _slice("piece_", F.col("i_"), k)
    if split:
        cut = cut.where(~F.contains(read, F.lit(" ")))
    pos = (F.col("off_") + F.col("i_")).cast("int").alias("pos")
    if spec.mode == SINGLE:
        return cut.select(*others, pos, read.alias("kmer"))
    canon = F.least(read, _slice("other_", last - F.col("i_"), k))
    if spec.mode == CANONICAL:
        return cut.select(*others, pos, canon.alias("kmer"))
    return cut.select(*others, pos, read.alias("kmer"), canon.alias("canon"))


def _slice(column: str, start: Column, k: int) -> Column:
    return F.substring(F.col(column), start + 1, F.lit(k)).cast("string")


def count_kmers(reads: DataFrame, spec: KeySpec, sequence: str = "seq", order: str = "seq_id") -> DataFrame:
    """kmer, cnt.  Bimolecule: kmer is the strand read first by (``order``, pos)."""
    cut = windows(reads, spec, sequence)
    if spec.mode != BIMOLECULE:
        return cut.groupBy("kmer").agg(F.count("*").alias("cnt"))
    first = F.min_by("kmer", F.struct(F.col(order), F.col("pos"), F.col("kmer")))
    return cut.groupBy("canon").agg(first.alias("kmer"), F.count("*").alias("cnt")).select("kmer", "cnt")


def positions(reads: DataFrame, spec: KeySpec, sequence: str = "seq", quality: str | None = None) -> DataFrame:
    """Position index rows: kmer, seq_id, pos and, with a quality column, qual.

    qual is the mean Phred score (offset 33) of the window's symbols.
    """
    if quality is None:
        return windows(reads.select("seq_id", sequence), spec, sequence).select("kmer", "seq_id", "pos")
    cut = windows(reads.select("seq_id", sequence, quality), spec, sequence)
    scores = F.transform(F.sequence(F.lit(1), F.lit(spec.k)), lambda j: F.ascii(F.substring(F.col(quality).cast("binary"), F.col("pos") + j, F.lit(1)).cast("string")) - 33)
    mean = F.aggregate(scores, F.lit(0), lambda a, x: a + x) / spec.k
    return cut.select("kmer", "seq_id", "pos", mean.cast("float").alias("qual"))
