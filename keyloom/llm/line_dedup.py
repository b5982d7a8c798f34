"""Line dedup by site-relative frequency.

For each host the pages that contain a line are divided by the pages of the host;
a line on more than ``ratio`` of them is boilerplate there.  Lines are counted as
128-bit hashes with map-side sums, so a host may hold any share of the rows.  Of
one host at most (mean distinct lines of a page) / ``ratio`` lines can be
boilerplate, which bounds the list that is laid beside each page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.text import stable

RATIO = 0.1
MIN_PAGES = 3
SPACE = " \t\n\x0b\x0c\r"
#: Boilerplate lines of all hosts, counted before use, that are broadcast; more
#: of them are joined by host.
BROADCAST_LINES = 100_000


def _trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(SPACE))


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def boilerplate(pages: DataFrame, ratio: float, min_pages: int) -> DataFrame:
    """host, key of each boilerplate line; ``pages`` has host and lines."""
    own = F.array_distinct(F.transform(F.filter("lines", lambda x: _trimmed(x) != ""), lambda x: _key(_trimmed(x))))
    counts = pages.select("host", F.explode(own).alias("key")).groupBy("host", "key").agg(F.count("*").alias("n"))
    totals = pages.groupBy("host").agg(F.count("*").alias("total"))
    common = counts.where(F.col("n") >= min_pages).join(totals, "host")
    return common.where(F.col("n") > F.lit(ratio) * F.col("total")).select("host", "key")


def _cleaned(docs: DataFrame, host: str, ratio: float, min_pages: int, keep_whole: bool) -> tuple[DataFrame, list[Column]]:
    """Rows with page (the row of ``docs``), lines and dropped (how many go), and
    the columns of ``docs`` after that."""
    page = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("page")
    pages = docs.select(page).select("page", F.coalesce(F.col(f"page.`{host}`").cast("string"), F.lit("")).alias("host"), F.split("page.text", "\n").alias("lines"))
    common = stable(boilerplate(pages.select("host", "lines"), ratio, min_pages))
    bad = common.groupBy("host").agg(F.collect_list("key").alias("bad"))
    if common.count() <= BROADCAST_LINES:
        bad = F.broadcast(bad)
    joined = pages.join(bad, "host", "left")
    keeps = F.filter("lines", lambda x: (_trimmed(x) == "") | ~F.array_contains("bad", _key(_trimmed(x))))
    left = joined.select("page", "lines", F.when(F.col("bad").isNotNull(), keeps).otherwise(F.col("lines")).alias("kept"))
    if keep_whole:
        some = F.exists("kept", lambda x: _trimmed(x) != "")
        left = left.withColumn("kept", F.when(some, F.col("kept")).otherwise(F.col("lines")))
    dropped = F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines") - F.size("kept"))
    left = left.withColumn("dropped", dropped)
    text = F.when(F.col("dropped") > 0, F.array_join("kept", "\n")).otherwise(F.col("page.text"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("dropped") > 0, F.length(text).cast(kind)).otherwise(F.col("page.n_chars"))
    return left, [new.get(c, F.col(f"page.`{c}`")).alias(c) for c in docs.columns]


def line_dedup(docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, keep_whole: bool = False) -> DataFrame:
    """All columns of ``docs`` with boilerplate lines gone from text, and two counts.

    A line is boilerplate if more than ``ratio`` of its host's rows, and at least
    ``min_pages``, contain it; each row is a page, repeated rows too, and counts a
    line once.  Lines end at a line feed and are compared without white space at
    either end; blank ones are neither counted nor dropped.  A page of nothing
    but boilerplate loses all its lines; with ``keep_whole`` it stays as it is, as
    a copy of a page rather than a frame around one.  Null hosts are one host.  A
    null text stays null and has no lines.  n_chars, if there, becomes the new
    length where lines went.  An empty table gives none.

    Added: n_lines and n_dropped (columns of these names are replaced).
    """
    left, columns = _cleaned(docs.drop("n_lines", "n_dropped"), host, ratio, min_pages, keep_whole)
    n_lines = F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines"))
    return left.select(*columns, n_lines.alias("n_lines"), F.col("dropped").alias("n_dropped"))


def without_boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, keep_whole: bool = True) -> DataFrame:
    """``docs`` with boilerplate lines gone from text, every other column as it was.

    See ``line_dedup``; n_chars, if there, becomes the new length.
    """
    left, columns = _cleaned(docs, host, ratio, min_pages, keep_whole)
    return left.select(*columns)
