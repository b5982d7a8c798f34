"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keyloom.llm.chat import perspectives
from keyloom.llm.compact_windows import repeated_passages
from keyloom.llm.decontaminate import leaked
from keyloom.llm.exact_dedup import exact_dedup
from keyloom.llm.line_dedup import line_dedup
from keyloom.llm.lm_score import lm_score
from keyloom.llm.packing import pack_documents
from keyloom.llm.quality import quality
from keyloom.llm.simhash_dedup import simhash_dedup
from keyloom.llm.warc import warc_round_trip

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"), size=4, radius=4)


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "source", "text", "n_chars", "n_lines", "n_dropped")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"))


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives(table(spark, sf_dir, "conversations"))


def vocabulary() -> str:
    """The byte-level vocabulary among the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary())


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


LINE_DEDUP_SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(source, '') AS host, text, n_chars,
         string_split(text, chr(10)) AS lines
  FROM documents
),
k AS (
  SELECT host, unnest(list_distinct(list_filter(list_transform(lines, lambda l: trim(l, E' \t\n\x0b\x0c\r')), lambda l: l <> ''))) AS line
  FROM p
),
c AS (SELECT host, line, count(*) AS n FROM k GROUP BY ALL),
t AS (SELECT host, count(*) AS total FROM p GROUP BY ALL),
b AS (
  SELECT host, list(line) AS bad FROM c JOIN t USING (host)
  WHERE n >= 3 AND n > 0.1::DOUBLE * total GROUP BY host
),
f AS (
  SELECT p.*, list_filter(lines, lambda l: trim(l, E' \t\n\x0b\x0c\r') = '' OR NOT list_contains(coalesce(bad, []), trim(l, E' \t\n\x0b\x0c\r'))) AS kept
  FROM p LEFT JOIN b USING (host)
)
SELECT doc_id, source,
       CASE WHEN len(kept) < len(lines) THEN array_to_string(kept, chr(10)) ELSE text END AS text,
       CASE WHEN len(kept) < len(lines) THEN length(array_to_string(kept, chr(10))) ELSE n_chars END AS n_chars,
       coalesce(len(lines), 0)::INTEGER AS n_lines,
       coalesce(len(lines) - len(kept), 0)::INTEGER AS n_dropped
FROM f
"""

WARC_SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS r, page_id, encode(coalesce(html, '')) AS payload FROM pages
),
f AS (
  SELECT *, first_value(r) OVER same AS first_r, first_value(page_id) OVER same AS first_page
  FROM p WINDOW same AS (PARTITION BY payload ORDER BY page_id NULLS LAST, r)
),
h AS (SELECT *, unhex(sha1(payload)) AS d FROM f),
g AS (
  SELECT r, string_agg(chr(CASE WHEN v < 26 THEN 65 + v ELSE 24 + v END), '' ORDER BY i) AS digest
  FROM (
    SELECT r, i, CAST(('0b' || substr(CAST(CAST(d AS BIT) AS VARCHAR), CAST(i * 5 + 1 AS BIGINT), 5)) AS INTEGER) AS v
    FROM h, range(32) AS q(i)
  ) GROUP BY r
),
b AS (SELECT h.*, digest FROM h JOIN g USING (r))
SELECT page_id, octet_length(payload) AS payload_bytes, digest AS payload_digest,
       CASE WHEN r = first_r THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN r <> first_r THEN first_page END AS refers_to
FROM b
"""

CHAT_SQL = r"""
WITH s AS (
  SELECT DISTINCT conv_id, turn,
         CASE WHEN trim(coalesce(role, '')) = '' THEN 'unknown' ELSE trim(role) END AS role,
         regexp_replace(coalesce(text, ''), '<\|(im_start|im_end)\|>', '<| \1 |>', 'g') AS text
  FROM conversations
),
d AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos FROM s
),
w AS (SELECT DISTINCT conv_id, role AS participant FROM s WHERE role <> 'system'),
r AS (
  SELECT d.*, participant, role = participant AS mine,
         CASE WHEN role = participant THEN '<|im_start|>assistant' || chr(10)
              WHEN role = 'system' THEN '<|im_start|>system' || chr(10)
              ELSE '<|im_start|>user name=' || role || chr(10) END AS head
  FROM d JOIN w ON d.conv_id IS NOT DISTINCT FROM w.conv_id
),
o AS (
  SELECT *, head || text || '<|im_end|>' || chr(10) AS whole, length(head) + length(text) + 11 AS size,
         sum(length(head) + length(text) + 11) OVER (PARTITION BY conv_id, participant ORDER BY pos ROWS UNBOUNDED PRECEDING) AS upto
  FROM r
)
SELECT conv_id, participant, pos // 64 AS part, min(pos) AS first_turn, CAST(min(upto - size) AS BIGINT) AS first_char, count(*) AS n_turns,
       count(*) FILTER (WHERE mine) AS n_assistant,
       string_agg(whole, '' ORDER BY pos) AS rendered,
       string_agg(CASE WHEN mine THEN '1' ELSE '0' END, '' ORDER BY pos) AS mask,
       coalesce(string_agg(CAST(upto - length(text) - 11 AS VARCHAR) || ':' || CAST(length(text) AS VARCHAR), ',' ORDER BY pos) FILTER (WHERE mine), '') AS spans
FROM o GROUP BY conv_id, participant, pos // 64
"""

EXACT_DEDUP_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS text FROM documents
)
SELECT doc_id,
       min(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept,
       sha256(text) AS text_sha256
FROM t WINDOW same AS (PARTITION BY text)
"""

QUERIES: dict[str, Query] = {
    "op1_simhash": op1_simhash,
    "op2_lm_score": op2_lm_score,
    "op3_line_dedup": op3_line_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_quality": op5_quality,
    "op6_warc": op6_warc,
    "op7_passages": op7_passages,
    "op8_chat": op8_chat,
    "op9_packing": op9_packing,
    "op10_decontaminate": op10_decontaminate,
}

SQL: dict[str, str] = {
    "op3_line_dedup": LINE_DEDUP_SQL,
    "op4_exact_dedup": EXACT_DEDUP_SQL,
    "op6_warc": WARC_SQL,
    "op8_chat": CHAT_SQL,
}
