"""Registered queries of the keyed engine with their SQL.

Every query reads its whole tables.  Ordered reductions order by a struct that
ends in the value, as (l_orderkey, l_linenumber) repeats.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions import hashing, numbers, sketch
from keyloom.functions.alphabets import DNA, DNA16
from keyloom.operators import movement
from keyloom.operators.keyed_map import COUNT, FIRST, FOLD, LAST, KeyedMap, is_new
from keyloom.operators.kmers import count_kmers, positions, windows
from keyloom.operators.multimap import Multimap, aux_filter, aux_filter_by
from keyloom.plans.keyspec import BIMOLECULE, CANONICAL, SINGLE, KeySpec
from keyloom.plans.storage import remove, shared_folder, stable
from keyloom.sources.binary import read_pairs, write_pairs
from keyloom.sources.sequences import read_fasta, read_fastq, write_fasta, write_fastq
from keyloom.sources.synthetic import hash_sample, query_mix, unique_keys
from keyloom.streaming.incremental import counts as stream_counts
from keyloom.streaming.incremental import file_stream, run_to_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
K = 5
LONG_K = 11
ORDER = ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"]


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL if there is any."""

    def add(function: Query) -> Query:
        QUERIES[name or function.__name__] = function
        if sql is not None:
            SQL[name or function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sequences: the nucleotide letters of their text."""
    docs = movement.spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(F.col("doc_id").alias("seq_id"), DNA.clean(F.col("text")).alias("seq"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


def by_part(spark: SparkSession, sf_dir: str, reducer: str, value: str | None = "l_suppkey", **more: object) -> KeyedMap:
    return KeyedMap.build(lines(spark, sf_dir), "l_partkey", value, reducer, ORDER, **more)


def quantities(spark: SparkSession, sf_dir: str) -> KeyedMap:
    """Orders to the sum of their quantities."""
    return KeyedMap.build(lines(spark, sf_dir), "l_orderkey", F.col("l_quantity").cast("long"), "sum")


def order_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))


def scratch(spark: SparkSession) -> str:
    """A new folder in the store that all executors share."""
    return f"{shared_folder(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"


# --- SQL pieces ---------------------------------------------------------------

SQL_READS = "reads AS (SELECT doc_id AS seq_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents)"


def sql_windows(k: int, source: str = "reads") -> str:
    return f"cut AS (SELECT seq_id, i - 1 AS pos, substr(seq, CAST(i AS BIGINT), {k}) AS kmer FROM {source}, unnest(range(1, greatest(length(seq) - {k} + 2, 1))) AS t(i))"


SQL_CANON = "least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA')))"
SQL_SUMS = "m AS (SELECT l_orderkey AS key, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS value FROM lineitem GROUP BY 1)"
SQL_HASH = "CAST('0x' || substr(md5(CAST({} AS VARCHAR)), 1, 15) AS BIGINT)"
SQL_ORDER = "row(l_orderkey, l_linenumber, l_suppkey, l_quantity)"

# --- sequences ----------------------------------------------------------------


@query(f"WITH {SQL_READS}, {sql_windows(K)} SELECT seq_id, CAST(pos AS INTEGER) AS pos, kmer FROM cut")
def kmer_extract(spark, sf_dir):
    return windows(reads(spark, sf_dir), KeySpec(K)).select("seq_id", "pos", "kmer")


@query(f"""WITH reads AS (SELECT doc_id AS seq_id, unnest(regexp_split_to_array(upper(text), '[^ACGT]+')) AS seq FROM documents), {sql_windows(3)}
SELECT kmer, count(*) AS cnt FROM cut GROUP BY 1""")
def kmer_nsplit(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.explode(DNA.pieces(F.col("text"))).alias("seq"))
    return count_kmers(rows, KeySpec(3))


@query(f"""WITH s AS (SELECT doc_id AS seq_id, regexp_replace(upper(text), '[^ACGT]', ' ', 'g') AS t FROM documents),
c AS (SELECT seq_id, i - 1 AS pos, substr(t, CAST(i AS BIGINT), 4) AS kmer FROM s, unnest(range(1, greatest(length(t) - 2, 1))) AS u(i))
SELECT seq_id, CAST(pos AS INTEGER) AS pos, kmer FROM c WHERE NOT contains(kmer, ' ')""")
def kmer_nsplit_positions(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), F.col("text").alias("seq"))
    return windows(rows, KeySpec(4), split=True).select("seq_id", "pos", "kmer")


@query(f"WITH {SQL_READS}, {sql_windows(K)} SELECT kmer, count(*) AS cnt FROM cut GROUP BY 1")
def kmer_count_single(spark, sf_dir):
    return count_kmers(reads(spark, sf_dir), KeySpec(K))


@query(f"WITH {SQL_READS}, {sql_windows(K)} SELECT {SQL_CANON} AS kmer, count(*) AS cnt FROM cut GROUP BY 1")
def kmer_count_canonical(spark, sf_dir):
    return count_kmers(reads(spark, sf_dir), KeySpec(K, mode=CANONICAL))


@query(f"WITH {SQL_READS}, {sql_windows(LONG_K)} SELECT {SQL_CANON} AS kmer, count(*) AS cnt FROM cut GROUP BY 1")
def kmer_count_canonical_long(spark, sf_dir):
    return count_kmers(reads(spark, sf_dir), KeySpec(LONG_K, mode=CANONICAL))


@query(f"""WITH {SQL_READS}, {sql_windows(K)}
SELECT kmer, cnt FROM (SELECT {SQL_CANON} AS canon, arg_min(kmer, row(seq_id, pos, kmer)) AS kmer, count(*) AS cnt FROM cut GROUP BY 1)""")
def kmer_count_bimolecule(spark, sf_dir):
    return count_kmers(reads(spark, sf_dir), KeySpec(K, mode=BIMOLECULE))


@query(r"""WITH reads AS (SELECT doc_id AS seq_id, regexp_replace(translate(text, 'acmgrsvtwyhkdbn', 'ACMGRSVTWYHKDBN'), '[^ACMGRSVTWYHKDBN]', '', 'g') AS seq FROM documents),
cut AS (SELECT substr(seq, CAST(i AS BIGINT), 3) AS kmer FROM reads, unnest(range(1, greatest(length(seq) - 1, 1))) AS t(i))
SELECT least(kmer, reverse(translate(kmer, 'ACMGRSVTWYHKDBN', 'TGKCYSBAWRDMHVN'))) AS kmer, count(*) AS cnt FROM cut GROUP BY 1""")
def kmer_count_dna16(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), DNA16.clean(F.col("text")).alias("seq"))
    return count_kmers(rows, KeySpec(3, DNA16, CANONICAL))


@query(f"WITH {SQL_READS}, {sql_windows(LONG_K)} SELECT {SQL_CANON} AS kmer, seq_id, CAST(pos AS INTEGER) AS pos FROM cut")
def kmer_position_index(spark, sf_dir):
    return positions(reads(spark, sf_dir), KeySpec(LONG_K, mode=CANONICAL))


@query(f"""WITH {SQL_READS}, {sql_windows(LONG_K)}, b AS (SELECT item_id AS seq_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM benchmark),
q AS (SELECT DISTINCT substr(seq, CAST(i AS BIGINT), {LONG_K}) AS kmer FROM b, unnest(range(1, greatest(length(seq) - {LONG_K - 2}, 1))) AS t(i))
SELECT seq_id, count(*) AS hits FROM cut SEMI JOIN q USING (kmer) GROUP BY 1""")
def kmer_index_lookup(spark, sf_dir):
    """Hits of the benchmark's windows in the documents' position index."""
    index = positions(reads(spark, sf_dir), KeySpec(LONG_K)).withColumnRenamed("kmer", "key")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), DNA.clean(F.col("text")).alias("seq"))
    keys = windows(asked, KeySpec(LONG_K)).select(F.col("kmer").alias("key")).distinct()
    return Multimap(index).equal_range(keys).groupBy("seq_id").agg(F.count("*").alias("hits"))


@query(f"""WITH {SQL_READS}, {sql_windows(LONG_K)}, c AS (SELECT kmer, {SQL_HASH.format(SQL_CANON)} % 16 AS bucket FROM cut)
SELECT CAST(bucket AS INTEGER) AS bucket, count(*) AS n, count(DISTINCT kmer) AS kmers FROM c GROUP BY 1""")
def kmer_placement(spark, sf_dir):
    """Windows placed by a hash that both strands share."""
    cut = windows(reads(spark, sf_dir), KeySpec(LONG_K))
    bucket = F.pmod(hashing.portable60(DNA.canonical(F.col("kmer"))), F.lit(16)).cast("int")
    return cut.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.count_distinct("kmer").alias("kmers"))


@query(f"WITH {SQL_READS}, {sql_windows(LONG_K)} SELECT {SQL_CANON} AS kmer, count(*) AS cnt FROM cut GROUP BY 1")
def fasta_kmer_count(spark, sf_dir):
    """Documents written as FASTA, read back and counted."""
    folder = scratch(spark)
    write_fasta(reads(spark, sf_dir), folder, "seq_id")
    out = stable(count_kmers(read_fasta(spark, folder), KeySpec(LONG_K, mode=CANONICAL)))
    remove(spark, folder)
    return out


#: Quality characters by nucleotide, as Phred scores with offset 33.
QUALITIES = {"A": "5", "C": "?", "G": "I", "T": "#"}
SQL_SCORES = " + ".join(f"{ord(q) - 33} * (length(kmer) - length(replace(kmer, '{c}', '')))" for c, q in QUALITIES.items())


@query(f"WITH {SQL_READS}, {sql_windows(K)} SELECT kmer, seq_id, CAST(pos AS INTEGER) AS pos, CAST(({SQL_SCORES}) / {K}.0 AS FLOAT) AS qual FROM cut")
def fastq_quality_index(spark, sf_dir):
    """Documents written as FASTQ, read back as a position index with mean qualities."""
    folder = scratch(spark)
    scored = reads(spark, sf_dir).withColumn("qual", F.translate("seq", "".join(QUALITIES), "".join(QUALITIES.values())))
    write_fastq(scored, folder, "seq_id")
    back = read_fastq(spark, folder).withColumn("seq_id", F.col("header").cast("long"))
    out = stable(positions(back, KeySpec(K), quality="qual"))
    remove(spark, folder)
    return out


@query("SELECT l_partkey AS key, count(*) AS n, CAST(sum(l_suppkey) AS BIGINT) AS total FROM lineitem GROUP BY 1")
def binary_pairs(spark, sf_dir):
    """Packed pairs written by each task, read back in ranges."""
    folder = scratch(spark)
    rows = lines(spark, sf_dir).select(F.col("l_partkey").alias("key"), F.col("l_suppkey").alias("value"))
    write_pairs(rows, folder)
    out = stable(read_pairs(spark, folder).groupBy("key").agg(F.count("*").alias("n"), F.sum("value").alias("total")))
    remove(spark, folder)
    return out


@query("SELECT o_orderkey AS key FROM orders")
def binary_headed_keys(spark, sf_dir):
    """Keys as headed vectors, a file a task, read back in ranges and checked."""
    folder = scratch(spark)
    write_pairs(order_keys(spark, sf_dir), folder, "uint64", None, headed=True)
    out = stable(read_pairs(spark, folder, "uint64", None, headed=True, range_bytes=1 << 16))
    remove(spark, folder)
    return out


# --- aggregation --------------------------------------------------------------


@query(f"SELECT l_partkey AS key, arg_min(l_suppkey, {SQL_ORDER}) AS value FROM lineitem GROUP BY 1")
def map_first(spark, sf_dir):
    return by_part(spark, sf_dir, FIRST).entries()


@query(f"SELECT l_partkey AS key, arg_max(l_suppkey, {SQL_ORDER}) AS value FROM lineitem GROUP BY 1")
def map_last(spark, sf_dir):
    return by_part(spark, sf_dir, LAST).entries()


def _reduced(name: str, sql: str) -> None:
    query(f"SELECT l_partkey AS key, {sql} AS value FROM lineitem GROUP BY 1", f"map_reduce_{name}")(lambda spark, sf_dir: by_part(spark, sf_dir, name).entries())


for _name, _sql in (("sum", "CAST(sum(l_suppkey) AS BIGINT)"), ("min", "min(l_suppkey)"), ("max", "max(l_suppkey)"), ("bit_and", "bit_and(l_suppkey)"), ("bit_or", "bit_or(l_suppkey)"), ("bit_xor", "bit_xor(l_suppkey)")):
    _reduced(_name, _sql)


@query(f"""SELECT l_partkey AS key, list_reduce(list_prepend(0::BIGINT, list(l_suppkey ORDER BY {SQL_ORDER})), lambda a, v: (a * 31 + v) % 1000003) AS value FROM lineitem GROUP BY 1""")
def map_reduce_fold(spark, sf_dir):
    return by_part(spark, sf_dir, FOLD, fold=lambda a, v: (a * 31 + v) % 1000003).entries()


@query("SELECT l_partkey AS key, count(*) AS value FROM lineitem GROUP BY 1")
def map_count(spark, sf_dir):
    return by_part(spark, sf_dir, COUNT, None).entries()


@query("SELECT l_partkey AS key, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS value FROM lineitem GROUP BY 1")
def map_count_weighted(spark, sf_dir):
    return KeyedMap.build(lines(spark, sf_dir), "l_partkey", F.col("l_quantity").cast("long"), COUNT).entries()


@query(f"SELECT l_partkey AS key, arg_min(l_suppkey, {SQL_ORDER}) AS value FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
def map_insert_filtered(spark, sf_dir):
    return by_part(spark, sf_dir, FIRST, where=F.col("l_returnflag") == "R").entries()


def _batches(rows: DataFrame) -> list[DataFrame]:
    """Every row in one of three batches: flag A, flag N, and whatever else there is."""
    flag = F.col("l_returnflag")
    return [rows.where(flag == "A"), rows.where(flag == "N"), rows.where(~F.coalesce(flag.isin("A", "N"), F.lit(False)))]


@query("SELECT l_partkey AS key, count(*) AS value FROM lineitem GROUP BY 1")
def map_insert_incremental(spark, sf_dir):
    """A counting map built of three insertions."""
    first, second, rest = _batches(lines(spark, sf_dir))
    held = KeyedMap.build(first, "l_partkey", None, COUNT)
    return held.insert(second, "l_partkey").insert(rest, "l_partkey").entries()


@query(f"SELECT l_partkey AS key, arg_max(l_suppkey, {SQL_ORDER}) AS value FROM lineitem GROUP BY 1")
def map_insert_batches(spark, sf_dir):
    rows = lines(spark, sf_dir)
    empty = KeyedMap.build(rows.limit(0), "l_partkey", "l_suppkey", LAST, ORDER)
    return empty.insert_all(_batches(rows), "l_partkey", "l_suppkey", ORDER).entries()


@query(f"SELECT l_partkey AS key, arg_min(l_suppkey, {SQL_ORDER}) AS value FROM lineitem GROUP BY 1")
def map_insert_sorted(spark, sf_dir):
    """A first-wins map of rows that were placed and sorted by key before."""
    placed = movement.local_sort(movement.distribute(lines(spark, sf_dir), "l_partkey"), ["l_partkey", *ORDER])
    return KeyedMap.build(placed, "l_partkey", "l_suppkey", FIRST, ORDER).entries()


@query(f"""WITH m AS (SELECT DISTINCT l_partkey AS key FROM lineitem WHERE l_quantity > 49),
q AS (SELECT l_partkey AS key, l_orderkey, l_linenumber, l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_partkey ORDER BY {SQL_ORDER}) AS nth FROM lineitem WHERE l_quantity > 48)
SELECT q.key, l_orderkey, l_linenumber, l_suppkey, l_quantity, m.key IS NULL AND nth = 1 AS is_new FROM q LEFT JOIN m USING (key)""")
def map_is_new(spark, sf_dir):
    """Which of a batch's rows would add their key to a held map, repeats within the batch included."""
    held = by_part(spark, sf_dir, COUNT, None, where=F.col("l_quantity") > 49)
    batch = lines(spark, sf_dir).where("l_quantity > 48").select(F.col("l_partkey").alias("key"), *ORDER)
    return is_new(batch, held, ORDER)


# --- lookup -------------------------------------------------------------------


@query(f"WITH {SQL_SUMS} SELECT o_orderkey AS key, coalesce(value, -1) AS value FROM orders LEFT JOIN m ON o_orderkey = key")
def map_find_default(spark, sf_dir):
    return quantities(spark, sf_dir).find(order_keys(spark, sf_dir), -1)


@query(f"WITH {SQL_SUMS}, q AS (SELECT l_suppkey * 7 AS key FROM lineitem) SELECT key, value FROM q JOIN m USING (key)")
def map_find_existing(spark, sf_dir):
    asked = lines(spark, sf_dir).select((F.col("l_suppkey") * 7).alias("key"))
    return quantities(spark, sf_dir).find_existing(asked)


@query(f"WITH {SQL_SUMS}, q AS (SELECT DISTINCT l_suppkey * 7 AS key FROM lineitem) SELECT key, value FROM q JOIN m USING (key)")
def map_find_existing_distinct(spark, sf_dir):
    asked = lines(spark, sf_dir).select((F.col("l_suppkey") * 7).alias("key"))
    return quantities(spark, sf_dir).find_existing(asked, distinct=True)


@query(f"WITH {SQL_SUMS} SELECT o_orderkey AS key, CAST(key IS NOT NULL AS INTEGER) AS found FROM orders LEFT JOIN m ON o_orderkey = key")
def map_exists(spark, sf_dir):
    return quantities(spark, sf_dir).exists(order_keys(spark, sf_dir))


@query(f"WITH {SQL_SUMS} SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 = 0 THEN coalesce(value, 0) ELSE 0 END AS value FROM orders LEFT JOIN m ON o_orderkey = key")
def map_find_inpred(spark, sf_dir):
    return quantities(spark, sf_dir).find(order_keys(spark, sf_dir), 0, in_pred=lambda k: k % 3 == 0)


@query(f"WITH {SQL_SUMS} SELECT o_orderkey AS key, CASE WHEN value > 100 THEN value ELSE 0 END AS value FROM orders LEFT JOIN m ON o_orderkey = key")
def map_find_outpred(spark, sf_dir):
    return quantities(spark, sf_dir).find(order_keys(spark, sf_dir), 0, out_pred=lambda e: e["value"] > 100)


@query(f"WITH {SQL_SUMS} SELECT key, value FROM m WHERE value > 100 AND key % 2 = 0")
def map_find_where(spark, sf_dir):
    return quantities(spark, sf_dir).find_where(lambda e: (e["value"] > 100) & (e["key"] % 2 == 0))


@query(f"WITH {SQL_SUMS} SELECT o_orderkey AS key, CASE WHEN value > 100 THEN 1 ELSE -1 END AS found FROM orders LEFT JOIN m ON o_orderkey = key WHERE o_orderkey % 3 = 0")
def map_exists_predicated(spark, sf_dir):
    """Presence by query and entry predicates, with another value for a miss."""
    return quantities(spark, sf_dir).exists(order_keys(spark, sf_dir), in_pred=lambda k: k % 3 == 0, out_pred=lambda e: e["value"] > 100, miss=-1)


@query(f"WITH {SQL_SUMS} SELECT key, CAST(value > 100 AS INTEGER) AS found FROM m")
def map_exists_where(spark, sf_dir):
    return quantities(spark, sf_dir).exists_where(lambda e: e["value"] > 100)


@query(f"WITH {SQL_SUMS} SELECT count(*) AS asked, count(value) AS hits FROM orders LEFT JOIN m ON o_orderkey = key")
def map_hits(spark, sf_dir):
    return quantities(spark, sf_dir).hits(order_keys(spark, sf_dir))


@query(f"WITH {SQL_SUMS} SELECT o_orderkey AS key, CASE WHEN value IS NULL THEN -o_orderkey ELSE value * 2 + o_orderkey END AS result FROM orders LEFT JOIN m ON o_orderkey = key")
def map_query_functor(spark, sf_dir):
    """A lookup that hands key, value and hit to a function."""
    return quantities(spark, sf_dir).query(order_keys(spark, sf_dir), lambda key, value, hit: F.when(hit, value * 2 + key).otherwise(-key))


@query("SELECT o_orderkey AS key, l_linenumber, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT'")
def map_equal_range(spark, sf_dir):
    held = Multimap(lines(spark, sf_dir).select(F.col("l_orderkey").alias("key"), "l_linenumber", "l_partkey"))
    asked = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("key"))
    return held.equal_range(asked)


@query("SELECT o_orderkey AS key, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def multimap_count(spark, sf_dir):
    held = Multimap(lines(spark, sf_dir).select(F.col("l_orderkey").alias("key"), "l_linenumber"))
    return held.count(order_keys(spark, sf_dir))


# --- change -------------------------------------------------------------------

SQL_PARTS = "m AS (SELECT l_partkey AS key, CAST(sum(l_suppkey) AS BIGINT) AS value FROM lineitem WHERE l_quantity > 45 GROUP BY 1), u AS (SELECT p_partkey AS key, CAST(p_size AS BIGINT) AS new FROM part WHERE p_size > 20)"


def _parts(spark: SparkSession, sf_dir: str) -> tuple[KeyedMap, DataFrame]:
    held = by_part(spark, sf_dir, "sum", where=F.col("l_quantity") > 45)
    new = table(spark, sf_dir, "part").where("p_size > 20").select(F.col("p_partkey").alias("key"), F.col("p_size").cast("long").alias("value"))
    return held, new


@query(f"WITH {SQL_PARTS} SELECT m.key, value + coalesce(new, 0) AS value FROM m LEFT JOIN u USING (key)")
def map_update(spark, sf_dir):
    held, new = _parts(spark, sf_dir)
    return held.update(new).entries()


@query(f"WITH {SQL_PARTS} SELECT coalesce(m.key, u.key) AS key, coalesce(new, value) AS value FROM m FULL JOIN u ON m.key = u.key")
def map_upsert(spark, sf_dir):
    held, new = _parts(spark, sf_dir)
    return held.upsert(new).entries()


@query(f"WITH {SQL_PARTS} SELECT coalesce(m.key, u.key) AS key, coalesce(greatest(value, new), value, new) AS value FROM m FULL JOIN u ON m.key = u.key")
def map_upsert_reduce(spark, sf_dir):
    held, new = _parts(spark, sf_dir)
    return held.upsert(new, F.greatest).entries()


@query(f"WITH {SQL_PARTS} SELECT key, value FROM m ANTI JOIN u USING (key)")
def map_erase(spark, sf_dir):
    held, new = _parts(spark, sf_dir)
    return held.erase(new).entries()


@query(f"WITH {SQL_PARTS} SELECT key, value FROM m WHERE NOT (value % 2 = 0)")
def map_erase_where(spark, sf_dir):
    held, _ = _parts(spark, sf_dir)
    return held.erase_where(lambda e: e["value"] % 2 == 0).entries()


@query(f"WITH {SQL_PARTS} SELECT key, value FROM m WHERE NOT (key % 2 = 0 AND value > 20 AND key IN (SELECT key FROM u))")
def map_erase_predicated(spark, sf_dir):
    held, new = _parts(spark, sf_dir)
    return held.erase(new, in_pred=lambda k: k % 2 == 0, out_pred=lambda e: e["value"] > 20).entries()


@query(f"WITH {SQL_PARTS} SELECT count(*) AS removed FROM m WHERE key % 2 = 0 AND value > 20 AND key IN (SELECT key FROM u)")
def map_erased(spark, sf_dir):
    held, new = _parts(spark, sf_dir)
    return held.erased(new, in_pred=lambda k: k % 2 == 0, out_pred=lambda e: e["value"] > 20)


@query(f"WITH {SQL_PARTS} SELECT p_partkey AS key, CAST(p_partkey IN (SELECT key FROM m) AND p_partkey NOT IN (SELECT key FROM u) AS INTEGER) AS found FROM part")
def map_erase_then_count(spark, sf_dir):
    """Presence of every part after some were erased."""
    held, new = _parts(spark, sf_dir)
    return held.erase(new).exists(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key")))


# --- facts --------------------------------------------------------------------


@query("SELECT DISTINCT l_partkey AS key FROM lineitem")
def map_keys(spark, sf_dir):
    return by_part(spark, sf_dir, COUNT, None).keys()


@query("SELECT count(DISTINCT l_partkey) AS size, count(*) AS total FROM lineitem")
def map_size(spark, sf_dir):
    return by_part(spark, sf_dir, COUNT, None).facts().select("size", "total")


@query("SELECT count(*) AS rows, count(DISTINCT l_partkey) AS keys, count(*) / count(DISTINCT l_partkey) AS multiplicity FROM lineitem")
def map_multiplicity(spark, sf_dir):
    return Multimap(lines(spark, sf_dir).select(F.col("l_partkey").alias("key"))).multiplicity()


@query("SELECT CAST(sum(n * n) AS BIGINT) AS sum_squares FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey)")
def map_sum_squares(spark, sf_dir):
    return by_part(spark, sf_dir, COUNT, None).facts().select("sum_squares")


@query("SELECT l_partkey AS key, count(*) AS value FROM lineitem WHERE l_quantity > 49 GROUP BY 1")
def map_clear(spark, sf_dir):
    """A cleared map holds what is put in afterwards, and nothing else."""
    held = by_part(spark, sf_dir, COUNT, None).clear()
    return held.insert(lines(spark, sf_dir), "l_partkey", where=F.col("l_quantity") > 49).entries()


@query("SELECT count(DISTINCT l_partkey) AS size FROM lineitem")
def map_local_sizes(spark, sf_dir):
    """The entries of each partition as the map lies, added up."""
    return by_part(spark, sf_dir, COUNT, None).local_sizes().agg(F.sum("size").alias("size"))


# --- movement -----------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rank FROM lineitem")
def sort_global_rank(spark, sf_dir):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return movement.global_rank(lines(spark, sf_dir).select(*order), order)


@query("""WITH r AS (SELECT l_partkey, row_number() OVER (ORDER BY l_partkey) AS place, count(*) OVER () AS n FROM lineitem), s AS (SELECT unnest(range(1, 8)) AS split)
SELECT CAST(split AS INTEGER) AS split, l_partkey AS value FROM s JOIN r ON place = ceil(n * split / 8.0)""")
def sort_splitters(spark, sf_dir):
    return movement.splitters(lines(spark, sf_dir), "l_partkey", 8)


@query("SELECT CAST((l_partkey > 500)::INT + (l_partkey > 1000)::INT + (l_partkey > 1500)::INT AS INTEGER) AS part, count(*) AS n FROM lineitem GROUP BY 1")
def stable_split(spark, sf_dir):
    return movement.stable_split(lines(spark, sf_dir), "l_partkey", [500, 1000, 1500]).groupBy("part").agg(F.count("*").alias("n"))


@query(f"SELECT CAST({SQL_HASH.format('l_orderkey')} % 16 AS INTEGER) AS bucket, count(*) AS size FROM lineitem GROUP BY 1")
def bucket_sizes(spark, sf_dir):
    return movement.bucket_sizes(lines(spark, sf_dir), F.col("l_orderkey"), 16, hashing.portable60)


@query("SELECT l_returnflag, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS total FROM lineitem GROUP BY 1")
def rebalance_rows(spark, sf_dir):
    """Rows dealt evenly over partitions, none lost."""
    return movement.rebalance(lines(spark, sf_dir), 16).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_partkey").alias("total"))


@query("SELECT event_id AS qid, user_id * 2 AS value FROM events")
def scatter_gather(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("qid"), "user_id")
    return movement.scatter_compute_gather(rows, "user_id", lambda d: d.select("qid", (F.col("user_id") * 2).alias("value")))


@query("SELECT event_id AS qid, user_id, event_type, CASE WHEN user_id % 2 = 0 THEN user_id * 3 END AS value FROM events")
def undistribute_results(spark, sf_dir):
    """Results computed by key, back beside the rows that asked for them."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("qid"), "user_id", "event_type")
    placed = movement.distribute(rows.select("qid", "user_id"), "user_id")
    return movement.undistribute(placed.where("user_id % 2 = 0").select("qid", (F.col("user_id") * 3).alias("value")), rows)


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_suppkey % 2 = 1")
def aux_filter_odd(spark, sf_dir):
    return aux_filter(lines(spark, sf_dir), F.col("l_suppkey") % 2 == 1).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT o_orderkey AS i, o_custkey FROM orders JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 45) ON o_orderkey = l_orderkey")
def aux_filter_two(spark, sf_dir):
    """Rows of one sequence whose companion in a second one satisfies a predicate."""
    base = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"), "o_custkey")
    return aux_filter_by(base, lines(spark, sf_dir).withColumnRenamed("l_orderkey", "i"), F.col("l_quantity") > 45)


SQL_SHARE = SQL_HASH.format("{}") + " % 1000"


@query(f"""WITH m AS (SELECT l_partkey AS key, count(*) AS value FROM lineitem GROUP BY 1),
q AS (SELECT p_partkey AS key FROM part WHERE {SQL_SHARE.format('p_partkey')} >= 250 UNION ALL SELECT p_partkey + 10000000 FROM part WHERE {SQL_SHARE.format('p_partkey + 10000000')} < 250)
SELECT key, coalesce(value, 0) AS value FROM q LEFT JOIN m USING (key)""")
def query_mix_missing(spark, sf_dir):
    """A query set of which a quarter misses."""
    present = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"))
    absent = present.select((F.col("key") + 10_000_000).alias("key"))
    return by_part(spark, sf_dir, COUNT, None).find(query_mix(present, absent, 0.25, hashing.portable60))


@query(f"SELECT p_partkey, p_size FROM part WHERE {SQL_HASH.format('p_partkey')} % 2 = 0")
def query_sample(spark, sf_dir):
    return hash_sample(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey", 2, hashing.portable60)


@query("SELECT CAST((i + 23)::HUGEINT * 11400714819323197 % 2305843009213693951 AS BIGINT) AS key FROM range(5000) AS t(i)")
def generated_keys(spark, sf_dir):
    return unique_keys(spark, 5000)


# --- sketches, hashes, integers -----------------------------------------------


def sql_hll(rows: str, by: str = "", precision: int = sketch.PRECISION, ignored: int = 0) -> str:
    """The estimate of hashes h of ``rows``, by a column: registers, their harmonic mean, linear counting."""
    m, rest, lead = 1 << precision, sketch.HASH_BITS - ignored - precision, f"{by}, " if by else ""
    alpha = 0.7213 / (1 + 1.079 / m)
    return f"""g AS (SELECT {lead}(h >> {rest}) & {m - 1} AS register, max({rest + 1} - length(ltrim(bin(h & {(1 << rest) - 1}), '0'))) AS rank FROM {rows} GROUP BY {lead}register),
e AS (SELECT {lead}count(*) AS held, {alpha * m * m} / (sum(pow(2.0, -rank)) + {m} - count(*)) AS raw FROM g {"GROUP BY " + by if by else ""}),
x AS (SELECT {lead}CAST(floor(CASE WHEN raw <= {2.5 * m} AND held < {m} THEN {float(m)} * ln({float(m)} / ({m} - held)) ELSE raw END + 0.5) AS BIGINT) AS estimate FROM e)"""


def _whole(estimates: DataFrame) -> DataFrame:
    return estimates.withColumn("estimate", F.floor(F.col("estimate") + 0.5))


@query(f"WITH r AS (SELECT {SQL_HASH.format('l_partkey')} AS h FROM lineitem), {sql_hll('r')} SELECT estimate FROM x")
def hll_distinct(spark, sf_dir):
    """The estimated number of parts from registers of their hashes."""
    return _whole(sketch.register_estimate(sketch.registers(lines(spark, sf_dir), hashing.portable60(F.col("l_partkey")))))


@query(f"WITH r AS (SELECT {SQL_HASH.format('l_orderkey')} AS h FROM lineitem), {sql_hll('r')} SELECT estimate FROM x")
def hll_merge(spark, sf_dir):
    """Sketches by return flag, merged, estimate the union."""
    parts = sketch.registers(lines(spark, sf_dir), hashing.portable60(F.col("l_orderkey")), ["l_returnflag"])
    return _whole(sketch.register_estimate(sketch.merged_registers(parts)))


@query(f"WITH r AS (SELECT {SQL_HASH.format('l_orderkey')} AS h, h >> 56 AS bucket FROM lineitem), {sql_hll('r', 'bucket', 10, 4)} SELECT bucket, estimate FROM x")
def hll_by_bucket(spark, sf_dir):
    """The estimate of each destination, whose number the leading four bits are."""
    rows = lines(spark, sf_dir).select(hashing.portable60(F.col("l_orderkey")).alias("h"))
    parts = sketch.registers(rows.withColumn("bucket", F.shiftright("h", 56)), F.col("h"), ["bucket"], 10, 4)
    return _whole(sketch.register_estimate(parts, ["bucket"], 10))


@query(f"WITH r AS (SELECT {SQL_HASH.format('l_orderkey')} AS h, h >> 56 AS bucket FROM lineitem), {sql_hll('r', 'bucket', 10, 4)} SELECT CAST(sum(estimate) AS BIGINT) AS total, count(*) AS buckets FROM x")
def hll_average(spark, sf_dir):
    """What the estimates of all destinations come to."""
    return hll_by_bucket(spark, sf_dir).agg(F.sum("estimate").alias("total"), F.count("*").alias("buckets"))


def sql_steps(source: str, steps: list[tuple[str, str]]) -> str:
    """``source`` with a column for each step, which may use those before."""
    for name, expression in steps:
        source = f"(SELECT *, {expression} AS {name} FROM {source})"
    return source


def _sql_hashes() -> str:
    """Published hashes (seed 43) of four bytes, word w, in 128-bit integers."""
    b32, b64 = 1 << 32, 1 << 64
    u = lambda x: f"CAST({x} AS UHUGEINT)"
    times = lambda x, y, b: f"({x} * {u(y)} % {u(b)})"
    turned = lambda x, by, bits: f"({x} * {u(1 << by)} % {u(1 << bits)} + {x} // {u(1 << (bits - by))})"
    shifted = lambda x, by: f"xor({x}, {x} // {u(1 << by)})"
    steps: list[tuple[str, str]] = []

    def add(name: str, expression: str) -> str:
        steps.append((name, expression))
        return name

    def mix32(x: str, name: str) -> str:
        for k, (by, factor) in enumerate(((16, 0x85EBCA6B), (13, 0xC2B2AE35))):
            x = add(f"{name}{k}", times(shifted(x, by), factor, b32))
        return add(name, shifted(x, 16))

    def mix64(x: str, name: str) -> str:
        for k, factor in enumerate((0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)):
            x = add(f"{name}{k}", times(shifted(x, 33), factor, b64))
        return add(name, shifted(x, 33))

    add("k1", times("w", 0xCC9E2D51, b32))
    add("k2", times(turned("k1", 15, 32), 0x1B873593, b32))
    add("k3", f"xor({u(43)}, k2)")
    add("k4", f"xor(({turned('k3', 13, 32)} * {u(5)} + {u(0xE6546B64)}) % {u(b32)}, {u(4)})")
    mix32("k4", "murmur32_")
    add("p1", times("w", 0x87C37B91114253D5, b64))
    add("p2", f"xor(xor({u(43)}, {times(turned('p1', 31, 64), 0x4CF5AD432745937F, b64)}), {u(4)})")
    add("p3", f"(p2 + {u(43 ^ 4)}) % {u(b64)}")
    add("p4", f"(p3 + {u(43 ^ 4)}) % {u(b64)}")
    mix64("p3", "x_")
    mix64("p4", "y_")
    add("q1", times("w", 0x239B961B, b32))
    add("q2", f"xor(xor({u(43)}, {times(turned('q1', 15, 32), 0xAB0E9789, b32)}), {u(4)})")
    add("q3", f"(q2 + {u(3 * (43 ^ 4))}) % {u(b32)}")
    add("q4", f"(q3 + {u(43 ^ 4)}) % {u(b32)}")
    mix32("q3", "r_")
    mix32("q4", "s_")
    add("t1", f"(r_ + {u(3)} * s_) % {u(b32)}")
    add("t2", f"(s_ + t1) % {u(b32)}")
    add("m64", f"(x_ + y_) % {u(b64)}")
    add("m128", f"t1 + t2 * {u(b32)}")
    mix32("w", "finalizer_")
    signed = lambda x: f"CAST(CAST({x} AS HUGEINT) - CASE WHEN {x} >= {u(1 << 63)} THEN {b64}::HUGEINT ELSE 0 END AS BIGINT)"
    byte = "list_reduce(list_prepend(xor(c, b), range(8)), lambda d, i: xor(d // 2, 2197175160 * (d % 2)))"
    crc = f"list_reduce(list_prepend(4294967295, [ascii(x) for x in string_split(word, '')]), lambda c, b: {byte})"
    source = "(SELECT p_partkey, lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') AS word FROM part)"
    word = " + ".join(f"ascii(substr(word, {i + 1}, 1)) * {256**i}::BIGINT" for i in range(4))
    source = f"(SELECT *, {u(word)} AS w FROM {source})"
    return f"""SELECT p_partkey, CAST(murmur32_ AS BIGINT) AS murmur32, {signed("m64")} AS murmur64, {signed("m128")} AS murmur128, CAST(xor({crc}, 4294967295) AS BIGINT) AS crc32c, CAST(finalizer_ AS BIGINT) AS finalizer32, p_partkey AS low
FROM {sql_steps(source, steps)}"""


@query(_sql_hashes())
def hash_published(spark, sf_dir):
    """Values of the published hash functions."""
    word = F.lpad((F.col("p_partkey") % 10_000).cast("string"), 4, "0")
    letters = [F.ascii(F.substring(word, i + 1, 1)).cast("long") * 256**i for i in range(4)]
    functions = {"murmur32": hashing.murmur3_32, "murmur64": hashing.murmur3_64, "murmur128": hashing.murmur3_x86_128, "crc32c": hashing.crc32c}
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        *[hashing.hashed(word, f).alias(n) for n, f in functions.items()],
        hashing.finalizer32(letters[0] + letters[1] + letters[2] + letters[3]).alias("finalizer32"),
        hashing.identity(F.col("p_partkey")).alias("low"),
    )


@query(f"SELECT CAST({SQL_HASH.format('l_orderkey')} % 64 AS INTEGER) AS bucket, count(DISTINCT l_orderkey) AS keys FROM lineitem GROUP BY 1")
def hash_spread(spark, sf_dir):
    """How evenly a hash spreads the keys over buckets."""
    bucket = F.pmod(hashing.portable60(F.col("l_orderkey")), F.lit(64)).cast("int")
    return lines(spark, sf_dir).groupBy(bucket.alias("bucket")).agg(F.count_distinct("l_orderkey").alias("keys"))


@query("""SELECT p_partkey, CAST(power(2, ceil(log2(greatest(p_partkey, 1)))) AS BIGINT) AS next_power, CAST(CASE WHEN p_partkey = 0 THEN 0 ELSE length(ltrim(bin(p_partkey), '0')) END AS INTEGER) AS top_bit,
CAST(gcd(p_partkey, p_size) AS BIGINT) AS gcd, CAST(lcm(p_partkey, p_size) AS BIGINT) AS lcm FROM part""")
def integer_helpers(spark, sf_dir):
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", numbers.next_power_of_2(key).alias("next_power"), numbers.leftmost_set_bit(key).alias("top_bit"), numbers.gcd(key, F.col("p_size")).alias("gcd"), numbers.lcm(key, F.col("p_size")).alias("lcm"))


# --- streaming ----------------------------------------------------------------


@query("SELECT user_id AS key, count(*) AS value FROM events GROUP BY 1")
def stream_event_count(spark, sf_dir):
    """A counting map over a stream of files, read to its end."""
    path = f"{sf_dir}/event[s].parquet"
    schema = spark.read.parquet(path).schema
    stream = stream_counts(file_stream(spark, path, schema), "user_id")
    return run_to_folder(stream, scratch(spark)).select("key", "value")
