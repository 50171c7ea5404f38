"""The operators bound to the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm import decontam, harmonic, lm, packing, pii, quality, ranked, rules, sharding, simhash, substring, warc, whitening
from tallyfold.llm.tokens import vocabulary_path


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(read(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = docs.select("doc_id", pii.span_column(pii.fit(docs)).alias("s"))
    base = F.filter("s", lambda s: s["base"])
    counts = (pii.base_count(F.col("s"), k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS[:pii.BASE_KINDS]))
    return found.select("doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"),
                        pii.listed(F.col("s")).alias("spans"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(read(spark, sf_dir, "documents"), vocabulary_path())
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_stop_words", "n_lines")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", (quality.fold_of("doc_id") == 0).alias("held_out"), quality.score_column(docs, model).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    crc = F.crc32(F.coalesce(F.col("text").cast("binary"), F.lit(b"")))
    return sharding.assign_shards(docs, 8, carry={"doc_id": F.col("doc_id"), "text_crc32": crc}).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(read(spark, sf_dir, "documents"), vocabulary_path())


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = decontam.add_hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), "hits")
    ids = F.array_join(F.array_sort(F.transform("hits.items", lambda i: i.cast("string"))), ",")
    return docs.select("doc_id", "hits.n_words", "hits.n_hit", F.size("hits.items").cast("bigint").alias("n_items"),
                       F.sha2(ids, 256).alias("items_sha256"), (F.col("hits.n_hit") > 0).alias("contaminated"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(read(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_harmonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = harmonic.pack_harmonic(read(spark, sf_dir, "documents"), vocabulary_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op13_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.rank_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_substring, op2_simhash, op3_pii, op4_packing, op5_rules, op6_quality, op7_sharding, op8_lm, op9_decontamination,
    op10_warc, op11_harmonic, op12_whitening, op13_ranked)}

_STOP = ", ".join(f"'{w}'" for w in sorted({w for words in rules.STOP_WORDS.values() for w in words}))

# words, their windows, and which words an occurrence covers
ORACLE = {
    "op5_rules": rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT r, i, array_to_string(w[i:i + 2], ' ') AS s FROM d, unnest(range(1, len(w) - 1)) AS u(i)),
f AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, s) > 1),
c AS (SELECT r, count(DISTINCT k) AS n FROM f, unnest([i, i + 1, i + 2]) AS u(k) GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) AS BIGINT) AS n_stop_words, CAST(len(l) AS BIGINT) AS n_lines,
         len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS n_ellipsis,
         len(list_filter(l, lambda x: regexp_matches(x, '^\s*[-•*]\s'))) AS n_bullet
  FROM d LEFT JOIN c USING (r)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * word_chars BETWEEN 200 * n_words AND 1500 * n_words AND 100 * n_symbols <= 30 * n_words
       AND 100 * n_stop_words >= 2 * n_words AND 100 * n_dup_lines <= 50 * n_lines AND 100 * n_ellipsis <= 30 * n_lines
       AND 100 * n_bullet <= 90 * n_lines AS kept, n_stop_words, n_lines
FROM v
""",
    "op10_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS d FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS lowest FROM q)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND page_id > lowest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id > lowest THEN lowest END AS refers_to
FROM f
""",
    "op13_ranked": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
g AS (SELECT CAST(count(*) AS BIGINT) AS a, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
t AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n, term, count(*) AS tf FROM d, unnest(w) AS u(term) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
s AS (
  SELECT item_id, r, doc_id,
         sum(CAST(floor(1000 * ln((2 * a + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * a) // l)))) AS score
  FROM q JOIN f USING (term) JOIN t USING (term), g GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
       doc_id, CAST(score AS BIGINT) AS score
FROM s WHERE score > 0 QUALIFY rank <= 50
""",
    "op9_decontamination": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0),
o AS (
  SELECT DISTINCT r, i, p.n, item_id
  FROM (SELECT r, i, l.n, array_to_string(w[i:i + l.n - 1], ' ') AS s
        FROM d, (SELECT DISTINCT n FROM p) AS l, unnest(range(1, len(w) - l.n + 2)) AS u(i)) AS x
  JOIN p ON p.s = x.s AND p.n = x.n),
h AS (SELECT r, count(DISTINCT k) AS n_hit FROM o, unnest(range(i, i + n)) AS u(k) GROUP BY r),
c AS (SELECT r, count(DISTINCT item_id) AS n_items,
             string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM o GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN c USING (r)
""",
}
