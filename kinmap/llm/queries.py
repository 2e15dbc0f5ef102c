"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmap.llm.common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinmap.llm.quality import clean_lines

    return clean_lines(table(spark, sf_dir, "documents"), with_text=False)


OP1_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d
), f AS (
  SELECT r, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars FROM w
), g AS (
  SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS x
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM g) WHERE n > 1
), rep AS (
  SELECT r, count(DISTINCT i + j)::BIGINT AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS j) GROUP BY r
), l AS (
  SELECT r, i, ls[i] AS line FROM (SELECT r, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT r, string_split(t, chr(10)) AS ls FROM d))
), m AS (
  SELECT r, i, line, length(line)::BIGINT AS c, row_number() OVER (PARTITION BY r, line ORDER BY i) AS k,
    len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n, len(regexp_extract_all(line, '[.!?…]+')) AS marks,
    len(regexp_extract_all(line, '[|»›·•]')) AS separators, len(regexp_extract_all(line, '[#*$%&|<>]')) AS symbols,
    regexp_matches(regexp_replace(line, '[\x20\x09-\x0D]+$', ''), '[.!?…:;"''”’»)\]]$') AS ended,
    regexp_matches(line, '(?i)all rights reserved|licensed under|released under the|copyright (?:\(c\)|©|[0-9]{4})|privacy policy|cookie policy|(?:uses?|accept) cookies|terms of (?:use|service)|enable javascript|powered by|click here|sign in|log in|subscribe (?:now|to)|share (?:on|this)|read more|lorem ipsum') AS boilerplate
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), b AS (
  SELECT *, (NOT ended AND marks * 40 < n) OR (100 * marks > 50 * n AND n > 3) OR 100 * symbols > 20 * n
    OR (separators >= 3 AND 100 * separators >= 20 * n) OR boilerplate AS bad FROM m
), s AS (
  SELECT r, count(*) FILTER (k > 1) AS n_dup_lines, count(*) AS n_lines, count(*) FILTER (bad) AS n_lines_removed,
    sum(c)::BIGINT AS line_chars, coalesce(sum(c) FILTER (bad), 0)::BIGINT AS lost_chars FROM b GROUP BY r
), a AS (
  SELECT doc_id, n_words, word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_lines_removed, 0)::BIGINT AS n_lines_removed,
    coalesce(line_chars, 0)::BIGINT AS line_chars, coalesce(lost_chars, 0)::BIGINT AS lost_chars
  FROM d JOIN f USING (r) LEFT JOIN rep USING (r) LEFT JOIN s USING (r)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost_chars <= 50 * line_chars AS kept FROM a
"""

def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinmap.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinmap.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinmap.llm.decontaminate import find_contamination

    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinmap.llm.pii import BASE_KINDS, find_pii

    found = find_pii(table(spark, sf_dir, "documents"), with_text=False)
    listed = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *(count(k) for k in BASE_KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinmap.llm.tokenstore import write_store

    return write_store(table(spark, sf_dir, "documents")).read_digests()


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinmap.llm.langid import identify

    found = identify(table(spark, sf_dir, "documents"))
    return found.withColumn("posterior", F.round("posterior", 6)).withColumnRenamed("accepted", "kept")


def op4_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinmap.llm.warc import write_archive

    return write_archive(table(spark, sf_dir, "pages")).read().select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinmap.llm.sharding import shard_documents

    placed = shard_documents(table(spark, sf_dir, "documents"))
    columns = ("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"))
    return placed.select(*columns, F.lit(None).cast("int").alias("grown_shard"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinmap.llm.html_text import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


def pages_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 9 on web pages: visible text, the html element's declaration, the address's host and suffix."""
    from kinmap.llm.html_text import extract_text
    from kinmap.llm.langid import host_of, identify, markup_language

    pages = table(spark, sf_dir, "pages")
    named = pages.select("page_id", "html", markup_language(F.col("html")).alias("lang"), host_of(F.col("url")).alias("host"))
    found = identify(extract_text(named, keep=["page_id", "lang", "host"]), key="page_id", host="host")
    return found.withColumn("posterior", F.round("posterior", 6))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_sharding": op2_sharding,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_warc_bundles": op4_warc_bundles,
    "op5_html_text": op5_html_text,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_decontamination": op7_decontamination,
    "op8_pii": op8_pii,
    "op9_language_id": op9_language_id,
    "op10_token_store": op10_token_store,
    "pages_language": pages_language,
}
OP7_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS m, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS x
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)
), dw AS (
  SELECT r, i, m, array_to_string(ws[i : i + m - 1], ' ') AS x
  FROM (SELECT r, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(ws) >= m)
), h AS (
  SELECT r, i, dw.m, item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.x = bw.x
), p AS (
  SELECT r, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM h) GROUP BY r
), n AS (
  SELECT r, count(*)::BIGINT AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM h) GROUP BY r
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN n USING (r)
"""

ORACLES: dict[str, str] = {"op1_quality_rules": OP1_SQL, "op7_decontamination": OP7_SQL}
