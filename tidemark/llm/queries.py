"""The registered queries, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from .bpe import encode_texts, read_ranks
from .exact_dedup import exact_copies
from .line_dedup import dedup_blocks
from .mixing import mix
from .ngram_join import jaccard_components
from .quality import fit_quality, held_out, score_quality
from .repetition import repetition_rules
from .shared import table
from .substring_dedup import repeated_passages
from .url_filter import judge_urls
from .warc import pages_as_records, resolve_revisits

#: The rules that the contract of op5 fixes: host, path, verdict.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_blocks(docs)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = encode_texts(docs, ranks, public_tokenizers.PATTERN, space_starts=True, decoded_col="decoded", carry=["doc_id"])
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), carry=["doc_id"]).drop("spans")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repetition_rules(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "covered_words", "longest_repeat",
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=4, percent=85, parts=True)


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return resolve_revisits(pages_as_records(pages)).select(
        F.expr("(record_id - 1) div 2").alias("page_id"),
        F.expr("refers_to div 2").alias("response_of"),
        "state",
        F.array_join(
            F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n"
        ).alias("headers"),
        F.sha2(F.col("payload").cast("binary"), 256).alias("payload_sha256"),
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = fit_quality(docs, table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))))
    return score_quality(docs, weights).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_mixing": op3_mixing,
    "op4_quality_rules": op4_quality_rules,
    "op5_url_filter": op5_url_filter,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_warc_revisits": op7_warc_revisits,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_quality_classifier": op10_quality_classifier,
}

ORACLE_SQL = {
    "op5_url_filter": """
WITH u AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), rules(h, p, v) AS (VALUES """
    + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    + """), fit AS (
  SELECT u.page_id, u.host, u.path, h || p AS rule, v,
    row_number() OVER (PARTITION BY u.page_id, u.host, u.path ORDER BY length(h || p) DESC NULLS LAST) AS k
  FROM u LEFT JOIN rules ON (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, p)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM fit WHERE k = 1
""",
    "op7_warc_revisits": """
WITH b AS (SELECT page_id, html, regexp_replace(url, '(?s)#.*$', '') AS u FROM pages),
c AS (
  SELECT page_id, html, md5(html) AS m, CASE WHEN regexp_matches(u, '(?s)^[^:/?]*://') THEN
    lower(regexp_extract(u, '(?s)^([^:/?]*)://', 1)) || '://' ||
    regexp_replace(lower(regexp_extract(u, '(?s)^[^:/?]*://([^/?]*)', 1)),
      CASE lower(regexp_extract(u, '(?s)^([^:/?]*)://', 1)) WHEN 'http' THEN ':80$' WHEN 'https' THEN ':443$' ELSE 'x^' END, '') ||
    CASE WHEN starts_with(regexp_extract(u, '(?s)^[^:/?]*://[^/?]*(.*)$', 1), '/') THEN '' ELSE '/' END ||
    regexp_extract(u, '(?s)^[^:/?]*://[^/?]*(.*)$', 1) ELSE u END AS key
  FROM b
), j AS (
  SELECT r.page_id, r.m, f.page_id AS response_of, f.m AS fm, f.html AS fhtml
  FROM (SELECT *, 2 * (page_id + 500) + 1 AS ts FROM c) r
  ASOF LEFT JOIN (SELECT *, 2 * page_id AS ts FROM c) f ON r.key = f.key AND r.ts > f.ts
)
SELECT page_id, response_of,
  CASE WHEN response_of IS NULL THEN 'missing' WHEN m = fm THEN 'resolved' ELSE 'mismatch' END AS state,
  CASE WHEN m = fm THEN 'cache-control: max-age=3600' || chr(10) || 'content-length: ' || length(fhtml) || chr(10) ||
    'content-type: text/html' || chr(10) || 'etag: W/"' || m || '"' END AS headers,
  CASE WHEN m = fm THEN sha256(fhtml) END AS payload_sha256
FROM j
""",
    "op8_exact_dedup": """
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
""",
}
