"""The text operators over the given tables, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, filter_audit, html_main, license_scan, media, near_dup, packing, quality, simhash_dup, token_matrix, toxicity, url_filter, whitening
from .common import cut

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.train_url_model(url_filter.labelled_urls(spark))
    judged = url_filter.judge_urls(_read(spark, sf_dir, "pages").select("page_id", "url"), model, URL_RULES)
    return judged.select("page_id", *[f"__sf_verdict.{c}" for c in ("host", "path", "rule", "verdict")])


def url_host_path_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op1 takes from a url before its model: host, path and the longest rule."""
    host, path = url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))
    return _read(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path"), url_filter.rule_for(host, path, URL_RULES)["rule"].alias("rule"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract_main_text(_read(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.encode_documents(_read(spark, sf_dir, "documents"), tokenizer=TOKENIZER)
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_read(spark, sf_dir, "documents")).select("doc_id", "class_id", "copy_of")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = cut(quality.measured(_read(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text"))
    rated = quality.judged(measures)
    return rated.select("doc_id", *[f"__sf_quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def _digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digests(packing.pack_documents(_read(spark, sf_dir, "documents"), tokenizer=TOKENIZER))


def op7_token_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_matrix.token_matrix(_read(spark, sf_dir, "documents"), tokenizer=TOKENIZER)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = media.read_avi(media.write_avi(_read(spark, sf_dir, "documents")))
    size = F.octet_length("payload")
    clips = F.concat_ws(",", F.transform("clips", lambda c: F.format_string("%.2f-%.2f", c["start_s"], c["end_s"])))
    return read.select("doc_id", "n_bytes", size.cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.expr("substring(payload, octet_length(payload) - 63, 64)")).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.concat(F.lit("shots in seconds: "), clips).alias("feature"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_read(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _read(spark, sf_dir, "labels"))
    held_out = F.coalesce(toxicity.fold() == 1, F.lit(False))
    return toxicity.score_toxicity(docs, model, name="score").select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dup.simhash_components(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_read(spark, sf_dir, "embeddings"))[0]


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_url_filter, url_host_path_rule, op2_main_text, op3_bpe, op4_near_duplicates, op5_quality_rules, op6_packing, op7_token_matrix, op8_media, op9_license_scan, op10_toxicity, op11_simhash_components, op12_embedding_whitening, op13_filter_audit)}

ORACLE_SQL = {
    "url_host_path_rule": r"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages
), rules AS (SELECT unnest(['org/', 'example.org/es/', 'example.org/en/1', 'com/fr/', 'com/de/']) AS rule
), parts AS (SELECT rule, split_part(rule, '/', 1) AS own, substr(rule, length(split_part(rule, '/', 1)) + 1) AS start FROM rules)
SELECT page_id, host, path, (SELECT arg_max(rule, length(rule)) FROM parts WHERE (host = own OR ends_with(host, '.' || own)) AND starts_with(path, start)) AS rule FROM u
""",
    "op5_quality_rules": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), starts AS (
  SELECT rid, unnest(range(1, len(ws) - 3)) AS i, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) AS w FROM d WHERE len(ws) >= 5
), keyed AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS n FROM starts
), covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM keyed, range(5) r(k) WHERE n >= 2 GROUP BY rid
), lines AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), m AS (
  SELECT d.rid, doc_id, source, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN lines USING (rid) LEFT JOIN covered USING (rid)
), b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
), hosts AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS f FROM b GROUP BY source
), moments AS (SELECT avg(f / n) AS mean, var_pop(f / n) AS var FROM hosts
), prior AS (SELECT mean, CASE WHEN var > 1e-12 AND var < mean * (1 - mean) THEN mean * (1 - mean) / var - 1 ELSE 10.0 END AS weight FROM moments
), rates AS (SELECT source, (f + mean * weight) / (n + weight) AS rate FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate < 0.5 AS kept
FROM b JOIN rates ON b.source IS NOT DISTINCT FROM rates.source
""",
    "op13_filter_audit": r"""
WITH w AS MATERIALIZED (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), least AS (SELECT t, min(doc_id) AS least FROM w GROUP BY t
), m AS MATERIALIZED (
  SELECT doc_id, part, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t),
    regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > least, false)] AS fails
  FROM w JOIN least USING (t)
), marks AS (SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic FROM labels GROUP BY doc_id
), counts AS MATERIALIZED (
  SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN marks USING (doc_id) GROUP BY ALL
), letters AS (SELECT unnest(range(1, 6)) AS i
), orders AS MATERIALIZED (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o, array_to_string(list_transform([a.i, b.i, c.i, d.i, e.i], lambda x: chr((64 + x)::INT)), '') AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), steps AS (
  SELECT part, filter_order, i::INT AS step, o[i] AS f, n, good, toxic, fails[o[i]] AS own, len(list_filter(o[1:i - 1], lambda x: fails[x])) > 0 AS earlier, len(list_filter(fails, lambda x: x)) AS failed
  FROM counts, orders, letters
), sums AS (
  SELECT part, filter_order, step, f, sum(n * (NOT own AND NOT earlier)::INT)::BIGINT AS kept, sum(n * (own AND NOT earlier)::INT)::BIGINT AS removed, sum(n * (own AND earlier)::INT)::BIGINT AS redundant,
    sum(n * (own AND failed = 1)::INT)::BIGINT AS unique_fails, sum(good * (own AND NOT earlier)::INT)::BIGINT AS good_lost, sum(toxic * (own AND NOT earlier)::INT)::BIGINT AS toxic_lost
  FROM steps GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM sums
""",
}
