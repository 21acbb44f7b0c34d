"""The registered queries of the training-data operators, and the oracle SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE_SQL: dict[str, str] = {}


def register(fn: QueryFn) -> QueryFn:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register
def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


#: The rules of the url query.
URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


@register
def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import filter_urls

    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, URL_RULES)) + " AS rules(host, path, verdict)")
    return filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL["op4_url_filters"] = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw_host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), named AS (
  SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts
), rules(rule_host, rule_path, verdict) AS (VALUES {", ".join(map(str, URL_RULES))}),
urls AS (SELECT DISTINCT host, path FROM named),
fits AS (
  SELECT host, path, rule_host || rule_path AS rule, verdict,
         row_number() OVER (PARTITION BY host, path ORDER BY length(rule_host || rule_path) DESC) AS place
  FROM urls JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT n.page_id, n.host, n.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM named n LEFT JOIN fits f ON n.host = f.host AND n.path = f.path AND f.place = 1
"""


@register
def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_facts, write_media
    from .words import store

    places = store(write_media(_table(spark, sf_dir, "documents")), "media-places")
    return media_facts(places).selectExpr(
        "id AS doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "length AS media_bytes", "media_sha256", "feature",
        "width", "height", "shard", "offset")


@register
def op5_token_id_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .records import read_records, write_records

    files = write_records(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_records(files).withColumnRenamed("id", "doc_id")


@register
def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@register
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"), detail=False)


@register
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .pieces import round_trips

    return round_trips(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@register
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pii_report

    return pii_report(_table(spark, sf_dir, "documents"))


@register
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality

    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@register
def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import language_scores

    return language_scores(_table(spark, sf_dir, "documents"))


@register
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic import looped_tails, periodic_runs

    return periodic_runs(_table(spark, sf_dir, "documents"), rewrite=looped_tails, detail=False)


@register
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(_table(spark, sf_dir, "embeddings"))


@register
def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents"))
