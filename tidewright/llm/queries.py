"""The registered queries of the text operators, with SQL oracles where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tidewright
from tidewright.llm import conversations, decontaminate, lines, neardup, packing, pages, passages, quality, suffixes
from tidewright.llm import topk, toxicity, urls, whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: the rules of op7: host, path, action
URL_RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    # Python workers started elsewhere must find this package; on a cluster it is installed or sent along
    spark.sparkContext.environment.setdefault("PYTHONPATH", os.path.dirname(os.path.abspath(tidewright.__path__[0])))
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable:
    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query(
    "op1_line_dedup",
    r"""
    WITH lines AS (
        SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
        FROM documents),
    keyed AS (
        SELECT *, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz') AS key
        FROM lines),
    repeated AS (
        SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10
        GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
    judged AS (
        SELECT k.doc_id, pos, line, coalesce(k.doc_id > r.first, false) AS dropped
        FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
    FROM judged GROUP BY doc_id
    """,
)
def op1(spark: SparkSession, directory: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, directory, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", "kept_sha256")


@query("op2_best_fit_packing")
def op2(spark: SparkSession, directory: str) -> DataFrame:
    return packing.pack_documents(table(spark, directory, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op3_quality_rules")
def op3(spark: SparkSession, directory: str) -> DataFrame:
    rows = quality.ledger(quality.measure(table(spark, directory, "documents")))
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~quality.passes(quality.BASE)).alias("base_failed"),
        quality.passes(quality.STANDARD).alias("kept"),
        "failed",
    )


@query("op4_html_extraction")
def op4(spark: SparkSession, directory: str) -> DataFrame:
    return pages.extract(table(spark, directory, "pages"))


def not_held_out(labels: DataFrame) -> DataFrame:
    """The labels that may be learned from."""
    return labels.filter(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0)


@query("op5_toxicity")
def op5(spark: SparkSession, directory: str) -> DataFrame:
    docs = table(spark, directory, "documents")
    model = toxicity.fit(docs, not_held_out(table(spark, directory, "labels")))
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id",
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query("op6_benchmark_decontamination")
def op6(spark: SparkSession, directory: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, directory, "documents"), table(spark, directory, "benchmark"))


@query(
    "op7_url_filters",
    r"""
    WITH rules(rhost, rpath, action) AS (
        VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
               ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
    parts AS (
        SELECT page_id, url,
               translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                         'abcdefghijklmnopqrstuvwxyz') AS host,
               coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
        FROM pages),
    fits AS (
        SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule,
               arg_max(action, length(rhost || rpath)) AS action
        FROM parts, rules
        WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
        GROUP BY page_id)
    SELECT p.page_id, host, path, rule, coalesce(action, 'allow') AS verdict
    FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id
    """,
)
def op7(spark: SparkSession, directory: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, action string")
    out = urls.judge_urls(table(spark, directory, "pages"), rules)
    return out.select("page_id", "host", "path", "rule", "verdict")


@query("op8_substring_dedup")
def op8(spark: SparkSession, directory: str) -> DataFrame:
    out = passages.dedup_passages(table(spark, directory, "documents"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op10_suffix_array_dedup")
def op10(spark: SparkSession, directory: str) -> DataFrame:
    out = suffixes.dedup_bytes(table(spark, directory, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op9_minhash_near_dedup")
def op9(spark: SparkSession, directory: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, directory, "documents"))


@query("op11_conversation_repair")
def op11(spark: SparkSession, directory: str) -> DataFrame:
    return conversations.repair(conversations.damage(table(spark, directory, "conversations")), lost="lost")


@query(
    "op12_exact_topk",
    r"""
    WITH whole AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
        FROM embeddings
        WHERE embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
    flat AS (
        SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS i FROM whole),
    pairs AS (
        SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score
        FROM flat q JOIN flat c ON q.i = c.i AND q.vec_id <> c.vec_id AND q.vec_id % 100 = 0
        GROUP BY ALL),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM pairs)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
)
def op12(spark: SparkSession, directory: str) -> DataFrame:
    return topk.search(table(spark, directory, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op13_embedding_whitening")
def op13(spark: SparkSession, directory: str) -> DataFrame:
    return whiten.whiten(table(spark, directory, "embeddings"))
