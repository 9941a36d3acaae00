"""Registered queries of this subpackage, and the SQL that states their results where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from larder.llm import chat_format, chunk_dedup, decontaminate, exact_dedup, language_id, packing, secret_scan, simhash_dedup, toxicity, warc

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


@query("op1_simhash_near_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every near copy that goes, with the document of its group that stays."""
    return simhash_dedup.near_groups(table(spark, sf_dir, "documents"))


@query(
    "op2_exact_dedup",
    """
    WITH rows AS (SELECT text, doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text, doc_id),
    span AS (SELECT min(doc_id) + (max(doc_id) - min(doc_id)) // 2 AS cut FROM rows),
    won AS (SELECT *, min(doc_id) OVER (PARTITION BY text) AS kept_id FROM rows)
    SELECT doc_id, kept_id, kept_id <= cut AS in_history,
           copies - CASE WHEN doc_id = kept_id THEN 1 ELSE 0 END AS n_rows
    FROM won, span WHERE doc_id <> kept_id OR copies > 1
    """,
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeat that goes, with the document that stays and whether history held it."""
    return exact_dedup.repeats(table(spark, sf_dir, "documents"))


@query("op10_benchmark_decontamination")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with a benchmark passage: the items, the passages, and the text without them."""
    return decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_chunk_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage that goes because an earlier document has it."""
    return chunk_dedup.repeated_passages(table(spark, sf_dir, "documents"))


@query(
    "op6_chat_format",
    """
    WITH turns AS (
        SELECT DISTINCT conv_id, turn, lower(trim(role)) AS role, replace(text, '<|', '< |') AS text FROM conversations
        WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL AND text IS NOT NULL
    ), shown AS (
        SELECT *, '<|' || replace(role, '<|', '< |') || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown FROM turns
    ), made AS (
        SELECT *, count(*) OVER before AS n_context, coalesce(string_agg(shown, '') OVER before, '') || '<|assistant|>' || chr(10) AS context
        FROM shown
        WINDOW before AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    )
    SELECT conv_id, turn, n_context, context, text || '<|end|>' || chr(10) AS reply, context || text || '<|end|>' || chr(10) AS example,
           length(context) AS train_start, length(context || text || '<|end|>' || chr(10)) AS train_stop
    FROM made WHERE role = 'assistant' AND text <> ''
    """,
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every assistant turn as an example of its own."""
    return chat_format.examples(table(spark, sf_dir, "conversations"))


@query("op7_secret_scan")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every secret that its structure confirms."""
    return secret_scan.scan(table(spark, sf_dir, "documents"))


@query(
    "op8_warc_revisits",
    """
    WITH p AS (SELECT DISTINCT coalesce(page_id, -1) AS page_id, coalesce(url, 'about:blank') AS url, coalesce(html, '') AS html FROM pages),
    d AS (SELECT *, strftime(TIMESTAMP '2024-01-01' + to_seconds(greatest(page_id, 0) % 1000000000), '%Y-%m-%dT%H:%M:%SZ') AS date FROM p),
    r AS (SELECT *, row_number() OVER w AS n, first_value(url) OVER w AS first_url, first_value(date) OVER w AS first_date FROM d WINDOW w AS (PARTITION BY html ORDER BY date, page_id, url))
    SELECT CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS type, url AS uri, date, sha256(html) AS payload,
           CASE WHEN n > 1 THEN first_url END AS refers_to_uri, CASE WHEN n > 1 THEN first_date END AS refers_to_date FROM r
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as archives, deduplicated: every record of the new archives."""
    return warc.crawl_and_deduplicate(table(spark, sf_dir, "pages"))


@query("op4_nnls_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 2,048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op3_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language and how sure it is."""
    return language_id.identify(table(spark, sf_dir, "documents"))


@query("op5_nnpu_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
