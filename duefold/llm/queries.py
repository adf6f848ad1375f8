"""The registered queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from duefold.llm import (
    conversation_repair,
    exact_dedup,
    hamming_topk,
    language_id,
    license_scan,
    mixing,
    multi_index,
    oracles,
    packing,
    passages,
    quality,
    ranked_search,
    sharding,
    simhash,
)
from duefold.llm.common import workers_find_package
from duefold.llm.settings import TOKENIZER

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(function):
        @wraps(function)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            workers_find_package(spark)
            return function(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@_query(
    "op1_exact_dedup",
    """
    WITH d AS (
      SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                      'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
      FROM documents
    ), g AS (
      SELECT *, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
             count(*) OVER (PARTITION BY text_sha256) AS group_size
      FROM d
    )
    SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM g
    """,
)
def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, folder, "documents"))


@_query("op2_license_scan")
def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, folder, "documents"))


@_query("op3_simhash_near_dedup")
def op3_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_groups(_table(spark, folder, "documents"))


@_query("op4_language_id")
def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identify(_table(spark, folder, "documents"))


@_query(
    "op5_topk_search",
    """
    WITH e AS (
      SELECT vec_id, [coalesce(x > 0 AND NOT isnan(x), false) FOR x IN embedding] AS signs
      FROM embeddings
    ), p AS (
      SELECT q.vec_id AS query_id, n.vec_id AS neighbor_id,
             list_sum([(q.signs[i] <> n.signs[i])::INT FOR i IN range(1, 65)])::INT AS distance
      FROM e q JOIN e n ON q.vec_id % 20 = 0 AND q.vec_id <> n.vec_id
    ), r AS (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id)::INT AS rank
      FROM p
    )
    SELECT query_id, neighbor_id, distance, rank FROM r WHERE rank <= 10
    """,
)
def op5_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    return hamming_topk.nearest_signs(_table(spark, folder, "embeddings"))


@_query("op6_quality")
def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score_quality(
        _table(spark, folder, "documents"), _table(spark, folder, "labels")
    )


@_query("op7_sharding")
def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, folder, "documents"))


@_query("op8_substring_dedup")
def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return passages.repeated_passages(_table(spark, folder, "documents"))


@_query("op9_packing")
def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"), TOKENIZER)


@_query(
    "op10_mixing",
    r"""
    WITH RECURSIVE d AS (
      SELECT doc_id, source, coalesce('+' || source, '') AS source_key,
             CASE WHEN text IS NULL THEN 0
                  ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size
      FROM documents
    ), s AS (
      SELECT source_key, any_value(source) AS source, sum(size)::BIGINT AS source_size
      FROM d GROUP BY source_key
    ), w AS (
      SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT
                AS weight
      FROM s
    ),
    -- Reshare by weight what is above twice a source's size, until none is above.
    r AS (
      SELECT 0 AS step, *, false AS filled,
             (sum(source_size) OVER () * 3)::BIGINT AS part, (sum(weight) OVER () * 2)::BIGINT AS parts
      FROM w
      UNION ALL
      SELECT step + 1, source_key, source, source_size, weight, filled,
             (part - coalesce(sum(source_size * 4) FILTER (filled AND NOT was_full) OVER (), 0))::BIGINT,
             (parts - coalesce(sum(weight * 2) FILTER (filled AND NOT was_full) OVER (), 0))::BIGINT
      FROM (
        SELECT * EXCLUDE (filled), filled AS was_full,
               filled OR part * weight > parts * source_size * 2 AS filled,
               bool_or(NOT filled AND part * weight > parts * source_size * 2) OVER () AS more
        FROM r
      ) WHERE more
    ), t AS (
      SELECT source_key, source_size,
             CASE WHEN filled THEN (source_size * 2)::DOUBLE
                  ELSE (part * weight)::DOUBLE / parts::DOUBLE END AS target
      FROM r WHERE step = (SELECT max(step) FROM r)
    ), c AS (
      SELECT d.*, t.* EXCLUDE (source_key),
             CASE WHEN source_size = 0 THEN 0
                  ELSE floor(target / source_size * 16777216) END::BIGINT AS rate,
             ('0x' || substr(md5('7:' || d.source_key), 1, 6))::BIGINT AS start,
             greatest(length(bin(size)) - 5, 0) AS shift,
             ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT
               % greatest(16, (count(*) OVER () + 999999) // 1000000) AS salt
      FROM d JOIN t USING (source_key)
    ), n AS (
      SELECT *, row_number() OVER (PARTITION BY source_key
               ORDER BY shift * 32 + (size >> shift), salt, size, doc_id NULLS FIRST) AS nth
      FROM c
    )
    SELECT doc_id, size, source_size, target,
           (((nth * rate + start) >> 24) - (((nth - 1) * rate + start) >> 24)) * size AS taken
    FROM n
    """,
)
def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_report(_table(spark, folder, "documents"))


@_query("op11_conversation_repair", oracles.CONVERSATION_REPAIR)
def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    conversations = _table(spark, folder, "conversations")
    return conversation_repair.repair_report(
        conversation_repair.damaged(conversations), conversations
    )


@_query("op12_nearest_neighbours")
def op12_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return multi_index.nearest(_table(spark, folder, "embeddings"))


@_query("op13_ranked_search", oracles.RANKED_SEARCH)
def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.ranked_search(
        _table(spark, folder, "documents"), _table(spark, folder, "benchmark")
    )


@_query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)
