"""Relations that the queries run on, derived from the driver tables.

Each is one SELECT that Spark and DuckDB read alike, so both sides of a check start
from the same rows: conversations with injected noise as messages and as stored
episodes, documents as memory files, conversation texts as facts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_NL = "chr(10)"

MESSAGES = f"""
SELECT 'conv-' || CAST(conv_id AS STRING) AS session_key, conv_id, CAST(turn AS BIGINT) AS idx, role,
  CASE (conv_id * 7 + turn) % 13
    WHEN 0 THEN '<memory-context>' || {_NL} || 'old fact' || {_NL} || '</memory-context>' || {_NL} || text
    WHEN 1 THEN text || {_NL} || '<memory-continuity>a' || {_NL} || 'b</memory-continuity> end'
    WHEN 2 THEN '<relevant-memories>x</relevant-memories>' || text || '<relevant-memories>y</relevant-memories>'
    WHEN 3 THEN '```json' || {_NL} || '{{"schema": "inbound_meta.v1", "n": 1}}' || {_NL} || '```' || {_NL} || text
    WHEN 4 THEN text || {_NL} || '[Subagent Context] depth 1' || {_NL} || 'done'
    WHEN 5 THEN '[Mon 2026-03-15 14:00 UTC] ' || text || {_NL} || '[Tue 2026-03-16 09:30 CEST]  later'
    WHEN 6 THEN text || {_NL} || {_NL} || {_NL} || {_NL} || 'after blanks' || {_NL} || '  '
    WHEN 7 THEN 'As we discussed, keep going: ' || text
    WHEN 8 THEN 'short text of 20 chr'
    WHEN 10 THEN '```json' || {_NL} || CASE WHEN turn % 2 = 0 THEN '{{"label": "a", "sender": "b"}}' ELSE '{{"n": {{"sender": "b"}}, "label": "a"}}' END || {_NL} || '```' || {_NL} || text
    WHEN 9 THEN '<memory-context>all of it is recalled</memory-context>'
    ELSE text END AS content
FROM conversations
"""

EPISODES = """
SELECT 'ep-' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS uuid,
  CASE WHEN turn % 5 = 4 THEN NULL WHEN turn % 5 = 3 THEN 'turn-s' || CAST(conv_id % 29 AS STRING) || '-1' ELSE 'batch-1' END AS name,
  '2026-' || lpad(CAST(1 + conv_id % 12 AS STRING), 2, '0') || '-' || lpad(CAST(1 + (conv_id * 5 + turn) % 28 AS STRING), 2, '0') || 'T' || lpad(CAST(turn % 24 AS STRING), 2, '0') || ':30:00.000Z' AS created_at,
  CASE (conv_id + turn) % 7
    WHEN 0 THEN '{"event":"after_turn","session_key":"s' || CAST(conv_id % 29 AS STRING) || '","thread_id":"t' || CAST(turn % 3 AS STRING) || '"}'
    WHEN 1 THEN '{"event":"compact","session_key":"s' || CAST(conv_id % 29 AS STRING) || '"}'
    WHEN 2 THEN 'session=s' || CAST(conv_id % 29 AS STRING) || ' event=old'
    WHEN 3 THEN 'null'
    WHEN 4 THEN NULL
    WHEN 5 THEN '{"event":"memory_index","file":"memory/a.md","source":"cli","agent":"x","channel":"web","session_key":"s' || CAST(conv_id % 29 AS STRING) || '"}'
    ELSE '{"event":' END AS source_description,
  CASE WHEN turn % 6 = 5 THEN '' ELSE text END AS content,
  CASE WHEN conv_id % 5 = 0 THEN 'other' ELSE 'core' END AS group_id
FROM conversations
"""

FILES = """
SELECT 'memory/' || source || '/' || CASE lang WHEN 'en' THEN 'note-' || CAST(doc_id AS STRING) || '.md' WHEN 'de' THEN CAST(doc_id AS STRING) || '.TXT' WHEN 'fr' THEN CAST(doc_id AS STRING) || '.json' ELSE 'plain' || CAST(doc_id AS STRING) END AS path,
  CASE WHEN doc_id % 17 = 0 THEN NULL ELSE '2026-02-' || lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0') || 'T00:00:00.000Z' END AS last_modified,
  CAST(octet_length(text) AS BIGINT) AS size, left(text, 500) AS excerpt
FROM documents
"""
FILES_SQL = FILES.replace("octet_length(text)", "strlen(text)")

STATE = """
SELECT path, CASE WHEN size % 3 = 0 THEN '2026-01-01T00:00:00.000Z' ELSE coalesce(last_modified, '2026-01-01T00:00:00.000Z') END AS last_modified, '2026-02-28T00:00:00.000Z' AS last_indexed
FROM files WHERE size % 2 = 0
"""

FACTS = """
SELECT 'fact-' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS uuid, upper(role) AS name, text AS fact,
  CASE WHEN turn % 3 = 0 THEN NULL ELSE '2026-01-01T00:00:00Z' END AS valid_at,
  CASE WHEN turn % 4 = 1 THEN '2026-06-01T00:00:00Z' ELSE NULL END AS invalid_at,
  CASE WHEN conv_id % 5 = 0 THEN 'other' ELSE 'core' END AS group_id
FROM conversations
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _select(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    ((name, given),) = tables.items()
    return spark.sql(sql.replace("{", "{{").replace("}", "}}").replace(f"FROM {name}", "FROM {given}"), given=given)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark, MESSAGES, conversations=table(spark, sf_dir, "conversations"))


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark, EPISODES, conversations=table(spark, sf_dir, "conversations"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark, FILES, documents=table(spark, sf_dir, "documents"))


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark, STATE, files=files(spark, sf_dir))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark, FACTS, conversations=table(spark, sf_dir, "conversations"))
