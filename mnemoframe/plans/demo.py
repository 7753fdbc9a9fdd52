"""A memory graph derived from the driver's tables, for queries and tests.

Each table exists twice, as Spark SQL and as DuckDB SQL (``CTES``), so that an
oracle starts from the same rows without sharing any operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_EVENTS = """
SELECT concat('e', event_id) AS id, concat(event_type, ' by user ', user_id) AS summary, event_type AS action, concat('lot ', event_id % 13) AS causality,
  {epoch} + event_id % 7 AS last_active, {epoch} AS timestamp, {epoch} AS created_at, {epoch} AS valid_from, CAST(NULL AS BIGINT) AS valid_to,
  CASE WHEN event_id % 10 = 0 THEN 'archived' WHEN event_id % 10 = 1 THEN 'merged' ELSE 'active' END AS status,
  1 + event_id % 4 AS support_count, props AS payload, {k} AS k, user_id, event_type, event_id AS n,
  concat('s', event_id % 97) AS session_id, CASE WHEN event_id % 11 = 0 THEN concat('e', event_id - 1) END AS parent_event_id, CASE WHEN event_id % 5 = 0 THEN concat('t', user_id) END AS thread_id
FROM events
"""
_CONTEXTS = """
SELECT concat('c', doc_id) AS id, 'context' AS context_type, CASE lang WHEN 'en' THEN 'situation' WHEN 'fr' THEN 'constraint' ELSE 'environment' END AS subtype,
  concat(source, ' ', lang, ' ', doc_id) AS summary, text AS description, source AS subject, concat('read from ', source) AS condition, '' AS applies_when,
  CAST(0.2 + (doc_id % 9) / 10.0 AS DOUBLE) AS confidence, 1 + doc_id % 5 AS support_count, 1700000000 + doc_id * 3600 AS last_seen_at, 1700000000 + doc_id * 3600 AS updated_at,
  1700000000 + doc_id * 1800 AS created_at, 1700000000 + doc_id * 1800 AS valid_from, CAST(NULL AS BIGINT) AS valid_to, CASE WHEN doc_id % 9 = 0 THEN 'deprecated' ELSE 'active' END AS status, doc_id AS n
FROM documents
"""
_ENTITIES = """
SELECT concat('user_', user_id) AS id, CASE WHEN user_id % 3 = 0 THEN 'person' ELSE 'UNKNOWN' END AS type, user_id % 2 = 0 AS registered, concat('user number ', user_id) AS description,
  CASE WHEN user_id % 7 = 0 THEN 'merged' ELSE 'active' END AS status, CASE WHEN user_id % 7 = 0 THEN concat('user_', user_id + 1) END AS canonical_id, min(ev) AS created_at
FROM (SELECT user_id, event_id AS ev FROM events) GROUP BY user_id
"""
_INVOLVES = """
SELECT concat('e', event_id) AS event_id, concat('user_', user_id) AS entity_id, 1 + event_id % 3 AS c_valid, {epoch} AS t_created, {epoch} AS t_valid FROM events
UNION ALL SELECT concat('e', event_id), concat('kind_', event_type), 1, {epoch}, {epoch} FROM events WHERE event_id % 2 = 0
"""
_IN_REL = """
SELECT concat('e', e.event_id) AS event_id, concat('c', d.doc_id) AS context_id, CAST(0.3 + (e.event_id % 7) / 10.0 AS DOUBLE) AS confidence, CAST(1.0 + (e.event_id % 4) AS DOUBLE) AS weight, {epoch} AS updated_at
FROM events e CROSS JOIN (SELECT max(doc_id) + 1 AS n FROM documents) t JOIN (SELECT doc_id FROM documents) d ON d.doc_id = e.event_id % t.n
"""
_RELATION = """
SELECT concat('e', event_id) AS from_id, concat('e', event_id + 1) AS to_id, CASE event_id % 4 WHEN 0 THEN '意义更新' WHEN 1 THEN '补充' WHEN 2 THEN 'merge' ELSE '时序相邻' END AS relation_type,
  CASE event_id % 2 WHEN 0 THEN 'supersedes' ELSE 'co_recall' END AS operation, CAST(0.5 + (event_id % 5) / 10.0 AS DOUBLE) AS confidence, {epoch} AS created_at, {epoch} AS updated_at FROM events
"""
_STATE = """
SELECT concat('e', event_id) AS id, {epoch} AS timestamp, concat('user_', user_id) AS entity, event_type AS attribute, CAST({k} AS {text}) AS value_after, CAST(NULL AS {text}) AS value_before FROM events
"""
_PARTS = {"events": _EVENTS, "contexts": _CONTEXTS, "entities": _ENTITIES, "involves": _INVOLVES, "in_rel": _IN_REL, "event_relation": _RELATION, "states": _STATE}
_SPARK = {"epoch": "timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)", "k": "CAST(get_json_object(props, '$.k') AS BIGINT)", "text": "STRING"}
_DUCK = {"epoch": "CAST(floor(epoch(ts)) AS BIGINT)", "k": "CAST(json_extract_string(props, '$.k') AS BIGINT)", "text": "VARCHAR"}


def graph(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The graph's tables as DataFrames."""
    read = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("events", "documents")}
    return {name: spark.sql(body.format(**_SPARK).replace("FROM events", "FROM {events}").replace("FROM documents", "FROM {documents}"), **read) for name, body in _PARTS.items()}


def ctes(*names: str) -> str:
    """WITH clause of the same tables (prefixed g_) for DuckDB."""
    return "WITH " + ", ".join(f"g_{n} AS ({_PARTS[n].format(**_DUCK)})" for n in names)
