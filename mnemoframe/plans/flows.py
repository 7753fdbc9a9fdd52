"""Queries that lead from payloads to stored rows: several operators one after the other, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import consolidation, contexts, entities, resolution
from .lookups import NOW, _query

#: Every document as an event whose payload names two contexts, and a third that does not hold up.
_PAYLOADS = """
SELECT concat('d', doc_id) AS id, 1700000000 + doc_id AS timestamp, doc_id % 2 AS half, doc_id AS n, concat(source, ' ', lang, ' habit; remark ', chr(CAST(97 + doc_id % 11 AS INTEGER))) AS summary,
  CASE lang WHEN 'en' THEN 'situation' WHEN 'fr' THEN 'limit' ELSE 'env' END AS kind, concat(source, '-', doc_id % 40) AS subject,
  concat('{{"contexts":[{{"subtype":"', CASE lang WHEN 'en' THEN 'situation' WHEN 'fr' THEN 'limit' ELSE 'env' END, '","summary":"', source, ' ', lang, ' habit","subject":"', source, '-', doc_id % 40, '","confidence":', 0.25 + (doc_id % 8) / 16.0,
    ',"facts":{{"k', doc_id % 3, '":"v', doc_id % 5, '"}}}},{{"subtype":"env","summary":"remark ', chr(CAST(97 + doc_id % 11 AS INTEGER)), '","subject":"', source, '-', doc_id % 40, '","confidence":0}},{{"subtype":"env","summary":"elsewhere ', doc_id, '"}}, 7]}}') AS payload
FROM {documents}
"""
_SUBTYPE = "CASE kind WHEN 'limit' THEN 'constraint' WHEN 'env' THEN 'environment' ELSE kind END"
_RESOLVED = f"""WITH p AS ({_PAYLOADS.format(documents="documents")}),
  d AS (SELECT id, timestamp AS t, half, subject, {_SUBTYPE} AS subtype, regexp_extract(summary, '^[^;]*') AS summary, CAST(0.25 + (n % 8) / 16.0 AS DOUBLE) AS confidence, 'k' || n % 3 AS k, 'v' || n % 5 AS v FROM p
    UNION ALL SELECT id, timestamp, half, subject, 'environment', regexp_extract(summary, '; (.*)$', 1), 0.6, NULL, NULL FROM p),
  k AS (SELECT *, 'ctx_' || substr(sha256('context|' || subtype || '|' || subject || '|' || summary), 1, 20) AS context_id FROM d),
  f AS (SELECT context_id, string_agg(k || '=' || v, ',' ORDER BY k) AS facts FROM (SELECT context_id, k, v FROM k WHERE k IS NOT NULL QUALIFY row_number() OVER (PARTITION BY context_id, k ORDER BY half, t) = 1) GROUP BY context_id),
  c AS (SELECT context_id, any_value(subtype) AS subtype, any_value(summary) AS summary, count(*) AS support_count, list_reduce(list(confidence ORDER BY half, t), lambda a, b: least(1.0, a * 0.8 + b * 0.2 + 0.012)) AS confidence,
    CASE WHEN count(*) > 1 THEN {NOW} ELSE max(t) END AS last_seen_at, min(t) AS valid_from FROM k GROUP BY context_id)
"""


def _resolved(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = spark.sql(_PAYLOADS, documents=spark.read.parquet(f"{d}/documents.parquet"))
    none = spark.createDataFrame([], "id string")
    first, a = resolution.resolve(resolution.drafts_of(rows.filter("half = 0")), none, NOW, ("subtype", "subject"))
    second, b = resolution.resolve(resolution.drafts_of(rows.filter("half = 1")), first, NOW, ("subtype", "subject"))
    return second, a.unionByName(b)


@_query(f"{_RESOLVED} SELECT context_id AS id, subtype, summary, support_count, round(confidence, 6) AS confidence, last_seen_at, valid_from, coalesce(facts, '') AS facts FROM c LEFT JOIN f USING (context_id)")
def resolved_contexts(spark, d) -> DataFrame:
    """Contexts of payloads, resolved in two batches, the second over what the first left."""
    facts = F.array_join(F.array_sort(F.transform(F.map_entries("facts"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return _resolved(spark, d)[0].select("id", "subtype", "summary", "support_count", F.round("confidence", 6).alias("confidence"), "last_seen_at", "valid_from", facts.alias("facts"))


@_query(f"{_RESOLVED} SELECT k.id AS event_id, context_id, round(greatest(0.3, least(1.0, c.confidence)), 6) AS confidence, round(greatest(0.1, least(5.0, 1 + ln(1 + support_count))), 6) AS weight, k.summary AS evidence_span, t AS updated_at FROM k JOIN c USING (context_id)")
def resolved_edges(spark, d) -> DataFrame:
    """Edges of the same payloads' events to their contexts."""
    contexts, matches = _resolved(spark, d)
    return resolution.edges_of(matches, contexts).select("event_id", "context_id", F.round("confidence", 6).alias("confidence"), F.round("weight", 6).alias("weight"), "evidence_span", "updated_at")


#: Every vector, and another a little aside of it.
_POINTS = {
    "spark": "SELECT 2 * vec_id AS n, embedding AS v FROM {embeddings} UNION ALL SELECT 2 * vec_id + 1, transform(embedding, (x, i) -> CAST(CAST(x AS DOUBLE) + 0.25D * CAST(embedding[(i + 1) % size(embedding)] AS DOUBLE) AS FLOAT)) FROM {embeddings}",
    "duck": "SELECT 2 * vec_id AS n, CAST(embedding AS DOUBLE[]) AS v FROM embeddings UNION ALL SELECT 2 * vec_id + 1, [CAST(CAST(CAST(embedding[i] AS DOUBLE) + 0.25 * CAST(embedding[i % len(embedding) + 1] AS DOUBLE) AS FLOAT) AS DOUBLE) for i in range(1, len(embedding) + 1)] FROM embeddings",
}
_NEAR = "round(greatest(0.0, least(1.0, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))))), 12)"


def _points(spark, d) -> DataFrame:
    return spark.sql(_POINTS["spark"], embeddings=spark.read.parquet(f"{d}/embeddings.parquet"))


@_query(f"""WITH p AS ({_POINTS["duck"]}), e AS (SELECT n, CAST(n AS VARCHAR) AS id, v FROM p WHERE n % 10 <> 0), r AS (SELECT a.id AS id, b.id AS cand_id, b.n AS t, {_NEAR} AS s FROM e a JOIN e b ON a.n <> b.n)
  SELECT id, cand_id, round(s, 6) AS similarity, CAST(row_number() OVER (PARTITION BY id ORDER BY s DESC, t DESC, cand_id) AS INTEGER) AS rank FROM r WHERE s >= 0.8 QUALIFY rank <= 8""")
def near_events_everywhere(spark, d) -> DataFrame:
    """Near events over all active vectors, without a block."""
    status = F.when(F.col("n") % 10 == 0, "archived").otherwise("active")
    e = _points(spark, d).select(F.col("n").cast("string").alias("id"), F.col("v").alias("embedding"), F.col("n").alias("last_active"), F.col("n").alias("timestamp"), status.alias("status"))
    return consolidation.near_pairs(e, search="signatures").select(F.col("a.id").alias("id"), F.col("b.id").alias("cand_id"), F.round("similarity", 6).alias("similarity"), "rank")


@_query(f"""WITH p AS ({_POINTS["duck"]}), c AS (SELECT 'v' || n AS id, n, v, 'Topic ' || n % 200 AS summary, n % 3 AS subtype, 1 + n % 4 AS support FROM p WHERE n % 7 <> 0),
  r AS (SELECT a.id AS x, b.id AS y, b.n AS t, {_NEAR} AS s FROM c a JOIN c b ON a.n <> b.n), near AS (SELECT least(x, y) AS x, greatest(x, y) AS y FROM r WHERE s >= 0.53 QUALIFY row_number() OVER (PARTITION BY x ORDER BY s DESC, t DESC, y) <= 8),
  chain AS (SELECT id AS x, lead(id) OVER (PARTITION BY summary ORDER BY id) AS y FROM c), m AS (SELECT x, y FROM near UNION SELECT x, y FROM chain WHERE y IS NOT NULL),
  j AS (SELECT a.id AS i, b.id AS k, CASE WHEN a.summary = b.summary THEN 1.0 ELSE {_NEAR} END + CASE WHEN a.subtype = b.subtype THEN 0.05 ELSE 0.0 END AS s, (a.support, a.n, a.n, a.id) >= (b.support, b.n, b.n, b.id) AS first FROM m JOIN c a ON a.id = x JOIN c b ON b.id = y)
  SELECT CASE WHEN first THEN i ELSE k END AS canonical_id, CASE WHEN first THEN k ELSE i END AS merged_id, round(least(1.0, s), 4) AS score FROM j WHERE s >= 0.58""")
def context_merge_candidates(spark, d) -> DataFrame:
    """Which contexts of a whole table say the same: by vector and by summary."""
    n = F.col("n")
    c = _points(spark, d).select(F.concat(F.lit("v"), "n").alias("id"), F.concat(F.lit("Topic "), n % 200).alias("summary"), F.lit("").alias("description"), (n % 3).cast("string").alias("subtype"), (1 + n % 4).alias("support_count"), n.alias("last_seen_at"), n.alias("updated_at"), n.alias("created_at"), F.when(n % 7 == 0, "deprecated").otherwise("active").alias("status"), F.col("v").alias("embedding"))
    return contexts.near_merge_candidates(c)


@_query(f"""WITH p AS ({_POINTS["duck"]}), k AS (SELECT *, CASE n % 5 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'PERSON' ELSE 'THING' END AS type FROM (SELECT n // 2 AS n, n % 2 AS asked, v FROM p)),
  r AS (SELECT a.n, b.n AS e, {_NEAR} AS s FROM k a JOIN k b ON a.asked = 1 AND b.asked = 0 AND (a.type = b.type OR a.type = 'UNKNOWN' OR b.type = 'UNKNOWN')),
  t AS (SELECT n, e, s, coalesce(lead(s) OVER w, 0) AS second, row_number() OVER w AS r FROM r WHERE s > 0 WINDOW w AS (PARTITION BY n ORDER BY s DESC, 'e' || e))
  SELECT 'Mention ' || n AS name, 'e' || e AS id, 'vector_high' AS reason, round(s, 6) AS score FROM t WHERE r = 1 AND s >= 0.82 AND s - second > 0.03""")
def mentions_by_vector(spark, d) -> DataFrame:
    """Each vector aside as a mention of the entity that has the vector, among entities of compatible types."""
    type_ = F.when(F.floor(F.col("n") / 2) % 5 == 0, "UNKNOWN").when(F.floor(F.col("n") / 2) % 5 == 1, "person").otherwise("thing")
    rows = _points(spark, d).select(F.floor(F.col("n") / 2).alias("k"), (F.col("n") % 2 == 1).alias("asked"), type_.alias("type"), "v")
    known = rows.filter("not asked").select(F.concat(F.lit("e"), "k").alias("id"), "type", F.col("v").alias("description_embedding"), F.lit(True).alias("registered"))
    found = entities.resolve(rows.filter("asked").select(F.concat(F.lit("Mention "), "k").alias("name"), "type", F.col("v").alias("embedding")), known)
    return found.select("name", "id", "reason", F.round("score", 6).alias("score"))
