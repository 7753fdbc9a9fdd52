"""Queries over the driver's tables, one for each family of operators, and their DuckDB oracles.

Every query runs over its whole tables. Floats are rounded to six digits on
both sides; arrays and maps are given as text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import measures as M
from ..functions import text as T
from ..operators import consolidation, contexts, joins, mutations, patterns, recall, relations, reports, scans, search, task_recall
from ..sources.lines import flatten_json
from . import flows, lookups, memories, texts  # noqa: F401 (they add to lookups)
from .demo import ctes, graph
from .task_oracle import PATTERN, TASK, TASK_BULLETS

NOW = 1_760_000_000
SEARCH = "the erblest thon and the"
LIST_QUERY = "click by user 12"
SEEDS = ["e3", "e9", "e12", "e21", "e30"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as events: newest first by id."""
    status = F.when(F.col("vec_id") % 10 == 0, "archived").otherwise("active")
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding", F.col("vec_id").alias("last_active"), F.col("vec_id").alias("timestamp"), F.col("vec_id").alias("created_at"), status.alias("status"), (1 + F.col("vec_id") % 3).alias("support_count"), F.col("label").cast("string").alias("session_id"), F.lit("").alias("episode_id"), F.lit("{}").alias("payload"), F.concat(F.lit("vector "), "vec_id").alias("summary"), F.lit("").alias("action"), F.lit("").alias("causality"), F.lit(None).cast("long").alias("valid_to"))


def bm25_search(spark, d):
    return search.bm25(_table(spark, d, "documents"), SEARCH, None, "doc_id", "text").select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


def bm25_index(spark, d):
    index = search.write_index(search.build_index(_table(spark, d, "documents"), "doc_id", "text"))
    return search.search_index(index, SEARCH, None).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


def bm25_index_update(spark, d):
    docs = _table(spark, d, "documents")
    index = search.build_index(docs.filter("doc_id % 3 <> 0"), "doc_id", "text")
    index = search.add_to_index(index, docs.filter("doc_id % 2 = 0"), id_col="doc_id", text_expr="text")
    index = search.remove_from_index(index, docs.filter("doc_id % 5 = 0").select(F.col("doc_id").alias("id")))
    return search.index_stats(index).select("n_docs", F.round("avgdl", 6).alias("avgdl"))


def document_frequency(spark, d):
    return search.corpus_frequency([_table(spark, d, "documents")])


def recent_events(spark, d):
    return scans.recent_events(graph(spark, d)["events"], NOW, 10**9, 100).select("id", "last_active", "status")


def list_events(spark, d):
    return scans.list_events(graph(spark, d)["events"], 50, LIST_QUERY, ["active"]).select("id", F.round("score", 6).alias("score"))


def list_contexts(spark, d):
    return scans.list_contexts(graph(spark, d)["contexts"], 40, "the and thon", ["active"]).select("id", F.round("score", 6).alias("score"))


def candidate_contexts(spark, d):
    return recall.candidate_contexts(graph(spark, d)["contexts"], "the and thon", limit=16).select("id", F.round("score", 6).alias("score"))


def events_with_entities(spark, d):
    g = graph(spark, d)
    return joins.events_with_entities(g["events"], g["involves"]).select("id", F.array_join("entity_ids", ",").alias("entity_ids"))


def event_event_edges(spark, d):
    g = graph(spark, d)
    return joins.event_event_edges(g["event_relation"], g["events"], 250, ["active"]).select("from_id", "to_id", "relation_type", "from_summary", "to_summary")


def event_context_edges(spark, d):
    g = graph(spark, d)
    return joins.event_context_edges(g["in_rel"], g["events"], g["contexts"], 250, ["active"], ["active"]).select("event_id", "context_id", F.round("confidence", 6).alias("confidence"), "event_summary")


def relation_paths(spark, d):
    g = graph(spark, d)
    return joins.relation_paths(g["event_relation"], g["events"], SEEDS).select("from_id", "to_id", "relation_type", "operation")


def events_by_contexts(spark, d):
    g = graph(spark, d)
    return joins.events_by_contexts(g["events"], g["in_rel"], ["c1", "c2", "c3"], 50).select("id", "last_active")


def canonical_entities(spark, d):
    return scans.canonical_ids(graph(spark, d)["entities"])


def graph_stats(spark, d):
    return reports.graph_stats(graph(spark, d))


def status_counts(spark, d):
    return reports.status_counts(graph(spark, d)["events"])


def supersession_chain(spark, d):
    return relations.supersession_chain(graph(spark, d)["states"])


def recall_temporal(spark, d):
    e = graph(spark, d)["events"]
    return recall.temporal(e, e).select("query_id", "cand_id", F.round("score", 6).alias("score"))


def recall_entity(spark, d):
    g = graph(spark, d)
    return recall.entity(g["events"], g["events"], g["involves"]).select("query_id", "cand_id", F.round("score", 6).alias("score"))


def recall_state(spark, d):
    g = graph(spark, d)
    return recall.state(g["events"], g["events"], g["states"]).select("query_id", "cand_id", "score")


def recall_reference(spark, d):
    e = graph(spark, d)["events"]
    return recall.reference(e, e).select("query_id", "cand_id", "score")


def recall_semantic(spark, d):
    v = _vectors(spark, d)
    return recall.semantic(v, v, threshold=0.3).select("query_id", "cand_id", F.round("score", 6).alias("score"))


def _recalled(spark, d):
    g = graph(spark, d)
    return g, recall.recall(g["events"], g["events"], g["involves"], g["states"])


def recall_fused(spark, d):
    found = _recalled(spark, d)[1]
    return found.select("query_id", "cand_id", "rank", "channel", F.round("aggregate_score", 5).alias("aggregate_score"), F.array_join(F.map_keys("channels"), ",").alias("channels"))


def relation_decisions(spark, d):
    g, found = _recalled(spark, d)
    done = relations.process(found, g["events"], g["states"], g["in_rel"])
    return done.select("query_id", "cand_id", "operation", "confidence", "status", "value_before", "value_after")


def retrieval_scores(spark, d):
    v = _vectors(spark, d)
    q = [0.125] * 64
    return recall.with_retrieval_score(v, q, NOW).select("id", F.round("similarity", 6).alias("similarity"), F.round("evolution_score", 6).alias("evolution_score"))


def near_events(spark, d):
    v = _vectors(spark, d)
    return consolidation.near_pairs(v, F.col("session_id"), threshold=0.2).select(F.col("a.id").alias("id"), F.col("b.id").alias("cand_id"), F.round("similarity", 6).alias("similarity"), "rank")


def merge_plan(spark, d):
    v = _vectors(spark, d)
    return consolidation.merge_plan(v, F.col("session_id"), gate=0.1, near=0.2).select("canonical_id", "merged_id", "score")


def time_buckets(spark, d):
    e = graph(spark, d)["events"]
    return e.groupBy(M.time_bucket("timestamp").alias("bucket")).agg(F.count("*").alias("n_events"))


def decayed_contexts(spark, d):
    out = contexts.decayed(graph(spark, d)["contexts"], NOW)
    return out.select("id", "status", F.round("confidence", 6).alias("confidence"), "valid_to", "changed")


def archived_events(spark, d):
    return consolidation.archived(graph(spark, d)["events"], NOW).groupBy("status", "changed").agg(F.count("*").alias("n_events"))


def graph_delta(spark, d):
    before = graph(spark, d)["events"].select("id", "summary", "status", "support_count", "n")
    after = before.filter("n % 17 <> 0").withColumns({"status": F.when(F.col("n") % 5 == 0, "archived").otherwise(F.col("status")), "support_count": F.col("support_count") + (F.col("n") % 6 == 0).cast("int")})
    after = after.union(before.limit(0)).unionByName(before.filter("n % 23 = 0").withColumn("id", F.concat(F.lit("new"), "id")))
    return joins.graph_delta(before, after, ["id"]).groupBy("change").agg(F.count("*").alias("n_rows"))


def relinked_entities(spark, d):
    g = graph(spark, d)
    moved = mutations.relink_entities(g["involves"], scans.canonical_ids(g["entities"]), NOW)
    return moved.groupBy("entity_id").agg(F.count("*").alias("n_events"), F.sum("c_valid").alias("c_valid"), F.max("t_valid").alias("t_valid"))


def counted_links(spark, d):
    g = graph(spark, d)
    links = g["events"].filter("n % 3 = 0").select(F.col("id").alias("event_id"), F.concat(F.lit("kind_"), "event_type").alias("entity_id"))
    out = mutations.count_links(g["involves"], links, NOW)
    return out.groupBy("c_valid", (F.col("t_valid") == NOW).alias("now")).agg(F.count("*").alias("n_edges"))


def extraction_metrics(spark, d):
    rows = _table(spark, d, "documents").select(F.col("lang").alias("route"), F.col("source").alias("bucket"), (F.col("doc_id") % 4).alias("n_events"), (F.col("doc_id") % 3).alias("n_contexts"), F.least(F.col("doc_id") % 4, F.lit(2)).alias("n_subject_events"), (F.col("doc_id") % 7 / 7.0).alias("overlap_sum"), (F.col("doc_id") % 2).alias("llm_calls"), (F.col("doc_id") % 50 == 0).alias("error"), F.col("n_chars").cast("double").alias("latency_ms"))
    out = reports.extraction_metrics(rows)
    return out.select(*[F.round(f.name, 6).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in out.schema])


def reuse_summary(spark, d):
    rows = _table(spark, d, "labels").select((F.col("doc_id") % 4).cast("string").alias("category"), (F.col("quality") == 1).alias("expected"), (F.col("toxic") == 0).alias("predicted"), ((F.col("quality") == 1) == (F.col("toxic") == 0)).alias("correct"), (F.col("doc_id") % 100).cast("double").alias("latency_ms"))
    out = reports.reuse_summary(rows)
    return out.select(*[F.round(f.name, 6).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in out.schema])


def turn_overlap(spark, d):
    turns = _table(spark, d, "conversations")
    nxt = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return turns.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.round(T.overlap("text", "next"), 6).alias("overlap"), F.round(T.character_overlap("text", "next"), 6).alias("characters"))


def flattened_props(spark, d):
    return _table(spark, d, "events").select("event_id", flatten_json("props").alias("flat"))


def context_keys(spark, d):
    c = graph(spark, d)["contexts"]
    return c.select("id", M.context_key("subtype", F.lit("s")).alias("key"), T.normalize_key("subject").alias("subject"))


def pattern_sections(spark, d):
    docs = _table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("entity_id"), F.concat(F.lit("intro\n## First "), "lang", F.lit("\n"), "text", F.lit("\n## Second\n"), "source").alias("content"))
    return patterns.recall_patterns(docs, "first en src3", "section", 1).select("entity_id", "mode", "total_chars", F.size("matched_sections").alias("n_sections"), F.col("matched_sections")[0]["heading"].alias("heading"))


def task_bullets(spark, d):
    g = graph(spark, d)
    docs = spark.createDataFrame([("p1", "user_2", PATTERN, 1, 2)], "id string, entity_id string, content string, created_at long, updated_at long")
    memory = task_recall.Graph(g["events"], g["contexts"], g["entities"], docs, g["involves"], g["in_rel"], g["event_relation"])
    found = task_recall.project(memory, TASK)
    return task_recall.bullets(task_recall.select(task_recall.fold(task_recall.walk(memory, found))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (bm25_search, bm25_index, bm25_index_update, document_frequency, recent_events, list_events, list_contexts, candidate_contexts, events_with_entities, event_event_edges, event_context_edges, relation_paths, events_by_contexts, canonical_entities, graph_stats, status_counts, supersession_chain, recall_temporal, recall_entity, recall_state, recall_reference, recall_semantic, recall_fused, relation_decisions, retrieval_scores, near_events, merge_plan, time_buckets, decayed_contexts, archived_events, graph_delta, relinked_entities, counted_links, extraction_metrics, reuse_summary, turn_overlap, flattened_props, context_keys, pattern_sections, task_bullets)
}

_TOKENS = "regexp_extract_all(lower({x}), '[a-z0-9_]+')"
_PACKED = "string_split(regexp_replace(lower({x}), '\\s+', '', 'g'), '')"
_GRAMS = f"list_distinct(list_concat(regexp_extract_all(lower({{x}}), '[a-z0-9_]+'), list_filter([z[1] || z[2] for z in list_zip({_PACKED}, {_PACKED}[2:])], lambda g: g IS NOT NULL)))"
_BM25 = f"""
WITH d AS (SELECT doc_id, {_TOKENS.format(x="text")} AS w FROM documents),
q AS (SELECT t, count(*) AS m FROM (SELECT unnest({_TOKENS.format(x=f"'{SEARCH}'")}) AS t) GROUP BY t),
s AS (SELECT count(*) AS n, avg(len(w)) AS a FROM d),
tf AS (SELECT doc_id, t, count(*) AS f, any_value(l) AS l FROM (SELECT doc_id, len(w) AS l, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY doc_id, t),
df AS (SELECT t, count(*) AS c FROM tf GROUP BY t)
SELECT doc_id, round(sum(m * ln(1 + (n - c + 0.5) / (c + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * l / a))), 6) AS score
FROM tf JOIN df USING (t) JOIN q USING (t) CROSS JOIN s GROUP BY doc_id
"""
_JACCARD = "CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE) END"
_COS = "CASE WHEN p > 0 AND q > 0 THEN greatest(0.0, least(1.0, dot / (sqrt(p) * sqrt(q)))) ELSE 0.0 END"
_VEC = "SELECT vec_id, CAST(vec_id AS VARCHAR) AS id, label, CAST(embedding AS DOUBLE[]) AS v, CASE WHEN vec_id % 10 = 0 THEN 'archived' ELSE 'active' END AS status FROM embeddings"
_DOT = "list_sum([x * y for x, y in zip_]) "
_CANON = "CASE relation_type WHEN 'merge' THEN '同一主题' WHEN '补充' THEN '共同背景' WHEN '意义更新' THEN '意义更新' ELSE '' END"
_METRICS = """
count(*) AS n_records, CAST(sum(n_events) AS BIGINT) AS n_events, CAST(sum(n_contexts) AS BIGINT) AS n_contexts, count(*) FILTER (WHERE n_events = 0) AS n_empty, count(*) FILTER (WHERE error) AS n_errors,
round(count(*) FILTER (WHERE n_events = 0) / CAST(count(*) AS DOUBLE), 6) AS empty_rate, round(sum(n_events) / CAST(count(*) AS DOUBLE), 6) AS event_yield, round(sum(llm_calls) / CAST(count(*) AS DOUBLE), 6) AS llm_call_rate,
round(coalesce(sum(n_subject_events) / CAST(nullif(sum(n_events), 0) AS DOUBLE), 0), 6) AS subject_rate, round(coalesce(sum(overlap_sum) / nullif(sum(n_contexts), 0), 0), 6) AS mean_overlap,
round(avg(latency_ms), 6) AS latency_avg, round(quantile_cont(latency_ms, 0.5), 6) AS latency_p50, round(quantile_cont(latency_ms, 0.95), 6) AS latency_p95, round(quantile_cont(latency_ms, 0.99), 6) AS latency_p99
"""
_REUSE = """
count(*) AS n_cases, round(count(*) FILTER (WHERE e = p) / CAST(count(*) AS DOUBLE), 6) AS accuracy,
round(coalesce(count(*) FILTER (WHERE e AND p) / CAST(nullif(count(*) FILTER (WHERE p), 0) AS DOUBLE), 0), 6) AS precision, round(coalesce(count(*) FILTER (WHERE e AND p) / CAST(nullif(count(*) FILTER (WHERE e), 0) AS DOUBLE), 0), 6) AS recall,
round(coalesce(count(*) FILTER (WHERE p AND NOT e) / CAST(nullif(count(*) FILTER (WHERE NOT e), 0) AS DOUBLE), 0), 6) AS false_link_rate,
round(avg(l), 6) AS latency_avg, round(quantile_cont(l, 0.5), 6) AS latency_p50, round(quantile_cont(l, 0.95), 6) AS latency_p95, round(quantile_cont(l, 0.99), 6) AS latency_p99
"""
_PAIR = "list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"

ORACLES: dict[str, str] = {
    "bm25_search": _BM25,
    "bm25_index": _BM25,
    "bm25_index_update": f"SELECT count(*) AS n_docs, round(avg(len({_TOKENS.format(x='text')})), 6) AS avgdl FROM documents WHERE (doc_id % 3 <> 0 OR doc_id % 2 = 0) AND doc_id % 5 <> 0",
    "document_frequency": f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({_TOKENS.format(x='text')})) AS term FROM documents) GROUP BY term",
    "recent_events": f"{ctes('events')} SELECT id, last_active, status FROM g_events WHERE last_active >= {NOW} - 1000000000 ORDER BY last_active DESC, id LIMIT 100",
    "list_events": f"""{ctes("events")}, p AS (SELECT id, last_active, concat_ws(' ', summary, action, causality, payload) AS x FROM g_events WHERE status = 'active' ORDER BY last_active DESC, id LIMIT 300),
      s AS (SELECT id, last_active, {_JACCARD} AS score FROM (SELECT id, last_active, {_GRAMS.format(x="x")} AS a, {_GRAMS.format(x=f"'{LIST_QUERY}'")} AS b FROM p))
      SELECT id, round(score, 6) AS score FROM s WHERE score > 0 ORDER BY s.score DESC, last_active DESC, id LIMIT 50""",
    "events_with_entities": f"{ctes('events', 'involves')} SELECT id, string_agg(DISTINCT entity_id, ',' ORDER BY entity_id) AS entity_ids FROM g_events JOIN g_involves ON event_id = id GROUP BY id",
    "event_event_edges": f"""{ctes("events", "event_relation")} SELECT from_id, to_id, {_CANON} AS relation_type, a.summary AS from_summary, b.summary AS to_summary FROM g_event_relation r JOIN g_events a ON a.id = from_id JOIN g_events b ON b.id = to_id
      WHERE a.status = 'active' AND b.status = 'active' ORDER BY r.updated_at DESC, from_id, to_id LIMIT 250""",
    "event_context_edges": f"""{ctes("events", "contexts", "in_rel")} SELECT event_id, context_id, round(r.confidence, 6) AS confidence, e.summary AS event_summary FROM g_in_rel r JOIN g_events e ON e.id = event_id JOIN g_contexts c ON c.id = context_id
      WHERE e.status = 'active' AND c.status = 'active' ORDER BY r.updated_at DESC, event_id, context_id LIMIT 250""",
    "relation_paths": f"""{ctes("events", "event_relation")} SELECT from_id, to_id, CASE WHEN {_CANON} <> '' THEN {_CANON} ELSE relation_type END AS relation_type, operation FROM g_event_relation r JOIN g_events a ON a.id = from_id JOIN g_events b ON b.id = to_id
      WHERE (from_id IN ({str(SEEDS)[1:-1]}) OR to_id IN ({str(SEEDS)[1:-1]})) AND a.status = 'active' AND b.status = 'active' ORDER BY r.updated_at DESC, from_id, to_id LIMIT 40""",
    "events_by_contexts": f"{ctes('events', 'in_rel')} SELECT id, last_active FROM g_events WHERE id IN (SELECT event_id FROM g_in_rel WHERE context_id IN ('c1', 'c2', 'c3')) ORDER BY last_active DESC, id LIMIT 50",
    "canonical_entities": f"{ctes('entities')} SELECT id, CASE WHEN status = 'merged' AND coalesce(canonical_id, '') <> '' THEN canonical_id ELSE id END AS canonical FROM g_entities",
    "graph_stats": f"{ctes('events', 'contexts', 'entities', 'involves', 'in_rel', 'event_relation', 'states')} " + " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n_rows FROM g_{n}" for n in ("events", "contexts", "entities", "involves", "in_rel", "event_relation", "states")),
    "status_counts": f"{ctes('events')} SELECT status, count(*) AS n_events FROM g_events GROUP BY status",
    "supersession_chain": f"""{ctes("states")}, s AS (SELECT *, lag(id) OVER w AS old_id, lag(value_after) OVER w AS old_after FROM g_states WHERE entity <> '' AND attribute <> '' WINDOW w AS (PARTITION BY entity, attribute ORDER BY timestamp, id))
      SELECT old_id AS from_id, id AS to_id, entity, attribute, CASE WHEN coalesce(old_after, '') <> '' THEN old_after ELSE coalesce(value_before, '') END AS value_before, value_after FROM s WHERE old_id IS NOT NULL AND coalesce(value_after, '') <> '' AND value_after <> coalesce(old_after, '')""",
    "recall_temporal": f"""{ctes("events")}, pool AS (SELECT id, last_active AS t FROM g_events ORDER BY last_active DESC, id LIMIT 15)
      SELECT q.id AS query_id, p.id AS cand_id, round(exp(-greatest(q.last_active - p.t, 0) / 604800.0), 6) AS score FROM g_events q JOIN pool p ON p.t >= q.last_active - 604800 AND p.id <> q.id
      QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY exp(-greatest(q.last_active - p.t, 0) / 604800.0) DESC, p.t DESC, p.id) <= 5""",
    "recall_state": f"""{ctes("events", "states")}, k AS (SELECT DISTINCT s.id, entity, attribute, last_active, status FROM g_states s JOIN g_events e USING (id)),
      pool AS (SELECT * FROM k WHERE status = 'active' QUALIFY row_number() OVER (PARTITION BY entity, attribute ORDER BY last_active DESC, id) <= 5)
      SELECT query_id, cand_id, 1.0 AS score FROM (SELECT DISTINCT k.id AS query_id, pool.id AS cand_id, pool.last_active AS t FROM k JOIN pool USING (entity, attribute) WHERE k.id <> pool.id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY t DESC, cand_id) <= 5""",
    "recall_reference": f"""{ctes("events")}, pool AS (SELECT id, thread_id, last_active FROM g_events WHERE status = 'active' AND thread_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY thread_id ORDER BY last_active DESC, id) <= 5),
      u AS (SELECT a.id AS query_id, b.id AS cand_id, 1.0 AS s, b.last_active AS t FROM g_events a JOIN g_events b ON a.parent_event_id = b.id UNION ALL SELECT a.id, p.id, 0.8, p.last_active FROM g_events a JOIN pool p USING (thread_id) WHERE a.id <> p.id)
      SELECT query_id, cand_id, CAST(max(s) AS DOUBLE) AS score FROM u GROUP BY query_id, cand_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY max(s) DESC, max(t) DESC, cand_id) <= 5""",
    "recall_entity": f"""{ctes("events", "involves")}, s AS (SELECT event_id AS id, list_sort(list_distinct(list(entity_id))) AS es FROM g_involves GROUP BY event_id), e AS (SELECT id, es, last_active AS t FROM s JOIN g_events USING (id)),
      x AS (SELECT id, es, t, unnest(es) AS n FROM e), shape AS (SELECT es, row_number() OVER () AS g FROM (SELECT DISTINCT es FROM e)), m AS (SELECT id, t, g FROM e JOIN shape USING (es)),
      sx AS (SELECT g, es, unnest(es) AS n FROM shape), gp AS (SELECT DISTINCT a.g AS g1, b.g AS g2, a.es AS e1, b.es AS e2 FROM sx a JOIN sx b USING (n)),
      top AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY g ORDER BY t DESC, id) <= 9),
      r AS (SELECT q.id AS query_id, c.id AS cand_id, c.t, len(list_intersect(e1, e2)) / CAST(len(list_distinct(list_concat(e1, e2))) AS DOUBLE) AS s FROM m q JOIN gp ON gp.g1 = q.g JOIN top c ON c.g = gp.g2 WHERE c.id <> q.id)
      SELECT query_id, cand_id, round(s, 6) AS score FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, t DESC, cand_id) <= 8""",
    "recall_semantic": f"""WITH v AS ({_VEC}), pool AS (SELECT * FROM v WHERE status = 'active' ORDER BY vec_id DESC LIMIT 200), r AS (SELECT a.id AS query_id, b.id AS cand_id, b.vec_id AS t, greatest(0.0, least(1.0, {_PAIR})) AS s FROM v a JOIN pool b ON a.id <> b.id)
      SELECT query_id, cand_id, round(s, 6) AS score FROM r WHERE s >= 0.3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, t DESC, cand_id) <= 8""",
    "retrieval_scores": f"""WITH v AS ({_VEC}), s AS (SELECT id, vec_id, status, greatest(0.0, least(1.0, list_sum([x * 0.125 for x in v]) / sqrt(list_dot_product(v, v)))) AS sim FROM v)
      SELECT id, round(sim, 6) AS similarity, round(0.45 * sim + 0.2 * exp(-1e-8 * ({NOW} - vec_id)) + 0.1 * (CASE WHEN status = 'archived' THEN 0.25 ELSE 1.0 END) + 0.1 * least(1.0, ln(2 + vec_id % 3) / ln(21)), 6) AS evolution_score FROM s""",
    "near_events": f"""WITH v AS ({_VEC}), r AS (SELECT a.id AS id, b.id AS cand_id, b.vec_id AS t, greatest(0.0, least(1.0, {_PAIR})) AS s FROM v a JOIN v b ON a.label = b.label AND a.id <> b.id WHERE a.status = 'active' AND b.status = 'active')
      SELECT id, cand_id, round(s, 6) AS similarity, CAST(row_number() OVER (PARTITION BY id ORDER BY s DESC, t DESC, cand_id) AS INTEGER) AS rank FROM r WHERE s >= 0.2 QUALIFY rank <= 8""",
    "time_buckets": f"{ctes('events')} SELECT CASE WHEN h >= 5 AND h < 12 THEN 'morning' WHEN h >= 12 AND h < 18 THEN 'afternoon' WHEN h >= 18 AND h < 23 THEN 'evening' ELSE 'night' END AS bucket, count(*) AS n_events FROM (SELECT (timestamp // 3600) % 24 AS h FROM g_events) GROUP BY bucket",
    "decayed_contexts": f"""{ctes("contexts")} SELECT id, CASE WHEN stale AND low < 0.25 THEN 'deprecated' ELSE status END AS status, round(CAST(CASE WHEN stale THEN low ELSE confidence END AS DOUBLE), 6) AS confidence, CASE WHEN stale AND low < 0.25 THEN {NOW} ELSE valid_to END AS valid_to, stale AND abs(confidence - low) > 1e-6 AS changed
      FROM (SELECT *, last_seen_at < {NOW} - 2592000 AS stale, greatest(0.0, confidence - 0.04) AS low FROM g_contexts)""",
    "archived_events": f"{ctes('events')} SELECT CASE WHEN o THEN 'archived' ELSE status END AS status, o AS changed, count(*) AS n_events FROM (SELECT status, last_active < {NOW} - 7776000 AND support_count <= 1 AS o FROM g_events) GROUP BY ALL",
    "graph_delta": f"""{ctes("events")}, b AS (SELECT id, n, status, support_count FROM g_events), a AS (SELECT id, n, CASE WHEN n % 5 = 0 THEN 'archived' ELSE status END AS status, support_count + CASE WHEN n % 6 = 0 THEN 1 ELSE 0 END AS support_count FROM b WHERE n % 17 <> 0 UNION ALL SELECT 'new' || id, n, status, support_count FROM b WHERE n % 23 = 0)
      SELECT change, count(*) AS n_rows FROM (SELECT CASE WHEN b.id IS NULL THEN 'created' WHEN a.id IS NULL THEN 'removed' WHEN a.status = 'archived' AND b.status <> 'archived' THEN 'archived' WHEN a.status <> b.status OR a.support_count <> b.support_count THEN 'updated' END AS change FROM b FULL JOIN a USING (id)) WHERE change IS NOT NULL GROUP BY change""",
    "relinked_entities": f"""{ctes("entities", "involves")}, m AS (SELECT i.event_id, coalesce(CASE WHEN e.status = 'merged' THEN e.canonical_id END, i.entity_id) AS entity_id, e.status = 'merged' AND e.canonical_id IS NOT NULL AS moved, c_valid, t_valid FROM g_involves i LEFT JOIN g_entities e ON e.id = i.entity_id),
      g AS (SELECT event_id, entity_id, max(c_valid) AS c_valid, greatest(max(t_valid), max(CASE WHEN moved THEN {NOW} END)) AS t_valid FROM m GROUP BY ALL) SELECT entity_id, count(*) AS n_events, CAST(sum(c_valid) AS BIGINT) AS c_valid, max(t_valid) AS t_valid FROM g GROUP BY entity_id""",
    "counted_links": f"""{ctes("events", "involves")}, l AS (SELECT DISTINCT id AS event_id, 'kind_' || event_type AS entity_id FROM g_events WHERE n % 3 = 0), j AS (SELECT i.c_valid AS c, i.t_valid AS t, i.event_id IS NOT NULL AS known, l.event_id IS NOT NULL AS hit FROM g_involves i FULL JOIN l ON i.event_id = l.event_id AND i.entity_id = l.entity_id)
      SELECT CAST(CASE WHEN hit AND known THEN c + 1 WHEN hit THEN 1 ELSE c END AS BIGINT) AS c_valid, (CASE WHEN hit THEN {NOW} ELSE t END) = {NOW} AS now, count(*) AS n_edges FROM j GROUP BY ALL""",
    "extraction_metrics": f"""WITH r AS (SELECT lang AS route, source AS bucket, doc_id % 4 AS n_events, doc_id % 3 AS n_contexts, least(doc_id % 4, 2) AS n_subject_events, doc_id % 7 / 7.0 AS overlap_sum, doc_id % 2 AS llm_calls, doc_id % 50 = 0 AS error, CAST(n_chars AS DOUBLE) AS latency_ms FROM documents)
      SELECT 'overall' AS scope, CAST(NULL AS VARCHAR) AS route, CAST(NULL AS VARCHAR) AS bucket, {_METRICS} FROM r UNION ALL SELECT 'route', route, NULL, {_METRICS} FROM r GROUP BY route UNION ALL SELECT 'bucket', NULL, bucket, {_METRICS} FROM r GROUP BY bucket""",
    "reuse_summary": f"""WITH r AS (SELECT CAST(doc_id % 4 AS VARCHAR) AS category, quality = 1 AS e, toxic = 0 AS p, CAST(doc_id % 100 AS DOUBLE) AS l FROM labels) SELECT CAST(NULL AS VARCHAR) AS category, 'overall' AS scope, {_REUSE} FROM r UNION ALL SELECT category, 'category', {_REUSE} FROM r GROUP BY category""",
    "flattened_props": "SELECT event_id, 'k: ' || json_extract_string(props, '$.k') AS flat FROM events",
    "context_keys": f"{ctes('contexts')} SELECT id, 'ctx_' || substr(sha256('context|' || subtype || '|s'), 1, 20) AS key, lower(subject) AS subject FROM g_contexts",
}


ORACLES["list_contexts"] = f"""{ctes("contexts")}, p AS (SELECT id, last_seen_at AS t, summary || ' ' || description AS x FROM g_contexts WHERE status = 'active' ORDER BY last_seen_at DESC, id LIMIT 240),
  s AS (SELECT id, t, {_JACCARD} AS score FROM (SELECT id, t, {_GRAMS.format(x="x")} AS a, {_GRAMS.format(x="'the and thon'")} AS b FROM p))
  SELECT id, round(score, 6) AS score FROM s WHERE score > 0 ORDER BY s.score DESC, t DESC, id LIMIT 40"""
_CHANNELS = " UNION ALL ".join(f"SELECT query_id, cand_id, '{c}' AS c, {i} AS o, {w} AS w, score AS s FROM ({ORACLES[f'recall_{c}']})" for i, (c, w) in enumerate((("temporal", 0.10), ("entity", 0.30), ("state", 0.15), ("reference", 0.10))))
ORACLES["recall_fused"] = f"""{ctes("events")}, u AS ({_CHANNELS}), f AS (SELECT query_id, cand_id, sum(w * s) AS a, max(s) AS m, arg_max(c, {{'s': s, 'o': -o}}) AS channel, string_agg(c, ',' ORDER BY c) AS channels FROM u WHERE query_id <> cand_id GROUP BY query_id, cand_id),
  k AS (SELECT f.*, e.last_active AS t FROM f JOIN g_events e ON e.id = cand_id WHERE round(a, 9) >= 0.12 AND status NOT IN ('merged', 'archived'))
  SELECT query_id, cand_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(a, 6) DESC, m DESC, t DESC, cand_id) AS INTEGER) AS rank, channel, round(a, 5) AS aggregate_score, channels FROM k QUALIFY rank <= 10"""
_FUSED = ORACLES["recall_fused"].rpartition("SELECT query_id")[0]
ORACLES["relation_decisions"] = f"""{_FUSED}, c AS (SELECT query_id, cand_id, round(a, 6) AS agg, m, t, string_split(channels, ',') AS ch FROM k QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(a, 6) DESC, m DESC, t DESC, cand_id) <= 10),
  {ctes("states", "in_rel").removeprefix("WITH ")}, s AS (SELECT id, timestamp AS at, entity, attribute, coalesce(value_after, '') AS after FROM g_states WHERE entity <> '' AND attribute <> ''),
  up AS (SELECT DISTINCT query_id, cand_id, o.after AS before, n.after FROM c JOIN s n ON n.id = query_id JOIN s o ON o.id = cand_id AND o.entity = n.entity AND o.attribute = n.attribute WHERE (o.at < n.at OR (o.at = n.at AND o.id < n.id)) AND n.after <> '' AND n.after <> o.after),
  ref AS (SELECT query_id, cand_id FROM c JOIN g_events q ON q.id = query_id JOIN g_events e ON e.id = cand_id WHERE q.parent_event_id = cand_id OR e.parent_event_id = query_id),
  sh AS (SELECT DISTINCT query_id, cand_id FROM c JOIN g_in_rel x ON x.event_id = query_id JOIN g_in_rel y ON y.event_id = cand_id AND y.context_id = x.context_id),
  r AS (SELECT c.*, up.before, up.after, CASE WHEN up.query_id IS NOT NULL THEN 'supersedes' WHEN ref.query_id IS NOT NULL THEN 'co_recall' WHEN sh.query_id IS NULL AND (list_contains(ch, 'reference') OR list_contains(ch, 'state')) THEN 'skip' END AS operation
    FROM c LEFT JOIN up USING (query_id, cand_id) LEFT JOIN ref USING (query_id, cand_id) LEFT JOIN sh USING (query_id, cand_id)),
  b AS (SELECT *, row_number() OVER (PARTITION BY query_id, operation ORDER BY CASE WHEN list_contains(ch, 'reference') THEN 5 ELSE 4 END DESC, agg DESC, m DESC, t DESC, cand_id) AS n FROM r WHERE operation IS NOT NULL),
  d AS (SELECT query_id, cand_id, operation, CAST(CASE operation WHEN 'supersedes' THEN 0.95 WHEN 'co_recall' THEN 0.9 ELSE 0.0 END AS DOUBLE) AS confidence, coalesce(before, '') AS value_before, coalesce(after, '') AS value_after FROM b WHERE operation <> 'skip' OR n <= 5)
  SELECT query_id, cand_id, operation, confidence, CASE WHEN operation = 'skip' THEN 'skipped' WHEN count(*) FILTER (WHERE operation <> 'skip') OVER (PARTITION BY query_id ORDER BY confidence DESC, cand_id ROWS UNBOUNDED PRECEDING) <= 3 THEN 'executed' ELSE 'relation_budget_exhausted' END AS status, value_before, value_after FROM d"""
# greedy matching by the serial rule: pair after pair, best first, with the list of used ids
ORACLES["merge_plan"] = f"""WITH RECURSIVE v AS ({_VEC}), n AS (SELECT a.id AS x, b.id AS y, a.vec_id AS i, b.vec_id AS j, greatest(0.0, least(1.0, {_PAIR})) AS s FROM v a JOIN v b ON a.label = b.label AND a.id <> b.id WHERE a.status = 'active' AND b.status = 'active'),
  top AS (SELECT * FROM n WHERE s >= 0.2 QUALIFY row_number() OVER (PARTITION BY x ORDER BY s DESC, j DESC, y) <= 8),
  c AS (SELECT *, {{'s': 1 + i % 3, 'c': i, 'i': x}} >= {{'s': 1 + j % 3, 'c': j, 'i': y}} AS first FROM top WHERE i % 3 = 0 OR j % 3 = 0),
  p AS (SELECT DISTINCT CASE WHEN first THEN x ELSE y END AS canonical_id, CASE WHEN first THEN y ELSE x END AS merged_id, round(least(1.0, s + 0.05 * exp(-abs(i - j) / 172800.0)), 6) AS score FROM c),
  o AS (SELECT *, row_number() OVER (ORDER BY score DESC, canonical_id, merged_id) AS n FROM p WHERE score >= 0.1),
  g AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS used, false AS taken UNION ALL
    SELECT o.n, CASE WHEN list_has_any(used, [canonical_id, merged_id]) THEN used ELSE list_concat(used, [canonical_id, merged_id]) END, NOT list_has_any(used, [canonical_id, merged_id]) FROM g JOIN o ON o.n = g.n + 1)
  SELECT canonical_id, merged_id, score FROM g JOIN o USING (n) WHERE taken"""
ORACLES["candidate_contexts"] = f"""{ctes("contexts")}, p AS (SELECT *, summary || ' ' || description AS x FROM g_contexts WHERE status = 'active' ORDER BY last_seen_at DESC, id LIMIT 64),
  l AS (SELECT *, {_JACCARD} AS lex FROM (SELECT *, {_GRAMS.format(x="x")} AS a, {_GRAMS.format(x="'the and thon'")} AS b FROM p)),
  s AS (SELECT *, lex > 0 AS hit, CASE WHEN lex > 0 THEN lex + 0.15 * confidence END AS score FROM l),
  r AS (SELECT *, row_number() OVER (PARTITION BY hit ORDER BY score DESC, last_seen_at DESC, confidence DESC, support_count DESC, id) AS rn, least(count(*) FILTER (WHERE hit) OVER (), 16) AS hits FROM s)
  SELECT id, round(score, 6) AS score FROM r WHERE CASE WHEN hit THEN rn <= 16 ELSE rn <= least(4, 16 - hits) END"""
_NORMAL = "regexp_replace(lower(trim({x})), '[\\s，,。；;：:、/\\\\-]+', '', 'g')"
_SHORT = "list_distinct(regexp_extract_all(lower({x}), '[a-z0-9_]+'))"
_CHARS = "list_distinct(string_split(regexp_replace({x}, '\\s+', '', 'g'), ''))"
ORACLES["turn_overlap"] = f"""WITH t AS (SELECT a.conv_id, a.turn, a.text AS p, b.text AS q FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
  n AS (SELECT *, {_NORMAL.format(x="p")} AS x, {_NORMAL.format(x="q")} AS y, {_SHORT.format(x="p")} AS a, {_SHORT.format(x="q")} AS b, {_CHARS.format(x="p")} AS c, {_CHARS.format(x="q")} AS d FROM t)
  SELECT conv_id, turn, round(CASE WHEN x = '' OR y = '' THEN 0 WHEN x = y THEN 1 WHEN len(x) <= len(y) AND contains(y, x) THEN len(x) / CAST(len(y) AS DOUBLE) WHEN len(x) > len(y) AND contains(x, y) THEN len(y) / CAST(len(x) AS DOUBLE) ELSE {_JACCARD} END, 6) AS overlap,
  round(len(list_intersect(c, d)) / CAST(len(d) AS DOUBLE), 6) AS characters FROM n"""
ORACLES["pattern_sections"] = """SELECT CAST(doc_id AS VARCHAR) AS entity_id, 'section' AS mode, length('intro' || chr(10) || '## First ' || lang || chr(10) || text || chr(10) || '## Second' || chr(10) || source) AS total_chars, 1 AS n_sections, '## First ' || lang AS heading FROM documents"""
ORACLES["task_bullets"] = TASK_BULLETS
QUERIES |= lookups.QUERIES
ORACLES |= lookups.ORACLES
