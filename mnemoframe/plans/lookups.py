"""Queries for lookups, writes, reports and payloads over the demonstration graph, with their DuckDB oracles.

As in ``queries``, every query reads whole tables; keys that a lookup is asked
for are constants of the query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import measures as M
from ..functions import text as T
from ..operators import consolidation, contexts, entities, joins, mutations, patterns, payloads, recall, relations, reports, scans
from .demo import ctes, graph

NOW = 1_760_000_000
IDS = ["e7", "e3", "e12", "e0", "e3", "nowhere"]
NAMES = ["user_2", "user_7", "kind_click"]
QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def _query(oracle: str):
    def keep(f: Callable) -> Callable:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, oracle
        return f

    return keep


def _in(values: list[str]) -> str:
    return str(list(values))[1:-1]


@_query(f"{ctes('events')} SELECT id, CAST(p AS INTEGER) AS pos FROM g_events JOIN (VALUES ('e7', 0), ('e3', 1), ('e12', 2), ('e0', 3)) w(id, p) USING (id) WHERE status = 'active'")
def events_by_ids(spark, d) -> DataFrame:
    return scans.by_ids(graph(spark, d)["events"], IDS, ["active"]).select("id", "pos")


@_query(f"{ctes('entities', 'contexts')} SELECT id, description AS label FROM g_entities WHERE id = 'user_4' AND registered UNION ALL SELECT id, summary FROM g_contexts WHERE id = 'c5'")
def nodes_by_id(spark, d) -> DataFrame:
    g = graph(spark, d)
    return scans.registered_entity(g["entities"], "user_4").select("id", F.col("description").alias("label")).unionByName(scans.by_id(g["contexts"], "c5").select("id", F.col("summary").alias("label")))


@_query(f"{ctes('entities')} SELECT id, description FROM g_entities WHERE registered AND coalesce(status = 'active', true)")
def registered_entities(spark, d) -> DataFrame:
    return scans.registered(graph(spark, d)["entities"]).select("id", "description")


@_query(f"{ctes('events', 'involves')} SELECT id, last_active FROM g_events WHERE id IN (SELECT event_id FROM g_involves WHERE entity_id IN ({_in(NAMES)}))")
def events_by_entities(spark, d) -> DataFrame:
    g = graph(spark, d)
    return joins.events_by_entities(g["events"], g["involves"], NAMES).select("id", "last_active")


@_query(f"{ctes('involves')} SELECT DISTINCT entity_id FROM g_involves WHERE event_id = 'e12'")
def event_entities(spark, d) -> DataFrame:
    return joins.event_entities(graph(spark, d)["involves"], "e12")


@_query(f"{ctes('contexts', 'in_rel')} SELECT c.id, round(r.weight, 6) AS edge_weight, round(r.confidence, 6) AS edge_confidence FROM g_in_rel r JOIN g_contexts c ON c.id = r.context_id WHERE r.event_id = 'e12'")
def event_contexts(spark, d) -> DataFrame:
    g = graph(spark, d)
    return joins.event_contexts(g["in_rel"], g["contexts"], "e12").select("id", F.round("edge_weight", 6).alias("edge_weight"), F.round("edge_confidence", 6).alias("edge_confidence"))


@_query(f"{ctes('events')} SELECT id, last_active FROM g_events WHERE status = 'active' AND contains(payload, '\"k\": 7') AND contains(payload, '}}') ORDER BY last_active DESC, id LIMIT 20")
def events_mentioning(spark, d) -> DataFrame:
    return scans.events_mentioning(graph(spark, d)["events"], '"k": 7', "}").select("id", "last_active")


@_query(f"{ctes('contexts')} SELECT id, subtype, last_seen_at FROM g_contexts WHERE context_type = 'context' AND subtype = 'situation' AND status = 'active' ORDER BY last_seen_at DESC, id LIMIT 24")
def newest_contexts(spark, d) -> DataFrame:
    return scans.context_candidates(graph(spark, d)["contexts"], subtype="situation").select("id", "subtype", "last_seen_at")


@_query(f"{ctes('contexts')} SELECT id, summary FROM g_contexts WHERE context_type = 'context' AND status = 'active'")
def context_summaries(spark, d) -> DataFrame:
    return scans.summary_index(graph(spark, d)["contexts"])


@_query(f"{ctes('contexts')} SELECT id, md5(description) AS description, round(confidence, 6) AS confidence FROM g_contexts WHERE status = 'active'")
def active_contexts(spark, d) -> DataFrame:
    return scans.all_contexts(graph(spark, d)["contexts"]).select("id", F.md5("description").alias("description"), F.round("confidence", 6).alias("confidence"))


@_query("""WITH p AS (SELECT CAST(conv_id AS VARCHAR) AS id, min(turn) AS t, string_agg(text, ' ' ORDER BY turn) AS content, CASE WHEN conv_id % 2 = 0 THEN 'even' ELSE 'odd' END AS b, conv_id % 3 = 0 AS w FROM conversations WHERE text IS NOT NULL GROUP BY conv_id)
  SELECT id, w AS written FROM p WHERE b = 'even' AND contains(lower(content), 'the') AND NOT w ORDER BY t, id LIMIT 100""")
def listed_episodes(spark, d) -> DataFrame:
    turns = spark.read.parquet(f"{d}/conversations.parquet").filter("text is not null")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ")
    bucket = F.when(F.col("conv_id") % 2 == 0, "even").otherwise("odd")
    rows = turns.groupBy("conv_id").agg(F.min("turn").alias("timestamp"), said.alias("content")).select(F.col("conv_id").cast("string").alias("id"), "timestamp", "content", F.create_map(F.lit("bucket_name"), bucket).alias("metadata"), "conv_id")
    done = rows.filter("conv_id % 3 = 0").select(F.col("id").alias("episode_id"))
    return scans.list_episodes(rows, done, "the", "even", pending_only=True).select("id", "written")


_TRACES = "SELECT 'e' || event_id AS source_id, 'e' || (event_id + 4) AS target_id FROM events WHERE event_id % 4 = 0"


@_query(f"WITH t AS ({_TRACES}) SELECT source_id, target_id FROM t WHERE source_id = 'e12' OR target_id = 'e12'")
def merge_traces(spark, d) -> DataFrame:
    t = spark.read.parquet(f"{d}/events.parquet").filter("event_id % 4 = 0").select(F.concat(F.lit("e"), "event_id").alias("source_id"), F.concat(F.lit("e"), F.col("event_id") + 4).alias("target_id"))
    return joins.merge_traces(t, "e12")


@_query(f"""{ctes("in_rel")}, r AS (SELECT 'e' || event_id AS event_id, 'e' || (event_id + CASE WHEN event_id % 2 = 0 THEN n ELSE 1 END) AS cand_id FROM events, (SELECT count(*) AS n FROM documents))
  SELECT DISTINCT r.event_id, r.cand_id FROM r JOIN g_in_rel a ON a.event_id = r.event_id JOIN g_in_rel b ON b.event_id = r.cand_id AND b.context_id = a.context_id""")
def shared_contexts(spark, d) -> DataFrame:
    """Every second pair of events has the same document, the others have neighbours."""
    g = graph(spark, d)
    size = spark.read.parquet(f"{d}/documents.parquet").agg(F.count("*").alias("size"))
    far = F.col("n") + F.when(F.col("n") % 2 == 0, F.col("size")).otherwise(1)
    pairs = g["events"].select("id", "n").crossJoin(F.broadcast(size)).select(F.col("id").alias("event_id"), F.concat(F.lit("e"), far).alias("cand_id"))  # one row
    return joins.context_shared(g["in_rel"], pairs)


@_query(f"{ctes('events', 'involves', 'in_rel')}, a AS (SELECT event_id, string_agg(DISTINCT entity_id, ',' ORDER BY entity_id) AS x FROM g_involves GROUP BY 1), b AS (SELECT event_id, string_agg(DISTINCT context_id, ',' ORDER BY context_id) AS y FROM g_in_rel GROUP BY 1) SELECT id, coalesce(x, '') AS entity_ids, coalesce(y, '') AS context_ids FROM g_events LEFT JOIN a ON a.event_id = id LEFT JOIN b ON b.event_id = id")
def serialized_events(spark, d) -> DataFrame:
    g = graph(spark, d)
    return joins.serialized_events(g["events"], g["involves"], g["in_rel"]).select("id", F.array_join("entity_ids", ",").alias("entity_ids"), F.array_join("context_ids", ",").alias("context_ids"))


@_query(f"""{ctes("events", "entities", "involves")}, e AS (SELECT id FROM g_events ORDER BY support_count DESC, id LIMIT 200), n AS (SELECT id FROM g_entities ORDER BY id LIMIT 200)
  SELECT event_id, entity_id FROM g_involves WHERE event_id IN (SELECT id FROM e) AND entity_id IN (SELECT id FROM n)""")
def snapshot_edges(spark, d) -> DataFrame:
    g = graph(spark, d)
    return joins.snapshot_nodes(g["events"], g["entities"], g["contexts"], g["involves"], g["in_rel"])["involves"].select("event_id", "entity_id")


@_query(f"{ctes('events')} SELECT count(*) FILTER (WHERE last_active < {NOW} - 7776000 AND coalesce(support_count, 1) <= 1) AS n_archivable FROM g_events")
def archivable_events(spark, d) -> DataFrame:
    return consolidation.archivable(graph(spark, d)["events"], NOW)


@_query(f"{ctes('events')} SELECT max(CASE WHEN last_active <> 0 THEN last_active ELSE timestamp END) AS now FROM g_events WHERE status = 'active'")
def newest_activity(spark, d) -> DataFrame:
    return consolidation.reference_time(graph(spark, d)["events"])


@_query("SELECT lang AS route, count(*) AS n_records, round(count(*) / sum(count(*)) OVER (), 6) AS rate FROM documents GROUP BY lang")
def route_shares(spark, d) -> DataFrame:
    rows = spark.read.parquet(f"{d}/documents.parquet").select(F.col("lang").alias("route"))
    return reports.route_distribution(rows).withColumn("rate", F.round("rate", 6))


_CHECKED = "SELECT lang AS route, source AS bucket, doc_id % 4 AS n_events, doc_id % 3 AS n_contexts, doc_id % 7 / 7.0 AS overlap_sum, doc_id % 2 AS llm_calls, doc_id % 50 = 0 AS error FROM documents"


@_query(f"""WITH r AS ({_CHECKED}), m AS (SELECT count(*) FILTER (WHERE n_events = 0) / CAST(count(*) AS DOUBLE) AS a, sum(llm_calls) / CAST(count(*) AS DOUBLE) AS b, CAST(sum(n_events) AS DOUBLE) AS c, sum(overlap_sum) / sum(n_contexts) AS e, CAST(count(*) FILTER (WHERE error) AS DOUBLE) AS f FROM r)
  SELECT 'empty_rate' AS name, round(a, 6) AS value, CAST(0.4 AS DOUBLE) AS target, a < 0.4 AS passed FROM m UNION ALL SELECT 'llm_call_rate', round(b, 6), 0.0, b > 0 FROM m UNION ALL SELECT 'n_events', c, 0.0, c > 0 FROM m UNION ALL SELECT 'mean_overlap', round(e, 6), 0.5, e > 0.5 FROM m UNION ALL SELECT 'n_errors', f, 0.0, f = 0 FROM m""")
def validation_checks(spark, d) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    n = F.col("doc_id")
    rows = docs.select(F.col("lang").alias("route"), F.col("source").alias("bucket"), (n % 4).alias("n_events"), (n % 3).alias("n_contexts"), F.lit(0).alias("n_subject_events"), (n % 7 / 7.0).alias("overlap_sum"), (n % 2).alias("llm_calls"), (n % 50 == 0).alias("error"), F.lit(0.0).alias("latency_ms"))
    return reports.validation(reports.extraction_metrics(rows)).withColumn("value", F.round("value", 6))


@_query("SELECT name, value, baseline, round(value - baseline, 6) AS delta, round(value / baseline, 6) AS ratio FROM (SELECT 'n_docs' AS name, CAST(count(*) AS DOUBLE) AS value, CAST((SELECT count(*) FROM labels) AS DOUBLE) AS baseline FROM documents UNION ALL SELECT 'last', CAST(max(doc_id) AS DOUBLE), CAST((SELECT max(doc_id) FROM labels) AS DOUBLE) FROM documents)")
def run_comparison(spark, d) -> DataFrame:
    run = lambda name: spark.read.parquet(f"{d}/{name}.parquet").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last"))
    return reports.comparison(run("documents"), run("labels"), ["n_docs", "last"]).withColumns({"delta": F.round("delta", 6), "ratio": F.round("ratio", 6)})


@_query("SELECT lang AS key, CAST(sum(n_chars) AS BIGINT) AS total, round(avg(n_chars), 6) AS average FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def summed_timings(spark, d) -> DataFrame:
    rows = spark.read.parquet(f"{d}/documents.parquet").filter("lang is not null").select(F.create_map("lang", "n_chars").alias("ms"))
    return reports.summed_map(rows, "ms").withColumn("average", F.round("average", 6))


@_query("SELECT CAST(sum(quality) AS BIGINT) AS quality, CAST(sum(toxic) AS BIGINT) AS toxic FROM labels")
def summed_reports(spark, d) -> DataFrame:
    return reports.summed(spark.read.parquet(f"{d}/labels.parquet").select("quality", "toxic"))


@_query(f"{ctes('events')} SELECT id, CASE WHEN id IN ({_in(IDS)}) THEN 'archived' ELSE status END AS status, CASE WHEN id IN ({_in(IDS)}) THEN {NOW} END AS valid_to FROM g_events")
def marked_events(spark, d) -> DataFrame:
    return mutations.marked(graph(spark, d)["events"], IDS, "archived", NOW).select("id", "status", "valid_to")


@_query(f"{ctes('events', 'involves')} SELECT count(DISTINCT event_id) AS n_events, count(*) AS n_edges FROM g_involves WHERE CAST(substr(event_id, 2) AS BIGINT) % 3 <> 0")
def detached_deletes(spark, d) -> DataFrame:
    g = graph(spark, d)
    nodes, edges = mutations.detach_delete(g["events"], g["events"].filter("n % 3 = 0"), {"involves": (g["involves"], ["event_id"])})
    return edges["involves"].join(nodes, F.col("event_id") == F.col("id"), "left_semi").agg(F.count_distinct("event_id").alias("n_events"), F.count("*").alias("n_edges"))


@_query(f"""{ctes("event_relation")}, u AS (SELECT from_id, to_id, relation_type, 'link' AS operation, created_at, {NOW} AS updated_at FROM g_event_relation WHERE CAST(substr(from_id, 2) AS BIGINT) % 6 = 0)
  SELECT operation, min(created_at) AS first, max(updated_at) AS last, count(*) AS n_edges FROM (SELECT from_id, to_id, relation_type, operation, created_at, updated_at FROM g_event_relation WHERE CAST(substr(from_id, 2) AS BIGINT) % 6 <> 0 UNION ALL SELECT * FROM u UNION ALL SELECT 'x' || from_id, to_id, relation_type, operation, 5, updated_at FROM u) GROUP BY operation""")
def upserted_relations(spark, d) -> DataFrame:
    edges = graph(spark, d)["event_relation"]
    known = edges.filter("cast(substr(from_id, 2) as bigint) % 6 = 0").withColumns({"operation": F.lit("link"), "created_at": F.lit(5).cast(edges.schema["created_at"].dataType), "updated_at": F.lit(NOW).cast(edges.schema["updated_at"].dataType)})
    new = known.withColumn("from_id", F.concat(F.lit("x"), "from_id"))
    loops, blank = known.withColumn("to_id", F.col("from_id")), known.withColumn("relation_type", F.lit(" "))
    out = mutations.upsert_relations(edges, known.unionByName(new).unionByName(loops).unionByName(blank))
    return out.groupBy("operation").agg(F.min("created_at").alias("first"), F.max("updated_at").alias("last"), F.count("*").alias("n_edges"))


@_query(f"""{ctes("event_relation")}, m AS (SELECT CASE WHEN a % 10 = 1 THEN a - 1 ELSE a END AS x, CASE WHEN b % 10 = 1 THEN b - 1 ELSE b END AS y, relation_type FROM (SELECT CAST(substr(from_id, 2) AS BIGINT) AS a, CAST(substr(to_id, 2) AS BIGINT) AS b, relation_type FROM g_event_relation))
  SELECT DISTINCT 'e' || x AS from_id, 'e' || y AS to_id, relation_type FROM m WHERE x <> y""")
def relinked_relations(spark, d) -> DataFrame:
    g = graph(spark, d)
    to = g["events"].filter("n % 10 = 1").select("id", F.concat(F.lit("e"), F.col("n") - 1).alias("canonical"))
    # of the last event's relation the far end does not exist, and so is not merged
    far = g["event_relation"].select(F.col("to_id").alias("id"), F.expr("cast(substr(to_id, 2) as bigint)").alias("n")).filter("n % 10 = 1").select("id", F.concat(F.lit("e"), F.col("n") - 1).alias("canonical"))
    return mutations.relink(g["event_relation"], to.union(far).distinct(), ["from_id", "to_id"], ["from_id", "to_id", "relation_type"]).select("from_id", "to_id", "relation_type")


@_query(f"{ctes('entities')} SELECT CASE WHEN hit AND known IS NULL THEN 'created' WHEN hit AND NOT coalesce(known, false) THEN 'promoted' WHEN hit THEN 'updated' END AS outcome, count(*) AS n_entities FROM (SELECT e.registered AS known, r.id IS NOT NULL AS hit FROM g_entities e FULL JOIN (SELECT DISTINCT 'user_' || (user_id * 2 - user_id % 3) AS id FROM events) r USING (id)) GROUP BY 1")
def registered_outcomes(spark, d) -> DataFrame:
    g = graph(spark, d)
    table = g["entities"].withColumns({"aliases": F.expr("cast(null as array<string>)"), "updated_at": F.lit(None).cast("long")})
    ids = spark.read.parquet(f"{d}/events.parquet").select(F.expr("concat('user_', user_id * 2 - user_id % 3)").alias("id")).distinct()
    rows = ids.withColumns({"type": F.lit("person"), "description": F.lit(""), "aliases": F.expr("array('x')")})
    return mutations.register_entities(table, rows, NOW).groupBy("outcome").agg(F.count("*").alias("n_entities"))


@_query("SELECT DISTINCT 'pattern_' || substr(sha256('src:' || source), 1, 16) AS id, 'src:' || source AS entity_id FROM documents WHERE source IS NOT NULL")
def stored_patterns(spark, d) -> DataFrame:
    rows = spark.read.parquet(f"{d}/documents.parquet").filter("source is not null").select(F.concat(F.lit("src:"), "source").alias("entity_id"), F.lit("body").alias("content"))
    none = spark.createDataFrame([], "id string, entity_id string, content string, created_at long, updated_at long")
    return mutations.put_patterns(none, rows, NOW).select("id", "entity_id")


@_query(f"{ctes('entities')} SELECT 'USER_' || user_id AS name, 'user_' || user_id AS id, 'exact_match' AS reason, CAST(1.0 AS DOUBLE) AS score FROM (SELECT DISTINCT user_id FROM events) JOIN g_entities e ON e.id = 'user_' || user_id AND e.registered")
def resolved_mentions(spark, d) -> DataFrame:
    g = graph(spark, d)
    mentions = spark.read.parquet(f"{d}/events.parquet").select(F.concat(F.lit("USER_"), "user_id").alias("name"), F.lit("person").alias("type"), F.expr("cast(null as array<double>)").alias("embedding")).distinct()
    known = g["entities"].withColumn("description_embedding", F.expr("cast(null as array<double>)"))
    return entities.resolve(mentions, known)


@_query(f"""{ctes("contexts")} SELECT id, CASE WHEN low < 0.25 THEN 'deprecated' ELSE 'weakened' END AS status, round(low, 6) AS confidence, CASE WHEN low < 0.25 THEN {NOW} END AS valid_to FROM (SELECT *, greatest(0.0, confidence - 0.04) AS low FROM g_contexts)""")
def weakened_contexts(spark, d) -> DataFrame:
    return contexts.weakened(graph(spark, d)["contexts"], NOW).select("id", "status", F.round("confidence", 6).alias("confidence"), "valid_to")


@_query(f"{ctes('contexts', 'in_rel')} SELECT event_id, context_id, round(greatest(0.3, least(1.0, c.confidence)), 6) AS confidence, round(greatest(0.1, least(5.0, 1 + ln(1 + support_count))), 6) AS weight FROM g_in_rel r JOIN g_contexts c ON c.id = r.context_id")
def context_edges(spark, d) -> DataFrame:
    g = graph(spark, d)
    return contexts.edges_for(g["in_rel"].select("event_id", "context_id"), g["contexts"]).select("event_id", "context_id", F.round("confidence", 6).alias("confidence"), F.round("weight", 6).alias("weight"))


@_query(f"{ctes('contexts')} SELECT a.id, round(CASE WHEN x = 0 OR y = 0 THEN 0.7 ELSE greatest(0.3, exp(-abs(x - y) / 2592000.0)) END, 6) AS compatible FROM (SELECT id, valid_from AS x, last_seen_at AS y FROM g_contexts) a")
def temporal_compatibility(spark, d) -> DataFrame:
    none = F.lit(None).cast("long")
    return graph(spark, d)["contexts"].select("id", F.round(M.temporal_compatibility(F.col("valid_from"), none, F.col("last_seen_at"), none), 6).alias("compatible"))


@_query(f"{ctes('events')} SELECT id, md5(concat_ws(' ', summary, action, causality, CASE WHEN payload <> '{{}}' THEN payload END)) AS searched, sha256(summary) AS hashed FROM g_events")
def event_texts(spark, d) -> DataFrame:
    return graph(spark, d)["events"].select("id", F.md5(T.event_text(payload="payload")).alias("searched"), M.hash_text("summary").alias("hashed"))


@_query(f"{ctes('events')} SELECT id, substr(sha256(summary), 1, 20) || '_' || timestamp || '_' || substr(sha256(session_id || '|' || n), 1, 6) AS key FROM g_events")
def event_keys(spark, d) -> DataFrame:
    return graph(spark, d)["events"].select("id", M.event_key("summary", "timestamp", "session_id", "n").alias("key"))


@_query(f"{ctes('events')} SELECT id, timestamp AS parsed, CAST(timestamp AS BIGINT) // 86400 * 86400 AS day FROM g_events")
def parsed_times(spark, d) -> DataFrame:
    at = F.timestamp_seconds("timestamp")
    return graph(spark, d)["events"].select("id", M.parse_time(F.date_format(at, "yyyy-MM-dd HH:mm:ss")).alias("parsed"), M.parse_time(F.date_format(at, "yyyy-MM-dd")).alias("day"))


@_query("SELECT event_id, event_type AS summary, event_type AS action, CASE WHEN event_id % 3 = 0 THEN 'why ' || user_id ELSE '' END AS causality, 'user ' || user_id || CASE WHEN event_id % 2 = 0 THEN '/front' ELSE '' END AS people FROM events")
def normalized_payloads(spark, d) -> DataFrame:
    who = F.array(F.to_json(F.struct(F.expr("concat('user ', user_id)").alias("role"), F.when(F.col("event_id") % 2 == 0, "front").alias("seat"))))
    body = F.concat(F.lit('{"Action": "'), "event_type", F.lit('", "participants": ['), F.array_join(who, ","), F.lit("]"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(', "reason": "why '), "user_id", F.lit('"'))).otherwise(""), F.lit("}"))
    wrapped = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('{"event": '), body, F.lit("}"))).otherwise(body)
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", wrapped.alias("payload"))
    return payloads.normalized_payloads(rows).select("event_id", "summary", "action", "causality", F.array_join(payloads.labels(F.col("participants")), ",").alias("people"))


@_query("SELECT event_id, CAST(i AS INTEGER) AS event_index FROM events, (VALUES (0), (1)) v(i) WHERE event_id % 4 <> 0 AND (event_id % 2 = 0 OR i = 0)")
def payload_items(spark, d) -> DataFrame:
    one = F.concat(F.lit('{"summary": "'), "event_type", F.lit('"}'))
    n = F.col("event_id")
    answer = F.when(n % 4 == 0, F.lit('{"events": [{"note": ""}, "text"]}')).when(n % 2 == 0, F.concat(F.lit('{"events": ['), one, F.lit(", "), one, F.lit("]}"))).otherwise(one)
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", answer.alias("payload"))
    return payloads.event_items(rows).select("event_id", "event_index")


@_query(f"""{ctes("events", "involves", "in_rel", "contexts")}, c AS (SELECT id FROM g_contexts WHERE status = 'active' ORDER BY last_seen_at DESC, id LIMIT 64), near AS (SELECT id FROM c QUALIFY row_number() OVER (ORDER BY (SELECT last_seen_at FROM g_contexts g WHERE g.id = c.id) DESC) <= 16)
  SELECT DISTINCT id FROM g_events WHERE id IN (SELECT event_id FROM g_involves WHERE entity_id = 'user_2') OR id IN (SELECT id FROM g_events WHERE id IN (SELECT event_id FROM g_in_rel WHERE context_id IN (SELECT id FROM near)) ORDER BY last_active DESC, id LIMIT 40)""")
def candidate_events(spark, d) -> DataFrame:
    """All contexts have the same text and confidence here, so the newest 16 count and the query tests the pools and the union."""
    g = graph(spark, d)
    same = g["contexts"].withColumns({"confidence": F.lit(0.5), "summary": F.lit("user_2"), "description": F.lit("user_2"), "support_count": F.lit(1)})
    return recall.candidate_events(g["events"], g["involves"], g["in_rel"], same, "user_2", ["user_2"]).select("id")


@_query(f"{ctes('events')} SELECT id, CASE WHEN n % 2 = 0 THEN timestamp ELSE last_active END AS at FROM g_events")
def event_order(spark, d) -> DataFrame:
    """Every second event has no timestamp and is ordered by its last activity."""
    e = graph(spark, d)["events"].withColumn("timestamp", F.when(F.col("n") % 2 == 0, F.col("timestamp")).otherwise(0))
    return e.select("id", relations.sort_key()["at"].alias("at"))


@_query("SELECT CAST(doc_id AS VARCHAR) AS entity_id, 'full' AS mode, CASE WHEN text IS NULL THEN 0 ELSE length(text) END AS total_chars FROM documents WHERE text IS NOT NULL")
def full_patterns(spark, d) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet").filter("text is not null").select(F.col("doc_id").cast("string").alias("entity_id"), F.col("text").alias("content"))
    return patterns.recall_patterns(docs, "", "full", 1).select("entity_id", "mode", "total_chars")


@_query("SELECT event_id, trim(coalesce(CASE WHEN event_id % 3 > 0 THEN event_type END, '')) || '|' || '|' || CASE WHEN event_id % 3 = 2 THEN 'why' ELSE '' END AS signature FROM events WHERE event_id % 3 > 0 UNION ALL SELECT event_id, '' FROM events WHERE event_id % 3 = 0")
def payload_signatures(spark, d) -> DataFrame:
    n = F.col("event_id")
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.when(n % 3 > 0, F.concat(F.lit(" "), "event_type")).alias("summary"), F.lit(" ").alias("action"), F.when(n % 3 == 2, "why").alias("causality"))
    return rows.select("event_id", payloads.signature().alias("signature"))


@_query("SELECT event_id, CAST(i AS INTEGER) AS context_index, event_type || i AS summary FROM events, (VALUES (0), (2)) v(i) WHERE event_id % 3 = 0")
def orphan_contexts(spark, d) -> DataFrame:
    item = lambda i: F.concat(F.lit('{"summary": "'), "event_type", F.lit(f'{i}"}}'))
    n = F.col("event_id")
    answer = F.when(n % 3 == 0, F.concat(F.lit('{"orphan_contexts": ['), item(0), F.lit(', "text", '), item(2), F.lit("]}"))).when(n % 3 == 1, F.lit('{"orphan_contexts": "none"}')).otherwise(F.lit('{"events": []}'))
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", "event_type", answer.alias("payload"))
    return payloads.orphan_contexts(rows).select("event_id", "context_index", F.get_json_object("context", "$.summary").alias("summary"))


@_query(f"{ctes('events')} SELECT id, CASE WHEN n % 2 = 0 THEN id END AS event_id, CASE WHEN n % 2 = 0 THEN CAST(timestamp AS VARCHAR) END AS at, summary AS evidence_span, CASE WHEN n % 2 = 0 THEN 5 ELSE 3 END AS n_fields FROM g_events")
def made_source_refs(spark, d) -> DataFrame:
    e = graph(spark, d)["events"]
    ref = contexts.source_refs("record", F.col("summary"), F.lit("stated"), F.when(F.col("n") % 2 == 0, F.col("id")), F.col("timestamp"))[0]
    return e.select("id", ref["event_id"].alias("event_id"), ref["timestamp"].alias("at"), ref["evidence_span"].alias("evidence_span"), F.size(ref).alias("n_fields"))


@_query(f"{ctes('events')}, t AS (SELECT DISTINCT 'u' || user_id AS user_id, id AS event_id, CASE WHEN n % 8 = 0 THEN 5 ELSE {NOW} END AS t_created FROM g_events WHERE n % 4 = 0) SELECT user_id, event_id, CAST(t_created AS BIGINT) AS t_created FROM t")
def promoted_traits(spark, d) -> DataFrame:
    e = graph(spark, d)["events"]
    own = lambda rows: rows.select(F.concat(F.lit("u"), "user_id").alias("user_id"), F.col("id").alias("event_id"))
    known = own(e.filter("n % 8 = 0")).withColumn("t_created", F.lit(5).cast("long"))
    asked = own(e.filter("n % 4 = 0"))
    unknown = asked.limit(1).withColumn("event_id", F.lit("nowhere"))
    users = asked.select(F.col("user_id").alias("id")).limit(0)
    return mutations.promote_traits(users, known, asked.union(asked).union(unknown), e, NOW)[1]
