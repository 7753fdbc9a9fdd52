"""Queries through a memory over versioned tables: what is written in several steps is what the SQL says.

Each fills a namespace of its own in the shared folder from the driver's whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..memory import Memory
from ..operators import mutations, recall, relations, scans
from ..sources.catalog import Catalog
from ..sources.lines import merge_payloads, robust_json
from ..sources.shared import fresh_dir
from ..streaming import ingest
from .demo import ctes, graph
from .lookups import NOW, _query


def _memory(spark) -> Memory:
    return Memory(spark, fresh_dir(spark, "memory"))


_WRITTEN = f"""{ctes("events")}, w AS (SELECT id, CASE WHEN n % 10 = 0 THEN 'again' ELSE summary END AS summary, timestamp AS created_at, CASE WHEN n % 20 = 5 THEN 'archived' ELSE 'active' END AS status, CASE WHEN n % 20 = 5 THEN {NOW} END AS valid_to, n FROM g_events WHERE id NOT IN ('e8', 'e9')
  UNION ALL SELECT 'x' || id, 'again', timestamp + 5, 'active', NULL, NULL FROM g_events WHERE n % 100 = 0)"""


@_query(_WRITTEN.replace("n % 20 = 5", "id IN ('e5', 'e7')") + " SELECT id, summary, created_at, status, valid_to FROM w")
def memory_writes(spark, d) -> DataFrame:
    """Events written, some written again or added, two archived, two deleted."""
    e, m = graph(spark, d)["events"], _memory(spark)
    m.write(e.select("id", "summary", "action", "timestamp"), "event")
    more = lambda rows, id_: rows.select(id_.alias("id"), F.lit("again").alias("summary"), (F.col("timestamp") + 5).alias("timestamp"))
    m.write(more(e.filter("n % 10 = 0"), F.col("id")).unionByName(more(e.filter("n % 100 = 0"), F.concat(F.lit("x"), "id"))), "event")
    m.remove(["e5", "e7"], now=NOW)
    m.remove(["e8", "e9", "nowhere"], hard=True)
    return m.table("events").select("id", "summary", "created_at", "status", "valid_to")


@_query(f"""{ctes("events")}, l AS (SELECT id AS event_id, 'kind_' || event_type AS entity_id, 1 + CASE WHEN n % 4 = 0 THEN 1 ELSE 0 END AS c_valid FROM g_events WHERE n % 2 = 0 AND id NOT IN ('e8', 'e12'))
  SELECT entity_id, count(*) AS n_events, CAST(sum(c_valid) AS BIGINT) AS c_valid, max(CASE WHEN c_valid = 2 THEN 7 ELSE 5 END) AS t_valid FROM l GROUP BY entity_id""")
def memory_links(spark, d) -> DataFrame:
    """Links of every second event, counted up for every fourth, gone with deleted events."""
    e, m = graph(spark, d)["events"].select("id", "summary", "timestamp", "n", "event_type"), _memory(spark)
    links = lambda rows: rows.select(F.col("id").alias("event_id"), F.concat(F.lit("kind_"), "event_type").alias("entity_id"))
    m.write(e.drop("n", "event_type"), "event", links(e.filter("n % 2 = 0")), 5)
    m.write(e.filter("n % 4 = 0").drop("n", "event_type"), "event", links(e.filter("n % 4 = 0")), 7)
    m.remove(["e8", "e12"], hard=True)
    return m.table("involves").groupBy("entity_id").agg(F.count("*").alias("n_events"), F.sum("c_valid").alias("c_valid"), F.max("t_valid").alias("t_valid"))


@_query("""WITH t AS (SELECT conv_id, turn, trim(text) AS s FROM conversations WHERE trim(coalesce(text, '')) <> ''), a AS (SELECT turn + 1 AS timestamp, count(*) AS n FROM t GROUP BY turn), e AS (SELECT turn + 1 AS timestamp, count(*) AS n FROM conversations GROUP BY turn)
  SELECT e.timestamp, coalesce(a.n, 0) AS n_events, coalesce(a.n, 0) AS n_edges, e.n AS n_episodes FROM e LEFT JOIN a USING (timestamp)""")
def memory_ingest(spark, d) -> DataFrame:
    """Turns as episodes, taken in twice in part: their events, edges and episodes by time."""
    turns, m = spark.read.parquet(f"{d}/conversations.parquet"), _memory(spark)
    episodes = turns.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("content"), (F.col("turn") + 1).alias("timestamp"))
    m.ingest(episodes.filter("timestamp % 3 <> 0"), now=NOW)
    m.ingest(episodes.filter("timestamp % 2 <> 0 or timestamp % 3 = 0"), now=NOW)
    m.ingest(episodes, now=NOW)
    events = m.table("events").select("id", "timestamp")
    edges = m.table("extracted_from").select(F.col("event_id").alias("id")).join(events, "id").groupBy("timestamp").agg(F.count("*").alias("n_edges"))
    counts = events.groupBy("timestamp").agg(F.count("*").alias("n_events"))
    return m.table("episodes").groupBy("timestamp").agg(F.count("*").alias("n_episodes")).join(counts, "timestamp", "left").join(edges, "timestamp", "left").fillna(0)


@_query("""WITH u AS (SELECT user_id, count(*) AS n FROM (SELECT DISTINCT event_id, user_id FROM events) GROUP BY user_id) SELECT CASE WHEN user_id % 2 = 0 THEN 'user_' || user_id ELSE 'u' || user_id END AS entity_id, user_id % 2 = 0 AS registered, n AS n_events,
  CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END AS merged FROM u""")
def memory_entities(spark, d) -> DataFrame:
    """Users known by a nickname, half of them registered with it as an alias: nicknames merge into who they stand for."""
    raw, m = spark.read.parquet(f"{d}/events.parquet"), _memory(spark)
    rows = raw.select(F.concat(F.lit("e"), "event_id").alias("id"), F.lit("seen").alias("summary"), F.lit(1).cast("long").alias("timestamp"))
    m.write(rows, "event", raw.select(F.concat(F.lit("e"), "event_id").alias("event_id"), F.concat(F.lit("u"), "user_id").alias("entity_id")), 1)
    even = raw.filter("user_id % 2 = 0").select("user_id").distinct()
    m.register_entities(even.select(F.concat(F.lit("user_"), "user_id").alias("id"), F.lit("person").alias("type"), F.lit("").alias("description"), F.array(F.concat(F.lit("U"), "user_id")).alias("aliases")), NOW)
    twins = m.table("entities").filter("status = 'merged'").groupBy(F.col("canonical_id").alias("entity_id")).agg(F.count("*").cast("int").alias("merged"))
    live = m.table("entities").filter("status = 'active'").select(F.col("id").alias("entity_id"), "registered")
    counts = m.table("involves").groupBy("entity_id").agg(F.count("*").alias("n_events"))
    return live.join(counts, "entity_id").join(twins, "entity_id", "left").fillna(0, ["merged"])


@_query("SELECT 'user_' || user_id AS entity_id, '## Port' || chr(10) || 'again ' || user_id AS content, CAST(1 AS BIGINT) AS created_at, CAST(2 AS BIGINT) AS updated_at FROM (SELECT DISTINCT user_id FROM events) WHERE user_id <> 4")
def memory_patterns(spark, d) -> DataFrame:
    """A document for each registered user, replaced once, one deleted."""
    users, m = spark.read.parquet(f"{d}/events.parquet").select("user_id").distinct(), _memory(spark)
    ids = F.concat(F.lit("user_"), "user_id")
    m.register_entities(users.select(ids.alias("id"), F.lit("person").alias("type"), F.lit("").alias("description"), F.expr("cast(array() as array<string>)").alias("aliases")), NOW)
    for now, word in ((1, "first "), (2, "again ")):
        m.put_patterns(users.select(ids.alias("entity_id"), F.concat(F.lit(f"## Port\n{word}"), "user_id").alias("content")), now)
    m.delete_patterns(["user_4"])
    return m.table("patterns").select("entity_id", "content", "created_at", "updated_at")


@_query(f"""{ctes("events", "contexts", "in_rel", "event_relation")} SELECT 'events' AS name, count(*) AS n, CAST(sum(n) AS BIGINT) AS s FROM (SELECT n FROM g_events WHERE status = 'active' ORDER BY last_active DESC, id LIMIT 50)
  UNION ALL SELECT 'contexts', count(*), CAST(sum(n) AS BIGINT) FROM (SELECT n FROM g_contexts WHERE status = 'active' ORDER BY last_seen_at DESC, id LIMIT 50)
  UNION ALL SELECT 'event_context', count(*), CAST(sum(n) AS BIGINT) FROM (SELECT e.n FROM g_in_rel r JOIN g_events e ON e.id = event_id AND e.status = 'active' JOIN g_contexts c ON c.id = context_id AND c.status = 'active' ORDER BY r.updated_at DESC, event_id, context_id LIMIT 250)
  UNION ALL SELECT 'event_event', count(*), CAST(sum(n) AS BIGINT) FROM (SELECT a.n FROM g_event_relation r JOIN g_events a ON a.id = from_id AND a.status = 'active' JOIN g_events b ON b.id = to_id AND b.status = 'active' ORDER BY r.updated_at DESC, from_id, to_id LIMIT 250)""")
def memory_snapshot(spark, d) -> DataFrame:
    """What a query of the whole memory lists, with its edges."""
    g, m = graph(spark, d), _memory(spark)
    for name in ("events", "contexts", "in_rel", "event_relation"):
        m.space.append(name, g[name])
    got = m.query(graph=True)
    total = lambda name, key: got[name].select(F.substring(key, 2, 20).cast("long").alias("k")).agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.sum("k").alias("s"))
    return total("events", "id").unionByName(total("contexts", "id")).unionByName(total("event_context", "event_id")).unionByName(total("event_event", "from_id"))


@_query("""SELECT 'cust' || c_custkey AS user_id, CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 1 END AS n_keys, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS n_databases FROM customer WHERE c_custkey <> 5""")
def catalog_details(spark, d) -> DataFrame:
    """Customers as users with a key and a database each, some keys revoked, a third with one more database, one user deleted."""
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("k"), F.concat(F.lit("cust"), "c_custkey").alias("user_id"))
    none = lambda kind: F.lit(None).cast(kind)
    users = c.select("user_id", F.col("user_id").alias("name"), F.lit(False).alias("is_root"), F.lit(1).cast("long").alias("created_at"))
    keys = c.select(F.concat(F.lit("key"), "k").alias("key_id"), "user_id", F.sha2("user_id", 256).alias("token_hash"), F.lit("r").alias("scopes"), F.when(F.col("k") % 2 == 0, F.lit(9)).cast("long").alias("revoked_at"), none("long").alias("last_used_at"), F.lit(1).cast("long").alias("created_at"))
    bases = c.withColumn("copy", F.explode(F.when(F.col("k") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select(F.concat_ws("-", F.lit("db"), "k", "copy").alias("db_id"), "user_id", F.lit("mine").alias("name"), F.lit("active").alias("status"), F.lit(1).cast("long").alias("created_at"))
    own = Catalog(spark, {"users": users, "api_keys": keys, "databases": bases}).delete_user("cust5").archive_database("db-7-0")
    return own.user_detail().select("user_id", F.col("n_keys").cast("int").alias("n_keys"), F.col("n_databases").cast("int").alias("n_databases"))


@_query(f"""{ctes("events")}, q AS (SELECT 'e' || n AS query_id, 'e' || (n + 3) AS cand_id, n FROM g_events WHERE 'e' || (n + 3) IN (SELECT id FROM g_events)), x AS (SELECT q.*, a.timestamp AS t, b.timestamp AS u, a.last_active AS la, b.last_active AS lb, a.session_id AS s FROM q JOIN g_events a ON a.id = query_id JOIN g_events b ON b.id = cand_id),
  y AS (SELECT *, CASE n % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE (t, query_id) < (u, cand_id) END AS forward FROM x WHERE n % 4 <> 3)
  SELECT CASE WHEN forward THEN query_id ELSE cand_id END AS from_id, CASE WHEN forward THEN cand_id ELSE query_id END AS to_id, CASE WHEN n % 2 = 0 THEN '意义更新' ELSE '共同背景' END AS relation_type, s AS source_session_id, greatest(1600000000, la, lb) AS updated_at FROM y""")
def executed_edges(spark, d) -> DataFrame:
    """Edges of executed decisions, in each kind of direction."""
    e = graph(spark, d)["events"]
    n = F.col("n")
    pairs = e.select(F.col("id").alias("query_id"), F.concat(F.lit("e"), n + 3).alias("cand_id"), "n").join(e.select(F.col("id").alias("cand_id")), "cand_id", "left_semi")
    done = pairs.select("query_id", "cand_id", F.when(n % 4 == 3, "skipped").otherwise("executed").alias("status"), F.when(n % 2 == 0, "supersedes").otherwise("co_recall").alias("operation"), F.lit(0.9).alias("confidence"), F.when(n % 3 == 0, "new_to_candidate").when(n % 3 == 1, "candidate_to_new").otherwise("").alias("direction"))
    return relations.edges_of(done, e, 1_600_000_000).select("from_id", "to_id", "relation_type", "source_session_id", "updated_at")


@_query(f"""{ctes("contexts", "in_rel")}, v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), c AS (SELECT 'c' || n AS id, status, greatest(0.0, least(1.0, list_sum([x * 0.125 for x in v]) / sqrt(list_dot_product(v, v)))) * CASE WHEN status = 'active' THEN 1.0 ELSE 0.5 END AS s FROM g_contexts JOIN v ON v.vec_id = n)
  SELECT event_id AS id, round(max(s), 6) AS context_match FROM g_in_rel JOIN c ON c.id = context_id GROUP BY event_id""")
def context_matches(spark, d) -> DataFrame:
    """Of every event the best of its contexts for a query's vector."""
    g = graph(spark, d)
    v = spark.read.parquet(f"{d}/embeddings.parquet").select(F.concat(F.lit("c"), "vec_id").alias("id"), "embedding")
    found = recall.context_match(g["events"].select("id"), g["in_rel"], g["contexts"].join(v, "id"), [0.125] * 64)
    return found.select("id", F.round("context_match", 6).alias("context_match"))


@_query("SELECT user_id, time_bucket(INTERVAL '1 hour', ts) AS starts, count(*) AS n FROM events GROUP BY ALL")
def hourly_counts(spark, d) -> DataFrame:
    """Events of a user by the hour; the same query counts a stream."""
    found = ingest.windowed_counts(spark.read.parquet(f"{d}/events.parquet"), "ts", "user_id")
    return found.select("user_id", F.col("window.start").cast("timestamp_ntz").alias("starts"), "n")


@_query("""WITH l AS (SELECT user_id, ts, ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '12 hours' AS cut FROM events), s AS (SELECT user_id, ts, sum(CASE WHEN coalesce(cut, true) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM l)
  SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, d) -> DataFrame:
    """Runs of a user's events with gaps under twelve hours."""
    found = ingest.sessions(spark.read.parquet(f"{d}/events.parquet"), "ts", "user_id", "12 hours")
    return found.select("user_id", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"), "n")


@_query("""SELECT event_id, '{"k": ' || json_extract_string(props, '$.k') || ', "kind": "' || event_type || '", "list": [1, ' || CASE WHEN event_id % 2 = 0 THEN '' ELSE '7, ' END || '2], "deep": {"a": 1, "b": 2}}' AS merged, CASE WHEN event_id % 3 = 0 THEN NULL ELSE '{"k": ' || json_extract_string(props, '$.k') || '}' END AS found FROM events""")
def merged_json(spark, d) -> DataFrame:
    """Payloads merged with a second one, and payloads found in a model's answer."""
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", "props", "event_type", F.get_json_object("props", "$.k").alias("k"))
    a = F.concat(F.lit('{"k": '), "k", F.lit(', "kind": "", "list": [1'), F.when(F.col("event_id") % 2 == 0, "").otherwise(", 7"), F.lit('], "deep": {"a": 1, "b": null}}'))
    b = F.concat(F.lit('{"k": -1, "kind": "'), "event_type", F.lit('", "list": [1, 2], "deep": {"a": 5, "b": 2}}'))
    answer = F.when(F.col("event_id") % 3 == 0, F.lit("sorry, {none")).otherwise(F.concat(F.lit("here {it is: {\"k\": "), "k", F.lit("} done")))
    return rows.select("event_id", merge_payloads(a, b).alias("merged"), robust_json(answer).alias("found"))


@_query("SELECT user_id, count(*) AS n FROM (SELECT DISTINCT 'user_' || user_id AS user_id FROM events UNION ALL SELECT 'user_' || user_id FROM (SELECT DISTINCT user_id FROM events) WHERE false) GROUP BY user_id")
def created_entities(spark, d) -> DataFrame:
    """Entities made where they are missing, twice: each once."""
    users = spark.read.parquet(f"{d}/events.parquet").select(F.concat(F.lit("user_"), "user_id").alias("id"))
    none = spark.createDataFrame([], "id string")
    once = mutations.insert_missing(mutations.insert_missing(none, users, ["id"]), users, ["id"])
    return once.groupBy(F.col("id").alias("user_id")).agg(F.count("*").alias("n"))


@_query(f"""{ctes("entities", "contexts", "events")} SELECT 'entities' AS pool, count(*) AS n FROM g_entities WHERE registered AND coalesce(status = 'active', true) UNION ALL SELECT 'contexts', least(240, count(*)) FROM g_contexts WHERE status = 'active' UNION ALL SELECT 'events', least(240, count(*)) FROM g_events WHERE status = 'active'""")
def anchor_pools(spark, d) -> DataFrame:
    g = graph(spark, d)
    pools = scans.task_anchor_pools(g["entities"], g["contexts"], g["events"])
    one = lambda name: pools[name].agg(F.lit(name).alias("pool"), F.count("*").alias("n"))
    return one("entities").unionByName(one("contexts")).unionByName(one("events"))


@_query("SELECT conv_id, turn, CASE WHEN role = lower(role) THEN role ELSE lower(role) END || '|T' || turn AS said FROM conversations")
def spelled_terms(spark, d) -> DataFrame:
    """First spellings of repeated terms."""
    low, turn = F.lower("role"), F.col("turn").cast("string")
    terms = T.first_spellings(F.array(low, F.upper("role"), F.lit(""), F.concat(F.lit("T"), turn), F.concat(F.lit("t"), turn)))
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.array_join(terms, "|").alias("said"))
