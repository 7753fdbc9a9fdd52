"""Queries for text, time and row functions over whole tables, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import measures as M
from ..functions import text as T
from ..operators import consolidation, contexts, joins, mutations, reports, scans
from ..plans.model import context_status, context_subtype, relation_type, with_event_defaults
from .demo import ctes, graph
from .lookups import NOW, _query

_CLAUSE, _NAMES, _FRAGMENT = "' ，,。；;'", "' ，,。；;：:\"''()[]{}'", "' ，,。；;:：|'"
_LINE = "regexp_replace(x, '\\s+', ' ', 'g')"


def _conversations(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", T.text("text").alias("x"))


_SAID = "SELECT conv_id, turn, role, coalesce(text, '') AS x FROM conversations"


def _trimmed(line: str, limit: int) -> str:
    return f"CASE WHEN len({line}) <= {limit} THEN {line} ELSE rtrim(regexp_replace(substr({line}, 1, {limit - 1}), '[ ，,。；;]+$', '')) || '…' END"


@_query(f"""WITH c AS ({_SAID}), l AS (SELECT *, trim({_LINE}, {_CLAUSE}) AS line, trim(regexp_replace(regexp_replace(trim(x), '\\s+', ' ', 'g'), '\\b20\\d{{2}}[-/]\\d{{1,2}}[-/]\\d{{1,2}}\\s+\\d{{1,2}}:\\d{{2}}(?::\\d{{2}})?\\b', '', 'g'), {_FRAGMENT}) AS fragment,
    trim({_LINE}, {_NAMES}) AS name, trim(regexp_replace(lower(x), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM c), j AS (SELECT *, CASE WHEN line = '' OR line = role THEN role ELSE role || '；' || line END AS duo FROM l)
  SELECT conv_id, turn, {_trimmed("line", 60)} AS line, {_trimmed("duo", 80)} AS clause, CASE WHEN len(fragment) > 40 THEN rtrim(substr(fragment, 1, 40)) || '...' ELSE fragment END AS fragment, CASE WHEN len(name) > 1 THEN name ELSE '' END AS name, substr(slug, 1, 30) AS slug FROM j""")
def text_lines(spark, d) -> DataFrame:
    """Turns as lines, clauses, fragments, names and slugs."""
    return _conversations(spark, d).select("conv_id", "turn", T.trim_line("x", 60).alias("line"), T.join_clause("role", "x", limit=80).alias("clause"), T.clean_fragment("x", 40).alias("fragment"), T.entity_name("x").alias("name"), T.slug("x").alias("slug"))


_MARKED = "concat('# ', source, '\n- ', lang, '\n\n  * item ', doc_id, '\n### ', lang, '\n', substr(text, 1, 90))"


@_query(f"""WITH d AS (SELECT doc_id, string_split_regex(coalesce({_MARKED.replace(chr(10), "' || chr(10) || '")}, ''), '\\r\\n?|\\n') AS ls FROM documents),
  p AS (SELECT doc_id, [trim(regexp_replace(regexp_replace(regexp_replace(trim(l), '^#{{1,6}}\\s*', ''), '^[-*]\\s*', ''), '\\s+', ' ', 'g'), {_CLAUSE}) for l in ls] AS ps FROM d),
  q AS (SELECT doc_id, array_to_string(list_filter(ps, lambda y, i: y <> '' AND list_position(ps, y) = i), '；') AS line FROM p) SELECT doc_id, {_trimmed("line", 160)} AS clause FROM q""")
def markdown_clauses(spark, d) -> DataFrame:
    """Markdown made of every document, as one clause."""
    marked = F.concat(F.lit("# "), "source", F.lit("\n- "), "lang", F.lit("\n\n  * item "), F.col("doc_id").cast("string"), F.lit("\n### "), "lang", F.lit("\n"), F.substring("text", 1, 90))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", T.plain_markdown(marked).alias("clause"))


_CARD_ROWS = f"{ctes('contexts')}, c AS (SELECT id, subject, condition, summary, trim(description) AS description, substr(id, 2) AS v FROM g_contexts)"
_CLIP = "substr(trim(regexp_replace({x}, '\\s+', ' ', 'g'), ' ，,。；;：:'), 1, {n})"


@_query(f"""{_CARD_ROWS}, r AS (SELECT *, '背景条件：' || {_CLIP.format(x="condition", n=192)} || ' 实况：lot：' || v || ' 适用：' || {_CLIP.format(x="subject", n=192)} AS parts, {_CLIP.format(x="description", n=512)} AS rest FROM c)
  SELECT id, condition || '；lot' || v || '；适用于' || subject AS card, md5('主体：' || subject || ' 背景条件：' || condition || ' 实况：lot：' || v || ' 适用：' || subject || CASE WHEN description <> '' THEN ' ' || description ELSE '' END) AS labelled,
    md5(concat_ws(' ', subject, condition, 'lot ' || v, subject, summary, nullif(description, ''))) AS said, md5({_CLIP.format(x="replace(parts, ' 实况：', '。实况：') || CASE WHEN rest <> '' AND NOT contains(parts, rest) THEN '。' || rest ELSE '' END", n=512)}) AS told FROM r""".replace("replace(parts, ' 实况：', '。实况：')", "replace(replace(parts, ' 实况：', '。实况：'), ' 适用：', '。适用：')"))
def context_cards(spark, d) -> DataFrame:
    """Cards, labelled cards, search texts and descriptions of contexts with a fact and a scope."""
    c = graph(spark, d)["contexts"].select("id", "subject", "condition", "summary", F.trim("description").alias("description"), F.col("subject").alias("applies_when"), F.create_map(F.lit("lot"), F.substring("id", 2, 20)).alias("facts"))
    return c.select("id", T.context_card().alias("card"), F.md5(T.labelled_card()).alias("labelled"), F.md5(T.context_text()).alias("said"), F.md5(T.context_description()).alias("told"))


@_query(f"""{ctes("events", "entities")} SELECT id, summary || '；' || action || '；' || causality AS text FROM g_events UNION ALL SELECT id, concat_ws(' ', id, 'twin of ' || id, type, description) FROM g_entities""")
def node_texts(spark, d) -> DataFrame:
    """Cards of events, search texts of entities with an alias."""
    g = graph(spark, d)
    return g["events"].select("id", T.event_card().alias("text")).unionByName(g["entities"].withColumn("aliases", F.array(F.concat(F.lit("twin of "), "id"))).select("id", T.entity_text().alias("text")))


_NORM = "regexp_replace(lower(trim({x})), '[\\s，,。；;：:、/\\\\-]+', '', 'g')"
_NEGATED = "regexp_matches(lower({x}), '" + T.NEGATION + "')"
_SOME = "regexp_matches(lower(x || ' ' || role || ' '), '{words}')"


@_query(f"""WITH c AS ({_SAID}), e AS (SELECT *, substr(x, 5, 20) AS e, trim(substr(x, 1, 130)) AS s FROM c), n AS (SELECT *, {_NORM.format(x="e")} AS ne, {_NORM.format(x="x")} AS nx, len(string_split(x, ' ')) AS words FROM e)
  SELECT conv_id, turn, {_NEGATED.format(x="x")} AS negated, regexp_matches(lower(concat_ws(' ', x, role, '')), '{"|".join(T.INTENT_MARKERS)}') AND NOT regexp_matches(lower(concat_ws(' ', x, role, '')), '{"|".join(T.STABLE_MARKERS)}') AS wants,
    CASE WHEN e = '' THEN false WHEN role = '' THEN true ELSE ne <> '' AND contains({_NORM.format(x="role")}, ne) END AS by_role, CASE WHEN e = '' THEN false WHEN x = '' THEN true ELSE ne <> '' AND contains(nx, ne) END AS grounded,
    s <> '' AND len(s) <= 128 AND NOT regexp_matches(s, '[{{}}"]') AND len(trim(x)) <= 512 AS valid, len(list_filter(regexp_extract_all(lower(x), '[a-z0-9_]+'), lambda t: NOT regexp_matches(t, '^[0-9]$'))) AS informative FROM n""")
def turn_signals(spark, d) -> DataFrame:
    """Negation, passing intent, grounded evidence, validity as a draft, informative tokens of every turn."""
    e = F.substring("x", 5, 20)
    return _conversations(spark, d).select("conv_id", "turn", T.contains_negation("x").alias("negated"), T.current_intent("x", "role", F.lit("")).alias("wants"), T.evidence_matches(e, "role").alias("by_role"), T.evidence_matches(e, "x").alias("grounded"), T.valid_draft(F.substring("x", 1, 130), "x").alias("valid"), F.size(T.informative_tokens("x")).cast("long").alias("informative"))


@_query(f"""{ctes("events")}, t AS (SELECT n, timestamp AS t, strftime(to_timestamp(timestamp) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS at, strftime(to_timestamp(timestamp + n % 9000) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS until, CASE n % 5 WHEN 0 THEN 'early morning' WHEN 1 THEN 'at 3 pm' WHEN 2 THEN 'Evening' WHEN 3 THEN '深夜' ELSE 'whenever' END AS label FROM g_events)
  SELECT n, t AS strict, CAST(NULL AS BIGINT) AS loose, CASE n % 5 WHEN 0 THEN 'morning' WHEN 1 THEN 'afternoon' WHEN 2 THEN 'evening' WHEN 3 THEN 'night' ELSE '' END AS bucket, t AS start, CASE WHEN n % 2 = 0 THEN t ELSE t + n % 9000 END AS until, n % 9000 // 60 AS minutes, t < {NOW} - 3600 * n AS expired,
    greatest(0.0, least(1.0, CASE WHEN n % 3 = 0 THEN n / 1000.0 WHEN n % 3 = 1 THEN 0.0 ELSE -1.0 END)) AS confidence, CASE WHEN 0.05 * exp(-(n % 400000) / 172800.0) >= 0.02 THEN 'event_embedding_similarity,temporal_proximity' ELSE 'event_embedding_similarity' END AS reason,
    CASE n % 6 WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 2 WHEN 4 THEN 1 ELSE 0 END AS strength FROM t""")
def times_and_ranges(spark, d) -> DataFrame:
    """Times, parts of the day, ranges, durations, expiry, confidences, reasons and anchor strengths of every event."""
    n = F.col("n")
    clock = lambda s: F.date_format(F.timestamp_seconds(s), "yyyy-MM-dd HH:mm:ss")
    label = F.when(n % 5 == 0, "early morning").when(n % 5 == 1, "at 3 pm").when(n % 5 == 2, "Evening").when(n % 5 == 3, "深夜").otherwise("whenever")
    rows = graph(spark, d)["events"].select("n", "timestamp", clock(F.col("timestamp")).alias("at"), clock(F.col("timestamp") + n % 9000).alias("until"), label.alias("label"))
    known = F.when(n % 3 == 0, (n / 1000.0).cast("string")).when(n % 3 == 1, F.lit("high")).otherwise("-1")
    kind = F.when(n % 6 == 0, "literal").when(n % 6 == 1, "entity").when(n % 6 == 2, "context").when(n % 6 == 3, "event").when(n % 6 == 4, "lexical").otherwise("none")
    span = M.time_range("at", F.when(n % 2 == 1, F.col("until")), "label")
    return rows.select("n", M.strict_time("at").alias("strict"), M.strict_time(F.substring("at", 1, 16)).alias("loose"), M.guessed_bucket("label").alias("bucket"), span["start"].alias("start"), span["end"].alias("until"), M.duration_minutes("at", "until").alias("minutes"), (F.lit(NOW) - F.col("timestamp") > 3600 * n).alias("expired"), M.coerce_confidence(known).alias("confidence"), M.merge_reason(n % 400000).alias("reason"), M.anchor_strength(kind).alias("strength"))


_KIND = "CASE n % 6 WHEN 0 THEN ' Limit ' WHEN 1 THEN 'external-environment' WHEN 2 THEN 'ENV' WHEN 3 THEN 'other' WHEN 4 THEN 'resource' END"
_STATUS = "CASE n % 6 WHEN 0 THEN 'Active' WHEN 1 THEN ' removed' WHEN 2 THEN 'weakened' WHEN 3 THEN 'odd' WHEN 4 THEN 'merged' END"
_EDGE = "CASE n % 5 WHEN 0 THEN ' update ' WHEN 1 THEN 'merge' WHEN 2 THEN 'link' WHEN 3 THEN '时序相邻' END"


@_query(f"""{ctes("events")} SELECT n, CASE n % 6 WHEN 0 THEN 'constraint' WHEN 1 THEN 'environment' WHEN 2 THEN 'environment' WHEN 4 THEN 'constraint' ELSE 'situation' END AS subtype, CASE n % 6 WHEN 1 THEN 'deprecated' WHEN 2 THEN 'weakened' WHEN 4 THEN 'merged' ELSE 'active' END AS status,
  CASE n % 5 WHEN 0 THEN '意义更新' WHEN 1 THEN '同一主题' WHEN 2 THEN '共同背景' ELSE '' END AS relation FROM g_events""")
def canonical_names(spark, d) -> DataFrame:
    """Subtypes, statuses and relation types under their canonical names."""
    rows = graph(spark, d)["events"].select("n").selectExpr("n", f"{_KIND} AS kind", f"{_STATUS} AS state", f"{_EDGE} AS edge")
    return rows.select("n", context_subtype("kind").alias("subtype"), context_status("state").alias("status"), relation_type("edge").alias("relation"))


@_query("SELECT CASE WHEN event_id % 2 = 0 THEN 'k' || event_id ELSE sha256('s' || event_id) END AS id, t AS timestamp, t AS last_active, t AS valid_from, CASE WHEN event_id % 4 = 0 THEN 'merged' ELSE 'active' END AS status, CAST(1 AS BIGINT) AS support_count FROM (SELECT event_id, 1 + event_id AS t FROM events)")
def event_defaults(spark, d) -> DataFrame:
    """Events with every second id, every third time and most statuses missing."""
    n = F.col("event_id")
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.when(n % 2 == 0, F.concat(F.lit("k"), n)).alias("id"), F.concat(F.lit("s"), n).alias("summary"), F.when(n % 3 != 0, n + 1).alias("timestamp"), F.when(n % 3 == 0, n + 1).otherwise(F.lit(0)).cast("long").alias("last_active"), F.when(n % 4 == 0, "merged").alias("status"), *[F.lit(None).cast("long").alias(c) for c in ("created_at", "updated_at", "valid_from", "support_count")])
    return with_event_defaults(rows).select("id", "timestamp", "last_active", "valid_from", "status", "support_count")


@_query(f"""{ctes("events")}, v AS (SELECT 'e' || vec_id AS id FROM embeddings), p AS (SELECT id, last_active FROM g_events WHERE status = 'active' ORDER BY last_active DESC, id LIMIT 100000) SELECT id, last_active FROM p WHERE id IN (SELECT id FROM v)""")
def active_vectors(spark, d) -> DataFrame:
    """Active events that have a vector."""
    v = spark.read.parquet(f"{d}/embeddings.parquet").select(F.concat(F.lit("e"), "vec_id").alias("id"), "embedding")
    return scans.active_with_vectors(graph(spark, d)["events"].join(v, "id", "left"), 100_000).select("id", "last_active")


@_query("SELECT CAST(conv_id AS VARCHAR) AS id, max(turn) AS timestamp FROM conversations GROUP BY conv_id HAVING NOT max(turn) < 100 - 97")
def unexpired_episodes(spark, d) -> DataFrame:
    rows = spark.read.parquet(f"{d}/conversations.parquet").groupBy("conv_id").agg(F.max("turn").alias("timestamp"))
    return consolidation.unexpired(rows.select(F.col("conv_id").cast("string").alias("id"), "timestamp"), 100, 97)



@_query(f"""{ctes("entities", "involves")}, k AS (SELECT id FROM g_entities WHERE registered AND id NOT IN ('user_2', 'user_4')), e AS (SELECT id, registered FROM g_entities WHERE NOT (id IN ('user_2', 'user_4') AND registered))
  SELECT (SELECT count(*) FROM k) AS registered, (SELECT count(*) FROM e) AS left_over, (SELECT count(*) FROM g_involves WHERE entity_id IN (SELECT id FROM k)) AS edges""")
def unregistered_entities(spark, d) -> DataFrame:
    """The registry without two entities, and the edges that reach what is still registered."""
    g = graph(spark, d)
    left = mutations.unregistered(g["entities"], ["user_2", "user_4"])
    kept = left.filter("registered")
    edges = g["involves"].join(kept.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    return kept.agg(F.count("*").alias("registered")).crossJoin(left.agg(F.count("*").alias("left_over"))).crossJoin(edges.agg(F.count("*").alias("edges")))  # one row each


@_query(f"""{ctes("events", "contexts")}, i AS (SELECT 'e' || (n - 1) AS event_id, 'c' || (n % 900) AS context_id FROM g_events) SELECT count(*) AS n_edges, count(DISTINCT event_id) AS n_events FROM i WHERE event_id IN (SELECT id FROM g_events) AND context_id IN (SELECT id FROM g_contexts)""")
def linked_existing(spark, d) -> DataFrame:
    """Of edges that point anywhere those whose ends exist."""
    g = graph(spark, d)
    edges = g["events"].select(F.concat(F.lit("e"), F.col("n") - 1).alias("event_id"), F.concat(F.lit("c"), F.col("n") % 900).alias("context_id"))
    return mutations.linked_existing(edges, g["events"], "event_id", g["contexts"], "context_id").agg(F.count("*").alias("n_edges"), F.count_distinct("event_id").alias("n_events"))


_PLAN = "SELECT 'e' || n AS canonical_id, 'e' || (n + 1) AS merged_id FROM g_events WHERE n % 4 = 0 AND 'e' || (n + 1) IN (SELECT id FROM g_events)"


@_query(f"""{ctes("events")}, p AS ({_PLAN}), m AS (SELECT canonical_id, b.summary, b.support_count, b.last_active FROM p JOIN g_events b ON b.id = merged_id)
  SELECT e.id, CASE WHEN m.canonical_id IS NULL OR contains(e.summary, m.summary) THEN e.summary ELSE e.summary || '；' || m.summary END AS summary, CAST(e.support_count + coalesce(m.support_count, 0) AS BIGINT) AS support_count, greatest(e.last_active, coalesce(m.last_active, 0)) AS last_active,
    CASE WHEN e.id IN (SELECT merged_id FROM p) THEN 'merged' ELSE e.status END AS status, CASE WHEN e.id IN (SELECT merged_id FROM p) THEN {NOW} END AS valid_to FROM g_events e LEFT JOIN m ON m.canonical_id = e.id""")
def merged_events(spark, d) -> DataFrame:
    """Every fourth event takes up the next."""
    e = graph(spark, d)["events"]
    plan = e.filter("n % 4 = 0").select(F.col("id").alias("canonical_id"), F.concat(F.lit("e"), F.col("n") + 1).alias("merged_id")).join(e.select(F.col("id").alias("merged_id")), "merged_id", "left_semi")
    return consolidation.apply_merges(e, plan, NOW).select("id", "summary", F.col("support_count").cast("long").alias("support_count"), "last_active", "status", F.col("valid_to").cast("long").alias("valid_to"))


@_query(f"""{ctes("events")}, p AS ({_PLAN}) SELECT merged_id AS source_id, canonical_id AS target_id, 'near' AS merge_reason, 0.5 AS similarity_score, {NOW} AS merged_at, 'v1' AS strategy_version FROM p""")
def written_traces(spark, d) -> DataFrame:
    e = graph(spark, d)["events"]
    plan = e.filter("n % 4 = 0").select(F.col("id").alias("canonical_id"), F.concat(F.lit("e"), F.col("n") + 1).alias("merged_id"), F.lit("near").alias("reason"), F.lit(0.5).alias("score")).join(e.select(F.col("id").alias("merged_id")), "merged_id", "left_semi")
    return consolidation.traces_of(plan, NOW).withColumn("merged_at", F.col("merged_at").cast("long"))


@_query(f"""{ctes("contexts")}, p AS (SELECT 'c' || n AS a, 'c' || (n + 1) AS b FROM g_contexts WHERE n % 3 = 0 AND 'c' || (n + 1) IN (SELECT id FROM g_contexts)), m AS (SELECT a, y.* FROM p JOIN g_contexts y ON y.id = p.b)
  SELECT c.id, substr(trim(CASE WHEN m.a IS NOT NULL AND len(trim(m.summary)) > len(trim(c.summary)) THEN m.summary ELSE c.summary END), 1, 128) AS summary, CAST(c.support_count + CASE WHEN m.a IS NULL THEN 0 ELSE greatest(1, m.support_count) END AS BIGINT) AS support_count,
    round(CAST(CASE WHEN m.a IS NULL THEN c.confidence ELSE least(1.0, greatest(c.confidence, m.confidence) + 0.03) END AS DOUBLE), 6) AS confidence, CASE WHEN c.id IN (SELECT b FROM p) THEN 'merged' ELSE c.status END AS status, CASE WHEN m.a IS NULL THEN c.last_seen_at ELSE greatest(c.last_seen_at, m.last_seen_at, {NOW}) END AS last_seen_at FROM g_contexts c LEFT JOIN m ON m.a = c.id""")
def merged_contexts(spark, d) -> DataFrame:
    """Every third context takes up the next."""
    c = graph(spark, d)["contexts"].withColumn("facts", F.expr("cast(map() as map<string,string>)"))
    plan = c.filter("n % 3 = 0").select(F.col("id").alias("canonical_id"), F.concat(F.lit("c"), F.col("n") + 1).alias("merged_id")).join(c.select(F.col("id").alias("merged_id")), "merged_id", "left_semi")
    return contexts.apply_merges(c, plan, NOW).select("id", "summary", F.col("support_count").cast("long").alias("support_count"), F.round("confidence", 6).alias("confidence"), "status", F.col("last_seen_at").cast("long").alias("last_seen_at"))


@_query(f"""{ctes("events", "event_relation")} SELECT from_id, to_id, relation_type FROM g_event_relation WHERE from_id IN (SELECT id FROM g_events WHERE n % 40 = 0) OR to_id IN (SELECT id FROM g_events WHERE n % 40 = 0)""")
def touching_relations(spark, d) -> DataFrame:
    """Relations at either end of a table of events."""
    g = graph(spark, d)
    return joins.touching(g["event_relation"], g["events"].filter("n % 40 = 0"), "from_id", "to_id").select("from_id", "to_id", "relation_type")


@_query("""WITH r AS (SELECT source, count(*) AS n, sum(n_chars) AS total FROM documents WHERE n_chars IS NOT NULL GROUP BY source) SELECT source, n, round(total / n, 6) AS latency_avg, q.name, true AS within FROM r, (VALUES ('p50'), ('p95'), ('p99')) q(name)""")
def sketched_latencies(spark, d) -> DataFrame:
    """Quantiles from sketches of two runs, merged: whether each one's true rank is within 2 % of what it stands for."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source", F.col("n_chars").alias("latency_ms"))
    runs = reports.latency_sketches(docs.filter("doc_id % 2 = 0"), "a", ["source"]).unionByName(reports.latency_sketches(docs.filter("doc_id % 2 = 1"), "b", ["source"]))
    found = reports.sketched_latency(reports.merged_sketches(runs, ["source"]))
    each = found.select("source", "n", F.round("latency_avg", 6).alias("latency_avg"), F.explode(F.create_map(*[x for q in reports.QUANTILES for x in (F.lit(q), F.col(f"latency_{q}"))])).alias("name", "value"))
    below = docs.join(each, "source").groupBy("source", "name").agg((F.count_if(F.col("latency_ms") < F.col("value")) / F.first("n")).alias("low"), (F.count_if(F.col("latency_ms") <= F.col("value")) / F.first("n")).alias("high"))
    asked = F.when(F.col("name") == "p50", 0.5).when(F.col("name") == "p95", 0.95).otherwise(0.99)
    return each.join(below, ["source", "name"]).select("source", "n", "latency_avg", "name", ((F.col("low") - 0.02 <= asked) & (F.col("high") + 0.02 >= asked)).alias("within"))
