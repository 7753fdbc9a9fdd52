"""A memory over a namespace: writes, queries and jobs in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import event_text
from .operators import consolidation, contexts, entities, joins, mutations, patterns, recall, relations, reports, resolution, scans, search, task_recall
from .plans.model import SCHEMAS, conform, with_event_defaults
from .sources.shared import written
from .sources.tables import Audit, Namespace
from .streaming.ingest import events_from

_KINDS = {"event": "events", "context": "contexts"}
_KEYS = {"involves": ["event_id", "entity_id"], "extracted_from": ["event_id", "episode_id"], "in_rel": ["event_id", "context_id"], "event_relation": ["from_id", "to_id", "relation_type"]}
_EDGES = {"event": {"involves": ["event_id"], "extracted_from": ["event_id"], "in_rel": ["event_id"], "event_relation": ["from_id", "to_id"]}, "context": {"in_rel": ["context_id"]}}


def infer_kind(columns: list[str], kind: str = "") -> str:
    """Told, or by columns that only one kind has."""
    if kind:
        return kind
    return "context" if {"subtype", "condition", "applies_when", "facts"} & set(columns) else "event"


class Memory:
    """Each write is one new version of the tables it touches; reads are lazy DataFrames of the current versions."""

    def __init__(self, spark: SparkSession, root: str, name: str = "default", audit: str | None = None):
        self.spark, self.space = spark, Namespace(spark, root, name)
        self.audit = Audit(spark, audit, name) if audit else None

    def table(self, name: str) -> DataFrame:
        return self.space.read(name)

    def _save(self, name: str, rows: DataFrame) -> None:
        before = self.table(name)
        self.space.write(name, rows)
        if self.audit is not None and "id" in before.columns:
            self.audit.deltas(name, joins.graph_delta(before, self.table(name), ["id"]), name)

    def _change(self, name: str, rows: DataFrame, keys: tuple[str, ...] = ("id",), keep: tuple[str, ...] = ()) -> None:
        """Writes changed and new rows only; ``keep`` columns stay as they were."""
        rows = conform(rows, name)
        old = self.table(name).join(rows.select(*keys).distinct(), list(keys), "left_semi")
        if keep:
            was = old.select(*keys, *[F.col(c).alias(f"_{c}") for c in keep])
            rows = rows.join(was, list(keys), "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in keep else F.col(c) for c in rows.columns])
        rows = written(rows, "changed-rows")
        self.space.upsert(name, rows, list(keys))
        if self.audit is not None and keys == ("id",):
            self.audit.deltas(name, joins.graph_delta(old, rows.dropDuplicates(["id"]), ["id"]), name)

    # --- writes

    def ingest(self, episodes: DataFrame, extract=None, now: int = 0) -> DataFrame:
        """Episodes (id, content, timestamp), the events in them, and the contexts that the events' payloads name;
        known events change nothing. Returns the new events."""
        found = events_from(episodes, extract)
        new = found.join(self.table("events").select("id"), "id", "left_anti").dropDuplicates(["id"])
        edges = found.select(F.col("id").alias("event_id"), "episode_id").distinct()
        self.space.append("episodes", episodes.dropDuplicates(["id"]).join(self.table("episodes").select("id"), "id", "left_anti"))
        self.space.append("extracted_from", edges.join(self.table("extracted_from"), ["event_id", "episode_id"], "left_anti"))
        old = self.table("events").select("id")  # bound to the version before
        self._change("events", new)
        new = self.table("events").join(old, "id", "left_anti")
        self.attach_contexts(resolution.drafts_of(new), now)
        return new

    def attach_contexts(self, drafts: DataFrame, now: int, scope: tuple[str, ...] = ("subtype",)) -> DataFrame:
        """Resolves drafts (see ``resolution.resolve``) into contexts and edges; returns the matches."""
        changed, matches = resolution.resolve(drafts, self.table("contexts"), now, scope, changed_only=True)
        if not matches.isEmpty():
            self._change("contexts", changed)
            self._change("in_rel", resolution.edges_of(matches, self.table("contexts")), ("event_id", "context_id"), keep=("created_at",))
        return matches

    def consolidate_contexts(self, now: int, pool: int = consolidation.POOL, max_pairs: int | None = None) -> DataFrame:
        """Merges the contexts of the newest ``pool`` active ones that say the same; returns the plan."""
        recent = self.table("contexts").filter("status = 'active'").orderBy(F.col("last_seen_at").desc_nulls_last(), "id").limit(pool)
        plan = contexts.disjoint_plan(contexts.merge_candidates(recent), max_pairs)
        if not plan.isEmpty():
            self.merge_contexts(plan, now)
        return plan

    def write(self, rows: DataFrame, kind: str = "", links: DataFrame | None = None, now: int = 0) -> str:
        """Creates or replaces events or contexts by id; links (event_id, entity_id) count up their edges."""
        kind = infer_kind(rows.columns, kind)
        table = _KINDS[kind]
        new = conform(rows, table)
        new = with_event_defaults(new) if kind == "event" else new
        self._change(table, new, keep=("created_at",))
        if links is not None:
            named = links.select(F.col("entity_id").alias("id")).distinct()
            self._save("entities", mutations.insert_missing(self.table("entities"), conform(named.withColumns({"status": F.lit("active"), "registered": F.lit(False), "type": F.lit("UNKNOWN")}), "entities"), ["id"]))
            self.space.write("involves", mutations.count_links(self.table("involves"), links, now))
        return kind

    def remove(self, ids: list[str], kind: str = "event", hard: bool = False, now: int = 0) -> None:
        """Archives events, deprecates contexts; ``hard`` deletes them with their edges."""
        table = _KINDS[kind]
        if not hard:
            self._change(table, mutations.marked(self.table(table).filter(F.col("id").isin(ids)), ids, "archived" if kind == "event" else "deprecated", now))
            return
        for name, ends in _EDGES[kind].items():
            touched = [F.col(end).isin(ids) for end in ends]
            gone = self.table(name).filter(touched[0] if len(touched) == 1 else touched[0] | touched[1])
            if not gone.isEmpty():
                self.space.delete(name, gone, _KEYS[name])
        held = self.table(table).filter(F.col("id").isin(ids))
        self.space.delete(table, held, ["id"])
        if self.audit is not None:
            self.audit.deltas(table, joins.graph_delta(held, held.limit(0), ["id"]), table)

    def register_entities(self, rows: DataFrame, now: int) -> DataFrame:
        """Registers rows; unregistered entities that carry a new alias as their name are merged. Returns outcomes."""
        table = mutations.register_entities(self.table("entities"), rows, now)
        self._save("entities", table.drop("outcome"))
        known = self.table("entities")
        names = entities.alias_index(known).join(rows.select("id"), "id", "left_semi")
        twins = known.filter("not registered and coalesce(status, 'active') = 'active'").select(F.col("id").alias("merged_id"), F.lower("id").alias("name")).join(names.withColumnRenamed("id", "canonical_id"), "name").filter("merged_id <> canonical_id")
        twins = twins.select("merged_id", "canonical_id", F.lit("alias_match").alias("reason"), F.lit(1.0).alias("score")).dropDuplicates(["merged_id"])
        if not twins.isEmpty():
            self.merge_entities(twins, now)
        return self.table("entities").join(rows.select("id"), "id", "left_semi")

    def merge_entities(self, pairs: DataFrame, now: int) -> None:
        table, edges, traces = mutations.merge_entities(self.table("entities"), self.table("involves"), pairs, now)
        self.space.append("entity_merge_trace", traces)
        self.space.write("involves", edges)
        self._save("entities", table)

    def merge_events(self, plan: DataFrame, now: int) -> None:
        """Applies a plan (canonical_id, merged_id, score, reason): rows, lineage and edges."""
        mapping = plan.select(F.col("merged_id").alias("id"), F.col("canonical_id").alias("canonical"))
        self.space.append("event_merge_trace", consolidation.traces_of(plan, now))
        for name, ends, keys, at in (("event_relation", ["from_id", "to_id"], ["from_id", "to_id", "relation_type"], "updated_at"), ("in_rel", ["event_id"], ["event_id", "context_id"], "updated_at"), ("involves", ["event_id"], ["event_id", "entity_id"], "t_valid"), ("extracted_from", ["event_id"], ["event_id", "episode_id"], "event_id")):
            self.space.write(name, mutations.relink(self.table(name), mapping, ends, keys, at))
        self._save("events", consolidation.apply_merges(self.table("events"), plan, now))

    def merge_contexts(self, plan: DataFrame, now: int) -> None:
        mapping = plan.select(F.col("merged_id").alias("id"), F.col("canonical_id").alias("canonical"))
        self.space.write("in_rel", mutations.relink(self.table("in_rel"), mapping, ["context_id"], ["event_id", "context_id"]))
        self._save("contexts", contexts.apply_merges(self.table("contexts"), plan, now))

    def relate(self, queries: DataFrame, states: DataFrame, now: int, judge=None) -> DataFrame:
        """Recalls, judges and links the given events; returns the executed decisions."""
        events = self.table("events")
        for c in ("parent_event_id", "thread_id", "session_id", "episode_id"):
            events, queries = (df if c in df.columns else df.withColumn(c, F.get_json_object("payload", f"$.{c}")) for df in (events, queries))
        found = recall.recall(queries, events, self.table("involves"), states)
        done = written(relations.process(found, events, states, self.table("in_rel"), judge), "decisions")
        edges = relations.edges_of(done, events, now).withColumn("created_at", F.col("updated_at"))
        self.space.write("event_relation", mutations.upsert_relations(self.table("event_relation"), conform(edges, "event_relation")))
        return done

    def consolidate(self, now: int, block=None, dry_run: bool = False, focus: list[str] | None = None, max_pairs: int | None = None) -> DataFrame:
        """Merges events and contexts of the recent pools (events also within blocks), ages contexts, archives; returns the counts."""
        events = self.table("events").withColumns({c: F.get_json_object("payload", f"$.{c}") for c in ("session_id", "episode_id")})
        out = consolidation.consolidate(events, self.table("contexts"), now, block, dry_run, focus, max_pairs)
        counts = out["report"].collect()[0]
        if not dry_run:
            if counts["merged"]:
                self.merge_events(out["plan"], now)
            self.consolidate_contexts(now, max_pairs=max_pairs)
            self._save("contexts", contexts.decayed(self.table("contexts"), now).drop("changed"))
            self._save("events", consolidation.archived(self.table("events"), now).drop("changed"))
        return self.spark.createDataFrame([counts], out["report"].schema)

    def cleanup(self, now: int, ttl: int = 3600) -> None:
        self.space.write("episodes", consolidation.unexpired(self.table("episodes"), now, ttl))

    def put_patterns(self, rows: DataFrame, now: int) -> None:
        """Documents of registered entities; others are refused."""
        known = scans.registered(self.table("entities")).select(F.col("id").alias("entity_id"))
        if not rows.join(known, "entity_id", "left_anti").isEmpty():
            raise LookupError("only registered entities have documents")
        self._save("patterns", mutations.put_patterns(self.table("patterns"), rows, now))

    def delete_patterns(self, entity_ids: list[str] | None = None) -> None:
        self._save("patterns", mutations.delete_patterns(self.table("patterns"), entity_ids))

    # --- queries

    def search(self, query: str, top_k: int = 5) -> DataFrame:
        """BM25 over active events."""
        active = self.table("events").filter("status = 'active'")
        hits = search.bm25(active, query, top_k, "id", event_text(), "last_active")
        return active.join(F.broadcast(hits), "id").select("id", "summary", "action", "causality", "timestamp", "score").orderBy(F.desc("score"), "id")

    def recall_for_task(self, task: str, limit: int = 5) -> dict:
        t = self.table
        return task_recall.recall_for_task(task_recall.Graph(t("events"), t("contexts"), t("entities"), t("patterns"), t("involves"), t("in_rel"), t("event_relation")), task, limit)

    def recall_pattern(self, entity_id: str, query: str = "", mode: str = "auto", top_k: int = 3) -> DataFrame:
        return patterns.recall_patterns(scans.entity_pattern(self.table("patterns"), entity_id), query, mode, top_k)

    def query(self, text: str = "", limit: int = 50, include_inactive: bool = False, graph: bool = False) -> dict[str, DataFrame]:
        """Listed events and contexts, statistics, and the edges between (five times as many)."""
        statuses = None if include_inactive else ["active"]
        t = self.table
        out = {"events": scans.list_events(t("events"), limit, text, statuses), "contexts": scans.list_contexts(t("contexts"), limit, text, statuses), "stats": self.stats()}
        if graph:
            out |= {"event_event": joins.event_event_edges(t("event_relation"), t("events"), 5 * limit, statuses), "event_context": joins.event_context_edges(t("in_rel"), t("events"), t("contexts"), 5 * limit, statuses, statuses)}
        return out

    def detail(self, kind: str, key: str) -> DataFrame:
        """A node with its neighbours' ids."""
        row = scans.by_id(self.table(_KINDS[kind]), key)
        return joins.serialized_events(row, self.table("involves"), self.table("in_rel"), self.table("event_merge_trace")) if kind == "event" else row.drop("embedding")

    def stats(self) -> DataFrame:
        return reports.graph_stats({n: self.table(n) for n in SCHEMAS})
