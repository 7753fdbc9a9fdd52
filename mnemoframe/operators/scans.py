"""Lookups, listings and point queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import event_text, lexical_score, text
from ..sources.shared import written


def by_id(table: DataFrame, key: str, column: str = "id") -> DataFrame:
    """Rows of one key: episodes, events, contexts, entities alike."""
    return table.filter(F.col(column) == key)


def by_ids(table: DataFrame, keys: list[str], statuses: list[str] | None = None) -> DataFrame:
    """Rows of the keys in the order given (``pos``), optionally of some statuses."""
    wanted = table.sparkSession.createDataFrame([(k, i) for i, k in enumerate(dict.fromkeys(keys))], "id string, pos int")
    return with_statuses(table, statuses).join(F.broadcast(wanted), "id").orderBy("pos")


def with_statuses(table: DataFrame, statuses: list[str] | None) -> DataFrame:
    return table.filter(F.col("status").isin(list(statuses))) if statuses else table


def registered(entities: DataFrame, vectors: bool = True) -> DataFrame:
    """Registered entities whose status is null or active."""
    out = entities.filter(F.col("registered") & F.coalesce(F.col("status") == "active", F.lit(True)))
    return out if vectors else out.drop("description_embedding", "name_embedding")


def registered_entity(entities: DataFrame, key: str) -> DataFrame:
    return by_id(entities, key).filter("registered")


def entity_vectors(entities: DataFrame, keys: list[str], column: str = "name_embedding") -> DataFrame:
    """(id, vector) of the keys that have one."""
    return entities.filter(F.col("id").isin(keys) & F.col(column).isNotNull()).select("id", column)


def recent_events(events: DataFrame, now: int, window: int, limit: int = 100) -> DataFrame:
    """Newest first, of any status, from ``now - window`` on (later ones too)."""
    return events.filter(F.col("last_active") >= now - window).orderBy(F.desc("last_active"), "id").limit(limit)


def active_with_vectors(events: DataFrame, limit: int = 200) -> DataFrame:
    """The newest ``limit`` active events, then only those with a vector: in this order."""
    newest = events.filter("status = 'active'").orderBy(F.desc("last_active"), "id").limit(max(limit, 1))
    return newest.filter(F.size("embedding") > 0)


def events_mentioning(events: DataFrame, *needles: str, limit: int = 20) -> DataFrame:
    """Active events whose payload text holds all needles (state keys, threads); none if one is blank."""
    found = events.filter("status = 'active'") if all(n.strip() for n in needles) else events.filter(F.lit(False))
    for n in needles:
        found = found.filter(F.contains(text("payload"), F.lit(n.strip())))
    return found.orderBy(F.desc("last_active"), "id").limit(max(limit, 1))


def context_candidates(contexts: DataFrame, context_type: str = "context", subtype: str = "", limit: int = 24, only_active: bool = True) -> DataFrame:
    out = contexts.filter(F.col("context_type") == context_type)
    out = out.filter(F.col("subtype") == subtype) if subtype else out
    out = out.filter("status = 'active'") if only_active else out
    return out.orderBy(F.desc("last_seen_at"), "id").limit(limit)


def summary_index(contexts: DataFrame, context_type: str = "context", only_active: bool = True) -> DataFrame:
    out = contexts.filter(F.col("context_type") == context_type)
    return (out.filter("status = 'active'") if only_active else out).select("id", "summary")


def all_contexts(contexts: DataFrame, only_active: bool = True) -> DataFrame:
    out = contexts.filter("status = 'active'") if only_active else contexts
    return out.drop("source_refs", "merged_from")


def _listed(table: DataFrame, haystack: Column, query: str, statuses: list[str] | None, recency: str, limit: int) -> DataFrame:
    limit = max(limit, 1)
    pool = with_statuses(table, statuses).orderBy(F.desc(recency), "id").limit(limit * (6 if query else 1))
    score = lexical_score(haystack, F.lit(query)) if query else F.lit(1.0)
    return pool.withColumn("score", score).filter("score > 0").orderBy(F.desc("score"), F.desc(recency), "id").limit(limit)


def list_events(events: DataFrame, limit: int = 50, query: str = "", statuses: list[str] | None = None) -> DataFrame:
    """Newest events; with a query, of the newest six times as many those that share grams, best first."""
    return _listed(events, event_text(payload="payload"), query, statuses, "last_active", limit)


def list_contexts(contexts: DataFrame, limit: int = 50, query: str = "", statuses: list[str] | None = None) -> DataFrame:
    return _listed(contexts, F.concat_ws(" ", text("summary"), text("description")), query, statuses, "last_seen_at", limit)


def list_episodes(episodes: DataFrame, stored: DataFrame, search: str = "", bucket: str = "", pending_only: bool = False, written_only: bool = False, limit: int = 100) -> DataFrame:
    """Episodes with ``written`` (whether ``stored`` has their id); a substring filter over content and metadata, one bucket, or one of both states."""
    done = stored.select(F.col("episode_id").alias("id")).distinct().withColumn("written", F.lit(True))
    out = episodes.join(done, "id", "left").withColumn("written", F.coalesce("written", F.lit(False)))
    if search.strip():
        needle = F.lit(search.strip().lower())
        out = out.filter(F.contains(F.lower(F.concat_ws(" ", text("content"), F.to_json("metadata"))), needle))
    if bucket:
        out = out.filter(F.col("metadata")["bucket_name"] == bucket)
    out = out.filter(~F.col("written")) if pending_only else out
    out = out.filter("written") if written_only else out
    return out.orderBy("timestamp", "id").limit(limit)


def canonical_ids(entities: DataFrame, transitive: bool = False, rounds: int = 64) -> DataFrame:
    """(id, canonical): where a merged entity points, one hop or to the end of the chain.

    Each round doubles the hops, until nothing moves; what still moves after
    ``rounds`` (ids that point to one another in a circle always do) is an error."""
    point = F.when((F.col("status") == "merged") & (text("canonical_id") != ""), F.col("canonical_id"))
    out = entities.select("id", F.coalesce(point, F.col("id")).alias("canonical"))
    for done in range(rounds + 1 if transitive else 0):
        out = written(out, "canonical-ids")
        hop = out.select(F.col("id").alias("canonical"), F.col("canonical").alias("next"))
        moved = out.join(hop.filter("canonical <> next"), "canonical")
        if moved.isEmpty():
            break
        if done == rounds:
            raise ValueError("canonical ids did not settle")
        out = out.join(hop, "canonical", "left").select("id", F.coalesce("next", "canonical").alias("canonical"))
    return out


def entity_pattern(patterns: DataFrame, entity_id: str) -> DataFrame:
    return by_id(patterns, entity_id, "entity_id")


def task_anchor_pools(entities: DataFrame, contexts: DataFrame, events: DataFrame, limit: int = 240) -> dict[str, DataFrame]:
    """What a task is matched against: registered entities, newest active contexts and events."""
    return {"entities": registered(entities), "contexts": list_contexts(contexts, limit, statuses=["active"]), "events": list_events(events, limit, statuses=["active"])}
