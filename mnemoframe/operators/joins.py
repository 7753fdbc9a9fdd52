"""Edge lookups and graph joins. OR-conditions are unions of equi joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import row_hash
from ..plans.model import relation_type
from .scans import with_statuses


def events_by_entities(events: DataFrame, involves: DataFrame, entity_ids: list[str]) -> DataFrame:
    hit = involves.filter(F.col("entity_id").isin(entity_ids)).select(F.col("event_id").alias("id"))
    return events.join(hit, "id", "left_semi")


def events_with_entities(events: DataFrame, involves: DataFrame) -> DataFrame:
    """Each event that has entities, with their sorted ids. Aggregated before the join."""
    held = involves.groupBy(F.col("event_id").alias("id")).agg(F.array_sort(F.collect_set("entity_id")).alias("entity_ids"))
    return events.join(held, "id")


def event_entities(involves: DataFrame, event_id: str) -> DataFrame:
    return involves.filter(F.col("event_id") == event_id).select("entity_id").distinct()


def event_contexts(in_rel: DataFrame, contexts: DataFrame, event_id: str) -> DataFrame:
    """Contexts of an event, heaviest edge first."""
    edges = in_rel.filter(F.col("event_id") == event_id).select(F.col("context_id").alias("id"), F.col("weight").alias("edge_weight"), F.col("confidence").alias("edge_confidence"))
    return contexts.join(edges, "id").orderBy(F.desc("edge_weight"), F.desc("edge_confidence"), "id")


def events_by_contexts(events: DataFrame, in_rel: DataFrame, context_ids: list[str], limit: int = 50) -> DataFrame:
    hit = in_rel.filter(F.col("context_id").isin(context_ids)).select(F.col("event_id").alias("id"))
    return events.join(hit, "id", "left_semi").orderBy(F.desc("last_active"), "id").limit(limit)


def _ends(edges: DataFrame, table: DataFrame, column: str, statuses: list[str] | None, prefix: str) -> DataFrame:
    end = with_statuses(table, statuses).select(F.col("id").alias(column), F.col("summary").alias(f"{prefix}_summary"), F.col("status").alias(f"{prefix}_status"))
    return edges.join(end, column)


def event_event_edges(edges: DataFrame, events: DataFrame, limit: int = 250, statuses: list[str] | None = None) -> DataFrame:
    """Relations whose both ends pass the status filter, newest first, types canonical."""
    out = _ends(_ends(edges, events, "from_id", statuses, "from"), events, "to_id", statuses, "to")
    return out.withColumn("relation_type", relation_type("relation_type")).orderBy(F.desc("updated_at"), "from_id", "to_id").limit(limit)


def event_context_edges(in_rel: DataFrame, events: DataFrame, contexts: DataFrame, limit: int = 250, event_statuses: list[str] | None = None, context_statuses: list[str] | None = None) -> DataFrame:
    out = _ends(_ends(in_rel, events, "event_id", event_statuses, "event"), contexts, "context_id", context_statuses, "context")
    return out.orderBy(F.desc("updated_at"), "event_id", "context_id").limit(limit)


def touching(edges: DataFrame, ids: DataFrame | list[str], source: str, target: str) -> DataFrame:
    """Edges with either end among the ids, each once."""
    if isinstance(ids, list):
        return edges.filter(F.col(source).isin(ids)).unionByName(edges.filter(F.col(target).isin(ids))).distinct()
    half = lambda c: edges.join(ids.select(F.col("id").alias(c)).distinct(), c, "left_semi").select(edges.columns)
    return half(source).unionByName(half(target)).distinct()


def relation_paths(edges: DataFrame, events: DataFrame, event_ids: list[str], relation_types: list[str] | None = None) -> DataFrame:
    """One-hop relations around the ids, both ends active, newest first; at most max(20, 8 for each id)."""
    ids = [i.strip() for i in event_ids if i.strip()]
    out = touching(edges, ids, "from_id", "to_id")
    out = out.filter(F.col("relation_type").isin(relation_types)) if relation_types else out
    out = _ends(_ends(out, events, "from_id", ["active"], "from"), events, "to_id", ["active"], "to")
    kept = F.when(relation_type("relation_type") != "", relation_type("relation_type")).otherwise(F.col("relation_type"))
    return out.withColumn("relation_type", kept).orderBy(F.desc("updated_at"), "from_id", "to_id").limit(max(20, 8 * len(ids)))


def merge_traces(traces: DataFrame, event_id: str) -> DataFrame:
    return touching(traces, [event_id], "source_id", "target_id")


def context_shared(in_rel: DataFrame, pairs: DataFrame, a: str = "event_id", b: str = "cand_id") -> DataFrame:
    """Pairs of events that have a context in common."""
    left = in_rel.select(F.col("event_id").alias(a), "context_id")
    right = in_rel.select(F.col("event_id").alias(b), "context_id")
    return pairs.join(left, a).join(right, [b, "context_id"]).select(a, b).distinct()


def graph_delta(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """What changed between two snapshots: keys, change in created, updated, merged, archived, removed.

    Rows are compared by a hash of all their columns; unchanged ones are left out.
    """

    def hashed(df: DataFrame, name: str) -> DataFrame:
        status = F.col("status") if "status" in df.columns else F.lit(None).cast("string")
        rest = sorted(c for c in df.columns if c not in keys)
        return df.select(*keys, row_hash(df, rest).alias(f"{name}_hash"), status.alias(f"{name}_status"), F.lit(True).alias(name))

    both = hashed(before, "before").join(hashed(after, "after"), keys, "full_outer")
    became = lambda *names: F.col("after_status").isin(*names) & ~F.col("before_status").eqNullSafe(F.col("after_status"))
    change = F.when(F.col("before").isNull(), "created").when(F.col("after").isNull(), "removed").when(became("merged"), "merged").when(became("archived", "deprecated"), "archived").when(F.col("before_hash") != F.col("after_hash"), "updated")
    return both.select(*keys, change.alias("change")).filter("change is not null")


def snapshot_nodes(events: DataFrame, entities: DataFrame, contexts: DataFrame, involves: DataFrame, in_rel: DataFrame, limit: int = 200) -> dict[str, DataFrame]:
    """Capped node lists and the edges whose both ends survived the cap."""
    short = lambda c: F.when(F.length(c) > 40, F.concat(F.substring(c, 1, 40), F.lit("..."))).otherwise(F.col(c))
    ev = events.orderBy(F.desc("support_count"), "id").limit(limit).select("id", short("summary").alias("label"), "status")
    en = entities.orderBy("id").limit(limit).select("id", F.col("id").alias("label"))
    co = contexts.orderBy("id").limit(limit).select("id", short("summary").alias("label"), "status")
    keep = lambda edges, a, nodes_a, b, nodes_b: edges.join(nodes_a.select(F.col("id").alias(a)), a, "left_semi").join(nodes_b.select(F.col("id").alias(b)), b, "left_semi")
    return {"events": ev, "entities": en, "contexts": co, "involves": keep(involves, "event_id", ev, "entity_id", en), "in_rel": keep(in_rel, "event_id", ev, "context_id", co)}


def serialized_events(events: DataFrame, involves: DataFrame, in_rel: DataFrame, traces: DataFrame | None = None) -> DataFrame:
    """Events with their entity ids, context ids and merge sources, by grouped joins."""
    held = lambda edges, key, value, name: edges.groupBy(F.col(key).alias("id")).agg(F.array_sort(F.collect_set(value)).alias(name))
    out = events.join(held(involves, "event_id", "entity_id", "entity_ids"), "id", "left").join(held(in_rel, "event_id", "context_id", "context_ids"), "id", "left")
    names = ["entity_ids", "context_ids"]
    if traces is not None:
        out = out.join(held(traces, "target_id", "source_id", "merged_ids"), "id", "left")
        names.append("merged_ids")
    return out.withColumns({n: F.coalesce(n, F.expr("cast(array() as array<string>)")) for n in names})
