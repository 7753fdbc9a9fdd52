"""Writes as new versions of tables: upserts, relinking, deletion, the entity registry.

Parquet has no updates in place, so each function returns the table's next
version; callers write it (see ``sources.tables``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import row_hash
from ..functions.text import text
from .scans import canonical_ids


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """``table`` with ``rows`` in place of those of the same keys (of equal ones the last by updated_at); ``keep`` columns stay the old ones'."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("updated_at") if "updated_at" in rows.columns else F.lit(0), row_hash(rows, rows.columns)))
    new = rows.select(*table.columns).withColumn("_r", rank).filter("_r = 1").drop("_r")
    if keep:
        old = table.select(*keys, *[F.col(c).alias(f"_{c}") for c in keep])
        new = new.join(old, keys, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in keep else F.col(c) for c in table.columns])
    return table.join(new.select(*keys), keys, "left_anti").select(*table.columns).unionByName(new)


def insert_missing(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds rows whose keys are new, each once; what is there, merged ones too, stays as it is."""
    new = rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti")
    return table.unionByName(new, allowMissingColumns=True)


def append(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows, allowMissingColumns=True)


def marked(table: DataFrame, ids: list[str], status: str, now: int) -> DataFrame:
    """Rows of the ids get a status and, unless they have one, an end of validity (archived events, deprecated contexts)."""
    hit = F.col("id").isin(ids)
    return table.withColumns({"status": F.when(hit, status).otherwise(F.col("status")), "valid_to": F.when(hit & F.col("valid_to").isNull(), F.lit(now)).otherwise(F.col("valid_to"))})


def detach_delete(nodes: DataFrame, ids: DataFrame, edges: dict[str, tuple[DataFrame, list[str]]]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Nodes without the ids, and each edge table without edges at them. ``edges``: name -> (table, end columns)."""
    gone = ids.select("id").distinct()
    out = {}
    for name, (table, ends) in edges.items():
        columns = table.columns
        for end in ends:
            table = table.join(gone.select(F.col("id").alias(end)), end, "left_anti")
        out[name] = table.select(*columns)
    return nodes.join(gone, "id", "left_anti").select(*nodes.columns), out


def linked_existing(edges: DataFrame, left: DataFrame, left_col: str, right: DataFrame, right_col: str) -> DataFrame:
    """Edges both of whose ends exist."""
    end = lambda t, c: t.select(F.col("id").alias(c))
    return edges.join(end(left, left_col), left_col, "left_semi").join(end(right, right_col), right_col, "left_semi")


def relink_entities(involves: DataFrame, mapping: DataFrame, now: int) -> DataFrame:
    """INVOLVES with entities replaced by ``mapping`` (id, canonical); edges that fall together keep the earliest
    creation, the latest validity and the larger count."""
    to = mapping.select(F.col("id").alias("entity_id"), "canonical").filter("entity_id <> canonical")
    moved = involves.join(to, "entity_id", "left").withColumn("_moved", F.col("canonical").isNotNull()).withColumn("entity_id", F.coalesce("canonical", "entity_id")).drop("canonical")
    aggs = {"t_created": F.min("t_created"), "t_valid": F.greatest(F.max("t_valid"), F.max(F.when(F.col("_moved"), F.lit(now)))), "c_valid": F.max("c_valid")}
    rest = [c for c in involves.columns if c not in ("event_id", "entity_id", *aggs)]
    return moved.groupBy("event_id", "entity_id").agg(*[a.alias(c) for c, a in aggs.items() if c in involves.columns], *[F.max(c).alias(c) for c in rest]).select(*involves.columns)


def relink(edges: DataFrame, mapping: DataFrame, ends: list[str], keys: list[str], recency: str = "updated_at") -> DataFrame:
    """Any edge table with its ends mapped (id -> canonical): loops go, of clashing edges the latest stays."""
    out = edges
    for end in ends:
        to = mapping.filter("id <> canonical").select(F.col("id").alias(end), F.col("canonical").alias("_to"))
        out = out.join(to, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    if len(ends) == 2:
        out = out.filter(F.col(ends[0]) != F.col(ends[1]))
    latest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(recency), row_hash(edges, edges.columns)))
    return out.withColumn("_r", latest).filter("_r = 1").select(*edges.columns)


def upsert_relations(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """EVENT_RELATION upsert by (from, to, type); loops and blank ends or types are rejected; creation times stay."""
    good = rows.filter((F.trim(text("from_id")) != "") & (F.trim(text("to_id")) != "") & (F.trim(text("relation_type")) != "") & (F.col("from_id") != F.col("to_id")))
    return upsert(edges, good, ["from_id", "to_id", "relation_type"], keep=("created_at",))


def count_links(involves: DataFrame, links: DataFrame, now: int) -> DataFrame:
    """INVOLVES after linking (event_id, entity_id): a known edge counts one more and is valid now, a new one starts at 1."""
    fresh = links.select("event_id", "entity_id").distinct().withColumn("_new", F.lit(True))
    both = involves.join(fresh, ["event_id", "entity_id"], "full_outer")
    hit = F.col("_new").isNotNull()
    known = F.col("c_valid").isNotNull()
    changes = {"c_valid": F.when(hit & known, F.col("c_valid") + 1).when(hit, F.lit(1)).otherwise(F.col("c_valid")), "t_valid": F.when(hit, F.lit(now)).otherwise(F.col("t_valid")), "t_created": F.when(hit & ~known, F.lit(now)).otherwise(F.col("t_created"))}
    return both.select(*[changes[c].alias(c) if c in changes else F.col(c) for c in involves.columns])


def register_entities(entities: DataFrame, rows: DataFrame, now: int) -> DataFrame:
    """Registers rows (id, type, description, aliases): new ones are created, known ones promoted or updated; aliases unite sorted.

    ``outcome`` tells created, promoted, updated, or null for untouched rows.
    """
    new = rows.select("id", F.struct(*[F.col(c) for c in rows.columns if c != "id"]).alias("n"))
    both = entities.join(new, "id", "full_outer")
    hit, known = F.col("n").isNotNull(), F.col("status").isNotNull() | F.col("registered").isNotNull()
    none = F.expr("cast(array() as array<string>)")
    outcome = F.when(hit & ~known, "created").when(hit & ~F.coalesce("registered", F.lit(False)), "promoted").when(hit, "updated")
    fill = lambda c: F.when(hit & (text(f"n.{c}") != ""), F.col(f"n.{c}")).otherwise(F.col(c))
    changes = {"registered": hit | F.coalesce("registered", F.lit(False)), "type": fill("type"), "description": fill("description"), "aliases": F.when(hit, F.array_sort(F.array_union(F.coalesce("aliases", none), F.coalesce("n.aliases", none)))).otherwise(F.col("aliases")), "status": F.coalesce("status", F.lit("active")), "created_at": F.coalesce("created_at", F.lit(now)), "updated_at": F.when(hit, F.lit(now)).otherwise(F.col("updated_at"))}
    return both.select(*[changes[c].alias(c) if c in changes else F.col(c) for c in entities.columns], outcome.alias("outcome"))


def update_aliases(entities: DataFrame, entity_id: str, add: list[str] = (), remove: list[str] = ()) -> DataFrame:
    """Aliases of a registered entity with some added and removed."""
    lit = lambda xs: F.array(*[F.lit(x) for x in xs]) if xs else F.expr("cast(array() as array<string>)")
    aliases = F.array_except(F.array_union(F.coalesce("aliases", lit([])), lit(add)), lit(remove))
    return entities.withColumn("aliases", F.when((F.col("id") == entity_id) & F.col("registered"), aliases).otherwise(F.col("aliases")))


def unregistered(entities: DataFrame, ids: list[str]) -> DataFrame:
    return entities.filter(~(F.col("id").isin(ids) & F.col("registered")))


def merge_entities(entities: DataFrame, involves: DataFrame, pairs: DataFrame, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, involves, traces) after merging pairs (merged_id, canonical_id, reason, score).

    The merged entity is marked and points to the canonical one, which takes
    its id and aliases; edges move.
    """
    point = pairs.select(F.col("merged_id").alias("id"), F.col("canonical_id").alias("_to"))
    none = F.expr("cast(array() as array<string>)")
    aliases = F.coalesce("aliases", none) if "aliases" in entities.columns else none
    given = entities.join(point, "id").select(F.col("_to").alias("id"), F.array_union(F.array("id"), aliases).alias("_names"), F.col("id").alias("_from"))
    taken = given.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_names")))).alias("_names"), F.array_sort(F.collect_set("_from")).alias("_merged"))
    out = entities.join(point, "id", "left").join(taken, "id", "left")
    changes = {"status": F.when(F.col("_to").isNotNull(), "merged").otherwise(F.col("status")), "canonical_id": F.coalesce("_to", "canonical_id"), "updated_at": F.when(F.col("_to").isNotNull() | F.col("_merged").isNotNull(), F.lit(now)).otherwise(F.col("updated_at") if "updated_at" in entities.columns else F.lit(now))}
    if "aliases" in entities.columns:
        changes["aliases"] = F.when(F.col("_names").isNotNull(), F.array_sort(F.array_union(aliases, F.col("_names")))).otherwise(F.col("aliases"))
    if "merged_from" in entities.columns:
        changes["merged_from"] = F.when(F.col("_merged").isNotNull(), F.array_union(F.coalesce("merged_from", none), F.col("_merged"))).otherwise(F.col("merged_from"))
    new = out.select(*[changes[c].alias(c) if c in changes else F.col(c) for c in entities.columns])
    mapping = canonical_ids(new.select("id", "status", "canonical_id"), transitive=True)
    traces = pairs.select(F.col("merged_id").alias("source_id"), F.col("canonical_id").alias("target_id"), F.col("reason").alias("merge_reason"), F.col("score").alias("similarity_score"), F.lit(now).alias("merged_at"), F.lit("v1").alias("strategy_version"))
    return new, relink_entities(involves, mapping, now), traces


def put_patterns(patterns: DataFrame, rows: DataFrame, now: int) -> DataFrame:
    """One document for each entity: a known one's id and creation time stay, the content is replaced."""
    new = rows.select("entity_id", "content").dropDuplicates(["entity_id"]).withColumns({"id": F.concat(F.lit("pattern_"), F.substring(F.sha2("entity_id", 256), 1, 16)), "created_at": F.lit(now), "updated_at": F.lit(now)})
    return upsert(patterns, new, ["entity_id"], keep=("id", "created_at"))


def delete_patterns(patterns: DataFrame, entity_ids: list[str] | None = None) -> DataFrame:
    """Without those of the entities, or of all."""
    return patterns.filter(F.lit(False)) if entity_ids is None else patterns.filter(~F.col("entity_id").isin(entity_ids))


def promote_traits(users: DataFrame, traits: DataFrame, rows: DataFrame, events: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(users, traits) after marking events as a user's permanent traits (user_id, event_id): users are created if
    new, traits of unknown events are left out, known ones keep their creation time."""
    people = insert_missing(users, rows.select(F.col("user_id").alias("id")), ["id"])
    known = rows.select("user_id", "event_id").join(events.select(F.col("id").alias("event_id")), "event_id", "left_semi")
    return people, insert_missing(traits, known.withColumn("t_created", F.lit(now).cast("long")), ["user_id", "event_id"])
