"""Memory for a task: project it onto anchors, walk the graph, fold, select, compile.

Pools are the newest few hundred rows, so every step after them is a bounded
join; paths of all kinds are rows of one DataFrame.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import context_card, context_text, entity_text, event_card, event_text, informative_tokens, join_clause, literal_anchors, literal_hits, matched_terms, normalize_key, plain_markdown, text, trim_line
from ..plans.model import MEANING_UPDATE, RELATION_ALIASES, RELATION_TYPES, SAME_TOPIC, relation_type
from .joins import events_by_contexts, relation_paths
from .patterns import recall_patterns
from .scans import by_ids, canonical_ids, list_contexts, list_events, registered

POOL, PER_ANCHOR, LEXICAL, LIMIT = 240, 20, 12, 5


def _array(values: list[str]):
    return F.array(*[F.lit(v) for v in values]) if values else F.expr("cast(array() as array<string>)")


def _ids(spark, values: list[str], column: str = "id") -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{column} string")


class Graph:
    """The tables a task walks. Missing columns of the text fields count as blank."""

    def __init__(self, events: DataFrame, contexts: DataFrame, entities: DataFrame, patterns: DataFrame, involves: DataFrame, in_rel: DataFrame, relations: DataFrame):
        fill = lambda df, cols, kind: df.withColumns({c: F.lit(None).cast(kind) for c in cols if c not in df.columns})
        self.spark = events.sparkSession
        self.events = fill(events, ["action", "causality", "payload"], "string")
        self.contexts = fill(fill(contexts, ["subject", "condition", "applies_when", "description"], "string"), ["facts"], "map<string,string>")
        self.entities = fill(fill(entities, ["type", "description", "canonical_id"], "string"), ["aliases"], "array<string>")
        self.patterns, self.involves, self.in_rel, self.relations = patterns, involves, in_rel, relations


def lexical_anchors(spark, task: str, documents: DataFrame, most: int = LEXICAL) -> list[str]:
    """The rarest of the task's tokens among the documents (column text); ties to longer, then later ones."""
    asked = sorted(set(spark.range(1).select(informative_tokens(F.lit(task)).alias("t")).first()["t"]))
    if not asked:
        return []
    kept = documents.filter(F.trim(text("text")) != "").select(informative_tokens("text").alias("t"))
    stats = kept.agg(F.count("*").alias("n"), *[F.count_if(F.array_contains("t", w)).alias(f"d{i}") for i, w in enumerate(asked)]).first()
    n = stats["n"]
    rarity = {w: math.log(1.0 + (n + 1) / (stats[f"d{i}"] + 1)) if stats[f"d{i}"] else math.log(1.0 + n + 1) for i, w in enumerate(asked)}
    return sorted(asked, key=lambda w: (rarity[w], len(w), w), reverse=True)[:most]


def project(graph: Graph, task: str, pool: int = POOL) -> dict:
    """literal and lexical anchors, and the (id, terms) of entities, contexts and events that match them."""
    spark = graph.spark
    literals = list(spark.range(1).select(literal_anchors(F.lit(task)).alias("a")).first()["a"])
    events, contexts, entities = list_events(graph.events, pool, statuses=["active"]), list_contexts(graph.contexts, pool, statuses=["active"]), registered(graph.entities)
    documents = events.select(event_text(payload="payload").alias("text")).union(contexts.select(context_text().alias("text"))).union(entities.select(entity_text().alias("text")))
    documents = documents.union(graph.patterns.join(entities.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").select(text("content")))
    lexical = lexical_anchors(spark, task, documents)
    terms = _array(literals + lexical)

    def hits(table: DataFrame, body, *order) -> list[str]:
        rows = table.select("id", *[c for c in ("last_active", "last_seen_at") if c in table.columns], matched_terms(body, terms).alias("m")).filter("size(m) > 0")
        return [r["id"] for r in rows.orderBy(*order).select("id").collect()]  # a pool at most

    return {
        "task": task,
        "literals": literals,
        "lexical": lexical,
        "entities": hits(entities, entity_text(), "id"),
        "contexts": hits(contexts, context_text(), F.desc("last_seen_at"), "id"),
        "events": hits(events, event_text(payload="payload"), F.desc("last_active"), "id"),
    }


def place(stage: int, at, first: str, second: str | None = None):
    """Where a path stands among all: by stage, then by a number, then by ids. Ordered as it is, without numbering rows."""
    return F.struct(F.lit(stage).alias("stage"), F.coalesce(at.cast("long"), F.lit((1 << 63) - 1)).alias("at"), text(first).alias("first"), (text(second) if second else F.lit("")).alias("second"))


def latest_first(column: str):
    return -F.col(column).cast("long")


def walk(graph: Graph, found: dict, per_anchor: int = PER_ANCHOR) -> DataFrame:
    """Paths from the anchors: patterns of entities, contexts, events by entity, by text and by context, and relations."""
    spark, literals = graph.spark, _array(found["literals"])
    terms = found["literals"] + found["lexical"]
    # any number of entities may match, so they are rows to join and no literals of a plan
    targets = {r["id"]: r["canonical"] for r in canonical_ids(graph.entities).join(_ids(spark, found["entities"]), "id", "left_semi").collect()} if found["entities"] else {}
    entity_ids = list(dict.fromkeys(targets.get(e, e) for e in found["entities"]))
    zero = F.lit(0)
    at = F.coalesce(F.when(F.col("last_active") != 0, F.col("last_active")), F.col("timestamp"), zero)
    known = lambda c: F.coalesce(c, F.lit(1))

    def event_paths(rows: DataFrame, stage: int, length: int, entity_hits=zero, names: list[str] | None = None) -> DataFrame:
        rows = rows.withColumn("_matched", matched_terms(event_text(payload="payload"), _array(terms), loose=True))
        matched = anchors = F.col("_matched")
        if names:
            # a name adds no literal hit: one that is a literal matches as the literal does, which is a term
            rows = rows.crossJoin(F.broadcast(spark.createDataFrame([(names,)], "_names array<string>")))
            anchors = F.array_distinct(F.concat(matched, matched_terms(event_text(payload="payload"), F.col("_names"), loose=True)))
        return rows.select(place(stage, F.col("pos") if "pos" in rows.columns else latest_first("last_active"), "id").alias("seq"), F.lit("event").alias("memory_type"), F.col("id").alias("primary_id"), anchors.alias("anchor_terms"), F.lit(length).alias("path_length"), literal_hits(matched, literals).alias("literal_hits"), entity_hits.alias("entity_hits"), known(F.col("support_count")).alias("support_count"), at.alias("last_active"), event_card().alias("folded"), F.lit("event").alias("reason"), ((F.size(matched) > 0) | (entity_hits > 0)).alias("has_value"), F.lit(False).alias("warning"))

    held = graph.patterns.filter(F.col("entity_id").isin(entity_ids[:per_anchor]))
    cut = recall_patterns(held, found["task"], "section", 1).join(held.select("entity_id", F.coalesce("updated_at", "created_at", zero).alias("last_active")), "entity_id")
    order = F.array_position(_array(entity_ids[:per_anchor]), F.col("entity_id"))
    rules = cut.filter(F.trim("content") != "").select(place(0, order, "entity_id").alias("seq"), F.lit("rule").alias("memory_type"), F.lit(None).cast("string").alias("primary_id"), F.array("entity_id").alias("anchor_terms"), F.lit(2).alias("path_length"), zero.alias("literal_hits"), F.lit(1).alias("entity_hits"), F.lit(1).alias("support_count"), "last_active", plain_markdown("content").alias("folded"), F.lit("rule").alias("reason"), F.lit(True).alias("has_value"), F.lit(False).alias("warning"))

    own = by_ids(graph.contexts, found["contexts"][:per_anchor], ["active"]).withColumn("_matched", matched_terms(context_text(), _array(terms), loose=True))
    matched = F.col("_matched")
    telling = (F.size(matched) > 0) | (F.coalesce(F.size("facts"), zero) > 0) | (text("applies_when") != "") | (text("condition") != "")
    contexts = own.select(place(1, F.col("pos"), "id").alias("seq"), F.lit("context").alias("memory_type"), F.col("id").alias("primary_id"), matched.alias("anchor_terms"), F.lit(1).alias("path_length"), literal_hits(matched, literals).alias("literal_hits"), zero.alias("entity_hits"), known(F.col("support_count")).alias("support_count"), F.coalesce("last_seen_at", "updated_at", "created_at", zero).alias("last_active"), context_card().alias("folded"), F.lit("context").alias("reason"), telling.alias("has_value"), F.lit(False).alias("warning"))

    linked = graph.involves.join(F.broadcast(_ids(spark, entity_ids, "entity_id")), "entity_id", "left_semi").groupBy(F.col("event_id").alias("id")).agg(F.count_distinct("entity_id").alias("_hits"), F.max(F.col("entity_id").isin(entity_ids[:per_anchor])).alias("_near"))
    by_entity = graph.events.filter("status = 'active'").join(linked.filter("_near"), "id")
    paths = [rules, contexts, event_paths(by_entity, 2, 2, F.col("_hits").cast("int"), entity_ids)]
    paths.append(event_paths(by_ids(graph.events, found["events"][:per_anchor], ["active"]), 3, 1))
    paths.append(event_paths(events_by_contexts(graph.events, graph.in_rel, found["contexts"][:per_anchor], per_anchor * 2).filter("status = 'active'"), 4, 2))
    plain = paths[0]
    for p in paths[1:]:
        plain = plain.unionByName(p)

    # relations start from the anchored events, then from those found so far
    others = [r["primary_id"] for r in plain.filter("memory_type = 'event'").orderBy("seq").select("primary_id").limit(per_anchor * 4).collect()]
    starts = list(dict.fromkeys(found["events"] + others))[: per_anchor * 2]
    types = [*RELATION_TYPES, *[a for k, v in RELATION_ALIASES.items() if k for a in v]]
    edges = relation_paths(graph.relations, graph.events, starts, types).select("from_id", "to_id", "relation_type", "updated_at").filter(relation_type("relation_type") != "")
    end = lambda c, p: graph.events.select(F.col("id").alias(c), event_text(payload="payload").alias(f"{p}_text"), event_card().alias(f"{p}_card"), known(F.col("support_count")).alias(f"{p}_support"), at.alias(f"{p}_at"))
    both = edges.join(end("from_id", "s"), "from_id").join(end("to_id", "d"), "to_id")
    both = both.withColumn("_matched", matched_terms(F.concat_ws(" ", "s_text", "d_text"), _array(terms), loose=True))
    newer = F.col("relation_type").isin(SAME_TOPIC, MEANING_UPDATE)
    evolved = both.select(
        place(5, latest_first("updated_at"), "from_id", "to_id").alias("seq"), F.lit("event").alias("memory_type"), F.when(newer, F.col("to_id")).otherwise(F.col("from_id")).alias("primary_id"), matched.alias("anchor_terms"), F.lit(2).alias("path_length"), literal_hits(matched, literals).alias("literal_hits"), zero.alias("entity_hits"),
        F.greatest("s_support", "d_support").alias("support_count"), F.greatest("s_at", "d_at").alias("last_active"), F.when(newer, F.col("d_card")).otherwise(join_clause("s_card", "d_card")).alias("folded"), F.col("relation_type").alias("reason"), F.lit(True).alias("has_value"), (F.col("relation_type") == MEANING_UPDATE).alias("warning"), F.when(newer & (F.col("from_id") != F.col("to_id")), F.col("from_id")).alias("superseded"),
    )
    return plain.withColumn("superseded", F.lit(None).cast("string")).unionByName(evolved)


def fold(paths: DataFrame) -> DataFrame:
    """Without events that a newer one replaces; of each memory its best path."""
    gone = paths.filter("superseded is not null").select(F.col("superseded").alias("primary_id"), F.lit(True).alias("_gone")).distinct()
    left = paths.join(gone, "primary_id", "left").filter((F.col("folded") != "") & ~(F.coalesce("_gone", F.lit(False)) & (F.col("memory_type") == "event") & ~F.col("reason").isin(SAME_TOPIC, MEANING_UPDATE)))
    key = F.concat_ws(":", "memory_type", F.coalesce("primary_id", "folded"))
    line = Window.partitionBy(key)
    best = F.row_number().over(line.orderBy(F.desc("literal_hits"), F.desc("entity_hits"), F.desc("support_count"), F.desc("last_active"), "seq"))
    return left.withColumns({"_r": best, "seq": F.min("seq").over(line)}).filter("_r = 1").drop("_r", "_gone")


def select(folded: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The memories that can change what is done next, one for each text, best first (``rank``)."""
    tier = F.when(F.col("warning") | (F.col("memory_type") == "rule"), 1).when(F.col("memory_type") == "context", 2).otherwise(3)
    order = [tier, F.desc("literal_hits"), F.desc("entity_hits"), F.col("path_length"), F.desc("support_count"), F.desc("last_active"), F.col("seq")]
    rows = folded.filter("has_value").withColumn("_key", normalize_key("folded")).filter("_key <> ''")
    one = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_key").orderBy(*order))).filter("_r = 1")
    return one.orderBy(*order).limit(max(1, limit)).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))).drop("_r", "_key")


def bullets(selected: DataFrame) -> DataFrame:
    """(rank, kind, text) of the lines."""
    kind = F.when(F.col("warning"), "Warning").when(F.col("memory_type") == "rule", "Rule").when(F.col("memory_type") == "context", "Context").otherwise("Event")
    return selected.select("rank", kind.alias("kind"), F.concat(F.lit("- ["), kind, F.lit("] "), trim_line("folded", 120)).alias("text"))


def recall_for_task(graph: Graph, task: str, limit: int = LIMIT) -> dict:
    """prompt_text (markdown, '' if nothing is relevant), items and counts."""
    task = (task or "").strip()
    if not task:
        return {"prompt_text": "", "items": [], "stats": {"reason": "empty_task"}}
    found = project(graph, task)
    folded = fold(walk(graph, found))
    lines = [r.asDict() for r in bullets(select(folded, limit)).orderBy("rank").collect()]
    prompt = "## Relevant Memory\n" + "\n".join(x["text"] for x in lines) if lines else ""
    stats = {f"{k}_anchors": len(found[k]) for k in ("literals", "lexical", "entities", "contexts", "events")}
    return {"prompt_text": prompt, "items": lines, "stats": stats | {"selected": len(lines)}, "projection": found}


