"""Five-channel candidate recall for many new events at once, and fusion.

Each channel returns (query_id, cand_id, channel, score); a query is an event of
``queries``, a candidate one of ``events``. Pools that are limits over the whole
table (newest events) are of fixed size and broadcast; the equality channels
rank within their key first, so a popular key contributes its newest few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import cosine, recency
from ..functions.text import joined, lexical_score, text
from ..sources.shared import written

WEIGHTS = {"temporal": 0.10, "entity": 0.30, "semantic": 0.35, "state": 0.15, "reference": 0.10}
LIMITS = {"temporal": 5, "entity": 8, "semantic": 8, "state": 5, "reference": 5}
WINDOW, THRESHOLD, FLOOR, MOST = 604800, 0.78, 0.12, 10


def _now() -> Column:
    return F.coalesce(F.when(F.col("last_active") != 0, F.col("last_active")), F.col("timestamp"), F.lit(0))


def _top(rows: DataFrame, limit: int, *order: Column) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") <= limit).drop("_rank")


def _known(events: DataFrame) -> list[Column]:
    """What fusion asks of a candidate; it travels with the candidate, so that no channel is joined with the events again."""
    alive = ~F.col("status").isin("merged", "archived") if "status" in events.columns else F.lit(True)
    return [_now().alias("cand_at"), F.coalesce(alive, F.lit(False)).alias("alive")]


def _entry(x, score: Column) -> Column:
    return F.struct(x["id"].alias("cand_id"), score.cast("double").alias("score"), x["cand_at"].alias("cand_at"), x["alive"].alias("alive"))


def _latest(x, *before: Column) -> Column:
    """Sorts as ``before``, then the latest, unknown times last, then by id."""
    return F.struct(*before, x["at"].isNull().alias("none"), (-x["at"]).alias("back"), x["id"].alias("id"), x["cand_at"].alias("cand_at"), x["alive"].alias("alive"))


def _listed(rows: DataFrame, limit: int, score: str = "score") -> DataFrame:
    """(query_id, found): of rows (query_id, score, x) the best ``limit``."""
    each = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(_latest(F.col("x"), (-F.col(score)).alias("less")))).alias("l"))
    return each.select("query_id", F.transform(F.slice("l", 1, limit), lambda x: _entry(x, -x["less"])).alias("found"))


def _rows(lists: DataFrame, channel: str) -> DataFrame:
    return lists.select("query_id", F.explode("found").alias("f")).select("query_id", F.col("f.cand_id").alias("cand_id"), F.lit(channel).alias("channel"), F.col("f.score").alias("score"))


def temporal(queries: DataFrame, events: DataFrame, window: int = WINDOW, limit: int = LIMITS["temporal"]) -> DataFrame:
    """The newest 3 x limit events from ``window`` before the query on; later ones count as simultaneous."""
    asked = queries.select(F.col("id").alias("query_id"), _now().alias("now"))
    return _rows(_temporal(asked, events, window, limit).withColumnRenamed("temporal", "found"), "temporal")


def _temporal(asked: DataFrame, events: DataFrame, window: int = WINDOW, limit: int = LIMITS["temporal"]) -> DataFrame:
    """``asked`` (query_id, now) with the list ``temporal``; nothing is shuffled."""
    newest = events.orderBy(F.desc("last_active"), "id").limit(limit * 3).select(F.struct("id", _now().alias("at"), *_known(events)).alias("x"))
    pool = newest.agg(F.collect_list("x").alias("_pool"))
    near = F.filter("_pool", lambda x: (x["at"] >= F.col("now") - window) & (x["id"] != F.col("query_id")))
    near = F.sort_array(F.transform(near, lambda x: _latest(x, (-recency(F.col("now") - x["at"], window)).alias("less"))))
    return asked.crossJoin(F.broadcast(pool)).withColumn("temporal", F.transform(F.slice(near, 1, limit), lambda x: _entry(x, -x["less"]))).drop("_pool")


def entity_sets(events: DataFrame, involves: DataFrame) -> DataFrame:
    """(id, entities, at, alive): sorted distinct ids from edges; events without edges fall back to ``entity_ids`` if they carry it."""
    held = involves.groupBy(F.col("event_id").alias("id")).agg(F.sort_array(F.collect_set("entity_id")).alias("_edges"))
    own = F.sort_array(F.array_distinct(F.filter(F.transform("entity_ids", lambda e: F.trim(e)), lambda e: e != ""))) if "entity_ids" in events.columns else F.expr("cast(null as array<string>)")
    return events.join(held, "id", "left").select("id", F.coalesce("_edges", own).alias("entities"), _now().alias("at"), _known(events)[1])


POPULAR, WIDEST = 64, 6


def entity(queries: DataFrame, events: DataFrame, involves: DataFrame, limit: int = LIMITS["entity"], popular: int = POPULAR, widest: int = WIDEST) -> DataFrame:
    """Jaccard of entity sets: the best ``limit`` of each query, by score, recency, id.

    Events of one set score alike, so sets are compared, each with its newest
    few events. An entity of more than ``popular`` sets is popular. Sets that
    share another entity meet there. A candidate that shares only the popular
    entities S has a score fixed by its size, so of each (S, size) the newest
    few suffice: whatever is left out has as many better ones in its group.
    Sets with more than ``widest`` popular entities have too many subsets; they
    meet through each of their entities.
    """
    return _rows(_entity(queries, events, involves, limit, popular, widest), "entity")


def _entity(queries: DataFrame, events: DataFrame, involves: DataFrame, limit: int = LIMITS["entity"], popular: int = POPULAR, widest: int = WIDEST) -> DataFrame:
    """Lists of ``entity``: a set's candidates are one row, as are a query's."""
    few = limit + 1
    known = lambda rows: entity_sets(rows, involves).filter("size(entities) > 0")
    sets = known(events)
    if queries is events:
        sets = written(sets, "entity-sets-of-events")  # read twice, not made twice
    asked = (sets if queries is events else known(queries)).select(F.col("id").alias("query_id"), F.col("entities").alias("q"))
    newest = Window.partitionBy("entities").orderBy(F.desc("at"), "id")
    groups = sets.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= few).groupBy("entities").agg(F.sort_array(F.collect_list(F.struct((-F.col("at")).alias("back"), "id", "alive"))).alias("members"))
    groups = written(groups, "entity-sets")
    each = groups.select(F.explode("entities").alias("e")).groupBy("e").agg(F.count("*").alias("n"))
    often = written(each.filter(F.col("n") > popular).select("e"), "popular-entities")

    def parted(shapes: DataFrame) -> DataFrame:
        """``shared``: the popular entities of each set, sorted; ``wide``: too many for subsets."""
        held = shapes.select("entities", F.explode("entities").alias("e")).join(often, "e").groupBy("entities").agg(F.sort_array(F.collect_list("e")).alias("shared"))
        out = shapes.join(held, "entities", "left").withColumn("shared", F.coalesce("shared", F.expr("cast(array() as array<string>)")))
        return out.withColumn("wide", F.size("shared") > widest)

    q, c = parted(asked.select(F.col("q").alias("entities")).distinct()), parted(groups.select("entities"))
    side = lambda rows, column, name: rows.select(F.col("entities").alias(name), F.explode(column).alias("e"))
    rare = F.array_except("entities", "shared")
    met = side(q, rare, "q").join(side(c, rare, "c"), "e")
    met = met.unionByName(side(q.filter("wide"), F.col("shared"), "q").join(side(c, F.col("shared"), "c"), "e"))
    met = met.unionByName(side(q.filter("not wide"), F.col("shared"), "q").join(side(c.filter("wide"), F.col("shared"), "c"), "e"))
    pairs = met.select("q", "c").distinct()
    score = F.size(F.array_intersect("q", "c")) / F.size(F.array_union("q", "c"))
    ranked = pairs.withColumn("score", score).join(groups.withColumnRenamed("entities", "c"), "c")
    best = Window.partitionBy("q").orderBy(F.desc("score"), F.col("members")[0])
    ranked = ranked.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= few).select("q", F.transform("members", lambda m: F.struct((-F.col("score")).alias("less"), m.alias("m"))).alias("l"))
    ranked = ranked.groupBy("q").agg(F.slice(F.sort_array(F.flatten(F.collect_list("l"))), 1, few).alias("l"))

    subsets = F.expr("transform(sequence(1, shiftleft(1, size(shared)) - 1), b -> filter(shared, (x, i) -> shiftright(b, i) % 2 = 1))")
    parts = lambda rows: rows.filter("not wide and size(shared) > 0").withColumn("s", F.explode(subsets))
    pool = parts(c).join(groups, "entities").select("s", F.size("entities").alias("size"), F.explode("members").alias("m"))
    pool = pool.withColumn("_r", F.row_number().over(Window.partitionBy("s", "size").orderBy("m"))).filter(F.col("_r") <= few)
    # the fewer others a set has, the better; a list for each s: by size, then the newest
    pool = pool.groupBy("s").agg(F.sort_array(F.collect_list(F.struct("size", "m"))).alias("p"))
    scored = F.transform("p", lambda x: F.struct((-(F.size("s") / (F.size("q") + x["size"] - F.size("s")))).alias("less"), x["m"].alias("m")))
    alike = parts(q).select(F.col("entities").alias("q"), "s").join(pool, "s").select("q", F.slice(F.sort_array(scored), 1, few).alias("l"))

    lists = ranked.unionByName(alike).groupBy("q").agg(F.sort_array(F.flatten(F.collect_list("l"))).alias("l"))
    # of an event that is met more than once the best score
    lists = lists.select("q", "l", F.col("l.m.id").alias("ids"))
    lists = lists.select("q", F.slice(F.filter("l", lambda x, i: F.array_position("ids", x["m"]["id"]) == i + 1), 1, few).alias("l"))
    others = F.slice(F.filter("l", lambda x: x["m"]["id"] != F.col("query_id")), 1, limit)
    entry = lambda x: _entry({"id": x["m"]["id"], "cand_at": -x["m"]["back"], "alive": x["m"]["alive"]}, -x["less"])
    return asked.join(lists, "q").select("query_id", F.transform(others, entry).alias("found"))


def semantic(queries: DataFrame, events: DataFrame, threshold: float = THRESHOLD, limit: int = LIMITS["semantic"]) -> DataFrame:
    """Cosine against the newest max(10 x limit, 200) active events, of these those with vectors."""
    return _rows(_semantic(queries, events, threshold, limit), "semantic")


def _semantic(queries: DataFrame, events: DataFrame, threshold: float = THRESHOLD, limit: int = LIMITS["semantic"]) -> DataFrame:
    pool = events.filter("status = 'active'").orderBy(F.desc("last_active"), "id").limit(max(10 * limit, 200)).filter("size(embedding) > 0")
    pool = pool.select(F.struct("id", F.col("last_active").alias("at"), *_known(events)).alias("x"), F.col("embedding").alias("v"))
    asked = queries.filter("size(embedding) > 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    near = asked.join(F.broadcast(pool), F.col("x.id") != F.col("query_id")).withColumn("score", cosine("q", "v")).filter(F.col("score") >= threshold)
    return _listed(_top(near, limit, F.desc("score"), F.desc("x.at"), F.asc("x.id")), limit)


def state(queries: DataFrame, events: DataFrame, states: DataFrame, limit: int = LIMITS["state"]) -> DataFrame:
    """Active events that change the same (entity, attribute): the newest of each key, score 1.

    ``states``: id, entity, attribute. Blank keys match nothing.
    """
    return _rows(_state(queries, events, states, limit), "state")


def _state(queries: DataFrame, events: DataFrame, states: DataFrame, limit: int = LIMITS["state"]) -> DataFrame:
    keyed = states.filter((F.trim(text("entity")) != "") & (F.trim(text("attribute")) != "")).select("id", F.trim("entity").alias("entity"), F.trim("attribute").alias("attribute")).distinct()
    active = events.filter("status = 'active'").select("id", F.col("last_active").alias("at"), *_known(events))
    newest = Window.partitionBy("entity", "attribute").orderBy(F.desc("at"), "id")
    pool = keyed.join(active, "id").withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= limit)
    pool = pool.groupBy("entity", "attribute").agg(F.sort_array(F.collect_list(_latest(_columns("id", "at", "cand_at", "alive")))).alias("l"))
    asked = keyed.join(queries.select("id"), "id", "left_semi").withColumnRenamed("id", "query_id")
    found = asked.join(pool, ["entity", "attribute"]).groupBy("query_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("l")))).alias("l"))
    others = F.slice(F.filter("l", lambda x: x["id"] != F.col("query_id")), 1, limit)
    return found.select("query_id", F.transform(others, lambda x: _entry(x, F.lit(1.0))).alias("found"))


def _columns(*names: str) -> dict[str, Column]:
    return {n: F.col(n) for n in names}


def reference(queries: DataFrame, events: DataFrame, limit: int = LIMITS["reference"]) -> DataFrame:
    """The event a query names as its parent (1.0, any status), and the newest active of its thread (0.8)."""
    return _rows(_reference(queries, events, limit), "reference")


def _reference(queries: DataFrame, events: DataFrame, limit: int = LIMITS["reference"]) -> DataFrame:
    own = queries.select(F.col("id").alias("query_id"), F.trim(text("parent_event_id")).alias("parent"), F.trim(text("thread_id")).alias("thread"))
    x = _columns("id", "at", "cand_at", "alive")
    held = events.select("id", F.col("last_active").alias("at"), *_known(events), "status", F.trim(text("thread_id")).alias("thread"))
    parents = own.filter("parent <> ''").select("query_id", F.col("parent").alias("id")).join(held, "id").select("query_id", F.array(_latest(x, F.lit(-1.0).alias("less"))).alias("l"))
    newest = Window.partitionBy("thread").orderBy(F.desc("at"), "id")
    pool = held.filter("status = 'active' and thread <> ''").withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= limit)
    pool = pool.groupBy("thread").agg(F.collect_list(_latest(x, F.lit(-0.8).alias("less"))).alias("l"))
    threads = own.filter("thread <> ''").select("query_id", "thread").join(pool, "thread").select("query_id", F.filter("l", lambda y: y["id"] != F.col("query_id")).alias("l"))
    both = parents.unionByName(threads).groupBy("query_id").agg(F.sort_array(F.flatten(F.collect_list("l"))).alias("l"))
    once = F.filter("l", lambda y, i: F.array_position("l.id", y["id"]) == i + 1)
    return both.select("query_id", F.transform(F.slice(once, 1, limit), lambda y: _entry(y, -y["less"])).alias("found"))


def fuse(channels: DataFrame, events: DataFrame, weights: dict[str, float] | None = None, floor: float = FLOOR, most: int = MOST) -> DataFrame:
    """One row per query and candidate: channels (map), channel (the best), channel_score, aggregate_score, rank.

    Itself, merged and archived candidates are dropped; the weighted sum must
    reach the floor; the best ``most`` stay, by sum, best score, recency.
    """
    alive = events.select(F.col("id").alias("cand_id"), *_known(events))
    return _fused(channels.join(alive, "cand_id"), weights, floor, most)


def _fused(rows: DataFrame, weights: dict[str, float] | None = None, floor: float = FLOOR, most: int = MOST) -> DataFrame:
    """``rows``: query_id, cand_id, channel, score, cand_at, alive. They are not shuffled if they lie by query_id."""
    weights = weights or WEIGHTS
    # of equal scores the first channel in this order is the primary one
    names = [*[c for c in WEIGHTS if c not in weights], *weights]
    own = lambda c: F.max(F.when(F.col("channel") == c, F.col("score")))
    kept = rows.filter(F.col("alive") & (F.col("query_id") != F.col("cand_id")) & (F.trim("cand_id") != "")).groupBy("query_id", "cand_id").agg(F.max("cand_at").alias("cand_at"), *[own(c).alias(f"_{c}") for c in names])
    raw = F.lit(0.0)
    for c, w in weights.items():
        raw = raw + F.coalesce(F.lit(w) * F.col(f"_{c}"), F.lit(0.0))
    kept = kept.withColumns({"_raw": raw, "channel_score": F.greatest(*[F.col(f"_{c}") for c in names])})
    kept = kept.filter(F.round("_raw", 12) >= floor).withColumn("aggregate_score", F.round("_raw", 6))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("aggregate_score"), F.desc("channel_score"), F.desc("cand_at"), "cand_id"))
    primary = F.coalesce(*[F.when(F.col(f"_{c}") == F.col("channel_score"), F.lit(c)) for c in names])
    every = F.filter(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"_{c}").alias("score")) for c in sorted(names)]), lambda x: x["score"].isNotNull())
    return kept.withColumn("rank", rank).filter(F.col("rank") <= most).select("query_id", "cand_id", "rank", primary.alias("channel"), "channel_score", "aggregate_score", F.map_from_entries(every).alias("channels"), "cand_at")


def recall(queries: DataFrame, events: DataFrame, involves: DataFrame, states: DataFrame | None = None, **more) -> DataFrame:
    """All channels whose inputs the tables have, fused. A query's lists meet in one row."""
    lists = {"entity": _entity(queries, events, involves)}
    if "embedding" in events.columns:
        lists["semantic"] = _semantic(queries, events)
    if states is not None:
        lists["state"] = _state(queries, events, states)
    if {"parent_event_id", "thread_id"} <= set(events.columns):
        lists["reference"] = _reference(queries, events)
    every = queries.select(F.col("id").alias("query_id"), _now().alias("now"))
    for name, found in lists.items():
        every = every.join(found.withColumnRenamed("found", name), "query_id", "left")
    every = _temporal(every, events)
    told = lambda c: F.transform(c, lambda x: F.struct(x["cand_id"].alias("cand_id"), x["score"].alias("score"), x["cand_at"].alias("cand_at"), x["alive"].alias("alive"), F.lit(c).alias("channel")))
    found = F.flatten(F.filter(F.array(*[told(c) for c in ("temporal", *lists)]), lambda x: x.isNotNull()))
    return _fused(every.select("query_id", F.explode(found).alias("f")).select("query_id", "f.*"), **more)


def candidate_contexts(contexts: DataFrame, query: str, entities: list[str] | None = None, limit: int = 16) -> DataFrame:
    """Contexts for a query among the newest 4 x limit active ones: lexical matches (score + 0.15 confidence), then a few recent others."""
    entities = entities or []
    names = F.array(*[F.lit(e) for e in entities]) if entities else None
    pool = contexts.filter("status = 'active'").orderBy(F.desc("last_seen_at"), "id").limit(limit * 4)
    lexical = lexical_score(F.concat_ws(" ", text("summary"), text("description")), F.lit(query), names)
    pool = pool.withColumn("_lexical", lexical)
    hit = (F.col("_lexical") > 0) | F.lit(not (query or entities))
    # the pool is of fixed size, so one window over it is bounded
    pool = pool.withColumn("_hit", hit).withColumn("score", F.when(hit, F.col("_lexical") + 0.15 * F.col("confidence")))
    by_score = Window.partitionBy("_hit").orderBy(F.desc("score"), F.desc("last_seen_at"), F.desc("confidence"), F.desc("support_count"), "id")
    pool = pool.withColumn("_r", F.row_number().over(by_score)).withColumn("_hits", F.least(F.sum(F.col("_hit").cast("int")).over(Window.partitionBy()), F.lit(limit)))
    spare = F.least(F.lit(max(2, limit // 4)), F.lit(limit) - F.col("_hits"))
    out = pool.filter(F.when(F.col("_hit"), F.col("_r") <= limit).otherwise(F.col("_r") <= spare))
    return out.orderBy(F.desc("_hit"), "_r").drop("_lexical", "_r", "_hits", "_hit")


def candidate_events(events: DataFrame, involves: DataFrame, in_rel: DataFrame, contexts: DataFrame, query: str, entities: list[str] | None = None, limit: int = 40, context_limit: int = 16) -> DataFrame:
    """Events of the named entities and of the query's contexts (newest ``limit``), each once."""
    by_entity = involves.filter(F.col("entity_id").isin(entities or [])).select(F.col("event_id").alias("id"))
    by_context = in_rel.join(F.broadcast(candidate_contexts(contexts, query, entities, context_limit).select(F.col("id").alias("context_id"))), "context_id").select(F.col("event_id").alias("id"))
    newest = events.join(by_context, "id", "left_semi").orderBy(F.desc("last_active"), "id").limit(limit)
    return events.join(by_entity, "id", "left_semi").unionByName(newest).dropDuplicates(["id"])


def context_match(event_ids: DataFrame, in_rel: DataFrame, contexts: DataFrame, query_vector: list[float]) -> DataFrame:
    """(id, context_match): best cosine of an event's contexts with the query, halved for inactive ones."""
    q = F.array(*[F.lit(float(x)) for x in query_vector])
    scored = contexts.select(F.col("id").alias("context_id"), (cosine("embedding", q) * F.when(F.col("status") == "active", 1.0).otherwise(0.5)).alias("s"))
    return event_ids.join(in_rel.withColumnRenamed("event_id", "id"), "id").join(scored, "context_id").groupBy("id").agg(F.max("s").alias("context_match"))


def with_retrieval_score(events: DataFrame, query_vector: list[float], now: int, matches: DataFrame | None = None, rate: float = 1e-8) -> DataFrame:
    """``events`` with evolution_score and its parts; see ``measures.retrieval_score``."""
    from ..functions.measures import retrieval_score

    q = F.array(*[F.lit(float(x)) for x in query_vector])
    out = events.join(matches, "id", "left") if matches is not None else events.withColumn("context_match", F.lit(0.0))
    valid = F.when(F.col("status").isin("merged", "archived", "deprecated"), 0.25).when(F.col("status") == "weakened", 0.5).otherwise(1.0)
    out = out.withColumns({"similarity": cosine("embedding", q), "context_match": F.coalesce("context_match", F.lit(0.0)), "validity": valid})
    return out.withColumn("evolution_score", retrieval_score(F.col("similarity"), F.col("context_match"), F.lit(now) - _now(), F.col("validity"), F.col("support_count"), rate))


def retrieve(events: DataFrame, query_vector: list[float], now: int, top_k: int = 5, matches: DataFrame | None = None) -> DataFrame:
    return with_retrieval_score(events, query_vector, now, matches).orderBy(F.desc("evolution_score"), "id").limit(top_k)


def embedding_text() -> Column:
    return joined("summary", "action", "causality")
