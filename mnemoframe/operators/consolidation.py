"""Merging events, ageing and expiry: plans first, then new versions of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import merge_reason, merge_similarity
from ..functions.text import text
from .contexts import disjoint_plan
from .near import nearest, similar

NEAR, TOP_K, GATE, WINDOW, ARCHIVE, POOL = 0.80, 8, 0.78, 172800, 7776000, 300


def reference_time(events: DataFrame) -> DataFrame:
    """One row: the newest activity of active events."""
    return events.filter("status = 'active'").agg(F.max(F.coalesce(F.when(F.col("last_active") != 0, F.col("last_active")), F.col("timestamp"))).alias("now"))


def aggregated(prefix: str = "") -> Column:
    """Made by merging before: traces in the payload, or support above one."""
    trace = lambda k: F.coalesce(F.get_json_object(text(f"{prefix}payload"), f"$.{k}"), F.lit("[]")) != "[]"
    return trace("merge_inputs") | trace("merge_trace") | (F.coalesce(F.col(f"{prefix}support_count"), F.lit(1)) > 1)


def same_scope(a: str, b: str) -> Column:
    """The same session if both have one, else the same episode if both have one."""
    s = lambda p, c: F.trim(text(f"{p}.{c}"))
    sessions, episodes = (s(a, "session_id") != "") & (s(b, "session_id") != ""), (s(a, "episode_id") != "") & (s(b, "episode_id") != "")
    return F.when(sessions, s(a, "session_id") == s(b, "session_id")).when(episodes, s(a, "episode_id") == s(b, "episode_id")).otherwise(F.lit(False))


def recent_pool(events: DataFrame, now: int, focus: list[str] | None = None, window: int = WINDOW, limit: int = POOL) -> DataFrame:
    """What a merge run compares: the newest ``limit`` events of the window, or with ``focus`` the newest active ones."""
    held = events.filter("status = 'active'") if focus else events.filter(F.col("last_active") >= now - window)
    return held.orderBy(F.desc("last_active"), "id").limit(limit)


def near_pairs(events: DataFrame, block: Column | None = None, threshold: float = NEAR, top_k: int = TOP_K, focus: list[str] | None = None, search: str = "pairs") -> DataFrame:
    """(a, b, similarity, rank): of each event (or those in ``focus``) the ``top_k`` most similar others, not merged or archived, of its block.

    ``block`` keys what is compared (session, episode, cluster). With
    ``search="pairs"`` every pair of a block is (see ``near.nearest``), which without a
    block suits the recent pool only; ``"signatures"`` (see ``near.similar``) suits whole tables.
    Only ids, vectors and times are paired; the rows join the pairs that stay.
    """
    rows = lambda n: events.select(F.col("id").alias(f"{n}_id"), F.struct(*[F.col(c) for c in events.columns]).alias(n))
    whole = lambda pairs: pairs.join(rows("a"), "a_id").join(rows("b"), "b_id").select("a", "b", "similarity", "rank")
    alive = events.filter(~F.col("status").isin("merged", "archived") & (F.size("embedding") > 0))
    asked = alive.select("id", F.col("embedding").alias("v"), F.coalesce("last_active", "timestamp").alias("at"), *([block.cast("string").alias("scope")] if block is not None else [F.lit("").alias("scope")] if search == "pairs" else []))
    search_in = nearest if search == "pairs" else similar
    return whole(search_in(asked, threshold, top_k, asked.filter(F.col("id").isin(focus)) if focus else None).withColumnsRenamed({"query_id": "a_id", "id": "b_id"}))


def merge_plan(events: DataFrame, block: Column | None = None, gate: float = GATE, near: float = NEAR, same_scope_only: bool = False, max_pairs: int | None = None, judge=None, focus: list[str] | None = None, search: str = "pairs") -> DataFrame:
    """Disjoint (canonical_id, merged_id, score, similarity, reason): which events to merge.

    Two aggregated events never merge; one only within its scope. The canonical
    one has more support, then was created later. ``judge`` may filter and
    rescore the pairs before matching. Equal scores count in order of the ids.
    With ``focus`` only these events look for a partner.
    """
    pairs = near_pairs(events, block, near, focus=focus, search=search)
    scope = same_scope("a", "b") if {"session_id", "episode_id"} <= set(events.columns) else F.lit(False)
    left, right = aggregated("a."), aggregated("b.")
    pairs = pairs.filter(~(left & right) & (~(left | right) | scope) & (scope if same_scope_only else F.lit(True)))
    gap = F.coalesce("a.last_active", "a.timestamp") - F.coalesce("b.last_active", "b.timestamp")
    key = lambda p: F.struct(F.coalesce(f"{p}.support_count", F.lit(1)).alias("s"), F.coalesce(f"{p}.created_at", f"{p}.timestamp", F.lit(0)).alias("c"), F.col(f"{p}.id").alias("i"))
    first = key("a") >= key("b")
    scored = pairs.select(
        F.when(first, F.col("a.id")).otherwise(F.col("b.id")).alias("canonical_id"),
        F.when(first, F.col("b.id")).otherwise(F.col("a.id")).alias("merged_id"),
        F.round(merge_similarity(F.col("similarity"), gap, WINDOW), 6).alias("score"),
        F.round("similarity", 4).alias("similarity"),
        merge_reason(gap, WINDOW).alias("reason"),
    ).dropDuplicates(["canonical_id", "merged_id"])
    scored = scored.filter(F.col("score") >= gate)
    scored = judge(scored) if judge is not None else scored
    return disjoint_plan(scored, max_pairs, by_id=True).join(scored.drop("score"), ["canonical_id", "merged_id"])


def merged_text(a: Column, b: Column) -> Column:
    """Both summaries, the second unless the first holds it."""
    x, y = F.trim(text(a)), F.trim(text(b))
    return F.when(x == "", y).when((y == "") | F.contains(x, y), x).otherwise(F.concat(x, F.lit("；"), y))


def apply_merges(events: DataFrame, plan: DataFrame, now: int) -> DataFrame:
    """The events after merging: canonical ones take up support and texts, merged ones are marked."""
    cols = [c for c in ("summary", "action", "causality", "support_count", "last_active") if c in events.columns]
    source = events.select(F.col("id").alias("merged_id"), *[F.col(c).alias(f"m_{c}") for c in cols])
    # a canonical event takes its sources in order of their ids
    taken = plan.select("canonical_id", "merged_id").join(source, "merged_id")
    taken = taken.groupBy(F.col("canonical_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("merged_id", *[f"m_{c}" for c in cols]))).alias("m"))
    gone = plan.select(F.col("merged_id").alias("id"), F.lit(True).alias("gone")).distinct()
    out = events.join(taken, "id", "left").join(gone, "id", "left")
    summary = F.substring(F.aggregate("m", text("summary"), lambda s, x: merged_text(s, x["m_summary"])), 1, 180)
    first = lambda c: F.substring(F.trim(F.coalesce(F.when(text(c) != "", F.col(c)), F.get(F.filter(F.transform("m", lambda x: x[f"m_{c}"]), lambda v: F.coalesce(v, F.lit("")) != ""), F.lit(0)), F.lit(""))), 1, 120)
    hit = F.col("m").isNotNull()
    changes = {
        "summary": F.when(hit, summary).otherwise(F.col("summary")),
        "action": F.when(hit, first("action")).otherwise(F.col("action")),
        "causality": F.when(hit, first("causality")).otherwise(F.col("causality")),
        "support_count": F.when(hit, F.col("support_count") + F.aggregate("m", F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x["m_support_count"], F.lit(1)).cast("long"))).otherwise(F.col("support_count")),
        "last_active": F.when(hit, F.greatest(F.col("last_active"), F.array_max(F.transform("m", lambda x: x["m_last_active"])))).otherwise(F.col("last_active")),
        "status": F.when(F.col("gone"), "merged").otherwise(F.col("status")),
        "valid_to": F.when(F.col("gone") & F.col("valid_to").isNull(), F.lit(now)).otherwise(F.col("valid_to")),
    }
    return out.select(*[changes[c].alias(c) if c in changes else F.col(c) for c in events.columns])


def traces_of(plan: DataFrame, now: int, version: str = "v1") -> DataFrame:
    """Lineage rows of a plan."""
    return plan.select(F.col("merged_id").alias("source_id"), F.col("canonical_id").alias("target_id"), F.col("reason").alias("merge_reason"), F.col("score").alias("similarity_score"), F.lit(now).alias("merged_at"), F.lit(version).alias("strategy_version"))


def archived(events: DataFrame, now: int) -> DataFrame:
    """Old events of little support become archived, whatever their status; ``changed`` marks them."""
    old = (F.col("last_active") < now - ARCHIVE) & (F.coalesce("support_count", F.lit(1)) <= 1)
    return events.withColumns({"changed": old, "status": F.when(old, "archived").otherwise(F.col("status")), "valid_to": F.when(old & F.col("valid_to").isNull(), F.lit(now)).otherwise(F.col("valid_to"))})


def archivable(events: DataFrame, now: int) -> DataFrame:
    return events.agg(F.count_if((F.col("last_active") < now - ARCHIVE) & (F.coalesce("support_count", F.lit(1)) <= 1)).alias("n_archivable"))


def unexpired(episodes: DataFrame, now: int, ttl: int = 3600) -> DataFrame:
    """Episodes within their time to live; the others are what a purge removes."""
    return episodes.filter(~(F.col("timestamp") < now - ttl))


def consolidate(events: DataFrame, contexts: DataFrame, now: int, block: Column | None = None, dry_run: bool = False, focus: list[str] | None = None, max_pairs: int | None = None) -> dict[str, DataFrame]:
    """Event merges, ageing contexts, archiving: the plan and, unless a dry run, the new tables.

    The plan is over the recent pool (see ``recent_pool``), or with ``block``
    over all events, compared within their blocks.
    """
    from .contexts import decayed

    plan = merge_plan(recent_pool(events, now, focus) if block is None else events, block, max_pairs=max_pairs, focus=focus)
    counts = plan.agg(F.count("*").alias("merged")).crossJoin(archivable(events, now)).crossJoin(decayed(contexts, now).agg(F.count_if("changed").alias("decayed")))  # one row each
    if dry_run:
        return {"plan": plan, "report": counts}
    return {"plan": plan, "report": counts, "events": archived(apply_merges(events, plan, now), now).drop("changed"), "contexts": decayed(contexts, now).drop("changed"), "traces": traces_of(plan, now)}
