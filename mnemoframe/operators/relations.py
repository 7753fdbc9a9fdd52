"""Relations between events: rules, gates, budgets and supersession chains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import clamp
from ..functions.text import text
from ..plans.model import MEANING_UPDATE, SHARED_CONTEXT
from ..sources.shared import written

MAX_LINKS, MIN_CONFIDENCE = 3, 0.75
SEMANTIC_GATE, AGGREGATE_GATE = 0.82, 0.25
INACTIVE = ("merged", "archived", "ignored")


def sort_key(prefix: str = "") -> Column:
    at = F.coalesce(*[F.when(F.col(f"{prefix}{c}") != 0, F.col(f"{prefix}{c}")) for c in ("timestamp", "last_active", "created_at")], F.lit(0))
    return F.struct(at.alias("at"), F.col(f"{prefix}id").alias("id"))


def clean_states(states: DataFrame) -> DataFrame:
    """id, at, entity, attribute, before, after: stripped, blank keys left out; ``at`` from ``timestamp``."""
    value = lambda c: F.trim(text(c))
    out = states.select("id", F.coalesce("timestamp", F.lit(0)).alias("at"), value("entity").alias("entity"), value("attribute").alias("attribute"), value("value_before").alias("before"), value("value_after").alias("after"))
    return out.filter("entity <> '' and attribute <> ''")


def _facts(**parts: DataFrame) -> DataFrame:
    """(id, lists of the parts): one row an id; each part has (id, x)."""
    rows = [rows.select("id", *[(F.col("x") if n == name else F.lit(None)).alias(n) for n in parts]) for name, rows in parts.items()]
    # dealt as they are: an id has few rows, lists made of them before would only be larger
    return reduce(DataFrame.unionByName, rows).repartition("id").groupBy("id").agg(*[F.collect_list(n).alias(n) for n in parts])


def _selves(events: DataFrame) -> DataFrame:
    inactive = F.coalesce(F.col("status").isin(*INACTIVE), F.lit(False)) if "status" in events.columns else F.lit(False)
    return events.select("id", F.struct(F.trim(text("parent_event_id")).alias("parent"), inactive.alias("inactive")).alias("x"))


def _changes(states: DataFrame) -> DataFrame:
    return clean_states(states).select("id", F.struct("at", "entity", "attribute", "before", "after").alias("x"))


def _contexts(in_rel: DataFrame) -> DataFrame:
    return in_rel.select(F.col("event_id").alias("id"), F.col("context_id").alias("x"))


def _with(pairs: DataFrame, key: str, facts: DataFrame, **columns: Column) -> DataFrame:
    """``pairs`` with what ``columns`` make of the lists of the event that ``key`` names, null if it has none."""
    return pairs.join(facts.select(F.col("id").alias(key), *[c.alias(name) for name, c in columns.items()]), key, "left")


def _bit(*of: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.hash(*of), F.lit(64)))


def _bits(values: Column | str, bit) -> Column:
    """One of 64 bits for each value: what two lists share has a bit in common."""
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(bit(x)))


def _shares(a: str, b: str) -> Column:
    return F.coalesce(F.col(a).bitwiseAND(F.col(b)) != 0, F.lit(False))


def _changing() -> Column:
    """States that can change another one: their value after is known."""
    return F.filter("states", lambda n: n["after"] != "")


def _update(new: str, old: str) -> Column:
    """The least of the states (lists ``new``, ``old``) that the query changes and its candidate set; null if there is none."""
    older = lambda n, o: F.struct(o["at"], F.col("cand_id")) < F.struct(n["at"], F.col("query_id"))
    differs = lambda n, o: (n["after"] != o["after"]) & ~((n["before"] != "") & (o["after"] != "") & (n["before"] != o["after"]))
    changed = lambda n, o: (o["entity"] == n["entity"]) & (o["attribute"] == n["attribute"]) & older(n, o) & differs(n, o)
    met = lambda n, o: F.struct(n["entity"].alias("entity"), n["attribute"].alias("attribute"), o["after"].alias("old_after"), n["before"].alias("new_before"), n["after"].alias("new_after"))
    return F.array_min(F.flatten(F.transform(new, lambda n: F.transform(F.filter(old, lambda o: changed(n, o)), lambda o: met(n, o)))))


def _update_fields(m: str) -> list[Column]:
    before = F.when(F.col(f"{m}.old_after") != "", F.col(f"{m}.old_after")).otherwise(F.col(f"{m}.new_before"))
    return [F.lit("supersedes").alias("operation"), F.lit(0.95).alias("confidence"), F.lit("candidate_to_new").alias("direction"), before.alias("value_before"), F.col(f"{m}.new_after").alias("value_after")]


def _parents() -> Column:
    """Whom an event names; null if it is not known."""
    return F.when(F.size("selves") > 0, F.transform("selves", lambda x: x["parent"]))


def _names(parents: str, other: str) -> Column:
    return F.coalesce((F.trim(other) != "") & F.array_contains(parents, F.col(other)), F.lit(False))


def _towards(names: Column, back: Column) -> Column:
    """The direction: the query names its candidate, or ``back``."""
    # of a pair that names each other the new one's parent counts
    return F.when(names, "candidate_to_new").when(back, "new_to_candidate")


def _reference_fields(direction: str) -> list[Column]:
    return [F.lit("co_recall").alias("operation"), F.lit(0.9).alias("confidence"), F.col(direction).alias("direction"), F.lit("").alias("value_before"), F.lit("").alias("value_after")]


def _pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("new_id").alias("query_id"), F.col("old_id").alias("cand_id")).distinct()


def state_updates(pairs: DataFrame, states: DataFrame) -> DataFrame:
    """Of pairs (new_id, old_id): those in which the new event changes a state that the old one set.

    The old event is strictly older; the new value is not blank and differs;
    where both are known, the new event's value before is the old one's after.
    """
    facts = _facts(states=_changes(states))
    met = _with(_with(_pairs(pairs), "query_id", facts, new=_changing()), "cand_id", facts, old=F.col("states"))
    return met.withColumn("m", _update("new", "old")).filter("m is not null").select(F.col("query_id").alias("new_id"), F.col("cand_id").alias("old_id"), *_update_fields("m"))


def supersession_chain(states: DataFrame) -> DataFrame:
    """The same over whole tables without pairs: each change of a key against the change before it."""
    s = clean_states(states)
    line = Window.partitionBy("entity", "attribute").orderBy("at", "id")
    s = s.withColumns({"old_id": F.lag("id").over(line), "old_after": F.lag("after").over(line)})
    agrees = (F.col("before") == "") | (F.col("old_after") == "") | (F.col("before") == F.col("old_after"))
    kept = s.filter(F.col("old_id").isNotNull() & (F.col("old_id") != F.col("id")) & (F.col("after") != "") & (F.col("after") != F.col("old_after")) & agrees)
    return kept.select(F.col("old_id").alias("from_id"), F.col("id").alias("to_id"), "entity", "attribute", F.when(F.col("old_after") != "", F.col("old_after")).otherwise(F.col("before")).alias("value_before"), F.col("after").alias("value_after"))


def explicit_references(pairs: DataFrame, events: DataFrame) -> DataFrame:
    """Of pairs (new_id, old_id): those of which one names the other as its parent."""
    facts = _facts(selves=_selves(events))
    met = _with(_with(_pairs(pairs), "query_id", facts, new=_parents()), "cand_id", facts, old=_parents())
    known = lambda parents: F.col(parents).isNotNull()
    met = met.withColumn("towards", _towards(_names("new", "cand_id") & known("old"), _names("old", "query_id") & known("new"))).filter("towards is not null")
    return met.select(F.col("query_id").alias("new_id"), F.col("cand_id").alias("old_id"), *_reference_fields("towards"))


def priority(channels: Column) -> Column:
    has = lambda c: F.map_contains_key(channels, c)
    return F.when(has("reference"), 5).when(has("state"), 4).when(has("semantic") & has("entity"), 3).when(has("semantic"), 2).otherwise(1)


def entity_only(channels: Column) -> Column:
    return (F.size(channels) > 0) & (F.size(F.array_except(F.map_keys(channels), F.array(F.lit("entity"), F.lit("temporal")))) == 0)


def needs_judgement(channels: Column, aggregate: Column) -> Column:
    has = lambda c: F.map_contains_key(channels, c)
    return has("reference") | has("state") | ((F.coalesce(F.element_at(channels, "semantic"), F.lit(0.0)) >= SEMANTIC_GATE) & (aggregate >= AGGREGATE_GATE))


def _alone() -> Column:
    """The route of a candidate of which no more is known."""
    channels = F.col("channels")
    return F.when(entity_only(channels), "entity_only").when(needs_judgement(channels, F.col("aggregate_score")), "judge").otherwise("below_gate")


def _foremost() -> list[Column]:
    return [F.desc("priority"), F.desc("aggregate_score"), F.desc("channel_score"), F.desc("cand_at"), F.asc("cand_id")]


def _routed(told: DataFrame, alone: Column, events: DataFrame, states: DataFrame, in_rel: DataFrame, max_links: int, order: list[Column], decided: bool = False) -> DataFrame:
    """``told`` with ``rule`` and ``route``, which is ``alone`` where nothing else is known; ``decided`` keeps what a rule or the judge decides.

    A pair travels once to its candidate, with a bit for each state and context
    of its query, and once back. What meets a bit there travels back with it and
    is compared as it is.
    """
    facts, kept = _facts(selves=_selves(events), states=_changes(states), contexts=_contexts(in_rel)), told.columns
    key, mark = (lambda s: _bit(s["entity"], s["attribute"])), _bit
    # what is known of the id would else be asked of the facts too, which then were others for the two ends and shuffled twice
    told = told.withColumn("cand_id", F.concat("cand_id"))
    asked = _with(told, "query_id", facts, new=_parents(), keys=_bits(_changing(), key), until=F.array_max(F.transform(_changing(), lambda n: n["at"])), marks=_bits("contexts", mark))
    marks = F.when(alone == "judge", F.col("marks")) if decided else F.col("marks")
    asked = asked.select(*kept, _names("new", "cand_id").alias("names"), "keys", "until", marks.alias("marks"))
    there = _with(asked, "cand_id", facts, old=_parents(), inactive=F.exists("selves", lambda x: x["inactive"]), states=F.transform("states", lambda s: F.struct(*[s[c].alias(c) for c in ("at", "entity", "attribute", "after")])), held=_bits("states", key), since=F.array_min(F.transform("states", lambda s: s["at"])), contexts=F.col("contexts"), marked=_bits("contexts", mark))
    # of each pair numbers are compared, of the few that may meet the lists
    there = there.withColumns({"meets": _shares("keys", "held") & (F.col("since") <= F.col("until")), "inactive": F.coalesce("inactive", F.lit(False)), "towards": _towards(F.col("names") & F.col("old").isNotNull(), _names("old", "query_id"))})
    if decided:
        there = there.filter(~F.col("inactive") & ((F.coalesce(alone, F.lit("")) == "judge") | F.col("towards").isNotNull() | F.col("meets")))
    met = F.filter("states", lambda s: (F.struct(s["at"], F.col("cand_id")) < F.struct("until", "query_id")) & (F.col("keys").bitwiseAND(key(s)) != 0))
    marks = F.filter("contexts", lambda c: F.col("marks").bitwiseAND(mark(c)) != 0)
    back = there.select(*kept, "inactive", "towards", F.when(F.col("meets"), met).alias("old_states"), F.when(_shares("marks", "marked"), marks).alias("old_contexts"))
    out = _with(back, "query_id", facts, new=_parents(), new_states=_changing(), new_contexts=F.col("contexts"))
    towards = F.when((F.col("towards") == "candidate_to_new") | F.col("new").isNotNull(), F.col("towards"))
    shared = F.coalesce(F.arrays_overlap("new_contexts", "old_contexts"), F.lit(False))
    out = out.select(*kept, "inactive", towards.alias("towards"), F.when(F.size("old_states") > 0, _update("new_states", "old_states")).alias("m"), shared.alias("shared"))
    rule = F.when(F.col("m").isNotNull(), F.struct(F.lit(1).alias("_o"), *_update_fields("m"))).when(F.col("towards").isNotNull(), F.struct(F.lit(2).alias("_o"), *_reference_fields("towards")))
    route = F.when(F.col("inactive"), "inactive").when(F.col("m").isNotNull() | F.col("towards").isNotNull(), "rule").when(F.col("shared"), "shared_context").otherwise(alone)
    out = out.withColumns({"rule": rule, "route": route})
    # counted by query alone: what lies by query needs no other shuffle
    judged = F.sum((F.col("route") == "judge").cast("int")).over(Window.partitionBy("query_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    beyond = (F.col("route") == "judge") & (judged > min(5, max(1, max_links) + 2))
    out = out.withColumn("_beyond", beyond).withColumn("route", F.when(F.col("_beyond"), "judge_budget").otherwise(F.col("route"))).select(*kept, "rule", "route")
    return out.filter(F.col("route").isin("rule", "judge")) if decided else out


def split_candidates(candidates: DataFrame, events: DataFrame, states: DataFrame, in_rel: DataFrame, max_links: int = MAX_LINKS) -> DataFrame:
    """``candidates`` (from ``recall``) with ``route``: rule, judge or the reason it is skipped, and the rule's decision.

    In order: inactive; a state update; an explicit reference; a shared
    context; entity or time alone; the judge's gate; beyond the judge's budget.
    """
    return _routed(candidates.withColumn("priority", priority(F.col("channels"))), _alone(), events, states, in_rel, max_links, _foremost())


def normalized_decisions(judged: DataFrame, least: float = MIN_CONFIDENCE) -> DataFrame:
    """A judge's answers made safe: known operations only, confidence within [0, 1], the unsure skipped."""
    op = F.lower(F.trim(text("operation")))
    confidence = clamp(F.coalesce(text("confidence").try_cast("double"), F.lit(0.0)))
    return judged.withColumns({"confidence": confidence, "operation": F.when(op.isin("supersedes", "co_recall") & (confidence >= least), op).otherwise("skip")})


def execute(decisions: DataFrame, max_links: int = MAX_LINKS) -> DataFrame:
    """``status`` of each decision: of a query's decisions by confidence, the first ``max_links`` that link are executed."""
    inactive = F.col("cand_status").isin(*INACTIVE) if "cand_status" in decisions.columns else F.lit(False)
    state = F.when(F.col("operation") == "skip", "skipped").when(inactive, "candidate_inactive").otherwise("executed")
    line = Window.partitionBy("query_id").orderBy(F.desc("confidence"), "cand_id").rowsBetween(Window.unboundedPreceding, 0)
    out = decisions.withColumn("status", state).withColumn("_n", F.sum((F.col("status") == "executed").cast("int")).over(line))
    return out.withColumn("status", F.when((F.col("status") == "executed") & (F.col("_n") > max_links), "relation_budget_exhausted").otherwise(F.col("status"))).drop("_n")


def edges_of(executed: DataFrame, events: DataFrame, now: int) -> DataFrame:
    """Edges of executed decisions: by explicit direction, else from the older to the newer event."""
    end = lambda name, c: events.select(F.col("id").alias(c), sort_key().alias(f"{name}_key"), F.col("last_active").alias(f"{name}_at"), *[F.col(x).alias(f"{name}_{x}") for x in ("session_id", "episode_id") if x in events.columns])
    out = executed.filter("status = 'executed'").join(end("q", "query_id"), "query_id").join(end("c", "cand_id"), "cand_id")
    forward = F.when(F.col("direction") == "new_to_candidate", True).when(F.col("direction") == "candidate_to_new", False).otherwise(F.col("q_key") < F.col("c_key"))
    first = lambda x: F.coalesce(*[F.when(F.trim(text(f"{s}_{x}")) != "", F.trim(text(f"{s}_{x}"))) for s in ("q", "c") if f"{s}_{x}" in out.columns], F.lit(""))
    return out.select(
        F.when(forward, F.col("query_id")).otherwise(F.col("cand_id")).alias("from_id"),
        F.when(forward, F.col("cand_id")).otherwise(F.col("query_id")).alias("to_id"),
        F.when(F.col("operation") == "supersedes", MEANING_UPDATE).otherwise(SHARED_CONTEXT).alias("relation_type"),
        "operation",
        "confidence",
        *[c for c in ("value_before", "value_after") if c in executed.columns],
        first("session_id").alias("source_session_id"),
        first("episode_id").alias("source_episode_id"),
        F.greatest(F.lit(now), F.col("q_at"), F.col("c_at")).alias("updated_at"),
    )


def report(executed: DataFrame) -> DataFrame:
    """One row of counters; reports of batches add up."""
    hit = F.col("status") == "executed"
    return executed.agg(F.count_if(hit & (F.col("operation") == "supersedes")).alias("updates"), F.count_if(hit & (F.col("operation") == "co_recall")).alias("links"), F.count_if(hit).alias("total_links"), F.count_if(~hit).alias("skipped"))


def process(candidates: DataFrame, events: DataFrame, states: DataFrame, in_rel: DataFrame, judge=None, max_links: int = MAX_LINKS) -> DataFrame:
    """Split, judge, execute. ``judge``: DataFrame of routed candidates -> with operation, confidence, direction (default: skip all).

    The candidates are read once. For a judge, what is decided is written with
    all its columns; without one only ids and places among a query's travel.
    """
    fields = ["operation", "confidence", "direction", "value_before", "value_after"]
    told, tables = candidates.withColumn("priority", priority(F.col("channels"))), (events, states, in_rel, max_links)
    if judge is None:
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(*_foremost()))
        told = told.withColumn("place", place).select("query_id", "cand_id", F.when(_alone() == "judge", F.col("place")).alias("place"))
        routed = _routed(told, F.when(F.col("place").isNotNull(), "judge"), *tables, [F.asc("place")], decided=True)
        skip = dict(zip(fields, [F.lit("skip"), F.lit(0.0), *[F.lit("")] * 3], strict=True))
        return execute(routed.select("query_id", "cand_id", *[F.coalesce(F.col(f"rule.{f}"), skip[f]).alias(f) for f in fields]), max_links)
    routed = written(_routed(told, _alone(), *tables, _foremost(), decided=True), "routed")
    ruled = routed.filter("route = 'rule'").select("query_id", "cand_id", *[F.col(f"rule.{f}").alias(f) for f in fields])
    judged = normalized_decisions(judge(routed.filter("route = 'judge'"))).select("query_id", "cand_id", *fields)
    return execute(ruled.unionByName(judged), max_links)
