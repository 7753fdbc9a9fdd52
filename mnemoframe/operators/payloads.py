"""Extracted event payloads of any spelling to event rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import parse_time, time_range
from ..functions.text import once, text

#: Names under which a payload may hold each field, first found first taken.
NAMES = {
    "actor": ["actor", "Actor", "actors", "Actors", "participants", "participant"],
    "action": ["action", "Action", "what_happened", "WhatHappened", "event_action"],
    "time": ["time", "Time", "time_range", "timestamp", "happened_at"],
    "outcome": ["outcome", "Outcome", "result", "impact", "effect"],
    "summary": ["summary", "Summary", "event_summary"],
    "causality": ["causality", "cause", "reason"],
    "role": ["role", "name", "actor", "id", "label"],
    "seat": ["seat", "position", "loc"],
    "start": ["start", "begin", "timestamp"],
    "end": ["end", "finish"],
    "label": ["text", "label", "description"],
    "bucket": ["display_time_bucket", "bucket", "time_bucket"],
}
_HANDLED = [*{n for k in ("actor", "action", "time", "outcome", "summary", "causality") for n in NAMES[k]}, "evidence", "contexts"]
_NONE = ["", "[]", "{}", "null"]


def pick(payload: Column, field: str) -> Column:
    """The first of a field's names that holds something, as text or JSON; null if none."""
    found = [F.get_json_object(payload, f"$.{n}") for n in NAMES[field]]
    return F.coalesce(*[once(x, lambda v: F.when(~F.trim(text(v)).isin(_NONE), v)) for x in found])


def plain(value: Column) -> Column:
    """Text of a scalar; of a list its items, comma-joined."""

    def one(v: Column) -> Column:
        items = F.from_json(v, F.lit("array<string>"))
        listed = F.array_join(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != ""), ", ")
        return F.when(F.ltrim(text(v)).startswith("["), F.coalesce(listed, F.lit(""))).otherwise(F.trim(text(v)))

    return once(value, one)


def _list(value: Column) -> Column:
    """A JSON list's items, or the value alone."""
    one = lambda v: F.when(~F.trim(text(v)).isin(_NONE), F.array(v)).otherwise(F.expr("cast(array() as array<string>)"))
    return once(value, lambda v: F.when(F.ltrim(text(v)).startswith("["), F.from_json(v, F.lit("array<string>"))).otherwise(one(v)))


def _is_object(x: Column) -> Column:
    return F.ltrim(text(x)).startswith("{")


def participants(value: Column) -> Column:
    """array<struct(role, seat)>: distinct, of names or objects, those with a role."""
    each = F.transform(_list(value), lambda x: F.struct(F.when(_is_object(x), plain(pick(x, "role"))).otherwise(F.trim(text(x))).alias("role"), F.when(_is_object(x), plain(pick(x, "seat"))).otherwise(F.lit("")).alias("seat")))
    return F.array_distinct(F.filter(each, lambda p: p["role"] != ""))


def labels(people: Column) -> Column:
    """Sorted distinct names of participants, with their seats."""
    return F.array_sort(F.array_distinct(F.transform(people, lambda p: F.when(text(p["seat"]) != "", F.concat(p["role"], F.lit("/"), p["seat"])).otherwise(p["role"]))))


def evidence(value: Column) -> Column:
    """array<struct(source, snippet, timestamp, confidence)>; bare texts count as extracted, confidence 1 unless told."""
    get = lambda x, n: F.get_json_object(x, f"$.{n}")
    each = F.transform(
        _list(value),
        lambda x: F.struct(
            F.when(_is_object(x), F.trim(text(get(x, "source")))).otherwise(F.lit("llm_extraction")).alias("source"),
            F.when(_is_object(x), F.trim(text(get(x, "snippet")))).otherwise(F.trim(text(x))).alias("snippet"),
            F.when(_is_object(x), parse_time(get(x, "timestamp"))).otherwise(F.lit(0).cast("long")).alias("timestamp"),
            F.coalesce(F.when(_is_object(x), get(x, "confidence").try_cast("double")), F.lit(1.0)).alias("confidence"),
        ),
    )
    return F.filter(each, lambda e: (e["source"] != "llm_extraction") | (e["snippet"] != ""))


def happened(value: Column) -> Column:
    """The time range of a moment or of an object with a start."""
    return once(value, lambda v: F.when(_is_object(v), time_range(pick(v, "start"), pick(v, "end"), pick(v, "label"), pick(v, "bucket"))).otherwise(time_range(v, None, v)))


def rest(payload: Column) -> Column:
    """JSON of the fields that have no column and hold something."""
    held = F.from_json(payload, F.lit("map<string,string>"))
    return F.to_json(F.map_filter(held, lambda k, v: ~k.isin(_HANDLED) & ~F.coalesce(F.trim(v), F.lit("")).isin(_NONE)))


def normalized_payloads(rows: DataFrame, column: str = "payload") -> DataFrame:
    """``rows`` with summary, action, causality, participants, time_range, evidence, contexts, extra.

    A payload under ``event`` counts as the payload; a missing summary is the
    action, else the causality, else the outcome; a missing action is the
    summary, a missing causality the outcome. What is no object gives blanks.
    """
    own = F.when(_is_object(F.col(column)), F.col(column)).otherwise(F.lit("{}"))
    p = once(F.get_json_object(F.col(column), "$.event"), lambda inner: F.when(_is_object(inner), inner).otherwise(own))
    out = rows.withColumn("_p", p)
    raw = {k: plain(pick(F.col("_p"), k)) for k in ("summary", "action", "causality", "outcome")}
    out = out.withColumns({f"_{k}": v for k, v in raw.items()})
    first = lambda *xs: F.coalesce(*[F.when(F.col(x) != "", F.col(x)) for x in xs], F.lit(""))
    out = out.withColumn("summary", first("_summary", "_action", "_causality", "_outcome"))
    out = out.withColumns({"action": first("_action", "summary"), "causality": first("_causality", "_outcome"), "participants": participants(pick(F.col("_p"), "actor")), "time_range": happened(pick(F.col("_p"), "time")), "evidence": evidence(F.get_json_object("_p", "$.evidence")), "contexts": F.get_json_object("_p", "$.contexts"), "extra": rest(F.col("_p"))})
    return out.drop("_p", "_summary", "_action", "_causality", "_outcome")


def event_items(rows: DataFrame, column: str = "payload") -> DataFrame:
    """One row (``item``, ``event_index``) for each event of an answer: under ``events``, a list, or the object itself; those without any text are dropped."""
    answer = F.col(column)
    many = F.coalesce(F.get_json_object(answer, "$.events"), F.when(F.ltrim(answer).startswith("["), answer), F.get_json_object(answer, "$.event"), answer)
    items = rows.select("*", F.posexplode(_list(many)).alias("event_index", "item"))
    some = F.coalesce(*[pick(F.col("item"), k) for k in ("summary", "action", "causality")])
    return items.filter(_is_object(F.col("item")) & some.isNotNull())


def signature(summary="summary", action="action", causality="causality") -> Column:
    """What tells two payloads apart: their trimmed texts; '' if all are blank."""
    parts = [F.trim(text(x)) for x in (summary, action, causality)]
    return F.when(F.concat(*parts) != "", F.concat_ws("|", *parts)).otherwise("")


def orphan_contexts(rows: DataFrame, column: str = "payload") -> DataFrame:
    """One row (``context_index``, ``context``, JSON) for each object of an answer's ``orphan_contexts``; what is no list or no object is left out."""
    given = F.get_json_object(F.col(column), "$.orphan_contexts")
    listed = F.when(F.ltrim(text(given)).startswith("["), given)
    items = rows.select("*", F.posexplode(_list(listed)).alias("context_index", "context"))
    return items.filter(_is_object(F.col("context")))
