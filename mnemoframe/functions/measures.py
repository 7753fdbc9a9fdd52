"""Similarities, scores, times and identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import col, text


def dot(a: Column | str, b: Column | str) -> Column:
    """Over the shorter of both lengths, in double precision."""
    x, y = col(a), col(b)
    n = F.least(F.size(x), F.size(y))
    parts = F.zip_with(F.slice(x, F.lit(1), n), F.slice(y, F.lit(1), n), lambda p, q: p.cast("double") * q.cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda s, p: s + p)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda s, p: s + p.cast("double") * p.cast("double")))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Clamped to [0, 1]; 0 for missing or zero vectors."""
    length = norm(a) * norm(b)
    return F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / length))).otherwise(F.lit(0.0))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def safe_div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def coerce_confidence(x: Column | str) -> Column:
    return clamp(F.coalesce(text(x).try_cast("double"), F.lit(0.0)))


def recency(age: Column, window: float) -> Column:
    """exp(-age / window), 1 for the future."""
    return F.exp(-F.greatest(age, F.lit(0)).cast("double") / F.lit(float(max(window, 1))))


def retrieval_score(similarity: Column, context: Column, age: Column, valid: Column, support: Column, rate: float = 1e-8, weights: tuple[float, float, float, float, float] = (0.45, 0.15, 0.20, 0.10, 0.10)) -> Column:
    """Weighted sum of event similarity, context match, recency exp(-rate * age), validity and support."""
    w = [F.lit(x) for x in weights]
    support_score = F.least(F.lit(1.0), F.log1p(F.greatest(F.coalesce(support, F.lit(1)), F.lit(0)).cast("double")) / F.log(F.lit(21.0)))
    return w[0] * similarity + w[1] * context + w[2] * F.exp(-F.lit(rate) * F.greatest(age, F.lit(0))) + w[3] * valid + w[4] * support_score


def merge_similarity(similarity: Column, gap: Column, window: int = 172800) -> Column:
    """Similarity with a bonus of up to 0.05 for closeness in time, at most 1."""
    return F.least(F.lit(1.0), similarity + proximity_bonus(gap, window))


def proximity_bonus(gap: Column, window: int = 172800) -> Column:
    return F.lit(0.05) * F.exp(-F.abs(gap).cast("double") / F.lit(float(max(window, 1))))


def merge_reason(gap: Column, window: int = 172800) -> Column:
    return F.concat_ws(",", F.lit("event_embedding_similarity"), F.when(proximity_bonus(gap, window) >= 0.02, F.lit("temporal_proximity")))


def temporal_compatibility(a_from: Column, a_to: Column, b_from: Column, b_to: Column, window: int = 2592000) -> Column:
    """Of two validity intervals: disjoint 0.35, an unknown start 0.7, else decaying with the starts' distance, 0.3 at least."""
    x, y = F.coalesce(a_from, F.lit(0)), F.coalesce(b_from, F.lit(0))
    apart = ((F.coalesce(a_to, F.lit(0)) != 0) & (y != 0) & (a_to < y)) | ((F.coalesce(b_to, F.lit(0)) != 0) & (x != 0) & (b_to < x))
    return F.when(apart, F.lit(0.35)).when((x == 0) | (y == 0), F.lit(0.7)).otherwise(F.greatest(F.lit(0.3), F.exp(-F.abs(x - y).cast("double") / F.lit(float(window)))))


def anchor_strength(kind: Column | str) -> Column:
    return F.when(col(kind) == "literal", 4).when(col(kind) == "entity", 3).when(col(kind).isin("context", "event"), 2).when(col(kind) == "lexical", 1).otherwise(0)


def time_bucket(seconds: Column | str) -> Column:
    """Part of the day of a unix time in the session's time zone; '' for none."""
    hour = F.hour(F.timestamp_seconds(col(seconds)))
    return F.when(F.coalesce(col(seconds), F.lit(0)) <= 0, "").when((hour >= 5) & (hour < 12), "morning").when((hour >= 12) & (hour < 18), "afternoon").when((hour >= 18) & (hour < 23), "evening").otherwise("night")


def guessed_bucket(x: Column | str) -> Column:
    """Part of the day that a text names; '' if none."""
    low = F.lower(text(x))
    return F.when(low.rlike(r"morning|上午|清晨|早上|\b\d{1,2}\s*am\b|\bam\b"), "morning").when(low.rlike(r"afternoon|下午|\b\d{1,2}\s*pm\b|\bpm\b"), "afternoon").when(low.rlike("evening|傍晚|晚上"), "evening").when(low.rlike("night|深夜|夜里"), "night").otherwise("")


def parse_time(x: Column | str) -> Column:
    """Unix seconds of digits, three plain formats or ISO 8601; 0 if none or not positive."""
    s = F.trim(text(x))
    at = lambda f: F.try_to_timestamp(s, F.lit(f))
    known = F.coalesce(at("yyyy-MM-dd HH:mm:ss"), at("yyyy-MM-dd HH:mm"), at("yyyy-MM-dd"), F.try_to_timestamp(s))
    seconds = F.when(s.rlike(r"^[0-9]+(\.[0-9]+)?$"), F.floor(s.try_cast("double")).cast("long")).otherwise(F.unix_seconds(known))
    return F.when(F.coalesce(seconds, F.lit(0)) > 0, seconds).otherwise(F.lit(0)).cast("long")


def strict_time(x: Column | str) -> Column:
    """Unix seconds of ``yyyy-MM-dd HH:mm:ss``; null otherwise."""
    return F.unix_seconds(F.try_to_timestamp(text(x), F.lit("yyyy-MM-dd HH:mm:ss")))


def time_range(start: Column | str, end: Column | str | None = None, label: Column | str | None = None, bucket: Column | str | None = None) -> Column:
    """struct(start, end, display_time_bucket): a missing end is the start; the bucket is guessed from the label."""
    a = parse_time(start)
    b = parse_time(end) if end is not None else F.lit(0).cast("long")
    given = text(bucket) if bucket is not None else F.lit("")
    guess = guessed_bucket(label) if label is not None else F.lit("")
    return F.struct(a.alias("start"), F.when((a > 0) & (b == 0), a).otherwise(b).alias("end"), F.when(given != "", given).otherwise(guess).alias("display_time_bucket"))


def duration_minutes(start: Column | str, end: Column | str, given: Column | str | None = None) -> Column:
    found = F.floor((strict_time(end) - strict_time(start)) / 60).cast("long")
    return found if given is None else F.coalesce(col(given).cast("long"), found)


def expired(seconds: Column | str, now: Column, ttl: int) -> Column:
    return now - col(seconds) > ttl


def hash_text(x: Column | str) -> Column:
    return F.sha2(text(x), 256)


def event_key(summary: Column | str, at: Column | str, episode: Column | str, index: Column | str) -> Column:
    """A repeatable identifier: hash prefix, time, and a hash of where the event came from."""
    origin = F.sha2(F.concat_ws("|", text(episode), text(index)), 256)
    return F.concat_ws("_", F.substring(hash_text(summary), 1, 20), text(at), F.substring(origin, 1, 6))


def context_key(subtype: Column | str, summary: Column | str) -> Column:
    return F.concat(F.lit("ctx_"), F.substring(F.sha2(F.concat_ws("|", F.lit("context"), text(subtype), text(summary)), 256), 1, 20))


def row_hash(rows: DataFrame, columns: list[str]) -> Column:
    """A hash of columns of any type; maps, which have no hash, by their JSON."""
    kinds = dict(rows.dtypes)
    return F.xxhash64(*[F.to_json(F.struct(c)) if "map<" in kinds[c] else F.col(c) for c in columns])
