"""Background contexts: reuse gate, conflicts, merging and ageing.

Drafts and candidates are compared within their subtype; candidate pools are
the newest few of a subtype, as ranked tables, so joins stay bounded per draft.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import clamp, context_key, cosine, temporal_compatibility
from ..functions.text import context_description, current_intent, evidence_matches, labelled_card, negation_conflict, normalized, overlap, text, valid_draft
from ..plans.model import context_subtype
from ..sources.shared import fresh_dir, written
from .near import similar

REUSE_LIMIT, REUSE_SCORE, MIN_SUMMARY, MIN_EVIDENCE = 8, 0.72, 0.65, 0.40
REUSE_WEIGHTS = {"summary": 0.45, "evidence": 0.25, "entity": 0.15, "temporal": 0.10, "subtype": 0.05}
CONFLICT, REUSE_THRESHOLD = 0.72, 0.50
REINFORCEMENT, DECAY, STALE = 0.06, 0.04, 2592000
#: Contexts of one summary that one window orders.
CROWD = 10_000


def card(prefix: str) -> Column:
    c = lambda n: F.col(f"{prefix}.{n}")
    return labelled_card(c("subject"), c("condition"), c("facts"), c("applies_when"), c("summary"), c("description"))


def valid_drafts(drafts: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """Drafts that hold up: a good summary, grounded in the record's text, no passing intent; then one per subtype and summary.

    Columns used: pos, record_text and a context's text fields. The first by
    ``pos`` of each key stays, or ``within`` an event or record.
    """
    kept = drafts.filter(valid_draft() & ~current_intent() & evidence_matches(F.when(text("evidence_span") != "", text("evidence_span")).otherwise(text("summary")), "record_text"))
    condition = F.when(text("condition") != "", text("condition")).otherwise(text("summary"))
    kept = kept.withColumns({"subtype": context_subtype("subtype"), "condition": condition, "confidence": clamp(F.coalesce("confidence", F.lit(0.0)))})
    kept = kept.withColumn("description", context_description("condition", "facts", "applies_when", F.when(text("description") != "", text("description")).otherwise(text("evidence_span"))))
    first = F.row_number().over(Window.partitionBy(*within, "subtype", "summary").orderBy("pos"))
    return kept.withColumn("_r", first).filter("_r = 1").drop("_r")


def evidence_overlap(evidence: Column, candidate_text: Column) -> Column:
    """1 if the evidence stands in the text, else their overlap; 0 without evidence."""
    e = normalized(evidence)
    return F.when(F.trim(evidence) == "", F.lit(0.0)).when((e != "") & F.contains(normalized(candidate_text), e), F.lit(1.0)).otherwise(overlap(candidate_text, evidence))


def entity_overlap(labels: Column, candidate_text: Column) -> Column:
    """Share of an event's participants that a context mentions; 1 if it mentions none, or there are none."""
    said = normalized(candidate_text)
    hits = F.size(F.filter(F.array_distinct(labels), lambda p: F.contains(said, normalized(p))))
    n = F.size(F.array_distinct(labels))
    return F.when((n <= 0) | (said == "") | (hits == 0), F.lit(1.0)).otherwise(hits / F.greatest(n, F.lit(1)))


def hard_reject(c: str, d: str, require_evidence: bool = True) -> Column:
    """Why a context must not be reused: inactive, another subtype, too little overlap, negation, ungrounded evidence."""
    col = lambda p, n: F.col(f"{p}.{n}")
    left = F.concat_ws(" ", text(col(c, "summary")), card(c))
    right = F.concat_ws(" ", text(col(d, "summary")), card(d), text(col(d, "evidence_span")))
    out = (text(col(c, "status")) != "active") | (col(c, "subtype") != col(d, "subtype")) | (overlap(col(c, "summary"), col(d, "summary")) < MIN_SUMMARY) | negation_conflict(left, right, MIN_SUMMARY)
    if require_evidence:
        e, said = F.trim(text(col(d, "evidence_span"))), text(col(d, "event_text"))
        grounded = (said == "") | F.contains(normalized(said), normalized(e)) | (overlap(e, said) >= MIN_EVIDENCE)
        out = out | (e == "") | ~grounded | (evidence_overlap(e, candidate_text(c)) < MIN_EVIDENCE)
    return out


def candidate_text(c: str) -> Column:
    col = lambda n: F.col(f"{c}.{n}")
    return F.concat_ws(" ", text(col("summary")), text(col("description")), card(c))


def reuse_score(c: str, d: str) -> Column:
    """Weighted mean of summary, evidence, entity, temporal and subtype agreement; 0 if rejected."""
    col = lambda p, n: F.col(f"{p}.{n}")
    w = REUSE_WEIGHTS
    parts = (
        w["summary"] * overlap(col(c, "summary"), col(d, "summary"))
        + w["evidence"] * evidence_overlap(text(col(d, "evidence_span")), candidate_text(c))
        + w["entity"] * entity_overlap(col(d, "participants"), candidate_text(c))
        + w["temporal"] * temporal_compatibility(col(c, "valid_from"), col(c, "valid_to"), col(d, "valid_from"), col(d, "valid_to"))
        + w["subtype"] * (col(c, "subtype") == col(d, "subtype")).cast("double")
    )
    return F.when(hard_reject(c, d), F.lit(0.0)).otherwise(clamp(parts / sum(w.values())))


def rank_key(p: str) -> Column:
    c = lambda n: F.col(f"{p}.{n}")
    return F.struct(F.coalesce(c("support_count"), F.lit(1)).alias("s"), (F.trim(text(c("description"))) != "").cast("int").alias("d"), F.coalesce(c("last_seen_at"), c("updated_at"), F.lit(0)).alias("l"), F.coalesce(c("created_at"), F.lit(0)).alias("c"), c("id").alias("i"))


def match_existing(drafts: DataFrame, contexts: DataFrame, threshold: float = REUSE_SCORE) -> DataFrame:
    """(draft_id, context_id, how, score): the context each draft reuses; drafts without one are left out.

    An exact normalised summary wins if any such context survives the gate
    (the best ranked one); if exact ones exist but none does, nothing matches.
    Else the best of the newest few of the subtype, if it reaches the threshold.
    """
    c = contexts.select(F.struct(*[F.col(x) for x in contexts.columns]).alias("c"))
    d = drafts.select("draft_id", F.struct(*[F.col(x) for x in drafts.columns]).alias("d"))
    keyed = c.filter("c.status = 'active'").withColumn("key", normalized("c.summary"))
    exact = d.withColumn("key", normalized("d.summary")).join(keyed, "key")
    exact = exact.groupBy("draft_id").agg(F.max(F.when(~hard_reject("c", "d"), F.struct(rank_key("c").alias("k"), F.col("c.id").alias("id")))).alias("best"))
    newest = F.row_number().over(Window.partitionBy("c.subtype").orderBy(F.desc("c.last_seen_at"), "c.id"))
    pool = c.filter("c.status = 'active'").withColumn("_r", newest).filter(F.col("_r") <= REUSE_LIMIT).withColumn("subtype", F.col("c.subtype"))
    scored = d.join(exact.select("draft_id"), "draft_id", "left_anti").withColumn("subtype", F.col("d.subtype")).join(F.broadcast(pool), "subtype").withColumn("score", reuse_score("c", "d"))
    best = scored.groupBy("draft_id").agg(F.max(F.struct("score", (-F.col("_r")).alias("r"), F.col("c.id").alias("id"))).alias("best")).filter(F.col("best.score") >= threshold)
    return exact.filter("best is not null").select("draft_id", F.col("best.id").alias("context_id"), F.lit("exact").alias("how"), F.lit(1.0).alias("score")).unionByName(best.select("draft_id", F.col("best.id").alias("context_id"), F.lit("score").alias("how"), F.col("best.score").alias("score")))


def conflict_ratio(a: str, b: str) -> Column:
    """0 if they agree or nothing can be said; else 1 - agreement."""
    col = lambda p, n: F.col(f"{p}.{n}")
    summaries, described = overlap(col(a, "summary"), col(b, "summary")), (F.trim(text(col(a, "description"))) != "") & (F.trim(text(col(b, "description"))) != "")
    agreement = F.greatest(summaries, overlap(col(a, "description"), col(b, "description")), cosine(col(a, "embedding"), col(b, "embedding")))
    return F.when((summaries >= 0.6) | ~described | (agreement >= REUSE_THRESHOLD), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1.0 - agreement))


def similarity(a: str, b: str) -> Column:
    """Of two contexts: cosine, 1 for equal summaries, a bonus for one subtype, less if inactive."""
    col = lambda p, n: F.col(f"{p}.{n}")
    same = normalized(col(a, "summary")) == normalized(col(b, "summary"))
    base = F.when(same, F.lit(1.0)).otherwise(cosine(col(a, "embedding"), col(b, "embedding")))
    alive = (text(col(a, "status")) == "active") & (text(col(b, "status")) == "active")
    return clamp(F.when(alive, base).otherwise(0.85 * base) + F.when(col(a, "subtype") == col(b, "subtype"), 0.05).otherwise(0.0))


def merge_candidates(contexts: DataFrame, threshold: float = 0.58, blocks: Column | str = "context_type") -> DataFrame:
    """(canonical_id, merged_id, score) of pairs of active contexts within a block that do not conflict.

    ``blocks`` keys what is compared; give a finer key (subtype, cluster) for
    large tables: pairs grow with the square of a block.
    """
    c = contexts.filter("status = 'active'").withColumn("_b", F.col(blocks) if isinstance(blocks, str) else blocks)
    side = lambda n: c.select("_b", F.struct(*[F.col(x) for x in contexts.columns]).alias(n))
    return _judged(side("a").join(side("b"), "_b").filter(F.col("a.id") < F.col("b.id")), threshold)


def _judged(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) that do not conflict and are similar enough, the better ranked one canonical."""
    pairs = pairs.filter(conflict_ratio("a", "b") < min(0.95, CONFLICT + 0.20)).withColumn("score", similarity("a", "b")).filter(F.col("score") >= max(REUSE_THRESHOLD, threshold))
    first = rank_key("a") >= rank_key("b")
    return pairs.select(F.when(first, F.col("a.id")).otherwise(F.col("b.id")).alias("canonical_id"), F.when(first, F.col("b.id")).otherwise(F.col("a.id")).alias("merged_id"), F.round("score", 4).alias("score"))


def near_merge_candidates(contexts: DataFrame, threshold: float = 0.58, top_k: int = 8) -> DataFrame:
    """Like ``merge_candidates`` over a whole table, without a block: each active context meets the ``top_k`` of the
    nearest vectors (see ``near.similar``), and those of one normalised summary meet the next in order of id."""
    alive = contexts.filter("status = 'active'")
    gate = max(REUSE_THRESHOLD, threshold)
    at = F.coalesce("last_seen_at", F.lit(0))
    # one subtype gives a bonus, so the vectors alone may be that much less alike
    near = similar(alive.select("id", F.col("embedding").alias("v"), at.alias("at")), gate - 0.05, top_k).select(F.least("query_id", "id").alias("a_id"), F.greatest("query_id", "id").alias("b_id"))
    said = alive.select("id", normalized("summary").alias("key")).filter("key <> ''")
    crowds = said.groupBy("key").agg(F.ceil(F.count("*") / CROWD).alias("n")).filter("n > 1")
    # a crowded summary is cut into parts, so none of its windows is large
    part = said.join(crowds, "key", "left").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("n", F.lit(1))))
    same = part.select(F.col("id").alias("a_id"), F.lead("id").over(Window.partitionBy("key", "part").orderBy("id")).alias("b_id")).filter("b_id is not null")
    ids = near.unionByName(same).distinct()
    side = lambda n: alive.select(F.col("id").alias(f"{n}_id"), F.struct(*[F.col(x) for x in contexts.columns]).alias(n))
    return _judged(ids.join(side("a"), "a_id").join(side("b"), "b_id"), threshold)


def disjoint_plan(pairs: DataFrame, max_pairs: int | None = None, rounds: int | None = None, by_id: bool = False) -> DataFrame:
    """Greedy matching, best score first: each id in one pair at most.

    A pair that is the best of both its ids is what greedy takes first, so
    rounds of mutual bests give the greedy result without a serial loop. Equal
    scores are ordered by a hash of the pair, which keeps the rounds few among
    copies; where scores fall along a chain, each round settles one of its pairs.
    With ``by_id`` they are ordered by canonical and merged id instead.
    It ends when no pair is left; ``rounds`` bounds it, and pairs left then are
    an error.
    """
    spark = pairs.sparkSession
    left = written(pairs.select("canonical_id", "merged_id", "score"), "open-pairs")
    order = F.struct((-F.col("score")).alias("s"), (F.lit(0).cast("long") if by_id else F.xxhash64("canonical_id", "merged_id")).alias("h"), F.col("canonical_id").alias("c"), F.col("merged_id").alias("m"))
    plan, taken = left.limit(0), []
    while not left.isEmpty():
        if rounds is not None and len(taken) >= rounds:
            raise RuntimeError(f"pairs are left after {rounds} rounds")
        ends = left.select(F.col("canonical_id").alias("id"), order.alias("o")).union(left.select("merged_id", order))
        best = ends.groupBy("id").agg(F.min("o").alias("o"))
        mine = left.withColumn("o", order)
        won = mine.join(best.select(F.col("id").alias("canonical_id"), F.col("o").alias("o1")), "canonical_id").join(best.select(F.col("id").alias("merged_id"), F.col("o").alias("o2")), "merged_id").filter("o = o1 and o = o2").select("canonical_id", "merged_id", "score")
        taken.append(fresh_dir(spark, "won-pairs"))
        won.write.parquet(taken[-1])
        won = spark.read.schema(left.schema).parquet(taken[-1])
        if won.isEmpty():
            raise RuntimeError("pairs without an id cannot be settled")
        used = won.select(F.col("canonical_id").alias("id")).union(won.select("merged_id"))
        left = written(left.join(used.withColumnRenamed("id", "canonical_id"), "canonical_id", "left_anti").join(used.withColumnRenamed("id", "merged_id"), "merged_id", "left_anti").select("canonical_id", "merged_id", "score"), "open-pairs")
    if taken:
        plan = spark.read.schema(left.schema).parquet(*taken)
    return plan if max_pairs is None else plan.orderBy(F.desc("score"), "canonical_id", "merged_id").limit(max_pairs)


def longer(a: Column, b: Column) -> Column:
    return F.when(F.length(text(b)) > F.length(text(a)), b).otherwise(a)


def created(drafts: DataFrame, now: int) -> DataFrame:
    """New contexts of drafts, with repeatable ids."""
    at = F.coalesce(F.when(F.col("valid_from") != 0, F.col("valid_from")), F.lit(now))
    return drafts.withColumns({"id": context_key("subtype", "summary"), "context_type": F.lit("context"), "support_count": F.lit(1), "created_at": at, "updated_at": at, "last_seen_at": at, "status": F.lit("active")})


def edges_for(matches: DataFrame, contexts: DataFrame) -> DataFrame:
    """IN_REL edges of (event_id, context_id): confidence within [0.3, 1], weight 1 + ln(1 + support) within [0.1, 5]."""
    c = contexts.select(F.col("id").alias("context_id"), F.col("confidence").alias("c"), F.col("support_count").alias("s"))
    return matches.join(c, "context_id").withColumns({"confidence": clamp(F.col("c"), 0.3, 1.0), "weight": clamp(1.0 + F.log1p(F.col("s").cast("double")), 0.1, 5.0)}).drop("c", "s")


def decayed(contexts: DataFrame, now: int) -> DataFrame:
    """Unseen for long: confidence one step down, deprecated below 0.25. ``changed`` marks the rows."""
    stale = (F.coalesce("last_seen_at", F.lit(0)) == 0) | (F.col("last_seen_at") < now - STALE)
    lower = F.greatest(F.lit(0.0), F.col("confidence") - DECAY)
    gone = stale & (lower < 0.25)
    return contexts.withColumns(
        {
            "changed": stale & (F.abs(F.col("confidence") - lower) > 1e-6),
            "status": F.when(gone, "deprecated").otherwise(F.col("status")),
            "valid_to": F.when(gone & (F.coalesce("valid_to", F.lit(0)) == 0), F.lit(now)).otherwise(F.col("valid_to")),
            "confidence": F.when(stale, lower).otherwise(F.col("confidence")),
            "updated_at": F.when(stale, F.lit(now)).otherwise(F.col("updated_at")),
        }
    )


def weakened(contexts: DataFrame, now: int) -> DataFrame:
    """One step down for each given context but merged ones: weakened, or deprecated below 0.25."""
    lower, alive = F.greatest(F.lit(0.0), F.col("confidence") - DECAY), F.col("status") != "merged"
    return contexts.withColumns({"status": F.when(alive & (lower < 0.25), "deprecated").when(alive, "weakened").otherwise(F.col("status")), "valid_to": F.when(alive & (lower < 0.25) & (F.coalesce("valid_to", F.lit(0)) == 0), F.lit(now)).otherwise(F.col("valid_to")), "confidence": F.when(alive, lower).otherwise(F.col("confidence")), "updated_at": F.when(alive, F.lit(now)).otherwise(F.col("updated_at"))})




def source_refs(source: str, evidence: Column, signal: Column, event_id: Column, at: Column) -> Column:
    """A list of one reference to where a context comes from; the event's fields only if there is one."""
    own = F.create_map(F.lit("source"), F.lit(source), F.lit("evidence_span"), text(evidence), F.lit("signal"), text(signal))
    event = F.create_map(F.lit("event_id"), event_id, F.lit("timestamp"), text(at))
    return F.array(F.when(event_id.isNotNull(), F.map_concat(own, event)).otherwise(own))


def united(a: Column, b: Column) -> Column:
    """Two lists of references in order, each reference once; null if both are. Maps have no equality in Spark, so
    entries sorted by key, as JSON, tell equal ones."""
    none = F.expr("cast(array() as array<map<string,string>>)")
    tagged = F.transform(F.concat(F.coalesce(a, none), F.coalesce(b, none)), lambda r: F.struct(F.to_json(F.array_sort(F.map_entries(r))).alias("k"), r.alias("r")))
    once = F.filter(tagged, lambda x, i: F.array_position(F.transform(tagged, lambda y: F.coalesce(y["k"], F.lit(""))), F.coalesce(x["k"], F.lit(""))) == i + 1)
    return F.when(a.isNotNull() | b.isNotNull(), F.transform(once, lambda x: x["r"]))


def apply_merges(contexts: DataFrame, plan: DataFrame, now: int) -> DataFrame:
    """Contexts after a disjoint plan: the canonical one takes the longer texts, missing facts, the support and the
    lineage; the merged one is marked and ends."""
    has = set(contexts.columns)
    fields = [c for c in ("id", "summary", "description", "subject", "condition", "applies_when", "facts", "support_count", "confidence", "last_seen_at", "source_refs", "merged_from") if c in has]
    source = contexts.select(F.col("id").alias("merged_id"), F.struct(*[F.col(c) for c in fields]).alias("m"))
    taken = plan.select("canonical_id", "merged_id").join(source, "merged_id").select(F.col("canonical_id").alias("id"), "m")
    gone = plan.select(F.col("merged_id").alias("id"), F.lit(True).alias("gone"))
    out = contexts.join(taken, "id", "left").join(gone, "id", "left")
    hit, m = F.col("m").isNotNull(), lambda c: F.col(f"m.{c}")
    none = F.expr("cast(array() as array<string>)")
    empty = F.expr("map()").cast("map<string,string>")
    summary = longer(F.trim(text("summary")), F.trim(text("m.summary")))
    changes = {
        "summary": F.substring(F.when(summary != "", summary).otherwise(F.col("subtype")), 1, 128),
        "description": longer(F.col("description"), m("description")) if "description" in has else None,
        "subject": F.when(text("subject") != "", F.col("subject")).otherwise(m("subject")) if "subject" in has else None,
        "condition": longer(F.col("condition"), m("condition")) if "condition" in has else None,
        "applies_when": longer(F.col("applies_when"), m("applies_when")) if "applies_when" in has else None,
        "facts": F.map_zip_with(F.coalesce("facts", empty), F.coalesce(m("facts"), empty), lambda k, x, y: F.coalesce(F.when(x != "", x), y)) if "facts" in has else None,
        "support_count": F.col("support_count") + F.greatest(F.lit(1), m("support_count")),
        "confidence": F.least(F.lit(1.0), F.greatest("confidence", m("confidence")) + 0.03),
        "last_seen_at": F.greatest("last_seen_at", m("last_seen_at"), F.lit(now)),
        "source_refs": united(F.col("source_refs"), m("source_refs")) if "source_refs" in has else None,
        "merged_from": F.array_sort(F.array_union(F.coalesce("merged_from", none), F.array_union(F.array(m("id")), F.coalesce(m("merged_from"), none)))) if "merged_from" in has else None,
    }
    closed = F.col("gone").isNotNull()
    ends = {"status": F.when(closed, "merged").otherwise(F.col("status")), "valid_to": F.when(closed, F.lit(now)).otherwise(F.col("valid_to")), "updated_at": F.when(closed | hit, F.lit(now)).otherwise(F.col("updated_at"))}
    pick = lambda c: F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if changes.get(c) is not None else (ends[c].alias(c) if c in ends else F.col(c))
    return out.select(*[pick(c) for c in contexts.columns])
