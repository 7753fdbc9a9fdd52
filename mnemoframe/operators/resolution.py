"""Context resolution: drafts of events become contexts, reusing what is there.

Resolution depends on order: a draft may reuse a context that an earlier draft
of the same batch made or changed. So drafts are folded in order, scope by
scope: the rows of a scope (a subtype, or finer) pass through one task in time
order, scopes side by side. A fold streams; it holds the newest few contexts of
its scope and those that the drafts touch. Scopes of many drafts are cut into
rounds by time, so that what a round touches stays small, and each round's
contexts are written before the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import plain
from ..functions.text import context_description, joined, normalized, text
from ..plans.model import SCHEMAS, conform
from ..sources.shared import written
from . import contexts as C
from . import payloads

#: Drafts of large scopes in a round; a round's touched contexts are in memory, a few kilobytes each.
ROUND_DRAFTS = 200_000
ROWS = 1000

DRAFT = "draft_id string, event_id string, at long, context_index int, subtype string, summary string, description string, subject string, condition string, facts map<string,string>, applies_when string, confidence double, evidence_span string, participants array<string>, event_text string, valid_from long, valid_to long, source_refs array<map<string,string>>"
_MATCH = "draft_id string, event_id string, at long, context_id string, how string, score double, evidence_span string"
_MATCH_ARROW = pa.struct([("draft_id", pa.string()), ("event_id", pa.string()), ("at", pa.int64()), ("context_id", pa.string()), ("how", pa.string()), ("score", pa.float64()), ("evidence_span", pa.string())])


def _once(value: Column, name: str) -> Column:
    """Computed once a row: what follows a generator is not folded back into it."""
    return F.explode(F.array(value)).alias(name)


def drafts_of(events: DataFrame, payload: str = "payload") -> DataFrame:
    """Valid drafts (columns of DRAFT) of the ``contexts`` list in the events' payloads.

    Each object of the list is a draft; what is no object is left out. A draft
    without evidence rests on its summary; a missing or zero confidence is 0.6.
    Drafts that do not hold up (``contexts.valid_drafts``) go; of an event's
    drafts of one subtype and summary the first stays. Events without a list,
    or with null payloads, give none.
    """
    def held(c: str) -> Column:
        return F.col(c) if c in events.columns else F.lit(None)

    fields = F.from_json(payload, "episode_text string, content string, text string")
    at = F.coalesce(*[F.when(held(c).cast("long") != 0, held(c).cast("long")) for c in ("valid_from", "timestamp", "last_active")], F.lit(0))
    people = payloads.labels(payloads.participants(payloads.pick(F.col("payload"), "actor")))
    rows = events.select(F.col("id").alias("event_id"), at.alias("at"), *[text(held(c)).alias(c) for c in ("summary", "action", "causality")], F.col(payload).alias("payload"), _once(fields, "p"))
    said = joined("p.episode_text", "p.content", "p.text", "summary", "action", "causality")
    record = F.coalesce(*[F.when(F.trim(text(x)) != "", F.col(x)) for x in ("p.episode_text", "summary", "action")], F.lit(""))
    rows = rows.withColumn("listed", F.get_json_object("payload", "$.contexts")).filter(F.ltrim(text("listed")).startswith("["))
    rows = rows.select("event_id", "at", said.alias("event_text"), record.alias("record_text"), people.alias("participants"), "listed")
    items = rows.select("*", F.posexplode(F.from_json("listed", "array<string>")).alias("context_index", "item")).filter(F.ltrim(text("item")).startswith("{"))
    given = items.select("*", _once(F.from_json("item", "subtype string, summary string, condition string, description string, subject string, facts map<string,string>, applies_when string, confidence string, evidence_span string, valid_to string"), "i"))
    got = lambda *names: F.trim(text(F.coalesce(*[F.col(f"i.{n}") for n in names])))
    confidence = F.coalesce(F.col("i.confidence").try_cast("double"), F.lit(0.0))
    first = {
        "subtype": F.coalesce(F.when(text("i.subtype") != "", F.col("i.subtype")), F.lit("situation")), "summary": got("summary", "condition"), "description": got("description"), "subject": got("subject"),
        "condition": F.coalesce(F.when(got("condition", "summary") != "", got("condition", "summary")), got("summary", "condition")), "facts": F.coalesce("i.facts", F.expr("cast(map() as map<string,string>)")), "applies_when": got("applies_when"),
        "confidence": F.when(confidence == 0, 0.6).otherwise(confidence), "evidence_span": F.coalesce(F.when(got("evidence_span") != "", got("evidence_span")), got("summary", "condition")), "valid_to": F.col("i.valid_to").try_cast("long"),
    }
    own = ["event_id", "at", "context_index", "event_text", "record_text", "participants"]
    drafts = given.select(*own, _once(F.named_struct(*[x for n, c in first.items() for x in (F.lit(n), c)]), "d")).select(*own, "d.*")
    drafts = drafts.select(*[c for c in drafts.columns if c != "description"], _once(context_description("condition", "facts", "applies_when", "description"), "description"))
    drafts = drafts.withColumns({"draft_id": F.concat_ws("#", "event_id", "context_index"), "valid_from": F.col("at"), "pos": F.col("context_index")})
    good = C.valid_drafts(drafts, ("event_id",))
    refs = C.source_refs("event_payload_context", F.col("evidence_span"), F.lit("event_payload_context"), F.col("event_id"), F.col("at"))
    return as_drafts(good.withColumn("source_refs", refs))


def as_drafts(rows: DataFrame) -> DataFrame:
    """Exactly the columns of DRAFT; missing ones null."""
    return rows.select(*[(F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(DRAFT)])


def _plain(row: dict | None) -> dict | None:
    """Maps as dictionaries."""
    if row is None:
        return None
    out = dict(row)
    out["facts"] = dict(out.get("facts") or ())
    if out.get("source_refs") is not None:
        out["source_refs"] = [dict(r or ()) for r in out["source_refs"]]
    return out


def rejected(c: dict, d: dict) -> bool:
    """``contexts.hard_reject`` on plain rows."""
    alike = plain.overlap(c["summary"], d["summary"])
    if (c["status"] or "") != "active" or c["subtype"] != d["subtype"] or alike < C.MIN_SUMMARY:
        return True
    left, right = f"{c['summary'] or ''} {plain.card(c)}", f"{d['summary'] or ''} {plain.card(d)} {d['evidence_span'] or ''}"
    if plain.negated(left) != plain.negated(right) and plain.overlap(left, right) >= C.MIN_SUMMARY:
        return True
    e, said = (d["evidence_span"] or "").strip(" "), d["event_text"] or ""
    grounded = not said or plain.normalized(e) in plain.normalized(said) or plain.overlap(e, said) >= C.MIN_EVIDENCE
    return not e or not grounded or plain.evidence_overlap(e, _said(c)) < C.MIN_EVIDENCE


def _said(c: dict) -> str:
    return f"{c['summary'] or ''} {c['description'] or ''} {plain.card(c)}"


def score(c: dict, d: dict) -> float:
    """``contexts.reuse_score`` on plain rows; participants also count where the context's references name them."""
    if rejected(c, d):
        return 0.0
    w, refs = C.REUSE_WEIGHTS, " ".join(v or "" for r in c.get("source_refs") or () for v in r.values())
    people, said = set(d["participants"] or ()), plain.normalized(f"{_said(c)} {refs}" if refs else _said(c))
    hits = sum(plain.normalized(p) in said for p in people)
    named = 1.0 if not people or not said or not hits else hits / len(people)
    parts = w["summary"] * plain.overlap(c["summary"], d["summary"]) + w["evidence"] * plain.evidence_overlap(d["evidence_span"], _said(c)) + w["entity"] * named
    parts += w["temporal"] * plain.temporal_compatibility(c["valid_from"], c["valid_to"], d["valid_from"], d["valid_to"]) + w["subtype"]
    return max(0.0, min(1.0, parts / sum(w.values())))


def _rank(c: dict) -> tuple:
    return (c["support_count"] if c["support_count"] is not None else 1, bool((c["description"] or "").strip(" ")), next((x for x in (c["last_seen_at"], c["updated_at"]) if x is not None), 0), c["created_at"] or 0, c["id"])


def _recent(c: dict) -> tuple:
    return (c["last_seen_at"] is None, -(c["last_seen_at"] or 0), c["id"])


def _reference(r: dict) -> frozenset:
    return frozenset(r.items())


def strengthen(c: dict, d: dict, now: int, seen: set[frozenset] | None = None) -> None:
    """One piece of evidence: longest texts, missing facts and subject, references, support and confidence up.

    ``seen`` belongs to the context: the references it holds, so that a new one is not compared with each.
    """
    longer = lambda a, b: b if len(b or "") > len(a or "") else a
    c["summary"], c["description"] = longer(c["summary"], d["summary"]), longer(c["description"], d["description"])
    c["condition"], c["applies_when"] = longer(c["condition"], d["condition"]), longer(c["applies_when"], d["applies_when"])
    c["subject"] = c["subject"] or d["subject"]
    for k, v in (d["facts"] or {}).items():
        if k.strip() and v not in (None, "") and not c["facts"].get(k):
            c["facts"][k] = v
    c["description"] = plain.description(c["condition"], c["facts"], c["applies_when"], c["description"])
    at = max(d["valid_from"] or 0, now)
    c["support_count"] = (c["support_count"] or 0) + 1
    c["updated_at"] = c["last_seen_at"] = at
    c["valid_from"] = min(c["valid_from"] or at, d["valid_from"] or at)
    if d["valid_to"]:
        c["valid_to"] = max(c["valid_to"] or 0, d["valid_to"])
    seen = set() if seen is None else seen
    if not seen:
        seen.update(_reference(r) for r in c.get("source_refs") or ())
    for r in d.get("source_refs") or ():
        if (key := _reference(r)) not in seen:
            seen.add(key)
            c["source_refs"] = c.get("source_refs") or []
            c["source_refs"].append(r)
    c["confidence"] = min(1.0, (c["confidence"] or 0.0) * 0.8 + (d["confidence"] or 0.0) * 0.2 + C.REINFORCEMENT * 0.2)
    c["status"] = "active"


def new_context(d: dict, now: int, key: str) -> dict:
    at = d["valid_from"] or now
    kept = {k: d[k] for k in ("subtype", "summary", "description", "subject", "condition", "applies_when", "confidence", "valid_to", "source_refs")}
    if kept["source_refs"] is not None:
        kept["source_refs"] = list(kept["source_refs"])
    return kept | {"id": key, "context_type": "context", "facts": dict(d["facts"] or {}), "support_count": 1, "created_at": at, "updated_at": at, "last_seen_at": at, "valid_from": d["valid_from"], "status": "active", "merged_from": None, "embedding": None}


class Scope:
    """The contexts of one scope while its drafts pass in order."""

    def __init__(self, now: int, threshold: float, limit: int):
        self.now, self.threshold, self.limit = now, threshold, limit
        self.held: dict[str, dict] = {}
        self.refs: dict[str, set[frozenset]] = {}
        self.by_key: dict[str, set[str]] = {}
        self.pool: list[dict] = []
        self.touched: set[str] = set()

    def hold(self, c: dict) -> None:
        """A known context: all that share a key with a draft, and the newest few."""
        self.held[c["id"]] = c
        if c["status"] == "active":
            self.by_key.setdefault(plain.normalized(c["summary"]), set()).add(c["id"])
            self._newest(c)

    def _newest(self, c: dict) -> None:
        # times only grow, so a context that fell out and is not touched does not come back
        self.pool = sorted([x for x in self.pool if x["id"] != c["id"]] + [c], key=_recent)[: self.limit]

    def match(self, d: dict) -> tuple[dict | None, str, float]:
        same = self.by_key.get(plain.normalized(d["summary"]))
        if same:
            for c in sorted((self.held[i] for i in same), key=_rank, reverse=True):
                if not rejected(c, d):
                    return c, "exact", 1.0
            return None, "new", 0.0
        best, most = None, -1.0
        for c in self.pool:
            if (s := score(c, d)) > most:
                best, most = c, s
        return (best, "score", most) if most >= self.threshold else (None, "new", 0.0)

    def add(self, d: dict) -> dict:
        c, how, found = self.match(d)
        if c is None:
            c = new_context(d, self.now, d["new_id"])
            if c["id"] in self.held:  # the key of the same draft, seen before, whose context may not be reused
                c["id"] = f"{c['id']}_{d['draft_id']}"
            self.hold(c)
        else:
            before = plain.normalized(c["summary"])
            strengthen(c, d, self.now, self.refs.setdefault(c["id"], set()))
            if (after := plain.normalized(c["summary"])) != before:
                self.by_key[before].discard(c["id"])
                self.by_key.setdefault(after, set()).add(c["id"])
            self._newest(c)
        self.touched.add(c["id"])
        return {"draft_id": d["draft_id"], "event_id": d["event_id"], "at": d["at"], "context_id": c["id"], "how": how, "score": found, "evidence_span": d["evidence_span"]}


def _entries(c: dict) -> dict:
    """Back to what Arrow takes for maps."""
    out = dict(c)
    out["facts"] = list(c["facts"].items())
    if c.get("source_refs") is not None:
        out["source_refs"] = [list(r.items()) for r in c["source_refs"]]
    return out


def _dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of a key in one task. By a hash of the keys: sides of a union that were joined by the keys themselves
    would count as dealt already, and each of them may still be read in its own way."""
    return rows.repartition(F.xxhash64(*keys))


def _round(drafts: DataFrame, contexts: DataFrame, now: int, scope: tuple[str, ...], threshold: float, limit: int) -> DataFrame:
    """(c: a touched context) or (m: a draft's match), of one round."""
    d = drafts.withColumns({"key": normalized("summary"), "new_id": C.context_key("subtype", F.concat_ws("|", *[s for s in scope if s != "subtype"], "summary"))})
    # only contexts that a draft may meet: by key, the same new id, or among the newest few of a scope
    by_key = contexts.withColumn("key", normalized("summary")).join(d.select(*scope, "key").distinct(), [*scope, "key"], "left_semi").drop("key")
    by_id = contexts.join(d.select(F.col("new_id").alias("id")).distinct(), "id", "left_semi")
    # Spark keeps the newest ``limit`` of each task before it shuffles
    newest = F.row_number().over(Window.partitionBy(*scope).orderBy(F.col("last_seen_at").desc_nulls_last(), "id"))
    pool = contexts.filter("status = 'active'").join(d.select(*scope).distinct(), list(scope), "left_semi").withColumn("_r", newest).filter(F.col("_r") <= limit).drop("_r")
    parts = [x.select(*contexts.columns) for x in (by_key, by_id, pool)]
    known = parts[0].unionByName(parts[1]).unionByName(parts[2]).dropDuplicates(["id"])
    left = known.select(*[F.col(s).alias(f"s{i}") for i, s in enumerate(scope)], F.lit(0).alias("kind"), F.lit(0).cast("long").alias("at"), F.col("id").alias("by"), F.lit(0).alias("nth"), F.struct(*contexts.columns).alias("c"), F.lit(None).cast(d.select(F.struct("*").alias("x")).schema["x"].dataType).alias("d"))
    right = d.select(*[F.col(s).alias(f"s{i}") for i, s in enumerate(scope)], F.lit(1).alias("kind"), "at", F.col("event_id").alias("by"), F.col("context_index").alias("nth"), F.lit(None).cast(left.schema["c"].dataType).alias("c"), F.struct("*").alias("d"))
    keys = [f"s{i}" for i in range(len(scope))]
    rows = _dealt(left.unionByName(right), keys).sortWithinPartitions(*keys, "kind", "at", "by", "nth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, kind, matches = None, None, None, []

        def out(c: list[dict], m: list[dict]) -> pa.RecordBatch:
            n = len(c) + len(m)
            both = [pa.array([*map(_entries, c), *[None] * len(m)], kind), pa.array([*[None] * len(c), *m], _MATCH_ARROW)]
            return pa.RecordBatch.from_arrays(both, ["c", "m"]) if n else None

        def close() -> Iterator[pa.RecordBatch]:
            touched = [held.held[i] for i in sorted(held.touched)] if held else []
            for i in range(0, len(touched), ROWS):
                yield out(touched[i : i + ROWS], [])

        for batch in batches:
            kind = batch.schema.field("c").type
            for row in batch.to_pylist():
                if (here := tuple(row[k] for k in keys)) != at:
                    yield from close()
                    held, at = Scope(now, threshold, limit), here
                if row["kind"] == 0:
                    held.hold(_plain(row["c"]))
                else:
                    matches.append(held.add(_plain(row["d"])))
                if len(matches) >= ROWS:
                    yield out([], matches)
                    matches = []
        yield from close()
        if matches:
            yield out([], matches)

    return rows.mapInArrow(run, f"c struct<{SCHEMAS['contexts']}>, m struct<{_MATCH}>")


def resolve(drafts: DataFrame, contexts: DataFrame, now: int, scope: tuple[str, ...] = ("subtype",), threshold: float = C.REUSE_SCORE, limit: int = C.REUSE_LIMIT, round_drafts: int = ROUND_DRAFTS, changed_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """(contexts, matches): all contexts after the drafts (or those made or changed), and for each draft the context it made or reuses.

    Drafts (columns of DRAFT) count in order of (at, event_id, context_index).
    A draft reuses the best ranked active context of its scope with its
    normalised summary that passes the gate (if there are such contexts and none
    passes, it makes a new one); else the best scored of the newest ``limit`` of
    the scope, from ``threshold`` on; else it becomes a context. Reused contexts
    take up the draft as evidence before the next draft is looked at.

    ``scope`` names columns that contexts and drafts have, subtype among them;
    a finer one (subtype, subject) lets more tasks work side by side, and then
    only contexts of the same subject are reused. Null scopes are a scope of
    their own. Scopes of more than ``round_drafts`` drafts are resolved in rounds
    by time, so many that a round holds no more of theirs; others need none, as
    a task holds a scope at a time. Drafts of one second share a round.
    """
    if "subtype" not in scope:
        raise ValueError("a scope includes the subtype")
    spark, held = drafts.sparkSession, conform(contexts, "contexts")
    blank = lambda df: df.withColumns({s: text(s) for s in scope})
    drafts, held = written(blank(as_drafts(drafts)), "drafts"), blank(held)
    if drafts.isEmpty():
        return (held.limit(0) if changed_only else held), spark.createDataFrame([], _MATCH)
    large = drafts.join(drafts.groupBy(*scope).count().filter(F.col("count") > round_drafts), list(scope), "left_semi")
    rounds = max(1, -(-large.count() // round_drafts))
    cuts = large.agg(F.percentile_approx("at", [i / rounds for i in range(1, rounds)], 10 * rounds).alias("p")).first()["p"] if rounds > 1 else []
    edges = [None, *sorted(set(cuts or [])), None]
    found = []
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        some = drafts
        if low is not None:
            some = some.filter(F.col("at") > low)
        if high is not None:
            some = some.filter(F.col("at") <= high)
        step = written(_round(some, held, now, scope, threshold, limit), "resolved")
        found.append(step.filter("m is not null").select("m.*"))
        touched = step.filter("c is not null").select("c.*")
        held = held.join(touched.select("id"), "id", "left_anti").select(*touched.columns).unionByName(touched)
        if len(edges) > 2:
            held = written(held, "contexts-so-far")
    matches = found[0]
    for more in found[1:]:
        matches = matches.unionByName(more)
    return (held.join(matches.select(F.col("context_id").alias("id")).distinct(), "id", "left_semi") if changed_only else held), matches


def edges_of(matches: DataFrame, contexts: DataFrame) -> DataFrame:
    """IN_REL rows of the matches: one an event and context, with the last draft's evidence."""
    last = matches.groupBy("event_id", "context_id").agg(F.max(F.struct("at", "draft_id", "evidence_span")).alias("l"))
    rows = last.select("event_id", "context_id", F.lit("event_payload_context").alias("original_signal"), F.col("l.evidence_span").alias("evidence_span"), F.col("l.at").alias("created_at"), F.col("l.at").alias("updated_at"))
    return conform(C.edges_for(rows, contexts), "in_rel")


def with_evidence(contexts: DataFrame, evidence: DataFrame, now: int) -> DataFrame:
    """Contexts after their evidence (context_id and a draft's fields), one piece after the other.

    Pieces of one context count in order of (valid_from, summary, evidence_span).
    They stream through the context's task, none is collected; a context
    without evidence stays as it is, evidence of no context is left out.
    """
    columns, full = contexts.columns, conform(contexts, "contexts")
    known = full.select(F.col("id").alias("key"), F.lit(0).alias("kind"), F.struct(*full.columns).alias("c"))
    pieces = as_drafts(evidence.withColumn("draft_id", F.col("context_id"))).select(F.col("draft_id").alias("key"), F.lit(1).alias("kind"), F.struct("*").alias("d"))
    met = pieces.join(known.select("key"), "key", "left_semi")
    hit = known.join(pieces.select("key").distinct(), "key", "left_semi")
    rows = hit.withColumn("d", F.lit(None).cast(met.schema["d"].dataType)).unionByName(met.withColumn("c", F.lit(None).cast(known.schema["c"].dataType)))
    rows = _dealt(rows, ["key"]).sortWithinPartitions("key", "kind", "d.valid_from", "d.summary", "d.evidence_span")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, kind, done, seen = None, None, [], set()
        flat = lambda rows: pa.RecordBatch.from_arrays(pa.array(rows, kind).flatten(), [f.name for f in kind])
        for batch in batches:
            kind = batch.schema.field("c").type
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    done += [_entries(c)] if c is not None else []
                    c, seen = _plain(row["c"]), set()
                else:
                    strengthen(c, _plain(row["d"]), now, seen)
            if len(done) >= ROWS:
                yield flat(done)
                done = []
        if c is not None:
            yield flat([*done, _entries(c)])

    changed = rows.mapInArrow(run, SCHEMAS["contexts"])
    extra = [x for x in columns if x not in full.columns]
    if extra:
        changed = changed.join(contexts.select("id", *extra), "id")
    kept = contexts.join(pieces.select(F.col("key").alias("id")).distinct(), "id", "left_anti")
    types = dict(contexts.dtypes)
    return kept.select(*columns).unionByName(changed.select(*[F.col(x).cast(types[x]).alias(x) for x in columns]))
