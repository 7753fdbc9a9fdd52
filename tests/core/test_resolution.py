import random

import pytest
from pyspark.sql import functions as F

from mnemoframe.functions import measures, plain, text
from mnemoframe.memory import Memory
from mnemoframe.operators import contexts, resolution
from mnemoframe.plans.model import SCHEMAS, conform

PIECES = ["rain", "Rain,", "in the", "city", "never", "snow", "不要", "音乐", "安静的音乐", "a/b", "port 80", " ", "  x", "。", "No", "Straße", "_z9", "\t"]


def phrases(n, seed=1):
    rng = random.Random(seed)
    return [rng.choice(["", " "]).join(rng.choice(PIECES) for _ in range(rng.randint(0, 5))) for _ in range(n)]


def test_plain_comparisons_equal_the_expressions(spark):
    a, b = phrases(300), phrases(300, 2)
    b[:60] = [x[: len(x) // 2] for x in a[:60]]
    facts = [{"k": x} if i % 3 else {} for i, x in enumerate(b)]
    rows = spark.createDataFrame([(i, x, y, f) for i, (x, y, f) in enumerate(zip(a, b, facts, strict=True))], "i int, a string, b string, f map<string,string>")
    got = rows.select("i", text.normalized("a").alias("n"), text.overlap("a", "b").alias("o"), text.contains_negation("a").alias("g"), contexts.evidence_overlap(F.col("a"), F.col("b")).alias("e"), text.labelled_card("a", "b", "f", "a", "b", "a").alias("c"), text.context_description("a", "f", "b", "b").alias("d"), measures.temporal_compatibility(F.col("i"), F.col("i") * 2, F.lit(100), F.lit(50)).alias("t")).collect()
    for r in got:
        x, y, f = a[r.i], b[r.i], facts[r.i]
        assert (r.n, r.o, r.g, r.e) == (plain.normalized(x), pytest.approx(plain.overlap(x, y)), plain.negated(x), pytest.approx(plain.evidence_overlap(x, y))), (x, y)
        card = plain.card({"subject": x, "condition": y, "facts": f, "applies_when": x, "summary": y, "description": x})
        assert (r.c, r.d, r.t) == (card, plain.description(x, f, y, y), pytest.approx(plain.temporal_compatibility(r.i, r.i * 2, 100, 50)))


def test_scores_equal_the_expressions(spark):
    rng, words = random.Random(3), ["rain", "in", "the", "city", "not", "today", "park"]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = []
    for i in range(200):
        c = {"id": f"c{i}", "status": rng.choice(["active", "active", "merged"]), "subtype": "situation", "summary": some(4), "description": some(3), "subject": some(1), "condition": "", "facts": {}, "applies_when": "", "valid_from": rng.choice([0, 5, 10**8]), "valid_to": None, "source_refs": None}
        d = {"subtype": "situation", "summary": c["summary"] if i % 3 == 0 else some(4), "description": "", "subject": "", "condition": "", "facts": {}, "applies_when": "", "valid_from": 10**7, "valid_to": None, "evidence_span": some(2), "event_text": rng.choice(["", some(6)]), "participants": rng.sample(words, rng.randint(0, 2))}
        rows.append((c, d))
    kinds = "id string, status string, subtype string, summary string, description string, subject string, condition string, facts map<string,string>, applies_when string, valid_from long, valid_to long, evidence_span string, event_text string, participants array<string>"
    df = spark.createDataFrame([({k: v for k, v in c.items() if k != "source_refs"}, d | {"id": c["id"]}) for c, d in rows], f"c struct<{kinds}>, d struct<{kinds}>")
    got = {r.id: r.s for r in df.select("c.id", contexts.reuse_score("c", "d").alias("s")).collect()}
    assert {c["id"]: pytest.approx(resolution.score(c, d)) for c, d in rows} == got and sum(s > 0 for s in got.values()) > 3


def serial(drafts, known, now, scope, limit=8):
    """One draft after the other over the whole list of contexts."""
    held, out = {c["id"]: c for c in known}, []
    here = lambda row: tuple(row[s] or "" for s in scope)
    for d in sorted(drafts, key=lambda d: (d["at"], d["event_id"], d["context_index"])):
        mine = [c for c in held.values() if here(c) == here(d) and c["status"] == "active"]
        same = [c for c in mine if plain.normalized(c["summary"]) == plain.normalized(d["summary"])]
        best = None
        if same:
            best = next((c for c in sorted(same, key=resolution._rank, reverse=True) if not resolution.rejected(c, d)), None)
        else:
            newest = sorted(mine, key=lambda c: (c["last_seen_at"] is None, -(c["last_seen_at"] or 0), c["id"]))[:limit]
            scored = [(resolution.score(c, d), -i, c["id"]) for i, c in enumerate(newest)]
            if scored and max(scored)[0] >= contexts.REUSE_SCORE:
                best = held[max(scored)[2]]
        if best is None:
            key = d["new_id"] if d["new_id"] not in held else f"{d['new_id']}_{d['draft_id']}"
            best = held[key] = resolution.new_context(d, now, key)
        else:
            resolution.strengthen(best, d, now)
        out.append((d["draft_id"], best["id"]))
    return held, sorted(out)


@pytest.mark.parametrize("round_drafts", [10**6, 120])
def test_bulk_equals_one_by_one(spark, round_drafts):
    rng = random.Random(7)
    places = ["city", "city park", "city centre", "old city centre", "village", "the village", "coast"]
    acts = ["rain falls in", "rain falls often in", "never rain in", "loud music near", "loud music near the"]
    people = ["Ann", "Bo"]

    def phrase():
        return f"{rng.choice(acts)} {rng.choice(places)}"

    drafts = []
    for i in range(500):
        s = phrase()
        drafts.append({"draft_id": f"d{i}", "event_id": f"e{i // 3}", "at": 1000 + i // 2 * 5, "context_index": i % 3, "subtype": rng.choice(["situation", "environment", None]), "summary": s, "description": "", "subject": rng.choice(["", "Ann"]), "condition": s, "facts": {rng.choice("ab"): rng.choice("xyz")}, "applies_when": rng.choice(["", "at night"]), "confidence": rng.random(), "evidence_span": rng.choice([s, s[:12], ""]), "participants": rng.sample(people, rng.randint(0, 2)), "event_text": rng.choice([s, "", "something else"]), "valid_from": 1000 + i, "valid_to": rng.choice([None, 5000 + i]), "source_refs": [{"signal": rng.choice(["p", "q"])}]})
    names = [f.name for f in spark.createDataFrame([], SCHEMAS["contexts"]).schema]
    known = [dict.fromkeys(names) | {"id": f"old{i}", "subtype": rng.choice(["situation", "environment"]), "summary": phrase(), "description": "", "subject": "Bo", "condition": "", "facts": {"a": ""}, "applies_when": "", "confidence": 0.5, "support_count": rng.choice([1, 4]), "last_seen_at": rng.choice([900, 901, None]), "created_at": 5, "status": rng.choice(["active", "active", "deprecated"])} for i in range(40)]
    df, base = spark.createDataFrame(drafts, resolution.DRAFT), spark.createDataFrame(known, SCHEMAS["contexts"])
    keys = {r.draft_id: r.k for r in df.withColumn("subtype", text.text("subtype")).select("draft_id", contexts.context_key("subtype", "summary").alias("k")).collect()}
    for d in drafts:
        d["subtype"], d["new_id"] = d["subtype"] or "", keys[d["draft_id"]]
    table, matches = resolution.resolve(df.repartition(7), base, 2000, round_drafts=round_drafts)
    got = sorted((r.draft_id, r.context_id) for r in matches.collect())
    held, want = serial(drafts, [dict(c, facts=dict(c["facts"])) for c in known], 2000, ("subtype",))
    assert got == want
    assert {m.how for m in matches.select("how").distinct().collect()} == {"exact", "score", "new"}
    rows = {r.id: r.asDict(recursive=True) for r in table.collect()}
    assert rows.keys() == held.keys()
    for i, c in held.items():
        for f in ("summary", "description", "condition", "facts", "support_count", "last_seen_at", "valid_from", "valid_to", "status", "source_refs", "subject"):
            assert rows[i][f] == c[f], (i, f)
        assert rows[i]["confidence"] == pytest.approx(c["confidence"])
    edges = resolution.edges_of(matches, table)
    assert edges.count() == len({(d["event_id"], dict(want)[d["draft_id"]]) for d in drafts}) and edges.filter("weight < 0.1 or weight > 5 or confidence < 0.3").isEmpty()


def test_evidence_folds_into_one_row(spark):
    c = conform(spark.createDataFrame([("a", "rain", 1, 0.5, "active"), ("b", "sun", 4, 0.5, "weakened")], "id string, summary string, support_count long, confidence double, status string"), "contexts")
    e = spark.createDataFrame([("a", "rain falls", 1.0, 7), ("a", "it rains and rains", 0.0, 9), ("nowhere", "x", 1.0, 1)], "context_id string, summary string, confidence double, valid_from long")
    got = {r.id: r for r in resolution.with_evidence(c, e, 5).collect()}
    assert len(got) == 2 and (got["a"].support_count, got["a"].summary, got["a"].last_seen_at, got["a"].valid_from) == (3, "it rains and rains", 9, 7)
    assert got["a"].confidence == pytest.approx((0.5 * 0.8 + 0.2 + 0.012) * 0.8 + 0.012) and (got["b"].support_count, got["b"].status) == (4, "weakened")
    assert resolution.with_evidence(c, e.limit(0), 5).count() == 2 and resolution.with_evidence(c.limit(0), e, 5).count() == 0


def test_nothing_to_resolve(spark):
    empty = spark.createDataFrame([], "id string, payload string")
    table, matches = resolution.resolve(resolution.drafts_of(empty), empty, 5)
    assert table.isEmpty() and matches.isEmpty()
    odd = spark.createDataFrame([("e", None), ("f", "no json"), ("g", '{"contexts": 5}'), ("h", '{"contexts": [1, "x", null, {}, {"summary": "  "}, {"summary": "{raw}"}]}'), (None, '{"contexts": [{"summary": "held"}]}')], "id string, payload string")
    assert [r.summary for r in resolution.drafts_of(odd).collect()] == ["held"]


def test_memory_makes_and_merges_contexts(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "root"))
    said = '{"contexts": [{"subtype": "limit", "summary": "road is closed", "confidence": 0.8}], "episode_text": "The road is closed."}'
    episodes = spark.createDataFrame([("p1", "The road is closed.", 100, said), ("p2", "Again the road is closed.", 200, said)], "id string, content string, timestamp long, payload string")
    extract = lambda rows: rows.selectExpr("*", "content as summary", "'' as action", "'' as causality", "0 as event_index")
    assert m.ingest(episodes, extract, now=300).count() == 2
    (c,) = m.table("contexts").collect()
    assert (c.subtype, c.summary, c.support_count, c.last_seen_at) == ("constraint", "road is closed", 2, 300) and m.table("in_rel").count() == 2
    assert m.ingest(episodes, extract, now=400).count() == 0 and m.table("contexts").first().support_count == 2
    twin = conform(spark.createDataFrame([("twin", "Road is closed", "environment", 9)], "id string, summary string, subtype string, last_seen_at long"), "contexts").selectExpr("* except(status, context_type, support_count)", "'active' as status", "'context' as context_type", "1L as support_count")
    m.write(twin, "context")
    m.consolidate(500)
    rows = {r.id: r for r in m.table("contexts").collect()}
    assert rows["twin"].status == "merged" and rows[c.id].support_count == 3 and rows[c.id].merged_from == ["twin"]
