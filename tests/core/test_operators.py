import json
import math

import pytest
from pyspark.sql import functions as F

from mnemoframe.operators import consolidation, contexts, entities, joins, mutations, recall, relations, resolution, reports, scans, search, task_recall
from mnemoframe.plans import model

EVENT = "id string, summary string, action string, causality string, timestamp long, last_active long, created_at long, valid_to long, status string, support_count long, embedding array<double>, payload string, parent_event_id string, thread_id string, session_id string, episode_id string"


def events(spark, *rows):
    base = dict(summary="", action="", causality="", timestamp=0, status="active", support_count=1, payload="{}", parent_event_id="", thread_id="", session_id="", episode_id="")
    full = []
    for r in rows:
        x = base | r
        x.setdefault("last_active", x["timestamp"])
        x.setdefault("created_at", x["timestamp"])
        full.append(tuple(x.get(f.split()[0]) for f in EVENT.split(", ")))
    return spark.createDataFrame(full, EVENT)


def states(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, timestamp long, entity string, attribute string, value_before string, value_after string")


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([("a", "x y y"), ("b", "x z"), ("c", "w")], "id string, text string")
    got = {r.id: r.score for r in search.bm25(docs, "y x y", None).collect()}
    n, avg = 3, 2.0
    idf = lambda df: math.log(1 + (n - df + 0.5) / (df + 0.5))
    part = lambda tf, df, length: idf(df) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avg))
    assert got == pytest.approx({"a": 2 * part(2, 1, 3) + part(1, 2, 3), "b": part(1, 2, 2)})
    assert search.bm25(docs, "", 5).count() == 0 and search.bm25(docs, "x", 0).count() == 0
    index = search.build_index(docs)
    assert {r.id: r.score for r in search.search_index(index, "y x y", None).collect()} == pytest.approx(got)
    index = search.add_to_index(index, spark.createDataFrame([("b", "q")], "id string, text string"))
    assert [r.id for r in search.search_index(index, "x q").collect()] == ["b", "a"]
    assert search.index_stats(search.remove_from_index(index, docs.filter("id = 'a'").select("id"))).first().n_docs == 2


def test_a_candidate_of_three_channels_appears_once(spark):
    e = events(spark, dict(id="q", timestamp=100, embedding=[1.0, 0.0]), dict(id="c", timestamp=99, embedding=[0.99, 0.01]), dict(id="far", timestamp=98, embedding=[0.0, 1.0]), dict(id="m", timestamp=97, status="merged", embedding=[1.0, 0.0]))
    involves = spark.createDataFrame([("q", "x"), ("c", "x")], "event_id string, entity_id string")
    found = {r.cand_id: r for r in recall.recall(e.filter("id = 'q'"), e, involves).collect()}
    assert set(found["c"].channels) == {"temporal", "entity", "semantic"} and found["c"].aggregate_score > 0.7 and found["c"].rank == 1
    assert "far" not in found and "m" not in found and "q" not in found


def test_state_change_supersedes_one_way(spark):
    s = states(spark, ("old", 100, "car", "temp", None, "20"), ("new", 110, "car", "temp", "20", "25"), ("same", 120, "car", "temp", "", "25"), ("other", 130, "car", "temp", "99", "30"))
    pairs = spark.createDataFrame([("new", "old"), ("old", "new"), ("other", "new")], "new_id string, old_id string")
    assert [(r.new_id, r.old_id, r.value_before, r.value_after) for r in relations.state_updates(pairs, s).collect()] == [("new", "old", "20", "25")]
    assert [(r.from_id, r.to_id) for r in relations.supersession_chain(s).collect()] == [("old", "new")]


def candidates(spark, *rows):
    return spark.createDataFrame([("q", c, ch, 1.0, a, 0) for c, ch, a in rows], "query_id string, cand_id string, channels map<string,double>, channel_score double, aggregate_score double, cand_at long")


def test_routes_and_budget(spark):
    e = events(spark, dict(id="q", parent_event_id="p"), dict(id="p"), dict(id="shared"), dict(id="ent"), dict(id="sem"), dict(id="weak"), dict(id="gone", status="archived"))
    in_rel = spark.createDataFrame([("q", "c1"), ("shared", "c1")], "event_id string, context_id string")
    c = candidates(spark, ("p", {"reference": 1.0}, 0.5), ("shared", {"semantic": 0.9}, 0.5), ("ent", {"entity": 1.0, "temporal": 1.0}, 0.5), ("sem", {"semantic": 0.9}, 0.5), ("weak", {"semantic": 0.5}, 0.5), ("gone", {"semantic": 0.9}, 0.5))
    routed = {r.cand_id: r.route for r in relations.split_candidates(c, e, states(spark), in_rel).collect()}
    assert routed == {"p": "rule", "shared": "shared_context", "ent": "entity_only", "sem": "judge", "weak": "below_gate", "gone": "inactive"}
    judge = lambda df: df.withColumns({"operation": F.lit("CO_RECALL"), "confidence": F.lit("0.8"), "direction": F.lit(""), "value_before": F.lit(""), "value_after": F.lit("")})
    done = relations.process(c, e, states(spark), in_rel, judge, max_links=1)
    assert {r.cand_id: r.status for r in done.collect()} == {"p": "executed", "sem": "relation_budget_exhausted"}
    edge = relations.edges_of(done, e, 5).first()
    assert (edge.from_id, edge.to_id, edge.relation_type, edge.updated_at) == ("p", "q", model.SHARED_CONTEXT, 5)
    assert relations.report(done).first().asDict() == {"updates": 0, "links": 1, "total_links": 1, "skipped": 1}
    five = spark.createDataFrame([("q", f"c{i}", "co_recall", 0.9) for i in range(5)], "query_id string, cand_id string, operation string, confidence double")
    assert relations.execute(five, 2).filter("status = 'executed'").count() == 2


CONTEXT = "id string, context_type string, subtype string, summary string, description string, subject string, condition string, facts map<string,string>, applies_when string, confidence double, support_count long, created_at long, updated_at long, valid_from long, valid_to long, last_seen_at long, status string, embedding array<double>"


def context_rows(spark, *rows):
    base = dict(context_type="context", subtype="situation", description="", subject="", condition="", facts=None, applies_when="", confidence=0.5, support_count=1, created_at=1, updated_at=1, valid_from=1, valid_to=None, last_seen_at=1, status="active", embedding=None)
    return spark.createDataFrame([tuple((base | r).get(f.split(" ")[0]) for f in CONTEXT.split(", ")) for r in rows], CONTEXT)


def test_context_reuse(spark):
    c = context_rows(spark, dict(id="a", summary="rain in the city"), dict(id="b", summary="Rain, in the city!", support_count=5), dict(id="w", summary="snow on the hills", status="weakened"), dict(id="n", summary="never rain in the city center today"))
    d = context_rows(spark, dict(id="d1", summary="rain in the city"), dict(id="d2", summary="snow on the hills"), dict(id="d3", summary="rain in the city center today")).withColumn("draft_id", F.col("id")).withColumns({"evidence_span": F.col("summary"), "event_text": F.col("summary"), "participants": F.expr("cast(array() as array<string>)")})
    got = {r.draft_id: (r.context_id, r.how) for r in contexts.match_existing(d, c).collect()}
    assert got["d1"] == ("a", "exact") and "d2" not in got and got.get("d3", ("", ""))[0] != "n"


def test_context_ageing_and_evidence(spark):
    c = context_rows(spark, dict(id="old", summary="s", confidence=0.27), dict(id="new", summary="s", last_seen_at=10**10, confidence=0.9), dict(id="mid", summary="s", confidence=0.9))
    got = {r.id: r for r in contexts.decayed(c, 10**7).collect()}
    assert (got["old"].status, got["old"].valid_to, got["old"].changed) == ("deprecated", 10**7, True)
    assert (got["new"].status, got["new"].changed) == ("active", False) and got["mid"].confidence == pytest.approx(0.86)
    e = spark.createDataFrame([("mid", "a longer summary", "", "", "", {"k": "v"}, 1.0, 5, None)], "context_id string, summary string, description string, condition string, applies_when string, facts map<string,string>, confidence double, valid_from long, valid_to long")
    up = {r.id: r for r in resolution.with_evidence(c, e, 99).collect()}["mid"]
    assert (up.summary, up.support_count, up.facts, up.last_seen_at) == ("a longer summary", 2, {"k": "v"}, 99) and up.confidence == pytest.approx(0.9 * 0.8 + 0.2 + 0.012)


def test_drafts(spark):
    rows = [(0, "limit", "road is closed", "", "road is closed", "The road is closed."), (1, "limit", "road is closed", "", "", "The road is closed."), (2, "x", "not there", "", "not there", "other"), (3, "x", "I want tea", "", "I want tea", "I want tea")]
    d = spark.createDataFrame(rows, "pos int, subtype string, summary string, description string, evidence_span string, record_text string").withColumns({"condition": F.lit(""), "applies_when": F.lit(""), "facts": F.lit(None).cast("map<string,string>"), "confidence": F.lit(2.0)})
    (got,) = contexts.valid_drafts(d).collect()
    assert (got.pos, got.subtype, got.confidence, got.condition) == (0, "constraint", 1.0, "road is closed")


def test_greedy_matching(spark):
    pairs = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.8), ("c", "d", 0.7), ("d", "e", 0.6), ("f", "g", 0.6)], "canonical_id string, merged_id string, score double")
    assert sorted((r.canonical_id, r.merged_id) for r in contexts.disjoint_plan(pairs).collect()) == [("a", "b"), ("c", "d"), ("f", "g")]


def test_merging_events(spark):
    e = events(spark, dict(id="a", summary="one", timestamp=10, embedding=[1.0, 0.0, 0.0], support_count=2, session_id="s"), dict(id="b", summary="two", action="go", timestamp=12, embedding=[0.99, 0.01, 0.0], session_id="s"), dict(id="c", summary="three", timestamp=11, embedding=[0.0, 1.0, 0.0], session_id="s"))
    plan = consolidation.merge_plan(e)
    (p,) = plan.collect()
    assert (p.canonical_id, p.merged_id, p.reason) == ("a", "b", "event_embedding_similarity,temporal_proximity") and p.score == 1.0
    after = {r.id: r for r in consolidation.apply_merges(e, plan, 50).collect()}
    assert (after["a"].summary, after["a"].action, after["a"].support_count, after["a"].last_active) == ("one；two", "go", 3, 12)
    assert (after["b"].status, after["b"].valid_to, after["c"].status) == ("merged", 50, "active")
    assert consolidation.reference_time(e).first().now == 12
    both = events(spark, *[dict(id=i, embedding=[1.0], support_count=2, session_id="s") for i in "ab"])
    assert consolidation.merge_plan(both).isEmpty()
    old = consolidation.archived(e, 10**8)
    assert {r.id: r.status for r in old.collect()} == {"a": "active", "b": "archived", "c": "archived"}


def test_upserts_and_edges(spark):
    t = spark.createDataFrame([(1, "a", 5), (2, "b", 5)], "id long, v string, created_at long")
    up = mutations.upsert(t, spark.createDataFrame([(2, "c", 9), (3, "d", 9)], t.schema), ["id"], keep=("created_at",))
    assert sorted(tuple(r) for r in up.collect()) == [(1, "a", 5), (2, "c", 5), (3, "d", 9)]
    assert mutations.upsert(up, spark.createDataFrame([(2, "c", 9)], t.schema), ["id"], keep=("created_at",)).exceptAll(up).isEmpty()
    assert mutations.insert_missing(t, up, ["id"]).count() == 3
    edges = spark.createDataFrame([("x", "y", 1), ("y", "z", 2), ("x", "z", 3)], "a string, b string, updated_at long")
    moved = mutations.relink(edges, spark.createDataFrame([("y", "x")], "id string, canonical string"), ["a", "b"], ["a", "b"])
    assert sorted(tuple(r) for r in moved.collect()) == [("x", "z", 3)]
    nodes, left = mutations.detach_delete(spark.createDataFrame([("x",), ("z",)], "id string"), spark.createDataFrame([("x",)], "id string"), {"e": (edges, ["a", "b"])})
    assert [r.id for r in nodes.collect()] == ["z"] and [tuple(r) for r in left["e"].collect()] == [("y", "z", 2)]
    rel = spark.createDataFrame([("a", "b", "t", 1, 1)], "from_id string, to_id string, relation_type string, created_at long, updated_at long")
    new = spark.createDataFrame([("a", "b", "t", 7, 7), ("a", "a", "t", 7, 7), ("a", "c", " ", 7, 7)], rel.schema)
    assert [tuple(r) for r in mutations.upsert_relations(rel, new).collect()] == [("a", "b", "t", 1, 7)]


def test_entity_registry(spark):
    e = spark.createDataFrame([("Ann", "person", False, "", ["A"], "active", None, 1, 1), ("Bob", "person", True, "x", None, "active", None, 1, 1)], "id string, type string, registered boolean, description string, aliases array<string>, status string, canonical_id string, created_at long, updated_at long")
    rows = spark.createDataFrame([("Ann", "", "an artist", ["Annie"]), ("Cy", "person", "new", None)], "id string, type string, description string, aliases array<string>")
    got = {r.id: r for r in mutations.register_entities(e, rows, 9).collect()}
    assert (got["Ann"].outcome, got["Ann"].aliases, got["Ann"].description) == ("promoted", ["A", "Annie"], "an artist") and got["Cy"].outcome == "created" and got["Bob"].outcome is None
    involves = spark.createDataFrame([("e1", "Ann", 5, 5, 2), ("e1", "Bob", 3, 8, 1), ("e2", "Ann", 4, 4, 1)], "event_id string, entity_id string, t_created long, t_valid long, c_valid long")
    pairs = spark.createDataFrame([("Ann", "Bob", "same", 0.9)], "merged_id string, canonical_id string, reason string, score double")
    table, edges, traces = mutations.merge_entities(e, involves, pairs, 20)
    merged = {r.id: r for r in table.collect()}
    assert (merged["Ann"].status, merged["Ann"].canonical_id, merged["Bob"].aliases) == ("merged", "Bob", ["A", "Ann"])
    assert sorted(tuple(r) for r in edges.collect()) == [("e1", "Bob", 3, 20, 2), ("e2", "Bob", 4, 20, 1)] and traces.count() == 1
    linked = mutations.count_links(involves, spark.createDataFrame([("e1", "Ann"), ("e3", "New")], "event_id string, entity_id string"), 30)
    assert {(r.event_id, r.entity_id): (r.t_created, r.t_valid, r.c_valid) for r in linked.collect()}[("e3", "New")] == (30, 30, 1)
    p = mutations.put_patterns(mutations.put_patterns(spark.createDataFrame([], model.SCHEMAS["patterns"]), spark.createDataFrame([("Ann", "v1")], "entity_id string, content string"), 1), spark.createDataFrame([("Ann", "v2")], "entity_id string, content string"), 2)
    assert [(r.content, r.created_at, r.updated_at) for r in p.collect()] == [("v2", 1, 2)] and mutations.delete_patterns(p).isEmpty()


def test_resolution(spark):
    e = spark.createDataFrame([("Bob", ["Bobby"], "person", True, [1.0, 0.0]), ("Rob", ["Bobby"], "person", True, [0.0, 1.0]), ("City", None, "place", True, [0.6, 0.8])], "id string, aliases array<string>, type string, registered boolean, description_embedding array<double>")
    m = spark.createDataFrame([("BOB", "x", None), ("bobby", "person", [0.9, 0.1]), ("guy", "person", [0.7, 0.7]), ("town", "place", [0.6, 0.8]), ("zz", "thing", [1.0, 0.0])], "name string, type string, embedding array<double>")
    got = {r.name: (r.id, r.reason) for r in entities.resolve(m, e).collect()}
    assert got == {"BOB": ("Bob", "exact_match"), "bobby": ("Bob", "vector_high"), "town": ("City", "vector_high")}
    asked = entities.resolve(m, e, lambda df: df.withColumn("decision", F.lit("yes")))
    assert {r.name for r in asked.collect()} == {"BOB", "bobby", "town", "guy"}


def test_delta_and_lists(spark):
    a = spark.createDataFrame([("1", "x", "active"), ("2", "x", "active"), ("3", "x", "active"), ("4", "x", "active")], "id string, v string, status string")
    b = spark.createDataFrame([("1", "x", "active"), ("2", "y", "active"), ("3", "x", "merged"), ("5", "x", "active")], "id string, v string, status string")
    assert {r.id: r.change for r in joins.graph_delta(a, b, ["id"]).collect()} == {"2": "updated", "3": "merged", "4": "removed", "5": "created"}
    e = events(spark, dict(id="a", summary="red fox", timestamp=1), dict(id="b", summary="blue", timestamp=2), dict(id="c", summary="red", timestamp=3, status="archived"))
    assert [r.id for r in scans.list_events(e, 5, "red fox").collect()] == ["a", "c"]
    assert [r.id for r in scans.list_events(e, 5, statuses=["active"]).collect()] == ["b", "a"]
    assert [r.id for r in scans.by_ids(e, ["c", "a", "c"]).collect()] == ["c", "a"]
    assert scans.active_with_vectors(e, 1).count() == 0
    chain = spark.createDataFrame([("A", "merged", "B"), ("B", "merged", "C"), ("C", "active", None)], "id string, status string, canonical_id string")
    assert {r.id: r.canonical for r in scans.canonical_ids(chain).collect()} == {"A": "B", "B": "C", "C": "C"}
    assert {r.id: r.canonical for r in scans.canonical_ids(chain, transitive=True, rounds=3).collect()} == {"A": "C", "B": "C", "C": "C"}


def memory(spark, relation=None):
    e = events(spark, dict(id="e1", summary="use port 8080 for API_HOST", timestamp=5), dict(id="e2", summary="use port 9090 for API_HOST", timestamp=9), dict(id="z", summary="unrelated", timestamp=1))
    c = context_rows(spark, dict(id="c1", summary="staging cluster", condition="staging cluster runs API_HOST", facts={"port": "8080"}))
    ent = spark.createDataFrame([("Gateway", "service", True, "the gateway", ["gw"], "active", None)], "id string, type string, registered boolean, description string, aliases array<string>, status string, canonical_id string")
    pat = spark.createDataFrame([("p", "Gateway", "## Gateway rules\n- restart gateway gently\n## Other\nno", 1, 2)], model.SCHEMAS["patterns"])
    inv = spark.createDataFrame([("e1", "Gateway")], "event_id string, entity_id string")
    rel = spark.createDataFrame([("e1", "e2", relation or "时序相邻", "", 7)], "from_id string, to_id string, relation_type string, operation string, updated_at long")
    return task_recall.Graph(e, c, ent, pat, inv, spark.createDataFrame([], "event_id string, context_id string"), rel)


def test_task_recall(spark):
    out = task_recall.recall_for_task(memory(spark), "restart the Gateway with API_HOST on 8080")
    lines = out["prompt_text"].split("\n")
    assert lines[0] == "## Relevant Memory" and {x["kind"] for x in out["items"]} >= {"Rule", "Context", "Event"}
    assert all(len(x) <= 140 for x in lines) and "e1" not in out["prompt_text"].replace("8080", "") and lines[1].startswith("- [Rule]")
    assert task_recall.recall_for_task(memory(spark), "  ")["prompt_text"] == ""
    assert task_recall.recall_for_task(memory(spark), "qqqq")["prompt_text"] == ""


@pytest.mark.parametrize("relation", [model.MEANING_UPDATE, "merge", "补充"])
def test_folding(spark, relation):
    out = task_recall.recall_for_task(memory(spark, relation), "what about API_HOST port")
    texts = [x["text"] for x in out["items"] if x["kind"] in ("Event", "Warning")]
    if relation == "补充":
        assert any("8080" in t and "9090" in t for t in texts)
    else:
        assert any("9090" in t for t in texts) and not any("8080" in t for t in texts)


def test_reports(spark):
    rows = spark.createDataFrame([("a", True, True, True, 1.0), ("a", False, True, False, 3.0), ("b", True, False, False, 5.0)], "category string, expected boolean, predicted boolean, correct boolean, latency_ms double")
    got = {(r.scope, r.category): r for r in reports.reuse_summary(rows).collect()}
    assert got[("overall", None)].precision == 0.5 and got[("overall", None)].latency_p50 == 3.0 and got[("category", "b")].recall == 0.0
    assert reports.summed(spark.createDataFrame([(1, 2), (3, 4)], "a int, b int")).first().asDict() == {"a": 4, "b": 6}
    assert {r.key: r.total for r in reports.summed_map(spark.createDataFrame([({"x_ms": 1.0},), ({"x_ms": 2.0, "y_ms": 5.0},)], "m map<string,double>"), "m").collect()} == {"x_ms": 3.0, "y_ms": 5.0}
    assert json.dumps({r.name: r.n_rows for r in reports.graph_stats({"t": rows}).collect()}) == '{"t": 3}'
