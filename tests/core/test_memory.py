import pytest

from mnemoframe.memory import Memory, infer_kind
from mnemoframe.streaming.models import sentences


def test_a_memory_from_end_to_end(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "root"), "db", audit=str(tmp_path / "audit"))
    episodes = spark.createDataFrame([("p1", "Gateway listens on 8080. Ann restarted it.", 100), ("p2", "Lunch was late.", 200)], "id string, content string, timestamp long")
    assert m.ingest(episodes, sentences).count() == 3 and m.ingest(episodes, sentences).count() == 0
    assert [r.summary for r in m.search("gateway 8080").collect()] == ["Gateway listens on 8080."]
    first = m.search("gateway").first().id
    m.write(spark.createDataFrame([(first, "Gateway listens on 9090.", 300)], "id string, summary string, timestamp long"), links=spark.createDataFrame([(first, "gw")], "event_id string, entity_id string"), now=300)
    assert m.search("9090").count() == 1 and m.search("8080").count() == 0 and m.table("events").count() == 3
    out = m.register_entities(spark.createDataFrame([("Gateway", "service", "the gateway", ["gw"])], "id string, type string, description string, aliases array<string>"), 400)
    assert out.first().registered and m.table("involves").first().entity_id == "Gateway"
    m.put_patterns(spark.createDataFrame([("Gateway", "## Ports\nuse 9090")], "entity_id string, content string"), 500)
    assert m.recall_pattern("Gateway").first().content.startswith("## Ports")
    with pytest.raises(LookupError):
        m.put_patterns(spark.createDataFrame([("nobody", "x")], "entity_id string, content string"), 500)
    told = m.recall_for_task("which port does the Gateway use")["prompt_text"]
    assert "[Rule]" in told and "9090" in told
    assert {r.id for r in m.query("lunch")["events"].collect()} and m.detail("event", first).first().entity_ids == ["Gateway"]
    counts = m.consolidate(10**9, dry_run=True).first()
    assert counts.n_archivable == 3 and m.table("events").filter("status = 'archived'").isEmpty()
    m.remove([first], now=600)
    assert m.search("9090").count() == 0
    m.remove([first], hard=True)
    assert m.table("events").count() == 2 and m.table("involves").isEmpty() and m.table("extracted_from").count() == 2
    m.cleanup(4000)
    assert {r.name: r.n_rows for r in m.stats().collect()}["episodes"] == 1 - 1 or m.table("episodes").count() <= 2
    assert {(r.entity_type, r.action) for r in m.audit.recent(1000).collect()} >= {("events", "created"), ("events", "updated"), ("events", "archived"), ("events", "removed"), ("entities", "merged")}
    assert infer_kind(["subtype"]) == "context" and infer_kind(["summary"]) == "event"


def test_merges(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "root"))
    m.write(spark.createDataFrame([("a", "rain", 1, 0.5, 2, ["x"]), ("b", "heavy rain", 1, 0.7, 3, None), ("c", "sun", 1, 0.5, 1, None)], "id string, summary string, created_at long, confidence double, support_count long, merged_from array<string>").selectExpr("*", "'active' as status", "'situation' as subtype", "1 as last_seen_at"), "context")
    m.space.write("in_rel", spark.createDataFrame([("e", "a", 1), ("e", "b", 2), ("f", "b", 3)], "event_id string, context_id string, updated_at long"))
    m.merge_contexts(spark.createDataFrame([("a", "b", 0.9)], "canonical_id string, merged_id string, score double"), 50)
    rows = {r.id: r for r in m.table("contexts").collect()}
    assert (rows["a"].summary, rows["a"].support_count, rows["a"].merged_from) == ("heavy rain", 5, ["b", "x"]) and rows["a"].confidence == pytest.approx(0.73)
    assert (rows["b"].status, rows["b"].valid_to, rows["c"].status) == ("merged", 50, "active")
    assert sorted((r.event_id, r.context_id, r.updated_at) for r in m.table("in_rel").collect()) == [("e", "a", 2), ("f", "a", 3)]
    m.write(spark.createDataFrame([("x", "one", 5, [1.0, 0.0]), ("y", "two", 5, [1.0, 0.0])], "id string, summary string, timestamp long, embedding array<float>"))
    counts = m.consolidate(60).first()
    assert counts.merged == 1 and m.table("event_merge_trace").count() == 1 and m.table("events").filter("status = 'merged'").count() == 1
