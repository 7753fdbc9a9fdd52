import json

from mnemoframe.operators import payloads


def test_normalisation(spark):
    rows = [
        {"event": {"actor": [{"name": "Ann", "seat": "front"}, "Bob", "Bob", ""], "Action": "drives", "time": "1970-01-02 08:00:00", "outcome": "late", "mood": "calm", "empty": []}},
        {"summary": "s", "cause": "c", "time_range": {"start": 100, "text": "in the morning"}, "evidence": ["seen", {"source": "x", "snippet": "y", "confidence": "0.5"}]},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)] + [(2, "no json")], "i int, payload string")
    a, b, c = payloads.normalized_payloads(df).orderBy("i").collect()
    assert (a.summary, a.action, a.causality, json.loads(a.extra)) == ("drives", "drives", "late", {"mood": "calm"})
    assert [tuple(p) for p in a.participants] == [("Ann", "front"), ("Bob", "")] and a.time_range.start == a.time_range.end == 86400 + 8 * 3600
    assert (b.summary, b.action, b.causality, b.time_range.display_time_bucket) == ("s", "s", "c", "morning")
    assert [tuple(e) for e in b.evidence] == [("llm_extraction", "seen", 0, 1.0), ("x", "y", 0, 0.5)]
    assert (c.summary, c.participants, c.evidence) == ("", [], [])
    found = payloads.normalized_payloads(df).select(payloads.labels(payloads.F.col("participants")).alias("l")).first().l
    assert found == ["Ann/front", "Bob"]


def test_lists_as_text(spark):
    df = spark.createDataFrame([('["010", " 101 ", ""]',)], "v string")
    assert df.select(payloads.plain(payloads.F.col("v")).alias("t")).first().t == "010, 101"


def test_items(spark):
    answers = [json.dumps({"events": [{"summary": "a"}, {"x": 1}, {"action": "b"}]}), json.dumps([{"summary": "c"}]), json.dumps({"summary": "d"}), json.dumps({"event": {"cause": "e"}}), "{}"]
    df = spark.createDataFrame([(a,) for a in answers], "payload string")
    assert sorted(json.loads(r.item).get("summary") or "-" for r in payloads.event_items(df).collect()) == ["-", "-", "a", "c", "d"]


def test_each_name_is_read_once(spark):
    rows = spark.range(4).selectExpr("id", "concat('{\"Action\": \"', id, '\", \"participants\": [\"Ann\"]}') as payload")
    plan = payloads.normalized_payloads(rows).select("summary", "action", "causality", "participants")._jdf.queryExecution().optimizedPlan().toString()
    for name in ("$.event", "$.Action", "$.event_summary", "$.cause", "$.impact", "$.Actors"):
        assert plan.count(f"{name})") == 1, name
