from mnemoframe.operators import resolution


class Counted(dict):
    compared = 0

    def __eq__(self, other):
        Counted.compared += 1
        return dict.__eq__(self, other)


def draft(i):
    return {"summary": "s", "description": "", "condition": "", "applies_when": "", "subject": "", "facts": {}, "confidence": 0.5, "valid_from": i, "valid_to": None, "subtype": "x", "source_refs": [Counted(event_id=str(i // 2))]}


def test_a_reference_is_not_compared_with_each(spark):
    c, seen = resolution.new_context(draft(0), 9, "c"), set()
    for i in range(1, 200):
        resolution.strengthen(c, draft(i), 9, seen)
    assert [r["event_id"] for r in c["source_refs"]] == [str(i) for i in range(100)] and c["support_count"] == 200
    assert Counted.compared == 0


def test_rounds_follow_the_largest_scope(spark, monkeypatch):
    rows = [(f"d{i}", f"e{i}", i, 0, "situation", f"habit {i % 4}", f"s{i % 4}", f"habit {i % 4}", 0.5) for i in range(12)]
    drafts = spark.createDataFrame(rows, "draft_id string, event_id string, at long, context_index int, subtype string, summary string, subject string, evidence_span string, confidence double")
    none, calls, once = spark.createDataFrame([], "id string"), [], resolution._round
    monkeypatch.setattr(resolution, "_round", lambda *a: calls.append(1) or once(*a))
    got = {}
    for n in (3, 2):
        calls.clear()
        held, _ = resolution.resolve(drafts, none, 1000, ("subtype", "subject"), round_drafts=n)
        got[n] = (len(calls), sorted((r.id, r.support_count, round(r.confidence, 9)) for r in held.collect()))
    assert got[3][0] == 1 and got[2][0] > 1
    assert got[3][1] == got[2][1] and len(got[3][1]) == 4
