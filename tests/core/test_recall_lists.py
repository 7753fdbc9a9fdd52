from pyspark.sql import functions as F

from mnemoframe.operators import recall


def test_a_query_is_shuffled_as_one_row(spark):
    """Channels meet by lists, their candidates are neither joined with the events nor shuffled one by one."""
    rows = [(f"e{i:02}", 100 + i % 5, ["active", "merged", "active", "archived"][i % 4], f"e{i - 1:02}" if i % 3 == 0 else None, f"t{i % 4}") for i in range(40)]
    events = spark.createDataFrame(rows, "id string, last_active long, status string, parent_event_id string, thread_id string").withColumn("timestamp", F.col("last_active"))
    involves = spark.createDataFrame([(f"e{i:02}", e) for i in range(40) for e in (f"u{i % 9}", f"k{i % 2}")], "event_id string, entity_id string")
    states = spark.createDataFrame([(f"e{i:02}", f"u{i % 9}", "port") for i in range(40)] + [("e01", "u2", "port"), ("e02", " ", "port")], "id string, entity string, attribute string")
    got = recall.recall(events, events, involves, states)
    parts = [("temporal", recall.temporal(events, events)), ("entity", recall.entity(events, events, involves)), ("state", recall.state(events, events, states)), ("reference", recall.reference(events, events))]
    status, scores = {r[0]: r[2] for r in rows}, {}
    for name, rows_ in parts:
        for r in rows_.collect():
            assert r.channel == name and r.query_id != r.cand_id
            scores.setdefault((r.query_id, r.cand_id), {})[name] = r.score
    want = {}
    at = {r[0]: r[1] for r in rows}
    for (q, c), own in scores.items():
        total = sum(recall.WEIGHTS[n] * s for n, s in own.items())
        if status[c] == "active" and round(total, 12) >= recall.FLOOR:
            want.setdefault(q, []).append((-round(total, 6), -max(own.values()), -at[c], c, own))
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, {})[r["rank"]] = (-round(r.aggregate_score, 6), -r.channel_score, -r.cand_at, r.cand_id, dict(r.channels))
        assert r.channel == min(r.channels, key=lambda n: (-r.channels[n], list(recall.WEIGHTS).index(n)))
    assert {q: [v[k] for k in sorted(v)] for q, v in found.items()} == {q: sorted(v, key=lambda x: x[:4])[: recall.MOST] for q, v in want.items()}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "cand_id" not in "".join(line for line in plan.splitlines() if "Join" in line)
