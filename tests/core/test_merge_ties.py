from mnemoframe.operators import consolidation


def test_equal_scores_merge_in_order_of_ids(spark):
    rows = [(f"e{i:02}", [1.0, 0.0], 100, 100, 100, 1, "active", "{}") for i in range(9)]
    events = spark.createDataFrame(rows, "id string, embedding array<double>, last_active long, timestamp long, created_at long, support_count int, status string, payload string")
    plan = consolidation.merge_plan(events)
    used, want = set(), set()
    for pair in sorted((f"e{i:02}", f"e{j:02}") for i in range(9) for j in range(i)):  # the larger id is canonical
        if not used & set(pair):
            used |= set(pair)
            want.add(pair)
    assert {(r.canonical_id, r.merged_id) for r in plan.collect()} == want
