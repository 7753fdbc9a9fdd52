import math
from functools import reduce

import numpy as np
from pyspark.sql import functions as F

from mnemoframe.operators import consolidation, near

KIND = "id string, embedding array<float>, session_id string, last_active long, timestamp long, status string"


def total(parts):
    return reduce(lambda s, x: s + x, parts, 0.0)  # sum() compensates


def brute(rows, threshold, k):
    def close(v, w):
        n = min(len(v), len(w))
        if None in v or None in w:
            return 0.0
        v, w = ([float(np.float32(x)) for x in y] for y in (v, w))
        length = math.prod(math.sqrt(total(x * x for x in y)) for y in (v, w))
        if length <= 0:
            return 0.0
        s = total(x * y for x, y in zip(v[:n], w[:n])) / length
        return 1.0 if math.isnan(s) else max(0.0, min(1.0, s))

    good = [r for r in rows if r[0] is not None and r[1] and r[2] is not None and r[5] == "active"]
    out = {}
    for i, v, s, *_ in good:
        hits = sorted((-close(v, w), -(at or t), j) for j, w, u, at, t, _ in good if i != j and s == u and close(v, w) >= threshold)
        out |= {(i, n + 1): (j, -d) for n, (d, _, j) in enumerate(hits[:k])}
    return out


def test_near_pairs_are_exact_and_pair_no_rows(spark, monkeypatch):
    monkeypatch.setattr(near, "CHUNK", 40)
    monkeypatch.setattr(near, "BLOCK", 16)
    rng = np.random.default_rng(5)
    rows = [(f"p{i:04d}", rng.normal(size=8).astype(np.float32).tolist(), "ab"[i % 2], int(rng.integers(0, 9)) or None, 4, "active") for i in range(230)]
    rows += [(f"copy{i}", [1.0] * 8, "a", i % 7, 0, "active") for i in range(60)] + [(f"scaled{i}", [float(i % 9 + 2)] * 8, "a", 3, 0, "active") for i in range(50)]
    rows += [("zero", [0.0] * 8, "a", 1, 0, "active"), ("nan", [float("nan")] * 8, "b", 1, 0, "active"), ("nan2", [float("nan")] * 8, "b", 2, 0, "active"), ("hole", [None] + [1.0] * 7, "a", 1, 0, "active"), ("far", [float("inf")] + [1.0] * 7, "b", 1, 0, "active")]
    rows += [("short", [1.0, 0.5], "a", 1, 0, "active"), ("long", [1.0] * 11, "a", 1, 0, "active"), ("none", None, "a", 1, 0, "active"), ("nowhere", [1.0] * 8, None, 1, 0, "active"), (None, [1.0] * 8, "a", 1, 0, "active"), ("gone", [1.0] * 8, "a", 9, 0, "archived")]
    events = spark.createDataFrame(rows, KIND)
    for threshold, k in ((0.2, 5), (0.9, 3)):
        found = consolidation.near_pairs(events, F.col("session_id"), threshold, k)
        assert {(r.a.id, r["rank"]): (r.b.id, r.similarity) for r in found.collect()} == brute(rows, threshold, k)
    # the scopes are not joined with themselves
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_v#" not in plan and "FlatMapCoGroupsInArrow" in plan
