import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemoframe.operators import consolidation, contexts, entities, near

KIND = "id string, at long, v array<float>, scope string"


def brute(rows, threshold, k, queries=None):
    good = [r for r in rows if r[0] is not None and r[2] and None not in r[2] and np.isfinite(r[2]).all() and any(r[2]) and len(r[2]) == 8]
    asked = good if queries is None else [r for r in queries if r[0] is not None and r[2] and any(r[2])]
    out = {}
    for i, _, v, s in asked:
        v = np.array(v, np.float32).astype(float)
        hits = []
        for j, at, w, t in good:
            w = np.array(w, np.float32).astype(float)
            near_ = round(float(np.clip(v @ w / np.linalg.norm(v) / np.linalg.norm(w), 0, 1)), 12)
            if i != j and (s or "") == (t or "") and near_ >= threshold:
                hits.append((-near_, -(at or 0), j))
        out[i] = [(j, -d) for d, _, j in sorted(hits)[:k]]
    return {i: h for i, h in out.items() if h}


def result(spark, rows, threshold, k, queries=None):
    df = lambda x: spark.createDataFrame(x, KIND)
    out = {}
    for r in near.similar(df(rows), threshold, k, None if queries is None else df(queries)).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.id, r.similarity))
        assert r.rank == len(out[r.query_id])
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]] and np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-9)


def groups(n, rng, spread):
    centres = rng.normal(size=(n // 6, 8))
    return [(f"p{i:05d}", int(rng.integers(0, 50)), (centres[i % len(centres)] + spread * rng.normal(size=8)).astype(np.float32).tolist(), None) for i in range(n)]


def test_same_as_all_pairs_with_copies_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(near, "CHUNK", 40)
    rng = np.random.default_rng(2)
    rows = groups(240, rng, 0.02)
    rows += [(f"copy{i}", i % 7, [1.0] * 8, None) for i in range(150)] + [(f"scaled{i}", 3, [float(i + 2)] * 8, None) for i in range(60)]
    rows += [(f"x{i}", i, [1.0] + [0.0] * 6 + [i / 100], "other" if i % 2 else "") for i in range(20)]
    rows += [("none", 1, None, None), ("zero", 1, [0.0] * 8, None), ("nan", 1, [float("nan")] * 8, None), ("hole", 1, [None] + [1.0] * 7, None), ("short", 1, [1.0], None), (None, 1, [1.0] * 8, None)]
    same(result(spark, rows, 0.97, 4), brute(rows, 0.97, 4))


def test_queries_of_their_own(spark):
    rng = np.random.default_rng(4)
    rows = groups(120, rng, 0.02)
    asked = [(f"q{i}", 0, (np.array(r[2]) * 2 + 0.001).astype(np.float32).tolist(), None) for i, r in enumerate(rows[:30])] + [(rows[0][0], 0, rows[0][2], None), ("alone", 0, [0.0] * 7 + [1.0], "elsewhere")]
    same(result(spark, rows, 0.97, 3, asked), brute(rows, 0.97, 3, asked))
    assert result(spark, rows, 0.9, 3, []) == {} and result(spark, [], 0.9, 3) == {} and result(spark, [], 0.9, 3, asked) == {}


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(700, 8))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    aside = rng.normal(size=base.shape)
    aside -= (aside * base).sum(axis=1, keepdims=True) * base
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    rows = [(f"a{i}", 0, v.astype(np.float32).tolist(), None) for i, v in enumerate(base)] + [(f"b{i}", 0, v.astype(np.float32).tolist(), None) for i, v in enumerate(0.805 * base + (1 - 0.805**2) ** 0.5 * aside)]
    got = result(spark, rows, 0.8, 50)
    met = sum(f"b{i}" in [j for j, _ in got.get(f"a{i}", [])] for i in range(700))
    assert met >= 0.98 * 700


def test_plans_trade_planes_for_tables():
    small, large = near.plan(1_000, 0.8), near.plan(10**9, 0.8)
    assert large[0] > small[0] and large[2] > small[2] and near.plan(10**6, 0.95)[2] < near.plan(10**6, 0.6)[2]
    planes, flips, tables = large
    assert tables * 2**flips / 2**planes < 0.01  # of a hundred rows one is compared


def test_merging_without_a_block(spark):
    rows = [("a", [1.0, 0.0], "s1", 1), ("b", [0.99, 0.1], "s2", 2), ("c", [0.0, 1.0], "s1", 3), ("d", [0.05, 1.0], "s3", 4)]
    e = spark.createDataFrame(rows, "id string, embedding array<float>, session_id string, last_active long").selectExpr("*", "last_active as timestamp", "last_active as created_at", "1 as support_count", "'active' as status", "'' as episode_id", "'{}' as payload")
    assert sorted((r.canonical_id, r.merged_id) for r in consolidation.merge_plan(e, search="signatures").collect()) == [("b", "a"), ("d", "c")]
    focus = consolidation.near_pairs(e, focus=["a"], search="signatures").select("a.id", F.col("b.id").alias("other")).collect()
    assert [tuple(r) for r in focus] == [("a", "b")]


def test_contexts_meet_by_summary_and_vector(spark, monkeypatch):
    monkeypatch.setattr(contexts, "CROWD", 3)
    rows = [(f"s{i}", "Rain, in town", None, 1) for i in range(12)] + [("v1", "one thing", [1.0, 0.0], 1), ("v2", "another thing", [0.9, 0.2], 2), ("far", "elsewhere", [0.0, 1.0], 1), ("old", "rain in town", None, 1)]
    c = spark.createDataFrame(rows, "id string, summary string, embedding array<float>, support_count int").selectExpr("*", "if(id = 'old', 'deprecated', 'active') as status", "'situation' as subtype", "'' as description", "1 as last_seen_at", "1 as updated_at", "1 as created_at")
    found = {frozenset((r.canonical_id, r.merged_id)): r for r in contexts.near_merge_candidates(c).collect()}
    assert found[frozenset(("v1", "v2"))].canonical_id == "v2" and not [p for p in found if p & {"far", "old"}]
    plan = contexts.disjoint_plan(contexts.near_merge_candidates(c))
    assert plan.filter("canonical_id like 's%'").count() >= 4


@pytest.mark.parametrize("arbiter", [None, lambda rows: rows.withColumn("decision", F.lit("yes"))])
def test_mentions_meet_entities_of_their_type(spark, arbiter):
    known = spark.createDataFrame([("Ann", "person", [1.0, 0.0]), ("Ann's car", "thing", [0.99, 0.05]), ("It", None, [0.0, 1.0]), ("Bo", "person", [0.6, 0.8])], "id string, type string, description_embedding array<float>").selectExpr("*", "true as registered", "array('twin') as aliases")
    asked = spark.createDataFrame([("she", "person", [1.0, 0.02]), ("which", "", [1.0, 0.02]), ("that", "thing", [0.1, 1.0]), ("bo", "person", None), ("twin", "person", [0.62, 0.78]), ("half", "person", [0.8, -0.6]), ("none", "person", [-1.0, 0.0])], "name string, type string, embedding array<float>")
    got = {r.name: (r.id, r.reason) for r in entities.resolve(asked, known, arbiter).collect()}
    want = {"she": ("Ann", "vector_high"), "that": ("It", "vector_high"), "bo": ("Bo", "exact_match"), "twin": ("Bo", "vector_high")}
    if arbiter:
        want |= {"which": ("Ann", "llm_yes"), "half": ("Ann", "llm_yes")}
    assert got == want
