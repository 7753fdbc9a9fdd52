import random

import numpy as np
import pytest

from mnemoframe.llm import kmtree


def brute(rows, k=10, every=100):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, v in good:
        if q % every == 0:
            best = {}
            for i, w in good:
                if i != q:
                    d = float(np.sqrt(((w - v) ** 2).sum()))
                    best[i] = min(d, best.get(i, d))
            out[q] = sorted((d, i) for i, d in best.items())[:k]
    return out


def result(spark, rows, every=100, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as leaf", "2 as id", "3 as v")
    got = {}
    for r in kmtree.Index(df).search(df.filter(f"vec_id % {every} = 0"), **more).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(got[r.query_id])
    return got


def test_all_leaves_give_exact_results(spark, monkeypatch):
    monkeypatch.setattr(kmtree, "CHUNK_ROWS", 40)
    monkeypatch.setattr(kmtree, "CHUNK_QUERIES", 2)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(700)]
    same = [1.0, 2.0, 0.5, 0.0, -1.0, 3.0]
    rows += [(1000 + i, same) for i in range(150)] + [(2000, same), (2001, None), (2100, [0.0] * 6), (2200, [float("nan")] * 6), (2300, [None] + [1.0] * 5), (None, same), (2400, [1.0, 2.0]), (5, same)]
    rows += [(3000, same)] * 40 + [(3001 + j % 3, (np.array(same) + j / 64).tolist()) for j in range(30)]
    got, want = result(spark, rows, target=1.0, every=50), brute([r for r in rows if r[0] != 2400], every=50)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]] and np.allclose([d for d, _ in got[q]], [d for d, _ in want[q]], atol=1e-12)


def test_cells_hold_whole_leaves(monkeypatch):
    monkeypatch.setattr(kmtree, "CHUNK_ROWS", 300)
    rng = np.random.default_rng(2)
    rows = np.concatenate([rng.normal(size=(2000, 4)), np.ones((500, 4))])
    tree = kmtree.Tree(rows)
    counts = np.bincount(tree.assign(rows), minlength=tree.n_leaves)
    cells = tree.cells(counts)
    held = np.bincount(cells, weights=counts)
    assert 1 < len(held) < tree.n_leaves and held.sum() == len(rows)
    assert all(n <= 300 or (cells == c).sum() == 1 for c, n in enumerate(held))


def test_few_or_no_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])]
    assert result(spark, rows) == brute(rows)
    assert result(spark, []) == {}
    assert result(spark, [(0, None), (100, [0.0])]) == {}
    assert result(spark, [(0, [1.0])]) == {}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    want, found = brute(rows, every=20), {}
    index = kmtree.Index(df)
    for r in index.search(df.filter("vec_id % 20 = 0")).collect():
        found.setdefault(r.query_id, {})[r.vec_id] = r.score
        assert r.visited <= index.tree.n_leaves and 0.97 <= r.recall <= 1
    hits = sum(i in found[q] for q, near in want.items() for _, i in near)
    assert hits >= 0.93 * sum(map(len, want.values()))
    assert all(abs(found[q][i] - d) < 1e-12 for q, near in want.items() for d, i in near if i in found[q])
