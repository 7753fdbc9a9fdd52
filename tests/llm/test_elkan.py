import hashlib
import math

import numpy as np
import pytest

from mnemoframe.llm import elkan

KIND = "vec_id long, embedding array<double>"


def brute(rows, k, rounds, dim):
    """Every distance of every round, in Python's own integers."""
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    centroids = [v for _, v in seeds]
    far = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c, strict=True))
    nearest = lambda v: min(range(len(centroids)), key=lambda j: (far(v, centroids[j]), j))
    for _ in range(rounds):
        own = [nearest(v) for _, v in kept]
        groups = {j: [v for (_, v), o in zip(kept, own, strict=True) if o == j] for j in range(len(centroids))}
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if groups[j] else c for j, c in enumerate(centroids)]
    found = [(i, nearest(v), v) for i, v in kept]
    cost = {}
    for _, j, v in found:
        cost[j] = cost.get(j, 0) + far(v, centroids[j])
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((i is None, i or 0, j, far(v, centroids[j]), cost[j], sum(cost.values()), digest[j]) for i, j, v in found)


def result(spark, rows, **more):
    df = spark.createDataFrame(rows, KIND).selectExpr("*", "1 as id", "'x' as v", "2 as own", "3 as cluster")
    found = elkan.cluster(df, **more).collect()
    return sorted((r.id is None, r.id or 0, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in found), sum(r.computed for r in found)


def test_same_as_all_distances(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(9, 5)) * 3
    rows = [(i, (centres[i % 9] + rng.normal(size=5) * 0.4).tolist()) for i in range(300)]
    rows += [(1000 + i, [0.5, -0.25, 1.0, 0.0, 2.0]) for i in range(60)]  # copies
    rows += [(2000 + i, [float(i % 2), 0.0, 0.0, 0.0, 0.0]) for i in range(40)]  # ties
    rows += [(5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1]), (3000, None), (3001, [1.0]), (3002, [float("nan")] * 5), (3003, [None] + [1.0] * 4), (3004, [float("inf")] * 5)]
    got, computed = result(spark, rows, k=8, rounds=3, dimensions=5)
    assert got == brute(rows, 8, 3, 5)
    assert computed < 0.6 * 8 * 4 * len(got)


def test_ties_go_to_the_smaller_number(spark):
    # every vector stands as far from two of the first centroids
    rows = [(i, [float(x), float(y)]) for i, (x, y) in enumerate([(0, 0), (2, 0), (0, 2), (2, 2), (1, 1), (1, 0), (0, 1), (1, 2), (2, 1)] * 3)]
    for k in (2, 3, 4, 9):
        assert result(spark, rows, k=k, rounds=2, dimensions=2)[0] == brute(rows, k, 2, 2)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [0.0, 0.0])] * 3])
def test_few_or_no_rows(spark, rows):
    assert result(spark, rows, k=4, rounds=3, dimensions=2)[0] == brute(rows, 4, 3, 2)


def test_large_components_stay_exact(spark):
    most = elkan.largest_component(3)
    far = most / 64 * 0.999
    rows = [(i, [far * s, far * (i % 5) / 5, -far * s]) for i, s in enumerate([1, -1, 1, -1, 0.5, -0.5, 0.25, 1, -1, -1])] + [(99, [far * 2] * 3)]
    assert result(spark, rows, k=3, rounds=3, dimensions=3)[0] == brute(rows[:-1], 3, 3, 3)


def test_bounds_hold(monkeypatch):
    rng = np.random.default_rng(5)
    rows = rng.integers(-40, 40, size=(500, 6))
    first, second = rows[:7].copy(), rows[7:14].copy()
    own, _, upper, lower, _ = elkan.Centroids(first).assign(rows, None, None, None)
    far = lambda c: np.sqrt(((rows[:, None, :] - c[None]) ** 2).sum(axis=2))
    assert (lower <= far(first)).all() and (upper >= far(first)[np.arange(500), own]).all()
    own, square, upper, lower, _ = elkan.Centroids(second, first).assign(rows, own, upper, lower)
    assert (lower <= far(second)).all() and (upper >= far(second)[np.arange(500), own]).all() and (own == far(second).argmin(axis=1)).all()
