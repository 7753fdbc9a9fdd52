import random
import re

import numpy as np
import pytest

from mnemoframe.llm import arrays, graph, set_join

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text, words):
    w = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not w:
        return set()
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)}


def brute(rows, words=5, percent=75):
    low = -(1 << 63)
    docs = [(low if i is None else i, shingles(t, words)) for i, t in rows]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            a, b = docs[i][1], docs[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d), d)
    null = lambda x: None if x == low else x
    return sorted(((null(d), len(s), null(least[find(i)])) for i, (d, s) in enumerate(docs)), key=repr)


def result(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as cls", "3 as n")
    return sorted((tuple(r) for r in set_join.similar_components(df, **more).collect()), key=repr)


def near_copies(rng, groups, copies, low=1, high=90):
    rows, i = [], 0
    for _ in range(groups):
        base = [rng.choice("abcdefghij") + rng.choice("klmnopqrst") for _ in range(rng.randint(low, high))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice("uvwxyz") * 2
            if rng.random() < 0.3:
                w = w[: -rng.randint(1, 4)] or w
            rows.append((i := i + 1, rng.choice([" ", "\n"]).join(w).title() if rng.random() < 0.5 else " ".join(w)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(set_join, "BUCKET", 700)
    rng = random.Random(seed)
    rows = near_copies(rng, 50, 5) + near_copies(rng, 30, 3, 1, 9)
    rows += [(None, rows[0][1]), (-5, None), (6, ""), (7, " \t"), (rows[1][0], rows[1][1]), (rows[1][0], "quite another text"), (-9, "One"), (-8, "one")]
    assert result(spark, rows) == brute(rows)


@pytest.mark.parametrize("rounds", [1, 4])
def test_hot_groups(spark, monkeypatch, rounds):
    """More near copies than FEW, loose enough that no pivot reaches all, and a common passage."""
    monkeypatch.setattr(set_join, "FEW", 3)
    monkeypatch.setattr(set_join, "CHUNK", 7)
    monkeypatch.setattr(set_join, "TRIES", rounds)
    rng = random.Random(5)
    rows = near_copies(rng, 3, 40, 60, 90)
    passage = " ".join(f"p{i}" for i in range(40))
    rows += [(1000 + i, passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.randint(8, 30)))) for i in range(60)]
    chain = [f"c{i}" for i in range(140)]
    rows += [(2000 + i, " ".join(chain[i : i + 60])) for i in range(0, 80, 4)]
    assert result(spark, rows) == brute(rows)


def test_other_thresholds_and_empty(spark):
    rows = near_copies(random.Random(9), 30, 4)
    assert result(spark, rows, words=3, percent=60) == brute(rows, 3, 60)
    assert result(spark, rows, percent=100) == brute(rows, 5, 100)
    assert result(spark, []) == []


def test_small_documents_table(spark, monkeypatch):
    monkeypatch.setattr(arrays, "BLOCK_BYTES", 20_000)
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert result(spark, rows) == brute(rows)


def test_every_linked_pair_shares_a_signature():
    rng, bands = np.random.default_rng(1), set_join.Bands(75)
    for size in [*range(2, 40), 64, 85, 128, 500]:
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
            drop, add = rng.integers(0, size // 7 + 1), rng.integers(0, size // 7 + 1)
            b = np.unique(np.concatenate((rng.permutation(a)[drop:], rng.integers(0, 2**63, add).astype(np.uint64))))
            if not set_join.linked(a, b, 75):
                continue
            sig, row, _, _ = set_join.signatures(np.concatenate((a, b)), np.array([len(a), len(b)]), bands)
            assert set(sig[row == 0]) & set(sig[row == 1])


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 50), (50, 100), (7, 7), (200, 100)]
    got = dict(graph.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(31)} | {50: 50, 100: 50, 200: 50}
