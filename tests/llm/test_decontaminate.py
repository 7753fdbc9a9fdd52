import hashlib
import random
import re

import pytest

from mnemoframe.llm import decontaminate as dc

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))


def brute(docs, items, size=10):
    sets = {}
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - size + 1)) if w else ():
            sets.setdefault(tuple(w[s : s + size]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for key, ids in sets.items():
            for s in range(len(w) - len(key) + 1):
                if tuple(w[s : s + len(key)]) == key:
                    hit |= set(range(s, s + len(key)))
                    found |= {i for i in ids if i is not None}
        joined = ",".join(sorted(map(str, found)))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(joined.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()), key=repr)


@pytest.mark.parametrize("limit", [10**6, 0])
def test_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(dc, "BROADCAST_WINDOWS", limit)
    rng = random.Random(2)
    word = lambda: rng.choice(["a", "Bc", "É", "é", "x1", "ß"])
    text = lambda n: rng.choice([" ", "-", "\n\t", ", "]).join(word() for _ in range(n))
    items = [(i, text(rng.randint(0, 25))) for i in range(25)] + [(3, text(6)), (None, text(11)), (30, None), (31, "One two three")]
    docs = [(i, " ".join([text(rng.randint(0, 30)), rng.choice(items)[1] or "", text(rng.randint(0, 9))])) for i in range(50)]
    docs += [docs[0], (0, "other text"), (None, items[0][1]), (90, None), (91, ""), (92, "!!"), (93, "ONE two\x00three"), (94, " ".join(["zz"] * 40_000) + " one two three")]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as id", "2 as hash", "3 as words", "4 as n_words")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as item", "2 as words")
    found = dc.annotate(d, b)
    assert rows_of(found) == brute(docs, items)
    cut = dc.decontaminate(d, b)
    assert cut.columns == d.columns and cut.count() == len(docs)
    left = {r.doc_id: r.text for r in cut.collect()}
    assert left[93] == "" and left[92] == "!!" and left[90] is None
    assert dc.decontaminate(d, b, remove="documents").count() == sum(not r[-1] for r in brute(docs, items))
    if limit:
        assert rows_of(dc.annotate(d.limit(0), b)) == []
        assert rows_of(dc.annotate(d, b.limit(0))) == brute(docs, [])


def test_cutting_keeps_the_rest(spark):
    docs = spark.createDataFrame([(1, "Keep (this). One, two; THREE! and that")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert dc.decontaminate(docs, items).first().text == "Keep (this). and that"


def test_plan_is_native(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    plan = dc.annotate(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan and "NestedLoop" not in plan
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    assert rows_of(dc.annotate(docs, items)) == want
