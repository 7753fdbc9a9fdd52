import re
from itertools import permutations

from mnemoframe.llm import filter_audit

DOCS = "doc_id long, text string, lang string, id int, mask int, part string, n int"
LABELS = "doc_id long, quality int, toxic int, text string"


def fails_of(rows):
    smallest = {}
    for i, t, _ in rows:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    out = []
    for i, t, part in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A"} if len(words) < 200 else set()
        fails |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t) else set()
        fails |= {"D"} if re.search("[#$%&*|]", t) else set()
        fails |= {"E"} if i is not None and i > smallest[t] else set()
        out.append((i, part or "", fails))
    return out


def brute(rows, labels):
    good, toxic = ({i for i, *ls in labels if ls[at] == 1} for at in (0, 1))
    out, removed_by = {}, {}
    for order in map("".join, permutations("ABCDE")):
        for i, part, fails in fails_of(rows):
            gone = False
            for step, f in enumerate(order, 1):
                c = out.setdefault((part, order, step), dict.fromkeys(["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"], 0))
                here = f in fails and not gone
                c["redundant"] += f in fails and gone
                gone |= here
                c["kept"] += not gone
                c["removed"] += here
                c["unique_fails"] += fails == {f}
                c["good_lost"] += here and i in good
                c["toxic_lost"] += here and i in toxic
                removed_by[part, f] = removed_by.get((part, f), 0) + here
    return {k: (*c.values(), removed_by[k[0], k[1][k[2] - 1]]) for k, c in out.items()}


def result(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1, 2, "p", 3) for r in rows], DOCS)
    found = filter_audit.audit(docs, spark.createDataFrame([(*r, "t") for r in labels], LABELS)).collect()
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in found}


def test_same_as_filter_by_filter(spark):
    prose = " ".join(f"word{i}" for i in range(210))
    rich, same, loud, marked = prose, "again and " * 150, "ALL Loud " * 120 + prose, prose + " 5 % | more"
    texts = [rich, same, loud, marked, None, "", " \t\n", "short", "SHORT $", "É" * 100 + "A" * 3, "É" * 100 + "A" * 4, prose.replace(" ", " "), "x\x1cy " * 200]
    rows = [(i, t, lang) for i, t in enumerate(texts * 2) for lang in ["en", None] if (i + (lang is None)) % 3]
    rows += [(100 + i, rich, "de") for i in range(30)] + [(200, rich, "en"), (200, rich, "en"), (0, rich, "fr"), (None, rich, "en"), (None, "only without id", "it"), (300, "only without id", "it"), (None, "only without id", "it")]
    rows += [(400, "equal", "en"), (400, "equal", "de"), (401, "equal", "en")]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 120, 3)] + [(200, 1, 0), (200, 0, 1), (3, None, None), (None, 1, 1), (9999, 1, 1)]
    labels = [(i, q, None if t is None else int(t)) for i, q, t in labels]
    want = brute(rows, [r for r in labels if r[0] is not None])
    got = result(spark, rows, labels)
    assert got == want and len(got) == 600 * 5


def test_empty_tables(spark):
    assert result(spark, [], []) == {}
    got = result(spark, [(1, "a", "en")], [])
    assert len(got) == 600 and got["en", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120)


def test_masks(spark):
    row = spark.createDataFrame([("x " * 199 + "Y",)], "text string").select(filter_audit.text_mask("text").alias("m")).first()
    assert row.m == 2  # 200 words of two kinds; one upper-case letter in 399 characters
