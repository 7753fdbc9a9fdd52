import math
import random
from collections import Counter, defaultdict

import numpy as np

from mnemoframe.llm import ppm


def plain_bits(text, samples, order=ppm.ORDER):
    """One byte at a time, from dictionaries."""
    after = defaultdict(Counter)
    for s in samples:
        for i in range(len(s)):
            for k in range(order + 1):
                if i >= k:
                    after[s[i - k : i]][s[i]] += 1
    bits = 0.0
    for i in range(len(text)):
        for k in range(order, -2, -1):
            if k < 0:
                bits += 8
                break
            if i < k or text[i - k : i] not in after:
                continue
            seen = after[text[i - k : i]]
            total, distinct = sum(seen.values()), len(seen)
            if text[i] in seen:
                bits -= math.log2(seen[text[i]] / (total + distinct))
                break
            bits -= math.log2(distinct / (total + distinct))
    return bits


def trees(samples):
    counts = [{} for _ in range(ppm.ORDER + 1)]
    for lang, texts in samples.items():
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        codes, _ = ppm.separated(offsets, np.frombuffer(b"".join(texts), np.uint8))
        for m in range(ppm.ORDER + 1):
            counts[m][lang] = ppm.gram_counts(codes, m + 1)
    return ppm.ContextTrees(list(samples), counts)


def test_code_lengths_are_exact():
    rng = random.Random(1)
    text = lambda letters, n: "".join(rng.choice(letters) for _ in range(n)).encode()
    samples = {"b": [text("abc ", 200), text("abé ", 50), b""], "a": [text("xyz ab", 300)]}
    model = trees(samples)
    asked = [text("abcxyz é!?", rng.randint(0, 80)) for _ in range(60)] + [b"", b"a", b"\x00\xff"]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in asked])))
    bits = model.code_lengths(offsets, np.frombuffer(b"".join(asked), np.uint8))
    want = [[plain_bits(t, samples[x]) for x in ("a", "b")] for t in asked]
    assert np.allclose(bits, want, rtol=1e-4, atol=1e-3)


def test_held_out_accuracy_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = ppm.learn_languages(docs, per_language=60)
    assert model.languages == ["de", "en", "es", "fr"]
    found = ppm.identify(docs, model).filter(ppm.held_out("doc.doc_id"))
    rows = found.select("doc.lang", "lang_pred", "score").collect()
    assert len(rows) > 150 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    odd = spark.createDataFrame([(None, None), (1, ""), (2, "123 !?"), (3, "the and of " * 40_000), (3, "中文")], "doc_id long, text string").selectExpr("*", "1 as score", "2 as doc")
    got = {(r.doc.doc_id, (r.text or "")[:3]): (r.lang_pred, r.score) for r in ppm.identify(odd, model).collect()}
    assert got[(None, "")] == got[(1, "")] == got[(2, "123")] == ("und", 0.0)
    assert got[(3, "the")] == ("en", 1.0) and got[(3, "中文")][0] in model.languages
    assert ppm.identify(odd.limit(0), model).count() == 0
    nothing = ppm.learn_languages(docs.limit(0))
    assert {r.lang_pred for r in ppm.identify(odd, nothing).collect()} == {"und"}


def test_the_held_out_fold_is_not_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    changed = docs.withColumn("text", ppm.F.when(ppm.held_out(), "zzz").otherwise(ppm.F.col("text")))
    a, b = ppm.learn_languages(docs), ppm.learn_languages(changed)
    assert all((x == y).all() for x, y in zip(a.costs, b.costs))
