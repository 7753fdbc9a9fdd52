import hashlib
import random
import re

import pytest

from mnemoframe.llm import arrays, substring

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(rows, size):
    docs = [(i if i is not None else -(1 << 63), WORD.findall((t or "").encode())) for i, t in rows]
    first = {}
    for i, w in docs:
        for s in range(len(w) - size + 1):
            k = tuple(w[s : s + size])
            first[k] = min(first.get(k, (i, s)), (i, s))
    out = []
    for (i, w), (raw, _) in zip(docs, rows, strict=True):
        gone = set()
        for s in range(len(w) - size + 1):
            if first[tuple(w[s : s + size])] < (i, s):
                gone |= set(range(s, s + size))
        kept = b" ".join(x for n, x in enumerate(w) if n not in gone)
        text = rows[len(out)][1]
        if gone:
            spans = [(m.start(), m.end()) for m in WORD.finditer(text.encode())] + [(len(text.encode()), 0)]
            text = b"".join(text.encode()[a:b] for a, b in [(0, spans[0][0])] + [(spans[n][0], spans[n + 1][0]) for n in range(len(w)) if n not in gone]).decode()
        out.append((raw, len(w), len(gone), hashlib.sha256(kept).hexdigest(), text))
    return sorted(out, key=repr)


def result(spark, rows, size):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as doc", "'x' as hash", "2 as grp", "3 as id")
    got = substring.remove_repeats(df, size=size).collect()
    for r in got:
        assert sum(s.end - s.start for s in r.removed) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.removed, r.removed[1:]))
    return sorted(((r.doc.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in got), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(substring, "BUCKET_BYTES", 400)
    monkeypatch.setattr(substring, "GROUP_BYTES", 700)
    rng = random.Random(seed)
    passages = [[rng.choice("ab cé x yÑ".split(" ")) for _ in range(rng.randint(3, 12))] for _ in range(6)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randint(0, 8)):
            words += rng.choice(passages) if rng.random() < 0.6 else [rng.choice("pqrstu") for _ in range(rng.randint(1, 5))]
        rows.append((rng.randint(-20, 20) if i % 9 else None, rng.choice([" ", "\n", "\t \x0b", "  "]).join(words)))
    rows += [rows[3], rows[3], (5, None), (6, ""), (None, None), (7, " \n ")]
    rng.shuffle(rows)
    assert result(spark, rows, 5) == brute(rows, 5)


def test_long_text_and_empty_table(spark):
    rows = [(2, " ".join(f"w{i}" for i in range(60_000))), (1, " ".join(f"w{i}" for i in range(30_000, 31_000)))]
    assert result(spark, rows, 20) == brute(rows, 20)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substring.remove_repeats(empty).count() == 0


def test_blocks_do_not_matter(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    monkeypatch.setattr(arrays, "BLOCK_BYTES", 5000)
    assert result(spark, rows, 20) == brute(rows, 20)
