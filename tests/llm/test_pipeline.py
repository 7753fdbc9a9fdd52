import re
import struct
import sys
from pathlib import Path

import public_tokenizers as P
import pytest
import tiktoken

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as cp  # noqa: E402
from mnemoframe.llm import byte_bpe, ppm  # noqa: E402
from tests.llm import test_decontaminate as leaks  # noqa: E402
from tests.llm import test_set_join as near  # noqa: E402
from tests.llm import test_substring as repeats  # noqa: E402


def cut_leaks(docs, items, size=10):
    sets = {tuple(w[s : s + size]) for _, t in items if (w := leaks.words(t)) for s in range(max(1, len(w) - size + 1))}
    out = []
    for d, t in docs:
        w, hit = leaks.words(t), set()
        for key in sets:
            for s in range(len(w) - len(key) + 1):
                if tuple(w[s : s + len(key)]) == key:
                    hit |= set(range(s, s + len(key)))
        if hit:
            at = [m.start() for m in re.finditer(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t.encode())] + [len(t.encode())]
            t = (t.encode()[: at[0]] + b"".join(t.encode()[at[i] : at[i + 1]] for i in range(len(w)) if i not in hit)).decode()
        out.append((d, t))
    return out


def brute(spark, sf_dir, docs):
    trees = ppm.learn_languages(docs)
    rows = [(r.doc.doc_id, r.text) for r in ppm.identify(docs, trees).collect() if r.lang_pred != "und" and r.bits_per_byte <= cp.MOST_BITS and r.score >= cp.LEAST_SCORE]
    stay = {d for d, _, c in near.brute(rows) if c == d}
    rows = list({(d, t) for d, t in rows if d in stay})
    rows = [(r[0], r[4]) for r in repeats.brute(rows, 20)]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    return sorted((d, struct.pack(f"<{len(ids)}I", *ids)) for d, t in cut_leaks(rows, items) if (ids := enc.encode_ordinary(t)) is not None)


def test_run_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    want = brute(spark, sf_dir, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert sorted((r.doc_id, bytes(r.ids)) for r in cp.run(spark, sf_dir).collect()) == want
    assert len(want) > 100


def test_stages_keep_columns_and_survive_odd_rows(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, "12 34", None, None, 5), (3, "of the and in", "en", None, 13), (3, "of the and in", "en", None, 13)], docs.schema)
    docs = docs.union(odd).selectExpr("*", "1 as id", "2 as doc", "'x' as hash", "3 as key")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType, name
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert docs.filter("doc_id = 3 and text = 'of the and in'").count() <= 1 and docs.filter("text is null").count() == 0


@pytest.mark.parametrize("n", [len(cp.STAGES)])
def test_stage_order(n):
    assert [x for x, _ in cp.STAGES] == ["language_id", "ngram_join", "substring_dedup", "decontamination", "byte_level_bpe"] and n == 5


def test_ngram_join_keeps_one_row_of_each_group_whatever_the_ids(spark):
    x, y, z = ("the quick brown fox jumps over the lazy dog again", "an entirely different text about nothing much at all", "a third one that nobody has copied so far here")
    rows = [(1, x), (3, x), (3, y), (4, y.upper()), (5, z), (5, z), (6, ""), (6, None), (None, z + " more words than before"), (7, "one"), (7, "two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as _id", "2 as id", "3 as hash", "4 as k", "5 as stay", "6 as rows", "7 as doc", "8 as group_id")
    out = cp.ngram_join(spark, docs, "")
    assert out.columns == docs.columns
    kept = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    # z and its longer copy are near duplicates; a null id is the smallest
    linked = near.brute([(0, z), (1, z + " more words than before")])[1][2] == 0
    want = [(1, x), (3, y), (6, ""), (6, None), (7, "one"), (7, "two"), (None, z + " more words than before")] + ([] if linked else [(5, z)])
    assert kept == sorted(want, key=repr)


def test_of_rows_of_one_id_and_text_the_first_stays(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long, more map<string,int>"
    rows = [(1, "one two three four five six", "en", s, 5, {"k": n}) for s, n in (("b", 1), ("a", 2), ("a", 1), (None, 0))] + [(1, "quite another text of this id", "en", "z", 1, None), (2, "one two three four five six", "en", "a", 5, None), (None, None, None, "y", None, None), (None, None, None, "x", None, None), (3, "", "en", "q", 0, None)]
    for order in (rows, rows[::-1]):
        got = sorted(((r.doc_id, r.text, r.source, r.more) for r in cp.ngram_join(spark, spark.createDataFrame(order, kind).repartition(3), "").collect()), key=repr)
        # a null column is left out of the JSON, so what follows it counts: n_chars comes before source
        assert got == sorted([(1, rows[1][1], None, {"k": 0}), (1, rows[4][1], "z", None), (None, None, "x", None), (3, "", "q", None)], key=repr)
