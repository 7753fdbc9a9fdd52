"""Ties, chains, copies and popular keys: what must not depend on order or size."""

import random

import pytest
from pyspark.sql import functions as F

from mnemoframe.functions import text as T
from mnemoframe.operators import contexts, mutations, recall, scans, search
from mnemoframe.sources import lines


def test_entity_recall_cuts_ties_by_id(spark):
    rows = [("q", ["a", "b"], 5)] + [(f"e{i:02}", ["a", f"x{i}"], 7) for i in range(30)]
    events = spark.createDataFrame(rows, "id string, entity_ids array<string>, last_active long").withColumn("timestamp", F.col("last_active"))
    none = spark.createDataFrame([], "event_id string, entity_id string")
    for popular in (3, 64):  # through the popular entity, and by the join
        got = [r.cand_id for r in recall.entity(events.filter("id = 'q'"), events, none, popular=popular).orderBy("cand_id").collect()]
        assert got == [f"e{i:02}" for i in range(8)]


@pytest.mark.parametrize(("popular", "widest"), [(2, 6), (2, 1), (5, 2), (1000, 6)])
def test_entity_recall_against_brute_force(spark, popular, widest):
    rng = random.Random(popular * 10 + widest)
    sets = {f"e{i}": (sorted(rng.sample("abcdefgh", rng.randint(0, 4)) + [f"r{rng.randrange(12)}" for _ in range(rng.randint(0, 1))]), rng.randrange(6)) for i in range(90)}
    events = spark.createDataFrame([(i, at) for i, (_, at) in sets.items()], "id string, last_active long").withColumn("timestamp", F.col("last_active"))
    involves = spark.createDataFrame([(i, e) for i, (es, _) in sets.items() for e in es], "event_id string, entity_id string")
    got = {}
    for r in recall.entity(events, events, involves, limit=4, popular=popular, widest=widest).collect():
        got.setdefault(r.query_id, []).append((-round(r.score, 9), -sets[r.cand_id][1], r.cand_id))
    for q, (own, _) in sets.items():
        scored = [(-round(len(set(own) & set(es)) / len(set(own) | set(es)), 9), -at, c) for c, (es, at) in sets.items() if c != q and set(own) & set(es)]
        assert sorted(got.get(q, [])) == sorted(scored)[:4]


def test_canonical_chains_of_any_length(spark):
    rows = [(f"m{i}", "merged", f"m{i + 1}") for i in range(40)] + [("m40", "active", None)]
    table = spark.createDataFrame(rows, "id string, status string, canonical_id string")
    assert {r.canonical for r in scans.canonical_ids(table, transitive=True).collect()} == {"m40"}
    involves = spark.createDataFrame([("e1", "m0", 1, 1, 1)], "event_id string, entity_id string, c_valid int, t_created long, t_valid long")
    pairs = spark.createDataFrame([("m40", "n", "r", 1.0)], "merged_id string, canonical_id string, reason string, score double")
    entities = table.union(spark.createDataFrame([("n", "active", None)], table.schema))
    assert [r.entity_id for r in mutations.merge_entities(entities, involves, pairs, 9)[1].collect()] == ["n"]


def test_references_are_united_once(spark):
    row = spark.range(1).select(F.expr("array(map('a', '1', 'b', '2'), map('c', '3'))").alias("x"), F.expr("array(map('b', '2', 'a', '1'), map('c', '4'))").alias("y"), F.expr("cast(null as array<map<string,string>>)").alias("z"))
    got = row.select(contexts.united(F.col("x"), F.col("y")).alias("xy"), contexts.united(F.col("z"), F.col("y")).alias("zy"), contexts.united(F.col("z"), F.col("z")).alias("zz")).first()
    assert got.xy == [{"a": "1", "b": "2"}, {"c": "3"}, {"c": "4"}] and got.zy == [{"a": "1", "b": "2"}, {"c": "4"}] and got.zz is None


def test_texts_are_cut_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the cat 猫和狗"), (2, "a dog"), (3, None)], "id long, text string")
    made = search._cut(docs, [F.col("id")], "text", T.tokens).select("id", F.size("words").alias("n"), search._times("words", "the").alias("a"), search._times("words", "dog").alias("b")).filter("a + b > 0")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    once = docs.select(T.tokens("text").alias("w"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == once.count("regexp_extract_all")
    index = search.write_index(search.build_index(docs))
    for query in ("the dog", "猫和", "none"):
        assert sorted(map(tuple, search.bm25(docs, query).collect())) == sorted(map(tuple, search.search_index(index, query).collect()))


def test_bigrams_of_any_characters(spark):
    for x in ("", "a", "ab", "a\nb", "猫和狗", "a😀b😀", "x" * 5000):
        want = [x[i : i + 2] for i in range(len(x) - 1)]
        assert list(spark.range(1).select(T.bigrams(F.lit(x)).alias("b")).first().b) == want


def test_loose_json_and_blobs():
    assert lines.loose_json('well: [1, {"a": {"b": {"c": {"d": 1}}}}] {"x": [1]}') == '{"a": {"b": {"c": {"d": 1}}}}'
    assert lines.loose_json("list [1, 2] end") == "[1, 2]" and lines.loose_json("[not json]") is None and lines.loose_json(None) is None
    assert lines.is_blob("data:image/png;base64,AAAA") and lines.is_blob("QUJD" * 60) and lines.is_blob("QUJD\n" * 60)
    assert not lines.is_blob("QUJD") and not lines.is_blob("a word, " * 60) and not lines.is_blob("data: plain") and not lines.is_blob(7)
    assert lines.flatten('{"uuid": "12345678-1234-1234-1234-123456789abc", "pk": "77", "id": "name", "other": "77"}') == "uuid: <id>\npk: <id>\nid: name\nother: 77"
