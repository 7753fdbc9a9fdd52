import pytest
from pyspark.sql import functions as F

from mnemoframe.operators import contexts


def test_all_pairs_of_copies_and_a_chain(spark):
    copies = [(f"a{i:03}", f"a{j:03}", 1.0) for i in range(104) for j in range(i + 1, 104)]
    chain = [(f"b{i:03}", f"b{i + 1:03}", 0.9 - i / 1000) for i in range(103)]
    pairs = spark.createDataFrame(copies + chain, "canonical_id string, merged_id string, score double")
    used, greedy = set(), set()
    for r in sorted(pairs.withColumn("h", F.xxhash64("canonical_id", "merged_id")).collect(), key=lambda r: (-r.score, r.h, r.canonical_id, r.merged_id)):
        if not {r.canonical_id, r.merged_id} & used:
            used |= {r.canonical_id, r.merged_id}
            greedy.add((r.canonical_id, r.merged_id))
    found = [(r.canonical_id, r.merged_id) for r in contexts.disjoint_plan(pairs).collect()]
    assert len(found) == 104 and set(found) == greedy


def test_a_bound_is_an_error_and_ties_take_few_rounds(spark):
    copies = spark.createDataFrame([(f"a{i:03}", f"a{j:03}", 1.0) for i in range(60) for j in range(i + 1, 60)], "canonical_id string, merged_id string, score double")
    assert contexts.disjoint_plan(copies, rounds=20).count() == 30
    with pytest.raises(RuntimeError):
        contexts.disjoint_plan(copies, rounds=1)
    assert contexts.disjoint_plan(copies.limit(0)).count() == 0
