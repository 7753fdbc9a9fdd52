from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from mnemoframe.operators import relations


def test_candidates_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(x):
        seen.add(1)
        return x

    once = F.udf(counted, StringType()).asNondeterministic()
    rows = [("q", f"c{i}", 0.5, 1.0, 5, {"state": 1.0}) for i in range(3)]
    candidates = spark.createDataFrame(rows, "query_id string, cand_id string, aggregate_score double, channel_score double, cand_at long, channels map<string,double>").withColumn("cand_id", once("cand_id"))
    events = spark.createDataFrame([("q", "active", "c0"), ("c0", "active", ""), ("c1", "active", "q"), ("c2", "active", "c0")], "id string, status string, parent_event_id string")
    states = spark.createDataFrame([("q", 5, "u", "port", None, "25"), ("c2", 1, "u", "port", None, "20")], "id string, timestamp long, entity string, attribute string, value_before string, value_after string")
    done = relations.process(candidates, events, states, spark.createDataFrame([], "event_id string, context_id string")).collect()
    assert sorted((r.cand_id, r.operation, r.status) for r in done) == [("c0", "co_recall", "executed"), ("c1", "co_recall", "executed"), ("c2", "supersedes", "executed")]
    assert seen.value == 3


def test_a_parent_that_is_no_event_counts_for_nothing(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "gone"), ("c", "d"), ("d", "c")], "new_id string, old_id string")
    events = spark.createDataFrame([("a", "gone"), ("b", " a "), ("c", "d"), ("d", "c")], "id string, parent_event_id string")
    found = sorted((r.new_id, r.old_id, r.direction) for r in relations.explicit_references(pairs, events).collect())
    assert found == [("a", "b", "new_to_candidate"), ("b", "a", "candidate_to_new"), ("c", "d", "candidate_to_new"), ("d", "c", "candidate_to_new")]
