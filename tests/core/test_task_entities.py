from pyspark.sql import functions as F

from mnemoframe.functions.text import event_text, matched_terms
from mnemoframe.operators import task_recall

from .test_operators import memory


def test_matching_entities_are_rows_and_no_literals(spark):
    graph = memory(spark)
    more = spark.range(60).select(F.concat(F.lit("Zone"), "id").alias("id"), F.lit("service").alias("type"), F.lit(True).alias("registered"), F.lit("a gateway").alias("description"), F.lit(None).cast("array<string>").alias("aliases"), F.lit("active").alias("status"), F.lit(None).cast("string").alias("canonical_id"))
    graph.entities = graph.entities.unionByName(more)
    found = task_recall.project(graph, "restart the Gateway with API_HOST on 8080")
    assert len(found["entities"]) == 61
    paths = task_recall.walk(graph, found)
    spark.conf.set("spark.sql.debug.maxToStringFields", 10_000)
    plan = [line for line in paths._jdf.queryExecution().logical().toString().splitlines() if "LocalRelation" not in line]
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert not [line[:200] for line in plan if "Zone7" in line]  # the first few may be literals, not all
    names = F.array(*[F.lit(t) for t in found["literals"] + found["lexical"] + found["entities"]])
    want = graph.events.filter("id = 'e1'").select(matched_terms(event_text(payload="payload"), names, loose=True).alias("m")).first().m
    row = paths.filter("memory_type = 'event' and entity_hits = 1").first()
    assert row.primary_id == "e1" and row.anchor_terms == want and row.literal_hits >= 1 and row.has_value
