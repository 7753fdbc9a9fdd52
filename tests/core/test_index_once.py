from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from mnemoframe.operators import search


def test_texts_are_cut_once_for_a_written_index(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(x):
        seen.add(1)
        return x

    once = F.udf(counted, StringType()).asNondeterministic()
    docs = spark.range(0, 60, 1, 3).select("id", F.concat(F.lit("the x"), F.col("id") % 7, F.lit(" the")).alias("text")).withColumn("text", once("text"))
    index = search.write_index(search.build_index(docs))
    assert seen.value == 60
    assert search.index_stats(index).first().asDict() == {"n_docs": 60, "avgdl": 3.0}
    assert {r.term: r.df for r in search.document_frequency(index).collect()} == {"the": 60} | {f"x{i}": len(range(i, 60, 7)) for i in range(7)}
    assert search.search_index(index, "x3", None).count() == len(range(3, 60, 7)) and index["postings"].agg(F.sum("tf")).first()[0] == 180
