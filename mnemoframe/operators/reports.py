"""Aggregations: graph statistics, quality and latency reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import safe_div


def graph_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n_rows) of every table."""
    return reduce(DataFrame.unionByName, [t.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("name"), "n_rows") for n, t in tables.items()])


def status_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("status").agg(F.count("*").alias("n_events"))


def latency(column: str = "latency_ms") -> list[Column]:
    """Mean and interpolated quantiles, 0 without rows."""
    q = lambda p: F.coalesce(F.percentile(column, F.lit(p)), F.lit(0.0))
    return [F.coalesce(F.avg(column), F.lit(0.0)).alias("latency_avg"), q(0.5).alias("latency_p50"), q(0.95).alias("latency_p95"), q(0.99).alias("latency_p99")]


def extraction_metrics(records: DataFrame) -> DataFrame:
    """Per overall, route and bucket in one pass: counts, ratios, weighted overlap, latency.

    ``records``: route, bucket, n_events, n_contexts, n_subject_events,
    overlap_sum, llm_calls, error, latency_ms. ``scope`` tells which grouping.
    """
    return records.sparkSession.sql(
        """
        SELECT CASE WHEN grouping(route) = 0 THEN 'route' WHEN grouping(bucket) = 0 THEN 'bucket' ELSE 'overall' END AS scope, route, bucket,
          count(*) AS n_records, sum(n_events) AS n_events, sum(n_contexts) AS n_contexts, count_if(n_events = 0) AS n_empty, count_if(error) AS n_errors,
          coalesce(try_divide(count_if(n_events = 0), count(*)), 0D) AS empty_rate, coalesce(try_divide(sum(n_events), count(*)), 0D) AS event_yield,
          coalesce(try_divide(sum(llm_calls), count(*)), 0D) AS llm_call_rate, coalesce(try_divide(sum(n_subject_events), sum(n_events)), 0D) AS subject_rate,
          coalesce(try_divide(sum(overlap_sum), sum(n_contexts)), 0D) AS mean_overlap,
          coalesce(avg(latency_ms), 0D) AS latency_avg, coalesce(percentile(latency_ms, 0.5), 0D) AS latency_p50, coalesce(percentile(latency_ms, 0.95), 0D) AS latency_p95, coalesce(percentile(latency_ms, 0.99), 0D) AS latency_p99
        FROM {records} GROUP BY GROUPING SETS ((), (route), (bucket))
        """,
        records=records,
    )


def route_distribution(records: DataFrame) -> DataFrame:
    n = F.count("*")
    out = records.groupBy("route").agg(n.alias("n_records"))
    return out.withColumn("rate", F.col("n_records") / F.sum("n_records").over(Window.partitionBy()))  # a row for each route


def validation(metrics: DataFrame, yields: dict[str, float] | None = None) -> DataFrame:
    """Named checks of an overall row against targets: name, value, target, passed."""
    checks = [("empty_rate", "<", 0.40), ("llm_call_rate", ">", 0.0), ("n_events", ">", 0.0), ("mean_overlap", ">", 0.50), ("n_errors", "=", 0.0)]
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value"), F.lit(t).alias("target"), {"<": F.col(n) < t, ">": F.col(n) > t, "=": F.col(n) == t}[op].alias("passed")) for n, op, t in checks])
    return metrics.filter("scope = 'overall'").select(F.explode(rows).alias("c")).select("c.*")


def comparison(run: DataFrame, baseline: DataFrame, names: list[str]) -> DataFrame:
    """name, value, baseline, delta, ratio of two one-row runs."""
    long = lambda df, v: df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias(v)) for n in names])).alias("x")).select("x.*")
    return long(run, "value").join(long(baseline, "baseline"), "name").withColumns({"delta": F.col("value") - F.col("baseline"), "ratio": safe_div(F.col("value"), F.col("baseline"))})


def reuse_summary(results: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, false links and latency, overall and by category.

    ``results``: category, expected, predicted (booleans), correct, latency_ms.
    """
    tp, fp, fn, tn = (F.count_if(F.col("expected").eqNullSafe(F.lit(e)) & F.col("predicted").eqNullSafe(F.lit(p))) for e, p in ((True, True), (False, True), (True, False), (False, False)))
    out = results.cube("category").agg(F.grouping("category").alias("all"), F.count("*").alias("n_cases"), safe_div(F.count_if("correct"), F.count("*")).alias("accuracy"), safe_div(tp, tp + fp).alias("precision"), safe_div(tp, tp + fn).alias("recall"), safe_div(fp, fp + tn).alias("false_link_rate"), *latency())
    return out.withColumn("scope", F.when(F.col("all") == 1, "overall").otherwise("category")).drop("all")


def summed(reports: DataFrame) -> DataFrame:
    """Counters of several reports added up, column by column."""
    numeric = [f.name for f in reports.schema if f.dataType.typeName() in ("integer", "long", "double", "float", "short")]
    return reports.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in numeric])


def summed_map(rows: DataFrame, column: str) -> DataFrame:
    """(key, total, average) of a map of numbers over all rows."""
    return rows.select(F.explode(column).alias("key", "value")).groupBy("key").agg(F.sum("value").alias("total"), F.avg("value").alias("average"))


#: Size of a sketch: a rank is off by about 0.7 % with 400.
SKETCH = 400
QUANTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def latency_sketches(records: DataFrame, run: str, keys: list[str], column: str = "latency_ms") -> DataFrame:
    """run, keys, n, total and a quantile sketch of each group: small rows to be stored, and merged later. Nulls count nowhere."""
    known = records.filter(F.col(column).isNotNull())
    return known.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col(column).cast("double")).alias("total"), F.kll_sketch_agg_double(F.col(column).cast("double"), F.lit(SKETCH)).alias("sketch")).select(F.lit(run).alias("run"), *keys, "n", "total", "sketch")


def merged_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of several runs, windows or groups as one of each key; the records are not read again."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.kll_merge_agg_double("sketch", F.lit(SKETCH)).alias("sketch"))


def sketched_latency(sketches: DataFrame) -> DataFrame:
    """Means and quantiles in place of the sketches."""
    quantiles = [F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(f"latency_{name}") for name, q in QUANTILES.items()]
    return sketches.select(*[c for c in sketches.columns if c not in ("total", "sketch")], safe_div(F.col("total"), F.col("n")).alias("latency_avg"), *quantiles)


def latency_comparison(sketches: DataFrame, run: str, baseline: str, keys: list[str]) -> DataFrame:
    """keys, name, value, baseline, delta, ratio of two stored runs; groups that one of them lacks are left out."""
    names = ["latency_avg", *[f"latency_{q}" for q in QUANTILES]]

    def long(which: str, value: str) -> DataFrame:
        rows = sketched_latency(merged_sketches(sketches.filter(F.col("run") == which), keys))
        return rows.select(*keys, F.explode(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])).alias("name", value))

    both = long(run, "value").join(long(baseline, "baseline"), [*keys, "name"])
    return both.withColumns({"delta": F.col("value") - F.col("baseline"), "ratio": safe_div(F.col("value"), F.col("baseline"))})
