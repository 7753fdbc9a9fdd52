"""BM25 search: over documents directly, or over a maintained index.

A query needs only its own terms' document frequencies and the mean length. The
direct form reads the texts once: these are observed while the documents that
hold a term are written, with their lengths and counts, and the scores follow
from that: no shuffle, and no row for a document without a hit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import once, text, tokens
from ..sources.shared import written

K1, B = 1.5, 0.75
#: Parts of a term's postings, so that a frequent one fills no task.
SPREAD = 32


def query_terms(spark: SparkSession, query: str, cut=tokens) -> list[str]:
    """The query's tokens, repeated ones repeated."""
    return list(spark.range(1).select(cut(F.lit(query)).alias("t")).first()["t"]) if query else []


def _weight(n: int, df: int) -> float:
    return math.log(1.0 + (n - df + 0.5) / (df + 0.5))


def _score(tf: Column, length: Column, average: float, idf: float) -> Column:
    return F.when(tf > 0, F.lit(idf) * (tf * (K1 + 1.0)) / (tf + K1 * (1.0 - B + B * length / (average or 1.0)))).otherwise(F.lit(0.0))


def _times(words: str, term: str) -> Column:
    return (F.size(words) - F.size(F.array_remove(words, term))).cast("double")


def _cut(docs: DataFrame, columns: list[Column], text_expr: Column | str, cut) -> DataFrame:
    """The columns and ``words``, cut once: a filter or a projection is not pushed through the generator and so cannot repeat the cutting."""
    return docs.select(*columns, F.explode(F.array(cut(text_expr))).alias("words"))


def bm25(docs: DataFrame, query: str, top_k: int | None = 5, id_col: str = "id", text_expr: Column | str = "text", recency: str | None = None, cut=tokens) -> DataFrame:
    """(id, score): Okapi with k1 1.5 and b 0.75, positive scores only, best first.

    Ties: the more recent (if a column is given), then the smaller id. Repeated
    query terms count repeatedly. ``top_k=None`` keeps all.
    """
    terms = query_terms(docs.sparkSession, query, cut)
    schema = [F.col(id_col).alias("id"), *([F.col(recency).alias("recency")] if recency else [])]
    if not terms or (top_k is not None and top_k <= 0):
        return docs.limit(0).select(*schema[:1], F.lit(0.0).alias("score"))
    distinct = sorted(set(terms))
    counts = _cut(docs, schema, text_expr, cut).select(*[c for c in ("id", "recency")[: len(schema)]], F.size("words").alias("length"), F.array(*[_times("words", t) for t in distinct]).alias("tf"))
    seen = Observation()
    counts = counts.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("avg"), *[F.count_if(F.col("tf")[i] > 0).alias(f"df{i}") for i in range(len(distinct))])
    counts = written(counts.filter(F.exists("tf", lambda n: n > 0)), "term-counts")
    stats = seen.get
    score = F.lit(0.0)
    for i, t in enumerate(distinct):
        score = score + terms.count(t) * _score(F.col("tf")[i], F.col("length").cast("double"), stats["avg"], _weight(stats["n"], stats[f"df{i}"]))
    scored = counts.withColumn("score", score).filter("score > 0")
    order = [F.desc("score"), *([F.desc("recency")] if recency else []), F.asc("id")]
    return (scored if top_k is None else scored.orderBy(*order).limit(top_k)).select("id", "score")


def _counted(words: Column) -> Column:
    """array<struct(term, tf)>: sorted, equal words stand together, so a document's words are counted within its row."""
    def runs(w: Column) -> Column:
        new = lambda i: (i == 1) | (F.element_at(w, i) != F.element_at(w, F.greatest(i - 1, F.lit(1))))
        starts = F.filter(F.sequence(F.lit(1), F.size(w)), new)
        return once(starts, lambda at: F.transform(at, lambda s, k: F.struct(F.element_at(w, s).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(w) + 1) - s).cast("long").alias("tf"))))

    return F.when(F.size(words) > 0, once(F.sort_array(words), runs)).otherwise(F.expr("cast(array() as array<struct<term:string,tf:bigint>>)"))


def _index(whole: DataFrame, lengths: DataFrame | None = None) -> dict[str, DataFrame]:
    return {"postings": whole.filter("term <> ''").select("id", "term", "tf", "length"), "lengths": whole.filter("term = ''").select("id", "length") if lengths is None else lengths, "whole": whole}


def build_index(docs: DataFrame, id_col: str = "id", text_expr: Column | str = "text", cut=tokens) -> dict[str, DataFrame]:
    """postings(id, term, tf, length), lengths(id, length), and ``whole``: both in one table, in which each document has
    a row of the empty term besides, so that what is written is cut once and documents without words count."""
    words = _cut(docs, [F.col(id_col).alias("id")], text_expr, cut)
    none = F.expr("array(named_struct('term', '', 'tf', 0L))")
    rows = words.select("id", F.size("words").alias("length"), F.explode(F.concat(none, _counted(F.col("words")))).alias("p"))
    return _index(rows.select("id", "p.term", "p.tf", "length"), words.select("id", F.size("words").alias("length")))


def write_index(index: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The index as one table in the shared folder, each term in up to ``SPREAD`` files in which it stands together, so
    a search reads its terms' pages. Dealt by hash: a range would cut all texts once more, to draw its bounds."""
    dealt = index["whole"].repartition("term", F.pmod(F.xxhash64("id"), F.lit(SPREAD)))
    return _index(written(dealt.sortWithinPartitions("term"), "postings"))


def remove_from_index(index: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    gone = ids.select("id").distinct()
    return _index(*[index[name].join(gone, "id", "left_anti").select(*index[name].columns) for name in ("whole", "lengths")])


def add_to_index(index: dict[str, DataFrame], docs: DataFrame, **more) -> dict[str, DataFrame]:
    """Adds documents, replacing those of the same id."""
    new = build_index(docs, **more)
    old = remove_from_index(index, new["lengths"])
    return _index(*[old[name].unionByName(new[name]) for name in ("whole", "lengths")])


def index_stats(index: dict[str, DataFrame]) -> DataFrame:
    """One row: documents, mean length."""
    return index["lengths"].agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("avgdl"))


def document_frequency(index: dict[str, DataFrame]) -> DataFrame:
    return index["postings"].groupBy("term").agg(F.count("*").alias("df"))


def search_index(index: dict[str, DataFrame], query: str, top_k: int | None = 5, cut=tokens) -> DataFrame:
    """Like ``bm25``, from the index: only the query terms' postings are read."""
    spark = index["postings"].sparkSession
    terms = query_terms(spark, query, cut)
    stats = index_stats(index).first()
    hit = index["postings"].filter(F.col("term").isin(sorted(set(terms))))
    df = {r["term"]: r["df"] for r in hit.groupBy("term").agg(F.count("*").alias("df")).collect()}  # a row for each query term
    weights = spark.createDataFrame([(t, float(terms.count(t) * _weight(stats["n_docs"], n))) for t, n in df.items()], "term string, idf double")
    part = F.col("idf") * (F.col("tf") * (K1 + 1.0)) / (F.col("tf") + K1 * (1.0 - B + B * F.col("length") / (stats["avgdl"] or 1.0)))
    scored = hit.join(F.broadcast(weights), "term").groupBy("id").agg(F.sum(part).alias("score")).filter("score > 0")
    return scored if top_k is None else scored.orderBy(F.desc("score"), "id").limit(top_k)


def corpus_frequency(documents: list[DataFrame], cut=tokens) -> DataFrame:
    """(term, df) over the union of text columns named ``text``; blank texts are left out."""
    every = documents[0].select("text")
    for d in documents[1:]:
        every = every.union(d.select("text"))
    return every.filter(F.trim(text("text")) != "").select(F.explode(F.array_distinct(cut("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
