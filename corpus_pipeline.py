"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. ``run`` writes each stage's result to the
shared folder and hands it to the next.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoframe.llm import byte_bpe, decontaminate, ppm, set_join, substring
from mnemoframe.llm.storage import written

#: A text is rejected if no language's code for it is shorter than its bytes are
#: (prose takes 2 to 4 bits a byte, also with a key or a number in it), or if no
#: language leads.
MOST_BITS, LEAST_SCORE = 8.0, 0.5


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what is in one of the learned languages.

    Learns from the texts of ``docs`` themselves that name a language. Null and
    empty texts, and those without a letter, are in none and go; so does all of
    a table that names no language. Repeated rows stay repeated, texts of any
    length are read whole, an empty table gives none; columns of any name stay.
    """
    found = ppm.identify(docs, ppm.learn_languages(docs))
    kept = (F.col("lang_pred") != ppm.UNDETERMINED) & (F.col("bits_per_byte") <= MOST_BITS) & (F.col("score") >= LEAST_SCORE)
    return found.filter(kept).select(*[F.col(c) if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns])


def _first_of_repeats(rows: DataFrame) -> DataFrame:
    """Of rows of one id and text the one whose columns, as JSON, come first in order; nulls are equal."""
    columns = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    picked = rows.select(F.col("doc_id").alias("k0"), F.col("text").alias("k1"), columns.alias("row")).withColumn("as_json", F.to_json("row"))
    return picked.groupBy("k0", "k1").agg(F.min_by("row", "as_json").alias("row")).select("row.*")


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest document of each group of near duplicates (five-word
    shingles, similarity 0.75 or more; ties of ids by the text's hash).

    Of rows of one id and text one stays, the first in order of its columns as
    JSON. Null and empty texts are in no group and stay, one of an id; a null id
    is the smallest. Texts of any length are compared whole; an empty table
    gives none; columns of any name stay.
    """
    groups = written(set_join.similar_components(docs, keys=True), "near-duplicates")
    smallest = groups.filter("group_id is not null").groupBy("group_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("k"))
    alone = groups.filter("group_id is null").select(F.struct("doc_id", "text_hash").alias("k"))
    stay = smallest.select("k").union(alone).distinct().select(F.col("k.doc_id").alias("id"), F.col("k.text_hash").alias("hash"))
    same = lambda left, right: F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.id")) & (F.xxhash64(F.col(f"{left}.text").cast("string")) == F.col(f"{right}.hash"))
    counts = groups.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    repeated = written(counts.alias("rows").join(stay.alias("stay"), F.col("rows.id").eqNullSafe(F.col("stay.id")) & (F.col("rows.hash") == F.col("stay.hash")), "left_semi"), "repeats")
    kept = docs.alias("doc").join(stay.alias("stay"), same("doc", "stay"), "left_semi")
    if repeated.isEmpty():
        return kept
    once = kept.alias("doc").join(repeated.alias("more"), same("doc", "more"), "left_anti")
    return once.unionByName(_first_of_repeats(kept.alias("doc").join(repeated.alias("more"), same("doc", "more"), "left_semi")))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 20 words and more that start earlier in the corpus.

    No document goes; of one cut whole an empty text stays. Null texts stay
    null or empty, repeated rows are cut as later ones; an empty table gives
    none; columns of any name stay, and n_chars follows the text.
    """
    found = substring.remove_repeats(docs)
    return _sized(found.select(*[F.col("kept_text").alias(c) if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the passages that benchmark items share.

    Null and empty texts share nothing; clean texts, whatever their length, stay
    as they are; repeated rows are cut alike; an empty table gives none, an
    empty benchmark cuts none; columns of any name stay, n_chars follows the text.
    """
    return _sized(decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left: a row for each row, in whole texts.

    A null text counts as the empty one, which has no ids; repeated rows give
    repeated rows; an empty table gives none; other columns are not read.
    """
    return byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("ngram_join", ngram_join),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("byte_level_bpe", byte_level_bpe),
]

#: SQL can express neither the language model nor the tokenizer; the tests
#: compare ``run`` with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each result written to the shared folder and read by the next; nulls, repeats,
    long texts and empty tables as each stage says."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
