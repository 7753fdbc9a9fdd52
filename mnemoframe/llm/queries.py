"""The ``opN_`` queries: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, elkan, filter_audit, host_rules, kmtree, licenses, ppm, quotes, set_join, sst, substring, warc
from .oracles import QUOTING

RANKS = "byte_bpe_50k.tiktoken"
WORD_VOCABULARY = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return kmtree.Index(rows).search(rows.filter("vec_id % 100 = 0"))


def _linked(messages: DataFrame) -> DataFrame:
    found = quotes.link_quotes(messages)
    thread = F.array_join(F.transform("thread", lambda t: t.cast("string")), "/")
    return found.select("doc.conv_id", "doc.turn", "doc.role", "body", "reply_to", "linked", "n_quoted", "n_found", thread.alias("thread"))


def op2_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linked(table(spark, sf_dir, "conversations"))


def quoted_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotation linking where the given conversations quote: every turn's text with the turns it answers above it."""
    return _linked(spark.sql(QUOTING.replace("conversations", "{conversations}"), conversations=table(spark, sf_dir, "conversations")))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = ppm.learn_languages(docs)
    found = ppm.identify(docs.select("doc_id", "text"), trees, keep_text=False)
    return found.select("doc.doc_id", ppm.held_out("doc.doc_id").alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op4_sst_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sst.read_shards(sst.write_shards(docs, public_tokenizers.path(WORD_VOCABULARY))).drop("ids")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.remove_repeats(docs, keep_text=False).select("doc.doc_id", "n_words", "n_removed", "kept_sha256")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.similar_components(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.annotate(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(licenses.paths_of(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")))
    return found.select("doc.doc_id", "doc.path", "license", F.round("score", 6).alias("score"), "origin")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return byte_bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, keep_ids=False)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive_pages(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_elkan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the contract; see ``elkan.cluster`` for nulls, repeated ids, short and empty tables."""
    found = elkan.cluster(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """See ``filter_audit.audit`` for nulls, copies, repeated rows and empty tables."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The host of a document is its ``source``; see ``host_rules.judge`` for nulls, repeated rows and empty tables."""
    found = host_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep_text=False)
    return found.select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_kmeans_tree": op1_kmeans_tree,
    "op2_quotation_linking": op2_quotation_linking,
    "quoted_conversations": quoted_conversations,
    "op3_language_id": op3_language_id,
    "op4_sst_shards": op4_sst_shards,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_ngram_join": op6_ngram_join,
    "op7_decontamination": op7_decontamination,
    "op8_license_scan": op8_license_scan,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_warc": op10_warc,
    "op11_elkan": op11_elkan,
    "op12_filter_audit": op12_filter_audit,
    "op13_host_rules": op13_host_rules,
}
