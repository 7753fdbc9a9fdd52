"""Benchmark decontamination by a broadcast hash set of n-grams, DataFrame functions only.

Words of both sides are normalised alike. Every window of ``size`` words of a
benchmark item (or the whole item, if shorter) becomes a row of the hash set:
hash, words, item ids. Documents are scanned once for hits: the windows' hashes
are made in one lambda per text, probed against the set, and hits are verified
word by word. Only hits are shuffled, then joined to the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: After lower-casing A-Z, all other ASCII than 0-9 and a-z separates words.
_GAP = r"[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]"
_CASED = r"[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"
_CASED_GAP = r"[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"

#: Most windows that are broadcast (some 100 bytes each); beyond, a shuffle join.
BROADCAST_WINDOWS = 500_000


def words_of(text: str) -> Column:
    """Array of the normalised words of a column; null has none."""
    # an ASCII text has as many characters as bytes, and then lower() is exact and fast
    lowered = f"if(length({text}) = octet_length({text}), lower({text}), translate({text}, '{_UPPER}', '{_LOWER}'))"
    return F.expr(f"coalesce(filter(split({lowered}, '{_GAP}+'), w -> w <> ''), cast(array() as array<string>))")


def _windows(words: str, size: int) -> str:
    """Hashes of all windows of ``size`` words, in order; none if there are fewer."""
    return f"if(size({words}) < {size}, cast(array() as array<bigint>), transform(sequence(1, size({words}) - {size - 1}), i -> xxhash64(slice({words}, i, {size}))))"


def window_set(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = 10) -> DataFrame:
    """Distinct windows: hash, len, words, items (ids, nulls left out)."""
    items = benchmark.select(F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("text")).select("item", words_of("text").alias("words")).filter("size(words) > 0")
    cut = f"transform(sequence(1, greatest(size(words) - {size - 1}, 1)), i -> slice(words, i, {size}))"
    rows = items.select("item", F.explode(F.expr(cut)).alias("words"))
    sets = rows.groupBy("words").agg(F.collect_set("item").alias("items"))
    return sets.select(F.xxhash64("words").alias("hash"), F.size("words").alias("len"), "words", "items")


def find_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 10) -> DataFrame:
    """Verified hits of each distinct (id, text): id, hash (of the text), spans,
    items. ``spans`` are the hit windows in order, as (start, len) in words."""
    held = window_set(benchmark, item_col, item_text_col, size)
    stats = held.groupBy("len").count().collect()  # at most ``size`` rows
    sizes = sorted(r["len"] for r in stats) or [size]
    small = sum(r["count"] for r in stats) <= BROADCAST_WINDOWS
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    arrays = ", ".join(f"struct({n} as len, {_windows('words', n)} as hashes)" for n in sizes)
    scanned = source.select("id", F.xxhash64("text").alias("text_hash"), words_of("text").alias("words")).select("id", "text_hash", "words", F.explode(F.expr(f"array({arrays})")).alias("w"))
    placed = scanned.select("id", "text_hash", "words", F.col("w.len").alias("doc_len"), F.posexplode("w.hashes").alias("pos", "hash"))
    held, own = held.withColumnRenamed("words", "window"), F.expr("slice(words, pos + 1, doc_len)").alias("own")
    if small:  # only hits reach the comparison, and no row leaves its task before
        met = placed.join(F.broadcast(held), "hash").filter(own == F.col("window"))
    else:  # a shuffled row carries its window, never the text
        met = placed.select("id", "text_hash", "pos", "hash", own).join(held, "hash").filter("own = window")
    return met.groupBy("id", "text_hash").agg(F.array_sort(F.collect_set(F.struct(F.col("pos").alias("start"), "len"))).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))


def annotate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 10) -> DataFrame:
    """Contamination of every row.

    Words: A-Z lower-cased, runs of 0-9, a-z and all non-ASCII characters. Every
    word in an occurrence of a window is hit. Returns doc (struct of all input
    columns, whatever their names), n_words, n_hit, spans, items, n_items,
    items_sha256 (of the ids sorted as strings, comma-joined), contaminated.
    Null, empty and unworded texts have no words and no hits; rows of equal id
    are judged by their own text; items without words or ids match nothing or
    list nothing; empty tables give no rows or no hits.
    """
    hits = find_hits(docs, benchmark, id_col, text_col, item_col, item_text_col, size)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(id_col).alias("id0"), F.xxhash64(text).alias("hash0"), text.alias("text0"))
    rows = rows.select("doc", "id0", "hash0", F.size(words_of("text0")).cast("long").alias("n_words"))
    both = rows.join(hits, F.col("id0").eqNullSafe(F.col("id")) & (F.col("hash0") == F.col("text_hash")), "left")
    union = "aggregate(spans, struct(0 as until, 0L as n), (a, s) -> struct(greatest(a.until, s.start + s.len) as until, a.n + greatest(0, s.start + s.len - greatest(a.until, s.start)) as n), a -> a.n)"
    ids = F.expr("array_join(array_sort(transform(items, i -> cast(i as string))), ',')")
    out = both.select("doc", "n_words", F.coalesce(F.expr(union), F.lit(0)).cast("long").alias("n_hit"), "spans", "items", F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.sha2(F.coalesce(ids, F.lit("")), 256).alias("items_sha256"))
    out = out.withColumn("n_items", F.when(F.col("items").isNull(), 0).otherwise(F.col("n_items")).cast("long"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """``docs`` without what leaks: ``remove="spans"`` cuts the hit words, each
    with what separates it from the next; ``"documents"`` drops the rows. Same
    columns; clean rows are untouched."""
    found = annotate(docs, benchmark, id_col, text_col, **more)
    if remove == "documents":
        return found.filter(~F.col("contaminated")).select("doc.*")
    if remove != "spans":
        raise ValueError("remove is 'spans' or 'documents'")
    text = f"doc.`{text_col}`"
    pieces = f"regexp_extract_all({text}, '{_CASED}+{_CASED_GAP}*', 0)"
    kept = f"array_join(filter({pieces}, (p, i) -> not exists(spans, s -> i >= s.start and i < s.start + s.len)), '')"
    cut = F.expr(f"concat(regexp_extract({text}, '^{_CASED_GAP}*', 0), {kept})")
    columns = [F.when(F.col("contaminated"), cut).otherwise(F.col(text)).alias(c) if c == text_col else F.col(f"doc.`{c}`") for c in docs.columns]
    return found.select(*columns)
