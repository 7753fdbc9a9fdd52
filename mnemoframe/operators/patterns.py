"""Recall from markdown documents by section."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import section_score, sections, text, tokens

SEPARATOR, FULL_CHARS, TOP_SECTIONS = "\n\n---\n\n", 2000, 3


def recall_patterns(patterns: DataFrame, query: str = "", mode: str = "auto", top_k: int = TOP_SECTIONS, full_chars: int = FULL_CHARS) -> DataFrame:
    """entity_id, mode, content, total_chars, matched_sections for every document.

    ``auto``: whole without a query or below ``full_chars``, else by section.
    By section: the ``top_k`` best that score, in the order of the document.
    """
    q = query.strip()
    body = text("content")
    effective = F.lit(mode) if mode in ("full", "section") else F.when(F.lit(bool(q)) & (F.length(body) >= full_chars), "section").otherwise("full")
    asked = tokens(F.lit(q))
    base = patterns.select("entity_id", body.alias("whole"), F.length(body).alias("total_chars"), effective.alias("mode"))
    cut = base.filter("mode = 'section'").select("entity_id", F.posexplode(sections("whole")).alias("pos", "s")).select("entity_id", "pos", "s.*")
    scored = cut.withColumn("score", section_score(F.col("heading"), F.col("body"), asked)).filter("score > 0")
    rank = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("score"), "pos"))
    out = F.concat_ws("\n", F.when(F.col("heading") != "", F.col("heading")), F.when(F.col("body") != "", F.col("body")))
    best = scored.withColumn("r", rank).filter(F.col("r") <= max(1, top_k)).withColumn("out", out)
    best = best.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("char_offset", "heading", "score", "out"))).alias("m"))
    found = base.join(best, "entity_id", "left")
    none = F.expr("cast(array() as array<struct<heading:string,score:int,char_offset:int>>)")
    picked = F.transform("m", lambda e: F.struct(e["heading"].alias("heading"), e["score"].alias("score"), e["char_offset"].alias("char_offset")))
    content = F.when(F.col("mode") == "full", F.col("whole")).otherwise(F.coalesce(F.array_join(F.transform("m", lambda e: e["out"]), SEPARATOR), F.lit("")))
    return found.select("entity_id", "mode", content.alias("content"), "total_chars", F.coalesce(picked, none).alias("matched_sections"))
