"""Entity resolution: mentions to registered entities, by name, then by vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import cosine
from ..functions.text import text
from .near import similar

HIGH, LOW, MARGIN, BUDGET, SNIPPET = 0.82, 0.55, 0.03, 8, 240
#: Stands for any type; no type is written so.
ANY = "\0"


def alias_index(entities: DataFrame) -> DataFrame:
    """(name, id): lower-case ids and aliases of registered entities."""
    none = F.expr("cast(array() as array<string>)")
    aliases = F.coalesce("aliases", none) if "aliases" in entities.columns else none
    names = F.array_distinct(F.transform(F.concat(F.array("id"), aliases), lambda a: F.lower(F.trim(a))))
    return entities.filter("registered").select(F.explode(names).alias("name"), "id").filter("name <> ''").distinct()


def mention_text(name="name", summary="summary"):
    """What a mention is embedded by."""
    snippet = F.substring(F.trim(text(summary)), 1, SNIPPET)
    return F.when(snippet != "", F.concat(F.trim(text(name)), F.lit(" | "), snippet)).otherwise(F.trim(text(name)))


def resolve(mentions: DataFrame, entities: DataFrame, arbiter=None, budget: int = BUDGET) -> DataFrame:
    """(name, id, reason, score) of the mentions that resolve; ``mentions``: name, type, embedding.

    One exact name or alias wins. Else (or among several exact ones) the most
    similar registered entity of a compatible type, if it is high and clear of
    the second; between low and high the arbiter decides (DataFrame of name,
    id, score -> with decision), at most ``budget`` mentions, by name. Vectors
    meet by signatures (``near.similar``), not each mention with each entity.
    """
    asked = mentions.withColumn("key", F.lower(F.trim(text("name")))).filter("key <> ''")
    hits = asked.select("key").distinct().join(alias_index(entities).withColumnRenamed("name", "key"), "key")
    hits = hits.withColumn("n", F.count("*").over(Window.partitionBy("key")))
    exact = hits.filter("n = 1").select("key", "id", F.lit("exact_match").alias("reason"), F.lit(1.0).alias("score"))
    open_ = asked.join(exact.select("key"), "key", "left_anti").filter("size(embedding) > 0").dropDuplicates(["key"])
    known = entities.filter("registered and size(description_embedding) > 0").select("id", F.upper(F.coalesce("type", F.lit("UNKNOWN"))).alias("etype"), "description_embedding")
    kind = F.upper(F.when(F.trim(text("type")) != "", F.trim(text("type"))).otherwise("UNKNOWN"))
    several = hits.filter("n > 1").select("key", "id", F.lit(True).alias("named"))
    has = several.select("key").distinct().withColumn("some", F.lit(True))
    # compatible types meet through one key each: an entity stands under its type and under any;
    # a mention of a type asks for the type and for the unknown one, a mention without asks for any
    under = known.withColumn("via", F.explode(F.array("etype", F.lit(ANY)))).drop("etype")
    via = F.when(kind == "UNKNOWN", F.array(F.lit(ANY))).otherwise(F.array(kind, F.lit("UNKNOWN")))
    least = LOW if arbiter is not None else HIGH - MARGIN  # what is less similar decides nothing
    asking = open_.join(has, "key", "left").select("key", "embedding", "some", F.explode(via).alias("scope"))
    free = asking.filter("some is null").select(F.concat_ws("\x01", "scope", "key").alias("id"), F.col("embedding").alias("v"), "scope")
    near = similar(under.select("id", F.col("description_embedding").alias("v"), F.col("via").alias("scope")), least, 2, free)
    by_vector = near.select(F.expr("substring(query_id, instr(query_id, '\x01') + 1)").alias("key"), "id", F.col("similarity").alias("score"))
    # several entities of one name: only these are compared
    by_name = asking.filter("some").join(several, "key").join(under, ["id"]).filter("scope = via").select("key", "id", cosine("embedding", "description_embedding").alias("score"))
    scored = by_vector.unionByName(by_name).filter("score > 0").dropDuplicates(["key", "id"])
    line = Window.partitionBy("key").orderBy(F.desc("score"), "id")
    top = scored.withColumns({"r": F.row_number().over(line), "second": F.coalesce(F.lead("score").over(line), F.lit(0.0))}).filter("r = 1")
    clear = (F.col("score") >= HIGH) & (F.col("score") - F.col("second") > MARGIN)
    out = exact.unionByName(top.filter(clear).select("key", "id", F.lit("vector_high").alias("reason"), "score"))
    if arbiter is not None:
        unsure = top.filter(~clear & (F.col("score") >= LOW)).orderBy("key").limit(budget).select("key", "id", "score")
        out = out.unionByName(arbiter(unsure).filter("decision = 'yes'").select("key", "id", F.lit("llm_yes").alias("reason"), "score"))
    return asked.select("key", "name").distinct().join(out, "key").select("name", "id", "reason", "score")
