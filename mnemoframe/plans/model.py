"""Tables of the memory graph, their defaults and vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import col, text

#: Table -> columns. Times are unix seconds, scores doubles, payloads JSON text.
SCHEMAS = {
    "episodes": "id string, content string, timestamp long, metadata map<string,string>",
    "events": "id string, summary string, action string, causality string, time_range struct<start:long,end:long,display_time_bucket:string>, last_active long, participants array<struct<role:string,seat:string,id:string,name:string,type:string>>, evidence array<struct<source:string,snippet:string,timestamp:long,confidence:double>>, embedding array<float>, timestamp long, created_at long, updated_at long, valid_from long, valid_to long, status string, support_count long, payload string",
    "entities": "id string, type string, registered boolean, description string, aliases array<string>, description_embedding array<float>, name_embedding array<float>, merged_from array<string>, metadata map<string,string>, status string, canonical_id string, created_at long, updated_at long",
    "contexts": "id string, context_type string, subtype string, summary string, description string, subject string, condition string, facts map<string,string>, applies_when string, confidence double, support_count long, created_at long, updated_at long, valid_from long, valid_to long, last_seen_at long, status string, source_refs array<map<string,string>>, merged_from array<string>, embedding array<float>",
    "patterns": "id string, entity_id string, content string, created_at long, updated_at long",
    "users": "id string",
    "involves": "event_id string, entity_id string, t_created long, t_expired long, t_valid long, t_invalid long, c_valid long",
    "extracted_from": "event_id string, episode_id string",
    "in_rel": "event_id string, context_id string, confidence double, weight double, original_signal string, evidence_span string, created_at long, updated_at long",
    "event_relation": "from_id string, to_id string, relation_type string, operation string, description string, confidence double, evidence_span string, value_before string, value_after string, source_episode_id string, source_session_id string, recall_channel string, recall_score double, created_at long, updated_at long",
    "event_merge_trace": "source_id string, target_id string, merge_reason string, similarity_score double, merged_at long, strategy_version string",
    "entity_merge_trace": "source_id string, target_id string, merge_reason string, similarity_score double, merged_at long, strategy_version string",
    "permanent_trait": "user_id string, event_id string, t_created long",
}

SAME_TOPIC, MEANING_UPDATE, SHARED_CONTEXT = "同一主题", "意义更新", "共同背景"
RELATION_TYPES = [SAME_TOPIC, MEANING_UPDATE, SHARED_CONTEXT]
#: Older names of relation types; one is dropped.
RELATION_ALIASES = {
    SAME_TOPIC: ["同一事件", "同一件事", "merge"],
    MEANING_UPDATE: ["更新", "覆盖", "修正", "update"],
    SHARED_CONTEXT: ["补充", "导致", "延续", "因果", "触发", "前置条件", "促成", "后续", "演进", "extend", "link"],
    "": ["时序相邻"],
}
#: What a context's subtype may be called; all other names are situations.
SUBTYPES = {"constraint": ["constraint", "limit", "restriction", "resource"], "environment": ["environment", "external_environment", "env"]}
CONTEXT_STATUSES = ["active", "weakened", "deprecated", "merged"]
DEPRECATED_NAMES = ["inactive", "archived", "removed"]


def tables(spark: SparkSession) -> dict[str, DataFrame]:
    """All tables, empty."""
    return {name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()}


def conform(df: DataFrame, table: str) -> DataFrame:
    """``df`` with exactly the table's columns: missing ones null, types cast, extra ones dropped."""
    want = StructType.fromDDL(SCHEMAS[table])
    return df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want])


def relation_type(x: Column | str) -> Column:
    """The canonical relation type; '' if unknown or dropped."""
    name = F.trim(text(x))
    out = F.when(name.isin(RELATION_TYPES), name)
    for canonical, aliases in RELATION_ALIASES.items():
        out = out.when(name.isin(aliases), canonical)
    return out.otherwise("")


def context_subtype(x: Column | str) -> Column:
    name = F.translate(F.lower(F.trim(text(x))), " -", "__")
    out = None
    for canonical, aliases in SUBTYPES.items():
        out = F.when(name.isin(aliases), canonical) if out is None else out.when(name.isin(aliases), canonical)
    return out.otherwise("situation")


def context_status(x: Column | str) -> Column:
    name = F.lower(F.trim(text(x)))
    return F.when(name.isin(DEPRECATED_NAMES), "deprecated").when(name.isin(CONTEXT_STATUSES), name).otherwise("active")


def with_event_defaults(events: DataFrame) -> DataFrame:
    """Fills times from one another, the id from the summary, status and support."""
    known = lambda *xs: F.coalesce(*[F.when(col(x) != 0, col(x)) for x in xs])
    out = events.withColumn("timestamp", known("timestamp", "last_active")).withColumn("last_active", known("last_active", "timestamp"))
    out = out.withColumn("created_at", known("created_at", "timestamp")).withColumn("updated_at", known("updated_at", "last_active", "timestamp")).withColumn("valid_from", known("valid_from", "timestamp"))
    return out.withColumns({"id": F.coalesce(F.when(text("id") != "", F.col("id")), F.sha2(text("summary"), 256)), "status": F.coalesce("status", F.lit("active")), "support_count": F.coalesce("support_count", F.lit(1))})
