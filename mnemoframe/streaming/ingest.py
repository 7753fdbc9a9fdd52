"""Streams of observations into the memory graph.

Each micro-batch is written as one version, so a replayed batch (same batch id)
changes nothing. Everything past the batch is a declared query; the state of
windows, sessions and repeated ids is bounded by their watermarks. Supersession
over a stream stands in ``chains``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import event_key
from ..functions.text import text
from ..plans.model import conform, with_event_defaults
from ..sources.tables import Namespace


def events_from(records: DataFrame, extract: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Event rows of episodes (id, content, timestamp). ``extract`` adds summary, action, causality and event_index;
    the default takes the content as one event. Ids repeat for repeated input; events without any text are dropped."""
    if extract is None:
        rows = records.withColumns({"summary": F.trim(text("content")), "action": F.lit(""), "causality": F.lit(""), "event_index": F.lit(0)})
    else:
        rows = extract(records)
    rows = rows.withColumns({"summary": F.coalesce(F.when(F.trim(text("summary")) != "", F.trim("summary")), F.when(text("action") != "", F.col("action")), text("causality"))}).filter("summary <> ''")
    ids = rows.withColumns({"episode_id": F.col("id"), "id": event_key("summary", "timestamp", "id", "event_index"), "last_active": F.col("timestamp")})
    return with_event_defaults(conform(ids, "events")).join(ids.select("id", "episode_id"), "id")


def ingest(stream: DataFrame, space: Namespace, checkpoint: str, extract=None, evolve: Callable[[DataFrame, int], None] | None = None, once: bool = True):
    """Starts the query: each batch adds its episodes, new events and their edges; ``evolve`` runs after each batch."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        rows = rows.persist()
        try:
            if rows.isEmpty():
                return
            found = events_from(rows, extract).persist()
            new = found.join(space.read("events").select("id"), "id", "left_anti").dropDuplicates(["id"])
            edges = found.select(F.col("id").alias("event_id"), "episode_id").distinct()
            known = space.read("episodes").select("id")
            links = edges.join(space.read("extracted_from"), ["event_id", "episode_id"], "left_anti")
            # nodes first: a batch that is replayed after a failure adds what is missing
            space.append("episodes", rows.dropDuplicates(["id"]).join(known, "id", "left_anti"))
            space.append("extracted_from", links)
            space.append("events", new)
            if evolve is not None:
                evolve(found, batch_id)
            found.unpersist()
        finally:
            rows.unpersist()

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(stream: DataFrame, time_col: str, key: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per window and key; rows later than the watermark are dropped by Spark."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, window), key).agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, time_col: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Episodes of activity: runs of a key's events with gaps below ``gap``."""
    return stream.withWatermark(time_col, late).groupBy(F.session_window(time_col, gap), key).agg(F.count("*").alias("n"), F.min(time_col).alias("first"), F.max(time_col).alias("last"))


def unique_episodes(stream: DataFrame, time_col: str, ttl: str = "1 hour") -> DataFrame:
    """Each id once within its time to live."""
    return stream.withWatermark(time_col, ttl).dropDuplicatesWithinWatermark(["id"])
