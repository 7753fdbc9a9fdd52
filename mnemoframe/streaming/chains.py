"""Supersession over a stream, the same whatever order changes arrive in.

The state of an (entity, attribute) is a map of its versions. A change that
arrives late falls between two versions: the edge between these is taken back
and two edges take its place. ``settled`` sums up what was added and taken back,
which gives the edges of ``relations.supersession_chain`` over all changes.

State is bounded by the watermark: Spark drops changes older than it, so of the
versions before it only the newest is needed, as the one that the next change
follows. A timer removes the others; with ``forget`` it also removes a key's
last version once that has stood so long, and the key starts anew.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.relations import clean_states

CHANGES = "from_id string, to_id string, entity string, attribute string, value_before string, value_after string, op string"
_STORE, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def edge(old: tuple, new: tuple) -> tuple[str, str, str, str] | None:
    """(from, to, before, after) of two versions (at, id, after, before) that follow one another, if the second supersedes the first."""
    (_, old_id, old_after, _), (_, new_id, after, before) = old, new
    if old_id == new_id or not after or after == old_after or (before and old_after and before != old_after):
        return None
    return old_id, new_id, old_after or before, after


class Chain(StatefulProcessor):
    def __init__(self, forget_ms: int | None = None):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.versions = handle.getMapState("versions", "at long, id string", "after string, before string")

    def _held(self) -> list[tuple]:
        return sorted((k[0], k[1], v[0], v[1]) for k, v in self.versions.iterator())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self._held()
        for row in rows:
            new = (row["at"], row["id"], row["after"], row["before"])
            i = bisect_left(held, new[:2], key=lambda v: v[:2])
            if i < len(held) and held[i][:2] == new[:2]:
                continue  # a replay; of two rows of one id and time the first counts
            old, later = held[i - 1] if i else None, held[i] if i < len(held) else None
            held.insert(i, new)
            self.versions.updateValue(new[:2], new[2:])
            for a, b, op in ((old, later, "retract"), (old, new, "add"), (new, later, "add")):
                found = edge(a, b) if a and b else None
                if found:
                    yield Row(from_id=found[0], to_id=found[1], entity=key[0], attribute=key[1], value_before=found[2], value_after=found[3], op=op)
        self._wake(held, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark, held = timerValues.getCurrentWatermarkInMs(), self._held()
        past = [v for v in held if v[0] * 1000 < mark]
        gone = past[:-1]
        if self.forget_ms is not None and past == held and held and held[-1][0] * 1000 + self.forget_ms <= mark:
            gone = held
        for v in gone:
            self.versions.removeKey(v[:2])
        self._wake(held[len(gone) :], mark)
        yield from ()

    def _wake(self, held: list[tuple], mark: int) -> None:
        """One timer: when the second version is behind the watermark the first can go; a last one is forgotten later."""
        at = None
        if len(held) > 1:
            at = max(held[1][0] * 1000, mark) + 1
        elif held and self.forget_ms is not None:
            at = max(held[0][0] * 1000 + self.forget_ms, mark) + 1
        for known in list(self.handle.listTimers()):
            if known != at:
                self.handle.deleteTimer(known)
        if at is not None:
            self.handle.registerTimer(at)

    def close(self) -> None:
        pass


def supersession_stream(states: DataFrame, delay: str = "7 days", forget_seconds: int | None = None) -> DataFrame:
    """Edges added and taken back (CHANGES) as state changes (id, timestamp, entity, attribute, value_before,
    value_after) arrive in any order.

    Changes more than ``delay`` behind the newest are dropped by Spark, which
    counts them as rows dropped by the watermark. Blank entities, attributes
    and null times are left out, as in the batch. Start it within ``rocks``.
    """
    rows = clean_states(states).withColumn("event_time", F.timestamp_seconds("at")).withWatermark("event_time", delay)
    return rows.groupBy("entity", "attribute").transformWithState(Chain(None if forget_seconds is None else forget_seconds * 1000), CHANGES, "Append", "EventTime")


@contextmanager
def rocks(spark: SparkSession):
    """The state store that this processor needs, for the queries that start within; the session's own comes back."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)


def settled(changes: DataFrame) -> DataFrame:
    """The edges that stand: those added more often than taken back."""
    columns = [c for c in changes.columns if c != "op"]
    stands = F.sum(F.when(F.col("op") == "add", 1).otherwise(-1)) > 0
    return changes.groupBy(*columns).agg(stands.alias("stands")).filter("stands").drop("stands")
