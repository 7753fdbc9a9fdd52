"""Versioned tables in a namespace: one folder a database, one a table.

Parquet tables have no updates in place. A version is a list of parts, folders
of files that never change: a write makes one new part, an append adds one, an
upsert or a deletion adds a part of changed rows or gone keys. Readers lay later
parts over earlier ones by key, so a change of ten rows writes ten rows. After
MAX_CHANGES such parts, or MAX_PARTS appends, the rows are written anew as one.

The pointer to a version is one small file under the version's number, made
whole under another name and then linked to its own, which fails where that is
taken: readers see whole versions, a lost writer leaves the last one, and of two
writers of one number the later one starts again from the newer list (append,
upsert, delete) or fails (write). Stores without an atomic rename need a lock
around their writers.
"""

from __future__ import annotations

import json
import os
import re
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.measures import row_hash
from ..plans.model import SCHEMAS, conform

MAX_PARTS, MAX_CHANGES, MAX_TRIES, KEEP = 64, 16, 1000, 256


class Taken(RuntimeError):
    """Another writer made the version."""


class Namespace:
    """The tables of one database."""

    def __init__(self, spark: SparkSession, root: str, name: str = "default"):
        self.spark, self.path = spark, f"{root.rstrip('/')}/{name}"

    def _store(self, path: str):
        there = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return there.getFileSystem(self.spark._jsc.hadoopConfiguration()), there

    def _numbers(self, table: str) -> list[int]:
        """Of the versions, by the names of their pointers; no job runs for it."""
        store, folder = self._store(f"{self.path}/{table}/_versions")
        if not store.exists(folder):
            return []
        names = [f.getPath().getName() for f in store.listStatus(folder)]
        return sorted(int(n[1:13]) for n in names if re.fullmatch(r"v\d{12}\.json", n))

    def _version(self, table: str, number: int) -> dict:
        store, path = self._store(f"{self.path}/{table}/_versions/v{number:012d}.json")
        stream = store.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _newest(self, table: str) -> dict | None:
        numbers = self._numbers(table)
        return self._version(table, numbers[-1]) if numbers else None

    def versions(self, table: str) -> DataFrame:
        """(version, at, parts, number), a row a version."""
        known = [self._version(table, n) for n in self._numbers(table)]
        return self.spark.createDataFrame([(v["version"], v["at"], [p["part"] for p in v["parts"]], v["number"]) for v in known], "version string, at long, parts array<string>, number long")

    def current(self, table: str) -> str | None:
        newest = self._newest(table)
        return newest["version"] if newest else None

    def read(self, table: str, version: str | None = None) -> DataFrame:
        """The newest version (or a given one); missing columns are null, an unwritten table is empty."""
        held = next((v for v in (self._version(table, n) for n in self._numbers(table)) if v["version"] == version), None) if version else self._newest(table)
        if held is None:
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self._rows(table, held["parts"])

    def _files(self, table: str, parts: list[dict]) -> DataFrame:
        found = self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.path}/{table}/{p['part']}" for p in parts])
        return conform(found, table) if table in SCHEMAS else found

    def _rows(self, table: str, parts: list[dict]) -> DataFrame:
        """Each row that no later part changes or deletes."""
        keys = next((p["keys"] for p in parts if p["keys"]), None)
        if keys is None:
            return self._files(table, parts)
        runs: list[tuple[int, list[dict]]] = []  # appended parts with no change between them count as one
        for i, p in enumerate(parts):
            if p["kind"] == "rows" and runs and runs[-1][1][-1]["kind"] == "rows" and runs[-1][0] + len(runs[-1][1]) == i:
                runs[-1][1].append(p)
            elif p["kind"] != "gone":
                runs.append((i, [p]))
        rows = changed = None
        for i, some in runs:
            more = self._files(table, some).withColumn("_at", F.lit(i + len(some) - 1))
            rows = more if rows is None else rows.unionByName(more, allowMissingColumns=True)
        if rows is None:  # deletions only
            return self.spark.createDataFrame([], SCHEMAS[table])
        for i, p in enumerate(parts):
            if p["kind"] != "rows":
                more = self.spark.read.parquet(f"{self.path}/{table}/{p['part']}").select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.lit(i).alias("_last"))
                changed = more if changed is None else changed.unionByName(more)
        newest = changed.groupBy(*[f"_k_{k}" for k in keys]).agg(F.max("_last").alias("_last"))
        same = None
        for k in keys:
            one = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
            same = one if same is None else same & one
        return rows.join(newest, same, "left").filter("_last is null or _at >= _last").drop("_at", "_last", *[f"_k_{k}" for k in keys])

    def _part(self, table: str, rows: DataFrame, kind: str = "rows", keys: list[str] | None = None) -> dict:
        part = f"p{time.time_ns():020d}-{uuid.uuid4().hex[:6]}"
        rows.write.parquet(f"{self.path}/{table}/{part}")
        return {"part": part, "kind": kind, "keys": keys}

    def _point(self, table: str, number: int, parts: list[dict]) -> str:
        """Makes the version's pointer, unless its number is taken."""
        version, name = f"v{number:012d}-{uuid.uuid4().hex[:6]}", f"{self.path}/{table}/_versions/v{number:012d}.json"
        body = json.dumps({"version": version, "at": time.time_ns(), "parts": parts, "number": number})
        store, path = self._store(name)
        store.mkdirs(path.getParent())
        if store.getUri().getScheme() == "file":
            here = path.toUri().getPath()
            draft = f"{here}.{uuid.uuid4().hex}.new"
            with open(draft, "x") as f:
                f.write(body)
            try:
                os.link(draft, here)
            except FileExistsError:
                raise Taken(name) from None
            finally:
                os.unlink(draft)
            return version
        _, draft = self._store(f"{name}.{uuid.uuid4().hex}.new")
        out = store.create(draft, False)
        out.write(bytearray(body.encode()))
        out.close()
        if not store.rename(draft, path):
            store.delete(draft, False)
            raise Taken(name)
        return version

    def write(self, table: str, rows: DataFrame) -> str:
        """A new version of these rows; an error if another writer made one meanwhile."""
        newest = self._newest(table)
        return self._point(table, newest["number"] + 1 if newest else 1, [self._part(table, conform(rows, table) if table in SCHEMAS else rows)])

    def _add(self, table: str, part: dict) -> str:
        for attempt in range(MAX_TRIES):
            newest = self._newest(table)
            held, number = (newest["parts"], newest["number"] + 1) if newest else ([], 1)
            changes = [p for p in held if p["kind"] != "rows"]
            full = len(held) >= MAX_PARTS or len(changes) >= MAX_CHANGES or any(p["keys"] != part["keys"] for p in changes if part["keys"])
            if full and held:
                held = [self._part(table, self._rows(table, held))]
            try:
                done = self._point(table, number, [*held, part])
            except Taken:
                time.sleep(min(0.2, 0.002 * attempt))
                continue
            if full:
                self.expire(table, KEEP)
            return done
        raise RuntimeError(f"no turn to add to {table}")

    def append(self, table: str, rows: DataFrame) -> str:
        """A new version with the rows added as a part."""
        return self._add(table, self._part(table, conform(rows, table) if table in SCHEMAS else rows))

    def upsert(self, table: str, rows: DataFrame, keys: list[str]) -> str:
        """A new version with these rows in place of those of the same keys (nulls equal), or added; the others are not
        written. Of rows of one key the last by ``updated_at`` counts."""
        rows = conform(rows, table) if table in SCHEMAS else rows
        order = [*([F.desc("updated_at")] if "updated_at" in rows.columns else []), row_hash(rows, rows.columns)]
        one = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")
        return self._add(table, self._part(table, one, "changed", keys))

    def delete(self, table: str, gone: DataFrame, keys: list[str]) -> str:
        """A new version without the rows of these keys."""
        types = dict(conform(gone, table).dtypes) if table in SCHEMAS else dict(gone.dtypes)
        return self._add(table, self._part(table, gone.select(*[F.col(k).cast(types[k]).alias(k) for k in keys]).distinct(), "gone", keys))

    def expire(self, table: str, keep: int = 10) -> int:
        """Deletes the parts that none of the newest ``keep`` versions names, and the other versions' pointers. Returns the number of parts."""
        known = [self._version(table, n) for n in self._numbers(table)]
        lost, kept = known[: max(0, len(known) - keep)], known[max(0, len(known) - keep) :]
        used = {p["part"] for v in kept for p in v["parts"]}
        gone = {p["part"] for v in lost for p in v["parts"]} - used
        for name in [*[f"_versions/v{v['number']:012d}.json" for v in lost], *sorted(gone)]:
            store, path = self._store(f"{self.path}/{table}/{name}")
            store.delete(path, True)
        return len(gone)

    def create(self) -> None:
        for table in SCHEMAS:
            self.write(table, self.spark.createDataFrame([], SCHEMAS[table]))


class Audit:
    """Spans and changes as appended JSON lines."""

    SCHEMA = "logged_at long, instance string, trace_id string, stage string, action string, status string, entity_type string, entity_id string, elapsed_ms double, details string"

    def __init__(self, spark: SparkSession, path: str, instance: str = "default"):
        self.spark, self.path, self.instance = spark, path, instance

    def write(self, rows: DataFrame) -> None:
        names = [f.strip().split()[0] for f in self.SCHEMA.split(",")]
        base = rows.withColumns({"logged_at": F.lit(time.time_ns() // 1_000_000), "instance": F.lit(self.instance)})
        base.select(*[F.col(n) if n in base.columns else F.lit(None).cast("string").alias(n) for n in names]).write.mode("append").json(self.path)

    @contextmanager
    def trace(self, operation: str):
        """A span: its time, and whether it failed."""
        trace_id, began, status = uuid.uuid4().hex, time.monotonic(), "ok"
        try:
            yield trace_id
        except Exception:
            status = "failed"
            raise
        finally:
            row = [(trace_id, "request", operation, status, (time.monotonic() - began) * 1000)]
            self.write(self.spark.createDataFrame(row, "trace_id string, stage string, action string, status string, elapsed_ms double"))

    def deltas(self, trace_id: str, delta: DataFrame, kind: str, key: str = "id") -> None:
        """A graph delta's rows, one line each."""
        self.write(delta.select(F.lit(trace_id).alias("trace_id"), F.lit("delta").alias("stage"), F.col("change").alias("action"), F.lit("ok").alias("status"), F.lit(kind).alias("entity_type"), F.col(key).alias("entity_id")))

    def recent(self, limit: int = 100) -> DataFrame:
        rows = self.spark.read.schema(self.SCHEMA).option("mode", "DROPMALFORMED").json(self.path)
        return rows.orderBy(F.desc("logged_at")).limit(limit).orderBy("logged_at")


def database_id(name: str) -> str:
    """Slug and a random suffix."""
    slug = re.sub("[^a-z0-9]+", "-", name.lower()).strip("-")[:30]
    return f"{slug or 'db'}-{uuid.uuid4().hex[:6]}"


def safe_values(rows: DataFrame) -> DataFrame:
    """Vectors replaced by whether they are there and their length."""
    vectors = [f.name for f in rows.schema if f.dataType.simpleString() in ("array<float>", "array<double>")]
    return rows.withColumns({v: F.struct(F.col(v).isNotNull().alias("present"), F.coalesce(F.size(v), F.lit(0)).alias("dimension")) for v in vectors})
