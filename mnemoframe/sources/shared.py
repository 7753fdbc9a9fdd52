"""Intermediate tables in the folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """Where it is unset, a local session (tests) gets a folder of its own; a
    cluster's executors would not share one, so there it is an error."""
    global _own
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = known.get() if known.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _own = _own or "file://" + tempfile.mkdtemp(prefix="mnemoframe-")
    return folder.rstrip("/")


def fresh_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, sort: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: it cuts the lineage, and it
    survives lost executors. ``sort`` orders the rows within each file."""
    spark = df.sparkSession
    path = fresh_dir(spark, what)
    (df.sortWithinPartitions(sort) if sort else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
