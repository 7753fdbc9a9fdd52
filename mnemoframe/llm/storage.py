"""Where intermediate results live: tables and files in the shared folder."""

from __future__ import annotations

import gc
import time

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import fresh_dir, shared_dir, written
from .files import opened

__all__ = ["discard", "fresh_dir", "lean", "release", "shared_dir", "written"]


def discard(*tables: DataFrame) -> None:
    """Deletes what ``written`` wrote, when nothing reads it any more."""
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            store, path = opened(folder)
            store.delete_dir(path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nobody holds any more."""
    for _ in range(2):  # what the first round frees holds references itself
        gc.collect()
        time.sleep(0.2)  # the bridge drops Java objects in a thread of its own
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def lean(spark: SparkSession) -> None:
    """Arrow batches of texts stay small, unless the session says otherwise: at
    the default of 10,000 rows a batch of long documents is a worker's memory."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, "1000")
