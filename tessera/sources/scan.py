"""Several sources at once, each by itself: one that fails or takes too long leaves the others as they are.

A source is read in a thread of its own, under a tag of its own, and written before it counts. So an error while its rows are
read, which a frame that is only opened doesn't show, stays with it; at its limit its jobs are cancelled by their tag.
What is written by then isn't read.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATUS = "source string, status string, n long, error string"


@dataclass
class Source:
    """load opens the source; seconds is its limit."""

    load: Callable[[], DataFrame]
    seconds: float = 300.0


class _Run(threading.Thread):
    def __init__(self, spark: SparkSession, name: str, source: Source, folder: str):
        super().__init__(daemon=True)  # one that hangs outside of Spark is left behind
        self.spark, self.source, self.folder, self.tag = spark, source, f"{folder}/{name}", f"source-{uuid.uuid4().hex}"
        self.status, self.error = "timeout", "timeout"

    def run(self) -> None:
        self.spark.sparkContext.addJobTag(self.tag)
        self.spark.sparkContext.setInterruptOnCancel(True)  # of this thread's jobs: a task that waits for its rows ends, too
        try:
            self.source.load().write.parquet(self.folder)
            self.status, self.error = "done", None
        except Exception as error:  # noqa: BLE001  whatever a source raises stays with it
            self.status, self.error = "error", error.getCondition() or type(error).__name__ if isinstance(error, PySparkException) else type(error).__name__


def scan_sources(spark: SparkSession, sources: dict[str, Source], folder: str) -> tuple[DataFrame | None, DataFrame]:
    """Rows of the sources that were read to the end, with their name as source (None if there is none), and a row of STATUS for each source.

    A source's rows are written below folder, which all executors share. Columns that a source lacks are null.
    """
    began = time.monotonic()
    runs = {name: _Run(spark, name, source, folder) for name, source in sources.items()}
    for run in runs.values():
        run.start()
    told, rows = [], None
    for name, run in sorted(runs.items(), key=lambda x: x[1].source.seconds):
        run.join(max(0.0, began + run.source.seconds - time.monotonic()))
        status, error = ("timeout", "timeout") if run.is_alive() else (run.status, run.error)  # what ends after this is too late
        if status == "timeout":
            spark.sparkContext.cancelJobsWithTag(run.tag)
        n = 0
        if status == "done":
            one = spark.read.parquet(run.folder)
            n = one.count()
            one = one.withColumn("source", F.lit(name))
            rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
        told.append((name, status, n, error))
    return rows, spark.createDataFrame(told, STATUS)
