"""Derived tables kept by Structured Streaming (2.12).

Canonical rows arrive as files; each micro-batch is turned into postings, attributes or latest state by the same
operators that a batch rebuild uses.  The stream's checkpoint is the projection cursor; a batch that fails after its
retries is written to a log of failures and passed over.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators.lifecycle import latest_state

#: Seconds before each retry of a batch.
RETRIES = (1.0, 4.0, 16.0)


def source(spark: SparkSession, path: str, schema, files_per_batch: int = 64) -> DataFrame:
    """A stream of the Parquet files in a folder, or of the one file at ``path``."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())


def project(stream: DataFrame, derive: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, failures: str, retries: tuple[float, ...] = RETRIES, sleep: Callable[[float], None] = time.sleep) -> StreamingQuery:
    """Write ``derive`` of every micro-batch below ``out``, one folder per batch id, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        error = None
        for wait in (*retries, None):
            try:
                derive(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
                return
            except Exception as e:  # noqa: BLE001
                error = e
                if wait is not None:
                    sleep(wait)
        note = [(batch_id, type(error).__name__, str(error)[:500])]
        batch.sparkSession.createDataFrame(note, "batch_id long, error string, message string").write.mode("append").parquet(failures)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(query: StreamingQuery) -> None:
    """Wait until all that had arrived is projected (read after write)."""
    query.awaitTermination()


def latest_state_stream(stream: DataFrame, keys: list[str], order: list[str], out: str, checkpoint: str) -> StreamingQuery:
    """Keep the latest row of each key: every micro-batch adds its own latest rows, and reading takes the latest of all.

    A batch writes no more than it holds, into a folder of its own, so a repeated batch replaces itself.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        latest_state(batch, keys, order).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_state(spark: SparkSession, out: str, keys: list[str], order: list[str]) -> DataFrame:
    return latest_state(spark.read.parquet(out).drop("batch"), keys, order)


def compact_state(spark: SparkSession, out: str, keys: list[str], order: list[str], into: str) -> None:
    """The state as one table at ``into``, for a reader that shouldn't see its history."""
    read_state(spark, out, keys, order).write.parquet(into)


def projection_cursor(query: StreamingQuery) -> int:
    """The last batch that is fully projected."""
    progress = query.lastProgress
    return -1 if progress is None else progress["batchId"]


def windowed_counts(events: DataFrame, time_column: str, key: str, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Beyond the reference: counts per key and event-time window, with a watermark."""
    return events.withWatermark(time_column, late).groupBy(F.window(time_column, size).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), key, "n")
