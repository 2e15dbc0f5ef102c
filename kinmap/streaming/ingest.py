"""Ingest of descriptor files into inverted lists as a stream: bounded batches, exactly once for each file."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinmap.operators.knn import closest_lists


def ingest(spark: SparkSession, source: str, lists: str, centroids: DataFrame, checkpoint: str, schema: str = "b_id bigint, vec array<double>", files_per_batch: int = 20) -> StreamingQuery:
    """Assigns each vector of the Parquet files that arrive in ``source`` to its list and appends it to ``lists``, by list.

    A batch is written to a folder of its own that a repeated batch overwrites, so a restart neither loses nor doubles rows.
    """

    def append(batch: DataFrame, number: int) -> None:
        assigned = batch.join(closest_lists(batch, centroids, "b_id").select("b_id", "list_id"), "b_id")
        assigned.write.mode("overwrite").parquet(f"{lists}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(append).start()


def read_lists(spark: SparkSession, lists: str) -> DataFrame:
    return spark.read.option("basePath", lists).parquet(lists).drop("batch")


def merge_lists(*indexes: DataFrame) -> DataFrame:
    """Lists of several indexes, list by list, in order within a list."""
    merged = indexes[0]
    for other in indexes[1:]:
        merged = merged.unionByName(other)
    return merged.repartition("list_id").sortWithinPartitions("list_id", "b_id")


def progress(query: StreamingQuery) -> dict:
    """Files and rows so far."""
    rows = [p for p in query.recentProgress]
    return {"batches": len(rows), "rows": sum(p["numInputRows"] for p in rows)}


def await_or_stop(query: StreamingQuery, seconds: float) -> bool:
    """Waits for a stream to end; one that has not within ``seconds`` is stopped, and False returned. What it has committed stays."""
    if query.awaitTermination(seconds):
        return True
    query.stop()
    return False


def within(spark: SparkSession, seconds: float, action: Callable):
    """What ``action()`` returns; its jobs are cancelled, and it fails, if they take longer than ``seconds``."""
    context, group = spark.sparkContext, f"within-{uuid.uuid4().hex}"
    timer = threading.Timer(seconds, context.cancelJobGroup, [group])
    context.setJobGroup(group, "limited in time", interruptOnCancel=True)
    timer.start()
    try:
        return action()
    finally:
        timer.cancel()
        context.setLocalProperty("spark.jobGroup.id", None)
