"""Feed debounced changes into the stored tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from ..plans.index import apply_changes
from ..session import shared_folder
from ..sources.store import Store


def apply_stream(
    changes: DataFrame,
    store: Store,
    contents: Callable[[DataFrame], DataFrame],
    *,
    checkpoint: str | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start applying a stream of debounced changes (repo, path, event_type, last_ts).

    ``contents`` turns a set of (repo, path) into (repo, path, text) rows of the files that
    exist now. A path may be quiet more than once within a micro-batch; its last change
    counts. Each micro-batch reserves an unused batch of the store when it begins and notes it
    beside the checkpoint, so that one that is tried again writes the same folders again, and
    other runs on the store may come in between.
    """
    spark = store.spark
    checkpoint = checkpoint or shared_folder(spark, f"apply-checkpoint-{uuid.uuid4().hex[:12]}")

    def one_batch(rows: DataFrame, epoch: int) -> None:
        batch = _batch_of(store, checkpoint, epoch)
        log = store.folder("stream", batch)
        last = rows.groupBy("repo", "path").agg(F.max_by("event_type", "last_ts").alias("event_type"))
        last.write.mode("overwrite").parquet(log)
        last = spark.read.parquet(log)
        gone = last.where(F.col("event_type") == "deleted").select("repo", "path")
        there = last.where(F.col("event_type") != "deleted").select("repo", "path")
        apply_changes(store, contents(there), gone, batch=batch)
        store.discard("stream", batch)

    writer = (
        changes.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(one_batch)
    )
    return writer.trigger(**(trigger or {"processingTime": "2 seconds"})).start()


def _batch_of(store: Store, checkpoint: str, epoch: int) -> int:
    """The store batch of a micro-batch: the one noted when it was first tried, else a new one."""
    note = f"{checkpoint.rstrip('/')}-batches/epoch={epoch}"
    spark = store.spark
    try:
        return spark.read.parquet(note).first()["batch"]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    batch = store.reserve(f"{checkpoint} {epoch}")
    spark.range(1).select(F.lit(batch).alias("batch")).write.parquet(note)
    return batch


def drain(query: StreamingQuery, timeout: float | None = None) -> None:
    """Wait for a stream that stops by itself, as long as it takes unless a ``timeout`` in
    seconds is given; a failure of the stream is raised."""
    if not query.awaitTermination(timeout) and timeout is not None:
        query.stop()
        raise TimeoutError("the stream did not finish in time")
