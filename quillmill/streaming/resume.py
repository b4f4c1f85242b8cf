"""Resumable work as Structured Streaming jobs that end when there is nothing left."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def run_available(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Hand every new micro-batch to ``handle`` once, then stop; a later run goes on from there."""
    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def ingest(spark: SparkSession, source: str, schema, target: str, checkpoint: str, *, key: str, prepare: Callable[[DataFrame], DataFrame] = lambda d: d, files_per_batch: int = 100) -> None:
    """Append rows of new Parquet files whose key the target doesn't hold yet.

    The batch number is part of each output path, so a batch that runs again
    after a failure overwrites its own files.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def append(batch: DataFrame, number: int) -> None:
        fresh = prepare(batch).dropDuplicates([key])
        try:
            held = spark.read.option("recursiveFileLookup", "true").parquet(target).where(F.input_file_name().contains(f"batch={number}/") == False)  # noqa: E712
            fresh = fresh.join(held.select(key), key, "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        fresh.write.mode("overwrite").parquet(f"{target}/batch={number}")

    run_available(stream, checkpoint, append)


def windowed_counts(events: DataFrame, *, time: str = "ts", kind: str = "event_type", window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events per window and kind; works on batches and, with a watermark, on streams."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    counted = marked.groupBy(F.window(time, window).alias("w"), F.col(kind).alias("kind")).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), "kind", "n")
