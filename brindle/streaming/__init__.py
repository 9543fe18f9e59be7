"""Deltas from files as they arrive, and windowed counts over event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.plans.incremental import IncrementalQuery


def refresh_stream(spark: SparkSession, path: str, schema: str, table: str, query: IncrementalQuery, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> None:
    """Refresh a started query with each micro-batch of new parquet files, until all that are there are used.

    A micro-batch is the snapshot of one refresh: its offsets are fixed before
    it runs and committed after the sink has taken the answer. Its rows are first
    written below the checkpoint under the batch's number, from where the query
    reads them: a batch that comes again replaces the same files and is given to
    the query once. After a restart a new query is first brought up to date from
    the batches written before, so nothing that the stream skips is lost.
    """
    stream = spark.readStream.schema(schema).parquet(path)
    kept = f"{checkpoint.rstrip('/')}/rows"
    kinds = spark.createDataFrame([], schema).schema
    known: set[int] = query.__dict__.setdefault("epochs", {}).setdefault(checkpoint, set())

    def rows_of(epoch: int) -> DataFrame:
        return spark.read.schema(kinds).parquet(f"{kept}/{epoch:012d}")

    def finished() -> list[int]:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(kept)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [f.getPath() for f in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(p.getName()) for p in names if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def step(rows: DataFrame, epoch: int) -> None:
        if epoch in known:  # the batch was used, its commit was not reached
            sink(query.answer(), epoch)
            return
        rows.write.mode("overwrite").parquet(f"{kept}/{epoch:012d}")
        new = rows_of(epoch)
        if not new.isEmpty():
            sink(query.refresh({table: new}), epoch)
        known.add(epoch)

    for epoch in finished():
        if epoch not in known:
            old = rows_of(epoch)
            if not old.isEmpty():
                sink(query.refresh({table: old}), epoch)
            known.add(epoch)
    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(spark: SparkSession, folder: str, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Events by window and type, in a form that a stream can run too: late rows beyond the watermark are left out there."""
    events = spark.read.parquet(f"{folder}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return windowed(events, width, slide, late)


def windowed(events: DataFrame, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def first_of_each(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Drops rows whose keys were seen within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)
