"""Structured Streaming: windowed counts with a watermark, and set-form operators over micro-batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.sources.storage import shared_dir


def state_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, folder: str, name: str = "events", files_per_batch: int | None = None) -> DataFrame:
    """A file stream of one table, or of the files that name, a pattern, matches; ``ts`` becomes a timestamp with zone, which
    watermarks need. files_per_batch makes micro-batches of so many files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    raw = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, key: str, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, key, n, total) of tumbling windows; state older than the watermark is dropped."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", size), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("start"), key, "n", "total")


def run_to_end(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Everything that is there now, through a memory sink (for results of bounded size)."""
    name = f"stream_{uuid.uuid4().hex}"
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", state_folder(stream.sparkSession)).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def in_batches(stream: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply a set-form operator to each micro-batch; results carry the batch's number. A batch that runs again after a
    failure overwrites its own folder, so each counts once."""
    folder = state_folder(stream.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(f"{folder}/out")
