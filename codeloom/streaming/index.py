"""Incremental maintenance with Structured Streaming, and event-time windows as an extension."""

from __future__ import annotations

import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.sources import tables


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder that executors share; a temporary one where the session names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}" if root else "file://" + tempfile.mkdtemp(prefix=f"codeloom-{name}-")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}.parquet*")


def drain_to_table(spark: SparkSession, sf_dir: str, name: str, keys: list[str]) -> DataFrame:
    """Runs all available files through foreachBatch upserts into a table, and gives that table."""
    at, state = _scratch(spark, "stream-table"), _scratch(spark, "stream-state")
    latest: list[str] = []

    def merge(batch: DataFrame, epoch: int) -> None:
        path = f"{at}/epoch={epoch}"
        old = batch.sparkSession.read.parquet(latest[-1]) if latest else None
        fresh = batch.dropDuplicates(keys)
        (fresh if old is None else tables.upserted(old, fresh, keys)).write.mode("overwrite").parquet(path)
        latest.append(path)

    q = stream(spark, sf_dir, name).writeStream.foreachBatch(merge).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(latest[-1]) if latest else spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0)


def windowed(spark: SparkSession, sf_dir: str, size: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts and sums of events by tumbling window and type, streamed in update mode with a watermark; of a window that was updated more than once, the last state counts."""
    at, state = _scratch(spark, "windows"), _scratch(spark, "windows-state")
    agg = lambda df: df.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
    live = agg(stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late))

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/epoch={epoch}")

    live.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.option("basePath", at).parquet(f"{at}/epoch=*")
    return got.groupBy("start", "event_type").agg(F.max_by("n", "epoch").alias("n"), F.max_by("total", "epoch").alias("total"))


def watch(spark: SparkSession, files: DataFrame, apply, state: str, every: str = "500 milliseconds"):
    """Starts a query that hands each batch of changed files (path, content) to apply(batch, epoch)."""
    return files.writeStream.foreachBatch(apply).option("checkpointLocation", state).trigger(processingTime=every).start()


def forget(path: str) -> None:
    shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
