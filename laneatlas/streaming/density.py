"""Streaming grids and windows over detections."""

from __future__ import annotations

import copy
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laneatlas.functions import geo
from laneatlas.session import shared_folder


def stream_density(points: DataFrame, width: int, height: int, grid: int = 50) -> DataFrame:
    """Running counts of cells of a stream of px, py; use output mode update or complete."""
    return points.groupBy(geo.cell(F.col("py"), height, grid).alias("gy"), geo.cell(F.col("px"), width, grid).alias("gx")).agg(F.count("*").alias("n"))


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Extension: counts of event-time windows; ts without a zone is cast, as watermarks need a timestamp."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return timed.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes", key: str = "user_id") -> DataFrame:
    """Extension: counts of sessions of a key."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def _at_work(spark: SparkSession) -> bool:
    told = spark.sparkContext.statusTracker()
    return any(info is not None and info.numActiveTasks for info in map(told.getStageInfo, told.getActiveStageIds()))


def drained(stream: DataFrame, mode: str = "complete", seconds: int = 600) -> DataFrame:
    """What a stream gives once all that is there now has been read, as a table in the shared folder, where the query's checkpoint lies too.

    mode append: the rows of all micro-batches; complete: those of the last one. TimeoutError once no task has run for `seconds`; a stream that is
    being read may take as long as it takes.
    """
    spark, schema = stream.sparkSession, stream.schema
    path = f"{shared_folder(spark)}/drained-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={n}")

    query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    worked = time.monotonic()
    while not query.awaitTermination(min(5, seconds)):
        if _at_work(spark):
            worked = time.monotonic()
        elif time.monotonic() - worked >= seconds:
            query.stop()
            raise TimeoutError(f"stream not drained, and no task ran for {seconds} s")
    rows = spark.read.schema(copy.deepcopy(schema).add("batch", "long")).parquet(f"{path}/rows")
    if mode == "complete":
        rows = rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch")
    return rows.drop("batch")
