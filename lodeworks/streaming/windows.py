"""Event-time windows over a stream of events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of events as a stream of files, be it one file or a folder of them (a pattern finds either)."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")


def counted(events: DataFrame, width: str = "1 hour", late: str = "40 days") -> DataFrame:
    """Counts and sums per window and type; what is later than ``late`` behind the newest event is dropped by the watermark."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream run over all that is there, each batch's updated windows appended to a table; of each window the last update."""
    folder = f"{shared_folder(spark)}/lodeworks/windows-{uuid.uuid4().hex}"

    def append(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{folder}/table")

    out = counted(event_stream(spark, sf_dir)).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    out.foreachBatch(append).start().awaitTermination()
    updates = spark.read.parquet(f"{folder}/table")
    last = updates.groupBy("window.start", "event_type").agg(F.max_by(F.struct("n", "value"), "batch").alias("l"))
    return last.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "l.n", F.round("l.value", 4).alias("value"))
