"""A stream that creates jobs: one for each task and owner, unless there is an active one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from .windows import event_stream

JOBS = "task_type string, owner long, job_id long"


def created_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The jobs after the stream has run over all events that are no errors: in each batch the first of a task and
    owner, and none that has a job already. A batch that is run again writes the same rows to the same place."""
    folder = f"{shared_folder(spark)}/lodeworks/jobs-{uuid.uuid4().hex}"
    spark.createDataFrame([], JOBS).write.parquet(f"{folder}/jobs/batch=-1")

    def create(batch: DataFrame, number: int) -> None:
        first = batch.where("event_type <> 'error'").groupBy(F.col("event_type").alias("task_type"), F.col("user_id").alias("owner")).agg(F.min(F.struct("ts", "event_id")).alias("f"))
        active = spark.read.schema(JOBS + ", batch int").parquet(f"{folder}/jobs").where(F.col("batch") < number).select("task_type", "owner")
        new = first.join(active, ["task_type", "owner"], "left_anti").select("task_type", "owner", F.col("f.event_id").alias("job_id"))
        new.write.mode("overwrite").parquet(f"{folder}/jobs/batch={number}")

    out = event_stream(spark, sf_dir).writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    out.foreachBatch(create).start().awaitTermination()
    return spark.read.schema(JOBS + ", batch int").parquet(f"{folder}/jobs").select("task_type", "job_id")
