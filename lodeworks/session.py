"""What a session offers to operators that have to cut their lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); one of our own only where none is named and all runs on this machine."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-lodeworks-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again, with its partitions as they are."""
    sc = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return df.checkpoint()
