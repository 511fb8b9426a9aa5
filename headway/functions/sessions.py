"""The folder that a cluster shares, and results that go on from it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a local session (tests) gets a new one; a cluster has no
    other folder that is sure to be shared, so there it is an error."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="headway-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. What is written there stays as long as the cluster keeps the folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from there, so that no lost executor makes Spark run the plan again."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def reused(df: DataFrame) -> DataFrame:
    """The rows written once as Parquet to the shared folder and read from there, for several branches of a plan."""
    path = shared_path(df.sparkSession, "reused")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
