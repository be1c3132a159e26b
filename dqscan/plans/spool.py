"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, one of the machine's own, if there is just one machine."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if at:
        return at
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not getattr(sc, "_dqscan_folder", None):
        sc._dqscan_folder = f"file://{tempfile.mkdtemp(prefix='dqscan-')}"
    return sc._dqscan_folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/dqscan-{name}-{uuid.uuid4().hex}"


def passing(spark: SparkSession, path: str) -> None:
    """Has a written table deleted when the driver ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def keep(df: DataFrame, name: str, folder: str | None = None) -> str:
    """Writes df as a Parquet table that outlives the job, and gives its path; into the shared folder unless another is named."""
    path = f"{folder or shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def spool(df: DataFrame, name: str = "spool") -> DataFrame:
    """Writes df and reads it back: lineage ends there, and lost executors cost nothing. The table goes when the driver ends."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    passing(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
