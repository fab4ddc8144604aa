"""Tables in the folder that driver and executors share: what iterations and reused results are written to."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is spark.checkpoint.dir. Where that is unset, a local master gets
    /tmp/checkpoints; a cluster has no safe default, so it is an error there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "/tmp/checkpoints"


def _folder(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    The lineage ends there, so that a lost executor costs only the tasks that
    read the table. The table goes when the application ends, or by drop(). The
    shuffles that made earlier tables go here: Spark deletes their files once
    the driver's garbage is collected, which it may not be for long.
    """
    spark = df.sparkSession
    spark.sparkContext._jvm.System.gc()
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, at = _folder(spark, path)
    fs.deleteOnExit(at)
    table = spark.read.schema(df.schema).parquet(path)
    table._cut_path = path
    return table


def drop(*tables: DataFrame) -> None:
    """Delete tables of cut() that nothing reads any more: what was made of them must have been written too."""
    for t in tables:
        fs, at = _folder(t.sparkSession, t._cut_path)
        fs.delete(at, True)
