"""Reading, text keys and scratch tables shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import cut, drop, shared_dir

__all__ = ["BATCH_BYTES", "WORD", "cut", "drop", "few", "lower_ascii", "map_arrow", "shared_dir", "table", "text_key"]

#: Words of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes that go to Python at once, or one row if it is longer; Spark's default is 64 MB.
BATCH_BYTES = 4 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow with batches of at most BATCH_BYTES, a bound that the session keeps from here on."""
    spark = df.sparkSession
    now = int(spark.conf.get(_BYTES).rstrip("b"))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(_BYTES, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def few(df: DataFrame) -> DataFrame:
    """df in an eighth of its tasks, but enough for all cores: for rows that are small beside what they are made of.

    Each file that a task writes has a price of its own, most so in a store or
    where a file's permissions take a process.
    """
    spark = df.sparkSession
    plan = df._jdf.queryExecution().executedPlan()
    if plan.nodeName() == "AdaptiveSparkPlan":  # with a shuffle, whose tasks are not known yet
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    else:
        n = plan.execute().getNumPartitions()
    return df.coalesce(max(1, min(n, max(4 * spark.sparkContext.defaultParallelism, n // 8))))


def text_key(text: Column) -> list[Column]:
    """Two independent 64-bit hashes that stand for a whole text; null has its own."""
    return [
        F.xxhash64(text).alias("_k1"),
        F.xxhash64(F.lit("second"), text).alias("_k2"),
    ]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
