"""The folder that all executors share, and tables written there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a local session without one gets a temporary folder, any other an error."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        of_context = spark.sparkContext._jsc.sc().getCheckpointDir()
        d = of_context.get() if of_context.isDefined() else None
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="shipcheck-")
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: what follows reads it as often as it likes."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, key: str, name: str, into: str = "number") -> DataFrame:
    """df with each row's place by key, from 0: one range exchange, and prefix sums over a count for each partition (the rows are
    written once, so their partitions stay what they were)."""
    spark = df.sparkSession
    dealt = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), key).sortWithinPartitions(key)
    t = materialise(dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), name)
    counts = t.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = counts.select(F.col("_part").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return t.join(starts, F.col("_part") == F.col("_of")).withColumn(into, F.col("_start") + F.col("_at")).drop("_part", "_at", "_of", "_start", "_n")
