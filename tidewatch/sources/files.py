"""Partitioned file store for metrics, and a JDBC reader."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.operators import chunks

#: Folders of more than one file up to which their table is broadcast.
BROADCAST_FOLDERS = 10_000


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``.

    Only in a local session without that setting is a temporary folder used.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    base = base or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set; name a shared folder first")
        base = tempfile.mkdtemp(prefix="tidewatch-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_metrics(metrics: DataFrame, path: str, batch: str, rows_per_file: int = 5_000_000) -> None:
    """Write a batch by date and metric name, in place of what was written for this batch before.

    A batch owns the folder ``batch=<batch>``, so one that is delivered again leaves the store as it was.
    The rows of each date and name are counted, and spread by a hash of series and time over as many
    tasks as files of ``rows_per_file`` rows need: a hot metric or day is not written by one task.
    """
    dated = metrics.withColumn("date", F.to_date("ts"))
    counts = dated.groupBy("date", "name").agg(F.ceil(F.count(F.lit(1)) / rows_per_file).alias("__tasks"))
    _, many = chunks.measured(counts.where("__tasks > 1"), BROADCAST_FOLDERS)
    tasks = many.select(F.col("date").alias("__d"), F.col("name").alias("__n"), "__tasks")
    same = F.col("date").eqNullSafe(F.col("__d")) & F.col("name").eqNullSafe(F.col("__n"))
    spread = F.pmod(F.xxhash64("system_id", "ts"), F.coalesce("__tasks", F.lit(1)))
    (
        dated.join(tasks, same, "left").withColumn("__spread", spread).repartition("date", "name", "__spread")
        .drop("__d", "__n", "__tasks", "__spread")
        .write.mode("overwrite").partitionBy("date", "name").parquet(f"{path.rstrip('/')}/batch={batch}")
    )


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """All batches, with the column ``batch``; equal keys of different batches are settled by ``store.upsert_metrics``."""
    return spark.read.parquet(path)


def write_jdbc(df: DataFrame, url: str, table: str, partitions: int, **options: str) -> None:
    """Append to a database table over at most ``partitions`` connections."""
    (
        df.write.format("jdbc").option("url", url).option("dbtable", table)
        .option("numPartitions", partitions).options(**options).mode("append").save()
    )


def read_jdbc(
    spark: SparkSession, url: str, table: str, partition_column: str,
    lower: str, upper: str, partitions: int, **options: str,
) -> DataFrame:
    """Parallel read of a database table, split on ``partition_column``."""
    return (
        spark.read.format("jdbc").option("url", url).option("dbtable", table)
        .option("partitionColumn", partition_column).option("lowerBound", lower)
        .option("upperBound", upper).option("numPartitions", partitions)
        .options(**options).load()
    )
