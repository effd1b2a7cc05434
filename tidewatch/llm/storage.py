"""Tables in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``.

    A session on one machine without that setting gets a folder of its own, once; a cluster
    must name one.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if base is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir is not set; name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tidewatch-")
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Bytes of rows that go to a Python worker at once.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """From now on this session hands rows to Python in Arrow batches of some ``most`` bytes, or one row.

    Spark's own limits (10,000 rows, 64 MB) let every task hold a batch several times over: as Arrow vectors
    that double as they fill, outside the heap, and as Arrow and Python objects in its worker.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or it with underscores, such that no column of ``df`` is called so, in either case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps no longer recompute it."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
