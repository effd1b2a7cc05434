"""Kafka source and sink.

The connector jar comes with the deployment.  Encoding and decoding of records
is separate from the transport so that it can be tested on any DataFrame with
Kafka's columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_topics(
    spark: SparkSession, servers: str, topics: str, *, max_per_trigger: int | None = None,
    starting: str = "latest", poll_records: int = 500,
) -> DataFrame:
    """Stream of the topics; a micro-batch takes all there is unless ``max_per_trigger`` limits it.

    ``poll_records`` is the most that one poll of one consumer returns.
    """
    limit = {} if max_per_trigger is None else {"maxOffsetsPerTrigger": max_per_trigger}
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topics)
        .option("startingOffsets", starting)
        .option("kafka.max.poll.records", poll_records)
        .options(**limit)
        .load()
    )


def decode(records: DataFrame, schema: str) -> DataFrame:
    """Kafka rows to ``topic``, ``ts`` and the fields of the JSON value."""
    return records.select(
        "topic", F.col("timestamp").alias("ts"),
        F.from_json(F.col("value").cast("string"), schema).alias("v"),
    ).select("topic", "ts", "v.*")


def encode(rows: DataFrame, key: str, topic: str) -> DataFrame:
    """Rows to ``topic``, ``key`` and a JSON ``value``."""
    return rows.select(
        F.col(topic).alias("topic"),
        F.col(key).cast("string").alias("key"),
        F.to_json(F.struct(*[c for c in rows.columns if c != topic])).alias("value"),
    )


def write_topic(rows: DataFrame, servers: str, checkpoint: str):
    """Start a streaming write of encoded rows; at-least-once through the checkpoint."""
    return (
        rows.writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("kafka.acks", "all")
        .option("kafka.enable.idempotence", "true")
        .option("kafka.compression.type", "snappy")
        .option("checkpointLocation", checkpoint)
        .start()
    )
