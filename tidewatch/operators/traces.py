"""Spans: service edges, sampling and batching."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewatch.functions.sampling import hash_fraction
from tidewatch.operators import ordered


def span_parents(spans: DataFrame) -> DataFrame:
    """Each span with the service of its parent span."""
    parent = spans.select(
        "trace_id", F.col("span_id").alias("parent_span_id"), F.col("service").alias("caller")
    )
    return spans.join(parent, ["trace_id", "parent_span_id"], "inner")


def topology_edges(spans: DataFrame) -> DataFrame:
    """Calls between services: count, mean and worst duration."""
    return span_parents(spans).groupBy("caller", F.col("service").alias("callee")).agg(
        F.count(F.lit(1)).alias("calls"), F.avg("duration_ms").alias("avg_ms"),
        F.max("duration_ms").alias("max_ms"),
    )


def trace_sample(spans: DataFrame, rate: float) -> DataFrame:
    """Keep whole traces, chosen by a hash of the trace id."""
    return spans.where(hash_fraction(F.col("trace_id").cast("string")) < rate)


def span_batch(spans: DataFrame, batch: int, max_ms: float) -> DataFrame:
    """Number export batches of ``batch`` spans per service, without oversized spans."""
    fit = spans.where(F.col("duration_ms") <= max_ms)
    out = ordered.running(
        fit, ["service"], ["ts", "span_id"], ordered.row_chunks("ts"), __n=ordered.row_number()
    )
    return out.withColumn("batch", F.floor((F.col("__n") - 1) / F.lit(batch)).cast("long")).drop("__n")
