"""Event-time windows, sessions, late data, duplicates, order and sampling.

The grouping functions work on batch and streaming DataFrames alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.conditions import reasons
from tidewatch.functions.sampling import hash_fraction
from tidewatch.operators import ordered, sequential
from tidewatch.operators.store import parse_records


def _windowed(df: DataFrame, by: Sequence[str], window: Column) -> DataFrame:
    return df.groupBy(*by, window.alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"),
        F.min("value").alias("low"), F.max("value").alias("high"),
    ).select(
        *by, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
        "n", "total", "mean", "low", "high",
    )


def tumbling(df: DataFrame, by: Sequence[str], size: str, ts: str = "ts") -> DataFrame:
    return _windowed(df, by, F.window(ts, size))


def sliding(df: DataFrame, by: Sequence[str], size: str, slide: str, ts: str = "ts") -> DataFrame:
    return _windowed(df, by, F.window(ts, size, slide))


def sessions(df: DataFrame, key: str, gap_seconds: int, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Sessions of a bounded table: a pause of ``gap_seconds`` or more begins a new one.

    ``session_window`` would bring all rows of a key to one task; this does not.
    """
    paused = F.timestamp_diff("MICROSECOND", F.col("__before"), F.col(ts)) >= gap_seconds * 1_000_000
    found = ordered.island_aggregates(
        df, [key], [ts, tie], ordered.row_chunks(ts), {"__before": F.col(ts)},
        F.col("__before").isNull() | paused,
        session_start=("min", F.col(ts)), last=("max", F.col(ts)), n=("count", F.col(tie)), total=("sum", F.col("value")),
    )
    gap = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(gap_seconds).cast("decimal(18,6)"))
    return found.select(key, "session_start", (F.col("last") + gap).alias("session_end"), "n", "total")


def sessions_streaming(df: DataFrame, key: str, gap: str, ts: str = "ts") -> DataFrame:
    """Sessions of a stream with a watermark."""
    return df.groupBy(key, F.session_window(ts, gap).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")
    ).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n", "total")


def late_side_output(
    df: DataFrame, arrival: str, lateness_seconds: int, ts: str = "ts", tie: str = "event_id",
    chunk: int = 100_000,
) -> DataFrame:
    """Flag rows older than the newest event time seen before them minus the lateness."""
    seen = ordered.running(
        df, [], [arrival, tie], ordered.number_chunk(arrival, chunk), __newest=ordered.max_before(F.col(ts))
    )
    behind = F.timestamp_diff("MICROSECOND", F.col(ts), F.col("__newest")) > lateness_seconds * 1_000_000
    return seen.withColumn("is_late", F.coalesce(behind, F.lit(False))).drop("__newest")


def first_per_key(df: DataFrame, keys: Sequence[str], ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The earliest row of each key; combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(ts, tie)).alias("r")).select(*keys, "r.*")


def dedup_ttl(df: DataFrame, keys: Sequence[str], ttl_seconds: int, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Drop a row while a kept row of its key is younger than the TTL."""
    return sequential.keep_spaced(df, keys, ts, tie, ttl_seconds).where("kept").drop("kept")


def event_order(df: DataFrame, key: str, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Position of each event in the event-time order of its key."""
    return ordered.running(df, [key], [ts, tie], ordered.row_chunks(ts), position=ordered.row_number())


def sorted_output(df: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """Range-partitioned by key and time, sorted inside partitions; a busy key spans several."""
    return df.repartitionByRange(key, ts).sortWithinPartitions(key, ts)


def metric_sample(metrics: DataFrame, rate: float) -> DataFrame:
    """Keep whole series, chosen by a hash."""
    series = F.concat_ws("/", "system_id", "name")
    return metrics.where(hash_fraction(series) < rate)


def schema_check_events(df: DataFrame, schema: str, required: Sequence[str], body: str = "body") -> DataFrame:
    """Reasons why a body does not fit the schema; empty text when it does."""
    parsed = parse_records(df, schema, body)
    missing = [(f"no {c}", F.col("reason").isNull() & F.col(f"record.{c}").isNull()) for c in required]
    found = reasons(("malformed body", F.col("reason").isNotNull()), *missing)
    return parsed.withColumn("reason", F.concat_ws(",", found)).withColumn("valid", F.col("reason") == "")


def retry_dead_letter(messages: DataFrame, retries: int = 3, first_s: float = 1.0, factor: float = 2.0, longest_s: float = 30.0) -> DataFrame:
    """What happens next to failed messages: another try after a delay, or the dead letters."""
    failed = messages.where(F.col("status") == "error")
    delay = F.least(F.lit(longest_s), first_s * F.pow(F.lit(factor), F.col("attempts")))
    dead = F.col("attempts") > retries
    return failed.select(
        "*", F.when(dead, "dead-letter").otherwise("retry").alias("next"), F.when(~dead, delay).alias("delay_s")
    )
