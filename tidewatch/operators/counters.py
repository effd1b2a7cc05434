"""Counters, gauges, histograms, rates, throughput and data quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.operators import ordered
from tidewatch.operators.alerts import seconds_between
from tidewatch.operators.latest import instant_vector
from tidewatch.operators.selection import span

# Histogram bucket bounds by family.
BUCKETS = {
    "default": [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0],
    "processing": [0.001 * 2**i for i in range(15)],
    "remediation": [0.1 * 2**i for i in range(10)],
    "prediction": [0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0],
    "confidence": [0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95, 0.99, 1.0],
    "batch": [1, 5, 10, 20, 50, 100, 200, 500],
    "anomaly": [0.1, 0.5, 1.0, 2.0, 5.0, 10.0],
    "quality": [0.1, 0.3, 0.5, 0.7, 0.8, 0.9, 0.95, 1.0],
    "feature": [0.01, 0.05, 0.1, 0.5, 1.0, 2.0],
}


def counter_totals(df: DataFrame, family: str, labels: Sequence[str], increment: Column | None = None) -> DataFrame:
    """Total of a counter per label set; labels are joined into one text."""
    step = F.lit(1) if increment is None else increment
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in labels])
    return df.groupBy(text.alias("labels")).agg(F.sum(step).cast("long").alias("total")).select(
        F.lit(family).alias("family"), "labels", "total"
    )


def gauge_last(df: DataFrame, labels: Sequence[str], value: str = "value", ts: str = "ts", tie: str = "id") -> DataFrame:
    return df.groupBy(*labels).agg(F.max_by(value, F.struct(ts, tie)).alias("value"))


def _bucket_columns(value: str, bounds: Sequence[float]) -> list[Column]:
    return [F.count_if(F.col(value) <= b).alias(f"__b{i}") for i, b in enumerate(bounds)]


def histogram_wide(df: DataFrame, labels: Sequence[str], value: str, bounds: Sequence[float]) -> DataFrame:
    """One row per label set with a cumulative count per bound; one pass, no row expansion."""
    return df.groupBy(*labels).agg(
        *_bucket_columns(value, bounds), F.count(value).alias("count"), F.sum(value).alias("sum")
    )


def histogram_cumulative(df: DataFrame, labels: Sequence[str], value: str, bounds: Sequence[float]) -> DataFrame:
    """Cumulative ``le`` buckets with count and sum; ``+Inf`` equals the count."""
    wide = histogram_wide(df, labels, value, bounds)
    rows = [F.struct(F.lit(f"{b:.6g}").alias("le"), F.col(f"__b{i}").alias("n")) for i, b in enumerate(bounds)]
    rows.append(F.struct(F.lit("+Inf").alias("le"), F.col("count").alias("n")))
    return wide.select(*labels, "count", "sum", F.explode(F.array(*rows)).alias("b")).select(
        *labels, "b.le", F.col("b.n").alias("cumulative"), "count", "sum"
    )


def quantile_hist(df: DataFrame, labels: Sequence[str], value: str, bounds: Sequence[float], q: float) -> DataFrame:
    """Quantile estimate: linear inside the bucket that holds the rank.

    A rank beyond the last bound gives the last bound.
    """
    wide = histogram_wide(df, labels, value, bounds)
    rank = F.lit(float(q)) * F.col("count")
    estimate = None
    for i, bound in enumerate(bounds):
        lower, below = (float(bounds[i - 1]), F.col(f"__b{i - 1}")) if i else (0.0, F.lit(0))
        inside = F.coalesce(F.try_divide(rank - below, F.col(f"__b{i}") - below), F.lit(0.0))
        point = F.lit(lower) + F.lit(float(bound) - lower) * inside
        hit = F.col(f"__b{i}") >= rank
        estimate = F.when(hit, point) if estimate is None else estimate.when(hit, point)
    return wide.select(*labels, "count", estimate.otherwise(float(bounds[-1])).alias("estimate"))


def throughput(messages: DataFrame, by: Sequence[str] = ("topic", "processor"), width: str = "1 minute") -> DataFrame:
    """Messages per second in fixed windows; also the body of the streaming form."""
    seconds = {"1 minute": 60.0, "5 minutes": 300.0, "1 hour": 3600.0}[width]
    return messages.groupBy(*by, F.window("ts", width).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) / F.lit(seconds)).alias("per_second")
    ).select(*by, F.col("w.start").alias("window_start"), "n", "per_second")


def error_rate_pct(messages: DataFrame, by: Sequence[str]) -> DataFrame:
    errors = F.count_if(F.col("status") == "error")
    return messages.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), (F.lit(100.0) * errors / F.count(F.lit(1))).alias("error_pct")
    )


def pipeline_lag(messages: DataFrame, by: Sequence[str], as_of: Column) -> DataFrame:
    return messages.groupBy(*by).agg(seconds_between(F.max("ts"), as_of).alias("lag_s"))


def promql_avg(metrics: DataFrame, at: Column, lookback: str = "5 minutes") -> DataFrame:
    return instant_vector(metrics, at, lookback).groupBy("name").agg(
        F.avg("value").alias("value"), F.count(F.lit(1)).alias("series")
    )


def counter_increase(
    metrics: DataFrame, keys: Sequence[str] = ("system_id", "name"), chunk: str = "hour"
) -> DataFrame:
    """Increase of a counter since the sample before; a drop means it was reset."""
    out = ordered.running(
        metrics, keys, ["ts", "id"], ordered.time_chunk("ts", chunk), before=ordered.previous(F.col("value"))
    )
    value, before = F.col("value"), F.col("before")
    step = F.when(before.isNotNull(), F.when(value < before, value).otherwise(value - before))
    return out.withColumn("increase", step).drop("before")


def promql_rate(metrics: DataFrame, at: Column, range_text: str = "5m", chunk: str = "hour") -> DataFrame:
    """Increase per second over the sampled span; no extrapolation to the range's edges."""
    recent = metrics.where((F.col("ts") > at - span(range_text)) & (F.col("ts") <= at))
    keys = ["system_id", "name"]
    covered = seconds_between(F.min("ts"), F.max("ts"))
    return counter_increase(recent, keys, chunk).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"), F.try_divide(F.sum("increase"), covered).alias("rate")
    )


def _in_range() -> Column:
    name, value = F.col("name"), F.col("value")
    top = F.when(name.isin("cpu_usage", "memory_usage", "disk_usage"), value <= 100).otherwise(True)
    return (value >= 0) & top


def data_quality(metrics: DataFrame, systems: DataFrame, as_of: Column, hours: int = 168) -> DataFrame:
    """Completeness x validity x timeliness per system; below 0.7 is flagged.

    Complete means a sample in every hour of the window.
    """
    hourly = (
        metrics.where((F.col("ts") >= as_of - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("ts") < as_of))
        .groupBy("system_id", F.date_trunc("hour", F.col("ts")).alias("hour"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(_in_range()).alias("valid"), F.max("ts").alias("newest"))
    )
    per_system = hourly.groupBy("system_id").agg(
        F.count(F.lit(1)).alias("present"), (F.sum("valid") / F.sum("n")).alias("validity"),
        (seconds_between(F.max("newest"), as_of) / 3600).alias("age_h"),
    )
    joined = systems.select(F.col("id").alias("system_id")).join(per_system, "system_id", "left")
    timeliness = F.greatest(F.lit(0.0), 1 - F.col("age_h") / hours)
    score = F.coalesce(F.col("present") / hours * F.col("validity") * timeliness, F.lit(0.0))
    return joined.select(
        "system_id", (F.lit(hours) - F.coalesce("present", F.lit(0))).alias("missing_hours"),
        score.alias("score"), (score < 0.7).alias("flagged"),
    )


def missing_points(metrics: DataFrame, systems: DataFrame, as_of: Column, hours: int = 168) -> DataFrame:
    """Hours of the window in which a system sent nothing.

    The samples are reduced to the hours of each system, at most ``hours`` of them, which meet the
    system in one row.  The expected grid is made by a sequence behind the join, so it is never
    shuffled, sorted or held.
    """
    start = as_of - F.expr(f"INTERVAL {hours} HOURS")
    present = (
        metrics.where((F.col("ts") >= start) & (F.col("ts") < as_of))
        .select("system_id", F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("hour")).distinct()
        .groupBy("system_id").agg(F.collect_list("hour").alias("__present"))
    )
    grid = F.sequence(start, as_of - F.expr("INTERVAL 1 HOUR"), F.expr("INTERVAL 1 HOUR"))
    missing = F.array_except(grid, F.coalesce("__present", F.array().cast("array<timestamp_ntz>")))
    joined = systems.select(F.col("id").alias("system_id")).join(present, "system_id", "left")
    return joined.select("system_id", F.explode(missing).alias("hour"))


def data_quality_report(metrics: DataFrame, as_of: Column) -> DataFrame:
    """Null, duplicate, out-of-range and future samples per metric."""
    per_key = metrics.groupBy("name", "system_id", "ts").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value").isNull()).alias("nulls"),
        F.count_if(~_in_range()).alias("out_of_range"), F.count_if(F.col("ts") > as_of).alias("future"),
    )
    return per_key.groupBy("name").agg(
        F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), F.sum(F.col("n") - 1).alias("duplicates"),
        F.sum("out_of_range").alias("out_of_range"), F.sum("future").alias("future"),
    )


def cardinality_guard(metrics: DataFrame, maximum: int, approximate: bool = False) -> DataFrame:
    """Distinct label sets per metric, flagged above the maximum."""
    count = F.approx_count_distinct("labels") if approximate else F.countDistinct("labels")
    return metrics.groupBy("name").agg(count.alias("cardinality")).withColumn(
        "exceeded", F.col("cardinality") > maximum
    )


def service_metrics(requests: DataFrame) -> DataFrame:
    ok = F.count_if(F.col("status") == "ok")
    return requests.agg(
        F.count(F.lit(1)).alias("total_predictions"), F.avg("latency_ms").alias("average_response_time"),
        F.try_divide(ok, F.count(F.lit(1))).alias("success_rate"),
    )
