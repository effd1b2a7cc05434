"""Latest values and instant queries.

``max_by`` combines before the shuffle, so a series of any length is reduced to
one row per map task; no window over the samples is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window


def latest_metrics(metrics: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest sample of each series; ``limit`` keeps the first names of each system.

    The names are ranked alphabetically among the series of a system, a set
    bounded by the number of metric names, not by the number of samples.
    """
    newest = F.max_by(F.struct("value", "unit", "labels", "ts"), F.struct("ts", "id"))
    out = (
        metrics.groupBy("system_id", "name").agg(newest.alias("m"))
        .select("system_id", "name", "m.*")
    )
    if limit is None:
        return out
    by_name = Window.partitionBy("system_id").orderBy("name")
    return out.withColumn("__r", F.row_number().over(by_name)).where(F.col("__r") <= limit).drop("__r")


def instant_vector(metrics: DataFrame, at: Column, lookback: str = "5 minutes") -> DataFrame:
    """Newest sample of each series in ``(at - lookback, at]``."""
    recent = metrics.where((F.col("ts") > at - F.expr(f"INTERVAL {lookback}")) & (F.col("ts") <= at))
    return latest_metrics(recent)


def instant_grid(
    metrics: DataFrame, step_seconds: int, lookback_seconds: int = 300
) -> DataFrame:
    """The instant vector at every multiple of ``step_seconds`` since the epoch.

    Between two grid points only the newest sample of a series can answer, so the
    samples are reduced to that first, which leaves a series at most one row a step.  A row
    answers from its own point until its lookback ends or the next row's point comes, so
    the points are counted out of each row and meet in no join or aggregation.
    """
    step, look = step_seconds * 1_000_000, lookback_seconds * 1_000_000
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    first = F.ceil(micros / F.lit(step)).cast("long")
    newest = (
        metrics.where(F.col("ts").isNotNull()).groupBy("system_id", "name", first.alias("first"))
        .agg(F.max_by(F.struct("value", "ts"), F.struct("ts", "id")).alias("m"))
        .select("system_id", "name", "first", "m.value", F.unix_micros(F.col("m.ts").cast("timestamp")).alias("us"))
    )
    following = F.lead("first").over(Window.partitionBy("system_id", "name").orderBy("first"))
    last = F.ceil((F.col("us") + F.lit(look)) / F.lit(step)).cast("long") - 1
    reach = newest.withColumn("last", F.least(last, following - 1))
    points = F.when(F.col("last") >= F.col("first"), F.sequence("first", "last"))
    spread = reach.select("system_id", "name", "value", F.explode(points).alias("g"))
    eval_time = F.timestamp_micros(F.col("g") * F.lit(step)).cast("timestamp_ntz")
    return spread.select("system_id", "name", eval_time.alias("eval_time"), "value")
