"""Point lookups, ranges, filters, lists and free-form queries."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.labels import utc_timestamp

_UNITS = {"s": "SECONDS", "m": "MINUTES", "h": "HOURS", "d": "DAYS"}


def span(text: str) -> Column:
    """An interval from ``30m``, ``1h``, ``24h``, ``7d`` or a mix such as ``1h30m``."""
    parts = re.findall(r"(\d+)([smhd])", text)
    if not parts or "".join(n + u for n, u in parts) != text:
        raise ValueError(f"not a duration: {text!r}")
    total = None
    for n, unit in parts:
        piece = F.expr(f"INTERVAL {int(n)} {_UNITS[unit]}")
        total = piece if total is None else total + piece
    return total


def metrics_time_range(
    metrics: DataFrame, start: Column, end: Column, system_id: str | None = None
) -> DataFrame:
    """Samples with ``start <= ts <= end``, newest first."""
    chosen = metrics.where(F.col("ts").between(start, end))
    if system_id is not None:
        chosen = chosen.where(F.col("system_id") == system_id)
    return chosen.orderBy(F.desc("ts"))


def _bound(text: str) -> Column:
    """A UTC wall-clock time from RFC 3339 text; without an offset it is UTC already."""
    if re.search(r"\d(?:[Zz]|[+-]\d\d:?\d\d)$", text) and ":" in text:
        return utc_timestamp(F.lit(text))
    return F.lit(text).cast("timestamp_ntz")


def historical_metrics(
    metrics: DataFrame, as_of: Column, start: str | None = None, end: str | None = None,
    range_text: str = "24h", system_id: str | None = None,
) -> DataFrame:
    """Range query with text bounds; the default is the last ``range_text`` before ``as_of``."""
    upper = _bound(end) if end else as_of
    lower = _bound(start) if start else upper - span(range_text)
    return metrics_time_range(metrics, lower, upper, system_id)


def historical_checked(
    metrics: DataFrame, start: dt.datetime, end: dt.datetime, system_id: str | None = None
) -> DataFrame:
    """Samples per series in a checked range: end after start, at most 30 whole days."""
    if end <= start:
        raise ValueError("end must be after start")
    if (end - start).days > 30:
        raise ValueError("a range of at most 30 days can be queried")
    bounds = [F.lit(b.isoformat(sep=" ")).cast("timestamp_ntz") for b in (start, end)]
    chosen = metrics.where(F.col("ts").between(*bounds))
    if system_id is not None:
        chosen = chosen.where(F.col("system_id") == system_id)
    return chosen.groupBy("system_id", "name").agg(F.count(F.lit(1)).alias("n"))


def metric_name_filter(metrics: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    return metrics.where(F.col("name").isin(list(names))) if names else metrics


def by_id(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Look up the rows of ``ids``; an id without a row is reported in ``error``."""
    found = df.withColumn("__found", F.lit(True))
    return (
        ids.select("id").join(found, "id", "left")
        .withColumn("error", F.when(F.col("__found").isNull(), F.concat(F.col("id"), F.lit(" not found"))))
        .drop("__found")
    )


def list_systems(systems: DataFrame) -> DataFrame:
    return systems.orderBy(F.desc("created_at"), "id")


def active_alerts(alerts: DataFrame, system_id: str | None = None) -> DataFrame:
    """Open alerts (active or acknowledged), newest first."""
    chosen = alerts.where(F.col("status").isin("active", "acknowledged"))
    if system_id is not None:
        chosen = chosen.where(F.col("system_id") == system_id)
    return chosen.orderBy(F.desc("created_at"), "id")


def list_alerts(alerts: DataFrame, system_id: str | None = None, limit: int = 50) -> DataFrame:
    """The newest alerts; no system means all systems."""
    chosen = alerts if system_id is None else alerts.where(F.col("system_id") == system_id)
    return chosen.orderBy(F.desc("created_at"), "id").limit(limit)


def filter_alerts(
    alerts: DataFrame, severity: str | None = None, system_id: str | None = None,
    active_only: bool = True,
) -> DataFrame:
    """Conjunction of the filters given; ``active_only`` leaves out acknowledged alerts."""
    if severity is not None:
        alerts = alerts.where(F.col("severity") == severity)
    if system_id is not None:
        alerts = alerts.where(F.col("system_id") == system_id)
    return alerts.where(F.col("status") == "active") if active_only else alerts


def enabled_rules(rules: DataFrame, systems: DataFrame) -> DataFrame:
    """Enabled rules of known systems."""
    known = systems.select(F.col("id").alias("__id"))
    return rules.where(F.col("enabled")).join(known, F.col("system_id") == F.col("__id"), "left_semi")


def status_regex_filter(df: DataFrame, pattern: str, column: str = "status") -> DataFrame:
    """Label matcher: the pattern must match the whole value."""
    return df.where(F.col(column).cast("string").rlike(f"^(?:{pattern})$"))


def http_error_filter(requests: DataFrame) -> DataFrame:
    return requests.where(F.col("status") >= 400)


def prediction_history(
    predictions: DataFrame, system_id: str | None = None, limit: int = 100
) -> DataFrame:
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be between 1 and 1000")
    chosen = predictions if system_id is None else predictions.where(F.col("system_id") == system_id)
    return chosen.orderBy(F.desc("generated_at"), "request_id").limit(limit)


_COMPARE = {
    "eq": lambda c, v: c == v, "ne": lambda c, v: c != v, "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(list(v)), "between": lambda c, v: c.between(*v),
}
_AGGREGATES = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


def sql_query(tables: dict[str, DataFrame], text: str) -> DataFrame:
    """Run SQL text over the tables given, under their names."""
    spark = next(iter(tables.values())).sparkSession
    return spark.sql(text, **tables)


def custom_query(
    df: DataFrame, filters: Sequence[tuple] = (), group_by: Sequence[str] = (),
    aggregates: dict[str, tuple[str, str]] | None = None, window: tuple[str, str] | None = None,
) -> DataFrame:
    """Filter and aggregate from a small specification.

    ``filters`` are ``(column, operator, value)``; ``aggregates`` map an output
    name to ``(function, column)``; ``window`` is ``(time column, width)``.
    """
    for column, operator, value in filters:
        df = df.where(_COMPARE[operator](F.col(column), value))
    if not aggregates:
        return df
    keys = [F.col(c) for c in group_by]
    if window:
        keys.append(F.window(window[0], window[1]).alias("__w"))
    out = df.groupBy(*keys).agg(
        *[_AGGREGATES[fn](column).alias(name) for name, (fn, column) in aggregates.items()]
    )
    if window:
        out = out.withColumns(
            {"window_start": F.col("__w.start"), "window_end": F.col("__w.end")}
        ).drop("__w")
    return out
