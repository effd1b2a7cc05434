"""Rule evaluation, the life of an alert, notifications and incidents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.conditions import alert_condition
from tidewatch.functions.ids import entity_id
from tidewatch.functions.labels import combine_labels, decode_labels, encode_labels
from tidewatch.operators import ordered, quantiles


def rules_join_latest(rules: DataFrame, latest: DataFrame) -> DataFrame:
    """Each rule with the latest point it watches; rules without a point are skipped.

    Both sides have at most one row per rule or series, so the shuffle is small;
    whether a side is broadcast is left to the size statistics.
    """
    point = latest.select(
        "system_id", F.col("name").alias("metric_name"), F.col("value").alias("metric_value"),
        F.col("labels").alias("metric_labels"), F.col("ts").alias("metric_ts"),
    )
    return rules.join(point, ["system_id", "metric_name"]).withColumn(
        "triggered",
        alert_condition(F.col("metric_value"), F.col("operator"), F.col("threshold")),
    )


def _on_metric(df: DataFrame) -> DataFrame:
    return df.select(F.col("system_id").alias("__s"), F.col("metric_name").alias("__m")).distinct()


def _same_metric() -> Column:
    return (F.col("system_id") == F.col("__s")) & (F.col("metric_name") == F.col("__m"))


def new_alerts(evaluated: DataFrame, alerts: DataFrame, as_of: Column) -> DataFrame:
    """Alerts to open: triggered rules on a (system, metric) without an active alert.

    Rules on the same metric share one alert: the one with the lowest id.
    """
    active = _on_metric(alerts.where(F.col("status") == "active"))
    fresh = evaluated.where("triggered").join(active, _same_metric(), "left_anti")
    columns = [c for c in fresh.columns if c not in ("system_id", "metric_name")]
    first = fresh.groupBy("system_id", "metric_name").agg(
        F.min_by(F.struct(*columns), "id").alias("r")
    )
    return alert_project(first.select("system_id", "metric_name", "r.*"), as_of)


def alert_project(evaluated: DataFrame, as_of: Column) -> DataFrame:
    """The alert row of a triggered rule."""
    labels = combine_labels(decode_labels(F.col("metric_labels")), decode_labels(F.col("labels")))
    return evaluated.select(
        entity_id("alert_", "system_id", "metric_name", "metric_ts").alias("id"),
        F.col("id").alias("rule_id"), "system_id",
        F.concat(F.lit("Alert: "), "name").alias("name"),
        F.coalesce("severity", F.lit("medium")).alias("severity"),
        F.lit("active").alias("status"), "metric_name", "metric_value", "threshold", "operator",
        encode_labels(labels).alias("labels"), "channels",
        as_of.alias("created_at"), as_of.alias("updated_at"),
    )


def alerts_to_resolve(evaluated: DataFrame, alerts: DataFrame, as_of: Column) -> DataFrame:
    """Active alerts on a metric for which some rule evaluated false, as resolved.

    ``channels`` are those of the first such rule by id, for :func:`notification_rows`.
    """
    calm = evaluated.where(~F.col("triggered")).groupBy(
        F.col("system_id").alias("__s"), F.col("metric_name").alias("__m")
    ).agg(F.min_by("channels", "id").alias("channels"))
    return (
        alerts.drop("channels").where(F.col("status") == "active").join(calm, _same_metric()).drop("__s", "__m")
        .withColumns({"status": F.lit("resolved"), "updated_at": as_of, "resolved_at": as_of})
    )


# The channels there are.
CHANNELS = ("email", "slack", "webhook", "pagerduty")


def notification_rows(
    alerts: DataFrame, kind: str, enabled: Sequence[str] = CHANNELS
) -> DataFrame:
    """One row per alert and channel; ``channels`` is comma-separated text.

    Unknown channels are flagged; known ones that are switched off are skipped.
    """
    rows = alerts.withColumn("channel", F.explode(F.split("channels", ",")))
    known = F.col("channel").isin(*CHANNELS)
    return (
        rows.where(~known | F.col("channel").isin(*enabled))
        .withColumns({"type": F.lit(kind), "known": known})
        .drop("channels")
    )


def priority_channels(alerts: DataFrame, channels: Sequence[tuple[str, bool, int, Sequence[str]]]) -> DataFrame:
    """Channels for each alert in order of priority.

    ``channels`` is configuration: (type, enabled, priority, filters).  A channel
    takes an alert when a filter matches the text ``severity metric_name``; no
    filters takes all.
    """
    text = F.concat_ws(" ", "severity", "metric_name")
    options = []
    for kind, on, priority, filters in sorted(channels, key=lambda c: (c[2], c[0])):
        if on:
            takes = text.rlike("|".join(f"(?:{f})" for f in filters)) if filters else F.lit(True)
            options.append(F.when(takes, F.struct(F.lit(kind).alias("type"), F.lit(priority).alias("priority"))))
    chosen = F.array_compact(F.array(*options))
    return alerts.select("*", F.posexplode(chosen).alias("__p", "__c")).select(
        *alerts.columns, F.col("__c.type").alias("channel"), F.col("__c.priority").alias("priority"),
        (F.col("__p") + 1).alias("position"),
    )


def alert_episodes(rules: DataFrame, metrics: DataFrame, chunk: str = "hour") -> DataFrame:
    """Open and resolve times implied by replaying each series against its rules.

    An episode begins with a breach after a calm point and ends with the next
    calm point.
    """
    r = rules.select(
        F.col("id").alias("rule_id"), "system_id", F.col("metric_name").alias("name"),
        "operator", "threshold", "duration_s",
    )
    samples = metrics.select("system_id", "name", "value", "ts", F.col("id").alias("sample_id"))
    points = samples.join(r, ["system_id", "name"]).select(
        "rule_id", "system_id", "name", "duration_s", "ts", "sample_id", "value",
        alert_condition(F.col("value"), F.col("operator"), F.col("threshold")).alias("breach"),
    )
    breach, ts = F.col("breach"), F.col("ts")
    return ordered.island_aggregates(
        points, ["rule_id", "system_id", "name", "duration_s"], ["ts", "sample_id"], ordered.time_chunk("ts", chunk),
        {"was": breach}, breach & ~F.coalesce("was", F.lit(False)),
        opened_at=("min", F.when(breach, ts)), last_breach_at=("max", F.when(breach, ts)),
        resolved_at=("min", F.when(~breach, ts)), peak=("max", F.when(breach, F.col("value"))),
        n=("count", F.when(breach, ts)),
    )


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds as a double, for timestamps with or without zone."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)


def alert_sustained(episodes: DataFrame) -> DataFrame:
    """Episodes whose breach lasted at least the rule's duration."""
    lasted = seconds_between(F.col("opened_at"), F.col("last_breach_at"))
    return episodes.where(lasted >= F.col("duration_s"))


# Severities from least to worst.
SEVERITIES = ("low", "medium", "high", "critical")


def severity_rank(severity: str = "severity") -> Column:
    """Position of a severity, 1 for the least; 0 when unknown."""
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col(severity))


def incident_rollup(alerts: DataFrame, gap_seconds: int = 1800, chunk: str = "month") -> DataFrame:
    """Alerts of a system that follow each other within the gap form one incident."""
    apart = seconds_between(F.col("before"), F.col("created_at")) > gap_seconds
    incidents = ordered.island_aggregates(
        alerts.select("system_id", "id", "severity", "created_at", "resolved_at"),
        ["system_id"], ["created_at", "id"], ordered.time_chunk("created_at", chunk),
        {"before": F.col("created_at")}, F.col("before").isNull() | apart,
        opened_at=("min", F.col("created_at")), last_end=("max", F.col("resolved_at")),
        n_open=("count", F.when(F.col("resolved_at").isNull(), 1)), rank=("max", severity_rank()),
        n_alerts=("count", F.col("id")),
    )
    return incidents.select(
        "system_id", "opened_at", F.when(F.col("n_open") == 0, F.col("last_end")).alias("closed_at"),
        F.get(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("rank").cast("int") - 1).alias("severity"), "n_alerts",
    )


def incident_timeline(alerts: DataFrame, chunk: str = "month") -> DataFrame:
    """State changes per system in order, with the time since the one before."""
    changes = F.array(
        F.struct(F.col("created_at").alias("changed_at"), F.lit("opened").alias("state")),
        F.struct(F.col("resolved_at").alias("changed_at"), F.lit("resolved").alias("state")),
    )
    rows = (
        alerts.select("system_id", F.col("id").alias("alert_id"), F.explode(changes).alias("c"))
        .select("system_id", "alert_id", "c.changed_at", "c.state").where(F.col("changed_at").isNotNull())
    )
    out = ordered.running(
        rows, ["system_id"], ["changed_at", "alert_id", "state"], ordered.time_chunk("changed_at", chunk),
        before=ordered.previous(F.col("changed_at")), position=ordered.row_number(),
    )
    return out.withColumn("dwell_s", seconds_between(F.col("before"), F.col("changed_at"))).drop("before")


def threshold_check(systems: DataFrame, latest: DataFrame) -> DataFrame:
    """Per-system thresholds against the latest points."""
    limits = systems.select(
        F.col("id").alias("system_id"),
        F.explode(F.from_json("thresholds", "map<string,double>")).alias("name", "threshold"),
    )
    return limits.join(latest.select("system_id", "name", "value"), ["system_id", "name"]).withColumn(
        "breach", F.col("value") > F.col("threshold")
    )


def adaptive_thresholds(metrics: DataFrame) -> DataFrame:
    """Thresholds learned per series: mean + 3 deviations, and the 99th percentile, of all values but NaN."""
    learned = quantiles.exact_percentiles(metrics, ["system_id", "name"], "value", {"p99": 0.99}, moments=True)
    return learned.select(
        "system_id", "name", (F.col("mean") + 3 * F.col("std")).alias("sigma_threshold"), "n", "p99"
    )


def mttr(alerts: DataFrame, by: Sequence[str] = ("severity",)) -> DataFrame:
    """Mean time to resolve."""
    took = seconds_between(F.col("created_at"), F.col("resolved_at"))
    return alerts.where(F.col("resolved_at").isNotNull()).groupBy(*by).agg(
        F.avg(took).alias("mttr_s"), F.count(F.lit(1)).alias("n")
    )


def mtbf(alerts: DataFrame, by: Sequence[str] = ("system_id",)) -> DataFrame:
    """Mean gap between failures.

    The gaps of an ordered sequence add up to last minus first, so the mean needs
    no ordering at all.
    """
    n = F.count(F.lit(1))
    total = seconds_between(F.min("created_at"), F.max("created_at"))
    return alerts.groupBy(*by).agg(
        n.alias("n"), F.when(n > 1, total / (n - 1)).alias("mtbf_s")
    )


def availability(
    alerts: DataFrame, systems: DataFrame, start: Column, end: Column, chunk: str = "month"
) -> DataFrame:
    """1 - (union of outages) / window, for each of ``systems``.

    An outage runs from creation to resolution, or to ``end`` while it is open; a system without
    outages was available all the time.  Overlaps count once: each outage
    adds only what lies after the furthest end before it.
    """
    until = F.coalesce("resolved_at", end)
    outages = alerts.where((until > start) & (F.col("created_at") < end)).select(
        "system_id", "id", F.greatest("created_at", start).alias("o_start"),
        F.least(until, end).alias("o_end"),
    )
    seen = ordered.running(
        outages, ["system_id"], ["o_start", "id"], ordered.time_chunk("o_start", chunk),
        covered=ordered.max_before(F.col("o_end")),
    )
    extra = F.greatest(F.lit(0.0), seconds_between(F.greatest("o_start", "covered"), F.col("o_end")))
    window = seconds_between(start, end)
    lost = seen.groupBy("system_id").agg(F.sum(extra).alias("outage_s"))
    named = systems.select(F.col("id").alias("system_id"))
    return named.join(lost, "system_id", "left").fillna(0.0, ["outage_s"]).withColumn(
        "availability", 1 - F.col("outage_s") / window
    )
