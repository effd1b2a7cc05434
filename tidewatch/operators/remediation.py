"""Remediation: safety, approvals, caps, history, and the business reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.conditions import reasons
from tidewatch.operators import ordered, quantiles
from tidewatch.operators.alerts import seconds_between

# Action types allowed, and the load above which nothing is done.
ALLOWED_TYPES = ("restart", "scale", "update_config")
SAFETY_LIMITS = {"cpu_usage": 80.0, "memory_usage": 85.0, "disk_usage": 90.0}


def safety_gate(actions: DataFrame, latest: DataFrame, restricted: Sequence[str] = ()) -> DataFrame:
    """Reasons against each action; none means it is allowed.

    An unknown action type, and an unknown environment where some are restricted, count
    against the action.  A system without a latest point has no load that could.

    The latest points are first turned into one row per system, so each action
    meets one row.
    """
    load = latest.where(F.col("name").isin(*SAFETY_LIMITS)).groupBy("system_id").agg(
        *[F.max(F.when(F.col("name") == n, F.col("value"))).alias(f"__{n}") for n in SAFETY_LIMITS]
    )
    checks = [("action type", F.coalesce(~F.col("action_type").isin(*ALLOWED_TYPES), F.lit(True)))]
    if restricted:
        checks.append(("environment", F.coalesce(F.col("environment").isin(*restricted), F.lit(True))))
    checks += [(n, F.col(f"__{n}") >= limit) for n, limit in SAFETY_LIMITS.items()]
    out = actions.join(load, "system_id", "left").withColumn("reasons", reasons(*checks))
    return out.withColumn("allowed", F.size("reasons") == 0).drop(*[f"__{n}" for n in SAFETY_LIMITS])


def safety_hourly_cap(actions: DataFrame, cap: int = 50) -> DataFrame:
    """Actions in the hour up to each action, over all systems, and whether that is too many.

    A window without a key would run in one task; the sums are taken over slices
    of an hour.
    """
    counted = ordered.trailing_sums(actions, [], "requested_at", 3600, True, last_hour=F.lit(1).cast("long"))
    return counted.withColumn("over_cap", F.col("last_hour") > cap)


def approval_expiry(actions: DataFrame, as_of: Column, timeout_s: int = 1800) -> DataFrame:
    """Pending actions that waited longer than the timeout expire."""
    waited = seconds_between(F.col("requested_at"), as_of)
    expired = (F.col("status") == "pending") & (waited > timeout_s)
    return actions.withColumn("status", F.when(expired, "expired").otherwise(F.col("status")))


def remediation_stats(actions: DataFrame, by: Sequence[str] = ("action_type",)) -> DataFrame:
    n = F.count(F.lit(1))
    rolled_back = F.count_if(F.col("status") == "rolled_back")
    return actions.groupBy(*by).agg(
        n.alias("attempts"), F.count_if(F.col("status") == "succeeded").alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "running").alias("active"),
        (rolled_back / n).alias("rollback_rate"), F.avg("duration_s").alias("avg_duration_s"),
        F.max("duration_s").alias("max_duration_s"),
    )


def remediation_history(actions: DataFrame, start: Column, end: Column) -> DataFrame:
    chosen = actions.where(F.col("requested_at").between(start, end))
    return chosen.orderBy(F.desc("requested_at"), F.desc("action_id"))


def audit_report(actions: DataFrame, start: Column, end: Column) -> DataFrame:
    """Counts of action and result in a time range, and the number of systems concerned."""
    per_system = actions.where(F.col("requested_at").between(start, end)).groupBy(
        "action_type", "status", "system_id"
    ).agg(F.count(F.lit(1)).alias("n"), F.min("requested_at").alias("first_at"), F.max("requested_at").alias("last_at"))
    return per_system.groupBy("action_type", "status").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("systems"), F.min("first_at").alias("first_at"),
        F.max("last_at").alias("last_at"),
    )


def compliance_status(gated: DataFrame, required: float = 0.9) -> DataFrame:
    """Share of actions of each system that passed the safety checks."""
    ratio = F.count_if("allowed") / F.count(F.lit(1))
    return gated.groupBy("system_id").agg(
        F.count(F.lit(1)).alias("checks"), ratio.alias("pass_ratio"), (ratio >= required).alias("compliant")
    )


def roi_savings(
    df: DataFrame, downtime_cost: float = 300_000.0, labor_cost: float = 150.0
) -> DataFrame:
    """Downtime hours x cost + staff hours x cost + infrastructure savings, per row."""
    return df.withColumn(
        "savings",
        F.col("downtime_hours") * downtime_cost + F.col("staff_hours") * labor_cost + F.col("infra_savings"),
    )


def alert_costs(alerts: DataFrame, staff_hours_per_alert: float, infra_savings_per_alert: float) -> DataFrame:
    """Inputs of :func:`roi_savings` per system, from its resolved alerts."""
    hours = seconds_between(F.col("created_at"), F.col("resolved_at")) / 3600
    return alerts.where(F.col("resolved_at").isNotNull()).groupBy("system_id").agg(
        F.sum(hours).alias("downtime_hours"), (F.count(F.lit(1)) * staff_hours_per_alert).alias("staff_hours"),
        (F.count(F.lit(1)) * infra_savings_per_alert).alias("infra_savings"),
    )


def analytics_summary(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy(F.to_date("created_at").alias("day"), "severity", "status").agg(
        F.count(F.lit(1)).alias("n")
    )


def analytics_performance(requests: DataFrame) -> DataFrame:
    """Latency percentiles and error share by path."""
    shares = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    latency = quantiles.exact_percentiles(requests, ["path"], "duration_s", shares)
    counts = requests.groupBy("path").agg(
        F.count(F.lit(1)).alias("n"), (F.count_if(F.col("status") >= 400) / F.count(F.lit(1))).alias("error_share")
    )
    return latency.join(counts, "path")


def resource_inventory(systems: DataFrame) -> DataFrame:
    return systems.groupBy("type", "status").agg(
        F.count(F.lit(1)).alias("n"), F.min("created_at").alias("first_created"),
        F.max("created_at").alias("last_created"),
    )


def insights(metrics: DataFrame, names: Sequence[str], grid: str = "1 hour", top: int | None = None) -> DataFrame:
    """Correlation of metric pairs on a common time grid, strongest first.

    The samples become one row per grid cell with a column per metric; all pairs
    are then correlated in a single aggregation.
    """
    cells = metrics.groupBy(F.window("ts", grid).alias("w")).agg(
        *[F.avg(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names]
    )
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    both = {(a, b): F.col(a).isNotNull() & F.col(b).isNotNull() for a, b in pairs}
    wide = cells.agg(
        *[F.corr(F.when(both[p], F.col(p[0])), F.when(both[p], F.col(p[1]))).alias(f"c{i}") for i, p in enumerate(pairs)],
        *[F.count_if(both[p]).alias(f"n{i}") for i, p in enumerate(pairs)],
    )
    rows = [
        F.struct(F.lit(a).alias("metric_a"), F.lit(b).alias("metric_b"), F.col(f"c{i}").alias("correlation"), F.col(f"n{i}").alias("n"))
        for i, (a, b) in enumerate(pairs)
    ]
    out = wide.select(F.inline(F.array(*rows)))
    if top is None:
        return out
    return out.orderBy(F.desc(F.abs("correlation")), "metric_a", "metric_b").limit(top)
