"""Queries: remediation, audit, business reports, inventory and insights."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import counters, latest, remediation as rem, selection
from tidewatch.plans.aggregates import rounded
from tidewatch.plans.registry import query
from tidewatch.plans.store import AT
from tidewatch.sources.views import METRIC_OF_EVENT, as_of

RANGE = "TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-25 00:00:00'"


def _range():
    return [F.lit(x).cast("timestamp_ntz") for x in ("2024-01-05 00:00:00", "2024-01-25 00:00:00")]


GATE = """
SELECT a.*, concat_ws(',', CASE WHEN action_type NOT IN ('restart', 'scale', 'update_config') THEN 'action type' END,
  CASE WHEN environment IN ('staging') THEN 'environment' END, CASE WHEN c.value >= 80 THEN 'cpu_usage' END,
  CASE WHEN m.value >= 85 THEN 'memory_usage' END) AS reasons
FROM actions a LEFT JOIN latest c ON c.system_id = a.system_id AND c.name = 'cpu_usage'
LEFT JOIN latest m ON m.system_id = a.system_id AND m.name = 'memory_usage'"""


def _gated(t):
    return rem.safety_gate(t.actions, latest.latest_metrics(t.metrics), restricted=("staging",))


@query("safety_gate", f"WITH g AS ({GATE}) SELECT action_id, reasons, reasons = '' AS allowed FROM g")
def safety_gate(t):
    return _gated(t).select("action_id", F.concat_ws(",", "reasons").alias("reasons"), "allowed")


@query("compliance_status", f"""
WITH g AS ({GATE}) SELECT system_id, count(*) AS checks, round(count(*) FILTER (reasons = '') / count(*)::DOUBLE, 6) AS pass_ratio,
  count(*) FILTER (reasons = '') / count(*)::DOUBLE >= 0.5 AS compliant FROM g GROUP BY system_id""")
def compliance_status(t):
    return rounded(rem.compliance_status(_gated(t), 0.5), "pass_ratio")


@query("approval_expiry", f"""
SELECT action_id, CASE WHEN status = 'pending' AND epoch({AT}) - epoch(requested_at) > 1800 THEN 'expired' ELSE status END AS status FROM actions""")
def approval_expiry(t):
    return rem.approval_expiry(t.actions, as_of()).select("action_id", "status")


@query("remediation_stats", """
SELECT action_type, count(*) AS attempts, count(*) FILTER (status = 'succeeded') AS succeeded,
  count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'running') AS active,
  round(count(*) FILTER (status = 'rolled_back') / count(*)::DOUBLE, 6) AS rollback_rate,
  round(avg(duration_s), 6) AS avg_duration_s, round(max(duration_s), 6) AS max_duration_s FROM actions GROUP BY action_type""")
def remediation_stats(t):
    return rounded(rem.remediation_stats(t.actions), "rollback_rate", "avg_duration_s", "max_duration_s")


_BOUNDS = ", ".join(f"({b!r}::DOUBLE, '{b:.6g}')" for b in counters.BUCKETS["remediation"])


@query("remediation_durations", f"""
SELECT action_type, b.le, count(*) FILTER (duration_s <= b.bound) AS cumulative, count(*) AS count, round(sum(duration_s), 4) AS sum
FROM actions JOIN (VALUES {_BOUNDS}, ('inf'::DOUBLE, '+Inf')) b(bound, le) ON TRUE GROUP BY ALL""")
def remediation_durations(t):
    got = counters.histogram_cumulative(t.actions, ["action_type"], "duration_s", counters.BUCKETS["remediation"])
    return got.withColumn("sum", F.round("sum", 4))


@query("remediation_history", f"""
SELECT action_id, action_type, system_id, status, requested_at FROM actions WHERE requested_at BETWEEN {RANGE}""")
def remediation_history(t):
    got = rem.remediation_history(t.actions, *_range())
    return got.select("action_id", "action_type", "system_id", "status", "requested_at")


@query("audit_report", f"""
SELECT action_type, status, count(*) AS n, count(DISTINCT system_id) AS systems, min(requested_at) AS first_at,
  max(requested_at) AS last_at FROM actions WHERE requested_at BETWEEN {RANGE} GROUP BY ALL""")
def audit_report(t):
    return rem.audit_report(t.actions, *_range())


_COSTS = """
SELECT system_id, sum(epoch(resolved_at) - epoch(created_at)) / 3600 AS downtime_hours, count(*) * 0.5::DOUBLE AS staff_hours,
  count(*) * 20.0::DOUBLE AS infra_savings FROM alerts WHERE resolved_at IS NOT NULL GROUP BY system_id"""


def _costs(t):
    return rem.roi_savings(rem.alert_costs(t.alerts, 0.5, 20.0))


@query("roi_savings", f"""
WITH c AS ({_COSTS}) SELECT round(sum(downtime_hours), 4) AS downtime_hours, sum(staff_hours) AS staff_hours,
  round(sum(downtime_hours * 300000 + staff_hours * 150 + infra_savings), 2) AS savings FROM c""")
def roi_savings(t):
    return _costs(t).agg(
        F.round(F.sum("downtime_hours"), 4).alias("downtime_hours"), F.sum("staff_hours").alias("staff_hours"),
        F.round(F.sum("savings"), 2).alias("savings"),
    )


@query("analytics_cost", f"""
WITH c AS ({_COSTS}) SELECT system_id, round(downtime_hours, 4) AS downtime_hours, staff_hours, infra_savings,
  round(downtime_hours * 300000 + staff_hours * 150 + infra_savings, 2) AS savings FROM c""")
def analytics_cost(t):
    return _costs(t).withColumns({"downtime_hours": F.round("downtime_hours", 4), "savings": F.round("savings", 2)})


@query("analytics_summary", """
SELECT created_at::DATE AS day, severity, status, count(*) AS n FROM alerts GROUP BY ALL""")
def analytics_summary(t):
    return rem.analytics_summary(t.alerts)


@query("analytics_performance", """
SELECT path, round(quantile_cont(duration_s, 0.5) + 3.7e-9, 6) AS p50, round(quantile_cont(duration_s, 0.95) + 3.7e-9, 6) AS p95,
  round(quantile_cont(duration_s, 0.99) + 3.7e-9, 6) AS p99, count(*) AS n,
  round(count(*) FILTER (status >= 400) / count(*)::DOUBLE, 6) AS error_share FROM http_requests GROUP BY path""")
def analytics_performance(t):
    """Interpolated percentiles fall on rounding ties, so both sides are nudged off them."""
    got = rounded(rem.analytics_performance(t.http_requests), "error_share")
    return got.withColumns({c: F.round(F.col(c) + 3.7e-9, 6) for c in ("p50", "p95", "p99")})


@query("analytics_reports", """
SELECT severity, metric_name, count(id) AS n, round(avg(metric_value), 6) AS mean, max(created_at) AS newest
FROM alerts WHERE status <> 'resolved' GROUP BY ALL""")
def analytics_reports(t):
    """A report with chosen dimensions and measures."""
    got = selection.custom_query(
        t.alerts, [("status", "ne", "resolved")], ["severity", "metric_name"],
        {"n": ("count", "id"), "mean": ("avg", "metric_value"), "newest": ("max", "created_at")},
    )
    return rounded(got, "mean")


@query("resource_inventory", """
SELECT type, status, count(*) AS n, min(created_at) AS first_created, max(created_at) AS last_created FROM systems GROUP BY ALL""")
def resource_inventory(t):
    return rem.resource_inventory(t.systems)


@query("insights", """
WITH c AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, name, avg(value) AS v FROM metrics GROUP BY 1, 2),
names(name, p) AS (VALUES ('cpu_usage', 1), ('memory_usage', 2), ('error_rate', 3), ('response_time', 4), ('request_count', 5))
SELECT a.name AS metric_a, b.name AS metric_b, round(corr(a.v, b.v), 6) AS correlation, count(*) AS n
FROM c a JOIN names na ON na.name = a.name JOIN c b ON b.w = a.w JOIN names nb ON nb.name = b.name
WHERE na.p < nb.p GROUP BY a.name, b.name""")
def insights(t):
    names = [v[0] for v in METRIC_OF_EVENT.values()]
    return rounded(rem.insights(t.metrics, names), "correlation")
