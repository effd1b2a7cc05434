"""Queries: rule evaluation joins, enrichment, as-of and span joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import aggregate, alerts, latest, selection, sequential, traces
from tidewatch.plans.registry import query
from tidewatch.plans.store import AT, r6
from tidewatch.sources.views import as_of

EVALUATED = """
SELECT r.id, r.system_id, r.name, r.metric_name, r.operator, r.threshold, r.severity, r.labels, r.channels,
  l.value AS metric_value, l.labels AS metric_labels, l.ts AS metric_ts,
  CASE WHEN r.operator IN ('gt', '>') THEN l.value > r.threshold WHEN r.operator = 'gte' THEN l.value >= r.threshold
    WHEN r.operator = 'lt' THEN l.value < r.threshold ELSE FALSE END AS triggered
FROM rules r JOIN latest l ON l.system_id = r.system_id AND l.name = r.metric_name WHERE r.enabled"""


def evaluated(t):
    enabled = selection.enabled_rules(t.rules, t.systems)
    return alerts.rules_join_latest(enabled, latest.latest_metrics(t.metrics))


@query("rules_join_latest", f"""
WITH e AS ({EVALUATED}) SELECT id, system_id, metric_name, round(metric_value, 6) AS metric_value, metric_ts, triggered FROM e""")
def rules_join_latest(t):
    return evaluated(t).select(
        "id", "system_id", "metric_name", r6("metric_value").alias("metric_value"), "metric_ts", "triggered"
    )


@query("new_alerts_anti", f"""
WITH e AS ({EVALUATED}) SELECT id AS rule_id, system_id, metric_name, round(metric_value, 6) AS metric_value FROM e
WHERE triggered AND NOT EXISTS (SELECT 1 FROM alerts a WHERE a.status = 'active' AND a.system_id = e.system_id
  AND a.metric_name = e.metric_name)""")
def new_alerts_anti(t):
    got = alerts.new_alerts(evaluated(t), t.alerts, as_of())
    return got.select("rule_id", "system_id", "metric_name", r6("metric_value").alias("metric_value"))


@query("alerts_to_resolve", f"""
WITH e AS ({EVALUATED}), c AS (SELECT system_id, metric_name, arg_min(channels, id) AS channels FROM e WHERE NOT triggered GROUP BY ALL)
SELECT id, system_id, metric_name, 'resolved' AS status, {AT} AS resolved_at, c.channels
FROM alerts JOIN c USING (system_id, metric_name) WHERE status = 'active'""")
def alerts_to_resolve(t):
    got = alerts.alerts_to_resolve(evaluated(t), t.alerts, as_of())
    return got.select("id", "system_id", "metric_name", "status", "resolved_at", "channels")


SNAPSHOT = f"""
SELECT s.id, s.name, count(m.id) AS n,
  CASE WHEN count(m.id) = 0 THEN 'unknown' ELSE coalesce(arg_max(
    CASE WHEN m.name = 'memory_usage' THEN 'warning' ELSE 'critical' END, m.ts) FILTER (
      (m.name = 'cpu_usage' AND m.value > 90) OR (m.name = 'memory_usage' AND m.value > 85)
      OR (m.name = 'error_rate' AND m.value > 5)), 'healthy') END AS status,
  CASE WHEN count(m.id) = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, 100 - sum(CASE
    WHEN m.name = 'cpu_usage' AND m.value > 80 THEN 2 * (m.value - 80)
    WHEN m.name = 'memory_usage' AND m.value > 85 THEN 3 * (m.value - 85)
    WHEN m.name = 'error_rate' THEN 10 * m.value ELSE 0 END)) END AS health_score
FROM systems s LEFT JOIN metrics m ON m.system_id = s.id AND m.ts BETWEEN {AT} - INTERVAL 1 HOUR AND {AT}
GROUP BY s.id, s.name"""
OPEN = """
SELECT system_id, count(*) AS n_open, count(*) FILTER (severity = 'critical') AS n_critical FROM alerts
WHERE status IN ('active', 'acknowledged') GROUP BY system_id"""


@query("system_details", f"""
WITH s AS ({SNAPSHOT}), o AS ({OPEN})
SELECT s.id, s.name, s.n, round(s.health_score, 6) AS health_score, coalesce(n_open, 0) AS n_open,
  CASE WHEN n_critical > 0 THEN 'critical' WHEN n_open > 0 THEN 'warning' ELSE s.status END AS status
FROM s LEFT JOIN o ON o.system_id = s.id""")
def system_details(t):
    got = aggregate.system_details(t.systems, t.metrics, t.alerts, as_of())
    return got.select("id", "name", "n", r6("health_score").alias("health_score"), "n_open", "status")


@query("systems_metrics_join", f"""
SELECT s.id AS system_id, m.id, m.name, m.ts FROM systems s LEFT JOIN metrics m ON m.system_id = s.id
  AND m.ts BETWEEN {AT} - INTERVAL 7 DAY AND {AT}""")
def systems_metrics_join(t):
    got = aggregate.systems_metrics_join(t.systems, t.metrics, as_of(), "7d")
    return got.select("system_id", "id", "name", "ts")


@query("promql_instant_asof", """
SELECT system_id, name, eval_time, round(arg_max(value, ts), 6) AS value FROM (
  SELECT m.*, make_timestamp(g * 300000000) AS eval_time FROM metrics m,
    UNNEST(generate_series(CAST(ceil(epoch_us(ts) / 300000000.0::DOUBLE) AS BIGINT),
      CAST(ceil((epoch_us(ts) + 3600000000) / 300000000.0::DOUBLE) AS BIGINT) - 1)) u(g)) q
GROUP BY system_id, name, eval_time""")
def promql_instant_asof(t):
    """Every 5 minutes, newest sample of the hour before."""
    return latest.instant_grid(t.metrics, 300, 3600).withColumn("value", r6("value"))


@query("event_enrich", """
SELECT e.event_id, e.event_type, s.name AS system_name, n.n_name AS nation, r.r_name AS region
FROM events e LEFT JOIN systems s ON s.id = 'sys-' || (e.user_id * 2)
LEFT JOIN nation n ON n.n_nationkey = s.nation_key LEFT JOIN region r ON r.r_regionkey = n.n_regionkey""")
def event_enrich(t):
    """Some events name a system that does not exist."""
    dims = aggregate.system_dimension(t.systems, t.raw("nation"), t.raw("region"))
    events = t.events.select(
        "event_id", "event_type", F.concat(F.lit("sys-"), F.col("user_id") * 2).alias("system_id")
    )
    return aggregate.event_enrich(events, dims, "system_id").select(
        "event_id", "event_type", "system_name", "nation", "region"
    )


EDGES = """
SELECT p.service AS caller, c.service AS callee, count(*) AS calls, round(avg(c.duration_ms), 6) AS avg_ms,
  round(max(c.duration_ms), 6) AS max_ms
FROM spans c JOIN spans p ON p.trace_id = c.trace_id AND p.span_id = c.parent_span_id GROUP BY ALL"""


@query("span_parent_join", """
SELECT c.trace_id, c.span_id, c.service, p.service AS caller FROM spans c
JOIN spans p ON p.trace_id = c.trace_id AND p.span_id = c.parent_span_id""")
def span_parent_join(t):
    return traces.span_parents(t.spans).select("trace_id", "span_id", "service", "caller")


@query("topology_edges", EDGES)
def topology_edges(t):
    return traces.topology_edges(t.spans).withColumns({"avg_ms": r6("avg_ms"), "max_ms": r6("max_ms")})


@query("alert_suppress", """
WITH RECURSIVE tagged AS (
  SELECT id, system_id, metric_name, severity, created_at, CASE WHEN metric_name LIKE 'cpu%' THEN 5184000
    WHEN metric_name LIKE '%rate%' AND severity = 'low' THEN 31536000 END AS hold, metric_name LIKE 'cpu%' AS cpu
  FROM alerts),
o AS (SELECT *, row_number() OVER (PARTITION BY system_id, metric_name, cpu ORDER BY created_at, id) AS rn
  FROM tagged WHERE hold IS NOT NULL),
walk AS (SELECT id, system_id, metric_name, created_at, hold, rn, TRUE AS kept, created_at AS last FROM o WHERE rn = 1
  UNION ALL SELECT o.id, o.system_id, o.metric_name, o.created_at, o.hold, o.rn,
    epoch_us(o.created_at) - epoch_us(w.last) >= o.hold * 1000000::BIGINT,
    CASE WHEN epoch_us(o.created_at) - epoch_us(w.last) >= o.hold * 1000000::BIGINT THEN o.created_at ELSE w.last END
  FROM walk w JOIN o ON o.system_id = w.system_id AND o.metric_name = w.metric_name AND o.rn = w.rn + 1)
SELECT id, kept FROM walk UNION ALL SELECT id, TRUE FROM tagged WHERE hold IS NULL""")
def alert_suppress(t):
    """Sixty days for cpu alerts, a year for low error-rate alerts."""
    rules = [("^cpu", 60 * 86400, None), ("rate", 365 * 86400, "low")]
    df = t.alerts.select("id", "system_id", "metric_name", "severity", "created_at")
    return sequential.alert_suppress(df, rules).select("id", "kept")


@query("models_named_semi", """
SELECT model_name, accuracy, f1_score FROM model_metrics WHERE position IN (SELECT user_id * 3 FROM events)""")
def models_named_semi(t):
    """Names asked for come from the events; names without metrics are skipped."""
    asked = t.events.select(F.concat(F.lit("model-"), F.col("user_id") * 3).alias("model_name"))
    return aggregate.models_named(t.model_metrics, asked).select("model_name", "accuracy", "f1_score")
