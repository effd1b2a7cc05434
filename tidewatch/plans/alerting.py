"""Queries: alert rows, notifications, episodes, incidents and availability."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import ids
from tidewatch.functions.labels import combine_labels, decode_labels, encode_labels
from tidewatch.operators import alerts as al, latest, selection
from tidewatch.plans.aggregates import rounded
from tidewatch.plans.joins import EVALUATED, evaluated
from tidewatch.plans.registry import query
from tidewatch.plans.store import AT, r6
from tidewatch.sources.views import as_of


@query("latest_metrics", """
SELECT system_id, name, round(value, 6) AS value, unit, labels, ts FROM latest""")
def latest_metrics(t):
    return latest.latest_metrics(t.metrics).withColumn("value", r6("value"))


@query("latest_metrics_limited", """
SELECT system_id, name, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY system_id ORDER BY name) AS r FROM latest) q WHERE r <= 2""")
def latest_metrics_limited(t):
    """The first two names of each system, as a limit on the name-ordered list gives."""
    return latest.latest_metrics(t.metrics, limit=2).select("system_id", "name", "ts")


@query("alerts_top_n", """
SELECT system_id, id, created_at FROM (
  SELECT *, row_number() OVER (PARTITION BY system_id ORDER BY created_at DESC, id) AS r FROM alerts) q WHERE r <= 3""")
def alerts_top_n(t):
    """Three newest alerts per system; Spark limits each group before the shuffle too."""
    from pyspark.sql.window import Window

    newest = Window.partitionBy("system_id").orderBy(F.desc("created_at"), "id")
    return (
        t.alerts.select("system_id", "id", "created_at").withColumn("r", F.row_number().over(newest))
        .where("r <= 3").drop("r")
    )


@query("combine_labels", f"""
WITH e AS ({EVALUATED}) SELECT id, '{{"k":"rule","team":"' || json_extract_string(labels, '$.team') || '"}}' AS rule_wins,
  '{{"k":"' || json_extract_string(metric_labels, '$.k') || '"}}' AS no_rule_labels FROM e""")
def combine_labels_query(t):
    metric, rule = decode_labels(F.col("metric_labels")), decode_labels(F.col("labels"))
    none = F.lit(None).cast("map<string,string>")
    return evaluated(t).select(
        "id", encode_labels(combine_labels(metric, rule)).alias("rule_wins"),
        encode_labels(combine_labels(metric, none)).alias("no_rule_labels"),
    )


@query("alert_project", f"""
WITH e AS ({EVALUATED}) SELECT id AS rule_id, system_id, 'Alert: ' || name AS name, coalesce(severity, 'medium') AS severity,
  'active' AS status, metric_name, round(metric_value, 6) AS metric_value, threshold, operator,
  '{{"k":"rule","team":"' || json_extract_string(labels, '$.team') || '"}}' AS labels, {AT} AS created_at
FROM e WHERE triggered""")
def alert_project(t):
    got = al.alert_project(evaluated(t).where("triggered"), as_of())
    return rounded(got, "metric_value").drop("id", "channels", "updated_at")


@query("entity_ids", """
SELECT id AS sample_id, 'alert_' || sha256(system_id || ',' || name || ',' || id) AS alert_id,
  'pred_' || sha256(system_id || ',' || id) AS prediction_id FROM metrics""")
def entity_ids(t):
    return t.metrics.select(
        F.col("id").alias("sample_id"), ids.entity_id("alert_", "system_id", "name", "id").alias("alert_id"),
        ids.entity_id("pred_", "system_id", "id").alias("prediction_id"),
    )


@query("notification_rows", f"""
WITH e AS ({EVALUATED}), c AS (SELECT id AS rule_id, unnest(string_split(channels, ',')) AS channel FROM e WHERE triggered)
SELECT rule_id, channel, 'triggered' AS type, channel IN ('email', 'slack', 'webhook', 'pagerduty') AS known
FROM c WHERE channel <> 'slack'""")
def notification_rows(t):
    """Slack is switched off; fax is not a channel."""
    opened = al.alert_project(evaluated(t).where("triggered"), as_of())
    got = al.notification_rows(opened, "triggered", enabled=("email", "webhook", "pagerduty"))
    return got.select("rule_id", "channel", "type", "known")


@query("resolution_notices", f"""
WITH e AS ({EVALUATED}), calm AS (SELECT system_id, metric_name, arg_min(channels, id) AS channels FROM e WHERE NOT triggered GROUP BY 1, 2),
r AS (SELECT a.id, unnest(string_split(c.channels, ',')) AS channel FROM alerts a JOIN calm c USING (system_id, metric_name) WHERE a.status = 'active')
SELECT id, channel, 'resolved' AS type, channel IN ('email', 'slack', 'webhook', 'pagerduty') AS known FROM r WHERE channel <> 'slack'""")
def resolution_notices(t):
    """Notifications of the alerts that calm rules resolve, through the channels of the rule."""
    resolved = al.alerts_to_resolve(evaluated(t), t.alerts, as_of())
    got = al.notification_rows(resolved, "resolved", enabled=("email", "webhook", "pagerduty"))
    return got.select("id", "channel", "type", "known")


@query("priority_channels", """
SELECT id, channel, priority, row_number() OVER (PARTITION BY id ORDER BY priority, channel)::INT AS position FROM (
  SELECT id, c.channel, c.priority FROM alerts JOIN (VALUES ('pagerduty', 1, '^critical'), ('slack', 2, 'cpu|memory'),
    ('email', 3, '')) c(channel, priority, f) ON regexp_matches(severity || ' ' || metric_name, f)) q""")
def priority_channels(t):
    channels = [
        ("email", True, 3, []), ("slack", True, 2, ["cpu", "memory"]), ("webhook", False, 1, []),
        ("pagerduty", True, 1, ["^critical"]),
    ]
    return al.priority_channels(t.alerts, channels).select("id", "channel", "priority", "position")


EPISODES = """
SELECT rule_id, system_id, name, duration_s, episode, min(ts) FILTER (breach) AS opened_at,
  max(ts) FILTER (breach) AS last_breach_at, min(ts) FILTER (NOT breach) AS resolved_at,
  max(value) FILTER (breach) AS peak, count(*) FILTER (breach) AS n
FROM (SELECT *, sum(CASE WHEN breach AND NOT coalesce(was, FALSE) THEN 1 ELSE 0 END)
    OVER (PARTITION BY rule_id ORDER BY ts, sid)::BIGINT AS episode
  FROM (SELECT *, lag(breach) OVER (PARTITION BY rule_id ORDER BY ts, sid) AS was
    FROM (SELECT r.id AS rule_id, m.system_id, m.name, r.duration_s, m.ts, m.id AS sid, m.value,
        CASE WHEN r.operator IN ('gt', '>') THEN m.value > r.threshold WHEN r.operator = 'gte' THEN m.value >= r.threshold
          WHEN r.operator = 'lt' THEN m.value < r.threshold ELSE FALSE END AS breach
      FROM rules r JOIN metrics m ON m.system_id = r.system_id AND m.name = r.metric_name WHERE r.enabled) a) b) c
WHERE episode > 0 GROUP BY rule_id, system_id, name, duration_s, episode"""


def _episodes(t):
    return al.alert_episodes(selection.enabled_rules(t.rules, t.systems), t.metrics, "day")


@query("alert_episodes", f"""
WITH e AS ({EPISODES}) SELECT rule_id, opened_at, last_breach_at, resolved_at, round(peak, 6) AS peak, n FROM e""")
def alert_episodes(t):
    return rounded(_episodes(t), "peak").select(
        "rule_id", "opened_at", "last_breach_at", "resolved_at", "peak", "n"
    )


@query("alert_sustained", f"""
WITH e AS ({EPISODES}) SELECT rule_id, opened_at, last_breach_at FROM e
WHERE epoch_us(last_breach_at) - epoch_us(opened_at) >= duration_s * 1000000::BIGINT""")
def alert_sustained(t):
    return al.alert_sustained(_episodes(t)).select("rule_id", "opened_at", "last_breach_at")


@query("incident_rollup", """
WITH a AS (SELECT *, lag(created_at) OVER (PARTITION BY system_id ORDER BY created_at, id) AS before FROM alerts),
b AS (SELECT *, sum(CASE WHEN before IS NULL OR epoch(created_at) - epoch(before) > 604800 THEN 1 ELSE 0 END)
  OVER (PARTITION BY system_id ORDER BY created_at, id)::BIGINT AS incident FROM a)
SELECT system_id, min(created_at) AS opened_at,
  CASE WHEN count(*) FILTER (resolved_at IS NULL) = 0 THEN max(resolved_at) END AS closed_at,
  arg_max(severity, CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS severity,
  count(*) AS n_alerts FROM b GROUP BY system_id, incident""")
def incident_rollup(t):
    """Alert times have day resolution here, so the gap is a week."""
    return al.incident_rollup(t.alerts, gap_seconds=7 * 86400)


@query("incident_timeline", """
WITH c AS (SELECT system_id, id AS alert_id, created_at AS changed_at, 'opened' AS state FROM alerts
  UNION ALL SELECT system_id, id, resolved_at, 'resolved' FROM alerts WHERE resolved_at IS NOT NULL)
SELECT system_id, alert_id, changed_at, state, row_number() OVER w AS position,
  (epoch_us(changed_at) - epoch_us(lag(changed_at) OVER w)) / 1e6 AS dwell_s
FROM c WINDOW w AS (PARTITION BY system_id ORDER BY changed_at, alert_id, state)""")
def incident_timeline(t):
    return al.incident_timeline(t.alerts)


@query("threshold_check", """
WITH lim AS (SELECT id AS system_id, 'cpu_usage' AS name, json_extract(thresholds, '$.cpu_usage')::DOUBLE AS threshold FROM systems
  UNION ALL SELECT id, 'memory_usage', json_extract(thresholds, '$.memory_usage')::DOUBLE FROM systems)
SELECT l.system_id, l.name, l.threshold, round(m.value, 6) AS value, m.value > l.threshold AS breach
FROM lim l JOIN latest m ON m.system_id = l.system_id AND m.name = l.name""")
def threshold_check(t):
    return rounded(al.threshold_check(t.systems, latest.latest_metrics(t.metrics)), "value")


@query("adaptive_thresholds", """
SELECT system_id, name, round(avg(value) + 3 * stddev_pop(value), 6) AS sigma_threshold,
  round(quantile_cont(value, 0.99), 6) AS p99, count(*) AS n FROM metrics GROUP BY system_id, name""")
def adaptive_thresholds(t):
    return rounded(al.adaptive_thresholds(t.metrics), "sigma_threshold", "p99")


@query("mttr", """
SELECT severity, round(avg(epoch(resolved_at) - epoch(created_at)), 6) AS mttr_s, count(*) AS n FROM alerts
WHERE resolved_at IS NOT NULL GROUP BY severity""")
def mttr(t):
    return rounded(al.mttr(t.alerts), "mttr_s")


@query("mtbf", """
SELECT system_id, count(*) AS n, round(avg(gap), 6) AS mtbf_s FROM (
  SELECT system_id, epoch(created_at) - epoch(lag(created_at) OVER (PARTITION BY system_id ORDER BY created_at)) AS gap
  FROM alerts) q GROUP BY system_id""")
def mtbf(t):
    return rounded(al.mtbf(t.alerts), "mtbf_s")


@query("availability", """
WITH w AS (SELECT TIMESTAMP '1996-01-01 00:00:00' AS a, TIMESTAMP '1998-01-01 00:00:00' AS b),
o AS (SELECT system_id, id, greatest(created_at, a) AS s, least(coalesce(resolved_at, b), b) AS e FROM alerts JOIN w ON TRUE
  WHERE coalesce(resolved_at, b) > a AND created_at < b),
c AS (SELECT *, max(e) OVER (PARTITION BY system_id ORDER BY s, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cov FROM o)
SELECT y.id AS system_id, coalesce(sum(greatest(0, epoch(e) - epoch(greatest(s, cov)))), 0)::DOUBLE AS outage_s,
  round(1 - coalesce(sum(greatest(0, epoch(e) - epoch(greatest(s, cov)))), 0) / 63158400.0::DOUBLE, 6) AS availability
FROM systems y LEFT JOIN c ON c.system_id = y.id GROUP BY y.id""")
def availability(t):
    bounds = [F.lit(x).cast("timestamp_ntz") for x in ("1996-01-01 00:00:00", "1998-01-01 00:00:00")]
    return rounded(al.availability(t.alerts, t.systems, *bounds), "availability")
