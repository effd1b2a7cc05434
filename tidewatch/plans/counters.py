"""Queries: counters, gauges, histograms, rates and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import aggregate, counters as c
from tidewatch.plans.aggregates import rounded
from tidewatch.plans.registry import query
from tidewatch.plans.store import AT
from tidewatch.sources.views import as_of


@query("counter_totals", """
SELECT 'metrics_collected' AS family, system_id AS labels, count(*) AS total FROM metrics GROUP BY 2
UNION ALL SELECT 'alerts_triggered', system_id || '|' || severity, count(*) FROM alerts GROUP BY 2
UNION ALL SELECT 'http_requests', method || '|' || path || '|' || status, count(*) FROM http_requests GROUP BY 2
UNION ALL SELECT 'messages_processed', topic || '|' || processor || '|' || status, count(*) FROM messages GROUP BY 2
UNION ALL SELECT 'predictions', prediction_type || '|' || status, count(*) FROM requests GROUP BY 2
UNION ALL SELECT 'remediation', action_type || '|' || status || '|' || system_id, count(*) FROM actions GROUP BY 2
UNION ALL SELECT 'rollbacks', action_type || '|' || environment, count(*) FROM actions WHERE status = 'rolled_back' GROUP BY 2
UNION ALL SELECT 'errors', processor || '|' || topic, count(*) FROM messages WHERE status = 'error' GROUP BY 2
UNION ALL SELECT 'request_bytes', path, sum(length(path))::BIGINT FROM http_requests GROUP BY 2""")
def counter_totals(t):
    families = [
        c.counter_totals(t.metrics, "metrics_collected", ["system_id"]),
        c.counter_totals(t.alerts, "alerts_triggered", ["system_id", "severity"]),
        c.counter_totals(t.http_requests, "http_requests", ["method", "path", "status"]),
        c.counter_totals(t.messages, "messages_processed", ["topic", "processor", "status"]),
        c.counter_totals(t.requests, "predictions", ["prediction_type", "status"]),
        c.counter_totals(t.actions, "remediation", ["action_type", "status", "system_id"]),
        c.counter_totals(t.actions.where("status = 'rolled_back'"), "rollbacks", ["action_type", "environment"]),
        c.counter_totals(t.messages.where("status = 'error'"), "errors", ["processor", "topic"]),
        c.counter_totals(t.http_requests, "request_bytes", ["path"], F.length("path")),
    ]
    return aggregate.union(families)


@query("gauge_last", """
SELECT name, labels, round(value, 6) AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY name, labels ORDER BY ts DESC, id DESC) AS rn FROM metrics) q WHERE rn = 1""")
def gauge_last(t):
    return rounded(c.gauge_last(t.metrics, ["name", "labels"]), "value")


_LE = ", ".join(f"({b}::DOUBLE, '{b:.6g}')" for b in c.BUCKETS["default"])
_HIST = f"""
SELECT method, path, b.bound, b.le, count(*) FILTER (duration_s <= b.bound) AS cumulative, count(*) AS count, sum(duration_s) AS sum
FROM http_requests JOIN (VALUES {_LE}, ('inf'::DOUBLE, '+Inf')) b(bound, le) ON TRUE GROUP BY ALL"""


@query("histogram_cumulative", f"""
WITH h AS ({_HIST}) SELECT method, path, le, cumulative, count, round(sum, 4) AS sum FROM h""")
def histogram_cumulative(t):
    got = c.histogram_cumulative(t.http_requests, ["method", "path"], "duration_s", c.BUCKETS["default"])
    return got.withColumn("sum", F.round("sum", 4))


@query("quantile_hist", f"""
WITH h AS ({_HIST}), p AS (SELECT *, coalesce(lag(bound) OVER w, 0) AS lower, coalesce(lag(cumulative) OVER w, 0) AS below
  FROM h WINDOW w AS (PARTITION BY method, path ORDER BY bound)),
r AS (SELECT method, path, count, 0.9::DOUBLE * count AS rank, bound, lower, below, cumulative,
  row_number() OVER (PARTITION BY method, path ORDER BY bound) AS rn FROM p WHERE cumulative >= 0.9::DOUBLE * count)
SELECT method, path, count, round(CASE WHEN bound = 'inf'::DOUBLE THEN lower
  ELSE lower + (bound - lower) * coalesce((rank - below) / nullif(cumulative - below, 0), 0) END, 6) AS estimate
FROM r WHERE rn = 1""")
def quantile_hist(t):
    got = c.quantile_hist(t.http_requests, ["method", "path"], "duration_s", c.BUCKETS["default"], 0.9)
    return rounded(got, "estimate")


@query("throughput", """
SELECT topic, processor, time_bucket(INTERVAL 1 MINUTE, ts) AS window_start, count(*) AS n,
  round(count(*) / 60.0::DOUBLE, 6) AS per_second FROM messages GROUP BY ALL""")
def throughput(t):
    return rounded(c.throughput(t.messages), "per_second")


@query("error_rate_pct", """
SELECT topic, processor, count(*) AS n, round(100.0::DOUBLE * count(*) FILTER (status = 'error') / count(*), 6) AS error_pct
FROM messages GROUP BY ALL""")
def error_rate_pct(t):
    return rounded(c.error_rate_pct(t.messages, ["topic", "processor"]), "error_pct")


@query("pipeline_lag", f"""
SELECT topic, processor, round((epoch_us({AT}) - epoch_us(max(ts))) / 1e6, 6) AS lag_s FROM messages GROUP BY ALL""")
def pipeline_lag(t):
    return rounded(c.pipeline_lag(t.messages, ["topic", "processor"], as_of()), "lag_s")


@query("promql_avg", """
SELECT name, round(avg(value), 6) AS value, count(*) AS series FROM (
  SELECT system_id, name, arg_max(value, ts) AS value FROM metrics
  WHERE ts > TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 6 HOUR AND ts <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY ALL) q
GROUP BY name""")
def promql_avg(t):
    at = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    return rounded(c.promql_avg(t.metrics, at, "6 hours"), "value")


_INCREASE = """
SELECT id, system_id, name, ts, CASE WHEN before IS NOT NULL THEN CASE WHEN value < before THEN value ELSE value - before END END AS increase
FROM (SELECT *, lag(value) OVER (PARTITION BY system_id, name ORDER BY ts, id) AS before FROM metrics {where}) q"""


@query("counter_increase", f"""
WITH i AS ({_INCREASE.format(where='')}) SELECT id, system_id, name, round(increase, 6) AS increase FROM i""")
def counter_increase(t):
    return rounded(c.counter_increase(t.metrics), "increase").select("id", "system_id", "name", "increase")


@query("promql_rate", f"""
WITH i AS ({_INCREASE.format(where=f"WHERE ts > {AT} - INTERVAL 7 DAY AND ts <= {AT}")})
SELECT system_id, name, count(*) AS samples,
  round(sum(increase) / nullif((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 0), 6) AS rate FROM i GROUP BY system_id, name""")
def promql_rate(t):
    return rounded(c.promql_rate(t.metrics, as_of(), "7d"), "rate")


_VALID = "(value >= 0 AND (name NOT IN ('cpu_usage', 'memory_usage') OR value <= 100))"


@query("data_quality", f"""
WITH q AS (SELECT system_id, count(DISTINCT date_trunc('hour', ts)) AS present,
    count(*) FILTER {_VALID.replace('(value', '(WHERE value', 1)} / count(*)::DOUBLE AS validity,
    (epoch_us({AT}) - epoch_us(max(ts))) / 3.6e9 AS age_h
  FROM metrics WHERE ts >= {AT} - INTERVAL 168 HOUR AND ts < {AT} GROUP BY system_id),
s AS (SELECT s.id AS system_id, present, coalesce(present / 168.0::DOUBLE * validity * greatest(0, 1 - age_h / 168), 0) AS score
  FROM systems s LEFT JOIN q ON q.system_id = s.id)
SELECT system_id, 168 - coalesce(present, 0) AS missing_hours, round(score, 6) AS score, score < 0.7 AS flagged FROM s""")
def data_quality(t):
    return rounded(c.data_quality(t.metrics, t.systems, as_of()), "score")


@query("missing_points", f"""
SELECT s.id AS system_id, h AS hour FROM systems s,
  UNNEST(generate_series({AT} - INTERVAL 168 HOUR, {AT} - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) g(h)
WHERE NOT EXISTS (SELECT 1 FROM metrics m WHERE m.system_id = s.id AND date_trunc('hour', m.ts) = h)""")
def missing_points(t):
    return c.missing_points(t.metrics, t.systems, as_of())


@query("data_quality_report", f"""
WITH m AS (SELECT name, system_id, ts, CASE WHEN id % 23 <> 0 THEN value - CASE WHEN id % 29 = 0 THEN 1000 ELSE 0 END END AS value
  FROM metrics UNION ALL SELECT name, system_id, ts, value FROM metrics WHERE id % 41 = 0)
SELECT name, count(*) AS n, count(*) FILTER (value IS NULL) AS nulls,
  count(*) - count(DISTINCT (system_id, ts)) AS duplicates, count(*) FILTER (NOT {_VALID}) AS out_of_range,
  count(*) FILTER (ts > TIMESTAMP '2024-01-25 00:00:00') AS future FROM m GROUP BY name""")
def data_quality_report(t):
    """Samples with nulls, duplicates and impossible values mixed in."""
    i = F.col("id")
    spoiled = t.metrics.withColumn(
        "value", F.when(i % 23 != 0, F.col("value") - F.when(i % 29 == 0, 1000).otherwise(0))
    )
    df = spoiled.unionByName(t.metrics.where(i % 41 == 0))
    return c.data_quality_report(df, F.lit("2024-01-25 00:00:00").cast("timestamp_ntz"))


@query("cardinality_guard", """
SELECT name, count(DISTINCT labels) AS cardinality, count(DISTINCT labels) > 90 AS exceeded FROM metrics GROUP BY name""")
def cardinality_guard(t):
    return c.cardinality_guard(t.metrics, 90)


@query("service_metrics", """
SELECT count(*) AS total_predictions, round(avg(latency_ms), 6) AS average_response_time,
  round(count(*) FILTER (status = 'ok') / count(*)::DOUBLE, 6) AS success_rate FROM requests""")
def service_metrics(t):
    return rounded(c.service_metrics(t.requests), "average_response_time", "success_rate")
