"""Queries: lookups, ranges, filters and validation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidewatch.functions.conditions import alert_condition
from tidewatch.operators import logs, selection as sel, validation as val
from tidewatch.plans.registry import query
from tidewatch.plans.store import AT, r6
from tidewatch.sources.views import as_of


def ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


@query("metrics_time_range", """
SELECT id, system_id, name, round(value, 6) AS value, ts FROM metrics
WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 12:00:00'""")
def metrics_time_range(t):
    got = sel.metrics_time_range(t.metrics, ntz("2024-01-10 00:00:00"), ntz("2024-01-12 12:00:00"))
    return got.select("id", "system_id", "name", r6("value").alias("value"), "ts")


@query("historical_metrics", f"""
SELECT 'default' AS kind, id, name, ts FROM metrics WHERE ts BETWEEN {AT} - INTERVAL 24 HOUR AND {AT}
UNION ALL SELECT '90m', id, name, ts FROM metrics WHERE ts BETWEEN {AT} - INTERVAL 90 MINUTE AND {AT}
UNION ALL SELECT 'bounds', id, name, ts FROM metrics
  WHERE ts BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-04 06:00:00'""")
def historical_metrics(t):
    kinds = {
        "default": {}, "90m": {"range_text": "1h30m"},
        "bounds": {"start": "2024-01-03T00:00:00", "end": "2024-01-04T06:00:00"},
    }
    out = None
    for kind, args in kinds.items():
        part = sel.historical_metrics(t.metrics, as_of(), **args).select(F.lit(kind).alias("kind"), "id", "name", "ts")
        out = part if out is None else out.unionByName(part)
    return out


@query("historical_checked", """
SELECT system_id, name, count(*) AS n FROM metrics
WHERE ts BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND TIMESTAMP '2024-01-31 23:00:00' GROUP BY ALL""")
def historical_checked(t):
    """Thirty days and 23 hours: still thirty whole days."""
    return sel.historical_checked(t.metrics, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 31, 23))


@query("metric_name_filter", """
SELECT id, name, round(value, 6) AS value FROM metrics WHERE name IN ('cpu_usage', 'error_rate')""")
def metric_name_filter(t):
    got = sel.metric_name_filter(t.metrics, ["cpu_usage", "error_rate"])
    return got.select("id", "name", r6("value").alias("value"))


@query("system_by_id", """
SELECT q.id, s.name, s.type, s.created_at, CASE WHEN s.id IS NULL THEN q.id || ' not found' END AS error
FROM (SELECT DISTINCT 'sys-' || (user_id * 3) AS id FROM events) q LEFT JOIN systems s ON s.id = q.id""")
def system_by_id(t):
    ids = t.events.select(F.concat(F.lit("sys-"), F.col("user_id") * 3).alias("id")).distinct()
    return sel.by_id(t.systems, ids).select("id", "name", "type", "created_at", "error")


@query("alert_by_id", """
SELECT q.id, a.system_id, a.severity, a.status, CASE WHEN a.id IS NULL THEN q.id || ' not found' END AS error
FROM (SELECT 'alert_' || (event_id * 2) AS id FROM events) q LEFT JOIN alerts a ON a.id = q.id""")
def alert_by_id(t):
    ids = t.events.select(F.concat(F.lit("alert_"), F.col("event_id") * 2).alias("id"))
    return sel.by_id(t.alerts, ids).select("id", "system_id", "severity", "status", "error")


@query("list_systems", "SELECT id, name, type, status, created_at FROM systems")
def list_systems(t):
    return sel.list_systems(t.systems).select("id", "name", "type", "status", "created_at")


@query("order_by_recency", """
SELECT id, ts, row_number() OVER (ORDER BY ts DESC, id DESC) AS position FROM metrics""")
def order_by_recency(t):
    """Newest-first positions, numbered without a single-task sort."""
    from tidewatch.operators import ordered

    reverse = (
        F.lit(0) - F.unix_micros(F.col("ts").cast("timestamp"))
    )
    df = t.metrics.select("id", "ts", reverse.alias("age"), (-F.col("id")).alias("minus_id"))
    out = ordered.running(
        df, [], ["age", "minus_id"], ordered.RowChunks(F.col("age"), 3_600_000_000), position=ordered.row_number()
    )
    return out.select("id", "ts", "position")


@query("active_alerts", """
SELECT id, system_id, severity, status, created_at FROM alerts WHERE status IN ('active', 'acknowledged')""")
def active_alerts(t):
    return sel.active_alerts(t.alerts).select("id", "system_id", "severity", "status", "created_at")


@query("list_alerts", """
SELECT id, system_id, severity, created_at FROM alerts ORDER BY created_at DESC, id LIMIT 50""")
def list_alerts(t):
    return sel.list_alerts(t.alerts).select("id", "system_id", "severity", "created_at")


@query("filter_alerts", """
SELECT id, system_id, severity, status FROM alerts WHERE severity = 'critical' AND status = 'active'""")
def filter_alerts(t):
    return sel.filter_alerts(t.alerts, severity="critical").select("id", "system_id", "severity", "status")


@query("alert_condition", """
SELECT m.id, op, CASE op WHEN 'gt' THEN value > t WHEN '>=' THEN value >= t WHEN 'lt' THEN value < t
  WHEN '<=' THEN value <= t WHEN 'eq' THEN value = t WHEN '!=' THEN value <> t ELSE FALSE END AS triggered
FROM (SELECT id, value, (id % 101)::DOUBLE AS t FROM metrics) m
CROSS JOIN (VALUES ('gt'), ('>='), ('lt'), ('<='), ('eq'), ('!='), ('about')) o(op)""")
def alert_condition_query(t):
    ops = F.array(*[F.lit(o) for o in ("gt", ">=", "lt", "<=", "eq", "!=", "about")])
    return t.metrics.select(
        "id", "value", (F.col("id") % 101).cast("double").alias("t"), F.explode(ops).alias("op")
    ).select("id", "op", alert_condition(F.col("value"), F.col("op"), F.col("t")).alias("triggered"))


@query("enabled_rules", """
SELECT r.id, r.system_id, r.metric_name FROM rules r JOIN systems s ON s.id = r.system_id
WHERE r.enabled AND s.type <> 'BUILDING'""")
def enabled_rules(t):
    known = t.systems.where("type <> 'BUILDING'")
    return sel.enabled_rules(t.rules, known).select("id", "system_id", "metric_name")


@query("status_regex_filter", """
SELECT request_id, status, path FROM http_requests WHERE regexp_full_match(status::VARCHAR, '5..|40.')""")
def status_regex_filter(t):
    return sel.status_regex_filter(t.http_requests, "5..|40.").select("request_id", "status", "path")


@query("http_error_filter", """
SELECT request_id, method, path, status, ts FROM http_requests WHERE status >= 400""")
def http_error_filter(t):
    return sel.http_error_filter(t.http_requests).select("request_id", "method", "path", "status", "ts")


@query("log_filter_patterns", """
SELECT log_id, level FROM logs WHERE NOT regexp_matches(message, 'http[s]?://|[0-9]{4}')""")
def log_filter_patterns(t):
    return logs.log_filter_patterns(t.logs, ["http[s]?://", "[0-9]{4}"]).select("log_id", "level")


@query("log_extract_fields", """
SELECT log_id, CASE WHEN log_id % 9 <> 0 THEN json_extract_string(x, '$.user') END AS user,
  CASE WHEN log_id % 9 <> 0 THEN json_extract_string(x, '$.ctx.n') END AS n,
  CASE WHEN log_id % 9 = 0 THEN extra END AS raw
FROM (SELECT *, CASE WHEN log_id % 9 = 0 THEN '{}' ELSE extra END AS x FROM logs)""")
def log_extract_fields(t):
    got = logs.log_extract_fields(t.logs, "extra", {"user": "$.user", "n": "$.ctx.n"})
    return got.select("log_id", "user", "n", "raw")


@query("log_size_limit", """
SELECT log_id, length(message) > 2000 AS truncated, md5(left(message, 2000)) AS digest FROM logs""")
def log_size_limit(t):
    got = logs.log_size_limit(t.logs, 2000)
    return got.select("log_id", "truncated", F.md5("message").alias("digest"))


@query("prediction_history", """
SELECT request_id, system_id, prediction_type, generated_at FROM requests
ORDER BY generated_at DESC, request_id LIMIT 100""")
def prediction_history(t):
    return sel.prediction_history(t.requests).select("request_id", "system_id", "prediction_type", "generated_at")


@query("custom_query", """
SELECT system_id, name, time_bucket(INTERVAL 1 DAY, ts) AS window_start,
  time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end, count(value) AS n,
  round(avg(value), 6) AS mean, round(max(value), 6) AS top
FROM metrics WHERE name IN ('cpu_usage', 'memory_usage') AND value >= 10 GROUP BY ALL""")
def custom_query(t):
    got = sel.custom_query(
        t.metrics, [("name", "in", ["cpu_usage", "memory_usage"]), ("value", "gte", 10.0)],
        ["system_id", "name"], {"n": ("count", "value"), "mean": ("avg", "value"), "top": ("max", "value")},
        ("ts", "1 day"),
    )
    return got.withColumns({"mean": r6("mean"), "top": r6("top")})


@query("validate_metric_points", """
SELECT id, concat_ws(',', CASE WHEN ts > TIMESTAMP '2024-01-20 00:00:00' THEN 'timestamp in the future' END,
  CASE WHEN id % 31 = 0 THEN 'no name' END, CASE WHEN id % 37 = 0 THEN 'no value' END) AS reasons FROM metrics""")
def validate_metric_points(t):
    points = t.metrics.select(
        "id", "ts", F.when(F.col("id") % 31 != 0, F.col("name")).alias("name"),
        F.when(F.col("id") % 37 != 0, F.col("value")).alias("value"),
    )
    got = val.validate_metric_points(points, ntz("2024-01-20 00:00:00"))
    return got.select("id", F.concat_ws(",", "reasons").alias("reasons"))


@query("validate_requests", """
SELECT request_id, concat_ws(',', CASE WHEN n_metrics < 1 THEN 'no metrics' END,
  CASE WHEN time_horizon NOT BETWEEN 1 AND 168 THEN 'time_horizon' END,
  CASE WHEN confidence_threshold NOT BETWEEN 0 AND 1 THEN 'confidence_threshold' END,
  CASE WHEN sensitivity NOT BETWEEN 0.1::DOUBLE AND 1 THEN 'sensitivity' END,
  CASE WHEN batch_size NOT BETWEEN 1 AND 100 THEN 'batch_size' END,
  CASE WHEN priority NOT BETWEEN 1 AND 10 THEN 'priority' END,
  CASE WHEN test_split NOT BETWEEN 0.1::DOUBLE AND 0.5::DOUBLE THEN 'test_split' END) AS reasons FROM requests""")
def validate_requests(t):
    got = val.validate_requests(t.requests)
    return got.select("request_id", F.concat_ws(",", "reasons").alias("reasons"))


@query("validate_series_lengths", """
SELECT vec_id, len(values) = len(values) - CASE WHEN vec_id % 6 = 0 THEN 1 ELSE 0 END AS valid FROM series_arrays""")
def validate_series_lengths(t):
    n = F.size("values") - F.when(F.col("vec_id") % 6 == 0, 1).otherwise(0)
    df = t.series_arrays.withColumn("timestamps", F.sequence(F.lit(1), n))
    return val.validate_series_lengths(df, "timestamps", "values").select("vec_id", "valid")


@query("validate_ranges_out", """
SELECT seq, concat_ws(',', CASE WHEN actual NOT BETWEEN 0 AND 1 THEN 'actual' END,
  CASE WHEN confidence NOT BETWEEN 0 AND 1 THEN 'confidence' END,
  CASE WHEN seq % 113 NOT BETWEEN 0 AND 100 THEN 'progress' END) AS reasons FROM predictions""")
def validate_ranges_out(t):
    df = t.predictions.withColumn("progress", F.col("seq") % 113)
    got = val.validate_ranges_out(df, ["actual", "confidence"], ["progress"])
    return got.select("seq", F.concat_ws(",", "reasons").alias("reasons"))
