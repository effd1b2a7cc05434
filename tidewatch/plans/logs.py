"""Queries: log records, identifiers and templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import ids
from tidewatch.functions.times import to_instant
from tidewatch.operators import logs as lg
from tidewatch.plans.registry import query


@query("mask_sensitive", """
SELECT log_id, CASE WHEN log_id % 9 = 0 THEN extra ELSE '{"user":"u' || log_id ||
  '","password":"***MASKED***","api_key":"***MASKED***","ctx":{"token":"***MASKED***","n":' || (log_id % 10) || '}}' END AS extra FROM logs""")
def mask_sensitive(t):
    return lg.mask_sensitive(t.logs, "extra").select("log_id", "extra")


@query("correlation_fill", """
SELECT log_id, coalesce(correlation_id, request_id, 'unknown') AS correlation_id FROM logs""")
def correlation_fill(t):
    return lg.correlation_fill(t.logs).select("log_id", "correlation_id")


@query("service_tags", """
SELECT log_id, level, 'prediction' AS service, 'ml-engine' AS component, '1.0.0' AS version FROM logs""")
def service_tags(t):
    tagged = lg.service_tags(t.logs, "prediction", "ml-engine", "1.0.0")
    return tagged.select("log_id", "level", "service", "component", "version")


@query("log_entry_json", """
SELECT log_id, '{"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '","level":"' || level || '","logger":"' || service ||
  '","correlation_id":"' || coalesce(correlation_id, request_id, 'unknown') || '"' ||
  CASE WHEN request_id IS NOT NULL THEN ',"request_id":"' || request_id || '"' ELSE '' END || ',"user_id":"' || user_id || '"' ||
  CASE WHEN log_id % 9 <> 0 THEN ',"user":"u' || log_id || '","n":"' || (log_id % 10) || '"}' ELSE '}' END AS entry FROM logs""")
def log_entry_json(t):
    """Some records have extra fields, one of them private."""
    i = F.col("log_id")
    extra = F.when(i % 9 != 0, F.create_map(
        F.lit("user"), F.concat(F.lit("u"), i), F.lit("_private"), F.lit("x"), F.lit("n"), (i % 10).cast("string")
    )).otherwise(F.create_map(F.lit("_private"), F.lit("x")))
    df = lg.correlation_fill(t.logs).withColumns(
        {"timestamp": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), "logger": F.col("service")}
    )
    standard = ["timestamp", "level", "logger", "correlation_id", "request_id", "user_id"]
    return lg.log_entry_json(df, standard, extra).select("log_id", "entry")


@query("client_id", """
SELECT request_id, coalesce('user:' || user_id, 'ip:' || ip) AS client, coalesce('user_' || user_id, ip) AS gateway_client FROM http_requests""")
def client_id(t):
    user, ip = F.col("user_id"), F.col("ip")
    return t.http_requests.select(
        "request_id", ids.client_id(user, ip).alias("client"), ids.client_id(user, ip, "gateway").alias("gateway_client")
    )


@query("request_hash", """
SELECT request_id, substr(sha256((epoch_us(ts) * 1000)::VARCHAR || '-' || ip), 1, 16) AS hash FROM http_requests""")
def request_hash(t):
    nanos = F.unix_micros(to_instant(F.col("ts"))) * 1000
    return t.http_requests.select("request_id", ids.request_hash(nanos, F.col("ip")).alias("hash"))


@query("analyze_logs", r"""
WITH x AS (SELECT level, ts, trim(regexp_replace(regexp_replace(regexp_replace(message, '0[xX][0-9a-fA-F]+', '<hex>', 'g'),
  '[0-9]+', '<num>', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS tpl FROM logs)
SELECT md5(tpl) AS template_id, level, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen, max(length(tpl))::INT AS length, min(tpl) AS template
FROM x GROUP BY 1, 2""")
def analyze_logs(t):
    return lg.analyze_logs(t.logs)
