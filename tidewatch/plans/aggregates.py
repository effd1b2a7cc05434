"""Queries: fleet, system, request and model aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import aggregate as agg
from tidewatch.plans.joins import OPEN, SNAPSHOT
from tidewatch.plans.registry import query
from tidewatch.plans.store import AT, r6
from tidewatch.sources.views import as_of


def rounded(df, *columns):
    return df.withColumns({c: r6(c) for c in columns})


@query("aggregated_metrics", f"""
SELECT m.name, count(*) AS count, round(sum(value) / count(*), 6) AS average, round(min(value), 6) AS minimum,
  round(max(value), 6) AS maximum, 0::BIGINT AS nan_count, (SELECT count(*) FROM systems) AS system_count,
  {AT} - INTERVAL 7 DAY AS start_time, {AT} AS end_time
FROM metrics m JOIN systems s ON s.id = m.system_id WHERE m.ts BETWEEN {AT} - INTERVAL 7 DAY AND {AT} GROUP BY m.name""")
def aggregated_metrics(t):
    got = agg.aggregated_metrics(t.metrics, t.systems, as_of(), "7d")
    return rounded(got, "average", "minimum", "maximum")


@query("system_status", f"""
SELECT s.id AS system_id, CASE WHEN count(m.id) = 0 THEN 'unknown' ELSE coalesce(arg_max(
    CASE WHEN m.name = 'memory_usage' THEN 'warning' ELSE 'critical' END, m.ts) FILTER (
      (m.name = 'cpu_usage' AND m.value > 90) OR (m.name = 'memory_usage' AND m.value > 85)
      OR (m.name = 'error_rate' AND m.value > 5)), 'healthy') END AS status
FROM systems s LEFT JOIN metrics m ON m.system_id = s.id AND m.ts BETWEEN {AT} - INTERVAL 7 DAY AND {AT} GROUP BY s.id""")
def system_status(t):
    return agg.system_status(t.metrics, t.systems, as_of(), "7d").select("system_id", "status")


@query("health_score", f"""
WITH s AS ({SNAPSHOT.replace("INTERVAL 1 HOUR", "INTERVAL 24 HOUR")})
SELECT id AS system_id, round(health_score, 6) AS health_score FROM s""")
def health_score(t):
    got = agg.health_score(t.metrics, t.systems, as_of(), "24h")
    return rounded(got, "health_score").select("system_id", "health_score")


@query("system_snapshot", f"""
WITH s AS ({SNAPSHOT}) SELECT id AS system_id, name AS system_name, status, round(health_score, 6) AS health_score, n FROM s""")
def system_snapshot(t):
    got = agg.system_snapshot(t.metrics, t.systems, as_of())
    return rounded(got, "health_score").select("system_id", "system_name", "status", "health_score", "n")


@query("overall_status", f"""
WITH s AS ({SNAPSHOT.replace("INTERVAL 1 HOUR", "INTERVAL 7 DAY")}), o AS ({OPEN})
SELECT s.id AS system_id, coalesce(n_open, 0) AS n_open,
  CASE WHEN n_critical > 0 THEN 'critical' WHEN n_open > 0 THEN 'warning' ELSE s.status END AS status
FROM s LEFT JOIN o ON o.system_id = s.id""")
def overall_status(t):
    snapshot = agg.system_snapshot(t.metrics, t.systems, as_of(), "7d")
    return agg.overall_status(snapshot, t.alerts).select("system_id", "n_open", "status")


@query("fleet_summary", """
SELECT round(avg(value) FILTER (name = 'cpu_usage'), 6) AS avg_cpu_usage,
  round(avg(value) FILTER (name = 'memory_usage'), 6) AS avg_memory_usage,
  round(avg(value) FILTER (name = 'response_time'), 6) AS avg_response_time,
  round(sum(value) FILTER (name = 'request_count'), 6) AS total_requests,
  round(avg(value) FILTER (name = 'error_rate'), 6) AS error_rate, count(DISTINCT system_id) AS systems
FROM metrics""")
def fleet_summary(t):
    got = agg.fleet_summary(t.metrics)
    return rounded(got, *[c for c in got.columns if c != "systems"])


@query("metric_trends", f"""
WITH g AS (SELECT system_id, name, regr_slope(value, x) AS slope, avg(value) AS mean, max(x) - min(x) AS hours FROM (
  SELECT *, (epoch_us(ts) - epoch_us({AT})) / 3.6e9 AS x FROM metrics) q GROUP BY system_id, name)
SELECT system_id, name, round(slope, 6) AS slope, round(mean, 6) AS mean,
  CASE WHEN slope * hours / nullif(mean, 0) > 0.05 THEN 'increasing' WHEN slope * hours / nullif(mean, 0) < -0.05 THEN 'decreasing'
  ELSE 'stable' END AS trend FROM g""")
def metric_trends(t):
    got = agg.metric_trends(t.metrics, as_of(), ("system_id", "name"))
    return rounded(got, "slope", "mean").select("system_id", "name", "slope", "mean", "trend")


@query("metric_percentiles", """
SELECT name, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90,
  round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99
FROM metrics GROUP BY name""")
def metric_percentiles(t):
    return rounded(agg.metric_percentiles(t.metrics), "p50", "p90", "p95", "p99")


@query("feature_vector", """
SELECT system_id, name, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min,
  round(max(value), 6) AS max, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS median,
  round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.75), 6) AS p75
FROM metrics GROUP BY system_id, name""")
def feature_vector(t):
    got = agg.feature_vector(t.metrics, ["system_id", "name"])
    return rounded(got, "mean", "std", "min", "max", "median", "p25", "p75")


@query("batch_summary", """
SELECT model_name, count(*) AS total_requests, count(p) AS successful, count(*) - count(p) AS failed,
  round(coalesce(avg(p), 0), 6) AS avg_probability, coalesce(max(p), 0) AS max_probability,
  count(*) FILTER (p > 0.7::DOUBLE) AS high_risk
FROM (SELECT model_name, CASE WHEN request_id % 19 <> 0 THEN probability END AS p FROM model_outputs) q GROUP BY model_name""")
def batch_summary(t):
    df = t.model_outputs.withColumn(
        "probability", F.when(F.col("request_id") % 19 != 0, F.col("probability"))
    )
    return rounded(agg.batch_summary(df, ["model_name"]), "avg_probability")


@query("requests_by_type", """
SELECT prediction_type, batch, count(*) AS n, min(request_id) AS first_id, max(request_id) AS last_id FROM (
  SELECT prediction_type, request_id,
    (row_number() OVER (PARTITION BY prediction_type ORDER BY generated_at, request_id) - 1) // 100 AS batch FROM requests) q
GROUP BY ALL""")
def requests_by_type(t):
    got = agg.requests_by_type(t.requests.select("prediction_type", "request_id", "generated_at"))
    return got.select(
        "prediction_type", "batch", "n", F.array_min("request_ids").alias("first_id"),
        F.array_max("request_ids").alias("last_id"),
    )


@query("weighted_confidence", """
SELECT vec_id, round(sum(abs(v) / i) / sum(1.0::DOUBLE / i), 6) AS confidence FROM (
  SELECT vec_id, unnest(values) AS v, generate_subscripts(values, 1) AS i FROM series_arrays) q GROUP BY vec_id""")
def weighted_confidence(t):
    df = t.series_arrays.select("vec_id", F.transform("values", lambda v: F.abs(v)).alias("confidences"))
    return rounded(agg.weighted_confidence(df, "confidences"), "confidence").drop("confidences")


ENSEMBLE = """
SELECT request_id, sum(probability * w) / sum(w) AS probability, sum(confidence * w) / sum(w) AS confidence FROM (
  SELECT *, confidence * CASE model_name WHEN 'lstm' THEN 0.3::DOUBLE WHEN 'transformer' THEN 0.3
    WHEN 'random_forest' THEN 0.25 WHEN 'isolation_forest' THEN 0.15 ELSE 0.1 END AS w FROM model_outputs) q
GROUP BY request_id"""


@query("ensemble_probability", f"""
WITH e AS ({ENSEMBLE}) SELECT request_id, round(probability, 6) AS probability, round(confidence, 6) AS confidence FROM e""")
def ensemble_probability(t):
    return rounded(agg.ensemble_probability(t.model_outputs), "probability", "confidence")


SCORES_SQL = """
SELECT model_name, position, 'accuracy' AS metric, accuracy AS value FROM model_metrics
UNION ALL SELECT model_name, position, 'precision', precision FROM model_metrics
UNION ALL SELECT model_name, position, 'recall', recall FROM model_metrics
UNION ALL SELECT model_name, position, 'f1_score', f1_score FROM model_metrics"""


@query("model_comparison", f"""
WITH u AS ({SCORES_SQL}) SELECT metric, max(value) AS best, min(value) AS worst, round(avg(value), 6) AS average,
  round(stddev_pop(value), 6) AS std_dev FROM u GROUP BY metric""")
def model_comparison(t):
    return rounded(agg.model_comparison(t.model_metrics), "average", "std_dev")


@query("model_counts", "SELECT count(*) AS total, count(*) FILTER (status = 'active') AS active FROM models")
def model_counts(t):
    return agg.model_counts(t.models)


@query("classification_metrics", """
WITH c AS (SELECT cls, count(*) FILTER (label = cls) AS support, count(*) FILTER (pred = cls) AS predicted,
    count(*) FILTER (label = cls AND pred = cls) AS tp
  FROM class_pairs JOIN (SELECT DISTINCT label AS cls FROM class_pairs UNION SELECT DISTINCT pred FROM class_pairs) k ON TRUE
  GROUP BY cls),
s AS (SELECT *, coalesce(tp / nullif(predicted, 0)::DOUBLE, 0) AS p, coalesce(tp / nullif(support, 0)::DOUBLE, 0) AS r FROM c)
SELECT round(sum(tp) / sum(support)::DOUBLE, 6) AS accuracy, round(sum(p * support) / sum(support), 6) AS precision,
  round(sum(r * support) / sum(support), 6) AS recall,
  round(sum(coalesce(2 * p * r / nullif(p + r, 0), 0) * support) / sum(support), 6) AS f1_score FROM s""")
def classification_metrics(t):
    got = agg.classification_metrics(t.class_pairs)
    return rounded(got, *got.columns)
