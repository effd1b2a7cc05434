"""Queries: rolling windows, rankings, selection, forecasts and rate limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import models as m, remediation, sequential
from tidewatch.plans.aggregates import SCORES_SQL, rounded
from tidewatch.plans.registry import query
from tidewatch.plans.store import AT
from tidewatch.sources.views import as_of


@query("rolling_model_performance", """
SELECT model_id, seq, round(avg(abs(actual - predicted)) OVER w + 3.7e-9, 6) AS mae,
  round(avg(confidence) OVER w + 3.7e-9, 6) AS avg_confidence,
  count(*) OVER w AS n, round(1 - avg(abs(actual - predicted)) OVER w + 3.7e-9, 6) AS accuracy
FROM predictions WINDOW w AS (PARTITION BY model_id ORDER BY seq ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)""")
def rolling_model_performance(t):
    """Means of short windows fall on rounding ties, so both sides are nudged off them."""
    got = m.rolling_model_performance(t.predictions)
    return got.withColumns({c: F.round(F.col(c) + 3.7e-9, 6) for c in ("mae", "avg_confidence", "accuracy")})


@query("sequence_windows", """
SELECT name, rn - 59 AS window_no, window_start, window_end, round(first_value, 6) AS first_value, round(last_value, 6) AS last_value, round(total, 4) AS total
FROM (SELECT name, ts AS window_end, row_number() OVER (PARTITION BY name ORDER BY ts, id) AS rn, count(*) OVER w AS n,
    first(ts) OVER w AS window_start, first(value) OVER w AS first_value, value AS last_value, sum(value) OVER w AS total
  FROM metrics WINDOW w AS (PARTITION BY name ORDER BY ts, id ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) q WHERE n = 60""")
def sequence_windows(t):
    got = m.sequence_windows(t.metrics, ["name"], 60)
    total = F.aggregate("values", F.lit(0.0), lambda acc, v: acc + v)
    return rounded(
        got.select(
            "name", "window_no", "window_start", "window_end", F.get("values", F.lit(0)).alias("first_value"),
            F.get("values", F.lit(59)).alias("last_value"), F.round(total, 4).alias("total"),
        ),
        "first_value", "last_value",
    )


@query("forecast_rows", f"""
SELECT vec_id, (i - 1)::INT AS i, round(values[i], 6) AS predicted_value,
  round(CASE WHEN i <= 40 THEN abs(values[i]) ELSE 0.8 END, 6) AS confidence, {AT} + to_hours(i) AS ts,
  round(CASE WHEN i <= 20 THEN values[i] - 1 END, 6) AS lower_bound, round(CASE WHEN i <= 20 THEN values[i] + 1 END, 6) AS upper_bound
FROM (SELECT vec_id, values, unnest(generate_series(1, least(len(values), 48))) AS i FROM series_arrays) q""")
def forecast_rows(t):
    """Confidences cover 40 and bounds 20 of the predictions; the horizon is 48 hours."""
    one = F.lit(1)
    df = t.series_arrays.select(
        "vec_id", F.col("values").alias("predictions"),
        F.transform(F.slice("values", one, F.lit(40)), lambda v: F.abs(v)).alias("confidences"),
        F.transform(F.slice("values", one, F.lit(20)), lambda v: v - 1).alias("lower"),
        F.transform(F.slice("values", one, F.lit(20)), lambda v: v + 1).alias("upper"),
    )
    return rounded(
        m.forecast_rows(df, as_of(), 48, ["vec_id"]), "predicted_value", "confidence", "lower_bound", "upper_bound"
    )


@query("model_rankings", f"""
WITH u AS ({SCORES_SQL}) SELECT model_name, position, metric, value,
  row_number() OVER (PARTITION BY metric ORDER BY value DESC, position) AS rank FROM u""")
def model_rankings(t):
    return m.model_rankings(t.model_metrics)


SCORED = f"""
SELECT *, least(1.0::DOUBLE, coalesce(accuracy, 0) * 0.4::DOUBLE + coalesce(greatest(0, 1 - mae), 0) * 0.3::DOUBLE
  + CASE WHEN training_date IS NULL THEN 0 ELSE greatest(0, 1 - (date_diff('second', training_date, {AT}) // 86400) / 30.0::DOUBLE) END * 0.2::DOUBLE
  + 0.5::DOUBLE * 0.1::DOUBLE) AS score FROM models"""


@query("model_score", f"""
WITH s AS ({SCORED}) SELECT model_id, round(score, 6) AS score FROM s""")
def model_score(t):
    return rounded(t.models.withColumn("score", m.model_score(as_of())), "score").select("model_id", "score")


@query("select_optimal_model", f"""
WITH s AS ({SCORED}), cand(prediction_type, model_type, pos) AS (VALUES
  {", ".join(f"('{k}', '{n}', {i})" for k, names in m.CANDIDATES.items() for i, n in enumerate(names))}),
best AS (SELECT prediction_type, model_id FROM (
  SELECT c.prediction_type, s.model_id, row_number() OVER (PARTITION BY c.prediction_type ORDER BY round(score, 9) DESC, pos, model_no) AS rn
  FROM s JOIN cand c ON c.model_type = s.model_type WHERE s.status = 'active' AND s.system_id IS NULL AND score > 0) q WHERE rn = 1),
own AS (SELECT system_id, arg_min(model_id, model_no) AS model_id FROM models WHERE status = 'active' AND system_id IS NOT NULL GROUP BY system_id)
SELECT r.request_id, r.prediction_type, coalesce(o.model_id, b.model_id) AS model_id, o.model_id IS NOT NULL AS system_specific
FROM requests r LEFT JOIN own o ON o.system_id = r.system_id LEFT JOIN best b ON b.prediction_type = r.prediction_type""")
def select_optimal_model(t):
    requests = t.requests.select("request_id", "system_id", "prediction_type")
    return m.select_optimal_model(requests, t.models, as_of()).select(
        "request_id", "prediction_type", "model_id", "system_specific"
    )


# the log is replayed a hundred thousand times faster, so that limits are reached
_REPLAY = """
SELECT request_id, client, path, make_timestamp(epoch_us(TIMESTAMP '2024-01-01 00:00:00')
  + (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) // 100000) AS ts,
  CASE path WHEN '/api/v1/predict' THEN 50 WHEN '/api/v1/detect-anomalies' THEN 30 WHEN '/api/v1/train' THEN 5 ELSE 100 END AS rate_limit
FROM http_requests"""


def _replayed(t):
    start = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").cast("timestamp"))
    offset = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - start) / F.lit(100_000)).cast("long")
    path = F.col("path")
    limit = (
        F.when(path == "/api/v1/predict", 50).when(path == "/api/v1/detect-anomalies", 30)
        .when(path == "/api/v1/train", 5).otherwise(100)
    )
    return t.http_requests.select(
        "request_id", "client", "path", F.timestamp_micros(start + offset).cast("timestamp_ntz").alias("ts"),
        limit.alias("rate_limit"),
    )


@query("rate_limit_sliding", f"""
WITH RECURSIVE r AS ({_REPLAY}), o AS (SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY client, path ORDER BY ts, request_id) AS rn FROM r),
w AS (SELECT request_id, client, path, rn, TRUE AS accepted, [us] AS log FROM o WHERE rn = 1
  UNION ALL SELECT o.request_id, o.client, o.path, o.rn, len(list_filter(w.log, lambda x: x > o.us - 60000000)) < o.rate_limit,
    CASE WHEN len(list_filter(w.log, lambda x: x > o.us - 60000000)) < o.rate_limit
      THEN list_append(list_filter(w.log, lambda x: x > o.us - 60000000), o.us)
      ELSE list_filter(w.log, lambda x: x > o.us - 60000000) END
  FROM w JOIN o ON o.client = w.client AND o.path = w.path AND o.rn = w.rn + 1)
SELECT request_id, client, path, accepted FROM w""")
def rate_limit_sliding(t):
    return sequential.rate_limit_sliding(_replayed(t)).select("request_id", "client", "path", "accepted")


@query("rate_limit_bucket", f"""
WITH RECURSIVE r AS ({_REPLAY}), o AS (SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY client ORDER BY ts, request_id) AS rn FROM r),
w AS (SELECT request_id, client, rn, us, TRUE AS accepted, 540000000::BIGINT AS tokens FROM o WHERE rn = 1
  UNION ALL SELECT o.request_id, o.client, o.rn, o.us, least(600000000::BIGINT, w.tokens + (o.us - w.us) * 60) >= 60000000,
    least(600000000::BIGINT, w.tokens + (o.us - w.us) * 60)
      - CASE WHEN least(600000000::BIGINT, w.tokens + (o.us - w.us) * 60) >= 60000000 THEN 60000000 ELSE 0 END
  FROM w JOIN o ON o.client = w.client AND o.rn = w.rn + 1)
SELECT request_id, client, accepted FROM w""")
def rate_limit_bucket(t):
    """Sixty a minute with bursts of ten."""
    got = sequential.rate_limit_bucket(_replayed(t).drop("rate_limit", "path"), 60, 10)
    return got.select("request_id", "client", "accepted")


@query("safety_hourly_cap", """
SELECT action_id, n AS last_hour, n > 8 AS over_cap FROM (
  SELECT action_id, count(*) OVER (ORDER BY requested_at RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n FROM actions) q""")
def safety_hourly_cap(t):
    return remediation.safety_hourly_cap(t.actions, 8).select("action_id", "last_hour", "over_cap")
