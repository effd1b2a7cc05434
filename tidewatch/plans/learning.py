"""Queries: features, scoring columns, forecasts, anomalies and training."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import scoring as sc
from tidewatch.operators import learning as ml, models as m
from tidewatch.plans.aggregates import ENSEMBLE, rounded
from tidewatch.plans.registry import query
from tidewatch.plans.store import AT
from tidewatch.sources.views import as_of

_FRACTION = {"cpu_usage": 100, "memory_usage": 100, "disk_usage": 100, "error_rate": 100}
_WIDE_COLUMNS = ",\n  ".join(
    f"coalesce(arg_max(value, ts) FILTER (name = '{n}'), 0) / {_FRACTION.get(n, 1)}::DOUBLE AS {n}" for n in sc.FEATURES
)
WIDE = f"SELECT system_id, {_WIDE_COLUMNS} FROM metrics GROUP BY system_id"
DAILY = f"SELECT system_id, date_trunc('day', ts) AS day, {_WIDE_COLUMNS} FROM metrics GROUP BY ALL"
LABEL = "(cpu_usage > 0.8::DOUBLE OR memory_usage > 0.9::DOUBLE OR error_rate > 0.1::DOUBLE OR response_time > 2000)::INT"
_ROUNDED_FEATURES = ", ".join(f"round({n}, 6) AS {n}" for n in sc.FEATURES)


@query("features_wide", f"WITH w AS ({WIDE}) SELECT system_id, {_ROUNDED_FEATURES} FROM w")
def features_wide(t):
    return rounded(ml.features_wide(t.metrics), *sc.FEATURES)


@query("failure_label", f"WITH d AS ({DAILY}) SELECT system_id, day, {LABEL} AS label FROM d")
def failure_label(t):
    return ml.failure_features(t.metrics).select("system_id", "day", "label")


@query("risk_level", """
SELECT request_id, model_name, CASE WHEN probability >= 0.8::DOUBLE THEN 'critical' WHEN probability >= 0.6::DOUBLE THEN 'high'
  WHEN probability >= 0.4::DOUBLE THEN 'medium' ELSE 'low' END AS risk_level FROM model_outputs""")
def risk_level(t):
    return t.model_outputs.select("request_id", "model_name", sc.risk_level(F.col("probability")).alias("risk_level"))


@query("failure_time", f"""
SELECT request_id, model_name, CASE WHEN probability >= 0.3::DOUBLE
  THEN {AT} + to_hours(greatest(1, trunc(24 * (1 - probability))::INT)) END AS failure_time FROM model_outputs""")
def failure_time(t):
    return t.model_outputs.select(
        "request_id", "model_name", sc.failure_time(F.col("probability"), as_of()).alias("failure_time")
    )


FACTORS = """concat_ws(',', CASE WHEN cpu_usage > 0.8::DOUBLE THEN 'cpu_usage:' || CASE WHEN cpu_usage > 0.9::DOUBLE THEN 'high' ELSE 'medium' END END,
  CASE WHEN memory_usage > 0.8::DOUBLE THEN 'memory_usage:' || CASE WHEN memory_usage > 0.9::DOUBLE THEN 'high' ELSE 'medium' END END,
  CASE WHEN disk_usage > 0.8::DOUBLE THEN 'disk_usage:' || CASE WHEN disk_usage > 0.9::DOUBLE THEN 'high' ELSE 'medium' END END,
  CASE WHEN error_rate > 0.05::DOUBLE THEN 'error_rate:high' END)"""


def _factor_text(column):
    return F.concat_ws(",", F.transform(column, lambda f: F.concat_ws(":", f["metric"], f["severity"])))


@query("contributing_factors", f"WITH d AS ({DAILY}) SELECT system_id, day, {FACTORS} AS factors FROM d")
def contributing_factors(t):
    df = ml.failure_features(t.metrics)
    return df.select("system_id", "day", _factor_text(sc.contributing_factors()).alias("factors"))


ADVICE = """CASE WHEN {p} > 0.7::DOUBLE THEN 'Immediate attention required - Scale up resources;Check system logs for errors;Consider enabling circuit breakers;Prepare rollback plan'
  WHEN {p} > 0.5::DOUBLE THEN 'Monitor system closely;Consider preventive scaling;Review recent deployments' ELSE 'System appears stable' END"""


@query("recommendations", f"""
SELECT request_id, model_name, {ADVICE.format(p='probability')} AS advice FROM model_outputs""")
def recommendations(t):
    return t.model_outputs.select(
        "request_id", "model_name", F.concat_ws(";", sc.recommendations(F.col("probability"))).alias("advice")
    )


@query("anomaly_severity", """
SELECT request_id, model_name, CASE WHEN probability - 1 < -0.5::DOUBLE THEN 'high' WHEN probability - 1 < -0.2::DOUBLE THEN 'medium'
  ELSE 'low' END AS severity FROM model_outputs""")
def anomaly_severity(t):
    score = F.col("probability") - 1
    return t.model_outputs.select("request_id", "model_name", sc.anomaly_severity(score).alias("severity"))


@query("risk_interpretation", """
SELECT request_id, model_name, CASE WHEN probability > 0.7::DOUBLE THEN 'High failure risk' WHEN probability > 0.4::DOUBLE
  THEN 'Moderate failure risk' ELSE 'Low failure risk' END AS interpretation FROM model_outputs""")
def risk_interpretation(t):
    return t.model_outputs.select(
        "request_id", "model_name", sc.risk_interpretation(F.col("probability")).alias("interpretation")
    )


@query("logit_probability", """
SELECT vec_id, round(1 / (1 + exp(-10 * values[1])), 6) AS probability,
  round(least(1, greatest(0.5, abs(10 * values[1]))), 6) AS confidence FROM series_arrays""")
def logit_probability(t):
    x = F.get("values", F.lit(0)) * 10
    got = t.series_arrays.select("vec_id", sc.logit_probability(x).alias("l")).select("vec_id", "l.*")
    return rounded(got, "probability", "confidence")


@query("binary_confidence", """
SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN round(1 - abs(values[1]), 6) WHEN 1 THEN round(abs(values[1]), 6) END AS probability,
  CASE vec_id % 3 WHEN 0 THEN round(greatest(abs(values[1]), 1 - abs(values[1])), 6) WHEN 1 THEN round(abs(values[1]), 6) ELSE 0.8::DOUBLE END AS confidence
FROM series_arrays""")
def binary_confidence(t):
    """Two classes, one class, and no probabilities."""
    p, i = F.abs(F.get("values", F.lit(0))), F.col("vec_id") % 3
    arrays = F.when(i == 0, F.array(p, 1 - p)).when(i == 1, F.array(p)).otherwise(F.array().cast("array<double>"))
    got = t.series_arrays.select("vec_id", sc.binary_confidence(arrays).alias("b")).select("vec_id", "b.*")
    return rounded(got, "probability", "confidence")


@query("confidence_filter", """
SELECT vec_id, count(*) FILTER (abs(v) >= 0.1::DOUBLE) AS kept, round(coalesce(sum(v) FILTER (abs(v) >= 0.1::DOUBLE), 0), 6) AS total,
  round(coalesce(sum(v - 1) FILTER (abs(v) >= 0.1::DOUBLE), 0), 6) AS total_lower
FROM (SELECT vec_id, unnest(values) AS v FROM series_arrays) q GROUP BY vec_id""")
def confidence_filter(t):
    df = t.series_arrays.select(
        "vec_id", F.col("values").alias("predictions"), F.transform("values", lambda v: F.abs(v)).alias("confidences"),
        F.transform("values", lambda v: v - 1).alias("lower"), F.transform("values", lambda v: v + 1).alias("upper"),
    )
    got = m.confidence_filter(df, 0.1)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    return rounded(
        got.select("vec_id", F.size("predictions").cast("long").alias("kept"), total("predictions").alias("total"),
                   total("lower").alias("total_lower")),
        "total", "total_lower",
    )


@query("timeseries_points", """
SELECT system_id, name, 0::BIGINT AS part, count(*)::INT AS n, min(ts) AS first_ts, max(ts) AS last_ts,
  round(arg_min(value, ts), 6) AS first_value FROM metrics GROUP BY system_id, name""")
def timeseries_points(t):
    first, last = F.element_at("points", 1), F.element_at("points", -1)
    got = ml.timeseries_points(t.metrics).select(
        "system_id", "name", "part", F.size("points").alias("n"), first["ts"].alias("first_ts"),
        last["ts"].alias("last_ts"), first["value"].alias("first_value"),
    )
    return rounded(got, "first_value")


@query("ds_y_frame", "SELECT system_id, name, ts AS ds, round(value, 6) AS y FROM metrics")
def ds_y_frame(t):
    return rounded(ml.ds_y_frame(t.metrics), "y")


@query("clean_series", """
WITH g AS (SELECT id, system_id, name, ts, CASE WHEN id % 7 <> 0 THEN value END AS value FROM metrics),
f AS (SELECT *, last_value(value IGNORE NULLS) OVER (PARTITION BY name ORDER BY ts, id) AS filled FROM g),
q AS (SELECT name, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM g GROUP BY name)
SELECT id, round(filled, 6) AS filled, round(CASE WHEN filled IS NOT NULL THEN
  least(greatest(filled, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)) END, 6) AS cleaned
FROM f JOIN q ON q.name = f.name""")
def clean_series(t):
    """Every seventh sample is missing."""
    gaps = t.metrics.withColumn("value", F.when(F.col("id") % 7 != 0, F.col("value")))
    return rounded(ml.clean_series(gaps, ["name"]), "filled", "cleaned").select("id", "filled", "cleaned")


@query("normalize_series", """
SELECT id, round(coalesce((value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0), 0), 6) AS zscore,
  round(coalesce((value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0), 0), 6) AS minmax
FROM metrics WINDOW w AS (PARTITION BY system_id, name)""")
def normalize_series(t):
    z = ml.normalize_series(t.metrics).withColumnRenamed("normalized", "zscore")
    got = ml.normalize_series(z, method="minmax").withColumnRenamed("normalized", "minmax")
    return rounded(got, "zscore", "minmax").select("id", "zscore", "minmax")


@query("engineer_features", f"""
WITH d AS (SELECT *, value - lag(value) OVER (PARTITION BY name ORDER BY ts, id) AS step,
    (epoch_us(ts) - epoch_us({AT})) / 3.6e9 AS x FROM metrics),
b AS (SELECT name, regr_slope(value, x) AS trend, stddev_pop(value) AS std, stddev_pop(step) AS volatility FROM d GROUP BY name),
h AS (SELECT name, max(mean) - min(mean) AS spread FROM (SELECT name, hour(ts) AS h, avg(value) AS mean FROM metrics GROUP BY 1, 2) q GROUP BY name)
SELECT b.name, round(trend, 6) AS trend, round(spread / std, 6) AS seasonality, round(volatility, 6) AS volatility
FROM b JOIN h ON h.name = b.name""")
def engineer_features(t):
    return rounded(ml.engineer_features(t.metrics, as_of()), "trend", "seasonality", "volatility")


@query("train_test_split", """
SELECT id, ('0x' || substr(md5(id::VARCHAR), 1, 4))::INT / 65536.0::DOUBLE < 0.2::DOUBLE AS is_test FROM metrics""")
def train_test_split(t):
    return ml.train_test_split(t.metrics.select("id"), "id")


@query("standardize", """
WITH d AS (SELECT id, value, id % 7 AS k, ('0x' || substr(md5(id::VARCHAR), 1, 4))::INT / 65536.0::DOUBLE < 0.2::DOUBLE AS is_test FROM metrics),
s AS (SELECT avg(value) AS mv, stddev_pop(value) AS sv, avg(k) AS mk, stddev_pop(k) AS sk FROM d WHERE NOT is_test)
SELECT id, is_test, round((value - mv) / sv, 6) AS value_scaled, round((k - mk) / sk, 6) AS k_scaled FROM d JOIN s ON TRUE""")
def standardize(t):
    df = ml.train_test_split(t.metrics.select("id", "value", (F.col("id") % 7).alias("k")), "id")
    got = ml.standardize(df, ["value", "k"], ~F.col("is_test"))
    return rounded(got, "value_scaled", "k_scaled").select("id", "is_test", "value_scaled", "k_scaled")


@query("anomaly_stat", """
WITH w AS (SELECT id, system_id, name, value, avg(value) OVER b AS expected, stddev_pop(value) OVER b AS std, count(*) OVER b AS n_before
  FROM metrics WINDOW b AS (PARTITION BY name ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)),
z AS (SELECT *, CASE WHEN std > 0 THEN (value - expected) / std END AS z FROM w)
SELECT id, n_before, round(expected + 3.7e-9, 6) AS expected_value, round(least(1, abs(z) / 6) + 3.7e-8, 5) AS score, coalesce(abs(z) > 2, FALSE) AS is_anomaly FROM z""")
def anomaly_stat(t):
    got = ml.anomaly_stat(t.metrics, 0.8, 24, ["name"])
    return got.select(
        "id", "n_before", F.round(F.col("expected_value") + 3.7e-9, 6).alias("expected_value"),
        F.round(F.col("score") + 3.7e-8, 5).alias("score"), "is_anomaly",
    )


_FIT = """SELECT {k}, regr_slope(value, x) AS slope, regr_intercept(value, x) AS intercept, regr_r2(value, x) AS r2, count(*) AS n
FROM (SELECT *, (epoch_us(ts) - epoch_us({at})) / 3.6e9 AS x FROM metrics) q GROUP BY {k}"""


@query("forecast_linear", f"""
WITH f AS ({_FIT.format(k='name', at=AT)}),
r AS (SELECT m.name, hour(m.ts) AS h, m.value - f.intercept - f.slope * ((epoch_us(m.ts) - epoch_us({AT})) / 3.6e9) AS e
  FROM metrics m JOIN f ON f.name = m.name),
s AS (SELECT name, stddev_pop(e) AS sigma FROM r GROUP BY name), h AS (SELECT name, h, avg(e) AS residual FROM r GROUP BY name, h),
p AS (SELECT f.name, i::INT AS i, {AT} + to_hours(i) AS ts, intercept + slope * i AS base FROM f, UNNEST(generate_series(1, 12)) u(i))
SELECT p.name, p.i, p.ts, round(base + coalesce(residual, 0), 5) AS predicted_value,
  round(base + coalesce(residual, 0) - 1.96 * sigma, 5) AS lower_bound, round(base + coalesce(residual, 0) + 1.96 * sigma, 5) AS upper_bound
FROM p JOIN s ON s.name = p.name LEFT JOIN h ON h.name = p.name AND h.h = hour(p.ts)""")
def forecast_linear(t):
    got = ml.forecast_linear(t.metrics, as_of())
    return got.withColumns({c: F.round(c, 5) for c in ("predicted_value", "lower_bound", "upper_bound")})


@query("capacity_eta", f"""
WITH f AS ({_FIT.format(k='name', at=AT)}) SELECT name, "limit", round(slope, 6) AS slope,
  round(CASE WHEN slope > 0 THEN ("limit" - intercept) / slope END, 2) AS eta_hours
FROM f JOIN (VALUES ('cpu_usage', 100.0::DOUBLE), ('memory_usage', 100), ('error_rate', 50), ('response_time', 5000), ('request_count', 1000)) l(metric, "limit")
ON l.metric = f.name""")
def capacity_eta(t):
    limits = {"cpu_usage": 100, "memory_usage": 100, "error_rate": 50, "response_time": 5000, "request_count": 1000}
    got = ml.capacity_eta(t.metrics, limits, as_of(), ["name"])
    return rounded(got, "slope").select("name", "limit", "slope", F.round("eta_hours", 2).alias("eta_hours"))


@query("trend_analysis", f"""
WITH f AS ({_FIT.format(k='system_id, name', at=AT)})
SELECT system_id, name, round(slope, 6) AS slope, round(intercept, 4) AS intercept, round(r2, 6) AS r2, n FROM f WHERE n > 2""")
def trend_analysis(t):
    got = ml.trend_analysis(t.metrics, as_of()).where("n > 2")
    return rounded(got, "slope", "r2").withColumn("intercept", F.round("intercept", 4))


@query("resource_optimization", """
WITH p AS (SELECT system_id, name, quantile_cont(value, 0.95) AS p95 FROM metrics WHERE name IN ('cpu_usage', 'memory_usage') GROUP BY ALL)
SELECT system_id, name, round(p95, 6) AS p95, CASE WHEN p95 < 30 THEN 'downsize' WHEN p95 > 80 THEN 'upsize' ELSE 'keep' END AS advice FROM p""")
def resource_optimization(t):
    return rounded(ml.resource_optimization(t.metrics, ["cpu_usage", "memory_usage"]), "p95")


_CORR = " UNION ALL ".join(
    f"SELECT '{n}' AS feature_name, coalesce(abs(corr({n}, label)), 0) AS importance FROM d"
    for n in ("cpu_usage", "memory_usage", "error_rate", "response_time", "request_count")
)


@query("feature_importance", f"""
WITH w AS ({DAILY}), d AS (SELECT *, {LABEL} AS label FROM w), c AS ({_CORR})
SELECT feature_name, round(importance, 6) AS importance, row_number() OVER (ORDER BY importance DESC, feature_name)::INT AS rank FROM c""")
def feature_importance(t):
    names = ["cpu_usage", "memory_usage", "error_rate", "response_time", "request_count"]
    return rounded(ml.feature_importance(ml.failure_features(t.metrics), names, "label"), "importance")


@query("retrain_due", f"""
SELECT model_id, coalesce(accuracy < 0.75::DOUBLE, FALSE) AS inaccurate,
  coalesce(epoch({AT}) - epoch(training_date) >= 86400, FALSE) AS old FROM models
WHERE accuracy < 0.75::DOUBLE OR epoch({AT}) - epoch(training_date) >= 86400""")
def retrain_due(t):
    return m.retrain_due(t.models, as_of()).select("model_id", "inaccurate", "old")


@query("score_batch", f"""
WITH o AS (SELECT * REPLACE (CASE WHEN model_name = 'isolation_forest' THEN CASE WHEN request_id % 10 = 0 THEN 1 ELSE 0 END
    ELSE probability END AS probability) FROM model_outputs),
e AS ({ENSEMBLE.replace("FROM model_outputs", "FROM o")}), w AS ({WIDE}), s AS (SELECT DISTINCT request_id, system_id FROM model_outputs)
SELECT e.request_id, s.system_id, round(e.probability, 6) AS probability, round(e.confidence, 6) AS confidence,
  CASE WHEN e.probability >= 0.8::DOUBLE THEN 'critical' WHEN e.probability >= 0.6::DOUBLE THEN 'high'
    WHEN e.probability >= 0.4::DOUBLE THEN 'medium' ELSE 'low' END AS risk_level,
  CASE WHEN e.probability >= 0.3::DOUBLE THEN {AT} + to_hours(greatest(1, trunc(24 * (1 - e.probability))::INT)) END AS predicted_failure_time,
  {FACTORS} AS factors, {ADVICE.format(p='e.probability')} AS advice
FROM e JOIN s ON s.request_id = e.request_id JOIN w ON w.system_id = s.system_id""")
def score_batch(t):
    raw = F.when(F.col("model_name") == "isolation_forest", F.when(F.col("request_id") % 10 == 0, -1.0).otherwise(1.0))
    outputs = t.model_outputs.withColumn("probability", F.coalesce(raw, "probability"))
    got = ml.score_batch(outputs, ml.features_wide(t.metrics), as_of())
    return rounded(got, "probability", "confidence").select(
        "request_id", "system_id", "probability", "confidence", "risk_level", "predicted_failure_time",
        _factor_text(F.col("contributing_factors")).alias("factors"), F.concat_ws(";", "recommendations").alias("advice"),
    )


@query("train_random_forest")
def train_random_forest(t):
    """Failure probability of each system and day from a forest fitted on the training share."""
    from pyspark.ml.functions import vector_to_array

    keyed = ml.failure_features(t.metrics).withColumn("row_id", F.concat_ws("/", "system_id", "day"))
    data = ml.train_test_split(keyed, "row_id")
    model = ml.train_random_forest(data.where(~F.col("is_test")))
    return model.transform(ml.assemble(data)).select(
        "system_id", "day", "is_test", "label", vector_to_array("probability")[1].alias("failure_probability")
    )


@query("isolation_score")
def isolation_score(t):
    """Systems and days scored by an isolation forest."""
    df = ml.failure_features(t.metrics).withColumn("row_id", F.concat_ws("/", "system_id", "day"))
    return ml.isolation_score(df.select("row_id", *ml.FEATURES), ml.FEATURES, "row_id").select("row_id", "score", "is_anomaly")


@query("retrain_all")
def retrain_all(t):
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier

    data = ml.failure_features(t.metrics).withColumn("row_id", F.concat_ws("/", "system_id", "day"))
    return ml.retrain_all(data, {
        "random_forest": RandomForestClassifier(numTrees=100, maxDepth=10, seed=42),
        "logistic": LogisticRegression(),
        "broken": RandomForestClassifier(labelCol="no_such_column"),
    }, "row_id")
