"""The derived views in SQL, for checking the Spark queries against DuckDB."""

VIEWS: dict[str, str] = {
    "metrics": """
SELECT event_id AS id, 'sys-' || user_id AS system_id,
  CASE event_type WHEN 'click' THEN 'cpu_usage' WHEN 'view' THEN 'memory_usage' WHEN 'error' THEN 'error_rate'
    WHEN 'purchase' THEN 'response_time' WHEN 'signup' THEN 'request_count' END AS name,
  (CASE event_type WHEN 'error' THEN value / 20 WHEN 'purchase' THEN value * 10
    WHEN 'signup' THEN floor(value) ELSE least(value, 100) END) + 0.0::DOUBLE AS value,
  CASE event_type WHEN 'purchase' THEN 'ms' WHEN 'signup' THEN 'count' ELSE 'percent' END AS unit,
  '{"k":"' || json_extract_string(props, '$.k') || '"}' AS labels, ts
FROM events""",
    "systems": """
SELECT 'sys-' || c_custkey AS id, c_name AS name, c_mktsegment AS type, 'unknown' AS status,
  TIMESTAMP '2023-01-01 00:00:00' + to_hours(c_custkey) AS created_at, c_nationkey AS nation_key,
  '{"cpu_usage":' || (60 + c_custkey % 40) || ',"memory_usage":' || (50 + c_custkey % 50) || '}' AS thresholds,
  c_custkey AS system_no
FROM customer""",
    "alerts": """
SELECT 'alert_' || o_orderkey AS id, 'sys-' || o_custkey AS system_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium'
    ELSE 'low' END AS severity,
  CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'P' THEN 'acknowledged' WHEN 'F' THEN 'resolved' END AS status,
  CASE o_orderkey % 3 WHEN 0 THEN 'cpu_usage' WHEN 1 THEN 'memory_usage' ELSE 'error_rate' END AS metric_name,
  o_totalprice AS metric_value, 'gt' AS operator, o_orderdate AS created_at,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_hours(o_orderkey % 72 + 1) END AS resolved_at,
  o_orderkey AS alert_no
FROM orders""",
    "rules": """
SELECT 'rule_' || c_custkey || '_' || r.n AS id, 'sys-' || c_custkey AS system_id, 'rule ' || r.m AS name,
  r.m AS metric_name, r.op AS operator, r.t AS threshold, r.s AS severity, r.e AS enabled,
  r.n * 600 AS duration_s, '{"k":"rule","team":"t' || (c_custkey % 3) || '"}' AS labels,
  CASE WHEN (c_custkey // 2) % 2 = 0 THEN 'email,slack' ELSE 'webhook,fax' END AS channels
FROM customer CROSS JOIN (VALUES (1, 'cpu_usage', 'gt', 90.0::DOUBLE, 'critical', TRUE),
  (2, 'memory_usage', 'gte', 85.0, 'high', TRUE), (3, 'error_rate', '>', 5.0, 'critical', TRUE),
  (4, 'response_time', 'gt', 2000.0, NULL, TRUE), (5, 'request_count', 'lt', 1.0, 'low', FALSE)) r(n, m, op, t, s, e)
WHERE c_custkey % 2 = 0""",
    "metric_batch": """
SELECT id, system_id, name, value + 1 AS value, unit, labels, ts, 0 AS seq FROM metrics WHERE id % 10 = 0
UNION ALL SELECT id, system_id, name, value + 2, unit, labels, ts, 1 FROM metrics WHERE id % 10 = 0
UNION ALL SELECT id, system_id, name, value, unit, labels, ts + INTERVAL 1 HOUR, 0 FROM metrics WHERE id % 10 = 1""",
    "predictions": """
SELECT event_type AS model_id, event_id AS seq, value / 500 AS actual,
  (event_id * 7919 % 1000) / 1000.0::DOUBLE AS predicted,
  0.5::DOUBLE + (event_id % 50) / 100.0::DOUBLE AS confidence
FROM events""",
    "model_outputs": """
SELECT event_id AS request_id, 'sys-' || user_id AS system_id, m.model_name,
  (event_id * (m.n * 31 + 7) % 1000) / 1000.0::DOUBLE AS probability,
  0.5::DOUBLE + (event_id * m.n % 50) / 100.0::DOUBLE AS confidence
FROM events CROSS JOIN (VALUES (1, 'lstm'), (2, 'transformer'), (3, 'random_forest'), (4, 'isolation_forest')) m(n, model_name)""",
    "requests": """
SELECT event_id AS request_id, 'sys-' || user_id AS system_id,
  ['failure_prediction', 'capacity_planning', 'performance_forecast', 'resource_optimization',
   'anomaly_detection', 'trend_analysis'][event_id % 6 + 1] AS prediction_type,
  (event_id % 200)::INT AS time_horizon, (event_id % 120) / 100.0::DOUBLE AS confidence_threshold,
  (event_id % 13) / 10.0::DOUBLE AS sensitivity, (event_id % 12)::INT AS priority,
  (event_id % 110)::INT AS batch_size, (event_id % 70) / 100.0::DOUBLE AS test_split,
  (event_id % 4)::INT AS n_metrics, ts AS generated_at, value / 10 AS latency_ms,
  CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status
FROM events""",
    "models": """
SELECT 'model-' || c_custkey AS model_id,
  ['lstm', 'transformer', 'random_forest', 'prophet', 'xgboost', 'svm', 'isolation_forest',
   'autoencoder'][c_custkey % 8 + 1] AS model_type,
  CASE WHEN c_custkey % 5 = 0 THEN 'inactive' ELSE 'active' END AS status,
  CASE WHEN c_custkey % 7 <> 0 THEN (c_custkey * 37 % 100) / 100.0::DOUBLE END AS accuracy,
  CASE WHEN c_custkey % 11 <> 0 THEN (c_custkey * 53 % 150) / 100.0::DOUBLE END AS mae,
  CASE WHEN c_custkey % 13 <> 0
    THEN TIMESTAMP '2024-01-31 00:00:00' - to_hours(c_custkey % 60 * 24 + c_custkey % 24) END AS training_date,
  CASE WHEN c_custkey % 17 = 0 THEN 'sys-' || (c_custkey // 17) END AS system_id,
  c_custkey AS model_no
FROM customer""",
    "model_metrics": """
SELECT 'model-' || c_custkey AS model_name, c_custkey AS position,
  (c_custkey * 37 % 101) / 100.0::DOUBLE AS accuracy, (c_custkey * 41 % 101) / 100.0::DOUBLE AS precision,
  (c_custkey * 43 % 101) / 100.0::DOUBLE AS recall, (c_custkey * 47 % 101) / 100.0::DOUBLE AS f1_score
FROM customer""",
    "class_pairs": "SELECT quality AS label, 1 - toxic AS pred FROM labels",
    "series_arrays": "SELECT vec_id, embedding::DOUBLE[] AS values, label FROM embeddings",
    "http_requests": """
SELECT event_id AS request_id, user_id::VARCHAR AS client,
  CASE WHEN event_id % 4 <> 0 THEN user_id::VARCHAR END AS user_id, '10.0.0.' || (user_id % 250) AS ip,
  CASE event_type WHEN 'click' THEN '/api/v1/predict' WHEN 'view' THEN '/api/v1/detect-anomalies'
    WHEN 'purchase' THEN '/api/v1/train' WHEN 'signup' THEN '/health' WHEN 'error' THEN '/other' END AS path,
  ['GET', 'POST', 'PUT'][event_id % 3 + 1] AS method,
  CASE WHEN event_type = 'error' THEN 500 WHEN event_id % 17 = 0 THEN 404 ELSE 200 END AS status,
  value / 1000 AS duration_s, ts
FROM events""",
    "messages": """
SELECT event_id AS message_id,
  ['metrics', 'logs', 'events', 'traces', 'alerts', 'bogus'][event_id % 6 + 1] AS topic,
  event_type AS processor, CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
  CASE WHEN event_id % 50 = 0 THEN '{bad' ELSE props END AS body, (event_id % 7)::INT AS attempts, ts
FROM events""",
    "logs": """
SELECT doc_id AS log_id, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS ts,
  ['DEBUG', 'INFO', 'WARNING', 'ERROR'][doc_id % 4 + 1] AS level, source AS service, text AS message,
  CASE WHEN doc_id % 3 <> 0 THEN 'req-' || doc_id END AS request_id,
  CASE WHEN doc_id % 6 = 1 THEN 'corr-' || doc_id END AS correlation_id, 'u' || (doc_id % 20) AS user_id,
  CASE WHEN doc_id % 9 = 0 THEN text ELSE '{"user":"u' || doc_id || '","password":"p' || doc_id ||
    '","api_key":"k' || doc_id || '","ctx":{"token":"t' || doc_id || '","n":' || (doc_id % 10) || '}}' END AS extra
FROM documents""",
    "spans": """
SELECT event_id // 5 AS trace_id, event_id AS span_id,
  CASE WHEN event_id % 5 <> 0 THEN event_id - 1 END AS parent_span_id, 'svc-' || (user_id % 10) AS service,
  value AS duration_ms, ts
FROM events""",
    "actions": """
SELECT event_id AS action_id,
  ['restart', 'scale', 'update_config', 'delete_volume'][event_id % 4 + 1] AS action_type,
  'sys-' || user_id AS system_id, ['production', 'staging', 'dev'][user_id % 3 + 1] AS environment,
  ['pending', 'running', 'succeeded', 'failed', 'rolled_back'][event_id % 5 + 1] AS status,
  value AS duration_s, ts AS requested_at
FROM events WHERE event_type IN ('purchase', 'error')""",
    "late_events": """
SELECT event_id, ts, user_id, event_type, value,
  event_id + CASE WHEN event_id % 20 = 0 THEN 120 ELSE 0 END AS arrival
FROM events""",
    # helpers used by several oracles
    "latest": """
SELECT system_id, name, value, unit, labels, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY system_id, name ORDER BY ts DESC, id DESC) AS rn FROM metrics) q
WHERE rn = 1""",
}
