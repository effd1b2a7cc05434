"""Queries: scans, sinks, merges and table maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.labels import decode_labels, encode_labels
from tidewatch.operators import store
from tidewatch.plans.registry import query
from tidewatch.sources import files, kafka
from tidewatch.sources.views import as_of

AT = "TIMESTAMP '2024-01-31 00:00:00'"


def r6(column):
    return F.round(column, 6)


@query("scan_metrics", """
SELECT id, system_id, name, round(value, 6) AS value, unit, json_extract_string(labels, '$.k') AS label_k, ts
FROM metrics""")
def scan_metrics(t):
    return store.scan_metrics(t.metrics).select(
        "id", "system_id", "name", r6("value").alias("value"), "unit",
        F.col("labels")["k"].alias("label_k"), "ts",
    )


@query("ingest_collect", """
SELECT system_id, name, round(value, 6) AS value, unit, labels, ts FROM metrics
UNION ALL SELECT system_id, 'copy_of_' || name, round(value, 6), unit, 'null', ts FROM metrics""")
def ingest_collect(t):
    """Two points per envelope; one names another system, one has no labels."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp")
    point = F.struct(
        "name", "value", "unit", decode_labels(F.col("labels")).alias("labels"), stamp
    )
    plain = F.struct(
        F.concat(F.lit("copy_of_"), "name").alias("name"), "value", "unit",
        F.lit(None).cast("map<string,string>").alias("labels"), stamp,
    )
    bodies = t.metrics.select(
        F.to_json(F.struct("system_id", F.array(point, plain).alias("metrics"))).alias("body")
    )
    return store.ingest_collect(bodies).withColumn("value", r6("value"))


@query("upsert_metrics", """
SELECT system_id, name, ts, labels, round(value, 6) AS value, unit FROM (
  SELECT *, row_number() OVER (PARTITION BY system_id, name, ts, labels ORDER BY seq DESC) AS rn FROM (
    SELECT system_id, name, ts, labels, value, unit, -1 AS seq FROM metrics
    UNION ALL SELECT system_id, name, ts, labels, value, unit, seq FROM metric_batch) u) q
WHERE rn = 1""")
def upsert_metrics(t):
    return store.upsert_metrics(t.metrics, t.metric_batch).withColumn("value", r6("value"))


@query("upsert_systems", f"""
SELECT id, CASE WHEN system_no % 3 = 0 THEN upper(name) ELSE name END AS name,
  CASE WHEN system_no % 3 = 0 THEN 'healthy' ELSE status END AS status, created_at
FROM systems
UNION ALL SELECT 'new-' || system_no, name, status, {AT} FROM systems WHERE system_no % 3 = 1""")
def upsert_systems(t):
    base = t.systems
    changed = base.where(F.col("system_no") % 3 == 0).select(
        "id", F.upper("name").alias("name"), F.lit("healthy").alias("status"),
        as_of().alias("created_at"),
    )
    added = base.where(F.col("system_no") % 3 == 1).select(
        F.concat(F.lit("new-"), "system_no").alias("id"), "name", "status",
        as_of().alias("created_at"),
    )
    return store.upsert_systems(
        base.select("id", "name", "status", "created_at"), changed.unionByName(added)
    )


@query("ingest_rejects", """
SELECT id, CASE id % 5 WHEN 1 THEN 'malformed body' WHEN 2 THEN 'no system_id' WHEN 3 THEN 'no metrics' ELSE 'no body' END AS reason
FROM metrics WHERE id % 5 <> 0""")
def ingest_rejects(t):
    """Why envelopes are refused: cut off, without a system, without points, or empty."""
    no = F.col("id") % 5
    points = F.array(F.struct("name", "value"))
    whole = F.to_json(F.struct("system_id", points.alias("metrics")))
    body = (
        F.when(no == 0, whole).when(no == 1, F.expr("left(whole, length(whole) - 3)"))
        .when(no == 2, F.to_json(F.struct(points.alias("metrics")))).when(no == 3, F.to_json(F.struct("system_id")))
        .otherwise("")
    )
    bodies = t.metrics.withColumn("whole", whole).select("id", body.alias("body"))
    return store.rejected_envelopes(bodies).select("id", "reason")


@query("update_system_partial", f"""
SELECT id, CASE WHEN system_no % 4 = 1 THEN 'renamed-' || system_no ELSE name END AS name,
  CASE WHEN system_no % 4 = 1 THEN 'now ' || type ELSE type END AS description,
  CASE WHEN system_no % 4 = 0 THEN 'patched' ELSE status END AS tag,
  CASE WHEN system_no % 4 = 0 THEN '{{"cpu_usage":50}}' ELSE thresholds END AS thresholds,
  CASE WHEN system_no % 4 < 2 THEN {AT} END AS updated_at
FROM systems""")
def update_system_partial(t):
    no = F.col("system_no")
    patches = t.systems.where(no % 4 < 2).select(
        "id",
        F.when(no % 4 == 1, F.concat(F.lit("renamed-"), no)).otherwise("").alias("name"),
        F.when(no % 4 == 1, F.concat(F.lit("now "), "type")).otherwise("").alias("description"),
        F.when(no % 4 == 0, F.array(F.lit("patched"))).alias("tags"),
        F.when(no % 4 == 0, '{"cpu_usage":50}').alias("thresholds"),
    )
    stored = t.systems.select("id", "name", F.col("type").alias("description"), F.array("status").alias("tags"), "thresholds")
    got = store.update_system_partial(stored, patches, as_of())
    return got.select("id", "name", "description", F.array_join("tags", ",").alias("tag"), "thresholds", "updated_at")


@query("upsert_alerts", f"""
SELECT id, system_id, CASE WHEN alert_no % 4 = 0 THEN 'acknowledged' ELSE status END AS status,
  CASE WHEN alert_no % 4 = 0 THEN {AT} ELSE created_at END AS updated_at,
  CASE WHEN alert_no % 4 <> 0 THEN resolved_at END AS resolved_at FROM alerts
UNION ALL SELECT 'new_' || id, system_id, 'active', {AT}, NULL FROM alerts WHERE alert_no % 4 = 1""")
def upsert_alerts(t):
    no = F.col("alert_no")
    stored = t.alerts.select("id", "system_id", "status", F.col("created_at").alias("updated_at"), "resolved_at")
    changed = t.alerts.where(no % 4 == 0).select(
        "id", F.lit("ignored").alias("system_id"), F.lit("acknowledged").alias("status"),
        as_of().alias("updated_at"),
    )
    added = t.alerts.where(no % 4 == 1).select(
        F.concat(F.lit("new_"), "id").alias("id"), "system_id", F.lit("active").alias("status"),
        as_of().alias("updated_at"),
    )
    return store.upsert_alerts(stored, changed.unionByName(added))


@query("update_alert", f"""
SELECT id, CASE alert_no % 5 WHEN 0 THEN 'resolved' WHEN 1 THEN 'acknowledged' ELSE status END AS status,
  CASE WHEN alert_no % 5 = 2 THEN 'note ' || alert_no ELSE 'about ' || metric_name END AS description,
  CASE WHEN alert_no % 5 = 0 THEN {AT} ELSE resolved_at END AS resolved_at,
  CASE WHEN alert_no % 5 < 3 THEN {AT} ELSE created_at END AS updated_at
FROM alerts""")
def update_alert(t):
    no = F.col("alert_no")
    patches = t.alerts.where(no % 5 < 3).select(
        "id",
        F.when(no % 5 == 0, "resolved").when(no % 5 == 1, "acknowledged").otherwise("").alias("status"),
        F.when(no % 5 == 2, F.concat(F.lit("note "), no)).otherwise("").alias("description"),
    )
    stored = t.alerts.select(
        "id", "status", F.concat(F.lit("about "), "metric_name").alias("description"),
        "resolved_at", F.col("created_at").alias("updated_at"),
    )
    return store.update_alert(stored, patches, as_of())


@query("acknowledge_alerts", f"""
SELECT id, CASE WHEN status = 'active' THEN 'acknowledged' ELSE status END AS status,
  CASE WHEN status = 'active' THEN {AT} END AS updated_at,
  CASE WHEN status <> 'active' THEN 'alert is not in active state' END AS error FROM alerts
UNION ALL SELECT 'missing_' || s.id, NULL, NULL, 'alert not found' FROM systems s""")
def acknowledge_alerts(t):
    missing = t.systems.select(F.concat(F.lit("missing_"), "id").alias("id"))
    return store.acknowledge_alerts(t.alerts, t.alerts.select("id").union(missing), as_of())


@query("delete_system_cascade", """
SELECT 'systems' AS table_name, id AS key, count(*) AS n FROM systems WHERE type <> 'FURNITURE' GROUP BY id
UNION ALL SELECT 'metrics', m.system_id, count(*) FROM metrics m
  WHERE m.system_id NOT IN (SELECT id FROM systems WHERE type = 'FURNITURE') GROUP BY m.system_id
UNION ALL SELECT 'alerts', a.system_id, count(*) FROM alerts a
  WHERE a.system_id NOT IN (SELECT id FROM systems WHERE type = 'FURNITURE') GROUP BY a.system_id
UNION ALL SELECT 'rules', r.system_id, count(*) FROM rules r
  WHERE r.system_id NOT IN (SELECT id FROM systems WHERE type = 'FURNITURE') GROUP BY r.system_id""")
def delete_system_cascade(t):
    """Remove every system of one type; rows left per table and system."""
    tables = {"systems": t.systems, "metrics": t.metrics, "alerts": t.alerts, "rules": t.rules}
    left = store.delete_system_cascade(tables, t.systems.where(F.col("type") == "FURNITURE"))
    out = None
    for name, df in left.items():
        key = "id" if name == "systems" else "system_id"
        part = df.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("table_name"), "key", "n"
        )
        out = part if out is None else out.unionByName(part)
    return out


@query("delete_alert", "SELECT id, status FROM alerts WHERE severity <> 'low'")
def delete_alert(t):
    return store.delete_alert(t.alerts, t.alerts.where("severity = 'low'")).select("id", "status")


@query("upsert_rules", f"""
SELECT id, threshold + CASE WHEN metric_name = 'cpu_usage' THEN 1 ELSE 0 END AS threshold,
  TIMESTAMP '2023-06-01 00:00:00' AS created_at,
  CASE WHEN metric_name IN ('cpu_usage', 'error_rate') THEN {AT} ELSE TIMESTAMP '2023-06-01 00:00:00' END AS updated_at
FROM rules WHERE enabled AND metric_name <> 'error_rate'
UNION ALL SELECT 'new_' || id, threshold, {AT}, {AT} FROM rules WHERE metric_name = 'memory_usage'""")
def upsert_rules(t):
    """cpu rules change, error-rate rules are switched off, memory rules are added."""
    born = F.lit("2023-06-01 00:00:00").cast("timestamp_ntz")
    none = F.lit(None).cast("timestamp_ntz")
    base = t.rules.select("id", "metric_name", "threshold", "enabled", born.alias("created_at"), born.alias("updated_at"))
    update = base.where(F.col("metric_name").isin("cpu_usage", "error_rate")).select(
        "id", "metric_name",
        F.when(F.col("metric_name") == "cpu_usage", F.col("threshold") + 1).otherwise(F.col("threshold")).alias("threshold"),
        (F.col("metric_name") != "error_rate").alias("enabled"), none.alias("created_at"),
    )
    added = base.where(F.col("metric_name") == "memory_usage").select(
        F.concat(F.lit("new_"), "id").alias("id"), "metric_name", "threshold",
        F.lit(True).alias("enabled"), none.alias("created_at"),
    )
    merged = store.upsert_rules(base, update.unionByName(added), as_of())
    return store.active_rules(merged).select("id", "threshold", "created_at", "updated_at")


def _sources(t):
    hosts = t.raw("supplier").select(
        F.concat(F.lit("host-"), "s_suppkey").alias("system_id"), F.lit("disk_usage").alias("name"),
        (F.abs("s_acctbal") % F.lit(100.0)).alias("value"), F.lit("percent").alias("unit"), as_of().alias("ts"),
    )
    containers = t.raw("part").select(
        F.concat(F.lit("container-"), "p_partkey").alias("system_id"), F.lit("container_cpu_usage").alias("name"),
        (F.col("p_partkey") % 100).cast("double").alias("value"), F.lit("percent").alias("unit"), as_of().alias("ts"),
    )
    return {"prometheus": t.metrics, "system": hosts, "docker": containers}


_COLLECT_SQL = f"""
SELECT 'prometheus' AS source, system_id, name, round(value, 6) AS value, unit, ts FROM metrics
UNION ALL SELECT 'system', 'host-' || s_suppkey, 'disk_usage', round(abs(s_acctbal) % 100.0::DOUBLE, 6), 'percent', {AT} FROM supplier
UNION ALL SELECT 'docker', 'container-' || p_partkey, 'container_cpu_usage', (p_partkey % 100)::DOUBLE, 'percent', {AT} FROM part"""


@query("collect_union", _COLLECT_SQL)
def collect_union(t):
    return store.collect_union(_sources(t)).withColumn("value", r6("value"))


@query("union_all", f"""
WITH u AS ({_COLLECT_SQL})
SELECT source, name, count(*) AS n, count(DISTINCT system_id) AS n_systems FROM u GROUP BY source, name""")
def union_all(t):
    """Bag union of all collectors, counted; duplicates are kept."""
    return store.collect_union(_sources(t)).groupBy("source", "name").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("system_id").alias("n_systems")
    )


@query("collector_status", """
SELECT topic AS source, sum(CASE WHEN body <> '{bad' THEN 1 ELSE 0 END)::BIGINT AS metrics_count,
  count(*) FILTER (body = '{bad') AS error_count, max(ts) AS last_collection,
  arg_max('bad body in ' || message_id, ts) FILTER (body = '{bad') AS last_error
FROM messages GROUP BY topic""")
def collector_status(t):
    bad = F.col("body") == "{bad"
    runs = t.messages.select(
        F.col("topic").alias("source"), "ts", F.when(bad, 0).otherwise(1).alias("points"),
        F.when(bad, F.concat(F.lit("bad body in "), "message_id")).alias("error"),
    )
    return store.collector_status(runs)


@query("prom_response_rows", """
SELECT id, system_id, name, round(value, 6) AS value FROM metrics WHERE id % 7 <> 0 AND id % 11 <> 0 AND id % 13 <> 0""")
def prom_response_rows(t):
    """Bodies with failures, empty results and values that are not numbers."""
    i = F.col("id")
    sample = F.when(i % 13 == 0, "n/a").otherwise(F.col("value").cast("string"))
    result = F.when(i % 11 == 0, "[]").otherwise(
        F.concat(F.lit('[{"metric":{"name":"'), "name", F.lit('"},"value":[1706659200,"'), sample, F.lit('"]}]'))
    )
    bodies = t.metrics.select(
        "id", "system_id", "name",
        F.concat(
            F.lit('{"status":"'), F.when(i % 7 == 0, "error").otherwise("success"),
            F.lit('","data":{"result":'), result, F.lit("}}"),
        ).alias("body"),
    )
    return store.prom_response_rows(bodies).withColumn("value", r6("value"))


@query("prom_result_convert", """
SELECT system_id, name, 0::BIGINT AS part, count(*)::INT AS n, min(ts) AS first_time, max(ts) AS last_time,
  round(arg_min(value, ts), 6) AS first_value, round(arg_max(value, ts), 6) AS last_value
FROM metrics GROUP BY system_id, name""")
def prom_result_convert(t):
    """Samples to one ordered matrix row per series."""
    matrix = store.prom_matrix(t.metrics, ["system_id", "name"])
    first, last = F.element_at("values", 1), F.element_at("values", -1)
    return matrix.select(
        "system_id", "name", "part", F.size("values").alias("n"),
        first["time"].alias("first_time"), last["time"].alias("last_time"),
        r6(first["value"]).alias("first_value"), r6(last["value"]).alias("last_value"),
    )


@query("labels_codec", """
SELECT id, '{"name":"' || name || '","type":"' || type || '"}' AS labels, type AS decoded_type, 'null' AS empty
FROM systems""")
def labels_codec(t):
    """Decode labels whose keys are out of order and encode them canonically."""
    raw = F.concat(F.lit('{"type":"'), "type", F.lit('","name":"'), "name", F.lit('"}'))
    return t.systems.select("id", decode_labels(raw).alias("m")).select(
        "id", encode_labels(F.col("m")).alias("labels"), F.col("m")["type"].alias("decoded_type"),
        encode_labels(F.lit(None).cast("map<string,string>")).alias("empty"),
    )


@query("topic_route", """
SELECT message_id, topic, CASE WHEN topic = 'bogus' OR body = '{bad' THEN 'dead-letter' ELSE topic END AS route
FROM messages""")
def topic_route(t):
    return store.topic_route(t.messages).select("message_id", "topic", "route")


@query("dead_letter", """
SELECT message_id, topic, body, CASE WHEN body = '{bad' THEN 'malformed body' ELSE 'unknown topic' END AS reason
FROM messages WHERE body = '{bad' OR topic = 'bogus'""")
def dead_letter(t):
    return store.dead_letter(t.messages).select("message_id", "topic", "body", "reason")


@query("ingest_batch_validate", """
SELECT message_id, body <> '{bad' AND topic <> 'bogus' AS accepted, TRY_CAST(json_extract_string(
  CASE WHEN body = '{bad' THEN '{}' ELSE body END, '$.k') AS BIGINT) AS k,
  CASE WHEN body = '{bad' THEN 'malformed body' WHEN topic = 'bogus' THEN 'unknown topic' END AS reason
FROM messages""")
def ingest_batch_validate(t):
    parsed = store.parse_records(t.messages, "k long")
    reason = F.coalesce(
        F.col("reason"), F.when(~F.col("topic").isin(*store.PROCESSED_TOPICS), "unknown topic")
    )
    return parsed.select(
        "message_id", reason.isNull().alias("accepted"), F.col("record.k").alias("k"), reason.alias("reason")
    )


@query("source_kafka", """
SELECT topic, ts, message_id, processor, status FROM messages""")
def source_kafka(t):
    """Decode records that have the columns of the Kafka source."""
    records = t.messages.select(
        F.col("message_id").cast("string").cast("binary").alias("key"),
        F.to_json(F.struct("message_id", "processor", "status")).cast("binary").alias("value"),
        "topic", F.col("ts").alias("timestamp"),
    )
    return kafka.decode(records, "message_id long, processor string, status string")


@query("sink_kafka", """
SELECT topic, message_id::VARCHAR AS key,
  '{"message_id":' || message_id || ',"processor":"' || processor || '","status":"' || status || '"}' AS value
FROM messages""")
def sink_kafka(t):
    return kafka.encode(t.messages.select("message_id", "topic", "processor", "status"), "message_id", "topic")


@query("sink_files", """
SELECT ts::DATE AS date, name, count(*) AS n, round(sum(value), 4) AS total FROM metrics GROUP BY 1, 2""")
def sink_files(t):
    """Write by date and name, read back."""
    path = files.shared_folder(t.spark, "metrics")
    last_day = F.col("ts") >= F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")
    files.write_metrics(t.metrics.where(~last_day), path, batch="month")
    for _ in range(2):  # a batch delivered again replaces itself
        files.write_metrics(t.metrics.where(last_day), path, batch="last-day")
    return files.read_metrics(t.spark, path).groupBy("date", "name").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")
    )


@query("retention_prune", f"""
SELECT id, system_id, name, ts FROM metrics WHERE ts >= {AT} - INTERVAL 15 DAY""")
def retention_prune(t):
    return store.retention_prune(t.metrics, as_of(), 15).select("id", "system_id", "name", "ts")


@query("downsample", f"""
SELECT '1 hour' AS resolution, 'avg' AS aggregator, system_id, name, time_bucket(INTERVAL 1 HOUR, ts) AS window_start,
  round(avg(value), 6) AS value FROM metrics WHERE ts >= {AT} - INTERVAL 7 DAY GROUP BY ALL
UNION ALL SELECT '6 hours', 'max', system_id, name, time_bucket(INTERVAL 6 HOUR, ts), round(max(value), 6)
  FROM metrics WHERE ts >= {AT} - INTERVAL 15 DAY GROUP BY ALL
UNION ALL SELECT '1 day', 'last', system_id, name, time_bucket(INTERVAL 1 DAY, ts), round(arg_max(value, ts), 6)
  FROM metrics WHERE ts >= {AT} - INTERVAL 30 DAY GROUP BY ALL""")
def downsample(t):
    rules = [("1 hour", 7, "avg"), ("6 hours", 15, "max"), ("1 day", 30, "last")]
    return store.downsample(t.metrics, rules, as_of()).withColumn("value", r6("value"))
