"""Queries: event-time windows, late data, sampling, and streaming jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.labels import decode_labels
from tidewatch.functions.times import to_wall
from tidewatch.operators import events as ev, selection, traces
from tidewatch.plans.aggregates import rounded
from tidewatch.plans.registry import query
from tidewatch.plans.store import r6
from tidewatch.schemas import RAW
from tidewatch.sources.files import shared_folder
from tidewatch.sources.views import Tables, as_of
from tidewatch.streaming import jobs

_STATS = "count(*) AS n, round(sum(value), 4) AS total, round(avg(value) + 3.7e-9, 6) AS mean, round(min(value), 6) AS low, round(max(value), 6) AS high"


def _stats(df):
    """Means of few values fall on rounding ties, so both sides are nudged off them."""
    return rounded(df, "low", "high").withColumns(
        {"total": F.round("total", 4), "mean": F.round(F.col("mean") + 3.7e-9, 6)}
    )


@query("tumbling_metrics", f"""
SELECT system_id, name, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end,
  {_STATS} FROM metrics GROUP BY 1, 2, 3, 4""")
def tumbling_metrics(t):
    return _stats(ev.tumbling(t.metrics, ["system_id", "name"], "1 hour"))


@query("sliding_metrics", f"""
SELECT name, w AS window_start, w + INTERVAL 1 HOUR AS window_end, {_STATS} FROM (
  SELECT *, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL (k * 15) MINUTE AS w FROM metrics JOIN (VALUES (0), (1), (2), (3)) s(k) ON TRUE) q
GROUP BY 1, 2, 3""")
def sliding_metrics(t):
    return _stats(ev.sliding(t.metrics, ["name"], "1 hour", "15 minutes"))


@query("session_events", """
WITH l AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 6 HOUR THEN 1 ELSE 0 END)
  OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM l)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n, round(sum(value), 4) AS total
FROM s GROUP BY user_id, session""")
def session_events(t):
    return ev.sessions(t.events, "user_id", 6 * 3600).withColumn("total", F.round("total", 4))


@query("late_side_output", """
SELECT event_id, coalesce(max(ts) OVER (ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - ts
  > INTERVAL 5 HOUR, FALSE) AS is_late FROM late_events""")
def late_side_output(t):
    return ev.late_side_output(t.late_events, "arrival", 5 * 3600).select("event_id", "is_late")


@query("event_dedup_ttl", """
WITH RECURSIVE o AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us,
  row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events),
w AS (SELECT event_id, user_id, event_type, rn, us AS last, TRUE AS kept FROM o WHERE rn = 1
  UNION ALL SELECT o.event_id, o.user_id, o.event_type, o.rn, CASE WHEN o.us - w.last >= 86400000000 THEN o.us ELSE w.last END,
    o.us - w.last >= 86400000000 FROM w JOIN o ON o.user_id = w.user_id AND o.event_type = w.event_type AND o.rn = w.rn + 1)
SELECT event_id, user_id, event_type FROM w WHERE kept""")
def event_dedup_ttl(t):
    """A day between kept events of a user and type."""
    df = t.events.select("event_id", "user_id", "event_type", "ts")
    return ev.dedup_ttl(df, ["user_id", "event_type"], 86400).drop("ts")


@query("event_first_per_key", """
SELECT user_id, event_type, min(ts) AS ts, arg_min(event_id, ts) AS event_id FROM events GROUP BY user_id, event_type""")
def event_first_per_key(t):
    df = t.events.select("event_id", "user_id", "event_type", "ts")
    return ev.first_per_key(df, ["user_id", "event_type"])


@query("event_order", """
SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position FROM late_events""")
def event_order(t):
    return ev.event_order(t.late_events, "user_id").select("event_id", "user_id", "position")


_HASH = "('0x' || substr(md5({x}), 1, 4))::INT / 65536.0::DOUBLE"


@query("metric_sample", f"""
SELECT id, system_id, name FROM metrics WHERE {_HASH.format(x="system_id || '/' || name")} < 0.25::DOUBLE""")
def metric_sample(t):
    return ev.metric_sample(t.metrics, 0.25).select("id", "system_id", "name")


@query("trace_sample", f"""
SELECT trace_id, span_id FROM spans WHERE {_HASH.format(x='trace_id::VARCHAR')} < 0.1::DOUBLE""")
def trace_sample(t):
    return traces.trace_sample(t.spans, 0.1).select("trace_id", "span_id")


@query("span_batch", """
SELECT span_id, service, (row_number() OVER (PARTITION BY service ORDER BY ts, span_id) - 1) // 50 AS batch
FROM spans WHERE duration_ms <= 200""")
def span_batch(t):
    return traces.span_batch(t.spans, 50, 200.0).select("span_id", "service", "batch")


@query("schema_check_events", """
SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'malformed body' WHEN event_id % 7 = 0 THEN 'no kind' ELSE '' END AS reason,
  event_id % 50 <> 0 AND event_id % 7 <> 0 AS valid FROM events""")
def schema_check_events(t):
    i = F.col("event_id")
    kind = F.when(i % 7 == 0, "").otherwise(F.concat(F.lit(',"kind":"'), "event_type", F.lit('"')))
    body = F.when(i % 50 == 0, "{bad").otherwise(F.concat(F.lit('{"id":'), i, kind, F.lit("}")))
    got = ev.schema_check_events(t.events.withColumn("body", body), "id long, kind string", ["id", "kind"])
    return got.select("event_id", "reason", "valid")


@query("retry_dead_letter", """
SELECT message_id, attempts, CASE WHEN attempts > 3 THEN 'dead-letter' ELSE 'retry' END AS next,
  CASE WHEN attempts <= 3 THEN least(30.0::DOUBLE, 2.0::DOUBLE ** attempts) END AS delay_s FROM messages WHERE status = 'error'""")
def retry_dead_letter(t):
    return ev.retry_dead_letter(t.messages).select("message_id", "attempts", "next", "delay_s")


# --- streaming jobs; results are written to files and read back ---------------


class StreamTables(Tables):
    """The same views over a streaming read of the events."""

    @property
    def events(self):
        # a pattern, because the table may be one file or a folder of files
        return jobs.read_files(self.spark, f"{self.sf_dir}/events.parque[t]", RAW["events"])


def _streamed(t, name, df):
    out = shared_folder(t.spark, name)
    jobs.run_to_files(df, f"{out}/data", f"{out}/checkpoint")
    return t.spark.read.schema(df.schema).parquet(f"{out}/data")


def _wall_clock(df, *columns):
    return df.withColumns({c: to_wall(F.col(c)) for c in columns})


@query("watermark_late", """
SELECT name, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM metrics
GROUP BY 1, 2 HAVING time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM metrics) - INTERVAL 30 MINUTE""")
def watermark_late(t):
    """Hourly windows that the watermark (20 min disorder + 10 min lateness) has closed."""
    stream = StreamTables(t.spark, t.sf_dir)
    got = _streamed(t, "watermark", jobs.tumbling_stream(stream.metrics, "1 hour", "30 minutes"))
    return _wall_clock(got, "window_start").select("name", "window_start", "n", F.round("total", 4).alias("total"))


@query("throughput_stream", """
SELECT topic, processor, time_bucket(INTERVAL 1 MINUTE, ts) AS window_start, count(*) AS n, round(count(*) / 60.0::DOUBLE, 6) AS per_second
FROM messages GROUP BY 1, 2, 3
HAVING time_bucket(INTERVAL 1 MINUTE, ts) + INTERVAL 1 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) FROM messages) - INTERVAL 1 MINUTE""")
def throughput_stream(t):
    stream = StreamTables(t.spark, t.sf_dir)
    got = _streamed(t, "throughput", jobs.throughput_stream(stream.messages))
    return rounded(_wall_clock(got, "window_start"), "per_second")


@query("state_ttl", """
WITH l AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 6 HOUR THEN 1 ELSE 0 END)
  OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS stretch FROM l)
SELECT user_id::VARCHAR AS key, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS n FROM s GROUP BY user_id, stretch
HAVING epoch_ms(max(ts)) + CASE WHEN epoch_us(max(ts)) % 1000 > 0 THEN 1 ELSE 0 END + 21600000 <= (SELECT epoch_ms(max(ts)) FROM events) - 1800000""")
def state_ttl(t):
    """Events per user in state that expires after six hours of event time without a row; what the watermark has closed."""
    stream = StreamTables(t.spark, t.sf_dir)
    out = shared_folder(t.spark, "state-ttl")
    table = jobs.BatchLog(t.spark, f"{out}/data")
    counts = jobs.expiring_counts(stream.events, "user_id", ttl_seconds=6 * 3600, delay="30 minutes")
    jobs.run_stateful(counts, table.write, f"{out}/checkpoint")
    return table.read().select("key", "first_us", "last_us", "n")


@query("collect_stream", """
SELECT system_id, name, ts, labels, round(value, 6) AS value FROM metrics""")
def collect_stream(t):
    """Envelopes streamed into the metric table by upsert."""
    stream = StreamTables(t.spark, t.sf_dir)
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp")
    point = F.struct("name", "value", "unit", decode_labels(F.col("labels")).alias("labels"), stamp)
    bodies = stream.metrics.select(F.to_json(F.struct("system_id", F.array(point).alias("metrics"))).alias("body"))
    out = shared_folder(t.spark, "collect")
    table = jobs.BatchLog(t.spark, f"{out}/data")
    jobs.run_batches(bodies, jobs.collect_stream(table), f"{out}/checkpoint")
    return jobs.collected_metrics(table).select("system_id", "name", "ts", "labels", r6("value").alias("value"))


@query("alert_stream", """
SELECT r.id AS rule_id, r.system_id, r.metric_name, 'active' AS status FROM rules r
JOIN latest l ON l.system_id = r.system_id AND l.name = r.metric_name
WHERE r.enabled AND CASE WHEN r.operator IN ('gt', '>') THEN l.value > r.threshold ELSE l.value >= r.threshold END""")
def alert_stream(t):
    """Rules evaluated on every micro-batch; alerts open and resolve."""
    stream = StreamTables(t.spark, t.sf_dir)
    out = shared_folder(t.spark, "alerts")
    state, changes = jobs.BoundedState(t.spark, f"{out}/open"), jobs.BatchLog(t.spark, f"{out}/changes")
    rules = selection.enabled_rules(t.rules, t.systems)
    step = jobs.alert_stream(state, changes, rules, as_of(), jobs.BoundedState(t.spark, f"{out}/points"))
    jobs.run_batches(stream.metrics, step, f"{out}/checkpoint")
    return jobs.standing_alerts(changes).select("rule_id", "system_id", "metric_name", "status")
