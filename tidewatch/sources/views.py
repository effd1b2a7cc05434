"""Monitoring tables derived from the driver tables (FIXTURES.md section 4).

Every view is a lazy DataFrame over a whole driver table, so each query reads
data whose size grows with the scale factor.  ``tidewatch.plans.oracle_views``
states the same views in SQL.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewatch.schemas import RAW

AS_OF = "2024-01-31 00:00:00"

# Metric name and unit for each kind of event.
METRIC_OF_EVENT = {
    "click": ("cpu_usage", "percent"),
    "view": ("memory_usage", "percent"),
    "error": ("error_rate", "percent"),
    "purchase": ("response_time", "ms"),
    "signup": ("request_count", "count"),
}

# The rule set given to every second system.
RULE_TEMPLATES = [
    (1, "cpu_usage", "gt", 90.0, "critical", True),
    (2, "memory_usage", "gte", 85.0, "high", True),
    (3, "error_rate", ">", 5.0, "critical", True),
    (4, "response_time", "gt", 2000.0, "medium", True),
    (5, "request_count", "lt", 1.0, "low", False),
]


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def mapped(column: Column, mapping: dict[str, str]) -> Column:
    """``column`` translated by a small fixed mapping; null when absent."""
    out = None
    for key, value in mapping.items():
        out = F.when(column == key, value) if out is None else out.when(column == key, value)
    return out


def pick(index: Column, values: list[str]) -> Column:
    """The ``index``-th (0-based) entry of a small fixed list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def hours(n: Column) -> Column:
    return F.make_dt_interval(F.lit(0), n.cast("int"), F.lit(0), F.lit(0).cast("decimal(18,6)"))


class Tables:
    """Driver tables and the views on them, built on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.schema(RAW[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self.raw("events")

    @cached_property
    def metrics(self) -> DataFrame:
        """Labelled samples; labels are canonical JSON text."""
        kind, value = F.col("event_type"), F.col("value")
        scaled = (
            F.when(kind == "error", value / 20)
            .when(kind == "purchase", value * 10)
            .when(kind == "signup", F.floor(value).cast("double"))
            .otherwise(F.least(value, F.lit(100.0)))
        ) + F.lit(0.0)
        label = F.get_json_object("props", "$.k")
        return self.events.select(
            F.col("event_id").alias("id"),
            F.concat(F.lit("sys-"), F.col("user_id")).alias("system_id"),
            mapped(kind, {k: v[0] for k, v in METRIC_OF_EVENT.items()}).alias("name"),
            scaled.alias("value"),
            mapped(kind, {k: v[1] for k, v in METRIC_OF_EVENT.items()}).alias("unit"),
            F.concat(F.lit('{"k":"'), label, F.lit('"}')).alias("labels"),
            F.col("ts"),
        )

    @cached_property
    def systems(self) -> DataFrame:
        key = F.col("c_custkey")
        start = F.lit("2023-01-01 00:00:00").cast("timestamp_ntz")
        return self.raw("customer").select(
            F.concat(F.lit("sys-"), key).alias("id"),
            F.col("c_name").alias("name"),
            F.col("c_mktsegment").alias("type"),
            F.lit("unknown").alias("status"),
            (start + hours(key)).alias("created_at"),
            F.col("c_nationkey").alias("nation_key"),
            F.concat(
                F.lit('{"cpu_usage":'), 60 + key % 40, F.lit(',"memory_usage":'), 50 + key % 50, F.lit("}")
            ).alias("thresholds"),
            key.alias("system_no"),
        )

    @cached_property
    def alerts(self) -> DataFrame:
        key = F.col("o_orderkey")
        priority = F.col("o_orderpriority")
        severity = (
            F.when(priority == "1-URGENT", "critical")
            .when(priority == "2-HIGH", "high")
            .when(priority == "3-MEDIUM", "medium")
            .otherwise("low")
        )
        return self.raw("orders").select(
            F.concat(F.lit("alert_"), key).alias("id"),
            F.concat(F.lit("sys-"), F.col("o_custkey")).alias("system_id"),
            severity.alias("severity"),
            mapped(
                F.col("o_orderstatus"), {"O": "active", "P": "acknowledged", "F": "resolved"}
            ).alias("status"),
            pick(key % 3, ["cpu_usage", "memory_usage", "error_rate"]).alias("metric_name"),
            F.col("o_totalprice").alias("metric_value"),
            F.lit("gt").alias("operator"),
            F.col("o_orderdate").alias("created_at"),
            F.when(
                F.col("o_orderstatus") == "F", F.col("o_orderdate") + hours(key % 72 + 1)
            ).alias("resolved_at"),
            key.alias("alert_no"),
        )

    @cached_property
    def rules(self) -> DataFrame:
        templates = F.array(
            *[
                F.struct(
                    F.lit(n).alias("n"), F.lit(m).alias("metric_name"), F.lit(op).alias("operator"),
                    F.lit(t).alias("threshold"), F.lit(s).alias("severity"), F.lit(e).alias("enabled"),
                )
                for n, m, op, t, s, e in RULE_TEMPLATES
            ]
        )
        key = F.col("c_custkey")
        return (
            self.raw("customer")
            .where(key % 2 == 0)
            .select(key, F.explode(templates).alias("r"))
            .select(
                F.concat(F.lit("rule_"), key, F.lit("_"), F.col("r.n")).alias("id"),
                F.concat(F.lit("sys-"), key).alias("system_id"),
                F.concat(F.lit("rule "), F.col("r.metric_name")).alias("name"),
                F.col("r.metric_name").alias("metric_name"),
                F.col("r.operator").alias("operator"),
                F.col("r.threshold").alias("threshold"),
                F.when(F.col("r.n") != 4, F.col("r.severity")).alias("severity"),
                F.col("r.enabled").alias("enabled"),
                (F.col("r.n") * 600).alias("duration_s"),
                F.concat(F.lit('{"k":"rule","team":"t'), key % 3, F.lit('"}')).alias("labels"),
                F.when((key / 2).cast("long") % 2 == 0, F.lit("email,slack"))
                .otherwise(F.lit("webhook,fax")).alias("channels"),
            )
        )

    @cached_property
    def metric_batch(self) -> DataFrame:
        """A batch to upsert: every tenth sample changed (twice), every next one new."""
        base = self.metrics
        changed = base.where(F.col("id") % 10 == 0)
        first = changed.withColumn("value", F.col("value") + 1).withColumn("seq", F.lit(0))
        second = changed.withColumn("value", F.col("value") + 2).withColumn("seq", F.lit(1))
        added = (
            base.where(F.col("id") % 10 == 1)
            .withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR"))
            .withColumn("seq", F.lit(0))
        )
        return first.unionByName(second).unionByName(added)

    @cached_property
    def predictions(self) -> DataFrame:
        key = F.col("event_id")
        return self.events.select(
            F.col("event_type").alias("model_id"),
            key.alias("seq"),
            (F.col("value") / 500).alias("actual"),
            ((key * 7919 % 1000) / F.lit(1000.0)).alias("predicted"),
            (F.lit(0.5) + (key % 50) / F.lit(100.0)).alias("confidence"),
        )

    @cached_property
    def model_outputs(self) -> DataFrame:
        key = F.col("event_id")
        names = F.array(
            *[
                F.struct(F.lit(i).alias("n"), F.lit(m).alias("model_name"))
                for i, m in enumerate(["lstm", "transformer", "random_forest", "isolation_forest"], 1)
            ]
        )
        n = F.col("m.n")
        return self.events.select(
            key, F.concat(F.lit("sys-"), F.col("user_id")).alias("system_id"), F.explode(names).alias("m")
        ).select(
            key.alias("request_id"),
            "system_id",
            F.col("m.model_name").alias("model_name"),
            ((key * (n * 31 + 7) % 1000) / F.lit(1000.0)).alias("probability"),
            (F.lit(0.5) + (key * n % 50) / F.lit(100.0)).alias("confidence"),
        )

    @cached_property
    def requests(self) -> DataFrame:
        """Prediction requests, one per event."""
        key = F.col("event_id")
        return self.events.select(
            key.alias("request_id"),
            F.concat(F.lit("sys-"), F.col("user_id")).alias("system_id"),
            pick(
                key % 6,
                ["failure_prediction", "capacity_planning", "performance_forecast",
                 "resource_optimization", "anomaly_detection", "trend_analysis"],
            ).alias("prediction_type"),
            (key % 200).cast("int").alias("time_horizon"),
            ((key % 120) / F.lit(100.0)).alias("confidence_threshold"),
            ((key % 13) / F.lit(10.0)).alias("sensitivity"),
            (key % 12).cast("int").alias("priority"),
            (key % 110).cast("int").alias("batch_size"),
            ((key % 70) / F.lit(100.0)).alias("test_split"),
            (key % 4).cast("int").alias("n_metrics"),
            F.col("ts").alias("generated_at"),
            (F.col("value") / 10).alias("latency_ms"),
            F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"),
        )

    @cached_property
    def models(self) -> DataFrame:
        """Model registry: one model per customer, some fields missing."""
        key = F.col("c_custkey")
        trained = as_of() - hours(key % 60 * 24 + key % 24)
        return self.raw("customer").select(
            F.concat(F.lit("model-"), key).alias("model_id"),
            pick(
                key % 8,
                ["lstm", "transformer", "random_forest", "prophet", "xgboost", "svm",
                 "isolation_forest", "autoencoder"],
            ).alias("model_type"),
            F.when(key % 5 == 0, "inactive").otherwise("active").alias("status"),
            F.when(key % 7 != 0, (key * 37 % 100) / F.lit(100.0)).alias("accuracy"),
            F.when(key % 11 != 0, (key * 53 % 150) / F.lit(100.0)).alias("mae"),
            F.when(key % 13 != 0, trained).alias("training_date"),
            F.when(key % 17 == 0, F.concat(F.lit("sys-"), (key / 17).cast("long"))).alias("system_id"),
            key.alias("model_no"),
        )

    @cached_property
    def model_metrics(self) -> DataFrame:
        key = F.col("c_custkey")
        pct = lambda m: (key * m % 101) / F.lit(100.0)
        return self.raw("customer").select(
            F.concat(F.lit("model-"), key).alias("model_name"),
            key.alias("position"),
            pct(37).alias("accuracy"),
            pct(41).alias("precision"),
            pct(43).alias("recall"),
            pct(47).alias("f1_score"),
        )

    @cached_property
    def class_pairs(self) -> DataFrame:
        return self.raw("labels").select(
            F.col("quality").alias("label"), (1 - F.col("toxic")).alias("pred")
        )

    @cached_property
    def series_arrays(self) -> DataFrame:
        return self.raw("embeddings").select(
            "vec_id", F.col("embedding").cast("array<double>").alias("values"), "label"
        )

    @cached_property
    def http_requests(self) -> DataFrame:
        key, kind = F.col("event_id"), F.col("event_type")
        return self.events.select(
            key.alias("request_id"),
            F.col("user_id").cast("string").alias("client"),
            F.when(key % 4 != 0, F.col("user_id").cast("string")).alias("user_id"),
            F.concat(F.lit("10.0.0."), F.col("user_id") % 250).alias("ip"),
            mapped(
                kind,
                {"click": "/api/v1/predict", "view": "/api/v1/detect-anomalies",
                 "purchase": "/api/v1/train", "signup": "/health", "error": "/other"},
            ).alias("path"),
            pick(key % 3, ["GET", "POST", "PUT"]).alias("method"),
            F.when(kind == "error", 500).when(key % 17 == 0, 404).otherwise(200).alias("status"),
            (F.col("value") / 1000).alias("duration_s"),
            F.col("ts"),
        )

    @cached_property
    def messages(self) -> DataFrame:
        key = F.col("event_id")
        return self.events.select(
            key.alias("message_id"),
            pick(key % 6, ["metrics", "logs", "events", "traces", "alerts", "bogus"]).alias("topic"),
            F.col("event_type").alias("processor"),
            F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"),
            F.when(key % 50 == 0, "{bad").otherwise(F.col("props")).alias("body"),
            (key % 7).cast("int").alias("attempts"),
            F.col("ts"),
        )

    @cached_property
    def logs(self) -> DataFrame:
        key = F.col("doc_id")
        start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
        minutes = F.make_dt_interval(
            F.lit(0), F.lit(0), key.cast("int"), F.lit(0).cast("decimal(18,6)")
        )
        extra = F.concat(
            F.lit('{"user":"u'), key, F.lit('","password":"p'), key,
            F.lit('","api_key":"k'), key, F.lit('","ctx":{"token":"t'), key,
            F.lit('","n":'), key % 10, F.lit("}}"),
        )
        return self.raw("documents").select(
            key.alias("log_id"),
            (start + minutes).alias("ts"),
            pick(key % 4, ["DEBUG", "INFO", "WARNING", "ERROR"]).alias("level"),
            F.col("source").alias("service"),
            F.col("text").alias("message"),
            F.when(key % 3 != 0, F.concat(F.lit("req-"), key)).alias("request_id"),
            F.when(key % 6 == 1, F.concat(F.lit("corr-"), key)).alias("correlation_id"),
            F.concat(F.lit("u"), key % 20).alias("user_id"),
            F.when(key % 9 == 0, F.col("text")).otherwise(extra).alias("extra"),
        )

    @cached_property
    def spans(self) -> DataFrame:
        key = F.col("event_id")
        return self.events.select(
            F.floor(key / 5).cast("long").alias("trace_id"),
            key.alias("span_id"),
            F.when(key % 5 != 0, key - 1).alias("parent_span_id"),
            F.concat(F.lit("svc-"), F.col("user_id") % 10).alias("service"),
            F.col("value").alias("duration_ms"),
            F.col("ts"),
        )

    @cached_property
    def actions(self) -> DataFrame:
        key = F.col("event_id")
        return self.events.where(F.col("event_type").isin("purchase", "error")).select(
            key.alias("action_id"),
            pick(key % 4, ["restart", "scale", "update_config", "delete_volume"]).alias("action_type"),
            F.concat(F.lit("sys-"), F.col("user_id")).alias("system_id"),
            pick(F.col("user_id") % 3, ["production", "staging", "dev"]).alias("environment"),
            pick(
                key % 5, ["pending", "running", "succeeded", "failed", "rolled_back"]
            ).alias("status"),
            F.col("value").alias("duration_s"),
            F.col("ts").alias("requested_at"),
        )

    @cached_property
    def late_events(self) -> DataFrame:
        key = F.col("event_id")
        return self.events.select(
            key, "ts", "user_id", "event_type", "value",
            (key + F.when(key % 20 == 0, 120).otherwise(0)).alias("arrival"),
        )
