"""Fleet, system and model aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.operators import ordered, quantiles
from tidewatch.operators.selection import span

_ON_SYSTEM = "system_id"
_FLEET = ("cpu_usage", "memory_usage", "response_time", "request_count", "error_rate")


def aggregated_metrics(metrics: DataFrame, systems: DataFrame, as_of: Column, range_text: str) -> DataFrame:
    """Count, mean, minimum and maximum per metric name over the registered systems.

    Samples are reduced to one row per series before they meet the systems, so a
    busy system brings one row per name to the join.  NaN samples are left out
    and counted.  Systems without samples count in ``system_count``.
    """
    value = F.when(~F.isnan("value"), F.col("value"))
    per_series = (
        metrics.where(F.col("ts").between(as_of - span(range_text), as_of))
        .groupBy(_ON_SYSTEM, "name")
        .agg(
            F.count(value).alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"),
            F.max(value).alias("high"), F.count_if(F.isnan("value")).alias("nans"),
        )
    )
    registered = systems.select(F.col("id").alias(_ON_SYSTEM))
    system_count = systems.select(F.count(F.lit(1))).scalar()
    return (
        per_series.join(registered, _ON_SYSTEM, "left_semi").groupBy("name")
        .agg(
            F.sum("n").alias("count"), (F.sum("total") / F.sum("n")).alias("average"),
            F.min("low").alias("minimum"), F.max("high").alias("maximum"), F.sum("nans").alias("nan_count"),
        )
        .withColumns(
            {"system_count": system_count, "start_time": as_of - span(range_text), "end_time": as_of}
        )
    )


def _violation() -> Column:
    """Status implied by one sample; null when it is within bounds (fixed bounds)."""
    name, value = F.col("name"), F.col("value")
    return (
        F.when((name == "cpu_usage") & (value > 90), "critical")
        .when((name == "memory_usage") & (value > 85), "warning")
        .when((name == "error_rate") & (value > 5), "critical")
    )


def _penalty() -> Column:
    name, value = F.col("name"), F.col("value")
    return (
        F.when((name == "cpu_usage") & (value > 80), (value - 80) * 2)
        .when((name == "memory_usage") & (value > 85), (value - 85) * 3)
        .when(name == "error_rate", value * 10)
        .otherwise(0.0)
    )


def _status() -> Column:
    """The newest violating sample decides; of equal times the critical one."""
    kind = _violation()
    order = F.when(kind.isNotNull(), F.struct(F.col("ts"), (kind == "critical").alias("worst")))
    return F.coalesce(F.max_by(kind, order), F.lit("healthy"))


def _score() -> Column:
    return F.greatest(F.lit(0.0), 100 - F.sum(_penalty()))


def _last(metrics: DataFrame, as_of: Column, range_text: str) -> DataFrame:
    return metrics.where(F.col("ts").between(as_of - span(range_text), as_of))


def _onto_systems(systems: DataFrame, per_system: DataFrame) -> DataFrame:
    return systems.select(F.col("id").alias(_ON_SYSTEM), F.col("name").alias("system_name")).join(
        per_system, _ON_SYSTEM, "left"
    )


def system_status(metrics: DataFrame, systems: DataFrame, as_of: Column, range_text: str = "1h") -> DataFrame:
    per_system = _last(metrics, as_of, range_text).groupBy(_ON_SYSTEM).agg(_status().alias("status"))
    return _onto_systems(systems, per_system).fillna("unknown", ["status"])


def health_score(
    metrics: DataFrame, systems: DataFrame, as_of: Column, range_text: str = "1h", latest_only: bool = False
) -> DataFrame:
    """100 minus the penalties of every sample, at least 0; 0 without samples.

    ``latest_only`` counts the newest sample of each series instead.
    """
    rows = _last(metrics, as_of, range_text)
    if latest_only:
        rows = rows.groupBy(_ON_SYSTEM, "name").agg(F.max_by("value", F.struct("ts", "id")).alias("value"))
    per_system = rows.groupBy(_ON_SYSTEM).agg(_score().alias("health_score"))
    return _onto_systems(systems, per_system).fillna(0.0, ["health_score"])


def system_snapshot(metrics: DataFrame, systems: DataFrame, as_of: Column, range_text: str = "1h") -> DataFrame:
    """Status, score and number of samples per system, in one aggregation."""
    per_system = _last(metrics, as_of, range_text).groupBy(_ON_SYSTEM).agg(
        _status().alias("status"), _score().alias("health_score"), F.count(F.lit(1)).alias("n")
    )
    return _onto_systems(systems, per_system).fillna({"status": "unknown", "health_score": 0.0, "n": 0})


def _open_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.where(F.col("status").isin("active", "acknowledged")).groupBy(_ON_SYSTEM).agg(
        F.count(F.lit(1)).alias("n_open"), F.bool_or(F.col("severity") == "critical").alias("any_critical")
    )


def overall_status(snapshot: DataFrame, alerts: DataFrame) -> DataFrame:
    """Alerts outrank metrics: critical, then warning, then the metric status."""
    joined = snapshot.join(_open_alerts(alerts), _ON_SYSTEM, "left")
    return joined.withColumns(
        {
            "n_open": F.coalesce("n_open", F.lit(0)),
            "status": F.when(F.col("any_critical"), "critical").when(F.col("n_open") > 0, "warning")
            .otherwise(F.coalesce("status", F.lit("unknown"))),
        }
    ).drop("any_critical")


def system_details(systems: DataFrame, metrics: DataFrame, alerts: DataFrame, as_of: Column) -> DataFrame:
    """Every system with its last hour and its open alerts."""
    out = overall_status(system_snapshot(metrics, systems, as_of), alerts)
    return out.withColumnsRenamed({_ON_SYSTEM: "id", "system_name": "name"})


def systems_metrics_join(systems: DataFrame, metrics: DataFrame, as_of: Column, range_text: str) -> DataFrame:
    """Samples in range by system, keeping systems without any."""
    return systems.select(F.col("id").alias(_ON_SYSTEM)).join(
        _last(metrics, as_of, range_text), _ON_SYSTEM, "left"
    )


def system_dimension(systems: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return systems.join(places, F.col("nation_key") == F.col("n_nationkey"), "left").select(
        F.col("id").alias(_ON_SYSTEM), F.col("name").alias("system_name"),
        F.col("n_name").alias("nation"), F.col("r_name").alias("region"),
    )


def event_enrich(events: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Add the fields of a lookup table; unknown keys get nulls."""
    return events.join(dimension, key, "left")


def models_named(model_metrics: DataFrame, names: DataFrame) -> DataFrame:
    return model_metrics.join(names.select("model_name").distinct(), "model_name", "left_semi")


def fleet_summary(metrics: DataFrame) -> DataFrame:
    """Means over the fleet, total requests and number of systems.

    Sums are taken per system and metric first, which also counts the systems
    without a distinct aggregate.
    """
    per_series = metrics.groupBy(_ON_SYSTEM, "name").agg(
        F.sum("value").alias("total"), F.count("value").alias("n")
    )
    per_system = per_series.groupBy(_ON_SYSTEM).agg(
        *[F.sum(F.when(F.col("name") == m, F.col(c))).alias(f"{m}_{c}") for m in _FLEET for c in ("total", "n")]
    )
    mean = {m: F.sum(f"{m}_total") / F.sum(f"{m}_n") for m in _FLEET}
    return per_system.agg(
        mean["cpu_usage"].alias("avg_cpu_usage"), mean["memory_usage"].alias("avg_memory_usage"),
        mean["response_time"].alias("avg_response_time"), F.sum("request_count_total").alias("total_requests"),
        mean["error_rate"].alias("error_rate"), F.count(F.lit(1)).alias("systems"),
    )


def _hours_before(as_of: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", as_of, F.col("ts")) / F.lit(3.6e9)


def metric_trends(metrics: DataFrame, as_of: Column, by: Sequence[str] = ("name",), tolerance: float = 0.05) -> DataFrame:
    """Change over the span relative to the mean: stable within the tolerance."""
    x = _hours_before(as_of)
    out = metrics.groupBy(*by).agg(
        F.regr_slope("value", x).alias("slope"), F.avg("value").alias("mean"),
        (F.max(x) - F.min(x)).alias("hours"),
    )
    change = F.try_divide(F.col("slope") * F.col("hours"), F.col("mean"))
    trend = F.when(change > tolerance, "increasing").when(change < -tolerance, "decreasing").otherwise("stable")
    return out.withColumns({"change": change, "trend": trend})


PERCENTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def metric_percentiles(metrics: DataFrame, by: Sequence[str] = ("name",), approximate: bool = False) -> DataFrame:
    if not approximate:
        return quantiles.exact_percentiles(metrics, by, "value", PERCENTILES)
    return metrics.groupBy(*by).agg(
        *[F.approx_percentile("value", q).alias(n) for n, q in PERCENTILES.items()]
    )


def feature_vector(metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean, deviation, extremes, quartiles and length of each series, of all values but NaN."""
    return quantiles.exact_percentiles(metrics, by, "value", {"median": 0.5, "p25": 0.25, "p75": 0.75}, moments=True)


def batch_summary(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals of prediction batches; ``probability`` is null where a request failed."""
    p = F.col("probability")
    return predictions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_requests"), F.count(p).alias("successful"),
        F.count_if(p.isNull()).alias("failed"), F.coalesce(F.avg(p), F.lit(0.0)).alias("avg_probability"),
        F.coalesce(F.max(p), F.lit(0.0)).alias("max_probability"), F.count_if(p > 0.7).alias("high_risk"),
    )


def requests_by_type(requests: DataFrame, batch_size: int = 100) -> DataFrame:
    """Group requests by type into batches of at most ``batch_size``.

    A type may hold most of the requests, so its members are numbered in chunks
    and cut into batches; no list of a whole type is ever built.
    """
    numbered = ordered.running(
        requests, ["prediction_type"], ["generated_at", "request_id"],
        ordered.row_chunks("generated_at"), __n=ordered.row_number(),
    )
    batch = F.floor((F.col("__n") - 1) / F.lit(batch_size)).cast("long")
    return numbered.withColumn("batch", batch).groupBy("prediction_type", "batch").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("request_id")).alias("request_ids")
    )


def weighted_confidence(df: DataFrame, confidences: str) -> DataFrame:
    """Mean weighted by 1 / (position), position counted from 1; 0 when empty."""
    weighted = F.aggregate(
        F.transform(confidences, lambda c, i: c / (i + 1)), F.lit(0.0), lambda acc, x: acc + x
    )
    weights = F.aggregate(
        F.transform(confidences, lambda c, i: F.lit(1.0) / (i + 1)), F.lit(0.0), lambda acc, x: acc + x
    )
    return df.withColumn("confidence", F.coalesce(F.try_divide(weighted, weights), F.lit(0.0)))


# Base weight of each model in the ensemble.
ENSEMBLE_WEIGHTS = {"lstm": 0.3, "transformer": 0.3, "random_forest": 0.25, "isolation_forest": 0.15}
OTHER_MODEL_WEIGHT = 0.1


def ensemble_probability(outputs: DataFrame, by: Sequence[str] = ("request_id",)) -> DataFrame:
    """Probability and confidence weighted by base weight x confidence; 0 without weight."""
    base = F.lit(OTHER_MODEL_WEIGHT)
    for name, weight in ENSEMBLE_WEIGHTS.items():
        base = F.when(F.col("model_name") == name, weight).otherwise(base)
    w = base * F.col("confidence")

    def mean(column: str) -> Column:
        return F.coalesce(F.try_divide(F.sum(F.col(column) * w), F.sum(w)), F.lit(0.0)).alias(column)

    return outputs.groupBy(*by).agg(mean("probability"), mean("confidence"))


SCORES = ("accuracy", "precision", "recall", "f1_score")


def unpivot_scores(model_metrics: DataFrame) -> DataFrame:
    return model_metrics.unpivot(["model_name", "position"], list(SCORES), "metric", "value")


def model_comparison(model_metrics: DataFrame) -> DataFrame:
    return unpivot_scores(model_metrics).groupBy("metric").agg(
        F.max("value").alias("best"), F.min("value").alias("worst"), F.avg("value").alias("average"),
        F.stddev_pop("value").alias("std_dev"),
    )


def model_counts(models: DataFrame) -> DataFrame:
    return models.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "active").alias("active")
    )


def classification_metrics(pairs: DataFrame) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1.

    Pairs are counted first; everything after works on one row per class.
    """
    counts = pairs.groupBy("label", "pred").agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("label").alias("cls"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), hit.cast("long").alias("tp")),
        F.struct(F.col("pred").alias("cls"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp")),
    )
    per_class = counts.select(F.explode(sides).alias("s")).groupBy("s.cls").agg(
        F.sum("s.support").alias("support"), F.sum("s.predicted").alias("predicted"), F.sum("s.tp").alias("tp")
    )
    zero = F.lit(0.0)
    precision = F.coalesce(F.try_divide(F.col("tp"), F.col("predicted")), zero)
    recall = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), zero)
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), zero)
    weight = F.col("support")
    total = F.sum(weight)
    return per_class.agg(
        (F.sum("tp") / total).alias("accuracy"), (F.sum(precision * weight) / total).alias("precision"),
        (F.sum(recall * weight) / total).alias("recall"), (F.sum(f1 * weight) / total).alias("f1_score"),
    )


def union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
