"""Column expressions of failure prediction and anomaly scoring."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Texts recommended above each probability, highest first.
RECOMMENDATIONS = (
    (0.7, (
        "Immediate attention required - Scale up resources",
        "Check system logs for errors",
        "Consider enabling circuit breakers",
        "Prepare rollback plan",
    )),
    (0.5, (
        "Monitor system closely",
        "Consider preventive scaling",
        "Review recent deployments",
    )),
)
OTHERWISE_RECOMMENDED = ("System appears stable",)

# The features of the failure model, in order.
FEATURES = (
    "cpu_usage", "memory_usage", "disk_usage", "network_io", "request_count",
    "response_time", "error_rate", "gc_frequency", "thread_count", "connection_count",
)


def risk_level(p: Column) -> Column:
    return F.when(p >= 0.8, "critical").when(p >= 0.6, "high").when(p >= 0.4, "medium").otherwise("low")


def failure_time(p: Column, as_of: Column) -> Column:
    """When a failure is expected; null below 0.3, at least one hour away."""
    hours = F.greatest(F.lit(1), (24 * (1 - p)).cast("int"))
    ahead = F.make_dt_interval(F.lit(0), hours, F.lit(0), F.lit(0).cast("decimal(18,6)"))
    return F.when(p >= 0.3, as_of + ahead)


def _factor(metric: str, severity: Column, impact: str) -> Column:
    return F.struct(
        F.lit(metric).alias("metric"), F.col(metric).alias("value"), severity.alias("severity"),
        F.lit(impact).alias("impact"),
    )


def contributing_factors() -> Column:
    """Features that explain a failure, in feature order; features are fractions."""
    found = []
    for name in FEATURES:
        value = F.col(name)
        if name in ("cpu_usage", "memory_usage", "disk_usage"):
            severity = F.when(value > 0.9, "high").otherwise("medium")
            found.append(F.when(value > 0.8, _factor(name, severity, "High resource utilization detected")))
        elif name == "error_rate":
            found.append(F.when(value > 0.05, _factor(name, F.lit("high"), "Elevated error rate detected")))
    return F.array_compact(F.array(*found))


def recommendations(p: Column) -> Column:
    out = None
    for bound, texts in RECOMMENDATIONS:
        advice = F.array(*[F.lit(x) for x in texts])
        out = F.when(p > bound, advice) if out is None else out.when(p > bound, advice)
    return out.otherwise(F.array(*[F.lit(x) for x in OTHERWISE_RECOMMENDED]))


def anomaly_severity(score: Column) -> Column:
    return F.when(score < -0.5, "high").when(score < -0.2, "medium").otherwise("low")


def risk_interpretation(p: Column) -> Column:
    return (
        F.when(p > 0.7, "High failure risk").when(p > 0.4, "Moderate failure risk")
        .otherwise("Low failure risk")
    )


def logit_probability(x: Column) -> Column:
    """Struct of the sigmoid and a confidence: the size of the logit within 0.5..1."""
    return F.struct(
        (F.lit(1.0) / (1 + F.exp(-x))).alias("probability"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.5), F.abs(x))).alias("confidence"),
    )


def binary_confidence(probabilities: Column) -> Column:
    """Struct of the class-1 probability (or the only one) and the largest one.

    Without probabilities the confidence is 0.8.
    """
    return F.struct(
        F.coalesce(F.get(probabilities, F.lit(1)), F.get(probabilities, F.lit(0))).alias("probability"),
        F.coalesce(F.array_max(probabilities), F.lit(0.8)).alias("confidence"),
    )


def failure_label() -> Column:
    """1 where the features (fractions; response time in ms) are those of a failure."""
    return (
        (F.col("cpu_usage") > 0.8) | (F.col("memory_usage") > 0.9) | (F.col("error_rate") > 0.1)
        | (F.col("response_time") > 2000)
    ).cast("int")
