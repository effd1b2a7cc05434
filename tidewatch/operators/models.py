"""Model registry: scores, rankings, selection, rolling performance, forecasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tidewatch.operators import ordered
from tidewatch.operators.aggregate import unpivot_scores

# Candidate models of each prediction type, in order of preference.
CANDIDATES = {
    "failure_prediction": ("lstm", "transformer", "random_forest"),
    "capacity_planning": ("prophet", "lstm", "xgboost"),
    "performance_forecast": ("lstm", "transformer", "prophet"),
    "resource_optimization": ("xgboost", "random_forest", "svm"),
    "anomaly_detection": ("isolation_forest", "autoencoder", "svm"),
    "trend_analysis": ("prophet", "lstm", "transformer"),
}


def model_score(as_of: Column, quality: Column | None = None) -> Column:
    """Accuracy 0.4, inverted error 0.3, freshness 0.2, data quality 0.1; at most 1.

    A missing part adds nothing; a missing quality counts as 0.5.  Freshness
    decays over thirty whole days.
    """
    days = F.floor(F.timestamp_diff("SECOND", F.col("training_date"), as_of) / F.lit(86400))
    accuracy = F.coalesce("accuracy", F.lit(0.0)) * 0.4
    error = F.coalesce(F.greatest(F.lit(0.0), 1 - F.col("mae")), F.lit(0.0)) * 0.3
    fresh = F.when(F.col("training_date").isNotNull(), F.greatest(F.lit(0.0), 1 - days / 30)).otherwise(0.0) * 0.2
    known = F.lit(0.5) if quality is None else F.coalesce(quality, F.lit(0.5))
    return F.least(F.lit(1.0), accuracy + error + fresh + known * 0.1)


def select_optimal_model(requests: DataFrame, models: DataFrame, as_of: Column) -> DataFrame:
    """Model for each request: the system's own active one, else the best general one.

    The best model of each prediction type is found once, by aggregation over
    the registry, and then joined to the requests.  Scores must be above 0; on
    equal scores the earlier candidate wins, then the older entry.
    """
    active = models.where(F.col("status") == "active")
    kinds = None
    for kind, names in CANDIDATES.items():
        for position, name in enumerate(names):
            entry = F.when(
                F.col("model_type") == name,
                F.struct(F.lit(kind).alias("prediction_type"), F.lit(position).alias("position")),
            )
            kinds = [entry] if kinds is None else [*kinds, entry]
    general = (
        active.where(F.col("system_id").isNull()).withColumn("score", model_score(as_of))
        .where(F.col("score") > 0)
        .select("model_id", "model_no", "score", F.explode(F.array_compact(F.array(*kinds))).alias("k"))
        .groupBy("k.prediction_type")
        .agg(F.max_by("model_id", F.struct("score", -F.col("k.position"), -F.col("model_no"))).alias("best"))
    )
    own = active.where(F.col("system_id").isNotNull()).groupBy("system_id").agg(
        F.min_by("model_id", "model_no").alias("own")
    )
    return (
        # one row per prediction type, of which there are six
        requests.join(own, "system_id", "left").join(F.broadcast(general), "prediction_type", "left")
        .withColumns({"model_id": F.coalesce("own", "best"), "system_specific": F.col("own").isNotNull()})
        .drop("own", "best")
    )


def model_rankings(model_metrics: DataFrame) -> DataFrame:
    """Models of each metric from best to worst; equal values keep their input order."""
    long = unpivot_scores(model_metrics).withColumn("__neg", -F.col("value"))
    ranked = ordered.running(long, ["metric"], ["__neg", "position"], ordered.value_chunks("__neg"), rank=ordered.row_number())
    return ranked.drop("__neg")


def rolling_model_performance(predictions: DataFrame, window: int = 100, block: int = 100_000) -> DataFrame:
    """Mean error, mean confidence and accuracy over the last ``window`` predictions of a model."""
    df = predictions.select("model_id", "seq", F.abs(F.col("actual") - F.col("predicted")).alias("__error"), "confidence")
    cut = ordered.blocks(df, ["model_id"], ["seq"], ordered.number_chunk("seq", block), window - 1, block)
    in_block = Window.partitionBy("model_id", "block").orderBy("row_no")
    upto = in_block.rowsBetween(Window.unboundedPreceding, 0)
    summed = cut.select(
        "model_id", "seq", "row_no", "is_halo", "block",
        F.sum("__error").over(upto).alias("__e"), F.sum("confidence").over(upto).alias("__c"),
    )
    n = F.least(F.col("row_no"), F.lit(window))

    def mean(total: str) -> Column:
        # a difference of running sums: linear, where a sliding frame adds up every window anew
        return (F.col(total) - F.coalesce(F.lag(total, window).over(in_block), F.lit(0.0))) / n

    out = summed.select(
        "model_id", "seq", "is_halo", mean("__e").alias("mae"), mean("__c").alias("avg_confidence"), n.alias("n")
    )
    return out.where(~F.col("is_halo")).drop("is_halo").withColumn("accuracy", 1 - F.col("mae"))


def sequence_windows(
    series: DataFrame, keys: Sequence[str], length: int, ts: str = "ts", tie: str = "id",
    value: str = "value", block: int = 100_000,
) -> DataFrame:
    """All sliding windows of ``length`` samples of each series; none if it is shorter."""
    df = series.select(*keys, ts, tie, value)
    cut = ordered.blocks(df, keys, [ts, tie], ordered.row_chunks(ts), length - 1, block)
    back = Window.partitionBy(*keys, "block").orderBy("row_no").rowsBetween(-(length - 1), 0)
    return (
        cut.select(
            *keys, "row_no", "is_halo", F.collect_list(value).over(back).alias("values"),
            F.first(ts).over(back).alias("window_start"), F.col(ts).alias("window_end"),
        )
        .where(~F.col("is_halo") & (F.size("values") == length))
        .withColumn("window_no", F.col("row_no") - length + 1).drop("is_halo", "row_no")
    )


def forecast_rows(df: DataFrame, as_of: Column, horizon: Column | int, keep: Sequence[str]) -> DataFrame:
    """Arrays of predictions to one row per hour ahead.

    Columns ``predictions``, ``confidences``, ``lower`` and ``upper`` are arrays;
    the last three may be shorter: the confidence is then 0.8, a bound null.
    """
    limit = F.least(F.size("predictions"), horizon if isinstance(horizon, Column) else F.lit(horizon))
    hour = F.make_dt_interval(F.lit(0), F.col("i") + 1, F.lit(0), F.lit(0).cast("decimal(18,6)"))
    return df.select(
        *keep, "confidences", "lower", "upper", F.posexplode(F.slice("predictions", F.lit(1), limit)).alias("i", "predicted_value")
    ).select(
        *keep, "i", "predicted_value",
        F.coalesce(F.get("confidences", F.col("i")), F.lit(0.8)).alias("confidence"),
        (as_of + hour).alias("ts"), F.get("lower", F.col("i")).alias("lower_bound"),
        F.get("upper", F.col("i")).alias("upper_bound"),
    )


def confidence_filter(df: DataFrame, threshold: Column | float, filter_bounds: bool = True) -> DataFrame:
    """Keep predictions whose confidence reaches the threshold.

    With ``filter_bounds=False`` the bounds stay whole, so that they no longer
    line up with the predictions.
    """
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    zipped = F.filter(
        F.arrays_zip("predictions", "confidences", "lower", "upper"), lambda p: p["confidences"] >= limit
    )
    # pairs end with the shorter of predictions and confidences
    pairs = F.slice(zipped, F.lit(1), F.least(F.size("predictions"), F.size("confidences")))
    names = ["predictions", "confidences"] + (["lower", "upper"] if filter_bounds else [])
    kept = df.withColumn("__kept", pairs)
    return kept.withColumns({n: F.col("__kept")[n] for n in names}).drop("__kept")


def retrain_due(models: DataFrame, as_of: Column, minimum_accuracy: float = 0.75, hours: int = 24) -> DataFrame:
    """Models that are too inaccurate or too old."""
    age = F.timestamp_diff("SECOND", F.col("training_date"), as_of)
    return models.withColumns(
        {"inaccurate": F.coalesce(F.col("accuracy") < minimum_accuracy, F.lit(False)),
         "old": F.coalesce(age >= hours * 3600, F.lit(False))}
    ).where(F.col("inaccurate") | F.col("old"))
