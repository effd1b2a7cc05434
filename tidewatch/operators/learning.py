"""Features, series preparation, forecasts, anomaly scores and model training."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from tidewatch.functions.sampling import hash_fraction
from tidewatch.functions.scoring import (
    FEATURES, contributing_factors, failure_label, failure_time, recommendations, risk_level,
)
from tidewatch.operators import ordered, quantiles
from tidewatch.operators.aggregate import ensemble_probability
from tidewatch.operators.chunks import measured

# Stored percentages become the fractions the model uses.
FRACTIONS = {"cpu_usage": 100.0, "memory_usage": 100.0, "disk_usage": 100.0, "error_rate": 100.0}

#: Series up to which their statistics are broadcast to the samples.
BROADCAST_SERIES = 1_000


def features_wide(metrics: DataFrame, by: Sequence[str] = ("system_id",)) -> DataFrame:
    """Latest value of each feature per system as a column; 0 where missing.

    One conditional ``max_by`` per feature: a single aggregation, no pivot job to
    find the names.
    """
    columns = []
    for name in FEATURES:
        mine = F.col("name") == name
        value = F.max_by(F.when(mine, F.col("value")), F.when(mine, F.struct("ts", "id")))
        columns.append((F.coalesce(value, F.lit(0.0)) / FRACTIONS.get(name, 1.0)).alias(name))
    return metrics.groupBy(*by).agg(*columns)


def timeseries_points(metrics: DataFrame, points_per_row: int = 10_000) -> DataFrame:
    """Ordered ``(ts, value)`` points per series, in parts of bounded size."""
    numbered = ordered.running(
        metrics.select("system_id", "name", "ts", "id", "value"), ["system_id", "name"], ["ts", "id"],
        ordered.row_chunks("ts"), position=ordered.row_number(),
    )
    part = F.floor((F.col("position") - 1) / F.lit(points_per_row)).cast("long")
    points = F.array_sort(F.collect_list(F.struct("position", "ts", "value")))
    return numbered.groupBy("system_id", "name", part.alias("part")).agg(
        F.transform(points, lambda p: F.struct(p["ts"], p["value"])).alias("points")
    )


def ds_y_frame(metrics: DataFrame) -> DataFrame:
    return metrics.select("system_id", "name", F.col("ts").alias("ds"), F.col("value").alias("y"))


def clean_series(metrics: DataFrame, keys: Sequence[str] = ("system_id", "name")) -> DataFrame:
    """Fill missing values forward, then clip to the quartiles -/+ 1.5 ranges."""
    keys = list(keys)
    filled = ordered.running(
        metrics, keys, ["ts", "id"], ordered.row_chunks("ts"), filled=ordered.last_known(F.col("value"))
    )
    quartiles = quantiles.exact_percentiles(metrics, keys, "value", {"q1": 0.25, "q3": 0.75})
    width = F.col("q3") - F.col("q1")
    clipped = F.least(F.greatest(F.col("filled"), F.col("q1") - 1.5 * width), F.col("q3") + 1.5 * width)
    return filled.join(quartiles, keys, "left").withColumn(
        "cleaned", F.when(F.col("filled").isNotNull(), clipped)
    ).drop("q1", "q3")


def normalize_series(metrics: DataFrame, keys: Sequence[str] = ("system_id", "name"), method: str = "zscore") -> DataFrame:
    """Z-score or min-max scaling per series; a constant series becomes 0.

    The statistics are aggregated and joined, rather than taken over a window
    that would hold a whole series in one task.
    """
    keys = list(keys)
    stats = metrics.groupBy(*keys).agg(
        F.avg("value").alias("__mean"), F.stddev_pop("value").alias("__std"),
        F.min("value").alias("__min"), F.max("value").alias("__max"),
    )
    if method == "zscore":
        scaled = F.try_divide(F.col("value") - F.col("__mean"), F.col("__std"))
    else:
        scaled = F.try_divide(F.col("value") - F.col("__min"), F.col("__max") - F.col("__min"))
    out = metrics.join(stats, keys).withColumn("normalized", F.coalesce(scaled, F.lit(0.0)))
    return out.drop("__mean", "__std", "__min", "__max")


def _hours(as_of: Column, ts: str = "ts") -> Column:
    return F.timestamp_diff("MICROSECOND", as_of, F.col(ts)) / F.lit(3.6e9)


def engineer_features(metrics: DataFrame, as_of: Column, keys: Sequence[str] = ("name",)) -> DataFrame:
    """Trend (slope per hour), seasonality (spread of hourly means over deviation), volatility."""
    keys = list(keys)
    steps = ordered.running(
        metrics, keys, ["ts", "id"], ordered.row_chunks("ts"), before=ordered.previous(F.col("value"))
    )
    basic = steps.groupBy(*keys).agg(
        F.regr_slope("value", _hours(as_of)).alias("trend"), F.stddev_pop("value").alias("__std"),
        F.stddev_pop(F.col("value") - F.col("before")).alias("volatility"),
    )
    by_hour = metrics.groupBy(*keys, F.hour("ts").alias("h")).agg(F.avg("value").alias("m"))
    spread = by_hour.groupBy(*keys).agg((F.max("m") - F.min("m")).alias("__spread"))
    return basic.join(spread, keys).select(
        *keys, "trend", F.coalesce(F.try_divide(F.col("__spread"), F.col("__std")), F.lit(0.0)).alias("seasonality"),
        "volatility",
    )


def train_test_split(df: DataFrame, id_column: str, test_share: float = 0.2) -> DataFrame:
    """Mark test rows by a hash of the id, so that reruns and retries agree."""
    return df.withColumn("is_test", hash_fraction(F.col(id_column).cast("string")) < test_share)


def standardize(df: DataFrame, columns: Sequence[str], train: Column) -> DataFrame:
    """Scale by the mean and population deviation of the training rows."""
    aggs = []
    for c in columns:
        value = F.when(train, F.col(c))
        aggs += [F.avg(value).alias(f"m_{c}"), F.stddev_pop(value).alias(f"s_{c}")]
    stats = df.agg(F.struct(*aggs)).scalar()
    scaled = {
        f"{c}_scaled": F.coalesce(F.try_divide(F.col(c) - F.col("__st")[f"m_{c}"], F.col("__st")[f"s_{c}"]), F.lit(0.0))
        for c in columns
    }
    return df.withColumn("__st", stats).withColumns(scaled).drop("__st")


def anomaly_stat(
    metrics: DataFrame, sensitivity: float = 0.8, window_hours: int = 24, keys: Sequence[str] = ("system_id", "name"),
) -> DataFrame:
    """Deviation from the trailing window, excluding the sample itself.

    A sample is an anomaly when its z-score exceeds ``4 - 2.5 * sensitivity``.
    Values are centred on the mean of their series, so that sums of squares keep
    their precision; a window whose deviation is below a millionth of the
    deviation of the series counts as constant.  Nulls and NaN count as no samples.
    """
    if not 0.1 <= sensitivity <= 1.0:
        raise ValueError("sensitivity must be between 0.1 and 1")
    keys = list(keys)
    known = F.when(~F.isnan("value"), F.col("value"))
    stats = metrics.groupBy(*keys).agg(
        F.coalesce(F.avg(known), F.lit(0.0)).alias("__mean"), F.coalesce(F.var_pop(known), F.lit(0.0)).alias("__var")
    )
    x = known - F.col("__mean")
    # the samples of a few series are not dealt by series, which would be a task each
    _, stats = measured(stats, BROADCAST_SERIES)
    sums = ordered.trailing_sums(
        metrics.join(stats, keys), keys, "ts", window_hours * 3600, False,
        n_before=F.when(known.isNotNull(), 1).otherwise(0).cast("long"),
        __sx=F.coalesce(x, F.lit(0.0)), __sxx=F.coalesce(x * x, F.lit(0.0)),
    )
    n = F.when(F.col("n_before") > 0, F.col("n_before"))
    mean = F.col("__sx") / n
    variance = F.col("__sxx") / n - mean * mean
    deviation = F.when(variance > F.col("__var") * 1e-12, F.sqrt(variance))
    return sums.withColumns(
        {
            "n_before": F.coalesce("n_before", F.lit(0)), "expected_value": mean + F.col("__mean"),
            "z": (known - F.col("__mean") - mean) / deviation,
        }
    ).withColumns(
        {
            "score": F.least(F.lit(1.0), F.abs(F.col("z")) / 6),
            "is_anomaly": F.coalesce(F.abs(F.col("z")) > 4 - 2.5 * sensitivity, F.lit(False)),
        }
    ).drop("__sx", "__sxx", "__mean", "__var")


def forecast_linear(metrics: DataFrame, as_of: Column, horizon: int = 12, keys: Sequence[str] = ("name",)) -> DataFrame:
    """Hourly forecast: line plus mean residual of the hour of day, bounds +/- 1.96 deviations.

    The fit is an aggregation per series.  Sums per hour of day follow from the
    same line, so the residuals need no second pass over the samples.
    """
    keys = list(keys)
    x, y = _hours(as_of), F.col("value")
    cells = metrics.groupBy(*keys, F.hour("ts").alias("h")).agg(
        F.count(y).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"),
    )
    fit = metrics.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"), F.count(y).alias("n"),
    )
    fit = fit.withColumn(
        "sigma", F.sqrt(F.greatest(F.lit(0.0), F.col("syy") - F.col("slope") * F.col("sxy")) / F.col("n"))
    ).select(*keys, "slope", "intercept", "sigma")
    seasonal = cells.join(fit, keys).withColumn(
        "residual", (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n") - F.col("intercept")
    ).select(*keys, "h", "residual")
    ahead = fit.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("i"))
    step = F.make_dt_interval(F.lit(0), F.col("i"), F.lit(0), F.lit(0).cast("decimal(18,6)"))
    ahead = ahead.withColumn("ts", as_of + step).withColumn("h", F.hour("ts"))
    value = F.col("intercept") + F.col("slope") * F.col("i") + F.coalesce("residual", F.lit(0.0))
    return ahead.join(seasonal, [*keys, "h"], "left").withColumn("predicted_value", value).select(
        *keys, "i", "ts", "predicted_value",
        (F.col("predicted_value") - 1.96 * F.col("sigma")).alias("lower_bound"),
        (F.col("predicted_value") + 1.96 * F.col("sigma")).alias("upper_bound"),
    )


def trend_analysis(metrics: DataFrame, as_of: Column, keys: Sequence[str] = ("system_id", "name")) -> DataFrame:
    x = _hours(as_of)
    return metrics.groupBy(*keys).agg(
        F.regr_slope("value", x).alias("slope"), F.regr_intercept("value", x).alias("intercept"),
        F.regr_r2("value", x).alias("r2"), F.count("value").alias("n"),
    )


def capacity_eta(metrics: DataFrame, limits: dict[str, float], as_of: Column, keys: Sequence[str] = ("system_id", "name")) -> DataFrame:
    """Hours from ``as_of`` until the trend of a series reaches the limit of its metric."""
    limit = None
    for name, value in limits.items():
        hit = F.col("name") == name
        limit = F.when(hit, F.lit(float(value))) if limit is None else limit.when(hit, F.lit(float(value)))
    fit = trend_analysis(metrics.where(F.col("name").isin(*limits)), as_of, keys).withColumn("limit", limit)
    eta = F.when(F.col("slope") > 0, (F.col("limit") - F.col("intercept")) / F.col("slope"))
    return fit.withColumn("eta_hours", eta)


def resource_optimization(metrics: DataFrame, names: Sequence[str], keys: Sequence[str] = ("system_id", "name")) -> DataFrame:
    """Size advice from the 95th percentile of utilisation."""
    used = metrics.where(F.col("name").isin(*names))
    p = quantiles.exact_percentiles(used, keys, "value", {"p95": 0.95})
    advice = F.when(F.col("p95") < 30, "downsize").when(F.col("p95") > 80, "upsize").otherwise("keep")
    return p.withColumn("advice", advice)


def feature_importance(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Features ranked by the size of their correlation with the label."""
    wide = df.agg(*[F.corr(c, label).alias(c) for c in features])
    rows = F.array(*[F.struct(F.lit(c).alias("feature_name"), F.coalesce(F.abs(F.col(c)), F.lit(0.0)).alias("importance")) for c in features])
    # a dozen features: sorted inside one row
    ranked = F.array_sort(
        rows,
        lambda a, b: F.when(a["importance"] > b["importance"], -1).when(a["importance"] < b["importance"], 1)
        .when(a["feature_name"] < b["feature_name"], -1).otherwise(1),
    )
    return wide.select(F.posexplode(ranked).alias("p", "f")).select(
        "f.feature_name", "f.importance", (F.col("p") + 1).alias("rank")
    )


def failure_features(metrics: DataFrame, grid: str = "day") -> DataFrame:
    """Training rows: the features of each system and day, with the failure label."""
    daily = metrics.withColumn("day", F.date_trunc(grid, F.col("ts")).cast("timestamp_ntz"))
    return features_wide(daily, ["system_id", "day"]).withColumn("label", failure_label())


def assemble(df: DataFrame, columns: Sequence[str] = FEATURES, output: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(columns), outputCol=output).transform(df)


def train_random_forest(train: DataFrame, trees: int = 100, depth: int = 10, seed: int = 42):
    from pyspark.ml.classification import RandomForestClassifier

    forest = RandomForestClassifier(
        featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed
    )
    return forest.fit(assemble(train))


def forest_nodes(spark: SparkSession, path: str) -> DataFrame:
    """``tree, node, feature, cut, lower, upper, label, share``: a saved forest as a table, a row per node and label.

    A row goes to ``lower`` where its feature is at most ``cut``, else to ``upper``; leaves have no feature.  ``share``
    is the share of a node's training weight that has the label; the probability of a label is the mean of the
    shares of the leaves a row reaches.  Node 0 is the root of each tree.  Features must be continuous.
    """
    n = F.col("nodeData")
    inner = n["leftChild"] >= 0
    nodes = spark.read.parquet(f"{path.rstrip('/')}/data").select(
        F.col("treeID").alias("tree"), n["id"].alias("node"), F.when(inner, n["split"]["featureIndex"]).alias("feature"),
        F.when(inner, F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0))).alias("cut"),
        F.when(inner, n["leftChild"]).alias("lower"), F.when(inner, n["rightChild"]).alias("upper"), n["impurityStats"].alias("stats"),
    )
    total = F.aggregate("stats", F.lit(0.0), lambda x, y: x + y)
    return nodes.select(
        "tree", "node", "feature", "cut", "lower", "upper", total.alias("total"), F.posexplode("stats").alias("label", "held")
    ).withColumn("share", F.col("held") / F.col("total")).drop("held", "total")


def forest_importance(model, train: DataFrame, columns: Sequence[str] = FEATURES) -> DataFrame:
    """Importances of a fitted forest, one row per feature."""
    weights = [float(w) for w in model.featureImportances.toArray()]
    ranked = sorted(zip(columns, weights), key=lambda c: (-c[1], c[0]))
    rows = [(name, weight, rank) for rank, (name, weight) in enumerate(ranked, 1)]
    return train.sparkSession.createDataFrame(rows, "feature_name string, importance double, rank int")


def retrain_all(data: DataFrame, trainers: dict[str, object], id_column: str, test_share: float = 0.2) -> DataFrame:
    """Fit each model on the training share and measure it on the rows held out; a row per model.

    The scaler is fitted once, on the training rows alone.  Precision, recall and F1 are means over the
    labels, weighted by their rows.  The loop is over a handful of model kinds; each fit is a
    distributed job, and a failing one does not stop the others.  Only the counts of (label,
    prediction) come to the driver.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler

    split = assemble(train_test_split(data, id_column, test_share), output="raw_features")
    train, test = split.where(~F.col("is_test")), split.where("is_test")
    rows, scaler = [], None
    for name, estimator in trainers.items():
        try:
            if scaler is None:
                scaler = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True).fit(train)
            model = Pipeline(stages=[scaler, estimator]).fit(train)
            pairs = model.transform(test).groupBy("label", "prediction").count().collect()
            counts = {(float(r["label"]), float(r["prediction"])): r["count"] for r in pairs}
            rows.append((name, "success", *held_out_metrics(counts), sum(counts.values()), None))
        except Exception as failure:  # noqa: BLE001
            rows.append((name, "failed", None, None, None, None, None, type(failure).__name__))
    return data.sparkSession.createDataFrame(
        rows, "model_name string, status string, accuracy double, precision double, recall double, f1 double, "
        "test_rows long, error string"
    )


def held_out_metrics(counts: dict[tuple[float, float], int]) -> tuple[float | None, ...]:
    """Accuracy and weighted precision, recall and F1 from counts of (label, prediction); None without rows."""
    total = sum(counts.values())
    if not total:
        return None, None, None, None
    precision = recall = f1 = 0.0
    for label in {at[0] for at in counts}:
        right = counts.get((label, label), 0)
        of_label = sum(n for (y, _), n in counts.items() if y == label)
        as_label = sum(n for (_, y), n in counts.items() if y == label)
        p, r = right / as_label if as_label else 0.0, right / of_label
        share = of_label / total
        precision, recall = precision + share * p, recall + share * r
        f1 += share * (2 * p * r / (p + r) if right else 0.0)
    return sum(n for (y, z), n in counts.items() if y == z) / total, precision, recall, f1


# --- isolation forest -----------------------------------------------------

EULER = 0.5772156649


def _average_path(n: int) -> float:
    """Mean path length of an unsuccessful search among ``n`` points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


def _grow(x: np.ndarray, rng: np.random.Generator, depth: int, limit: int, nodes: list) -> int:
    """Append the nodes of an isolation tree on ``x``; return the root's index."""
    here = len(nodes)
    spread = np.ptp(x, axis=0) if len(x) else np.zeros(0)
    usable = np.flatnonzero(spread > 0)
    if depth >= limit or len(x) <= 1 or len(usable) == 0:
        nodes.append([-1, depth + _average_path(len(x)), -1, -1])
        return here
    feature = int(rng.choice(usable))
    cut = float(rng.uniform(x[:, feature].min(), x[:, feature].max()))
    nodes.append([feature, cut, -1, -1])
    left = x[:, feature] < cut
    nodes[here][2] = _grow(x[left], rng, depth + 1, limit, nodes)
    nodes[here][3] = _grow(x[~left], rng, depth + 1, limit, nodes)
    return here


def _path_lengths(x: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), dtype=int)
    while True:
        inner = nodes[at, 0] >= 0
        if not inner.any():
            return nodes[at, 1]
        rows = np.flatnonzero(inner)
        node = nodes[at[rows]]
        goes_left = x[rows, node[:, 0].astype(int)] < node[:, 1]
        at[rows] = np.where(goes_left, node[:, 2], node[:, 3]).astype(int)


def _uniform(ids: Column, seed: int, *salt: Column) -> Column:
    return F.xxhash64(ids, *salt, F.lit(seed)).bitwiseAND(F.lit(2**52 - 1)) / F.lit(float(2**52))


def _pool(
    df: DataFrame, columns: Sequence[str], id_column: str, trees: int, seed: int, subsample: int
) -> tuple[DataFrame, int]:
    """About ``4 * subsample * trees`` rows drawn by a hash of the id, or all, and the number of rows."""
    total = df.select(F.count(F.lit(1))).scalar()
    share = F.lit(float(4 * subsample * trees)) / F.greatest(total, F.lit(1))
    return df.select(id_column, *columns).where(_uniform(F.col(id_column).cast("string"), seed, F.lit("pool")) < share), total


def grow_forest(
    df: DataFrame, columns: Sequence[str], id_column: str, trees: int = 100, seed: int = 42, subsample: int = 256
) -> DataFrame:
    """Isolation trees, one row each, grown in parallel on hash samples of ``subsample`` rows.

    A pool of rows is drawn first, by a hash of the id, so that only about
    ``4 * subsample * trees`` rows are ever multiplied by the number of trees.
    Each tree takes the ``subsample`` rows of the pool with the smallest hashes for it; the
    limit per tree is applied before the rows are grouped.
    """
    columns = list(columns)
    pool, total = _pool(df, columns, id_column, trees, seed, subsample)
    share = F.lit(4.0 * subsample) / F.least(F.greatest(total, F.lit(1)), F.lit(float(4 * subsample * trees)))
    drawn = (
        pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
        .withColumn("__u", _uniform(F.col(id_column).cast("string"), seed, F.col("tree"))).where(F.col("__u") < share)
    )
    smallest = Window.partitionBy("tree").orderBy("__u", id_column)
    sample = drawn.withColumn("__r", F.row_number().over(smallest)).where(F.col("__r") <= subsample)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rows = pdf.sort_values("__r")[columns].to_numpy(dtype=float)
        nodes: list = []
        limit = int(np.ceil(np.log2(max(2, len(rows)))))
        _grow(rows, np.random.default_rng(seed + tree), 0, limit, nodes)
        return pd.DataFrame({"tree": [tree], "size": [len(rows)], "nodes": [json.dumps(nodes)]})

    return sample.groupBy("tree").applyInPandas(grow, "tree int, size int, nodes string")


def isolation_nodes(forest: DataFrame) -> DataFrame:
    """``tree, size, node, feature, cut, lower, upper, path``: grown trees as a table, a row per node.

    A row goes to ``lower`` where its feature is below ``cut``, else to ``upper``; a leaf has no feature and gives the
    ``path`` length.  Node 0 is the root.
    """
    rows = forest.select("tree", "size", F.posexplode(F.from_json("nodes", "array<array<double>>")).alias("node", "at"))
    inner, at = F.col("at")[0] >= 0, F.col("at")
    return rows.select(
        "tree", "size", "node", F.when(inner, at[0].cast("int")).alias("feature"), F.when(inner, at[1]).alias("cut"),
        F.when(inner, at[2].cast("int")).alias("lower"), F.when(inner, at[3].cast("int")).alias("upper"), F.when(~inner, at[1]).alias("path"),
    )


def isolation_score(
    df: DataFrame, columns: Sequence[str], id_column: str, contamination: float = 0.1,
    trees: int = 100, seed: int = 42, error: float = 0.001, subsample: int = 256, forest: DataFrame | None = None,
) -> DataFrame:
    """Anomaly score and flag of each row.

    ``score`` is offset so that about ``contamination`` of the rows lie below 0.
    Trees are grown on ``subsample`` rows each, the size the method is defined by, or given as ``forest``; every row is
    scored, once.  The offset comes from the pool of rows trees are drawn from, which is all rows of a small table.
    The forest is at most ``trees`` x (2 x ``subsample`` - 1) nodes whatever the size of the data, so
    it is sent to the tasks with the scoring function.
    """
    columns = list(columns)
    given = grow_forest(df, columns, id_column, trees, seed, subsample) if forest is None else forest
    grown = [(r["size"], np.array(json.loads(r["nodes"]), dtype=float)) for r in given.toLocalIterator()]
    scale = _average_path(max((size for size, _ in grown), default=1)) or 1.0

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns])
            mean = np.mean([_path_lengths(x, nodes) for _, nodes in grown], axis=0)
            arrays = [*batch.columns, pa.array(-np.power(2.0, -mean / scale))]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "raw"])

    def scored(rows: DataFrame) -> DataFrame:
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        return rows.mapInArrow(score, f"{fields}, raw double")

    pool, _ = _pool(df, columns, id_column, trees, seed, subsample)
    offset = scored(pool).select(F.approx_percentile("raw", contamination, int(1 / error))).scalar()
    return scored(df).withColumn("score", F.col("raw") - offset).withColumn("is_anomaly", F.col("score") < 0).drop("raw")


def score_batch(outputs: DataFrame, features: DataFrame, as_of: Column) -> DataFrame:
    """Failure response per request: ensemble, risk, time, factors and advice.

    An isolation forest answers -1 or 1; as a probability that is 1 or 0.
    """
    as_probability = F.when(
        F.col("model_name") == "isolation_forest", F.when(F.col("probability") < 0, 1.0).otherwise(0.0)
    ).otherwise(F.col("probability"))
    ensemble = ensemble_probability(
        outputs.withColumn("probability", as_probability), ["request_id", "system_id"]
    )
    p = F.col("probability")
    return ensemble.join(features, "system_id", "left").withColumns(
        {
            "risk_level": risk_level(p), "predicted_failure_time": failure_time(p, as_of),
            "contributing_factors": contributing_factors(), "recommendations": recommendations(p),
        }
    ).drop(*FEATURES)
