"""Validation: an array of reason codes per row, empty when the row is valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.conditions import reasons


def _outside(column: str, low: float, high: float) -> Column:
    return F.col(column).isNull() | ~F.col(column).between(F.lit(low), F.lit(high))


def validate_metric_points(points: DataFrame, as_of: Column) -> DataFrame:
    return points.withColumn(
        "reasons",
        reasons(
            ("timestamp in the future", F.col("ts") > as_of),
            ("no name", F.col("name").isNull() | (F.col("name") == "")),
            ("no value", F.col("value").isNull()),
        ),
    )


def validate_requests(requests: DataFrame) -> DataFrame:
    """Fixed bounds of prediction, anomaly, batch and training requests."""
    return requests.withColumn(
        "reasons",
        reasons(
            ("no metrics", F.col("n_metrics") < 1),
            ("time_horizon", _outside("time_horizon", 1, 168)),
            ("confidence_threshold", _outside("confidence_threshold", 0.0, 1.0)),
            ("sensitivity", _outside("sensitivity", 0.1, 1.0)),
            ("batch_size", _outside("batch_size", 1, 100)),
            ("priority", _outside("priority", 1, 10)),
            ("test_split", _outside("test_split", 0.1, 0.5)),
        ),
    )


def validate_series_lengths(df: DataFrame, timestamps: str, values: str) -> DataFrame:
    return df.withColumn("valid", F.size(timestamps) == F.size(values))


def validate_ranges_out(df: DataFrame, unit_columns: list[str], percent_columns: list[str]) -> DataFrame:
    """Scores within [0, 1], progress within 0..100."""
    checks = [(c, _outside(c, 0.0, 1.0)) for c in unit_columns]
    checks += [(c, _outside(c, 0, 100)) for c in percent_columns]
    return df.withColumn("reasons", reasons(*checks))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without reasons, and the others."""
    bad = F.size("reasons") > 0
    return df.where(~bad).drop("reasons"), df.where(bad)
