"""Alert conditions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def alert_condition(value: Column, operator: Column, threshold: Column) -> Column:
    """``value operator threshold`` with the operator given by text; unknown is false.

    Spark orders NaN above every number and equal to itself.  Alert rules use
    IEEE comparison, where only ``ne`` holds for NaN.
    """
    nan = F.isnan(value) | F.isnan(threshold)
    holds = (
        F.when(operator.isin("gt", ">"), value > threshold)
        .when(operator.isin("gte", ">="), value >= threshold)
        .when(operator.isin("lt", "<"), value < threshold)
        .when(operator.isin("lte", "<="), value <= threshold)
        .when(operator.isin("eq", "=="), value == threshold)
        .when(operator.isin("ne", "!="), value != threshold)
        .otherwise(False)
    )
    return F.coalesce(F.when(nan, operator.isin("ne", "!=")).otherwise(holds), F.lit(False))


def reasons(*checks: tuple[str, Column]) -> Column:
    """Codes of the checks that hold, as an array in the order given."""
    return F.array_compact(F.array(*[F.when(bad, F.lit(code)) for code, bad in checks]))
