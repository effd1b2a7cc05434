"""Label maps: canonical text, decoding and overlaying."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidewatch.functions.times import to_wall

MAP_TYPE = "map<string,string>"


def decode_labels(text: Column) -> Column:
    return F.from_json(text, MAP_TYPE)


def encode_labels(labels: Column) -> Column:
    """JSON with sorted keys; a null map becomes the text ``null``.

    Sorted keys make the text usable as a grouping key, which a map is not, and
    unlabelled points then conflict with each other on upsert.
    """
    ordered = F.map_from_entries(F.array_sort(F.map_entries(labels)))
    return F.coalesce(F.to_json(ordered), F.lit("null"))


def combine_labels(metric_labels: Column, rule_labels: Column) -> Column:
    """Metric labels overlaid by rule labels."""
    empty = F.create_map().cast(MAP_TYPE)
    return F.map_zip_with(
        F.coalesce(metric_labels, empty),
        F.coalesce(rule_labels, empty),
        lambda _, metric, rule: F.coalesce(rule, metric),
    )


def utc_timestamp(text: Column) -> Column:
    """RFC 3339 text to a UTC wall-clock timestamp whatever the session zone."""
    return to_wall(F.try_to_timestamp(text))
