"""Between wall-clock UTC timestamps (without zone) and instants, in any session zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def to_instant(wall: Column) -> Column:
    """The instant of a UTC wall-clock time."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), wall).cast("timestamp")


def to_wall(instant: Column) -> Column:
    """The UTC wall-clock time of an instant."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz"))
