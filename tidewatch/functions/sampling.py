"""Deterministic sampling and splitting by hash."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def hash_fraction(text: Column) -> Column:
    """A number in [0, 1) that depends only on the text."""
    head = F.conv(F.substring(F.md5(text), 1, 4), 16, 10).cast("int")
    return head / F.lit(65536.0)
