"""Identifiers derived from content, so that a retried task makes the same ones."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def entity_id(prefix: str, *columns: str) -> Column:
    text = F.concat_ws(",", *[F.col(c).cast("string") for c in columns])
    return F.concat(F.lit(prefix), F.sha2(text, 256))


def request_hash(nanos: Column, ip: Column) -> Column:
    """First 16 hex digits of the digest of ``nanos-ip``."""
    return F.substring(F.sha2(F.concat_ws("-", nanos.cast("string"), ip), 256), 1, 16)


def client_id(user: Column, ip: Column, style: str = "service") -> Column:
    """Rate-limit key: the user where known, else the address."""
    if style == "gateway":
        return F.coalesce(F.concat(F.lit("user_"), user), ip)
    return F.coalesce(F.concat(F.lit("user:"), user), F.concat(F.lit("ip:"), F.coalesce(ip, F.lit("unknown"))))
