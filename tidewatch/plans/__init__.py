"""Registered queries and their DuckDB counterparts."""

from __future__ import annotations

from tidewatch.plans.registry import ORACLES, QUERIES


def load_all() -> None:
    """Import every query module so that the registry is full."""
    from tidewatch.plans import (  # noqa: F401
        aggregates,
        alerting,
        counters,
        joins,
        learning,
        logs,
        ordering,
        platform,
        selection,
        store,
        streams,
    )


__all__ = ["ORACLES", "QUERIES", "load_all"]
