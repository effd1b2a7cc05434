"""Operators over the monitoring tables."""
