"""Aggregations over streams."""

from .monthly import monthly_counts

__all__ = ["monthly_counts"]
