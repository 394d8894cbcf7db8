"""Column functions: dates, comparisons with tolerance, scaling, user functions."""

from .scalar import abs_diff, date_text, days_to_date, near, relabel, scale, year_month
from .udf import map_column, native_column

__all__ = ["abs_diff", "date_text", "days_to_date", "map_column", "native_column", "near", "relabel", "scale", "year_month"]
