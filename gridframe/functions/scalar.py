"""Scalar functions, all built from expressions that Catalyst compiles."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def _col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def abs_diff(a: ColumnLike, b: ColumnLike) -> Column:
    """Absolute difference."""
    return F.abs(_col(a) - _col(b))


def near(a: ColumnLike, b: ColumnLike | float, tolerance: float = 1.5e-8) -> Column:
    """Whether two doubles differ by less than the tolerance."""
    other = F.lit(float(b)) if isinstance(b, (int, float)) else _col(b)
    return F.abs(_col(a).cast("double") - other) < F.lit(tolerance)


def days_to_date(days: ColumnLike, origin: str = "1950-01-01") -> Column:
    """Date of a number of days since an origin."""
    return F.date_add(F.lit(origin).cast("date"), _col(days).cast("int"))


def date_text(date: ColumnLike) -> Column:
    """A date as ``yyyy-MM-dd``."""
    return F.date_format(_col(date), "yyyy-MM-dd")


def year_month(date: ColumnLike, as_int: bool = False) -> Column:
    """Month of a date: ``yyyyMM`` as text, or year * 100 + month."""
    c = _col(date)
    return F.year(c) * 100 + F.month(c) if as_int else F.date_format(c, "yyyyMM")


def scale(raw: ColumnLike, factor: float, kind: str = "float") -> Column:
    """Packed value times its scale factor, in single precision by default."""
    return (_col(raw).cast(kind) * F.lit(factor).cast(kind)).cast(kind)


def relabel(c: ColumnLike, names: Mapping[str, str]) -> Column:
    """Replace labels that have a new name; others stay."""
    out = _col(c)
    for old, new in names.items():
        out = F.when(_col(c) == old, F.lit(new)).otherwise(out)
    return out
