"""Grouped frames: partial and final hash aggregation of every other column."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .series import aggregate

if TYPE_CHECKING:
    from .frame import Frame


class GroupedFrame:
    def __init__(self, frame: Frame, by: list[str]):
        self.frame, self.by = frame, by
        self.columns = [c for c in frame.columns if c not in by]

    def _agg(self, name: str, keep_type: bool) -> Frame:
        from .frame import Frame

        df = self.frame.df
        if not self.columns:  # nothing but keys: the distinct keys
            return Frame(df.select(*self.by).distinct(), self.by, self.by, self.frame.coerce)
        out = []
        for c in self.columns:
            kind = df.schema[c].dataType
            if not isinstance(kind, T.NumericType) and name not in ("min", "max", "count"):
                raise TypeError(f"{name} of column {c} of type {kind.simpleString()}")
            a = aggregate(name, F.col(f"`{c}`"))
            whole = isinstance(kind, T.IntegralType) and name in ("sum", "prod")  # bigint and double: no overflow of narrow columns
            out.append((a.cast(kind) if keep_type and not whole else a).alias(c))
        return Frame(df.groupBy(*self.by).agg(*out), self.by, self.by, self.frame.coerce)

    def sum(self) -> Frame:
        return self._agg("sum", True)

    def prod(self) -> Frame:
        return self._agg("prod", True)

    def min(self) -> Frame:
        return self._agg("min", True)

    def max(self) -> Frame:
        return self._agg("max", True)

    def mean(self) -> Frame:
        return self._agg("mean", False)

    def count(self) -> Frame:
        return self._agg("count", False)

    def std(self) -> Frame:
        return self._agg("std", False)
