"""Index objects: the values of index columns in row order, to slice, filter and expand.

Nothing is evaluated before ``expand`` is run or ``evaluate`` is called.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession

from . import index
from .frame import Frame
from .series import Series


class Index:
    """Values of one or more named columns, in the order of ``order``."""

    def __init__(self, df: DataFrame, names: str | Sequence[str], order: Sequence[str] | None = None):
        self.names = (names,) if isinstance(names, str) else tuple(names)
        self.frame = Frame(df, (), self.names if order is None else order)

    def _new(self, frame: Frame) -> Index:
        return Index(frame.df, self.names, frame.order)

    def values(self, name: str | None = None) -> Series:
        """A column of the index, to build a filter of."""
        return self.frame[name or self.names[0]]

    def __getitem__(self, item) -> Index:
        """Rows [start, stop) by a slice, or the rows that a boolean series of ``values`` marks."""
        if isinstance(item, slice):
            return self._new(self.frame.slice(item.start, item.stop, item.step))
        if isinstance(item, (Series, Column)):
            return self._new(self.frame.filter(item))
        raise TypeError(f"an index is cut by a slice or a boolean series, not by {type(item).__name__}")

    def head(self, n: int = 10) -> Index:
        return self._new(self.frame.head(n))

    def expand(self) -> DataFrame:
        """The values as columns."""
        return self.frame.df.select(*self.names)

    def evaluate(self):
        """The values as pandas, in order."""
        return self.frame.evaluate()[list(self.names)]

    def __len__(self) -> int:
        return len(self.frame)

    def __repr__(self) -> str:
        return f"{type(self).__name__}(names={list(self.names)})"


class RangeIndex(Index):
    """start, start + step, .. before stop; slices of it are ranges again and read nothing."""

    def __init__(self, spark: SparkSession, start: int, stop: int, step: int = 1, name: str = "Index"):
        if step < 1:
            raise ValueError("the step of a range index is positive")
        self.spark, self.range = spark, range(start, stop, step)
        super().__init__(index.range_index(spark, start, stop, step, name), name)

    def __getitem__(self, item) -> Index:
        if not isinstance(item, slice):
            return super().__getitem__(item)
        if (item.start or 0) < 0 or (item.stop or 0) < 0 or (item.step is not None and item.step < 1):
            raise ValueError("bounds of a slice count from the start")
        cut = self.range[item]
        return RangeIndex(self.spark, cut.start, cut.stop, cut.step, self.names[0])

    def head(self, n: int = 10) -> Index:
        return self[:n]

    def __len__(self) -> int:
        return len(self.range)


class MultiIndex:
    """Label columns ``<name>_label`` in row order, and the levels (value, label) of each name.

    A slice, a filter and ``head`` cut the labels alone; levels stay whole, so
    that every label keeps its value.
    """

    def __init__(self, levels: Mapping[str, DataFrame], labels: Frame):
        self.levels, self.labels = dict(levels), labels

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(self.levels)

    @classmethod
    def from_product(cls, spark: SparkSession, levels: Mapping[str, Sequence]) -> MultiIndex:
        """Every combination of the values given, the first name varying slowest."""
        names = list(levels)
        if not prod(len(levels[n]) for n in names):
            raise ValueError("every level of a product needs a value")
        grid = index.cartesian_indices(spark, [len(levels[n]) for n in names])
        labels = grid.withColumnsRenamed({f"i{k}": f"{n}_label" for k, n in enumerate(names)})
        tables = {n: spark.createDataFrame([(v, i) for i, v in enumerate(levels[n])], [n, "label"]) for n in names}
        return cls(tables, Frame(labels, (), ("pos",)))

    @classmethod
    def from_arrays(cls, df: DataFrame, names: Sequence[str], order: Sequence[str]) -> MultiIndex:
        """Of columns that hold the values of each row; ``order`` columns order the rows.

        A null value has a null label and is null again when expanded.
        """
        coded, levels = index.from_arrays(df, names)
        extra = [c for c in order if c not in names]
        kept = Frame(coded.select(*extra, *[f"{n}_label" for n in names]), (), [f"{c}_label" if c in names else c for c in order])
        return cls(levels, kept)

    def values(self, name: str) -> Series:
        """The labels of a name, to build a filter of."""
        return self.labels[f"{name}_label"]

    def __getitem__(self, item) -> MultiIndex:
        if not isinstance(item, (slice, Series, Column)):
            raise TypeError(f"an index is cut by a slice or a boolean series, not by {type(item).__name__}")
        return MultiIndex(self.levels, self.labels[item])

    def head(self, n: int = 10) -> MultiIndex:
        return MultiIndex(self.levels, self.labels.head(n))

    def expand(self) -> DataFrame:
        """The order columns that are no labels, and the values of every row."""
        df = self.labels.df
        for n in self.names:
            df = index.decode(df, self.levels[n], n, f"{n}_label")
        return df.drop(*[f"{n}_label" for n in self.names])

    def evaluate(self):
        """The values as pandas, in order."""
        df = self.labels.df
        for n in self.names:
            df = index.decode(df, self.levels[n], n, f"{n}_label")
        return Frame(df, (), self.labels.order).evaluate()[list(self.names)]

    def __len__(self) -> int:
        return len(self.labels)

    def __repr__(self) -> str:
        return f"MultiIndex(names={list(self.names)})"
