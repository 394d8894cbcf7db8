"""The frame: a Spark DataFrame with named index columns and an explicit row order.

Frames are immutable; every operation extends one logical plan, so a filter, a
slice or a dropped column reaches the scan through Catalyst.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import positional
from .series import Series, aggregate, arithmetic, literal

NUMERIC = (T.NumericType,)


class Frame:
    """Data columns beside index columns; ``order`` names the columns that order rows."""

    def __init__(self, df: DataFrame, index: Sequence[str] = (), order: Sequence[str] | None = None, coerce: str = "column"):
        self.df, self.index = df, tuple(index)
        self.order = tuple(order if order is not None else index)
        self.coerce = coerce

    def _new(self, df: DataFrame, index: Sequence[str] | None = None, order: Sequence[str] | None = None) -> Frame:
        kept = [c for c in (self.order if order is None else order) if c in df.columns]
        whole = len(kept) == len(self.order if order is None else order)
        return Frame(df, self.index if index is None else index, kept if whole else (), self.coerce)

    @property
    def columns(self) -> list[str]:
        """Data columns, without the index."""
        return [c for c in self.df.columns if c not in self.index]

    @property
    def dtypes(self) -> dict[str, str]:
        return {c: k for c, k in self.df.dtypes if c not in self.index}

    def __iter__(self) -> Iterator[str]:
        return iter(self.columns)

    def __len__(self) -> int:
        return self.df.count()

    def __repr__(self) -> str:
        return f"Frame(index={list(self.index)}, columns={self.dtypes})"

    def __str__(self) -> str:
        return self.head(20).evaluate().to_string(index=False)

    # selection

    def series(self, name: str) -> Series:
        return Series(self, F.col(f"`{name}`"), self.df.schema[name].dataType, name, plain=True)

    def __getitem__(self, item) -> Series | Frame:
        if isinstance(item, str):
            return self.series(item)
        if isinstance(item, slice):
            return self.slice(item.start, item.stop, item.step)
        if isinstance(item, list):
            if not all(isinstance(c, str) for c in item):
                raise TypeError("a list of column names is expected")
            return self.select(item)
        if isinstance(item, (Series, Column)):
            return self.filter(item)
        raise TypeError(f"can't select by {type(item).__name__}")

    def select(self, columns: Sequence[str]) -> Frame:
        """Named data columns; the index stays."""
        return self._new(self.df.select(*self.index, *[c for c in columns if c not in self.index]))

    def reading(self, columns: Sequence[str]) -> Frame:
        """A frame that reads no more than the columns, where its source can't see that by itself."""
        return self

    def filter(self, mask: Series | Column) -> Frame:
        if isinstance(mask, Series):
            if not isinstance(mask.kind, T.BooleanType):
                raise ValueError("a filter must be boolean")
            mask = mask.column
        return self._new(self.df.filter(mask))

    def slice(self, start: int | None, stop: int | None, step: int | None = None) -> Frame:
        """Rows [start, stop) of the frame's order."""
        return self._new(positional.slice_rows(self.df, self.order, start, stop, step))

    def head(self, n: int = 10) -> Frame:
        """The first n rows of the result, in order if there is one."""
        return self._new(self._ordered(self.df).limit(n))

    def _ordered(self, df: DataFrame) -> DataFrame:
        return df.orderBy(*self.order) if self.order else df

    def drop(self, columns: str | Sequence[str]) -> Frame:
        """Without the columns; unknown names are ignored."""
        if isinstance(columns, str):
            columns = [columns]
        if not isinstance(columns, (list, tuple)):
            raise TypeError("a column name or a list of them is expected")
        return self._new(self.df.drop(*columns))

    def rename(self, columns: Mapping[str, str]) -> Frame:
        """New names; unknown names are ignored."""
        df = self.df.withColumnsRenamed(dict(columns))
        return self._new(df, [columns.get(c, c) for c in self.index], [columns.get(c, c) for c in self.order])

    # assignment and arithmetic

    def assign(self, name: str, value: Series | Column | object) -> Frame:
        """Add or replace a column: of this frame, or a scalar."""
        if isinstance(value, Series):
            if value.frame.df is not self.df:
                raise ValueError("a series of another frame has no row to go to; merge the frames")
            value = value.column
        elif not isinstance(value, Column):
            value = F.lit(value)
        return self._new(self.df.withColumn(name, value))

    def assign_values(self, name: str, values: Sequence) -> Frame:
        """Add values given in row order (an array of the driver), by row number."""
        rows = positional.with_row_ids(self.df, self.order)
        given = self.df.sparkSession.createDataFrame([(i, v) for i, v in enumerate(values)], [positional.ROW_ID, name])
        return self._new(rows.drop(name).join(given, positional.ROW_ID, "left").drop(positional.ROW_ID))

    def _all(self, op: str, value) -> Frame:
        fields = self.df.schema
        own = [arithmetic(F.col(f"`{c}`"), op, literal(value, fields[c].dataType, self.coerce), fields[c].dataType, self.coerce).alias(c) if isinstance(fields[c].dataType, NUMERIC) else F.col(f"`{c}`") for c in self.columns]
        return self._new(self.df.select(*[c for c in self.df.columns if c not in self.columns], *own))

    def __add__(self, value) -> Frame:
        return self._all("+", value)

    def __sub__(self, value) -> Frame:
        return self._all("-", value)

    def __mul__(self, value) -> Frame:
        return self._all("*", value)

    def __truediv__(self, value) -> Frame:
        return self._all("/", value)

    # joins

    def merge(self, right: Frame, how: str = "inner", suffixes: tuple[str, str] | None = None, on_conflict: str = "error", hint: str | None = None) -> Frame:
        """Join on the index columns, any number of them, duplicates allowed."""
        if not isinstance(right, Frame):
            raise TypeError("a frame can only be merged with a frame")
        if not self.index or len(self.index) != len(right.index):
            raise ValueError("both frames need an index of the same number of columns")
        other = right.df
        for a, b in zip(self.index, right.index, strict=True):
            other = other.withColumnRenamed(b, a)
        left = self.df
        both = [c for c in self.columns if c in other.columns]
        if both and suffixes:
            left = left.withColumnsRenamed({c: c + suffixes[0] for c in both})
            other = other.withColumnsRenamed({c: c + suffixes[1] for c in both})
        elif both and on_conflict == "right":
            left = left.drop(*both)
        elif both:
            raise ValueError(f"columns in both frames: {', '.join(both)}; give suffixes or on_conflict='right'")
        if hint:
            other = other.hint(hint)
        return self._new(left.join(other, list(self.index), how), order=self.order or self.index)

    @staticmethod
    def merge_all(frames: Sequence[Frame], how: str = "inner") -> Frame:
        """Chained merge of any number of frames."""
        out = frames[0]
        for f in frames[1:]:
            out = out.merge(f, how)
        return out

    def append(self, other: Frame) -> Frame:
        """Rows of both, columns matched by name; missing ones are null."""
        return self._new(self.df.unionByName(other.df, allowMissingColumns=True))

    # aggregation

    def _numeric(self) -> list[str]:
        return [c for c in self.columns if isinstance(self.df.schema[c].dataType, NUMERIC)]

    def reduce(self, name: str) -> DataFrame:
        """Rows (column, value) of one aggregate of every numeric column, as double."""
        columns = self._numeric()
        one = self.df.agg(*[aggregate(name, F.col(f"`{c}`")).cast("double").alias(c) for c in columns])
        return one.unpivot([], columns, "column", name)

    def sum(self) -> DataFrame:
        return self.reduce("sum")

    def prod(self) -> DataFrame:
        return self.reduce("prod")

    def min(self) -> DataFrame:
        return self.reduce("min")

    def max(self) -> DataFrame:
        return self.reduce("max")

    def count(self) -> DataFrame:
        return self.reduce("count")

    def mean(self) -> DataFrame:
        return self.reduce("mean")

    def std(self) -> DataFrame:
        return self.reduce("std")

    def agg(self, names: Sequence[str], key: str = "agg") -> DataFrame:
        """One row for each aggregate, one column for each numeric column, in one pass."""
        if not names:
            raise TypeError("at least one aggregate is needed")
        columns = self._numeric()
        one = self.df.agg(*[aggregate(n, F.col(f"`{c}`")).cast("double").alias(f"{n}_{i}") for n in names for i, c in enumerate(columns)])
        rows = [F.struct(F.lit(n).alias(key), *[F.col(f"{n}_{i}").alias(c) for i, c in enumerate(columns)]) for n in names]
        return one.select(F.inline(F.array(*rows)))

    def describe(self, names: Sequence[str] = ("min", "max", "mean", "std"), key: str = "agg") -> DataFrame:
        return self.agg(names, key)

    def groupby(self, by: str | Sequence[str]):
        from .groupby import GroupedFrame

        if isinstance(by, str):
            by = [by]
        if not isinstance(by, (list, tuple)):
            raise TypeError("a column name or a list of them is expected")
        if not by:
            raise ValueError("a group needs a key")
        return GroupedFrame(self, list(by))

    # index

    def set_index(self, columns: Sequence[str]) -> Frame:
        return self._new(self.df.select(*columns, *[c for c in self.df.columns if c not in columns]), columns, columns)

    def reset_index(self, row_id: str | None = None) -> Frame:
        """Index columns become data; optionally number the rows."""
        if row_id is None:
            return self._new(self.df.select(*self.index, *self.columns), ())
        return Frame(positional.with_row_ids(self.df, self.order, row_id), (row_id,), (row_id,), self.coerce)

    # evaluation

    @staticmethod
    def release() -> None:
        """Give back the rows that positional operations hold."""
        positional.release()

    def sort_values(self, by: str | Sequence[str]) -> Frame:
        """The frame with its rows ordered by the columns, ties by the present order."""
        by = [by] if isinstance(by, str) else list(by)
        return self._new(self.df, order=[*by, *[c for c in self.order if c not in by]])

    def cache(self) -> Frame:
        return self._new(self.df.cache())

    def evaluate(self):
        """The frame as pandas, in order; the only time rows come to the driver."""
        return self._ordered(self.df).toPandas()

    def to_grid(self, path: str, form: str = "classic") -> None:
        """Write a small frame as a grid file (``classic`` or ``netcdf4``), its index as dimensions."""
        from ..sources.sink import write_grid

        write_grid(self, path, form)

    def to_csv(self, path: str, sep: str = ",", header: bool = True, index: bool = True, single: bool = True) -> None:
        from ..sources.sink import write_csv

        df = self._ordered(self.df)
        write_csv(df if index else df.drop(*self.index), path, sep, header, single)
