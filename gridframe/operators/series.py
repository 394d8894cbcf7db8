"""A column bound to its frame, with the arithmetic and comparison rules of the engine."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import map_column, native_column

if TYPE_CHECKING:
    from .frame import Frame

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
AGGREGATES = ("sum", "prod", "min", "max", "count", "mean", "std")


def literal(value, kind: T.DataType, coerce: str = "column") -> Column:
    """A scalar as a column: cast to the column's type, or left to promote both.

    The cast makes ``col == -99.99`` hold for a float column, whose stored
    value is not the double nearest to -99.99.
    """
    return F.lit(value).cast(kind) if coerce == "column" else F.lit(value)


def arithmetic(left: Column, op: str, right: Column, kind: T.DataType, coerce: str = "column") -> Column:
    """``left op right`` in the left type; division of integers drops the fraction."""
    if op == "/" and coerce == "column" and isinstance(kind, INTEGERS):
        out = F.call_function("div", left, right)
    else:
        out = {"+": left + right, "-": left - right, "*": left * right, "/": left / right}[op]
    return out.cast(kind) if coerce == "column" else out


def aggregate(name: str, column: Column) -> Column:
    """Aggregate expression; accumulators are double or bigint."""
    if name == "sum":
        return F.sum(column)
    if name == "prod":
        return F.product(column)
    if name == "min":
        return F.min(column)
    if name == "max":
        return F.max(column)
    if name == "count":
        return F.count(F.lit(1))
    if name == "mean":
        return F.avg(column)
    if name == "std":
        return F.stddev_samp(column)
    raise ValueError(f"unknown aggregate {name!r}; known are {', '.join(AGGREGATES)}")


class Series:
    """One column of a frame, unevaluated."""

    def __init__(self, frame: Frame, column: Column, kind: T.DataType, name: str, plain: bool = False):
        self.frame, self.column, self.kind, self.name = frame, column, kind, name
        self.plain = plain  # a column of the frame, not an expression over several

    def _with(self, column: Column, kind: T.DataType | None = None) -> Series:
        return Series(self.frame, column, kind or self.kind, self.name)

    def _other(self, other) -> Column:
        if isinstance(other, Series):
            if other.frame is not self.frame:
                raise ValueError("series of different frames have no common rows; merge the frames")
            return other.column
        return literal(other, self.kind, self.frame.coerce)

    def _compare(self, op: Callable[[Column, Column], Column], other) -> Series:
        return self._with(op(self.column, self._other(other)), T.BooleanType())

    def __lt__(self, other) -> Series:
        return self._compare(lambda a, b: a < b, other)

    def __le__(self, other) -> Series:
        return self._compare(lambda a, b: a <= b, other)

    def __eq__(self, other) -> Series:  # type: ignore[override]
        return self._compare(lambda a, b: a == b, other)

    def __ne__(self, other) -> Series:  # type: ignore[override]
        return self._compare(lambda a, b: a != b, other)

    def __ge__(self, other) -> Series:
        return self._compare(lambda a, b: a >= b, other)

    def __gt__(self, other) -> Series:
        return self._compare(lambda a, b: a > b, other)

    __hash__ = None  # type: ignore[assignment]

    def _logic(self, op: Callable[[Column, Column], Column], other: Series) -> Series:
        if not (isinstance(other, Series) and isinstance(self.kind, T.BooleanType) and isinstance(other.kind, T.BooleanType)):
            raise TypeError("& and | are for boolean series")
        return self._with(op(self.column, self._other(other)))

    def __and__(self, other: Series) -> Series:
        return self._logic(lambda a, b: a & b, other)

    def __or__(self, other: Series) -> Series:
        return self._logic(lambda a, b: a | b, other)

    def __invert__(self) -> Series:
        return self._with(~self.column)

    def _arithmetic(self, op: str, other) -> Series:
        return self._with(arithmetic(self.column, op, self._other(other), self.kind, self.frame.coerce))

    def __add__(self, other) -> Series:
        return self._arithmetic("+", other)

    def __sub__(self, other) -> Series:
        return self._arithmetic("-", other)

    def __mul__(self, other) -> Series:
        return self._arithmetic("*", other)

    def __truediv__(self, other) -> Series:
        return self._arithmetic("/", other)

    def __getitem__(self, item) -> Series:
        """Filter by a boolean series, or take a positional slice."""
        return self.to_frame()[item][self.name]

    def map(self, fn: Callable[..., Column], inputs: Sequence[Series] = (), kind: T.DataType | None = None) -> Series:
        """An expression over this column and others; the type stays unless told."""
        return self._with(map_column(self.column, fn, [s.column for s in inputs]).cast(kind or self.kind), kind)

    def map_native(self, fn: Callable, inputs: Sequence[Series] = (), kind: T.DataType | None = None) -> Series:
        """A vectorised Python function over Arrow batches."""
        kind = kind or self.kind
        return self._with(native_column(self.column, fn, kind.simpleString(), [s.column for s in inputs]), kind)

    def to_frame(self, name: str | None = None) -> Frame:
        """The column beside the index, under a name."""
        name = name or self.name
        keys = [c for c in dict.fromkeys([*self.frame.index, *self.frame.order]) if c != name]
        return self.frame._new(self.frame.df.select(*keys, self.column.alias(name)))

    def _rows(self) -> DataFrame:
        """The frame's rows; of a plain column no other is read."""
        plain = self.plain and self.name in self.frame.columns
        return (self.frame.reading([self.name]) if plain else self.frame).df

    def agg(self, names: Sequence[str]) -> DataFrame:
        """Rows (agg, value) of one pass."""
        if not names:
            raise TypeError("at least one aggregate is needed")
        one = self._rows().agg(*[aggregate(n, self.column).cast("double").alias(n) for n in names])
        return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("agg"), F.col(n).alias(self.name)) for n in names])))

    def describe(self, names: Sequence[str]) -> DataFrame:
        return self.agg(names)

    def _scalar(self, name: str) -> DataFrame:
        out = aggregate(name, self.column)
        if name in ("min", "max"):
            out = out.cast(self.kind)
        elif name in ("sum", "prod") and isinstance(self.kind, INTEGERS):
            out = out.cast("long")
        return self._rows().agg(out.alias(self.name))

    def sum(self) -> DataFrame:
        return self._scalar("sum")

    def prod(self) -> DataFrame:
        return self._scalar("prod")

    def min(self) -> DataFrame:
        return self._scalar("min")

    def max(self) -> DataFrame:
        return self._scalar("max")

    def count(self) -> DataFrame:
        return self._scalar("count")

    def mean(self) -> DataFrame:
        return self._scalar("mean")

    def std(self) -> DataFrame:
        return self._scalar("std")

    def head(self, n: int = 10) -> Series:
        return self.to_frame().head(n)[self.name]

    def evaluate(self):
        """The values as a numpy array."""
        return self.frame._ordered(self.frame.df.select(*self.frame.order, self.column.alias("_gf_value"))).toPandas()["_gf_value"].to_numpy()

    def __repr__(self) -> str:
        return f"Series({self.name}: {self.kind.simpleString()})"
