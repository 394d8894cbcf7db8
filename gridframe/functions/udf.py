"""User functions: expressions where possible, Arrow batches otherwise."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import ColumnLike, _col


def map_column(column: ColumnLike, fn: Callable[..., Column], inputs: Sequence[ColumnLike] = ()) -> Column:
    """``fn`` over column expressions; stays inside generated code."""
    return fn(_col(column), *[_col(c) for c in inputs])


def native_column(column: ColumnLike, fn: Callable[..., pd.Series], returns: str, inputs: Sequence[ColumnLike] = ()) -> Column:
    """``fn`` over Arrow batches as pandas series, for what expressions can't say."""

    first, *rest = [_col(column), *[_col(c) for c in inputs]]
    if len(rest) > 1:  # more than two columns travel as one struct
        packed = F.struct(*[c.alias(f"c{i}") for i, c in enumerate([first, *rest])])
        return F.pandas_udf(_fixed(fn, 3), returns)(packed)
    return F.pandas_udf(_fixed(fn, 1 + len(rest)), returns)(first, *rest)


def _fixed(fn: Callable[..., pd.Series], count: int) -> Callable[..., pd.Series]:
    """``fn`` with the annotated arguments that pandas_udf looks for."""
    if count == 1:

        def one(a0: pd.Series) -> pd.Series:
            return fn(a0)

        return one
    if count == 2:

        def two(a0: pd.Series, a1: pd.Series) -> pd.Series:
            return fn(a0, a1)

        return two

    def many(a0: pd.DataFrame) -> pd.Series:
        return fn(*[a0[c] for c in a0.columns])

    return many
