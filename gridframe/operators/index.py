"""Index functions: ranges, repeats, products, and labels of distinct values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import positional

#: values of a dimension up to which they travel as a literal array
LITERAL_VALUES = 10_000


def _div(a: Column, n: int) -> Column:
    return F.call_function("div", a, F.lit(n)).cast("long")


def range_index(spark: SparkSession, start: int, stop: int, step: int = 1, name: str = "Index") -> DataFrame:
    return spark.range(start, stop, step).withColumnRenamed("id", name)


def repeat_indices(spark: SparkSession, n: int, times: int) -> DataFrame:
    """(pos, i): each of n indices ``times`` times in a row."""
    return spark.range(n * times).select(F.col("id").alias("pos"), _div(F.col("id"), times).alias("i"))


def tile_indices(spark: SparkSession, n: int, times: int) -> DataFrame:
    """(pos, i): all n indices in order, ``times`` times over."""
    return spark.range(n * times).select(F.col("id").alias("pos"), F.pmod(F.col("id"), F.lit(n)).alias("i"))


def cartesian_indices(spark: SparkSession, sizes: Sequence[int]) -> DataFrame:
    """(pos, i0, i1 ..): index of each dimension, the first varying slowest, by arithmetic on the position."""
    if len(sizes) < 2:
        raise ValueError("a product needs two dimensions at least")
    out, inner = [F.col("id").alias("pos")], prod(sizes)
    for k, n in enumerate(sizes):
        inner //= n
        out.append(F.pmod(_div(F.col("id"), inner), F.lit(n)).alias(f"i{k}"))
    return spark.range(prod(sizes)).select(*out)


def from_product(spark: SparkSession, levels: Mapping[str, Sequence]) -> DataFrame:
    """(pos, names ..): the values of every combination, the first name varying slowest."""
    names = list(levels)
    grid = cartesian_indices(spark, [len(levels[n]) for n in names])
    out = [F.col("pos")]
    for k, name in enumerate(names):
        values = list(levels[name])
        if len(values) <= LITERAL_VALUES:
            out.append(F.element_at(F.array(*[F.lit(v) for v in values]), F.col(f"i{k}").cast("int") + 1).alias(name))
        else:
            table = spark.createDataFrame(list(enumerate(values)), [f"i{k}", name])
            grid = grid.join(table, f"i{k}")
            out.append(F.col(name))
    return grid.select(*out)


def unique(df: DataFrame, column: str) -> DataFrame:
    """Distinct values in order."""
    return df.select(column).distinct().orderBy(column)


def levels_of(df: DataFrame, column: str) -> DataFrame:
    """(column, label): distinct values but null, numbered in order from 0."""
    return positional.with_row_ids(df.select(column).where(F.col(column).isNotNull()).distinct(), [column], "label")


def encode(df: DataFrame, column: str, levels: DataFrame | None = None, label: str = "label") -> DataFrame:
    """Add the label of each value: its place among the distinct values, or in given ``levels`` (column, label).

    Every row stays: a null, or a value that given levels don't hold, has a null label.
    """
    levels = levels_of(df, column) if levels is None else levels
    return df.join(levels.select(F.col(column), F.col("label").alias(label)), column, "left")


def decode(labels: DataFrame, levels: DataFrame, column: str, label: str = "label") -> DataFrame:
    """Add the value of each label; null for a null or unknown one."""
    return labels.join(levels.select(F.col("label").alias(label), F.col(column)), label, "left")


def from_arrays(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Label columns ``<name>_label`` for each key, and the levels of each."""
    levels = {c: levels_of(df, c) for c in columns}
    for c in columns:
        df = encode(df, c, levels[c], f"{c}_label")
    return df, levels
