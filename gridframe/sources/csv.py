"""CSV scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession

from ..operators.frame import Frame


def read_csv(spark: SparkSession, path: str, index: Sequence[str] = (), order: Sequence[str] | None = None, schema: str | None = None, eager: bool = False) -> Frame:
    """A CSV file with a header as a frame; types are inferred unless a schema is given.

    Unused columns are not parsed.  ``eager`` reads at once and keeps the rows.
    """
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    frame = Frame(df, index, order)
    if eager:
        frame = frame.cache()
        frame.df.count()
    return frame
