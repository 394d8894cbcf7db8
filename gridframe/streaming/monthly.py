"""The pipeline's monthly bucketing over an unbounded table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import year_month


def monthly_counts(stream: DataFrame, time: str, value: str, keys: Sequence[str] = (), late: str = "1 day", window: str = "1 day") -> DataFrame:
    """Count and mean of ``value`` by keys, time window and month; rows later than ``late`` are dropped.

    The watermark bounds the state; a window never spans two months as long as
    it divides a day.
    """
    span = F.window(time, window)
    return (
        stream.withColumn(time, F.col(time).cast("timestamp"))
        .withWatermark(time, late)
        .groupBy(*keys, span.alias("span"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
        .select(*keys, F.col("span.start").alias("start"), year_month(F.col("span.start")).alias("year_month"), "n", "mean")
    )
