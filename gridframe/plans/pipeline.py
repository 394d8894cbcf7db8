"""The grid pipeline: join, preview, slice, clean, derive, summarise, monthly means.

    python -m gridframe.plans.pipeline --input DIR --slice A:B --output DIR [--format grid|csv|parquet] [--eager] [--partitions N]
"""

from __future__ import annotations

import argparse
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import abs_diff, year_month
from ..operators.frame import Frame
from ..session import build_session
from ..sources import read_csv, read_grid

#: fixed values: keys, what stands for a missing measurement, columns that go, columns that are averaged
KEYS = ("longitude", "latitude", "time")
SENTINELS = {"tg": -99.99, "pp": -999.9, "rr": -999.9}
DROPPED = ("pp_stderr", "rr_stderr")
MEANS = ("tg", "tn", "tx", "pp", "rr")


@dataclass
class Result:
    """The joined preview, one row for each aggregate, one row for each column's sum of group means."""

    head: DataFrame
    agg: DataFrame
    grouped: DataFrame


def mark(event: str) -> None:
    """Progress line that timing tools read."""
    print(f"#{datetime.now():%H:%M:%S}-{event}", flush=True)


def without_sentinels(frame: Frame, sentinels: Mapping[str, float]) -> Frame:
    """Rows none of whose columns holds its sentinel; literals take the columns' types."""
    return frame.filter(reduce(lambda a, b: a & b, [frame[c] != v for c, v in sentinels.items()]))


def monthly_means(frame: Frame, keys: Sequence[str], time: str, columns: Sequence[str]) -> Frame:
    """Group mean of ``columns`` by the other keys and month, as ``<column>_mean``."""
    place = [k for k in keys if k != time]
    df = frame.df.select(*place, year_month(time).alias("year_month"), *columns)
    return Frame(df).groupby([*place, "year_month"]).mean().rename({c: f"{c}_mean" for c in columns})


def analyse(
    joined: Frame,
    rows: tuple[int, int] | None,
    *,
    keys: Sequence[str] = KEYS,
    sentinels: Mapping[str, float] = SENTINELS,
    dropped: Sequence[str] = DROPPED,
    high: str = "tx",
    low: str = "tn",
    means: Sequence[str] = MEANS,
) -> tuple[DataFrame, DataFrame]:
    """(agg, grouped) of a joined frame."""
    frame = joined if rows is None else joined[rows[0] : rows[1]]
    frame = without_sentinels(frame, sentinels).drop(list(dropped))
    frame = frame.assign("abs_diff", abs_diff(high, low))
    agg = frame.describe(["min", "max", "mean", "std"])
    time = keys[-1]
    per_month = monthly_means(frame, keys, time, means)
    return agg, per_month.sum().withColumnRenamed("sum", "grouped_sum")


def run_pipeline(left: Frame, right: Frame, rows: tuple[int, int] | None, **options) -> Result:
    joined = left.merge(right)
    agg, grouped = analyse(joined, rows, **options)
    return Result(joined.head(10).df, agg, grouped)


def _read(spark: SparkSession, folder: str, form: str, eager: bool) -> tuple[Frame, Frame]:
    if form == "grid":
        return tuple(read_grid(spark, f"{folder}/data{i}.nc", eager=eager) for i in (1, 2))
    if form == "csv":
        return tuple(read_csv(spark, f"{folder}/data{i}.csv", KEYS, eager=eager) for i in (1, 2))
    return tuple(Frame(spark.read.parquet(f"{folder}/data{i}.parquet"), KEYS) for i in (1, 2))


def main(args: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("-i", "--input", required=True, help="folder of data1 and data2")
    parser.add_argument("-s", "--slice", required=True, help="rows A:B of the joined grid")
    parser.add_argument("-o", "--output", help="folder of head.csv, agg.csv and grouped.csv")
    parser.add_argument("-f", "--format", choices=("grid", "csv", "parquet"), default="grid")
    parser.add_argument("-e", "--eager", action="store_true", help="read the inputs at once and keep them")
    parser.add_argument("-p", "--partitions", type=int, help="shuffle partitions")
    got = parser.parse_args(args)
    spark = build_session(**({"spark.sql.shuffle.partitions": str(got.partitions)} if got.partitions else {}))
    left, right = _read(spark, got.input, got.format, got.eager)
    mark("done_read")
    start, stop = (int(x) for x in got.slice.split(":"))
    result = run_pipeline(left, right, (start, stop))
    for event, name, df in (("done_head", "head", result.head), ("done_agg", "agg", result.agg), ("done_groupby", "grouped", result.grouped)):
        if got.output:
            Frame(df).to_csv(f"{got.output}/{name}.csv")
        else:
            df.show()
        mark(event)


if __name__ == "__main__":
    main()
