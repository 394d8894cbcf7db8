"""Part of a grid file as CSV, Parquet or another grid file.

    python -m gridframe.plans.convert --input FILE --output PATH [--format csv|parquet|classic|netcdf4]
        [--variables A,B] [--subset time=1950-01-01:1950-12-31] [--rows A:B]
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..session import build_session
from ..sources import read_grid


def convert(spark: SparkSession, source: str, target: str, form: str = "csv", variables: Sequence[str] = (), subset: Sequence[tuple[str, str, str]] = (), rows: tuple[int, int] | None = None) -> None:
    """``subset``: (dimension, least label, greatest label), both included; ``rows`` are numbered in the whole file."""
    frame = read_grid(spark, source, list(variables) or None)
    if rows is not None:
        frame = frame[rows[0] : rows[1]]
    for dimension, low, high in subset:
        kind = frame.df.schema[dimension].dataType
        frame = frame.subset(dimension, F.lit(low).cast(kind), F.lit(high).cast(kind))
    if form == "csv":
        frame.to_csv(target)
    elif form == "parquet":
        frame.keyed().df.write.mode("overwrite").parquet(target)
    else:
        frame.to_grid(target, form)


def main(args: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("-i", "--input", required=True, help="grid file")
    parser.add_argument("-o", "--output", required=True, help="file or folder to write")
    parser.add_argument("-f", "--format", choices=("csv", "parquet", "classic", "netcdf4"), default="csv")
    parser.add_argument("-v", "--variables", default="", help="variables, by comma; all by default")
    parser.add_argument("-s", "--subset", action="append", default=[], help="DIMENSION=LOW:HIGH, may be repeated")
    parser.add_argument("-r", "--rows", help="rows A:B of the file")
    got = parser.parse_args(args)
    subset = [(d, *span.split(":", 1)) for d, span in (s.split("=", 1) for s in got.subset)]
    rows = tuple(int(x) for x in got.rows.split(":")) if got.rows else None
    convert(build_session(), got.input, got.output, got.format, [v for v in got.variables.split(",") if v], subset, rows)


if __name__ == "__main__":
    main()
