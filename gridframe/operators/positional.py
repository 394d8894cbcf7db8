"""Positional rows: row numbers and slices of an explicit order, without one sorting task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW_ID = "_row_id"
#: rows up to which a slice from the start is a top-n rather than a full sort
TOP_ROWS = 100_000
_IN_PARTITION = 33  # bits that monotonically_increasing_id gives the row of a partition
_held: list[DataFrame] = []


def release() -> None:
    """Give back what numbered rows hold in memory and on disk; their frames are computed anew if used again."""
    while _held:
        _held.pop().unpersist()


def with_row_ids(df: DataFrame, order: Sequence[str], name: str = ROW_ID) -> DataFrame:
    """Add the row number (from 0) in the given order, which should be unique.

    Rows are range-partitioned and sorted in parallel; only the row count of
    each partition comes to the driver, and goes back as a small table.  The
    sorted rows are held until ``release``.
    """
    if not order:
        raise ValueError("a positional operation needs an order")
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_gf_at", F.monotonically_increasing_id())
    placed = placed.persist(StorageLevel.MEMORY_AND_DISK)  # both passes must see the same ranges
    _held.append(placed)
    part = F.shiftright("_gf_at", _IN_PARTITION).cast("int")
    counts = placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    base, starts = 0, []
    for row in sorted(counts, key=lambda r: r.p):
        starts.append((row.p, base))
        base += row.n
    if not starts:
        return placed.withColumn(name, F.lit(0).cast("long")).drop("_gf_at")
    bases = df.sparkSession.createDataFrame(starts, "_gf_part int, _gf_base long")
    placed = placed.withColumn("_gf_part", part).join(F.broadcast(bases), "_gf_part")
    return placed.withColumn(name, F.col("_gf_base") + F.col("_gf_at").bitwiseAND(F.lit((1 << _IN_PARTITION) - 1))).drop("_gf_at", "_gf_part", "_gf_base")


def slice_rows(df: DataFrame, order: Sequence[str], start: int | None, stop: int | None, step: int | None = None) -> DataFrame:
    """Rows [start, stop) of the order, every ``step``-th of them."""
    start, step = start or 0, step or 1
    if start < 0 or (stop is not None and stop < 0) or step < 1:
        raise ValueError("bounds of a slice count from the start")
    if stop is not None and stop <= start:
        return df.limit(0)
    if stop is not None and stop <= TOP_ROWS and step == 1 and order:
        top = df.orderBy(*order)
        return top.offset(start).limit(stop - start) if start else top.limit(stop)
    rows = with_row_ids(df, order)
    keep = F.col(ROW_ID) >= start
    if stop is not None:
        keep &= F.col(ROW_ID) < stop
    if step > 1:
        keep &= F.pmod(F.col(ROW_ID) - start, F.lit(step)) == 0
    return rows.filter(keep).drop(ROW_ID)
