"""Joins of many rows with one row a key, where one key may hold much of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

#: keys with more than this part of the rows are split, so at most as many keys as its inverse are broadcast
SHARE = 10_000
#: rows that a key may always have unsplit
LEAST = 1000


def lookup(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", least: int = LEAST, total: int | None = None) -> DataFrame:
    """``rows`` joined with ``table`` on ``key``, in the columns of both.

    ``rows`` reads a scratch table, so that a row's number is the same in every
    run of a task; ``table`` has one row for each key.  Its column ``size``, if
    it has one, says how many of ``rows`` have the key and goes; otherwise they
    are counted.  Rows of a key beyond the limit are dealt out to cells of about
    that many rows, and the key's row of the table is sent to each of them: at
    most ``2 * SHARE`` rows more than without.  Null keys join nothing.
    ``total`` is a known bound on the rows, which otherwise are counted.
    """
    own = table.drop("size")
    total = rows.count() if total is None else total
    if total <= least:
        return rows.join(own, key, how)
    limit = max(least, total // SHARE)
    sizes = table if "size" in table.columns else rows.groupBy(key).agg(F.count(F.lit(1)).alias("size"))
    many = sizes.where(F.col(key).isNotNull() & (F.col("size") > limit))
    many = scratch.table(many.select(key, F.ceil(F.col("size") / limit).cast("int").alias("_gf_cells")))
    if many.isEmpty():
        return rows.join(own, key, how)
    many = F.broadcast(many)
    cells = F.coalesce("_gf_cells", F.lit(1))
    numbered = rows.withColumn("_gf_row", F.monotonically_increasing_id()).join(many, key, "left")
    left = numbered.withColumn("_gf_cell", F.pmod("_gf_row", cells).cast("int")).drop("_gf_row", "_gf_cells")
    right = own.join(many, key, "left").withColumn("_gf_cell", F.explode(F.sequence(F.lit(0), cells - 1))).drop("_gf_cells")
    return left.join(right, [key, "_gf_cell"], how).drop("_gf_cell")
