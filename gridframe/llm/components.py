"""Connected components of an edge table, by contraction, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hot, scratch

#: rows of one vertex that a join leaves together (two or three numbers each)
VERTEX_ROWS = 100_000


def components(edges: DataFrame) -> DataFrame:
    """(v, comp) for every vertex of ``edges`` (columns a, b: long); comp is a vertex of the component.

    Each round hooks every vertex to the least of its neighbours and itself,
    follows the hook once more, and contracts the edges; vertices should be
    hashes, so that a round leaves a fraction of them.  A vertex with a large
    part of all edges is split in every join.
    """
    live = scratch.table(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    first = live.select(F.col("a").alias("v")).union(live.select(F.col("b").alias("v"))).distinct()
    label = first.withColumn("comp", F.col("v"))
    n = live.count()
    vertices = 2 * n
    while n:
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        hook = scratch.table(hook)
        onward = hook.select(F.col("a").alias("m"), F.col("m").alias("mm"))
        jump = scratch.table(hot.lookup(hook, onward, "m", "left", VERTEX_ROWS, 2 * n).select(F.col("a").alias("x"), F.coalesce("mm", "m").alias("y")))
        ends = {c: jump.select(F.col("x").alias(c), F.col("y").alias(f"new_{c}")) for c in ("comp", "a", "b")}
        label = scratch.table(hot.lookup(label, ends["comp"], "comp", "left", VERTEX_ROWS, vertices).select("v", F.coalesce("new_comp", "comp").alias("comp")))
        moved = live
        for c in "ab":
            moved = scratch.table(moved) if c == "b" and n > VERTEX_ROWS else moved
            moved = hot.lookup(moved, ends[c], c, "left", VERTEX_ROWS, n).withColumn(c, F.coalesce(f"new_{c}", c)).select("a", "b")
        live = scratch.table(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        n = live.count()
    return label
