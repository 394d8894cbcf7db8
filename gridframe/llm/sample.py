"""Bounded samples of whole labelled texts, for models that learn on the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def whole_texts(rows: DataFrame, wanted: Sequence[tuple], train_bytes: int) -> list[tuple]:
    """(g, i, t) of the ``wanted`` (g, i), in their order, as far as ``train_bytes`` of each g go.

    ``rows`` has group g, id i and text t.  Of several texts of one (g, i) the
    one of least hash counts, once; null texts are empty.  The first text of a
    group is taken however long it is.  At most the wanted texts come to the
    driver, and of them only those that fit.
    """
    if not wanted:
        return []
    spark, kinds = rows.sparkSession, {f.name: f.dataType.simpleString() for f in rows.schema}
    rows = rows.withColumn("t", F.coalesce("t", F.lit(""))).withColumn("h", F.xxhash64("t"))

    def beside(keys: list[tuple], columns: str) -> DataFrame:
        return F.broadcast(spark.createDataFrame(keys, columns))

    of = rows.join(beside(list(wanted), f"g {kinds['g']}, i {kinds['i']}"), ["g", "i"], "left_semi")
    found = {(r.g, r.i): r.s for r in of.groupBy("g", "i").agg(F.min(F.struct("h", F.octet_length("t").alias("n"))).alias("s")).collect()}
    left: dict = {}
    taken = []
    for key in wanted:
        if key in found:
            n = found[key].n
            if key[0] not in left or n <= left[key[0]]:
                left[key[0]] = left.get(key[0], train_bytes) - n
                taken.append((*key, found[key].h))
    texts = rows.join(beside(taken, f"g {kinds['g']}, i {kinds['i']}, h long"), ["g", "i", "h"], "left_semi").groupBy("g", "i").agg(F.min("t").alias("t"))
    got = {(r.g, r.i): r.t for r in texts.collect()}
    return [(g, i, got[g, i]) for g, i, _ in taken]
