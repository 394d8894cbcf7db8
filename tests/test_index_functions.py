import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridframe import operators as op
from gridframe.functions import days_to_date, map_column, native_column, near, relabel, scale, year_month


def column(df, name, by="pos"):
    return [r[name] for r in df.orderBy(by).collect()]


def test_repeat_and_tile(spark):
    assert column(op.repeat_indices(spark, 3, 4), "i") == [0] * 4 + [1] * 4 + [2] * 4
    assert column(op.tile_indices(spark, 3, 4), "i") == [0, 1, 2] * 4


@settings(max_examples=8, deadline=None)
@given(sizes=st.lists(st.integers(1, 4), min_size=2, max_size=4))
def test_products_are_nested_loops(spark, sizes):
    got = [tuple(r)[1:] for r in op.cartesian_indices(spark, sizes).orderBy("pos").collect()]
    assert got == list(itertools.product(*[range(n) for n in sizes]))


def test_product_needs_two(spark):
    with pytest.raises(ValueError):
        op.cartesian_indices(spark, [3])


def test_range(spark):
    assert column(op.range_index(spark, 0, 3), "Index", "Index") == [0, 1, 2]


@settings(max_examples=8, deadline=None)
@given(values=st.lists(st.integers(-5, 5), min_size=1, max_size=30))
def test_decode_undoes_encode(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "pos int, v int")
    levels = op.index.levels_of(df, "v")
    coded = op.encode(df, "v", levels)
    ranks = {v: i for i, v in enumerate(sorted(set(values)))}
    assert column(coded, "label") == [ranks[v] for v in values]
    assert column(op.decode(coded.drop("v"), levels, "v"), "v") == values


@settings(max_examples=8, deadline=None)
@given(n=st.integers(0, 40), a=st.integers(0, 45), b=st.integers(0, 45), step=st.integers(1, 4))
def test_slices_are_those_of_a_list(spark, n, a, b, step):
    df = spark.range(n).select((F.lit(n) - F.col("id")).alias("v"))
    got = [r.v for r in op.slice_rows(df, ["v"], a, b, step).orderBy("v").collect()]
    assert got == list(range(1, n + 1))[a:b:step]


def test_row_ids(spark):
    df = op.with_row_ids(spark.range(1000).select((F.col("id") * 7 % 1000).alias("v")), ["v"])
    assert df.where("_row_id <> v").count() == 0
    assert op.with_row_ids(df.limit(0).drop("_row_id"), ["v"]).count() == 0
    with pytest.raises(ValueError):
        op.with_row_ids(df, [])


def test_unique(spark):
    df = spark.createDataFrame([(3,), (1,), (3,)], "v int")
    assert [r.v for r in op.unique(df, "v").collect()] == [1, 3]


def test_functions(spark):
    df = spark.createDataFrame([(59, 1.0, 1.0 + 1e-9, "stddev", 1234)], "n int, a double, b double, s string, raw int")
    r = df.select(
        days_to_date("n").alias("d"),
        year_month(days_to_date("n")).alias("ym"),
        year_month(days_to_date("n"), as_int=True).alias("ymi"),
        near("a", "b").alias("near"),
        near("a", 1.1).alias("far"),
        relabel("s", {"stddev": "std"}).alias("s"),
        scale("raw", 0.01).alias("v"),
        map_column("n", lambda c: c + 2).alias("m"),
        native_column("n", lambda s: s + 2, "int").alias("u1"),
        native_column("n", lambda a, b: a + b, "int", ["raw"]).alias("u2"),
        native_column("n", lambda a, b, c: a + b + c, "double", ["raw", "a"]).alias("u3"),
    ).first()
    assert str(r.d) == "1950-03-01" and r.ym == "195003" and r.ymi == 195003
    assert (r.near, r.far, r.s, r.m, r.u1, r.u2, r.u3) == (True, False, "std", 61, 61, 1293, 1294.0)
    assert r.v == pytest.approx(12.34, rel=1e-6)


def test_encode_keeps_every_row(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b")], "i int, v string")
    coded, levels = op.from_arrays(df, ["v"])
    assert [(r.i, r.v_label) for r in coded.orderBy("i").collect()] == [(1, 1), (2, None), (3, 0), (4, 1)]
    back = op.decode(coded.select("i", F.col("v_label").alias("label")), levels["v"], "v")
    assert [(r.i, r.v) for r in back.orderBy("i").collect()] == [(1, "b"), (2, None), (3, "a"), (4, "b")]
    given = spark.createDataFrame([("a", 7)], "v string, label long")
    assert [r.label for r in op.encode(df, "v", given).orderBy("i").collect()] == [None, None, 7, None]


def test_many_partitions_and_release(spark):
    from gridframe.operators import positional

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "300")
    try:
        df = op.with_row_ids(spark.range(3000).select((F.col("id") * 7 % 3000).alias("v")), ["v"])
        assert df.columns == ["v", "_row_id"] and df.where("_row_id <> v").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    positional.release()
    assert not positional._held and df.count() == 3000
