import itertools

import pytest
from pyspark.sql import functions as F

from gridframe.operators import Index, MultiIndex, RangeIndex


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture()
def days(spark):
    return Index(spark.createDataFrame([(i * 10 % 70, i) for i in range(7)], "d int, extra int"), "d")


def test_index_slice_filter_head(days):
    assert days.evaluate()["d"].tolist() == [0, 10, 20, 30, 40, 50, 60]
    assert days[2:5].evaluate()["d"].tolist() == [20, 30, 40]
    assert days[1:6:2].evaluate()["d"].tolist() == [10, 30, 50]
    assert days[days.values() > 30].evaluate()["d"].tolist() == [40, 50, 60]
    assert days[F.col("extra") == 3].evaluate()["d"].tolist() == [30]
    assert days.head(2).evaluate()["d"].tolist() == [0, 10] and len(days) == 7
    assert days.expand().columns == ["d"]


def test_index_refuses_other_items(days, spark):
    for item in (3, "d", ["d"]):
        with pytest.raises(TypeError):
            days[item]
        with pytest.raises(TypeError):
            MultiIndex.from_product(spark, {"a": [1], "b": [2]})[item]
    with pytest.raises(ValueError):
        days[days.values()]
    with pytest.raises(ValueError):
        days[-3:]


def test_range_index(spark):
    r = RangeIndex(spark, 5, 100, 3, "i")
    want = list(range(5, 100, 3))
    for cut in (slice(None), slice(2, 9), slice(4, None), slice(1, 20, 4), slice(9, 2), slice(30, 500)):
        got = r[cut]
        assert isinstance(got, RangeIndex) and len(got) == len(want[cut]) and got.evaluate()["i"].tolist() == want[cut]
    assert r.head(3).evaluate()["i"].tolist() == want[:3]
    assert r[r.values() > 90].evaluate()["i"].tolist() == [x for x in want if x > 90]
    for bad in (slice(-1, None), slice(None, -1), slice(None, None, -1), slice(None, None, 0)):
        with pytest.raises(ValueError):
            r[bad]
    with pytest.raises(ValueError):
        RangeIndex(spark, 0, 3, 0)


def test_product(spark):
    levels = {"x": [1.5, 2.5], "y": ["b", "a", "c"], "z": [7, 8]}
    want = list(itertools.product(*levels.values()))
    m = MultiIndex.from_product(spark, levels)
    assert [tuple(r) for r in m.evaluate().itertuples(index=False)] == want and len(m) == 12
    assert [tuple(r) for r in m[3:9].evaluate().itertuples(index=False)] == want[3:9]
    assert [tuple(r) for r in m.head(4).evaluate().itertuples(index=False)] == want[:4]
    second = m[m.values("y") == 1]
    assert [tuple(r) for r in second.evaluate().itertuples(index=False)] == [w for w in want if w[1] == "a"]
    assert second.levels["y"].count() == 3  # levels stay whole
    with pytest.raises(ValueError):
        MultiIndex.from_product(spark, {"x": [1], "y": []})


def test_arrays(spark):
    df = spark.createDataFrame([(0, "b", 2.0), (1, "a", 2.0), (2, None, 1.0), (3, "b", 1.0)], "pos int, k string, v double")
    m = MultiIndex.from_arrays(df, ["k", "v"], ["pos"])
    assert sorted(rows(m.expand().select("pos", "k", "v"))) == sorted(rows(df), key=lambda r: r[0])
    assert m[1:3].evaluate().fillna("none").to_numpy().tolist() == [["a", 2.0], ["none", 1.0]]
    by_value = MultiIndex.from_arrays(df.where("k IS NOT NULL").drop("pos"), ["k", "v"], ["k", "v"])
    assert by_value.evaluate().to_numpy().tolist() == [["a", 2.0], ["b", 1.0], ["b", 2.0]]
    empty = MultiIndex.from_arrays(df.limit(0), ["k", "v"], ["pos"])
    assert len(empty) == 0 and empty.expand().count() == 0
