import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from gridframe.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df:
        if not pd.api.types.is_numeric_dtype(df[c]):
            df[c] = df[c].map(lambda v: "" if v is None else str(v)[:10])
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(plans.ORACLE_SQL[name]).df()
    pd.testing.assert_frame_equal(normal(got), normal(want), check_dtype=False, rtol=1e-9)


def test_entry(spark):
    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_streaming_counts(spark, tmp_path):
    from gridframe.streaming import monthly_counts

    events = spark.read.parquet(f"{SF}/events.parquet").select("ts", "event_type", "value")
    events.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/in")
    q = monthly_counts(stream, "ts", "value", ["event_type"]).writeStream.outputMode("complete").format("memory").queryName("monthly").option("checkpointLocation", f"file://{tmp_path}/at").start()
    try:
        q.processAllAvailable()
        assert spark.table("monthly").agg({"n": "sum"}).first()[0] == events.count()
    finally:
        q.stop()
