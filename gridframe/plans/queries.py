"""Registered queries over the driver's tables, each with the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import operators as op
from ..functions import abs_diff, date_text, days_to_date, near, relabel, scale, year_month
from ..operators import Frame
from ..session import shared_folder
from ..sources import formats, read_csv, read_grid
from . import pipeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str, name: str | None = None):
    """Register a function under its name, or another, with its SQL."""

    def add(fn):
        QUERIES[name or fn.__name__] = fn
        ORACLE_SQL[name or fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark, sf_dir) -> Frame:
    return Frame(table(spark, sf_dir, "orders"), ("o_orderkey",))


def nation(spark, sf_dir) -> Frame:
    return Frame(table(spark, sf_dir, "nation"), ("n_nationkey",))


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# Two measurement grids over (l_suppkey, l_linenumber, day), made of lineitem.

GRID_KEYS = ("l_suppkey", "l_linenumber", "d")
_GRID1 = "SELECT l_suppkey, l_linenumber, CAST(l_shipdate AS DATE) AS d, avg(l_quantity) AS tg, min(l_discount) AS pp, max(l_tax) AS rr FROM lineitem GROUP BY ALL"
_GRID2 = "SELECT l_suppkey, l_linenumber, CAST(l_shipdate AS DATE) AS d, min(l_extendedprice) AS tn, max(l_extendedprice) AS tx FROM lineitem GROUP BY ALL"


def grid(spark, sf_dir, side: int) -> Frame:
    line = table(spark, sf_dir, "lineitem").withColumn("d", F.to_date("l_shipdate"))
    aggs = {1: {"tg": F.avg("l_quantity"), "pp": F.min("l_discount"), "rr": F.max("l_tax")}, 2: {"tn": F.min("l_extendedprice"), "tx": F.max("l_extendedprice")}}[side]
    return Frame(line.groupBy(*GRID_KEYS).agg(*[c.alias(n) for n, c in aggs.items()]), GRID_KEYS)


# scans, projections, filters


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def scan_select(spark, sf_dir):
    return orders(spark, sf_dir)[["o_custkey", "o_totalprice"]].df


@query("SELECT o_orderkey, o_totalprice FROM orders")
def select_column(spark, sf_dir):
    return orders(spark, sf_dir)["o_totalprice"].to_frame().df


@query(
    """SELECT l_orderkey, l_linenumber, v FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN CAST(-99.99 AS FLOAT) ELSE CAST(l_quantity AS FLOAT) END AS v FROM lineitem)
    WHERE v <> CAST(-99.99 AS FLOAT) AND v > CAST(10 AS FLOAT)"""
)
def filter_sentinel(spark, sf_dir):
    v = F.when(F.col("l_linenumber") == 3, F.lit(-99.99).cast("float")).otherwise(F.col("l_quantity").cast("float"))
    f = Frame(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", v.alias("v")))
    return f[(f["v"] != -99.99) & (f["v"] > 10)].df


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 1000 OR o_totalprice >= 400000 OR (o_totalprice <= 2000 AND o_totalprice > 1900)")
def filter_or(spark, sf_dir):
    f = orders(spark, sf_dir)[["o_totalprice"]]
    p = f["o_totalprice"]
    return f[(p < 1000) | (p >= 400000) | ((p <= 2000) & (p > 1900))].df


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal = 1 OR s_nationkey = 7")
def filter_equal(spark, sf_dir):
    f = Frame(table(spark, sf_dir, "supplier"), ("s_suppkey",))
    return f[(f["s_acctbal"] == 1) | (f["s_nationkey"] == 7)][["s_acctbal"]].df


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE abs(o_totalprice - (SELECT min(o_totalprice) FROM orders)) < 1.5e-8")
def near_filter(spark, sf_dir):
    f = orders(spark, sf_dir)[["o_totalprice"]]
    least = f["o_totalprice"].min().first()[0]
    return f[near("o_totalprice", least)].df


@query("SELECT l_orderkey, l_linenumber, abs(l_extendedprice - 1000 * l_quantity) AS d FROM lineitem")
def assign_abs_diff(spark, sf_dir):
    f = Frame(table(spark, sf_dir, "lineitem")[["l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"]])
    f = f.assign("q", f["l_quantity"] * 1000).assign("d", abs_diff("l_extendedprice", "q"))
    return f.drop(["l_extendedprice", "l_quantity", "q"]).df


@query("SELECT n_nationkey AS nation, n_name AS name FROM nation")
def rename_drop(spark, sf_dir):
    return nation(spark, sf_dir).rename({"n_nationkey": "nation", "n_name": "name", "absent": "x"}).drop(["n_regionkey", "absent"]).df


@query("SELECT n_name, n_nationkey, n_regionkey, CAST(n_nationkey * 10 + 1 AS BIGINT) AS v FROM nation")
def assign_values(spark, sf_dir):
    return nation(spark, sf_dir).assign_values("v", [i * 10 + 1 for i in range(25)]).df


# positional rows


@query("SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn FROM orders) WHERE rn >= 100 AND rn < 350")
def slice_rows(spark, sf_dir):
    return orders(spark, sf_dir)[["o_totalprice"]][100:350].df


@query("SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn FROM orders) WHERE rn >= 100 AND rn < 1200 AND (rn - 100) % 7 = 0")
def slice_step(spark, sf_dir):
    return orders(spark, sf_dir)[["o_totalprice"]][100:1200:7].df


@query("SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn FROM orders) WHERE rn >= 1000")
def slice_open(spark, sf_dir):
    return orders(spark, sf_dir)[["o_totalprice"]][1000:].df


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 10")
def head_n(spark, sf_dir):
    return orders(spark, sf_dir)[["o_custkey"]].head(10).df


@query("SELECT o_orderkey, o_custkey, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS row FROM orders")
def reset_index(spark, sf_dir):
    return orders(spark, sf_dir)[["o_custkey"]].reset_index("row").df


@query("SELECT n_regionkey, n_name, n_nationkey FROM nation")
def set_index(spark, sf_dir):
    return Frame(table(spark, sf_dir, "nation")).set_index(["n_regionkey", "n_name"]).df


@query("SELECT CAST(range AS BIGINT) AS i FROM range(5, 100, 3)")
def range_index(spark, sf_dir):
    return op.range_index(spark, 5, 100, 3, "i")


# arithmetic


@query("SELECT o_orderkey, round(o_totalprice * 2 + 1, 4) AS a, round((o_totalprice - 3) / 4, 4) AS b FROM orders")
def elementwise_scalar(spark, sf_dir):
    f = orders(spark, sf_dir)[["o_totalprice"]]
    f = f.assign("a", f["o_totalprice"] * 2 + 1)
    f = f.assign("b", (f["o_totalprice"] - 3) / 4)
    return rounded(f.drop("o_totalprice").df, "a", "b")


@query(
    "SELECT l_orderkey, l_linenumber, l_extendedprice + l_tax AS a, l_extendedprice - l_quantity AS s, l_extendedprice * l_discount AS m, l_extendedprice / l_quantity AS d FROM lineitem"
)
def elementwise_array(spark, sf_dir):
    f = Frame(table(spark, sf_dir, "lineitem"))
    p = f["l_extendedprice"]
    return f.df.select("l_orderkey", "l_linenumber", (p + f["l_tax"]).column.alias("a"), (p - f["l_quantity"]).column.alias("s"), (p * f["l_discount"]).column.alias("m"), (p / f["l_quantity"]).column.alias("d"))


@query("SELECT o_orderkey, o_custkey // 7 AS c FROM orders")
def int_div(spark, sf_dir):
    f = orders(spark, sf_dir)
    return f.assign("c", f["o_custkey"] / 7)[["c"]].df


@query("SELECT s_suppkey, s_nationkey * 2 - 1 AS s_nationkey, round(s_acctbal * 2 - 1, 4) AS s_acctbal FROM supplier")
def frame_scalar(spark, sf_dir):
    f = Frame(table(spark, sf_dir, "supplier"), ("s_suppkey",))[["s_nationkey", "s_acctbal"]]
    return rounded((f * 2 - 1).df, "s_acctbal")


@query("SELECT n_nationkey, CAST(CAST(n_nationkey AS FLOAT) * CAST(0.01 AS FLOAT) AS FLOAT) AS v FROM nation")
def scale_factor(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", scale("n_nationkey", 0.01).alias("v"))


# joins


@query("SELECT o_orderkey, o_totalprice, lines, round(quantity, 4) AS quantity FROM orders JOIN (SELECT l_orderkey AS o_orderkey, count(*) AS lines, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_orderkey) USING (o_orderkey)")
def merge_1d(spark, sf_dir):
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("quantity"))
    return rounded(orders(spark, sf_dir)[["o_totalprice"]].merge(Frame(per, ("l_orderkey",))).df, "quantity")


@query(f"SELECT l_suppkey, l_linenumber, d, round(tg, 4) AS tg, pp, rr, tn, tx FROM ({_GRID1}) JOIN ({_GRID2}) USING (l_suppkey, l_linenumber, d)")
def merge_3d(spark, sf_dir):
    return rounded(grid(spark, sf_dir, 1).merge(grid(spark, sf_dir, 2)).df, "tg")


@query("SELECT c_custkey, c_name, n, t FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS t FROM orders GROUP BY o_custkey) USING (c_custkey)")
def merge_left(spark, sf_dir):
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("t"))
    return Frame(table(spark, sf_dir, "customer")[["c_custkey", "c_name"]], ("c_custkey",)).merge(Frame(per, ("o_custkey",)), how="left").df


@query("SELECT n_nationkey, n.n_name AS n_name_l, upper(n.n_name) AS n_name_r FROM nation n")
def merge_suffixes(spark, sf_dir):
    left = nation(spark, sf_dir)[["n_name"]]
    return left.merge(Frame(left.df.withColumn("n_name", F.upper("n_name")), ("n_nationkey",)), suffixes=("_l", "_r")).df


@query("SELECT o_orderkey, o_custkey, lines, round(price, 2) AS price FROM orders JOIN (SELECT l_orderkey AS o_orderkey, count(*) AS lines FROM lineitem GROUP BY 1) USING (o_orderkey) JOIN (SELECT l_orderkey AS o_orderkey, max(l_extendedprice) AS price FROM lineitem GROUP BY 1) USING (o_orderkey)")
def dataset_merge(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    a = Frame(line.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("lines")), ("o_orderkey",))
    b = Frame(line.groupBy("o_orderkey").agg(F.max("l_extendedprice").alias("max_price")), ("o_orderkey",))
    return rounded(Frame.merge_all([orders(spark, sf_dir)[["o_custkey"]], a, b.rename({"max_price": "price"})]).df, "price", digits=2)


# index functions


@query("SELECT CAST(row_number() OVER (ORDER BY r_regionkey, ln) - 1 AS BIGINT) AS pos, r_regionkey, ln FROM region, (SELECT DISTINCT l_linenumber AS ln FROM lineitem)")
def cartesian(spark, sf_dir):
    a = [r[0] for r in op.unique(table(spark, sf_dir, "region"), "r_regionkey").collect()]
    b = [r[0] for r in op.unique(table(spark, sf_dir, "lineitem"), "l_linenumber").collect()]
    grid_ = op.from_product(spark, {"r_regionkey": a, "ln": b})
    return grid_.select("pos", F.col("r_regionkey").cast("int").alias("r_regionkey"), F.col("ln").cast("int").alias("ln"))


@query("SELECT range AS pos, range // 6 AS i0, (range // 2) % 3 AS i1, range % 2 AS i2 FROM range(24)")
def cartesian_3d(spark, sf_dir):
    return op.cartesian_indices(spark, [4, 3, 2])


@query("SELECT range AS pos, range // 3 AS i FROM range(75)")
def repeat_elements(spark, sf_dir):
    return op.repeat_indices(spark, table(spark, sf_dir, "nation").count(), 3)


@query("SELECT range AS pos, range % 25 AS i FROM range(75)")
def tile_array(spark, sf_dir):
    return op.tile_indices(spark, table(spark, sf_dir, "nation").count(), 3)


@query("SELECT c_custkey, c_mktsegment, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS BIGINT) AS label FROM customer")
def encode_labels(spark, sf_dir):
    return op.encode(table(spark, sf_dir, "customer")[["c_custkey", "c_mktsegment"]], "c_mktsegment")


@query("SELECT c_custkey, c_mktsegment FROM customer")
def decode_labels(spark, sf_dir):
    coded, levels = op.from_arrays(table(spark, sf_dir, "customer")[["c_custkey", "c_mktsegment"]], ["c_mktsegment"])
    coded = coded.select("c_custkey", F.col("c_mktsegment_label").alias("label"))
    return op.decode(coded, levels["c_mktsegment"], "c_mktsegment").drop("label")


@query("SELECT DISTINCT p_type FROM part")
def unique_sorted(spark, sf_dir):
    return op.unique(table(spark, sf_dir, "part"), "p_type")


@query("SELECT c_mktsegment, c_acctbal FROM customer WHERE c_acctbal < 0 OR c_mktsegment = 'BUILDING'")
def index_filter(spark, sf_dir):
    index = op.Index(table(spark, sf_dir, "customer"), ["c_mktsegment", "c_acctbal"])
    return index[(index.values("c_acctbal") < 0) | (index.values("c_mktsegment") == "BUILDING")].expand()


@query("SELECT CAST(5 + 3 * range AS BIGINT) AS i FROM range(2, 30, 4)")
def index_range_slice(spark, sf_dir):
    return op.RangeIndex(spark, 5, 100, 3, "i")[2:30:4].expand()


_PAIRS = "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS rn, o_orderkey, o_orderstatus, o_orderpriority FROM orders"


def _pairs(spark, sf_dir):
    return op.MultiIndex.from_arrays(table(spark, sf_dir, "orders")[["o_orderkey", "o_orderstatus", "o_orderpriority"]], ["o_orderstatus", "o_orderpriority"], ["o_orderkey"])


@query(f"SELECT o_orderkey, o_orderstatus, o_orderpriority FROM ({_PAIRS}) WHERE rn >= 30 AND rn < 400")
def multi_index_slice(spark, sf_dir):
    return _pairs(spark, sf_dir)[30:400].expand()


@query(f"SELECT o_orderkey, o_orderstatus, o_orderpriority FROM ({_PAIRS}) WHERE o_orderpriority = (SELECT min(o_orderpriority) FROM orders)")
def multi_index_filter(spark, sf_dir):
    index = _pairs(spark, sf_dir)
    return index[index.values("o_orderpriority") == 0].expand()


@query(f"SELECT o_orderkey, o_orderstatus, o_orderpriority FROM ({_PAIRS}) WHERE rn < 10")
def multi_index_head(spark, sf_dir):
    return _pairs(spark, sf_dir).head(10).expand()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25")
def sort_values(spark, sf_dir):
    return orders(spark, sf_dir)[["o_totalprice"]].sort_values("o_totalprice").head(25).df


# aggregates


def _one(name: str, column: str, source: str, sql: str, digits: int | None = 4):
    def run(spark, sf_dir):
        out = getattr(Frame(table(spark, sf_dir, source))[column], name)()
        return rounded(out, column, digits=digits) if digits is not None else out

    run.__name__ = f"agg_{name}"
    value = f"round({sql}, {digits})" if digits is not None else sql
    query(f"SELECT {value} AS {column} FROM {source}")(run)


_one("sum", "o_totalprice", "orders", "sum(o_totalprice)", 2)
_one("min", "o_totalprice", "orders", "min(o_totalprice)")
_one("max", "o_totalprice", "orders", "max(o_totalprice)")
_one("count", "o_totalprice", "orders", "count(*)", None)
_one("mean", "o_totalprice", "orders", "avg(o_totalprice)")
_one("std", "o_totalprice", "orders", "stddev_samp(o_totalprice)")


@query("SELECT CAST(product(n_regionkey + 1) AS DOUBLE) AS p FROM nation")
def agg_prod(spark, sf_dir):
    f = nation(spark, sf_dir).assign("p", F.col("n_regionkey").cast("double") + 1)
    return f["p"].prod()


_STATS = (("sum", "sum({c})"), ("min", "min({c})"), ("max", "max({c})"), ("count", "count(*)"), ("mean", "avg({c})"), ("std", "stddev_samp({c})"))


def _stats_sql(names: tuple[str, ...], columns: tuple[str, ...], source: str) -> str:
    by = dict(_STATS)
    return " UNION ALL ".join(f"SELECT '{n}' AS agg, " + ", ".join(f"round(CAST({by[n].format(c=c)} AS DOUBLE), 2) AS {c}" for c in columns) + f" FROM {source}" for n in names)


@query(_stats_sql(("mean", "sum", "min", "max", "count", "std"), ("l_quantity", "l_extendedprice"), "lineitem"))
def agg_multi(spark, sf_dir):
    f = Frame(table(spark, sf_dir, "lineitem")[["l_quantity", "l_extendedprice"]])
    return rounded(f.agg(["mean", "sum", "min", "max", "count", "std"]), "l_quantity", "l_extendedprice", digits=2)


@query(_stats_sql(("min", "max", "mean", "std"), ("l_quantity", "l_discount", "l_tax"), "lineitem"))
def describe(spark, sf_dir):
    f = Frame(table(spark, sf_dir, "lineitem")[["l_quantity", "l_discount", "l_tax"]])
    return rounded(f.describe(["min", "max", "mean", "std"]), "l_quantity", "l_discount", "l_tax", digits=2)


@query("SELECT 'l_quantity' AS \"column\", round(sum(l_quantity), 2) AS sum FROM lineitem UNION ALL SELECT 'l_tax', round(sum(l_tax), 2) FROM lineitem")
def to_frame_unpivot(spark, sf_dir):
    return rounded(Frame(table(spark, sf_dir, "lineitem")[["l_quantity", "l_tax"]]).sum(), "sum", digits=2)


def _grouped(name: str, sql: str):
    def run(spark, sf_dir):
        f = Frame(table(spark, sf_dir, "lineitem")[["l_returnflag", "l_linestatus", "l_quantity", "l_tax"]]).groupby(["l_returnflag", "l_linestatus"])
        return rounded(getattr(f, name)().df, "l_quantity", "l_tax", digits=3)

    run.__name__ = f"groupby_{name}"
    query(f"SELECT l_returnflag, l_linestatus, round({sql.format(c='l_quantity')}, 3) AS l_quantity, round({sql.format(c='l_tax')}, 3) AS l_tax FROM lineitem GROUP BY 1, 2")(run)


for _name, _sql in (("sum", "sum({c})"), ("min", "min({c})"), ("max", "max({c})"), ("mean", "avg({c})"), ("std", "stddev_samp({c})")):
    _grouped(_name, _sql)


@query("SELECT n_regionkey, CAST(product(CAST(n_nationkey % 5 + 1 AS DOUBLE)) AS DOUBLE) AS v FROM nation GROUP BY 1")
def groupby_prod(spark, sf_dir):
    f = Frame(table(spark, sf_dir, "nation").select("n_regionkey", (F.col("n_nationkey") % 5 + 1).cast("double").alias("v")))
    return f.groupby("n_regionkey").prod().df


@query("SELECT o_orderstatus, count(*) AS o_custkey FROM orders GROUP BY 1")
def groupby_count(spark, sf_dir):
    return Frame(table(spark, sf_dir, "orders")[["o_orderstatus", "o_custkey"]]).groupby("o_orderstatus").count().df


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def groupby_all_columns(spark, sf_dir):
    return Frame(table(spark, sf_dir, "orders")[["o_orderstatus", "o_orderpriority"]]).groupby(["o_orderstatus", "o_orderpriority"]).sum().df


# set operations, dates, user functions


@query("SELECT n_nationkey AS k, n_name AS name, CAST(NULL AS INTEGER) AS extra FROM nation UNION ALL SELECT r_regionkey, r_name, r_regionkey * 2 FROM region")
def union_by_name(spark, sf_dir):
    a = Frame(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")))
    b = Frame(table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("k"), (F.col("r_regionkey") * 2).alias("extra")))
    return a.append(b).df


@query("SELECT o_orderkey, CAST(DATE '1950-01-01' + CAST(o_orderkey % 20000 AS INTEGER) AS DATE) AS d FROM orders", "days_to_date")
def days_to_date_query(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", days_to_date(F.col("o_orderkey") % 20000).alias("d"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y%m') AS ym FROM orders")
def year_month_str(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", year_month("o_orderdate").alias("ym"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS ym FROM orders")
def year_month_int(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", year_month("o_orderdate", as_int=True).alias("ym"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders", "date_text")
def date_text_query(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", date_text("o_orderdate").alias("d"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status FROM orders", "relabel")
def relabel_query(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", relabel("o_orderstatus", {"F": "filled", "O": "open"}).alias("status"))


@query("SELECT n_nationkey, n_nationkey + 2 AS v, greatest(n_nationkey, n_regionkey) - least(n_nationkey, n_regionkey) AS w FROM nation")
def map_expr(spark, sf_dir):
    f = nation(spark, sf_dir).assign("k", F.col("n_nationkey"))
    k = f["k"]
    f = f.assign("v", k.map(lambda c: c + 2)).assign("w", k.map(lambda a, b: F.when(a > b, a - b).otherwise(b - a), [f["n_regionkey"]]).column)
    return f[["v", "w"]].df


@query("SELECT n_nationkey, n_regionkey + 2 AS v, n_regionkey * n_nationkey AS w FROM nation")
def map_udf(spark, sf_dir):
    f = nation(spark, sf_dir).assign("k", F.col("n_nationkey"))
    r = f["n_regionkey"]
    f = f.assign("v", r.map_native(lambda s: s + 2).column).assign("w", r.map_native(lambda a, b: a * b, [f["k"]]).column)
    return f[["v", "w"]].df


@query("SELECT event_id, ts FROM events WHERE ts BETWEEN (SELECT min(ts) FROM events) AND (SELECT min(ts) FROM events) + INTERVAL 1 DAY")
def time_range(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts")
    first = e.agg(F.min("ts")).first()[0]
    return e.where(F.col("ts").between(F.lit(first), F.lit(first) + F.expr("INTERVAL 1 DAY")))


# sources and sinks


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_roundtrip(spark, sf_dir):
    path = f"{shared_folder(spark)}/nation.csv"
    nation(spark, sf_dir).to_csv(path)
    return read_csv(spark, path, schema="n_nationkey int, n_name string, n_regionkey int").df


CDL = """netcdf sample {
dimensions:
  longitude = 2 ;
  latitude = 3 ;
  time = 2 ;
variables:
  float longitude(longitude) ;
  float latitude(latitude) ;
  int time(time) ;
    time:units = "days since 1950-01-01" ;
    time:calendar = "standard" ;
  short tg(time, latitude, longitude) ;
    tg:_FillValue = -9999s ;
    tg:scale_factor = 0.01f ;
data:
  longitude = 25.5, 26 ;
  latitude = 10, 11, 12 ;
  time = 0, 31 ;
  tg = 100, 200, 300, 400, 500, 600, _, 800, 900, 1000, 1100, 1200 ;
}
"""


@query(
    """SELECT CAST(25.5 + 0.5 * x AS FLOAT) AS longitude, CAST(10 + y AS FLOAT) AS latitude, CAST(DATE '1950-01-01' + CAST(31 * t AS INTEGER) AS DATE) AS time,
    CAST(CASE WHEN t = 1 AND y = 0 AND x = 0 THEN CAST(-9999 AS FLOAT) ELSE CAST(100 * (6 * t + 2 * y + x + 1) AS FLOAT) END * CAST(0.01 AS FLOAT) AS FLOAT) AS tg
    FROM (SELECT range AS x FROM range(2)), (SELECT range AS y FROM range(3)), (SELECT range AS t FROM range(2))"""
)
def grid_cdl(spark, sf_dir):
    path = f"{shared_folder(spark)}/sample.cdl"
    formats.save(path, CDL.encode())
    return read_grid(spark, path).keyed().df


#: suppliers as a grid of packed balances, written in each of the formats and read again
_CELLS = "SELECT s_nationkey, s_suppkey, CAST(s_acctbal AS FLOAT) AS balance FROM supplier"


def _supplier_grid(spark, sf_dir, form: str) -> Frame:
    path = f"{shared_folder(spark)}/supplier.nc"
    cells = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", F.col("s_acctbal").cast("float").alias("balance"))
    Frame(cells, ("s_nationkey", "s_suppkey")).to_grid(path, form)
    return read_grid(spark, path)


@query(_CELLS)
def grid_classic(spark, sf_dir):
    f = _supplier_grid(spark, sf_dir, "classic")
    return f[f["balance"] < 1e30].keyed().df


@query(_CELLS)
def grid_hdf5(spark, sf_dir):
    f = _supplier_grid(spark, sf_dir, "netcdf4")
    return f[f["balance"] < 1e30].keyed().df


_ALL_CELLS = f"""SELECT s_nationkey, s_suppkey, coalesce(balance, CAST(9.96921e36 AS FLOAT)) AS balance, row_number() OVER (ORDER BY s_nationkey, s_suppkey) - 1 AS rn
    FROM (SELECT DISTINCT s_nationkey FROM supplier) CROSS JOIN (SELECT DISTINCT s_suppkey FROM supplier) LEFT JOIN ({_CELLS}) USING (s_nationkey, s_suppkey)"""


@query(f"SELECT s_nationkey, s_suppkey, balance FROM ({_ALL_CELLS}) WHERE rn < 12")
def grid_head(spark, sf_dir):
    return _supplier_grid(spark, sf_dir, "netcdf4").head(12).keyed().df


@query(f"SELECT s_nationkey, s_suppkey, balance FROM ({_ALL_CELLS}) WHERE rn >= 7 AND rn < 40")
def grid_slice(spark, sf_dir):
    return _supplier_grid(spark, sf_dir, "classic")[7:40].keyed().df


@query(f"{_CELLS} WHERE s_nationkey BETWEEN 5 AND 12")
def grid_subset(spark, sf_dir):
    f = _supplier_grid(spark, sf_dir, "netcdf4").subset("s_nationkey", 5, 12)
    return f[f["balance"] < 1e30].keyed().df


# the pipeline

_SENTINELS = {"tg": 25.0, "pp": 0.0, "rr": 0.0}
_CLEAN = f"""WITH j AS (SELECT *, row_number() OVER (ORDER BY l_suppkey, l_linenumber, d) - 1 AS rn, count(*) OVER () AS n FROM ({_GRID1}) JOIN ({_GRID2}) USING (l_suppkey, l_linenumber, d)),
c AS (SELECT *, abs(tx - tn) AS abs_diff FROM j WHERE rn >= n // 6 AND rn < n // 2 AND tg <> 25 AND pp <> 0 AND rr <> 0)"""


def _joined(spark, sf_dir) -> tuple[Frame, tuple[int, int]]:
    joined = grid(spark, sf_dir, 1).merge(grid(spark, sf_dir, 2)).cache()  # counted, then sliced
    n = len(joined)
    return joined, (n // 6, n // 2)


def _analysed(spark, sf_dir):
    joined, rows = _joined(spark, sf_dir)
    return pipeline.analyse(joined, rows, keys=GRID_KEYS, sentinels=_SENTINELS, dropped=())


@query(f"SELECT l_suppkey, l_linenumber, d, round(tg, 4) AS tg, pp, rr, tn, tx FROM ({_GRID1}) JOIN ({_GRID2}) USING (l_suppkey, l_linenumber, d) ORDER BY 1, 2, 3 LIMIT 10")
def pipeline_head(spark, sf_dir):
    return rounded(_joined(spark, sf_dir)[0].head(10).df, "tg")


@query(
    f"""WITH s AS (SELECT *, row_number() OVER (ORDER BY l_suppkey, l_linenumber, d) - 1 AS rn FROM ({_GRID1}))
    SELECT 'tg' AS "column", round(sum(tg), 2) AS sum FROM s WHERE rn >= 100 AND rn < 3000 UNION ALL SELECT 'rr', round(sum(rr), 2) FROM s WHERE rn >= 100 AND rn < 3000"""
)
def pipeline_mini(spark, sf_dir):
    """Slice, drop, sum: the short form of the pipeline."""
    return rounded(grid(spark, sf_dir, 1)[100:3000].drop(["pp", "absent"]).sum(), "sum", digits=2)


_COLUMNS = ("tg", "pp", "rr", "tn", "tx", "abs_diff")


@query(_CLEAN + " " + _stats_sql(("min", "max", "mean", "std"), _COLUMNS, "c"))
def pipeline_agg(spark, sf_dir):
    return rounded(_analysed(spark, sf_dir)[0], *_COLUMNS, digits=2)


@query(
    _CLEAN
    + ", m AS (SELECT l_suppkey, l_linenumber, strftime(d, '%Y%m') AS ym, "
    + ", ".join(f"avg({c}) AS {c}" for c in pipeline.MEANS)
    + " FROM c GROUP BY ALL) "
    + " UNION ALL ".join(f"SELECT '{c}_mean' AS \"column\", round(sum({c}), 2) AS grouped_sum FROM m" for c in pipeline.MEANS)
)
def pipeline_grouped(spark, sf_dir):
    return rounded(_analysed(spark, sf_dir)[1], "grouped_sum", digits=2)
