"""Tables written once to the cluster's shared folder to cut lineage.

The folder is the session's ``spark.checkpoint.dir``; where it is unset in local
mode (tests) a temporary folder stands in for it, and on a cluster it must be
set.  Files are removed when the driver ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_roots: dict[str, str] = {}


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of about 4 MB instead of the default 64 MB, in the JVM and in workers.

    Texts are long: at the default, the batches of a few tasks take a fair part
    of an executor's memory.  A size that has been set otherwise stays.
    """
    if spark.conf.get(_BATCH) in ("67108864b", "64m"):
        spark.conf.set(_BATCH, "4m")


def shared_dir(spark: SparkSession) -> str:
    """Folder of this application below ``spark.checkpoint.dir``."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        if not base and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="gridframe-")
        _roots[app] = f"{base.rstrip('/')}/scratch-{app}"
        atexit.register(_remove, spark, _roots[app])
    return _roots[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may have gone before the interpreter ends
        pass


def table(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")  # the plan runs once: its shuffle files go when it ends
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def placement(spark: SparkSession, n: int) -> list[int]:
    """For each of n partitions a number that ``repartition(n, number)`` sends there."""
    from pyspark.sql import functions as F

    rows = spark.range(40 * n).select(F.col("id").cast("int").alias("id"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("at"))
    got = {r.at: r.id for r in rows.groupBy("at").agg(F.min("id").alias("id")).collect()}
    return [got.get(i, i) for i in range(n)]


#: bytes of input for each partition of data that a task holds in memory; partitions from which on they take more
PART_BYTES, MANY, LARGE_BYTES = 8 << 20, 20_000, 256 << 20


def partitions(spark: SparkSession, df: DataFrame | None = None) -> int:
    """Partitions of a shuffle: the session's number, and more where the input that ``df`` reads asks for it.

    The size is the optimizer's estimate (of files: theirs); where it has none
    the session's number counts alone.  Tasks hold about ``PART_BYTES`` of input
    up to ``MANY`` partitions, and ``LARGE_BYTES`` at most beyond.
    """
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if df is None:
        return n
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:  # unknown
        return n
    return max(n, min(-(-size // PART_BYTES), MANY), -(-size // LARGE_BYTES))
