"""Tables written in the folder that all executors share, to cut a plan's lineage.

Files are removed through the JVM's file system, so these helpers need a classic session
(not Spark Connect).
"""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The tables written by the calls of ``narrow_result`` functions now running, innermost last.
_open: ContextVar[tuple[list[str], ...]] = ContextVar("open_scratch", default=())


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a temporary folder in local mode only: executors elsewhere could not see it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="gleanwork-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def remove(spark: SparkSession, path: str, now: bool = True) -> None:
    """Delete a folder, now or when the session's JVM ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    store.delete(at, True) if now else store.deleteOnExit(at)


def materialize(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """``df`` written once in the shared folder and read back; a lost executor costs a re-read.

    The files go when the ``narrow_result`` function that wrote them returns, or else with the session's JVM.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/gleanwork-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    remove(spark, path, now=False)
    if _open.get():
        _open.get()[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def narrow_result(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A function whose result is small beside what it writes on its way: the result is written too, and all the rest removed."""

    @functools.wraps(f)
    def called(*args, **kwargs) -> DataFrame:
        written: list[str] = []
        token = _open.set((*_open.get(), written))
        try:
            df = f(*args, **kwargs)
        except BaseException:
            _open.reset(token)
            raise
        _open.reset(token)
        out = materialize(df)
        for path in written:
            remove(df.sparkSession, path)
        return out

    return called


def running(rows: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` up to and with each row in ``order``: ranges are sorted apart, and the sums of the ranges before are added."""
    ranges = materialize(rows.withColumn("__value", value).repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sums = ranges.groupBy(F.col("__range").alias("__of")).agg(F.sum("__value").alias("__n"))  # one row per range
    before = sums.select("__of", (F.sum("__n").over(Window.orderBy("__of")) - F.col("__n")).alias("__before"))
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = ranges.withColumn(name, F.sum("__value").over(inside)).join(F.broadcast(before), F.col("__range") == F.col("__of"))
    return joined.withColumn(name, F.col(name) + F.col("__before")).drop("__range", "__of", "__n", "__before", "__value")


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with their place from 1 on in ``order``: ranges are sorted apart, and the counts of the ranges before are added."""
    ranges = materialize(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    counts = ranges.groupBy(F.col("__range").alias("__of")).agg(F.count("*").alias("__n"))  # one row per range
    before = counts.select("__of", (F.sum("__n").over(Window.orderBy("__of")) - F.col("__n")).alias("__before"))
    placed = ranges.withColumn(name, F.row_number().over(Window.partitionBy("__range").orderBy(*order)))
    joined = placed.join(F.broadcast(before), F.col("__range") == F.col("__of"))
    return joined.withColumn(name, F.col(name) + F.col("__before")).drop("__range", "__of", "__n", "__before")
