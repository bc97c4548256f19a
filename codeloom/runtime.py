"""Lineage cuts and size-checked broadcasts shared by the operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Largest table, in rows and in bytes as written, that `small` lets a join broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 16 * 1024 * 1024

_kept: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; only where none is named and Spark runs on this machine alone (tests), one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("name a folder that all machines share in spark.checkpoint.dir")
    own = getattr(spark.sparkContext, "_codeloom_dir", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="codeloom-")
        spark.sparkContext._codeloom_dir = own
    return own


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _kept.discard(path)


def cut(df: DataFrame) -> DataFrame:
    """Write `df` into the shared folder and read it back: the lineage ends there.

    The table survives lost executors. `release` removes one that is no longer
    needed; what is left goes when the Python process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/codeloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _kept:
        atexit.register(_sweep)
    _kept.add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._codeloom_path = path
    return out


def release(*tables: DataFrame) -> None:
    for t in tables:
        path = getattr(t, "_codeloom_path", None)
        if path in _kept:
            _delete(t.sparkSession, path)


def _sweep() -> None:
    spark = SparkSession.getActiveSession()
    for path in list(_kept):
        try:
            _delete(spark, path)
        except Exception:
            return


def written_bytes(table: DataFrame) -> int | None:
    """Bytes of a table that `cut` wrote; None for others."""
    path = getattr(table, "_codeloom_path", None)
    if path is None:
        return None
    jvm, spark = table.sparkSession.sparkContext._jvm, table.sparkSession
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def small(table: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast if the written table `table` has at most `rows` rows and `most` bytes; else join by shuffle."""
    size = written_bytes(table)
    return F.broadcast(table) if (size is None or size <= most) and table.limit(rows + 1).count() <= rows else table


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranked(df: DataFrame, name: str, *order, one_task: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with its place (from 1) in the whole order, without one task that sorts all rows.

    Rows are spread by ranges of the order and counted; a row's place is its place in
    its range after all rows of the ranges before. `order` must tell all rows apart.
    At most one_task rows are sorted at once, with the same result.
    """
    df = cut(df)
    if df.limit(one_task + 1).count() <= one_task:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))
    spread = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = spread.groupBy("_part").agg(F.count("*").alias("_n"))
    before = before.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # one row a partition
    out = spread.join(F.broadcast(before), "_part").withColumn(name, F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.col("_before"))
    return out.drop("_part", "_before")
