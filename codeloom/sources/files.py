"""Source trees as tables of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import columns as C

# Fixed value: the size limit of a file where none, or zero, is set.
MAX_BYTES = 3 * 1024 * 1024


def scan(spark: SparkSession, root: str, excludes: list[str] | None = None, max_bytes: int | None = None) -> DataFrame:
    """file_path (below root), language, byte_count, hash, modified, content of the files of known languages.

    Reads with Spark's binary files, so a tree of any size is spread over tasks; what
    is too large or excluded is dropped before its content is read where Spark can.
    Unreadable files are skipped. Bytes that are no UTF-8 become replacement marks.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).load(root)
    below = F.regexp_replace(F.regexp_replace("path", r"^\w+:/*", "/"), "^" + "/" + root.split(":")[-1].strip("/").replace(".", r"\.") + "/+", "")
    f = raw.filter(F.col("length") <= (max_bytes or MAX_BYTES)).withColumn("file_path", below)
    for p in excludes or []:
        f = f.filter(~C.excluded_by("file_path", F.lit(p)))
    f = f.withColumn("language", C.language_of("file_path")).filter("language IS NOT NULL")
    return f.select("file_path", "language", F.col("length").alias("byte_count"), F.substring(F.sha2("content", 256), 1, 16).alias("hash"), F.col("modificationTime").alias("modified"), F.expr("make_valid_utf8(content)").alias("content"))


def skipped(spark: SparkSession, root: str, excludes: list[str] | None = None, max_bytes: int | None = None) -> DataFrame:
    """file_path, error of the files below root that `scan` leaves out: too large, excluded, of no known language, or unreadable.

    The listing is read without contents; what passes its rules but does not come out of the scan is unreadable.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    below = F.regexp_replace(F.regexp_replace("path", r"^\w+:/*", "/"), "^" + "/" + root.split(":")[-1].strip("/").replace(".", r"\.") + "/+", "")
    listed = raw.select(below.alias("file_path"), "length")
    out = F.lit(False)
    for p in excludes or []:
        out = out | C.excluded_by("file_path", F.lit(p))
    why = F.when(F.col("length") > (max_bytes or MAX_BYTES), "too large").when(out, "excluded").when(C.language_of("file_path").isNull(), "unknown language")
    ruled = listed.select("file_path", why.alias("error"))
    read = scan(spark, root, excludes, max_bytes).select("file_path")
    return ruled.filter("error IS NOT NULL").unionByName(ruled.filter("error IS NULL").join(read, "file_path", "left_anti").withColumn("error", F.lit("unreadable")))


def changed(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files that are new or whose hash differs from what is known (file_path, hash)."""
    old = known.select("file_path", F.col("hash").alias("old"))
    return files.join(old, "file_path", "left").filter(~F.col("hash").eqNullSafe(F.col("old"))).drop("old")


def deleted(files: DataFrame, known: DataFrame) -> DataFrame:
    return known.join(files.select("file_path"), "file_path", "left_anti")
