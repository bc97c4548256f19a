"""Change-driven updates: a stream of file events keeps the graph's files current."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeloom.operators.graph import remove_nodes

#: Events: path, kind (update or delete), content, at.
EVENTS = "path string, kind string, content string, at timestamp"


def read_events(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Events dropped into a folder as JSON lines."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).json(folder)


def last_of_each(events: DataFrame) -> DataFrame:
    """The last event of each path in a batch: what was typed in between is skipped."""
    w = Window.partitionBy("path").orderBy(F.desc("at"), F.desc("kind"))
    return events.filter("path IS NOT NULL").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def apply_batch(files: DataFrame, events: DataFrame, generation: int) -> DataFrame:
    """path, content, hash, generation after a batch: deleted paths go, unchanged ones keep their generation.

    An update with the same hash, or a null path, changes nothing. Deleting an unknown path is no error.
    """
    last = last_of_each(events).withColumn("new_hash", F.substring(F.sha2("content", 256), 1, 16))
    e = last.select("path", F.col("kind").alias("_kind"), F.col("content").alias("_content"), F.col("new_hash").alias("_hash"))
    j = files.join(e, "path", "full_outer").filter("_kind IS NULL OR _kind <> 'delete'")
    same = F.col("_kind").isNull() | F.col("_hash").eqNullSafe(F.col("hash"))
    pick = lambda old, new: F.when(same, F.col(old)).otherwise(new).alias(old)
    return j.select("path", pick("content", F.col("_content")), pick("hash", F.col("_hash")), pick("generation", F.lit(generation)))


def drop_files(nodes: DataFrame, edges: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after a batch: nodes of the paths whose last event is a deletion go, and the edges that touch them."""
    gone = last_of_each(events).filter("kind = 'delete'").select(F.col("path").alias("file_path"))
    return remove_nodes(nodes, edges, nodes.join(gone, "file_path", "left_semi").select("id"))


def live_view(files: DataFrame, path: str, content: str) -> DataFrame:
    """The files as if one of them had the content of an open editor; nothing is kept, and no generation begins."""
    spark = files.sparkSession
    event = spark.createDataFrame([(path, "update", content, None)], EVENTS)
    current = files.agg(F.max("generation")).first()[0]
    return apply_batch(files, event, current or 0)


def follow(events: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Run `on_batch` on each micro-batch of events; the batch's number is the generation."""
    w = events.writeStream.foreachBatch(lambda df, i: on_batch(df, i + 1)).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="300 milliseconds")).start()


def edit_bursts(events: DataFrame, gap: str = "300 milliseconds", late: str = "10 seconds") -> DataFrame:
    """path, begun, ended, n of bursts of edits that follow each other within the gap; a stream needs the watermark to close them."""
    watched = events.withWatermark("at", late) if events.isStreaming else events
    return watched.groupBy(F.session_window("at", gap).alias("w"), "path").agg(F.count("*").alias("n")).select("path", F.col("w.start").alias("begun"), F.col("w.end").alias("ended"), "n")
