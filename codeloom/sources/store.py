"""Where graphs are kept: generations of nodes and edges, committed by a pointer, with a fallback."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs that the history keeps.
HISTORY = 50


class GraphStore:
    """Nodes and edges by generation under one folder.

    A generation is written whole and becomes visible when its marker is written
    after it, so a job that dies leaves the generation before. `load` falls back to
    the newest older generation whose tables can be read, then to a legacy JSON
    export. Any Hadoop file system will do.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _path(self, generation: int, table: str) -> str:
        return f"{self.folder}/generation={generation}/{table}"

    def generations(self) -> list[int]:
        """Committed generations, the newest first."""
        fs, where = self._fs(self.folder)
        if not fs.exists(where):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        out = [int(n.split("=")[1]) for n in names if n.startswith("generation=")]
        return sorted((g for g in out if fs.exists(self._fs(self._path(g, "_COMMITTED"))[1])), reverse=True)

    def save(self, nodes: DataFrame, edges: DataFrame, generation: int) -> None:
        for name, table in (("nodes", nodes), ("edges", edges)):
            # by type, so that questions about one type read one folder
            table.write.mode("overwrite").partitionBy("type").parquet(self._path(generation, name))
        fs, marker = self._fs(self._path(generation, "_COMMITTED"))
        fs.create(marker, True).close()

    def load(self, legacy_json: str | None = None) -> tuple[DataFrame, DataFrame, int | None]:
        """Nodes, edges and their generation; raises FileNotFoundError if nothing can be read."""
        for g in self.generations():
            try:
                nodes, edges = (self.spark.read.parquet(self._path(g, t)) for t in ("nodes", "edges"))
                nodes.limit(1).count(), edges.limit(1).count()
                return nodes, edges, g
            except Exception:
                continue
        if legacy_json:
            return *self.import_json(legacy_json), None
        raise FileNotFoundError(self.folder)

    def import_json(self, path: str) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges of one JSON document with the arrays nodes and edges; edges without end points are kept."""
        doc = self.spark.read.option("multiLine", True).json(path)
        if not {"nodes", "edges"} <= set(doc.columns):
            raise ValueError("no graph: the arrays nodes and edges are needed")
        return doc.select(F.explode("nodes").alias("x")).select("x.*"), doc.select(F.explode("edges").alias("x")).select("x.*")

    def export(self, nodes: DataFrame, edges: DataFrame, folder: str) -> None:
        """JSON lines, compressed."""
        for name, table in (("nodes", nodes), ("edges", edges)):
            table.write.mode("overwrite").option("compression", "gzip").json(f"{folder.rstrip('/')}/{name}")

    def clear(self) -> None:
        fs, where = self._fs(self.folder)
        fs.delete(where, True)

    def size(self) -> int:
        """Bytes kept."""
        fs, where = self._fs(self.folder)
        return fs.getContentSummary(where).getLength() if fs.exists(where) else 0


def record_run(history: DataFrame, run: DataFrame) -> DataFrame:
    """The history (generation, ...) with a run added, the latest HISTORY kept."""
    return history.unionByName(run, allowMissingColumns=True).orderBy(F.desc("generation")).limit(HISTORY)


def save_history(history: DataFrame, path: str) -> None:
    """Write the history as JSON lines, as load_history reads them; HISTORY rows at most."""
    history.orderBy(F.desc("generation")).limit(HISTORY).coalesce(1).write.mode("overwrite").json(path)


def write_artifacts(artifacts: list[dict], folder: str) -> tuple[list[str], list[str]]:
    """Write the selected artifacts (path, content, selected) below a folder; (written, failed) paths. A path that leads out of the folder fails."""
    written, failed = [], []
    root = os.path.realpath(folder)
    for a in artifacts:
        if not a.get("selected"):
            continue
        where = os.path.realpath(os.path.join(root, a["path"]))
        try:
            if os.path.commonpath([root, where]) != root:
                raise OSError("outside the folder")
            os.makedirs(os.path.dirname(where), exist_ok=True)
            with open(where, "w", encoding="utf-8") as f:
                f.write(a.get("content") or "")
            written.append(a["path"])
        except OSError:
            failed.append(a["path"])
    return written, failed


def load_history(spark: SparkSession, path: str) -> DataFrame:
    """generation, trigger, n_files, n_nodes, n_edges, duration_ms of the runs; broken lines are left out."""
    schema = "generation int, trigger string, n_files long, n_nodes long, n_edges long, duration_ms long, _broken string"
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    return rows.filter("generation IS NOT NULL").drop("_broken")


def history_summary(history: DataFrame) -> DataFrame:
    """One row: current generation, runs, last full and last incremental generation."""
    last = lambda t: F.max(F.when(F.col("trigger") == t, F.col("generation")))
    return history.agg(F.max("generation").alias("current"), F.count("*").alias("runs"), last("full-scan").alias("last_full"), last("incremental").alias("last_incremental"))


def to_json(df: DataFrame) -> str:
    """A small report as JSON text, for the edge of the engine."""
    return json.dumps([r.asDict(recursive=True) for r in df.collect()], default=str)


__all__ = ["HISTORY", "GraphStore", "history_summary", "load_history", "record_run", "save_history", "to_json", "write_artifacts"]
