"""One object over a folder of tables: what a caller asks by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.columns import normal_path
from codeloom.operators import graph as G
from codeloom.operators import lookups as L
from codeloom.operators import reports as R
from codeloom.operators import search as S
from codeloom.operators import snapshots as SN
from codeloom.operators.context import capability_chain
from codeloom.plans.graph_queries import CYCLE_TYPES
from codeloom.runtime import cut


class Engine:
    """The graph of one folder. Tables are read once and cut, so questions share them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        read = lambda t: spark.read.parquet(f"{folder}/{t}.parquet")
        self.read = read
        self.nodes = cut(G.nodes_of(read("graph_nodes"), read("package_nodes")))
        self.edges = cut(G.merge_edges(read("graph_edges")))

    def _start(self, target: str) -> DataFrame:
        """The node of an id, else the first by name or qualified name."""
        n = self.nodes.filter((F.col("id") == target) | (F.col("name") == target) | (F.col("qualified_name") == target))
        return cut(n.orderBy((F.col("id") != target), "generation_created", "id").limit(1).select("id"))

    def search_codebase(self, query: str, limit: int = 20) -> DataFrame:
        return S.hybrid_search(self.nodes, query, limit)

    def get_node_impact(self, target: str, depth: int = 3) -> DataFrame:
        return G.impact(self.nodes, self.edges, self._start(target), depth)

    def get_capability_chain(self, target: str) -> DataFrame:
        return capability_chain(self.nodes, self.edges, self._start(target))

    def list_api_endpoints(self) -> DataFrame:
        return self.nodes.filter("type = 'api-endpoint'").select("id", "name", "file_path")

    def get_architecture_overview(self) -> DataFrame:
        return R.language_distribution(self.nodes)

    def get_code_quality(self) -> DataFrame:
        return R.maintainability(self.nodes, self.read("parse_results"), self.edges, CYCLE_TYPES)

    def get_documentation_health(self) -> DataFrame:
        return R.doc_health(self.nodes)

    def get_symbols(self, text: str, kind: str | None = None) -> DataFrame:
        return L.search_symbols(L.symbol_index(self.read("parse_results")), text, kind)

    def get_graph_diff(self) -> DataFrame:
        return SN.snapshot_changes(self.read("node_snapshots"))

    def find_path(self, source: str, target: str, directed: bool = False) -> list[str]:
        return G.shortest_path(G.oriented(self.edges, "outgoing" if directed else "both"), source, target)

    def execute_graph_query(self, mode: str, text: str) -> DataFrame:
        """definition, callers, callees, implementations, usages, tests, flow, structural, search; an empty text finds nothing."""
        n, e = self.nodes, self.edges
        limit = {"definition": 30, "structural": 30, "ai": 20}.get(mode, 40)
        first = lambda df: df.orderBy("generation_created", "id").limit(limit).select("id", "type", "name")
        if not text.strip():
            return first(n.filter("false"))
        around = {"callers": ("incoming", ["calls"]), "callees": ("outgoing", ["calls"]), "implementations": ("incoming", ["implements", "extends"]), "usages": ("incoming", G.DEPENDENTS), "tests": ("incoming", ["tests"])}
        if mode in around:
            seed = self._start(text)
            if not seed.limit(1).count():
                seed = cut(G.search_nodes(n, text).orderBy("generation_created", "id").limit(1).select("id"))
            ids = G.neighbors(e, *around[mode]).join(F.broadcast(seed), "id", "left_semi").select(F.col("neighbor").alias("id"))  # one id
            return n.join(ids, "id", "left_semi").select("id", "type", "name")
        if mode == "flow":
            parts = [p.strip() for p in text.replace("=>", "->").split("->") if p.strip()]
            ends = [self._start(p).first() for p in parts[:2]]
            if not ends or any(x is None for x in ends):
                return first(n.filter("false"))
            if len(ends) == 2:
                path = G.shortest_path(G.oriented(e, "both"), ends[0][0], ends[1][0])
                return n.filter(F.col("id").isin(path)).select("id", "type", "name")
            reached = G.bfs(G.oriented(e, "outgoing", G.FLOW), self._start(parts[0]), 6)
            return n.join(reached.orderBy("depth", "id").limit(15), "id").select("id", "type", "name")
        if mode == "structural" and "(n:" in text:
            return first(n.filter(F.col("type") == text.split("(n:")[1].split(")")[0]))
        return first(G.search_nodes(n, text))

    def audit_staleness(self, stories: DataFrame, changed: DataFrame) -> DataFrame:
        return R.stale_stories(stories.withColumn("path", normal_path("path")), changed)

