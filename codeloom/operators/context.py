"""Context packages: what surrounds a feature, its chain of stages, its gaps, and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import columns as C
from codeloom.operators import graph as G
from codeloom.runtime import cut

# Stages of a capability chain: (place, name, condition on id, type, role, layer, file_path; confidence if found).
STAGES = [
    (3, "existing-ui", "layer = 'presentation' OR file_path LIKE '%/ui/%' OR file_path LIKE '%/pages/%'", 0.9),
    (4, "frontend-component", "role IN ('component', 'store', 'hook')", 0.9),
    (5, "api-endpoint", "type = 'api-endpoint'", 0.9),
    (6, "backend-controller", "role IN ('controller', 'handler')", 0.85),
    (7, "service-layer", "role = 'service'", 0.85),
    (8, "shared-library", "role IN ('utility', 'shared')", 0.75),
    (9, "data-configuration", "type = 'database-table' OR role IN ('model', 'repository', 'configuration') OR layer = 'data-access'", 0.85),
    (10, "existing-tests", "type = 'test-suite'", 0.95),
]
NOT_FOUND = 0.5


def described(nodes: DataFrame) -> DataFrame:
    """Nodes with the layer and role that their paths show."""
    path = F.coalesce("file_path", F.lit(""))
    return nodes.withColumns({"layer": C.layer_of(path), "role": C.role_of(path, "language")})


def seeds(nodes: DataFrame, words: list[str]) -> DataFrame:
    """id, relevance of the nodes that hold one of the words; the best word counts."""
    parts = None
    for w in words:
        hit = G.search_nodes(nodes, w).select("id", C.relevance("name", F.lit(w)).alias("relevance"))
        parts = hit if parts is None else parts.unionByName(hit)
    return parts.groupBy("id").agg(F.max("relevance").alias("relevance"))


def capability_chain(nodes: DataFrame, edges: DataFrame, starts: DataFrame, depth: int = 2) -> DataFrame:
    """place, stage, id, confidence: the first node of each stage in the feature's subgraph, by depth of insertion (generation_created, id)."""
    near = cut(described(nodes.join(G.feature_subgraph(nodes, edges, starts, depth), "id", "left_semi")).select("id", "type", "layer", "role", "file_path", "generation_created"))
    first = near.agg(*(F.min(F.when(F.expr(cond), F.struct("generation_created", "id"))).alias(f"s{place}") for place, _, cond, _ in STAGES))
    rows = F.array(*(F.struct(F.lit(place).alias("place"), F.lit(name).alias("stage"), F.col(f"s{place}.id").alias("id"), F.when(F.col(f"s{place}").isNotNull(), sure).otherwise(NOT_FOUND).alias("confidence")) for place, name, _, sure in STAGES))
    ends = F.array(F.struct(F.lit(1).alias("place"), F.lit("feature-request").alias("stage"), F.lit(None).cast("string").alias("id"), F.lit(1.0).alias("confidence")), F.struct(F.lit(11).alias("place"), F.lit("related-workflows").alias("stage"), F.lit(None).cast("string").alias("id"), F.lit(0.7).alias("confidence")))
    return first.select(F.explode(F.concat(rows, ends)).alias("x")).select("x.*")


def gaps(chain: DataFrame) -> DataFrame:
    """stage of what the feature lacks: components without tests, a controller without service, or all."""
    have = chain.agg(*(F.bool_or((F.col("stage") == s) & F.col("id").isNotNull()).alias(k) for s, k in (("frontend-component", "c"), ("existing-tests", "t"), ("backend-controller", "h"), ("service-layer", "s"))), F.count("id").alias("n"))
    found = F.array_compact(F.array(F.when(F.expr("c AND NOT t"), "tests"), F.when(F.expr("h AND NOT s"), "service"), F.when(F.col("n") == 0, "nothing-found")))
    return have.select(F.explode(found).alias("gap"))


def layer_groups(nodes: DataFrame, k: int = 8) -> DataFrame:
    """layer, n, first: nodes of each layer and the first k ids, by generation, then id."""
    d = described(nodes).select("layer", "id", "generation_created")
    r = d.withColumn("r", F.row_number().over(Window.partitionBy("layer").orderBy("generation_created", "id")))
    top = r.filter(F.col("r") <= k).groupBy("layer").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "id"))), lambda x: x["id"]), ",").alias("first"))  # k rows a layer
    return d.groupBy("layer").agg(F.count("*").alias("n")).join(top, "layer")


def dependency_summary(nodes: DataFrame, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """neighbor, kind: what the seeds depend on, internal or external."""
    d = G.neighbors(edges, "outgoing", G.DEPENDENCIES).join(starts.select("id"), "id", "left_semi").select("neighbor").distinct()
    return d.join(nodes.select(F.col("id").alias("neighbor"), "type"), "neighbor").select("neighbor", F.when(F.col("type") == "external-dependency", "external").otherwise("internal").alias("kind"))


def prompt_quality(prompts: DataFrame) -> DataFrame:
    """doc_id, n_keywords, tokens, budget, reduction of prompts (doc_id, text)."""
    t = C.token_estimate("text")
    return prompts.select("doc_id", F.size(C.keywords("text", 6)).alias("n_keywords"), t.alias("tokens"), F.least(F.greatest(t * 4, F.lit(768)), F.lit(12000)).alias("budget"), C.floor_round(C.token_reduction(t), 4).alias("reduction"))


# Node types that come first in the evidence for a task.
TASK_TYPES = {"implementation": ["component", "api-endpoint", "service"], "testing": ["test-suite"]}


def prompt_evidence(nodes: DataFrame, prompt: str, task: str = "implementation", limit: int = 10) -> DataFrame:
    """id, type, name of the nodes that the prompt's first six words find, the task's types first, then by name."""
    words = nodes.sparkSession.range(1).select(C.keywords(F.lit(prompt), 6)).first()[0]
    if not words:
        return nodes.filter("false").select("id", "type", "name")
    found = nodes.join(seeds(nodes, words).select("id"), "id", "left_semi")
    first = F.col("type").isin(TASK_TYPES.get(task, []))
    return found.orderBy(first.desc(), F.asc_nulls_first("name"), "id").limit(limit).select("id", "type", "name")


def context_seeds(semantic: DataFrame, by_word: DataFrame, active: DataFrame) -> DataFrame:
    """id, relevance: the active file's nodes (id) at 1, else the semantic hits (id, score) at a fifth of the score, at most 1, else the word hits."""
    every = active.select("id", F.lit(0).alias("p"), F.lit(1.0).alias("relevance")).unionByName(semantic.select("id", F.lit(1).alias("p"), F.least(F.col("score") / 5, F.lit(1.0)).alias("relevance"))).unionByName(by_word.select("id", F.lit(2).alias("p"), "relevance"))
    return every.groupBy("id").agg(F.min_by("relevance", "p").alias("relevance"))


def feature_context(nodes: DataFrame, near: DataFrame) -> DataFrame:
    """kind, n, first: components, endpoints, tests, modules and layers of a feature's subgraph (id), with the first of each."""
    d = described(nodes.join(near, "id", "left_semi"))
    kind = F.when(F.col("type").isin("component", "api-endpoint", "test-suite", "module"), F.col("type")).otherwise("other")
    return d.groupBy(kind.alias("kind"), "layer").agg(F.count("*").alias("n"), F.min_by("id", F.struct("generation_created", "id")).alias("first"))
