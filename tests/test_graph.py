"""Graph questions on hand-made graphs."""

import pytest
from test_data_problems import EDGE, NODE, PACKAGE, edge, node

from codeloom.operators import graph as G
from codeloom.operators import reports as R


@pytest.fixture(scope="module")
def chain(spark):
    e = [edge("1", "ctrl", "svc", kind="calls"), edge("2", "svc", "repo", kind="calls"), edge("3", "repo", "model", kind="depends-on"), edge("4", "t", "svc", kind="tests")]
    n = [node(i, k + 1, kind="component") for k, i in enumerate(("ctrl", "svc", "repo", "model"))] + [node("t", 9, kind="test-suite")]
    return G.nodes_of(spark.createDataFrame(n, NODE), spark.createDataFrame([], PACKAGE)), G.merge_edges(spark.createDataFrame(e, EDGE))


def test_merge_keeps_the_surest(spark):
    rows = [("a", "f1", "f2", "imports", "heuristic", 0.5, [("x", "s", "d", "heuristic", 0.5)], 1, 1, None), ("b", "f1", "f2", "imports", "confirmed", 0.9, [("y", "s", "d", "confirmed", 0.9)], 1, 2, None), ("c", "f1", None, "imports", None, None, None, 1, 2, None)]
    merged = G.merge_edges(spark.createDataFrame(rows, EDGE)).collect()
    assert [(m.confidence, m.resolution, m.n_evidence, m.generation_verified) for m in merged] == [(0.9, "confirmed", 2, 2)]


def test_traversal(spark, chain):
    nodes, edges = chain
    start = spark.createDataFrame([("ctrl",)], "id string")
    assert {(r.id, r.depth) for r in G.bfs(G.oriented(edges, "outgoing"), start, 3).collect()} == {("ctrl", 0), ("svc", 1), ("repo", 2), ("model", 3)}
    assert G.shortest_path(G.oriented(edges), "ctrl", "model") == ["ctrl", "svc", "repo", "model"]
    assert G.shortest_path(G.oriented(edges), "ctrl", "ctrl") == ["ctrl"] and G.shortest_path(G.oriented(edges), "ctrl", "nowhere") == []
    assert G.bfs(G.oriented(edges), spark.createDataFrame([], "id string"), 3).count() == 0


def test_impact_and_tests(spark, chain):
    nodes, edges = chain
    found = {(r.id, r.kind) for r in G.impact(nodes, edges, spark.createDataFrame([("repo",)], "id string"), 3).collect()}
    assert found == {("svc", "direct"), ("ctrl", "transitive"), ("t", "test")}
    assert {r.id for r in G.components_without_tests(nodes, edges).collect()} == {"ctrl", "repo", "model"}


def test_remove_cascades(spark, chain):
    nodes, edges = chain
    left, kept = G.remove_nodes(nodes, edges, spark.createDataFrame([("svc",)], "id string"))
    assert left.count() == 4 and [(r.source, r.target) for r in kept.collect()] == [("repo", "model")]


def test_cycles(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("e", "f"), ("x", "x")]
    edges = G.merge_edges(spark.createDataFrame([edge(str(k), s, t, kind="imports") for k, (s, t) in enumerate(pairs)], EDGE))
    assert {(r.id, r.component, r["size"]) for r in G.strongly_connected(edges, ["imports"]).collect()} == {("a", "a", 3), ("b", "a", 3), ("c", "a", 3), ("d", "d", 2), ("e", "d", 2)}
    assert {r.cycle for r in G.short_cycles(edges, ["imports"]).collect()} == {"a > b > c", "d > e"}
    assert G.strongly_connected(edges.limit(0), ["imports"]).count() == 0


def test_staleness(spark):
    s = spark.createDataFrame([("s1", 0, "src\\a\\login.ts"), ("s1", 1, "x.ts"), ("s2", 0, "b.ts"), ("s3", 0, ""), ("s4", 0, None), ("s5", 0, "other/long/path/file.ts")], "story_id string, place int, path string")
    f = spark.createDataFrame([("app/src/a/login.ts",), ("lib/ab.ts",), ("x.ts",)], "path string")
    assert {tuple(r) for r in R.stale_stories(s, f).collect()} == {("s1", "src\\a\\login.ts"), ("s2", "b.ts")}
