"""Orphan references, snapshot changes and hierarchies on small tables, against brute force."""

import random

import pytest

from codeloom.operators import hierarchy as H
from codeloom.operators import references as R
from codeloom.operators import snapshots as S

EDGE = "edge_id string, source string, target string, type string, resolution string, confidence double, evidence array<struct<type:string,source:string,description:string,resolution:string,confidence:double>>, generation_created int, generation_verified int, observed_at timestamp"
NODE = "id string, type string, name string, qualified_name string, description string, file_path string, language string, generation_created int, generation_updated int, generation_removed int, loaded_at timestamp"
PACKAGE = "id string, name string, version string, registry string, generation_created int, generation_removed int"
SNAP = "repo string, generation int, id string, type string, name string, description string, path string, language string, hash string, size long, generation_updated int, loaded_at timestamp"


def edge(i, s, t, g=5, kind="contains", conf=0.9):
    return (i, s, t, kind, "resolved", conf, [], 1, g, None)


def node(i, born, gone=None, kind="file"):
    return (i, kind, None, None, None, None, None, born, None, gone, None)


def test_orphan_reasons(spark):
    edges = spark.createDataFrame(
        [
            edge("e1", "a", "b"),
            edge("e1", "a", "gone", g=3),  # superseded
            edge("e2", " \ta\\x ", "late"),
            edge("e3", "gone", "back"),
            edge("e4", None, "  "),
            edge("e5", "A", "ext:p"),
            edge("e6", "never", "a", g=None),
            edge("e6", "never", "a", g=None),
        ],
        EDGE,
    )
    nodes = spark.createDataFrame([node("a", 1), node("a", 1), node("b", 5, 6), node("a/x", 1), node("late", 6), node("gone", 1, 5), node("back", 1, 3), node("back", 5), node(None, 1)], NODE)
    packages = spark.createDataFrame([("ext:p", "p", None, None, 2, 4)], PACKAGE)
    found = {tuple(r) for r in R.orphan_references(edges, nodes, packages).collect()}
    assert found == {("e2", "target", "late"), ("e3", "source", "deleted"), ("e5", "source", "missing"), ("e5", "target", "deleted"), ("e6", "source", "missing")}
    report = {(r.node_table, r.generation, r.reason): r.n_sources + r.n_targets for r in R.orphan_report(edges, nodes, packages).collect()}
    assert report[("package_nodes", 5, "deleted")] == 1 and sum(report.values()) == len(found)


def test_orphans_of_empty_tables_and_extra_columns(spark):
    from pyspark.sql import functions as F

    edges, nodes, packages = (spark.createDataFrame([], s) for s in (EDGE, NODE, PACKAGE))
    assert R.orphan_references(edges, nodes, packages).count() == 0
    one = spark.createDataFrame([edge("e", "x" * 100_000, "y")], EDGE).withColumn("k", F.lit(1)).withColumn("reason", F.lit("?")).withColumn("lives", F.lit(1))
    assert {tuple(r) for r in R.orphan_references(one, nodes.withColumn("k", F.lit(1)), packages).collect()} == {("e", "source", "missing"), ("e", "target", "missing")}


def snap(repo, g, i, name="n", desc=None, kind="file", h="h", size=1, at=None):
    import datetime as dt

    return (repo, g, i, kind, name, desc, None, None, h, size, 1, None if at is None else dt.datetime(2025, 1, at))


def test_snapshot_changes(spark):
    t = spark.createDataFrame(
        [
            snap("r", 1, "a"), snap("r", 1, "a"), snap("r", 3, "a", name=None), snap("r", 4, "a", name=None, h="", size=None),
            snap("r", 1, "b", desc=""), snap("r", 3, "b", desc=None), snap("r", 4, "b", h="x", kind="symbol", at=1), snap("r", 4, "b", h="y", kind="symbol", desc="d", at=2),
            snap("r", 3, "c"), snap("r", 1, "d"), snap("r", 4, "d"), snap("s", 2, "a"), snap("r", None, "a"), snap("r", 4, None),
        ],
        SNAP,
    )
    found = {tuple(r) for r in S.snapshot_changes(t).collect()}
    assert found == {
        ("r", 1, 3, "a", "modified", "name"), ("r", 3, 4, "a", "modified", "size"), ("r", 1, 3, "b", "modified", "description"), ("r", 3, 4, "b", "modified", "description,type,content"),
        ("r", 1, 3, "c", "added", ""), ("r", 3, 4, "c", "removed", ""), ("r", 1, 3, "d", "removed", ""), ("r", 3, 4, "d", "added", ""), ("r", 3, 4, None, "added", ""),
    }
    assert S.snapshot_changes(t.limit(0)).count() == 0


def brute_hierarchy(edges):
    best = {}
    for e, s, t, kind, c, g in edges:
        if e not in best or (g or -1) > (best[e][4] or -1):
            best[e] = (s, t, kind, c, g)
    ids, up = set(), {}
    for s, t, kind, c, _ in best.values():
        if kind == "contains" and s and t:
            ids |= {s, t}
            up[t] = min(up.get(t, (9, "")), (-(c or 0), s))
    up = {t: s for t, (_, s) in up.items()}
    out = {}
    for i in ids:
        seen, x = [i], i
        while x in up and up[x] not in seen:
            x = up[x]
            seen.append(x)
        if x not in up:
            out[i] = ["tree", x, len(seen) - 1, 0]
        else:
            loop, y = [up[x]], up[up[x]]
            while y != up[x]:
                loop.append(y)
                y = up[y]
            out[i] = ["cycle" if i in loop else "below", "", -1, -1]
    for i in ids:
        x = i
        while out[i][0] == "tree" and x in up:
            x = up[x]
            out[x][3] += 1
    return {(i, *v) for i, v in out.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_hierarchy_against_brute_force(spark, seed):
    r = random.Random(seed)
    names = [f"n{i}" for i in range(40)]
    rows = [(f"e{k}", r.choice([*names[: 3 + k % 37], None, "hub"]), r.choice(names), r.choice(["contains"] * 6 + ["calls"]), r.choice([None, 0.5, 0.9]), r.choice([None, 1, 2])) for k in range(70)]
    rows += [("loop", "s", "s", "contains", None, 1), *((f"c{i}", f"chain{i}", f"chain{i + 1}", "contains", 1.0, 1) for i in range(60)), *((f"h{i}", "hub2", f"leaf{i}", "contains", 1.0, 1) for i in range(300))]
    df = spark.createDataFrame([(e, s, t, k, "resolved", c, [], 1, g, None) for e, s, t, k, c, g in rows], EDGE)
    nodes, packages = spark.createDataFrame([node("chain0", 1, kind="repository"), node("chain0", 2, kind="project")], NODE), spark.createDataFrame([("hub2", "p", None, None, 1, None)], PACKAGE)
    found = H.hierarchy(df, nodes, packages).collect()
    assert {(x.id, x.status, x.root_id, x.depth, x.n_descendants) for x in found} == brute_hierarchy(rows)
    kinds = {x.id: x.root_type for x in found}
    assert kinds["chain5"] == "project" and kinds["leaf3"] == "ext" and kinds["s"] == ""
    path = {x.id: (x.depth, x.path) for x in H.paths(df).collect()}
    assert path["chain2"] == (2, "chain0 > chain1 > chain2") and "s" not in path
    spans = {x.id: x for x in H.descendants(df).collect()}
    inside = lambda y, x: spans[y].root_id == spans[x].root_id and spans[x].leave <= spans[y].leave and spans[y].entry < spans[x].entry
    assert inside("chain7", "chain3") and not inside("chain3", "chain7")


def test_hierarchy_of_nothing(spark):
    empty = spark.createDataFrame([], EDGE)
    assert H.hierarchy(empty, spark.createDataFrame([], NODE), spark.createDataFrame([], PACKAGE)).count() == 0
    blank = spark.createDataFrame([edge("e", None, "x"), edge("f", " ", "y"), edge("g", "a", "b", kind=None)], EDGE)
    assert H.hierarchy(blank, spark.createDataFrame([], NODE), spark.createDataFrame([], PACKAGE)).count() == 0
