"""The graph as two tables, and the questions asked of it: look-ups, joins, traversals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.columns import clamp01, layer_of, resolution_rank, risk_of
from codeloom.functions.keys import clean_id
from codeloom.functions.rules import LAYER_RULES, PARENTS, RELATIONS
from codeloom.operators.references import latest_edges
from codeloom.runtime import BROADCAST_ROWS, cut, release, small

# Edge types that the questions follow.
DEPENDENCIES = ["imports", "depends-on", "uses-package"]
DEPENDENTS = ["imports", "depends-on", "uses-package", "calls", "api-flow"]
DIRECT_IMPACT = ["imports", "depends-on", "calls", "extends", "implements", "type-reference"]
TRANSITIVE_IMPACT = ["imports", "depends-on", "calls", "extends", "implements"]
API_FLOW = ["api-flow", "calls", "depends-on", "handles-route"]
FLOW = ["api-flow", "handles-route", "calls", "data-flow"]
CONCEPT_RELATIONS = ["belongs-to-concept", "related-concept", "contains"]
# Edge types and node types of each overview; null means all.
OVERVIEWS = {
    "architecture": (["contains", "depends-on", "imports", "api-flow", "handles-route"], ["repository", "project", "application", "service", "module", "component", "api-endpoint"]),
    "dependencies": (["imports", "depends-on", "uses-package"], ["project", "module", "component", "file", "external-dependency"]),
    "calls": (["calls", "instantiates", "api-flow", "communicates-with"], None),
    "flows": (["api-flow", "handles-route", "calls", "data-flow", "publishes-event", "subscribes-event"], None),
    "tests-impact": (["tests", "calls", "depends-on", "imports"], ["test-suite", "component", "service", "api-endpoint", "module"]),
}


def upsert_nodes(rows: DataFrame) -> DataFrame:
    """One row per id of the deliveries: the last written wins, in the order of generation_created, generation_updated, loaded_at.

    Null ids are no nodes; repeated rows are one.
    """
    w = Window.partitionBy("id").orderBy(F.desc("generation_created"), F.desc_nulls_last("generation_updated"), F.desc_nulls_last("loaded_at"))
    return rows.filter("id IS NOT NULL").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def nodes_of(graph_nodes: DataFrame, packages: DataFrame) -> DataFrame:
    """id, type, name, qualified_name, description, file_path, language, generations; packages are nodes of type external-dependency.

    The order of insertion, which first matches and limits go by, is (generation_created, id).
    """
    columns = ["id", "type", "name", "qualified_name", "description", "file_path", "language", "generation_created", "generation_removed"]
    own = upsert_nodes(graph_nodes).select(*columns)
    none = F.lit(None).cast("string")
    ext = packages.select("id", F.lit("external-dependency").alias("type"), "name", F.col("name").alias("qualified_name"), none.alias("description"), none.alias("file_path"), none.alias("language"), "generation_created", "generation_removed")
    return own.unionByName(ext)


def merge_edges(rows: DataFrame) -> DataFrame:
    """Edges merged per (source, target, type): highest confidence, surest resolution, all evidence, latest generation.

    Rows are the latest delivery of each edge_id. Confidence null counts as 0 and is
    clamped to [0, 1]. Aggregates on the map side first, so a hot target costs no
    single task its edges.
    """
    one = latest_edges(rows.select("edge_id", "generation_verified", clean_id("source").alias("source"), clean_id("target").alias("target"), "type", "resolution", clamp01(F.coalesce("confidence", F.lit(0.0))).alias("confidence"), F.size(F.coalesce("evidence", F.array())).alias("n_evidence"), "generation_created"), "source", "target", "type", "resolution", "confidence", "n_evidence", "generation_created")
    keyed = one.filter("source IS NOT NULL AND target IS NOT NULL AND type IS NOT NULL")
    return keyed.groupBy("source", "target", "type").agg(
        F.max("confidence").alias("confidence"),
        F.min(F.struct(resolution_rank("resolution").alias("r"), "resolution")).alias("_best"),
        F.sum("n_evidence").alias("n_evidence"),
        F.min("generation_created").alias("generation_created"),
        F.max("generation_verified").alias("generation_verified"),
    ).select("source", "target", "type", "confidence", F.col("_best.resolution").alias("resolution"), "n_evidence", "generation_created", "generation_verified")


def edges_between(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges both of whose end points are nodes."""
    ids = nodes.select("id")
    return edges.join(ids, edges.source == ids.id, "left_semi").join(ids, edges.target == ids.id, "left_semi")


def remove_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without those of `gone` (id), and edges without what touched them."""
    g = gone.select("id").distinct()
    left = edges.join(g, edges.source == g.id, "left_anti")
    return nodes.join(g, "id", "left_anti"), left.join(g, left.target == g.id, "left_anti")


def edges_for_node(edges: DataFrame, node_id: str) -> DataFrame:
    """Outgoing edges, then incoming ones; a self-loop shows as both."""
    return edges.filter(F.col("source") == node_id).withColumn("direction", F.lit("outgoing")).unionByName(edges.filter(F.col("target") == node_id).withColumn("direction", F.lit("incoming")))


def neighbors(edges: DataFrame, direction: str, types: list[str] | None = None) -> DataFrame:
    """id, neighbor of all nodes, once each."""
    e = edges if types is None else edges.filter(F.col("type").isin(types))
    out = e.select(F.col("source").alias("id"), F.col("target").alias("neighbor"))
    back = e.select(F.col("target").alias("id"), F.col("source").alias("neighbor"))
    return (out if direction == "outgoing" else back if direction == "incoming" else out.unionByName(back)).distinct()


def first_parent(edges: DataFrame) -> DataFrame:
    """id, parent: the source of the first containing edge of each node, by generation, then id."""
    return edges.filter("type = 'contains'").groupBy(F.col("target").alias("id")).agg(F.min_by("source", F.struct("generation_created", "source")).alias("parent"))


def search_nodes(nodes: DataFrame, text: str, types: list[str] | None = None) -> DataFrame:
    """Nodes whose name, qualified name or description holds the text, in any case."""
    t = F.lit(text.lower())
    hit = F.coalesce(F.lower("name").contains(t), F.lit(False)) | F.coalesce(F.lower("qualified_name").contains(t), F.lit(False)) | F.coalesce(F.lower("description").contains(t), F.lit(False))
    return nodes.filter(hit if types is None else hit & F.col("type").isin(types))


def oriented(edges: DataFrame, direction: str = "both", types: list[str] | None = None, min_confidence: float = 0.0) -> DataFrame:
    """src, dst: the steps that a traversal may take."""
    e = edges.filter(F.col("confidence") >= min_confidence)
    return neighbors(e, direction, types).select(F.col("id").alias("src"), F.col("neighbor").alias("dst"))


#: Rounds after which the tables of a traversal are written together, so that a long one reads few files.
COMPACT = 8


def bfs(steps: DataFrame, starts: DataFrame, max_depth: int) -> DataFrame:
    """id, depth: what is reached from the starts (id) in at most max_depth steps, at its least depth.

    Each round joins the frontier with the steps and drops what was seen; the
    frontier is broadcast while it is small. Rounds are written, so the lineage
    stays short and lost executors cost one round.
    """
    steps = cut(steps)
    frontier = cut(starts.select("id", F.lit(0).alias("depth")).distinct())
    rounds, n = [frontier], frontier.count()
    for depth in range(1, max_depth + 1):
        if not n:
            break
        seen = rounds[0]
        for r in rounds[1:]:
            seen = seen.unionByName(r)
        near = frontier.select(F.col("id").alias("src"))
        found = steps.join(F.broadcast(near) if n <= BROADCAST_ROWS else near, "src").select(F.col("dst").alias("id")).distinct()
        frontier = cut(found.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)))
        n = frontier.count()
        rounds.append(frontier)
        if len(rounds) > COMPACT:
            one = cut(seen.unionByName(frontier))
            release(*rounds[:-1])
            rounds = [one]
    seen = rounds[0]
    for r in rounds[1:]:
        seen = seen.unionByName(r)
    return seen


def shortest_path(steps: DataFrame, source: str, target: str, max_depth: int = 50) -> list[str]:
    """Ids on a shortest path, the least id at each step back; empty if there is none.

    The visited table keeps each node's least parent; walking back reads one row a step.
    """
    spark = steps.sparkSession
    if source == target:
        return [source]
    steps = cut(steps)
    seen = cut(spark.createDataFrame([(source, None, 0)], "id string, parent string, depth int"))
    frontier = seen
    for depth in range(1, max_depth + 1):
        found = steps.join(small(frontier.select(F.col("id").alias("src"))), "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        new = cut(found.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)))
        seen, frontier = cut(seen.unionByName(new)), new
        if new.filter(F.col("id") == target).limit(1).count():
            break
        if not new.limit(1).count():
            return []
    else:
        return []
    path = [target]
    while path[-1] != source:
        path.append(seen.filter(F.col("id") == path[-1]).select("parent").first()[0])
    return path[::-1]


def impact(nodes: DataFrame, edges: DataFrame, starts: DataFrame, depth: int = 3) -> DataFrame:
    """id, kind: direct and transitive dependents of the starts, and the tests, endpoints and services within reach.

    The three ways to go (t: edges that carry a change on, i: any edge back, b: any edge)
    are walked by one traversal, whose ids bear the way as their first letter.
    """
    near = small(cut(starts.select("id").distinct()))
    first = oriented(edges, "incoming", DIRECT_IMPACT).join(near.select(F.col("id").alias("src")), "src", "left_semi")
    direct = cut(first.select(F.col("dst").alias("id")).distinct().join(near, "id", "left_anti"))
    ways = {"t": oriented(edges, "incoming", TRANSITIVE_IMPACT), "i": oriented(edges, "incoming"), "b": oriented(edges, "both")}
    steps = None
    for way, e in ways.items():
        marked = e.select(F.concat(F.lit(way), "src").alias("src"), F.concat(F.lit(way), "dst").alias("dst"))
        steps = marked if steps is None else steps.unionByName(marked)
    begin = near.select(F.explode(F.array(*(F.concat(F.lit(w), "id") for w in ways))).alias("id"))
    reached = bfs(steps, begin, depth + 1).filter("depth > 0").select(F.substring("id", 1, 1).alias("way"), F.expr("substring(id, 2)").alias("id"), "depth")
    further = reached.filter((F.col("way") == "t") & (F.col("depth") <= depth)).select("id").join(small(direct), "id", "left_anti")
    typed = reached.filter("way <> 't'").join(nodes.filter("type IN ('test-suite', 'api-endpoint', 'service', 'docker-service')").select("id", "type"), "id")
    kind = F.expr("CASE WHEN way = 'i' AND type = 'test-suite' THEN 'test' WHEN way = 'i' AND type = 'api-endpoint' THEN 'api' WHEN way = 'b' AND type IN ('service', 'docker-service') THEN 'service' END")
    return (
        direct.join(nodes, "id", "left_semi").select("id", F.lit("direct").alias("kind"))
        .unionByName(further.join(nodes, "id", "left_semi").select("id", F.lit("transitive").alias("kind")))
        .unionByName(typed.select("id", kind.alias("kind")).filter("kind IS NOT NULL"))
    )


def impact_summary(found: DataFrame) -> DataFrame:
    """One row: ids of each kind, and the risk of what is touched directly and transitively."""
    n = lambda k: F.count_if(F.col("kind") == k).alias(f"n_{k}")
    return found.agg(n("direct"), n("transitive"), n("test"), n("api"), n("service")).withColumn("risk", risk_of(F.col("n_direct") + F.col("n_transitive")))


def feature_subgraph(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """id of the neighborhood of the seeds over edges of confidence 0.3 and more, with the tests and routes that lead into it and what configures it."""
    near = cut(bfs(oriented(edges, "both", min_confidence=0.3), seeds, depth).select("id"))
    typed = near.join(nodes.select("id", "type"), "id")
    into = lambda ids, types: edges.filter(F.col("type").isin(types)).join(ids.select(F.col("id").alias("target")), "target", "left_semi").select(F.col("source").alias("id"))
    tests = into(near, ["tests"])
    routes = into(typed.filter("type = 'component'"), ["handles-route", "api-flow"])
    config = oriented(edges, "both", ["configures", "feature-flag"]).join(near.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
    return near.unionByName(tests).unionByName(routes).unionByName(config).distinct()


def expand(nodes: DataFrame, edges: DataFrame, node_id: str, mode: str) -> DataFrame:
    """Edges of any type between a node and its neighbors over the mode's edges."""
    around = neighbors(edges, "both", OVERVIEWS[mode][0]).filter(F.col("id") == node_id).select(F.col("neighbor").alias("id"))
    shown = small(cut(around.join(nodes, "id", "left_semi").unionByName(nodes.filter(F.col("id") == node_id).select("id")).distinct()))
    e = edges.join(shown.select(F.col("id").alias("source")), "source", "left_semi").join(shown.select(F.col("id").alias("target")), "target", "left_semi")
    return e.filter((F.col("source") == node_id) | (F.col("target") == node_id)).select("source", "target", "type", "confidence")


def overview(nodes: DataFrame, edges: DataFrame, mode: str, cap: int = 120) -> tuple[DataFrame, DataFrame]:
    """The first `cap` nodes of a mode's types, and the mode's edges between them."""
    types, kinds = OVERVIEWS[mode]
    shown = nodes if kinds is None else nodes.filter(F.col("type").isin(kinds))
    shown = cut(shown.orderBy("generation_created", "id").limit(cap).select("id", "type", "name"))
    ids = F.broadcast(shown.select("id"))  # at most `cap` rows
    e = edges.filter(F.col("type").isin(types)).join(ids.select(F.col("id").alias("source")), "source", "left_semi").join(ids.select(F.col("id").alias("target")), "target", "left_semi")
    return shown, e.select("source", "target", "type", "confidence")


def components_without_tests(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.filter("type = 'component'").select("id").join(edges.filter("type = 'tests'").select(F.col("target").alias("id")), "id", "left_anti")


def cross_layer(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """source, target, type, from_layer, to_layer of dependencies that the layer rules forbid."""
    spark = nodes.sparkSession
    rules = F.broadcast(spark.createDataFrame([(a, b) for a, bs in LAYER_RULES.items() for b in bs], "from_layer string, to_layer string"))  # a fixed table
    layered = nodes.filter("file_path IS NOT NULL").select("id", layer_of("file_path").alias("layer"))
    e = edges.filter(F.col("type").isin(["imports", "depends-on", "calls"])).select("source", "target", "type")
    e = e.join(layered.select(F.col("id").alias("source"), F.col("layer").alias("from_layer")), "source").join(layered.select(F.col("id").alias("target"), F.col("layer").alias("to_layer")), "target")
    return e.filter(F.col("from_layer").isin(list(LAYER_RULES))).join(rules, ["from_layer", "to_layer"], "left_anti").select("source", "target", "type", "from_layer", "to_layer")


def ontology_violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """type, source_type, target_type, n of edges whose end points the ontology does not allow."""
    spark = nodes.sparkSession
    rules = F.broadcast(spark.createDataFrame([(t, a, b) for t, (s, d) in RELATIONS.items() for a in s.split() for b in d.split()], "type string, source_type string, target_type string"))  # a fixed table
    kinds = nodes.select("id", F.col("type").alias("kind"))
    e = edges.select("source", "target", "type").join(kinds.select(F.col("id").alias("source"), F.col("kind").alias("source_type")), "source").join(kinds.select(F.col("id").alias("target"), F.col("kind").alias("target_type")), "target")
    return e.groupBy("type", "source_type", "target_type").agg(F.count("*").alias("n")).join(rules, ["type", "source_type", "target_type"], "left_anti")


def parent_violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """parent_type, child_type, n of containing edges that the ontology's hierarchy does not allow."""
    spark = nodes.sparkSession
    rules = F.broadcast(spark.createDataFrame([(c, p) for c, ps in PARENTS.items() for p in ps], "child_type string, parent_type string"))  # a fixed table
    kinds = nodes.select("id", F.col("type").alias("kind"))
    e = edges.filter("type = 'contains'").join(kinds.select(F.col("id").alias("source"), F.col("kind").alias("parent_type")), "source").join(kinds.select(F.col("id").alias("target"), F.col("kind").alias("child_type")), "target")
    return e.groupBy("parent_type", "child_type").agg(F.count("*").alias("n")).join(rules, ["child_type", "parent_type"], "left_anti").select("parent_type", "child_type", "n")


#: Edges that are few enough for one task to find their components.
ONE_TASK_EDGES = 200_000


def _components(batches):
    """id, component of the strongly connected components of all edges (source, target) of one partition, by depth-first search without recursion."""
    import pyarrow as pa

    names: dict[str, int] = {}
    out: list[list[int]] = []
    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for v in (x, y):
                if v not in names:
                    names[v] = len(out)
                    out.append([])
            out[names[x]].append(names[y])
    ids = list(names)
    order, low, on, stack, found = [-1] * len(ids), [0] * len(ids), [False] * len(ids), [], []
    seen = 0
    for root in range(len(ids)):
        if order[root] >= 0:
            continue
        work = [(root, iter(out[root]))]
        order[root] = low[root] = seen
        seen += 1
        stack.append(root)
        on[root] = True
        while work:
            v, rest = work[-1]
            for w in rest:
                if order[w] < 0:
                    order[w] = low[w] = seen
                    seen += 1
                    stack.append(w)
                    on[w] = True
                    work.append((w, iter(out[w])))
                    break
                if on[w]:
                    low[v] = min(low[v], order[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == order[v]:
                    part = []
                    while not part or part[-1] != v:
                        part.append(stack.pop())
                        on[part[-1]] = False
                    if len(part) > 1:
                        least = min(ids[x] for x in part)
                        found += [(ids[x], least) for x in part]
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found)], names=["id", "component"])


def strongly_connected(edges: DataFrame, types: list[str], one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """id, component (its least id), size of the strongly connected components of two ids and more.

    Ids without an edge in or out are trimmed while that removes a tenth. Then every
    id learns the least id that leads to it and the least that it leads to, round by
    round along the edges and, to halve what is left of the way, from the least id
    it knows. Where both are one, the id and that least id lead to each other; such
    components are taken out and the rest goes on. Takes about log(longest way)
    rounds for each layer of components. What is left of at most one_task edges is
    solved in one task, with the same result.
    """
    spark = edges.sparkSession
    rest = cut(edges.filter(F.col("type").isin(types)).filter("source <> target").select("source", "target").distinct())
    done = None
    while True:
        n = rest.count()
        while n:  # trim
            ins, outs = rest.select(F.col("target").alias("source")).distinct(), rest.select(F.col("source").alias("target")).distinct()
            nxt = cut(rest.join(ins, "source", "left_semi").join(outs, "target", "left_semi"))
            m = nxt.count()
            release(rest)
            rest, little, n = nxt, m > 0.9 * n, m
            if little:
                break
        if not n:
            break
        if n <= one_task:
            part = cut(rest.coalesce(1).mapInArrow(_components, "id string, component string"))
            done = part if done is None else done.unionByName(part)
            break
        ids = rest.select(F.col("source").alias("id")).unionByName(rest.select(F.col("target").alias("id"))).distinct()
        least = cut(ids.select("id", F.col("id").alias("f"), F.col("id").alias("b"), F.lit(True).alias("moved")))
        none = F.lit(None).cast("string")
        while True:
            new = least.filter("moved")
            told = [
                rest.join(new.select(F.col("id").alias("source"), "f"), "source").select(F.col("target").alias("id"), "f", none.alias("b")),
                rest.join(new.select(F.col("id").alias("target"), "b"), "target").select(F.col("source").alias("id"), none.alias("f"), "b"),
                least.select("id", F.col("f").alias("k")).join(new.select(F.col("id").alias("k"), "f"), "k").select("id", "f", none.alias("b")),
                least.select("id", F.col("b").alias("k")).join(new.select(F.col("id").alias("k"), "b"), "k").select("id", none.alias("f"), "b"),
            ]
            every = least.select("id", "f", "b", F.col("f").alias("f0"), F.col("b").alias("b0"))
            for t in told:
                every = every.unionByName(t.withColumns({"f0": none, "b0": none}))
            g = every.groupBy("id").agg(F.min("f").alias("f"), F.min("b").alias("b"), F.max("f0").alias("f0"), F.max("b0").alias("b0"))
            nxt = cut(g.select("id", "f", "b", ((F.col("f") < F.col("f0")) | (F.col("b") < F.col("b0"))).alias("moved")))
            release(least)
            least = nxt
            if not least.filter("moved").limit(1).count():
                break
        part = cut(least.filter("f = b").select("id", F.col("f").alias("component")))
        done = part if done is None else cut(done.unionByName(part))
        # an edge between ids that differ in either lies in no component
        inside = rest.join(least.select(F.col("id").alias("source"), F.col("f").alias("f1"), F.col("b").alias("b1")), "source").join(least.select(F.col("id").alias("target"), F.col("f").alias("f2"), F.col("b").alias("b2")), "target")
        left = cut(inside.filter("f1 = f2 AND b1 = b2 AND f1 <> b1").select("source", "target"))
        release(rest)
        rest = left
    if done is None:
        return spark.createDataFrame([], "id string, component string, size long")
    sizes = done.groupBy("component").agg(F.count("*").alias("size"))
    return done.join(sizes, "component").filter("size > 1").select("id", "component", "size")


def short_cycles(edges: DataFrame, types: list[str], longest: int = 3) -> DataFrame:
    """length, cycle of the simple cycles of at most `longest` ids, each once, from its least id on; only ids of strongly connected components take part."""
    scc = strongly_connected(edges, types).select("id", "component")
    e = edges.filter(F.col("type").isin(types)).select("source", "target").distinct()
    e = e.join(scc.select(F.col("id").alias("source"), F.col("component").alias("a")), "source").join(scc.select(F.col("id").alias("target"), F.col("component").alias("b")), "target").filter("a = b").select("source", "target")
    e = cut(e)
    paths = e.filter("source < target").select(F.array("source", "target").alias("path"), F.col("target").alias("end"))
    out = None
    for length in range(2, longest + 1):
        closed = paths.join(e.select(F.col("source").alias("end"), F.col("target").alias("start")), "end").filter(F.col("start") == F.col("path")[0]).select(F.lit(length).alias("length"), F.array_join("path", " > ").alias("cycle"))
        out = closed if out is None else out.unionByName(closed)
        step = e.select(F.col("source").alias("end"), F.col("target").alias("next"))
        paths = paths.join(step, "end").filter((F.col("next") > F.col("path")[0]) & ~F.array_contains("path", F.col("next"))).select(F.concat("path", F.array("next")).alias("path"), F.col("next").alias("end"))
    return out
