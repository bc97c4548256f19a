"""Queries over the graph, and the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import rules
from codeloom.operators import graph as G
from codeloom.plans.data_queries import _CLEAN
from codeloom.runtime import cut, load, small

# Edge types of the graph's dependency cycles.
CYCLE_TYPES = ["imports", "depends-on", "calls"]


def nodes(spark, d):
    return G.nodes_of(load(spark, d, "graph_nodes"), load(spark, d, "package_nodes"))


def edges(spark, d):
    return G.merge_edges(load(spark, d, "graph_edges"))


def written(spark, d):
    """Nodes and edges, each worked out once for a question that reads them several times."""
    return cut(nodes(spark, d)), cut(edges(spark, d))


def hub(n, e, type_=None):
    """The node most edges lead to, as a table of one id, and the id."""
    top = e.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n")).join(n if type_ is None else n.filter(F.col("type") == type_), "id", "left_semi").orderBy(F.desc("n"), "id").limit(1)
    t = cut(top.select("id"))
    return t, t.first()[0]


def node_upsert_latest(s, d):
    return nodes(s, d)


def edge_merge(s, d):
    return edges(s, d)


def node_remove_cascade(s, d):
    n, e = nodes(s, d), edges(s, d)
    left, kept = G.remove_nodes(n, e, n.filter("generation_removed IS NOT NULL"))
    return left.select(F.lit("node").alias("kind"), "type").unionByName(kept.select(F.lit("edge").alias("kind"), "type")).groupBy("kind", "type").agg(F.count("*").alias("n"))


def import_graph_checked(s, d):
    return G.edges_between(edges(s, d), nodes(s, d)).groupBy("type").agg(F.count("*").alias("n"))


def graph_stats(s, d):
    n = nodes(s, d).groupBy("type").agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), "type", "n")
    return n.unionByName(edges(s, d).groupBy("type").agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), "type", "n"))


def stats_rollup(s, d):
    return nodes(s, d).rollup("type", "language").agg(F.count("*").alias("n"))


def nodes_by_type(s, d):
    return nodes(s, d).filter("type = 'database-table'").select("id", "name")


def node_by_qualified_name(s, d):
    return nodes(s, d).filter("qualified_name IS NOT NULL").groupBy("qualified_name").agg(F.max_by("id", F.struct("generation_created", "id")).alias("id"))


def search_nodes(s, d):
    return G.search_nodes(nodes(s, d), "ledger", ["component", "symbol", "module"]).select("id", "type")


def nodes_by_layer(s, d):
    from codeloom.functions.columns import layer_of

    return nodes(s, d).filter("type IN ('file', 'module') AND file_path IS NOT NULL").select("id", layer_of("file_path").alias("layer")).filter("layer <> 'unknown'")


def edges_for_node(s, d):
    n, e = written(s, d)
    return G.edges_for_node(e, hub(n, e)[1]).groupBy("direction", "type").agg(F.count("*").alias("n"))


def neighbor_counts(s, d):
    return G.neighbors(edges(s, d), "both").groupBy("id").agg(F.count("*").alias("n"))


def _of_hub(direction, types):
    def q(s, d):
        n, e = written(s, d)
        return G.neighbors(e, direction, types).filter(F.col("id") == hub(n, e)[1]).select("neighbor")

    return q


callers, dependents = _of_hub("incoming", ["calls"]), _of_hub("incoming", G.DEPENDENTS)


def callees(s, d):
    return G.neighbors(edges(s, d), "outgoing", ["calls"]).groupBy("id").agg(F.count("*").alias("n_callees"))


def dependencies(s, d):
    return G.neighbors(edges(s, d), "outgoing", G.DEPENDENCIES).groupBy("id").agg(F.count("*").alias("n_dependencies"))


def children(s, d):
    return G.neighbors(edges(s, d), "outgoing", ["contains"]).groupBy("id").agg(F.count("*").alias("n_children"))


def implementations(s, d):
    return G.neighbors(edges(s, d), "incoming", ["implements", "extends"])


def parent_first(s, d):
    return G.first_parent(edges(s, d))


def uncovered_components(s, d):
    return G.components_without_tests(nodes(s, d), edges(s, d))


def coverage_semi(s, d):
    return nodes(s, d).join(edges(s, d).filter("type = 'tests'").select(F.col("target").alias("id")), "id", "left_semi").groupBy("type").agg(F.count("*").alias("n_tested"))


def cross_layer_violations(s, d):
    return G.cross_layer(nodes(s, d), edges(s, d))


def ontology_violations(s, d):
    return G.ontology_violations(nodes(s, d), edges(s, d))


def parent_violations(s, d):
    return G.parent_violations(nodes(s, d), edges(s, d))


def bfs_depth(s, d):
    n, e = written(s, d)
    return G.bfs(G.oriented(e, "incoming"), hub(n, e)[0], 3)


def bfs_confidence(s, d):
    n, e = written(s, d)
    return G.bfs(G.oriented(e, "both", min_confidence=0.9), hub(n, e, "component")[0], 2)


def bfs_nodetype_emission(s, d):
    """Symbols only, though paths lead over all types."""
    n, e = written(s, d)
    return G.bfs(G.oriented(e, "incoming"), hub(n, e)[0], 3).join(n.filter("type = 'symbol'").select("id"), "id")


def shortest_path_len(s, d):
    """From the hub to the last id that it reaches in four steps."""
    n, every = written(s, d)
    e = cut(G.oriented(every, "both"))
    t, i = hub(n, every, "component")
    far = G.bfs(e, t, 4).groupBy().agg(F.max(F.struct("depth", "id")).alias("m")).select("m.id").first()[0]
    path = G.shortest_path(e, i, far)
    return s.createDataFrame([(i, far, len(path))], "source string, target string, n_nodes long")


def feature_subgraph(s, d):
    n, e = written(s, d)
    return G.feature_subgraph(n, e, hub(n, e, "component")[0], 2)


def _impact(s, d):
    n, e = written(s, d)
    return G.impact(n, e, hub(n, e, "file")[0], 2)


def impact_direct(s, d):
    return _impact(s, d).filter("kind = 'direct'").select("id")


def impact_transitive(s, d):
    return _impact(s, d).filter("kind = 'transitive'").select("id")


def impact_tests(s, d):
    return _impact(s, d).filter("kind IN ('test', 'api', 'service')")


def impact_summary_risk(s, d):
    return G.impact_summary(_impact(s, d))


def api_flow(s, d):
    """These repositories declare no endpoints, so the flow is traced from every component."""
    starts = nodes(s, d).filter("type IN ('api-endpoint', 'component')").select("id")
    return G.bfs(G.oriented(edges(s, d), "outgoing", G.API_FLOW), starts, 10)


def dep_tree(s, d):
    return G.bfs(G.oriented(edges(s, d), "outgoing", G.DEPENDENCIES), nodes(s, d).filter("type = 'project'").select("id"), 10)


def reverse_dep_tree(s, d):
    n, e = written(s, d)
    return G.bfs(G.oriented(e, "incoming", G.DEPENDENCIES), hub(n, e, "external-dependency")[0], 10)


def concept_relations(s, d):
    n, e = written(s, d)
    return G.bfs(G.oriented(e, "both", G.CONCEPT_RELATIONS), hub(n, e, "module")[0], 3)


def expand_node(s, d):
    n, e = written(s, d)
    return G.expand(n, e, hub(n, e, "component")[1], "tests-impact")


def overview_nodes(s, d):
    return G.overview(nodes(s, d), edges(s, d), "architecture")[0]


def overview_edges(s, d):
    return G.overview(nodes(s, d), edges(s, d), "architecture")[1]


def metric_details(s, d):
    """The first hundred components by name."""
    return nodes(s, d).filter("type = 'component'").select("id", "name").orderBy(F.asc_nulls_first("name"), "id").limit(100)


def structural_query(s, d):
    """(n:docker-service), as a list of nodes in the order of insertion."""
    kind = F.regexp_extract(F.lit("match (n:database-table) return n"), r"\(n:([a-zA-Z-]+)\)", 1)
    return nodes(s, d).filter(F.col("type") == kind).orderBy("generation_created", "id").limit(30).select("id", "name")


def flow_query(s, d):
    return G.bfs(G.oriented(edges(s, d), "outgoing", G.FLOW), cut(edges(s, d).filter("type = 'calls'").agg(F.min("source").alias("id"))), 6).orderBy("depth", "id").limit(15)


def cycles_scc(s, d):
    return G.strongly_connected(edges(s, d), CYCLE_TYPES)


def cycles_bounded(s, d):
    return G.short_cycles(edges(s, d), CYCLE_TYPES, 3)


QUERIES = {
    f.__name__: f
    for f in (
        node_upsert_latest, edge_merge, node_remove_cascade, import_graph_checked, graph_stats, stats_rollup, nodes_by_type, node_by_qualified_name, search_nodes, nodes_by_layer, edges_for_node, neighbor_counts, callees, dependencies,
        children, implementations, parent_first, uncovered_components, coverage_semi, cross_layer_violations, ontology_violations, parent_violations, bfs_depth, bfs_confidence, bfs_nodetype_emission, shortest_path_len, feature_subgraph,
        impact_direct, impact_transitive, impact_tests, impact_summary_risk, api_flow, dep_tree, reverse_dep_tree, concept_relations, expand_node, overview_nodes, overview_edges, metric_details, structural_query, flow_query, cycles_scc, cycles_bounded,
    )
} | {"callers": callers, "dependents": dependents}


def sql_list(xs):
    return "(" + ", ".join(f"'{x}'" for x in xs) + ")"


def sql_values(rows):
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows) + ")"


def sql_rule(table, low, otherwise):
    """A first-match table of path rules as a CASE."""
    whens = []
    for name, marks in table:
        have = " OR ".join(f"ends_with({low}, '{m[1:]}')" if m[0] == "$" else f"regexp_matches({low}, '{m[1:]}')" if m[0] == "~" else f"contains({low}, '{m}')" for m in marks if m[0] != "-")
        out = "".join(f" AND NOT contains({low}, '{m[1:]}')" for m in marks if m[0] == "-")
        whens.append(f"WHEN ({have}){out} THEN '{name}'")
    return f"CASE {' '.join(whens)} ELSE '{otherwise}' END"


NODES = """nodes AS (SELECT id, type, name, qualified_name, description, file_path, language, generation_created, generation_removed FROM (SELECT *, row_number() OVER (PARTITION BY id
    ORDER BY generation_created DESC, generation_updated DESC NULLS LAST, loaded_at DESC NULLS LAST) AS rn FROM graph_nodes WHERE id IS NOT NULL) WHERE rn = 1
    UNION ALL SELECT id, 'external-dependency', name, name, NULL, NULL, NULL, generation_created, generation_removed FROM package_nodes)"""
_RANK = "CASE resolution " + " ".join(f"WHEN '{n}' THEN {i + 1}" for i, (n, _) in enumerate(rules.RESOLUTIONS)) + " ELSE 9 END"
EDGES = f"""one AS (SELECT * FROM (SELECT edge_id, {_CLEAN.format(c="source")} AS source, {_CLEAN.format(c="target")} AS target, type, resolution, greatest(0, least(1, coalesce(confidence, 0))) AS confidence,
    coalesce(len(evidence), 0) AS n_evidence, generation_created, generation_verified, row_number() OVER (PARTITION BY edge_id ORDER BY generation_verified DESC NULLS LAST, source DESC NULLS LAST, target DESC NULLS LAST, type DESC NULLS LAST, resolution DESC NULLS LAST, confidence DESC NULLS LAST, coalesce(len(evidence), 0) DESC, generation_created DESC NULLS LAST) AS rn FROM graph_edges) WHERE rn = 1),
edges AS (SELECT source, target, type, max(confidence) AS confidence, arg_min(resolution, {_RANK}) AS resolution, CAST(sum(n_evidence) AS BIGINT) AS n_evidence, min(generation_created) AS generation_created, max(generation_verified) AS generation_verified
    FROM one WHERE source IS NOT NULL AND target IS NOT NULL AND type IS NOT NULL GROUP BY source, target, type)"""
BASE = f"{NODES}, {EDGES}"


def hub_cte(name="hub", type_=None):
    where = f"WHERE type = '{type_}'" if type_ else ""
    return f"{name} AS (SELECT target AS id FROM edges WHERE target IN (SELECT id FROM nodes {where}) GROUP BY target ORDER BY count(*) DESC, target LIMIT 1)"


def steps_cte(direction="both", types=None, least=0.0, name="steps"):
    where = f"confidence >= {least}" + (f" AND type IN {sql_list(types)}" if types else "")
    out, back = f"SELECT source AS src, target AS dst FROM edges WHERE {where}", f"SELECT target AS src, source AS dst FROM edges WHERE {where}"
    return f"{name} AS ({out if direction == 'outgoing' else back if direction == 'incoming' else out + ' UNION ' + back})"


def bfs_cte(depth, starts="hub", steps="steps", name="reached"):
    return f"""{name}_w AS (SELECT id, 0 AS depth FROM {starts} UNION SELECT e.dst, w.depth + 1 FROM {name}_w w JOIN {steps} e ON e.src = w.id WHERE w.depth < {depth}),
{name} AS (SELECT id, CAST(min(depth) AS INT) AS depth FROM {name}_w GROUP BY id)"""


def bfs_sql(depth, direction="both", types=None, least=0.0, starts=None, select="SELECT id, depth FROM reached"):
    return f"WITH RECURSIVE {BASE}, {starts or hub_cte()}, {steps_cte(direction, types, least)}, {bfs_cte(depth)} {select}"


def _near(direction, types):
    a, b = ("source", "target") if direction == "outgoing" else ("target", "source")
    return f"SELECT DISTINCT {a} AS id, {b} AS neighbor FROM edges WHERE type IN {sql_list(types)}"


_IMPACT = f"""WITH RECURSIVE {BASE}, {hub_cte(type_="file")}, {steps_cte("incoming", G.DIRECT_IMPACT, name="s1")}, {bfs_cte(1, steps="s1", name="r1")}, {steps_cte("incoming", G.TRANSITIVE_IMPACT, name="s2")}, {bfs_cte(2, steps="s2", name="r2")},
{steps_cte("incoming", name="s3")}, {bfs_cte(3, steps="s3", name="r3")}, {steps_cte("both", name="s4")}, {bfs_cte(3, steps="s4", name="r4")},
impact AS (SELECT id, 'direct' AS kind FROM r1 WHERE depth > 0 AND id IN (SELECT id FROM nodes) UNION ALL SELECT id, 'transitive' FROM r2 WHERE depth > 0 AND id NOT IN (SELECT id FROM r1 WHERE depth > 0) AND id IN (SELECT id FROM nodes)
UNION ALL SELECT r.id, CASE n.type WHEN 'test-suite' THEN 'test' ELSE 'api' END FROM r3 r JOIN nodes n ON n.id = r.id WHERE depth > 0 AND n.type IN ('test-suite', 'api-endpoint')
UNION ALL SELECT r.id, 'service' FROM r4 r JOIN nodes n ON n.id = r.id WHERE depth > 0 AND n.type IN ('service', 'docker-service'))"""
_OVER = f"shown AS (SELECT id, type, name FROM nodes WHERE type IN {sql_list(G.OVERVIEWS['architecture'][1])} ORDER BY generation_created, id LIMIT 120)"
LAYER = sql_rule(rules.LAYERS, "lower(file_path)", "unknown")

ORACLE = {
    "node_upsert_latest": f"WITH {NODES} SELECT * FROM nodes",
    "edge_merge": f"WITH {EDGES} SELECT * FROM edges",
    "node_remove_cascade": f"WITH {BASE}, gone AS (SELECT id FROM nodes WHERE generation_removed IS NOT NULL) SELECT 'node' AS kind, type, count(*) AS n FROM nodes WHERE id NOT IN (SELECT id FROM gone) GROUP BY type UNION ALL SELECT 'edge', type, count(*) FROM edges WHERE source NOT IN (SELECT id FROM gone) AND target NOT IN (SELECT id FROM gone) GROUP BY type",
    "import_graph_checked": f"WITH {BASE} SELECT type, count(*) AS n FROM edges WHERE source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes) GROUP BY type",
    "graph_stats": f"WITH {BASE} SELECT 'node' AS kind, type, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY type",
    "stats_rollup": f"WITH {NODES} SELECT type, language, count(*) AS n FROM nodes GROUP BY ROLLUP (type, language)",
    "nodes_by_type": f"WITH {NODES} SELECT id, name FROM nodes WHERE type = 'database-table'",
    "node_by_qualified_name": f"WITH {NODES} SELECT qualified_name, id FROM (SELECT qualified_name, id, row_number() OVER (PARTITION BY qualified_name ORDER BY generation_created DESC, id DESC) AS rn FROM nodes WHERE qualified_name IS NOT NULL) WHERE rn = 1",
    "search_nodes": f"WITH {NODES} SELECT id, type FROM nodes WHERE type IN ('component', 'symbol', 'module') AND (contains(lower(coalesce(name, '')), 'ledger') OR contains(lower(coalesce(qualified_name, '')), 'ledger') OR contains(lower(coalesce(description, '')), 'ledger'))",
    "nodes_by_layer": f"WITH {NODES} SELECT id, layer FROM (SELECT id, {LAYER} AS layer FROM nodes WHERE type IN ('file', 'module') AND file_path IS NOT NULL) WHERE layer <> 'unknown'",
    "edges_for_node": f"WITH {BASE}, {hub_cte()} SELECT 'outgoing' AS direction, type, count(*) AS n FROM edges WHERE source IN (SELECT id FROM hub) GROUP BY type UNION ALL SELECT 'incoming', type, count(*) FROM edges WHERE target IN (SELECT id FROM hub) GROUP BY type",
    "neighbor_counts": f"WITH {EDGES}, {steps_cte()} SELECT src AS id, count(*) AS n FROM (SELECT DISTINCT src, dst FROM steps) GROUP BY src",
    "callers": f"WITH {BASE}, {hub_cte()} SELECT DISTINCT source AS neighbor FROM edges WHERE type = 'calls' AND target IN (SELECT id FROM hub)",
    "dependents": f"WITH {BASE}, {hub_cte()} SELECT DISTINCT source AS neighbor FROM edges WHERE type IN {sql_list(G.DEPENDENTS)} AND target IN (SELECT id FROM hub)",
    "callees": f"WITH {EDGES} SELECT id, count(*) AS n_callees FROM ({_near('outgoing', ['calls'])}) GROUP BY id",
    "dependencies": f"WITH {EDGES} SELECT id, count(*) AS n_dependencies FROM ({_near('outgoing', G.DEPENDENCIES)}) GROUP BY id",
    "children": f"WITH {EDGES} SELECT id, count(*) AS n_children FROM ({_near('outgoing', ['contains'])}) GROUP BY id",
    "implementations": f"WITH {EDGES} {_near('incoming', ['implements', 'extends'])}",
    "parent_first": f"WITH {EDGES} SELECT id, parent FROM (SELECT target AS id, source AS parent, row_number() OVER (PARTITION BY target ORDER BY generation_created, source) AS rn FROM edges WHERE type = 'contains') WHERE rn = 1",
    "uncovered_components": f"WITH {BASE} SELECT id FROM nodes WHERE type = 'component' AND id NOT IN (SELECT target FROM edges WHERE type = 'tests')",
    "coverage_semi": f"WITH {BASE} SELECT type, count(*) AS n_tested FROM nodes WHERE id IN (SELECT target FROM edges WHERE type = 'tests') GROUP BY type",
    "cross_layer_violations": f"WITH {BASE}, layered AS (SELECT id, {LAYER} AS layer FROM nodes WHERE file_path IS NOT NULL), allowed(a, b) AS {sql_values([(a, b) for a, bs in rules.LAYER_RULES.items() for b in bs])} SELECT e.source, e.target, e.type, f.layer AS from_layer, t.layer AS to_layer FROM edges e JOIN layered f ON f.id = e.source JOIN layered t ON t.id = e.target WHERE e.type IN ('imports', 'depends-on', 'calls') AND f.layer IN (SELECT a FROM allowed) AND NOT EXISTS (SELECT 1 FROM allowed x WHERE x.a = f.layer AND x.b = t.layer)",
    "ontology_violations": f"WITH {BASE}, allowed(t, a, b) AS {sql_values([(t, a, b) for t, (s, d) in rules.RELATIONS.items() for a in s.split() for b in d.split()])} SELECT e.type, f.type AS source_type, t.type AS target_type, count(*) AS n FROM edges e JOIN nodes f ON f.id = e.source JOIN nodes t ON t.id = e.target WHERE NOT EXISTS (SELECT 1 FROM allowed x WHERE x.t = e.type AND x.a = f.type AND x.b = t.type) GROUP BY 1, 2, 3",
    "parent_violations": f"WITH {BASE}, allowed(c, p) AS {sql_values([(c, p) for c, ps in rules.PARENTS.items() for p in ps])} SELECT f.type AS parent_type, t.type AS child_type, count(*) AS n FROM edges e JOIN nodes f ON f.id = e.source JOIN nodes t ON t.id = e.target WHERE e.type = 'contains' AND NOT EXISTS (SELECT 1 FROM allowed x WHERE x.c = t.type AND x.p = f.type) GROUP BY 1, 2",
    "bfs_depth": bfs_sql(3, "incoming"),
    "bfs_confidence": bfs_sql(2, least=0.9, starts=hub_cte(type_="component")),
    "bfs_nodetype_emission": bfs_sql(3, "incoming", select="SELECT r.id, r.depth FROM reached r JOIN nodes n ON n.id = r.id WHERE n.type = 'symbol'"),
    "shortest_path_len": bfs_sql(4, starts=hub_cte(type_="component"), select="SELECT (SELECT id FROM hub) AS source, id AS target, CAST(depth + 1 AS BIGINT) AS n_nodes FROM reached ORDER BY depth DESC, id DESC LIMIT 1"),
    "feature_subgraph": bfs_sql(2, least=0.3, starts=hub_cte(type_="component"), select="""SELECT id FROM reached UNION SELECT source FROM edges WHERE type = 'tests' AND target IN (SELECT id FROM reached)
        UNION SELECT source FROM edges WHERE type IN ('handles-route', 'api-flow') AND target IN (SELECT r.id FROM reached r JOIN nodes n ON n.id = r.id WHERE n.type = 'component')
        UNION SELECT target FROM edges WHERE type IN ('configures', 'feature-flag') AND source IN (SELECT id FROM reached) UNION SELECT source FROM edges WHERE type IN ('configures', 'feature-flag') AND target IN (SELECT id FROM reached)"""),
    "impact_direct": f"{_IMPACT} SELECT id FROM impact WHERE kind = 'direct'",
    "impact_transitive": f"{_IMPACT} SELECT id FROM impact WHERE kind = 'transitive'",
    "impact_tests": f"{_IMPACT} SELECT id, kind FROM impact WHERE kind IN ('test', 'api', 'service')",
    "impact_summary_risk": f"{_IMPACT} SELECT *, CASE WHEN n_direct + n_transitive >= 20 THEN 'critical' WHEN n_direct + n_transitive >= 10 THEN 'high' WHEN n_direct + n_transitive >= 4 THEN 'medium' ELSE 'low' END AS risk FROM (SELECT "
    + ", ".join(f"count(CASE WHEN kind = '{k}' THEN 1 END) AS n_{k}" for k in ("direct", "transitive", "test", "api", "service"))
    + " FROM impact)",
    "api_flow": bfs_sql(10, "outgoing", G.API_FLOW, starts="hub AS (SELECT id FROM nodes WHERE type IN ('api-endpoint', 'component'))"),
    "dep_tree": bfs_sql(10, "outgoing", G.DEPENDENCIES, starts="hub AS (SELECT id FROM nodes WHERE type = 'project')"),
    "reverse_dep_tree": bfs_sql(10, "incoming", G.DEPENDENCIES, starts=hub_cte(type_="external-dependency")),
    "concept_relations": bfs_sql(3, "both", G.CONCEPT_RELATIONS, starts=hub_cte(type_="module")),
    "expand_node": f"WITH {BASE}, {hub_cte(type_='component')}, {steps_cte('both', G.OVERVIEWS['tests-impact'][0])}, shown AS (SELECT id FROM nodes WHERE id IN (SELECT dst FROM steps WHERE src IN (SELECT id FROM hub)) OR id IN (SELECT id FROM hub)) SELECT source, target, type, confidence FROM edges WHERE source IN (SELECT id FROM shown) AND target IN (SELECT id FROM shown) AND (source IN (SELECT id FROM hub) OR target IN (SELECT id FROM hub))",
    "overview_nodes": f"WITH {NODES}, {_OVER} SELECT id, type, name FROM shown",
    "overview_edges": f"WITH {BASE}, {_OVER} SELECT source, target, type, confidence FROM edges WHERE type IN {sql_list(G.OVERVIEWS['architecture'][0])} AND source IN (SELECT id FROM shown) AND target IN (SELECT id FROM shown)",
    "metric_details": f"WITH {NODES} SELECT id, name FROM nodes WHERE type = 'component' ORDER BY name NULLS FIRST, id LIMIT 100",
    "structural_query": f"WITH {NODES} SELECT id, name FROM nodes WHERE type = 'database-table' ORDER BY generation_created, id LIMIT 30",
    "flow_query": bfs_sql(6, "outgoing", G.FLOW, starts="hub AS (SELECT min(source) AS id FROM edges WHERE type = 'calls')", select="SELECT id, depth FROM reached ORDER BY depth, id LIMIT 15"),
    "cycles_bounded": f"""WITH {EDGES}, e AS (SELECT DISTINCT source AS s, target AS t FROM edges WHERE type IN {sql_list(CYCLE_TYPES)} AND source <> target)
        SELECT 2 AS length, a.s || ' > ' || a.t AS cycle FROM e a JOIN e b ON b.s = a.t AND b.t = a.s WHERE a.s < a.t
        UNION ALL SELECT 3, a.s || ' > ' || a.t || ' > ' || b.t FROM e a JOIN e b ON b.s = a.t JOIN e c ON c.s = b.t AND c.t = a.s WHERE a.s < a.t AND a.s < b.t AND a.t <> b.t""",
    "cycles_scc": f"""WITH RECURSIVE {EDGES}, e AS (SELECT DISTINCT source AS s, target AS t FROM edges WHERE type IN {sql_list(CYCLE_TYPES)} AND source <> target),
        reach AS (SELECT s, t FROM e UNION SELECT r.s, e.t FROM reach r JOIN e ON e.s = r.t), same AS (SELECT a.s AS id, a.t AS other FROM reach a JOIN reach b ON b.s = a.t AND b.t = a.s),
        least_of AS (SELECT id, min(other) AS component FROM same GROUP BY id) SELECT id, component, count(*) OVER (PARTITION BY component) AS size FROM least_of""",
}
