"""Queries over indexes, evidence, edges in time and parsed files, and the SQL that each must equal.

The SQL here is written by hand, pattern by pattern; it shares no rule tables with the
operators. Queries named fixture_ run over a few literal rows, for what the tables do
not hold: relative imports, manifests, foreign keys, projects above modules.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import columns as C
from codeloom.functions import frameworks as FW
from codeloom.operators import assemble as A
from codeloom.operators import build as B
from codeloom.operators import context as X
from codeloom.operators import extract as E
from codeloom.operators import graph as G
from codeloom.operators import lookups as L
from codeloom.operators import reports as R
from codeloom.plans.graph_queries import BASE, EDGES, NODES, edges, hub, hub_cte, nodes, steps_cte, bfs_cte, written
from codeloom.plans.graph_queries import CYCLE_TYPES, sql_list
from codeloom.plans.report_queries import ORACLE as REPORTS
from codeloom.plans.report_queries import ROLE, texts
from codeloom.runtime import load
from codeloom.sources.store import history_summary, record_run

#: Literal rows: files with relative imports.
FILES = [
    (1, "web/src/app.ts", "typescript", "import { Ledger, Panel as P } from './ledger';\nimport type {\n  Row,\n} from '../lib/rows.js';\nimport './side';\nimport fs, * as all from 'fs-extra';\n"),
    (2, "web/src/ledger.ts", "typescript", "export class Ledger extends Base implements Reader, Writer<string> {\n}\nexport class Panel {\n}\n"),
    (3, "web/lib/rows.ts", "typescript", "export interface Row {}\n"),
    (4, "web/src/side/index.ts", "typescript", "const x = 'import y from \"z\"';\n"),
    (5, "svc/main.go", "go", 'package main\n\nimport (\n\t"fmt"\n\t"code.example/svc/store"\n)\n'),
    (6, "svc/one.go", "go", 'package main\n\nimport "os"\n'),
    (7, "web/src/none.ts", "typescript", None),
]
#: Literal rows: manifests.
MANIFESTS = [
    ("a/package.json", '{"dependencies": {"react": "^18.0.0", "next": "14.1.0"}}'),
    ("b/package.json", '{"dependencies": {"express": "4.0.0"}, "devDependencies": {"express": "5.0.0"}}'),
    ("c/package.json", '{"devDependencies": {"@nestjs/core": "10.2.1"}}'),
    ("d/package.json", '{"dependencies": {}}'),
    ("e/package.json", "{ no json"),
    ("f/other.json", '{"dependencies": {"vue": "3"}}'),
    ("g/package.json", None),
]
#: Literal rows: classes with bases.
CLASSES = [
    (1, "java", "public final class A<T> extends Base<T> implements Reader, java.io.Closeable {\n}\n"),
    (2, "csharp", "public class B : Base, Reader\n{\n}\n"),
    (3, "python", "class C(a.Base, Reader, metaclass=M):\n    pass\nclass D:\n    pass\n"),
    (4, "javascript", "export default class E extends Missing {}\n"),
    (5, "java", None),
]
#: Literal rows: files with endpoints.
ROUTED = [
    (1, "a.ts", "typescript", "app.get('/users', f);\nrouter.post(`items`, g);\n@Delete('x')\n"),
    (2, "a.py", "python", "@app.route('/home')\n@app.put('/y')\n"),
    (3, "A.java", "java", '@GetMapping("/j")\n'),
    (4, "a.cs", "csharp", '[HttpPost("c")]\n'),
    (5, "a.rs", "rust", '#[get("/r")]\n'),
    (6, "a.go", "go", 'r.GET("/g", h)\n'),
    (7, "b.ts", "typescript", None),
]
COMPOSE = "version: '3'\nservices:\n  web:\n    image: 'nginx:1'\n    ports:\n      - '80:80'\n    depends_on:\n      - db\n      - cache\n  db:\n    image: postgres\nvolumes:\n  data:\n"
TABLES = "CREATE TABLE customer (id INT PRIMARY KEY, region_id INT REFERENCES region(id), name TEXT NOT NULL);\nCREATE TABLE region (id INT);\nCREATE TABLE IF NOT EXISTS orders (id INT, customer_id INT, FOREIGN KEY (customer_id) REFERENCES customer(id), FOREIGN KEY (part_id) REFERENCES part(id));\n"


def find_edge(s, d):
    """The first calling edge by its end points, found again by its key."""
    e = edges(s, d)
    k = e.filter("type = 'calls'").agg(F.min(F.struct("source", "target")).alias("k")).first()[0]
    return L.find_edge(e, k.source, k.target, "calls").select("source", "target", "type", "confidence") if k else e.limit(0).select("source", "target", "type", "confidence")


def nodes_by_role(s, d):
    return L.nodes_by_role(nodes(s, d), "service").select("id")


def search_concepts(s, d):
    """Concepts that hold a word; the graph has none, so project nodes stand for them."""
    n = nodes(s, d).withColumn("type", F.when(F.col("type") == "project", "concept").otherwise(F.col("type")))
    return L.search_concepts(n, "a").select("id")


def file_index(s, d):
    return L.file_index(load(s, d, "parse_results"))


def file_index_by_generation(s, d):
    return L.file_index(load(s, d, "parse_results")).groupBy("generation", "language").agg(F.count("*").alias("n"))


def symbol_search(s, d):
    return L.search_symbols(L.symbol_index(load(s, d, "parse_results")), "Ledger")


def symbols_by_kind(s, d):
    return L.symbol_index(load(s, d, "parse_results")).groupBy("kind").agg(F.count("*").alias("n"))


def symbols_without_files(s, d):
    """The index without the files that the scanner reported, and with an entry for each of those."""
    index, bad = L.symbol_index(load(s, d, "parse_results")), load(s, d, "scan_errors").select(F.replace("file_path", F.lit("\\"), F.lit("/")).alias("file_path")).filter("file_path IS NOT NULL").distinct()
    more = bad.select("file_path", F.lit("?").alias("name"), F.lit("unknown").alias("kind"))
    return L.add_symbols(L.remove_files(index, bad), more).groupBy("kind").agg(F.count("*").alias("n"))


def symbols_without_node(s, d):
    return L.symbols_without_node(L.symbol_index(load(s, d, "parse_results")), nodes(s, d))


def evidence_confident(s, d):
    return L.evidence_rows(load(s, d, "graph_edges"), 0.8).groupBy("kind", "resolution").agg(F.count("*").alias("n"))


def evidence_resolved(s, d):
    return L.evidence_rows(load(s, d, "graph_edges"), 0.0, ["confirmed", "resolved"]).groupBy("kind").agg(F.count("*").alias("n"))


def evidence_order(s, d):
    return L.evidence_rows(load(s, d, "graph_edges")).groupBy("edge_id").agg(F.count("*").alias("n"), F.max(F.when(F.col("place") == 1, F.col("confidence"))).alias("surest"), F.max("place").cast("int").alias("last"))


def evidence_sentences(s, d):
    return load(s, d, "graph_edges").select("edge_id", FW.evidence_sentence("evidence").alias("said")).distinct()


def node_merge_fields(s, d):
    return L.merged_nodes(load(s, d, "graph_nodes"))


def edge_evidence(s, d):
    e = L.merged_evidence(load(s, d, "graph_edges"))
    return e.select("source", "target", "type", F.size("evidence").alias("n"), F.col("evidence")[0]["confidence"].alias("surest"))


def edge_snapshot_diff(s, d):
    """Edges added, removed (none: deliveries are never taken back) and modified from generation 12 to 24."""
    e = load(s, d, "graph_edges")
    return L.edge_diff(L.edges_at(e, 12), L.edges_at(e, 24))


def edge_snapshot_report(s, d):
    return edge_snapshot_diff(s, d).groupBy("type", "change_type", "changed_fields").agg(F.count("*").alias("n"))


def edge_diff_back(s, d):
    """The same two snapshots the other way round, so that removals show."""
    e = load(s, d, "graph_edges")
    return L.edge_diff(L.edges_at(e, 24), L.edges_at(e, 12)).groupBy("change_type").agg(F.count("*").alias("n"))


def top_consumers(s, d):
    """The fifteen nodes with the most distinct dependents."""
    return G.neighbors(edges(s, d), "incoming", G.DEPENDENTS).groupBy("id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(15)


def extras_bag(s, d):
    """Tests, routes and settings of the hub's neighbors, each as often as an edge leads to it."""
    n, e = written(s, d)
    near = G.bfs(G.oriented(e, "both"), hub(n, e, "component")[0], 1).select("id")
    into = lambda types, kind: e.filter(F.col("type").isin(types)).join(near.select(F.col("id").alias("target")), "target", "left_semi").select(F.lit(kind).alias("kind"), F.col("source").alias("id"))
    bag = into(["tests"], "test").unionAll(into(["handles-route", "api-flow", "calls"], "api")).unionAll(into(["configures", "feature-flag", "imports"], "config"))
    return bag.groupBy("kind", "id").agg(F.count("*").alias("n"))


def tested_and_contained(s, d):
    """Nodes that are tested and contained too."""
    e = edges(s, d)
    of = lambda t: e.filter(F.col("type") == t).select(F.col("target").alias("id"))
    return of("tests").intersect(of("contains"))


def impact_report_risk(s, d):
    """Risk of a change to each file by the report's scale: what imports it, what that leads to in one step more, the tests and services beside it."""
    n, e = written(s, d)
    dep = G.neighbors(e, "incoming", G.DIRECT_IMPACT)
    direct = dep.groupBy("id").agg(F.count("*").alias("direct"))
    tests = e.filter("type = 'tests'").groupBy(F.col("target").alias("id")).agg(F.count("*").alias("tests"))
    f = n.filter("type = 'file'").select("id").join(direct, "id", "left").join(tests, "id", "left").fillna(0, ["direct", "tests"])
    return f.select("id", FW.report_risk(F.col("direct"), F.lit(0), F.col("tests"), F.lit(0), F.lit(0)).alias("risk")).groupBy("risk").agg(F.count("*").alias("n"))


def import_statements(s, d):
    return L.imports_with_names(texts(s, d)).select("file_id", "line_no", "source", F.array_join("specifiers", ",").alias("specifiers"))


def go_packages(s, d):
    """External packages of Go files, and how many files use each."""
    t = L.imports_with_names(texts(s, d).filter("language = 'go'"))
    return L.package_edges(t.select("file_id", F.col("file_path").alias("file"), "source")).groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n_files"))


def sql_symbols(s, d):
    return L.sql_symbols(E.table_columns(texts(s, d)))


def chat_keywords(s, d):
    return load(s, d, "documents").filter("text IS NOT NULL").select("doc_id", F.size(FW.chat_keywords("text")).alias("n"), F.array_join(F.slice(FW.chat_keywords("text"), 1, 5), " ").alias("first"))


def token_sum(s, d):
    from codeloom.functions.columns import token_estimate

    return load(s, d, "documents").filter("text IS NOT NULL").groupBy("source").agg(F.sum(token_estimate("text")).alias("tokens"), F.count("*").alias("n"))


def prompt_scores(s, d):
    """Scores of each document as a prompt, by the components and test suites that its repository has as evidence."""
    n = nodes(s, d).filter("file_path IS NOT NULL").groupBy(F.element_at(F.split("file_path", "/"), 1).alias("repo")).agg(F.count_if(F.col("type") == "component").alias("e"), F.count_if(F.col("type") == "test-suite").alias("t"))
    p = load(s, d, "documents").filter("text IS NOT NULL").select("doc_id", "repo").join(n, "repo", "left").fillna(0, ["e", "t"])
    return p.select("doc_id", *(c.alias(k) for k, c in FW.prompt_scores(F.col("e"), F.col("t")).items()))


def invalid_json(s, d):
    """JSON files whose text is none, with the error, beside the number of those that are."""
    f = texts(s, d).filter("language = 'json' AND content IS NOT NULL").select("file_id", F.try_parse_json("content").isNull().alias("bad")).distinct()
    return f.groupBy(F.when(F.col("bad"), "invalid JSON").otherwise("").alias("error")).agg(F.count("*").alias("n"))


def node_items(s, d):
    """Nodes as a client sees them: a label that is never null, a fixed confidence."""
    return nodes(s, d).select("id", "type", F.coalesce("name", "id").alias("label"), F.coalesce("file_path", F.lit("")).alias("path"), F.lit(0.95).alias("confidence"))


def dependency_cycles(s, d):
    """Strongly connected components over imports and depends-on between files and modules, as the quality report counts cycles."""
    n = nodes(s, d).filter("type IN ('file', 'module')").select("id")
    e = G.edges_between(edges(s, d).filter("type IN ('imports', 'depends-on')"), n)
    return G.strongly_connected(e, ["imports", "depends-on"])


def dependency_maintainability(s, d):
    n = nodes(s, d)
    e = edges(s, d)
    inner = G.edges_between(e.filter("type IN ('imports', 'depends-on')"), n.filter("type IN ('file', 'module')").select("id"))
    return R.maintainability(n, load(s, d, "parse_results"), e, ["imports", "depends-on"], inner)


def capability_confidence(s, d):
    n, e = written(s, d)
    return X.capability_chain(n, e, hub(n, e, "component")[0]).agg(F.round(F.avg("confidence"), 6).alias("confidence"), F.count("*").alias("n_stages"))


def discovery_components(s, d):
    """Components that the words find, those of a relevance of 0.7 and more as directly affected."""
    n = nodes(s, d)
    found = X.seeds(n, ["ledger", "invoice"]).join(n.filter("type = 'component'").select("id"), "id", "left_semi")
    return found.select("id", F.when(F.col("relevance") >= 0.7, "direct").otherwise("indirect").alias("affected"))


def open_questions(s, d):
    """One question if several concepts are likely, and one for each gap that is not sure."""
    n = nodes(s, d)
    likely = X.seeds(n, ["ledger", "invoice"]).filter("relevance >= 0.6").agg(F.count("*").alias("n"))
    return likely.filter("n > 1").select(F.lit("focus").alias("question"), "n")


def _files(s):
    return s.createDataFrame(FILES, "file_id long, file_path string, language string, content string")


def fixture_import_statements(s, d):
    return L.imports_with_names(_files(s)).select("file_id", "line_no", "source", F.array_join("specifiers", ",").alias("specifiers"))


def fixture_import_edges(s, d):
    f = _files(s)
    resolved = L.import_edges(L.imports_with_names(f), f)
    names = s.createDataFrame([("web/src/ledger.ts", "Ledger", "component:Ledger", 1), ("web/src/ledger.ts", "Panel", "component:Panel", 2), ("web/src/ledger.ts", "Panel", "symbol:Panel", 3), ("web/lib/rows.ts", "Row", "component:Row", 4), ("svc/main.go", "Row", "component:Other", 0)], "file string, name string, id string, seq int")
    own = resolved.select(F.col("file").alias("source"), "target", F.lit("imports").alias("type"), F.lit(0.9).alias("confidence"))
    packages = L.package_edges(L.imports_with_names(f).select(F.col("file_path").alias("file"), "source"))
    return own.unionByName(L.specifier_edges(resolved, names)).unionByName(packages).select("source", "target", "type")


def fixture_base_types(s, d):
    return L.base_types(_files(s))


def fixture_inheritance(s, d):
    """Edges to the bases that some file declares, over literal rows of four languages."""
    f = s.createDataFrame(CLASSES, "file_id long, language string, content string")
    known = s.createDataFrame([("a.Base", "Base", "component:Base", 1), ("b.Base", "Base", "component:Other", 2), ("a.Reader", "Reader", "component:Reader", 3)], "qualified_name string, name string, id string, seq int")
    t = L.base_types(f).select(F.concat_ws(":", F.lit("component"), "file_id", "name").alias("id"), "base")
    return B.inheritance(t, known)


def fixture_test_frameworks(s, d):
    return L.frameworks_of_tests(s.createDataFrame([("@jest/globals",), ("org.junit.Test",), ("left-pad",), ("testing",), ("pytest",), ("pytest",), (None,)], "source string"))


def fixture_frameworks(s, d):
    return L.project_frameworks(s.createDataFrame(MANIFESTS, "file_path string, content string"))


def fixture_keys(s, d):
    f = s.createDataFrame([(1, "sql", TABLES)], "file_id long, language string, content string")
    return L.key_edges(_with_tables(E.foreign_keys(f), E.table_columns(f))).select("source", "target", "type")


def _with_tables(keys, columns):
    """Foreign keys, and a row without one for each table that has none of its own."""
    rest = columns.select("file_id", "table_name").distinct().join(keys.select("table_name").distinct(), "table_name", "left_anti")
    return keys.unionByName(rest, allowMissingColumns=True)


def built_graph(s, d):
    """Nodes and edges that the files give, by kind."""
    n, e = A.graph_of(load(s, d, "parse_results"))
    return n.groupBy(F.lit("node").alias("kind"), "type").agg(F.count("*").alias("n")).unionByName(e.groupBy(F.lit("edge").alias("kind"), "type").agg(F.count("*").alias("n")))


def fixture_graph(s, d):
    """The edges of the graph that a few files give, but for those of symbols and modules."""
    rows = [(i, "web", p, l, c) for i, p, l, c in FILES] + [(20, "web", "db/t.sql", "SQL", TABLES), (21, "web", "web/package.json", "json", "{}"), (22, "web", "svc/Dockerfile", "docker", "FROM x\n"), (23, "web", "web/src/base.ts", "typescript", "export class Base {}\nexport interface Reader {}\n"), (24, "web", "web/src/api.ts", "typescript", "app.get('/a', go);\nexport function go() {}\n"), (24, "web", "web/src/api.ts", "typescript", "app.get('/a', go);\nexport function go() {}\n")]
    _, e = A.graph_of(s.createDataFrame(rows, "file_id long, repo string, file_path string, language string, content string"))
    return e.filter("type NOT IN ('defined-in') AND NOT (type = 'contains' AND target LIKE 'component:%') AND NOT (type = 'contains' AND source LIKE 'module:%')").select("source", "target", "type")


def fixture_routes(s, d):
    return E.routes(E.lines_of(s.createDataFrame(ROUTED, "file_id long, file_path string, language string, content string")))


def fixture_projects(s, d):
    return B.projects(s.createDataFrame([("a/package.json",), ("a/b/go.mod",), ("Cargo.toml",), ("c/x.csproj",), ("c/y.sln",), ("d/package.json.bak",), ("a/package.json",), (None,)], "file_path string"))


def fixture_compose(s, d):
    f = s.createDataFrame([(1, "deploy/docker-compose.yml", "docker", COMPOSE), (2, "deploy/other.yml", "yaml", COMPOSE)], "file_id long, file_path string, language string, content string")
    t = E.compose_services(E.lines_of(f))
    return t.select("service", "image", F.array_join("ports", ",").alias("ports"), F.array_join("depends_on", ",").alias("depends_on"))


def fixture_import_resolution(s, d):
    f = s.createDataFrame([(1, "a/x.ts"), (2, "a/y.js"), (3, "a/y.ts"), (4, "lib/z/index.ts"), (5, "a/y.ts")], "file_id long, file_path string")
    i = s.createDataFrame([(1, "a/x.ts", 1, "./y"), (1, "a/x.ts", 2, "../lib/z"), (1, "a/x.ts", 3, "./none"), (1, "a/x.ts", 4, "left-pad"), (1, "a/x.ts", 5, "./y.js")], "file_id long, file_path string, line_no int, source string")
    return B.resolved_imports(i, f)


def fixture_handlers(s, d):
    e = s.createDataFrame([("api:GET:/a", "r.ts"), ("api:GET:/b", "none.ts")], "id string, file_path string")
    y = s.createDataFrame([("c", "class", "r.ts", 0), ("f", "function", "r.ts", 2), ("m", "method", "r.ts", 1)], "id string, kind string, file_path string, seq int")
    return B.endpoint_handlers(e, y)


def fixture_gaps(s, d):
    """What three chains lack: components without tests, a controller without a service, nothing at all."""
    kind = "stage string, id string"
    a = X.gaps(s.createDataFrame([("frontend-component", "c"), ("existing-tests", None), ("backend-controller", "h"), ("service-layer", None)], kind)).withColumn("chain", F.lit("a"))
    b = X.gaps(s.createDataFrame([("frontend-component", None), ("existing-tests", None)], kind)).withColumn("chain", F.lit("b"))
    return a.unionByName(b).unionByName(X.gaps(s.createDataFrame([("frontend-component", "c"), ("existing-tests", "t")], kind)).withColumn("chain", F.lit("c")))


def fixture_stale_tests(s, d):
    """Test stories of stale stories, over the stories of two workflows told flat."""
    stories = s.createDataFrame([("w1:s1", 0, "src/a/ledger.ts"), ("w1:s2", 0, "src/b.ts"), ("w2:s1", 1, "x\\y\\panel.ts"), ("w2:s1", 0, None)], "story_id string, place int, path string")
    stale = R.stale_stories(stories.filter("path IS NOT NULL"), s.createDataFrame([("repo/src/a/ledger.ts",), ("y/panel.ts",)], "path string"))
    return R.stale_tests(s.createDataFrame([("t1", "w1:s1"), ("t2", "w1:s2"), ("t3", "w2:s1"), ("t4", None)], "test_id string, story_id string"), stale).select("test_id", "story_id")


def fixture_history(s, d):
    h = s.createDataFrame([(1, "full-scan"), (2, "incremental"), (3, "full-scan"), (4, "incremental"), (5, None)], "generation int, trigger string")
    return history_summary(record_run(h, s.createDataFrame([(6, "incremental")], "generation int, trigger string")))


def fixture_resolution(s, d):
    return s.createDataFrame([(0.95,), (0.9,), (0.7,), (0.69,), (0.5,), (0.1,)], "confidence double").select("confidence", C.resolution_of("confidence").alias("resolution"))


def fixture_module_projects(s, d):
    m = s.createDataFrame([("apps/web/src",), ("apps/web",), ("libs/x",), ("z",)], "path string")
    p = s.createDataFrame([("apps/w", 2), ("apps/web", 1), (".", 3), ("libs", 4)], "path string, seq int")
    return L.module_projects(m, p)


QUERIES = {
    f.__name__: f
    for f in (
        find_edge, nodes_by_role, search_concepts, file_index, file_index_by_generation, symbol_search, symbols_by_kind, symbols_without_files, symbols_without_node, evidence_confident, evidence_resolved, evidence_order, evidence_sentences,
        node_merge_fields, edge_evidence, edge_snapshot_diff, edge_snapshot_report, edge_diff_back, top_consumers, extras_bag, tested_and_contained, impact_report_risk, import_statements, go_packages,
        sql_symbols, chat_keywords, token_sum, prompt_scores, invalid_json, node_items, dependency_cycles, dependency_maintainability, capability_confidence, discovery_components, open_questions,
        fixture_import_statements, fixture_import_edges, fixture_base_types, fixture_inheritance, fixture_frameworks, fixture_test_frameworks, fixture_keys, fixture_module_projects, built_graph, fixture_graph, fixture_routes, fixture_projects, fixture_compose, fixture_import_resolution, fixture_handlers, fixture_gaps, fixture_stale_tests, fixture_history, fixture_resolution,
    )
}

_ID = "nullif(replace(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'), '\\', '/'), '')"
INDEX = "idx AS (SELECT DISTINCT file_path, s.name AS name, s.kind AS kind FROM (SELECT file_path, unnest(symbols) AS s FROM parse_results WHERE file_path IS NOT NULL) WHERE s.name IS NOT NULL)"
FINDEX = "fidx AS (SELECT file_path, language, generation, byte_count FROM (SELECT file_path, lower(language) AS language, generation, byte_count, row_number() OVER (PARTITION BY file_path ORDER BY generation DESC NULLS LAST, file_id DESC) AS rn FROM parse_results WHERE file_path IS NOT NULL) WHERE rn = 1)"
EV = """ev0 AS (SELECT edge_id, unnest(generate_series(1, len(evidence))) AS pos, unnest(evidence) AS e FROM graph_edges),
ev AS (SELECT DISTINCT edge_id, pos, e.type AS kind, e.resolution AS resolution, coalesce(e.confidence, 0) AS confidence FROM ev0)"""


def _at(name, g):
    return f"""{name} AS (SELECT source, target, type, confidence, resolution FROM (SELECT *, row_number() OVER (PARTITION BY source, target, type ORDER BY generation_verified DESC, confidence DESC, resolution DESC NULLS LAST) AS rn
    FROM (SELECT {_ID.format(c="source")} AS source, {_ID.format(c="target")} AS target, type, greatest(0, least(1, coalesce(confidence, 0))) AS confidence, resolution, generation_verified FROM graph_edges WHERE generation_verified <= {g})
    WHERE source IS NOT NULL AND target IS NOT NULL AND type IS NOT NULL) WHERE rn = 1)"""


DIFF = f"""{_at("a", 12)}, {_at("b", 24)}, j AS (SELECT coalesce(a.source, b.source) AS source, coalesce(a.target, b.target) AS target, coalesce(a.type, b.type) AS type, a.source IS NULL AS fresh, b.source IS NULL AS gone,
    concat_ws(',', CASE WHEN abs(a.confidence - b.confidence) > 0.05 THEN 'confidence' END, CASE WHEN a.source IS NOT NULL AND b.source IS NOT NULL AND a.resolution IS DISTINCT FROM b.resolution THEN 'resolution' END) AS fields
    FROM a FULL JOIN b ON b.source = a.source AND b.target = a.target AND b.type = a.type),
diff AS (SELECT source, target, type, CASE WHEN fresh THEN 'added' WHEN gone THEN 'removed' ELSE 'modified' END AS change_type, CASE WHEN fresh OR gone THEN '' ELSE fields END AS changed_fields FROM j WHERE fresh OR gone OR fields <> '')"""
_NL = "replace(content, chr(13) || chr(10), chr(10))"
FT = f"ft AS (SELECT DISTINCT file_id, file_path, lower(language) AS language, {_NL} AS t FROM parse_results WHERE content IS NOT NULL)"
#: In the tables every import statement of these languages stands on one line, so the SQL goes line by line.
STATEMENTS = f"""{FT}, ls AS (SELECT file_id, unnest(generate_series(1, len(string_split(t, chr(10))))) AS line_no, unnest(string_split(t, chr(10))) AS l FROM ft WHERE language IN ('typescript', 'javascript')),
ims AS (SELECT file_id, CAST(line_no AS INT) AS line_no, regexp_extract(l, '^[ \\t]*import\\b[^''"();]*[''"]([^''"]+)[''"]', 1) AS source, regexp_extract(l, '^[ \\t]*import[ \\t]+(\\w+)', 1) AS d, regexp_extract(l, '\\* as (\\w+)', 1) AS ns, regexp_extract(l, '\\{{([^}}]*)\\}}', 1) AS named
    FROM ls WHERE regexp_matches(l, '^[ \\t]*import\\b[^''"();]*[''"][^''"]+[''"]')),
gos AS (SELECT file_id, 1 AS line_no, unnest(CASE WHEN regexp_matches(t, 'import\\s*\\(') THEN regexp_extract_all(regexp_extract(t, 'import\\s*\\(([^)]*)\\)', 1), '"([^"]+)"', 1) ELSE regexp_extract_all(t, '(?m)^\\s*import\\s+"([^"]+)"', 1) END) AS source FROM ft WHERE language = 'go'),
statements AS (SELECT DISTINCT file_id, line_no, source, array_to_string(list_filter([d, ns] || list_transform(string_split(named, ','), lambda p: regexp_extract(p, '(\\w+)', 1)), lambda x: x <> ''), ',') AS specifiers FROM ims
    UNION SELECT file_id, line_no, source, string_split(source, '/')[-1] FROM gos)"""
_STOP = ", ".join(f"'{w}'" for w in "a an the is are was were be been being have has had do does did will would could should may might can shall to of in for on with at by from as into through during before after above below between and but or not no nor so yet both either neither each every all any few more most other some such than too very just also add new feature request want need like please i we you it this that these those".split())
ORACLE = {
    "find_edge": f"WITH {EDGES}, k AS (SELECT source, target FROM edges WHERE type = 'calls' ORDER BY source, target LIMIT 1) SELECT source, target, type, confidence FROM edges WHERE type = 'calls' AND (source, target) IN (SELECT (source, target) FROM k)",
    "search_concepts": f"WITH {NODES} SELECT id FROM nodes WHERE type = 'project' AND (contains(lower(coalesce(name, '')), 'a') OR contains(lower(coalesce(qualified_name, '')), 'a') OR contains(lower(coalesce(description, '')), 'a'))",
    "file_index": f"WITH {FINDEX} SELECT * FROM fidx",
    "file_index_by_generation": f"WITH {FINDEX} SELECT generation, language, count(*) AS n FROM fidx GROUP BY ALL",
    "symbol_search": f"WITH {INDEX} SELECT * FROM idx WHERE contains(lower(name), 'ledger')",
    "symbols_by_kind": f"WITH {INDEX} SELECT kind, count(*) AS n FROM idx GROUP BY kind",
    "symbols_without_files": f"WITH {INDEX}, bad AS (SELECT DISTINCT replace(file_path, '\\', '/') AS file_path FROM scan_errors WHERE file_path IS NOT NULL), whole AS (SELECT * FROM idx WHERE file_path NOT IN (SELECT file_path FROM bad) UNION SELECT file_path, '?', 'unknown' FROM bad) SELECT kind, count(*) AS n FROM whole GROUP BY kind",
    "symbols_without_node": f"WITH {NODES}, {INDEX} SELECT * FROM idx i WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.type IN ('symbol', 'component', 'database-table') AND n.file_path = i.file_path AND n.name = i.name)",
    "evidence_confident": f"WITH {EV} SELECT kind, resolution, count(*) AS n FROM ev WHERE confidence >= 0.8 GROUP BY ALL",
    "evidence_resolved": f"WITH {EV} SELECT kind, count(*) AS n FROM ev WHERE resolution IN ('confirmed', 'resolved') GROUP BY ALL",
    "evidence_order": f"WITH {EV} SELECT edge_id, count(*) AS n, max(confidence) AS surest, CAST(count(*) AS INT) AS last FROM ev GROUP BY edge_id",
    "evidence_sentences": """WITH c AS (SELECT edge_id, coalesce(evidence, []) AS e FROM graph_edges), k AS (SELECT edge_id, len(e) AS n, len(list_filter(e, lambda x: x.resolution = 'confirmed')) AS a, len(list_filter(e, lambda x: x.resolution = 'resolved')) AS b, len(list_filter(e, lambda x: x.resolution = 'heuristic')) AS c,
        len(list_filter(e, lambda x: x.resolution = 'unresolved')) AS d, coalesce(list_sum(list_transform(e, lambda x: coalesce(x.confidence, 0))), 0) AS t FROM c)
        SELECT DISTINCT edge_id, n || ' evidence items (' || concat_ws(', ', CASE WHEN a > 0 THEN a || ' confirmed' END, CASE WHEN b > 0 THEN b || ' resolved' END, CASE WHEN c > 0 THEN c || ' heuristic' END, CASE WHEN d > 0 THEN d || ' unresolved' END) || '). Overall confidence: ' || CAST(floor(CASE WHEN n > 0 THEN t / n ELSE 0 END * 100 + 0.5) AS BIGINT) || '%.' AS said FROM k""",
    "node_merge_fields": "WITH o AS (SELECT *, struct_pack(a := generation_created, b := coalesce(generation_updated, -1), c := coalesce(loaded_at, TIMESTAMP '1900-01-01')) AS o_at FROM graph_nodes WHERE id IS NOT NULL) SELECT id, "
    + ", ".join(f"(max(struct_pack(k := o_at, v := {c})) FILTER (WHERE {c} IS NOT NULL)).v AS {c}" for c in ("type", "name", "qualified_name", "description", "file_path", "language"))
    + ", min(generation_created) AS generation_created, max(generation_updated) AS generation_updated FROM o GROUP BY id",
    "edge_snapshot_diff": f"WITH {DIFF} SELECT * FROM diff",
    "edge_snapshot_report": f"WITH {DIFF} SELECT type, change_type, changed_fields, count(*) AS n FROM diff GROUP BY ALL",
    "edge_diff_back": f"WITH {DIFF} SELECT CASE change_type WHEN 'added' THEN 'removed' WHEN 'removed' THEN 'added' ELSE change_type END AS change_type, count(*) AS n FROM diff GROUP BY 1",
    "top_consumers": f"WITH {EDGES} SELECT target AS id, count(DISTINCT source) AS n FROM edges WHERE type IN ('imports', 'depends-on', 'uses-package', 'calls', 'api-flow') GROUP BY 1 ORDER BY n DESC, id LIMIT 15",
    "extras_bag": f"WITH RECURSIVE {BASE}, {hub_cte(type_='component')}, {steps_cte()}, {bfs_cte(1)}, bag AS (SELECT 'test' AS kind, source AS id FROM edges WHERE type = 'tests' AND target IN (SELECT id FROM reached) UNION ALL SELECT 'api', source FROM edges WHERE type IN ('handles-route', 'api-flow', 'calls') AND target IN (SELECT id FROM reached) UNION ALL SELECT 'config', source FROM edges WHERE type IN ('configures', 'feature-flag', 'imports') AND target IN (SELECT id FROM reached)) SELECT kind, id, count(*) AS n FROM bag GROUP BY ALL",
    "tested_and_contained": f"WITH {EDGES} SELECT target AS id FROM edges WHERE type = 'tests' INTERSECT SELECT target FROM edges WHERE type = 'contains'",
    "impact_report_risk": f"""WITH {BASE}, c AS (SELECT n.id, (SELECT count(DISTINCT source) FROM edges e WHERE e.target = n.id AND e.type IN ('imports', 'depends-on', 'calls', 'extends', 'implements', 'type-reference')) AS d, (SELECT count(*) FROM edges e WHERE e.target = n.id AND e.type = 'tests') AS t FROM nodes n WHERE n.type = 'file')
        SELECT CASE WHEN d > 50 THEN 'critical' WHEN d > 20 THEN 'high' WHEN d > 5 OR t > 3 THEN 'medium' ELSE 'low' END AS risk, count(*) AS n FROM c GROUP BY 1""",
    "import_statements": f"WITH {STATEMENTS} SELECT * FROM statements",
    "go_packages": f"WITH {STATEMENTS} SELECT 'ext:' || source AS id, count(DISTINCT file_path) AS n_files FROM (SELECT DISTINCT g.file_id, f.file_path, source FROM gos g JOIN ft f ON f.file_id = g.file_id) WHERE NOT (starts_with(source, '.') OR starts_with(source, '/')) GROUP BY 1",
    "sql_symbols": f"""WITH {FT}, tabs AS (SELECT file_id, unnest(regexp_extract_all(t, '(?is)create\\s+table\\s+(?:if\\s+not\\s+exists\\s+)?(\\w+)\\s*\\(.*?\\);', 1)) AS tab, unnest(regexp_extract_all(t, '(?is)create\\s+table\\s+(?:if\\s+not\\s+exists\\s+)?\\w+\\s*\\((.*?)\\);', 1)) AS body FROM ft WHERE language = 'sql'),
        cols AS (SELECT file_id, tab, trim(unnest(string_split(body, ',')), ' ' || chr(10) || chr(9)) AS c FROM tabs), named AS (SELECT file_id, tab, regexp_extract(c, '^(\\w+)\\s+[A-Za-z0-9_()]+', 1) AS c FROM cols WHERE regexp_matches(c, '^\\w+\\s+[A-Za-z0-9_()]+') AND NOT regexp_matches(c, '(?i)^(primary|foreign)\\s+key'))
        SELECT DISTINCT file_id, tab AS name, 'table:' || tab AS qualified_name, 'table' AS kind FROM named UNION ALL SELECT DISTINCT file_id, tab || '.' || c, 'column:' || tab || '.' || c, 'column' FROM named""",
    "chat_keywords": f"WITH w AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\s+'), lambda x: lower(regexp_replace(x, '[^a-zA-Z0-9_-]', '', 'g'))), lambda x: length(x) > 2 AND NOT list_contains([{_STOP}], x)) AS k FROM documents WHERE text IS NOT NULL) SELECT doc_id, CAST(len(k) AS INT) AS n, array_to_string(k[1:5], ' ') AS first FROM w",
    "token_sum": "SELECT source, sum(greatest(1, CAST(ceil(length(text) / 4.0) AS BIGINT))) AS tokens, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY source",
    "prompt_scores": f"WITH {NODES}, r AS (SELECT split_part(file_path, '/', 1) AS repo, count(*) FILTER (WHERE type = 'component') AS e, count(*) FILTER (WHERE type = 'test-suite') AS t FROM nodes WHERE file_path IS NOT NULL GROUP BY 1) SELECT doc_id, 5 AS intent_preservation, 4 AS clarity, CASE WHEN e > 0 THEN 5 ELSE 3 END AS specificity, CASE WHEN e > 0 THEN 5 ELSE 2 END AS repository_fit, CASE WHEN t > 0 THEN 5 ELSE 3 END AS testability, 5 AS token_efficiency FROM documents d LEFT JOIN r ON r.repo = d.repo WHERE text IS NOT NULL",
    "invalid_json": f"WITH {FT} SELECT CASE WHEN json_valid(t) THEN '' ELSE 'invalid JSON' END AS error, count(*) AS n FROM ft WHERE language = 'json' GROUP BY 1",
    "node_items": f"WITH {NODES} SELECT id, type, coalesce(name, id) AS label, coalesce(file_path, '') AS path, CAST(0.95 AS DOUBLE) AS confidence FROM nodes",
    "dependency_cycles": f"""WITH RECURSIVE {BASE}, f AS (SELECT id FROM nodes WHERE type IN ('file', 'module')), e AS (SELECT DISTINCT source AS s, target AS t FROM edges WHERE type IN ('imports', 'depends-on') AND source <> target AND source IN (SELECT id FROM f) AND target IN (SELECT id FROM f)),
        reach AS (SELECT s, t FROM e UNION SELECT r.s, e.t FROM reach r JOIN e ON e.s = r.t), same AS (SELECT a.s AS id, a.t AS other FROM reach a JOIN reach b ON b.s = a.t AND b.t = a.s),
        least_of AS (SELECT id, min(other) AS component FROM same GROUP BY id) SELECT id, component, count(*) OVER (PARTITION BY component) AS size FROM least_of""",
    "nodes_by_role": f"WITH {NODES} SELECT id FROM (SELECT id, {ROLE} AS role FROM (SELECT id, type, language, coalesce(file_path, '') AS file_path FROM nodes) WHERE type = 'component') WHERE role = 'service'",
    "edge_evidence": f"""WITH o AS (SELECT {_ID.format(c="source")} AS source, {_ID.format(c="target")} AS target, type, evidence, rank() OVER (PARTITION BY edge_id ORDER BY generation_verified DESC NULLS LAST) AS rn FROM graph_edges),
        x AS (SELECT DISTINCT source, target, type, unnest(evidence) AS e FROM o WHERE rn = 1 AND source IS NOT NULL AND target IS NOT NULL AND type IS NOT NULL) SELECT source, target, type, CAST(count(*) AS INT) AS n, max_by(e.confidence, coalesce(e.confidence, 0)) AS surest FROM x GROUP BY ALL""",
    "capability_confidence": f"SELECT round(avg(confidence), 6) AS confidence, count(*) AS n_stages FROM ({REPORTS['capability_chain']})",
    "discovery_components": f"WITH {NODES} SELECT s.id, CASE WHEN s.relevance >= 0.7 THEN 'direct' ELSE 'indirect' END AS affected FROM ({REPORTS['seed_relevance']}) s JOIN nodes n ON n.id = s.id WHERE n.type = 'component'",
    "open_questions": f"SELECT 'focus' AS question, count(*) AS n FROM ({REPORTS['seed_relevance']}) WHERE relevance >= 0.6 HAVING count(*) > 1",
    "dependency_maintainability": REPORTS["maintainability"].replace(f"type IN {sql_list(CYCLE_TYPES)} AND source <> target", "type IN ('imports', 'depends-on') AND source <> target AND source IN (SELECT id FROM nodes WHERE type IN ('file', 'module')) AND target IN (SELECT id FROM nodes WHERE type IN ('file', 'module'))"),
    "fixture_inheritance": "SELECT a AS source, b AS target FROM (VALUES ('component:1:A', 'component:Base'), ('component:1:A', 'component:Reader'), ('component:2:B', 'component:Base'), ('component:2:B', 'component:Reader'), ('component:3:C', 'component:Base'), ('component:3:C', 'component:Reader')) t(a, b)",
    "fixture_test_frameworks": "SELECT a AS name, 'testing' AS category FROM (VALUES ('Jest'), ('JUnit'), ('Go testing'), ('pytest')) t(a)",
    "fixture_import_statements": "SELECT CAST(a AS BIGINT) AS file_id, b AS line_no, c AS source, d AS specifiers FROM (VALUES (1, 1, './ledger', 'Ledger,Panel'), (1, 2, '../lib/rows.js', 'Row'), (1, 5, './side', ''), (1, 6, 'fs-extra', 'fs,all'), (5, 1, 'fmt', 'fmt'), (5, 1, 'code.example/svc/store', 'store'), (6, 1, 'os', 'os')) t(a, b, c, d)",
    "fixture_import_edges": "SELECT a AS source, b AS target, c AS type FROM (VALUES ('web/src/app.ts', 'web/src/ledger.ts', 'imports'), ('web/src/app.ts', 'web/lib/rows.ts', 'imports'), ('web/src/app.ts', 'web/src/side/index.ts', 'imports'), ('web/src/app.ts', 'component:Ledger', 'depends-on'), ('web/src/app.ts', 'component:Panel', 'depends-on'), ('web/src/app.ts', 'component:Row', 'depends-on'), ('web/src/app.ts', 'ext:fs-extra', 'uses-package'), ('svc/main.go', 'ext:fmt', 'uses-package'), ('svc/main.go', 'ext:code.example/svc/store', 'uses-package'), ('svc/one.go', 'ext:os', 'uses-package')) t(a, b, c)",
    "fixture_base_types": "SELECT CAST(2 AS BIGINT) AS file_id, 'Ledger' AS name, a AS relation, b AS base FROM (VALUES ('extends', 'Base'), ('implements', 'Reader'), ('implements', 'Writer')) t(a, b)",
    "fixture_frameworks": "SELECT a AS file_path, b AS framework, c AS version, d AS category FROM (VALUES ('a/package.json', 'Next.js', '14.1.0', 'frontend'), ('b/package.json', 'Express', '5.0.0', 'backend'), ('c/package.json', 'NestJS', '10.2.1', 'backend')) t(a, b, c, d)",
    "fixture_keys": "SELECT a AS source, b AS target, 'depends-on' AS type FROM (VALUES ('table:customer', 'table:region'), ('table:orders', 'table:customer')) t(a, b)",
    "fixture_graph": "SELECT a AS source, b AS target, c AS type FROM (VALUES ('file:web/src/app.ts', 'file:web/src/ledger.ts', 'imports'), ('file:web/src/app.ts', 'file:web/lib/rows.ts', 'imports'), ('file:web/src/app.ts', 'file:web/src/side/index.ts', 'imports'), ('file:web/src/app.ts', 'component:web/src/ledger.ts:Ledger', 'depends-on'), ('file:web/src/app.ts', 'component:web/src/ledger.ts:Panel', 'depends-on'), ('file:web/src/app.ts', 'component:web/lib/rows.ts:Row', 'depends-on'), ('file:web/src/app.ts', 'ext:fs-extra', 'uses-package'), ('file:svc/main.go', 'ext:fmt', 'uses-package'), ('file:svc/main.go', 'ext:code.example/svc/store', 'uses-package'), ('file:svc/one.go', 'ext:os', 'uses-package'), ('file:svc/Dockerfile', 'ext:x', 'uses-package'), ('component:web/src/ledger.ts:Ledger', 'component:web/src/base.ts:Base', 'extends'), ('component:web/src/ledger.ts:Ledger', 'component:web/src/base.ts:Reader', 'implements'), ('table:customer', 'table:region', 'depends-on'), ('table:orders', 'table:customer', 'depends-on'), ('file:db/t.sql', 'table:customer', 'contains'), ('file:db/t.sql', 'table:region', 'contains'), ('file:db/t.sql', 'table:orders', 'contains'), ('file:web/src/api.ts', 'api:GET:/a', 'contains'), ('api:GET:/a', 'symbol:web/src/api.ts:go', 'api-flow'), ('project:web', 'module:web/src', 'contains'), ('project:web', 'module:web/lib', 'contains'), ('project:web', 'module:web/package.json', 'contains')) t(a, b, c)",
    "fixture_routes": "SELECT CAST(a AS BIGINT) AS file_id, b AS line_no, c AS method, d AS path FROM (VALUES (1, 1, 'GET', '/users'), (1, 2, 'POST', '/items'), (1, 3, 'DELETE', '/x'), (2, 1, 'GET', '/home'), (2, 2, 'PUT', '/y'), (3, 1, 'GET', '/j'), (4, 1, 'POST', '/c'), (5, 1, 'GET', '/r'), (6, 1, 'GET', '/g')) t(a, b, c, d)",
    "fixture_projects": "SELECT a AS path, b AS kind FROM (VALUES ('a', 'npm'), ('a/b', 'go-module'), ('.', 'cargo'), ('c', 'dotnet')) t(a, b)",
    "fixture_compose": "SELECT a AS service, b AS image, c AS ports, d AS depends_on FROM (VALUES ('web', 'nginx:1', '80:80', 'cache,db'), ('db', 'postgres', '', '')) t(a, b, c, d)",
    "fixture_import_resolution": "SELECT CAST(1 AS BIGINT) AS file_id, a AS line_no, b AS source, CAST(c AS BIGINT) AS target_id FROM (VALUES (1, './y', 3), (2, '../lib/z', 4), (5, './y.js', 2)) t(a, b, c)",
    "fixture_handlers": "SELECT 'api:GET:/a' AS source, 'm' AS target",
    "fixture_gaps": "SELECT a AS chain, b AS gap FROM (VALUES ('a', 'tests'), ('a', 'service'), ('b', 'nothing-found')) t(a, b)",
    "fixture_stale_tests": "SELECT a AS test_id, b AS story_id FROM (VALUES ('t1', 'w1:s1'), ('t3', 'w2:s1')) t(a, b)",
    "fixture_history": "SELECT 6 AS current, CAST(6 AS BIGINT) AS runs, 3 AS last_full, 6 AS last_incremental",
    "fixture_resolution": "SELECT CAST(a AS DOUBLE) AS confidence, b AS resolution FROM (VALUES (0.95, 'confirmed'), (0.9, 'confirmed'), (0.7, 'resolved'), (0.69, 'heuristic'), (0.5, 'heuristic'), (0.1, 'unresolved')) t(a, b)",
    "fixture_module_projects": "SELECT a AS source, b AS target FROM (VALUES ('project:apps/web', 'module:apps/web/src'), ('project:apps/web', 'module:apps/web'), ('project:.', 'module:libs/x'), ('project:.', 'module:z')) t(a, b)",
}
