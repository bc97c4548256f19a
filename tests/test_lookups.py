"""Indexes, evidence, changes of edges, imports, frameworks, server, status: dirty rows and empty tables."""

import io
import json
import threading

import pytest
from pyspark.sql import functions as F

from codeloom import runtime
from codeloom.functions import frameworks as FW
from codeloom.operators import context as X
from codeloom.operators import graph as G
from codeloom.operators import lookups as L
from codeloom.plans.server import answer, serve
from codeloom.sources import files as FS
from codeloom.sources import store as ST
from codeloom.streaming import changes as CH
from codeloom.streaming.status import SingleFlight, Status

EDGE = "edge_id string, source string, target string, type string, resolution string, confidence double, evidence array<struct<type:string,source:string,description:string,resolution:string,confidence:double>>, generation_created int, generation_verified int"


@pytest.fixture(scope="module")
def edges(spark):
    e = lambda c, r="confirmed": ("t", "s", "d", r, c)
    rows = [
        ("1", " a\t", "b\\c", "calls", "confirmed", 0.9, [e(0.9), e(0.9), e(None, None)], 1, 2),
        ("1", "a", "b/c", "calls", "confirmed", 0.9, [e(0.9), e(0.9), e(None, None)], 1, 2),
        ("2", "a", "b/c", "calls", "heuristic", 0.5, [e(0.3, "heuristic")], 1, 9),
        ("3", None, "b", "calls", None, None, None, None, None),
        ("4", "", "b", None, "x", 7.0, [], 1, 1),
    ]
    return spark.createDataFrame(rows, EDGE).withColumn("name", F.lit("clash"))


def test_evidence(spark, edges):
    got = {(r.source, r.target, r.type): [x.confidence for x in r.evidence] for r in L.merged_evidence(edges).collect()}
    assert got == {("a", "b/c", "calls"): [0.9, 0.3, None]}
    rows = sorted(map(tuple, L.evidence_rows(edges).collect()))
    assert [r[:2] for r in rows] == [("1", 1), ("1", 2), ("1", 3), ("2", 1)] and rows[2][4] == 0.0
    assert L.evidence_rows(edges, 0.5).count() == 2 and L.evidence_rows(edges, 0.0, ["heuristic"]).count() == 1
    said = {r.edge_id: r.s for r in edges.select("edge_id", FW.evidence_sentence("evidence").alias("s")).collect()}
    assert said["1"] == "3 evidence items (2 confirmed). Overall confidence: 60%." and said["3"] == said["4"] == "0 evidence items (). Overall confidence: 0%."
    assert L.merged_evidence(edges.limit(0)).count() == 0 and L.evidence_rows(edges.limit(0)).count() == 0


def test_edge_diff(spark, edges):
    a, b = L.edges_at(edges, 5), L.edges_at(edges, 9)
    assert [tuple(r) for r in L.edge_diff(a, b).collect()] == [("a", "b/c", "calls", "modified", "confidence,resolution")]
    assert L.edge_diff(a, a).count() == 0 and [r.change_type for r in L.edge_diff(a, b.limit(0)).collect()] == ["removed"] and [r.change_type for r in L.edge_diff(a.limit(0), b).collect()] == ["added"]


def test_merged_nodes(spark):
    rows = [("x", "file", "old", None, "kept", "p", "go", 1, 1, None), ("x", "file", None, "q", None, "p2", None, 2, None, None), (None, "file", "n", None, None, None, None, 1, 1, None), ("x", "file", "old", None, "kept", "p", "go", 1, 1, None)]
    n = spark.createDataFrame(rows, "id string, type string, name string, qualified_name string, description string, file_path string, language string, generation_created int, generation_updated int, loaded_at timestamp")
    assert [tuple(r) for r in L.merged_nodes(n).collect()] == [("x", "file", "old", "q", "kept", "p2", "go", 1, 1)]
    assert L.merged_nodes(n.limit(0)).count() == 0


def test_indexes(spark):
    f = spark.createDataFrame([(1, "a.ts", "TypeScript", 1, 5, [("Ledger", "class"), (None, "x"), ("Ledger", "class")]), (2, "a.ts", None, 2, 6, None), (3, None, "go", 1, 1, [("q", "function")])], "file_id long, file_path string, language string, generation int, byte_count long, symbols array<struct<name:string,kind:string>>")
    assert [tuple(r) for r in L.file_index(f).collect()] == [("a.ts", None, 2, 6)]
    index = L.symbol_index(f)
    assert [tuple(r) for r in index.collect()] == [("a.ts", "Ledger", "class")]
    assert L.search_symbols(index, "LEDG").count() == 1 and L.search_symbols(index, "ledg", "enum").count() == 0
    assert L.add_symbols(index, index).count() == 1 and L.remove_files(index, f.select("file_path")).count() == 0
    assert L.symbol_index(f.limit(0)).count() == 0 and L.file_index(f.limit(0)).count() == 0


def test_imports_and_bases_of_dirty_texts(spark):
    f = spark.createDataFrame([(1, "a.ts", "typescript", ""), (2, None, "typescript", "import x from 'y';\r\nimport x from 'y';\r\n" + "z " * 50_000), (2, None, "typescript", "import x from 'y';\r\nimport x from 'y';\r\n" + "z " * 50_000), (3, "a", None, "import q from 'r'"), (4, "b.ts", "typescript", "const a = import('x'); import('y')\nexport { z } from 'w';\n")], "file_id long, file_path string, language string, content string")
    assert sorted((r.file_id, r.line_no, r.source, tuple(r.specifiers)) for r in L.imports_with_names(f).collect()) == [(2, 1, "y", ("x",)), (2, 2, "y", ("x",))]
    assert L.imports_with_names(f.limit(0)).count() == 0 and L.base_types(f).count() == 0


def test_requests(spark):
    words = spark.createDataFrame([("Please add the Ledger-export, to IT: and audit_log!",), ("",), (None,)], "t string").select(FW.chat_keywords("t").alias("w")).collect()
    assert [r.w for r in words] == [["ledger-export", "audit_log"], [], None]
    risk = lambda *x: FW.report_risk(*map(F.lit, x))
    row = spark.range(1).select(risk(0, 0, 0, 0, 0).alias("a"), risk(3, 3, 0, 0, 0).alias("b"), risk(0, 0, 0, 0, 1).alias("c"), risk(51, 0, 0, 0, 0).alias("d"), risk(0, 0, 4, 0, 0).alias("e")).first()
    assert tuple(row) == ("low", "medium", "high", "critical", "medium")


def test_context_seeds(spark):
    s = X.context_seeds(spark.createDataFrame([("a", 10.0), ("b", 1.0)], "id string, score double"), spark.createDataFrame([("b", 0.9), ("c", 0.4)], "id string, relevance double"), spark.createDataFrame([("c",)], "id string"))
    assert {(r.id, r.relevance) for r in s.collect()} == {("a", 1.0), ("b", 0.2), ("c", 1.0)}


def test_impact_ways(spark):
    n = spark.createDataFrame([("a", "file"), ("b", "file"), ("c", "file"), ("t", "test-suite"), ("s", "service"), ("p", "api-endpoint")], "id string, type string")
    e = spark.createDataFrame([("b", "a", "imports", 1.0), ("c", "b", "calls", 1.0), ("t", "b", "tests", 1.0), ("a", "s", "uses", 1.0), ("p", "a", "handles-route", 1.0), ("a", "a", "calls", 1.0)], "source string, target string, type string, confidence double")
    assert {tuple(r) for r in G.impact(n, e, n.filter("id = 'a'").select("id"), 2).collect()} == {("b", "direct"), ("c", "transitive"), ("t", "test"), ("p", "api"), ("s", "service")}
    assert G.impact(n, e, n.limit(0).select("id"), 2).count() == 0


class Fake:
    def __init__(self, spark):
        self.spark = spark

    def search_codebase(self, query, limit=3):
        return self.spark.range(limit)

    def list_api_endpoints(self):
        raise RuntimeError("boom\nmore")


def test_server(spark):
    ask = lambda **r: answer(Fake(spark), json.dumps({"jsonrpc": "2.0", "id": 1, **r}))
    assert ask(method="search_codebase", params={"query": "x", "limit": 2})["result"] == {"rows": [{"id": 0}, {"id": 1}], "truncated": False}
    assert ask(method="tools/call", params={"name": "search_codebase", "arguments": {"query": "x", "limit": 300}})["result"]["truncated"]
    assert ask(method="nothing")["error"]["code"] == -32601 and ask(method="search_codebase", params={"q": 1})["error"]["code"] == -32602
    assert ask(method="search_codebase", params={})["error"]["code"] == -32602 and ask(method="list_api_endpoints")["error"] == {"code": -32603, "message": "boom"}
    assert answer(Fake(spark), "{")["error"]["code"] == -32700 and answer(Fake(spark), "[]")["error"]["code"] == -32600
    assert len(ask(method="tools/list")["result"]["tools"]) == 9 and answer(Fake(spark), '{"method": "tools/list"}') is None
    out = io.StringIO()
    serve(Fake(spark), io.StringIO('\n{"id": 2, "method": "tools/list"}\n'), out)
    assert json.loads(out.getvalue())["id"] == 2


def test_status_and_single_flight():
    s, heard = Status(), []
    stop = s.listen(lambda a, b: heard.append((a, b)))
    s.become("scanning")
    with pytest.raises(ValueError):
        s.become("ready")
    stop()
    s.become("analyzing")
    assert heard == [("idle", "scanning")] and s.state == "analyzing"
    f, runs, gate = SingleFlight(), [], threading.Event()

    def job():
        runs.append(1)
        gate.wait(5)
        return 7

    got = []
    threads = [threading.Thread(target=lambda: got.append(f.run(job))) for _ in range(3)]
    for t in threads:
        t.start()
    while not runs:
        pass
    threading.Timer(0.3, gate.set).start()
    for t in threads:
        t.join()
    assert got == [7, 7, 7] and len(runs) == 1
    with pytest.raises(ZeroDivisionError):
        f.run(lambda: 1 / 0)


def test_store(spark, tmp_path):
    h = spark.createDataFrame([(1, "full-scan"), (2, "incremental")], "generation int, trigger string")
    ST.save_history(h, str(tmp_path / "h"))
    assert tuple(ST.history_summary(ST.load_history(spark, str(tmp_path / "h"))).first()) == (2, 2, 1, 2)
    artifacts = [{"path": "a/b.md", "content": "x", "selected": True}, {"path": "c.md", "content": "y", "selected": False}, {"path": "../d.md", "content": "z", "selected": True}]
    assert ST.write_artifacts(artifacts, str(tmp_path / "out")) == (["a/b.md"], ["../d.md"]) and (tmp_path / "out/a/b.md").read_text() == "x"


def test_skipped_files(spark, tmp_path):
    for name, text in (("a.py", "x = 1"), ("b.py", "y" * 100), ("c.unknown", "z"), ("d/e.py", "w")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {(r.file_path, r.error) for r in FS.skipped(spark, str(tmp_path), ["**/d/**", "d/**"], 50).collect()}
    assert got == {("b.py", "too large"), ("c.unknown", "unknown language"), ("d/e.py", "excluded")}


def test_changes_of_files(spark):
    n = spark.createDataFrame([("file:a", "a"), ("sym:a:f", "a"), ("file:b", "b"), ("x", None)], "id string, file_path string")
    e = spark.createDataFrame([("file:a", "sym:a:f"), ("file:b", "x"), ("file:b", "file:a")], "source string, target string")
    ev = spark.createDataFrame([("a", "delete", None, None), (None, "delete", None, None), ("b", "update", "q", None)], CH.EVENTS)
    left, kept = CH.drop_files(n, e, ev)
    assert {r.id for r in left.collect()} == {"file:b", "x"} and {tuple(r) for r in kept.collect()} == {("file:b", "x")}
    f = spark.createDataFrame([("a", "old", "h", 3)], "path string, content string, hash string, generation int")
    assert {(r.path, r.content, r.generation) for r in CH.live_view(f, "a", "new").collect()} == {("a", "new", 3)}


def test_shared_folder_and_small_tables(spark, monkeypatch):
    t = runtime.cut(spark.range(10))
    assert "broadcast" in runtime.small(t)._jdf.queryExecution().logical().toString().lower() or runtime.small(t) is not t
    assert runtime.small(t, most=1) is t and runtime.small(t, rows=5) is t
    runtime.release(t)

    class Cluster:
        master = "spark://host:7077"

        def getConf(self):
            return self

        def get(self, *_):
            return None

    class Session:
        sparkContext = Cluster()
        conf = Cluster()

    with pytest.raises(RuntimeError):
        runtime.shared_dir(Session())
