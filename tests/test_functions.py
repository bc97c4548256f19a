"""Column functions, extraction, stores, streams and repair."""

import json

import pytest
from pyspark.sql import functions as F

from codeloom.functions import columns as C
from codeloom.functions import repair
from codeloom.operators import build as B
from codeloom.operators import extract as E
from codeloom.operators import search as S
from codeloom.sources import files as SF
from codeloom.sources import store as ST
from codeloom.streaming import changes as T


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_tokens_and_hash(spark):
    t = lambda x: one(spark, C.tokens(F.lit(x)))[0]
    assert t("UserController") == ["user", "controller"] and t("handle_stripe_webhook") == ["handle", "stripe", "webhook"] and t("parseHTTPResponse") == ["parse", "http", "response"] and t("auth-guard.service.ts") == ["auth", "guard", "service", "ts"] and t("") == []
    assert one(spark, C.fnv1a(F.lit("user")))[0] == 1618501362


def test_path_rules(spark):
    r = one(spark, C.language_of(F.lit("a/Dockerfile")), C.language_of(F.lit("x/y.tsx")), C.language_of(F.lit("x/y.zzz")), C.layer_of(F.lit("a/tests/x.ts")), C.layer_of(F.lit("tests/x.ts")), C.role_of(F.lit("a/user.service.ts"), F.lit("typescript")), C.role_of(F.lit("a/acct.service.test.ts"), F.lit("typescript")))
    assert list(r) == ["docker", "typescript", None, "test", "unknown", "service", "test"]
    r = one(spark, C.module_of(F.lit("src/core/x.ts")), C.module_of(F.lit("a/b/c/d")), C.module_of(F.lit("a")), C.folded_path(F.lit("a/b/../c/./d")))
    assert list(r) == ["src/core/x.ts", "a/b", None, "a/c/d"]
    ex = lambda p, x: one(spark, C.excluded_by(F.lit(p), F.lit(x)))[0]
    assert ex("a/node_modules/b.js", "**/node_modules/**") and ex("a/x.min.js", "**/*.min.js") and not ex("a/b.js", "**/dist/**") and ex("a/.env", "zzz")


def test_complexity_and_grades(spark):
    text = "if (a) { for (;;) { while (b) { } } } else if (c && d || e) { x ? y : z }"
    assert one(spark, C.complexity(F.lit(text), F.lit(4)))[0] == 1 + 2 + 1 + 1 + 1 + 1 + 1 + 1 + 1
    assert one(spark, C.maintainability_grade(C.maintainability(F.lit(1.0), F.lit(0.0), F.lit(0), F.lit(0))))[0] == "A"


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "file_id long, file_path string, language string, content string")


def test_symbols_and_imports(spark):
    f = files(
        spark,
        (1, "src/a.ts", "typescript", "import x from './b.js';\nexport class A extends B {\n}\nexport const f = (x) => 1;\ninterface I {}\n"),
        (2, "src/b.ts", "typescript", None),
        (3, "p.py", "python", "import os\nclass K(object):\n    def m(self):\n        pass\ndef g():\n    pass\n"),
        (4, "m.go", "go", "package m\r\nfunc (s *S) Do() {\r\n}\r\ntype S struct {\r\n}\r\n"),
        (5, "x", None, "class Z"),
    )
    lines = E.lines_of(f)
    assert {(r.file_id, r.kind, r.name) for r in E.symbols(lines).collect()} == {(1, "class", "A"), (1, "arrow", "f"), (1, "interface", "I"), (3, "class", "K"), (3, "method", "m"), (3, "function", "g"), (4, "package", "m"), (4, "method", "Do"), (4, "struct", "S")}
    i = E.imports(lines)
    assert {(r.file_id, r.source) for r in i.collect()} == {(1, "./b.js"), (3, "os")}
    assert [tuple(r) for r in B.resolved_imports(i, f).select("file_id", "target_id").collect()] == [(1, 2)]
    assert [r.id for r in B.external_packages(i).collect()] == ["ext:os"]


def test_routes_tables_services(spark):
    f = files(
        spark,
        (1, "a.ts", "typescript", "app.get('/users', f)\n@Post('login')\n"),
        (2, "a.py", "python", "@app.route('/x')\n"),
        (3, "s.sql", "sql", "CREATE TABLE users (id INT PRIMARY KEY, name TEXT NOT NULL, org_id INT REFERENCES orgs(id));\nCREATE TABLE orders (id INT, FOREIGN KEY (uid) REFERENCES users (id));"),
        (4, "docker-compose.yml", "docker", 'services:\n  web:\n    image: nginx:1\n    ports:\n      - "80:80"\n    depends_on:\n      - db\n  db:\n    image: "pg"\nvolumes:\n  data:\n'),
        (5, "x/Dockerfile", "docker", "FROM a:1 AS b\nFROM c\nEXPOSE 80 443\n"),
    )
    lines = E.lines_of(f)
    assert {(r.method, r.path) for r in E.routes(lines).collect()} == {("GET", "/users"), ("POST", "/login"), ("GET", "/x")}
    assert {(r.table_name, r.column_name, r.is_primary, r.is_nullable) for r in E.table_columns(f).collect()} == {("users", "id", True, True), ("users", "name", False, False), ("users", "org_id", False, True), ("orders", "id", False, True)}
    assert {(r.table_name, r.references_table) for r in E.foreign_keys(f).collect()} == {("users", "orgs"), ("orders", "users")}
    assert {(r.service, r.image, tuple(r.ports), tuple(r.depends_on)) for r in E.compose_services(lines).collect()} == {("web", "nginx:1", ("80:80",), ("db",)), ("db", "pg", (), ())}
    assert [(r.image, r.ports) for r in E.dockerfiles(lines).collect()] == [("a:1", ["443", "80"])]


def test_build_helpers(spark):
    p = spark.createDataFrame([("package.json",), ("a/x.csproj",), ("a/b/go.mod",), ("a/c.ts",)], "file_path string")
    assert {tuple(r) for r in B.projects(p).collect()} == {(".", "npm"), ("a", "dotnet"), ("a/b", "go-module")}
    s = spark.createDataFrame([("s1", "f", "x.f", "a.ts", 1, "function"), ("s2", "f", "y.f", "b.ts", 2, "method"), ("s3", "g", "g", "b.ts", 3, "function")], "id string, name string, qualified_name string, file_path string, seq int, kind string")
    c = spark.createDataFrame([("s3", "b.ts", "f"), ("s3", "b.ts", "obj.f"), ("s3", "b.ts", "g"), ("s1", "a.ts", "y.f")], "caller string, caller_file string, callee string")
    assert {tuple(r) for r in B.call_edges(c, s).collect()} == {("s3", "s2"), ("s3", "s1"), ("s1", "s2")}
    t = spark.createDataFrame([("c1", "f"), ("c2", "y.f")], "id string, base string")
    assert {tuple(r) for r in B.inheritance(t, s).collect()} == {("c1", "s1"), ("c2", "s2")}
    e = spark.createDataFrame([("api:GET:/x", "b.ts")], "id string, file_path string")
    assert [tuple(r) for r in B.endpoint_handlers(e, s).collect()] == [("api:GET:/x", "s2")]


def test_search_ranks(spark):
    n = spark.createDataFrame([("1", "component", "AuthGuard", "auth", "login and session checks"), ("2", "component", "PaymentService", "pay", "refund and charge customers"), ("3", "database-table", "orders", "orders", "table of orders")], "id string, type string, name string, qualified_name string, description string").withColumn("file_path", F.lit(None).cast("string"))
    assert S.hybrid_search(n, "login").first().id == "1" and S.hybrid_search(n, "refund customer charge").first().id == "2" and S.hybrid_search(n, "orders").first().id == "3"
    assert S.hybrid_search(n, "the of").count() == 0


@pytest.mark.parametrize(
    "text, value",
    [
        ('{"name": "t"}', {"name": "t"}),
        ('```json\n{"name": "t"}\n```', {"name": "t"}),
        ('Here it is:\n{"name": "t"} bye', {"name": "t"}),
        ('{"name": "t", "items": [1, 2, 3,],}', {"name": "t", "items": [1, 2, 3]}),
        ('{"name": "t", "items": [1, 2', {"name": "t", "items": [1, 2]}),
        ('{"data": {"users": [{"name": "Alice"', {"data": {"users": [{"name": "Alice"}]}}),
        ("{'a': 'b', c: 1}", {"a": "b", "c": 1}),
        ('{"a": "x\ny"}', {"a": "x\ny"}),
        ("no json", None),
        (None, None),
    ],
)
def test_repair(text, value):
    fixed = repair.repair_json(text)
    assert (json.loads(fixed) if fixed else None) == value


def test_repair_column(spark):
    df = spark.createDataFrame([('{"a":1}',), ("{'a': 2}",), (None,), ("x",)], "t string")
    assert [r[0] for r in df.select(repair.repaired("t")).collect()] == ['{"a":1}', '{"a":2}', None, None]
    assert repair.all_json('{"id": 1} some text {"id": 2}') == ['{"id":1}', '{"id":2}']


def test_store_falls_back(spark, tmp_path):
    nodes, edges = spark.createDataFrame([("a", "file")], "id string, type string"), spark.createDataFrame([("a", "b", "calls")], "source string, target string, type string")
    s = ST.GraphStore(spark, str(tmp_path / "g"))
    with pytest.raises(FileNotFoundError):
        s.load()
    s.save(nodes, edges, 1)
    s.save(nodes, edges, 2)
    assert s.load()[2] == 2 and s.size() > 0
    for p in (tmp_path / "g" / "generation=2" / "nodes").rglob("*.parquet"):
        p.write_bytes(b"broken")
    for p in (tmp_path / "g" / "generation=2" / "nodes").rglob(".*.crc"):
        p.unlink()
    assert s.load()[2] == 1
    s.clear()
    (tmp_path / "old.json").write_text('{"nodes": [{"id": "a", "type": "file"}], "edges": [{"source": "a", "target": "zz"}]}')
    n, e, g = s.load(str(tmp_path / "old.json"))
    assert n.count() == 1 and e.count() == 1 and g is None


def test_scan_and_changes(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.ts").write_text("export class A {}")
    (tmp_path / "src" / "b.bin").write_bytes(b"\x00\xff")
    (tmp_path / "src" / "c.py").write_bytes(b"x = '\xff'")
    f = SF.scan(spark, str(tmp_path))
    rows = {r.file_path: r for r in f.collect()}
    assert set(rows) == {"src/a.ts", "src/c.py"} and rows["src/a.ts"].content == "export class A {}"
    known = spark.createDataFrame([("src/a.ts", rows["src/a.ts"].hash), ("gone.ts", "h")], "file_path string, hash string")
    assert [r.file_path for r in SF.changed(f, known).collect()] == ["src/c.py"] and [r.file_path for r in SF.deleted(f, known).collect()] == ["gone.ts"]


def test_stream_of_changes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    ev = lambda p, k, c, s: json.dumps({"path": p, "kind": k, "content": c, "at": f"2025-01-01T00:00:0{s}Z"})
    (tmp_path / "in" / "1.json").write_text("\n".join([ev("a", "update", "one", 1), ev("a", "update", "two", 2), ev("b", "update", "x", 1)]))
    state = {"files": spark.createDataFrame([("b", "x", None, 0)], "path string, content string, hash string, generation int").withColumn("hash", F.substring(F.sha2("content", 256), 1, 16))}

    def on_batch(df, generation):
        state["files"] = df.sparkSession.createDataFrame(T.apply_batch(state["files"], df, generation).collect(), "path string, content string, hash string, generation int")

    run = lambda: T.follow(T.read_events(spark, str(tmp_path / "in")), on_batch, str(tmp_path / "ck"), once=True).awaitTermination(120)
    run()
    assert {(r.path, r.content, r.generation) for r in state["files"].collect()} == {("a", "two", 1), ("b", "x", 0)}
    (tmp_path / "in" / "2.json").write_text("\n".join([ev("a", "delete", None, 3), ev("zz", "delete", None, 3)]))
    run()
    assert {r.path for r in state["files"].collect()} == {"b"}
    e = spark.createDataFrame([("a", "update", "x", "2025-01-01 00:00:00.1"), ("a", "update", "y", "2025-01-01 00:00:00.2"), ("a", "update", "z", "2025-01-01 00:00:05")], "path string, kind string, content string, t string").withColumn("at", F.to_timestamp("t"))
    assert sorted(r.n for r in T.edit_bursts(e).collect()) == [1, 2]
