"""Every query against its SQL in DuckDB on the smallest tables, where they are at hand."""

import glob
import os
from collections import Counter

import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


#: Queries without SQL, and where their operators are checked instead.
CHECKED_ELSEWHERE = {
    "p6_descendants": "test_descendants",
    "dense_all": "test_search", "embedding_all": "test_search", "context_seeds": "test_search",
    "built_graph": "fixture_graph", "routes": "fixture_routes", "project_directories": "fixture_projects", "import_resolution": "fixture_import_resolution", "feature_gaps": "fixture_gaps",
} | {n: "tests/llm" for n in ("p3_found", "p3_kinds", "p4_found", "p4_rates", "p5_found", "p5_redacted_files", "p5_redacted_services", "p7_ids", "p8_found", "p8_report", "p9_pieces")}


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(DATA + "/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def norm(v):
    if isinstance(v, float):
        return round(v, 5)
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    rows, columns = df.collect(), sorted(df.columns)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert name in CHECKED_ELSEWHERE, "no SQL and no other check"
        return
    out = duck.execute(sql)
    names = [d[0] for d in out.description]
    assert sorted(names) == columns
    want = Counter(tuple(norm(r[names.index(c)]) for c in columns) for r in out.fetchall())
    assert Counter(tuple(norm(r[c]) for c in columns) for r in rows) == want


def test_entry(spark):
    assert entry.entry(spark).columns == ["edge_id", "endpoint", "reason"]
