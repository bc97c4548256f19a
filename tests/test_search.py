"""Vectors of all node texts against brute force in Python."""

import math
import re
from collections import Counter

import pytest

import __spark_entry__ as entry
from codeloom.functions import rules
from codeloom.plans.report_queries import QUERY

NODES = [  # id, type, name, qualified_name, description, file_path
    ("s:1", "symbol", "payInvoice", "ledger.payInvoice", "books a payment", "r/ledger.ts"),
    ("f:1", "file", "ledger.ts", None, None, "r/src/ledger.ts"),
    ("n:1", None, "invoiceController", None, None, None),
    ("m:1", "module", "billing", "r.billing", "controller of invoices", "r/billing"),
    ("c:1", "component", "Clock", None, "tells the time", None),
    ("t:1", "database-table", "ledger_payment", None, None, None),
    ("e:1", None, None, None, None, None),
]
PACKAGES = [("ext:payment-lib", "payment-lib")]


def fnv(text, seed=0):
    h = 2166136261 ^ seed
    for b in text.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h


def terms(text):
    t = re.sub(r"[._\-/:\\$#@()\[\]{}<>,\"'`=;]", " ", text)
    t = re.sub(r"([A-Z]+)([A-Z][a-z\d]+)", r"\1 \2", re.sub(r"([a-z\d])([A-Z])", r"\1 \2", t))
    out = [re.sub("[^a-z0-9]", "", w) for w in t.lower().split()]
    return [w for w in out if len(w) >= 2 and w not in rules.STOP_WORDS]


def vector(text):
    v = Counter()
    for t in terms(text):
        v[fnv(t) % 256] += 1.5 if fnv(t, 1) % 2 == 0 else -1.5
        for k in range(len(t) - 2):
            g = t[k : k + 3]
            v[fnv(g, 42) % 256] += 0.5 if fnv(g, 99) % 2 == 0 else -0.5
    norm = math.sqrt(sum(w * w for w in v.values()))
    return {d: w / norm for d, w in v.items() if w}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("nodes"))
    life = (1, 1, None, None)
    spark.createDataFrame([(*n, None, *life) for n in NODES], "id string, type string, name string, qualified_name string, description string, file_path string, language string, generation_created int, generation_updated int, generation_removed int, loaded_at timestamp").write.parquet(d + "/graph_nodes.parquet")
    spark.createDataFrame([(*p, None, None, 1, None) for p in PACKAGES], "id string, name string, version string, registry string, generation_created int, generation_removed int").write.parquet(d + "/package_nodes.parquet")
    return d


@pytest.fixture(scope="module")
def want():
    texts = {n[0]: " ".join(x for x in (n[2], n[3], n[4], n[1], n[5]) if x) for n in NODES}
    texts |= {i: f"{name} {name} external-dependency" for i, name in PACKAGES}
    return {i: vector(t) for i, t in texts.items()}


def test_vectors_of_all_nodes(spark, folder, want):
    got = {(r.id, r.dim): r.w for r in entry.queries()["embedding_all"](spark, folder).collect()}
    assert got == pytest.approx({(i, d): w for i, v in want.items() for d, w in v.items()}, abs=1e-6)
    assert {i for i, _ in got} == set(want) - {"e:1"}


def test_cosines_of_all_nodes(spark, folder, want):
    q = vector(QUERY)
    sims = {i: sum(w * q.get(d, 0) for d, w in v.items()) for i, v in want.items()}
    got = {r.id: r.sim for r in entry.queries()["dense_all"](spark, folder).collect()}
    assert got == pytest.approx({i: s for i, s in sims.items() if s > 0.05}, abs=1e-6)
    assert {"s:1", "n:1"} <= set(got)
