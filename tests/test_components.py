"""Strongly connected components on random graphs, against reachability."""

import random

import pytest

from codeloom.operators import graph as G


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    r = random.Random(seed)
    names = [f"n{i:02d}" for i in range(30)]
    pairs = {(r.choice(names), r.choice(names)) for _ in range(38)} | {(f"c{i:02d}", f"c{(i + 1) % 17:02d}") for i in range(17)}
    df = spark.createDataFrame([(a, b, "calls") for a, b in pairs], "source string, target string, type string")
    reach = {a: {a} for a in {x for p in pairs for x in p}}
    while True:
        before = sum(map(len, reach.values()))
        for a, b in pairs:
            reach[a] |= reach[b]
        if sum(map(len, reach.values())) == before:
            break
    want = set()
    for a in reach:
        same = {b for b in reach[a] if a in reach[b]}
        if len(same) > 1:
            want.add((a, min(same), len(same)))
    for one_task in (0, G.ONE_TASK_EDGES):  # all rounds, and the rest in one task
        assert {(x.id, x.component, x["size"]) for x in G.strongly_connected(df, ["calls"], one_task).collect()} == want
