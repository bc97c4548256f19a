"""Descendants read off the positions of the hierarchy, against walks up the parents."""

import random

from codeloom.operators import hierarchy as H

SCHEMA = "edge_id string, source string, target string, type string, confidence double, generation_verified int"


def test_all_descendants_are_read_off(spark):
    rng = random.Random(2)
    parent = {f"n{k}": f"n{rng.randrange(max(0, k - 9), k)}" for k in range(1, 60) if k not in (20, 40)}
    loop = {"a": "b", "b": "a", "under": "a", "self": "self"}
    edges = [(f"e{c}", p, c, "contains", 1.0, 1) for c, p in (parent | loop).items()]
    got = H.descendants(spark.createDataFrame(edges, SCHEMA)).collect()
    ids = set(parent) | set(parent.values())
    assert sorted(r.id for r in got) == sorted(ids)

    def above(x):
        out = []
        while x in parent:
            x = parent[x]
            out.append(x)
        return out

    want = {(a, x) for x in ids for a in above(x)}
    assert {(x.id, y.id) for x in got for y in got if x.root_id == y.root_id and x.leave <= y.leave and y.entry < x.entry} == want
    assert {r.id: r.depth for r in got} == {x: len(above(x)) for x in ids}
    assert {r.id: r.entry - r.leave - 1 for r in got} == {x: sum(a == x for a, _ in want) for x in ids}
