"""Shared pieces: places in an order, nearest vectors, written tables."""

import os
import random

from pyspark.sql import functions as F

from codeloom import runtime
from codeloom.operators import search as S


def test_ranked(spark):
    rows = [(i, random.Random(i).randrange(50)) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, x int").repartition(7)
    for one_task in (0, runtime.BROADCAST_ROWS):  # by ranges, and at once
        out = runtime.ranked(df, "place", F.desc("x"), F.col("id"), one_task=one_task).collect()
        want = {i: k for k, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
        assert {r.id: r.place for r in out} == want
    assert runtime.ranked(df.limit(0), "place", F.col("id")).count() == 0


def test_nearest_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "QUERY_BLOCK", 3)
    r = random.Random(2)
    vs = [(i, [r.random() - 0.5 for _ in range(8)]) for i in range(60)] + [(90, [0.0] * 8), (91, None)]
    df = spark.createDataFrame(vs, "vec_id long, embedding array<float>")
    out = {}
    for x in S.nearest(df, df.filter("vec_id % 10 = 0"), 3).collect():
        out.setdefault(x.query_id, []).append((x["rank"], x.vec_id))

    def cos(a, b):
        n = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return sum(x * y for x, y in zip(a, b)) / n if n else 0.0

    good = {i: v for i, v in vs if v}
    for q, got in out.items():
        want = sorted((i for i in good if i != q), key=lambda i: (-round(cos(good[q], good[i]), 5), i))[:3]
        assert [v for _, v in sorted(got)] == want
    assert set(out) == {0, 10, 20, 30, 40, 50, 90}
    assert S.nearest(df, df.limit(0), 3).count() == 0


def test_cut_and_release(spark):
    t = runtime.cut(spark.range(10))
    path = t._codeloom_path.removeprefix("file://")
    assert t.count() == 10 and os.path.isdir(path)
    runtime.release(t)
    assert not os.path.exists(path)
    u = runtime.cut(spark.range(3))
    assert "Broadcast" in runtime.small(u).join(spark.range(5), "id")._jdf.queryExecution().toString()
