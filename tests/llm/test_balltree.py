import random

import numpy as np
from pyspark.sql import functions as F

from claimloom.llm.balltree import BallTree, exact_topk


def brute(rows, k=5):
    ok = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, x in {i: (i, v) for i, v in sorted(ok, reverse=True) if i % 5 == 0}.values():
        s = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in ok if i != q and len(y) == len(x))[:k]
        out |= {(q, r + 1, i, -v) for r, (v, i) in enumerate(s)}
    return out


def test_nodes_cover_their_rows():
    x = np.random.default_rng(0).normal(size=(900, 5))
    t = BallTree(x, 16)
    for lo, hi, c, r in zip(t.lo, t.hi, t.centre, t.radius, strict=True):
        assert np.sqrt(((t.rows[lo:hi] - c) ** 2).sum(1)).max() <= r + 1e-9
    assert sorted(t.order) == list(range(900))


def test_against_brute_force(spark):
    r = random.Random(6)
    rows = [(i, [r.choice([0.0, 0.25, -0.5, r.random()]) for _ in range(4)]) for i in range(230)]
    rows += [(300 + i, [0.25] * 4) for i in range(70)]  # ties
    rows += [(5, None), (400, [1.0, None, 0.0, 0.0]), (405, [float("nan")] * 4), (410, [float("inf")] * 4), (None, [1.0] * 4), (415, [1.0, 2.0]), (416, [3.0, 2.0]), (420, []), (10, [9.0] * 4)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int")
    for shard, block, most in ((2048, 2048, 8), (16, 7, 3), (10, 1000, 100), (50, 11, 1)):
        got = exact_topk(df, F.col("vec_id") % 5 == 0, shard_rows=shard, query_rows=block, group_shards=most)
        assert {tuple(x) for x in got.collect()} == brute(rows)
    assert exact_topk(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0
