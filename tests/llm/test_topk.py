import math
import random

from pyspark.sql import functions as F

from lectern.llm import topk


def brute(rows, asks, k):
    def whole(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(1024 * x) for x in v]

    valid = [(i, w) for i, v in rows if i is not None and (w := whole(v)) is not None]
    out = []
    for q, v in dict(x for x in valid if asks(x[0])).items():
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in valid if i != q and len(w) == len(v))
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def run(spark, rows, k=10):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, id string, shard int")
    found = topk.top_k(df, F.col("vec_id") % 10 == 0, k)
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect())


def test_against_brute_force_over_many_shards(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.5, rng.gauss(0, 0.3)]) for _ in range(8)]) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(40)]  # ties
    rows += [(2000, None), (2010, []), (2020, [None] * 8), (2030, [float("nan")] * 8), (2040, [float("inf")] * 8), (None, rows[0][1])]
    rows += [(3000 + i, [0.1, 0.2]) for i in range(15)]  # another length
    monkeypatch.setattr(topk, "SHARD", 60)
    monkeypatch.setattr(topk, "LEAF", 8)
    plain = [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows]
    import numpy as np

    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in plain]
    assert run(spark, plain) == brute(exact, lambda i: i % 10 == 0, 10)


def test_few_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, [(0, [1.0]), (3, [-0.5]), (1, [2.0])]) == [(0, 1, 1, 2048 * 1024), (0, 2, 3, -512 * 1024)]


def test_large_components_and_empty_vectors_take_part(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 4)
    rows = [(0, [2_000_000.0, 0.5]), (10, [3e18, -1.0]), (20, []), (30, [1e300, -1e300]), (31, [1.7e308, 1.0]), (32, [-1e200, 2.0])]
    rows += [(i, [float(i), -1.5 * i]) for i in range(40, 60)] + [(61, []), (62, []), (63, [5e18, 7.0]), (64, [5e18, 7.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = topk.top_k(df, F.col("vec_id") % 10 == 0, 5)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect())
    clip = lambda s: max(min(s, (1 << 63) - 1), 1 - (1 << 63))
    assert got == [(q, rank, i, clip(s)) for q, rank, i, s in brute([(i, [int(x) if abs(x) > 1e15 else x for x in v]) for i, v in rows], lambda i: i % 10 == 0, 5)]


def test_groups_of_near_vectors_in_many_cells(spark, monkeypatch):
    rng = random.Random(8)
    middles = [[rng.choice([-4.0, 4.0]) for _ in range(6)] for _ in range(9)]
    rows = [(i, [x + rng.choice([0, 0.25, -0.5]) for x in middles[i % 9]]) for i in range(400)]
    monkeypatch.setattr(topk, "SHARD", 30)
    monkeypatch.setattr(topk, "LEAF", 4)
    assert run(spark, rows) == brute(rows, lambda i: i % 10 == 0, 10)


def test_a_query_opens_few_nodes_where_vectors_lie_in_groups(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(4)
    middles = rng.normal(0, 400, (40, 8))
    x = np.floor(middles[rng.integers(0, 40, 20_000)] + rng.normal(0, 4, (20_000, 8)))
    tree = topk.BallTree(np.arange(20_000), x)
    opened = []
    scores = topk.scores
    monkeypatch.setattr(topk, "scores", lambda q, x: opened.append(len(x)) or scores(q, x))
    best = tree.search(7, x[7], tree.bounds(x[7:8])[0], None, 10)
    exact = sorted((-int(s), i) for i, s in enumerate((x @ x[7]).astype(int)) if i != 7)[:10]
    assert best == [(-s, i) for s, i in exact] and sum(opened) < len(x) / 10
