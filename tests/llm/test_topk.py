import numpy as np
from pyspark.sql import functions as F

from volspark.llm import topk


def brute(rows, k=10, mod=lambda q: q % 5 == 0):
    good = [(i, np.floor(np.asarray(v, np.float32).astype(float) * 1024)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, x in good:
        if mod(q):
            found = sorted((-int(x @ y), c) for c, y in good if c != q and len(y) == len(x))[:k]
            out |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(found)}
    return out


def _run(spark, rows, **more):
    d = spark.createDataFrame([(i, v, 1, "c") for i, v in rows], "vec_id long, embedding array<float>, id int, v string")
    return {tuple(r) for r in topk.top_k(d, F.col("vec_id") % 5 == 0, **more).collect()}


def test_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).round(1).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, [0.5] * 6) for i in range(30)]  # ties
    rows += [(2000, None), (2005, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2010, [float("nan")] * 6), (2015, [float("inf")] * 6), (None, [1.0] * 6), (2020, [1.0, 2.0]), (2021, [0.5, 0.5])]
    want = brute(rows)
    for more in ({}, {"shard_rows": 40, "block_rows": 7}):
        assert _run(spark, rows, **more) == want


def test_large_values_are_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.uniform(-1e5, 1e5, 64)).astype(np.float32).tolist()) for i in range(60)]
    exact = [(i, [int(np.floor(float(np.float32(c)) * 1024)) for c in v]) for i, v in rows]
    want = set()
    for q, x in exact:
        if q % 5 == 0:
            found = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), c) for c, y in exact if c != q)[:10]
            want |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(found)}
    assert max(abs(r[3]) for r in want) > 1 << 53
    assert _run(spark, rows) == want == _run(spark, rows, shard_rows=10, block_rows=3)
    huge = _run(spark, [(0, [3e30, 1.0]), (1, [3e30, 0.0]), (2, [-3e30, 0.0])])
    assert huge == {(0, 1, 1, (1 << 63) - 1), (0, 2, 2, -(1 << 63))}


def test_copies_fill_no_shard_and_ids_of_any_type(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [1.0, 2.0, 0.5]) for i in range(200)] + [(i, rng.normal(size=3).astype(np.float32).tolist()) for i in range(200, 400)]
    assert _run(spark, rows, shard_rows=30, block_rows=5) == brute(rows)
    d = spark.createDataFrame([(f"v{i:04}", v) for i, v in rows[190:240]], "vec_id string, embedding array<float>")
    got = topk.top_k(d, F.col("vec_id").endswith("5"), shard_rows=20).collect()
    assert {(int(r["query_id"][1:]), r["rank"], int(r["vec_id"][1:]), r["score"]) for r in got} == brute(rows[190:240], mod=lambda q: q % 10 == 5)


def test_few_rows(spark):
    assert _run(spark, [(0, [1.0]), (1, [2.0])]) == {(0, 1, 1, 1024 * 2048)}
    assert _run(spark, [(0, [1.0])]) == set()
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 5 == 0).count() == 0


def test_tree_holds_all_points():
    x = np.floor(np.random.default_rng(2).normal(size=(500, 8)) * 1024)
    t = topk.BallTree(x, leaf=16)
    assert sorted(t.order.tolist()) == list(range(500))
    for n in range(len(t.lo)):
        own = t.points[t.lo[n] : t.hi[n]]
        assert np.sqrt(((own - t.centres[n]) ** 2).sum(axis=1)).max() <= t.radii[n] * (1 + 1e-9) + 1e-6
