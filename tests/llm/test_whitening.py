import math
from fractions import Fraction

import numpy as np

from volspark.llm import exact, whitening

OFFSET = 1_000_000
LONG = (1 << 63) - 1


def brute(rows, components=16, scale=64):
    """rows: (id, vector) of one length. For each row: id, x, deviation, whitened; and explained, n."""
    kept = [(i, [min(math.floor(scale * float(np.float32(c))) + OFFSET, LONG) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    points = sorted({tuple(x) for _, x in kept})
    n, d = len(points), len(points[0])
    s = [sum(p[j] for p in points) for j in range(d)]
    v = np.array([[float(Fraction(n * sum(p[i] * p[j] for p in points) - s[i] * s[j], n * n)) for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(v)
    order = np.argsort(-e)[:components]
    centred = np.array([[float(Fraction(n * c - s[j], n)) for j, c in enumerate(x)] for _, x in kept])
    deviation = [min(LONG, sum((n * c - s[j]) ** 2 for j, c in enumerate(x))) for _, x in kept]
    return [i for i, _ in kept], deviation, centred @ u[:, order] / np.sqrt(e[order]), e[order] / np.trace(v), n


def same(found, rows, components=16):
    ids, deviation, z, explained, n = brute(rows, components)
    k = len(explained)
    assert len(found) == len(ids) * k
    got = {}
    for r in found:
        got.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r["whitened"])
        assert r["n"] == n and r["identity_error"] < 1e-4
        assert abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9
    assert set(got) == set(zip(ids, deviation, strict=True))
    for c in range(1, k + 1):
        mine = np.array([got[key][c][0] for key in zip(ids, deviation, strict=True)])
        sign = np.sign(mine @ z[:, c - 1])
        assert np.abs(mine - sign * z[:, c - 1]).max() < 1e-7


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "c", 2) for i, v in rows], "vec_id long, embedding array<float>, n int, x string, component int")


def test_equals_exact_arithmetic(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=6) * [9, 5, 3, 2, 1, 0.5] + 100).tolist()) for i in range(150)]
    rows += [(200, rows[0][1]), (200, rows[1][1]), (None, rows[2][1]), (300, None), (301, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (302, [float("nan")] * 6), (303, [float("-inf")] * 6)]
    same(whitening.whiten(_frame(spark, rows).repartition(3)).collect(), rows)
    same(whitening.whiten(_frame(spark, rows), components=2).collect(), rows, 2)


def test_hot_copies_count_once(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(300)] + [(i, rng.normal(size=3).tolist()) for i in range(300, 340)]
    same(whitening.whiten(_frame(spark, rows).repartition(4)).collect(), rows)


def test_large_numbers_are_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=3) * 1e15).tolist()) for i in range(40)]
    same(whitening.whiten(_frame(spark, rows).repartition(3)).collect(), rows)
    ids = {r["vec_id"]: r["deviation"] for r in whitening.whiten(_frame(spark, [(1, [3e30, 1.0]), (2, [-5.0, 2.0]), (3, [7.0, 9.0])])).collect()}
    assert ids == {1: LONG, 2: LONG, 3: LONG}


def test_few_rows_and_lengths(spark):
    assert whitening.whiten(_frame(spark, [])).collect() == []
    assert whitening.whiten(_frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []  # no variance
    assert whitening.whiten(_frame(spark, [(1, []), (2, None)])).collect() == []
    found = whitening.whiten(_frame(spark, [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [1.0]), (4, [3.0, 6.0])])).collect()
    assert {(r["vec_id"], r["component"], r["n"]) for r in found} == {(1, 1, 3), (2, 1, 3), (4, 1, 3)}  # one direction


def test_scatter_and_limbs_of_any_size():
    rng = np.random.default_rng(9)
    for scale in (10, 1 << 21, 1 << 45):
        y = rng.integers(-scale, scale, (300, 3))
        s = whitening.Scatter(3)
        s.blocks = 126
        for a in range(0, 300, 100):
            s.add(y[a : a + 100])
        rows = [exact.total(exact.opened(b.column("sums")[0].as_py(), b.column("limbs")[0].as_py())) for b in s.rows()]
        big = y.astype(object)
        assert rows[0] == [300, *big.sum(axis=0)]
        assert rows[1:] == [(big.T @ big)[i, i:].tolist() for i in range(3)]
    values = [0, -1, 1 << 32, -(1 << 32), (1 << 200) + 5, -(1 << 190) - 7]
    assert exact.total(exact.limbs(np.array(values, object))) == values


def test_sums_add_up(spark):
    values = [[1 << 70, -3], [-(1 << 90), 4], [5, -(1 << 40)]]

    def some(batches):
        for b in batches:
            for i in b.column(0).to_pylist():
                yield exact.rows_of({"k": [i % 2]}, [np.array(values[i % 3], object)])

    got = {r["k"]: exact.total(exact.opened(r["sums"], r["limbs"])) for r in exact.exact_sums(spark.range(0, 30, 1, 5).mapInArrow(some, exact.schema_of(["k"])), ["k"]).collect()}
    assert got == {k: [sum(values[i % 3][j] for i in range(k, 30, 2)) for j in range(2)] for k in range(2)}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    same(whitening.op12_whitening(spark, sf).collect(), rows)
