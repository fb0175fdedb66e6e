"""What a volume of any size must not do: meet in one task, be planned by sizes that are not its own, or keep what no one reads."""

import contextlib
import io
import os

import numpy as np
from pyspark.sql import functions as F

from volspark import session
from volspark.operators import blocks, cluster, lesion, levels, regions
from volspark.plans import image_queries, sweeps
from volspark.schema import KEYS
from volspark.sources.grids import extents


def _volume(spark, shape, seed=3):
    rng = np.random.default_rng(seed)
    v = rng.random(shape)
    at = np.indices(shape).reshape(3, -1)
    rows = [("a", int(z), int(y), int(x), float(v[z, y, x])) for z, y, x in at.T]
    return spark.createDataFrame(rows, "vol_id string, z int, y int, x int, v double")


def _plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_voxels_are_not_shuffled_by_volume(spark):
    vox = session.cut(_volume(spark, (6, 4, 5)))
    for df in (blocks.with_blocks(vox, (1, 1, 1), 4), regions.floored(vox, 0.2), blocks.voxels_of(blocks.over_chunks(blocks.chunked(vox, 4), lambda p: p[1:-1, 1:-1, 1:-1], (1, 1, 1)))):
        plan = _plan(df)
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_a_cut_table_has_the_size_of_its_rows_and_is_discarded(spark):
    rows = session.cut(spark.range(100_000).select(F.lit("a volume").alias("vol_id"), F.col("id")))
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    assert 100_000 * 16 <= size <= 100_000 * 40
    path = rows.shared_path.removeprefix("file:")
    assert os.path.exists(path)
    session.discard(rows)
    assert not os.path.exists(path)


def test_places_go_to_blocks_in_few_rows(spark):
    mask = _volume(spark, (9, 10, 11)).where("v > 0.4").select(*KEYS)
    got = blocks.packed(mask.coalesce(1), (1, 2, 0), 4)
    assert got.count() == got.select("b_z", "b_y", "b_x").distinct().count()
    there = {tuple(r)[1:] for r in mask.collect()}
    for r in got.collect():
        place = np.unravel_index(np.frombuffer(r["at"], np.int32), (6, 8, 4))
        found = {tuple(int(p + c * 4 - h) for p, c, h in zip(q, (r["b_z"], r["b_y"], r["b_x"]), (1, 2, 0), strict=True)) for q in zip(*place, strict=True)}
        assert found == {p for p in there if all(c * 4 - h <= a < c * 4 + 4 + h for a, c, h in zip(p, (r["b_z"], r["b_y"], r["b_x"]), (1, 2, 0), strict=True))}


def test_morphology_below_zero(spark):
    """Coordinates under 0 and blocks that begin before the volume."""
    mask = _volume(spark, (7, 6, 5)).where("v > 0.5").select("vol_id", (F.col("z") - 3).alias("z"), (F.col("y") - 33).alias("y"), "x")
    bounds = extents(mask)
    there, lo, hi = {tuple(r)[1:] for r in mask.collect()}, *[[bounds.first()[f"{n}_{a}"] for a in "zyx"] for n in ("lo", "hi")]
    want = {tuple(a + d for a, d in zip(p, o, strict=True)) for p in there for o in regions.ball(2)}
    want = {p for p in want if all(a <= b <= c for a, b, c in zip(lo, p, hi, strict=True))}
    assert {tuple(r)[1:] for r in regions.dilate(mask, regions.ball(2), bounds).collect()} == want


def test_sweep_counts_basins_and_not_voxels(spark):
    """The sweep of levels by basin equals that by voxel, and no level multiplies the voxels."""
    vox = _volume(spark, (6, 7, 8))
    got = {(r["level"]): (r["basins"], r["n"]) for r in sweeps.watershed_sweep(vox, [0.5], [0.05], [0.05, 0.3]).collect()}
    from volspark.operators import stencil

    w = regions.merge_levels(regions.basins(regions.floored(stencil.gaussian_gradient(vox, 0.5), 0.05)), [0.05, 0.3])
    want = {r["level"]: (r["basins"], r["n"]) for r in w.groupBy("level").agg(F.countDistinct("label").alias("basins"), F.count("*").alias("n")).collect()}
    assert got == want and all(n == 336 for _, n in got.values())


def _basins_left(a, limits):
    """Basins of an array and, for each limit of saliency, those that are left, a voxel and a pass at a time; NaN is no voxel."""
    near = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
    there = {p: a[p] for p in np.ndindex(*a.shape) if not np.isnan(a[p])}
    beside = {p: [q for d in near if (q := tuple(i + k for i, k in zip(p, d, strict=True))) in there] for p in there}
    label = {}
    for p in sorted(there, key=lambda p: (there[p], p)):
        to = min([p, *beside[p]], key=lambda q: (there[q], q))
        label[p] = p if to == p else label[to]
    passes = sorted((max(there[p], there[q]), label[p], label[q]) for p in there for q in beside[p] if label[p] < label[q])
    root = {p: p for p in label.values()}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    ended = []
    for h, p, q in passes:
        p, q = find(p), find(q)
        if p != q:
            p, q = (p, q) if (there[p], p) > (there[q], q) else (q, p)
            ended.append(h - there[p])
            root[p] = q
    return [len(set(label.values())) - sum(e <= x for e in ended) for x in limits]


def test_levels_of_blocks_are_those_of_the_volume(spark):
    """Random heights, heights of many ties, plateaus and holes, on blocks of a few voxels that begin below zero: as a pass at a time."""
    rng = np.random.default_rng(12)
    holes = np.where(rng.random((8, 7, 6)) < 0.1, np.nan, rng.random((8, 7, 6)))
    pits = np.full((9, 9, 9), 5.0)  # a high plateau whose region is at all faces, and ever deeper pits
    for i, p in enumerate([(1, 1, 1), (4, 4, 4), (7, 1, 7), (2, 7, 5), (7, 7, 2)]):
        pits[p] = 4.0 - i
    made = {"random": rng.random((11, 6, 7)), "ties": rng.integers(0, 4, (9, 8, 5)).astype(float), "line": rng.random((40, 1, 2)), "holes": holes, "pits": pits, "flat": np.ones((5, 4, 6)), "one": np.zeros((1, 1, 1))}
    rows = [(k, z - 3, y + 2, x - 7, float(v)) for k, a in made.items() for (z, y, x), v in np.ndenumerate(a) if not np.isnan(v)]
    vox = spark.createDataFrame(rows, "vol_id string, z int, y int, x int, v double")
    thresholds, shares = [0.0, 0.3], [0.05, 0.2, 0.6]
    want = {}
    for name, a in made.items():
        for k, t in enumerate(thresholds):
            low = np.nanmin(a) + t * (np.nanmax(a) - np.nanmin(a))
            left = _basins_left(np.maximum(a, low), [(np.nanmax(a) - low) * x for x in shares])
            want |= {(name, k, x): (b, int((~np.isnan(a)).sum())) for x, b in zip(shares, left, strict=True)}
    for block in (2, 3, 64):
        got = {(r["vol_id"], r["run"], r["level"]): (r["basins"], r["n"]) for r in levels.basin_counts(blocks.chunked(vox, block), thresholds, shares).collect()}
        assert got == want


def test_sweep_of_watersheds_takes_few_jobs(spark):
    """Jobs neither follow pointers nor merge regions round by round."""
    vox = _volume(spark, (70, 5, 6))
    jobs = lambda: spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
    before = jobs()
    assert len(sweeps.watershed_sweep(vox, [0.5], [0.05, 0.1], [0.05, 0.3]).collect()) == 4
    assert jobs() - before < 25


def test_task_of_boxes_holds_faces_only(spark):
    """What a block hands on does not grow with its inside."""
    a = np.random.default_rng(2).random((64, 12, 12))
    vox = spark.createDataFrame([("a", *map(int, p), float(v)) for p, v in np.ndenumerate(a)], "vol_id string, z int, y int, x int, v double")
    basins = levels.basin_counts(blocks.chunked(vox, 32), [0.0], [0.1]).first()["basins"]
    c = blocks.chunked(vox, 32)
    rows = blocks.sent_chunks(c, (1, 1, 1)).join(F.broadcast(blocks.chunk_ranges(c)), "vol_id").groupBy("vol_id", "b_z", "b_y", "b_x")
    left = rows.applyInArrow(levels._in_block(32, [0, 0, 0], [0.0], [0.1]), levels._LEFT).collect()
    assert len(left) == 2 and basins > 500
    assert all(len(r["node"]) // 8 <= 3 * 144 and len(r["place"]) // 8 == 144 for r in left)


def _many_values(spark, n=10_000):
    v = np.random.default_rng(8).exponential(1.0, n) - 0.2
    return v, spark.createDataFrame([("a", 0, 0, i, float(x)) for i, x in enumerate(v)], "vol_id string, z int, y int, x int, v double")


def test_rounds_of_large_volumes_are_no_jobs(spark):
    """Values that no task may hold take far fewer jobs than rounds, and give the same clusters."""
    v, vox = _many_values(spark)
    rounds, whole = 0, cluster.Values(v, np.ones(len(v)))
    seeds = np.linspace(v[v > 0].min(), v.max(), 16)
    while not np.array_equal(whole.lloyd(seeds, rounds), whole.lloyd(seeds, None)):
        rounds += 1
    assert rounds > 60
    jobs = lambda: spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
    before = jobs()
    got = {r["vol_id"]: r["means"] for r in cluster.kmeans(vox, cluster.uniform_seeds(vox, 16), bound=10).collect()}
    assert jobs() - before < rounds
    want = {r["vol_id"]: r["means"] for r in cluster.kmeans(vox, cluster.uniform_seeds(vox, 16)).collect()}
    assert sorted(got) == sorted(want) and all(np.allclose(got[k], want[k], rtol=1e-9) for k in want)


def test_runs_are_fetched_again_when_few_are_held(monkeypatch):
    """The same clusters, scores and percentiles where the driver may hold a few runs only."""
    v = np.unique(np.concatenate([np.random.default_rng(5).normal(size=900), [0.0, 60.0]]))
    n = np.arange(len(v)) % 3 + 1
    parts = np.array_split(np.arange(len(v)), len(v) // 16)
    centre = float(v @ n / n.sum())
    d = v - centre
    rows = np.array([[v[p[0]], v[p[-1]], n[p].sum(), (n * d)[p].sum(), (n * d * d)[p].sum()] for p in parts]).T
    asked = []

    def fetch(lows):
        asked.append(len(lows))
        return {v[p[0]]: (v[p], n[p]) for p in parts if v[p[0]] in lows}

    monkeypatch.setattr(cluster, "HELD_VALUES", 160)
    whole, runs = cluster.Values(v, n), cluster.Runs(rows, centre, 17, fetch)
    ps = np.array([0.0, 0.02, 0.5, 0.977, 1.0])
    assert np.allclose(runs.above(0.0).quantiles(ps), whole.above(0.0).quantiles(ps)) and np.allclose(runs.above(0.0).ends(), whole.above(0.0).ends())
    for k in (1, 2, 7, 12):
        means = whole.lloyd(np.linspace(-3, 60, k), None)
        assert np.allclose(runs.lloyd(np.linspace(-3, 60, k), None), means)
        assert np.allclose(runs.lloyd(np.linspace(-3, 60, k), 3), whole.lloyd(np.linspace(-3, 60, k), 3))
        got, want = runs.above(0.0).scores(means)[0], whole.above(0.0).scores(means)[0]
        assert got == want if want is None else abs(got / want - 1) < 1e-9
    assert max(asked) <= 12


def test_clusters_are_measured_once_for_all_rules(spark, monkeypatch):
    made = []
    gradient = lesion.gradient_magnitude
    monkeypatch.setattr(lesion, "gradient_magnitude", lambda vox: made.append(1) or gradient(vox))
    assert len(image_queries.pick_clusters(spark, "/root/testdata/sf0.001").collect()) == 4
    assert len(made) == 1
