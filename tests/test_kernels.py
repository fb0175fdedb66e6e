"""Kernels against brute force, and what must hold whatever the data."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from volspark.functions import stats
from volspark.operators import cluster, denoise, fronts, lesion, regions, stencil, threshold
from volspark.operators.blocks import over_blocks, windows
from volspark.plans import sweeps
from volspark.schema import KEYS, VOXELS
from volspark.sources.grids import extents


def volume(spark, a, name="a"):
    z, y, x = np.indices(a.shape)
    return spark.createDataFrame([(name, *map(int, t[:3]), float(t[3])) for t in zip(z.ravel(), y.ravel(), x.ravel(), a.ravel(), strict=True)], VOXELS)


def array(df, shape, value="v"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["z"], r["y"], r["x"]] = np.nan if r[value] is None else r[value]
    return out


RNG = np.random.default_rng(3)
A = RNG.integers(0, 256, (6, 9, 7)).astype(float)
MODES = {"replicate": "edge", "reflect": "reflect", "symmetric": "symmetric"}


@pytest.mark.parametrize("boundary", MODES)
@pytest.mark.parametrize("block", [3, 100])
def test_blocks_pad_like_numpy(spark, boundary, block):
    got = array(over_blocks(volume(spark, A), lambda p: windows(p, (2, 1, 2)).mean(axis=-1), (2, 1, 2), boundary, block), A.shape)
    want = windows(np.pad(A, ((2, 2), (1, 1), (2, 2)), mode=MODES[boundary]), (2, 1, 2)).mean(axis=-1)
    assert np.allclose(got, want, atol=1e-9)


def test_constant_volume_is_a_fixed_point(spark):
    v = volume(spark, np.full((4, 4, 4), 7.0))
    for out in (stencil.mean_filter(v, 1), stencil.median_without_centre(v), denoise.adaptive_median(v, 5), denoise.adaptive_wiener(v, 3), stencil.curvature_diffusion(v, 3)):
        assert np.allclose(array(out, (4, 4, 4)), 7.0)
    assert np.allclose(array(stencil.gradient_magnitude(v), (4, 4, 4)), 0)


def test_equalisation_identity_and_single_plane(spark):
    v = volume(spark, A)
    assert np.allclose(array(stencil.adaptive_equalisation(v, 1.0, 1.0, 1), A.shape), A)
    flat = A[:1]
    got = array(stencil.median_without_centre(volume(spark, flat)), flat.shape)
    assert got.shape == flat.shape and not np.isnan(got).any()


def test_two_volumes_do_not_mix(spark):
    both = volume(spark, A, "a").unionByName(volume(spark, A * 2, "b"))
    got = stencil.mean_filter(both, 1)
    assert np.allclose(array(got.where("vol_id = 'b'"), A.shape), 2 * array(got.where("vol_id = 'a'"), A.shape))


def test_ramp_gradients(spark):
    ramp = np.broadcast_to(np.arange(12.0) * 3, (5, 5, 12)).copy()
    g = array(stencil.gaussian_gradient(volume(spark, ramp), 0.5), ramp.shape)
    assert np.allclose(g[:, :, 3:-3], 3.0)


def test_noise_is_the_same_everywhere(spark):
    v = volume(spark, A)
    n = int(A.size * 0.2)
    for parts in (1, 5):
        s = array(denoise.salt_and_pepper(v.repartition(parts), 0.2, -1, 300), A.shape)
        assert (s == 300).sum() == n // 2 and (s == -1).sum() == n - n // 2
    a, b = (array(denoise.gaussian_noise(v.repartition(p), 5.0), A.shape) for p in (1, 4))
    assert np.array_equal(a, b)


def test_gaussian_noise_is_gaussian(spark):
    shape = (40, 50, 1200)  # an axis of more than 1,024 places, too
    at = spark.range(int(np.prod(shape))).selectExpr("'a' as vol_id", "cast(id div 60000 as int) as z", "cast(id div 1200 % 50 as int) as y", "cast(id % 1200 as int) as x", "0.0D as v")
    rows = denoise.gaussian_noise(at, 3.0).toPandas()
    n = np.empty(shape)
    n[rows["z"], rows["y"], rows["x"]] = rows["v"] / 3.0
    assert abs(n.mean()) < 0.004 and abs(n.std() - 1) < 0.004 and abs((n**3).mean()) < 0.02 and abs((n**4).mean() - 3) < 0.05
    assert 4.5 < n.max() < 6.5 and -6.5 < n.min() < -4.5
    for axis in range(3):
        for lag in (1, 2, 7):
            a, b = (np.moveaxis(n, axis, 0)[s] for s in (slice(lag, None), slice(None, -lag)))
            assert abs((a * b).mean()) < 0.005
    # no value is clipped where salt and pepper will not be: the streams are independent
    mixed = denoise.mixed_noise(at.where("z < 10"), 0.3, 3.0, own_extremes=True).where("v <> 0").toPandas()["v"] / 3.0
    assert abs(mixed.std() - 1) < 0.01 and mixed.max() > 4


def test_psnr(spark):
    v = volume(spark, A)
    assert stats.mse_psnr(v, v).first()["psnr"] == np.inf
    assert stats.mse_psnr(v, v.where("z > 0")).count() == 0


def brute_components(mask):
    label = -np.ones(mask.shape, int)
    for i in np.flatnonzero(mask.ravel()):
        p = np.unravel_index(i, mask.shape)
        if label[p] >= 0:
            continue
        todo = [p]
        label[p] = i
        while todo:
            q = todo.pop()
            for axis, d in itertools.product(range(3), (-1, 1)):
                r = list(q)
                r[axis] += d
                r = tuple(r)
                if 0 <= r[axis] < mask.shape[axis] and mask[r] and label[r] < 0:
                    label[r] = i
                    todo.append(r)
    return label


def partition(label):
    return {frozenset(np.flatnonzero(label.ravel() == i).tolist()) for i in np.unique(label[label >= 0])}


@pytest.mark.parametrize("block", [2, 32])
def test_components(spark, block):
    mask = A > 120
    got = regions.components(volume(spark, mask.astype(float)).where("v > 0"), block).collect()
    label = -np.ones(mask.shape)
    numbers = {c: i for i, c in enumerate({r["component"] for r in got})}
    for r in got:
        label[r["z"], r["y"], r["x"]] = numbers[r["component"]]
    assert partition(label) == partition(brute_components(mask))
    assert np.array_equal(regions.label_array(mask), brute_components(mask))


def test_morphology_bounds(spark):
    v = volume(spark, A)
    m, b = v.where("v > 100"), extents(v)
    places = lambda d: {(r["z"], r["y"], r["x"]) for r in d.select("z", "y", "x").collect()}
    mask, ball = places(m), regions.ball(1)
    small, large = places(regions.erode(m, ball)), places(regions.dilate(m, ball, b))
    assert small <= mask <= large
    opened = regions.opening(m, ball, b)
    assert places(regions.opening(opened, ball, b)) == places(opened)


def test_fill_holes_of_a_shell(spark):
    a = np.zeros((5, 5, 5))
    a[1:4, 1:4, 1:4] = 1
    a[2, 2, 2] = 0
    v = volume(spark, a)
    assert regions.fill_holes(v.where("v > 0"), v).count() == 27


def test_watershed_partitions_the_volume(spark):
    v = volume(spark, A)
    w = regions.watershed(v)
    assert w.count() == A.size
    few = regions.watershed(v, 0.0, 0.5).select("label").distinct().count()
    assert 1 <= few < w.select("label").distinct().count()


def test_front_on_unit_speed(spark):
    got = array(fronts.fast_marching(volume(spark, np.ones((5, 5, 5))), (2, 2, 2), 0.0, 100.0), (5, 5, 5))
    z, y, x = np.indices((5, 5, 5)) - 2
    far = np.sqrt(z**2 + y**2 + x**2)
    assert got[2, 2, 2] == 0 and np.all(got >= far - 1e-9) and np.all(got <= np.abs(z) + np.abs(y) + np.abs(x) + 1e-9)
    assert np.isnan(array(fronts.fast_marching(volume(spark, np.ones((5, 5, 5))), (2, 2, 2), 0.0, 1.0), (5, 5, 5))[0, 0, 0])


def test_bias_of_a_quadratic_field(spark):
    z, y, x = np.indices((8, 8, 8))
    b = 0.01 * z * z + 0.02 * y - 0.01 * x * y
    got = array(fronts.polynomial_log_bias(volume(spark, 50 * np.exp(b)), 2), b.shape)
    assert np.allclose(got, b - b.mean(), atol=1e-6)


def test_kmeans_equals_lloyd(spark):
    v, values = volume(spark, A), A.ravel()
    means = np.linspace(values[values > 0].min(), values.max(), 4)
    for _ in range(60):
        label = np.abs(values[:, None] - means[None]).argmin(axis=1)
        means = np.array([values[label == i].mean() if (label == i).any() else means[i] for i in range(4)])
    assert np.allclose(cluster.kmeans(v, cluster.uniform_seeds(v, 4), 60).first()["means"], means)


def test_silhouette_brute(spark):
    vals = RNG.integers(0, 20, 60).astype(float)
    labels = np.where(vals < 6, 0, np.where(vals < 13, 1, 2))
    labels[0], vals[0] = 3, 50.0
    d = np.abs(vals[:, None] - vals[None])
    want = []
    for i in range(60):
        own = labels == labels[i]
        if own.sum() == 1:
            want.append(0.0)
            continue
        a = d[i][own].sum() / (own.sum() - 1)
        b = min(d[i][labels == k].mean() for k in set(labels) - {labels[i]})
        want.append((b - a) / max(a, b))
    rows = spark.createDataFrame([("a", int(k), float(x)) for k, x in zip(labels, vals, strict=True)], "vol_id string, label int, v double")
    assert np.isclose(stats.silhouette(rows).first()["silhouette"], np.mean(want))


def test_seeds(spark):
    d = spark.createDataFrame([([3.0, 1.0, 1.00001, 1.00002],)], "s array<double>")
    assert np.allclose(d.select(cluster.dedupe_seeds("s")).first()[0], [1.0, 1.0001, 1.0002, 3.0])
    v = volume(spark, A)
    warm = cluster.warm_seeds(spark.createDataFrame([("a", [100.0, 120.0])], "vol_id string, means array<double>"), v, 3).first()["seeds"]
    assert np.isclose(max(warm), (120 + 255) / 2) or len(warm) == 3


def test_otsu_agrees_with_two_class_multi_otsu(spark):
    v = volume(spark, A)
    assert threshold.otsu(v, 32).first()["bin"] == threshold.multi_otsu(v, 2, 32).first()["bins"][0]


def test_lesion_parts(spark):
    a = np.full((8, 8, 8), 10.0)
    a[2:5, 2:5, 2:5] = 200
    v = volume(spark, a)
    labels = v.select(*KEYS, "v", F.when(F.col("v") > 100, 1).otherwise(0).alias("label"))
    s = {r["label"]: r for r in lesion.score_clusters(labels, v).collect()}
    assert set(s) == {1} and s[1]["size"] == 27 and s[1]["compactness"] == 1.0 and s[1]["tail_extremeness"] == 1.0
    assert lesion.pick_clusters(labels, v).first()["labels"] == [1]
    assert lesion.clean_mask(labels.where("label = 1"), v, 20).count() == 27
    with pytest.raises(ValueError):
        lesion.foreground(v, 500.0)
    both = volume(spark, a * 10, "large").unionByName(v)  # one volume's voxels do not hide that another has none
    with pytest.raises(ValueError, match="1 volumes, a"):
        lesion.foreground(both, 250.0, 0, 0, least=20)


@pytest.mark.parametrize("organ", ["brain", "breast", "liver"])
def test_lesion_run_of_each_organ(spark, organ):
    rng = np.random.default_rng(7)
    z, y, x = np.indices((18, 20, 20))
    body = ((z - 9) / 8) ** 2 + ((y - 10) / 9) ** 2 + ((x - 10) / 9) ** 2 < 1
    spot = (abs(z - 9) <= 1) & (abs(y - 8) <= 2) & (abs(x - 11) <= 2)
    a = np.where(body, 200 + rng.normal(0, 6, z.shape) + 40 * (y > 10), rng.uniform(0, 8, z.shape)) + 300 * spot
    settings = {"close_radius": 1, "open_radius": 1, "least": 500} | ({"least_part": 300} if organ == "breast" else {}) | ({"erode_radius": 2} if organ == "brain" else {})
    report, mask = sweeps.lesion_run(volume(spark, a), organ, range(3, 5), correct={"iterations": (3,), "shrink": 2}, least_lesion=10, **settings)
    r, found = report.first(), {(m["z"], m["y"], m["x"]) for m in mask.collect()}
    assert r["lesion_voxels"] == len(found) and r["roi_voxels"] > 1000
    assert set(zip(*(c.tolist() for c in np.nonzero(spot)), strict=True)) <= found and len(found) < 2 * spot.sum()


def test_kmeans_ends_when_no_cluster_changes(spark):
    values = np.concatenate([RNG.exponential(40, 200), [400.0]]).reshape(1, 3, 67)
    v, flat = volume(spark, values), values.ravel()
    means, rounds, label = np.linspace(flat.min(), flat.max(), 4), 0, None
    while label is None or not np.array_equal(label, np.abs(flat[:, None] - means[None]).argmin(axis=1)):
        label, rounds = np.abs(flat[:, None] - means[None]).argmin(axis=1), rounds + 1
        means = np.array([flat[label == i].mean() if (label == i).any() else means[i] for i in range(4)])
    assert rounds > 6
    assert np.allclose(cluster.kmeans(v, cluster.uniform_seeds(v, 4)).first()["means"], means)


def test_border_erodes_nothing(spark):
    v = volume(spark, np.ones((2, 5, 5)))
    assert regions.safe_closing(v, regions.ball(3), extents(v)).count() == 50
    assert regions.safe_opening(v.where("not (z = 0 and y = 2 and x = 2)"), regions.ball(1), v).count() < 50
    assert regions.safe_opening(v, regions.ball(1), v).count() == 50


def test_registered_grids_are_whole():


    assert list(sweeps.KS) == [3, 4, 5, 6, 7, 8] and len(sweeps.NOISES) == 12
    assert np.prod([len(x) for x in sweeps.WATERSHED.values()]) == 27
    g = sweeps.LEVEL_SET
    assert len(g["iterations"]) * len(g["sigmas"]) == 9 and len(g["alphas"]) * len(g["betas"]) * len(g["stoppings"]) == 27
    assert 1 + 2 * len(sweeps.FILTER_RADII) + len(sweeps.EQUALISE) ** 2 * len(sweeps.EQUALISE_RADII) == 15


def heap_march(speed, seed, start, stop):
    """Fast marching with a heap, a voxel at a time."""
    import heapq

    time, done = np.full(speed.shape, np.inf), np.zeros(speed.shape, bool)
    time[seed] = start
    heap = [(start, seed)]
    while heap:
        t, p = heapq.heappop(heap)
        if done[p] or t > stop:
            continue
        done[p] = True
        for axis, d in itertools.product(range(3), (-1, 1)):
            q = tuple(c + d * (i == axis) for i, c in enumerate(p))
            if not all(0 <= c < n for c, n in zip(q, speed.shape, strict=True)) or done[q] or not speed[q] > 0:
                continue
            near = []
            for a in range(3):
                at = [time[r] for e in (-1, 1) if 0 <= q[a] + e < speed.shape[a] and done[r := tuple(c + e * (i == a) for i, c in enumerate(q))]]
                near += [min(at)] if at else []
            near.sort()
            new = near[0] + 1 / speed[q]
            for k in range(2, len(near) + 1):
                if near[k - 1] < new:
                    b = sum(near[:k])
                    new = (b + np.sqrt(max(0.0, b * b - k * (sum(x * x for x in near[:k]) - 1 / speed[q] ** 2)))) / k
            if new < time[q]:
                time[q] = new
                heapq.heappush(heap, (new, q))
    return np.where(done, time, np.nan)


@pytest.mark.parametrize("block", [3, 48])
def test_front_equals_heap(spark, block):
    speed = RNG.random((7, 8, 9)) * (RNG.random((7, 8, 9)) > 0.15)
    speed[2, 3, 4] = 1.0
    both = volume(spark, speed).unionByName(volume(spark, speed * 2, "b"))
    got = fronts.fast_marching(both, (2, 3, 4), 1.5, 6.0, block)
    for name, f in (("a", 1), ("b", 2)):
        assert np.allclose(array(got.where(f"vol_id = '{name}'"), speed.shape), heap_march(speed * f, (2, 3, 4), -1.5, 6.0), atol=1e-9, equal_nan=True)


def test_level_set_is_its_parts(spark):
    got = array(fronts.level_set(volume(spark, A), (2, 3, 4), 1, 0.5, -20.0, 60.0, 4.0), A.shape, "label")
    grad = array(stencil.gaussian_gradient(stencil.curvature_diffusion(volume(spark, A), 1), 0.5), A.shape)
    t = heap_march(1 / (1 + np.exp((grad - 60) / 20)), (2, 3, 4), -5.0, 4.0)
    assert np.array_equal(got == 255, (t >= 0) & (t <= 4))


@pytest.mark.parametrize("block", [3, 32])
def test_diffusion_equals_numpy(spark, block, monkeypatch):
    v = A.copy()
    for _ in range(5):
        p = np.pad(v, 2, mode="edge")
        g = stencil._central(p)
        size = np.sqrt(sum(d * d for d in g)) + 1e-12
        flux = [np.exp(-0.5 * (size / 3) ** 2) * d / size for d in g]
        v = v + 0.0625 * size[1:-1, 1:-1, 1:-1] * sum(stencil._central(f)[a] for a, f in enumerate(flux))
    wide = stencil.over_blocks
    monkeypatch.setattr(stencil, "over_blocks", lambda *a, **k: wide(*a, **k, block=block))
    assert np.allclose(array(stencil.curvature_diffusion(volume(spark, A), 5), A.shape), v, atol=1e-9)


def test_both_ways_of_kmeans_and_components(spark):
    v = volume(spark, A).unionByName(volume(spark, A[::-1] * 1.5 - 20, "b"))
    key = lambda df: {(r["vol_id"], r["k"], r["strategy"]): ([round(x, 6) for x in r["means"]], round(r["ch"], 4), round(r["silhouette"], 6)) for r in df.collect()}
    assert key(cluster.sweep(v, range(3, 5))) == key(cluster.sweep(v, range(3, 5), bound=0))
    assert {r["vol_id"] for r in cluster.best_per_k(cluster.sweep(v, range(3, 5))).collect()} == {"a", "b"}
    e = spark.createDataFrame([("n1", "n2"), ("n5", "n3"), ("n2", "n3"), ("n8", "n9"), ("n7", "n7")], "a string, b string")
    got = [{r["node"]: r["component"] for r in regions.star_components(e, few).collect()} for few in (0, 100)]
    assert got[0] == got[1] == {"n1": "n1", "n2": "n1", "n3": "n1", "n5": "n1", "n8": "n8", "n9": "n8"}


def test_percentiles_equal_numpy(spark):
    wide = np.concatenate([RNG.normal(size=500), RNG.integers(0, 3, 400), [1e9, -1e7]])
    ps = [0.0, 0.013, 0.25, 0.5, 0.82, 0.999, 1.0]
    rows = [("a", float(x)) for x in wide] + [("b", 4.0)] * 3 + [("b", None)]
    got = {r["vol_id"]: r["p"] for r in stats.percentiles(spark.createDataFrame(rows, "vol_id string, v double"), ps).collect()}
    assert np.allclose(got["a"], np.percentile(wide, np.array(ps) * 100), rtol=1e-12) and got["b"] == [4.0] * 7


@pytest.mark.parametrize("r", [1, 2])
def test_morphology_equals_shifts(spark, r):
    v, mask = volume(spark, A), A > 100
    ball = regions.ball(r)
    wide = np.pad(mask, r)
    shift = lambda o: wide[tuple(slice(r + d, r + d + n) for d, n in zip(o, A.shape, strict=True))]
    places = lambda d: {(x["z"], x["y"], x["x"]) for x in d.collect()}
    at = lambda m: set(zip(*(i.tolist() for i in np.nonzero(m)), strict=True))
    m = v.where("v > 100")
    assert places(regions.dilate(m, ball, extents(v))) == at(np.any([shift(o) for o in ball], axis=0))
    assert places(regions.erode(m, ball)) == at(np.all([shift(o) for o in ball], axis=0))
    wide = np.pad(mask, r, constant_values=True)
    assert places(regions.erode(m, ball, v)) == at(np.all([shift(o) for o in ball], axis=0))


@pytest.mark.parametrize("block", [2, 32])
def test_basins_equal_descent(spark, block, monkeypatch):
    a = np.floor(A / 40)  # with plateaus
    to = {}
    for p in np.ndindex(a.shape):
        near = [p] + [tuple(c + d * (i == k) for i, c in enumerate(p)) for k in range(3) for d in (-1, 1)]
        to[p] = min((q for q in near if all(0 <= c < n for c, n in zip(q, a.shape, strict=True))), key=lambda q: (a[q], q))
    root = lambda p: p if to[p] == p else root(to[p])
    wide = regions.over_blocks
    monkeypatch.setattr(regions, "over_blocks", lambda *x, **k: wide(*x, **k, block=block))
    got = {(r["z"], r["y"], r["x"]): r["label"] for r in regions.watershed(volume(spark, a)).collect()}
    code = lambda p: sum((c + (1 << 20)) << s for c, s in zip(p, (42, 21, 0), strict=True))
    assert got == {p: code(root(p)) for p in to}


def test_names_with_hash_and_absent_seed(spark):
    v = volume(spark, A, "a#b")
    labels = v.select(*KEYS, "v", F.when(F.col("v") > 100, 1).otherwise(0).alias("label"))
    assert {r["vol_id"] for r in lesion.score_clusters(labels, v, max_fraction=1.0).collect()} == {"a#b"}
    both = v.unionByName(volume(spark, A[:2], "small"))
    assert {r["vol_id"] for r in regions.confidence_connected(both, (4, 4, 4), 2.0, 1).collect()} == {"a#b"}


def _greedy(edges, floors, limit):
    """Regions of a graph: again and again the two of least saliency merge (pass less the higher floor as it is by then), up to limit."""
    region = {n: {n} for n in floors}
    floor = {n: (f, n) for n, f in floors.items()}
    of = {n: n for n in floors}
    while True:
        low = {}
        for a, b, h in edges:
            p, q = sorted((of[a], of[b]))
            if p != q:
                low[p, q] = min(low.get((p, q), (np.inf,)), (h, a, b))
        best = min(((h[0] - max(floor[p], floor[q])[0], h, p, q) for (p, q), h in low.items()), default=None)
        if best is None or best[0] > limit:
            return {frozenset(r) for r in region.values()}
        _, _, p, q = best
        for n in region[q]:
            of[n] = p
        region[p] |= region.pop(q)
        floor[p] = min(floor[p], floor.pop(q))


@pytest.mark.parametrize(("seed", "whole"), [(0, False), (1, False), (2, True), (3, True), (4, False)])
def test_merge_tree_equals_merging_by_saliency(spark, seed, whole):
    rng = np.random.default_rng(seed)
    n = 40
    draw = (lambda k: rng.integers(0, 30, k).astype(float)) if whole else (lambda k: rng.uniform(0, 30, k))
    floors = dict(enumerate(draw(n).tolist()))
    pairs = {tuple(sorted(p)) for p in rng.integers(0, n, (120, 2)).tolist() if p[0] != p[1]} | {(i, i + 1) for i in range(n - 1)}
    edges = [(a, b, max(floors[a], floors[b]) + float(d)) for (a, b), d in zip(sorted(pairs), draw(len(pairs)), strict=True)]
    graph = spark.createDataFrame([("v", a, b, h, floors[a], floors[b], a, b) for a, b, h in edges], regions._PASSES)
    for few in (0, 30, 1000):  # by rounds, by both, in one task
        tree = [tuple(r) for r in regions.merge_tree(graph, few).select("a", "b", "saliency").collect()]
        assert len(tree) == n - 1
        for limit in (0.0, 2.0, 5.0, 12.0, 100.0):
            of = {i: i for i in range(n)}
            for a, b, s in tree:
                if s <= limit:
                    p, q = of[a], of[b]
                    of = {k: p if v == q else v for k, v in of.items()}
            got = {frozenset(k for k, v in of.items() if v == r) for r in set(of.values())}
            if whole:  # ties may be merged in another order, into as many regions
                assert len(got) == len(_greedy(edges, floors, limit))
            else:
                assert got == _greedy(edges, floors, limit)


def test_a_merged_basin_has_the_lower_floor(spark):
    line = np.array([0, 6, 5, 7, 4, 20], float).reshape(1, 1, -1)
    label = lambda level: [r["label"] for r in regions.watershed(volume(spark, line), 0.0, level).orderBy("x").collect()]
    at = label(0.1)  # 5 merges with 0 over 6; from 0 and 5 to 4 the pass is 3 above the higher floor, limit 2
    assert len(set(at)) == 2 and at[0] == at[2] != at[4]
    assert len(set(label(0.04))) == 3 and len(set(label(0.15))) == 1


def test_merge_tree_of_one_or_no_basin(spark):
    flat = regions.basins(volume(spark, np.zeros((2, 3, 3))))
    assert {r["label"] for r in regions.merge_levels(flat, [0.5]).collect()} == {regions.basins(volume(spark, np.zeros((1, 1, 1)))).first()["label"]}
    assert regions.merge_levels(flat.where("false"), [0.5]).count() == 0


def test_basin_graph_over_blocks(spark):
    rng = np.random.default_rng(3)
    b = regions.basins(volume(spark, rng.normal(size=(7, 8, 9)))).cache()
    want = {tuple(r) for r in regions.basin_graph(b).collect()}
    assert len(want) > 50 and {tuple(r) for r in regions.basin_graph(b, block=3).collect()} == want


@pytest.mark.parametrize("sigma", [0.5, 1.0, 2.0, 12.0])
def test_recursive_filters_are_nearly_gaussian(sigma):
    n = 301
    x = np.zeros(n)
    x[n // 2] = 1
    d = np.arange(n) - n // 2
    g = np.exp(-0.5 * (d / sigma) ** 2)
    g /= g.sum()
    assert np.abs(stencil.recursive_filter(x, sigma) - g).max() < (0.02 if sigma < 1 else 5e-3) * g.max()
    slope = -d / sigma**2 * g
    if sigma >= 1:
        assert np.abs(stencil.recursive_filter(x, sigma, True) - slope).max() < 0.02 * slope.max()
    line = 3.0 * np.arange(n) + 5
    middle = slice(n // 2 - 20, n // 2 + 20)
    assert np.allclose(stencil.recursive_filter(line, sigma)[middle], line[middle], atol=1e-6)
    assert np.allclose(stencil.recursive_filter(line, sigma, True)[middle], 3.0, atol=1e-6)
    flat = np.full((9, 2), 7.0)
    assert np.allclose(stencil.recursive_filter(flat, sigma), 7) and np.allclose(stencil.recursive_filter(flat, sigma, True), 0, atol=1e-9)


@pytest.mark.parametrize("block", [3, 32])
def test_recursive_gradient_over_blocks(spark, block, monkeypatch):
    made = stencil.chunked
    monkeypatch.setattr(stencil, "chunked", lambda v: made(v, block))
    got = array(stencil.recursive_gaussian_gradient(volume(spark, A), 1.5), A.shape)
    along = lambda a, axis, slope: np.moveaxis(stencil.recursive_filter(np.moveaxis(a, axis, 0), 1.5, slope), 0, axis)
    want = 0.0
    for axis in range(3):
        d = A
        for k in range(3):
            d = along(d, k, k == axis)
        want = want + d * d
    assert np.allclose(got, np.sqrt(want), atol=1e-9)


def test_equalisations_share_their_powers(monkeypatch):
    """All combinations at once give what each gives by its windows, and a power is taken once for each alpha and place of the window."""
    p = np.random.default_rng(4).normal(100, 60, (14, 13, 12))
    calls = []
    plain = np.abs
    monkeypatch.setattr(np, "abs", lambda x: calls.append(1) or plain(x))
    got = iter(stencil.plain_equalisations(p, (0.3, 0.5), (0.3, 0.5), (1, 3), 0.0, 500.0))
    monkeypatch.undo()
    assert len(calls) == 7**3
    for a, b, r in itertools.product((0.3, 0.5), (0.3, 0.5), (1, 3)):
        w = windows(p[3 - r : 11 + r, 3 - r : 10 + r, 3 - r : 9 + r], (r, r, r)) / 500 - 0.5
        u = w[..., w.shape[-1] // 2, None]
        d = u - w
        f = 0.5 * np.sign(d) * np.abs(2 * d) ** a - b * d + b * u
        assert np.allclose(next(got), (f.mean(axis=-1) + 0.5) * 500)


def test_errors_of_chunks_are_those_of_voxels(spark):
    from volspark.operators.blocks import chunk_errors, chunked

    clean = volume(spark, A)
    noisy = clean.select(F.concat("vol_id", F.lit("#3")).alias("vol_id"), "z", "y", "x", (F.col("v") + F.col("x") % 3).alias("v"))
    want = stats.mse_psnr(clean.select(F.concat("vol_id", F.lit("#3")).alias("vol_id"), "z", "y", "x", "v"), noisy).first()
    got = chunk_errors(chunked(clean), chunked(noisy)).first()
    assert (got["vol_id"], got["n"]) == (want["vol_id"], want["n"]) and np.allclose([got["mse"], got["psnr"]], [want["mse"], want["psnr"]])
    assert chunk_errors(chunked(clean), chunked(noisy.where("x > 0"))).count() == 0  # of different shape


def test_adaptive_median_opens_few_large_windows(spark, monkeypatch):
    """A larger window is taken only for places that need one."""
    from volspark.operators import blocks, denoise

    seen, made = [], {}
    monkeypatch.setattr(denoise, "over_chunks", lambda chunks, kernel, *_: made.setdefault("kernel", kernel))
    denoise.chunk_adaptive_median(None, 9)
    plain = np.median
    monkeypatch.setattr(np, "median", lambda w, axis: seen.append(len(w)) or plain(w, axis=axis))
    p = np.random.default_rng(2).normal(size=(3, 20, 20))
    p[1, 10:13, 10:13] = 5.0
    made["kernel"](p)
    assert seen[0] == 3 * 12 * 12 and 0 < seen[1] < 10 and blocks


def test_repeated_samples_share_their_pools(spark, monkeypatch):
    """Gradients and percentiles are made once for all repeats, and the measures are those of each sample alone."""
    vox = volume(spark, A)
    labels = vox.withColumn("label", F.when(F.col("v") < 128, 0).otherwise(1))
    grad = vox.withColumn("v", F.abs(F.col("v") - 100))
    want = [stats.calinski_harabasz(lesion.stratified_sample(labels, grad, 120, 42 + i)).first()["ch"] for i in range(2)]
    calls, plain = [], lesion.percentiles
    monkeypatch.setattr(lesion, "percentiles", lambda *a, **k: calls.append(1) or plain(*a, **k))
    got = lesion.evaluate(labels, grad, 2, 120).collect()
    assert len(got) == 1 and len(calls) == 1
    assert np.allclose([got[0]["ch_mean"], got[0]["ch_var"]], [np.mean(want), np.var(want)])
