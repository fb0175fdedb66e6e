"""Pipelines and parameter sweeps composed from the operators; a run per row."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volspark.functions import pointwise as P
from volspark.functions import stats as A
from volspark.operators import cluster, denoise, fronts, lesion, regions, stencil, threshold
from volspark.operators.bias import n4_log_bias
from volspark.operators.blocks import Chunks, box_mean, chunked, over_blocks
from volspark.operators.levels import basin_counts
from volspark.schema import KEYS
from volspark.session import cut
from volspark.sources.grids import rescale_uint16


#: Foreground and cluster choice of each organ (fixed values).
ORGANS = {
    "brain": ({"threshold": "otsu", "close_radius": 3, "open_radius": 1, "erode_radius": 6, "least": 5_000}, {"tail": "bright", "min_fraction": 0.0005, "max_fraction": 0.10}),
    "breast": ({"threshold": "li", "close_radius": 5, "open_radius": 2, "largest": False, "least_part": 20_000, "least": 200_000}, {"tail": "bright", "min_fraction": 0.0005, "max_fraction": 0.08}),
    "liver": ({"threshold": "otsu", "close_radius": 3, "open_radius": 1, "least": 5_000}, {"tail": "bright", "min_fraction": 0.0005, "max_fraction": 0.10}),
}
#: Rounds of the bias correction at each level, and its shrink factor (fixed values).
BIAS = {"iterations": (40, 40, 30), "shrink": 4}
#: The full grids (fixed values).
KS = range(3, 9)
WATERSHED = {"sigmas": [0.5, 1.0, 2.0], "thresholds": [0.005, 0.01, 0.05], "levels": [0.1, 0.2, 0.4]}
LEVEL_SET = {"iterations": [5, 15, 30], "sigmas": [0.5, 1.0, 2.0], "alphas": [-0.5, -1.0, -2.0], "betas": [2.0, 3.0, 5.0], "stoppings": [50.0, 100.0, 200.0]}
LEVEL_SET_FIXED, LEVEL_SET_BEST = (-0.5, 3.0, 100.0), (15, 1.0)
#: Kind, density, sigma, largest window (fixed values).
NOISES = [("none", 0.0, 0.0, 5), ("none", 0.0, 0.0, 7), ("none", 0.0, 0.0, 9), ("salt_pepper", 0.05, 0.0, 7), ("salt_pepper", 0.1, 0.0, 7), ("salt_pepper", 0.3, 0.0, 7), ("salt_pepper", 0.1, 0.0, 5), ("salt_pepper", 0.1, 0.0, 9), ("gaussian", 0.0, 5.0, 7), ("gaussian", 0.0, 10.0, 7), ("gaussian", 0.0, 20.0, 7), ("mixed", 0.1, 10.0, 7)]
FILTER_RADII, EQUALISE, EQUALISE_RADII = (2, 3, 4), (0.3, 0.5), (3, 5)


def lesion_run(vox: DataFrame, organ: str = "liver", ks: range = KS, rounds: int | None = None, correct: dict | None = BIAS, least_lesion: int = 50, **settings) -> tuple[DataFrame, DataFrame]:
    """(report, mask). Foreground, positive shift, bias correction in the foreground, z-score, k sweep by Calinski-Harabasz, cluster choice,
    clean-up: a row a volume with the sweep nested, and the lesion's voxels. settings override the organ's foreground; correct: those of the bias
    correction, None for none; least_lesion: voxels of a part that stays."""
    ground, choice = ORGANS[organ]
    vox = cut(vox)
    roi = lesion.foreground(vox, **(ground | settings)).withColumn("in_roi", F.lit(True))
    marked = vox.join(roi, KEYS, "left").select(*KEYS, "v", F.coalesce("in_roi", F.lit(False)).alias("in_roi"))
    least = marked.where("in_roi").groupBy("vol_id").agg(F.greatest(F.lit(0.0), 1 - F.min("v")).alias("shift"))
    flat = marked.join(F.broadcast(least), "vol_id").select(*KEYS, (F.col("v") + F.col("shift")).alias("v"))
    if correct is not None:
        flat = n4_log_bias(flat, roi, **correct, corrected=True)
    inside = flat.join(roi.select(*KEYS), KEYS, "left_semi")
    normal = cut(P.zscore(inside, F.lit(True)))
    rows = cut(cluster.sweep(normal, ks, rounds))
    best = cluster.best_runs(rows)
    labelled = cut(cluster.label_by_means(normal, best.select("vol_id", "means")))
    picked = cut(lesion.pick_clusters(labelled, normal, **choice))
    mask = labelled.join(F.broadcast(picked), "vol_id").where(F.array_contains("labels", F.col("label"))).select(*KEYS)
    clean = cut(lesion.clean_mask(mask, vox, least_lesion))
    sweep = rows.groupBy("vol_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("k", "strategy", F.size("means").alias("n_means"), F.round("ch", 4).alias("ch"))))).alias("sweep"))
    n = clean.groupBy("vol_id").agg(F.count("*").alias("lesion_voxels"))
    size = roi.groupBy("vol_id").agg(F.count("*").alias("roi_voxels"))
    report = best.select("vol_id", "k", "strategy").join(picked.select("vol_id", F.array_join("labels", ",").alias("labels"), F.round("score", 4).alias("score")), "vol_id").join(size, "vol_id").join(n, "vol_id", "left").na.fill(0, ["lesion_voxels"]).join(sweep, "vol_id")
    return report, clean


def threshold_comparison(vox: DataFrame, bins: int = 128) -> DataFrame:
    """Otsu, Huang and Triangle on the volume rescaled to uint16: threshold and voxels above it, per method."""
    u = rescale_uint16(vox).withColumn("v", F.col("v").cast("double"))
    out = None
    for name in ("otsu", "huang", "triangle"):
        t = threshold.METHODS[name](u, bins)
        row = u.join(F.broadcast(t), "vol_id").groupBy("vol_id", "bin", "threshold").agg(F.count_if(F.col("v") > F.col("threshold")).alias("above"), F.count("*").alias("n"))
        row = row.select("vol_id", F.lit(name).alias("method"), "bin", F.round("threshold", 4).alias("threshold"), "above", "n")
        out = row if out is None else out.unionByName(row)
    return out


def _named(vox: DataFrame, i: int) -> DataFrame:
    """The volume under a name of its own, for a run over several."""
    return vox.select(F.concat("vol_id", F.lit(f"#{i}")).alias("vol_id"), "z", "y", "x", "v")


def _of_runs(rows: DataFrame, runs: list[tuple], names: list[str]) -> DataFrame:
    """vol_id as it was and, in front of the other columns, the parameters of the run."""
    at = F.substring_index("vol_id", "#", -1).cast("int")
    columns = [F.element_at(F.array(*[F.lit(r[k]) for r in runs]), at + 1).alias(n) for k, n in enumerate(names)]
    return rows.select(F.regexp_replace("vol_id", "#[^#]*$", "").alias("vol_id"), *columns, *[c for c in rows.columns if c != "vol_id"])


def watershed_sweep(vox: DataFrame, sigmas: list[float], thresholds: list[float], levels: list[float]) -> DataFrame:
    """Basins for each combination. The volume is put into chunks once; gradients of all sigmas are volumes of one relation, of which a block
    takes all thresholds, and the levels count the merges."""
    c = chunked(vox, max(64, *[len(stencil.gaussian_weights(s)[0]) // 2 for s in sigmas]))
    name = lambda i: F.concat("vol_id", F.lit(f"#{i}"))
    made = [stencil.chunk_gaussian_gradient(c, s).data.withColumn("vol_id", name(i)) for i, s in enumerate(sigmas)]
    bounds = [c.bounds.withColumn("vol_id", name(i)) for i in range(len(sigmas))]
    grads = Chunks(cut(reduce(DataFrame.unionByName, made)), cut(reduce(DataFrame.unionByName, bounds)), c.block)
    rows = basin_counts(grads, thresholds, levels)
    threshold = F.element_at(F.array(*map(F.lit, thresholds)), F.col("run") + 1).alias("threshold")
    return _of_runs(rows.select("vol_id", threshold, "level", "basins", "n"), [(s,) for s in sigmas], ["sigma"])


def level_set_sweep(vox: DataFrame, seed: tuple[int, int, int], iterations: list[int], sigmas: list[float], alphas: list[float], betas: list[float], stoppings: list[float], fixed: tuple[float, float, float], best: tuple[int, float]) -> DataFrame:
    """Phase one: iterations by sigma at the fixed alpha, beta, stopping. Phase two: alpha by beta by stopping at the best iterations and sigma.

    Diffusions and gradients are made once. A front's times do not depend on where it stops, so each speed is marched once, to its last stop;
    the speeds are volumes of one relation, whose fronts advance together.
    """
    runs = [(1, i, s, *fixed[:2]) for i in iterations for s in sigmas] + [(2, *best, a, b) for a in alphas for b in betas]
    smooth, grads, made, last, at = {}, {}, [], vox, 0
    for i in sorted({r[1] for r in runs}):  # each diffusion goes on from the one before it
        smooth[i] = last = cut(stencil.curvature_diffusion(last, i - at))
        at = i
    for k, (_, i, s, a, b) in enumerate(runs):
        grads[i, s] = grads.get((i, s)) or cut(stencil.gaussian_gradient(smooth[i], s))
        made.append(_named(grads[i, s].select(*KEYS, P.sigmoid(F.col("v"), a, b).alias("v")), k))
    times = fronts.fast_marching(reduce(DataFrame.unionByName, made), seed, stopping=max([fixed[2], *stoppings]))
    inside = _of_runs(times, runs, ["phase", "iterations", "sigma", "alpha", "beta"])
    stops = F.when(F.col("phase") == 1, F.array(F.lit(fixed[2]))).otherwise(F.array(*map(F.lit, stoppings)))
    keys = ["vol_id", "phase", "iterations", "sigma", "alpha", "beta", "stopping"]
    return inside.select("*", F.explode(stops).alias("stopping")).groupBy(*keys).agg(F.count_if(F.col("v").between(0, F.col("stopping"))).alias("voxels"))


def noise_table(vox: DataFrame, noises: list[tuple[str, float, float, int]], others: list[str]) -> DataFrame:
    """The adaptive median of each noise and largest window, and the other filters of each noise: noise, density, sigma, filter, n, mse, psnr."""
    kinds = list(dict.fromkeys(n[:3] for n in noises))
    return denoise.denoise_table(vox, kinds, {k: [f"adaptive_median_{w}" for *m, w in noises if tuple(m) == k] + others for k in kinds})


def filter_batch(vox: DataFrame) -> DataFrame:
    """Gradient, means, medians and local equalisations of one volume: a summary row per run. All runs are columns of one pass over blocks."""
    low, high = 0.0, 500.0
    runs = {"gradient": (1, lambda p: stencil.plain_gradient(p, True))}
    runs |= {f"mean_r{r}": (r, lambda p, r=r: box_mean(p, r)) for r in FILTER_RADII}
    runs |= {f"median_r{r}": (r, lambda p, r=r: stencil.plain_median(p, (r, r, r))) for r in FILTER_RADII}
    equalised = [f"equalise_a{a}_b{b}_r{r}" for a in EQUALISE for b in EQUALISE for r in EQUALISE_RADII]
    most = max(*EQUALISE_RADII, *(r for r, _ in runs.values()))

    def kernel(p: np.ndarray) -> tuple[np.ndarray, ...]:
        inner = lambda r: p[tuple(slice(most - r, n - most + r) for n in p.shape)]
        equal = stencil.plain_equalisations(inner(max(EQUALISE_RADII)), EQUALISE, EQUALISE, EQUALISE_RADII, low, high)
        return (*(f(inner(r)) for r, f in runs.values()), *equal)

    names = [*runs, *equalised]
    columns = tuple(f"c{i}" for i in range(len(names)))
    made = over_blocks(vox, kernel, (most,) * 3, "replicate", block=16, columns=columns)
    stats = lambda c: F.struct(F.count(c).alias("n"), F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"))
    rows = made.groupBy("vol_id").agg(*[stats(c).alias(c) for c in columns])
    one = F.explode(F.array(*[F.struct(F.lit(name).alias("filter"), F.col(c).alias("s")) for c, name in zip(columns, names, strict=True)])).alias("r")
    return rows.select("vol_id", one).select("vol_id", "r.filter", "r.s.n", *[F.round(f"r.s.{c}", 4).alias(c) for c in ("min", "max", "mean", "std")])


def workshop(vox: DataFrame, organ: str) -> DataFrame:
    """The three segmentations of a volume side by side: the organ's narrow percentile range, multi-Otsu of three classes, k-means of three clusters:
    method, label, n, percent."""
    vox = cut(vox)
    low, high = A.ORGAN_PERCENTILES[organ][1]
    limits = A.percentiles(vox.where("v > 0"), [low, high])
    made = {
        "range": vox.join(F.broadcast(limits), "vol_id").select(*KEYS, P.binary_threshold(F.col("v"), F.col("p")[0], F.col("p")[1]).alias("label")),
        "otsu": threshold.apply_cuts(vox, threshold.multi_otsu(vox, 3)),
        "kmeans": cluster.label_by_means(vox, cluster.kmeans(vox, cluster.uniform_seeds(vox, 3, most=4))),
    }
    return reduce(DataFrame.unionByName, [A.label_counts(df).select("vol_id", F.lit(name).alias("method"), "label", "n", "percent") for name, df in made.items()])


def region_growing(vox: DataFrame, seed: tuple[int, int, int], lower: float, upper: float) -> DataFrame:
    """Voxels of the connected-threshold and the confidence-connected region, and of both."""
    a = cut(regions.connected_threshold(vox, seed, lower, upper))
    b = cut(regions.confidence_connected(vox, seed, 1.0, 2))
    both = a.intersect(b)
    count = lambda d, n: d.agg(F.count("*").alias("voxels")).select(F.lit(n).alias("method"), "voxels")
    return count(a, "connected_threshold").unionByName(count(b, "confidence_connected")).unionByName(count(both, "both"))
