"""Adaptive denoising, reproducible noise, and the table that compares filters."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volspark.functions.stats import percentiles
from volspark.operators.blocks import Borders, Chunks, box_mean, chunk_errors, chunk_means, chunked, cut_chunks, on_chunks, over_chunks, replicated, voxels_of
from volspark.operators.stencil import chunk_median_without_centre, plain_gradient, plain_median
from volspark.schema import KEYS
from volspark.session import cut

#: Factors of place and seed, and of the mixing rounds, for noise that is the same in every engine: all products of 32-bit numbers
#: with the latter fit a signed long.
PLACE_Z, PLACE_Y, PLACE_X, SEED = 2654435761, 2246822519, 3266489917, 668265263
MIX_1, MIX_2, WORD = 739982445, 695872825, 4294967296


def adaptive_median(vox: DataFrame, largest: int = 7) -> DataFrame:
    """Per axial slice. The window grows 3, 5, ... until its median lies strictly between its extremes; then the
    value stays if it does too, else it becomes that median; without such a window the last median. Borders
    mirrored without the edge. An even size becomes the next smaller odd one, under 3 is 3."""
    return voxels_of(chunk_adaptive_median(chunked(vox), largest))


def chunk_adaptive_median(chunks: Chunks, largest: int = 7) -> Chunks:
    largest = max(3, largest - 1 + largest % 2)
    h = largest // 2

    def kernel(p: np.ndarray) -> np.ndarray:
        core = p[:, h : p.shape[1] - h, h : p.shape[2] - h]
        out, todo = np.empty_like(core), np.nonzero(np.ones(core.shape, bool))
        for r in range(1, h + 1):  # a larger window only where none before it would do
            w = np.lib.stride_tricks.sliding_window_view(p[:, h - r : p.shape[1] - h + r, h - r : p.shape[2] - h + r], (1, 2 * r + 1, 2 * r + 1))
            w = w[todo].reshape(len(todo[0]), (2 * r + 1) ** 2)
            lo, mid, hi, own = w.min(axis=-1), np.median(w, axis=-1), w.max(axis=-1), core[todo]
            found = (lo < mid) & (mid < hi)
            out[todo] = np.where(found & (lo < own) & (own < hi), own, mid)
            todo = tuple(t[~found] for t in todo)
            if not len(todo[0]):
                break
        return out

    return over_chunks(chunks, kernel, (0, h, h), "reflect")


def adaptive_median_approximation(vox: DataFrame) -> DataFrame:
    """In-plane median of radius 1; where the gradient of that median exceeds its 82nd percentile the original value stays.
    Median and gradient come from one pass over blocks."""

    def kernel(p: np.ndarray, borders: Borders) -> tuple[np.ndarray, ...]:
        m = plain_median(p, (0, 1, 1))[1:-1]  # core and one more plane on each side
        m = replicated(m, 1, borders)
        return p[2:-2, 2:-2, 2:-2], m[1:-1, 1:-1, 1:-1], plain_gradient(m)

    local = cut_chunks(over_chunks(chunked(vox), kernel, (2, 2, 2), "replicate", columns=("v", "m", "g"), bordered=True))
    gradients = voxels_of(Chunks(local.data, local.bounds, local.block, ("g",)))
    top = percentiles(gradients.select("vol_id", F.col("g").alias("v")), [0.82]).select("vol_id", F.col("p")[0].alias("top"))
    return voxels_of(on_chunks(local, lambda v, m, g, t: np.where(g > t, v, m), top))


def adaptive_wiener(vox: DataFrame, size: int = 5, noise: float | None = None) -> DataFrame:
    """mu + max(s2 - n2, 0) / max(s2, eps) (v - mu), with window mean mu and variance s2; n2 is their mean unless
    given. Even sizes grow by one; borders mirrored with the edge. Mean and variance come from one pass over blocks."""
    return voxels_of(chunk_adaptive_wiener(chunked(vox, max(32, size // 2)), size, noise))


def chunk_adaptive_wiener(chunks: Chunks, size: int = 5, noise: float | None = None) -> Chunks:
    h = (size + 1 - size % 2) // 2

    def kernel(p: np.ndarray) -> tuple[np.ndarray, ...]:
        mu = box_mean(p, h)
        core = p[h:-h, h:-h, h:-h]
        return core, mu, box_mean(p * p, h) - mu * mu

    local = over_chunks(chunks, kernel, (h, h, h), "symmetric", columns=("v", "mu", "s2"))
    if noise is None:
        local = cut_chunks(local)
        by = chunk_means(local, "s2")
    else:
        by = local.bounds.select("vol_id", F.lit(float(noise)).alias("n2"))
    return on_chunks(local, lambda v, mu, s2, n2: mu + np.maximum(s2 - n2, 0.0) / np.maximum(s2, np.finfo(float).eps) * (v - mu), by)


def with_hash(vox: DataFrame, name: str, seed: int) -> DataFrame:
    """A number of 32 bits for each place and seed, the same wherever it is computed: a linear combination, then xor-shifts and
    multiplications, so that numbers of different seeds are independent streams. A step is a projection of its own, since it uses its input twice."""
    h = F.col("z").cast("long") * PLACE_Z + F.col("y").cast("long") * PLACE_Y + F.col("x").cast("long") * PLACE_X + F.lit(seed).cast("long") * SEED
    out = vox.withColumn(name, F.pmod(h, F.lit(WORD)))
    for shift, factor in ((15, MIX_1), (12, MIX_2), (15, None)):
        mixed = F.col(name).bitwiseXOR(F.shiftrightunsigned(name, shift))
        out = out.withColumn(name, mixed if factor is None else (mixed * factor) % WORD)
    return out


def uniform(name: str) -> Column:
    """In (0, 1), of a number of with_hash."""
    return (F.col(name) + 0.5) / float(WORD)


def gaussian_noise(vox: DataFrame, sigma: float, clip: bool = False, seed: int = 1) -> DataFrame:
    """Adds Box-Muller noise; clip: to whole numbers 0..255."""
    n = F.sqrt(-2 * F.log(uniform("u1"))) * F.cos(2 * np.pi * uniform("u2"))
    v = F.col("v") + sigma * n
    return with_hash(with_hash(vox.select(*KEYS, "v"), "u1", seed), "u2", seed + 7919).select(*KEYS, (F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), v))).cast("double") if clip else v).alias("v"))


def salt_and_pepper(vox: DataFrame, density: float, low: float | None = None, high: float | None = None, seed: int = 1, extremes: DataFrame | None = None) -> DataFrame:
    """int(n density) voxels, half of them (rounded down) to high, the rest to low; without values the extremes of the volume
    (or of ``extremes``). The voxels of smallest noise number are found by a threshold over number counts per volume, not by a global sort."""
    r = (extremes if extremes is not None else vox).groupBy("vol_id").agg(F.min("v").alias("mn"), F.max("v").alias("mx"))
    n = vox.groupBy("vol_id").agg(F.count("*").alias("n"))
    keyed = with_hash(vox.select(*KEYS, "v"), "u", seed + 104_729).withColumn("slot", F.shiftrightunsigned("u", 16).cast("int"))
    slots = keyed.groupBy("vol_id", "slot").agg(F.count("*").alias("k"))
    before = slots.withColumn("before", F.sum("k").over(Window.partitionBy("vol_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)) - F.col("k")).drop("k")
    rank = F.row_number().over(Window.partitionBy("vol_id", "slot").orderBy("u", "z", "y", "x")) + F.col("before")
    ranked = keyed.join(before, ["vol_id", "slot"]).withColumn("rank", rank).join(F.broadcast(n), "vol_id").join(F.broadcast(r), "vol_id")
    count = F.floor(F.col("n") * density)
    top = F.col("mx") if high is None else F.lit(float(high))
    bottom = F.col("mn") if low is None else F.lit(float(low))
    return ranked.select(*KEYS, F.when(F.col("rank") <= F.floor(count / 2), top).when(F.col("rank") <= count, bottom).otherwise(F.col("v")).alias("v"))


def mixed_noise(vox: DataFrame, density: float, sigma: float, seed: int = 1, own_extremes: bool = False) -> DataFrame:
    """Gaussian first, then salt and pepper, whose extremes are 255 and 0, or those of the volume before any noise."""
    noisy = gaussian_noise(vox, sigma, clip=not own_extremes, seed=seed)
    return salt_and_pepper(noisy, density, seed=seed, extremes=vox) if own_extremes else salt_and_pepper(noisy, density, 0, 255, seed)


def add_noise(vox: DataFrame, kind: str, density: float = 0.0, sigma: float = 0.0, seed: int = 1) -> DataFrame:
    made = {"none": lambda: vox, "gaussian": lambda: gaussian_noise(vox, sigma, True, seed), "salt_pepper": lambda: salt_and_pepper(vox, density, 0, 255, seed), "mixed": lambda: mixed_noise(vox, density, sigma, seed)}
    return made[kind]()


FILTERS = {"median26": chunk_median_without_centre, "adaptive_median": lambda c: chunk_adaptive_median(c, 5), "wiener": lambda c: chunk_adaptive_wiener(c, 3)}
FILTERS |= {f"adaptive_median_{w}": lambda c, w=w: chunk_adaptive_median(c, w) for w in (5, 7, 9)}


def denoise_table(vox: DataFrame, noises: list[tuple[str, float, float]], filters: list[str] | dict[tuple[str, float, float], list[str]]) -> DataFrame:
    """noise, density, sigma, filter, n, mse, psnr. filters: those of every noise, or of each.

    The noisy copies of a volume are volumes of one relation, so each filter runs once over all that it is asked for. They become chunks once; filters and errors work
    on these."""
    wanted = filters if isinstance(filters, dict) else {n: filters for n in noises}
    vox = cut(vox)
    name = lambda i: F.concat(F.col("vol_id"), F.lit(f"#{i}")).alias("vol_id")
    place = ["z", "y", "x", "v"]
    noisy = reduce(DataFrame.unionByName, [add_noise(vox, *n).select(name(i), *place) for i, n in enumerate(noises)])
    clean, noisy, out = chunked(vox), chunked(noisy), None
    for f in dict.fromkeys(x for n in noises for x in wanted[n]):
        own = [i for i, n in enumerate(noises) if f in wanted[n]]
        some = noisy.data.where(F.substring_index("vol_id", "#", -1).cast("int").isin(own))
        row = chunk_errors(clean, FILTERS[f](Chunks(some, noisy.bounds, noisy.block))).withColumn("filter", F.lit(f))
        out = row if out is None else out.unionByName(row)
    at = F.substring_index("vol_id", "#", -1).cast("int")
    of = lambda k: F.element_at(F.array(*[F.lit(n[k]) for n in noises]), at + 1)
    return out.select(of(0).alias("noise"), of(1).alias("density"), of(2).alias("sigma"), "filter", "n", "mse", "psnr")
