"""Bias field correction by sharpening and cubic B-splines, after Sled, Zijdenbos and Evans (1998) and Tustison et al. (2010).

The logarithm of a volume is a sharp distribution of tissues blurred by a smooth field. A round deconvolves the histogram of what is
corrected so far (Wiener filter), takes the difference between each value and its sharpened expectation, and fits a cubic B-spline
lattice to that, which is added to the field; levels double the lattice's mesh. The fit is by weighted sums of each control point
(Lee, Wolberg and Shin 1997), and weights are products of those of the axes, so a dense box adds to all control points by three small
matrix products. A volume's box structure is that of volspark.operators.blocks.

Volumes of at most ``few`` fitted voxels are solved in a task each; others by rounds over all executors, in which chunks send a histogram and
a lattice, never voxels. Both use the same functions, so they agree but for the order of additions.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volspark.operators.blocks import CHUNK, Chunks, chunk_row, chunked, voxels_of
from volspark.schema import KEYS
from volspark.session import cut
from volspark.sources.grids import extents

#: Voxels that a task may fit alone (8 bytes each, and some copies).
FEW_VOXELS = 4_000_000
BINS = 200
#: Full width of the blurring Gaussian at half its height (in log units), and noise of the Wiener filter (fixed values).
FWHM, NOISE = 0.15, 0.01


def spline(at: np.ndarray, lo: int, hi: int, mesh: int) -> np.ndarray:
    """places x control points: weights of a uniform cubic B-spline of mesh spans over lo..hi; a place beyond has those of the end."""
    t = np.clip((at - lo) / max(hi - lo, 1), 0.0, 1.0) * mesh
    span = np.minimum(t.astype(int), mesh - 1)
    u = t - span
    w = np.stack([(1 - u) ** 3, 3 * u**3 - 6 * u**2 + 4, -3 * u**3 + 3 * u**2 + 3 * u + 1, u**3], axis=1) / 6
    out = np.zeros((len(t), mesh + 3))
    np.put_along_axis(out, span[:, None] + np.arange(4), w, axis=1)
    return out


def _contract(box: np.ndarray, by: list[np.ndarray]) -> np.ndarray:
    """Sum over all places of box times a weight of each axis (places x outputs)."""
    for w in by:  # an axis goes from the front to the back
        box = np.tensordot(box, w, axes=(0, 0))
    return box


class Place:
    """Where a box lies in its volume: the axes' coordinates and bounds."""

    def __init__(self, first: list[int], size: list[int], step: list[int], lo: list[int], hi: list[int]):
        self.axes = [(np.arange(f, f + n) * s + s // 2, a, z) for f, n, s, a, z in zip(first, size, step, lo, hi, strict=True)]

    def weights(self, mesh: int) -> list[np.ndarray]:
        return [spline(c, lo, hi, mesh) for c, lo, hi in self.axes]

    def value(self, lattice: np.ndarray) -> np.ndarray:
        """The field of a lattice in the box."""
        return _contract(lattice, [w.T for w in self.weights(lattice.shape[0] - 3)])

    def sums(self, residual: np.ndarray, mesh: int) -> np.ndarray:
        """Numerators and denominators of all control points; missing voxels (NaN) do not count."""
        w = self.weights(mesh)
        there = ~np.isnan(residual)
        top = _contract(np.where(there, residual, 0.0), [a**3 / (a**2).sum(axis=1, keepdims=True) for a in w])
        return np.stack([top, _contract(there.astype(float), [a**2 for a in w])])


def histogram(w: np.ndarray, lo: float, hi: float, bins: int = BINS) -> np.ndarray:
    """Counts, each value shared between the two bin centres about it."""
    x = w[~np.isnan(w)]
    t = (x - lo) / (hi - lo) * (bins - 1) if hi > lo else np.zeros(len(x))
    i = np.minimum(t.astype(int), bins - 2)
    return np.bincount(i, 1 - (t - i), bins) + np.bincount(i + 1, t - i, bins)


def sharpened(counts: np.ndarray, lo: float, hi: float, fwhm: float = FWHM, noise: float = NOISE) -> np.ndarray:
    """Of each bin centre the expected value without the blur."""
    bins = len(counts)
    slope = (hi - lo) / (bins - 1)
    if not slope > 0:
        return np.full(bins, lo)
    n = 1 << (int(np.ceil(np.log2(bins))) + 1)
    before = (n - bins) // 2
    padded = np.zeros(n)
    padded[before : before + bins] = counts
    k = np.minimum(np.arange(n), n - np.arange(n))  # distance on the circle
    wide = fwhm / slope
    blur = np.fft.fft(2 * np.sqrt(np.log(2) / np.pi) / wide * np.exp(-4 * np.log(2) * (k / wide) ** 2))
    sharp = np.maximum(np.fft.ifft(np.fft.fft(padded) * (np.conj(blur) / (np.abs(blur) ** 2 + noise)).real).real, 0.0)
    centre = lo + (np.arange(n) - before) * slope
    blurred = lambda x: np.fft.ifft(np.fft.fft(x) * blur).real
    top, under = blurred(centre * sharp), blurred(sharp)
    found = np.divide(top, under, out=np.zeros(n), where=np.abs(under) > 1e-12 * max(np.abs(under).max(), 1e-300))
    return found[before : before + bins]


def residual(w: np.ndarray, expected: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """w less the expected value, which is interpolated between bin centres."""
    return w - np.interp(w, np.linspace(lo, hi, len(expected)), expected)


def lattice_of(sums: np.ndarray) -> np.ndarray:
    return np.divide(sums[0], sums[1], out=np.zeros_like(sums[0]), where=sums[1] > 0)


def solve(boxes: list[tuple[Place, np.ndarray]], iterations: list[int], threshold: float) -> list[np.ndarray]:
    """Lattices, one a level, of a volume whose logarithms (NaN: not fitted) are in boxes."""
    field, out = [np.zeros(u.shape) for _, u in boxes], []
    for level, most in enumerate(iterations):
        mesh = 1 << level
        lattice = np.zeros((mesh + 3,) * 3)
        for _ in range(most):
            w = [u - f for (_, u), f in zip(boxes, field, strict=True)]
            some = [x for x in w if not np.isnan(x).all()]
            if not some:
                break
            lo, hi = min(np.nanmin(x) for x in some), max(np.nanmax(x) for x in some)
            expected = sharpened(sum(histogram(x, lo, hi) for x in some), lo, hi)
            delta = lattice_of(sum(p.sums(residual(x, expected, lo, hi), mesh) for (p, _), x in zip(boxes, w, strict=True)))
            lattice += delta
            change = [p.value(delta) for p, _ in boxes]
            field = [f + d for f, d in zip(field, change, strict=True)]
            if _still(sum(_moments(d, u) for d, (_, u) in zip(change, boxes, strict=True)), threshold):
                break
        out.append(lattice)
    return out


def _moments(change: np.ndarray, u: np.ndarray) -> np.ndarray:
    """n, sum and squares of the factors by which a round changes the fitted voxels."""
    r = np.exp(change[~np.isnan(u)])
    return np.array([len(r), r.sum(), (r * r).sum()])


def _still(moments: np.ndarray, threshold: float) -> bool:
    n, s, q = moments
    return n < 2 or np.sqrt(max(q - s * s / n, 0.0) / (n - 1)) / (s / n) < threshold


_FIELD = "vol_id string, lattices array<array<double>>"


def _opened(lattices: list[list[float]]) -> list[np.ndarray]:
    return [np.array(x).reshape((round(len(x) ** (1 / 3)),) * 3) for x in lattices]


def _place(row: dict) -> Place:
    return Place(row["first"], row["size"], row["step"], row["lo"], row["hi"])


def _value(row: dict) -> np.ndarray:
    return np.frombuffer(row["v"], np.float64).reshape(row["size"])


def _fitted(vox: DataFrame, mask: DataFrame | None, shrink: int) -> tuple[Chunks, DataFrame]:
    """Chunks of log v of the fitted voxels on the shrunk grid; and vol_id, step, lo, hi of the whole volumes."""
    e = extents(vox)
    step = [F.when(F.col(f"hi_{a}") - F.col(f"lo_{a}") + 1 < shrink, 1).otherwise(shrink) for a in "zyx"]
    frame = cut(e.select("vol_id", F.array(*step).alias("step"), F.array(*[F.col(f"lo_{a}") for a in "zyx"]).alias("lo"), F.array(*[F.col(f"hi_{a}") for a in "zyx"]).alias("hi")))
    some = vox.where("v > 0") if mask is None else vox.where("v > 0").join(mask.select(*KEYS), KEYS, "left_semi")
    some = some.join(F.broadcast(frame.select("vol_id", "step")), "vol_id").where(" and ".join(f"pmod({a}, step[{i}]) = step[{i}] div 2" for i, a in enumerate("zyx")))
    return chunked(some.select("vol_id", *[F.floor(F.col(a) / F.col("step")[i]).cast("int").alias(a) for i, a in enumerate("zyx")], F.log("v").alias("v"))), frame


def fit_fields(vox: DataFrame, mask: DataFrame | None = None, iterations: tuple[int, ...] = (40, 40, 30), shrink: int = 4, threshold: float = 0.001, few: int = FEW_VOXELS) -> tuple[DataFrame, DataFrame]:
    """(fields, frame): vol_id and lattices of each volume with a fitted voxel, and vol_id, step, lo, hi of all."""
    chunks, frame = _fitted(vox, mask, shrink)
    rows = chunks.data.join(F.broadcast(frame), "vol_id")
    large = cut(chunks.data.groupBy("vol_id").agg(F.sum(F.col("size")[0].cast("long") * F.col("size")[1] * F.col("size")[2]).alias("n")).where(F.col("n") > few).select("vol_id"))

    def alone(rows: pa.Table) -> pa.Table:
        boxes = [(_place(r), _value(r)) for r in sorted(rows.to_pylist(), key=lambda r: r["first"])]
        found = solve(boxes, list(iterations), threshold)
        return pa.table({"vol_id": pa.array([rows.column("vol_id")[0].as_py()]), "lattices": pa.array([[x.ravel().tolist() for x in found]], pa.list_(pa.list_(pa.float64())))})

    fields = rows.join(F.broadcast(large), "vol_id", "left_anti").groupBy("vol_id").applyInArrow(alone, _FIELD)
    if not large.isEmpty():
        fields = fields.unionByName(_by_rounds(cut(rows.join(F.broadcast(large), "vol_id", "left_semi")), large, iterations, threshold))
    return cut(fields), frame


def _added(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """Elementwise sums of an array column by key."""
    each = df.select(*keys, F.posexplode(column).alias("i", "x")).groupBy(*keys, "i").agg(F.sum("x").alias("x"))
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias(column))


def _by_rounds(rows: DataFrame, volumes: DataFrame, iterations: tuple[int, ...], threshold: float) -> DataFrame:
    """The rounds of solve() for volumes of many chunks: each chunk sends its range, then its histogram, then its sums. A volume that has come to
    rest in a level waits for the next one."""

    def each_chunk(df: DataFrame, f, schema: str) -> DataFrame:
        """f of a chunk's row, its place and its values less its field: the columns after vol_id."""
        names = [c.split()[0] for c in schema.split(", ")]
        kinds = {"double": pa.float64(), "array<double>": pa.list_(pa.float64())}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    p, u = _place(r), _value(r)
                    out = f(r, p, u, u - sum((p.value(x) for x in _opened(r["lattices"])), np.zeros(u.shape)))
                    yield pa.RecordBatch.from_arrays([pa.array([r["vol_id"]]), *[pa.array([x], kinds[c.split()[1]]) for x, c in zip(out, schema.split(", "), strict=True)]], names=["vol_id", *names])

        return df.mapInArrow(run, f"vol_id string, {schema}")

    def sharpen(df: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"vol_id": df["vol_id"], "lo": df["lo"], "hi": df["hi"], "expected": [sharpened(np.array(c), lo, hi).tolist() for c, lo, hi in zip(df["counts"], df["lo"], df["hi"], strict=True)]})

    model = volumes.select("vol_id", F.expr("cast(array() as array<array<double>>)").alias("lattices"))
    for level, most in enumerate(iterations):
        mesh = 1 << level
        model = cut(model.select("vol_id", F.concat("lattices", F.array(F.array_repeat(F.lit(0.0), (mesh + 3) ** 3))).alias("lattices"), F.lit(True).alias("moves")))
        for _ in range(most):
            active = rows.join(F.broadcast(model.where("moves").drop("moves")), "vol_id")
            ends = lambda r, p, u, w: (float(np.nanmin(w)), float(np.nanmax(w))) if not np.isnan(w).all() else (None, None)
            span = each_chunk(active, ends, "lo double, hi double").groupBy("vol_id").agg(F.min("lo").alias("w_lo"), F.max("hi").alias("w_hi"))
            counts = each_chunk(active.join(F.broadcast(span), "vol_id"), lambda r, p, u, w: (histogram(w, r["w_lo"], r["w_hi"]).tolist(),), "counts array<double>")
            expected = _added(counts, "counts", "vol_id").join(span, "vol_id").select("vol_id", "counts", F.col("w_lo").alias("lo"), F.col("w_hi").alias("hi"))
            expected = expected.groupBy("vol_id").applyInPandas(sharpen, "vol_id string, lo double, hi double, expected array<double>").toDF("vol_id", "e_lo", "e_hi", "expected")
            sums = each_chunk(active.join(F.broadcast(expected), "vol_id"), lambda r, p, u, w, mesh=mesh: (p.sums(residual(w, np.array(r["expected"]), r["e_lo"], r["e_hi"]), mesh).ravel().tolist(),), "sums array<double>")
            points = (mesh + 3) ** 3
            ratio = F.expr(f"transform(sequence(0, {points - 1}), i -> if(sums[i + {points}] > 0, sums[i] / sums[i + {points}], 0d))")
            delta = cut(_added(sums, "sums", "vol_id").select("vol_id", ratio.alias("delta")))
            change = each_chunk(active.join(F.broadcast(delta), "vol_id"), lambda r, p, u, w: (_moments(p.value(_opened([r["delta"]])[0]), u).tolist(),), "m array<double>")
            m = _added(change, "m", "vol_id")
            rests = F.expr(f"if(m[0] < 2, true, sqrt(greatest(m[2] - m[1] * m[1] / m[0], 0d) / (m[0] - 1)) / (m[1] / m[0]) < {threshold!r}d)")
            rest = m.select("vol_id", rests.alias("rests"))
            moved = model.join(delta, "vol_id", "left").join(rest, "vol_id", "left")
            added = F.zip_with(F.element_at("lattices", -1), "delta", lambda a, b: a + b)
            lattices = F.when(F.col("delta").isNull(), F.col("lattices")).otherwise(F.concat(F.slice("lattices", 1, level), F.array(added)) if level else F.array(added))
            model = cut(moved.select("vol_id", lattices.alias("lattices"), (F.col("moves") & ~F.coalesce("rests", F.lit(True))).alias("moves")))
            if model.where("moves").isEmpty():
                break
    return model.select("vol_id", "lattices")


def n4_log_bias(vox: DataFrame, mask: DataFrame | None = None, iterations: tuple[int, ...] = (40, 40, 30), shrink: int = 4, threshold: float = 0.001, few: int = FEW_VOXELS, corrected: bool = False) -> DataFrame:
    """vol_id, z, y, x, v: the logarithm of each volume's bias, or (corrected) the values divided by its bias.

    Fitted are voxels over 0 (in the mask, if one is given) at every shrink-th place of an axis; an axis shorter than that counts whole. The
    lattice spans the whole volume. Each level ends after its number of rounds, or once the deviation of a round's factors is under threshold times
    their mean. A volume without a fitted voxel has bias 0; so has one of a single value."""
    fields, frame = fit_fields(vox, mask, iterations, shrink, threshold, few)
    whole = chunked(vox)

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                p = Place(r["first"], r["size"], [1, 1, 1], r["lo"], r["hi"])
                f = reduce(np.add, [p.value(x) for x in _opened(r["lattices"] or [])], np.zeros(r["size"]))
                v = _value(r) / np.exp(f) if corrected else f
                yield from chunk_row(r["vol_id"], [r["b_z"], r["b_y"], r["b_x"]], r["first"], [("v", v)]).to_batches()

    data = whole.data.join(F.broadcast(frame.select("vol_id", "lo", "hi")), "vol_id").join(F.broadcast(fields), "vol_id", "left").mapInArrow(evaluate, f"{CHUNK}, v binary")
    return voxels_of(Chunks(data, whole.bounds, whole.block))
