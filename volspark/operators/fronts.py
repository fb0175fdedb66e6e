"""Front propagation over blocks, and a smooth bias estimate."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volspark.functions.pointwise import sigmoid
from volspark.operators.stencil import curvature_diffusion, gaussian_gradient
from volspark.schema import KEYS
from volspark.session import cut
from volspark.sources.grids import extents


def march(time: np.ndarray, cost: np.ndarray, stop: float, fresh: np.ndarray | None = None) -> np.ndarray:
    """First-order upwind arrival times (Sethian 1996) of the core of an array padded by one plane, whose values are known times of
    neighbours (inf: none); fresh marks the padded places whose time is news (all, if not given). Times only fall, from known ones outwards, so
    the rounds end in the solution of |grad t| = cost; times beyond stop are not passed on, nor is anything into places of infinite cost
    (no speed). A round solves the neighbours of the earliest news alone, those of a narrow band of times, so each place is solved a few times
    whatever the block's size."""
    shape = time.shape
    t, c = time.reshape(-1), np.full(shape, np.inf)
    c[1:-1, 1:-1, 1:-1] = cost
    c = c.reshape(-1)
    open_ = np.isfinite(c)
    steps = [shape[1] * shape[2], shape[2], 1]
    band = float(np.median(cost[np.isfinite(cost)])) if np.isfinite(cost).any() else 0.0
    news = (np.isfinite(time) & (time <= stop) & (True if fresh is None else fresh)).reshape(-1).copy()
    near = np.zeros(t.size, bool)
    while len(at := np.flatnonzero(news)):
        at = at[t[at] <= t[at].min() + band]
        news[at] = False
        for d in steps:  # places of the padding lead nowhere but inwards
            near[np.minimum(at + d, t.size - 1)] = True
            near[np.maximum(at - d, 0)] = True
        todo = np.flatnonzero(near & open_)
        near[:] = False
        if not len(todo):
            continue
        best = np.sort(np.stack([np.minimum(t[todo - d], t[todo + d]) for d in steps]), axis=0)
        best = np.where(best <= stop, best, np.inf)
        own = np.isfinite(best[0]) & (best[0] < t[todo])
        todo, best = todo[own], best[:, own]
        new, cell = best[0] + c[todo], c[todo]
        for k in (2, 3):  # one more axis counts where its time is under the solution without it
            more = np.isfinite(best[k - 1]) & (best[k - 1] < new)
            s, q = best[:k, more].sum(axis=0), (best[:k, more] ** 2).sum(axis=0)
            new[more] = (s + np.sqrt(np.maximum(s * s - k * (q - cell[more] ** 2), 0.0))) / k
        fell = new < t[todo]
        t[todo[fell]] = new[fell]
        news[todo[fell & (new <= stop)]] = True
    return time


_STATE = "vol_id string, b_z int, b_y int, b_x int, lo array<int>, hi array<int>, speed binary, times binary"
_FACE = "vol_id string, b_z int, b_y int, b_x int, axis int, side int, plane binary"
_CELL = ["vol_id", "b_z", "b_y", "b_x"]


def _shape(first: list[int], hi: list[int], block: int) -> list[int]:
    return [min(block, h - f + 1) for f, h in zip(first, hi, strict=True)]


def _pack(block: int):
    """A block's voxels as one row: its speeds as an array; its times with a plane more on each side, for what neighbours send."""

    def run(rows: pa.Table) -> pa.Table:
        lo, hi, cell = [[rows.column(f"{n}_{a}")[0].as_py() for a in "zyx"] for n in ("lo", "hi", "b")]
        first = [a + b * block for a, b in zip(lo, cell, strict=True)]
        data = np.zeros(_shape(first, hi, block))
        data[tuple(rows.column(a).to_numpy() - f for a, f in zip("zyx", first, strict=True))] = rows.column("v").to_numpy()
        own = [rows.column("vol_id")[0].as_py(), *cell, lo, hi, data.tobytes(), np.full([n + 2 for n in data.shape], np.inf).tobytes()]
        return pa.table([pa.array([x], t) for x, t in zip(own, [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()], strict=True)], names=[c.split()[0] for c in _STATE.split(", ")])

    return run


def _advance(block: int, seed: tuple[int, int, int], start: float, stop: float, first_round: bool):
    """A block with the planes that its neighbours sent: the block with its times, and a row for each face whose times fell."""
    columns = [c.split()[0] for c in (_STATE + ", " + _FACE.split("b_x int, ")[1]).split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]

    def run(state: pa.Table, faces: pa.Table) -> pa.Table:
        out = []
        if state.num_rows:
            own = state.to_pylist()[0]
            cell = [own[f"b_{a}"] for a in "zyx"]
            first = [a + b * block for a, b in zip(own["lo"], cell, strict=True)]
            shape = _shape(first, own["hi"], block)
            speed = np.frombuffer(own["speed"]).reshape(shape)
            time = np.frombuffer(own["times"]).reshape([n + 2 for n in shape]).copy()
            before, known = time[1:-1, 1:-1, 1:-1].copy(), time.copy()
            if first_round and all(f <= s < f + n for f, s, n in zip(first, seed, shape, strict=True)):
                time[tuple(s - f + 1 for s, f in zip(seed, first, strict=True))] = start
            for r in faces.to_pylist():
                q = np.moveaxis(time, r["axis"], 0)[0 if r["side"] < 0 else -1, 1:-1, 1:-1]
                q[...] = np.minimum(q, np.frombuffer(r["plane"]).reshape(q.shape))
            with np.errstate(divide="ignore"):
                cost = np.where(speed > 0, 1.0 / speed, np.inf)
            time = march(time, cost, stop, time < known)
            now = time[1:-1, 1:-1, 1:-1]
            key = [own["vol_id"], *cell]
            out.append([*key, own["lo"], own["hi"], own["speed"], time.tobytes(), None, None, None])
            for axis in range(3):
                for side in (-1, 1):
                    at = 0 if side < 0 else -1
                    plane, old = np.moveaxis(now, axis, 0)[at], np.moveaxis(before, axis, 0)[at]
                    there = [b + side if i == axis else b for i, b in enumerate(cell)]
                    inside = own["lo"][axis] <= first[axis] + side * (block if side < 0 else shape[axis]) <= own["hi"][axis]
                    if inside and ((plane < old) & (plane <= stop)).any():
                        out.append([own["vol_id"], *there, None, None, None, None, axis, -side, np.ascontiguousarray(plane).tobytes()])
        cols = zip(*out, strict=True) if out else [[] for _ in columns]
        return pa.table([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=columns)

    return run, _STATE + ", " + _FACE.split("b_x int, ")[1]


def fast_marching(speed: DataFrame, seed: tuple[int, int, int], initial_distance: float = 5.0, stopping: float = 100.0, block: int = 48) -> DataFrame:
    """Arrival times; the trial node has -initial_distance; null where the front has not come by the stopping time.

    Blocks are solved alone; faces whose times fell go to the neighbour, which is solved again, until none falls. A round moves
    face planes and the blocks that got one; the front of all volumes of the relation advances together. Values of one place that differ: any.
    """
    rows = speed.select(*KEYS, F.col("v").cast("double").alias("v")).join(F.broadcast(extents(speed)), "vol_id")
    rows = rows.select("*", *[F.floor((F.col(a) - F.col(f"lo_{a}")) / block).cast("int").alias(f"b_{a}") for a in "zyx"])
    state = cut(rows.groupBy(*_CELL).applyInArrow(_pack(block), _STATE))
    here = reduce(lambda a, b: a & b, [(F.col("lo")[i] + F.col(f"b_{a}") * block <= seed[i]) & (F.col("lo")[i] + (F.col(f"b_{a}") + 1) * block > seed[i]) for i, a in enumerate("zyx")])
    active, faces, count = state.where(here), speed.sparkSession.createDataFrame([], _FACE), 0
    while True:
        run, schema = _advance(block, seed, -initial_distance, stopping, count == 0)
        out = cut(active.groupBy(*_CELL).cogroup(faces.groupBy(*_CELL)).applyInArrow(run, schema))
        done = out.where("speed is not null").select(state.columns)
        state = state.join(done.select(*_CELL), _CELL, "left_anti").unionByName(done)
        faces = out.where("plane is not null").select([c.split()[0] for c in _FACE.split(", ")])
        count += 1
        if faces.isEmpty():
            break
        if count % 8 == 0:
            state = cut(state)
        active = state.join(faces.select(*_CELL).distinct(), _CELL, "left_semi")

    def unpack(batches):
        for b in batches:
            for r in b.to_pylist():
                first = [r["lo"][i] + r[f"b_{a}"] * block for i, a in enumerate("zyx")]
                shape = _shape(first, r["hi"], block)
                t = np.frombuffer(r["times"]).reshape([n + 2 for n in shape])[1:-1, 1:-1, 1:-1].ravel()
                places = np.meshgrid(*[np.arange(f, f + n, dtype=np.int32) for f, n in zip(first, shape, strict=True)], indexing="ij")
                vol = pa.DictionaryArray.from_arrays(pa.array(np.zeros(t.size, np.int32)), pa.array([r["vol_id"]], pa.string())).cast(pa.string())
                yield pa.RecordBatch.from_arrays([vol, *[pa.array(p.ravel()) for p in places], pa.array(t, mask=~(t <= stopping))], names=[*KEYS, "v"])

    return state.mapInArrow(unpack, "vol_id string, z int, y int, x int, v double")


def level_set(vox: DataFrame, seed: tuple[int, int, int], iterations: int, sigma: float, alpha: float, beta: float, stopping: float) -> DataFrame:
    """Diffusion, smoothed gradient, sigmoid speed, front, threshold: the mask (label 255) of 0 <= t <= stopping. The seed's own time is negative."""
    speed = gaussian_gradient(curvature_diffusion(vox, iterations), sigma)
    speed = speed.select(*KEYS, sigmoid(F.col("v"), alpha, beta).alias("v"))
    t = fast_marching(speed, seed, stopping=stopping)
    return t.select(*KEYS, F.when(F.col("v").between(0, stopping), 255).otherwise(0).alias("label"))


def polynomial_log_bias(vox: DataFrame, step: int = 4) -> DataFrame:
    """A quadratic surface fitted to log v on every step-th voxel of v > 0, least squares, centred: a plain stand-in
    for B-spline bias correction. The normal equations are sums, so voxels are aggregated where they lie; ten coefficients a volume are solved."""
    terms = ["1", "z", "y", "x", "z*z", "y*y", "x*x", "z*y", "z*x", "y*x"]
    some = vox.where("v > 0").where(" and ".join(f"pmod({a}, {step}) = 0" for a in "zyx"))
    t = [F.expr(f"cast({e} as double)") for e in terms]
    log = F.log("v")
    sums = some.groupBy("vol_id").agg(F.array(*[F.sum(a * b) for i, a in enumerate(t) for b in t[: i + 1]]).alias("g"), F.array(*[F.sum(a * log) for a in t]).alias("r"))

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for vol, g, r in zip(rows["vol_id"], rows["g"], rows["r"], strict=True):
            n = len(terms)
            full = np.zeros((n, n))
            full[np.tril_indices(n)] = g
            full = full + np.tril(full, -1).T
            out.append((vol, np.linalg.lstsq(full, np.asarray(r, float), rcond=None)[0].tolist()))
        return pd.DataFrame(out, columns=["vol_id", "c"])

    fit = sums.groupBy("vol_id").applyInPandas(solve, "vol_id string, c array<double>")
    value = sum((F.col("c")[i] * t[i] for i in range(len(terms))), F.lit(0.0))
    fitted = vox.join(F.broadcast(fit), "vol_id").select(*KEYS, value.alias("b"))
    mean = fitted.groupBy("vol_id").agg(F.avg("b").alias("mb"))
    return fitted.join(F.broadcast(mean), "vol_id").select(*KEYS, (F.col("b") - F.col("mb")).alias("v"))
