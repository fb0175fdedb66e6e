"""Watersheds by number: how many basins each level leaves, without a label a voxel.

Regions merge pass after pass, the lowest first, and the one of the higher floor ends there; its saliency is the pass less its floor. Each
basin but one of a connected volume ends once, so a level leaves as many basins as there are, less the saliencies up to it. Of
equal passes or floors the order decides which names meet, not which saliencies there are: how many regions there are below a height does not depend on it.

A block merges what it knows whole: a region that lies inside it ends at its lowest pass, if what is beyond is at least as deep,
whatever else is there. Left are the regions at faces to other blocks, the few inside whose end depends on these, and the
passes between them that close no ring. Boxes of blocks go on with those, then boxes of boxes, until one holds the volume. So voxels
are met once, and a task holds the faces of a box.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volspark.operators.blocks import Chunks, chunk_ranges, padded, sent_chunks
from volspark.operators.regions import descents
from volspark.session import cut

_AXES, _SHIFTS, _ZERO = ["b_z", "b_y", "b_x"], (42, 21, 0), 1 << 20
#: What a box leaves: n voxels, basins found, ended (by level) the saliencies up to it; passes between regions a and b; the floor of each region named (of one that
#: is a voxel of another box: that voxel's height, which its floor is at most); places at faces to other boxes, and the region of each.
_LONGS, _DOUBLES = ("a", "b", "node", "place", "region"), ("pass", "floor")
_LEFT = "vol_id string, run int, b_z int, b_y int, b_x int, lo array<int>, hi array<int>, limits array<double>, n long, basins long, ended array<long>, " + ", ".join(f"{c} binary" for c in (*_LONGS, *_DOUBLES))
#: Boxes that a box of the next size holds.
_JOINED = 8


def _left_row(keys: dict, cell: list[int], n: int, basins: int, ended: np.ndarray, arrays: dict[str, np.ndarray]) -> pa.Table:
    box, numbers = pa.list_(pa.int32()), {"lo": keys["lo"], "hi": keys["hi"]}
    one = {"vol_id": pa.array([keys["vol_id"]], pa.string()), "run": pa.array([keys["run"]], pa.int32()), **{c: pa.array([int(k)], pa.int32()) for c, k in zip(_AXES, cell, strict=True)}}
    one |= {c: pa.array([x], box) for c, x in numbers.items()} | {"limits": pa.array([keys["limits"]], pa.list_(pa.float64()))}
    one |= {"n": pa.array([n], pa.int64()), "basins": pa.array([basins], pa.int64()), "ended": pa.array([[int(k) for k in ended]], pa.list_(pa.int64()))}
    one |= {c: pa.array([np.ascontiguousarray(arrays[c], np.int64).tobytes()], pa.binary()) for c in _LONGS}
    return pa.table(one | {c: pa.array([np.ascontiguousarray(arrays[c], np.float64).tobytes()], pa.binary()) for c in _DOUBLES})


def _merged(a: np.ndarray, b: np.ndarray, height: np.ndarray, floor: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(saliencies, left) of the passes between nodes a and b in order of height: saliencies of the regions that end, and rows (a, b,
    height) of passes whose outcome depends on others. whole: nodes all of whose passes are here. A region's root is its deepest node."""
    root, floors, known = list(range(len(floor))), floor.tolist(), whole.tolist()
    ended, left = [], []
    for x, y, h in zip(a.tolist(), b.tolist(), height.tolist(), strict=True):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        while root[y] != y:
            root[y] = root[root[y]]
            y = root[y]
        if x == y:
            continue
        if floors[x] < floors[y] or (floors[x] == floors[y] and not known[x]):
            x, y = y, x
        if known[x]:
            ended.append(h - floors[x])
        else:
            left.append((x, y, h))
            known[y] = False
        root[x] = y
    return np.array(ended), np.array(left).reshape(-1, 3)


def _settled(keys: dict, cell: list[int], n: int, basins: int, ended: np.ndarray, edges: tuple[np.ndarray, ...], names: np.ndarray, floor: np.ndarray, whole: np.ndarray, places: np.ndarray, region: np.ndarray) -> pa.Table:
    """What a box leaves of its passes (a, b, height) between nodes, the places at its faces and their nodes."""
    a, b, height = edges
    order = np.argsort(height, kind="stable")
    saliency, left = _merged(a[order], b[order], height[order], floor, whole)
    ended = ended + [int((saliency <= x).sum()) for x in keys["limits"]]
    p, q = left[:, 0].astype(np.int64), left[:, 1].astype(np.int64)
    used = np.unique(np.concatenate([p, q, region]))
    arrays = {"a": names[p], "b": names[q], "pass": left[:, 2], "node": names[used], "floor": floor[used], "place": places, "region": names[region]}
    return _left_row(keys, cell, n, basins, ended, arrays)


def _in_block(block: int, origin: list[int], thresholds: list[float], levels: list[float]) -> Callable[[pa.Table], pa.Table]:
    core = (slice(1, -1),) * 3

    def run(rows: pa.Table) -> pa.Table:
        cell, first, data, borders = padded(rows, (1, 1, 1), "replicate", block)
        mn, mx = (np.nan if (m := rows.column(c)[0].as_py()) is None else m for c in ("mn", "mx"))
        keys = {c: rows.column(c)[0].as_py() for c in ("vol_id", "lo", "hi")}
        number = sum((np.arange(f - 1, f - 1 + k, dtype=np.int64) + _ZERO << s).reshape([-1 if i == j else 1 for j in range(3)]) for i, (f, k, s) in enumerate(zip(first, data.shape, _SHIFTS, strict=True))).ravel()
        there = ~np.isnan(data)
        beside = np.zeros(data.shape, bool)  # core places at faces to other blocks
        for axis, sides in enumerate(borders):
            for side, at in zip(sides, (1, -2), strict=True):
                if not side:
                    np.moveaxis(beside, axis, 0)[at] = True
        inside = np.zeros(data.shape, bool)
        inside[core] = True
        beside &= inside & there
        out = []
        for k, t in enumerate(thresholds):
            low = max(mn, mn + t * (mx - mn))
            p = np.maximum(data, low)
            to = descents(p, borders)
            found = []
            for axis, (_, behind) in enumerate(borders):
                # pairs of the core, and of the core and the next block
                near = [slice(1, -1)] * 3
                far = list(near)
                near[axis], far[axis] = (slice(1, -2), slice(2, -1)) if behind else (slice(1, -1), slice(2, None))
                near, far = tuple(near), tuple(far)
                meet = (to[near] != to[far]) & there[near] & there[far]
                found.append((to[near][meet], to[far][meet], np.maximum(p[near], p[far])[meet]))
            a, b, height = (np.concatenate(x) for x in zip(*found, strict=True))
            pair = np.minimum(a, b) * p.size + np.maximum(a, b)
            order = np.lexsort((height, pair))
            order = order[np.diff(pair[order], prepend=-1) != 0]
            minima = (to == np.arange(p.size).reshape(p.shape)) & inside & there
            flat, index = np.unique(np.concatenate([a[order], b[order], to[beside]]), return_inverse=True)
            whole = inside.ravel()[flat]
            ends = index[2 * len(order) :]
            whole[ends] = False
            keys |= {"run": k, "limits": [(mx - low) * x for x in levels]}
            edges = (index[: len(order)], index[len(order) : 2 * len(order)], height[order])
            out.append(_settled(keys, [c - o for c, o in zip(cell, origin, strict=True)], int((inside & there).sum()), int(minima.sum()), np.zeros(len(levels), int), edges, number[flat], p.ravel()[flat], whole, number[beside.ravel()], ends))
        return pa.concat_tables(out)

    return run


def _ends(place: np.ndarray, region: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted places and the regions that they lead to in the end, of regions that may be places themselves."""
    order = np.argsort(place)
    place, region = place[order], region[order]
    while len(place):
        nxt = _renamed(region, place, region)
        if np.array_equal(nxt, region):
            break
        region = nxt
    return place, region


def _renamed(x: np.ndarray, place: np.ndarray, region: np.ndarray) -> np.ndarray:
    if not len(place):
        return x
    at = np.minimum(np.searchsorted(place, x), len(place) - 1)
    return np.where(place[at] == x, region[at], x)


def _in_box(width: list[int], base: list[int]) -> Callable[[pa.Table], pa.Table]:
    """Goes on with what the boxes in a box of so many voxels (boxes begin at base) left."""

    def run(rows: pa.Table) -> pa.Table:
        keys = {c: rows.column(c)[0].as_py() for c in ("vol_id", "run", "lo", "hi", "limits")}
        cell = [rows.column(c)[0].as_py() for c in _AXES]
        x = {c: np.frombuffer(b"".join(rows.column(c).to_pylist()), np.int64 if c in _LONGS else np.float64) for c in (*_LONGS, *_DOUBLES)}
        first = [b + c * w for b, c, w in zip(base, cell, width, strict=True)]
        last = [f + w - 1 for f, w in zip(first, width, strict=True)]
        axis = lambda ids, s: (ids >> s & (1 << 21) - 1) - _ZERO
        place, region = _ends(x["place"], x["region"])
        beside = np.zeros(len(place), bool)
        for f, t, lo, hi, s in zip(first, last, keys["lo"], keys["hi"], _SHIFTS, strict=True):
            c = axis(place, s)
            beside |= ((c == f) & (f > lo)) | ((c == t) & (t < hi))
        a, b, node = (_renamed(x[c], place, region) for c in ("a", "b", "node"))
        place, region = place[beside], region[beside]
        names, at = np.unique(node, return_inverse=True)
        floor = np.full(len(names), np.inf)
        np.minimum.at(floor, at, x["floor"])
        whole = np.ones(len(names), bool)
        for f, t, s in zip(first, last, _SHIFTS, strict=True):
            c = axis(names, s)
            whole &= (c >= f) & (c <= t)
        a, b, ends = (np.searchsorted(names, k) for k in (a, b, region))
        whole[ends] = False
        ended = np.array(rows.column("ended").to_pylist()).sum(axis=0)
        n, basins = (sum(rows.column(c).to_pylist()) for c in ("n", "basins"))
        return _settled(keys, cell, n, basins, ended, (a, b, x["pass"]), names, floor, whole, place, ends)

    return run


def basin_counts(height: Chunks, thresholds: list[float], levels: list[float]) -> DataFrame:
    """vol_id, run, level, basins, n: of each threshold (run: its number; heights under this fraction of the range rise to it) and level (a fraction of the range
    that is left) the basins of watershed() and the voxels. Missing voxels take no part."""
    block = height.block
    lo, hi = height.bounds.agg(*[F.array(*[f(F.floor(F.col(c)[i] / block)) for i in range(3)]) for f, c in ((F.min, "lo"), (F.max, "hi"))]).first()
    if lo is None or lo[0] is None:
        lo = hi = [0, 0, 0]
    rows = sent_chunks(height, (1, 1, 1)).join(F.broadcast(chunk_ranges(height)), "vol_id")
    left = cut(rows.groupBy("vol_id", *_AXES).applyInArrow(_in_block(block, lo, thresholds, levels), _LEFT))
    cells, width = [b - a + 1 for a, b in zip(lo, hi, strict=True)], [block] * 3
    while max(cells) > 1:
        by = [1, 1, 1]
        while np.prod(by) < _JOINED and max(cells) > 1:
            i = int(np.argmax(cells))
            by[i], cells[i], width[i] = 2 * by[i], -(-cells[i] // 2), 2 * width[i]
        wider = left.select("vol_id", "run", *[F.floor(F.col(c) / k).cast("int").alias(c) for c, k in zip(_AXES, by, strict=True)], *[c for c in left.columns if c not in ("vol_id", "run", *_AXES)])
        left = wider.groupBy("vol_id", "run", *_AXES).applyInArrow(_in_box(list(width), [c * block for c in lo]), _LEFT)
    each = F.explode(F.arrays_zip(F.array(*map(F.lit, levels)).alias("level"), F.col("ended").alias("ended"))).alias("l")
    return cut(left.select("vol_id", "run", "basins", "n", each).select("vol_id", "run", F.col("l.level").alias("level"), (F.col("basins") - F.col("l.ended")).alias("basins"), "n"))
