"""Connected regions, morphology, flood fills, watershed.

Components: voxels of a block are labelled together (smallest linear index of the block's part), then only labels that
touch across block faces are linked, and linked labels are resolved by alternating large-star and small-star rounds, of
which a chain of n labels needs about log n. So rounds move labels of block faces, never voxels.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from volspark.operators.blocks import Borders, over_blocks, packed, place_rows, unpacked, with_blocks
from volspark.schema import KEYS
from volspark.session import cut, discard
from volspark.sources.grids import extents


def linear(z="z", y="y", x="x"):
    """A number that orders places by z, y, x: 21 bits an axis, coordinates from -2^20 on."""
    at = lambda c: F.col(c).cast("long") + (1 << 20) if isinstance(c, str) else c.cast("long") + (1 << 20)
    return F.shiftleft(at(z), 42) + F.shiftleft(at(y), 21) + at(x)


#: Edges that one task may resolve; a graph of more takes rounds over all executors.
FEW_EDGES = 200_000


def resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Components of all edges of a task."""
    root: dict = {}

    def own(n):
        root.setdefault(n, n)
        return n

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for b in batches:
        for u, v in zip(b["u"], b["v"], strict=True):
            x, y = find(own(u)), find(own(v))
            if x != y:
                root[max(x, y)] = min(x, y)
    if root:
        yield pd.DataFrame({"node": list(root), "component": [find(n) for n in root]})


def star_components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """node, component (its smallest member) of edges (a, b): at most few of them in one task, else by alternating
    large-star and small-star rounds."""
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if e.count() <= few:
        kind = e.schema["u"].dataType.simpleString()
        return e.coalesce(1).mapInPandas(resolve, f"node {kind}, component {kind}")
    last = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m")
        small = large.join(least, F.col("u") == F.col("n"))
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        old, e = e, cut(small.where("u <> v").distinct())
        discard(old)
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == last or not state[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
        last = state


def label_array(mask: np.ndarray) -> np.ndarray:
    """Smallest flat index of the face-connected part of each set voxel, -1 elsewhere."""
    label = np.where(mask, np.arange(mask.size).reshape(mask.shape), mask.size)
    while True:
        before = label.copy()
        for axis in range(3):
            lo, hi = [slice(None)] * 3, [slice(None)] * 3
            lo[axis], hi[axis] = slice(0, -1), slice(1, None)
            a, b = label[tuple(lo)], label[tuple(hi)]
            both = mask[tuple(lo)] & mask[tuple(hi)]
            m = np.minimum(a, b)
            a[both] = m[both]
            b[both] = np.minimum(b, m)[both]  # b overlaps a
        flat = label.ravel()  # jump to the label of the label
        inside = flat < mask.size
        flat[inside] = flat[flat[inside]]
        label = flat.reshape(mask.shape)
        if np.array_equal(before, label):
            return np.where(mask, label, -1)


_LABELLED = "vol_id string, z int, y int, x int, part long"


def _label_block(rows: pa.Table, block: int) -> pa.Table:
    mask = unpacked(rows, (0, 0, 0), block)
    own = np.nonzero(mask)
    low = [int(p.min()) for p in own]
    mask = mask[tuple(slice(a, int(p.max()) + 1) for a, p in zip(low, own, strict=True))]
    own = [p - a for p, a in zip(own, low, strict=True)]
    base = [rows.column(f"b_{a}")[0].as_py() * block + n for a, n in zip("zyx", low, strict=True)]
    root = np.unravel_index(label_array(mask)[tuple(own)], mask.shape)
    part = sum((r.astype(np.int64) + b + (1 << 20)) << s for r, b, s in zip(root, base, (42, 21, 0), strict=True))
    return place_rows(rows.column("vol_id")[0].as_py(), [o + b for o, b in zip(own, base, strict=True)], part=part)


def components(mask: DataFrame, block: int = 32) -> DataFrame:
    """vol_id, z, y, x, component for the voxels of a mask (vol_id, z, y, x): face-connected; component is the least linear index."""
    parts = cut(packed(mask, (0, 0, 0), block).groupBy("vol_id", "b_z", "b_y", "b_x").applyInArrow(lambda rows: _label_block(rows, block), _LABELLED))
    links = None
    for a in "zyx":
        # the last plane of a block beside the first plane of the next
        near = parts.where(F.pmod(F.col(a), F.lit(block)) == block - 1).withColumn(a, F.col(a) + 1).withColumnRenamed("part", "a")
        far = parts.where(F.pmod(F.col(a), F.lit(block)) == 0).withColumnRenamed("part", "b")
        pairs = near.join(far, KEYS).select("vol_id", "a", "b").distinct()
        links = pairs if links is None else links.unionByName(pairs)
    # parts of different volumes are different nodes
    node = lambda c: F.concat_ws("|", "vol_id", F.lpad(F.col(c).cast("string"), 20, "0"))
    found = star_components(links.select(node("a").alias("a"), node("b").alias("b")))
    # nodes back to volumes and parts: voxels are joined by numbers
    of = found.select(F.expr("substring(node, 1, length(node) - 21)").alias("vol_id"), F.substring_index("node", "|", -1).cast("long").alias("part"), F.substring_index("component", "|", -1).cast("long").alias("root"))
    return parts.join(of, ["vol_id", "part"], "left").select(*KEYS, F.coalesce("root", "part").alias("component"))


def component_sizes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("vol_id", "component").agg(F.count("*").alias("n"))


def keep_components(labelled: DataFrame, least: int = 1, top: int | None = None) -> DataFrame:
    """Voxels of components of at least so many voxels, of these the top largest (ties: the smaller component)."""
    w = Window.partitionBy("vol_id").orderBy(F.desc("n"), "component")
    kept = component_sizes(labelled).where(F.col("n") >= least).withColumn("k", F.row_number().over(w))
    if top is not None:
        kept = kept.where(F.col("k") <= top)
    return labelled.join(kept.select("vol_id", "component"), ["vol_id", "component"], "left_semi").select(*KEYS, "component")


def flood(mask: DataFrame, seed: tuple[int, int, int], block: int = 32) -> DataFrame:
    """Voxels of the mask connected with the seed (z, y, x); none if the seed is not in the mask."""
    labelled = cut(components(mask, block))
    own = labelled.where((F.col("z") == seed[0]) & (F.col("y") == seed[1]) & (F.col("x") == seed[2])).select("vol_id", "component")
    return labelled.join(own, ["vol_id", "component"], "left_semi").select(*KEYS)


def connected_threshold(vox: DataFrame, seed: tuple[int, int, int], lower: float, upper: float) -> DataFrame:
    return flood(vox.where(F.col("v").between(lower, upper)), seed)


def confidence_connected(vox: DataFrame, seed: tuple[int, int, int], multiplier: float = 2.5, rounds: int = 5, radius: int = 1) -> DataFrame:
    """mean +- multiplier std (population) of the cube about the seed, then of the region, so many rounds; then the last region, of
    each volume. The seed's value always counts as inside; a volume without the seed has no region."""
    near = F.lit(True)
    for a, s in zip("zyx", seed, strict=True):
        near = near & F.col(a).between(s - radius, s + radius)
    stats = lambda d: d.groupBy("vol_id").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    at = vox.where((F.col("z") == seed[0]) & (F.col("y") == seed[1]) & (F.col("x") == seed[2])).select("vol_id", F.col("v").alias("own"))
    now, region = stats(vox.where(near)), None
    for i in range(rounds + 1):
        limits = now.join(at, "vol_id").select("vol_id", F.least(F.col("mean") - multiplier * F.col("std"), "own").alias("lo"), F.greatest(F.col("mean") + multiplier * F.col("std"), "own").alias("hi"))
        region = cut(flood(vox.join(F.broadcast(limits), "vol_id").where("v between lo and hi"), seed))
        if i < rounds:
            now = stats(vox.join(region, KEYS, "left_semi"))
    return region


def ball(r: int) -> list[tuple[int, int, int]]:
    return [(z, y, x) for z in range(-r, r + 1) for y in range(-r, r + 1) for x in range(-r, r + 1) if z * z + y * y + x * x <= r * r]


CROSS = [(0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]


def _grown(bounds: DataFrame, by: int) -> DataFrame:
    return bounds.select("vol_id", *[(F.col(f"{n}_{a}") + d).alias(f"{n}_{a}") for a in "zyx" for n, d in (("lo", -by), ("hi", by))])


def _morph(mask: DataFrame, offsets: list[tuple[int, int, int]], bounds: DataFrame, erodes: bool, outside: bool = False, block: int = 32, ring: bool = False) -> DataFrame:
    """Voxels inside bounds of which an offset (erodes: every offset) leads into the mask; outside: whether places out of bounds are of the mask; ring: without the mask itself.
    A voxel goes to the blocks whose halo holds it, not to every offset, and a block's offsets are shifts of its array."""
    halo = tuple(max(abs(o[i]) for o in offsets) for i in range(3))
    block = max(block, *halo)

    def run(rows: pa.Table) -> pa.Table:
        lo, hi, cell = [[rows.column(f"{n}_{a}")[0].as_py() for a in "zyx"] for n in ("lo", "hi", "b")]
        start = [c * block for c in cell]
        first = [max(a, b) for a, b in zip(lo, start, strict=True)]
        size = [min(b + block - 1, h) - f + 1 for b, h, f in zip(start, hi, first, strict=True)]
        data = unpacked(rows, halo, block)
        if outside:
            inner = [np.arange(b - h, b + block + h) for b, h in zip(start, halo, strict=True)]
            free = [(c < lo[i]) | (c > hi[i]) for i, c in enumerate(inner)]
            data |= free[0][:, None, None] | free[1][None, :, None] | free[2][None, None, :]
        out = np.full(size, erodes)
        for o in offsets:
            moved = data[tuple(slice(f - b + h + d, f - b + h + d + n) for f, b, h, d, n in zip(first, start, halo, o, size, strict=True))]
            out = out & moved if erodes else out | moved
        if ring:
            out &= ~data[tuple(slice(f - b + h, f - b + h + n) for f, b, h, n in zip(first, start, halo, size, strict=True))]
        return place_rows(rows.column("vol_id")[0].as_py(), [p + f for p, f in zip(np.nonzero(out), first, strict=True)])

    inside = reduce(lambda p, q: p & q, [(F.col(f"b_{a}") * block <= F.col(f"hi_{a}")) & ((F.col(f"b_{a}") + 1) * block > F.col(f"lo_{a}")) for a in "zyx"])
    rows = packed(mask, halo, block).join(F.broadcast(bounds), "vol_id").where(inside)
    return rows.groupBy("vol_id", "b_z", "b_y", "b_x").applyInArrow(run, "vol_id string, z int, y int, x int")


def dilate(mask: DataFrame, offsets: list[tuple[int, int, int]], bounds: DataFrame) -> DataFrame:
    """The mask's voxels moved by all offsets, inside bounds (of extents())."""
    return _morph(mask, [tuple(-v for v in o) for o in offsets], bounds, erodes=False)


def ring(mask: DataFrame, offsets: list[tuple[int, int, int]], bounds: DataFrame) -> DataFrame:
    """What dilate() adds to the mask."""
    return _morph(mask, [tuple(-v for v in o) for o in offsets], bounds, erodes=False, ring=True)


def erode(mask: DataFrame, offsets: list[tuple[int, int, int]], vox: DataFrame | None = None) -> DataFrame:
    """Voxels all of whose neighbours by offset are in the mask; outside the volume is not, or is, if the (dense) volume is given.
    offsets hold (0, 0, 0)."""
    return _morph(mask, offsets, extents(mask if vox is None else vox), erodes=True, outside=vox is not None)


def closing(mask: DataFrame, offsets: list[tuple[int, int, int]], bounds: DataFrame) -> DataFrame:
    return erode(cut(dilate(mask, offsets, bounds)), offsets)


def safe_closing(mask: DataFrame, offsets: list[tuple[int, int, int]], bounds: DataFrame) -> DataFrame:
    """Closing in a volume with a margin, so that the volume's border erodes nothing."""
    wide = _grown(bounds, max(abs(v) for o in offsets for v in o))
    out = erode(cut(dilate(mask, offsets, wide)), offsets).join(F.broadcast(bounds), "vol_id")
    return out.where(" and ".join(f"{a} between lo_{a} and hi_{a}" for a in "zyx")).select(*KEYS)


def safe_opening(mask: DataFrame, offsets: list[tuple[int, int, int]], vox: DataFrame) -> DataFrame:
    """Opening whose erosion counts what lies outside the volume as set."""
    return dilate(erode(mask, offsets, vox), offsets, extents(vox))


def opening(mask: DataFrame, offsets: list[tuple[int, int, int]], bounds: DataFrame) -> DataFrame:
    return dilate(erode(mask, offsets), offsets, bounds)


def fill_holes(mask: DataFrame, vox: DataFrame) -> DataFrame:
    """The mask and every background part that does not touch the volume's border."""
    outside = vox.select(*KEYS).join(mask, KEYS, "left_anti")
    labelled = cut(components(outside)).join(F.broadcast(extents(vox)), "vol_id")
    border = labelled.where(" or ".join(f"{a} = lo_{a} or {a} = hi_{a}" for a in "zyx")).select("vol_id", "component").distinct()
    return mask.select(*KEYS).unionByName(labelled.join(border, ["vol_id", "component"], "left_anti").select(*KEYS))


def watershed(height: DataFrame, threshold: float = 0.0, level: float = 0.0) -> DataFrame:
    """vol_id, z, y, x, label: basins of steepest descent, merged in order of saliency up to level of the volume's range. Heights under
    threshold (a fraction of the range) rise to it."""
    found = basins(floored(height, threshold) if threshold > 0 else height)
    return found.select(*KEYS, "label") if level <= 0 else merge_levels(found, [level]).select(*KEYS, "label")


def floored(height: DataFrame, threshold: float) -> DataFrame:
    """Heights under a fraction of the volume's range above its minimum rise to it."""
    r = height.groupBy("vol_id").agg(F.min("v").alias("mn"), F.max("v").alias("mx"))
    return height.join(F.broadcast(r), "vol_id").select(*KEYS, F.greatest("v", F.col("mn") + threshold * (F.col("mx") - F.col("mn"))).alias("v"))


def basins(height: DataFrame) -> DataFrame:
    """vol_id, z, y, x, v, label: basins of steepest descent before any are merged.

    Each voxel points to its lowest face neighbour (ties, and plateaus: the lowest linear index, so pointers go down in (height, index) and
    end in minima). A block follows the pointers that stay inside it; those that leave it are resolved by doubling.
    """
    p = cut(over_blocks(height, _descend, (1, 1, 1), "replicate", columns=("v", "tz", "ty", "tx"), placed=True))
    p = p.select(*KEYS, "v", linear().alias("i"), linear(*[F.col(f"t{a}").cast("int") for a in "zyx"]).alias("to"))
    # a voxel's own root is in its block or is the first voxel beyond it, whose root is looked up
    jump = _followed(cut(p.select("vol_id", "i", "to").join(p.select("vol_id", F.col("to").alias("i")).distinct(), ["vol_id", "i"], "left_semi")))
    roots = jump.select("vol_id", F.col("i").alias("to"), F.col("to").alias("label"))
    return cut(p.join(roots, ["vol_id", "to"]).select(*KEYS, "v", "label"))


def _followed(jump: DataFrame) -> DataFrame:
    """Pointers (vol_id, i, to), each place having one, followed to their ends, which point to themselves: by doubling."""
    old = None
    while not jump.where("i <> to").isEmpty():
        nxt = jump.select("vol_id", F.col("i").alias("to"), F.col("to").alias("next"))
        step = cut(jump.join(nxt, ["vol_id", "to"]).select("vol_id", "i", "to", F.col("next")))
        if old is not None:
            discard(old)
        old = step
        done = step.where("to <> next").isEmpty()
        jump = step.select("vol_id", "i", F.col("next").alias("to"))
        if done:
            break
    return jump


def descents(p: np.ndarray, borders: Borders) -> np.ndarray:
    """For each place of an array padded by 1 the flat place where the pointers of the core lead it: a minimum, or the first voxel out of the block."""
    core = tuple(slice(1, -1) for _ in range(3))
    to = np.arange(p.size).reshape(p.shape)
    best, at = np.full(p[core].shape, np.inf), to[core]
    for d in sorted(CROSS):  # by linear index, so that of equals the first stays
        axis = next((i for i, k in enumerate(d) if k), 0)
        moved = tuple(slice(1 + k, n - 1 + k) for k, n in zip(d, p.shape, strict=True))
        take = p[moved] < best
        if borders[axis][0] and d[axis] < 0:
            np.moveaxis(take, axis, 0)[0] = False
        if borders[axis][1] and d[axis] > 0:
            np.moveaxis(take, axis, 0)[-1] = False
        best = np.where(take, p[moved], best)
        at = np.where(take, to[moved], at)
    to[core] = at
    to = to.ravel()
    while True:
        nxt = to[to]
        if np.array_equal(nxt, to):
            return to.reshape(p.shape)
        to = nxt


def _descend(p: np.ndarray, start: tuple[int, int, int], borders: Borders) -> tuple[np.ndarray, ...]:
    """For each core voxel: its height, and where the pointers lead it: a minimum, or the first voxel out of the block."""
    core = tuple(slice(1, -1) for _ in range(3))
    ends = np.unravel_index(descents(p, borders)[core], p.shape)
    return p[core], *[e - 1 + s for e, s in zip(ends, start, strict=True)]


_PASSES = "vol_id string, a long, b long, pass double, floor_a double, floor_b double, oa long, ob long"


def _block_passes(rows: pa.Table) -> pa.Table:
    """The lowest pass between each two basins that meet in a block, or between it and the first plane of the next ones."""
    at = [rows.column(c).to_numpy() for c in "zyx"]
    base = [int(a.min()) for a in at]
    place = tuple(a - b for a, b in zip(at, base, strict=True))
    shape = [int(a.max()) + 1 for a in place]
    label, v = np.full(shape, -1, np.int64), np.full(shape, np.nan)
    label[place], v[place] = rows.column("label").to_numpy(), rows.column("v").to_numpy()
    found = []
    for axis in range(3):
        p, q = (np.moveaxis(label, axis, 0)[k] for k in (slice(0, -1), slice(1, None)))
        h = np.maximum(*(np.moveaxis(v, axis, 0)[k] for k in (slice(0, -1), slice(1, None))))
        meet = (p != q) & (p >= 0) & (q >= 0)
        found.append((np.minimum(p, q)[meet], np.maximum(p, q)[meet], h[meet]))
    a, b, h = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((h, b, a))
    a, b, h = a[order], b[order], h[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    vol = pa.array([rows.column("vol_id")[0].as_py()] * int(first.sum()), pa.string())
    return pa.table({"vol_id": vol, "a": a[first], "b": b[first], "pass": h[first]})


def basin_graph(basin: DataFrame, block: int = 32) -> DataFrame:
    """vol_id, a, b, pass, floor_a, floor_b, oa, ob: for each two basins that share a border the lowest pass over it (the higher of the two
    voxels there) and both floors. A block finds its own passes, so rows of the volume are shuffled once; a < b, and oa, ob are the same."""
    rows = with_blocks(basin.select(*KEYS, "v", "label"), (1, 1, 1), block, extents(basin))
    low = rows.groupBy("vol_id", "b_z", "b_y", "b_x").applyInArrow(_block_passes, "vol_id string, a long, b long, pass double").groupBy("vol_id", "a", "b").agg(F.min("pass").alias("pass"))
    floors = basin.groupBy("vol_id", "label").agg(F.min("v").alias("floor"))
    of = lambda c: floors.select("vol_id", F.col("label").alias(c), F.col("floor").alias(f"floor_{c}"))
    return low.join(of("a"), ["vol_id", "a"]).join(of("b"), ["vol_id", "b"]).select("vol_id", "a", "b", "pass", "floor_a", "floor_b", F.col("a").alias("oa"), F.col("b").alias("ob"))


def _merge_in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The merges of all edges of a task, the lowest pass first: the region of the higher floor ends there."""
    edges = pd.concat([pd.DataFrame(columns=[c.split()[0] for c in _PASSES.split(", ")]), *batches], ignore_index=True)
    floor, root = {}, {}

    def find(n):
        root.setdefault(n, n)
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    out = []
    for r in edges.sort_values(["pass", "oa", "ob"]).itertuples(index=False):
        vol, a, b, height, floor_a, floor_b, oa, ob = r
        floor.setdefault((vol, a), floor_a)
        floor.setdefault((vol, b), floor_b)
        p, q = find((vol, a)), find((vol, b))
        if p != q:
            if (floor[p], p) < (floor[q], q):
                p, q = q, p
            root[p] = q
            out.append((vol, oa, ob, height - floor[p]))
    yield pd.DataFrame(out, columns=["vol_id", "a", "b", "saliency"])


def merge_tree(graph: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """vol_id, a, b, saliency: the merges that make one basin of each connected part of the graph (of basin_graph()), one row for each basin
    that ends. Regions merge in order of saliency, the pass less the higher of the two regions' floors as they are by then, and the merged region
    has the lower floor: the basins of a limit are what the rows of at most that saliency connect. Of equal passes that of the
    smaller labels counts, of equal floors the smaller label is the deeper.

    A region whose lowest pass leads to a deeper one ends at that pass, whatever else merges before: in the order of saliencies, too, no other
    pass could come first. So a round ends all such regions at once, contracts the graph and keeps the lowest pass of each pair,
    until at most few edges are left, which one task merges in order. A graph of few edges takes no round."""
    edges, done = cut(graph), None
    while edges.count() > few:
        flip = lambda d: d.select("vol_id", F.col("b").alias("a"), F.col("a").alias("b"), "pass", F.col("floor_b").alias("floor_a"), F.col("floor_a").alias("floor_b"), "oa", "ob")
        low = edges.unionByName(flip(edges)).groupBy("vol_id", "a").agg(F.min(F.struct("pass", "oa", "ob", "b", "floor_a", "floor_b")).alias("m")).select("vol_id", "a", "m.*")
        ends = F.struct("floor_b", "b") < F.struct("floor_a", "a")
        low = cut(low.select("vol_id", "a", "pass", "oa", "ob", "floor_a", F.when(ends, F.col("b")).otherwise(F.col("a")).alias("to")))
        merged = low.where("a <> to").select("vol_id", F.col("oa").alias("a"), F.col("ob").alias("b"), (F.col("pass") - F.col("floor_a")).alias("saliency"))
        done = merged if done is None else done.unionByName(merged)
        roots = _followed(low.select("vol_id", F.col("a").alias("i"), "to"))
        roots = roots.join(low.select("vol_id", F.col("a").alias("to"), F.col("floor_a").alias("floor")), ["vol_id", "to"])
        of = lambda c: roots.select("vol_id", F.col("i").alias(c), F.col("to").alias(f"r{c}"), F.col("floor").alias(f"f{c}"))
        moved = edges.select("vol_id", "a", "b", "pass", "oa", "ob").join(of("a"), ["vol_id", "a"]).join(of("b"), ["vol_id", "b"]).where("ra <> rb")
        one = moved.select("vol_id", F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"), "pass", "oa", "ob", F.when(F.col("ra") < F.col("rb"), F.col("fa")).otherwise(F.col("fb")).alias("floor_a"), F.when(F.col("ra") < F.col("rb"), F.col("fb")).otherwise(F.col("fa")).alias("floor_b"))
        edges = cut(one.groupBy("vol_id", "a", "b").agg(F.min(F.struct("pass", "oa", "ob", "floor_a", "floor_b")).alias("m")).select("vol_id", "a", "b", "m.pass", "m.floor_a", "m.floor_b", "m.oa", "m.ob"))
    last = edges.coalesce(1).mapInPandas(_merge_in_order, "vol_id string, a long, b long, saliency double")
    return last if done is None else done.unionByName(last)


def merged_labels(basin: DataFrame, levels: list[float], few: int = FEW_EDGES) -> DataFrame:
    """vol_id, basin, level, label for each level: the label of each basin in the merge tree, cut at a fraction of the volume's range: the least of the merged."""
    span = basin.groupBy("vol_id").agg((F.max("v") - F.min("v")).alias("range"))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.lit(float(x)).alias("level")) for i, x in enumerate(levels)])).alias("l")
    shallow = merge_tree(basin_graph(basin), few).join(F.broadcast(span), "vol_id").select("*", each).where("saliency <= range * l.level")
    node = lambda c, k: F.concat_ws("|", "vol_id", k, F.lpad(F.col(c).cast("string"), 20, "0"))
    merged = star_components(shallow.select(node("a", F.col("l.k")).alias("a"), node("b", F.col("l.k")).alias("b")), few)
    named = basin.select("vol_id", F.col("label").alias("basin")).distinct().select("vol_id", "basin", each).select("vol_id", "basin", "l.level", node("basin", F.col("l.k")).alias("own"))
    label = F.coalesce(F.substring_index("component", "|", -1).cast("long"), F.col("basin")).alias("label")
    return named.join(merged, F.col("own") == F.col("node"), "left").select("vol_id", "basin", "level", label)


def merge_levels(basin: DataFrame, levels: list[float], few: int = FEW_EDGES) -> DataFrame:
    """level, vol_id, z, y, x, label for each level, of merged_labels()."""
    return basin.select(*KEYS, F.col("label").alias("basin")).join(merged_labels(basin, levels, few), ["vol_id", "basin"]).select("level", *KEYS, "label")
