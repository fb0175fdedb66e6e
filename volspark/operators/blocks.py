"""Neighbourhood kernels over blocks with a halo.

Between kernels a volume is a relation of chunks, dense boxes on a grid of blocks, as arrays in binary columns. A chunk goes to its
own block, and the planes in a neighbour's halo to that one; a group is one block with its halo, so a
task holds (block + 2 halo)^3 values whatever the volume's size, and one shuffle serves any window and any number of
result columns. Windows at a volume's border read mirrored or replicated places, which lie inside the block and its halo. Rows
of voxels are made at the end.

The grid must be dense; a missing voxel is NaN for the kernel. Rows of one place that differ: the last wins.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volspark.schema import BOUNDARIES
from volspark.session import cut
from volspark.sources.grids import extents

#: Of a padded array (and, if asked for, of its volume borders) the result, or a tuple of results, of its core.
Kernel = Callable[..., "np.ndarray | tuple[np.ndarray, ...]"]
#: For each axis, how many planes of the padding before and behind the core lie outside the volume.
Borders = list[tuple[int, int]]


def mirrored(i: np.ndarray, lo: int, hi: int, boundary: str) -> np.ndarray:
    """Places i on an axis lo..hi, those outside mapped back inside."""
    n = hi - lo + 1
    i = i - lo
    if boundary == "replicate" or n == 1:
        return np.clip(i, 0, n - 1) + lo
    period = 2 * (n - 1) if boundary == "reflect" else 2 * n
    i = np.mod(i, period)
    return np.where(i < n, i, (period if boundary == "reflect" else period - 1) - i) + lo


def replicated(p: np.ndarray, cut: int, borders: Borders) -> np.ndarray:
    """p, from whose sides cut planes are gone already, with the planes that lie outside the volume made equal to the volume's edge."""
    for axis, sides in enumerate(borders):
        q = np.moveaxis(p, axis, 0)
        before, behind = (max(0, n - cut) for n in sides)
        if before:
            q[:before] = q[before]
        if behind:
            q[len(q) - behind :] = q[len(q) - behind - 1]
    return p


def with_blocks(vox: DataFrame, halo: tuple[int, int, int], block: int, bounds: DataFrame | None = None) -> DataFrame:
    """Rows with b_z, b_y, b_x of each block that needs them, and their volume's bounds."""
    out = vox.join(F.broadcast(extents(vox) if bounds is None else bounds), "vol_id")
    for a, h in zip("zyx", halo, strict=True):
        lo, hi, c = F.col(f"lo_{a}"), F.col(f"hi_{a}"), F.col(a)
        first = F.floor((F.greatest(lo, c - h) - lo) / block).cast("int")
        last = F.floor((F.least(hi, c + h) - lo) / block).cast("int")
        out = out.withColumn(f"b_{a}", F.explode(F.sequence(first, last)) if h else first)
    return out


def packed(places: DataFrame, halo: tuple[int, int, int], block: int) -> DataFrame:
    """vol_id, b_z, b_y, b_x, at: places of a mask by block (on the grid that starts at 0, 0, 0), a place going to all blocks in whose halo it lies. at
    holds places in the padded block, flat, as int32. A task hands on places of a block together, so that rows are few and no voxel is sorted."""
    wide = [block + 2 * h for h in halo]
    steps = (wide[1] * wide[2], wide[2], 1)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= _GATHER:
                yield from pieces(held)
                held, n = [], 0
        if n:
            yield from pieces(held)

    def pieces(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        names = pa.compute.dictionary_encode(rows.column("vol_id").combine_chunks())
        names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
        code = names.indices.fill_null(len(names.dictionary)).to_numpy().astype(np.int64)
        at = [rows.column(a).to_numpy().astype(np.int64) for a in "zyx"]
        own = [a // block for a in at]
        inner = [a - c * block for a, c in zip(at, own, strict=True)]
        some = []
        for shift in itertools.product(*[(-1, 0, 1) if h else (0,) for h in halo]):
            near = np.ones(len(code), bool)
            for s, i, h in zip(shift, inner, halo, strict=True):
                near &= i < h if s < 0 else i >= block - h if s > 0 else True
            if len(k := np.flatnonzero(near)):
                some.append((k, [c[k] + s for c, s in zip(own, shift, strict=True)], sum((i[k] - s * block + h) * n for i, s, h, n in zip(inner, shift, halo, steps, strict=True))))
        which, flat = np.concatenate([k for k, _, _ in some]), np.concatenate([f for _, _, f in some]).astype(np.int32)
        cell = [np.concatenate([c[i] for _, c, _ in some]) for i in range(3)]
        order = np.lexsort((*cell[::-1], code[which]))
        keys = np.stack((code[which], *cell))[:, order]
        first = np.flatnonzero(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(axis=0))))
        flat, ends = flat[order], np.append(first[1:], len(order))
        vols = rows.column("vol_id").combine_chunks().take(pa.array(which[order][first]))
        vols = vols.combine_chunks() if isinstance(vols, pa.ChunkedArray) else vols
        yield pa.RecordBatch.from_arrays([vols, *[pa.array(k[first], pa.int32()) for k in keys[1:]], pa.array([flat[i:j].tobytes() for i, j in zip(first.tolist(), ends.tolist(), strict=True)], pa.binary())], names=[*_CELL, "at"])

    return places.select("vol_id", *[F.col(a).cast("int").alias(a) for a in "zyx"]).mapInArrow(gather, "vol_id string, b_z int, b_y int, b_x int, at binary")


def unpacked(rows: pa.Table, halo: tuple[int, int, int], block: int) -> np.ndarray:
    """The mask of a padded block from the rows of packed()."""
    mask = np.zeros([block + 2 * h for h in halo], bool)
    for x in rows.column("at").to_pylist():
        mask.reshape(-1)[np.frombuffer(x, np.int32)] = True
    return mask


def place_rows(vol: str, places: list[np.ndarray], **more: np.ndarray) -> pa.Table:
    """A row a place of a volume."""
    vols = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(places[0]), np.int32)), pa.array([vol], pa.string())).cast(pa.string())
    return pa.table({"vol_id": vols, **{a: pa.array(p.astype(np.int32)) for a, p in zip("zyx", places, strict=True)}, **{k: pa.array(x) for k, x in more.items()}})


CHUNK = "vol_id string, b_z int, b_y int, b_x int, first array<int>, size array<int>"
_CELL = ["vol_id", "b_z", "b_y", "b_x"]
_BOX = pa.list_(pa.int32())
#: Voxels that a task gathers before it hands them on by block.
_GATHER = 1 << 19


@dataclass
class Chunks:
    """Volumes as rows of dense boxes, for kernels after each other: vol_id, b_z, b_y, b_x (the box's place on the grid of blocks that starts at 0,
    0, 0), first (its least z, y, x), size, and a column of float64 values in that order for each of columns. bounds: a row a volume, lo and hi."""

    data: DataFrame
    bounds: DataFrame
    block: int
    columns: tuple[str, ...] = ("v",)


def chunked(vox: DataFrame, block: int = 32) -> Chunks:
    """Voxels go to their block by task: a task hands on places and values of a block together, so a block comes in few rows and its voxels
    are neither sorted nor written as rows. The chunks are cut, so what made vox runs once."""
    at_type, value_type = pa.binary(), pa.binary()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= _GATHER:
                yield pieces(held)
                held = []
        if held:
            yield pieces(held)

    def pieces(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        names = pa.compute.dictionary_encode(rows.column("vol_id").combine_chunks())
        names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
        code = names.indices.fill_null(len(names.dictionary)).to_numpy().astype(np.int64)
        at = [rows.column(a).to_numpy() for a in "zyx"]
        cell = [a // block for a in at]
        key = code
        for c in cell:
            key = key * (int(c.max(initial=0)) - int(c.min(initial=0)) + 1) + c - int(c.min(initial=0))
        order = np.argsort(key, kind="stable")
        inner = sum((a - c * block).astype(np.int32) * np.int32(block**k) for a, c, k in zip(at, cell, (2, 1, 0), strict=True))[order]
        v = rows.column("v").to_numpy(zero_copy_only=False).astype(np.float64)[order]
        key = key[order]
        cuts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)])) if len(key) else np.zeros(1, int)
        first = order[cuts[:-1]]
        ends = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        vols = rows.column("vol_id").take(pa.array(first)).combine_chunks()
        vols = vols.combine_chunks() if isinstance(vols, pa.ChunkedArray) else vols
        return pa.RecordBatch.from_arrays([vols, *[pa.array(c[first], pa.int32()) for c in cell], pa.array([inner[i:j].tobytes() for i, j in ends], at_type), pa.array([v[i:j].tobytes() for i, j in ends], value_type)], names=[*_CELL, "at", "v"])

    def assemble(rows: pa.Table) -> pa.Table:
        at = np.frombuffer(b"".join(rows.column("at").to_pylist()), np.int32)
        place = np.unravel_index(at, (block,) * 3)
        lo, hi = [int(p.min()) for p in place], [int(p.max()) for p in place]
        box = np.full([h - a + 1 for a, h in zip(lo, hi, strict=True)], np.nan)
        box[tuple(p - a for p, a in zip(place, lo, strict=True))] = np.frombuffer(b"".join(rows.column("v").to_pylist()), np.float64)
        cell = [rows.column(c)[0].as_py() for c in _CELL[1:]]
        return chunk_row(rows.column("vol_id")[0].as_py(), cell, [c * block + a for c, a in zip(cell, lo, strict=True)], [("v", box)])

    some = vox.select("vol_id", "z", "y", "x", F.col("v").cast("double").alias("v")).mapInArrow(gather, "vol_id string, b_z int, b_y int, b_x int, at binary, v binary")
    data = cut(some.groupBy(*_CELL).applyInArrow(assemble, f"{CHUNK}, v binary"))
    return Chunks(data, _bounds(data), block)


def _bounds(data: DataFrame) -> DataFrame:
    lo = [F.min(F.col("first")[i]) for i in range(3)]
    hi = [F.max(F.col("first")[i] + F.col("size")[i] - 1) for i in range(3)]
    return data.groupBy("vol_id").agg(F.array(*lo).alias("lo"), F.array(*hi).alias("hi"))


def chunk_row(vol: str, cell: list[int], first: list[int], values: list[tuple[str, np.ndarray]]) -> pa.Table:
    one = {"vol_id": pa.array([vol], pa.string()), **{c: pa.array([k], pa.int32()) for c, k in zip(_CELL[1:], cell, strict=True)}}
    one |= {"first": pa.array([first], _BOX), "size": pa.array([values[0][1].shape], _BOX)}
    return pa.table(one | {c: pa.array([np.ascontiguousarray(x, np.float64).tobytes()], pa.binary()) for c, x in values})


def _box(row: dict, column: str) -> np.ndarray:
    return np.frombuffer(row[column], np.float64).reshape(row["size"])


def _sent(block: int, halo: tuple[int, int, int], column: str):
    """What each block needs of a chunk: its own all, its neighbours the planes in their halo."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                box, first = _box(row, column), row["first"]
                last = [f + n - 1 for f, n in zip(first, row["size"], strict=True)]
                ranges = [range(max(lo, f - h) // block, min(hi, t + h) // block + 1) for lo, hi, f, t, h in zip(row["lo"], row["hi"], first, last, halo, strict=True)]
                out = []
                for cell in itertools.product(*ranges):
                    lo = [max(f, c * block - h) for f, c, h in zip(first, cell, halo, strict=True)]
                    hi = [min(t, c * block + block - 1 + h) for t, c, h in zip(last, cell, halo, strict=True)]
                    if all(a <= z for a, z in zip(lo, hi, strict=True)):
                        out.append((cell, lo, box[tuple(slice(a - f, z - f + 1) for a, z, f in zip(lo, hi, first, strict=True))]))
                n = len(out)
                arrays = [pa.array([row["vol_id"]] * n, pa.string()), *[pa.array([c[i] for c, _, _ in out], pa.int32()) for i in range(3)], pa.array([f for _, f, _ in out], _BOX), pa.array([x.shape for _, _, x in out], _BOX), pa.array([np.ascontiguousarray(x).tobytes() for _, _, x in out], pa.binary()), pa.array([row["lo"]] * n, _BOX), pa.array([row["hi"]] * n, _BOX)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*_CELL, "first", "size", "v", "lo", "hi"])

    return run


def padded(rows: pa.Table, halo: tuple[int, int, int], boundary: str, block: int) -> tuple[list[int], list[int], np.ndarray, Borders]:
    """Of what was sent to a block: its place on the grid of blocks, its least z, y, x, its array with the halo, and which padding lies outside the volume."""
    pieces = rows.to_pylist()
    lo, hi, cell = pieces[0]["lo"], pieces[0]["hi"], [pieces[0][c] for c in _CELL[1:]]
    first = [max(lo[i], cell[i] * block) for i in range(3)]
    last = [min(cell[i] * block + block - 1, hi[i]) for i in range(3)]
    base = [max(lo[i], first[i] - halo[i]) for i in range(3)]
    shape = [min(hi[i], last[i] + halo[i]) - base[i] + 1 for i in range(3)]
    data = np.full(shape, np.nan)
    for r in pieces:
        data[tuple(slice(f - b, f - b + n) for f, b, n in zip(r["first"], base, r["size"], strict=True))] = _box(r, "v")
    if any(halo):
        index = [np.clip(mirrored(np.arange(first[i] - halo[i], last[i] + halo[i] + 1), lo[i], hi[i], boundary) - base[i], 0, shape[i] - 1) for i in range(3)]
        data = data[np.ix_(*index)]
    return cell, first, data, [(max(0, halo[i] - (first[i] - lo[i])), max(0, halo[i] - (hi[i] - last[i]))) for i in range(3)]


def _run(kernel: Kernel, halo: tuple[int, int, int], boundary: str, block: int, columns: tuple[str, ...], bordered: bool, placed: bool):
    def run(rows: pa.Table) -> pa.Table:
        cell, first, data, borders = padded(rows, halo, boundary, block)
        out = kernel(data, *([tuple(first)] if placed else []), *([borders] if bordered or placed else []))
        return chunk_row(rows.column("vol_id")[0].as_py(), cell, first, list(zip(columns, out if isinstance(out, tuple) else (out,), strict=True)))

    return run


def sent_chunks(chunks: Chunks, halo: tuple[int, int, int]) -> DataFrame:
    """The first column of chunks, v, by the blocks that need it: their own and those in whose halo it lies; with their volume's lo and hi."""
    if max(halo) > chunks.block:
        raise ValueError("a halo is at most a block wide")
    own = chunks.data.select(*_CELL, "first", "size", chunks.columns[0]).join(F.broadcast(chunks.bounds), "vol_id")
    return own.mapInArrow(_sent(chunks.block, halo, chunks.columns[0]), f"{CHUNK}, v binary, lo array<int>, hi array<int>")


def over_chunks(chunks: Chunks, kernel: Kernel, halo: tuple[int, int, int], boundary: str = "replicate", columns: tuple[str, ...] = ("v",), bordered: bool = False, placed: bool = False) -> Chunks:
    """over_blocks() of the first column of chunks, to chunks: between kernels go the chunks and the planes in their neighbours' halo, as arrays.
    No halo is wider than a block. A block whose voxels are all missing stays so."""
    if boundary not in BOUNDARIES:
        raise ValueError(f"boundary is one of {BOUNDARIES}")
    schema = f"{CHUNK}, " + ", ".join(f"{c} binary" for c in columns)
    data = sent_chunks(chunks, halo).groupBy(*_CELL).applyInArrow(_run(kernel, halo, boundary, chunks.block, columns, bordered, placed), schema)
    return Chunks(data, chunks.bounds, chunks.block, columns)


def along_axis(chunks: Chunks, axis: int, f: Callable[..., tuple[np.ndarray, ...]], columns: tuple[str, ...]) -> Chunks:
    """f of all columns over whole lines of an axis (which comes first in its arrays), to columns: chunks behind each other meet in a task, which holds
    (length of the axis x block^2) values of each column, whatever the other axes' length."""
    names, b = chunks.columns, [c for i, c in enumerate(_CELL[1:]) if i != axis]
    cells = _CELL[1:]

    def run(rows: pa.Table) -> pa.Table:
        held = sorted(rows.to_pylist(), key=lambda r: r[cells[axis]])
        lines = [np.moveaxis(np.concatenate([_box(r, c) for r in held], axis=axis), axis, 0) for c in names]
        out, at, made = [np.moveaxis(x, 0, axis) for x in f(*lines)], 0, []
        for r in held:
            part = tuple(slice(at, at + r["size"][axis]) if i == axis else slice(None) for i in range(3))
            at += r["size"][axis]
            made.append(chunk_row(r["vol_id"], [r[c] for c in cells], r["first"], [(c, x[part]) for c, x in zip(columns, out, strict=True)]))
        return pa.concat_tables(made)

    data = chunks.data.select(*_CELL, "first", "size", *names).groupBy("vol_id", *b).applyInArrow(run, f"{CHUNK}, " + ", ".join(f"{c} binary" for c in columns))
    return Chunks(data, chunks.bounds, chunks.block, columns)


def on_chunks(chunks: Chunks, f: Callable[..., np.ndarray], by: DataFrame | None = None) -> Chunks:
    """f of the arrays of all columns of a chunk, in place, to one column v; by: more arguments for f, a row of numbers a volume (volumes without one go)."""
    columns = chunks.columns
    more = [c for c in by.columns if c != "vol_id"] if by is not None else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                out = f(*[_box(row, c) for c in columns], *[row[c] for c in more])
                yield from chunk_row(row["vol_id"], [row[c] for c in _CELL[1:]], row["first"], [("v", out)]).to_batches()

    data = chunks.data.join(F.broadcast(by), "vol_id") if by is not None else chunks.data
    return Chunks(data.mapInArrow(run, f"{CHUNK}, v binary"), chunks.bounds, chunks.block)


def chunk_means(chunks: Chunks, column: str) -> DataFrame:
    """vol_id and mean of a column of chunks; missing voxels do not count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [np.frombuffer(x, np.float64) for x in b.column(1).to_pylist()]
            arrays = [b.column(0), pa.array([float(np.nansum(x)) for x in values]), pa.array([int((~np.isnan(x)).sum()) for x in values], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["vol_id", "s", "n"])

    return chunks.data.select("vol_id", column).mapInArrow(run, "vol_id string, s double, n long").groupBy("vol_id").agg((F.sum("s") / F.sum("n")).alias("mean"))


def chunk_ranges(chunks: Chunks) -> DataFrame:
    """vol_id, mn and mx of the first column of chunks; missing voxels do not count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [x[~np.isnan(x)] for x in (np.frombuffer(v, np.float64) for v in b.column(1).to_pylist())]
            ends = [pa.array([float(f(x)) if len(x) else None for x in values], pa.float64()) for f in (np.min, np.max)]
            yield pa.RecordBatch.from_arrays([b.column(0), *ends], names=["vol_id", "mn", "mx"])

    return chunks.data.select("vol_id", chunks.columns[0]).mapInArrow(run, "vol_id string, mn double, mx double").groupBy("vol_id").agg(F.min("mn").alias("mn"), F.max("mx").alias("mx"))


def chunk_errors(reference: Chunks, other: Chunks) -> DataFrame:
    """mse_psnr() of chunks on the same grid of blocks, whose voxels need not be joined one by one. The volumes of other are named vol_id#run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, x, y, same in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                if not same:
                    rows.append((name, 0, 0, -1, 0.0, None))
                    continue
                v, w = np.frombuffer(x, np.float64), np.frombuffer(y, np.float64)
                there, both = ~np.isnan(v), ~np.isnan(v) & ~np.isnan(w)
                rows.append((name, int(there.sum()), int((~np.isnan(w)).sum()), int(both.sum()), float(((v - w)[both] ** 2).sum()), float(v[both].max()) if both.any() else None))
            yield pa.RecordBatch.from_pylist([dict(zip(("vol_id", "n_a", "n_b", "n", "s", "top"), r, strict=True)) for r in rows], pa.schema([("vol_id", pa.string()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n", pa.int64()), ("s", pa.float64()), ("top", pa.float64())]))

    whole = F.regexp_replace("vol_id", "#[^#]*$", "").alias("vol_id")
    own = other.data.select(F.col("vol_id").alias("name"), whole, *_CELL[1:], F.col("v").alias("w"), F.struct("first", "size").alias("w_box"))
    both = own.join(reference.data.select(*_CELL, "v", F.struct("first", "size").alias("box")), _CELL, "left").select("name", "v", "w", F.col("box").eqNullSafe(F.col("w_box")).alias("same"))
    s = both.mapInArrow(run, "vol_id string, n_a long, n_b long, n long, s double, top double").groupBy("vol_id")
    s = s.agg(F.count("*").alias("chunks"), *[F.sum(c).alias(c) for c in ("n_a", "n_b", "n", "s")], F.max("top").alias("top")).where("n = n_a and n = n_b").withColumn("mse", F.col("s") / F.col("n"))
    wanted = reference.data.groupBy(F.col("vol_id").alias("of")).agg(F.count("*").alias("wanted"))
    s = s.join(F.broadcast(wanted), F.regexp_replace("vol_id", "#[^#]*$", "") == F.col("of")).where("chunks = wanted")
    return s.select("vol_id", "n", "mse", F.when(F.col("mse") > 0, 10 * F.log10(F.col("top") * F.col("top") / F.col("mse"))).otherwise(float("inf")).alias("psnr"))


def cut_chunks(chunks: Chunks) -> Chunks:
    return Chunks(cut(chunks.data), chunks.bounds, chunks.block, chunks.columns)


def voxels_of(chunks: Chunks) -> DataFrame:
    """vol_id, z, y, x and the columns of chunks, a row a voxel."""
    columns = chunks.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                n = int(np.prod(row["size"]))
                places = np.meshgrid(*[np.arange(f, f + k, dtype=np.int32) for f, k in zip(row["first"], row["size"], strict=True)], indexing="ij")
                vol = pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, np.int32)), pa.array([row["vol_id"]], pa.string())).cast(pa.string())
                yield pa.RecordBatch.from_arrays([vol, *[pa.array(p.ravel()) for p in places], *[pa.array(np.frombuffer(row[c], np.float64)) for c in columns]], names=["vol_id", "z", "y", "x", *columns])

    return chunks.data.select(*_CELL, "first", "size", *columns).mapInArrow(run, "vol_id string, z int, y int, x int, " + ", ".join(f"{c} double" for c in columns))


def over_blocks(vox: DataFrame, kernel: Kernel, halo: tuple[int, int, int], boundary: str = "replicate", block: int = 32, columns: tuple[str, ...] = ("v",), bordered: bool = False, placed: bool = False) -> DataFrame:
    """kernel maps a padded array to the array of its core, or to a tuple of arrays, one for each of columns; bordered kernels
    are told which padding lies outside the volume, placed ones where the core starts, too. Returns vol_id, z, y, x and columns."""
    return voxels_of(over_chunks(chunked(vox, max(block, *halo)), kernel, halo, boundary, columns, bordered, placed))


def windows(padded: np.ndarray, halo: tuple[int, int, int]) -> np.ndarray:
    """A view: the window of each core place, flattened in the last axis."""
    w = np.lib.stride_tricks.sliding_window_view(padded, tuple(2 * h + 1 for h in halo))
    return w.reshape(*w.shape[:3], -1)


def box_mean(padded: np.ndarray, r: int) -> np.ndarray:
    """Mean of the (2 r + 1)^3 window of each core place, an axis at a time: work does not grow with the window."""
    out, d = padded, 2 * r + 1
    for axis in range(3):
        sums = np.cumsum(np.concatenate((np.zeros_like(np.take(out, [0], axis=axis)), out), axis=axis), axis=axis)
        n = out.shape[axis]
        out = (np.take(sums, np.arange(d, n + 1), axis=axis) - np.take(sums, np.arange(n + 1 - d), axis=axis)) / d
    return out
