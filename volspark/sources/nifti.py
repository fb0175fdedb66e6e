"""Python data sources for volumes in files: NIfTI-1 (.nii, .nii.gz) and MetaImage (.mha).

Reading ("nifti"): a partition per file, or per slab of slices of an uncompressed one. Paths may be of any store that pyarrow opens (file, hdfs, s3 ...);
a folder gives its .nii.gz, then its .nii, then its .mha files, each sorted. "volume_geometry" reads headers alone.

Writing ("nifti"): a task writes the volumes it holds under names of the attempt; the commit on the driver renames them, or, if a volume came
in pieces from several tasks, deletes all and fails, so that no volume is ever half written.

write_volumes() is for volumes of any size and type: slabs of planes are cast and compressed by tasks of their own, as gzip members, a task a volume puts
the members behind each other, and the driver renames whole files. A member says in its header how long it is, so such a file is read by slabs, too, though
it is compressed; for other readers it is an ordinary .nii.gz.
"""

from __future__ import annotations

import bisect
import gzip
import io
import struct
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from volspark.operators.blocks import chunked
from volspark.schema import VOXELS
from volspark.session import cut, drop_path

#: NIfTI-1 data type codes and MetaImage element types (fixed values of the formats).
TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
META_TYPES = {"MET_UCHAR": "u1", "MET_CHAR": "i1", "MET_USHORT": "u2", "MET_SHORT": "i2", "MET_UINT": "u4", "MET_INT": "i4", "MET_ULONG_LONG": "u8", "MET_LONG_LONG": "i8", "MET_FLOAT": "f4", "MET_DOUBLE": "f8"}
SUFFIXES = (".nii.gz", ".nii", ".mha")
IDENTITY = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)


@dataclass
class Header:
    shape: tuple[int, int, int]  # x, y, z as stored
    dtype: np.dtype
    offset: int
    slope: float
    inter: float
    spacing: tuple[float, float, float]
    origin: tuple[float, float, float] = (0.0, 0.0, 0.0)
    direction: tuple[float, ...] = IDENTITY  # 3 x 3, by rows
    packed: bool = False  # the values are one zlib stream


def _rotation(b: float, c: float, d: float, sign: float) -> np.ndarray:
    """Of the quaternion of a NIfTI header."""
    a = np.sqrt(max(0.0, 1 - b * b - c * c - d * d))
    r = np.array([[a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)], [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)], [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c]])
    return r * np.array([1.0, 1.0, sign])


def parse_header(raw: bytes) -> Header:
    order = "<" if struct.unpack("<i", raw[:4])[0] == 348 else ">"
    if struct.unpack(order + "i", raw[:4])[0] != 348:
        raise ValueError("not a NIfTI-1 header")
    dim = struct.unpack(order + "8h", raw[40:56])
    if dim[0] < 3 or any(d > 1 for d in dim[4 : dim[0] + 1]):
        raise ValueError(f"a volume has three dimensions, this one {dim[0]}")
    code = struct.unpack(order + "h", raw[70:72])[0]
    if code not in TYPES:
        raise ValueError(f"data type {code} is not supported")
    pix = struct.unpack(order + "8f", raw[76:108])
    offset, slope, inter = struct.unpack(order + "3f", raw[108:120])
    qform, sform = struct.unpack(order + "2h", raw[252:256])
    spacing, origin, direction = np.array(pix[1:4]), np.zeros(3), np.eye(3)
    if sform > 0:
        rows = np.array(struct.unpack(order + "12f", raw[280:328])).reshape(3, 4)
        spacing = np.sqrt((rows[:, :3] ** 2).sum(axis=0))
        origin, direction = rows[:, 3], rows[:, :3] / np.where(spacing > 0, spacing, 1.0)
    elif qform > 0:
        q = struct.unpack(order + "6f", raw[256:280])
        origin, direction = np.array(q[3:]), _rotation(*q[:3], -1.0 if pix[0] < 0 else 1.0)
    return Header(dim[1:4], np.dtype(order + TYPES[code]), int(offset), slope or 1.0, inter if slope else 0.0, tuple(map(float, spacing)), tuple(map(float, origin)), tuple(map(float, direction.ravel())))


def parse_meta_header(raw: bytes) -> Header:
    """Of a MetaImage file whose values follow the header."""
    mark = raw.find(b"ElementDataFile")
    end = raw.find(b"\n", mark) + 1
    if mark < 0 or not end:
        raise ValueError("not a MetaImage header")
    fields = {k.strip(): v.strip() for k, _, v in (line.partition("=") for line in raw[:end].decode("latin-1").splitlines())}
    if fields["ElementDataFile"] != "LOCAL" or fields.get("NDims") != "3" or fields.get("ElementNumberOfChannels", "1") != "1":
        raise ValueError("a MetaImage volume has three dimensions, one channel and its values in the same file")
    order = ">" if fields.get("BinaryDataByteOrderMSB", fields.get("ElementByteOrderMSB", "False")).lower() == "true" else "<"
    numbers = lambda names, rest: tuple(float(x) for x in next((fields[n] for n in names if n in fields), rest).split())
    matrix = np.array(numbers(("TransformMatrix", "Rotation", "Orientation"), "1 0 0 0 1 0 0 0 1")).reshape(3, 3).T  # stored by columns
    return Header(tuple(int(x) for x in fields["DimSize"].split()), np.dtype(order + META_TYPES[fields["ElementType"]]), end, 1.0, 0.0, numbers(("ElementSpacing", "ElementSize"), "1 1 1"), numbers(("Offset", "Position", "Origin"), "0 0 0"), tuple(map(float, matrix.ravel())), fields.get("CompressedData", "False").lower() == "true")


def store_of(path: str) -> tuple[pafs.FileSystem, str]:
    """A path, absolute or of any scheme; Hadoop writes file:/x for file:///x."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _stem(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return next(name[: -len(s)] for s in SUFFIXES if name.endswith(s))


def _open(path: str):
    store, name = store_of(path)
    stream = store.open_input_file(name)
    return gzip.GzipFile(fileobj=stream) if path.endswith(".gz") else stream


def read_header(path: str) -> Header:
    with _open(path) as s:
        return parse_meta_header(s.read(65_536)) if path.endswith(".mha") else parse_header(s.read(352))


def _files(path: str) -> list[str]:
    store, name = store_of(path)
    if store.get_file_info(name).type == pafs.FileType.File:
        return [path]
    found = sorted(f.base_name for f in store.get_file_info(pafs.FileSelector(name)) if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_")))
    return [f"{path.rstrip('/')}/{n}" for s in SUFFIXES for n in found if n.endswith(s)]


@dataclass
class _Slab(InputPartition):
    path: str
    z0: int
    z1: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.slab = options["path"], int(options.get("slab", 16))

    def partitions(self):
        out = []
        for f in _files(self.path):
            h = read_header(f)
            n = h.shape[2]
            whole = h.packed or (f.endswith(".gz") and members(f) is None)  # such a stream has no random access
            step = n if whole else self.slab
            out += [_Slab(f, z, min(n, z + step)) for z in range(0, n, max(step, 1))]
        return out

    def read(self, partition: _Slab):
        h = read_header(partition.path)
        nx, ny, _ = h.shape
        size = nx * ny * h.dtype.itemsize
        inside = members(partition.path) if partition.path.endswith(".gz") else None
        with _open(partition.path) if inside is None else _Members(partition.path, inside) as s:
            offset = h.offset
            if h.packed:
                s.seek(h.offset)
                s, offset = io.BytesIO(zlib.decompress(s.read())), 0
            for z in range(partition.z0, partition.z1):
                s.seek(offset + z * size)
                v = np.frombuffer(s.read(size), h.dtype).astype(np.float64) * h.slope + h.inter
                y, x = np.divmod(np.arange(nx * ny, dtype=np.int32), nx)
                names = pa.DictionaryArray.from_arrays(np.zeros(nx * ny, np.int32), [_stem(partition.path)]).cast(pa.string())
                yield pa.RecordBatch.from_arrays([names, pa.array(np.full(nx * ny, z, np.int32)), pa.array(y.astype(np.int32)), pa.array(x.astype(np.int32)), pa.array(v)], names=["vol_id", "z", "y", "x", "v"])


class _Members(io.RawIOBase):
    """What a file of members() holds, from any place: only the members that are read are inflated, one at a time."""

    def __init__(self, path: str, inside: list[tuple[int, int, int, int]]):
        store, name = store_of(path)
        self.file, self.inside, self.at, self.open_, self.data = store.open_input_file(name), inside, 0, -1, b""
        self.firsts = [m[2] for m in inside]

    def seek(self, at: int, whence: int = 0) -> int:
        self.at = at
        return at

    def read(self, n: int = -1) -> bytes:
        out = []
        while n > 0:
            k = bisect.bisect_right(self.firsts, self.at) - 1
            offset, length, first, size = self.inside[k]
            if self.at >= first + size:
                break
            if k != self.open_:
                self.file.seek(offset)
                self.data, self.open_ = gzip.decompress(self.file.read(length)), k
            part = self.data[self.at - first : self.at - first + n]
            out.append(part)
            self.at += len(part)
            n -= len(part)
        return b"".join(out)

    def close(self) -> None:
        self.file.close()
        super().close()


class _GeometryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self):
        return [_Slab(f, 0, 0) for f in _files(self.path)]

    def read(self, partition: _Slab):
        h = read_header(partition.path)
        yield _stem(partition.path), partition.path, list(map(int, h.shape)), list(h.spacing), list(h.origin), list(h.direction), h.dtype.newbyteorder("=").name


@dataclass
class _Written(WriterCommitMessage):
    files: dict[str, str]  # volume: name of the attempt


class _Writer(DataSourceWriter):
    """A file per volume. Options: compress (true: .nii.gz), spacing, origin (three numbers) and direction (nine, by rows), comma-separated."""

    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.suffix = ".nii.gz" if options.get("compress", "false").lower() == "true" else ".nii"
        numbers = lambda n, rest: tuple(float(x) for x in options[n].split(",")) if n in options else rest
        self.geometry = numbers("spacing", (1.0, 1.0, 1.0)), numbers("origin", (0.0, 0.0, 0.0)), numbers("direction", IDENTITY)

    def write(self, rows):
        by: dict[str, list] = {}
        for r in rows:
            by.setdefault(r.vol_id, []).append((r.z, r.y, r.x, r.v))
        store, base = store_of(self.path)
        store.create_dir(base, recursive=True)
        done = {}
        for vol, vs in by.items():
            a = np.array(vs)
            z, y, x = (a[:, i].astype(int) for i in range(3))
            data = np.zeros((z.max() + 1, y.max() + 1, x.max() + 1), "<f4")
            data[z, y, x] = a[:, 3]
            raw = make_header(data.shape[::-1], *self.geometry) + data.tobytes()
            done[vol] = f"{base}/.{uuid.uuid4().hex}.tmp"
            with store.open_output_stream(done[vol], compression=None) as f:
                f.write(gzip.compress(raw, 6, mtime=0) if self.suffix.endswith(".gz") else raw)
        return _Written(done)

    def commit(self, messages):
        store, base = store_of(self.path)
        pieces: dict[str, list[str]] = {}
        for m in messages:
            for vol, name in (m.files if m else {}).items():
                pieces.setdefault(vol, []).append(name)
        torn = sorted(v for v, names in pieces.items() if len(names) > 1)
        if torn:
            self.abort(messages)
            raise ValueError(f"volumes came in pieces from several tasks (repartition by vol_id, or use write_volumes): {torn[:5]}")
        for vol, (name,) in pieces.items():
            store.move(name, f"{base}/{vol}{self.suffix}")

    def abort(self, messages):
        store, _ = store_of(self.path)
        for m in messages:
            for name in (m.files if m else {}).values():
                if store.get_file_info(name).type == pafs.FileType.File:
                    store.delete_file(name)


#: Mark of the extra field of a member's header that has its length.
_MARK = b"VS"


def member(raw: bytes) -> bytes:
    """A gzip member whose header has the length of the member and of what it holds (RFC 1952)."""
    pack = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = pack.compress(raw) + pack.flush()
    size = 12 + 4 + 16 + len(body) + 8
    return b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H2sHQQ", 20, _MARK, 16, size, len(raw)) + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def members(path: str) -> list[tuple[int, int, int, int]] | None:
    """(offset, length, first byte, bytes) of each member of a file of such, of what it holds; None if it is another file. Reads headers alone."""
    store, name = store_of(path)
    size, out, at, first = store.get_file_info(name).size, [], 0, 0
    with store.open_input_file(name) as f:
        while at < size:
            f.seek(at)
            head = f.read(32)
            if len(head) < 32 or head[:4] != b"\x1f\x8b\x08\x04" or head[12:14] != _MARK:
                return None
            length, n = struct.unpack("<QQ", head[16:32])
            out.append((at, length, first, n))
            at, first = at + length, first + n
    return out


def make_header(shape: tuple[int, int, int], spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), origin: tuple[float, float, float] = (0.0, 0.0, 0.0), direction: tuple[float, ...] = IDENTITY, dtype: str = "f4") -> bytes:
    """Header of a volume, shape as x, y, z."""
    h = bytearray(352)
    struct.pack_into("<i", h, 0, 348)
    struct.pack_into("<8h", h, 40, 3, *shape, 1, 1, 1, 1)
    struct.pack_into("<2h", h, 70, next(c for c, t in TYPES.items() if t == dtype), 8 * np.dtype(dtype).itemsize)
    struct.pack_into("<8f", h, 76, 1.0, *spacing, 0, 0, 0, 0)
    struct.pack_into("<3f", h, 108, 352.0, 1.0, 0.0)
    struct.pack_into("<2h", h, 252, 0, 1)
    rows = np.concatenate((np.array(direction).reshape(3, 3) * np.array(spacing), np.array(origin)[:, None]), axis=1)
    struct.pack_into("<12f", h, 280, *rows.ravel())
    h[344:348] = b"n+1\0"
    return bytes(h)


class NiftiSource(DataSource):
    """spark.dataSource.register(NiftiSource); spark.read.format("nifti").load(folder)."""

    @classmethod
    def name(cls) -> str:
        return "nifti"

    def schema(self) -> str:
        return VOXELS

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool):
        return _Writer(self.options)


class GeometrySource(DataSource):
    """vol_id, path, shape (x, y, z), spacing, origin, direction (by rows) and type of the volumes of a folder."""

    @classmethod
    def name(cls) -> str:
        return "volume_geometry"

    def schema(self) -> str:
        return "vol_id string, path string, shape array<int>, spacing array<double>, origin array<double>, direction array<double>, type string"

    def reader(self, schema):
        return _GeometryReader(self.options)


def register(spark: SparkSession) -> None:
    for source in (NiftiSource, GeometrySource):
        spark.dataSource.register(source)


def _cast(a: np.ndarray, dtype: str) -> bytes:
    """Bytes of values of a type; whole numbers are truncated and clipped to its range, what is missing is 0."""
    a = np.nan_to_num(a, nan=0.0, posinf=np.inf, neginf=-np.inf)
    if np.dtype(dtype).kind in "iu":
        info = np.iinfo(dtype)
        low, high = float(info.min), np.nextafter(float(info.max) + 1, 0) if info.bits == 64 else float(info.max)
        a = np.clip(np.trunc(a), low, high)
    return a.astype(np.dtype(dtype).newbyteorder("<")).tobytes()


def write_volumes(vox: DataFrame, path: str, compress: str = "false", dtype: str = "f4", slab: int = 32, spacing: str = "1,1,1", origin: str = "0,0,0", direction: str = ",".join(map(str, IDENTITY))) -> None:
    """Each volume as one file, from place 0, 0, 0 on. A task holds a slab of planes, the one that puts a volume together no more than one slab, compressed. Files appear
    when all volumes are whole; a failure leaves none, and no parts."""
    if dtype not in TYPES.values():
        raise ValueError(f"a type is one of {sorted(TYPES.values())}")
    spark, base, packed = vox.sparkSession, path.rstrip("/"), compress.lower() == "true"
    parts, suffix = f"{base}/.parts-{uuid.uuid4().hex}", ".nii.gz" if packed else ".nii"
    geometry = [tuple(float(x) for x in g.split(",")) for g in (spacing, origin, direction)]
    pack = member if packed else bytes

    def put(name: str, pieces) -> None:
        store, at = store_of(name)
        store.create_dir(at.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(at, compression=None) as f:
            for p in pieces:
                f.write(p)

    def write_slab(rows: pa.Table) -> pa.Table:
        held = rows.to_pylist()
        (hz, hy, hx), b = held[0]["hi"], held[0]["b_z"]
        data = np.zeros((min(slab, hz + 1 - b * slab), hy + 1, hx + 1))
        for r in held:
            at = [r["first"][0] - b * slab, *r["first"][1:]]
            data[tuple(slice(f, f + n) for f, n in zip(at, r["size"], strict=True))] = np.frombuffer(r["v"]).reshape(r["size"])
        name = f"{parts}/{uuid.uuid4().hex}"
        put(name, [pack(_cast(data, dtype))])
        return pa.table({"vol_id": [held[0]["vol_id"]], "b_z": pa.array([b], pa.int32()), "name": [name], "hi": pa.array([held[0]["hi"]], pa.list_(pa.int32()))})

    def put_together(rows: pa.Table) -> pa.Table:
        held = {r["b_z"]: r for r in rows.to_pylist()}
        vol, (hz, hy, hx) = next((r["vol_id"], r["hi"]) for r in held.values())
        name = f"{parts}/{uuid.uuid4().hex}"

        def pieces():
            yield pack(make_header((hx + 1, hy + 1, hz + 1), *geometry, dtype))
            for b in range(hz // slab + 1):
                if b in held:
                    store, at = store_of(held[b]["name"])
                    with store.open_input_stream(at, compression=None) as f:
                        yield f.read()
                else:
                    yield pack(_cast(np.zeros((min(slab, hz + 1 - b * slab), hy + 1, hx + 1)), dtype))

        put(name, pieces())
        return pa.table({"vol_id": [vol], "name": [name]})

    chunks = chunked(vox, slab)
    if not chunks.bounds.where("exists(lo, x -> x < 0)").isEmpty():
        raise ValueError("a file has no places before 0")
    try:
        slabs = cut(chunks.data.join(F.broadcast(chunks.bounds), "vol_id").groupBy("vol_id", "b_z").applyInArrow(write_slab, "vol_id string, b_z int, name string, hi array<int>"))
        whole = cut(slabs.groupBy("vol_id").applyInArrow(put_together, "vol_id string, name string"))
        for r in whole.toLocalIterator():
            store, at = store_of(r["name"])
            store.move(at, f"{store_of(base)[1]}/{r['vol_id']}{suffix}")
    finally:
        drop_path(spark, parts)
