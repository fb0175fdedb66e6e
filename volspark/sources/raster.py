"""PNG images: a scan of pixels, and a sink of slices. Files come through Spark's binary source, so from any store; an image is decoded by one task."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volspark.sources.nifti import store_of

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel by colour type (fixed values): grey, colours, index into the palette, grey with alpha, colours with alpha.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Pixels of an image that a task decodes.
MOST_PIXELS = 1 << 28


def _chunks(raw: bytes) -> Iterator[tuple[bytes, bytes]]:
    if not raw.startswith(_SIGNATURE):
        raise ValueError("not a PNG file")
    at, kind = len(_SIGNATURE), b""
    while kind != b"IEND":
        if at + 12 > len(raw):
            raise ValueError("a PNG file that ends too early")
        n, kind = struct.unpack_from(">I4s", raw, at)
        data = raw[at + 8 : at + 8 + n]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", raw.ljust(at + 12 + n, b"\0"), at + 8 + n)[0]:
            raise ValueError("a PNG file with a damaged part")
        yield kind, data
        at += 12 + n


def _predicted(kind: int, row: bytearray, above: bytes, step: int) -> None:
    """Adds to a row what filters 3 (mean) and 4 (the nearest of left, above and corner to their plane) predict, byte by byte."""
    if kind == 3:
        for i in range(len(row)):
            row[i] = (row[i] + ((row[i - step] if i >= step else 0) + above[i]) // 2) & 255
        return
    for i in range(len(row)):
        a, c = (row[i - step], above[i - step]) if i >= step else (0, 0)
        b = above[i]
        p, q, r = abs(b - c), abs(a - c), abs(a + b - 2 * c)
        row[i] = (row[i] + (a if p <= q and p <= r else b if q <= r else c)) & 255


def decode_png(raw: bytes) -> np.ndarray:
    """rows x columns x samples, in 0..1; images of a palette as colours. Interlaced images are refused."""
    head, palette, alpha, packed = None, None, b"", []
    for kind, data in _chunks(raw):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"PLTE":
            palette = np.frombuffer(data, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = data
        elif kind == b"IDAT":
            packed.append(data)
    width, height, depth, colour, _, _, interlaced = head
    if interlaced:
        raise ValueError("interlaced PNG images are not supported")
    if width * height > MOST_PIXELS:
        raise ValueError(f"an image of more than {MOST_PIXELS} pixels is not decoded by one task")
    samples = SAMPLES[colour]
    step, size = max(1, samples * depth // 8), (width * samples * depth + 7) // 8
    flat = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)[: height * (size + 1)].reshape(height, size + 1)
    out, above = np.zeros((height, size), np.uint8), np.zeros(size, np.uint8)
    for y in range(height):
        kind, row = int(flat[y, 0]), flat[y, 1:]
        if kind == 1:
            whole = np.zeros(-(-size // step) * step, np.uint8)
            whole[:size] = row
            row = np.cumsum(whole.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[:size]
        elif kind == 2:
            row = row + above
        elif kind in (3, 4):
            mine = bytearray(row.tobytes())
            _predicted(kind, mine, above.tobytes(), step)
            row = np.frombuffer(mine, np.uint8)
        out[y] = above = row
    if depth == 16:
        values = out.reshape(height, -1).view(">u2")
    elif depth == 8:
        values = out
    else:
        bits = np.unpackbits(out, axis=1).reshape(height, -1, depth)
        values = (bits << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(axis=2)
    values = values[:, : width * samples].reshape(height, width, samples)
    if colour != 3:
        return values / float((1 << depth) - 1)
    seen = palette[values[:, :, 0]] / 255.0
    if not alpha:
        return seen
    clear = np.concatenate([np.frombuffer(alpha, np.uint8), np.full(len(palette) - len(alpha), 255, np.uint8)])
    return np.concatenate([seen, clear[values] / 255.0], axis=2)


def encode_png(a: np.ndarray) -> bytes:
    """A grey image of rows x columns (uint8, or uint16 with all bits), each row less the one above."""
    depth = a.dtype.itemsize * 8
    raw = a.astype(f">u{a.dtype.itemsize}").view(np.uint8).reshape(a.shape[0], -1)
    less = raw - np.concatenate([np.zeros((1, raw.shape[1]), np.uint8), raw[:-1]])
    rows = np.concatenate([np.full((len(raw), 1), 2, np.uint8), less], axis=1)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return _SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], depth, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows.tobytes())) + part(b"IEND", b"")


def read_png(spark: SparkSession, path: str) -> DataFrame:
    """vol_id (the name without folders and ending), r, c, channel, v in 0..1 of each pixel and sample of the images of a folder or pattern."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path).select("path", "content")

    def pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                a = decode_png(content.as_py())
                name = path.rsplit("/", 1)[-1].removesuffix(".png")
                rows = max(1, 20_000 // max(1, a.shape[1] * a.shape[2]))
                for y in range(0, a.shape[0], rows):
                    part = a[y : y + rows]
                    r, c, k = (i.ravel().astype(np.int32) for i in np.indices(part.shape))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * part.size), pa.array(r + np.int32(y)), pa.array(c), pa.array(k), pa.array(np.ascontiguousarray(part, np.float64).ravel())], names=["vol_id", "r", "c", "channel", "v"])

    return files.mapInArrow(pixels, "vol_id string, r int, c int, channel int, v double")


def write_png(slices: DataFrame, folder: str, levels: int = 256) -> DataFrame:
    """slices: vol_id, r, c, v (whole numbers under levels, 256 or 65536). Writes each as a grey image of its own, and returns vol_id and path: a folder of its own
    for each attempt of a task, so that what a lost one left is in no path that is returned. Missing pixels are black."""

    def draw(rows: pa.Table) -> pa.Table:
        name = rows.column("vol_id")[0].as_py()
        r, c = (rows.column(x).to_numpy() for x in ("r", "c"))
        a = np.zeros((int(r.max()) + 1, int(c.max()) + 1), np.uint8 if levels == 256 else np.uint16)
        a[r, c] = np.clip(rows.column("v").to_numpy(), 0, levels - 1).astype(a.dtype)
        path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}/{name}.png"
        store, at = store_of(path)
        store.create_dir(at.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(at) as out:
            out.write(encode_png(a))
        return pa.table({"vol_id": [name], "path": [path]})

    return slices.select("vol_id", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.col("v").cast("double").alias("v")).groupBy("vol_id").applyInArrow(draw, "vol_id string, path string")
