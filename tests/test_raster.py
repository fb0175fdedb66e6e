"""PNG files of every filter, depth and colour type, written here byte by byte."""

import struct
import zlib

import numpy as np
import pytest

from volspark.sources import raster


def _part(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(a, depth=8, colour=0, filters=(0, 1, 2, 3, 4), palette=None, alpha=None, interlaced=0):
    """a: rows x columns x samples of whole numbers."""
    h, w, n = a.shape
    if depth == 16:
        rows = [r.astype(">u2").tobytes() for r in a]
    elif depth == 8:
        rows = [r.astype(np.uint8).tobytes() for r in a]
    else:
        bits = ((a.reshape(h, -1, 1) >> np.arange(depth - 1, -1, -1)) & 1).reshape(h, -1)
        rows = [np.packbits(r.astype(np.uint8)).tobytes() for r in bits]
    step, out, above = max(1, n * depth // 8), b"", bytes(len(rows[0]))
    for y, row in enumerate(rows):
        kind, new = filters[y % len(filters)], bytearray()
        for i, x in enumerate(row):
            left, up, corner = (row[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
            near = min((abs(left + up - corner - v), k, v) for k, v in enumerate((left, up, corner)))[2]
            new.append((x - (0, left, up, (left + up) // 2, near)[kind]) & 255)
        out, above = out + bytes([kind]) + bytes(new), row
    body = zlib.compress(out)
    parts = [_part(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, interlaced))]
    parts += [_part(kind, data) for kind, data in ((b"PLTE", palette), (b"tRNS", alpha)) if data is not None]
    return raster._SIGNATURE + b"".join([*parts, _part(b"tEXt", b"a\0b"), _part(b"IDAT", body[:9]), _part(b"IDAT", body[9:]), _part(b"IEND", b"")])


@pytest.mark.parametrize("depth", [1, 2, 4, 8, 16])
@pytest.mark.parametrize("colour", [0, 2, 4, 6])
def test_depths_and_colours(depth, colour):
    if depth < 8 and colour:
        return
    a = np.random.default_rng(depth + colour).integers(0, 1 << depth, (11, 7, raster.SAMPLES[colour]))
    assert np.allclose(raster.decode_png(png(a, depth, colour)), a / ((1 << depth) - 1))


def test_palette():
    palette = np.arange(12, dtype=np.uint8).reshape(4, 3) * 20
    a = np.random.default_rng(1).integers(0, 4, (5, 6, 1))
    assert np.allclose(raster.decode_png(png(a, 2, 3, palette=palette.tobytes())), palette[a[:, :, 0]] / 255)
    clear = raster.decode_png(png(a, 8, 3, palette=palette.tobytes(), alpha=b"\x00\x80"))
    assert np.allclose(clear[:, :, 3], np.array([0, 128, 255, 255])[a[:, :, 0]] / 255)


def test_what_is_refused():
    a = np.zeros((2, 2, 1), int)
    with pytest.raises(ValueError, match="interlaced"):
        raster.decode_png(png(a, interlaced=1))
    with pytest.raises(ValueError, match="not a PNG"):
        raster.decode_png(b"GIF89a")
    whole = png(a)
    with pytest.raises(ValueError, match="damaged"):
        raster.decode_png(whole[:20] + b"\xff" + whole[21:])
    with pytest.raises(ValueError):
        raster.decode_png(whole[:-20])


def test_scan_and_sink(spark, tmp_path):
    rng = np.random.default_rng(2)
    colours = rng.integers(0, 256, (30, 20, 3))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.png").write_bytes(png(colours, 8, 2))
    (tmp_path / "in" / "other.txt").write_text("x")
    got = {(r["r"], r["c"], r["channel"]): r["v"] for r in raster.read_png(spark, str(tmp_path / "in")).collect()}
    assert len(got) == colours.size and all(abs(got[i] - v / 255) < 1e-12 for i, v in np.ndenumerate(colours))
    for levels in (256, 65536):
        grey = rng.integers(0, levels, (9, 8))
        rows = [("a", *map(int, i), float(v)) for i, v in np.ndenumerate(grey)] + [("b", 0, 0, 5.0)]
        made = raster.write_png(spark.createDataFrame(rows, "vol_id string, r int, c int, v double"), str(tmp_path / f"out{levels}"), levels).collect()
        assert sorted(r["vol_id"] for r in made) == ["a", "b"]
        back = {(r["r"], r["c"]): r["v"] for r in raster.read_png(spark, str(tmp_path / f"out{levels}" / "*")).where("vol_id = 'a'").collect()}
        assert np.allclose([back[i] for i, _ in np.ndenumerate(grey)], grey.ravel() / (levels - 1))
