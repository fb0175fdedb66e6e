import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_kernels import A, array, volume
from volspark.operators import cluster, views
from volspark.sources import listing, nifti, sinks
from volspark.sources.nifti import NiftiSource, make_header
from volspark.streaming import ingest


def test_nifti_round_trip(spark, tmp_path):
    spark.dataSource.register(NiftiSource)
    (tmp_path / "in").mkdir()
    data = A.astype("<f4")
    (tmp_path / "in" / "one.nii").write_bytes(make_header(data.shape[::-1]) + data.tobytes())
    got = spark.read.format("nifti").option("slab", 2).load(str(tmp_path / "in"))
    assert got.rdd.getNumPartitions() == 3 and np.allclose(array(got, A.shape), data)
    got.repartition("vol_id").write.format("nifti").mode("append").save(str(tmp_path / "out"))
    assert np.allclose(array(spark.read.format("nifti").load(str(tmp_path / "out")), A.shape), data)


def test_volume_in_pieces_fails_whole(spark, tmp_path):
    nifti.register(spark)
    two = volume(spark, A).unionByName(volume(spark, A * 2, "b"))
    with pytest.raises(Exception, match="in pieces"):
        two.repartition(4, "z").write.format("nifti").mode("append").save(str(tmp_path / "out"))
    assert not list((tmp_path / "out").iterdir())
    nifti.write_volumes(two.repartition(4, "z"), f"file://{tmp_path}/out")
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.nii", "b.nii"]
    back = spark.read.format("nifti").load(f"file://{tmp_path}/out")
    assert np.allclose(array(back.where("vol_id = 'b'"), A.shape), A * 2)


def test_geometry_survives(spark, tmp_path):
    turned = "0,-1,0,1,0,0,0,0,1"
    nifti.write_volumes(volume(spark, A), str(tmp_path / "g"), compress="true", spacing="0.5,2,3", origin="-10,4.5,7", direction=turned)
    assert [p.name for p in (tmp_path / "g").iterdir()] == ["a.nii.gz"]
    r = spark.read.format("volume_geometry").load(str(tmp_path / "g")).first()
    assert r["shape"] == list(A.shape[::-1]) and r["type"] == "float32" and r["vol_id"] == "a"
    assert np.allclose(r["spacing"], [0.5, 2, 3]) and np.allclose(r["origin"], [-10, 4.5, 7]) and np.allclose(r["direction"], [float(x) for x in turned.split(",")])
    assert np.allclose(array(spark.read.format("nifti").load(str(tmp_path / "g")), A.shape), A)


def test_int64_and_meta_images(spark, tmp_path):
    nifti.register(spark)
    h = bytearray(nifti.make_header(A.shape[::-1]))
    h[70:74] = (1024).to_bytes(2, "little") + (64).to_bytes(2, "little")
    (tmp_path / "long.nii").write_bytes(bytes(h) + A.astype("<i8").tobytes())
    meta = "ObjectType = Image\nNDims = 3\nDimSize = {} {} {}\nElementType = MET_SHORT\nElementSpacing = 1 2 3\nOffset = 4 5 6\nTransformMatrix = 0 1 0 -1 0 0 0 0 1\n{}ElementDataFile = LOCAL\n".format
    (tmp_path / "plain.mha").write_bytes(meta(*A.shape[::-1], "").encode() + A.astype("<i2").tobytes())
    (tmp_path / "packed.mha").write_bytes(meta(*A.shape[::-1], "CompressedData = True\n").encode() + zlib.compress(A.astype("<i2").tobytes()))
    back = spark.read.format("nifti").option("slab", 2).load(str(tmp_path))
    for name in ("long", "plain", "packed"):
        assert np.array_equal(array(back.where(f"vol_id = '{name}'"), A.shape), A)
    rows = {r["vol_id"]: r for r in spark.read.format("volume_geometry").load(str(tmp_path)).collect()}
    assert rows["long"]["type"] == "int64" and rows["plain"]["spacing"] == [1, 2, 3] and rows["plain"]["origin"] == [4, 5, 6] and rows["packed"]["direction"] == [0, -1, 0, 1, 0, 0, 0, 0, 1]
    half = np.sqrt(0.5)
    assert np.allclose(nifti._rotation(0, 0, half, 1.0), [[0, -1, 0], [1, 0, 0], [0, 0, 1]])


def test_listing(spark, tmp_path):
    for p in ("brain/x.nii.gz", "other/liver_y.mha", "a_1_2.nii", "skip.txt"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_bytes(b"1")
    f = listing.list_volumes(spark, str(tmp_path))
    assert [r["stem"] for r in f.collect()] == ["a_1_2", "x", "liver_y"]
    o = spark.createDataFrame([("b", "brain", "brain"), ("l", "liver", "liver")], "organ string, folder string, pattern string")
    assert {r["organ"]: r["path"].rsplit("/", 1)[1] for r in listing.discover(f, o).collect()} == {"b": "x.nii.gz", "l": "liver_y.mha"}
    assert [r["params"] for r in listing.results_of(f, "a").collect()] == ["1_2"]


def test_sinks(spark, tmp_path):
    sinks.write_voxels(volume(spark, A), str(tmp_path / "v"))
    assert np.allclose(array(spark.read.parquet(str(tmp_path / "v")), A.shape), A)
    old = spark.createDataFrame([("a", 1), ("b", 1)], "image_name string, k int")
    new = spark.createDataFrame([("b", 2), ("c", 2)], "image_name string, k int")
    assert {(r["image_name"], r["k"]) for r in sinks.upsert(old, new).collect()} == {("a", 1), ("b", 2), ("c", 2)}
    assert sinks.as_json(new).first()["json"] == '{"image_name":"b","k":2}'


def test_parameter_grid(spark):
    runs = spark.createDataFrame([(s, t, u, s * 100 + t * 10 + u) for s in (1, 2) for t in (1, 2) for u in (1, 2, 3)], "s int, t int, u int, v int")
    got = views.parameter_grid(runs, "s", "t", "u", "v", [1, 2])
    assert {tuple(r) for r in got.collect()} == {(1, 112, 122), (2, 212, 222)}


def test_stream(spark, tmp_path):
    volume(spark, A).write.parquet(str(tmp_path / "in"))
    q = ingest.start(ingest.running_stats(ingest.arriving_voxels(spark, str(tmp_path / "in"))), "volume_stats", str(tmp_path / "ck"))
    q.awaitTermination(120)
    r = spark.table("volume_stats").select("n", F.round("mean", 6).alias("m")).first()
    assert (r["n"], r["m"]) == (A.size, round(A.mean(), 6))


def test_reports_logs_and_paths(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "image_name string, k long")
    sinks.write_report(rows, str(tmp_path / "report"))
    sinks.write_report(rows.where("k = 2"), str(tmp_path / "report"))
    assert [tuple(r) for r in sinks.read_report(spark, str(tmp_path / "report"), "image_name string, k long").collect()] == [("b", 2)]
    (tmp_path / "list.json").write_text('[{"image_name": "c",\n "k": 3}]')
    assert sinks.read_report(spark, str(tmp_path / "list.json")).first()["k"] == 3
    for step in ("read", "write"):
        sinks.append_log(spark.createDataFrame([(step, "done")], "step string, message string"), str(tmp_path / "log"))
    assert {r["step"] for r in spark.read.json(str(tmp_path / "log")).collect()} == {"read", "write"}
    (tmp_path / "Images").mkdir()
    (tmp_path / "Images" / "x.nii").write_bytes(b"1")
    assert listing.resolve(f"{tmp_path}/x.nii", f"{tmp_path}/Images") == f"{tmp_path}/Images/x.nii"
    with pytest.raises(FileNotFoundError):
        listing.resolve(f"{tmp_path}/y.nii", f"{tmp_path}/Images")


def test_label_numbers_and_guard(spark):
    d = spark.createDataFrame([(i,) for i in range(3)], "label int")
    assert [r[0] for r in cluster.spread_labels(d, 3).collect()] == [0, 84, 168]
    with pytest.raises(ValueError, match="at most 4"):
        cluster.uniform_seeds(volume(spark, A), 5, most=4)


def test_a_volume_by_many_tasks(spark, tmp_path):
    """Slabs by tasks of their own; a compressed file is read by slabs as well, by any other reader as a whole."""
    import gzip

    wide = np.random.default_rng(4).normal(size=(11, 9, 7)) * 100
    v = volume(spark, wide).unionByName(volume(spark, wide[:2] + 1, "b")).repartition(5)
    nifti.register(spark)
    for compress, suffix in (("true", ".nii.gz"), ("false", ".nii")):
        out = str(tmp_path / compress)
        nifti.write_volumes(v, out, compress=compress, dtype="f8", slab=3, spacing="1,2,3")
        assert sorted(p.name for p in (tmp_path / compress).iterdir()) == [f"a{suffix}", f"b{suffix}"]
        back = spark.read.format("nifti").option("slab", 2).load(out)
        assert back.rdd.getNumPartitions() == 7
        assert np.array_equal(array(back.where("vol_id = 'a'"), wide.shape), wide)
    raw = gzip.open(tmp_path / "true" / "a.nii.gz").read()
    assert np.array_equal(np.frombuffer(raw[352:], "<f8").reshape(wide.shape), wide)
    assert len(nifti.members(str(tmp_path / "true" / "a.nii.gz"))) == 5  # header and four slabs
    geometry = spark.read.format("volume_geometry").load(str(tmp_path / "true")).orderBy("vol_id").first()
    assert (geometry["shape"], geometry["spacing"], geometry["type"]) == ([7, 9, 11], [1.0, 2.0, 3.0], "float64")


@pytest.mark.parametrize(("dtype", "low", "high"), [("u1", 0, 255), ("i2", -32768, 32767), ("u2", 0, 65535), ("i8", -(1 << 63), (1 << 63) - 1024), ("f4", None, None)])
def test_types_of_files(spark, tmp_path, dtype, low, high):
    a = np.array([0.0, 1.9, -1.9, 254.7, 300.2, 40_000.0, 70_000.0, -70_000.0, 1e20]).reshape(1, 3, 3)
    nifti.write_volumes(volume(spark, a), str(tmp_path), compress="true", dtype=dtype)
    nifti.register(spark)
    got = array(spark.read.format("nifti").load(str(tmp_path)), a.shape)
    assert np.array_equal(got, a.astype(np.float32) if low is None else np.clip(np.trunc(a), low, high))


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    with pytest.raises(Exception, match="no places before 0"):
        nifti.write_volumes(volume(spark, A).withColumn("z", F.col("z") - 1), str(tmp_path / "x"))
    nifti.write_volumes(volume(spark, A), str(tmp_path / "y"))
    broken = volume(spark, A).withColumn("v", F.when(F.col("z") > 3, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        nifti.write_volumes(broken, str(tmp_path / "y"))
    assert [p.name for p in (tmp_path / "y").iterdir()] == ["a.nii"]


def test_a_volume_that_begins_late(spark, tmp_path):
    late = volume(spark, A).withColumns({"z": F.col("z") + 9, "x": F.col("x") + 1})
    nifti.write_volumes(late, str(tmp_path), compress="true", slab=4)
    nifti.register(spark)
    got = array(spark.read.format("nifti").load(str(tmp_path)), (A.shape[0] + 9, A.shape[1], A.shape[2] + 1))
    assert np.array_equal(got[9:, :, 1:], A) and not got[:9].any() and not got[:, :, 0].any()
