"""Batches that skip what is there, and a report rewritten by a stream."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_kernels import A, volume
from volspark import session
from volspark.operators import stencil
from volspark.plans import runs
from volspark.streaming import ingest, report


def _counted(calls, name, f):
    def work(v, p):
        calls.append((name, sorted(r["vol_id"] for r in v.select("vol_id").distinct().collect())))
        return f(v, p)

    return work


def test_a_batch_skips_what_is_there(spark, tmp_path):
    folder, calls = str(tmp_path / "batch"), []
    both = volume(spark, A).unionByName(volume(spark, A + 1, "b"))
    mean = lambda r: runs.Run("mean", _counted(calls, f"mean{r}", lambda v, p: stencil.mean_filter(v, p["r"])), {"r": r})
    broken = runs.Run("broken", _counted(calls, "broken", lambda v, p: 1 / 0))
    some = runs.Run("some", _counted(calls, "some", lambda v, p: v.where("vol_id = 'b' and z = 0")))
    first = runs.run_all(volume(spark, A), [mean(1), broken, some], folder).collect()
    assert [c[0] for c in calls] == ["mean1", "broken", "some"]
    assert {(r["run"], r["ok"], r["n"]) for r in first} == {("mean", True, A.size), ("broken", False, 0), ("some", True, 0)}
    assert "ZeroDivisionError" in next(r["error"] for r in first if r["run"] == "broken") and all(r["seconds"] >= 0 for r in first)
    calls.clear()
    runs.run_all(volume(spark, A), [mean(1), some], folder)
    assert calls == []  # a second call does nothing
    runs.run_all(both, [mean(1), mean(2), some], folder)
    assert calls == [("mean1", ["b"]), ("mean2", ["a", "b"]), ("some", ["b"])]  # a new volume, a changed parameter
    got = runs.results(spark, folder, mean(1))
    assert got.groupBy("vol_id").count().where(f"count = {A.size}").count() == 2
    t = {r["run"]: r for r in runs.tallies(runs.manifest(spark, folder)).collect()}
    assert (t["mean"]["attempts"], t["mean"]["succeeded"], t["mean"]["failed"], t["mean"]["n"]) == (4, 4, 0, 4 * A.size)
    assert (t["broken"]["failed"], t[None]["attempts"], t["some"]["n"]) == (1, 7, A[0].size)
    with pytest.raises(ValueError):
        runs.results(spark, folder, broken)


def test_results_of_a_killed_run_do_not_count(spark, tmp_path):
    folder = str(tmp_path / "batch")
    volume(spark, A).write.parquet(f"{folder}/results/killed")  # written, but without a row in the manifest
    run = runs.Run("copy", lambda v, p: v)
    assert runs.pending(volume(spark, A), [run], folder).count() == 1
    runs.run_all(volume(spark, A), [run], folder)
    assert runs.results(spark, folder, run).count() == A.size


def test_a_report_has_each_row_once(spark, tmp_path):
    folder, checkpoint, source = str(tmp_path / "report"), str(tmp_path / "ck"), tmp_path / "in"
    names = ["a", "b", "c"]
    for i, n in enumerate(names):
        volume(spark, A + i, n).coalesce(1).write.mode("append").parquet(str(source))
        for f in source.glob("*.parquet"):
            if not f.name.startswith("0"):
                os.utime(f, (1_000_000 + i, 1_000_000 + i))
                f.rename(source / f"0{i}.parquet")
    summary = lambda b: b.groupBy("vol_id").agg(F.count("*").alias("n"), F.avg("v").alias("mean"))
    seen = []

    def fails(when):
        def f(batch):
            out = summary(batch)
            if len(seen) == 2 and when == "before":
                seen.append("failed")
                raise RuntimeError("killed")
            seen.append(batch.first()["vol_id"])
            return out

        return f

    def once(f):
        q = report.keep_report(ingest.arriving_voxels(spark, str(source), 1), f, folder, checkpoint)
        try:
            q.awaitTermination(120)
        except Exception:
            return False
        return True

    assert report.read_report(spark, folder) is None
    assert not once(fails("before"))
    assert report.read_report(spark, folder).count() == 2
    # the batch after the last commit was written as well, when it was killed
    (tmp_path / "report" / "v=2").mkdir()
    (tmp_path / "report" / "v=2" / "part.parquet").write_bytes(b"half")
    assert once(summary)
    rows = {r["vol_id"]: (r["n"], r["mean"]) for r in report.read_report(spark, folder).collect()}
    assert set(rows) == set(names) and all(n == A.size for n, _ in rows.values())
    assert np.allclose([rows[n][1] for n in names], [A.mean() + i for i in range(3)])
    assert once(summary)  # nothing has come
    volume(spark, A * 2, "b").coalesce(1).write.mode("append").parquet(str(source))
    assert once(summary)
    assert {r["vol_id"]: round(r["mean"], 6) for r in report.read_report(spark, folder).collect()}["b"] == round(A.mean() * 2, 6)
    assert len(session.list_names(spark, folder)) <= 2


def test_clear(spark):
    df = session.cut(spark.range(5))
    assert df.count() == 5
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    session.clear(spark)
    assert not os.path.exists(folder) and session.cut(spark.range(3)).count() == 3
