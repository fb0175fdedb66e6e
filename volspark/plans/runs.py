"""Batches of runs over volumes that skip what is there: results, and a manifest of what ran, how long, and how it ended."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from volspark.session import drop_path, path_exists

MANIFEST = "vol_id string, run string, params string, ok boolean, seconds double, n long, error string, path string"


@dataclass
class Run:
    """work(volumes, params) gives rows with vol_id."""

    name: str
    work: Callable[[DataFrame, dict], DataFrame]
    params: dict = field(default_factory=dict)

    @property
    def key(self) -> str:
        return json.dumps(self.params, sort_keys=True)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{folder.rstrip('/')}/manifest"
    return spark.read.schema(MANIFEST).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], MANIFEST)


def pending(vox: DataFrame, runs: list[Run], folder: str) -> DataFrame:
    """vol_id, i: the runs (by place) that a volume has no result of yet, with the very same parameters."""
    spark = vox.sparkSession
    every = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(r.name).alias("run"), F.lit(r.key).alias("params")) for i, r in enumerate(runs)])).alias("r")
    done = manifest(spark, folder).where("ok").select("vol_id", "run", "params")
    return vox.select("vol_id").distinct().select("vol_id", every).select("vol_id", "r.*").join(done, ["vol_id", "run", "params"], "left_anti").select("vol_id", "i")


def run_all(vox: DataFrame, runs: list[Run], folder: str) -> DataFrame:
    """Runs what is pending, and returns the manifest. A run takes all volumes that lack it as one relation, is timed and counted while it is written,
    and counts once its row in the manifest is there: what a run that failed or was killed has written is in no row, and it runs again at the
    next call. A failure is recorded and does not end the batch."""
    spark, folder = vox.sparkSession, folder.rstrip("/")
    todo: dict[int, list[str]] = {}
    for r in pending(vox, runs, folder).orderBy("i", "vol_id").toLocalIterator():  # names of volumes, not voxels
        todo.setdefault(r["i"], []).append(r["vol_id"])
    for i, volumes in todo.items():
        run, path, seen = runs[i], f"{folder}/results/{uuid.uuid4().hex}", Observation("rows")
        names = spark.createDataFrame([(v,) for v in volumes], "vol_id string")
        began, rows, error = time.perf_counter(), {}, None
        try:
            made = run.work(vox.join(names, "vol_id", "left_semi"), run.params)
            made.observe(seen, F.count("*").alias("n")).write.parquet(path)
            if seen.get["n"]:
                rows = {r["vol_id"]: r["n"] for r in spark.read.parquet(path).groupBy("vol_id").agg(F.count("*").alias("n")).toLocalIterator()}
        except Exception as e:  # any failure is the run's own
            error = f"{type(e).__name__}: {e}"[:500]
            drop_path(spark, path)
        took = round(time.perf_counter() - began, 3)
        entries = [(v, run.name, run.key, error is None, took, rows.get(v, 0), error, path if error is None else None) for v in volumes]
        spark.createDataFrame(entries, MANIFEST).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def results(spark: SparkSession, folder: str, run: Run) -> DataFrame:
    """The rows of a run's results, of all volumes that have them."""
    done = manifest(spark, folder).where("ok").where((F.col("run") == run.name) & (F.col("params") == run.key))
    paths = [r["path"] for r in done.select("path").distinct().toLocalIterator()]
    if not paths:
        raise ValueError(f"{run.name} has no result")
    return spark.read.parquet(*paths)


def tallies(rows: DataFrame) -> DataFrame:
    """run (null: all), attempts, succeeded, failed, n (rows), seconds and longest of a manifest. A run's seconds count once, however many volumes it took."""
    jobs = rows.groupBy("run", "params", "path", "ok", "seconds").agg(F.count("*").alias("volumes"), F.sum("n").alias("n"))
    return jobs.rollup("run").agg(F.sum("volumes").alias("attempts"), F.sum(F.when(F.col("ok"), F.col("volumes")).otherwise(0)).alias("succeeded"), F.sum(F.when(F.col("ok"), 0).otherwise(F.col("volumes"))).alias("failed"), F.sum("n").alias("n"), F.sum("seconds").alias("seconds"), F.max("seconds").alias("longest"))
