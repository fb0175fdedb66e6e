"""Volumes that arrive as files of voxel rows: running statistics per volume by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volspark.schema import VOXELS


def arriving_voxels(spark: SparkSession, folder: str, files_per_batch: int = 16) -> DataFrame:
    """A stream of the Parquet voxel files that appear in a folder."""
    return spark.readStream.schema(VOXELS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def running_stats(vox: DataFrame) -> DataFrame:
    """Count, range, mean and population deviation per volume so far; state is one row per volume. Sums of counts are mergeable, so late files only add."""
    return vox.groupBy("vol_id").agg(F.count("*").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def start(stats: DataFrame, name: str, checkpoint: str):
    """An in-memory table of the statistics, complete after each batch."""
    return stats.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
