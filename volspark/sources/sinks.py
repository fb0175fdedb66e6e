"""Sinks: voxels as Parquet by volume, and a report table with upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_voxels(vox: DataFrame, path: str) -> None:
    """A folder per volume, rows sorted by place, so that scans of slices prune."""
    vox.repartition("vol_id", "z").sortWithinPartitions("z", "y", "x").write.mode("overwrite").partitionBy("vol_id").parquet(path)


def upsert(old: DataFrame | None, new: DataFrame, key: str = "image_name") -> DataFrame:
    """new, and what of old has other keys."""
    if old is None:
        return new
    return old.join(new.select(F.col(key)).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def as_json(report: DataFrame) -> DataFrame:
    return report.select(F.to_json(F.struct(*[F.col(c) for c in report.columns])).alias("json"))


def write_report(report: DataFrame, path: str) -> None:
    """The report as JSON, in place of what was there."""
    report.write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A report read back, one object a line or a list over many."""
    reader = spark.read.option("multiLine", "true")
    return (reader.schema(schema) if schema else reader).json(path)


def append_log(rows: DataFrame, path: str) -> None:
    """step, message and the time of writing, a line of JSON each, after what is there."""
    rows.select(F.current_timestamp().alias("at"), "step", "message").write.mode("append").json(path)
