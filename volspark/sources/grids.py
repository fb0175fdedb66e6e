"""Voxel grids over the driver tables, by key arithmetic alone, and typed scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volspark.schema import KEYS


def _table_grid(df: DataFrame, name: str, key: str, value: str) -> DataFrame:
    at = lambda e: F.expr(e).cast("int")
    return df.select(F.lit(name).alias("vol_id"), at(f"{key} div 500").alias("z"), at(f"({key} div 25) % 20").alias("y"), at(f"{key} % 25").alias("x"), F.col(value).cast("double").alias("v"))


def voxels(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """orders, events: 20 x 25 slices of a key; embeddings: a 8 x 8 slice per vector."""
    if name == "orders":
        return _table_grid(spark.read.parquet(f"{sf_dir}/orders.parquet"), name, "o_orderkey", "o_totalprice")
    if name == "events":
        return _table_grid(spark.read.parquet(f"{sf_dir}/events.parquet"), name, "event_id", "value")
    if name == "embeddings":
        e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("i", "e"))
        return e.select(F.lit(name).alias("vol_id"), F.col("vec_id").cast("int").alias("z"), F.expr("cast(i div 8 as int)").alias("y"), F.expr("cast(i % 8 as int)").alias("x"), F.col("e").cast("double").alias("v"))
    raise ValueError(f"no grid {name}")


def extents(vox: DataFrame) -> DataFrame:
    """vol_id and the inclusive bounds of each axis."""
    return vox.groupBy("vol_id").agg(*[f(a).alias(f"{n}{a}") for a in "zyx" for f, n in ((F.min, "lo_"), (F.max, "hi_"))])


def _with_range(vox: DataFrame) -> DataFrame:
    r = vox.groupBy("vol_id").agg(F.min("v").alias("mn"), F.max("v").alias("mx"))
    return vox.join(F.broadcast(r), "vol_id")


def rescale_uint16(vox: DataFrame) -> DataFrame:
    """Volumes of whole numbers within 0..65535 stay; others go linearly to that range, truncated; a constant volume is 0."""
    r = vox.groupBy("vol_id").agg(F.min("v").alias("mn"), F.max("v").alias("mx"), F.bool_and((F.col("v") == F.floor("v")) & F.col("v").between(0, 65535)).alias("whole"))
    scaled = F.when(F.col("whole"), F.col("v")).when(F.col("mx") == F.col("mn"), F.lit(0.0)).otherwise((F.col("v") - F.col("mn")) / (F.col("mx") - F.col("mn")) * 65535.0)
    return vox.join(F.broadcast(r), "vol_id").select(*KEYS, F.floor(scaled).cast("int").alias("v"))


def normalise_uint8(vox: DataFrame) -> DataFrame:
    """Min-max to 0..255, clipped, truncated; a constant volume is 0."""
    t = (F.col("v") - F.col("mn")) / (F.col("mx") - F.col("mn")) * 255.0
    return _with_range(vox).select(*KEYS, F.floor(F.when(F.col("mx") > F.col("mn"), F.least(F.lit(255.0), F.greatest(F.lit(0.0), t))).otherwise(F.lit(0.0))).cast("int").alias("v"))


def rescale_intensity(vox: DataFrame, low: float = 0.0, high: float = 255.0) -> DataFrame:
    """Linear from the volume's range to [low, high]; a constant volume is low."""
    t = (F.col("v") - F.col("mn")) / (F.col("mx") - F.col("mn")) * (high - low) + low
    return _with_range(vox).select(*KEYS, F.when(F.col("mx") > F.col("mn"), t).otherwise(F.lit(low)).alias("v"))


def display_range(vox: DataFrame) -> DataFrame:
    """(v - min) / (max - min + 1e-9)."""
    return _with_range(vox).select(*KEYS, ((F.col("v") - F.col("mn")) / (F.col("mx") - F.col("mn") + 1e-9)).alias("v"))
