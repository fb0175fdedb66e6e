"""Listings of volume files as relations, and names taken apart."""

from __future__ import annotations

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from volspark.functions.pointwise import file_stem
from volspark.sources.nifti import store_of


def list_volumes(spark: SparkSession, folder: str, pattern: str = "*.{nii,nii.gz,mha}") -> DataFrame:
    """path, stem, length, ordered by path; contents are not read."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return f.select("path", file_stem(F.col("path")).alias("stem"), "length").orderBy("path")


def discover(files: DataFrame, organs: DataFrame) -> DataFrame:
    """organ, path: for each organ (organ, folder, pattern) the first file of its own folder, else the first whose lower-case name contains the pattern."""
    m = files.join(organs, (F.contains("path", F.concat(F.lit("/"), "folder", F.lit("/")))) | F.contains(F.lower(file_stem(F.col("path"))), F.col("pattern")))
    rank = F.when(F.contains("path", F.concat(F.lit("/"), "folder", F.lit("/"))), 0).otherwise(1)
    return m.withColumn("k", F.row_number().over(Window.partitionBy("organ").orderBy(rank, "path"))).where("k = 1").select("organ", "path")


def results_of(files: DataFrame, image: str) -> DataFrame:
    """path and params of the results of an image: names that start with ``image_``."""
    s = file_stem(F.col("path"))
    return files.where(F.startswith(s, F.lit(f"{image}_"))).select("path", F.substr(s, F.lit(len(image) + 2)).alias("params")).orderBy("path")


def parameters(results: DataFrame, names: list[str]) -> DataFrame:
    """results_of() with a column for each of names: the parts of params between underscores, null where there are fewer."""
    parts = F.split("params", "_")
    return results.select("*", *[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)])


def all_present(results: DataFrame, required: list[str], key: str = "image", kind: str = "kind") -> DataFrame:
    """The rows of those keys that have every required kind."""
    whole = results.where(F.col(kind).isin(required)).groupBy(key).agg(F.countDistinct(kind).alias("kinds")).where(F.col("kinds") == len(set(required)))
    return results.join(whole.select(key), key, "left_semi")


def resolve(path: str, folder: str = "Images") -> str:
    """path if there is such a file, else that in folder; an error where there is neither."""
    for p in (path, f"{folder.rstrip('/')}/{path.rsplit('/', 1)[-1]}"):
        store, name = store_of(p)
        if store.get_file_info(name).type == pafs.FileType.File:
            return p
    raise FileNotFoundError(f"neither {path} nor one in {folder}")
