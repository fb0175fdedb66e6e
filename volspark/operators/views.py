"""The relations behind figures: panels of slices, mosaics, overlays, grids of parameters. Rendering is left to the reader's tool."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from volspark.functions.pointwise import plane
from volspark.functions.stats import percentiles


def panels(volumes: list[tuple[str, DataFrame]], axis: str, index: int | None = None) -> DataFrame:
    """panel, title, vol_id, r, c, v: the same slice of several volumes side by side."""
    out = None
    for i, (title, vox) in enumerate(volumes):
        p = plane(vox, axis, index).select(F.lit(i).alias("panel"), F.lit(title).alias("title"), "vol_id", "r", "c", "v")
        out = p if out is None else out.unionByName(p)
    return out


def three_planes(vox: DataFrame) -> DataFrame:
    """view, vol_id, r, c, v of the middle slices of all axes."""
    out = None
    for name, axis in (("axial", "z"), ("coronal", "y"), ("sagittal", "x")):
        p = plane(vox, axis).select(F.lit(name).alias("view"), "vol_id", "r", "c", "v")
        out = p if out is None else out.unionByName(p)
    return out


def mosaic(names: DataFrame, per_row: int = 4) -> DataFrame:
    """name, row, col: cells in order of names, per_row a row. names has a name column (as many as figures, not voxels)."""
    i = F.row_number().over(Window.orderBy("name")) - 1
    return names.select("name", i.alias("i")).select("name", F.floor(F.col("i") / per_row).cast("int").alias("row"), (F.col("i") % per_row).cast("int").alias("col"))


def overlay(sl: DataFrame, mask_slice: DataFrame) -> DataFrame:
    """vol_id, r, c, v, vmax (98th percentile of the slice), on: the original where there is one, and whether the mask is set."""
    m = mask_slice.select("vol_id", "r", "c", F.lit(True).alias("m"))
    p = percentiles(sl, [0.98]).select("vol_id", F.col("p")[0].alias("vmax"))
    return sl.join(m, ["vol_id", "r", "c"], "left").join(p, "vol_id").select("vol_id", "r", "c", "v", "vmax", F.coalesce("m", F.lit(False)).alias("on"))


def parameter_grid(runs: DataFrame, row: str, col: str, fixed: str, value: str, columns: list) -> DataFrame:
    """value by row and column of two parameters, the third fixed at its middle value (sorted, len // 2)."""
    vals = runs.select(fixed).distinct().agg(F.sort_array(F.collect_list(fixed)).alias("a"))  # as many as parameter values
    mid = vals.select(F.element_at("a", (F.floor(F.size("a") / 2) + 1).cast("int")).alias("mid"))
    kept = runs.join(F.broadcast(mid), F.col(fixed) == F.col("mid"))
    return kept.groupBy(row).pivot(col, columns).agg(F.first(value))


def summary_grid(cells: dict[tuple[str, str], DataFrame], axis: str, index: int | None = None) -> DataFrame:
    """row, col, r, c, v: the same slice of a volume for each row and column of a figure."""
    out = None
    for (row, col), vox in cells.items():
        p = plane(vox, axis, index).select(F.lit(row).alias("row"), F.lit(col).alias("col"), "r", "c", "v")
        out = p if out is None else out.unionByName(p)
    return out
