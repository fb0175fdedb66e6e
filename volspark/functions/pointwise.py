"""Voxel-wise operators: Column to Column where no statistic is needed, else over a small aggregate per volume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volspark.functions.stats import percentiles
from volspark.schema import KEYS


def binary_threshold(v: Column, lower: Column | float, upper: Column | float, inside: int = 1, outside: int = 0) -> Column:
    """inside where lower <= v <= upper."""
    return F.when(v.between(lower, upper), F.lit(inside)).otherwise(F.lit(outside))


def sigmoid(v: Column, alpha: float, beta: float) -> Column:
    """1 / (1 + exp(-(v - beta) / alpha)); a negative alpha inverts."""
    return 1.0 / (1.0 + F.exp(-(v - beta) / alpha))


def to_uint8(v: Column) -> Column:
    """Clipped to 0..255, truncated."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), v))).cast("int")


#: Names of the classes of each organ (fixed values).
TISSUES = {
    "brain": {0: "Fondo / CSF", 1: "Sustancia gris", 2: "Sustancia blanca", 3: "Tumor (hiper.)"},
    "breast": {0: "Fondo", 1: "Tejido oscuro", 2: "Tejido intermedio", 3: "Tumor (hiper.)"},
    "liver": {0: "Fondo", 1: "Tejido hepático", 2: "Tejido hiper.", 3: "Tumor (hiper.)"},
}


def tissue(organ: Column, label: Column) -> Column:
    """The name of an organ's class; null for others."""
    names = F.create_map(*[F.lit(x) for o, by in TISSUES.items() for i, name in by.items() for x in (f"{o}:{i}", name)])
    return F.element_at(names, F.concat(organ, F.lit(":"), label.cast("string")))


def clamp(i: Column, low: Column | int, high: Column | int) -> Column:
    """i, not under low nor over high."""
    wrap = lambda c: c if isinstance(c, Column) else F.lit(c)
    return F.greatest(wrap(low), F.least(wrap(high), i))


def file_stem(path: Column) -> Column:
    """The name without folders and without .nii.gz, .nii or .mha."""
    return F.regexp_replace(F.regexp_extract(path, r"[^/\\]*$", 0), r"\.(nii\.gz|nii|mha)$", "")


def zscore(vox: DataFrame, roi: Column) -> DataFrame:
    """(v - mean) / std of the ROI (population; a std under 1e-6 is 1); 0 outside."""
    s = vox.where(roi).groupBy("vol_id").agg(F.avg("v").alias("mu"), F.stddev_pop("v").alias("sd"))
    sd = F.when(F.col("sd") < 1e-6, 1.0).otherwise(F.col("sd"))
    return vox.withColumn("in_roi", roi).join(F.broadcast(s), "vol_id", "left").select(*KEYS, F.when(F.col("in_roi"), (F.col("v") - F.col("mu")) / sd).otherwise(0.0).alias("v"))


def robust_minmax(vox: DataFrame, roi: Column) -> DataFrame:
    """(v - p1) / (p99 - p1) of the ROI, span at least 1e-6, clipped to 0..1; 0 outside. Percentiles are exact."""
    s = percentiles(vox.where(roi), [0.01, 0.99])
    span = F.greatest(F.col("p")[1] - F.col("p")[0], F.lit(1e-6))
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("v") - F.col("p")[0]) / span))
    return vox.withColumn("in_roi", roi).join(F.broadcast(s), "vol_id", "left").select(*KEYS, F.when(F.col("in_roi"), t).otherwise(0.0).alias("v"))


def positive_shift(vox: DataFrame, roi: Column) -> DataFrame:
    """Adds 1 - min over the ROI to the whole volume if that minimum is under 1."""
    s = vox.where(roi).groupBy("vol_id").agg(F.min("v").alias("mn"))
    return vox.join(F.broadcast(s), "vol_id", "left").select(*KEYS, (F.col("v") + F.when(F.col("mn") < 1, 1 - F.col("mn")).otherwise(0.0)).alias("v"))


def remove_log_bias(vox: DataFrame, bias: DataFrame) -> DataFrame:
    """v / exp(b) for a log-bias grid of the same shape."""
    b = bias.select(*KEYS, F.col("v").alias("b"))
    return vox.join(b, KEYS).select(*KEYS, (F.col("v") / F.exp("b")).alias("v"))


def crop_keep_shape(vox: DataFrame, z: tuple[int, int], y: tuple[int, int], x: tuple[int, int]) -> DataFrame:
    """0 outside the half-open box; the shape stays."""
    inside = F.lit(True)
    for a, (lo, hi) in (("z", z), ("y", y), ("x", x)):
        inside = inside & (F.col(a) >= lo) & (F.col(a) < hi)
    return vox.select(*KEYS, F.when(inside, F.col("v")).otherwise(0.0).alias("v"))


def shrink(vox: DataFrame, factor: int) -> DataFrame:
    """Every factor-th voxel from factor // 2 on, renumbered."""
    at = [F.pmod(F.col(a), F.lit(factor)) == factor // 2 for a in "zyx"]
    return vox.where(at[0] & at[1] & at[2]).select("vol_id", *[F.expr(f"cast({a} div {factor} as int)").alias(a) for a in "zyx"], "v")


def plane(vox: DataFrame, axis: str, index: int | None = None) -> DataFrame:
    """vol_id, r, c, v of one slice; without an index the middle one, size // 2. A filter on one axis, so scans can prune."""
    r, c = [a for a in "zyx" if a != axis]
    if index is None:
        mid = vox.groupBy("vol_id").agg(F.expr(f"cast((max({axis}) + 1) div 2 as int)").alias("mid"))
        picked = vox.join(mid, (vox["vol_id"] == mid["vol_id"]) & (vox[axis] == mid["mid"]), "left_semi")
    else:
        picked = vox.where(F.col(axis) == index)
    return picked.select("vol_id", F.col(r).alias("r"), F.col(c).alias("c"), "v")


def rotate_ccw(sl: DataFrame) -> DataFrame:
    """A slice (vol_id, r, c, v) turned 90 degrees counter-clockwise."""
    w = sl.groupBy("vol_id").agg(F.max("c").alias("w"))
    return sl.join(w, "vol_id").select("vol_id", (F.col("w") - F.col("c")).alias("r"), F.col("r").alias("c"), "v")
