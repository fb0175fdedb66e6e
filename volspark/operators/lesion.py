"""From labels to a lesion mask: foreground, scoring of clusters, pairs, clean-up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volspark.functions.pointwise import positive_shift, zscore
from volspark.functions.stats import calinski_harabasz, percentiles, robust_stats, silhouette
from volspark.operators import regions
from volspark.operators.denoise import with_hash
from volspark.operators.stencil import gradient_magnitude
from volspark.operators.threshold import METHODS
from volspark.schema import KEYS
from volspark.session import cut
from volspark.sources.grids import extents

#: Weights of tail, compactness and edge support, and the lead a pair needs (fixed values).
TAIL, COMPACT, EDGE, PAIR_LEAD = 0.5, 0.25, 0.25, 0.05


def foreground(vox: DataFrame, threshold: float | str, close_radius: int = 1, open_radius: int = 1, erode_radius: int = 0, least: int = 50, largest: bool = True, least_part: int = 1) -> DataFrame:
    """Threshold (a number, or the method of a histogram threshold), closing, opening, holes filled, then the largest component, or all of at least
    least_part voxels; optional erosion, after which the same choice is made. The volume's border erodes nothing. An error if fewer than least
    voxels are left in any of the volumes."""
    bounds = extents(vox)
    if isinstance(threshold, str):
        m = vox.join(F.broadcast(METHODS[threshold](vox).select("vol_id", "threshold")), "vol_id").where(F.col("v") > F.col("threshold")).select(*KEYS)
    else:
        m = vox.where(F.col("v") > threshold).select(*KEYS)
    if close_radius:
        m = cut(regions.safe_closing(m, regions.ball(close_radius), bounds))
    if open_radius:
        m = cut(regions.safe_opening(m, regions.ball(open_radius), vox))
    parts = lambda m: regions.keep_components(cut(regions.components(m)), 1 if largest else least_part, 1 if largest else None).select(*KEYS)
    m = parts(cut(regions.fill_holes(m, vox)))
    if erode_radius:
        m = parts(regions.erode(m, regions.ball(erode_radius), vox))
    m = cut(m)
    sizes = bounds.select("vol_id").join(m.groupBy("vol_id").agg(F.count("*").alias("n")), "vol_id", "left")
    if least and (small := sizes.where(F.coalesce("n", F.lit(0)) < least).agg(F.count("*"), F.min("vol_id")).first())[0]:
        raise ValueError(f"the foreground has fewer than {least} voxels in {small[0]} volumes, {small[1]} being one")
    return m


def compactness(mask: DataFrame, by: list[str]) -> DataFrame:
    """by, largest, compact: voxels of the largest face-connected part over those of its bounding box. by: vol_id and a label; parts of different labels are apart."""
    named = mask.withColumn("vol_id", F.concat_ws("#", *by))
    labelled = cut(regions.components(named))
    box = " * ".join(f"(max({a}) - min({a}) + 1)" for a in "zyx")
    sized = labelled.groupBy("vol_id", "component").agg(F.count("*").alias("n"), F.expr(f"cast(count(*) as double) / ({box})").alias("compact"))
    first = sized.withColumn("k", F.row_number().over(Window.partitionBy("vol_id").orderBy(F.desc("n"), "component"))).where("k = 1")
    return first.select(F.regexp_replace("vol_id", "#[^#]*$", "").alias("vol_id"), F.substring_index("vol_id", "#", -1).cast("int").alias("label"), F.col("n").alias("largest"), "compact")


def edge_support(mask: DataFrame, grad: DataFrame, roi_mean: DataFrame, bounds: DataFrame) -> DataFrame:
    """vol_id, label, edge: mean gradient on the one-voxel outer ring over the ROI's mean, a third of it, at most 1."""
    named = mask.withColumn("vol_id", F.concat_ws("#", "vol_id", "label"))
    b = mask.select("vol_id", "label").distinct().join(bounds, "vol_id").withColumn("vol_id", F.concat_ws("#", "vol_id", "label")).drop("label")
    ring = regions.ring(named, regions.CROSS, b)
    ring = ring.select(F.regexp_replace("vol_id", "#[^#]*$", "").alias("vol_id"), F.substring_index("vol_id", "#", -1).cast("int").alias("label"), "z", "y", "x")
    m = ring.join(grad.select(*KEYS, F.col("v").alias("g")), KEYS).groupBy("vol_id", "label").agg(F.avg("g").alias("ring"))
    return m.join(roi_mean, "vol_id").select("vol_id", "label", F.least(F.col("ring") / F.col("roi_grad") / 3, F.lit(1.0)).alias("edge"))


def _tail(mean: Column, mode: str) -> Column:
    bright = F.least(F.greatest((mean - F.col("p90")) / F.col("iqr"), F.lit(0.0)), F.lit(1.0))
    dark = F.least(F.greatest((F.col("p10") - mean) / F.col("iqr"), F.lit(0.0)), F.lit(1.0))
    return {"bright": bright, "dark": dark}.get(mode, F.when(F.col("bright_side"), bright).otherwise(dark))


def measured(labelled: DataFrame, vox: DataFrame, paired: bool = True) -> DataFrame:
    """What the choice of clusters needs of the voxels, whatever its rule. labelled: ROI voxels vol_id, z, y, x, v, label (from 0 on). A row for each cluster
    and, if paired, each two clusters adjacent in mean intensity, whose label is negative and numbers them: labels, size, mean_intensity, compactness,
    edge_support, n_roi (the ROI's voxels), median, p10, p90, iqr and bright_side of the ROI. All of them are measured together."""
    means = cut(labelled.groupBy("vol_id", "label").agg(F.count("*").alias("size"), F.avg("v").alias("mean_intensity")))
    rows, masks = means.select("vol_id", "label", F.array("label").alias("labels"), "size", "mean_intensity"), labelled.select(*KEYS, "label")
    if paired:
        order = Window.partitionBy("vol_id").orderBy("mean_intensity", "label")
        ahead = [F.lead(c).over(order).alias(f"next_{c}") for c in ("label", "size", "mean_intensity")]
        pairs = cut(means.select("*", *ahead, (-F.row_number().over(order)).alias("pair")).where("next_label is not null"))
        n = F.col("size") + F.col("next_size")
        mean = (F.col("size") * F.col("mean_intensity") + F.col("next_size") * F.col("next_mean_intensity")) / n
        rows = rows.unionByName(pairs.select("vol_id", F.col("pair").alias("label"), F.array("label", "next_label").alias("labels"), n.alias("size"), mean.alias("mean_intensity")))
        own = F.broadcast(pairs.select("vol_id", F.explode(F.array("label", "next_label")).alias("label"), "pair"))
        masks = masks.unionByName(labelled.join(own, ["vol_id", "label"]).select(*KEYS, F.col("pair").alias("label")))
    masks = cut(masks)
    grad = cut(gradient_magnitude(vox))
    roi_grad = cut(labelled.select(*KEYS).join(grad, KEYS).groupBy("vol_id").agg((F.avg("v") + 1e-8).alias("roi_grad")))
    compact = compactness(masks, ["vol_id", "label"]).select("vol_id", "label", F.col("compact").alias("compactness"))
    edge = edge_support(masks, grad, roi_grad, extents(vox)).withColumnRenamed("edge", "edge_support")
    sides = means.groupBy("vol_id").agg(F.sum("size").alias("n_roi"), F.min("mean_intensity").alias("m0"), F.max("mean_intensity").alias("m1"))
    out = rows.join(robust_stats(labelled), "vol_id").join(sides, "vol_id").withColumn("bright_side", (F.col("m1") - F.col("median")) >= (F.col("median") - F.col("m0")))
    return cut(out.drop("m0", "m1").join(compact, ["vol_id", "label"]).join(edge, ["vol_id", "label"], "left").na.fill(0.0, ["edge_support"]))


def _scored(measures: DataFrame, tail: str) -> DataFrame:
    out = measures.withColumn("tail_extremeness", _tail(F.col("mean_intensity"), tail))
    return out.withColumn("score", TAIL * F.col("tail_extremeness") + COMPACT * F.col("compactness") + EDGE * F.col("edge_support"))


def _admissible(scored: DataFrame, min_fraction: float, max_fraction: float) -> DataFrame:
    return scored.where((F.col("label") >= 0) & (F.col("size") / F.col("n_roi")).between(min_fraction, max_fraction))


def score_clusters(labelled: DataFrame, vox: DataFrame, tail: str = "auto", min_fraction: float = 0.001, max_fraction: float = 0.25) -> DataFrame:
    """labelled: ROI voxels vol_id, z, y, x, v, label. A row for each cluster of an admissible share of the ROI: size, mean_intensity,
    tail_extremeness, compactness, edge_support, score."""
    out = _admissible(_scored(measured(labelled, vox, paired=False), tail), min_fraction, max_fraction)
    return out.select("vol_id", "label", "size", "mean_intensity", "tail_extremeness", "compactness", "edge_support", "score")


def pick_clusters(labelled: DataFrame, vox: DataFrame, tail: str = "auto", min_fraction: float = 0.001, max_fraction: float = 0.25) -> DataFrame:
    """vol_id, labels, score: the best single cluster, or a pair of clusters adjacent in mean intensity that beats it by more than 0.05; without an
    admissible cluster the brightest (for tail dark the darkest) with no score."""
    return pick(measured(labelled, vox), tail, min_fraction, max_fraction)


def pick(measures: DataFrame, tail: str = "auto", min_fraction: float = 0.001, max_fraction: float = 0.25) -> DataFrame:
    """pick_clusters() by the rows of measured(), which serve any number of rules. Shares and statistics of a pair are those of the whole ROI; a pair has
    no lower limit."""
    scored = _scored(measures, tail)
    first = lambda df, *by: df.withColumn("k", F.row_number().over(Window.partitionBy("vol_id").orderBy(*by))).where("k = 1")
    best = first(_admissible(scored, min_fraction, max_fraction), F.desc("score"), "label").select("vol_id", F.col("labels").alias("best_labels"), "score")
    pairs = scored.where((F.col("label") < 0) & (F.col("size") <= max_fraction * F.col("n_roi")))
    top = first(pairs, F.desc("score"), F.desc("label")).select("vol_id", F.col("labels").alias("pair_labels"), F.col("score").alias("pair_score"))
    edge = F.asc("mean_intensity") if tail == "dark" else F.desc("mean_intensity")
    last = first(measures.where("label >= 0"), edge, "label").select("vol_id", F.col("labels").alias("fallback"))
    out = last.join(best, "vol_id", "left").join(top, "vol_id", "left")
    wins = F.col("pair_score") > F.col("score") + PAIR_LEAD
    return out.select("vol_id", F.when(wins, F.col("pair_labels")).otherwise(F.coalesce("best_labels", "fallback")).alias("labels"), F.when(wins, F.col("pair_score")).otherwise(F.col("score")).alias("score"))


def clean_mask(mask: DataFrame, vox: DataFrame, least: int = 50, top: int = 3) -> DataFrame:
    """Components of at least so many voxels, the top of them, closed by the face structure, holes filled."""
    kept = regions.keep_components(cut(regions.components(mask)), least, top).select(*KEYS)
    closed = cut(regions.closing(kept, regions.CROSS, extents(vox)))
    return regions.fill_holes(closed, vox)


def stratified_sample(labelled: DataFrame, grad: DataFrame, total: int = 20_000, seed: int = 42) -> DataFrame:
    """Of each cluster max(50, total // k) voxels: half from gradients of at least the cluster's 75th percentile, half from below; small
    clusters whole, and a cluster one of whose pools is empty gives its whole quota from all its voxels. Which voxels: those of smallest
    noise number, so the sample does not depend on partitioning."""
    return _drawn(_pooled(labelled, grad), total, seed)


def _pooled(labelled: DataFrame, grad: DataFrame) -> DataFrame:
    """What a sample needs of the voxels whatever its seed: vol_id, z, y, x, v, label, at_edge, and size, edges (of the label) and k."""
    g = cut(labelled.join(grad.select(*KEYS, F.col("v").alias("g")), KEYS))
    edge = percentiles(g.select("vol_id", "label", F.col("g").alias("v")), [0.75], "label").select("vol_id", "label", F.col("p")[0].alias("p75"))
    s = g.join(F.broadcast(edge), ["vol_id", "label"]).withColumn("at_edge", F.col("g") >= F.col("p75"))
    size = s.groupBy("vol_id", "label").agg(F.count("*").alias("size"), F.count_if("at_edge").alias("edges"))
    k = size.groupBy("vol_id").agg(F.count("*").alias("k"))
    return s.drop("g", "p75").join(F.broadcast(size), ["vol_id", "label"]).join(F.broadcast(k), "vol_id")


def _drawn(pooled: DataFrame, total: int, seed: int) -> DataFrame:
    s = pooled.withColumn("quota", F.greatest(F.lit(50), F.floor(F.lit(total) / F.col("k"))))
    s = s.withColumn("pool", F.when(F.col("edges") == F.col("size"), False).otherwise(F.col("at_edge")))
    s = with_hash(s, "u", seed)
    # of a pool the smallest numbers: a bound from counts of their upper halves first, so that no task orders a whole pool
    half = F.floor(F.col("quota") / 2)
    share = F.when(F.col("edges") == F.col("size"), F.col("quota")).when(F.col("pool"), half).otherwise(F.col("quota") - half)
    s = s.withColumn("share", F.when(F.col("size") <= F.col("quota"), F.col("size")).otherwise(share)).withColumn("slot", F.shiftrightunsigned("u", 16).cast("int"))
    keys = ["vol_id", "label", "pool"]
    slots = s.groupBy(*keys, "slot").agg(F.count("*").alias("n"))
    before = slots.withColumn("before", F.sum("n").over(Window.partitionBy(*keys).orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).drop("n")
    s = s.join(before, [*keys, "slot"]).where("before < share")
    rank = F.row_number().over(Window.partitionBy(*keys, "slot").orderBy("u", "z", "y", "x"))
    return s.withColumn("r", F.col("before") + rank).where("r <= share").select(*KEYS, "v", "label")


def evaluate(labelled: DataFrame, grad: DataFrame, repeats: int = 3, total: int = 20_000, seed: int = 42) -> DataFrame:
    """vol_id, and mean and variance over repeated stratified samples of Calinski-Harabasz and silhouette: ch_mean, ch_var, silhouette_mean, silhouette_var.
    Gradients and pools are made once, and the samples are volumes of one relation, which are measured together."""
    pooled = cut(_pooled(labelled, grad))
    drawn = [_drawn(pooled, total, seed + i).withColumn("vol_id", F.concat("vol_id", F.lit(f"#{i}"))) for i in range(repeats)]
    s = cut(reduce(DataFrame.unionByName, drawn))
    rows = calinski_harabasz(s).select("vol_id", "ch").join(silhouette(s).select("vol_id", "silhouette"), "vol_id")
    rows = rows.withColumn("vol_id", F.regexp_replace("vol_id", "#[^#]*$", ""))
    return rows.groupBy("vol_id").agg(*[f(c).alias(f"{c}_{n}") for c in ("ch", "silhouette") for n, f in (("mean", F.avg), ("var", F.var_pop))])


def preprocessing_stats(vox: DataFrame, roi: Column) -> DataFrame:
    """vol_id, shift, n, min, max, mean of the ROI after the positive shift and the z-score."""
    shift = vox.where(roi).groupBy("vol_id").agg(F.greatest(F.lit(0.0), 1 - F.min("v")).alias("shift"))
    inside = zscore(positive_shift(vox, roi).join(vox.where(roi).select(*KEYS, F.lit(True).alias("roi")), KEYS), F.col("roi"))
    rows = inside.groupBy("vol_id").agg(F.count("*").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"))
    return shift.join(rows, "vol_id")
