"""Aggregates over voxel relations. Exact percentiles run over value counts, so a group needs its distinct values only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volspark.schema import KEYS

#: Percentile pairs of each organ: a wide and a narrow range (fixed values).
ORGAN_PERCENTILES = {"brain": ((0.75, 0.99), (0.85, 0.99)), "breast": ((0.70, 0.95), (0.80, 0.95)), "liver": ((0.30, 0.65), (0.40, 0.60))}
#: Manual intensity ranges (fixed values).
ORGAN_RANGES = {"brain": (173.0, 360.0), "breast": (330.0, 750.0), "liver": (44.0, 85.0)}
PERCENTILES = [0.25, 0.30, 0.40, 0.50, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95, 0.99]


def value_counts(vox: DataFrame, *by: str) -> DataFrame:
    return vox.groupBy("vol_id", *by, "v").agg(F.count("*").alias("n"))


#: Buckets of a group's range, so that no task sorts or holds all its distinct values.
BUCKETS = 4096


def _in_buckets(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Value counts with the bucket of each value, and the count of all values of the group."""
    r = counts.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("n").alias("n_all"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(BUCKETS - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BUCKETS).cast("int"))).otherwise(0)
    return counts.join(F.broadcast(r), keys).withColumn("bucket", at)


def percentiles(vox: DataFrame, ps: list[float], *by: str) -> DataFrame:
    """vol_id, by, p: exact, linearly interpolated.

    Values are counted once; the counts of equal buckets of a group's range tell which buckets hold the wanted ranks, and only these are
    ordered, each by a running sum of its own. So no task holds the distinct values of a volume."""
    keys = ["vol_id", *by]
    t = _in_buckets(value_counts(vox, *by).where("v is not null"), keys)
    c = t.groupBy(*keys, "bucket").agg(F.sum("n").alias("k"), F.any_value("n_all").alias("n_all"))
    c = c.withColumn("stop", F.sum("k").over(Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
    wanted = F.posexplode(F.array(*[F.lit(float(p)) for p in ps]))
    place = (F.col("p") * (F.col("n_all") - 1)).alias("place")
    low = F.floor("place")
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), low.alias("rank")), F.struct(F.lit(1).alias("side"), F.least(low + 1, F.col("n_all") - 1).alias("rank")))).alias("s")
    ranks = c.select(*keys, "bucket", "n_all", "stop", (F.col("stop") - F.col("k")).alias("start"), wanted.alias("i", "p")).select("*", place)
    ranks = ranks.select(*keys, "bucket", "start", "stop", "i", (F.col("place") - low).alias("frac"), sides).where("s.rank >= start and s.rank < stop")
    held = ranks.select(*keys, "bucket", "start").distinct()
    run = F.sum("n").over(Window.partitionBy(*keys, "bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    inside = t.select(*keys, "bucket", "v", "n").join(held, [*keys, "bucket"]).withColumn("c", F.col("start") + run).drop("start")
    hit = inside.join(ranks.select(*keys, "bucket", "i", "frac", "s"), [*keys, "bucket"]).where("s.rank < c and s.rank >= c - n")
    value = lambda side: F.max(F.when(F.col("s.side") == side, F.col("v")))
    one = hit.groupBy(*keys, "i", "frac").agg((value(0) + (value(1) - value(0)) * F.col("frac")).alias("q"))
    return one.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "q"))), lambda r: r["q"]).alias("p"))


def describe(vox: DataFrame) -> DataFrame:
    return vox.groupBy("vol_id").agg(F.count("*").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def histogram(vox: DataFrame, bins: int) -> DataFrame:
    """vol_id, bin, n over the volume's range; the last bin's right edge is closed; a constant volume fills bin 0; empty bins are left out."""
    r = vox.groupBy("vol_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    b = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins).cast("int"))).otherwise(0)
    return vox.join(F.broadcast(r), "vol_id").groupBy("vol_id", "lo", "hi", b.alias("bin")).agg(F.count("*").alias("n"))


def label_counts(labels: DataFrame, label: str = "label") -> DataFrame:
    n = labels.groupBy("vol_id", label).agg(F.count("*").alias("n"))
    return n.withColumn("percent", F.col("n") * F.lit(100.0) / F.sum("n").over(Window.partitionBy("vol_id")))


def by_slice(vox: DataFrame, measure: Column) -> DataFrame:
    """vol_id, axis, idx, m for each slice of each axis, in one pass by grouping sets."""
    axis = F.when(F.grouping("z") == 0, "z").when(F.grouping("y") == 0, "y").otherwise("x")
    sets = vox.groupingSets([[F.col("vol_id"), F.col(a)] for a in "zyx"], F.col("vol_id"), F.col("z"), F.col("y"), F.col("x"))
    return sets.agg(axis.alias("axis"), F.coalesce("z", "y", "x").alias("idx"), measure.alias("m")).select("vol_id", "axis", "idx", "m")


def focus_slices(slices: DataFrame) -> DataFrame:
    """The slice of the greatest measure of each axis; the first of equals."""
    w = Window.partitionBy("vol_id", "axis").orderBy(F.desc("m"), "idx")
    return slices.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def presence(mask: DataFrame) -> DataFrame:
    """First, last and peak slice of a mask's voxels per axis."""
    s = by_slice(mask, F.count("*"))
    ends = s.groupBy("vol_id", "axis").agg(F.min("idx").alias("first"), F.max("idx").alias("last"))
    return ends.join(focus_slices(s).select("vol_id", "axis", F.col("idx").alias("peak"), F.col("m").alias("peak_n")), ["vol_id", "axis"])


def bounding_box(mask: DataFrame) -> DataFrame:
    return mask.groupBy("vol_id").agg(*[f(a).alias(f"{n}_{a}") for a in "zyx" for f, n in ((F.min, "lo"), (F.max, "hi"))], F.count("*").alias("n"))


def mse_psnr(reference: DataFrame, other: DataFrame) -> DataFrame:
    """vol_id, n, mse, psnr = 10 log10(max(reference)^2 / mse), infinite where the mse is 0. Volumes of different shape are left out."""
    a, b = reference.select(*KEYS, "v"), other.select(*KEYS, F.col("v").alias("w"))
    size = lambda d, n: d.groupBy("vol_id").agg(F.count("*").alias(n))
    s = a.join(b, KEYS).groupBy("vol_id").agg(F.count("*").alias("n"), F.avg(F.pow(F.col("v") - F.col("w"), 2)).alias("mse"), F.max("v").alias("top"))
    s = s.join(size(a, "n_a"), "vol_id").join(size(b, "n_b"), "vol_id").where("n = n_a and n = n_b")
    return s.select("vol_id", "n", "mse", F.when(F.col("mse") > 0, 10 * F.log10(F.col("top") * F.col("top") / F.col("mse"))).otherwise(float("inf")).alias("psnr"))


def robust_stats(vox: DataFrame) -> DataFrame:
    """median, p10, p90 and IQR (at least 1e-6)."""
    p = percentiles(vox, [0.10, 0.25, 0.50, 0.75, 0.90])
    return p.select("vol_id", F.col("p")[2].alias("median"), F.col("p")[0].alias("p10"), F.col("p")[4].alias("p90"), F.greatest(F.col("p")[3] - F.col("p")[1], F.lit(1e-6)).alias("iqr"))


def organ_ranges(vox: DataFrame) -> DataFrame:
    """vol_id, organ, kind, lower, upper from percentiles of v > 0."""
    ps = sorted({p for pair in ORGAN_PERCENTILES.values() for r in pair for p in r})
    at = {p: i for i, p in enumerate(ps)}
    got = percentiles(vox.where("v > 0"), ps)
    rows = [F.struct(F.lit(o).alias("organ"), F.lit(k).alias("kind"), F.col("p")[at[a]].alias("lower"), F.col("p")[at[b]].alias("upper")) for o, pair in ORGAN_PERCENTILES.items() for k, (a, b) in zip(("wide", "narrow"), pair, strict=True)]
    return got.select("vol_id", F.explode(F.array(*rows)).alias("r")).select("vol_id", "r.*")


def calinski_harabasz(labelled: DataFrame) -> DataFrame:
    """vol_id, k, ch of labelled values (vol_id, label, v): B / (k - 1) over W / (n - k); null where undefined."""
    c = labelled.groupBy("vol_id", "label").agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s"))
    t = labelled.groupBy("vol_id").agg(F.avg("v").alias("mean"))
    s = c.join(t, "vol_id").groupBy("vol_id").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(F.col("m") - F.col("mean"), 2)).alias("b"), F.sum(F.col("n") * F.col("s")).alias("w"))
    ok = (F.col("k") > 1) & (F.col("n") > F.col("k")) & (F.col("w") > 0)
    return s.select("vol_id", "k", F.when(ok, (F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("n") - F.col("k")))).alias("ch"))


def silhouette(labelled: DataFrame) -> DataFrame:
    """Exact mean silhouette of 1-D values by prefix sums over distinct values of each cluster: no pair of values is ever formed.

    For a value v and a cluster, the sum of |v - u| follows from the count and sum of members up to v. Each distinct (label, value) meets
    every cluster's prefix up to it in one running window over the union of values, so work is values times clusters.
    """
    n = labelled.groupBy("vol_id", "label", "v").agg(F.count("*").alias("n"))
    tot = n.groupBy("vol_id", "label").agg(F.sum("n").alias("size"), F.sum(F.col("n") * F.col("v")).alias("total"))
    grid = n.select("vol_id", "v").distinct().join(F.broadcast(tot.withColumnRenamed("label", "other")), "vol_id")
    own = n.select("vol_id", F.col("label").alias("other"), "v", "n")
    g = grid.join(own, ["vol_id", "other", "v"], "left").na.fill(0, ["n"])
    at = _in_buckets(n.groupBy("vol_id", "v").agg(F.sum("n").alias("n")), ["vol_id"]).select("vol_id", "v", "bucket")
    g = g.join(at, ["vol_id", "v"])
    # prefix sums in two steps: of the buckets, and inside each
    sums = g.groupBy("vol_id", "other", "bucket").agg(F.sum("n").alias("c0"), F.sum(F.col("n") * F.col("v")).alias("s0"))
    before = Window.partitionBy("vol_id", "other").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("vol_id", "other", "bucket", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("c0", "s0")])
    w = Window.partitionBy("vol_id", "other", "bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    g = g.join(sums, ["vol_id", "other", "bucket"]).withColumn("c", F.col("c0") + F.sum("n").over(w)).withColumn("s", F.col("s0") + F.sum(F.col("n") * F.col("v")).over(w))
    away = F.col("v") * F.col("c") - F.col("s") + (F.col("total") - F.col("s")) - F.col("v") * (F.col("size") - F.col("c"))
    d = g.select("vol_id", "other", "v", "size", away.alias("away"))
    p = n.join(d, ["vol_id", "v"])
    mean = F.when(F.col("other") == F.col("label"), F.col("away") / (F.col("size") - 1)).otherwise(F.col("away") / F.col("size"))
    ab = p.groupBy("vol_id", "label", "v", "n").agg(F.max(F.when(F.col("other") == F.col("label"), F.when(F.col("size") > 1, mean))).alias("a"), F.min(F.when(F.col("other") != F.col("label"), mean)).alias("b"))
    s = F.when(F.col("a").isNull() | (F.greatest("a", "b") == 0), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return ab.groupBy("vol_id").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * s) / F.sum("n")).alias("silhouette"))


def focus_or(first: DataFrame, second: DataFrame, vox: DataFrame) -> DataFrame:
    """vol_id, axis, idx, source: the slice of most voxels of the first mask, where that is empty of the second, else the middle one."""
    of = lambda mask, name: focus_slices(by_slice(mask, F.count("*"))).select("vol_id", "axis", F.col("idx").alias(name))
    middle = by_slice(vox, F.count("*")).groupBy("vol_id", "axis").agg(F.expr("cast((max(idx) + 1) div 2 as int)").alias("middle"))
    all_of = middle.join(of(first, "a"), ["vol_id", "axis"], "left").join(of(second, "b"), ["vol_id", "axis"], "left")
    source = F.when(F.col("a").isNotNull(), "first").when(F.col("b").isNotNull(), "second").otherwise("middle")
    return all_of.select("vol_id", "axis", F.coalesce("a", "b", "middle").alias("idx"), source.alias("source"))


def tallies(runs: DataFrame, by: str) -> DataFrame:
    """by (null: all), n, succeeded, failed, seconds, longest of runs with ok and seconds."""
    return runs.rollup(by).agg(F.count("*").alias("n"), F.count_if("ok").alias("succeeded"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("failed"), F.sum("seconds").alias("seconds"), F.max("seconds").alias("longest"))
