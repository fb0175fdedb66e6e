"""Thresholds from histograms: the volume is read once for the histogram, everything after works on its bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volspark.functions.stats import histogram, percentiles


def _full(vox: DataFrame, bins: int) -> DataFrame:
    """vol_id, bin, n, lo, w for every bin, empty ones too (bins rows per volume)."""
    h = histogram(vox, bins)
    r = h.select("vol_id", "lo", "hi").distinct()
    all_bins = r.select("vol_id", "lo", ((F.col("hi") - F.col("lo")) / bins).alias("w"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return all_bins.join(h.select("vol_id", "bin", "n"), ["vol_id", "bin"], "left").na.fill(0, ["n"])


def _sums(full: DataFrame) -> DataFrame:
    """Adds running and total counts and first moments (of bin numbers)."""
    run = Window.partitionBy("vol_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("vol_id")
    m = F.col("n") * F.col("bin")
    return full.withColumns({"c": F.sum("n").over(run), "m": F.sum(m).over(run), "n_all": F.sum("n").over(whole), "m_all": F.sum(m).over(whole)})


def _best(rows: DataFrame, score: str, ascending: bool = False, then: str = "bin") -> DataFrame:
    order = F.asc_nulls_last(score) if ascending else F.desc_nulls_last(score)
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("vol_id").orderBy(order, then))).where("k = 1")


def _edge() -> Column:
    """Upper edge of a bin."""
    return F.col("lo") + (F.col("bin") + 1) * F.col("w")


def otsu(vox: DataFrame, bins: int = 128) -> DataFrame:
    """vol_id, bin, threshold: greatest between-class variance w0 w1 (m0 - m1)^2; the first of equals."""
    s = _sums(_full(vox, bins)).where("c > 0 and c < n_all")
    d = F.col("m") / F.col("c") - (F.col("m_all") - F.col("m")) / (F.col("n_all") - F.col("c"))
    s = s.withColumn("score", F.col("c").cast("double") * (F.col("n_all") - F.col("c")) * d * d)
    return _best(s, "score").select("vol_id", "bin", _edge().alias("threshold"))


def multi_otsu(vox: DataFrame, classes: int, bins: int = 128) -> DataFrame:
    """classes - 1 cuts (1 to 3) of the greatest between-class variance: a join of bins with later bins over prefix sums."""
    if classes not in (2, 3, 4):
        raise ValueError("2, 3 or 4 classes")
    s = _sums(_full(vox, bins)).select("vol_id", "bin", "c", "m", "n_all", "m_all", "lo", "w")
    cuts = s.select("vol_id", "lo", "w", "n_all", "m_all", F.col("bin").alias("t1"), F.col("c").alias("c1"), F.col("m").alias("m1"))
    for i in range(2, classes):
        nxt = s.select(F.col("vol_id").alias("v"), F.col("bin").alias(f"t{i}"), F.col("c").alias(f"c{i}"), F.col("m").alias(f"m{i}"))
        cuts = cuts.join(nxt, (F.col("vol_id") == F.col("v")) & (F.col(f"t{i}") > F.col(f"t{i - 1}"))).drop("v")
    part = lambda c, m: F.when(c > 0, m * m / c).otherwise(0.0)
    ends = [(F.lit(0), F.lit(0)), *[(F.col(f"c{i}"), F.col(f"m{i}")) for i in range(1, classes)], (F.col("n_all"), F.col("m_all"))]
    score = sum((part((c2 - c1).cast("double"), (m2 - m1).cast("double")) for (c1, m1), (c2, m2) in zip(ends, ends[1:], strict=False)), F.lit(0.0))
    ts = F.array(*[F.col(f"t{i}") for i in range(1, classes)])
    best = cuts.withColumn("score", score).withColumn("bins", ts)
    best = best.withColumn("k", F.row_number().over(Window.partitionBy("vol_id").orderBy(F.desc("score"), "bins"))).where("k = 1")
    return best.select("vol_id", "bins", F.transform("bins", lambda t: F.col("lo") + (t + 1) * F.col("w")).alias("thresholds"))


def huang(vox: DataFrame, bins: int = 128) -> DataFrame:
    """Huang and Wang (1995): least fuzzy entropy, membership 1 / (1 + |g - mean of its class| / C), C the range of filled bins."""
    s = _sums(_full(vox, bins))
    filled = s.where("n > 0").groupBy("vol_id").agg(F.min("bin").alias("b0"), F.max("bin").alias("b1"))
    t = s.join(filled, "vol_id").where("bin >= b0 and bin < b1")
    g = s.where("n > 0").select(F.col("vol_id").alias("v"), F.col("bin").alias("g"), F.col("n").alias("gn"))
    p = t.join(g, F.col("vol_id") == F.col("v"))
    mean = F.when(F.col("g") <= F.col("bin"), F.col("m") / F.col("c")).otherwise((F.col("m_all") - F.col("m")) / (F.col("n_all") - F.col("c")))
    mu = 1 / (1 + F.abs(F.col("g") - mean) / (F.col("b1") - F.col("b0")))
    e = F.when((mu > 0) & (mu < 1), -mu * F.log(mu) - (1 - mu) * F.log(1 - mu)).otherwise(0.0)
    e = p.groupBy("vol_id", "bin", "lo", "w").agg(F.sum(F.col("gn") * e).alias("score"))
    return _best(e.withColumn("score", F.round("score", 6)), "score", True).select("vol_id", "bin", _edge().alias("threshold"))


def triangle(vox: DataFrame, bins: int = 128) -> DataFrame:
    """Zack (1977): the bin farthest under the line from the peak to the farther end of the histogram."""
    f = _full(vox, bins)
    peak = _best(f.withColumn("score", F.col("n")), "score").select("vol_id", F.col("bin").alias("pk"), F.col("n").alias("pn"))
    ends = f.where("n > 0").groupBy("vol_id").agg(F.min("bin").alias("b0"), F.max("bin").alias("b1"))
    end = F.when(F.col("b1") - F.col("pk") >= F.col("pk") - F.col("b0"), F.col("b1")).otherwise(F.col("b0"))
    s = f.join(peak, "vol_id").join(ends, "vol_id").withColumn("end", end).where("bin between least(pk, end) and greatest(pk, end)")
    en = s.where("bin = end").select(F.col("vol_id").alias("v"), F.col("n").alias("en"))
    s = s.join(en, F.col("vol_id") == F.col("v"))
    # twice the area of peak, end and bin: in proportion to the distance from the line
    area = F.abs((F.col("end") - F.col("pk")) * (F.col("pn") - F.col("n")) - (F.col("pk") - F.col("bin")) * (F.col("en") - F.col("pn")))
    return _best(s.withColumn("score", area), "score").select("vol_id", "bin", _edge().alias("threshold"))


def li(vox: DataFrame, bins: int = 128) -> DataFrame:
    """Li and Lee (1993): least cross-entropy over all cuts; levels are bin numbers plus one, so that logarithms exist."""
    f = _full(vox, bins).withColumn("n1", F.col("n") * (F.col("bin") + 1))
    run = Window.partitionBy("vol_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("vol_id")
    s = f.withColumns({"c": F.sum("n").over(run), "m": F.sum("n1").over(run), "n_all": F.sum("n").over(whole), "m_all": F.sum("n1").over(whole)}).where("c > 0 and c < n_all")
    rest = F.col("m_all") - F.col("m")
    score = -(F.col("m") * F.log(F.col("m") / F.col("c")) + rest * F.log(rest / (F.col("n_all") - F.col("c"))))
    return _best(s.withColumn("score", F.round(score, 6)), "score", True).select("vol_id", "bin", _edge().alias("threshold"))


def percentile_threshold(vox: DataFrame, p: float) -> DataFrame:
    """vol_id, lower (percentile of v > 0), upper (maximum + 1)."""
    top = vox.groupBy("vol_id").agg((F.max("v") + 1).alias("upper"))
    return percentiles(vox.where("v > 0"), [p]).select("vol_id", F.col("p")[0].alias("lower")).join(top, "vol_id")


METHODS = {"otsu": otsu, "huang": huang, "triangle": triangle, "li": li}


def bin_sweep(vox: DataFrame, bins: list[int] = [32, 64, 128, 256], methods: list[str] = ["otsu", "huang", "triangle"]) -> DataFrame:  # noqa: B006
    """method, bins, bin, threshold: one histogram per bin count, one small plan per method."""
    out = None
    for b in bins:
        for m in methods:
            row = METHODS[m](vox, b).select("vol_id", F.lit(m).alias("method"), F.lit(b).alias("bins"), "bin", "threshold")
            out = row if out is None else out.unionByName(row)
    return out


def apply_cuts(vox: DataFrame, cuts: DataFrame) -> DataFrame:
    """label = number of thresholds under v; cuts: vol_id, thresholds."""
    return vox.join(F.broadcast(cuts), "vol_id").select("vol_id", "z", "y", "x", F.size(F.filter("thresholds", lambda t: F.col("v") > t)).alias("label"), "v")


def class_limits(vox: DataFrame, cuts: DataFrame) -> DataFrame:
    """[0, thresholds rounded to two places ..., max]."""
    top = vox.groupBy("vol_id").agg(F.max("v").alias("top"))
    return cuts.join(top, "vol_id").select("vol_id", F.concat(F.array(F.lit(0.0)), F.transform("thresholds", lambda t: F.round(t, 2)), F.array("top")).alias("limits"))
