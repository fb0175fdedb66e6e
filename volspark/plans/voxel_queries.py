"""Queries of voxel-wise operators, aggregates and relations, with DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volspark.functions import pointwise as P
from volspark.functions import stats as A
from volspark.plans.sqltext import GRIDS, grid, uint8
from volspark.schema import KEYS
from volspark.sources import grids as G
from volspark.sources.grids import voxels

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _r(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# --- sources and voxel-wise operators ---


@query(GRIDS["orders"])
def grid_orders(spark, sf):
    return voxels(spark, sf, "orders")


@query(GRIDS["events"])
def grid_events(spark, sf):
    return voxels(spark, sf, "events")


@query(GRIDS["embeddings"])
def grid_embeddings(spark, sf):
    return voxels(spark, sf, "embeddings")


@query(f"WITH {grid('events')} SELECT vol_id, z, y, x, CAST(floor((v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) * 65535.0) AS INTEGER) AS v FROM g")
def rescale_uint16(spark, sf):
    return G.rescale_uint16(voxels(spark, sf, "events"))


@query(f"WITH {grid('events')} SELECT * FROM {uint8()}")
def normalise_uint8(spark, sf):
    return G.normalise_uint8(voxels(spark, sf, "events"))


@query(f"WITH {grid('orders')} SELECT vol_id, z, y, x, round((v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) * 255.0, 6) AS v FROM g")
def rescale_intensity(spark, sf):
    return _r(G.rescale_intensity(voxels(spark, sf, "orders")), "v")


@query(f"WITH {grid('orders')} SELECT vol_id, z, y, x, round((v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER () + 1e-9), 6) AS v FROM g")
def display_range(spark, sf):
    return _r(G.display_range(voxels(spark, sf, "orders")), "v")


@query(f"WITH {grid('events')}, s AS (SELECT avg(v) AS mu, stddev_pop(v) AS sd FROM g WHERE v > 50) SELECT vol_id, z, y, x, round(CASE WHEN v > 50 THEN (v - mu) / CASE WHEN sd < 1e-6 THEN 1 ELSE sd END ELSE 0 END, 6) AS v FROM g, s")
def zscore_in_roi(spark, sf):
    return _r(P.zscore(voxels(spark, sf, "events"), F.col("v") > 50), "v")


@query(f"WITH {grid('events')}, s AS (SELECT quantile_cont(v, 0.01) AS a, quantile_cont(v, 0.99) AS b FROM g WHERE v > 50) SELECT vol_id, z, y, x, round(CASE WHEN v > 50 THEN least(1, greatest(0, (v - a) / greatest(b - a, 1e-6))) ELSE 0 END, 6) AS v FROM g, s")
def robust_minmax_in_roi(spark, sf):
    return _r(P.robust_minmax(voxels(spark, sf, "events"), F.col("v") > 50), "v")


@query(f"WITH {grid('embeddings')}, s AS (SELECT min(v) AS mn FROM g WHERE x > 0) SELECT vol_id, z, y, x, round(v + CASE WHEN mn < 1 THEN 1 - mn ELSE 0 END, 6) AS v FROM g, s")
def positive_shift(spark, sf):
    return _r(P.positive_shift(voxels(spark, sf, "embeddings"), F.col("x") > 0), "v")


@query(f"WITH {grid('events')} SELECT vol_id, z, y, x, round(v / exp(0.01 * z + 0.002 * y * x), 6) AS v FROM g")
def remove_log_bias(spark, sf):
    g = voxels(spark, sf, "events")
    return _r(P.remove_log_bias(g, g.withColumn("v", 0.01 * F.col("z") + 0.002 * F.col("y") * F.col("x"))), "v")


@query(f"WITH {grid('events')} SELECT vol_id, z, y, x, round(1 / (1 + exp(-(v - 100) / 25)), 6) AS v FROM g")
def sigmoid(spark, sf):
    return voxels(spark, sf, "events").select(*KEYS, F.round(P.sigmoid(F.col("v"), 25.0, 100.0), 6).alias("v"))


@query(f"WITH {grid('events')} SELECT vol_id, z, y, x, CAST(floor(greatest(0, least(255, v * 1.5 - 20))) AS INTEGER) AS v FROM g")
def clip_uint8(spark, sf):
    return voxels(spark, sf, "events").select(*KEYS, P.to_uint8(F.col("v") * 1.5 - 20).alias("v"))


@query(f"WITH {grid('events')} SELECT vol_id, y AS r, x AS c, v FROM g WHERE z = (SELECT (max(z) + 1) // 2 FROM g)")
def middle_slice(spark, sf):
    return P.plane(voxels(spark, sf, "events"), "z")


@query(f"WITH {grid('events')} SELECT vol_id, (SELECT max(x) FROM g) - x AS r, y AS c, v FROM g WHERE z = 3")
def rotated_slice(spark, sf):
    return P.rotate_ccw(P.plane(voxels(spark, sf, "events"), "z", 3))


@query(f"WITH {grid('events')} SELECT vol_id, z, y, x, CASE WHEN z >= 2 AND z < 10 AND y >= 3 AND y < 15 AND x >= 5 AND x < 20 THEN v ELSE 0 END AS v FROM g")
def crop_keep_shape(spark, sf):
    return P.crop_keep_shape(voxels(spark, sf, "events"), (2, 10), (3, 15), (5, 20))


@query(f"WITH {grid('events')} SELECT vol_id, z // 4 AS z, y // 4 AS y, x // 4 AS x, v FROM g WHERE z % 4 = 2 AND y % 4 = 2 AND x % 4 = 2")
def shrink_by_4(spark, sf):
    return P.shrink(voxels(spark, sf, "events"), 4)


@query(r"SELECT n_name AS name, regexp_replace(regexp_extract('/data/' || r_name || '/' || n_name || e, '[^/\\]*$'), '\.(nii\.gz|nii|mha)$', '') AS stem FROM nation JOIN region ON n_regionkey = r_regionkey, (VALUES ('.nii'), ('.nii.gz'), ('.mha'), ('.txt')) t(e)")
def file_stems(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet").join(spark.read.parquet(f"{sf}/region.parquet"), F.col("n_regionkey") == F.col("r_regionkey"))
    e = n.withColumn("e", F.explode(F.array(*[F.lit(x) for x in (".nii", ".nii.gz", ".mha", ".txt")])))
    return e.select(F.col("n_name").alias("name"), P.file_stem(F.concat(F.lit("/data/"), "r_name", F.lit("/"), "n_name", "e")).alias("stem"))


@query(f"WITH {grid('orders')} SELECT vol_id, z, y, x, CASE WHEN v BETWEEN 100000 AND 250000 THEN 255 ELSE 0 END AS label FROM g")
def binary_threshold(spark, sf):
    return voxels(spark, sf, "orders").select(*KEYS, P.binary_threshold(F.col("v"), 100000, 250000, 255).alias("label"))


@query(f"WITH {grid('events')}, o(organ, lo, hi) AS (VALUES ('brain', 173.0, 360.0), ('breast', 330.0, 750.0), ('liver', 44.0, 85.0)) SELECT organ, count(*) FILTER (WHERE v BETWEEN lo AND hi) AS inside, count(*) AS n FROM g, o GROUP BY organ")
def organ_range_counts(spark, sf):
    ranges = spark.createDataFrame([(o, *r) for o, r in A.ORGAN_RANGES.items()], "organ string, lo double, hi double")
    hit = voxels(spark, sf, "events").crossJoin(F.broadcast(ranges))  # three rows
    return hit.groupBy("organ").agg(F.count_if(F.col("v").between(F.col("lo"), F.col("hi"))).alias("inside"), F.count("*").alias("n"))


# --- aggregates ---


@query(f"WITH {grid('orders')} SELECT vol_id, count(*) AS n, min(v) AS min, max(v) AS max, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std FROM g WHERE v > 0 GROUP BY vol_id")
def foreground_stats(spark, sf):
    return _r(A.describe(voxels(spark, sf, "orders").where("v > 0")), "mean", "std", digits=4)


@query(f"WITH {grid('orders')}, s AS (SELECT quantile_cont(v, {A.PERCENTILES}) AS l FROM g WHERE v > 0) SELECT unnest({A.PERCENTILES}::DOUBLE[]) AS q, round(unnest(l), 6) AS v FROM s")
def foreground_percentiles(spark, sf):
    p = A.percentiles(voxels(spark, sf, "orders").where("v > 0"), A.PERCENTILES)
    return p.select(F.explode(F.arrays_zip(F.array(*[F.lit(float(x)) for x in A.PERCENTILES]).alias("q"), "p")).alias("s")).select(F.col("s.q").alias("q"), F.round("s.p", 6).alias("v"))


_RANGES_SQL = " UNION ALL ".join(f"SELECT 'orders' AS vol_id, '{o}' AS organ, '{k}' AS kind, round(quantile_cont(v, {a}), 6) AS lower, round(quantile_cont(v, {b}), 6) AS upper FROM g WHERE v > 0" for o, pair in A.ORGAN_PERCENTILES.items() for k, (a, b) in zip(("wide", "narrow"), pair, strict=True))


@query(f"WITH {grid('orders')} {_RANGES_SQL}")
def organ_ranges(spark, sf):
    return _r(A.organ_ranges(voxels(spark, sf, "orders")), "lower", "upper")


@query(f"WITH {grid('orders')}, r AS (SELECT min(v) AS lo, max(v) AS hi FROM g) SELECT vol_id, CAST(least(99, floor((v - lo) / (hi - lo) * 100)) AS INTEGER) AS bin, count(*) AS n FROM g, r GROUP BY 1, 2")
def histogram_100(spark, sf):
    return A.histogram(voxels(spark, sf, "orders"), 100).select("vol_id", "bin", "n")


_RANGE = "t AS (SELECT quantile_cont(v, 0.30) AS lo, quantile_cont(v, 0.65) AS hi FROM g WHERE v > 0), l AS (SELECT g.*, CASE WHEN v BETWEEN lo AND hi THEN 1 ELSE 0 END AS label FROM g, t)"


def _range_labels(spark, sf):
    g = voxels(spark, sf, "orders")
    p = A.percentiles(g.where("v > 0"), [0.30, 0.65])
    return g.join(F.broadcast(p), "vol_id").select(*KEYS, "v", P.binary_threshold(F.col("v"), F.col("p")[0], F.col("p")[1]).alias("label"))


@query(f"WITH {grid('orders')}, {_RANGE} SELECT vol_id, label, count(*) AS n, round(count(*) * CAST(100 AS DOUBLE) / sum(count(*)) OVER (), 6) AS percent FROM l GROUP BY vol_id, label")
def label_counts(spark, sf):
    return _r(A.label_counts(_range_labels(spark, sf)), "percent")


@query(f"WITH {grid('orders')}, {_RANGE} SELECT vol_id, label, count(*) AS n, round(avg(v), 4) AS mean FROM l GROUP BY vol_id, label")
def cluster_means(spark, sf):
    return _range_labels(spark, sf).groupBy("vol_id", "label").agg(F.count("*").alias("n"), F.round(F.avg("v"), 4).alias("mean"))


@query(f"WITH {grid('orders')}, {_RANGE} SELECT DISTINCT vol_id, label FROM l")
def distinct_labels(spark, sf):
    return _range_labels(spark, sf).select("vol_id", "label").distinct()


def _slices_sql(measure: str, source: str) -> str:
    return " UNION ALL ".join(f"SELECT vol_id, '{a}' AS axis, {a} AS idx, {measure} AS m FROM {source} GROUP BY vol_id, {a}" for a in "zyx")


@query(f"WITH {grid('events')}, s AS ({_slices_sql('var_pop(v)', 'g')}) SELECT vol_id, axis, idx, round(m, 6) AS m FROM (SELECT *, row_number() OVER (PARTITION BY vol_id, axis ORDER BY m DESC, idx) AS k FROM s) WHERE k = 1")
def focus_slices_by_variance(spark, sf):
    return _r(A.focus_slices(A.by_slice(voxels(spark, sf, "events"), F.var_pop("v"))), "m")


@query(f"WITH {grid('events')}, b AS (SELECT * FROM g WHERE v > 150), s AS ({_slices_sql('count(*)', 'b')}) SELECT vol_id, axis, idx, m FROM (SELECT *, row_number() OVER (PARTITION BY vol_id, axis ORDER BY m DESC, idx) AS k FROM s) WHERE k = 1")
def focus_slices_by_mass(spark, sf):
    return A.focus_slices(A.by_slice(voxels(spark, sf, "events").where("v > 150"), F.count("*")))


@query(f"WITH {grid('events')}, b AS (SELECT * FROM g WHERE v > 200), s AS ({_slices_sql('count(*)', 'b')}) SELECT vol_id, axis, min(idx) AS first, max(idx) AS last, arg_min(idx, (-m, idx)) AS peak, max(m) AS peak_n FROM s GROUP BY vol_id, axis")
def presence_report(spark, sf):
    return A.presence(voxels(spark, sf, "events").where("v > 200"))


@query(f"WITH {grid('events')} SELECT vol_id, min(z) AS lo_z, max(z) AS hi_z, min(y) AS lo_y, max(y) AS hi_y, min(x) AS lo_x, max(x) AS hi_x, count(*) AS n FROM g WHERE v > 300 GROUP BY vol_id")
def bounding_box(spark, sf):
    return A.bounding_box(voxels(spark, sf, "events").where("v > 300"))


@query(f"WITH {grid('events')}, n AS (SELECT *, floor(v / 10) * 10 AS w FROM g), s AS (SELECT vol_id, count(*) AS n, avg(pow(v - w, 2)) AS mse, max(v) AS top FROM n GROUP BY vol_id) SELECT vol_id, n, round(mse, 6) AS mse, round(10 * log10(top * top / mse), 6) AS psnr FROM s")
def mse_psnr(spark, sf):
    g = voxels(spark, sf, "events")
    return _r(A.mse_psnr(g, g.withColumn("v", F.floor(F.col("v") / 10) * 10)), "mse", "psnr")


@query(f"WITH {grid('orders')} SELECT vol_id, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.9), 6) AS p90, round(greatest(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 1e-6), 6) AS iqr FROM g GROUP BY vol_id")
def robust_roi_stats(spark, sf):
    return _r(A.robust_stats(voxels(spark, sf, "orders")), "median", "p10", "p90", "iqr")


_THREE = "l AS (SELECT vol_id, CASE WHEN v < 30 THEN 0 WHEN v < 90 THEN 1 ELSE 2 END AS label, v FROM g)"


def _three(spark, sf):
    return voxels(spark, sf, "events").select("vol_id", F.when(F.col("v") < 30, 0).when(F.col("v") < 90, 1).otherwise(2).alias("label"), "v")


@query(f"WITH {grid('events')}, {_THREE}, c AS (SELECT label, count(*) AS n, avg(v) AS m, var_pop(v) AS s FROM l GROUP BY label), t AS (SELECT avg(v) AS mean FROM l) SELECT 'events' AS vol_id, count(*) AS k, round((sum(n * pow(m - mean, 2)) / (count(*) - 1)) / (sum(n * s) / (sum(n) - count(*))), 4) AS ch FROM c, t")
def calinski_harabasz(spark, sf):
    return _r(A.calinski_harabasz(_three(spark, sf)), "ch", digits=4)


@query(f"""WITH {grid('events')}, {_THREE}, q AS (SELECT label, v, count(*) AS n FROM l GROUP BY 1, 2), z AS (SELECT label, count(*) AS size FROM l GROUP BY 1),
d AS (SELECT a.label, a.v, a.n, b.label AS other, sum(b.n * abs(a.v - b.v)) AS away FROM q a, q b GROUP BY ALL),
m AS (SELECT d.label, v, n, max(CASE WHEN other = d.label AND size > 1 THEN away / (size - 1) END) AS a, min(CASE WHEN other <> d.label THEN away / size END) AS b FROM d JOIN z ON z.label = d.other GROUP BY ALL)
SELECT 'events' AS vol_id, CAST(sum(n) AS BIGINT) AS n, round(sum(n * CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END) / sum(n), 6) AS silhouette FROM m""")
def silhouette(spark, sf):
    return _r(A.silhouette(_three(spark, sf)), "silhouette")


# --- joins, sets, order: the dataflow shapes between volumes ---


@query(f"WITH {grid('orders')}, e AS ({GRIDS['events']}) SELECT g.z, g.y, g.x, CASE WHEN e.v > 100 THEN g.v ELSE e.v END AS v FROM g JOIN e USING (z, y, x)")
def aligned_where(spark, sf):
    a = voxels(spark, sf, "orders").select("z", "y", "x", "v")
    b = voxels(spark, sf, "events").select("z", "y", "x", F.col("v").alias("w"))
    return a.join(b, ["z", "y", "x"]).select("z", "y", "x", F.when(F.col("w") > 100, F.col("v")).otherwise(F.col("w")).alias("v"))


@query(f"WITH {grid('events')}, roi AS (SELECT z, y, x FROM g WHERE v > 120) SELECT vol_id, z, y, x, CASE WHEN v <= 120 THEN -1 ELSE CAST(floor(v / 100) AS INTEGER) END AS label FROM g")
def label_outside_roi(spark, sf):
    g = voxels(spark, sf, "events")
    roi = g.where("v > 120").select(*KEYS, F.lit(True).alias("in_roi"))
    return g.join(roi, KEYS, "left").select(*KEYS, F.when(F.col("in_roi").isNull(), -1).otherwise(F.floor(F.col("v") / 100).cast("int")).alias("label"))


@query(f"WITH {grid('events')} (SELECT z, y, x FROM g WHERE v > 120 INTERSECT SELECT z, y, x FROM g WHERE z % 2 = 0) EXCEPT SELECT z, y, x FROM g WHERE x < 5")
def mask_algebra(spark, sf):
    g = voxels(spark, sf, "events")
    m = lambda c: g.where(c).select("z", "y", "x")
    return m("v > 120").intersect(m("z % 2 = 0")).subtract(m("x < 5"))


@query(f"WITH {grid('events')} SELECT DISTINCT z, y, x FROM (SELECT z, y, x FROM g WHERE v > 250 UNION ALL SELECT z, y, x FROM g WHERE v < 2)")
def mask_union(spark, sf):
    g = voxels(spark, sf, "events")
    return g.where("v > 250").unionByName(g.where("v < 2")).select("z", "y", "x").distinct()


@query("SELECT n_name AS name, CAST((row_number() OVER (ORDER BY n_name) - 1) // 4 AS INTEGER) AS row, CAST((row_number() OVER (ORDER BY n_name) - 1) % 4 AS INTEGER) AS col FROM nation")
def mosaic_cells(spark, sf):
    from volspark.operators.views import mosaic

    return mosaic(spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_name").alias("name")))


@query(f"WITH {grid('events')} SELECT 'axial' AS view, vol_id, y AS r, x AS c, v FROM g WHERE z = (SELECT (max(z) + 1) // 2 FROM g) UNION ALL SELECT 'coronal', vol_id, z, x, v FROM g WHERE y = (SELECT (max(y) + 1) // 2 FROM g) UNION ALL SELECT 'sagittal', vol_id, z, y, v FROM g WHERE x = (SELECT (max(x) + 1) // 2 FROM g)")
def three_planes(spark, sf):
    from volspark.operators.views import three_planes as planes

    return planes(voxels(spark, sf, "events"))


@query(f"WITH {grid('events')}, s AS (SELECT * FROM g WHERE z = 5), p AS (SELECT quantile_cont(v, 0.98) AS vmax FROM s) SELECT vol_id, y AS r, x AS c, v, round(vmax, 6) AS vmax, v > 150 AS on FROM s, p")
def overlay_slice(spark, sf):
    from volspark.operators.views import overlay

    s = P.plane(voxels(spark, sf, "events"), "z", 5)
    return _r(overlay(s, s.where("v > 150")), "vmax")


@query(f"WITH {grid('events')}, e AS ({GRIDS['orders']}) SELECT 0 AS panel, 'events' AS title, vol_id, y AS r, x AS c, v FROM g WHERE z = 2 UNION ALL SELECT 1, 'orders', vol_id, y, x, v FROM e WHERE z = 2")
def comparison_panels(spark, sf):
    from volspark.operators.views import panels

    return panels([(n, voxels(spark, sf, n)) for n in ("events", "orders")], "z", 2)


@query(f"WITH {grid('events')}, p(sigma, level) AS (SELECT s::DOUBLE, l::DOUBLE FROM (VALUES (0.5), (1.0), (2.0)) a(s), (VALUES (0.1), (0.2), (0.3)) b(l)) SELECT sigma, level, count(*) FILTER (WHERE v > 100 * sigma * (1 + level)) AS hits, count(*) AS n FROM g, p GROUP BY ROLLUP (sigma, level)")
def parameter_sweep_totals(spark, sf):
    grid_ = spark.createDataFrame([(s, level) for s in (0.5, 1.0, 2.0) for level in (0.1, 0.2, 0.3)], "sigma double, level double")
    runs = voxels(spark, sf, "events").crossJoin(F.broadcast(grid_))  # nine rows
    return runs.rollup("sigma", "level").agg(F.count_if(F.col("v") > 100 * F.col("sigma") * (1 + F.col("level"))).alias("hits"), F.count("*").alias("n"))


# --- files, reports, lookups ---

_FILES_SQL = "f AS (SELECT '/data/' || lower(r_name) || '/' || lower(n_name) || '_' || n_nationkey || '_' || n_regionkey || '.nii.gz' AS path FROM nation JOIN region ON n_regionkey = r_regionkey)"


def _files(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet").join(spark.read.parquet(f"{sf}/region.parquet"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(F.concat(F.lit("/data/"), F.lower("r_name"), F.lit("/"), F.lower("n_name"), F.lit("_"), "n_nationkey", F.lit("_"), "n_regionkey", F.lit(".nii.gz")).alias("path"))


_ORGANS = [("a", "asia", "nation_9"), ("b", "nowhere", "nation_2"), ("c", "europe", "nation_1"), ("d", "nowhere", "nothing")]


@query(f"""WITH {_FILES_SQL}, o(organ, folder, pattern) AS (VALUES {", ".join(map(str, _ORGANS))}),
m AS (SELECT organ, path, CASE WHEN contains(path, '/' || folder || '/') THEN 0 ELSE 1 END AS k FROM f JOIN o ON contains(path, '/' || folder || '/') OR contains(lower(regexp_extract(path, '[^/]*$')), pattern))
SELECT organ, path FROM (SELECT *, row_number() OVER (PARTITION BY organ ORDER BY k, path) AS r FROM m) WHERE r = 1""")
def discover_files(spark, sf):
    from volspark.sources.listing import discover

    return discover(_files(spark, sf), spark.createDataFrame(_ORGANS, "organ string, folder string, pattern string"))


@query(f"""WITH {_FILES_SQL}, s AS (SELECT path, regexp_replace(regexp_extract(path, '[^/]*$'), '[.]nii[.]gz$', '') AS stem FROM f), r AS (SELECT path, substr(stem, 8) AS params FROM s WHERE starts_with(stem, 'nation_'))
SELECT path, params, split_part(params, '_', 1) AS a, split_part(params, '_', 2) AS b, split_part(params, '_', 3) AS c, CAST(NULL AS VARCHAR) AS d FROM r""")
def results_of_image(spark, sf):
    from volspark.sources.listing import parameters, results_of

    return parameters(results_of(_files(spark, sf), "nation"), ["a", "b", "c", "d"])


@query("WITH r AS (SELECT n_regionkey AS image, CASE WHEN n_nationkey < 8 THEN 'mask' WHEN n_nationkey < 9 THEN 'labels' ELSE 'other' END AS kind FROM nation) SELECT image, kind FROM r WHERE image IN (SELECT image FROM r WHERE kind IN ('mask', 'labels') GROUP BY image HAVING count(DISTINCT kind) = 2)")
def images_with_all_results(spark, sf):
    from volspark.sources.listing import all_present

    n = spark.read.parquet(f"{sf}/nation.parquet")
    kind = F.when(F.col("n_nationkey") < 8, "mask").when(F.col("n_nationkey") < 9, "labels").otherwise("other")
    return all_present(n.select(F.col("n_regionkey").alias("image"), kind.alias("kind")), ["mask", "labels"])


@query("SELECT n_name AS image_name, CAST(CASE WHEN n_regionkey = 1 THEN -1 ELSE n_nationkey END AS BIGINT) AS k FROM nation")
def report_upsert(spark, sf):
    from volspark.sources.sinks import as_json, upsert

    n = spark.read.parquet(f"{sf}/nation.parquet")
    old = n.select(F.col("n_name").alias("image_name"), F.col("n_nationkey").cast("long").alias("k"))
    new = n.where("n_regionkey = 1").select(F.col("n_name").alias("image_name"), F.lit(-1).cast("long").alias("k"))
    return as_json(upsert(old, new)).select(F.from_json("json", "image_name string, k long").alias("j")).select("j.*")


@query(f"WITH {grid('events')}, r AS (SELECT CASE x % 3 WHEN 0 THEN 'mean' WHEN 1 THEN 'median' ELSE 'gradient' END AS filter, v > 20 AS ok, v / 10 AS seconds FROM g) SELECT filter, count(*) AS n, count(*) FILTER (WHERE ok) AS succeeded, count(*) FILTER (WHERE NOT ok) AS failed, round(sum(seconds), 4) AS seconds, round(max(seconds), 4) AS longest FROM r GROUP BY ROLLUP (filter)")
def run_tallies(spark, sf):
    name = F.element_at(F.array(F.lit("mean"), F.lit("median"), F.lit("gradient")), F.col("x") % 3 + 1)
    runs = voxels(spark, sf, "events").select(name.alias("filter"), (F.col("v") > 20).alias("ok"), (F.col("v") / 10).alias("seconds"))
    return _r(A.tallies(runs, "filter"), "seconds", "longest", digits=4)


_TISSUES_SQL = ", ".join(f"('{o}', {i}, '{name}')" for o, by in P.TISSUES.items() for i, name in by.items())


@query(f"WITH {grid('events')}, t(organ, label, tissue) AS (VALUES {_TISSUES_SQL}), l AS (SELECT o.organ, CAST(least(4, floor(v / 60)) AS INTEGER) AS label, greatest(1, least((SELECT max(z) FROM g) - 1, z - 3)) AS near FROM g, (VALUES ('brain'), ('breast'), ('liver')) o(organ)) SELECT organ, label, tissue, CAST(min(near) AS INTEGER) AS first, CAST(max(near) AS INTEGER) AS last, count(*) AS n FROM l LEFT JOIN t USING (organ, label) GROUP BY ALL")
def tissue_names(spark, sf):
    g = voxels(spark, sf, "events")
    most = g.agg((F.max("z") - 1).alias("most"))
    each = g.crossJoin(F.broadcast(most)).select("v", P.clamp(F.col("z") - 3, 1, F.col("most")).alias("near"), F.explode(F.array(*map(F.lit, P.TISSUES))).alias("organ"))
    each = each.withColumn("label", F.least(F.lit(4), F.floor(F.col("v") / 60)).cast("int"))
    return each.withColumn("tissue", P.tissue(F.col("organ"), F.col("label"))).groupBy("organ", "label", "tissue").agg(F.min("near").alias("first"), F.max("near").alias("last"), F.count("*").alias("n"))


@query(f"""WITH {grid("events")}, a AS ({_slices_sql("count(*)", "(SELECT * FROM g WHERE v > 400 AND z > 5)")}), s AS (SELECT axis, arg_max(idx, (m, -idx)) AS idx FROM a GROUP BY axis), c(axis, mid) AS (SELECT 'z', (max(z) + 1) // 2 FROM g UNION ALL SELECT 'y', 10 UNION ALL SELECT 'x', 12)
SELECT 'events' AS vol_id, axis, CAST(coalesce(idx, mid) AS INTEGER) AS idx, CASE WHEN idx IS NULL THEN 'middle' ELSE 'second' END AS source FROM c LEFT JOIN s USING (axis)""")
def focus_slices_with_fallback(spark, sf):
    g = voxels(spark, sf, "events")
    return A.focus_or(g.where("v > 1e9"), g.where("v > 400 and z > 5"), g)


@query(f"WITH {grid('events')}, e AS ({GRIDS['orders']}) SELECT 'raw' AS row, 'events' AS col, y AS r, x AS c, v FROM g WHERE z = 1 UNION ALL SELECT 'half', 'events', y, x, v / 2 FROM g WHERE z = 1 UNION ALL SELECT 'raw', 'orders', y, x, v FROM e WHERE z = 1")
def summary_grid(spark, sf):
    from volspark.operators.views import summary_grid as cells

    g, o = voxels(spark, sf, "events"), voxels(spark, sf, "orders")
    return cells({("raw", "events"): g, ("half", "events"): g.withColumn("v", F.col("v") / 2), ("raw", "orders"): o}, "z", 1)


@query(f"WITH {grid('events')} SELECT vol_id, z, y, x, CAST(CAST(v AS FLOAT) AS DOUBLE) AS v FROM g")
def nifti_round_trip(spark, sf):
    """Written compressed, a file per volume, and read back with its slices."""
    from volspark.session import shared_folder
    from volspark.sources.nifti import register, write_volumes

    path = f"{shared_folder(spark)}/volspark-nifti-{uuid.uuid4().hex}"
    write_volumes(voxels(spark, sf, "events"), path, compress="true", spacing="1,1,2")
    register(spark)
    return spark.read.format("nifti").load(path)
