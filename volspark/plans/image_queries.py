"""Queries of window filters, thresholds, clusters, regions, noise and pipelines, with DuckDB SQL where it can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from volspark.operators import bias, cluster, denoise, fronts, lesion, regions, stencil, threshold
from volspark.plans import runs, sweeps
from volspark.plans import sqltext as T
from volspark.plans.sqltext import GRIDS, central, grid, histogram, uint8
from volspark.plans.sqltext import stencil as near
from volspark.schema import KEYS
from volspark.session import cut, shared_folder
from volspark.sources import grids as G
from volspark.sources import raster
from volspark.sources.grids import extents, voxels

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _r(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


def _u8(spark, sf):
    return G.normalise_uint8(voxels(spark, sf, "events")).withColumn("v", F.col("v").cast("double"))


# --- windows ---


@query(f"WITH {grid('events')}, {near((2, 2, 2), 'replicate')} SELECT vol_id, z, y, x, round(avg(w), 6) AS v FROM n GROUP BY vol_id, z, y, x")
def mean_filter_r2(spark, sf):
    return _r(stencil.mean_filter(voxels(spark, sf, "events"), 2), "v")


@query(f"WITH {grid('events')}, {near((1, 1, 1), 'replicate')} SELECT vol_id, z, y, x, median(w) AS v FROM n GROUP BY vol_id, z, y, x")
def median_filter_r1(spark, sf):
    return stencil.median_filter(voxels(spark, sf, "events"), (1, 1, 1))


@query(f"WITH {grid('events')}, {near((1, 1, 1), 'reflect')} SELECT vol_id, z, y, x, round(median(w), 6) AS v FROM n WHERE NOT (dz = 0 AND dy = 0 AND dx = 0) GROUP BY vol_id, z, y, x")
def median_26(spark, sf):
    return _r(stencil.median_without_centre(voxels(spark, sf, "events")), "v")


def _amf_sql() -> str:
    def size(r: int) -> str:
        inside = f"abs(dy) <= {r} AND abs(dx) <= {r}"
        return f"min(w) FILTER ({'WHERE ' + inside}) AS lo{r}, median(w) FILTER (WHERE {inside}) AS mid{r}, max(w) FILTER (WHERE {inside}) AS hi{r}"

    steps = " ".join(f"WHEN lo{r} < mid{r} AND mid{r} < hi{r} THEN CASE WHEN lo{r} < v AND v < hi{r} THEN v ELSE mid{r} END" for r in (1, 2, 3))
    return f"""WITH g0 AS ({GRIDS["events"]}), g AS (SELECT * FROM {uint8("g0")}), {near((0, 3, 3), "reflect")},
s AS (SELECT vol_id, z, y, x, any_value(v) AS v, {", ".join(size(r) for r in (1, 2, 3))} FROM n GROUP BY vol_id, z, y, x)
SELECT vol_id, z, y, x, CAST(CASE {steps} ELSE mid3 END AS DOUBLE) AS v FROM s"""


@query(_amf_sql())
def adaptive_median_7(spark, sf):
    return denoise.adaptive_median(_u8(spark, sf), 7)


@query(f"""WITH {grid("events")}, {near((0, 1, 1), "replicate")}, m AS (SELECT vol_id, z, y, x, median(w) AS v FROM n GROUP BY vol_id, z, y, x),
{near((1, 1, 1), "replicate", "m", "k")}, d AS (SELECT vol_id, z, y, x, any_value(v) AS m, sqrt({central()}) AS gr FROM k GROUP BY vol_id, z, y, x),
t AS (SELECT quantile_cont(gr, 0.82) AS top FROM d) SELECT g.vol_id, g.z, g.y, g.x, CASE WHEN gr > top THEN g.v ELSE m END AS v FROM g JOIN d USING (vol_id, z, y, x), t""")
def adaptive_median_approximation(spark, sf):
    return denoise.adaptive_median_approximation(voxels(spark, sf, "events"))


@query(f"""WITH {grid("events")}, {near((2, 2, 2), "symmetric")}, l AS (SELECT vol_id, z, y, x, any_value(v) AS v, avg(w) AS mu, avg(w * w) - avg(w) * avg(w) AS s2 FROM n GROUP BY vol_id, z, y, x),
t AS (SELECT avg(s2) AS n2 FROM l) SELECT vol_id, z, y, x, round(mu + greatest(s2 - n2, 0) / greatest(s2, 2.220446049250313e-16) * (v - mu), 5) AS v FROM l, t""")
def adaptive_wiener_5(spark, sf):
    return _r(denoise.adaptive_wiener(voxels(spark, sf, "events"), 5), "v", digits=5)


@query(f"WITH {grid('events')}, {near((1, 1, 1), 'replicate')} SELECT vol_id, z, y, x, round(sqrt({central()}), 6) AS v FROM n GROUP BY vol_id, z, y, x")
def gradient_magnitude(spark, sf):
    return _r(stencil.gradient_magnitude(voxels(spark, sf, "events")), "v")


@query(f"WITH {grid('events')}, {near((1, 1, 1), 'replicate')}, d AS (SELECT vol_id, sqrt({central()}) AS v FROM n GROUP BY vol_id, z, y, x) SELECT vol_id, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean FROM d GROUP BY vol_id")
def gradient_summary(spark, sf):
    d = stencil.gradient_magnitude(voxels(spark, sf, "events"))
    return _r(d.groupBy("vol_id").agg(F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean")), "min", "max", "mean")


def _sobel(axis: str) -> str:
    smooth = " * ".join(f"(2 - abs(d{a}))" for a in "zyx" if a != axis)
    return f"pow(sum(d{axis} * {smooth} * w), 2)"


@query(f"WITH {grid('events')}, {near((1, 1, 1), 'replicate')} SELECT vol_id, z, y, x, round(sqrt({' + '.join(_sobel(a) for a in 'zyx')}), 6) AS v FROM n GROUP BY vol_id, z, y, x")
def sobel_magnitude(spark, sf):
    return _r(stencil.sobel_magnitude(voxels(spark, sf, "events")), "v")


def _gauss_sql(sigma: float) -> str:
    g, d = stencil.gaussian_weights(sigma)
    r = len(g) // 2
    rows = ", ".join(f"({k}, {float(g[k + r])!r}::DOUBLE, {float(d[k + r])!r}::DOUBLE)" for k in range(-r, r + 1))

    def term(axis: str) -> str:
        return f"pow(sum({' * '.join(('d' if a == axis else 'g') + a for a in 'zyx')} * w), 2)"

    joins = " ".join(f"JOIN wt w{a} ON w{a}.k = d{a}" for a in "zyx")
    cols = ", ".join(f"w{a}.g AS g{a}, w{a}.d AS d{a}" for a in "zyx")
    return f"""WITH {grid("events")}, {near((r, r, r), "replicate")}, wt(k, g, d) AS (VALUES {rows}),
m AS (SELECT vol_id, z, y, x, w, {cols} FROM n {joins}) SELECT vol_id, z, y, x, round(sqrt({" + ".join(term(a) for a in "zyx")}), 5) AS v FROM m GROUP BY vol_id, z, y, x"""


@query(_gauss_sql(0.5))
def gaussian_gradient_half(spark, sf):
    return _r(stencil.gaussian_gradient(voxels(spark, sf, "events"), 0.5), "v", digits=5)


@query(f"""WITH {grid("events")}, {near((2, 2, 2), "replicate")}, f AS (SELECT vol_id, z, y, x, (v / 500 - 0.5) AS u, (v - w) / 500 AS d FROM n)
SELECT vol_id, z, y, x, round((avg(0.5 * sign(d) * pow(abs(2 * d), 0.3) - 0.5 * 0.5 * sign(d) * abs(2 * d) + 0.5 * u) + 0.5) * 500, 6) AS v FROM f GROUP BY vol_id, z, y, x""")
def adaptive_equalisation(spark, sf):
    return _r(stencil.adaptive_equalisation(voxels(spark, sf, "events"), 0.3, 0.5, 2, 0.0, 500.0), "v")


def _diffusion_sql(iterations: int) -> str:
    """Each step: central differences with replicated borders, their flux, and its divergence; no flux is there outside the volume."""
    line = {a: f"(PARTITION BY {', '.join(b for b in 'zyx' if b != a)} ORDER BY {a})" for a in "zyx"}
    beside = lambda c, a, rest: f"(lead({c}, 1, {rest}) OVER {line[a]} - lag({c}, 1, {rest}) OVER {line[a]}) / 2"
    steps = ["v0 AS MATERIALIZED (SELECT z, y, x, v FROM g)"]
    for k in range(iterations):
        steps.append(f"g{k} AS MATERIALIZED (SELECT z, y, x, v, {', '.join(f'{beside("v", a, "v")} AS g{a}' for a in 'zyx')} FROM v{k})")
        steps.append(f"f{k} AS MATERIALIZED (SELECT z, y, x, v, s, {', '.join(f'exp(-0.5 * pow(s / 3, 2)) * g{a} / s AS f{a}' for a in 'zyx')} FROM (SELECT *, sqrt(gz * gz + gy * gy + gx * gx) + 1e-12 AS s FROM g{k}))")
        steps.append(f"v{k + 1} AS MATERIALIZED (SELECT z, y, x, v + 0.0625 * s * ({' + '.join(beside(f'f{a}', a, '0') for a in 'zyx')}) AS v FROM f{k})")
    return f"WITH {grid('events')}, {', '.join(steps)} SELECT 'events' AS vol_id, z, y, x, round(v, 6) AS v FROM v{iterations}"


@query(_diffusion_sql(5))
def curvature_diffusion_5(spark, sf):
    return _r(stencil.curvature_diffusion(voxels(spark, sf, "events"), 5), "v")


# --- noise ---

def _hashes(streams: dict[str, int], source: str = "g") -> str:
    """CTEs up to u: source and, for each name, the hash of its place and seed."""
    place = f"CAST(z AS BIGINT) * {denoise.PLACE_Z} + CAST(y AS BIGINT) * {denoise.PLACE_Y} + CAST(x AS BIGINT) * {denoise.PLACE_X}"
    steps = [f"u0 AS (SELECT *, {', '.join(f'({place} + {seed * denoise.SEED}) % {denoise.WORD} AS {n}' for n, seed in streams.items())} FROM {source})"]
    for k, (shift, factor) in enumerate(((15, denoise.MIX_1), (12, denoise.MIX_2), (15, None))):
        mixed = (lambda n, s=shift: f"xor({n}, {n} >> {s})") if factor is None else (lambda n, s=shift, f=factor: f"xor({n}, {n} >> {s}) * {f} % {denoise.WORD}")
        steps.append(f"u{k + 1} AS (SELECT * REPLACE ({', '.join(f'{mixed(n)} AS {n}' for n in streams)}) FROM u{k})")
    return ", ".join(steps)


_BOX_MULLER = f"(sqrt(-2 * ln((a + 0.5) / {float(denoise.WORD)})) * cos(2 * pi() * ((b + 0.5) / {float(denoise.WORD)})))"
_STREAMS = {"a": 1, "b": 1 + 7919}


@query(f"WITH {grid('events')}, {_hashes(_STREAMS)} SELECT vol_id, z, y, x, round(v + 20 * {_BOX_MULLER}, 6) AS v FROM u3")
def gaussian_noise(spark, sf):
    return _r(denoise.gaussian_noise(voxels(spark, sf, "events"), 20.0), "v")


@query(f"""WITH g0 AS ({GRIDS["events"]}), g AS (SELECT * FROM {uint8("g0")}), {_hashes({"c": 1 + 104_729})},
k AS (SELECT *, row_number() OVER (ORDER BY c, z, y, x) AS k, floor(count(*) OVER () * 0.1) AS n FROM u3)
SELECT vol_id, z, y, x, CAST(CASE WHEN k <= floor(n / 2) THEN 255 WHEN k <= n THEN 0 ELSE v END AS DOUBLE) AS v FROM k""")
def salt_and_pepper(spark, sf):
    return denoise.salt_and_pepper(_u8(spark, sf), 0.1, 0, 255)


@query(f"""WITH {grid("events")}, {_hashes(_STREAMS | {"c": 1 + 104_729})},
k AS (SELECT *, row_number() OVER (ORDER BY c, z, y, x) AS k, floor(count(*) OVER () * 0.05) AS n, min(v) OVER () AS mn, max(v) OVER () AS mx FROM u3)
SELECT vol_id, z, y, x, round(CASE WHEN k <= floor(n / 2) THEN mx WHEN k <= n THEN mn ELSE v + 10 * {_BOX_MULLER} END, 6) AS v FROM k""")
def mixed_noise(spark, sf):
    return _r(denoise.mixed_noise(voxels(spark, sf, "events"), 0.05, 10.0, own_extremes=True), "v")


def _denoise_sql() -> str:
    kinds = list(dict.fromkeys(n[:3] for n in sweeps.NOISES))
    gauss = lambda s: f"floor(greatest(0, least(255, v + {s} * {_BOX_MULLER})))"
    pepper = lambda e, d: f"CASE WHEN k <= floor(floor(n * {d}) / 2) THEN 255 WHEN k <= floor(n * {d}) THEN 0 ELSE {e} END"
    made = {"none": lambda d, s: "v", "gaussian": lambda d, s: gauss(s), "salt_pepper": lambda d, s: pepper("v", d), "mixed": lambda d, s: pepper(gauss(s), d)}
    noisy = " UNION ALL ".join(f"SELECT '{i}' AS vol_id, z, y, x, CAST({made[k](d, s)} AS DOUBLE) AS v FROM k" for i, (k, d, s) in enumerate(kinds))
    inside = lambda r: f"WHERE abs(dy) <= {r} AND abs(dx) <= {r}"
    sizes = ", ".join(f"min(w) FILTER ({inside(r)}) AS lo{r}, median(w) FILTER ({inside(r)}) AS mid{r}, max(w) FILTER ({inside(r)}) AS hi{r}" for r in (1, 2, 3, 4))
    steps = lambda h: " ".join(f"WHEN lo{r} < mid{r} AND mid{r} < hi{r} THEN CASE WHEN lo{r} < v AND v < hi{r} THEN v ELSE mid{r} END" for r in range(1, h + 1))
    found = [f"SELECT vol_id, z, y, x, 'adaptive_median_{w}' AS filter, CASE {steps(w // 2)} ELSE mid{w // 2} END AS v FROM am WHERE vol_id IN ({', '.join(repr(str(kinds.index(n[:3]))) for n in sweeps.NOISES if n[3] == w)})" for w in (5, 7, 9)]
    found.append("SELECT vol_id, z, y, x, 'median26', median(w) FROM q WHERE NOT (dz = 0 AND dy = 0 AND dx = 0) GROUP BY vol_id, z, y, x")
    found.append("SELECT vol_id, z, y, x, 'wiener', mu + greatest(s2 - n2, 0) / greatest(s2, 2.220446049250313e-16) * (v - mu) FROM wl JOIN wn USING (vol_id)")
    names = " ".join(f"WHEN '{i}' THEN '{k}'" for i, (k, _, _) in enumerate(kinds)), " ".join(f"WHEN '{i}' THEN {d}::DOUBLE" for i, (_, d, _) in enumerate(kinds)), " ".join(f"WHEN '{i}' THEN {s}::DOUBLE" for i, (_, _, s) in enumerate(kinds))
    return f"""WITH g0 AS ({GRIDS["events"]}), g AS (SELECT * FROM {uint8("g0")}), {_hashes(_STREAMS | {"c": 1 + 104_729})},
k AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY c, z, y, x) AS k, count(*) OVER () AS n FROM u3), noisy AS MATERIALIZED ({noisy}),
{near((0, 4, 4), "reflect", "noisy", "p").replace("FROM noisy g,", "FROM noisy g,")}, am AS (SELECT vol_id, z, y, x, any_value(v) AS v, {sizes} FROM p GROUP BY vol_id, z, y, x),
{near((1, 1, 1), "reflect", "noisy", "q")}, {near((1, 1, 1), "symmetric", "noisy", "w")},
wl AS MATERIALIZED (SELECT vol_id, z, y, x, any_value(v) AS v, avg(w) AS mu, avg(w * w) - avg(w) * avg(w) AS s2 FROM w GROUP BY vol_id, z, y, x), wn AS (SELECT vol_id, avg(s2) AS n2 FROM wl GROUP BY vol_id),
f AS ({" UNION ALL ".join(found)}),
s AS (SELECT f.vol_id, filter, count(*) AS n, avg(pow(g.v - f.v, 2)) AS mse, CAST(max(g.v) AS DOUBLE) AS top FROM f JOIN g USING (z, y, x) GROUP BY f.vol_id, filter)
SELECT CASE vol_id {names[0]} END AS noise, CASE vol_id {names[1]} END AS density, CASE vol_id {names[2]} END AS sigma, filter, n, round(mse, 6) AS mse, round(CASE WHEN mse > 0 THEN 10 * log10(top * top / mse) ELSE 'Infinity'::DOUBLE END, 4) AS psnr FROM s"""


@query(_denoise_sql())
def denoise_table(spark, sf):
    t = sweeps.noise_table(_u8(spark, sf), sweeps.NOISES, ["median26", "wiener"])
    return _r(_r(t, "psnr", digits=4), "mse")


def _recursive_sql(sigma: float, reach: int = 60) -> str:
    """The responses summed over all distances to reach, where they have died away; ends replicated."""
    cte = []
    for name, amplitudes, slope in (("k0", stencil.SMOOTH, False), ("k1", stencil.SLOPE, True)):
        wave = " + ".join(f"exp({damping} * abs(d) / {sigma}) * ({a} * cos({w} * abs(d) / {sigma}) + {b} * sin({w} * abs(d) / {sigma}))" for (a, b), (w, damping) in zip(amplitudes, stencil.WAVES, strict=True))
        odd = f"CASE WHEN d < 0 THEN -1 WHEN d > 0 THEN 1 ELSE 0 END * ({wave})" if slope else wave
        cte.append(f"{name} AS MATERIALIZED (SELECT d, h / {'sum(-d * h) OVER ()' if slope else 'sum(h) OVER ()'} AS h FROM (SELECT d, {odd} AS h FROM range(-{reach}, {reach + 1}) t(d)))")
    cte.append("e AS (SELECT max(z) AS mz, max(y) AS my, max(x) AS mx FROM g)")
    for n, (name, source, axis, kernel) in enumerate([("xd", "g", "x", "k1"), ("xs", "g", "x", "k0"), ("xds", "xd", "y", "k0"), ("yds", "xs", "y", "k1"), ("yss", "xs", "y", "k0"), ("fx", "xds", "z", "k0"), ("fy", "yds", "z", "k0"), ("fz", "yss", "z", "k1")]):
        at = ", ".join(f"greatest(0, least(m{a}, a.{a} - d)) AS p{a}" if a == axis else f"a.{a} AS p{a}" for a in "zyx")
        cte.append(f"{name} AS MATERIALIZED (SELECT t.z, t.y, t.x, sum(t.h * b.v) AS v FROM (SELECT a.z, a.y, a.x, h, {at} FROM {source} a, e, {kernel}) t JOIN {source} b ON b.z = pz AND b.y = py AND b.x = px GROUP BY t.z, t.y, t.x)")
    return f"WITH {grid('events')}, {', '.join(cte)} SELECT 'events' AS vol_id, z, y, x, round(sqrt(fx.v * fx.v + fy.v * fy.v + fz.v * fz.v), 5) AS v FROM fx JOIN fy USING (z, y, x) JOIN fz USING (z, y, x)"


@query(_recursive_sql(1.0))
def recursive_gaussian_gradient(spark, sf):
    return _r(stencil.recursive_gaussian_gradient(voxels(spark, sf, "events"), 1.0), "v", digits=5)


# --- thresholds ---

_EDGE = "round(lo + (bin + 1) * w, 6) AS threshold"


def _otsu(bins: int, source: str = "cum") -> str:
    return f"SELECT 'events' AS vol_id, bin, {_EDGE} FROM {source} WHERE c > 0 AND c < n_all ORDER BY CAST(c AS DOUBLE) * (n_all - c) * pow(CAST(m AS DOUBLE) / c - CAST(m_all - m AS DOUBLE) / (n_all - c), 2) DESC, bin LIMIT 1"


@query(f"WITH {grid('events')}, {histogram(128)} {_otsu(128)}")
def otsu_128(spark, sf):
    return _r(threshold.otsu(voxels(spark, sf, "events")), "threshold")


@query(f"WITH {grid('orders')}, {histogram(128)} {_otsu(128).replace('events', 'orders')}")
def otsu_orders(spark, sf):
    return _r(threshold.otsu(voxels(spark, sf, "orders")), "threshold")


def _multi(classes: int) -> str:
    k = classes - 1
    ends = [("0", "0"), *[(f"a{i}.c", f"a{i}.m") for i in range(1, k + 1)], ("a1.n_all", "a1.m_all")]
    score = " + ".join(f"CASE WHEN {c2} - {c1} > 0 THEN CAST({m2} - {m1} AS DOUBLE) * ({m2} - {m1}) / ({c2} - {c1}) ELSE 0 END" for (c1, m1), (c2, m2) in zip(ends, ends[1:], strict=False))
    joins = " ".join(f"JOIN cum a{i} ON a{i}.bin > a{i - 1}.bin" for i in range(2, k + 1))
    cols = ", ".join(f"round(a{i}.lo + (a{i}.bin + 1) * a{i}.w, 6) AS t{i}" for i in range(1, k + 1))
    return f"SELECT 'events' AS vol_id, {cols} FROM cum a1 {joins} ORDER BY {score} DESC, {', '.join(f'a{i}.bin' for i in range(1, k + 1))} LIMIT 1"


@query(f"WITH {grid('events')}, {histogram(64)} {_multi(3)}")
def multi_otsu_3(spark, sf):
    t = threshold.multi_otsu(voxels(spark, sf, "events"), 3, 64)
    return t.select("vol_id", *[F.round(F.col("thresholds")[i], 6).alias(f"t{i + 1}") for i in range(2)])


@query(f"WITH {grid('events')}, {histogram(64)} {_multi(4)}")
def multi_otsu_4(spark, sf):
    t = threshold.multi_otsu(voxels(spark, sf, "events"), 4, 64)
    return t.select("vol_id", *[F.round(F.col("thresholds")[i], 6).alias(f"t{i + 1}") for i in range(3)])


@query(f"""WITH {grid("events")}, {histogram(128)}, b AS (SELECT min(bin) AS b0, max(bin) AS b1 FROM hist WHERE n > 0),
p AS (SELECT t.bin, t.lo, t.w, q.n AS gn, 1 / (1 + abs(q.bin - CASE WHEN q.bin <= t.bin THEN CAST(t.m AS DOUBLE) / t.c ELSE CAST(t.m_all - t.m AS DOUBLE) / (t.n_all - t.c) END) / (b1 - b0)) AS mu
      FROM cum t, hist q, b WHERE t.bin >= b0 AND t.bin < b1 AND q.n > 0)
SELECT 'events' AS vol_id, bin, {_EDGE} FROM p GROUP BY bin, lo, w ORDER BY round(sum(gn * CASE WHEN mu > 0 AND mu < 1 THEN -mu * ln(mu) - (1 - mu) * ln(1 - mu) ELSE 0 END), 6), bin LIMIT 1""")
def huang_128(spark, sf):
    return _r(threshold.huang(voxels(spark, sf, "events")), "threshold")


@query(f"""WITH {grid("events")}, {histogram(128)}, p AS (SELECT bin AS pk, n AS pn FROM hist ORDER BY n DESC, bin LIMIT 1), e AS (SELECT min(bin) AS b0, max(bin) AS b1 FROM hist WHERE n > 0),
f AS (SELECT pk, pn, CASE WHEN b1 - pk >= pk - b0 THEN b1 ELSE b0 END AS fin FROM p, e), k AS (SELECT f.*, hist.n AS en FROM f JOIN hist ON hist.bin = fin)
SELECT 'events' AS vol_id, bin, {_EDGE} FROM hist, k WHERE bin BETWEEN least(pk, fin) AND greatest(pk, fin) ORDER BY abs((fin - pk) * (pn - n) - (pk - bin) * (en - pn)) DESC, bin LIMIT 1""")
def triangle_128(spark, sf):
    return _r(threshold.triangle(voxels(spark, sf, "events")), "threshold")


_LI = "l AS (SELECT bin, lo, w, sum(n) OVER (ORDER BY bin) AS c, sum(n * (bin + 1)) OVER (ORDER BY bin) AS m, sum(n) OVER () AS n_all, sum(n * (bin + 1)) OVER () AS m_all FROM hist)"
_LI_BEST = f"SELECT 'events' AS vol_id, bin, {_EDGE} FROM l WHERE c > 0 AND c < n_all ORDER BY round(-(m * ln(CAST(m AS DOUBLE) / c) + (m_all - m) * ln(CAST(m_all - m AS DOUBLE) / (n_all - c))), 6), bin LIMIT 1"


@query(f"WITH {grid('events')}, {histogram(128)}, {_LI} {_LI_BEST}")
def li_128(spark, sf):
    return _r(threshold.li(voxels(spark, sf, "events")), "threshold")


@query(f"WITH {grid('events')} SELECT vol_id, round(quantile_cont(v, 0.9) FILTER (WHERE v > 0), 6) AS lower, max(v) + 1 AS upper FROM g GROUP BY vol_id")
def percentile_threshold(spark, sf):
    return _r(threshold.percentile_threshold(voxels(spark, sf, "events"), 0.9), "lower")


@query(" UNION ALL ".join(f"(WITH {grid('events')}, {histogram(b)} SELECT vol_id, 'otsu' AS method, {b} AS bins, bin, threshold FROM ({_otsu(b)}))" for b in (32, 64, 128, 256)))
def otsu_bin_sweep(spark, sf):
    return _r(threshold.bin_sweep(voxels(spark, sf, "events"), methods=["otsu"]), "threshold")


@query(f"WITH {grid('events')}, {histogram(64)}, t AS ({_multi(3)}) SELECT g.vol_id, z, y, x, CAST((v > t1)::INTEGER + (v > t2)::INTEGER AS INTEGER) AS label, v FROM g, t")
def multi_otsu_labels(spark, sf):
    g = voxels(spark, sf, "events")
    return threshold.apply_cuts(g, threshold.multi_otsu(g, 3, 64))


@query(f"WITH {grid('events')}, {histogram(64)}, t AS ({_multi(3)}) SELECT vol_id, 0.0::DOUBLE AS l0, round(t1, 2) AS l1, round(t2, 2) AS l2, (SELECT max(v) FROM g) AS l3 FROM t")
def class_limits(spark, sf):
    g = voxels(spark, sf, "events")
    c = threshold.class_limits(g, threshold.multi_otsu(g, 3, 64))
    return c.select("vol_id", *[F.col("limits")[i].alias(f"l{i}") for i in range(4)])


# --- clusters ---


def _lloyd_sql(k: int, rounds: int) -> str:
    seeds = f"m0 AS (SELECT i, lo + (hi - lo) * i / {k - 1} AS m FROM (SELECT min(v) AS lo, max(v) AS hi FROM g WHERE v > 0), range({k}) r(i))"
    steps = [seeds]
    for j in range(rounds):
        # the nearest mean of each value, ties to the smaller
        steps.append(f"l{j} AS (SELECT v, n, arg_min(i, (abs(v - m), i)) AS i FROM q, m{j} GROUP BY v, n)")
        steps.append(f"m{j + 1} AS (SELECT m{j}.i, coalesce(s.m, m{j}.m) AS m FROM m{j} LEFT JOIN (SELECT i, sum(n * v) / sum(n) AS m FROM l{j} GROUP BY i) s ON s.i = m{j}.i)")
    return f"WITH {grid('events')}, q AS (SELECT v, count(*) AS n FROM g GROUP BY v), {', '.join(steps)} SELECT CAST(i AS INTEGER) AS label, round(m, 5) AS mean FROM m{rounds}"


@query(_lloyd_sql(4, 6))
def kmeans_uniform_6(spark, sf):
    g = voxels(spark, sf, "events")
    m = cluster.kmeans(g, cluster.uniform_seeds(g, 4), 6)
    return m.select(F.posexplode("means").alias("label", "mean")).select("label", F.round("mean", 5).alias("mean"))


@query(f"WITH {grid('events')}, q AS (SELECT unnest(quantile_cont(v, [0.02, 0.26, 0.5, 0.74, 0.98])) AS m FROM g WHERE v > 0) SELECT round(m, 6) AS seed FROM q")
def quantile_seeds_5(spark, sf):
    return cluster.quantile_seeds(voxels(spark, sf, "events"), 5).select(F.explode("seeds").alias("seed")).select(F.round("seed", 6).alias("seed"))


def _list_label(ms: str, k: int) -> str:
    return f"len(list_filter(range(1, {k}), lambda i: v > ({ms}[i] + {ms}[i + 1]) / 2))"


def _lloyd_list(t: str, k: int, seeds: str) -> str:
    """CTE of a WITH RECURSIVE: rounds over a list of means, those of the counts q, until no cluster changes."""
    return f"""l{t}(step, ms, sizes, done) AS (SELECT 0, ms, NULL::BIGINT[], false FROM ({seeds}) UNION ALL
SELECT step + 1, ms2, sz2, coalesce(sz2 = sizes, false) FROM (SELECT st.step, st.sizes, list(coalesce(a.m, st.ms[c.j + 1]) ORDER BY c.j) AS ms2, list(coalesce(a.n, 0)::BIGINT ORDER BY c.j) AS sz2
    FROM l{t} st JOIN range({k}) c(j) ON true LEFT JOIN (SELECT {_list_label("s2.ms", k)} AS j, sum(n * v) / sum(n) AS m, sum(n) AS n FROM l{t} s2, q GROUP BY 1) a ON a.j = c.j WHERE NOT st.done GROUP BY st.step, st.sizes))"""


def _sweep_sql(ks: range) -> str:
    """Lloyd to the end as a recursion over lists of means, warm starts from the better run of one cluster less, both scores from value counts."""
    label = _list_label
    cte = ["r AS (SELECT (v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) * 255.0 AS v FROM g)", "q AS MATERIALIZED (SELECT v, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY v)", "p AS MATERIALIZED (SELECT * FROM q WHERE v > 0)", "pv AS MATERIALIZED (SELECT v FROM r WHERE v > 0)"]
    rows = []
    for k in ks:
        runs = {"quantile_anchored": f"SELECT quantile_cont(v, [{', '.join(repr((2 + 96 * i / (k - 1)) / 100) for i in range(k))}]) AS ms FROM pv"}
        if k > ks[0]:
            gaps = "list_transform(range(1, len(e)), lambda i: e[i + 1] - e[i])"
            runs["warm_start"] = f"SELECT list_sort(list_append(ms, (e[gap] + e[gap + 1]) / 2)) AS ms FROM (SELECT *, list_position({gaps}, list_max({gaps})) AS gap FROM (SELECT ms, list_sort(list_concat(list_concat([(SELECT min(v) FROM p)], ms), [(SELECT max(v) FROM p)])) AS e FROM best{k - 1}))"
        for name, seeds in runs.items():
            t = f"{k}{name[0]}"
            cte.append(_lloyd_list(t, k, seeds))
            cte.append(f"e{t} AS MATERIALIZED (SELECT ms FROM l{t} WHERE done)")
            cte.append(f"o{t} AS MATERIALIZED (SELECT v, n, {label('ms', k)} AS label FROM p, e{t})")
            cte.append(f"c{t} AS MATERIALIZED (SELECT label, sum(n) AS n, sum(n * v) AS s, sum(n * v) / sum(n) AS m FROM o{t} GROUP BY label)")
            within = f"(SELECT sum(o.n * pow(o.v - c.m, 2)) FROM o{t} o JOIN c{t} c USING (label))"
            cte.append(f"h{t} AS MATERIALIZED (SELECT (sum(n * pow(m - (SELECT sum(n * v) / sum(n) FROM p), 2)) / (count(*) - 1)) / ({within} / (sum(n) - count(*))) AS ch FROM c{t})")
            cte.append(f"""d{t} AS (SELECT x.v, x.label, x.n, c.label AS other, c.n AS size, sum(CASE WHEN x.label = c.label THEN x.n ELSE 0 END) OVER w AS cc, sum(CASE WHEN x.label = c.label THEN x.n * x.v ELSE 0 END) OVER w AS cs, c.s AS total
    FROM o{t} x, c{t} c WINDOW w AS (PARTITION BY c.label ORDER BY x.v))""")
            cte.append(f"a{t} AS (SELECT v, label, n, other, size, v * cc - cs + (total - cs) - v * (size - cc) AS away FROM d{t})")
            cte.append(f"s{t} AS (SELECT v, label, any_value(n) AS n, max(CASE WHEN other = label AND size > 1 THEN away / (size - 1) END) AS a, min(CASE WHEN other <> label THEN away / size END) AS b FROM a{t} GROUP BY v, label)")
            rows.append(f"SELECT 'events' AS vol_id, {k} AS k, '{name}' AS strategy, {k} AS n_means, round((SELECT ch FROM h{t}), 4) AS ch, round((SELECT sum(n * CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END) / sum(n) FROM s{t}), 4) AS silhouette")
        both = " UNION ALL ".join(f"SELECT ms, ch, '{n}' AS s FROM e{k}{n[0]}, h{k}{n[0]}" for n in runs)
        cte.append(f"best{k} AS MATERIALIZED (SELECT ms FROM ({both}) ORDER BY ch DESC, s LIMIT 1)")
    return f"WITH RECURSIVE {grid('events')}, {', '.join(cte)} {' UNION ALL '.join(rows)}"


@query(_sweep_sql(sweeps.KS))
def kmeans_sweep(spark, sf):
    rows = cluster.sweep(G.rescale_intensity(voxels(spark, sf, "events")), sweeps.KS)
    return _r(rows.select("vol_id", "k", "strategy", F.size("means").alias("n_means"), "ch", "silhouette"), "ch", "silhouette", digits=4)


# --- regions ---

_STEP = "abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x) = 1"
_LIN = "((CAST({0}z AS BIGINT) + 1048576) << 42) + ((CAST({0}y AS BIGINT) + 1048576) << 21) + CAST({0}x AS BIGINT) + 1048576"
_SIX = "(VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) o(dz, dy, dx)"


def _parts_sql(where: str) -> str:
    return f"""WITH RECURSIVE {grid("events")}, b AS MATERIALIZED (SELECT z, y, x, {_LIN.format("")} AS i FROM g WHERE {where}),
e AS MATERIALIZED (SELECT p.i AS i, q.i AS j FROM b p, {_SIX} JOIN b q ON q.z = p.z + dz AND q.y = p.y + dy AND q.x = p.x + dx),
reach(i, j) AS (SELECT i, i FROM b UNION SELECT r.i, e.j FROM reach r JOIN e ON e.i = r.j),
parts AS (SELECT i, min(j) AS component FROM reach GROUP BY i)"""


@query(f"{_parts_sql('v > 90')} SELECT 'events' AS vol_id, z, y, x, component FROM b JOIN parts USING (i)")
def connected_components(spark, sf):
    return regions.components(voxels(spark, sf, "events").where("v > 90"), 8)


@query(f"{_parts_sql('v > 90')} SELECT 'events' AS vol_id, component, count(*) AS n FROM parts GROUP BY component")
def component_sizes(spark, sf):
    return regions.component_sizes(regions.components(voxels(spark, sf, "events").where("v > 90"), 8))


@query(f"{_parts_sql('v > 90')}, s AS (SELECT component, count(*) AS n FROM parts GROUP BY component), k AS (SELECT component FROM s WHERE n >= 3 ORDER BY n DESC, component LIMIT 3) SELECT 'events' AS vol_id, z, y, x, component FROM b JOIN parts USING (i) JOIN k USING (component)")
def top_components(spark, sf):
    return regions.keep_components(regions.components(voxels(spark, sf, "events").where("v > 90"), 8), 3, 3)


_SEED = "10, 10, 12"


@query(f"""WITH RECURSIVE {grid("events")}, b AS MATERIALIZED (SELECT z, y, x FROM g WHERE v BETWEEN 10 AND 400),
f(z, y, x) AS (SELECT z, y, x FROM b WHERE z = (SELECT max(z) // 2 FROM g) AND y = 10 AND x = 12 UNION SELECT b.z, b.y, b.x FROM f, {_SIX} JOIN b ON b.z = f.z + dz AND b.y = f.y + dy AND b.x = f.x + dx)
SELECT 'events' AS vol_id, z, y, x FROM f""")
def connected_threshold(spark, sf):
    g = voxels(spark, sf, "events")
    mid = g.agg(F.expr("max(z) div 2")).first()[0]
    return regions.connected_threshold(g, (mid, 10, 12), 10, 400)


def _confidence_sql(rounds: int, multiplier: float) -> str:
    cte = ["own AS (SELECT v FROM g WHERE z = 1 AND y = 10 AND x = 12)", "s0 AS (SELECT avg(v) AS m, stddev_pop(v) AS s FROM g WHERE z BETWEEN 0 AND 2 AND y BETWEEN 9 AND 11 AND x BETWEEN 11 AND 13)"]
    for k in range(rounds + 1):
        cte.append(f"b{k} AS MATERIALIZED (SELECT z, y, x, g.v FROM g, s{k}, own WHERE g.v BETWEEN least(m - {multiplier} * s, own.v) AND greatest(m + {multiplier} * s, own.v))")
        cte.append(T.flood(f"f{k}", f"b{k}", "z = 1 AND y = 10 AND x = 12"))
        cte.append(f"s{k + 1} AS (SELECT avg(v) AS m, stddev_pop(v) AS s FROM b{k} JOIN f{k} USING (z, y, x))")
    return ", ".join(cte)


@query(f"WITH RECURSIVE {grid('events')}, {_confidence_sql(2, 1.0)} SELECT 'events' AS vol_id, z, y, x FROM f2")
def confidence_connected(spark, sf):
    g = voxels(spark, sf, "events")
    return regions.confidence_connected(g, (1, 10, 12), 1.0, 2)


def _moved_sql(source: str, offsets: list[tuple[int, int, int]], sign: int = 1) -> str:
    rows = ", ".join(f"({z}, {y}, {x})" for z, y, x in offsets)
    s = "+" if sign > 0 else "-"
    return f"SELECT m.z {s} dz AS z, m.y {s} dy AS y, m.x {s} dx AS x FROM {source} m, (VALUES {rows}) o(dz, dy, dx)"


_BOX = "z BETWEEN 0 AND (SELECT max(z) FROM g) AND y BETWEEN 0 AND 19 AND x BETWEEN 0 AND 24"


@query(f"WITH {grid('events')}, b AS (SELECT z, y, x FROM g WHERE v > 150), d AS ({_moved_sql('b', regions.ball(1))}) SELECT DISTINCT 'events' AS vol_id, z, y, x FROM d WHERE {_BOX}")
def dilation(spark, sf):
    g = voxels(spark, sf, "events")
    return regions.dilate(g.where("v > 150"), regions.ball(1), extents(g))


@query(f"WITH {grid('events')}, b AS (SELECT z, y, x FROM g WHERE v > 10), d AS ({_moved_sql('b', regions.ball(1), -1)}) SELECT 'events' AS vol_id, z, y, x FROM d GROUP BY z, y, x HAVING count(*) = {len(regions.ball(1))}")
def erosion(spark, sf):
    return regions.erode(voxels(spark, sf, "events").where("v > 10"), regions.ball(1))


@query(f"WITH {grid('events')}, b AS (SELECT z, y, x FROM g WHERE v > 60), d0 AS ({_moved_sql('b', regions.ball(1))}), d AS (SELECT DISTINCT z, y, x FROM d0 WHERE {_BOX}), e AS ({_moved_sql('d', regions.ball(1), -1)}) SELECT 'events' AS vol_id, z, y, x FROM e GROUP BY z, y, x HAVING count(*) = {len(regions.ball(1))}")
def closing(spark, sf):
    g = voxels(spark, sf, "events")
    return regions.closing(g.where("v > 60"), regions.ball(1), extents(g))


@query(f"WITH {grid('events')}, b AS (SELECT z, y, x FROM g WHERE v > 10), e0 AS ({_moved_sql('b', regions.ball(1), -1)}), e AS (SELECT z, y, x FROM e0 GROUP BY z, y, x HAVING count(*) = {len(regions.ball(1))}), d AS ({_moved_sql('e', regions.ball(1))}) SELECT DISTINCT 'events' AS vol_id, z, y, x FROM d WHERE {_BOX}")
def opening(spark, sf):
    g = voxels(spark, sf, "events")
    return regions.opening(g.where("v > 10"), regions.ball(1), extents(g))


@query(f"""WITH RECURSIVE {grid("events")}, b AS MATERIALIZED (SELECT z, y, x FROM g WHERE v <= 90),
f(z, y, x) AS (SELECT z, y, x FROM b WHERE z IN (0, (SELECT max(z) FROM g)) OR y IN (0, 19) OR x IN (0, 24) UNION SELECT b.z, b.y, b.x FROM f, {_SIX} JOIN b ON b.z = f.z + dz AND b.y = f.y + dy AND b.x = f.x + dx)
SELECT vol_id, z, y, x FROM g WHERE (z, y, x) NOT IN (SELECT (z, y, x) FROM f)""")
def fill_holes(spark, sf):
    g = voxels(spark, sf, "events")
    return regions.fill_holes(g.where("v > 90"), g)


@query(f"""WITH {grid("events")}, m AS (SELECT z, y, x, CASE WHEN v > 120 THEN 1 ELSE 0 END AS label FROM g), b AS (SELECT * FROM m WHERE label = 1), d0 AS ({_moved_sql("b", regions.CROSS)}),
ring AS (SELECT DISTINCT z, y, x FROM d0 WHERE {_BOX} EXCEPT SELECT z, y, x FROM b), {near((1, 1, 1), "replicate")}, gr AS (SELECT z, y, x, sqrt({central()}) AS v FROM n GROUP BY z, y, x)
SELECT 'events' AS vol_id, 1 AS label, round(least((SELECT avg(v) FROM gr JOIN ring USING (z, y, x)) / ((SELECT avg(v) FROM gr) + 1e-8) / 3, 1), 6) AS edge""")
def edge_support(spark, sf):
    g = voxels(spark, sf, "events")
    grad = stencil.gradient_magnitude(g)
    mean = grad.groupBy("vol_id").agg((F.avg("v") + 1e-8).alias("roi_grad"))
    return _r(lesion.edge_support(g.where("v > 120").select(*KEYS, F.lit(1).alias("label")), grad, mean, extents(g)), "edge")


@query(f"""{_parts_sql("v > 90")}, s AS (SELECT component, count(*) AS n, CAST(count(*) AS DOUBLE) / ((max(z) - min(z) + 1) * (max(y) - min(y) + 1) * (max(x) - min(x) + 1)) AS compact FROM b JOIN parts USING (i) GROUP BY component)
SELECT 'events' AS vol_id, 1 AS label, n AS largest, round(compact, 6) AS compact FROM s ORDER BY n DESC, component LIMIT 1""")
def compactness(spark, sf):
    m = voxels(spark, sf, "events").where("v > 90").select(*KEYS, F.lit(1).alias("label"))
    return _r(lesion.compactness(m, ["vol_id", "label"]), "compact")


@query(f"""WITH RECURSIVE {grid("events")}, h AS MATERIALIZED (SELECT z, y, x, v, {_LIN.format("")} AS i FROM g), s AS (SELECT * FROM {_SIX} UNION ALL SELECT 0, 0, 0),
p AS MATERIALIZED (SELECT a.i, arg_min(b.i, (b.v, b.i)) AS t FROM h a, s o(dz, dy, dx) JOIN h b ON b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY a.i),
w(i, t) AS (SELECT i, t FROM p UNION SELECT w.i, p.t FROM w JOIN p ON p.i = w.t), f AS (SELECT w.i, w.t FROM w JOIN p ON p.i = w.t WHERE p.t = w.t)
SELECT 'events' AS vol_id, z, y, x, t AS label FROM h JOIN f USING (i)""")
def watershed_basins(spark, sf):
    return regions.watershed(voxels(spark, sf, "events"))


_GRADIENT = f"{near((1, 1, 1), 'replicate')}, gr AS MATERIALIZED (SELECT z, y, x, sqrt({central()}) AS v FROM n GROUP BY z, y, x)"


@query(f"""WITH RECURSIVE {grid("events")}, {_GRADIENT}, {T.watershed("w", "gr", 0.05)}, {T.merged("c", "w", 0.1)}
SELECT 'events' AS vol_id, z, y, x, component AS label FROM w_b JOIN c ON c.i = w_b.label""")
def watershed_merged(spark, sf):
    return regions.watershed(stencil.gradient_magnitude(voxels(spark, sf, "events")), 0.05, 0.1)


# --- fronts, bias, lesions, pipelines ---


@query()
def fast_marching(spark, sf):
    speed = voxels(spark, sf, "events").withColumn("v", 1 / (1 + F.col("v") / 50))
    return _r(fronts.fast_marching(speed, (1, 10, 12), 5.0, 20.0), "v")


@query()
def level_set(spark, sf):
    return fronts.level_set(voxels(spark, sf, "events"), (1, 10, 12), 2, 0.5, -20.0, 60.0, 40.0)


@query()
def n4_log_bias(spark, sf):
    """Fitted on every second voxel, as the grid is small."""
    return _r(bias.n4_log_bias(voxels(spark, sf, "events"), shrink=2), "v", digits=5)


@query()
def polynomial_log_bias(spark, sf):
    return _r(fronts.polynomial_log_bias(voxels(spark, sf, "events")), "v", digits=5)


_LABELS = "CASE WHEN v < 30 THEN 0 WHEN v < 120 THEN 1 ELSE 2 END AS label"


def _sample_sql(seed: int, total: int, name: str = "s") -> str:
    """CTEs: name(z, y, x, v, label) of the relation lab(z, y, x, v, label, g)."""
    return f"""{name}_p AS (SELECT label, quantile_cont(g, 0.75) AS p75, count(*) AS size, (SELECT count(DISTINCT label) FROM lab) AS k FROM lab GROUP BY label),
{name}_q AS (SELECT lab.*, size, greatest(50, {total} // k) AS quota, g >= p75 AS at_edge, count(*) FILTER (WHERE g >= p75) OVER (PARTITION BY label) AS edges FROM lab JOIN {name}_p USING (label)),
{_hashes({"u": seed}, f"{name}_q").replace("u0 AS", f"{name}_u0 AS").replace("u1 AS", f"{name}_u1 AS").replace("u2 AS", f"{name}_u2 AS").replace("u3 AS", f"{name}_u3 AS").replace("FROM u", f"FROM {name}_u")},
{name}_r AS (SELECT *, CASE WHEN edges = size THEN quota WHEN at_edge THEN quota // 2 ELSE quota - quota // 2 END AS share, row_number() OVER (PARTITION BY label, at_edge AND edges < size ORDER BY u, z, y, x) AS r FROM {name}_u3),
{name} AS MATERIALIZED (SELECT z, y, x, v, label FROM {name}_r WHERE size <= quota OR r <= share)"""


_LAB = f"{_GRADIENT}, lab AS MATERIALIZED (SELECT g.z, g.y, g.x, g.v, {_LABELS.replace('v <', 'g.v <')}, gr.v AS g FROM g JOIN gr USING (z, y, x))"


def _scores_sql(name: str, masks: str, chosen: str) -> str:
    """CTEs: name(label, size, mean, tail, compact, edge, score) of masks(z, y, x, v, label), whose clusters chosen(label) are admissible; the statistics are those of lab."""
    return f"""{T.parts(f"{name}_c", masks, "label")},
{name}_z AS (SELECT label, component, count(*) AS n, CAST(count(*) AS DOUBLE) / ((max(z) - min(z) + 1) * (max(y) - min(y) + 1) * (max(x) - min(x) + 1)) AS compact FROM {name}_c GROUP BY label, component),
{name}_k AS (SELECT label, compact FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, component) AS r FROM {name}_z) WHERE r = 1),
{name}_d AS (SELECT DISTINCT z, y, x, label FROM ({T.moved(masks, regions.CROSS, ", m.label")}) WHERE {T.BOX} EXCEPT SELECT z, y, x, label FROM {masks}),
{name}_g AS (SELECT label, least(avg(gr.v) / (SELECT avg(g) + 1e-8 FROM lab) / 3, 1.0) AS edge FROM {name}_d JOIN gr USING (z, y, x) GROUP BY label),
{name}_m AS (SELECT label, count(*) AS size, avg(v) AS mean FROM {masks} JOIN {chosen} USING (label) GROUP BY label),
{name}_t AS (SELECT *, least(greatest(CASE WHEN bright THEN (mean - p90) / iqr ELSE (p10 - mean) / iqr END, 0), 1) AS tail FROM {name}_m, stats),
{name} AS MATERIALIZED (SELECT label, size, mean, tail, compact, coalesce(edge, 0) AS edge, 0.5 * tail + 0.25 * compact + 0.25 * coalesce(edge, 0) AS score FROM {name}_t JOIN {name}_k USING (label) LEFT JOIN {name}_g USING (label))"""


_STATS = """means AS MATERIALIZED (SELECT label, avg(v) AS m, count(*) AS n FROM lab GROUP BY label),
stats AS MATERIALIZED (SELECT quantile_cont(v, 0.1) AS p10, quantile_cont(v, 0.9) AS p90, greatest(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 1e-6) AS iqr,
    (SELECT max(m) FROM means) - quantile_cont(v, 0.5) >= quantile_cont(v, 0.5) - (SELECT min(m) FROM means) AS bright FROM lab)"""


def _some_labels(spark, sf):
    g = voxels(spark, sf, "events")
    return g, g.select(*KEYS, "v", F.when(F.col("v") < 30, 0).when(F.col("v") < 120, 1).otherwise(2).alias("label"))


@query(f"""WITH RECURSIVE {grid("events")}, {_LAB}, {_STATS}, ok AS (SELECT label FROM means WHERE n BETWEEN 0.001 * (SELECT count(*) FROM lab) AND 0.9 * (SELECT count(*) FROM lab)), {_scores_sql("s", "lab", "ok")}
SELECT 'events' AS vol_id, label, size, round(mean, 5) AS mean_intensity, round(tail, 5) AS tail_extremeness, round(compact, 5) AS compactness, round(edge, 5) AS edge_support, round(score, 5) AS score FROM s""")
def lesion_scores(spark, sf):
    g, labels = _some_labels(spark, sf)
    return _r(lesion.score_clusters(labels, g, max_fraction=0.9), "mean_intensity", "tail_extremeness", "compactness", "edge_support", "score", digits=5)


def _pick_sql(tail: str, least: float, most: float) -> str:
    fixed = {"bright": "true", "dark": "false"}.get(tail)
    stats = _STATS if fixed is None else _STATS.replace("(SELECT max(m) FROM means) - quantile_cont(v, 0.5) >= quantile_cont(v, 0.5) - (SELECT min(m) FROM means) AS bright", f"{fixed} AS bright")
    return f"""WITH RECURSIVE {grid("events")}, {_LAB}, {stats}, ok AS (SELECT label FROM means WHERE n BETWEEN {least} * (SELECT count(*) FROM lab) AND {most} * (SELECT count(*) FROM lab)), {_scores_sql("s", "lab", "ok")},
pr AS (SELECT label AS one, lead(label) OVER (ORDER BY m, label) AS two, row_number() OVER (ORDER BY m, label) AS pair FROM means),
pl AS MATERIALIZED (SELECT z, y, x, v, CAST(pair AS INTEGER) AS label FROM lab JOIN pr ON two IS NOT NULL AND (label = one OR label = two)),
po AS (SELECT label FROM pl GROUP BY label HAVING count(*) <= {most} * (SELECT count(*) FROM lab)), {_scores_sql("t", "pl", "po")},
bs AS (SELECT [label] AS labels, score FROM s ORDER BY score DESC, label LIMIT 1), bp AS (SELECT [one, two] AS labels, score FROM t JOIN pr ON pair = label ORDER BY score DESC, label LIMIT 1),
fb AS (SELECT [label] AS labels FROM means ORDER BY m {"ASC" if tail == "dark" else "DESC"}, label LIMIT 1),
al AS (SELECT fb.labels AS f, bs.labels AS a, bs.score AS sa, bp.labels AS b, bp.score AS sb FROM fb LEFT JOIN bs ON true LEFT JOIN bp ON true)
SELECT 'events' AS vol_id, '{tail} {least} {most}' AS rule, array_to_string(CASE WHEN sb > sa + 0.05 THEN b ELSE coalesce(a, f) END, ',') AS labels, round(CASE WHEN sb > sa + 0.05 THEN sb ELSE sa END, 5) AS score FROM al"""


#: Rules that end in a single cluster, a pair, and the fallback.
_PICKS = [("auto", 0.001, 0.9), ("bright", 0.001, 0.99), ("dark", 0.001, 0.9), ("dark", 0.001, 0.01)]


@query(" UNION ALL ".join(f"(SELECT * FROM ({_pick_sql(*p)}))" for p in _PICKS))
def pick_clusters(spark, sf):
    g, labels = _some_labels(spark, sf)
    rows, measures = None, lesion.measured(labels, g)
    for tail, least, most in _PICKS:
        row = lesion.pick(measures, tail, least, most).select("vol_id", F.lit(f"{tail} {least} {most}").alias("rule"), F.array_join("labels", ",").alias("labels"), F.round("score", 5).alias("score"))
        rows = row if rows is None else rows.unionByName(row)
    return rows


@query(f"""WITH RECURSIVE {grid("events")}, m AS MATERIALIZED (SELECT z, y, x FROM g WHERE v > 150), {T.parts("c", "m")}, k AS (SELECT component FROM c GROUP BY component HAVING count(*) >= 3 ORDER BY count(*) DESC, component LIMIT 3),
t AS MATERIALIZED (SELECT z, y, x FROM c JOIN k USING (component)), d AS MATERIALIZED ({T.dilated("t", regions.CROSS)}), e AS MATERIALIZED ({T.eroded("d", regions.CROSS)}), {T.filled("f", "e")}
SELECT 'events' AS vol_id, z, y, x FROM f""")
def clean_mask(spark, sf):
    g = voxels(spark, sf, "events")
    return lesion.clean_mask(g.where("v > 150"), g, 3, 3)


def _foreground_sql(o: str, radius: tuple[int, int], kept: str) -> str:
    """o: CTEs with o(threshold); kept: the components of c(z, y, x, component) that stay."""
    close, open_ = map(regions.ball, radius)
    return f"""WITH RECURSIVE {grid("events")}, {histogram(128)}, {o}, m AS MATERIALIZED (SELECT z, y, x FROM g, o WHERE v > threshold),
cd AS MATERIALIZED ({T.dilated("m", close, inside=False)}), ce AS MATERIALIZED (SELECT * FROM ({T.eroded("cd", close)}) WHERE {T.BOX}),
bg AS MATERIALIZED (SELECT z, y, x FROM g EXCEPT SELECT z, y, x FROM ce), oe AS MATERIALIZED (SELECT z, y, x FROM ce EXCEPT ({T.dilated("bg", open_)})), od AS MATERIALIZED ({T.dilated("oe", open_)}),
{T.filled("f", "od")}, {T.parts("c", "f")}, k AS (SELECT component FROM c GROUP BY component {kept})
SELECT 'events' AS vol_id, z, y, x FROM c JOIN k USING (component)"""


_PLAIN_EDGE = ("round(lo + (bin + 1) * w, 6)", "lo + (bin + 1) * w")


@query(_foreground_sql(f"o AS ({_otsu(128).replace(*_PLAIN_EDGE)})", (1, 1), "ORDER BY count(*) DESC, component LIMIT 1"))
def foreground_roi(spark, sf):
    return lesion.foreground(voxels(spark, sf, "events"), "otsu", 1, 1, least=0)


@query(_foreground_sql(f"{_LI}, o AS ({_LI_BEST.replace(*_PLAIN_EDGE)})", (1, 1), "HAVING count(*) >= 5"))
def foreground_roi_parts(spark, sf):
    """All parts of a least size, as for breasts."""
    return lesion.foreground(voxels(spark, sf, "events"), "li", 1, 1, least=0, largest=False, least_part=5)


@query(f"""WITH {grid("events")}, {_LAB}, {", ".join(_sample_sql(42 + i, 3000, f"s{i}") for i in range(3))},
{", ".join(f"""c{i} AS (SELECT label, count(*) AS n, avg(v) AS m, var_pop(v) AS s FROM s{i} GROUP BY label), h{i} AS (SELECT (sum(n * pow(m - (SELECT avg(v) FROM s{i}), 2)) / (count(*) - 1)) / (sum(n * s) / (sum(n) - count(*))) AS ch FROM c{i}),
q{i} AS (SELECT label, v, count(*) AS n FROM s{i} GROUP BY 1, 2), d{i} AS (SELECT a.label, a.v, any_value(a.n) AS n, b.label AS other, sum(b.n * abs(a.v - b.v)) AS away FROM q{i} a, q{i} b GROUP BY a.label, a.v, b.label),
w{i} AS (SELECT d.label, v, any_value(d.n) AS n, max(CASE WHEN other = d.label AND c.n > 1 THEN away / (c.n - 1) END) AS a, min(CASE WHEN other <> d.label THEN away / c.n END) AS b FROM d{i} d JOIN c{i} c ON c.label = d.other GROUP BY d.label, v)""" for i in range(3))},
r AS ({" UNION ALL ".join(f"SELECT (SELECT ch FROM h{i}) AS ch, (SELECT sum(n * CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END) / sum(n) FROM w{i}) AS si" for i in range(3))})
SELECT 'events' AS vol_id, round(avg(ch), 4) AS ch_mean, round(var_pop(ch), 3) AS ch_var, round(avg(si), 6) AS silhouette_mean, round(var_pop(si), 8) AS silhouette_var FROM r""")
def repeated_evaluation(spark, sf):
    g, labels = _some_labels(spark, sf)
    e = lesion.evaluate(labels, stencil.gradient_magnitude(g), 3, 3000)
    return e.select("vol_id", F.round("ch_mean", 4).alias("ch_mean"), F.round("ch_var", 3).alias("ch_var"), F.round("silhouette_mean", 6).alias("silhouette_mean"), F.round("silhouette_var", 8).alias("silhouette_var"))


@query(f"""WITH {grid("events")}, s AS (SELECT greatest(0, 1 - min(v)) AS shift FROM g WHERE v > 50), p AS (SELECT v + shift AS v, shift FROM g, s WHERE v > 50), m AS (SELECT avg(v) AS mu, stddev_pop(v) AS sd FROM p), z AS (SELECT (v - mu) / CASE WHEN sd < 1e-6 THEN 1 ELSE sd END AS v FROM p, m)
SELECT 'events' AS vol_id, round((SELECT shift FROM s), 6) AS shift, count(*) AS n, round(min(v), 5) AS min, round(max(v), 5) AS max, round(avg(v), 5) + 0.0 AS mean FROM z""")
def preprocessing_stats(spark, sf):
    g = voxels(spark, sf, "events")
    st = lesion.preprocessing_stats(g, F.col("v") > 50)
    return st.select("vol_id", F.round("shift", 6).alias("shift"), "n", *[F.round(c, 5).alias(c) for c in ("min", "max")], (F.round("mean", 5) + 0.0).alias("mean"))


@query()
def lesion_pipeline(spark, sf):
    """With the liver's settings, but for a least foreground that fits the grid."""
    return sweeps.lesion_run(voxels(spark, sf, "events"), least_lesion=3, least=50)[0]


@query()
def lesion_mask(spark, sf):
    """The label map of the same run by the breast's settings, with sizes that fit the grid."""
    return sweeps.lesion_run(voxels(spark, sf, "events"), "breast", range(3, 5), least_lesion=3, close_radius=1, open_radius=1, least_part=50, least=50)[1]


def _no_run(v, p):
    raise ValueError("this run fails")


@query(f"""WITH {grid("events")}, r AS (SELECT 'mean' AS run, count(*) AS n, 1 AS ok FROM g UNION ALL SELECT 'mean', count(*), 1 FROM g UNION ALL SELECT 'gradient', count(*), 1 FROM g UNION ALL SELECT 'fails', 0, 0)
SELECT run, count(*) AS attempts, sum(ok)::BIGINT AS succeeded, (count(*) - sum(ok))::BIGINT AS failed, sum(n)::BIGINT AS n FROM r GROUP BY ROLLUP (run)""")
def batch_runs(spark, sf):
    """A batch of two runs, then one of these and three more, one of which fails: tallies of the manifest."""
    folder = f"{shared_folder(spark)}/batch-{uuid.uuid4().hex}"
    g = cut(voxels(spark, sf, "events"))
    mean = [runs.Run("mean", lambda v, p: stencil.mean_filter(v, p["r"]), {"r": r}) for r in (1, 2)]
    gradient = runs.Run("gradient", lambda v, p: stencil.gradient_magnitude(v))
    runs.run_all(g, [mean[0], gradient], folder)
    return runs.tallies(runs.run_all(g, [mean[0], gradient, mean[1], runs.Run("fails", _no_run)], folder)).drop("seconds", "longest")


@query(f"""WITH {grid("events")}, s AS (SELECT concat('events_', z) AS vol_id, v FROM {uint8()})
SELECT vol_id, CAST(v AS INTEGER) AS bin, count(*) AS n FROM s GROUP BY ALL""")
def png_histogram(spark, sf):
    """The planes of a volume as PNG images in the shared folder, and the histograms of the images read back."""
    folder = f"{shared_folder(spark)}/png-{uuid.uuid4().hex}"
    planes = _u8(spark, sf).select(F.concat_ws("_", "vol_id", "z").alias("vol_id"), F.col("y").alias("r"), F.col("x").alias("c"), "v")
    cut(raster.write_png(planes, folder))
    seen = raster.read_png(spark, f"{folder}/*")
    return seen.groupBy("vol_id", F.round(F.col("v") * 255).cast("int").alias("bin")).agg(F.count("*").alias("n"))


_U16 = "u AS (SELECT vol_id, z, y, x, CAST(floor((v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) * 65535.0) AS DOUBLE) AS v FROM g)"


def _compared_sql() -> str:
    one = lambda sql: sql.split(f"{histogram(128)}", 1)[1].lstrip().removeprefix(",").strip()
    rows = []
    for name in ("otsu", "huang", "triangle"):
        rest = one(ORACLE_SQL[f"{name}_128"])
        rest = f"WITH {rest}" if not rest.startswith("SELECT") else rest
        rows.append(f"SELECT '{name}' AS method, bin, threshold FROM ({rest})")
    found = " UNION ALL ".join(rows).replace("round(lo + (bin + 1) * w, 6)", "lo + (bin + 1) * w")
    return f"WITH {grid('events')}, {_U16}, {histogram(128, 'u')}, t AS ({found}) SELECT 'events' AS vol_id, method, bin, round(threshold, 4) AS threshold, count(*) FILTER (WHERE v > threshold) AS above, count(*) AS n FROM u, t GROUP BY method, bin, threshold"


@query(_compared_sql())
def threshold_comparison(spark, sf):
    return sweeps.threshold_comparison(voxels(spark, sf, "events"))


def _separable_gradient(name: str, sigma: float) -> str:
    """CTEs: name(z, y, x, v), the Gaussian gradient, an axis at a time, borders replicated."""
    g, d = stencil.gaussian_weights(sigma)
    r = len(g) // 2
    cte = []
    for axis in "zyx":
        source = "g"
        for a in "zyx":
            w = d if a == axis else g
            rows = ", ".join(f"({k}, {float(w[k + r])!r}::DOUBLE)" for k in range(-r, r + 1))
            on = " AND ".join(f"h.{b} = t.{'at' if b == a else b}" for b in "zyx")
            out = f"{name}_{axis}{a}"
            cte.append(f"{out} AS MATERIALIZED (SELECT t.z, t.y, t.x, sum(c * h.v) AS v FROM (SELECT s.z, s.y, s.x, c, greatest(0, least((SELECT max({a}) FROM g), s.{a} + k)) AS at FROM {source} s, (VALUES {rows}) o(k, c)) t JOIN {source} h ON {on} GROUP BY t.z, t.y, t.x)")
            source = out
    total = " + ".join(f"pow({a}.v, 2)" for a in "zyx")
    return ", ".join(cte) + f", {name} AS MATERIALIZED (SELECT z.z, z.y, z.x, sqrt({total}) AS v FROM {name}_zx z JOIN {name}_yx y ON y.z = z.z AND y.y = z.y AND y.x = z.x JOIN {name}_xx x ON x.z = z.z AND x.y = z.y AND x.x = z.x)"


def _watershed_sweep_sql(sigmas: list[float], thresholds: list[float], levels: list[float]) -> str:
    cte, rows = [], []
    for i, sigma in enumerate(sigmas):
        cte.append(_separable_gradient(f"h{i}", sigma))
        for j, threshold in enumerate(thresholds):
            cte.append(T.watershed(f"w{i}{j}", f"h{i}", threshold))
            for k, level in enumerate(levels):
                cte.append(T.merged(f"c{i}{j}{k}", f"w{i}{j}", level))
                rows.append(f"SELECT 'events' AS vol_id, {sigma}::DOUBLE AS sigma, {threshold}::DOUBLE AS threshold, {level}::DOUBLE AS level, (SELECT count(DISTINCT component) FROM c{i}{j}{k}) AS basins, (SELECT count(*) FROM g) AS n")
    return f"WITH RECURSIVE {grid('events')}, {', '.join(cte)} {' UNION ALL '.join(rows)}"


@query(_watershed_sweep_sql(**sweeps.WATERSHED))
def watershed_sweep(spark, sf):
    return sweeps.watershed_sweep(voxels(spark, sf, "events"), **sweeps.WATERSHED)


@query()
def level_set_sweep(spark, sf):
    return sweeps.level_set_sweep(voxels(spark, sf, "events"), (1, 10, 12), **sweeps.LEVEL_SET, fixed=sweeps.LEVEL_SET_FIXED, best=sweeps.LEVEL_SET_BEST)


def _filter_batch_sql() -> str:
    inside = lambda r: f"abs(dz) <= {r} AND abs(dy) <= {r} AND abs(dx) <= {r}"
    f = lambda a, b: f"0.5 * sign(d) * pow(abs(2 * d), {a}) - {b} * 0.5 * sign(d) * abs(2 * d) + {b} * u"
    runs = {"gradient": f"floor(least(255, greatest(0, sqrt({central()}))))"}
    runs |= {f"mean_r{r}": f"avg(w) FILTER (WHERE {inside(r)})" for r in sweeps.FILTER_RADII} | {f"median_r{r}": f"median(w) FILTER (WHERE {inside(r)})" for r in sweeps.FILTER_RADII}
    runs |= {f"equalise_a{a}_b{b}_r{r}": f"(avg({f(a, b)}) FILTER (WHERE {inside(r)}) + 0.5) * 500" for a in sweeps.EQUALISE for b in sweeps.EQUALISE for r in sweeps.EQUALISE_RADII}
    columns = ", ".join(f"{e} AS c{i}" for i, e in enumerate(runs.values()))
    rows = " UNION ALL ".join(f"SELECT 'events' AS vol_id, '{name}' AS filter, count(*) AS n, round(min(c{i}), 4) AS min, round(max(c{i}), 4) AS max, round(avg(c{i}), 4) AS mean, round(stddev_pop(c{i}), 4) AS std FROM s" for i, name in enumerate(runs))
    return f"WITH {grid('events')}, {near((5, 5, 5), 'replicate')}, k AS (SELECT *, v / 500 - 0.5 AS u, (v - w) / 500 AS d FROM n), s AS MATERIALIZED (SELECT z, y, x, {columns} FROM k GROUP BY z, y, x) {rows}"


@query(_filter_batch_sql())
def filter_batch(spark, sf):
    return sweeps.filter_batch(voxels(spark, sf, "events"))


@query(f"""WITH RECURSIVE {grid("events")}, {_confidence_sql(2, 1.0)}, a AS MATERIALIZED (SELECT z, y, x FROM g WHERE v BETWEEN 10 AND 400), {T.flood("c", "a", "z = 1 AND y = 10 AND x = 12")}
SELECT 'connected_threshold' AS method, count(*) AS voxels FROM c UNION ALL SELECT 'confidence_connected', count(*) FROM f2 UNION ALL SELECT 'both', count(*) FROM c JOIN f2 USING (z, y, x)""")
def region_growing_comparison(spark, sf):
    return sweeps.region_growing(voxels(spark, sf, "events"), (1, 10, 12), 10, 400)


@query(f"WITH {grid('events')}, {_LAB}, {_sample_sql(42, 3000)} SELECT 'events' AS vol_id, * FROM s")
def stratified_sample(spark, sf):
    g = voxels(spark, sf, "events")
    labels = g.select(*KEYS, "v", F.when(F.col("v") < 30, 0).when(F.col("v") < 120, 1).otherwise(2).alias("label"))
    return lesion.stratified_sample(labels, stencil.gradient_magnitude(g), 3000)


@query(f"SELECT vol_id, k, strategy, ch FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ch DESC, strategy) AS r FROM ({_sweep_sql(sweeps.KS)})) WHERE r = 1")
def best_run_per_k(spark, sf):
    rows = cluster.sweep(G.rescale_intensity(voxels(spark, sf, "events")), sweeps.KS)
    best = cluster.best_per_k(rows).select("vol_id", F.explode("best").alias("k", "b"))
    return best.select("vol_id", "k", "b.strategy", F.round("b.ch", 4).alias("ch"))


_COUNTS = "SELECT vol_id, '{0}' AS method, CAST(label AS INTEGER) AS label, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM g), 6) AS percent FROM {1} GROUP BY vol_id, label"


@query(f"""WITH RECURSIVE {grid("orders")}, {histogram(128)}, o AS ({_multi(3).replace("'events'", "'orders'").replace("round(", "(").replace(", 6)", ")")}), q AS MATERIALIZED (SELECT v, count(*) AS n FROM g GROUP BY v),
{_lloyd_list("k", 3, "SELECT [lo, lo + (hi - lo) / 2, hi] AS ms FROM (SELECT min(v) AS lo, max(v) AS hi FROM g WHERE v > 0)")}, km AS MATERIALIZED (SELECT ms FROM lk WHERE done),
p AS (SELECT quantile_cont(v, 0.40) AS a, quantile_cont(v, 0.60) AS b FROM g WHERE v > 0),
la AS (SELECT vol_id, CASE WHEN v BETWEEN a AND b THEN 1 ELSE 0 END AS label FROM g, p), lb AS (SELECT g.vol_id, (v > t1)::INTEGER + (v > t2)::INTEGER AS label FROM g, o), lc AS (SELECT vol_id, {_list_label("ms", 3)} AS label FROM g, km)
{" UNION ALL ".join(_COUNTS.format(n, t) for n, t in (("range", "la"), ("otsu", "lb"), ("kmeans", "lc")))}""")
def threshold_workshop(spark, sf):
    return _r(sweeps.workshop(voxels(spark, sf, "orders"), "liver"), "percent")
