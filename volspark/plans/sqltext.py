"""Pieces of DuckDB SQL shared by the oracles: grids, stencils, histograms."""

GRIDS = {
    "orders": "SELECT 'orders' AS vol_id, CAST(o_orderkey // 500 AS INTEGER) AS z, CAST((o_orderkey // 25) % 20 AS INTEGER) AS y, CAST(o_orderkey % 25 AS INTEGER) AS x, CAST(o_totalprice AS DOUBLE) AS v FROM orders",
    "events": "SELECT 'events' AS vol_id, CAST(event_id // 500 AS INTEGER) AS z, CAST((event_id // 25) % 20 AS INTEGER) AS y, CAST(event_id % 25 AS INTEGER) AS x, CAST(value AS DOUBLE) AS v FROM events",
    "embeddings": "SELECT 'embeddings' AS vol_id, CAST(vec_id AS INTEGER) AS z, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, CAST(e AS DOUBLE) AS v FROM (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding) AS e FROM embeddings)",
}


def grid(name: str) -> str:
    return f"g AS ({GRIDS[name]})"


def uint8(source: str = "g") -> str:
    """A relation of whole numbers 0..255 over a grid."""
    return f"(SELECT vol_id, z, y, x, CAST(floor(least(255, greatest(0, (v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) * 255))) AS INTEGER) AS v FROM {source})"


def _mapped(axis: str, boundary: str) -> str:
    t, m = f"(g.{axis} + o.d{axis})", f"s.m{axis}"
    if boundary == "replicate":
        return f"greatest(0, least({m}, {t}))"
    if boundary == "reflect":
        return f"CASE WHEN {t} < 0 THEN -{t} WHEN {t} > {m} THEN 2 * {m} - {t} ELSE {t} END"
    return f"CASE WHEN {t} < 0 THEN -{t} - 1 WHEN {t} > {m} THEN 2 * {m} + 1 - {t} ELSE {t} END"


def stencil(halo: tuple[int, int, int], boundary: str, source: str = "g", name: str = "n") -> str:
    """CTEs: name(vol_id, z, y, x, v, dz, dy, dx, w), w the value of a neighbour, borders mapped."""
    ranges = ", ".join(f"range(-{h}, {h + 1}) t{a}(d{a})" for a, h in zip("zyx", halo, strict=True))
    targets = ", ".join(f"CAST({_mapped(a, boundary)} AS INTEGER) AS t{a}" for a in "zyx")
    on = " AND ".join(["h.vol_id = t.vol_id", *[f"h.{a} = t.t{a}" for a in "zyx"]])
    return f"""{name}_s AS (SELECT max(z) AS mz, max(y) AS my, max(x) AS mx FROM {source}),
{name}_o AS (SELECT CAST(dz AS INTEGER) AS dz, CAST(dy AS INTEGER) AS dy, CAST(dx AS INTEGER) AS dx FROM {ranges}),
{name}_t AS (SELECT g.vol_id, g.z, g.y, g.x, g.v, o.dz, o.dy, o.dx, {targets} FROM {source} g, {name}_o o, {name}_s s),
{name} AS (SELECT t.vol_id, t.z, t.y, t.x, t.v, t.dz, t.dy, t.dx, h.v AS w FROM {name}_t t JOIN {source} h ON {on})"""


def central(source: str = "n") -> str:
    """Squared central-difference magnitude from a radius-1 stencil, as expression over its group."""
    parts = []
    for a in "zyx":
        rest = " AND ".join(f"d{b} = 0" for b in "zyx" if b != a)
        parts.append(f"pow((max(CASE WHEN d{a} = 1 AND {rest} THEN w END) - max(CASE WHEN d{a} = -1 AND {rest} THEN w END)) / 2, 2)")
    return " + ".join(parts)


def histogram(bins: int, source: str = "g") -> str:
    """CTEs: r(lo, hi), hist(bin, n, lo, w) with empty bins, cum (with c, m, n_all, m_all)."""
    return f"""r AS (SELECT min(v) AS lo, max(v) AS hi FROM {source}),
hc AS (SELECT CAST(least({bins - 1}, floor((v - lo) / (hi - lo) * {bins})) AS INTEGER) AS bin, count(*) AS n FROM {source}, r GROUP BY 1),
hist AS (SELECT CAST(b.bin AS INTEGER) AS bin, coalesce(n, 0) AS n, lo, (hi - lo) / {bins} AS w FROM range({bins}) b(bin) LEFT JOIN hc USING (bin), r),
cum AS (SELECT *, CAST(sum(n) OVER (ORDER BY bin) AS BIGINT) AS c, CAST(sum(n * bin) OVER (ORDER BY bin) AS BIGINT) AS m, CAST(sum(n) OVER () AS BIGINT) AS n_all, CAST(sum(n * bin) OVER () AS BIGINT) AS m_all FROM hist)"""


SIX = "(VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) o(dz, dy, dx)"
BOX = "z BETWEEN 0 AND (SELECT max(z) FROM g) AND y BETWEEN 0 AND 19 AND x BETWEEN 0 AND 24"


def linear(prefix: str = "") -> str:
    return f"((CAST({prefix}z AS BIGINT) + 1048576) << 42) + ((CAST({prefix}y AS BIGINT) + 1048576) << 21) + CAST({prefix}x AS BIGINT) + 1048576"


def labels(name: str, nodes: str, edges: str) -> str:
    """CTEs of a WITH RECURSIVE: name(i, component), the least node that a node reaches. nodes: a relation of i; edges: of i and j, both ways.
    Labels go to all neighbours at once until none changes."""
    return f"""{name}_e AS MATERIALIZED (SELECT i, j FROM {edges} UNION SELECT i, i FROM {nodes}),
{name}_r(step, i, c) AS (SELECT 0, i, i FROM {nodes} UNION ALL
    SELECT step, i, c FROM (SELECT r.step + 1 AS step, e.i, min(r.c) AS c, max(CASE WHEN e.j = e.i THEN r.c END) AS old FROM {name}_r r JOIN {name}_e e ON e.j = r.i GROUP BY r.step, e.i) QUALIFY sum(CASE WHEN c <> old THEN 1 ELSE 0 END) OVER () > 0),
{name} AS MATERIALIZED (SELECT i, c AS component FROM {name}_r WHERE step = (SELECT max(step) FROM {name}_r))"""


def parts(name: str, mask: str, *by: str) -> str:
    """CTEs: name(z, y, x, by, component) of the face-connected parts of a mask (z, y, x, by); parts of different by are apart."""
    more = "".join(f", {b}" for b in by)
    key = f"{linear()}" + "".join(f" + (CAST({b} AS BIGINT) << 58)" for b in by)
    same = "".join(f" AND q.{b} = p.{b}" for b in by)
    return f"""{name}_b AS MATERIALIZED (SELECT z, y, x{more}, {linear()} AS own, {key} AS i FROM {mask}),
{name}_p AS MATERIALIZED (SELECT p.i, q.i AS j FROM {name}_b p, {SIX} JOIN {name}_b q ON q.z = p.z + dz AND q.y = p.y + dy AND q.x = p.x + dx{same}),
{labels(f"{name}_l", f"{name}_b", f"{name}_p")},
{name} AS MATERIALIZED (SELECT b.z, b.y, b.x{"".join(f", b.{b}" for b in by)}, r.own AS component FROM {name}_b b JOIN {name}_l l USING (i) JOIN {name}_b r ON r.i = l.component)"""


def flood(name: str, allowed: str, start: str) -> str:
    """CTE of a WITH RECURSIVE: name(z, y, x), what is reached in the relation allowed from its rows where start holds."""
    return f"{name}(z, y, x) AS (SELECT z, y, x FROM {allowed} WHERE {start} UNION SELECT b.z, b.y, b.x FROM {name} f, {SIX} JOIN {allowed} b ON b.z = f.z + dz AND b.y = f.y + dy AND b.x = f.x + dx)"


def moved(source: str, offsets: list[tuple[int, int, int]], more: str = "") -> str:
    rows = ", ".join(f"({z}, {y}, {x})" for z, y, x in offsets)
    return f"SELECT m.z + dz AS z, m.y + dy AS y, m.x + dx AS x{more} FROM {source} m, (VALUES {rows}) o(dz, dy, dx)"


def dilated(source: str, offsets: list[tuple[int, int, int]], inside: bool = True) -> str:
    return f"SELECT DISTINCT z, y, x FROM ({moved(source, offsets)})" + (f" WHERE {BOX}" if inside else "")


def eroded(source: str, offsets: list[tuple[int, int, int]]) -> str:
    return f"SELECT z, y, x FROM ({moved(source, [tuple(-v for v in o) for o in offsets])}) GROUP BY z, y, x HAVING count(*) = {len(offsets)}"


def filled(name: str, mask: str) -> str:
    """CTEs: name, the mask with its holes."""
    return f"""{name}_o AS MATERIALIZED (SELECT z, y, x FROM g EXCEPT SELECT z, y, x FROM {mask}),
{flood(f"{name}_f", f"{name}_o", "z IN (0, (SELECT max(z) FROM g)) OR y IN (0, 19) OR x IN (0, 24)")},
{name} AS MATERIALIZED (SELECT z, y, x FROM g EXCEPT SELECT z, y, x FROM {name}_f)"""


def watershed(name: str, height: str, threshold: float) -> str:
    """CTEs of a WITH RECURSIVE: name_b(z, y, x, v, label), name_s(a, b, saliency, span) of the basins of height(z, y, x, v): regions merge one pass
    after the other, the lowest first, and the one of the higher floor ends; root has the region of each basin, floors its floor."""
    return f"""{name}_m AS (SELECT min(v) AS mn, max(v) AS mx FROM {height}),
{name}_h AS MATERIALIZED (SELECT z, y, x, greatest(v, mn + {threshold}::DOUBLE * (mx - mn)) AS v, {linear()} AS i FROM {height}, {name}_m),
{name}_p AS MATERIALIZED (SELECT a.i, arg_min(b.i, (b.v, b.i)) AS t FROM {name}_h a, (SELECT * FROM {SIX} UNION ALL SELECT 0, 0, 0) o(dz, dy, dx) JOIN {name}_h b ON b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY a.i),
{name}_w(i, t) AS (SELECT i, t FROM {name}_p UNION SELECT w.i, p.t FROM {name}_w w JOIN {name}_p p ON p.i = w.t),
{name}_b AS MATERIALIZED (SELECT h.*, w.t AS label FROM {name}_h h JOIN {name}_w w USING (i) JOIN {name}_p p ON p.i = w.t WHERE p.t = w.t),
{name}_k AS MATERIALIZED (SELECT label, min(v) AS floor, row_number() OVER (ORDER BY label) AS no FROM {name}_b GROUP BY label),
{name}_q AS (SELECT ka.no AS a, kb.no AS b, pass FROM (SELECT least(p.label, q.label) AS la, greatest(p.label, q.label) AS lb, min(greatest(p.v, q.v)) AS pass FROM {name}_b p, {SIX} JOIN {name}_b q ON q.z = p.z + dz AND q.y = p.y + dy AND q.x = p.x + dx WHERE p.label <> q.label GROUP BY 1, 2)
    JOIN {name}_k ka ON ka.label = la JOIN {name}_k kb ON kb.label = lb),
{name}_o AS MATERIALIZED (SELECT a, b, pass, row_number() OVER (ORDER BY pass, a, b) AS step FROM {name}_q),
{name}_t(step, a, b, pass, root, floors, saliency) AS (SELECT 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::DOUBLE, (SELECT list(no ORDER BY no) FROM {name}_k), (SELECT list(floor ORDER BY no) FROM {name}_k), NULL::DOUBLE UNION ALL
    SELECT step, a, b, pass, CASE WHEN p = q THEN root ELSE list_transform(root, lambda r: CASE WHEN r = p THEN q ELSE r END) END, floors, CASE WHEN p <> q THEN pass - floors[p] END
    FROM (SELECT step, a, b, pass, root, floors, CASE WHEN (floors[p], p) < (floors[q], q) THEN q ELSE p END AS p, CASE WHEN (floors[p], p) < (floors[q], q) THEN p ELSE q END AS q
        FROM (SELECT o.step, o.a, o.b, o.pass, t.root, t.floors, t.root[o.a] AS p, t.root[o.b] AS q FROM {name}_t t JOIN {name}_o o ON o.step = t.step + 1))),
{name}_s AS MATERIALIZED (SELECT ka.label AS a, kb.label AS b, saliency, (SELECT max(v) - min(v) FROM {name}_b) AS span FROM {name}_t JOIN {name}_k ka ON ka.no = a JOIN {name}_k kb ON kb.no = b WHERE saliency IS NOT NULL)"""


def merged(name: str, basins: str, level: float) -> str:
    """CTEs: name(i, component) of the labels of watershed(basins) at a level."""
    e = f"(SELECT a AS i, b AS j FROM {basins}_s WHERE saliency <= span * {level}::DOUBLE UNION SELECT b, a FROM {basins}_s WHERE saliency <= span * {level}::DOUBLE)"
    return labels(name, f"(SELECT label AS i FROM {basins}_k)", e)
