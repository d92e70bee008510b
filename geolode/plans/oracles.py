"""The registered queries as DuckDB SQL over the same tables."""

from __future__ import annotations

import re


def r(x: str, name: str | None = None) -> str:
    return f"round({x}, 8) + 0.0 AS {name or x}"


def rs(*names: str) -> str:
    return ", ".join(r(n) for n in names)


V = "v AS (SELECT o_orderkey AS vid, (o_orderkey % 50)::DOUBLE AS x, (o_orderkey // 50)::DOUBLE AS y, o_totalprice / 100000 AS z FROM orders)"
REF = "ref AS (SELECT vid, 2.5 + x * 0.01 + (y % 7) * 0.02 AS z FROM v)"
FACES = V + """,
cell AS (SELECT vid FROM v WHERE vid % 50 < 49 AND vid + 50 IN (SELECT vid FROM v)),
f AS (SELECT 2 * vid AS fid, vid AS a, vid + 1 AS b, vid + 50 AS c FROM cell UNION ALL SELECT 2 * vid + 1, vid + 1, vid + 51, vid + 50 FROM cell)"""
XYZ = FACES + """,
g AS (SELECT f.*, p.x AS ax, p.y AS ay, p.z AS az, q.x AS bx, q.y AS by, q.z AS bz, s.x AS cx, s.y AS cy, s.z AS cz
  FROM f JOIN v p ON p.vid = f.a JOIN v q ON q.vid = f.b JOIN v s ON s.vid = f.c),
n AS (SELECT *, (by - ay) * (cz - az) - (bz - az) * (cy - ay) AS nx, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) AS ny, (bx - ax) * (cy - ay) - (by - ay) * (cx - ax) AS nz FROM g),
m AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) / 2 AS surface_area, abs(nz) / 2 AS plan_area,
  CASE WHEN abs(nz) < 1e-12 THEN 'inf'::DOUBLE ELSE sqrt(nx * nx + ny * ny) / abs(nz) END AS slope, (ax + bx + cx) / 3 AS mx, (ay + by + cy) / 3 AS my, (az + bz + cz) / 3 AS mz FROM n)"""
ZONES = """z AS (SELECT n_nationkey AS zone_id, (n_nationkey % 5) * 9.8::DOUBLE AS x0, (n_nationkey // 5) * (h / 5) AS y0, (n_nationkey % 5 + 1) * 9.8::DOUBLE AS x1, (n_nationkey // 5 + 1) * (h / 5) AS y1, n_regionkey AS priority
  FROM nation, (SELECT max(y) AS h FROM v))"""
HALF = """e AS (SELECT fid, 0 AS k, a, b FROM f UNION ALL SELECT fid, 1, b, c FROM f UNION ALL SELECT fid, 2, c, a FROM f),
h AS (SELECT *, least(a, b) AS u, greatest(a, b) AS w FROM e),
edges AS (SELECT u, w AS v, count(*) AS n_faces FROM h GROUP BY u, w)"""
BEARING = """bearing AS (SELECT fid, plan_area, CASE WHEN (hx * hx + hy * hy = 0) OR (nz != 0 AND slope <= 0.005) THEN NULL ELSE CASE WHEN t >= 360 THEN 0.0 ELSE t END END AS bearing
  FROM (SELECT *, (((90 - degrees(atan2(hy, hx))) % 360) + 360) % 360 AS t FROM (SELECT *, nx * CASE WHEN nz < 0 THEN -1 ELSE 1 END AS hx, ny * CASE WHEN nz < 0 THEN -1 ELSE 1 END AS hy FROM m)))"""
SLOPES = "val AS (SELECT round(slope * 100, 8) + 0.0 AS v, round(plan_area, 8) AS w FROM m WHERE slope < 'inf'::DOUBLE)"
HIST = SLOPES + """, ext AS (SELECT min(v) AS lo, max(v) AS hi, sum(w) AS total FROM val WHERE w > 0),
hist AS (SELECT CASE WHEN hi > lo THEN floor((v - lo) / (hi - lo) * 2047) ELSE 0 END::INT AS bin, sum(w) AS weight FROM val, ext WHERE w > 0 GROUP BY 1)"""


def percentile(p: float) -> str:
    return f"""(SELECT least(hi, lo + (bin + ({p} * t - (upto - weight)) / weight) / 2047 * (hi - lo)) FROM cum, ext WHERE upto >= {p} * t ORDER BY bin LIMIT 1)"""


CUM = HIST + ", cum AS (SELECT bin, weight, sum(weight) OVER (ORDER BY bin) AS upto, sum(weight) OVER () AS t FROM hist)"


def nice(x: str) -> str:
    p = f"pow(10.0, floor(log10({x})))"
    return f"(CASE WHEN {x} / {p} <= 1 THEN 1 WHEN {x} / {p} <= 2 THEN 2 WHEN {x} / {p} <= 5 THEN 5 ELSE 10 END * {p})"


def auto(zero: bool) -> str:
    lo, hi = ("least(p02, 0)", "greatest(p98, 0)") if zero else ("p02", "p98")
    return f"""{CUM}, pc AS (SELECT {percentile(0.02)} AS p02, {percentile(0.98)} AS p98), sh AS (SELECT {lo} AS a, {hi} AS b FROM pc),
rng AS (SELECT floor(a / {nice('((b - a) / 8)')}) * {nice('((b - a) / 8)')} AS lo, ceil(b / {nice('((b - a) / 8)')}) * {nice('((b - a) / 8)')} AS hi FROM sh)"""


BANDS = f"""st AS (SELECT lo, hi, {nice('((hi - lo) / 8)')} AS step FROM rng), nb AS (SELECT *, greatest(1, ceil((hi - lo) / step - 1e-9))::INT AS n FROM st),
bands AS (SELECT i::INT AS band, lo + i * step AS low, CASE WHEN i = n - 1 THEN hi ELSE lo + i * step + step END AS high FROM nb, unnest(range(0, n)) t(i))"""
POINTS = "pt AS (SELECT c_custkey AS pid, ((c_custkey * 37) % 4999) / 100 AS x, ((c_custkey * 53) % 2903) / 100 AS y, c_acctbal / 1000 AS z FROM customer)"
RINGS = """ring AS (SELECT * FROM (VALUES (1,0,0,5.0::DOUBLE,5.0::DOUBLE),(1,0,1,15,2),(1,0,2,25,6),(1,0,3,24,18),(1,0,4,14,22),(1,0,5,4,16),(1,1,0,10,8),(1,1,1,18,8),(1,1,2,18,14),(1,1,3,10,14),
  (2,0,0,28,3),(2,0,1,45,3),(2,0,2,45,25),(2,0,3,37,9),(2,0,4,28,24),(3,0,0,20,15),(3,0,1,35,27),(3,0,2,12,28)) t(area_id, ring_id, seq, x, y)),
re AS (SELECT a.area_id, a.ring_id, a.seq, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM ring a JOIN ring b ON a.area_id = b.area_id AND a.ring_id = b.ring_id
  AND b.seq = (a.seq + 1) % (SELECT count(*) FROM ring c WHERE c.area_id = a.area_id AND c.ring_id = a.ring_id))"""
ROUTE = V + """, rt AS (SELECT x::INT AS route_id, y::INT AS seq, x, y, z FROM v), line AS (SELECT *, y - min(y) OVER (PARTITION BY route_id) AS station FROM rt),
leg AS (SELECT * FROM (SELECT route_id, seq, station AS s0, lead(station) OVER w AS s1, x AS x0, y AS y0, z AS z0, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(z) OVER w AS z1 FROM line WINDOW w AS (PARTITION BY route_id ORDER BY seq)) WHERE s1 IS NOT NULL)"""
GRID = """cl AS (SELECT floor((l_partkey % 50) + l_discount * 9 + 0.5)::BIGINT AS col, floor((l_suppkey % 40) + l_tax * 11 + 0.5)::BIGINT AS row, l_quantity AS z, l_linenumber AS cls, l_orderkey AS colour FROM lineitem),
grid AS (SELECT col, row, max(z) AS v FROM cl GROUP BY col, row)"""


def windowed(grid: str, radius: int, pick: str, name: str = "v") -> str:
    return f"(SELECT a.col, a.row, {pick}(b.{name}) AS {name} FROM {grid} a JOIN {grid} b ON b.col BETWEEN a.col - {radius} AND a.col + {radius} AND b.row BETWEEN a.row - {radius} AND a.row + {radius} GROUP BY a.col, a.row)"


DIFF = XYZ + ", " + REF + """, d AS (SELECT m.*, az - p.z AS da, bz - q.z AS db, cz - s.z AS dc FROM m JOIN ref p ON p.vid = a JOIN ref q ON q.vid = b JOIN ref s ON s.vid = c),
tip AS (SELECT *, plan_area * (da + db + dc) / 3 AS total, (da >= 0 AND db >= 0 AND dc >= 0) OR (da <= 0 AND db <= 0 AND dc <= 0) AS one,
  CASE WHEN (da > 0 AND db <= 0 AND dc <= 0) OR (da < 0 AND db >= 0 AND dc >= 0) THEN [da, db, dc] WHEN (db > 0 AND da <= 0 AND dc <= 0) OR (db < 0 AND da >= 0 AND dc >= 0) THEN [db, da, dc] ELSE [dc, da, db] END AS l FROM d),
lin AS (SELECT *, CASE WHEN one THEN 0 ELSE plan_area * l[1] * l[1] * l[1] / (3 * (l[1] - l[2]) * (l[1] - l[3])) END AS t FROM tip),
vol AS (SELECT *, CASE WHEN one THEN greatest(total, 0) ELSE greatest(t, 0) + greatest(total - t, 0) END AS fill, CASE WHEN one THEN greatest(-total, 0) ELSE greatest(-t, 0) + greatest(t - total, 0) END AS cut FROM lin)"""
TOTALS = f"count(*) AS n_faces, {r('sum(plan_area)', 'plan_area')}, {r('sum(cut)', 'cut')}, {r('sum(fill)', 'fill')}, {r('sum(cut) - sum(fill)', 'net')}"
IN_ZONE = "mx >= z.x0 AND mx < z.x1 AND my >= z.y0 AND my < z.y1"


def contours(source: str, levels: str, fa: str, fb: str, fc: str) -> str:
    def hit(p: str, q: str, fp: str, fq: str) -> str:
        t = f"((level - {fp}) / ({fq} - {fp}))"
        return f"CASE WHEN ({fp} < level) != ({fq} < level) THEN [{p}x + ({q}x - {p}x) * {t}, {p}y + ({q}y - {p}y) * {t}] END"

    return f"""seg AS (SELECT fid, level, list_filter([{hit('a', 'b', fa, fb)}, {hit('b', 'c', fb, fc)}, {hit('c', 'a', fc, fa)}], lambda p: p IS NOT NULL) AS p
  FROM {source}, {levels} WHERE level > least({fa}, {fb}, {fc}) AND level <= greatest({fa}, {fb}, {fc})),
con AS (SELECT fid, level, p[1][1] AS x0, p[1][2] AS y0, p[2][1] AS x1, p[2][2] AS y1 FROM seg WHERE len(p) = 2)"""


LEVELS = "(SELECT i * 0.5::DOUBLE AS level FROM range(1, 10) t(i))"
NEIGH = "use AS (SELECT *, row_number() OVER (PARTITION BY u, w ORDER BY fid, k) AS i, lag(fid) OVER (PARTITION BY u, w ORDER BY fid, k) AS before, lead(fid) OVER (PARTITION BY u, w ORDER BY fid, k) AS after FROM h), nb AS (SELECT fid, " + ", ".join(f"coalesce(max(CASE WHEN k = {k} THEN CASE i WHEN 1 THEN after WHEN 2 THEN before END END), -1) AS n{k}" for k in range(3)) + " FROM use GROUP BY fid)"


def _reach(p: str, q: str) -> str:
    den = f"(dx * ({q}y - {p}y) - dy * ({q}x - {p}x))"
    t = f"((({p}x - mx) * ({q}y - {p}y) - ({p}y - my) * ({q}x - {p}x)) / {den})"
    return f"CASE WHEN {den} != 0 AND {t} > 0 THEN {t} END"


FLOW = f"""{XYZ}, {HALF}, {NEIGH}, dd AS (SELECT *, nx / nz AS dx, ny / nz AS dy FROM m WHERE nz != 0), tt AS (SELECT fid, slope, {_reach('a', 'b')} AS t0, {_reach('b', 'c')} AS t1, {_reach('c', 'a')} AS t2 FROM dd),
flow AS (SELECT fid, coalesce(CASE WHEN slope <= 0.005 THEN NULL WHEN t0 = least(t0, t1, t2) THEN n0 WHEN t1 = least(t0, t1, t2) THEN n1 WHEN t2 = least(t0, t1, t2) THEN n2 END, -2) AS flows_to FROM tt JOIN nb USING (fid))"""
ROOTS = """, path AS (SELECT fid, fid AS pos, flows_to AS nxt, 0 AS k FROM flow UNION ALL SELECT p.fid, f.fid, f.flows_to, k + 1 FROM path p JOIN flow f ON f.fid = p.nxt WHERE k < 400),
ended AS (SELECT fid, pos AS root FROM path WHERE nxt < 0),
lost AS (SELECT fid, pos, k FROM path WHERE fid NOT IN (SELECT fid FROM ended)),
roots AS (SELECT * FROM ended UNION ALL SELECT fid, min(pos) FROM lost WHERE k > 200 GROUP BY fid)"""
EVENTS = """ln AS (SELECT event_id + 1 AS line_number, CASE WHEN event_id % 53 = 7 THEN '# remark' WHEN event_id % 59 = 9 THEN '1,2' ELSE
  event_id || ',' || CASE WHEN event_id % 97 = 3 THEN 'n/a' ELSE (user_id % 90)::VARCHAR END || ',' || (event_id % 71) || ',' || (user_id % 13) || ',' || upper(event_type) || (user_id % 4) ||
  CASE event_id % 11 WHEN 0 THEN ' ST' WHEN 5 THEN ' CLOSE' WHEN 8 THEN ' END' ELSE '' END END AS line FROM events),
sp AS (SELECT line_number, string_split(line, ',') AS f FROM ln WHERE line NOT LIKE '#%'),
pp AS (SELECT *, CASE WHEN len(f) < 4 THEN 'too few columns' WHEN try_cast(f[2] AS DOUBLE) IS NULL THEN 'bad number' END AS problem FROM sp),
tok AS (SELECT line_number, try_cast(f[3] AS DOUBLE) AS x, string_split(upper(f[5]), ' ') AS t FROM pp WHERE problem IS NULL),
code AS (SELECT line_number, regexp_replace(t[1], '[0-9]+$', '') AS code, regexp_extract(t[1], '([0-9]+)$', 1)::INT AS figure, coalesce(t[2] = 'ST', false) AS starts, coalesce(t[2] = 'END', false) AS ends, coalesce(t[2] = 'CLOSE', false) AS closes FROM tok)"""
CURV = V + """, dv AS (SELECT c.vid, (e.z - w.z) / 2 AS p, (n.z - s.z) / 2 AS q, e.z - 2 * c.z + w.z AS r, n.z - 2 * c.z + s.z AS t, (ne.z - se.z - nw.z + sw.z) / 4 AS s
  FROM v c JOIN v e ON e.vid = c.vid + 1 JOIN v w ON w.vid = c.vid - 1 JOIN v n ON n.vid = c.vid + 50 JOIN v s ON s.vid = c.vid - 50
  JOIN v ne ON ne.vid = c.vid + 51 JOIN v nw ON nw.vid = c.vid + 49 JOIN v se ON se.vid = c.vid - 49 JOIN v sw ON sw.vid = c.vid - 51 WHERE c.x BETWEEN 1 AND 48),
cv AS (SELECT vid, -((1 + q * q) * r - 2 * p * q * s + (1 + p * p) * t) / (2 * (1 + p * p + q * q) * sqrt(1 + p * p + q * q)) AS mean, (r * t - s * s) / ((1 + p * p + q * q) * (1 + p * p + q * q)) AS gaussian,
  -(p * p * r + 2 * p * q * s + q * q * t) / ((p * p + q * q) * (1 + p * p + q * q) * sqrt(1 + p * p + q * q)) AS pr, p * p + q * q AS g2 FROM dv),
cu AS (SELECT vid, mean, gaussian, mean + sqrt(greatest(0, mean * mean - gaussian)) AS k1, mean - sqrt(greatest(0, mean * mean - gaussian)) AS k2, CASE WHEN g2 < 1e-12 THEN mean ELSE pr END AS profile, 2 * mean - CASE WHEN g2 < 1e-12 THEN mean ELSE pr END AS plan FROM cv)"""


def _goings(strict: bool) -> str:
    def mid(n0, g0, n1, g1):
        return str(min(g0, g1)) + "::DOUBLE" if strict else f"{g0} + (1 / slope - {n0}) / {n1 - n0} * {g1 - g0}"

    return f"CASE WHEN 1 / slope <= 1 THEN 2::DOUBLE WHEN 1 / slope <= 2 THEN {mid(1, 2, 2, 5)} WHEN 1 / slope <= 4 THEN {mid(2, 5, 4, 10)} ELSE 10 END"


SEGDIST = "sqrt(pow(px - (x0 + (x1 - x0) * t), 2) + pow(py - (y0 + (y1 - y0) * t), 2))"
SEGT = "least(greatest(CASE WHEN pow(x1 - x0, 2) + pow(y1 - y0, 2) > 0 THEN ((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0)) / (pow(x1 - x0, 2) + pow(y1 - y0, 2)) ELSE 0 END, 0), 1)"


def orient(a: str, b: str, p: str) -> str:
    return f"(({b}x - {a}x) * ({p}y - {a}y) - ({b}y - {a}y) * ({p}x - {a}x))"


SQL: dict[str, str] = {
    "lattice_vertices": f"WITH {V} SELECT vid, {rs('x', 'y', 'z')} FROM v",
    "lattice_faces": f"WITH {FACES} SELECT * FROM f",
    "face_measures": f"WITH {XYZ} SELECT fid, {rs('plan_area', 'surface_area', 'slope')}, {r('mx', 'x')}, {r('my', 'y')}, {r('mz', 'z')} FROM m",
    "slope_units": f"WITH {XYZ} SELECT fid, {r('slope', 'ratio')}, {r('slope * 100', 'percent')}, {r('slope * 1000', 'promille')}, {r('degrees(atan(slope))', 'degrees')}, {r('tan(atan(slope))', 'back')} FROM m",
    "slope_summary": f"WITH {XYZ}, s AS (SELECT degrees(atan(slope)) AS s, surface_area AS w FROM m WHERE slope < 'inf'::DOUBLE) SELECT count(*) AS n_faces, {r('min(s)', 'min_slope')}, {r('max(s)', 'max_slope')}, {r('sum(s * w) / sum(w)', 'mean_slope')} FROM s",
    "slope_by_zone": f"""WITH {XYZ}, {ZONES} SELECT zone_id, count(*) AS n_faces, {r('sum(plan_area)', 'plan_area')}, {r('sum(surface_area)', 'surface_area')}, {r('min(least(az, bz, cz))', 'min_z')}, {r('sum(mz * plan_area) / sum(plan_area)', 'mean_z')},
  {r('max(greatest(az, bz, cz))', 'max_z')}, {r('min(slope * 100)', 'min_slope')}, {r('sum(slope * 100 * plan_area) / sum(plan_area)', 'mean_slope')}, {r('max(slope * 100)', 'max_slope')} FROM m JOIN z ON {IN_ZONE} GROUP BY zone_id""",
    "face_aspect": f"WITH {XYZ}, {BEARING} SELECT fid, {r('bearing')} FROM bearing",
    "aspect_summary": f"""WITH {XYZ}, {BEARING}, s AS (SELECT count(*) AS n_faces, count(*) FILTER (bearing IS NULL) AS n_flat, coalesce(sum(plan_area) FILTER (bearing IS NULL), 0) AS flat_area, sum(sin(radians(bearing)) * plan_area) AS e, sum(cos(radians(bearing)) * plan_area) AS n FROM bearing)
  SELECT n_faces, n_flat, {r('flat_area')}, {r('(degrees(atan2(e, n)) + 360) % 360', 'mean_bearing')} FROM s""",
    "aspect_sectors": f"""WITH {XYZ}, {BEARING} SELECT coalesce(['N','NE','E','SE','S','SW','W','NW'][(round_even(bearing / 45, 0)::INT % 8) + 1], 'flat') AS sector, count(*) AS n_faces, {r('sum(plan_area)', 'plan_area')} FROM bearing GROUP BY 1""",
    "invalid_faces": f"""WITH {FACES}, odd AS (SELECT * FROM f UNION ALL SELECT -fid - 1, a, a, CASE WHEN fid % 2 = 0 THEN c ELSE -5 END FROM f WHERE fid % 97 = 0)
  SELECT fid, 'repeated' AS reason FROM odd WHERE a = b OR b = c OR a = c UNION ALL SELECT DISTINCT fid, 'unknown' FROM (SELECT fid, unnest([a, b, c]) AS vid FROM odd) WHERE vid NOT IN (SELECT vid FROM v)""",
    "face_adjacency": f"WITH {FACES}, {HALF}, {NEIGH} SELECT * FROM nb",
    "edge_topology": f"WITH {FACES}, {HALF} SELECT * FROM edges",
    "naked_edges": f"WITH {FACES}, {HALF} SELECT u, v FROM edges WHERE n_faces = 1",
    "vertex_degree": f"""WITH {FACES}, {HALF}, ends AS (SELECT u AS vid, n_faces FROM edges UNION ALL SELECT v, n_faces FROM edges), corner AS (SELECT vid, count(*) AS n_faces FROM (SELECT unnest([a, b, c]) AS vid FROM f) GROUP BY vid)
  SELECT vid, count(*) AS n_neighbours, any_value(c.n_faces) AS n_faces, bool_or(e.n_faces = 1) AS on_border FROM ends e JOIN corner c USING (vid) GROUP BY vid""",
    "topology_checks": f"WITH {FACES}, {HALF}, d AS (SELECT u, w, count(*) AS n, count(*) FILTER (a = u) AS up FROM h GROUP BY u, w) SELECT count(*) AS n_edges, count(*) FILTER (n = 1) AS n_naked, count(*) FILTER (n > 2) AS n_crowded, bool_and(up <= 1 AND n - up <= 1) AS winds_alike FROM d",
    "boundary_vertices": f"WITH {FACES}, {HALF} SELECT vid, count(*) AS degree FROM (SELECT unnest([u, v]) AS vid FROM edges WHERE n_faces = 1) GROUP BY vid",
    "crease_edges": f"""WITH {XYZ}, {HALF}, un AS (SELECT fid, nx / l AS nx, ny / l AS ny, nz / l AS nz FROM (SELECT fid, nx, ny, nz, sqrt(nx * nx + ny * ny + nz * nz) AS l FROM n) WHERE l > 0),
  pr AS (SELECT p.u, p.w AS v, a.nx * b.nx + a.ny * b.ny + a.nz * b.nz AS cosine FROM h p JOIN h q ON p.u = q.u AND p.w = q.w AND p.fid < q.fid JOIN un a ON a.fid = p.fid JOIN un b ON b.fid = q.fid JOIN (SELECT u, w FROM h GROUP BY u, w HAVING count(*) = 2) two ON two.u = p.u AND two.w = p.w) SELECT u, v, {r('cosine')} FROM pr WHERE cosine <= 0.2""",
    "mesh_regularity": f"""WITH {XYZ}, k AS (SELECT *, row_number() OVER (ORDER BY fid) - 1 AS rk, count(*) OVER () AS nn FROM m), pick AS (SELECT k.* FROM k WHERE nn <= 2048 OR rk IN (SELECT floor(i * (SELECT count(*) FROM m) / 2048)::BIGINT FROM range(0, 2048) t(i))),
  l AS (SELECT sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by) + (az - bz) * (az - bz)) AS l0, sqrt((bx - cx) * (bx - cx) + (by - cy) * (by - cy) + (bz - cz) * (bz - cz)) AS l1, sqrt((cx - ax) * (cx - ax) + (cy - ay) * (cy - ay) + (cz - az) * (cz - az)) AS l2 FROM pick),
  a AS (SELECT *, degrees(least(acos((l1 * l1 + l2 * l2 - l0 * l0) / (2 * l1 * l2)), acos((l2 * l2 + l0 * l0 - l1 * l1) / (2 * l2 * l0)), acos((l0 * l0 + l1 * l1 - l2 * l2) / (2 * l0 * l1)))) AS ang FROM l),
  ed AS (SELECT list_sort(list((l0 + l1 + l2) / 3)) AS xs FROM l) SELECT count(*) AS n_sampled, count(*) FILTER (ang < 8) AS n_skinny, {r('any_value(xs[len(xs) // 2 + 1])', 'median_edge')} FROM a, ed""",
    "mesh_compaction": f"WITH {FACES}, used AS (SELECT DISTINCT unnest([a, b, c]) AS vid FROM f WHERE fid % 6 < 2) SELECT vid, row_number() OVER (ORDER BY vid) - 1 AS nid FROM used",
    "weighted_histogram": f"WITH {XYZ}, {HIST} SELECT bin, {r('weight')} FROM hist",
    "weighted_percentile": f"WITH {XYZ}, {CUM} " + " UNION ALL ".join(f"SELECT {p}::DOUBLE AS fraction, {r(percentile(p), 'value')}" for p in (0.02, 0.5, 0.98)),
    "auto_range": f"WITH {XYZ}, {auto(True)} SELECT {rs('lo', 'hi')} FROM rng",
    "stepped_bands": f"WITH {XYZ}, {auto(False)}, {BANDS} SELECT band, {rs('low', 'high')} FROM bands",
    "band_counts": f"WITH {XYZ}, {auto(False)}, {BANDS}, lim AS (SELECT min(low) AS lo, max(band) AS last, max(high - low) FILTER (band = 0) AS step FROM bands) SELECT greatest(0, least(last, floor((v - lo) / step)))::INT AS band, count(*) AS n, {r('sum(w)', 'weight')} FROM val, lim GROUP BY 1",
    "range_ticks": f"WITH {XYZ}, {auto(False)}, tk AS (SELECT lo, hi, {nice('((hi - lo) / 5)')} AS step FROM rng) SELECT {r('i * step', 'tick')} FROM tk, unnest(range(ceil(lo / step - 1e-9)::BIGINT, least(floor(hi / step + 1e-9)::BIGINT, ceil(lo / step - 1e-9)::BIGINT + 12) + 1)) t(i)",
    "histogram_bars": f"WITH {XYZ}, {HIST}, b AS (SELECT least(23, bin * 24 // 2048)::INT AS bar, sum(weight) AS w FROM hist GROUP BY 1) SELECT bar, {r('w / max(w) OVER ()', 'height')} FROM b",
    "lattice_curvature": f"WITH {CURV} SELECT vid, {rs('mean', 'gaussian', 'k1', 'k2', 'profile', 'plan')} FROM cu",
    "landform_counts": f"WITH {CURV} SELECT CASE WHEN round(mean, 8) > 0.5 THEN 'convex' WHEN round(mean, 8) < -0.5 THEN 'concave' ELSE 'planar' END AS landform, count(*) AS n FROM cu GROUP BY 1",
    "contour_segments": f"WITH {XYZ}, {contours('m', LEVELS, 'az', 'bz', 'cz')} SELECT fid, {rs('level', 'x0', 'y0', 'x1', 'y1')} FROM con",
    "contour_length_by_level": f"WITH {XYZ}, {contours('m', LEVELS, 'az', 'bz', 'cz')} SELECT {r('level')}, count(*) AS n_segments, {r('sum(sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)))', 'length')} FROM con GROUP BY con.level",
    "linear_cut_fill": f"WITH {DIFF} SELECT {TOTALS} FROM vol",
    "prism_cut_fill": f"WITH {DIFF}, pv AS (SELECT plan_area, greatest(total, 0) AS fill, greatest(-total, 0) AS cut FROM tip) SELECT {TOTALS} FROM pv",
    "cut_fill_by_zone": f"WITH {DIFF}, {ZONES} SELECT zone_id, {TOTALS} FROM vol JOIN z ON {IN_ZONE} GROUP BY zone_id",
    "difference_contours": f"WITH {DIFF}, {contours('d', '(SELECT 0.0::DOUBLE AS level)', 'da', 'db', 'dc')} SELECT fid, {rs('level', 'x0', 'y0', 'x1', 'y1')} FROM con",
    "points_in_areas": f"WITH {POINTS}, {RINGS} SELECT pid, area_id FROM pt, re WHERE (y1 > y) != (y0 > y) AND x < (x0 - x1) * (y - y1) / (y0 - y1) + x1 GROUP BY pid, area_id HAVING count(*) % 2 = 1",
    "area_distance": f"WITH {POINTS}, {RINGS}, dd AS (SELECT *, {SEGT} AS t FROM (SELECT pid, x AS px, y AS py FROM pt), re), ds AS (SELECT pid, area_id, min({SEGDIST}) AS distance FROM dd GROUP BY pid, area_id) SELECT pid, area_id, {r('distance')} FROM ds WHERE distance <= 1.5",
    "ring_areas": f"WITH {RINGS} SELECT area_id, ring_id, {r('sum(x0 * y1 - y0 * x1) / 2', 'signed_area')} FROM re GROUP BY area_id, ring_id",
    "zone_priority": f"WITH {V}, {ZONES}, {POINTS} SELECT pid, arg_max(zone_id, priority * 1000 + zone_id) AS zone_id FROM pt JOIN z ON x >= x0 AND x < x1 + 3 AND y >= y0 AND y < y1 + 3 GROUP BY pid",
    "point_heights": f"""WITH {XYZ}, {POINTS}, hit AS (SELECT pid, x AS px, y AS py, m.* FROM pt JOIN m ON x BETWEEN least(ax, bx, cx) AND greatest(ax, bx, cx) AND y BETWEEN least(ay, by, cy) AND greatest(ay, by, cy)),
  o AS (SELECT *, {orient('a', 'b', 'p')} AS d1, {orient('b', 'c', 'p')} AS d2, {orient('c', 'a', 'p')} AS d3, {orient('a', 'b', 'c')} AS w FROM hit),
  hh AS (SELECT pid, (d2 * az + d3 * bz + (w - d2 - d3) * cz) / w AS z FROM o WHERE NOT ((d1 < 0 OR d2 < 0 OR d3 < 0) AND (d1 > 0 OR d2 > 0 OR d3 > 0))),
  ag AS (SELECT pid, min(z) AS lo, max(z) AS hi FROM hh GROUP BY pid) SELECT pid, round(lo, 11) AS low_z, round(hi, 11) AS top_z, CASE WHEN hi IS NULL THEN 'outside' WHEN hi - lo > 4e-6 THEN 'ambiguous' ELSE 'projected' END AS status FROM pt LEFT JOIN ag USING (pid)""",
    "nearest_vertices": f"WITH {V}, {POINTS}, dd AS (SELECT pid, vid, (pt.x - v.x) * (pt.x - v.x) + (pt.y - v.y) * (pt.y - v.y) AS d FROM pt JOIN v ON v.x BETWEEN pt.x - 0.6 AND pt.x + 0.6 AND v.y BETWEEN pt.y - 0.6 AND pt.y + 0.6) SELECT pid, vid, {r('sqrt(d)', 'distance')} FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY d, vid) AS k FROM dd WHERE d <= 0.36) WHERE k = 1",
    "segment_crossings": f"""WITH s AS (SELECT s_suppkey AS sid, (s_suppkey * 17 % 47)::DOUBLE AS ax, (s_suppkey * 29 % 31)::DOUBLE AS ay, (s_suppkey * 17 % 47 + s_suppkey * 7 % 11 - 5)::DOUBLE AS bx, s_suppkey * 29 % 31 + s_suppkey * 13 % 9 - 4 + 0.5::DOUBLE AS by FROM supplier),
  j AS (SELECT p.sid AS s1, q.sid AS s2, p.ax, p.ay, p.bx, p.by, q.ax AS cx, q.ay AS cy, q.bx AS dx, q.by AS dy FROM s p JOIN s q ON p.sid < q.sid),
  c AS (SELECT *, (bx - ax) * (dy - cy) - (by - ay) * (dx - cx) AS den FROM j WHERE {orient('a', 'b', 'c')} * {orient('a', 'b', 'd')} < 0 AND {orient('c', 'd', 'a')} * {orient('c', 'd', 'b')} < 0),
  t AS (SELECT *, ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / den AS t, ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / den AS u FROM c) SELECT s1, s2, {r('ax + (bx - ax) * t', 'x')}, {r('ay + (by - ay) * t', 'y')}, {rs('t', 'u')} FROM t""",
    "clipped_segments": f"""WITH s AS (SELECT s_suppkey AS sid, (s_suppkey * 17 % 47)::DOUBLE AS x0, (s_suppkey * 29 % 31)::DOUBLE AS y0, (s_suppkey * 17 % 47 + s_suppkey * 7 % 11 - 5)::DOUBLE AS x1, s_suppkey * 29 % 31 + s_suppkey * 13 % 9 - 4 + 0.5::DOUBLE AS y1 FROM supplier),
  p AS (SELECT *, CASE WHEN x1 != x0 THEN least((8 - x0) / (x1 - x0), (34 - x0) / (x1 - x0)) WHEN x0 BETWEEN 8 AND 34 THEN 0 ELSE 2 END AS ex, CASE WHEN x1 != x0 THEN greatest((8 - x0) / (x1 - x0), (34 - x0) / (x1 - x0)) WHEN x0 BETWEEN 8 AND 34 THEN 1 ELSE -1 END AS lx,
    CASE WHEN y1 != y0 THEN least((6 - y0) / (y1 - y0), (24 - y0) / (y1 - y0)) WHEN y0 BETWEEN 6 AND 24 THEN 0 ELSE 2 END AS ey, CASE WHEN y1 != y0 THEN greatest((6 - y0) / (y1 - y0), (24 - y0) / (y1 - y0)) WHEN y0 BETWEEN 6 AND 24 THEN 1 ELSE -1 END AS ly FROM s),
  q AS (SELECT *, greatest(0, ex, ey) AS t0, least(1, lx, ly) AS t1 FROM p) SELECT sid, {rs('t0', 't1')}, {r('x0 + (x1 - x0) * t0', 'cx0')}, {r('y0 + (y1 - y0) * t0', 'cy0')}, {r('x0 + (x1 - x0) * t1', 'cx1')}, {r('y0 + (y1 - y0) * t1', 'cy1')} FROM q WHERE t0 < t1""",
    "plan_stations": f"WITH {ROUTE} SELECT route_id, seq, {rs('x', 'y', 'z', 'station')} FROM line",
    "profile_lookup": f"WITH {ROUTE}, q AS (SELECT route_id, station * 1.07 - 0.5 AS station FROM line) SELECT q.route_id, {r('q.station', 'station')}, round(min(z0 + (z1 - z0) * ((q.station - s0) / (s1 - s0))), 11) AS z FROM q LEFT JOIN leg ON leg.route_id = q.route_id AND q.station >= s0 AND q.station <= s1 GROUP BY q.route_id, q.station",
    "even_stations": f"WITH {ROUTE}, l AS (SELECT route_id, max(station) AS length, greatest(1, ceil(max(station) / 1.7))::INT AS n FROM line GROUP BY route_id) SELECT route_id, {r('length * i / n', 'station')} FROM l, unnest(range(0, n + 1)) t(i)",
    "section_cut_fill": f"""WITH {ROUTE}, d AS (SELECT route_id, station AS s0, z - (2.5 + station * 0.003) AS d0, lead(z - (2.5 + station * 0.003)) OVER w AS d1, lead(station) OVER w AS s1 FROM line WINDOW w AS (PARTITION BY route_id ORDER BY station)),
  p AS (SELECT route_id, s1 - s0 AS run, d0, d1, abs(d0) AS a, abs(d1) AS b FROM d WHERE s1 - s0 > 1e-9),
  q AS (SELECT route_id, CASE WHEN d0 * d1 < -1e-18 THEN CASE WHEN d0 > 0 THEN run * a * a / (2 * (a + b)) ELSE run * b * b / (2 * (a + b)) END ELSE greatest(run * (d0 + d1) / 2, 0) END AS fill,
    CASE WHEN d0 * d1 < -1e-18 THEN CASE WHEN d0 > 0 THEN run * b * b / (2 * (a + b)) ELSE run * a * a / (2 * (a + b)) END ELSE greatest(-run * (d0 + d1) / 2, 0) END AS cut FROM p) SELECT route_id, {r('sum(cut)', 'cut')}, {r('sum(fill)', 'fill')} FROM q GROUP BY route_id""",
    "route_metrics": f"WITH {ROUTE} SELECT route_id, {r('sum(s1 - s0)', 'length')}, {r('max(abs(z1 - z0) / (s1 - s0))', 'max_grade')}, {r('sum(abs(z1 - z0)) / sum(s1 - s0)', 'mean_grade')}, {r('sum(greatest(z1 - z0, 0))', 'rise')}, {r('sum(greatest(z0 - z1, 0))', 'fall')} FROM leg GROUP BY route_id",
    "route_runs": f"""WITH {ROUTE}, s AS (SELECT route_id, station, coalesce(lag(station) OVER w, station) AS a, round(coalesce(lag(z) OVER w, z), 8) AS za, coalesce(lead(station) OVER w, station) AS b, round(coalesce(lead(z) OVER w, z), 8) AS zb FROM line WINDOW w AS (PARTITION BY route_id ORDER BY station)),
  g AS (SELECT route_id, station, coalesce(abs((zb - za) / (b - a)), 0) AS grade FROM s), f AS (SELECT *, grade <= 0.45 AS flat FROM g),
  k AS (SELECT *, CASE WHEN flat = lag(flat) OVER (PARTITION BY route_id ORDER BY station) THEN 0 ELSE 1 END AS new FROM f), n AS (SELECT *, sum(new) OVER (PARTITION BY route_id ORDER BY station)::INT AS run FROM k)
  SELECT route_id, run, CASE WHEN flat AND max(station) - min(station) >= 2 THEN 'landing' WHEN flat THEN 'level' ELSE 'slope' END AS kind, {r('min(station)', 's0')}, {r('max(station)', 's1')}, {r('max(grade)', 'steepest')}, count(*) AS n FROM n GROUP BY route_id, run, flat""",
    "grade_limited_profile": f"""WITH {ROUTE}, u AS (SELECT a.route_id, a.station, max(b.z - 1.5 * abs(a.station - b.station)) AS upper, min(b.z + 1.5 * abs(a.station - b.station)) AS lower FROM line a JOIN line b ON a.route_id = b.route_id GROUP BY a.route_id, a.station),
  e AS (SELECT route_id, min_by(z, station) AS z0, max_by(z, station) AS z1, max(station) AS len FROM line GROUP BY route_id),
  w AS (SELECT *, greatest(z0 - 1.5 * station, z1 - 1.5 * (len - station)) AS lo, least(z0 + 1.5 * station, z1 + 1.5 * (len - station)) AS hi, abs(z1 - z0) / len AS required FROM u JOIN e USING (route_id))
  SELECT route_id, {rs('station', 'upper', 'lower', 'required')}, required <= 1.5 * (1 + 1e-9) + 1e-12 AS feasible,
    CASE WHEN required <= 1.5 * (1 + 1e-9) + 1e-12 THEN round(CASE WHEN station = 0 THEN z0 WHEN station = len THEN z1 WHEN hi < lo THEN (lo + hi) / 2 ELSE least(greatest((upper + lower) / 2, lo), hi) END, 8) + 0.0 END AS grade_z FROM w""",
    "route_compliance": f"""WITH {XYZ}, rt AS (SELECT x::INT AS route_id, y::INT AS seq, x, y FROM v), lg AS (SELECT a.route_id, a.seq, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM rt a JOIN rt b ON a.route_id = b.route_id AND b.seq = a.seq + 1),
  dd AS (SELECT *, {SEGT} AS t FROM (SELECT fid, mx AS px, my AS py, nx, ny, nz, plan_area FROM m) JOIN lg ON abs(px - x0) <= 1.25 AND y0 <= py + 2.25 AND y1 >= py - 2.25), ds AS (SELECT *, {SEGDIST} AS d FROM dd),
  b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY d, route_id, seq) AS k FROM ds WHERE d <= 1.25) WHERE k = 1)
  SELECT CASE WHEN abs(ny / nz) > 1 + 1e-9 THEN 'running' WHEN abs(nx / nz) > 1.5 + 1e-9 THEN 'cross' WHEN abs(ny / nz) > 0.4 + 1e-9 THEN 'ramp' ELSE 'walk' END AS verdict, count(*) AS n_faces, {r('sum(plan_area)', 'plan_area')} FROM b GROUP BY 1""",
    "allowed_going": f"WITH {XYZ} SELECT fid, {r(_goings(False), 'linear')}, {r(_goings(True), 'strict')} FROM m WHERE slope > 0",
    "route_cost": f"WITH {XYZ}, q AS (SELECT fid, slope / 0.8 AS q, greatest(0, slope / 0.8 - 1) AS o FROM m) SELECT fid, {r('1 + least(q, 1) * least(q, 1) + 2 * o + 4 * o * o', 'cost')} FROM q",
    "cloud_raster": f"WITH {GRID}, k AS (SELECT *, row_number() OVER (PARTITION BY col, row ORDER BY z DESC, cls, colour) AS i FROM cl) SELECT col, row, count(*) AS n, {r('max(z)', 'top')}, max(cls) FILTER (i = 1) AS top_cls, max(colour) FILTER (i = 1) AS top_colour, {r('min(z)', 'low')}, round(min(z) FILTER (cls = 2), 8) + 0.0 AS ground FROM k GROUP BY col, row",
    "raster_erode": f"WITH {GRID} SELECT col, row, {r('v')} FROM {windowed('grid', 1, 'min')}",
    "raster_dilate": f"WITH {GRID} SELECT col, row, {r('v')} FROM {windowed('grid', 2, 'max')}",
    "raster_open": f"WITH {GRID}, er AS {windowed('grid', 1, 'min')} SELECT col, row, {r('v')} FROM {windowed('er', 1, 'max')}",
    "progressive_ground": f"""WITH {GRID}, e1 AS {windowed('grid', 1, 'min')}, o1 AS {windowed('e1', 1, 'max')}, e2 AS {windowed('o1', 2, 'min')}, o2 AS {windowed('e2', 2, 'max')}, e3 AS {windowed('o2', 4, 'min')}, o3 AS {windowed('e3', 4, 'max')}
  SELECT g.col, g.row, {r('g.v', 'v')}, g.v - o1.v <= 2.6 AND o1.v - o2.v <= 2.6 AND o2.v - o3.v <= 4.2 AS is_ground FROM grid g JOIN o1 USING (col, row) JOIN o2 USING (col, row) JOIN o3 USING (col, row)""",
    "rough_ground": f"WITH {GRID}, lo AS {windowed('grid', 1, 'min')}, hi AS {windowed('grid', 1, 'max')} SELECT col, row, {r('hi.v - lo.v', 'range')}, hi.v - lo.v > 12 AS is_rough FROM lo JOIN hi USING (col, row)",
    "coarse_grid": f"WITH {GRID} SELECT col // 4 AS col, row // 4 AS row, {r('avg(v)', 'v')}, count(*) AS n FROM grid GROUP BY grid.col // 4, grid.row // 4",
    "grid_sample": f"""WITH {GRID}, {POINTS}, sp AS (SELECT * FROM grid WHERE (col * 7 + row * 3) % 5 != 0), p AS (SELECT pid, floor(x)::BIGINT AS c, floor(y)::BIGINT AS r, x - floor(x) AS fu, y - floor(y) AS fw FROM pt),
  q AS (SELECT pid, c + i AS col, r + j AS row, (CASE WHEN i = 1 THEN fu ELSE 1 - fu END) * (CASE WHEN j = 1 THEN fw ELSE 1 - fw END) AS k FROM p, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) t(i, j))
  SELECT pid, round(sum(k * v) / sum(k) FILTER (v IS NOT NULL), 8) + 0.0 AS v FROM q LEFT JOIN sp USING (col, row) WHERE k > 0 GROUP BY pid""",
    "mask_components": f"""WITH RECURSIVE {GRID}, mask AS (SELECT col, row, row * 100000 + col AS id FROM grid WHERE v < 47 OR (col + row) % 3 = 0), lk AS (SELECT a.id AS a, b.id AS b FROM mask a JOIN mask b ON abs(a.col - b.col) + abs(a.row - b.row) = 1),
  reach AS (SELECT id AS a, id AS b FROM mask UNION SELECT r.a, l.b FROM reach r JOIN lk l ON r.b = l.a) SELECT m.col, m.row, (min(b) // 100000) || ':' || (min(b) % 100000) AS label FROM reach JOIN mask m ON m.id = a GROUP BY m.col, m.row""",
    "basin_flow": f"WITH {FLOW} SELECT fid, flows_to FROM flow",
    "basin_roots": f"WITH RECURSIVE {FLOW}{ROOTS} SELECT fid, root FROM roots",
    "basin_areas": f"WITH RECURSIVE {FLOW}{ROOTS} SELECT root, count(*) AS n_faces, {r('sum(plan_area)', 'plan_area')}, {r('min(least(az, bz, cz))', 'low_z')} FROM roots JOIN m USING (fid) GROUP BY root",
    "point_clusters": f"""WITH RECURSIVE {POINTS}, lk AS (SELECT a.pid AS a, b.pid AS b FROM pt a JOIN pt b ON a.pid != b.pid AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 0.9 * 0.9),
  reach AS (SELECT pid AS a, pid AS b FROM pt UNION SELECT r.a, l.b FROM reach r JOIN lk l ON r.b = l.a), c AS (SELECT a AS pid, min(b) AS cluster FROM reach GROUP BY a), mn AS (SELECT cluster, avg(x) AS x, avg(y) AS y, avg(z) AS z, count(*) AS n FROM c JOIN pt USING (pid) GROUP BY cluster)
  SELECT pid, cluster, {rs('x', 'y', 'z')}, n FROM c JOIN mn USING (cluster)""",
    "laplacian_smooth": f"""WITH {FACES}, {HALF}, nb AS (SELECT u AS vid, v AS nid FROM edges UNION ALL SELECT v, u FROM edges), held AS (SELECT DISTINCT unnest([u, v]) AS vid FROM edges WHERE n_faces = 1),
  r1 AS (SELECT nb.vid, avg(z) AS m, min(z) AS lo, max(z) AS hi FROM nb JOIN v ON v.vid = nb.nid GROUP BY nb.vid), z1 AS (SELECT v.vid, CASE WHEN h2.vid IS NOT NULL OR m IS NULL THEN z ELSE least(greatest(z + 0.5 * (m - z), lo), hi) END AS z FROM v LEFT JOIN r1 USING (vid) LEFT JOIN held h2 USING (vid)),
  r2 AS (SELECT nb.vid, avg(z) AS m, min(z) AS lo, max(z) AS hi FROM nb JOIN z1 ON z1.vid = nb.nid GROUP BY nb.vid) SELECT z1.vid, round(CASE WHEN h2.vid IS NOT NULL OR m IS NULL THEN z ELSE least(greatest(z + 0.5 * (m - z), lo), hi) END, 12) + 0.0 AS z FROM z1 LEFT JOIN r2 USING (vid) LEFT JOIN held h2 USING (vid)""",
    "survey_points": f"""WITH {EVENTS}, ok AS (SELECT *, problem IS NULL AS good FROM pp) SELECT line_number, CASE WHEN good THEN f[1]::INT END AS number, round(CASE WHEN good THEN f[3]::DOUBLE * 0.5 END, 8) + 0.0 AS x, round(CASE WHEN good THEN f[2]::DOUBLE * 0.5 END, 8) + 0.0 AS y,
  round(CASE WHEN good THEN f[4]::DOUBLE * 0.5 + 10 END, 8) + 0.0 AS z, CASE WHEN good THEN f[5] END AS raw, problem FROM ok""",
    "delimiter_scores": f"""WITH {EVENTS}, fst AS (SELECT line FROM ln WHERE line NOT LIKE '#%' ORDER BY line_number LIMIT 50) SELECT ',' AS delimiter, 0 AS place, count(*) FILTER (len(string_split(line, ',')) >= 4) AS score FROM fst
  UNION ALL SELECT chr(9), 1, 0 UNION ALL SELECT ';', 2, 0 UNION ALL SELECT ' ', 3, 0""",
    "code_parse": f"WITH {EVENTS} SELECT * FROM code",
    "unmatched_codes": f"WITH {EVENTS} SELECT code, count(*) AS n FROM code WHERE code NOT IN ('CLICK', 'VIEW') GROUP BY code",
    "figure_runs": f"""WITH {EVENTS}, s AS (SELECT *, sum(CASE WHEN starts OR prev THEN 1 ELSE 0 END) OVER (PARTITION BY code, figure ORDER BY line_number) AS run FROM (SELECT *, coalesce(lag(ends OR closes) OVER (PARTITION BY code, figure ORDER BY line_number), false) AS prev FROM code))
  SELECT code, figure, CASE WHEN count(*) = 1 THEN 'spot' ELSE 'figure' END AS kind, bool_or(closes) AS closed, count(*) AS n, min(line_number) AS first_line FROM s GROUP BY code, figure, run""",
    "report_zones": f"""WITH {XYZ}, {ZONES}, q AS (SELECT zone_id, plan_area, slope FROM m JOIN z ON {IN_ZONE}) SELECT coalesce(zone_id, -1) AS zone_id, count(*) AS n_faces, format('{{:.2f}}', sum(plan_area)) AS plan_area, format('{{:.1f}}%', max(slope) * 100) AS max_slope FROM q GROUP BY ROLLUP (zone_id)""",
    "face_owner_groups": f"WITH {FACES} SELECT fid % 17 AS owner, count(*) AS n, min(fid) AS first_fid FROM f GROUP BY 1",
}

SEG = "s AS (SELECT s_suppkey AS sid, (s_suppkey * 17 % 47)::DOUBLE AS ax, (s_suppkey * 29 % 31)::DOUBLE AS ay, (s_suppkey * 17 % 47 + s_suppkey * 7 % 11 - 5)::DOUBLE AS bx, s_suppkey * 29 % 31 + s_suppkey * 13 % 9 - 4 + 0.5::DOUBLE AS by FROM supplier)"
CROSS = SEG + f""", j AS (SELECT p.sid AS s1, q.sid AS s2, p.ax, p.ay, p.bx, p.by, q.ax AS cx, q.ay AS cy, q.bx AS dx, q.by AS dy FROM s p JOIN s q ON p.sid < q.sid),
c AS (SELECT *, (bx - ax) * (dy - cy) - (by - ay) * (dx - cx) AS den FROM j WHERE {orient('a', 'b', 'c')} * {orient('a', 'b', 'd')} < 0 AND {orient('c', 'd', 'a')} * {orient('c', 'd', 'b')} < 0),
x AS (SELECT *, ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / den AS t, ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / den AS u FROM c)"""
PDIST = f"""rd AS (SELECT pid, area_id, min({SEGDIST}) AS distance FROM (SELECT *, {SEGT} AS t FROM (SELECT pid, x AS px, y AS py FROM pt), re) GROUP BY pid, area_id)"""
PIN = "pin AS (SELECT pid, area_id FROM pt, re WHERE (y1 > y) != (y0 > y) AND x < (x0 - x1) * (y - y1) / (y0 - y1) + x1 GROUP BY pid, area_id HAVING count(*) % 2 = 1)"
SMOOTH = "least(greatest({u}, 0), 1) * least(greatest({u}, 0), 1) * (3 - 2 * least(greatest({u}, 0), 1))"
TEXTS = """tx AS (SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN '1:' || (o_orderkey % 9) WHEN 1 THEN (o_orderkey % 300) || '%' WHEN 2 THEN (o_orderkey % 95) || '°' WHEN 3 THEN (o_orderkey % 11)::VARCHAR WHEN 4 THEN ' ' || (o_orderkey % 13) || ' : 2 ' WHEN 5 THEN 'steep' ELSE (o_orderkey % 50) || '‰' END AS t FROM orders),
ps AS (SELECT id, try_cast(regexp_extract(t, '^ *([0-9]+) *: *([0-9]+) *$', 1) AS DOUBLE) AS a, try_cast(regexp_extract(t, '^ *([0-9]+) *: *([0-9]+) *$', 2) AS DOUBLE) AS b, try_cast(regexp_extract(t, '^([0-9]+)(%|‰|°)?$', 1) AS DOUBLE) AS v, regexp_extract(t, '^([0-9]+)(%|‰|°)?$', 2) AS u FROM tx),
rr AS (SELECT id, CASE WHEN a IS NOT NULL THEN CASE WHEN b != 0 THEN a / b END WHEN u = '%' THEN v / 100 WHEN u = '‰' THEN v / 1000 WHEN u = '°' AND v <= 89.9 THEN tan(radians(v)) END AS known, v, u, a FROM ps),
q AS (SELECT id, CASE WHEN a IS NOT NULL OR u != '' THEN known WHEN v = 0 THEN 0 ELSE 1 / v END AS ratio, CASE WHEN a IS NOT NULL OR u != '' THEN known ELSE v / 100 END AS percent FROM rr)"""


def _ok(x: str) -> str:
    return f"round(CASE WHEN degrees(atan(abs({x}))) <= 89.9 THEN {x} END, 8) + 0.0 AS {x}"


def _channel(a: int, b: int, c: int) -> str:
    return f"round_even(CASE WHEN t <= 0.5 THEN {a} + t / 0.5 * {b - a} ELSE {b} + (t - 0.5) / 0.5 * {c - b} END, 0)::INT"


def _jacobi(k: int) -> str:
    return f"z{k} AS (SELECT a.col, a.row, CASE WHEN a.known OR r.m IS NULL THEN a.v ELSE r.m END AS v, a.known FROM z{k - 1} a LEFT JOIN (SELECT p.col, p.row, avg(q.v) AS m FROM z{k - 1} p JOIN z{k - 1} q ON abs(p.col - q.col) + abs(p.row - q.row) = 1 GROUP BY p.col, p.row) r ON r.col = a.col AND r.row = a.row)"


SQL |= {
    "slope_texts": f"WITH {TEXTS} SELECT id, {_ok('ratio')}, {_ok('percent')} FROM q",
    "slope_labels": f"WITH {XYZ}, s AS (SELECT fid, round(slope, 4) AS s FROM m) SELECT fid, CASE WHEN s = 0 THEN '0' ELSE '1:' || format('{{:.2f}}', 1 / s) END AS ratio, format('{{:.2f}}', s * 100) || '%' AS percent, format('{{:.2f}}', degrees(atan(s))) || '°' AS degrees FROM s",
    "report_csv": "SELECT s_suppkey AS n, chr(34) || s_name || ', ' || chr(34) || chr(34) || 'x' || chr(34) || chr(34) || chr(34) || ',' || format('{:.2f}', round(s_acctbal / 3, 2) + 0.0) AS line FROM supplier UNION ALL SELECT -1, 'name,balance'",
    "colour_ramp": f"WITH {XYZ}, c AS (SELECT fid, least(greatest(round(slope, 6) / 3, 0), 1) AS t FROM m) SELECT fid, {_channel(0, 240, 200)} AS r, {_channel(80, 240, 0)} AS g, {_channel(255, 90, 30)} AS b FROM c",
    "category_colours": "SELECT n_nationkey, CASE WHEN n_nationkey < 2 THEN '#9e9e9e' ELSE ['#aa0000', '#00aa00', '#0000aa'][(n_nationkey - 2) % 3 + 1] END AS colour FROM nation",
    "landxml_round_trip": f"WITH {FACES} SELECT * FROM (SELECT count(*) AS n_points, {r('sum(x)', 'sx')}, {r('sum(y)', 'sy')}, {r('round(max(z), 6)', 'max_z')} FROM v), (SELECT count(*) AS n_faces, sum(a + b * 2 + c * 3)::BIGINT AS checksum FROM f)",
    "raster_georeference": f"WITH {GRID} SELECT col, row, {r('100 + 0.5::DOUBLE * (col + 0.5) + 0.1::DOUBLE * (row + 0.5)', 'x')}, {r('900 - 0.05::DOUBLE * (col + 0.5) - 0.5::DOUBLE * (row + 0.5)', 'y')} FROM grid",
    "write_plan": """WITH w AS (SELECT s_suppkey AS key, sha256(s_name) AS fp FROM supplier WHERE s_suppkey % 5 != 1), e AS (SELECT s_suppkey AS key, CASE WHEN s_suppkey % 4 = 0 THEN 'old' ELSE sha256(s_name) END AS old FROM supplier WHERE s_suppkey % 3 != 2)
  SELECT coalesce(w.key, e.key) AS key, CASE WHEN e.key IS NULL THEN 'create' WHEN w.key IS NULL THEN 'delete' WHEN fp = old THEN 'keep' ELSE 'replace' END AS action FROM w FULL JOIN e ON w.key = e.key""",
    "protected_influence": f"WITH {POINTS}, {RINGS}, {PIN}, {PDIST}, d AS (SELECT pid, min(distance) AS d FROM rd WHERE distance <= 1.5 GROUP BY pid) SELECT pid, {r('CASE WHEN pid IN (SELECT pid FROM pin) THEN 0 WHEN d IS NULL THEN 1 ELSE ' + SMOOTH.format(u='(d / 1.5)') + ' END', 'weight')} FROM pt LEFT JOIN d USING (pid)",
    "points_near_areas": f"WITH {POINTS}, {RINGS}, {PIN}, {PDIST} SELECT pid FROM pt WHERE pid IN (SELECT pid FROM pin) OR pid IN (SELECT pid FROM rd WHERE distance <= 0.75)",
    "scatter_mask": f"""WITH {POINTS}, {RINGS}, {PIN}, {PDIST}, ok AS (SELECT pid FROM pin WHERE area_id < 3 GROUP BY pid EXCEPT SELECT pid FROM pin WHERE area_id = 3 EXCEPT SELECT pid FROM rd WHERE area_id = 3 AND distance < 0.5),
  e AS (SELECT pid, min(distance) AS d FROM rd WHERE area_id < 3 AND distance <= 1.3 GROUP BY pid) SELECT pid, {r('CASE WHEN d IS NULL THEN 1 WHEN d < 0.3 THEN 0 ELSE least(greatest((d - 0.3) / 1.0, 0), 1) END', 'probability')} FROM ok LEFT JOIN e USING (pid)""",
    "conformed_surface": f"WITH {V}, {REF} SELECT v.vid, round(CASE WHEN v.vid % 3 != 0 THEN v.z + 0.25 * 1.0 * (ref.z - v.z) ELSE v.z END, 11) AS z FROM v JOIN ref ON ref.vid = v.vid",
    "graded_pads": f"""WITH {V}, {REF}, {RINGS}, pt AS (SELECT v.vid AS pid, v.x, v.y, ref.z FROM v JOIN ref ON ref.vid = v.vid), {PIN}, {PDIST}, pads AS (SELECT * FROM (VALUES (1, 2.0::DOUBLE, 2.0::DOUBLE), (2, 1.0, 1.5), (3, 3.0, 1.0)) t(area_id, pad_z, batter)),
  i AS (SELECT pid, arg_min(pad_z, area_id) AS in_z FROM pin JOIN pads USING (area_id) GROUP BY pid), n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY distance, area_id) AS k FROM rd JOIN pads USING (area_id) WHERE distance <= 3) WHERE k = 1),
  g AS (SELECT pt.pid AS vid, z, CASE WHEN in_z IS NOT NULL THEN in_z WHEN n.pid IS NOT NULL THEN CASE WHEN z > pad_z THEN least(z, pad_z + distance / batter) ELSE greatest(z, pad_z - distance / batter) END ELSE z END AS w FROM pt LEFT JOIN i USING (pid) LEFT JOIN n USING (pid))
  SELECT vid, {r('w', 'z')}, CASE WHEN z - w > 1e-9 THEN 1 WHEN w - z > 1e-9 THEN -1 ELSE 0 END AS branch FROM g""",
    "graded_corridor": f"""WITH {V}, {REF}, rt AS (SELECT x::INT AS route_id, y::INT AS seq, x, y, 2.0 + y * 0.01 AS z FROM v), lg AS (SELECT a.route_id, a.seq, a.x AS x0, a.y AS y0, a.z AS z0, b.x AS x1, b.y AS y1, b.z AS z1 FROM rt a JOIN rt b ON a.route_id = b.route_id AND b.seq = a.seq + 1),
  dd AS (SELECT *, {SEGT} AS t FROM (SELECT v.vid, v.x AS px, v.y AS py FROM v) JOIN lg ON abs(px - x0) <= 3 AND y0 <= py + 3 AND y1 >= py - 3), ds AS (SELECT *, {SEGDIST} AS d, z0 + (z1 - z0) * t AS lz FROM dd),
  b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY d, route_id, seq) AS k FROM ds WHERE d <= 3) WHERE k = 1)
  SELECT ref.vid, round(CASE WHEN d IS NULL THEN z WHEN d <= 1 THEN lz WHEN z > lz THEN least(z, lz + greatest(0, d - 1) / 2) ELSE greatest(z, lz - greatest(0, d - 1) / 2) END, 8) + 0.0 AS z FROM ref LEFT JOIN b ON b.vid = ref.vid""",
    "brush_dab": f"WITH {V}, {REF}, q AS (SELECT v.vid, ref.z, sqrt((v.x - 20.3) * (v.x - 20.3) + (v.y - 10.7) * (v.y - 10.7)) / 6 AS d FROM v JOIN ref ON ref.vid = v.vid) SELECT vid, round(CASE WHEN d < 1 THEN z + 0.8 * ((1 - d) * (1 - d) * (3 - 2 * (1 - d))) ELSE z END, 8) + 0.0 AS z FROM q",
    "height_conflicts": f"WITH {CROSS}, g AS (SELECT s1, s2, ax + (bx - ax) * t AS x, ay + (by - ay) * t AS y, abs((s1 % 13) + ((s1 % 7) - (s1 % 13)) * t - ((s2 % 13) + ((s2 % 7) - (s2 % 13)) * u)) AS gap FROM x) SELECT s1, s2, {rs('x', 'y', 'gap')} FROM g WHERE gap > 1.5",
    "split_segments": f"""WITH {CROSS}, cut AS (SELECT s1 AS sid, t FROM x UNION SELECT s2, u FROM x UNION SELECT sid, 0 FROM s UNION SELECT sid, 1 FROM s), pr AS (SELECT sid, t AS a, lead(t) OVER (PARTITION BY sid ORDER BY t) AS b, row_number() OVER (PARTITION BY sid ORDER BY t)::INT - 1 AS part FROM cut)
  SELECT sid, part, {r('ax + (bx - ax) * a', 'x0')}, {r('ay + (by - ay) * a', 'y0')}, {r('ax + (bx - ax) * b', 'x1')}, {r('ay + (by - ay) * b', 'y1')} FROM pr JOIN s USING (sid) WHERE b IS NOT NULL""",
    "crossing_chains": f"WITH {CROSS} SELECT DISTINCT sid // 3 AS chain_id FROM (SELECT s1 AS sid FROM x UNION SELECT s2 FROM x)",
    "boundary_peel": f"""WITH RECURSIVE {XYZ.replace('f AS (', 'f0 AS (').replace('FROM f JOIN', 'FROM f0 f JOIN')}, f AS (SELECT * FROM f0 WHERE fid % 101 != 0), {HALF}, odd AS (SELECT fid FROM m WHERE fid % 101 != 0 AND degrees(atan(slope)) > 60),
  ad AS (SELECT p.fid AS a, q.fid AS b FROM h p JOIN h q ON p.u = q.u AND p.w = q.w AND p.fid != q.fid WHERE p.fid IN (SELECT fid FROM odd) AND q.fid IN (SELECT fid FROM odd)),
  gone AS (SELECT DISTINCT h.fid FROM h JOIN edges ON h.u = edges.u AND h.w = edges.v AND n_faces = 1 WHERE h.fid IN (SELECT fid FROM odd) UNION SELECT b FROM gone JOIN ad ON a = gone.fid) SELECT fid FROM f WHERE fid NOT IN (SELECT fid FROM gone)""",
    "boundary_chains": f"""WITH RECURSIVE {FACES.replace('f AS (', 'ff AS (')}, f AS (SELECT * FROM ff WHERE fid % 101 != 0), {HALF}, nk AS (SELECT u, v FROM edges WHERE n_faces = 1), lk AS (SELECT u AS a, v AS b FROM nk UNION SELECT v, u FROM nk),
  lab AS (SELECT a AS node, a AS root FROM lk GROUP BY a UNION SELECT l.b, p.root FROM lab p JOIN lk l ON l.a = p.node), mn AS (SELECT node, min(root) AS root FROM lab GROUP BY node), dg AS (SELECT a AS node, count(*) AS d FROM lk GROUP BY a)
  SELECT root AS chain, any_value(e.n) AS n_edges, count(*) AS n_vertices, bool_and(d = 2) AS closed FROM mn JOIN dg USING (node) JOIN (SELECT root, count(*) AS n FROM nk JOIN mn ON mn.node = nk.u GROUP BY root) e USING (root) GROUP BY root""",
    "draped_lines": f"""WITH {ROUTE}, h AS (SELECT *, CASE WHEN (seq * 7 + route_id) % 5 != 0 THEN z + 1 END AS h FROM line),
  sp AS (SELECT *, sum(CASE WHEN h IS NOT NULL AND pv IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY route_id ORDER BY seq)::INT AS part FROM (SELECT *, lag(h) OVER (PARTITION BY route_id ORDER BY seq) AS pv FROM h)),
  br AS (SELECT *, last_value(h IGNORE NULLS) OVER b AS h0, last_value(CASE WHEN h IS NOT NULL THEN station END IGNORE NULLS) OVER b AS t0, first_value(h IGNORE NULLS) OVER a AS h1, first_value(CASE WHEN h IS NOT NULL THEN station END IGNORE NULLS) OVER a AS t1 FROM h
    WINDOW b AS (PARTITION BY route_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY route_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
  SELECT 'split' AS policy, route_id, seq, part, round(h, 8) + 0.0 AS z FROM sp WHERE h IS NOT NULL UNION ALL SELECT 'bridge', route_id, seq, 0, round(coalesce(h, h0 + (h1 - h0) * ((station - t0) / (t1 - t0))), 8) + 0.0 FROM br WHERE h0 IS NOT NULL AND h1 IS NOT NULL""",
    "zone_stack_order": """WITH z AS (SELECT n_nationkey AS zone_id, n_nationkey % 6 AS zo, n_nationkey % 4 AS so, n_nationkey AS o, n_regionkey % 2 = 0 AS e, (n_nationkey * 7) % 11 AS el FROM nation), k AS (SELECT *, row_number() OVER (ORDER BY zo, so, o) AS k FROM z),
  n AS (SELECT *, sum(CASE WHEN e AND pe THEN 0 ELSE 1 END) OVER (ORDER BY k) AS run FROM (SELECT *, lag(e) OVER (ORDER BY k) AS pe FROM k)) SELECT zone_id, row_number() OVER (ORDER BY run, CASE WHEN e THEN el END NULLS FIRST, so, zo, o)::INT AS place FROM n""",
    "curve_review": """WITH r AS (SELECT s_suppkey AS route_id, unnest([{'c': 'grade', 'u': (s_suppkey * 7) % 23 / 100 / 0.12}, {'c': 'radius', 'u': 20 / ((s_suppkey * 11) % 37 + 5)}, {'c': 'break', 'u': (s_suppkey * 13) % 19 / 10}, {'c': 'coverage', 'u': 0.8 / ((s_suppkey * 17) % 41 / 40 + 0.01)}]) AS x FROM supplier)
  SELECT route_id, x.c AS "check", CASE WHEN x.u > 1 THEN 'fail' WHEN x.u > 0.9 THEN 'warn' ELSE 'pass' END AS verdict FROM r""",
    "level_area_compliance": f"""WITH {XYZ}, {RINGS}, f2 AS (SELECT fid, mx AS x, my AS y, -nx / nz AS p, -ny / nz AS q, plan_area AS w FROM m WHERE nz != 0), mem AS (SELECT fid FROM f2, re WHERE (y1 > y) != (y0 > y) AND x < (x0 - x1) * (y - y1) / (y0 - y1) + x1 GROUP BY fid HAVING count(*) % 2 = 1),
  k AS (SELECT f2.* FROM f2 JOIN mem USING (fid)), avg_ AS (SELECT a.fid, any_value(a.w) AS w, sum(b.p * b.w) / sum(b.w) AS p, sum(b.q * b.w) / sum(b.w) AS q FROM k a JOIN k b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 2.25 GROUP BY a.fid)
  SELECT CASE WHEN sqrt(p * p + q * q) > 0.9 + 1e-9 THEN 'exceeds' ELSE 'level' END AS verdict, count(*) AS n_faces, {r('sum(w)', 'plan_area')} FROM avg_ GROUP BY 1""",
    "trimmed_faces": f"""WITH {XYZ}, {RINGS}, pt AS (SELECT fid AS pid, mx AS x, my AS y FROM m), {PIN} SELECT pid AS fid FROM pin GROUP BY pid HAVING (bool_or(area_id = 1) AND NOT bool_or(area_id = 3)) OR bool_or(area_id = 2)""",
    "mask_open": f"""WITH {GRID}, mk AS (SELECT col, row FROM grid WHERE v >= 44), er AS (SELECT col + i AS col, row + j AS row FROM mk, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j) GROUP BY 1, 2 HAVING count(*) = 9)
  SELECT DISTINCT col + i AS col, row + j AS row FROM er, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j)""",
    "mask_distance": f"WITH {GRID}, low AS (SELECT col, row FROM grid WHERE v = (SELECT min(v) FROM grid)) SELECT a.col, a.row, min((a.col - b.col) * (a.col - b.col) + (a.row - b.row) * (a.row - b.row))::BIGINT AS d2 FROM grid a, low b GROUP BY a.col, a.row",
    "mask_largest": f"""WITH RECURSIVE {GRID}, mask AS (SELECT col, row, row * 100000 + col AS id FROM grid WHERE v < 47 OR (col + row) % 3 = 0), lk AS (SELECT a.id AS a, b.id AS b FROM mask a JOIN mask b ON abs(a.col - b.col) + abs(a.row - b.row) = 1),
  reach AS (SELECT id AS a, id AS b FROM mask UNION SELECT r.a, l.b FROM reach r JOIN lk l ON r.b = l.a), lab AS (SELECT a, min(b) AS l FROM reach GROUP BY a), best AS (SELECT l FROM lab GROUP BY l ORDER BY count(*) DESC, (l // 100000)::VARCHAR || ':' || (l % 100000) LIMIT 1) SELECT col, row FROM lab JOIN best USING (l) JOIN mask ON mask.id = a""",
    "harmonic_fill": f"""WITH {GRID}, kn AS (SELECT * FROM grid WHERE (col * 7 + row * 3) % 5 != 0) -- no two gaps touch, so each is its neighbours' mean
  SELECT col, row, {r('v')} FROM kn UNION ALL SELECT g.col, g.row, round(coalesce(avg(k.v), (SELECT avg(v) FROM kn)), 8) + 0.0 FROM grid g LEFT JOIN kn k ON abs(g.col - k.col) + abs(g.row - k.row) = 1 WHERE (g.col * 7 + g.row * 3) % 5 = 0 GROUP BY g.col, g.row""",
    "classified_ground": f"""WITH {GRID}, e1 AS {windowed('grid', 1, 'min')}, o1 AS {windowed('e1', 1, 'max')}, e2 AS {windowed('o1', 2, 'min')}, o2 AS {windowed('e2', 2, 'max')}, gr AS (SELECT col, row, min(z) FILTER (cls = 2) AS g FROM cl GROUP BY col, row)
  SELECT g.col, g.row, round(coalesce(gr.g, g.v), 8) + 0.0 AS v, (g.v - o1.v <= 2.6 AND o1.v - o2.v <= 2.6) OR gr.g IS NOT NULL AS is_ground FROM grid g JOIN o1 USING (col, row) JOIN o2 USING (col, row) JOIN gr USING (col, row)""",
    "route_height_grid": f"WITH {V} SELECT a.vid AS pid, round(CASE WHEN b.vid IS NULL OR c.vid IS NULL THEN NULL ELSE 0.25 * a.z + 0.25 * b.z + 0.5 * c.z END, 11) + 0.0 AS top_z FROM v a LEFT JOIN v b ON b.vid = a.vid + 1 AND b.y = a.y LEFT JOIN v c ON c.vid = a.vid + 50",
    "water_traces": f"""WITH RECURSIVE {FLOW}, tr AS (SELECT fid AS start, 0 AS step, fid, [fid] AS seen FROM f UNION ALL SELECT start, step + 1, flows_to, list_append(seen, flows_to) FROM tr JOIN flow USING (fid) WHERE flows_to >= 0 AND NOT list_contains(seen, flows_to)) SELECT start, step, fid FROM tr""",
    "basin_rims": f"""WITH RECURSIVE {FLOW}{ROOTS}, er AS (SELECT u, w, root FROM h JOIN roots USING (fid)), pr AS (SELECT u, w, min(root) AS lo, max(root) AS hi, count(*) AS n FROM er GROUP BY u, w), lv AS (SELECT pr.*, least(a.z, b.z) AS level FROM pr JOIN v a ON a.vid = u JOIN v b ON b.vid = w),
  al AS (SELECT lo AS root, hi AS other, level FROM lv WHERE lo != hi UNION ALL SELECT hi, lo, level FROM lv WHERE lo != hi UNION ALL SELECT lo, -1, level FROM lv WHERE n = 1) SELECT root, other, {r('min(level)', 'level')} FROM al GROUP BY root, other""",
}

# A keyword in one dialect, a corner's coordinate here.
SQL = {k: re.sub(r"\bby\b", '"by"', v) for k, v in SQL.items()}
