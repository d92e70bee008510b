"""Queries on places, polygons, routes, rasters and labels, each with its SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolode.functions import geometry as G
from geolode.functions import text as X
from geolode.operators import cleanup, curves, edits, faces, fields, graphs, labels, lines, polygons, rasters, rays, sections, spatial, surfaces, topology
from geolode.plans import oracles as O
from geolode.plans.oracles import r, rs
from geolode.plans.queries import R, _grid, _levels, _points, _ring_edges, _routes, _segments, mesh, query, rounded, survey_lines
from geolode.sources import rasters as files
from geolode.sources import survey
from geolode.sources import tables as T

SQL: dict[str, str] = {}


# scalars


@query
def placement_frames(spark, d):
    p = _points(spark, d)
    u, v = G.to_local("x", "y", 10.0, 5.0, 30.0)
    p = p.select("pid", u.alias("u"), v.alias("v"))
    x, y = G.to_world("u", "v", 10.0, 5.0, 30.0)
    return rounded(p.select("pid", "u", "v", x.alias("x"), y.alias("y")))


SQL["placement_frames"] = f"WITH {O.POINTS}, l AS (SELECT pid, (x - 10) * cos(radians(30)) + (y - 5) * sin(radians(30)) AS u, (y - 5) * cos(radians(30)) - (x - 10) * sin(radians(30)) AS v, x, y FROM pt) SELECT pid, {rs('u', 'v', 'x', 'y')} FROM l"


@query
def datum_levels(spark, d):
    s = T.table(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), G.datum("s_acctbal", 250.0).alias("datum"))


SQL["datum_levels"] = "SELECT s_suppkey AS id, floor(s_acctbal / 250.0) * 250.0 - 250.0 AS datum FROM supplier"


@query
def unit_conversions(spark, d):
    p = _points(spark, d)
    return rounded(p.select("pid", G.convert("x", "ft", "m").alias("length"), G.convert("x", "ft", "m", 2).alias("area"), G.convert("x", "ft", "m", 3).alias("volume"), G.convert("x", "ft", "m", -2).alias("per_area")))


SQL["unit_conversions"] = f"WITH {O.POINTS} SELECT pid, {r('x * 0.3048', 'length')}, {r('x * pow(0.3048, 2)', 'area')}, {r('x * pow(0.3048, 3)', 'volume')}, {r('x * pow(0.3048, -2)', 'per_area')} FROM pt"


@query
def segment_touch(spark, d):
    s = _segments(spark, d)
    t = s.select((F.col("sid") - 1).alias("sid"), *(F.col(k).alias(f"o{k}") for k in ("x0", "y0", "x1", "y1")))
    p = s.join(t, "sid")
    return p.select("sid", G.segments_touch("x0", "y0", "x1", "y1", "ox0", "oy0", "ox1", "oy1").alias("touch"), G.in_segment_box("ox0", "oy0", "x0", "y0", "x1", "y1", 1.5).alias("in_box"))


_SIDE = lambda a, b, p: f"sign(({b}x - {a}x) * ({p}y - {a}y) - ({b}y - {a}y) * ({p}x - {a}x))"
SQL["segment_touch"] = f"""WITH {O.SEG}, j AS (SELECT p.sid, p.ax, p.ay, p.bx, p.by, q.ax AS cx, q.ay AS cy, q.bx AS dx, q.by AS dy FROM s p JOIN s q ON q.sid = p.sid + 1)
  SELECT sid, {_SIDE('a', 'b', 'c')} * {_SIDE('a', 'b', 'd')} <= 0 AND {_SIDE('c', 'd', 'a')} * {_SIDE('c', 'd', 'b')} <= 0 AND greatest(ax, bx) >= least(cx, dx) AND greatest(cx, dx) >= least(ax, bx) AND greatest(ay, by) >= least(cy, dy) AND greatest(cy, dy) >= least(ay, by) AS touch,
    cx BETWEEN least(ax, bx) - 1.5 AND greatest(ax, bx) + 1.5 AND cy BETWEEN least(ay, by) - 1.5 AND greatest(ay, by) + 1.5 AS in_box FROM j"""


@query
def tie_in_weights(spark, d):
    p = sections.plan_stations(_routes(spark, d))
    end = p.groupBy("route_id").agg(F.max("station").alias("length"))
    return rounded(p.join(end, "route_id").select("route_id", "seq", lines.tie_in("station", "length", 3.0).alias("weight")))


SQL["tie_in_weights"] = f"WITH {O.ROUTE}, e AS (SELECT route_id, max(station) AS len FROM line GROUP BY route_id) SELECT route_id, seq, {r('least(greatest(least(station, len - station) / 3, 0), 1)', 'weight')} FROM line JOIN e USING (route_id)"


@query
def displaced_surface(spark, d):
    v = T.lattice_vertices(spark, d)
    w = G.smoothstep(F.col("x") / 20)
    return edits.displaced(v, 0.25 * F.col("y") - 1, w).select("vid", F.round("z", 11).alias("z"))


SQL["displaced_surface"] = f"WITH {O.V}, w AS (SELECT *, least(x / 20, 1) AS u FROM v) SELECT vid, round(z + u * u * (3 - 2 * u) * (0.25 * y - 1), 11) AS z FROM w"


@query
def drawing_frame(spark, d):
    p = sections.plan_stations(_routes(spark, d))
    x, y = G.to_drawing("station", "z", 100.0, 50.0, -1.0, 5.0)
    p = p.select("route_id", "seq", x.alias("x"), y.alias("y"))
    s, z = G.from_drawing("x", "y", 100.0, 50.0, -1.0, 5.0)
    return rounded(p.select("route_id", "seq", "x", "y", s.alias("station"), z.alias("z")))


SQL["drawing_frame"] = f"WITH {O.ROUTE} SELECT route_id, seq, {r('100 + station', 'x')}, {r('50 + (z + 1) * 5', 'y')}, {rs('station', 'z')} FROM line"


@query
def display_numbers(spark, d):
    o = T.table(spark, d, "orders")
    v = (F.col("o_orderkey") % 400 - 200) / 2
    return rounded(o.select(F.col("o_orderkey").alias("id"), *(X.display_ratio(v, u).alias(u) for u in ("ratio", "percent", "degrees")), X.display_number(X.display_ratio(v, "percent"), "ratio").alias("shown")))


SQL["display_numbers"] = f"WITH t AS (SELECT o_orderkey AS id, (o_orderkey % 400 - 200) / 2.0::DOUBLE AS v FROM orders) SELECT id, {r('CASE WHEN v = 0 THEN 0 ELSE 1 / v END', 'ratio')}, {r('v / 100', 'percent')}, round(CASE WHEN abs(v) <= 89.9 THEN tan(radians(v)) END, 8) + 0.0 AS degrees, {r('CASE WHEN v = 0 THEN 0 ELSE 1 / (v / 100) END', 'shown')} FROM t"


@query
def typed_degrees(spark, d):
    o = T.table(spark, d, "orders")
    k = F.col("o_orderkey")
    t = F.when(k % 4 == 0, F.concat((k % 97).cast("string"), F.lit("°"))).when(k % 4 == 1, F.concat((k % 250).cast("string"), F.lit("%"))).when(k % 4 == 2, F.concat(F.lit("1:"), (k % 9 + 1).cast("string"))).otherwise(F.lit("n/a"))
    return rounded(o.select(k.alias("id"), X.parse_degrees(t, "percent").alias("degrees")))


SQL["typed_degrees"] = "WITH t AS (SELECT o_orderkey AS id, o_orderkey % 4 AS m, o_orderkey % 97 AS a, o_orderkey % 250 AS b, o_orderkey % 9 + 1 AS c FROM orders), q AS (SELECT id, CASE m WHEN 0 THEN CASE WHEN a <= 89.9 THEN a END WHEN 1 THEN degrees(atan(b / 100.0)) WHEN 2 THEN degrees(atan(1.0 / c)) END AS g FROM t) SELECT id, round(g::DOUBLE, 8) + 0.0 AS degrees FROM q"


@query
def ramp_samples(spark, d):
    return rounded(X.ramp_samples(spark, [(0.0, (0, 80, 255)), (0.4, (240, 240, 90)), (1.0, (200, 0, 30))], 11))


def _ramp(a: int, b: int, c: int) -> str:
    return f"round_even(CASE WHEN t <= 0.4 THEN {a} + t / 0.4 * ({b} - {a}) ELSE {b} + (t - 0.4) / 0.6 * ({c} - {b}) END, 0)::INT"


SQL["ramp_samples"] = f"WITH s AS (SELECT i::INT AS i, i / 10.0::DOUBLE AS t FROM range(11) x(i)) SELECT i, {r('t')}, {_ramp(0, 240, 200)} AS r, {_ramp(80, 240, 0)} AS g, {_ramp(255, 90, 30)} AS b FROM s"


@query
def landform_size(spark, d):
    v = T.lattice_vertices(spark, d)
    e = v.agg((F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"))
    return rounded(e.select(G.landform_size("w", "h").alias("size")))


SQL["landform_size"] = f"""WITH {O.V}, e AS (SELECT max(x) - min(x) AS w, max(y) - min(y) AS h FROM v), b AS (SELECT greatest(least(w, h), greatest(w, h) / 50) * 0.1 AS b FROM e), p AS (SELECT b, pow(10, floor(log10(b))) AS p FROM b)
  SELECT {r('p * k', 'size')} FROM p, (VALUES (1.0::DOUBLE), (2), (2.5), (5), (10)) m(k) ORDER BY abs(ln(b / p / k)), k LIMIT 1"""


@query
def mesh_verdict(spark, d):
    return rounded(topology.mesh_verdict(mesh(spark, d)[2]))


SQL["mesh_verdict"] = f"""WITH {O.XYZ}, q AS ({O.SQL['mesh_regularity']}), e AS (SELECT count(*) AS n, sqrt(pow(max(greatest(ax, bx, cx)) - min(least(ax, bx, cx)), 2) + pow(max(greatest(ay, by, cy)) - min(least(ay, by, cy)), 2) + pow(max(greatest(az, bz, cz)) - min(least(az, bz, cz)), 2)) AS diagonal FROM m)
  SELECT n AS n_faces, {r('diagonal')}, median_edge, n < 250 OR median_edge > diagonal / 12 AS very_sparse, n_skinny >= greatest(1, n_sampled // 100) AS very_skinny FROM e, q"""


@query
def coordinate_check(spark, d):
    """Farthest coordinate, its rounding step in 32 bits, and whether that passes a tenth of a millimetre."""
    m = T.lattice_vertices(spark, d).agg(F.max(F.greatest(F.abs("x"), F.abs("y"))).alias("magnitude"))
    return rounded(m.select("magnitude", (F.col("magnitude") * G.FLOAT_STEP).alias("step"), (F.col("magnitude") > G.safe_distance(0.001)).alias("too_far")))


SQL["coordinate_check"] = f"WITH {O.V}, m AS (SELECT max(greatest(abs(x), abs(y))) AS magnitude FROM v) SELECT {r('magnitude')}, {r('magnitude / 8388608', 'step')}, magnitude > 0.001 * 0.1 * 8388608 AS too_far FROM m"


# points


@query
def cell_extremes(spark, d):
    p = _points(spark, d)
    g = p.groupBy(F.floor(F.col("x") / 5).alias("col"), F.floor(F.col("y") / 5).alias("row"))
    return g.agg(F.min(F.struct("z", "pid")).alias("lo"), F.max(F.struct("z", (-F.col("pid")).alias("p"))).alias("hi")).select("col", "row", F.col("lo.pid").alias("lowest"), (-F.col("hi.p")).alias("highest"))


SQL["cell_extremes"] = f"WITH {O.POINTS}, k AS (SELECT *, floor(x / 5)::BIGINT AS col, floor(y / 5)::BIGINT AS row FROM pt) SELECT DISTINCT col, row, first_value(pid) OVER (PARTITION BY col, row ORDER BY z, pid) AS lowest, first_value(pid) OVER (PARTITION BY col, row ORDER BY z DESC, pid) AS highest FROM k"


@query
def scatter_mix(spark, d):
    """Counts and shares of what is planted, by kind, with a total row (kind -1)."""
    n = _points(spark, d).select((F.col("pid") % 5).alias("kind")).rollup("kind").agg(F.count("*").alias("n"))
    total = n.where("kind is null").select(F.col("n").alias("total"))
    return rounded(n.join(F.broadcast(total), how="cross").select(F.coalesce("kind", F.lit(-1)).alias("kind"), "n", (F.col("n") / F.col("total")).alias("share")))


SQL["scatter_mix"] = f"WITH {O.POINTS} SELECT coalesce(pid % 5, -1) AS kind, count(*) AS n, {r('count(*) / (SELECT count(*) FROM pt)', 'share')} FROM pt GROUP BY ROLLUP (pid % 5)"


@query
def merge_targets(spark, d):
    p = _points(spark, d)
    first, last, centre = (graphs.merge_targets(p, m).select(F.lit(m).alias("mode"), "pid", "x", "y", "z") for m in ("first", "last", "centre"))
    return rounded(first.unionByName(last).unionByName(centre))


SQL["merge_targets"] = f"""WITH {O.POINTS}, m AS (SELECT 'first' AS mode, x, y, z FROM pt WHERE pid = (SELECT min(pid) FROM pt) UNION ALL SELECT 'last', x, y, z FROM pt WHERE pid = (SELECT max(pid) FROM pt) UNION ALL SELECT 'centre', avg(x), avg(y), avg(z) FROM pt)
  SELECT mode, pid, {r('m.x', 'x')}, {r('m.y', 'y')}, {r('m.z', 'z')} FROM pt, m"""


# polygons


def _plots(spark, d) -> DataFrame:
    """A plot at every supplier's place: a skewed quadrangle, every fifth one crossing itself."""
    s = T.table(spark, d, "supplier")
    k = F.col("s_suppkey")
    cx, cy, w, h = (k * 17 % 47).cast("double"), (k * 29 % 31).cast("double"), 1 + k % 3 * 0.5, 0.8 + k % 4 * 0.4
    corner = [(cx, cy), (cx + w, cy + 0.3), (cx + w + 0.2, cy + h), (cx - 0.1, cy + h + 0.1)]
    seq = lambda i: F.when(k % 5 == 0, F.lit([0, 2, 1, 3][i])).otherwise(F.lit(i))
    p = s.select(k.alias("area_id"), F.explode(F.array(*[F.struct(seq(i).alias("seq"), x.alias("x"), y.alias("y")) for i, (x, y) in enumerate(corner)])).alias("p"))
    return p.select("area_id", F.lit(0).alias("ring_id"), "p.*")


PLOTS = """plot AS (SELECT s_suppkey AS area_id, (s_suppkey * 17 % 47)::DOUBLE AS cx, (s_suppkey * 29 % 31)::DOUBLE AS cy, 1 + s_suppkey % 3 * 0.5::DOUBLE AS w, 0.8::DOUBLE + s_suppkey % 4 * 0.4::DOUBLE AS h, s_suppkey % 5 = 0 AS bow FROM supplier),
pc AS (SELECT area_id, CASE WHEN bow THEN [0, 2, 1, 3][i + 1] ELSE i END AS seq, CASE i WHEN 0 THEN cx WHEN 1 THEN cx + w WHEN 2 THEN cx + w + 0.2::DOUBLE ELSE cx - 0.1::DOUBLE END AS x, CASE i WHEN 0 THEN cy WHEN 1 THEN cy + 0.3::DOUBLE WHEN 2 THEN cy + h ELSE cy + h + 0.1::DOUBLE END AS y FROM plot, range(4) t(i)),
pe AS (SELECT a.area_id, a.seq, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM pc a JOIN pc b ON a.area_id = b.area_id AND b.seq = (a.seq + 1) % 4)"""


def _cross(a: str, b: str) -> str:
    side = lambda e, px, py: f"(({e}.x1 - {e}.x0) * ({py} - {e}.y0) - ({e}.y1 - {e}.y0) * ({px} - {e}.x0))"
    return f"{side(a, f'{b}.x0', f'{b}.y0')} * {side(a, f'{b}.x1', f'{b}.y1')} < 0 AND {side(b, f'{a}.x0', f'{a}.y0')} * {side(b, f'{a}.x1', f'{a}.y1')} < 0"


def _inside(point: str, edge: str) -> str:
    return f"(({edge}.y1 > {point}.y) != ({edge}.y0 > {point}.y)) AND {point}.x < ({edge}.x0 - {edge}.x1) * ({point}.y - {edge}.y1) / ({edge}.y0 - {edge}.y1) + {edge}.x1"


@query
def polygon_overlaps(spark, d):
    return polygons.overlaps(spatial.ring_edges(_plots(spark, d)), 3.0)


SQL["polygon_overlaps"] = f"""WITH {PLOTS}, v AS (SELECT p.area_id AS p, e.area_id AS q FROM pc p JOIN pe e ON p.area_id != e.area_id AND {_inside('p', 'e')} GROUP BY p.area_id, p.seq, e.area_id HAVING count(*) % 2 = 1)
  SELECT DISTINCT least(p, q) AS a, greatest(p, q) AS b FROM (SELECT p, q FROM v UNION ALL SELECT e.area_id, g.area_id FROM pe e JOIN pe g ON e.area_id < g.area_id AND {_cross('e', 'g')})"""


@query
def self_crossing_rings(spark, d):
    return polygons.self_crossing(spatial.ring_edges(_plots(spark, d)), 3.0)


SQL["self_crossing_rings"] = f"WITH {PLOTS} SELECT DISTINCT e.area_id, 0 AS ring_id FROM pe e JOIN pe g ON e.area_id = g.area_id AND e.seq < g.seq AND {_cross('e', 'g')}"


@query
def interior_points(spark, d):
    return rounded(polygons.interior_points(spatial.ring_edges(_plots(spark, d)).unionByName(_ring_edges(spark).withColumn("area_id", -F.col("area_id")))))


SQL["interior_points"] = f"""WITH {PLOTS}, {O.RINGS}, e AS (SELECT area_id, x0, y0, x1, y1 FROM pe UNION ALL SELECT -area_id, x0, y0, x1, y1 FROM re),
  gp AS (SELECT area_id, y, lead(y) OVER (PARTITION BY area_id ORDER BY y) - y AS gap FROM (SELECT DISTINCT area_id, y0 AS y FROM e)),
  lv AS (SELECT area_id, y + gap / 2 AS y FROM (SELECT *, row_number() OVER (PARTITION BY area_id ORDER BY gap DESC, y) AS k FROM gp WHERE gap > 0) WHERE k = 1),
  hx AS (SELECT e.area_id, y, x0 + (x1 - x0) * ((y - y0) / (y1 - y0)) AS x FROM e JOIN lv ON e.area_id = lv.area_id AND (y0 > y) != (y1 > y)),
  st AS (SELECT *, lead(x) OVER w AS x2, row_number() OVER w AS k FROM hx WINDOW w AS (PARTITION BY area_id ORDER BY x))
  SELECT area_id, {rs('x', 'y')} FROM (SELECT area_id, x + (x2 - x) / 2 AS x, y, row_number() OVER (PARTITION BY area_id ORDER BY x2 - x DESC, x) AS n FROM st WHERE k % 2 = 1) WHERE n = 1"""


@query
def footprints_inside(spark, d):
    p = _plots(spark, d).select(F.col("area_id").alias("shape"), F.col("seq").alias("pid"), "x", "y")
    return polygons.all_inside(p, _ring_edges(spark), 0.4, 4.0)


SQL["footprints_inside"] = f"""WITH {PLOTS}, {O.RINGS}, i AS (SELECT p.area_id AS shape, p.seq, e.area_id FROM pc p JOIN re e ON {_inside('p', 'e')} GROUP BY ALL HAVING count(*) % 2 = 1),
  n AS (SELECT DISTINCT shape, seq, area_id FROM (SELECT *, {O.SEGT} AS t FROM (SELECT area_id AS shape, seq, x AS px, y AS py FROM pc), (SELECT area_id, x0, y0, x1, y1 FROM re)) WHERE {O.SEGDIST} <= 0.4)
  SELECT shape, area_id FROM (SELECT * FROM i UNION SELECT * FROM n) GROUP BY shape, area_id HAVING count(*) = 4"""


def _heighted(spark, d) -> DataFrame:
    s = F.col("sid")
    return _segments(spark, d).withColumns({"z0": (s % 13).cast("double"), "z1": (s % 7).cast("double")})


@query
def clipped_lines(spark, d):
    return rounded(polygons.clipped_lines(_heighted(spark, d), _ring_edges(spark), 4.0))


CLIP = f"""{O.SEG}, {O.RINGS}, sg AS (SELECT sid, ax AS x0, ay AS y0, bx AS x1, by AS y1 FROM s),
  ct AS (SELECT s.sid, e.area_id, (s.x1 - s.x0) * (e.y1 - e.y0) - (s.y1 - s.y0) * (e.x1 - e.x0) AS den, (e.x0 - s.x0) * (e.y1 - e.y0) - (e.y0 - s.y0) * (e.x1 - e.x0) AS tn, (e.x0 - s.x0) * (s.y1 - s.y0) - (e.y0 - s.y0) * (s.x1 - s.x0) AS un FROM sg s, re e),
  tt AS (SELECT DISTINCT sid, area_id, tn / den AS t FROM ct WHERE den != 0 AND tn / den > 0 AND tn / den < 1 AND un / den BETWEEN 0 AND 1),
  ar AS (SELECT DISTINCT area_id FROM re), al AS (SELECT sid, area_id, t FROM tt UNION ALL SELECT sid, area_id, 0.0 FROM sg, ar UNION ALL SELECT sid, area_id, 1.0 FROM sg, ar),
  pt2 AS (SELECT sid, area_id, t AS t0, lead(t) OVER w AS t1, (row_number() OVER w - 1)::INT AS part FROM al WINDOW w AS (PARTITION BY sid, area_id ORDER BY t)),
  md AS (SELECT p.*, s.x0 + (s.x1 - s.x0) * (t0 + t1) / 2 AS x, s.y0 + (s.y1 - s.y0) * (t0 + t1) / 2 AS y FROM pt2 p JOIN sg s USING (sid) WHERE t1 - t0 > 1e-12),
  inn AS (SELECT md.sid, md.area_id, part, t0, t1 FROM md JOIN re e ON e.area_id = md.area_id AND {_inside('md', 'e')} GROUP BY ALL HAVING count(*) % 2 = 1)"""
SQL["clipped_lines"] = f"""WITH {CLIP}, z AS (SELECT inn.*, x0 AS ax, y0 AS ay, x1 AS bx, y1 AS by, (sid % 13)::DOUBLE AS az, (sid % 7)::DOUBLE AS bz FROM inn JOIN sg USING (sid))
  SELECT sid, area_id, part, {rs('t0', 't1')}, {', '.join(r(f'a{c} + (b{c} - a{c}) * t{i}', f'{c}{i}') for i in (0, 1) for c in 'xyz')} FROM z"""


@query
def lines_inside(spark, d):
    return polygons.lines_inside(_heighted(spark, d), _ring_edges(spark), 4.0)


SQL["lines_inside"] = f"WITH {CLIP} SELECT sid, area_id FROM inn GROUP BY sid, area_id HAVING sum(t1 - t0) >= 1 - 1e-9"


@query
def mapping_rectangles(spark, d):
    """Rectangles that suppliers stand for, turned by whole quarters of 3:4:5; every seventh is no rectangle."""
    s = T.table(spark, d, "supplier")
    k = F.col("s_suppkey")
    w, h = (k % 5 + 1).cast("double"), (k % 3 + 1).cast("double")
    ux, uy = F.when(k % 2 == 0, 0.8).otherwise(F.lit(1.0)), F.when(k % 2 == 0, 0.6).otherwise(F.lit(0.0))
    x, y = (k % 40).cast("double"), (k % 23).cast("double")
    bad = F.when(k % 7 == 0, 0.5).otherwise(F.lit(0.0))
    c = [(x, y), (x + ux * w, y + uy * w), (x + ux * w - uy * h + bad, y + uy * w + ux * h), (x - uy * h, y + ux * h)]
    p = s.select(k.cast("int").alias("area_id"), F.explode(F.array(*[F.struct(F.lit(i).alias("seq"), a.alias("x"), b.alias("y"), F.lit(2.0).alias("z")) for i, (a, b) in enumerate(c)])).alias("p")).select("area_id", "p.*")
    return rounded(polygons.mapping_rectangles(p, 1e-6))


SQL["mapping_rectangles"] = f"""WITH t AS (SELECT s_suppkey::INT AS area_id, s_suppkey % 7 = 0 AS bad, (s_suppkey % 40)::DOUBLE AS x, (s_suppkey % 23)::DOUBLE AS y, (s_suppkey % 5 + 1)::DOUBLE AS width, (s_suppkey % 3 + 1)::DOUBLE AS height, CASE WHEN s_suppkey % 2 = 0 THEN degrees(atan2(0.6, 0.8)) ELSE 0 END AS rotation FROM supplier)
  SELECT area_id, {', '.join(f"CASE WHEN NOT bad THEN round({c}, 8) + 0.0 END AS {c}" for c in ('x', 'y', 'width', 'height', 'rotation'))}, CASE WHEN bad THEN 'not square' END AS problem FROM t"""


@query
def t_junctions(spark, d):
    s = _segments(spark, d)
    v = s.select(F.col("x0").alias("x"), F.col("y0").alias("y"))
    return rounded(lines.split_at_vertices(s, v, 0.05, 4.0))


SQL["t_junctions"] = f"""WITH {O.SEG}, sg AS (SELECT sid, ax AS x0, ay AS y0, bx AS x1, by AS y1, sqrt(pow(bx - ax, 2) + pow(by - ay, 2)) AS l FROM s),
  h AS (SELECT *, {O.SEGT} AS t FROM sg, (SELECT ax AS px, ay AS py FROM s) WHERE l > 0), k AS (SELECT DISTINCT sid, t FROM h WHERE t * l > 0.05 AND (1 - t) * l > 0.05 AND {O.SEGDIST} <= 0.05),
  al AS (SELECT * FROM k UNION ALL SELECT sid, 0.0 FROM sg UNION ALL SELECT sid, 1.0 FROM sg), p AS (SELECT sid, t AS a, lead(t) OVER w AS b, (row_number() OVER w - 1)::INT AS part FROM al WINDOW w AS (PARTITION BY sid ORDER BY t))
  SELECT sid, part, {', '.join(r(f'{c}0 + ({c}1 - {c}0) * {t}', f'{c}{i}') for i, t in enumerate('ab') for c in 'xy')} FROM p JOIN sg USING (sid) WHERE b IS NOT NULL"""


# routes


def _even_profile(spark, d) -> DataFrame:
    """A design on stations of its own, every 1.7, the last fifth missing."""
    e = sections.even_stations(_routes(spark, d), 1.7)
    end = e.groupBy("route_id").agg(F.max("station").alias("end"))
    return e.join(end, "route_id").where("station <= 0.8 * end").select("route_id", "station", (2.5 + 0.02 * F.col("station")).alias("z"))


PROFILE = f"""{O.ROUTE}, ln AS (SELECT route_id, max(station) AS len FROM line GROUP BY route_id), nn AS (SELECT route_id, len, greatest(1, ceil(len / 1.7))::INT AS n FROM ln),
pf AS (SELECT route_id, len * i / n AS station, 2.5 + 0.02 * (len * i / n) AS z FROM nn, range(0, 100000) t(i) WHERE i <= n AND len * i / n <= 0.8 * len)"""


@query
def profile_on_path(spark, d):
    p = sections.plan_stations(_routes(spark, d))
    out = sections.with_profile(p, _even_profile(spark, d), 1e-6, 8.0)
    return rounded(out)


SQL["profile_on_path"] = f"""WITH {PROFILE}, en AS (SELECT route_id, min(station) AS lo, max(station) AS hi FROM pf GROUP BY route_id),
  xt AS (SELECT p.route_id, p.station, l.x0 + (l.x1 - l.x0) * (p.station - l.s0) / (l.s1 - l.s0) AS x, l.y0 + (l.y1 - l.y0) * (p.station - l.s0) / (l.s1 - l.s0) AS y, l.z0 + (l.z1 - l.z0) * (p.station - l.s0) / (l.s1 - l.s0) AS z, 1 AS later
    FROM pf p JOIN leg l ON l.route_id = p.route_id AND p.station >= l.s0 AND p.station < l.s1 JOIN ln ON ln.route_id = p.route_id WHERE p.station > 1e-6 AND p.station < len - 1e-6),
  al AS (SELECT route_id, station, x, y, z, 0 AS later FROM line UNION ALL SELECT * FROM xt), kp AS (SELECT *, coalesce(station - lag(station) OVER (PARTITION BY route_id ORDER BY station, later) <= 1e-6, false) AS again FROM al)
  SELECT route_id, {rs('station', 'x', 'y')}, {r('CASE WHEN station BETWEEN lo AND hi THEN 2.5 + 0.02 * station ELSE z END', 'z')}, station BETWEEN lo AND hi AS covered FROM kp JOIN en USING (route_id) WHERE NOT again"""


@query
def compared_profiles(spark, d):
    p = sections.plan_stations(_routes(spark, d)).select("route_id", F.lit(0).alias("part"), "seq", "station", "z")
    q = _even_profile(spark, d).select("route_id", F.lit(0).alias("part"), F.col("station").alias("seq"), "station", "z")
    return rounded(sections.compared(p, q, 1e-9, 8.0))


SQL["compared_profiles"] = f"""WITH {PROFILE}, pr AS (SELECT * FROM (SELECT route_id, station AS a, z AS za, lead(station) OVER w AS b, lead(z) OVER w AS zb FROM pf WINDOW w AS (PARTITION BY route_id ORDER BY station)) WHERE b IS NOT NULL),
  ov AS (SELECT l.route_id, greatest(s0, a) AS s, least(s1, b) AS e, l.s0, l.s1, l.z0, l.z1, a, b, za, zb FROM leg l JOIN pr ON pr.route_id = l.route_id AND a < s1 AND b > s0),
  df AS (SELECT route_id, s, e, z0 + (z1 - z0) * (s - s0) / (s1 - s0) - (za + (zb - za) * (s - a) / (b - a)) AS d0, z0 + (z1 - z0) * (e - s0) / (s1 - s0) - (za + (zb - za) * (e - a) / (b - a)) AS d1 FROM ov WHERE e - s > 1e-9),
  sp AS (SELECT *, s + (e - s) * d0 / (d0 - d1) AS m, d0 * d1 < -1e-18 AS cr FROM df WHERE abs(d0) > 1e-9 OR abs(d1) > 1e-9),
  pt3 AS (SELECT route_id, s, e, d0, d1 FROM sp WHERE NOT cr UNION ALL SELECT route_id, s, m, d0, 0.0 FROM sp WHERE cr UNION ALL SELECT route_id, m, e, 0.0, d1 FROM sp WHERE cr),
  ok AS (SELECT *, d0 + d1 < 0 AS is_cut FROM pt3 WHERE e - s > 1e-9 AND abs(d0 + d1) / 2 > 1e-9),
  mk AS (SELECT *, CASE WHEN lag(is_cut) OVER w = is_cut AND abs(lag(e) OVER w - s) <= 1e-9 AND abs(lag(d1) OVER w - d0) <= 1e-9 THEN 0 ELSE 1 END AS nw FROM ok WINDOW w AS (PARTITION BY route_id ORDER BY s)),
  rg AS (SELECT *, (sum(nw) OVER (PARTITION BY route_id ORDER BY s))::INT AS region FROM mk) SELECT route_id, region, is_cut, {r('min(s)', 's0')}, {r('max(e)', 's1')}, {r('abs(sum((e - s) * (d0 + d1) / 2))', 'area')} FROM rg GROUP BY route_id, region, is_cut"""


def _route_heights(spark, d) -> DataFrame:
    return sections.plan_stations(_routes(spark, d)).withColumn("z", R("z"))


@query
def run_pieces(spark, d):
    return rounded(sections.run_pieces(_route_heights(spark, d), 2.0, 0.45, 2.0, 1.5, 1.0, 2.0, [(1.0, 2.0), (2.0, 5.0), (4.0, 10.0)]))


@query
def run_faces(spark, d):
    s = sections.route_stations(sections.plan_stations(_routes(spark, d)), 1.0, 8.0)
    return rounded(sections.faces_to_stations(mesh(spark, d)[2], s, 0.8))


SQL["run_faces"] = f"""WITH {O.XYZ}, st AS (SELECT x::INT AS route_id, y - min(y) OVER (PARTITION BY x) AS station, x, y FROM v),
  h AS (SELECT fid, route_id, station, (mx - x) * (mx - x) + (my - y) * (my - y) AS q FROM m JOIN st ON abs(mx - x) <= 0.8 AND abs(my - y) <= 0.8),
  b AS (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY q, route_id DESC, station DESC) AS k FROM h WHERE q <= 0.8 * 0.8) SELECT fid, route_id, {r('station')} FROM b WHERE k = 1"""


@query
def route_earthworks(spark, d):
    p = sections.plan_stations(_routes(spark, d).withColumn("z", 2.5 + 0.02 * F.col("y")))
    e = sections.earthworks(p, mesh(spark, d)[2], 4.0, 0.5, 2.0)
    return e.select("route_id", R("cut").alias("cut"), R("fill").alias("fill"), *(F.round(c, 11).alias(c) for c in ("max_cut", "max_fill")))


SQL["route_earthworks"] = f"""WITH {O.V}, lg AS (SELECT a.x::INT AS route_id, a.y, a.z AS za, b.z AS zb FROM v a JOIN v b ON b.x = a.x AND b.y = a.y + 1),
  -- along a column the ground is the height between its two nodes
  sm AS (SELECT route_id, 2.5 + 0.02 * (y + (k + 0.5) / 2) - (za + (zb - za) * (k + 0.5) / 2) AS depth FROM lg, range(2) t(k)), rt AS (SELECT DISTINCT x::INT AS route_id FROM v)
  SELECT route_id, {r('coalesce(sum(greatest(-depth, 0)) * 0.5 * 4, 0)', 'cut')}, {r('coalesce(sum(greatest(depth, 0)) * 0.5 * 4, 0)', 'fill')}, round(coalesce(max(greatest(-depth, 0)), 0), 11) + 0.0 AS max_cut, round(coalesce(max(greatest(depth, 0)), 0), 11) + 0.0 AS max_fill FROM rt LEFT JOIN sm USING (route_id) GROUP BY route_id"""


def _bent_routes(spark, d) -> DataFrame:
    """Columns bent sideways by a parabola of their own."""
    return _routes(spark, d).withColumn("x", F.col("x") + F.col("y") * F.col("y") * 0.01 * (F.col("route_id") % 4))


@query
def route_complexity(spark, d):
    return rounded(sections.complexity(_bent_routes(spark, d), 5.0, 0.5))


@query
def turned_points(spark, d):
    p = _routes(spark, d).withColumn("x", F.col("x") + F.floor(F.col("y") / 5) * 0.5)
    return rounded(curves.turned_points(p, 1e-6))


SQL["turned_points"] = f"""WITH {O.V}, p AS (SELECT x::INT AS route_id, y::INT AS seq, x + floor(y / 5) * 0.5 AS x, y FROM v), q AS (SELECT *, lag(x) OVER w AS xp, lag(y) OVER w AS yp, lead(x) OVER w AS xn, lead(y) OVER w AS yn FROM p WINDOW w AS (PARTITION BY route_id ORDER BY seq))
  SELECT route_id, seq, {rs('x', 'y')} FROM q WHERE xp IS NULL OR xn IS NULL OR abs((x - xp) * (yn - yp) - (y - yp) * (xn - xp)) > 1e-6 * sqrt(pow(xn - xp, 2) + pow(yn - yp, 2))"""


@query
def simplified_lines(spark, d):
    return rounded(curves.simplified(_bent_routes(spark, d), 0.2, 1.0))


@query
def filleted_lines(spark, d):
    """Zigzags whose corners are rounded."""
    z = _routes(spark, d).where("y % 10 = 0").withColumn("x", F.col("x") + F.when(F.col("y") % 20 == 0, 4.0).otherwise(F.lit(0.0)))
    return rounded(curves.filleted(z, 2.0))


@query
def spline_points(spark, d):
    return rounded(curves.spline_points(_routes(spark, d), 3, 9))


@query
def places_along(spark, d):
    return rounded(curves.along(sections.plan_stations(_routes(spark, d)), 2.5, 8.0))


SQL["places_along"] = f"WITH {O.ROUTE}, ln AS (SELECT route_id, any_value(x) AS x, min(y) AS y0, max(station) AS len FROM line GROUP BY route_id HAVING max(station) > 0) SELECT route_id, k::INT AS k, {r('x')}, {r('y0 + k * 2.5', 'y')}, 90.0::DOUBLE AS tangent FROM ln, range(0, 100000) t(k) WHERE k <= floor(len / 2.5 + 1e-9)"


# labels


@query
def elevation_summary(spark, d):
    xyz = mesh(spark, d)[2]
    z, w = (F.col("az") + F.col("bz") + F.col("cz")) / 3, G.plan_area()
    return rounded(xyz.agg(F.min(F.least("az", "bz", "cz")).alias("min_z"), F.max(F.greatest("az", "bz", "cz")).alias("max_z"), (F.sum(z * w) / F.sum(w)).alias("mean_z"), F.sum(w).alias("plan_area")))


SQL["elevation_summary"] = f"WITH {O.XYZ} SELECT {r('min(least(az, bz, cz))', 'min_z')}, {r('max(greatest(az, bz, cz))', 'max_z')}, {r('sum(mz * plan_area) / sum(plan_area)', 'mean_z')}, {r('sum(plan_area)', 'plan_area')} FROM m"

_AT = f"""{O.XYZ}, {O.POINTS}, hit AS (SELECT pid, x AS px, y AS py, m.* FROM pt JOIN m ON x BETWEEN least(ax, bx, cx) AND greatest(ax, bx, cx) AND y BETWEEN least(ay, by, cy) AND greatest(ay, by, cy)),
  o AS (SELECT *, {O.orient('a', 'b', 'p')} AS d1, {O.orient('b', 'c', 'p')} AS d2, {O.orient('c', 'a', 'p')} AS d3, {O.orient('a', 'b', 'c')} AS w FROM hit),
  hh AS (SELECT *, (d2 * az + d3 * bz + (w - d2 - d3) * cz) / w AS z FROM o WHERE NOT ((d1 < 0 OR d2 < 0 OR d3 < 0) AND (d1 > 0 OR d2 > 0 OR d3 > 0)))"""


@query
def projected_heights(spark, d):
    return labels.slopes_at(_points(spark, d), mesh(spark, d)[2], 2.0).select("pid", F.round("z", 11).alias("z"))


SQL["projected_heights"] = f"WITH {_AT} SELECT pid, round(max(hh.z), 11) AS z FROM pt LEFT JOIN hh USING (pid) GROUP BY pid"


def _off_lattice(spark, d) -> DataFrame:
    """Points inside faces, never on an edge."""
    return T.lattice_vertices(spark, d).select(F.col("vid").alias("pid"), (F.col("x") + 0.21).alias("x"), (F.col("y") + 0.37).alias("y"))


_OFF = f"""{O.XYZ}, pz AS (SELECT m.*, a AS pid, 0.21::DOUBLE AS u, 0.37::DOUBLE AS w FROM m WHERE fid % 2 = 0)"""


@query
def point_slopes(spark, d):
    s = labels.slopes_at(_off_lattice(spark, d), mesh(spark, d)[2], 2.0).where("z is not null")
    return s.select("pid", F.round("z", 11).alias("z"), R("slope").alias("slope"))


SQL["point_slopes"] = f"WITH {_OFF} SELECT pid, round(az + u * (bz - az) + w * (cz - az), 11) AS z, {r('slope')} FROM pz"


@query
def slope_arrows(spark, d):
    a = labels.slope_arrows(mesh(spark, d)[2].withColumns({f"{c}{k}": F.col(f"{c}{k}") - v for c in "abc" for k, v in (("x", 0.21), ("y", 0.37))}), 1.0, 2.0)
    return rounded(a.select("col", "row", "bearing", "slope"))


SQL["slope_arrows"] = f"WITH {O.XYZ}, {O.BEARING} SELECT m.ax::BIGINT AS col, m.ay::BIGINT AS row, {r('bearing')}, {r('slope')} FROM m JOIN bearing USING (fid) WHERE fid % 2 = 0 AND bearing IS NOT NULL"


@query
def grade_callouts(spark, d):
    s = F.col("s_suppkey")
    p = T.table(spark, d, "supplier").select(s.alias("pid"), (s * 17 % 45).cast("double").alias("x0"), (s * 29 % 25).cast("double").alias("y0"), (s * 7 % 45).cast("double").alias("x1"), (s * 11 % 25).cast("double").alias("y1"))
    return rounded(labels.grade_callouts(p, mesh(spark, d)[2], 2.0))


SQL["grade_callouts"] = f"""WITH {O.FACES}, uv AS (SELECT DISTINCT unnest([a, b, c]) AS vid FROM f), vz AS (SELECT x, y, z FROM v JOIN uv USING (vid)), p AS (SELECT s_suppkey AS pid, (s_suppkey * 17 % 45)::DOUBLE AS x0, (s_suppkey * 29 % 25)::DOUBLE AS y0, (s_suppkey * 7 % 45)::DOUBLE AS x1, (s_suppkey * 11 % 25)::DOUBLE AS y1 FROM supplier),
  j AS (SELECT pid, a.z AS z0, b.z AS z1, sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) AS length FROM p LEFT JOIN vz a ON a.x = x0 AND a.y = y0 LEFT JOIN vz b ON b.x = x1 AND b.y = y1) SELECT pid, {rs('z0', 'z1', 'length')}, round(CASE WHEN length > 0 THEN (z1 - z0) / length END, 8) + 0.0 AS grade FROM j"""


@query
def curve_labels(spark, d):
    c = labels.curve_labels(sections.plan_stations(_routes(spark, d).where("x > 0 and x < 49")), mesh(spark, d)[2], 1.0, 4.0)
    return rounded(c.select("route_id", "seq", "station", "z", "grade"))


SQL["curve_labels"] = f"""WITH {O.ROUTE}, q AS (SELECT * FROM line WHERE x > 0 AND x < 49) SELECT route_id, (row_number() OVER w)::INT AS seq, {rs('station', 'z')}, round(lead(z) OVER w - z, 8) + 0.0 AS grade FROM q WINDOW w AS (PARTITION BY route_id ORDER BY station)"""


@query
def cross_sections(spark, d):
    p = sections.plan_stations(_routes(spark, d))
    return rounded(labels.cross_sections(p, mesh(spark, d)[2], 4.0, 3.0, 1.0, 4.0).select("route_id", "seq", "offset", "x", "y"))


SQL["cross_sections"] = f"""WITH {O.ROUTE}, ln AS (SELECT route_id, any_value(x) AS x, min(y) AS y0, max(station) AS len FROM line GROUP BY route_id), nn AS (SELECT *, greatest(1, ceil(len / 4))::INT AS n FROM ln)
  SELECT route_id, (i + 1)::INT AS seq, {r('k::DOUBLE', '"offset"')}, {r('x + k', 'x')}, {r('y0 + len * i / n', 'y')} FROM nn, range(0, 100000) t(i), range(-3, 4) s(k) WHERE i <= n"""


_LENGTH = ((47.1 - 1.3) ** 2 + (21.9 - 0.7) ** 2) ** 0.5
_U = f"{(47.1 - 1.3) / _LENGTH!r}::DOUBLE", f"{(21.9 - 0.7) / _LENGTH!r}::DOUBLE"
_AT_SIDE = lambda k: f"(({k}y - 0.7::DOUBLE) * {_U[0]} - ({k}x - 1.3::DOUBLE) * {_U[1]}) AS d{k}, (({k}x - 1.3::DOUBLE) * {_U[0]} + ({k}y - 0.7::DOUBLE) * {_U[1]}) AS s{k}"


def _cut(p: str, q: str) -> str:
    t = f"(d{p} / (d{p} - d{q}))"
    return f"CASE WHEN (d{p} >= 0) != (d{q} >= 0) THEN [s{p} + (s{q} - s{p}) * {t}, {p}z + ({q}z - {p}z) * {t}] END"


SQL["section_slice"] = f"""WITH {O.XYZ}, sd AS (SELECT fid, az, bz, cz, {', '.join(map(_AT_SIDE, 'abc'))} FROM m), ps AS (SELECT fid, list_sort(list_filter([{_cut('a', 'b')}, {_cut('b', 'c')}, {_cut('c', 'a')}], lambda p: p IS NOT NULL)) AS p FROM sd)
  SELECT fid, {r('p[1][1]', 's0')}, {r('p[1][2]', 'z0')}, {r('p[2][1]', 's1')}, {r('p[2][2]', 'z1')} FROM ps WHERE len(p) = 2 AND p[2][1] >= 0 AND p[1][1] <= {_LENGTH!r}::DOUBLE"""


@query
def lowest_points(spark, d):
    s = F.col("s_suppkey")
    x, y, z = (s * 17 % 40).cast("double"), (s * 29 % 20).cast("double"), 10 + s % 4
    o = T.table(spark, d, "supplier").select(s.alias("shape"), F.explode(F.array(*[F.struct(F.lit(i).alias("pid"), (x + a).alias("x"), (y + b).alias("y"), (z + 0.1 * i).cast("double").alias("z")) for i, (a, b) in enumerate(((0, 0), (2, 0), (2, 2), (0, 2)))])).alias("p")).select("shape", "p.*")
    return rounded(labels.lowest_points(o, mesh(spark, d)[2], 2.0))


SQL["lowest_points"] = f"""WITH {O.FACES}, uv AS (SELECT DISTINCT unnest([a, b, c]) AS vid FROM f), vz AS (SELECT x, y, z FROM v JOIN uv USING (vid)),
  c AS (SELECT s_suppkey AS shape, i::INT AS pid, (s_suppkey * 17 % 40 + [0, 2, 2, 0][i + 1])::DOUBLE AS x, (s_suppkey * 29 % 20 + [0, 0, 2, 2][i + 1])::DOUBLE AS y, 10 + s_suppkey % 4 + 0.1::DOUBLE * i AS z FROM supplier, range(4) t(i)),
  h AS (SELECT shape, pid, c.z - vz.z AS g, row_number() OVER (PARTITION BY shape ORDER BY c.z - vz.z, pid) AS k FROM c JOIN vz ON vz.x = c.x AND vz.y = c.y) SELECT shape, pid, {r('g', 'drop')} FROM h WHERE k = 1"""


@query
def surface_frames(spark, d):
    f = labels.frames_at(_off_lattice(spark, d), mesh(spark, d)[2], 2.0)
    return rounded(f.select("pid", "nx", "ny", "nz", "ux", "uz", "vy"))


SQL["surface_frames"] = f"""WITH {_OFF}, q AS (SELECT pid, nx / l AS nx, ny / l AS ny, nz / l AS nz FROM (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS l FROM pz)), s AS (SELECT *, sqrt(1 + (nx / nz) * (nx / nz)) AS g FROM q)
  SELECT pid, {rs('nx', 'ny', 'nz')}, {r('1 / g', 'ux')}, {r('-nx / nz / g', 'uz')}, {r('nz / g - nx * (-nx / nz / g)', 'vy')} FROM s"""


# rasters and fields


@query
def cloud_cell_size(spark, d):
    return rounded(spark.createDataFrame([(rasters.cell_size(T.cloud(spark, d)),)], "cell double"))


SQL["cloud_cell_size"] = f"WITH c AS (SELECT (l_partkey % 50) + l_discount * 9 AS x, (l_suppkey % 40) + l_tax * 11 AS y FROM lineitem) SELECT {r('sqrt((max(x) - min(x)) * (max(y) - min(y)) * 4 / count(*))', 'cell')} FROM c"


@query
def mesh_raster(spark, d):
    g = rasters.mesh_rasterized(mesh(spark, d)[2], 0.5, 0.25, 0.3)
    return g.select("col", "row", "n", F.round("top", 11).alias("top"), F.round("low", 11).alias("low"))


SQL["mesh_raster"] = f"""WITH {O.XYZ}, nd AS (SELECT m.*, i::BIGINT AS col, j::BIGINT AS row, 0.25 + 0.5 * i AS px, 0.3 + 0.5 * j AS py FROM m, range(0, 100) s(i), range(0, 4) q(k), (SELECT 0) z, LATERAL (SELECT (ceil((ay - 1.3) * 2)::BIGINT + k) AS j) WHERE 0.25 + 0.5 * i BETWEEN least(ax, bx, cx) - 1e-9 AND greatest(ax, bx, cx) + 1e-9 AND j >= 0 AND 0.3 + 0.5 * j BETWEEN least(ay, by, cy) - 1e-9 AND greatest(ay, by, cy) + 1e-9),
  w AS (SELECT *, {O.orient('a', 'b', 'c')} AS t, {O.orient('b', 'c', 'p')} AS p1, {O.orient('c', 'a', 'p')} AS p2 FROM nd), b AS (SELECT *, p1 / t AS wa, p2 / t AS wb, 1 - p1 / t - p2 / t AS wc FROM w), hz AS (SELECT col, row, wa * az + wb * bz + wc * cz AS z FROM b WHERE wa >= -1e-9 AND wb >= -1e-9 AND wc >= -1e-9)
  SELECT col, row, count(*) AS n, round(max(z), 11) AS top, round(min(z), 11) AS low FROM hz GROUP BY col, row"""


@query
def disc_opened(spark, d):
    g = _grid(spark, d)
    return rasters.disc_opened(g.where("v >= 38").select("col", "row"), g.select("col", "row"), 1.5)


SQL["disc_opened"] = f"""WITH {O.GRID}, mk AS (SELECT col, row FROM grid WHERE v >= 38), ou AS (SELECT col, row FROM grid WHERE v < 38),
  co AS (SELECT g.col, g.row FROM grid g WHERE NOT EXISTS (SELECT 1 FROM ou WHERE (ou.col - g.col) * (ou.col - g.col) + (ou.row - g.row) * (ou.row - g.row) <= 2.25)) SELECT col, row FROM mk WHERE EXISTS (SELECT 1 FROM co WHERE (co.col - mk.col) * (co.col - mk.col) + (co.row - mk.row) * (co.row - mk.row) <= 2.25)"""


@query
def ground_mesh(spark, d):
    v, f = rasters.ground_mesh(_grid(spark, d), 3)
    use = f.select(F.explode(F.array("a", "b", "c")).alias("vid")).groupBy("vid").agg(F.count("*").alias("n_faces"))
    return rounded(v.join(use, "vid", "left").select("vid", "x", "y", "z", F.coalesce("n_faces", F.lit(0)).alias("n_faces")))


SQL["ground_mesh"] = f"""WITH {O.GRID}, sz AS (SELECT max(col) AS mc, max(row) AS mr, max(col) // 3 + 1 AS w FROM grid), ce AS (SELECT col AS c, row AS r, least(1, col, mc - col) AS rx, least(1, row, mr - row) AS ry, w FROM grid, sz WHERE col % 3 = 0 AND row % 3 = 0),
  ve AS (SELECT (r // 3) * w + c // 3 AS vid, c::DOUBLE AS x, r::DOUBLE AS y, w, c // 3 AS i, avg(v) AS z FROM ce JOIN grid g ON g.col BETWEEN c - rx AND c + rx AND g.row BETWEEN r - ry AND r + ry GROUP BY c, r, w),
  cl2 AS (SELECT a.vid, a.w FROM ve a JOIN ve b ON b.vid = a.vid + 1 JOIN ve p ON p.vid = a.vid + a.w JOIN ve q ON q.vid = a.vid + a.w + 1 WHERE a.i < a.w - 1),
  us AS (SELECT k AS vid, count(*) AS n FROM (SELECT unnest([vid, vid + 1, vid + w, vid + 1, vid + w + 1, vid + w]) AS k FROM cl2) GROUP BY k) SELECT vid, {rs('x', 'y', 'z')}, coalesce(n, 0) AS n_faces FROM ve LEFT JOIN us USING (vid)"""


@query
def mask_outlines(spark, d):
    """Outlines of a mask's parts: their sides, and the area that they enclose, which is that of the part."""
    o = rasters.mask_outlines(_grid(spark, d).where("v < 47").select("col", "row"))
    e = spatial.ring_edges(o.select(F.col("label").alias("area_id"), F.col("loop").alias("ring_id"), "seq", "x", "y"))
    return rounded(e.groupBy(F.col("area_id").alias("label")).agg(F.count("*").alias("n_sides"), (F.sum(G.cross("x0", "y0", "x1", "y1")) / 2).alias("area")))


SQL["mask_outlines"] = f"""WITH RECURSIVE {O.GRID}, mask AS (SELECT col, row, row * 100000 + col AS id FROM grid WHERE v < 47), lk AS (SELECT a.id AS a, b.id AS b FROM mask a JOIN mask b ON abs(a.col - b.col) + abs(a.row - b.row) = 1),
  reach AS (SELECT id AS a, id AS b FROM mask UNION SELECT r.a, l.b FROM reach r JOIN lk l ON r.b = l.a), lab AS (SELECT a AS id, min(b) AS k FROM reach GROUP BY a), dg AS (SELECT a AS id, count(*) AS n FROM lk GROUP BY a)
  SELECT (k // 100000) || ':' || (k % 100000) AS label, sum(4 - coalesce(n, 0))::BIGINT AS n_sides, {r('count(*)::DOUBLE', 'area')} FROM lab LEFT JOIN dg USING (id) GROUP BY k"""


def _field(spark, d) -> DataFrame:
    """Heights of the lattice as samples, in tiles and out of them again."""
    s = T.lattice_vertices(spark, d).select(F.col("x").cast("long").alias("gi"), F.col("y").cast("long").alias("gj"), F.col("z").alias("value"))
    return fields.samples(fields.tiles(s))


@query
def field_tiles(spark, d):
    return _field(spark, d).select("gi", "gj", F.round(F.col("value").cast("double"), 8).alias("value"))


SQL["field_tiles"] = f"WITH {O.V} SELECT x::BIGINT AS gi, y::BIGINT AS gj, round(z::FLOAT::DOUBLE, 8) AS value FROM v WHERE z::FLOAT != 0"


@query
def field_samples(spark, d):
    return rounded(fields.sampled(_field(spark, d), _points(spark, d), 1.0))


SQL["field_samples"] = f"""WITH {O.V}, {O.POINTS}, f4 AS (SELECT x, y, z::FLOAT::DOUBLE AS z FROM v), c AS (SELECT pid, floor(x) + i AS gi, floor(y) + j AS gj, (CASE i WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) * (CASE j WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) AS k FROM pt, range(2) s(i), range(2) t(j))
  SELECT pid, {r('coalesce(sum(k * z), 0)', 'v')} FROM c LEFT JOIN f4 ON f4.x = gi AND f4.y = gj GROUP BY pid"""


@query
def field_resampled(spark, d):
    s = fields.resampled(_field(spark, d), 1.0, 2.0)
    return s.select("gi", "gj", F.round(F.col("value").cast("double"), 8).alias("value"))


SQL["field_resampled"] = f"WITH {O.V} SELECT (x / 2)::BIGINT AS gi, (y / 2)::BIGINT AS gj, round(z::FLOAT::DOUBLE, 8) AS value FROM v WHERE x % 2 = 0 AND y % 2 = 0 AND z::FLOAT != 0"


@query
def image_samples(spark, d):
    g = T.lattice_vertices(spark, d).where("x < 8 and y < 5").select(F.col("x").cast("long").alias("col"), F.col("y").cast("long").alias("row"), F.col("z").alias("v"))
    p = _points(spark, d).select("pid", (F.col("x") / 25 - 0.5).alias("s"), (F.col("y") / 20 - 0.2).alias("t"))
    one, two = (fields.image_sampled(g, p, 8, 5, again) for again in (False, True))
    return rounded(one.withColumnRenamed("v", "clamped").join(two.withColumnRenamed("v", "repeated"), "pid"))


SQL["image_samples"] = f"""WITH {O.V}, {O.POINTS}, q AS (SELECT pid, (x / 25 - 0.5) * 8 - 0.5 AS u, (1 - (y / 20 - 0.2)) * 5 - 0.5 AS w FROM pt),
  c AS (SELECT pid, floor(u)::BIGINT + i AS ci, floor(w)::BIGINT + j AS ri, (CASE i WHEN 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END) * (CASE j WHEN 1 THEN w - floor(w) ELSE 1 - (w - floor(w)) END) AS k FROM q, range(2) s(i), range(2) t(j))
  SELECT pid, {r('sum(k * a.z)', 'clamped')}, {r('sum(k * b.z)', 'repeated')} FROM c JOIN v a ON a.x = least(greatest(ci, 0), 7) AND a.y = least(greatest(ri, 0), 4) JOIN v b ON b.x = ((ci % 8) + 8) % 8 AND b.y = ((ri % 5) + 5) % 5 GROUP BY pid"""


@query
def dem_points(spark, d):
    g = _grid(spark, d)
    return rounded(files.on_rectangle(g, 60, 52, 100.0, 200.0, 120.0, 104.0, 5.0, 0.1))


SQL["dem_points"] = f"WITH {O.GRID} SELECT col, row, {r('100 + (col + 0.5) / 60 * 120', 'x')}, {r('200 + (1 - (row + 0.5) / 52) * 104', 'y')}, {r('5 + v * 0.1', 'z')} FROM grid"


@query
def landform_areas(spark, d):
    c = rounded(surfaces.curvatures(surfaces.derivatives(T.lattice_vertices(spark, d))))
    a = surfaces.landform_areas(mesh(spark, d)[2], c, 0.25, 2.0)
    return rounded(a.select(F.coalesce("landform", F.lit("total")).alias("landform"), "n_faces", "plan_area"))


SQL["landform_areas"] = f"""WITH {O.CURV}, {O.XYZ.split('v AS')[0]}cell AS (SELECT vid FROM v WHERE vid % 50 < 49 AND vid + 50 IN (SELECT vid FROM v)), ff AS (SELECT 2 * vid AS fid, vid AS a, vid + 1 AS b, vid + 50 AS c FROM cell UNION ALL SELECT 2 * vid + 1, vid + 1, vid + 51, vid + 50 FROM cell),
  h AS (SELECT fid, (round(p.mean, 8) + round(q.mean, 8) + round(s.mean, 8)) / 3 AS h FROM ff LEFT JOIN cu p ON p.vid = a LEFT JOIN cu q ON q.vid = b LEFT JOIN cu s ON s.vid = c), k AS (SELECT CASE WHEN h IS NULL THEN 'unmeasured' WHEN h > 0.5 THEN 'convex' WHEN h < -0.5 THEN 'concave' ELSE 'planar' END AS landform FROM h)
  SELECT coalesce(landform, 'total') AS landform, count(*) AS n_faces, {r('count(*) * 0.5::DOUBLE', 'plan_area')} FROM k GROUP BY ROLLUP (landform)"""


@query
def smoothing_violations(spark, d):
    """Heights doubled are beyond their neighbours' range, or moved though held."""
    v, f, _ = mesh(spark, d)
    held = topology.boundary_vertices(f).select("vid")
    after = v.withColumn("z", F.when(F.col("vid") % 10 == 0, F.col("z") * 2).otherwise(F.col("z")))
    return rounded(surfaces.smoothing_violations(v, after, topology.vertex_neighbours(f), held, 1, 1e-6))


SQL["smoothing_violations"] = f"""WITH {O.FACES}, {O.HALF}, nb AS (SELECT u AS vid, v AS nid FROM edges UNION SELECT v, u FROM edges UNION SELECT u, u FROM edges UNION SELECT v, v FROM edges), held AS (SELECT DISTINCT unnest([u, v]) AS vid FROM edges WHERE n_faces = 1),
  rg AS (SELECT nb.vid, min(z) AS lo, max(z) AS hi FROM nb JOIN v ON v.vid = nb.nid GROUP BY nb.vid), j AS (SELECT v.vid, z AS z0, CASE WHEN v.vid % 10 = 0 THEN z * 2 ELSE z END AS z1, coalesce(lo, z) AS lo, coalesce(hi, z) AS hi, held.vid IS NOT NULL AS h FROM v LEFT JOIN rg USING (vid) LEFT JOIN held USING (vid)),
  k AS (SELECT vid, CASE WHEN h AND abs(z1 - z0) > 1e-6 THEN 'held' WHEN NOT h AND greatest(z1 - hi, lo - z1) > 1e-6 THEN 'extreme' END AS kind, CASE WHEN h THEN abs(z1 - z0) ELSE greatest(z1 - hi, lo - z1) END AS amount FROM j) SELECT vid, kind, {r('amount')} FROM k WHERE kind IS NOT NULL"""


@query
def contours_updated(spark, d):
    """Contours after every eleventh vertex was lowered, traced again only where it matters."""
    v, f, xyz = mesh(spark, d)
    low = v.withColumn("z", F.when(F.col("vid") % 11 == 0, F.col("z") * 0.5).otherwise(F.col("z")))
    return rounded(surfaces.contours_updated(surfaces.contour_segments(xyz, _levels(spark)), faces.gather(f, low), v.where("vid % 11 = 0"), _levels(spark)))


_LOWERED = O.XYZ.replace("o_totalprice / 100000 AS z FROM orders", "CASE WHEN o_orderkey % 11 = 0 THEN o_totalprice / 100000 * 0.5 ELSE o_totalprice / 100000 END AS z FROM orders")
SQL["contours_updated"] = f"WITH {_LOWERED}, {O.contours('m', O.LEVELS, 'az', 'bz', 'cz')} SELECT fid, {rs('level', 'x0', 'y0', 'x1', 'y1')} FROM con"


@query
def daylight_reach(spark, d):
    """Batters from every lattice node's middle, rising or falling to a level plane's surface."""
    v = T.lattice_vertices(spark, d).select("vid", "x", "y", F.lit(0.0).alias("z"))
    f = T.lattice_faces(v)
    rr = v.select(F.col("vid").alias("ray"), (F.col("x") + 0.3).alias("x"), (F.col("y") + 0.4).alias("y"), (F.col("vid") % 5 - 2.5).alias("z"), F.lit(0.6).alias("dx"), F.lit(0.8).alias("dy"), F.lit(0.5).alias("slope"), F.when(F.col("vid") % 5 < 3, 1).otherwise(-1).alias("branch"), F.lit(4.5).alias("max_reach"))
    return rounded(rays.daylight(rr, faces.gather(f, v), 2.0))


SQL["daylight_reach"] = f"WITH {O.V}, c AS (SELECT x, y FROM v WHERE vid % 50 < 49 AND vid + 50 IN (SELECT vid FROM v)), q AS (SELECT vid AS ray, abs(vid % 5 - 2.5) / 0.5 AS reach, floor(x + 0.3 + 0.6 * abs(vid % 5 - 2.5) / 0.5) AS tx, floor(y + 0.4 + 0.8 * abs(vid % 5 - 2.5) / 0.5) AS ty FROM v) SELECT ray, round(CASE WHEN reach <= 4.5 AND c.x IS NOT NULL THEN reach END, 8) + 0.0 AS reach FROM q LEFT JOIN c ON c.x = tx AND c.y = ty"


@query
def line_of_sight(spark, d):
    """What vertical lines through the surface meet."""
    p = _off_lattice(spark, d)
    h = rays.first_hits(p.select(F.col("pid").alias("ray"), "x", "y", F.lit(100.0).alias("z"), F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(-200.0).alias("dz")), mesh(spark, d)[2], 2.0)
    return h.select("ray", "fid", F.round("z", 9).alias("z"))


SQL["line_of_sight"] = f"WITH {_OFF} SELECT pid AS ray, fid, round(az + u * (bz - az) + w * (cz - az), 9) AS z FROM pz"


# meshes made sound


@query
def normalized_mesh(spark, d):
    """The mesh with every seventh vertex once more, in places that 32 bits do not tell apart."""
    v, f, _ = mesh(spark, d)
    twin = v.where("vid % 7 = 0").select((F.col("vid") + 100_000_000).alias("vid"), (F.col("x") + 1e-9).alias("x"), "y", "z")
    f2 = f.withColumn("a", F.when(F.col("a") % 7 == 0, F.col("a") + 100_000_000).otherwise(F.col("a")))
    _, out = cleanup.normalized(v.unionByName(twin), f2)
    return out


SQL["normalized_mesh"] = f"WITH {O.FACES}, k AS (SELECT vid, CASE WHEN vid % 7 = 0 AND (x + 1e-9)::FLOAT = x::FLOAT THEN vid + 100000000 ELSE vid END AS keep, CASE WHEN vid % 7 = 0 THEN vid + 100000000 ELSE vid END AS own FROM v) SELECT fid, p.own AS a, q.keep AS b, s.keep AS c FROM f JOIN k p ON p.vid = a JOIN k q ON q.vid = b JOIN k s ON s.vid = c"


@query
def merged_meshes(spark, d):
    """Two halves of the mesh that share a column of vertices, put together: as many vertices and edges as before."""
    v, f, _ = mesh(spark, d)
    left, right = (f.where(f"a % 50 {s} 25").where(f"c % 50 {s} 25 or c % 50 = 25") for s in ("<", ">="))
    part = lambda g: (v.join(g.select(F.explode(F.array("a", "b", "c")).alias("vid")).distinct(), "vid", "left_semi"), g)
    mv, mf = cleanup.merged([part(left), part(right)], 1e-3)
    e = topology.edges(mf)
    return mv.agg(F.count("*").alias("n_vertices")).join(mf.agg(F.count("*").alias("n_faces")), how="cross").join(e.agg(F.count("*").alias("n_edges"), F.count_if(F.col("n_faces") == 1).alias("n_naked")), how="cross")


SQL["merged_meshes"] = f"""WITH {O.FACES.replace('f AS (', 'f0 AS (')}, f AS (SELECT * FROM f0 WHERE (a % 50 < 25 AND (c % 50 < 25 OR c % 50 = 25)) OR (a % 50 >= 25 AND (c % 50 >= 25))), {O.HALF}
  SELECT (SELECT count(DISTINCT k) FROM (SELECT unnest([a, b, c]) AS k FROM f)) AS n_vertices, (SELECT count(*) FROM f) AS n_faces, count(*) AS n_edges, count(*) FILTER (n_faces = 1) AS n_naked FROM edges"""


# survey


@query
def ruled_codes(spark, d):
    """Points by role and layer of the standing rules, their own codes standing in for these."""
    p = survey.parse_codes(survey.parse_points(survey_lines(spark, d)).where("problem is null"))
    code = F.element_at(F.array(*map(F.lit, ["ep", "BDY", "gnd", "none"])), (F.col("line_number") % 4 + 1).cast("int"))
    return survey.ruled(p.withColumn("code", F.upper(code)), survey.code_rules(spark)).groupBy("code", "role", "layer", "closed_by_rule").agg(F.count("*").alias("n"))


SQL["ruled_codes"] = f"""WITH {O.EVENTS}, c AS (SELECT ['EP', 'BDY', 'GND', 'NONE'][line_number % 4 + 1] AS code FROM tok)
  SELECT code, CASE code WHEN 'EP' THEN 'breakline' WHEN 'BDY' THEN 'boundary' WHEN 'GND' THEN 'spot' END AS role, CASE code WHEN 'EP' THEN 'Breaklines' WHEN 'BDY' THEN 'Boundary' WHEN 'GND' THEN 'Spots' END AS layer, CASE code WHEN 'EP' THEN false WHEN 'BDY' THEN true WHEN 'GND' THEN false END AS closed_by_rule, count(*) AS n FROM c GROUP BY code"""


@query
def layer_paths(spark, d):
    n = T.table(spark, d, "nation")
    k = F.col("n_nationkey")
    t = F.when(k % 5 == 0, F.concat(F.lit("Site::"), F.col("n_name"))).when(k % 5 == 1, F.concat(F.lit(" "), F.col("n_name"))).when(k % 5 == 2, F.lit("A::::B")).when(k % 5 == 3, F.lit("A:B")).otherwise(F.col("n_name"))
    return n.select(k.alias("id"), survey.valid_layer_path(t).alias("valid"))


SQL["layer_paths"] = "SELECT n_nationkey AS id, n_nationkey % 5 IN (0, 4) AS valid FROM nation"


@query
def figure_pieces(spark, d):
    p = survey.parse_codes(survey.parse_points(survey_lines(spark, d)).where("problem is null"))
    return rounded(survey.figure_pieces(survey.figures(p.withColumn("arc", F.col("line_number") % 6 == 0))))


SQL = {k: re.sub(r'(?<!")\bby\b(?!")', '"by"', v) for k, v in SQL.items()}
