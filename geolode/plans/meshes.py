"""Queries on triangulation, overlay and drainage, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolode.functions import geometry as G
from geolode.operators import drainage, faces, graphs, overlay, spatial, surfaces, tin, topology
from geolode.plans import oracles as O
from geolode.plans.lineage import materialized, shuffled_joins
from geolode.plans.oracles import r, rs
from geolode.plans.queries import R, _points, _ring_edges, mesh, query, rounded
from geolode.sources import tables as T

SQL: dict[str, str] = {}


# overlay


def _plane(spark, d) -> DataFrame:
    """A sloping plane in cells of seven, wider than the lattice."""
    top = T.lattice_vertices(spark, d).agg(F.max("y").alias("h"))
    n = top.select(F.explode(F.sequence(F.lit(0), F.floor(F.col("h") / 7 + 2).cast("int"))).alias("j")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(8))))
    v = n.select((F.col("j") * 9 + F.col("i")).cast("long").alias("vid"), (F.col("i") * 7 - 0.3).alias("x"), (F.col("j") * 7 - 0.4).alias("y")).withColumn("z", 2.5 + 0.01 * F.col("x") + 0.002 * F.col("y"))
    return faces.gather(T.lattice_faces(v, 9), v)


PLANE = "ref AS (SELECT vid, 2.5 + 0.01 * x + 0.002 * y AS z FROM v)"


@query
def overlay_cut_fill(spark, d):
    p = overlay.pieces(mesh(spark, d)[2], _plane(spark, d), 7.0)
    return rounded(overlay.volumes(p, "fid").drop("net"))


SQL["overlay_cut_fill"] = f"WITH {O.DIFF.replace(O.REF, PLANE)} SELECT fid, {r('plan_area', 'area')}, {rs('cut', 'fill')} FROM vol"


@query
def surface_deviation(spark, d):
    v = overlay.deviation(mesh(spark, d)[2], _plane(spark, d), 7.0)
    return v.select(R("max_gap").alias("max_gap"), F.round("shared_area", 6).alias("shared_area"), F.round("area", 6).alias("area"), "same_ground")


SQL["surface_deviation"] = f"WITH {O.DIFF.replace(O.REF, PLANE)} SELECT {r('max(greatest(abs(da), abs(db), abs(dc)))', 'max_gap')}, round(sum(plan_area), 6) AS shared_area, round(sum(plan_area), 6) AS area, false AS same_ground FROM d"


# triangulation


def _scattered(spark, d) -> DataFrame:
    """Customers as survey points, off any regular pattern."""
    c = T.table(spark, d, "customer")
    k = F.col("c_custkey")
    return c.select(k.alias("pid"), ((k * 37) % 4999 / 100 + F.col("c_acctbal") / 50000).alias("x"), ((k * 53) % 2903 / 100 + F.col("c_acctbal") / 70000).alias("y"), (F.col("c_acctbal") / 1000).alias("z"))


def _radius(spark, d) -> float:
    """Greatest circle, by how densely the points lie."""
    n = T.table(spark, d, "customer").count()
    return 2.0 * (1500 / max(n, 1)) ** 0.5


@query
def tin_faces(spark, d):
    return tin.triangulated(_scattered(spark, d), _radius(spark, d))


#: Every triple of points near one another whose circle is small enough and holds no other point, counter-clockwise from its least id.
SQL["tin_faces"] = """WITH p AS (SELECT c_custkey AS pid, ((c_custkey * 37) % 4999) / 100 + c_acctbal / 50000 AS x, ((c_custkey * 53) % 2903) / 100 + c_acctbal / 70000 AS y FROM customer),
  rr AS (SELECT 2.0 * sqrt(1500 / greatest(count(*), 1)) AS rad FROM p),
  g AS (SELECT *, floor(x / (2 * rad))::INT AS gx, floor(y / (2 * rad))::INT AS gy FROM p, rr),
  n AS (SELECT a.pid AS a, b.pid AS b, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by, a.rad FROM g a JOIN (SELECT * FROM g, range(-1, 2) i(i), range(-1, 2) j(j)) b ON b.gx + i = a.gx AND b.gy + j = a.gy AND a.pid < b.pid AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 4 * a.rad * a.rad),
  t AS (SELECT u.a, u.b, w.b AS c, u.ax, u.ay, u.bx - u.ax AS px, u.by - u.ay AS py, w.bx - u.ax AS qx, w.by - u.ay AS qy, u.rad FROM n u JOIN n w ON u.a = w.a AND u.b < w.b WHERE pow(u.bx - w.bx, 2) + pow(u.by - w.by, 2) <= 4 * u.rad * u.rad),
  k AS (SELECT *, 2 * (px * qy - py * qx) AS den FROM t WHERE px * qy - py * qx != 0),
  o AS (SELECT a, b, c, den, rad, ax + (qy * (px * px + py * py) - py * (qx * qx + qy * qy)) / den AS cx, ay + (px * (qx * qx + qy * qy) - qx * (px * px + py * py)) / den AS cy, (pow(qy * (px * px + py * py) - py * (qx * qx + qy * qy), 2) + pow(px * (qx * qx + qy * qy) - qx * (px * px + py * py), 2)) / (den * den) AS r2 FROM k),
  s AS (SELECT *, floor(cx / (2 * rad))::INT AS gx, floor(cy / (2 * rad))::INT AS gy FROM o WHERE r2 <= rad * rad),
  e AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM (SELECT *, gx + i AS hx, gy + j AS hy FROM g, range(-1, 2) i(i), range(-1, 2) j(j)) q WHERE q.hx = s.gx AND q.hy = s.gy AND q.pid NOT IN (s.a, s.b, s.c) AND pow(q.x - s.cx, 2) + pow(q.y - s.cy, 2) < s.r2 * (1 - 1e-12)))
  SELECT a, CASE WHEN den > 0 THEN b ELSE c END AS b, CASE WHEN den > 0 THEN c ELSE b END AS c FROM e"""


@query
def tin_summary(spark, d):
    """Faces, their area and volume over zero: a survey's surface from points alone."""
    p = _scattered(spark, d)
    f = tin.numbered(tin.triangulated(p, _radius(spark, d)))
    xyz = faces.gather(f, p.withColumnRenamed("pid", "vid"))
    return rounded(xyz.agg(F.count("*").alias("n_faces"), F.round(F.sum(G.plan_area()), 6).alias("plan_area"), F.round(F.sum(G.plan_area() * (F.col("az") + F.col("bz") + F.col("cz")) / 3), 6).alias("volume")))


SQL["tin_summary"] = SQL["tin_faces"].replace("WITH p AS (SELECT c_custkey AS pid,", "WITH p AS (SELECT c_custkey AS pid, c_acctbal / 1000 AS z,").replace("SELECT a, CASE WHEN den > 0 THEN b ELSE c END AS b, CASE WHEN den > 0 THEN c ELSE b END AS c FROM e", "SELECT count(*) AS n_faces, round(sum(abs(den) / 4), 6) AS plan_area, round(sum(abs(den) / 4 * (u.z + v.z + w.z) / 3), 6) AS volume FROM e JOIN p u ON u.pid = a JOIN p v ON v.pid = b JOIN p w ON w.pid = c")


@query
def tin_in_outline(spark, d):
    """Triangles of the survey whose centroid lies in the areas."""
    p = _scattered(spark, d)
    return tin.within_outline(tin.triangulated(p, _radius(spark, d)), p, _ring_edges(spark))


SQL["tin_in_outline"] = SQL["tin_faces"].replace("WITH p AS", f"WITH {O.RINGS}, p AS").replace("SELECT a, CASE WHEN den > 0 THEN b ELSE c END AS b, CASE WHEN den > 0 THEN c ELSE b END AS c FROM e", ", m AS (SELECT e.*, (u.x + v.x + w.x) / 3 AS x, (u.y + v.y + w.y) / 3 AS y FROM e JOIN p u ON u.pid = a JOIN p v ON v.pid = b JOIN p w ON w.pid = c) SELECT a, CASE WHEN den > 0 THEN b ELSE c END AS b, CASE WHEN den > 0 THEN c ELSE b END AS c FROM m JOIN re ON ((y1 > m.y) != (y0 > m.y)) AND m.x < (x0 - x1) * (m.y - y1) / (y0 - y1) + x1 GROUP BY a, b, c, den HAVING count(*) % 2 = 1")


@query
def cleaned_segments(spark, d):
    n = T.table(spark, d, "supplier")
    k = F.col("s_suppkey")
    return tin.cleaned_segments(n.select((k % 7).alias("p"), (k % 5).alias("q")))


SQL["cleaned_segments"] = "SELECT DISTINCT least(s_suppkey % 7, s_suppkey % 5) AS p, greatest(s_suppkey % 7, s_suppkey % 5) AS q FROM supplier WHERE s_suppkey % 7 != s_suppkey % 5"


# drainage


def _terraced(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The lattice in steps of a whole unit, so that much of it is flat."""
    v = T.lattice_vertices(spark, d).withColumn("z", F.floor("z"))
    v = v.withColumn("z", F.col("z").cast("double"))
    f = T.lattice_faces(v)
    return v, f, faces.gather(f, v)


def _terraced_flow(spark, d):
    """The terraced surface's faces, their neighbours and where they drain; each is made once, since many steps read them."""
    _, f, xyz = _terraced(spark, d)
    xyz, n = materialized(xyz), materialized(topology.face_neighbours(f))
    c = xyz.select("fid", (F.col("az") + F.col("bz") + F.col("cz")).alias("z"))
    return xyz, n, drainage.with_flats(surfaces.lattice_flow(xyz, n), n, c)


@query
def flat_flow(spark, d):
    return _terraced_flow(spark, d)[2]


FLAT = O.FLOW.replace("o_totalprice / 100000 AS z FROM orders", "floor(o_totalprice / 100000)::DOUBLE AS z FROM orders") + """,
fl AS (SELECT flow.fid, az + bz + cz AS z FROM flow JOIN m USING (fid) WHERE flows_to = -2), zz AS (SELECT fid, az + bz + cz AS z FROM m),
sd AS (SELECT fid, unnest([n0, n1, n2]) AS nid FROM nb SEMI JOIN fl USING (fid)),
lo AS (SELECT sd.fid, sd.nid, row_number() OVER (PARTITION BY sd.fid ORDER BY n.z, sd.nid) AS k FROM sd JOIN fl ON fl.fid = sd.fid JOIN zz n ON n.fid = sd.nid WHERE sd.nid NOT IN (SELECT fid FROM fl) AND n.z < fl.z),
sp AS (SELECT fid, nid AS flows_to FROM lo WHERE k = 1 UNION ALL SELECT DISTINCT fid, -1 FROM sd WHERE nid = -1 AND fid NOT IN (SELECT fid FROM lo)),
inn AS (SELECT DISTINCT sd.fid, sd.nid FROM sd JOIN fl ON fl.fid = sd.nid),
reach AS (SELECT fid AS a, fid AS b FROM fl UNION SELECT r.a, i.nid FROM reach r JOIN inn i ON i.fid = r.b),
reg AS (SELECT a AS fid, min(b) AS region FROM reach GROUP BY a),
dry AS (SELECT region, arg_min(fid, (fl.z, fid)) AS fid FROM reg JOIN fl USING (fid) WHERE region NOT IN (SELECT region FROM reg JOIN sp USING (fid)) GROUP BY region),
src AS (SELECT fid, flows_to FROM sp UNION ALL SELECT fid, -2 FROM dry),
lev AS (SELECT fid, 0 AS k FROM src UNION SELECT i.nid, k + 1 FROM lev JOIN inn i ON i.fid = lev.fid WHERE k < 60),
dk AS (SELECT fid, min(k) AS k FROM lev GROUP BY fid),
ff AS (SELECT fid, flows_to FROM flow WHERE flows_to != -2 UNION ALL SELECT fid, flows_to FROM src UNION ALL SELECT a.fid, min(b.fid) FROM dk a JOIN inn i ON i.fid = a.fid JOIN dk b ON b.fid = i.nid AND b.k = a.k - 1 WHERE a.k > 0 GROUP BY a.fid)"""
SQL["flat_flow"] = f"WITH RECURSIVE {FLAT} SELECT fid, flows_to FROM ff"


def _basins(spark, d, share: float):
    with shuffled_joins(spark):
        xyz, flow, roots = _settled_basins(spark, d, share)
        return materialized(rounded(drainage.basin_table(roots, flow, xyz)))


def _settled_basins(spark, d, share: float):
    xyz, neighbours, flow = _terraced_flow(spark, d)
    flow = materialized(flow)
    ends = flow.where("flows_to = -1").select(F.col("fid").alias("root"))
    return xyz, flow, drainage.settled(graphs.flow_roots(flow), ends, xyz, neighbours, share)


@query
def basins_consolidated(spark, d):
    """Basins by size, sinks that share a floor being one."""
    return _basins(spark, d, 0.0)


@query
def basins_merged(spark, d):
    """The same, slivers below half a hundredth of the whole joined to a neighbour."""
    return _basins(spark, d, 0.005)


@query
def basin_outlets(spark, d):
    """Basins of the plain lattice with their low points and outlets, numbered by area."""
    _, f, xyz = mesh(spark, d)
    flow = surfaces.lattice_flow(xyz, topology.face_neighbours(f))
    return rounded(drainage.basin_table(graphs.flow_roots(flow), flow, xyz))


SQL["basin_outlets"] = f"""WITH RECURSIVE {O.FLOW}{O.ROOTS}, cn AS (SELECT root, unnest([(az, ax, ay), (bz, bx, by), (cz, cx, cy)]) AS p FROM roots JOIN m USING (fid)), lp AS (SELECT root, min(p) AS p FROM cn GROUP BY root),
  gr AS (SELECT root, count(*) AS n_faces, sum(plan_area) AS plan_area FROM roots JOIN m USING (fid) GROUP BY root), en AS (SELECT fid AS root, flows_to FROM flow)
  SELECT row_number() OVER (ORDER BY round(plan_area, 6) DESC, root) - 1 AS basin, root, n_faces, {r('plan_area')}, {r('p[2]', 'low_x')}, {r('p[3]', 'low_y')}, {r('p[1]', 'low_z')}, CASE WHEN flows_to = -1 THEN 'border' ELSE 'sink' END AS outlet FROM gr JOIN lp USING (root) JOIN en USING (root)"""


@query
def basin_outlines(spark, d):
    """Outlines of the plain lattice's basins: their sides, and the area they enclose."""
    with shuffled_joins(spark):
        v, f, xyz = mesh(spark, d)
        f = materialized(f)
        roots = graphs.flow_roots(surfaces.lattice_flow(xyz, topology.face_neighbours(f)))
        o = drainage.outlines(roots, f).join(v, "vid")
        e = spatial.ring_edges(o.select(F.col("root").alias("area_id"), F.col("loop").alias("ring_id"), "seq", "x", "y"))
        return materialized(rounded(e.groupBy(F.col("area_id").alias("root")).agg(F.count("*").alias("n_sides"), (F.sum(G.cross("x0", "y0", "x1", "y1")) / 2).alias("area"))))


SQL["basin_outlines"] = f"""WITH RECURSIVE {O.FLOW}{O.ROOTS}, s AS (SELECT root, u, w, count(*) AS n FROM h JOIN roots USING (fid) GROUP BY root, u, w), a AS (SELECT root, sum(plan_area) AS area FROM roots JOIN m USING (fid) GROUP BY root)
  SELECT root, count(*) AS n_sides, {r('any_value(area)', 'area')} FROM s JOIN a USING (root) WHERE n = 1 GROUP BY root"""


SQL = {k: re.sub(r'(?<!")\bby\b(?!")', '"by"', v) for k, v in SQL.items()}
