"""Closed rings against one another, against points and against lines."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geolode.functions import geometry as G
from geolode.operators import spatial

_XY = ["x0", "y0", "x1", "y1"]


def _numbered(edges: DataFrame) -> DataFrame:
    """Edges with a name ``sid`` of their own."""
    return edges.select(F.struct("area_id", "ring_id", "seq").alias("sid"), *_XY)


#: Edges up to which an area is held against another as a whole.
WHOLE = 64


def overlaps(edges: DataFrame, cell: float) -> DataFrame:
    """(a, b), a < b: areas of which a vertex of one lies inside the other, or edges properly cross.

    Areas of few edges (``WHOLE``) meet where their boxes do, in the one cell that holds the boxes' common
    lower corner, and stop at the first proof; pairs with a larger area are found by edges.
    """
    ends = [f("x0", "x1") for f in (F.least, F.greatest)] + [f("y0", "y1") for f in (F.least, F.greatest)]
    box = [f(e).alias(n) for f, e, n in zip((F.min, F.max, F.min, F.max), ends, ("lx", "hx", "ly", "hy"), strict=True)]
    area = edges.where("area_id is not null").groupBy("area_id").agg(F.count("*").alias("n"), *box)
    large = area.where(F.col("n") > WHOLE).select("area_id")
    few = edges.join(large, "area_id", "left_anti").groupBy("area_id").agg(F.collect_list(F.struct(*_XY)).alias("e"), *box).where("lx is not null and ly is not null")
    at = few.withColumn("gx", spatial._cells(F.col("lx"), F.col("hx"), cell)).withColumn("gy", spatial._cells(F.col("ly"), F.col("hy"), cell))
    p, q = (at.select("gx", "gy", *(F.col(c).alias(f"{side}_{c}") for c in ("area_id", "e", "lx", "hx", "ly", "hy"))) for side in "pq")
    low = [F.greatest(f"p_l{k}", f"q_l{k}") for k in "xy"]
    meet = (F.col("p_area_id") < F.col("q_area_id")) & (low[0] <= F.least("p_hx", "q_hx")) & (low[1] <= F.least("p_hy", "q_hy")) & (F.floor(low[0] / cell) == F.col("gx")) & (F.floor(low[1] / cell) == F.col("gy"))
    cross = F.exists("p_e", lambda s: F.exists("q_e", lambda t: G.segments_cross_strictly(*(s[k] for k in _XY), *(t[k] for k in _XY))))
    inside = lambda v, e: F.exists(v, lambda s: F.size(F.filter(e, lambda t: G.ray_crosses(s["x0"], s["y0"], *(t[k] for k in _XY)))) % 2 == 1)
    proof = F.coalesce(cross, F.lit(False)) | F.coalesce(inside("p_e", "q_e"), F.lit(False)) | F.coalesce(inside("q_e", "p_e"), F.lit(False))
    found = spatial.spread(p).join(spatial.spread(q), ["gx", "gy"]).where(meet).where(proof).select(F.col("p_area_id").alias("a"), F.col("q_area_id").alias("b"))
    if not large.limit(1).count():
        return found
    vertex = edges.select(F.struct("area_id", "ring_id", "seq").alias("pid"), F.col("x0").alias("x"), F.col("y0").alias("y"))
    within = spatial.points_in_rings(vertex, edges, cell).select(F.col("pid.area_id").alias("p"), F.col("area_id").alias("q"))
    crossing = spatial.segment_crossings(_numbered(edges), cell).select(F.col("s1.area_id").alias("p"), F.col("s2.area_id").alias("q"))
    return found.unionByName(within.unionByName(crossing).where("p != q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))).distinct()


def self_crossing(edges: DataFrame, cell: float) -> DataFrame:
    """(area_id, ring_id) of rings of which two edges properly cross; neighbours never do."""
    c = spatial.segment_crossings(_numbered(edges), cell)
    same = (F.col("s1.area_id") == F.col("s2.area_id")) & (F.col("s1.ring_id") == F.col("s2.ring_id"))
    return c.where(same).select("s1.area_id", "s1.ring_id").distinct()


def interior_points(edges: DataFrame) -> DataFrame:
    """(area_id, x, y): the middle of the widest stretch inside, of equals the first, on a level halfway up the tallest gap between vertices' heights.

    Such a level meets no vertex, so crossings pair up. Areas without height have no point.
    """
    y = edges.select("area_id", F.col("y0").alias("y")).distinct()
    w = Window.partitionBy("area_id").orderBy("y")
    gap = y.select("area_id", "y", (F.lead("y").over(w) - F.col("y")).alias("gap")).where("gap > 0")
    level = gap.groupBy("area_id").agg(F.max(F.struct("gap", (-F.col("y")).alias("low"))).alias("g")).select("area_id", (-F.col("g.low") + F.col("g.gap") / 2).alias("y"))
    hit = edges.join(level, "area_id").where((F.col("y0") > F.col("y")) != (F.col("y1") > F.col("y")))
    x = F.col("x0") + (F.col("x1") - F.col("x0")) * ((F.col("y") - F.col("y0")) / (F.col("y1") - F.col("y0")))
    at = Window.partitionBy("area_id").orderBy("x")
    hit = hit.select("area_id", "y", x.alias("x")).select("area_id", "y", "x", F.lead("x").over(at).alias("to"), F.row_number().over(at).alias("k")).where("k % 2 = 1")
    best = hit.groupBy("area_id").agg(F.max(F.struct((F.col("to") - F.col("x")).alias("wide"), (-F.col("x")).alias("left"), "y")).alias("b"))
    return best.select("area_id", (-F.col("b.left") + F.col("b.wide") / 2).alias("x"), F.col("b.y").alias("y"))


def all_inside(points: DataFrame, edges: DataFrame, tolerance: float, band: float) -> DataFrame:
    """(shape, area_id) of point sets (shape, pid, x, y) that lie in an area whole: every point inside or within a tolerance of its edges."""
    p = points.select(F.struct("shape", "pid").alias("pid"), "x", "y")
    hit = spatial.points_in_rings(p, edges, band)
    if tolerance > 0:
        hit = hit.unionByName(spatial.ring_distance(p, edges, tolerance).select("pid", "area_id"))
    n = points.groupBy("shape").agg(F.count("*").alias("n"))
    return hit.distinct().groupBy(F.col("pid.shape").alias("shape"), "area_id").agg(F.count("*").alias("m")).join(n, "shape").where("m = n").select("shape", "area_id")


def clipped_lines(segments: DataFrame, edges: DataFrame, cell: float) -> DataFrame:
    """(sid, area_id, part, t0, t1, x0, y0, z0, x1, y1, z1): the parts of segments inside each area, cut where its edges cross or touch them.

    Segments along an edge are cut at its ends. A part belongs if its middle is inside, even-odd.
    """
    s = segments.withColumn("gx", spatial._cells(F.least("x0", "x1"), F.greatest("x0", "x1"), cell)).withColumn("gy", spatial._cells(F.least("y0", "y1"), F.greatest("y0", "y1"), cell))
    e = edges.select("area_id", *(F.col(k).alias(f"e{k}") for k in _XY))
    near = e.withColumn("gx", spatial._cells(F.least("ex0", "ex1"), F.greatest("ex0", "ex1"), cell)).withColumn("gy", spatial._cells(F.least("ey0", "ey1"), F.greatest("ey0", "ey1"), cell))
    dx, dy, ux, uy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("ex1") - F.col("ex0"), F.col("ey1") - F.col("ey0")
    wx, wy = F.col("ex0") - F.col("x0"), F.col("ey0") - F.col("y0")
    den = G.cross(dx, dy, ux, uy)
    t, u = G.cross(wx, wy, ux, uy) / F.when(den != 0, den), G.cross(wx, wy, dx, dy) / F.when(den != 0, den)
    place = lambda x, y: G.segment_parameter(x, y, "x0", "y0", "x1", "y1")
    along = (den == 0) & (G.cross(wx, wy, dx, dy) == 0)
    cuts = F.when(along, F.array(place("ex0", "ey0"), place("ex1", "ey1"))).when((t >= 0) & (t <= 1) & (u >= 0) & (u <= 1), F.array(t))
    cut = s.join(near, ["gx", "gy"]).select("sid", "area_id", F.explode(cuts).alias("t")).where("t > 0 and t < 1").groupBy("sid", "area_id").agg(F.array_sort(F.collect_set("t")).alias("t"))
    # Areas a segment does not cross may hold it whole: its middle tells.
    mid = segments.select(F.col("sid").alias("pid"), ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    whole = spatial.points_in_rings(mid, edges, cell).select(F.col("pid").alias("sid"), "area_id").join(cut, ["sid", "area_id"], "left_anti").withColumn("t", F.array().cast("array<double>"))
    part = cut.unionByName(whole).withColumn("t", F.concat(F.array(F.lit(0.0)), "t", F.array(F.lit(1.0))))
    part = part.select("sid", "area_id", "t", F.posexplode(F.slice("t", 1, F.size("t") - 1)).alias("part", "t0")).select("sid", "area_id", "part", "t0", F.element_at("t", F.col("part") + 2).alias("t1")).where("t1 - t0 > 1e-12")
    part = part.join(segments, "sid")
    m = (F.col("t0") + F.col("t1")) / 2
    middle = part.select(F.struct("sid", "area_id", "part").alias("pid"), G.lerp("x0", "x1", m).alias("x"), G.lerp("y0", "y1", m).alias("y"))
    inside = spatial.points_in_rings(middle, edges, cell).where(F.col("pid.area_id") == F.col("area_id")).select("pid.*")
    out = part.join(inside, ["sid", "area_id", "part"], "left_semi")
    return out.select("sid", "area_id", "part", "t0", "t1", *(G.lerp(f"{c}0", f"{c}1", f"t{i}").alias(f"{c}{i}") for i in (0, 1) for c in "xyz"))


def lines_inside(segments: DataFrame, edges: DataFrame, cell: float) -> DataFrame:
    """(sid, area_id) of segments that lie in an area whole."""
    c = clipped_lines(segments, edges, cell)
    return c.groupBy("sid", "area_id").agg(F.sum(F.col("t1") - F.col("t0")).alias("t")).where("t >= 1 - 1e-9").select("sid", "area_id")


_RECTANGLE = "area_id int, x double, y double, width double, height double, rotation double, problem string"


def mapping_rectangles(corners: DataFrame, tolerance: float) -> DataFrame:
    """(area_id, x, y, width, height, rotation, problem) of closed outlines (area_id, seq, x, y, z) that should be level rectangles.

    Repeated and straight vertices do not count. The first vertex is the origin; outlines that wind clockwise are turned.
    """
    tol = max(tolerance, 1e-12)

    def fit(key, rows):
        rows = rows.sort_values("seq")
        p = list(zip(rows["x"], rows["y"], strict=True))
        bad = lambda why: pd.DataFrame([(key[0], None, None, None, None, None, why)], columns=[c.split()[0] for c in _RECTANGLE.split(", ")])
        if len(p) > 1 and math.dist(p[0], p[-1]) <= tol:
            p.pop()
        if rows["z"].max() - rows["z"].min() > tol:
            return bad("not level")

        def needless(i: int) -> bool:
            a, b, c = p[i - 1], p[i], p[(i + 1) % len(p)]
            side = math.dist(a, c)
            off = abs((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])) / side if side > 1e-15 else math.dist(a, b)
            return math.dist(a, b) <= tol or off <= tol

        while len(p) >= 3 and (i := next((i for i in range(len(p)) if needless(i)), None)) is not None:
            if i == 0:
                return bad("start is no corner")
            del p[i]
        if len(p) != 4:
            return bad(f"{len(p)} corners")
        if sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, [*p[1:], p[0]], strict=True)) < 0:
            p = [p[0], p[3], p[2], p[1]]
        (ux, uy), (vx, vy) = ((p[i][0] - p[0][0], p[i][1] - p[0][1]) for i in (1, 3))
        width, height = math.hypot(ux, uy), math.hypot(vx, vy)
        if min(width, height) <= tol:
            return bad("no area")
        if abs(ux * vx + uy * vy) / max(width, height) > tol or math.hypot(p[2][0] - p[0][0] - ux - vx, p[2][1] - p[0][1] - uy - vy) > tol:
            return bad("not square")
        return pd.DataFrame([(key[0], *p[0], width, height, math.degrees(math.atan2(uy, ux)), None)], columns=[c.split()[0] for c in _RECTANGLE.split(", ")])

    return corners.groupBy("area_id").applyInPandas(fit, _RECTANGLE)
