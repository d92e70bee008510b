"""Profiles and routes: stations, as-of heights, section comparison, runs, compliance, grade limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geolode.functions import geometry as G


def plan_stations(lines: DataFrame) -> DataFrame:
    """Adds ``station``, the plan distance along each line (route_id, seq, x, y, ...)."""
    w = Window.partitionBy("route_id").orderBy("seq")
    step = F.coalesce(F.sqrt(G.distance2("x", "y", F.lag("x").over(w), F.lag("y").over(w))), F.lit(0.0))
    return lines.withColumn("step", step).withColumn("station", F.sum("step").over(w)).drop("step")


def legs(lines: DataFrame) -> DataFrame:
    """(route_id, seq, s0, s1, x0.., x1..): a row for each pair of neighbouring stations."""
    w = Window.partitionBy("route_id").orderBy("seq")
    cols = ["station", "x", "y", "z"]
    out = lines.select("route_id", "seq", *cols, *(F.lead(k).over(w).alias(f"{k}1") for k in cols)).where("station1 is not null")
    return out.select("route_id", "seq", F.col("station").alias("s0"), F.col("station1").alias("s1"), F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("z").alias("z0"), F.col("x1"), F.col("y1"), F.col("z1"))


def elevation_at(lines: DataFrame, queries: DataFrame, cell: float) -> DataFrame:
    """(route_id, station, z) by linear interpolation; null outside the profile. Legs and queries meet by station bucket."""
    leg = legs(lines).where("s1 > s0").withColumn("b", F.explode(F.sequence(F.floor(F.col("s0") / cell), F.floor(F.col("s1") / cell))))
    q = queries.select("route_id", "station", F.floor(F.col("station") / cell).alias("b"))
    hit = q.join(leg, ["route_id", "b"]).where("station >= s0 and station <= s1")
    z = G.lerp("z0", "z1", (F.col("station") - F.col("s0")) / (F.col("s1") - F.col("s0")))
    best = hit.groupBy("route_id", "station").agg(F.min_by(z, "s0").alias("z"))
    return queries.select("route_id", "station").join(best, ["route_id", "station"], "left")


def even_stations(lines: DataFrame, spacing: float) -> DataFrame:
    """(route_id, station): evenly spread, ceil(length / spacing) steps to a route."""
    length = plan_stations(lines).groupBy("route_id").agg(F.max("station").alias("length"))
    n = F.greatest(F.lit(1), F.ceil(F.col("length") / spacing)).cast("int")
    return length.select("route_id", "length", n.alias("n"), F.explode(F.sequence(F.lit(0), n)).alias("i")).select("route_id", (F.col("length") * F.col("i") / F.col("n")).alias("station"))


def section_cut_fill(pairs: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(route_id, cut, fill) from rows (route_id, station, proposed, reference): areas between two profiles, split where they cross."""
    w = Window.partitionBy("route_id").orderBy("station")
    d = pairs.withColumn("d0", F.col("proposed") - F.col("reference"))
    d = d.select("route_id", "station", "d0", F.lead("d0").over(w).alias("d1"), F.lead("station").over(w).alias("s1")).where("s1 is not null")
    run = F.col("s1") - F.col("station")
    d = d.where(run > tolerance)
    a, b = F.abs("d0"), F.abs("d1")
    crossing = F.col("d0") * F.col("d1") < -tolerance * tolerance
    area = run * (F.col("d0") + F.col("d1")) / 2
    part0, part1 = run * a * a / (2 * (a + b)), run * b * b / (2 * (a + b))
    up = F.when(crossing, F.when(F.col("d0") > 0, part0).otherwise(part1)).otherwise(F.greatest(area, F.lit(0.0)))
    down = F.when(crossing, F.when(F.col("d0") > 0, part1).otherwise(part0)).otherwise(F.greatest(-area, F.lit(0.0)))
    return d.select("route_id", up.alias("fill"), down.alias("cut")).groupBy("route_id").agg(F.sum("cut").alias("cut"), F.sum("fill").alias("fill"))


def sliced(xyz: DataFrame, x0: float, y0: float, x1: float, y1: float, margin: float = 0.0) -> DataFrame:
    """(fid, s0, z0, s1, z1): where a vertical plane through a plan segment cuts faces, by station along it."""
    length = ((x1 - x0) ** 2 + (y1 - y0) ** 2) ** 0.5
    ux, uy = (x1 - x0) / length, (y1 - y0) / length
    side = {k: (F.col(f"{k}y") - y0) * ux - (F.col(f"{k}x") - x0) * uy for k in "abc"}
    along = {k: (F.col(f"{k}x") - x0) * ux + (F.col(f"{k}y") - y0) * uy for k in "abc"}
    m = xyz.select("fid", *(v.alias(f"d{k}") for k, v in side.items()), *(v.alias(f"s{k}") for k, v in along.items()), *(F.col(f"{k}z") for k in "abc"))

    def cut(p, q):
        t = F.col(f"d{p}") / F.when(F.col(f"d{p}") != F.col(f"d{q}"), F.col(f"d{p}") - F.col(f"d{q}"))
        point = F.struct(G.lerp(f"s{p}", f"s{q}", t).alias("s"), G.lerp(f"{p}z", f"{q}z", t).alias("z"))
        return F.when((F.col(f"d{p}") >= 0) != (F.col(f"d{q}") >= 0), point)

    m = m.select("fid", F.array_sort(F.array_compact(F.array(cut("a", "b"), cut("b", "c"), cut("c", "a")))).alias("p")).where(F.size("p") == 2)
    m = m.select("fid", F.get("p", F.lit(0))["s"].alias("s0"), F.get("p", F.lit(0))["z"].alias("z0"), F.get("p", F.lit(1))["s"].alias("s1"), F.get("p", F.lit(1))["z"].alias("z1"))
    return m.where((F.col("s1") >= -margin) & (F.col("s0") <= length + margin))


def route_metrics(lines: DataFrame) -> DataFrame:
    """(route_id, length, max_grade, mean_grade, rise, fall) along each route (stations and z)."""
    leg = legs(lines).where("s1 > s0").withColumn("dz", F.col("z1") - F.col("z0"))
    run = F.col("s1") - F.col("s0")
    return leg.groupBy("route_id").agg(F.sum(run).alias("length"), F.max(F.abs("dz") / run).alias("max_grade"), (F.sum(F.abs("dz")) / F.sum(run)).alias("mean_grade"), F.sum(F.greatest("dz", F.lit(0.0))).alias("rise"), F.sum(F.greatest(-F.col("dz"), F.lit(0.0))).alias("fall"))


def runs(lines: DataFrame, window: float, landing_limit: float, min_landing: float) -> DataFrame:
    """(route_id, run, kind, s0, s1, n): stretches that are landings or slopes, by smoothed grade.

    The grade at a station is from the heights half a window back and on (a neighbour each side at least).
    """
    w = Window.partitionBy("route_id").orderBy("station")
    near = f"over (partition by route_id order by station range between {window / 2} preceding and {window / 2} following)"
    s = lines.select("route_id", "station", "z", F.lag("station").over(w).alias("sp"), F.lag("z").over(w).alias("zp"), F.lead("station").over(w).alias("sn"), F.lead("z").over(w).alias("zn"), F.expr(f"min(station) {near}").alias("lo"), F.expr(f"max(station) {near}").alias("hi"), F.expr(f"first(z) {near}").alias("zlo"), F.expr(f"last(z) {near}").alias("zhi"))
    a, za = F.when(F.col("lo") < F.col("station"), F.col("lo")).otherwise(F.coalesce("sp", "station")), F.when(F.col("lo") < F.col("station"), F.col("zlo")).otherwise(F.coalesce("zp", "z"))
    b, zb = F.when(F.col("hi") > F.col("station"), F.col("hi")).otherwise(F.coalesce("sn", "station")), F.when(F.col("hi") > F.col("station"), F.col("zhi")).otherwise(F.coalesce("zn", "z"))
    s = s.select("route_id", "station", "z", F.coalesce(F.abs(F.try_divide(zb - za, b - a)), F.lit(0.0)).alias("grade"))
    s = s.withColumn("flat", F.col("grade") <= landing_limit)
    s = s.withColumn("new", F.coalesce(F.col("flat") != F.lag("flat").over(w), F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(w))
    g = s.groupBy("route_id", "run", "flat").agg(F.min("station").alias("s0"), F.max("station").alias("s1"), F.max("grade").alias("steepest"), F.count("*").alias("n"))
    kind = F.when(F.col("flat") & (F.col("s1") - F.col("s0") >= min_landing), "landing").when(F.col("flat"), "level").otherwise("slope")
    return g.select("route_id", F.col("run").cast("int").alias("run"), kind.alias("kind"), "s0", "s1", "steepest", "n")


def grade_limited(lines: DataFrame, limit: float) -> DataFrame:
    """Adds ``grade_z``, the height midway between the least and greatest profiles whose grade never passes the limit.

    Both ends keep their own height: the middle is clamped into the cones from
    them. Where the ends lie too far apart (``required`` grade beyond the limit)
    ``feasible`` is false and there is no height. The envelopes are running
    extremes of z +- limit * station, one window each way.
    """
    # Both ways the window grows from its start: one that shrinks towards the end would be worked out anew for every row.
    whole = Window.partitionBy("route_id")
    back, on = (whole.orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc("station"), F.desc("station")))
    s, m = F.col("station"), F.lit(limit) * F.col("station")
    upper = F.greatest(F.max(F.col("z") + m).over(back) - m, F.max(F.col("z") - m).over(on) + m)
    lower = F.least(F.min(F.col("z") - m).over(back) + m, F.min(F.col("z") + m).over(on) - m)
    ends = {"_s0": F.min("station").over(whole), "_z0": F.min_by("z", "station").over(whole), "_s1": F.max("station").over(whole), "_z1": F.max_by("z", "station").over(whole)}
    out = lines.withColumns({"upper": upper, "lower": lower, **ends})
    span, gap = F.col("_s1") - F.col("_s0"), F.abs(F.col("_z1") - F.col("_z0"))
    required = F.when(span > 0, gap / span).when(gap == 0, 0.0).otherwise(F.lit(G.INF))
    low = F.greatest(F.col("_z0") - limit * (s - F.col("_s0")), F.col("_z1") - limit * (F.col("_s1") - s))
    high = F.least(F.col("_z0") + limit * (s - F.col("_s0")), F.col("_z1") + limit * (F.col("_s1") - s))
    held = F.when(s == F.col("_s0"), F.col("_z0")).when(s == F.col("_s1"), F.col("_z1")).when(high < low, (low + high) / 2).otherwise(G.clamp((F.col("upper") + F.col("lower")) / 2, low, high))
    out = out.withColumn("required", required).withColumn("feasible", F.col("required") <= limit * (1 + 1e-9) + 1e-12)
    return out.withColumn("grade_z", F.when(F.col("feasible"), held)).drop("_s0", "_z0", "_s1", "_z1")


def allowed_going(ratio, limits: list[tuple[float, float]], stricter: bool = False):
    """Longest going for a grade from pairs (n of 1:n, going): clamped at the ends; between, the stricter one or linear in n."""
    rows = sorted(limits)
    n = 1 / G.c(ratio)
    out = F.when(n <= rows[0][0], F.lit(float(rows[0][1])))
    for (n0, g0), (n1, g1) in zip(rows, rows[1:], strict=False):
        between = F.lit(float(min(g0, g1))) if stricter else g0 + (n - n0) / (n1 - n0) * (g1 - g0)
        out = out.when(n <= n1, between)
    return out.otherwise(F.lit(float(rows[-1][1])))


def route_compliance(xyz: DataFrame, lines: DataFrame, half_width: float, walk_limit: float, ramp_limit: float, cross_limit: float) -> DataFrame:
    """(verdict, n_faces, plan_area): faces whose centroid is near a route, by grade along and across its nearest leg.

    Beyond the ramp's limit along the route they are ``running``, else beyond the
    limit across it ``cross``, else beyond what may be walked ``ramp``, else ``walk``.
    """
    nx, ny, nz = G.normal()
    f = xyz.select("fid", ((F.col("ax") + F.col("bx") + F.col("cx")) / 3).alias("px"), ((F.col("ay") + F.col("by") + F.col("cy")) / 3).alias("py"), (-nx / F.when(nz != 0, nz)).alias("gx_"), (-ny / F.when(nz != 0, nz)).alias("gy_"), G.plan_area().alias("plan_area"))
    f = f.withColumns({"gx": F.floor(F.col("px") / half_width), "gy": F.floor(F.col("py") / half_width)})
    e = legs(lines).where("s1 > s0")
    e = e.withColumn("gx", F.explode(F.sequence(F.floor((F.least("x0", "x1") - half_width) / half_width), F.floor((F.greatest("x0", "x1") + half_width) / half_width))))
    e = e.withColumn("gy", F.explode(F.sequence(F.floor((F.least("y0", "y1") - half_width) / half_width), F.floor((F.greatest("y0", "y1") + half_width) / half_width))))
    d = G.segment_distance("px", "py", "x0", "y0", "x1", "y1")
    from geolode.operators import spatial

    hit = spatial.spread(f).join(spatial.spread(e), ["gx", "gy"]).withColumn("d", d).where(F.col("d") <= half_width)
    best = hit.groupBy("fid").agg(F.min_by(F.struct("gx_", "gy_", "plan_area", "x0", "y0", "x1", "y1"), F.struct("d", "route_id", "seq")).alias("b")).select("b.*")
    ux, uy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    length = F.sqrt(ux * ux + uy * uy)
    running, across = F.abs(F.col("gx_") * ux + F.col("gy_") * uy) / length, F.abs(G.cross("gx_", "gy_", ux, uy)) / length
    slack = 1e-9
    verdict = F.when(running > max(walk_limit, ramp_limit) + slack, "running").when(across > cross_limit + slack, "cross").when(running > walk_limit + slack, "ramp").otherwise("walk")
    return best.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n_faces"), F.sum("plan_area").alias("plan_area"))


def with_profile(lines: DataFrame, profile: DataFrame, tolerance: float, cell: float) -> DataFrame:
    """(route_id, station, x, y, z, covered): a path's stations and a profile's (route_id, station, z) together, the profile's height where it has one.

    Profile stations at or beyond the path's ends are left out; a run of stations, each
    within the tolerance of the one before, counts as its first (a path's before a profile's). Where the profile ends the path keeps its own height and ``covered`` is false.
    """
    eps = max(abs(tolerance), 1e-12)
    length = lines.groupBy("route_id").agg(F.max("station").alias("length"))
    extra = profile.join(length, "route_id").where((F.col("station") > eps) & (F.col("station") < F.col("length") - eps)).select("route_id", "station")
    leg = legs(lines).where("s1 > s0").withColumn("b", F.explode(F.sequence(F.floor(F.col("s0") / cell), F.floor(F.col("s1") / cell))))
    at = extra.distinct().withColumn("b", F.floor(F.col("station") / cell)).join(leg, ["route_id", "b"]).where("station >= s0 and station < s1")
    t = (F.col("station") - F.col("s0")) / (F.col("s1") - F.col("s0"))
    both = lines.select("route_id", "station", "x", "y", "z", F.lit(0).alias("later")).unionByName(at.select("route_id", "station", *(G.lerp(f"{k}0", f"{k}1", t).alias(k) for k in "xyz"), F.lit(1).alias("later")))
    w = Window.partitionBy("route_id").orderBy("station", "later")
    near = F.col("station") - F.lag("station").over(w) <= eps
    both = both.withColumn("again", F.coalesce(near, F.lit(False))).where("not again").drop("again", "later")
    own = profile.select("route_id", F.col("station").alias("seq"), "station", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), "z")
    z = elevation_at(own, both.select("route_id", "station"), cell).withColumnRenamed("z", "pz")
    return both.join(z, ["route_id", "station"]).select("route_id", "station", "x", "y", F.coalesce("pz", "z").alias("z"), F.col("pz").isNotNull().alias("covered"))


def _profile_edges(points: DataFrame, tolerance: float, name: str) -> DataFrame:
    """(route_id, a, b, za, zb) of profiles (route_id, part, seq, station, z), the lower station first."""
    w = Window.partitionBy("route_id", "part").orderBy("seq")
    e = points.select("route_id", "station", "z", F.lead("station").over(w).alias("s1"), F.lead("z").over(w).alias("z1")).where(F.abs(F.col("s1") - F.col("station")) > tolerance)
    up = F.col("station") <= F.col("s1")
    pick = lambda x, y: F.when(up, F.col(x)).otherwise(F.col(y))
    return e.select("route_id", pick("station", "s1").alias(f"{name}a"), pick("s1", "station").alias(f"{name}b"), pick("z", "z1").alias(f"{name}za"), pick("z1", "z").alias(f"{name}zb"))


def compared(proposed: DataFrame, reference: DataFrame, tolerance: float, cell: float) -> DataFrame:
    """(route_id, region, is_cut, s0, s1, area): regions between two profiles (route_id, part, seq, station, z), which may have stations of their own.

    Edges are compared where they overlap, split where the difference changes
    sign, left out where it is within the tolerance, and neighbours on one side
    become one region.
    """
    tol = max(tolerance, 1e-9)
    p, r = _profile_edges(proposed, tol, "p"), _profile_edges(reference, tol, "r")
    p = p.withColumn("b", F.explode(F.sequence(F.floor(F.col("pa") / cell), F.floor(F.col("pb") / cell))))
    r = r.withColumn("b", F.explode(F.sequence(F.floor(F.col("ra") / cell), F.floor(F.col("rb") / cell))))
    o = p.join(r, ["route_id", "b"]).withColumns({"s0": F.greatest("pa", "ra"), "s1": F.least("pb", "rb")})
    o = o.where((F.col("s1") - F.col("s0") > tol) & (F.col("b") == F.floor(F.col("s0") / cell)))
    at = lambda k, s: G.lerp(f"{k}za", f"{k}zb", (F.col(s) - F.col(f"{k}a")) / (F.col(f"{k}b") - F.col(f"{k}a")))
    o = o.select("route_id", "s0", "s1", (at("p", "s0") - at("r", "s0")).alias("d0"), (at("p", "s1") - at("r", "s1")).alias("d1")).where((F.abs("d0") > tol) | (F.abs("d1") > tol))
    crossing = F.col("d0") * F.col("d1") < -tol * tol
    mid = G.lerp("s0", "s1", F.col("d0") / (F.col("d0") - F.col("d1")))
    one = lambda a, b, x, y: F.struct(a.alias("s0"), b.alias("s1"), x.alias("d0"), y.alias("d1"))
    zero, s0, s1, d0, d1 = F.lit(0.0), F.col("s0"), F.col("s1"), F.col("d0"), F.col("d1")
    parts = o.select("route_id", F.explode(F.when(crossing, F.array(one(s0, mid, d0, zero), one(mid, s1, zero, d1))).otherwise(F.array(one(s0, s1, d0, d1)))).alias("p")).select("route_id", "p.*")
    parts = parts.where((F.col("s1") - F.col("s0") > tol) & (F.abs(F.col("d0") + F.col("d1")) / 2 > tol)).withColumn("is_cut", F.col("d0") + F.col("d1") < 0)
    w = Window.partitionBy("route_id").orderBy("s0")
    joined = (F.lag("is_cut").over(w) == F.col("is_cut")) & (F.abs(F.lag("s1").over(w) - F.col("s0")) <= tol) & (F.abs(F.lag("d1").over(w) - F.col("d0")) <= tol)
    parts = parts.withColumn("new", (~F.coalesce(joined, F.lit(False))).cast("int")).withColumn("region", F.sum("new").over(w))
    area = F.abs(F.sum((F.col("s1") - F.col("s0")) * (F.col("d0") + F.col("d1")) / 2))
    return parts.groupBy("route_id", F.col("region").cast("int").alias("region"), "is_cut").agg(F.min("s0").alias("s0"), F.max("s1").alias("s1"), area.alias("area"))


def route_stations(lines: DataFrame, spacing: float, cell: float) -> DataFrame:
    """(route_id, seq, station, x, y): even stations along plan lines (with ``station``), ceil(length / spacing) steps."""
    even = even_stations(lines, spacing).withColumn("b", F.floor(F.col("station") / cell))
    leg = legs(lines).where("s1 > s0").withColumn("b", F.explode(F.sequence(F.floor(F.col("s0") / cell), F.floor(F.col("s1") / cell))))
    at = even.join(leg, ["route_id", "b"]).where("station >= s0 and station <= s1")
    t = (F.col("station") - F.col("s0")) / (F.col("s1") - F.col("s0"))
    at = at.groupBy("route_id", "station").agg(F.min_by(F.struct(G.lerp("x0", "x1", t).alias("x"), G.lerp("y0", "y1", t).alias("y")), "s0").alias("p"))
    return at.select("route_id", F.row_number().over(Window.partitionBy("route_id").orderBy("station")).alias("seq"), "station", "p.x", "p.y")


def run_pieces(stations: DataFrame, window: float, landing_ratio: float, min_landing: float, walk_ratio: float, walk_rise: float, ramp_rise: float, going: list[tuple[float, float]], stricter: bool = False) -> DataFrame:
    """(route_id, run, kind, s0, s1, rise, steepest, allowed_going, rise_exceeded, going_exceeded) of routes' stations (route_id, station, z).

    Slopes are over a window around each station, a neighbour each side at
    least; a station is flat if the slope back or on is within a landing's. Flat
    stretches of the least length are landings; all between two landings is one
    run that shares their end stations, its rise taken from their mean heights too,
    its kind (level, walk, ramp) from its steepest station.
    """
    tol = 1e-9
    w = Window.partitionBy("route_id").orderBy("station")
    half = max(0.0, window) / 2 + tol
    near = f"over (partition by route_id order by station range between {half} preceding and {half} following)"
    s = stations.select("route_id", "station", "z", F.lag("station").over(w).alias("sp"), F.lag("z").over(w).alias("zp"), F.lead("station").over(w).alias("sn"), F.lead("z").over(w).alias("zn"), F.expr(f"first(station) {near}").alias("lo"), F.expr(f"last(station) {near}").alias("hi"), F.expr(f"first(z) {near}").alias("zlo"), F.expr(f"last(z) {near}").alias("zhi"))
    own = F.col("station")
    a, za = F.when(F.col("lo") < own, F.col("lo")).otherwise(F.coalesce("sp", "station")), F.when(F.col("lo") < own, F.col("zlo")).otherwise(F.coalesce("zp", "z"))
    b, zb = F.when(F.col("hi") > own, F.col("hi")).otherwise(F.coalesce("sn", "station")), F.when(F.col("hi") > own, F.col("zhi")).otherwise(F.coalesce("zn", "z"))
    s = s.select("route_id", "station", "z", a.alias("a"), za.alias("za"), b.alias("b"), zb.alias("zb"))
    slope = lambda x, zx, y, zy: F.when(F.col(y) > F.col(x), F.abs(F.col(zy) - F.col(zx)) / (F.col(y) - F.col(x))).otherwise(F.lit(G.INF))
    s = s.withColumns({"slope": F.when(F.col("b") > F.col("a"), slope("a", "za", "b", "zb")).otherwise(F.lit(0.0)), "flat": F.least(slope("a", "za", "station", "z"), slope("station", "z", "b", "zb")) <= landing_ratio + tol})
    s = s.withColumn("new", F.coalesce(F.col("flat") != F.lag("flat").over(w), F.lit(True)).cast("int")).withColumn("stretch", F.sum("new").over(w))
    per = Window.partitionBy("route_id", "stretch")
    s = s.withColumn("landing", F.col("flat") & (F.max("station").over(per) - F.min("station").over(per) >= min_landing - tol))
    s = s.withColumn("turn", F.coalesce(F.col("landing") != F.lag("landing").over(w), F.lit(True)).cast("int")).withColumn("run", F.sum("turn").over(w).cast("int"))
    g = s.groupBy("route_id", "run", "landing").agg(F.min("station").alias("s0"), F.max("station").alias("s1"), F.min("z").alias("low"), F.max("z").alias("high"), F.avg("z").alias("level"), F.max("slope").alias("steepest"), F.min_by(F.struct("z", "slope"), "station").alias("first"), F.max_by(F.struct("z", "slope"), "station").alias("last"))
    r = Window.partitionBy("route_id").orderBy("run")
    side = {"p": F.lag(F.struct("s1", "last", "level", "landing")).over(r), "n": F.lead(F.struct("s0", "first", "level", "landing")).over(r)}
    g = g.withColumns(side)
    free = ~F.col("landing")
    s0, s1 = F.when(free & F.col("p").isNotNull(), F.col("p.s1")).otherwise(F.col("s0")), F.when(free & F.col("n").isNotNull(), F.col("n.s0")).otherwise(F.col("s1"))
    heights = [F.when(free, x) for x in (F.col("p.last.z"), F.col("p.level"), F.col("n.first.z"), F.col("n.level"))]
    low, high = F.least("low", *heights), F.greatest("high", *heights)
    steepest = F.greatest("steepest", *(F.when(free, x) for x in (F.col("p.last.slope"), F.col("n.first.slope"))))
    g = g.select("route_id", "run", "landing", s0.alias("s0"), s1.alias("s1"), (high - low).alias("rise"), steepest.alias("steepest"))
    kind = F.when(F.col("landing"), "landing").when(F.col("steepest") <= landing_ratio + tol, "level").when(F.col("steepest") <= walk_ratio + tol, "walk").otherwise("ramp")
    g = g.withColumn("kind", kind).withColumn("going", F.col("s1") - F.col("s0"))
    ratio = F.when(F.col("going") > 0, F.col("rise") / F.col("going")).otherwise(F.lit(0.0))
    allowed = F.when((F.col("kind") == "ramp") & (ratio > 0), allowed_going(F.when(ratio > 0, ratio), going, stricter))
    g = g.withColumn("allowed_going", allowed)
    over = ((F.col("kind") == "walk") & (F.col("rise") > walk_rise + tol)) | ((F.col("kind") == "ramp") & (F.col("rise") > ramp_rise + tol))
    return g.select("route_id", "run", "kind", "s0", "s1", "rise", "steepest", "allowed_going", over.alias("rise_exceeded"), F.coalesce(F.col("going") > F.col("allowed_going") + tol, F.lit(False)).alias("going_exceeded"))


def faces_to_stations(xyz: DataFrame, stations: DataFrame, half_width: float) -> DataFrame:
    """(fid, route_id, station): the station nearest to each face's centroid within half a width; of equals the last by route and station."""
    f = xyz.select("fid", ((F.col("ax") + F.col("bx") + F.col("cx")) / 3).alias("px"), ((F.col("ay") + F.col("by") + F.col("cy")) / 3).alias("py"))
    f = f.withColumns({"gx": F.floor(F.col("px") / half_width), "gy": F.floor(F.col("py") / half_width)})
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    s = stations.withColumn("d", around).select("route_id", "station", "x", "y", (F.floor(F.col("x") / half_width) + F.col("d.i")).alias("gx"), (F.floor(F.col("y") / half_width) + F.col("d.j")).alias("gy"))
    hit = f.join(s, ["gx", "gy"]).withColumn("d", G.distance2("px", "py", "x", "y")).where(F.col("d") <= half_width * half_width)
    return hit.groupBy("fid").agg(F.max(F.struct((-F.col("d")).alias("d"), "route_id", "station")).alias("s")).select("fid", "s.route_id", "s.station")


def earthworks(lines: DataFrame, xyz: DataFrame, width: float, spacing: float, cell: float) -> DataFrame:
    """(route_id, cut, fill, max_cut, max_fill): a corridor's volumes against the ground below it, sampled in the middle of each piece of a leg.

    Legs are cut into ceil(length / spacing) pieces; what lies off the ground is left out.
    """
    from geolode.operators import spatial

    leg = legs(lines).where("s1 > s0").withColumn("n", F.greatest(F.lit(1), F.ceil((F.col("s1") - F.col("s0")) / spacing)).cast("int"))
    p = leg.select("route_id", "seq", "n", "s0", "s1", *(f"{k}{i}" for k in "xyz" for i in (0, 1)), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    t = (F.col("k") + 0.5) / F.col("n")
    p = p.select(F.struct("route_id", "seq", "k").alias("pid"), *(G.lerp(f"{c}0", f"{c}1", t).alias(c) for c in "xyz"), ((F.col("s1") - F.col("s0")) / F.col("n")).alias("piece"))
    h = p.join(spatial.heights_at(p, xyz, cell).where("top_z is not null").select("pid", "top_z"), "pid").withColumn("depth", F.col("z") - F.col("top_z"))
    up, down = F.greatest("depth", F.lit(0.0)), F.greatest(-F.col("depth"), F.lit(0.0))
    sums = h.groupBy("pid.route_id").agg((F.sum(down * F.col("piece")) * width).alias("cut"), (F.sum(up * F.col("piece")) * width).alias("fill"), F.max(down).alias("max_cut"), F.max(up).alias("max_fill"))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return lines.select("route_id").distinct().join(sums, "route_id", "left").select("route_id", *map(zero, ("cut", "fill", "max_cut", "max_fill")))


#: A turn sharper than this is a kink.
KINK_DEGREES = 20.0


def complexity(lines: DataFrame, radius: float, limit: float, kink: float = KINK_DEGREES) -> DataFrame:
    """(route_id, plan, profile): how much a route's curvature and grade change, in turns of a reference radius and shares of a grade limit.

    Curvature is of the circle through three neighbouring points; a kink counts as two changes.
    """
    import math

    from geolode.functions.geometry import cross

    w = Window.partitionBy("route_id").orderBy("seq")
    p = lines.withColumns({"lx": F.lag("x").over(w), "ly": F.lag("y").over(w)}).where(F.col("lx").isNull() | (G.distance2("x", "y", "lx", "ly") > 1e-24)).drop("lx", "ly")
    p = p.withColumns({f"{k}{n}": f(k).over(w) for k in "xyz" for n, f in (("p", F.lag), ("n", F.lead))})
    ax, ay, bx, by = F.col("x") - F.col("xp"), F.col("y") - F.col("yp"), F.col("xn") - F.col("x"), F.col("yn") - F.col("y")
    la, lb, chord = F.sqrt(ax * ax + ay * ay), F.sqrt(bx * bx + by * by), F.sqrt(G.distance2("xp", "yp", "xn", "yn"))
    p = p.withColumns({"sharp": (ax * bx + ay * by) / (la * lb) < math.cos(math.radians(kink)), "bend": F.when(chord > 0, 2 * cross(ax, ay, bx, by) / (la * lb) / chord).otherwise(F.lit(0.0)), "grade": (F.col("z") - F.col("zp")) / la})
    inner = p.where("xp is not null and xn is not null")
    soft = inner.where("not sharp").select("route_id", "seq", "bend", F.coalesce(F.lag("bend").over(w), F.lit(0.0)).alias("before"), F.lead("seq").over(w).isNull().alias("final"))
    turn = soft.groupBy("route_id").agg(F.sum(F.abs(F.col("bend") - F.col("before")) + F.when(F.col("final"), F.abs("bend")).otherwise(F.lit(0.0))).alias("turn"))
    kinks = inner.where("sharp").groupBy("route_id").agg((F.count("*") * 2.0 / radius).alias("kinks"))
    grade = p.where("grade is not null").select("route_id", F.abs(F.col("grade") - F.lag("grade").over(w)).alias("step")).groupBy("route_id").agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("change"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    out = lines.select("route_id").distinct().join(turn, "route_id", "left").join(kinks, "route_id", "left").join(grade, "route_id", "left")
    return out.select("route_id", ((zero("turn") + zero("kinks")) * radius).alias("plan"), (zero("change") / limit).alias("profile"))
