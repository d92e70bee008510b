"""What is written beside a surface: heights, slopes, arrows, grades, sections; and what is set down on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geolode.functions import geometry as G
from geolode.operators import sections, spatial


def slopes_at(points: DataFrame, xyz: DataFrame, cell: float, flat_ratio: float = 0.005) -> DataFrame:
    """(pid, z, slope, bearing) of the highest face over each point (of equals the least); nulls off the surface."""
    h = spatial.faces_at(points, xyz, cell).groupBy("pid").agg(F.max(F.struct("z", (-F.col("fid")).alias("f"))).alias("m")).select("pid", F.col("m.z").alias("z"), (-F.col("m.f")).alias("fid"))
    s = xyz.select("fid", G.slope_ratio().alias("slope"), G.bearing(flat_ratio).alias("bearing"))
    return spatial.spread(points.select("pid")).join(spatial.spread(spatial.spread(h).join(spatial.spread(s), "fid").drop("fid")), "pid", "left")


def slope_arrows(xyz: DataFrame, spacing: float, cell: float, flat_ratio: float = 0.005) -> DataFrame:
    """(col, row, x, y, z, bearing, slope): the fall at the nodes of a grid, where the surface is not flat."""
    e = xyz.agg(*(f(F.least(*(F.col(f"{c}{k}") for c in "abc")) if f is F.min else F.greatest(*(F.col(f"{c}{k}") for c in "abc"))).alias(f"{k}{i}") for k in "xy" for i, f in enumerate((F.min, F.max))))
    steps = lambda k: F.sequence(F.ceil(F.col(f"{k}0") / spacing), F.floor(F.col(f"{k}1") / spacing))
    n = e.where("x0 is not null").select(F.explode(steps("x")).alias("col"), steps("y").alias("rows")).select("col", F.explode("rows").alias("row"))
    p = n.select(F.struct("col", "row").alias("pid"), (F.col("col") * spacing).alias("x"), (F.col("row") * spacing).alias("y"))
    return slopes_at(p, xyz, cell, flat_ratio).where("bearing is not null").join(spatial.spread(p), "pid").select("pid.col", "pid.row", "x", "y", "z", "bearing", "slope")


def grade_callouts(pairs: DataFrame, xyz: DataFrame, cell: float) -> DataFrame:
    """(pid, z0, z1, length, grade) between two points (pid, x0, y0, x1, y1) on the surface, uphill positive; null where an end is off it or both are one."""
    ends = pairs.select(F.explode(F.array(*[F.struct(F.struct("pid", F.lit(i).alias("i")).alias("pid"), F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y")) for i in (0, 1)])).alias("p")).select("p.*")
    h = spatial.heights_at(ends, xyz, cell).groupBy("pid.pid").agg(*(F.max(F.when(F.col("pid.i") == i, F.col("top_z"))).alias(f"z{i}") for i in (0, 1)))
    length = F.sqrt(G.distance2("x0", "y0", "x1", "y1"))
    return pairs.join(h, "pid").select("pid", "z0", "z1", length.alias("length"), F.when(length > 0, (F.col("z1") - F.col("z0")) / length).alias("grade"))


def curve_labels(lines: DataFrame, xyz: DataFrame, spacing: float, cell: float) -> DataFrame:
    """(route_id, seq, station, x, y, z, grade): heights at even stations along lines, and the grade on to the next."""
    s = sections.route_stations(lines, spacing, cell)
    h = spatial.heights_at(s.select(F.struct("route_id", "seq").alias("pid"), "x", "y"), xyz, cell).select("pid.route_id", "pid.seq", F.col("top_z").alias("z"))
    w = Window.partitionBy("route_id").orderBy("seq")
    grade = F.try_divide(F.lead("z").over(w) - F.col("z"), F.lead("station").over(w) - F.col("station"))
    return s.join(h, ["route_id", "seq"]).withColumn("grade", grade)


def cross_sections(lines: DataFrame, xyz: DataFrame, spacing: float, half_width: float, step: float, cell: float) -> DataFrame:
    """(route_id, seq, offset, x, y, z): heights across lines at even stations, from the left (negative) to the right."""
    s = sections.route_stations(lines, spacing, cell).withColumn("b", F.floor(F.col("station") / cell))
    leg = sections.legs(lines).where("s1 > s0").withColumn("b", F.explode(F.sequence(F.floor(F.col("s0") / cell), F.floor(F.col("s1") / cell))))
    run = F.col("s1") - F.col("s0")
    d = s.join(leg.drop("seq"), ["route_id", "b"]).where("station >= s0 and station <= s1").groupBy("route_id", "seq").agg(F.min_by(F.struct(((F.col("x1") - F.col("x0")) / run).alias("x"), ((F.col("y1") - F.col("y0")) / run).alias("y")), "s0").alias("d"))
    n = int(half_width / step + 1e-9)
    a = s.join(d, ["route_id", "seq"]).withColumn("k", F.explode(F.sequence(F.lit(-n), F.lit(n))))
    p = a.select(F.struct("route_id", "seq", "k").alias("pid"), (F.col("x") + F.col("k") * step * F.col("d.y")).alias("x"), (F.col("y") - F.col("k") * step * F.col("d.x")).alias("y"))
    h = spatial.heights_at(p, xyz, cell).select("pid", F.col("top_z").alias("z"))
    return p.join(h, "pid").select("pid.route_id", "pid.seq", (F.col("pid.k") * step).alias("offset"), "x", "y", "z")


def lowest_points(objects: DataFrame, xyz: DataFrame, cell: float) -> DataFrame:
    """(shape, pid, drop): for each object (shape, pid, x, y, z) the least drop that sets a corner of it on the surface, and that corner; objects off the surface stay out."""
    p = objects.select(F.struct("shape", "pid").alias("pid"), "x", "y", "z")
    h = spatial.heights_at(p, xyz, cell).where("top_z is not null").join(p, "pid").select("pid.shape", "pid.pid", (F.col("z") - F.col("top_z")).alias("drop"))
    return h.groupBy("shape").agg(F.min(F.struct("drop", "pid")).alias("m")).select("shape", "m.pid", "m.drop")


def frames_at(points: DataFrame, xyz: DataFrame, cell: float, heading: float = 0.0) -> DataFrame:
    """(pid, z, ux..uz, vx..vz, nx..nz): a right-handed frame on the highest face at each point, its first axis along a heading (degrees from x) laid into the face."""
    import math

    h = spatial.faces_at(points, xyz, cell).groupBy("pid").agg(F.max(F.struct("z", (-F.col("fid")).alias("f"))).alias("m")).select("pid", F.col("m.z").alias("z"), (-F.col("m.f")).alias("fid"))
    nx, ny, nz = G.normal()
    up = F.when(nz < 0, -1.0).otherwise(1.0)
    f = xyz.select("fid", (nx * up).alias("ax"), (ny * up).alias("ay"), (nz * up).alias("az")).where("az > 0")
    n = F.sqrt(F.col("ax") * F.col("ax") + F.col("ay") * F.col("ay") + F.col("az") * F.col("az"))
    f = f.select("fid", *((F.col(f"a{k}") / n).alias(f"n{k}") for k in "xyz"))
    c, s = math.cos(math.radians(heading)), math.sin(math.radians(heading))
    # The heading, raised to lie in the plane.
    rise = -(F.col("nx") * c + F.col("ny") * s) / F.col("nz")
    size = F.sqrt(1 + rise * rise)
    f = f.withColumns({"ux": F.lit(c) / size, "uy": F.lit(s) / size, "uz": rise / size})
    f = f.withColumns({"vx": F.col("ny") * F.col("uz") - F.col("nz") * F.col("uy"), "vy": F.col("nz") * F.col("ux") - F.col("nx") * F.col("uz"), "vz": F.col("nx") * F.col("uy") - F.col("ny") * F.col("ux")})
    return h.join(f, "fid").drop("fid")
