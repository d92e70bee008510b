"""Face tables: gathering, validity, slope, aspect and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolode.functions import geometry as G
from geolode.operators import spatial


def gather(faces: DataFrame, vertices: DataFrame, other: str | None = None) -> DataFrame:
    """Faces with their corners' coordinates, and as ``ra, rb, rc`` another column of theirs. Faces with unknown or repeated vertices drop out."""
    out = faces.where("a != b and b != c and a != c")
    for k in "abc":
        v = vertices.select(F.col("vid").alias(k), *(F.col(x).alias(f"{k}{x}") for x in "xyz"), *([F.col(other).alias(f"r{k}")] if other else []))
        out = spatial.spread(out).join(spatial.spread(v), k)
    return out


def invalid(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(fid, reason) of faces that a mesh may not have: repeated corners, unknown corners, coordinates that are no numbers."""
    repeated = faces.where("a = b or b = c or a = c").select("fid", F.lit("repeated").alias("reason"))
    corners = faces.select("fid", F.explode(F.array("a", "b", "c")).alias("vid"))
    seen = corners.join(vertices, "vid", "left")
    unknown = seen.where("x is null or y is null or z is null").select("fid", F.lit("unknown").alias("reason")).distinct()
    odd = seen.where(~(G.finite("x") & G.finite("y") & G.finite("z"))).select("fid", F.lit("not finite").alias("reason")).distinct()
    return repeated.unionByName(unknown).unionByName(odd)


def measured(xyz: DataFrame) -> DataFrame:
    """Adds areas, slope, centroid and bearing."""
    return xyz.withColumns({"plan_area": G.plan_area(), "surface_area": G.surface_area(), "slope": G.slope_ratio(), "cx_": (F.col("ax") + F.col("bx") + F.col("cx")) / 3, "cy_": (F.col("ay") + F.col("by") + F.col("cy")) / 3, "cz_": (F.col("az") + F.col("bz") + F.col("cz")) / 3})


def slope_summary(xyz: DataFrame, unit: str) -> DataFrame:
    """Least, greatest and mean slope in a unit, the mean by true area; faces that are vertical stay out."""
    m = xyz.select(G.slope_in(G.slope_ratio(), unit).alias("s"), G.surface_area().alias("w"), G.slope_ratio().alias("r")).where(G.finite("r"))
    return m.agg(F.count("*").alias("n_faces"), F.coalesce(F.min("s"), F.lit(0.0)).alias("min_slope"), F.coalesce(F.max("s"), F.lit(0.0)).alias("max_slope"), F.coalesce(F.try_divide(F.sum(F.col("s") * F.col("w")), F.sum("w")), F.lit(0.0)).alias("mean_slope"))


def aspect_summary(xyz: DataFrame, flat_ratio: float = 0.0) -> DataFrame:
    """Mean bearing by plan area (of unit vectors, null if they cancel), and how much is flat."""
    m = xyz.select(G.bearing(flat_ratio).alias("b"), G.plan_area().alias("w"))
    east, north = F.sum(F.when(F.col("b").isNotNull(), F.sin(F.radians("b")) * F.col("w"))), F.sum(F.when(F.col("b").isNotNull(), F.cos(F.radians("b")) * F.col("w")))
    s = m.agg(F.count("*").alias("n_faces"), F.count_if(F.col("b").isNull()).alias("n_flat"), F.coalesce(F.sum(F.when(F.col("b").isNull(), F.col("w"))), F.lit(0.0)).alias("flat_area"), east.alias("e"), north.alias("n"))
    mean = F.when((F.col("e") != 0) | (F.col("n") != 0), F.pmod(F.degrees(F.atan2("e", "n")), F.lit(360.0)))
    return s.select("n_faces", "n_flat", "flat_area", mean.alias("mean_bearing"))


def aspect_sectors(xyz: DataFrame, flat_ratio: float = 0.0) -> DataFrame:
    """Faces and plan area of each compass sector, ``flat`` among them."""
    m = xyz.select(G.bearing(flat_ratio).alias("b"), G.plan_area().alias("w"))
    return m.groupBy(F.coalesce(G.sector("b"), F.lit("flat")).alias("sector")).agg(F.count("*").alias("n_faces"), F.sum("w").alias("plan_area"))


def by_zone(xyz: DataFrame, zones: DataFrame, unit: str = "percent") -> DataFrame:
    """Zone table: areas, heights and slopes of the faces whose centroid lies in each zone. Vertical faces have no slope."""
    m = measured(xyz)
    m = spatial.in_rectangles(m, "cx_", "cy_", zones)
    s = F.when(G.finite("slope"), G.slope_in("slope", unit))
    w = F.when(G.finite("slope"), F.col("plan_area"))
    low, high = F.least("az", "bz", "cz"), F.greatest("az", "bz", "cz")
    return m.groupBy("zone_id").agg(F.count("*").alias("n_faces"), F.sum("plan_area").alias("plan_area"), F.sum("surface_area").alias("surface_area"), F.min(low).alias("min_z"), F.try_divide(F.sum(F.col("cz_") * F.col("plan_area")), F.sum("plan_area")).alias("mean_z"), F.max(high).alias("max_z"), F.min(s).alias("min_slope"), F.try_divide(F.sum(s * w), F.sum(w)).alias("mean_slope"), F.max(s).alias("max_slope"))
