"""Edits of heights: conform, displace, pads, paths, brushes, batters; masks that weigh them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolode.functions import geometry as G
from geolode.operators import spatial


def influence(points: DataFrame, edges: DataFrame, feather: float, band: float = 4.0) -> DataFrame:
    """(pid, weight) of protected areas (edges as in rings): 0 inside any, then smoothly up to 1 at ``feather`` from the nearest."""
    inside = spatial.points_in_rings(points, edges, band).select("pid").distinct().withColumn("inside", F.lit(True))
    near = spatial.ring_distance(points, edges, feather).groupBy("pid").agg(F.min("distance").alias("d"))
    w = F.when(F.col("inside"), 0.0).when(F.col("d").isNull(), 1.0).otherwise(G.smoothstep(F.col("d") / feather))
    return points.select("pid").join(inside, "pid", "left").join(near, "pid", "left").select("pid", w.alias("weight"))


def within(points: DataFrame, edges: DataFrame, margin: float, band: float = 4.0) -> DataFrame:
    """(pid) of points inside any area or within a margin of one; every point where there are no areas."""
    if not edges.limit(1).count():
        return points.select("pid")
    inside = spatial.points_in_rings(points, edges, band).select("pid")
    if margin > 0:
        inside = inside.unionByName(spatial.ring_distance(points, edges, margin).select("pid"))
    return points.select("pid").join(inside.distinct(), "pid", "left_semi")


def scatter_mask(points: DataFrame, regions: DataFrame, exclusions: DataFrame, clearance: float, setback: float, feather: float) -> DataFrame:
    """(pid, probability) of points that may be planted: inside a region, clear of exclusions, thinned towards its edge."""
    inside = spatial.points_in_rings(points, regions, 4.0).select("pid").distinct()
    barred = spatial.points_in_rings(points, exclusions, 4.0).select("pid").unionByName(spatial.ring_distance(points, exclusions, clearance).where(F.col("distance") < clearance).select("pid"))
    p = points.join(inside, "pid", "left_semi").join(barred.distinct(), "pid", "left_anti")
    edge = spatial.ring_distance(p, regions, setback + feather).groupBy("pid").agg(F.min("distance").alias("d"))
    prob = F.when(F.col("d").isNull(), 1.0).when(F.col("d") < setback, 0.0).otherwise(G.clamp((F.col("d") - setback) / feather, 0.0, 1.0))
    return p.select("pid").join(edge, "pid", "left").select("pid", prob.alias("probability"))


def conformed(vertices: DataFrame, target: DataFrame, strength: float, weight: Column | None = None) -> DataFrame:
    """Heights moved towards a target's (rows vid, target_z); vertices without one stay."""
    w = F.lit(1.0) if weight is None else weight
    return vertices.join(target, "vid", "left").withColumn("z", F.when(F.col("target_z").isNotNull(), F.col("z") + strength * w * (F.col("target_z") - F.col("z"))).otherwise(F.col("z"))).drop("target_z")


def padded(vertices: DataFrame, edges: DataFrame, pads: DataFrame, reach: float) -> DataFrame:
    """(vid, z, branch): a pad's height inside it, and batters (cut 1 up, fill -1 down, at most to the ground) around.

    ``pads`` has area_id, pad_z and batter (run to rise). Of several pads the one of least id inside, else of nearest edge, rules.
    """
    p = vertices.select(F.col("vid").alias("pid"), "x", "y", "z")
    inside = spatial.points_in_rings(p, edges, 4.0).join(F.broadcast(pads), "area_id").groupBy("pid").agg(F.min_by("pad_z", "area_id").alias("in_z"))
    near = spatial.ring_distance(p, edges, reach).join(F.broadcast(pads), "area_id").groupBy("pid").agg(F.min_by(F.struct("pad_z", "batter", "distance"), F.struct("distance", "area_id")).alias("n"))
    j = p.join(inside, "pid", "left").join(near, "pid", "left")
    rise = F.col("n.distance") / F.col("n.batter")
    cut = F.col("z") > F.col("n.pad_z")
    slope_z = F.when(cut, F.least(F.col("z"), F.col("n.pad_z") + rise)).otherwise(F.greatest(F.col("z"), F.col("n.pad_z") - rise))
    new = F.when(F.col("in_z").isNotNull(), F.col("in_z")).when(F.col("n").isNotNull(), slope_z).otherwise(F.col("z"))
    j = j.select(F.col("pid").alias("vid"), "z", new.alias("new"))
    return j.select("vid", F.col("new").alias("z"), batter_branch(F.col("z"), F.col("new"), 1e-9).alias("branch"))


def batter_branch(ground: Column, design: Column, tolerance: float) -> Column:
    """1 where the design cuts into the ground, -1 where it fills, 0 at grade."""
    return F.when(ground - design > tolerance, 1).when(design - ground > tolerance, -1).otherwise(0)


def corridor(vertices: DataFrame, legs: DataFrame, half_width: float, batter: float, reach: float) -> DataFrame:
    """(vid, z): the height of the nearest leg within the corridor, batters beyond it up to ``reach``."""
    e = legs.where("s1 > s0")
    e = e.withColumn("gx", F.explode(F.sequence(F.floor((F.least("x0", "x1") - reach) / reach), F.floor((F.greatest("x0", "x1") + reach) / reach))))
    e = e.withColumn("gy", F.explode(F.sequence(F.floor((F.least("y0", "y1") - reach) / reach), F.floor((F.greatest("y0", "y1") + reach) / reach)))).select("route_id", "seq", "gx", "gy", "x0", "y0", "z0", "x1", "y1", "z1")
    v = vertices.select("vid", "x", "y", "z", F.floor(F.col("x") / reach).alias("gx"), F.floor(F.col("y") / reach).alias("gy"))
    t = G.segment_parameter_clamped("x", "y", "x0", "y0", "x1", "y1")
    hit = v.join(e, ["gx", "gy"]).withColumns({"d": G.segment_distance("x", "y", "x0", "y0", "x1", "y1"), "lz": G.lerp("z0", "z1", t)}).where(F.col("d") <= reach)
    best = hit.groupBy("vid").agg(F.min(F.struct("d", "route_id", "seq", "lz")).alias("b"))
    j = vertices.select("vid", "z").join(best, "vid", "left")
    rise = F.greatest(F.lit(0.0), F.col("b.d") - half_width) / batter
    side = F.when(F.col("z") > F.col("b.lz"), F.least(F.col("z"), F.col("b.lz") + rise)).otherwise(F.greatest(F.col("z"), F.col("b.lz") - rise))
    return j.select("vid", F.when(F.col("b").isNull(), F.col("z")).when(F.col("b.d") <= half_width, F.col("b.lz")).otherwise(side).alias("z"))


def brushed(vertices: DataFrame, x: float, y: float, radius: float, amount: float, kind: str = "smooth") -> DataFrame:
    """Heights after one dab of a brush."""
    d = F.sqrt(G.distance2("x", "y", x, y)) / radius
    return vertices.withColumn("z", F.when(d <= 1, F.col("z") + amount * G.falloff(kind, d)).otherwise(F.col("z")))


def displaced(vertices: DataFrame, offset: Column, weight: Column) -> DataFrame:
    return vertices.withColumn("z", F.col("z") + weight * offset)


def balance(net_at, low: float, high: float, target: float = 0.0, tolerance: float = 1e-6, rounds: int = 60) -> tuple[float, float]:
    """The level at which a falling or rising net volume meets a target, by bisection; (level, net there).

    ``net_at`` runs one aggregate a round. The bracket's nearer end is returned where the target lies outside it.
    """
    f_low, f_high = net_at(low) - target, net_at(high) - target
    if f_low * f_high > 0:
        return (low, f_low + target) if abs(f_low) <= abs(f_high) else (high, f_high + target)
    for _ in range(rounds):
        mid = (low + high) / 2
        f = net_at(mid) - target
        if abs(f) <= tolerance:
            return mid, f + target
        if f_low * f <= 0:
            high = mid
        else:
            low, f_low = mid, f
    return (low + high) / 2, f + target
