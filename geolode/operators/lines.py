"""Line work: splits, conflicts, chains, trims, drapes, priorities, reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geolode.functions import geometry as G
from geolode.operators import spatial
from geolode.operators.graphs import components


def height_conflicts(segments: DataFrame, heights: DataFrame, cell: float, tolerance: float) -> DataFrame:
    """(s1, s2, x, y, gap): proper crossings at which the two lines' heights (sid, z0, z1) differ by more than a tolerance."""
    c = spatial.segment_crossings(segments, cell)
    h1 = heights.select(F.col("sid").alias("s1"), F.col("z0").alias("p0"), F.col("z1").alias("p1"))
    h2 = heights.select(F.col("sid").alias("s2"), F.col("z0").alias("q0"), F.col("z1").alias("q1"))
    gap = F.abs(G.lerp("p0", "p1", "t") - G.lerp("q0", "q1", "u"))
    return c.join(h1, "s1").join(h2, "s2").select("s1", "s2", "x", "y", gap.alias("gap")).where(F.col("gap") > tolerance)


def split_at_crossings(segments: DataFrame, cell: float) -> DataFrame:
    """(sid, part, x0, y0, x1, y1): segments cut at every proper crossing with another."""
    c = spatial.segment_crossings(segments, cell)
    cuts = c.select(F.col("s1").alias("sid"), "t").unionByName(c.select(F.col("s2").alias("sid"), F.col("u").alias("t")))
    return _split(segments, cuts)


def split_at_vertices(segments: DataFrame, vertices: DataFrame, tolerance: float, cell: float) -> DataFrame:
    """Segments cut at vertices (x, y) within a tolerance of their inside."""
    s = segments.withColumn("gx", F.explode(F.sequence(F.floor((F.least("x0", "x1") - tolerance) / cell), F.floor((F.greatest("x0", "x1") + tolerance) / cell))))
    s = s.withColumn("gy", F.explode(F.sequence(F.floor((F.least("y0", "y1") - tolerance) / cell), F.floor((F.greatest("y0", "y1") + tolerance) / cell))))
    v = vertices.select(F.col("x").alias("px"), F.col("y").alias("py"), F.floor(F.col("x") / cell).alias("gx"), F.floor(F.col("y") / cell).alias("gy"))
    length = F.sqrt(G.distance2("x0", "y0", "x1", "y1"))
    t = G.segment_parameter("px", "py", "x0", "y0", "x1", "y1")
    hit = s.join(v, ["gx", "gy"]).withColumns({"t": t, "l": length}).where((F.col("t") * F.col("l") > tolerance) & ((1 - F.col("t")) * F.col("l") > tolerance) & (G.segment_distance("px", "py", "x0", "y0", "x1", "y1") <= tolerance))
    return _split(segments, hit.select("sid", "t"))


def _split(segments: DataFrame, cuts: DataFrame) -> DataFrame:
    t = cuts.groupBy("sid").agg(F.array_sort(F.collect_set("t")).alias("t"))
    s = segments.join(t, "sid", "left").withColumn("t", F.concat(F.array(F.lit(0.0)), F.coalesce("t", F.array().cast("array<double>")), F.array(F.lit(1.0))))
    s = s.select("*", F.posexplode(F.slice("t", 1, F.size("t") - 1)).alias("part", "a")).withColumn("b", F.element_at("t", F.col("part") + 2))
    return s.select("sid", "part", *(G.lerp(f"{k}0", f"{k}1", p).alias(f"{k}{i}") for i, p in enumerate(("a", "b")) for k in "xy"))


def crossing_chains(chains: DataFrame, cell: float) -> DataFrame:
    """(chain_id) of chains (chain_id, sid, x0..y1) that properly cross another or themselves."""
    c = spatial.segment_crossings(chains.drop("chain_id"), cell)
    both = c.select(F.explode(F.array("s1", "s2")).alias("sid")).distinct()
    return chains.join(both, "sid", "left_semi").select("chain_id").distinct()


def chain_labels(edges: DataFrame) -> DataFrame:
    """(chain, n_edges, n_vertices, closed): edges (u, v) gathered into chains; one whose vertices all have two edges is a loop."""
    ends = edges.select(F.explode(F.array("u", "v")).alias("node"))
    c = components(ends.distinct(), edges.select(F.col("u").alias("a"), F.col("v").alias("b")))
    degree = ends.groupBy("node").count()
    v = c.join(degree, "node").groupBy(F.col("root").alias("chain")).agg(F.count("*").alias("n_vertices"), F.bool_and(F.col("count") == 2).alias("closed"))
    e = edges.join(c.withColumnRenamed("node", "u"), "u").groupBy(F.col("root").alias("chain")).agg(F.count("*").alias("n_edges"))
    return v.join(e, "chain").select("chain", "n_edges", "n_vertices", "closed")


def trimmed_faces(inside: DataFrame, faces: DataFrame) -> DataFrame:
    """Faces of (outer without hidden) and shown, by the areas that hold their centroid (rows fid, role)."""
    role = inside.groupBy("fid").agg(*(F.bool_or(F.col("role") == r).alias(r) for r in ("outer", "hide", "show")))
    return faces.join(role, "fid").where("(outer and not hide) or show").select("fid")


def draped(lines: DataFrame, heights: DataFrame, policy: str = "split") -> DataFrame:
    """Lines (route_id, seq, station, x, y, z) on a surface's heights (rows route_id, seq, h; null: off it).

    ``split``: a new part after each gap; ``bridge``: inner gaps are interpolated by station; ``keep``: the own height stays.
    """
    j = lines.join(heights, ["route_id", "seq"], "left")
    w = Window.partitionBy("route_id").orderBy("seq")
    if policy == "keep":
        return j.withColumn("z", F.coalesce("h", "z")).withColumn("part", F.lit(0)).drop("h")
    if policy == "bridge":
        back, on = (Window.partitionBy("route_id").orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc("seq"), F.desc("seq")))
        at = F.when(F.col("h").isNotNull(), F.col("station"))
        j = j.withColumns({"s0": F.last(at, True).over(back), "h0": F.last("h", True).over(back), "s1": F.last(at, True).over(on), "h1": F.last("h", True).over(on)})
        z = F.coalesce("h", G.lerp("h0", "h1", F.try_divide(F.col("station") - F.col("s0"), F.col("s1") - F.col("s0"))))
        return j.where("h0 is not null and h1 is not null").withColumn("z", z).withColumn("part", F.lit(0)).drop("h", "h0", "h1", "s0", "s1")
    new = F.when(F.col("h").isNotNull() & F.coalesce(F.lag("h").over(w).isNull(), F.lit(True)), 1).otherwise(0)
    return j.withColumn("part", F.sum(new).over(w).cast("int")).where("h is not null").withColumn("z", F.col("h")).drop("h")


def tie_in(station, length, ramp):
    """Weight of a change along a line: 0 at both ends, 1 from ``ramp`` on."""
    return G.clamp(F.least(G.c(station), G.c(length) - G.c(station)) / G.c(ramp), 0.0, 1.0)


def priority_order(zones: DataFrame) -> DataFrame:
    """Adds ``place``: by zone, source, ordinal; each run of entries that go by elevation is ordered by it inside (later ones win).

    A stack of zones is short: one window holds it.
    """
    w = Window.orderBy("zone_order", "source_order", "ordinal")
    z = zones.withColumn("k", F.row_number().over(w)).withColumn("new", F.coalesce((F.col("by_elevation") != F.lag("by_elevation").over(w)) | ~F.col("by_elevation"), F.lit(True)).cast("int"))
    z = z.withColumn("run", F.sum("new").over(Window.orderBy("k")))
    e = F.when(F.col("by_elevation"), F.col("elevation"))
    return z.withColumn("place", F.row_number().over(Window.orderBy("run", e, "source_order", "zone_order", "ordinal"))).drop("k", "new", "run")


def reviewed(routes: DataFrame, max_grade: float, min_radius: float, max_break: float, min_coverage: float, warn: float = 0.9) -> DataFrame:
    """(route_id, check, verdict) of curves (grade, radius, break_, coverage): pass, warn within a tenth of the limit, fail."""

    def verdict(used):
        return F.when(used > 1, "fail").when(used > warn, "warn").otherwise("pass")

    checks = [("grade", F.col("grade") / max_grade), ("radius", min_radius / F.col("radius")), ("break", F.col("break_") / max_break), ("coverage", min_coverage / F.col("coverage"))]
    return routes.select("route_id", F.explode(F.array(*[F.struct(F.lit(n).alias("check"), verdict(u).alias("verdict")) for n, u in checks])).alias("c")).select("route_id", "c.*")


def level_areas(xyz: DataFrame, edges: DataFrame, length: float, limit: float) -> DataFrame:
    """(verdict, n_faces, plan_area) of faces inside level areas (all loops together, even-odd): gradients averaged over faces within half a length."""
    nx, ny, nz = G.normal()
    f = xyz.select(F.col("fid").alias("pid"), ((F.col("ax") + F.col("bx") + F.col("cx")) / 3).alias("x"), ((F.col("ay") + F.col("by") + F.col("cy")) / 3).alias("y"), (-nx / F.when(nz != 0, nz)).alias("p"), (-ny / F.when(nz != 0, nz)).alias("q"), G.plan_area().alias("w"))
    member = f.join(spatial.points_in_rings(f, edges.withColumn("area_id", F.lit(0)), 4.0).select("pid"), "pid", "left_semi")
    r = length / 2
    near = member.withColumn("s", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])))
    near = near.select((F.floor(F.col("x") / r) + F.col("s.i")).alias("gx"), (F.floor(F.col("y") / r) + F.col("s.j")).alias("gy"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("p").alias("op"), F.col("q").alias("oq"), F.col("w").alias("ow"))
    m = member.withColumns({"gx": F.floor(F.col("x") / r), "gy": F.floor(F.col("y") / r)}).join(near, ["gx", "gy"]).where(G.distance2("x", "y", "ox", "oy") <= r * r)
    g = m.groupBy("pid").agg(F.first("w").alias("w"), (F.sum(F.col("op") * F.col("ow")) / F.sum("ow")).alias("p"), (F.sum(F.col("oq") * F.col("ow")) / F.sum("ow")).alias("q"))
    over = F.sqrt(F.col("p") * F.col("p") + F.col("q") * F.col("q")) > limit + 1e-9
    return g.groupBy(F.when(over, "exceeds").otherwise("level").alias("verdict")).agg(F.count("*").alias("n_faces"), F.sum("w").alias("plan_area"))
