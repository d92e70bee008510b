"""Spatial joins by equality on buckets: no pair of things far apart is ever looked at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geolode.functions import geometry as G


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` for a join by shuffles.

    The planner takes exploded rows for as few as they came from, and would send
    a table of any size through the driver to every executor.
    """
    return rows.hint("merge")


def _cells(lo: Column, hi: Column, size: float) -> Column:
    return F.explode(F.sequence(F.floor(lo / size), F.floor(hi / size)))


def points_in_rings(points: DataFrame, edges: DataFrame, band: float) -> DataFrame:
    """(pid, area_id) of points inside rings given as edges (area_id, x0, y0, x1, y1), by even-odd count.

    A point meets the edges of its own band of y only; holes are edges like others.
    """
    e = edges.where("y0 != y1").withColumn("band", _cells(F.least("y0", "y1"), F.greatest("y0", "y1"), band))
    p = points.select("pid", "x", "y", F.floor(F.col("y") / band).alias("band"))
    hit = p.join(e, "band").where(G.ray_crosses("x", "y", "x0", "y0", "x1", "y1"))
    return hit.groupBy("pid", "area_id").agg(F.count("*").alias("n")).where("n % 2 = 1").select("pid", "area_id")


def ring_distance(points: DataFrame, edges: DataFrame, reach: float) -> DataFrame:
    """(pid, area_id, distance) to the nearest edge of each area within reach."""
    e = edges.withColumns({"gx0": F.floor((F.least("x0", "x1") - reach) / reach), "gx1": F.floor((F.greatest("x0", "x1") + reach) / reach)})
    e = e.withColumn("gx", F.explode(F.sequence("gx0", "gx1"))).withColumn("gy", _cells(F.least("y0", "y1") - reach, F.greatest("y0", "y1") + reach, reach))
    p = points.select("pid", "x", "y", F.floor(F.col("x") / reach).alias("gx"), F.floor(F.col("y") / reach).alias("gy"))
    d = G.segment_distance("x", "y", "x0", "y0", "x1", "y1")
    return p.join(e, ["gx", "gy"]).groupBy("pid", "area_id").agg(F.min(d).alias("distance")).where(F.col("distance") <= reach)


def faces_at(points: DataFrame, xyz: DataFrame, cell: float) -> DataFrame:
    """(pid, fid, z): the faces over each point, border included, with their plane's height there."""
    low, high = (lambda k: F.least(f"a{k}", f"b{k}", f"c{k}")), (lambda k: F.greatest(f"a{k}", f"b{k}", f"c{k}"))
    f = xyz.withColumn("gx", _cells(low("x"), high("x"), cell)).withColumn("gy", _cells(low("y"), high("y"), cell))
    p = points.select("pid", F.col("x").alias("px"), F.col("y").alias("py"), F.floor(F.col("x") / cell).alias("gx"), F.floor(F.col("y") / cell).alias("gy"))
    hit = spread(p).join(spread(f), ["gx", "gy"]).where(G.in_triangle("px", "py"))
    return hit.select("pid", "fid", G.plane_height("px", "py").alias("z")).where("z is not null")


def heights_at(points: DataFrame, xyz: DataFrame, cell: float, tolerance: float = 1e-6) -> DataFrame:
    """(pid, low_z, top_z, status): lowest and highest sheet at each point, and whether one height will do."""
    h = faces_at(points, xyz, cell).groupBy("pid").agg(F.min("z").alias("low_z"), F.max("z").alias("top_z"))
    status = F.when(F.col("top_z").isNull(), "outside").when(F.col("top_z") - F.col("low_z") > 4 * tolerance, "ambiguous").otherwise("projected")
    return points.select("pid").join(h, "pid", "left").select("pid", "low_z", "top_z", status.alias("status"))


def nearest_vertex(points: DataFrame, vertices: DataFrame, reach: float) -> DataFrame:
    """(pid, vid, distance) to the nearest vertex within reach; of equals the least vid."""
    near = [F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
    v = vertices.withColumn("s", F.explode(F.array(*near))).select("vid", F.col("x").alias("vx"), F.col("y").alias("vy"), (F.floor(F.col("x") / reach) + F.col("s.dx")).alias("gx"), (F.floor(F.col("y") / reach) + F.col("s.dy")).alias("gy"))
    p = points.select("pid", "x", "y", F.floor(F.col("x") / reach).alias("gx"), F.floor(F.col("y") / reach).alias("gy"))
    d = G.distance2("x", "y", "vx", "vy")
    hit = p.join(v, ["gx", "gy"]).withColumn("d", d).where(F.col("d") <= reach * reach)
    best = hit.groupBy("pid").agg(F.min(F.struct("d", "vid")).alias("b"))
    return best.select("pid", F.col("b.vid").alias("vid"), F.sqrt("b.d").alias("distance"))


def segment_crossings(segments: DataFrame, cell: float) -> DataFrame:
    """(s1, s2, x, y, t, u): proper crossings of segments (sid, x0, y0, x1, y1); each pair once, though its buckets are many."""
    s = segments.withColumn("gx", _cells(F.least("x0", "x1"), F.greatest("x0", "x1"), cell)).withColumn("gy", _cells(F.least("y0", "y1"), F.greatest("y0", "y1"), cell))
    other = s.select(F.col("sid").alias("s2"), *(F.col(k).alias(f"o{k}") for k in ("x0", "y0", "x1", "y1")), "gx", "gy")
    hit = s.withColumnRenamed("sid", "s1").join(other, ["gx", "gy"]).where((F.col("s1") < F.col("s2")) & G.segments_cross_strictly("x0", "y0", "x1", "y1", "ox0", "oy0", "ox1", "oy1"))
    den = G.cross(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("ox1") - F.col("ox0"), F.col("oy1") - F.col("oy0"))
    t = G.cross(F.col("ox0") - F.col("x0"), F.col("oy0") - F.col("y0"), F.col("ox1") - F.col("ox0"), F.col("oy1") - F.col("oy0")) / den
    u = G.cross(F.col("ox0") - F.col("x0"), F.col("oy0") - F.col("y0"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / den
    x, y = G.lerp("x0", "x1", t), G.lerp("y0", "y1", t)
    # A crossing lies in one cell: keep the pair there only.
    hit = hit.select("s1", "s2", x.alias("x"), y.alias("y"), t.alias("t"), u.alias("u"), "gx", "gy")
    return hit.groupBy("s1", "s2").agg(F.first("x").alias("x"), F.first("y").alias("y"), F.first("t").alias("t"), F.first("u").alias("u"))


def clipped_to_box(segments: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Segments (sid, x0..y1) cut to a rectangle, with their parameters t0 < t1; those outside drop out."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")

    def span(p, d, lo, hi):
        a, b = (F.lit(lo) - F.col(p)) / F.when(d != 0, d), (F.lit(hi) - F.col(p)) / F.when(d != 0, d)
        inside = F.col(p).between(lo, hi)
        enter = F.when(d != 0, F.least(a, b)).otherwise(F.when(inside, 0.0).otherwise(2.0))
        leave = F.when(d != 0, F.greatest(a, b)).otherwise(F.when(inside, 1.0).otherwise(-1.0))
        return enter, leave

    ex, lx = span("x0", dx, x0, x1)
    ey, ly = span("y0", dy, y0, y1)
    s = segments.withColumns({"t0": F.greatest(F.lit(0.0), ex, ey), "t1": F.least(F.lit(1.0), lx, ly)}).where("t0 < t1")
    return s.select("sid", "t0", "t1", G.lerp("x0", "x1", "t0").alias("cx0"), G.lerp("y0", "y1", "t0").alias("cy0"), G.lerp("x0", "x1", "t1").alias("cx1"), G.lerp("y0", "y1", "t1").alias("cy1"))


def in_rectangles(rows: DataFrame, x: str, y: str, zones: DataFrame, cell: float = 16.0) -> DataFrame:
    """Rows joined with the rectangles (zone_id, x0, y0, x1, y1, half open) that hold their place, cell by cell."""
    z = zones.where("x0 < x1 and y0 < y1").withColumn("_gx", _cells(F.col("x0"), F.col("x1"), cell)).withColumn("_gy", _cells(F.col("y0"), F.col("y1"), cell))
    r = rows.withColumns({"_gx": F.floor(F.col(x) / cell), "_gy": F.floor(F.col(y) / cell)})
    inside = (F.col(x) >= F.col("x0")) & (F.col(x) < F.col("x1")) & (F.col(y) >= F.col("y0")) & (F.col(y) < F.col("y1"))
    return r.join(z, ["_gx", "_gy"]).where(inside).drop("_gx", "_gy")


def zone_of(points: DataFrame, zones: DataFrame) -> DataFrame:
    """(pid, zone_id): of the rectangles that hold a point, the one of highest priority, then of highest id."""
    hit = in_rectangles(points, "x", "y", zones)
    return hit.groupBy("pid").agg(F.max(F.struct("priority", "zone_id")).alias("z")).select("pid", "z.zone_id")


def ring_edges(rings: DataFrame) -> DataFrame:
    """Edges of closed rings (area_id, ring_id, seq, x, y)."""
    w = Window.partitionBy("area_id", "ring_id").orderBy("seq")
    first = Window.partitionBy("area_id", "ring_id")
    nx, ny = F.coalesce(F.lead("x").over(w), F.min_by("x", "seq").over(first)), F.coalesce(F.lead("y").over(w), F.min_by("y", "seq").over(first))
    return rings.select("area_id", "ring_id", "seq", F.col("x").alias("x0"), F.col("y").alias("y0"), nx.alias("x1"), ny.alias("y1"))


def ring_areas(rings: DataFrame) -> DataFrame:
    """(area_id, ring_id, signed_area) by the shoelace rule."""
    e = ring_edges(rings)
    return e.groupBy("area_id", "ring_id").agg((F.sum(G.cross("x0", "y0", "x1", "y1")) / 2).alias("signed_area"))


#: Points of the first share that ``deduplicated`` settles, and how many times as many come before the next one's end.
FIRST, GROWTH = 20_000, 6


def _near(p: DataFrame, q: DataFrame, tolerance: float) -> DataFrame:
    """Points with those of ``q`` (their rank as ``before``) that come earlier and that they may merge into."""
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    q = q.withColumn("s", around).select((F.col("gx") + F.col("s.i")).alias("gx"), (F.col("gy") + F.col("s.j")).alias("gy"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("z").alias("oz"), F.col("rank").alias("before"))
    dz = F.col("z") - F.col("oz")
    near = (G.distance2("x", "y", "ox", "oy") < tolerance * tolerance) & (F.col("rank.late") | (dz * dz < tolerance * tolerance))
    return p.join(spread(q), ["gx", "gy"]).where((F.col("before") < F.col("rank")) & near)


def _settled(p: DataFrame, tolerance: float) -> DataFrame:
    """(rank, kept) of points none of which has a kept neighbour elsewhere: each round settles every point whose earlier neighbours are settled."""
    from geolode.plans.lineage import materialized

    pairs = materialized(_near(p, p, tolerance).select("rank", "before"))
    state = materialized(p.select("rank", F.lit(None).cast(p.schema["rank"].dataType).alias("kept")))
    settled = state.limit(0)
    while True:
        seen = pairs.join(settled.select(F.col("rank").alias("before"), F.col("kept")), "before", "left")
        seen = seen.groupBy("rank").agg(F.min(F.when(F.col("kept") == F.col("before"), F.col("before"))).alias("into"), F.min(F.when(F.col("kept").isNull(), F.col("before"))).alias("open"))
        now = state.join(seen, "rank", "left")
        # A kept neighbour takes the point once no earlier one is open; without open ones and kept ones it stays.
        done = F.when(F.col("into").isNotNull() & (F.col("open").isNull() | (F.col("into") < F.col("open"))), F.col("into")).when(F.col("into").isNull() & F.col("open").isNull(), F.col("rank"))
        now = materialized(now.select("rank", done.alias("kept")))
        settled = settled.unionByName(now.where("kept is not null"))
        state = now.where("kept is null")
        if state.limit(1).count() == 0:
            return settled
        settled = materialized(settled)


def deduplicated(points: DataFrame, tolerance: float) -> DataFrame:
    """(pid, kept_as): points in order, each merged into the first kept one strictly within a tolerance, or kept itself.

    The order is breaklines' points (``line``) before others, then ``pid``. Points of
    breaklines merge with one another only if their heights are within the tolerance too;
    others merge by plan alone, with anything. Nulls and other coordinates that are no
    numbers drop out. Many points are settled share by share in their order, each a few
    times larger than those before: a point with a kept neighbour in an earlier share
    merges into the first such, and only the others are held against one another.
    """
    from geolode.plans.lineage import materialized

    tolerance = max(tolerance, 1e-12)
    p = points.where(G.finite("x") & G.finite("y") & G.finite("z")).select("pid", "x", "y", "z", F.struct((~F.coalesce("line", F.lit(False))).alias("late"), F.col("pid").alias("id")).alias("rank"))
    p = materialized(p.withColumns({"gx": F.floor(F.col("x") / tolerance), "gy": F.floor(F.col("y") / tolerance)}).drop("pid"))
    n = p.count()
    # Any borders give the same result; they are cut from the ids of a sample's size that the driver can hold.
    shares, upto = [], FIRST
    while upto < n:
        shares.append(upto / n)
        upto *= GROWTH
    ends = []
    if shares:
        some = sorted(tuple(r.rank) for r in p.select("rank").where("rank.id is not null").sample(fraction=min(1.0, 20_000 / n), seed=7).collect())
        ends = sorted({some[int(s * len(some))] for s in shares}) if some else []
    kind = p.schema["rank"].dataType
    here = [F.struct(F.lit(late).cast(kind["late"].dataType).alias("late"), F.lit(i).cast(kind["id"].dataType).alias("id")) for late, i in ends]
    out = kept = None
    for lo, hi in zip([None, *here], [*here, None], strict=True):
        part = p.where((F.lit(True) if lo is None else F.col("rank") >= lo) & (F.lit(True) if hi is None else F.col("rank") < hi))
        if kept is None:
            now = _settled(part, tolerance)
        else:
            taken = materialized(_near(part, kept, tolerance).groupBy("rank").agg(F.min("before").alias("kept")))
            now = taken.unionByName(_settled(materialized(part.join(taken.select("rank"), "rank", "left_anti")), tolerance))
        now = materialized(now)
        out = now if out is None else out.unionByName(now)
        stay = p.join(now.where("rank = kept").select("rank"), "rank", "left_semi")
        kept = materialized(stay if kept is None else kept.unionByName(stay))
    return out.select(F.col("rank.id").alias("pid"), F.col("kept.id").alias("kept_as"))
