"""Contours, volumes between surfaces, lattice curvature and landforms, smoothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geolode.functions import geometry as G


#: Levels that go into a plan as numbers; more are joined by steps.
SMALL = 1000


def contour_segments(xyz: DataFrame, levels: DataFrame, field: tuple[str, str, str] = ("az", "bz", "cz")) -> DataFrame:
    """(fid, level, x0, y0, x1, y1) where a field over the faces passes each level (rows ``level``).

    A level counts for a face if it is above the least corner and at most the
    greatest; then just two edges are crossed. Each face takes the levels of its own span only.
    """
    fa, fb, fc = (F.col(k) for k in field)
    low, high = F.least(fa, fb, fc), F.greatest(fa, fb, fc)
    ok = xyz.where(G.finite(fa) & G.finite(fb) & G.finite(fc)).where(low < high)
    few = [x.level for x in levels.where(G.finite("level")).distinct().limit(SMALL + 1).collect()]
    if len(few) <= SMALL:
        mine = F.filter(F.array(*map(F.lit, sorted(few))).cast("array<double>"), lambda x: (x > low) & (x <= high))
        hit = ok.withColumn("level", F.explode(mine))
    else:
        span = levels.agg(F.min("level").alias("lo"), F.max("level").alias("hi"), F.count_distinct("level").alias("n")).first()
        step = max((span.hi - span.lo) / span.n, 1e-9)
        steps = F.sequence(F.floor(F.greatest(low, F.lit(span.lo)) / step), F.floor(F.least(high, F.lit(span.hi)) / step))
        wide = ok.where((high >= span.lo) & (low <= span.hi)).withColumn("_step", F.explode(steps))
        hit = wide.join(levels.distinct().withColumn("_step", F.floor(F.col("level") / step)), "_step").where((F.col("level") > low) & (F.col("level") <= high)).drop("_step")

    def crossing(p, q, fp, fq):
        t = (F.col("level") - fp) / F.when(fq != fp, fq - fp)
        at = F.struct(G.lerp(f"{p}x", f"{q}x", t).alias("x"), G.lerp(f"{p}y", f"{q}y", t).alias("y"))
        return F.when((fp < F.col("level")) != (fq < F.col("level")), at)

    hit = hit.select("fid", "level", crossing("a", "b", fa, fb).alias("ab"), crossing("b", "c", fb, fc).alias("bc"), crossing("c", "a", fc, fa).alias("ca"))
    first, second = F.coalesce("ab", "bc"), F.when(F.col("ab").isNull() | F.col("bc").isNull(), F.col("ca")).otherwise(F.col("bc"))
    return hit.select("fid", "level", *(p[k].alias(f"{k}{i}") for i, p in enumerate((first, second)) for k in "xy"))


def contour_lengths(segments: DataFrame) -> DataFrame:
    return segments.groupBy("level").agg(F.count("*").alias("n_segments"), F.sum(F.sqrt(G.distance2("x0", "y0", "x1", "y1"))).alias("length"))


def paired(xyz: DataFrame, faces: DataFrame, other: DataFrame) -> DataFrame:
    """Faces with the corner heights ``ra, rb, rc`` of a second surface on the same vertices. Where both are at hand, ``gather`` with the other's heights takes half the joins."""
    out = xyz
    for k in "abc":
        out = out.join(other.select(F.col("vid").alias(k), F.col("z").alias(f"r{k}")), k)
    return out


def cut_fill(pairs: DataFrame, exact: bool = True) -> DataFrame:
    """(fid, plan_area, fill, cut) between two surfaces: exact where the difference changes sign, or by the mean's sign (prisms)."""
    da, db, dc = (F.col(f"{k}z") - F.col(f"r{k}") for k in "abc")
    area = G.plan_area()
    if exact:
        fill, cut = G.linear_cut_fill(area, da, db, dc)
    else:
        v = area * (da + db + dc) / 3
        fill, cut = F.greatest(v, F.lit(0.0)), F.greatest(-v, F.lit(0.0))
    return pairs.select("*", area.alias("plan_area"), fill.alias("fill"), cut.alias("cut"))


def volume_totals(measured: DataFrame, *by: str) -> DataFrame:
    """Cut, fill and net (cut less fill), by keys."""
    g = measured.groupBy(*by) if by else measured.groupBy()
    return g.agg(F.count("*").alias("n_faces"), F.sum("plan_area").alias("plan_area"), F.sum("cut").alias("cut"), F.sum("fill").alias("fill"), (F.sum("cut") - F.sum("fill")).alias("net"))


def derivatives(vertices: DataFrame) -> DataFrame:
    """First and second differences p, q, r, s, t of a lattice of unit cells, at its inner nodes.

    Neighbours are found by an equality each, so a node's row or column never gathers in one task.
    """
    shifts = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
    near = vertices.select(F.explode(F.array(*[F.struct((F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"), F.lit(i).alias("i"), F.col("z")) for i, (dx, dy) in enumerate(shifts)])).alias("n")).select("n.*")
    z = near.groupBy("x", "y").agg(*(F.max(F.when(F.col("i") == i, F.col("z"))).alias(f"z{i}") for i in range(9)), F.count("*").alias("n")).where("n = 9")
    at = {s: F.col(f"z{i}") for i, s in enumerate(shifts)}
    full = vertices.select("vid", "x", "y").join(z, ["x", "y"])
    p, q = (at[1, 0] - at[-1, 0]) / 2, (at[0, 1] - at[0, -1]) / 2
    r, t = at[1, 0] - 2 * at[0, 0] + at[-1, 0], at[0, 1] - 2 * at[0, 0] + at[0, -1]
    s = (at[1, 1] - at[1, -1] - at[-1, 1] + at[-1, -1]) / 4
    return full.select("vid", "x", "y", p.alias("p"), q.alias("q"), r.alias("r"), s.alias("s"), t.alias("t"))


def curvatures(d: DataFrame) -> DataFrame:
    v = ("p", "q", "r", "s", "t")
    k1, k2 = G.principal_curvatures(*v)
    return d.select("vid", G.mean_curvature(*v).alias("mean"), G.gaussian_curvature(*v).alias("gaussian"), k1.alias("k1"), k2.alias("k2"), G.profile_curvature(*v).alias("profile"), G.plan_curvature(*v).alias("plan"))


def landforms(curved: DataFrame, tolerance: float, length: float) -> DataFrame:
    """(landform, n) by mean curvature against the threshold of a landform of this size."""
    t = G.curvature_threshold(tolerance, length)
    kind = F.when(F.col("mean") > t, "convex").when(F.col("mean") < -t, "concave").otherwise("planar")
    return curved.groupBy(kind.alias("landform")).agg(F.count("*").alias("n"))


def smoothed(vertices: DataFrame, neighbours: DataFrame, held: DataFrame, rounds: int, strength: float) -> DataFrame:
    """Heights after Jacobi rounds towards the neighbours' mean, kept in the neighbours' range; held vertices (rows ``vid``) stay."""
    from geolode.plans.lineage import materialized

    z = vertices.join(held.select("vid", F.lit(True).alias("held")), "vid", "left").select("vid", "x", "y", "z", F.coalesce("held", F.lit(False)).alias("held"))
    for _ in range(rounds):
        ring = neighbours.join(z.select(F.col("vid").alias("nid"), F.col("z").alias("nz")), "nid").groupBy("vid").agg(F.avg("nz").alias("m"), F.min("nz").alias("lo"), F.max("nz").alias("hi"))
        moved = F.col("z") + F.lit(strength) * (F.col("m") - F.col("z"))
        new = F.when(F.col("held") | F.col("m").isNull(), F.col("z")).otherwise(G.clamp(moved, "lo", "hi"))
        z = materialized(z.join(ring, "vid", "left").select("vid", "x", "y", new.alias("z"), "held"))
    return z.drop("held")


def lattice_flow(xyz: DataFrame, neighbours: DataFrame, flat_ratio: float = 0.005) -> DataFrame:
    """(fid, flows_to): the face across the edge that the fall from the centroid leaves by.

    -1: over the border; -2: flat, or no edge to leave by.
    """
    nx, ny, nz = G.normal()
    cx, cy = (F.col("ax") + F.col("bx") + F.col("cx")) / 3, (F.col("ay") + F.col("by") + F.col("cy")) / 3
    m = xyz.select("*", (nx / F.when(nz != 0, nz)).alias("dx"), (ny / F.when(nz != 0, nz)).alias("dy"), (F.abs(nz) <= 1e-14).alias("steep"), cx.alias("mx"), cy.alias("my"), G.slope_ratio().alias("ratio"))

    def reach(p, q):
        ex, ey = F.col(f"{q}x") - F.col(f"{p}x"), F.col(f"{q}y") - F.col(f"{p}y")
        den = G.cross("dx", "dy", ex, ey)
        wx, wy = F.col(f"{p}x") - F.col("mx"), F.col(f"{p}y") - F.col("my")
        t = G.cross(wx, wy, ex, ey) / F.when(den != 0, den)
        return F.when(t > 0, t)

    t = [reach("a", "b"), reach("b", "c"), reach("c", "a")]
    # From inside a triangle the nearest crossing ahead, of the three lines, is the edge left by.
    m = m.withColumns({f"t{i}": x for i, x in enumerate(t)})
    first = F.least("t0", "t1", "t2")
    edge = F.when(F.col("t0") == first, 0).when(F.col("t1") == first, 1).when(F.col("t2") == first, 2)
    m = m.select("fid", F.when(F.col("steep") | (F.col("ratio") <= flat_ratio), F.lit(None)).otherwise(edge).alias("edge"))
    to = F.when(F.col("edge") == 0, F.col("n0")).when(F.col("edge") == 1, F.col("n1")).when(F.col("edge") == 2, F.col("n2"))
    return m.join(neighbours, "fid").select("fid", F.coalesce(to, F.lit(-2)).alias("flows_to"))


def smoothing_violations(before: DataFrame, after: DataFrame, neighbours: DataFrame, held: DataFrame, rounds: int, tolerance: float) -> DataFrame:
    """(vid, kind, amount) of vertices that smoothing should not have put where they are: ``held`` ones that moved, others beyond the range of heights within ``rounds`` edges."""
    from geolode.plans.lineage import materialized

    both = neighbours.select("vid", "nid").unionByName(neighbours.select("vid").distinct().select("vid", F.col("vid").alias("nid")))
    span = materialized(before.select("vid", F.col("z").alias("lo"), F.col("z").alias("hi")))
    for _ in range(max(0, rounds)):
        near = both.join(span.withColumnRenamed("vid", "nid"), "nid").groupBy("vid").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        span = materialized(near)
    j = before.select("vid", F.col("z").alias("z0")).join(after.select("vid", F.col("z").alias("z1")), "vid").join(span, "vid", "left").join(held.select("vid", F.lit(True).alias("held")), "vid", "left")
    moved = F.abs(F.col("z1") - F.col("z0"))
    out = F.greatest(F.col("z1") - F.coalesce("hi", "z0"), F.coalesce("lo", "z0") - F.col("z1"))
    kind = F.when(F.col("held") & (moved > tolerance), "held").when(F.col("held").isNull() & (out > tolerance), "extreme")
    return j.select("vid", kind.alias("kind"), F.when(F.col("held"), moved).otherwise(out).alias("amount")).where("kind is not null")


def contours_updated(segments: DataFrame, xyz: DataFrame, changed: DataFrame, levels: DataFrame) -> DataFrame:
    """Contour segments after the heights of some vertices (rows vid) changed: only faces with such a corner are traced again (``xyz`` has the new heights)."""
    corner = xyz.select("fid", F.explode(F.array("a", "b", "c")).alias("vid"))
    again = corner.join(changed.select("vid").distinct(), "vid", "left_semi").select("fid").distinct()
    return segments.join(again, "fid", "left_anti").unionByName(contour_segments(xyz.join(again, "fid", "left_semi"), levels))


def landform_areas(xyz: DataFrame, curved: DataFrame, tolerance: float, length: float) -> DataFrame:
    """(landform, n_faces, plan_area) of faces by the mean of their corners' curvatures; those with a corner that has none are ``unmeasured``. A total row is null."""
    t = G.curvature_threshold(tolerance, length)
    corner = xyz.select("fid", G.plan_area().alias("area"), F.explode(F.array("a", "b", "c")).alias("vid")).join(curved.select("vid", "mean"), "vid", "left")
    f = corner.groupBy("fid").agg(F.max("area").alias("area"), F.sum("mean").alias("s"), F.count("mean").alias("n"))
    h = F.when(F.col("n") == 3, F.col("s") / 3)
    kind = F.when(h.isNull(), "unmeasured").when(h > t, "convex").when(h < -t, "concave").otherwise("planar")
    return f.select(kind.alias("landform"), "area").rollup("landform").agg(F.count("*").alias("n_faces"), F.sum("area").alias("plan_area"))
