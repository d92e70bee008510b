"""Triangulation of points: Delaunay by tiles, with lines worked in and outlines cut out."""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolode.functions import geometry as G
from geolode.operators import spatial, topology
from geolode.plans.lineage import materialized

_GHOST = -1


def _orient(a, b, p) -> float:
    """Twice the signed area of a, b, p; exact where rounding could change its sign."""
    left, right = (b[0] - a[0]) * (p[1] - a[1]), (b[1] - a[1]) * (p[0] - a[0])
    det = left - right
    if abs(det) > 4e-16 * (abs(left) + abs(right)):
        return det
    (ax, ay), (bx, by), (px, py) = ((Fraction(q[0]), Fraction(q[1])) for q in (a, b, p))
    det = (bx - ax) * (py - ay) - (by - ay) * (px - ax)
    return (det > 0) - (det < 0)


def _in_circle(a, b, c, p) -> bool:
    """Whether p lies strictly inside the circle through a, b, c (counter-clockwise)."""
    ax, ay, bx, by, cx, cy = a[0] - p[0], a[1] - p[1], b[0] - p[0], b[1] - p[1], c[0] - p[0], c[1] - p[1]
    aa, bb, cc = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
    u, v, w = bx * cy - by * cx, cx * ay - cy * ax, ax * by - ay * bx
    det = aa * u + bb * v + cc * w
    size = aa * (abs(bx * cy) + abs(by * cx)) + bb * (abs(cx * ay) + abs(cy * ax)) + cc * (abs(ax * by) + abs(ay * bx))
    if abs(det) > 2e-15 * size:
        return det > 0
    (ax, ay), (bx, by), (cx, cy) = ((Fraction(q[0]) - Fraction(p[0]), Fraction(q[1]) - Fraction(p[1])) for q in (a, b, c))
    return (ax * ax + ay * ay) * (bx * cy - by * cx) + (bx * bx + by * by) * (cx * ay - cy * ax) + (cx * cx + cy * cy) * (ax * by - ay * bx) > 0


def delaunay(points: list[tuple[float, float]]) -> list[tuple[int, int, int]]:
    """Counter-clockwise Delaunay triangles of distinct points, by insertion into cavities; none where all lie on a line.

    The outside is triangles with a ghost vertex, so no point is far away.
    """
    n = len(points)
    if n < 3:
        return []
    span = max(max(p[k] for p in points) - min(p[k] for p in points) for k in (0, 1)) or 1.0
    cell = span / max(1.0, n**0.5 / 2)
    x0 = min(p[0] for p in points)

    def along(i: int):
        column = int((points[i][0] - x0) / cell)
        return column, points[i][1] if column % 2 == 0 else -points[i][1]

    order = sorted(range(n), key=along)  # neighbours follow one another, so walks are short
    a, b = order[0], order[1]
    third = next((k for k in range(2, n) if _orient(points[a], points[b], points[order[k]]) != 0), None)
    if third is None:
        return []
    c = order.pop(third)
    if _orient(points[a], points[b], points[c]) < 0:
        a, b = b, a
    corner: list = [(a, b, c), (b, a, _GHOST), (c, b, _GHOST), (a, c, _GHOST)]
    # across[t][i] is the triangle beyond the edge from corner i on.
    across: list = [[1, 2, 3], [0, 3, 2], [0, 1, 3], [0, 2, 1]]
    alive = [True] * 4

    def beyond(t: int, p) -> bool:
        """Whether a point kills a triangle."""
        i, j, k = corner[t]
        if k == _GHOST:
            side = _orient(points[i], points[j], p)
            if side != 0:
                return side > 0
            (ix, iy), (jx, jy) = points[i], points[j]
            return (p[0] - ix) * (p[0] - jx) + (p[1] - iy) * (p[1] - jy) < 0
        return _in_circle(points[i], points[j], points[k], p)

    last = 0
    for v in order[2:]:
        p = points[v]
        t, came = last, -1
        while corner[t][2] != _GHOST:
            i, j, k = corner[t]
            for s, (x, y) in enumerate(((i, j), (j, k), (k, i))):
                if across[t][s] != came and _orient(points[x], points[y], p) < 0:
                    came, t = t, across[t][s]
                    break
            else:
                break
        if not beyond(t, p):  # on the hull's line, or on an edge: some neighbour holds it
            t = next((m for m in across[t] if beyond(m, p)), None)
            if t is None:
                t = next(m for m in range(len(corner)) if alive[m] and beyond(m, p))
        dead, rim, todo = {t}, [], [t]
        while todo:
            at = todo.pop()
            for s in range(3):
                other = across[at][s]
                if other in dead:
                    continue
                if beyond(other, p):
                    dead.add(other)
                    todo.append(other)
                else:
                    rim.append((corner[at][s], corner[at][(s + 1) % 3], other, at))
        for d in dead:
            alive[d] = False
        first: dict = {}
        made = []
        for x, y, other, at in rim:
            new = len(corner)
            if x == _GHOST:
                tri, edge = (y, v, _GHOST), 2
            elif y == _GHOST:
                tri, edge = (v, x, _GHOST), 1
            else:
                tri, edge = (x, y, v), 0
            corner.append(tri)
            links = [0, 0, 0]
            links[edge] = other
            across.append(links)
            alive.append(True)
            across[other][across[other].index(at)] = new
            first[x] = (new, edge)
            made.append((new, edge, y))
        for new, edge, y in made:
            nxt, e2 = first[y]
            across[new][(edge + 1) % 3] = nxt
            across[nxt][(e2 + 2) % 3] = new
        last = made[-1][0]
        for new, _, _ in made:
            if corner[new][2] != _GHOST:
                last = new
                break
    return [corner[t] for t in range(len(corner)) if alive[t] and corner[t][2] != _GHOST]


def _circle(p, q, r) -> tuple[float, float, float]:
    """Centre and radius of the circle through three points."""
    bx, by, cx, cy = q[0] - p[0], q[1] - p[1], r[0] - p[0], r[1] - p[1]
    d = 2 * (bx * cy - by * cx)
    if d == 0:
        return 0.0, 0.0, float("inf")
    b2, c2 = bx * bx + by * by, cx * cx + cy * cy
    ux, uy = (cy * b2 - by * c2) / d, (bx * c2 - cx * b2) / d
    return p[0] + ux, p[1] + uy, (ux * ux + uy * uy) ** 0.5


#: Where tiles begin: off any round number, so that circles of regular points do not lie on a border.
OFFSET = 0.3712


def triangulated(points: DataFrame, radius: float, tile: float | None = None) -> DataFrame:
    """(a, b, c) of the Delaunay triangles of points (pid, x, y) whose circle is no larger than ``radius``.

    A triangle belongs to the tile that holds its circle's centre. All points its
    empty circle could hold lie within ``radius`` of the tile, so tiles are
    worked out apart and their triangles fit together exactly. Triangles wind
    counter-clockwise from their least vertex. Of points at one place the least id counts;
    points whose coordinates are null or no numbers drop out.
    """
    tile = tile or 16 * radius
    p = points.where(G.finite("x") & G.finite("y")).groupBy("x", "y").agg(F.min("pid").alias("pid"))
    at = lambda c, d: F.floor((F.col(c) + d) / tile - OFFSET)
    p = p.withColumn("tx", F.explode(F.sequence(at("x", -radius), at("x", radius)))).withColumn("ty", F.explode(F.sequence(at("y", -radius), at("y", radius))))

    def local(key, rows):
        rows = rows.sort_values("pid")
        ids, xy = rows["pid"].tolist(), list(zip(rows["x"].tolist(), rows["y"].tolist(), strict=True))
        out = []
        for t in delaunay(xy):
            i = t.index(min(t))
            t = t[i:] + t[:i]
            x, y, r = _circle(*(xy[k] for k in t))
            if r <= radius and (int((x / tile - OFFSET) // 1), int((y / tile - OFFSET) // 1)) == (key[0], key[1]):
                out.append(tuple(ids[k] for k in t))
        return pd.DataFrame(out, columns=["a", "b", "c"])

    return p.groupBy("tx", "ty").applyInPandas(local, "a long, b long, c long")


def numbered(triangles: DataFrame) -> DataFrame:
    """Triangles (a, b, c) with ``fid``, their place in that order."""
    return topology.ranked(triangles, [F.asc("a"), F.asc("b"), F.asc("c")], "fid").select("fid", "a", "b", "c")


def with_lines(points: DataFrame, lines: DataFrame, radius: float, tile: float | None = None, rounds: int = 6) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vertices, triangles, missing) of points with lines (sid, p, q: point ids) as edges.

    A line that is no edge of the triangulation is halved, its middle being a new
    point (ids from the greatest on), until all pieces are edges. ``missing`` are pieces that are not after the
    rounds (lines that meet at sharp angles may need many, and where points lie farther apart than ``radius`` there are no edges at all). Crossing lines are to be split before.
    """
    v = materialized(points.select("pid", "x", "y", "z"))
    pieces = materialized(lines.select("sid", "p", "q").where("p != q"))
    for turn in range(rounds + 1):
        faces = materialized(triangulated(v, radius, tile))
        e = faces.select(F.explode(F.array(*[F.struct(F.least(i, j).alias("u"), F.greatest(i, j).alias("w")) for i, j in (("a", "b"), ("b", "c"), ("c", "a"))])).alias("e")).select("e.*").distinct()
        keyed = pieces.select("*", F.least("p", "q").alias("u"), F.greatest("p", "q").alias("w"))
        lost = materialized(keyed.join(e, ["u", "w"], "left_anti"))
        if turn == rounds or not lost.limit(1).count():
            return v, faces, lost.select("sid", "p", "q")
        end = lambda k: v.select(F.col("pid").alias(k), *(F.col(c).alias(f"{k}{c}") for c in "xyz"))  # noqa: E731, B023
        top = v.agg(F.max("pid")).first()[0]
        cut = topology.ranked(lost.select("sid", "p", "q", "u", "w").dropDuplicates(["u", "w"]).select("u", "w"), [F.asc("u"), F.asc("w")], "k").select("u", "w", (F.col("k") + top + 1).alias("m"))
        new = cut.join(end("u"), "u").join(end("w"), "w").select(F.col("m").alias("pid"), *(((F.col(f"u{c}") + F.col(f"w{c}")) / 2).alias(c) for c in "xyz"))
        halves = lost.join(cut, ["u", "w"]).select("sid", F.explode(F.array(F.struct(F.col("p"), F.col("m").alias("q")), F.struct(F.col("m").alias("p"), F.col("q")))).alias("h")).select("sid", "h.p", "h.q")
        pieces = materialized(keyed.join(e, ["u", "w"], "left_semi").select("sid", "p", "q").unionByName(halves))
        v = materialized(v.unionByName(new))


def cleaned_segments(segments: DataFrame) -> DataFrame:
    """(p, q) of segments between point ids: each once whatever its direction, those without length left out."""
    return segments.where("p != q").select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).distinct()


def within_outline(triangles: DataFrame, vertices: DataFrame, edges: DataFrame, band: float = 4.0) -> DataFrame:
    """Triangles whose centroid lies inside the rings (edges), all loops together."""
    v = vertices.select("pid", "x", "y")
    t = triangles
    for k in "abc":
        t = t.join(v.select(F.col("pid").alias(k), F.col("x").alias(f"{k}x"), F.col("y").alias(f"{k}y")), k)
    c = t.select(F.struct("a", "b", "c").alias("pid"), ((F.col("ax") + F.col("bx") + F.col("cx")) / 3).alias("x"), ((F.col("ay") + F.col("by") + F.col("cy")) / 3).alias("y"))
    return spatial.points_in_rings(c, edges.withColumn("area_id", F.lit(0)), band).select("pid.*")
