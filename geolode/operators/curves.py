"""Curves one by one: simplified chains, fillets, splines, places along them. One kernel call a curve."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geolode.functions import geometry as G
from geolode.operators import sections


def simplified(lines: DataFrame, plan_tolerance: float, height_tolerance: float = math.inf) -> DataFrame:
    """Vertices of lines (route_id, seq, x, y, z) that a chord between kept ones does not reproduce within tolerances in plan and height.

    The vertex farthest off, by share of its tolerance, is kept and both sides are looked at again; the ends always stay.
    """

    def run(key, rows):
        rows = rows.sort_values("seq")
        p = rows[["x", "y", "z"]].to_numpy(float)
        keep = np.zeros(len(p), bool)
        keep[[0, -1]] = True
        todo = [(0, len(p) - 1)]
        while todo:
            a, b = todo.pop()
            if b - a < 2:
                continue
            d, q = p[b] - p[a], p[a + 1 : b] - p[a]
            n = d[0] * d[0] + d[1] * d[1]
            t = np.clip((q[:, 0] * d[0] + q[:, 1] * d[1]) / n, 0, 1) if n > 0 else np.zeros(len(q))
            off = np.hypot(q[:, 0] - t * d[0], q[:, 1] - t * d[1]) / plan_tolerance
            if math.isfinite(height_tolerance):
                off = np.maximum(off, np.abs(q[:, 2] - t * d[2]) / height_tolerance)
            k = int(np.argmax(off))
            if off[k] > 1:
                keep[a + 1 + k] = True
                todo += [(a, a + 1 + k), (a + 1 + k, b)]
        return rows[keep]

    cols = lines.select("route_id", "seq", "x", "y", "z")
    return cols.groupBy("route_id").applyInPandas(run, cols.schema)


_FILLET = "route_id int, piece int, kind string, x0 double, y0 double, x1 double, y1 double, cx double, cy double, radius double"


def filleted(lines: DataFrame, radius: float) -> DataFrame:
    """(route_id, piece, kind, x0, y0, x1, y1, cx, cy, radius): plan lines with their corners rounded by tangent arcs.

    Corners that ask for more of a leg than it has share it in proportion, so
    their radius shrinks; nearly straight corners and reversals stay as they are.
    """

    def run(key, rows):
        rows = rows.sort_values("seq")
        p = list(zip(rows["x"].tolist(), rows["y"].tolist(), strict=True))
        n, out = len(p), []
        length = [math.dist(a, b) for a, b in zip(p, p[1:], strict=False)]
        bend, reach = [0.0] * n, [0.0] * n
        for i in range(1, n - 1):
            if length[i - 1] <= 0 or length[i] <= 0:
                continue
            ux, uy = (p[i][0] - p[i - 1][0]) / length[i - 1], (p[i][1] - p[i - 1][1]) / length[i - 1]
            vx, vy = (p[i + 1][0] - p[i][0]) / length[i], (p[i + 1][1] - p[i][1]) / length[i]
            bend[i] = math.atan2(ux * vy - uy * vx, ux * vx + uy * vy)
            if 1e-6 <= abs(bend[i]) <= math.pi - 1e-3:
                reach[i] = radius * math.tan(abs(bend[i]) / 2)
        asked = [reach[i] + reach[i + 1] for i in range(n - 1)]
        share = [size / want if want > size * (1 - 1e-9) and want > 0 else 1.0 for want, size in zip(asked, length, strict=True)]
        at = p[0]

        def line_to(q, whole: float) -> None:
            if math.dist(at, q) > 1e-9 * max(whole, 1.0):
                out.append((int(key[0]), len(out), "line", *at, *q, None, None, None))

        for i in range(1, n - 1):
            t = reach[i] * min(share[i - 1], share[i])
            if t <= 0:
                line_to(p[i], length[i - 1])
                at = p[i]
                continue
            ux, uy = (p[i][0] - p[i - 1][0]) / length[i - 1], (p[i][1] - p[i - 1][1]) / length[i - 1]
            vx, vy = (p[i + 1][0] - p[i][0]) / length[i], (p[i + 1][1] - p[i][1]) / length[i]
            r, side = t / math.tan(abs(bend[i]) / 2), math.copysign(1.0, bend[i])
            a, b = (p[i][0] - ux * t, p[i][1] - uy * t), (p[i][0] + vx * t, p[i][1] + vy * t)
            line_to(a, length[i - 1])
            out.append((int(key[0]), len(out), "arc", *a, *b, a[0] - uy * r * side, a[1] + ux * r * side, r))
            at = b
        if n > 1:
            line_to(p[-1], length[-1])
        return pd.DataFrame(out, columns=[c.split()[0] for c in _FILLET.split(", ")])

    return lines.select("route_id", "seq", "x", "y").groupBy("route_id").applyInPandas(run, _FILLET)


def basis(degree: int, knots: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Values (places, control points) of the B-splines on a knot vector; the last knot belongs to the last span."""
    u = np.asarray(u, float)
    n = len(knots) - degree - 1
    at = np.clip(np.searchsorted(knots, u, side="right") - 1, degree, n - 1)
    b = np.zeros((len(u), len(knots) - 1))
    b[np.arange(len(u)), at] = 1.0
    for d in range(1, degree + 1):
        wide = np.zeros((len(u), len(knots) - 1 - d))
        for i in range(len(knots) - 1 - d):
            left, right = knots[i + d] - knots[i], knots[i + d + 1] - knots[i + 1]
            if left > 0:
                wide[:, i] += (u - knots[i]) / left * b[:, i]
            if right > 0:
                wide[:, i] += (knots[i + d + 1] - u) / right * b[:, i + 1]
        b = wide
    return b


def clamped_knots(n: int, degree: int) -> np.ndarray:
    """Even knots from 0 to 1 for n control points, the ends repeated."""
    return np.r_[np.zeros(degree), np.linspace(0, 1, n - degree + 1), np.ones(degree)]


def spline_points(controls: DataFrame, degree: int, n: int) -> DataFrame:
    """(route_id, i, u, x, y, z, curvature) at n even places of the clamped B-spline of control points (route_id, seq, x, y, z); curvature in plan, left positive.

    Curves with too few control points for the degree take the highest that they allow.
    """

    def run(key, rows):
        rows = rows.sort_values("seq")
        c = rows[["x", "y", "z"]].to_numpy(float)
        d = min(degree, len(c) - 1)
        u = np.linspace(0, 1, n)
        if d < 1:
            return pd.DataFrame({"route_id": int(key[0]), "i": range(n), "u": u, "x": c[0, 0], "y": c[0, 1], "z": c[0, 2], "curvature": 0.0})
        knots, curves, k = clamped_knots(len(c), d), [], d
        for _ in range(3):
            if k < 0 or len(c) < 1:
                curves.append(np.zeros((n, 3)))
                continue
            curves.append(basis(k, knots, u) @ c)
            gap = (knots[k + 1 : -1] - knots[1 : -k - 1])[: len(c) - 1] if k else np.zeros(0)
            c = k * np.diff(c, axis=0) / np.where(gap > 0, gap, np.inf)[:, None] if k else np.zeros((0, 3))
            knots, k = knots[1:-1], k - 1
        at, v, a = curves
        speed2 = v[:, 0] ** 2 + v[:, 1] ** 2
        bend = np.where(speed2 > 1e-24, (v[:, 0] * a[:, 1] - v[:, 1] * a[:, 0]) / np.maximum(speed2, 1e-24) ** 1.5, 0.0)
        return pd.DataFrame({"route_id": int(key[0]), "i": range(n), "u": u, "x": at[:, 0], "y": at[:, 1], "z": at[:, 2], "curvature": bend})

    return controls.select("route_id", "seq", "x", "y", "z").groupBy("route_id").applyInPandas(run, "route_id int, i int, u double, x double, y double, z double, curvature double")


def along(lines: DataFrame, spacing: float, cell: float) -> DataFrame:
    """(route_id, k, x, y, tangent): places every ``spacing`` along plan lines (with stations), from the start, and the direction there in degrees."""
    end = lines.groupBy("route_id").agg(F.max("station").alias("length")).where("length > 0")
    k = end.select("route_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("length") / spacing + 1e-9).cast("int"))).alias("k")).withColumn("station", F.col("k") * F.lit(spacing)).withColumn("b", F.floor(F.col("station") / cell))
    leg = sections.legs(lines).where("s1 > s0").withColumn("b", F.explode(F.sequence(F.floor(F.col("s0") / cell), F.floor(F.col("s1") / cell))))
    hit = k.join(leg, ["route_id", "b"]).where("station >= s0 and station <= s1")
    t = (F.col("station") - F.col("s0")) / (F.col("s1") - F.col("s0"))
    p = F.struct(G.lerp("x0", "x1", t).alias("x"), G.lerp("y0", "y1", t).alias("y"), F.degrees(F.atan2(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0"))).alias("tangent"))
    return hit.groupBy("route_id", "k").agg(F.min_by(p, "s0").alias("p")).select("route_id", "k", "p.*")


def turned_points(lines: DataFrame, tolerance: float) -> DataFrame:
    """Vertices of lines (route_id, seq, x, y) without those within a tolerance of the one before and those that lie straight between their neighbours; ends stay."""
    w = Window.partitionBy("route_id").orderBy("seq")
    p = lines.withColumns({"lx": F.lag("x").over(w), "ly": F.lag("y").over(w), "last": F.lead("seq").over(w).isNull()})
    p = p.where(F.col("lx").isNull() | F.col("last") | (G.distance2("x", "y", "lx", "ly") > tolerance * tolerance)).drop("lx", "ly", "last")
    p = p.withColumns({f"{k}{n}": f(k).over(w) for k in "xy" for n, f in (("p", F.lag), ("n", F.lead))})
    straight = G.segment_distance("x", "y", "xp", "yp", "xn", "yn") <= tolerance
    return p.where(F.col("xp").isNull() | F.col("xn").isNull() | ~straight).select("route_id", "seq", "x", "y")
