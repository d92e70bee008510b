"""Two surfaces of different triangulations laid over one another: volumes and deviation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolode.functions import geometry as G
from geolode.operators import spatial


def _clipped(poly: np.ndarray, count: np.ndarray, ax, ay, bx, by) -> tuple[np.ndarray, np.ndarray]:
    """Convex polygons (n, k, 2), of which ``count`` corners count, cut to the left of lines a to b."""
    n, k, _ = poly.shape
    out, size, row = np.zeros((n, k + 1, 2)), np.zeros(n, np.int64), np.arange(n)
    side = (bx - ax)[:, None] * (poly[:, :, 1] - ay[:, None]) - (by - ay)[:, None] * (poly[:, :, 0] - ax[:, None])
    for i in range(k):
        live = i < count
        j = np.where(i + 1 < count, i + 1, 0)
        here, there = side[:, i], side[row, j]
        keep = live & (here >= 0)
        out[row[keep], size[keep]] = poly[keep, i]
        size += keep
        cross = live & ((here > 0) & (there < 0) | (here < 0) & (there > 0))
        t = here[cross] / (here[cross] - there[cross])
        p, q = poly[cross, i], poly[row[cross], j[cross]]
        out[row[cross], size[cross]] = p + (q - p) * t[:, None]
        size += cross
    return out, size


def _parts(area, da, db, dc) -> tuple[np.ndarray, np.ndarray]:
    """Fill and cut over triangles on which the difference is linear."""
    total = area * (da + db + dc) / 3
    mixed = (np.maximum(np.maximum(da, db), dc) > 0) & (np.minimum(np.minimum(da, db), dc) < 0)
    lone = lambda x, y, z: ((x > 0) & (y <= 0) & (z <= 0)) | ((x < 0) & (y >= 0) & (z >= 0))
    first, second = lone(da, db, dc), lone(db, da, dc)
    x, y, z = np.where(first, da, np.where(second, db, dc)), np.where(first, db, da), np.where(first | second, dc, db)
    den = 3 * (x - y) * (x - z)
    tip = np.where(mixed, area * x**3 / np.where(den != 0, den, 1), 0.0)
    rest = total - tip
    up, down = np.maximum(tip, 0) + np.maximum(rest, 0), np.maximum(-tip, 0) + np.maximum(-rest, 0)
    return np.where(mixed, up, np.maximum(total, 0)), np.where(mixed, down, np.maximum(-total, 0))


_CORNERS = [f"{p}{k}{c}" for p in ("", "r") for k in "abc" for c in "xyz"]
_PIECE = "fid long, rid long, area double, fill double, cut double, gap double"


def _measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        m = f[_CORNERS].to_numpy(float).reshape(len(f), 6, 3)
        turn = lambda t: (t[:, 1, 0] - t[:, 0, 0]) * (t[:, 2, 1] - t[:, 0, 1]) - (t[:, 1, 1] - t[:, 0, 1]) * (t[:, 2, 0] - t[:, 0, 0])
        new, ref = m[:, :3].copy(), m[:, 3:].copy()
        for t in (new, ref):
            back = turn(t) < 0
            t[back] = t[back][:, ::-1]
        poly, count = new[:, :, :2], np.full(len(f), 3)
        for i, j in ((0, 1), (1, 2), (2, 0)):
            poly, count = _clipped(poly, count, ref[:, i, 0], ref[:, i, 1], ref[:, j, 0], ref[:, j, 1])

        def height(t, x, y):
            d = turn(t)
            d = np.where(d != 0, d, np.nan)[:, None]
            u = ((x - t[:, None, 0, 0]) * (t[:, 2, 1] - t[:, 0, 1])[:, None] - (y - t[:, None, 0, 1]) * (t[:, 2, 0] - t[:, 0, 0])[:, None]) / d
            v = ((t[:, 1, 0] - t[:, 0, 0])[:, None] * (y - t[:, None, 0, 1]) - (t[:, 1, 1] - t[:, 0, 1])[:, None] * (x - t[:, None, 0, 0])) / d
            return t[:, None, 0, 2] + u * (t[:, 1, 2] - t[:, 0, 2])[:, None] + v * (t[:, 2, 2] - t[:, 0, 2])[:, None]

        gap = height(new, poly[:, :, 0], poly[:, :, 1]) - height(ref, poly[:, :, 0], poly[:, :, 1])
        area, fill, cut = (np.zeros(len(f)) for _ in range(3))
        for i in range(1, poly.shape[1] - 1):
            there = i + 1 < count
            a = np.where(there, ((poly[:, i, 0] - poly[:, 0, 0]) * (poly[:, i + 1, 1] - poly[:, 0, 1]) - (poly[:, i, 1] - poly[:, 0, 1]) * (poly[:, i + 1, 0] - poly[:, 0, 0])) / 2, 0.0)
            up, down = _parts(np.maximum(a, 0), gap[:, 0], gap[:, i], gap[:, i + 1])
            area, fill, cut = area + np.maximum(a, 0), fill + np.where(there, up, 0), cut + np.where(there, down, 0)
        most = np.where(np.arange(poly.shape[1])[None, :] < count[:, None], np.abs(gap), 0).max(axis=1)
        met = area > 0
        yield pd.DataFrame({"fid": f["fid"], "rid": f["rid"], "area": area, "fill": fill, "cut": cut, "gap": most})[met]


def pieces(xyz: DataFrame, reference: DataFrame, cell: float) -> DataFrame:
    """(fid, rid, area, fill, cut, gap): what each face and each reference face share, exactly.

    Pairs meet by cells and are taken in the cell where their boxes' common
    corner lies, so each once. ``gap`` is the greatest difference of height over the piece.
    Faces that are vertical or have no area share nothing.
    """
    low, high = (lambda p, k: F.least(*(F.col(f"{p}{c}{k}") for c in "abc"))), (lambda p, k: F.greatest(*(F.col(f"{p}{c}{k}") for c in "abc")))

    def spread(t: DataFrame, p: str) -> DataFrame:
        t = t.withColumns({f"{p}lx": low(p, "x"), f"{p}ly": low(p, "y"), f"{p}hx": high(p, "x"), f"{p}hy": high(p, "y")})
        return t.withColumn("gx", spatial._cells(F.col(f"{p}lx"), F.col(f"{p}hx"), cell)).withColumn("gy", spatial._cells(F.col(f"{p}ly"), F.col(f"{p}hy"), cell))

    new = spread(xyz.select("fid", *_CORNERS[:9]), "")
    ref = spread(reference.select(F.col("fid").alias("rid"), *(F.col(c).alias(f"r{c}") for c in _CORNERS[:9])), "r")
    hit = new.join(ref, ["gx", "gy"]).where((F.col("lx") < F.col("rhx")) & (F.col("rlx") < F.col("hx")) & (F.col("ly") < F.col("rhy")) & (F.col("rly") < F.col("hy")))
    hit = hit.where((F.col("gx") == F.floor(F.greatest("lx", "rlx") / cell)) & (F.col("gy") == F.floor(F.greatest("ly", "rly") / cell)))
    return hit.select("fid", "rid", *_CORNERS).mapInPandas(_measured, _PIECE)


def volumes(pieces_: DataFrame, *by: str) -> DataFrame:
    """Cut, fill and net (cut less fill) of pieces, by keys."""
    return pieces_.groupBy(*by).agg(F.sum("area").alias("area"), F.sum("cut").alias("cut"), F.sum("fill").alias("fill"), (F.sum("cut") - F.sum("fill")).alias("net"))


def deviation(xyz: DataFrame, reference: DataFrame, cell: float, tolerance: float = 1e-6) -> DataFrame:
    """One row: the greatest difference of height, the areas, and whether both surfaces cover the same ground (areas within a tolerance)."""
    o = pieces(xyz, reference, cell).agg(F.coalesce(F.max("gap"), F.lit(0.0)).alias("max_gap"), F.coalesce(F.sum("area"), F.lit(0.0)).alias("shared_area"), F.count("*").alias("n_pieces"))
    size = lambda t, n: t.agg(F.coalesce(F.sum(G.plan_area()), F.lit(0.0)).alias(n))
    one = o.join(size(xyz, "area"), how="cross").join(size(reference, "reference_area"), how="cross")
    same = (F.abs(F.col("area") - F.col("shared_area")) <= tolerance * F.greatest(F.col("area"), F.lit(1.0))) & (F.abs(F.col("reference_area") - F.col("shared_area")) <= tolerance * F.greatest(F.col("area"), F.lit(1.0)))
    return one.withColumn("same_ground", same)
