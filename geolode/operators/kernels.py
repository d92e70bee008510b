"""Computations that are no relations: noise, seeded scatter, cheapest routes, contour chains. One kernel call a group or batch."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolode.functions import geometry as G
from geolode.operators import spatial

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


#: Multipliers of the lattice hash and of its two mixing steps, the step between octaves, and the eight gradients.
_HX, _HY, _HS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_H1, _H2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_OCTAVE = (17.31, -9.77, 1013)
_DIAGONAL = 0.70710678118654752440
_GX = np.array([1.0, -1.0, 0.0, 0.0, _DIAGONAL, -_DIAGONAL, _DIAGONAL, -_DIAGONAL])
_GY = np.array([0.0, 0.0, 1.0, -1.0, _DIAGONAL, _DIAGONAL, -_DIAGONAL, -_DIAGONAL])


def gradient_noise(x: np.ndarray, y: np.ndarray, seed: int) -> np.ndarray:
    """Smooth noise of lattice gradients, -1 to 1, 0 at whole coordinates. Integer hashing and a table of gradients: the same on every machine."""
    ix, iy = np.floor(x), np.floor(y)
    fx, fy = x - ix, y - iy
    ix, iy = ix.astype(np.int64), iy.astype(np.int64)
    salt = np.uint64((seed & 0xFFFFFFFF) * int(_HS) & (1 << 64) - 1)

    def corner(dx: int, dy: int) -> np.ndarray:
        k = ((ix + dx).view(np.uint64) * _HX) ^ ((iy + dy).view(np.uint64) * _HY) ^ salt
        for m in (_H1, _H2):
            k = (k ^ (k >> np.uint64(33))) * m
        g = ((k ^ (k >> np.uint64(33))) & np.uint64(7)).astype(np.int64)
        return _GX[g] * (fx - dx) + _GY[g] * (fy - dy)

    fade = lambda t: t * t * t * (t * (t * 6 - 15) + 10)
    u, v = fade(fx), fade(fy)
    low, high = corner(0, 0), corner(0, 1)
    low, high = low + u * (corner(1, 0) - low), high + u * (corner(1, 1) - high)
    return np.clip((low + v * (high - low)) * math.sqrt(2), -1, 1)


def fractal_noise(x: np.ndarray, y: np.ndarray, octaves: int, gain: float, seed: int) -> np.ndarray:
    """Octaves of gradient noise (8 at most), each twice as fine and ``gain`` as strong as the one before, over the sum of their weights."""
    total, weights, weight, k = np.zeros(len(x)), 0.0, 1.0, 1.0
    gain = min(max(gain, 0.0), 1.0)
    for o in range(max(1, min(8, octaves))):
        total += weight * gradient_noise(x * k + o * _OCTAVE[0], y * k + o * _OCTAVE[1], seed + o * _OCTAVE[2])
        weights, weight, k = weights + weight, weight * gain, k * 2
    return np.clip(total / weights, -1, 1)


def with_noise(points: DataFrame, scale: float, octaves: int, gain: float, seed: int) -> DataFrame:
    """Adds ``noise``: ``fractal_noise`` at places in units of a scale."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(noise=fractal_noise(f.x.to_numpy(float) / scale, f.y.to_numpy(float) / scale, octaves, gain, seed))

    return points.mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in points.dtypes) + ", noise double")


def scattered(x0: float, y0: float, x1: float, y1: float, spacing: float, jitter: float, seed: int, regions: DataFrame) -> DataFrame:
    """(pid, x, y): a grid over a box, each point moved by up to ``jitter`` of half a cell, inside the regions.

    Points come from their cell's number and the seed alone, so any executor makes its own.
    """
    spark = regions.sparkSession
    nx, ny = max(1, math.ceil((x1 - x0) / spacing)), max(1, math.ceil((y1 - y0) / spacing))
    cells = spark.range(nx * ny)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            k = f["id"].to_numpy().astype(np.uint64)
            u, v = (((_mixed(k * np.uint64(2) + np.uint64((i + seed * int(_M1)) & (1 << 64) - 1)) >> np.uint64(11)).astype(np.float64) / (1 << 53)) - 0.5 for i in (0, 1))
            yield pd.DataFrame({"pid": f["id"], "x": x0 + (f["id"] % nx + 0.5 + u * jitter) * spacing, "y": y0 + (f["id"] // nx + 0.5 + v * jitter) * spacing})

    points = cells.mapInPandas(run, "pid long, x double, y double")
    inside = spatial.points_in_rings(points, regions, max(spacing * 4, 1.0)).select("pid").distinct()
    return points.join(inside, "pid", "left_semi")


def thinned(points: DataFrame, distance: float) -> DataFrame:
    """(pid, x, y): points of which no two are closer than ``distance``, each left-out one close to a point kept (lowest id first).

    Rounds: a point stays once no closer undecided one has a lower id, and then its neighbours go.
    """
    from geolode.plans.lineage import materialized

    near = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    p = points.select("pid", "x", "y", F.floor(F.col("x") / distance).alias("gx"), F.floor(F.col("y") / distance).alias("gy"))
    q = p.withColumn("s", F.explode(F.array(*near))).select(F.col("pid").alias("qid"), F.col("x").alias("qx"), F.col("y").alias("qy"), (F.col("gx") + F.col("s.i")).alias("gx"), (F.col("gy") + F.col("s.j")).alias("gy"))
    pairs = materialized(p.join(q, ["gx", "gy"]).where((F.col("pid") != F.col("qid")) & (G.distance2("x", "y", "qx", "qy") < distance * distance)).select("pid", "qid"))
    left, kept = materialized(points.select("pid")), None
    while True:
        blocked = pairs.where("qid < pid").join(left.withColumnRenamed("pid", "qid"), "qid", "left_semi").select("pid").distinct()
        stay = materialized(left.join(blocked, "pid", "left_anti"))
        if not stay.limit(1).count():
            break
        kept = stay if kept is None else kept.unionByName(stay)
        gone = pairs.join(stay.withColumnRenamed("pid", "qid"), "qid", "left_semi").select("pid").distinct()
        left = materialized(left.join(stay, "pid", "left_anti").join(gone, "pid", "left_anti"))
    return points.join(kept, "pid", "left_semi") if kept is not None else points.limit(0)


_MOVES = [(dx, dy) for dx in range(-2, 3) for dy in range(-2, 3) if (abs(dx), abs(dy)) in {(0, 1), (1, 0), (1, 1), (1, 2), (2, 1)}]
_PATH = "request int, step int, col long, row long, cost double"


def cheapest_routes(grid: DataFrame, requests: DataFrame, limit: float, margin: int = 12) -> DataFrame:
    """(request, step, col, row, cost) of the cheapest way over a height grid between two nodes, in 16 directions.

    A request (request, c0, r0, c1, r1) sees the nodes of its own box and a margin
    around it, so that its kernel's memory follows the request, not the grid.
    """
    b = requests.select("request", "c0", "r0", "c1", "r1", *((f(F.col(f"{k}0"), F.col(f"{k}1")) + d).alias(n) for n, k, f, d in (("lo_c", "c", F.least, -margin), ("hi_c", "c", F.greatest, margin), ("lo_r", "r", F.least, -margin), ("hi_r", "r", F.greatest, margin))))
    rows = grid.join(F.broadcast(b), F.col("col").between(F.col("lo_c"), F.col("hi_c")) & F.col("row").between(F.col("lo_r"), F.col("hi_r")))

    def search(key, g):
        z = {(int(c), int(r)): v for c, r, v in zip(g["col"], g["row"], g["v"], strict=True)}
        one = g.iloc[0]
        start, goal = (int(one.c0), int(one.r0)), (int(one.c1), int(one.r1))
        empty = pd.DataFrame(columns=[c.split()[0] for c in _PATH.split(", ")])
        if start not in z or goal not in z:
            return empty
        best, came, queue = {start: 0.0}, {}, [(math.dist(start, goal), start)]
        while queue:
            _, at = heapq.heappop(queue)
            if at == goal:
                break
            for dx, dy in _MOVES:
                to = (at[0] + dx, at[1] + dy)
                if to not in z:
                    continue
                run = math.hypot(dx, dy)
                r = abs(z[to] - z[at]) / run / limit
                over = max(0.0, r - 1)
                cost = best[at] + run * (1 + min(r, 1.0) ** 2 + 2 * over + 4 * over * over)
                if cost < best.get(to, math.inf):
                    best[to], came[to] = cost, at
                    heapq.heappush(queue, (cost + math.dist(to, goal), to))
        if goal not in best:
            return empty
        path = [goal]
        while path[-1] != start:
            path.append(came[path[-1]])
        return pd.DataFrame([(int(key[0]), i, c, r, best[c, r]) for i, (c, r) in enumerate(reversed(path))], columns=[c.split()[0] for c in _PATH.split(", ")])

    return rows.groupBy("request").applyInPandas(search, _PATH)


def _labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least of what each of ``n`` nodes is joined with over edges (u, v)."""
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return label
        u, v = a[apart], b[apart]
        np.minimum.at(label, np.maximum(u, v), np.minimum(u, v))
        while not np.array_equal(label, further := label[label]):
            label = further


_PIECE = "level double, degrees long, closed boolean, length double, open boolean, lc long, y long, x long, token string"


def _pieces(frames: Iterator[pd.DataFrame], height: int) -> Iterator[pd.DataFrame]:
    """Chains of the segments of whole bands, named by the least end in them; open ones run on in other bands, over segments that their rows with a token name."""
    frames = [f for f in frames if len(f)]
    if not frames:
        return
    t = pd.concat(frames, ignore_index=True)
    bands = t["band"].unique()
    # A segment between two bands that both are here came twice.
    t = t[(t["band"] == t["yu"] // height) | ~(t["yu"] // height).isin(bands)]
    lc, y, x = np.tile(t["lc"].to_numpy(), 2), np.concatenate([t["yu"], t["yv"]]), np.concatenate([t["xu"], t["xv"]])
    order = np.lexsort((x, y, lc))
    lc, y, x = lc[order], y[order], x[order]
    new = np.r_[True, (lc[1:] != lc[:-1]) | (y[1:] != y[:-1]) | (x[1:] != x[:-1])]
    node = np.empty(len(order), dtype=np.int64)
    node[order] = np.cumsum(new) - 1
    lc, y, x = lc[new], y[new], x[new]
    m, n = len(t), len(lc)
    u, v = node[:m], node[m:]
    own = np.isin(y // height, bands)
    inner = own[u] & own[v]
    label = _labels(n, u[inner], v[inner])
    degree, half = np.bincount(node, minlength=n), np.bincount(node, np.tile(t["l"].to_numpy(), 2), n)
    at, piece = np.unique(label[own], return_inverse=True)  # a piece's label is its least end
    k = len(at)
    level = np.empty(n)
    level[u] = level[v] = t["level"].to_numpy()
    cross = np.flatnonzero(~inner)
    mine = np.searchsorted(at, label[np.where(own[u[cross]], u[cross], v[cross])])
    open_ = np.zeros(k, dtype=bool)
    open_[mine] = True
    out = pd.DataFrame({"level": level[at], "degrees": np.bincount(piece, degree[own], k).astype(np.int64), "closed": np.bincount(piece, degree[own] != 2, k) == 0, "length": np.bincount(piece, half[own], k) / 2, "open": open_, "lc": lc[at], "y": y[at], "x": x[at], "token": None})
    yield out
    if len(cross):
        a, b = u[cross], v[cross]
        ends = zip(*(c[i].tolist() for i in (a, b) for c in (lc, y, x)), strict=True)
        yield out.iloc[mine].assign(token=[":".join(map(str, sorted((e[:3], e[3:])))) for e in ends])


#: Segments of one band, where bands are not given.
BAND = 100_000


def stitched(segments: DataFrame, tolerance: float, band: float | None = None) -> DataFrame:
    """(level, chain, n_segments, closed, length): contour segments joined where their ends fall into one cell of the tolerance.

    Segments are dealt to bands of y (``band`` high, by their number and extent if that is not given), those
    between two bands to both; only what runs from band to band is joined over the table. Chains are named by
    the y, x and level of their least end.
    """
    from geolode.operators.graphs import components
    from geolode.plans.lineage import materialized

    cell = lambda c: F.round(F.col(c) / tolerance, 0).cast("long")
    if band is None:
        n, lo, hi = segments.agg(F.count("*"), F.min(F.least("y0", "y1")), F.max(F.greatest("y0", "y1"))).first()
        band = (hi - lo) / max(1, n // BAND) if n and hi is not None else 1.0
    height = max(1, math.ceil(band / tolerance))
    e = segments.select("level", cell("level").alias("lc"), *(cell(f"{c}{i}").alias(f"{c}{k}") for i, k in enumerate("uv") for c in "yx"), F.sqrt(G.distance2("x0", "y0", "x1", "y1")).alias("l")).where("yu != yv or xu != xv")
    of = lambda c: F.floor(F.col(c) / height)
    e = e.withColumn("band", F.explode(F.when(of("yu") == of("yv"), F.array(of("yu"))).otherwise(F.array(of("yu"), of("yv")))))
    piece = materialized(e.repartition("band").mapInPandas(lambda frames: _pieces(frames, height), _PIECE))
    name = F.concat_ws(":", F.lpad(F.col("y").cast("string"), 20, "0"), F.lpad(F.col("x").cast("string"), 20, "0"), F.col("lc").cast("string"))
    whole = piece.where("not open").select("level", name.alias("chain"), "degrees", "closed", "length")
    part = piece.where("open").withColumn("name", name)
    links = part.where("token is not null").groupBy("token").agg(F.min("name").alias("a"), F.max("name").alias("b"))
    part = part.where("token is null")
    root = components(part.select(F.col("name").alias("node")), links.select("a", "b"))
    joined = part.join(root.withColumnRenamed("node", "name"), "name").groupBy(F.col("root").alias("chain")).agg(F.first("level").alias("level"), F.sum("degrees").alias("degrees"), F.bool_and("closed").alias("closed"), F.sum("length").alias("length"))
    return whole.unionByName(joined).select("level", "chain", (F.col("degrees") / 2).cast("long").alias("n_segments"), "closed", "length")


def principal_axes(points: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(centre, axes as rows, spreads): from sums that the executors add up; null for no points."""
    n, *s = points.agg(F.count("*"), *(F.avg(k) for k in "xyz")).first()
    if not n:
        return None
    centred = [F.col(k) - float(m) for k, m in zip("xyz", s, strict=True)]
    c = points.agg(*(F.avg(centred[i] * centred[j]) for i in range(3) for j in range(3))).first()
    values, vectors = np.linalg.eigh(np.array(c).reshape(3, 3))
    return np.array(s), vectors.T[::-1], np.sqrt(np.maximum(values[::-1], 0))
