"""Rasters in long form (col, row, v), absent where there is no value: clouds, morphology, ground, sampling."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geolode.functions import geometry as G

GROUND_CLASS = 2


def rasterized(cloud: DataFrame, cell: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """(col, row, n, top, top_cls, top_colour, low, ground) for each node with points; of equally high points the one of least class and colour gives both."""
    at = cloud.select(F.floor((F.col("x") - x0) / cell + 0.5).alias("col"), F.floor((F.col("y") - y0) / cell + 0.5).alias("row"), "z", "cls", "colour")
    g = at.groupBy("col", "row").agg(F.count("*").alias("n"), F.min(F.struct((-F.col("z")).alias("nz"), "cls", "colour")).alias("t"), F.min("z").alias("low"), F.min(F.when(F.col("cls") == GROUND_CLASS, F.col("z"))).alias("ground"))
    return g.select("col", "row", "n", (-F.col("t.nz")).alias("top"), F.col("t.cls").alias("top_cls"), F.col("t.colour").alias("top_colour"), "low", "ground")


def _window(grid: DataFrame, radius: int, least: bool) -> DataFrame:
    """Extreme over a square, at nodes that have a value: columns first, then rows, so that work grows with the radius, not its square."""
    pick = F.min if least else F.max
    side = F.explode(F.sequence(F.lit(-radius), F.lit(radius)))
    cols = grid.select(F.col("col"), F.col("row"), "v", side.alias("d")).groupBy((F.col("col") + F.col("d")).alias("col"), "row").agg(pick("v").alias("v"))
    both = cols.select("col", "row", "v", side.alias("d")).groupBy("col", (F.col("row") + F.col("d")).alias("row")).agg(pick("v").alias("v"))
    return both.join(grid.select("col", "row"), ["col", "row"], "left_semi")


def eroded(grid: DataFrame, radius: int) -> DataFrame:
    return _window(grid, radius, True)


def dilated(grid: DataFrame, radius: int) -> DataFrame:
    return _window(grid, radius, False)


def opened(grid: DataFrame, radius: int) -> DataFrame:
    return dilated(eroded(grid, radius), radius)


def ground_filter(grid: DataFrame, radii: list[int], cell: float, slope: float, start: float, most: float) -> DataFrame:
    """(col, row, v, is_ground): progressive morphological filter. A node stands out once a wider opening lies below it by more than a threshold that grows with the window."""
    from geolode.plans.lineage import materialized

    cur = materialized(grid.select("col", "row", "v", F.col("v").alias("w"), F.lit(True).alias("is_ground")))
    before = 0
    for r in radii:
        limit = min(most, start + slope * (r - before) * 2 * cell)
        low = opened(cur.select("col", "row", F.col("w").alias("v")), r).withColumnRenamed("v", "o")
        cur = materialized(cur.join(low, ["col", "row"]).select("col", "row", "v", F.col("o").alias("w"), (F.col("is_ground") & (F.col("w") - F.col("o") <= limit)).alias("is_ground")))
        before = r
    return cur.select("col", "row", "v", "is_ground")


def rough(grid: DataFrame, radius: int, threshold: float) -> DataFrame:
    """(col, row, range, is_rough): spread of values in a square around each node."""
    lo, hi = eroded(grid, radius).withColumnRenamed("v", "lo"), dilated(grid, radius).withColumnRenamed("v", "hi")
    return lo.join(hi, ["col", "row"]).select("col", "row", (F.col("hi") - F.col("lo")).alias("range"), (F.col("hi") - F.col("lo") > threshold).alias("is_rough"))


def coarse(grid: DataFrame, factor: int) -> DataFrame:
    """Means of blocks of nodes."""
    return grid.groupBy(F.floor(F.col("col") / factor).alias("col"), F.floor(F.col("row") / factor).alias("row")).agg(F.avg("v").alias("v"), F.count("*").alias("n"))


def sampled(grid: DataFrame, points: DataFrame, cell: float = 1.0) -> DataFrame:
    """(pid, v): bilinear, the weights of absent nodes given to the others; null where all four are absent."""
    u, w = F.col("x") / cell, F.col("y") / cell
    p = points.select("pid", F.floor(u).alias("c"), F.floor(w).alias("r"), (u - F.floor(u)).alias("fu"), (w - F.floor(w)).alias("fw"))
    corners = [(0, 0), (1, 0), (0, 1), (1, 1)]
    weight = lambda i, j: (F.col("fu") if i else 1 - F.col("fu")) * (F.col("fw") if j else 1 - F.col("fw"))
    q = p.select("pid", F.explode(F.array(*[F.struct((F.col("c") + i).alias("col"), (F.col("r") + j).alias("row"), weight(i, j).alias("k")) for i, j in corners])).alias("n")).select("pid", "n.*").where("k > 0")
    s = q.join(grid.select("col", "row", "v"), ["col", "row"], "left")
    return s.groupBy("pid").agg(F.try_divide(F.sum(F.col("k") * F.col("v")), F.sum(F.when(F.col("v").isNotNull(), F.col("k")))).alias("v"))


def labelled(mask: DataFrame) -> DataFrame:
    """(col, row, label): connected nodes (side by side) of a mask share the least (row, col) as a label. Rows and columns lie within 31 bits."""
    from geolode.operators.graphs import components

    wide, half = 1 << 32, 1 << 31
    key = lambda c, r: F.col(r).cast("long") * wide + F.col(c) + half
    m = mask.select("col", "row", key("col", "row").alias("node"))
    right = m.select((F.col("col") + 1).alias("col"), "row", F.col("node").alias("a"))
    up = m.select("col", (F.col("row") + 1).alias("row"), F.col("node").alias("a"))
    links = right.unionByName(up).join(m, ["col", "row"]).select("a", F.col("node").alias("b"))
    c = components(m.select("node"), links)
    parts = lambda k: (F.expr(f"shiftright({k}, 32)"), F.col(k).bitwiseAND(F.lit(wide - 1)) - half)
    (r, col), (r0, c0) = parts("node"), parts("root")
    kinds = {k: mask.schema[k].dataType for k in ("col", "row")}
    return c.select(col.cast(kinds["col"]).alias("col"), r.cast(kinds["row"]).alias("row"), F.concat_ws(":", r0.cast("string"), c0.cast("string")).alias("label"))


def mask_dilated(mask: DataFrame, radius: int) -> DataFrame:
    """Nodes (col, row) within a square of a mask's."""
    side = F.explode(F.sequence(F.lit(-radius), F.lit(radius)))
    cols = mask.select("col", "row", side.alias("d")).select((F.col("col") + F.col("d")).alias("col"), "row").distinct()
    return cols.select("col", "row", side.alias("d")).select("col", (F.col("row") + F.col("d")).alias("row")).distinct()


def mask_eroded(mask: DataFrame, radius: int) -> DataFrame:
    """Nodes whose whole square lies in the mask."""
    side = F.explode(F.sequence(F.lit(-radius), F.lit(radius)))
    n = 2 * radius + 1
    cols = mask.select("col", "row", side.alias("d")).groupBy((F.col("col") + F.col("d")).alias("col"), "row").count().where(F.col("count") == n)
    return cols.select("col", "row", side.alias("d")).groupBy("col", (F.col("row") + F.col("d")).alias("row")).count().where(F.col("count") == n).select("col", "row")


def mask_opened(mask: DataFrame, radius: int) -> DataFrame:
    return mask_dilated(mask_eroded(mask, radius), radius)


def _row_pass(key, nodes, lines):
    """Squared distances in one row: the lower envelope of the parabolas over its columns, in whole numbers."""
    site: list[int] = []
    first: list[int] = []  # where each site of the envelope becomes the nearest
    squares = dict(zip(lines["col"].tolist(), lines["g"].tolist(), strict=True))
    for q in sorted(squares):
        while site:
            p = site[-1]
            # The first column from which on q is nearer than p.
            cut = (q * q - p * p + squares[q] - squares[p]) // (2 * (q - p)) + 1
            if cut > first[-1]:
                break
            site.pop()
            first.pop()
        if not site:
            cut = -(1 << 62)
        site.append(q)
        first.append(cut)
    col = nodes["col"].to_numpy()
    d2 = None
    if site:
        near = np.array(site)[np.searchsorted(np.array(first), col, side="right") - 1]
        d2 = (col - near) ** 2 + np.array([squares[k] for k in near.tolist()], dtype="int64")
    return pd.DataFrame({"col": col, "row": nodes["row"], "d2": pd.array(d2, dtype="Int64") if d2 is not None else pd.array([None] * len(col), dtype="Int64")})


def distance2(mask: DataFrame, nodes: DataFrame) -> DataFrame:
    """(col, row, d2): exact squared distance in cells to the nearest mask node, for every node; null where the mask is empty.

    First along each column of the mask, from the mask rows before and after,
    then along each row over those columns: the squares add up.
    """
    whole = mask.select("col", "row").unionByName(nodes.select("col", "row")).agg(F.min("row").alias("lo"), F.max("row").alias("hi"))
    sites = mask.select("col", "row").distinct().withColumn("at", F.col("row"))
    spread = sites.select("col").distinct().join(F.broadcast(whole), how="cross").select("col", F.explode(F.sequence("lo", "hi")).alias("row"))
    # The nearest mask row each way, by windows that grow from either end.
    up, down = (F.last("at", True).over(Window.partitionBy("col").orderBy(o).rowsBetween(Window.unboundedPreceding, 0)) for o in (F.asc("row"), F.desc("row")))
    gap = F.least(F.col("row") - up, down - F.col("row"))
    lines = spread.join(sites, ["col", "row"], "left").select("col", "row", (gap * gap).alias("g"))
    at = nodes.select(F.col("col").cast("long"), F.col("row").cast("long"))
    return at.groupBy("row").cogroup(lines.select(F.col("col").cast("long"), F.col("row").cast("long"), F.col("g").cast("long")).groupBy("row")).applyInPandas(_row_pass, "col long, row long, d2 long")


def distance2_to(mask: DataFrame, nodes: DataFrame, radius: int) -> DataFrame:
    """``distance2`` of the nodes within ``radius``."""
    return distance2(mask, nodes).where(F.col("d2") <= radius * radius)


def largest_component(labels: DataFrame) -> DataFrame:
    """(col, row) of the label with most nodes; of equals the first in order."""
    best = labels.groupBy("label").count().orderBy(F.desc("count"), "label").limit(1)
    return labels.join(F.broadcast(best.select("label")), "label", "left_semi").select("col", "row")


#: Nodes of a gap that one task solves.
GAP = 2_000_000


def _solved(key, rows):
    """One gap's nodes as the mean of their neighbours: conjugate gradients on the graph of its nodes, borders known."""
    inner = rows[rows["i"] == 0]
    n = len(inner)
    at = {k: i for i, k in enumerate(zip(inner["col"].tolist(), inner["row"].tolist(), strict=True))}
    edge = {(c, r): v for c, r, v in rows.loc[rows["i"] == 1, ["col", "row", "v"]].itertuples(index=False)}
    i, j, degree, right = [], [], np.zeros(n), np.zeros(n)
    for (c, r), k in at.items():
        for near in ((c + 1, r), (c - 1, r), (c, r + 1), (c, r - 1)):
            if near in at:
                i.append(k)
                j.append(at[near])
                degree[k] += 1
            elif near in edge:
                right[k] += edge[near]
                degree[k] += 1
    i, j = np.array(i, int), np.array(j, int)
    apply = lambda x: degree * x - np.bincount(i, x[j], n)
    x = np.full(n, right.sum() / max(degree.sum() - len(i), 1))
    res = right - apply(x)
    step, size = res.copy(), res @ res
    for _ in range(20 * n):
        if size <= 1e-26 * max(1.0, right @ right):
            break
        moved = apply(step)
        alpha = size / (step @ moved)
        x, res = x + alpha * step, res - alpha * moved
        before, size = size, res @ res
        step = res + size / before * step
    return pd.DataFrame({"col": inner["col"], "row": inner["row"], "v": x, "residual": np.abs(right - apply(x)) / np.maximum(degree, 1)})


def harmonic_filled(grid: DataFrame, unknown: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(col, row, v, residual): unknown nodes as the mean of their neighbours, solved; known ones have residual 0.

    Each connected gap is a system of its own, solved in one task with its
    border. Gaps of more than ``GAP`` nodes go by rounds over the table until no
    node moves by more than ``tolerance``. A gap that no known node borders gets the mean of what is known.
    """
    from geolode.plans.lineage import materialized

    known = grid.select("col", "row", F.col("v").cast("double").alias("v"))
    gaps = labelled(unknown.select("col", "row").distinct().join(known, ["col", "row"], "left_anti"))
    gaps = materialized(gaps)
    shifts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    rim = gaps.withColumn("s", F.explode(shifts)).select((F.col("col") + F.col("s.i")).alias("col"), (F.col("row") + F.col("s.j")).alias("row"), "label").distinct().join(known, ["col", "row"])
    mean = known.agg(F.avg("v").alias("m"))
    size = gaps.groupBy("label").agg(F.count("*").alias("n")).join(rim.groupBy("label").agg(F.avg("v").alias("start")), "label", "left")
    gaps = materialized(gaps.join(size, "label"))
    free = gaps.where("start is null").join(F.broadcast(mean), how="cross").select("col", "row", F.col("m").alias("v"), F.lit(0.0).alias("residual"))
    small = gaps.where(f"start is not null and n <= {GAP}").select("label", "col", "row", F.lit(None).cast("double").alias("v"), F.lit(0).alias("i"))
    border = rim.join(size.where(f"n <= {GAP}").select("label"), "label", "left_semi").select("label", "col", "row", "v", F.lit(1).alias("i"))
    solved = small.unionByName(border).groupBy("label").applyInPandas(_solved, f"col {grid.schema['col'].dataType.simpleString()}, row {grid.schema['row'].dataType.simpleString()}, v double, residual double")
    out = known.withColumn("residual", F.lit(0.0)).unionByName(free).unionByName(solved)
    z = gaps.where(f"start is not null and n > {GAP}").select("col", "row", F.col("start").alias("v"), F.lit(G.INF).alias("residual"))
    if z.limit(1).count() == 0:
        return out
    while z.where(F.col("residual") > tolerance).limit(1).count():
        for _ in range(8):
            ring = z.select("col", "row", "v").unionByName(known).withColumn("s", F.explode(shifts)).groupBy((F.col("col") + F.col("s.i")).alias("col"), (F.col("row") + F.col("s.j")).alias("row")).agg(F.avg("v").alias("m"))
            z = z.join(ring, ["col", "row"]).select("col", "row", F.col("m").alias("v"), F.abs(F.col("m") - F.col("v")).alias("residual"))
        z = materialized(z)
    return out.unionByName(z)


def with_classified_ground(filtered: DataFrame, raster: DataFrame) -> DataFrame:
    """Ground where points of the ground class say so, the filter's elsewhere."""
    return filtered.join(raster.select("col", "row", "ground"), ["col", "row"]).select("col", "row", F.coalesce("ground", "v").alias("v"), (F.col("is_ground") | F.col("ground").isNotNull()).alias("is_ground"))


#: Nodes of a raster at most.
MOST_NODES = 16_000_000


def cell_size(cloud: DataFrame) -> float:
    """Side of a cell that holds four points on the average, larger where the raster would have too many nodes; 1 for no points."""
    n, x0, x1, y0, y1 = cloud.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if not n:
        return 1.0
    w, h = x1 - x0, y1 - y0
    cell = max(math.sqrt(max(w * h, 1e-12) * 4 / n), max(w, h) / (MOST_NODES - 1))
    while (math.floor(w / cell) + 2) * (math.floor(h / cell) + 2) > MOST_NODES:
        cell *= 1.5
    return cell


def mesh_rasterized(xyz: DataFrame, cell: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """(col, row, n, top, low) of the nodes that faces cover, borders included by 1e-9 of a weight: the highest and the lowest surface there.

    A face meets the nodes of its own box only; faces without area cover none.
    """
    low, high = (lambda k: F.least(*(F.col(f"{c}{k}") for c in "abc"))), (lambda k: F.greatest(*(F.col(f"{c}{k}") for c in "abc")))
    whole = G.orient("ax", "ay", "bx", "by", "cx", "cy")
    size = F.greatest(high("x") - low("x"), high("y") - low("y"))
    f = xyz.where(F.abs(whole) / 2 > 1e-12 * size * size)
    span = lambda k, o: F.explode(F.sequence(F.ceil((low(k) - o) / cell - 1e-9), F.floor((high(k) - o) / cell + 1e-9)))
    nodes = lambda k, o: F.floor((high(k) - o) / cell + 1e-9) >= F.ceil((low(k) - o) / cell - 1e-9)
    f = f.where(nodes("x", x0) & nodes("y", y0)).withColumn("col", span("x", x0)).withColumn("row", span("y", y0))
    px, py = F.col("col") * cell + x0, F.col("row") * cell + y0
    wa, wb = G.orient("bx", "by", "cx", "cy", px, py) / whole, G.orient("cx", "cy", "ax", "ay", px, py) / whole
    f = f.select("col", "row", "az", "bz", "cz", wa.alias("wa"), wb.alias("wb")).withColumn("wc", 1 - F.col("wa") - F.col("wb")).where("wa >= -1e-9 and wb >= -1e-9 and wc >= -1e-9")
    z = F.col("wa") * F.col("az") + F.col("wb") * F.col("bz") + F.col("wc") * F.col("cz")
    return f.groupBy("col", "row").agg(F.count("*").alias("n"), F.max(z).alias("top"), F.min(z).alias("low"))


def disc_opened(mask: DataFrame, nodes: DataFrame, radius: float) -> DataFrame:
    """(col, row) of a mask opened by a disc: its nodes within the radius of one that lies farther than that from every node outside. ``nodes`` is the whole raster."""
    outside = nodes.select("col", "row").join(mask.select("col", "row"), ["col", "row"], "left_anti")
    core = distance2(outside, nodes).where(F.col("d2").isNull() | (F.col("d2") > radius * radius))
    return distance2(core, mask).where(F.col("d2") <= radius * radius).select("col", "row")


def ground_mesh(grid: DataFrame, factor: int, cell: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of every ``factor``-th node (from 0): heights are means of a square around it, as far as it lies evenly inside the raster; two faces to each cell with four corners.

    Vertices are named row * width + col, so faces need no ranks.
    """
    size = grid.agg(F.max("col").alias("mc"), F.max("row").alias("mr"))
    reach = factor // 2
    g = grid.select("col", "row", "v").join(F.broadcast(size), how="cross").withColumn("width", F.floor(F.col("mc") / factor) + 1)
    centre = g.where((F.col("col") % factor == 0) & (F.col("row") % factor == 0)).select("width", F.col("col").alias("c"), F.col("row").alias("r"), F.least(F.lit(reach), "col", F.col("mc") - F.col("col")).alias("rx"), F.least(F.lit(reach), "row", F.col("mr") - F.col("row")).alias("ry"))
    square = centre.withColumn("col", F.explode(F.sequence(F.col("c") - F.col("rx"), F.col("c") + F.col("rx")))).withColumn("row", F.explode(F.sequence(F.col("r") - F.col("ry"), F.col("r") + F.col("ry"))))
    mean = square.join(grid.select("col", "row", "v"), ["col", "row"]).groupBy("c", "r", "width").agg(F.avg("v").alias("z"))
    i, j = (F.col("c") / factor).cast("long"), (F.col("r") / factor).cast("long")
    v = mean.select((j * F.col("width") + i).alias("vid"), (F.col("c") * cell).cast("double").alias("x"), (F.col("r") * cell).cast("double").alias("y"), "z", "width")
    k, w = F.col("vid"), F.col("width")
    need = v.where(k % w < w - 1).select(k.alias("cell"), "width", F.explode(F.array(k, k + 1, k + w, k + w + 1)).alias("vid"))
    full = need.join(v.select("vid"), "vid", "left_semi").groupBy("cell", "width").count().where("count = 4")
    at = F.col("cell")
    faces = full.select(F.explode(F.array(F.struct((2 * at).alias("fid"), at.alias("a"), (at + 1).alias("b"), (at + w).alias("c")), F.struct((2 * at + 1).alias("fid"), (at + 1).alias("a"), (at + w + 1).alias("b"), (at + w).alias("c")))).alias("f")).select("f.*")
    return v.drop("width"), faces


def mask_outlines(mask: DataFrame) -> DataFrame:
    """(label, loop, seq, x, y): the borders of a mask's connected parts as loops of corners of their nodes' cells, the part on the left. Corners lie half a node off."""
    from geolode.operators.drainage import _loops
    from geolode.operators.graphs import by_groups

    lab = labelled(mask)
    width = 1 << 31
    corner = lambda c, r: (F.col("row") + r) * width + F.col("col") + c
    sides = [((0, -1), (0, 0), (1, 0)), ((1, 0), (1, 0), (1, 1)), ((0, 1), (1, 1), (0, 1)), ((-1, 0), (0, 1), (0, 0))]
    e = lab.select("label", F.explode(F.array(*[F.struct((F.col("col") + dc).alias("nc"), (F.col("row") + dr).alias("nr"), corner(*p).alias("a"), corner(*q).alias("b")) for (dc, dr), p, q in sides])).alias("s")).select("label", "s.*")
    rim = e.join(mask.select(F.col("col").alias("nc"), F.col("row").alias("nr")), ["nc", "nr"], "left_anti").select("label", "a", "b")
    loops = by_groups(rim, "label", _loops, "label string, loop int, seq int, vid long")
    return loops.select("label", "loop", "seq", (F.pmod("vid", F.lit(width)) - F.lit(0.5)).alias("x"), (F.floor(F.col("vid") / width) - F.lit(0.5)).alias("y"))
