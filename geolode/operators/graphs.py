"""Iterative graph operators: components, roots of a flow, basins, peeling, clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolode.functions import geometry as G
from geolode.operators import topology
from geolode.plans.lineage import materialized


#: Links that one task joins by itself; more go by rounds over the table.
SMALL = 500_000


def _joined(frames):
    """Roots of the nodes that links join, the least of each component."""
    root: dict = {}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for f in frames:
        for a, b in zip(f["a"].tolist(), f["b"].tolist(), strict=True):
            a, b = find(root.setdefault(a, a)), find(root.setdefault(b, b))
            if a != b:
                root[max(a, b)] = min(a, b)
    nodes = list(root)
    if nodes:
        yield pd.DataFrame({"node": nodes, "root": [find(x) for x in nodes]})


def _by_rounds(once: DataFrame) -> DataFrame:
    """(node, root) of the nodes of links: each round a tree's root hooks on to the least grandparent that any of its nodes sees across a link, and every node moves up to its grandparent."""
    both = materialized(once.union(once.select("b", "a")).toDF("a", "b"))
    label = materialized(both.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node")))
    while True:
        up = label.select(F.col("node").alias("root"), F.col("root").alias("grand"))
        at = label.join(up, "root").select("node", "root", "grand")
        near = both.join(at.select(F.col("node").alias("b"), "grand"), "b").groupBy(F.col("a").alias("node")).agg(F.min("grand").alias("near"))
        at = materialized(at.join(near, "node", "left"))
        hook = at.groupBy(F.col("root").alias("node")).agg(F.min("near").alias("hook"))
        step = materialized(at.join(hook, "node", "left").select("node", F.least("root", "grand", "near", "hook").alias("root"), F.col("root").alias("was")))
        if step.where("root != was").limit(1).count() == 0:
            return label
        label = step.select("node", "root")


#: Links of one range that are joined where they lie, before what leads from range to range is.
RANGE = 250_000


def _roots(once: DataFrame, kind: str) -> DataFrame:
    """(node, root) of the nodes of links (a < b, each once)."""
    n = once.count()
    if n <= SMALL:
        return once.coalesce(1).mapInPandas(_joined, f"node {kind}, root {kind}")
    cut = materialized(once.repartitionByRange(-(-n // RANGE), "a").withColumn("part", F.spark_partition_id()))
    low = sorted((r.part, r.lo) for r in cut.groupBy("part").agg(F.min("a").alias("lo")).collect())  # one row a range
    end = {part: low[i + 1][1] if i + 1 < len(low) else None for i, (part, _) in enumerate(low)}

    def joined(frames):
        part = None

        def seen():
            nonlocal part
            for f in frames:
                if len(f):
                    part = int(f["part"].iat[0])
                yield f

        for out in _joined(seen()):
            top = end[part]
            yield out.assign(beyond=[top is not None and x >= top for x in out["node"].tolist()])

    # A node of a later range is named by its own range's root, or by itself where no link starts there.
    local = materialized(cut.mapInPandas(joined, f"node {kind}, root {kind}, beyond boolean"))
    own, out = local.where("not beyond").select("node", "root"), local.where("beyond").select("node", "root")
    far = out.select(F.col("root").alias("a"), "node").join(own.withColumnRenamed("root", "b"), "node", "left").select("a", "node", F.coalesce("b", "node").alias("b"))
    left = materialized(far.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct())
    top = _roots(left, kind) if left.count() <= max(SMALL, n // 2) else _by_rounds(left)
    top = top.select(F.col("node").alias("root"), F.col("root").alias("top"))
    all_ = own.unionByName(out.join(own.select("node"), "node", "left_anti").groupBy("node").agg(F.min("root").alias("root")))
    return all_.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root"))


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root): least node reachable over links (a, b), itself included.

    Few links (``SMALL``) are joined in one task. More are joined range by range of their lesser end first,
    so that names which lie near one another where the graph is connected leave few links between ranges;
    what is left goes the same way while it shrinks, and by rounds over the table otherwise.
    """
    once = materialized(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    kind = nodes.schema["node"].dataType.simpleString()
    root = _roots(once, kind) if kind in ("bigint", "int", "string") else _by_rounds(once)
    return materialized(nodes.select("node").join(root, "node", "left").select("node", F.coalesce("root", "node").alias("root")))


def by_groups(rows: DataFrame, key: str, kernel, schema: str) -> DataFrame:
    """Rows that ``kernel(key, *other columns as lists)`` returns as tuples for each group, which lies in one task.

    A task's groups follow one another in its batches, so that many small groups cost no call of Spark's each.
    """
    others = [c for c in rows.columns if c != key]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames):
        at, held, out = None, [[] for _ in others], []
        for f in frames:
            columns = [f[c].tolist() for c in others]
            keys = f[key]
            cuts = [*keys.index[keys.ne(keys.shift())].tolist(), len(f)] if len(f) else []
            names_ = keys.tolist()
            for lo, hi in zip(cuts, cuts[1:]):  # noqa: B905, RUF007
                if held[0] and names_[lo] != at:
                    out += kernel(at, *held)
                    held = [[] for _ in others]
                at = names_[lo]
                for h, c in zip(held, columns, strict=True):
                    h += c[lo:hi]
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=names)
                out = []
        if held[0]:
            out += kernel(at, *held)
        if out:
            yield pd.DataFrame(out, columns=names)

    return rows.select(key, *others).repartition(key).sortWithinPartitions(key).mapInPandas(run, schema)


_AT = "fid long, to long, low long, open boolean"


def _followed(frames):
    """Rows (fid, to, low, open) of one range, each led on as far as faces of the range go: to what lies beyond (open) or to its end; ``low`` is the least face on the way."""
    frames = [f for f in frames if len(f)]
    if not frames:
        return
    t = pd.concat(frames).sort_values("fid", ignore_index=True)
    fid, to, low, open_ = (t[c].to_numpy() for c in ("fid", "to", "low", "open"))
    at = np.minimum(np.searchsorted(fid, to), len(fid) - 1)
    inside = open_ & (fid[at] == to)
    jump = np.where(inside, at, np.arange(len(fid)))
    for _ in range(len(fid).bit_length()):
        low, further = np.minimum(low, low[jump]), jump[jump]
        if np.array_equal(further, jump):
            break
        jump = further
    # Who is not at a way out or an end by now is on a cycle, and its least face is the way's.
    round_ = inside[jump]
    yield pd.DataFrame({"fid": fid, "to": np.where(round_, low[jump], to[jump]), "low": low, "open": open_[jump] & ~round_})


def _tripled(at: DataFrame) -> DataFrame:
    """(fid, to) of rows (fid, to, low, open), by pointers that triple their stride a round."""
    ended, loose = at.where("not open"), at.where("open")
    before = None
    while True:
        nxt = ended.unionByName(loose).select(F.col("fid").alias("to"), F.col("to").alias("to2"), F.col("low").alias("low2"), F.col("open").alias("open2"))
        step = loose
        for _ in range(2):
            step = step.join(nxt, "to").select("fid", F.col("to2").alias("to"), F.when(F.col("open2"), F.least("low", "low2")).otherwise(F.col("low")).alias("low"), F.col("open2").alias("open"))
        step = materialized(step)
        ended, loose = ended.unionByName(step.where("not open")), step.where("open")
        reached = loose.select(F.col("to").alias("fid")).distinct()
        now = tuple(loose.join(reached, "fid", "left_semi").agg(F.count("*"), F.sum("low")).first())
        # Images of what has no end only shrink: once they stand still they are the
        # cycles, and once the least faces on the way do too, each has seen its cycle.
        if now[0] == 0 or now == before:
            break
        before = now
    # From a face on a cycle the path is the cycle, so its least face is the path's.
    cycles = loose.select(F.col("fid").alias("to"), F.col("low").alias("root"))
    return ended.select("fid", "to").unionByName(loose.select("fid", "to").join(cycles, "to").select("fid", F.col("root").alias("to")))


def _ends(at: DataFrame, n: int) -> DataFrame:
    """(fid, to) of ``n`` rows (fid, to, low, open): where each way ends. What leads to no row has no end and drops out."""
    if n <= SMALL:
        return at.coalesce(1).mapInPandas(_followed, _AT).where("not open").select("fid", "to")
    cut = materialized(at.repartitionByRange(-(-n // RANGE), "fid").mapInPandas(_followed, _AT))
    loose = cut.where("open")
    # Only faces that another range leads to matter to it.
    entry = materialized(cut.join(loose.select(F.col("to").alias("fid")).distinct(), "fid", "left_semi"))
    m = entry.count()
    top = _ends(entry, m) if m <= max(SMALL, n // 2) else _tripled(entry)
    return cut.where("not open").select("fid", "to").unionByName(loose.select("fid", "to").join(top.select(F.col("fid").alias("to"), F.col("to").alias("end")), "to").select("fid", F.col("end").alias("to")))


def flow_roots(flow: DataFrame) -> DataFrame:
    """(fid, root): where each face's flow ends (rows fid, flows_to).

    Faces up to ``SMALL`` are followed in one task, more range by range, and then what leads from range to range;
    where names say nothing of place, so that most faces do, pointers triple their stride over the table.
    A cycle counts as one end, named by its least face; an outlet or a flat face is its own end.
    """
    fid, to = F.col("fid").cast("long"), F.col("flows_to").cast("long")
    at = materialized(flow.where("flows_to is not null").select(fid.alias("fid"), F.when(to < 0, fid).otherwise(to).alias("to"), fid.alias("low"), (to >= 0).alias("open")))
    return _ends(at, at.count()).select("fid", F.col("to").alias("root"))


def basins(roots: DataFrame, measured: DataFrame) -> DataFrame:
    """(root, n_faces, plan_area, low_z) of the faces that drain to one end."""
    low = F.least("az", "bz", "cz")
    return roots.join(measured, "fid").groupBy("root").agg(F.count("*").alias("n_faces"), F.sum("plan_area").alias("plan_area"), F.min(low).alias("low_z"))


def merge_clusters(points: DataFrame, distance: float) -> DataFrame:
    """(pid, cluster, x, y, z): points within a distance of one another in space, transitively, and their cluster's mean.

    Pairs come from cells of the distance's size and their neighbours, so nothing far apart meets.
    """
    p = points.select("pid", "x", "y", "z", *(F.floor(F.col(k) / distance).alias(f"g{k}") for k in "xyz"))
    shifts = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(dz).alias("dz")) for dx in (-1, 0, 1) for dy in (-1, 0, 1) for dz in (-1, 0, 1)])
    q = p.withColumn("s", F.explode(shifts)).select(F.col("pid").alias("qid"), F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("z").alias("qz"), *((F.col(f"g{k}") + F.col(f"s.d{k}")).alias(f"g{k}") for k in "xyz"))
    near = p.join(q, ["gx", "gy", "gz"]).where((F.col("pid") < F.col("qid")) & (G.distance3_2("x", "y", "z", "qx", "qy", "qz") <= distance * distance))
    c = components(points.select(F.col("pid").alias("node")), near.select(F.col("pid").alias("a"), F.col("qid").alias("b")))
    c = c.select(F.col("node").alias("pid"), F.col("root").alias("cluster"))
    mean = c.join(points, "pid").groupBy("cluster").agg(*(F.avg(k).alias(k) for k in "xyz"), F.count("*").alias("n"))
    return c.join(mean, "cluster")


def merge_targets(points: DataFrame, mode: str) -> DataFrame:
    """(pid, x, y, z): where points go when they are made one: ``first`` or ``last`` by id, or ``centre``, their mean."""
    if mode == "centre":
        one = points.agg(*(F.avg(k).alias(k) for k in "xyz"))
    else:
        pick = {"first": F.min_by, "last": F.max_by}[mode]
        one = points.agg(pick(F.struct("x", "y", "z"), "pid").alias("p")).select("p.*")
    return points.select("pid").join(F.broadcast(one), how="cross")


def peel_threshold(xyz: DataFrame, factor: float = 4.0) -> float:
    """An edge length beyond which border faces go when none is given: a multiple of the median edge in plan."""
    ends = [F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v"), F.sqrt(G.distance2(f"{p}x", f"{p}y", f"{q}x", f"{q}y")).alias("l")) for p, q in ("ab", "bc", "ca")]
    e = xyz.select(F.explode(F.array(*ends)).alias("e")).groupBy("e.u", "e.v").agg(F.min("e.l").alias("l"))
    r = topology.ranked(e, [F.asc("l"), F.asc("u"), F.asc("v")], "k")
    n = r.count()
    return factor * r.where(F.col("k") == n // 2).first().l if n else 0.0


def peeled(xyz: DataFrame, faces: DataFrame, longest: float = 0.0, angle: float = 170.0, slope: float = 0.0) -> DataFrame:
    """Faces left after border faces that qualify are taken off, again and again.

    A face qualifies if its longest edge in plan is longer than ``longest`` (0: four times the
    median edge) and its widest angle there is at least ``angle`` degrees, or if it is steeper
    than ``slope`` degrees. A negative length leaves all faces, an angle or slope of 0 is not looked at.
    Peeling runs on over edges of two faces, so what goes are the connected qualifying faces that reach the border.
    """
    if longest < 0:
        return faces
    if longest == 0 and angle > 0:
        longest = peel_threshold(xyz)
    side = lambda p, q: F.sqrt(G.distance2(f"{p}x", f"{p}y", f"{q}x", f"{q}y"))

    def widest(o, p, q):
        ux, uy, vx, vy = F.col(f"{p}x") - F.col(f"{o}x"), F.col(f"{p}y") - F.col(f"{o}y"), F.col(f"{q}x") - F.col(f"{o}x"), F.col(f"{q}y") - F.col(f"{o}y")
        return F.degrees(F.atan2(F.abs(G.cross(ux, uy, vx, vy)), ux * vx + uy * vy))

    goes = F.lit(False)
    if longest > 0 and angle > 0:
        goes = goes | ((F.greatest(side("a", "b"), side("b", "c"), side("c", "a")) > longest) & (F.greatest(widest("a", "b", "c"), widest("b", "c", "a"), widest("c", "a", "b")) >= angle))
    if slope > 0:
        goes = goes | (F.degrees(F.atan(G.slope_ratio())) > slope)
    odd = materialized(xyz.where(goes).select("fid").join(faces.select("fid"), "fid", "left_semi"))
    e = topology.half_edges(faces).where("u != v")
    shared = topology.edges(faces)
    mine = materialized(e.join(odd, "fid", "left_semi").join(shared, ["u", "v"]).select("fid", "u", "v", "n_faces"))
    pair = mine.where("n_faces = 2").groupBy("u", "v").agg(F.min("fid").alias("a"), F.max("fid").alias("b")).where("a != b")
    root = components(odd.select(F.col("fid").alias("node")), pair.select("a", "b"))
    border = root.join(mine.where("n_faces = 1").select(F.col("fid").alias("node")).distinct(), "node", "left_semi").select("root").distinct()
    gone = root.join(border, "root", "left_semi").select(F.col("node").alias("fid"))
    return faces.join(gone, "fid", "left_anti")
