"""Drainage as a whole: flat regions, sinks that share a floor, small basins, measures and outlines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geolode.functions import geometry as G
from geolode.operators import topology
from geolode.operators.graphs import by_groups, components, flow_roots
from geolode.plans.lineage import materialized

#: Where a flow ends: over the border, or in a sink.
BORDER, SINK = -1, -2


def _sides(neighbours: DataFrame) -> DataFrame:
    """(fid, k, nid) of every edge with a neighbour across it."""
    return neighbours.select("fid", F.posexplode(F.array("n0", "n1", "n2")).alias("k", "nid"))


#: Faces of a flat region, neighbouring pairs of basins, or either of a whole table, that one task takes by itself; more go by rounds over the table.
SMALL = 500_000

#: Edges of one range of basins, when more than that are joined.
RANGE = 250_000


def _led(_, fids, what, to, z):
    """(fid, flows_to) of whole flat regions: faces with heights (0), ways out (1) and neighbours (2)."""
    height, out, near, back = {}, {}, {}, {}
    for i, w, j, h in zip(fids, what, to, z, strict=True):
        if w == 0:
            height[i] = (h != h, h if h == h else 0.0, i)
        elif w == 1:
            out[i] = j
        else:
            near.setdefault(i, []).append(j)
            back.setdefault(j, []).append(i)
    seen: set = set()
    ways = set(out)
    for start in height:
        if start in seen:
            continue
        seen.add(start)
        region = [start]
        for x in region:
            for y in (*near.get(x, ()), *back.get(x, ())):
                if y not in seen:
                    seen.add(y)
                    region.append(y)
        if ways.isdisjoint(region):
            out[min(region, key=height.__getitem__)] = SINK
    front = dict(out)
    while front:
        step: dict = {}
        for n in front:
            for i in back.get(n, ()):
                if i not in out:
                    step[i] = min(step.get(i, n), n)
        out |= step
        front = step
    return list(out.items())


def with_flats(flow: DataFrame, neighbours: DataFrame, centroids: DataFrame) -> DataFrame:
    """``flow`` (fid, flows_to) with its flat faces (-2) led to where their region spills.

    A flat face with a lower neighbour that is not flat (by centroid, rows fid, z)
    flows to the lowest such, of equals the least; else one at the border flows
    over it. The other faces of a region flow, in steps, to the least neighbour
    that is one step nearer to such a face. A region without any is a sink at its lowest face.
    """
    flow = materialized(flow)
    flat = flow.where(F.col("flows_to") == SINK).select("fid")
    side = materialized(_sides(neighbours).join(flat, "fid", "left_semi"))
    is_flat = flat.select(F.col("fid").alias("nid"), F.lit(True).alias("flat"))
    inner = materialized(side.join(is_flat.select("nid"), "nid", "left_semi").select("fid", "nid"))
    z = centroids.select("fid", "z")
    rim = side.where("nid >= 0").join(is_flat.select("nid"), "nid", "left_anti").join(z, "fid").join(z.select(F.col("fid").alias("nid"), F.col("z").alias("nz")), "nid").where("nz < z")
    spill = rim.groupBy("fid").agg(F.min(F.struct("nz", "nid")).alias("to")).select("fid", F.col("to.nid").alias("flows_to"))
    over = side.where("nid < 0").select("fid").distinct().join(spill, "fid", "left_anti").select("fid", F.lit(BORDER).cast("long").alias("flows_to"))
    done = materialized(spill.unionByName(over))
    none = F.lit(0).cast("long")
    rows = flat.join(z, "fid").select("fid", F.lit(0).alias("what"), none.alias("to"), F.coalesce("z", F.lit(float("-inf"))).alias("z"))
    rows = rows.unionByName(done.select("fid", F.lit(1).alias("what"), F.col("flows_to").alias("to"), F.lit(0.0).alias("z")))
    rows = rows.unionByName(inner.select("fid", F.lit(2).alias("what"), F.col("nid").alias("to"), F.lit(0.0).alias("z")))
    led, small = "fid long, flows_to long", inner.limit(SMALL + 1).count() <= SMALL
    if small:
        routed = by_groups(rows.withColumn("region", none), "region", _led, led)
        return flow.where(F.col("flows_to") != SINK).unionByName(routed)
    region = components(flat.select(F.col("fid").alias("node")), inner.select(F.col("fid").alias("a"), F.col("nid").alias("b")))
    region = region.select(F.col("node").alias("fid"), F.col("root").alias("region"))
    if (region.groupBy("region").count().agg(F.max("count")).first()[0] or 0) <= SMALL:
        routed = by_groups(rows.join(region, "fid"), "region", _led, led)
        return flow.where(F.col("flows_to") != SINK).unionByName(routed)
    dry = region.join(region.join(done, "fid", "left_semi").select("region").distinct(), "region", "left_anti").join(z, "fid")
    sinks = dry.groupBy("region").agg(F.min(F.struct("z", "fid")).alias("s")).select(F.col("s.fid").alias("fid"), F.lit(SINK).cast("long").alias("flows_to"))
    done = materialized(done.unionByName(sinks))
    routed, front = done, done
    while True:
        # A step a round: what borders on the front and is not routed yet.
        nxt = inner.join(front.select(F.col("fid").alias("nid")), "nid").join(routed.select("fid"), "fid", "left_anti").groupBy("fid").agg(F.min("nid").alias("flows_to"))
        front = materialized(nxt)
        if not front.limit(1).count():
            break
        routed = materialized(routed.unionByName(front))
    return flow.where(F.col("flows_to") != SINK).unionByName(routed.select("fid", "flows_to"))


def _pairs(roots: DataFrame, xyz: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(root, other, low, high): each basin's neighbours, with the first side by height of its edge's lower, and of its higher end, as (height, fid, k)."""
    ends = [(F.least(f"{p}z", f"{q}z"), F.greatest(f"{p}z", f"{q}z")) for p, q in ("ab", "bc", "ca")]
    side = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"n{k}").alias("nid"), low.alias("low"), high.alias("high")) for k, (low, high) in enumerate(ends)])
    e = xyz.join(neighbours, "fid").join(roots, "fid").select("fid", "root", F.explode(F.filter(side, lambda x: x["nid"] >= 0)).alias("e")).select("fid", "root", "e.*")
    e = e.join(roots.select(F.col("fid").alias("nid"), F.col("root").alias("other")), "nid").where("root != other")
    return materialized(e.groupBy("root", "other").agg(F.min(F.struct("low", "fid", "k")).alias("low"), F.min(F.struct("high", "fid", "k")).alias("high")))


def _kept(_, a, what, b, low, fid, k):
    """(root, keeper): the rounds of ``consolidated`` over floors (0), shared floors (1) and pairs (2) in memory."""
    z, links, pairs = {}, [], []
    for p, w, q, h, f, s in zip(a, what, b, low, fid, k, strict=True):
        if w == 0:
            z[p] = h
        elif w == 1:
            links.append((p, q))
        else:
            pairs.append((p, q, (h, f, s)))
    up = {p: p for p in z}

    def find(p):
        while up[p] != p:
            up[p] = p = up[up[p]]
        return p

    while True:
        for p, q in links:
            p, q = find(p), find(q)
            if p != q:
                # The lower floor keeps its name, of equal floors the least.
                p, q = sorted((p, q), key=lambda x: (z[x], x))
                up[q] = p
        now, best = [], {}
        for p, q, m in pairs:
            p, q = find(p), find(q)
            if p == q or m[0] > max(z[p], z[q]):
                continue
            now.append((p, q, m))
            for x, y in ((p, q), (q, p)):
                if z[x] >= z[y] and m[0] <= z[x] and (x not in best or m < best[x][0]):
                    best[x] = m, y
        if not best:
            return [(p, find(p)) for p in up]
        pairs, links = now, [(x, y) for x, (_, y) in best.items()]


#: Clusters of basins: may join on, holds a basin of another range, has joined a lower floor.
FREE, STUCK, DONE = 0, 1, 2


def _grown(up: dict, state: dict, edges: list) -> tuple[list, list]:
    """Picks of free clusters until none is left, and the edges that stuck ones keep.

    An edge (order, basin, other, a, b) is its basin's to pick; without other it leads to a lower floor.
    """
    picks, held = [], []

    def find(p):
        while up[p] != p:
            up[p] = p = up[up[p]]
        return p

    while True:
        best, now = {}, []
        for m, p, q, a, b in edges:
            p = find(p)
            if q is not None:
                q = find(q)
                q = None if state[q] == DONE else q
            if p == q or state[p] == DONE:
                continue
            e = m, p, q, a, b
            if state[p] == STUCK:
                held.append(e)
                continue
            now.append(e)
            if p not in best or m < best[p][0]:
                best[p] = e
        if not best:
            break
        for _, p, q, a, b in best.values():
            p = find(p)
            if q is None:
                state[p] = DONE
            else:
                q = find(q)
                if p == q:  # picked from either side
                    continue
                up[p] = q
                state[q] = max(state[p], state[q])
            picks.append((a, b))
        edges = now
    least: dict = {}
    for m, p, q, a, b in held:
        p, q = find(p), None if q is None else find(q)
        q = None if q is not None and state[q] == DONE else q
        if p != q and state[p] != DONE and ((p, q) not in least or m < least[p, q][0]):
            least[p, q] = m, p, q, a, b
    return picks, list(least.values())


_PART = "what int, p long, q long, low double, fid long, k int, a long, b long"


def _local(frames):
    """Picks (0) of one range of basins; whose cluster its basins next to another range are in (1); and of stuck clusters the basins of others in them (2) and their edges (3)."""
    edges, up, far = [], {}, set()
    for f in frames:
        rows = [f[c].tolist() for c in ("p", "q", "lower", "low", "fid", "k")]
        for p, q, lower, low, fid, k in zip(*rows, strict=True):
            up[p] = p
            edges.append(((low, fid, k), p, None if lower else q, p, q))
    state = dict.fromkeys(up, FREE)
    rim = set()
    for _, p, q, _, _ in edges:
        if q is not None and q not in state:
            rim.add(p)
            far.add(q)
    for q in far:
        up[q], state[q] = q, STUCK
    picks, held = _grown(up, state, edges)

    def find(p):
        while up[p] != p:
            p = up[p]
        return p

    # A range's clusters go by names of their own: the least of its basins in it.
    name: dict = {}
    for p in state:
        if p not in far:
            r = find(p)
            name[r] = min(name.get(r, p), p)
    out = [(0, None, None, None, None, None, a, b) for a, b in picks]
    out += [(1, p, name[find(p)], float(state[find(p)] == DONE), None, None, None, None) for p in rim]
    out += [(2, name[find(q)], q, None, None, None, None, None) for q in far if find(q) in name]
    out += [(3, name[p], None if q is None else name.get(q, q), *m, a, b) for m, p, q, a, b in held if p in name]
    t = pd.DataFrame(out, columns=[c.split()[0] for c in _PART.split(", ")])
    yield t.astype({c: "Float64" if c == "low" else "Int64" for c in t.columns})


def _between(_, what, p, q, done, low, fid, k, a, b):
    """Picks (a, b) of what is left between ranges: clusters joined already (2) and edges (3), of clusters of which ``done`` says what the other's is."""
    up, state, edges, links = {}, {}, [], []
    for w, x, y, d, h, f, s, i, j in zip(what, p, q, done, low, fid, k, a, b, strict=True):
        up.setdefault(x, x)
        state.setdefault(x, FREE)
        y = None if y < 0 else y
        if y is not None:
            up.setdefault(y, y)
            state[y] = max(state.get(y, FREE), DONE if d else FREE)
        if w == 2:
            links.append((x, y))
        else:
            edges.append(((h, f, s), x, y, i, j))

    def find(n):
        while up[n] != n:
            up[n] = n = up[up[n]]
        return n

    for x, y in links:
        x, y = find(x), find(y)
        if x != y:
            up[x] = y
            state[y] = max(state[x], state[y])
    return _grown(up, state, edges)[0]


def _links_by_ranges(edges: DataFrame, n: int) -> DataFrame | None:
    """(a, b) over which basins join, of ``n`` edges (p, q, lower, low, fid, k) that are p's to pick; none if too much leads from range to range.

    Of an edge's order only the first of a cluster counts, so what a range's clusters pick holds
    while they lie in it as wholes, whatever others do; the rest is settled in one task.
    """
    part = materialized(edges.repartitionByRange(-(-n // RANGE), "p").mapInPandas(_local, _PART))
    label = part.where("what = 1").select(F.col("p").alias("q"), F.col("q").alias("name"), (F.col("low") > 0).alias("done"))
    left = part.where("what > 1").join(label, "q", "left")
    left = materialized(left.select("what", "p", F.coalesce("name", "q", F.lit(-1)).alias("q"), F.coalesce("done", F.lit(False)).alias("done"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("low", "fid", "k", "a", "b"))).where("what = 3 or p != q"))
    if left.limit(SMALL + 1).count() > SMALL:
        return None
    rest = by_groups(left.withColumn("g", F.lit(0)), "g", _between, "a long, b long")
    return materialized(part.where("what = 0").select("a", "b").unionByName(rest))


def _keepers(roots: DataFrame, sinks: DataFrame, xyz: DataFrame, pairs: DataFrame) -> DataFrame:
    """(root, keeper) of the sinks, by ``consolidated``."""
    low = F.array_min(F.array(*[F.struct(F.col(f"{k}z").alias("z"), F.col(k).alias("vid")) for k in "abc"]))
    floor = xyz.join(roots.join(sinks.select("root"), "root", "left_semi"), "fid").groupBy("root").agg(F.min(low).alias("f")).select("root", F.col("f.z").alias("z"), F.col("f.vid").alias("vid"))
    floor = materialized(floor.select("root", "z", F.min("root").over(Window.partitionBy("vid")).alias("first")))
    # Floors only fall, so an edge above both never joins; of a pair's edges the first says all.
    other = floor.select(F.col("root").alias("other"), F.col("z").alias("oz"), F.col("first").alias("ofirst"))
    both = pairs.join(floor, "root").join(other, "other").where("low.low <= greatest(z, oz)")
    both = both.groupBy(F.least("root", "other").alias("root"), F.greatest("root", "other").alias("other")).agg(F.min_by(F.struct("low", F.when(F.col("root") < F.col("other"), F.struct("z", "oz", "first", "ofirst")).otherwise(F.struct(F.col("oz").alias("z"), F.col("z").alias("oz"), F.col("ofirst").alias("first"), F.col("first").alias("ofirst"))).alias("at")), "low").alias("m"))
    joins = materialized(both.select("root", "other", "m.low.low", "m.low.fid", "m.low.k", "m.at.z", "m.at.oz", "m.at.first", "m.at.ofirst"))
    shared = floor.where("root != first").select(F.col("root").alias("a"), F.col("first").alias("b"))
    no = F.lit(0).cast("long")
    rows = floor.select(F.col("root").alias("a"), F.lit(0).alias("what"), no.alias("b"), F.col("z").alias("low"), no.alias("fid"), no.alias("k"))
    rows = rows.unionByName(shared.select("a", F.lit(1).alias("what"), "b", F.lit(0.0).alias("low"), no.alias("fid"), no.alias("k")))
    rows = rows.unionByName(joins.select(F.col("root").alias("a"), F.lit(2).alias("what"), F.col("other").alias("b"), "low", F.col("fid").cast("long").alias("fid"), F.col("k").cast("long").alias("k")))
    n = joins.count()
    if n <= SMALL:
        return materialized(by_groups(rows.withColumn("g", no), "g", _kept, "root long, keeper long"))
    # Sinks of one floor are one from the start; an edge is the higher floor's to pick, of equal floors either's.
    e = joins.where("first != ofirst").select("low", "fid", "k", F.explode(F.array(F.struct(F.col("first").alias("p"), F.col("ofirst").alias("q"), F.col("z").alias("z"), F.col("oz").alias("oz")), F.struct(F.col("ofirst").alias("p"), F.col("first").alias("q"), F.col("oz").alias("z"), F.col("z").alias("oz")))).alias("e"))
    e = e.where("e.z >= e.oz").select("e.p", "e.q", (F.col("e.z") > F.col("e.oz")).alias("lower"), "low", "fid", "k")
    links = _links_by_ranges(e, n)
    if links is not None:
        group = components(floor.select(F.col("root").alias("node")), links.unionByName(shared)).select(F.col("node").alias("root"), F.col("root").alias("g"))
        first = floor.join(group, "root").groupBy("g").agg(F.min(F.struct("z", "root")).alias("f"))
        return materialized(group.join(first, "g").select("root", F.col("f.root").alias("keeper")))
    name = materialized(floor.select("root", F.col("root").alias("keeper"), "z"))
    links = shared
    joins = joins.select("root", "other", "low", "fid", "k")
    while True:
        nodes = name.select(F.col("keeper").alias("node")).distinct()
        group = components(nodes, links).select(F.col("node").alias("keeper"), "root").withColumnRenamed("root", "g")
        best = name.select("keeper", "z").groupBy("keeper").agg(F.min("z").alias("z")).join(group, "keeper").groupBy("g").agg(F.min(F.struct("z", "keeper")).alias("k"))
        name = materialized(name.select("root", "keeper").join(group, "keeper").join(best, "g").select("root", F.col("k.keeper").alias("keeper"), F.col("k.z").alias("z")))
        to = name.select(F.col("root").alias("other"), F.col("keeper").alias("okeeper"), F.col("z").alias("oz"))
        near = joins.join(name, "root").join(to, "other").where("keeper != okeeper")
        # Seen from either side; the side of the higher floor joins the other.
        both = near.select("fid", "k", "low", F.col("keeper").alias("a"), F.col("okeeper").alias("b"), F.col("z").alias("za"), F.col("oz").alias("zb")).unionByName(near.select("fid", "k", "low", F.col("okeeper").alias("a"), F.col("keeper").alias("b"), F.col("oz").alias("za"), F.col("z").alias("zb")))
        links = materialized(both.where("za >= zb and low <= za").groupBy("a").agg(F.min_by("b", F.struct("low", "fid", "k")).alias("b")))
        if not links.limit(1).count():
            break
    return name.select("root", "keeper")


def _renamed(roots: DataFrame, names: DataFrame) -> DataFrame:
    return roots.join(names, "root", "left").select("fid", F.coalesce("keeper", "root").alias("root"))


def consolidated(roots: DataFrame, sinks: DataFrame, xyz: DataFrame, faces: DataFrame) -> DataFrame:
    """(fid, root) with sinks (rows root) merged that share a floor vertex, or are joined no higher than the higher floor.

    The basin of lower floor keeps its name, of equal floors that of least name.
    A round joins each basin over the first edge, by face and side, at the height
    of its own floor to a neighbour whose floor is no higher; rounds go on while any joins.
    """
    roots = materialized(roots)
    return _renamed(roots, _keepers(roots, sinks, xyz, _pairs(roots, xyz, topology.face_neighbours(faces))))


def _absorbed(frames, threshold: float, rounds: int):
    """The rounds of ``without_slivers`` over a table of basins and neighbours in memory."""
    t = pd.concat(list(frames), ignore_index=True)
    own = t[t["other"].isna()]
    area, sink = dict(zip(own["root"].tolist(), own["area"].tolist(), strict=True)), dict(zip(own["root"].tolist(), own["sink"].tolist(), strict=True))
    pairs = [(int(a), int(b), (h, f, k)) for a, b, h, f, k in t.loc[t["other"].notna(), ["root", "other", "high", "fid", "k"]].itertuples(index=False)]
    keeper = {r: r for r in area}
    for _ in range(rounds):
        size: dict = {}
        for r, k in keeper.items():
            size[k] = size.get(k, 0.0) + area[r]
        best: dict = {}
        for a, b, rim in pairs:
            a, b = keeper[a], keeper[b]
            if a != b and not sink[a] and not sink[b] and size[a] < threshold and (a not in best or rim < best[a][0]):
                best[a] = rim, b
        if not best:
            break
        end: dict = {}
        for k in size:
            path, at = [], k
            while at in best and at not in end and at not in path:
                path.append(at)
                at = best[at][1]
            last = end.get(at, max(path[path.index(at) :]) if at in path else at)
            for x in path:
                end[x] = last
            end.setdefault(k, last)
        keeper = {r: end[k] for r, k in keeper.items()}
    yield pd.DataFrame({"root": list(keeper), "keeper": list(keeper.values())})


def without_slivers(roots: DataFrame, sinks: DataFrame, xyz: DataFrame, faces: DataFrame, share: float, rounds: int = 16) -> DataFrame:
    """(fid, root) with basins below a share of the whole plan area joined, over their lowest rim, to a neighbour.

    Sinks (rows root) neither join nor take in others. The rim is an edge's
    higher end; of equal rims the first by face and side. Basins joined in a chain
    take the name of the one that does not join; of those that join in a circle, the greatest name.
    """
    roots = materialized(roots)
    return _renamed(roots, _absorbers(roots, sinks, xyz, lambda: _pairs(roots, xyz, topology.face_neighbours(faces)), share, rounds))


def _absorbers(roots: DataFrame, sinks: DataFrame, xyz: DataFrame, pairs, share: float, rounds: int = 16) -> DataFrame:
    """(root, keeper) of the basins that are no sinks, by ``without_slivers``; ``pairs`` are asked for if any can join."""
    area = materialized(roots.join(xyz.select("fid", G.plan_area().alias("area")), "fid").groupBy("root").agg(F.sum("area").alias("area")))
    total = area.agg(F.sum("area")).first()[0] or 0.0
    # Sinks neither join nor take in others, so only the rest is looked at.
    state = materialized(area.join(sinks.select("root").distinct(), "root", "left_anti").select("root", F.col("root").alias("keeper"), "area", F.lit(False).alias("sink")))
    if share * total <= 0:
        return state.select("root", "keeper")
    other = state.select(F.col("root").alias("other"))
    joins = materialized(pairs().join(state.select("root"), "root", "left_semi").join(other, "other", "left_semi").select("root", "other", "high.high", "high.fid", "high.k"))
    if joins.limit(SMALL + 1).count() <= SMALL:
        none = lambda t: F.lit(None).cast(t)
        rows = state.select("root", none("long").alias("other"), "area", "sink", none("double").alias("high"), none("long").alias("fid"), none("int").alias("k"))
        rows = rows.unionByName(joins.select("root", "other", none("double").alias("area"), none("boolean").alias("sink"), "high", F.col("fid").cast("long").alias("fid"), F.col("k").cast("int").alias("k")))
        names = rows.coalesce(1).mapInPandas(lambda frames: _absorbed(frames, share * total, max(1, rounds)), "root long, keeper long")
        return materialized(names)
    for _ in range(max(1, rounds)):
        now = state.groupBy("keeper").agg(F.sum("area").alias("area"), F.bool_or("sink").alias("sink"))
        names = state.select("root", "keeper").join(now, "keeper")
        side = joins.join(names.select("root", "keeper", "area", "sink"), "root").join(names.select(F.col("root").alias("other"), F.col("keeper").alias("okeeper"), F.col("sink").alias("osink")), "other")
        hook = side.where((F.col("keeper") != F.col("okeeper")) & ~F.col("sink") & ~F.col("osink") & (F.col("area") < share * total)).groupBy("keeper").agg(F.min_by("okeeper", F.struct("high", "fid", "k")).alias("to"))
        hook = materialized(hook)
        if not hook.limit(1).count():
            break
        # Negative names, so that of a circle the greatest is the least.
        flow = now.join(hook, "keeper", "left").select((-F.col("keeper") - 1).alias("fid"), F.when(F.col("to").isNotNull(), F.col("to")).otherwise(F.lit(-1)).alias("to"))
        end = _roots_of(flow)
        state = materialized(state.join(end, "keeper").select("root", F.col("end").alias("keeper"), "area", "sink"))
    return state.select("root", "keeper")


def settled(roots: DataFrame, ends: DataFrame, xyz: DataFrame, neighbours: DataFrame, share: float) -> DataFrame:
    """``consolidated``, then ``without_slivers`` if there is a share; all but the basins of ``ends`` (rows root) are sinks. Faces are looked at once, for both."""
    roots = materialized(roots)
    pairs = _pairs(roots, xyz, neighbours)
    basins = roots.select("root").distinct()
    names = _keepers(roots, basins.join(ends, "root", "left_anti"), xyz, pairs)
    one = _renamed(roots, names)
    if not share:
        return one
    one = materialized(one)

    def renamed():
        p = pairs.join(names, "root", "left").select(F.coalesce("keeper", "root").alias("root"), "other", "high")
        p = p.join(names.select(F.col("root").alias("other"), "keeper"), "other", "left").select("root", F.coalesce("keeper", "other").alias("other"), "high")
        return p.where("root != other").groupBy("root", "other").agg(F.min("high").alias("high"))

    left = one.select("root").distinct().join(ends, "root", "left_anti")
    return _renamed(one, _absorbers(one, left, xyz, renamed, share))


def _roots_of(hooks: DataFrame) -> DataFrame:
    """(keeper, end) of hooks between basins (fid: negative name, to: name or -1)."""
    top = hooks.agg(F.min("fid")).first()[0] or 0
    shifted = hooks.select((F.col("fid") - top).alias("fid"), F.when(F.col("to") < 0, F.lit(-1)).otherwise(-F.col("to") - 1 - top).cast("long").alias("flows_to"))
    return flow_roots(shifted).select((-(F.col("fid") + top) - 1).alias("keeper"), (-(F.col("root") + top) - 1).alias("end"))


def basin_table(roots: DataFrame, flow: DataFrame, xyz: DataFrame) -> DataFrame:
    """(basin, root, n_faces, plan_area, low_x, low_y, low_z, outlet): basins numbered by falling plan area, then by name.

    ``outlet`` is ``border`` or ``sink``, after the face that the basin is named by; the low point is the least (z, x, y).
    """
    low = F.array_min(F.array(*[F.struct(F.col(f"{k}z").alias("z"), F.col(f"{k}x").alias("x"), F.col(f"{k}y").alias("y")) for k in "abc"]))
    m = roots.join(xyz, "fid").select("root", G.plan_area().alias("area"), low.alias("low"))
    g = m.groupBy("root").agg(F.count("*").alias("n_faces"), F.sum("area").alias("plan_area"), F.min("low").alias("low"))
    end = flow.select(F.col("fid").alias("root"), F.when(F.col("flows_to") == BORDER, "border").otherwise("sink").alias("outlet"))
    g = g.join(end, "root", "left").select("root", "n_faces", "plan_area", F.col("low.x").alias("low_x"), F.col("low.y").alias("low_y"), F.col("low.z").alias("low_z"), F.coalesce("outlet", F.lit("sink")).alias("outlet"))
    # Areas as they are shown: sums in another order must not change places.
    return topology.ranked(g, [F.desc(F.round("plan_area", 6)), F.asc("root")], "basin")


_LOOP = "root long, loop int, seq int, vid long"


def _loops(root, starts, ends):
    """Directed edges of one outline as closed loops, rows (root, loop, seq, vid): at a vertex with several ways on, the least is taken first."""
    ways: dict[int, list[int]] = {}
    for a, b in sorted(zip(starts, ends, strict=True), reverse=True):
        ways.setdefault(a, []).append(b)
    out, n = [], 0
    for start in sorted(ways):
        while ways[start]:
            at, seq = start, 0
            while ways.get(at):
                out.append((root, n, seq, at))
                seq += 1
                at = ways[at].pop()
                if at == start:
                    break
            n += 1
    return out


def outlines(roots: DataFrame, faces: DataFrame) -> DataFrame:
    """(root, loop, seq, vid): the outline of each group of faces as loops of vertices, the faces on their left as they wind.

    Only sides that no face of the group shares are looked at, a group's outline in one task, which takes many groups.
    """
    e = topology.half_edges(faces).join(roots, "fid")
    rim = e.groupBy("root", "u", "v").agg(F.count("*").alias("n"), F.first("a").alias("a"), F.first("b").alias("b")).where("n = 1")
    return by_groups(rim.select("root", "a", "b"), "root", _loops, _LOOP)
