"""Triangulation, overlay, drainage, files and figures against definitions and closed forms."""

import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from geolode.operators import curves, drainage, faces, fields, graphs, kernels, overlay, polygons, rasters, sections, spatial, surfaces, tin, topology, water
from geolode.sources import rasters as files
from geolode.plans import queries
from geolode.sources import survey, tables
from tests.conftest import DATA


def lattice(spark, n, z):
    v = spark.createDataFrame([(j * n + i, float(i), float(j), float(z(i, j))) for j in range(n) for i in range(n)], "vid long, x double, y double, z double")
    f = tables.lattice_faces(v, n)
    return v, f, faces.gather(f, v)


# triangulation


def area2(a, b, p):
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


@pytest.mark.parametrize("n", [3, 4, 7, 40])
def test_kernel_is_delaunay(n):
    rng = random.Random(n)
    for points in ([(rng.random(), rng.random()) for _ in range(n)], [(float(i % 5), float(i // 5)) for i in rng.sample(range(25), min(n, 25))]):
        t = tin.delaunay(points)
        for a, b, c in t:
            assert area2(points[a], points[b], points[c]) > 0
            assert not any(tin._in_circle(points[a], points[b], points[c], p) for p in points)
        hull = sorted(points)

        def chain(ps):
            out = []
            for p in ps:
                while len(out) > 1 and area2(out[-2], out[-1], p) <= 0:
                    out.pop()
                out.append(p)
            return out[:-1]

        h = chain(hull) + chain(hull[::-1])
        whole = sum(h[i][0] * h[(i + 1) % len(h)][1] - h[i][1] * h[(i + 1) % len(h)][0] for i in range(len(h)))
        assert sum(area2(*(points[k] for k in x)) for x in t) == pytest.approx(whole, abs=1e-9)


def test_tiles_fit_together(spark):
    rng = random.Random(2)
    points = [(i, rng.uniform(0, 30), rng.uniform(0, 20)) for i in range(900)] + [(900 + i, 5.0 + i % 6, 5.0 + i // 6) for i in range(36)]
    df = spark.createDataFrame([*points, (5000, points[0][1], points[0][2]), (5001, None, 1.0), (5002, float("nan"), 1.0)], "pid long, x double, y double")
    xy = [p[1:] for p in points]
    r = 1.6
    small = lambda t: tin._circle(*(xy[k] for k in t))[2] <= r
    want = {frozenset(t) for t in tin.delaunay(xy) if small(t)}
    for tile in (2.5, 100.0):
        got = tin.triangulated(df, r, tile).collect()
        assert len(got) == len({frozenset(t) for t in got})
        # Equal circles leave a choice inside the square lattice: compare what covers the ground.
        assert sum(area2(*(xy[k] for k in t)) for t in got) == pytest.approx(sum(abs(area2(*(xy[k] for k in t))) for t in want))
        assert {frozenset(t) for t in got if max(t) < 900} == {t for t in want if max(t) < 900}
    assert tin.triangulated(df.limit(0), r).count() == 0


def test_lines_become_edges(spark):
    rng = random.Random(4)
    points = [(i, rng.uniform(0, 10), rng.uniform(0, 10), 0.0) for i in range(120)] + [(200, 1.0, 1.0, 0.0), (201, 9.0, 8.5, 8.0)]
    df = spark.createDataFrame(points, "pid long, x double, y double, z double")
    line = spark.createDataFrame([(1, 200, 201)], "sid long, p long, q long")
    v, t, lost = tin.with_lines(df, line, 6.0, 100.0)
    assert lost.count() == 0
    on = {r.pid for r in v.where("abs((x - 1) * 7.5 - (y - 1) * 8) < 1e-9").collect()}
    z = {r.pid: (r.x, r.z) for r in v.collect()}
    e = {frozenset(x) for r in t.collect() for x in ((r.a, r.b), (r.b, r.c), (r.c, r.a))}
    path = sorted(on, key=lambda k: z[k][0])
    assert len(path) > 2 and all(frozenset(x) in e for x in zip(path, path[1:], strict=False)) and all(z[k][1] == pytest.approx(z[k][0] - 1) for k in path)


# overlay


def test_two_triangulations_of_one_surface_differ_by_nothing(spark):
    v, f, xyz = lattice(spark, 6, lambda i, j: 0.5 * i + 0.25 * j)
    other = f.select("fid", F.col("b").alias("a"), F.col("c").alias("b"), F.col("a").alias("c"))
    d = overlay.deviation(xyz, faces.gather(other, v), 2.0).first()
    assert d.max_gap == pytest.approx(0, abs=1e-12) and d.shared_area == pytest.approx(25) and d.same_ground
    big = spark.createDataFrame([(0, -1.0, -1.0, 1.0), (1, 20.0, -1.0, 1.0), (2, -1.0, 20.0, 1.0)], "vid long, x double, y double, z double")
    t = spark.createDataFrame([(0, 0, 2, 1)], "fid long, a long, b long, c long")
    _, _, tilted = lattice(spark, 5, lambda i, j: i - 1)
    one = overlay.volumes(overlay.pieces(tilted, faces.gather(t, big), 3.0)).first()
    assert one.cut == pytest.approx(8) and one.fill == pytest.approx(8) and one.net == pytest.approx(0) and one.area == pytest.approx(16)
    far = overlay.deviation(tilted, faces.gather(t, big.withColumn("x", F.col("x") + 100)), 3.0).first()
    assert far.n_pieces == 0 and far.shared_area == 0 and not far.same_ground


# drainage


def flows(spark, v, f, xyz):
    n = topology.face_neighbours(f)
    c = xyz.select("fid", ((F.col("az") + F.col("bz") + F.col("cz")) / 3).alias("z"))
    return drainage.with_flats(surfaces.lattice_flow(xyz, n), n, c)


def test_a_plateau_with_one_way_out_is_one_basin(spark):
    # Flat inside a rim that two neighbouring border vertices leave open.
    z = lambda i, j: 5 if (i in (0, 7) or j in (0, 7)) and (i, j) not in ((7, 3), (7, 4)) else 2
    v, f, xyz = lattice(spark, 8, z)
    flow = flows(spark, v, f, xyz)
    flat = xyz.where("az = 2 and bz = 2 and cz = 2").select("fid")
    roots = graphs.flow_roots(flow).join(flat, "fid", "left_semi").select("root").distinct().collect()
    assert len(roots) == 1 and flow.where(F.col("fid") == roots[0].root).first().flows_to == -1


def test_a_closed_plateau_is_a_sink(spark):
    v, f, xyz = lattice(spark, 6, lambda i, j: 5 if i in (0, 5) or j in (0, 5) else 2)
    flow = flows(spark, v, f, xyz)
    flat = {r.fid for r in xyz.where("az = 2 and bz = 2 and cz = 2").collect()}
    got = {r.fid: r.root for r in graphs.flow_roots(flow).collect()}
    assert {got[k] for k in flat} == {min(flat)}


def test_sinks_that_share_a_floor_are_one(spark):
    xyz = spark.createDataFrame([(0, 0, 1, 2, 0.0, 0.0, 0.0, 1.0, 0.0, 3.0, 0.0, 1.0, 3.0), (1, 0, 2, 3, 0.0, 0.0, 0.0, 0.0, 1.0, 3.0, -1.0, 0.0, 3.0), (2, 1, 4, 2, 1.0, 0.0, 3.0, 1.0, 1.0, 2.5, 0.0, 1.0, 3.0)], "fid long, a long, b long, c long, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double")
    f = xyz.select("fid", "a", "b", "c")
    roots = spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "fid long, root long")
    got = {r.fid: r.root for r in drainage.consolidated(roots, roots.select("root"), xyz, f).collect()}
    assert got == {0: 0, 1: 0, 2: 2}


def test_flats_and_floors_by_task_by_groups_and_by_rounds(spark, monkeypatch):
    rng = random.Random(12)
    v, f, xyz = lattice(spark, 14, lambda i, j: rng.choice([1, 2, 2, 3, 4]))
    calls, whole = [], drainage.components
    monkeypatch.setattr(drainage, "components", lambda *a: calls.append(1) or whole(*a))

    def run():
        flow = flows(spark, v, f, xyz).localCheckpoint()
        roots = graphs.flow_roots(flow).localCheckpoint()
        sinks = roots.select("root").distinct().join(flow.where("flows_to = -1").select(F.col("fid").alias("root")), "root", "left_anti")
        one = drainage.consolidated(roots, sinks, xyz, f)
        return sorted(map(tuple, flow.collect())), sorted(map(tuple, one.collect())), roots.select("root").distinct().count()

    by_task = run()
    assert not calls  # small tables take no rounds of jobs
    assert len({r for _, r in by_task[1]}) < by_task[2]
    for small in (60, 0):  # groups that fit one task each, then none that do
        monkeypatch.setattr(drainage, "SMALL", small)
        calls.clear()
        assert run() == by_task
        assert calls


def test_joins_take_shuffles_only_inside(spark):
    from geolode.plans.lineage import shuffled_joins

    key = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(key)
    with pytest.raises(ZeroDivisionError), shuffled_joins(spark):
        assert spark.conf.get(key) == "-1"
        raise ZeroDivisionError
    assert spark.conf.get(key) == was


def test_flow_is_followed_range_by_range(spark, monkeypatch):
    rng = random.Random(8)
    near = {i: rng.choice([i + 1, i + 1, max(0, i - 1), i + 2, rng.randrange(200), -1, -2, 999]) for i in range(200)}  # 999 is no face: what leads there has no end
    rounds, tripled = [], graphs._tripled
    monkeypatch.setattr(graphs, "_tripled", lambda *a: rounds.append(1) or tripled(*a))
    for to, small, size in ((near, 500_000, 1), (near, 20, 30), ({i: i * 7 % 211 for i in range(211)}, 9, 50)):
        want = {}
        for i in to:
            path, at = [], i
            while at in to and at not in path and to[at] >= 0:
                path.append(at)
                at = to[at]
            if at in path:
                want[i] = min(path[path.index(at) :])
            elif at in to:
                want[i] = at
        monkeypatch.setattr(graphs, "SMALL", small)
        monkeypatch.setattr(graphs, "RANGE", size)
        got = [tuple(x) for x in graphs.flow_roots(spark.createDataFrame(list(to.items()), "fid long, flows_to long")).collect()]
        assert len(got) == len(want) and dict(got) == want
    assert len(rounds) == 1  # where every face is led to from another range


def test_outlines_of_basins_send_nothing_through_the_driver(spark, monkeypatch):
    seen, whole = [], graphs.flow_roots
    monkeypatch.setattr(graphs, "flow_roots", lambda flow: seen.append(spark.conf.get("spark.sql.autoBroadcastJoinThreshold")) or whole(flow))
    df = queries.QUERIES["basin_outlines"](spark, DATA)
    assert seen == ["-1"] and "Join" not in df._jdf.queryExecution().executedPlan().toString()


def test_slivers_by_table_and_by_task(spark, monkeypatch):
    rng = random.Random(3)
    v, f, xyz = lattice(spark, 7, lambda i, j: rng.uniform(0, 9))
    roots = spark.createDataFrame([(r.fid, (r.fid // 5) * 5) for r in f.collect()], "fid long, root long")
    sinks = spark.createDataFrame([(10,), (25,)], "root long")
    one = sorted(map(tuple, drainage.without_slivers(roots, sinks, xyz, f, 0.2, 2).collect()))
    monkeypatch.setattr(drainage, "SMALL", 0)
    assert sorted(map(tuple, drainage.without_slivers(roots, sinks, xyz, f, 0.2, 2).collect())) == one
    kept = {r for _, r in one}
    assert {10, 25} <= kept and sum(r == 10 for _, r in one) == 3 and len(kept) < roots.select("root").distinct().count()


def test_floors_are_joined_range_by_range(spark, monkeypatch):
    rng = random.Random(21)
    v, f, xyz = lattice(spark, 26, lambda i, j: rng.choice([1, 1, 2, 2, 3, 4]))
    xyz, f = xyz.localCheckpoint(), f.localCheckpoint()
    roots = xyz.select("fid", F.expr("fid - fid % 3").alias("root")).localCheckpoint()
    sinks = roots.where("root % 11 != 0").select("root").distinct()
    one = dict(map(tuple, drainage.consolidated(roots, sinks, xyz, f).collect()))
    found, whole = [], drainage._links_by_ranges
    monkeypatch.setattr(drainage, "_links_by_ranges", lambda *a: found.append(whole(*a)) or found[-1])
    monkeypatch.setattr(drainage, "SMALL", 300)
    for size in (500, 60):
        monkeypatch.setattr(drainage, "RANGE", size)
        assert dict(map(tuple, drainage.consolidated(roots, sinks, xyz, f).collect())) == one
    assert len(found) == 2 and None not in found  # no rounds over the table
    assert len(set(one.values())) < len(set(roots.select("root").distinct().collect())) - 50


def test_sinks_are_no_work_for_slivers(spark, monkeypatch):
    v, f, xyz = lattice(spark, 12, lambda i, j: i * j % 7)
    roots = xyz.select("fid", F.expr("fid - fid % 4").alias("root"))
    sinks = roots.where("root not in (0, 24)").select("root").distinct()
    rounds, whole = [], drainage._roots_of
    monkeypatch.setattr(drainage, "_roots_of", lambda *a: rounds.append(1) or whole(*a))
    monkeypatch.setattr(drainage, "SMALL", 4)
    got = dict(map(tuple, drainage.without_slivers(roots, sinks, xyz, f, 0.5).collect()))
    assert not rounds and len(got) == 242  # of some 60 neighbours of either
    assert {k: r for k, r in got.items() if k - k % 4 not in (0, 24)} == {k: k - k % 4 for k in got if k - k % 4 not in (0, 24)}


def test_components_by_rounds_and_by_task(spark, monkeypatch):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)]
    nodes, df = spark.range(310).toDF("node"), spark.createDataFrame(links, "a long, b long")
    one = sorted(map(tuple, graphs.components(nodes, df).collect()))
    monkeypatch.setattr(graphs, "SMALL", 0)
    assert sorted(map(tuple, graphs.components(nodes, df).collect())) == one


def test_components_range_by_range(spark, monkeypatch):
    rng = random.Random(4)
    links = [(i, i + rng.choice([1, 1, 2, 40])) for i in range(0, 400) if rng.random() < 0.7] + [(i, rng.randrange(400)) for i in range(0, 400, 37)]
    for kind, name in (("long", lambda i: i), ("string", lambda i: f"{i:04d}")):
        nodes = spark.createDataFrame([(name(i),) for i in range(460)], f"node {kind}")
        df = spark.createDataFrame([(name(a), name(b)) for a, b in links], f"a {kind}, b {kind}")
        monkeypatch.setattr(graphs, "SMALL", 500_000)
        one = sorted(map(tuple, graphs.components(nodes, df).collect()))
        monkeypatch.setattr(graphs, "SMALL", 5)
        monkeypatch.setattr(graphs, "RANGE", 30)
        assert sorted(map(tuple, graphs.components(nodes, df).collect())) == one


def test_corners_of_the_lattice_by_one_shuffle(spark, monkeypatch):
    monkeypatch.setattr(tables, "ROWS", 3)
    rng = random.Random(2)
    # With gaps, and a vertex that is there twice.
    rows = [(k, float(k % 5), float(k // 5), rng.random()) for k in range(-12, 90) if rng.random() < 0.9] + [(31, 1.0, 6.0, 7.5)]
    v = spark.createDataFrame(rows, "vid long, x double, y double, z double")
    got = tables.lattice_corners(v, 5)
    want = faces.gather(tables.lattice_faces(v, 5), v).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert tables.lattice_corners(v, 5)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_contours_are_stitched_band_by_band(spark, monkeypatch):
    rng = random.Random(6)
    v, f, xyz = lattice(spark, 16, lambda i, j: rng.choice([0, 1, 2, 3, 1.5]))
    levels = spark.createDataFrame([(0.5,), (1.0,), (1.75,)], "level double")
    df = surfaces.contour_segments(xyz, levels).select("level", *(F.col(c) - 8 for c in ("x0", "y0", "x1", "y1"))).toDF("level", "x0", "y0", "x1", "y1").localCheckpoint()
    root, ends = {}, []

    def find(n):
        while root.setdefault(n, n) != n:
            n = root[n]
        return n

    for s in df.collect():
        u, w = ((s.level, round(x * 1e6), round(y * 1e6)) for x, y in ((s.x0, s.y0), (s.x1, s.y1)))
        if u != w:
            ends.append((u, w, math.dist((s.x0, s.y0), (s.x1, s.y1))))
            root[find(u)] = find(w)
    chains, degree = {}, {}
    for u, w, length in ends:
        chains.setdefault(find(u), []).append(length)
        for n in (u, w):
            degree[n] = degree.get(n, 0) + 1
    closed = {c: all(degree[n] == 2 for n in degree if find(n) == c) for c in chains}
    want = sorted((c[0], len(x), closed[c], round(sum(x), 6)) for c, x in chains.items())
    nodes, whole = [], graphs.components
    monkeypatch.setattr(graphs, "components", lambda n, links: nodes.append(n.count()) or whole(n, links))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else all bands lie in one task
    try:
        for band in (None, 100.0, 3.0, 0.4):
            got = kernels.stitched(df, 1e-6, band).collect()
            assert sorted((r.level, r.n_segments, r.closed, round(r.length, 6)) for r in got) == want
            assert len({r.chain for r in got}) == len(got)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert nodes[0] <= nodes[2] < len(degree) / 4 and nodes[3]  # only what runs from band to band is joined over the table


def test_contours_are_stitched_with_one_labelling(spark, monkeypatch):
    square = [(0, 0, 1, 0), (1, 0, 1, 1), (1, 1, 0, 1), (0, 1, 0, 0)]
    line = [(-5.0, -9.5, -4.0, -9.5), (-4.0, -9.5, -3.0, -9.0), (7, 7, 7, 7)]
    rows = [(0.5, *map(float, s)) for s in square + line] + [(1.5, *map(float, s)) for s in square[:3]]
    df = spark.createDataFrame(rows, "level double, x0 double, y0 double, x1 double, y1 double")
    calls = []
    whole = graphs.components
    monkeypatch.setattr(graphs, "components", lambda *a: calls.append(1) or whole(*a))
    got = sorted((r.level, r.n_segments, r.closed, round(r.length, 9)) for r in kernels.stitched(df, 1e-6).collect())
    assert got == [(0.5, 2, False, round(1 + math.sqrt(1.25), 9)), (0.5, 4, True, 4.0), (1.5, 3, False, 3.0)]
    assert len(calls) == 1


@pytest.mark.parametrize("batch", ["1", "3", "10000"])
def test_groups_over_batches(spark, batch):
    rng = random.Random(2)
    rows = [(rng.randrange(40), rng.randrange(9)) for _ in range(300)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = graphs.by_groups(spark.createDataFrame(rows, "k long, v long"), "k", lambda k, v: [(k, sum(v), len(v))], "k long, total long, n long").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {k: [v for q, v in rows if q == k] for k, _ in rows}
    assert sorted(map(tuple, got)) == sorted((k, sum(v), len(v)) for k, v in want.items())


def test_ponds_of_two_pits(spark):
    pits = {(1, 1): 0.0, (4, 4): 1.0}
    v, f, xyz = lattice(spark, 6, lambda i, j: pits.get((i, j), 5.0 if 0 < i < 5 and 0 < j < 5 else 6.0))
    x = {r.fid: r for r in xyz.collect()}
    roots = spark.createDataFrame([(k, 1 if r.ax + r.bx + r.cx + r.ay + r.by + r.cy < 15 else 2) for k, r in x.items()], "fid long, root long")
    got = water.ponds(roots, xyz, f)
    assert "FlatMapGroups" not in got._jdf.queryExecution().toString()
    got = {r.root: r for r in got.collect()}
    assert set(got) == {1, 2} and [(got[k].floor, got[k].spill) for k in (1, 2)] == [(0.0, 5.0), (1.0, 5.0)]
    for k in (1, 2):
        mine = [5 - (x[r.fid].az + x[r.fid].bz + x[r.fid].cz) / 3 for r in roots.collect() if r.root == k]
        assert got[k].n_faces == sum(q > 0 for q in mine) and got[k].volume == pytest.approx(sum(q for q in mine if q > 0) / 2)


def test_outlines_take_many_basins_a_call(spark):
    _, f, _ = lattice(spark, 4, lambda i, j: 0)
    roots = f.select("fid", (F.col("fid") % 5).alias("root"))
    got = drainage.outlines(roots, f)
    assert "FlatMapGroups" not in got._jdf.queryExecution().toString()
    assert got.groupBy("root").count().count() == 5


def test_areas_overlap_as_wholes_and_by_edges(spark, monkeypatch):
    rng = random.Random(6)
    rows = []
    for k in range(60):
        x, y, w = rng.uniform(-9, 9), rng.uniform(-9, 9), rng.choice([0.3, 1.0, 4.0])
        rows += [(k, 0, i, x + w * c + rng.uniform(-0.1, 0.1), y + w * r + rng.uniform(-0.1, 0.1)) for i, (c, r) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1)])]
        if k % 4 == 0:
            rows += [(k, 1, i, x + w * c, y + w * r) for i, (c, r) in enumerate([(0.3, 0.3), (0.7, 0.3), (0.5, 0.7)])]
    edges = spatial.ring_edges(spark.createDataFrame(rows, "area_id int, ring_id int, seq int, x double, y double"))
    whole = polygons.overlaps(edges, 2.0)
    assert "p_e" in whole._jdf.queryExecution().toString()
    whole = sorted(map(tuple, whole.collect()))
    assert len(whole) == len(set(whole)) > 20
    for n in (0, 4):  # all by edges, as before; those with a hole by edges
        monkeypatch.setattr(polygons, "WHOLE", n)
        assert sorted(map(tuple, polygons.overlaps(edges, 2.0).collect())) == whole


def test_points_are_settled_share_by_share(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(k, rng.uniform(0, 5), rng.uniform(0, 4), rng.uniform(0, 2), rng.choice([True, False, None])) for k in range(500)]
    kept, want = [], []
    for k, x, y, z, line in sorted(rows, key=lambda r: (not r[4], r[0])):
        into = next((q for q, u, v, w in kept if (x - u) ** 2 + (y - v) ** 2 < 0.25 and (not line or (z - w) ** 2 < 0.25)), None)
        if into is None:
            kept.append((k, x, y, z))
        want.append((k, k if into is None else into))
    df = spark.createDataFrame(rows, "pid long, x double, y double, z double, line boolean")
    for first in (20_000, 60):
        monkeypatch.setattr(spatial, "FIRST", first)
        assert sorted(map(tuple, spatial.deduplicated(df, 0.5).collect())) == sorted(want)


# runs, grades, curves


def test_runs_between_landings(spark):
    z = [0, 0, 0, 1, 2, 3, 3, 3, 3, 3.2, 3.4]
    s = spark.createDataFrame([(1, float(i), float(h)) for i, h in enumerate(z)], "route_id int, station double, z double")
    got = sections.run_pieces(s, 0.0, 0.1, 2.0, 0.3, 1.0, 2.0, [(1.0, 2.0), (10.0, 5.0)]).orderBy("run").collect()
    assert [(r.kind, r.s0, r.s1) for r in got] == [("landing", 0, 2), ("ramp", 2, 5), ("landing", 5, 8), ("walk", 8, 10)]
    ramp = got[1]
    assert ramp.rise == pytest.approx(3) and ramp.rise_exceeded and ramp.allowed_going == 2 and ramp.going_exceeded and not got[3].rise_exceeded


def test_circle_and_kink_have_known_complexity(spark):
    arc = [(1, i, 10 * math.cos(i / 20), 10 * math.sin(i / 20), 0.0) for i in range(30)]
    kink = [(2, 0, 0.0, 0.0, 0.0), (2, 1, 1.0, 0.0, 0.0), (2, 2, 1.0, 1.0, 0.5)]
    got = {r.route_id: r for r in sections.complexity(spark.createDataFrame(arc + kink, "route_id int, seq int, x double, y double, z double"), 10.0, 0.5).collect()}
    assert got[1].plan == pytest.approx(2, rel=1e-3) and got[1].profile == 0
    assert got[2].plan == pytest.approx(2) and got[2].profile == pytest.approx(1)


def test_simplified_chain_stays_near(spark):
    rng = random.Random(7)
    p = [(1, i, i * 0.1, math.sin(i / 9) + rng.uniform(-0.01, 0.01), 0.0) for i in range(200)]
    kept = curves.simplified(spark.createDataFrame(p, "route_id int, seq int, x double, y double, z double"), 0.05).orderBy("seq").collect()
    assert kept[0].seq == 0 and kept[-1].seq == 199 and len(kept) < 60
    for a, b in zip(kept, kept[1:], strict=False):
        for _, i, x, y, _ in p[a.seq : b.seq]:
            assert abs((b.x - a.x) * (y - a.y) - (b.y - a.y) * (x - a.x)) / math.dist((a.x, a.y), (b.x, b.y)) <= 0.05 + 1e-12


def test_fillet_of_a_right_angle(spark):
    p = [(1, 0, 0.0, 0.0), (1, 1, 10.0, 0.0), (1, 2, 10.0, 10.0), (2, 0, 0.0, 0.0), (2, 1, 1.0, 0.0), (2, 2, 1.0, 1.0), (3, 0, 0.0, 0.0), (3, 1, 4.0, 0.0)]
    got = curves.filleted(spark.createDataFrame(p, "route_id int, seq int, x double, y double"), 2.0).orderBy("route_id", "piece").collect()
    one = [r for r in got if r.route_id == 1]
    assert [r.kind for r in one] == ["line", "arc", "line"] and (one[1].x0, one[1].y1, one[1].cx, one[1].cy, one[1].radius) == pytest.approx((8, 2, 8, 2, 2))
    assert [(r.kind, r.radius) for r in got if r.route_id == 2] == [("arc", pytest.approx(1))] and [r.kind for r in got if r.route_id == 3] == ["line"]


def test_spline_ends_and_curvature(spark):
    c = spark.createDataFrame([(1, 0, 1.0, 0.0, 0.0), (1, 1, 1.0, 1.0, 1.0), (1, 2, 0.0, 1.0, 2.0), (2, 0, 0.0, 0.0, 0.0), (2, 1, 2.0, 0.0, 4.0)], "route_id int, seq int, x double, y double, z double")
    got = {(r.route_id, r.i): r for r in curves.spline_points(c, 3, 5).collect()}
    assert (got[1, 0].x, got[1, 4].y, got[1, 2].x, got[1, 2].z) == pytest.approx((1, 1, 0.75, 1)) and got[1, 0].curvature == pytest.approx(0.5)
    assert got[2, 2].z == pytest.approx(2) and got[2, 2].curvature == 0


# fields, noise, masks


def test_tile_payloads_are_raw_deflate():
    t = np.arange(4096, dtype="<f4")
    assert (fields.decode_tile(fields.encode_tile(t)) == t).all() and zlib.decompress(fields.encode_tile(t), -15) == t.tobytes()
    with pytest.raises(ValueError):
        fields.encode_tile(t[:7])


def test_noise_is_zero_on_the_lattice_and_the_same_everywhere(spark):
    i = np.arange(-20, 20, dtype=float)
    assert not kernels.gradient_noise(i, i[::-1].copy(), 5).any()
    x, y = np.linspace(-9, 9, 500), np.linspace(4, -7, 500)
    n = kernels.fractal_noise(x, y, 8, 0.5, 42)
    assert np.abs(n).max() <= 1 and n.std() > 0.05

    def corner(ix, iy, dx, dy, seed):
        m = (1 << 64) - 1
        k = (ix * 0x9E3779B97F4A7C15 & m) ^ (iy * 0xC2B2AE3D27D4EB4F & m) ^ ((seed & 0xFFFFFFFF) * 0x165667B19E3779F9 & m)
        for a in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            k = (k ^ k >> 33) * a & m
        g = (k ^ k >> 33) & 7
        return kernels._GX[g] * dx + kernels._GY[g] * dy

    a, b, seed = -3.3, 2.6, -7
    fx, fy = a - math.floor(a), b - math.floor(b)
    fade = lambda t: t**3 * (t * (t * 6 - 15) + 10)
    c = [[corner(math.floor(a) + i, math.floor(b) + j, fx - i, fy - j, seed) for i in (0, 1)] for j in (0, 1)]
    rows = [r[0] + fade(fx) * (r[1] - r[0]) for r in c]
    assert kernels.gradient_noise(np.array([a]), np.array([b]), seed)[0] == pytest.approx(math.sqrt(2) * (rows[0] + fade(fy) * (rows[1] - rows[0])))
    df = spark.createDataFrame([(1, 2.5, 3.5)], "pid int, x double, y double")
    assert kernels.with_noise(df, 2.0, 3, 0.5, 9).first().noise == pytest.approx(kernels.fractal_noise(np.array([1.25]), np.array([1.75]), 3, 0.5, 9)[0])


def test_outline_of_a_ring_has_two_loops(spark):
    ring = [(c, r) for c in range(3) for r in range(3) if (c, r) != (1, 1)]
    got = rasters.mask_outlines(spark.createDataFrame(ring, "col long, row long")).collect()
    assert len({r.loop for r in got}) == 2 and len(got) == 16


# files


def tiff(values, order="<", tiled=False, deflate=False, nodata=None):
    """A small float raster with model tags, written by hand."""
    h, w = values.shape
    raw = values.astype(order + "f4")
    if tiled:
        pad = np.zeros((-(-h // 16) * 16, -(-w // 16) * 16), order + "f4")
        pad[:h, :w] = raw
        blocks = [pad[j : j + 16, i : i + 16].tobytes() for j in range(0, pad.shape[0], 16) for i in range(0, pad.shape[1], 16)]
    else:
        blocks = [raw[j : j + 2].tobytes() for j in range(0, h, 2)]
    blocks = [zlib.compress(b) for b in blocks] if deflate else blocks
    body, places = b"", []
    for b in blocks:
        places.append((8 + len(body), len(b)))
        body += b
    tags = {256: ("I", [w]), 257: ("I", [h]), 258: ("H", [32]), 259: ("H", [8 if deflate else 1]), 277: ("H", [1]), 339: ("H", [3]), 33550: ("d", [2.0, 3.0, 0.0]), 33922: ("d", [0.0, 0.0, 0.0, 100.0, 900.0, 0.0]), 34735: ("H", [1, 1, 0, 2, 1025, 0, 1, 1, 3076, 0, 1, 9002])}
    tags |= {322: ("H", [16]), 323: ("H", [16]), 324: ("I", [p for p, _ in places]), 325: ("I", [n for _, n in places])} if tiled else {273: ("I", [p for p, _ in places]), 278: ("H", [2]), 279: ("I", [n for _, n in places])}
    if nodata is not None:
        tags[42113] = ("s", nodata.encode() + b"\0")
    kinds, at, extra, entries = {"H": 3, "I": 4, "d": 12, "s": 2}, 8 + len(body), b"", b""
    base = at + 2 + 12 * len(tags) + 4
    for tag, (code, v) in sorted(tags.items()):
        data = v if code == "s" else struct.pack(order + code * len(v), *v)
        value = data.ljust(4, b"\0") if len(data) <= 4 else struct.pack(order + "I", base + len(extra))
        extra += data if len(data) > 4 else b""
        entries += struct.pack(order + "HHI", tag, kinds[code], len(v)) + value
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", at) + body + struct.pack(order + "H", len(tags)) + entries + b"\0\0\0\0" + extra


@pytest.mark.parametrize(("order", "tiled", "deflate"), [("<", False, False), (">", True, True)])
def test_tiff_rasters(spark, tmp_path, order, tiled, deflate):
    v = np.arange(7 * 20, dtype=float).reshape(7, 20)
    v[3, 4], v[2, 2] = -9999, np.nan
    (tmp_path / "a.tif").write_bytes(tiff(v, order, tiled, deflate, "-9999"))
    (tmp_path / "b.tif").write_bytes(b"not a raster")
    got = {(r.col, r.row): r.v for r in files.read_tiff(spark, str(tmp_path)).collect()}
    assert got == {(c, r): v[r, c] for r in range(7) for c in range(20) if (r, c) not in ((3, 4), (2, 2))}
    assert {(r.col, r.row) for r in files.read_tiff(spark, str(tmp_path / "a.tif"), 5).collect()} == {(c, r) for c in range(0, 20, 5) for r in range(0, 7, 5)}
    head = {r.path[-5:]: r for r in files.read_tiff_headers(spark, str(tmp_path)).collect()}
    a = head["a.tif"]
    assert (a.width, a.height, a.a, a.e, a.c, a.f, a.pixel_is_area, a.unit, a.problem) == (20, 7, 2, -3, 100, 900, True, 0.3048, None) and "TIFF" in head["b.tif"].problem


def test_grey_maps(spark, tmp_path):
    (tmp_path / "a.pgm").write_bytes(b"P5 # two by three\n2 3\n255\n" + bytes([0, 51, 102, 153, 204, 255]))
    (tmp_path / "b.pgm").write_text("P2\n2 1\n10\n5 10\n")
    got = files.read_pgm(spark, str(tmp_path)).collect()
    assert sorted((r.path[-5:], r.col, r.row, round(r.v, 6)) for r in got) == [("a.pgm", 0, 0, 0.0), ("a.pgm", 0, 1, 0.4), ("a.pgm", 0, 2, 0.8), ("a.pgm", 1, 0, 0.2), ("a.pgm", 1, 1, 0.6), ("a.pgm", 1, 2, 1.0), ("b.pgm", 0, 0, 0.5), ("b.pgm", 1, 0, 1.0)]


# figures


def test_figures_go_on_and_close_by_rule(spark):
    raw = ["BLD1 ST", "BLD1", "BLD1 END", "EP ST", "EP AR", "EP", "EP END", "EP- END", "EP ST", "EP ST", "EP", "SPOT", "XX", "BDY", "TC-"]
    p = spark.createDataFrame([(i, float(i), float(i * i), 0.0, r) for i, r in enumerate(raw)], "line_number long, x double, y double, z double, raw string")
    f = survey.figures(survey.parse_codes(p), rules=survey.code_rules(spark)).collect()
    by = {}
    for r in sorted(f, key=lambda r: r.line_number):
        by.setdefault(r.figure_id, []).append(r)
    got = {k: ([r.line_number for r in v], v[0].closed, v[0].kind) for k, v in by.items()}
    assert got == {"BLD:1#0": ([0, 1, 2], True, "figure"), "EP:#0": ([3, 4, 5, 6, 7], False, "figure"), "EP:#1": ([8], False, "spot"), "EP:#2": ([9, 10], False, "figure"), "BDY:#0": ([13], True, "spot"), "TC:#0": ([14], False, "spot")}
    pieces = {}
    for r in survey.figure_pieces(spark.createDataFrame(f)).orderBy("piece").collect():
        pieces.setdefault(r.figure_id, []).append((r.kind, r.x0, r.x1))
    assert pieces["EP:#0"] == [("arc", 3, 5), ("line", 5, 6), ("line", 6, 7)] and pieces["BLD:1#0"] == [("line", 0, 1), ("line", 1, 2), ("line", 2, 0)]


def test_rectangles_that_are_none(spark):
    shapes = {1: [(0, 0, 0), (2, 0, 0), (2, 1, 0), (0, 1, 0), (0, 0, 0)], 2: [(0, 0, 0), (0, 1, 0), (2, 1, 0), (2, 0, 0)], 3: [(0, 0, 0), (1, 0, 0), (2, 0, 0), (2, 1, 0), (0, 1, 0)], 4: [(0, 0, 0), (2, 0, 1), (2, 1, 0), (0, 1, 0)], 5: [(0, 0, 0), (1, 0, 0), (0, 1, 0)], 6: [(1, 0, 0), (2, 0, 0), (2, 1, 0), (0, 1, 0), (0, 0, 0)]}
    df = spark.createDataFrame([(k, i, float(x), float(y), float(z)) for k, p in shapes.items() for i, (x, y, z) in enumerate(p)], "area_id int, seq int, x double, y double, z double")
    got = {r.area_id: r for r in polygons.mapping_rectangles(df, 1e-6).collect()}
    assert (got[1].width, got[1].height, got[1].rotation) == (2, 1, 0) == (got[2].width, got[2].height, got[2].rotation) and got[3].width == 2
    assert [got[k].problem for k in (4, 5, 6)] == ["not level", "3 corners", "start is no corner"]


def test_even_sample_is_whole_where_partitions_are_merged(spark):
    """The counts of the ranges are read from fewer columns than the rows, and merged otherwise."""
    held = {"spark.sql.shuffle.partitions": "12", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(40_000).select((F.col("id") * 7 % 40_009).alias("fid"), *(F.rand(i).alias(f"c{i}") for i in range(9)))
        ids = sorted(r.fid for r in df.select("fid").collect())
        assert sorted(r.fid for r in topology.evenly(df, 777, 40_000).collect()) == [ids[i * 40_000 // 777] for i in range(777)]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
