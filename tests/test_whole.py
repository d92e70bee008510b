"""Operators against brute force and closed forms, where SQL says too little."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geolode.functions import text
from geolode.operators import graphs, rasters, sections, spatial, surfaces, water
from geolode.plans import queries
from tests.conftest import DATA


def test_traces_run_to_their_end(spark):
    n = 205
    flow = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(n, -1)], "fid long, flows_to long").coalesce(1)
    starts = spark.createDataFrame([(0, 0), (n - 2, n - 2)], "start long, fid long").coalesce(1)
    got = {(r.start, r.step, r.fid) for r in water.traces(starts, flow).collect()}
    assert got == {(0, i, i) for i in range(n + 1)} | {(n - 2, i, n - 2 + i) for i in range(3)}


def test_roots_of_long_tails_and_cycles(spark):
    flow = [(i, i + 1) for i in range(90)] + [(90, 95), (95, 97), (97, 96), (96, 95), (200, -2)] + [(i, i - 1) for i in range(201, 260)]
    got = {r.fid: r.root for r in graphs.flow_roots(spark.createDataFrame(flow, "fid long, flows_to long").coalesce(2)).collect()}
    assert got == {i: 95 for i in [*range(91), 95, 96, 97]} | {i: 200 for i in range(200, 260)}


def test_every_node_has_its_exact_distance(spark):
    rng = random.Random(5)
    nodes = {(rng.randint(-30, 30), rng.randint(-20, 40)) for _ in range(500)}
    for n in (1, 3, 40):
        mask = {(rng.randint(-45, 45), rng.randint(-40, 60)) for _ in range(n)}
        frames = (spark.createDataFrame(sorted(x), "col long, row long") for x in (mask, nodes))
        got = {(r.col, r.row): r.d2 for r in rasters.distance2(*frames).collect()}
        assert got == {(c, r): min((c - a) ** 2 + (r - b) ** 2 for a, b in mask) for c, r in nodes}


def test_empty_mask_leaves_every_node_without_a_distance(spark):
    nodes = spark.createDataFrame([(0, 0), (5, 3)], "col long, row long")
    assert {(r.col, r.row, r.d2) for r in rasters.distance2(nodes.limit(0), nodes).collect()} == {(0, 0, None), (5, 3, None)}


def test_queries_on_faces_take_every_face(spark):
    n = queries.lattice_faces(spark, DATA).count()
    assert queries.slope_labels(spark, DATA).count() == queries.colour_ramp(spark, DATA).count() == n


# grade limits


def line(spark, heights, stations=None):
    return spark.createDataFrame([(1, float(s), float(z)) for s, z in zip(stations or range(len(heights)), heights, strict=True)], "route_id int, station double, z double")


@pytest.mark.parametrize(("heights", "limit", "want"), [([0, 5, 0], 1.0, [0, 1, 0]), ([0, 0, 0, 3], 1.0, [0, 1, 2, 3]), ([2, 2, 2], 0.5, [2, 2, 2]), ([0, 10, 0, 10, 0], 100.0, [0, 10, 0, 10, 0])])
def test_profile_holds_its_ends(spark, heights, limit, want):
    got = sections.grade_limited(line(spark, heights), limit).orderBy("station").collect()
    assert [r.grade_z for r in got] == pytest.approx(want) and all(r.feasible for r in got)


def test_ends_too_far_apart_are_refused(spark):
    got = sections.grade_limited(line(spark, [0, 5]), 1.0).collect()
    assert all(not r.feasible and r.grade_z is None and r.required == 5 for r in got)
    one = sections.grade_limited(line(spark, [3]), 1.0).first()
    assert one.feasible and one.grade_z == 3


def test_any_feasible_profile_keeps_grade_and_ends(spark):
    rng = random.Random(4)
    for _ in range(4):
        s = sorted(rng.sample(range(100), 20))
        z = [rng.uniform(0, 30) for _ in s]
        z[-1] = z[0] + 0.3 * (s[-1] - s[0])
        g = [r.grade_z for r in sections.grade_limited(line(spark, z, s), 0.5).orderBy("station").collect()]
        assert g[0] == z[0] and g[-1] == z[-1]
        assert all(abs(b - a) <= 0.5 * (t - u) + 1e-9 for a, b, u, t in zip(g, g[1:], s, s[1:], strict=False))


# tolerance merge


def merged_by_hand(points, tol):
    kept, out = [], {}
    for pid, x, y, z, is_line in sorted(points, key=lambda p: (not p[4], p[0])):
        into = next((k for k in kept if (k[1] - x) ** 2 + (k[2] - y) ** 2 < tol * tol and (not is_line or (k[3] - z) ** 2 < tol * tol)), None)
        if into is None:
            kept.append((pid, x, y, z))
        out[pid] = into[0] if into else pid
    return out


def test_points_merge_as_one_after_another(spark):
    rng = random.Random(8)
    points = [(i, rng.uniform(-4, 4), rng.uniform(-4, 4), rng.choice([0.0, 0.2, 3.0]), rng.random() < 0.4) for i in range(500)] + [(500, 1.0, 1.0, 0.0, True), (501, 1.0, 1.0, 9.0, True), (502, 1.0, 1.0, 5.0, False)]
    df = spark.createDataFrame([*points, (600, float("nan"), 0.0, 0.0, True), (601, None, 0.0, 0.0, False)], "pid long, x double, y double, z double, line boolean")
    for tol in (0.5, 0.05):
        got = {r.pid: r.kept_as for r in spatial.deduplicated(df, tol).collect()}
        assert got == merged_by_hand(points, tol)
    assert spatial.deduplicated(df.limit(0), 0.5).count() == 0


def test_points_across_a_cell_border_merge(spark):
    df = spark.createDataFrame([(1, 0.9995, 0.0, 0.0, False), (2, 1.0005, 0.0, 0.0, False)], "pid long, x double, y double, z double, line boolean")
    assert {r.kept_as for r in spatial.deduplicated(df, 0.01).collect()} == {1}


# harmonic fill


def test_wide_gaps_are_solved(spark, monkeypatch):
    nodes = [(c, r) for c in range(14) for r in range(11)]
    gap = {(c, r) for c, r in nodes if 3 <= c <= 9 and 2 <= r <= 8} | {(0, 0), (13, 5), (13, 6)}
    known = {(c, r): float(c * c + 3 * r) for c, r in nodes if (c, r) not in gap}
    at = {k: i for i, k in enumerate(sorted(gap))}
    a, b = np.zeros((len(at), len(at))), np.zeros(len(at))
    for (c, r), i in at.items():
        for n in ((c + 1, r), (c - 1, r), (c, r + 1), (c, r - 1)):
            if n in at or n in known:
                a[i, i] += 1
                if n in at:
                    a[i, at[n]] -= 1
                else:
                    b[i] += known[n]
    x = np.linalg.solve(a, b)
    g = spark.createDataFrame([(c, r, v) for (c, r), v in known.items()], "col long, row long, v double")
    u = spark.createDataFrame(nodes, "col long, row long")
    got = rasters.harmonic_filled(g, u).collect()
    assert len(got) == len(nodes) and max(r.residual for r in got) < 1e-9
    assert all(r.v == pytest.approx(x[at[r.col, r.row]] if (r.col, r.row) in at else known[r.col, r.row], abs=1e-8) for r in got)
    monkeypatch.setattr(rasters, "GAP", 1)
    rounds = {(r.col, r.row): r.v for r in rasters.harmonic_filled(g, u.where("col > 10"), 1e-4).collect()}
    assert rounds[13, 5] == pytest.approx(x[at[13, 5]], abs=1e-2)


def test_gap_without_a_border(spark):
    g = spark.createDataFrame([(0, 0, 2.0), (1, 0, 4.0)], "col long, row long, v double")
    u = spark.createDataFrame([(7, 7), (7, 8)], "col long, row long")
    assert {r.v for r in rasters.harmonic_filled(g, u).where("col = 7").collect()} == {3.0}


# contours by many levels


def test_many_levels_give_what_few_give(spark, monkeypatch):
    _, _, xyz = queries.mesh(spark, DATA)
    levels = queries._levels(spark)
    one = sorted(map(tuple, surfaces.contour_segments(xyz, levels).collect()))
    monkeypatch.setattr(surfaces, "SMALL", 2)
    assert sorted(map(tuple, surfaces.contour_segments(xyz, levels).collect())) == one


# text


def test_slopes_are_written_as_c_prints_them(spark):
    rng = random.Random(3)
    ratios = [1.6, 0.32, 8.0, 0.064, 0.0128, 0.02675, 0.00125, -1.6, *(round(rng.uniform(0, 9), 4) for _ in range(500))]
    df = spark.createDataFrame([(x,) for x in ratios], "r double")
    got = df.select("r", text.format_slope(F.col("r"), "ratio", 2).alias("ratio"), text.format_slope(F.col("r"), "percent", 2).alias("percent"), text.nearest_decimal(F.col("r") + 2.675, 2).alias("near")).collect()
    for r in got:
        assert (r.ratio, r.percent) == (f"1:{1 / r.r:.2f}" if r.r else "0", f"{r.r * 100:.2f}%")
        assert f"{r.near:.2f}" == f"{r.r + 2.675:.2f}"


# joins of exploded rows


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exploded_rows_do_not_go_through_the_driver(spark):
    """Their number is not known to the planner, which took them for few."""
    from geolode.operators import fields, labels
    from geolode.plans.lineage import materialized

    xyz = materialized(queries.mesh(spark, DATA)[2])
    lines = materialized(sections.plan_stations(queries._routes(spark, DATA)))
    assert "Broadcast" not in plan_of(sections.route_compliance(xyz, lines, 1.25, 0.4, 1.0, 1.5))
    assert "Broadcast" not in plan_of(labels.slope_arrows(xyz, 1.0, 2.0))
    field = materialized(lines.select(F.col("x").cast("long").alias("gi"), F.col("y").cast("long").alias("gj"), F.col("z").cast("float").alias("value")))
    assert "Broadcast" not in plan_of(fields.resampled(field, 1.0, 2.0))
