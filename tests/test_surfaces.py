"""Surfaces with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from geolode.functions import geometry as G
from geolode.operators import faces, graphs, ranges, rasters, sections, spatial, surfaces, topology
from geolode.sources import survey, tables


def lattice(spark, n, z):
    k = F.col("id")
    x, y = (k % n).cast("double"), F.floor(k / n).cast("double")
    return spark.range(n * n).select(k.alias("vid"), x.alias("x"), y.alias("y"), z(x, y).alias("z"))


def mesh(spark, n, z):
    v = lattice(spark, n, z)
    f = tables.lattice_faces(v, n)
    return v, f, faces.gather(f, v)


def test_plane_has_one_slope_and_one_bearing(spark):
    _, _, xyz = mesh(spark, 8, lambda x, y: 0.5 * x)
    r = faces.slope_summary(xyz, "percent").first()
    assert r.n_faces == 98 and r.min_slope == pytest.approx(50) == r.max_slope and r.mean_slope == pytest.approx(50)
    assert {round(b.b, 6) for b in xyz.select(G.bearing().alias("b")).collect()} == {270.0}  # falls to the west
    assert faces.aspect_summary(xyz).first().mean_bearing == pytest.approx(270)


def test_flat_faces_have_no_bearing(spark):
    _, _, xyz = mesh(spark, 4, lambda x, y: 0 * x + 3)
    s = faces.aspect_summary(xyz).first()
    assert s.n_flat == s.n_faces and s.mean_bearing is None


def test_flat_faces_are_a_sector_of_their_own(spark):
    _, _, xyz = mesh(spark, 4, lambda x, y: F.greatest(x - 2, 0 * x))
    assert {r.sector: r.n_faces for r in faces.aspect_sectors(xyz).collect()} == {"flat": 12, "W": 6}


def test_vertical_face_is_left_out_of_the_summary(spark):
    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.5, 0.0, 1.0)], "vid long, x double, y double, z double")
    f = spark.createDataFrame([(0, 0, 1, 2)], "fid long, a long, b long, c long")
    xyz = faces.gather(f, v)
    assert xyz.select(G.slope_ratio().alias("s")).first().s == math.inf
    assert faces.slope_summary(xyz, "degrees").first().n_faces == 0


def test_cut_fill_of_a_tilted_plane_is_exact(spark):
    v, f, xyz = mesh(spark, 5, lambda x, y: x - 2)
    level = v.withColumn("z", F.lit(0.0))
    t = surfaces.volume_totals(surfaces.cut_fill(surfaces.paired(xyz, f, level))).first()
    assert t.cut == pytest.approx(8) and t.fill == pytest.approx(8) and t.net == pytest.approx(0)


def test_contour_of_a_plane_is_as_long_as_the_plane_is_wide(spark):
    _, _, xyz = mesh(spark, 6, lambda x, y: x)
    levels = spark.createDataFrame([(2.5,)], "level double")
    assert surfaces.contour_lengths(surfaces.contour_segments(xyz, levels)).first().length == pytest.approx(5)


def test_level_at_a_vertex_counts_as_above(spark):
    _, _, xyz = mesh(spark, 3, lambda x, y: x)
    levels = spark.createDataFrame([(0.0,), (2.0,)], "level double")
    assert {r.level for r in surfaces.contour_segments(xyz, levels).collect()} == {2.0}


def test_curvature_of_a_bowl(spark):
    v = lattice(spark, 7, lambda x, y: (x - 3) * (x - 3) + (y - 3) * (y - 3))
    c = {r.vid: r for r in surfaces.curvatures(surfaces.derivatives(v)).collect()}
    assert c[24].mean == pytest.approx(-2) and c[24].gaussian == pytest.approx(4)
    assert len(c) == 25


def test_topology_of_a_square(spark):
    _, f, _ = mesh(spark, 3, lambda x, y: x)
    t = topology.topology_checks(f).first()
    assert (t.n_edges, t.n_naked, t.n_crowded, t.winds_alike) == (16, 8, 0, True)
    flipped = f.withColumn("b2", F.when(F.col("fid") == 0, F.col("c")).otherwise(F.col("b"))).withColumn("c", F.when(F.col("fid") == 0, F.col("b")).otherwise(F.col("c"))).withColumn("b", F.col("b2"))
    assert not topology.topology_checks(flipped).first().winds_alike


def test_third_use_of_an_edge_has_no_neighbour(spark):
    f = spark.createDataFrame([(0, 0, 1, 2), (1, 1, 0, 3), (2, 0, 1, 4)], "fid long, a long, b long, c long")
    n = {r.fid: (r.n0, r.n1, r.n2) for r in topology.face_neighbours(f).collect()}
    assert n == {0: (1, -1, -1), 1: (0, -1, -1), 2: (-1, -1, -1)}


def test_even_sample_by_rank(spark):
    df = spark.range(10).select((F.col("id") * 3).alias("fid"))
    assert sorted(r.fid for r in topology.evenly(df, 4, 10).collect()) == [3 * (i * 10 // 4) for i in range(4)]


def test_percentile_interpolates_inside_its_bin(spark):
    v = spark.createDataFrame([(float(i), 1.0) for i in range(101)], "v double, w double")
    p = {r.fraction: r.value for r in ranges.percentiles(v, [0.5]).collect()}
    assert p[0.5] == pytest.approx(50, abs=0.2)


@pytest.mark.parametrize(("lo", "hi", "shape", "want"), [(0.3, 7.6, "plain", (0.0, 8.0)), (2.0, 2.0, "plain", (2.0, 3.0)), (-3.0, 1.0, "symmetric", (-3.0, 3.0)), (0.0, 0.0, "symmetric", (-1.0, 1.0)), (4.0, 9.0, "from_zero", (0.0, 10.0))])
def test_snap(lo, hi, shape, want):
    assert ranges.snapped(lo, hi, shape) == pytest.approx(want)


def test_auto_range_without_values(spark):
    none = spark.createDataFrame([], "v double, w double")
    assert tuple(ranges.auto_range(none).first()) == (0.0, 1.0)
    assert tuple(ranges.auto_range(none, "symmetric").first()) == (-1.0, 1.0)


def test_bands_never_exceed_64(spark):
    r = spark.createDataFrame([(0.0, 1000.0)], "lo double, hi double")
    b = ranges.bands(r, 0.5).collect()
    assert len(b) <= 64 and max(x.high for x in b) == 1000.0


def test_flow_roots_end_cycles_at_their_least_face(spark):
    flow = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (4, -1), (5, 4), (6, 5), (7, -2)], "fid long, flows_to long")
    assert {r.fid: r.root for r in graphs.flow_roots(flow).collect()} == {1: 2, 2: 2, 3: 2, 4: 4, 5: 4, 6: 4, 7: 7}


def test_components_of_a_long_chain(spark):
    nodes = spark.range(200).select(F.col("id").alias("node"))
    links = spark.range(199).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).where("a != 99")
    assert sorted({r.root for r in graphs.components(nodes, links).collect()}) == [0, 100]


def test_point_in_ring_with_hole(spark):
    ring = [(1, 0, i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)])] + [(1, 1, i, x, y) for i, (x, y) in enumerate([(4.0, 4.0), (6.0, 4.0), (6.0, 6.0), (4.0, 6.0)])]
    e = spatial.ring_edges(spark.createDataFrame(ring, "area_id int, ring_id int, seq int, x double, y double"))
    p = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 11.0, 5.0)], "pid long, x double, y double")
    assert [r.pid for r in spatial.points_in_rings(p, e, 3.0).collect()] == [1]


def test_grade_limit_holds(spark):
    line = spark.createDataFrame([(1, float(i), [0.0, 5.0, 0.0, 1.0, 3.0][i]) for i in range(5)], "route_id int, station double, z double")
    g = [r.grade_z for r in sections.grade_limited(line, 1.0).orderBy("station").collect()]
    assert max(abs(a - b) for a, b in zip(g, g[1:], strict=False)) <= 1.0 + 1e-9


def test_opening_never_raises(spark):
    g = spark.range(60).select((F.col("id") % 10).alias("col"), F.floor(F.col("id") / 10).alias("row"), ((F.col("id") * 7) % 11).cast("double").alias("v"))
    both = rasters.opened(g, 1).withColumnRenamed("v", "o").join(g, ["col", "row"])
    assert both.count() == 60 and both.where("o > v").count() == 0


def test_survey_rows_and_codes(spark):
    lines = spark.createDataFrame([(1, "﻿# head"), (2, '7,10,20,3.5,"EP, 12" ST'), (3, "8,x,20,3.5,CL"), (4, "9,1"), (5, ""), (6, "10,1,2,3,TOE5 END")], "line_number long, line string")
    p = {r.line_number: r for r in survey.parse_points(lines.where("line_number > 1")).collect()}
    assert p[2].number == 7 and (p[2].x, p[2].y, p[2].z) == (20.0, 10.0, 3.5)
    assert p[3].problem == "bad number" and p[4].problem == "too few columns" and 5 not in p
    c = survey.parse_codes(spark.createDataFrame([("EP ST",), ("EP.ST",), ("toe12,END",), ("CL 4 CLOSE",), ("1.5",), (None,)], "raw string")).collect()
    assert [(r.code, r.figure, r.starts, r.ends, r.closes) for r in c[:4]] == [("EP", None, True, False, False), ("EP", None, True, False, False), ("TOE", 12, False, True, False), ("CL", 4, False, False, True)]
    assert c[4].code == "1.5" and c[4].figure is None


def test_empty_mesh(spark):
    v = spark.createDataFrame([], "vid long, x double, y double, z double")
    f = tables.lattice_faces(v)
    xyz = faces.gather(f, v)
    assert faces.slope_summary(xyz, "percent").first().n_faces == 0
    assert topology.face_neighbours(f).count() == 0
