"""Registered queries over the driver tables; results are rounded at the edge, never inside."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geolode.functions import geometry as G
from geolode.functions import text as X
from geolode.operators import faces as FA
from geolode.operators import edits, graphs, kernels, lines, ranges, rasters, sections, spatial, surfaces, topology, water
from geolode.sources import exchange as EX
from geolode.sources import survey
from geolode.sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
R = G.settled


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(R(n).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes))


def mesh(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    v = T.lattice_vertices(spark, d)
    f = T.lattice_faces(v)
    return v, f, FA.gather(f, v)


def height(spark: SparkSession, d: str) -> float:
    return float(T.lattice_vertices(spark, d).agg(F.max("y")).first()[0])


# surface tables


@query
def lattice_vertices(spark, d):
    return rounded(T.lattice_vertices(spark, d))


@query
def lattice_faces(spark, d):
    return T.lattice_faces(T.lattice_vertices(spark, d))


@query
def face_measures(spark, d):
    m = FA.measured(mesh(spark, d)[2])
    return rounded(m.select("fid", "plan_area", "surface_area", "slope", F.col("cx_").alias("x"), F.col("cy_").alias("y"), F.col("cz_").alias("z")))


@query
def slope_units(spark, d):
    m = FA.measured(mesh(spark, d)[2])
    return rounded(m.select("fid", *(G.slope_in("slope", u).alias(u) for u in ("ratio", "percent", "promille", "degrees")), G.slope_from(G.slope_in("slope", "degrees"), "degrees").alias("back")))


@query
def slope_summary(spark, d):
    return rounded(FA.slope_summary(mesh(spark, d)[2], "degrees"))


@query
def slope_by_zone(spark, d):
    return rounded(FA.by_zone(mesh(spark, d)[2], T.zones(spark, d, height(spark, d))))


@query
def face_aspect(spark, d):
    xyz = mesh(spark, d)[2]
    return rounded(xyz.select("fid", G.bearing(0.005).alias("bearing")))


@query
def aspect_summary(spark, d):
    return rounded(FA.aspect_summary(mesh(spark, d)[2], 0.005))


@query
def aspect_sectors(spark, d):
    return rounded(FA.aspect_sectors(mesh(spark, d)[2], 0.005))


@query
def invalid_faces(spark, d):
    v, f, _ = mesh(spark, d)
    odd = f.where("fid % 97 = 0").select((-F.col("fid") - 1).alias("fid"), "a", F.col("a").alias("b"), F.when(F.col("fid") % 2 == 0, F.col("c")).otherwise(F.lit(-5)).alias("c"))
    return FA.invalid(f.unionByName(odd), v)


# topology


@query
def face_adjacency(spark, d):
    return topology.face_neighbours(mesh(spark, d)[1])


@query
def edge_topology(spark, d):
    return topology.edges(mesh(spark, d)[1])


@query
def naked_edges(spark, d):
    return topology.naked_edges(mesh(spark, d)[1])


@query
def vertex_degree(spark, d):
    return topology.vertex_degrees(mesh(spark, d)[1])


@query
def topology_checks(spark, d):
    return topology.topology_checks(mesh(spark, d)[1])


@query
def boundary_vertices(spark, d):
    return topology.boundary_vertices(mesh(spark, d)[1])


@query
def crease_edges(spark, d):
    _, f, xyz = mesh(spark, d)
    return rounded(topology.creases(xyz, f, 0.2))


@query
def mesh_regularity(spark, d):
    return rounded(topology.regularity(mesh(spark, d)[2]))


@query
def mesh_compaction(spark, d):
    v, f, _ = mesh(spark, d)
    return topology.compacted(v, f.where("fid % 6 < 2")).select("vid", "nid")


# ranges


def _slopes(spark, d) -> DataFrame:
    # Rounded values and weights, so that both engines put each into the same bin.
    return mesh(spark, d)[2].select(R(G.slope_in(G.slope_ratio(), "percent")).alias("v"), R(G.plan_area()).alias("w"))


@query
def weighted_histogram(spark, d):
    return rounded(ranges.histogram(_slopes(spark, d)).select("bin", "weight"))


@query
def weighted_percentile(spark, d):
    return rounded(ranges.percentiles(_slopes(spark, d), [0.02, 0.5, 0.98]))


@query
def auto_range(spark, d):
    return rounded(ranges.auto_range(_slopes(spark, d), "from_zero"))


@query
def stepped_bands(spark, d):
    return rounded(ranges.bands(ranges.auto_range(_slopes(spark, d))))


@query
def band_counts(spark, d):
    v = _slopes(spark, d)
    return rounded(ranges.band_weights(v, ranges.bands(ranges.auto_range(v))))


@query
def range_ticks(spark, d):
    return rounded(ranges.ticks(ranges.auto_range(_slopes(spark, d))))


@query
def histogram_bars(spark, d):
    return rounded(ranges.bars(_slopes(spark, d), 24))


# curvature and landforms


@query
def lattice_curvature(spark, d):
    return rounded(surfaces.curvatures(surfaces.derivatives(T.lattice_vertices(spark, d))))


@query
def landform_counts(spark, d):
    c = rounded(surfaces.curvatures(surfaces.derivatives(T.lattice_vertices(spark, d))))
    return surfaces.landforms(c, 0.25, 2.0)


# contours and volumes


def _levels(spark) -> DataFrame:
    return spark.range(1, 10).select((F.col("id") * 0.5).alias("level"))


@query
def contour_segments(spark, d):
    return rounded(surfaces.contour_segments(mesh(spark, d)[2], _levels(spark)))


@query
def contour_length_by_level(spark, d):
    return rounded(surfaces.contour_lengths(surfaces.contour_segments(mesh(spark, d)[2], _levels(spark))))


def _volumes(spark, d, exact: bool) -> DataFrame:
    v = T.lattice_vertices(spark, d)
    both = v.join(T.reference_vertices(spark, d).select("vid", F.col("z").alias("r")), "vid")
    return surfaces.cut_fill(FA.gather(T.lattice_faces(v), both, "r"), exact)


@query
def linear_cut_fill(spark, d):
    return rounded(surfaces.volume_totals(_volumes(spark, d, True)))


@query
def prism_cut_fill(spark, d):
    return rounded(surfaces.volume_totals(_volumes(spark, d, False)))


@query
def cut_fill_by_zone(spark, d):
    z = T.zones(spark, d, height(spark, d))
    cx, cy = (F.col("ax") + F.col("bx") + F.col("cx")) / 3, (F.col("ay") + F.col("by") + F.col("cy")) / 3
    m = _volumes(spark, d, True).withColumns({"px": cx, "py": cy})
    m = spatial.in_rectangles(m, "px", "py", z)
    return rounded(surfaces.volume_totals(m, "zone_id"))


@query
def difference_contours(spark, d):
    _, f, xyz = mesh(spark, d)
    p = surfaces.paired(xyz, f, T.reference_vertices(spark, d)).withColumns({f"d{k}": F.col(f"{k}z") - F.col(f"r{k}") for k in "abc"})
    return rounded(surfaces.contour_segments(p, spark.createDataFrame([(0.0,)], "level double"), ("da", "db", "dc")))


# spatial joins


def _points(spark, d) -> DataFrame:
    c = T.table(spark, d, "customer")
    k = F.col("c_custkey")
    return c.select(k.alias("pid"), ((k * 37) % 4999 / 100).alias("x"), ((k * 53) % 2903 / 100).alias("y"), (F.col("c_acctbal") / 1000).alias("z"))


def _rings(spark) -> DataFrame:
    """Three areas: a hexagon with a square hole, a concave one, a triangle."""
    rows = [(1, 0, [(5, 5), (15, 2), (25, 6), (24, 18), (14, 22), (4, 16)]), (1, 1, [(10, 8), (18, 8), (18, 14), (10, 14)]), (2, 0, [(28, 3), (45, 3), (45, 25), (37, 9), (28, 24)]), (3, 0, [(20, 15), (35, 27), (12, 28)])]
    flat = [(a, r, i, float(x), float(y)) for a, r, p in rows for i, (x, y) in enumerate(p)]
    return spark.createDataFrame(flat, "area_id int, ring_id int, seq int, x double, y double")


@query
def points_in_areas(spark, d):
    return spatial.points_in_rings(_points(spark, d), spatial.ring_edges(_rings(spark)), 4.0)


@query
def area_distance(spark, d):
    return rounded(spatial.ring_distance(_points(spark, d), spatial.ring_edges(_rings(spark)), 1.5))


@query
def ring_areas(spark, d):
    return rounded(spatial.ring_areas(_rings(spark)))


@query
def zone_priority(spark, d):
    z = T.zones(spark, d, height(spark, d))
    wide = z.select("zone_id", *((F.col(k) + (3 if k[1] == "1" else 0)).alias(k) for k in ("x0", "y0", "x1", "y1")), "priority")
    return spatial.zone_of(_points(spark, d), wide)


@query
def point_heights(spark, d):
    h = spatial.heights_at(_points(spark, d), mesh(spark, d)[2], 2.0)
    return h.select("pid", F.round("low_z", 11).alias("low_z"), F.round("top_z", 11).alias("top_z"), "status")


@query
def nearest_vertices(spark, d):
    return rounded(spatial.nearest_vertex(_points(spark, d), T.lattice_vertices(spark, d), 0.6))


def _segments(spark, d) -> DataFrame:
    s = F.col("s_suppkey")
    return T.table(spark, d, "supplier").select(s.alias("sid"), ((s * 17) % 47).cast("double").alias("x0"), ((s * 29) % 31).cast("double").alias("y0"), ((s * 17) % 47 + (s * 7) % 11 - 5).cast("double").alias("x1"), ((s * 29) % 31 + (s * 13) % 9 - 4 + 0.5).alias("y1"))


@query
def segment_crossings(spark, d):
    return rounded(spatial.segment_crossings(_segments(spark, d), 4.0))


@query
def clipped_segments(spark, d):
    return rounded(spatial.clipped_to_box(_segments(spark, d), 8.0, 6.0, 34.0, 24.0))


@query
def point_dedup(spark, d):
    """Every third point stands for a breakline's."""
    return spatial.deduplicated(_points(spark, d).withColumn("line", F.col("pid") % 3 == 0), 0.4).select("pid", "kept_as")


# sections and routes


def _routes(spark, d) -> DataFrame:
    """The lattice's columns as routes, along y."""
    return T.lattice_vertices(spark, d).select(F.col("x").cast("int").alias("route_id"), F.col("y").cast("int").alias("seq"), "x", "y", "z")


@query
def plan_stations(spark, d):
    return rounded(sections.plan_stations(_routes(spark, d)))


@query
def profile_lookup(spark, d):
    lines = sections.plan_stations(_routes(spark, d))
    q = lines.select("route_id", (F.col("station") * 1.07 - 0.5).alias("station"))
    e = sections.elevation_at(lines, q, 8.0)
    return e.select("route_id", R("station").alias("station"), F.round("z", 11).alias("z"))


@query
def even_stations(spark, d):
    return rounded(sections.even_stations(_routes(spark, d), 1.7))


@query
def section_cut_fill(spark, d):
    lines = sections.plan_stations(_routes(spark, d))
    pairs = lines.select("route_id", "station", F.col("z").alias("proposed"), (2.5 + F.col("station") * 0.003).alias("reference"))
    return rounded(sections.section_cut_fill(pairs))


@query
def section_slice(spark, d):
    return rounded(sections.sliced(mesh(spark, d)[2], 1.3, 0.7, 47.1, 21.9))


@query
def route_metrics(spark, d):
    return rounded(sections.route_metrics(sections.plan_stations(_routes(spark, d))))


@query
def route_runs(spark, d):
    lines = sections.plan_stations(_routes(spark, d)).withColumn("z", R("z"))
    return rounded(sections.runs(lines, 2.0, 0.45, 2.0))


@query
def grade_limited_profile(spark, d):
    g = sections.grade_limited(sections.plan_stations(_routes(spark, d)), 1.5)
    return rounded(g.select("route_id", "station", "upper", "lower", "required", "feasible", "grade_z"))


@query
def route_compliance(spark, d):
    return rounded(sections.route_compliance(mesh(spark, d)[2], sections.plan_stations(_routes(spark, d)), 1.25, 0.4, 1.0, 1.5))


@query
def allowed_going(spark, d):
    m = FA.measured(mesh(spark, d)[2]).where("slope > 0")
    return rounded(m.select("fid", sections.allowed_going("slope", [(1.0, 2.0), (2.0, 5.0), (4.0, 10.0)]).alias("linear"), sections.allowed_going("slope", [(1.0, 2.0), (2.0, 5.0), (4.0, 10.0)], True).alias("strict")))


@query
def route_cost(spark, d):
    m = FA.measured(mesh(spark, d)[2])
    return rounded(m.select("fid", G.route_unit_cost("slope", 0.8).alias("cost")))


# rasters


def _grid(spark, d) -> DataFrame:
    return rasters.rasterized(T.cloud(spark, d), 1.0).select("col", "row", F.col("top").alias("v"))


@query
def cloud_raster(spark, d):
    return rounded(rasters.rasterized(T.cloud(spark, d), 1.0))


@query
def raster_erode(spark, d):
    return rounded(rasters.eroded(_grid(spark, d), 1))


@query
def raster_dilate(spark, d):
    return rounded(rasters.dilated(_grid(spark, d), 2))


@query
def raster_open(spark, d):
    return rounded(rasters.opened(_grid(spark, d), 1))


@query
def progressive_ground(spark, d):
    return rounded(rasters.ground_filter(_grid(spark, d), [1, 2, 4], 1.0, 0.8, 1.0, 6.0))


@query
def rough_ground(spark, d):
    return rounded(rasters.rough(_grid(spark, d), 1, 12.0))


@query
def coarse_grid(spark, d):
    return rounded(rasters.coarse(_grid(spark, d), 4))


@query
def grid_sample(spark, d):
    sparse = _grid(spark, d).where("(col * 7 + row * 3) % 5 != 0")
    return rounded(rasters.sampled(sparse, _points(spark, d)))


@query
def mask_components(spark, d):
    return rasters.labelled(_grid(spark, d).where("v < 47 or (col + row) % 3 = 0").select("col", "row"))


# graphs


@query
def basin_flow(spark, d):
    _, f, xyz = mesh(spark, d)
    return surfaces.lattice_flow(xyz, topology.face_neighbours(f))


@query
def basin_roots(spark, d):
    return graphs.flow_roots(basin_flow(spark, d))


@query
def basin_areas(spark, d):
    _, _, xyz = mesh(spark, d)
    return rounded(graphs.basins(basin_roots(spark, d), FA.measured(xyz)))


@query
def point_clusters(spark, d):
    return rounded(graphs.merge_clusters(_points(spark, d), 0.9).select("pid", "cluster", "x", "y", "z", "n"))


@query
def boundary_peel(spark, d):
    """A mesh with holes, steep faces taken off from its borders."""
    _, f, xyz = mesh(spark, d)
    holes = f.where("fid % 101 != 0")
    return graphs.peeled(xyz, holes, 1.2, 170.0, 60.0).select("fid")


@query
def laplacian_smooth(spark, d):
    v, f, _ = mesh(spark, d)
    held = topology.boundary_vertices(f).select("vid")
    # Halves of sixths of seven decimals: fewer places would round on ties.
    return surfaces.smoothed(v, topology.vertex_neighbours(f), held, 2, 0.5).select("vid", F.round("z", 12).alias("z"))


# survey


def survey_lines(spark: SparkSession, d: str) -> DataFrame:
    e = T.table(spark, d, "events")
    m = F.when(F.col("event_id") % 11 == 0, " ST").when(F.col("event_id") % 11 == 5, " CLOSE").when(F.col("event_id") % 11 == 8, " END").otherwise("")
    bad = F.when(F.col("event_id") % 97 == 3, F.lit("n/a")).otherwise((F.col("user_id") % 90).cast("string"))
    code = F.concat(F.upper("event_type"), (F.col("user_id") % 4).cast("string"), m)
    text = F.concat_ws(",", F.col("event_id").cast("string"), bad, (F.col("event_id") % 71).cast("string"), (F.col("user_id") % 13).cast("string"), code)
    line = F.when(F.col("event_id") % 53 == 7, F.lit("# remark")).when(F.col("event_id") % 59 == 9, F.lit("1,2")).otherwise(text)
    return e.select((F.col("event_id") + 1).alias("line_number"), line.alias("line"))


@query
def survey_points(spark, d):
    return rounded(survey.parse_points(survey_lines(spark, d), scale=0.5, offset=10.0))


@query
def delimiter_scores(spark, d):
    return survey.delimiter_scores(survey_lines(spark, d), 4)


@query
def code_parse(spark, d):
    p = survey.parse_points(survey_lines(spark, d)).where("problem is null")
    return survey.parse_codes(p).select("line_number", "code", "figure", "starts", "ends", "closes")


@query
def unmatched_codes(spark, d):
    p = survey.parse_codes(survey.parse_points(survey_lines(spark, d)).where("problem is null"))
    return survey.unmatched_codes(p, spark.createDataFrame([("click",), ("view",)], "code string"))


@query
def figure_runs(spark, d):
    p = survey.parse_codes(survey.parse_points(survey_lines(spark, d)).where("problem is null"))
    f = survey.figures(p)
    return f.groupBy("code", "figure", "figure_id", "kind", "closed").agg(F.count("*").alias("n"), F.min("line_number").alias("first_line")).drop("figure_id")


# reports


@query
def report_zones(spark, d):
    """Zone table with a total row (zone_id -1)."""
    v = FA.measured(mesh(spark, d)[2])
    z = T.zones(spark, d, height(spark, d))
    m = spatial.in_rectangles(v, "cx_", "cy_", z)
    r = m.rollup("zone_id").agg(F.count("*").alias("n_faces"), F.sum("plan_area").alias("plan_area"), F.max("slope").alias("max_slope"))
    return r.select(F.coalesce("zone_id", F.lit(-1)).alias("zone_id"), "n_faces", F.format_string("%.2f", "plan_area").alias("plan_area"), F.format_string("%.1f%%", F.col("max_slope") * 100).alias("max_slope"))


@query
def face_owner_groups(spark, d):
    f = mesh(spark, d)[1]
    w = Window.partitionBy("owner")
    return f.select("fid", (F.col("fid") % 17).alias("owner")).withColumn("n", F.count("*").over(w)).groupBy("owner").agg(F.max("n").alias("n"), F.min("fid").alias("first_fid"))


# text, colours, exchange


@query
def slope_texts(spark, d):
    o = T.table(spark, d, "orders")
    k = F.col("o_orderkey")
    t = F.when(k % 7 == 0, F.concat(F.lit("1:"), (k % 9).cast("string"))).when(k % 7 == 1, F.concat((k % 300).cast("string"), F.lit("%"))).when(k % 7 == 2, F.concat((k % 95).cast("string"), F.lit("°"))).when(k % 7 == 3, (k % 11).cast("string")).when(k % 7 == 4, F.concat(F.lit(" "), (k % 13).cast("string"), F.lit(" : 2 "))).when(k % 7 == 5, F.lit("steep")).otherwise(F.concat((k % 50).cast("string"), F.lit("‰")))
    return rounded(o.select(k.alias("id"), X.parse_slope(t, "ratio").alias("ratio"), X.parse_slope(t, "percent").alias("percent")))


@query
def slope_labels(spark, d):
    s = F.round("slope", 4)
    return FA.measured(mesh(spark, d)[2]).select("fid", *(X.format_slope(s, u, 2).alias(u) for u in ("ratio", "percent", "degrees")))


@query
def report_csv(spark, d):
    s = T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.concat(F.col("s_name"), F.lit(', "x"')).alias("name"), X.report_number(F.col("s_acctbal") / 3, 2).alias("balance"))
    return EX.report_lines(s, ["name", "balance"], "k")


@query
def colour_ramp(spark, d):
    c = X.ramp(G.normalized(F.round("slope", 6), 0.0, 3.0), [(0.0, (0, 80, 255)), (0.5, (240, 240, 90)), (1.0, (200, 0, 30))])
    return FA.measured(mesh(spark, d)[2]).select("fid", c.alias("c")).select("fid", "c.r", "c.g", "c.b")


@query
def category_colours(spark, d):
    return T.table(spark, d, "nation").select("n_nationkey", X.category_colour(F.col("n_nationkey") - 2, ["#aa0000", "#00aa00", "#0000aa"]).alias("colour"))


@query
def landxml_round_trip(spark, d):
    v, f, _ = mesh(spark, d)
    lines = EX.surface_xml(v, f, "ground")
    p, q = EX.surface_points(lines), EX.surface_faces(lines)
    return rounded(p.agg(F.count("*").alias("n_points"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.max("z").alias("max_z")).join(q.agg(F.count("*").alias("n_faces"), F.sum(F.col("a") + F.col("b") * 2 + F.col("c") * 3).alias("checksum")), how="cross"))


@query
def raster_georeference(spark, d):
    g = _grid(spark, d)
    x, y = EX.pixel_to_plan(F.col("col"), F.col("row"), {"a": 0.5, "b": 0.1, "d": -0.05, "e": -0.5, "c": 100.0, "f": 900.0})
    return rounded(g.select("col", "row", x.alias("x"), y.alias("y")))


@query
def write_plan(spark, d):
    s = T.table(spark, d, "supplier")
    k, fp = F.col("s_suppkey"), F.sha2(F.col("s_name"), 256)
    wanted = s.where("s_suppkey % 5 != 1").select(k.alias("key"), fp.alias("fingerprint"))
    existing = s.where("s_suppkey % 3 != 2").select(k.alias("key"), F.when(k % 4 == 0, F.lit("old")).otherwise(fp).alias("fingerprint"))
    return EX.write_plan(wanted, existing)


@query
def height_fingerprints(spark, d):
    return EX.fingerprints(T.lattice_vertices(spark, d), "vid", ["z"])


# edits and masks


def _ring_edges(spark) -> DataFrame:
    return spatial.ring_edges(_rings(spark))


@query
def protected_influence(spark, d):
    return rounded(edits.influence(_points(spark, d), _ring_edges(spark), 1.5))


@query
def points_near_areas(spark, d):
    return edits.within(_points(spark, d), _ring_edges(spark), 0.75)


@query
def scatter_mask(spark, d):
    e = _ring_edges(spark)
    return rounded(edits.scatter_mask(_points(spark, d), e.where("area_id < 3"), e.where("area_id = 3"), 0.5, 0.3, 1.0))


@query
def conformed_surface(spark, d):
    v = T.lattice_vertices(spark, d)
    t = T.reference_vertices(spark, d).where("vid % 3 != 0").select("vid", F.col("z").alias("target_z"))
    return edits.conformed(v, t, 0.25).select("vid", F.round("z", 11).alias("z"))


@query
def graded_pads(spark, d):
    pads = spark.createDataFrame([(1, 2.0, 2.0), (2, 1.0, 1.5), (3, 3.0, 1.0)], "area_id int, pad_z double, batter double")
    return rounded(edits.padded(T.reference_vertices(spark, d), _ring_edges(spark), pads, 3.0))


@query
def graded_corridor(spark, d):
    v = T.reference_vertices(spark, d)
    legs = sections.legs(sections.plan_stations(_routes(spark, d).withColumn("z", 2.0 + F.col("y") * 0.01)))
    return rounded(edits.corridor(v, legs, 1.0, 2.0, 3.0))


@query
def brush_dab(spark, d):
    return rounded(edits.brushed(T.reference_vertices(spark, d), 20.3, 10.7, 6.0, 0.8).select("vid", "z"))


@query
def pad_balance(spark, d):
    _, _, xyz = mesh(spark, d)
    xyz = xyz.cache()

    def net(level: float) -> float:
        area = G.plan_area()
        fill, cut = G.linear_cut_fill(area, *(F.lit(level) - F.col(f"{k}z") for k in "abc"))
        return xyz.agg((F.sum(cut) - F.sum(fill)).alias("n")).first().n

    level, _ = edits.balance(net, 0.0, 6.0, tolerance=1e-4)
    xyz.unpersist()
    return spark.createDataFrame([(round(level, 3),)], "level double")


# lines


@query
def height_conflicts(spark, d):
    s = _segments(spark, d)
    h = s.select("sid", (F.col("sid") % 13).cast("double").alias("z0"), (F.col("sid") % 7).cast("double").alias("z1"))
    return rounded(lines.height_conflicts(s, h, 4.0, 1.5))


@query
def split_segments(spark, d):
    return rounded(lines.split_at_crossings(_segments(spark, d), 4.0))


@query
def crossing_chains(spark, d):
    s = _segments(spark, d).withColumn("chain_id", F.floor(F.col("sid") / 3))
    return lines.crossing_chains(s, 4.0)


@query
def boundary_chains(spark, d):
    f = mesh(spark, d)[1].where("fid % 101 != 0")
    return lines.chain_labels(topology.naked_edges(f))


@query
def draped_lines(spark, d):
    r = sections.plan_stations(_routes(spark, d))
    h = r.where("(seq * 7 + route_id) % 5 != 0").select("route_id", "seq", (F.col("z") + 1).alias("h"))
    cols = ["route_id", "seq", "part", "z"]
    split, bridge = (lines.draped(r, h, p).select(F.lit(p).alias("policy"), *cols) for p in ("split", "bridge"))
    return rounded(split.unionByName(bridge))


@query
def zone_stack_order(spark, d):
    n = T.table(spark, d, "nation")
    z = n.select(F.col("n_nationkey").alias("zone_id"), (F.col("n_nationkey") % 6).alias("zone_order"), (F.col("n_nationkey") % 4).alias("source_order"), F.col("n_nationkey").alias("ordinal"), (F.col("n_regionkey") % 2 == 0).alias("by_elevation"), ((F.col("n_nationkey") * 7) % 11).cast("double").alias("elevation"))
    return lines.priority_order(z).select("zone_id", "place")


@query
def curve_review(spark, d):
    s = T.table(spark, d, "supplier")
    k = F.col("s_suppkey")
    r = s.select(k.alias("route_id"), ((k * 7) % 23 / 100).alias("grade"), ((k * 11) % 37 + 5).cast("double").alias("radius"), ((k * 13) % 19 / 10).alias("break_"), ((k * 17) % 41 / 40 + 0.01).alias("coverage"))
    return lines.reviewed(r, 0.12, 20.0, 1.0, 0.8)


@query
def level_area_compliance(spark, d):
    return rounded(lines.level_areas(mesh(spark, d)[2], _ring_edges(spark), 3.0, 0.9))


@query
def trimmed_faces(spark, d):
    _, f, xyz = mesh(spark, d)
    c = FA.measured(xyz).select(F.col("fid").alias("pid"), F.col("cx_").alias("x"), F.col("cy_").alias("y"))
    hit = spatial.points_in_rings(c, _ring_edges(spark), 4.0)
    role = F.element_at(F.array(F.lit("outer"), F.lit("show"), F.lit("hide")), F.col("area_id"))
    return lines.trimmed_faces(hit.select(F.col("pid").alias("fid"), role.alias("role")), f)


# more rasters


def _mask(spark, d) -> DataFrame:
    return _grid(spark, d).where("v >= 44").select("col", "row")


@query
def mask_open(spark, d):
    return rasters.mask_opened(_mask(spark, d), 1)


@query
def mask_distance(spark, d):
    """Distance of every node to the nearest of the lowest nodes, a mask that no grid leaves empty."""
    g = _grid(spark, d)
    low = g.agg(F.min("v").alias("low"))
    return rasters.distance2(g.join(F.broadcast(low), F.col("v") == F.col("low"), "left_semi").select("col", "row"), g.select("col", "row"))


@query
def mask_largest(spark, d):
    return rasters.largest_component(rasters.labelled(_grid(spark, d).where("v < 47 or (col + row) % 3 = 0").select("col", "row")))


@query
def harmonic_fill(spark, d):
    g = _grid(spark, d)
    known = g.where("(col * 7 + row * 3) % 5 != 0")
    return rounded(rasters.harmonic_filled(known, g.select("col", "row")).select("col", "row", "v"))


@query
def classified_ground(spark, d):
    r = rasters.rasterized(T.cloud(spark, d), 1.0)
    g = rasters.ground_filter(r.select("col", "row", F.col("top").alias("v")), [1, 2], 1.0, 0.8, 1.0, 6.0)
    return rounded(rasters.with_classified_ground(g, r))


@query
def route_height_grid(spark, d):
    v = T.lattice_vertices(spark, d)
    p = v.select(F.col("vid").alias("pid"), (F.col("x") + 0.25).alias("x"), (F.col("y") + 0.5).alias("y"))
    return spatial.heights_at(p, mesh(spark, d)[2], 2.0).select("pid", F.round("top_z", 11).alias("top_z"))


# kernels


@query
def water_traces(spark, d):
    starts = T.lattice_faces(T.lattice_vertices(spark, d)).select(F.col("fid").alias("start"), "fid")
    return water.traces(starts, basin_flow(spark, d))


@query
def basin_rims(spark, d):
    _, f, xyz = mesh(spark, d)
    return rounded(water.rims(basin_roots(spark, d), xyz, f))


@query
def ponds(spark, d):
    _, f, xyz = mesh(spark, d)
    flow = basin_flow(spark, d)
    out = flow.where("flows_to = -1").select(F.col("fid").alias("root"))
    sinks = graphs.flow_roots(flow).join(out, "root", "left_anti")
    return rounded(water.ponds(sinks, xyz, f))


@query
def contour_chains(spark, d):
    return rounded(kernels.stitched(surfaces.contour_segments(T.lattice_corners(T.lattice_vertices(spark, d)), _levels(spark)), 1e-6, 512.0).drop("chain"))


@query
def displacement_noise(spark, d):
    return rounded(kernels.with_noise(T.lattice_vertices(spark, d), 7.0, 4, 0.5, 42).select("vid", "noise"))


@query
def region_scatter(spark, d):
    return rounded(kernels.scattered(0.0, 0.0, 49.0, 29.0, 1.0, 0.8, 7, _ring_edges(spark)))


@query
def thinned_scatter(spark, d):
    return rounded(kernels.thinned(kernels.scattered(0.0, 0.0, 49.0, 29.0, 1.0, 0.8, 7, _ring_edges(spark)), 0.9))


@query
def cheapest_routes(spark, d):
    g = T.lattice_vertices(spark, d).select(F.col("x").cast("long").alias("col"), F.col("y").cast("long").alias("row"), F.col("z").alias("v"))
    r = spark.createDataFrame([(1, 2, 3, 44, 25), (2, 48, 1, 5, 20)], "request int, c0 long, r0 long, c1 long, r1 long")
    return rounded(kernels.cheapest_routes(g, r, 0.5))
