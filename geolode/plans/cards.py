"""Cards: what a user calls by name on a surface, each one function with its defaults.

A card takes a surface (vertices and faces) and settings, and returns a
DataFrame. ``card`` registers more; ``settings_json`` and ``from_json`` keep a
stack of cards and their settings.
"""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolode.functions import geometry as G
from geolode.operators import cleanup, curves, drainage, edits, faces, graphs, kernels, labels, overlay, ranges, rays, sections, spatial, surfaces, tin, topology, water
from geolode.plans.lineage import materialized


@dataclass(frozen=True)
class Surface:
    vertices: DataFrame
    faces: DataFrame

    @property
    def xyz(self) -> DataFrame:
        return faces.gather(self.faces, self.vertices)

    @property
    def flow(self) -> DataFrame:
        n = topology.face_neighbours(self.faces)
        xyz = self.xyz
        z = xyz.select("fid", ((F.col("az") + F.col("bz") + F.col("cz")) / 3).alias("z"))
        return materialized(drainage.with_flats(surfaces.lattice_flow(xyz, n), n, z))


CARDS: dict[str, dict[str, Callable[..., DataFrame]]] = {k: {} for k in ("analysis", "annotation", "marker", "modifier", "object")}


def card(family: str, kind: str):
    """Registers a function (surface, ...) under a family and kind."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        CARDS[family][kind] = f
        return f

    return add


def defaults(family: str, kind: str) -> dict:
    """Settings that a card takes when none are given."""
    return {k: p.default for k, p in inspect.signature(CARDS[family][kind]).parameters.items() if p.default is not inspect.Parameter.empty}


def settings_json(stack: list[tuple[str, str, dict]]) -> str:
    """A stack of (family, kind, settings) as JSON, defaults written out, so that a later default changes no saved stack."""
    return json.dumps([{"family": f, "kind": k, "settings": defaults(f, k) | s} for f, k, s in stack], sort_keys=True)


def from_json(text: str) -> list[tuple[str, str, dict]]:
    """The stack again; KeyError for a kind that is not registered."""
    out = [(c["family"], c["kind"], c["settings"]) for c in json.loads(text)]
    for family, kind, _ in out:
        CARDS[family][kind]
    return out


# analyses


@card("analysis", "slope")
def slope(s: Surface, unit: str = "percent") -> DataFrame:
    return faces.slope_summary(s.xyz, unit)


@card("analysis", "aspect")
def aspect(s: Surface, flat_ratio: float = 0.005) -> DataFrame:
    return faces.aspect_sectors(s.xyz, flat_ratio)


@card("analysis", "elevation")
def elevation(s: Surface, interval: float | None = None) -> DataFrame:
    v = s.xyz.select(((F.col("az") + F.col("bz") + F.col("cz")) / 3).alias("v"), G.plan_area().alias("w"))
    return ranges.band_weights(v, ranges.bands(ranges.auto_range(v), interval))


@card("analysis", "curvature")
def curvature(s: Surface, tolerance: float = 0.1, length: float = 1.0) -> DataFrame:
    return surfaces.landform_areas(s.xyz, surfaces.curvatures(surfaces.derivatives(s.vertices)), tolerance, length)


@card("analysis", "cut-fill")
def cut_fill(s: Surface, reference: Surface) -> DataFrame:
    both = s.vertices.join(reference.vertices.select("vid", F.col("z").alias("r")), "vid")
    return surfaces.volume_totals(surfaces.cut_fill(faces.gather(s.faces, both, "r")))


@card("analysis", "earthwork")
def earthwork(s: Surface, reference: Surface, cell: float = 8.0) -> DataFrame:
    return overlay.volumes(overlay.pieces(s.xyz, reference.xyz, cell))


@card("analysis", "catchment")
def catchment(s: Surface, share: float = 0.0) -> DataFrame:
    flow, xyz = s.flow, materialized(s.xyz)
    roots = materialized(graphs.flow_roots(flow))
    ends = flow.where("flows_to = -1").select(F.col("fid").alias("root"))
    sinks = lambda r: r.select("root").distinct().join(ends, "root", "left_anti")
    roots = materialized(drainage.consolidated(roots, sinks(roots), xyz, s.faces))
    roots = drainage.without_slivers(roots, sinks(roots), xyz, s.faces, share) if share else roots
    return drainage.basin_table(roots, flow, xyz)


@card("analysis", "ponding")
def ponding(s: Surface, min_depth: float = 0.05) -> DataFrame:
    flow, xyz = s.flow, s.xyz
    ends = flow.where("flows_to = -1").select(F.col("fid").alias("root"))
    return water.ponds(graphs.flow_roots(flow).join(ends, "root", "left_anti"), xyz, s.faces, min_depth)


@card("analysis", "waterflow")
def waterflow(s: Surface, starts: DataFrame, cell: float = 2.0) -> DataFrame:
    """From points (pid, x, y); those off the surface start nothing."""
    at = spatial.faces_at(starts, s.xyz, cell).groupBy("pid").agg(F.min("fid").alias("fid"))
    return water.traces(at.select(F.col("pid").alias("start"), "fid"), s.flow)


@card("analysis", "gradient-compliance")
def gradient_compliance(s: Surface, routes: DataFrame, width: float = 2.0, walk: float = 0.05, ramp: float = 1 / 12, cross: float = 0.02) -> DataFrame:
    return sections.route_compliance(s.xyz, sections.plan_stations(routes), width / 2, walk, ramp, cross)


# annotations and markers


@card("annotation", "contour")
def contour(s: Surface, interval: float = 0.5) -> DataFrame:
    z = s.vertices.agg(F.floor(F.min("z") / interval).alias("lo"), F.ceil(F.max("z") / interval).alias("hi"))
    return surfaces.contour_segments(s.xyz, z.where("lo is not null").select(F.explode(F.sequence("lo", "hi")).alias("k")).select((F.col("k") * interval).alias("level")))


@card("annotation", "cross-section-station")
def cross_section_station(s: Surface, routes: DataFrame, spacing: float = 10.0, half_width: float = 5.0, step: float = 1.0, cell: float = 4.0) -> DataFrame:
    return labels.cross_sections(sections.plan_stations(routes), s.xyz, spacing, half_width, step, cell)


@card("annotation", "curve-elevation-label")
def curve_elevation_label(s: Surface, routes: DataFrame, spacing: float = 5.0, cell: float = 4.0) -> DataFrame:
    return labels.curve_labels(sections.plan_stations(routes), s.xyz, spacing, cell).drop("grade")


@card("annotation", "curve-slope-label")
def curve_slope_label(s: Surface, routes: DataFrame, spacing: float = 5.0, cell: float = 4.0) -> DataFrame:
    return labels.curve_labels(sections.plan_stations(routes), s.xyz, spacing, cell).where("grade is not null")


@card("annotation", "grade-callout")
def grade_callout(s: Surface, pairs: DataFrame, cell: float = 2.0) -> DataFrame:
    return labels.grade_callouts(pairs, s.xyz, cell)


@card("annotation", "legend")
def legend(s: Surface, interval: float | None = None) -> DataFrame:
    """Bands of height as they are shown."""
    v = s.xyz.select(((F.col("az") + F.col("bz") + F.col("cz")) / 3).alias("v"), G.plan_area().alias("w"))
    return ranges.bands(ranges.auto_range(v), interval)


@card("annotation", "longitudinal-section")
def longitudinal_section(s: Surface, routes: DataFrame, spacing: float = 1.0, cell: float = 4.0) -> DataFrame:
    return labels.curve_labels(sections.plan_stations(routes), s.xyz, spacing, cell).select("route_id", "seq", "station", "z")


@card("annotation", "terrain-section")
def terrain_section(s: Surface, x0: float = 0.0, y0: float = 0.0, x1: float = 1.0, y1: float = 1.0) -> DataFrame:
    return sections.sliced(s.xyz, x0, y0, x1, y1)


@card("annotation", "slope-arrows")
def slope_arrows(s: Surface, spacing: float = 1.0, cell: float = 2.0) -> DataFrame:
    return labels.slope_arrows(s.xyz, spacing, cell)


@card("annotation", "report-table")
def report_table(s: Surface, zones: DataFrame, unit: str = "percent") -> DataFrame:
    return faces.by_zone(s.xyz, zones, unit)


@card("annotation", "point-slope-label")
@card("marker", "slope")
def point_slopes(s: Surface, points: DataFrame, cell: float = 2.0) -> DataFrame:
    return labels.slopes_at(points, s.xyz, cell)


@card("annotation", "projected-elevation-label")
@card("marker", "elevation")
def point_heights(s: Surface, points: DataFrame, cell: float = 2.0) -> DataFrame:
    return spatial.heights_at(points, s.xyz, cell)


# modifiers give vertices, or triangles where there were none


@card("modifier", "displace")
def displace(s: Surface, scale: float = 10.0, amount: float = 1.0, octaves: int = 4, gain: float = 0.5, seed: int = 0) -> DataFrame:
    return edits.displaced(kernels.with_noise(s.vertices, scale, octaves, gain, seed), F.col("noise") * amount, F.lit(1.0)).drop("noise")


@card("modifier", "grade-pad")
def grade_pad(s: Surface, rings: DataFrame, pads: DataFrame, reach: float = 10.0) -> DataFrame:
    return edits.padded(s.vertices, spatial.ring_edges(rings), pads, reach)


@card("modifier", "grade-path")
def grade_path(s: Surface, routes: DataFrame, width: float = 2.0, batter: float = 2.0, reach: float = 5.0) -> DataFrame:
    return edits.corridor(s.vertices, sections.legs(sections.plan_stations(routes)), width / 2, batter, reach)


@card("modifier", "grade-line")
def grade_line(s: Surface, routes: DataFrame, batter: float = 2.0, reach: float = 5.0) -> DataFrame:
    return edits.corridor(s.vertices, sections.legs(sections.plan_stations(routes)), 0.0, batter, reach)


@card("modifier", "project-to")
def project_to(s: Surface, target: Surface, strength: float = 1.0, cell: float = 2.0) -> DataFrame:
    h = spatial.heights_at(s.vertices.withColumnRenamed("vid", "pid"), target.xyz, cell).where("top_z is not null")
    return edits.conformed(s.vertices, h.select(F.col("pid").alias("vid"), F.col("top_z").alias("target_z")), strength)


@card("modifier", "sculpt")
def sculpt(s: Surface, x: float = 0.0, y: float = 0.0, radius: float = 5.0, amount: float = 1.0, kind: str = "smooth") -> DataFrame:
    return edits.brushed(s.vertices, x, y, radius, amount, kind)


@card("modifier", "smooth")
def smooth(s: Surface, rounds: int = 3, strength: float = 0.5) -> DataFrame:
    return surfaces.smoothed(s.vertices, topology.vertex_neighbours(s.faces), topology.boundary_vertices(s.faces).select("vid"), rounds, strength)


@card("modifier", "triangulate")
def triangulate(s: Surface, radius: float = 2.0) -> DataFrame:
    """The vertices triangulated anew; faces come by number."""
    return tin.numbered(tin.triangulated(s.vertices.withColumnRenamed("vid", "pid"), radius))


@card("modifier", "clean")
def clean(s: Surface) -> DataFrame:
    return cleanup.normalized(s.vertices, s.faces)[1]


# objects


@card("object", "lowest-point")
def lowest_point(s: Surface, objects: DataFrame, cell: float = 2.0) -> DataFrame:
    return labels.lowest_points(objects, s.xyz, cell)


@card("object", "surface-oriented")
def surface_oriented(s: Surface, points: DataFrame, heading: float = 0.0, cell: float = 2.0) -> DataFrame:
    return labels.frames_at(points, s.xyz, cell, heading)


@card("object", "scatter")
def scatter(s: Surface, rings: DataFrame, spacing: float = 1.0, jitter: float = 0.8, seed: int = 7, distance: float = 0.0) -> DataFrame:
    e = s.vertices.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    p = kernels.scattered(*e, spacing, jitter, seed, spatial.ring_edges(rings))
    return kernels.thinned(p, distance) if distance > 0 else p


@card("object", "along-curve")
def along_curve(s: Surface, routes: DataFrame, spacing: float = 1.0, cell: float = 4.0) -> DataFrame:
    return curves.along(sections.plan_stations(routes), spacing, cell)


@card("object", "line-of-sight")
def line_of_sight(s: Surface, lines: DataFrame, cell: float = 2.0) -> DataFrame:
    return rays.first_hits(lines, s.xyz, cell)
