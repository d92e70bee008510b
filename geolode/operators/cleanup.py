"""Meshes made sound: vertices that are one, faces without area, meshes put together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolode.operators import spatial


def _mapped(faces: DataFrame, names: DataFrame) -> DataFrame:
    """Faces with their corners renamed (rows vid, keep)."""
    out = faces
    for k in "abc":
        out = out.join(names.select(F.col("vid").alias(k), F.col("keep").alias(f"_{k}")), k).drop(k).withColumnRenamed(f"_{k}", k)
    return out.select("fid", "a", "b", "c")


def normalized(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) with vertices that are equal in 32 bits made one, that of greatest number, unused ones left out, and faces without three corners or without area dropped.

    Faces with corners that do not exist drop out too.
    """
    as_float = [(F.col(k).cast("float") + F.lit(0.0).cast("float")).alias(f"f{k}") for k in "xyz"]  # no negative zero
    v = vertices.select("vid", "x", "y", "z", *as_float)
    keep = v.groupBy("fx", "fy", "fz").agg(F.max("vid").alias("keep"))
    names = v.join(keep, ["fx", "fy", "fz"]).select("vid", "keep")
    f = _mapped(faces, names).where("a != b and b != c and c != a")
    xyz = f
    for k in "abc":
        xyz = xyz.join(vertices.select(F.col("vid").alias(k), *(F.col(c).alias(f"{k}{c}") for c in "xyz")), k)
    e1, e2 = [F.col(f"b{k}") - F.col(f"a{k}") for k in "xyz"], [F.col(f"c{k}") - F.col(f"a{k}") for k in "xyz"]
    flat = (e1[1] * e2[2] - e1[2] * e2[1] == 0) & (e1[2] * e2[0] - e1[0] * e2[2] == 0) & (e1[0] * e2[1] - e1[1] * e2[0] == 0)
    f = xyz.where(~flat).select("fid", "a", "b", "c")
    used = f.select(F.explode(F.array("a", "b", "c")).alias("vid")).distinct()
    return vertices.join(used, "vid", "left_semi"), f


def welded(vertices: DataFrame, faces: DataFrame, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) with vertices within a tolerance of an earlier one, in plan and height, made that one; faces that lose a corner drop out."""
    kept = spatial.deduplicated(vertices.select(F.col("vid").alias("pid"), "x", "y", "z", F.lit(True).alias("line")), tolerance)
    names = kept.select(F.col("pid").alias("vid"), F.col("kept_as").alias("keep"))
    f = _mapped(faces, names).where("a != b and b != c and c != a")
    return vertices.join(names.where("vid = keep").select("vid"), "vid", "left_semi"), f


def merged(parts: list[tuple[DataFrame, DataFrame]], tolerance: float) -> tuple[DataFrame, DataFrame]:
    """One mesh of several: vertices and faces of each after those of the ones before, then welded."""
    vertices = faces = None
    v0 = f0 = 0
    for v, f in parts:
        top = v.agg(F.max("vid")).first()[0], f.agg(F.max("fid")).first()[0]
        v, f = v.select((F.col("vid") + v0).alias("vid"), "x", "y", "z"), f.select((F.col("fid") + f0).alias("fid"), *((F.col(k) + v0).alias(k) for k in "abc"))
        vertices, faces = (v, f) if vertices is None else (vertices.unionByName(v), faces.unionByName(f))
        v0, f0 = v0 + (top[0] if top[0] is not None else -1) + 1, f0 + (top[1] if top[1] is not None else -1) + 1
    return welded(vertices, faces, tolerance)
