"""Exchange formats: surfaces as LandXML, world files, report tables as CSV, fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geolode.functions import text as X


def surface_xml(vertices: DataFrame, faces: DataFrame, name: str) -> DataFrame:
    """One row per line (n, line) of a LandXML surface: points as northing, easting, height, then faces by point id.

    Lines are rows and their order is a number, so a surface of any size is written by all executors.
    """
    num = lambda c: F.regexp_replace(F.format_string("%.6f", c), r"\.?0+$", "")
    spark = vertices.sparkSession
    esc = name.replace("&", "&amp;").replace('"', "&quot;").replace("<", "&lt;")
    rows = [(0, 0, '<?xml version="1.0"?>'), (0, 1, '<LandXML xmlns="http://www.landxml.org/schema/LandXML-1.2" version="1.2">'), (0, 2, f'<Surfaces><Surface name="{esc}"><Definition surfType="TIN"><Pnts>'), (2, 0, "</Pnts><Faces>"), (4, 0, "</Faces></Definition></Surface></Surfaces></LandXML>")]
    frame = spark.createDataFrame(rows, "part long, n long, line string")
    p = vertices.select(F.lit(1).cast("long").alias("part"), F.col("vid").alias("n"), F.concat(F.lit('<P id="'), F.col("vid").cast("string"), F.lit('">'), F.concat_ws(" ", num(F.col("y")), num(F.col("x")), num(F.col("z"))), F.lit("</P>")).alias("line"))
    f = faces.select(F.lit(3).cast("long").alias("part"), F.col("fid").alias("n"), F.concat(F.lit("<F>"), F.concat_ws(" ", *(F.col(k).cast("string") for k in "abc")), F.lit("</F>")).alias("line"))
    return frame.unionByName(p).unionByName(f)


def write_surface(lines: DataFrame, path: str) -> None:
    """The lines in order, in files whose names sort in that order."""
    lines.repartitionByRange("part", "n").sortWithinPartitions("part", "n").select("line").write.text(path)


def surface_points(lines: DataFrame) -> DataFrame:
    """(vid, x, y, z) of the P elements of LandXML lines; elements may share a line."""
    each = lines.select(F.explode(F.regexp_extract_all("line", F.lit('<P id="[^"]*"[^>]*>[^<]*</P>'), F.lit(0))).alias("p"))
    v = F.split(F.trim(F.regexp_extract("p", ">([^<]*)<", 1)), r"\s+")
    return each.select(F.regexp_extract("p", 'id="([^"]*)"', 1).cast("long").alias("vid"), v[1].cast("double").alias("x"), v[0].cast("double").alias("y"), v[2].cast("double").alias("z"))


def surface_faces(lines: DataFrame) -> DataFrame:
    """(a, b, c) of the F elements with three points; others are no triangles and drop out."""
    each = lines.select(F.explode(F.regexp_extract_all("line", F.lit("<F(?: [^>]*)?>[^<]*</F>"), F.lit(0))).alias("f"))
    v = F.split(F.trim(F.regexp_extract("f", ">([^<]*)<", 1)), r"\s+")
    return each.select(v.alias("v")).where(F.size("v") == 3).select(*(F.col("v")[i].cast("long").alias(k) for i, k in enumerate("abc")))


def world_file(spark: SparkSession, path: str) -> DataFrame:
    """(path, a, d, b, e, c, f) of six-line world files; others are refused with nulls."""
    t = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.filter(F.split("value", r"\s+"), lambda x: x != "").alias("v"))
    return t.select("path", *(F.when(F.size("v") == 6, F.expr(f"try_cast(v[{i}] as double)")).alias(k) for i, k in enumerate(("a", "d", "b", "e", "c", "f"))))


def pixel_to_plan(px: Column, line: Column, affine: dict[str, float], pixel_is_area: bool = True) -> tuple[Column, Column]:
    """Plan place of a raster node; an area's node is its middle."""
    u, v = (px + 0.5, line + 0.5) if pixel_is_area else (px, line)
    return affine["c"] + affine["a"] * u + affine["b"] * v, affine["f"] + affine["d"] * u + affine["e"] * v


def report_lines(table: DataFrame, columns: list[str], order: str) -> DataFrame:
    """(n, line) of a table as CSV, the header first; cells are strings already."""
    cells = [X.csv_field(F.col(c)) for c in columns]
    head = table.sparkSession.createDataFrame([(-1, ",".join(columns))], "n long, line string")
    return head.unionByName(table.select(F.col(order).cast("long").alias("n"), F.concat_ws(",", *cells).alias("line")))


def write_plan(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """(key, action): what to create, keep, replace or delete, by key and fingerprint."""
    e = existing.select(F.col("key"), F.col("fingerprint").alias("old"))
    both = wanted.select("key", "fingerprint").join(e, "key", "full_outer")
    action = F.when(F.col("old").isNull(), "create").when(F.col("fingerprint").isNull(), "delete").when(F.col("fingerprint") == F.col("old"), "keep").otherwise("replace")
    return both.select("key", action.alias("action"))


def fingerprints(values: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, fingerprint): XXH64 (seed 0) of each row's doubles, little-endian, as 16 hex digits."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for f in frames:
            raw = f[columns].to_numpy("<f8")
            yield pd.DataFrame({key: f[key], "fingerprint": [xxhash.xxh64_hexdigest(r.tobytes()) for r in raw]})

    return values.select(key, *columns).mapInPandas(run, f"{key} {values.schema[key].dataType.simpleString()}, fingerprint string")
