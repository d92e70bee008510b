"""Survey data as it comes in: points parsed from a folder of text files, heights kept by cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolode.sources import survey


def point_stream(spark: SparkSession, folder: str, preset: str = "PNEZD", delimiter: str = ",", scale: float = 1.0, offset: float = 0.0, files_at_once: int = 100) -> DataFrame:
    """A stream of parsed rows as ``survey.parse_points`` gives them; lines of a stream have no number of their own, so ``line_number`` is null."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_at_once).text(folder).select(F.lit(None).cast("long").alias("line_number"), F.col("value").alias("line"))
    return survey.parse_points(lines, preset, delimiter, scale, offset)


def cell_heights(points: DataFrame, cell: float) -> DataFrame:
    """(col, row, n, top, low): a running table of a stream's points by cell, for the update or complete mode. Its state is one row a cell."""
    p = points.where("problem is null")
    return p.groupBy(F.floor(F.col("x") / cell).alias("col"), F.floor(F.col("y") / cell).alias("row")).agg(F.count("*").alias("n"), F.max("z").alias("top"), F.min("z").alias("low"))


def event_counts(events: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """(from, to, key, n): events in tumbling windows; those later than ``late`` after the latest seen drop out, and closed windows leave the state."""
    w = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), F.col(key).alias("key")).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("from"), F.col("w.end").alias("to"), "key", "n")
