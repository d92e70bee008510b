"""Displacement fields of tiles of 64 by 64 samples, and height images."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolode.operators import spatial

TILE = 64


def encode_tile(samples: np.ndarray) -> bytes:
    """4096 32-bit floats, little-endian, row by row, as a raw deflate stream."""
    if samples.size != TILE * TILE:
        raise ValueError(f"a tile has {TILE * TILE} samples")
    z = zlib.compressobj(1, zlib.DEFLATED, -15)
    return z.compress(np.ascontiguousarray(samples, "<f4").tobytes()) + z.flush()


def decode_tile(payload: bytes) -> np.ndarray:
    raw = zlib.decompress(payload, -15)
    if len(raw) < TILE * TILE * 4:
        raise ValueError("the tile's payload is cut short")
    return np.frombuffer(raw[: TILE * TILE * 4], "<f4")


def tiles(samples: DataFrame) -> DataFrame:
    """(ti, tj, payload) of samples (gi, gj, value); tiles of zeros only are left out, of equal places the greatest value counts."""
    s = samples.groupBy("gi", "gj").agg(F.max(F.col("value").cast("float")).alias("value")).where("value != 0")
    s = s.withColumns({"ti": F.floor(F.col("gi") / TILE), "tj": F.floor(F.col("gj") / TILE)})

    def pack(key, rows):
        tile = np.zeros(TILE * TILE, "<f4")
        tile[(rows["gj"] - key[1] * TILE) * TILE + rows["gi"] - key[0] * TILE] = rows["value"]
        return pd.DataFrame({"ti": [key[0]], "tj": [key[1]], "payload": [encode_tile(tile)]})

    return s.groupBy("ti", "tj").applyInPandas(pack, "ti long, tj long, payload binary")


def samples(tiles_: DataFrame) -> DataFrame:
    """(gi, gj, value) of tiles, without zeros."""

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i, j, payload in zip(f["ti"], f["tj"], f["payload"], strict=True):
                v = decode_tile(payload)
                at = np.flatnonzero(v)
                yield pd.DataFrame({"gi": i * TILE + at % TILE, "gj": j * TILE + at // TILE, "value": v[at]})

    return tiles_.mapInPandas(unpack, "gi long, gj long, value float")


def sampled(field: DataFrame, points: DataFrame, cell: float) -> DataFrame:
    """(pid, v): bilinear between samples (gi, gj, value) at whole multiples of the cell; absent ones are 0."""
    u, w = F.col("x") / cell, F.col("y") / cell
    p = points.select("pid", F.floor(u).alias("i"), F.floor(w).alias("j"), (u - F.floor(u)).alias("fu"), (w - F.floor(w)).alias("fw"))
    k = lambda a, b: (F.col("fu") if a else 1 - F.col("fu")) * (F.col("fw") if b else 1 - F.col("fw"))
    q = p.select("pid", F.explode(F.array(*[F.struct((F.col("i") + a).alias("gi"), (F.col("j") + b).alias("gj"), k(a, b).alias("k")) for a in (0, 1) for b in (0, 1)])).alias("n")).select("pid", "n.*")
    hit = spatial.spread(q).join(spatial.spread(field.select("gi", "gj", F.col("value").cast("double").alias("value"))), ["gi", "gj"]).groupBy("pid").agg(F.sum(F.col("k") * F.col("value")).alias("v"))
    return spatial.spread(points.select("pid")).join(spatial.spread(hit), "pid", "left").select("pid", F.coalesce("v", F.lit(0.0)).alias("v"))


def resampled(field: DataFrame, cell: float, new_cell: float) -> DataFrame:
    """(gi, gj, value) on another cell, over the extent of the samples that are not 0 and a cell around it."""
    e = field.where("value != 0").agg(*(f(k).alias(f"{k}{i}") for k in ("gi", "gj") for i, f in enumerate((F.min, F.max))))
    steps = lambda k: F.sequence(F.floor((F.col(f"{k}0") - 1) * cell / new_cell).cast("long"), F.ceil((F.col(f"{k}1") + 1) * cell / new_cell).cast("long"))
    g = e.where("gi0 is not null").select(F.explode(steps("gi")).alias("gi"), steps("gj").alias("js")).select("gi", F.explode("js").alias("gj"))
    p = g.select(F.struct("gi", "gj").alias("pid"), (F.col("gi") * new_cell).alias("x"), (F.col("gj") * new_cell).alias("y"))
    return sampled(field, p, cell).select("pid.gi", "pid.gj", F.col("v").cast("float").alias("value")).where("value != 0")


def image_sampled(image: DataFrame, points: DataFrame, width: int, height: int, repeat: bool = False) -> DataFrame:
    """(pid, v): bilinear in an image (col, row, v) at places (pid, s, t) of 0 to 1, t upwards; beyond the edge it repeats or its border goes on."""
    x, y = F.col("s") * width - 0.5, (1 - F.col("t")) * height - 0.5
    p = points.select("pid", F.floor(x).alias("i"), F.floor(y).alias("j"), (x - F.floor(x)).alias("fu"), (y - F.floor(y)).alias("fw"))
    wrap = lambda c, n: F.pmod(c, F.lit(n)) if repeat else F.least(F.greatest(c, F.lit(0)), F.lit(n - 1))
    k = lambda a, b: (F.col("fu") if a else 1 - F.col("fu")) * (F.col("fw") if b else 1 - F.col("fw"))
    q = p.select("pid", F.explode(F.array(*[F.struct(wrap(F.col("i") + a, width).alias("col"), wrap(F.col("j") + b, height).alias("row"), k(a, b).alias("k")) for a in (0, 1) for b in (0, 1)])).alias("n")).select("pid", "n.*")
    return q.join(image.select("col", "row", "v"), ["col", "row"]).groupBy("pid").agg(F.sum(F.col("k") * F.col("v")).alias("v"))
