"""Rasters from files: TIFF with geographic tags, portable grey maps."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sizes of TIFF field types, and the tags read here.
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d"}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS, COUNTS, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FORMAT = 322, 323, 324, 325, 339
SCALE, TIES, MATRIX, KEYS, NO_DATA = 33550, 33922, 34264, 34735, 42113
RASTER_TYPE, LINEAR_UNIT = 1025, 3076
#: Metres in the linear units by code.
LINEAR_UNITS = {9001: 1.0, 9002: 0.3048, 9003: 1200.0 / 3937.0}


def tiff_tags(raw: bytes) -> dict[int, list]:
    """Values of the first directory's tags (classic TIFF, either byte order); ValueError for anything else."""
    if raw[:4] not in (b"II*\0", b"MM\0*"):
        raise ValueError("no classic TIFF")
    o = "<" if raw[:2] == b"II" else ">"
    (at,) = struct.unpack_from(o + "I", raw, 4)
    (n,) = struct.unpack_from(o + "H", raw, at)
    out = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(o + "HHI", raw, at + 2 + 12 * i)
        code = _TYPES.get(kind)
        if code is None:
            continue
        size = struct.calcsize("=" + code) * count
        where = at + 10 + 12 * i if size <= 4 else struct.unpack_from(o + "I", raw, at + 10 + 12 * i)[0]
        if where + size > len(raw):
            raise ValueError(f"tag {tag} lies beyond the file")
        if code == "s":
            out[tag] = [raw[where : where + size].split(b"\0")[0].decode("latin-1")]
        elif len(code) == 2:
            v = struct.unpack_from(o + code * count, raw, where)
            out[tag] = [a / b if b else float("nan") for a, b in zip(v[::2], v[1::2], strict=True)]
        else:
            out[tag] = list(struct.unpack_from(o + code * count, raw, where))
    return out


def georeference(tags: dict[int, list]) -> tuple | None:
    """(a, d, b, e, c, f, pixel_is_area, metres in a unit or null) from the model tags, None without them."""
    keys = tags.get(KEYS, [])
    key = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    rest = (key.get(RASTER_TYPE, 1) != 2, LINEAR_UNITS.get(key.get(LINEAR_UNIT)))
    if len(m := tags.get(MATRIX, [])) == 16:
        return (m[0], m[4], m[1], m[5], m[3], m[7], *rest)
    s, t = tags.get(SCALE, []), tags.get(TIES, [])
    if len(s) < 2 or len(t) < 6:
        return None
    return (s[0], 0.0, 0.0, -s[1], t[3] - t[0] * s[0], t[4] + t[1] * s[1], *rest)


def _blocks(raw: bytes, tags: dict[int, list]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(column, row, values) of the raster's strips or tiles, first band only."""
    o = "<" if raw[:2] == b"II" else ">"
    width, height, bits, bands = tags[WIDTH][0], tags[HEIGHT][0], tags.get(BITS, [1])[0], tags.get(SAMPLES, [1])[0]
    kind = {1: "u", 2: "i", 3: "f"}[tags.get(FORMAT, [1])[0]]
    how = tags.get(COMPRESSION, [1])[0]
    if how not in (1, 8, 32946) or tags.get(PREDICTOR, [1])[0] not in (1, 2) or bits not in (8, 16, 32, 64):
        raise ValueError(f"compression {how} with {bits} bits is not read")
    if TILE_OFFSETS in tags:
        w, h = tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]
        across = -(-width // w)
        places = [((i % across) * w, (i // across) * h, w, h) for i in range(len(tags[TILE_OFFSETS]))]
        spans = zip(tags[TILE_OFFSETS], tags[TILE_COUNTS], strict=True)
    else:
        h = min(tags.get(ROWS, [height])[0], height)
        places = [(0, i * h, width, min(h, height - i * h)) for i in range(len(tags[STRIPS]))]
        spans = zip(tags[STRIPS], tags[COUNTS], strict=True)
    for (x, y, w, h), (start, size) in zip(places, spans, strict=True):
        data = raw[start : start + size]
        data = data if how == 1 else zlib.decompress(data)
        v = np.frombuffer(data, f"{o}{kind}{bits // 8}", w * h * bands).reshape(h, w, bands)
        if tags.get(PREDICTOR, [1])[0] == 2:
            v = np.cumsum(v, axis=1, dtype=v.dtype)
        yield x, y, v[: height - y, : width - x, 0]


def read_tiff_headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, a, d, b, e, c, f, pixel_is_area, unit, problem) of TIFF files; files that are none stay, with a problem."""
    schema = "path string, width int, height int, a double, d double, b double, e double, c double, f double, pixel_is_area boolean, unit double, problem string"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, raw in zip(frame["path"], frame["content"], strict=True):
                try:
                    tags = tiff_tags(raw)
                    geo = georeference(tags)
                    rows.append((name, tags[WIDTH][0], tags[HEIGHT][0], *(geo or [None] * 8), None if geo else "no georeference"))
                except (ValueError, KeyError, struct.error) as e:
                    rows.append((name, *[None] * 10, str(e)))
            yield pd.DataFrame(rows, columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def read_tiff(spark: SparkSession, path: str, stride: int = 1) -> DataFrame:
    """(path, col, row, v) of the first band's values, every ``stride``-th node each way; no-data values and what is not finite are left out.

    A file is one task; its strips or tiles go out one by one. Files that are no such TIFF give no rows (``read_tiff_headers`` says why).
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, raw in zip(frame["path"], frame["content"], strict=True):
                try:
                    tags = tiff_tags(raw)
                    none = float(tags[NO_DATA][0]) if NO_DATA in tags else None
                    for x, y, v in _blocks(raw, tags):
                        r, c = np.arange(-y % stride, v.shape[0], stride), np.arange(-x % stride, v.shape[1], stride)
                        z = v[np.ix_(r, c)].astype(float)
                        ok = np.isfinite(z) & (True if none is None else z != none)
                        i, j = np.nonzero(ok)
                        yield pd.DataFrame({"path": name, "col": x + c[j], "row": y + r[i], "v": z[ok]})
                except (ValueError, KeyError, struct.error, zlib.error):
                    continue

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, col long, row long, v double")


def read_pgm(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, col, row, v) of portable grey maps (P2, P5), values 0 to 1."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, raw in zip(frame["path"], frame["content"], strict=True):
                words, at = [], 0
                while len(words) < 4 and at < len(raw):
                    if raw[at : at + 1] == b"#":
                        at = raw.find(b"\n", at) % (len(raw) + 1)
                    elif raw[at : at + 1].isspace():
                        at += 1
                    else:
                        end = at
                        while end < len(raw) and not raw[end : end + 1].isspace():
                            end += 1
                        words.append(raw[at:end])
                        at = end
                if len(words) < 4 or words[0] not in (b"P2", b"P5"):
                    continue
                w, h, top = map(int, words[1:])
                v = np.array(raw[at:].split(), float) if words[0] == b"P2" else np.frombuffer(raw, ">u2" if top > 255 else "u1", w * h, at + 1).astype(float)
                k = np.arange(w * h)
                yield pd.DataFrame({"path": name, "width": w, "height": h, "col": k % w, "row": k // w, "v": v[: w * h] / top})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, width int, height int, col long, row long, v double")


def on_rectangle(samples: DataFrame, width: int, height: int, x0: float, y0: float, size_x: float, size_y: float, z: float = 0.0, scale: float = 1.0) -> DataFrame:
    """Raster samples (col, row, v) at their pixels' middles over a level rectangle, the first row at its top; none if fewer than three."""
    if samples.limit(3).count() < 3:
        samples = samples.limit(0)
    u, w = (F.col("col") + 0.5) / width, 1 - (F.col("row") + 0.5) / height
    return samples.select("col", "row", (x0 + u * size_x).alias("x"), (y0 + w * size_y).alias("y"), (z + F.col("v") * scale).alias("z"))


def scaled(affine: dict[str, Column], factor: float) -> dict[str, Column]:
    """An affine map in another unit."""
    return {k: v * factor for k, v in affine.items()}
