"""Text in and out: slopes as people write them, report numbers, colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from geolode.functions import geometry as G

#: Steepest slope that may be typed, in degrees.
MAX_DEGREES = 89.9
_NUMBER = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)"


def parse_slope(text: Column, unit: str) -> Column:
    """Ratio of ``a:b``, of a number with a unit (%, ‰, °), or of a bare one in the display unit; null for anything else.

    In the ratio display a bare n means 1:n, and 0 is flat. Slopes over 89.9 degrees are refused.
    """
    t = F.trim(text)
    pair = rf"^({_NUMBER})\s*:\s*({_NUMBER})$"
    one = rf"^({_NUMBER})\s*(%|‰|°|deg)?$"
    a, b = F.regexp_extract(t, pair, 1), F.regexp_extract(t, pair, 2)
    num = lambda x: F.when(x != "", x.cast("double"))
    v, suffix = num(F.regexp_extract(t, one, 1)), F.regexp_extract(t, one, 2)
    angle = F.when(F.abs(v) <= MAX_DEGREES, F.tan(F.radians(v)))
    bare = F.when(v == 0, 0.0).otherwise(F.try_divide(F.lit(1.0), v)) if unit == "ratio" else angle if unit == "degrees" else G.slope_from(v, unit)
    single = F.when(suffix == "%", v / 100).when(suffix == "‰", v / 1000).when(suffix.isin("°", "deg"), angle).otherwise(bare)
    ratio = F.when(t.rlike(pair), F.try_divide(num(a), num(b))).when(t.rlike(one), single)
    return F.when(F.degrees(F.atan(F.abs(ratio))) <= MAX_DEGREES, ratio)


def nearest_decimal(x: Column, decimals: int) -> Column:
    """The multiple of a power of ten nearest to what ``x`` is in binary, true halves to the even one: as C prints it.

    Java's formatter rounds the shortest decimal that reads back as ``x``, halves up.
    Numbers of 2^43 and more, and what is not finite, stay as they are.
    """
    scale = 10**decimals
    size = F.abs(x)
    whole = F.floor(size)
    f = size - whole
    high = F.floor(f * 2**26) / F.lit(float(2**26))  # both parts times the scale are exact
    below = F.floor(f * scale)
    off = (high * (2 * scale) - (2 * below + 1)) + (f - high) * (2 * scale)
    up = (off > 0) | ((off == 0) & ((whole * scale + below) % 2 == 1))
    near = (whole * scale + below + up.cast("long")) / F.lit(float(scale))
    # Only what lies next to a half is looked at so closely.
    half = F.abs(size * scale - F.floor(size * scale) - 0.5) <= 1e-6 + size * (scale * 1e-14)
    return F.when((size < 2**43) & half, F.when(x < 0, -near).otherwise(near)).otherwise(x)


def format_slope(ratio: Column, unit: str, decimals: int = 1) -> Column:
    """A slope with its unit; ratios as 1:n, flat ones as 0."""
    number = lambda x: F.format_string(f"%.{decimals}f", nearest_decimal(x, decimals))
    if unit == "ratio":
        return F.when(ratio == 0, F.lit("0")).otherwise(F.concat(F.lit("1:"), number(F.try_divide(F.lit(1.0), ratio))))
    return F.concat(number(G.slope_in(ratio, unit)), F.lit({"percent": "%", "promille": "‰", "degrees": "°"}[unit]))


def report_number(x: Column, decimals: int) -> Column:
    """Fixed decimals, halves away from zero, no negative zero; empty for what is not finite."""
    v = F.round(x, decimals)
    return F.when(G.finite(x), F.format_string(f"%.{decimals}f", F.when(v == 0, 0.0).otherwise(v))).otherwise(F.lit(""))


def csv_field(x: Column) -> Column:
    """A field quoted where it must be."""
    return F.when(x.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(x, F.lit("")))


def ramp(t: Column, stops: list[tuple[float, tuple[int, int, int]]]) -> Column:
    """Colour at a place 0 to 1 between stops, as a struct r, g, b of rounded bytes (halves to even)."""
    stops = sorted(stops)
    t = G.clamp(t, stops[0][0], stops[-1][0])

    def channel(i: int) -> Column:
        out = F.lit(float(stops[-1][1][i]))
        for (t0, c0), (t1, c1) in reversed(list(zip(stops, stops[1:], strict=False))):
            out = F.when(t <= t1, F.lit(float(c0[i])) + (t - t0) / (t1 - t0) * (c1[i] - c0[i])).otherwise(out)
        return F.bround(out, 0).cast("int")

    return F.struct(channel(0).alias("r"), channel(1).alias("g"), channel(2).alias("b"))


def category_colour(index: Column, palette: list[str], none: str = "#9e9e9e") -> Column:
    """A palette's colour by index, round and round; a grey for negative ones."""
    return F.when(index < 0, F.lit(none)).otherwise(F.element_at(F.array(*map(F.lit, palette)), (index % len(palette) + 1).cast("int")))


def parse_degrees(text: Column, unit: str) -> Column:
    """Degrees of a typed slope; null for what is none or beyond 89.9."""
    return F.degrees(F.atan(parse_slope(text, unit)))


def display_ratio(value: Column, unit: str) -> Column:
    """Ratio of a number typed in a display unit: n of 1:n in the ratio display (0 is flat); null for what is not finite or steeper than may be typed."""
    ok = G.finite(value)
    if unit == "ratio":
        return F.when(ok, F.when(F.abs(value) <= 1e-12, 0.0).otherwise(F.try_divide(F.lit(1.0), value)))
    if unit == "degrees":
        ok = ok & (F.abs(value) <= MAX_DEGREES)
    return F.when(ok, G.slope_from(value, unit))


def display_number(ratio: Column, unit: str) -> Column:
    """The number that a ratio is shown as; n of 1:n in the ratio display."""
    if unit == "ratio":
        return F.when(F.abs(ratio) <= 1e-12, 0.0).otherwise(F.try_divide(F.lit(1.0), ratio))
    return G.slope_in(ratio, unit)


def ramp_samples(spark, stops: list[tuple[float, tuple[int, int, int]]], n: int):
    """(i, t, r, g, b): a ramp at n evenly spaced places."""
    t = F.col("id") / F.lit(float(max(n - 1, 1)))
    return spark.range(n).select(F.col("id").cast("int").alias("i"), t.alias("t"), ramp(t, stops).alias("c")).select("i", "t", "c.r", "c.g", "c.b")
