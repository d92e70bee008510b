"""Value ranges of an analysis: weighted histograms, percentiles, auto ranges, bands, ticks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geolode.functions import geometry as G

BINS = 2048
MAX_BANDS = 64


def extent(values: DataFrame) -> DataFrame:
    """One row (lo, hi, total) of rows (v, w) with finite values and positive finite weights."""
    ok = values.where(G.finite("v") & G.finite("w") & (F.col("w") > 0))
    return ok.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("w").alias("total"))


def histogram(values: DataFrame, bins: int = BINS) -> DataFrame:
    """(bin, weight) over the observed extent; the greatest value is the last bin's start."""
    ok = values.where(G.finite("v") & G.finite("w") & (F.col("w") > 0))
    span = F.col("hi") - F.col("lo")
    at = F.when(span > 0, F.floor((F.col("v") - F.col("lo")) / span * (bins - 1))).otherwise(F.lit(0))
    return ok.join(F.broadcast(extent(values)), how="cross").groupBy(at.cast("int").alias("bin"), "lo", "hi").agg(F.sum("w").alias("weight"))


def percentiles(values: DataFrame, fractions: list[float], bins: int = BINS) -> DataFrame:
    """(fraction, value): inside the bin where the cumulative weight reaches the fraction, by the weight's share.

    The histogram has ``bins`` rows at most, so one window over it is bounded.
    """
    h = histogram(values, bins)
    w = Window.orderBy("bin")
    h = h.withColumns({"upto": F.sum("weight").over(w), "total": F.sum("weight").over(Window.partitionBy())})
    f = values.sparkSession.createDataFrame([(float(x),) for x in fractions], "fraction double")
    target = F.col("fraction") * F.col("total")
    hit = h.join(F.broadcast(f), F.col("upto") >= target)
    first = hit.groupBy("fraction").agg(F.min_by(F.struct("bin", "weight", "upto", "total", "lo", "hi"), "bin").alias("b"))
    inside = F.col("b.bin") + (F.col("fraction") * F.col("b.total") - (F.col("b.upto") - F.col("b.weight"))) / F.col("b.weight")
    value = F.col("b.lo") + inside / (bins - 1) * (F.col("b.hi") - F.col("b.lo"))
    return first.select("fraction", F.least(value, F.col("b.hi")).alias("value"))


def nice(x: float) -> float:
    """The least of 1, 2, 5, 10 times a power of ten that is no less than ``x``; 1 for what is not positive."""
    if not x > 0 or not math.isfinite(x):
        return 1.0
    power = 10.0 ** math.floor(math.log10(x))
    return next((k for k in (1.0, 2.0, 5.0) if x / power <= k), 10.0) * power


def snapped(lo: float, hi: float, shape: str = "plain") -> tuple[float, float]:
    """A range widened to round steps. Shapes: ``plain``, ``from_zero``, ``symmetric``."""

    def shaped(a: float, b: float) -> tuple[float, float]:
        if shape == "from_zero":
            return min(a, 0.0), max(b, 0.0)
        if shape == "symmetric":
            m = max(abs(a), abs(b))
            return -m, m
        return a, b

    lo, hi = shaped(lo, hi)
    if not hi > lo:
        return (-1.0, 1.0) if shape == "symmetric" else (lo, lo + 1)
    step = nice((hi - lo) / 8)
    return shaped(math.floor(lo / step) * step, math.ceil(hi / step) * step)


def auto_range(values: DataFrame, shape: str = "plain") -> DataFrame:
    """(lo, hi) for display: 2 % of the weight off each end, then snapped outward; bearings are always 0 to 360.

    One row, and the last step of an aggregate: it is worked out once and then a constant for what follows.
    """
    spark = values.sparkSession
    if shape == "cyclic":
        return spark.createDataFrame([(0.0, 360.0)], "lo double, hi double")
    p = percentiles(values, [0.02, 0.98]).agg(F.max(F.when(F.col("fraction") < 0.5, F.col("value"))).alias("p02"), F.max(F.when(F.col("fraction") > 0.5, F.col("value"))).alias("p98"))
    found = p.join(F.broadcast(extent(values)), how="cross").select(F.when(F.col("p98") > F.col("p02"), F.col("p02")).otherwise(F.col("lo")).alias("lo"), F.when(F.col("p98") > F.col("p02"), F.col("p98")).otherwise(F.col("hi")).alias("hi")).first()
    if found is None or found.lo is None:
        return spark.createDataFrame([(-1.0 if shape == "symmetric" else 0.0, 1.0)], "lo double, hi double")
    return spark.createDataFrame([snapped(found.lo, found.hi, shape)], "lo double, hi double")


def bands(range_: DataFrame, interval: float | None = None) -> DataFrame:
    """(band, low, high): half-open steps over a range (lo, hi); at most 64, by doubling the interval; the last ends at hi."""
    span = F.col("hi") - F.col("lo")
    step = F.lit(interval) if interval else G.nice_step(span / 8)
    count = F.greatest(F.lit(1), F.ceil(span / step - 1e-9))
    doublings = F.when(count > MAX_BANDS, F.ceil(F.log2(count / MAX_BANDS) - 1e-12)).otherwise(F.lit(0))
    r = range_.select("lo", "hi", (step * F.pow(F.lit(2.0), doublings)).alias("step"))
    r = r.withColumn("n", F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo")) / F.col("step") - 1e-9)).cast("int"))
    r = r.withColumn("band", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    low = F.col("lo") + F.col("band") * F.col("step")
    return r.select("band", low.alias("low"), F.when(F.col("band") == F.col("n") - 1, F.col("hi")).otherwise(low + F.col("step")).alias("high"))


def band_weights(values: DataFrame, bands_: DataFrame) -> DataFrame:
    """(band, n, weight): values outside the range count with its end bands."""
    b = bands_.agg(F.min("low").alias("lo"), F.max("high").alias("hi"), F.max("band").alias("last"), F.max(F.when(F.col("band") == 0, F.col("high") - F.col("low"))).alias("step"))
    at = F.greatest(F.lit(0), F.least(F.col("last"), F.floor((F.col("v") - F.col("lo")) / F.col("step")))).cast("int")
    return values.where(G.finite("v")).join(F.broadcast(b), how="cross").groupBy(at.alias("band")).agg(F.count("*").alias("n"), F.sum("w").alias("weight"))


def ticks(range_: DataFrame) -> DataFrame:
    """(tick): about five round values inside a range, 13 at most."""
    step = G.nice_step((F.col("hi") - F.col("lo")) / 5)
    r = range_.where("hi > lo").select("lo", "hi", step.alias("step"))
    first, last = F.ceil(F.col("lo") / F.col("step") - 1e-9).cast("long"), F.floor(F.col("hi") / F.col("step") + 1e-9).cast("long")
    return r.where(last >= first).select(F.explode(F.sequence(first, F.least(last, first + 12))).alias("k"), "step").select((F.col("k") * F.col("step")).alias("tick"))


def bars(values: DataFrame, n: int, bins: int = BINS) -> DataFrame:
    """(bar, height): the histogram in ``n`` bars, the tallest 1."""
    h = histogram(values, bins).groupBy(F.least(F.lit(n - 1), F.floor(F.col("bin") * n / bins)).cast("int").alias("bar")).agg(F.sum("weight").alias("w"))
    return h.select("bar", (F.col("w") / F.max("w").over(Window.partitionBy())).alias("height"))
