"""Column expressions for plane and surface geometry; all stay in whole-stage code.

Angles are degrees, slopes ratios of rise to run. A face is ``a, b, c`` with
coordinates in columns ``ax`` .. ``cz``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def cross(ux, uy, vx, vy) -> Column:
    return c(ux) * c(vy) - c(uy) * c(vx)


def orient(ax, ay, bx, by, px, py) -> Column:
    """Twice the signed area of a, b, p."""
    return cross(c(bx) - c(ax), c(by) - c(ay), c(px) - c(ax), c(py) - c(ay))


def lerp(a, b, t) -> Column:
    return c(a) + (c(b) - c(a)) * c(t)


def distance2(ax, ay, bx, by) -> Column:
    return (c(ax) - c(bx)) * (c(ax) - c(bx)) + (c(ay) - c(by)) * (c(ay) - c(by))


def distance3_2(ax, ay, az, bx, by, bz) -> Column:
    return distance2(ax, ay, bx, by) + (c(az) - c(bz)) * (c(az) - c(bz))


def clamp(x, lo, hi) -> Column:
    return F.least(F.greatest(c(x), c(lo)), c(hi))


def segment_parameter(px, py, ax, ay, bx, by) -> Column:
    """Place of a point's foot on a segment, 0 at a, 1 at b; 0 for a segment without length."""
    dx, dy = c(bx) - c(ax), c(by) - c(ay)
    n = dx * dx + dy * dy
    return F.when(n > 0, ((c(px) - c(ax)) * dx + (c(py) - c(ay)) * dy) / n).otherwise(F.lit(0.0))


def segment_parameter_clamped(px, py, ax, ay, bx, by) -> Column:
    return clamp(segment_parameter(px, py, ax, ay, bx, by), 0.0, 1.0)


def segment_distance(px, py, ax, ay, bx, by) -> Column:
    t = segment_parameter_clamped(px, py, ax, ay, bx, by)
    return F.sqrt(distance2(px, py, lerp(ax, bx, t), lerp(ay, by, t)))


def in_segment_box(px, py, ax, ay, bx, by, pad=0.0) -> Column:
    return c(px).between(F.least(c(ax), c(bx)) - pad, F.greatest(c(ax), c(bx)) + pad) & c(py).between(F.least(c(ay), c(by)) - pad, F.greatest(c(ay), c(by)) + pad)


def segments_cross_strictly(ax, ay, bx, by, px, py, qx, qy) -> Column:
    """Whether ab and pq cross at inner points of both."""
    d1, d2 = orient(ax, ay, bx, by, px, py), orient(ax, ay, bx, by, qx, qy)
    d3, d4 = orient(px, py, qx, qy, ax, ay), orient(px, py, qx, qy, bx, by)
    return (d1 * d2 < 0) & (d3 * d4 < 0)


def segments_touch(ax, ay, bx, by, px, py, qx, qy) -> Column:
    """Whether ab and pq share a point, ends included."""
    d1, d2 = orient(ax, ay, bx, by, px, py), orient(ax, ay, bx, by, qx, qy)
    d3, d4 = orient(px, py, qx, qy, ax, ay), orient(px, py, qx, qy, bx, by)
    apart = (F.signum(d1) * F.signum(d2) <= 0) & (F.signum(d3) * F.signum(d4) <= 0)
    boxes = (F.greatest(c(ax), c(bx)) >= F.least(c(px), c(qx))) & (F.greatest(c(px), c(qx)) >= F.least(c(ax), c(bx)))
    boxes = boxes & (F.greatest(c(ay), c(by)) >= F.least(c(py), c(qy))) & (F.greatest(c(py), c(qy)) >= F.least(c(ay), c(by)))
    return apart & boxes


def ray_crosses(px, py, ax, ay, bx, by) -> Column:
    """Whether a ray to the right of the point crosses an edge (half open, so that corners count once)."""
    spans = (c(by) > c(py)) != (c(ay) > c(py))
    return F.when(spans, c(px) < (c(ax) - c(bx)) * (c(py) - c(by)) / (c(ay) - c(by)) + c(bx)).otherwise(F.lit(False))


def in_triangle(px, py, ax="ax", ay="ay", bx="bx", by="by", cx="cx", cy="cy") -> Column:
    """Point in triangle, border included, either winding."""
    d1, d2, d3 = orient(ax, ay, bx, by, px, py), orient(bx, by, cx, cy, px, py), orient(cx, cy, ax, ay, px, py)
    return ~(((d1 < 0) | (d2 < 0) | (d3 < 0)) & ((d1 > 0) | (d2 > 0) | (d3 > 0)))


def plane_height(px, py) -> Column:
    """Height of the face's plane at a point, by barycentric weights; null for a face without plan area."""
    whole = orient("ax", "ay", "bx", "by", "cx", "cy")
    wa, wb = orient("bx", "by", "cx", "cy", px, py), orient("cx", "cy", "ax", "ay", px, py)
    return F.when(whole != 0, (wa * F.col("az") + wb * F.col("bz") + (whole - wa - wb) * F.col("cz")) / whole)


def normal() -> tuple[Column, Column, Column]:
    """Normal of a face, of the length of twice its area."""
    ux, uy, uz = (F.col(f"b{k}") - F.col(f"a{k}") for k in "xyz")
    vx, vy, vz = (F.col(f"c{k}") - F.col(f"a{k}") for k in "xyz")
    return uy * vz - uz * vy, uz * vx - ux * vz, ux * vy - uy * vx


def surface_area() -> Column:
    nx, ny, nz = normal()
    return F.sqrt(nx * nx + ny * ny + nz * nz) / 2


def plan_area() -> Column:
    return F.abs(normal()[2]) / 2


def slope_ratio() -> Column:
    """Rise over run of a face; infinite where it is vertical."""
    nx, ny, nz = normal()
    return F.when(F.abs(nz) < 1e-12, F.lit(INF)).otherwise(F.sqrt(nx * nx + ny * ny) / F.abs(nz))


def slope_in(ratio, unit: str) -> Column:
    """A slope ratio as ``ratio``, ``percent``, ``promille`` or ``degrees``."""
    r = c(ratio)
    return {"ratio": r, "percent": r * 100, "promille": r * 1000, "degrees": F.degrees(F.atan(r))}[unit]


def slope_from(value, unit: str) -> Column:
    v = c(value)
    return {"ratio": v, "percent": v / 100, "promille": v / 1000, "degrees": F.tan(F.radians(v))}[unit]


def finite(x) -> Column:
    return ~F.isnan(c(x)) & (F.abs(c(x)) < INF)


def bearing(flat_ratio: float = 0.0, north: float = 90.0) -> Column:
    """Direction in which a face falls, clockwise from north; null where it is flat."""
    nx, ny, nz = normal()
    up = F.when(nz < 0, -1.0).otherwise(1.0)
    hx, hy = nx * up, ny * up
    flat = (hx * hx + hy * hy == 0) | ((nz != 0) & (slope_ratio() <= flat_ratio))
    turned = F.pmod(F.lit(north) - F.degrees(F.atan2(hy, hx)), F.lit(360.0))
    return F.when(~flat, F.when(turned >= 360.0, 0.0).otherwise(turned))


SECTORS = ["N", "NE", "E", "SE", "S", "SW", "W", "NW"]


def sector(b) -> Column:
    """Nearest of the eight compass names; halves go to the even neighbour, and null has none (``element_at`` alone may take it for -1)."""
    return F.when(c(b).isNotNull(), F.element_at(F.array(*map(F.lit, SECTORS)), (F.pmod(F.bround(c(b) / 45, 0).cast("int"), F.lit(8)) + 1).cast("int")))


def nice_step(x) -> Column:
    """The least of 1, 2, 5, 10 times a power of ten that is no less than ``x``; 1 for what is not positive."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(c(x))))
    lead = c(x) / power
    step = F.when(lead <= 1, 1.0).when(lead <= 2, 2.0).when(lead <= 5, 5.0).otherwise(10.0) * power
    return F.when((c(x) > 0) & finite(x), step).otherwise(F.lit(1.0))


def normalized(x, lo, hi) -> Column:
    return F.when(c(hi) > c(lo), clamp((c(x) - c(lo)) / (c(hi) - c(lo)), 0.0, 1.0)).otherwise(F.lit(0.0))


def smoothstep(u) -> Column:
    u = clamp(u, 0.0, 1.0)
    return u * u * (3 - 2 * u)


def falloff(kind: str, d) -> Column:
    """Brush weight at a share ``d`` of the radius."""
    t = 1 - c(d)
    inside = {"smooth": t * t * (3 - 2 * t), "linear": t, "sharp": t * t, "constant": F.lit(1.0)}[kind]
    edge = F.when(c(d) > 1, 0.0).otherwise(1.0) if kind == "constant" else F.lit(0.0)
    return F.when(c(d) >= 1, edge).otherwise(inside)


def mean_curvature(p, q, r, s, t) -> Column:
    """Of a height field with first derivatives p, q and second r, s, t; convex is positive."""
    p, q, r, s, t = map(c, (p, q, r, s, t))
    w = 1 + p * p + q * q
    return -((1 + q * q) * r - 2 * p * q * s + (1 + p * p) * t) / (2 * w * F.sqrt(w))


def gaussian_curvature(p, q, r, s, t) -> Column:
    p, q, r, s, t = map(c, (p, q, r, s, t))
    w = 1 + p * p + q * q
    return (r * t - s * s) / (w * w)


def principal_curvatures(p, q, r, s, t) -> tuple[Column, Column]:
    h = mean_curvature(p, q, r, s, t)
    root = F.sqrt(F.greatest(F.lit(0.0), h * h - gaussian_curvature(p, q, r, s, t)))
    return h + root, h - root


def profile_curvature(p, q, r, s, t) -> Column:
    """Along the line of fall; the mean one where there is none."""
    pc, qc, rc, sc, tc = map(c, (p, q, r, s, t))
    g = pc * pc + qc * qc
    w = 1 + g
    return F.when(g < 1e-12, mean_curvature(p, q, r, s, t)).otherwise(-(pc * pc * rc + 2 * pc * qc * sc + qc * qc * tc) / (g * w * F.sqrt(w)))


def plan_curvature(p, q, r, s, t) -> Column:
    """Across the line of fall, so that it and the profile one average to the mean."""
    return 2 * mean_curvature(p, q, r, s, t) - profile_curvature(p, q, r, s, t)


def curvature_threshold(tolerance, length) -> Column:
    return 8 * c(tolerance) / (c(length) * c(length))


def route_unit_cost(ratio, limit, distance=1.0, steepness=1.0, earthworks=1.0) -> Column:
    """Price of a unit of length at a grade: distance, grade up to the limit, earthworks beyond it."""
    r = c(ratio) / c(limit)
    over = F.greatest(F.lit(0.0), r - 1)
    capped = F.least(r, F.lit(1.0))
    return c(distance) + c(steepness) * capped * capped + c(earthworks) * (2 * over + 4 * over * over)


def datum(lo, step) -> Column:
    """A round level below the lowest."""
    return F.floor(c(lo) / c(step)) * c(step) - c(step)


def to_local(x, y, ox, oy, degrees) -> tuple[Column, Column]:
    a = F.radians(c(degrees))
    dx, dy = c(x) - c(ox), c(y) - c(oy)
    return dx * F.cos(a) + dy * F.sin(a), dy * F.cos(a) - dx * F.sin(a)


def to_world(u, v, ox, oy, degrees) -> tuple[Column, Column]:
    a = F.radians(c(degrees))
    return c(ox) + c(u) * F.cos(a) - c(v) * F.sin(a), c(oy) + c(u) * F.sin(a) + c(v) * F.cos(a)


#: Metres in a unit.
UNITS = {"m": 1.0, "mm": 0.001, "cm": 0.01, "km": 1000.0, "ft": 0.3048, "us-ft": 1200.0 / 3937.0, "in": 0.0254}


def convert(x, source: str, target: str, power: int = 1) -> Column:
    """Lengths (power 1), areas (2), volumes (3) and inverse areas (-2) between units."""
    return c(x) * float((UNITS[source] / UNITS[target]) ** power)


def linear_cut_fill(area, da, db, dc) -> tuple[Column, Column]:
    """Fill and cut (both at least 0) over a triangle on which the difference new - old is linear."""
    area, da, db, dc = map(c, (area, da, db, dc))
    total = area * (da + db + dc) / 3
    one_sign = ((da >= 0) & (db >= 0) & (dc >= 0)) | ((da <= 0) & (db <= 0) & (dc <= 0))

    def corner(lone, o1, o2):
        return area * lone * lone * lone / (3 * (lone - o1) * (lone - o2))

    # The corner whose sign is its own; zeros count with the other two.
    lone_a = ((da > 0) & (db <= 0) & (dc <= 0)) | ((da < 0) & (db >= 0) & (dc >= 0))
    lone_b = ((db > 0) & (da <= 0) & (dc <= 0)) | ((db < 0) & (da >= 0) & (dc >= 0))
    tip = F.when(lone_a, corner(da, db, dc)).when(lone_b, corner(db, da, dc)).otherwise(corner(dc, da, db))
    rest = total - tip
    zero = F.lit(0.0)
    fill = F.when(one_sign, F.greatest(total, zero)).otherwise(F.greatest(tip, zero) + F.greatest(rest, zero))
    cut = F.when(one_sign, F.greatest(-total, zero)).otherwise(F.greatest(-tip, zero) + F.greatest(-rest, zero))
    return fill, cut


def settled(x) -> Column:
    """Eight decimals and no negative zero: what a sum's order and the last bits of functions do not reach."""
    return F.round(c(x), 8) + F.lit(0.0)


def to_drawing(station, elevation, ox, oy, level, exaggeration) -> tuple[Column, Column]:
    """Place of a station and height in a section's drawing."""
    return c(ox) + c(station), c(oy) + (c(elevation) - c(level)) * c(exaggeration)


def from_drawing(x, y, ox, oy, level, exaggeration) -> tuple[Column, Column]:
    return c(x) - c(ox), c(level) + (c(y) - c(oy)) / c(exaggeration)


def readable(x) -> Column:
    """The nearest, by ratio, of 1, 2, 2.5, 5, 10 times a power of ten; 0 for what is not positive."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(c(x))))
    lead = c(x) / power
    best = F.array_min(F.array(*[F.struct(F.abs(F.log(lead / k)).alias("off"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate((1.0, 2.0, 2.5, 5.0, 10.0))]))
    return F.when((c(x) > 0) & finite(x), best["k"] * power).otherwise(F.lit(0.0))


def landform_size(width, height) -> Column:
    """A readable tenth of a site's shorter side, which counts as a fiftieth of the longer at least."""
    w, h = F.abs(c(width)), F.abs(c(height))
    longer = F.greatest(w, h)
    return F.when(longer > 0, readable(F.greatest(F.least(w, h), longer / 50) * 0.1)).otherwise(F.lit(0.0))


#: Relative step of a 32-bit coordinate.
FLOAT_STEP = 1.0 / 8_388_608


def safe_distance(tolerance: float) -> float:
    """Greatest coordinate at which 32-bit rounding stays within a tenth of a tolerance."""
    return tolerance * 0.1 / FLOAT_STEP if tolerance > 0 else INF
