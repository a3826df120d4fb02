"""Column expressions of the cell, edge and route algebra; all stay inside whole-stage codegen."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The eight neighbour steps (dx, dy) of a cell.
STEPS = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]
INF = float("inf")


def altitude(dem: Column, agl: Column) -> Column:
    return dem + agl


def usable_time_s(energy_wh: Column, reserve_wh: Column, power_w: Column) -> Column:
    """Seconds of flight above the reserve; infinite without an energy model."""
    return F.coalesce(3600.0 * (energy_wh - F.coalesce(reserve_wh, F.lit(0.0))) / power_w, F.lit(INF))


def edge_clearance(agl: Column, excess: Column) -> Column:
    """Height above the terrain profile of an edge; minus infinity where the profile is unknown or not finite."""
    return F.when(excess.isNull(), agl).when(F.isnan(excess) | (F.abs(excess) == INF), F.lit(-INF)).otherwise(agl - excess)


def layer_mean(first: Column, middle: Column, last: Column, dtype: str) -> Column:
    """Mean of five samples along an edge (the middle cell three times), in the layer's own precision."""
    total = first + middle + middle + middle + last
    return (total / 5).cast(dtype).cast("double")


def step_length(dx_m: Column, dy_m: Column) -> Column:
    return F.sqrt(dx_m * dx_m + dy_m * dy_m)


def wind_parts(dx_m: Column, dy_m: Column, d: Column, dz_m: Column, u: Column, v: Column) -> dict[str, Column]:
    """Wind along and across an edge of length ``d``, and its slope."""
    tx, ty = dx_m / d, dy_m / d
    return {"along": u * tx + v * ty, "across": u * ty - v * tx, "slope": dz_m / d}


def speed_discriminant(along: Column, across: Column, slope: Column, v_air: Column) -> Column:
    """Negative where the airspeed cannot hold the track."""
    b = -2.0 * along
    return b * b - 4.0 * (1.0 + slope * slope) * (along * along + across * across - v_air * v_air)


def ground_speed(along: Column, slope: Column, disc: Column) -> Column:
    """Speed over the ground at the discriminant; an edge is flown only where it is positive."""
    return (2.0 * along + F.sqrt(disc)) / (2.0 * (1.0 + slope * slope))


def turn_radius(hx: Column, hy: Column, dx: Column, dy: Column, resolution: Column) -> Column:
    """Radius of the turn between two steps: the shorter step over twice the sine of half the angle."""
    l1, l2 = F.sqrt((hx * hx + hy * hy).cast("double")), F.sqrt((dx * dx + dy * dy).cast("double"))
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (hx * dx + hy * dy) / (l1 * l2)))
    half = F.sqrt(F.greatest((1.0 - cosine) / 2.0, F.lit(0.0)))
    return F.when((l1 == 0) | (l2 == 0) | (half <= 1e-12), F.lit(INF)).otherwise(F.least(l1, l2) * resolution / (2.0 * half))


def turn_feasible(radius: Column, limit: Column) -> Column:
    return limit.isNull() | (radius + 1e-12 >= limit)


def wind_speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def wind_direction(u: Column, v: Column) -> Column:
    """Degrees, 0 to the north and 90 to the east."""
    return F.pmod(F.degrees(F.atan2(u, v)) + 360.0, F.lit(360.0))


def gaussian_density(x: Column, y: Column, x0: Column, y0: Column, sigma: Column) -> Column:
    return F.exp(-((x - x0) * (x - x0) + (y - y0) * (y - y0)) / (2.0 * sigma * sigma))


def ndvi(nir: Column, red: Column) -> Column:
    return F.when(nir + red == 0, F.lit(0.0)).otherwise((nir - red) / (nir + red))


def grayscale(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def noisy_or(geometry: Column, texture: Column, alpha: float = 0.9, beta: float = 0.6) -> Column:
    return 1.0 - (1.0 - alpha * geometry) * (1.0 - beta * texture)


def navigation_density(visual: Column, terrain: Column) -> Column:
    return F.greatest(visual, terrain)


def clip(c: Column, low, high) -> Column:
    return F.least(F.greatest(c, F.lit(low) if not isinstance(low, Column) else low), F.lit(high) if not isinstance(high, Column) else high)


def stretch(c: Column, low: Column, high: Column) -> Column:
    """Clip to [low, high] and scale to [0, 1]; 0 where both are equal."""
    return F.when(low == high, F.lit(0.0)).otherwise((F.least(F.greatest(c, low), high) - low) / (high - low))


def to_uint8(c: Column, low: Column, high: Column) -> Column:
    return F.floor(255.0 * stretch(c, low, high)).cast("int")


def point_to_cell(p: Column, low: Column, high: Column, n: Column) -> Column:
    """Index of the cell that holds a coordinate, clipped to the grid."""
    return F.greatest(F.lit(0), F.least(n - 1, ((p - low) * n / (high - low)).cast("int")))


def cell_centre(index: Column, low: Column, high: Column, n: Column) -> Column:
    return low + (index + 0.5) * (high - low) / n


def reflect(i: Column, n: Column) -> Column:
    """Index inside [0, n) under half-sample reflection at both ends."""
    k = F.pmod(i, 2 * n)
    return F.when(k >= n, 2 * n - 1 - k).otherwise(k)


def weakly_dominates(a: list[Column], b: list[Column]) -> Column:
    return reduce(lambda p, q: p & q, [x <= y for x, y in zip(a, b)])


def dominates(a: list[Column], b: list[Column]) -> Column:
    """No worse in any objective and better in one; no tolerance."""
    return weakly_dominates(a, b) & reduce(lambda p, q: p | q, [x < y for x, y in zip(a, b)])


def seconds_text(c: Column) -> Column:
    return F.format_string("%.2f s", c)


def vector_text(cols: list[Column]) -> Column:
    return F.format_string("(" + ", ".join(["%.3f"] * len(cols)) + ")", *cols)


def parse_cell(text: Column) -> Column:
    """``x,y`` as a struct of integers."""
    parts = F.split(text, ",")
    return F.struct(F.trim(parts[0]).cast("int").alias("x"), F.trim(parts[1]).cast("int").alias("y"))


def simplex_weights(parts: int = 4) -> list[tuple[float, float, float]]:
    """All weight vectors with components in multiples of 1/parts that sum to one."""
    return [(i / parts, j / parts, (parts - i - j) / parts) for i in range(parts + 1) for j in range(parts + 1 - i)]


def turn_table(resolution: float) -> dict[tuple[int, int, int, int], float]:
    """Radius of each of the 64 turns between neighbour steps."""
    out = {}
    for hx, hy in STEPS:
        for dx, dy in STEPS:
            l1, l2 = math.hypot(hx, hy), math.hypot(dx, dy)
            half = math.sqrt(max(0.0, (1.0 - max(-1.0, min(1.0, (hx * dx + hy * dy) / (l1 * l2)))) / 2.0))
            out[hx, hy, dx, dy] = INF if half <= 1e-12 else min(l1, l2) * resolution / (2.0 * half)
    return out
