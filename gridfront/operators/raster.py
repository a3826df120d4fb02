"""Raster operators: pooling, patches, focal windows, percentiles, interpolation, zones, landing sites.

A raster is a relation of cells ``case_id, x, y, value``. Focal windows are separable: a pass down
the columns, then one along the rows, each a window function over a line of cells that is padded by
reflected rows; no cell meets more than a line's neighbours and nothing is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridfront.functions import scalars as S
from gridfront.operators.ordering import quantiles


def sized(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the grid's ``width`` and ``height``."""
    size = cells.groupBy(*keys).agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    return cells.join(size, keys) if keys else cells.join(F.broadcast(size))  # one row without keys


def mean_pool(cells: DataFrame, k: int, columns: list[str], keys: list[str]) -> DataFrame:
    """Means of complete k-by-k blocks."""
    blocks = cells.groupBy(*keys, F.floor(F.col("x") / k).cast("int").alias("x"), F.floor(F.col("y") / k).cast("int").alias("y"))
    return blocks.agg(*[F.avg(c).alias(c) for c in columns], F.count("*").alias("_n")).filter(F.col("_n") == k * k).drop("_n")


def upscale(cells: DataFrame, k: int) -> DataFrame:
    """Every cell repeated k by k times."""
    reps = F.sequence(F.lit(0), F.lit(k - 1))
    out = cells.withColumn("_i", F.explode(reps)).withColumn("_j", F.explode(reps))
    return out.withColumn("x", F.col("x") * k + F.col("_i")).withColumn("y", F.col("y") * k + F.col("_j")).drop("_i", "_j")


def patch_grid(pixels: DataFrame, cell_m: float, pixel_m: float, keys: list[str], strict_zero: bool = True) -> DataFrame:
    """Pixels ``px, py, value`` with their patch ``cell_x, cell_y``; incomplete patches go, and under
    ``strict_zero`` a patch whose sum is not positive (or not a number) becomes zero throughout."""
    k = int(cell_m // pixel_m)
    if k <= 0:
        raise ValueError("a cell must be at least a pixel wide")
    p = pixels.withColumn("cell_x", F.floor(F.col("px") / k).cast("int")).withColumn("cell_y", F.floor(F.col("py") / k).cast("int"))
    w = Window.partitionBy(*keys, "cell_x", "cell_y")
    p = p.withColumn("_n", F.count("*").over(w)).withColumn("_s", F.sum("value").over(w)).filter(F.col("_n") == k * k)
    if strict_zero:
        p = p.withColumn("value", F.when((F.col("_s") > 0) & ~F.isnan("_s"), F.col("value")).otherwise(F.lit(0.0)))
    return p.drop("_n", "_s")


def mosaic(patches: DataFrame, width: int, height: int) -> DataFrame:
    """Patches as one picture: pixels ``px, py`` of the patches ``cell_x, cell_y`` get their place ``x, y`` in it.

    A pixel outside its patch's ``width`` by ``height`` is an error when the row is read.
    """
    inside = F.col("px").between(0, width - 1) & F.col("py").between(0, height - 1)
    place = lambda cell, size, at: F.when(inside, F.col(cell) * size + F.col(at)).otherwise(F.raise_error("a pixel lies outside its patch").cast("int"))
    rest = [c for c in patches.columns if c not in ("cell_x", "cell_y", "px", "py")]
    return patches.select(place("cell_x", width, "px").alias("x"), place("cell_y", height, "py").alias("y"), *rest)


def slope(cells: DataFrame, value: str, resolution: float, keys: list[str]) -> DataFrame:
    """Adds ``slope``: central differences inside, one-sided at the border."""

    def gradient(axis: str, other: str) -> Column:
        w = Window.partitionBy(*keys, other).orderBy(axis)
        back, ahead = F.lag(value).over(w), F.lead(value).over(w)
        inner = (ahead - back) / (2.0 * resolution)
        return F.coalesce(inner, (ahead - F.col(value)) / resolution, (F.col(value) - back) / resolution, F.lit(0.0))

    out = cells.withColumn("_gx", gradient("x", "y")).withColumn("_gy", gradient("y", "x"))
    return out.withColumn("slope", F.sqrt(F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy"))).drop("_gx", "_gy")


def padded(cells: DataFrame, axis: str, size: str, reach: int) -> DataFrame:
    """Each cell at its own place and at every reflected place within ``reach`` of the border."""
    n = F.col(size)
    places = F.filter(F.sequence(F.lit(-reach), n - 1 + reach), lambda p: S.reflect(p, n) == F.col(axis))
    small = F.filter(F.array(F.col(axis), -1 - F.col(axis), 2 * n - 1 - F.col(axis)), lambda p: (p >= -reach) & (p < n + reach))
    return cells.withColumn("_p", F.explode(F.when(n >= reach, small).otherwise(places)))


def focal(cells: DataFrame, value: str, size: int, keys: list[str]) -> DataFrame:
    """Adds ``mean, mean_sq, lo, hi`` over the size-by-size window with reflected borders."""
    reach = size // 2
    c = sized(cells, keys).withColumn("_v", F.col(value).cast("double"))
    frame = lambda *by: Window.partitionBy(*by).orderBy("_p").rowsBetween(-reach, reach)
    wy = frame(*keys, "x")
    d = padded(c, "y", "height", reach)
    d = d.select("*", F.sum("_v").over(wy).alias("_s"), F.sum(F.col("_v") * F.col("_v")).over(wy).alias("_q"), F.min("_v").over(wy).alias("_lo"), F.max("_v").over(wy).alias("_hi")).filter("_p = y")
    wx = frame(*keys, "y")
    d = padded(d.drop("_p"), "x", "width", reach)
    area = float(size * size)
    d = d.select("*", (F.sum("_s").over(wx) / area).alias("mean"), (F.sum("_q").over(wx) / area).alias("mean_sq"), F.min("_lo").over(wx).alias("lo"), F.max("_hi").over(wx).alias("hi")).filter("_p = x")
    return d.select(*cells.columns, "mean", "mean_sq", "lo", "hi")


def terrain_metrics(cells: DataFrame, value: str, resolution: float, keys: list[str], size: int = 7) -> DataFrame:
    """Adds ``slope, tri, tpi, std, roughness``."""
    d = slope(focal(cells, value, size, keys), value, resolution, keys)
    v = F.col(value)
    zero = F.lit(0.0)
    return d.select(*cells.columns, "slope", F.sqrt(F.greatest(F.col("mean_sq") - 2 * v * F.col("mean") + v * v, zero)).alias("tri"), (v - F.col("mean")).alias("tpi"), F.sqrt(F.greatest(F.col("mean_sq") - F.col("mean") * F.col("mean"), zero)).alias("std"), (F.col("hi") - F.col("lo")).alias("roughness"))


def robust_normalize(rows: DataFrame, columns: list[str], keys: list[str], low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Replaces each column by its position between two percentiles of its group, clipped to [0, 1]."""
    bounds = quantiles(rows, keys, columns, (low, high)).withColumnsRenamed({f"_{c}": f"_b_{c}" for c in columns})
    r = rows.join(bounds, keys) if keys else rows.join(F.broadcast(bounds))  # one row without keys
    for c in columns:
        r = r.withColumn(c, S.stretch(F.col(c), F.col(f"_b_{c}")[0], F.col(f"_b_{c}")[1]))
    return r.drop(*[f"_b_{c}" for c in columns])


#: Weights of the terrain components.
TERRAIN_WEIGHTS = {"slope": 0.25, "tri": 0.25, "tpi": 0.15, "std": 0.20, "roughness": 0.15}


def terrain_quality(pixels: DataFrame, value: str, resolution: float, keys: list[str], cell: list[str], size: int = 7) -> DataFrame:
    """Quality of each cell of pixels: weighted normalised components, averaged, normalised over the grid."""
    parts = robust_normalize(terrain_metrics(pixels, value, resolution, [*keys, *cell], size), list(TERRAIN_WEIGHTS), [*keys, *cell])
    total = sum((w * F.col(c) for c, w in TERRAIN_WEIGHTS.items()), F.lit(0.0))
    return robust_normalize(parts.groupBy(*keys, *cell).agg(F.avg(total).alias("quality")), ["quality"], keys)


def bilinear(points: DataFrame, cells: DataFrame, value: str, keys: list[str], id_: list[str]) -> DataFrame:
    """Finite-aware bilinear samples at ``px, py`` (cell units, clamped): weights of missing corners are renormalised."""
    size = cells.groupBy(*keys).agg((F.max("x") + 1).alias("_w"), (F.max("y") + 1).alias("_h"))
    p = points.join(size, keys)
    x, y = S.clip(F.col("px"), 0.0, F.col("_w") - 1.0), S.clip(F.col("py"), 0.0, F.col("_h") - 1.0)
    p = p.select(*points.columns, "_w", "_h", x.alias("_x"), y.alias("_y")).withColumns({"_x0": F.floor("_x").cast("int"), "_y0": F.floor("_y").cast("int")})
    fx, fy = F.col("_x") - F.col("_x0"), F.col("_y") - F.col("_y0")
    corner = lambda ox, oy, w: F.struct(F.least(F.col("_x0") + ox, F.col("_w") - 1).cast("int").alias("x"), F.least(F.col("_y0") + oy, F.col("_h") - 1).cast("int").alias("y"), w.alias("w"))
    p = p.withColumn("_c", F.explode(F.array(corner(0, 0, (1 - fx) * (1 - fy)), corner(1, 0, fx * (1 - fy)), corner(0, 1, (1 - fx) * fy), corner(1, 1, fx * fy))))
    p = p.filter("_c.w > 0").select(*points.columns, F.col("_c.x").alias("x"), F.col("_c.y").alias("y"), F.col("_c.w").alias("w"))
    v = cells.select(*keys, "x", "y", F.col(value).cast("double").alias("_v")).filter(~F.isnan("_v") & (F.abs("_v") < S.INF))
    s = p.join(v, [*keys, "x", "y"], "left")
    good = F.when(F.col("_v").isNotNull(), F.col("w"))
    return s.groupBy(*keys, *id_).agg((F.sum(F.col("w") * F.col("_v")) / F.sum(good)).alias("sample"))


def edge_profiles(fine: DataFrame, centres: DataFrame, patch: int, keys: list[str]) -> DataFrame:
    """``x, y, dx, dy, excess_m``: how far the fine terrain rises above the straight line between cell centres.

    ``fine`` has ``x, y, value`` in fine cells, ``centres`` ``x, y, height`` in planner cells.
    """
    half = (patch - 1) / 2.0
    steps = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in S.STEPS])).alias("s")
    e = centres.select(*keys, "x", "y", F.col("height").alias("h0"), steps).select(*keys, "x", "y", "h0", "s.*")
    far = centres.select(*keys, F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("height").alias("h1"))
    e = e.withColumns({"_x": F.col("x") + F.col("dx"), "_y": F.col("y") + F.col("dy")}).join(far, [*keys, "_x", "_y"]).drop("_x", "_y")
    n = F.ceil(F.sqrt((F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).cast("double")) * patch).cast("int")
    e = e.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n")))).withColumn("t", F.col("i") / F.col("n"))
    pts = e.select(*keys, "x", "y", "dx", "dy", "i", "t", "h0", "h1", (F.col("x") * patch + half + F.col("t") * F.col("dx") * patch).alias("px"), (F.col("y") * patch + half + F.col("t") * F.col("dy") * patch).alias("py"))
    s = bilinear(pts.withColumnsRenamed({"x": "ex", "y": "ey"}), fine, "value", keys, ["ex", "ey", "dx", "dy", "i", "t", "h0", "h1"])
    gap = F.col("sample") - (F.col("h0") + F.col("t") * (F.col("h1") - F.col("h0")))
    return s.groupBy(*keys, F.col("ex").alias("x"), F.col("ey").alias("y"), "dx", "dy").agg(F.coalesce(F.max(gap), F.lit(S.INF)).alias("excess_m"))


def smoke_visibility(points: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """``density`` and ``visibility`` at points under Gaussian plumes; points without plumes are clear.

    Plumes are few (at most 10,000, checked), and meet the points as one array, so the plan does not grow with them.
    """
    rows = sources.select("x0", "y0", "sigma", "min_vis").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("at most 10,000 plumes are taken")
    if not rows:
        return points.select(*keys, F.lit(0.0).alias("density"), F.lit(1.0).alias("visibility"))
    plumes = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for v, n in zip(r, ("x0", "y0", "sigma", "min_vis"))]) for r in sorted(tuple(r) for r in rows)])
    met = F.transform(plumes, lambda p: F.struct(S.gaussian_density(F.col("px"), F.col("py"), p.x0, p.y0, p.sigma).alias("d"), p.min_vis.alias("m")))
    clear = F.aggregate("met", F.lit(1.0), lambda a, p: a * (1.0 - p.d))
    seen = F.aggregate("met", F.lit(1.0), lambda a, p: a * (1.0 - (1.0 - p.m) * p.d))
    return points.select(*keys, met.alias("met")).select(*keys, (1.0 - clear).alias("density"), seen.alias("visibility"))


def rings_of(zones: list[list[tuple[float, float]]]) -> Column:
    """Polygons as one array: each with its bounds and its sides."""
    number = lambda n, v: F.lit(float(v)).alias(n)
    out = []
    for ring in zones:
        closed = ring if ring[0] == ring[-1] else [*ring, ring[0]]
        sides = [F.struct(number("ax", a[0]), number("ay", a[1]), number("bx", b[0]), number("by", b[1])) for a, b in zip(closed[:-1], closed[1:])]
        xs, ys = zip(*closed)
        out.append(F.struct(number("x0", min(xs)), number("x1", max(xs)), number("y0", min(ys)), number("y1", max(ys)), F.array(*sides).alias("sides")))
    return F.array(*out)


def ring_touches_box(ring: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether a polygon's ring meets a closed box: a side crosses or touches it, or it lies inside the ring."""

    def crosses(s: Column) -> Column:
        side = [(s.bx - s.ax) * (y - s.ay) - (s.by - s.ay) * (x - s.ax) for x in (x0, x1) for y in (y0, y1)]
        near = (x0 <= F.greatest(s.ax, s.bx)) & (x1 >= F.least(s.ax, s.bx)) & (y0 <= F.greatest(s.ay, s.by)) & (y1 >= F.least(s.ay, s.by))
        return near & (F.greatest(*side) >= 0) & (F.least(*side) <= 0)

    def right_of(s: Column) -> Column:
        cx, cy = (x0 + x1) / 2, (y0 + y1) / 2
        level = (s.ay != s.by) & (cy >= F.least(s.ay, s.by)) & (cy < F.greatest(s.ay, s.by))
        return F.when(level, (cx < s.ax + (cy - s.ay) * (s.bx - s.ax) / F.nullif(s.by - s.ay, F.lit(0.0))).cast("int")).otherwise(0)

    bounds = (x0 <= ring.x1) & (x1 >= ring.x0) & (y0 <= ring.y1) & (y1 >= ring.y0)
    inside = F.aggregate(ring.sides, F.lit(0), lambda n, s: n + right_of(s)) % 2 == 1
    return bounds & (F.exists(ring.sides, crosses) | inside)


def in_zones(cells: DataFrame, zones: list[list[tuple[float, float]]], extent: tuple[float, float, float, float], keys: list[str]) -> DataFrame:
    """Adds ``in_zone``: whether any polygon touches the cell; ``extent`` is (xmin, xmax, ymin, ymax), row 0 in the north.

    The polygons are one array of constants (a list on the driver to begin with); a cell looks at a polygon's sides
    only where it meets its bounds, and the plan does not grow with them.
    """
    c = sized(cells, keys)
    if not zones:
        return c.withColumn("in_zone", F.lit(False)).drop("width", "height")
    xmin, xmax, ymin, ymax = extent
    w, h = (xmax - xmin) / F.col("width"), (ymax - ymin) / F.col("height")
    box = {"_x0": xmin + F.col("x") * w, "_y0": ymax - (F.col("y") + 1) * h, "_x1": xmin + (F.col("x") + 1) * w, "_y1": ymax - F.col("y") * h}
    hit = F.exists(rings_of(zones), lambda r: ring_touches_box(r, *map(F.col, box)))
    return c.withColumns(box).withColumn("in_zone", hit).drop("width", "height", *box)


def landing_candidates(cells: DataFrame, resolution: float, keys: list[str], min_visibility: float = 0.7, max_slope: float = 0.05) -> DataFrame:
    """Free, visible and flat cells, with their slope."""
    return slope(cells, "dem", resolution, keys).filter(~F.col("occ") & (F.col("vis") >= min_visibility) & (F.col("slope") <= max_slope))


def landing_sites(cells: DataFrame, resolution: float, start: tuple[int, int], goal: tuple[int, int], keys: list[str], sites: int = 10, min_visibility: float = 0.7, max_slope: float = 0.05, corridor_m: float | None = None) -> DataFrame:
    """The best candidate of each band of progress along the corridor from start to goal."""
    dx, dy = (goal[0] - start[0]) * resolution, (goal[1] - start[1]) * resolution
    length = (dx * dx + dy * dy) ** 0.5
    if sites < 1 or length == 0:
        raise ValueError("there must be a site and a way to go")
    ux, uy = dx / length, dy / length
    corridor = max(3.0 * resolution, 0.2 * length) if corridor_m is None else corridor_m
    c = landing_candidates(cells, resolution, keys, min_visibility, max_slope)
    rx, ry = (F.col("x") - start[0]) * resolution, (F.col("y") - start[1]) * resolution
    c = c.withColumn("along", rx * ux + ry * uy).withColumn("off", F.abs(rx * uy - ry * ux))
    c = c.filter(F.col("along").between(0.0, length) & (F.col("off") <= corridor)).withColumn("progress", F.col("along") / length)
    c = c.withColumn("band", F.least((F.col("progress") * sites).cast("int"), F.lit(sites - 1)))
    order = Window.partitionBy(*keys, "band").orderBy(F.col("vis").desc(), "slope", F.round("off", 9), F.round(F.abs(F.col("progress") - (F.col("band") + 0.5) / sites), 9), "y", "x")
    return c.withColumn("_r", F.row_number().over(order)).filter("_r = 1").select(*keys, "band", "x", "y", "vis", "slope")


def cell_coordinates(cells: DataFrame, extent: tuple[float, float, float, float], keys: list[str]) -> DataFrame:
    """Centres of cells in the extent (xmin, xmax, ymin, ymax)."""
    xmin, xmax, ymin, ymax = (F.lit(float(v)) for v in extent)
    c = sized(cells, keys)
    return c.select(*keys, "x", "y", S.cell_centre(F.col("x"), xmin, xmax, F.col("width")).alias("east"), (ymax - (F.col("y") + 0.5) * (ymax - ymin) / F.col("height")).alias("north"))
