"""From aligned pixel tables to a planner map: patches, qualities, wind, visibility, zones, landing sites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfront.functions import scalars as S
from gridfront.operators import imagery, raster
from gridfront.operators.paths import checkpointed
from gridfront.sources import maps

CASE = ["case_id"]


def patches(pixels: DataFrame, cell_m: float, pixel_m: float) -> DataFrame:
    """Pixels with their patch ``cx, cy`` and place ``x, y`` inside it."""
    k = int(cell_m // pixel_m)
    p = raster.patch_grid(pixels, cell_m, pixel_m, CASE)
    return p.select("case_id", F.col("cell_x").alias("cx"), F.col("cell_y").alias("cy"), (F.col("px") % k).alias("x"), (F.col("py") % k).alias("y"), "value")


def build(grey: DataFrame, dem: DataFrame, wind: DataFrame, extent: tuple[float, float, float, float], cell_m: float, pixel_m: float, no_fly: list | None = None, low_visibility: list | None = None, zone_visibility: float = 0.35, plumes: DataFrame | None = None) -> DataFrame:
    """``cells`` with ``dem_max, phi_vis, phi_ter`` beside the planner's layers.

    ``grey`` and ``dem`` are pixel tables ``case_id, px, py, value`` on one grid; ``wind`` has the
    cells' ``u, v``. Visibility comes from zones, from plumes, or is clear; not from both.
    """
    if low_visibility and plumes is not None:
        raise ValueError("visibility comes from zones or from plumes")
    if not 0 <= zone_visibility <= 1:
        raise ValueError("zone_visibility must lie in [0, 1]")
    k = int(cell_m // pixel_m)
    d = patches(dem, cell_m, pixel_m)
    keys = [*CASE, "cx", "cy"]
    half = (k - 1) / 2.0
    near = (F.abs(F.col("x") - half) < 1) & (F.abs(F.col("y") - half) < 1)  # the pixels around the centre weigh alike
    heights = d.groupBy(*keys).agg(F.avg(F.when(near & ~F.isnan("value"), F.col("value"))).alias("dem"), F.max(F.when(~F.isnan("value"), F.col("value"))).alias("dem_max"))
    terrain = raster.terrain_quality(d, "value", pixel_m, CASE, ["cx", "cy"]).withColumnRenamed("quality", "phi_ter")
    g = patches(grey, cell_m, pixel_m).select(*keys, F.col("x").alias("px"), F.col("y").alias("py"), F.col("value").alias("grey"))
    visual = imagery.visual_richness(g, keys, CASE).select(*keys, F.col("richness").alias("phi_vis"))
    c = heights.join(terrain, keys).join(visual, keys).withColumnsRenamed({"cx": "x", "cy": "y"}).join(wind, ["case_id", "x", "y"])
    c = c.withColumn("nav", S.navigation_density(F.col("phi_vis"), F.col("phi_ter"))).withColumn("vis", F.lit(1.0))
    if low_visibility:
        c = raster.in_zones(c, low_visibility, extent, CASE).withColumn("vis", F.when(F.col("in_zone"), zone_visibility).otherwise(1.0)).drop("in_zone")
    if plumes is not None:
        at = raster.cell_coordinates(c, extent, CASE).select("case_id", "x", "y", F.col("east").alias("px"), F.col("north").alias("py"))
        c = c.drop("vis").join(raster.smoke_visibility(at, plumes, ["case_id", "x", "y"]).withColumnRenamed("visibility", "vis").drop("density"), ["case_id", "x", "y"])
    c = raster.in_zones(c, no_fly, extent, CASE).withColumnRenamed("in_zone", "occ") if no_fly else c.withColumn("occ", F.lit(False))
    return c.select("case_id", "x", "y", "dem", "dem_max", "phi_vis", "phi_ter", "nav", "vis", "u", "v", "occ")


def validate_options(battery_wh: float, reserve_wh: float, power_w: float, agl_m: float, clearance_m: float | None, sites: int) -> None:
    """The energy, clearance and landing options of a planner map."""
    if battery_wh <= 0:
        raise ValueError("battery_wh must be positive")
    if not 0 <= reserve_wh < battery_wh:
        raise ValueError("reserve_wh must not be negative and be less than battery_wh")
    if power_w <= 0:
        raise ValueError("power_w must be positive")
    if agl_m < 0:
        raise ValueError("agl_m must not be negative")
    if clearance_m is not None and not 0 <= clearance_m <= agl_m:
        raise ValueError("clearance_m must lie between 0 and agl_m")
    if sites < 1:
        raise ValueError("there must be a landing site")


def planner_map(grey: DataFrame, dem: DataFrame, wind: DataFrame, points: DataFrame, extent: tuple[float, float, float, float], cell_m: float, pixel_m: float, no_fly: list | None = None, low_visibility: list | None = None, zone_visibility: float | None = None, plumes: DataFrame | None = None, sites: int = 10, battery_wh: float = 300.0, reserve_wh: float = 40.0, power_w: float = 450.0, agl_m: float = 120.0, clearance_m: float | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A runnable map from pixels and mission points: ``cells, params, excess, provenance``.

    ``points`` has ``role, x, y`` (``files.points``) with a start and a goal. Cells keep both sources of the
    navigation density; ``excess`` is the terrain profile of every edge; landing sites lie along the mission.
    """
    if low_visibility and zone_visibility is None:
        raise ValueError("zones need zone_visibility")
    if low_visibility is not None and not low_visibility:
        raise ValueError("there are no zones")
    validate_options(battery_wh, reserve_wh, power_w, agl_m, clearance_m, sites)
    ends = {r.role: (r.x, r.y) for r in points.filter(F.col("role").isin("start", "goal")).groupBy("role").agg(F.min_by("x", "id").alias("x"), F.min_by("y", "id").alias("y")).collect()}
    if missing := {"start", "goal"} - set(ends):
        raise ValueError(f"the mission points lack {' and '.join(sorted(missing))}")
    cells = checkpointed(build(grey, dem, wind, extent, cell_m, pixel_m, no_fly, low_visibility, 1.0 if zone_visibility is None else zone_visibility, plumes).withColumnsRenamed({"phi_vis": "visual_richness", "phi_ter": "rugosity"}))
    size = cells.agg(F.first("case_id").alias("case_id"), (F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h")).first()
    xmin, xmax, ymin, ymax = extent
    clip = lambda v, n: max(0, min(n - 1, int(v)))
    start, goal = ((clip((x - xmin) * size.w / (xmax - xmin), size.w), clip((ymax - y) * size.h / (ymax - ymin), size.h)) for x, y in (ends["start"], ends["goal"]))
    k = int(cell_m // pixel_m)
    fine = raster.patch_grid(dem, cell_m, pixel_m, CASE).select("case_id", F.col("px").alias("x"), F.col("py").alias("y"), "value")
    excess = raster.edge_profiles(fine, cells.select("case_id", "x", "y", F.col("dem").alias("height")), k, CASE)
    found = raster.landing_sites(cells, cell_m, start, goal, CASE, sites).agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("sites"))
    row = (size.case_id, size.w, size.h, float(cell_m), start, goal, 15.0, 12.0, 0.1, None, None, agl_m, clearance_m, battery_wh, reserve_wh, power_w, None, None)
    params = cells.sparkSession.createDataFrame([row], maps.PARAMS).drop("sites").join(F.broadcast(found))  # one row each
    source = "zones" if low_visibility else "synthetic_smoke" if plumes is not None else "clear"
    made = cells.sparkSession.createDataFrame([(size.case_id, source, zone_visibility, list(map(float, extent)), sites)], "case_id string, visibility_source string, visibility_zone_value double, extent array<double>, max_landing_sites int")
    return cells, params, excess, made


def previews(pixels: DataFrame, cell_m: float, pixel_m: float, size: int) -> DataFrame:
    """``case_id, cx, cy, preview``: each patch resampled to size by size and stretched to bytes, missing values at the median."""
    p = patches(pixels, cell_m, pixel_m)
    k = int(cell_m // pixel_m)
    bounds = p.groupBy(*CASE).agg(F.percentile(F.when(~F.isnan("value"), F.col("value")), [0.02, 0.5, 0.98]).alias("b"))
    step = (k - 1) / (size - 1) if size > 1 else 0.0
    grid = p.select(*CASE, "cx", "cy").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    keys = [*CASE, "cx", "cy"]
    s = raster.bilinear(grid.select(*keys, "i", "j", (F.col("i") * step).alias("px"), (F.col("j") * step).alias("py")), p, "value", keys, ["i", "j"]).join(bounds, CASE)
    v = S.to_uint8(F.coalesce("sample", F.col("b")[1]), F.col("b")[0], F.col("b")[2])
    return s.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "i", v.alias("v")))), lambda q: q["v"]).alias("preview"))
