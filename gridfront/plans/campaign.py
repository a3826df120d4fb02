"""Scenario campaigns: weather, vehicle and ablation as dimension tables, cases as their product."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfront.functions import scalars as S
from gridfront.operators import decision, edges, pareto, search
from gridfront.operators.paths import checkpointed
from gridfront.sources import files, maps

#: Weather (name, wind, share of the wind limit, visibility factor).
WEATHER = [("calm_clear", "calm", 0.0, 1.0), ("headwind_clear", "headwind", 0.65, 1.0), ("crosswind_clear", "crosswind", 0.65, 1.0), ("moderate_degradation", "crosswind", 0.25, 0.6), ("severe_degradation", "headwind", 0.35, 0.25)]
#: Vehicles and their turn radius in metres.
VEHICLES = [("multirotor", 0.0), ("fixed_wing_vtol", 40.0)]
#: Ablations of the navigation density and the layer that each one takes instead.
ABLATED = {"visual_only": "visual_richness", "terrain_only": "rugosity"}
ABLATIONS = ("full", *ABLATED)
OBJECTIVES = ["f1", "f2", "f3"]
FAMILIES = ("lake", "foggy_valley", "terrain", "realistic")


def matrix(spark: SparkSession, families: tuple[str, ...] = FAMILIES, variants: int = 30) -> DataFrame:
    """One row a case; the weather cycles with the variant. Built by explosions of small literals."""
    d = spark.range(1).select(F.explode(F.array(*map(F.lit, families))).alias("family"))
    d = d.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))))
    sky = F.array(*[F.struct(F.lit(n).alias("weather"), F.lit(k).alias("wind"), F.lit(s).alias("speed_fraction"), F.lit(f).alias("visibility_factor")) for n, k, s, f in WEATHER])
    d = d.select("*", F.element_at(sky, F.col("variant") % len(WEATHER) + 1).alias("w")).select("family", "variant", "w.*")
    d = d.withColumn("v", F.explode(F.array(*[F.struct(F.lit(n).alias("vehicle"), F.lit(r).alias("min_turn_radius_m")) for n, r in VEHICLES]))).select("*", "v.*").drop("v")
    return d.withColumn("case_id", F.format_string("synthetic_%s_%02d_%s_%s", "family", "variant", "weather", "vehicle"))


def apply_weather(cells: DataFrame, params: DataFrame) -> DataFrame:
    """Cells under the weather columns of ``params`` (``wind, speed_fraction, visibility_factor``).

    The wind's direction follows from start and goal; its speed stays below nine tenths of the limit.
    """
    p = params.select("case_id", "start", "goal", "v_max", "wind", "speed_fraction", "visibility_factor")
    hx, hy = (F.col("goal.x") - F.col("start.x")).cast("double"), -(F.col("goal.y") - F.col("start.y")).cast("double")
    n = F.greatest(F.sqrt(hx * hx + hy * hy), F.lit(1e-12))
    toward = lambda a, b: F.when(F.col("wind") == "headwind", -a / n).when(F.col("wind") == "crosswind", b / n).otherwise(0.0)
    c = cells.join(p, "case_id")
    push = F.col("speed_fraction") * F.col("v_max")
    c = c.withColumns({"u": F.col("u").cast("double") + toward(hx, -hy) * push, "v": F.col("v").cast("double") + toward(hy, hx) * push})
    scale = F.least(F.lit(1.0), 0.9 * F.col("v_max") / F.greatest(S.wind_speed(F.col("u"), F.col("v")), F.lit(1e-12)))
    kind = dict(cells.dtypes)["vis"]
    return c.withColumns({"u": F.col("u") * scale, "v": F.col("v") * scale, "vis": S.clip(F.col("vis") * F.col("visibility_factor").cast(kind), 0.0, 1.0).cast(kind)}).select(*cells.columns)


def apply_vehicle(params: DataFrame, vehicle: str) -> DataFrame:
    """Parameters with the turn radius of a vehicle; an unknown vehicle is an error."""
    radius = dict(VEHICLES).get(vehicle)
    if radius is None:
        raise ValueError(f"{vehicle} is not a vehicle")
    return params.withColumn("min_turn_radius_m", F.lit(radius))


def apply_ablation(cells: DataFrame, mode: str) -> DataFrame:
    """Navigation density of one source layer (``visual_richness`` or ``rugosity``); without the layer an error."""
    if mode == "full":
        return cells
    layer = ABLATED.get(mode)
    if layer is None or layer not in cells.columns:
        raise ValueError(f"{mode} needs its source layer")
    return cells.withColumn("nav", F.col(layer))


def scaled(cells: DataFrame, params: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """A case on a grid k times as fine."""
    from gridfront.operators.raster import upscale

    if k < 1 or int(k) != k:
        raise ValueError("the scale must be a positive integer")
    move = lambda c: F.struct((F.col(f"{c}.x") * k).alias("x"), (F.col(f"{c}.y") * k).alias("y"))
    p = params.withColumns({"resolution_m": F.col("resolution_m") / k, "start": move("start"), "goal": move("goal"), "width": F.col("width") * k, "height": F.col("height") * k})
    sites = F.expr(f"flatten(flatten(transform(sites, s -> transform(sequence(0, {k - 1}), i -> transform(sequence(0, {k - 1}), j -> named_struct('x', s.x * {k} + i, 'y', s.y * {k} + j))))))")
    return upscale(cells, k), p.withColumn("sites", sites)


def synthetic(spark: SparkSession, cases: DataFrame, seed: int = 2026) -> tuple[DataFrame, DataFrame]:
    """Cells and parameters of every case of ``matrix``; the terrain family draws a map a variant."""
    import numpy as np

    rng = np.random.default_rng(seed)
    wanted = []
    for r in cases.select("family", "variant").distinct().orderBy("family", "variant").collect():  # maps, not rows
        wanted.append((r.family, int(rng.integers(0, 2**31)) if r.family == "terrain" else None, f"{r.family}:{r.variant}"))
    cells, params = maps.relation(spark, wanted, double=True)
    own = cases.withColumn("_k", F.concat_ws(":", "family", "variant"))
    full = own.drop("min_turn_radius_m").join(params.drop("min_turn_radius_m").withColumnRenamed("case_id", "_k"), "_k").join(own.select("case_id", "min_turn_radius_m"), "case_id").drop("_k")
    every = own.select("case_id", "_k").join(cells.withColumnRenamed("case_id", "_k"), "_k").drop("_k")
    return apply_weather(every, full), full


def aoi_matrix(missions: DataFrame, vehicles: list[tuple] = VEHICLES, weather: list[tuple] = WEATHER, ablations: tuple[str, ...] = ("full",)) -> DataFrame:
    """One row a case of real areas: every mission of ``files.aoi_manifest`` under every weather, vehicle and ablation."""
    sky = F.array(*[F.struct(F.lit(n).alias("weather"), F.lit(k).alias("wind"), F.lit(s).alias("speed_fraction"), F.lit(f).alias("visibility_factor")) for n, k, s, f in weather])
    craft = F.array(*[F.struct(F.lit(n).alias("vehicle"), F.lit(r).alias("min_turn_radius_m")) for n, r in vehicles])
    d = missions.select("*", F.inline(sky)).select("*", F.inline(craft)).select("*", F.explode(F.array(*map(F.lit, ablations))).alias("navigation_model"))
    return d.select(F.format_string("real_%s_%s_%s_%s_%s", "aoi", "mission", "weather", "vehicle", "navigation_model").alias("case_id"), "*", F.lit("real_aoi").alias("case_kind"), F.lit(1).alias("grid_scale"))


def real_aoi(spark: SparkSession, manifest: str, vehicles: list[tuple] = VEHICLES, weather: list[tuple] = WEATHER, ablations: tuple[str, ...] = ("full",)) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """``cases, cells, params, excess`` of the manifest's areas; archives are named from the manifest's folder.

    A case whose ablation needs a layer that its area's archive lacks is left out.
    """
    missions = files.aoi_manifest(spark, manifest)
    cells = params = excess = None
    layers: dict[str, set[str]] = {}
    for r in missions.select("aoi", "archive").distinct().orderBy("aoi").collect():  # the manifest's five areas
        at = r.archive if r.archive.startswith("/") or "://" in r.archive else f"{manifest.rsplit('/', 1)[0]}/{r.archive}"
        c, p, e = maps.archive(spark, at, r.aoi, (0, 0), (0, 0))
        layers[r.aoi] = set(c.columns)
        cells, params = (c, p) if cells is None else (cells.unionByName(c, allowMissingColumns=True), params.unionByName(p))
        excess = e if excess is None else excess if e is None else excess.unionByName(e)
    cases = aoi_matrix(missions, vehicles, weather, ablations)
    fit = [(F.col("aoi") == a) & F.col("navigation_model").isin(["full", *[m for m, layer in ABLATED.items() if layer in have]]) for a, have in layers.items()]
    cases = cases.filter(reduce(lambda x, y: x | y, fit))
    own = cases.select("case_id", "aoi", "start", "goal", "wind", "speed_fraction", "visibility_factor", "min_turn_radius_m", "navigation_model")
    full = own.join(params.drop("start", "goal", "min_turn_radius_m").withColumnRenamed("case_id", "aoi"), "aoi")
    every = own.select("case_id", "aoi", "navigation_model").join(cells.withColumnRenamed("case_id", "aoi"), "aoi")
    nav = F.col("nav")
    for mode, layer in ABLATED.items():
        if layer in cells.columns:
            nav = F.when(F.col("navigation_model") == mode, F.col(layer)).otherwise(nav)
    every = every.withColumn("nav", nav).select("case_id", *[c for c in cells.columns if c not in ("case_id", *ABLATED.values())])
    if excess is not None:
        excess = own.select("case_id", "aoi").join(excess.withColumnRenamed("case_id", "aoi"), "aoi").drop("aoi")
    return cases, apply_weather(every, full), full.select("case_id", *[c for c in params.columns if c != "case_id"], "wind", "speed_fraction", "visibility_factor"), excess


def summarised(runs: DataFrame, baseline: str = "time_only") -> DataFrame:
    """The summary of runs: counters, measures, coverage of each method, and each profile's choice against the baseline's."""
    solutions = search.routes_of(runs).withColumnRenamed("case_id", "scenario")
    methods = sorted(r.method for r in runs.select("method").distinct().collect())
    rows = pareto.summary_rows(solutions, runs.withColumnRenamed("case_id", "scenario").drop("solutions"), OBJECTIVES, methods)
    names = {"f1": "f1", "f2": "f2", "f3": "f3", "time_premium": "time_premium_vs_time_only", "nav_improvement": "nav_improvement_vs_time_only", "visibility_improvement": "visibility_improvement_vs_time_only"}
    picks = decision.premiums(solutions, OBJECTIVES, baseline, "route_id")
    wide = picks.groupBy("scenario", "method").agg(*[F.first(F.when(F.col("profile") == p, F.col(c)), ignorenulls=True).alias(f"{p}_{n}") for p in decision.PROFILES for c, n in names.items()])
    return rows.join(wide, ["scenario", "method"], "left")


def benchmark(cells: DataFrame, params: DataFrame, methods: tuple[str, ...] = tuple(search.METHODS), excess: DataFrame | None = None, measure_memory: bool = False) -> tuple[DataFrame, DataFrame]:
    """Runs of all cases by all methods, which are written once, and their summary rows."""
    runs = checkpointed(search.runs(edges.edges(cells, params, excess), params, methods, measure_memory))
    return runs, summarised(runs)
