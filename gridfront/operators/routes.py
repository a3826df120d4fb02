"""Characteristics of routes: lengths, altitudes, averages, energy and ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridfront.operators.decision import topsis


def route_points(routes: DataFrame, keys: list[str]) -> DataFrame:
    return routes.select(*keys, F.posexplode("path").alias("k", "p")).select(*keys, "k", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


def characteristics(points: DataFrame, totals: DataFrame, cells: DataFrame, params: DataFrame, keys: list[str]) -> DataFrame:
    """One row a route: lengths, altitude range, mean speed and qualities, energy and what is left.

    ``points`` has ``keys, case_id, k, x, y``, ``totals`` ``keys, f1, f2, f3``. Qualities of a route
    without duration are 1 and its speed 0; energies are NaN without an energy model.
    """
    p = points.join(cells.select("case_id", "x", "y", "dem"), ["case_id", "x", "y"]).join(params.select("case_id", "resolution_m", F.coalesce("agl_m", F.lit(0.0)).alias("agl")), "case_id")
    w = Window.partitionBy(*keys).orderBy("k")
    nx, ny, nz = F.lead("x").over(w), F.lead("y").over(w), F.lead("dem").over(w)
    p = p.withColumns({"_dx": (nx - F.col("x")) * F.col("resolution_m"), "_dy": (ny - F.col("y")) * F.col("resolution_m"), "_dz": nz - F.col("dem")})
    flat = F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy"))
    solid = F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy") + F.col("_dz") * F.col("_dz"))
    m = p.groupBy(*keys, "case_id").agg(F.count("*").alias("points"), F.coalesce(F.sum(flat), F.lit(0.0)).alias("length_m"), F.coalesce(F.sum(solid), F.lit(0.0)).alias("length_3d_m"), F.min(F.col("dem") + F.col("agl")).alias("min_altitude_m"), F.max(F.col("dem") + F.col("agl")).alias("max_altitude_m"))
    m = m.join(totals.select(*keys, "f1", "f2", "f3"), keys).join(params.select("case_id", "battery_wh", "power_w"), "case_id")
    t, nan = F.col("f1"), F.lit(float("nan"))
    share = lambda c: F.when(t > 0, 1.0 - F.col(c) / t).otherwise(1.0)
    energy = F.coalesce(F.col("power_w") * t / 3600.0, nan)
    return m.select(*keys, "points", "length_m", "length_3d_m", "min_altitude_m", "max_altitude_m", "f1", "f2", "f3", F.when(t > 0, F.col("length_m") / t).otherwise(0.0).alias("mean_speed_mps"), share("f2").alias("mean_navigation"), share("f3").alias("mean_visibility"), energy.alias("energy_wh"), F.coalesce(F.col("battery_wh") - energy, nan).alias("energy_left_wh"))


def ranked(rows: DataFrame, keys: list[str], tie: str, weights=(0.5, 0.3, 0.2)) -> DataFrame:
    """Characteristics with TOPSIS closeness, rank and the selected route."""
    return topsis(rows, ["f1", "f2", "f3"], list(weights), keys, tie).withColumn("selected", F.col("rank") == 1)


def best(rows: DataFrame, n: int) -> DataFrame:
    """The routes that ``ranked`` places among the first ``n`` of their case."""
    if n < 1:
        raise ValueError("at least one route is to be shown")
    return rows.filter(F.col("rank") <= n)


def representative(rows: DataFrame, keys: list[str], id_: str, limit: int = 8) -> DataFrame:
    """The routes to show of each case: all of them up to ``limit``, else the first best of each cost and the selected one.

    ``rows`` come from ``ranked``; one aggregate a case, joined back.
    """
    best = [F.min_by(id_, F.struct(o, id_)).alias(f"_{o}") for o in ("f1", "f2", "f3")]
    each = rows.groupBy(*keys).agg(F.count("*").alias("_n"), *best, F.min_by(id_, "rank").alias("_best"))
    r = rows.join(each, keys)
    return r.filter((F.col("_n") <= limit) | F.col(id_).isin(*[F.col(c) for c in ("_f1", "_f2", "_f3", "_best")])).select(*rows.columns)


def text_map(cells: DataFrame, path: DataFrame, params: DataFrame) -> DataFrame:
    """One line of text a row of each grid: ``*`` route, ``S``, ``G``, ``X`` occupied, ``~`` no navigation, ``o`` landing site, ``f`` fog."""
    c = cells.join(path.select("case_id", "x", "y", F.lit(True).alias("_on")).distinct(), ["case_id", "x", "y"], "left").join(params.select("case_id", "start", "goal", "sites"), "case_id")
    at = F.struct("x", "y")
    glyph = F.when(F.col("_on"), "*").when(at == F.col("start"), "S").when(at == F.col("goal"), "G").when(F.col("occ"), "X").when(F.col("nav") < 0.5, "~")
    glyph = glyph.when(F.coalesce(F.exists("sites", lambda s: s == F.struct(F.col("x").alias("x"), F.col("y").alias("y"))), F.lit(False)), "o").when(F.col("vis") < 0.5, "f").otherwise(".")
    return c.groupBy("case_id", "y").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", glyph.alias("g")))), lambda s: s["g"]), "").alias("line"))
