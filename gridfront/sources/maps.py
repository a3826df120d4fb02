"""Control maps as relations: cells from ``spark.range`` and CASE columns, one parameter row a map."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = "case_id string, x int, y int, dem double, nav double, vis double, u double, v double, occ boolean"
PARAMS = "case_id string, width int, height int, resolution_m double, start struct<x:int,y:int>, goal struct<x:int,y:int>, v_air double, v_max double, v_air_min double, v_air_max double, z_max_m double, agl_m double, clearance_m double, battery_wh double, reserve_wh double, power_w double, min_turn_radius_m double, sites array<struct<x:int,y:int>>"

#: Height, width and resolution in metres of each map.
SIZES = {"lake": (13, 19, 25.0), "demo": (9, 11, 25.0), "terrain": (11, 15, 10.0), "realistic": (18, 28, 20.0), "nfz": (11, 17, 10.0), "tailwind": (10, 15, 10.0), "foggy_valley": (3, 5, 10.0), "mountain_pass": (3, 3, 10.0), "walled": (7, 7, 10.0), "brute": (4, 3, 10.0)}
#: Elliptic patches of the terrain map (row, column, radius, quality), painted in this order.
PATCHES = [(8.0, 13.5, 1.3, 0.26), (2.5, 10.0, 1.9, 0.56), (8.5, 4.0, 2.0, 0.58), (5.5, 12.0, 1.6, 0.88), (9.0, 7.0, 1.4, 0.86), (4.0, 8.0, 2.5, 0.24)]
BUILT_IN = ("lake", "foggy_valley", "tailwind", "nfz", "mountain_pass", "walled", "terrain", "realistic")


def block(x0: int, x1: int, y0: int, y1: int) -> Column:
    """Columns x0 to x1 and rows y0 to y1, ends exclusive."""
    return (F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1)


def square(c: Column) -> Column:
    return c * c


def layers(name: str) -> dict[str, Column]:
    """The layers of a map that differ from the plain one."""
    x, y = F.col("x"), F.col("y")
    one = lambda cond, value, rest: F.when(cond, F.lit(value)).otherwise(rest)
    if name == "lake":
        return {"nav": one(block(5, 14, 4, 9), 0.0, 0.9), "vis": one(block(0, 5, 0, 3), 0.2, 1.0)}
    if name == "demo":
        return {"nav": one(block(4, 9, 3, 6), 0.0, 0.9), "vis": one(block(4, 6, 4, 5), 0.2, 1.0)}
    if name == "nfz":
        return {"occ": block(8, 9, 3, 7)}
    if name == "tailwind":
        return {"u": one(y == 9, 10.0, 0.0)}
    if name == "foggy_valley":
        return {"vis": one(block(1, 4, 1, 2), 0.0, 1.0)}
    if name == "mountain_pass":
        return {"dem": one((x == 1) & (y == 1), 100.0, 0.0)}
    if name == "walled":
        return {"occ": x == 3}
    if name == "realistic":
        hill = lambda cx, cy, sx, sy: F.exp(-square((x - cx) / sx) - square((y - cy) / sy))
        fog = square((x - 8.0) / 4.5) + square((y - 11.0) / 2.5) <= 1.0
        lake = square((x - 13.5) / 6.0) + square((y - 11.5) / 2.7) <= 1.0
        nav = F.when((x > 20) & (y > 10), 0.48).when((x < 8) & (y < 6), 0.90).when(lake, 0.08).otherwise(0.72)
        return {"dem": 112.0 + 0.45 * x + 0.25 * y + 48.0 * hill(14.0, 8.0, 4.8, 3.6) + 18.0 * hill(5.0, 3.0, 3.0, 2.5), "nav": nav, "vis": one(fog | ((x == 12) & (y == 15)), 0.35, 1.0), "occ": block(18, 20, 6, 12) | block(10, 16, 3, 5), "u": 5.5 * F.exp(-square((y - 14.0) / 3.5)), "v": 3.5 * F.exp(-square((x - 14.0) / 5.0))}
    return {}


def single(name: str) -> tuple[str, ...]:
    """Layers of a map in single precision."""
    return () if name == "brute" else ("u", "v") if name == "realistic" else ("dem", "nav", "vis", "u", "v")


def drawn(name: str, height: int, width: int, seed: int | None) -> dict[str, np.ndarray]:
    """Layers that need the seeded generator; drawn on the driver, a few hundred numbers."""
    if name == "terrain":
        rng = np.random.default_rng(7 if seed is None else seed)
        nav = np.full((height, width), 0.9, np.float32)
        lake = (slice(3, 8), slice(5, 12))
        nav[lake] = 0.0
        yy, xx = np.mgrid[:height, :width]
        for cy, cx, r, value in PATCHES:
            nav[np.hypot((xx - cx) / r, (yy - cy) / r) <= 1.0] = value
        nav += rng.normal(0.0, 0.03, (height, width))
        nav = np.clip(nav, 0.05, 0.95)
        nav[lake] = 0.0
        return {"nav": nav}
    if name == "brute":
        rng = np.random.default_rng(3 if seed is None else seed)
        flat = np.float32(0.0)
        dem = np.full((height, width), flat)
        dem[1:] += rng.uniform(0.0, 5.0, (height - 1, width))
        nav, vis = (np.clip(np.full((height, width), v, np.float32) + rng.uniform(-0.3, 0.3, (height, width)), 0.05, 0.95) for v in (0.9, 1.0))
        u, v = (rng.uniform(-3.0, 3.0, (height, width)).astype(np.float32) for _ in range(2))
        return {"dem": dem, "nav": nav, "vis": vis, "u": u, "v": v}
    return {}


#: Start, goal and limits of the maps that differ from the plain ones.
OWN = {
    "foggy_valley": {"start": (0, 1), "goal": (4, 1)},
    "mountain_pass": {"start": (0, 2), "goal": (2, 0), "agl_m": 20.0, "z_max_m": 50.0},
    "brute": {"start": (0, 0), "goal": (2, 3)},
    "realistic": {"start": (1, 16), "goal": (26, 1), "v_air_min": 10.0, "v_air_max": 22.0, "z_max_m": 205.0, "agl_m": 55.0, "battery_wh": 18.0, "reserve_wh": 3.0, "power_w": 450.0, "min_turn_radius_m": 10.0, "sites": [(1, 16), (25, 2)]},
}
PLAIN = {"dem": 0.0, "nav": 0.9, "vis": 1.0, "u": 0.0, "v": 0.0, "occ": False}


def relation(spark: SparkSession, cases: list[tuple[str, int | None, str]], double: bool = False) -> tuple[DataFrame, DataFrame]:
    """``cells`` and ``params`` of (map, seed, case id) triples: one small table of cases, exploded to cells, and one CASE a layer.

    Layers of single precision are rounded to it; the averaged ones (``nav``, ``vis``) also have its type, unless all
    are to be ``double``. Maps of both precisions need ``double``.
    """
    if wrong := sorted({n for n, _, _ in cases} - set(SIZES)):
        raise ValueError(f"unknown map {wrong[0]!r}; known: {', '.join(SIZES)}")
    names = sorted({n for n, _, _ in cases})
    if len({"nav" in single(n) for n in names}) > 1 and not double:
        raise ValueError("maps of both precisions")
    held, rows = [], []
    for name, seed, case in cases:
        h, w, res = SIZES[name]
        layers_ = drawn(name, h, w, seed)
        held.append((case, name, w, h, *[[float(z) for z in layers_[c].ravel()] if c in layers_ else None for c in PLAIN if c != "occ"]))
        p = {"case_id": case, "width": w, "height": h, "resolution_m": res, "start": (0, h - 1), "goal": (w - 1, 0), "v_air": 15.0, "v_max": 12.0, "v_air_min": 0.1, "v_air_max": None, "z_max_m": None, "agl_m": None, "clearance_m": None, "battery_wh": None, "reserve_wh": None, "power_w": None, "min_turn_radius_m": None, "sites": None}
        rows.append(tuple((p | OWN.get(name, {})).values()))
    arrays = [f"d_{c}" for c in PLAIN if c != "occ"]
    base = spark.createDataFrame(held, "case_id string, name string, w int, h int, " + ", ".join(f"{d} array<double>" for d in arrays))
    base = base.select("*", F.explode(F.sequence(F.lit(0), F.col("w") * F.col("h") - 1)).alias("at"))
    base = base.select("*", (F.col("at") % F.col("w")).alias("x"), F.floor(F.col("at") / F.col("w")).cast("int").alias("y"))
    own = {n: layers(n) for n in names}
    columns = {}
    for c, plain in PLAIN.items():
        value = F.lit(plain)
        for n in names:
            if c in own[n]:
                value = F.when(F.col("name") == n, own[n][c]).otherwise(value)
        if c == "occ":
            columns[c] = value
            continue
        value = F.coalesce(F.get(f"d_{c}", F.col("at")), value)
        coarse = [n for n in names if c in single(n)]
        rounded = value.cast("float")
        if c in ("nav", "vis") and coarse and not double:
            columns[c] = rounded  # all the maps are of single precision here
        else:
            columns[c] = F.when(F.col("name").isin(coarse), rounded.cast("double")).otherwise(value) if coarse else value
    return base.select("case_id", "x", "y", *[v.alias(c) for c, v in columns.items()]), spark.createDataFrame(rows, PARAMS)


def control_map(spark: SparkSession, name: str, seed: int | None = None, case_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``cells`` and ``params`` of a named map; layers of single precision have type float."""
    return relation(spark, [(name, seed, case_id or name)])


def built_in_names(names: list[str] | tuple[str, ...]) -> None:
    """An error if a name is not one of the benchmark's control maps."""
    if wrong := set(names) - set(BUILT_IN):
        raise ValueError(f"unknown maps: {', '.join(sorted(wrong))}")


def built_in(spark: SparkSession, names: tuple[str, ...] = BUILT_IN) -> list[tuple[DataFrame, DataFrame]]:
    """The benchmark's control maps; unknown names are an error."""
    built_in_names(names)
    return [control_map(spark, n) for n in names]


def many(spark: SparkSession, names: tuple[str, ...]) -> list[tuple[DataFrame, DataFrame]]:
    """The named maps as one relation for each precision of the averaged layers."""
    groups: dict[bool, list] = {}
    for name in names:
        groups.setdefault("nav" in single(name), []).append((name, None, name))
    return [relation(spark, g) for g in groups.values()]


#: Layers that an archive must hold, and those that it may hold beside them, with their columns.
NEEDED = {"dem": "dem", "nav_density": "nav", "visibility": "vis"}
OPTIONAL = {"dem_max": "dem_max", "visual_richness": "visual_richness", "rugosity": "rugosity"}


def archive(spark: SparkSession, path: str, case_id: str, start: tuple | None = None, goal: tuple | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """A map from an ``.npz`` archive of aligned layers, read from any file system that Spark reads.

    Gives ``cells`` (with the optional layers that the archive holds), ``params``, and the terrain profile
    ``case_id, x, y, dx, dy, excess_m`` of the directed edges, None without one. Start and goal come from
    the arguments or from the archive; neither is an error. A value of the profile that is not finite bars its edge.
    """
    import io

    raw = spark.read.format("binaryFile").load(path).select("content").first()
    if raw is None:
        raise ValueError(f"{path} holds no archive")
    z = np.load(io.BytesIO(bytes(raw[0])), allow_pickle=False)
    missing = [k for k in ("dem", "nav_density", "visibility", "wind_field", "occupancy") if k not in z]
    if missing:
        raise ValueError(f"the archive lacks {', '.join(missing)}")
    h, w = z["dem"].shape
    shapes = {k: z[k].shape for k in (*NEEDED, *OPTIONAL, "occupancy", "landing_sites") if k in z} | {"wind_field": z["wind_field"].shape[:2]}
    if wrong := [k for k, s in shapes.items() if s != (h, w)]:
        raise ValueError(f"layers must have one shape; not so: {', '.join(wrong)}")
    if "edge_terrain_excess_m" in z and z["edge_terrain_excess_m"].shape != (h, w, 3, 3):
        raise ValueError("the terrain profile must have three by three values a cell")
    if lacks := [k for k, v in (("goal", goal), ("start", start)) if v is None and k not in z]:
        raise ValueError(f"the archive lacks {' and '.join(lacks)}, and none is given")
    number = lambda k, d=None: float(z[k]) if k in z and not np.isnan(float(z[k])) else d
    cell = lambda v, k: tuple(int(q) for q in (v if v is not None else z[k]))
    yy, xx = np.mgrid[:h, :w]
    import pandas as pd

    kind = lambda a: "float" if a.dtype == np.float32 else "double"
    cols = {c: z[k] for k, c in (NEEDED | OPTIONAL).items() if k in z} | {"u": z["wind_field"][..., 0], "v": z["wind_field"][..., 1]}
    cols = {c: cols[c] for c in ("dem", "nav", "vis", "u", "v", *OPTIONAL.values()) if c in cols}
    pdf = pd.DataFrame({"case_id": case_id, "x": xx.ravel().astype(np.int32), "y": yy.ravel().astype(np.int32)} | {k: a.ravel() for k, a in cols.items()} | {"occ": z["occupancy"].astype(bool).ravel()})
    cells = spark.createDataFrame(pdf, "case_id string, x int, y int, " + ", ".join(f"{k} {kind(a)}" for k, a in cols.items()) + ", occ boolean")
    sites = [(int(x), int(y)) for y, x in np.argwhere(z["landing_sites"])] if "landing_sites" in z else None
    row = (case_id, w, h, number("resolution_m", 10.0), cell(start, "start"), cell(goal, "goal"), number("v_air", 15.0), number("v_max", 12.0), number("v_air_min_mps", 0.1), number("v_air_max_mps"), number("z_max_m"), number("cruise_altitude_agl_m"), number("min_terrain_clearance_m"), number("battery_energy_wh"), number("energy_reserve_wh"), number("cruise_power_w"), number("min_turn_radius_m"), sites)
    excess = None
    if "edge_terrain_excess_m" in z:
        e = z["edge_terrain_excess_m"].astype(float)
        dy, dx = np.mgrid[-1:2, -1:2]
        table = pd.DataFrame({"case_id": case_id} | {k: np.broadcast_to(v, e.shape).ravel().astype(np.int32) for k, v in (("x", xx[..., None, None]), ("y", yy[..., None, None]), ("dx", dx), ("dy", dy))} | {"excess_m": np.where(np.isfinite(e), e, np.inf).ravel()})
        excess = spark.createDataFrame(table[(table.dx != 0) | (table.dy != 0)], "case_id string, x int, y int, dx int, dy int, excess_m double")
    return cells, spark.createDataFrame([row], PARAMS), excess
