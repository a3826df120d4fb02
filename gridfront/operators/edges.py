"""The directed edge relation of a raster: one gather of neighbours, then column arithmetic.

Cells are dealt out by tiles with a border of one cell; there every cell sends itself to the nine cells
around it and one aggregation puts each 3x3 neighbourhood into a map: a single shuffle of little more
than a row a cell, instead of one join for the end cell, one for the sampled cell and two for the corners. A neighbour outside the grid is absent from the map,
which is the bounds check. Values that later steps use more than once are computed in stages that the
optimiser does not fold into one expression (``once``), so each is evaluated once an edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfront.functions import scalars as S

#: Cells along a side of the tiles that cells are dealt out by.
TILE = 16
LAYERS = ["dem", "nav", "vis", "u", "v", "occ"]


def neighbourhood(cells: DataFrame, columns: list[str], keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """``keys, x, y, near``: ``near`` maps 3 * dx + dy to the neighbour's columns (0 is the cell itself).

    Cells are dealt out once by square tiles, those at a border to each tile that they touch; around a tile's cells
    nothing is shuffled any more.
    """
    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    side = lambda c, d: F.floor((F.col(c) + d) / TILE)
    tiles = F.array_distinct(F.array(*[F.struct(side("x", dx).alias("tx"), side("y", dy).alias("ty")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]))
    dealt = cells.select(*keys, "x", "y", F.struct(*columns).alias("cell"), F.inline(tiles)).repartition(n, *keys, "tx", "ty")
    around = F.inline(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in [(0, 0), *S.STEPS]]))
    sent = dealt.select("*", around).withColumns({"x": F.col("x") - F.col("dx"), "y": F.col("y") - F.col("dy")})
    sent = sent.filter((side("x", 0) == F.col("tx")) & (side("y", 0) == F.col("ty")))
    near = sent.groupBy(*keys, "tx", "ty", "x", "y").agg(F.map_from_entries(F.collect_list(F.struct((3 * F.col("dx") + F.col("dy")).alias("k"), F.col("cell")))).alias("near"))
    return near.select(*keys, "x", "y", "near").filter(F.col("near")[0].isNotNull())  # targets outside the grid have no centre


def once(rows: DataFrame, **values) -> DataFrame:
    """Adds columns that are evaluated once a row: a generator of one row, through which no projection is folded."""
    held = F.inline(F.array(F.struct(*[c.alias(n) for n, c in values.items()])))
    return rows.select("*", held)


def edges(cells: DataFrame, params: DataFrame, excess: DataFrame | None = None) -> DataFrame:
    """Feasible directed edges ``case_id, x, y, dx, dy, x1, y1, c1, c2, c3``.

    ``cells`` has ``case_id, x, y, dem, nav, vis, u, v, occ``; ``params`` has one row a case with
    ``resolution_m, v_air, v_max, z_max_m, agl_m, clearance_m`` (the last three may be null). An
    edge ends in a free cell under the ceiling, does not cut the corner of an occupied cell, meets
    wind below the limit at the cell of least indices, and clears the terrain profile if given.
    """
    near = neighbourhood(cells, LAYERS)
    step = F.inline(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in S.STEPS]))
    p = F.broadcast(params) if few(params) else params
    e = near.join(p.select("case_id", "resolution_m", "v_air", "v_max", "z_max_m", "agl_m", "clearance_m"), "case_id").select("*", step)
    dx, dy = F.col("dx"), F.col("dy")
    at = lambda kx, ky: F.col("near")[3 * kx + ky]
    e = once(e, a=at(F.lit(0), F.lit(0)), b=at(dx, dy), m=at(F.least(dx, F.lit(0)), F.least(dy, F.lit(0))), p=at(dx, F.lit(0)), q=at(F.lit(0), dy)).drop("near")
    e = e.filter("b is not null and not b.occ").filter("z_max_m is null or b.dem + coalesce(agl_m, 0D) <= z_max_m")
    e = e.filter("dx = 0 or dy = 0 or not (p.occ or q.occ)").filter(S.wind_speed(F.col("m.u"), F.col("m.v")) < F.col("v_max"))
    if excess is not None:
        e = e.join(excess.select("case_id", "x", "y", "dx", "dy", "excess_m"), ["case_id", "x", "y", "dx", "dy"], "left")
        agl = F.coalesce("agl_m", F.lit(0.0))
        e = e.filter(S.edge_clearance(agl, F.col("excess_m")) + 1e-9 >= F.coalesce("clearance_m", agl))
    res = F.col("resolution_m")
    dtype = dict(cells.dtypes)
    mean = lambda c: S.layer_mean(F.col(f"a.{c}"), F.col(f"m.{c}"), F.col(f"b.{c}"), dtype[c])
    e = once(e, d=S.step_length(dx * res, -dy * res), nav=mean("nav"), vis=mean("vis")).select("case_id", "x", "y", "dx", "dy", "d", "nav", "vis", "m.u", "m.v", "v_air", (F.col("b.dem") - F.col("a.dem")).alias("dz"), "resolution_m")
    e = once(e, **S.wind_parts(dx * res, -dy * res, F.col("d"), F.col("dz"), F.col("u"), F.col("v")))
    e = once(e, disc=S.speed_discriminant(F.col("along"), F.col("across"), F.col("slope"), F.col("v_air"))).filter("disc >= 0")
    e = once(e, speed=S.ground_speed(F.col("along"), F.col("slope"), F.col("disc"))).filter("speed > 0")
    e = once(e, c1=F.col("d") / F.col("speed"))
    return e.select("case_id", "x", "y", "dx", "dy", (F.col("x") + dx).alias("x1"), (F.col("y") + dy).alias("y1"), "c1", ((1.0 - F.col("nav")) * F.col("c1")).alias("c2"), ((1.0 - F.col("vis")) * F.col("c1")).alias("c3"))


def few(params: DataFrame, most: int = 8 << 20, rows: int = 10_000) -> bool:
    """Whether the parameter table is small enough to send to every task, by its known size or, for rows made in the session, their number.

    Spark takes such rows for larger than any table and would rather send all cells than them.
    """
    plan = params._jdf.queryExecution().optimizedPlan()
    if plan.stats().sizeInBytes() <= most:
        return True
    while plan.children().size() == 1:
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRDD" and params.limit(rows + 1).count() <= rows


def turns(edge_rows: DataFrame, params: DataFrame) -> DataFrame:
    """Pairs of successive edges with the radius of the turn between them and whether it is allowed."""
    first = edge_rows.select("case_id", F.col("x1").alias("x"), F.col("y1").alias("y"), F.col("dx").alias("hx"), F.col("dy").alias("hy"))
    both = first.join(edge_rows.select("case_id", "x", "y", "dx", "dy"), ["case_id", "x", "y"]).join(params.select("case_id", "resolution_m", "min_turn_radius_m"), "case_id")
    radius = S.turn_radius(*(F.col(c) for c in ("hx", "hy", "dx", "dy", "resolution_m")))
    return both.select("case_id", "x", "y", "hx", "hy", "dx", "dy", radius.alias("radius_m"), S.turn_feasible(radius, F.col("min_turn_radius_m")).alias("feasible"))


def validate(cells: DataFrame, params: DataFrame) -> DataFrame:
    """``case_id, problem`` for every broken constraint of a case; empty for sound cases."""
    p = F.col
    agl = F.coalesce(p("agl_m"), F.lit(0.0))
    checks = [
        ("resolution must be positive", ~(p("resolution_m") > 0)),
        ("airspeed must be positive", ~(p("v_air") > 0)),
        ("airspeed must lie in its range", (p("v_air") < p("v_air_min")) | (p("v_air") > p("v_air_max"))),
        ("wind limit must be positive", ~(p("v_max") > 0)),
        ("turn radius must not be negative", p("min_turn_radius_m") < 0),
        ("height above ground must not be negative", agl < 0),
        ("clearance must lie between 0 and the height above ground", (p("clearance_m") < 0) | (p("clearance_m") > agl)),
        ("battery, reserve and power must be consistent", (p("battery_wh") <= 0) | (p("reserve_wh") < 0) | (p("reserve_wh") >= p("battery_wh")) | (p("power_w") <= 0) | (p("battery_wh").isNotNull() & p("power_w").isNull())),
    ]
    broken = params.select("case_id", F.explode(F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), m) for m, c in checks]), lambda x: x.isNotNull())).alias("problem"))
    ends = params.select("case_id", "z_max_m", "agl_m", F.explode(F.array(F.struct(F.lit("start").alias("role"), p("start.x").alias("x"), p("start.y").alias("y")), F.struct(F.lit("goal").alias("role"), p("goal.x").alias("x"), p("goal.y").alias("y")))).alias("e"))
    ends = ends.select("case_id", "z_max_m", "agl_m", "e.*").join(cells.select("case_id", "x", "y", "dem", "occ"), ["case_id", "x", "y"], "left")
    wrong = F.when(p("occ").isNull(), "lies outside the grid").when(p("occ"), "is occupied").when(p("dem") + agl > p("z_max_m"), "lies above the ceiling")
    return broken.union(ends.select("case_id", F.concat_ws(" ", "role", wrong).alias("problem"), wrong.alias("w")).filter("w is not null").drop("w"))
