"""The operators over the star-schema tables, each with DuckDB SQL for the same rows where SQL has a form.

``part`` is read as a raster of 50 columns (cell (p_partkey % 50, p_partkey div 50)), ``lineitem``
by supplier gives cost vectors, ``orders`` experiment runs and routes, ``events`` a time axis.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridfront.functions import scalars as S
from gridfront.operators import decision, edges, imagery, pareto, paths, raster, routes, search, stats
from gridfront.plans import campaign
from gridfront.sources import maps
from gridfront.streaming import health

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
OBJ = ["f1", "f2", "f3"]
EXTENT = (1000.0, 2500.0, 500.0, 1700.0)
#: Polygons of the zone queries.
ZONES = [[(1105.0, 1640.0), (1333.0, 1555.0), (1210.0, 1310.0)], [(1800.0, 600.0), (2100.0, 600.0), (2100.0, 900.0), (1950.0, 700.0), (1800.0, 900.0)]]
PLUMES = [(12.0, 3.0, 6.0, 0.25), (33.5, 2.0, 4.0, 0.3), (25.0, 20.0, 9.0, 0.4)]


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, columns: list[str], places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) + F.lit(0.0) for c in columns})


def grid(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "part").select("p_partkey", "p_size")
    k, s = F.col("p_partkey"), F.col("p_size")
    return p.select(F.lit("part").alias("case_id"), (k % 50).cast("int").alias("x"), F.floor(k / 50).cast("int").alias("y"), (s * 2.0).alias("dem"), (s / 50.0).alias("nav"), ((k % 7 + 1) / 8.0).alias("vis"), (k % 5 - 2.0).alias("u"), (k % 3 - 1.0).alias("v"), (s > 46).alias("occ"))


GRID = """grid AS (SELECT (p_partkey % 50)::INT AS x, (p_partkey // 50)::INT AS y, p_size * 2e0 AS dem, p_size / 50e0 AS nav,
  (p_partkey % 7 + 1) / 8e0 AS vis, p_partkey % 5 - 2e0 AS u, p_partkey % 3 - 1e0 AS v, p_size > 46 AS occ FROM part)"""


def params(spark: SparkSession, case: str = "part", turn: float | None = 8.0) -> DataFrame:
    row = (case, 50, None, 10.0, (0, 0), (49, 3), 15.0, 12.0, 0.1, None, 95.0, 5.0, None, 40.0, 4.0, 300.0, turn, [(7, 1), (30, 2)])
    return spark.createDataFrame([row], maps.PARAMS)


STEPS = "steps AS (SELECT * FROM (VALUES (-1,-1),(-1,0),(-1,1),(0,-1),(0,1),(1,-1),(1,0),(1,1)) t(dx, dy))"
EDGES = f"""{GRID}, {STEPS}, e0 AS (
  SELECT a.x, a.y, s.dx, s.dy, b.x AS x1, b.y AS y1, b.dem - a.dem AS dz, m.u, m.v, 10e0 * s.dx AS ex, -10e0 * s.dy AS ey,
         (a.nav + m.nav + m.nav + m.nav + b.nav) / 5 AS nav, (a.vis + m.vis + m.vis + m.vis + b.vis) / 5 AS vis
  FROM grid a JOIN steps s ON true JOIN grid b ON b.x = a.x + s.dx AND b.y = a.y + s.dy
  JOIN grid m ON m.x = least(a.x, b.x) AND m.y = least(a.y, b.y)
  JOIN grid p ON p.x = b.x AND p.y = a.y JOIN grid q ON q.x = a.x AND q.y = b.y
  WHERE NOT b.occ AND b.dem + 5e0 <= 95e0 AND (s.dx = 0 OR s.dy = 0 OR NOT (p.occ OR q.occ)) AND sqrt(m.u * m.u + m.v * m.v) < 12e0
), e1 AS (SELECT *, sqrt(ex * ex + ey * ey) AS d FROM e0
), e2 AS (SELECT *, u * (ex / d) + v * (ey / d) AS al, u * (ey / d) - v * (ex / d) AS ac, dz / d AS sl FROM e1
), e3 AS (SELECT *, 1 + sl * sl AS qa, -2 * al AS qb, 4 * al * al - 4 * (1 + sl * sl) * (al * al + ac * ac - 225e0) AS disc FROM e2
), e4 AS (SELECT *, (-qb + sqrt(disc)) / (2 * qa) AS vh FROM e3 WHERE disc >= 0
), edges AS (SELECT x, y, dx, dy, x1, y1, d / vh AS c1, (1 - nav) * (d / vh) AS c2, (1 - vis) * (d / vh) AS c3 FROM e4 WHERE vh > 0)"""


@query("grid_edges", f"WITH {EDGES} SELECT x, y, dx::INT AS dx, dy::INT AS dy, round(c1, 6) AS c1, round(c2, 6) AS c2, round(c3, 6) AS c3 FROM edges")
def grid_edges(spark, sf):
    e = edges.edges(grid(spark, sf), params(spark))
    return rounded(e.select("x", "y", "dx", "dy", "c1", "c2", "c3"), ["c1", "c2", "c3"])


@query("profile_edges", f"""WITH {EDGES}, k AS (SELECT (p_partkey % 50)::INT AS x, (p_partkey // 50)::INT AS y, p_partkey AS k FROM part),
 ex AS (SELECT x, y, dx, dy, CASE WHEN k % 97 = 0 THEN NULL ELSE (k * 7 + dx * 3 + dy * 5 + 8) % 11 - 2e0 END AS excess FROM k, steps WHERE (k + dx + dy + 2) % 4 <> 0)
 SELECT e.x, e.y, e.dx::INT AS dx, e.dy::INT AS dy, round(c1, 6) AS c1 FROM edges e LEFT JOIN (SELECT *, true AS known FROM ex) ex USING (x, y, dx, dy)
 WHERE known IS NULL OR (excess IS NOT NULL AND 5e0 - excess + 1e-9 >= 3e0)""")
def profile_edges(spark, sf):
    """Edges that clear a terrain profile: some edges have none, and some a value that is not finite and bars them."""
    c = grid(spark, sf)
    k = F.col("p_partkey")
    p = load(spark, sf, "part").select(F.lit("part").alias("case_id"), "p_partkey", (k % 50).cast("int").alias("x"), F.floor(k / 50).cast("int").alias("y"), F.inline(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in S.STEPS])))
    excess = p.filter((k + F.col("dx") + F.col("dy") + 2) % 4 != 0).select("case_id", "x", "y", "dx", "dy", F.when(k % 97 == 0, F.lit(S.INF)).otherwise((k * 7 + F.col("dx") * 3 + F.col("dy") * 5 + 8) % 11 - 2.0).alias("excess_m"))
    e = edges.edges(c, params(spark).withColumn("clearance_m", F.lit(3.0)), excess)
    return rounded(e.select("x", "y", "dx", "dy", "c1"), ["c1"])


@query("mean_pool", f"WITH {GRID} SELECT (x // 5)::INT AS x, (y // 5)::INT AS y, round(avg(dem), 6) AS dem, round(avg(vis), 6) AS vis FROM grid GROUP BY ALL HAVING count(*) = 25")
def mean_pool(spark, sf):
    return rounded(raster.mean_pool(grid(spark, sf), 5, ["dem", "vis"], []), ["dem", "vis"])


@query("upscale", f"WITH {GRID} SELECT (x * 2 + i)::INT AS x, (y * 2 + j)::INT AS y, dem FROM grid, (VALUES (0),(1)) a(i), (VALUES (0),(1)) b(j)")
def upscale(spark, sf):
    return raster.upscale(grid(spark, sf).select("x", "y", "dem"), 2)


@query("patch_grid", f"""WITH {GRID}, p AS (SELECT x AS px, y AS py, dem / 2 - 25 AS value, x // 4 AS cx, y // 4 AS cy FROM grid),
 w AS (SELECT *, count(*) OVER (PARTITION BY cx, cy) AS n, sum(value) OVER (PARTITION BY cx, cy) AS s FROM p)
 SELECT px, py, cx::INT AS cell_x, cy::INT AS cell_y, CASE WHEN s > 0 THEN value ELSE 0 END AS value FROM w WHERE n = 16""")
def patch_grid(spark, sf):
    px = grid(spark, sf).select(F.col("x").alias("px"), F.col("y").alias("py"), (F.col("dem") / 2 - 25).alias("value"))
    return raster.patch_grid(px, 4.0, 1.0, [])


@query("mosaic", """SELECT (p_partkey // 16 % 25 * 4 + p_partkey % 4)::INT AS x, (p_partkey // 400 * 4 + p_partkey // 4 % 4)::INT AS y, p_size AS value FROM part""")
def mosaic(spark, sf):
    k = F.col("p_partkey")
    part = lambda a, b: (F.floor(k / a) % b).cast("int")
    p = load(spark, sf, "part").select(part(16, 25).alias("cell_x"), F.floor(k / 400).cast("int").alias("cell_y"), part(1, 4).alias("px"), part(4, 4).alias("py"), F.col("p_size").alias("value"))
    return raster.mosaic(p, 4, 4)


SLOPE = f"""{GRID}, sl AS (SELECT *, coalesce((lead(dem) OVER wx - lag(dem) OVER wx) / 20e0, (lead(dem) OVER wx - dem) / 10e0, (dem - lag(dem) OVER wx) / 10e0, 0) AS gx,
  coalesce((lead(dem) OVER wy - lag(dem) OVER wy) / 20e0, (lead(dem) OVER wy - dem) / 10e0, (dem - lag(dem) OVER wy) / 10e0, 0) AS gy
  FROM grid WINDOW wx AS (PARTITION BY y ORDER BY x), wy AS (PARTITION BY x ORDER BY y)), slopes AS (SELECT *, sqrt(gx * gx + gy * gy) AS slope FROM sl)"""


@query("slope", f"WITH {SLOPE} SELECT x, y, round(slope, 6) AS slope FROM slopes")
def slope(spark, sf):
    return rounded(raster.slope(grid(spark, sf), "dem", 10.0, []).select("x", "y", "slope"), ["slope"])


FOCAL = f"""{SLOPE}, dim AS (SELECT max(x) + 1 AS w, max(y) + 1 AS h FROM grid), off AS (SELECT unnest(range(-3, 4)) AS o),
 near AS (SELECT c.x, c.y, c.dem, c.slope, s.dem AS v FROM slopes c JOIN off a ON true JOIN off b ON true JOIN dim ON true
   JOIN grid s ON s.x = CASE WHEN c.x + a.o < 0 THEN -1 - c.x - a.o WHEN c.x + a.o >= w THEN 2 * w - 1 - c.x - a.o ELSE c.x + a.o END
    AND s.y = CASE WHEN c.y + b.o < 0 THEN -1 - c.y - b.o WHEN c.y + b.o >= h THEN 2 * h - 1 - c.y - b.o ELSE c.y + b.o END),
 met AS (SELECT x, y, slope, sqrt(avg((v - dem) * (v - dem))) AS tri, any_value(dem) - avg(v) AS tpi,
   sqrt(greatest(avg(v * v) - avg(v) * avg(v), 0)) AS std, max(v) - min(v) AS roughness FROM near GROUP BY x, y, slope)"""


@query("focal_terrain", f"WITH {FOCAL} SELECT x, y, round(slope, 5) AS slope, round(tri, 5) AS tri, round(tpi, 5) + 0 AS tpi, round(std, 5) AS std, round(roughness, 5) AS roughness FROM met")
def focal_terrain(spark, sf):
    c = ["slope", "tri", "tpi", "std", "roughness"]
    return rounded(raster.terrain_metrics(grid(spark, sf), "dem", 10.0, []).select("x", "y", *c), c, 5)


@query("robust_norm", """WITH b AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.02) AS lo, quantile_cont(l_extendedprice, 0.98) AS hi FROM lineitem GROUP BY 1)
 SELECT l_orderkey, l_linenumber, l_returnflag, round(CASE WHEN lo = hi THEN 0 ELSE (least(greatest(l_extendedprice, lo), hi) - lo) / (hi - lo) END, 6) AS price FROM lineitem JOIN b USING (l_returnflag)""")
def robust_norm(spark, sf):
    rows = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_extendedprice").alias("price"))
    return rounded(raster.robust_normalize(rows, ["price"], ["l_returnflag"]), ["price"]).select("l_orderkey", "l_linenumber", "l_returnflag", "price")


@query("terrain_quality", f"""WITH {GRID}, k AS (SELECT x, y, dem, x // 10 AS cx, y // 4 AS cy, x % 10 AS lx, y % 4 AS ly FROM grid),
 sl AS (SELECT *, coalesce((lead(dem) OVER wx - lag(dem) OVER wx) / 20e0, (lead(dem) OVER wx - dem) / 10e0, (dem - lag(dem) OVER wx) / 10e0, 0) AS gx,
  coalesce((lead(dem) OVER wy - lag(dem) OVER wy) / 20e0, (lead(dem) OVER wy - dem) / 10e0, (dem - lag(dem) OVER wy) / 10e0, 0) AS gy
  FROM k WINDOW wx AS (PARTITION BY cx, cy, ly ORDER BY lx), wy AS (PARTITION BY cx, cy, lx ORDER BY ly)),
 off AS (SELECT unnest(range(-3, 4)) AS o),
 near AS (SELECT c.cx, c.cy, c.lx, c.ly, c.dem, sqrt(gx * gx + gy * gy) AS slope, s.dem AS v FROM sl c JOIN off a ON true JOIN off b ON true
  JOIN k s ON s.cx = c.cx AND s.cy = c.cy AND s.lx = CASE WHEN c.lx + a.o < 0 THEN -1 - c.lx - a.o WHEN c.lx + a.o >= 10 THEN 19 - c.lx - a.o ELSE c.lx + a.o END
   AND s.ly = CASE WHEN c.ly + b.o < 0 THEN -1 - c.ly - b.o WHEN c.ly + b.o >= 4 THEN 7 - c.ly - b.o ELSE c.ly + b.o END),
 met AS (SELECT cx, cy, lx, ly, slope, sqrt(avg((v - dem) * (v - dem))) AS tri, any_value(dem) - avg(v) AS tpi, sqrt(greatest(avg(v * v) - avg(v) * avg(v), 0)) AS std, max(v) - min(v) AS roughness FROM near GROUP BY ALL),
 long AS (UNPIVOT met ON slope, tri, tpi, std, roughness INTO NAME part_name VALUE val),
 b AS (SELECT cx, cy, part_name, quantile_cont(val, 0.02) AS lo, quantile_cont(val, 0.98) AS hi FROM long GROUP BY ALL),
 n AS (SELECT l.cx, l.cy, l.lx, l.ly, sum(CASE l.part_name WHEN 'slope' THEN 0.25e0 WHEN 'tri' THEN 0.25e0 WHEN 'tpi' THEN 0.15e0 WHEN 'std' THEN 0.2e0 ELSE 0.15e0 END
   * CASE WHEN lo = hi THEN 0 ELSE (least(greatest(val, lo), hi) - lo) / (hi - lo) END) AS t FROM long l JOIN b USING (cx, cy, part_name) GROUP BY ALL),
 q AS (SELECT cx, cy, avg(t) AS quality FROM n GROUP BY ALL), z AS (SELECT quantile_cont(quality, 0.02) AS lo, quantile_cont(quality, 0.98) AS hi FROM q)
 SELECT cx::INT AS cx, cy::INT AS cy, round(CASE WHEN lo = hi THEN 0 ELSE (least(greatest(quality, lo), hi) - lo) / (hi - lo) END, 4) AS quality FROM q, z""")
def terrain_quality(spark, sf):
    k = grid(spark, sf).select((F.floor(F.col("x") / 10)).cast("int").alias("cx"), F.floor(F.col("y") / 4).cast("int").alias("cy"), (F.col("x") % 10).alias("x"), (F.col("y") % 4).alias("y"), "dem")
    return rounded(raster.terrain_quality(k, "dem", 10.0, [], ["cx", "cy"]), ["quality"], 4)


@query("scalar_fields", f"""WITH {GRID} SELECT x, y, dem + 5e0 AS altitude, round(3600 * (40e0 - 4e0) / (300e0 + x), 6) AS usable_s, CASE WHEN y % 2 = 0 THEN 5e0 - dem ELSE 5e0 END AS clearance,
 round(CASE WHEN nav + vis = 0 THEN 0 ELSE (nav - vis) / (nav + vis) END, 6) AS ndvi, round(1 - (1 - 0.9e0 * nav) * (1 - 0.6e0 * vis), 6) AS richness,
 round(sqrt(u * u + v * v), 6) AS wind_speed, round((degrees(atan2(u, v)) + 360) % 360, 6) AS wind_direction, round(0.299e0 * dem + 0.587e0 * nav + 0.114e0 * vis, 6) AS grey,
 greatest(nav, vis) AS density, round(exp(-((x - 12e0) ** 2 + (y - 3e0) ** 2) / (2 * 6e0 * 6e0)), 6) AS plume, floor(255 * (least(greatest(dem, 10e0), 90e0) - 10) / 80)::INT AS preview FROM grid""")
def scalar_fields(spark, sf):
    c = {k: F.col(k) for k in ("x", "y", "dem", "nav", "vis", "u", "v")}
    out = grid(spark, sf).select("x", "y", S.altitude(c["dem"], F.lit(5.0)).alias("altitude"), S.usable_time_s(F.lit(40.0), F.lit(4.0), 300.0 + c["x"]).alias("usable_s"), S.edge_clearance(F.lit(5.0), F.when(c["y"] % 2 == 0, c["dem"])).alias("clearance"), S.ndvi(c["nav"], c["vis"]).alias("ndvi"), S.noisy_or(c["nav"], c["vis"]).alias("richness"), S.wind_speed(c["u"], c["v"]).alias("wind_speed"), S.wind_direction(c["u"], c["v"]).alias("wind_direction"), S.grayscale(c["dem"], c["nav"], c["vis"]).alias("grey"), S.navigation_density(c["nav"], c["vis"]).alias("density"), S.gaussian_density(c["x"], c["y"], F.lit(12.0), F.lit(3.0), F.lit(6.0)).alias("plume"), S.to_uint8(c["dem"], F.lit(10.0), F.lit(90.0)).alias("preview"))
    return rounded(out, ["usable_s", "ndvi", "richness", "wind_speed", "wind_direction", "grey", "plume"])


PLUME_SQL = ", ".join(f"({a}e0, {b}e0, {s}e0, {m}e0)" for a, b, s, m in PLUMES)


@query("smoke_visibility", f"""WITH {GRID}, s AS (SELECT * FROM (VALUES {PLUME_SQL}) t(x0, y0, sg, mv)), d AS (SELECT x, y, exp(-((x - x0) ** 2 + (y - y0) ** 2) / (2 * sg * sg)) AS d, mv FROM grid, s),
 f AS (SELECT x, y, 1 - product(1 - d) AS density, product(1 - (1 - mv) * d) AS visibility FROM d GROUP BY x, y)
 SELECT (x // 2)::INT AS x, (y // 2)::INT AS y, round(avg(density), 6) AS density, round(avg(visibility), 6) AS visibility FROM f GROUP BY ALL HAVING count(*) = 4""")
def smoke_visibility(spark, sf):
    pts = grid(spark, sf).select("x", "y", F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py"))
    f = raster.smoke_visibility(pts, spark.createDataFrame(PLUMES, "x0 double, y0 double, sigma double, min_vis double"), ["x", "y"])
    return rounded(raster.mean_pool(f, 2, ["density", "visibility"], []), ["density", "visibility"])


def solutions(spark: SparkSession, sf: str) -> DataFrame:
    """Cost vectors of suppliers by return flag (scenario) and line status (method)."""
    li = load(spark, sf, "lineitem")
    return li.groupBy(F.col("l_returnflag").alias("scenario"), F.col("l_linestatus").alias("method"), F.col("l_suppkey").alias("id")).agg(F.avg("l_quantity").alias("f1"), (F.sum(F.round(F.col("l_discount") * 100)) / F.count("*")).alias("f2"), (F.sum(F.round(F.col("l_tax") * 100)) / F.count("*")).alias("f3"))


SOL = """sol AS (SELECT l_returnflag AS scenario, l_linestatus AS method, l_suppkey AS id, avg(l_quantity) AS f1,
  sum(round(l_discount * 100)) / count(*) AS f2, sum(round(l_tax * 100)) / count(*) AS f3 FROM lineitem GROUP BY 1, 2, 3)"""
BEATS = "b.f1 <= a.f1 AND b.f2 <= a.f2 AND b.f3 <= a.f3 AND (b.f1 < a.f1 OR b.f2 < a.f2 OR b.f3 < a.f3)"
FRONT = f"{SOL}, front AS (SELECT scenario, f1, f2, f3 FROM sol a WHERE NOT EXISTS (SELECT 1 FROM sol b WHERE b.scenario = a.scenario AND {BEATS}))"
REF = f"{FRONT}, ref AS (SELECT scenario, greatest(1.05e0 * max(f1), 1e-6) AS r1, greatest(1.05e0 * max(f2), 1e-6) AS r2, greatest(1.05e0 * max(f3), 1e-6) AS r3 FROM front GROUP BY 1)"
R3 = "round(f1, 6) AS f1, round(f2, 6) AS f2, round(f3, 6) AS f3"


@query("skyline", f"WITH {SOL} SELECT scenario, method, id, {R3} FROM sol a WHERE NOT EXISTS (SELECT 1 FROM sol b WHERE b.scenario = a.scenario AND b.method = a.method AND {BEATS})")
def skyline(spark, sf):
    return rounded(pareto.skyline(solutions(spark, sf), OBJ, ["scenario", "method"]), OBJ)


@query("union_front", f"WITH {FRONT} SELECT scenario, {R3} FROM front")
def union_front(spark, sf):
    return rounded(pareto.union_front(solutions(spark, sf), OBJ), OBJ)


@query("dedupe_front", f"""WITH {FRONT}, r AS (SELECT DISTINCT scenario, round(f1, 1) AS f1, round(f2, 1) AS f2, round(f3, 1) AS f3 FROM front)
 SELECT * FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.scenario = a.scenario AND {BEATS})""")
def dedupe_front(spark, sf):
    return pareto.dedupe_front(pareto.union_front(solutions(spark, sf), OBJ), OBJ, ["scenario"], 1)


@query("reference_point", f"WITH {REF} SELECT scenario, round(r1, 6) AS ref_f1, round(r2, 6) AS ref_f2, round(r3, 6) AS ref_f3 FROM ref")
def reference_point(spark, sf):
    return rounded(pareto.reference_point(pareto.union_front(solutions(spark, sf), OBJ), OBJ), ["ref_f1", "ref_f2", "ref_f3"])


@query("coverage", f"""WITH {SOL}, m AS (SELECT DISTINCT scenario, method AS a FROM sol), t AS (SELECT m.a, s.scenario, s.method AS b,
 EXISTS (SELECT 1 FROM sol p WHERE p.scenario = s.scenario AND p.method = m.a AND p.f1 <= s.f1 + 1e-9 AND p.f2 <= s.f2 + 1e-9 AND p.f3 <= s.f3 + 1e-9) AS hit FROM sol s JOIN m ON m.scenario = s.scenario AND m.a <> s.method)
 SELECT scenario, a, b, round(avg(hit::INT), 6) AS coverage FROM t GROUP BY 1, 2, 3""")
def coverage(spark, sf):
    return rounded(pareto.coverage(solutions(spark, sf), OBJ), ["coverage"])


NEAR = "abs(s.f1 - f.f1) <= 1e-9 AND abs(s.f2 - f.f2) <= 1e-9 AND abs(s.f3 - f.f3) <= 1e-9"


@query("front_recall", f"""WITH {FRONT}, m AS (SELECT DISTINCT scenario, method FROM sol) SELECT m.scenario, m.method,
 round(avg(EXISTS (SELECT 1 FROM sol s WHERE s.scenario = f.scenario AND s.method = m.method AND {NEAR})::INT), 6) AS recall FROM m JOIN front f USING (scenario) GROUP BY 1, 2""")
def front_recall(spark, sf):
    s = solutions(spark, sf)
    return rounded(pareto.recall(s, pareto.union_front(s, OBJ), OBJ), ["recall"])


@query("additive_epsilon", f"""WITH {FRONT}, g AS (SELECT f.scenario, s.method, f.f1, f.f2, f.f3, min(greatest(s.f1 - f.f1, s.f2 - f.f2, s.f3 - f.f3)) AS gap
 FROM front f JOIN sol s ON s.scenario = f.scenario GROUP BY ALL) SELECT scenario, method, round(max(gap), 6) + 0 AS epsilon FROM g GROUP BY 1, 2""")
def additive_epsilon(spark, sf):
    s = solutions(spark, sf)
    return rounded(pareto.additive_epsilon(s, pareto.union_front(s, OBJ), OBJ), ["epsilon"])


HV = f"""{REF}, pts AS (SELECT DISTINCT s.scenario, s.method, s.f1, s.f2, s.f3 FROM sol s JOIN ref USING (scenario) WHERE f1 < r1 - 1e-9 AND f2 < r2 - 1e-9 AND f3 < r3 - 1e-9),
 pf AS (SELECT * FROM pts a WHERE NOT EXISTS (SELECT 1 FROM pts b WHERE b.scenario = a.scenario AND b.method = a.method AND {BEATS})),
 a1 AS (SELECT scenario, method, v AS lo, lead(v) OVER (PARTITION BY scenario, method ORDER BY v) AS hi FROM (SELECT scenario, method, f1 AS v FROM pf UNION SELECT DISTINCT scenario, method, r1 FROM pf JOIN ref USING (scenario))),
 a2 AS (SELECT scenario, method, v AS lo, lead(v) OVER (PARTITION BY scenario, method ORDER BY v) AS hi FROM (SELECT scenario, method, f2 AS v FROM pf UNION SELECT DISTINCT scenario, method, r2 FROM pf JOIN ref USING (scenario))),
 a3 AS (SELECT scenario, method, v AS lo, lead(v) OVER (PARTITION BY scenario, method ORDER BY v) AS hi FROM (SELECT scenario, method, f3 AS v FROM pf UNION SELECT DISTINCT scenario, method, r3 FROM pf JOIN ref USING (scenario))),
 box AS (SELECT a1.scenario, a1.method, a1.lo AS x, a2.lo AS y, a3.lo AS z, (a1.hi - a1.lo) * (a2.hi - a2.lo) * (a3.hi - a3.lo) AS vol FROM a1 JOIN a2 USING (scenario, method) JOIN a3 USING (scenario, method) WHERE a1.hi IS NOT NULL AND a2.hi IS NOT NULL AND a3.hi IS NOT NULL)
 SELECT scenario, method, round(sum(vol), 3) AS hypervolume FROM box b WHERE EXISTS (SELECT 1 FROM pf p WHERE p.scenario = b.scenario AND p.method = b.method AND p.f1 <= b.x + 1e-9 AND p.f2 <= b.y + 1e-9 AND p.f3 <= b.z + 1e-9) GROUP BY 1, 2"""


@query("hypervolume", f"WITH {HV}")
def hypervolume(spark, sf):
    s = solutions(spark, sf)
    ref = pareto.reference_point(pareto.union_front(s, OBJ), OBJ)
    return rounded(pareto.hypervolume(s, ref, OBJ), ["hypervolume"], 3)


HV_STEPS = ", ".join(f"a{k} AS (SELECT scenario, method, v AS lo, lead(v) OVER (PARTITION BY scenario, method ORDER BY v) AS hi FROM (SELECT scenario, method, f{k} AS v FROM pf UNION SELECT DISTINCT scenario, method, r{k} FROM pf JOIN ref USING (scenario)))" for k in (1, 2, 3))
#: Methods of the measures; the last one never has a route.
METHODS = ("F", "O", "none")
METRICS = f"""{REF}, runs AS (SELECT scenario, method, true AS feasible, count(*) AS n FROM sol GROUP BY 1, 2 UNION ALL SELECT DISTINCT scenario, 'none', false, 0 FROM sol),
 pts AS (SELECT DISTINCT s.* FROM (SELECT scenario, method, f1, f2, f3 FROM sol UNION ALL SELECT scenario, '#', f1, f2, f3 FROM front) s JOIN ref USING (scenario) WHERE f1 < r1 - 1e-9 AND f2 < r2 - 1e-9 AND f3 < r3 - 1e-9),
 pf AS (SELECT * FROM pts a WHERE NOT EXISTS (SELECT 1 FROM pts b WHERE b.scenario = a.scenario AND b.method = a.method AND {BEATS})), {HV_STEPS},
 box AS (SELECT a1.scenario, a1.method, a1.lo AS x, a2.lo AS y, a3.lo AS z, (a1.hi - a1.lo) * (a2.hi - a2.lo) * (a3.hi - a3.lo) AS vol FROM a1 JOIN a2 USING (scenario, method) JOIN a3 USING (scenario, method) WHERE a1.hi IS NOT NULL AND a2.hi IS NOT NULL AND a3.hi IS NOT NULL),
 hv AS (SELECT scenario, method, sum(vol) AS hv FROM box b WHERE EXISTS (SELECT 1 FROM pf p WHERE p.scenario = b.scenario AND p.method = b.method AND p.f1 <= b.x + 1e-9 AND p.f2 <= b.y + 1e-9 AND p.f3 <= b.z + 1e-9) GROUP BY 1, 2),
 gap AS (SELECT f.scenario, s.method, min(greatest(s.f1 - f.f1, s.f2 - f.f2, s.f3 - f.f3)) AS gap FROM front f JOIN sol s ON s.scenario = f.scenario GROUP BY f.scenario, s.method, f.f1, f.f2, f.f3),
 eps AS (SELECT scenario, method, max(gap) AS eps FROM gap GROUP BY 1, 2),
 rec AS (SELECT m.scenario, m.method, avg(EXISTS (SELECT 1 FROM sol s WHERE s.scenario = f.scenario AND s.method = m.method AND {NEAR})::INT) AS rec FROM runs m JOIN front f USING (scenario) GROUP BY 1, 2),
 cov AS (SELECT r.scenario, r.method AS a, s.method AS b, avg(EXISTS (SELECT 1 FROM sol p WHERE p.scenario = s.scenario AND p.method = r.method AND p.f1 <= s.f1 + 1e-9 AND p.f2 <= s.f2 + 1e-9 AND p.f3 <= s.f3 + 1e-9)::INT) AS cov
  FROM runs r JOIN sol s ON s.scenario = r.scenario AND s.method <> r.method GROUP BY 1, 2, 3),
 measured AS (SELECT r.scenario, r.method, r.feasible, r.n, round(coalesce(h.hv, 0), 3) AS hypervolume, round(CASE WHEN u.hv > 1e-9 THEN coalesce(h.hv, 0) / u.hv ELSE r.feasible::INT END, 6) AS normalized_hypervolume,
  round(eps, 6) + 0 AS additive_epsilon, round(coalesce(rec, 0), 6) AS union_front_recall, round(r1, 6) AS q1, round(r2, 6) AS q2, round(r3, 6) AS q3,
  {", ".join(f"(SELECT round(cov, 6) FROM cov WHERE cov.scenario = r.scenario AND cov.a = r.method AND cov.b = '{m}') AS coverage_of_{m}" for m in METHODS)}
  FROM runs r JOIN ref USING (scenario) LEFT JOIN hv h USING (scenario, method) LEFT JOIN hv u ON u.scenario = r.scenario AND u.method = '#' LEFT JOIN eps USING (scenario, method) LEFT JOIN rec USING (scenario, method))"""
COVERS = [f"coverage_of_{m}" for m in METHODS]


def scenario_runs(spark: SparkSession, sf: str) -> DataFrame:
    """A run for each scenario and method, and one without a route for each scenario."""
    s = solutions(spark, sf)
    own = s.groupBy("scenario", "method").agg(F.lit(True).alias("feasible"), F.count("*").alias("n"))
    return own.union(s.select("scenario").distinct().select("scenario", F.lit("none").alias("method"), F.lit(False).alias("feasible"), F.lit(0).cast("long").alias("n")))


@query("scenario_metrics", f"WITH {METRICS} SELECT scenario, method, feasible, hypervolume, normalized_hypervolume, additive_epsilon, union_front_recall, q1 AS ref_f1, q2 AS ref_f2, q3 AS ref_f3, {', '.join(COVERS)} FROM measured")
def scenario_metrics(spark, sf):
    m = pareto.scenario_metrics(solutions(spark, sf), OBJ, runs=scenario_runs(spark, sf))
    m = m.select("*", *[F.try_element_at("coverage", F.lit(x)).alias(f"coverage_of_{x}") for x in METHODS]).drop("coverage")
    return rounded(rounded(m, ["normalized_hypervolume", "additive_epsilon", "union_front_recall", "ref_f1", "ref_f2", "ref_f3", *COVERS]), ["hypervolume"], 3)


@query("summary_rows", f"""WITH {METRICS}, best AS (SELECT scenario, method, min(f1) AS b1, min(f2) AS b2, min(f3) AS b3 FROM sol GROUP BY 1, 2)
 SELECT scenario, 'lineitem' AS source, method, feasible, n * 0.5e0 AS runtime_ms, n AS n_expanded, 2 * n AS n_generated, CASE WHEN feasible THEN n * 2e0 END AS peak_memory_kib, n AS solution_count,
  round(b1, 6) AS best_f1_time_s, round(b2, 6) AS best_f2_nav_deficit_s, round(b3, 6) AS best_f3_visibility_deficit_s, hypervolume, normalized_hypervolume, additive_epsilon, union_front_recall,
  q1 AS reference_f1, q2 AS reference_f2, q3 AS reference_f3, {', '.join(COVERS)} FROM measured LEFT JOIN best USING (scenario, method)""")
def summary_rows(spark, sf):
    n = F.col("n")
    r = scenario_runs(spark, sf).select("scenario", F.lit("lineitem").alias("source"), "method", "feasible", (n * 0.5).alias("runtime_ms"), n.alias("n_expanded"), (2 * n).alias("n_generated"), F.when(F.col("feasible"), n * 2.0).alias("peak_memory_kib"))
    rows = pareto.summary_rows(solutions(spark, sf), r, OBJ, list(METHODS))
    return rounded(rounded(rows, ["normalized_hypervolume", "additive_epsilon", "union_front_recall", *pareto.BEST, *pareto.REFERENCE, *COVERS]), ["hypervolume"], 3)


def topsis_sql(weights, source="sol") -> str:
    w1, w2, w3 = (f"{w}e0" for w in weights)
    v = lambda o, w: f"{o} / CASE WHEN n{o} > 0 THEN n{o} ELSE 1 END * {w}"
    return f"""n AS (SELECT scenario, sqrt(sum(f1 * f1)) AS nf1, sqrt(sum(f2 * f2)) AS nf2, sqrt(sum(f3 * f3)) AS nf3 FROM {source} GROUP BY 1),
 v AS (SELECT s.*, {v('f1', w1)} AS v1, {v('f2', w2)} AS v2, {v('f3', w3)} AS v3 FROM {source} s JOIN n USING (scenario)),
 i AS (SELECT scenario, min(v1) AS l1, min(v2) AS l2, min(v3) AS l3, max(v1) AS h1, max(v2) AS h2, max(v3) AS h3 FROM v GROUP BY 1),
 dd AS (SELECT v.*, sqrt((v1-l1)**2 + (v2-l2)**2 + (v3-l3)**2) AS dp, sqrt((v1-h1)**2 + (v2-h2)**2 + (v3-h3)**2) AS dn FROM v JOIN i USING (scenario)),
 cl AS (SELECT *, CASE WHEN dp + dn > 0 THEN dn / (dp + dn) ELSE 0.5e0 END AS closeness FROM dd),
 rk AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY round(closeness, 12) DESC, id, method) AS rank FROM cl)"""


def tied(spark, sf):
    return solutions(spark, sf).withColumn("key", F.struct("id", "method"))


@query("topsis", f"WITH {SOL}, {topsis_sql((0.5, 0.3, 0.2))} SELECT scenario, method, id, round(closeness, 6) AS closeness, rank::INT AS rank FROM rk")
def topsis(spark, sf):
    return rounded(decision.topsis(tied(spark, sf), OBJ, [0.5, 0.3, 0.2], ["scenario"], "key").select("scenario", "method", "id", "closeness", "rank"), ["closeness"])


@query("top_routes", f"WITH {SOL}, {topsis_sql((0.5, 0.3, 0.2))} SELECT scenario, method, id, round(closeness, 6) AS closeness, rank::INT AS rank, rank = 1 AS selected FROM rk WHERE rank <= 5")
def top_routes(spark, sf):
    """The five best routes of each scenario (the panel is the limit)."""
    rows = routes.ranked(tied(spark, sf), ["scenario"], "key")
    return rounded(routes.best(rows, 5).select("scenario", "method", "id", "closeness", "rank", "selected"), ["closeness"])


@query("profile_selection", " UNION ALL ".join(f"SELECT * FROM (WITH {SOL}, {topsis_sql(w)} SELECT '{p}' AS profile, scenario, method, id, round(closeness, 6) AS closeness FROM rk WHERE rank = 1)" for p, w in decision.PROFILES.items()))
def profile_selection(spark, sf):
    return rounded(decision.profile_selection(tied(spark, sf), OBJ, ["scenario"], "key").select("profile", "scenario", "method", "id", "closeness"), ["closeness"])


@query("profile_premiums", f"""WITH {SOL}, own AS (SELECT scenario AS sc, scenario || '|' || method AS scenario, method, id, f1, f2, f3 FROM sol), picks AS (""" + " UNION ALL ".join(f"SELECT * FROM (WITH {topsis_sql(w, 'own')} SELECT '{p}' AS profile, sc, method, f1, f2, f3 FROM rk WHERE rank = 1)" for p, w in decision.PROFILES.items()) + """)
 SELECT p.sc AS scenario, p.method, p.profile, round(p.f1, 6) AS f1, round(p.f2, 6) AS f2, round(p.f3, 6) AS f3, round(p.f1 - b.f1, 6) + 0 AS time_premium, round(b.f2 - p.f2, 6) + 0 AS nav_improvement, round(b.f3 - p.f3, 6) + 0 AS visibility_improvement
 FROM picks p LEFT JOIN picks b ON b.sc = p.sc AND b.profile = p.profile AND b.method = 'F'""")
def profile_premiums(spark, sf):
    return rounded(decision.premiums(tied(spark, sf), OBJ, "F", "key"), [*OBJ, "time_premium", "nav_improvement", "visibility_improvement"])


@query("representative_routes", f"""WITH {SOL}, {topsis_sql((0.5, 0.3, 0.2))}, c AS (SELECT *, count(*) OVER (PARTITION BY scenario, method) AS n, row_number() OVER (PARTITION BY scenario, method ORDER BY rank) AS b0,
  row_number() OVER (PARTITION BY scenario, method ORDER BY f1, id) AS b1, row_number() OVER (PARTITION BY scenario, method ORDER BY f2, id) AS b2, row_number() OVER (PARTITION BY scenario, method ORDER BY f3, id) AS b3 FROM rk)
 SELECT scenario, method, id, rank::INT AS rank FROM c WHERE n <= 8 OR 1 IN (b0, b1, b2, b3)""")
def representative_routes(spark, sf):
    return routes.representative(routes.ranked(tied(spark, sf), ["scenario"], "key"), ["scenario", "method"], "id").select("scenario", "method", "id", "rank")


@query("best_per_objective", f"WITH {SOL} SELECT scenario, method, round(min(f1), 6) AS best_f1, first(id ORDER BY f1, id) AS best_f1_id, round(min(f2), 6) AS best_f2, first(id ORDER BY f2, id) AS best_f2_id, round(min(f3), 6) AS best_f3, first(id ORDER BY f3, id) AS best_f3_id FROM sol GROUP BY 1, 2")
def best_per_objective(spark, sf):
    return rounded(decision.best_per_objective(solutions(spark, sf), OBJ, ["scenario", "method"], "id"), ["best_f1", "best_f2", "best_f3"])


@query("landing_candidates", f"WITH {SLOPE} SELECT x, y, vis, round(slope, 6) AS slope FROM slopes WHERE NOT occ AND vis >= 0.5 AND slope <= 2")
def landing_candidates(spark, sf):
    return rounded(raster.landing_candidates(grid(spark, sf), 10.0, ["case_id"], 0.5, 2.0).select("x", "y", "vis", "slope"), ["slope"])


@query("landing_sites", f"""WITH {SLOPE}, k AS (SELECT sqrt(490e0 * 490 + 30 * 30) AS len), c AS (SELECT x, y, vis, slope, (10e0 * x * 490 + 10e0 * y * 30) / len AS al, abs(10e0 * x * 30 - 10e0 * y * 490) / len AS off, len
 FROM slopes, k WHERE NOT occ AND vis >= 0.5 AND slope <= 2), b AS (SELECT *, least(trunc(al / len * 10), 9)::INT AS band FROM c WHERE al >= 0 AND al <= len AND off <= greatest(30, 0.2e0 * len)),
 r AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY vis DESC, slope, round(off, 9), round(abs(al / len - (band + 0.5e0) / 10), 9), y, x) AS rn FROM b)
 SELECT band, x, y, vis, round(slope, 6) AS slope FROM r WHERE rn = 1""")
def landing_sites(spark, sf):
    return rounded(raster.landing_sites(grid(spark, sf), 10.0, (0, 0), (49, 3), ["case_id"], 10, 0.5, 2.0).drop("case_id"), ["slope"])


def zone_sql() -> str:
    tests = []
    for ring in ZONES:
        inside = []
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            side = ", ".join(f"({bx - ax}e0) * (({y}) - ({ay}e0)) - ({by - ay}e0) * (({x}) - ({ax}e0))" for x in ("x0", "x1") for y in ("y0", "y1"))
            tests.append(f"(x0 <= {max(ax, bx)}e0 AND x1 >= {min(ax, bx)}e0 AND y0 <= {max(ay, by)}e0 AND y1 >= {min(ay, by)}e0 AND greatest({side}) >= 0 AND least({side}) <= 0)")
            if ay != by:
                inside.append(f"((y0 + y1) / 2 >= {min(ay, by)}e0 AND (y0 + y1) / 2 < {max(ay, by)}e0 AND (x0 + x1) / 2 < {ax}e0 + ((y0 + y1) / 2 - {ay}e0) * ({bx - ax}e0) / ({by - ay}e0))::INT")
        tests.append(f"(({' + '.join(inside)}) % 2 = 1)")
    return " OR ".join(tests)


@query("zone_visibility", f"""WITH {GRID}, d AS (SELECT max(x) + 1 AS w, max(y) + 1 AS h FROM grid), b AS (SELECT x, y, 1000e0 + x * (1500e0 / w) AS x0, 1000e0 + (x + 1) * (1500e0 / w) AS x1, 1700e0 - (y + 1) * (1200e0 / h) AS y0, 1700e0 - y * (1200e0 / h) AS y1 FROM grid, d)
 SELECT x, y, CASE WHEN {zone_sql()} THEN 0.35e0 ELSE 1e0 END AS visibility FROM b""")
def zone_visibility(spark, sf):
    z = raster.in_zones(grid(spark, sf), ZONES, EXTENT, ["case_id"])
    return z.select("x", "y", F.when(F.col("in_zone"), 0.35).otherwise(1.0).alias("visibility"))


@query("time_to_landing", f"""WITH RECURSIVE {EDGES}, tt AS (SELECT x, y, 0e0 AS cost FROM grid WHERE dem = 2 AND NOT occ),
 r(x, y, cost) USING KEY (x, y) AS (SELECT x, y, cost FROM tt UNION
  (SELECT e.x, e.y, min(e.c1 + r.cost) AS cost FROM edges e JOIN r ON r.x = e.x1 AND r.y = e.y1 LEFT JOIN recurring.r AS k ON k.x = e.x AND k.y = e.y
   WHERE k.cost IS NULL OR e.c1 + r.cost < k.cost - 1e-12 GROUP BY e.x, e.y)) SELECT x, y, round(cost, 6) AS cost FROM r""")
def time_to_landing(spark, sf):
    c = grid(spark, sf)
    e = edges.edges(c, params(spark))
    t = c.filter("dem = 2 and not occ").select("case_id", "x", "y")
    return rounded(paths.cost_to_targets(e, t, "c1", ["case_id", "x", "y"], ["case_id", "x1", "y1"]).drop("case_id"), ["cost"])


@query("time_to_landing_turns", f"""WITH RECURSIVE {EDGES}, mv AS (SELECT f.x1 AS x, f.y1 AS y, f.dx AS hx, f.dy AS hy, s.dx, s.dy, s.x1, s.y1, s.c1 AS w, sqrt(f.dx * f.dx + f.dy * f.dy) AS l1, sqrt(s.dx * s.dx + s.dy * s.dy) AS l2 FROM edges f JOIN edges s ON s.x = f.x1 AND s.y = f.y1),
 hf AS (SELECT *, sqrt(greatest((1 - greatest(-1, least(1, (hx * dx + hy * dy) / (l1 * l2)))) / 2, 0)) AS half FROM mv), ok AS (SELECT * FROM hf WHERE half <= 1e-12 OR least(l1, l2) * 10 / (2 * half) + 1e-12 >= 8),
 tt AS (SELECT x, y, dx AS hx, dy AS hy, 0e0 AS cost FROM grid, steps WHERE dem = 2 AND NOT occ),
 r(x, y, hx, hy, cost) USING KEY (x, y, hx, hy) AS (SELECT x, y, hx, hy, cost FROM tt UNION
  (SELECT e.x, e.y, e.hx, e.hy, min(e.w + r.cost) AS cost FROM ok e JOIN r ON r.x = e.x1 AND r.y = e.y1 AND r.hx = e.dx AND r.hy = e.dy
   LEFT JOIN recurring.r AS k ON k.x = e.x AND k.y = e.y AND k.hx = e.hx AND k.hy = e.hy
   WHERE k.cost IS NULL OR e.w + r.cost < k.cost - 1e-12 GROUP BY e.x, e.y, e.hx, e.hy)) SELECT x, y, hx::INT AS hx, hy::INT AS hy, round(cost, 6) AS cost FROM r""")
def time_to_landing_turns(spark, sf):
    c = grid(spark, sf)
    e = edges.edges(c, params(spark))
    moves = paths.heading_edges(edges.turns(e, params(spark)), e, "c1")
    heads = F.explode(F.array(*[F.struct(F.lit(a).alias("hx"), F.lit(b).alias("hy")) for a, b in S.STEPS])).alias("s")
    t = c.filter("dem = 2 and not occ").select("case_id", "x", "y", heads).select("case_id", "x", "y", "s.*")
    return rounded(paths.cost_to_targets(moves, t, "w", ["case_id", "x", "y", "hx", "hy"], ["case_id", "x1", "y1", "dx", "dy"]).drop("case_id"), ["cost"])


@query("components", f"""WITH RECURSIVE {GRID}, c AS (SELECT x, y, y * 4294967296::BIGINT + x AS id FROM grid WHERE nav < 0.3), n AS (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
 r AS (SELECT a, b FROM n UNION SELECT r.a, n.b FROM r JOIN n ON r.b = n.a), m AS (SELECT a, min(b) AS lab FROM r GROUP BY a)
 SELECT x, y, (dense_rank() OVER (ORDER BY lab) - 1)::INT AS component FROM c JOIN m ON m.a = c.id""")
def components(spark, sf):
    return paths.grid_components(grid(spark, sf).filter("nav < 0.3"), ["case_id"]).drop("case_id")


TURNS = f"""{EDGES}, t AS (SELECT f.dx AS hx, f.dy AS hy, s.dx, s.dy, greatest(-1, least(1, (f.dx * s.dx + f.dy * s.dy) / (sqrt(f.dx * f.dx + f.dy * f.dy) * sqrt(s.dx * s.dx + s.dy * s.dy)))) AS co,
  least(sqrt(f.dx * f.dx + f.dy * f.dy), sqrt(s.dx * s.dx + s.dy * s.dy)) AS l FROM edges f JOIN edges s ON s.x = f.x1 AND s.y = f.y1),
 q AS (SELECT *, sqrt(greatest((1 - co) / 2, 0)) AS half FROM t)"""


@query("vehicle_transform", f"""WITH {TURNS} SELECT vehicle, count(*) AS turns, sum((half <= 1e-12 OR l * 10 / (2 * half) + 1e-12 >= r)::INT)::BIGINT AS allowed
 FROM q, (VALUES ('multirotor', 0e0), ('fixed_wing_vtol', 40e0)) v(vehicle, r) GROUP BY 1""")
def vehicle_transform(spark, sf):
    """Turns of the grid that each vehicle may take."""
    e = edges.edges(grid(spark, sf), params(spark))
    found = None
    for name, _ in campaign.VEHICLES:
        one = edges.turns(e, campaign.apply_vehicle(params(spark), name)).agg(F.lit(name).alias("vehicle"), F.count("*").alias("turns"), F.count_if("feasible").alias("allowed"))
        found = one if found is None else found.unionByName(one)
    return found


@query("turn_feasible", f"""WITH {TURNS} SELECT hx::INT AS hx, hy::INT AS hy, dx::INT AS dx, dy::INT AS dy, count(*) AS n, min(half <= 1e-12 OR l * 10 / (2 * half) + 1e-12 >= 8) AS feasible FROM q GROUP BY 1, 2, 3, 4""")
def turn_feasible(spark, sf):
    e = edges.edges(grid(spark, sf), params(spark))
    return edges.turns(e, params(spark)).groupBy("hx", "hy", "dx", "dy").agg(F.count("*").alias("n"), F.min("feasible").alias("feasible"))


def order_routes(spark, sf):
    """Customers' orders as routes over the first cells of the grid, and their totals."""
    o = load(spark, sf, "orders").select("o_orderkey", "o_custkey")
    k = F.col("o_orderkey") % 200
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    pts = o.select(F.col("o_custkey").alias("route_id"), F.lit("part").alias("case_id"), (F.row_number().over(w) - 1).alias("k"), (k % 50).cast("int").alias("x"), F.floor(k / 50).cast("int").alias("y"))
    n = F.count("*")
    tot = o.groupBy(F.col("o_custkey").alias("route_id")).agg(((n - 1) * 2.5).alias("f1"), ((n - 1) * 0.5).alias("f2"), ((n - 1) * 0.25).alias("f3"))
    return pts, tot


@query("route_characteristics", f"""WITH {GRID}, p AS (SELECT o_custkey AS route_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, ((o_orderkey % 200) % 50)::INT AS x, ((o_orderkey % 200) // 50)::INT AS y FROM orders),
 z AS (SELECT p.*, dem FROM p JOIN grid USING (x, y)), l AS (SELECT *, 10e0 * (lead(x) OVER w - x) AS dx, 10e0 * (lead(y) OVER w - y) AS dy, lead(dem) OVER w - dem AS dz FROM z WINDOW w AS (PARTITION BY route_id ORDER BY k)),
 m AS (SELECT route_id, count(*) AS points, coalesce(sum(sqrt(dx * dx + dy * dy)), 0) AS len, coalesce(sum(sqrt(dx * dx + dy * dy + dz * dz)), 0) AS len3, min(dem) + 5 AS lo, max(dem) + 5 AS hi, (count(*) - 1) * 2.5e0 AS t FROM l GROUP BY 1)
 SELECT route_id, points, round(len, 5) AS length_m, round(len3, 5) AS length_3d_m, lo AS min_altitude_m, hi AS max_altitude_m, round(CASE WHEN t > 0 THEN len / t ELSE 0 END, 5) AS mean_speed_mps,
  round(CASE WHEN t > 0 THEN 1 - t / 5 / t ELSE 1 END, 5) AS mean_navigation, round(CASE WHEN t > 0 THEN 1 - t / 10 / t ELSE 1 END, 5) AS mean_visibility, round(300 * t / 3600, 5) AS energy_wh, round(40 - 300 * t / 3600, 5) AS energy_left_wh FROM m""")
def route_characteristics(spark, sf):
    pts, tot = order_routes(spark, sf)
    r = routes.characteristics(pts, tot, grid(spark, sf), params(spark), ["route_id"]).drop("f1", "f2", "f3")
    return rounded(r, ["length_m", "length_3d_m", "mean_speed_mps", "mean_navigation", "mean_visibility", "energy_wh", "energy_left_wh"], 5)


@query("campaign_matrix", """WITH w AS (SELECT * FROM (VALUES (0,'calm_clear',0e0,1e0),(1,'headwind_clear',0.65e0,1e0),(2,'crosswind_clear',0.65e0,1e0),(3,'moderate_degradation',0.25e0,0.6e0),(4,'severe_degradation',0.35e0,0.25e0)) t(i, weather, speed_fraction, visibility_factor)),
 f AS (SELECT unnest(['lake','foggy_valley','terrain','realistic']) AS family), n AS (SELECT unnest(range(30))::INT AS variant), v AS (SELECT * FROM (VALUES ('multirotor', 0e0), ('fixed_wing_vtol', 40e0)) t(vehicle, min_turn_radius_m))
 SELECT 'synthetic_' || family || '_' || lpad(variant::VARCHAR, 2, '0') || '_' || weather || '_' || vehicle AS case_id, family, variant, weather, vehicle, speed_fraction, visibility_factor, min_turn_radius_m FROM f, n JOIN w ON w.i = variant % 5, v""")
def campaign_matrix(spark, sf):
    return campaign.matrix(spark).select("case_id", "family", "variant", "weather", "vehicle", "speed_fraction", "visibility_factor", "min_turn_radius_m")


@query("weather_transform", f"""WITH {GRID}, w AS (SELECT * FROM (VALUES ('calm_clear','calm',0e0,1e0),('headwind_clear','headwind',0.65e0,1e0),('crosswind_clear','crosswind',0.65e0,1e0),('moderate_degradation','crosswind',0.25e0,0.6e0),('severe_degradation','headwind',0.35e0,0.25e0)) t(case_id, wind, sf, vf)),
 k AS (SELECT 49 / sqrt(49e0 * 49 + 9) AS hx, -3 / sqrt(49e0 * 49 + 9) AS hy), d AS (SELECT case_id, vf, 12 * sf * CASE wind WHEN 'headwind' THEN -hx WHEN 'crosswind' THEN -hy ELSE 0 END AS px, 12 * sf * CASE wind WHEN 'headwind' THEN -hy WHEN 'crosswind' THEN hx ELSE 0 END AS py FROM w, k),
 g AS (SELECT case_id, x, y, u + px AS u, v + py AS v, greatest(0, least(1, vis * vf)) AS vis FROM grid, d), s AS (SELECT *, least(1, 10.8e0 / greatest(sqrt(u * u + v * v), 1e-12)) AS q FROM g)
 SELECT case_id, x, y, round(u * q, 6) + 0 AS u, round(v * q, 6) + 0 AS v, round(vis, 6) AS vis FROM s""")
def weather_transform(spark, sf):
    sky = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k).alias("wind"), F.lit(s).alias("speed_fraction"), F.lit(f).alias("visibility_factor")) for n, k, s, f in campaign.WEATHER])).alias("w")
    p = params(spark).select("*", sky).select("*", "w.*").withColumn("case_id", F.col("name"))
    names = F.explode(F.array(*[F.lit(w[0]) for w in campaign.WEATHER])).alias("name")
    c = grid(spark, sf).select("*", names).withColumn("case_id", F.col("name")).drop("name")
    return rounded(campaign.apply_weather(c, p).select("case_id", "x", "y", "u", "v", "vis"), ["u", "v", "vis"])


@query("ablation", f"WITH {GRID} SELECT x, y, vis AS nav, 'visual_only' AS mode FROM grid UNION ALL SELECT x, y, dem / 100 AS nav, 'terrain_only' FROM grid UNION ALL SELECT x, y, nav, 'full' FROM grid")
def ablation(spark, sf):
    c = grid(spark, sf).withColumn("visual_richness", F.col("vis")).withColumn("rugosity", F.col("dem") / 100)
    out = [campaign.apply_ablation(c, m).select("x", "y", "nav", F.lit(m).alias("mode")) for m in ("visual_only", "terrain_only", "full")]
    return out[0].union(out[1]).union(out[2])


def runs(spark, sf):
    o = load(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("scenario"), F.col("o_orderpriority").alias("method"), (F.col("o_orderstatus") != "F").alias("feasible"), F.col("o_totalprice").alias("runtime_ms"))


@query("group_aggregate", """SELECT o_orderpriority AS method, sum((o_orderstatus <> 'F')::INT)::BIGINT AS instances, round(avg((o_orderstatus <> 'F')::INT), 6) AS feasibility_rate,
 round(quantile_cont(o_totalprice, 0.25) FILTER (o_orderstatus <> 'F'), 4) AS runtime_ms_q1, round(quantile_cont(o_totalprice, 0.5) FILTER (o_orderstatus <> 'F'), 4) AS runtime_ms_median, round(quantile_cont(o_totalprice, 0.75) FILTER (o_orderstatus <> 'F'), 4) AS runtime_ms_q3 FROM orders GROUP BY 1""")
def group_aggregate(spark, sf):
    g = stats.group_quartiles(runs(spark, sf), ["method"], ["runtime_ms"])
    return rounded(rounded(g, ["feasibility_rate"]), ["runtime_ms_q1", "runtime_ms_median", "runtime_ms_q3"], 4)


PAIRS = """r AS (SELECT o_custkey AS scenario, o_orderpriority AS method, o_totalprice AS m, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey DESC) AS rn FROM orders WHERE o_orderstatus <> 'F'),
 p AS (SELECT a.scenario, a.m - b.m AS diff FROM r a JOIN r b ON a.scenario = b.scenario AND a.rn = 1 AND b.rn = 1 AND a.method = (SELECT min(o_orderpriority) FROM orders) AND b.method = (SELECT max(o_orderpriority) FROM orders))"""


def diffs(spark, sf):
    r = runs(spark, sf)
    ends = r.agg(F.min("method"), F.max("method")).first()
    return stats.pairs(r, "runtime_ms", ends[0], ends[1])


@query("paired_differences", f"WITH {PAIRS} SELECT scenario, round(diff, 4) + 0 AS diff FROM p")
def paired_differences(spark, sf):
    return rounded(diffs(spark, sf), ["diff"], 4)


@query("paired_stats", f"""WITH {PAIRS}, z AS (SELECT *, abs(diff) AS m FROM p WHERE abs(diff) > 1e-12), k AS (SELECT *, rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2e0 AS rk FROM z)
 SELECT (SELECT count(*) FROM p) AS n, (SELECT round(quantile_cont(diff, 0.5), 4) FROM p) AS median_difference, (SELECT round(avg((diff > 0)::INT), 6) FROM p) AS superiority_rate, round(sum(sign(diff) * rk) / sum(rk), 6) AS rank_biserial, count(*) AS nonzero FROM k""")
def paired_stats(spark, sf):
    d = stats.paired_summary(diffs(spark, sf))
    return rounded(rounded(d, ["median_difference"], 4), ["superiority_rate", "rank_biserial"])


@query("bootstrap_ci")
def bootstrap_ci(spark, sf):
    return stats.bootstrap_median(runs(spark, sf).filter("feasible").select("run_id", "method", "runtime_ms"), ["method"], "runtime_ms", order="run_id")


@query("wilcoxon", f"""WITH {PAIRS}, z AS (SELECT diff, abs(diff) AS m FROM p WHERE abs(diff) > 1e-12), k AS (SELECT *, rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2e0 AS rk, count(*) OVER (PARTITION BY m) AS t FROM z),
 s AS (SELECT count(*) AS nz, least(sum(rk) FILTER (diff > 0), sum(rk) FILTER (diff < 0)) AS low, sum(t * t - 1) AS ties FROM k),
 q AS (SELECT *, abs((low - nz * (nz + 1) / 4e0) / sqrt(nz * (nz + 1) * (2 * nz + 1) / 24e0 - ties / 48e0)) / sqrt(2e0) AS x FROM s)
 SELECT 'first_last' AS pair, (SELECT count(*) FROM p) AS n, nz AS nonzero, low AS statistic, round(1 - CASE WHEN x = 0 THEN 0 ELSE 2 / sqrt(pi()) * list_sum(list_transform(range(100), lambda i: CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END * exp((2 * i + 1) * ln(x) - lgamma(i + 1)) / (2 * i + 1))) END, 6) AS p_value FROM q""")
def wilcoxon(spark, sf):
    """The test by its normal approximation, which holds above 50 pairs."""
    return rounded(stats.wilcoxon(diffs(spark, sf).withColumn("pair", F.lit("first_last")), ["pair"]), ["p_value"])


@query("bilinear_resample", f"""WITH {GRID}, d AS (SELECT max(x) + 1 AS w, max(y) + 1 AS h FROM grid), p AS (SELECT x AS id_x, y AS id_y, least(greatest(x * 0.8e0 + 0.3e0, 0), w - 1) AS px, least(greatest(y * 0.7e0 - 0.4e0, 0), h - 1) AS py, w, h FROM grid, d),
 c AS (SELECT *, floor(px)::INT AS x0, floor(py)::INT AS y0 FROM p), q AS (SELECT id_x, id_y, least(x0 + i, w - 1) AS x, least(y0 + j, h - 1) AS y, CASE WHEN i = 1 THEN px - x0 ELSE 1 - px + x0 END * CASE WHEN j = 1 THEN py - y0 ELSE 1 - py + y0 END AS wt FROM c, (VALUES (0),(1)) a(i), (VALUES (0),(1)) b(j))
 SELECT id_x, id_y, round(sum(wt * dem) / sum(wt), 6) AS sample FROM q JOIN grid USING (x, y) WHERE wt > 0 GROUP BY 1, 2""")
def bilinear_resample(spark, sf):
    c = grid(spark, sf)
    pts = c.select("case_id", F.col("x").alias("id_x"), F.col("y").alias("id_y"), (F.col("x") * 0.8 + 0.3).alias("px"), (F.col("y") * 0.7 - 0.4).alias("py"))
    return rounded(raster.bilinear(pts, c, "dem", ["case_id"], ["id_x", "id_y"]).drop("case_id"), ["sample"])


@query("edge_profile", f"""WITH {GRID}, {STEPS}, d AS (SELECT max(x) + 1 AS w, max(y) + 1 AS h FROM grid), c AS (SELECT (x - 1) // 3 AS x, (y - 1) // 3 AS y, dem AS h FROM grid WHERE x % 3 = 1 AND y % 3 = 1),
 e AS (SELECT a.x, a.y, dx, dy, a.h AS h0, b.h AS h1, ceil(sqrt(dx * dx + dy * dy) * 3)::INT AS n FROM c a JOIN steps ON true JOIN c b ON b.x = a.x + dx AND b.y = a.y + dy),
 s AS (SELECT *, i / n::DOUBLE AS t FROM (SELECT *, unnest(range(n + 1)) AS i FROM e)),
 p AS (SELECT x, y, dx, dy, i, h0, h1, t, least(greatest(x * 3 + 1 + t * dx * 3, 0), w - 1) AS px, least(greatest(y * 3 + 1 + t * dy * 3, 0), d.h - 1) AS py, w, d.h AS hh FROM s, d),
 q AS (SELECT p.*, floor(px)::INT AS x0, floor(py)::INT AS y0 FROM p), k AS (SELECT q.x AS ex, q.y AS ey, dx, dy, q.i, h0, h1, t, least(x0 + a.i, w - 1) AS x, least(y0 + b.j, hh - 1) AS y, CASE WHEN a.i = 1 THEN px - x0 ELSE 1 - px + x0 END * CASE WHEN b.j = 1 THEN py - y0 ELSE 1 - py + y0 END AS wt FROM q, (VALUES (0),(1)) a(i), (VALUES (0),(1)) b(j)),
 v AS (SELECT ex, ey, dx, dy, i, h0, h1, t, sum(wt * dem) / sum(wt) AS z FROM k JOIN grid USING (x, y) WHERE wt > 0 GROUP BY ALL)
 SELECT ex::INT AS x, ey::INT AS y, dx::INT AS dx, dy::INT AS dy, round(max(z - (h0 + t * (h1 - h0))), 5) + 0 AS excess_m FROM v GROUP BY 1, 2, 3, 4""")
def edge_profile(spark, sf):
    c = grid(spark, sf).withColumn("value", F.col("dem"))
    centres = c.filter("x % 3 = 1 and y % 3 = 1").select("case_id", F.floor((F.col("x") - 1) / 3).cast("int").alias("x"), F.floor((F.col("y") - 1) / 3).cast("int").alias("y"), F.col("dem").alias("height"))
    return rounded(raster.edge_profiles(c, centres, 3, ["case_id"]).drop("case_id"), ["excess_m"], 5)


@query("point_to_cell", """WITH b AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer) SELECT c_custkey, greatest(0, least(49, trunc((c_acctbal - lo) * 50 / (hi - lo))))::INT AS col FROM customer, b""")
def point_to_cell(spark, sf):
    c = load(spark, sf, "customer").select("c_custkey", "c_acctbal")
    lo, hi = c.agg(F.min("c_acctbal"), F.max("c_acctbal")).first()
    return c.select("c_custkey", S.point_to_cell(F.col("c_acctbal"), F.lit(lo), F.lit(hi), F.lit(50)).alias("col"))


@query("cell_coordinates", f"WITH {GRID}, d AS (SELECT max(x) + 1 AS w, max(y) + 1 AS h FROM grid) SELECT x, y, round(1000 + (x + 0.5e0) * 1500 / w, 6) AS east, round(1700 - (y + 0.5e0) * 1200 / h, 6) AS north FROM grid, d")
def cell_coordinates(spark, sf):
    return rounded(raster.cell_coordinates(grid(spark, sf), EXTENT, ["case_id"]).drop("case_id"), ["east", "north"])


@query("text_map", f"""WITH {GRID} SELECT y, string_agg(CASE WHEN x = y THEN '*' WHEN x = 0 AND y = 0 THEN 'S' WHEN x = 49 AND y = 3 THEN 'G' WHEN occ THEN 'X' WHEN nav < 0.5 THEN '~' WHEN (x = 7 AND y = 1) OR (x = 30 AND y = 2) THEN 'o' WHEN vis < 0.5 THEN 'f' ELSE '.' END, '' ORDER BY x) AS line FROM grid GROUP BY y""")
def text_map(spark, sf):
    c = grid(spark, sf)
    return routes.text_map(c, c.filter("x = y"), params(spark)).drop("case_id")


@query("validate_case", f"WITH {GRID} SELECT 'part' AS case_id, CASE WHEN occ THEN r || ' is occupied' ELSE r || ' lies above the ceiling' END AS problem FROM (SELECT 'start' AS r, 0 AS px, 0 AS py UNION ALL SELECT 'goal', 49, 3) t JOIN grid ON x = px AND y = py WHERE occ OR dem + 5 > 95")
def validate_case(spark, sf):
    return edges.validate(grid(spark, sf), params(spark))


@query("health_windows", """SELECT time_bucket(INTERVAL 10 MINUTE, ts::TIMESTAMP) AS window_start, event_type, count(*) AS n, round(avg(value), 4) AS mean_value,
 CASE WHEN avg(value) < 20 THEN 'CRITICAL' WHEN avg(value) < 40 THEN 'DEGRADED' ELSE 'OK' END AS state FROM events GROUP BY 1, 2""")
def health_windows(spark, sf):
    return rounded(health.windowed_health(load(spark, sf, "events")), ["mean_value"], 4)


@query("supplier_choice", f"WITH {SOL.replace('sol AS', 'all_sol AS')}, sol AS (SELECT * FROM all_sol a WHERE NOT EXISTS (SELECT 1 FROM all_sol b WHERE b.scenario = a.scenario AND {BEATS})), {topsis_sql((0.5, 0.3, 0.2))} SELECT scenario, method, id, round(closeness, 6) AS closeness, rank::INT AS rank FROM rk")
def supplier_choice(spark, sf):
    front = pareto.skyline(solutions(spark, sf), OBJ, ["scenario"]).withColumn("key", F.struct("id", "method"))
    return rounded(decision.topsis(front, OBJ, [0.5, 0.3, 0.2], ["scenario"], "key").select("scenario", "method", "id", "closeness", "rank"), ["closeness"])


@query("baseline_deltas", f"""WITH {SOL}, b AS (SELECT scenario, method, min(f1) AS b FROM sol GROUP BY 1, 2), t AS (SELECT scenario, min_by(b, method) AS base FROM b GROUP BY 1) SELECT scenario, method, round(b - base, 6) + 0 AS delta FROM b JOIN t USING (scenario)""")
def baseline_deltas(spark, sf):
    b = solutions(spark, sf).groupBy("scenario", "method").agg(F.min("f1").alias("b"))
    t = b.groupBy("scenario").agg(F.min_by("b", "method").alias("base"))
    return rounded(b.join(t, "scenario").select("scenario", "method", (F.col("b") - F.col("base")).alias("delta")), ["delta"])


def searched(spark: SparkSession, names: tuple[str, ...], methods: tuple[str, ...]) -> DataFrame:
    e = p = None
    for c, q in maps.many(spark, names):
        x = edges.edges(c, q)
        e, p = (x, q) if e is None else (e.unionByName(x), p.unionByName(q))
    return search.search(e, p, methods)


@query("exact_front")
def exact_front(spark, sf):
    """All routes of the control maps; the tables do not enter."""
    return searched(spark, (*maps.BUILT_IN, "demo", "brute"), ("exact",))


@query("weighted_fronts")
def weighted_fronts(spark, sf):
    """Time-only and repeated weighted routes of the control maps; the tables do not enter."""
    return searched(spark, maps.BUILT_IN, ("time_only", "repeated_weighted"))


@query("grid_route")
def grid_route(spark, sf):
    """The fastest route over the whole part grid."""
    return search.fastest(edges.edges(grid(spark, sf), params(spark, turn=None)), params(spark, turn=None).withColumns({"battery_wh": F.lit(None).cast("double"), "start": F.struct(F.lit(1).alias("x"), F.lit(0).alias("y"))}))


@query("visual_richness")
def visual_richness(spark, sf):
    px = grid(spark, sf).select(F.floor(F.col("x") / 10).cast("int").alias("cx"), F.floor(F.col("y") / 4).cast("int").alias("cy"), (F.col("x") % 10).alias("px"), (F.col("y") % 4).alias("py"), (F.col("dem") * 2.5).alias("grey"))
    return imagery.visual_richness(px, ["cx", "cy"], [])


@query("band_richness")
def band_richness(spark, sf):
    """The part grid as red and near-infrared patches."""
    px = grid(spark, sf).select(F.floor(F.col("x") / 10).cast("int").alias("cx"), F.floor(F.col("y") / 4).cast("int").alias("cy"), (F.col("x") % 10).alias("px"), (F.col("y") % 4).alias("py"), (F.col("dem") * 2.5).alias("red"), (F.col("vis") * 200.0).alias("nir"))
    return imagery.band_richness(px, ["cx", "cy"], [])


@query("grid_route_cost", f"""WITH RECURSIVE {EDGES}, r(x, y, cost) USING KEY (x, y) AS (SELECT 49 AS x, 3 AS y, 0e0 AS cost UNION
  (SELECT e.x, e.y, min(e.c1 + r.cost) AS cost FROM edges e JOIN r ON r.x = e.x1 AND r.y = e.y1 LEFT JOIN recurring.r AS k ON k.x = e.x AND k.y = e.y
   WHERE k.cost IS NULL OR e.c1 + r.cost < k.cost - 1e-12 GROUP BY e.x, e.y)) SELECT 'part' AS case_id, round(cost, 6) AS f1 FROM r WHERE x = 1 AND y = 0""")
def grid_route_cost(spark, sf):
    """The flight time of ``grid_route``."""
    return rounded(grid_route(spark, sf).select("case_id", "f1"), ["f1"])


def tiles(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Every twelve parts as a case of four columns and three rows; ends are free."""
    p = load(spark, sf, "part").select("p_partkey", "p_size")
    k, s = F.col("p_partkey"), F.col("p_size")
    at = k % 12
    c = p.select(F.floor(k / 12).cast("string").alias("case_id"), (at % 4).cast("int").alias("x"), F.floor(at / 4).cast("int").alias("y"), (s * 2.0).alias("dem"), (s / 50.0).alias("nav"), (k % 7 / 8.0 + 0.125).alias("vis"), (k % 5 - 2.0).alias("u"), (k % 3 - 1.0).alias("v"), ((s > 40) & (at > 0) & (at < 11)).alias("occ"))
    whole = c.groupBy("case_id").agg(F.count("*").alias("n")).filter("n = 12").select("case_id")
    row = (None, 4, 3, 10.0, (0, 0), (3, 2), 15.0, 12.0, 0.1, None, None, None, None, None, None, None, None, None)
    q = whole.join(F.broadcast(spark.createDataFrame([row], maps.PARAMS).drop("case_id"))).select(*[x.split()[0] for x in ("case_id", *[f.name for f in spark.createDataFrame([row], maps.PARAMS).drop("case_id").schema])])
    return c.join(whole, "case_id"), q


TILE_EDGES = EDGES.split("edges AS (")[0].replace(GRID, """tile AS (SELECT (p_partkey // 12)::VARCHAR AS c, (p_partkey % 12 % 4)::INT AS x, (p_partkey % 12 // 4)::INT AS y, p_size * 2e0 AS dem, p_size / 50e0 AS nav,
  p_partkey % 7 / 8e0 + 0.125e0 AS vis, p_partkey % 5 - 2e0 AS u, p_partkey % 3 - 1e0 AS v, p_size > 40 AND p_partkey % 12 BETWEEN 1 AND 10 AS occ FROM part),
 grid AS (SELECT * FROM tile WHERE c IN (SELECT c FROM tile GROUP BY c HAVING count(*) = 12))""").replace("SELECT a.x, a.y,", "SELECT a.c, a.x, a.y,").replace("JOIN grid b ON", "JOIN grid b ON b.c = a.c AND").replace("JOIN grid m ON", "JOIN grid m ON m.c = a.c AND").replace("JOIN grid p ON", "JOIN grid p ON p.c = a.c AND").replace("q ON q.x", "q ON q.c = a.c AND q.x").replace(" AND b.dem + 5e0 <= 95e0", "") + "edges AS (SELECT c, x, y, x1, y1, d / vh AS c1, (1 - nav) * (d / vh) AS c2, (1 - vis) * (d / vh) AS c3 FROM e4 WHERE vh > 0)"


@query("exact_front_tiles", f"""WITH RECURSIVE {TILE_EDGES}, w(c, x, y, seen, f1, f2, f3) AS (SELECT DISTINCT c, 0, 0, 1::BIGINT, 0e0, 0e0, 0e0 FROM grid UNION ALL
  SELECT w.c, e.x1, e.y1, w.seen | (1::BIGINT << (e.y1 * 4 + e.x1)), f1 + c1, f2 + c2, f3 + c3 FROM w JOIN edges e ON e.c = w.c AND e.x = w.x AND e.y = w.y
  WHERE (w.seen >> (e.y1 * 4 + e.x1)) & 1 = 0 AND NOT (w.x = 3 AND w.y = 2)),
 g AS (SELECT DISTINCT c, round(f1, 6) AS f1, round(f2, 6) AS f2, round(f3, 6) AS f3 FROM w WHERE x = 3 AND y = 2)
 SELECT c AS case_id, f1, f2, f3 FROM g a WHERE NOT EXISTS (SELECT 1 FROM g b WHERE b.c = a.c AND {BEATS})""")
def exact_front_tiles(spark, sf):
    """The exact fronts of small cases cut from the part table; the SQL walks every simple path."""
    c, p = tiles(spark, sf)
    return pareto.dedupe_front(search.search(edges.edges(c, p), p, ("exact",)), OBJ, ["case_id"])
