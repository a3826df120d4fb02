"""Reference optima, brute force and invariants of the raster, route and front operators."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridfront.functions import scalars as S
from gridfront.operators import decision, edges, imagery, ordering, pareto, paths, raster, routes, search, stats
from gridfront.plans import campaign, tables
from gridfront.sources import files, maps

OBJ = ["f1", "f2", "f3"]
#: Published optima of each objective, size of the front (6 places), labels popped.
GOLD = {
    "lake": (38.284271247461895, 4.218952422373863, 0.0, 5, 1107),
    "foggy_valley": (2.6666666666666665, 0.2666667302449544, 0.0, 2, 50),
    "tailwind": (10.48528137423857, 1.0485283874124458, 0.0, 1, 80),
    "nfz": (13.42809041582063, 1.3428093617326873, 0.0, 1, 168),
    "mountain_pass": (2.2761423749153966, 0.22761429175900272, 0.0, 1, 13),
    "terrain": (12.094757082487297, 1.2701236711593007, 0.0, 4, 430),
    "realistic": (38.19183096388988, 10.841010071216015, 0.0, 51, 2748),
}


def together(spark, names):
    e = p = None
    for c, q in maps.many(spark, tuple(names)):
        x = edges.edges(c, q)
        e, p = (x, q) if e is None else (e.unionByName(x), p.unionByName(q))
    return e, p


def front_of(pdf):
    r = pdf[OBJ].round(6).drop_duplicates().to_numpy()
    return r[pareto.local_front(r)]


def test_published_optima(spark):
    got = search.search(*together(spark, [*GOLD, "walled", "demo"])).toPandas()
    for name, (f1, f2, f3, n, popped) in GOLD.items():
        g = got[got.case_id == name]
        assert (g.f1.min(), g.f2.min(), g.f3.min()) == pytest.approx((f1, f2, f3), abs=1e-12)
        assert len(front_of(g)) == n and g.n_expanded.iloc[0] == pytest.approx(popped, rel=0.02)
    assert len(got[got.case_id == "walled"]) == 0
    assert len(front_of(got[got.case_id == "demo"])) == 3


def test_methods_agree(spark):
    got = search.search(*together(spark, ["lake", "nfz", "foggy_valley", "realistic"]), ("exact", "time_only", "repeated_weighted")).toPandas()
    for _, g in got.groupby("case_id"):
        by = {m: x for m, x in g.groupby("method")}
        assert by["time_only"].f1.iloc[0] == pytest.approx(by["exact"].f1.min())
        exact = by["exact"][OBJ].to_numpy()
        for v in by["repeated_weighted"][OBJ].to_numpy():
            assert (np.abs(exact - v) < 1e-6).all(axis=1).any()


def graph(spark, cells, params):
    p = params.select("case_id", F.col("start.x").alias("sx"), F.col("start.y").alias("sy"), F.col("goal.x").alias("gx"), F.col("goal.y").alias("gy"), "resolution_m", "min_turn_radius_m", "battery_wh", "reserve_wh", "power_w", "sites")
    return search.Graph(p.join(edges.edges(cells, params), "case_id", "left").toPandas())


@pytest.mark.parametrize(("seed", "turn"), [(3, None), (7, None), (0, None), (3, 8.0), (7, 8.0)])
def test_exhaustive_front(spark, seed, turn):
    c, p = maps.control_map(spark, "brute", seed)
    g = graph(spark, c, p.withColumn("min_turn_radius_m", F.lit(turn).cast("double")))
    assert sorted(map(tuple, front_of(pd.DataFrame([c for c, _ in search.exact_front(g)[0]], columns=OBJ)))) == search.exhaustive_front(g)


def walled_cases(spark):
    """Maps of 30 by 30 cells with walls whose only gap lies far from both ends, as cases of several rules and ends."""
    rng, cells, rows = np.random.default_rng(5), [], []
    base = dict.fromkeys((f.name for f in spark.createDataFrame([], maps.PARAMS).schema), None) | {"resolution_m": 10.0, "v_air": 15.0, "v_max": 12.0}
    rules = {
        "near": {"start": (3, 3), "goal": (9, 4)},
        "around": {"start": (13, 3), "goal": (16, 3)},
        "turns": {"start": (13, 3), "goal": (16, 3), "min_turn_radius_m": 8.0},
        "budget": {"start": (13, 3), "goal": (16, 3), "battery_wh": 0.001, "power_w": 300.0},
        "charged": {"start": (13, 3), "goal": (16, 3), "battery_wh": 400.0, "power_w": 300.0},
        "sites": {"start": (13, 3), "goal": (16, 3), "battery_wh": 400.0, "power_w": 300.0, "sites": [(0, 29)]},
        "same": {"start": (4, 4), "goal": (4, 4)},
        "closed": {"start": (13, 3), "goal": (16, 3)},
    }
    for name, rule in rules.items():
        dem, u, v, nav = rng.uniform(0, 5, (30, 30)), rng.uniform(-5, 5, (30, 30)), rng.uniform(-5, 5, (30, 30)), rng.uniform(0, 1, (30, 30))
        occ = rng.random((30, 30)) < 0.1
        if name != "near":
            occ[:29, 15] = True  # the gap is in the last row
        occ[29] = False
        if name == "closed":
            occ[29, 15] = True
        for at in (rule["start"], rule["goal"]):
            occ[at[1], at[0]] = False
        cells += [(name, x, y, float(dem[y, x]), float(nav[y, x]), float(nav[x, y]), float(u[y, x]), float(v[y, x]), bool(occ[y, x])) for x in range(30) for y in range(30)]
        rows.append(tuple((base | {"case_id": name} | rule).values()))
    c = spark.createDataFrame(cells, "case_id string, x int, y int, dem double, nav double, vis double, u double, v double, occ boolean")
    return c, spark.createDataFrame(rows, maps.PARAMS)


def test_fastest_from_near_edges_is_that_of_the_whole_grid(spark, monkeypatch):
    c, p = walled_cases(spark)
    e = edges.edges(c, p).cache()
    whole = {r.case_id: r for r in search.search(e, p, ("time_only",)).collect()}
    assert set(whole) == {"near", "around", "turns", "charged", "sites", "same"}
    assert max(q.y for q in whole["around"].path) == 29 and max(q.y for q in whole["near"].path) < 12
    rounds = []
    around = search.around
    monkeypatch.setattr(search, "around", lambda margin: rounds.append(margin) or around(margin))
    assert {r.case_id: r for r in search.fastest(e, p, margin=1).collect()} == whole
    assert rounds[:3] == [1, 4, 16]
    e.unpersist()


def test_grid_route_sends_no_cells_or_edges_to_the_driver(spark):
    """The case of the part grid is one literal, so joins on it have no key; only the parameters may be broadcast."""
    sf = "/root/testdata/sf0.001"
    p = tables.params(spark, turn=None)
    e = edges.edges(tables.grid(spark, sf), p)
    for df in (e, search.runs(e, p, ("time_only",))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BuildLeft" not in plan and "LeftOuter" not in plan and plan.count("BroadcastExchange") == 1
    got = tables.grid_route(spark, sf).collect()
    assert got == search.search(e, p.withColumn("start", F.struct(F.lit(1).alias("x"), F.lit(0).alias("y"))).withColumn("battery_wh", F.lit(None).cast("double")), ("time_only",)).collect()


def test_grid_route_cost_broadcasts_little(spark):
    """With broadcasts of at most 256 KB, less than the cells or edges of the grid take, the cost is that of its SQL."""
    import duckdb

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{sf}/part.parquet'")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "256k")
    try:
        got = tables.grid_route_cost(spark, sf).collect()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert [tuple(r) for r in got] == con.execute(tables.SQL["grid_route_cost"]).fetchall()


def plain(spark, **over):
    """A 3 by 3 map of 10 m cells from corner to corner."""
    c = spark.range(9).select(F.lit("m").alias("case_id"), (F.col("id") % 3).cast("int").alias("x"), F.floor(F.col("id") / 3).cast("int").alias("y"))
    base = {"dem": F.lit(0.0), "nav": F.lit(0.5), "vis": F.lit(0.5), "u": F.lit(0.0), "v": F.lit(0.0), "occ": F.lit(False)}
    row = {"case_id": "m", "width": 3, "height": 3, "resolution_m": 10.0, "start": (0, 0), "goal": (2, 2), "v_air": 15.0, "v_max": 12.0, "v_air_min": 0.1, "v_air_max": None, "z_max_m": None, "agl_m": None, "clearance_m": None, "battery_wh": None, "reserve_wh": None, "power_w": None, "min_turn_radius_m": None, "sites": None}
    for k, v in over.items():
        (base if k in base else row)[k] = v
    return c.select("*", *[v.alias(k) for k, v in base.items()]), spark.createDataFrame([tuple(row.values())], maps.PARAMS)


def edge(spark, dx, dy, x=1, y=1, excess=None, **over):
    r = edges.edges(*plain(spark, **over), excess).filter((F.col("x") == x) & (F.col("y") == y) & (F.col("dx") == dx) & (F.col("dy") == dy)).collect()
    return r[0] if r else None


def test_edge_costs(spark):
    assert edge(spark, 1, 0).c1 == pytest.approx(10 / 15)
    assert edge(spark, 1, 0).c2 == pytest.approx(10 / 15 / 2)
    assert edge(spark, 1, 0, u=F.lit(5.0)).c1 == pytest.approx(0.5)
    assert edge(spark, -1, 0, u=F.lit(5.0)).c1 == pytest.approx(1.0)
    assert edge(spark, 0, -1, v=F.lit(5.0)).c1 == pytest.approx(0.5)  # rows grow to the south
    assert edge(spark, 1, 0, v=F.lit(9.0)).c1 == pytest.approx(10 / 12)
    assert edge(spark, 1, 0, u=F.lit(12.0)) is None
    up = edge(spark, 1, 0, v=F.lit(8.0), dem=F.when(F.col("x") == 2, 10.0).otherwise(0.0))
    assert up.c1 == pytest.approx(10 / ((225 - 64) / 2) ** 0.5)
    wall = (F.col("x") == 2) & (F.col("y") == 1)
    assert edge(spark, 1, 0, occ=wall) is None and edge(spark, 1, 1, occ=wall) is None
    assert edge(spark, 1, 0, dem=F.when(F.col("x") == 2, 90.0).otherwise(0.0), agl_m=20.0, z_max_m=100.0) is None
    bump = spark.createDataFrame([("m", 1, 1, 1, 0, 5.0), ("m", 1, 1, -1, 0, float("inf"))], "case_id string, x int, y int, dx int, dy int, excess_m double")
    assert edge(spark, 1, 0, excess=bump, agl_m=20.0, clearance_m=15.0) and not edge(spark, 1, 0, excess=bump, agl_m=20.0, clearance_m=16.0)
    assert edge(spark, -1, 0, excess=bump, agl_m=20.0, clearance_m=1.0) is None


def test_validate(spark):
    assert edges.validate(*plain(spark)).count() == 0
    bad = {r.problem for r in edges.validate(*plain(spark, occ=F.col("x") == 0, v_air=0.01, battery_wh=5.0, reserve_wh=6.0, power_w=10.0, goal=(5, 5))).collect()}
    assert bad == {"airspeed must lie in its range", "battery, reserve and power must be consistent", "start is occupied", "goal lies outside the grid"}


def test_turns():
    t = S.turn_table(10.0)
    assert t[1, 0, 0, 1] == pytest.approx(7.0711, abs=1e-4) and t[1, 0, 1, 0] == S.INF
    assert t[1, 0, 1, 1] == pytest.approx(13.066, abs=1e-3) and t[1, 0, -1, 0] == pytest.approx(5.0)


def test_energy_and_landing(spark):
    """The relational landing times, with and without headings, equal the kernel's."""
    c, p = maps.control_map(spark, "realistic")
    e = edges.edges(c, p)
    g = graph(spark, c, p)
    sites = p.select("case_id", F.explode("sites").alias("s")).select("case_id", "s.x", "s.y")
    heads = F.explode(F.array(*[F.struct(F.lit(a).alias("hx"), F.lit(b).alias("hy")) for a, b in S.STEPS])).alias("h")
    moves = paths.heading_edges(edges.turns(e, p), e, "c1")
    got = paths.cost_to_targets(moves, sites.select("*", heads).select("case_id", "x", "y", "h.*"), "w", ["case_id", "x", "y", "hx", "hy"], ["case_id", "x1", "y1", "dx", "dy"])
    got = {((r.x, r.y), (r.hx, r.hy)): r.cost for r in got.collect()}
    assert all(got[k] == pytest.approx(v) for k, v in g.landing.items() if k in got) and len(got) > 1000
    tight = graph(spark, c, p.withColumn("battery_wh", F.lit(3.5)))
    assert search.exact_front(tight)[0] == []


def test_cost_to_goal_is_consistent(spark):
    c, p = maps.control_map(spark, "lake")
    e = edges.edges(c, p)
    goal = p.select("case_id", F.col("goal.x").alias("x"), F.col("goal.y").alias("y"))
    h = paths.cost_to_targets(e, goal, "c1", ["case_id", "x", "y"], ["case_id", "x1", "y1"])
    far = h.select("case_id", F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("cost").alias("next"))
    assert e.join(h, ["case_id", "x", "y"]).join(far, ["case_id", "x1", "y1"]).filter("cost > c1 + next + 1e-9").count() == 0
    assert h.filter("x = 0 and y = 12").first().cost == pytest.approx(GOLD["lake"][0])


def test_front_measures(spark):
    s = spark.createDataFrame([("s", "a", 1.0, 4.0, 2.0), ("s", "a", 2.0, 2.0, 1.0), ("s", "b", 3.0, 5.0, 3.0)], "scenario string, method string, f1 double, f2 double, f3 double")
    assert {(r.a, r.b): r.coverage for r in pareto.coverage(s, OBJ).collect()} == {("a", "b"): 1.0, ("b", "a"): 0.0}
    m = {r.method: r for r in pareto.scenario_metrics(s, OBJ).collect()}
    assert m["a"].normalized_hypervolume == pytest.approx(1.0) and m["a"].additive_epsilon == 0 and m["a"].union_front_recall == 1
    assert m["b"].normalized_hypervolume == 0 and m["b"].additive_epsilon == pytest.approx(3.0) and m["b"].union_front_recall == 0


def test_skyline(spark):
    two = spark.createDataFrame([(1, 1.0, 4.0), (1, 2.0, 3.0), (1, 3.0, 1.0), (1, 4.0, 0.0), (1, 5.0, 5.0), (1, 1.0, 4.0), (2, 9.0, 9.0)], "g int, a double, b double")
    got = sorted((r.g, r.a, r.b) for r in pareto.skyline(two, ["a", "b"], ["g"]).collect())
    assert got == [(1, 1.0, 4.0), (1, 1.0, 4.0), (1, 2.0, 3.0), (1, 3.0, 1.0), (1, 4.0, 0.0), (2, 9.0, 9.0)]
    assert pareto.skyline(two.limit(0), ["a", "b"], ["g"]).count() == 0


def test_volume_against_samples():
    rng = np.random.default_rng(0)
    p, ref = rng.random((12, 3)), np.array([1.1, 1.2, 1.3])
    u = rng.random((200_000, 3)) * ref
    want = (p[None] <= u[:, None]).all(axis=2).any(axis=1).mean() * ref.prod()
    assert pareto.volume(p, ref) == pytest.approx(want, rel=0.01)


def test_topsis(spark):
    d = spark.createDataFrame([("g", 0, 10.0, 10.0), ("g", 1, 5.0, 5.0), ("g", 2, 8.0, 3.0), ("one", 0, 1.0, 2.0)], "g string, id int, a double, b double")
    r = {(x.g, x.id): x for x in decision.topsis(d, ["a", "b"], [0.5, 0.5], ["g"], "id").collect()}
    assert r["one", 0].closeness == 0.5 and r["g", 0].closeness == 0 and r["g", 0]["rank"] == 3
    assert all(0 <= x.closeness <= 1 for x in r.values())


def test_ablation_needs_its_layer(spark):
    c, _ = maps.control_map(spark, "lake")
    with pytest.raises(ValueError, match="source layer"):
        campaign.apply_ablation(c, "visual_only")


def test_mosaic_vehicle_and_best(spark):
    cells = [(cx, cy, px, py, float(100 * cx + 10 * cy + px + py)) for cx in range(2) for cy in range(3) for px in range(4) for py in range(2)]
    d = spark.createDataFrame(cells, "cell_x int, cell_y int, px int, py int, value double")
    got = {(r.x, r.y): r.value for r in raster.mosaic(d, 4, 2).collect()}
    assert got == {(cx * 4 + px, cy * 2 + py): v for cx, cy, px, py, v in cells}
    with pytest.raises(Exception, match="outside its patch"):
        raster.mosaic(d, 3, 2).collect()
    p = tables.params(spark)
    assert campaign.apply_vehicle(p, "fixed_wing_vtol").first().min_turn_radius_m == 40.0
    assert campaign.apply_vehicle(p, "multirotor").first().min_turn_radius_m == 0.0
    with pytest.raises(ValueError):
        campaign.apply_vehicle(p, "balloon")
    rows = spark.createDataFrame([("a", k, float(k), 1.0, 0.0) for k in range(6)], "case_id string, id int, f1 double, f2 double, f3 double")
    best = routes.best(routes.ranked(rows, ["case_id"], "id"), 2).orderBy("rank").collect()
    assert [(r.id, r.selected) for r in best] == [(0, True), (1, False)]
    with pytest.raises(ValueError):
        routes.best(rows, 0)


def test_campaign(spark):
    m = campaign.matrix(spark)
    assert m.count() == 240 and m.select("case_id").distinct().count() == 240
    few = campaign.matrix(spark, ("nfz", "foggy_valley"), 2)
    cells, params = campaign.synthetic(spark, few)
    assert params.count() == 8 and edges.validate(cells, params).count() == 0
    found, rows = campaign.benchmark(cells, params)
    rows = {(r.scenario, r.method): r for r in rows.collect()}
    assert len(rows) == found.count() == 24
    for (scenario, method), r in rows.items():
        assert r.feasible == (r.solution_count > 0) and r.runtime_ms > 0
        assert method != "exact" or not r.feasible or (r.union_front_recall == 1 and r.balanced_time_premium_vs_time_only >= -1e-9)
        if rows[scenario, "exact"].feasible and rows[scenario, "time_only"].feasible:
            assert rows[scenario, "exact"].coverage_of_time_only == 1.0
    documents = {(r.case_id, r.method): json.loads(r.json) for r in files.run_json(found, ["case_id", "method"]).collect()}
    assert all(d["feasible"] == bool(d["solutions"]) for d in documents.values())
    assert cells.filter(S.wind_speed(F.col("u"), F.col("v")) > 0.9 * 12 + 1e-9).count() == 0
    c2, p2 = campaign.scaled(*maps.control_map(spark, "nfz"), 2)
    assert c2.count() == 4 * 11 * 17 and p2.first().resolution_m == 5.0


def test_real_areas(spark, tmp_path):
    z = {"dem": np.zeros((3, 4)), "nav_density": np.full((3, 4), 0.5), "visibility": np.ones((3, 4)), "wind_field": np.zeros((3, 4, 2)), "occupancy": np.zeros((3, 4), bool), "resolution_m": 20.0}
    areas = []
    for k in range(5):
        more = {"visual_richness": np.full((3, 4), 0.7)} if k else {}
        np.savez_compressed(tmp_path / f"a{k}.npz", **z, **more, edge_terrain_excess_m=np.zeros((3, 4, 3, 3)), cruise_altitude_agl_m=10.0)
        areas.append({"id": f"a{k}", "land_cover": "forest", "archive": f"a{k}.npz", "missions": [{"id": "m0", "start": [0, 0], "goal": [3, 2]}, {"id": "m1", "start": [0, 2], "goal": [3, 0]}]})
    (tmp_path / "areas.json").write_text(json.dumps({"aois": areas}))
    cases, cells, params, excess = campaign.real_aoi(spark, str(tmp_path / "areas.json"), ablations=("full", "visual_only", "terrain_only"))
    names = {r.case_id for r in cases.select("case_id").collect()}
    # two missions, five weathers, two vehicles; no archive has the terrain layer, the first lacks the visual one
    assert len(names) == 5 * 20 + 4 * 20 and "real_a1_m0_calm_clear_multirotor_visual_only" in names and "real_a0_m0_calm_clear_multirotor_visual_only" not in names
    assert params.count() == len(names) and cells.count() == 12 * len(names) and excess.count() == 96 * len(names)
    one = cells.filter("case_id = 'real_a1_m1_calm_clear_multirotor_visual_only'").first()
    assert one.nav == 0.7 and params.filter("case_id like 'real_a1_m1%'").first().start.y == 2
    few = lambda d: d.filter("case_id = 'real_a2_m1_headwind_clear_multirotor_full'")
    runs, rows = campaign.benchmark(few(cells), few(params), ("exact", "time_only"), few(excess))
    assert rows.count() == 2 and runs.filter("feasible").count() == 2


def test_raster_kernels(spark):
    ramp = spark.range(16).select((F.col("id") % 4).cast("int").alias("px"), F.floor(F.col("id") / 4).cast("int").alias("py"), F.col("id").cast("double").alias("value"))
    g = raster.patch_grid(ramp, 2.0, 1.0, [])
    assert g.count() == 16 and g.select("cell_x", "cell_y").distinct().count() == 4
    assert raster.patch_grid(ramp, 3.0, 1.0, []).count() == 9
    nan = ramp.withColumn("value", F.when(F.col("px") == 0, float("nan")).otherwise(F.col("value")))
    assert raster.patch_grid(nan, 2.0, 1.0, []).filter("cell_x = 0 and value <> 0").count() == 0
    with pytest.raises(ValueError, match="pixel"):
        raster.patch_grid(ramp, 0.5, 1.0, [])


def test_zones(spark):
    c = spark.range(4).select(F.lit("z").alias("case_id"), (F.col("id") % 2).cast("int").alias("x"), F.floor(F.col("id") / 2).cast("int").alias("y"))
    hit = lambda ring: {(r.x, r.y) for r in raster.in_zones(c, [ring], (0.0, 2.0, 0.0, 2.0), ["case_id"]).filter("in_zone").collect()}
    assert len(hit([(0.8, 0.8), (1.2, 0.8), (1.2, 1.2), (0.8, 1.2)])) == 4
    assert hit([(1.0, 0.2), (1.0, 0.8), (0.5, 0.5)]) == {(0, 1), (1, 1)}  # touching an edge counts
    assert hit([(-5.0, -5.0), (7.0, -5.0), (7.0, 7.0), (-5.0, 7.0)]) == {(0, 0), (0, 1), (1, 0), (1, 1)}
    assert hit([(0.2, 0.2), (0.4, 0.2), (0.3, 0.4)]) == {(0, 1)}


def test_edge_profile_sees_a_spike(spark):
    fine = spark.range(18).select(F.lit("s").alias("case_id"), (F.col("id") % 6).cast("int").alias("x"), F.floor(F.col("id") / 6).cast("int").alias("y"))
    fine = fine.withColumn("value", F.when((F.col("x") == 3) & (F.col("y") == 1), 5.0).otherwise(0.0))
    centres = spark.createDataFrame([("s", 0, 0, 0.0), ("s", 1, 0, 0.0)], "case_id string, x int, y int, height double")
    got = {(r.x, r.dx): r.excess_m for r in raster.edge_profiles(fine, centres, 3, ["case_id"]).collect()}
    assert got == {(0, 1): 5.0, (1, -1): 5.0}


def test_imagery(spark):
    flat = np.full((16, 16), 7, np.uint8)
    board = (np.indices((16, 16)).sum(axis=0) % 2 * 255).astype(np.uint8)
    assert imagery.corner_response(flat).max() == 0 and imagery.disk_entropy(flat).max() == 0
    assert 0.9 < imagery.disk_entropy(board).mean() <= 1.0
    corner = np.zeros((16, 16))
    corner[8:, 8:] = 255
    assert imagery.corner_response(corner).max() > 0


def test_entropy_by_brute_force():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 6, (9, 13)).astype(np.uint8)
    got = imagery.disk_entropy(a, 3)
    for y in range(9):
        for x in range(13):
            near = [a[v, u] for v in range(9) for u in range(13) if (v - y) ** 2 + (u - x) ** 2 <= 9]
            p = np.bincount(near) / len(near)
            assert got[y, x] == pytest.approx(-sum(q * np.log2(q) for q in p if q))


def test_band_richness(spark):
    rng = np.random.default_rng(3)
    rows = [(c, x, y, float(r), float(n)) for c in range(3) for y in range(8) for x in range(8) for r, n in [rng.integers(0, 255, 2) if c else (7, 7)]]
    got = {r.c: r for r in imagery.band_scores(spark.createDataFrame(rows, "c int, px int, py int, red double, nir double"), ["c"]).collect()}
    assert got[0].geometry == 0 and got[0].texture == 0
    red, nir = (np.array([[next(r[k] for r in rows if r[:3] == (1, x, y)) for x in range(8)] for y in range(8)]) for k in (3, 4))
    assert got[1].geometry == pytest.approx((imagery.corner_response(red) + imagery.corner_response(nir)).max())
    ndvi = np.divide(nir - red, nir + red, out=np.zeros_like(nir), where=nir + red != 0)
    assert got[1].texture == pytest.approx(imagery.disk_entropy(np.clip((ndvi + 1) * 127.5, 0, 255).astype(np.uint8)).mean())


def test_quantiles_and_ranks_by_groups(spark):
    rng = np.random.default_rng(1)
    rows = [(None if k % 5 == 4 else f"g{k % 5}", float(v), None if k % 7 == 0 else float(k % 11)) for k, v in enumerate(rng.integers(0, 40, 300))] + [("empty", None, None), ("one", 3.0, None)]
    d = spark.createDataFrame(rows, "g string, a double, b double")
    pdf, shares = d.toPandas(), (0.02, 0.25, 0.5, 0.98)
    got = {r.g: r for r in ordering.quantiles(d, ["g"], ["a", "b"], shares).collect()}
    for g, part in pdf.groupby("g", dropna=False):
        for m in ("a", "b"):
            v = part[m].dropna().to_numpy()
            found = got[None if g != g else g]["_" + m] if (None if g != g else g) in got else None
            assert (found == pytest.approx(np.quantile(v, shares))) if len(v) else not found or found[0] is None
    whole = ordering.quantiles(d, [], ["a"], (0.5,)).first()
    assert whole["_a"][0] == np.median(pdf.a.dropna())
    places = ordering.ranked(d.withColumn("id", F.monotonically_increasing_id()), ["g"], ["a", "id"], "place").toPandas()
    assert len(places) == len(rows)
    for _, part in places.groupby("g", dropna=False):
        assert sorted(part.place) == list(range(1, len(part) + 1))


def test_measures_of_methods_without_solutions(spark):
    s = spark.createDataFrame([("s", "a", 1.0, 2.0, 3.0), ("s", "a", 2.0, 1.0, 3.0), ("s", "b", 2.0, 2.0, 3.0)], "scenario string, method string, f1 double, f2 double, f3 double")
    runs = spark.createDataFrame([("s", "a", True), ("s", "b", True), ("s", "c", False), ("t", "a", False)], "scenario string, method string, feasible boolean")
    got = {(r.scenario, r.method): r for r in pareto.scenario_metrics(s, OBJ, runs=runs).collect()}
    assert got["s", "a"].coverage == {"b": 1.0, "c": None} and got["s", "b"].coverage == {"a": 0.0, "c": None} and got["s", "c"].coverage == {"a": 0.0, "b": 0.0}
    assert (got["s", "a"].union_front_recall, got["s", "b"].union_front_recall, got["s", "c"].union_front_recall) == (1.0, 0.0, 0.0)
    assert got["s", "c"].additive_epsilon is None and got["s", "c"].hypervolume == 0 and got["s", "c"].normalized_hypervolume == 0
    assert (got["t", "a"].additive_epsilon, got["t", "a"].union_front_recall, got["t", "a"].normalized_hypervolume, got["t", "a"].coverage) == (0.0, 1.0, 0.0, None)


def test_statistics(spark):
    d = spark.createDataFrame([("a", 1.0), ("b", -2.0), ("c", 3.0), ("d", 3.0), ("e", 0.0)], "scenario string, diff double")
    s = stats.paired_summary(d).first()
    assert (s.n, s.median_difference, s.superiority_rate, s.nonzero) == (5, 1.0, 0.6, 4)
    assert s.rank_biserial == pytest.approx((1 - 2 + 3.5 + 3.5) / 10)
    d = spark.createDataFrame([("five", float(k)) for k in range(1, 6)] + [("none", 0.0)] * 3, "pair string, diff double")
    got = {r.pair: r for r in stats.wilcoxon(d, ["pair"]).collect()}
    assert got["five"].p_value == pytest.approx(0.0625) and got["five"].statistic == 0.0
    assert got["none"].p_value is None and got["none"].n == 3 and got["none"].nonzero == 0
    b = stats.bootstrap_median(spark.createDataFrame([("m", float(k)) for k in range(20)], "m string, v double"), ["m"], "v").first()
    assert b.ci_low < 9.5 < b.ci_high


def test_bootstrap_query_takes_2000_resamples_in_run_order(spark):
    sf = "/root/testdata/sf0.001"
    pdf = tables.runs(spark, sf).filter("feasible").toPandas().sort_values("run_id")
    got = {r.method: (r.ci_low, r.ci_high) for r in tables.bootstrap_ci(spark, sf).collect()}
    assert set(got) == set(pdf.method)
    for method, v in pdf.groupby("method").runtime_ms:
        rng = np.random.default_rng(2026)
        medians = [np.median(rng.choice(v.to_numpy(float), len(v), replace=True)) for _ in range(2000)]
        assert got[method] == tuple(np.quantile(medians, (0.025, 0.975)))


def test_running_total(spark):
    d = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 5).alias("v"))
    got = [(r.k, r.t) for r in ordering.running_total(d, ["k"], "v", "t").orderBy("k").collect()]
    pdf = d.toPandas().sort_values("k")
    assert got == list(zip(pdf.k, pdf.v.cumsum()))


def test_routes_and_text(spark):
    c, p = maps.control_map(spark, "foggy_valley")
    r = search.search(edges.edges(c, p), p)
    pts = routes.route_points(r, ["case_id", "route_id"]).withColumn("rid", F.col("route_id"))
    tot = r.select(F.col("route_id").alias("rid"), *OBJ)
    ch = routes.characteristics(pts.select("rid", "case_id", "k", "x", "y"), tot, c, p, ["rid"]).collect()
    assert min(x.length_m for x in ch) == 40.0 and all(np.isnan(x.energy_wh) for x in ch)
    ranked = routes.ranked(r, ["case_id"], "route_id")
    assert ranked.filter("selected").count() == 1
    lines = [x.line for x in routes.text_map(c, pts.limit(0), p).orderBy("y").collect()]
    assert lines == [".....", "SfffG", "....."]


def test_zero_route(spark):
    c, p = plain(spark, goal=(0, 0))
    assert [(r.f1, len(r.path)) for r in search.search(edges.edges(c, p), p).collect()] == [(0.0, 1)]


def test_files(spark, tmp_path):
    (tmp_path / "s.csv").write_text("scenario,method,feasible,runtime_ms,best_f1\na,m,True,1.5,\nb,m,False,,2\n")
    rows = files.summary_csv(spark, str(tmp_path / "s.csv")).orderBy("scenario").collect()
    assert rows[0].feasible and rows[0].runtime_ms == 1.5 and rows[0].best_f1 is None and not rows[1].feasible
    square = [[[0, 0], [2, 0], [2, 2], [0, 0]]]
    geo = {"type": "FeatureCollection", "crs": {"properties": {"name": "urn:ogc:def:crs:EPSG::32635"}}, "features": [{"properties": {"role": "start"}, "geometry": {"type": "MultiPoint", "coordinates": [[5.0, 6.0]]}}, {"properties": {}, "geometry": {"type": "Polygon", "coordinates": square}}, {"properties": {}, "geometry": {"type": "MultiPolygon", "coordinates": [square, square]}}]}
    (tmp_path / "g.geojson").write_text(json.dumps(geo, indent=1))
    f = files.features(spark, str(tmp_path / "g.geojson"))
    assert [(r.role, r.x, r.y) for r in files.points(f).collect()] == [("start", 5.0, 6.0)]
    assert files.rings(f.filter("id > 0")).count() == 3
    with pytest.raises(ValueError, match="polygon"):
        files.rings(f)
    files.write_table(f.select("id"), str(tmp_path / "t"))
    assert files.read_table(spark, str(tmp_path / "t")).count() == 3
    with pytest.raises(Exception, match="already exists"):
        files.write_table(f.select("id"), str(tmp_path / "t"))


def test_archive(spark, tmp_path):
    z = {"dem": np.arange(12.0).reshape(3, 4), "nav_density": np.full((3, 4), 0.5, np.float32), "visibility": np.ones((3, 4)), "wind_field": np.zeros((3, 4, 2)), "occupancy": np.zeros((3, 4), bool), "resolution_m": 20.0, "start": np.array([0, 0]), "goal": np.array([3, 2])}
    np.savez_compressed(tmp_path / "m.npz", **z)
    c, p, none = maps.archive(spark, str(tmp_path / "m.npz"), "arc")
    assert none is None
    assert c.count() == 12 and c.filter("x = 3 and y = 2").first().dem == 11.0 and p.first().goal.x == 3
    assert search.search(edges.edges(c, p), p).count() >= 1
    # a profile that bars the step from (1, 1) to the east, and one that is not finite to the south
    profile = np.zeros((3, 4, 3, 3))
    profile[1, 1, 1, 2], profile[1, 1, 2, 1] = 30.0, np.nan
    np.savez_compressed(tmp_path / "p.npz", **z, edge_terrain_excess_m=profile, dem_max=z["dem"] + 1, visual_richness=z["visibility"], cruise_altitude_agl_m=25.0)
    c, p, excess = maps.archive(spark, str(tmp_path / "p.npz"), "arc")
    assert {"dem_max", "visual_richness"} <= set(c.columns) and excess.count() == 96
    key = ["x", "y", "dx", "dy"]
    free, barred = ({tuple(r) for r in edges.edges(c, p, e).select(*key).collect()} for e in (None, excess))
    assert free - barred == set(free) - set(barred) and all(excess.filter(f"x = {x} and y = {y} and dx = {dx} and dy = {dy}").first().excess_m > 0 for x, y, dx, dy in free - barred)
    no_margin = p.withColumn("clearance_m", F.lit(0.0))
    assert {tuple(r) for r in edges.edges(c, no_margin, excess).select(*key).collect()} == free - {(1, 1, 1, 0), (1, 1, 0, 1)}
    np.savez_compressed(tmp_path / "ends.npz", **{k: v for k, v in z.items() if k != "goal"})
    with pytest.raises(ValueError, match="goal"):
        maps.archive(spark, str(tmp_path / "ends.npz"), "arc")
    assert maps.archive(spark, str(tmp_path / "ends.npz"), "arc", goal=(2, 1))[1].first().goal.x == 2
    np.savez_compressed(tmp_path / "bad.npz", dem=z["dem"])
    with pytest.raises(ValueError, match="lacks"):
        maps.archive(spark, str(tmp_path / "bad.npz"), "bad")


def test_stream(spark, tmp_path):
    from gridfront.streaming import health

    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = health.windowed_health(stream).writeStream.outputMode("append").format("memory").queryName("health").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = {(r.window_start, r.event_type): r.n for r in health.windowed_health(src).collect()}
    got = {(r.window_start, r.event_type): r.n for r in spark.table("health").collect()}
    assert got and all(batch[k] == n for k, n in got.items())


def test_queries_match_their_sql(spark):
    """Every query with SQL gives DuckDB's rows at the smallest scale."""
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("part", "lineitem", "orders", "customer", "events", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")

    def norm(pdf):
        cols = sorted(pdf.columns)
        return cols, sorted(str([None if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v) for v in row]) for row in pdf[cols].itertuples(index=False))

    for name, sql in tables.SQL.items():
        if name in ("focal_terrain",):  # the grid is thinner than the window here; held at the larger scale
            continue
        assert norm(tables.Q[name](spark, sf).toPandas()) == norm(con.execute(sql).df()), name
