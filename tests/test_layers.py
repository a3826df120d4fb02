"""Layers from pixels, seeded fields and the command line."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridfront.__main__ import main
from gridfront.operators import edges, search
from gridfront.plans import layers
from gridfront.sources import fields, files


def pixels(spark, seed, nan=False):
    rng = np.random.default_rng(seed)
    yy, xx = np.mgrid[:40, :50]
    v = rng.integers(1, 255, 2000).astype(float)
    if nan:
        v[3] = np.nan
    return spark.createDataFrame(pd.DataFrame({"case_id": "m", "px": xx.ravel().astype(np.int32), "py": yy.ravel().astype(np.int32), "value": v}))


def test_build(spark):
    wind = fields.wind(spark, "m", 4, 5, speed=6.0, direction=240.0)
    zone = [[(10.0, 10.0), (20.0, 10.0), (20.0, 20.0), (10.0, 20.0)]]
    c = layers.build(pixels(spark, 1), pixels(spark, 2).withColumn("value", F.col("value") / 100), wind, (0.0, 50.0, 0.0, 40.0), 10.0, 1.0, no_fly=[[(41.0, 31.0), (44.0, 31.0), (44.0, 34.0)]], low_visibility=zone)
    rows = {(r.x, r.y): r for r in c.collect()}
    assert len(rows) == 20 and [k for k, r in rows.items() if r.occ] == [(4, 0)]
    assert rows[1, 2].vis == 0.35 and rows[4, 0].vis == 1.0
    assert all(0 <= r.phi_vis <= 1 and 0 <= r.phi_ter <= 1 and r.nav == max(r.phi_vis, r.phi_ter) and r.dem <= r.dem_max for r in rows.values())
    p = spark.createDataFrame([("m", 5, 4, 10.0, (0, 3), (4, 3), 15.0, 12.0, 0.1, None, None, None, None, None, None, None, None, None)], __import__("gridfront.sources.maps", fromlist=["PARAMS"]).PARAMS)
    assert search.search(edges.edges(c.drop("dem_max", "phi_vis", "phi_ter"), p), p).count() >= 1
    with pytest.raises(ValueError, match="zones or"):
        layers.build(c, c, wind, (0, 1, 0, 1), 10.0, 1.0, low_visibility=zone, plumes=c)


def test_planner_map(spark):
    points = spark.createDataFrame([(0, "start", 3.0, 38.0), (1, "goal", 47.0, 2.0), (2, "other", 1.0, 1.0)], "id long, role string, x double, y double")
    wind = fields.wind(spark, "m", 4, 5, speed=3.0, direction=240.0)
    ground = pixels(spark, 2).withColumn("value", F.col("value") / 1000)
    args = (pixels(spark, 1), ground, wind, points, (0.0, 50.0, 0.0, 40.0), 10.0, 1.0)
    c, p, excess, made = layers.planner_map(*args, agl_m=20.0, clearance_m=15.0, sites=3)
    r = p.first()
    assert (r.start, r.goal, r.width, r.height) == ((0, 0), (4, 3), 5, 4) and 1 <= len(r.sites) <= 3
    assert excess.count() == 2 * (4 * 4 + 5 * 3 + 2 * 3 * 4) and 0 <= excess.agg(F.max("excess_m")).first()[0] < 1
    assert {"visual_richness", "rugosity", "dem_max"} <= set(c.columns) and made.first().visibility_source == "clear"
    assert edges.validate(c, p).count() == 0
    routes = search.search(edges.edges(c, p, excess), p)
    assert routes.count() >= 1
    barred = layers.planner_map(*args, agl_m=20.0, sites=3)  # the whole height is to be kept
    assert edges.edges(barred[0], barred[1], barred[2]).count() < edges.edges(c, p, excess).count()
    for wrong, text in (({"battery_wh": 0.0}, "battery"), ({"reserve_wh": 400.0}, "reserve"), ({"clearance_m": 500.0}, "clearance"), ({"sites": 0}, "site"), ({"low_visibility": [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]]}, "zone_visibility"), ({"low_visibility": []}, "no zones")):
        with pytest.raises(ValueError, match=text):
            layers.planner_map(*args, **wrong)
    with pytest.raises(ValueError, match="goal"):
        layers.planner_map(*args[:3], points.filter("role <> 'goal'"), *args[4:])


def test_previews(spark):
    got = layers.previews(pixels(spark, 3), 10.0, 1.0, 4).collect()
    assert len(got) == 20 and all(len(r.preview) == 16 and min(r.preview) >= 0 and max(r.preview) <= 255 for r in got)


def test_fields(spark):
    a = fields.smooth(np.eye(30), 2.0)
    assert a.sum() == pytest.approx(30.0) and a.max() < 0.3
    assert fields.wind(spark, "m", 3, 4).collect() == fields.wind(spark, "m", 3, 4).collect()
    one = np.random.RandomState(4)
    both = fields.smoke_sources(2, (0, 100), (0, 50), np.random.RandomState(4))
    assert both == fields.smoke_sources(1, (0, 100), (0, 50), one) + fields.smoke_sources(1, (0, 100), (0, 50), one)
    assert all(2 <= s <= 5 and 0.2 <= m <= 0.4 for _, _, s, m in both)
    with pytest.raises(ValueError, match="empty"):
        fields.smoke_sources(1, (0, 0), (0, 5), one)


def test_command_line(spark, tmp_path, capsys):
    assert main(["plan", "foggy_valley", "--out", str(tmp_path / "r")]) == 0
    assert "*" in capsys.readouterr().out
    assert main(["plan", "walled"]) == 1
    assert main(["benchmark", str(tmp_path / "b"), "--maps", "nfz", "walled", "--methods", "exact", "time_only", "--measure-memory"]) == 0
    rows = files.summary_csv(spark, str(tmp_path / "b/summary")).collect()
    assert {(r.scenario, r.method): r.feasible for r in rows} == {("nfz", "exact"): True, ("nfz", "time_only"): True, ("walled", "exact"): False, ("walled", "time_only"): False}
    assert all(r.peak_memory_kib > 0 and r.case_kind == "control" for r in rows)
    runs = {(r.case_id, r.method): json.loads(r.value) for r in spark.read.text(str(tmp_path / "b/runs")).collect()}
    assert runs["walled", "exact"]["feasible"] is False and runs["nfz", "exact"]["solutions"][0]["path"]
    assert {c["name"] for c in json.loads(spark.read.text(str(tmp_path / "b/manifest")).first().value)["cases"]} == {"nfz", "walled"}
    assert main(["analyze", str(tmp_path / "b/summary"), "--out", str(tmp_path / "a"), "--second", "time_only"]) == 0
    paired = spark.read.option("header", True).csv(str(tmp_path / "a/paired_tests")).filter("group = 'control' and metric = 'runtime_ms'").first()
    assert paired.n == "1"
    with pytest.raises(ValueError, match="unknown maps"):
        main(["benchmark", str(tmp_path / "c"), "--maps", "nowhere"])
