"""Command line: ``plan`` a mission, run a ``benchmark`` or a ``campaign``, ``analyze`` summaries."""

from __future__ import annotations

import argparse
import sys
from functools import reduce

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gridfront.functions.scalars import parse_cell, seconds_text, vector_text
from gridfront.operators import decision, edges, routes, search, stats
from gridfront.plans import campaign
from gridfront.sources import files, maps


def cell(spark: SparkSession, text: str | None) -> tuple[int, int] | None:
    if text is None:
        return None
    c = spark.sql("SELECT 1").select(parse_cell(F.lit(text)).alias("c")).first().c
    return c.x, c.y


def plan(spark: SparkSession, a: argparse.Namespace) -> int:
    """Prints the ranked routes and their map; 1 if there is none."""
    cells, params, excess = maps.archive(spark, a.archive, "mission", cell(spark, a.start), cell(spark, a.goal)) if a.archive else (*maps.control_map(spark, a.map), None)
    if problems := [r.problem for r in edges.validate(cells, params).collect()]:
        print("; ".join(problems), file=sys.stderr)
        return 2
    found = routes.ranked(search.search(edges.edges(cells, params, excess), params, (a.method,)), ["case_id"], "route_id", a.weights).cache()
    rows = found.select("rank", "route_id", seconds_text(F.col("f1")).alias("time"), vector_text([F.col("f1"), F.col("f2"), F.col("f3")]).alias("costs"), F.round("closeness", 4).alias("closeness"), F.size("path").alias("points")).orderBy("rank").collect()
    if not rows:
        print("no route", file=sys.stderr)
        return 1
    for r in rows:
        print(*r, sep="\t")
    best = routes.route_points(found.filter("selected"), ["case_id"])
    for line in routes.text_map(cells, best, params).orderBy("y").collect():
        print(line.line)
    if a.out:
        files.write_table(found, a.out, a.overwrite, ("case_id",))
    return 0


def named_map(text: str) -> tuple[str, str]:
    """``NAME=PATH``."""
    name, sep, path = text.partition("=")
    if not (name and sep and path):
        raise argparse.ArgumentTypeError("give a map as NAME=PATH")
    return name, path


def written(spark: SparkSession, a: argparse.Namespace, parts: list[tuple], cases: list[dict], meta=None) -> None:
    """Runs as JSON documents, the summary as CSV and the manifest, below ``a.out``."""
    runs, summaries = [], []
    for cells, params, excess in parts:
        r, s = campaign.benchmark(cells, params, tuple(a.methods), excess, a.measure_memory)
        runs.append(r)
        summaries.append(s)
    mode = "overwrite" if a.overwrite else "errorifexists"
    summary = files.union_rows(summaries)
    if meta is not None:
        summary = summary.join(meta, "scenario", "left")
    files.run_json(reduce(lambda x, y: x.unionByName(y), runs), ["case_id", "method"]).select("case_id", "method", "json").write.mode(mode).partitionBy("case_id", "method").text(f"{a.out}/runs")
    files.write_csv(summary, f"{a.out}/summary", a.overwrite)
    files.manifest(spark, cases, tuple(a.methods), decision.PROFILES).coalesce(1).write.mode(mode).text(f"{a.out}/manifest")
    summary.select("scenario", "method", "feasible", "solution_count", "best_f1_time_s", "normalized_hypervolume", "union_front_recall").orderBy("scenario", "method").show(1000, False)


def benchmark(spark: SparkSession, a: argparse.Namespace) -> int:
    """Runs methods over control maps and archives; writes runs, summary and manifest."""
    own = a.maps if a.maps is not None else [] if a.map else list(maps.BUILT_IN)
    maps.built_in_names(own)
    parts = [(c, p, None) for c, p in maps.many(spark, tuple(own))] + [maps.archive(spark, path, name) for name, path in a.map]
    kinds = [(n, f"synthetic:{n}", "control") for n in own] + [(n, path, "real") for n, path in a.map]
    meta = spark.createDataFrame(kinds, "scenario string, source string, case_kind string")
    written(spark, a, parts, [{"name": n, "source": s, "case_kind": k} for n, s, k in kinds], meta)
    return 0


def run_campaign(spark: SparkSession, a: argparse.Namespace) -> int:
    """Runs methods over the synthetic campaign, or over the real areas of a manifest."""
    if a.manifest:
        cases, cells, params, excess = campaign.real_aoi(spark, a.manifest, ablations=tuple(a.ablations))
        extra = ["case_kind", "aoi", "land_cover", "mission", "weather", "vehicle", "navigation_model", "grid_scale", F.col("archive").alias("source")]
    else:
        cases = campaign.matrix(spark, tuple(a.families), a.variants)
        (cells, params), excess = campaign.synthetic(spark, cases, a.seed), None
        extra = [F.lit("synthetic_campaign").alias("case_kind"), "family", "variant", "weather", "vehicle", F.concat(F.lit("synthetic:"), "family").alias("source")]
    meta = cases.select(F.col("case_id").alias("scenario"), *extra)
    written(spark, a, [(cells, params, excess)], [{"name": a.manifest or "synthetic"}], meta)
    return 0


def analyze(spark: SparkSession, a: argparse.Namespace) -> int:
    """Aggregates and paired tests of a summary by kind of case; as CSV below ``--out`` if given."""
    rows = files.summary_csv(spark, a.summary).withColumn("run_id", F.monotonically_increasing_id())
    kind = F.col("case_kind") if "case_kind" in rows.columns else F.lit(None).cast("string")
    rows = rows.withColumn("group", F.when(kind == "synthetic_campaign", "synthetic").when(kind == "real_aoi", "real_aoi").otherwise("control"))
    metrics = [m for m in stats.METRICS if m in rows.columns]
    total = stats.aggregate(rows, ["group", "method"], metrics, "run_id")
    total.orderBy("group", "method").show(100, False)
    tested = [m for m in ("normalized_hypervolume", "union_front_recall", "runtime_ms") if m in metrics]
    each = F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in tested]))
    long = rows.select("group", "method", "feasible", "run_id", F.col("scenario").alias("name"), each) if tested else None
    paired = None
    if tested:
        diffs = stats.pairs(long.select("method", "feasible", "run_id", "value", F.struct("group", "metric", "name").alias("scenario")), "value", a.first, a.second)
        diffs = diffs.select("scenario.group", "scenario.metric", "diff")
        keys = ["group", "metric"]
        paired = stats.paired_summary(diffs, keys).join(stats.wilcoxon(diffs, keys).drop("n", "nonzero"), keys, "left")
        paired.show(100, False)
    if a.out:
        files.write_csv(total, f"{a.out}/aggregate", a.overwrite)
        if paired is not None:
            files.write_csv(paired, f"{a.out}/paired_tests", a.overwrite)
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="gridfront")
    sub = p.add_subparsers(required=True)
    q = sub.add_parser("plan")
    q.add_argument("map", nargs="?", default="lake", choices=sorted(maps.SIZES))
    q.add_argument("--archive")
    q.add_argument("--start")
    q.add_argument("--goal")
    q.add_argument("--method", default="exact", choices=sorted(search.METHODS))
    q.add_argument("--weights", type=lambda s: tuple(map(float, s.split(","))), default=(0.5, 0.3, 0.2))
    q.add_argument("--out")
    q.add_argument("--overwrite", action="store_true")
    q.set_defaults(run=plan)
    q = sub.add_parser("benchmark")
    q.add_argument("out")
    q.add_argument("--maps", nargs="*")
    q.add_argument("--map", action="append", type=named_map, default=[], metavar="NAME=PATH")
    q.set_defaults(run=benchmark)
    c = sub.add_parser("campaign")
    c.add_argument("out")
    c.add_argument("--families", nargs="+", default=list(campaign.FAMILIES))
    c.add_argument("--variants", type=int, default=30)
    c.add_argument("--seed", type=int, default=2026)
    c.add_argument("--manifest")
    c.add_argument("--ablations", nargs="+", default=["full"], choices=campaign.ABLATIONS)
    c.set_defaults(run=run_campaign)
    for x in (q, c):
        x.add_argument("--methods", nargs="+", default=list(search.METHODS))
        x.add_argument("--measure-memory", action="store_true")
        x.add_argument("--overwrite", action="store_true")
    q = sub.add_parser("analyze")
    q.add_argument("summary")
    q.add_argument("--out")
    q.add_argument("--overwrite", action="store_true")
    q.add_argument("--first", default="exact")
    q.add_argument("--second", default="repeated_weighted")
    q.set_defaults(run=analyze)
    a = p.parse_args(argv)
    return a.run(SparkSession.builder.appName("gridfront").getOrCreate(), a)


if __name__ == "__main__":
    sys.exit(main())
