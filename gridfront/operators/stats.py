"""Statistics over experiment results: quartiles, intervals, paired tests."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridfront.operators.ordering import quantiles, running_total


def group_quartiles(rows: DataFrame, keys: list[str], metrics: list[str], feasible: str = "feasible") -> DataFrame:
    """Feasible count and rate over all rows, quartiles of each metric over feasible rows; no task holds a group."""
    of = lambda m: F.when(F.col(feasible), F.col(m))
    out = rows.groupBy(*keys).agg(F.sum(F.col(feasible).cast("long")).alias("instances"), F.avg(F.col(feasible).cast("double")).alias("feasibility_rate"))
    places = quantiles(rows.select(*keys, *[of(m).alias(m) for m in metrics]), keys, metrics, (0.25, 0.5, 0.75))
    out = out.join(places, keys, "left")
    return out.select(*keys, "instances", "feasibility_rate", *[F.col(f"_{m}")[i].alias(f"{m}_{q}") for m in metrics for i, q in enumerate(("q1", "median", "q3"))])


#: The metrics of an aggregate.
METRICS = ["normalized_hypervolume", "union_front_recall", "runtime_ms", "peak_memory_kib", "solution_count"]


def aggregate(rows: DataFrame, keys: list[str], metrics: list[str] = METRICS, order: str | None = None, feasible: str = "feasible") -> DataFrame:
    """``group_quartiles`` with the 95 % interval of each metric's median (``<metric>_ci95_low``, ``_ci95_high``)."""
    out = group_quartiles(rows, keys, metrics, feasible)
    each = F.inline(F.array(*[F.struct(F.lit(m).alias("_metric"), F.col(m).cast("double").alias("_value")) for m in metrics]))
    long = rows.filter(F.col(feasible)).select(*keys, *([order] if order else []), each).filter("_value is not null")
    ci = bootstrap_median(long, [*keys, "_metric"], "_value", order=order)
    ends = [F.first(F.when(F.col("_metric") == m, F.col(f"ci_{e}")), ignorenulls=True).alias(f"{m}_ci95_{e}") for m in metrics for e in ("low", "high")]
    return out.join(ci.groupBy(*keys).agg(*ends), keys, "left")


def bootstrap_median(rows: DataFrame, keys: list[str], metric: str, samples: int = 2000, seed: int = 2026, order: str | None = None) -> DataFrame:
    """95 % interval of the median by resampling, the same generator for each group; medians of a group stay in one task.

    The resamples depend on the order of a group's rows; ``order`` names the column that fixes it.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = (pdf.sort_values(order) if order else pdf)[metric].dropna().to_numpy(float)
        rng = np.random.default_rng(seed)
        low, high = np.quantile([np.median(rng.choice(v, len(v), replace=True)) for _ in range(samples)], (0.025, 0.975)) if len(v) else (None, None)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "ci_low": [low], "ci_high": [high]})

    kinds = dict(rows.dtypes)
    return rows.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", ci_low double, ci_high double")


def pairs(rows: DataFrame, metric: str, first: str, second: str, scenario: str = "scenario", method: str = "method", order: str = "run_id", feasible: str = "feasible") -> DataFrame:
    """``scenario, diff`` of two methods; of several runs the last one counts."""
    last = Window.partitionBy(scenario, method).orderBy(F.col(order).desc())
    r = rows.filter(F.col(feasible) & F.col(method).isin(first, second)).withColumn("_r", F.row_number().over(last)).filter("_r = 1")
    w = r.groupBy(scenario).agg(F.max(F.when(F.col(method) == first, F.col(metric))).alias("a"), F.max(F.when(F.col(method) == second, F.col(metric))).alias("b"))
    return w.filter("a is not null and b is not null").select(scenario, (F.col("a") - F.col("b")).alias("diff"))


def paired_summary(diffs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Count, median difference, superiority rate and rank-biserial effect of a table of differences, by group.

    Average ranks need how many differences are smaller and how many equal; they come from one
    aggregate of distinct absolute differences and a running sum over it.
    """
    keys = keys or []
    beside = lambda a, b: a.join(b, keys, "left") if keys else a.join(F.broadcast(b), how="left")  # noqa: E731  one row each without keys
    base = diffs.groupBy(*keys).agg(F.count("diff").alias("n"), F.avg((F.col("diff") > 0).cast("double")).alias("superiority_rate"))
    middle = quantiles(diffs, keys, ["diff"], (0.5,)).select(*keys, F.col("_diff")[0].alias("median_difference"))
    ties = diffs.filter(F.abs("diff") > 1e-12).groupBy(*keys, F.abs("diff").alias("m")).agg(F.count("*").alias("t"), F.sum(F.signum("diff")).alias("s"))
    placed = running_total(ties, [*keys, "m"], "t", "upto")
    placed = beside(placed, placed.groupBy(*keys).agg(F.min(F.col("upto") - F.col("t")).alias("start"))).withColumn("rank", F.col("upto") - F.col("start") - (F.col("t") - 1) / 2)
    effect = placed.groupBy(*keys).agg((F.sum(F.col("s") * F.col("rank")) / F.sum(F.col("t") * F.col("rank"))).alias("rank_biserial"), F.sum("t").alias("nonzero"))
    return beside(beside(base, middle), effect).select(*keys, "n", "median_difference", "superiority_rate", "rank_biserial", "nonzero")


def signed_rank_p(n: int, low: float, ties: int, untied: bool) -> float | None:
    """Two-sided p-value of the lesser rank sum: exact for up to 50 untied differences, else by the normal approximation."""
    if not n:
        return None
    if n <= 50 and untied:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1.0
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[:-r]
        return float(min(1.0, 2 * ways[: int(low) + 1].sum() / 2.0**n))
    var = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    z = (low - n * (n + 1) / 4) / math.sqrt(var)
    return float(min(1.0, math.erfc(abs(z) / math.sqrt(2))))


def wilcoxon(diffs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n, nonzero, statistic, p_value``: the signed-rank test by group of differences.

    Average ranks come from a running count over distinct absolute differences, so no task holds a group; only
    one row of sums a group reaches Python, for the distribution. Null p-value and statistic without differences.
    """
    every = diffs.groupBy(*keys).agg(F.count("diff").alias("n"))
    d = diffs.filter(F.abs("diff") > 1e-12).groupBy(*keys, F.abs("diff").alias("m")).agg(F.count("*").alias("t"), F.count_if(F.col("diff") > 0).alias("up"))
    placed = running_total(d, [*keys, "m"], "t", "upto")
    start = placed.groupBy(*keys).agg(F.min(F.col("upto") - F.col("t")).alias("start"))
    placed = placed.join(start, keys).withColumn("rank", F.col("upto") - F.col("start") - (F.col("t") - 1) / 2)
    t = F.col("t")
    sums = placed.groupBy(*keys).agg(F.sum(t).alias("nonzero"), F.sum(F.col("up") * F.col("rank")).alias("plus"), F.sum(t * F.col("rank")).alias("whole"), F.sum(t * t * t - t).alias("ties"))
    sums = every.join(sums, keys, "left").select(*keys, "n", F.coalesce("nonzero", F.lit(0)).alias("nonzero"), F.least(F.col("plus"), F.col("whole") - F.col("plus")).alias("statistic"), F.coalesce("ties", F.lit(0)).alias("ties"))

    def run(batches):
        for pdf in batches:
            p = [signed_rank_p(int(n), low, int(ties), ties == 0) for n, low, ties in zip(pdf.nonzero_, pdf.statistic, pdf.ties)]
            yield pdf.drop(columns=["ties"]).rename(columns={"nonzero_": "nonzero"}).assign(p_value=pd.Series(p, dtype="float64", index=pdf.index))

    kinds = dict(diffs.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n long, nonzero long, statistic double, p_value double"
    return sums.withColumnRenamed("nonzero", "nonzero_").mapInPandas(run, schema)
