"""Fronts (skylines) and their quality, keyed by a group such as a scenario.

A skyline first drops what its own partition already dominates (a vectorised pass that keeps only
local fronts, so little is shuffled), then settles each group by a left anti join of the survivors,
an equi-join on the group with the dominance test as condition. Equal vectors all stay.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridfront.functions import scalars as S

EPS = 1e-9
#: Width of the bins in which vectors meet their like.
BIN = 1e-6


def beaten(values: np.ndarray, rivals: np.ndarray) -> np.ndarray:
    """Which rows some rival dominates; a block of rows meets a block of rivals at a time."""
    out = np.zeros(len(values), bool)
    for a in range(0, len(values), 512):
        v = values[a : a + 512, None]
        for b in range(0, len(rivals), 2048):
            r = rivals[None, b : b + 2048]
            out[a : a + 512] |= ((r <= v).all(axis=2) & (r < v).any(axis=2)).any(axis=1)
    return out


def local_front(values: np.ndarray) -> np.ndarray:
    """Rows that no other row dominates; ascending sums, so that a row's dominators come before it or in its block."""
    order = np.argsort(values.sum(axis=1), kind="stable")
    kept, front = [], np.empty((0, values.shape[1]))
    for at in range(0, len(order), 512):
        k = order[at : at + 512]
        k = k[~beaten(values[k], front)]
        k = k[~beaten(values[k], values[k])]
        kept.append(k)
        front = np.concatenate([front, values[k]])
    return np.sort(np.concatenate(kept)) if kept else np.zeros(0, int)


def skyline(rows: DataFrame, objectives: list[str], keys: list[str]) -> DataFrame:
    """The rows of each group that no row of their group dominates (all objectives minimised)."""

    def reduce_(batches):
        for pdf in batches:
            for _, g in pdf.groupby(keys, dropna=False, sort=False) if keys else [(None, pdf)]:
                yield g.iloc[local_front(g[objectives].to_numpy(float))]

    slim = rows.mapInPandas(reduce_, rows.schema)
    rival = slim.select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.col(o).alias(f"_{o}") for o in objectives]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    worse = S.dominates([F.col(f"_{o}") for o in objectives], [F.col(o) for o in objectives])
    return slim.join(rival, reduce(lambda a, b: a & b, [*same, worse]), "left_anti")


def dedupe_front(front: DataFrame, objectives: list[str], keys: list[str], places: int = 6) -> DataFrame:
    """Distinct vectors of a front after rounding, dominated ones dropped."""
    rounded = front.select(*keys, *[F.round(o, places).alias(o) for o in objectives]).distinct()
    return skyline(rounded, objectives, keys)


def union_front(solutions: DataFrame, objectives: list[str], scenario: str = "scenario") -> DataFrame:
    """The shared front of all methods of a scenario, as a bag."""
    return skyline(solutions.select(scenario, *objectives), objectives, [scenario])


def reference_point(front: DataFrame, objectives: list[str], scenario: str = "scenario") -> DataFrame:
    return front.groupBy(scenario).agg(*[F.greatest(1.05 * F.max(o), F.lit(1e-6)).alias(f"ref_{o}") for o in objectives])


def methods_of(solutions: DataFrame, scenario: str, method: str) -> DataFrame:
    """The runs that have solutions, as feasible ones."""
    return solutions.select(scenario, method).distinct().withColumn("feasible", F.lit(True))


def coverage(solutions: DataFrame, objectives: list[str], scenario: str = "scenario", method: str = "method", runs: DataFrame | None = None) -> DataFrame:
    """``C(a, b)`` for every two methods of a scenario: the share of b's vectors that some vector of a weakly dominates.

    Null if b has no vectors, else 0 if a has none. Only a's skyline meets the distinct vectors of b, which gives
    the same shares; it is small as a rule, so that the join need not shuffle the vectors by their scenario.
    """
    runs = methods_of(solutions, scenario, method) if runs is None else runs
    b = solutions.groupBy(scenario, F.col(method).alias("b"), *objectives).agg(F.count("*").alias("n"))
    a = skyline(solutions.select(scenario, method, *objectives).distinct(), objectives, [scenario, method])
    a = a.select(F.col(scenario).alias("_s"), F.col(method).alias("a"), *[F.col(o).alias(f"_{o}") for o in objectives])
    hit = reduce(lambda p, q: p & q, [F.col(f"_{o}") <= F.col(o) + EPS for o in objectives])
    met = b.join(a, (F.col(scenario) == F.col("_s")) & (F.col("a") != F.col("b")) & hit).groupBy(scenario, "a", "b", *objectives).agg(F.first("n").alias("n"))
    covered = met.groupBy(scenario, "a", "b").agg(F.sum("n").alias("hits"))
    sizes = b.groupBy(scenario, "b").agg(F.sum("n").alias("n"))
    pairs = runs.select(scenario, F.col(method).alias("a")).join(runs.select(scenario, F.col(method).alias("b")), scenario).filter("a <> b")
    out = pairs.join(sizes, [scenario, "b"], "left").join(covered, [scenario, "a", "b"], "left")
    return out.select(scenario, "a", "b", F.when(F.col("n") > 0, F.coalesce("hits", F.lit(0)) / F.col("n")).alias("coverage"))


def recall(solutions: DataFrame, front: DataFrame, objectives: list[str], scenario: str = "scenario", method: str = "method") -> DataFrame:
    """The share of the shared front (a bag) that a method reproduces within the tolerance.

    Vectors meet by bins of ``BIN`` in every objective; a method's vector goes to each bin that its tolerance reaches.
    """
    target = front.groupBy(scenario, *objectives).agg(F.count("*").alias("n"))
    points = solutions.select(F.col(scenario).alias("_s"), method, *[F.col(o).alias(f"_{o}") for o in objectives]).distinct()
    place = lambda c: F.floor(c / BIN)
    reach = [[]]
    for o in objectives:
        reach = [[*r, place(F.col(f"_{o}") + e).alias(f"_b{len(r)}")] for r in reach for e in (-EPS, EPS)]
    points = points.withColumn("_bin", F.explode(F.array_distinct(F.array(*[F.struct(*r) for r in reach]))))
    target = target.withColumn("_at", F.struct(*[place(F.col(o)).alias(f"_b{k}") for k, o in enumerate(objectives)]))
    near = reduce(lambda p, q: p & q, [F.abs(F.col(f"_{o}") - F.col(o)) <= EPS for o in objectives])
    met = target.join(points, (F.col(scenario) == F.col("_s")) & (F.col("_at") == F.col("_bin")) & near).groupBy(scenario, method, *objectives).agg(F.first("n").alias("n"))
    hits = met.groupBy(scenario, method).agg(F.sum("n").alias("hits"))
    every = solutions.select(scenario, method).distinct().join(target.groupBy(scenario).agg(F.sum("n").alias("n")), scenario)
    return every.join(hits, [scenario, method], "left").select(scenario, method, (F.coalesce("hits", F.lit(0)) / F.col("n")).alias("recall"))


def additive_epsilon(solutions: DataFrame, front: DataFrame, objectives: list[str], scenario: str = "scenario", method: str = "method") -> DataFrame:
    """The least shift that lets a method weakly dominate the whole shared front; only the methods' skylines matter."""
    target = front.select(scenario, *objectives).distinct()
    points = skyline(solutions.select(scenario, method, *objectives).distinct(), objectives, [scenario, method])
    points = points.select(F.col(scenario).alias("_s"), method, *[F.col(o).alias(f"_{o}") for o in objectives])
    gap = F.greatest(*[F.col(f"_{o}") - F.col(o) for o in objectives])
    worst = target.join(points, F.col(scenario) == F.col("_s")).groupBy(scenario, method, *objectives).agg(F.min(gap).alias("gap"))
    return worst.groupBy(scenario, method).agg(F.max("gap").alias("epsilon"))


def volume(points: np.ndarray, ref: np.ndarray) -> float:
    """Exact volume of the union of boxes [point, ref], by slices along the last axis."""
    points = points[(points < ref - EPS).all(axis=1)]
    if not len(points):
        return 0.0
    points = points[local_front(points)]
    points = points[np.argsort(points[:, 2], kind="stable")]
    levels = np.append(np.unique(points[:, 2]), ref[2])
    total = 0.0
    for low, high in zip(levels[:-1], levels[1:]):
        flat = points[points[:, 2] <= low + EPS]
        flat = flat[np.lexsort((flat[:, 1], flat[:, 0]))]
        area, top = 0.0, ref[1]
        for x, y, _ in flat:
            if y < top:
                area += (ref[0] - x) * (top - y)
                top = y
        total += area * (high - low)
    return total


def hypervolume(solutions: DataFrame, reference: DataFrame, objectives: list[str], scenario: str = "scenario", method: str = "method") -> DataFrame:
    """Volume that each method's front dominates below the scenario's reference point.

    Only skyline points reach the grouped kernel, one task a scenario and method.
    """
    slim = skyline(solutions.select(scenario, method, *objectives), objectives, [scenario, method])
    rows = slim.join(reference, scenario)
    refs = [f"ref_{o}" for o in objectives]

    rows = rows.select(scenario, method, *objectives, *refs)

    def kernel(key: tuple, table: pa.Table) -> pa.Table:
        values = np.column_stack([table.column(o).to_numpy() for o in objectives]).astype(float)
        ref = np.array([table.column(r)[0].as_py() for r in refs], float)
        return table.select([scenario, method]).slice(0, 1).append_column("hypervolume", pa.array([volume(values, ref)]))

    schema = T.StructType([rows.schema[scenario], rows.schema[method], T.StructField("hypervolume", T.DoubleType())])
    return rows.groupBy(scenario, method).applyInArrow(kernel, schema)


def scenario_metrics(solutions: DataFrame, objectives: list[str], scenario: str = "scenario", method: str = "method", runs: DataFrame | None = None) -> DataFrame:
    """All measures of every method against its scenario's shared front.

    ``runs`` has ``scenario, method, feasible``, one row a run also where there are no solutions; without it
    the methods are those with solutions. A method without solutions has hypervolume 0, recall 0 and no epsilon; where
    no method of the scenario has any, recall is 1 and epsilon 0. ``coverage`` maps each other method to C(own, other).
    """
    runs = methods_of(solutions, scenario, method) if runs is None else runs.select(scenario, method, "feasible")
    front = union_front(solutions, objectives, scenario)
    ref = reference_point(front, objectives, scenario)
    own = hypervolume(solutions, ref, objectives, scenario, method)
    whole = hypervolume(front.withColumn("_all", F.lit(0)), ref, objectives, scenario, "_all").select(scenario, F.col("hypervolume").alias("union_hv"))
    out = runs.join(own, [scenario, method], "left").join(whole, scenario, "left").join(ref, scenario, "left")
    out = out.join(additive_epsilon(solutions, front, objectives, scenario, method), [scenario, method], "left").join(recall(solutions, front, objectives, scenario, method), [scenario, method], "left")
    covers = coverage(solutions, objectives, scenario, method, runs).groupBy(scenario, F.col("a").alias(method)).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("b", "coverage")))).alias("coverage"))
    out = out.join(covers, [scenario, method], "left")
    volume_ = F.coalesce("hypervolume", F.lit(0.0))
    share = F.when(F.col("union_hv") > EPS, volume_ / F.col("union_hv")).otherwise(F.when(F.col("feasible"), 1.0).otherwise(0.0))
    alone = F.col("union_hv").isNull()  # no method of the scenario has a solution
    epsilon, found = F.when(alone, 0.0).otherwise(F.col("epsilon")), F.when(alone, 1.0).otherwise(F.coalesce("recall", F.lit(0.0)))
    return out.select(scenario, method, "feasible", volume_.alias("hypervolume"), share.alias("normalized_hypervolume"), epsilon.alias("additive_epsilon"), found.alias("union_front_recall"), *[f"ref_{o}" for o in objectives], "coverage")


#: Names of the summary's columns for the least costs and the reference point, by objective.
BEST = ("best_f1_time_s", "best_f2_nav_deficit_s", "best_f3_visibility_deficit_s")
REFERENCE = ("reference_f1", "reference_f2", "reference_f3")


def summary_rows(solutions: DataFrame, runs: DataFrame, objectives: list[str], methods: list[str], scenario: str = "scenario", method: str = "method") -> DataFrame:
    """One summary row a run: what ``runs`` says of it (source, feasible, run time, counters, memory), the number and least
    costs of its solutions, its measures, the reference point, and ``coverage_of_<method>`` for each of ``methods``."""
    least = solutions.groupBy(scenario, method).agg(F.count("*").alias("solution_count"), *[F.min(o).alias(b) for o, b in zip(objectives, BEST)])
    m = scenario_metrics(solutions, objectives, scenario, method, runs).drop("feasible")
    rows = runs.join(least, [scenario, method], "left").join(m, [scenario, method], "left").withColumn("solution_count", F.coalesce("solution_count", F.lit(0)))
    rows = rows.withColumnsRenamed({f"ref_{o}": r for o, r in zip(objectives, REFERENCE)})
    return rows.select("*", *[F.try_element_at("coverage", F.lit(x)).alias(f"coverage_of_{x}") for x in methods]).drop("coverage")
