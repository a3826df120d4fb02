"""TOPSIS ranking and weight profiles; all groups and profiles in one pass of aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfront.operators.ordering import ranked

#: Weight profiles over (time, navigation, visibility).
PROFILES = {"emergency": (0.7, 0.2, 0.1), "balanced": (0.5, 0.3, 0.2), "localization_visibility": (0.2, 0.5, 0.3)}


def with_ideals(rows: DataFrame, objectives: list[str], keys: list[str]) -> DataFrame:
    """Adds each group's column norms and ideal points: one aggregate a group, joined back to its rows."""
    stats = rows.groupBy(*keys).agg(*[e for o in objectives for e in (F.sqrt(F.sum(F.col(o) * F.col(o))).alias(f"_n_{o}"), F.min(o).alias(f"_lo_{o}"), F.max(o).alias(f"_hi_{o}"))])
    return rows.join(stats, keys) if keys else rows.join(F.broadcast(stats))  # without keys the aggregate is one row


def closeness(objectives: list[str], weights: list[float], maximize: tuple[str, ...] = ()) -> Column:
    """Closeness to the ideal of a row of ``with_ideals``; 0.5 where all rows of the group are equal."""
    plus, minus = F.lit(0.0), F.lit(0.0)
    for o, w in zip(objectives, weights):
        scale = F.lit(float(w)) / F.when(F.col(f"_n_{o}") > 0, F.col(f"_n_{o}")).otherwise(1.0)
        best, worst = (f"_hi_{o}", f"_lo_{o}") if o in maximize else (f"_lo_{o}", f"_hi_{o}")
        a, b = (F.col(o) - F.col(best)) * scale, (F.col(o) - F.col(worst)) * scale
        plus, minus = plus + a * a, minus + b * b
    plus, minus = F.sqrt(plus), F.sqrt(minus)
    return F.when(plus + minus > 0, minus / (plus + minus)).otherwise(0.5)


def topsis(rows: DataFrame, objectives: list[str], weights: list[float], keys: list[str], tie: str, maximize: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``closeness`` and ``rank`` within each group; ``tie`` orders rows of equal closeness."""
    r = with_ideals(rows, objectives, keys).withColumn("closeness", closeness(objectives, weights, maximize))
    r = r.select(*rows.columns, "closeness", (-F.round("closeness", 12)).alias("_down"))
    return ranked(r, keys, ["_down", tie], "rank").drop("_down")


def profile_selection(rows: DataFrame, objectives: list[str], keys: list[str], tie: str, profiles: dict[str, tuple] = PROFILES) -> DataFrame:
    """The best row of each group under each profile: one aggregate that keeps a row a group and profile."""
    r = with_ideals(rows, objectives, keys)
    each = F.inline(F.array(*[F.struct(F.lit(name).alias("profile"), closeness(objectives, list(w)).alias("closeness")) for name, w in profiles.items()]))
    best = r.select(*rows.columns, each).groupBy(*keys, "profile").agg(F.min_by(F.struct(*[c for c in rows.columns if c not in keys], "closeness"), F.struct(-F.round("closeness", 12), tie)).alias("_r"))
    return best.select(*keys, "profile", "_r.*")


def premiums(rows: DataFrame, objectives: list[str], baseline: str, tie: str, scenario: str = "scenario", method: str = "method", profiles: dict[str, tuple] = PROFILES) -> DataFrame:
    """Each method's choice under each profile against the baseline method's: ``time_premium``, ``nav_improvement`` and
    ``visibility_improvement``, null where the baseline has no route."""
    best = profile_selection(rows, objectives, [scenario, method], tie, profiles).select(scenario, method, "profile", *objectives)
    base = best.filter(F.col(method) == baseline).select(scenario, "profile", *[F.col(o).alias(f"_{o}") for o in objectives])
    f1, f2, f3 = objectives
    out = best.join(base, [scenario, "profile"], "left")
    return out.select(scenario, method, "profile", *objectives, (F.col(f1) - F.col(f"_{f1}")).alias("time_premium"), (F.col(f"_{f2}") - F.col(f2)).alias("nav_improvement"), (F.col(f"_{f3}") - F.col(f3)).alias("visibility_improvement"))


def best_per_objective(rows: DataFrame, objectives: list[str], keys: list[str], id_: str) -> DataFrame:
    """Each objective's minimum and the first row that has it."""
    return rows.groupBy(*keys).agg(*[e for o in objectives for e in (F.min(o).alias(f"best_{o}"), F.min_by(id_, F.struct(o, id_)).alias(f"best_{o}_{id_}"))])
