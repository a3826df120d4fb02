"""Fix-point operators as rounds of join and min: costs to targets, and components of a grid.

Rounds are cut with ``checkpoint()`` in the folder of ``spark.checkpoint.dir``, so that the plan
stays short and lost executors cost a stage.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfront.functions import scalars as S


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint; a single-process session without a folder gets a temporary one."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.conf.set("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="gridfront-"))
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    return df.checkpoint()


def cost_to_targets(edges: DataFrame, targets: DataFrame, cost: str, state: list[str], end: list[str], most: int = 10_000) -> DataFrame:
    """``state, cost``: the least total cost from each state over ``edges`` (state -> end) to any target.

    Only states improved in the last round send offers, so the work follows the frontier.
    """
    e = checkpointed(edges.select(*state, *[F.col(c).alias(f"_{i}") for i, c in enumerate(end)], F.col(cost).alias("w")))
    now = checkpointed(targets.select(*state, F.lit(0.0).alias("cost"), F.lit(True).alias("fresh")).distinct())
    for _ in range(most):
        fresh = now.filter("fresh").select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(state)], F.col("cost").alias("c"))
        offers = e.join(fresh, [f"_{i}" for i in range(len(end))]).groupBy(*state).agg(F.min(F.col("w") + F.col("c")).alias("offer"))
        better = F.col("cost").isNull() | (F.col("offer") < F.col("cost"))
        new = now.join(offers, state, "full").select(*state, F.when(better & F.col("offer").isNotNull(), F.col("offer")).otherwise(F.col("cost")).alias("cost"), F.coalesce(better & F.col("offer").isNotNull(), F.lit(False)).alias("fresh"))
        now = checkpointed(new)
        if not now.filter("fresh").limit(1).count():
            return now.select(*state, "cost")
    raise RuntimeError("no fix-point within the allowed rounds")


def heading_edges(turn_rows: DataFrame, edges: DataFrame, cost: str) -> DataFrame:
    """The line graph: states are cells with an incoming heading, moves are the allowed turns."""
    ok = turn_rows.filter("feasible").select("case_id", "x", "y", "hx", "hy", "dx", "dy")
    m = ok.join(edges.select("case_id", "x", "y", "dx", "dy", F.col(cost).alias("w")), ["case_id", "x", "y", "dx", "dy"])
    return m.select("case_id", "x", "y", "hx", "hy", (F.col("x") + F.col("dx")).alias("x1"), (F.col("y") + F.col("dy")).alias("y1"), "dx", "dy", "w")


def grid_components(cells: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, x, y, component``: 8-connected components of the given cells, numbered from 0 by their first cell in row order."""
    c = cells.select(*keys, "x", "y").distinct().withColumn("label", F.col("y").cast("long") * (1 << 32) + F.col("x"))
    steps = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in S.STEPS])).alias("s")
    home = c.select(*keys, "x", "y", F.col("label").alias("own"))
    now = checkpointed(c)
    while True:
        sent = now.select(*keys, "x", "y", "label", steps).select(*keys, (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"), "label")
        low = sent.groupBy(*keys, "x", "y").agg(F.min("label").alias("offer"))
        lower = now.join(low, [*keys, "x", "y"], "left").select(*keys, "x", "y", F.least("label", "offer").alias("label"), F.col("label").alias("was"))
        # pointer jumping: a label is a cell; take that cell's label
        lower = checkpointed(lower)
        head = lower.join(home, [*keys, "x", "y"]).select(*keys, F.col("own").alias("label"), F.col("label").alias("next"))
        moved = checkpointed(lower.join(head, [*keys, "label"], "left").select(*keys, "x", "y", F.least("label", F.coalesce("next", "label")).alias("label"), "was"))
        if not moved.filter("label <> was").limit(1).count():
            break
        now = moved.select(*keys, "x", "y", "label")
    # numbers by the order of first cells: global positions of the distinct labels, counted from each group's first
    from gridfront.operators.ordering import running_total

    heads = running_total(moved.select(*keys, "label").distinct().withColumn("one", F.lit(1)), [*keys, "label"], "one", "place")
    first = heads.groupBy(*keys).agg(F.min("place").alias("first"))
    heads = heads.join(first, keys).select(*keys, "label", (F.col("place") - F.col("first")).cast("int").alias("component"))
    return moved.join(heads, [*keys, "label"]).select(*keys, "x", "y", "component")
