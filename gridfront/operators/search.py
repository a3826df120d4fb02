"""Exact and scalarised route search, one grouped kernel a case.

The edge relation comes from Spark; the ordered search itself has no relational form, so each case
(or case and weight) is one ``applyInPandas`` group over its edges. A group holds one grid's edges
(at most 8 a cell) beside its labels; cases are independent and spread over the cluster. ``fastest``
holds only the edges around both ends, as far as the result depends on them.
"""

from __future__ import annotations

import heapq
import time
import tracemalloc
from bisect import bisect_left
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfront.functions.scalars import INF, simplex_weights, turn_table
from gridfront.operators.edges import few
from gridfront.operators.paths import checkpointed

PATH = "array<struct<x:int,y:int>>"
#: A run of a method on a case, and a route of one (``search``).
RUNS = f"case_id string, method string, feasible boolean, runtime_ms double, n_expanded long, n_generated long, peak_memory_kib double, solutions array<struct<f1:double,f2:double,f3:double,path:{PATH}>>"
RUN_NAMES = ["case_id", "method", "feasible", "runtime_ms", "n_expanded", "n_generated", "peak_memory_kib", "solutions"]
ROUTES = f"case_id string, method string, route_id int, f1 double, f2 double, f3 double, path {PATH}, n_expanded long, n_generated long"
SLACK = 1e-12


class Graph:
    """Adjacency of one case; turns and energy as the parameters say."""

    def __init__(self, pdf: pd.DataFrame):
        first = pdf.iloc[0]
        self.start, self.goal = (int(first.sx), int(first.sy)), (int(first.gx), int(first.gy))
        self.out: dict = defaultdict(list)
        self.into: dict = defaultdict(list)
        for r in pdf[pdf.c1.notna()].sort_values(["x", "y", "x1", "y1"]).itertuples():
            a, b, c = (int(r.x), int(r.y)), (int(r.x1), int(r.y1)), (r.c1, r.c2, r.c3)
            self.out[a].append((b, c))
            self.into[b].append((a, c))
        limit = first.min_turn_radius_m
        self.headed = not pd.isna(limit)
        self.allowed = {k: r + SLACK >= limit for k, r in turn_table(first.resolution_m).items()} if self.headed else {}
        battery = first.battery_wh
        self.budget = INF if pd.isna(battery) else 3600.0 * (battery - (0.0 if pd.isna(first.reserve_wh) else first.reserve_wh)) / first.power_w
        sites = first.sites
        self.sites = None if sites is None or pd.isna(battery) else {(int(s["x"]), int(s["y"])) for s in sites}
        self.landing = None if self.sites is None else self.times_to_landing()

    def may_turn(self, heading, step) -> bool:
        return heading is None or not self.headed or self.allowed[(*heading, *step)]

    def to_goal(self, weight) -> dict:
        """Least weighted cost from every cell to the goal."""
        best, heap = {self.goal: 0.0}, [(0.0, self.goal)]
        while heap:
            d, v = heapq.heappop(heap)
            if d > best[v]:
                continue
            for u, c in self.into[v]:
                n = d + weight(c)
                if n < best.get(u, INF):
                    best[u] = n
                    heapq.heappush(heap, (n, u))
        return best

    def times_to_landing(self) -> dict:
        """Least flight time to a site, by (cell, incoming step) where turns are limited, else by cell."""
        if not self.headed:
            best = {s: 0.0 for s in self.sites}
            heap = [(0.0, s) for s in sorted(best)]
            while heap:
                d, v = heapq.heappop(heap)
                if d > best[v]:
                    continue
                for u, c in self.into[v]:
                    if d + c[0] < best.get(u, INF):
                        best[u] = d + c[0]
                        heapq.heappush(heap, (best[u], u))
            return best
        steps = sorted({k[:2] for k in self.allowed})
        best = {(s, h): 0.0 for s in self.sites for h in steps}
        heap = sorted((0.0, k) for k in best)
        cells = set(self.out) | set(self.into) | {self.start}
        while heap:
            d, (v, h) = heapq.heappop(heap)
            if d > best[v, h]:
                continue
            u = (v[0] - h[0], v[1] - h[1])
            cost = next((c[0] for w, c in self.out.get(u, ()) if w == v), None)
            if cost is None:
                continue
            for g in steps:
                if self.allowed[(*g, *h)] and (u[0] - g[0], u[1] - g[1]) in cells and d + cost < best.get((u, g), INF):
                    best[u, g] = d + cost
                    heapq.heappush(heap, (best[u, g], (u, g)))
        return best

    def can_land(self, v, heading, time: float) -> bool:
        if time > self.budget + SLACK:
            return False
        if self.landing is None:
            return True
        if v in self.sites:
            left = 0.0
        elif not self.headed:
            left = self.landing.get(v, INF)
        elif heading is None:
            left = min((c[0] + self.landing.get((u, (u[0] - v[0], u[1] - v[1])), INF) for u, c in self.out[v]), default=INF)
        else:
            left = self.landing.get((v, heading), INF)
        return left < INF and time + left <= self.budget + SLACK


def walk(parents: list, k: int, cells: list) -> list[dict]:
    path = []
    while k >= 0:
        path.append({"x": cells[k][0], "y": cells[k][1]})
        k = parents[k]
    return path[::-1]


def exact_front(g: Graph) -> tuple[list, int, int]:
    """All cost-unique non-dominated routes, by label setting in lexicographic order of g + h.

    Labels leave the heap by ascending first objective, so a state's front needs only the other two.
    """
    if g.start == g.goal:
        return [((0.0, 0.0, 0.0), [{"x": g.start[0], "y": g.start[1]}])], 0, 0
    ahead = [g.to_goal(lambda c, j=j: c[j]) for j in range(3)]
    if any(g.start not in h for h in ahead) or not g.can_land(g.start, None, 0.0):
        return [], 0, 0
    cells, parents, heads, costs = [g.start], [-1], [None], [(0.0, 0.0, 0.0)]
    heap = [(tuple(h[g.start] for h in ahead), 0)]
    fronts: dict = defaultdict(list)  # ascending second objective, descending third
    found: list[tuple[tuple, int]] = []
    popped = made = 0

    def beaten(front: list, c: tuple) -> bool:
        k = bisect_left(front, (c[1], INF))
        return any(p[1] <= c[2] for p in front[:k])

    while heap:
        f, k = heapq.heappop(heap)
        popped += 1
        v, c, head = cells[k], costs[k], heads[k]
        key = (v, head if g.headed else None)
        if beaten(fronts[key], c) or any(all(a <= b for a, b in zip(s, f)) for s, _ in found):
            continue
        if v == g.goal:
            found = [(s, i) for s, i in found if not all(a <= b for a, b in zip(c, s))] + [(c, k)]
            continue
        front = [p for p in fronts[key] if not (c[1] <= p[0] and c[2] <= p[1])]
        front.insert(bisect_left(front, (c[1], c[2])), (c[1], c[2]))
        fronts[key] = front
        for u, w in g.out[v]:
            step = (u[0] - v[0], u[1] - v[1])
            if u not in ahead[0] or not g.may_turn(head, step):
                continue
            n = (c[0] + w[0], c[1] + w[1], c[2] + w[2])
            made += 1
            if not g.can_land(u, step, n[0]):
                continue
            nf = tuple(a + h[u] for a, h in zip(n, ahead))
            if beaten(fronts.get((u, step if g.headed else None), []), n) or any(all(a <= b for a, b in zip(s, nf)) for s, _ in found):
                continue
            cells.append(u)
            parents.append(k)
            heads.append(step)
            costs.append(n)
            heapq.heappush(heap, (nf, len(cells) - 1))
    return [(c, walk(parents, k, cells)) for c, k in sorted(found)], popped, made


def best_route(g: Graph, weights: tuple[float, float, float]) -> tuple[list, int, int]:
    """One route of least weighted cost; states keep labels that no other beats in both cost and time."""
    total = sum(weights)
    if min(weights) < 0 or total <= 0:
        raise ValueError("weights must not be negative and must have a positive sum")
    w = [x / total for x in weights]
    value = lambda c: w[0] * c[0] + w[1] * c[1] + w[2] * c[2]
    if g.start == g.goal:
        return [((0.0, 0.0, 0.0), [{"x": g.start[0], "y": g.start[1]}])], 0, 0
    ahead = g.to_goal(value)
    if g.start not in ahead or not g.can_land(g.start, None, 0.0):
        return [], 0, 0
    cells, parents, heads, costs = [g.start], [-1], [None], [(0.0, 0.0, 0.0)]
    heap, kept, popped, made = [(ahead[g.start], 0.0, 0)], defaultdict(list), 0, 0
    while heap:
        _, _, k = heapq.heappop(heap)
        v, c, head = cells[k], costs[k], heads[k]
        key = (v, head if g.headed else None)
        if any(a <= value(c) + SLACK and t <= c[0] + SLACK for a, t in kept[key]):
            continue
        kept[key].append((value(c), c[0]))
        popped += 1
        if v == g.goal:
            return [(c, walk(parents, k, cells))], popped, made
        for u, e in g.out[v]:
            step = (u[0] - v[0], u[1] - v[1])
            n = (c[0] + e[0], c[1] + e[1], c[2] + e[2])
            if u not in ahead or not g.may_turn(head, step) or not g.can_land(u, step, n[0]):
                continue
            made += 1
            cells.append(u)
            parents.append(k)
            heads.append(step)
            costs.append(n)
            heapq.heappush(heap, (value(n) + ahead[u], n[0], len(cells) - 1))
    return [], popped, made


def repeated_weighted(g: Graph) -> tuple[list, int, int]:
    """Routes of all quarter weights, without those within tolerance of an earlier one, then the front of them."""
    unique: list = []
    popped = made = 0
    for weights in simplex_weights(4):
        routes, p, m = best_route(g, weights)
        popped, made = popped + p, made + m
        unique += [r for r in routes if not any(all(abs(a - b) <= 1e-9 for a, b in zip(r[0], u[0])) for u in unique)]
    front = [r for r in unique if not any(all(a <= b for a, b in zip(u[0], r[0])) and u[0] != r[0] for u in unique)]
    return sorted(front, key=lambda r: r[0]), popped, made


#: Methods by name; more can be registered.
METHODS = {"exact": exact_front, "time_only": lambda g: best_route(g, (1.0, 0.0, 0.0)), "repeated_weighted": repeated_weighted}


def dealt(edges: DataFrame, params: DataFrame, methods: tuple[str, ...]) -> DataFrame:
    """The rows of each case and method: its parameters once, without an edge, and its edges, without parameters.

    A union, since a join on a case that is one literal has no key left and would send all edges to the driver.
    """
    columns = ["resolution_m", "min_turn_radius_m", "battery_wh", "reserve_wh", "power_w", "sites"]
    p = params.select("case_id", F.col("start.x").alias("sx"), F.col("start.y").alias("sy"), F.col("goal.x").alias("gx"), F.col("goal.y").alias("gy"), *columns)
    rows = p.unionByName(edges.select("case_id", "x", "y", "x1", "y1", "c1", "c2", "c3"), allowMissingColumns=True).withColumn("method", F.explode(F.array(*map(F.lit, methods))))
    # dealt out by number, so that small cases are not put together into one task
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "case_id", "method")


def led(pdf: pd.DataFrame) -> pd.DataFrame | None:
    """A group of ``dealt`` led by its parameters; none for edges of a case without parameters."""
    own = pdf.sx.notna()
    return pd.concat([pdf[own], pdf[~own]]) if own.any() else None


def runs(edges: DataFrame, params: DataFrame, methods: tuple[str, ...] = ("exact",), measure_memory: bool = False) -> DataFrame:
    """``RUNS`` rows: one for every case and method, also where there is no route; one task a case and method.

    The time is that of the search alone. ``measure_memory`` runs it once more under an allocation trace.
    """
    chosen = {m: METHODS[m] for m in methods}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if (pdf := led(pdf)) is None:
            return pd.DataFrame(columns=RUN_NAMES, dtype=object)
        case, method = pdf.case_id.iloc[0], pdf.method.iloc[0]
        began = time.perf_counter()
        routes, popped, made = chosen[method](Graph(pdf))
        took, peak = 1e3 * (time.perf_counter() - began), None
        if measure_memory:
            tracemalloc.start()
            chosen[method](Graph(pdf))
            peak = tracemalloc.get_traced_memory()[1] / 1024
            tracemalloc.stop()
        found = [dict(zip(("f1", "f2", "f3"), c), path=path) for c, path in routes]
        return pd.DataFrame([(case, method, bool(routes), took, popped, made, peak, found)], columns=RUN_NAMES, dtype=object)

    return dealt(edges, params, methods).groupBy("case_id", "method").applyInPandas(run, RUNS)


def routes_of(runs_: DataFrame) -> DataFrame:
    """``ROUTES`` rows of runs: their solutions one by one."""
    r = runs_.select("case_id", "method", F.posexplode("solutions").alias("route_id", "s"), "n_expanded", "n_generated")
    return r.select("case_id", "method", "route_id", "s.f1", "s.f2", "s.f3", "s.path", "n_expanded", "n_generated")


def search(edges: DataFrame, params: DataFrame, methods: tuple[str, ...] = ("exact",)) -> DataFrame:
    """Routes of every case by every method; infeasible cases have no rows."""
    return routes_of(runs(edges, params, methods))


def settled(g: Graph, box: tuple[int, int, int, int], routes: list) -> bool:
    """Whether no edge that starts beyond ``box`` and the cells around it can change a search for the fastest route.

    The fastest way to the goal from any cell outside ends in edges that start in or next to the box. So if all cells no
    farther from the goal than the start is lie inside, their costs are those of the whole grid and the search takes no
    other cell. Cells next to these that have no way to the goal yet must have none outside either.
    """
    inside = lambda v: box[0] <= v[0] <= box[2] and box[1] <= v[1] <= box[3]

    def leaves(cells) -> bool:
        seen, todo = set(cells), list(cells)
        while todo:
            v = todo.pop()
            if not inside(v):
                return True
            new = {u for u, _ in g.out[v]} - seen
            seen |= new
            todo += new
        return False

    if g.start == g.goal:
        return True
    ahead = g.to_goal(lambda c: c[0])
    if not routes:
        return (g.start not in ahead and all(map(inside, ahead))) or not leaves([g.start])
    most = routes[0][0][0] * (1 + 1e-9) + SLACK
    near = [v for v, h in ahead.items() if h <= most]
    return all(map(inside, near)) and not leaves({u for v in near for u, _ in g.out[v] if u not in ahead})


def around(margin: int):
    """The kernel of ``fastest``: a run and whether the edges at hand settle it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if (pdf := led(pdf)) is None:
            return pd.DataFrame(columns=[*RUN_NAMES, "settled"], dtype=object)
        g = Graph(pdf)
        routes, popped, made = best_route(g, (1.0, 0.0, 0.0))
        (ax, ay), (bx, by) = g.start, g.goal
        box = (min(ax, bx) - margin, min(ay, by) - margin, max(ax, bx) + margin, max(ay, by) + margin)
        found = [dict(zip(("f1", "f2", "f3"), c), path=path) for c, path in routes]
        row = (pdf.case_id.iloc[0], "time_only", bool(routes), None, popped, made, None, found, g.sites is not None or settled(g, box, routes))
        return pd.DataFrame([row], columns=[*RUN_NAMES, "settled"], dtype=object)

    return run


def fastest(edges: DataFrame, params: DataFrame, margin: int = 64) -> DataFrame:
    """The rows of ``search`` by ``time_only``, from the edges around both ends alone where the others cannot matter.

    A task gets the edges that start at most ``margin`` + 1 cells beyond the rectangle of start and goal. Cases that these
    do not settle are searched again with four times the margin, in the end with the whole grid. Cases with landing
    sites take the whole grid at once.
    """
    whole = F.col("battery_wh").isNotNull() & F.col("sites").isNotNull()
    left, found = params, None
    while True:
        # long, for margins beyond the whole grid
        low, high = ([f(F.col(f"start.{c}"), F.col(f"goal.{c}")).cast("long") + by for c in "xy"] for f, by in ((F.least, -margin), (F.greatest, margin)))
        box = left.select("case_id", whole.alias("whole"), *[c.alias(n) for c, n in zip((*low, *high), ("x_lo", "y_lo", "x_hi", "y_hi"))])
        near = edges
        if few(left):
            # the rows around any case as plain numbers, which Spark applies before it makes edges
            box = F.broadcast(box)
            first, last, any_whole = box.agg(F.min("y_lo"), F.max("y_hi"), F.max("whole")).first()
            if first is not None and not any_whole:
                near = edges.filter(F.col("y").between(first - 1, last + 1))
        near = near.join(box, "case_id").filter("whole or x between x_lo - 1 and x_hi + 1 and y between y_lo - 1 and y_hi + 1")
        r = checkpointed(dealt(near, left, ("time_only",)).groupBy("case_id", "method").applyInPandas(around(margin), f"{RUNS}, settled boolean"))
        done = routes_of(r.filter("settled"))
        found = done if found is None else found.union(done)
        again = r.filter("not settled").select("case_id")
        if not again.limit(1).count():
            return found
        if left is params:
            edges = checkpointed(edges)
        left, margin = checkpointed(left.join(again, "case_id", "leftsemi")), 4 * margin


def exhaustive_front(g: Graph) -> list[tuple]:
    """Costs of the front over all simple paths; for tiny grids only. No energy rule."""
    costs: list[tuple] = []

    def visit(v, head, seen, c):
        if v == g.goal:
            costs.append(c)
            return
        for u, w in g.out[v]:
            step = (u[0] - v[0], u[1] - v[1])
            if u not in seen and g.may_turn(head, step):
                visit(u, step, seen | {u}, tuple(a + b for a, b in zip(c, w)))

    visit(g.start, None, {g.start}, (0.0, 0.0, 0.0))
    rounded = sorted({tuple(round(x, 6) for x in c) for c in costs})
    return [c for c in rounded if not any(all(a <= b for a, b in zip(o, c)) and o != c for o in rounded)]
