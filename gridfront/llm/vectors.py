"""Embedding near-duplicates over an inverted multi-index.

Two codebooks, learned independently on the halves of the unit vectors, form a product grid of
cells; each vector lies in the cell of its nearest centroids. For every vector the multi-sequence
traversal walks the grid from the nearest cells outwards, in the order of the sum of two sorted
sequences (lower bounds of the squared distance from the vector to a half's Voronoi cells), and
stops at a reach. The full reach is the squared distance of the weakest link, which misses none. A
lesser one is taken only where it is measured: at most ``PROBES`` vectors are compared with all
others by brute force, and in every stratum (``BANDS`` of squared distance, few or many links of
the probe) the mean over the probes of the share of links found must be ``RECALL``, so neither a
crowd nor tight links speak for the rest. A stratum with fewer than ``1 / (1 - RECALL)`` probes
measures nothing and keeps the full reach; only the strata of many links may be empty. Candidates
are then verified by their cosine in double precision.

A link counts for both ends, whichever of them visited the other. Only vectors with equal labels
and lengths meet; each length has an index of its own. Equal vectors are one class with a count. A
cell of n members is dealt out in square blocks of about ``16 * sqrt(n)`` a side (``LEAST`` to ``BLOCK``), by a
join with the cells' counts, so both tasks and copies grow with the root of n only. A block yields counts
and links that span its components, at most one row a member, never its pairs.

The codebooks are fitted on at most ``SAMPLE`` vectors (least hash); every vector is indexed, and the
grid grows with the number of vectors. At the full reach most cells of a fine grid may be visited;
then the grid is as coarse as makes rows dealt and comparisons least, down to one cell a label, which
compares all pairs of the label in blocks. A length that the sample lacks has one cell a label too.

Cases: null labels, and vectors that are null, empty, zero, or hold null or non-finite numbers, link
with nothing; a null ``vec_id`` is carried and counts as a neighbour but not in the least id; repeated
rows link with each other; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridfront.llm.common import components, cut, quiet_threads, release

SAMPLE, PROBES, RECALL = 8_000, 4_000, 0.995
#: Least and most members a side of a block, and steps of the measured reach.
LEAST, BLOCK, STEPS = 256, 20_000, 400
#: Bands of squared distance, links from which a probe has many, and comparisons that cost as much as a dealt row.
BANDS, MANY, PAIRS_A_ROW = 4, 8, 2_000


def sides_of(n: np.ndarray, block: int) -> np.ndarray:
    """Sides that ``n`` members of a cell are dealt out to."""
    return np.ceil(n / np.clip(16 * np.sqrt(n), min(LEAST, block), block))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances (rows, centroids), up to rounding; one product of matrices."""
    return (x**2).sum(axis=1)[:, None] - 2 * x @ c.T + (c**2).sum(axis=1)[None]


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Centroids of the rows; at most as many as there are distinct rows."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = squared(x, c).argmin(axis=1)
        c = np.array([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
    return np.unique(c, axis=0)


def cell_bounds(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Lower bounds (rows, centroids) of the squared distance from each row to each Voronoi cell."""
    d = squared(x, c)
    gap = 2 * np.sqrt(np.maximum(((c[:, None] - c[None]) ** 2).sum(axis=2), 1e-30))
    h = np.zeros_like(d)
    for k in range(len(c)):  # the bisector between k and the cell's own centroid
        h = np.maximum(h, (d - d[:, k : k + 1]) / gap[k][None, :])
    return h**2


def traverse(a: np.ndarray, b: np.ndarray, most: float) -> list[tuple[int, int]]:
    """Multi-sequence order: pairs of places (i, j) by increasing a[i] + b[j], both ascending, up to ``most``."""
    heap, out, pushed = [(a[0] + b[0], 0, 0)], [], {(0, 0)}
    while heap and heap[0][0] <= most:
        _, i, j = heapq.heappop(heap)
        out.append((i, j))
        for u, v in ((i + 1, j), (i, j + 1)):
            if u < len(a) and v < len(b) and (u, v) not in pushed:
                pushed.add((u, v))
                heapq.heappush(heap, (a[u] + b[v], u, v))
    return out


class Index:
    """Codebooks of both halves, and how far the traversal goes."""

    def __init__(self, sample: np.ndarray, threshold: float, centroids: int):
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        self.half = max(1, unit.shape[1] // 2)
        self.books = [kmeans(unit[:, : self.half], centroids, 1), kmeans(unit[:, self.half :], centroids, 2) if unit.shape[1] > 1 else np.zeros((1, 0))]
        self.most = self.reach = 2 - 2 * threshold + 1e-9

    def size(self) -> int:
        return len(self.books[0]) * len(self.books[1])

    def bounds(self, unit: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Bounds to each half's cells, 0 for the own one, and the own cells of the grid."""
        sides, own = [], []
        for part, book in zip((unit[:, : self.half], unit[:, self.half :]), self.books):
            near = squared(part, book).argmin(axis=1)
            bound = np.maximum(cell_bounds(part, book), 1e-12)
            bound[np.arange(len(part)), near] = 0.0
            sides.append(bound)
            own.append(near)
        return sides, own[0] * len(self.books[1]) + own[1]

    def cells(self, unit: np.ndarray) -> list[list[int]]:
        """For each row the cells to visit; the first is its own."""
        sides, _ = self.bounds(unit)
        order = [b.argsort(axis=1, kind="stable") for b in sides]
        rising = [np.take_along_axis(b, o, axis=1) for b, o in zip(sides, order)]
        k = len(self.books[1])
        return [[int(order[0][r, i]) * k + int(order[1][r, j]) for i, j in traverse(rising[0][r], rising[1][r], self.reach)] for r in range(len(unit))]


def united(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Join the components of the pairs in ``label``: each root takes the least label met."""
    while True:
        p, q = label[x], label[y]
        apart = p != q
        if not apart.any():
            return
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while not ((up := label[label]) == label).all():
            label[:] = up


def verify(own: dict, asking: dict, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links between own and asking rows: what each row of either gains, and component roots over both.

    Rows have unit vectors ``x``, ``node``, ``times`` and ``home`` cell; own rows also ``visits``, lists of
    the cells they visit. An asking row gains the copies of the rows it finds; an
    own row gains those of the rows that find it and that it does not visit. Own rows stand first.
    """
    n, m = len(own["node"]), len(asking["node"])
    gain, label = np.zeros(n + m, np.int64), np.arange(n + m)
    who = np.repeat(np.arange(n), [len(v) for v in own["visits"]])
    where = np.concatenate(own["visits"]) if n else np.zeros(0, np.int32)
    for a in range(0, m, 1024):
        homes, column = np.unique(asking["home"][a : a + 1024], return_inverse=True)
        k = np.minimum(np.searchsorted(homes, where), len(homes) - 1)
        hit = homes[k] == where
        seen = np.zeros((n, len(homes)), bool)
        seen[who[hit], k[hit]] = True
        for b in range(0, n, 2048):
            near = asking["x"][a : a + 1024] @ own["x"][b : b + 2048].T >= threshold
            near &= asking["node"][a : a + 1024, None] != own["node"][None, b : b + 2048]
            gain[n + a : n + a + len(near)] += near @ own["times"][b : b + 2048]
            unseen = near & ~seen[b : b + 2048][:, column].T
            gain[b : b + near.shape[1]] += asking["times"][a : a + 1024] @ unseen
            x, y = np.nonzero(near)
            united(label, x + a + n, y + b)
    return gain, label


def vectors_of(column: pa.Array, kind: str, dim: int) -> np.ndarray:
    """Unit vectors, in double precision, of a column of raw vectors."""
    x = np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True) if len(x) else x
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_duplicates(rows: DataFrame, threshold: float = 0.93, recall: float = RECALL, block: int = BLOCK, centroids: int | None = None) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row."""
    spark = rows.sparkSession
    single = rows.schema["embedding"].dataType.simpleString() == "array<float>"
    element, kind = ("float", "<f4") if single else ("double", "<f8")
    v = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{element}>").alias("e"), F.col("label").cast("string").alias("label"))
    sound = "label is not null and e is not null and size(e) > 0 and forall(e, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(e, x -> x <> 0)"
    v = v.withColumn("ok", F.coalesce(F.expr(sound), F.lit(False))).withColumn("k1", F.xxhash64("label", "e")).withColumn("k2", F.hash("label", "e"))
    classes = v.filter("ok").groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count("*").alias("times"), F.first("label").alias("label"), F.first("e").alias("e"))
    # numbered, not hashed, so no two classes share a node; the numbers hold because the table is written
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    totals = {r.dim: r["count"] for r in classes.groupBy(F.size("e").alias("dim")).count().collect()}
    sample = classes.select("node", "label", "e").orderBy(F.xxhash64("k1", "k2"), "k1", "k2").limit(SAMPLE).collect()
    by: dict[int, list] = {}
    for r in sample:
        by.setdefault(len(r.e), []).append(r)
    main = max(by, key=lambda k: (len(by[k]), k), default=1)

    def raw(batches):
        for b in batches:
            e = b.column("e")
            ends = np.asarray(e.offsets)
            held = np.ascontiguousarray(np.asarray(e.values)[ends[0] : ends[-1]], dtype=kind)
            at = ((ends - ends[0]) * held.itemsize).astype(np.int32)
            x = pa.Array.from_buffers(pa.binary(), len(e), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(held.tobytes())])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("node", "label", "times", "dim")), x], ["node", "label", "times", "dim", "x"])

    fit = classes.select("node", "label", "times", F.size("e").alias("dim"), "e").mapInArrow(raw, "node long, label string, times long, dim int, x binary")
    indexes: dict[int, Index] = {}
    for dim, found in by.items():
        points = np.array([r.e for r in found], dtype=np.float64)
        index = Index(points, threshold, centroids or int(np.clip(round((totals[dim] / 2000) ** 0.5), 8, 256)))
        if dim == main:
            index.reach = measured_reach(fit.filter(F.col("dim") == dim), index, found[:PROBES], threshold, recall, kind, dim)
        if index.reach == index.most and centroids is None:
            index = cheapest(index, points, [r.label for r in found], threshold, totals[dim], block)
        indexes[dim] = index
    shared = spark.sparkContext.broadcast(indexes)

    def assign(batches):
        quiet_threads()
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                some = whole.slice(at, 2048)
                dims = some.column("dim").to_numpy()
                for dim in np.unique(dims):
                    b = some.filter(pa.array(dims == dim))
                    index = shared.value.get(int(dim)) or Index(np.ones((1, dim)), threshold, 1)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(index.cells(vectors_of(b.column("x"), kind, dim)), pa.list_(pa.int32()))], [*b.schema.names, "cells"])

    placed = cut(fit.mapInArrow(assign, "node long, label string, times long, dim int, x binary, cells array<int>"), "vectors-cells")
    held = placed.select("label", "dim", F.explode("cells").alias("cell")).groupBy("label", "dim", "cell").count()
    side = F.ceil(F.col("count") / F.greatest(F.lit(min(LEAST, block)), F.least(F.lit(block), 16 * F.sqrt("count")))).cast("int")
    visit = placed.select("*", F.posexplode("cells").alias("nth", "cell")).join(held.select("label", "dim", "cell", side.alias("side")), ["label", "dim", "cell"])
    mine = F.pmod(F.xxhash64("node"), F.col("side")).cast("int")
    every = F.sequence(F.lit(0), F.col("side") - 1)
    square = lambda own, a, b: F.struct(a.alias("a"), b.alias("b"), F.lit(own).alias("own"))
    asks, owns = F.transform(every, lambda i: square(False, i, mine)), F.transform(every, lambda i: square(True, mine, i))
    to = F.explode(F.when(F.col("nth") == 0, F.concat(asks, owns)).otherwise(asks)).alias("to")
    dealt = visit.select("label", "dim", "cell", "node", "times", "x", "cells", to).select("label", "dim", "cell", "to.*", "node", "times", "x", F.col("cells")[0].alias("home"), F.when(F.col("to.own"), F.col("cells")).alias("visits"))

    def meet(table: pa.Table) -> pa.Table:
        quiet_threads()
        dim = table.column("dim")[0].as_py()
        sides = []
        for part in (table.filter(table.column("own")), table.filter(pc.invert(table.column("own")))):
            sides.append({"x": vectors_of(part.column("x"), kind, dim), "node": part.column("node").to_numpy(), "times": part.column("times").to_numpy(), "home": part.column("home").to_numpy(), "visits": [np.array(c, np.int32) for c in part.column("visits").to_pylist() if c is not None]})
        gain, label = verify(*sides, threshold)
        names = np.concatenate([s["node"] for s in sides])
        root = names[label]
        some = (gain > 0) | (root != names)
        return pa.table({"u": names[some], "v": root[some], "n": gain[some]})

    met = cut(dealt.groupBy("label", "dim", "cell", "a", "b").applyInArrow(meet, "u long, v long, n long"), "vectors-links")
    release(placed)
    joined = components(met.filter("u <> v").select("u", "v"), "vectors")
    links = met.groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    known = classes.select("node", "k1", "k2", "least", "times").join(links, "node", "left").join(joined, "node", "left").select("k1", "k2", "least", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    known = cut(known, "vectors-classes")
    release(classes, met, joined)
    ids = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(ids, "component").select("k1", "k2", "n_links", "component_id", F.lit(True).alias("ok"))
    out = v.select("vec_id", "ok", "k1", "k2").join(known, ["ok", "k1", "k2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def cheapest(index: Index, points: np.ndarray, labels: list, threshold: float, total: int, block: int) -> Index:
    """The index, or one of fewer cells, whose full reach costs least: rows dealt and comparisons, by the sample."""
    code = np.unique(labels, return_inverse=True)[1] if labels else np.zeros(len(points), int)
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    some, best, least, k = min(len(points), 500), index, math.inf, max(len(b) for b in index.books)
    while True:
        grid = index.size()
        home = np.concatenate([index.bounds(unit[at : at + 1024])[1] for at in range(0, len(unit), 1024)])
        held = np.bincount(code * grid + home, minlength=(code.max() + 1) * grid).reshape(-1, grid) * (total / len(points))
        cost = 0.0
        for c, cells in zip(code[:some], index.cells(unit[:some])):
            cost += sides_of(held[c, cells], block).sum() * PAIRS_A_ROW + held[c, cells].sum()
        if cost < least:
            best, least = index, cost
        if k == 1:
            return best
        k //= 2
        index = Index(points, threshold, k)


def measured_reach(fit: DataFrame, index: Index, probes: list, threshold: float, recall: float, kind: str, dim: int) -> float:
    """The least reach at which, in every stratum, probes find the share ``recall`` of their links from either end; else the full one."""
    by_label: dict[str, list] = {}
    for k, r in enumerate(probes):
        by_label.setdefault(r.label, []).append((k, r))
    packed = {label: ([k for k, _ in rs], [r.node for _, r in rs], np.array([r.e for _, r in rs], dtype=np.float64)) for label, rs in by_label.items()}
    shared = fit.sparkSession.sparkContext.broadcast((index, packed))

    def weigh(batches):
        quiet_threads()
        own, probes_ = shared.value
        prepared = {}
        for k, (places, nodes, e) in probes_.items():
            unit = e / np.linalg.norm(e, axis=1, keepdims=True)
            prepared[k] = (np.array(places), np.array(nodes), unit, *own.bounds(unit))
        books = len(own.books[1])
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                labels = np.array(b.column("label").to_pylist(), dtype=object)
                x, node = vectors_of(b.column("x"), kind, dim), b.column("node").to_numpy()
                for k in set(labels):
                    if k not in prepared:
                        continue
                    rows = np.flatnonzero(labels == k)
                    places, names, unit, sides, homes = prepared[k]
                    cosine = x[rows] @ unit.T
                    i, j = np.nonzero((cosine >= threshold) & (node[rows][:, None] != names[None]))
                    if len(i):
                        theirs, cells = own.bounds(x[rows])
                        there = theirs[0][i, homes[j] // books] + theirs[1][i, homes[j] % books]
                        back = sides[0][j, cells[i] // books] + sides[1][j, cells[i] % books]
                        step = np.minimum(np.ceil(np.minimum(there, back) / own.most * STEPS).astype(int), STEPS)
                        band = np.clip((2 - 2 * cosine[i, j]) / own.most * BANDS, 0, BANDS - 1).astype(int)
                        code, n = np.unique((places[j] * BANDS + band) * (STEPS + 1) + step, return_counts=True)
                        rest, step = np.divmod(code, STEPS + 1)
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in ((rest // BANDS, pa.int32()), (rest % BANDS, pa.int32()), (step, pa.int32()), (n, pa.int64()))], ["probe", "band", "step", "n"])

    found = fit.mapInArrow(weigh, "probe int, band int, step int, n long").groupBy("probe", "band", "step").agg(F.sum("n").alias("n"))
    of = lambda *keys: F.sum("n").over(Window.partitionBy(*keys))
    found = found.select("band", "step", (of("probe") >= MANY).alias("many"), (F.col("n") / of("probe", "band")).alias("share"))
    strata = {(band, many): {} for band in range(BANDS) for many in (False, True)}
    for r in found.groupBy("band", "many", "step").agg(F.sum("share").alias("share")).collect():
        strata[r.band, r.many][r.step] = r.share
    reach = 0
    for (_, many), shares in strata.items():
        total, so_far = sum(shares.values()), 0.0  # the shares of a probe add up to 1
        if many and not shares:
            continue
        if recall >= 1 or total < 1 / (1 - recall) - 1e-6:
            return index.most
        for step in sorted(shares):
            so_far += shares[step]
            if so_far >= recall * total - 1e-9:
                reach = max(reach, step)
                break
    return index.most if reach == STEPS else index.most * reach / STEPS + 1e-9
