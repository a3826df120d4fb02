"""Quality scores: random-indexing word vectors, pooled, then a two-layer network with a temperature.

Every word has a sparse random index vector (from its hash); its word vector adds the index vectors
of its neighbours over all texts. A document is the mean of its words' vectors beside the
mean of index vectors of word forms (capitals, marks, repeats) and its length. The network is
trained in numpy; a temperature fitted on rows kept out of training calibrates it.

The word vectors need no labels and count every row. The network trains on at most ``SAMPLE``
labelled rows, those with the least ``xxhash64(doc_id)``; scoring takes every row and whole texts.
Labels come only from rows whose fold is not 0.

Cases: a null or empty text has the zero vector and is scored like any other; null labels are left
out, and so is a ``doc_id`` with contradicting labels; without two classes of labels every score is
the share of label 1 (0.5 without labels); a null ``doc_id`` is scored and is of fold 0; repeated
rows are scored once each; an empty table gives no rows; a very long text is pooled whole, by pieces
of 50,000 words; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfront.llm.common import documents, fold, map_steps, quiet_threads, steps

#: Labelled rows that the network's training takes at most.
SAMPLE = 12_000
#: Folds of ``doc_id``; fold 0 is held out.
FOLDS = 5
BUCKETS, DIMS, HIDDEN, NONZERO, REACH = 1 << 14, 48, 24, 4, 2
FORMS = ("plain", "title", "upper", "number", "mark", "marks", "mixed", "long", "repeat")
WIDTH = 2 * DIMS + 2
#: Pairs of neighbours that are counted at once.
PAIRS = 500_000
_TOKEN = re.compile(r"\w+|[^\w\s]+")


def index_vectors(n: int, seed: int) -> np.ndarray:
    """Sparse ternary vectors: ``NONZERO`` of ``DIMS`` places hold plus or minus one."""
    rng = np.random.default_rng(seed)
    out = np.zeros((n, DIMS), dtype=np.float32)
    for _ in range(NONZERO):
        out[np.arange(n), rng.integers(0, DIMS, n)] += rng.choice(np.array([-1, 1], dtype=np.float32), n)
    return out


INDEX, FORM_INDEX = index_vectors(BUCKETS, 11), index_vectors(len(FORMS), 12)
PLACES = np.argsort(-np.abs(INDEX), axis=1, kind="stable")[:, :NONZERO]
WEIGHTS = np.take_along_axis(INDEX, PLACES, axis=1).astype(np.float64)


def form(token: str) -> int:
    if not (token[0].isalnum() or token[0] == "_"):
        return FORMS.index("mark" if len(token) == 1 else "marks")
    if len(token) > 24:
        return FORMS.index("long")
    if token.isdigit():
        return FORMS.index("number")
    if len(token) > 1 and token.isupper():
        return FORMS.index("upper")
    if token.islower():
        return FORMS.index("plain")
    return FORMS.index("title" if token.istitle() else "mixed")


class Tokens:
    """Buckets and forms of the tokens of texts, each distinct token hashed once."""

    REMEMBERED = 300_000

    def __init__(self):
        self.seen: dict[str, int] = {}

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All tokens' buckets and forms, and where each text begins (one more at the end)."""
        if len(self.seen) > self.REMEMBERED:
            self.seen.clear()
        split = [_TOKEN.findall(x or "") for x in texts]
        flat = [t for s in split for t in s]
        for t in set(flat).difference(self.seen):
            self.seen[t] = zlib.crc32(t.lower().encode("utf-8", "surrogatepass")) % BUCKETS * len(FORMS) + form(t)
        code = np.fromiter(map(self.seen.__getitem__, flat), np.int64, len(flat))
        starts = np.concatenate([[0], np.cumsum([len(s) for s in split])]).astype(np.int64)
        buckets, forms = np.divmod(code, len(FORMS))
        if len(flat) > 1:
            same = np.concatenate([[False], buckets[1:] == buckets[:-1]])
            same[starts[:-1][starts[:-1] < len(flat)]] = False
            forms = np.where(same & (forms != FORMS.index("marks")) & (forms != FORMS.index("mark")), FORMS.index("repeat"), forms)
        return buckets, forms, starts


def pooled(tokens: Tokens, texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    """One row a text: mean word vector, form shares through their index vectors, length."""
    buckets, forms, starts = tokens(texts)
    n = np.diff(starts)
    out = np.zeros((len(texts), WIDTH), dtype=np.float32)
    for k in np.flatnonzero(n > 50_000):  # long texts by pieces, so that no step holds many rows
        out[k, :DIMS] = sum(vectors[buckets[a : min(a + 50_000, starts[k + 1])]].sum(axis=0) for a in range(starts[k], starts[k + 1], 50_000))
    usual = np.flatnonzero((n > 0) & (n <= 50_000))
    at = 0
    while at < len(usual):
        to = at + 1
        while to < len(usual) and starts[usual[to] + 1] - starts[usual[at]] < 100_000:
            to += 1
        ks = usual[at:to]
        rows = np.concatenate([np.arange(starts[k], starts[k + 1]) for k in ks])
        first = np.concatenate([[0], np.cumsum(n[ks])[:-1]])
        out[ks, :DIMS] = np.add.reduceat(vectors[buckets[rows]], first, axis=0)
        at = to
    shares = np.bincount(np.repeat(np.arange(len(texts)), n) * len(FORMS) + forms, minlength=len(texts) * len(FORMS)).reshape(len(texts), -1)
    div = np.maximum(n, 1)[:, None]
    out[:, :DIMS] /= div
    out[:, DIMS : 2 * DIMS] = (shares / div) @ FORM_INDEX
    out[:, -2] = np.log1p(n) / 5
    out[:, -1] = n == 0
    return out


def training_rows(docs: DataFrame, labels: DataFrame, target: str) -> DataFrame:
    """``(doc_id, text, y)``: a bounded sample of labelled rows outside fold 0."""
    y = F.col(target).cast("double")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), y.alias("y")).filter("doc_id is not null and y is not null")
    known = known.filter(fold(F.col("doc_id"), FOLDS) != 0).groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("top")).filter("y = top")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).select("doc_id", "y")
    return documents(docs).join(F.broadcast(known), "doc_id")  # at most SAMPLE pairs of numbers


def word_vectors(rows: DataFrame) -> np.ndarray:
    """Word vectors by bucket from the neighbours in all texts; at most ``BUCKETS`` rows leave a task and reach the driver."""

    def count(batches):
        quiet_threads()
        tokens, seen = Tokens(), np.zeros(BUCKETS * DIMS)
        for batch in batches:
            for _, texts in steps(batch):
                buckets, _, starts = tokens(texts)
                text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
                pairs = []
                for gap in range(1, REACH + 1):
                    ok = text[gap:] == text[:-gap]
                    left, right = buckets[:-gap][ok], buckets[gap:][ok]
                    pairs += [(left, right), (right, left)]
                own, other = (np.concatenate(x) for x in zip(*pairs))
                for k in range(0, len(own), PAIRS):  # by the few places where an index vector is not 0
                    who, whom = own[k : k + PAIRS], other[k : k + PAIRS]
                    seen += np.bincount((who[:, None] * DIMS + PLACES[whom]).ravel(), WEIGHTS[whom].ravel(), BUCKETS * DIMS)
        seen = seen.reshape(BUCKETS, DIMS)
        rows_ = np.flatnonzero(np.abs(seen).sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(rows_.astype(np.int32)), pa.array([seen[k].astype(np.float32).tobytes() for k in rows_], pa.binary())], ["bucket", "vec"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column("bucket").to_pylist(), b.column("vec").to_pylist()):
                total[k] = total.get(k, 0) + np.frombuffer(v, np.float32).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.astype(np.float32).tobytes() for v in total.values()], pa.binary())], ["bucket", "vec"])

    schema = "bucket int, vec binary"
    out = np.zeros((BUCKETS, DIMS), dtype=np.float32)
    for r in rows.select("text").mapInArrow(count, schema).repartition("bucket").mapInArrow(add, schema).collect():
        out[r.bucket] = np.frombuffer(r.vec, np.float32)
    out = np.round(out, 3)
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    return INDEX / 2 + out


class Network:
    """Two layers and a calibration; constant if there is nothing to learn."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7):
        self.constant = None
        if not len(y) or y.min() == y.max():
            self.constant = float(np.mean(y)) if len(y) else 0.5
            return
        self.mean, self.std = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = ((x - self.mean) / self.std).astype(np.float64)
        rng = np.random.default_rng(seed)
        kept = np.arange(len(y)) % 5 == 4  # of the training rows, for the calibration
        if y[kept].min() == y[kept].max() or y[~kept].min() == y[~kept].max():
            kept[:] = False
        p = [rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        tx, ty = x[~kept], y[~kept]
        for _ in range(40):
            order = rng.permutation(len(ty))
            for at in range(0, len(order), 128):
                b = order[at : at + 128]
                h = np.tanh(tx[b] @ p[0] + p[1])
                d = (1 / (1 + np.exp(-(h @ p[2] + p[3][0]))) - ty[b]) / len(b)
                dh = np.outer(d, p[2]) * (1 - h * h)
                g = [tx[b].T @ dh + 1e-4 * p[0], dh.sum(axis=0), h.T @ d + 1e-4 * p[2], np.array([d.sum()])]
                t += 1
                for k in range(4):
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    p[k] -= 0.004 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.p, self.scale = p, 1.0
        if kept.any():
            z = self.logits(x[kept])
            loss = lambda s: np.logaddexp(0, -np.where(y[kept] > 0, 1, -1) * z * s).mean()
            self.scale = min((float(s) for s in np.geomspace(0.1, 3, 60)), key=loss)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3][0]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = np.clip(self.logits((x - self.mean) / self.std) * self.scale, -30, 30)
        return 1 / (1 + np.exp(-z))


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality") -> tuple[np.ndarray, Network]:
    """Word vectors from all documents, and the network from the training rows."""
    vectors = word_vectors(documents(docs))
    rows = training_rows(docs, labels, target)
    shared = rows.sparkSession.sparkContext.broadcast(vectors)

    def featurise(batches):
        quiet_threads()
        tokens = Tokens()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                x = pooled(tokens, part.column("text").to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "y", "x"])

    got = sorted((r.doc_id, r.x, r.y) for r in rows.mapInArrow(featurise, "doc_id long, y double, x binary").collect())
    x = np.array([np.frombuffer(r[1], np.float32) for r in got], dtype=np.float64).reshape(len(got), WIDTH)
    return vectors, Network(x, np.array([r[2] for r in got]))


def scorer(spark, vectors: np.ndarray, network: Network):
    """A function of texts that gives their scores, for use in ``map_steps``."""
    shared = spark.sparkContext.broadcast((vectors, network))

    def make():
        quiet_threads()
        tokens = Tokens()
        return lambda texts: network_scores(tokens, texts, *shared.value)

    return make


def network_scores(tokens: Tokens, texts: list, vectors: np.ndarray, network: Network) -> np.ndarray:
    return np.round(network(pooled(tokens, texts, vectors).astype(np.float64)), 6)


def score(docs: DataFrame, labels: DataFrame, target: str = "quality", threshold: float = 0.3) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row."""
    make_scores = scorer(docs.sparkSession, *fit(docs, labels, target))

    def make():
        scores = make_scores()
        return lambda rows, texts: pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(scores(texts), pa.float64())], ["doc_id", "score"])

    out = map_steps(documents(docs), "doc_id long, score double", make)
    return out.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, target: str = "quality", threshold: float = 0.3) -> DataFrame:
    """The rows whose score reaches the threshold, with all their columns."""
    make_scores = scorer(docs.sparkSession, *fit(docs, labels, target))

    def make():
        scores = make_scores()
        return lambda rows, texts: rows.filter(pa.array(scores(texts) >= threshold))

    return map_steps(docs, docs.schema, make)
