"""Language by a bidirectional gated recurrent network over bytes.

Forward and backward gated units read every byte of a text; a softmax over both states labels each
position, and a document's probabilities are the mean over its positions. Texts are cut into
segments of ``SEGMENT`` bytes that run through numpy side by side, each led in by ``LEAD`` bytes of
context that carry no label. Training is backpropagation through time in numpy, on at most
``SAMPLE`` rows a language (least ``xxhash64``), a few segments of each; only rows outside the
held-out fold and with a language are used.

Cases: a null text, or one without any letter, is ``und`` with score 0; without labelled rows all
are ``und``; of languages with equal probability the first by name is given; a null ``doc_id`` is labelled
and is of fold 0; repeated rows are labelled once each; an empty table gives no rows; a very long text
is read whole, by its segments; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfront.llm.common import documents, fold, map_steps, quiet_threads

#: Rows that training takes of one language at most, and segments of one row.
SAMPLE, SEGMENTS = 600, 3
#: Folds of ``doc_id`` and the one that is held out.
FOLDS, HELD = 4, 2
SEGMENT, LEAD, HIDDEN = 96, 8, 8
#: Segments that run side by side.
WIDE = 4096
PAD = 256


class Network:
    """Weights of both directions: byte table (3H a byte), recurrent matrix, softmax."""

    def __init__(self, langs: list[str], seed: int = 3):
        rng = np.random.default_rng(seed)
        h, k = HIDDEN, len(langs)
        self.langs = langs
        self.p = {}
        for d in "fb":
            self.p[f"{d}x"] = rng.normal(0, 0.5, (3 * h, 257)).astype(np.float32)
            self.p[f"{d}u"] = rng.normal(0, 1 / np.sqrt(h), (3 * h, h)).astype(np.float32)
        self.p["o"] = rng.normal(0, 0.3, (k, 2 * h)).astype(np.float32)
        self.p["c"] = np.zeros((k, 1), dtype=np.float32)

    def states(self, x: np.ndarray, d: str, keep: dict | None = None) -> np.ndarray:
        """Hidden states (T, H, B) of byte columns ``x`` (T, B) in one direction.

        Update and reset gates are logistic (as tanh), the candidate tanh; a padding byte leaves the
        state as it was.
        """
        table, u = self.p[f"{d}x"], self.p[f"{d}u"]
        h = HIDDEN
        half = np.concatenate([np.full((2 * h, 1), 0.5, np.float32), np.ones((h, 1), np.float32)])
        rows = np.ascontiguousarray((table * half).T)  # logistic(a) = (1 + tanh(a / 2)) / 2
        uz, uh = u[: 2 * h] * np.float32(0.5), u[2 * h :]
        out = np.empty((len(x), h, x.shape[1]), dtype=np.float32)
        s = np.zeros((h, x.shape[1]), dtype=np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            a = rows[x[t]].T
            g = uz @ s
            g += a[: 2 * h]
            np.tanh(g, out=g)
            g += 1
            g *= 0.5
            z, r = g[:h], g[h:]
            c = uh @ (r * s)
            c += a[2 * h :]
            np.tanh(c, out=c)
            z *= x[t] != PAD
            if keep is not None:
                keep[t] = (s, z, r, c)
            n = c - s
            n *= z
            n += s
            s = n
            out[t] = s
        return out

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (T, K, B) at every position."""
        f, b = self.states(x, "f"), self.states(x, "b")
        o = self.p["o"]
        z = np.matmul(o[:, :HIDDEN], f)
        z += np.matmul(o[:, HIDDEN:], b)
        z += self.p["c"]
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=1, keepdims=True)
        return z

    def gradient(self, x: np.ndarray, y: np.ndarray) -> dict:
        """Of the mean cross-entropy over the positions, by backpropagation through time."""
        h, (steps, width) = HIDDEN, x.shape
        kept = {"f": {}, "b": {}}
        s = {d: self.states(x, d, kept[d]) for d in "fb"}
        both = np.concatenate([s["f"], s["b"]], axis=1)
        z = np.matmul(self.p["o"], both) + self.p["c"]
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        live = (x != PAD)[:, None, :]
        p[:, y, np.arange(width)] -= 1
        p *= live / np.float32(max(1, live.sum()))
        g = {"o": np.einsum("tkb,thb->kh", p, both), "c": p.sum(axis=(0, 2))[:, None]}
        up = np.matmul(self.p["o"].T, p)
        for d, part in (("f", up[:, :h]), ("b", up[:, h:])):
            u = self.p[f"{d}u"]
            gu, gx = np.zeros_like(u), np.zeros_like(self.p[f"{d}x"])
            ds = np.zeros((h, width), dtype=np.float32)
            for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
                old, z_, r, c = kept[d][t]
                ds = ds + part[t]
                dc = ds * z_ * (1 - c * c)
                dz = ds * (c - old) * z_ * (1 - z_)
                back = u[2 * h :].T @ dc
                dr = back * old * r * (1 - r)
                ds = ds * (1 - z_) + back * r
                dg = np.concatenate([dz, dr])
                ds += u[: 2 * h].T @ dg
                gu[: 2 * h] += dg @ old.T
                gu[2 * h :] += dc @ (r * old).T
                da = np.concatenate([dg, dc])
                one = np.zeros((width, 257), dtype=np.float32)
                one[np.arange(width), x[t]] = 1
                gx += da @ one
            g[f"{d}u"], g[f"{d}x"] = gu, gx
        return g

    def train(self, x: np.ndarray, y: np.ndarray, rounds: int = 220, width: int = 192, seed: int = 4) -> None:
        """Adam over random batches; ``x`` is (segments, T)."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(a) for k, a in self.p.items()}
        for t in range(1, rounds + 1):
            b = rng.integers(0, len(y), width)
            g = self.gradient(np.ascontiguousarray(x[b].T), y[b])
            norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            rate = 0.02 * min(1.0, 2 * (1 - t / (rounds + 1)))
            for k, a in g.items():
                a = a * min(1.0, 1.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.99 * v[k] + 0.01 * a * a
                self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)

    def pool(self, texts: list[str | None]) -> np.ndarray:
        """Mean probabilities over all bytes of each text."""
        raw = [(x or "").encode("utf-8", "surrogatepass") for x in texts]
        n = np.array([len(x) for x in raw], dtype=np.int64)
        parts = -(-n // SEGMENT)
        flat = np.concatenate([np.full(LEAD, PAD, np.int16), *(np.concatenate([np.frombuffer(x, np.uint8).astype(np.int16), np.full(LEAD, PAD, np.int16)]) for x in raw), np.full(SEGMENT, PAD, np.int16)])
        base = LEAD + np.cumsum(n + LEAD) - n - LEAD
        owner = np.repeat(np.arange(len(raw)), parts)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        first = base[owner] + k * SEGMENT
        size = np.minimum(SEGMENT, n[owner] - k * SEGMENT)
        total = np.zeros((len(raw), len(self.langs)))
        for at in range(0, len(owner), WIDE):
            f, o, w = first[at : at + WIDE], owner[at : at + WIDE], size[at : at + WIDE]
            t = np.arange(-LEAD, SEGMENT + LEAD)[:, None]
            x = flat[np.clip(f + t, 0, len(flat) - 1)]
            x[t >= w + LEAD] = PAD
            p = self.positions(x)[LEAD : LEAD + SEGMENT]
            p *= (np.arange(SEGMENT)[:, None] < w)[:, None, :]
            np.add.at(total, o, p.sum(axis=0).T.astype(np.float64))
        return total / np.maximum(n, 1)[:, None]


def training_segments(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, segments (rows of bytes) and their labels, from a bounded sample of labelled rows."""
    rows = documents(docs, F.col("lang").cast("string").alias("lang")).filter("text is not null and text <> '' and lang is not null and doc_id is not null")
    rows = rows.filter(fold(F.col("doc_id"), FOLDS) != HELD)
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return [], np.zeros((0, SEGMENT), np.int16), np.zeros(0, int)
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, 1.5 * SAMPLE / n))])
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    picked = rows.filter(chance < share[F.col("lang")])
    # pieces from the start, the middle and the end of each row; rows of one id and language count once
    last = F.greatest(F.lit(0), F.length("text") - SEGMENT)
    at = [F.floor(last * k / max(1, SEGMENTS - 1)).cast("int") + 1 for k in range(SEGMENTS)]
    pieces = picked.select(F.xxhash64("doc_id").alias("h"), "doc_id", "lang", F.struct(*(F.substring("text", a, F.lit(SEGMENT)).alias(f"s{k}") for k, a in enumerate(at))).alias("s"))
    got = pieces.groupBy("h", "doc_id", "lang").agg(F.min("s").alias("s")).collect()
    got = [(r.doc_id, r.lang, *r.s) for r in sorted(got, key=lambda r: (r.h, r.doc_id, r.lang))]
    langs = sorted(counts)
    held: dict[str, int] = {}
    x, y = [], []
    for _, lang, *pieces in got:
        if held.setdefault(lang, 0) < SAMPLE:
            held[lang] += 1
            for piece in pieces:
                raw = np.frombuffer(piece.encode("utf-8", "surrogatepass")[:SEGMENT], np.uint8).astype(np.int16)
                x.append(np.concatenate([raw, np.full(SEGMENT - len(raw), PAD, np.int16)]))
                y.append(langs.index(lang))
    x, y = np.array(x), np.array(y)
    # as many segments of each language, the rarer ones repeated
    most = max(np.bincount(y))
    order = np.concatenate([np.resize(np.flatnonzero(y == k), most) for k in range(len(langs)) if (y == k).any()])
    return langs, x[order], y[order]


def fit(docs: DataFrame) -> Network | None:
    langs, x, y = training_segments(docs)
    if not langs:
        return None
    net = Network(langs)
    net.train(x, y)
    return net


def predict(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def make():
        quiet_threads()
        net = shared.value

        def f(rows, texts):
            letters = [bool(x) and any(map(str.isalpha, x)) for x in texts]
            p = net.pool(texts) if net else np.zeros((len(texts), 1))
            best = p.argmax(axis=1)
            ok = [a and net is not None for a in letters]
            lang = [net.langs[k] if a else "und" for k, a in zip(best, ok)]
            value = [float(min(1.0, round(p[i, k], 6))) if a else 0.0 for i, (k, a) in enumerate(zip(best, ok))]
            return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(lang, pa.string()), pa.array(value, pa.float64())], ["doc_id", "lang_pred", "score"])

        return f

    out = map_steps(documents(docs), "doc_id long, lang_pred string, score double", make)
    return out.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "lang_pred", "score")
