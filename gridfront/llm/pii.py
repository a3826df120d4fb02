"""Personal data: pattern spans and the spans of a linear-chain conditional random field.

Patterns give the base spans, leftmost and not overlapping within a kind. The field labels words by
their shapes, neighbours and trigger words; it is trained by gradient ascent on a small labelled
table built from templates, and decoded by Viterbi in numpy batches of equal width. Its sequences are
the words that hold a digit or an ``@``, or a spelt-out ``at``/``dot`` between brackets (in any case, with
a space inside them or not), with ``CONTEXT`` words on each side: any other word carries the outside
label, for no kind can lie there. A span of the field must be a plausible one of its kind (``plausible``).
The field adds spans where no base span is; base spans stay as they are.

Cases: a null text counts as empty and has no spans; a null ``doc_id`` is carried; repeated rows give
repeated results; an empty table gives no rows; a text is taken whole whatever its length; ``find``
ignores columns other than ``doc_id`` and ``text``, and ``mask`` carries them with their types.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridfront.llm.common import documents, map_steps, quiet_threads

KINDS = ("email", "ip", "card", "phone")
#: Words of context on each side of a word that may belong to a span.
CONTEXT = 3
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]")
_WORD = re.compile(r"\S+")
_TRIGGER = re.compile(r"[0-9@]|[\[({]\s?(?:at|dot)\s?[\])}]", re.I)
_AT, _DOT = (re.compile(rf"{a}|[\[({{]\s?{b}\s?[\])}}]", re.I) for a, b in (("@", "at"), (r"\.", "dot")))


def luhn(digits: str) -> bool:
    """Whether the digits pass the check sum of card numbers."""
    d = [int(c) for c in reversed(digits)]
    return (sum(d[0::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each ``@`` so that long runs without one cost nothing."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        first = at
        while first > free and _LOCAL.match(text, first - 1):
            first -= 1
        if first < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((first, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four patterns that pass their tests, by kind, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        if 13 <= len(m[0]) <= 37 and 13 <= len(d := _NOT_DIGITS.sub("", m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGITS.sub("", m[0])) <= 15]
    return out


# --- the field -------------------------------------------------------------------------------

LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))


def shape(word: str) -> str:
    """Letters, digits and marks in short: ``+1`` is ``+9``, ``ab.12@x.org`` is ``a.9@a.a``."""
    s = re.sub(r"[0-9]+", lambda m: "9" if len(m[0]) < 3 else "99" if len(m[0]) < 5 else "999" if len(m[0]) < 12 else "9999", word)
    return re.sub(r"[^\W\d_]+", "a", s)


def word_features(word: str) -> tuple[str, ...]:
    """Features of a word; those of usual length are remembered."""
    return remembered_features(word) if len(word) <= 64 else own_features(word)


def own_features(word: str) -> tuple[str, ...]:
    bare = word.strip(".,;:!?\"'()[]{}<>")
    digits = sum(c.isdigit() for c in bare)
    f = [f"s={shape(bare)}", f"d={min(digits, 4) if digits < 13 else 13}"]
    if "@" in bare:
        f.append("at")
    if bare.count(".") == 3 and digits and not re.search(r"[^0-9.]", bare):
        f.append("quad")
    if not digits and "@" not in bare:
        f.append(f"w={bare.lower()}" if bare.lower() in CUES or re.fullmatch(r"(at|dot)", bare, re.I) else "plain")
        if word[:1] in "[({" and re.fullmatch(r"(at|dot)", bare, re.I):
            f.append("spelt")
    if word[-1:] in ".,;:!?":
        f.append("stop")
    return tuple(f)


remembered_features = lru_cache(50_000)(own_features)

#: Words that announce personal data in the labelled table.
CUES = frozenset("call phone tel telephone mobile fax mail email e-mail contact write card visa mastercard credit account ip host server address from".split())


def features(words: list[str]) -> list[list[str]]:
    own = [word_features(w) for w in words]
    out = []
    for i, f in enumerate(own):
        out.append([*f, *(f"-1{x}" for x in (own[i - 1] if i else ("edge",))), *(f"+1{x}" for x in (own[i + 1] if i + 1 < len(own) else ("edge",)))])
    return out


def labelled_table(rows: int = 240, seed: int = 5) -> list[list[tuple[str, str]]]:
    """Sentences of (word, label), drawn from templates: the field's whole training set."""
    r = random.Random(seed)
    pick = lambda k, a="abcdefghijklmnopqrstuvwxyz": "".join(r.choice(a) for _ in range(k))
    num = lambda k: pick(k, "0123456789")
    plain = lambda: r.choice([pick(r.randint(1, 9)), pick(r.randint(2, 8)).capitalize(), pick(r.randint(3, 8)) + ",", pick(4) + "."])

    def entity(kind: str) -> list[str]:
        if kind == "email":
            host = f"{pick(r.randint(3, 8))}.{r.choice(['com', 'org', 'net', 'de'])}"
            name = r.choice([pick(5), f"{pick(4)}.{num(2)}", f"{pick(3)}_{pick(4)}"])
            return r.choice([[f"{name}@{host}"], [f"{name}@{pick(4)}{num(1)}.{host}"], [name, "[at]", host.split(".")[0], "[dot]", host.split(".")[1]], [name, "(at)", host]])
        if kind == "ip":
            return [".".join(str(r.randint(0, 255)) for _ in range(4)) + r.choice(["", "", ":8080"])]
        if kind == "card":
            return r.choice([[num(4) for _ in range(4)], [num(16)], ["-".join(num(4) for _ in range(4))]])
        return r.choice([[f"+{num(1)}", f"({num(3)})", f"{num(3)}-{num(4)}"], [f"({num(3)})", f"{num(3)}-{num(4)}"], [f"{num(3)}-{num(3)}-{num(4)}"], [f"+{num(2)}", num(3), num(4), num(3)]])

    noise = [lambda: [num(r.randint(1, 4))], lambda: [num(r.randint(1, 2)) + "."], lambda: [f"{pick(3)}={pick(2)}{num(2)}{pick(2)}{num(1)}"], lambda: [f"{num(1)}.{num(2)}"], lambda: [f"{pick(3).upper()}{num(2)}{pick(3).upper()}{num(1)}"], lambda: [f"{num(4)}-{num(2)}-{num(2)}"], lambda: [f"${num(2)}.{num(2)}"], lambda: ["@" + pick(5)], lambda: [num(r.randint(6, 12)) + pick(2)], lambda: [f'"{num(3)}{pick(3)}{num(4)}{pick(2)}"']]
    table = []
    for k in range(rows):
        row = [(plain(), "O") for _ in range(r.randint(1, 4))]
        if r.random() < 0.3:
            row.append((r.choice(sorted(CUES)), "O"))
        if k % 2:
            kind = KINDS[k // 2 % len(KINDS)]
            words = entity(kind)
            if r.random() < 0.2:
                words[-1] += r.choice(".,")
            row += [(w, f"{'BI'[i > 0]}-{kind}") for i, w in enumerate(words)]
        else:
            row += [(w, "O") for w in r.choice(noise)()]
        table.append(row + [(plain(), "O") for _ in range(r.randint(1, 4))])
    return table


class Field:
    """Emission weights by feature, transition weights, and their training."""

    def __init__(self, table: list[list[tuple[str, str]]]):
        rows = [([w for w, _ in row], [LABELS.index(x) for _, x in row]) for row in table]
        names = sorted({f for words, _ in rows for fs in features(words) for f in fs})
        self.index = {f: k for k, f in enumerate(names)}
        self.emit = np.zeros((len(names) + 1, len(LABELS)))
        self.move = np.zeros((len(LABELS), len(LABELS)))
        # an inside label follows its own kind only
        self.bar = np.array([[-1e4 if b[0] == "I" and a[1:] != b[1:] else 0.0 for b in LABELS] for a in LABELS])
        self.open = np.array([-1e4 if b[0] == "I" else 0.0 for b in LABELS])
        self.fit(rows)

    def ids(self, words: list[str]) -> list[list[int]]:
        return [[self.index.get(f, len(self.index)) for f in fs] for fs in features(words)]

    def scores(self, words: list[str]) -> np.ndarray:
        return np.array([self.emit[k].sum(axis=0) for k in self.ids(words)])

    def fit(self, rows: list, rounds: int = 60, penalty: float = 0.02) -> None:
        """Gradient ascent on the penalised log-likelihood, with forward and backward sums."""
        ids = [self.ids(words) for words, _ in rows]
        emit_2, move_2 = np.full_like(self.emit, 1e-8), np.full_like(self.move, 1e-8)
        lse = lambda x, axis: (m := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis=axis))
        for _ in range(rounds):
            g_emit, g_move = -penalty * self.emit, -penalty * self.move
            trans = self.move + self.bar
            for (_, gold), feats in zip(rows, ids):
                e = np.array([self.emit[k].sum(axis=0) for k in feats])
                n = len(e)
                fwd, bwd = np.zeros_like(e), np.zeros_like(e)
                fwd[0] = e[0] + self.open
                for t in range(1, n):
                    fwd[t] = lse(fwd[t - 1][:, None] + trans, 0) + e[t]
                for t in range(n - 2, -1, -1):
                    bwd[t] = lse(trans + (e[t + 1] + bwd[t + 1])[None, :], 1)
                z = lse(fwd[-1], 0)
                want = -np.exp(fwd + bwd - z)
                want[np.arange(n), gold] += 1
                for t, k in enumerate(feats):
                    g_emit[k] += want[t]
                for t in range(1, n):
                    g_move -= np.exp(fwd[t - 1][:, None] + trans + (e[t] + bwd[t])[None, :] - z)
                    g_move[gold[t - 1], gold[t]] += 1
            g_emit[-1] = 0
            emit_2 += g_emit**2
            move_2 += g_move**2
            self.emit += 0.5 * g_emit / np.sqrt(emit_2)
            self.move += 0.5 * g_move / np.sqrt(move_2)

    def viterbi(self, sequences: list[list[str]]) -> list[list[str]]:
        """Best label paths; sequences of like length go through numpy together."""
        out: list[list[str]] = [[] for _ in sequences]
        order = sorted(range(len(sequences)), key=lambda k: len(sequences[k]))
        trans = self.move + self.bar
        for at in range(0, len(order), 512):
            group = order[at : at + 512]
            n = np.array([len(sequences[k]) for k in group])
            if not n.max():
                continue
            e = np.zeros((n.max(), len(group), len(LABELS)))
            for j, k in enumerate(group):
                if sequences[k]:
                    e[: n[j], j] = self.scores(sequences[k])
            back = np.zeros(e.shape, dtype=np.int8)
            v = e[0] + self.open
            for t in range(1, len(e)):
                step = v[:, :, None] + trans[None]
                back[t] = step.argmax(axis=1)
                live = (t < n)[:, None]
                v = np.where(live, step.max(axis=1) + e[t], v)
            best = v.argmax(axis=1)
            for j, k in enumerate(group):
                y, path = best[j], []
                for t in range(n[j] - 1, -1, -1):
                    path.append(LABELS[y])
                    y = back[t, j, y]
                out[k] = path[::-1]
        return out


@lru_cache(1)
def trained() -> Field:
    """The field of the labelled table; deterministic, trained once in each process that asks."""
    return Field(labelled_table())


def sequences(text: str) -> list[list[tuple[str, int, int]]]:
    """Runs of words around those that may belong to a span: (word, start, end)."""
    out: list[list] = []
    done = 0
    while found := _TRIGGER.search(text, done):
        first = t = found.start()
        for _ in range(CONTEXT + 1):  # back over the word that holds the trigger, then its context
            while first > done and not text[first - 1].isspace():
                first -= 1
            edge = first
            while edge > done and text[edge - 1].isspace():
                edge -= 1
            if edge == done:
                break
            first = edge
        while first < t and text[first].isspace():
            first += 1
        words, after = [], 0
        for m in _WORD.finditer(text, first):
            words.append((m[0], m.start(), m.end()))
            if m.end() <= t:
                continue
            after = 0 if _TRIGGER.search(m[0]) else after + 1
            if after > CONTEXT:
                break
        done = words[-1][2]
        out.append(words)
    return out


def plausible(kind: str, text: str) -> bool:
    """What a span of the field must hold besides its labels."""
    d = len(_NOT_DIGITS.sub("", text))
    if kind == "email":
        return bool(_AT.search(text)) and bool(_DOT.search(text))
    return {"ip": bool(re.fullmatch(r"(\d{1,3}\.){3}\d{1,3}(:\d+)?", text)), "card": 13 <= d <= 19, "phone": 7 <= d <= 15}[kind]


def field_spans(texts: list[str], base: list[list[tuple[str, int, int]]], field: Field) -> list[list[tuple[str, int, int]]]:
    """Spans that the field adds, clear of the base spans."""
    runs = [(k, run) for k, text in enumerate(texts) for run in sequences(text)]
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for (k, run), path in zip(runs, field.viterbi([[w for w, _, _ in run] for _, run in runs])):
        i = 0
        while i < len(path):
            if path[i][0] != "B":
                i += 1
                continue
            j = i + 1
            while j < len(path) and path[j] == f"I-{path[i][2:]}":
                j += 1
            kind, a, b = path[i][2:], run[i][1], run[j - 1][2]
            while b > a and texts[k][b - 1] in ".,;:!?\"')]}>" and not texts[k][a:b].endswith("[dot]"):
                b -= 1
            while a < b and texts[k][a] in "\"'<[{":
                a += 1
            if plausible(kind, texts[k][a:b]) and not any(a < y and x < b for _, x, y in [*base[k], *out[k]]):
                out[k].append((kind, a, b))
            i = j
    return out


def spans(texts: list[str | None], field: Field | None = None) -> list[tuple[list, list]]:
    """Base spans, and all spans, of each text; by kind as in ``KINDS``, then start."""
    whole = [x or "" for x in texts]
    base = [base_spans(x) for x in whole]
    added = field_spans(whole, base, field or trained())
    by = {k: i for i, k in enumerate(KINDS)}
    return [(b, sorted(b + a, key=lambda s: (by[s[0]], s[1], s[2]))) for b, a in zip(base, added)]


def written(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def find(docs: DataFrame) -> DataFrame:
    """Counts and spans of personal data by document; offsets are code points, ends exclusive."""
    field = trained()
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def make():
        quiet_threads()

        def f(rows, texts):
            found = spans(texts, field)
            n = [pa.array([sum(s[0] == k for s in b) for b, _ in found], pa.int64()) for k in KINDS]
            sha = pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b, _ in found], pa.string())
            return pa.RecordBatch.from_arrays([rows.column("doc_id"), *n, sha, pa.array([written(a) for _, a in found], pa.string())], names)

        return f

    return map_steps(documents(docs), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", make)


def masked(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with its spans replaced by their kinds; where spans overlap, by the first one's."""
    out, at = [], 0
    for kind, a, b in sorted(found, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def mask(docs: DataFrame) -> DataFrame:
    """The documents with personal data masked in ``text``; other columns stay, ``n_chars`` follows the text."""
    field = trained()
    schema = docs.schema

    def make():
        quiet_threads()

        def f(rows, texts):
            new = [x if x is None else masked(x, s) for x, (_, s) in zip(texts, spans(texts, field))]
            columns = {c: rows.column(c) for c in rows.schema.names} | {"text": pa.array(new, pa.string())}
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if x is None else len(x) for x in new], pa.int64()).cast(columns["n_chars"].type)
            return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

        return f

    return map_steps(docs, schema, make)
