"""Byte-level BPE by DuckDB recursive queries, one database in each Python worker.

A text is split by the pre-tokenizer's pattern. Distinct words become token-position rows (one row a
byte); the recursive query joins neighbours to the merge table and contracts each word's leftmost
pair of least rank until no pair is left. Decoding joins ids to the vocabulary and aggregates the
bytes in order.

The query keeps every state, so a word of n bytes makes about n * n / 2 rows. One query takes words
of at most ``STATES`` rows together, and a word is given to it by pieces of at most ``PIECE`` bytes,
so rows grow with the text's length only. Neighbouring pieces share ``OVERLAP`` bytes and are joined at
a token that both have at one place. That is exact: contraction inside a run of final tokens never
looks beyond it, so if ``u`` and ``t`` contract to ids that end with the token ``t``, and ``t`` and ``v``
to ids that begin with it, then no contraction of ``u t v`` crosses an end of ``t``. Where two pieces share
no token (as in periodic words out of step), a new piece begins at a token of the part done so far;
it is as long as it takes for that token to come back as its first.

Cases: a null text counts as empty (no tokens); a null ``doc_id`` is carried; repeated rows give
repeated results; an empty table gives no rows; special tokens are ordinary text; texts of any
length and words of any length (scripts without spaces, all-distinct words) are taken whole, in
blocks of ``BLOCK`` words; columns other than ``doc_id`` and ``text`` are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridfront.llm.common import documents, map_steps

#: Bytes of a piece, and those that it shares with the next one (a token has at most 33).
PIECE, OVERLAP = 96, 32
#: Rows of all states of one query, and pieces of a long word that go to the queries together.
STATES, TOGETHER = 4_000_000, 10_000
#: Distinct words, and characters of them, that a worker remembers before it starts anew.
REMEMBERED, REMEMBERED_CHARS = 500_000, 30_000_000
#: Characters of text whose new words are contracted together, and words of a longer text.
STEP, BLOCK = 6_000_000, 1_000_000
#: Ids that one query decodes.
DECODED = 200_000

#: ``best`` packs a word's least pair: its merged id, the place of its left part, that of its right part.
#: It is null in a word's last state.
CONTRACT = """
WITH RECURSIVE state(w, pos, tok, best) AS (
    SELECT p.w, p.pos, p.tok, min((m.id::BIGINT << 44) | (p.pos::BIGINT << 22) | p.npos) OVER (PARTITION BY p.w)
    FROM (SELECT w, pos, tok, lead(tok) OVER o AS nxt, lead(pos) OVER o AS npos
          FROM seed WINDOW o AS (PARTITION BY w ORDER BY pos)) p
    LEFT JOIN merges m ON m.l = p.tok AND m.r = p.nxt
  UNION ALL
    SELECT p.w, p.pos, p.tok, min((m.id::BIGINT << 44) | (p.pos::BIGINT << 22) | p.npos) OVER (PARTITION BY p.w)
    FROM (SELECT w, pos, tok, lead(tok) OVER o AS nxt, lead(pos) OVER o AS npos
          FROM (SELECT w, pos, CASE WHEN pos = (best >> 22) & 4194303 THEN (best >> 44)::INTEGER ELSE tok END AS tok
                FROM state WHERE best IS NOT NULL AND pos <> best & 4194303)
          WINDOW o AS (PARTITION BY w ORDER BY pos)) p
    LEFT JOIN merges m ON m.l = p.tok AND m.r = p.nxt
)
SELECT w, pos, tok FROM state WHERE best IS NULL
"""

#: Ids of a word as text and the decoded bytes, in order of position.
GATHER = f"""
SELECT w, string_agg(tok::VARCHAR, ',' ORDER BY pos) AS ids, unhex(string_agg(raw, '' ORDER BY pos)) AS raw
FROM ({CONTRACT}) JOIN vocab ON vocab.id = tok GROUP BY w
"""
#: Ids of a word and their places.
PLACES = f"SELECT w, list(pos ORDER BY pos) AS pos, list(tok ORDER BY pos) AS tok FROM ({CONTRACT}) GROUP BY w"


class Vocabulary:
    """The merge table and the contraction queries over it."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = []
        for word, rank in ranks.items():
            for i in range(1, len(word)):
                a, b = ranks.get(word[:i]), ranks.get(word[i:])
                if a is not None and b is not None:
                    pairs.append((a, b, rank))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self.load("merges_in", pa.table(dict(zip(("l", "r", "id"), (np.array(x, dtype=np.int32) for x in zip(*pairs))))))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges_in")
        self.load("vocab_in", pa.table({"id": pa.array(ranks.values(), pa.int32()), "raw": pa.array(ranks.keys(), pa.binary())}))
        self.db.execute("CREATE TABLE vocab AS SELECT id, hex(raw) AS raw FROM vocab_in")
        self.words: dict[str, tuple] = {}
        self.chars = 0

    def load(self, name: str, table: pa.Table) -> None:
        self.db.register(name, table)

    def seed(self, words: list[bytes]) -> pa.Table:
        lens = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        at = np.cumsum(lens) - lens
        return pa.table({"w": np.repeat(np.arange(len(words), dtype=np.int32), lens), "pos": (np.arange(len(raw)) - np.repeat(at, lens)).astype(np.int32), "tok": self.single[raw]})

    def queried(self, query: str, words: list[bytes]) -> Iterator[tuple[list[bytes], list[list]]]:
        """Columns of a query over the states of ``words``, by groups of at most ``STATES`` rows; the first is the place in the group."""
        words = sorted(words, key=len)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        bounds = np.flatnonzero(np.diff(np.cumsum(lens * (lens + 1) // 2) // STATES)) + 1
        for a, b in zip([0, *bounds], [*bounds, len(words)]):
            self.load("seed", self.seed(words[a:b]))
            yield words[a:b], [c.to_pylist() for c in self.db.sql(query).to_arrow_table().columns]

    def contract(self, words: list[bytes]) -> dict[bytes, tuple[str, bytes]]:
        """For each distinct word, which is not empty, its ids as text and their decoded bytes."""
        out: dict[bytes, tuple[str, bytes]] = {}
        if whole := [x for x in words if len(x) <= PIECE]:
            for group, (place, ids, raw) in self.queried(GATHER, whole):
                out.update(zip(map(group.__getitem__, place), zip(ids, raw)))
        for x in words:
            if len(x) > PIECE:
                ids = self.joined(x)
                out[x] = (",".join(map(str, ids)), self.decode([ids])[0])
        return out

    def joined(self, word: bytes) -> array:
        """Ids of a long word from its pieces."""
        stride, known = PIECE - OVERLAP, {}

        def tokens(a: int, size: int, more: int = 1) -> tuple[list[int], list[int]]:
            """Places and ids of ``word[a : a + size]``; the pieces that follow are contracted together with it."""
            if (key := word[a : a + size]) not in known:
                if len(known) > 2 * TOGETHER:
                    known.clear()
                ask = list({word[s : s + size] for s in range(a, min(a + more * stride, len(word)), stride)}.difference(known))
                for group, (place, pos, tok) in self.queried(PLACES, ask):
                    known.update(zip(map(group.__getitem__, place), zip(pos, tok)))
            return known[key]

        at, ids = array("q"), array("i")  # the part done, which ends at byte ``end``
        for done, x in zip((at, ids), tokens(0, PIECE, TOGETHER)):
            done.extend(x)
        end = PIECE
        while end < len(word):
            a, size, back = (end - OVERLAP) // stride * stride, PIECE, OVERLAP
            pos, tok = tokens(a, size, TOGETHER)
            there = {(a + p, t): j for j, (p, t) in enumerate(zip(pos, tok))}
            low = bisect_left(at, a)
            k, j = next(((k, there[x]) for k in range(len(at) - 1, low - 1, -1) if (x := (at[k], ids[k])) in there), (None, 0))
            while k is None:
                k = max(0, bisect_right(at, end - back) - 1)
                a, size = at[k], 3 * back
                pos, tok = tokens(a, size)
                if a and tok[0] != ids[k]:
                    k = None
                back *= 2
            del at[k:], ids[k:]
            at.extend([a + p for p in pos[j:]])
            ids.extend(tok[j:])
            end = min(a + size, len(word))
        return ids

    def decode(self, many: list) -> list[bytes]:
        """Bytes of each list of ids, at most ``DECODED`` of them in one query; an id outside the vocabulary is an error."""
        out = [b""] * len(many)
        parts, held = [], 0
        for k, ids in enumerate(many):
            for a in range(0, len(ids), DECODED):
                parts.append((k, ids[a : a + DECODED]))
                held += len(parts[-1][1])
                if held >= DECODED:
                    self.spell(parts, out)
                    parts, held = [], 0
        if parts:
            self.spell(parts, out)
        return out

    def spell(self, parts: list[tuple], out: list[bytes]) -> None:
        lens = np.fromiter((len(ids) for _, ids in parts), np.int64, len(parts))
        flat = np.concatenate([np.asarray(ids, dtype=np.int64) for _, ids in parts])
        self.load("coded", pa.table({"w": np.repeat(np.arange(len(parts), dtype=np.int32), lens), "pos": np.arange(len(flat)), "id": flat}))
        got = self.db.sql("SELECT w, string_agg(raw, '' ORDER BY pos) AS raw, count(raw) = count(*) AS known FROM coded LEFT JOIN vocab USING (id) GROUP BY w ORDER BY w").to_arrow_table()
        for w, raw, known in zip(*(c.to_pylist() for c in got.columns)):
            if not known:
                raise ValueError("an id is not in the vocabulary")
            out[parts[w][0]] += bytes.fromhex(raw)

    def matches(self, text: str) -> Iterator[list[str]]:
        """Matches of the pattern, all at once or, of a text longer than ``STEP``, in blocks."""
        if len(text) <= STEP:
            yield self.pattern.findall(text)
            return
        found = self.pattern.finditer(text)
        while block := [m[0] for m in islice(found, BLOCK)]:
            yield block

    def prepared(self, texts: list[str]) -> Iterator[tuple[int, list[tuple]]]:
        """For each block of matches, the text's place and what ``contract`` gives for each of them."""
        held: list[tuple[int, list[str]]] = []
        size = 0
        for k, text in enumerate(texts):
            for block in self.matches(text):
                held.append((k, block))
                size += len(block)
                if size >= BLOCK:
                    yield from self.known(held)
                    held, size = [], 0
        yield from self.known(held)

    def known(self, held: list[tuple[int, list[str]]]) -> Iterator[tuple[int, list[tuple]]]:
        if len(self.words) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self.words.clear()
            self.chars = 0
        if new := list(set().union(*(block for _, block in held)).difference(self.words)):
            coded = [w.encode() for w in new]
            found = self.contract(coded)
            self.words.update(zip(new, map(found.__getitem__, coded)))
            self.chars += sum(map(len, new))
        for k, block in held:
            yield k, list(map(self.words.__getitem__, block))


_VOCABULARIES: dict[tuple, Vocabulary] = {}


def vocabulary(path: str, pattern: str) -> Vocabulary:
    """One vocabulary for each worker process, kept across its tasks."""
    if (path, pattern) not in _VOCABULARIES:
        _VOCABULARIES[path, pattern] = Vocabulary(path, pattern)
    return _VOCABULARIES[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, ids array<int>)``."""

    def make():
        vocab = vocabulary(path, pattern)

        def f(rows, texts):
            ids = [array("i") for _ in texts]
            for k, got in vocab.prepared([x or "" for x in texts]):
                for x in got:
                    ids[k].extend(map(int, x[0].split(",")))
            return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([np.asarray(x, dtype=np.int32) for x in ids], pa.list_(pa.int32()))], ["doc_id", "ids"])

        return f

    return map_steps(documents(docs), "doc_id long, ids array<int>", make)


def decode(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, raw binary)`` of ``(doc_id, ids)``: the ordered aggregation alone; null ids count as none."""

    def run(batches):
        vocab = vocabulary(path, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(vocab.decode([x or [] for x in part.column("ids").to_pylist()]), pa.binary())], ["doc_id", "raw"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, raw binary")


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of each text's ids and of their decoded bytes."""

    def make():
        vocab = vocabulary(path, pattern)

        def f(rows, texts):
            n = [0] * len(texts)
            coded, raw = ([hashlib.sha256() for _ in texts] for _ in range(2))
            for k, got in vocab.prepared([x or "" for x in texts]):
                if not got:
                    continue
                if n[k]:
                    coded[k].update(b",")
                ids = ",".join([x[0] for x in got]).encode()
                n[k] += ids.count(b",") + 1
                coded[k].update(ids)
                raw[k].update(b"".join([x[1] for x in got]))
            return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n, pa.int64()), *(pa.array([h.hexdigest() for h in hs], pa.string()) for hs in (coded, raw))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return f

    return map_steps(documents(docs), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make, most=STEP)
