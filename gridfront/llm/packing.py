"""Concatenate and cut: documents become one stream of token ids that is cut at fixed windows.

Pass one tokenizes each partition and keeps the running position of every document inside it.
The partitions' totals (one number each) are summed on the driver into global offsets. Pass two
places each document in the stream and cuts it at multiples of the window. A task emits its windows
whole where it holds all of their ids; the parts of windows that tasks share are boundary records,
which alone are shuffled, by their sequence, at most ``window`` of them for one. A sequence carries
its ids and the pieces of documents that they are.

Ids are those of the ``tokenizers`` library with ``add_special_tokens=False`` and no other setting: the
string of a special token in a text becomes that token's id.

Cases: a null text counts as empty, and an empty text is its end id alone; a null ``doc_id`` is
carried as it is; repeated rows are packed once each; an empty table gives no pieces; texts longer
than a window span several, and the longest are encoded whole; columns beside ``doc_id`` and ``text``
are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfront.llm.common import cut, documents, map_steps, quiet_threads, release

#: A space that follows white space and precedes white space or the end: the only spaces at which
#: a byte-level pre-tokenizer may not start a new match.
UNSAFE_SPACE = re.compile(r"\s \s|\s $")
#: Distinct chunks that a worker remembers before it starts anew.
REMEMBERED = 400_000

#: A piece in its sequence; and a sequence, or a boundary record of it that begins at ``first``.
PIECE = "doc_id long, start long, length long, doc_tokens long, offset long"
RECORD = f"sequence_id long, first long, width int, raw binary, pieces array<struct<{PIECE.replace(' ', ':').replace(',:', ',')}>>"
DIGEST = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Ragged:
    """Rows of ids by key, in one flat array."""

    def __init__(self, dtype: np.dtype):
        self.rows: dict = {}
        self.flat = np.zeros(1 << 16, dtype=dtype)
        self.ends = np.zeros(1 << 16, dtype=np.int64)

    def add(self, keys: list, flat: np.ndarray, lens: np.ndarray) -> None:
        n = len(self.rows)
        used = int(self.ends[n - 1]) if n else 0
        if used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat[:used], np.zeros(used + 2 * len(flat), dtype=self.flat.dtype)])
        if n + len(keys) > len(self.ends):
            self.ends = np.concatenate([self.ends[:n], np.zeros(n + 2 * len(keys), dtype=np.int64)])
        self.flat[used : used + len(flat)] = flat
        self.ends[n : n + len(keys)] = used + np.cumsum(lens)
        self.rows.update(zip(keys, range(n, n + len(keys))))

    def get(self, keys: list) -> tuple[np.ndarray, np.ndarray]:
        """The rows of known keys, one after another, and where each one ends."""
        rows = np.fromiter(map(self.rows.__getitem__, keys), np.int64, len(keys))
        begin = np.where(rows > 0, self.ends[rows - 1], 0)
        lens = self.ends[rows] - begin
        ends = np.cumsum(lens)
        return self.flat[np.repeat(begin - ends + lens, lens) + np.arange(ends[-1] if len(ends) else 0)], ends


@lru_cache(8)
def ranks_of(path: str) -> dict[bytes, int] | None:
    """Ranks by which ``tiktoken`` gives the very ids of a ``tokenizers`` file; None if that is not proved.

    Contracting the least rank among all pairs whose bytes are a token equals applying the file's
    merges in their order if ids follow the merges and each token, taken alone, is contracted to
    itself: a pair that spells a token has had no merge across its ends so far, so its inside went
    the way of the token alone, and the pair is the token's own merge.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
    if not plain or spec["normalizer"] or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space"):
        return None
    special = {x["content"] for x in spec["added_tokens"]}
    vocab = {k: v for k, v in model["vocab"].items() if k not in special}
    made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    order = [vocab.get(x, -1) for x in made]
    if len(set(made)) < len(made) or order != sorted(order) or sorted(vocab.values()) != list(range(len(vocab))) or len(vocab) != len(made) + 256:
        return None
    own = Tokenizer.from_file(path).model
    if any([t.id for t in own.tokenize(k)] != [v] for k, v in vocab.items()):
        return None
    # the printable stand-ins of bytes
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    back = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in shown)}
    return {bytes(back[c] for c in k): v for k, v in vocab.items()}


class ChunkEncoder:
    """Token ids of many texts by a ``tokenizers`` file; each distinct space-led chunk is encoded once."""

    def __init__(self, path: str, ranks: dict[bytes, int] | None):
        from tokenizers import Tokenizer

        quiet_threads()
        tokenizer = Tokenizer.from_file(path)
        self.whole = lambda texts: [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
        added = sorted(x.content for x in tokenizer.get_added_tokens_decoder().values())
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        if ranks:
            import public_tokenizers
            import tiktoken

            one = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self.batch = lambda texts: [one(x) for x in texts]
        else:
            self.batch = self.whole
        self.dtype = np.dtype("<u2") if tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.clear()

    def clear(self) -> None:
        self.chunks = Ragged(self.dtype)

    def learn(self, keys: list) -> None:
        """Encode chunks; a tuple is a text's first chunk, a string follows a space."""
        ids = self.batch([k[0] if isinstance(k, tuple) else " " + k for k in keys])
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        self.chunks.add(keys, np.fromiter(chain.from_iterable(ids), self.dtype, int(lens.sum())), lens)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.chunks.rows) > REMEMBERED:
            self.clear()
        keys: list = []
        counts, whole, added = [], {}, {}
        for k, text in enumerate(texts):
            text = text or ""
            special = self.special is not None and self.special.search(text)
            if special or UNSAFE_SPACE.search(text):
                (added if special else whole)[k] = text
                counts.append(0)
                continue
            parts = text.split(" ")
            parts[0] = (parts[0],)
            counts.append(len(parts))
            keys += parts
        if missing := list(set(keys).difference(self.chunks.rows)):
            self.learn(missing)
        flat, ends = self.chunks.get(keys)
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]
        out = [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        for texts_, encode in ((whole, self.batch), (added, self.whole)):
            for k, ids in zip(texts_, encode(list(texts_.values())) if texts_ else ()):
                out[k] = np.array(ids, dtype=self.dtype)
        return out


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str, ranks: dict[bytes, int] | None) -> ChunkEncoder:
    """One encoder for each worker process, kept across its tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path, ranks)
    return _ENCODERS[path]


def tokenize(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """``(part, begin, doc_id, n, width, ids)``: little-endian ids with the end id; begin is within the part."""

    ranks = docs.sparkSession.sparkContext.broadcast(ranks_of(path))

    def make():
        enc, part, at = encoder(path, ranks.value), TaskContext.get().partitionId(), 0

        def f(rows, texts):
            nonlocal at
            end = np.array([end_id], dtype=enc.dtype)
            ids = [np.concatenate([x, end]) for x in enc.encode(texts)]
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            begin = at + np.cumsum(n) - n
            at += int(n.sum())
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), part, np.int32)), pa.array(begin), rows.column("doc_id"), pa.array(n), pa.array(np.full(len(n), enc.dtype.itemsize, np.int32)), pa.array([x.tobytes() for x in ids], pa.binary())],
                ["part", "begin", "doc_id", "n", "width", "ids"],
            )

        return f

    return map_steps(documents(docs), "part int, begin long, doc_id long, n long, width int, ids binary", make)


def placed(docs: DataFrame, path: str, end_id: int = 0) -> tuple[DataFrame, dict[int, int]]:
    """The token table, written once, and the global offset of each of its parts."""
    tokens = cut(tokenize(docs, path, end_id), "tokens")
    totals = sorted((r.part, r.total) for r in tokens.groupBy("part").agg(F.sum("n").alias("total")).collect())
    offsets, at = {}, 0
    for part, total in totals:
        offsets[part] = at
        at += total
    return tokens, offsets


def cuts(begin: int, n: int, window: int) -> list[int]:
    """Bounds inside a document of ``n`` ids that begins at ``begin`` of the stream."""
    return [0, *range(window - begin % window, n, window), n]


def records(docs: DataFrame, path: str, window: int = 1024, end_id: int = 0) -> DataFrame:
    """``RECORD`` rows, written once: whole windows, and boundary records of those that tasks share."""
    tokens, offsets = placed(docs, path, end_id)

    def run(batches):
        held: list[np.ndarray] = []
        pieces: list[tuple] = []
        seq = first = size = width = 0
        for batch in batches:
            out: list[tuple] = []
            for part, begin, doc, n, wide, raw in zip(*(batch.column(c).to_pylist() for c in ("part", "begin", "doc_id", "n", "width", "ids"))):
                ids, begin = np.frombuffer(raw, f"<u{wide}"), begin + offsets[part]
                bounds = cuts(begin, n, window)
                for a, b in zip(bounds[:-1], bounds[1:]):
                    s, o = divmod(begin + a, window)
                    if held and (s != seq or first + size != o):
                        out.append((seq, first, width, np.concatenate(held).tobytes(), pieces))
                        held, pieces, size = [], [], 0
                    if not held:
                        seq, first, width = s, o, wide
                    held.append(ids[a:b])
                    pieces.append((doc, a, b - a, n, o))
                    size += b - a
            if out:
                yield packed(out)
        if held:
            yield packed([(seq, first, width, np.concatenate(held).tobytes(), pieces)])

    out = cut(tokens.mapInArrow(run, RECORD), "windows")
    release(tokens)
    return out


def packed(rows: list[tuple]) -> pa.RecordBatch:
    """A batch of ``RECORD`` rows."""
    seq, first, width, raw, pieces = zip(*rows)
    ends = np.concatenate([[0], np.cumsum([len(x) for x in pieces])]).astype(np.int32)
    flat = list(zip(*(x for ps in pieces for x in ps)))
    names = [x.split()[0] for x in PIECE.split(", ")]
    inner = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in flat], names)
    arrays = [pa.array(seq, pa.int64()), pa.array(first, pa.int64()), pa.array(width, pa.int32()), pa.array(raw, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), inner)]
    return pa.RecordBatch.from_arrays(arrays, ["sequence_id", "first", "width", "raw", "pieces"])


def sequences(docs: DataFrame, path: str, window: int = 1024, end_id: int = 0) -> DataFrame:
    """``(sequence_id, width, raw, pieces)``: each window's ids, little-endian of ``width`` bytes, and its pieces in order."""
    rows = records(docs, path, window, end_id)
    whole = F.octet_length("raw") == window * F.col("width")
    met = rows.filter(~whole).groupBy("sequence_id").agg(F.first("width").alias("width"), F.array_sort(F.collect_list(F.struct("first", "raw", "pieces"))).alias("r"))
    met = met.select("sequence_id", "width", F.expr("aggregate(r, cast('' as binary), (a, x) -> a || x.raw)").alias("raw"), F.flatten(F.transform("r", lambda x: x.pieces)).alias("pieces"))
    return rows.filter(whole).select("sequence_id", "width", "raw", "pieces").union(met)


def pack_sequences(docs: DataFrame, path: str, window: int = 1024, end_id: int = 0) -> DataFrame:
    """``(sequence_id, ids array<int>, pieces)``: what training reads. The last sequence may be short."""

    def ids(batches):
        for b in batches:
            flat = [np.frombuffer(x, f"<u{w}").astype(np.int32) for x, w in zip(b.column("raw").to_pylist(), b.column("width").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("sequence_id"), pa.array(flat, pa.list_(pa.int32())), b.column("pieces")], ["sequence_id", "ids", "pieces"])

    kind = RECORD.split("pieces ")[1]
    return sequences(docs, path, window, end_id).mapInArrow(ids, f"sequence_id long, ids array<int>, pieces {kind}")


def pack(docs: DataFrame, path: str, window: int = 1024, end_id: int = 0) -> DataFrame:
    """One row for each piece of a document, read off the sequences: where it lies and a checksum of its ids there."""
    names = [x.split()[0] for x in DIGEST.split(", ")]

    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for seq, width, raw, pieces in zip(*(b.column(c).to_pylist() for c in ("sequence_id", "width", "raw", "pieces"))):
                ids = np.frombuffer(raw, f"<u{width}").astype("<u4")
                out += [(p["doc_id"], p["start"], p["length"], zlib.crc32(ids[p["offset"] : p["offset"] + p["length"]]), p["doc_tokens"], seq, p["offset"]) for p in pieces]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)

    return sequences(docs, path, window, end_id).mapInArrow(run, DIGEST)
