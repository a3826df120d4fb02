"""Repeated passages: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

A window of ``WINDOW`` words of one document is repeated if its words also start in a document with a
smaller ``doc_id``; every word that a repeated window covers goes. Windows are judged on the input.

Every window is hashed, and also marked by its anchor, the least hash among its runs of ``GRAM``
words. Equal windows have equal anchors, so only windows whose anchor occurs in two documents can
repeat; only these are counted by Spark (about one row in fifteen words is exchanged to find the
anchors). Counts and minima combine before the shuffle. Documents with the same words throughout
meet first, by their hash: all but the least ``doc_id`` of them are repeated as a whole. Repeated
windows of a document merge into maximal intervals.

Hashes: 64 bits for anchors, which only preselect; 96 bits (two polynomials) for windows; 128 bits
for whole documents.

Cases: a null text has no words; texts with fewer words than a window lose nothing; a null
``doc_id`` is carried, loses nothing and removes nothing; rows that share a ``doc_id`` remove nothing
from each other; repeated rows give repeated results; an empty table gives no rows; a very long text is
hashed whole; ``digest`` ignores other columns, and ``remove`` carries them, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfront.llm.common import cut, documents, free_name, map_steps, quiet_threads

WINDOW, GRAM = 50, 20
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
SPACES = b" \t\n\x0b\x0c\r"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


class Hasher:
    """Rolling hashes over the words of texts; each distinct word is hashed once."""

    REMEMBERED = 400_000

    def __init__(self):
        quiet_threads()
        self.seen: dict[bytes, int] = {}
        self.powers: list[tuple[np.ndarray, np.ndarray]] = [(np.ones(1, np.uint64),) * 2] * 2

    def ids(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        if len(self.seen) > self.REMEMBERED:
            self.seen.clear()
        for w in set(words).difference(self.seen):
            self.seen[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(self.seen.__getitem__, words), np.uint64, len(words))

    def rolled(self, ids: np.ndarray, width: int, which: int = 0) -> np.ndarray:
        """Hash of every run of ``width`` words: a polynomial modulo 2**64, by prefix sums, then mixed."""
        n = len(ids)
        if n < width:
            return np.zeros(0, np.uint64)
        if len(self.powers[which][0]) < n:
            up = np.full(2 * n, BASES[which], np.uint64)
            down = np.full(2 * n, pow(BASES[which], -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            self.powers[which] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        up, down = self.powers[which]
        if which:
            ids = (ids ^ (ids >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ids * up[:n], dtype=np.uint64)])
        h = (sums[width:] - sums[:-width]) * down[: n - width + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))

    def anchors(self, ids: np.ndarray, window: int, gram: int) -> np.ndarray:
        """The anchor of every window."""
        h = self.rolled(ids, gram)
        if len(ids) < window:
            return h[:0]
        return np.lib.stride_tricks.sliding_window_view(h, window - gram + 1).min(axis=1)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def covered(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal intervals of words that windows at ``starts`` cover."""
    if not len(starts):
        return []
    starts = np.unique(starts)
    gaps = np.flatnonzero(np.diff(starts) > window)
    first, last = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(starts) - 1]])
    return [(int(a), int(b) + window) for a, b in zip(starts[first], starts[last])]


def without(words: list[bytes], intervals: list[tuple[int, int]]) -> list[bytes]:
    out, at = [], 0
    for a, b in intervals:
        out += words[at:a]
        at = b
    return out + words[at:]


def text_without(text: str, intervals: list[tuple[int, int]]) -> str:
    """The text without the words of the intervals and the white space after each of them."""
    raw, out, at, k = text.encode("utf-8", "surrogatepass"), [], 0, 0
    words = raw.split()
    starts, pos = [], 0
    for w in words:
        pos = raw.index(w, pos)
        starts.append(pos)
        pos += len(w)
    for a, b in intervals:
        k = starts[a]
        out.append(raw[at:k])
        at = starts[b] if b < len(words) else len(raw)
    kept = b"".join([*out, raw[at:]])
    return (kept.rstrip(SPACES) if intervals and intervals[-1][1] >= len(words) else kept).decode("utf-8", "surrogatepass")


def profiles(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """``(doc_id, th, n_words, whole, full_sha, anchors)``: each row's words in short."""

    def make():
        import xxhash

        hasher = Hasher()

        def f(rows, texts):
            n, whole, sha, anchors = [], [], [], []
            for text in texts:
                words = words_of(text)
                joined = b" ".join(words)
                n.append(len(words))
                whole.append(xxhash.xxh3_128_digest(joined))
                sha.append(hashlib.sha256(joined).hexdigest())
                anchors.append(np.unique(hasher.anchors(hasher.ids(words), window, gram)).view(np.int64) if len(words) >= window else np.zeros(0, np.int64))
            return pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("th"), pa.array(n, pa.int64()), pa.array(whole, pa.binary()), pa.array(sha, pa.string()), pa.array(anchors, pa.list_(pa.int64()))], ["doc_id", "th", "n_words", "whole", "full_sha", "anchors"])

        return f

    return map_steps(documents(docs, F.xxhash64("text").alias("th")), "doc_id long, th long, n_words long, whole binary, full_sha string, anchors array<long>", make)


def candidates(docs: DataFrame, wanted: DataFrame, window: int, gram: int) -> DataFrame:
    """``(doc_id, th, text, at, h, g)``: documents with windows that may repeat, and these windows' places and hashes."""

    def make():
        hasher = Hasher()

        def f(rows, texts):
            at, h, g = [], [], []
            for text, shared in zip(texts, rows.column("shared").to_pylist()):
                ids = hasher.ids(words_of(text))
                places = np.flatnonzero(np.isin(hasher.anchors(ids, window, gram).view(np.int64), np.array(shared, np.int64)))
                at.append(places.astype(np.int32))
                h.append(hasher.rolled(ids, window, 0)[places].view(np.int64))
                g.append((hasher.rolled(ids, window, 1)[places] >> np.uint64(32)).astype(np.uint32).view(np.int32))
            columns = [*(rows.column(c) for c in ("doc_id", "th", "text")), pa.array(at, pa.list_(pa.int32())), pa.array(h, pa.list_(pa.int64())), pa.array(g, pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "text", "at", "h", "g"])

        return f

    texts = documents(docs, F.xxhash64("text").alias("th"))
    rows = texts.join(wanted, ["doc_id", "th"]).select("doc_id", "th", "text", "shared")
    return map_steps(rows, "doc_id long, th long, text string, at array<int>, h array<long>, g array<int>", make)


def repeated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """All rows' profiles with ``copy`` (repeated as a whole), and ``(doc_id, th, text, starts)`` of those that lose a part."""
    rows = cut(profiles(docs, window, gram), "passages")
    long = rows.filter(F.col("n_words") >= window).filter("doc_id is not null")
    classes = cut(long.groupBy("whole").agg(F.min("doc_id").alias("least"), F.min_by(F.struct("th", "anchors"), "doc_id").alias("r")), "passages-classes")
    reps = classes.select(F.col("least").alias("doc_id"), F.col("r.th").alias("th"), F.explode("r.anchors").alias("anchor"))
    shared = reps.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("anchor")
    wanted = reps.join(shared, "anchor").groupBy("doc_id", "th").agg(F.collect_set("anchor").alias("shared"))
    some = cut(candidates(docs, cut(wanted, "passages-wanted"), window, gram), "passages-some")
    windows = some.select("doc_id", "th", F.explode(F.arrays_zip("at", "h", "g")).alias("w")).select("doc_id", "th", "w.at", "w.h", "w.g")
    first = windows.groupBy("h", "g").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("h", "g", "lo")
    first = cut(first, "passages-first")  # so that the join reads two exchanges, of which a hot passage's can be split
    hits = windows.join(first, ["h", "g"]).filter("doc_id > lo").groupBy("doc_id", "th").agg(F.collect_set("at").alias("starts"))
    parts = some.drop("at", "h", "g").join(cut(hits, "passages-hits"), ["doc_id", "th"]).select("doc_id", "th", "text", "starts")
    marked = rows.join(classes.select("whole", "least"), "whole", "left")
    return marked.select("doc_id", "th", "n_words", "full_sha", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).alias("copy")), parts


def digest(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` of every row."""
    marked, parts = repeated(docs, window, gram)

    def make():
        def f(rows, texts):
            n, sha = [], []
            for text, starts in zip(texts, rows.column("starts").to_pylist()):
                intervals = covered(np.array(starts), window)
                n.append(sum(b - a for a, b in intervals))
                sha.append(hashlib.sha256(b" ".join(without(words_of(text), intervals))).hexdigest())
            return pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("th"), pa.array(n, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "th", "lost", "sha"])

        return f

    cuts = map_steps(parts, "doc_id long, th long, lost long, sha string", make).dropDuplicates(["doc_id", "th"])
    out = marked.join(cuts, ["doc_id", "th"], "left")
    lost = F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("lost", F.lit(0)))
    sha = F.when(F.col("copy"), EMPTY_SHA).otherwise(F.coalesce("sha", "full_sha"))
    return out.select("doc_id", "n_words", lost.cast("long").alias("n_removed"), sha.alias("kept_sha256"))


def remove(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The documents without their repeated passages; all columns stay, ``n_chars`` follows a changed text."""
    marked, parts = repeated(docs, window, gram)

    def make():
        def f(rows, texts):
            new = [text_without(x, covered(np.array(s), window)) for x, s in zip(texts, rows.column("starts").to_pylist())]
            return pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("th"), pa.array(new, pa.string())], ["doc_id", "th", "_new"])

        return f

    cuts = map_steps(parts, "doc_id long, th long, _new string", make)
    edits = marked.filter("copy").select("doc_id", "th", F.lit("").alias("_new")).union(cuts).dropDuplicates(["doc_id", "th"])
    id_, th, new = (free_name(docs, c) for c in ("edit_id", "edit_hash", "edit_text"))
    edits = edits.select(F.col("doc_id").alias(id_), F.col("th").alias(th), F.col("_new").alias(new))
    out = docs.join(edits, (docs["doc_id"].cast("long") == edits[id_]) & (F.xxhash64(docs["text"].cast("string")) == edits[th]), "left")
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.coalesce(edits[new], docs["text"]).alias("text"))
        elif c == "n_chars":
            columns.append(F.when(edits[new].isNotNull(), F.length(edits[new]).cast(docs.schema[c].dataType)).otherwise(docs[c]).alias(c))
        else:
            columns.append(docs[c])
    return out.select(*columns)
