"""SimHash near-duplicates by a binary trie self-join.

A fingerprint's bit is set where over half of the document's shingle hashes have it. Fingerprints at
no more than three differing bits link; a component is all that links reach.

The trie's self-join is dealt out so that no task holds the whole trie: two fingerprints with at
most three differing bits agree on one of four 16-bit blocks and, in the other 48 bits, on one of
four 12-bit blocks, so each distinct fingerprint goes to 16 subtries that share 28 bits. In a
subtrie, node pairs descend together with the bits that differ so far; a pair is dropped when
they exceed the budget, or when both nodes already lie in one component, so a dense cluster costs
no pair for each two of its members. A subtrie with more than ``CROWD`` members is dealt out in square
blocks: its members fall on sides by their hash, and every pair of sides is a trie of its own. A trie
emits links that span its components, at most one a member. The distributed components of these links are those of all links.

Cases: a null text has no words; fingerprints of texts without words are zero and link like others;
exact copies meet as one fingerprint before the join; a null ``doc_id`` is carried, and does not
count in the least id of a component unless it is the only one (then null); repeated rows are kept;
an empty table gives no rows; a very long text is hashed whole; other columns are ignored, whatever their
names (``keep_first`` carries them).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfront.llm.common import components, cut, documents, free_name, map_steps, quiet_threads, release

BITS, BUDGET = 64, 3
#: Node pairs that descend together.
FRONTIER = 1 << 17
#: Members of one side of a subtrie's block, and the most sides.
CROWD, SIDES = 1 << 17, 1 << 15
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def hash_of(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Fingerprint of a text by XXH64 of its word shingles."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 50_000):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : at + 50_000].tolist(), last[at : at + 50_000].tolist())][: n - at], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(len(h), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``(doc_id, fp)``: fingerprints as signed longs."""

    def make():
        quiet_threads()

        def f(rows, texts):
            fp = np.array([hash_of(x, shingle) for x in texts], dtype=np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

        return f

    return map_steps(documents(docs), "doc_id long, fp long", make)


def links_in(group: np.ndarray, fp: np.ndarray, budget: int = BUDGET) -> np.ndarray:
    """For members sorted by group and fingerprint (distinct in a group): the place of the first member of their component."""
    n = len(fp)
    label = np.arange(n)
    if n < 2:
        return label
    edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    lo, hi = edge, np.concatenate([edge[1:], [n]])
    big = hi - lo > 1
    roots = np.stack([lo[big], hi[big], lo[big], hi[big], np.zeros(big.sum(), np.int64), np.zeros(big.sum(), np.int64)])
    ones: dict[int, np.ndarray] = {}

    def below(bit: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Where the members with the bit set begin in [a, b)."""
        out = np.empty_like(a)
        for k in np.unique(bit):
            if k not in ones:
                ones[k] = np.concatenate([[0], np.cumsum(fp >> np.uint64(63 - k) & np.uint64(1), dtype=np.int64)])
            m = bit == k
            out[m] = b[m] - (ones[k][b[m]] - ones[k][a[m]])
        return out

    def unite(x: np.ndarray, y: np.ndarray) -> None:
        """Join the components of the pairs: each root takes the least label met, until nothing changes."""
        while True:
            a, b = label[x], label[y]
            apart = a != b
            if not apart.any():
                break
            x, y, a, b = x[apart], y[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up

    stack = [roots]
    changes = None
    while stack:
        f = stack.pop()
        if f.shape[1] > FRONTIER:
            stack.append(f[:, FRONTIER:])
            f = f[:, :FRONTIER]
        if changes is None:
            changes = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
        a, b, c, d, depth, err = f
        settled = (label[a] == label[c]) & (changes[b - 1] == changes[a]) & (changes[d - 1] == changes[c])
        f = f[:, ~settled]
        if not f.shape[1]:
            continue
        a, b, c, d, depth, err = f
        # two single members: count the bits at once
        ends = (b - a == 1) & (d - c == 1)
        if ends.any():
            x, y = a[ends], c[ends]
            near = np.bitwise_count(fp[x] ^ fp[y]) <= budget
            if near.any():
                unite(x[near], y[near])
                changes = None
            f = f[:, ~ends]
            if not f.shape[1]:
                continue
            a, b, c, d, depth, err = f
        m1 = below(depth, a, b)
        m2 = below(depth, c, d)
        same = a == c
        out = []
        for (s, e), (u, v), cost, keep in (((a, m1), (c, m2), 0, None), ((m1, b), (m2, d), 0, None), ((a, m1), (m2, d), 1, None), ((m1, b), (c, m2), 1, ~same)):
            ok = (e > s) & (v > u) & (err + cost <= budget) & ((depth < BITS))
            if keep is not None:
                ok &= keep
            ok &= ~((s == u) & (e == v) & (e - s == 1))  # a single member with itself
            out.append(np.stack([s[ok], e[ok], u[ok], v[ok], depth[ok] + 1, err[ok] + cost]))
        stack.append(np.concatenate(out, axis=1))
    return label


def subtries(distinct: DataFrame) -> DataFrame:
    """``(key, fp)``: each fingerprint once for each of its 16 pairs of agreeing blocks."""
    keys = []
    for i in range(4):
        outer = F.shiftrightunsigned("fp", 16 * i).bitwiseAND(0xFFFF)
        rest = F.shiftrightunsigned("fp", 16 * (i + 1)).bitwiseAND((1 << 16 * (3 - i)) - 1)
        rest = F.shiftleft(rest, 16 * i).bitwiseOR(F.col("fp").bitwiseAND((1 << 16 * i) - 1))
        for j in range(4):
            inner = F.shiftrightunsigned(rest, 12 * j).bitwiseAND(0xFFF)
            keys.append(F.lit((4 * i + j) << 28).cast("long").bitwiseOR(F.shiftleft(outer.cast("long"), 12)).bitwiseOR(inner))
    return distinct.select(F.explode(F.array(*keys)).alias("key"), "fp")


def blocks(rows: DataFrame, crowd: int) -> DataFrame:
    """``(key, fp)`` with a key for each block: subtries over ``crowd`` members as all pairs of their sides.

    The table of crowded subtries is written first, so that Spark knows its size when it picks the join.
    """
    crowded = rows.groupBy("key").count().filter(F.col("count") > crowd)
    crowded = cut(crowded.select("key", F.least(F.ceil(F.col("count") / crowd), F.lit(SIDES)).cast("int").alias("sides")), "simhash-crowded")
    own = F.pmod(F.xxhash64("fp"), F.coalesce("sides", F.lit(1))).cast("int").alias("own")
    dealt = rows.join(crowded, "key", "left").select("key", "fp", own, F.explode(F.sequence(F.lit(0), F.coalesce("sides", F.lit(1)) - 1)).alias("other"))
    pair = F.shiftleft(F.least("own", "other").cast("long"), 15).bitwiseOR(F.greatest("own", "other").cast("long"))
    return dealt.select(F.shiftleft("key", 30).bitwiseOR(pair).alias("key"), "fp")


def spanning_links(distinct: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``(u, v)`` over fingerprints: links that span every component of the trie's self-join."""
    rows = blocks(subtries(distinct), crowd)
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        # groups of one key arrive together, in order; a batch may end inside a group
        keys, fps = [], []
        held = 0

        def solve(key, fp):
            order = np.lexsort((fp, key))
            key, fp = key[order], fp[order]
            root = links_in(key, fp)
            far = root != np.arange(len(fp))
            return pa.RecordBatch.from_arrays([pa.array(fp[far].view(np.int64)), pa.array(fp[root[far]].view(np.int64))], ["u", "v"])

        for batch in batches:
            if batch.num_rows:
                keys.append(batch.column("key").to_numpy())
                fps.append(batch.column("fp").to_numpy().view(np.uint64))
                held += batch.num_rows
            if held > 1 << 18:
                key, fp = np.concatenate(keys), np.concatenate(fps)
                whole = np.searchsorted(key, key[-1])  # the last group may go on
                if whole:
                    yield solve(key[:whole], fp[:whole])
                keys, fps, held = [key[whole:]], [fp[whole:]], len(key) - whole
        if held:
            yield solve(np.concatenate(keys), np.concatenate(fps))

    return rows.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every row."""
    prints = cut(fingerprints(docs, shingle), "simhash")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    links = cut(spanning_links(classes.select("fp")), "simhash-links")
    joined = components(links, "simhash")
    grouped = cut(classes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), "least"), "simhash-classes")
    ids = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print = grouped.join(ids, "component").select("fp", "component_id")
    release(links)
    return prints.join(by_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """The documents with one row of each component: that of the least ``doc_id``.

    Rows without a ``doc_id`` stay, for nothing tells which of them to keep; rows that repeat one
    ``doc_id`` are one document and stay together.
    """
    first = free_name(docs, "first")
    found = near_duplicates(docs, shingle).filter("doc_id = component_id").select(F.col("doc_id").alias(first)).distinct()
    rows = docs.join(found, docs["doc_id"].cast("long") == found[first], "left")
    return rows.filter(found[first].isNotNull() | docs["doc_id"].isNull()).drop(first)
