"""Quartile bucket digests of documents, compared by a bounded difference score.

Byte triplets are hashed into 1,024 buckets. A bucket's code is the quartile of its count among all
counts (two bits), before which stand a logarithmic length and the ratios of the quartiles. The
difference of two digests sums the code distances (from the lowest to the highest quartile counts
double) and the header's distances; it is bounded at half of the greatest possible sum, where texts
without anything in common lie, and likeness is one minus the difference over that bound.

Cases: a null text counts as empty; texts with fewer than three bytes have no triplets, so their
digest is the length and, for any bytes at all, their checksum; equal texts have equal digests; a
null ``doc_id`` sorts before all others, and rows with one ``doc_id`` sort by their texts; an empty
table gives no rows; a very long text is digested whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfront.llm.common import documents, map_steps, quiet_threads, small_batches

BUCKETS = 1024
#: Odd weights of the three byte values in a triplet's hash.
MIX = np.array([0x9E3B, 0x85EB, 0xC2B3], dtype=np.uint32)
LENGTH_MOST, RATIO_MOST = 12, 7
#: Greatest difference of the codes, and of all parts with their weights; differences are bounded at half of that.
CODES_MOST = 6 * BUCKETS
MOST = CODES_MOST + 64 * LENGTH_MOST + 2 * 32 * RATIO_MOST
BOUND = MOST // 2


def counts(raw: bytes) -> np.ndarray:
    """Occurrences of the hashed triplets by bucket."""
    x = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(x) < 3:
        return np.zeros(BUCKETS, np.int64)
    h = x[:-2] * MIX[0] + x[1:-1] * MIX[1] + x[2:] * MIX[2]
    h ^= h >> 15
    h *= np.uint32(0x85EBCA6B)
    return np.bincount(h >> 22, minlength=BUCKETS)


def digest(text: str | None) -> str:
    """Hex digest: length (2), quartile ratios (2), checksum of triplet-free texts (8), codes (512)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = counts(raw)
    q1, q2, q3 = np.sort(n)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (n > q1).astype(np.uint8) + (n > q2) + (n > q3)
    packed = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    size = min(255, round(8 * math.log2(1 + len(raw))))
    ratios = [int(15 * q / q3) if q3 else 0 for q in (q1, q2)]
    bare = 0 if len(raw) > 2 else zlib.crc32(raw)
    return f"{size:02x}{ratios[0]:x}{ratios[1]:x}{bare:08x}{packed.tobytes().hex()}"


def difference(a: str, b: str) -> int:
    """From 0 for equal digests to ``BOUND``; digests of triplet-free texts are equal or at the bound."""
    if a == b:
        return 0
    size = min(LENGTH_MOST, abs(int(a[:2], 16) - int(b[:2], 16)) // 2)
    ratios = sum(min(RATIO_MOST, abs(int(a[k], 16) - int(b[k], 16))) for k in (2, 3))
    if a[4:12] != b[4:12]:
        return BOUND
    x, y = (np.frombuffer(bytes.fromhex(d[12:]), np.uint8) for d in (a, b))
    gaps = np.concatenate([np.abs((x >> s & 3).astype(np.int8) - (y >> s & 3).astype(np.int8)) for s in (0, 2, 4, 6)])
    return min(BOUND, int(gaps.sum() + 3 * (gaps == 3).sum() + 64 * size + 32 * ratios))


def likeness(a: str, b: str) -> float:
    """1 for equal digests, falling to 0 at the bound."""
    return 1.0 - difference(a, b) / BOUND


def fingerprint(docs: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint)`` of each text."""

    def make():
        quiet_threads()
        return lambda rows, texts: pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([digest(x) for x in texts], pa.string())], ["doc_id", "fingerprint"])

    return map_steps(documents(docs), "doc_id long, fingerprint string", make)


def part_of(bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` lie below ``doc_id``, by a binary search inside one expression."""
    if not bounds:
        return F.lit(0)
    leaps = ", ".join(str(1 << k) for k in reversed(range(len(bounds).bit_length())))
    held = ", ".join(f"{b}L" if b > -(1 << 63) else "-9223372036854775807L - 1L" for b in bounds)
    return F.expr(f"aggregate(array({leaps}), 0, (n, s) -> CASE WHEN get(array({held}), n + s - 1) < doc_id THEN n + s ELSE n END)")


def in_order(docs: DataFrame, parts: int) -> DataFrame:
    """``(part, last, doc_id, text)``: rows by ascending ``doc_id``, each part followed by the next one's first row.

    The bounds of the parts are quantiles of ``doc_id``, and only they and each part's least ``doc_id``
    reach the driver (two numbers a part). Rows with that ``doc_id`` are sent twice, to their own part
    and, marked ``last``, to the one before; the least of their texts comes first there. The first
    row of all also ends the last part.
    """
    docs = documents(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("text", F.coalesce("text", F.lit("")))
    bounds = docs.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 20 * parts)).first()[0] if parts > 1 else []
    docs = docs.withColumn("part", part_of(sorted(set(bounds or []))).cast("int"))
    firsts = sorted((r.part, r.least) for r in docs.groupBy("part").agg(F.min("doc_id").alias("least")).collect())
    before = F.create_map(*[F.lit(x) for k, (_, least) in enumerate(firsts) for x in (least, firsts[k - 1][0])]) if firsts else F.lit(None).cast("map<bigint,int>")
    rows = docs.select("doc_id", "text", F.explode(F.array_compact(F.array(F.struct("part", F.lit(False).alias("last")), F.when(F.try_element_at(before, "doc_id").isNotNull(), F.struct(F.try_element_at(before, "doc_id").alias("part"), F.lit(True).alias("last")))))).alias("to"))
    return rows.select("to.part", "to.last", "doc_id", "text")


def edited(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Each document against its edited text and against the next document.

    The edited text has the last half of its code points replaced by as many from the start of the
    next document in order of ``doc_id``, or by all of it; the first document follows the last.
    """
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small_batches(docs.sparkSession)
    rows = in_order(docs, parts)
    rows = rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "last", "doc_id", "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches):
        quiet_threads()
        held = None
        for batch in batches:
            out = []
            for last, doc, text in zip(*(batch.column(c).to_pylist() for c in ("last", "doc_id", "text"))):
                own = digest(text)
                if held:
                    id_, old, mark = held
                    cut = len(old) - len(old) // 2
                    new = old[:cut] + text[: len(old) // 2]
                    print_ = digest(new)
                    out.append((id_ if id_ != -(1 << 63) else None, len(old), hashlib.sha256(new.encode()).hexdigest(), mark, print_, likeness(mark, print_), likeness(mark, own)))
                held = None if last else (doc, text, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return rows.select("last", "doc_id", "text").mapInArrow(run, schema)
