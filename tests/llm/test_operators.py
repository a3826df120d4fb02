"""The ten operators against brute force, the libraries they must equal, and awkward rows."""

import base64
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

from gridfront.llm import bpe, fingerprint, langid, packing, pii, quality, queries, simhash, substring, urls, vectors
from gridfront.llm.common import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th long, fp string, uid int, part string, first int, edit_text string, score double"
JSON, MULTI = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")


def row(id_, text, lang="en"):
    return (id_, text, lang, "s", None if text is None else len(text), 1, "x", 2, "y", 3, "z", 0.5)


LONG = " ".join(f"w{k % 977}" for k in range(60_000))
ODD = [
    row(3, None), row(1, ""), row(2, "  \n\t "), row(4, "a"), row(5, "a b"), row(6, "One two three four"), row(7, "one TWO three four"),
    row(7, "one TWO three four"), row(None, "no id here"), row(None, None), row(9, LONG), row(10, LONG), row(11, "x" * 3000),
    row(12, "日本語 テスト 🙂🙂 é"), row(13, "mail a.b+c@d-e.org, 10.0.0.1, 4111 1111 1111 1111 or +1 (988) 555-2485!"), row(14, "   lead  and   trail   "),
    row(15, "passage " + " ".join(f"p{k}" for k in range(70)) + " end"), row(16, "other start " + " ".join(f"p{k}" for k in range(70)) + " tail", None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- packing and tokens ---------------------------------------------------------------------


def packed_ok(pieces, rows, window=1024):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    by, seqs = {}, {}
    for p in pieces:
        by.setdefault(p.doc_id, []).append(p)
        seqs.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for id_, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        at = 0
        for p in sorted(by[id_], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    assert sum(window - sum(n for _, n in s) for s in seqs.values()) < window


def test_pack(docs):
    packed_ok(packing.pack(docs, JSON).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_pack_odd(odd, empty):
    rows = odd.filter("doc_id is not null").dropDuplicates(["doc_id"])
    packed_ok(packing.pack(rows, JSON).collect(), [(r.doc_id, r.text) for r in rows.collect()])
    assert packing.pack(odd, JSON).count() >= odd.count()
    assert packing.pack(empty, JSON).count() == 0


def test_pack_sequences(docs):
    got = {r.sequence_id: r.ids for r in packing.pack_sequences(docs.repartition(5), JSON, 256).collect()}
    assert sorted(got) == list(range(len(got)))
    assert all(len(got[k]) == 256 for k in range(len(got) - 1))
    total = sum(len(x) for x in got.values())
    assert total == packing.pack(docs, JSON).agg(F.sum("length")).first()[0]


def test_pack_special_strings(spark):
    rows = [(1, "a <|endoftext|> b"), (2, "<|endoftext|>"), (3, "<|endoftext|><|endoftext|>  x  "), (4, "<|endoftext |>"), (5, "plain")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), JSON).collect()
    packed_ok(got, rows)
    ids = [r.ids for r in packing.pack_sequences(spark.createDataFrame(rows, "doc_id long, text string"), JSON).collect()][0]
    assert ids.count(50256) == 4


def test_boundary_records_meet(docs):
    few = docs.repartition(7)
    records = packing.records(few, JSON, 512)
    shared = records.filter(F.octet_length("raw") < 512 * F.col("width")).count()
    assert shared > 6 and records.groupBy("sequence_id").count().filter("count > 1").count() > 2
    for r in packing.sequences(few, JSON, 512).collect():
        ends = 0
        for p in r.pieces:
            assert p.offset == ends
            ends += p.length
        assert ends * r.width == len(r.raw)


def test_ranks_are_proved():
    assert packing.ranks_of(JSON)
    assert packing.ranks_of(P.path("word_bpe_49k.json")) is None


def tiktoken_of():
    import tiktoken

    with open(MULTI, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(docs, odd):
    t = tiktoken_of()
    for d in (docs, odd):
        texts = {(r.doc_id, r.text or "") for r in d.collect()}
        want = sorted((repr(i), len(ids := t.encode_ordinary(x)), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(x.encode()).hexdigest()) for i, x in texts)
        got = sorted({(repr(r[0]), *r[1:]) for r in bpe.digest(d, MULTI, P.PATTERN).collect()})
        assert got == want


def test_bpe_round_trip(odd, empty):
    back = bpe.decode(bpe.encode(odd, MULTI, P.PATTERN), MULTI, P.PATTERN)
    assert sorted((repr(r.doc_id), bytes(r.raw)) for r in back.collect()) == sorted((repr(r.doc_id), (r.text or "").encode()) for r in odd.collect())
    assert bpe.digest(empty, MULTI, P.PATTERN).count() == 0


def test_bpe_long_words():
    v, t = bpe.vocabulary(MULTI, P.PATTERN), tiktoken_of()
    rng = np.random.default_rng(8)
    for letters in ("ab", "a=-", "日本語テスト人", "กขคงจ", "abcdefghijklmnopqrstuvwxyz", "=-_.", "0123456789abcdef"):
        for period in (None, 1, 2, 3, 7, 50):
            n = int(rng.integers(97, 700))
            some = "".join(rng.choice(list(letters), period or n))
            w = some * (n // len(some))
            ids, raw = v.contract([w.encode()])[w.encode()]
            want = t._core_bpe.encode_single_piece(w.encode())
            assert ids == ",".join(map(str, want)) and raw == w.encode(), (letters, period)


def test_bpe_of_great_texts(spark):
    """Six million characters of distinct words, and one unbroken word of a million letters."""
    rng, t = np.random.default_rng(9), tiktoken_of()
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
    texts = [" ".join(bytes(r).decode() for r in letters[rng.integers(0, 26, (600_000, 9))]), bytes(letters[rng.integers(0, 26, 1_000_000)]).decode()]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2, "doc_id")
    for r in bpe.digest(d, MULTI, P.PATTERN).collect():
        ids = t.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_bpe_blocks(odd, monkeypatch):
    want = collected(bpe.digest(odd, MULTI, P.PATTERN))
    v, texts = bpe.Vocabulary(MULTI, P.PATTERN), [r.text or "" for r in odd.collect()]
    for name, value in (("STEP", 10), ("BLOCK", 3), ("STATES", 3_000), ("DECODED", 4), ("REMEMBERED", 5)):
        monkeypatch.setattr(bpe, name, value)
    got = [[0, []] for _ in texts]
    for k, block in v.prepared([x[:2_000] for x in texts]):
        got[k][0] += sum(x[0].count(",") + 1 for x in block)
        got[k][1] += [x[1] for x in block]
    assert [b"".join(x[1]).decode() for x in got] == [x[:2_000] for x in texts]
    assert sorted(r[1] for r in want if r[1] < 300) == sorted(x[0] for x, y in zip(got, texts) if len(y) <= 2_000 and x[0] < 300)


# --- fingerprints -----------------------------------------------------------------------------


def test_fingerprint(spark, docs, odd, empty):
    for d in (docs, odd.filter("doc_id is not null").dropDuplicates(["doc_id"])):
        rows = sorted((r.doc_id, r.text or "") for r in d.collect())
        want = {}
        for k, (i, x) in enumerate(rows):
            nxt = rows[(k + 1) % len(rows)][1]
            new = x[: len(x) - len(x) // 2] + nxt[: len(x) // 2]
            want[i] = (len(x), hashlib.sha256(new.encode()).hexdigest(), fingerprint.digest(x), fingerprint.digest(new), fingerprint.likeness(fingerprint.digest(x), fingerprint.digest(nxt)))
        for parts in (1, 3, 8):
            got = {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_next) for r in fingerprint.edited(d, parts).collect()}
            assert got == want
    assert fingerprint.edited(odd).count() == odd.count()
    assert fingerprint.edited(empty).count() == 0
    assert fingerprint.likeness(fingerprint.digest("same text"), fingerprint.digest("same text")) == 1.0
    assert all(0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 for r in fingerprint.edited(odd).collect())


def digest_brute(text):
    """The digest by plain counting, one triplet at a time."""
    raw = (text or "").encode()
    n = [0] * 1024
    for a, b, c in zip(raw, raw[1:], raw[2:]):
        h = (a * 0x9E3B + b * 0x85EB + c * 0xC2B3) % 2**32
        h = (h ^ h >> 15) * 0x85EBCA6B % 2**32
        n[h >> 22] += 1
    q = [sorted(n)[k] for k in (255, 511, 767)]
    codes = [sum(v > b for b in q) for v in n]
    size = min(255, round(8 * np.log2(1 + len(raw))))
    ratios = [15 * b // q[2] if q[2] else 0 for b in q[:2]]
    return size, ratios, 0 if len(raw) > 2 else zlib.crc32(raw), codes


def likeness_brute(a, b):
    most = 6 * 1024 + 64 * 12 + 2 * 32 * 7
    x, y = digest_brute(a), digest_brute(b)
    if x == y:
        return 1.0
    if x[2] != y[2]:
        return 0.0
    gap = sum({0: 0, 1: 1, 2: 2, 3: 6}[abs(p - q)] for p, q in zip(x[3], y[3]))
    gap += 64 * min(12, abs(x[0] - y[0]) // 2) + 32 * sum(min(7, abs(p - q)) for p, q in zip(x[1], y[1]))
    return 1 - min(most // 2, gap) / (most // 2)


def test_fingerprint_by_brute_force(docs, odd):
    few = docs.limit(40).union(odd.filter("doc_id < 9 or doc_id > 10").dropDuplicates(["doc_id"]).select(docs.columns))
    few = few.withColumn("doc_id", F.col("doc_id") * 2 + F.when(F.col("source") == "s", 1).otherwise(0))
    rows = sorted((r.doc_id, r.text or "") for r in few.collect())
    got = {r.doc_id: r for r in fingerprint.edited(few, 4).collect()}
    assert len(got) == len(rows)
    for k, (i, x) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        new = x[: len(x) - len(x) // 2] + nxt[: len(x) // 2]
        for text, mark in ((x, got[i].fingerprint), (new, got[i].edited_fingerprint)):
            size, ratios, bare, codes = digest_brute(text)
            packed = bytes(codes[j] | codes[j + 1] << 2 | codes[j + 2] << 4 | codes[j + 3] << 6 for j in range(0, 1024, 4))
            assert mark == f"{size:02x}{ratios[0]:x}{ratios[1]:x}{bare:08x}{packed.hex()}"
        assert got[i].near_edited == pytest.approx(likeness_brute(x, new)) and got[i].near_next == pytest.approx(likeness_brute(x, nxt))


def test_fingerprint_of_repeated_ids(spark):
    """Rows of one id go by their texts; the part borders fall between them or not."""
    rows = [(k // 3, f"text {k * 7 % 5} of {k}") for k in range(60)] + [(5, "text"), (5, "text")]
    want = sorted(rows)
    for parts in (1, 4, 9):
        got = sorted((r.doc_id, r.edited_sha256) for r in fingerprint.edited(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), parts).collect())
        new = [(i, x[: len(x) - len(x) // 2] + want[(k + 1) % len(want)][1][: len(x) // 2]) for k, (i, x) in enumerate(want)]
        assert got == sorted((i, hashlib.sha256(x.encode()).hexdigest()) for i, x in new)


def test_very_long_texts(spark):
    """Three million characters of distinct words: the kernels of the operators that read whole texts."""
    rng = np.random.default_rng(12)
    text = " ".join(bytes(r).decode() for r in np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)[rng.integers(0, 26, (300_000, 9))]) + " jane@mail.org " + "9" * 200_000
    assert fingerprint.digest(text) == fingerprint.digest(text) != fingerprint.digest(text[:-1_500_000])
    assert pii.base_spans(text) == [("email", a := text.index("jane@"), a + 13)] and pii.spans([text])[0][1][0] == ("email", a, a + 13)
    x = quality.pooled(quality.Tokens(), [text, "short one"], quality.INDEX)
    assert np.isfinite(x).all() and x[0, -2] > x[1, -2]
    assert langid.Network(["a", "b"]).pool([text])[0].sum() == pytest.approx(1.0, abs=1e-4)
    assert len(list(packing.encoder(JSON, packing.ranks_of(JSON)).encode([text])[0])) > 300_000


# --- urls -------------------------------------------------------------------------------------


def test_urls(spark):
    rows = ["https://Blog.Example.COM/en/7198#top", "http://x.net/de/8", "http://a.example.net/de/8?q", "http://example.org/es/", "http://notcom/en/1", "com/en/", "", None, "http://com/en/?x", "http://u.com", "x://h.com:80/en/", "http://İ.com/en/A?b#c", "http://a.com/en/://b"]
    w = urls.train(urls.labelled_urls(spark))
    d = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(rows)] + [(None, "http://b.com/en/1", "c")], "page_id long, url string, host string")
    got = {r.page_id: r for r in urls.judge(d, queries.RULES, w).collect()}
    for k, u in enumerate(rows):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(h + p, v) for v, h, p in queries.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, key=lambda x: len(x[0]), default=(None, None))
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, best[0]), u
        grams = [(ord(m), *map(ord, s[i : i + 3])) for m, s in (("^", f"^^{host}^"), ("$", f"$${path}$")) for i in range(len(s) - 2)]
        total = w[urls.DIMS] + sum(w[(a * 7919 + b * 2617 + c * 131 + e * 31) % urls.DIMS] for a, b, c, e in grams)
        assert abs(got[k].blocked_probability - 1 / (1 + np.exp(-total / urls.UNIT))) < 1e-6
        assert got[k].verdict == (best[1] or ("block" if total >= 0 else "allow"))
    assert urls.judge(d.limit(0), queries.RULES, w).count() == 0


def test_url_model():
    rows = [(urls.bucket_list(u), float(y)) for u, y in urls.labelled_rows()]
    w, cut = urls.fitted(rows[: len(rows) * 4 // 5]), len(rows) * 4 // 5
    assert np.mean([(sum(w[k] for k in b) + w[urls.DIMS] >= 0) == bool(y) for b, y in rows[cut:]]) > 0.96
    w = urls.built_in_weights()
    blocked = lambda u: sum(w[k] for k in urls.bucket_list(u)) + w[urls.DIMS] >= 0
    for domain in ("example.com", "home.net", "never-seen.io"):
        for prefix in ("", "www.", "m."):
            assert not blocked(f"https://{prefix}garden.{domain}/en/77")
            for word in ("casino", "pills", "adult", "spam"):
                assert blocked(f"https://{prefix}{word}-win.{domain}/en/77") and blocked(f"https://{prefix}garden.{domain}/{word}/77.html")


def test_url_rules_tie(spark):
    d = spark.createDataFrame([(1, "http://a.b.c/x/y")], "page_id long, url string")
    w = urls.built_in_weights()
    for rules, want in (([("block", "b.c", "/x"), ("allow", "c", "/x/y")], ("b.c/x", "block")), ([("block", "c", "/x/y"), ("allow", "c", "/x/y")], ("c/x/y", "allow")), ([("block", "b.c", "/z")], (None, None))):
        r = urls.judge(d, rules, w).first()
        assert r.rule == want[0] and (want[1] is None or r.verdict == want[1])
    assert urls.judge(d, [], w).first().rule is None


def test_url_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    got = collected(queries.op3_url_filter(spark, sf))
    assert got == sorted(db.sql(queries.oracle_sql()["op3_url_filter"]).fetchall(), key=repr)
    assert {r[4] for r in got if r[3] is None} == {"allow", "block"}


# --- near-duplicates --------------------------------------------------------------------------


def simhash_brute(rows):
    def one(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]
        if not words:
            return 0
        sh = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fp = [one(x) for _, x in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if bin(fp[i] ^ fp[j]).count("1") <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, f"{fp[k]:016x}", least.get(find(k))) for k, (i, _) in enumerate(rows)), key=repr)


def test_simhash(docs, odd, empty):
    for d in (docs, odd):
        assert collected(simhash.near_duplicates(d)) == simhash_brute([(r.doc_id, r.text) for r in d.collect()])
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, _, c in simhash_brute([(r.doc_id, r.text) for r in docs.collect()])}
    assert simhash.keep_first(odd).columns == odd.columns


def test_spark_hash_is_the_hash(spark):
    r = spark.sql("SELECT xxhash64('a b c') AS h").first()
    assert r.h & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b c", 42)


def test_trie_join_in_clusters():
    rng = np.random.default_rng(5)
    for n in (2, 60, 300):
        fp = rng.integers(0, 2**63, 3, dtype=np.uint64)[rng.integers(0, 3, n)]
        for _ in range(3):
            fp = fp ^ (np.uint64(1) << rng.integers(0, 20, n).astype(np.uint64))
        fp = np.unique(fp)
        label = simhash.links_in(np.zeros(len(fp), np.int64), fp)
        near = np.bitwise_count(fp[:, None] ^ fp[None]) <= 3
        want = np.arange(len(fp))
        while not (new := np.array([want[near[k]].min() for k in range(len(fp))]))[:].tolist() == want.tolist():
            want = new
        assert label.tolist() == want.tolist()


def test_crowded_subtries(spark):
    rng = np.random.default_rng(6)
    fp = np.full(150, 0x9ABCDEF012345678, np.uint64)
    for _ in range(4):
        fp = fp ^ (np.uint64(1) << rng.integers(0, 24, len(fp)).astype(np.uint64))
    fp = np.unique(fp)
    near = np.bitwise_count(fp[:, None] ^ fp[None]) <= 3
    want = np.arange(len(fp))
    while not (new := np.array([want[near[k]].min() for k in range(len(fp))])).tolist() == want.tolist():
        want = new
    signed = fp.view(np.int64).tolist()
    d = spark.createDataFrame([(x,) for x in signed], "fp long")
    for crowd in (7, 60, 1 << 17):
        links = [(signed.index(r.u), signed.index(r.v)) for r in simhash.spanning_links(d, crowd).collect()]
        assert all(near[u, v] or want[u] == want[v] for u, v in links)
        got = np.arange(len(fp))
        for _ in range(len(fp)):
            for u, v in links:
                got[u] = got[v] = min(got[u], got[v])
        assert got.tolist() == want.tolist()


def test_components(spark):
    e = spark.createDataFrame([(k + 1, k) for k in range(1, 40)] + [(100, 200), (200, 100), (7, 7)], "u long, v long")
    got = {r.node: r.component for r in components(e, "t").collect()}
    assert got == {k: 1 for k in range(1, 41)} | {100: 100, 200: 100}


def test_vectors(spark, monkeypatch):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(30, 16)).astype(np.float32)
    rows = [(k, [float(x) for x in base[k % 30] + rng.normal(size=16) * 0.1], k % 3) for k in range(240)]
    rows += [(300, rows[0][1], 0), (301, rows[0][1], 0), (302, None, 0), (303, [0.0] * 16, 0), (304, [float("nan")] * 16, 0), (305, rows[0][1], None), (306, [None] + [1.0] * 15, 0), (307, [1.0, 2.0], 0), (308, [], 1), (None, rows[1][1], 1)]
    d = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<float>, label int, node string, times int")
    rows += [(400 + k, [float(x) for x in rng.normal(size=3)], 2) for k in range(30)] + [(500, [1.0, 2.0, 3.0], 2), (501, [2.0, 4.0, 6.01], 2), (502, [1.0, 2.0], 0), (503, [1.0, 2.1], 0)]  # other lengths
    d = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<float>, label int, node string, times int")
    sound = [(i, np.array(v, np.float32).astype(float), c) for i, v, c in rows if c is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = [v / np.linalg.norm(v) for _, v, _ in sound]
    x = np.array([np.pad(v, (0, 16 - len(v))) for v in unit])
    kinds = np.array([100 * c + len(v) for _, v, c in sound])
    near = (x @ x.T >= 0.93) & (kinds[:, None] == kinds[None])
    label = np.arange(len(x))
    for _ in range(20):
        label = np.array([label[near[k]].min() for k in range(len(x))])
    want = {i: (int(near[k].sum() - 1), min(j for m, (j, *_) in enumerate(sound) if label[m] == label[k] and j is not None)) for k, (i, *_) in enumerate(sound)}
    for block, centroids in ((20_000, 4), (7, 4), (20_000, 1)):
        got = vectors.near_duplicates(d, recall=1.0, block=block, centroids=centroids).collect()
        assert len(got) == len(rows)
        for r in got:
            links, comp = want.get(r.vec_id, (0, r.vec_id))
            assert (r.n_links, r.component_id) == (links, comp), r
            assert r.kept == (r.vec_id is not None and r.vec_id == comp)
    assert vectors.near_duplicates(d.limit(0)).count() == 0


def test_recall_at_the_default(spark):
    """Whole small table, each vector with a noisy copy at cosines about the threshold, at the default settings."""
    pdf = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").toPandas()
    rng, e = np.random.default_rng(4), np.array([np.asarray(v, float) for v in pdf.embedding])
    scale = np.linalg.norm(e, axis=1, keepdims=True) / e.shape[1] ** 0.5 * rng.uniform(0.0, 0.5, (len(e), 1))
    e, label = np.concatenate([e, e + scale * rng.normal(size=e.shape)]), np.tile(pdf.label.to_numpy(), 2)
    d = spark.createDataFrame([(k, [float(z) for z in v], int(c)) for k, (v, c) in enumerate(zip(e, label))], "vec_id long, embedding array<double>, label int")
    unit = e / np.linalg.norm(e, axis=1, keepdims=True)
    want = ((unit @ unit.T >= 0.93) & (label[:, None] == label[None])).sum(axis=1) - 1
    got = np.array([n for _, n in sorted((r.vec_id, r.n_links) for r in vectors.near_duplicates(d).collect())])
    assert (got <= want).all() and want.sum() > len(e) // 3 and got.sum() / want.sum() >= 0.99


def crowd_and_pairs(spark, cosines):
    """One tight crowd of distinct vectors beside pairs at the given cosines, and the links of each pair's row."""
    rng = np.random.default_rng(5)
    e = list(rng.normal(size=16) + rng.normal(size=(300, 16)) * 1e-3)
    for c in cosines:
        a, b = np.linalg.qr(rng.normal(size=(16, 2)))[0].T
        e += [a, c * a + np.sqrt(1 - c * c) * b]
    d = spark.createDataFrame([(k, [float(x) for x in v], 0) for k, v in enumerate(e)], "vec_id long, embedding array<double>, label int")
    unit = np.array(e) / np.linalg.norm(e, axis=1, keepdims=True)
    return d, (unit @ unit.T >= 0.93).sum(axis=1) - 1


def test_a_crowd_does_not_speak_for_loose_links(spark):
    d, want = crowd_and_pairs(spark, np.linspace(0.932, 0.96, 60))
    for centroids in (None, 8):
        assert {r.vec_id: r.n_links for r in vectors.near_duplicates(d, centroids=centroids).collect()} == dict(enumerate(want))


def test_reach_is_measured_in_every_band(spark, monkeypatch):
    cosines = np.linspace(0.932, 0.999, 240)
    d, want = crowd_and_pairs(spark, cosines)
    measured, reached = vectors.measured_reach, []
    monkeypatch.setattr(vectors, "measured_reach", lambda *a: reached.append(measured(*a)) or reached[-1])
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(d, recall=0.95, centroids=8).collect()}
    assert 0 < reached[0] < 0.14
    for at in range(0, 240, 60):
        assert np.mean([got[k] / want[k] for k in range(300 + 2 * at, 420 + 2 * at)]) >= 0.94


def test_multi_sequence_order():
    rng = np.random.default_rng(1)
    a, b = np.sort(rng.random(9)), np.sort(rng.random(7))
    got = vectors.traverse(a, b, 0.9)
    assert got == sorted(((i, j) for i in range(9) for j in range(7) if a[i] + b[j] <= 0.9), key=lambda p: (a[p[0]] + b[p[1]], p))


# --- repeated passages ------------------------------------------------------------------------


def passages_brute(rows, window=50):
    words = [[w for w in re.split(r"[\x20\x09-\x0D]+", x or "") if w] for _, x in rows]
    first = {}
    for (i, _), ws in zip(rows, words):
        for k in range(len(ws) - window + 1):
            key = tuple(ws[k : k + window])
            if i is not None:
                first[key] = min(i, first.get(key, i))
    out = []
    for (i, _), ws in zip(rows, words):
        gone = set()
        for k in range(len(ws) - window + 1):
            if i is not None and first[tuple(ws[k : k + window])] < i:
                gone |= set(range(k, k + window))
        kept = [w for k, w in enumerate(ws) if k not in gone]
        out.append((i, len(ws), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_substring(docs, odd, empty):
    small = odd.filter("doc_id is null or doc_id not in (9, 10)")
    for d in (docs, small):
        assert collected(substring.digest(d)) == passages_brute([(r.doc_id, r.text) for r in d.collect()])
    big = {r.doc_id: r for r in substring.digest(odd).collect()}
    assert big[10].n_removed == big[10].n_words == 60_000
    assert substring.digest(empty).count() == 0


def test_substring_short_windows(docs):
    few = docs.limit(60)
    assert collected(substring.digest(few, 8, 3)) == passages_brute([(r.doc_id, r.text) for r in few.collect()], 8)


def test_remove_keeps_the_rest(docs, odd):
    for d in (docs, odd.filter("doc_id is not null").dropDuplicates(["doc_id"])):
        out = substring.remove(d)
        assert out.columns == d.columns and out.count() == d.count()
        sha = {r.doc_id: r for r in substring.digest(d).collect()}
        old = {r.doc_id: r.text for r in d.collect()}
        for r in out.collect():
            assert hashlib.sha256(b" ".join(substring.words_of(r.text))).hexdigest() == sha[r.doc_id].kept_sha256
            if not sha[r.doc_id].n_removed:
                assert r.text == old[r.doc_id]


# --- personal data ----------------------------------------------------------------------------


def base_brute(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[^0-9]", "", m[0])
        total = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d)))
        if 13 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]


def test_pii_base(docs, odd, empty):
    rng = np.random.default_rng(2)
    made = ["".join(rng.choice(list("a1 .+@-()9\n"), 300)) for _ in range(200)]
    for x in [r.text or "" for r in docs.collect() + odd.collect()] + made:
        assert pii.base_spans(x) == base_brute(x)
    got = pii.find(odd).collect()
    assert len(got) == odd.count()
    r = next(r for r in got if r.doc_id == 13)
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
    assert pii.find(empty).count() == 0


def test_pii_field():
    t = "call (988) 555-2485 or jo_ann [at] mail [dot] org; card +1 (269) 555-3296 4524132264652876 end"
    found = {(k, t[a:b]) for k, a, b in pii.spans([t])[0][1]}
    assert ("phone", "(988) 555-2485") in found and ("card", "4524132264652876") in found
    clean = "In 2024 we saw 12 birds. Version 3.11 costs $20.50, ref AB12CD3, see page 7."
    assert pii.spans([clean])[0] == ([], [])
    field = pii.trained()
    rows = pii.labelled_table()
    paths = field.viterbi([[w for w, _ in r] for r in rows])
    right = [a == y for r, p in zip(rows, paths) for (_, y), a in zip(r, p)]
    assert np.mean(right) > 0.97


def test_viterbi_is_the_best_path():
    import itertools

    field = pii.trained()
    words = ["call", "+1", "(988)", "555-2485"]
    e, move = field.scores(words), field.move + field.bar
    best = max(itertools.product(range(len(pii.LABELS)), repeat=4), key=lambda p: field.open[p[0]] + e[range(4), p].sum() + sum(move[a, b] for a, b in zip(p, p[1:])))
    assert field.viterbi([words])[0] == [pii.LABELS[k] for k in best]


def test_mask(odd, docs):
    out = {r.doc_id: r for r in pii.mask(odd).collect()}
    assert out[13].text == "mail [EMAIL], [IP], [CARD] or [PHONE]!" and out[13].n_chars == len(out[13].text)
    clean = {r.doc_id: r.text for r in docs.collect() if not re.search(r"[0-9@]", r.text or "")}
    new = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    assert all(new[i] == x for i, x in clean.items())


# --- classifiers ------------------------------------------------------------------------------


def test_quality(spark, odd, empty):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.score(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95
    assert all(got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id])
    few = quality.score(odd, labels).collect()
    assert len(few) == odd.count() and all(0 <= r.score <= 1 for r in few)
    assert {r.score for r in quality.score(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.score(empty, labels).count() == 0
    kept = quality.keep(odd, labels)
    assert kept.columns == odd.columns
    # labels of the held-out fold do not matter
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert collected(quality.score(docs, flipped)) == collected(quality.score(docs, labels))


def test_quality_features_by_brute_force(docs):
    texts = [r.text for r in docs.limit(12).collect()] + ["", None, "a", "One, TWO 33 four!! four", "x" * 40]
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=quality.INDEX.shape).astype(np.float32)
    got = quality.pooled(quality.Tokens(), texts, vectors)
    for text, row in zip(texts, got):
        words = re.findall(r"\w+|[^\w\s]+", text or "")
        at = [zlib.crc32(w.lower().encode()) % quality.BUCKETS for w in words]
        forms = [quality.form(w) for w in words]
        for k in range(1, len(words)):
            if at[k] == at[k - 1] and quality.FORMS[forms[k]] not in ("mark", "marks"):
                forms[k] = quality.FORMS.index("repeat")
        n = max(1, len(words))
        want = np.zeros(quality.WIDTH)
        for a, f in zip(at, forms):
            want[: quality.DIMS] += vectors[a] / n
            want[quality.DIMS : 2 * quality.DIMS] += quality.FORM_INDEX[f] / n
        want[-2:] = np.log1p(len(words)) / 5, not words
        assert np.allclose(row, want, atol=1e-4)


def test_word_vectors_by_brute_force(spark):
    texts = ["one two three two", "", None, "two, one"]
    want = np.zeros((quality.BUCKETS, quality.DIMS))
    for text in texts:
        at = [zlib.crc32(w.encode()) % quality.BUCKETS for w in re.findall(r"\w+|[^\w\s]+", text or "")]
        for i, a in enumerate(at):
            for j, b in enumerate(at):
                if 0 < abs(i - j) <= quality.REACH:
                    want[a] += quality.INDEX[b]
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    got = quality.word_vectors(spark.createDataFrame([(x,) for x in texts], "text string"))
    assert np.allclose(got, quality.INDEX / 2 + want, atol=1e-5)


def test_quality_network_by_brute_force():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, quality.WIDTH))
    net = quality.Network(x, (x[:, 0] + x[:, 1] > 0).astype(float))
    got = net(x[:20])
    for row, p in zip((x[:20] - net.mean) / net.std, got):
        h = [np.tanh(sum(row[i] * net.p[0][i, j] for i in range(quality.WIDTH)) + net.p[1][j]) for j in range(quality.HIDDEN)]
        z = (sum(a * b for a, b in zip(h, net.p[2])) + net.p[3][0]) * net.scale
        assert p == pytest.approx(1 / (1 + np.exp(-z)))
    assert np.mean((net(x) > 0.5) == (x[:, 0] + x[:, 1] > 0)) > 0.9


def test_word_vectors_count_texts_outside_the_sample(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE", 50)
    docs = spark.createDataFrame([(k, f"word{k} beside other{k}") for k in range(400)], "doc_id long, text string")
    vectors, _ = quality.fit(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality"))
    used = sorted({int(b) for b in quality.Tokens()([r.text for r in docs.collect()])[0]})
    assert np.abs(vectors[used] - quality.INDEX[used] / 2).max(axis=1).min() > 0


def test_language(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predict(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.95
    out = langid.predict(odd).collect()
    assert len(out) == odd.count()
    assert all(r.lang_pred == "und" and r.score == 0 for r in out if r.doc_id in (1, 2, 3))
    assert {r.lang_pred for r in langid.predict(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.predict(empty).count() == 0


def test_language_pooling_by_brute_force():
    """Probabilities of every byte, segment by segment, and their mean."""
    net = langid.Network(["a", "b", "c"])
    texts = ["", None, "short", "é" * 40 + "z" * 91, "words " * 100]
    got = net.pool(texts)
    for text, p in zip(texts, got):
        raw = (text or "").encode()
        total = np.zeros(3)
        for at in range(0, len(raw), langid.SEGMENT):
            end = min(len(raw), at + langid.SEGMENT)
            column = [raw[k] if 0 <= k < min(len(raw), end + langid.LEAD) else langid.PAD for k in range(at - langid.LEAD, at + langid.SEGMENT + langid.LEAD)]
            q = net.positions(np.array(column, np.int16)[:, None])
            total += q[langid.LEAD : langid.LEAD + end - at, :, 0].sum(axis=0)
        assert np.allclose(p, total / max(1, len(raw)), atol=1e-4)


def test_languages_with_equal_probability(spark):
    net = langid.Network(["x", "a"])
    net.p = {k: np.zeros_like(v) for k, v in net.p.items()}
    assert net.pool(["abc"])[0].tolist() == pytest.approx([0.5, 0.5]) and net.pool(["abc"]).argmax() == 0


def test_language_gradient():
    net = langid.Network(["a", "b"])
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 257, (7, 5)).astype(np.int16), np.array([0, 1, 0, 1, 1])

    def loss():
        p = net.positions(x)
        live = x != langid.PAD
        return -(np.log(p[:, y, np.arange(5)]) * live).sum() / live.sum()

    g = net.gradient(x, y)
    for name in ("fu", "bu", "o", "c"):
        for at in [(0, 0), (1, 0)] if name == "c" else [(0, 1), (1, 3)]:
            old = net.p[name][at]
            net.p[name][at] = old + 1e-2
            up = loss()
            net.p[name][at] = old - 1e-2
            down = loss()
            net.p[name][at] = old
            assert abs((up - down) / 2e-2 - g[name][at]) < 2e-3, name


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, SF)
        assert out.columns == columns, k
        before, docs = docs.count(), spark.createDataFrame(out.collect(), out.schema)
        assert docs.count() <= before
    packed_ok(corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    total = lambda d: {r[0]: r[1] for r in d.groupBy("doc_id").agg(F.sum("length")).collect()}
    assert total(corpus_pipeline.run(spark, SF)) == total(packing.pack(docs, JSON))


def test_pipeline_on_awkward_rows(spark, odd, empty, tmp_path):
    """Nulls, empty and long texts, repeated rows and ids, clashing columns, and no rows at all."""
    import corpus_pipeline

    for source in (odd, empty, odd.withColumn("n_chars", F.col("n_chars").cast("int"))):
        docs, schema = source, source.schema
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{id(source)}-{k}")
            stage(spark, docs, SF).write.parquet(path)
            out = spark.read.parquet(path)
            if k < 4:
                assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in schema]
                assert out.count() <= docs.count()
                docs = out
        assert out.select("doc_id", "start").distinct().count() <= out.count() and (out.count() >= docs.count())
        assert out.agg(F.count_distinct(F.struct("sequence_id", "offset"))).first()[0] == out.count()
    changed = {r.doc_id: r for r in corpus_pipeline.STAGES[3][1](spark, odd, SF).collect()}
    assert changed[13].n_chars == len(changed[13].text) and changed[3].text is None


def test_pipeline_leaves_no_tables_behind(spark):
    import corpus_pipeline
    from gridfront.llm import common

    before = set(common._STANDING)
    out = corpus_pipeline.run(spark, SF)
    left = set(common._STANDING) - before
    assert len(left) == 1 and out.count() > 0


def test_query_names():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries()] == list(range(1, 11))
