"""URL filter in column expressions only: rules first, then logistic regression on hashed n-grams.

The model's features are character trigrams of host and path between marks, each hashed into ``DIMS``
buckets and counted. It is trained on a small labelled table of URLs: at most ``LABELLED`` rows of
bucket lists come to the driver, and gradient descent fits one weight a bucket. Weights are whole
millionths, so sums are exact in any order. Scoring sums the weights of a URL's trigrams inside one
column expression, so judging is a narrow projection of the scan: no shuffle, no Python on the executors.

Rules are a literal map from host to its paths; a url looks up each suffix of its host, so the work
does not grow with the rules. The longest rule wins; of equally long ones the one with the longer
host, then the first by host, path and verdict.

Cases: a null url, or one without ``://``, has empty host and path; no rule fits an empty host, so
the model judges its empty host and path; a null ``page_id`` is carried; repeated rows are judged once
each; an empty table gives no rows; urls of any length are taken whole; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIMS = 4096
#: Most rows of a labelled table.
LABELLED = 4_000
#: Weights are multiples of one over this.
UNIT = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Marks around host and path, and the factors of a trigram's three code points and of its mark in the hash.
MARKS, FACTORS = ("^", "$"), (2_617, 131, 31, 7_919)

#: Words of the small labelled table. A url is to be blocked if a word of the first list is in
#: its host or path; the others stand in urls of both kinds.
BLOCKED = "casino poker slots jackpot bets betting gambling lottery pills viagra pharmacy steroids adult xxx porn nude escort webcam spam malware phishing warez cracked keygen torrent payday loans replica counterfeit clickbait adclick".split()
NEUTRAL = "news sports weather library museum recipes garden travel school science health history music photos shop forum docs support archive city farm cheap win best free daily world home book river food art club market".split()
DOMAINS = "example.com example.org example.net acme.com town.org home.net media.info shop.biz site.top page.xyz".split()
PREFIXES = ("", "www.", "m.", "blog.")
PATHS = ("", "/", "/en/{n}", "/de/{n}.html", "/fr/{n}/", "/{w}", "/{w}/{n}.html", "/{w}/{v}?page={n}", "/about/{w}.html", "/articles/{n}/{w}-{v}")


def labelled_rows(rows: int = 4_000, seed: int = 17) -> list[tuple[str, int]]:
    """The built-in labelled table, (url, blocked), drawn by a rule: prefixes, words, domains and paths are crossed at random."""
    r = random.Random(seed)
    made = lambda: "".join(r.choice("bcdfghklmnprstvw") + r.choice("aeiou") + r.choice(["", "n", "r", "s", "th"]) for _ in range(r.randint(1, 3)))
    plain = lambda: r.choice(NEUTRAL) if r.random() < 0.5 else "".join(r.choice(("th", "er", "on", "an", "st", "sh", "ti", "en", "in", "re", "ha", "nt", "ing", "ou", "le", "wh", "ra", "is")) for _ in range(r.randint(2, 4))) if r.random() < 0.4 else made()
    out = []
    for k in range(rows):
        bad = k % 2
        word = r.choice(BLOCKED)
        where = r.choice(("host", "host", "path")) if bad else ""
        label = (word if where == "host" else plain(),)
        if r.random() < 0.5:
            label = (*label, plain()) if r.random() < 0.5 else (plain(), *label)
        domain = r.choice(DOMAINS) if r.random() < 0.6 else f"{plain()}{r.choice(('', '-'))}{plain()}.{r.choice(('com', 'org', 'net', 'io', 'biz'))}"
        bare = where != "host" and r.random() < 0.2
        host = r.choice(PREFIXES) + ("" if bare else r.choice(("-", "", "-")).join(label) + ".") + domain
        path = r.choice(PATHS[5:] if where == "path" else PATHS)
        path = path.format(n=r.randint(1, 9_999), w=word if where == "path" else plain(), v=plain())
        out.append((f"{r.choice(('http', 'https'))}://{host}{path}", bad))
    return out


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (ASCII letters lowered) and path of a url; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(url)), r"(?s)^[^?#]*", 0)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def buckets(host: Column, path: Column) -> Column:
    """Hashed trigrams of host and path, each between marks; occurrences repeat."""

    def grams(text: Column, mark: str) -> Column:
        s = F.concat(F.lit(mark * 2), text, F.lit(mark))
        code = lambda i: F.ascii(F.substring(s, i, F.lit(1))).cast("long")
        return F.transform(F.sequence(F.lit(1), F.length(s) - 2), lambda i: ((code(i) * FACTORS[0] + code(i + 1) * FACTORS[1] + code(i + 2) * FACTORS[2] + ord(mark) * FACTORS[3]) % DIMS).cast("int"))

    return F.concat(*(grams(c, m) for c, m in zip((host, path), MARKS)))


def fitted(rows: list[tuple[list[int], float]], rounds: int = 400, rate: float = 0.5, penalty: float = 2e-4) -> list[int]:
    """Weights by bucket and, last, the intercept, in whole units of ``1 / UNIT``; zero without rows."""
    w = np.zeros(DIMS + 1)
    if rows:
        rows = sorted(rows)
        lens = np.array([len(b) + 1 for b, _ in rows])
        flat = np.concatenate([[*b, DIMS] for b, _ in rows]).astype(np.int64)
        owner, y = np.repeat(np.arange(len(rows)), lens), np.array([y for _, y in rows])
        square = np.full(DIMS + 1, 1e-8)
        for _ in range(rounds):
            z = np.bincount(owner, w[flat], len(rows))
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(rows)
            g = np.bincount(flat, d[owner], DIMS + 1) + penalty * np.append(w[:-1], 0.0)
            square += g * g
            w -= rate * g / np.sqrt(square)
    return [round(x * UNIT) for x in w.tolist()]


def train(labelled: DataFrame) -> list[int]:
    """The weights of ``(url, blocked)``; null rows are left out."""
    host, path = host_and_path(F.col("url"))
    rows = labelled.filter("url is not null and blocked is not null").select(buckets(host, path).alias("b"), F.col("blocked").cast("double").alias("y"))
    got = [(r.b, r.y) for r in rows.limit(LABELLED + 1).collect()]
    if len(got) > LABELLED:
        raise ValueError(f"the labelled table is to have at most {LABELLED} rows")
    return fitted(got)


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The built-in labelled table as rows of literals."""
    rows = ", ".join(f"('{u}', {y})" for u, y in labelled_rows())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(url, blocked)")


def score(host: Column, path: Column, weights: list[int]) -> Column:
    """The sum of the weights of the url's trigrams and the intercept, a whole number."""
    table = F.lit([int(x) for x in weights[:DIMS]]).cast("array<bigint>")
    return F.aggregate(buckets(host, path), F.lit(weights[DIMS]).cast("long"), lambda a, k: a + F.element_at(table, k + 1))


def best_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest of ``(verdict, host, path)`` that fits, as a struct with ``h``, ``p`` and ``verdict``; null if none does."""
    by: dict[str, list] = {}
    for v, h, p in rules:
        by.setdefault(h, []).append((p, v))
    if not by:
        return F.lit(None).cast("struct<h:string,p:string,verdict:string>")
    one = lambda h, p, v: F.struct(F.lit(-len(h + p)).alias("size"), F.lit(-len(h)).alias("own"), F.lit(h).alias("h"), F.lit(p).alias("p"), F.lit(v).alias("verdict"))
    table = F.create_map(*[x for h, found in by.items() for x in (F.lit(h), F.array(*[one(h, p, v) for p, v in found]))])
    parts = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    found = F.flatten(F.array_compact(F.transform(suffixes, lambda s: F.try_element_at(table, s))))
    return F.array_min(F.filter(found, lambda r: F.startswith(path, r.p)))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], weights: list[int], threshold: float = 0.5) -> DataFrame:
    """``(page_id, host, path, rule, verdict, blocked_probability)`` of every url."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.select("*", best_rule(F.col("host"), F.col("path"), rules).alias("best"), score(F.col("host"), F.col("path"), weights).alias("score"))
    chance = F.round(1 / (1 + F.exp(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), -F.col("score") / UNIT)))), 6)
    rows = rows.select("page_id", "host", "path", "best", chance.alias("blocked_probability"))
    verdict = F.coalesce(F.col("best.verdict"), F.when(F.col("blocked_probability") >= threshold, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", F.concat("best.h", "best.p").alias("rule"), verdict.alias("verdict"), "blocked_probability")


def bucket_list(url: str) -> list[int]:
    """The buckets of a url with ``://``, in plain Python; equal to the column expression's."""
    rest = url.split("://", 1)[1]
    host = rest[: min([k for c in "/?#" if (k := rest.find(c)) >= 0], default=len(rest))]
    path = rest[len(host) :]
    path = path[: min([k for c in "?#" if (k := path.find(c)) >= 0], default=len(path))]
    host = host.translate(str.maketrans(UPPER, LOWER))
    out = []
    for text, mark in zip((host, path), MARKS):
        c = [ord(x) for x in mark * 2 + text + mark]
        out += [(a * FACTORS[0] + b * FACTORS[1] + d * FACTORS[2] + ord(mark) * FACTORS[3]) % DIMS for a, b, d in zip(c, c[1:], c[2:])]
    return out


@lru_cache(1)
def built_in_weights() -> list[int]:
    """The weights of the built-in table."""
    return fitted([(bucket_list(u), float(y)) for u, y in labelled_rows()])


def judge_sql(rules: list[tuple[str, str, str]]) -> str:
    """DuckDB SQL with the rows of ``judge`` over ``pages``, by the built-in table."""
    w = built_in_weights()
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1:], r[0]))
    fits = [f"WHEN (host = {quoted(h)} OR ends_with(host, {quoted('.' + h)})) AND starts_with(path, {quoted(p)}) THEN {{'rule': {quoted(h + p)}, 'verdict': {quoted(v)}}}" for v, h, p in ordered]
    best = f"CASE {' '.join(fits)} END" if fits else "CAST(NULL AS STRUCT(rule VARCHAR, verdict VARCHAR))"
    gram = lambda s, mark: f"list_transform(range(1, length({s}) - 1), lambda i: (unicode({s}[i]) * {FACTORS[0]} + unicode({s}[i + 1]) * {FACTORS[1]} + unicode({s}[i + 2]) * {FACTORS[2]} + {ord(mark) * FACTORS[3]}) % {DIMS})"
    return f"""WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
 h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM r),
 u AS (SELECT page_id, translate(coalesce(raw, ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path FROM h),
 g AS (SELECT *, '{MARKS[0] * 2}' || host || '{MARKS[0]}' AS hs, '{MARKS[1] * 2}' || path || '{MARKS[1]}' AS ps FROM u),
 s AS (SELECT *, {best} AS best, {w[DIMS]} + list_sum(list_transform(list_concat({gram('hs', MARKS[0])}, {gram('ps', MARKS[1])}), lambda k: ({w[:DIMS]})[k + 1])) AS score FROM g),
 p AS (SELECT *, round(1 / (1 + exp(greatest(-30, least(30, -score / {UNIT}e0)))), 6) AS blocked_probability FROM s)
 SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, CASE WHEN blocked_probability >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict, blocked_probability FROM p"""
