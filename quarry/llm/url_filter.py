"""URL filters: host and path rules, and a logistic regression on hashed character n-grams for the rest.

All in DataFrame functions; the regression is fitted on the driver from a small labelled table (at most LABELLED
rows, those whose urls hash lowest with a seed) by plain gradient steps over the rows' lists of n-grams, and its weights are one array of DIM numbers.
The labelled table that comes with it is generated from words of unwanted and of ordinary sites and random names with a fixed seed; another can be given.

An n-gram's bucket is a polynomial of its code points modulo the prime DIM, so SQL engines without a common hash give the same buckets.

A null url, or one without ://, has empty host and path, fits no rule and is judged on no n-grams: allowed, as the bias is below zero. The longest
fitting rule wins; equally long ones: block. A probability of exactly one half blocks. Repeated rows are judged one by one, an empty table gives
none; urls of any length are read whole; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import let, table

DIM = 8191
_STEP = 7919
GRAMS = (3, 4)
LABELLED = 10_000
SEED = 7
# fixed values: the rules, as verdict and host and path
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
# fixed values: words of unwanted and of ordinary sites
_UNWANTED = (
    "casino poker slots jackpot roulette betting bets gamble lottery winner bonus pills pharmacy viagra dietpill adult porn xxx cams escort dating "
    "ads adserver advert banner popup popunder tracker tracking clicks clickbait spam linkfarm malware phishing warez torrent cracked keygen payday loans replica"
).split()
_AROUND = "best top online free cheap win hot fast buy get my easy super pro 24 365 365x world club".split()
_ORDINARY = (
    "news docs blog library wiki museum university school science history garden kitchen recipes weather travel music theatre cinema books journal gazette "
    "bibliothek schule zeitung rathaus verein revista escuela noticias ciudad universidad bibliotheque journal ecole mairie musee forum project open software research health care "
    "city council parliament court archive radio sport football chess photo art design studio farm market bank post railway airport hotel bridge river forest"
).split()
_PAGES = ("index.html", "about", "contact", "2021/05/report", "articles/12", "docs/guide", "archive/1999", "en/topics/7", "de/seite/3", "fr/page/9", "es/tema/2", "feed", "a/b/c.html", "")
_BAD_PAGES = ("click", "banner/728x90", "track/pixel.gif", "win-now/bonus", "ad/slot/4", "popup/promo", "slots/free-spins", "adult/cams", "casino/bonus", "pills/order")


def labelled_urls(size: int = 3000, seed: int = SEED) -> list[tuple[str, str, int]]:
    """The small labelled table as (host, path, label); 1 is block."""
    r = random.Random(seed)
    tops, heads = ("com", "org", "net", "info", "de", "fr", "es"), ("", "", "www.", "m.", "blog.", "shop.")
    syllable = lambda: r.choice("bcdfghjklmnprstvwz") + r.choice(("", "r", "l", "h")) + r.choice("aeiou") + r.choice(("", "", "n", "r", "s", "th", "ng"))
    out = []
    for i in range(size):
        bad = i % 3 == 0
        if bad:
            parts = [r.choice(_UNWANTED), *r.sample(_AROUND + _UNWANTED, r.randint(0, 1))]
        elif i % 3 == 1:
            parts = ["".join(syllable() for _ in range(r.randint(1, 4)))]
        else:
            parts = [r.choice(_ORDINARY), *(["".join(syllable() for _ in range(2))] if r.random() < 0.5 else r.sample(_ORDINARY, r.randint(0, 1)))]
        r.shuffle(parts)
        name = r.choice(("-", "-", "", ".")).join(parts)
        page = r.choice(_BAD_PAGES if bad and r.random() < 0.4 else _PAGES) + r.choice(("", "", f"/{r.randint(1, 9999)}", f"{r.randint(1, 9999)}.html"))
        out.append((f"{r.choice(heads)}{name}.{r.choice(('', 'example.'))}{r.choice(tops)}", f"/{page}", int(bad)))
    return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits; null if none does."""
    name = verdict = None
    for kind, rule in sorted(rules, key=lambda r: (-len(r[1]), r[0] != "block", r[1])):
        of, slash, rest = rule.partition("/")
        fits = ((host == of) | F.endswith(host, F.lit("." + of))) & F.startswith(path, F.lit(slash + rest))
        name = F.when(fits, rule) if name is None else name.when(fits, rule)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return name, verdict


def features(host: Column, path: Column) -> Column:
    """Buckets of the character n-grams of host and of path; both ends are marked."""
    return F.array_distinct(F.concat(*(_grams(salt, part) for salt, part in ((1, host), (3, path)))))


def _grams(salt: int, part: Column) -> Column:
    codes = F.transform(F.split(F.concat(F.lit("^"), part, F.lit("$")), ""), lambda c: F.ascii(c).cast("long"))

    def hashed(c: Column, k: int, n: int) -> Column:
        def bucket(i: Column) -> Column:
            h = F.lit(salt + k).cast("long")
            for j in range(n):
                h = h * _STEP + F.get(c, i + j)
            return (h % DIM).cast("int")

        return F.when(F.size(c) >= n, F.transform(F.sequence(F.lit(0), F.greatest(F.size(c) - n, F.lit(0))), bucket)).otherwise(F.array().cast("array<int>"))

    grams = let(codes, lambda c: F.concat(*(hashed(c, k, n) for k, n in enumerate(GRAMS))))
    return F.when(F.length(part) > 0, grams).otherwise(F.array().cast("array<int>"))


def _plain_features(host: str, path: str) -> list[int]:
    """The same for the labelled table, on the driver."""
    out = set()
    for salt, part in ((1, host), (3, path)):
        codes = [ord(c) for c in f"^{part}$"] if part else []
        for k, n in enumerate(GRAMS):
            for i in range(len(codes) - n + 1):
                h = salt + k
                for c in codes[i : i + n]:
                    h = h * _STEP + c
                out.add(h % DIM)
    return sorted(out)


def fit(rows: list[tuple[str, str, int]], rounds: int = 300, rate: float = 20.0, shrink: float = 1e-3) -> list[float]:
    """Weights of a logistic regression from (host, path, label); the last one is the bias. Rows are lists of buckets, so memory follows the table."""
    found = [_plain_features(host, path) for host, path, _ in rows]
    at = np.array([b for f in found for b in f], np.int64)
    row = np.repeat(np.arange(len(rows)), [len(f) for f in found])
    value = np.array([len(f) ** -0.5 if f else 0.0 for f in found])[row]
    y = np.array([float(label) for *_, label in rows])
    w, bias = np.zeros(DIM), 0.0
    for _ in range(rounds):
        off = y - 1 / (1 + np.exp(-(np.bincount(row, w[at] * value, len(rows)) + bias)))
        w += rate * np.bincount(at, off[row] * value, DIM) / max(1, len(rows)) - shrink * w
        bias += rate * off.mean() if len(rows) else 0.0
    return [*w.tolist(), float(bias)]


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "label") -> list[float]:
    """Weights from a labelled table (url, label): LABELLED of its rows at most, chosen by a seeded hash."""
    host, path = host_and_path(F.col(f"`{url_col}`").cast("string"))
    rows = labelled.select(host.alias("host"), path.alias("path"), F.col(f"`{label_col}`").cast("int").alias("label"), F.xxhash64(F.lit(SEED), F.col(f"`{url_col}`")).alias("place"))
    picked = rows.where("label is not null").orderBy("place", "host", "path", "label").limit(LABELLED).collect()
    return fit([(r["host"], r["path"], r["label"]) for r in picked])


def judge(pages: DataFrame, weights: list[float], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score (the regression's probability of block)."""
    host, path = host_and_path(F.col(f"`{url_col}`").cast("string"))
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("f", features(F.col("host"), F.col("path")))
    table_ = F.split(F.lit(",".join(f"{v:.9g}" for v in weights[:-1])), ",").cast("array<double>")
    z = F.aggregate("f", F.lit(0.0), lambda s, b: s + F.get(table_, b)) / F.sqrt(F.greatest(F.size("f"), F.lit(1))) + weights[-1]
    score = 1 / (1 + F.exp(-z))
    rule, verdict = matched_rule(F.col("host"), F.col("path"))
    judged = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("v"), score.alias("score"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("v", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")


@lru_cache
def fitted() -> tuple[float, ...]:
    return tuple(fit(labelled_urls()))


def op7(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), list(fitted())).drop("score")


def oracle() -> str:
    """The same in DuckDB SQL, the weights written out."""
    weights = fitted()
    fits = [(kind, rule, *rule.partition("/")[::2]) for kind, rule in sorted(RULES, key=lambda r: (-len(r[1]), r[0] != "block", r[1]))]
    case = lambda what: "CASE " + " ".join(f"WHEN (host = '{of}' OR ends_with(host, '.{of}')) AND starts_with(path, '/{rest}') THEN '{(kind, rule)[what]}'" for kind, rule, of, rest in fits) + " END"

    def grams(salt: int, codes: str) -> str:
        lists = []
        for k, n in enumerate(GRAMS):
            h = str(salt + k) + "::BIGINT"
            for j in range(n):
                h = f"({h} * {_STEP} + {codes}[i + {j}])"
            lists.append(f"[{h} % {DIM} FOR i IN generate_series(1, len({codes}) - {n - 1})]")
        return " || ".join(lists)

    codes = lambda part: f"CASE WHEN {part} = '' THEN [] ELSE [unicode(c)::BIGINT FOR c IN string_split('^' || {part} || '$', '')] END"
    return f"""WITH rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
 parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
 w AS (SELECT [{", ".join(f"{v:.9g}" for v in weights[:-1])}]::DOUBLE[] AS w),
 codes AS (SELECT *, {codes("host")} AS h, {codes("path")} AS p FROM parts),
 f AS (SELECT *, list_distinct({grams(1, "h")} || {grams(3, "p")}) AS f FROM codes),
 z AS (SELECT *, coalesce(list_sum([w[b + 1] FOR b IN f]), 0) / sqrt(greatest(len(f), 1)) + {weights[-1]!r} AS z FROM f, w)
 SELECT page_id, host, path, {case(1)} AS rule, coalesce({case(0)}, CASE WHEN 1 / (1 + exp(-z)) >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict FROM z"""
