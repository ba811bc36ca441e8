"""Quality rules and a hashed n-gram likelihood ratio, in DataFrame functions only.

Words and word pairs are hashed to BUCKETS. Two multinomials are counted, that of all documents and that of trusted
ones (a bounded sample of labelled documents of good quality, TRUSTED at most); a document scores the mean
over its n-grams of log p(trusted) - log p(all), and is kept if that reaches THRESHOLD and the base rules
pass. The threshold is fixed, so equal corpora give equal verdicts.

A null text has no words: all counts are 0, base_failed is true. Repeated rows are judged one by one; extra columns are
ignored; without any trusted document every score is 0. Windows longer than the text don't exist.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import BLANKS, let, table, words_of

BUCKETS = 16_384
#: At most so many labelled documents of good quality are trusted: those whose ids hash lowest.
TRUSTED = 10_000
SMOOTH = 1.0
#: Mean log ratio a document must reach; clean text lies near 0, markup and shouting well below.
THRESHOLD = -0.3
_SYMBOLS = "#*$%&|<>"


def _repeat_words(n: Column, hashes: Column) -> Column:
    """Words in 5-word windows that occur twice or more: sort windows by hash, then cover their places."""
    at = lambda i, j: F.get(hashes, i + j)
    windows = F.when(n >= 5, F.transform(F.sequence(F.lit(0), F.greatest(n - 5, F.lit(0))), lambda i: F.xxhash64(at(i, 0), at(i, 1), at(i, 2), at(i, 3), at(i, 4))))

    def covered(w: Column) -> Column:
        ordered = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(ordered, lambda o: F.filter(o, lambda p, j: p["h"].eqNullSafe(F.get(o, j + 1)["h"]) | ((j > 0) & p["h"].eqNullSafe(F.get(o, F.greatest(j - 1, F.lit(0)))["h"]))))
        places = F.array_sort(F.transform(twice, lambda p: p["i"]))
        start = F.struct(F.lit(-5).alias("last"), F.lit(0).alias("total"))
        step = lambda s, i: F.struct(i.alias("last"), (s["total"] + F.least(F.lit(5), i - s["last"])).alias("total"))
        return F.aggregate(places, start, step, lambda s: s["total"])

    return F.coalesce(let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w))), F.lit(0))


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, and the hashes of all words."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("words", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)))


def _buckets(words: Column) -> Column:
    """Buckets of all words and pairs."""
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    return F.transform(F.concat(words, pairs), lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int"))


def log_ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[float]:
    """log p(trusted) - log p(all) of each bucket; one aggregation over all n-grams, BUCKETS rows to the driver."""
    ids = trusted.select(F.col(id_col).alias("doc_id")).distinct().withColumn("good", F.lit(True))
    flagged = _hashed(docs, id_col, text_col).join(F.broadcast(ids), "doc_id", "left")
    grams = flagged.select("good", F.explode(_buckets(F.col("words"))).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("every"), F.count("good").alias("good")).collect()
    every, good = [0] * BUCKETS, [0] * BUCKETS
    for r in counts:
        every[r["bucket"]], good[r["bucket"]] = r["every"], r["good"]
    if not sum(good):
        return [0.0] * BUCKETS
    shift = math.log(sum(every) + SMOOTH * BUCKETS) - math.log(sum(good) + SMOOTH * BUCKETS)
    return [math.log(g + SMOOTH) - math.log(e + SMOOTH) + shift for g, e in zip(good, every, strict=True)]


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Labelled documents of good quality that aren't toxic, TRUSTED at most."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRUSTED)


def judge(docs: DataFrame, ratios: list[float], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score."""
    table_ = F.split(F.lit(",".join(f"{x:.9g}" for x in ratios)), ",").cast("array<double>")
    rows = _hashed(docs, id_col, text_col)
    text, words, n = F.col("text"), F.col("words"), F.size("words")
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    total = F.aggregate(_buckets(words), F.lit(0.0), lambda s, b: s + F.get(table_, b))
    counted = rows.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(n, words).cast("long").alias("n_repeat_words"),
        F.when(n > 0, total / (2 * n - 1)).otherwise(0.0).alias("score"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("score") >= threshold)).alias("kept"), "score"
    )


def op2(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, log_ratios(docs, trusted_ids(table(spark, sf_dir, "labels"))))
