"""Differences between consecutive versions of a document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.text import jaccard, paragraphs, token_set
from quarry.operators import partners
from quarry.operators.storage import written

SAME, MINOR, RELATED, SHOWN, MOST = 0.90, 0.65, 0.30, 600, 40
# fixed values: the same limits for vectors, and the share of words below which a match by vectors doesn't count
VECTOR_SAME, VECTOR_MINOR, VECTOR_RELATED, UNRELATED = 0.97, 0.80, 0.45, 0.15

Embed = Callable[[Column], Column]


def pairs(docs: DataFrame, by: list[str], order: str, key: str = "doc_id") -> DataFrame:
    """(old_id, new_id): each document with the next of its group. Transcripts are a form like others here; leave them out beforehand where they don't count."""
    w = Window.partitionBy(*by).orderBy(order, key)
    return docs.select(F.col(key).alias("old_id"), F.lead(key).over(w).alias("new_id")).where("new_id is not null")


def best_matches(pairs_: DataFrame, units: DataFrame, embed: Embed | None = None) -> DataFrame:
    """(old_id, new_id, new_pos, old_pos, score) for every unit of the new side; old_pos is -1 if nothing is shared.

    units: (doc_id, pos, text). Similarity is that of the words' sets or, with `embed`, the product of unit vectors, by which every unit has a match if there is any.
    The first old unit wins ties.
    """
    feature = token_set(F.col("text")) if embed is None else F.transform(embed(F.col("text")), lambda x: x.cast("double"))
    return partners.best_partners(pairs_, units.select("doc_id", "pos", feature.alias("feature")), partners.by_words if embed is None else partners.by_vectors)


def classify(score: Column, overlap: Column | None = None) -> Column:
    """null for what stayed the same. With `overlap`, the share of common words, the score is one of vectors, and a match with hardly a common word is new."""
    if overlap is None:
        return F.when(score >= SAME, None).when(score < RELATED, "new").when(score < MINOR, "substantive").otherwise("minor")
    return F.when(score >= VECTOR_SAME, None).when((score < VECTOR_RELATED) | (overlap < UNRELATED), "new").when(score < VECTOR_MINOR, "substantive").otherwise("minor")


def removed(matches: DataFrame, pairs_: DataFrame, units: DataFrame, least: int = 80) -> DataFrame:
    """(old_id, new_id, old_pos): old units of more than `least` characters that no new unit matched best."""
    every = pairs_.join(units.where(F.length("text") > least).select(F.col("doc_id").alias("old_id"), F.col("pos").alias("old_pos")), "old_id")
    return every.join(matches.select("old_id", "new_id", "old_pos").distinct(), ["old_id", "new_id", "old_pos"], "left_anti")


def diff(pairs_: DataFrame, units: DataFrame, most: int = MOST, least: int = 80) -> DataFrame:
    """(old_id, new_id, place, kind, old_pos, new_pos, similarity): new, then substantive, removed, minor; `most` a pair.

    The matches are written once: both what changed and what was removed are told from them.
    """
    matches = written(best_matches(pairs_, units), "matches")
    kinds = matches.withColumn("kind", classify(F.col("score"))).where("kind is not null").select("old_id", "new_id", "kind", "old_pos", "new_pos", F.round("score", 3).alias("similarity"))
    gone = removed(matches, pairs_, units, least).select("old_id", "new_id", F.lit("removed").alias("kind"), "old_pos", F.lit(-1).alias("new_pos"), F.lit(0.0).alias("similarity"))
    rank = F.when(F.col("kind") == "new", 0).when(F.col("kind") == "substantive", 1).when(F.col("kind") == "removed", 2).otherwise(3)
    order = Window.partitionBy("old_id", "new_id").orderBy(rank, "new_pos", "old_pos")
    return kinds.unionByName(gone).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def by_section(pairs_: DataFrame, sections: DataFrame, most: int = MOST, shown: int = SHOWN, least: int = 80, embed: Embed | None = None) -> DataFrame:
    """(old_id, new_id, place, kind, item, similarity, old_text, new_text) of documents' sections (doc_id, pos, item, text).

    Each section of the new document is held against the old one's section of the same item, the last one where items repeat, paragraph by
    paragraph. Items only the old document has are removed paragraphs; a section only the new one has is one row. New, then
    substantive, removed, minor; within a kind removed items first, then the new document's order; `most` rows a pair. Texts are cut at `shown`.
    With `embed` paragraphs are matched by their vectors; a section without paragraphs then counts as an empty one.
    """
    key = ["old_id", "new_id"]
    olds = pairs_.join(sections.select(F.col("doc_id").alias("old_id"), "item", F.col("pos").alias("old_sec"), F.col("text").alias("old_text")), "old_id")
    news = pairs_.join(sections.select(F.col("doc_id").alias("new_id"), "item", F.col("pos").alias("new_sec"), F.col("text").alias("new_text")), "new_id")
    last = olds.groupBy(*key, "item").agg(F.max_by("old_text", "old_sec").alias("old_text"))
    none = F.lit(None).cast("string")

    def rows(df: DataFrame, kind: Column, seq: tuple, score: Column, old: Column, new: Column) -> DataFrame:
        names = [x.cast("int").alias(f"s{i}") for i, x in enumerate(seq)]
        cut = lambda t, name: F.coalesce(F.substring(t, 1, shown), F.lit("")).alias(name)
        return df.select(*key, kind.alias("kind"), "item", score.cast("double").alias("similarity"), cut(old, "old_text"), cut(new, "new_text"), *names)

    para = lambda c: F.posexplode(paragraphs(F.col(c), least))
    gone = olds.join(news.select(*key, "item").distinct(), [*key, "item"], "left_anti").select(*key, "item", "old_sec", para("old_text").alias("p", "t"))
    out = rows(gone, F.lit("removed"), (F.lit(0), F.col("old_sec"), F.lit(0), F.col("p")), F.lit(0.0), F.col("t"), none)
    fresh = news.join(last, [*key, "item"], "left_anti")
    out = out.unionByName(rows(fresh, F.lit("new"), (F.lit(1), F.col("new_sec"), F.lit(0), F.lit(0)), F.lit(0.0), none, F.col("new_text")))

    both = news.join(last, [*key, "item"]).withColumn("met", F.xxhash64(*key, "new_sec"))
    olds_ = paragraphs(F.col("old_text"), least)
    olds_ = olds_ if embed is None else F.when(F.size(olds_) > 0, olds_).otherwise(F.array(F.lit("")))
    at = F.struct(*key, "item", "new_sec").alias("at")
    old_units = both.select("met", at, (F.size(paragraphs(F.col("new_text"), least)) > 0).alias("compared"), F.posexplode(olds_).alias("old_pos", "old_text"))
    new_units = both.select("met", at, para("new_text").alias("new_pos", "new_text"))
    sides = both.select(F.col("met").alias("old_id"), (-F.col("met") - 1).alias("new_id"))
    units = old_units.select(F.col("met").alias("doc_id"), F.col("old_pos").alias("pos"), F.col("old_text").alias("text"))
    units = units.unionByName(new_units.select((-F.col("met") - 1).alias("doc_id"), F.col("new_pos").alias("pos"), F.col("new_text").alias("text")))
    matches = best_matches(sides, units, embed).select(F.col("old_id").alias("met"), "new_pos", "old_pos", F.round("score", 9).alias("score"))
    # one outer join of what matched what with the old paragraphs: a match without a change is of no interest, an old paragraph without a match is removed
    told = matches.join(new_units, ["met", "new_pos"]).join(old_units.withColumnRenamed("at", "old_at"), ["met", "old_pos"], "full")
    told = told.select("*", F.coalesce("at", "old_at").alias("_at")).select("*", F.col("_at.*"))
    overlap = None if embed is None else F.coalesce(jaccard(token_set(F.col("old_text")), token_set(F.col("new_text"))), F.lit(0.0))
    unmet = F.col("new_pos").isNull()
    kind = F.when(unmet, F.when((F.length("old_text") > least) & F.col("compared"), "removed")).otherwise(classify(F.col("score"), overlap))
    told = told.withColumn("kind", kind).where("kind is not null")
    out = out.unionByName(rows(told, F.col("kind"), (F.lit(1), F.col("new_sec"), unmet.cast("int"), F.coalesce("new_pos", "old_pos")), F.coalesce(F.round("score", 3), F.lit(0.0)), F.col("old_text"), F.col("new_text")))
    rank = F.when(F.col("kind") == "new", 0).when(F.col("kind") == "substantive", 1).when(F.col("kind") == "removed", 2).otherwise(3)
    order = Window.partitionBy(*key).orderBy(rank, "s0", "s1", "s2", "s3")
    return out.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select(*key, "place", "kind", "item", "similarity", "old_text", "new_text")


def suppressed(differences: DataFrame) -> DataFrame:
    """(old_id, new_id, shown, suppressed): how many differences are shown and how many minor ones are not."""
    return differences.groupBy("old_id", "new_id").agg(F.count_if(F.col("kind") != "minor").alias("shown"), F.count_if(F.col("kind") == "minor").alias("suppressed"))


def change_count(differences: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, changes): what is new, substantive or removed against the version before; null without one."""
    counts = differences.groupBy(F.col("new_id").alias(key)).agg(F.count_if(F.col("kind") != "minor").alias("changes"))
    return docs.select(key).join(counts, key, "left")
