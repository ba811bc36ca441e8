"""Grounding audit: does every sentence of an answer rest on its sources?"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import text as X
from quarry.operators.retrieval import dot

SUPPORT, PASS = 0.18, 0.8
#: The same limit for vectors.
VECTOR_SUPPORT = 0.62


def conversations(turns: DataFrame) -> DataFrame:
    """Answers (assistant turns) with the turn before as their only source; without a text before, they have none."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns.select("conv_id", "turn", "role", F.col("text").alias("answer"), F.lag("text").over(w).alias("source"))
    return rows.where("role = 'assistant'").select("conv_id", "turn", "answer", F.array_compact(F.array("source")).alias("sources"))


def sentence_audit(answers: DataFrame, embed: Callable[[Column], Column] | None = None, key: tuple[str, ...] = ()) -> DataFrame:
    """A row for each sentence that states something, of answers with sources: support, missing numbers, grounded.

    Candidates are the valid cited sources, or all. Numbers of a sentence that cites must be in
    its candidates, else in any source. Support is the greatest share of common words or, with `embed`, the greatest product of unit vectors: each sentence and each
    source gets its vector once, and a sentence meets the candidates of its own answer only, by the answers' `key`.
    """
    raw = answers.where(F.size("sources") > 0).select("*", F.posexplode(F.split("answer", r"(?<=[.!?])\s+")).alias("pos", "raw"))
    rows = raw.withColumn("cited", X.cited_numbers(F.col("raw"))).withColumn("sentence", X.strip(F.regexp_replace("raw", X.CITE_GROUP, "")))
    words = X.content_tokens(F.col("sentence"))
    meta = F.lit(False)
    for phrase in X.META_PHRASES:
        meta |= F.contains(F.lower("sentence"), F.lit(phrase))
    rows = rows.withColumn("words", words).where((F.col("sentence") != "") & ~meta & (F.size("words") >= 4))
    valid = F.filter("cited", lambda n: (n >= 1) & (n <= F.size("sources")))
    candidates = F.when(F.size(valid) > 0, F.transform(valid, lambda n: F.element_at("sources", n))).otherwise(F.col("sources"))
    rows = rows.withColumn("candidates", candidates)
    support = F.array_max(F.transform("candidates", lambda s: F.size(F.array_intersect(F.col("words"), X.content_tokens(s))) / F.greatest(F.size(F.array_union(F.col("words"), X.content_tokens(s))), F.lit(1))))
    allowed = F.flatten(F.transform(F.when(F.size("cited") > 0, F.col("candidates")).otherwise(F.col("sources")), X.numbers))
    missing = F.filter(X.numbers(F.col("sentence")), lambda n: ~F.array_contains(allowed, n))
    least = SUPPORT if embed is None else VECTOR_SUPPORT
    if embed is None:
        rows = rows.withColumn("support", support)
    else:
        places = F.when(F.size(valid) > 0, valid).otherwise(F.sequence(F.lit(1), F.size("sources")))
        asked = rows.select(*key, "pos", F.explode(places).alias("_at"), embed(F.col("sentence")).alias("_v"))
        given = answers.where(F.size("sources") > 0).select(*key, F.posexplode("sources").alias("_place", "_source")).select(*key, (F.col("_place") + 1).alias("_at"), embed(F.col("_source")).alias("_w"))
        best = asked.join(given, [*key, "_at"]).groupBy(*key, "pos").agg(F.max(dot(F.col("_v"), F.col("_w"))).alias("support"))
        rows = rows.join(best, [*key, "pos"])
    out = rows.withColumn("missing", missing)
    return out.withColumn("grounded", (F.round("support", 9) >= least) & (F.size("missing") == 0))


def verdict(answers: DataFrame, sentences: DataFrame, key: list[str], by: str = "jaccard") -> DataFrame:
    """(key, backend, ratio, n, n_grounded, passed, level) of every answer: without sources it fails with 0.0, else without sentences it passes with 1.0.

    `by` names what support was measured by: "jaccard" or "embeddings".
    """
    rows = answers.select(*key, (F.size("sources") > 0).alias("sourced"), F.lit(None).cast("int").alias("grounded"), F.lit(False).alias("bad"))
    rows = rows.unionByName(sentences.select(*key, F.lit(True).alias("sourced"), F.col("grounded").cast("int").alias("grounded"), (F.size("missing") > 0).alias("bad")))
    sums = F.count("grounded").alias("n"), F.coalesce(F.sum("grounded"), F.lit(0)).alias("n_grounded")
    out = rows.groupBy(*key).agg(F.max("sourced").alias("sourced"), F.avg("grounded").alias("ratio"), F.max("bad").alias("bad"), *sums)
    out = out.withColumn("ratio", F.when(F.col("sourced"), F.coalesce("ratio", F.lit(1.0))).otherwise(0.0))
    level = F.when(F.col("ratio") >= PASS, "high").when(F.col("ratio") >= 0.5, "medium").otherwise("low")
    backend = F.when(~F.col("sourced"), "none").when(F.col("n") == 0, "trivial").otherwise(by)
    return out.select(*key, backend.alias("backend"), "ratio", "n", "n_grounded", ((F.col("ratio") >= PASS) & ~F.col("bad")).alias("passed"), level.alias("level"))


# fixed values: the wording of the report
_HIGH = "Source check: %d/%d statements (%d%%) are supported by the cited passages. Open the sources below to verify."
_MEDIUM = "Source check: %d/%d statements (%d%%) are clearly supported by the cited passages. Please double-check the citations for the rest."
_LOW = "Source check: only %d/%d statements (%d%%) map cleanly onto the cited passages. Treat this answer with caution and verify against the sources below before relying on it."
_SUMMARY = "Hallucination audit %s: %d/%d sentences grounded (%s)"


def report(verdicts: DataFrame) -> DataFrame:
    """The verdicts with a summary line and a notice for readers."""
    counts = F.col("n_grounded"), F.col("n")
    percent = F.bround(F.round("ratio", 3) * 100).cast("int")
    notice = F.when(F.col("level") == "high", F.format_string(_HIGH, *counts, percent)).when(F.col("level") == "medium", F.format_string(_MEDIUM, *counts, percent)).otherwise(F.format_string(_LOW, *counts, percent))
    summary = F.format_string(_SUMMARY, F.when(F.col("passed"), "PASSED").otherwise("FAILED"), *counts, F.col("backend"))
    return verdicts.withColumns({"summary": summary, "notice": notice})


_STOPS = ", ".join(f"'{w}'" for w in X.AUDIT_STOP)
_WORDS = f"list_distinct([w FOR w IN regexp_extract_all(lower({{}}), '[a-z]{{{{3,}}}}') IF w NOT IN ({_STOPS})])"
_NUMBERS = f"[replace(regexp_replace(lower(n), '[\\s,$]', '', 'g'), 'percent', '%') FOR n IN regexp_extract_all({{}}, '{X.NUMBER}')]"
#: In DuckDB, for one source and answers without citations.
ORACLE = rf"""WITH ans AS (SELECT conv_id, turn, text AS answer, source FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS source FROM conversations) WHERE role = 'assistant' AND source IS NOT NULL),
 sen AS (SELECT conv_id, turn, source, i - 1 AS pos, regexp_replace(s[i], '^\s+|\s+$', '', 'g') AS sentence FROM (SELECT *, unnest(generate_series(1, len(s))) AS i FROM (SELECT *, string_split(regexp_replace(answer, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM ans))),
 tok AS (SELECT *, {_WORDS.format("sentence").replace("{{", "{").replace("}}", "}")} AS w, {_WORDS.format("source").replace("{{", "{").replace("}}", "}")} AS sw, {_NUMBERS.format("sentence")} AS nums, {_NUMBERS.format("source")} AS snums FROM sen),
 audit AS (SELECT conv_id, turn, pos, support, missing, round(support, 9) >= 0.18 AND len(missing) = 0 AS grounded FROM (SELECT *, len(list_intersect(w, sw)) / greatest(len(list_distinct(w || sw)), 1) AS support, [n FOR n IN nums IF NOT list_contains(snums, n)] AS missing FROM tok WHERE sentence <> '' AND len(w) >= 4))"""
