"""Guidance, risk-factor counts and the signal record of a document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import text as X
from quarry.operators import segment as S

# fixed values: cues, headings, words left out of titles
RISK_CUE = r"(?iU)\b(?:risk\w*|advers\w*|could|may|uncertain\w*|depend\w*|rely|reliance|harm\w*|expos\w*|fail\w*|litigation|subject to|ability|competition|impact\w*|affect\w*|challeng\w*|vulnerab\w*|threat\w*|disrupt\w*|fluctuat\w*|declin\w*|loss\w*|unable|inability)\b"
RISK_HEADING = r"(?imd)^(?=.{15,160}$)[A-Z][^!?\n]*?(?:risk|adversely|could|may|uncertain|depend|harm|expose|fail|litigation)[^!?\n]*?\.?$"
INLINE = r"^([^.!?]{3,40}\.)\s+\S"
GLUED = r"(?<=[a-z’)])\s+(?=(?:The|Our|We|There|Changes|Legislation|Increasing|In|[A-Z][a-z]{3,}(?:[’']s)?)\b)"
TITLE_STOP = "a an and as at by for from in into of on or our the to with we us is are may could not".split()


def agree(ours: Column, theirs: Column) -> Column:
    """Every number of ours is among theirs (or we have none)."""
    return F.size(F.array_except(ours, theirs)) == 0


def risk_counts(docs: DataFrame, cue: str = RISK_CUE) -> DataFrame:
    """(doc_id, structural, title, inline, glued, line, n_risks) of (doc_id, text).

    Paragraphs are one array a row; what needs the next paragraph reads the array by place, so
    there is no shuffle. The cascade takes the first count that is plainly the document's layout.
    """
    para = F.filter(F.transform(F.split("text", r"\n\s*\n"), lambda p: X.strip(F.regexp_replace(p, r"\s+", " "))), lambda p: p != "")
    rows = docs.select("doc_id", "text", para.alias("p"))
    p = F.col("p")

    def noise(x: Column) -> Column:
        low = F.lower(x)
        return F.contains(low, F.lit("form 10-k")) | F.contains(low, F.lit("table of contents")) | low.startswith("item 1b") | low.startswith("risk factor summary") | x.rlike(r"^[\d\s|]+$")

    def content(x: Column) -> Column:
        return F.filter(F.regexp_extract_all(x, F.lit("[A-Za-z][A-Za-z’'-]*"), F.lit(0)), lambda w: ~F.lower(w).isin(*TITLE_STOP))

    def titled(x: Column) -> Column:
        words = content(x)
        return (F.size(words) >= 2) & (F.size(F.filter(words, lambda w: w.rlike("^[A-Z]"))) >= 0.8 * F.size(words))

    follows = lambda i, least: F.coalesce(F.length(F.get(p, i + 1)) >= least, F.lit(False))
    among = lambda x, low, high: (F.length(x) >= low) & (F.length(x) <= high)
    # tests in the order of their cost: lengths first, the cue last
    structural = F.size(F.filter(p, lambda x, i: among(x, 40, 280) & follows(i, 250) & ~noise(x) & x.rlike(cue)))
    title = F.size(F.filter(p, lambda x, i: among(x, 20, 160) & follows(i, 150) & ~noise(x) & titled(x)))
    few = lambda h: F.size(F.filter(F.split(F.regexp_replace(h, r"\.$", ""), r"\s+"), lambda w: w != "")) <= 5
    heads = F.transform(p, lambda x: F.regexp_extract(x, INLINE, 1))  # of every paragraph, once
    inline = F.size(F.filter(heads, lambda h: (h != "") & few(h) & ~F.lower(h).startswith("item ") & ~F.lower(h).startswith("the oil, gas")))

    def glued(x: Column) -> Column:
        """Some boundary has a prefix of 30 characters or more with a cue."""
        pieces = F.split(F.substring(x, 1, 165), GLUED)
        heads = F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda _, i: F.array_join(F.slice(pieces, 1, i + 1), " "))
        return F.exists(heads, lambda h: (F.length(h) >= 30) & h.rlike(cue))

    line = F.size(F.regexp_extract_all("text", F.lit(RISK_HEADING), F.lit(0)))
    contents = F.size(F.split(F.lower("text"), "table of contents", -1)) - 1
    counts = rows.select("doc_id", F.size(p).alias("n"), structural.alias("structural"), title.alias("title"), inline.alias("inline"), F.size(F.filter(p, glued)).alias("glued"), line.alias("line"), contents.alias("contents"))
    blended = F.bround((F.col("structural") + F.col("line")) / 2).cast("int")
    small = F.col("n") < 60
    chosen = F.when(F.col("n") == 0, 0).when(F.col("title") >= 15, F.col("title")).when(small & (F.col("inline") >= 10), F.col("inline")).when(small & (F.col("glued") >= 8), F.col("glued"))
    chosen = chosen.when((F.col("contents") >= 8) & (F.col("structural") > 0), blended).when(F.col("structural") > 0, F.col("structural")).otherwise(F.col("line"))
    return counts.withColumn("n_risks", chosen).drop("contents")


def section_text(parts: DataFrame, docs: DataFrame, items: list[str], name: str) -> DataFrame:
    """(doc_id, name): the items' sections in document order, or the whole text without any."""
    chosen = parts.where(F.col("item").isin(*items)).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias(name))
    return docs.select("doc_id", F.col("text").alias("whole")).join(chosen, "doc_id", "left").select("doc_id", F.coalesce(F.when(F.col(name) != "", F.col(name)), F.col("whole")).alias(name))


#: A model sees so many characters of the discussion.
SEEN = 12_000


def found_numbers(strings: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(strings, lambda s: F.regexp_extract_all(s, F.lit(r"\d[\d,.]*"), F.lit(0)))))


def signals(docs: DataFrame, model: Callable[[Column], Column] | None = None) -> DataFrame:
    """The signal record of filings (doc_id, form, text), by rules and lexicon.

    `model` gives a model's reply for a text column. A valid reply (see validated_guidance) takes the place of the rules' guidance; the record then
    says whether all numbers the rules found are among the model's, which is null where the rules stand alone.
    """
    parts = S.sections(docs)
    mdna, risk = section_text(parts, docs, ["7", "2"], "mdna"), section_text(parts, docs, ["1A"], "risk")
    counts = risk_counts(risk.withColumnRenamed("risk", "text")).select("doc_id", F.col("n_risks").alias("risk_factor_count"))
    rules = F.struct(X.guidance(F.col("mdna")).alias("revenue_guidance"), X.guidance(F.col("mdna"), X.CAPEX_GUIDANCE).alias("capex_guidance"))
    reply = F.lit(None).cast("string") if model is None else model(F.substring("mdna", 1, SEEN))
    record = mdna.select("doc_id", rules.alias("rules"), X.validated_guidance(reply).alias("told"), X.lexicon(F.col("mdna")).alias("lexicon"))
    ours, theirs = (F.concat(F.col(f"{s}.revenue_guidance"), F.col(f"{s}.capex_guidance")) for s in ("rules", "told"))
    modelled = F.col("told").isNotNull()
    pick = lambda name: F.when(modelled, F.col(f"told.{name}")).otherwise(F.col(f"rules.{name}")).alias(name)
    out = record.select(
        "doc_id", pick("revenue_guidance"), pick("capex_guidance"), F.round("lexicon.score", 4).alias("sentiment_score"), F.col("lexicon.backend").alias("backend"),
        F.when(modelled, "llm+regex-xcheck").otherwise("regex").alias("method"), F.when(modelled, agree(found_numbers(ours), found_numbers(theirs))).alias("xcheck_agree"),
    )
    return out.join(counts, "doc_id")
