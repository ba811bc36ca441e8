"""Sections, speaker turns and overlapping chunks of long documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.text import sentences, strip

LEAST_SECTION, LEAST_TURN, CHUNK, OVERLAP = 200, 30, 900, 150
# fixed values: headings, captions with their item by form, speaker grammar
ITEM = r"(?md)^\s*(?:ITEM|Item|I\s?T\s?E\s?M)\s+(\d{1,2}A?B?)\s*[.:–—-]?\s*(.{0,120})$"
CAPTIONS = (
    ("risk factors", "1A", None), ("legal proceedings", "3", None), ("management[’']s discussion and analysis", "7", "2"),
    ("quantitative and qualitative disclosures about market risk", "7A", "3"), ("financial statements and supplementary data", "8", None), ("controls and procedures", "9A", "4"),
)
NAME = r"[A-Z][\w.'’-]*"
PARTICLE = r"(?:de|del|della|der|den|di|da|dos|du|la|le|van|von|ter|ten|te|bin|al|el)"
WHOLE_NAME = rf"{NAME}(?:\s+(?:{PARTICLE}\s+){{0,2}}{NAME})"
SPEAKER = rf"^({WHOLE_NAME}{{0,3}})\s*(?:--|—|–)\s*([A-Z].{{1,80}})$"
SPEAKER_COLON = rf"^({WHOLE_NAME}{{1,3}}|Operator)\s*:\s+(\S.*)$"
OPERATOR = r"(?i)^Operator\s*:?\s*$"
QA_BOUNDARY = r"(?i)^\s*(?:questions?[\s\-]*(?:&|and)?[\s\-]*answer|q\s*&\s*a\b)"
QA_HANDOVER = r"(?i)(?:first question|now begin.{0,30}question|open the (?:line|floor|call).{0,30}question)"


def _matches(docs: DataFrame, pattern: str, groups: int) -> DataFrame:
    """(key columns, g1, g2, end) of every match: ends are running lengths of the pieces between matches and the matches."""
    found = [F.regexp_extract_all("text", F.lit(pattern), F.lit(i)) for i in range(groups + 1)]
    zipped = F.arrays_zip(*[f.alias(f"g{i}") for i, f in enumerate(found)], F.slice(F.split("text", pattern, -1), 1, F.greatest(F.size(found[0]), F.lit(1))).alias("piece"))
    rows = docs.where(F.size(found[0]) > 0).select("doc_id", "form", F.posexplode(zipped).alias("pos", "m")).where("m.g0 is not null")
    so_far = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("m.piece") + F.length("m.g0")).over(so_far)
    return rows.select("doc_id", "form", F.col("m.g1").alias("g1"), (F.col("m.g2") if groups > 1 else F.lit(None).cast("string")).alias("g2"), end.alias("start"))


def sections(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, item, title, text) of filings (doc_id, form, text).

    A body runs to where the next heading ends. Short bodies (contents, cross references) go; of an item's
    bodies the longest stays, the first of equals; items come in the order of their first surviving
    body. A document without any is one section 0.
    """
    trimmed = F.regexp_replace("g2", "^[ .:–—-]+|[ .:–—-]+$", "")
    spans = _matches(docs, ITEM, 2).select("doc_id", F.upper("g1").alias("item"), trimmed.alias("title"), "start", F.lit(0).alias("kind"))
    for i, (caption, annual, quarterly) in enumerate(CAPTIONS):
        item = F.when(F.upper("form") == "10-Q", F.lit(quarterly)).otherwise(F.lit(annual))
        bare = _matches(docs, rf"(?imd)^\s*({caption})\s*:?\s*$", 1).select("doc_id", item.alias("item"), strip(F.col("g1")).alias("title"), "start", F.lit(i + 1).alias("kind"))
        spans = spans.unionByName(bare.where("item is not null"))
    follow = Window.partitionBy("doc_id").orderBy("start", "kind")
    bounded = spans.withColumn("stop", F.lead("start").over(follow)).join(docs.select("doc_id", "text"), "doc_id")
    body = strip(F.substring("text", F.col("start") + 1, F.coalesce("stop", F.length("text")) - F.col("start")))
    bodies = bounded.select("doc_id", "item", "title", "start", "kind", body.alias("body")).where(F.length("body") >= LEAST_SECTION)
    of_item = Window.partitionBy("doc_id", "item")
    best = bodies.withColumn("first", F.min(F.struct("start", "kind")).over(of_item))
    best = best.withColumn("place", F.row_number().over(of_item.orderBy(F.length("body").desc(), "start", "kind"))).where("place = 1")
    found = best.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("first")).alias("pos"), "item", "title", F.col("body").alias("text"))
    whole = docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
    return found.unionByName(whole.select("doc_id", F.lit(1).alias("pos"), F.lit("0").alias("item"), F.lit("Full document").alias("title"), strip(F.col("text")).alias("text")))


def turns(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, item, title, text) of transcripts (doc_id, text): islands of lines between headers.

    A header line names a speaker; a boundary line starts the questions and keeps the speaker. A segment is in
    the questions if a boundary or an operator's hand-over lies at or before its end.
    """
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw")).withColumn("line", strip(F.col("raw")))
    short = F.length("line") < 90
    kind = F.when(short & (F.length("line") < 60) & F.col("line").rlike(QA_BOUNDARY), "boundary").when(short & F.col("line").rlike(SPEAKER), "speaker")
    kind = kind.when(short & F.col("line").rlike(OPERATOR), "operator").when(F.col("line").rlike(SPEAKER_COLON), "colon").otherwise("text")
    rows = lines.withColumn("kind", kind)
    part = lambda pattern, i: F.regexp_extract("line", pattern, i)
    who = F.when(F.col("kind") == "speaker", strip(part(SPEAKER, 1))).when(F.col("kind") == "operator", "Operator").when(F.col("kind") == "colon", strip(part(SPEAKER_COLON, 1)))
    role = F.when(F.col("kind") == "speaker", strip(part(SPEAKER, 2))).when(F.col("kind").isin("operator", "colon"), "")
    said = F.when(F.col("kind") == "colon", part(SPEAKER_COLON, 2)).when(F.col("kind") == "text", F.col("raw"))
    so_far = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("segment", F.sum((F.col("kind") != "text").cast("int")).over(so_far))
    rows = rows.withColumn("who", F.last(who, ignorenulls=True).over(so_far)).withColumn("role", F.last(role, ignorenulls=True).over(so_far)).withColumn("said", said)
    flips = (F.col("kind") == "boundary") | ((F.col("who") == "Operator") & F.col("kind").isin("colon", "text") & F.col("line").rlike(QA_HANDOVER))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("said").isNotNull(), F.struct("pos", "said")))), lambda x: x["said"]), "\n")
    segments = rows.groupBy("doc_id", "segment").agg(F.max("who").alias("who"), F.max("role").alias("role"), F.max(F.coalesce(flips, F.lit(False))).alias("qa"), joined.alias("body"))
    qa = F.max("qa").over(Window.partitionBy("doc_id").orderBy("segment"))
    title = F.when(F.col("role") != "", F.concat("who", F.lit(" ("), "role", F.lit(")"))).otherwise(F.col("who"))
    found = segments.select("doc_id", "segment", F.when(qa, "QA").otherwise("PR").alias("item"), title.alias("title"), strip(F.regexp_replace("body", "\n{3,}", "\n\n")).alias("text"))
    found = found.where((F.length("text") >= LEAST_TURN) & F.col("title").isNotNull())
    found = found.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("segment")).alias("pos"), "item", "title", "text")
    whole = docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
    return found.unionByName(whole.select("doc_id", F.lit(1).alias("pos"), F.lit("0").alias("item"), F.lit("Full transcript").alias("title"), strip(F.col("text")).alias("text")))


def wrapped(units: Column, size: int) -> Column:
    """Units longer than size as pieces of at most size characters: rows of lines where they fit, else cut at blanks; one fold over the lines.

    Lines are gathered as long as they fit. What is longer than size even so is cut by one pattern: up to the last
    blank within size, else at size, blanks at a cut gone; its rest goes on gathering.
    """
    blank = r"(?U)[\s\x1c-\x1f]"
    cut = rf"(?s)(?:\A|\G{blank}*+)(.{{1,{size}}}\z|.{{1,{size - 1}}}(?= )|.{{{size}}})"
    state = "struct<done:array<string>,open:string>"

    def gather(s: Column, line: Column) -> Column:
        both = F.concat_ws("\n", F.nullif(s["open"], F.lit("")), line)
        fits = (F.length(both) <= size) | (s["open"] == "")
        done = F.when(fits, s["done"]).otherwise(F.array_append(s["done"], s["open"]))
        return settle(F.struct(done.alias("done"), F.when(fits, both).otherwise(line).alias("open")))

    def settle(s: Column) -> Column:
        long = F.transform(F.array(s), lambda x: F.struct(x.alias("s"), F.regexp_extract_all(x["open"], F.lit(cut), F.lit(1)).alias("p"))).getItem(0)

        def split(x: Column) -> Column:
            last = F.element_at(x["p"], -1)
            rest = F.when(F.endswith(x["s"]["open"], last), last).otherwise("")  # else blanks were the rest
            whole = F.filter(F.concat(x["p"], F.array(F.lit(None).cast("string"))), lambda p, i: p.isNotNull() & (i < F.size(x["p"]) - (rest != "").cast("int")))
            return F.struct(F.concat(x["s"]["done"], whole).alias("done"), rest.alias("open"))

        return F.when(F.length(s["open"]) > size, F.transform(F.array(long), split).getItem(0)).otherwise(s)

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open")).cast(state)
    finish = lambda s: F.concat(s["done"], F.filter(F.array(s["open"]), lambda x: x != ""))
    pieces = lambda u: F.aggregate(F.split(u, "\n", -1), start, gather, finish)
    long = F.exists(units, lambda u: F.length(u) > size)
    return F.when(long, F.flatten(F.transform(units, lambda u: F.when(F.length(u) > size, pieces(u)).otherwise(F.array(u))))).otherwise(units)


def packed(units: Column, size: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """Units joined to chunks of about size characters; whole trailing units of at most overlap characters begin the next."""
    state = "struct<chunks:array<string>,cur:array<string>,len:int>"
    start = F.struct(F.array().cast("array<string>").alias("chunks"), F.array().cast("array<string>").alias("cur"), F.lit(0).alias("len")).cast(state)

    def tail(cur: Column) -> Column:
        step = lambda s, u: F.when(s["open"] & (s["n"] + F.length(u) <= overlap), F.struct(F.concat(F.array(u), s["kept"]).alias("kept"), (s["n"] + F.length(u) + 1).alias("n"), F.lit(True).alias("open"))).otherwise(F.struct(s["kept"].alias("kept"), s["n"].alias("n"), F.lit(False).alias("open")))
        return F.aggregate(F.reverse(cur), F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("n"), F.lit(True).alias("open")), step)

    def add(s: Column, u: Column) -> Column:
        full = (s["len"] + F.length(u) + 1 > size) & (F.size(s["cur"]) > 0)
        kept = tail(s["cur"])
        flushed = F.struct(F.concat(s["chunks"], F.array(F.array_join(s["cur"], " "))).alias("chunks"), F.concat(kept["kept"], F.array(u)).alias("cur"), (kept["n"] + F.length(u) + 1).alias("len"))
        longer = F.struct(s["chunks"].alias("chunks"), F.concat(s["cur"], F.array(u)).alias("cur"), (s["len"] + F.length(u) + 1).alias("len"))
        return F.when(full, flushed).otherwise(longer)

    done = lambda s: F.when(F.size(s["cur"]) > 0, F.concat(s["chunks"], F.array(F.array_join(s["cur"], " ")))).otherwise(s["chunks"])
    return F.aggregate(units, start, add, done)


def chunks(parts: DataFrame, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n, item, title, text): chunks of sections (doc_id, pos, item, title, text), numbered over the document from 0."""
    units = F.filter(F.transform(sentences(F.col("text")), strip), lambda u: u != "")
    ready = parts.withColumn("units", units).withColumn("units", wrapped(F.col("units"), size))
    rows = ready.select("doc_id", "pos", "item", "title", F.posexplode(packed(F.col("units"), size, overlap)).alias("k", "text"))
    return rows.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "k")) - 1).alias("n"), "item", "title", "text")
