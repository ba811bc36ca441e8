import re

from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import segment as S
from quarry.operators import stores
from quarry.operators.extract import risk_counts
from quarry.operators.fundamentals import company_facts, latest_filed
from quarry.operators.retrieval import dedupe

BODY = "The plant may stop. " * 15


def test_sections_take_the_longest_body_and_the_caption_by_form(spark):
    text = f"Item 1A. Risk Factors\nItem 7. Discussion\n\nITEM 1A. Risk Factors\n{BODY}\nManagement’s discussion and analysis:\n{BODY * 2}\nItem 9A\nshort"
    rows = spark.createDataFrame([("a", "10-K", text), ("b", "10-Q", text), ("c", "10-K", "nothing here")], "doc_id string, form string, text string")
    got = {(r.doc_id, r.item): r for r in S.sections(rows).collect()}
    assert set(got) == {("a", "1A"), ("a", "7"), ("b", "1A"), ("b", "2"), ("c", "0")}
    assert got["a", "7"].text.startswith("The plant") and got["a", "1A"].pos == 1 and got["c", "0"].text == "nothing here"


def test_a_bare_item_line_takes_the_next_line_as_its_title(spark):
    text = f"Item 1A.\nItem 7.\n{BODY}"
    row = S.sections(spark.createDataFrame([("a", "10-K", text)], "doc_id string, form string, text string")).collect()
    assert [(r.item, r.title) for r in row] == [("1A", "Item 7")]


def test_turns(spark):
    text = "\n".join([
        "preamble that no one speaks, so it goes", "Maria de la Cruz -- Chief Executive Officer", "Welcome to the call of the third quarter, everyone.", "Operator",
        "We will now begin the question-and-answer session. The first question is yours.", "Jan van Dam: What about the margin in the next year, please?", "Questions and Answers", "Maria goes on, but as the same speaker in questions.", "Note: not a speaker",
    ])
    got = [(r.item, r.title, r.text) for r in S.turns(spark.createDataFrame([(1, text), (2, "flat text")], "doc_id int, text string")).orderBy("doc_id", "pos").collect()]
    assert [g[:2] for g in got] == [("PR", "Maria de la Cruz (Chief Executive Officer)"), ("QA", "Operator"), ("QA", "Jan van Dam"), ("QA", "Jan van Dam"), ("0", "Full transcript")]
    assert got[3][2].endswith("Note: not a speaker")


def pack(units, size, overlap):
    chunks, cur, n = [], [], 0
    for u in units:
        if cur and n + len(u) + 1 > size:
            chunks.append(" ".join(cur))
            kept, k = [], 0
            while cur and k + len(cur[-1]) <= overlap:
                kept.insert(0, cur.pop())
                k += len(kept[0]) + 1
            cur, n = kept, k
        cur.append(u)
        n += len(u) + 1
    return chunks + ([" ".join(cur)] if cur else [])


def test_chunks_against_a_plain_loop(spark):
    sentences = [f"Sentence {i} has {'x' * (i * 37 % 200)} inside." for i in range(60)]
    row = spark.createDataFrame([(1, 1, "7", "t", " ".join(sentences))], "doc_id int, pos int, item string, title string, text string")
    assert [r.text for r in S.chunks(row).orderBy("n").collect()] == pack(sentences, 900, 150)


def test_oversized_units_are_wrapped(spark):
    table = "\n".join("row " + "9 " * 100 for _ in range(12)) + "y" * 1000
    row = spark.createDataFrame([(1, 1, "7", "t", table)], "doc_id int, pos int, item string, title string, text string")
    got = [r.text for r in S.chunks(row).collect()]
    assert max(map(len, got)) <= 900 + 150 and re.sub(r"\s", "", "".join(got)).count("y") >= 1000


def test_citations_are_renumbered(spark):
    row = spark.createDataFrame([("A [3]. B [1, 3]. C [9].", ["p", "q", "r"]), ("none", ["p"])], "a string, s array<string>")
    text, kept = X.prune_citations(F.col("a"), F.col("s"))
    assert [tuple(r) for r in row.select(text, kept).collect()] == [("A [2]. B [1, 2]. C [9].", ["p", "r"]), ("none", ["p"])]


def test_dedupe_is_sequential(spark):
    words = lambda *w: list(w)
    rows = spark.createDataFrame([([(1, words("a", "b")), (2, words("a", "b")), (3, words("c"))],)], "h array<struct<key:bigint,words:array<string>>>")
    assert [x.key for x in rows.select(dedupe(F.col("h")).alias("k")).first().k] == [1, 3]


def test_guidance_replies_are_validated(spark):
    rows = spark.createDataFrame([('```json\n{"revenue_guidance": ["$1"], "capex_guidance": []}\n```',), ('{"revenue_guidance": [1], "capex_guidance": []}',), ("x",), ('{"revenue_guidance": []}',)], "r string")
    assert [r.v is not None for r in rows.select(X.validated_guidance(F.col("r")).alias("v")).collect()] == [True, False, False, False]


def test_risk_cascade_prefers_structure(spark):
    heading, body = "Our plant could stop and our results may be harmed by it", "word " * 60
    text = "\n\n".join([heading, body] * 3)
    row = risk_counts(spark.createDataFrame([(1, text), (2, "")], "doc_id int, text string")).orderBy("doc_id").collect()
    assert row[0].structural == 3 and row[0].n_risks == 3 and row[1].n_risks == 0


def test_restated_facts_and_tag_priority(spark):
    import json

    def fact(fy, val, filed, form="10-K", fp="FY"):
        return {"fy": fy, "fp": fp, "form": form, "val": val, "filed": filed}

    doc = {"facts": {"us-gaap": {"Revenues": {"units": {"USD": [fact(2023, 1.0, "2024-01-01"), fact(2023, 2.0, "2025-01-01"), fact(2023, 9.0, "2026-01-01", form="10-Q")]}}, "SalesRevenueNet": {"units": {"USD": [fact(2022, 5.0, "2023-01-01")]}}, "Assets": {"units": {"USD": [fact(2022, 7.0, "2023-01-01")]}}}}}
    rows = spark.createDataFrame([("x", json.dumps(doc))], "entity string, raw string").select("entity", F.inline(company_facts(F.col("raw"))))
    got = {r.period: r for r in latest_filed(rows).collect()}
    assert got["FY2023"].revenue == 2.0 and got["FY2022"].revenue is None and got["FY2022"].total_assets == 7.0


def test_upsert_and_read_through(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    assert sorted(map(tuple, stores.upsert(old, new, ["id"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    got = stores.read_through(spark.createDataFrame([(1,), (9,)], "id int"), old, lambda todo: todo.withColumn("v", F.lit("new")), ["id"])
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (9, "new")]
