"""What SQL gives is what the DataFrame functions give."""

from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import segment as S
from quarry.plans import sql_surface, texts


def test_functions_are_those_of_the_library(spark, small):
    names = sql_surface.register(spark)
    assert "token_jaccard" in names and "doc_paragraphs" in names
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", F.reverse("text").alias("other"))
    said = spark.createDataFrame([(-1, "We expect revenue of $5 million to $6 million. It's up. \n\n  Then more\n \n\nend", "x"), (-2, "", ""), (-3, None, None)], "doc_id long, text string, other string")
    docs = docs.unionByName(said)
    docs.createOrReplaceTempView("surface_docs")
    got = spark.sql("SELECT doc_id, doc_tokens(text) AS a, doc_token_set(text) AS b, token_jaccard(text, substring(text, 20)) AS c, doc_sentences(text) AS d, doc_snippet(text) AS e, revenue_guidance(text) AS f FROM surface_docs")
    jaccard = F.coalesce(X.jaccard(X.token_set(F.col("text")), X.token_set(F.substring("text", 20, 1 << 30))), F.lit(0.0))
    want = docs.select("doc_id", X.tokens(F.col("text")).alias("a"), X.token_set(F.col("text")).alias("b"), jaccard.alias("c"), X.sentences(F.col("text")).alias("d"), X.snippet(F.col("text")).alias("e"), X.guidance(F.col("text")).alias("f"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    got = spark.sql("SELECT d.doc_id, p.pos, p.text FROM surface_docs d, LATERAL doc_paragraphs(d.text, 3) p")
    want = docs.select("doc_id", F.posexplode(X.paragraphs(F.col("text"), 3)).alias("pos", "text"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 100
    terms = spark.sql("SELECT d.doc_id, sum(x.tf) AS n FROM surface_docs d, LATERAL doc_terms(d.text) x GROUP BY d.doc_id")
    assert {r.doc_id: r.n for r in terms.collect()} == {r.doc_id: r.n for r in docs.select("doc_id", F.size(X.tokens(F.col("text"))).alias("n")).where("n > 0").collect()}


def test_views_hold_sections_turns_and_chunks(spark, small):
    filings = texts.filings(spark, small).select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("doc_id"), "form", "text")
    calls = texts.transcripts(spark, small).select(F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("doc_id"), F.lit("TRANSCRIPT").alias("form"), "text")
    assert sql_surface.publish(filings.unionByName(calls), "v_") == ["v_sections", "v_turns", "v_chunks"]
    parts = S.sections(filings).unionByName(S.turns(calls.select("doc_id", "text")))
    want = S.chunks(parts)
    got = spark.sql("SELECT * FROM v_chunks")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert spark.sql("SELECT count(*) AS n FROM v_sections WHERE item = '1A'").first().n == S.sections(filings).where("item = '1A'").count() > 0
    assert spark.sql("SELECT count(DISTINCT doc_id) AS n FROM v_turns").first().n == calls.count()
