import random

from pyspark.sql import functions as F

from quarry.sources import corpus
from quarry.streaming import ingest


def test_corpus_and_stream(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir()
    b.mkdir()
    (a / "AAA_10-K_2024-01-01.txt").write_text("plain  text\r\n\n\n\nend ")
    (b / "AAA_10-K_2024-01-01.htm").write_text("<html><p>other</p></html>")
    (b / "BBB_10-Q_2024-02-01.html").write_text("<html><script>x</script><p>one &amp; two</p></html>")
    (b / "bad.txt").write_text("x")
    got = {r.doc_id: r.text for r in corpus.corpus(spark, str(a), str(b), str(tmp_path / "none")).collect()}
    assert got == {"AAA_10-K_2024-01-01": "plain text\n\nend", "BBB_10-Q_2024-02-01": "one & two"}
    assert corpus.corpus(spark, str(tmp_path / "none")).count() == 0
    for _ in range(2):
        ingest.append_new(ingest.document_stream(spark, str(b)), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_bytes_that_are_no_utf8_are_left_out(spark, tmp_path):
    r = random.Random(1)
    bits = [b"ab", "é".encode(), "\ufffd".encode(), "\ufdd0a".encode(), "\ufdd0".encode(), "😀".encode(), b"\xe9", b"\xff", b"\xe2\x82", b"\xed\xa0\x80", b"\xf0\x9f", b"\xc0\xaf", b" ", b"\xf4\x90\x80\x80"]
    raw = [b"".join(r.choice(bits) for _ in range(r.randint(0, 12))) for _ in range(400)]
    got = spark.createDataFrame(list(enumerate(map(bytearray, raw))), "i int, b binary").orderBy("i").select(corpus.decoded(F.col("b")).alias("t")).collect()
    assert [x.t for x in got] == [b.decode(errors="ignore") for b in raw]
    (tmp_path / "AAA_10-K_2024-01-01.txt").write_bytes(b"caf\xe9 one\xff two")
    (tmp_path / "BBB_10-K_2024-01-01.txt").write_bytes("café".encode())
    assert {x.doc_id[:3]: x.text for x in corpus.corpus(spark, str(tmp_path)).collect()} == {"AAA": "caf one two", "BBB": "café"}
    ingest.append_new(ingest.document_stream(spark, str(tmp_path)), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert {x.text for x in spark.read.parquet(str(tmp_path / "out")).collect()} == {"caf one two", "café"}


def test_contents_are_read_where_they_lie(spark, tmp_path):
    for folder, ending in (("a", "html"), ("a", "txt"), ("b", "txt")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / f"AAA_10-K_2024-01-01.{ending}").write_text(f"from {folder} {ending}")
    docs = corpus.corpus(spark, str(tmp_path / "b"), str(tmp_path / "a"), str(tmp_path / "a"))
    assert [x.text for x in docs.collect()] == ["from b txt"]
    assert [x.text for x in corpus.corpus(spark, str(tmp_path / "a")).collect()] == ["from a txt"]
    plan = docs._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    assert "BroadcastExchange" in plan and "Exchange hashpartitioning" not in plan


def test_facts_and_prices(spark, tmp_path):
    (tmp_path / "X.json").write_text('{"facts": {"us-gaap": {"Assets": {"units": {"USD": [{"fy": 2024, "fp": "FY", "form": "10-K", "val": 3, "filed": "2025-01-01"}]}}}}}')
    (tmp_path / "p.csv").write_text("ticker,date,close\nX,2024-01-02 00:00:00-05:00,1.5\nX,2024-01-03,\n")
    assert corpus.facts(spark, str(tmp_path)).first().val == 3.0
    assert [(str(r.date), r.close) for r in corpus.prices(spark, str(tmp_path / "p.csv")).collect()] == [("2024-01-02", 1.5)]
