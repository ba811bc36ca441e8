"""Data sources over a given function, and models as columns, with requests and rows that fail."""

import json
import os
import uuid

from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import answering, models
from quarry.operators.storage import ship
from quarry.sources import feeds


def test_tickers_are_fetched_in_batches_and_failures_are_rows(spark, tmp_path):
    log = str(tmp_path)

    def facts(ticker):
        with open(f"{log}/{ticker}-{uuid.uuid4().hex}", "w"):
            pass
        if ticker == "BAD":
            raise OSError("no such company")
        if ticker == "SLOW" and sum(n.startswith("SLOW") for n in os.listdir(log)) < 3:
            raise TimeoutError("busy")
        if ticker == "ODD":
            return "no json"
        return json.dumps({"facts": {"us-gaap": {"Assets": {"units": {"USD": [{"fy": 2024, "fp": "FY", "form": "10-K", "val": len(ticker), "filed": "2025-01-01"}], "EUR": [{"val": 1}]}}}}})

    def prices(ticker):
        return "date,close\n2024-01-02 00:00:00-05:00,1.5\n2024-01-03,\n2024-01-04,2\n"

    ship(spark)
    feeds.register(spark, facts, prices)
    read = lambda name: spark.read.format(name).options(tickers="AA, BBB,BAD,SLOW,ODD,CCCC,AA", batch="2", pause="0.01").load()
    assert read("company_facts").rdd.getNumPartitions() == 3
    got = {r.ticker: (r.tag, r.val, r.error) for r in read("company_facts").collect()}
    assert {t: v[:2] for t, v in got.items() if not v[2]} == {"AA": ("Assets", 2.0), "BBB": ("Assets", 3.0), "SLOW": ("Assets", 4.0), "CCCC": ("Assets", 4.0)}
    assert got["BAD"][2] == "OSError: no such company" and got["ODD"][2].startswith("JSONDecodeError")
    calls = lambda: {t: sum(n.split("-")[0] == t for n in os.listdir(log)) for t in ("AA", "BBB", "BAD", "SLOW")}
    assert calls() == {"AA": 1, "BBB": 1, "BAD": 3, "SLOW": 3}
    some = read("company_facts").where(F.col("ticker").isin("AA", "CCCC") & (F.col("val") > 2))
    assert [r.ticker for r in some.collect()] == ["CCCC"] and calls()["BBB"] == 1 and calls()["BAD"] == 3  # others are not fetched
    assert [(r.date, r.close) for r in read("prices").where("ticker = 'BBB'").collect()] == [("2024-01-02", 1.5), ("2024-01-04", 2.0)]
    assert read("prices").where("ticker = 'none'").count() == 0


def fake(log, reply, fails=()):
    """A model that notes its loading and every call."""

    def load():
        with open(f"{log}/load-{os.getpid()}-{uuid.uuid4().hex}", "w"):
            pass

        def run(inputs):
            with open(f"{log}/call-{uuid.uuid4().hex}", "w") as f:
                json.dump([len(str(x)) for x in inputs], f)
            if any(w in str(x) for x in inputs for w in fails):
                raise RuntimeError("cannot")
            return [reply(x) for x in inputs]

        return run

    return load


def test_a_model_is_loaded_once_a_worker_and_called_in_batches(spark, tmp_path):
    ship(spark)
    log = str(tmp_path)
    texts = [("w " * (i * 37 % 600)) + f"n{i}" for i in range(300)] + [None]
    ask = models.column(fake(log, lambda t: len(t.split()), fails=("n7",)), "int", most=100)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(6)
    got = {r.i: (r.x.value, r.x.error) for r in rows.select("i", ask(F.col("t")).alias("x")).collect()}
    for i, t in enumerate(texts):
        cut = None if t is None else " ".join(t.split()[:100])
        assert got[i] == ((None, None) if t is None else (None, "RuntimeError: cannot") if "n7" in cut else (min(100, len(t.split())), None))
    loads = [n.split("-")[1] for n in os.listdir(log) if n.startswith("load")]
    assert len(loads) == len(set(loads))  # one of each worker process
    sizes = [json.load(open(f"{log}/{n}")) for n in os.listdir(log) if n.startswith("call")]
    assert max(map(len, sizes)) == 16 and all(max(s) <= 300 for s in sizes) and all(s == sorted(s) for s in sizes)


def test_hooks_fall_through_to_the_next_backend(spark, tmp_path):
    ship(spark)
    log = str(tmp_path)
    chunks = spark.createDataFrame([(0, "the margin of the plant rose"), (1, "margin and plant and river")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "margin of the plant"), (2, "plant river")], "item_id long, text string")
    index, _ = answering.build_index(chunks, root=f"file://{tmp_path}/index")
    first = models.generator(fake(log, lambda x: f"first says {x[0]} [1].", fails=("river",)))
    second = models.generator(fake(log, lambda x: f"second says {x[0]} [1]."))
    got = {r.item_id: (r.answer, r.backend) for r in answering.answer(index, asked, k=1, models={"one": first, "two": second}, score=models.scorer(fake(log, lambda x: float(-len(x[1]))))).collect()}
    assert got[1][1] in ("one", "two") and got[2] == ("second says plant river [1].", "two")
    said = "This sentence is long enough to count here. This other one is long enough as well."
    scores = models.sentence_scores(fake(log, lambda s: (0.5, 0.1 * len(s.split()), 0.1), fails=("other",)))
    found = spark.createDataFrame([(said,), ("This sentence is quite long enough to count here.",), (None,), ("short",)], "t string").select(X.sentiment(F.col("t"), scores).alias("s")).collect()
    assert [r.s and r.s.backend for r in found] == ["lexicon", "finbert", None, "none"]
