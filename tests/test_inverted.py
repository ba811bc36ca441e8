"""The stored index: results are those of scoring everything, whatever the segments; blocks that cannot matter are not unpacked."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.operators import inverted, retrieval, storage
from quarry.operators.answering import build_index


def shown(df):
    return sorted((r.item_id, r["rank"], r.doc_id, round(r.score, 6)) for r in df.collect())


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(7)
    bag = [f"w{i}" for i in range(300)] + ["x-ray", "10k", "The"]
    docs = [(i, " ".join(r.choice(bag[: r.choice((5, 50, 303))]) for _ in range(r.randint(0, 60))), r.choice(("en", "fr", None))) for i in range(600)]
    docs += [(1000, None, "en"), (1001, "", "en"), (1002, "w1 " * 70_000, "fr")]
    asked = [(1, "w1 w2 w250"), (2, "x-ray the 10K w0 w0"), (3, "zzz unknown"), (4, ""), (5, None), (6, " ".join(bag))]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3).cache(), spark.createDataFrame(asked, "item_id long, text string")


def test_segments_and_merges_give_what_all_texts_give(spark, corpus, tmp_path):
    docs, asked = corpus
    index = inverted.InvertedIndex(spark, f"file://{tmp_path}/words", keep=("lang",))
    grams = inverted.TfidfIndex(spark, f"file://{tmp_path}/grams", keep=("lang",), features=400)
    seen = None
    for k in range(4):
        part = docs.where(F.col("doc_id") % 4 == k)
        seen = part if seen is None else seen.unionByName(part)
        index.append(part)
        grams.append(part)
        if k % 2:
            assert shown(index.bm25(asked, 7)) == shown(retrieval.bm25(seen, asked, 7))
            assert shown(grams.cosine(asked, 7)) == shown(retrieval.tfidf(seen, asked, 7, features=400))
    english = F.col("lang") == "en"
    want = [shown(retrieval.bm25(docs, asked, 7, keep=english)), shown(retrieval.tfidf(docs, asked, 7, features=400, keep=english)), sorted(map(tuple, retrieval.idf_table(retrieval.postings(docs), 1).select("term", "df").collect()))]
    for merged in (False, True):
        if merged:
            assert index.merge(least=9) is None and len(index.segments()) == 4
            assert index.merge(least=2) and grams.merge(least=2) and len(index.segments()) == len(grams.segments()) == 1
        assert index.totals() == (603, docs.select(F.sum(F.size(retrieval.tokens(F.coalesce("text", F.lit("")))))).first()[0])
        assert [shown(index.bm25(asked, 7, keep=english)), shown(grams.cosine(asked, 7, keep=english)), sorted(map(tuple, index.terms().collect()))] == want
    assert len(index.vacuum()) == 4 and shown(index.bm25(asked, 7, keep=english)) == want[0]
    assert {r.key for r in index.docs().collect()} == {r.doc_id for r in docs.collect()}


def test_a_question_reads_its_terms_and_no_texts(spark, corpus, tmp_path, monkeypatch):
    docs, asked = corpus
    docs.select("doc_id", "text", "lang").write.parquet(f"{tmp_path}/documents.parquet")
    texts = spark.read.parquet(f"{tmp_path}/documents.parquet")
    index, name = build_index(texts, root=f"file://{tmp_path}/index", keep=("lang",))
    assert name == "tfidf"
    plan = index.lexical.bm25(asked.where("item_id = 1"), 5)._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan and "PartitionFilters: [bucket" in plan and "In(term, [" in plan
    both = index.search(asked, 5)
    assert "documents.parquet" not in both._jdf.queryExecution().executedPlan().toString()
    assert shown(both) == shown(retrieval.rrf(retrieval.bm25(texts, asked, 10), retrieval.tfidf(texts, asked, 10), 5))
    again, _ = build_index(texts, root=f"file://{tmp_path}/index", keep=("lang",))
    assert again.lexical.segments() == index.lexical.segments()  # found, not built anew
    monkeypatch.setattr(inverted, "SENT", 3)  # more terms than are sent: joined instead
    assert shown(index.search(asked, 5)) == shown(both)
    monkeypatch.setattr(inverted, "TOGETHER", 1)
    assert shown(index.search(asked, 5)) == shown(both)


def packed(lists):
    rows = pa.array([[{"place": int(p), "tf": int(t)} for p, t in x] for x in lists], pa.list_(pa.struct([("place", pa.int32()), ("tf", pa.int32())])))
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(len(lists))]), pa.array([0] * len(lists)), rows], names=["term", "shard", "list"])
    out = next(inverted._pack(iter([batch])))
    return [tuple(out.column(c)[i].as_py() for c in ("docs", "tfs", "cells", "ends", "peaks")) for i in range(len(lists))]


@pytest.mark.parametrize("cell,size", [(128, 20_000), (4, 300), (1, 50)])
def test_blocks_are_skipped_and_nothing_is_lost(monkeypatch, cell, size):
    monkeypatch.setattr(inverted, "CELL", cell)
    r = np.random.default_rng(size)
    norm = np.exp(r.normal(size=size)) + 0.5
    keep = r.random(size) < 0.9
    lists = []
    for share in (0.3, 0.05, 0.01, 0.001):
        place = np.flatnonzero(r.random(size) < share)
        lists.append(list(zip(place, r.zipf(2.2, len(place)).clip(1, 900))) or [(0, 1)])
    work = []

    def value(tf, norm):
        work.append(len(tf))
        return inverted.bm25_value(tf, norm)

    shard = inverted._Shard(np.arange(size)[::-1].copy(), norm[::-1], keep[::-1], value)  # keys fall as places rise
    weights = [0.3, 1.0, 2.0, 4.0]
    for w, row in zip(weights, packed(lists)):
        shard.add(*row, [{"q": 7, "weight": w}])
    score = np.zeros(size)
    for w, x in zip(weights, lists):
        for p, t in x:
            score[p] += w * inverted.bm25_value(float(t), norm[p])
    score[~keep] = 0
    work.clear()
    for k in (1, 10, size):
        places, got = shard.best(shard.asked[7], k)
        want = sorted(np.flatnonzero(score > 0), key=lambda p: (-round(score[p], 9), -p))[:k]
        assert places.tolist() == [int(p) for p in want] and np.allclose(got, score[want])
        if k == 1 and size == 20_000:
            blocks = sum(len(np.frombuffer(row[2], np.uint16)) for row in packed(lists))
            assert sum(work) - blocks < 0.2 * sum(map(len, lists))  # the bounds aside, few postings were looked at


def test_versions_are_committed_once(spark, tmp_path):
    store = storage.Manifest(spark, f"file://{tmp_path}/m")
    assert store.version() == 0 and store.read() == {}
    assert store.commit({"a": 1}, 1) == 1
    with pytest.raises(storage.Conflict):
        store.commit({"a": 2}, 1)
    assert store.read() == {"a": 1} and store.names("manifest") == ["v0000000001.json"]
    other = storage.Manifest(spark, f"file://{tmp_path}/m")
    calls = []

    def edit(content):
        if not calls:  # another writer is faster
            calls.append(1)
            other.change(lambda c: c | {"b": 2})
        return content | {"c": 3}

    assert store.change(edit) == 3 and store.read() == {"a": 1, "b": 2, "c": 3}


def test_an_empty_index_has_no_answers(spark, corpus, tmp_path):
    docs, asked = corpus
    index, _ = build_index(docs.limit(0), root=f"file://{tmp_path}/none")
    assert index.search(asked, 5).count() == 0
    index.append(docs.where("doc_id < 20"))
    assert shown(index.search(asked, 3)) == shown(retrieval.rrf(retrieval.bm25(docs.where("doc_id < 20"), asked, 10), retrieval.tfidf(docs.where("doc_id < 20"), asked, 10), 3))


def test_features_follow_the_given_stop_words_and_words_of_any_script(spark, tmp_path):
    """Against a plain cosine of sublinear counts and smooth idf, with another list of stop words."""
    import math
    import re
    from collections import Counter

    from quarry.operators.inverted import TfidfIndex
    from quarry.operators.retrieval import STOP, tfidf

    stop = ("größe", "der", *[f"word{i}" for i in range(400)])
    texts = ["Die Größe der Straße über alles", "über_alles die straße 42 x", "Der Été, l\u2019été: année 中文 文字", "a I ß", "", None, "word7 die Straße über", "ÜBER ALLES 中文 文字 die"]
    asked = {1: "Die STRASSE der straße", 2: "été 中文 die größe", 3: "nothing of it", 4: ""}

    def grams(t):
        w = [x for x in re.findall(r"\w\w+", (t or "").lower()) if x not in stop]
        return Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])

    counts = [grams(t) for t in texts]
    df = Counter(g for c in counts for g in c)
    idf = {g: math.log((1 + len(texts)) / (1 + n)) + 1 for g, n in df.items()}

    def vector(c):
        v = {g: (1 + math.log(n)) * idf[g] for g, n in c.items() if g in idf}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {g: x / size for g, x in v.items()}

    want = {}
    for q, t in asked.items():
        v = vector(grams(t))
        scores = [(round(sum(x * vector(c).get(g, 0.0) for g, x in v.items()), 9), i) for i, c in enumerate(counts)]
        want[q] = [(i, round(s, 6)) for s, i in sorted(scores, key=lambda x: (-x[0], x[1]))[:4]]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    questions = spark.createDataFrame([*asked.items()], "item_id int, text string")
    index = TfidfIndex(spark, f"file://{tmp_path}/grams", stop=stop)
    index.append(docs)
    for found in (index.cosine(questions, 4), tfidf(docs, questions, 4, stop=stop)):
        got = {q: [] for q in asked}
        for r in sorted(found.collect(), key=lambda r: r["rank"]):
            got[r.item_id].append((r.doc_id, round(r.score, 6)))
        assert got == want
    assert "the" in STOP and want[2][0][1] > 0


def test_a_batch_is_counted_and_packed_in_bounded_runs(monkeypatch):
    """However many words a batch has, a few are worked on at once: what comes out is cut likewise, and is the same."""
    r = random.Random(4)
    lists = [[r.choice("abcdefg") for _ in range(r.choice((0, 3, 40, 130)))] for _ in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array([*lists[:-1], None], pa.list_(pa.string()))], names=["key", "words"])
    whole = [x for b in inverted._count(iter([batch])) for x in b.to_pylist()]
    rows = pa.array([[{"place": p, "tf": 1 + p % 3} for p in range(n)] for n in (0, 5, 300, 7, 90, 1)], pa.list_(pa.struct([("place", pa.int32()), ("tf", pa.int32())])))
    postings = pa.RecordBatch.from_arrays([pa.array(list("abcdef")), pa.array([0] * 6), rows], names=["term", "shard", "list"])
    packed_ = [x for b in inverted._pack(iter([postings])) for x in b.to_pylist()]
    monkeypatch.setattr(inverted, "COUNTED", 100)
    monkeypatch.setattr(inverted, "PACKED", 100)
    parts = list(inverted._count(iter([batch])))
    plain = lambda rows: [(x["key"], x["size"], sorted(zip(x["terms"], x["tfs"]))) for x in rows]
    assert max(sum(b.column("size").to_pylist()) for b in parts if b.num_rows > 1) <= 100 and len(parts) > 20
    assert plain(x for b in parts for x in b.to_pylist()) == plain(whole) and [x["key"] for x in whole] == list(range(200))
    parts = list(inverted._pack(iter([postings])))
    assert len(parts) == 3 and [x for b in parts for x in b.to_pylist()] == packed_


def test_words_cut_in_a_worker_are_those_of_the_pattern():
    import re

    r = random.Random(11)
    texts = ["".join(r.choice("ab9--- .éİ_\n") for _ in range(r.randint(0, 40))) for _ in range(3000)] + ["", "-", "a", "ab", "--ab", "a-", "-a-", "xßyy"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts) + 1)), pa.array([*texts, None])], names=["key", "words"])
    want = [re.findall(r"[a-z0-9][a-z0-9\-]+", t) for t in texts] + [[]]
    for part in (batch, batch.slice(7), batch.slice(5, 1), batch.slice(0, 0)):
        got = [x for b in inverted._cut(iter([part])) for x in b.to_pylist()]
        assert [x["words"] for x in got] == [want[k] for k in part.column("key").to_pylist()] and [x["key"] for x in got] == part.column("key").to_pylist()


def test_parts_are_joined_over_batches_and_in_any_order(monkeypatch):
    """Parts of a term and shard may come in several batches, and with places between those of another part, as a merge leaves them."""
    r = random.Random(3)
    want = {(t, s): sorted((p, r.randint(1, 9)) for p in r.sample(range(500), r.choice((1, 3, 200)))) for t in ("a", "a b", "c", "é") for s in (4, 5)}
    rows = []
    for (term, shard), posts in want.items():
        split = [[x for x in posts if x[0] % 3 == k] for k in range(3)] if shard == 4 else [posts[:2], posts[2:]]
        rows += [(term, shard, p[0][0], np.array([x[0] for x in p], np.uint16).tobytes(), np.array([x[1] for x in p], np.uint32).tobytes()) for p in split if p]
    rows.sort(key=lambda x: (x[0].encode(), x[1], x[2]))
    schema = pa.schema([("term", pa.string()), ("shard", pa.int64()), ("first", pa.int32()), ("docs", pa.binary()), ("tfs", pa.binary())])
    whole = pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], f.type) for i, f in enumerate(schema)], schema=schema)
    monkeypatch.setattr(inverted, "PACKED", 50)
    for size in (1, 2, 5, len(rows)):
        batches = [whole.slice(a, size) for a in range(0, len(rows), size)]
        got = [x for b in inverted._join(iter([*batches, whole.slice(0, 0)])) for x in b.to_pylist()]
        assert {(x["term"], x["shard"]): [(y["place"], y["tf"]) for y in x["list"]] for x in got} == want and len(got) == len(want)


@pytest.mark.parametrize("slots", [64, 1 << 12])
def test_features_are_those_of_all_counts_however_few_slots(spark, corpus, tmp_path, monkeypatch, slots):
    """Slots that tell too little let more through, and in the end all: the features stay the same."""
    docs, _ = corpus
    monkeypatch.setattr(inverted, "SLOTS", slots)
    index = inverted.TfidfIndex(spark, f"file://{tmp_path}/grams", features=150)
    index.append(docs)
    grams = docs.select(F.explode(retrieval.uni_bigrams(F.col("text"))).alias("term"), "doc_id").groupBy("term").agg(F.count("*").alias("times"), F.countDistinct("doc_id").alias("df"))
    want = {r.term: round(float(np.log(604 / (1 + r.df)) + 1), 9) for r in grams.orderBy(F.desc("times"), "term").limit(150).collect()}
    assert {r.term: round(r.idf, 9) for r in index.weighed()[0].collect()} == want
    monkeypatch.setattr(inverted, "SENT", 40)  # more features than are sent at once: taken in parts
    other = inverted.TfidfIndex(spark, f"file://{tmp_path}/parts", features=150)
    other.append(docs)
    plain = lambda index: sorted(round(r.norm, 9) for r in index.weighed()[1].collect())
    assert plain(other) == plain(index) and sorted(map(tuple, other.terms().collect())) == sorted(map(tuple, index.terms().collect()))


def test_building_exchanges_gathered_terms_not_postings(spark, tmp_path):
    """A word of 2,000 documents is exchanged as a few rows, and rare pairs are not exchanged at all."""
    r = random.Random(5)
    docs = spark.createDataFrame([(i, "alpha beta gamma delta " + " ".join(f"r{r.randrange(10**9)}" for _ in range(20))) for i in range(2_000)], "doc_id long, text string").repartition(2)
    index = inverted.TfidfIndex(spark, f"file://{tmp_path}/grams", features=7)
    kept, sent = {}, []
    write, by_id = inverted.TfidfIndex._write, inverted._frequent
    try:
        inverted.TfidfIndex._write = lambda self, parts, path: (sent.append(parts.count()), write(self, parts, path))[1]
        inverted._frequent = lambda bits, slots: kept.setdefault("run", (by_id(bits, slots), np.unpackbits(np.frombuffer(bits, np.uint8)).sum()))[0]
        index.append(docs)
        found = {x.term for x in index.weighed()[0].collect()}
    finally:
        inverted.TfidfIndex._write, inverted._frequent = write, by_id
    assert found == {"alpha", "beta", "gamma", "delta", "alpha beta", "beta gamma", "gamma delta"}
    assert sent[0] <= 7 * 2 * 2  # 14,000 postings
    assert {x.term: x.df for x in index.terms().collect()} == dict.fromkeys(found, 2_000)
