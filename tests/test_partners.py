"""Best partners and approximate vector search against plain loops."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.functions.text import letter_vector
from quarry.operators import audit, diffing, partners, retrieval, vector_index


def best_word_partner(old, words):
    best, at = 0.0, -1
    for i, other in enumerate(old):
        shared = len(words & other)
        if shared and shared / len(words | other) > best:
            best, at = shared / len(words | other), i
    return at, best


@pytest.mark.parametrize("at_once", [0, 1 << 18])
def test_word_partners_are_those_of_a_plain_loop(monkeypatch, at_once):
    monkeypatch.setattr(partners, "AT_ONCE", at_once)
    r = random.Random(3)
    for _ in range(60):
        bag = [f"w{i}" for i in range(r.choice((3, 30, 400)))] + ["ü"]
        units = lambda n: [set(r.choices(bag, k=r.randint(0, 40), weights=[1 / (i + 1) for i in range(len(bag))])) for _ in range(n)]  # noqa: E731, B023
        old, new = units(r.randint(1, 60)), units(r.randint(1, 30))
        old += old[:3]
        at, score = partners.by_words(pa.array(list(map(list, old)), pa.list_(pa.string())), pa.array(list(map(list, new)), pa.list_(pa.string())))
        assert list(zip(at.tolist(), score.tolist())) == [best_word_partner(old, w) for w in new]


def test_frequent_words_do_not_multiply(spark, monkeypatch):
    """300 x 300 paragraphs that share ten words: what is shipped is the units, and few postings of the frequent words are looked up."""
    common = [f"c{i}" for i in range(10)]
    text = lambda side, i: " ".join([*common, *(f"{side}{i}x{k}" for k in range(i % 30 + 5))])
    rows = [(1, i, text("o", i)) for i in range(300)] + [(2, i, text("n", i)) for i in range(300)]
    units = spark.createDataFrame(rows, "doc_id long, pos int, text string")
    pair = spark.createDataFrame([(1, 2)], "old_id long, new_id long")
    got = diffing.best_matches(pair, units)
    want = [best_word_partner([set(t.split()) for d, _, t in rows if d == 1], set(t.split())) for d, _, t in rows if d == 2]
    assert [(r.old_pos, r.score) for r in got.orderBy("new_pos").collect()] == want
    lists = [pa.array([t.split() for d, _, t in rows if d == side], pa.list_(pa.string())) for side in (1, 2)]
    tried = counted(monkeypatch)
    at, score = partners.by_words(*lists)
    assert list(zip(at.tolist(), score.tolist())) == want and len(tried) <= 2 * 300  # of 90,000 pairs


def counted(monkeypatch):
    """Every unit that is held against frequent words."""
    tried, plain = [], partners._shared
    monkeypatch.setattr(partners, "AT_ONCE", 0)
    monkeypatch.setattr(partners, "_shared", lambda rest, words: tried.append(1) or plain(rest, words))
    return tried


def test_rare_words_end_the_search_early(monkeypatch):
    """Near copies among units that share many frequent words: the first one tried is the best."""
    common = [f"c{i}" for i in range(40)]
    old = [[*common, *(f"o{i}x{k}" for k in range(40))] for i in range(400)]
    new = [[*common[:39], *(f"o{i}x{k}" for k in range(39)), "own"] for i in range(0, 400, 4)]
    tried = counted(monkeypatch)
    at, _ = partners.by_words(pa.array(old, pa.list_(pa.string())), pa.array(new, pa.list_(pa.string())))
    assert at.tolist() == list(range(0, 400, 4)) and len(tried) == len(new)


@pytest.mark.parametrize("side", [512, 3])
def test_units_meet_in_blocks(spark, monkeypatch, side):
    monkeypatch.setattr(partners, "SIDE", side)
    r = random.Random(5)
    rows = [(d, p, " ".join(r.choice("a b c d e f g h i j k l m n".split()) for _ in range(r.randint(0, 9)))) for d in range(6) for p in range(r.choice((0, 1, 4, 11)))]
    units = spark.createDataFrame(rows, "doc_id long, pos int, text string")
    pairs = spark.createDataFrame([(a, b) for a in range(6) for b in range(6)], "old_id long, new_id long")
    sets = {d: [set(t.split()) for k, _, t in rows if k == d] for d in range(6)}
    got = {(r.old_id, r.new_id, r.new_pos): (r.old_pos, r.score) for r in diffing.best_matches(pairs, units).collect()}
    assert got == {(a, b, p): best_word_partner(sets[a], w) for a in range(6) for b in range(6) for p, w in enumerate(sets[b])}
    vectors = {(v.doc_id, v.pos): np.array(v.v) for v in units.select("doc_id", "pos", letter_vector(F.col("text")).alias("v")).collect()}
    by = {(r.old_id, r.new_id, r.new_pos): (r.old_pos, round(r.score, 9)) for r in diffing.best_matches(pairs, units, letter_vector).collect()}
    for a in range(6):
        for b in range(6):
            for p in range(len(sets[b])):
                scores = [round(float(vectors[a, o] @ vectors[b, p]), 9) for o in range(len(sets[a]))]
                top = max(scores, default=None)
                got_at, got_score = by[a, b, p]
                assert (got_at, got_score) == (-1, 0.0) if top is None else abs(got_score - top) < 2e-9 and scores[got_at] >= top - 2e-9


def test_vector_limits_and_few_common_words():
    kinds = {}
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    rows = [(0.98, 0.0), (0.97, 0.5), (0.9, 0.5), (0.9, 0.1), (0.7, 0.5), (0.7, 0.15), (0.44, 0.9), (0.6, 0.14)]
    for r in spark.createDataFrame(rows, "s double, o double").select("s", "o", diffing.classify(F.col("s"), F.col("o")).alias("k")).collect():
        kinds[r.s, r.o] = r.k
    assert list(kinds.values()) == [None, None, "minor", "new", "substantive", "substantive", "new", "new"]


def test_support_by_vectors_is_that_of_a_plain_loop(spark):
    sources = ["Margins of the plant rose in spring.", "The river runs along the town; 45 boats.", "Something else entirely: zzz qqq xxx jjj."]
    said = "Margins of the plant rose in spring [1]. Boats and the river went along with 45 towns [2, 9]. The plant saw margins rise through spring months. Zebras quietly judge xylophone jazz music [3]."
    answers = spark.createDataFrame([(1, said, sources), (2, said, sources[:1]), (3, said, [])], "id long, answer string, sources array<string>")
    rows = audit.sentence_audit(answers, letter_vector, ("id",)).collect()
    vector = lambda t: np.array(spark.createDataFrame([(t,)], "t string").select(letter_vector(F.col("t")).alias("v")).first().v)
    cited = {0: [0], 1: [1], 2: [0, 1, 2], 3: [2]}
    assert sorted((r.id, r.pos) for r in rows) == [(i, p) for i in (1, 2) for p in range(4)]
    for r in rows:
        given = sources if r.id == 1 else sources[:1]
        among = [k for k in cited[r.pos] if k < len(given)] or range(len(given))
        want = max(float(vector(r.sentence) @ vector(given[k])) for k in among)
        assert abs(r.support - want) < 1e-9 and r.grounded == (round(want, 9) >= 0.62 and not r.missing)
    assert {r.backend for r in audit.verdict(answers, audit.sentence_audit(answers, letter_vector, ("id",)), ["id"], "embeddings").collect()} == {"embeddings", "none"}


def clustered(n=4000, size=24, clusters=60, seed=2):
    r = np.random.default_rng(seed)
    x = r.normal(size=(clusters, size))[r.integers(0, clusters, n)] + 0.25 * r.normal(size=(n, size))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def recall(index, vectors, queries, k, same=None):
    true = {(r.query_id, r.vec_id) for r in retrieval.dense(vectors, queries, k, same=same).collect()}
    got = {(r.query_id, r.vec_id): r.score for r in index.search(queries, k, same=bool(same)).collect()}
    exact = {(r.query_id, r.vec_id): r.score for r in retrieval.dense(vectors, queries, k, same=same).collect()}
    assert all(abs(got[p] - exact[p]) < 1e-9 for p in got.keys() & exact.keys())
    return len(true & got.keys()) / len(true)


def test_approximate_search_finds_most_and_reads_little(spark, tmp_path):
    x = clustered()
    rows = [(i, [float(a) for a in v], i % 3) for i, v in enumerate(x)] + [(9001, None, 1), (9002, [0.0] * 24, 1), (9003, [float("nan")] * 24, 1), (9004, [1.0], 2)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    index = vector_index.VectorIndex(spark, f"file://{tmp_path}/v")
    index.build(vectors, "label")
    sound = vectors.where("vec_id < 9000")
    queries = sound.where("vec_id % 100 = 0")
    entry = next(iter(index.manifest.read()["data"].values()))
    assert entry["vectors"] == 4000 and recall(index, sound, queries, 5) >= 0.9 and recall(index, sound, queries, 5, same="label") >= 0.9
    looked = index.candidates(queries, 5).dropDuplicates(["query_id", "vec_id"]).groupBy("query_id").count().agg(F.max("count")).first()[0]
    blocks = index.candidates(queries, 5).groupBy("query_id").agg(F.sum_distinct("looked_at").alias("n")).agg(F.avg("n")).first()[0]
    assert looked < 400 and blocks < 400  # under a tenth of the vectors
    plan = index.search(queries, 5)._jdf.queryExecution().executedPlan().toString()
    assert "codes" in plan


def test_vectors_without_structure_are_found_by_their_codes(spark, tmp_path):
    path = "/root/testdata/sf0.01"
    import os

    if not os.path.isdir(path):
        pytest.skip("no test tables here")
    vectors = spark.read.parquet(f"{path}/embeddings.parquet")
    index = vector_index.VectorIndex(spark, f"file://{tmp_path}/v")
    index.build(vectors, "label")
    queries = vectors.where("vec_id % 10 = 0")
    entry = next(iter(index.manifest.read()["data"].values()))
    assert entry["reranked"] < 50 and recall(index, vectors, queries, 5) >= 0.9


def test_a_difference_matches_once(spark):
    rows = [(1, i, f"word{i} same{i} common text number {i} " * 4) for i in range(5)] + [(2, i, f"word{i} same{i} common text number {i + i % 2} " * 4) for i in range(4)]
    units = spark.createDataFrame(rows, "doc_id long, pos int, text string")
    pair = spark.createDataFrame([(1, 2)], "old_id long, new_id long")
    found = diffing.diff(pair, units)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 0
    assert ("removed", 4, -1) in {(r.kind, r.old_pos, r.new_pos) for r in found.collect()}


def test_small_meetings_are_matched_together_and_words_are_split_once(spark, monkeypatch):
    """40 meetings of a few units, in batches that cut through them: three calls, and the partners of plain loops. Frequent words are left to single meetings."""
    r = random.Random(9)
    sets = {k: ([{f"w{r.randint(0, 9)}" for _ in range(r.randint(0, 5))} for _ in range(r.randint(0, 4))], [{f"w{r.randint(0, 9)}" for _ in range(3)} for _ in range(r.randint(0, 4))]) for k in range(40)}
    rows = [{"old_id": k, "new_id": k + 1, "old_block": 0, "new_block": 0, "new": bool(side), "pos": p, "feature": sorted(w)} for k, sides in sets.items() for side in (0, 1) for p, w in enumerate(sides[side])]
    kinds = pa.schema([(c, pa.int64()) for c in ("old_id", "new_id", "old_block", "new_block")] + [("new", pa.bool_()), ("pos", pa.int32()), ("feature", pa.list_(pa.string()))])
    batches = [pa.RecordBatch.from_pylist(rows[i : i + 60], kinds) for i in range(0, len(rows), 60)]
    want = [(k, p, *best_word_partner(old, w)) for k, (old, new) in sets.items() for p, w in enumerate(new)]
    calls = []
    for at_once in (partners.AT_ONCE, 5):
        monkeypatch.setattr(partners, "AT_ONCE", at_once)
        calls.clear()
        got = [x for b in partners._blocks(lambda *a: calls.append(1) or partners.by_words(*a))(iter(batches)) for x in zip(*(b.column(c).to_pylist() for c in ("old_id", "new_pos", "old_pos", "score")))]
        assert got == want and len(calls) <= 2 * len(batches)
    units = spark.createDataFrame([(1, 0, "a b"), (2, 0, "b c")], "doc_id long, pos int, text string")
    found = diffing.best_matches(spark.createDataFrame([(1, 2)], "old_id long, new_id long"), units)
    assert "split(" not in found._jdf.queryExecution().optimizedPlan().toString() and found.first().score == 1 / 3
