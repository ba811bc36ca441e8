"""Source divergence, line quality and ranked search against brute force, with nulls, empty and long texts, ties, repeated rows, extra columns."""

import itertools
import math
import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import divergence, lexical_search, line_crf, terms
from quarry.llm.hashing import utf8

LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
AUDIT = ("lang", "source", "part", "item", "value", "rank")


def words(pattern, text):
    return pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def crowd(seed=4, n=400):
    """Documents of two languages and many sources from few words; ids repeat, one is null, some texts and sources are too."""
    r = random.Random(seed)
    bag = ["the", "Of", "été", "x9y", "ñandú", "中文", "AB-cd", "e", "zz", "𐐷x", "q_r"] + [f"w{c}" for c in "abcdefghijklmnopqrst"]
    rows = []
    for i in range(n):
        text = " ".join(r.choice(bag[: r.randint(3, len(bag))]) for _ in range(r.randint(0, 40)))
        rows.append((i // 2 if i % 9 == 0 else 7 * i, r.choice((text, text, text, None, "")) if i % 11 == 0 else text, r.choice(("en", "fr", None, "xx")) if i % 5 == 0 else "en", f"s{r.randint(0, 12)}" if i % 7 else None))
    rows += [rows[3]] * 12 + [(None, "the of the", "en", "s1"), (None, None, "yy", "only"), (None, "the of the", "en", "s1")]
    return rows


def frame(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    extra = {c: F.lit("other") for c in ("term", "n", "block", "chunk", "rank", "score", "kind", "p", "size", "held_out", "quality", "item_id")}
    return docs.withColumns(extra)


def plain_audit(rows, least=10, top=10):
    groups, langs, df = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        w = words(LETTERS, text)
        groups[lang or "", source or ""].update(w)
        langs[lang or ""].update(w)
        df[lang or ""].update(set(w))
    out = []
    apart = lambda p, q: (p - q) ** 2 // (p + q)
    for (lang, source), own in groups.items():
        kept = [t for t in df[lang] if df[lang][t] >= least]

        def chance(counts):
            size = sum(counts[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // size for t in kept}

        p, q = chance(own), chance(langs[lang])
        pairs = []
        for (other, item), counts in groups.items():
            if other == lang and item != source:
                o = chance(counts)
                pairs.append((sum(apart(p[t], o[t]) for t in kept), item))
        typical = [(apart(p[t], q[t]), t) for t in kept if own[t] > 0 and p[t] > q[t]]
        order = lambda x: (-x[0], x[1].encode())
        out += [(lang, source, "pair", item, v, i + 1) for i, (v, item) in enumerate(sorted(pairs, key=order))]
        out += [(lang, source, "term", item, v, i + 1) for i, (v, item) in enumerate(sorted(typical, key=order)[:top])]
    return out


@pytest.mark.parametrize("sizes", [(8, 1024, 16), (2, 4, 2), (1, 1, 1)])
def test_divergence_is_that_of_a_plain_loop(spark, monkeypatch, sizes):
    for name, value in zip(("SIDE", "CHUNK", "STRIP"), sizes):
        monkeypatch.setattr(divergence, name, value)
    rows = crowd()
    got = divergence.audit(frame(spark, rows))
    assert got.columns == list(AUDIT)
    want = plain_audit(rows)
    assert any(r[2] == "term" for r in want) and sorted(map(tuple, got.collect())) == sorted(want)


def test_divergence_without_rows_or_vocabulary(spark):
    assert divergence.audit(frame(spark, []).select("doc_id", "text", "lang", "source")).count() == 0
    got = divergence.audit(spark.createDataFrame([(1, "a b", "en", "x"), (2, None, "en", "y"), (3, "a", "fr", "x")], "doc_id long, text string, lang string, source string"))
    assert sorted(map(tuple, got.collect())) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_counts_are_passed_on_in_parts_and_divided_exactly(monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 3)
    rows = crowd(9, 60)
    batch = pa.RecordBatch.from_arrays([pa.array([r[k] or "" for r in rows], pa.string()) for k in (2, 3, 1)], names=["lang", "source", "text"])
    parts = list(divergence._count(iter([batch.slice(0, 20), batch.slice(20)])))
    got, want = Counter(), Counter()
    for part in parts:
        for lang, source, term, n, df in zip(*(c.to_pylist() for c in part.columns)):
            got[lang, source, term, "n"] += n
            got[lang, source, term, "df"] += df
    for _, text, lang, source in rows:
        w = words(LETTERS, text)
        want[lang or "", source or "", "", "df"] += 1
        for t in w:
            want[lang or "", source or "", t, "n"] += 1
        for t in set(w):
            want[lang or "", source or "", t, "df"] += 1
    assert len(parts) > 20 and +got == want
    n, size = np.array([[0, 5, 10**15 - 4, 3 * 10**14]]), np.array([[7], [10**15]])
    for i in range(2):
        for j in range(4):
            if n[0, j] + 2 <= size[i, 0]:
                assert divergence._long_division(n, size)[i, j] == 1 + 10**9 * (int(n[0, j]) + 2) // int(size[i, 0])


def test_terms_of_long_texts_are_whole(monkeypatch):
    monkeypatch.setattr(terms, "_BLOCK", 10)
    r = random.Random(2)
    for _ in range(200):
        text = "".join(r.choice("aZ é9_\n中𐐷-") * r.randint(1, 9) for _ in range(r.randint(0, 30)))
        for pattern, table in ((LETTERS, terms.LETTERS), (ALNUM, terms.LETTERS_AND_DIGITS)):
            assert [w.decode() for b in terms.blocks(text.encode(), table) for w in b] == words(pattern, text)
    monkeypatch.setattr(terms, "_BLOCK", 1 << 12)
    assert [w for b in terms.blocks(b"x" * 30_000 + b" y", terms.LETTERS) for w in b] == [b"x" * 30_000, b"y"]
    assert list(terms.blocks(None, terms.LETTERS)) == list(terms.blocks(b"", terms.LETTERS)) == []


def plain_search(rows, questions, top):
    texts = [(r[0], Counter(words(ALNUM, r[1]))) for r in rows]
    texts = [(i, c) for i, c in texts if c]
    N, L, df = len(texts), sum(sum(c.values()) for _, c in texts), Counter(t for _, c in texts for t in c)
    items = defaultdict(set)
    for item, text in questions:
        items[item] |= set(words(ALNUM, text))
    out = []
    for item, asked in items.items():
        scored = []
        for i, c in texts:
            m = 50 + 50 * sum(c.values()) * N // L
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in asked if t in c)
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scored, key=lambda x: x[:2] + (x[2] or 0,))[:top])]
    return out


QUESTIONS = [(1, "THE of été"), (2, "wa wb, wc"), (2, "wd"), (3, ""), (4, None), (5, "unknown"), (6, "q_r x9y e ñandú 中文"), (None, "zz cd"), (7, "The the THE")]


@pytest.mark.parametrize("window,most,top", [(1 << 15, 1 << 18, 50), (8, 6, 50), (3, 1 << 18, 4), (1, 4, 1)])
def test_search_is_that_of_a_plain_loop(spark, monkeypatch, window, most, top):
    monkeypatch.setattr(lexical_search, "WINDOW", window)
    rows = crowd(6, 300)
    asked = spark.createDataFrame(QUESTIONS, "item_id long, text string").withColumn("term", F.lit(1)).withColumn("rank", F.lit(2))
    got = lexical_search.search(frame(spark, rows), asked, top, most=most)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain_search(rows, QUESTIONS, top), key=key)


def test_search_of_nothing(spark):
    docs, asked = "doc_id long, text string", "item_id long, text string"
    some, question = spark.createDataFrame([(1, "a b"), (2, None)], docs), spark.createDataFrame([(1, "a")], asked)
    assert lexical_search.search(some.limit(0), question).count() == lexical_search.search(some, question.limit(0)).count() == 0
    assert lexical_search.search(some.where("doc_id = 2"), question).count() == 0
    assert [tuple(r) for r in lexical_search.search(some, question).collect()] == plain_search([(1, "a b")], [(1, "a")], 50)


@pytest.mark.parametrize("module,name", [(divergence, "op11"), (lexical_search, "op13")])
def test_queries_give_what_their_sql_gives(spark, small, module, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    want = c.execute(module.ORACLE)
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, getattr(module, name)(spark, small).select(*names).collect())) == sorted(want.fetchall())


def lines_of(texts):
    return line_crf.measure(*utf8(pa.array(texts, pa.string())))


def plain_bins(text, table):
    """One line's own measures, in plain Python."""
    seen, out = set(), []
    lines = (text or "").split("\n")
    blank = re.compile(rb"[^ \t\n\x0b\x0c\r]+")
    low = [[w.lower() for w in blank.findall(x.encode())] for x in lines]
    low = [[re.sub(rb"[A-Z]", lambda m: m[0].lower(), w) for w in blank.findall(x.encode())] for x in lines]
    windows = Counter(tuple(w[i : i + 5]) for w in low for i in range(len(w) - 4))
    for x, w in zip(lines, low):
        raw = x.encode()
        count = lambda chars: sum(b in chars for b in raw)  # noqa: B023, E731
        solid, letters = sum(map(len, w)), sum(97 <= (b | 32) <= 122 and b < 128 for b in raw)
        own = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        values = {
            "symbols": count(b"#*$%&<>@^_~`=+\\{}[]/") / max(solid, 1), "shouts": count(b"!?") / max(solid, 1), "capitals": count(bytes(range(65, 91))) / max(letters, 1),
            "digits": count(b"0123456789") / max(solid, 1), "bars": count(b"|") / max(solid, 1), "stops": count(b".,;:") / max(solid, 1),
            "repeated": sum(windows[k] > 1 for k in own) / max(len(own), 1), "echoes": sum(a == b for a, b in zip(w, w[1:])) / max(len(w), 1),
        }
        place = lambda v, edges: sum(v >= e for e in edges)
        row = {k: place(v, line_crf.SHARES) for k, v in values.items()}
        row |= {"before": int(bool(w) and tuple(w) in seen), "mean word": place(solid / max(len(w), 1), line_crf.MEANS), "words": place(len(w), line_crf.SIZES), "ends": int(raw[-1:] in (b".", b"!", b"?", b":", b";") and raw != b"")}
        seen.add(tuple(w))
        out.append([row[k] for k in table])
    return out


def test_line_measures_are_those_of_plain_python(monkeypatch):
    r = random.Random(8)
    bag = ["The", "was", "WAS", "und", "|", "###", "é!", "a.b", "12", "x;", "Foo:", "long" * 6]
    texts = ["", None, "\n", "a\n\na\n", " \x0b\n\t", "one two three four five six"]
    texts += ["\n".join(" ".join(r.choice(bag[: r.randint(1, 12)]) for _ in range(r.randint(0, 30))) for _ in range(r.randint(1, 9))) for _ in range(80)]
    texts += ["\n".join(["same line of some words here"] * 4), "w " * 50_000 + "\n" + "x" * 70_000]
    got = lines_of(texts)
    assert len(got.first) == len(texts) + 1
    for i, t in enumerate(texts):
        own = plain_bins(t, line_crf.OWN)
        bins = got.bins[got.first[i] : got.first[i + 1]]
        assert bins[:, : len(line_crf.OWN)].tolist() == own
        at = [line_crf.OWN.index(b) for b in line_crf.BESIDE]
        none = [line_crf.NONE] * len(at)
        left = [none] + [[x[k] for k in at] for x in own[:-1]]
        right = [[x[k] for k in at] for x in own[1:]] + [none]
        assert bins[:, len(line_crf.OWN) :].tolist() == [a + b for a, b in zip(left, right)]
        assert got.weight[got.first[i] : got.first[i + 1]].tolist() == [len(x.encode()) for x in (t or "").split("\n")]


def random_chain(seed):
    r = np.random.default_rng(seed)
    return line_crf.Chain(r.normal(size=(line_crf.FEATURES, line_crf.BINS)), r.normal(size=(2, 2)))


def test_marginals_are_those_of_all_labellings():
    r = np.random.default_rng(1)
    counts = [1, 4, 2, 7, 1, 3]
    first = np.concatenate([[0], np.cumsum(counts)])
    bins = r.integers(0, line_crf.BINS, (first[-1], line_crf.FEATURES)).astype(np.uint8)
    chain = random_chain(2)
    got, expected, log_sum = chain.marginals(bins, first, pairs=True)
    e = chain.emissions(bins)
    all_pairs, all_logs = np.zeros((2, 2)), 0.0
    for a, b in zip(first[:-1], first[1:]):
        total, good, pairs = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(b - a)):
            w = math.exp(sum(e[a + i] for i in range(b - a) if y[i]) + sum(chain.steps[s] for s in zip(y, y[1:])))
            total += w
            good += w * np.array(y)
            for s in zip(y, y[1:]):
                pairs[s] += w
        assert np.allclose(got[a:b], good / total)
        all_pairs += pairs / total
        all_logs += math.log(total)
    assert np.allclose(expected, all_pairs) and math.isclose(log_sum, all_logs)
    score = chain.score(line_crf.Lines(bins, np.arange(first[-1], dtype=float), first))
    assert score[0] == got[0] and np.isclose(score[1], (got[1:5] * np.arange(1, 5)).sum() / 10)


def test_gradient_is_that_of_the_likelihood():
    r = np.random.default_rng(3)
    first = np.array([0, 3, 4, 9])
    bins = r.integers(0, line_crf.BINS, (9, line_crf.FEATURES)).astype(np.uint8)
    good = r.integers(0, 2, 9).astype(float)
    chain = random_chain(4)
    _, by_weight, by_step = chain.gradient(bins, first, good)
    for params, grad, places in ((chain.weights, by_weight, [(0, bins[0, 0]), (5, bins[4, 5]), (11, 3)]), (chain.steps, by_step, [(0, 0), (0, 1), (1, 0), (1, 1)])):
        for at in places:
            old, near = params[at], []
            for h in (1e-5, -1e-5):
                params[at] = old + h
                near.append(chain.gradient(bins, first, good)[0])
            params[at] = old
            assert abs((near[0] - near[1]) / 2e-5 - grad[at]) < 1e-4


def test_quality_of_edge_rows(spark):
    rows = [(i, t, "en", "s") for i, t in enumerate([None, "", "\n\n", "good words in a line.\n" * 3, "x" * 300_000, "##!! ||\n" * 2000])] + [(None, "a b c", None, None), (3, "good words in a line.\n" * 3, "fr", None)]
    docs = frame(spark, rows)
    labels = "doc_id long, quality int, toxic int"
    got = line_crf.classify(docs, line_crf.learn(docs, spark.createDataFrame([], labels)))
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and {(r.score, r.predicted) for r in got.collect()} == {(0.5, 1)}
    some = spark.createDataFrame([(i, int(i < 4), 0) for i in range(6)] * 2 + [(None, 1, 0), (3, None, 0), (99, 0, 0)], labels)
    chain = line_crf.learn(docs, some)
    rows = line_crf.classify(docs, chain).collect()
    assert len(rows) == 8 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert len({r.score for r in rows if r.doc_id == 3}) == 1 and len({r.score for r in rows if r.doc_id in (0, 1)}) == 1
    assert all(r.held_out == (r.doc_id is not None and __import__("zlib").crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert line_crf.classify(docs.limit(0), chain).count() == 0


def test_held_out_accuracy_and_nothing_held_out_is_learned(spark):
    path = "/root/testdata/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("no test tables here")
    labels = spark.read.parquet(f"{path}/labels.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    known = {r.doc_id: r.quality for r in labels.collect()}
    got = [r for r in line_crf.op12(spark, path).collect() if r.held_out and r.doc_id in known]
    assert len(got) > 50 and sum(r.predicted == known[r.doc_id] for r in got) >= 0.95 * len(got)
    turned = labels.withColumn("quality", F.when(line_crf.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = line_crf.learn(docs, labels), line_crf.learn(docs.withColumn("lang", F.lit("q")).withColumn("source", F.col("doc_id")), turned)
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.steps, b.steps)
