"""Ranked lexical search by windowed bucket scoring.

Scanning tasks turn every text into a small row: its number of terms, and of the questions' terms those it holds, with their counts; sums of
these give N, L and the documents of each term. The rows are then sorted by doc_id and met in windows of fixed ranges of WINDOW ids: a window's rows become
posting lists (term -> slots of the window), each posting's part of a score is computed once, and every question adds its terms' parts into an array of one cell a slot
while a bitset marks the cells in use; those are harvested into the question's heap of the TOP best. Tasks hand on TOP rows a question, which are merged by rank. Questions are answered in
blocks of at most QUESTION_TERMS terms, so what is sent to the tasks is bounded whatever the table of questions.

Equal scores are ordered by doc_id, documents without an id last. Rows that share a doc_id (or have none) are documents of their own: a window with more rows than slots is cut,
and nothing else depends on where a row lies. Questions that share an item_id are one question with the terms of all; a question without terms, or whose terms no
document holds with a weight above 0, has no rows. Null texts have no terms. Empty tables give no rows. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm import terms
from quarry.llm.common import cut, drop_cut, table, trim

TOP = 50
#: Ids of a window, and slots of its arrays: 8 bytes each, so an array stays in a core's cache.
WINDOW = 1 << 15
#: Question terms (of all questions of a block, with repeats) that are sent to the tasks at once, about 20 MB.
QUESTION_TERMS = 1 << 18
_ROWS = "kind byte, doc_id long, deal long, n long, term array<int>, tf array<int>"


def _scan(wanted):
    """Rows of documents (kind 0: id, terms, ids and counts of wanted terms) and of the documents of each term (kind 1: doc_id is the term)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = wanted.value
        df = np.zeros(len(ids), np.int64)
        deal = 0

        def packed(kind, doc_ids, deals, ns, parts, tfs):
            ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*x, np.zeros(0, np.int32)]).astype(np.int32))) for x in (parts, tfs)]
            return pa.RecordBatch.from_arrays([pa.array([kind] * len(ns), pa.int8()), pa.array(doc_ids, pa.int64()), pa.array(deals, pa.int64()), pa.array(ns, pa.int64()), *lists], names=["kind", "doc_id", "deal", "n", "term", "tf"])

        for batch in batches:
            ns, parts, tfs = [], [], []
            for text in terms.raw(batch.column(1)):
                n, held = 0, Counter()
                for words in terms.blocks(text, terms.LETTERS_AND_DIGITS):
                    n += len(words)
                    times = Counter(words)
                    for w in times.keys() & ids.keys():
                        held[ids[w]] += times[w]
                part = np.fromiter(held.keys(), np.int32, len(held))
                df[part] += 1
                ns.append(n)
                parts.append(part)
                tfs.append(np.fromiter(held.values(), np.int32, len(held)))
            yield packed(0, batch.column(0), range(deal, deal + len(ns)), ns, parts, tfs)
            deal += len(ns)
        some = np.flatnonzero(df)
        none = [np.zeros(0, np.int32)] * len(some)
        yield packed(1, some, some, df[some], none, none)
        trim()

    return run


def _search(plan):
    """Sorted rows of documents -> the best of each question among a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, names, questions, docs, total, top, slots = plan.value
        heaps: list[list[tuple[int, int, int | None]]] = [[] for _ in questions]
        score, used = np.zeros(slots, np.int64), np.zeros(slots, bool)

        def window(doc_ids: list[int | None], ns: np.ndarray, sizes: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
            m = 50 + 50 * ns * docs // total
            slot = np.repeat(np.arange(len(ns)), sizes)
            order = np.argsort(term, kind="stable")
            term, slot, tf = term[order], slot[order], tf[order].astype(np.int64)
            part = weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[slot]))
            lists = np.searchsorted(term, np.arange(len(weights) + 1))
            for heap, asked in zip(heaps, questions, strict=True):
                for t in asked:
                    low, high = lists[t], lists[t + 1]
                    if low < high:
                        score[slot[low:high]] += part[low:high]  # a document is once in a list
                        used[slot[low:high]] = True
                found = np.flatnonzero(used)
                if not len(found):
                    continue
                got = score[found]
                score[found], used[found] = 0, False
                least = heap[0][0] if len(heap) == top else 1
                better = np.flatnonzero(got >= least)
                if len(better) > top:  # all that could be among the best, ties included
                    better = better[got[better] >= np.partition(got[better], -top)[-top]]
                for i in better.tolist():
                    doc = doc_ids[found[i]]
                    entry = (int(got[i]), doc is not None, -(doc or 0), doc)
                    if len(heap) < top:
                        heapq.heappush(heap, entry)
                    elif entry[:3] > heap[0][:3]:
                        heapq.heapreplace(heap, entry)

        open_at, held = None, []  # the window's number, its pieces of batches

        def close() -> None:
            if held:
                ids = [x for piece in held for x in piece[0]]
                window(ids, *(np.concatenate([piece[k] for piece in held]) for k in range(1, 5)))
                held.clear()

        for batch in batches:
            doc_ids, ns = batch.column("doc_id").to_pylist(), batch.column("n").to_numpy()
            lists = [batch.column(c) for c in ("term", "tf")]
            at = lists[0].offsets.to_numpy()
            term, tf = (x.values.to_numpy() for x in lists)
            numbers = [None if x is None else x // slots for x in doc_ids]
            i = 0
            while i < len(ns):
                room = slots - sum(len(piece[0]) for piece in held)
                if held and (numbers[i] != open_at or not room):
                    close()
                    room = slots
                open_at, j = numbers[i], i + 1
                while j < len(ns) and j - i < room and numbers[j] == open_at:
                    j += 1
                held.append((doc_ids[i:j], ns[i:j], np.diff(at[i : j + 1]), term[at[i] : at[j]], tf[at[i] : at[j]]))
                i = j
        close()
        rows = [(name, e[3], e[0]) for name, heap in zip(names, heaps, strict=True) for e in heap]
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["item_id", "doc_id", "score"])
        trim()

    return run


def question_terms(questions: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (item_id, term)."""
    lower = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return questions.select(F.col(key).cast("long").alias("item_id"), F.explode(F.regexp_extract_all(lower, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))).alias("term")).distinct()


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def _block(docs: DataFrame, asked: DataFrame, top: int, doc_id: str, text: str) -> DataFrame:
    """The answers of one block of questions (item_id, term)."""
    spark = docs.sparkSession
    items: dict[int | None, list[str]] = {}
    for r in asked.collect():
        items.setdefault(r["item_id"], []).append(r["term"])
    wanted = {t.encode(): i for i, t in enumerate(sorted({t for x in items.values() for t in x}))}
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = cut(rows.mapInArrow(_scan(spark.sparkContext.broadcast(wanted)), _ROWS), "postings")
    sums = found.where("kind = 0 and n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("total")).first()
    df = {r["doc_id"]: r["df"] for r in found.where("kind = 1").groupBy("doc_id").agg(F.sum("n").alias("df")).collect()}
    weights = np.array([weight(sums["docs"], df.get(i, 0)) for i in range(len(wanted))], np.int64)
    names = list(items)
    questions = [np.array([wanted[t.encode()] for t in items[x]], np.int64) for x in names]
    plan = spark.sparkContext.broadcast((weights, names, questions, sums["docs"], sums["total"] or 1, top, WINDOW))
    rows = found.where("kind = 0 and size(term) > 0").select("doc_id", "deal", "n", "term", "tf")
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_last(), "deal").sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "deal").drop("deal")
    best = rows.mapInArrow(_search(plan), "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    best = cut(best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top), "answers")
    drop_cut(found)
    return best.select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, questions: DataFrame, top: int = TOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", question: str = "text", most: int | None = None) -> DataFrame:
    """(item_id, rank, doc_id, score) of each question's `top` best documents."""
    most = most or QUESTION_TERMS
    asked = question_terms(questions, item_id, question)
    sizes = asked.groupBy("item_id").agg(F.count("*").alias("terms"))
    blocks = max(1, -(-2 * (sizes.agg(F.sum("terms")).first()[0] or 0) // most))  # twice as many as even ones need
    out = None
    for k in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        got = _block(docs, part, top, doc_id, text)
        out = got if out is None else out.unionByName(got)
    return out


def op13(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents WHERE text IS NOT NULL),
 s AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS total FROM d WHERE len(w) > 0),
 q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
 p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) SEMI JOIN q USING (term) GROUP BY ALL),
 i AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM p, s GROUP BY term),
 m AS (SELECT r, doc_id, 50 + (50 * len(w) * docs) // total AS m FROM d, s WHERE len(w) > 0),
 x AS (SELECT item_id, r, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN p USING (term) JOIN i USING (term) JOIN m USING (r) GROUP BY ALL)
 SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM x WHERE score > 0) WHERE rank <= {TOP}"""
