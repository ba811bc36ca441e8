"""Lexical, vector and fused retrieval over DataFrames; ranks are explicit and ties go to the smaller key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.text import tokens
from quarry.operators.storage import ship

K1, B, RRF_K = 1.5, 0.75, 60
#: At most so many query vectors, hits or terms are sent to all tasks; more are joined by shuffle.
SENT = 65_536
#: Of vectors and texts so many bytes at most.
SENT_BYTES = 64 << 20
#: Vectors that a block of queries meets in one task.
SLICE = 8192


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text", words=tokens) -> DataFrame:
    """(key, term, tf) of every document."""
    return docs.select(key, F.explode(words(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def idf_table(posts: DataFrame, n: int | Column) -> DataFrame:
    df = posts.groupBy("term").agg(F.count("tf").alias("df"))  # tf is never null; asking for it lets both uses of the postings share their exchange
    n = n if isinstance(n, Column) else F.lit(n)
    return df.withColumn("idf", F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1))


def ranked(scores: DataFrame, query: str, key: str, k: int) -> DataFrame:
    """The k best of each query. Scores are compared at 9 decimals, so the order of summation can't reorder equal documents."""
    order = Window.partitionBy(query).orderBy(F.round("score", 9).desc(), key)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bm25(docs: DataFrame, queries: DataFrame, k: int, keep: Column | None = None, key: str = "doc_id", query: str = "item_id") -> DataFrame:
    """(query, key, score, rank). `keep` filters what is ranked; statistics always cover all documents.

    One scan sums the lengths; another one emits the words, of which only those that a query has (a small table, broadcast where AQE finds it
    so) are counted into postings. Whole postings are never shuffled.
    """
    terms = queries.select(query, F.explode(tokens(F.col("text"))).alias("term")).groupBy(query, "term").agg(F.count("*").alias("q"))
    flag = (F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))).alias("keep")
    words = docs.select(key, flag, tokens(F.col("text")).alias("words"))
    stats = words.agg(F.count("*").alias("n"), F.avg(F.coalesce(F.size("words"), F.lit(0))).alias("avg_len")).first()
    n, avg_len = stats["n"], stats["avg_len"] or 1.0
    rows = words.select(key, "keep", F.size("words").alias("len"), F.explode("words").alias("term")).join(terms.select("term").distinct(), "term")
    posts = rows.groupBy(key, "keep", "len", "term").agg(F.count("*").alias("tf"))
    weighed = posts.join(idf_table(posts, n), "term").where("keep")
    norm = K1 * (1 - B + B * F.col("len") / avg_len)
    weighed = weighed.select(key, "term", (F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)).alias("w"))
    scores = weighed.join(terms, "term").groupBy(query, key).agg(F.sum(F.col("q") * F.col("w")).alias("score"))
    return ranked(scores.where("score > 0"), query, key, k)


# fixed values: our own short list, where no other is given; the weights of very frequent words are small in any case
STOP = tuple("a an and are as at be by for from has have he in is it its of on or that the this to was were will with".split())
# fixed values: letters, digits and underscores of any script, two or more
GRAM_WORD = r"[\p{L}\p{N}_]{2,}"


def gram_words(c: Column, stop: Sequence[str] = STOP) -> Column:
    """Words in order but for stop words. `stop` may be a list of any length, as other libraries have them."""
    words = F.regexp_extract_all(F.lower(c), F.lit(GRAM_WORD), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*stop)) if stop else words


def uni_bigrams(c: Column, stop: Sequence[str] = STOP) -> Column:
    """Words but for stop words, and pairs of neighbours among what is left; the words are extracted once."""
    words = gram_words(c, stop)
    pairs = lambda w: F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.transform(F.array(words), lambda w: F.concat(w, pairs(w))).getItem(0)


FEATURES = 50_000


def tfidf(docs: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", query: str = "item_id", features: int = FEATURES, keep: Column | None = None, stop: Sequence[str] = STOP) -> DataFrame:
    """Cosine of sublinear tf, smooth idf vectors over the `features` words and word pairs that occur most (ties to the smaller term).

    Queries with fewer than k documents of a positive score are filled up with documents of score 0, by key. `keep` filters what is ranked.
    """
    n = docs.count()
    grams = uni_bigrams(F.col("text"), stop)
    one = lambda d, t: lambda w: F.struct(w.alias("term"), F.lit(d).alias("d"), F.lit(t).alias("t"))
    both = F.transform(F.array(grams), lambda g: F.concat(F.transform(F.array_distinct(g), one(1, 0)), F.transform(g, one(0, 1)))).getItem(0)
    by_count = docs.select(F.inline(both)).groupBy("term").agg(F.sum("d").alias("df"), F.sum("t").alias("times"))  # combined before the shuffle
    weights = by_count.orderBy(F.desc("times"), "term").limit(features).select("term", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf"))
    weights = F.broadcast(weights) if features <= SENT else weights
    w = (1 + F.log(F.col("tf"))) * F.col("idf")
    known = docs.select(key, F.explode(grams).alias("term")).join(weights, "term")
    doc = known.groupBy(key, "term", "idf").agg(F.count("*").alias("tf")).select(key, "term", w.alias("w"))
    norms = doc.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    q = postings(queries, query, words=partial(uni_bigrams, stop=stop)).join(weights, "term").select(query, "term", w.alias("qw"))
    qnorms = q.groupBy(query).agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm"))
    if keep is not None:
        doc = doc.join(docs.where(keep).select(key), key, "left_semi")
    dots = q.join(doc, "term").groupBy(query, key).agg(F.sum(F.col("qw") * F.col("w")).alias("dot"))
    scores = dots.join(norms, key).join(qnorms, query).select(query, key, (F.col("dot") / (F.col("norm") * F.col("qnorm"))).alias("score"))
    best = ranked(scores, query, key, k)
    # at most k documents of a query have a positive score and come first, so 2 k of the smallest keys hold enough others
    few = [r[0] for r in (docs if keep is None else docs.where(keep)).select(key).orderBy(key).limit(2 * k).collect()]
    have = best.groupBy(query).agg(F.collect_list(key).alias("have"))
    kind = have.schema["have"].dataType
    short = queries.select(query).distinct().join(have, query, "left").withColumn("have", F.coalesce("have", F.array().cast(kind))).where(F.size("have") < k)
    spare = F.array(*map(F.lit, few)).cast(kind)
    rest = F.slice(F.array_except(spare, "have"), 1, k - F.size("have"))
    filled = short.select(query, F.size("have").alias("n"), F.posexplode(rest).alias("place", key))
    return best.unionByName(filled.select(query, key, F.lit(0.0).alias("score"), (F.col("n") + F.col("place") + 1).alias("rank")))


def rrf(first: DataFrame, second: DataFrame, k: int, key: str = "doc_id", query: str = "item_id") -> DataFrame:
    """Reciprocal rank fusion of two ranked lists; ties keep the order of the first list, then the second."""
    lists = first.select(query, key, "rank", F.lit(1).alias("list")).unionByName(second.select(query, key, "rank", F.lit(2).alias("list")))
    place = lambda i: F.min(F.when(F.col("list") == i, F.col("rank")))
    fused = lists.groupBy(query, key).agg(F.sum(1 / (RRF_K + F.col("rank"))).alias("score"), place(1).alias("r1"), place(2).alias("r2"))
    order = Window.partitionBy(query).orderBy(F.round("score", 9).desc(), F.col("r1").asc_nulls_last(), F.col("r2").asc_nulls_last(), key)
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("r1", "r2")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector scaled to length 1; its norm is taken once."""
    return F.transform(F.array(F.sqrt(dot(v, v))), lambda n: F.transform(v, lambda x: x / n)).getItem(0)


def _arrays(column: pa.ChunkedArray) -> list:
    """A list of numbers each as an array; none for a null or a list with nulls."""
    out = []
    for part in column.chunks:
        flat, ends, null = part.values, part.offsets.to_numpy(), part.is_null().to_numpy(zero_copy_only=False)
        values, gap = flat.to_numpy(zero_copy_only=False).astype(float), np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
        out += [None if no or gap[b] > gap[a] else values[a:b] for no, a, b in zip(null, ends[:-1], ends[1:], strict=True)]
    return out


def _products(queries: list, vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """Products of each query and each vector, and where there is one: both are given and equally long."""
    one, two = (np.array([-1 if x is None else len(x) for x in xs], np.int64) for xs in (queries, vectors))
    out = np.zeros((len(queries), len(vectors)))
    for n in np.intersect1d(one[one >= 0], two[two >= 0]):
        i, j = np.flatnonzero(one == n), np.flatnonzero(two == n)
        out[np.ix_(i, j)] = np.stack([queries[x] for x in i]) @ np.stack([vectors[x] for x in j]).T
    return out, (one[:, None] == two) & (one[:, None] >= 0)


def _nearest(k: int, same: bool):
    """The k best vectors of a slice for each query of a block, a few queries at a time."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks().sort_by("vec_id")
        asked, held = rows.filter(rows["asks"]), rows.filter(pc.invert(rows["asks"]))
        vectors, ids, q_ids = _arrays(held["v"]), held["vec_id"].to_numpy(), asked["vec_id"].to_numpy()
        label, q_label = (np.array(t["same"].to_pylist(), object) if same else None for t in (held, asked))
        q_vectors, out = _arrays(asked["v"]), ([], [], [])
        for at in range(0, len(q_ids) if len(ids) else 0, 512):
            some = slice(at, at + 512)
            score, known = _products(q_vectors[some], vectors)
            order = np.where(known, np.nan_to_num(np.round(score, 9), nan=np.inf), -1e300)
            other = q_ids[some, None] != ids
            if same:
                other &= (q_label[some, None] == label) & (label != None)  # noqa: E711
            order[~other] = -np.inf
            least = -np.partition(-order, k - 1, axis=1)[:, k - 1] if k < len(ids) else np.full(len(order), -np.inf)
            for i, row in enumerate(order):
                found = np.flatnonzero((row >= least[i]) & other[i])  # by id
                found = found[np.argsort(-row[found], kind="stable")[:k]]
                out[0].append(np.repeat(q_ids[at + i], len(found)))
                out[1].append(ids[found])
                out[2].append(np.where(known[i, found], score[i, found], np.nan))
        none = np.zeros(0, np.int64)
        q, v, s = (np.concatenate([none, *x]) if x else none for x in out)
        return pa.table([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s.astype(float), pa.float64(), from_pandas=True)], names=["query_id", "vec_id", "score"])

    return run


def dense(vectors: DataFrame, queries: DataFrame, k: int, same: str | None = None, block: int = 8192) -> DataFrame:
    """Exact cosine top-k of each query vector against all vectors, itself excluded; `same` is a column that must agree.

    Blocks of about `block` queries meet slices of about SLICE vectors, each in a task, by products of matrices; a meeting returns its own k best of
    a query. An exact search, not a join on similarity. A pair without a score (a null in either vector, or other lengths) ranks last.
    """
    ship(vectors.sparkSession)
    label = F.col(same) if same else F.lit(None).cast("int")
    shape = lambda df, asks: df.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("same"), unit(F.col("embedding")).alias("v"), F.lit(asks).alias("asks"))
    blocks, slices = (max(1, -(-df.count() // n)) for df, n in ((queries, block), (vectors, SLICE)))
    mine = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = shape(vectors, False).select("*", mine(slices).alias("slice"), every(blocks).alias("block"))
    asked = shape(queries, True).select("*", mine(blocks).alias("block"), every(slices).alias("slice"))
    scores = held.unionByName(asked).groupBy("block", "slice").applyInArrow(_nearest(k, bool(same)), "query_id long, vec_id long, score double")
    return ranked(scores, "query_id", "vec_id", k)


def dedupe(ranked_texts: Column, k: int | None = None, most: float = 0.85) -> Column:
    """Of an array of structs (key, words) in rank order, those whose words aren't too similar to any kept before; with k, the first k of them."""
    kept_type = "array<struct<key:bigint,words:array<string>>>"

    def similar(a: Column, b: Column) -> Column:
        both = F.size(F.array_intersect(a, b))
        return (F.size(a) > 0) & (F.size(b) > 0) & (both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1)) > most)

    def step(kept: Column, x: Column) -> Column:
        full = F.size(kept) >= k if k is not None else F.lit(False)
        return F.when(full | F.exists(kept, lambda y: similar(y["words"], x["words"])), kept).otherwise(F.array_append(kept, x))

    return F.aggregate(ranked_texts, F.array().cast(kept_type), step)
