"""Answering from retrieved passages: index, pool, reranking, deduplication, context, a model or an extract, pruned citations.

A batch works on a table of questions. Models are hooks: `embed` gives a vector column for a text column, `score` a logit column for question and
passage, and a generator a text column for question and context (null where it fails). They are column expressions, so a Pandas UDF that loads a
model once a worker fits in; without any, results are deterministic.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import text as X
from quarry.operators import retrieval as R
from quarry.operators.inverted import InvertedIndex, TfidfIndex
from quarry.operators.storage import shared_dir, tasks, written

POOL, TOP, PAST, PAST_CHARS = 25, 5, 2, 400
# fixed values: what is said without passages or without a model
NOTHING = "No relevant passages found in the corpus."
EXTRACTIVE = "(Extractive mode — no model was given to write an answer.)\n"

Embed = Callable[[Column], Column]
Score = Callable[[Column, Column], Column]
Generate = Callable[[Column, Column], Column]


@dataclass
class Index:
    """Passages (key, text, ...) that are searched by words and, fused with that, by vectors or TF-IDF. The words of both are stored, and read anew by no search."""

    chunks: DataFrame
    lexical: InvertedIndex
    tfidf: TfidfIndex | None = None
    embed: Embed | None = None
    key: str = "doc_id"

    @property
    def name(self) -> str:
        return "vectors" if self.embed else "tfidf"

    def append(self, chunks: DataFrame) -> None:
        """Arrivals become segments; many small ones are merged."""
        for index in filter(None, (self.lexical, self.tfidf)):
            index.append(chunks)
            index.merge()
        self.chunks = self.chunks.unionByName(chunks)

    def search(self, questions: DataFrame, k: int, keep: Column | None = None, query: str = "item_id") -> DataFrame:
        """(query, key, score, rank) of the k best by reciprocal rank fusion; each list has the 2 k best, 10 at least. `keep` is over the columns kept in the index."""
        pool = max(2 * k, 10)
        lexical = self.lexical.bm25(questions, pool, keep, query)
        if self.embed is None:
            other = self.tfidf.cosine(questions, pool, keep, query)
        else:
            kept = self.chunks if keep is None else self.chunks.where(keep)
            vectors = kept.select(F.col(self.key).alias("vec_id"), self.embed(F.col("text")).alias("embedding"))
            asked = questions.select((-F.xxhash64(query).bitwiseAND(F.lit((1 << 62) - 1)) - 1).alias("vec_id"), query, self.embed(F.col("text")).alias("embedding"))
            found = R.dense(vectors, asked.select("vec_id", "embedding"), pool).join(asked.select(F.col("vec_id").alias("query_id"), query), "query_id")
            other = found.select(query, F.col("vec_id").alias(self.key), "score", "rank")
        return R.rrf(lexical, other, k, self.key, query)


def build_index(chunks: DataFrame, embed: Embed | None = None, key: str = "doc_id", root: str | None = None, keep: tuple[str, ...] = (), stop: Sequence[str] = R.STOP) -> tuple[Index, str]:
    """The index, stored under `root` (in the shared folder without one), and the name of its second ranker: vectors where there is an embedder, else TF-IDF with a list of stop words."""
    spark = chunks.sparkSession
    root = root or f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    lexical = InvertedIndex(spark, f"{root}/words", key=key, keep=keep)
    tfidf = None if embed else TfidfIndex(spark, f"{root}/grams-{zlib.crc32(' '.join(sorted(stop)).encode()):08x}", key=key, keep=keep, stop=stop)
    for index in filter(None, (lexical, tfidf)):
        if not index.segments():
            index.append(chunks)
    index = Index(chunks, lexical, tfidf, embed, key)
    return index, index.name


def lookup(hits: DataFrame, chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """The hits with the passages' columns, by key; hits without a passage have nulls."""
    return hits.join(chunks, key, "left")


def rerank(hits: DataFrame, score: Score | None = None, query: str = "item_id") -> DataFrame:
    """Hits (query, question, text, score, rank) in the order of a cross-scorer's logits, as probabilities; equal ones keep their order.

    Without a scorer, and for questions where it gives a null, the order stays.
    """
    if score is None:
        return hits
    scored = hits.withColumn("_logit", score(F.col("question"), F.col("text")).cast("double"))
    whole = F.count("_logit").over(Window.partitionBy(query)) == F.count("*").over(Window.partitionBy(query))
    scored = scored.withColumn("_whole", whole).withColumn("score", F.when(F.col("_whole"), 1 / (1 + F.exp(-F.col("_logit")))).otherwise(F.col("score")))
    order = Window.partitionBy(query).orderBy(F.when(F.col("_whole"), F.col("score")).desc(), "rank")
    return scored.withColumn("rank", F.row_number().over(order)).drop("_logit", "_whole")


def kept_hits(hits: DataFrame, k: int, query: str = "item_id", key: str = "doc_id") -> DataFrame:
    """(query, question, hits): of each question's passages in rank order the first k that are unlike all kept before. Pools are small (about POOL)."""
    one = F.struct("rank", F.col(key).alias("key"), X.token_set(F.col("text")).alias("words"), "score", "text", "citation")
    # pools are small and work on them is not: dealt by a stated number, which AQE doesn't join to a few tasks
    pools = hits.repartition(tasks(hits.sparkSession), query).groupBy(query).agg(F.first("question").alias("question"), F.array_sort(F.collect_list(one)).alias("pool"))
    kept = R.dedupe(F.transform("pool", lambda h: F.struct(h["rank"].cast("long").alias("key"), h["words"].alias("words"))), k)
    places = F.transform(kept, lambda x: x["key"])
    chosen = F.filter("pool", lambda h: F.array_contains(F.col("places"), h["rank"].cast("long")))
    shown = F.transform(chosen, lambda h: F.struct(h["key"].alias("key"), h["score"].alias("score"), h["text"].alias("text"), h["citation"].alias("citation")))
    return pools.withColumn("places", places).select(query, "question", shown.alias("hits"))


def context(hits: Column) -> Column:
    """The passages as a numbered block."""
    return F.array_join(F.transform(hits, lambda h, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] ("), h["citation"], F.lit(")\n"), h["text"])), "\n\n")


def with_history(question: Column, history: Column) -> Column:
    """The question after the last turns (array of struct(question, answer)), their answers cut."""
    recent = F.slice(history, F.greatest(F.size(history) - PAST + 1, F.lit(1)), PAST)
    turns = F.transform(recent, lambda t: F.concat(F.lit("Q: "), t["question"], F.lit("\nA: "), F.substring(t["answer"], 1, PAST_CHARS)))
    told = F.concat(F.lit("(Recent conversation for context:\n"), F.array_join(turns, "\n"), F.lit(")\n\nCurrent question: "), question)
    return F.when(F.size(history) > 0, told).otherwise(question)


def extract(hits: Column) -> Column:
    """The starts of the passages, numbered: the answer without a model."""
    lines = F.transform(hits, lambda h, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), X.snippet(h["text"])))
    return F.array_join(F.concat(F.array(F.lit(EXTRACTIVE)), lines), "\n\n")


def answer(index: Index, questions: DataFrame, k: int = TOP, keep: Column | None = None, score: Score | None = None, models: dict[str, Generate] | None = None, query: str = "item_id", pool: int = POOL) -> DataFrame:
    """(query, answer, sources, backend) of questions (query, text, optionally history): array of struct(key, score, text, citation) as sources.

    The models are tried in their order; the first that gives a text is the backend, else the passages' starts are the answer. Only
    cited sources stay. A question without passages gets a fixed answer and the backend "none".
    """
    hits = written(index.search(questions, max(pool, 3 * k), keep, query), "hits")
    chunks = index.chunks if "citation" in index.chunks.columns else index.chunks.withColumn("citation", F.col(index.key).cast("string"))
    asked = questions.select(query, F.col("text").alias("question"))
    chunks = chunks.select(index.key, "text", "citation")
    if hits.count() <= R.SENT:  # then texts that no question has met are in no exchange
        chunks = chunks.join(F.broadcast(hits.select(index.key).distinct()), index.key, "left_semi")
    full = lookup(hits, chunks, index.key).join(asked, query)
    found = kept_hits(rerank(full, score, query), k, query, index.key).select(query, "hits")
    rows = questions.select(query, F.col("text").alias("question"), *(["history"] if "history" in questions.columns else [])).join(found, query, "left")
    if "history" in rows.columns:
        rows = rows.withColumn("question", with_history(F.col("question"), F.col("history")))
    some = F.col("hits").isNotNull() & (F.size("hits") > 0)
    told = F.lit(None).cast("struct<text:string,backend:string>")
    for name, model in (models or {}).items():
        said = model(F.col("question"), context(F.col("hits")))
        told = F.coalesce(told, F.when(said.isNotNull(), F.struct(said.alias("text"), F.lit(name).alias("backend"))))
    told = F.coalesce(told, F.struct(extract(F.col("hits")).alias("text"), F.lit("extractive").alias("backend")))
    rows = rows.withColumn("told", F.when(some, told))
    text, sources = X.prune_citations(F.col("told.text"), F.col("hits"))
    empty = F.array().cast(rows.schema["hits"].dataType)
    return rows.select(query, F.when(some, text).otherwise(NOTHING).alias("answer"), F.when(some, sources).otherwise(empty).alias("sources"), F.when(some, F.col("told.backend")).otherwise("none").alias("backend"))
