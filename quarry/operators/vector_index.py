"""An approximate vector index: a trained coarse quantiser with inverted lists, product-quantised codes, exact re-ranking.

A bounded sample trains two quantisers: centroids, each with a list of the vectors nearest to it, and for every part of a vector 256 code words for what
is left of it beside its centroid. All vectors are encoded, a byte a part, and stored in blocks of a list, sorted by list. A question looks into its PROBED nearest
lists only: each task makes a table of the question's products with all code words and adds up a byte's entry a part, so no stored
vector is read; labels that must agree are compared in the lists, before the best are chosen. The best by codes are ranked by their exact cosines, read by id. `retrieval.dense` is the exact way.

How many lists a question looks into and how many candidates are ranked exactly follows from the data: when the index is built, sampled vectors are asked for their true neighbours in the sample,
and both numbers are the least that hold SURE of these. Vectors with clusters need few lists; without any structure all lists are looked into, and what is saved is that codes are read in place of vectors.

Vectors that are null, of another length than most, zero or not finite are in no list. Questions meet the lists in blocks of TOGETHER, and are sent to tasks by a join on the list.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.retrieval import dot, ranked, unit
from quarry.operators.storage import Manifest, ship

#: Bytes of vectors that the quantisers are trained on, at most.
TRAINED = 64 << 20
PARTS, WORDS, ROUNDS = 16, 256, 12
#: Vectors of a stored block, lists at most, questions of a block.
BLOCK, LISTS, TOGETHER = 4096, 16_384, 1024
#: Part of the true neighbours that the lists looked into, and the candidates ranked exactly, are to hold; sampled questions and neighbours that this is measured by.
SURE, ASKED, NEIGHBOURS = 0.97, 256, 10
_BLOCKS = "list int, ids array<long>, labels array<string>, codes binary"


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 1) -> np.ndarray:
    """k centres by Lloyd's rounds from k sampled rows; an empty one takes the row farthest from its own."""
    r = np.random.default_rng(seed)
    centres = x[r.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near, gap = nearest(x, centres)
        size = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        far = np.argsort(-gap)
        empty = np.flatnonzero(size == 0)
        centres = sums / np.maximum(size, 1)[:, None]
        centres[empty] = x[far[: len(empty)]] if len(empty) <= len(far) else x[r.choice(len(x), len(empty))]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, step: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """For each row the nearest centre and its squared distance, some rows at a time."""
    out, gaps = np.zeros(len(x), np.int64), np.zeros(len(x))
    own = (centres * centres).sum(1)
    for a in range(0, len(x), step):
        d = own - 2 * (x[a : a + step] @ centres.T)
        out[a : a + step] = d.argmin(1)
        gaps[a : a + step] = d.min(1) + (x[a : a + step] ** 2).sum(1)
    return out, gaps


class Quantiser:
    """Centroids and, for each part of what is left, code words."""

    def __init__(self, x: np.ndarray, lists: int):
        self.centroids = kmeans(x, lists)
        rest = x - self.centroids[nearest(x, self.centroids)[0]]
        self.cuts = np.linspace(0, x.shape[1], min(PARTS, x.shape[1]) + 1).astype(int)
        self.words = [kmeans(rest[:, a:b], WORDS, seed=3) for a, b in zip(self.cuts[:-1], self.cuts[1:])]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list, codes) of each row."""
        near, _ = nearest(x, self.centroids)
        rest = x - self.centroids[near]
        return near, np.stack([nearest(rest[:, a:b], w)[0] for a, b, w in zip(self.cuts[:-1], self.cuts[1:], self.words)], 1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Products of a question with all code words, a row a part."""
        return np.stack([w @ q[a:b] for a, b, w in zip(self.cuts[:-1], self.cuts[1:], self.words)])


def tuned(quantiser: Quantiser, x: np.ndarray) -> tuple[int, int]:
    """(lists to look into, candidates to rank exactly) that hold SURE of sampled rows' nearest others each."""
    near, codes = quantiser.encode(x)
    k = min(NEIGHBOURS, len(x) - 1)
    if k < 1:
        return 1, 1
    probes, ranks = [], []
    for i in range(0, len(x), max(1, len(x) // ASKED)):
        exact = x @ x[i]
        exact[i] = -np.inf
        true = np.argpartition(-exact, k - 1)[:k]
        table = quantiser.tables(x[i])
        lists = quantiser.centroids @ x[i]
        rough = lists[near] + sum(table[m][codes[:, m]] for m in range(len(table)))
        rough[i] = -np.inf
        place = np.empty(len(lists), np.int64)
        place[np.argsort(-lists, kind="stable")] = np.arange(len(lists))
        probes.append(place[near[true]])
        ranks.append([(rough > rough[t]).sum() for t in true])
    least = lambda v: int(np.quantile(np.concatenate(v), SURE, method="higher")) + 1
    return least(probes), least(ranks)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.values.slice(column.offset * size if isinstance(column, pa.FixedSizeListArray) else column.offsets[0].as_py(), len(column) * size).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _encode(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantiser = model.value
        for batch in batches:
            if batch.num_rows:
                near, codes = quantiser.encode(_matrix(batch.column("v"), quantiser.centroids.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(near.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], names=["vec_id", "label", "list", "code"])

    return run


def _probe(model, probed: int):
    """Each question's nearest lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = model.value.centroids
        for batch in batches:
            if batch.num_rows:
                score = _matrix(batch.column("v"), centroids.shape[1]) @ centroids.T
                best = np.argsort(-score, axis=1, kind="stable")[:, :probed]
                row = pa.array(np.repeat(np.arange(batch.num_rows), best.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column("query_id").take(row), batch.column("label").take(row), batch.column("v").take(row), pa.array(best.ravel().astype(np.int32))], names=["query_id", "label", "v", "list"])

    return run


def _scan(model, most: int, labelled: bool):
    """Blocks with the questions that look into their list -> (query_id, vec_id, approximate cosine) of each question's best in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantiser = model.value
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column("ids")[i].values.to_numpy()
                codes = np.frombuffer(batch.column("codes")[i].as_py(), np.uint8).reshape(len(ids), -1)
                labels = np.array(batch.column("labels")[i].as_py(), object) if labelled else None
                centroid = quantiser.centroids[batch.column("list")[i].as_py()]
                out = []
                for q in batch.column("asked")[i].as_py():
                    v = np.array(q["v"])
                    table = quantiser.tables(v)
                    score = v @ centroid + sum(table[m][codes[:, m]] for m in range(codes.shape[1]))
                    fit = ids != q["query_id"]
                    if labelled:
                        fit &= labels == q["label"] if q["label"] is not None else False
                    at = np.flatnonzero(fit)
                    if len(at) > most:
                        at = at[np.argpartition(-score[at], most)[:most]]
                    out.append((np.full(len(at), q["query_id"]), ids[at], score[at], np.full(len(at), len(ids))))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out])) for k in range(4)], names=["query_id", "vec_id", "near", "looked_at"])

    return run


class VectorIndex:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.manifest = spark, root.rstrip("/"), Manifest(spark, root)
        ship(spark)

    def build(self, vectors: DataFrame, label: str | None = None, lists: int | None = None) -> None:
        """Train, encode and store (vec_id, embedding, label); readers see the old index until all is written."""
        lab = F.col(label).cast("string") if label else F.lit(None).cast("string")
        rows = vectors.select("vec_id", lab.alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("e")).where("vec_id is not null and e is not null")
        sound = rows.where(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0))
        sizes = sound.groupBy(F.size("e").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
        if sizes is None:
            raise ValueError("there is no vector to index")
        size, n = sizes["size"], sizes["n"]
        sound = sound.where(F.size("e") == size).select("vec_id", "label", unit(F.col("e")).alias("v"))
        taken = sound.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, min(n, TRAINED // (8 * size)))).select("v").collect()
        lists = lists or int(max(1, min(LISTS, round(n**0.5), len(taken))))
        sample = np.array([r["v"] for r in taken])
        quantiser = Quantiser(sample, lists)
        probed, ranks = tuned(quantiser, sample)
        model = self.spark.sparkContext.broadcast(quantiser)
        coded = sound.mapInArrow(_encode(model), "vec_id long, label string, list int, code binary")
        block = F.floor(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)) / F.lit((1 << 40) / max(1, -(-4 * n // (lists * BLOCK)))))  # about a quarter full for an even list, so longer lists have full ones
        packed = coded.groupBy("list", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "label", "code"))).alias("x"))
        packed = packed.select("list", F.col("x.vec_id").alias("ids"), F.col("x.label").alias("labels"), F.unhex(F.array_join(F.transform("x.code", F.hex), "")).alias("codes"))
        name = f"i-{uuid.uuid4().hex}"
        packed.repartitionByRange("list").sortWithinPartitions("list").write.option("compression", "zstd").option("parquet.block.size", 4 << 20).parquet(f"{self.root}/data/{name}/lists")
        sound.repartitionByRange("vec_id").sortWithinPartitions("vec_id").write.parquet(f"{self.root}/data/{name}/vectors")
        parts = {"centroids": quantiser.centroids.tolist(), "words": [w.tolist() for w in quantiser.words], "cuts": quantiser.cuts.tolist()}
        self.spark.createDataFrame([(k, json.dumps(v)) for k, v in parts.items()], "name string, value string").coalesce(1).write.parquet(f"{self.root}/data/{name}/model")
        self.manifest.change(lambda _: {"data": {name: {"vectors": n, "lists": lists, "size": size, "probed": probed, "reranked": -(-ranks * n // len(sample))}}})

    def _open(self) -> tuple[str, dict, Quantiser]:
        name, entry = next(iter(self.manifest.read()["data"].items()))
        held = {r["name"]: json.loads(r["value"]) for r in self.spark.read.parquet(f"{self.root}/data/{name}/model").collect()}
        quantiser = Quantiser.__new__(Quantiser)
        quantiser.centroids, quantiser.cuts = np.array(held["centroids"]), np.array(held["cuts"])
        quantiser.words = [np.array(w) for w in held["words"]]
        return f"{self.root}/data/{name}", entry, quantiser

    def candidates(self, queries: DataFrame, k: int, same: bool = False, probed: int | None = None) -> DataFrame:
        """(query_id, vec_id, near, looked_at) by codes, of each block no more than are ranked exactly; looked_at: vectors of the block."""
        at, entry, quantiser = self._open()
        probed = probed or entry["probed"]
        model = self.spark.sparkContext.broadcast(quantiser)
        q = queries.select(F.col("vec_id").alias("query_id"), (F.col("label").cast("string") if same else F.lit(None).cast("string")).alias("label"), unit(F.transform("embedding", lambda x: x.cast("double"))).alias("v"))
        q = q.where((F.size("v") == entry["size"]) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)))
        probes = q.mapInArrow(_probe(model, probed), "query_id long, label string, v array<double>, list int")
        part = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-queries.count() // TOGETHER))))
        asked = probes.groupBy("list", part.alias("part")).agg(F.collect_list(F.struct("query_id", "label", "v")).alias("asked"))
        met = self.spark.read.schema(_BLOCKS).parquet(f"{at}/lists").join(asked, "list")
        return met.mapInArrow(_scan(model, max(k, entry["reranked"]), same), "query_id long, vec_id long, near double, looked_at long")

    def search(self, queries: DataFrame, k: int, same: bool = False, probed: int | None = None) -> DataFrame:
        """(query_id, vec_id, score, rank): the k best by exact cosine among the candidates, itself excluded; with `same`, of its label."""
        at, entry, _ = self._open()
        best = ranked(self.candidates(queries, k, same, probed).withColumnRenamed("near", "score"), "query_id", "vec_id", max(k, entry["reranked"])).select("query_id", "vec_id")
        vectors = self.spark.read.parquet(f"{at}/vectors").select("vec_id", "v")
        q = queries.select(F.col("vec_id").alias("query_id"), unit(F.transform("embedding", lambda x: x.cast("double"))).alias("q"))
        exact = best.join(vectors, "vec_id").join(q, "query_id").select("query_id", "vec_id", dot(F.col("v"), F.col("q")).alias("score"))
        return ranked(exact, "query_id", "vec_id", k)
