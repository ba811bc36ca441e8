"""N-gram Jaccard join by adaptive multi-match prefixes (in the manner of AdaptJoin, Wang et al., 2012).

Every text becomes its set of distinct word shingles; two texts link when the sets' Jaccard
similarity reaches the threshold, and the operator returns the connected components.

1. One pass hashes all texts. Texts with equal sets form a class and count as one node from here on.
   The same pass counts shingles that recur, for an ordering with rare shingles first; an estimate
   that is off costs time, never a link, since any one order of all shingles is correct.
2. A set of n shingles that overlaps another in at least T = ceil(t n) shares at least l shingles with
   it in the first n - T + l of the order. Each node takes the l whose estimated cost, postings plus
   verifications, is least, and lists its prefix; two nodes are candidates only if they share
   min(l1, l2) listed shingles, and as many more as their sizes call for. The smaller set of a pair is found by
   a still shorter part of its list (see prefix_of). Asking for more lengthens every list
   a little and leaves out pairs that merely share a passage.
3. Candidates are verified on the whole sets, which only pairs are sent whose counts of shingles by hash bucket, written in the first pass, allow
   a link: the sum of the smaller counts is never less than the overlap. First one node of each posting list against the others,
   which joins large groups of near copies with a linear number of pairs. Then every candidate pair
   whose two nodes are still in different components; pairs inside one cannot change it. Where a list
   is crowded with such pairs, its shingle is more frequent than the ordering knew. The nodes of crowded lists are then listed
   anew among themselves, in an order that has those shingles' counts: two nodes that share a crowded list are both there, and all other
   pairs were settled without. Where lists stay crowded, or little is at stake, their nodes meet block against block on whole sets instead, without a row a pair.

No task holds a whole posting list: what is asked of a list as a whole are aggregates, combined before the shuffle and joined back
(a skewed join, which AQE may split); lists are first told apart from those of one node within slices of HOT texts at most, by the recurring shingles'
counts; nodes of crowded lists are dealt to blocks by size, counts and hashes, and their blocks meet in rounds of bounded bytes.

Nulls and texts without words have an empty set, link with nothing and are their own component.
Repeated rows come back once each. Rows whose doc_id is null still belong to their class; a component
without any id is null. Extra columns of the input are ignored, whatever their names. An empty table gives no rows. Very long texts are
hashed in blocks. Words and shingles stand as 64-bit hashes throughout, so counts are exact but for chance collisions.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quarry.llm import hashing as H
from quarry.llm.common import connected, cut, drop_cut, release, table, trim

#: A shingle is reported as recurring by a batch of rows that has it in so many texts.
LOCAL_DF = 2
#: At most so many recurring shingles (the levels with the highest counts) order the prefixes: 4 MB for each worker.
ORDERED = 1 << 18
#: Bits of the filter of nodes to verify; if more nodes fill it up, it only filters less.
FILTER_BITS = 1 << 25
MOST_MATCHES = 16
#: Verifying a candidate ships two whole sets and costs about as much as so many postings.
VERIFY_COST = 300.0
#: Expected other texts with a shingle that is not among the ordered ones.
RARE_DF = 0.02
#: Texts with a recurring shingle that one slice of its list may come from.
HOT = 65_536
#: Leads that a node is held against before all others.
LEADS = 2
#: A list with more open pairs than so many a node is crowded.
CROWD = 24
SIDE = 1024
#: Bytes of whole sets that one round of meetings ships.
SHIPPED = 1 << 31
#: The nodes of crowded lists are listed anew, once, if their meetings would ship more bytes than so.
RELISTED = 1 << 28


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For blocks of texts: the first text's place, sorted distinct shingles of all, bounds of each text's."""
    raw, offsets = H.utf8(column)
    for i, j in H.spans(offsets, 1 << 20):
        words, first = H.word_hashes(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        grams, at = H.shingle_hashes(words, first, k)
        keep = np.ones(len(grams), bool)
        for a, b in zip(at[:-1], at[1:], strict=True):
            part = grams[a:b]
            part.sort()
            np.not_equal(part[1:], part[:-1], out=keep[a + 1 : b]) if b > a + 1 else None
        bounds = np.concatenate([[0], np.cumsum(keep)])[at]
        yield i, grams[keep], bounds


def _nodes(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set; 0 for the empty set."""
    one = np.concatenate([np.zeros(1, np.uint64), np.cumsum(H.mix(grams ^ np.uint64(0x1234567)), dtype=np.uint64)])
    two = np.concatenate([np.zeros(1, np.uint64), np.cumsum(grams, dtype=np.uint64)])
    n = np.diff(bounds).astype(np.uint64)
    a, b = one[bounds[1:]] - one[bounds[:-1]], two[bounds[1:]] - two[bounds[:-1]]
    return np.where(n > 0, H.mix(a ^ H.mix(b + n)), np.uint64(0)).astype(np.int64)


_CENSUS = T.StructType(
    [T.StructField(n, k) for n, k in (("doc_id", T.LongType()), ("n_shingles", T.LongType()), ("node", T.LongType()), ("gram", T.LongType()), ("df", T.LongType()), ("sketch", T.BinaryType()))]
)


def _sketch(grams: np.ndarray) -> bytes:
    """How many shingles fall in each of a power of two of hash buckets, about four in one; nothing if a count is too large for a byte."""
    size = 1 << max(4, (len(grams) // 4).bit_length())
    counts = np.bincount((grams & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else b""


def may_link(one: bytes, two: bytes, percent: int) -> bool:
    """Whether two sets' sketches allow the similarity: the smaller counts add up to the overlap or more."""
    if not one or not two:
        return True
    a, b = np.frombuffer(one, np.uint8).astype(np.int64), np.frombuffer(two, np.uint8).astype(np.int64)
    size = min(len(a), len(b))
    a, b = a.reshape(-1, size).sum(0), b.reshape(-1, size).sum(0)
    most = int(np.minimum(a, b).sum())
    return 100 * most >= percent * (int(a.sum()) + int(b.sum()) - most)


def _census(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(f.name, pa.binary() if f.name == "sketch" else pa.int64()) for f in _CENSUS])
        for batch in batches:
            ids, counts, nodes, all_grams, sketches = batch.column(0), [], [], [], []
            for _, grams, bounds in _sets(batch.column(1), k):
                counts.append(np.diff(bounds))
                nodes.append(_nodes(grams, bounds))
                all_grams.append(grams)
                sketches += [_sketch(grams[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            n = len(ids)
            if not n:
                continue
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(np.concatenate(counts)), pa.array(np.concatenate(nodes)), none, none, pa.array(sketches, pa.binary())], schema=schema)
            grams = np.sort(np.concatenate(all_grams))
            del all_grams
            begin = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, int)
            df = np.diff(np.append(begin, len(grams)))
            often = df >= LOCAL_DF
            if often.any():
                none = pa.nulls(int(often.sum()), pa.int64())
                more = [pa.array(grams[begin[often]].astype(np.int64)), pa.array(df[often].astype(np.int64)), pa.nulls(int(often.sum()), pa.binary())]
                yield pa.RecordBatch.from_arrays([none, none, none, *more], schema=schema)
            del grams, begin, df, often
        trim()

    return run


def prefix_of(grams: np.ndarray, df: np.ndarray, percent: int) -> tuple[np.ndarray, int, int, np.ndarray]:
    """What a node lists, how many shared shingles it asks for, how many of the list may find larger sets, and the list's counts.

    A partner of at least the same size overlaps in 2t / (1 + t) n shingles or more, so the smaller set of a
    pair needs only that shorter part of its list; the larger one needs all of it.
    """
    n = len(grams)
    least, least_up = -(-percent * n // 100), -(-2 * percent * n // (100 + percent))
    order = np.lexsort((grams, df)) if df.any() else np.argsort(grams, kind="stable")
    base, most = n - least_up, min(MOST_MATCHES, least)
    postings = np.cumsum(np.maximum(df[order[: base + most]] - 1, RARE_DF))
    ask = np.arange(1, most + 1)
    need = postings[base : base + most]
    take = int(ask[np.argmin(ask + need + VERIFY_COST * need / ask)])
    listed = order[: n - least + take]
    return grams[listed], take, base + take, df[listed]


def _postings(k: int, percent: int, frequent, bits=None):
    """The lists of all nodes, or of those that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weight = frequent.value
        seen: set[int] = set()
        names = ["gram", "node", "rest"]
        for batch in batches:
            for _, grams, bounds in _sets(batch.column(0), k):
                nodes = _nodes(grams, bounds)
                wanted = np.diff(bounds) > 0
                if bits is not None:
                    wanted &= _hit(bits.value, nodes)
                if not wanted.any():
                    continue
                if len(known):
                    at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
                    df = np.where(known[at] == grams, weight[at], 0)
                else:
                    df = np.zeros(len(grams), np.int64)
                lists, rows, slices = [], [], []
                for i in np.flatnonzero(wanted):
                    a, b, node = bounds[i], bounds[i + 1], int(nodes[i])
                    if node in seen:
                        continue
                    if len(seen) < 1 << 20:
                        seen.add(node)
                    prefix, ask, up, counts = prefix_of(grams[a:b], df[a:b], percent)
                    lists.append(prefix)
                    slices.append(np.where(counts > HOT, 1 + node % -(-counts // HOT), 0))
                    rows.append((node, b - a, ask, len(prefix), up))
                if rows:
                    r = np.array(rows, np.int64)
                    up = np.concatenate([np.arange(m) < up for m, up in zip(r[:, 3], r[:, 4], strict=True)])
                    rest = np.repeat(r[:, 1] << 32 | r[:, 2] << 25, r[:, 3]) | up.astype(np.int64) << 24 | np.minimum(np.concatenate(slices), (1 << 24) - 1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(lists).astype(np.int64)), pa.array(np.repeat(r[:, 0], r[:, 3])), pa.array(rest)],
                        names=names,
                    )

    return run


def _hit(mask: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Which nodes the filter lets through."""
    slot = nodes.astype(np.uint64) % np.uint64(FILTER_BITS)
    return ((mask[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def _wanted(k: int, bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = bits.value
        seen: set[int] = set()
        for batch in batches:
            for _, grams, bounds in _sets(batch.column(0), k):
                nodes = _nodes(grams, bounds)
                out, sets = [], []
                for i in np.flatnonzero(_hit(mask, nodes) & (np.diff(bounds) > 0)):
                    node = int(nodes[i])
                    if node in seen:
                        continue
                    if len(seen) < 1 << 20:
                        seen.add(node)
                    out.append(node)
                    sets.append(grams[bounds[i] : bounds[i + 1]].astype(np.int64))
                if out:
                    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(sets)))], names=["node", "grams"])

    return run


def _filter_bits(nodes: DataFrame) -> np.ndarray:
    """FILTER_BITS bits with those of the nodes set: a result of fixed size, 4 MB at most."""
    slot = F.pmod(F.col("node"), F.lit(FILTER_BITS))
    groups = nodes.select(slot.alias("slot")).groupBy(F.expr("slot div 32768").alias("part"))
    mask = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in groups.agg(F.expr("bitmap_construct_agg(slot % 32768)").alias("bits")).collect():
        mask[row["part"] * 4096 : (row["part"] + 1) * 4096] = np.frombuffer(row["bits"], np.uint8)
    return mask


def _in_filter(bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_hit(bits.value, batch.column(0).to_numpy())))

    return run


def _allowed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [may_link(x, y, percent) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _with_bits(pairs: DataFrame):
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    return pairs.sparkSession.sparkContext.broadcast(_filter_bits(nodes))


def _verified(docs: DataFrame, pairs: DataFrame, sketches: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets reach the threshold; sets go to pairs whose sketches (node, sketch) allow it."""
    bits = _with_bits(pairs)
    # written, like the sets below, so that both sides of the joins are plain exchanges, which AQE may split where a lead has very many pairs
    known = cut(sketches.mapInArrow(_in_filter(bits), "node long, sketch binary").dropDuplicates(["node"]), "sketches")
    met = pairs.join(known.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a").join(known.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b")
    pairs = cut(met.select("a", "b", "sa", "sb").mapInArrow(_allowed(percent), "a long, b long"), "pairs")
    drop_cut(known)
    bits.destroy()
    bits = _with_bits(pairs)
    sets = cut(docs.mapInArrow(_wanted(k, bits), "node long, grams array<long>").dropDuplicates(["node"]), "sets")
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("ga")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b")
    shared = F.size(F.array_intersect("ga", "gb"))
    reached = F.lit(100) * shared >= F.lit(percent) * (F.size("ga") + F.size("gb") - shared)
    links = cut(both.where(reached).select("a", "b"), "verified")
    drop_cut(sets)
    bits.destroy()
    return links


def _listed(texts: DataFrame, frequent, k: int, percent: int, bits=None) -> DataFrame:
    """(gram, node, n, ask, up) of the posting lists with more than one node, by an order that has the shingles of `frequent` last."""
    # a row of postings is three numbers: the size, what is asked for, and the slice of the list share one
    postings = texts.mapInArrow(_postings(k, percent, frequent, bits), "gram long, node long, rest long").withColumn("slice", F.expr("rest & 16777215"))
    # a list of more than HOT texts is in slices, which are kept whole: it has more than one node but for the rarest case
    by_gram = Window.partitionBy("gram", "slice")
    lists = postings.withColumn("low", F.min("node").over(by_gram)).withColumn("high", F.max("node").over(by_gram))
    lists = lists.withColumn("any_up", F.max(F.expr("rest & 16777216")).over(by_gram)).where("slice > 0 or (low <> high and any_up > 0)")
    shown = "gram", "node", F.expr("cast((rest >> 32) as int) n"), F.expr("cast(((rest >> 25) & 127) as byte) ask"), F.expr("((rest & 16777216) > 0) as up")
    return cut(lists.select(*shown), "postings")


def _recounted(frequent: tuple[np.ndarray, np.ndarray], crowd: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The ordered shingles with those of crowded lists, about ORDERED of these at most, which count what their lists have at least."""
    more, counts = _ordered(crowd.groupBy("gram").agg(F.max("m").alias("df")))
    known, at = np.unique(np.concatenate([frequent[0], more]), return_inverse=True)
    weight = np.zeros(len(known), np.int64)
    np.maximum.at(weight, at, np.concatenate([frequent[1], counts]))
    return known, weight


def _linked(texts: DataFrame, live: DataFrame, frequent: tuple[np.ndarray, np.ndarray], sketches: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, root) of all nodes that link, from the posting lists with more than one node."""
    spark = live.sparkSession
    release(spark)
    # a list's lead against the others of the list, but for each node only the leads it shares most lists with
    leads = live.groupBy("gram").agg(F.min("node").alias("lead"), F.min_by("n", "node").alias("lead_n"))  # nodes are hashes already
    star = live.join(leads, "gram").where(f"node <> lead and 100 * least(n, lead_n) >= {percent} * greatest(n, lead_n)")
    star = star.groupBy("node", "lead").agg(F.count("*").alias("got"))
    best = Window.partitionBy("node").orderBy(F.desc("got"), F.xxhash64("lead"))
    first = star.withColumn("place", F.row_number().over(best)).where(F.col("place") <= LEADS)
    first = cut(first.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct(), "pairs")
    links = _verified(texts, first, sketches, k, percent)
    roots = cut(connected(links), "roots")
    release(spark)

    more = []
    apart = _apart(live, roots)
    pairs, crowd = _candidates(apart, first, percent)
    if not pairs.isEmpty():
        release(spark)
        more.append(_verified(texts, pairs, sketches, k, percent))
    members, meet, shipped = _dealt(crowd, percent)
    if shipped > RELISTED:
        # two nodes on a crowded list in common are both among its members, so the lists of these alone find what is left
        drop_cut(apart)
        counts, bits = spark.sparkContext.broadcast(_recounted(frequent, crowd)), spark.sparkContext.broadcast(_filter_bits(members))
        again = _listed(texts, counts, k, percent, bits)
        counts.destroy()
        bits.destroy()
        release(spark)
        pairs, crowd = _candidates(_apart(again, roots), first.unionByName(pairs), percent)
        drop_cut(again)
        if not pairs.isEmpty():
            release(spark)
            more.append(_verified(texts, pairs, sketches, k, percent))
        members, meet, shipped = _dealt(crowd, percent)
    if shipped:
        release(spark)
        more.append(_crowded(texts, members, meet, shipped, k, percent))
    for found in more:
        links = links.unionByName(found)
    return cut(connected(links), "roots") if more else roots


def _candidates(apart: DataFrame, done: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b) to verify of the lists that are not crowded, without those done; and the crowded lists, with their number m of nodes."""
    per_root = apart.groupBy("gram", "root").agg(F.count("*").alias("m"), F.count_if("up").alias("up"))
    per_gram = per_root.groupBy("gram").agg(F.sum("m").alias("m"), F.sum("up").alias("up"), F.sum(F.col("m") * F.col("up")).alias("own"))
    crowded = per_gram.where(F.expr(f"m * up - own > {CROWD} * m")).select("gram", "m")
    crowd = cut(apart.join(crowded, "gram"), "crowd")
    sparse = apart.join(crowd.select("gram").distinct(), "gram", "left_anti")

    small, large = sparse.where("up").alias("a"), sparse.alias("b")
    larger = "(a.n < b.n or (a.n = b.n and a.node < b.node))"
    pairs = small.join(large, F.expr(f"a.gram = b.gram and a.root <> b.root and {larger} and 100 * a.n >= {percent} * b.n"))
    # shingles that the two share beyond what their lists show lie after the earlier end of the lists
    beyond = f"greatest(ceil({2 * percent} * a.n / {100 + percent}) - a.ask, ceil({percent} * b.n / 100) - b.ask)"
    need = F.expr(f"greatest(least(a.ask, b.ask), ceil({percent} * (a.n + b.n) / {100 + percent}) - {beyond})")
    pairs = pairs.groupBy(F.col("a.node").alias("x"), F.col("b.node").alias("y")).agg(F.count("*").alias("got"), F.first(need).alias("need"))
    # a pair on a crowded list is held against each other there
    pairs = pairs.where("got >= need").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return cut(pairs.join(done, ["a", "b"], "left_anti"), "pairs"), crowd


def _dealt(crowd: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, int]:
    """(node, root, block) of the nodes of crowded lists; (a, b, bytes) of the blocks that meet, with what a meeting ships; and the bytes of all meetings.

    Partners differ little in size, so blocks are dealt by size first and meet only those of near sizes. Of one size, large components have blocks of
    about SIDE to themselves, then the nodes of a list that is the most crowded one of many, then all others, by list.
    """
    members = crowd.groupBy("node").agg(F.first("n").alias("n"), F.first("root").alias("root"), F.max(F.struct("m", "gram"))["gram"].alias("key"))
    level = F.floor(F.log("n") / F.lit(max(math.log(100 / percent) / 2, 0.05))).alias("level")
    members = cut(members.select("*", level), "members")
    few = lambda c: F.col(c) < SIDE // 4
    parts = members.groupBy("level", "key", "root").agg(F.count("*").alias("n_part"))
    of_root = parts.groupBy("level", "root").agg(F.sum("n_part").alias("n_root"))
    parts = parts.join(of_root, ["level", "root"])
    of_key = parts.where(few("n_root")).groupBy("level", "key").agg(F.sum("n_part").alias("n_key"))
    of_rest = of_key.where(few("n_key")).groupBy("level").agg(F.sum("n_key").alias("n_rest"))
    parts = parts.join(of_key, ["level", "key"], "left").join(of_rest, "level", "left")
    blocks = lambda c: F.ceil(F.col(c) * 4 / (3 * SIDE))
    none = F.lit(0).cast("long")
    own = F.xxhash64(F.lit(0), "level", "root", F.pmod(F.xxhash64("node"), blocks("n_root")))
    listed = F.xxhash64(F.lit(1), "level", "key", F.pmod(F.xxhash64("root"), blocks("n_key")))
    rest = F.xxhash64(F.lit(2), "level", none, F.pmod(F.xxhash64("key"), blocks("n_rest")))
    named = F.when(~few("n_root"), own).when(~few("n_key"), listed).otherwise(rest)
    members = cut(members.join(parts, ["level", "key", "root"]).select("node", "n", "root", named.alias("block")), "crowd")
    blocks = members.groupBy("block").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("root").alias("low"), F.max("root").alias("high"), (8 * F.sum("n")).alias("bytes"))
    on = crowd.join(members.select("node", "block"), "node").select("gram", "block").distinct()
    on = on.join(blocks.select("block", "least", "most"), "block")
    near = f"a.gram = b.gram and a.block <= b.block and 100 * a.most >= {percent} * b.least and 100 * b.most >= {percent} * a.least"
    both = on.alias("a").join(on.alias("b"), F.expr(near)).select(F.col("a.block").alias("a"), F.col("b.block").alias("b")).distinct()
    meet = both.join(blocks.select(*[F.col(c).alias(f"{c}_a") for c in blocks.columns]), F.expr("a = block_a"))
    meet = meet.join(blocks.select(*[F.col(c).alias(f"{c}_b") for c in blocks.columns]), F.expr("b = block_b"))
    meet = meet.where("not (low_a = high_b and high_a = low_b)").select("a", "b", (F.col("bytes_a") + F.col("bytes_b")).alias("bytes"))
    meet = cut(meet, "meetings")
    return members.select("node", "root", "block"), meet, meet.agg(F.sum("bytes")).first()[0] or 0


def _crowded(texts: DataFrame, members: DataFrame, meet: DataFrame, shipped: int, k: int, percent: int) -> DataFrame:
    """Links among nodes on crowded lists, block against block on whole sets, without a row for each pair.

    Two blocks meet if a crowded list has nodes of both, unless all are of one component or too different in
    size; a meeting returns only the links that join components. A set goes to every meeting of its block, so meetings
    are held in rounds that ship about SHIPPED bytes each, and a round's shuffle is let go before the next.
    """
    spark = texts.sparkSession
    bits = spark.sparkContext.broadcast(_filter_bits(members))
    sets = texts.mapInArrow(_wanted(k, bits), "node long, grams array<long>").dropDuplicates(["node"])
    sets = cut(members.join(sets, "node"), "sets")
    bits.unpersist()
    rounds = -(-shipped // SHIPPED)
    meet = meet.withColumn("task", F.xxhash64("a", "b"))
    links = None
    for i in range(rounds):
        now = meet.where(F.pmod(F.xxhash64("task"), F.lit(rounds)) == i)
        sides = now.select("task", F.explode(F.expr("array(struct(a as block, 0 as side), struct(b as block, 1 as side))")).alias("s"))
        dealt = sets.join(sides.select("task", "s.block", "s.side"), "block").select("task", "side", "node", "root", "grams")
        found = cut(dealt.groupBy("task").applyInArrow(_meeting(percent), "a long, b long"), "verified")
        links = found if links is None else links.unionByName(found)
        del dealt
        release(spark)
    drop_cut(sets)
    return links


def _meeting(percent: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        side, node, root = (rows[c].to_numpy() for c in ("side", "node", "root"))
        grams = rows["grams"].chunk(0) if rows["grams"].num_chunks else pa.array([], pa.list_(pa.int64()))
        bounds = grams.offsets.to_numpy()
        _, token, often = np.unique(grams.values.to_numpy()[bounds[0] : bounds[-1]], return_inverse=True, return_counts=True)
        size = np.diff(bounds)
        owner = np.repeat(np.arange(len(size)), size)
        shared = often[token] > 1
        rank = np.cumsum(often > 1) - 1
        owner, token = owner[shared], rank[token[shared]]
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        common = np.zeros((len(left), len(right)), np.float32)
        order = np.argsort(token, kind="stable")
        owner, token = owner[order], token[order]
        width = 4096
        for at in range(0, int(token[-1]) + 1 if len(token) else 0, width):
            i, j = np.searchsorted(token, [at, at + width])
            part = np.zeros((len(size), width), np.float32)
            part[owner[i:j], token[i:j] - at] = 1
            common += part[left] @ part[right].T
        reach = 100 * common >= percent * (size[left][:, None] + size[right][None, :] - common)
        reach &= root[left][:, None] != root[right][None, :]
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while x in up:
                x = up[x]
            return x

        out = []
        for i, j in zip(*np.nonzero(reach), strict=True):
            x, y = top(int(root[left[i]])), top(int(root[right[j]]))
            if x != y:
                up[max(x, y)] = min(x, y)
                out.append((int(node[left[i]]), int(node[right[j]])))
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _apart(live: DataFrame, roots: DataFrame) -> DataFrame:
    """The posting lists that still have nodes of different components."""
    placed = cut(live.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")
    mixed = placed.groupBy("gram").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("gram")
    apart = cut(placed.join(mixed, "gram", "left_semi").distinct(), "apart")
    drop_cut(placed)
    return apart


def _ordered(often: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles with the highest counts, about ORDERED at most: whole levels from the top, and of the level that is too large a part by hash.

    Only a histogram of levels and then these shingles reach the driver.
    """
    leveled = cut(often.withColumn("level", F.floor(F.log2("df") * 8)), "recurring")
    room, least, part = ORDERED, None, 0
    for r in sorted(leveled.groupBy("level").agg(F.count("*").alias("n")).collect(), key=lambda r: -r["level"]):
        least = r["level"]
        if r["n"] > room:
            part = 1000 * room // r["n"]  # in thousandths
            break
        room, part = room - r["n"], 1000
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    chosen = (F.col("level") > least) | ((F.col("level") == least) & (F.pmod(F.xxhash64("gram"), F.lit(1000)) < part))
    rows = leveled.where(chosen).select("gram", "df").toArrow()
    drop_cut(leveled)
    return rows["gram"].to_numpy().astype(np.int64).astype(np.uint64), rows["df"].to_numpy().astype(np.int64)


def _classes(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, node) of every row, and (node, least_id, root) of every class with words."""
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    named = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    census = cut(named.mapInArrow(_census(k), _CENSUS), "census")
    rows = census.where("node is not null").select("doc_id", "n_shingles", "node")
    known, weight = _ordered(census.where("node is null").groupBy("gram").agg(F.sum("df").alias("df")))
    order = np.argsort(known)
    ordered = known[order], weight[order]
    frequent = spark.sparkContext.broadcast(ordered)
    live = _listed(texts, frequent, k, percent)
    sizes = rows.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least_id"))
    roots = _linked(texts, live, ordered, census.where("node is not null").select("node", "sketch"), k, percent)
    release(spark)

    return rows, sizes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; see the module's text for method and edge cases."""
    rows, classes = _classes(docs, id_col, text_col, k, percent)
    least = classes.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = classes.join(least, "root").select("node", "component_id")
    out = rows.join(named, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _with_class(k: int, at: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = [_nodes(grams, bounds) for _, grams, bounds in _sets(batch.column(at), k)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([np.zeros(0, np.int64), *nodes]))], names=[*batch.schema.names, name])
        trim()

    return run


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """The rows, with all columns, that stay when one row of each component does: one with its smallest id, nulls last.

    Rows are told apart by id and class, so an id with two texts, and rows without an id, are judged as what they are; of rows with
    both in common any one stays. Rows without words stay all.
    """
    rows, classes = _classes(docs, id_col, text_col, k, percent)
    first = classes.groupBy("root").agg(F.min(F.struct(F.col("least_id").isNull().alias("no"), F.col("least_id").alias("id"), F.col("node").alias("node"))).alias("x"))
    times = rows.where("n_shingles > 0").groupBy("node", F.col("doc_id").alias("id")).agg((F.count("*") > 1).alias("many"))
    f, t = first.select("x.id", "x.node").alias("f"), times.alias("t")
    stay = f.join(t, (F.col("f.node") == F.col("t.node")) & F.col("f.id").eqNullSafe(F.col("t.id")))
    node, id_, many = (f"{n}_{uuid.uuid4().hex}" for n in ("node", "id", "many"))
    stay = stay.select(F.col("f.node").alias(f"{node}_"), F.col("f.id").alias(id_), F.col("t.many").alias(many))
    marked = docs.mapInArrow(_with_class(k, docs.columns.index(text_col), node), T.StructType([*docs.schema.fields, T.StructField(node, T.LongType())]))
    same = (F.col(node) == F.col(f"{node}_")) & F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(id_))
    met = marked.where(F.col(node) != 0).join(stay, same)
    cols = [F.col(f"`{c}`") for c in docs.columns]
    several = met.where(many).groupBy(node).agg(F.min_by(F.struct(*cols), F.xxhash64(F.col(f"`{text_col}`"))).alias("row"))
    of_many = several.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
    return met.where(~F.col(many)).select(*cols).unionByName(of_many).unionByName(marked.where(F.col(node) == 0).select(*cols))


def op9(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
