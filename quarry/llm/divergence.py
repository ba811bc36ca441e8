"""Source divergence audit by two-dimensional group-block tiling.

A group is a (lang, source); a language's vocabulary are the terms in at least LEAST_DOCS of its documents. With N a group's
occurrences of these terms and V their number, a term has p = 1 + floor(10^9 (count + 2) / (N + 2 V)) there, and two groups differ by
floor((p - q)^2 / (p + q)) at a term. Scanning tasks count terms before anything is shuffled. Every language's groups are cut into blocks of
SIDE, its vocabulary into chunks of about CHUNK terms; a group's counts of a chunk are one packed row. Each pair of blocks
(and strip of chunks) is a task's tile: the rows are replicated to the tiles of their block, and the tile adds up its submatrix of pairs
chunk after chunk, so that it holds one chunk of 2 SIDE groups. Terms that no group of a tile has contribute one number a pair, added at the end.
No list grows with a term's, a group's or a language's frequency. Quotients are taken in decimals or by long division of 64-bit numbers, so all is exact
while N + 2 V stays below 9 x 10^15.

Null text, lang and source are empty strings. A group without terms is compared like others (all counts 0); a language without
vocabulary gives its pairs the value 0 and no terms; a language with one source has no pairs. Equal values are ranked by
item in the order of UTF-8. Repeated rows, also of one doc_id, are documents of their own. An empty table gives no rows. Extra columns, whatever their
names, are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm import terms
from quarry.llm.common import cut, drop_cut, table, trim

LEAST_DOCS, TOP = 10, 10
SIDE, CHUNK, STRIP = 8, 1024, 16
#: At most so many languages' sizes are sent to all tasks.
LANGS = 100_000
#: Counts that a scanning task holds before it passes them on.
HELD = 1 << 18
_COUNTS = "lang string, source string, term string, n long, df long"
_PAIRS = "lang string, a string, b string, vocabulary long, size_a long, size_b long, value long, seen long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, occurrences, documents) of parts of the rows; the empty term stands for the group itself."""
    totals: dict[tuple, tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (times, docs) in totals.items():
            names = list(docs)
            words = pa.array(names, pa.binary()).cast(pa.string())
            cols = [pa.array([x] * len(names), pa.string()) for x in (lang, source)]
            yield pa.RecordBatch.from_arrays([*cols, words, pa.array([times[w] for w in names], pa.int64()), pa.array(docs.values(), pa.int64())], names=["lang", "source", "term", "n", "df"])
        totals.clear()

    held = 0
    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), terms.raw(batch.column(2)), strict=True):
            times, docs = totals.setdefault((lang, source), (Counter(), Counter()))
            before, own = len(docs), set()
            for words in terms.blocks(text, terms.LETTERS):
                times.update(words)
                own.update(words)
            docs.update(own)
            docs[b""] += 1
            held += len(docs) - before
            if held >= HELD:
                yield from flush()
                held = 0
    yield from flush()
    trim()


def counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, df): one scan, counted in its tasks first."""
    clean = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))]
    return docs.select(*clean).mapInArrow(_count, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def _chance(n: Column, size: Column) -> Column:
    """1 + floor(10^9 (n + 2) / size), in decimals."""
    whole = F.lit(10**9).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)")
    return F.call_function("div", whole, size.cast("decimal(20,0)")).cast("long") + 1


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _long_division(n: np.ndarray, size: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (n + 2) / size) for n + 2 <= size, three decimal digits at a time."""
    rest, out = n + 2, np.zeros(np.broadcast_shapes(n.shape, size.shape), np.int64)
    out += rest // size
    rest = rest - rest // size * size
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // size
        rest = rest % size
    return out + 1


class _Tile:
    """Two blocks of groups (or one against itself) over a strip of the vocabulary."""

    def __init__(self, lang: str, first: int, second: int):
        self.lang, self.same, self.blocks = lang, first == second, (first, second)
        self.groups: list[tuple[str, int, int]] = []  # source, block, N + 2 V
        self.vocabulary = 0

    def open(self) -> None:
        self.place = {g[0]: i for i, g in enumerate(self.groups)}
        self.sizes = np.array([[g[2]] for g in self.groups], np.int64)
        self.left = [i for i, g in enumerate(self.groups) if g[1] == self.blocks[0]]
        self.right = [i for i, g in enumerate(self.groups) if g[1] == self.blocks[1]]
        self.values = np.zeros((len(self.left), len(self.right)), np.int64)
        self.seen = 0

    def add(self, rows: list[tuple[str, np.ndarray, np.ndarray]]) -> None:
        """One chunk: its packed rows."""
        dense = np.zeros((len(self.groups), 1 + max(int(at.max()) for _, at, _ in rows)), np.int64)
        for source, at, n in rows:
            dense[self.place[source], at] = n
        dense = dense[:, dense.any(0)]
        p = _long_division(dense, self.sizes)
        right = p[self.right]
        for i, k in enumerate(self.left):
            gap = right - p[k]
            self.values[i] += (gap * gap // (right + p[k])).sum(1)
        self.seen += dense.shape[1]

    def pairs(self) -> pa.RecordBatch:
        out = []
        for i, a in enumerate(self.left):
            for j, b in enumerate(self.right):
                if not self.same or a < b:
                    out.append((self.lang, self.groups[a][0], self.groups[b][0], self.vocabulary, self.groups[a][2], self.groups[b][2], int(self.values[i, j]), self.seen))
        kinds = [pa.string()] * 3 + [pa.int64()] * 5
        cols = list(zip(*out, strict=True)) or [()] * 8
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in _PAIRS.split(", ")])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of whole tiles, their groups (chunk -1) first -> sums of pairs."""
    tile, key, chunk, rows = None, None, -1, []
    for batch in batches:
        c = {name: batch.column(name) for name in batch.schema.names}
        plain = {name: c[name].to_pylist() for name in ("lang", "first", "second", "strip", "chunk", "source", "block", "size", "vocabulary")}
        ats, ns = c["at"], c["n"]
        for i in range(batch.num_rows):
            now = tuple(plain[k][i] for k in ("lang", "first", "second", "strip"))
            if (now, plain["chunk"][i]) != (key, chunk) and tile:
                if chunk < 0:
                    tile.open()
                elif rows:
                    tile.add(rows)
                rows = []
            if now != key:
                if tile:
                    yield tile.pairs()
                tile, key = _Tile(*now[:3]), now
            chunk = plain["chunk"][i]
            if chunk < 0:
                tile.groups.append((plain["source"][i], plain["block"][i], plain["size"][i]))
                tile.vocabulary = plain["vocabulary"][i]
            else:
                rows.append((plain["source"][i], ats[i].values.to_numpy(), ns[i].values.to_numpy()))
    if tile:
        if chunk < 0:
            tile.open()
        elif rows:
            tile.add(rows)
        yield tile.pairs()
    trim()


def pair_sums(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value) of the unordered pairs of a language's groups.

    kept: (lang, source, chunk, place, n); groups: (lang, source, block, blocks, chunks, size, vocabulary).
    """
    packed = kept.groupBy("lang", "source", "chunk").agg(F.collect_list(F.struct("place", "n")).alias("x"))
    packed = packed.join(groups.select("lang", "source", "block", "blocks"), ["lang", "source"])
    both = [F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second")]
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    sent = packed.select("*", every).select(
        "lang", *both, F.expr(f"chunk div {STRIP}").cast("int").alias("strip"), "chunk", "source", "block", F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("vocabulary"),
        F.col("x.place").alias("at"), F.col("x.n").alias("n"),
    )
    strips = F.explode(F.sequence(F.lit(0), F.greatest(F.expr(f"(chunks - 1) div {STRIP}"), F.lit(0)).cast("int"))).alias("strip")
    heads = groups.select("*", every).select("*", strips).select(
        "lang", *both, "strip", F.lit(-1).alias("chunk"), "source", "block", "size", "vocabulary", F.array().cast("array<int>").alias("at"), F.array().cast("array<long>").alias("n"),
    )
    tile = ["lang", "first", "second", "strip"]
    dealt = heads.unionByName(sent).repartition(*tile).sortWithinPartitions(*tile, "chunk", "source")
    sums = dealt.mapInArrow(_tiles, _PAIRS).groupBy("lang", "a", "b", "vocabulary", "size_a", "size_b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    unseen = (F.col("vocabulary") - F.col("seen")) * _apart(_chance(F.lit(0), F.col("size_a")), _chance(F.lit(0), F.col("size_b")))
    return sums.select("lang", "a", "b", F.when(F.col("vocabulary") > 0, F.col("value") + unseen).otherwise(0).cast("long").alias("value"))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): each group against the language's others (`pair`) and its most typical terms (`term`)."""
    found = cut(counts(docs, text, lang, source), "terms")
    known = found.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("df").alias("df")).where(F.col("df") >= LEAST_DOCS)
    known = cut(known.select("lang", "term", "lang_n"), "vocabulary")
    langs = known.groupBy("lang").agg(F.count("*").alias("vocabulary"), F.sum("lang_n").alias("lang_total"))
    langs = cut(langs.withColumn("chunks", F.ceil(F.col("vocabulary") / CHUNK).cast("int")), "langs")
    langs = F.broadcast(langs) if langs.count() <= LANGS else langs  # else rows would meet by language, and stay so for the window below
    placed = known.join(langs.select("lang", "chunks"), "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int"))
    placed = placed.withColumn("place", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1)
    kept = cut(found.where("term <> ''").select("lang", "source", "term", "n").join(placed.drop("chunks"), ["lang", "term"]), "kept")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = found.where("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0)
    size = lambda n: F.col(n) + 2 * F.col("vocabulary")
    groups = groups.withColumn("block", F.expr(f"(row_number() OVER (PARTITION BY lang ORDER BY source) - 1) div {SIDE}").cast("int"))
    groups = groups.withColumn("blocks", F.max("block").over(Window.partitionBy("lang")) + 1).withColumn("size", size("total")).withColumn("lang_size", size("lang_total"))
    groups = cut(groups, "groups")
    drop_cut(found)
    drop_cut(known)

    sums = pair_sums(kept.select("lang", "source", "chunk", "place", "n"), groups.select("lang", "source", "block", "blocks", "chunks", "size", "vocabulary"))
    ways = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    pairs = sums.select("lang", F.inline(ways), "value").select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    own = kept.join(groups.select("lang", "source", "size", "lang_size"), ["lang", "source"])
    own = own.withColumn("p", _chance(F.col("n"), F.col("size"))).withColumn("q", _chance(F.col("lang_n"), F.col("lang_size"))).where("n > 0 and p > q")
    typical = own.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    typical = typical.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(typical)


def op11(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
 g AS (SELECT DISTINCT lang, source FROM d),
 t AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
 v AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= {LEAST_DOCS}),
 c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN v USING (lang, term) GROUP BY ALL),
 a AS (SELECT lang, count(*) AS v, sum(lang_n) AS total FROM v GROUP BY lang),
 s AS (SELECT lang, source, coalesce(any_value(a.v), 0) AS v, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) LEFT JOIN a USING (lang) GROUP BY ALL),
 p AS (SELECT s.lang, s.source, v.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (s.total + 2 * s.v) AS p FROM s JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
 q AS (SELECT v.lang, term, 1 + (1000000000::HUGEINT * (lang_n + 2)) // (total + 2 * a.v) AS q FROM v JOIN a USING (lang)),
 x AS (SELECT p.lang, p.source, o.source AS item, sum(((p.p - o.p) * (p.p - o.p)) // (p.p + o.p)) AS value FROM p JOIN p o ON p.lang = o.lang AND p.term = o.term AND p.source <> o.source GROUP BY ALL),
 y AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
 z AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
   UNION ALL SELECT lang, source, 'term', item, value FROM y)
 SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM z) WHERE part = 'pair' OR rank <= {TOP}"""
