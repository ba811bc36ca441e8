"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Targets: sources in code point order, null last, weigh 1, 2, 3, repeating, and share the corpus; a source
stops at CAP times its size and the rest is shared anew by weight. In order of cap / weight the
capped sources come first, so running sums over one row a source give the final level.

Quotas: as many blocks of BLOCK words as the corpus holds go to the sources one after the other, each to the
highest quotient target / (2 seats + 1); a source's blocks go to its regions of about REGION shards and a region's
to its shards by the same rule, so no task ranks all shards of a source. Only
the last few seats of each party can differ from its plain share, so only those quotients are listed
and ranked.

Selection: documents are dealt to shards of about SHARD words by a seeded hash, and stand there in seeded
order; the shard's blocks are consecutive BLOCK words of that order, and its quota takes blocks
from the start, going round again where it has more than the shard holds, at most CAP times.
Equal rows are counted first and dealt to shards in turn, so no task sorts more than about a shard's documents, however large a source and however often a
document repeats. The plan has a row for each source, which one task orders: meant for up to some millions of sources.

A null text, or one without words, has size 0, is in the result, has no place in a shard and is never taken; a null source is a
source of its own; an empty table
gives no rows. Of equal rows each is taken on its own, those of a shard stand next to each other. Extra
columns are ignored or, by `materialize`, carried along, whatever their names. A document that is taken in part keeps its text up to the
last word taken, blanks and lines as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import WORD, cut, table, words_of

WEIGHTS = (1, 2, 3)
CAP = 3
BLOCK = 64
SHARD = 1 << 18
REGION = 1024
SEED = "mix-1"


def _hash60(key: Column, part: int) -> Column:
    """15 hex digits of an MD5 as a number; part 0 and 1 are independent."""
    return F.conv(F.substring(key, 1 + 15 * part, 15), 16, 10).cast("long")


def _targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> with weight and target."""
    everything = Window.partitionBy()
    total, cap = F.sum("source_size").over(everything), F.lit(CAP) * F.col("source_size")
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pick = (F.row_number().over(by_name) - 1) % len(WEIGHTS)
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (pick + 1).cast("int"))).withColumn("total", total)
    by_level = Window.orderBy(F.col("source_size") * CAP / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - F.coalesce(F.sum(cap).over(before), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    leveled = weighed.withColumn("level", level).withColumn("place", F.row_number().over(by_level))
    leveled = leveled.withColumn("full", cap <= F.col("weight") * F.col("level"))
    first = F.min(F.when(~F.col("full"), F.struct("place", "level"))).over(everything)
    leveled = leveled.withColumn("first", first)
    full = F.col("first").isNull() | (F.col("place") < F.col("first.place"))
    target = F.when(full, cap.cast("double")).otherwise(F.col("weight") * F.col("first.level"))
    return leveled.select("source", "source_size", "weight", "total", target.alias("target"))


def _seats(parties: DataFrame, votes: Column, all_votes: Column, seats: Column, room: Column, within: list[str], key: list[Column]) -> DataFrame:
    """Sainte-Lague: parties with their quota. Seats that are sure are given, those near the border are ranked."""
    group = Window.partitionBy(*within)
    p = parties.withColumn("votes", votes.cast("double")).withColumn("room", room)
    share = F.when(all_votes > 0, F.col("votes") / all_votes).otherwise(0.0)
    p = p.withColumn("near", (F.ceil(share * F.count("*").over(group)) + 2).cast("long"))
    p = p.withColumn("sure", F.least("room", F.greatest(F.lit(0), F.floor(share * seats) - F.col("near"))).cast("long"))
    p = p.withColumn("left", (seats - F.sum("sure").over(group)).cast("long"))
    upto = F.least(F.col("room"), F.col("sure") + 2 * F.col("near") + 2)
    claims = p.withColumn("seat", F.explode_outer(F.when(upto > F.col("sure"), F.sequence(F.col("sure") + 1, upto))))
    quotient = F.col("votes") / (2 * F.col("seat") - 1)
    order = Window.partitionBy(*within).orderBy(quotient.desc_nulls_last(), *key, "seat")
    won = claims.withColumn("won", (F.row_number().over(order) <= F.col("left")) & F.col("seat").isNotNull())
    same = [c for c in parties.columns]
    return won.groupBy(*same).agg((F.first("sure") + F.count_if("won")).alias("quota"))


def _keyed(id_col: str, text_col: str, source_col: str) -> list[Column]:
    """source, size and the seeded key of a row."""
    text = F.col(text_col).cast("string")
    key = F.md5(F.concat_ws(":", F.lit(SEED), F.col(id_col).cast("string"), text))
    return [F.col(source_col).alias("source"), F.size(words_of(text)).cast("long").alias("size"), key.alias("key")]


def _taken(groups: DataFrame) -> DataFrame:
    """Groups of equal rows (source, size, key, copies, ...) -> a row for each copy: its source's size and target, whole passes, and the words of a last part pass.

    The copies of a group are dealt to as many shards in turn as it has copies, so they fill no shard of their own; in a shard they stand together.
    """
    own = groups.columns
    sources = groups.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    plan = cut(_targets(sources), "targets")
    by_name = [F.col("source").asc_nulls_last()]
    blocks = F.round(F.col("total") / BLOCK)
    plan = cut(_seats(plan, F.col("target"), F.col("total"), blocks, F.floor(F.col("source_size") * CAP / BLOCK), [], by_name), "quotas")
    plan = plan.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD)).cast("long")).withColumnRenamed("quota", "source_quota")
    plan = plan.withColumn("regions", F.ceil(F.col("shards") / REGION))
    to = groups.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))).drop(F.col("p.source"))
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.least("copies", "shards") - 1)).alias("turn")
    share = F.expr("copies div shards") + (F.col("turn") < F.col("copies") % F.col("shards")).cast("long")
    pieces = to.select("*", piece).withColumn("shard", (_hash60(F.col("key"), 0) + F.col("turn")) % F.col("shards")).withColumn("region", F.col("shard") % F.col("regions")).withColumn("share", share)

    named = ["source", "shard", "region", "source_size", "source_quota"]
    shards = pieces.groupBy(*named).agg(F.sum(F.col("size") * F.col("share")).alias("shard_size")).withColumn("room", F.floor(F.col("shard_size") * CAP / BLOCK))
    shards = cut(shards, "shards")
    regions = shards.groupBy("source", "region", "source_size", "source_quota").agg(F.sum("shard_size").alias("region_size"), F.sum("room").alias("region_room"))
    regions = _seats(regions, F.col("region_size"), F.col("source_size"), F.col("source_quota"), F.col("region_room"), ["source"], [F.col("region")])
    r = regions.select(F.col("source").alias("r_source"), F.col("region").alias("r_region"), "region_size", F.col("quota").alias("region_quota"))
    shards = shards.join(r, F.col("source").eqNullSafe(F.col("r_source")) & (F.col("region") == F.col("r_region"))).drop("r_source", "r_region")
    quotas = _seats(shards, F.col("shard_size"), F.col("region_size"), F.col("region_quota"), F.col("room"), ["source", "region"], [F.col("shard")])
    quotas = cut(quotas.select("source", "shard", "shard_size", "quota"), "quotas")

    same = [c for c in own if c not in ("source", "size", "key", "copies")]
    in_shard = Window.partitionBy("source", "shard").orderBy(_hash60(F.col("key"), 1), "key", *same).rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.where("size > 0").withColumn("start", F.coalesce(F.sum(F.col("size") * F.col("share")).over(in_shard), F.lit(0)))
    q = quotas.alias("q")
    placed = placed.join(q, F.col("q.source").eqNullSafe(placed["source"]) & (F.col("q.shard") == placed["shard"])).drop(F.col("q.source"), F.col("q.shard"))
    words = F.col("quota") * BLOCK
    passes = F.when(F.col("shard_size") > 0, F.floor(words / F.col("shard_size"))).otherwise(0).cast("long")
    each = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("share") - 1))).withColumn("start", F.col("start") + F.col("copy") * F.col("size"))
    rest = words - passes * F.col("shard_size")
    part = F.greatest(F.lit(0), F.least(F.col("start") + F.col("size"), rest) - F.col("start")).cast("long")
    shown = [*own, "source_size", "target", "passes", "part"]
    empty = to.where("size = 0").select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"), *[F.lit(0).cast("long").alias(c) for c in ("passes", "part")])
    return each.withColumn("passes", passes).withColumn("part", part).select(*shown).unionByName(empty.select(*shown))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken and, of the taken words, whole passes and the words of a last part pass."""
    rows = docs.select(F.col(id_col).alias("doc_id"), *_keyed(id_col, text_col, source_col))
    groups = cut(rows.groupBy(*rows.columns).agg(F.count("*").alias("copies")), "sizes")
    return _taken(groups).select("doc_id", "size", "source_size", "target", (F.col("passes") * F.col("size") + F.col("part")).alias("taken"), "passes", "part")


def materialize(docs: DataFrame) -> DataFrame:
    """The mix itself: a row for each whole pass of a document, and one with its first words for a part pass."""
    keyed = docs.select(F.struct("*").alias("row"), F.md5(F.to_json(F.struct("*"))).alias("same"), *_keyed("doc_id", "text", "source"))
    groups = cut(keyed.groupBy("source", "size", "key", "same").agg(F.count("*").alias("copies")), "sizes")
    taken = _taken(groups).where("passes > 0 or part > 0").select("key", "same", "size", "passes", "part")
    once = keyed.where("size > 0").groupBy("key", "same").agg(F.first("row").alias("row"))  # equal rows stand for each other
    mixed = once.join(taken, ["key", "same"])
    whole = F.col("part") == F.col("size")
    copies = F.col("passes") + F.when((F.col("part") > 0), 1).otherwise(0)
    turn = mixed.withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    cut_short = (F.col("turn") > F.col("passes")) & ~whole
    n = F.greatest(F.col("part"), F.lit(1)).cast("int")
    blanks, words = F.slice(F.split("row.text", WORD, -1), 1, n), F.slice(words_of(F.col("row.text")), 1, n)
    start = F.array_join(F.zip_with(blanks, words, lambda b, w: F.concat(b, w)), "")  # the text up to its last word taken
    text = F.when(cut_short, start).otherwise(F.col("row.text"))
    named = [F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    out = turn.select(*[text.alias("text") if c == "text" else n for c, n in zip(docs.columns, named, strict=True)])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op8(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: The same in DuckDB SQL.
ORACLE = f"""
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
         md5(concat_ws(':', '{SEED}', doc_id::VARCHAR, text)) AS key FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, (sum(source_size) OVER ())::BIGINT AS total FROM src),
lv AS (SELECT *, row_number() OVER o AS place,
         (total - coalesce(sum({CAP} * source_size) OVER b, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level
       FROM w WINDOW o AS (ORDER BY source_size * {CAP}::DOUBLE / weight, source NULLS LAST),
                     b AS (ORDER BY source_size * {CAP}::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fi AS (SELECT min(place) AS place, arg_min(level, place) AS level FROM lv WHERE NOT {CAP} * source_size <= weight * level),
tg AS (SELECT source, source_size, total,
         CASE WHEN fi.place IS NULL OR lv.place < fi.place THEN ({CAP} * source_size)::DOUBLE ELSE weight * fi.level END AS target FROM lv, fi),
sq AS (SELECT source, k FROM (SELECT source, k, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, source NULLS LAST, k) AS r, total
        FROM tg, LATERAL (SELECT unnest(generate_series(1, (source_size * {CAP} // {BLOCK})::BIGINT)) AS k)) WHERE r <= round(total / {BLOCK}::DOUBLE)),
pl AS (SELECT *, ceil(shards / {REGION}::DOUBLE)::BIGINT AS regions FROM (SELECT tg.*, (SELECT count(*) FROM sq WHERE sq.source IS NOT DISTINCT FROM tg.source) AS quota, greatest(1, ceil(source_size / {SHARD}::DOUBLE))::BIGINT AS shards FROM tg)),
d AS (SELECT *, shard % regions AS region FROM (SELECT base.*, pl.source_size, pl.target, pl.quota AS source_quota, pl.regions, (('0x' || substr(key, 1, 15))::BIGINT + row_number() OVER (PARTITION BY base.source, doc_id, size, key) - 1) % shards AS shard,
        ('0x' || substr(key, 16, 15))::BIGINT AS place FROM base JOIN pl ON base.source IS NOT DISTINCT FROM pl.source)),
sh AS (SELECT source, region, shard, source_quota, sum(size)::BIGINT AS shard_size FROM d GROUP BY ALL),
rg AS (SELECT source, region, source_quota, sum(shard_size) AS region_size, sum((shard_size * {CAP}) // {BLOCK})::BIGINT AS room FROM sh GROUP BY ALL),
rq AS (SELECT source, region, count(*) AS region_quota FROM (SELECT source, region, k, source_quota, row_number() OVER (PARTITION BY source ORDER BY region_size / (2 * k - 1)::DOUBLE DESC, region, k) AS r
        FROM rg, LATERAL (SELECT unnest(generate_series(1, room)) AS k)) WHERE r <= source_quota GROUP BY ALL),
hq AS (SELECT source, shard, k FROM (SELECT sh.source, shard, k, region_quota, row_number() OVER (PARTITION BY sh.source, sh.region ORDER BY shard_size / (2 * k - 1)::DOUBLE DESC, shard, k) AS r
        FROM sh JOIN rq ON sh.source IS NOT DISTINCT FROM rq.source AND sh.region = rq.region, LATERAL (SELECT unnest(generate_series(1, (shard_size * {CAP} // {BLOCK})::BIGINT)) AS k)) WHERE r <= region_quota),
qc AS (SELECT source, shard, count(*) AS quota FROM hq GROUP BY ALL),
st AS (SELECT d.*, sh.shard_size, coalesce(qc.quota, 0) * {BLOCK} AS words,
         coalesce(sum(size) OVER (PARTITION BY d.source, d.shard ORDER BY place, key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
       FROM d JOIN sh ON d.source IS NOT DISTINCT FROM sh.source AND d.shard = sh.shard
       LEFT JOIN qc ON d.source IS NOT DISTINCT FROM qc.source AND d.shard = qc.shard),
en AS (SELECT *, CASE WHEN shard_size > 0 THEN words // shard_size ELSE 0 END AS passes FROM st)
SELECT doc_id, size, source_size, target,
       (passes * size + greatest(0, least(start + size, words - passes * shard_size) - start))::BIGINT AS taken FROM en
"""
