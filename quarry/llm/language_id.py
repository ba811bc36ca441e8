"""Language identification with language-bitmask n-gram filters.

Learning counts hashed letter n-grams (two and three letters within words, word ends marked) of all
labelled texts, per language, in one aggregation. A language's set holds the n-grams that make up
at least MIN_SHARE of its own and whose share is not far below that in any other language, so a set
has at most 1 / MIN_SHARE n-grams however large the corpus. The sets are stored as bit-sliced Bloom
filters: every position holds a bit for each language, and the AND over an n-gram's positions is the
mask of all languages that may have it. A text is decided by the per-language counts of set bits,
each corrected for its slice's rate of false positives.

A text that is null or has no letter is `und` with score 0. A text with letters always gets a
learned language (the one with most learned n-grams if no filter has any of its n-grams); ties go to the
first language in order. Without any labelled text, everything is `und`. A row whose doc_id is null is not
held out and not learned from. Extra columns are ignored; repeated rows are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut, drop_cut, table, trim
from quarry.llm.hashing import mix

SLOT_BITS = 20
MIN_SHARE = 1 / 20_000
#: An n-gram belongs to a language's set only if its share there is at least this part of its largest share.
KEEP_RATIO = 0.25
FILTER_BITS = 18
PROBES = 3
_BLOCK = 1 << 18  # characters
#: Languages that a counting worker holds the counts of: 8 MB each.
AT_ONCE = 16

_letters: list[np.ndarray] = []


def _lower_letters() -> np.ndarray:
    """By code point: its lower-case letter's code point, 0 for what is no letter."""
    if not _letters:
        out = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _letters.append(out)
    return _letters[0]


def _blocks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, n-gram slot) pairs of all texts, some characters at a time; n-grams at a cut inside a long text see both sides."""
    letters = _lower_letters()
    group: list[np.ndarray] = []
    who: list[int] = []
    size = 0

    for i, text in enumerate(texts):
        for at in range(0, len(text or ""), _BLOCK):
            raw = text[max(0, at - 1) : at + _BLOCK + 1]
            chars = letters[np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), np.uint32)]
            edge = np.zeros(1, np.uint32)
            lead = edge if at == 0 else chars[:0]
            tail = edge if at + _BLOCK >= len(text) else chars[:0]
            group.append(np.concatenate([lead, chars, tail]))
            who.append(i)
            size += len(raw)
            if size >= _BLOCK:
                yield from _grams(group, who)
                group, who, size = [], [], 0
    if group:
        yield from _grams(group, who)


def _grams(group: list[np.ndarray], who: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    chars = np.concatenate(group).astype(np.uint64)
    owner = np.repeat(np.array(who, np.int64), [len(g) for g in group])
    ends = np.cumsum([len(g) for g in group])
    left, mid, right = chars[:-2], chars[1:-1], chars[2:]
    inner = mid > 0
    inner[ends[:-1] - 1] = False  # a window must not span two texts; the centre then is an edge (0) or a repeated letter
    inner[np.minimum(ends[:-1] - 2, len(inner) - 1)] = False
    at = np.flatnonzero(inner)
    three = left[at] | mid[at] << np.uint64(21) | right[at] << np.uint64(42)
    two = mid[at] | right[at] << np.uint64(21) | np.uint64(1) << np.uint64(63)
    keys = mix(np.concatenate([three, two]) + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)
    text = owner[at + 1]
    yield np.concatenate([text, text]), keys.astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, slot, n) of the n-grams counted; a worker holds the counts of AT_ONCE languages and passes on those of others."""
    totals: dict[str, np.ndarray] = {}

    def flush(name: str) -> pa.RecordBatch:
        counts = totals.pop(name)
        slots = np.flatnonzero(counts)
        return pa.RecordBatch.from_arrays([pa.array([name] * len(slots), pa.string()), pa.array(slots.astype(np.int32)), pa.array(counts[slots])], names=["lang", "slot", "n"])

    for batch in batches:
        by_lang: dict[str, list[str | None]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by_lang.setdefault(lang, []).append(text)
        for name, texts in by_lang.items():
            if name not in totals:
                if len(totals) >= AT_ONCE:
                    yield flush(next(iter(totals)))
                totals[name] = np.zeros(1 << SLOT_BITS, np.int64)
            for _, slot in _blocks(texts):
                totals[name] += np.bincount(slot, minlength=1 << SLOT_BITS)
    while totals:
        yield flush(next(iter(totals)))
    trim()


class Filters:
    """Bit-sliced Bloom filters of the languages' n-gram sets."""

    def __init__(self, sets: dict[str, np.ndarray], bits: int = FILTER_BITS):
        self.langs = sorted(sets)
        self.bits = bits
        self.slices = np.zeros((-(-len(self.langs) // 8), 1 << bits), np.uint8)
        for k, lang in enumerate(self.langs):
            for p in self.positions(np.asarray(sets[lang], np.int64)):
                self.slices[k // 8, p] |= np.uint8(1 << k % 8)
        fill = [float((self.slices[k // 8] >> (k % 8) & 1).mean()) for k in range(len(self.langs))]
        self.false = np.array(fill) ** PROBES
        self.default = max(range(len(self.langs)), key=lambda k: (len(sets[self.langs[k]]), -k), default=-1)

    def positions(self, slots: np.ndarray) -> list[np.ndarray]:
        h = mix(slots.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
        return [(h >> np.uint64(21 * j) & np.uint64((1 << self.bits) - 1)).astype(np.int64) for j in range(PROBES)]

    def hits(self, text: np.ndarray, slots: np.ndarray, texts: int) -> np.ndarray:
        """Per text and language: n-grams of the text that the language's filter contains."""
        at = self.positions(slots)
        out = np.zeros((texts, len(self.langs)), np.int64)
        for w in range(len(self.slices)):
            mask = self.slices[w][at[0]]
            for p in at[1:]:
                mask &= self.slices[w][p]
            by_mask = np.bincount(text * 256 + mask, minlength=texts * 256).reshape(texts, 256)
            for k in range(8 * w, min(len(self.langs), 8 * w + 8)):
                out[:, k] = by_mask[:, (np.arange(256) >> (k % 8) & 1) == 1].sum(1)
        return out

    def decide(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        total, hits = np.zeros(n, np.int64), np.zeros((n, len(self.langs)), np.int64)
        for text, slots in _blocks(texts):
            low, high = int(text.min(initial=n)), int(text.max(initial=-1)) + 1
            if low < high:
                total[low:high] += np.bincount(text - low, minlength=high - low)
                hits[low:high] += self.hits(text - low, slots, high - low)
        if not self.langs:
            return ["und"] * n, np.zeros(n)
        real = np.clip((hits - self.false * total[:, None]) / (1 - np.minimum(self.false, 0.999)), 0, None)
        best = real.argmax(1)
        whole = real.sum(1)
        score = np.where(whole > 0, real.max(1) / np.maximum(whole, 1e-300), 0.0)
        best = np.where(whole > 0, best, self.default)
        return [self.langs[b] if t else "und" for b, t in zip(best.tolist(), total.tolist(), strict=True)], np.where(total > 0, score, 0.0)


def learn(labelled: DataFrame) -> Filters:
    """Filters from (lang, text): counts cover all rows, the driver gets at most 1 / MIN_SHARE n-grams a language."""
    counts = cut(labelled.mapInArrow(_count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")), "ngrams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counts.join(totals, "lang").withColumn("share", F.col("n") / F.col("total"))
    shares = shares.where(F.col("share") >= KEEP_RATIO * MIN_SHARE)
    most = shares.groupBy("slot").agg(F.max("share").alias("most"))
    kept = shares.join(most, "slot").where((F.col("share") >= MIN_SHARE) & (F.col("share") >= KEEP_RATIO * F.col("most")))
    sets: dict[str, list[int]] = {r["lang"]: [] for r in totals.collect()}
    for r in kept.select("lang", "slot").collect():
        sets[r["lang"]].append(r["slot"])
    drop_cut(counts)
    return Filters({lang: np.array(sorted(s), np.int64) for lang, s in sets.items()})


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def _judge(filters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = filters.value
        for batch in batches:
            lang, score = model.decide(batch.column(batch.num_columns - 1).to_pylist())
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    return run


def labelled_part(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    rows = docs.where((F.crc32(F.col(id_col).cast("string")) % 3 != 1) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    return rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))


def identify(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; only the text decides."""
    model = docs.sparkSession.sparkContext.broadcast(filters)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_judge(model), "doc_id long, held_out boolean, lang_pred string, score double")


def _known_only(filters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = filters.value.decide(batch.column("text").to_pylist())
            yield batch.filter(pa.array([x != "und" and s > 0 for x, s in zip(lang, score.tolist(), strict=True)], pa.bool_()))
        trim()

    return run


def keep_known(docs: DataFrame, filters: Filters) -> DataFrame:
    """The rows whose text is in a learned language: not `und`, and some n-gram is known."""
    return docs.mapInArrow(_known_only(docs.sparkSession.sparkContext.broadcast(filters)), docs.schema)


def op6(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(labelled_part(docs)))
