"""For each unit of one document the most similar unit of another: by shared words or by vectors, in blocks.

A pair's units meet in blocks of SIDE against SIDE: every unit is sent once to each block of the other side, so what is shipped grows with
the units, not with the pairs of units, and a task holds two blocks however long a document is. Blocks' results are merged by the greatest score. The first unit wins ties.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.storage import ship, tasks, written

SIDE = 512
#: Up to so many meetings of equal words two blocks are counted at once; beyond, word by word with bounds.
AT_ONCE = 1 << 18
#: Words of so many units at most are rare; so many units are tried before all words are looked up.
RARE, TRIED = 16, 32

#: About so many rows of small meetings are matched in one call.
TOGETHER = 2048

#: (old features, new features, meeting of each old and of each new unit, both ascending) -> place among the old ones and score of each new unit's best.
Kernel = Callable[[pa.Array, pa.Array, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _each(kernel: Kernel, old: pa.Array, new: pa.Array, of_old: np.ndarray, of_new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A kernel for one meeting after the other."""
    places, scores = np.full(len(new), -1), np.zeros(len(new))
    for meeting in np.unique(of_new):
        (a, b), (c, d) = (np.searchsorted(of, [meeting, meeting + 1]) for of in (of_old, of_new))
        if b > a:
            at, scores[c:d] = kernel(old.slice(a, b - a), new.slice(c, d - c))
            places[c:d] = np.where(at >= 0, at + a, -1)
    return places, scores


def by_words(old: pa.ListArray, new: pa.ListArray, of_old: np.ndarray | None = None, of_new: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(place, Jaccard) of each new unit's best old one in its meeting, without meetings of all; place -1 where no word is shared. Lists hold distinct words."""
    of_old, of_new = (np.zeros(len(x), np.int64) if of is None else of for x, of in ((old, of_old), (new, of_new)))
    words = pa.chunked_array([old.flatten(), new.flatten()]).dictionary_encode().combine_chunks()
    code = words.indices.to_numpy().astype(np.int64) if len(words) else np.zeros(0, np.int64)
    old_n, new_n = (x.value_lengths().fill_null(0).to_numpy().astype(np.int64) for x in (old, new))
    split, kinds = int(old_n.sum()), len(words.dictionary) if len(words) else 0
    key = code + kinds * np.repeat(np.concatenate([of_old, of_new]), np.concatenate([old_n, new_n]))
    by_key = np.argsort(key[:split], kind="stable")
    unit, held = np.repeat(np.arange(len(old)), old_n)[by_key], key[:split][by_key]
    first = np.searchsorted(held, key[split:])
    met = np.searchsorted(held, key[split:], "right") - first
    if met.sum() <= AT_ONCE:
        start = np.searchsorted(of_old, of_new)
        width = np.searchsorted(of_old, of_new, "right") - start  # old units of each new one's meeting
        base = np.cumsum(width) - width
        row = np.repeat(np.repeat(np.arange(len(new)), new_n), met)
        at = np.repeat(first - (np.cumsum(met) - met), met) + np.arange(met.sum())
        shared = np.bincount(base[row] + unit[at] - start[row], minlength=int(width.sum()))
        row = np.repeat(np.arange(len(new)), width)
        other = np.arange(len(row)) - base[row] + start[row]
        score = shared / np.maximum(new_n[row] + old_n[other] - shared, 1)
        top, places, some = np.zeros(len(new)), np.full(len(new), -1), width > 0
        if some.any():
            top[some] = np.maximum.reduceat(score, base[some])
            places[some] = np.minimum.reduceat(np.where(score == top[row], other, len(old)), base[some])
        return np.where(top > 0, places, -1), top
    if len(of_new) and (of_old[0] != of_new[-1] or of_old[-1] != of_new[0]):
        return _each(by_words, old, new, of_old, of_new)
    ends = np.searchsorted(code[:split][by_key], np.arange(kinds + 1))
    places, scores = np.full(len(new), -1), np.zeros(len(new))
    starts = np.concatenate([[0], np.cumsum(old_n), split + np.cumsum(new_n)])
    own_words = [code[a:b] for a, b in zip(starts[:-1], starts[1:])]
    for j, own in enumerate(own_words[len(old) :]):
        df = ends[own + 1] - ends[own]
        own = own[df > 0][np.argsort(df[df > 0], kind="stable")]  # rare words first
        if len(own):
            places[j], scores[j] = _bounded(own, int(new_n[j]), old_n, own_words, unit, ends)
    return places, scores


def _shared(rest: np.ndarray, words: np.ndarray) -> int:
    """How many of some words a unit has."""
    return int(np.isin(rest, words).sum())


def _bounded(own: np.ndarray, n: int, old_n: np.ndarray, old_words: list[np.ndarray], unit: np.ndarray, ends: np.ndarray) -> tuple[int, float]:
    """The best unit for words in their order. Rare words are looked up; frequent ones only bound what a unit can reach by them and its size, and units are
    held against them from the highest bound down, until none left can beat the best; where that takes more than TRIED, all words are looked up."""
    shared = np.zeros(len(old_n), np.int64)
    i = 0
    while i < len(own) and ends[own[i] + 1] - ends[own[i]] <= RARE:
        shared[unit[ends[own[i]] : ends[own[i] + 1]]] += 1
        i += 1
    rest = own[i:]
    if len(rest):
        most = np.minimum(shared + len(rest), old_n)
        bound = most / (n + old_n - most)
        best, at = 0.0, len(old_n)
        order = np.argsort(-bound, kind="stable")
        for c in order[:TRIED].tolist():
            if bound[c] < best or (bound[c] == best and c > at):
                return at, best
            both = shared[c] + _shared(rest, old_words[c])
            score = both / (n + old_n[c] - both)
            if score > best or (score == best and c < at):
                best, at = float(score), c
        if len(order) <= TRIED:
            return at, best
        for word in rest:
            shared[unit[ends[word] : ends[word + 1]]] += 1
    score = shared / np.maximum(n + old_n - shared, 1)
    at = int(score.argmax())
    return at, float(score[at])


def by_vectors(old: pa.ListArray, new: pa.ListArray, of_old: np.ndarray | None = None, of_new: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(place, product at 9 decimals) of each new unit's best old one in its meeting; vectors have one length."""
    if of_old is not None:
        return _each(by_vectors, old, new, of_old, of_new)
    a, b = (x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) for x in (old, new))
    score = np.round(b @ a.T, 9)  # so equal units are equal, whatever the order of summation
    best = score.argmax(1)
    return best, score[np.arange(len(b)), best]


def _opens(rows: pa.RecordBatch) -> np.ndarray:
    """Where meetings begin."""
    opens = np.zeros(rows.num_rows, bool)
    opens[:1] = True
    for c in ("old_id", "new_id", "old_block", "new_block"):
        values = rows.column(c).to_numpy(zero_copy_only=False)
        opens[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(opens)


def _matched(kernel: Kernel, rows: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
    """Whole meetings."""
    number = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, rows.num_rows)))
    is_new = rows.column("new").to_numpy(zero_copy_only=False)
    old, new = (rows.filter(pa.array(x)) for x in (~is_new, is_new))
    at, score = kernel(old.column("feature"), new.column("feature"), number[~is_new], number[is_new])
    old_pos = np.full(len(at), -1)
    old_pos[at >= 0] = old.column("pos").to_numpy()[at[at >= 0]]
    return pa.RecordBatch.from_arrays([new.column(c) for c in ("old_id", "new_id", "pos")] + [pa.array(old_pos.astype(np.int32)), pa.array(score.astype(np.float64))], names=["old_id", "new_id", "new_pos", "old_pos", "score"])


def _blocks(kernel: Kernel):
    """Sorted rows of whole meetings, old units first; small meetings are matched many in a call."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # the last meeting, which may go on

        def close(rows: pa.RecordBatch, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Runs of meetings, the last of which ends with the rows."""
            ends, i = np.append(starts[1:], rows.num_rows), 0
            while i < len(starts):
                j = max(i + 1, int(np.searchsorted(ends, starts[i] + TOGETHER, "right")))
                yield _matched(kernel, rows.slice(starts[i], ends[j - 1] - starts[i]), starts[i:j] - starts[i])
                i = j

        for batch in batches:
            rows = batch if rest is None else pa.concat_batches([rest, batch])
            starts = _opens(rows)
            if len(starts):
                yield from close(rows.slice(0, starts[-1]), starts[:-1])
                rest = rows.slice(starts[-1])
        if rest is not None:
            yield from close(rest, np.zeros(1, np.int64))

    return run


def best_partners(pairs: DataFrame, units: DataFrame, kernel: Kernel) -> DataFrame:
    """(old_id, new_id, new_pos, old_pos, score) of every unit of the new side; old_pos is -1 and the score 0 where there is none.

    pairs: (old_id, new_id); units: (doc_id, pos, feature).
    """
    ship(pairs.sparkSession)
    units = written(units.select("doc_id", F.col("pos").cast("int").alias("pos"), "feature"), "units")  # made once: their features are costly
    blocks = units.groupBy("doc_id").agg((F.max(F.expr(f"pos div {SIDE}")) + 1).alias("blocks"))
    of = lambda side: blocks.select(F.col("doc_id").alias(f"{side}_id"), F.col("blocks").alias(f"{side}_blocks"))
    # without old units the new ones still come to one block, and find none
    sides = pairs.join(of("new"), "new_id").join(of("old"), "old_id", "left").withColumn("old_blocks", F.coalesce("old_blocks", F.lit(1).cast("long")))
    own, every = F.expr(f"pos div {SIDE}"), lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    role = lambda side, other: sides.select(F.col(f"{side}_id").alias("doc_id"), "old_id", "new_id", F.lit(side == "new").alias("new"), every(f"{other}_blocks").alias("other"))
    met = role("old", "new").unionByName(role("new", "old")).join(units, "doc_id")
    block = lambda is_new: F.when(F.col("new") == is_new, own).otherwise(F.col("other"))
    met = met.select("old_id", "new_id", block(False).alias("old_block"), block(True).alias("new_block"), "new", "pos", "feature")
    meeting = met.columns[:4]
    met = met.repartition(tasks(pairs.sparkSession), *meeting).sortWithinPartitions(*meeting, "new", "pos")
    kinds = dict(pairs.dtypes)
    found = met.mapInArrow(_blocks(kernel), f"old_id {kinds['old_id']}, new_id {kinds['new_id']}, new_pos int, old_pos int, score double")
    best = F.max(F.struct((F.col("old_pos") >= 0).alias("any"), "score", (-F.col("old_pos")).alias("neg")))
    return found.groupBy("old_id", "new_id", "new_pos").agg(best.alias("b")).select("old_id", "new_id", "new_pos", (-F.col("b.neg")).alias("old_pos"), "b.score")
