"""A stored inverted index: term-partitioned posting blocks with block maxima, segments that are merged, and top-k that skips blocks.

Arrivals become a segment. One scan turns texts into a forward table (document, measures, terms with counts, or words in order where pairs of them count too); postings come
from that table alone. Each task gathers a run of documents into a row for each term, and only such rows are exchanged. Documents are numbered
within shards of SHARD; a term's documents in a shard are one row: places as 16-bit numbers, counts, and
for each cell of CELL places that has any the end of its block and its greatest count. Rows lie in folders by a hash of the term, sorted by term, so a question reads the
folders and row groups of its own terms. A manifest names the live segments with their numbers of documents and terms; it is committed
atomically, so readers see whole versions, and `merge` makes one segment of many small ones from their forward tables, without the texts.

Ranking takes the statistics of all segments. Each task holds shards' rows of the questions' terms; for every question it bounds each cell's score by the block
maxima and the cell's least norm, visits cells from the highest bound down, and stops where no cell can reach the k-th score: blocks beyond that are not unpacked.
Results are those of scoring all documents. Keys must be unique over all segments; a null text has no terms.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.text import tokens
from quarry.operators.retrieval import B, FEATURES, K1, SENT, STOP, gram_words, uni_bigrams
from quarry.operators.storage import Manifest, ship, tasks, written

SHARD, CELL, BUCKETS = 1 << 16, 128, 16
#: Segments with fewer documents than this are merged; a merge starts with MERGE of them.
SMALL, MERGE = 1 << 20, 8
#: At most so many questions' terms are looked up by a filter that the scan can use.
FILTERED = 2_000
#: About so many questions share a task's rows of a shard.
TOGETHER = 32
#: Words or postings that are worked on at once; batches are cut into runs of rows of about so many.
COUNTED, SPELLED, PACKED = 1 << 18, 1 << 19, 1 << 20
#: Words and pairs are counted by slots first (a power of two), which are summed in chunks of CHUNK. Those of slots with enough are counted one by one: of so many times more slots than there are features, of more where that was too few.
SLOTS, CHUNK, WIDER = 1 << 22, 1 << 13, (2, 16)
_PARTS = "term string, shard long, first int, docs binary, tfs binary"
_POSTINGS = "term string, shard long, n int, docs binary, tfs binary, cells binary, ends binary, peaks binary"


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most so much together, a row at least."""
    ends, at = np.cumsum(sizes), 0
    while at < len(ends):
        done = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield at, stop
        at = stop


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column's lists of words become terms, in no order, and counts; a run of rows at a time, so a worker holds a batch and little more."""
    for batch in batches:
        sizes = np.diff(batch.column(batch.num_columns - 1).offsets.to_numpy().astype(np.int64))
        for a, b in _runs(sizes, COUNTED):
            yield _counted(batch.slice(a, b - a))


def _counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    lists = batch.column(batch.num_columns - 1)
    at = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
    kinds = max(1, len(coded.dictionary))
    row = np.repeat(np.arange(len(lists)), np.diff(at))
    keys, n = np.unique(row * kinds + coded.indices.to_numpy(), return_counts=True)
    ends = pa.array(np.searchsorted(keys, np.arange(len(lists) + 1) * kinds).astype(np.int32))
    terms = pa.ListArray.from_arrays(ends, coded.dictionary.take(pa.array(keys % kinds)))
    tfs = pa.ListArray.from_arrays(ends, pa.array(n.astype(np.int32)))
    return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.diff(at)), terms, tfs], names=[*batch.schema.names[:-1], "size", "terms", "tfs"])


_INSIDE = np.zeros(256, bool)
_INSIDE[[*b"abcdefghijklmnopqrstuvwxyz0123456789-"]] = True


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of strings or binaries without nulls, and where each starts and the last ends."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if ends[-1] else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column's texts, in lower case, become lists of the words that `tokens` finds."""
    for batch in batches:
        texts = pc.fill_null(batch.column(batch.num_columns - 1), "")
        for a, b in _runs(pc.binary_length(texts).to_numpy(), 8 * COUNTED):
            yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[:-1], _words(texts.slice(a, b - a))], names=batch.schema.names)


def _words(texts: pa.Array) -> pa.Array:
    """Runs of letters, digits and hyphens, all ASCII, from the first that is no hyphen, if two characters at least are left."""
    data, at = _bytes(texts)
    inside = _INSIDE[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    begin, last = at[:-1][at[:-1] < len(data)], at[1:][at[1:] > 0] - 1  # a run ends with its text
    opens[begin], closes[last] = inside[begin], inside[last]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    lead = np.flatnonzero(data[start] == ord("-"))
    if len(lead):
        letters = np.append(np.flatnonzero(inside & (data != ord("-"))), len(data))
        start[lead] = letters[np.searchsorted(letters, start[lead])]
    start, end = start[end - start >= 2], end[end - start >= 2]
    edge = np.zeros(len(data) + 1, np.int8)
    edge[start] += 1
    edge[end] -= 1
    held = data[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)]
    values = pa.StringArray.from_buffers(len(start), pa.py_buffer(np.append(0, np.cumsum(end - start)).astype(np.int32)), pa.py_buffer(held))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(start, at).astype(np.int32)), values)


def _split(texts: pa.Array) -> pa.Array:
    """The words of texts that have one blank between two words, and no other."""
    data, at = _bytes(texts)
    blank = data == ord(" ")
    opens = np.append(False, blank[:-1])[: len(data)]
    opens[at[:-1][np.diff(at) > 0]] = True
    start, held = np.flatnonzero(opens), data[~blank]
    ends = np.append(start - np.searchsorted(np.flatnonzero(blank), start), len(held)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(start, at).astype(np.int32)), pa.StringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(held)))


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of terms and counts, the last two columns, as binaries: terms one after the other, their lengths, counts."""
    for batch in batches:
        lists, tfs = batch.columns[-2:]
        at = lists.offsets.to_numpy().astype(np.int64)
        data, ends = _bytes(lists.values.slice(at[0], at[-1] - at[0]))
        at, counts = at - at[0], tfs.values.to_numpy()[tfs.offsets[0].as_py() : tfs.offsets[-1].as_py()]
        packed = [_binary(data, ends[at]), _binary(np.diff(ends).astype(np.uint32), at), _binary(counts.astype(np.uint32), at)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *packed], names=[*batch.schema.names[:-2], "terms", "lengths", "tfs"])


def _stored(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    """What `_store` was given: lists of terms, and all their counts."""
    data, lengths, tf = (_bytes(batch.column(c))[0] for c in ("terms", "lengths", "tfs"))
    ends = np.append(0, np.cumsum(lengths.view(np.uint32), dtype=np.int64)).astype(np.int32)
    values = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data)))
    return pa.ListArray.from_arrays(pa.array((_bytes(batch.column("tfs"))[1] // 4).astype(np.int32)), values), tf.view(np.uint32)


def _count_and_store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _store(_count(batches))


def _cut_and_store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _store(_count(_cut(batches)))


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Slices of an array as binaries."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, shard, list of (place, count) in the order of places) -> a row of packed blocks."""
    for whole in batches:
        yield from (_packed(whole.slice(a, b - a)) for a, b in _runs(np.diff(whole.column("list").offsets.to_numpy().astype(np.int64)), PACKED))


def _packed(batch: pa.RecordBatch) -> pa.RecordBatch:
    lists = batch.column("list")
    at = lists.offsets.to_numpy().astype(np.int64)
    place, tf = (lists.values.field(k).to_numpy()[at[0] : at[-1]] for k in ("place", "tf"))
    at -= at[0]
    n = np.diff(at)
    row = np.repeat(np.arange(len(n)), n)
    opens = np.ones(len(place), bool)
    opens[1:] = (np.diff(place // CELL) != 0) | (np.diff(row) != 0)
    first = np.flatnonzero(opens)
    blocks = np.searchsorted(first, at)
    ends = np.append(first[1:], len(place)) - at[row[first]] if len(first) else first
    peaks = np.maximum.reduceat(tf, first) if len(first) else tf
    packed = [_binary(place.astype(np.uint16), at), _binary(tf.astype(np.uint32), at), _binary((place[first] // CELL).astype(np.uint16), blocks), _binary(ends.astype(np.uint32), blocks), _binary(peaks.astype(np.uint32), blocks)]
    return pa.RecordBatch.from_arrays([batch.column("term"), batch.column("shard"), pa.array(n.astype(np.int32)), *packed], names=[x.split()[0] for x in _POSTINGS.split(", ")])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forward rows (shard, place, terms, lengths, tfs) become parts of postings, a run of rows at a time."""
    for whole in batches:
        for a, b in _runs(pc.binary_length(whole.column("tfs")).to_numpy() // 4, PACKED):
            batch = whole.slice(a, b - a)
            lists, tf = _stored(batch)
            words, code, row = _coded(lists)
            yield _parts(words, code, row, tf, *(batch.column(c).to_numpy() for c in ("shard", "place")))


def _coded(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of lists; of each word its number among these, and the number of its list."""
    at = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(lists)), np.diff(at))


def _parts(names: pa.Array, code: np.ndarray, row: np.ndarray, tf: np.ndarray, shard: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """A row for each name and shard: its places, in their order, and counts."""
    turn = np.empty(len(shard), np.int64)
    turn[np.lexsort((place, shard))] = np.arange(len(shard))
    order = np.argsort(code * len(shard) + turn[row])
    code, row = code[order], row[order]
    opens = np.ones(len(code), bool)
    opens[1:] = (np.diff(code) != 0) | (np.diff(shard[row]) != 0)
    first = np.flatnonzero(opens)
    ends = np.append(first, len(code))
    packed = [_binary(place[row].astype(np.uint16), ends), _binary(tf[order].astype(np.uint32), ends)]
    return pa.RecordBatch.from_arrays([names.take(pa.array(code[first])), pa.array(shard[row[first]]), pa.array(place[row[first]].astype(np.int32)), *packed], names=["term", "shard", "first", "docs", "tfs"])


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts in the order of terms and shards -> (term, shard, list of (place, count)) as `_pack` takes them; the last group waits for the next batch."""
    kept = None
    for batch in batches:
        rows = batch if kept is None else pa.concat_batches([kept, batch])
        if rows.num_rows:
            first = _opens(rows)
            kept = rows.slice(first[-1])
            yield from _joined(rows.slice(0, first[-1]), first)
    if kept is not None:
        yield from _joined(kept, np.array([0, kept.num_rows]))


def _opens(rows: pa.RecordBatch) -> np.ndarray:
    """The first rows of each term and shard."""
    term, shard = rows.column("term"), rows.column("shard").to_numpy()
    other = pc.not_equal(term.slice(1), term.slice(0, len(term) - 1)).to_numpy(zero_copy_only=False)
    return np.append(0, np.flatnonzero(other | (np.diff(shard) != 0)) + 1)


def _joined(rows: pa.RecordBatch, first: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of groups that begin at all but the last of `first`, a run of groups at a time."""
    sizes = np.append(0, np.cumsum(pc.binary_length(rows.column("docs")).to_numpy().astype(np.int64) // 2))[first]
    for a, b in _runs(np.diff(sizes), PACKED):
        some = rows.slice(first[a], first[b] - first[a])
        place, tf = (_bytes(some.column(c))[0].view(kind).astype(np.int64) for c, kind in (("docs", np.uint16), ("tfs", np.uint32)))
        group = np.repeat(np.arange(b - a), np.diff(sizes[a : b + 1]))
        if np.any((np.diff(place) <= 0) & (np.diff(group) == 0)):  # documents that a merge has numbered anew came in another order
            order = np.lexsort((place, group))
            place, tf = place[order], tf[order]
        lists = pa.ListArray.from_arrays(pa.array((sizes[a : b + 1] - sizes[a]).astype(np.int32)), pa.StructArray.from_arrays([pa.array(place.astype(np.int32)), pa.array(tf)], ["place", "tf"]))
        heads = pa.array(first[a:b] - first[a])
        yield pa.RecordBatch.from_arrays([some.column("term").take(heads), some.column("shard").take(heads), lists], names=["term", "shard", "list"])


def _join_and_pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _pack(_join(batches))


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of a run of rows with words in order: the rows, the different words, each word's number and row, and the places of words that another of their row follows."""
    for whole in batches:
        for a, b in _runs(pc.binary_length(whole.column("terms")).to_numpy(), 8 * SPELLED):
            batch = whole.slice(a, b - a)
            words, code, row = _coded(_split(batch.column("terms")))
            yield batch, words, code, row, np.flatnonzero(np.diff(row) == 0)


def _slots(words: pa.Array, code: np.ndarray, pairs: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """The slots of words and of pairs: alike in all tasks."""
    data, ends = _bytes(words)
    size = np.diff(ends)
    power = np.cumprod(np.full(size.max(initial=0), 0xD6E8FEB86659FD93, np.uint64))
    each = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * power[np.arange(len(data)) - np.repeat(ends[:-1], size)], ends[:-1])

    def slot(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return (x >> np.uint64(64 - (slots.bit_length() - 1))).astype(np.int64)

    one, two = each * np.uint64(0xBF58476D1CE4E5B9), each * np.uint64(0x94D049BB133111EB) + np.uint64(1)
    return slot(one)[code], slot(one[code[pairs]] + two[code[pairs + 1]])


def _tally(slots: int):
    """Words in order -> how often each slot is met, in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.int64)
        for _, words, code, _, pairs in _spelled(batches):
            for met in _slots(words, code, pairs, slots):
                np.add.at(total, met, 1)
        if total.any():
            for c in range(-(-slots // CHUNK)):
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([total[c * CHUNK : (c + 1) * CHUNK].tobytes()])], names=["chunk", "counts"])

    return run


def _added(rows: pa.Table) -> pa.Table:
    """The sum of a chunk's counts."""
    total = sum(np.frombuffer(x.as_buffer(), np.int64) for x in rows["counts"])
    return pa.table([pa.array([rows["chunk"][0].as_py()], pa.int32()), pa.array([total.tobytes()])], names=["chunk", "counts"])


#: Classes of counts, eight for a doubling.
_EDGES = np.unique(np.ceil(2 ** (np.arange(8 * 62) / 8)).astype(np.int64))


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many slots have counts of each class."""
    for batch in batches:
        for x in batch.column("counts"):
            count = np.frombuffer(x.as_buffer(), np.int64)
            edge, n = np.unique(_EDGES[np.searchsorted(_EDGES, count[count > 0], "right") - 1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(edge), pa.array(n.astype(np.int64))], names=["edge", "n"])


def _reached(least: int):
    """Chunks -> a bit a slot: whether it was met so often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [np.packbits(np.frombuffer(x.as_buffer(), np.int64) >= least).tobytes() for x in batch.column("counts")]
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array(bits, pa.binary())], names=["chunk", "bits"])

    return run


def _heads(keys: np.ndarray) -> np.ndarray:
    """Where sorted keys change, and their number."""
    return np.append(np.flatnonzero(np.append(True, np.diff(keys) != 0)[: len(keys)]), len(keys))


def _frequent(bits: bytes, slots: int):
    """Words in order -> (term, df, times), of a run of rows, of the words and pairs in slots whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.unpackbits(np.frombuffer(bits, np.uint8))[:slots].astype(bool)
        for batch, words, code, row, pairs in _spelled(batches):
            one, two = (held[met] for met in _slots(words, code, pairs, slots))
            wide, rows = len(words) + 1, batch.num_rows
            keys = np.concatenate([code[one] * wide * rows + row[one], (code[pairs[two]] * wide + code[pairs[two] + 1] + 1) * rows + row[pairs[two]]])
            keys.sort()
            each = _heads(keys)  # of a term and document
            term = keys[each[:-1]] // rows
            first = _heads(term)
            times, df, term = np.diff(each[first]), np.diff(first), term[first[:-1]]
            a, b = words.take(pa.array(term // wide)), words.take(pa.array(term % wide - 1, mask=term % wide == 0))
            names = pc.if_else(b.is_null(), a, pc.binary_join_element_wise(a, b, " "))
            yield pa.RecordBatch.from_arrays([names, pa.array(df.astype(np.int64)), pa.array(times.astype(np.int64))], names=["term", "df", "times"])

    return run


def _known(terms: list[str], idf: list[float]):
    """Words in order -> parts of postings of some features, and rows without a term: documents' places with the sum of squares of what these features weigh."""
    split = [t.partition(" ")[::2] for t in terms]
    held = sorted({w for t in split for w in t if w})
    number = {w: i for i, w in enumerate(held)}
    single = np.full(len(held), -1)
    for i, (a, b) in enumerate(split):
        if not b:
            single[number[a]] = i
    pairs_ = sorted((number[a] * len(held) + number[b], i) for i, (a, b) in enumerate(split) if b)
    joint, feature = (np.array([x[k] for x in pairs_], np.int64) for k in (0, 1))
    weight = np.array(idf, float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, known = pa.array(terms, pa.string()), pa.array(held, pa.string())
        for batch, words, code, row, pairs in _spelled(batches):
            rows, n = batch.num_rows, pc.fill_null(pc.index_in(words, known), -1).to_numpy().astype(np.int64)[code]
            one = np.flatnonzero(n >= 0)
            one = one[single[n[one]] >= 0]
            two = pairs[(n[pairs] >= 0) & (n[pairs + 1] >= 0)]
            key = n[two] * len(held) + n[two + 1]
            at = np.minimum(np.searchsorted(joint, key), max(0, len(joint) - 1))
            hit = joint[at] == key if len(joint) else np.zeros(len(key), bool)
            keys = np.concatenate([single[n[one]] * rows + row[one], feature[at[hit]] * rows + row[two[hit]]])
            keys, tf = np.unique(keys, return_counts=True)
            code_, row_ = keys // max(1, rows), keys % max(1, rows)
            shard, place = (batch.column(c).to_numpy() for c in ("shard", "place"))
            parts = _parts(names, code_, row_, tf, shard, place)
            none = pa.nulls(parts.num_rows, pa.list_(pa.int32())), pa.nulls(parts.num_rows, pa.list_(pa.float64()))
            columns = [*parts.schema.names, "places", "squares"]
            yield pa.RecordBatch.from_arrays([*parts.columns, *none], names=columns)
            squares = np.bincount(row_, ((1 + np.log(tf)) * weight[code_]) ** 2, minlength=rows)
            for s in np.unique(shard[squares > 0]):
                mine = (shard == s) & (squares > 0)
                head = [pa.nulls(1, pa.string()), pa.array([s], pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary())]
                yield pa.RecordBatch.from_arrays([*head, pa.array([place[mine].astype(np.int32)]), pa.array([squares[mine]])], names=columns)

    return run


@dataclass
class Ranking:
    """How a posting counts: `value` of counts and norms (greater for greater counts and smaller norms), and what a question's term weighs."""

    value: Callable[[np.ndarray, np.ndarray], np.ndarray]
    norms: DataFrame  # (shard, place, key, norm, keep)
    weights: DataFrame  # (query, term, weight)
    terms: list[str] | DataFrame  # as `postings` takes them


class InvertedIndex:
    """Documents' terms under one folder; `words` gives a text's terms as a column of arrays."""

    def __init__(self, spark: SparkSession, root: str, words: Callable[[Column], Column] = tokens, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()):
        self.spark, self.root, self.words, self.key, self.text, self.kept = spark, root.rstrip("/"), words, key, text, keep
        self.manifest = Manifest(spark, root)
        ship(spark)

    # --- segments ---

    def segments(self, version: int | None = None) -> dict[str, dict]:
        """Name -> {number, docs, size} of the live ones."""
        return self.manifest.read(version).get("data", {})

    def _read(self, table: str, segments: dict[str, dict]) -> DataFrame:
        """One scan over all segments' tables."""
        if not segments:
            raise ValueError("nothing has been added to the index yet")
        rows = self.spark.read.schema(self.manifest.read()["schema"] if table == "forward" else f"{_POSTINGS}, bucket int")
        return rows.option("basePath", f"{self.root}/{table}").parquet(*[f"{self.root}/{table}/segment={s}" for s in segments])

    def _rows(self) -> DataFrame:
        """All postings."""
        return self._read("postings", self.segments())

    def _number(self, name: str) -> int:
        return int(name[2:], 16) % (1 << 21)

    def _write(self, parts: DataFrame, path: str) -> None:
        """Postings of parts; a term's lists are bounded by the shard's size, its shards are dealt to all tasks of its folder."""
        bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")
        each = -(-tasks(self.spark) // BUCKETS)
        dealt = parts.repartitionById(BUCKETS * each, bucket * each + F.pmod(F.xxhash64("shard", "term"), F.lit(each)).cast("int"))
        packed = dealt.sortWithinPartitions("term", "shard", "first").mapInArrow(_join_and_pack, _POSTINGS).withColumn("bucket", bucket)
        sorted_ = packed.sortWithinPartitions("bucket", "term", "shard")
        sorted_.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", 8 << 20).partitionBy("bucket").parquet(path)

    def _postings(self, name: str) -> None:
        """Postings of a segment from its forward table."""
        forward = self.spark.read.parquet(f"{self.root}/forward/segment={name}").select("shard", "place", "terms", "lengths", "tfs")
        self._write(forward.mapInArrow(_gather, _PARTS), f"{self.root}/postings/segment={name}")

    def _forward(self, docs: DataFrame, columns: list[Column]) -> DataFrame:
        """The columns, with each document's terms and counts."""
        cut = self.words is tokens  # a worker cuts texts into these words itself
        rows = docs.select(*columns, (F.lower(F.col(self.text)) if cut else self.words(F.col(self.text))).alias("words"))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "words") + ", size long, terms binary, lengths binary, tfs binary"
        return rows.mapInArrow(_cut_and_store if cut else _count_and_store, schema)

    def _finish(self, name: str, schema: str, replaced: tuple[str, ...] = ()) -> str:
        self._postings(name)
        sums = self.spark.read.parquet(f"{self.root}/forward/segment={name}").agg(F.count("*").alias("docs"), F.sum("size").alias("size")).first()
        entry = {"number": self._number(name), "docs": sums["docs"], "size": sums["size"] or 0}

        def edit(content: dict) -> dict:
            data = content.get("data", {})
            if any(r not in data for r in replaced) or entry["number"] in {x["number"] for x in data.values()}:
                raise RuntimeError(f"segments have changed meanwhile: {name} is not committed")
            return {"schema": schema, "data": {k: v for k, v in data.items() if k not in replaced} | {name: entry}}

        self.manifest.change(edit)
        return name

    def append(self, docs: DataFrame) -> str:
        """Add documents as a segment."""
        name = f"s-{uuid.uuid4().hex}"
        n = F.monotonically_increasing_id()
        within = n.bitwiseAND(F.lit((1 << 33) - 1))
        shard = F.shiftleft(F.lit(self._number(name)).cast("long"), 41) + F.shiftleft(F.shiftright(n, 33), 20) + F.floor(within / SHARD)
        rows = self._forward(docs, [shard.alias("shard"), (within % SHARD).cast("int").alias("place"), F.col(self.key).alias("key"), *map(F.col, self.kept)])
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        rows.write.option("compression", "zstd").option("parquet.block.size", 8 << 20).parquet(f"{self.root}/forward/segment={name}")
        return self._finish(name, schema)

    def merge(self, least: int = MERGE, small: int = SMALL) -> str | None:
        """One segment of all small ones if there are `least` of them: their documents are numbered anew, shard after shard."""
        old = {k: v for k, v in self.segments().items() if v["docs"] < small}
        if len(old) < max(2, least):
            return None
        name = f"s-{uuid.uuid4().hex}"
        schema = self.manifest.read()["schema"]
        forward = self._read("forward", old).drop("segment")
        sizes = forward.groupBy("shard").agg(F.count("*").alias("n"))
        start = sizes.withColumn("start", F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))).select("shard", F.coalesce("start", F.lit(0)).alias("start"))  # of small segments: few rows
        n = F.col("start") + F.col("place")
        moved = forward.join(F.broadcast(start), "shard").withColumn("_n", n).withColumn("shard", F.shiftleft(F.lit(self._number(name)).cast("long"), 41) + F.floor(F.col("_n") / SHARD)).withColumn("place", (F.col("_n") % SHARD).cast("int"))
        moved.select(*forward.columns).write.option("compression", "zstd").option("parquet.block.size", 8 << 20).parquet(f"{self.root}/forward/segment={name}")
        return self._finish(name, schema, tuple(old))

    def vacuum(self) -> list[str]:
        """Delete segments that the latest version doesn't name; only when no writer or reader is at work."""
        live = self.segments()
        gone = sorted({n for table in ("forward", "postings") for n in self.manifest.names(table) if n.removeprefix("segment=") not in live})
        for n in gone:
            for table in ("forward", "postings"):
                self.manifest.delete(n, table)
        return [n.removeprefix("segment=") for n in gone]

    # --- statistics ---

    def docs(self, *columns: str) -> DataFrame:
        """(shard, place, key, size, columns) of every document; terms and texts are not read."""
        return self._read("forward", self.segments()).select("shard", "place", "key", "size", *columns)

    def totals(self) -> tuple[int, int]:
        """Documents, and their terms with repeats, from the manifest."""
        found = self.segments().values()
        return sum(s["docs"] for s in found), sum(s["size"] for s in found)

    def terms(self) -> DataFrame:
        """(term, df) of all terms: a sum over rows, no list is read."""
        return self._rows().groupBy("term").agg(F.sum("n").cast("long").alias("df"))

    def postings(self, terms: list[str] | DataFrame) -> DataFrame:
        """The rows of some terms: folders and row groups of others are not read where the terms are few enough to be listed."""
        rows = self._rows()
        if isinstance(terms, DataFrame):
            return rows.join(terms.select("term").distinct(), "term", "left_semi")
        wanted = self.spark.createDataFrame([(t,) for t in terms], "term string").select("term", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("bucket"))
        if len(terms) <= FILTERED:
            buckets = sorted({r[0] for r in wanted.select("bucket").collect()})
            rows = rows.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))
        return rows.join(F.broadcast(wanted), ["bucket", "term"], "left_semi")

    def frequencies(self, terms: DataFrame) -> tuple[DataFrame, list[str] | DataFrame]:
        """(term, df) of some terms that occur, and the terms as `postings` takes them: a list of SENT at most, else a table."""
        listed = [r[0] for r in terms.select("term").distinct().limit(SENT + 1).collect()]
        if len(listed) > SENT:
            return self.postings(terms).groupBy("term").agg(F.sum("n").cast("long").alias("df")), terms
        df = [tuple(r) for r in self.postings(listed).groupBy("term").agg(F.sum("n").cast("long").alias("df")).collect()]
        return F.broadcast(self.spark.createDataFrame(df, "term string, df long")), [t for t, _ in df]

    # --- ranking ---

    def top(self, ranking: Ranking, k: int, query: str = "item_id") -> DataFrame:
        """(query, key, score, rank) of each question's k best with a score above 0; equal scores, at 9 decimals, by key."""
        kind = dict(ranking.weights.dtypes)[query]
        parts = max(1, -(-ranking.weights.select(query).distinct().count() // TOGETHER))
        part = F.pmod(F.xxhash64(query), F.lit(parts)).alias("part")
        asked = ranking.weights.groupBy("term", part).agg(F.collect_list(F.struct(F.col(query).alias("q"), "weight")).alias("asked"))
        empty = lambda *columns: [F.lit(None).cast(t).alias(c) for c, t in columns]
        packed, measures = [(c, "binary") for c in ("docs", "tfs", "cells", "ends", "peaks")], [("place", "array<int>"), ("norm", "array<double>"), ("keep", "array<boolean>")]
        heads = ranking.norms.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("key", "place", "norm", "keep"))).alias("x"))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part")
        heads = heads.select("shard", every, *empty(("term", "string"), *packed, ("asked", f"array<struct<q:{kind},weight:double>>")), *[F.col(f"x.{c}").alias(c) for c, _ in measures])
        rows = self.postings(ranking.terms).join(asked, "term").select("shard", "part", "term", *[c for c, _ in packed], "asked", *empty(*measures))
        dealt = heads.unionByName(rows).repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("term").asc_nulls_first())
        found = dealt.mapInArrow(_best_of(ranking.value, k), f"q {kind}, shard long, place int, score double")
        keys = ranking.norms.select("shard", "place", "key")
        named = found.join(keys, ["shard", "place"]).select(F.col("q").alias(query), F.col("key").alias(self.key), "score")
        order = Window.partitionBy(query).orderBy(F.round("score", 9).desc(), self.key)
        return named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def bm25(self, questions: DataFrame, k: int, keep: Column | None = None, query: str = "item_id", text: str = "text") -> DataFrame:
        """(query, key, score, rank) by BM25; `keep`, over the kept columns, filters what is ranked, statistics cover all documents."""
        n, size = self.totals()
        average = size / n if size else 1.0
        terms = questions.select(query, F.explode(self.words(F.col(text))).alias("term")).groupBy(query, "term").agg(F.count("*").alias("q"))
        df, listed = self.frequencies(terms)
        idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        weighed = terms.join(df, "term").select(query, "term", (F.col("q") * idf).alias("weight"))
        flag = F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))
        norms = self.docs(*self.kept).select("shard", "place", "key", (K1 * (1 - B + B * F.col("size") / average)).alias("norm"), flag.alias("keep"))
        return self.top(Ranking(bm25_value, norms, weighed, listed), k, query)


def bm25_value(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return tf * (K1 + 1) / (tf + norm)


def cosine_value(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return (1 + np.log(tf)) / norm


class _Shard:
    """A shard's norms, and the posting rows of the questions' terms."""

    def __init__(self, place: np.ndarray, norm: np.ndarray, keep: np.ndarray, value):
        size = int(place.max()) + 1
        self.value = value
        self.norm, self.keep, self.turn = np.full(size, np.inf), np.zeros(size, bool), np.zeros(size, np.int64)
        self.norm[place], self.keep[place], self.turn[place] = norm, keep, np.arange(len(place))  # places come in the order of their keys
        self.least = np.minimum.reduceat(np.where(self.keep, self.norm, np.inf), np.arange(0, size, CELL))
        self.rows: list[tuple] = []
        self.asked: dict = {}

    def add(self, docs: bytes, tfs: bytes, cells: bytes, ends: bytes, peaks: bytes, asked: list[dict]) -> None:
        ends_ = np.frombuffer(ends, np.uint32).astype(np.int64)
        row = (np.frombuffer(docs, np.uint16), np.frombuffer(tfs, np.uint32), np.frombuffer(cells, np.uint16), ends_, np.frombuffer(peaks, np.uint32))
        for x in asked:
            self.asked.setdefault(x["q"], []).append((x["weight"], len(self.rows)))
        self.rows.append(row)

    def best(self, terms: list[tuple[float, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of one question's k best here, or more where scores are equal."""
        bound = np.zeros(len(self.least))
        for weight, i in terms:
            _, _, cells, _, peaks = self.rows[i]
            bound[cells] += weight * self.value(peaks.astype(float), self.least[cells])
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        score = np.zeros(len(self.norm))
        kth, done, step = 0.0, 0, max(1, -(-4 * k // CELL))
        held = np.zeros(0, np.int64)
        while done < len(order) and bound[order[done]] >= kth - 1e-9:
            visit = np.zeros(len(self.least), bool)
            visit[order[done : done + step]] = True
            touched = []
            for weight, i in terms:
                docs, tfs, cells, ends, _ = self.rows[i]
                blocks = np.flatnonzero(visit[cells])
                if len(blocks):
                    starts = np.where(blocks > 0, ends[blocks - 1], 0)
                    count = ends[blocks] - starts
                    at = np.repeat(starts - (np.cumsum(count) - count), count) + np.arange(count.sum())
                    place = docs[at]
                    score[place] += weight * self.value(tfs[at].astype(float), self.norm[place])
                    touched.append(place)
            new = np.unique(np.concatenate(touched)).astype(np.int64) if touched else held[:0]
            held = np.concatenate([held, new[self.keep[new] & (score[new] > 0)]])
            if len(held) > k:
                kth = np.partition(score[held], len(held) - k)[len(held) - k]
                held = held[score[held] >= kth - 1e-9]
            done, step = done + step, step * 2
        chosen = held[np.lexsort((self.turn[held], -np.round(score[held], 9)))][:k]
        return chosen, score[chosen]


def _best_of(value, k: int):
    """Sorted rows of whole shards, the one with the norms first -> the k best of each question in each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number = None, (None, None)

        def close() -> Iterator[pa.RecordBatch]:
            out = [(q, *shard.best(terms, k)) for q, terms in shard.asked.items()] if shard else []
            if out:
                places = np.concatenate([o[1] for o in out])
                names = [o[0] for o in out for _ in o[1]]
                yield pa.RecordBatch.from_arrays([pa.array(names, kind), pa.array([number[0]] * len(names), pa.int64()), pa.array(places.astype(np.int32)), pa.array(np.concatenate([o[2] for o in out]))], names=["q", "shard", "place", "score"])

        for batch in batches:
            kind = batch.schema.field("asked").type.value_type.field("q").type
            for row in _rows(batch):
                if row[0] != number:
                    yield from close()
                    shard, number = None, row[0]
                if row[1] is None:
                    shard = _Shard(*row[2], value)
                else:
                    shard.add(*row[2])
        yield from close()

    return run


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """((shard, part), term, what that row adds)."""
    shards, terms = zip(batch.column("shard").to_pylist(), batch.column("part").to_pylist(), strict=True), batch.column("term").to_pylist()
    packed = [batch.column(c) for c in ("docs", "tfs", "cells", "ends", "peaks")]
    for i, (shard, term) in enumerate(zip(shards, terms, strict=True)):
        if term is None:
            yield shard, None, tuple(batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("place", "norm", "keep"))
        else:
            yield shard, term, (*(c[i].as_py() for c in packed), batch.column("asked")[i].as_py())


class TfidfIndex(InvertedIndex):
    """Words and word pairs by cosine of sublinear counts; weights follow all segments and are kept for a version. A root holds texts read with one list of stop words."""

    def __init__(self, spark: SparkSession, root: str, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), features: int = FEATURES, stop: Sequence[str] = STOP):
        super().__init__(spark, root, partial(uni_bigrams, stop=tuple(stop)), key, text, keep)
        self.features, self.stop = features, tuple(stop)

    def _forward(self, docs: DataFrame, columns: list[Column]) -> DataFrame:
        """The columns, with each document's words in order; pairs are made of them where they count."""
        words = F.coalesce(gram_words(F.col(self.text), self.stop), F.array().cast("array<string>"))
        rows = docs.select(*columns, words.alias("terms"))
        n = F.size("terms")
        return rows.select(*rows.columns[:-1], (n + F.greatest(n - 1, F.lit(0))).cast("long").alias("size"), F.array_join("terms", " ").alias("terms"))

    def _postings(self, name: str) -> None:
        """None by segment: what a term weighs, and which terms count, hangs on all documents."""

    def _derived(self) -> str:
        """The folder of this version's features, norms and postings: written once, from the forward tables."""
        version = self.manifest.version()
        at = f"{self.root}/derived/v{version}-{self.features}"
        if not self.manifest.fs().exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{at}/postings/_SUCCESS")):
            forward = self._read("forward", self.segments()).select("shard", "place", "terms")
            self._choose(forward, at)
            for k in range(slices := -(-self.features // SENT)):  # so many features are sent to all tasks at once
                known = self.spark.read.schema("term string, idf double").parquet(f"{at}/features").where(F.pmod(F.xxhash64("term"), F.lit(slices)) == k).collect()
                parts = forward.mapInArrow(_known([r[0] for r in known], [r[1] for r in known]), f"{_PARTS}, places array<int>, squares array<double>")
                parts.write.mode("append" if k else "overwrite").parquet(f"{at}/parts")
            parts = self.spark.read.schema(f"{_PARTS}, places array<int>, squares array<double>").parquet(f"{at}/parts")
            squares = parts.where("term is null").select("shard", F.explode(F.arrays_zip("places", "squares")).alias("x")).groupBy("shard", F.col("x.places").alias("place")).agg(F.sum("x.squares").alias("squares"))
            squares.select("shard", "place", F.sqrt("squares").alias("norm")).write.mode("overwrite").parquet(f"{at}/norms")
            self._write(parts.where("term is not null").drop("places", "squares"), f"{at}/postings")
            for made in ("parts", "slots"):
                self.manifest.delete(made, at.removeprefix(f"{self.root}/"))
        return at

    def _choose(self, forward: DataFrame, at: str) -> None:
        """The features: words and pairs that occur most. One of those occurs at least as often as the last of them does, and so does its slot; others needn't be
        counted. How often that is, is guessed from the slots' counts, and true if so many features are found that occur as often."""
        slots, n = SLOTS, self.totals()[0]
        forward.select("terms").mapInArrow(_tally(slots), "chunk int, counts binary").groupBy("chunk").applyInArrow(_added, "chunk int, counts binary").write.mode("overwrite").parquet(f"{at}/slots")
        counts = self.spark.read.schema("chunk int, counts binary").parquet(f"{at}/slots")
        classes = sorted(map(tuple, counts.mapInArrow(_classes, "edge long, n long").groupBy("edge").agg(F.sum("n")).collect()), reverse=True)
        idf = F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1
        for wide in (*WIDER, None):
            met = np.cumsum([x[1] for x in classes])
            least = next((e for (e, _), m in zip(classes, met, strict=True) if m >= wide * self.features), 1) if wide else 1
            bits = bytearray(-(-slots // 8))
            for chunk, some in counts.mapInArrow(_reached(least), "chunk int, bits binary").collect():
                bits[chunk * CHUNK // 8 : chunk * CHUNK // 8 + len(some)] = some
            found = forward.select("terms").mapInArrow(_frequent(bytes(bits), slots), "term string, df long, times long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("times").alias("times"))
            found.orderBy(F.desc("times"), "term").limit(self.features).select("term", idf.alias("idf"), "times").write.mode("overwrite").parquet(f"{at}/features")
            have, rarest = self.spark.read.schema("term string, times long").parquet(f"{at}/features").agg(F.count("*"), F.min("times")).first()
            if least <= 1 or (have == self.features and rarest >= least):
                return

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(f"{_POSTINGS}, bucket int").parquet(f"{self._derived()}/postings")

    def weighed(self) -> tuple[DataFrame, DataFrame]:
        """(term, idf) of the features and (shard, place, norm) of documents with any."""
        at = self._derived()
        return self.spark.read.schema("term string, idf double").parquet(f"{at}/features"), self.spark.read.schema("shard long, place int, norm double").parquet(f"{at}/norms")

    def cosine(self, questions: DataFrame, k: int, keep: Column | None = None, query: str = "item_id", text: str = "text") -> DataFrame:
        """(query, key, score, rank): questions with fewer than k documents above 0 are filled up with score 0, by key."""
        features, norms = self.weighed()
        w = (1 + F.log("tf")) * F.col("idf")
        asked = questions.select(query, F.explode(self.words(F.col(text))).alias("term")).groupBy(query, "term").agg(F.count("*").alias("tf")).join(features, "term").withColumn("w", w)
        listed = [r[0] for r in asked.select("term").distinct().limit(SENT + 1).collect()]
        lengths = asked.groupBy(query).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
        weighed = asked.join(lengths, query).select(query, "term", (F.col("w") * F.col("idf") / F.col("length")).alias("weight"))
        flag = F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))
        docs = self.docs(*self.kept).withColumn("keep", flag)
        ranking = Ranking(cosine_value, docs.join(norms, ["shard", "place"]).select("shard", "place", "key", "norm", "keep"), weighed, listed if len(listed) <= SENT else asked)
        best = written(self.top(ranking, k, query), "best")  # read twice below
        return filled(best, questions, docs.where("keep").select(F.col("key").alias(self.key)), k, self.key, query)


def filled(best: DataFrame, questions: DataFrame, keys: DataFrame, k: int, key: str, query: str) -> DataFrame:
    """Questions with fewer than k rows get those of the smallest keys that they lack, with score 0."""
    few = [r[0] for r in keys.orderBy(key).limit(2 * k).collect()]  # at most k keys of a question are taken, so 2 k hold enough others
    have = best.groupBy(query).agg(F.collect_list(key).alias("have"))
    kind = have.schema["have"].dataType
    short = questions.select(query).distinct().join(have, query, "left").withColumn("have", F.coalesce("have", F.array().cast(kind))).where(F.size("have") < k)
    rest = F.slice(F.array_except(F.array(*map(F.lit, few)).cast(kind), "have"), 1, k - F.size("have"))
    more = short.select(query, F.size("have").alias("n"), F.posexplode(rest).alias("place", key))
    return best.unionByName(more.select(query, key, F.lit(0.0).alias("score"), (F.col("n") + F.col("place") + 1).alias("rank")))
