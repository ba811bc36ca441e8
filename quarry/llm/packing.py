"""Best-fit packing by sum of squares (Csirik et al., 2006).

Texts become token ids, each document ends with id 0, and only documents longer than a sequence
are cut. Pieces are placed longest first, each into the open sequence that leaves the sum over residual gaps of
the squared count of open sequences smallest. This is the any-fit form of the rule: a new sequence is opened only where no open one has
room, and doesn't compete with those that have (as published, opening one is a choice like the others; longest first, that takes more sequences). Ids never leave the tokenizing
task; the shuffle carries a few numbers a piece. Pieces are dealt to groups of bounded size by their place in the
written pieces, so equal rows don't meet in one group, and each group is packed by one task; a group leaves a few sequences open, so the loss is a
few sequences in about 30,000 pieces.

A null or empty text is the single id 0. Repeated rows are packed each for itself. Ties between gaps go to
the smallest gap, among pieces of one length to the one that comes first. An empty table gives no rows. Extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut, table, trim

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 2048
GROUP = 32768
#: Words remembered by a worker, in each of two generations.
REMEMBER = 160_000
_BLOCK = 1 << 20
_BLANK = re.compile(rb"[\t-\r ]")
#: ASCII marks between a letter and a blank are a pre-token of their own: set apart, they need no entry for each word.
#: The mark comes first and what stands before it is looked at afterwards, so the search jumps from mark to mark.
_MARKS = re.compile(rb"[!-/:-@[-`{-~](?:(?<=[A-Za-z][!-~])|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf][!-~]))[!-/:-@[-`{-~]*(?=[\t-\r ]|\Z)")


class WordIds:
    """Ids of whole texts, word by word.

    The tokenizer drops white space and no pre-token spans it, so a text's ids are its words' ids. Words of
    plain letters are one pre-token that normalization only lower-cases: these go to the BPE model directly.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        bytewise = ByteLevel(add_prefix_space=False, use_regex=False)
        self.as_bytes = {c: bytewise.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x250)}

    def encode(self, word: bytes) -> bytes:
        if word.isalpha():
            return array("I", [t.id for t in self.model.tokenize(word.lower().decode())]).tobytes()
        text = word.decode()
        if text.isalpha() and max(text) < "\u0250" and "\u0130" not in text:  # the latter lower-cases to a letter and a mark
            return array("I", [t.id for t in self.model.tokenize(text.lower().translate(self.as_bytes))]).tobytes()
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of words that are not in the newer generation; long ones aren't kept."""
        found = {}
        if len(self.new) >= REMEMBER:
            self.old, self.new = self.new, {}
        for word in words:
            ids = self.old.get(word)
            if ids is None:
                ids = self.encode(word)
            found[word] = ids
            if len(word) <= 64:
                self.new[word] = ids
        return found

    def ids(self, text: str | None) -> bytes:
        """The ids of a whole text, without the closing 0, as little-endian 32-bit numbers."""
        data = (text or "").encode()
        if b"<|" not in data:
            if (text or "").isascii():
                data = data.lower()
            data = _MARKS.sub(rb" \g<0>", data)
        at, out = 0, []
        while at < len(data):
            stop = at + _BLOCK
            if stop < len(data):
                blank = _BLANK.search(data, stop)
                stop = blank.start() if blank else len(data)
            words = data[at:stop].split()
            got = list(map(self.new.get, words))
            if None in got:
                more = self.learn({w for w, g in zip(words, got, strict=True) if g is None})
                got = [more[w] if g is None else g for w, g in zip(words, got, strict=True)]
            out.append(b"".join(got))
            at = stop
        return b"".join(out)


_known: dict[str, WordIds] = {}


def word_ids(path: str | None) -> WordIds:
    """The worker's tokenizer; a path of None is the public vocabulary installed there."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    if path not in _known:
        _known[path] = WordIds(path)
    return _known[path]


def _pieces(path: str | None, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = words.ids(text.as_py()) + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        trim()

    return run


def place(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece."""
    count = np.zeros(capacity, np.int64)  # of open sequences by gap; full ones (gap 0) don't count
    open_at: list[list[int]] = [[] for _ in range(capacity)]
    seq, off = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    big = np.iinfo(np.int64).max
    used = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[i])
        gap = 0
        if s < capacity:
            # taking from gap g: count[g] falls by one, count[g - s] rises by one; the squares change by this much
            change = 2 * (count[: capacity - s] - count[s:]) + 2
            change[0] -= 1
            change[count[s:] == 0] = big
            best = int(np.argmin(change))
            if change[best] < big:  # a new sequence only where no open one has room: with the longest first that wastes least
                gap = best + s
        if gap:
            bin_ = open_at[gap].pop()
            count[gap] -= 1
            left = gap - s
            off[i] = capacity - gap
        else:
            bin_ = used
            used += 1
            left = capacity - s
            off[i] = 0
        seq[i] = bin_
        if left:
            open_at[left].append(bin_)
            count[left] += 1
    return seq, off


def _packs(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        seq, off = place(table["length"].to_numpy(), capacity)
        group = int(table["group"][0].as_py())
        out = table.drop_columns(["group"])
        return out.append_column("sequence_id", pa.array(seq + (group << 32))).append_column("offset", pa.array(off))

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer_path: str | None = None, group: int = GROUP) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = cut(texts.mapInArrow(_pieces(tokenizer_path, capacity), kinds), "pieces")
    groups = max(1, -(-pieces.count() // group))
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(_packs(capacity), kinds + ", sequence_id long, offset long")


def op10(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
