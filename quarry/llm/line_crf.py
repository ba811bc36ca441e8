"""Document quality by a linear-chain conditional random field over lines.

Every line (cut at \n) is good or bad. Its features are binned measures of its own bytes and words, and those of the lines
before and behind it: shares of symbols, capitals, digits, bars, marks, words like the one before and repeated five-word windows, word and line lengths, whether the line occurred before
in the document. The chain has a weight for each bin and state and one for each pair of neighbouring states. It is trained on documents whose lines all bear the document's label, by exact
gradients from forward-backward; a document's score is the mean of its lines' marginal probabilities of being good, weighted by their lengths in bytes. A line's state
thus depends on what surrounds it, and a document that is part good lies between.

Training takes at most TRAIN labelled documents of at most TRAIN_LINES lines (those whose ids hash lowest), the whole text of each; everything else covers all rows.
Only the text enters a score. A null or empty text is one empty line. A text without any byte weighs its lines alike. With no labelled
document, or labels of one kind only, the score is the smoothed share of good labels (0.5 without any). A doc_id that is null is not held out and has no label. An id that
is labelled more than once counts as good if its labels' mean is 0.5 or more. Repeated rows are scored one by one, ties do not arise, an empty table gives no rows, extra columns,
whatever their names, are ignored. Long texts are measured in whole, a few megabytes of short ones at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import table, trim
from quarry.llm.hashing import mix, spans, utf8, word_hashes

TRAIN, TRAIN_LINES = 3_000, 1_000
THRESHOLD = 0.3
STEPS, RATE, RIDGE = 80, 0.15, 2.0
SHARES = np.array([0.001, 0.01, 0.03, 0.08, 0.2, 0.4, 0.7])
MEANS = np.array([1.0, 2.0, 3.0, 4.0, 6.0, 9.0, 14.0])
SIZES = np.array([1.0, 3.0, 6.0, 12.0, 25.0, 60.0, 150.0])
BINS = 9  # one more than a measure has, for a neighbour that is not there
NONE = 8
OWN = ("symbols", "shouts", "capitals", "digits", "bars", "stops", "repeated", "echoes", "before", "mean word", "words", "ends")
#: Measures that a line also has of the lines beside it.
BESIDE = ("symbols", "shouts", "capitals", "bars", "repeated", "echoes", "words")
FEATURES = len(OWN) + 2 * len(BESIDE)
_U = np.uint64


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(chars)] = 1
    return out


_KINDS = {
    "symbols": _mask(b"#*$%&<>@^_~`=+\\{}[]/"), "shouts": _mask(b"!?"), "capitals": _mask(bytes(range(65, 91))), "digits": _mask(b"0123456789"), "bars": _mask(b"|"), "stops": _mask(b".,;:"),
    "letters": _mask(bytes(range(65, 91)) + bytes(range(97, 123))), "solid": 1 - _mask(b" \t\n\x0b\x0c\r"),
}


@dataclass
class Lines:
    """Lines of some texts: bins of the features, bytes, and the index of each text's first line."""

    bins: np.ndarray
    weight: np.ndarray
    first: np.ndarray


def measure(raw: np.ndarray, offsets: np.ndarray) -> Lines:
    """Lines and their features; a text has one line more than line feeds."""
    texts = len(offsets) - 1
    feeds = np.flatnonzero(raw == 10)
    owner = np.searchsorted(offsets, feeds, "right") - 1
    count = np.bincount(owner, minlength=texts) + 1 if texts else np.zeros(0, np.int64)
    first = np.concatenate([[0], np.cumsum(count)])
    start = np.empty(first[-1], np.int64)
    start[first[:-1]] = offsets[:-1]
    rest = np.ones(first[-1], bool)
    rest[first[:-1]] = False
    start[rest] = feeds + 1
    end = np.empty_like(start)
    end[first[1:] - 1] = offsets[1:]
    last = np.ones(first[-1], bool)
    last[first[1:] - 1] = False
    end[last] = feeds
    text = np.repeat(np.arange(texts), count)
    size = end - start

    sums = {}
    for kind, mask in _KINDS.items():
        running = np.concatenate([[0], np.cumsum(mask[raw], dtype=np.int32 if len(raw) < 1 << 31 else np.int64)])
        sums[kind] = (running[end] - running[start]).astype(np.float64)
    words, at = word_hashes(raw, np.concatenate([start, offsets[-1:]]) if len(start) else offsets)
    n_words = np.diff(at).astype(np.float64)
    share = lambda kind, of: sums[kind] / np.maximum(of, 1)
    solid = sums["solid"]
    ends = np.zeros(len(start))
    some = size > 0
    ends[some] = np.isin(raw[end[some] - 1], np.frombuffer(b".!?:;", np.uint8))
    own = {
        "symbols": np.digitize(share("symbols", solid), SHARES), "shouts": np.digitize(share("shouts", solid), SHARES), "capitals": np.digitize(share("capitals", sums["letters"]), SHARES),
        "digits": np.digitize(share("digits", solid), SHARES), "bars": np.digitize(share("bars", solid), SHARES), "stops": np.digitize(share("stops", solid), SHARES),
        "repeated": np.digitize(_repeated(words, at, text), SHARES), "echoes": np.digitize(_echoes(words, at, n_words), SHARES), "before": _before(words, at, text, n_words).astype(np.int64),
        "mean word": np.digitize(solid / np.maximum(n_words, 1), MEANS), "words": np.digitize(n_words, SIZES), "ends": ends.astype(np.int64),
    }
    bins = np.full((len(start), FEATURES), NONE, np.uint8)
    for k, name in enumerate(OWN):
        bins[:, k] = own[name]
    same = text[1:] == text[:-1]
    for k, name in enumerate(BESIDE):
        left, right = bins[:, len(OWN) + k], bins[:, len(OWN) + len(BESIDE) + k]
        left[1:][same] = own[name][:-1][same]
        right[:-1][same] = own[name][1:][same]
    return Lines(bins, size.astype(np.float64), first)


def _repeated(words: np.ndarray, at: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Share of a line's five-word windows that the document has twice or more."""
    room = np.maximum(np.diff(at) - 4, 0)
    whole = room.astype(np.float64)
    line = np.repeat(np.arange(len(text)), room)
    if not len(line):
        return np.zeros(len(text))
    begin = np.arange(len(line)) - np.repeat(np.cumsum(room) - room, room) + np.repeat(at[:-1], room)
    with np.errstate(over="ignore"):
        keys = text[line].astype(_U) * _U(0x9E3779B97F4A7C15)
        for k in range(5):
            keys = (keys ^ words[begin + k]) * _U(0xD6E8FEB86659FD93)
            keys ^= keys >> _U(32)
    order = np.argsort(keys)
    ordered = keys[order]
    twice = np.zeros(len(keys), bool)
    equal = ordered[1:] == ordered[:-1]
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    return np.bincount(line[twice], minlength=len(text)) / np.maximum(whole, 1)


def _echoes(words: np.ndarray, at: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Share of a line's words that are the word before."""
    echo = np.zeros(len(words) + 1, np.int64)
    echo[2:] = np.cumsum(words[1:] == words[:-1])
    inner = echo[at[1:]] - echo[np.minimum(at[:-1] + 1, at[1:])]
    return inner / np.maximum(n_words, 1)


def _before(words: np.ndarray, at: np.ndarray, text: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Whether a line with a word has the words of an earlier line of its document."""
    with np.errstate(over="ignore"):
        place = (np.arange(len(words)) - np.repeat(at[:-1], np.diff(at)) + 1).astype(_U)
        mixed = mix(words * (place * _U(2) + _U(1)) + place)
        running = np.concatenate([np.zeros(1, _U), np.cumsum(mixed)]) if len(mixed) else np.zeros(1, _U)
        keys = mix((running[at[1:]] - running[at[:-1]]) ^ (text.astype(_U) * _U(0x9E3779B97F4A7C15)))
    out = np.zeros(len(text), bool)
    some = np.flatnonzero(n_words > 0)
    if len(some):
        order = some[np.argsort(keys[some], kind="stable")]
        out[order[1:][keys[order[1:]] == keys[order[:-1]]]] = True
    return out


class Chain:
    """The field: a weight of each bin for `good` against `bad`, and of each (state, next state)."""

    def __init__(self, weights: np.ndarray | None = None, steps: np.ndarray | None = None, constant: float | None = None):
        self.weights = np.zeros((FEATURES, BINS)) if weights is None else weights
        self.steps = np.zeros((2, 2)) if steps is None else steps
        self.constant = constant

    def emissions(self, bins: np.ndarray) -> np.ndarray:
        out = np.zeros(len(bins))
        for k in range(FEATURES):
            out += self.weights[k][bins[:, k]]
        return np.clip(out, -30, 30)

    def marginals(self, bins: np.ndarray, first: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
        """P(good) of every line; with pairs, the expected number of each (state, next state) and the log of the sum over all labellings.

        Forward and backward sums run over all texts side by side, longest first, so the loop has as many steps as the longest text has lines.
        """
        e = self.emissions(bins)
        m = np.exp(self.steps - self.steps.max())
        order = np.argsort(-np.diff(first), kind="stable")
        start, count = first[:-1][order], np.diff(first)[order]
        longest = int(count[0]) if len(count) else 0
        live = np.searchsorted(-count, -np.arange(longest), "left")  # texts with more than t lines
        odds = np.stack([np.exp(-np.maximum(e, 0)), np.exp(np.minimum(e, 0))], 1)  # of bad and good, the larger one 1
        ahead, back = np.empty_like(odds), np.ones_like(odds)
        log_sum = float(np.maximum(e, 0).sum())
        for t in range(longest):
            at = start[: live[t]] + t
            x = odds[at] if t == 0 else (ahead[at - 1] @ m) * odds[at]
            total = x.sum(1, keepdims=True)
            ahead[at] = x / total
            if pairs:
                log_sum += float(np.log(total).sum()) + (len(at) * float(self.steps.max()) if t else 0.0)
        expected = np.zeros((2, 2))
        for t in range(longest - 2, -1, -1):
            at = start[: live[t + 1]] + t
            x = (odds[at + 1] * back[at + 1]) @ m.T
            back[at] = x / x.sum(1, keepdims=True)
            if pairs:
                both = ahead[at][:, :, None] * m[None] * (odds[at + 1] * back[at + 1])[:, None, :]
                expected += (both / both.sum((1, 2), keepdims=True)).sum(0)
        p = ahead * back
        return p[:, 1] / p.sum(1), expected, log_sum

    def gradient(self, bins: np.ndarray, first: np.ndarray, good: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-likelihood of the lines' labels and its gradient by weights and steps."""
        p, expected, log_sum = self.marginals(bins, first, pairs=True)
        rest = good - p
        by_weight = np.stack([np.bincount(bins[:, k], rest, BINS) for k in range(FEATURES)])
        inner = np.ones(len(good), bool)
        inner[first[:-1]] = False
        y = good.astype(np.int64)
        to = np.flatnonzero(inner)
        seen = np.bincount(2 * y[to - 1] + y[to], minlength=4).reshape(2, 2)
        likely = float((self.emissions(bins) * good).sum() + (seen * self.steps).sum()) - log_sum
        return likely, by_weight, seen - expected

    def score(self, lines: Lines) -> np.ndarray:
        """Per text: mean of the lines' probabilities of being good, weighted by bytes."""
        texts = len(lines.first) - 1
        if self.constant is not None:
            return np.full(texts, self.constant)
        p, _, _ = self.marginals(lines.bins, lines.first)
        text = np.repeat(np.arange(texts), np.diff(lines.first))
        size = np.bincount(text, lines.weight, texts)
        weight = np.where(size[text] > 0, lines.weight, 1.0)
        return np.clip(np.bincount(text, weight * p, texts) / np.maximum(np.bincount(text, weight, texts), 1e-300), 0.0, 1.0)


def fit(bins: np.ndarray, first: np.ndarray, label: np.ndarray) -> Chain:
    """A chain from lines of labelled texts (label: 0 or 1 a text), by adaptive gradient steps on the penalised likelihood."""
    if len(label) == 0 or label.min() == label.max():
        return Chain(constant=float((label.sum() + 1) / (len(label) + 2)))
    good = np.repeat(label, np.diff(first)).astype(np.float64)
    chain = Chain()
    params = [chain.weights, chain.steps]
    mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, STEPS + 1):
        _, *by = chain.gradient(bins, first, good)
        for p, g, m, s in zip(params, by, mean, square, strict=True):
            g = (g - RIDGE * p) / len(good)
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p += RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
    return chain


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Lines]]:
    """Slices of the batches with their lines; the text is the last column."""
    for batch in batches:
        raw, offsets = utf8(batch.column(batch.num_columns - 1))
        for i, j in spans(offsets):
            yield batch.slice(i, j - i), measure(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, lines in _texts(batches):
        n = np.diff(lines.first)
        packed = [lines.bins[a:b].tobytes() if b - a <= TRAIN_LINES else None for a, b in zip(lines.first[:-1].tolist(), lines.first[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(packed, pa.binary())], names=["quality", "lines", "bins"])
    trim()


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(quality, text) of the labelled documents that are learned from: TRAIN at most, none held out."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    known = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.join(F.broadcast(known), "doc_id").select("quality", "text")


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """Features are measured in tasks; the driver gets their bins, TRAIN x TRAIN_LINES x FEATURES bytes at most."""
    rows = training_rows(docs, labels, id_col, text_col).mapInArrow(_features, "quality int, lines long, bins binary").where("bins is not null")
    rows = rows.distinct().orderBy(F.xxhash64("bins"), "bins").limit(TRAIN).collect()  # an id may stand for many rows, equal ones count once
    bins = np.frombuffer(b"".join(bytes(r["bins"]) for r in rows), np.uint8).reshape(-1, FEATURES)
    return fit(bins, np.concatenate([[0], np.cumsum([r["lines"] for r in rows])]).astype(np.int64), np.array([r["quality"] for r in rows], np.int64))


def _judge(chain):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, lines in _texts(batches):
            score = chain.value.score(lines)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])
        trim()

    return run


def classify(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; only the text decides."""
    model = docs.sparkSession.sparkContext.broadcast(chain)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_judge(model), "doc_id long, held_out boolean, score double, predicted int")


def op12(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, learn(docs, table(spark, sf_dir, "labels")))
