"""Personal data: exact base patterns and a semi-Markov conditional random field over whole spans.

The base patterns are matched leftmost and non-overlapping per kind; the forms below find the same matches
as the plain patterns but can't go quadratic on long runs. The field then scores whole candidate
segments (digit counts, grouping, check digits, the words before, what touches the span) around every
digit, at sign or spelled at sign, and bounded dynamic programming picks boundaries and kinds jointly. Segments it
finds beside the base ones (phone numbers without +, spelled at signs) are added; base spans stay. An address in the
spelled form, as in name [at] host.org or name(at)host.org, is added even if the field passes over it.
Its weights are learned here, by exact likelihood gradients on generated lines with a fixed seed.

A null text counts as empty. Spans are code points, end exclusive. Very long texts are decoded in
overlapping windows around these, so memory is bounded. Extra columns are ignored and repeated
rows are judged one by one.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import table

# fixed values: the kinds in the order of the result, and the base patterns
KINDS = ("email", "ip", "card", "phone")
_LOCAL_CHAR = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

Span = tuple[int, int, int]  # kind's place, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHAR:
            start -= 1
        tail = _DOMAIN.match(text, at + 1) if start < at else None
        if tail:
            yield 0, start, tail.end()
            free = tail.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[Span]:
    out = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((1, m.start(), m.end()))
        for m in _CARD.finditer(text):
            d = _digits(m[0])
            if 13 <= len(d) <= 19 and luhn(d):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_digits(m[0])) <= 15:
                    out.append((3, m.start(), m.end()))
    return sorted(out)


# --- the semi-Markov field -------------------------------------------------------------------------

#: A segment has at most so many units (runs of digits or of letters, blanks, single marks) and characters.
MOST_UNITS = 20
MOST_CHARS = 80
WINDOW, OVERLAP, CONTEXT, GAP = 2000, 200, 40, 16
_UNIT = re.compile(r"[0-9]+|[^\W\d_]+|\s+|.", re.S)
_HIT = re.compile(r"[0-9@]+")
_MARKER = re.compile(r"[\[(]\s?[Aa][Tt]\s?[\])]")
_JOINTS = (" ", ".", "-")
_LABELS = len(KINDS) + 1  # label 0 is outside
# fixed values: words before a span that name its kind
_CUES = {
    "phone": 3, "phones": 3, "tel": 3, "telephone": 3, "mobile": 3, "cell": 3, "call": 3, "fax": 3, "telefon": 3, "teléfono": 3, "téléphone": 3,
    "email": 0, "mail": 0, "e": 0, "write": 0, "contact": 0, "ip": 1, "host": 1, "address": 1, "server": 1,
    "card": 2, "visa": 2, "credit": 2, "karte": 2, "tarjeta": 2, "carte": 2,
}
_SPELLED_AT = re.compile(r"[A-Za-z0-9._%+-]+\s?[\[(]\s?[Aa][Tt]\s?[\])]\s?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_GROUPED = re.compile(r"\+?[0-9]{0,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,5})(?:[ .-][0-9]{2,5}){1,4}")


def _shape(text: str) -> str:
    """Digit runs as their lengths, other characters as they are."""
    return re.sub("[0-9]+", lambda m: str(min(9, len(m[0]))), text)


def _segment_features(kind: int, body: str, before: str, cue: int | None, after: str) -> list[str]:
    d = _digits(body)
    sides = [_class(c) for c in (before[-1:], before[:-1], after[:1], after[1:])]
    out = ["bias", f"cue{'' if cue is None else int(cue == kind)}", f"left{sides[0]}", f"left{sides[0]},{sides[1]}", f"right{sides[2]}", f"right{sides[2]},{sides[3]}"]
    if kind > 1:
        out.append(f"n{len(d)}")
    if kind == 0:
        out += [f"whole{_emails_whole(body)}", f"spelled{bool(_SPELLED_AT.fullmatch(body))}"]
    elif kind == 1:
        parts = body.split(".")
        out += [f"parts{len(parts)}", f"small{all(p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts)}"]
    elif kind == 2:
        out += [f"luhn{luhn(d)}", f"marks{_marks(body)}"]
    else:
        groups = [g for g in re.split("[^0-9]+", body) if g]
        out += [f"plus{body[:1] == '+'}", f"paren{'(' in body}", f"marks{_marks(body)}", f"groups{min(5, len(groups))}", f"grouped{bool(_GROUPED.fullmatch(body))}", f"tail{len(groups[-1]) if groups else 0}"]
        out.append(f"date{bool(re.fullmatch(r'(?:19|20)[0-9]{2}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./][0-9]{2,4}', body))}")
        out.append(f"cued{cue == kind},paren{'(' in body},plus{body[:1] == '+'}")
    return [f"{KINDS[kind]}:{x}" for x in out]


def _class(ch: str) -> str:
    if not ch:
        return "edge"
    return "digit" if ch.isdigit() else "letter" if ch.isalpha() else "blank" if ch.isspace() else "@" if ch == "@" else "mark" if ch in "-./:+#$%&=\"'_" else "other"


def _marks(body: str) -> str:
    return "".join(sorted({c for c in body if not c.isalnum()}))[:4]


def _emails_whole(body: str) -> bool:
    return list(_emails(body)) == [(0, 0, len(body))]


def _segments(text: str) -> tuple[list[int], list[tuple[int, int, int, list[str]]]]:
    """Unit borders of a window and its candidate segments (first unit, last + 1, kind, features)."""
    units = [m.span() for m in _UNIT.finditer(text)]
    borders = [a for a, _ in units] + [len(text)]
    what = [text[a] if not text[a].isalpha() else "a" for a, _ in units]
    solid = [c.isdigit() or c == "a" for c in what]
    words = [text[a:b].lower() for a, b in units]
    out = []
    for i, (a, _) in enumerate(units):
        if not (solid[i] or what[i] in "+(") or text[a - 1 : a].isalnum():
            continue
        cue = next((_CUES[w] for w in reversed(words[max(0, i - 5) : i]) if w in _CUES), None)
        digits = dots = ats = 0
        letters = False
        alone = not (text[a - 1 : a] in _JOINTS and text[max(0, a - 2) : a - 1].isdigit())  # not the rest of a longer row of numbers
        for j in range(i, min(len(units), i + MOST_UNITS)):
            b = units[j][1]
            if b - a > MOST_CHARS or "\n" in words[j]:
                break
            if what[j].isdigit():
                digits += b - units[j][0]
            dots += what[j] == "."
            ats += what[j] == "@" or words[j] == "at"
            letters |= what[j] == "a"
            if not solid[j] or text[b : b + 1].isalnum():
                continue
            body = None
            number = alone and not letters and not (text[b : b + 1] in _JOINTS and text[b + 1 : b + 2].isdigit())
            for kind, fits in enumerate((ats == 1 and solid[i], dots == 3 and not letters and what[i].isdigit(), number and 13 <= digits <= 19, number and 7 <= digits <= 15)):
                if fits:
                    body = body or text[a:b]
                    out.append((i, j + 1, kind + 1, _segment_features(kind, body, text[max(0, a - 2) : a], cue, text[b : b + 2])))
    return borders, out


class Field:
    """Weights of segment features and of transitions between labels."""

    def __init__(self):
        self.names: dict[str, int] = {}
        self.w = np.zeros(0)
        self.trans = np.zeros((_LABELS, _LABELS))

    def score(self, features: list[str]) -> float:
        return float(sum(self.w[k] for f in features if (k := self.names.get(f)) is not None))

    def decode(self, text: str) -> list[Span]:
        """The best segmentation of a window; entity spans only."""
        borders, segments = _segments(text)
        if not segments:
            return []
        n = len(borders) - 1
        ending: dict[int, list[tuple[int, int, float]]] = {}
        for i, j, y, features in segments:
            s = self.score(features)
            if s > 0:  # outside scores 0 a unit, so no worse segment can be on the best path (transitions aren't positive)
                ending.setdefault(j, []).append((i, y, s))
        if not ending:
            return []
        best = np.full((n + 1, _LABELS), -np.inf)
        best[0, 0] = 0.0
        back: dict[tuple[int, int], tuple[int, int]] = {}
        for j in range(1, n + 1):
            for i, y, s in [(j - 1, 0, 0.0), *ending.get(j, ())]:
                via = best[i] + self.trans[:, y]
                p = int(via.argmax())
                if via[p] + s > best[j, y]:
                    best[j, y] = via[p] + s
                    back[j, y] = (i, p)
        out, j, y = [], n, int(best[n].argmax())
        while j:
            i, p = back[j, y]
            if y:
                out.append((y - 1, borders[i], borders[j]))
            j, y = i, p
        return out[::-1]

    def fit(self, lines: list[tuple[str, list[Span]]], rounds: int = 40, rate: float = 0.25, shrink: float = 0.0003) -> Field:
        data = []
        for text, gold in lines:
            borders, segments = _segments(text)
            at = {b: k for k, b in enumerate(borders)}
            want = {(at[a], at[b], kind + 1) for kind, a, b in gold}
            rows = []
            for i, j, y, features in segments:
                rows.append((i, j, y, np.array([self.names.setdefault(f, len(self.names)) for f in features])))
            data.append((len(borders) - 1, rows, want))
        size = len(self.names)
        x, slope, square = np.zeros(size + self.trans.size), 0.0, 0.0
        for step in range(1, rounds + 1):
            self.w, self.trans = x[:size], np.minimum(0, x[size:].reshape(self.trans.shape))
            grad, tgrad = np.zeros(size), np.zeros_like(self.trans)
            for n, rows, want in data:
                self._gradient(n, rows, want, grad, tgrad)
            g = np.concatenate([grad, tgrad.ravel()]) / len(data) - shrink * x
            slope, square = 0.8 * slope + 0.2 * g, 0.95 * square + 0.05 * g * g
            x = x + rate * (slope / (1 - 0.8**step)) / (np.sqrt(square / (1 - 0.95**step)) + 1e-4)
        self.w, self.trans = x[:size], np.minimum(0, x[size:].reshape(self.trans.shape))
        return self

    def _gradient(self, n, rows, want, grad, tgrad) -> None:
        """Adds observed minus expected counts: forward and backward sums over all segmentations."""
        by_end: dict[int, list] = {}
        for r in [(j - 1, j, 0, None) for j in range(1, n + 1)] + rows:
            s = 0.0 if r[3] is None else float(self.w[r[3]].sum())
            by_end.setdefault(r[1], []).append((*r, s))
        fwd = np.full((n + 1, _LABELS), -np.inf)
        fwd[0, 0] = 0.0
        into = np.full((n + 1, _LABELS), -np.inf)  # sums over the label before
        for j in range(n + 1):
            for i, _, y, _, s in by_end.get(j, ()):
                fwd[j, y] = np.logaddexp(fwd[j, y], into[i, y] + s)
            into[j] = np.logaddexp.reduce(fwd[j][:, None] + self.trans, axis=0)
        bwd = np.full((n + 1, _LABELS), -np.inf)
        bwd[n] = 0.0
        z = np.logaddexp.reduce(fwd[n])
        for j in range(n, 0, -1):
            for i, _, y, f, s in by_end.get(j, ()):
                out = s + bwd[j, y]
                bwd[i] = np.logaddexp(bwd[i], self.trans[:, y] + out)
                p = np.exp(fwd[i] + self.trans[:, y] + out - z)
                tgrad[:, y] -= p
                if f is not None:
                    np.add.at(grad, f, -p.sum())
        labels, at = [0], 0
        found = {(i, y): (j, f) for j, rs in by_end.items() for i, _, y, f, _ in rs if y and (i, j, y) in want}
        starts = {i: (y, *v) for (i, y), v in found.items()}
        while at < n:
            y, j, f = starts.get(at, (0, at + 1, None))
            tgrad[labels[-1], y] += 1
            if f is not None:
                np.add.at(grad, f, 1.0)
            labels.append(y)
            at = j


def training_lines(seed: int = 7, size: int = 260) -> list[tuple[str, list[Span]]]:
    """Generated lines: entities with their spans, and numbers that are none of these."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(("ta", "re", "on", "mi", "la", "sen", "kor", "vi")) for _ in range(r.randint(1, 3)))
    host = lambda: f"{word()}{r.choice(('', num(1)))}.{word()}.{r.choice(('com', 'org', 'net', 'de'))}"

    def card() -> str:
        d = num(15)
        d += next(c for c in "0123456789" if luhn(d + c))
        s = r.choice(("", "", " ", "-"))
        return s.join(d[i : i + 4] for i in range(0, 16, 4))

    def no_card() -> str:
        d = num(16)
        return no_card() if luhn(d) else d

    make = [
        (0, lambda: f"{word()}.{num(2)}@{host()}"), (0, lambda: f"{word()}_{word()}@{host()}"), (0, lambda: f"{word()}.{word()} [at] {host()}"), (0, lambda: f"{word()}(at){host()}"),
        (1, lambda: ".".join(str(r.randint(0, 255)) for _ in range(4))), (2, card), (2, card),
        (3, lambda: f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}"), (3, lambda: f"({num(3)}) {num(3)}-{num(4)}"), (3, lambda: f"+{num(2)} {num(3)} {num(3)} {num(3)}"), (3, lambda: f"+{num(11)}"),
    ]
    cued = [(3, lambda: f"{num(3)}-{num(3)}-{num(4)}"), (3, lambda: f"{num(4)} {num(7)}"), (3, lambda: num(10))]
    other = [
        no_card, no_card, no_card, lambda: f"{r.randint(1900, 2099)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", lambda: f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1900, 2099)}",
        lambda: f"{r.randint(0, 9)}.{r.randint(0, 9)}", lambda: f"version {r.randint(0, 9)}.{r.randint(0, 9)}.{r.randint(0, 20)}.", lambda: f"${num(2)},{num(3)}.{num(2)}", lambda: num(r.choice((2, 4, 7, 8, 9, 10, 11, 12, 13, 20))),
        lambda: f"{num(3)} {num(3)} {num(3)}", lambda: f"{num(4)}-{num(4)}", lambda: f"{num(3)}-{num(3)}-{num(4)}", lambda: f"@{word()}", lambda: f"{r.randint(300, 999)}.{r.randint(256, 999)}.{num(3)}.{num(1)}", lambda: f"{num(2)}:{num(2)}:{num(2)}",
        lambda: 'token = "' + "".join(r.choice("0123456789abcdef") for _ in range(40)) + '"', lambda: f"{num(3)},{num(3)},{num(3)}", lambda: f"ISBN {num(3)}-{num(1)}-{num(5)}-{num(3)}-{num(1)}", lambda: f"{num(1)}.{num(6)}e-{num(2)}", lambda: f"{num(5)}.{num(5)}",
        lambda: f"meet at {num(2)} {word()}.{word()}",
    ]
    cues = {kind: [w for w, k in _CUES.items() if k == kind and len(w) > 1] for kind in range(4)}
    out = []
    for i in range(size):
        left = " ".join(word() for _ in range(r.randint(0, 3)))
        right = r.choice(("", ".", ",", "!!", "###", "$$$", " ")) + r.choice(("", " " + word()))
        gold = None
        if i % 2:
            body = r.choice(other)()
        elif i % 8 == 2:
            gold, f = r.choice(cued)
            left += (" " if left else "") + r.choice(cues[gold]) + r.choice(("", ":"))
            body = f()
        else:
            gold, f = r.choice(make)
            body = f()
        left += " " if left else ""
        out.append((left + body + right, [] if gold is None else [(gold, len(left), len(left) + len(body))]))
    return out


_fitted: list[Field] = []


def field() -> Field:
    """The field, fitted once a process; always the same."""
    if not _fitted:
        _fitted.append(Field().fit(training_lines()))
    return _fitted[0]


def _windows(text: str) -> Iterator[tuple[int, int, int]]:
    """Windows (start, end, spans must begin before) around digits and at signs."""
    begin = last = None
    for m in _HIT.finditer(text):
        if begin is not None and (m.start() - last > GAP or m.end() - begin > WINDOW):
            cut_long = m.start() - last <= GAP
            yield max(0, begin - CONTEXT), min(len(text), last + CONTEXT + (OVERLAP if cut_long else 0)), last + 1 if not cut_long else last
            begin = None
        if begin is None:
            begin = m.start()
        last = m.end()
    if begin is not None:
        yield max(0, begin - CONTEXT), min(len(text), last + CONTEXT), last + 1


def _spelled(text: str, model: Field) -> Iterator[Span]:
    """Addresses around spelled at signs, each decoded with room for the longest segment on both sides.

    Where the field leaves such a sign out (no words around it, or a segment beyond its bounds), the address is what
    matches the spelled form as a whole.
    """
    free = 0
    for m in _MARKER.finditer(text):
        a = max(0, m.start() - MOST_CHARS - CONTEXT)
        decoded = model.decode(text[a : m.end() + MOST_CHARS + CONTEXT])
        found = [(a + s, a + e) for kind, s, e in decoded if kind == 0 and a + s < m.start() and m.end() < a + e]
        if not found:
            end = m.start() - text[m.start() - 1 : m.start()].isspace()
            start = end
            while start > free and text[start - 1] in _LOCAL_CHAR:
                start -= 1
            while start < end and not text[start].isalnum():
                start += 1
            tail = _DOMAIN.match(text, m.end() + text[m.end() : m.end() + 1].isspace())
            found = [(start, tail.end())] if start < end and tail else []
        for s, e in found:
            yield 0, s, e
        free = m.end()


def all_spans(text: str, model: Field) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by kind, then start."""
    base = base_spans(text)
    extra: list[Span] = []
    starts, ends = [], []  # what is taken, as ranges that don't touch
    for a, b in sorted((a, b) for _, a, b in base):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)

    def add(kind: int, a: int, b: int) -> None:
        at = bisect_left(starts, b)  # the ranges before this one begin before the span ends
        if not at or ends[at - 1] <= a:
            starts.insert(at, a)
            ends.insert(at, b)
            extra.append((kind, a, b))

    for kind, s, e in _spelled(text, model):
        add(kind, s, e)
    for a, b, before in _windows(text):
        for kind, s, e in model.decode(text[a:b]):
            if a + s < before:
                add(kind, a + s, a + e)
    return base, sorted([*base, *extra])


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def _scan(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = model.value
        for batch in batches:
            rows = []
            for text in batch.column(1):
                base, every = all_spans(text.as_py() or "", crf)
                counts = [sum(k == kind for k, _, _ in base) for kind in range(4)]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return run


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base counts, base_sha256 and all spans of every row."""
    model = docs.sparkSession.sparkContext.broadcast(field())
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scan(model), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask(text: str | None, spans: list[Span]) -> str | None:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the merged range goes."""
    if not text or not spans:
        return text
    out, at = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b in spans):
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind]}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _masked(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = model.value
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [mask(t, all_spans(t or "", crf)[1]) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at).name, pa.array(texts, batch.schema.field(at).type))

    return run


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns, with the personal data in text replaced."""
    return docs.mapInArrow(_masked(docs.sparkSession.sparkContext.broadcast(field())), docs.schema)


def op5(spark, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
