"""Secret scans: exact base patterns and assignment-aware lexing.

The lexer walks over every `=`, `:`, `:=` or `=>` of a text, reads the names before it (bare, quoted, dotted, with a
type before or behind, several, or a header or key) and the values after it: quoted, also with a prefix, in triple quotes, in parentheses, on the next line, or joined by +, . or standing side by side;
bare, up to a blank in a line of settings and up to a closing mark elsewhere; a block of deeper lines; the strings that a call gets, also a default beside a name; what follows `or`, `||`, `??`. So it
turns source and configuration into name-literal pairs. A value that is itself a name stands for what that name holds
there: the value of its last assignment before, or, as in configuration read as a whole, of its first one after where none
is before. So constants are propagated through chains of any length, and a later assignment doesn't touch earlier uses;
scopes of functions aren't told apart. A literal answers to its own name and to all that it is passed on to. A bare value
that could be a name is one if the text assigns to it or calls it, or if it has no
digit; else it is a literal, as in .env files, YAML and properties. Literals are scored by the most sensitive of their names and by their make-up
(length, kinds of characters, entropy, placeholders); those that reach SCORE are added as spans
beside the base ones, in the order of their starts, unless they touch one. Base spans stay. Names, blanks and values have no greatest length: quoted
values are read to their closing quote, escapes included, and bare ones to the end of their run.

A null or empty text has no span. Spans are code points, end exclusive; of spans of equal start the kinds are in the listed
order. Time is linear in the text but for sorting spans: names and blanks lie between two operators, quoted values between two quotes, and a run of bare
characters is read once. Repeated rows are judged one by one, an empty table gives none; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import table

# fixed values: kinds in the order of the result, base patterns
KINDS = ("assign", "access", "hex", "literal")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # the run is taken whole, so a shorter run has no longer part
_HEX = re.compile(r"[0-9a-f]{16,}")
# fixed values: parts of names and how sensitive they are
_NAMES = {
    "password": 4, "passwd": 4, "pwd": 4, "passphrase": 4, "pass": 2, "secret": 4, "token": 3, "apikey": 4, "credential": 4, "credentials": 4, "privatekey": 4, "accesskey": 4,
    "auth": 2, "authorization": 3, "bearer": 3, "signing": 2, "key": 2, "private": 2, "api": 1, "access": 1, "salt": 1, "cookie": 1, "session": 1,
    "public": -3, "name": -2, "path": -3, "file": -3, "url": -2, "length": -3, "count": -3, "size": -3, "id": -1, "type": -2, "policy": -3, "hint": -3, "primary": -3, "foreign": -3,
}
_PLACEHOLDER = re.compile(r"(?i)(?:(?:x+|\*+|\.+|null|none|true|false|changeme|change[-_ ]me|placeholder|<.*>|\$\{.*\}|%.*%|todo|test|dummy|redacted)$|example|your[-_ ])")
SCORE = 6
_OPERATOR = re.compile(r":=|=>|[:=](?![:=])")
_NAME_CHAR = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_$.-")
_FIRST = re.compile(r"[A-Za-z_$]")
_PREFIX = r"(?:[bBrRuUfF]{1,2}|[lL@$])?+"
_STRING = re.compile(
    _PREFIX
    + r"""(?:\"{3}((?:[^"\\]|\\.|"(?!""))*+)"{3}|'{3}((?:[^'\\]|\\.|'(?!''))*+)'{3}|"((?:[^"\n\\]|\\[^\n])++)"|'((?:[^'\n\\]|\\[^\n])++|[^'\n]++)'|`((?:[^`\n\\]|\\[^\n])++|[^`\n]++)`)""",
    re.S,
)
_BLANKS, _LINES = re.compile(r"[ \t]*+"), re.compile(r"\s*+")
_NEXT_LINE = re.compile(r"[ \t]*+\\?\r?\n[ \t]*+(?=[\"'`])")
_JOIN, _JOIN_LINES = re.compile(r"[ \t]*+(?:[+.][ \t]*+)?+(?=[bBrRuUfF]{0,2}[\"'])"), re.compile(r"\s*+(?:[+.]\s*+)?+(?=[bBrRuUfF]{0,2}[\"'])")
#: A bare value: in a line of settings all up to a blank, elsewhere up to what closes or parts values.
_LINE_VALUE, _BARE = re.compile(r"[^\s\"'`({\[][^\s]*+"), re.compile(r"[^\s\"'`,;(){}\[\]<>|]++")
_CALL = re.compile(r"[A-Za-z_$][\w.$]*+[(\[]", re.A)
_ARGUMENTS = re.compile(r"\(\s*+(?=[\"'])")
_ELSE = re.compile(r"[ \t]*+[)\]]?+[ \t]*+(?:or\b|\|\||\?\?|\?:)[ \t]*+")
_BLOCK = re.compile(r"[ \t]*+[|>][+-]?[0-9]?[+-]?[ \t]*+(?:#[^\n]*+)?\r?\n")
_OPENS = re.compile(r":[ \t]*[|>][+-]?[0-9]?\Z")
_INDENT = re.compile(r"[ \t]*+(?=[^\s])")
_TYPES = frozenset(("string", "byte", "rune"))
_IDENTIFIER = re.compile(r"[A-Za-z_$][A-Za-z0-9_.$]*+\Z")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")

Span = tuple[int, int, int]  # start, kind's place, end


def base_spans(text: str) -> list[Span]:
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def name_score(name: str) -> int:
    """How sensitive a name is: its parts' scores, neighbouring parts also read as one word."""
    parts = [p.lower() for p in _PART.findall(name)]
    both = [a + b for a, b in zip(parts, parts[1:], strict=False)]
    return sum(_NAMES.get(p, 0) for p in parts) + max((_NAMES.get(b, 0) for b in both), default=0)


def literal_score(value: str) -> int:
    return -9 if _PLACEHOLDER.match(value) else make_up(Counter(value))


def make_up(chars: Counter[str]) -> int:
    """The part of a literal's score that hangs on how often it has each character."""
    n = chars.total()
    if n < 6:
        return -9
    entropy = -sum(c / n * math.log2(c / n) for c in chars.values())
    kinds = sum(any(map(f, chars)) for f in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in chars)
    return (n >= 8) + (n >= 16) + (entropy >= 2.8) + (entropy >= 3.6) + (kinds >= 2) + (kinds >= 3) - 3 * any(c.isspace() for c in chars) - 2 * (kinds < 2)


def _name_before(text: str, at: int) -> tuple[int, str]:
    """(start, name) of the name that ends before a place, blanks and closing marks between; no name is empty."""
    while at and text[at - 1] in " \t":
        at -= 1
    for _ in range(3):
        if at and text[at - 1] in "\"'])":
            at -= 1
    start = at
    while start and text[start - 1] in _NAME_CHAR:
        start -= 1
    first = _FIRST.search(text, start, at)
    return (first.start(), text[first.start() : at]) if first else (at, "")


def _string(text: str, at: int, lines: bool = False) -> tuple[str, int, int, int] | None:
    """(value, start, end, place behind) of a quoted value with what is joined to it; parts may stand on lines of their own within parentheses."""
    m = _STRING.match(text, at)
    if not m:
        return None
    start, end = m.span(m.lastindex)
    body = [m[m.lastindex]]
    while (more := (_JOIN_LINES if lines else _JOIN).match(text, m.end())) and (part := _STRING.match(text, more.end())):
        m = part
        body.append(m[m.lastindex])
        end = m.end(m.lastindex)
    return "".join("".join(body).splitlines()), start, end, m.end()


def _indent(text: str, at: int) -> int:
    """Blanks before a line, -1 for an empty one."""
    m = _INDENT.match(text, at)
    return m.end() - at if m else -1


def _nested(text: str, at: int, depth: int) -> tuple[int, int] | None:
    """(start, end) of the lines from a place that are deeper than a line of `depth` blanks; empty lines belong to them, but for the last ones."""
    start = end = None
    while at < len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        line = text[at:stop].strip()
        deep = _indent(text, at) if line else None
        if deep is not None:
            if deep <= depth or (":" in line and _OPENS.search(line)):  # a block in the block: its lines are its own
                break
            start, end = at + deep if start is None else start, stop
        at = stop + 1
    return None if start is None else (start, end)


def _in_line(text: str, at: int) -> int | None:
    """Blanks before a name that opens its line (behind `export` or a dash), else none."""
    begin = at
    while begin and text[begin - 1] in " \t-":
        begin -= 1
    if text.endswith("export", 0, begin):
        begin -= 6
        while begin and text[begin - 1] in " \t":
            begin -= 1
    return at - begin if not begin or text[begin - 1] == "\n" else None


def _targets(text: str, at: int, name: str, op: str) -> tuple[list[str], str, int]:
    """(names that are assigned to, a type, start) for the name before an operator."""
    kind, names = "", [name]
    back = at
    while back and text[back - 1] in " \t":
        back -= 1
    if op == "=" and name.replace("_", "").isalpha() and text[back - 1 : back] == ":":  # name: type = value
        before, first = _name_before(text, back - 1)
        if first:
            return [first], name, before
    if op == "=" and name in _TYPES:  # name type = value
        before, first = _name_before(text, back - 2 if text.endswith("[]", 0, back) else back)
        if first:
            return [first], name, before
    while op != ":" and text[back - 1 : back] == ",":  # one, other = ...
        before, first = _name_before(text, back - 1)
        if not first:
            break
        names.append(first)
        at = back = before
        while back and text[back - 1] in " \t":
            back -= 1
    return names[::-1], kind, at


Pair = tuple[str, str, str | None, int, int]


def pairs_of(text: str) -> list[Pair]:
    """(name, type, value, start, end) of every assignment, in the order of the text; a bare value is None and stands from start to end.

    A run of bare characters may hold many assignments, whose values all end where it does: its end is sought once. Likewise nested lines are
    looked at only by the name that opens them.
    """
    out: list[Pair] = []
    stop = 0  # end of the last bare run
    for op in _OPERATOR.finditer(text):
        at, name = _name_before(text, op.start())
        if not name:
            continue
        names, kind, at = _targets(text, at, name, op[0])
        here = _BLANKS.match(text, op.end()).end()
        if op.end() < stop and text[here : here + 1] not in "\"'`":
            out.append((names[-1], kind, None, op.end(), stop))
            continue
        depth = _in_line(text, at)
        if op[0] == ":" and depth is not None and text[at - 1 : at] not in ('"', "'") and (found := _below(text, op.end(), depth)):
            out.append((names[-1], kind, *found))
            continue
        for k in range(len(names)):
            value, behind = _value(text, here, depth is not None and len(names) == 1)
            for v in value:
                out.append((names[k], kind, *v))
                if v[0] is None:
                    stop = max(stop, v[2])
            comma = _BLANKS.match(text, behind).end()
            if text[comma : comma + 1] != ",":
                break
            here = _BLANKS.match(text, comma + 1).end()
    for call in _ARGUMENTS.finditer(text):  # a name and its default as arguments
        first = _string(text, call.end())
        if first and _IDENTIFIER.match(first[0]):
            comma = _LINES.match(text, first[3]).end()
            if text[comma : comma + 1] == "," and (other := _string(text, _LINES.match(text, comma + 1).end())):
                out.append((first[0], "", *other[:3]))
    out.sort(key=lambda pair: pair[3])
    return out


def _below(text: str, at: int, depth: int) -> tuple[str, int, int] | None:
    """A value in the lines below its name: a block scalar, or a value that begins on the next line."""
    block = _BLOCK.match(text, at)
    line = _BLANKS.match(text, at).end()
    if not block and text[line : line + 1] != "\n":
        return None
    if block:
        found = _nested(text, block.end(), depth)
        return ("".join(x.strip() for x in text[found[0] : found[1]].splitlines()), *found) if found else None
    if _indent(text, line + 1) <= depth:
        return None
    begin = line + 1 + _indent(text, line + 1)
    if quoted := _string(text, begin):
        return quoted[:3]
    end = text.find("\n", begin)
    value = text[begin : len(text) if end < 0 else end].rstrip()
    return (value, begin, begin + len(value)) if value and not re.search(r"[\s:=({\[]", value) else None


def _value(text: str, at: int, whole: bool) -> tuple[list[tuple[str | None, int, int]], int]:
    """The literals that a value may be, and the place behind: quoted (in parentheses, too), bare, a call's arguments, what stands in for a missing one."""
    if next_line := _NEXT_LINE.match(text, at):
        at = next_line.end()
    found: list[tuple[str | None, int, int]] = []
    paren = _LINES.match(text, at + 1).end() if text[at : at + 1] == "(" else None
    if quoted := _string(text, at if paren is None else paren, paren is not None):
        found.append(quoted[:3])
        behind = quoted[3]
    else:
        call = _CALL.match(text, at)
        bare = (_LINE_VALUE if whole and not call else _BARE).match(text, at)
        if not bare:
            return [], at
        behind = bare.end()
        while whole and behind > at + 1 and text[behind - 1] in ",;":
            behind -= 1
        found.append((None, at, behind))
        if call and text[behind : behind + 1] in ("(", "["):
            behind = _LINES.match(text, behind + 1).end()
            while argument := _string(text, behind):
                behind = argument[3]
                if not _IDENTIFIER.match(argument[0]) or any(c.isdigit() for c in argument[0]):
                    found.append(argument[:3])
                comma = _LINES.match(text, behind).end()
                if text[comma : comma + 1] != ",":
                    break
                behind = _LINES.match(text, comma + 1).end()
    while other := _ELSE.match(text, behind):
        quoted = _string(text, other.end())
        if not quoted:
            name = _BARE.match(text, other.end())
            if not name:
                break
            behind = name.end()
            continue
        found.append(quoted[:3])
        behind = quoted[3]
    return found, behind


def sensitivity(text: str, found: list[Pair]) -> list[int | None]:
    """For each assignment of a literal the highest score of all names it reaches; null for those of names."""
    first: dict[str, int] = {}
    for i, (name, *_) in enumerate(found):
        first.setdefault(name, i)
    last: dict[str, int] = {}
    scores: dict[str, int] = {}
    source: list[int | None] = []  # the assignment that a name's value comes from; itself for a literal
    for i, (name, _, value, start, end) in enumerate(found):
        origin: int | None = i
        if value is None and _IDENTIFIER.match(text, start, end):
            word = text[start:end]
            if word in first or text[end : end + 1] == "(" or not any(c.isdigit() for c in word):
                origin = last.get(word, first.get(word))
                origin = None if origin == i else origin
        source.append(origin)
        last[name] = i
    out: list[int | None] = [0 if source[i] == i else None for i in range(len(found))]
    for i, (name, kind, *_) in enumerate(found):
        path, at, seen = [], i, set()
        while at is not None and source[at] != at and at not in seen:
            seen.add(at)
            path.append(at)
            at = source[at]
        if at is not None and source[at] != at:
            at = None  # names that only stand for each other
        for step in path:
            source[step] = at
        if at is not None:
            for word in (name, kind):
                if word not in scores:
                    scores[word] = name_score(word)
                out[at] = max(out[at], scores[word])
    return out


def lexed(text: str) -> list[tuple[int, int]]:
    """Spans of the literals that look like secrets."""
    if not any(c in text for c in "=:("):
        return []
    found = pairs_of(text)
    out = []
    chars, low, high = Counter(), 0, 0  # of a bare run, from the last value looked at
    for (_, _, value, start, end), best in zip(reversed(found), reversed(sensitivity(text, found)), strict=True):
        if best is None or best < 2:
            continue
        if value is not None:
            score = literal_score(value)
        else:
            if end != high:
                chars, low, high = Counter(), end, end
            chars.update(text[start:low])
            low = start
            score = -9 if _PLACEHOLDER.match(text, start, end) else make_up(chars)
        if best + score >= SCORE:
            out.append((start, end))
    return out[::-1]


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    base = base_spans(text)
    starts, ends = [], []  # base spans, merged
    for a, _, b in base:
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    extra, free = [], 0
    for a, b in lexed(text):
        near = bisect_right(starts, b - 1) - 1  # the last base range that begins within or before
        if a >= free and (near < 0 or ends[near] <= a):
            extra.append((a, 3, b))
            free = b
    return base, sorted([*base, *extra])


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1):
            base, every = all_spans(text.as_py() or "")
            counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
            rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        kinds = [pa.int64()] * 3 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base counts, base_sha256 and all spans of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op3(spark, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
