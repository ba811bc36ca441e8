"""Column functions on texts; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: word lists
POSITIVE = (
    "achieve achieved advantage benefit beneficial best exceed exceeded gain gains growth improve improved improvement innovation "
    "opportunity opportunities outperform profitable record strength strengthen strong succeed success successful"
).split()
NEGATIVE = (
    "adverse adversely against challenge challenges concern concerns decline declined decrease decreased deficit difficult downturn "
    "failure impair impairment litigation loss losses negative risk risks uncertain uncertainty volatile volatility weak weakness writedown"
).split()
AUDIT_STOP = "the and for that this with are was were has have its their from which also may could would".split()
META_PHRASES = ("context does not", "extractive mode", "no relevant passages")
# fixed values: patterns
TOKEN = r"[a-z0-9][a-z0-9\-]+"
SENTENCE_BREAK = r"(?<=[.!?])\s+(?=[A-Z0-9\"'(“‘])"
MONEY = r"(?:\$|US\$|USD\s?)?\s?\d[\d,.]*\s?(?:billion|million|bn|m\b)"
NUMBER = r"(?i)\$?\d[\d,.]*\s*(?:billion|million|bn|m\b|percent|%|basis points)?"
REVENUE_GUIDANCE = rf"(?i)(?:expect|anticipate|project|guidance|outlook)[^.]{{0,160}}?(?:revenue|net sales|total sales)[^.]{{0,160}}?({MONEY}(?:\s?(?:to|and|-|–)\s?{MONEY})?)"
CAPEX_GUIDANCE = rf"(?i)(?:capital expenditures?|capex)[^.]{{0,200}}?({MONEY}(?:\s?(?:to|and|-|–)\s?{MONEY})?)"
CITE_GROUP = r"\[\d+(?:\s*,\s*\d+)*\]"


def strip(c: Column) -> Column:
    """Without white space at both ends, newlines included."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def is_html(raw: Column) -> Column:
    return F.contains(F.substring(raw, 1, 5000), F.lit("</")) | F.contains(F.lower(F.substring(raw, 1, 2000)), F.lit("<html"))


def _longest_first(names) -> str:
    return "|".join(sorted(names, key=lambda n: (-len(n), n)))


#: Entities by name come from Python's table of those in HTML 5; some of them also stand without a semicolon, before whatever follows.
_ENDED = {n[:-1]: c for n, c in html5.items() if n.endswith(";")}
_OPEN = {n: c for n, c in html5.items() if not n.endswith(";")}
_BARE = f"^&({_longest_first(_OPEN)})"
ENTITY = f"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]{{0,31}};|(?:{_longest_first(_OPEN)}))"
#: Numbers that stand for another character, as browsers read them: Windows' ones from 128 to 159, 0, and the carriage return.
_WINDOWS = {n: bytes([n]).decode("cp1252", "replace").replace("\ufffd", chr(n)) for n in range(128, 160)} | {0: "\ufffd", 13: "\r"}


#: Names that are most of those met: compared before the whole table is searched.
_COMMON = ("amp", "nbsp", "lt", "gt", "quot", "apos", "copy", "middot", "mdash", "ndash", "rsquo", "lsquo", "rdquo", "ldquo", "hellip", "bull")


def _lookup(names: dict[str, str], key: Column) -> Column:
    """The value of a key in a constant map, or null."""
    pairs = "\x01".join(f"{k}\x02{v}" for k, v in names.items())
    return F.try_element_at(F.str_to_map(F.lit(pairs), F.lit("\x01"), F.lit("\x02")), key)


def _character(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def _entity(e: Column) -> Column:
    """What one entity stands for; itself if nothing."""
    decimal, hexa = F.regexp_extract(e, "^&#0*([0-9]*)", 1), F.regexp_extract(e, "^&#[xX]0*([0-9a-fA-F]*)", 1)
    is_hex = e.rlike("^&#[xX]")
    digits = F.when(is_hex, hexa).otherwise(decimal)
    code = F.when(F.length(digits) > 8, F.lit(1 << 32)).when(digits == "", F.lit(0)).otherwise(F.when(is_hex, F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("long"))
    return F.when(e.startswith("&#"), _by_code(code)).otherwise(_by_name(e))


def _by_code(n: Column) -> Column:
    other = F.lit(None).cast("string")
    for code, char in _WINDOWS.items():
        other = F.when(n == code, char).otherwise(other)
    outside = (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
    control = n.between(1, 8) | (n == 11) | n.between(14, 31) | n.between(127, 159) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    other = F.when((n == 0) | (n == 13) | n.between(128, 159), other)
    return F.coalesce(other, F.when(outside, "\ufffd").when(control, "").otherwise(_character(n)))


def _by_name(e: Column) -> Column:
    common = F.lit(None).cast("string")
    for name in reversed(_COMMON):
        common = F.when(e == f"&{name};", _ENDED[name]).otherwise(common)
    ended = F.when(F.endswith(e, F.lit(";")), _lookup(_ENDED, F.regexp_extract(e, "^&([A-Za-z0-9]+);$", 1)))
    bare = F.regexp_extract(e, _BARE, 1)
    return F.coalesce(common, ended, F.when(bare != "", F.concat(_lookup(_OPEN, bare), F.substring(e, F.length(bare) + 2, F.length(e)))), e)


def unescape(c: Column) -> Column:
    """All named and numeric entities, each once, from left to right; texts without any pass through."""
    found = F.regexp_extract_all(c, F.lit(ENTITY), F.lit(0))
    pieces = F.zip_with(F.split(c, ENTITY, -1), F.transform(found, _entity), lambda piece, char: F.concat(piece, F.coalesce(char, F.lit(""))))
    return F.when(F.contains(c, F.lit("&")), F.array_join(pieces, "")).otherwise(c)


# fixed values: the entities that the cleaning query's SQL knows, in its order
_USUAL = (("nbsp", "\u00a0"), ("middot", "·"), ("copy", "©"), ("quot", '"'), ("#39", "'"), ("lt", "<"), ("gt", ">"), ("amp", "&"))


def unescape_usual(c: Column) -> Column:
    """Eight usual entities with their semicolon, one after the other; all else stays."""
    for name, char in _USUAL:
        c = F.replace(c, F.lit(f"&{name};"), F.lit(char))
    return c


def clean(raw: Column, entities: Callable[[Column], Column] = unescape) -> Column:
    """Plain text of a file: tags gone where it is HTML, entities replaced, blanks collapsed, at most one blank line in a row."""
    plain = F.regexp_replace(raw, r"(?is)<script\b.*?</script>", " ")
    plain = F.regexp_replace(plain, r"(?is)<style\b.*?</style>", " ")
    plain = F.regexp_replace(plain, r"(?i)</?(p|div|tr|table|h\d|li|br)[^>]*>", "\n\n")
    plain = entities(F.regexp_replace(plain, r"<[^>]+>", " "))
    text = F.when(is_html(raw), plain).otherwise(raw)
    text = F.replace(F.replace(text, F.lit(" "), F.lit(" ")), F.lit("\r"), F.lit(""))
    text = F.regexp_replace(F.regexp_replace(text, "[ \t]+", " "), "\n{3,}", "\n\n")
    return strip(text)


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def sentences(c: Column) -> Column:
    return F.split(c, SENTENCE_BREAK)


def paragraphs(c: Column, least: int = 80, by: str = r"\n\s*\n") -> Column:
    return F.filter(F.transform(F.split(c, by), strip), lambda p: F.length(p) > least)


def token_set(c: Column) -> Column:
    """Distinct lower-case words between blanks."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(0.0)


def content_tokens(c: Column) -> Column:
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{3,}"), F.lit(0))), F.array(*map(F.lit, AUDIT_STOP)))


def numbers(c: Column) -> Column:
    """Normalised numbers with their units; a trailing full stop stays, as it does where numbers are compared."""
    found = F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0))
    return F.transform(found, lambda n: F.replace(F.regexp_replace(F.lower(n), r"[\s,$]", ""), F.lit("percent"), F.lit("%")))


def guidance(c: Column, pattern: str = REVENUE_GUIDANCE, most: int = 5) -> Column:
    return F.slice(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), strip)), 1, most)


def lexicon(c: Column, positive=POSITIVE, negative=NEGATIVE, most: int = 200) -> Column:
    """struct(score, n_sentences, backend, positive, negative, neutral) over the first sentences of more than 20 characters.

    score is (p - n) / max(p + n, 1), the others are shares of all words. Without a sentence the score is 0, the backend "none" and shares are null.
    The words are extracted once, bound, and filtered by both lists.
    """
    found = shown_sentences(c, most)
    words = F.regexp_extract_all(F.lower(F.array_join(found, " ")), F.lit("[a-z]+"), F.lit(0))
    def record(s: Column) -> Column:
        p, n, every = s["p"], s["n"], F.greatest(s["all"], F.lit(1))
        none = s["sentences"] == 0
        share = lambda x, name: F.when(~none, x).alias(name)
        return F.struct(((p - n) / F.greatest(p + n, F.lit(1))).alias("score"), s["sentences"].alias("n_sentences"), F.when(none, "none").otherwise("lexicon").alias("backend"),
                        share(p / every, "positive"), share(n / every, "negative"), share(1 - (p + n) / every, "neutral"))

    among = lambda ws, listed: F.size(F.filter(ws, lambda w: w.isin(*listed)))
    bound = F.transform(F.array(words), lambda ws: F.named_struct(F.lit("sentences"), F.size(found), F.lit("p"), among(ws, positive), F.lit("n"), among(ws, negative), F.lit("all"), F.size(ws)))
    return F.when(c.isNotNull(), F.transform(bound, record).getItem(0))


def shown_sentences(c: Column, most: int = 200) -> Column:
    """The first sentences of more than 20 characters."""
    return F.slice(F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), strip), lambda s: F.length(s) > 20), 1, most)


def sentiment(c: Column, model: Callable[[Column], Column] | None = None, name: str = "finbert") -> Column:
    """The record of lexicon(), from a model where there is one that answers: `model` gives for an array of sentences an array of
    struct(positive, negative, neutral) probabilities, or null; score and shares are their means."""
    rules = lexicon(c)
    if model is None:
        return rules
    found = shown_sentences(c)
    told = F.when(F.size(found) > 0, model(found))
    mean = lambda field: F.aggregate(told, F.lit(0.0), lambda s, p: s + F.coalesce(p[field], F.lit(0.0))) / F.size(told)
    record = F.struct((mean("positive") - mean("negative")).alias("score"), F.size(told).alias("n_sentences"), F.lit(name).alias("backend"), mean("positive").alias("positive"), mean("negative").alias("negative"), mean("neutral").alias("neutral"))
    return F.when(F.size(told) > 0, record).otherwise(rules)


def lexicon_score(c: Column, positive=POSITIVE, negative=NEGATIVE, most: int = 200) -> Column:
    return lexicon(c, positive, negative, most)["score"]


def snippet(c: Column, most: int = 350) -> Column:
    """The start of a text without a cut word."""
    return F.concat(F.regexp_replace(F.substring(c, 1, most), " [^ ]*$", ""), F.lit("…"))


def deep_link(url: Column, text: Column) -> Column:
    """The url with a text fragment of the first 8 words, percent-encoded as UTF-8 but for letters, digits and _.-~/"""
    words = F.filter(F.split(text, r"[\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"), lambda w: w != "")
    out = F.url_encode(F.array_join(F.slice(words, 1, 8), " "))
    for there, here in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        out = F.replace(out, F.lit(there), F.lit(here))
    return F.concat(url, F.lit("#:~:text="), out)


def linkify(c: Column, urls: Column) -> Column:
    """[n] as a Markdown link to the n-th url, where there is one; other text stays."""
    marks = F.regexp_extract_all(c, F.lit(r"\[(\d+)\]"), F.lit(1))
    url = lambda n: F.when(F.length(n) < 10, F.try_element_at(urls, F.nullif(n.cast("int"), F.lit(0))))
    linked = F.transform(marks, lambda n: F.coalesce(F.concat(F.lit("[["), n, F.lit("]]("), url(n), F.lit(")")), F.concat(F.lit("["), n, F.lit("]"))))
    return F.array_join(F.zip_with(F.split(c, r"\[\d+\]", -1), linked, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def citation_link(cite: Column, url: Column, text: Column) -> Column:
    """The citation as a Markdown link to the passage, or plain where there is no url."""
    return F.coalesce(F.concat(F.lit("["), cite, F.lit("]("), deep_link(url, text), F.lit(")")), cite)


def citation(ticker: Column, form: Column, date: Column, item: Column, title: Column) -> Column:
    call = F.concat(ticker, F.lit(" Earnings Call ("), date, F.lit(")"))
    phase = F.when(item == "QA", "Q&A").when(item == "PR", "Prepared Remarks")
    spoken = F.concat(call, F.coalesce(F.concat(F.lit(", "), phase), F.lit("")), F.lit(" — "), title)
    filed = F.concat(ticker, F.lit(" "), form, F.lit(" ("), date, F.lit("), Item "), item, F.lit(" — "), title)
    return F.when(F.upper(form) == "TRANSCRIPT", spoken).otherwise(filed)


def cited_numbers(c: Column) -> Column:
    """Distinct numbers in groups like [1, 2], ascending."""
    groups = F.regexp_extract_all(c, F.lit(CITE_GROUP), F.lit(0))
    found = F.transform(F.regexp_extract_all(F.array_join(groups, " "), F.lit(r"\d+"), F.lit(0)), lambda n: n.cast("int"))
    return F.array_sort(F.array_distinct(found))


def prune_citations(answer: Column, sources: Column) -> tuple[Column, Column]:
    """(answer with cited sources numbered anew, the cited sources); without a valid citation both stay."""
    cited = F.filter(cited_numbers(answer), lambda n: (n >= 1) & (n <= F.size(sources)))
    groups = F.regexp_extract_all(answer, F.lit(CITE_GROUP), F.lit(0))

    def renumber(group: Column) -> Column:
        members = F.transform(F.regexp_extract_all(group, F.lit(r"\d+"), F.lit(0)), lambda n: F.array_position(cited, n.cast("int")))
        valid = F.filter(members, lambda n: n > 0)
        return F.when(F.size(valid) > 0, F.concat(F.lit("["), F.array_join(F.transform(valid, lambda n: n.cast("string")), ", "), F.lit("]"))).otherwise(group)

    pieces = F.split(answer, CITE_GROUP, -1)
    text = F.array_join(F.zip_with(pieces, F.transform(groups, renumber), lambda p, g: F.concat(p, F.coalesce(g, F.lit("")))), "")
    kept = F.transform(cited, lambda n: F.element_at(sources, n))
    return F.when(F.size(cited) > 0, text).otherwise(answer), F.when(F.size(cited) > 0, kept).otherwise(sources)


def validated_guidance(raw: Column) -> Column:
    """The object in a model's reply, code fences stripped, or null unless both keys are lists of at most 5 strings of 1 to 199 characters."""
    bare = strip(F.regexp_replace(strip(raw), r"(?i)^```(?:json)?|```$", ""))
    value = F.try_parse_json(bare)
    out = F.from_json(bare, "revenue_guidance array<string>, capex_guidance array<string>")

    def good(key: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(value, f"$.{key}", "variant"))
        items = out[key]
        return kind.isin("ARRAY<STRING>", "ARRAY<VOID>") & (F.size(items) <= 5) & F.forall(items, lambda s: (F.length(s) > 0) & (F.length(s) < 200))

    return F.when(good("revenue_guidance") & good("capex_guidance"), out)


def letter_vector(text: Column) -> Column:
    """A unit vector from how often each of a-z occurs against the mean: an embedder that needs no model, for tests and the registered queries."""
    low = F.lower(F.coalesce(text, F.lit("")))
    counts = F.transform(F.array(*map(F.lit, "abcdefghijklmnopqrstuvwxyz")), lambda c: (F.length(low) - F.length(F.replace(low, c, F.lit("")))).cast("double"))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, b: a + b)
    bound = lambda v, by: F.named_struct(F.lit("v"), v, F.lit("by"), by)  # noqa: E731  both are taken once a text
    centred = F.transform(F.transform(F.array(counts), lambda v: bound(v, total(v) / 26)), lambda s: F.transform(s["v"], lambda x: x - s["by"]))
    scaled = F.transform(centred, lambda v: bound(v, F.greatest(F.sqrt(total(F.transform(v, lambda x: x * x))), F.lit(1e-6))))
    return F.transform(scaled, lambda s: F.transform(s["v"], lambda x: x / s["by"])).getItem(0)
