"""Personal data: base patterns, and offset-preserving deobfuscation.

Base spans come from the patterns on the text as it is. Then transducers rewrite
a text that shows signs of disguise (homoglyphs and full-width characters,
invisible characters, digits spelled out, "at" and "dot" for the marks, each by
itself), keeping for each character written the span of the source it came from.
The patterns run again on what was written, and their spans are mapped back.
Those that are inside no base span of their kind and no other added one are
added, wider ones around a base span too; base spans stay as they are.

Spans are in code points, end exclusive. The patterns' loops are written so
that they take time in proportion to the text, whatever it holds.

Defined results: null or empty text has no spans. One row out for each row in,
null and repeated ids included. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm._arrow import bounded_batches, give_back, slices, text_buffers

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# a match can't begin inside a run of digits: the run before it would have
# matched as well, or failed in the same place
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(_LOCAL)) if at - free < 512 else _run_start(text, free, at)
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield "email", start, found.end()
            free = found.end()
        at = text.find("@", max(at + 1, free))


def _run_start(text: str, free: int, at: int) -> int:
    """Where the run of local characters before ``at`` begins."""
    start = at
    while start > free:
        step = text[max(free, start - 512) : start]
        left = len(step.rstrip(_LOCAL))
        start -= len(step) - left
        if left:
            break
    return start


def find(text: str) -> list[Span]:
    """Base spans, by kind, then start."""
    out = list(_emails(text)) if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


#: Letters that look like ASCII ones (fixed values), beside those that Unicode's
#: compatibility forms give.
LOOKALIKES = dict(zip("АВЕКМНОРСТУХаеорсухіјѕԁһӏΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανρıℓ＠﹫․。．", "ABEKMHOPCTYXaeopcyxijsdhlABEZHIKMNOPTYXoavpil@@..."))
INVISIBLE = "­᠎​‌‍⁠⁡⁢⁣﻿"
#: Number words of digits (fixed values).
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
}
_NUMBER = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_DOT_WORD = "dot|punkt|punto|point"
_SPELLED = re.compile(rf"(?i)(?<!\w)(?:plus[ -]{{1,3}})?(?:{_NUMBER}|[0-9])(?:[ ,.-]{{1,3}}(?:{_NUMBER}|{_DOT_WORD}|[0-9])(?!\w)){{3,}}")
#: The same with whole numbers beside the words, and literal dots kept.
_MIXED = re.compile(rf"(?i)(?<!\w)(?:plus[ -]{{1,3}})?(?:{_NUMBER}|[0-9]++)(?:[ ,.-]{{1,3}}(?:{_NUMBER}|{_DOT_WORD}|[0-9]++)(?!\w)){{3,}}")
_MIXED_SIGN = re.compile(rf"(?i)(?<!\w)(?:{_NUMBER})[ ,.-]{{1,3}}(?:{_NUMBER}|{_DOT_WORD}|[0-9])|[0-9][ ,.-]{{1,3}}(?:{_NUMBER}|{_DOT_WORD})(?!\w)")
_PIECE = re.compile(rf"(?i)(?P<plus>plus)|(?P<dot>{_DOT_WORD})|(?P<word>{_NUMBER})|(?P<digit>[0-9])")
_MIXED_PIECE = re.compile(rf"(?i)(?P<plus>plus)|(?P<dot>{_DOT_WORD}|(?<=\w)\.(?=\w))|(?P<word>{_NUMBER})|(?P<digit>[0-9])")
_DOT_SHOWN = rf" ?(?:\[ ?(?:{_DOT_WORD}|\.) ?\]|\( ?(?:{_DOT_WORD}|\.) ?\)|\{{ ?(?:{_DOT_WORD}) ?\}}|< ?(?:{_DOT_WORD}) ?>|(?<=\w) (?:{_DOT_WORD}) (?=\w)|(?<=\w)_dot_(?=\w)) ?"
_DOT = re.compile(f"(?i){_DOT_SHOWN}")
# a bare "at" counts before a domain in which a dot is disguised
_AT = re.compile(rf"(?i) ?(?:\[ ?at ?\]|\( ?at ?\)|\{{ ?at ?\}}|< ?at ?>|(?<=\w) at (?=[\w-]++(?:\.[\w-]++)*+{_DOT_SHOWN}\w)|(?<=\w)_at_(?=\w)) ?")
#: In every text that _AT or _DOT changes, and cheaper to look for.
_MARKED = re.compile(rf"(?i)[\[({{<] ?(?:at|{_DOT_WORD}|\.) ?[\])}}>]| (?:{_DOT_WORD}) |_(?:at|dot)_")
_ODD = re.compile("[" + re.escape("".join(LOOKALIKES)) + INVISIBLE + "٠-٩۰-۹०-९⁰-ₜ①-⑨！-～\U0001d400-\U0001d7ff]")


class Written:
    """A text being rewritten, and the source span of each of its characters."""

    def __init__(self, text: str, start: Sequence[int] | None = None, end: Sequence[int] | None = None):
        self.text, self.start, self.end = text, start or range(len(text)), end or range(1, len(text) + 1)

    def copy(self) -> Written:
        return Written(self.text, self.start, self.end)

    def rewrite(self, pattern: re.Pattern, to: Callable[[re.Match], list[tuple[str, int, int]]]) -> None:
        """Replaces each match by characters, each from a part (a, b) of it."""
        text, start, end, last = [], [], [], 0
        for m in pattern.finditer(self.text):
            text.append(self.text[last : m.start()])
            start += self.start[last : m.start()]
            end += self.end[last : m.start()]
            for c, a, b in to(m):
                text.append(c)
                start.append(self.start[a])
                end.append(self.end[b - 1])
            last = m.end()
        if last:
            text.append(self.text[last:])
            self.text, self.start, self.end = "".join(text), [*start, *self.start[last:]], [*end, *self.end[last:]]

    def source(self, a: int, b: int) -> tuple[int, int]:
        return self.start[a], self.end[b - 1]


def _plain(m: re.Match) -> list[tuple[str, int, int]]:
    c = m[0]
    if c in INVISIBLE:
        return []
    shown = LOOKALIKES.get(c) or (str(unicodedata.digit(c)) if unicodedata.digit(c, None) is not None else unicodedata.normalize("NFKC", c))
    return [(shown if len(shown) == 1 and shown.isascii() else c, m.start(), m.end())]


def _digits(piece: re.Pattern) -> Callable[[re.Match], list[tuple[str, int, int]]]:
    sign = {"plus": "+", "dot": "."}
    return lambda m: [(sign.get(p.lastgroup) or DIGIT_WORDS.get(p[0].lower(), p[0]), p.start(), p.end()) for p in piece.finditer(m.string, m.start(), m.end())]


def deobfuscated(text: str) -> list[Written]:
    """The text with disguises undone, once for each reading of its numbers; none
    if it shows no disguise. A reading is there where its pattern matches, so what
    is found doesn't depend on other disguises in the text."""
    plain = Written(text)
    if not text.isascii() and _ODD.search(text):
        plain.rewrite(_ODD, _plain)
    out = {plain.text: plain} if plain.text != text else {}
    readings = [()]
    if _SPELLED.search(plain.text):
        readings.append((_SPELLED, _digits(_PIECE)))
    if _MIXED_SIGN.search(plain.text):
        readings.append((_MIXED, _digits(_MIXED_PIECE)))
    marked = _MARKED.search(plain.text)
    one = lambda c: lambda m: [(c, m.start(), m.end())]
    for reading in readings:
        if not (reading or marked):
            continue
        new = plain.copy()
        if reading:
            new.rewrite(*reading)
        if marked:
            new.rewrite(_AT, one("@"))
            new.rewrite(_DOT, one("."))
        if new.text != text:
            out.setdefault(new.text, new)
    return list(out.values())


def find_all(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, by kind, then start."""
    base = find(text)
    known = {kind: [(a, b) for k, a, b in base if k == kind] for kind in KINDS}
    more = {kind: set() for kind in KINDS}
    for out in deobfuscated(text):
        for kind, a, b in find(out.text):
            more[kind].add(out.source(a, b))
    return base, [(kind, a, b) for kind in KINDS for a, b in sorted([*known[kind], *_outside(more[kind], known[kind])])]


def _outside(spans: set[tuple[int, int]], base: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Those of ``spans`` that are not in ``base``, and inside no other span."""
    last, held = 0, set(base)
    for a, b in sorted(spans | held, key=lambda s: (s[0], -s[1])):
        if b > last:
            last = b
            if (a, b) not in held:
                yield a, b


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, list[str]]]:
    _, offs = text_buffers(batch.column(column))
    for a, b in slices(offs):
        yield a, b, [t or "" for t in batch.column(column).slice(a, b - a).to_pylist()]


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans): arrays of (kind, start, end) by kind, then start."""
    kind_of = df.schema[id_col].dataType.simpleString()
    spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in _texts(batch, 1):
                base, spans = zip(*map(find_all, texts))
                rows = [pa.array([[dict(zip(("kind", "start", "end"), s)) for s in x] for x in column], spans_type) for column in (base, spans)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *rows], names=["id", "base", "spans"])

    span = "array<struct<kind:string,start:long,end:long>>"
    return bounded_batches(df.select(id_col, text_col)).mapInArrow(run, f"id {kind_of}, base {span}, spans {span}").withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind and the digest of the base spans, and all spans as text."""
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(id_col, *map(count, KINDS), F.sha2(shown("base"), 256).alias("base_sha256"), shown("spans").alias("spans"))


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, overlapping ones as one, replaced by its kind."""
    out, last = [], 0
    for a, b, kind in sorted((a, b, kind) for kind, a, b in spans):
        if a >= last:
            out += [text[last:a], f"<{kind.upper()}>"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with every span in the text replaced by ``<KIND>``; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for a, b, texts in _texts(batch, at):
                part = batch.slice(a, b - a)
                null = part.column(at).is_null().to_pylist()
                done = [None if n else redacted(t, find_all(t)[1]) for t, n in zip(texts, null)]
                yield part.set_column(at, part.schema.field(at), pa.array(done, part.schema.field(at).type))
            give_back()

    return bounded_batches(df).mapInArrow(run, df.schema)


def base_digest(text: str) -> str:
    return hashlib.sha256(_joined(find(text)).encode()).hexdigest()
