"""Find personal data in texts, also where it is disguised, at its place in the original.

The stated patterns are matched on the text as it is. Then transducers undo disguises, one
after the other: lookalike and invisible characters, digits that are spelled out, bracketed
signs, and signs written as words. Each gives a new text and the list of what it replaced, so
that a span of the last text leads back, replacement by replacement, to the characters of
the original. What the patterns find there and did not find before is added.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrascore.llm.base import fresh, slices, table, text_or_empty
from terrascore.llm.registry import query

#: The stated kinds, in the order in which spans of one start are listed, and what a match needs.
KINDS = ("email", "ip", "card", "phone")
IP_MOST, CARD_DIGITS, PHONE_DIGITS = 255, (14, 19), (10, 15)
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Digits as they are spelled, in the languages of the corpus.
SPELLED = {
    word: str(digit)
    for words in (
        "zero one two three four five six seven eight nine",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for digit, word in enumerate(words.split())
} | {"oh": "0"}
AT_WORDS, DOT_WORDS = "at arobase arroba ät", "dot point punkt punto"
#: Letters of other scripts that look like Latin ones, each above the letter.
LOOKALIKES = str.maketrans(
    "АВЕЅЗІЈКМНОРСТУХаеѕіјорсухһԁԛԝӏΑΒΕΖΗΙΚΜΝΟΡΤΥΧαινορτυχɑɡı",
    "ABES3IJKMHOPCTYXaesijopcyxhdqwlABEZHIKMNOPTYXaivoptuxagi",
)
#: Soft hyphen, joiners, marks of direction, invisible operators, variation selectors, byte order mark.
_INVISIBLE = "\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\ufe0e\ufe0f\ufeff"
#: Spelled digits that make a run.
LEAST_SPELLED = 3

Span = tuple[int, int, int]  # start, kind, end
Edits = list[tuple[int, int, int, int]]  # start and end in the new text, start and end in the old one


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _luhn(digits: str) -> bool:
    doubled = (int(c) * 2 for c in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 * (d > 9) for d in doubled)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses that do not overlap: each sign with what stands before it, back to the last sign or address."""
    free = 0
    at = text.find("@")
    while at >= 0:
        before = text[free:at]
        start = free + len(before.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        # nothing before a sign can be part of a later address
        free = domain.end() if domain else at + 1
        at = text.find("@", free)


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost runs of four numbers joined by dots: of a longer run each four in turn."""
    for m in _NUMBERS.finditer(text):
        if m[0].count(".") < 3:
            continue
        parts, start = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= IP_MOST for p in four):
                yield start, end
            start = end + 1


def base_spans(text: str) -> list[Span]:
    """The stated patterns: leftmost matches that do not overlap within a kind, those that fail their test dropped."""
    out = [(s, 0, e) for s, e in _emails(text)]
    out += [(s, 1, e) for s, e in _addresses(text)]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= CARD_DIGITS[0] and CARD_DIGITS[0] <= len(d := _digits(m[0])) <= CARD_DIGITS[1] and _luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if PHONE_DIGITS[0] <= len(_digits(m[0])) <= PHONE_DIGITS[1]]
    return sorted(out)


def rewritten(text: str, pieces: Iterator[tuple[int, int, str]]) -> tuple[str, Edits]:
    """The text with ``pieces`` (start, end, replacement; in order, apart) replaced, and the way back."""
    out, edits, at, size = [], [], 0, 0
    for start, end, new in pieces:
        out += [text[at:start], new]
        size += start - at
        edits.append((size, size + len(new), start, end))
        size += len(new)
        at = end
    return ("".join([*out, text[at:]]), edits) if edits else (text, [])


def _back(edits: Edits, start: int, end: int) -> tuple[int, int, bool]:
    """A span in the old text, and whether anything inside was replaced; a piece that is cut counts whole."""
    if not edits:
        return start, end, False
    starts = [e[0] for e in edits] if len(edits) < 64 else _Starts(edits)
    last = bisect_right(starts, end - 1) - 1
    first = bisect_right(starts, start) - 1
    # at its start a span leaves out what was removed just before it
    old_start = start if first < 0 else edits[first][2] if start < edits[first][1] else edits[first][3] + start - edits[first][1]
    old_end = end if last < 0 else edits[last][3] if end <= edits[last][1] else edits[last][3] + end - edits[last][1]
    touched = last > first or (first >= 0 and start < edits[first][1])
    return old_start, old_end, touched


class _Starts:
    """The new starts of a long list of edits, for a search that copies none of it."""

    def __init__(self, edits: Edits):
        self.edits = edits

    def __len__(self) -> int:
        return len(self.edits)

    def __getitem__(self, at: int) -> int:
        return self.edits[at][0]


_FOREIGN = re.compile("[\u00a0\u00ad\u0131\u0251\u0261\u0300-\U0010ffff]+")


@lru_cache(1 << 14)
def _plain(c: str) -> str:
    """The ASCII character that ``c`` looks like or stands for, nothing for an invisible one, else itself."""
    if c in _INVISIBLE:
        return ""
    if (digit := unicodedata.decimal(c, None)) is not None:
        return str(digit)
    kind = unicodedata.category(c)
    if kind == "Zs":
        return " "
    if kind == "Pd" or c == "−":
        return "-"
    like = unicodedata.normalize("NFKC", c).translate(LOOKALIKES)
    return like if len(like) == 1 and like < "\x7f" else c


def _letters(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _FOREIGN.finditer(text):
        for at, c in enumerate(m[0], m.start()):
            if (new := _plain(c)) != c:
                yield at, at + 1, new


_SPELLED = "|".join(sorted(SPELLED, key=len, reverse=True))
_AT, _DOT = AT_WORDS.replace(" ", "|"), DOT_WORDS.replace(" ", "|")
_TOKEN = rf"(?:{_SPELLED}|[0-9]+)"
_RUN = re.compile(
    rf"(?<![^\W_])(?:plus\x20)?{_TOKEN}(?:(?:,?\x20|-|\x20(?:{_DOT})\x20){_TOKEN}(?![^\W_])){{{LEAST_SPELLED - 1},}}", re.IGNORECASE)
_IN_RUN = re.compile(rf"(plus\x20)|({_SPELLED})|([0-9]+)|(\x20(?:{_DOT})\x20)|[-,\x20]+", re.IGNORECASE)


def _spelled(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _RUN.finditer(text):
        tokens = list(_IN_RUN.finditer(text, m.start(), m.end()))
        if sum(bool(t[2]) for t in tokens) >= LEAST_SPELLED:
            for t in tokens:
                if not t[3]:
                    yield t.start(), t.end(), "+" if t[1] else SPELLED[t[2].lower()] if t[2] else "." if t[4] else ""


_BRACKETED = re.compile(
    rf"\x20?[\[({{<]\x20?(?:({_AT}|@)|{_DOT}|\.)\x20?[\])}}>]\x20?|(&\#0*64;|&commat;)|&\#0*46;|&period;", re.IGNORECASE)


def _signs(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _BRACKETED.finditer(text):
        yield m.start(), m.end(), "@" if m[1] or m[2] else "."


_WORD_DOT = rf"\x20(?:{_DOT}|\.)\x20"
_WORDED = re.compile(_WORD_DOT, re.IGNORECASE)
_NAME = r"[A-Za-z0-9_%+-]{1,64}"
_LABEL = r"[A-Za-z0-9-]{1,63}"
#: Names and labels with a worded sign between them; either the sign or a dot of the domain is disguised.
_SHAPE = re.compile(
    rf"(?<![A-Za-z0-9._%+-]){_NAME}(?:(?:\.|{_WORD_DOT}){_NAME}){{0,4}}?(?P<at>\x20?@\x20?|\x20(?:{_AT})\x20)"
    rf"(?P<domain>{_LABEL}(?:(?:\.|{_WORD_DOT}){_LABEL}){{1,4}})(?![A-Za-z0-9])", re.IGNORECASE)
_FOUR = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:(?:\.|{_WORD_DOT})[0-9]{{1,3}}){{3}}(?![0-9])", re.IGNORECASE)
_SIGN = re.compile(rf"(?P<at>\x20?@\x20?|\x20(?:{_AT})\x20)|{_WORD_DOT}", re.IGNORECASE)


def _worded(text: str, bracketed: Edits) -> Iterator[tuple[int, int, str]]:
    """Signs written as words or set apart, where names and labels or numbers surround them.

    A word for the sign alone is none ("look at example.com"): a dot of the domain must be disguised as well.
    """
    if not (_WORDED.search(text) or (bracketed and re.search(rf"\x20(?:{_AT}|@)\x20", text, re.IGNORECASE)) or "@ " in text or " @" in text):
        return
    spans = []
    for m in _SHAPE.finditer(text):
        dots = _WORDED.search(m["domain"]) or _back(bracketed, *m.span("domain"))[2]
        if dots or "@" in m["at"]:
            spans.append(m.span())
    spans += [m.span() for m in _FOUR.finditer(text) if _WORDED.search(m[0])]
    free = 0
    for start, end in sorted(spans):
        for m in _SIGN.finditer(text, max(start, free), end):
            new = "@" if m["at"] else "."
            if new != m[0]:
                yield m.start(), m.end(), new
        free = max(free, end)


def normalised(text: str) -> tuple[str, list[Edits]]:
    """The text without disguises, and what each transducer replaced, first to last."""
    layers: list[Edits] = []
    steps: list[Callable[[str], Iterator[tuple[int, int, str]]]] = [_letters, _spelled, _signs, lambda t: _worded(t, layers[-1])]
    for step in steps:
        text, edits = rewritten(text, step(text))
        layers.append(edits)
    return text, layers


def added_spans(text: str, base: list[Span]) -> list[Span]:
    """What the patterns find once disguises are undone, as spans of ``text``, if no stated span of its kind covers it."""
    plain, layers = normalised(text)
    if not any(layers):
        return []
    out = []
    ends = [[e for _, k, e in base if k == kind] for kind in range(len(KINDS))]
    starts = [[s for s, k, _ in base if k == kind] for kind in range(len(KINDS))]
    for start, kind, end in base_spans(plain):
        s, e, changed = start, end, []
        for edits in reversed(layers):
            s, e, touched = _back(edits, s, e)
            changed.append(touched)
        if not any(changed):
            continue
        if not any(changed[:-1]) and (plain[start - 1 : start].isalpha() or plain[end : end + 1].isalpha()):
            continue  # a part of a word in another script
        before = bisect_right(starts[kind], s) - 1
        if before < 0 or ends[kind][before] < e:
            out.append((s, kind, e))
    return out


def find_private(rows: DataFrame, text: str = "text", keep: list[str] | None = None, redact: bool = False) -> DataFrame:
    """``rows`` (or their columns ``keep``) with counts, a digest and the spans of personal data.

    ``n_email``, ``n_ip``, ``n_card`` and ``n_phone`` count the stated patterns in the text as it is,
    ``n_added`` what shows once disguises are undone; ``base_sha256`` is the digest of
    the stated spans and ``spans`` lists all, each as ``kind:start:end`` in code points, end
    exclusive, by start and then kind, joined by commas. An added span is not inside a
    stated one of its kind; it may overlap one that it completes. With ``redact``, ``redacted`` is the text with
    every span (overlapping ones together) replaced by the kind of its first in angle brackets.
    A null text is empty and has no spans. Columns of ``rows`` with a result's name are replaced.
    """
    names = [*(f"n_{k}" for k in KINDS), "n_added", "base_sha256", "spans", *(["redacted"] if redact else [])]
    kept = [c for c in (rows.columns if keep is None else keep) if c not in names]
    (body,) = fresh(rows, "body")
    source = rows.select(*[F.col(f"`{c}`") for c in kept], text_or_empty(f"`{text}`").alias(body))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, body):
            out = []
            for value in batch.column(batch.num_columns - 1).to_pylist():
                base = base_spans(value)
                added = added_spans(value, base)
                spans = sorted(chain(base, added))
                counts = [sum(k == kind for _, k, _ in base) for kind in range(len(KINDS))]
                digest = hashlib.sha256(_listed(base).encode()).hexdigest()
                out.append((*counts, len(added), digest, _listed(spans), *([replaced(value, spans)] if redact else ())))
            columns = [pa.array(c) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(batch.num_columns - 1)] + columns, [*kept, *names])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]]
    made = [f"{n} {'long' if n.startswith('n_') else 'string'}" for n in names]
    return source.mapInArrow(run, ", ".join([*fields, *made]))


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def replaced(text: str, spans: list[Span]) -> str:
    """The text with sorted spans replaced; spans that overlap are replaced as one."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind]}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


@query("op12_find_private_data")
def op12_find_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_private(table(spark, sf_dir, "documents"), keep=["doc_id"])
