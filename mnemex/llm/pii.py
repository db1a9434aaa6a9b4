"""Personal data: base patterns, and offset-preserving deobfuscation.

The base finders return what the contract's patterns match, leftmost and
non-overlapping per kind. They scan in linear time: an email is grown from its @ sign, digit runs
are entered at their start only, so a long run of digits or dots costs one pass.

Texts that hold a disguise are rewritten by transducers that emit normalised text together with a
piecewise map to source offsets: zero-width characters vanish, look-alike letters and digits of other scripts become
ASCII, ``[at]`` / `` at `` and ``(dot)`` / `` dot `` become ``@`` and ``.``, as do words between bars (``_at_``) and codes (``&#64;``, ``%40``), spelled digits become digits, with and without the
blanks between them. The same finders run on that text, and
spans that touch a rewritten place are mapped back. A found span adds to the base spans of its
kind unless one of them holds it already; base spans never go.

One map over whole texts, no shuffle. Defined results: null and empty texts have no
spans; offsets are code points, end exclusive; equal rows are treated alike; null ids and other columns pass.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def emails(text: str) -> list[Span]:
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL_CHARS:
            start -= 1
        end = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            end = m.end()
        # text before this sign never serves another one: the sign stands between
        floor = end
        at = text.find("@", at + 1 if end == at + 1 else end)
    return out


def ips(text: str) -> list[Span]:
    def small(part: str) -> bool:
        part = part.lstrip("0")
        return len(part) < 4 and int(part or 0) <= 255

    return [m.span() for m in IP.finditer(text) if all(map(small, m[0].split(".")))]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def cards(text: str) -> list[Span]:
    out = []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    if "+" not in text:
        return []
    return [m.span() for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]


FINDERS = {"email": emails, "ip": ips, "card": cards, "phone": phones}


def base_spans(text: str) -> dict[str, list[Span]]:
    return {kind: find(text) for kind, find in FINDERS.items()}


# Cyrillic and Greek letters that look like Latin ones.
ALIKE = dict(zip("аеорсухіјѕԁһӏАВЕКМНОРСТХІЈЅ", "aeopcyxijsdhlABEKMHOPCTXIJS", strict=True)) | dict(zip("ορνιΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "opviABEZHIKMNOPTYX", strict=True))
# Words for digits.
SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
# Last labels that a domain after a bare "at" must have where its dots are plain.
TOP = "com|net|org|edu|gov|info|biz|io|co|us|uk|de|fr|es|it|nl|eu|ch|at|ca|au|jp|example|test"
ZERO_WIDTH = "​‌‍⁠﻿­"


def _look_alikes() -> dict[str, str]:
    """Beyond Latin-1: decimal digits of any script, and characters whose compatibility form is one ASCII character."""
    table = dict(ALIKE)
    for code in [*range(0x100, 0xD800), *range(0xFE00, 0x10000), *range(0x1D400, 0x1D800), *range(0x10000, 0x11000), *range(0x11000, 0x12000)]:
        c = chr(code)
        if (digit := unicodedata.decimal(c, None)) is not None:
            table[c] = str(digit)
        elif len(form := unicodedata.normalize("NFKC", c)) == 1 and "!" <= form <= "~":
            table[c] = form
    return table


LOOK_ALIKES = _look_alikes()
STRANGE = frozenset(LOOK_ALIKES) | frozenset(ZERO_WIDTH)
_LETTERS = str.maketrans(LOOK_ALIKES)
_DIGIT = "|".join(SPELLED)
_AT, _DOT = r"at|@|arroba", r"dot|\.|point|punkt|punto"
_LABEL = r"[A-Za-z0-9-]+"
# What stands after "at" or before it in plain prose about places, sites and dots.
_NO_LABEL = r"(?:the|a|an|this|that|these|those|each|every|some|any|one|its|his|her|their|our|my|your)\b"
AT_PROSE = [
    "me", "us", "them", "it", "him", "you", "is", "are", "was", "were", "be", "been", "and", "or", "but", "look", "looks", "looked", "looking", "see", "seen",
    "find", "found", "visit", "available", "online", "live", "hosted", "read", "more", "also", "here", "there", "site", "website", "page", "pages", "shop",
    "blog", "store", "details", "info", "only", "up", "down", "back", "out", "now", "stay", "sold", "listed", "published", "posted", "shown", "works",
    "worked", "working", "meet", "arrive", "stop", "aim", "point", "start", "end", "stare", "sale", "register", "buy", "order", "follow", "learn", "try", "go",
    "stays", "work", "job",
]
_AT_CODE, _DOT_CODE = r"&(?:#0*64|#x0*40|commat);|%40", r"&(?:#0*46|#x0*2e|period);|%2e"
TOKENS = re.compile(
    rf"(?P<gone>[{ZERO_WIDTH}]+)"
    rf"|(?P<at>(?<!\s)\s*+[\[({{<]\s*+(?:{_AT})\s*+[\])}}>]\s*+)"
    rf"|(?P<dot>(?<!\s)\s*+[\[({{<]\s*+(?:{_DOT})\s*+[\])}}>]\s*+)"
    rf"|(?P<at_word>(?<=[A-Za-z0-9])\s++at\s++(?=(?!{_NO_LABEL}){_LABEL}(?:(?:\.|\s++dot\s++){_LABEL}){{0,4}}\s++dot\s++[A-Za-z]{{2,24}}\b))"
    rf"|(?P<at_site>(?<=[A-Za-z0-9])\s++at\s++(?={_LABEL}(?:\.{_LABEL}){{0,4}}\.(?:{TOP})\b))"
    rf"|(?P<at_bar>(?<=[A-Za-z0-9])[_-]at[_-](?=[A-Za-z0-9]+(?:[_-]dot[_-][A-Za-z0-9]+)+))"
    rf"|(?P<at_code>{_AT_CODE})"
    rf"|(?P<dot_word>(?<=[A-Za-z0-9])(?:\s++dot\s++|[_-]dot[_-])(?=[A-Za-z0-9]))"
    rf"|(?P<dot_code>{_DOT_CODE})"
    rf"|(?P<digit>(?<![A-Za-z0-9])(?:{_DIGIT})(?![A-Za-z0-9]))",
    re.IGNORECASE,
)
NEW = {"gone": "", "at": "@", "at_word": "@", "at_site": "@", "at_bar": "@", "at_code": "@", "dot": ".", "dot_word": ".", "dot_code": "."}
LAST_WORD = re.compile(r"[A-Za-z0-9]+\Z")
_SPELLED = rf"(?<![A-Za-z0-9])(?:{_DIGIT})(?![A-Za-z0-9])"
_BETWEEN = r"[ \t().+-]+"
# What TOKENS rewrites, brackets, codes and words alike. A spelled digit counts next to another digit only: no span has a single one.
HINT = re.compile(
    rf"[\[({{<]\s*+(?:{_AT}|{_DOT})\s*+[\])}}>]|[\s_-]dot[\s_-]|\sat\s++{_LABEL}(?:\.{_LABEL}){{0,4}}\.(?:{TOP})\b|{_AT_CODE}|{_DOT_CODE}|{_SPELLED}{_BETWEEN}(?:[0-9]|{_SPELLED})|[0-9]{_BETWEEN}{_SPELLED}", re.IGNORECASE
)
# Blanks between single digits, where one at least is spelled.
SPELLED_GAP = re.compile(r"[ \t]{1,2}\Z")
GAP_BEFORE_DIGIT = re.compile(r"[ \t]{1,2}(?=[0-9](?![0-9]))")
GAP_AFTER_DIGIT = re.compile(r"(?<=[0-9])(?<![0-9]{2})[ \t]{1,2}\Z")


def disguised(text: str) -> bool:
    if not text.isascii():
        try:
            text.encode("latin-1")
            if "­" in text:
                return True
        except UnicodeEncodeError:
            if not STRANGE.isdisjoint(text):
                return True
    return HINT.search(text) is not None


class Mapped:
    """Normalised text and, piece by piece, where each stretch of it came from."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size = 0
        self.starts: list[int] = []
        self.pieces: list[tuple[int, int, int, bool]] = []  # source start, source end, length, rewritten

    def emit(self, out: str, start: int, end: int, rewritten: bool) -> None:
        if out or rewritten:
            self.starts.append(self.size)
            self.pieces.append((start, end, len(out), rewritten))
            self.parts.append(out)
            self.size += len(out)

    @property
    def text(self) -> str:
        return "".join(self.parts)

    def source(self, start: int, end: int) -> Span:
        def place(at: int, last: bool) -> int:
            k = bisect_right(self.starts, at) - 1
            a, b, n, rewritten = self.pieces[k]
            if rewritten:
                return b if last else a
            return a + (at - self.starts[k]) + last

        return place(start, False), place(end - 1, True)

    def touched(self, start: int, end: int) -> bool:
        k = max(0, bisect_right(self.starts, start) - 1)
        while k < len(self.pieces) and self.starts[k] < end:
            if self.pieces[k][3] and (self.pieces[k][2] and self.starts[k] + self.pieces[k][2] > start or not self.pieces[k][2] and self.starts[k] > start):
                return True
            k += 1
        return False


def normalise(text: str, close_gaps: bool = False) -> Mapped:
    """The text without disguises; ``close_gaps`` also drops the blanks around spelled digits."""
    plain = text.translate(_LETTERS)  # one character for one, so offsets stay
    out, at = Mapped(), 0

    def copy(start: int, end: int) -> None:
        """Source characters that translation changed count as rewritten, one by one."""
        run = start
        if plain[start:end] != text[start:end]:
            for i in range(start, end):
                if plain[i] != text[i]:
                    out.emit(plain[run:i], run, i, False)
                    out.emit(plain[i], i, i + 1, True)
                    run = i + 1
        out.emit(plain[run:end], run, end, False)

    def between(start: int, end: int, spelled_before: bool, spelled_after: bool) -> None:
        """What stands between two tokens."""
        if close_gaps:
            gap = plain[start:end]
            if spelled_before and (m := (SPELLED_GAP.match(gap) if spelled_after else None) or GAP_BEFORE_DIGIT.match(gap)):
                out.emit("", start, start + m.end(), True)
                start += m.end()
            if spelled_after and (m := GAP_AFTER_DIGIT.search(plain, max(start, end - 3), end)):
                copy(start, m.start())
                out.emit("", m.start(), end, True)
                start = end
        copy(start, end)

    kind = None
    for m in TOKENS.finditer(plain):
        if m.lastgroup == "at_site" and LAST_WORD.search(plain, max(0, m.start() - 64), m.start())[0].lower() in AT_PROSE:
            continue  # "available at example.com" names a site
        last, kind = kind, m.lastgroup
        between(at, m.start(), last == "digit", kind == "digit")
        out.emit(SPELLED[m[0].lower()] if kind == "digit" else NEW[kind], *m.span(), True)
        at = m.end()
    between(at, len(text), kind == "digit", False)
    return out


def hidden_spans(text: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Spans that only the normalised text shows, at their source offsets; the longest where one holds another.

    The finders run with and without the blanks around spelled digits: dropping them joins the parts of
    an address, and may join one with a number that isn't part of it.
    """
    if not disguised(text):
        return {}
    found: dict[str, set[Span]] = {}
    views = [normalise(text)]
    if not any(p[3] for p in views[0].pieces):
        return {}
    closed = normalise(text, close_gaps=True)
    if closed.size < views[0].size:
        views.append(closed)
    for mapped in views:
        clear = mapped.text
        for kind, find in FINDERS.items():
            starts = [s for s, _ in base[kind]]
            for s, e in find(clear):
                if mapped.touched(s, e):
                    a, b = mapped.source(s, e)
                    k = bisect_right(starts, a) - 1
                    if k < 0 or base[kind][k][1] < b:
                        found.setdefault(kind, set()).add((a, b))
    return {kind: _longest(spans) for kind, spans in found.items()}


def _longest(spans: set[Span]) -> list[Span]:
    out: list[Span] = []
    for s, e in sorted(spans, key=lambda x: (x[0], -x[1])):
        if not out or e > out[-1][1]:
            out.append((s, e))
    return out


def all_spans(text: str | None) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    text = text or ""
    base = base_spans(text)
    more = hidden_spans(text, base)
    return base, {k: sorted({*base[k], *more.get(k, [])}) for k in KINDS}


def listed(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in spans[k])


def redact(text: str | None) -> str | None:
    """The text with every span replaced by its kind; overlapping spans become one, named after the first."""
    if not text:
        return text
    spans = sorted((s, -e, k) for k, own in all_spans(text)[1].items() for s, e in own)
    if not spans:
        return text
    out, at, end, kind = [], 0, -1, ""
    for s, minus_e, k in spans:
        if s >= end:
            if kind:
                out.append(f"<{kind.upper()}>")
                at = end
            out.append(text[at:s])
            end, kind = -minus_e, k
        else:
            end = max(end, -minus_e)
    return "".join([*out, f"<{kind.upper()}>", text[end:]])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, digests, spans, hidden = {k: [] for k in KINDS}, [], [], []
        for x in batch.column(1):
            base, every = all_spans(x.as_py())
            for k in KINDS:
                counts[k].append(len(base[k]))
            digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
            spans.append(listed(every))
            hidden.append(sum(map(len, every.values())) - sum(map(len, base.values())))
        yield pa.record_batch(
            [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(hidden, pa.int64())],
            names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_hidden"],
        )


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: base counts, digest of the base spans, all spans, and how many only deobfuscation found."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_find, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_hidden long")


def redact_pii(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span in the text replaced; ``length_col`` follows the new text. Null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index(text_col)
            yield batch.set_column(i, batch.schema.field(i), pa.array([redact(x.as_py()) for x in batch.column(i)], batch.schema.field(i).type))

    out = docs.mapInArrow(run, docs.schema)
    if length_col and length_col in docs.columns:
        out = out.withColumn(length_col, F.when(F.col(text_col).isNull(), F.col(length_col)).otherwise(F.length(text_col)).cast(docs.schema[length_col].dataType))
    return out


def op5(docs: DataFrame) -> DataFrame:
    return find_pii(docs)
