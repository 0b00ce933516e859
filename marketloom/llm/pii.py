"""Personal data, also in disguise: transducers normalise a text and keep the way back to its characters."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import emit, texts

#: The kinds, in the order that ties are listed in.
KINDS = ("email", "ip", "card", "phone")

# The detectors match as the plain patterns would; runs are possessive and begin at
# their first character, so that no text makes them start again at each of its characters.
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
NOT_DIGIT = re.compile("[^0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    floor, at = 0, text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at + 1)
        start = at
        if domain:
            while start > floor and text[start - 1] in LOCAL:
                start -= 1
        if start < at:
            floor = domain.end()
            yield start, floor
        at = text.find("@", max(at + 1, floor))


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[::-2]))) % 10 == 0


def _is_ip(found: str) -> bool:
    parts = [p.lstrip("0") for p in found.split(".")]
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def _is_card(found: str) -> bool:
    digits = NOT_DIGIT.sub("", found) if len(found) <= 37 else ""
    return 14 <= len(digits) <= 19 and luhn(digits)


def _is_phone(found: str) -> bool:
    return 10 <= len(NOT_DIGIT.sub("", found)) <= 15


def detect(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every identifier written plainly, leftmost and not overlapping within a kind."""
    found = [(s, 0, e) for s, e in emails(text)]
    if DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if _is_ip(m[0])]
        found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if _is_card(m[0])]
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if _is_phone(m[0])]
    return sorted(found)


# --- normalisation -------------------------------------------------------------------------------

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h",
    "ӏ": "l", "ѵ": "v", "ԛ": "q", "ԝ": "w", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S", "α": "a", "ο": "o", "ν": "v", "ι": "i", "ρ": "p",
    "υ": "u", "κ": "k", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N",
    "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ɑ": "a", "ɡ": "g", "ı": "i", "ɩ": "i", "ո": "n", "ս": "u", "օ": "o",
    "․": ".", "。": ".", "｡": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "﹣": "-", "﹢": "+", "﹫": "@",
}
#: Invisible characters.
UNSEEN = "​‌‍⁠﻿­"
SPACES = "              　"


def _characters() -> dict[str, str]:
    table = dict(LOOKALIKES) | dict.fromkeys(UNSEEN, "") | dict.fromkeys(SPACES, " ")
    table |= {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}  # full width
    for low, high in ((0x1D400, 0x1D800), (0x2460, 0x2474), (0x24B6, 0x24EB)):  # mathematical, in circles
        for c in map(chr, range(low, high)):
            plain = unicodedata.normalize("NFKC", c)
            if len(plain) == 1 and plain.isascii():
                table[c] = plain
    for zero in (0x0660, 0x06F0, 0x0966, 0x09E6, 0x0E50):  # digits of other scripts
        table |= {chr(zero + d): str(d) for d in range(10)}
    return table


CHARACTERS = _characters()

#: Digits in words, in the languages of the documents.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9", "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6",
    "sieben": "7", "acht": "8", "neun": "9", "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5",
    "sept": "7", "huit": "8", "neuf": "9", "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5",
    "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_WORDS = "|".join(sorted(SPELLED, key=len, reverse=True))
# blanks, names and labels are bounded (three, 63 and eight), so that no text makes a pattern look far ahead again and again
_OPEN, _CLOSE = r"\s{0,3}[\[({<]\s{0,3}", r"\s{0,3}[\])}>]\s{0,3}"
_BOXED_DOT = rf"{_OPEN}(?:dot|punkt|point|punto|\.){_CLOSE}"
_DOT = rf"(?:{_BOXED_DOT}|\s{{1,3}}(?:dot|punkt|point|punto)\s{{1,3}}|_dot_|\s{{1,3}}\.\s{{1,3}})"
_UNIT = rf"(?:(?<!\w)(?:{_WORDS})(?!\w)|(?<![0-9])[0-9]++)"
_GAP = r"(?:[\s,/-]{1,3}|[-.()]{1,2})"

# Signs of a disguise, looked for in the lower-cased text: one for each way in which RUN or MAIL can begin to match, made of the
# same pieces. Each begins with a fixed character or word, which is quick to look for.
_CUES = (
    (None, re.compile(r"[\[({<]\s{0,3}(?:at|@|dot|punkt|point|punto|\.)\s{0,3}[\])}>]")),
    ("@", re.compile(r"@(?:\s|(?<=\s@))")),
    ("at", re.compile(r"at\s{1,3}[a-z0-9-]{1,63}\.[a-z0-9-]|at_[a-z0-9-]")),
    ("dot", re.compile(r"dot(?<![^\s_]dot)[\s_]")),
    ("punkt", re.compile(r"punkt\s")),
    ("punto", re.compile(r"punto\s")),
    ("point", re.compile(r"point(?<=\spoint)\s{1,3}[a-z0-9-]")),
    (None, re.compile(r"\.(?<=\s\.)\s{1,3}[a-z0-9-]")),
    (None, re.compile(rf"(?:{_WORDS}){_GAP}(?:(?:{_WORDS})(?!\w)|[0-9])")),
    (None, re.compile(rf"[0-9]{_GAP}(?:{_WORDS})(?!\w)")),
)
#: Letters that patterns take for "i" and "s" in either case, though lower-casing leaves them or makes two of them.
_FOLDED = str.maketrans("İıſ", "iis")


def may_hide(text: str) -> bool:
    """False only for a text in which nothing is in disguise but by its characters."""
    low = (text if text.isascii() else text.translate(_FOLDED)).lower()
    return any((word is None or word in low) and cue.search(low) for word, cue in _CUES)


RUN = re.compile(rf"(?:(?<!\w)plus\s{{1,3}})?{_UNIT}(?:(?:{_DOT}|{_GAP}){_UNIT})++", re.IGNORECASE)
PIECE = re.compile(rf"(?P<plus>plus\s{{1,3}})|(?P<word>(?<!\w)(?:{_WORDS})(?!\w))|(?P<dot>{_DOT})|(?P<gap>(?<=\w){_GAP}(?=\w))", re.IGNORECASE)
_HOST = r"[A-Za-z0-9-]{1,63}"
#: Top-level names that make "name at host.name" an address.
_TOP = r"(?:com|org|net|edu|gov|info|io|co|de|fr|es|uk|eu)"
MAIL = re.compile(
    rf"(?P<at>{_OPEN}(?:at|@){_CLOSE}|_at_(?={_HOST}(?:{_DOT}|\.){_HOST})"
    rf"|(?<=[A-Za-z0-9._%+-])\s{{1,3}}(?:at|@)\s{{1,3}}(?={_HOST}(?:\.{_HOST}){{0,8}}{_DOT}{_HOST})"
    rf"|(?<=[A-Za-z0-9._%+-])\s{{1,3}}(?:at|@)\s{{1,3}}(?={_HOST}(?:\.{_HOST}){{0,8}}\.{_TOP}(?![\w-]))"
    rf"|(?<=[A-Za-z0-9._%+-])(?:\s{{1,3}}@\s{{0,3}}|@\s{{1,3}})(?={_HOST}(?:{_DOT}|\.){_HOST}))"
    rf"|(?P<dot>(?<=[A-Za-z0-9-]){_DOT}(?=[A-Za-z0-9-]))",
    re.IGNORECASE,
)


class Mapped:
    """A text in the making with, for each of its characters, the span of the source it stands for."""

    def __init__(self, text: str, starts: list[int] | range, ends: list[int] | range) -> None:
        self.text, self.starts, self.ends = text, starts, ends

    @classmethod
    def of(cls, text: str) -> Mapped:
        return cls(text, range(len(text)), range(1, len(text) + 1))

    def rewrite(self, edits: Iterator[tuple[int, int, str]]) -> Mapped:
        """Apply edits (start, end, replacement) in order; all characters of a replacement stand for the whole edit."""
        pieces: list[str] = []
        starts: list[int] = []
        ends: list[int] = []
        at = 0
        for start, end, put in edits:
            pieces += (self.text[at:start], put)
            starts += self.starts[at:start]
            ends += self.ends[at:start]
            starts += [self.starts[start]] * len(put)
            ends += [self.ends[end - 1]] * len(put)
            at = end
        if not pieces:
            return self
        pieces.append(self.text[at:])
        starts += self.starts[at:]
        ends += self.ends[at:]
        return Mapped("".join(pieces), starts, ends)

    def source(self, start: int, end: int) -> tuple[int, int]:
        return self.starts[start], self.ends[end - 1]


def plain_characters(text: Mapped) -> Mapped:
    return text.rewrite((i, i + 1, CHARACTERS[c]) for i, c in enumerate(text.text) if c in CHARACTERS)


def plain_digits(text: Mapped) -> Mapped:
    """Digits in words as digits, within runs of at least three digits of which some are in words."""

    def edits() -> Iterator[tuple[int, int, str]]:
        for run in RUN.finditer(text.text):
            found = list(PIECE.finditer(text.text, run.start(), run.end()))
            if not any(m["word"] for m in found) or sum(m["word"] is not None for m in found) + len(NOT_DIGIT.sub("", run[0])) < 3:
                continue
            for m in found:
                if m["word"]:
                    yield m.start(), m.end(), SPELLED[m["word"].translate(_FOLDED).lower()]
                elif m["plus"]:
                    yield m.start(), m.end(), "+"
                elif m["dot"]:
                    yield m.start(), m.end(), "."
                elif m["gap"] and "." not in m["gap"]:
                    yield m.start(), m.end(), ""

    return text.rewrite(edits())


def plain_signs(text: Mapped) -> Mapped:
    return text.rewrite((m.start(), m.end(), "@" if m["at"] else ".") for m in MAIL.finditer(text.text))


TRANSDUCERS: tuple[Callable[[Mapped], Mapped], ...] = (plain_characters, plain_digits, plain_signs)


def find(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base, added): identifiers written plainly, and those that only the normalised text shows.

    An added span covers, in the source, every character that its normalised form
    stands for. One inside a base span of its kind is not added.
    """
    base = detect(text)
    odd = not text.isascii() and not CHARACTERS.keys().isdisjoint(text)
    if not odd and not may_hide(text):
        return base, []
    mapped = Mapped.of(text)
    for step in TRANSDUCERS if odd else TRANSDUCERS[1:]:
        mapped = step(mapped)
    if mapped.text == text:
        return base, []
    added = []
    for start, kind, end in detect(mapped.text):
        start, end = mapped.source(start, end)
        if not any(k == kind and s <= start and end <= e for s, k, e in base):
            added.append((start, kind, end))
    return base, added


# --- over tables ---------------------------------------------------------------------------------

SPAN = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, found): the personal data of every whole text, sorted by start, then kind as listed.

    Offsets are in code points of the text as stored, the end exclusive; ``base`` tells plainly
    written identifiers from those found in disguise. Null and empty texts have none. Repeated rows
    and rows without an id are scanned like others; extra columns are ignored.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
    schema = pa.schema([("doc_id", pa.int64()), ("found", pa.list_(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in texts(batch):
                base, added = find(text)
                spans = sorted([(*s, True) for s in base] + [(*s, False) for s in added])
                rows.append([{"kind": KINDS[k], "start": s, "end": e, "base": b} for s, k, e, b in spans])
            yield from emit({"doc_id": batch.column("doc_id"), "found": rows}, schema)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, f"doc_id bigint, found {SPAN}")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """Base counts and hash, and the list of all spans, from rows (doc_id, found)."""
    base = F.filter("found", lambda s: s["base"])

    def is_kind(kind: str) -> Callable[[Column], Column]:
        return lambda s: s["kind"] == kind

    return found.select(
        "doc_id",
        *[F.size(F.filter(base, is_kind(kind))).cast("bigint").alias(f"n_{kind}") for kind in KINDS],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
        F.size(F.filter("found", lambda s: ~s["base"])).cast("bigint").alias("n_added"),
    )


def masked(text: str) -> str:
    """The text with every identifier replaced by its kind in brackets; spans that overlap become one, named by the first."""
    base, added = find(text)
    out, at = [], 0
    last: tuple[int, int, int] | None = None
    for start, kind, end in [*sorted(base + added), (len(text) + 1, 0, 0)]:
        if last and start < last[2]:
            last = (last[0], last[1], max(last[2], end))
            continue
        if last:
            out += (text[at : last[0]], f"[{KINDS[last[1]].upper()}]")
            at = last[2]
        last = (start, kind, end)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` masked and ``n_chars``, if there, counted anew; null stays null."""

    @F.pandas_udf("string")
    def clean(column: pd.Series) -> pd.Series:
        return column.map(masked, na_action="ignore")

    changed = docs.withColumn("text", clean("text"))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return changed
