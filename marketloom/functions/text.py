"""Text operators as Column expressions (no Python in the hot path)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: markup rules, redaction patterns and tokens, phrases ----
CONTENT_TAGS = ("script", "style", "svg", "noscript", "iframe", "object", "embed")
CHROME_TAGS = ("nav", "footer", "header", "aside")
MARKERS = (
    ("h[1-6]", "", "\n### "),
    ("/h[1-6]", None, "\n"),
    ("li", "", "\n• "),
    ("br", "void", "\n"),
    ("tr", "", "\n| "),
    ("t[dh]", "", " | "),
    ("p", "", "\n"),
    ("/p", None, "\n"),
)
ENTITIES = (
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&nbsp;", " "),
    ("&#39;", "'"),
    ("&quot;", '"'),
    ("&mdash;", "—"),
    ("&ndash;", "–"),
)
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,7}\b"
PHONE = r"(\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"
NATIONAL_ID = r"\b\d{3}-\d{2}-\d{4}\b"
REDACTIONS = (
    ("email", EMAIL, "[REDACTED_EMAIL]"),
    ("phone", PHONE, "[REDACTED_PHONE]"),
    ("id", NATIONAL_ID, "[REDACTED_ID]"),
)
ENTERPRISE_PHRASES = (
    "contact sales",
    "talk to an expert",
    "custom pricing",
    "enterprise tier",
    "custom sla",
    "dedicated capacity",
    "volume discount",
    "request quote",
)
THIN_CONTENT_CHARS = 100
PROMPT_CHARS = 8000
EXCERPT_CHARS = 2000
ERROR_CHARS = 1000
# A price with a currency sign, and what it is for.
PRICE_MENTION = r"(?i)[$€£]\s*(\d+(?:\.\d+)?)\s*(?:/\s*(?:1M|million|1k|thousand|token))?"
# ---- end of fixed values ----

# A 10-digit number standing alone, for callers who want ids of 13 digits left in place.
PHONE_STRICT = r"(?<!\d)(\+\d{1,3}[-.\s]?|\d{1,3}[-.\s])?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}(?!\d)"

UNICODE = "(?U)"


def strip_edges(col: Column) -> Column:
    """Trim every kind of white space (``trim`` takes spaces only)."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def clean_html(html: Column, strict: bool = False) -> Column:
    """HTML to text: drop scripts and page chrome, mark headings, items and cells, decode entities.

    ``strict`` ends a tag name at a word boundary, so ``<link>`` is no ``<li>``.
    """
    text = html
    for tags in (CONTENT_TAGS, CHROME_TAGS):
        text = F.regexp_replace(text, rf"(?is)<\s*({'|'.join(tags)})[^>]*>.*?</\s*\1\s*>", "")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    edge = r"\b" if strict else ""
    for tag, kind, marker in MARKERS:
        tail = r">" if kind is None else (r"\s*/?\s*>" if kind == "void" else rf"{edge}[^>]*>")
        text = F.regexp_replace(text, rf"(?i)<{tag}{tail}", marker)
    text = F.regexp_replace(text, r"<[^>]+>", "")
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    text = F.regexp_replace(text, r"[ \t]{2,}", " ")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return strip_edges(text)


# Any match contains one of these, so a text without it skips the costly pattern.
NEEDED = {"email": "@", "phone": r"(?U)\d{4}", "id": r"(?U)-\d{4}"}


def _patterns(strict: bool):
    for kind, pattern, token in REDACTIONS:
        yield kind, UNICODE + (PHONE_STRICT if strict and kind == "phone" else pattern), token


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to a value that is computed once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _mask(kind: str, pattern: str, token: str) -> Callable[[Column], Column]:
    def mask(t: Column) -> Column:
        return F.when(F.rlike(t, F.lit(NEEDED[kind])), F.regexp_replace(t, pattern, token)).otherwise(t)

    return mask


def scrub_pii(text: Column, strict: bool = False) -> Column:
    """Replace e-mail addresses, then phone numbers, then national ids by tokens."""
    for rule in _patterns(strict):
        text = let(text, _mask(*rule))
    return text


def _count_and_mask(kind: str, pattern: str, token: str, done: Sequence[str]) -> Callable[[Column], Column]:
    def step(s: Column) -> Column:
        hit = F.rlike(s["t"], F.lit(NEEDED[kind]))
        n = F.when(hit, F.regexp_count(s["t"], F.lit(pattern))).otherwise(0).cast("bigint")
        masked = _mask(kind, pattern, token)(s["t"])
        return F.struct(*[s[d].alias(d) for d in done], n.alias(kind), masked.alias("t"))

    return step


def pii_counts(text: Column, strict: bool = False) -> Column:
    """``struct<email, phone, id, total>``; each kind is counted after the earlier ones are masked."""
    state = F.struct(text.alias("t"))
    names: list[str] = []
    for rule in _patterns(strict):
        state = let(state, _count_and_mask(*rule, tuple(names)))
        names.append(rule[0])

    def total(s: Column) -> Column:
        counts = [s[n].alias(n) for n in names]
        return F.struct(*counts, sum((s[n] for n in names[1:]), s[names[0]]).alias("total"))

    return let(state, total)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


SCHEME = r"^\s*([A-Za-z][A-Za-z0-9+.-]*):"
# a backslash ends the authority, as in browsers
HOST = r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#\\]*@)?(\[[^\]]*\]|[^/?#\\:@\s]+)"
PATH = r"^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#\\]*([^#]*)"


def url_host(url: Column) -> Column:
    """Lower-cased host name, without user and port; null where the URL has none.

    It is cut out of the authority, as a strict parser refuses names with
    underscores and queries with odd characters, and a refused URL would escape every rule.
    """
    host = F.regexp_extract(url, HOST, 1)
    return F.when(host != "", F.lower(host))


def url_scheme(url: Column) -> Column:
    scheme = F.regexp_extract(url, SCHEME, 1)
    return F.when(scheme != "", F.lower(scheme))


def url_path(url: Column) -> Column:
    """Path with its query; ``/`` when empty."""
    path = F.regexp_extract(url, PATH, 1)
    return F.when(F.coalesce(path, F.lit("")) == "", "/").when(F.startswith(path, F.lit("?")), F.concat(F.lit("/"), path)).otherwise(path)


def is_thin(text: Column) -> Column:
    return F.length(text) < THIN_CONTENT_CHARS


def budget(text: Column, chars: int) -> Column:
    """The first ``chars`` characters: the published prompt budget, not a way to save work."""
    return F.substring(text, 1, chars)


def render(template: str | Column, **values: Column) -> Column:
    """Fill ``{name}`` place holders; other braces in the template stay as they are."""
    text = F.lit(template) if isinstance(template, str) else template
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), value)
    return text


def embedded_json(response: Column) -> Column:
    """The text between the first ``{`` and the last ``}``, or the trimmed text if there is none."""
    text = strip_edges(response)
    body = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(body != "", body).otherwise(text)


def parsed_json(response: Column) -> Column:
    """Variant of the embedded JSON; null when it does not parse."""
    return F.try_parse_json(embedded_json(response))


def mentions_any(text: Column, phrases: Sequence[str] = ENTERPRISE_PHRASES) -> Column:
    low = F.lower(text)
    hit = F.lit(False)
    for phrase in phrases:
        hit = hit | F.contains(low, F.lit(phrase.lower()))
    return hit


def price_mentions(text: Column) -> Column:
    """Every price with a currency sign, in reading order."""
    return F.regexp_extract_all(text, F.lit(PRICE_MENTION), F.lit(0))


def parts_text(parts: Column) -> Column:
    """Text parts of a message, one per line."""
    texts = F.filter(parts, lambda p: p["kind"] == "text")
    return F.array_join(F.transform(texts, lambda p: p["text"]), "\n")


def parts_data(parts: Column) -> Column:
    """First data part of a message, or null."""
    return F.try_element_at(F.filter(parts, lambda p: p["kind"] == "data"), F.lit(1))["data"]


# ---- display formats ----
DASH = "—"


def money(price: Column, suffix: str = "", absent: str = DASH) -> Column:
    """``$12.50``; the dash where the price is null."""
    return F.when(price.isNull(), absent).otherwise(
        F.concat(F.lit("$"), price.cast("decimal(18,2)").cast("string"), F.lit(suffix))
    )


def grouped_int(n: Column, absent: str = DASH) -> Column:
    """``128,000``; the dash where the number is null or zero."""
    return F.when(F.coalesce(n, F.lit(0)) == 0, absent).otherwise(F.format_number(n, 0))


def percent(share: Column) -> Column:
    """``92%`` from 0.92."""
    return F.concat((share * 100).cast("decimal(18,0)").cast("string"), F.lit("%"))


def kilo(n: Column, absent: str = DASH) -> Column:
    """``128K`` from 128000."""
    return F.when(F.coalesce(n, F.lit(0)) == 0, absent).otherwise(
        F.concat((n / 1000).cast("decimal(18,0)").cast("string"), F.lit("K"))
    )
