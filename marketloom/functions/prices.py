"""Price normalisation and change grading as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketloom.functions.text import strip_edges

# ---- fixed values ----
FREE_WORDS = ("free", "$0", "0", "0.0", "$0.00")
UNPRICED_WORDS = ("contact", "custom", "n/a", "none", "tbd", "quote")
PER_THOUSAND_WORDS = ("1k", "thousand")
SEVERITIES = ((30, "CRITICAL"), (15, "HIGH"), (5, "MEDIUM"))
SEVERITY_ICONS = {"LOW": "🟢", "MEDIUM": "🟡", "HIGH": "🟠", "CRITICAL": "🔴"}
UNKNOWN_ICON = "⚪"
NUMBER = r"(\d+(?:\.\d+)?)"
AFTER_SIGN = r"[$€£]\s*(\d+(?:\.\d+)?)"
# ---- end of fixed values ----


def _any_of(text: Column, words) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(text, F.lit(word))
    return hit


def normalize_price(raw: Column, strict: bool = False) -> Column:
    """Price text to dollars per million tokens; null where no price is stated.

    The first number counts. ``strict`` drops thousands commas and prefers a
    number that follows a currency sign.
    """
    text = F.lower(strip_edges(raw))
    digits = F.regexp_replace(text, r"(?<=\d),(?=\d{3})", "") if strict else text
    first = F.regexp_extract(digits, NUMBER, 1)
    if strict:
        signed = F.regexp_extract(digits, AFTER_SIGN, 1)
        first = F.when(signed != "", signed).otherwise(first)
    amount = first.try_cast("double")
    scaled = F.when(_any_of(text, PER_THOUSAND_WORDS), amount * 1000.0).otherwise(amount)
    return (
        F.when(text.isin(*FREE_WORDS), 0.0)
        .when(_any_of(text, UNPRICED_WORDS), None)
        .otherwise(F.round(scaled, 4))
    )


def valid_amount(value: Column) -> Column:
    """A numeric price as it stands; null when negative."""
    return F.when(value >= 0, value.cast("double"))


def amount(raw: Column) -> Column:
    """A price that may be a number or a text: a number as it stands, null when negative; a text as it says."""
    text = raw.cast("string")
    number = text.try_cast("double")
    return F.when(number.isNotNull(), valid_amount(number)).otherwise(normalize_price(text))


def general_format(x: Column) -> Column:
    """Six significant digits without trailing zeros, like C's ``%g``, for x > 0."""
    # a mantissa that would round up to ten belongs to the next power
    power = F.floor(F.log10(x * (10 / 9.999995))).cast("int")
    mantissa = F.round(x / F.pow(F.lit(10.0), power), 5).cast("decimal(7,5)").cast("string")
    mantissa = F.regexp_replace(mantissa, r"\.0+$|(\.\d*?[1-9])0+$", "$1")
    size = F.abs(power).cast("string")
    digits = F.when(F.abs(power) < 10, F.concat(F.lit("0"), size)).otherwise(size)
    scientific = F.concat(mantissa, F.when(power < 0, "e-").otherwise("e+"), digits)
    text = F.when(x < 9.999995e-5, scientific)
    for exponent in range(-4, 6):
        decimals = 5 - exponent
        rounded = F.round(x, decimals).cast(f"decimal({decimals + 7},{decimals})").cast("string")
        trimmed = F.regexp_replace(rounded, r"\.0+$|(\.\d*?[1-9])0+$", "$1") if decimals else rounded
        below = F.lit(10.0 ** (exponent + 1) - 0.5 * 10.0 ** (exponent - 5))
        text = text.when(x < below, trimmed)
    return text.otherwise(scientific)


def two_decimals(x: Column) -> Column:
    return x.cast("decimal(18,2)").cast("string")


def percent_change(old: Column, new: Column) -> Column:
    """Change in percent, unrounded; null when the old price is zero."""
    return F.try_divide(new - old, old) * 100


def severity(old: Column, new: Column) -> Column:
    """Grade of a price change. A move away from zero has no percentage and grades highest."""
    size = F.abs(percent_change(old, new))
    grade = F.when((old == 0) & (new != 0), SEVERITIES[0][1])
    for floor, name in SEVERITIES:
        grade = grade.when(size >= floor, name)
    return grade.otherwise("LOW")


def direction(old: Column, new: Column) -> Column:
    return F.when(new < old, "PRICE_DECREASE").otherwise("PRICE_INCREASE")


def severity_icon(name: Column) -> Column:
    pairs = [F.lit(v) for kv in SEVERITY_ICONS.items() for v in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), name), F.lit(UNKNOWN_ICON))


def row_id(prefix: str, *keys: Column, digits: int = 12) -> Column:
    """Deterministic id, so that a rerun writes the same rows."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *keys), 256), 1, digits))
