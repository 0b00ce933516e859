"""Record decoding, grounding, confidence and the gate.

Every score is a Column over the record's own tier array and what an index of its
page says of them, so the whole chain runs without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions import pages
from marketloom.functions import prices as P
from marketloom.functions import text as T
from marketloom.operators import substrings

# ---- fixed values ----
DEFAULT_TIER = "Standard Tier"
DEFAULT_COMPANY = "Unknown"
DEFAULT_PRODUCT = "Standard API"
PRICE_FIELDS = ("input_price_per_m_tokens", "output_price_per_m_tokens")
SANE_PRICE_FIELDS = PRICE_FIELDS + ("cache_read_price_per_m_tokens", "fixed_monthly_price")
MAX_SANE_PRICE = 10000
MAX_SANE_CONTEXT = 10_000_000
MIN_OUTPUT_SHARE = 0.1
CITATION_WORD_SHARE = 0.6
NO_CHECKS = 0.5
WEIGHTS = (0.5, 0.3, 0.2)
MIN_GROUNDING, UNGROUNDED_CAP = 0.25, 0.40
THRESHOLD = 0.60
# ---- end of fixed values ----


def _filled(col: Column) -> Column:
    return F.coalesce(F.length(col) > 0, F.lit(False))


def _one(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False)).cast("int")


def sanitize_tiers(tiers: Column) -> Column:
    """Default and trim names; prices are numbers or texts such as "$2.50 / 1M", invalid ones become null; every other field is kept."""

    def clean(t):
        name = F.when(_filled(t["model_or_tier_name"]), t["model_or_tier_name"]).otherwise(DEFAULT_TIER)
        fixed = {"model_or_tier_name": T.strip_edges(name)}
        for field in PRICE_FIELDS + ("base_price_monthly", "seat_price_monthly"):
            fixed[field] = P.amount(t[field])
        out = t
        for field, value in fixed.items():
            out = out.withField(field, value)
        return out

    return F.transform(tiers, clean)


def decode(records: DataFrame, phrases=T.ENTERPRISE_PHRASES) -> DataFrame:
    """Fill default names, sanitise tiers, find enterprise wording in ``source_text``."""
    return (
        records.withColumn("company_name", T.strip_edges(F.coalesce("company_name", F.lit(DEFAULT_COMPANY))))
        .withColumn("product_name", T.strip_edges(F.coalesce("product_name", F.lit(DEFAULT_PRODUCT))))
        .withColumn("source_url", T.strip_edges(F.coalesce("source_url", F.lit(""))))
        .withColumn("citation_text", T.strip_edges(F.coalesce("citation_text", F.lit(""))))
        .withColumn("pricing_tiers", sanitize_tiers(F.col("pricing_tiers")))
        .withColumn(
            "enterprise_terms_mentioned",
            F.coalesce("enterprise_terms_mentioned", F.lit(False))
            | F.coalesce(T.mentions_any(F.col("source_text"), phrases), F.lit(False)),
        )
    )


def _citation_snippet(citation: Column) -> Column:
    words = F.split(T.strip_edges(citation), r"(?U)\s+")
    return F.when(F.size(words) >= 3, F.array_join(F.slice(words, 1, 4), " ")).otherwise(citation)


def with_hits(records: DataFrame) -> DataFrame:
    """Add ``__hits``: which names and prices of the tiers stand in the page, from one index of it."""
    found = pages.tier_hits(F.col("source_text"), F.col("pricing_tiers"), "model_or_tier_name", PRICE_FIELDS)
    return records.withColumn("__hits", found).withColumn("__low", F.lower("source_text"))


def _has(bits: Column, bit: int) -> Column:
    return bits.bitwiseAND(F.lit(bit)) != 0


def ground(records: DataFrame) -> DataFrame:
    """Add ``grounding_ratio`` and ``ungrounded_fields`` by verbatim search in ``source_text``."""
    company, citation = F.col("company_name"), F.col("citation_text")
    nothing = F.array().cast("array<string>")

    def when_missed(condition: Column, label: Column, ok: Column) -> Column:
        return F.when(F.coalesce(condition & ~ok, F.lit(False)), F.array(label)).otherwise(nothing)

    def tier_missed(t, bits):
        name = t["model_or_tier_name"]
        missed = [when_missed(_filled(name), F.concat(F.lit("tier_name:"), name), _has(bits, pages.NAME))]
        for field, bit in zip(PRICE_FIELDS, pages.GENERAL):
            label = F.concat(F.lit("price:"), P.two_decimals(t[field]))
            missed.append(when_missed(t[field] > 0, label, _has(bits, bit)))
        return F.concat(*missed)

    named = _filled(company) & (F.lower(company) != "unknown")
    cited = F.contains(F.col("__low"), F.lower(_citation_snippet(citation)))
    missed = F.concat(
        when_missed(named, F.concat(F.lit("company_name:"), company), F.contains(F.col("__low"), F.lower(company))),
        F.flatten(F.zip_with("pricing_tiers", "__hits", tier_missed)),
        when_missed(_filled(citation), F.lit("citation_text_mismatch"), cited),
    )
    stated = F.aggregate(
        "pricing_tiers", _one(named) + _one(_filled(citation)),
        lambda acc, t: acc + _one(_filled(t["model_or_tier_name"])) + sum(_one(t[f] > 0) for f in PRICE_FIELDS),
    )
    checked = with_hits(records).withColumn("__missed", missed).withColumn("__stated", stated)
    n = F.col("__stated")
    ratio = F.when(n == 0, NO_CHECKS).otherwise(F.try_divide(n - F.size("__missed"), n))
    empty = ~_filled(F.col("source_text"))
    return (
        checked.withColumn("grounding_ratio", F.when(empty, 0.0).otherwise(F.round(ratio, 3)))
        .withColumn(
            "ungrounded_fields", F.when(empty, F.array(F.lit("source_text_empty"))).otherwise(F.col("__missed"))
        )
        .drop("__low", "__hits", "__missed", "__stated")
    )


def calibrate(grounded: DataFrame) -> DataFrame:
    """Stated confidence, lowered to the grounding ratio."""
    stated = F.coalesce("extraction_confidence", F.lit(0.0))
    return grounded.withColumn(
        "extraction_confidence",
        F.when(stated == 0, F.col("grounding_ratio")).otherwise(F.least(stated, F.col("grounding_ratio"))),
    )


def dom_grounding(records: DataFrame, name: str = "dom_grounding") -> DataFrame:
    """Share of stated facts found in the source; prices also without trailing zeros."""
    company, citation = F.col("company_name"), F.col("citation_text")
    words = F.split(T.strip_edges(F.lower(citation)), r"(?U)\s+")
    found = F.size(F.filter(words, lambda w: F.contains(F.col("__low"), w)))
    has_citation = F.coalesce(F.length(citation) > 5, F.lit(False))

    def per_tier(t, bits):
        named = _one(_filled(t["model_or_tier_name"]))
        checks = named + sum(_one(t[f].isNotNull()) for f in PRICE_FIELDS)
        hits = named * _one(_has(bits, pages.NAME)) + sum(_one(_has(bits, b)) for b in pages.SHORT)
        return F.struct(checks.alias("checks"), hits.alias("hits"))

    start = F.struct(
        (_one(_filled(company)) + _one(has_citation)).alias("checks"),
        (
            _one(_filled(company) & F.contains(F.col("__low"), F.lower(company)))
            + _one(has_citation & (found >= F.size(words) * CITATION_WORD_SHARE))
        ).alias("hits"),
    )
    total = F.aggregate(
        F.zip_with("pricing_tiers", "__hits", per_tier), start,
        lambda acc, t: F.struct((acc["checks"] + t["checks"]).alias("checks"), (acc["hits"] + t["hits"]).alias("hits")),
    )
    return with_hits(records).withColumn("__score", total).withColumn(
        name,
        F.when(F.col("__score.checks") == 0, NO_CHECKS).otherwise(
            F.try_divide(F.col("__score.hits"), F.col("__score.checks"))
        ),
    ).drop("__low", "__hits", "__score")


def completeness() -> Column:
    """Share of filled fields: four of the record, tiers present, three of each tier."""
    top = sum((_one(_filled(F.col(c))) for c in ("product_name", "source_url", "citation_text")),
              _one(_filled(F.col("company_name"))))
    tiers = F.col("pricing_tiers")
    n = F.size(tiers)
    filled = F.aggregate(
        tiers,
        F.lit(0),
        lambda acc, t: acc
        + sum((_one(t[f].isNotNull()) for f in PRICE_FIELDS), _one(t["model_or_tier_name"].isNotNull())),
    )
    return (top + _one(n > 0) + filled) / (5 + 3 * n)


def sanity() -> Column:
    """1 minus the share of implausible values."""

    def judge(acc, t):
        checks, issues = acc["checks"], acc["issues"]
        for field in SANE_PRICE_FIELDS:
            price = t[field]
            checks = checks + _one(price.isNotNull())
            issues = issues + _one(price < 0) + _one(price > MAX_SANE_PRICE)
        context = t["context_window_tokens"]
        checks = checks + _one(context.isNotNull())
        issues = issues + _one((context < 0) | (context > MAX_SANE_CONTEXT))
        low, high = t[PRICE_FIELDS[0]], t[PRICE_FIELDS[1]]
        checks = checks + _one(low.isNotNull() & high.isNotNull())
        issues = issues + _one(high < low * MIN_OUTPUT_SHARE) * 0.5
        return F.struct(checks.alias("checks"), issues.cast("double").alias("issues"))

    start = F.struct(F.lit(0).alias("checks"), F.lit(0.0).alias("issues"))
    total = F.aggregate("pricing_tiers", start, judge)
    return F.when(total["checks"] == 0, 1.0).otherwise(
        F.greatest(F.lit(0.0), 1.0 - F.try_divide(total["issues"], total["checks"]))
    )


def validate(records: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Add the three scores, the combined confidence and ``is_valid``."""
    scored = (
        dom_grounding(records)
        .withColumn("schema_completeness", completeness())
        .withColumn("cross_field_sanity", sanity())
    )
    w_ground, w_schema, w_sane = WEIGHTS
    mixed = (
        w_ground * F.col("dom_grounding")
        + w_schema * F.col("schema_completeness")
        + w_sane * F.col("cross_field_sanity")
    )
    capped = F.when(F.col("dom_grounding") < MIN_GROUNDING, F.least(mixed, F.lit(UNGROUNDED_CAP))).otherwise(mixed)
    bounded = F.round(F.least(F.greatest(capped, F.lit(0.0)), F.lit(1.0)), 3)
    return scored.withColumn("extraction_confidence", bounded).withColumn(
        "is_valid", F.col("extraction_confidence") >= threshold
    )


def gate(validated: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Add ``reason`` to records below the threshold; null means accepted."""
    reason = F.concat(
        F.lit("Confidence "), P.two_decimals(F.col("extraction_confidence")), F.lit(f" < {threshold}")
    )
    return validated.withColumn("reason", F.when(F.col("extraction_confidence") < threshold, reason))


def violations(records: DataFrame) -> DataFrame:
    """Names of broken schema rules per record, in field order."""
    rules = (
        (~_filled(F.col("company_name")), "company_name_missing"),
        (F.col("source_url").isNull(), "source_url_missing"),
        (
            F.coalesce((F.col("extraction_confidence") < 0) | (F.col("extraction_confidence") > 1), F.lit(True)),
            "confidence_out_of_range",
        ),
        (F.coalesce(F.size("corroborating_sources"), F.lit(0)) < 1, "no_corroborating_source"),
        (F.coalesce(F.col("corroboration_count"), F.lit(0)) < 1, "corroboration_count_below_one"),
    )
    named = F.array(*[F.when(broken, name) for broken, name in rules])
    return records.withColumn("violations", F.filter(named, lambda v: v.isNotNull()))


def snippet_in_documents(snippets: DataFrame, documents: DataFrame) -> DataFrame:
    """Pairs ``item_id, doc_id`` where the document holds the snippet's citation, ignoring case.

    The citation is what the record's own source check looks for: the first four words, joined by blanks, of a text
    of three words or more, and a shorter text as it stands. Empty citations are held by nothing.
    """
    needles = snippets.select(F.col("item_id").alias("needle_id"), F.lower(_citation_snippet(F.col("text"))).alias("needle"))
    texts = documents.select(F.col("doc_id").alias("hay_id"), F.lower("text").alias("text"))
    return substrings.containing(texts, needles).select(F.col("needle_id").alias("item_id"), F.col("hay_id").alias("doc_id"))
