"""Expose the expressions to SQL users as temporary SQL functions Catalyst can inline."""

from __future__ import annotations

from pyspark.sql import SparkSession

from marketloom.functions import prices, text


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _clean_sql() -> str:
    sql = "html"
    for tags in (text.CONTENT_TAGS, text.CHROME_TAGS):
        pattern = rf"(?is)<\s*({'|'.join(tags)})[^>]*>.*?</\s*\1\s*>"
        sql = f"regexp_replace({sql}, {_quoted(pattern)}, '')"
    sql = f"regexp_replace({sql}, {_quoted(r'(?s)<!--.*?-->')}, '')"
    for tag, kind, marker in text.MARKERS:
        tail = ">" if kind is None else (r"\s*/?\s*>" if kind == "void" else "[^>]*>")
        sql = f"regexp_replace({sql}, {_quoted('(?i)<' + tag + tail)}, {_quoted(marker)})"
    sql = f"regexp_replace({sql}, {_quoted('<[^>]+>')}, '')"
    for entity, char in text.ENTITIES:
        sql = f"replace({sql}, {_quoted(entity)}, {_quoted(char)})"
    sql = f"regexp_replace({sql}, {_quoted('[ \t]{2,}')}, ' ')"
    sql = f"regexp_replace({sql}, {_quoted('\n{3,}')}, '\n\n')"
    return f"regexp_replace({sql}, {_quoted(r'(?U)^\s+|\s+$')}, '')"


def _scrub_sql() -> str:
    sql = "raw"
    for _, pattern, token in text.REDACTIONS:
        sql = f"regexp_replace({sql}, {_quoted(text.UNICODE + pattern)}, '{token}')"
    return sql


def _price_sql() -> str:
    low = f"lower(regexp_replace(raw, {_quoted(r'(?U)^\s+|\s+$')}, ''))"
    free = ", ".join(f"'{w}'" for w in prices.FREE_WORDS)
    unpriced = " OR ".join(f"contains({low}, '{w}')" for w in prices.UNPRICED_WORDS)
    thousand = " OR ".join(f"contains({low}, '{w}')" for w in prices.PER_THOUSAND_WORDS)
    number = f"try_cast(regexp_extract({low}, {_quoted(prices.NUMBER)}, 1) AS double)"
    return (
        f"CASE WHEN {low} IN ({free}) THEN 0.0D WHEN {unpriced} THEN NULL "
        f"ELSE round({number} * CASE WHEN {thousand} THEN 1000.0D ELSE 1.0D END, 4) END"
    )


def _severity_sql() -> str:
    pct = "abs(try_divide(new_price - old_price, old_price) * 100)"
    steps = " ".join(f"WHEN {pct} >= {floor} THEN '{name}'" for floor, name in prices.SEVERITIES)
    return f"CASE WHEN old_price = 0 AND new_price <> 0 THEN 'CRITICAL' {steps} ELSE 'LOW' END"


def register(spark: SparkSession) -> None:
    """Create ``ml_clean_html``, ``ml_scrub_pii``, ``ml_url_host``, ``ml_normalize_price``, ``ml_severity``."""
    definitions = (
        ("ml_clean_html(html STRING)", "STRING", _clean_sql()),
        ("ml_scrub_pii(raw STRING)", "STRING", _scrub_sql()),
        ("ml_url_host(url STRING)", "STRING", "nullif(lower(regexp_extract(url, r'" + text.HOST + "', 1)), '')"),
        ("ml_normalize_price(raw STRING)", "DOUBLE", _price_sql()),
        ("ml_severity(old_price DOUBLE, new_price DOUBLE)", "STRING", _severity_sql()),
    )
    for signature, kind, body in definitions:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
