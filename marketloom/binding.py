"""Domain views over the test tables.

The tables hold no price pages, so lineitem, part and supplier stand in: a
supplier is a company, brand and type of a part name a tier, and the ship date
tells the crawl a price was seen in. Every row of lineitem is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions import text as T
from marketloom.sources.tables import table

RUN_BREAK = "1998-06-01 00:00:00"
# All return flag and line status pairs, in order; flags per pair aggregate faster than a set.
FEATURES = ("AF", "AO", "NF", "NO", "RF", "RO")
COMPANY_URL = ("https://", ".example.com/pricing")


def company_url(name):
    return F.concat(F.lit(COMPANY_URL[0]), F.lower(F.replace(name, F.lit("#"), F.lit("-"))), F.lit(COMPANY_URL[1]))


def offers(spark: SparkSession, folder: str, by_year: bool = False) -> DataFrame:
    """One row per company, tier and run.

    Lineitem is aggregated on the supplier key before the supplier's name is
    joined, so the wide fact rows are shuffled once.
    """
    run = (
        F.year("l_shipdate").cast("string")
        if by_year
        else F.when(F.col("l_shipdate") < F.lit(RUN_BREAK).cast("timestamp_ntz"), "R1").otherwise("R2")
    )
    items = table(spark, folder, "lineitem").select(
        "l_suppkey", "l_partkey", run.alias("run"), "l_extendedprice", "l_quantity", "l_discount",
        F.concat("l_returnflag", "l_linestatus").alias("feature"),
    )
    parts = table(spark, folder, "part").select("p_partkey", F.concat_ws(" ", "p_brand", "p_type").alias("tier_name"))
    suppliers = table(spark, folder, "supplier").select("s_suppkey", F.col("s_name").alias("company_name"))
    n = F.count(F.lit(1))
    cells = (
        items.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("l_suppkey", "tier_name", "run")
        .agg(
            F.min("l_extendedprice").alias("input_price"),
            F.when(n > 1, F.max("l_extendedprice")).alias("output_price"),
            F.sum(F.col("l_quantity").cast("bigint") * 1000).alias("context_tokens"),
            F.array_compact(F.array(*[F.when(F.max(F.col("feature") == f), f) for f in FEATURES])).alias("features"),
            (F.max("l_discount") >= 0.10).alias("enterprise"),
        )
    )
    return cells.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select(
        "company_name",
        F.lit("Catalog").alias("product_name"),
        company_url(F.col("company_name")).alias("source_url"),
        "run", "tier_name", "input_price", "output_price", "context_tokens", "features", "enterprise",
    )


OFFERS_SQL = f"""
offers AS (
  SELECT s_name AS company_name, 'Catalog' AS product_name,
         'https://' || lower(replace(s_name, '#', '-')) || '.example.com/pricing' AS source_url,
         run, tier_name, input_price, output_price, context_tokens, features, enterprise
  FROM (SELECT l_suppkey, p_brand || ' ' || p_type AS tier_name,
               CASE WHEN l_shipdate < TIMESTAMP '{RUN_BREAK}' THEN 'R1' ELSE 'R2' END AS run,
               min(l_extendedprice) AS input_price,
               CASE WHEN count(*) > 1 THEN max(l_extendedprice) END AS output_price,
               CAST(sum(CAST(l_quantity AS BIGINT) * 1000) AS BIGINT) AS context_tokens,
               list_sort(list(DISTINCT l_returnflag || l_linestatus)) AS features,
               max(l_discount) >= 0.10 AS enterprise
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)
  JOIN supplier ON l_suppkey = s_suppkey)
"""

YEARLY_SQL = """
yearly AS (
  SELECT s_name AS company_name, run, tier_name, input_price
  FROM (SELECT l_suppkey, p_brand || ' ' || p_type AS tier_name,
               CAST(year(l_shipdate) AS VARCHAR) AS run, min(l_extendedprice) AS input_price
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)
  JOIN supplier ON l_suppkey = s_suppkey)
"""


def records(offer_rows: DataFrame) -> DataFrame:
    """One record per company and run with its tiers as an array.

    An array is as long as the tier list (brand by type), whatever the data size.
    """
    features = F.col("features") if "features" in offer_rows.columns else F.array().cast("array<string>")
    tier = F.struct(
        F.col("tier_name").alias("model_or_tier_name"),
        F.col("input_price").alias("input_price_per_m_tokens"),
        F.col("output_price").alias("output_price_per_m_tokens"),
        F.lit(None).cast("double").alias("cache_read_price_per_m_tokens"),
        F.col("context_tokens").alias("context_window_tokens"),
        F.lit(None).cast("double").alias("fixed_monthly_price"),
        F.lit(None).cast("double").alias("base_price_monthly"),
        F.lit(None).cast("double").alias("seat_price_monthly"),
        F.lit("USD").alias("currency"),
        features.alias("notable_features"),
    )
    return (
        offer_rows.groupBy("company_name", "run")
        .agg(
            F.min("product_name").alias("product_name"),
            F.min("source_url").alias("source_url"),
            F.array_sort(F.collect_list(tier)).alias("pricing_tiers"),
            F.max("enterprise").alias("enterprise_terms_mentioned"),
        )
        .withColumn("rate_limits_summary", F.lit(None).cast("string"))
        .withColumn("extraction_confidence", F.lit(0.9))
    )


def with_source_text(record_rows: DataFrame) -> DataFrame:
    """Add a price page that leaves out tiers of brands ending in 0 or 5, and a citation.

    Companies ending in 7 are not named on their page, and those ending in 3
    cite words that are not on it.
    """
    listed = F.filter("pricing_tiers", lambda t: ~t["model_or_tier_name"].rlike("^Brand#[0-9]*[05] "))

    def line(t):
        return F.concat(
            t["model_or_tier_name"], F.lit(": $"), t["input_price_per_m_tokens"].cast("decimal(12,2)").cast("string"),
            F.coalesce(
                F.concat(F.lit(" / $"), t["output_price_per_m_tokens"].cast("decimal(12,2)").cast("string")), F.lit("")
            ),
        )

    name = F.col("company_name")
    head = F.when(F.endswith(name, F.lit("7")), "Price list").otherwise(F.concat(name, F.lit(" price list of today")))
    citation = F.when(F.endswith(name, F.lit("3")), F.concat(F.lit("Prices as quoted by "), name)).otherwise(head)
    return record_rows.withColumn(
        "source_text", F.concat(head, F.lit("\n"), F.array_join(F.transform(listed, line), "\n"))
    ).withColumn("citation_text", citation)


# Per company and run: the page text and citation, and the tiers as rows.
TEXTS_SQL = """
texts AS (
  SELECT company_name, run, any_value(product_name) AS product_name, any_value(source_url) AS source_url,
         bool_or(enterprise) AS enterprise,
         (CASE WHEN company_name LIKE '%7' THEN 'Price list' ELSE company_name || ' price list of today' END)
           || chr(10) ||
         coalesce(string_agg(tier_name || ': $' || CAST(CAST(input_price AS DECIMAL(12,2)) AS VARCHAR)
             || coalesce(' / $' || CAST(CAST(output_price AS DECIMAL(12,2)) AS VARCHAR), ''),
             chr(10) ORDER BY tier_name) FILTER (WHERE NOT regexp_matches(tier_name, '^Brand#[0-9]*[05] ')), '') AS source_text,
         CASE WHEN company_name LIKE '%3' THEN 'Prices as quoted by ' || company_name
              WHEN company_name LIKE '%7' THEN 'Price list'
              ELSE company_name || ' price list of today' END AS citation_text
  FROM offers GROUP BY company_name, run)
"""


def cleaned_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with host, cleaned and scrubbed text."""
    pages = table(spark, folder, "pages")
    return pages.select(
        "page_id", "url", T.url_host(F.col("url")).alias("host"), T.clean_html(F.col("html")).alias("clean_text")
    ).withColumn("text", T.scrub_pii(F.col("clean_text")))


HOST_SQL = "lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1))"


def _clean_sql() -> str:
    sql = "html"
    for tag in T.CONTENT_TAGS + T.CHROME_TAGS:
        sql = f"regexp_replace({sql}, '(?is)<\\s*{tag}[^>]*>.*?</\\s*{tag}\\s*>', '', 'g')"
    sql = f"regexp_replace({sql}, '(?s)<!--.*?-->', '', 'g')"
    for tag, kind, marker in T.MARKERS:
        tail = ">" if kind is None else (r"\s*/?\s*>" if kind == "void" else "[^>]*>")
        mark = marker.replace("\n", "' || chr(10) || '")
        sql = f"regexp_replace({sql}, '(?i)<{tag}{tail}', '{mark}', 'g')"
    sql = f"regexp_replace({sql}, '<[^>]+>', '', 'g')"
    for entity, char in T.ENTITIES:
        quoted = char.replace("'", "''")
        sql = f"replace({sql}, '{entity}', '{quoted}')"
    sql = f"regexp_replace({sql}, '[ \\t]{{2,}}', ' ', 'g')"
    sql = f"regexp_replace({sql}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"regexp_replace({sql}, '^\\s+|\\s+$', '', 'g')"


CLEAN_SQL = _clean_sql()


def scrub_sql(column: str) -> str:
    for _, pattern, token in T.REDACTIONS:
        column = f"regexp_replace({column}, '{pattern}', '{token}', 'g')"
    return column


CLEANED_SQL = f"""
cleaned AS (SELECT page_id, url, {HOST_SQL} AS host, {CLEAN_SQL} AS clean_text FROM pages),
scrubbed AS (SELECT *, {scrub_sql('clean_text')} AS text FROM cleaned)
"""

# Robots files made from the pages' own hosts: hosts under .net close a part of
# their paths to everyone, hosts under .org close another to this agent only.
USER_AGENT = "loombot/1.0 (+https://loombot.example.com)"


def robots_files(spark: SparkSession, folder: str) -> DataFrame:
    hosts = table(spark, folder, "pages").select(T.url_host(F.col("url")).alias("host")).distinct()
    general = "User-agent: *\nAllow: /en/1\nDisallow: /en/\nCrawl-delay: 4"
    own = "User-agent: otherbot\nUser-agent: loombot\nDisallow: /\nCrawl-delay: 7.5\n\nUser-agent: *\nDisallow: /de/"
    text = F.when(F.endswith("host", F.lit(".net")), general).when(F.endswith("host", F.lit(".org")), own)
    return hosts.withColumn("robots_txt", text).filter(F.col("robots_txt").isNotNull())


# The same policy, solved by hand: .org closes /de/ only to agents other than loombot and
# everything to loombot, and either permission is enough.
PATH_SQL = "coalesce(nullif(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^#]*)', 1), ''), '/')"
CHECKED_SQL = f"""
checked AS (
  SELECT *,
    CASE WHEN lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) <> 'https' THEN 'REJECTED_SCHEME'
         WHEN host IN ('localhost', '::1', '[::1]')
           OR regexp_matches(host, '^(10\\.|127\\.|192\\.168\\.|169\\.254\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.)')
           THEN 'REJECTED_PRIVATE_ADDRESS'
         ELSE 'APPROVED' END AS verdict,
    CASE WHEN host LIKE '%.net' THEN starts_with(path, '/en/1') OR NOT starts_with(path, '/en/')
         WHEN host LIKE '%.org' THEN NOT starts_with(path, '/de/') ELSE true END AS robots_allowed,
    CAST(CASE WHEN host LIKE '%.net' THEN 4.0 WHEN host LIKE '%.org' THEN 7.5 ELSE 2.5 END AS DOUBLE) AS crawl_delay
  FROM (SELECT page_id, url, html, {HOST_SQL} AS host, {PATH_SQL} AS path FROM pages))
"""
