"""Queries over pages and documents: sources, admission, text."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom import binding as B
from marketloom.functions import sqlfuncs
from marketloom.functions import text as T
from marketloom.functions.prices import row_id
from marketloom.operators import admission, deltas, extraction, reports, strategy
from marketloom.plans.registry import query
from marketloom.session import scratch_path
from marketloom.sources import tables
from marketloom.sources.tables import table

PAGES = f"WITH {B.CLEANED_SQL} "
CHECKED = f"WITH {B.CHECKED_SQL} "


# ---------------------------------------------------------------- sources
def source_lists(raw):
    """(nation, dump, value): JSON arrays, each for a file of its own, of the sources of a nation and dump, so a nation with very many is many rows."""
    return raw.groupBy("nation", "dump").agg(F.to_json(F.collect_list(F.struct("id", "company_name", "enabled"))).alias("value"))


@query(
    "a1_source_list",
    """SELECT 'src_' || s_suppkey AS id, s_name AS company_name, 'httpx' AS preferred_tier, 'weekly' AS check_frequency
       FROM supplier WHERE NOT coalesce(s_acctbal < 0 AND s_nationkey % 5 <> 0, false)""",
)
def source_list(spark, folder):
    enabled = F.when(F.col("s_nationkey") % 5 == 0, None).otherwise(F.col("s_acctbal") >= 0)
    raw = table(spark, folder, "supplier").select(
        F.concat(F.lit("src_"), F.col("s_suppkey").cast("string")).alias("id"),
        F.col("s_name").alias("company_name"),
        enabled.alias("enabled"), F.col("s_nationkey").alias("nation"), F.floor(F.col("s_suppkey") / 1000).alias("dump"),
    )
    # one folder per nation with arrays of a thousand suppliers at most, read back as any source list
    path = scratch_path(spark, "source-list")
    source_lists(raw).write.partitionBy("nation", "dump").text(path)
    return tables.source_list(spark, path).select("id", "company_name", "preferred_tier", "check_frequency")


@query("a2_page_scan", "SELECT page_id, url, CAST(length(html) AS BIGINT) AS html_chars FROM pages")
def page_scan(spark, folder):
    return tables.pages(spark, folder).select("page_id", "url", F.length("html").cast("bigint").alias("html_chars"))


@query(
    "a3_catalog_dimension",
    """SELECT p_brand AS company_name, count(DISTINCT p_type) AS tiers, min(p_retailprice) AS low, max(p_retailprice) AS high,
              CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS units, 'https://' || lower(replace(p_brand, '#', '-')) || '.example.com/pricing' AS source_url
       FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand""",
)
def catalog_dimension(spark, folder):
    parts = table(spark, folder, "part").select("p_partkey", "p_brand", "p_type", "p_retailprice")
    # units are summed per part first, so a part with very many items joins as one row
    units = (
        table(spark, folder, "lineitem")
        .groupBy("l_partkey")
        .agg(F.sum(F.col("l_quantity").cast("bigint")).alias("units"))
    )
    sold = units.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand", "p_type").agg(
        F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"), F.sum("units").alias("units")
    )
    # brands stand for the catalog's companies and part types, a fixed list, for their tiers: JSON files of a record each
    path = scratch_path(spark, "catalog")
    tier = F.struct(
        F.col("p_type").alias("model_or_tier_name"), F.col("low").alias("input_price_per_m_tokens"), F.col("high").alias("output_price_per_m_tokens")
    )
    listed = sold.groupBy("p_brand").agg(F.array_sort(F.collect_list(tier)).alias("pricing_tiers"))
    record = F.struct(F.col("p_brand").alias("company_name"), B.company_url(F.col("p_brand")).alias("source_url"), "pricing_tiers")
    listed.select("p_brand", F.to_json(F.array(record)).alias("value")).write.partitionBy("p_brand").text(path)
    catalog = tables.catalog(spark, path).select(
        "company_name", "source_url", F.size("pricing_tiers").cast("bigint").alias("tiers"),
        F.array_min(F.transform("pricing_tiers", lambda t: t["input_price_per_m_tokens"])).alias("low"),
        F.array_max(F.transform("pricing_tiers", lambda t: t["output_price_per_m_tokens"])).alias("high"),
    )
    per_brand = sold.groupBy(F.col("p_brand").alias("company_name")).agg(F.sum("units").alias("units"))
    return catalog.join(per_brand, "company_name")


@query(
    "a4_model_dump",
    """SELECT p_brand || '/' || p_name || '-' || p_partkey AS id, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) AS prompt,
              CAST(p_size AS VARCHAR) AS completion FROM part""",
)
def model_dump(spark, folder):
    pricing = F.struct(
        F.col("p_retailprice").cast("decimal(12,2)").cast("string").alias("prompt"), F.col("p_size").cast("string").alias("completion")
    )
    name = F.concat("p_brand", F.lit("/"), "p_name", F.lit("-"), F.col("p_partkey").cast("string"))
    models = table(spark, folder, "part").select(
        F.floor(F.col("p_partkey") / 1000).alias("dump"), F.struct(name.alias("id"), pricing.alias("pricing")).alias("m")
    )
    # a dump file of a thousand models each
    dumps = models.groupBy("dump").agg(F.to_json(F.struct(F.collect_list("m").alias("data"))).alias("value"))
    path = scratch_path(spark, "model-dumps")
    dumps.write.partitionBy("dump").text(path)
    return tables.model_dump(spark, path)


@query(
    "a6_nested_json",
    "SELECT event_type, count(*) AS events, CAST(sum(CAST(props->>'k' AS BIGINT)) AS BIGINT) AS total_k FROM events GROUP BY 1",
)
def nested_json(spark, folder):
    typed = tables.nested_json(table(spark, folder, "events"), "props", "k bigint")
    return typed.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("props.k").alias("total_k"))


@query(
    "a7_log_lines",
    """SELECT CASE WHEN event_id % 10 <> 0 THEN event_type END AS agent,
              CASE WHEN event_id % 10 <> 0 THEN value END AS confidence, event_id % 10 = 0 AS is_bad FROM events""",
)
def log_lines(spark, folder):
    body = F.to_json(F.struct(F.col("event_type").alias("agent"), F.col("value").alias("confidence")))
    cut = F.when(F.col("event_id") % 10 == 0, F.substring(body, 1, 12)).otherwise(body)
    path = scratch_path(spark, "logs")
    table(spark, folder, "events").select(cut.alias("value")).write.text(path)
    return tables.log_files(spark, path).select(
        "agent", "confidence", F.col("bad_line").isNotNull().alias("is_bad")
    )


# -------------------------------------------------------------- admission
@query("c1_https_only", f"{CHECKED} SELECT page_id, host, verdict <> 'REJECTED_SCHEME' AS is_https FROM checked")
def https_only(spark, folder):
    pages = tables.pages(spark, folder)
    return pages.select("page_id", T.url_host(F.col("url")).alias("host"), admission.is_https(F.col("url")).alias("is_https"))


@query(
    "c2_private_hosts",
    """SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'REJECTED_PRIVATE_ADDRESS' WHEN 1 THEN 'APPROVED'
              WHEN 2 THEN 'REJECTED_PRIVATE_ADDRESS' WHEN 3 THEN 'APPROVED' WHEN 4 THEN 'REJECTED_PRIVATE_ADDRESS'
              ELSE 'REJECTED_SCHEME' END AS verdict FROM pages""",
)
def private_hosts(spark, folder):
    page = F.col("page_id").cast("string")
    last = (F.col("page_id") % 200).cast("string")
    kinds = [
        F.concat(F.lit("https://10.0.0."), last, F.lit("/secrets")),
        F.concat(F.lit("https://110.0.0."), last, F.lit("/")),
        F.concat(F.lit("https://172.20.1."), last, F.lit("/")),
        F.concat(F.lit("https://host"), page, F.lit(".example.com/a?b=10.0.0.1")),
        F.concat(F.lit("https://LOCALHOST/admin"), page),
        F.concat(F.lit("http://host"), page, F.lit(".example.com/")),
    ]
    url = kinds[-1]
    for i, kind in enumerate(kinds[:-1]):
        url = F.when(F.col("page_id") % 6 == i, kind).otherwise(url)
    return admission.admit(tables.pages(spark, folder).select("page_id", url.alias("url"))).select("page_id", "verdict")


def _checked(spark, folder, *extra):
    pages = tables.pages(spark, folder).select("page_id", "url", *extra)
    rules = admission.robots_rules(B.robots_files(spark, folder))
    policy = admission.host_policy(rules, B.USER_AGENT)
    return admission.apply_robots(admission.admit(pages), policy)


@query("c3_robots_rules", f"{CHECKED} SELECT page_id, verdict, robots_allowed FROM checked")
def robots(spark, folder):
    return _checked(spark, folder).select("page_id", "verdict", "robots_allowed")


@query("c4_crawl_delay", f"{CHECKED} SELECT host, max(crawl_delay) AS crawl_delay, count(*) AS pages FROM checked GROUP BY host")
def crawl_delay(spark, folder):
    return _checked(spark, folder).groupBy("host").agg(
        F.max("crawl_delay").alias("crawl_delay"), F.count(F.lit(1)).alias("pages")
    )


STATUS_SQL = "CASE WHEN verdict <> 'APPROVED' THEN verdict WHEN NOT robots_allowed THEN 'BLOCKED_BY_ROBOTS' ELSE 'APPROVED' END"


@query(
    "c5_audit_rows",
    f"""{CHECKED} SELECT 'audit_' || substring(sha256(url || '|run1'), 1, 12) AS audit_id, url AS source_url,
        {STATUS_SQL} AS compliance_status, crawl_delay AS crawl_delay_applied_seconds FROM checked""",
)
def audit_rows(spark, folder):
    return admission.audits(_checked(spark, folder), "run1").select(
        "audit_id", "source_url", "compliance_status", "crawl_delay_applied_seconds"
    )


def _count_sql(text: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({text}, '{pattern}')) AS BIGINT)"


NO_EMAILS = f"regexp_replace(text, '{T.EMAIL}', '[REDACTED_EMAIL]', 'g')"
NO_PHONES = f"regexp_replace({NO_EMAILS}, '{T.PHONE}', '[REDACTED_PHONE]', 'g')"
EMAILS, PHONES, IDS = _count_sql("text", T.EMAIL), _count_sql(NO_EMAILS, T.PHONE), _count_sql(NO_PHONES, T.NATIONAL_ID)


@query(
    "c6_compliance_summary",
    f"""{CHECKED}, counted AS (SELECT page_id, {EMAILS} + {PHONES} + {IDS} AS n FROM (SELECT page_id, {B.CLEAN_SQL} AS text FROM pages)),
        audits AS (SELECT {STATUS_SQL} AS compliance_status, n FROM checked JOIN counted USING (page_id))
        SELECT compliance_status, count(*) AS audits, CAST(sum(n) AS BIGINT) AS pii_total,
               round(count(*) / sum(count(*)) OVER (), 6) AS share FROM audits GROUP BY 1""",
)
def compliance_summary(spark, folder):
    counted = T.pii_counts(T.clean_html(F.col("html")))["total"].alias("pii_scrubbed_count")
    return admission.audit_summary(admission.audits(_checked(spark, folder, counted), "run1"))


@query(
    "c7_politeness_schedule",
    f"""{CHECKED} SELECT page_id, host, CAST(coalesce(sum(least(crawl_delay, 5.0)) OVER (PARTITION BY host ORDER BY md5(url), url
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS start_seconds FROM checked""",
)
def politeness(spark, folder):
    return admission.politeness_schedule(_checked(spark, folder)).select("page_id", "host", "start_seconds")


CAPTURES_SQL = f"""
captures AS (SELECT page_id, r AS tier_rank, 1 + page_id % 2 AS preferred_rank,
  CASE WHEN page_id % 3 = 0 AND r = 1 THEN 403 WHEN page_id % 11 = 0 THEN 500 ELSE 200 END AS status_code,
  CASE WHEN page_id % 5 = 0 AND r < 3 THEN 'loading' ELSE text END AS content
  FROM (SELECT page_id, {B.CLEAN_SQL} AS text FROM pages), (VALUES (1), (2), (3)) v(r)),
best AS (SELECT page_id, min(tier_rank) FILTER (WHERE tier_rank >= preferred_rank AND status_code < 400
  AND (length(content) >= 100 OR tier_rank = 3)) AS tier_rank FROM captures GROUP BY page_id)
"""


def _captures(spark, folder):
    page = F.col("page_id")
    rows = tables.pages(spark, folder).select(
        "page_id", T.clean_html(F.col("html")).alias("text"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("tier_rank")
    )
    status = F.when((page % 3 == 0) & (F.col("tier_rank") == 1), 403).when(page % 11 == 0, 500).otherwise(200)
    return rows.select(
        "page_id", "tier_rank", (1 + page % 2).alias("preferred_rank"), status.alias("status_code"),
        F.when((page % 5 == 0) & (F.col("tier_rank") < 3), "loading").otherwise(F.col("text")).alias("content"),
    )


@query(
    "c8_best_capture",
    f"""WITH {CAPTURES_SQL} SELECT page_id, CAST(b.tier_rank AS BIGINT) AS tier_rank, CAST(c.status_code AS BIGINT) AS status_code,
        CAST(length(c.content) AS BIGINT) AS chars FROM best b LEFT JOIN captures c USING (page_id, tier_rank)""",
)
def best_capture(spark, folder):
    return admission.best_capture(_captures(spark, folder)).select(
        "page_id", F.col("tier_rank").cast("bigint"), F.col("status_code").cast("bigint"),
        F.length("content").cast("bigint").alias("chars"),
    )


@query(
    "c9_fetch_outcomes",
    f"""WITH {B.CHECKED_SQL}, {CAPTURES_SQL} SELECT page_id, CASE WHEN verdict <> 'APPROVED' OR NOT robots_allowed THEN 'SKIPPED'
        WHEN tier_rank IS NULL THEN 'ERROR' ELSE 'OK' END AS outcome FROM checked LEFT JOIN best USING (page_id)""",
)
def fetch_outcomes(spark, folder):
    best = admission.best_capture(_captures(spark, folder))
    return admission.fetch_outcomes(_checked(spark, folder), best).select("page_id", "outcome")


# ------------------------------------------------------------------- text
@query("d1_clean_html", f"{PAGES} SELECT page_id, clean_text FROM cleaned")
def clean_html(spark, folder):
    return tables.pages(spark, folder).select("page_id", T.clean_html(F.col("html")).alias("clean_text"))


@query("d2_scrub_pii", f"SELECT doc_id, {B.scrub_sql('text')} AS scrubbed FROM documents")
def scrub_pii(spark, folder):
    return table(spark, folder, "documents").select("doc_id", T.scrub_pii(F.col("text")).alias("scrubbed"))


@query("d3_pii_counts", f"SELECT doc_id, {EMAILS} AS email, {PHONES} AS phone, {IDS} AS id, {EMAILS} + {PHONES} + {IDS} AS total FROM documents")
def pii_counts(spark, folder):
    return table(spark, folder, "documents").select("doc_id", T.pii_counts(F.col("text")).alias("c")).select("doc_id", "c.*")


@query("d4_content_hash", f"{PAGES} SELECT page_id, sha256(text) AS content_hash FROM scrubbed")
def content_hash(spark, folder):
    return B.cleaned_pages(spark, folder).select("page_id", T.content_hash(F.col("text")).alias("content_hash"))


@query("d5_url_host", f"SELECT page_id, {B.HOST_SQL} AS host FROM pages")
def url_host(spark, folder):
    return tables.pages(spark, folder).select("page_id", T.url_host(F.col("url")).alias("host"))


@query("d6_thin_content", f"{PAGES} SELECT page_id, CAST(length(text) AS BIGINT) AS chars, length(text) < 100 AS is_thin FROM scrubbed")
def thin_content(spark, folder):
    return B.cleaned_pages(spark, folder).select(
        "page_id", F.length("text").cast("bigint").alias("chars"), T.is_thin(F.col("text")).alias("is_thin")
    )


@query("d7_text_budget", "SELECT doc_id, md5(substring(text, 1, 8000)) AS head_hash, length(text) > 8000 AS was_cut FROM documents")
def text_budget(spark, folder):
    text = F.col("text")
    return table(spark, folder, "documents").select(
        "doc_id", F.md5(T.budget(text, T.PROMPT_CHARS)).alias("head_hash"), (F.length(text) > T.PROMPT_CHARS).alias("was_cut")
    )


def _template_sql(template: str) -> str:
    return "'" + template.replace("'", "''") + "'"


@query(
    "d8_extraction_prompt",
    f"""{PAGES} SELECT page_id, md5(replace(replace({_template_sql(extraction.EXTRACT_TEMPLATE)}, '{{source_url}}', url),
        '{{markdown_content}}', substring(text, 1, 8000))) AS prompt_hash FROM scrubbed""",
)
def extraction_prompt(spark, folder):
    prompt = extraction.extraction_prompt(F.col("text"), F.col("url"))
    return B.cleaned_pages(spark, folder).select("page_id", F.md5(prompt).alias("prompt_hash"))


@query(
    "d9_repair_prompt",
    f"""{PAGES} SELECT page_id, md5(replace(replace(replace(replace({_template_sql(extraction.REPAIR_TEMPLATE)}, '{{agent_name}}', 'analyst'),
        '{{recent_actions}}', CASE WHEN page_id % 2 = 0 THEN 'RECENT ACTIONS:' || chr(10) || 'Recent pipeline actions:' || chr(10) || '  ✅ [scraper] fetched ' || url || chr(10) ELSE '' END),
        '{{error_trace}}', 'bad answer for ' || url), '{{input_excerpt}}', substring(text, 1, 2000))) AS prompt_hash FROM scrubbed""",
)
def repair_prompt(spark, folder):
    error = F.concat(F.lit("bad answer for "), F.col("url"))
    recent = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("Recent pipeline actions:\n  ✅ [scraper] fetched "), F.col("url")))
    prompt = extraction.repair_prompt(F.lit("analyst"), F.col("text"), error, recent)
    return B.cleaned_pages(spark, folder).select("page_id", F.md5(prompt).alias("prompt_hash"))


@query(
    "d11_embedded_json",
    "SELECT event_id, CASE WHEN event_id % 10 <> 3 THEN CAST(props->>'k' AS BIGINT) END AS k, event_id % 10 = 3 AS is_error FROM events",
)
def embedded_json(spark, folder):
    kind = F.col("event_id") % 10
    fenced = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    broken = F.concat(F.lit("Sorry: "), F.substring("props", 1, 4))
    wrapped = F.concat(F.lit("Here it is: "), F.col("props"), F.lit(" as asked."))
    response = F.when(kind < 3, fenced).when(kind == 3, broken).when(kind < 7, wrapped).otherwise(F.col("props"))
    parsed = table(spark, folder, "events").select("event_id", T.parsed_json(response).alias("payload"))
    return parsed.select(
        "event_id", F.try_variant_get("payload", "$.k", "bigint").alias("k"), F.col("payload").isNull().alias("is_error")
    )


WORDS = ("blees", "onward", "eaueau", "nicht", "the the")


@query(
    "d12_phrase_detection",
    "SELECT doc_id, " + " OR ".join(f"contains(lower(text), '{w}')" for w in WORDS) + " AS mentioned FROM documents",
)
def phrase_detection(spark, folder):
    return table(spark, folder, "documents").select("doc_id", T.mentions_any(F.col("text"), WORDS).alias("mentioned"))


@query(
    "d13_price_mentions",
    """SELECT l_orderkey, l_linenumber, '$' || CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR) || '/1M' AS first_mention,
              CAST(2 AS BIGINT) AS mentions FROM lineitem""",
)
def price_mentions(spark, folder):
    price = F.col("l_extendedprice").cast("decimal(12,2)").cast("string")
    text = F.concat(F.lit("From $"), price, F.lit("/1M in, €"), price, F.lit(" / 1k out, "), F.col("l_quantity").cast("string"), F.lit(" units"))
    found = T.price_mentions(text)
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", found[0].alias("first_mention"), F.size(found).cast("bigint").alias("mentions")
    )


@query(
    "d16_message_parts",
    """SELECT conv_id, turn, CAST(length(role || chr(10) || text) AS BIGINT) AS chars, md5(role || chr(10) || text) AS text_hash,
              CASE WHEN role = 'user' THEN CAST(turn AS VARCHAR) END AS data FROM conversations""",
)
def message_parts(spark, folder):
    def part(kind, text, data):
        return F.struct(kind.alias("kind"), text.alias("text"), data.alias("data"))

    none = F.lit(None).cast("string")
    second = F.when(F.col("role") == "user", "data").otherwise("file")
    parts = F.array(
        part(F.lit("text"), F.col("role"), none),
        part(second, none, F.col("turn").cast("string")),
        part(F.lit("text"), F.col("text"), none),
    )
    rows = table(spark, folder, "conversations").select("conv_id", "turn", parts.alias("parts"))
    joined = T.parts_text(F.col("parts"))
    return rows.select(
        "conv_id", "turn", F.length(joined).cast("bigint").alias("chars"), F.md5(joined).alias("text_hash"),
        T.parts_data(F.col("parts")).alias("data"),
    )


# ------------------------------------------------- matching and set operators
# labels of hosts are companies, with the address of the first page that has it
@query(
    "f1_catalog_match",
    f"""WITH labels AS (SELECT DISTINCT page_id, url, unnest(string_split({B.HOST_SQL}, '.')) AS label FROM pages),
        catalog AS (SELECT label AS company_name, min(page_id) AS position, substring(arg_min(url, page_id), 1, 40) AS source_url FROM labels
                    WHERE label NOT IN ('example', 'com', 'net', 'org', 'www', 'blog', 'm') AND label <> '' GROUP BY 1),
        hits AS (SELECT page_id, company_name, position FROM pages JOIN catalog
                 ON contains({B.HOST_SQL}, lower(company_name)) OR contains(lower(url), lower(company_name)) OR contains(lower(url), lower(source_url)))
        SELECT page_id, arg_min(company_name, (position, company_name)) AS company_name FROM pages LEFT JOIN hits USING (page_id) GROUP BY page_id""",
)
def catalog_match(spark, folder):
    pages = tables.pages(spark, folder).select("page_id", "url", T.url_host(F.col("url")).alias("host"))
    common = ["example", "com", "net", "org", "www", "blog", "m", ""]
    labels = pages.select("page_id", "url", F.explode(F.split("host", r"\.")).alias("company_name"))
    catalog = labels.filter(~F.col("company_name").isin(*common)).groupBy("company_name").agg(
        F.min("page_id").alias("position"), F.substring(F.min_by("url", "page_id"), 1, 40).alias("source_url")
    )
    return strategy.match_catalog(pages, catalog).select("page_id", "company_name")


SHORT_CATALOG = [("spam-farm", "https://none.example/"), ("cheap-pills", "https://none.example/"), ("th", "https://m.")]


@query(
    "f1_short_catalog_match",
    f"""SELECT page_id, CASE WHEN contains({B.HOST_SQL}, 'spam-farm') OR contains(lower(url), 'spam-farm') THEN 'spam-farm'
        WHEN contains(lower(url), 'cheap-pills') THEN 'cheap-pills'
        WHEN contains(lower(url), 'th') OR contains(lower(url), 'https://m.') THEN 'th' END AS company_name FROM pages""",
)
def short_catalog_match(spark, folder):
    pages = admission.admit(tables.pages(spark, folder).select("page_id", "url"))
    rows = [(*entry, i) for i, entry in enumerate(SHORT_CATALOG)]
    catalog = spark.createDataFrame(rows, "company_name string, source_url string, position int")
    return strategy.match_catalog(pages, catalog).select("page_id", "company_name")


CITED_SQL = f"""
cited AS (
  SELECT page_id // 2 AS rec_id, 'Move ' || (page_id // 2) AS title,
         CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN {B.HOST_SQL} WHEN 2 THEN {B.HOST_SQL} || '.missing' ELSE substring(url, 5, 6) END AS source
  FROM pages)
"""


def _cited(spark, folder):
    page, url = F.col("page_id"), F.col("url")
    rec = F.floor(page / 2).cast("bigint")
    host = T.url_host(url)
    source = (
        F.when(page % 4 == 0, url).when(page % 4 == 1, host).when(page % 4 == 2, F.concat(host, F.lit(".missing")))
        .otherwise(F.substring(url, 5, 6))
    )
    return tables.pages(spark, folder).select(
        rec.alias("rec_id"), F.concat(F.lit("Move "), rec.cast("string")).alias("title"), source.alias("source")
    )


@query(
    "f6_source_corroboration",
    f"WITH {CITED_SQL} SELECT DISTINCT source FROM cited WHERE EXISTS (SELECT 1 FROM pages WHERE contains(url, source))",
)
def source_corroboration(spark, folder):
    return strategy.cited_in_known(_cited(spark, folder), tables.pages(spark, folder))


@query(
    "g10_corroborated_claims",
    f"""WITH {CITED_SQL}, ok AS (SELECT DISTINCT rec_id, title, source FROM cited WHERE EXISTS (SELECT 1 FROM pages WHERE contains(url, source)))
        SELECT rec_id, CASE WHEN n >= 2 THEN title ELSE '[Single-Source] ' || title END AS title, source, n AS corroboration_count
        FROM (SELECT *, count(*) OVER (PARTITION BY rec_id, title) AS n FROM ok)""",
)
def corroborated_claims(spark, folder):
    return strategy.enforce_corroboration(_cited(spark, folder), tables.pages(spark, folder))


@query("g19_run_citations", f"SELECT {B.HOST_SQL} AS pipeline_id, url AS source_url FROM pages GROUP BY 1, 2")
def run_citations(spark, folder):
    pages = tables.pages(spark, folder)
    return pages.select(T.url_host(F.col("url")).alias("pipeline_id"), F.col("url").alias("source_url")).distinct()


@query(
    "j5_exact_duplicates",
    "SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
)
def exact_duplicates(spark, folder):
    return deltas.exact_duplicates(table(spark, folder, "documents"), "doc_id", "text")


@query(
    "j6_crawl_changes",
    f"""WITH {B.CLEANED_SQL},
        b AS (SELECT url, sha256(text) AS old_hash FROM scrubbed),
        a AS (SELECT CASE WHEN page_id % 7 = 0 THEN url || '&moved' ELSE url END AS url,
                     sha256(CASE WHEN page_id % 5 = 0 THEN text || 'x' ELSE text END) AS new_hash FROM scrubbed)
        SELECT url, old_hash, new_hash, CASE WHEN old_hash IS NULL THEN 'new' WHEN new_hash IS NULL THEN 'gone'
               WHEN old_hash = new_hash THEN 'unchanged' ELSE 'changed' END AS status FROM b FULL JOIN a USING (url)""",
)
def crawl_changes(spark, folder):
    # in the second crawl some pages have moved and others were edited
    pages = B.cleaned_pages(spark, folder)
    page, text = F.col("page_id"), F.col("text")
    moved = F.when(page % 7 == 0, F.concat("url", F.lit("&moved"))).otherwise(F.col("url"))
    edited = F.when(page % 5 == 0, F.concat(text, F.lit("x"))).otherwise(text)
    before = pages.select("url", T.content_hash(text).alias("content_hash"))
    after = pages.select(moved.alias("url"), T.content_hash(edited).alias("content_hash"))
    return deltas.crawl_changes(before, after)


@query("k11_row_ids", "SELECT page_id, 'pipe_' || substring(sha256(url), 1, 8) AS run_id FROM pages")
def row_ids(spark, folder):
    return tables.pages(spark, folder).select("page_id", row_id("pipe_", F.col("url"), digits=8).alias("run_id"))


# -------------------------------------------------------------- extension
@query(
    "m3_sql_functions",
    f"{PAGES} SELECT page_id, host, md5(text) AS text_hash FROM scrubbed",
)
def sql_functions(spark, folder):
    sqlfuncs.register(spark)
    return tables.pages(spark, folder).selectExpr(
        "page_id", "ml_url_host(url) AS host", "md5(ml_scrub_pii(ml_clean_html(html))) AS text_hash"
    )


@query(
    "m4_robots_rules",
    f"""WITH hosts AS (SELECT DISTINCT {B.HOST_SQL} AS host FROM pages),
        rules AS (SELECT * FROM (VALUES ('.net', '*', 'allow', '/en/1', 1), ('.net', '*', 'disallow', '/en/', 2),
          ('.net', '*', 'crawl-delay', '4', 3), ('.org', 'otherbot', 'disallow', '/', 2), ('.org', 'loombot', 'disallow', '/', 2),
          ('.org', 'otherbot', 'crawl-delay', '7.5', 3), ('.org', 'loombot', 'crawl-delay', '7.5', 3),
          ('.org', '*', 'disallow', '/de/', 6)) v(ending, agent, kind, value, line_no))
        SELECT host, agent, kind, value, CAST(line_no AS BIGINT) AS line_no FROM hosts JOIN rules ON ends_with(host, ending)""",
)
def robots_rule_rows(spark, folder):
    rules = admission.robots_rules(B.robots_files(spark, folder))
    return rules.select("host", "agent", "kind", "value", F.col("line_no").cast("bigint").alias("line_no"))


@query(
    "h10_citation_numbers",
    f"""SELECT url AS source_url, min(n) AS idx FROM (SELECT url, row_number() OVER (ORDER BY page_id) AS n FROM
        (SELECT page_id, 'https://' || {B.HOST_SQL} AS url FROM pages)) GROUP BY 1""",
)
def citation_numbers(spark, folder):
    pages = tables.pages(spark, folder).select(
        "page_id", F.concat(F.lit("https://"), T.url_host(F.col("url"))).alias("source_url"), F.lit("-").alias("company_name")
    )
    return reports.citations(pages, "page_id").select("source_url", "idx")
