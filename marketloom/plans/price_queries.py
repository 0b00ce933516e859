"""Queries over price snapshots: decoding, grounding, changes, strategy, matrix, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom import binding as B
from marketloom.functions import prices as P
from marketloom.functions import text as T
from marketloom.operators import deltas, evaluation, extraction, grounding, matrix, reports, skew, strategy
from marketloom.plans.registry import query
from marketloom.session import materialize, scratch_path
from marketloom.sources import sinks
from marketloom.sources.tables import table

OFFERS = f"WITH {B.OFFERS_SQL}"
TEXTS = f"WITH {B.OFFERS_SQL}, {B.TEXTS_SQL}"


def _run(spark, folder, run):
    return B.offers(spark, folder).filter(F.col("run") == run)


def _records(spark, folder, run="R2"):
    return B.records(_run(spark, folder, run).drop("features"))


def _sourced(spark, folder):
    return B.with_source_text(B.records(B.offers(spark, folder).drop("features")))


# ------------------------------------------------------ price normalisation
RAW_PRICE_SQL = """
raw AS (SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR) AS x FROM lineitem)
"""


def _raw_prices(spark, folder):
    items = table(spark, folder, "lineitem")
    x = F.col("l_extendedprice").cast("decimal(12,2)").cast("string")
    kinds = {
        1: F.concat(F.lit("$"), x), 2: F.concat(x, F.lit(" / 1K")), 3: F.lit("Free"), 4: F.lit("Contact sales"),
        5: F.concat(F.lit(" €"), x, F.lit(" ")), 7: F.concat(x, F.lit(" per thousand")),
    }
    raw = F.lit(None).cast("string")
    for number, text in kinds.items():
        raw = F.when(F.col("l_linenumber") == number, text).otherwise(raw)
    return items.select("l_orderkey", "l_linenumber", "l_extendedprice", raw.alias("raw"))


@query(
    "e1_normalize_price",
    f"""WITH {RAW_PRICE_SQL} SELECT l_orderkey, l_linenumber, l_extendedprice,
        CASE WHEN l_linenumber IN (1, 5) THEN round(CAST(x AS DOUBLE), 4) WHEN l_linenumber IN (2, 7) THEN round(CAST(x AS DOUBLE) * 1000.0, 4)
             WHEN l_linenumber = 3 THEN CAST(0 AS DOUBLE) END AS price FROM raw""",
)
def normalize_price(spark, folder):
    return _raw_prices(spark, folder).select(
        "l_orderkey", "l_linenumber", "l_extendedprice", P.normalize_price(F.col("raw")).alias("price")
    )


@query(
    "e2_sanitize_tiers",
    f"""{OFFERS} SELECT company_name, CASE WHEN tier_name LIKE 'Brand#1 %' THEN 'Standard Tier' ELSE tier_name END AS tier_name,
        CASE WHEN tier_name LIKE 'Brand#2 %' THEN round(CAST(CAST(input_price AS DECIMAL(18,2)) AS DOUBLE), 4)
             WHEN tier_name LIKE 'Brand#3 %' THEN round(CAST(CAST(input_price AS DECIMAL(18,2)) AS DOUBLE) * 1000, 4)
             WHEN tier_name LIKE 'Brand#4 %' THEN 0 WHEN tier_name LIKE 'Brand#5 %' THEN NULL
             WHEN input_price - 2000 >= 0 THEN input_price - 2000 END AS input_price, output_price, context_tokens
        FROM offers WHERE run = 'R2'""",
)
def sanitize_tiers(spark, folder):
    def spoil(t):
        name = t["model_or_tier_name"]
        blank = F.when(F.startswith(name, F.lit("Brand#1 ")), "").otherwise(F.concat(F.lit(" "), name, F.lit("\t")))
        price = t["input_price_per_m_tokens"]
        cents = price.cast("decimal(18,2)").cast("string")
        # as models write prices
        said = {2: F.concat(F.lit("$"), cents, F.lit(" / 1M")), 3: F.concat(cents, F.lit(" / 1K tokens")), 4: F.lit(" Free "), 5: F.lit("Contact sales")}
        text = (price - 2000).cast("string")
        for brand, words in said.items():
            text = F.when(F.startswith(name, F.lit(f"Brand#{brand} ")), words).otherwise(text)
        return t.withField("model_or_tier_name", blank).withField("input_price_per_m_tokens", text)

    spoiled = _records(spark, folder).withColumn("pricing_tiers", F.transform("pricing_tiers", spoil))
    clean = spoiled.withColumn("pricing_tiers", grounding.sanitize_tiers(F.col("pricing_tiers")))
    return matrix.flatten(clean).select("company_name", "tier_name", "input_price", "output_price", "context_tokens")


@query(
    "e3_decode_records",
    f"""{TEXTS} SELECT company_name, run, 'Standard API' AS product_name,
        enterprise OR contains(lower(source_text), 'brand#7 small') AS enterprise_terms_mentioned FROM texts""",
)
def decode_records(spark, folder):
    rows = _sourced(spark, folder).withColumn("product_name", F.lit(None).cast("string"))
    return grounding.decode(rows, phrases=("brand#7 small",)).select(
        "company_name", "run", "product_name", "enterprise_terms_mentioned"
    )


# Facts of each record as rows: (kind, text found in the page or not).
FACTS_SQL = """
facts AS (
  SELECT company_name, run, 'company_name:' || company_name AS label, contains(lower(source_text), lower(company_name)) AS ok FROM texts
  UNION ALL
  SELECT company_name, run, 'citation_text_mismatch',
         contains(lower(source_text), lower(CASE WHEN len(string_split(citation_text, ' ')) >= 3
           THEN array_to_string(string_split(citation_text, ' ')[1:4], ' ') ELSE citation_text END)) FROM texts
  UNION ALL
  SELECT o.company_name, o.run, 'tier_name:' || tier_name, contains(lower(source_text), lower(tier_name))
  FROM offers o JOIN texts t ON o.company_name = t.company_name AND o.run = t.run
  UNION ALL
  SELECT o.company_name, o.run, 'price:' || printf('%.2f', p),
         contains(source_text, printf('%.2f', p)) OR contains(source_text, printf('%g', p))
  FROM (SELECT company_name, run, unnest([input_price, output_price]) AS p FROM offers) o
  JOIN texts t ON o.company_name = t.company_name AND o.run = t.run WHERE p > 0),
ratios AS (
  SELECT company_name, run, round(count(*) FILTER (WHERE ok) / count(*), 3) AS grounding_ratio,
         count(*) FILTER (WHERE NOT ok) AS ungrounded_count,
         string_agg(label, ';' ORDER BY label) FILTER (WHERE NOT ok) AS ungrounded_fields
  FROM facts GROUP BY company_name, run)
"""


@query(
    "e4_grounding",
    f"""{TEXTS}, {FACTS_SQL} SELECT company_name, run, grounding_ratio, CAST(ungrounded_count AS BIGINT) AS ungrounded_count,
        coalesce(ungrounded_fields, '') AS ungrounded_fields FROM ratios""",
)
def ground(spark, folder):
    return grounding.ground(_sourced(spark, folder)).select(
        "company_name", "run", "grounding_ratio", F.size("ungrounded_fields").cast("bigint").alias("ungrounded_count"),
        F.array_join(F.array_sort("ungrounded_fields"), ";").alias("ungrounded_fields"),
    )


@query(
    "e5_calibrated_confidence",
    f"""{TEXTS}, {FACTS_SQL} SELECT company_name, run, CASE WHEN company_name LIKE '%1' THEN grounding_ratio
        ELSE least(0.9, grounding_ratio) END AS extraction_confidence FROM ratios""",
)
def calibrated_confidence(spark, folder):
    silent = F.when(F.endswith("company_name", F.lit("1")), 0.0).otherwise(F.col("extraction_confidence"))
    rows = _sourced(spark, folder).withColumn("extraction_confidence", silent)
    return grounding.calibrate(grounding.ground(rows)).select("company_name", "run", "extraction_confidence")


SCORES_SQL = """
tier_scores AS (
  SELECT o.company_name, o.run, count(*) AS n, count(*) + count(input_price) + count(output_price) AS checks,
    CAST(sum(contains(lower(source_text), lower(tier_name))::INT
      + coalesce((contains(source_text, printf('%.2f', input_price)) OR contains(source_text, rtrim(rtrim(printf('%.2f', input_price), '0'), '.')))::INT, 0)
      + coalesce((contains(source_text, printf('%.2f', output_price)) OR contains(source_text, rtrim(rtrim(printf('%.2f', output_price), '0'), '.')))::INT, 0)) AS DOUBLE) AS hits,
    count(tier_name) + count(input_price) + count(output_price) AS filled,
    count(input_price) + count(output_price) + count(context_tokens) + count(output_price) AS sane_checks,
    CAST(sum(coalesce((input_price > 10000)::INT, 0) + coalesce((output_price > 10000)::INT, 0)
      + coalesce((context_tokens > 10000000)::INT, 0)
      + CASE WHEN output_price < input_price * 0.1 THEN 0.5 ELSE 0 END) AS DOUBLE) AS issues
  FROM offers o JOIN texts t ON o.company_name = t.company_name AND o.run = t.run GROUP BY 1, 2),
scores AS (
  SELECT t.company_name, t.run,
    (1.0::DOUBLE * (contains(lower(source_text), lower(t.company_name))::INT + cited::INT + hits)) / (2 + checks) AS dom_grounding,
    CAST(5 + filled AS DOUBLE) / (5 + 3 * n) AS schema_completeness,
    greatest(0.0::DOUBLE, 1.0::DOUBLE - issues / sane_checks) AS cross_field_sanity
  FROM (SELECT *, len(list_filter(string_split(lower(citation_text), ' '), lambda w: contains(lower(source_text), w)))
          >= len(string_split(citation_text, ' ')) * 0.6 AS cited FROM texts) t
  JOIN tier_scores s ON t.company_name = s.company_name AND t.run = s.run),
confident AS (
  SELECT *, 0.5::DOUBLE * dom_grounding + 0.3::DOUBLE * schema_completeness + 0.2::DOUBLE * cross_field_sanity AS mixed FROM scores),
validated AS (
  SELECT *, round(least(greatest(CASE WHEN dom_grounding < 0.25 THEN least(mixed, 0.4) ELSE mixed END, 0.0), 1.0)::DOUBLE, 3) AS extraction_confidence
  FROM confident)
"""


@query(
    "e6_dom_grounding",
    f"{TEXTS}, {SCORES_SQL} SELECT company_name, run, round(dom_grounding, 9) AS dom_grounding FROM scores",
)
def dom_grounding(spark, folder):
    return grounding.dom_grounding(_sourced(spark, folder)).select(
        "company_name", "run", F.round("dom_grounding", 9).alias("dom_grounding")
    )


@query(
    "e7_schema_completeness",
    f"{TEXTS}, {SCORES_SQL} SELECT company_name, run, round(schema_completeness, 9) AS schema_completeness FROM scores",
)
def schema_completeness(spark, folder):
    return _sourced(spark, folder).select(
        "company_name", "run", F.round(grounding.completeness(), 9).alias("schema_completeness")
    )


@query(
    "e8_cross_field_sanity",
    f"{TEXTS}, {SCORES_SQL} SELECT company_name, run, round(cross_field_sanity, 9) AS cross_field_sanity FROM scores",
)
def cross_field_sanity(spark, folder):
    return _sourced(spark, folder).select("company_name", "run", F.round(grounding.sanity(), 9).alias("cross_field_sanity"))


def _claimed(records):
    """Records with sources, of which some have none, and confidences, of which some are out of range."""
    wide = F.filter("pricing_tiers", lambda t: t["context_window_tokens"] >= 100000)
    return (
        records.withColumn("extraction_confidence", F.when(F.endswith("company_name", F.lit("4")), 1.5).otherwise(0.9))
        .withColumn("corroborating_sources", F.transform(wide, lambda t: t["model_or_tier_name"]))
        .withColumn("corroboration_count", F.size("corroborating_sources"))
    )


@query(
    "e9_schema_violations",
    f"""{OFFERS} SELECT company_name, concat_ws(',', CASE WHEN company_name LIKE '%4' THEN 'confidence_out_of_range' END,
        CASE WHEN count(*) FILTER (WHERE context_tokens >= 100000) < 1 THEN 'no_corroborating_source' END,
        CASE WHEN count(*) FILTER (WHERE context_tokens >= 100000) < 1 THEN 'corroboration_count_below_one' END) AS violations
        FROM offers WHERE run = 'R2' GROUP BY company_name""",
)
def schema_violations(spark, folder):
    return grounding.violations(_claimed(_records(spark, folder))).select("company_name", F.array_join("violations", ",").alias("violations"))


@query(
    "e10_confidence",
    f"{TEXTS}, {SCORES_SQL} SELECT company_name, run, extraction_confidence FROM validated",
)
def confidence(spark, folder):
    return grounding.validate(_sourced(spark, folder)).select("company_name", "run", "extraction_confidence")


@query(
    "e11_validated_records",
    f"""{TEXTS}, {SCORES_SQL} SELECT company_name, run, extraction_confidence, extraction_confidence >= 0.6 AS is_valid,
        CAST(n AS BIGINT) AS tiers FROM validated JOIN (SELECT company_name, run, count(*) AS n FROM offers GROUP BY 1, 2) USING (company_name, run)""",
)
def validated_records(spark, folder):
    return grounding.validate(grounding.decode(_sourced(spark, folder))).select(
        "company_name", "run", "extraction_confidence", "is_valid", F.size("pricing_tiers").cast("bigint").alias("tiers")
    )


@query(
    "c10_confidence_gate",
    f"""{TEXTS}, {SCORES_SQL} SELECT company_name, run, CASE WHEN extraction_confidence < 0.65
        THEN 'Confidence ' || CAST(CAST(extraction_confidence AS DECIMAL(18,2)) AS VARCHAR) || ' < 0.65' END AS reason FROM validated""",
)
def confidence_gate(spark, folder):
    validated = grounding.validate(_sourced(spark, folder), threshold=0.65)
    return grounding.gate(validated, threshold=0.65).select("company_name", "run", "reason")


@query(
    "e13_repair_history",
    """WITH a AS (SELECT l_orderkey, l_linenumber, l_returnflag AS root_cause, 'use ' || l_linestatus || ' at ' || CAST(CAST(l_tax AS DECIMAL(4,2)) AS VARCHAR) AS remedy
         FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem) WHERE r = 1)
       SELECT l_orderkey, 'Previous repair attempts (' || count(*) || '/2):' || chr(10) ||
         string_agg('  Attempt ' || l_linenumber || ': Root cause = ' || root_cause || ', Remedy = ' || remedy, chr(10) ORDER BY l_linenumber) AS history
       FROM a GROUP BY 1""",
)
def repair_history(spark, folder):
    # orders stand for pages and line numbers for attempts
    items = table(spark, folder, "lineitem")
    first = F.min_by(F.struct("l_returnflag", "l_linestatus", "l_tax"), F.struct("l_partkey", "l_suppkey", "l_extendedprice"))
    attempts = items.groupBy("l_orderkey", F.col("l_linenumber").alias("attempt_number")).agg(first.alias("f")).select(
        "l_orderkey", "attempt_number", F.col("f.l_returnflag").alias("root_cause"),
        F.concat(F.lit("use "), F.col("f.l_linestatus"), F.lit(" at "), F.col("f.l_tax").cast("decimal(4,2)").cast("string")).alias("remedy"),
    )
    return extraction.repair_history(attempts, "l_orderkey")


@query(
    "e14_model_price_list",
    """SELECT *, 'https://openrouter.ai/' || lower(company_name) AS source_url, company_name || ' LLM Endpoints' AS product_name,
         'OpenRouter normalized proxy routing' AS rate_limits_summary, company_name || ' pricing verified via OpenRouter catalog.' AS citation_text FROM (
         SELECT upper(substring(p_brand, 1, 1)) || lower(substring(p_brand, 2)) AS company_name, p_name AS tier_name,
           CASE WHEN p_retailprice > 0 THEN round(p_retailprice / 1e6::DOUBLE * 1000000, 3) END AS input_price,
           CASE WHEN p_size > 25 THEN round(p_size / 1e6::DOUBLE * 1000000, 3) END AS output_price,
           CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS BIGINT) AS tier_no FROM part)""",
)
def model_price_list(spark, folder):
    parts = table(spark, folder, "part")
    models = parts.select(
        F.concat("p_brand", F.lit("/"), "p_name").alias("id"), (F.col("p_retailprice") / 1e6).alias("prompt"),
        F.when(F.col("p_size") > 25, F.col("p_size") / 1e6).otherwise(0.0).alias("completion"), "p_partkey",
    )
    return extraction.model_price_list(models, "p_partkey").select(
        "company_name", "tier_name", "input_price", "output_price", F.col("tier_no").cast("bigint").alias("tier_no"),
        "source_url", "product_name", "rate_limits_summary", "citation_text",
    )


# ------------------------------------------------------------------ changes
DELTAS_SQL = """
paired AS (
  SELECT coalesce(n.company_name, o.company_name) AS competitor_name, coalesce(n.tier_name, o.tier_name) AS tier,
         o.company_name IS NULL AS added, n.company_name IS NULL AS removed,
         o.input_price AS oi, n.input_price AS ni, o.output_price AS oo, n.output_price AS no
  FROM (SELECT * FROM offers WHERE run = 'R1') o FULL JOIN (SELECT * FROM offers WHERE run = 'R2') n
    ON o.company_name = n.company_name AND o.tier_name = n.tier_name),
kept AS (
  SELECT * FROM paired WHERE competitor_name IN (SELECT company_name FROM offers WHERE run = 'R1')
    AND competitor_name IN (SELECT company_name FROM offers WHERE run = 'R2')),
changes AS (
  SELECT competitor_name, tier, '_input_price' AS metric, oi AS old, ni AS new FROM kept WHERE NOT added AND NOT removed AND oi <> ni
  UNION ALL
  SELECT competitor_name, tier, '_output_price', oo, no FROM kept WHERE NOT added AND NOT removed AND oo <> no),
deltas AS (
  SELECT competitor_name, CASE WHEN new < old THEN 'PRICE_DECREASE' ELSE 'PRICE_INCREASE' END AS delta_type,
    tier || metric AS metric_name,
    '$' || CAST(CAST(old AS DECIMAL(18,2)) AS VARCHAR) || '/1M' AS old_value,
    '$' || CAST(CAST(new AS DECIMAL(18,2)) AS VARCHAR) || '/1M' AS new_value,
    round((new - old) / nullif(old, 0) * 100, 1) + 0.0::DOUBLE AS percentage_change,
    CASE WHEN abs((new - old) / old * 100) >= 30 THEN 'CRITICAL' WHEN abs((new - old) / old * 100) >= 15 THEN 'HIGH'
         WHEN abs((new - old) / old * 100) >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS strategic_severity
  FROM changes
  UNION ALL SELECT competitor_name, 'TIER_REMOVED', tier, tier, 'REMOVED', NULL, 'MEDIUM' FROM kept WHERE removed
  UNION ALL SELECT competitor_name, 'NEW_TIER', tier, NULL, 'NEW: ' || tier, NULL, 'MEDIUM' FROM kept WHERE added)
"""
DELTAS = f"{OFFERS}, {DELTAS_SQL}"


def _deltas(spark, folder):
    return deltas.tier_diff_of_runs(B.offers(spark, folder), "R1", "R2")


@query(
    "f3_tier_diff",
    f"""{DELTAS} SELECT competitor_name, delta_type, metric_name, old_value, new_value, percentage_change, strategic_severity FROM deltas""",
)
def tier_diff(spark, folder):
    return _deltas(spark, folder).drop("product_name")


@query(
    "g3_severity_rollup",
    f"""{DELTAS} SELECT competitor_name, delta_type, strategic_severity, count(*) AS changes,
        CAST(grouping(competitor_name, delta_type, strategic_severity) AS BIGINT) AS level
        FROM deltas GROUP BY ROLLUP (competitor_name, delta_type, strategic_severity)""",
)
def severity_rollup(spark, folder):
    return deltas.severity_rollup(_deltas(spark, folder))


@query(
    "f2_history_match",
    f"""{OFFERS}, c AS (SELECT company_name, run, count(*) AS tiers FROM offers GROUP BY 1, 2)
        SELECT n.company_name, n.tiers, o.tiers AS history_tiers, o.run AS history_run
        FROM (SELECT * FROM c WHERE run = 'R2') n LEFT JOIN (SELECT * FROM c WHERE run = 'R1') o USING (company_name)""",
)
def history_match(spark, folder):
    rows = B.records(B.offers(spark, folder).drop("features"))
    matched = deltas.match_history(rows.filter("run = 'R2'"), rows.filter("run = 'R1'"), "run")
    return matched.select(
        "company_name", F.size("pricing_tiers").cast("bigint").alias("tiers"),
        F.when(F.col("history_tiers").isNotNull(), F.size("history_tiers")).cast("bigint").alias("history_tiers"),
        F.col("history_position").alias("history_run"),
    )


@query(
    "f4_changed_companies",
    f"""{DELTAS}, still AS (SELECT DISTINCT company_name FROM offers WHERE company_name NOT IN
          (SELECT competitor_name FROM deltas WHERE strategic_severity = 'CRITICAL' GROUP BY 1 HAVING count(*) > 20))
        SELECT company_name, count(*) AS tiers FROM offers WHERE run = 'R2' AND (company_name NOT IN (FROM still)
          OR (SELECT count(*) FROM offers WHERE run = 'R2' AND company_name NOT IN (FROM still)) = 0) GROUP BY 1""",
)
def changed_companies(spark, folder):
    grave = _deltas(spark, folder).filter("strategic_severity = 'CRITICAL'").groupBy("competitor_name").agg(
        F.count(F.lit(1)).alias("n")
    ).filter("n > 20")
    rows = B.offers(spark, folder)
    still = rows.select("company_name").distinct().join(
        grave.withColumnRenamed("competitor_name", "company_name"), "company_name", "left_anti"
    )
    changed = deltas.changed_only(rows.filter("run = 'R2'"), still)
    return changed.groupBy("company_name").agg(F.count(F.lit(1)).alias("tiers"))


@query(
    "a5_fallback_source",
    f"{OFFERS} SELECT company_name, tier_name, input_price FROM offers WHERE run = 'R1'",
)
def fallback_source(spark, folder):
    # no run carries this name, so the older run answers
    rows = B.offers(spark, folder).select("company_name", "tier_name", "input_price", "run")
    return deltas.fallback(rows.filter("run = 'R3'"), rows.filter("run = 'R1'")).drop("run")


@query(
    "k1_percent_change",
    """SELECT l_orderkey, l_linenumber, l_extendedprice, round((l_linenumber - l_quantity) / nullif(l_quantity, 0) * 100, 1) + 0.0::DOUBLE AS pct,
         CASE WHEN l_linenumber < l_quantity THEN 'PRICE_DECREASE' ELSE 'PRICE_INCREASE' END AS direction FROM lineitem""",
)
def percent_change(spark, folder):
    old, new = F.col("l_quantity"), F.col("l_linenumber").cast("double")
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", F.round(P.percent_change(old, new), 1).alias("pct"),
        P.direction(old, new).alias("direction"),
    )


@query(
    "k2_severity",
    """SELECT l_orderkey, l_linenumber, l_extendedprice, CASE WHEN l_tax = 0 AND l_discount <> 0 THEN 'CRITICAL'
         WHEN abs((l_discount - l_tax) / nullif(l_tax, 0) * 100) >= 30 THEN 'CRITICAL' WHEN abs((l_discount - l_tax) / nullif(l_tax, 0) * 100) >= 15 THEN 'HIGH'
         WHEN abs((l_discount - l_tax) / nullif(l_tax, 0) * 100) >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM lineitem""",
)
def severity(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", P.severity(F.col("l_tax"), F.col("l_discount")).alias("severity")
    )


@query(
    "k3_delta_labels",
    f"{DELTAS} SELECT metric_name, old_value, new_value, count(*) AS n FROM deltas GROUP BY 1, 2, 3",
)
def delta_labels(spark, folder):
    return _deltas(spark, folder).groupBy("metric_name", "old_value", "new_value").agg(F.count(F.lit(1)).alias("n"))


@query(
    "k4_delta_sentences",
    f"""{DELTAS} SELECT competitor_name, delta_type || ': ' || metric_name || ' ' || coalesce(old_value, 'N/A') || ' → ' || new_value AS summary_of_change,
        strategic_severity AS impact_severity FROM deltas""",
)
def delta_sentences(spark, folder):
    return deltas.delta_sentences(_deltas(spark, folder))


@query(
    "k9_severity_icons",
    f"""{DELTAS} SELECT strategic_severity, CASE strategic_severity WHEN 'LOW' THEN '🟢' WHEN 'MEDIUM' THEN '🟡' WHEN 'HIGH' THEN '🟠'
        WHEN 'CRITICAL' THEN '🔴' ELSE '⚪' END AS icon, count(*) AS n FROM deltas GROUP BY 1, 2""",
)
def severity_icons(spark, folder):
    icon = P.severity_icon(F.col("strategic_severity")).alias("icon")
    return _deltas(spark, folder).groupBy("strategic_severity", icon).agg(F.count(F.lit(1)).alias("n"))


@query(
    "h4_unchanged_in_run",
    """SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, sha256(event_type || ' ' || props) ORDER BY event_id) > 1 AS unchanged FROM events""",
)
def unchanged_in_run(spark, folder):
    # an event is a record here: its user the company, type and properties the text
    text_hash = F.sha2(F.concat_ws(" ", "event_type", "props"), 256)
    rows = table(spark, folder, "events").select("event_id", "user_id", text_hash.alias("text_hash"))
    return deltas.repeated(rows, ["user_id", "text_hash"], "event_id").drop("text_hash")


@query(
    "h9_price_series",
    f"""WITH {B.YEARLY_SQL}, s AS (SELECT *, lag(input_price) OVER (PARTITION BY company_name, tier_name ORDER BY run) AS previous_price FROM yearly)
        SELECT company_name, tier_name, run, input_price, previous_price,
          round((input_price - previous_price) / nullif(previous_price, 0) * 100, 1) + 0.0::DOUBLE AS percentage_change,
          CASE WHEN previous_price IS NULL THEN NULL WHEN abs((input_price - previous_price) / previous_price * 100) >= 30 THEN 'CRITICAL'
            WHEN abs((input_price - previous_price) / previous_price * 100) >= 15 THEN 'HIGH'
            WHEN abs((input_price - previous_price) / previous_price * 100) >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS strategic_severity FROM s""",
)
def price_series(spark, folder):
    runs = B.offers(spark, folder, by_year=True).select("company_name", "tier_name", "run", "input_price")
    return deltas.price_series(runs)


@query(
    "j7_features_added",
    f"""{OFFERS} SELECT n.company_name AS competitor_name, 'FEATURE_ADDED' AS delta_type, n.tier_name AS metric_name,
        unnest(list_filter(n.features, lambda f: NOT list_contains(o.features, f))) AS new_value
        FROM offers n JOIN offers o USING (company_name, tier_name) WHERE n.run = 'R2' AND o.run = 'R1'""",
)
def features_added(spark, folder):
    rows = B.offers(spark, folder)
    return deltas.features_added(rows.filter("run = 'R1'"), rows.filter("run = 'R2'"))


@query(
    "d14_record_text",
    f"""{OFFERS} SELECT company_name, run, md5('Company: ' || company_name || chr(10) || 'Product: Catalog' || chr(10) ||
        string_agg(concat_ws(' | ', 'Tier: ' || tier_name, 'Input: $' || input_price || '/1M', 'Output: $' || output_price || '/1M',
          'Context: ' || context_tokens), chr(10) ORDER BY tier_name)) AS text_hash FROM offers GROUP BY 1, 2""",
)
def record_text(spark, folder):
    text = deltas.record_text(F.col("company_name"), F.col("product_name"), F.col("pricing_tiers"))
    return B.records(B.offers(spark, folder).drop("features")).select("company_name", "run", F.md5(text).alias("text_hash"))


@query(
    "d15_display_formats",
    f"""{OFFERS} SELECT company_name, run, tier_name, coalesce('$' || CAST(CAST(output_price AS DECIMAL(18,2)) AS VARCHAR), '—') AS money,
        format('{{:,}}', context_tokens) AS grouped, CAST(CAST(context_tokens / 1000 AS DECIMAL(18,0)) AS VARCHAR) || 'K' AS kilo,
        CAST(CAST(0.92 * 100 AS DECIMAL(18,0)) AS VARCHAR) || '%' AS share FROM offers""",
)
def display_formats(spark, folder):
    return B.offers(spark, folder).select(
        "company_name", "run", "tier_name", T.money(F.col("output_price")).alias("money"),
        T.grouped_int(F.col("context_tokens")).alias("grouped"), T.kilo(F.col("context_tokens")).alias("kilo"),
        T.percent(F.lit(0.92)).alias("share"),
    )


SYNTHESIS = "Records: {records} Changes: {deltas} Date: {current_date} Answer as {\"summary\": \"...\"}"


CHANGES_IN_A_PROMPT = 100


# one prompt per company and hundred changes; texts in the tables hold nothing that JSON escapes
@query(
    "d10_synthesis_prompt",
    f"""{DELTAS}, n AS (SELECT *, (row_number() OVER (PARTITION BY competitor_name ORDER BY metric_name, delta_type) - 1) // 100 AS part FROM deltas),
        d AS (SELECT competitor_name AS company_name, part, string_agg('{{"metric_name":"' || metric_name || '","delta_type":"' || delta_type || coalesce('","old_value":"' || old_value, '')
                || '","new_value":"' || new_value || '"}}', ',' ORDER BY metric_name, delta_type) AS text FROM n GROUP BY 1, 2),
        r AS (SELECT company_name, count(*) AS tiers FROM offers WHERE run = 'R2' GROUP BY 1)
        SELECT company_name, CAST(coalesce(part, 0) AS BIGINT) AS part, tiers, md5('[' || coalesce(text, '') || ']') AS changes_md5, true AS dated
        FROM r LEFT JOIN d USING (company_name)""",
)
def synthesis_prompt(spark, folder):
    prompts = strategy.synthesis_prompts(_records(spark, folder), _deltas(spark, folder), "2024-01-31", SYNTHESIS, CHANGES_IN_A_PROMPT)
    said = F.regexp_extract("prompt", r"^Records: (.*) Changes: (\[.*\]) Date: ", 2)
    tiers = F.get_json_object(F.regexp_extract("prompt", r"^Records: (.*) Changes: \[", 1), "$.pricing_tiers")
    return prompts.select(
        "company_name", "part", F.json_array_length(tiers).cast("bigint").alias("tiers"), F.md5(said).alias("changes_md5"),
        F.contains("prompt", F.lit(" Date: 2024-01-31 ")).alias("dated"),
    )


# ----------------------------------------------------------------- strategy
@query(
    "f5_price_advantages",
    f"""{OFFERS}, o AS (SELECT * FROM offers WHERE run = 'R2' AND input_price IS NOT NULL),
        top AS (SELECT max(input_price) AS a FROM o),
        pairs AS (SELECT a.company_name, a.tier_name, b.company_name AS other_company, b.tier_name AS other_tier,
          (b.input_price - a.input_price) / b.input_price * 100 AS pct
          FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_name ORDER BY input_price, tier_name) AS r FROM o) WHERE r <= 3) a
          JOIN o b ON a.company_name <> b.company_name AND a.input_price < b.input_price)
        SELECT company_name, tier_name, other_company, other_tier, round(pct, 6) AS pct_cheaper, CAST(r AS BIGINT) AS rank
        FROM (SELECT *, row_number() OVER (PARTITION BY company_name ORDER BY pct DESC, tier_name, other_company, other_tier) AS r FROM pairs) WHERE r <= 3""",
)
def price_advantages(spark, folder):
    return strategy.price_advantages(_run(spark, folder, "R2")).withColumn(
        "pct_cheaper", F.round("pct_cheaper", 6)
    ).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "f7_company_sources",
    f"""{DELTAS} SELECT DISTINCT competitor_name, source_url FROM deltas JOIN offers ON competitor_name = company_name WHERE delta_type = 'PRICE_DECREASE'""",
)
def company_sources(spark, folder):
    sources = strategy.company_sources(_run(spark, folder, "R2"))
    dropped = _deltas(spark, folder).filter("delta_type = 'PRICE_DECREASE'").select("competitor_name").distinct()
    return dropped.join(sources, F.col("competitor_name") == F.col("company_name")).select("competitor_name", "source_url")


@query(
    "g2_executive_summary",
    f"""{DELTAS} SELECT 'summary' AS kind, 'Analyzed ' || (SELECT count(DISTINCT company_name) FROM offers WHERE run = 'R2') || ' competitor product(s) across '
        || (SELECT count(DISTINCT company_name) FROM offers WHERE run = 'R2') || ' companies. Detected ' || count(*) || ' market changes ('
        || count(*) FILTER (WHERE strategic_severity = 'CRITICAL') || ' critical, ' || count(*) FILTER (WHERE strategic_severity = 'HIGH')
        || ' high severity). ' AS line FROM deltas
        UNION ALL SELECT DISTINCT 'company', company_name FROM offers WHERE run = 'R2'""",
)
def executive_summary(spark, folder):
    companies = _run(spark, folder, "R2").select("company_name").distinct()
    return strategy.executive_lines(companies, _deltas(spark, folder))


def _names_sql(source: str, shown: int = strategy.NAMES_LISTED, count_others: bool = True) -> str:
    """Names of ``company`` in a query of distinct ones, as one text."""
    more = f"CASE WHEN count(*) > {shown} THEN ' and ' || (count(*) - {shown}) || ' more' ELSE '' END" if count_others else "''"
    return f"(SELECT array_to_string(list_sort(list(company))[1:{shown}], ', ') || {more} FROM ({source}))"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


DROPPED = "SELECT DISTINCT competitor_name AS company FROM deltas WHERE delta_type = 'PRICE_DECREASE'"
MACRO_SQL = f"""
drops AS (SELECT * FROM deltas WHERE delta_type = 'PRICE_DECREASE'),
drop_sources AS (SELECT DISTINCT source_url FROM offers WHERE run = 'R2' AND company_name IN (SELECT competitor_name FROM drops)),
macro AS (SELECT 'PRICING' AS category, 'Multiple Competitors Reducing Prices' AS title,
  count(*) || ' price reductions detected across ' || {_names_sql(DROPPED)} || '. This signals an industry-wide margin compression trend.' AS rationale,
  {_quoted(strategy.MACRO_DROP_STEP)} AS actionable_next_step, count(*) AS drops, count(DISTINCT competitor_name) AS companies,
  (SELECT list(source_url ORDER BY source_url) FROM (SELECT source_url FROM drop_sources ORDER BY 1 LIMIT 3)) AS sources,
  (SELECT count(*) FROM drop_sources) AS corroboration_count FROM drops HAVING count(*) >= 2),
urls AS (SELECT DISTINCT company_name, source_url FROM offers WHERE run = 'R2'),
tiers AS (SELECT 'PRODUCT_ROADMAP' AS category, 'New Tier Launched by ' || competitor_name AS title,
  competitor_name || ' introduced a new tier: ' || new_value || '.' AS rationale, {_quoted(strategy.NEW_TIER_STEP)} AS actionable_next_step,
  (SELECT list(source_url ORDER BY source_url)[1:2] FROM urls WHERE company_name = competitor_name) AS sources,
  (SELECT count(*) FROM urls WHERE company_name = competitor_name) AS corroboration_count FROM deltas WHERE delta_type = 'NEW_TIER')
"""


def _listed(rows):
    return rows.withColumn("corroborating_sources", F.array_join("corroborating_sources", ","))


@query(
    "g4_macro_price_drop",
    f"""{DELTAS}, {MACRO_SQL} SELECT category, title, rationale, actionable_next_step, drops, companies,
        array_to_string(sources, ',') AS corroborating_sources, corroboration_count FROM macro""",
)
def macro_price_drop(spark, folder):
    return _listed(strategy.macro_price_drop(_run(spark, folder, "R2"), _deltas(spark, folder)))


@query("g4_macro_price_drop_sources", f"{DELTAS}, {MACRO_SQL} SELECT 'Multiple Competitors Reducing Prices' AS title, source_url FROM drop_sources")
def macro_price_drop_sources(spark, folder):
    return strategy.macro_price_drop_sources(_run(spark, folder, "R2"), _deltas(spark, folder))


@query(
    "g5_new_tier_recommendations",
    f"""{DELTAS}, {MACRO_SQL} SELECT category, title, rationale, actionable_next_step, array_to_string(sources, ',') AS corroborating_sources, corroboration_count FROM tiers""",
)
def new_tier_recommendations(spark, folder):
    return _listed(strategy.new_tier_recommendations(_run(spark, folder, "R2"), _deltas(spark, folder))).drop("company_name")


@query(
    "g5_new_tier_sources",
    f"""{DELTAS}, {MACRO_SQL} SELECT 'New Tier Launched by ' || competitor_name AS title, competitor_name || ' introduced a new tier: ' || new_value || '.' AS rationale, source_url
        FROM deltas JOIN urls ON company_name = competitor_name WHERE delta_type = 'NEW_TIER'""",
)
def new_tier_sources(spark, folder):
    return strategy.new_tier_sources(_run(spark, folder, "R2"), _deltas(spark, folder))


def _trend_sql(source: str, category: str, head: str, tail: str, rationale: tuple[str, str], step: str, named: int | None = None) -> str:
    names = _names_sql(source) if named is None else _names_sql(source, named, count_others=False)
    return (
        f"SELECT 'macro' AS scope, '{category}' AS category, '{head}' || n || '{tail}' AS title, {_quoted(rationale[0])} || {names} || {_quoted(rationale[1])} AS rationale, "
        f"{_quoted(step)} AS actionable_next_step, company AS source, n AS corroboration_count "
        f"FROM (SELECT company, count(*) OVER () AS n FROM ({source})) WHERE n >= 2"
    )


@query(
    "g6_price_drop_signal",
    f"{DELTAS} "
    + _trend_sql(
        DROPPED, "PRICING_COMPRESSION", "Market-Wide Token Price Deflation across ", " Competitors",
        strategy.DROP_TREND_RATIONALE, strategy.DROP_TREND_STEP,
    ),
)
def price_drop_signal(spark, folder):
    return strategy.price_drop_signal(_deltas(spark, folder))


@query(
    "g7_enterprise_signal",
    f"{OFFERS} "
    + _trend_sql(
        "SELECT DISTINCT company_name AS company FROM offers WHERE run = 'R2' AND enterprise",
        "ENTERPRISE_GATING", "Shift Toward Gated Enterprise Pricing (", " Providers)",
        strategy.ENTERPRISE_RATIONALE, strategy.ENTERPRISE_STEP, strategy.ENTERPRISE_NAMES,
    ),
)
def enterprise_signal(spark, folder):
    return strategy.enterprise_signal(_records(spark, folder))


@query(
    "g8_feature_signal",
    f"{OFFERS} "
    + _trend_sql(
        "SELECT DISTINCT company_name AS company FROM offers WHERE run = 'R2' AND contains(lower(tier_name), 'brand#3 economy')",
        "FEATURE_PARITY", "Prompt Caching Standardized across ", " Competitors",
        strategy.FEATURE_RATIONALE, strategy.FEATURE_STEP,
    ),
)
def feature_signal(spark, folder):
    return strategy.feature_signal(_records(spark, folder), "brand#3 economy")


ALL_COMPANIES = "SELECT DISTINCT company_name AS company FROM offers WHERE run = 'R2'"


@query(
    "g9_equilibrium_fallback",
    f"""{OFFERS} SELECT 'macro' AS scope, 'POSITIONING' AS category, 'Established Pricing Equilibrium among ' || (SELECT count(*) FROM ({ALL_COMPANIES}))
        || ' Tracked Competitors' AS title, 'Analyzed pricing across ' || {_names_sql(ALL_COMPANIES, 4, False)} || '. No destabilizing price wars detected.' AS rationale,
        {_quoted(strategy.EQUILIBRIUM_STEP)} AS actionable_next_step, company AS source,
        CAST(2 AS BIGINT) AS corroboration_count FROM ({ALL_COMPANIES} ORDER BY 1 LIMIT 2)""",
)
def equilibrium(spark, folder):
    rows = _records(spark, folder)
    return strategy.with_equilibrium(strategy.feature_signal(rows, "no such feature"), rows)


@query(
    "g11_battlecards",
    f"""{OFFERS}, c AS (SELECT company_name, arg_min(tier_name, (input_price, tier_name)) AS cheapest_tier, min(input_price) AS p,
          list_sort(list(tier_name)) AS names, bool_or(enterprise) AS e FROM offers WHERE run = 'R2' GROUP BY 1)
        SELECT company_name AS competitor, 'Active presence in Catalog' AS strength_presence, 'Tier options: ' || array_to_string(names[1:3], ', ') AS strength_tiers,
          CASE WHEN e THEN 'Requires high volume for tiered discount scaling' ELSE 'Limited enterprise SLA disclosures' END AS vulnerability,
          'Complex pricing matrix creates developer calculation friction' AS second_vulnerability,
          'Position against ' || company_name || ' on transparent pricing, faster time-to-first-token, and simplified billing.' AS counter_strategy,
          'Entry token pricing starts at $' || CAST(CAST(p AS DECIMAL(18,2)) AS VARCHAR) || '/1M' AS pricing_posture, cheapest_tier FROM c""",
)
def battlecards(spark, folder):
    return strategy.battlecards(_records(spark, folder))


LINES_SQL = f"""
o AS (SELECT * FROM offers WHERE run = 'R2'),
pairs AS (SELECT a.company_name, a.tier_name, b.company_name AS oc, b.tier_name AS ot, (b.input_price - a.input_price) / b.input_price * 100 AS pct
  FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_name ORDER BY input_price, tier_name) AS r FROM o) WHERE r <= 3) a
  JOIN o b ON a.company_name <> b.company_name AND a.input_price < b.input_price),
lines AS (
  SELECT company_name, 0 AS kind, row_number() OVER (PARTITION BY company_name ORDER BY pct DESC, tier_name, oc, ot) AS pos,
    tier_name || ' input pricing is ' || CAST(CAST(pct AS DECIMAL(18,0)) AS VARCHAR) || '% cheaper than ' || oc || '''s ' || ot AS line FROM pairs
  UNION ALL
  SELECT company_name, 1, row_number() OVER (PARTITION BY company_name ORDER BY context_tokens DESC, tier_name),
    tier_name || ' supports ' || format('{{:,}}', context_tokens) || ' token context window' FROM o WHERE context_tokens >= 128000),
won AS (SELECT company_name, line_no, line FROM (SELECT *, row_number() OVER (PARTITION BY company_name ORDER BY kind, pos) AS line_no FROM lines) WHERE line_no <= 3),
cards AS (
  SELECT company_name AS competitor, 'our_advantages' AS part, line_no, line FROM won
  UNION ALL SELECT DISTINCT company_name, 'recommended_talk_track', CAST(1 AS BIGINT),
    'When competing against ' || company_name || ', emphasize pricing advantages and context window capabilities.' FROM o)
"""


@query("g12_advantage_lines", f"{OFFERS}, {LINES_SQL} SELECT company_name, line_no, line FROM won")
def advantage_lines(spark, folder):
    return strategy.advantage_lines(_run(spark, folder, "R2"))


@query("g12_cards", f"{OFFERS}, {LINES_SQL} SELECT * FROM cards")
def keyed_cards(spark, folder):
    return strategy.cards(_run(spark, folder, "R2"))


PROFILES = ["promo", "econ", "small", "huge"]


@query(
    "f10_profile_match",
    """SELECT profile, min(p_partkey) AS p_partkey, arg_min(p_type, p_partkey) AS p_type, count(p_partkey) AS matches
       FROM (VALUES ('promo'), ('econ'), ('small'), ('huge')) v(profile) LEFT JOIN part ON contains(lower(p_type), profile) GROUP BY 1""",
)
def profile_match(spark, folder):
    return strategy.match_profiles(table(spark, folder, "part"), PROFILES, "p_type", "p_partkey").withColumn(
        "matches", F.coalesce("matches", F.lit(0)).cast("bigint")
    )


@query(
    "f12_feature_lookup",
    f"{OFFERS} SELECT company_name, tier_name, run FROM offers WHERE list_contains(features, 'RF')",
)
def feature_lookup(spark, folder):
    return B.offers(spark, folder).filter(F.exists("features", lambda f: f == "RF")).select("company_name", "tier_name", "run")


# --------------------------------------------------------------- evaluation
def _samples(spark, folder):
    def side(run):
        return _run(spark, folder, run).select(F.col("company_name").alias("sample_id"), "tier_name", "input_price", "output_price")

    return side("R1"), side("R2")


TOL = 500.0
MATCH_SQL = f"""
gold AS (SELECT company_name AS sample_id, * FROM offers WHERE run = 'R1'), pred AS (SELECT company_name AS sample_id, * FROM offers WHERE run = 'R2'),
matched AS (SELECT sample_id, tier_name FROM pred p WHERE EXISTS (SELECT 1 FROM gold g WHERE g.sample_id = p.sample_id
  AND abs(p.input_price - g.input_price) <= {TOL}
  AND ((p.output_price IS NULL AND g.output_price IS NULL) OR abs(p.output_price - g.output_price) <= {TOL})))
"""


@query("f8_matched_tiers", f"{OFFERS}, {MATCH_SQL} SELECT sample_id, tier_name FROM matched")
def matched_tiers(spark, folder):
    gold, pred = _samples(spark, folder)
    return evaluation.matched_tiers(pred, gold, TOL)


METRICS_SQL = """
per AS (SELECT g.sample_id, gold_tiers, coalesce(pred_tiers, 0) AS pred_tiers, coalesce(m, 0) AS matched_tiers,
    coalesce(r.grounding_ratio, 0) AS ratio, coalesce(r.ungrounded_count, 0) AS bad
  FROM (SELECT sample_id, count(*) AS gold_tiers FROM gold GROUP BY 1) g
  LEFT JOIN (SELECT sample_id, count(*) AS pred_tiers FROM pred GROUP BY 1) p USING (sample_id)
  LEFT JOIN (SELECT sample_id, count(*) AS m FROM matched GROUP BY 1) USING (sample_id)
  LEFT JOIN (SELECT * FROM ratios WHERE run = 'R2') r ON r.company_name = g.sample_id),
tot AS (SELECT count(*) AS total_samples, CAST(sum(gold_tiers) AS BIGINT) AS gold_tiers, CAST(sum(pred_tiers) AS BIGINT) AS pred_tiers,
    CAST(sum(matched_tiers) AS BIGINT) AS matched_tiers, CAST(sum(bad) AS BIGINT) AS hallucinated_values, round(avg(ratio), 3) AS avg_dom_grounding_ratio FROM per),
rated AS (SELECT *, (SELECT round(count(*) FILTER (WHERE sound) / count(*), 3) FROM (SELECT count(*) FILTER (WHERE context_tokens >= 100000) >= 1
      AND company_name NOT LIKE '%4' AS sound FROM offers WHERE run = 'R2' AND company_name IN (SELECT sample_id FROM gold) GROUP BY company_name)) AS schema_validity_rate, round(matched_tiers / pred_tiers, 3) AS tier_precision,
    round(matched_tiers / gold_tiers, 3) AS tier_recall, round(hallucinated_values / pred_tiers, 3) AS hallucination_rate FROM tot),
metrics AS (SELECT *, round(2 * tier_precision * tier_recall / nullif(tier_precision + tier_recall, 0), 3) AS tier_f1 FROM rated)
"""


def _metrics(spark, folder):
    gold, pred = _samples(spark, folder)
    rows = B.with_source_text(_records(spark, folder))
    judged = grounding.violations(_claimed(grounding.ground(rows)))
    grounded = judged.select(
        F.col("company_name").alias("sample_id"), "grounding_ratio", F.size("ungrounded_fields").alias("ungrounded_count"),
        (F.size("violations") == 0).alias("schema_valid"),
    )
    return evaluation.metrics(evaluation.per_sample(pred, gold, grounded, TOL))


@query("g13_evaluation_metrics", f"{TEXTS}, {FACTS_SQL}, {MATCH_SQL}, {METRICS_SQL} SELECT * FROM metrics")
def evaluation_metrics(spark, folder):
    return _metrics(spark, folder)


@query(
    "g14_metric_status",
    f"""{TEXTS}, {FACTS_SQL}, {MATCH_SQL}, {METRICS_SQL}, t AS (UNPIVOT (SELECT schema_validity_rate, tier_precision, tier_recall, tier_f1,
          avg_dom_grounding_ratio, hallucination_rate FROM metrics) ON COLUMNS(*) INTO NAME metric VALUE score)
        SELECT metric, score, target::DOUBLE AS target, CASE WHEN (metric = 'hallucination_rate' AND score <= target) OR (metric <> 'hallucination_rate' AND score >= target)
          THEN 'PASSED' ELSE 'WARNING' END AS status
        FROM t JOIN (VALUES ('schema_validity_rate', 0.99), ('tier_precision', 0.9), ('tier_recall', 0.85), ('tier_f1', 0.88),
          ('avg_dom_grounding_ratio', 0.9), ('hallucination_rate', 0.05)) v(metric, target) USING (metric)""",
)
def metric_status(spark, folder):
    return evaluation.status_table(_metrics(spark, folder))


@query(
    "g13_quality_gate",
    """WITH c AS (SELECT count(*) FILTER (WHERE n_chars >= 400 AND quality = 1) AS tp, count(*) FILTER (WHERE n_chars >= 400 AND quality <> 1) AS fp,
         count(*) FILTER (WHERE n_chars < 400 AND quality = 1) AS fn FROM labels JOIN documents USING (doc_id))
       SELECT *, round(tp / (tp + fp), 3) AS precision, round(tp / (tp + fn), 3) AS recall,
         round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 3) AS f1 FROM c""",
)
def quality_gate(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "n_chars")
    rows = table(spark, folder, "labels").join(docs, "doc_id")
    return evaluation.confusion(F.col("n_chars") >= 400, F.col("quality") == 1, rows)


# ------------------------------------------------------------------- matrix
@query(
    "j1_matrix",
    f"""{OFFERS} SELECT company_name, product_name, source_url, tier_name, input_price, output_price, CAST(NULL AS DOUBLE) AS cache_price, context_tokens
        FROM offers WHERE run = 'R2'""",
)
def flat_matrix(spark, folder):
    return matrix.flatten(_records(spark, folder))


@query(
    "j2_printable_matrix",
    f"""{OFFERS}, r AS (SELECT *, row_number() OVER (PARTITION BY company_name ORDER BY tier_name) - 1 AS pos FROM offers WHERE run = 'R2' AND company_name NOT LIKE '%9')
        SELECT company_name, CAST(pos AS BIGINT) AS pos, CASE WHEN pos = 0 THEN company_name ELSE '' END AS company_shown, tier_name AS tier,
          '$' || CAST(CAST(input_price AS DECIMAL(18,2)) AS VARCHAR) AS input, coalesce('$' || CAST(CAST(output_price AS DECIMAL(18,2)) AS VARCHAR), 'N/A') AS output,
          'Pay-as-you-go' AS monthly FROM r
        UNION ALL SELECT DISTINCT company_name, CAST(0 AS BIGINT), company_name, '(No tiers)', '-', '-', '-' FROM offers WHERE run = 'R2' AND company_name LIKE '%9'""",
)
def printable_matrix(spark, folder):
    tiers = F.filter("pricing_tiers", lambda t: ~F.endswith("company_name", F.lit("9")))
    return matrix.printable(_records(spark, folder).withColumn("pricing_tiers", tiers))


@query("j3_distinct_companies", "SELECT DISTINCT s_name AS company_name FROM supplier JOIN lineitem ON s_suppkey = l_suppkey")
def distinct_companies(spark, folder):
    # keys first: the shuffle carries one row per supplier and task
    used = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("s_suppkey")).distinct()
    return table(spark, folder, "supplier").join(used, "s_suppkey", "left_semi").select(F.col("s_name").alias("company_name")).distinct()


@query(
    "c11_matrix_search",
    f"""{OFFERS} SELECT company_name, tier_name, run FROM offers WHERE contains(lower(company_name), 'promo')
        OR contains(lower(tier_name), 'promo') OR contains(lower(product_name), 'promo')""",
)
def matrix_search(spark, folder):
    return matrix.search(B.offers(spark, folder), " PROMO ").select("company_name", "tier_name", "run")


@query(
    "i5_matrix_sort",
    f"""{OFFERS} SELECT company_name, tier_name, output_price, row_number() OVER (ORDER BY output_price ASC NULLS LAST, company_name, tier_name) AS position
        FROM offers WHERE run = 'R2'""",
)
def matrix_sort(spark, folder):
    rows = _run(spark, folder, "R2").select("company_name", "tier_name", "output_price")
    order = [F.col("output_price").asc_nulls_last(), F.col("company_name"), F.col("tier_name")]
    return matrix.sort_rows(skew.numbered(rows, [], order, "position"), "output_asc")


@query(
    "g15_dashboard_kpis",
    f"""{OFFERS} SELECT count(DISTINCT company_name) AS companies, count(*) AS tiers,
        round(CAST(sum(CAST(input_price AS DECIMAL(18,4))) AS DOUBLE) / count(input_price), 2) AS avg_input_price FROM offers WHERE run = 'R2'""",
)
def dashboard_kpis(spark, folder):
    return matrix.kpis(_run(spark, folder, "R2"))


@query(
    "h6_comparison_strip",
    f"""{OFFERS} SELECT company_name, tier_name, '$' || CAST(CAST(input_price AS DECIMAL(18,2)) AS VARCHAR) AS input,
        coalesce('$' || CAST(CAST(output_price AS DECIMAL(18,2)) AS VARCHAR), '—') AS output, CAST(CAST(context_tokens / 1000 AS DECIMAL(18,0)) AS VARCHAR) || 'K' AS context
        FROM (SELECT *, row_number() OVER (PARTITION BY company_name ORDER BY tier_name) AS r FROM offers WHERE run = 'R2') WHERE r <= 2""",
)
def comparison_strip(spark, folder):
    return matrix.comparison_strip(_records(spark, folder))


# ------------------------------------------------------------------ reports
def _report_offers(spark, folder):
    return _run(spark, folder, "R2").withColumn("cache_price", F.lit(None).cast("double")).withColumn(
        "extraction_confidence", F.lit(0.9)
    )


MATRIX_LINE = (
    "'| ' || company_name || ' | ' || tier_name || ' | $' || CAST(CAST(input_price AS DECIMAL(18,2)) AS VARCHAR) || ' | ' "
    "|| coalesce('$' || CAST(CAST(output_price AS DECIMAL(18,2)) AS VARCHAR), '—') || ' | — | ' || format('{:,}', context_tokens) || ' | 90% |'"
)
CHANGE_LINE = (
    "'| ' || competitor_name || ' | ' || delta_type || ' | ' || metric_name || ' | ' || coalesce(old_value, 'N/A') || ' → ' || new_value || ' | ' "
    "|| CASE strategic_severity WHEN 'LOW' THEN '🟢' WHEN 'MEDIUM' THEN '🟡' WHEN 'HIGH' THEN '🟠' ELSE '🔴' END || ' ' || strategic_severity || ' |'"
)


@query("n1_matrix_lines", f"{OFFERS} SELECT company_name, tier_name, {MATRIX_LINE} AS line FROM offers WHERE run = 'R2'")
def matrix_lines(spark, folder):
    return reports.matrix_lines(_report_offers(spark, folder))


@query("n2_change_lines", f"{DELTAS} SELECT competitor_name, metric_name, {CHANGE_LINE} AS line FROM deltas")
def change_lines(spark, folder):
    return reports.change_lines(_deltas(spark, folder))


ADVICE_SQL = """
advice AS (SELECT *, row_number() OVER (ORDER BY category, title, rationale) AS number FROM (
  SELECT category, title, rationale, actionable_next_step, sources, corroboration_count FROM macro
  UNION ALL SELECT category, title, rationale, actionable_next_step, sources, corroboration_count FROM tiers)),
advice_lines AS (SELECT number, CAST(line_no AS BIGINT) AS line_no, CASE line_no WHEN 1 THEN '### ' || number || '. [' || category || '] ' || title
    WHEN 3 THEN '**Rationale:** ' || rationale WHEN 5 THEN '**Action:** ' || actionable_next_step
    WHEN 7 THEN '**Corroboration (' || corroboration_count || ' sources):** ' || array_to_string(list_transform(sources, lambda x: '[Source](' || x || ')'), ', ') ELSE '' END AS line
  FROM advice, generate_series(1, 8) v(line_no))
"""


@query("n3_advice_lines", f"{DELTAS}, {MACRO_SQL}, {ADVICE_SQL} SELECT number, line_no, line FROM advice_lines")
def advice_lines(spark, folder):
    return reports.advice_lines(strategy.rule_based(_run(spark, folder, "R2"), _deltas(spark, folder)))


GENERATED = "2024-01-31 00:00 UTC"


def _stages(spark, folder):
    """Offers of the present run and changes, as a run stores them: offers of both runs are computed once."""
    both = materialize(B.offers(spark, folder), "offers")
    return both.filter(F.col("run") == "R2"), materialize(deltas.tier_diff_of_runs(both, "R1", "R2"), "deltas")


def _report(spark, folder):
    # the stage tables of a run are written once and read by every section
    offers = materialize(_report_offers(spark, folder), "offers")
    changes = materialize(_deltas(spark, folder), "deltas")
    sections = {
        reports.SUMMARY: strategy.executive_lines(offers.select("company_name").distinct(), changes).select(
            F.concat_ws(" ", F.when(F.col("kind") == "summary", "0").otherwise("1"), "line").alias("sort_key"), "line"
        ),
        reports.MATRIX: reports.matrix_lines(offers).select(F.concat_ws(" ", "company_name", "tier_name").alias("sort_key"), "line"),
        reports.CHANGES: reports.change_lines(changes).select(F.concat_ws(" ", "competitor_name", "metric_name").alias("sort_key"), "line"),
        reports.ADVICE: reports.advice_lines(strategy.rule_based(offers, changes)).select(
            reports.numbered_key(F.col("number"), F.col("line_no")).alias("sort_key"), "line"
        ),
        reports.CARDS: reports.card_lines(strategy.cards(offers)).select(
            F.concat_ws(" ", "competitor", reports.numbered_key(F.col("line_no"))).alias("sort_key"), "line"
        ),
        reports.CITATIONS: reports.citation_lines(
            offers.select("company_name", "source_url", "extraction_confidence").distinct(), "source_url", GENERATED
        ).select(reports.numbered_key(F.col("idx")).alias("sort_key"), "line"),
    }
    analyzed = offers.select("company_name").distinct()
    return reports.report("run-R2", "# Competitive Intelligence Report", sections, GENERATED, "B2B AI Developer Platforms", analyzed)


def _section_sql(no: int, body: str, heads: tuple[str, ...] = ()) -> str:
    fixed = ["---", reports.TITLES[no], "", *heads]
    rows = ", ".join(f"({i}, {_quoted(line)})" for i, line in enumerate(fixed))
    return f"""SELECT {no} AS section_no, ' ' || i AS sort_key, line FROM (VALUES {rows}) v(i, line) UNION ALL SELECT {no}, '~', ''
      UNION ALL SELECT {no}, '.' || sort_key, line FROM ({body})"""


REPORT_SQL = f"""
report AS (
  SELECT 1 AS section_no, i AS sort_key, line FROM (VALUES ('0', '# Competitive Intelligence Report'), ('1', ''), ('2', '**Pipeline:** `run-R2`  '),
    ('3', '**Generated:** {GENERATED}  '), ('4', '**Vertical:** B2B AI Developer Platforms  '), ('6', '')) v(i, line)
  UNION ALL SELECT 1, '5', '**Sources Analyzed:** ' || (SELECT count(DISTINCT company_name) FROM offers WHERE run = 'R2') || '  '
  UNION ALL SELECT 8, '0', '---' UNION ALL SELECT 8, '1', {_quoted(reports.DISCLAIMER)}
  UNION ALL {_section_sql(reports.SUMMARY, f"""SELECT CASE WHEN kind = 'summary' THEN '0 ' ELSE '1 ' END || line AS sort_key, line FROM (
      SELECT 'summary' AS kind, 'Analyzed ' || (SELECT count(DISTINCT company_name) FROM offers WHERE run = 'R2') || ' competitor product(s) across '
        || (SELECT count(DISTINCT company_name) FROM offers WHERE run = 'R2') || ' companies. Detected ' || count(*) || ' market changes ('
        || count(*) FILTER (WHERE strategic_severity = 'CRITICAL') || ' critical, ' || count(*) FILTER (WHERE strategic_severity = 'HIGH')
        || ' high severity). ' AS line FROM deltas UNION ALL SELECT DISTINCT 'company', company_name FROM offers WHERE run = 'R2')""")}
  UNION ALL {_section_sql(reports.MATRIX, f"SELECT company_name || ' ' || tier_name AS sort_key, {MATRIX_LINE} AS line FROM offers WHERE run = 'R2'", reports.MATRIX_HEAD)}
  UNION ALL {_section_sql(reports.CHANGES, f"SELECT competitor_name || ' ' || metric_name AS sort_key, {CHANGE_LINE} AS line FROM deltas", reports.CHANGES_HEAD)}
  UNION ALL {_section_sql(reports.ADVICE, "SELECT printf('%012d %012d', number, line_no) AS sort_key, line FROM advice_lines")}
  UNION ALL {_section_sql(reports.CARDS, """SELECT competitor || ' ' || printf('%012d', no) AS sort_key, line FROM (
      SELECT competitor, CASE WHEN part = 'our_advantages' THEN line_no + 3 ELSE 1000 END AS no, CASE WHEN part = 'our_advantages' THEN '- ✅ ' ELSE '**Recommended Talk Track:** ' END || line AS line FROM cards
      UNION ALL SELECT DISTINCT competitor, 0, '### vs. ' || competitor FROM cards UNION ALL SELECT DISTINCT competitor, 1, '' FROM cards
      UNION ALL SELECT DISTINCT competitor, 1001, '' FROM cards UNION ALL SELECT DISTINCT competitor, 2, '**Where We Win:**' FROM cards WHERE part = 'our_advantages'
      UNION ALL SELECT DISTINCT competitor, 999, '' FROM cards WHERE part = 'our_advantages')""")}
  UNION ALL {_section_sql(reports.CITATIONS, f"""SELECT printf('%012d', idx) AS sort_key, '[^' || idx || ']: ' || company_name || ' — ' || source_url || ' (Accessed {GENERATED}, Confidence: 0.90)' AS line
      FROM (SELECT *, row_number() OVER (ORDER BY source_url) AS idx FROM (SELECT DISTINCT company_name, source_url FROM offers WHERE run = 'R2'))""")})
"""


@query("n4_report", f"{DELTAS}, {MACRO_SQL}, {ADVICE_SQL}, {LINES_SQL}, {REPORT_SQL} SELECT 'run-R2' AS pipeline_id, section_no, sort_key, line FROM report")
def report(spark, folder):
    return _report(spark, folder)


@query(
    "b7_report_files",
    f"""{DELTAS}, {MACRO_SQL}, {ADVICE_SQL}, {LINES_SQL}, {REPORT_SQL} SELECT 'report_20240131_run-R2.md' AS file, count(*) AS lines, md5(string_agg(line, chr(10) ORDER BY section_no, sort_key, line)) AS text_md5 FROM report""",
)
def report_files(spark, folder):
    path = scratch_path(spark, "reports")
    sinks.report(_report(spark, folder), path, F.lit("2024-01-31").cast("date"))
    # the file is read back to see the order of its lines
    return sinks.report_digests(spark, path)


# -------------------------------------------------------------------- sinks
@query(
    "b4_to_json",
    f"{OFFERS} SELECT company_name, tier_name, run, CAST(to_json(features) AS VARCHAR) AS features_json FROM offers",
)
def to_json(spark, folder):
    return B.offers(spark, folder).select("company_name", "tier_name", "run", *sinks.as_json("features"))


@query(
    "b6_csv_export",
    f"{OFFERS} SELECT company_name, tier_name, run, input_price, output_price, context_tokens FROM offers",
)
def csv_export(spark, folder):
    rows = B.offers(spark, folder).select("company_name", "tier_name", "run", "input_price", "output_price", "context_tokens")
    path = scratch_path(spark, "csv")
    sinks.csv(rows, path)
    return spark.read.schema(rows.schema).option("header", True).csv(path)


@query(
    "b8_json_payload",
    f"""{DELTAS}, {MACRO_SQL}, {ADVICE_SQL}, {LINES_SQL}, parts AS (
        SELECT 'head' AS part, 'R2' AS a, '{GENERATED}' AS b, CAST(0 AS BIGINT) AS n
        UNION ALL SELECT 'executive_summary', kind, line, 0 FROM (SELECT 'company' AS kind, company AS line FROM ({ALL_COMPANIES}))
        UNION ALL SELECT 'executive_summary', 'summary', 'Analyzed ' || (SELECT count(*) FROM ({ALL_COMPANIES})) || ' competitor product(s) across ' || (SELECT count(*) FROM ({ALL_COMPANIES})) || ' companies. Detected '
          || count(*) || ' market changes (' || count(*) FILTER (WHERE strategic_severity = 'CRITICAL') || ' critical, ' || count(*) FILTER (WHERE strategic_severity = 'HIGH') || ' high severity). ', 0 FROM deltas
        UNION ALL SELECT 'competitors', company_name, any_value(source_url), count(*) FROM offers WHERE run = 'R2' GROUP BY 2
        UNION ALL SELECT 'market_deltas', competitor_name, metric_name || ' ' || delta_type, 0 FROM deltas
        UNION ALL SELECT 'recommendations', title, rationale, len(sources) FROM advice
        UNION ALL SELECT 'battlecards', competitor, line, line_no FROM cards)
        SELECT 'rpt_' || substring(sha256('R2'), 1, 12) AS report_id, part, a, b, n FROM parts""",
)
def json_payload(spark, folder):
    offers, changes = _stages(spark, folder)
    docs = sinks.payload(F.lit("R2"), F.lit(GENERATED), {
        "executive_summary": strategy.executive_lines(offers.select("company_name").distinct(), changes),
        "competitors": B.records(offers.drop("features")).drop("run"),
        "market_deltas": changes,
        "recommendations": strategy.rule_based(offers, changes),
        "battlecards": strategy.cards(offers),
    })

    # one look at each document gives all its fields as texts
    fields = [
        "pipeline_id", "kind", "company_name", "competitor_name", "title", "competitor", "generated_at", "rationale", "line", "source_url",
        "metric_name", "delta_type", "pricing_tiers", "corroborating_sources", "line_no",
    ]
    docs = docs.select("report_id", "part", F.json_tuple("payload", *fields).alias(*fields))

    def count(name):
        return F.coalesce(F.json_array_length(name), F.lit(0))

    a = F.coalesce(*fields[:6])
    b = F.coalesce("generated_at", "rationale", "line", "source_url", F.concat("metric_name", F.lit(" "), "delta_type"))
    n = F.when(F.col("part") == "competitors", count("pricing_tiers")).when(F.col("part") == "recommendations", count("corroborating_sources"))
    n = n.when(F.col("part") == "battlecards", F.col("line_no").cast("int")).otherwise(0)
    return docs.select("report_id", "part", a.alias("a"), b.alias("b"), n.cast("bigint").alias("n"))


@query(
    "k7_workload_costs",
    """WITH v AS (SELECT event_id, CAST(ceil(value) AS BIGINT) AS m FROM events),
       w AS (SELECT * FROM (VALUES ('general', 0.25::DOUBLE * 3.8 + 0.65::DOUBLE * 0.3 + 0.1::DOUBLE * 0.65), ('reasoning', 0.6::DOUBLE * 3.8 + 0.3::DOUBLE * 0.3 + 0.1::DOUBLE * 0.65),
         ('extraction', 0.05::DOUBLE * 3.8 + 0.9::DOUBLE * 0.3 + 0.05::DOUBLE * 0.65), ('interactive', 0.15::DOUBLE * 3.8 + 0.35::DOUBLE * 0.3 + 0.5::DOUBLE * 0.65)) t(workload, rate)),
       c AS (SELECT event_id, m AS volume_millions, workload, CAST(floor(m * 4.5::DOUBLE + 0.5) AS BIGINT) AS unoptimized, CAST(floor(m * rate + 0.5) AS BIGINT) AS optimized FROM v, w)
       SELECT *, greatest(0, unoptimized - optimized) AS monthly_savings, CAST(floor(greatest(0, unoptimized - optimized) / nullif(unoptimized, 0) * 100 + 0.5) AS BIGINT) AS savings_percent,
         greatest(0, unoptimized - optimized) * 12 AS annual_savings FROM c""",
)
def workload_costs(spark, folder):
    volumes = table(spark, folder, "events").select("event_id", F.ceil("value").cast("bigint").alias("volume_millions"))
    return matrix.workload_costs(volumes)
