"""The comparison matrix: flatten, filter, sort, totals, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions import text as T

# ---- fixed values ----
DEFAULT_TIER = "Standard Tier"
NO_TIERS = "(No tiers)"
HIGH_IMPACT = 0.8
BASELINE_RATE = 4.5
STACK_RATES = {"frontier": 3.8, "utility": 0.3, "realtime": 0.65}
WORKLOADS = (
    ("general", 0.25, 0.65, 0.10),
    ("reasoning", 0.60, 0.30, 0.10),
    ("extraction", 0.05, 0.90, 0.05),
    ("interactive", 0.15, 0.35, 0.50),
)
# ---- end of fixed values ----


def flatten(records: DataFrame, position: str | None = None) -> DataFrame:
    """One row per record and tier; records without tiers vanish. ``position`` names a column for the tier's place in its record."""
    places = [F.col("place").alias(position)] if position else []
    return records.select("company_name", "product_name", "source_url", F.posexplode("pricing_tiers").alias("place", "t")).select(
        *places,
        "company_name",
        "product_name",
        "source_url",
        F.coalesce("t.model_or_tier_name", F.lit(DEFAULT_TIER)).alias("tier_name"),
        F.col("t.input_price_per_m_tokens").alias("input_price"),
        F.col("t.output_price_per_m_tokens").alias("output_price"),
        F.col("t.cache_read_price_per_m_tokens").alias("cache_price"),
        F.col("t.context_window_tokens").alias("context_tokens"),
    )


def printable(records: DataFrame) -> DataFrame:
    """Display rows; the company stands on its first tier only, and records without tiers stay."""
    rows = records.select("company_name", F.posexplode_outer("pricing_tiers").alias("pos", "t"))
    has_tier = F.col("t").isNotNull()

    def cell(field: str, absent: str) -> Column:
        return F.when(has_tier, T.money(F.col(f"t.{field}"), absent=absent)).otherwise("-")

    return rows.select(
        F.col("company_name"),
        F.coalesce("pos", F.lit(0)).cast("bigint").alias("pos"),
        F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("company_name")).otherwise("").alias("company_shown"),
        F.when(has_tier, F.coalesce("t.model_or_tier_name", F.lit("Standard"))).otherwise(NO_TIERS).alias("tier"),
        cell("input_price_per_m_tokens", "N/A").alias("input"),
        cell("output_price_per_m_tokens", "N/A").alias("output"),
        cell("base_price_monthly", "Pay-as-you-go").alias("monthly"),
    )


def search(matrix: DataFrame, words: str = "", company: str = "ALL") -> DataFrame:
    """Rows of one company (or ALL) whose company, tier or product contains the words."""
    needle = F.lit(words.strip().lower())
    hit = F.contains(F.lower("company_name"), needle) | F.contains(F.lower("tier_name"), needle)
    hit = hit | F.contains(F.lower("product_name"), needle)
    rows = matrix if company == "ALL" else matrix.filter(F.lower("company_name") == company.lower())
    return rows.filter(hit) if words.strip() else rows


def sort_rows(matrix: DataFrame, by: str) -> DataFrame:
    """Sort for display; a missing price comes last whichever way the sort runs."""
    orders = {
        "input_asc": F.col("input_price").asc_nulls_last(),
        "input_desc": F.col("input_price").desc_nulls_last(),
        "output_asc": F.col("output_price").asc_nulls_last(),
        "name": F.col("tier_name").asc(),
    }
    return matrix.orderBy(orders[by], "company_name", "tier_name")


def kpis(matrix: DataFrame) -> DataFrame:
    """Companies, tiers and mean input price; averaged in decimal, so order does not matter."""
    price = F.col("input_price").cast("decimal(18,4)")
    per_company = matrix.groupBy("company_name").agg(
        F.count(F.lit(1)).alias("tiers"), F.sum(price).alias("total"), F.count("input_price").alias("priced")
    )
    return per_company.agg(
        F.count(F.lit(1)).alias("companies"),
        F.sum("tiers").cast("bigint").alias("tiers"),
        F.round(F.try_divide(F.sum("total").cast("double"), F.sum("priced")), 2).alias("avg_input_price"),
    )


def comparison_strip(records: DataFrame, tiers: int = 2) -> DataFrame:
    """The first tiers of every record for a quick comparison."""
    short = records.withColumn("pricing_tiers", F.slice("pricing_tiers", 1, tiers))
    return flatten(short).select(
        "company_name", "tier_name", T.money(F.col("input_price")).alias("input"),
        T.money(F.col("output_price")).alias("output"), T.kilo(F.col("context_tokens")).alias("context"),
    )


def _mentions(col: Column, *words: str) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(F.lower(col), F.lit(word))
    return hit


def classify_insights(insights: DataFrame, kind: Column, confidence: Column, high: float = HIGH_IMPACT,
                      pricing=("price", "margin"), amber=("price", "war"), green=("margin", "opportunity")) -> DataFrame:
    """Badge, PRICING or TECH group and impact of each insight by keywords in its type."""
    badge = F.when(_mentions(kind, *amber), "amber").when(_mentions(kind, *green), "green").otherwise("purple")
    group = F.when(_mentions(kind, *pricing), "PRICING").otherwise("TECH")
    impact = F.when(confidence > high, "High").otherwise("Medium")
    return insights.withColumn("badge", badge).withColumn("insight_group", group).withColumn("impact", impact)


def _whole(amount: Column) -> Column:
    """Round half up to a whole number."""
    return F.floor(amount + 0.5).cast("bigint")


def workload_costs(volumes: DataFrame, volume: str = "volume_millions") -> DataFrame:
    """Costs and savings of each workload mix for each volume; the four mixes are part of the plan."""
    mixes = F.array(
        *[
            F.struct(
                F.lit(name).alias("workload"),
                F.lit(f * STACK_RATES["frontier"] + u * STACK_RATES["utility"] + r * STACK_RATES["realtime"]).alias("rate"),
            )
            for name, f, u, r in WORKLOADS
        ]
    )
    rows = volumes.withColumn("mix", F.explode(mixes))
    plain = rows.withColumn("unoptimized", _whole(F.col(volume) * BASELINE_RATE)).withColumn(
        "optimized", _whole(F.col(volume) * F.col("mix.rate"))
    )
    saved = F.greatest(F.lit(0).cast("bigint"), F.col("unoptimized") - F.col("optimized"))
    return (
        plain.withColumn("monthly_savings", saved)
        .withColumn("savings_percent", _whole(F.try_divide("monthly_savings", "unoptimized") * 100))
        .withColumn("annual_savings", F.col("monthly_savings") * 12)
        .withColumn("workload", F.col("mix.workload"))
        .drop("mix")
    )


def stage_costs(usage: DataFrame, rates: dict[str, float]) -> DataFrame:
    """Tokens and cost per stage plus the total row (stage null); ``usage``: stage, tokens (whole)."""
    rate = F.lit(None).cast("double")
    for stage, per_million in rates.items():
        rate = F.when(F.col("stage") == stage, per_million).otherwise(rate)
    priced = usage.groupBy("stage").agg(F.sum("tokens").cast("bigint").alias("tokens")).withColumn(
        "cost", F.round(F.col("tokens") * F.coalesce(rate, F.lit(0.0)) / 1e6, 6).cast("decimal(20,6)")
    )
    return priced.rollup("stage").agg(
        F.sum("tokens").cast("bigint").alias("tokens"), F.sum("cost").cast("double").alias("cost")
    )
