"""Chat and instruction samples from pages and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions import text as T

SYSTEM_PROMPT = (
    "You read a web page and state the company's products and prices as one JSON object. "
    "Give null for a price the page does not state, and an empty list of tiers for a page without prices."
)

# ---- fixed values ----
USER_HEAD = "Extract structured pricing from the following web DOM excerpt:"
TARGET_DEFAULTS = (
    ("company_name", "Unknown"),
    ("product_name", "Standard API"),
    ("source_url", ""),
    ("pricing_tiers", None),
    ("enterprise_terms_mentioned", False),
    ("rate_limits_summary", None),
    ("citation_text", ""),
)
# ---- end of fixed values ----


def target_json(df: DataFrame) -> Column:
    """The record fields of the row as JSON, absent ones defaulted, nulls written out."""
    fields = []
    for name, default in TARGET_DEFAULTS:
        if name in df.columns:
            value = F.col(name) if default is None else F.coalesce(F.col(name), F.lit(default))
        elif name == "pricing_tiers":
            value = F.array().cast("array<string>")
        else:
            value = F.lit(default).cast("string") if default is None else F.lit(default)
        fields.append(value.alias(name))
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def all_samples(positives: DataFrame, negatives: DataFrame | None = None) -> DataFrame:
    """Positives and, if given, negatives; rows without a page (``dom``, else ``input_dom``) are left out."""
    rows = positives if negatives is None else positives.unionByName(negatives, allowMissingColumns=True)
    dom = F.coalesce(F.when(F.col("dom") != "", F.col("dom")), F.col("input_dom")) if "input_dom" in rows.columns else F.col("dom")
    return rows.withColumn("dom", dom).filter(F.coalesce(F.col("dom"), F.lit("")) != "")


def chat_samples(samples: DataFrame, system: str = SYSTEM_PROMPT) -> DataFrame:
    """``messages`` of system, user and assistant per sample."""
    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    page = F.concat(F.lit(USER_HEAD + "\n\n```html\n"), T.strip_edges(F.col("dom")), F.lit("\n```"))
    return samples.select(
        "sample_id",
        F.array(message("system", F.lit(system)), message("user", page), message("assistant", target_json(samples))).alias("messages"),
    )


def instruction_samples(samples: DataFrame, system: str = SYSTEM_PROMPT) -> DataFrame:
    """``instruction, input, output`` per sample."""
    return samples.select(
        "sample_id", F.lit(system).alias("instruction"), T.strip_edges(F.col("dom")).alias("input"),
        target_json(samples).alias("output"),
    )


def conversations(turns: DataFrame, turns_per_part: int = 1000) -> DataFrame:
    """Turn rows to ordered ``messages`` arrays.

    A conversation of any length is cut into parts of bounded length, so no
    row grows without limit; short ones have the single part 0.
    """
    part = F.floor(F.col("turn") / turns_per_part).cast("bigint")
    entry = F.struct("turn", "role", F.col("text").alias("content"))
    return (
        turns.groupBy("conv_id", part.alias("part"))
        .agg(F.array_sort(F.collect_list(entry)).alias("entries"))
        .select(
            "conv_id", "part",
            F.transform("entries", lambda e: F.struct(e["role"].alias("role"), e["content"].alias("content"))).alias("messages"),
        )
    )
