"""Extraction quality against gold tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values ----
TOLERANCE = 0.05
TARGETS = (
    ("schema_validity_rate", 0.99, ">="),
    ("tier_precision", 0.90, ">="),
    ("tier_recall", 0.85, ">="),
    ("tier_f1", 0.88, ">="),
    ("avg_dom_grounding_ratio", 0.90, ">="),
    ("hallucination_rate", 0.05, "<="),
)
# ---- end of fixed values ----


def _close(a: Column, b: Column, tolerance: float) -> Column:
    both = a.isNotNull() & b.isNotNull() & (F.abs(a - b) <= tolerance)
    return (a.isNull() & b.isNull()) | both


def _price_cell(price: Column, tolerance: float) -> Column:
    """Grid cell of a price; null prices share one cell of their own."""
    return F.coalesce(F.floor(price / (tolerance * 1.001)).cast("bigint"), F.lit(-(2**62)))


def matched_tiers(predicted: DataFrame, gold: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Predicted tiers with some gold tier of the sample within the tolerance on both prices.

    The band becomes an equi-join: gold stands in its own cell of a grid as
    wide as the tolerance and a prediction looks into the three cells around
    its input price. No sample is compared pairwise. A tier name that a sample
    predicts several times counts each time.
    """
    cell = _price_cell(F.col("input_price"), tolerance)
    looks = F.when(F.col("input_price").isNull(), F.array(cell)).otherwise(F.array(cell - 1, cell, cell + 1))
    same = ["sample_id", "tier_name", "input_price", "output_price"]
    listed = predicted.groupBy(*same).agg(F.count(F.lit(1)).alias("times"))
    probe = listed.select(*same, "times", F.explode(looks).alias("cell"))
    target = gold.select(
        "sample_id", F.col("input_price").alias("g_in"), F.col("output_price").alias("g_out"), cell.alias("cell")
    ).distinct()
    condition = (
        (probe["sample_id"] == target["sample_id"])
        & (probe["cell"] == target["cell"])
        & _close(probe["input_price"], target["g_in"], tolerance)
        & _close(probe["output_price"], target["g_out"], tolerance)
    )
    found = probe.join(target, condition, "left_semi").select(*same, "times").distinct()
    return found.select("sample_id", "tier_name", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times"))).alias("copy")).drop("copy")


def per_sample(predicted: DataFrame, gold: DataFrame, grounding: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Tier counts per gold sample, with the grounding ratio, number of ungrounded fields and ``schema_valid`` of its prediction."""

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("sample_id").agg(F.count(F.lit(1)).alias(name))

    parts = (
        counted(gold, "gold_tiers")
        .join(counted(predicted, "pred_tiers"), "sample_id", "left")
        .join(counted(matched_tiers(predicted, gold, tolerance), "matched_tiers"), "sample_id", "left")
    )
    parts = parts.join(grounding.select("sample_id", "grounding_ratio", "ungrounded_count", "schema_valid"), "sample_id", "left")
    zero = ["pred_tiers", "matched_tiers", "ungrounded_count"]
    return parts.fillna(0, zero).fillna(0.0, ["grounding_ratio"])


def metrics(samples: DataFrame) -> DataFrame:
    """One row of micro precision, recall, F1, grounding and hallucination over all samples."""
    total = samples.agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.sum("gold_tiers").alias("gold_tiers"),
        F.sum("pred_tiers").alias("pred_tiers"),
        F.sum("matched_tiers").alias("matched_tiers"),
        F.sum("ungrounded_count").alias("hallucinated_values"),
        F.round(F.avg("grounding_ratio"), 3).alias("avg_dom_grounding_ratio"),
        F.round(F.coalesce(F.avg(F.col("schema_valid").cast("int")), F.lit(0.0)), 3).alias("schema_validity_rate"),
    )

    def share(part: str, whole: str, empty: float) -> Column:
        return F.round(F.coalesce(F.try_divide(part, whole), F.lit(empty)), 3)

    rated = (
        total.withColumn("tier_precision", share("matched_tiers", "pred_tiers", 1.0))
        .withColumn("tier_recall", share("matched_tiers", "gold_tiers", 1.0))
        .withColumn("hallucination_rate", share("hallucinated_values", "pred_tiers", 0.0))
    )
    p, r = F.col("tier_precision"), F.col("tier_recall")
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    whole = ["gold_tiers", "pred_tiers", "matched_tiers", "hallucinated_values"]
    return rated.withColumn("tier_f1", F.round(f1, 3)).select(
        "total_samples", *[F.col(c).cast("bigint").alias(c) for c in whole],
        *[name for name, _, _ in TARGETS],
    )


def status_table(metric_row: DataFrame) -> DataFrame:
    """metric, score, target and PASSED or WARNING."""
    cells = []
    for name, target, sense in TARGETS:
        ok = F.col(name) >= target if sense == ">=" else F.col(name) <= target
        cells.append(
            F.struct(
                F.lit(name).alias("metric"), F.col(name).alias("score"), F.lit(target).alias("target"),
                F.when(ok, "PASSED").otherwise("WARNING").alias("status"),
            )
        )
    return metric_row.select(F.explode(F.array(*cells)).alias("m")).select("m.*")


def confusion(predicted_flag: Column, gold_flag: Column, rows: DataFrame) -> DataFrame:
    """Precision, recall and F1 of a yes/no gate over labelled rows."""
    counts = rows.agg(
        F.count_if(predicted_flag & gold_flag).alias("tp"),
        F.count_if(predicted_flag & ~gold_flag).alias("fp"),
        F.count_if(~predicted_flag & gold_flag).alias("fn"),
    )
    p = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(1.0))
    r = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(1.0))
    return counts.select(
        "tp", "fp", "fn", F.round(p, 3).alias("precision"), F.round(r, 3).alias("recall"),
        F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 3).alias("f1"),
    )
