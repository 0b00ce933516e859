"""Change detection between snapshots, crawls and runs.

``offers`` here means one row per company and tier:
``company_name, product_name, tier_name, input_price, output_price``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions import prices as P
from marketloom.functions import text as T
from marketloom.operators import skew


def first_of_company(history: DataFrame, position: str, newest: bool = True) -> DataFrame:
    """One historical record per company: the latest, or the first as listed."""
    return skew.latest(history, ["company_name"], [position], newest)


def match_history(current: DataFrame, history: DataFrame, position: str, newest: bool = True) -> DataFrame:
    """Current records with their company's historical tiers (null if there are none)."""
    past = first_of_company(history, position, newest).select(
        "company_name", F.col(position).alias("history_position"), F.col("pricing_tiers").alias("history_tiers")
    )
    return current.join(past, "company_name", "left")


def unique_tiers(offers: DataFrame, position: str | None = None) -> DataFrame:
    """One row per company and tier; the last position wins when a tier repeats."""
    keys = ["company_name", "tier_name"]
    return skew.latest(offers, keys, [position]) if position else offers


def tier_diff(old: DataFrame, new: DataFrame, position: str | None = None) -> DataFrame:
    """Price changes, removed and new tiers between two sets of tiers.

    With ``position`` a repeated tier counts as its last listing; without it tiers must be unique.
    """
    old, new = unique_tiers(old, position), unique_tiers(new, position)
    return tier_diff_of_runs(
        old.withColumn("run", F.lit("old")).unionByName(new.withColumn("run", F.lit("new")), allowMissingColumns=True),
        "old",
        "new",
    )


def tier_diff_of_runs(offers: DataFrame, old: str, new: str) -> DataFrame:
    """Price changes, removed and new tiers between two runs of one table (column ``run``).

    The full outer match is a single aggregate over the tagged rows: one scan,
    one shuffle, combined on the map side. Companies seen in one run only yield
    nothing, as there is no history to compare with; they are found on the
    aggregate's output, whose exchange both branches share.
    """
    is_old, is_new = F.col("run") == old, F.col("run") == new
    keys = ["company_name", "tier_name"]
    sides = ((is_old, "old"), (is_new, "new"))
    # all in one array: both readers below then need the same column and share one exchange
    flags = [F.max(side).cast("double") for side, _ in sides]
    values = [F.max(F.when(side, F.col(c))) for side, _ in sides for c in ("input_price", "output_price")]
    cells = offers.filter(is_old | is_new).groupBy(*keys).agg(
        # the product's name as the new run has it
        F.coalesce(F.max(F.when(is_new, F.col("product_name"))), F.max("product_name")).alias("product_name"), F.array(*flags, *values).alias("v")
    )
    both = (
        cells.groupBy("company_name")
        .agg(F.max(F.col("v")[0]).alias("o"), F.max(F.col("v")[1]).alias("n"))
        .filter("o = 1 AND n = 1")
        .select("company_name")
    )
    slots = ("in_old", "in_new", "input_old", "output_old", "input_new", "output_new")
    paired = skew.join(cells, both, ["company_name"], "left_semi").select(
        *keys, "product_name", *[F.col("v")[i].alias(slot) for i, slot in enumerate(slots)]
    )
    kind = F.when(F.col("in_new") == 0, "TIER_REMOVED").when(F.col("in_old") == 0, "NEW_TIER")

    def price_row(metric: str, field: str) -> Column:
        return F.struct(
            F.lit(metric).alias("metric"), F.col(f"{field}_old").alias("old"), F.col(f"{field}_new").alias("new")
        )

    nothing = F.struct(
        F.lit(None).cast("string").alias("metric"),
        F.lit(None).cast("double").alias("old"),
        F.lit(None).cast("double").alias("new"),
    )
    rows = F.when(kind.isNotNull(), F.array(nothing)).otherwise(
        F.array(price_row("_input_price", "input"), price_row("_output_price", "output"))
    )
    flat = paired.select(*keys, "product_name", kind.alias("kind"), F.explode(rows).alias("c")).filter(
        F.col("kind").isNotNull() | (F.col("c.old") != F.col("c.new"))
    )
    old_price, new_price = F.col("c.old"), F.col("c.new")
    tier = F.col("tier_name")
    removed, added = F.col("kind") == "TIER_REMOVED", F.col("kind") == "NEW_TIER"
    return flat.select(
        F.col("company_name").alias("competitor_name"),
        "product_name",
        F.coalesce("kind", P.direction(old_price, new_price)).alias("delta_type"),
        F.when(F.col("kind").isNotNull(), tier).otherwise(F.concat(tier, F.col("c.metric"))).alias("metric_name"),
        F.when(removed, tier).when(~added | added.isNull(), T.money(old_price, "/1M")).alias("old_value"),
        F.when(removed, "REMOVED")
        .when(added, F.concat(F.lit("NEW: "), tier))
        .otherwise(T.money(new_price, "/1M"))
        .alias("new_value"),
        F.round(P.percent_change(old_price, new_price), 1).alias("percentage_change"),
        F.when(F.col("kind").isNotNull(), "MEDIUM").otherwise(P.severity(old_price, new_price)).alias(
            "strategic_severity"
        ),
    )


def delta_sentences(deltas: DataFrame) -> DataFrame:
    """``TYPE: metric old → new`` for each change."""
    sentence = F.concat(
        F.col("delta_type"), F.lit(": "), F.col("metric_name"), F.lit(" "),
        F.coalesce("old_value", F.lit("N/A")), F.lit(" → "), F.col("new_value"),
    )
    return deltas.select(
        "competitor_name", sentence.alias("summary_of_change"), F.col("strategic_severity").alias("impact_severity")
    )


def severity_rollup(deltas: DataFrame) -> DataFrame:
    """Counts by company, type and severity with subtotals (null = all)."""
    return deltas.rollup("competitor_name", "delta_type", "strategic_severity").agg(
        F.count(F.lit(1)).alias("changes"), F.grouping_id().cast("bigint").alias("level")
    )


def fallback(preferred: DataFrame, other: DataFrame) -> DataFrame:
    """``preferred``, or ``other`` when ``preferred`` has no row."""
    any_row = preferred.limit(1).select(F.lit(True).alias("__any"))
    spare = other.withColumn("__true", F.lit(True))
    spare = spare.join(F.broadcast(any_row), spare["__true"] == any_row["__any"], "left_anti").drop("__true")
    return preferred.unionByName(spare)


def changed_only(records: DataFrame, unchanged: DataFrame) -> DataFrame:
    """Records of companies that changed; all records when none did."""
    return fallback(records.join(unchanged, "company_name", "left_anti"), records)


def record_text(company: Column, product: Column, tiers: Column) -> Column:
    """Canonical text of a record, one line per tier."""

    def line(t):
        return F.concat_ws(
            " | ",
            F.concat(F.lit("Tier: "), t["model_or_tier_name"]),
            F.concat(F.lit("Input: $"), t["input_price_per_m_tokens"].cast("string"), F.lit("/1M")),
            F.concat(F.lit("Output: $"), t["output_price_per_m_tokens"].cast("string"), F.lit("/1M")),
            F.concat(F.lit("Context: "), t["context_window_tokens"].cast("string")),
        )

    return F.concat_ws(
        "\n",
        F.concat(F.lit("Company: "), company),
        F.concat(F.lit("Product: "), product),
        F.array_join(F.transform(tiers, line), "\n"),
    )


def repeated(df: DataFrame, keys: Sequence[str], position: str, history: DataFrame | None = None) -> DataFrame:
    """Add ``unchanged``: the same keys occurred earlier in this run or in ``history``.

    The earliest position per key is found by a partial aggregate, so a key
    with very many copies costs one row per map task.
    """
    first = df.groupBy(*keys).agg(F.min(position).alias("__first"))
    marked = skew.join(df, first, keys).withColumn("unchanged", F.col(position) != F.col("__first"))
    if history is not None:
        known = history.select(*keys).distinct().withColumn("__known", F.lit(True))
        marked = skew.join(marked, known, keys).withColumn(
            "unchanged", F.col("unchanged") | F.coalesce("__known", F.lit(False))
        ).drop("__known")
    return marked.drop("__first")


def price_series(runs: DataFrame, order: str = "run") -> DataFrame:
    """Previous price of each company and tier over many runs, with change and grade.

    There is one row per company, tier and run, so a window group is as long
    as the number of runs.
    """
    spec = Window.partitionBy("company_name", "tier_name").orderBy(order)
    old, new = F.col("previous_price"), F.col("input_price")
    return (
        runs.withColumn("previous_price", F.lag("input_price").over(spec))
        .withColumn("percentage_change", F.round(P.percent_change(old, new), 1))
        .withColumn("strategic_severity", F.when(old.isNotNull(), P.severity(old, new)))
    )


def exact_duplicates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per distinct content: its hash, the smallest id and the number of copies."""
    return (
        docs.select(key, T.content_hash(F.col(text)).alias("content_hash"))
        .groupBy("content_hash")
        .agg(F.min(key).alias(key), F.count(F.lit(1)).alias("copies"))
    )


def crawl_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """changed, unchanged, new or gone for every ``url`` of two crawls with ``content_hash``."""
    b = before.select("url", F.col("content_hash").alias("old_hash"))
    a = after.select("url", F.col("content_hash").alias("new_hash"))
    status = (
        F.when(F.col("old_hash").isNull(), "new")
        .when(F.col("new_hash").isNull(), "gone")
        .when(F.col("old_hash") == F.col("new_hash"), "unchanged")
        .otherwise("changed")
    )
    return b.join(a, "url", "full_outer").select("url", "old_hash", "new_hash", status.alias("status"))


def features_added(old: DataFrame, new: DataFrame) -> DataFrame:
    """FEATURE_ADDED rows: features of a tier that its old snapshot lacked."""
    keys = ["company_name", "tier_name"]
    o = old.select(*keys, F.col("features").alias("old_features"))
    gained = F.array_except("features", "old_features")
    return new.join(o, keys).select(
        F.col("company_name").alias("competitor_name"),
        F.lit("FEATURE_ADDED").alias("delta_type"),
        F.col("tier_name").alias("metric_name"),
        F.explode(gained).alias("new_value"),
    )
