"""Report text as rows.

A report is a table of lines (pipeline_id, section_no, sort_key, line), never
one string: a run of any size stays distributed, and the sink sorts it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions import prices as P
from marketloom.functions import text as T
from marketloom.operators import skew
from marketloom.session import materialize

# ---- fixed values: section order and table heads ----
HEAD, SUMMARY, MATRIX, CHANGES, ADVICE, CARDS, CITATIONS, NOTE = range(1, 9)
TITLES = {
    SUMMARY: "## 📋 Executive Summary",
    MATRIX: "## 💰 Pricing Comparison Matrix",
    CHANGES: "## 📊 Detected Market Changes",
    ADVICE: "## 🎯 Strategic Recommendations",
    CARDS: "## ⚔️ Sales Battlecard Snippets",
    CITATIONS: "## 📝 Source Citations",
}
MATRIX_HEAD = (
    "| Company | Model/Tier | Input ($/1M tokens) | Output ($/1M tokens) | Cache Read ($/1M) | Context Window | Confidence |",
    "| :--- | :--- | :---: | :---: | :---: | :---: | :---: |",
)
CHANGES_HEAD = (
    "| Competitor | Change | Metric | Old → New | Severity |",
    "| :--- | :--- | :--- | :--- | :---: |",
)
RATIONALE, ACTION, CORROBORATION = "**Rationale:** ", "**Action:** ", "**Corroboration ("
VERSUS, WINS, TRACK = "### vs. ", "**Where We Win:**", "**Recommended Talk Track:** "
NO_MATRIX = "*No pricing data extracted in this run.*"
# ---- end of fixed values ----

DISCLAIMER = (
    "> *This report was generated automatically. All data points come from publicly available web pages and were checked "
    "against their text.*"
)


def _row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def matrix_lines(offers: DataFrame) -> DataFrame:
    """One Markdown table row per company and tier."""
    return offers.select(
        "company_name",
        "tier_name",
        _row(
            F.col("company_name"), F.col("tier_name"), T.money(F.col("input_price")), T.money(F.col("output_price")),
            T.money(F.col("cache_price")), T.grouped_int(F.col("context_tokens")), T.percent(F.col("extraction_confidence")),
        ).alias("line"),
    )


def change_lines(deltas: DataFrame) -> DataFrame:
    """One Markdown table row per change."""
    return deltas.select(
        "competitor_name",
        "metric_name",
        _row(
            F.col("competitor_name"), F.col("delta_type"), F.col("metric_name"),
            F.concat(F.coalesce("old_value", F.lit("N/A")), F.lit(" → "), F.col("new_value")),
            F.concat(P.severity_icon(F.col("strategic_severity")), F.lit(" "), F.col("strategic_severity")),
        ).alias("line"),
    )


def citations(records: DataFrame, order: str) -> DataFrame:
    """First index of each source url among the records in ``order``, whose values differ; indices may have gaps."""
    indexed = skew.numbered(records.select("source_url", "company_name", order), [], [order], "idx")
    return indexed.groupBy("source_url").agg(
        F.min("idx").alias("idx"), F.min_by("company_name", "idx").alias("company_name")
    )


def run_citations(records: DataFrame, run: str = "pipeline_id") -> DataFrame:
    """Distinct source urls per run, one row each."""
    return records.select(run, "source_url").distinct()


def advice_lines(recommendations: DataFrame) -> DataFrame:
    """Lines (number, line_no, line) of recommendations, numbered by category, title and rationale.

    ``corroborating_sources`` is an array; sources are linked.
    """
    key = ["category", "title", "rationale"]
    rows = skew.numbered(recommendations, [], key, "number")
    links = F.array_join(
        F.transform("corroborating_sources", lambda s: F.concat(F.lit("[Source]("), s, F.lit(")"))), ", "
    )

    def line(no: int, text: Column) -> Column:
        return F.struct(F.lit(no).cast("bigint").alias("line_no"), text.alias("line"))

    lines = F.array(
        line(1, F.concat(F.lit("### "), F.col("number").cast("string"), F.lit(". ["), F.col("category"), F.lit("] "), F.col("title"))),
        line(2, F.lit("")),
        line(3, F.concat(F.lit(RATIONALE), F.coalesce("rationale", F.lit("")))),
        line(4, F.lit("")),
        line(5, F.concat(F.lit(ACTION), F.coalesce("actionable_next_step", F.lit("")))),
        line(6, F.lit("")),
        line(7, F.concat(F.lit(CORROBORATION), F.col("corroboration_count").cast("string"), F.lit(" sources):** "), F.coalesce(links, F.lit("")))),
        line(8, F.lit("")),
    )
    return rows.select("number", F.explode(lines).alias("l")).select("number", "l.*")


def card_lines(cards: DataFrame) -> DataFrame:
    """Lines (competitor, line_no, line) of keyed battlecards: head, where we win, talk track.

    A competitor has one talk track, which brings the head along, and its first advantage brings the title of the advantages.
    """

    def lines(*pairs: tuple[Column | int, Column | str]) -> Column:
        made = [
            F.struct((no if isinstance(no, Column) else F.lit(no)).cast("bigint").alias("line_no"), (text if isinstance(text, Column) else F.lit(text)).alias("line"))
            for no, text in pairs
        ]
        return F.array(*made)

    won = (F.col("line_no") + 3, F.concat(F.lit("- ✅ "), F.col("line")))
    track = lines((0, F.concat(F.lit(VERSUS), F.col("competitor"))), (1, ""), (1000, F.concat(F.lit(TRACK), F.col("line"))), (1001, ""))
    first, later = lines((2, WINS), won, (999, "")), lines(won)
    listed = F.when(F.col("part") == "recommended_talk_track", track).when(F.col("line_no") == 1, first).otherwise(later)
    return cards.select("competitor", F.explode(listed).alias("l")).select("competitor", "l.*")


def citation_lines(records: DataFrame, order: str, accessed: str) -> DataFrame:
    """One footnote (idx, line) per source url, by its first record: company_name, source_url, extraction_confidence and ``order``."""
    needed = dict.fromkeys(["source_url", "company_name", "extraction_confidence", order])
    indexed = skew.numbered(records.select(*needed), [], [order], "idx")
    first = indexed.groupBy("source_url").agg(F.min(F.struct("idx", "company_name", "extraction_confidence")).alias("f"))
    line = F.concat(
        F.lit("[^"), F.col("f.idx").cast("string"), F.lit("]: "), F.col("f.company_name"), F.lit(" — "), F.col("source_url"),
        F.lit(f" (Accessed {accessed}, Confidence: "), P.two_decimals(F.col("f.extraction_confidence")), F.lit(")"),
    )
    return first.select(F.col("f.idx").alias("idx"), line.alias("line"))


def numbered_key(*parts: Column) -> Column:
    """A sort key of numbers, which sorts as they do."""
    return F.concat_ws(" ", *[F.lpad(p.cast("string"), 12, "0") for p in parts])


def report(run: str, title: str, sections: dict[int, DataFrame], generated: str, vertical: str, analyzed: DataFrame) -> DataFrame:
    """Lines of a whole report. Each section has ``sort_key, line``; an empty one is left out, but for the matrix.

    ``analyzed`` are the records the report is about. Head and section titles are a few fixed
    lines; the titles are kept by a semi-join on the sections that have any row.
    """
    spark = analyzed.sparkSession
    schema = "section_no int, sort_key string, line string"
    head = [
        (HEAD, "0", title), (HEAD, "1", ""), (HEAD, "2", f"**Pipeline:** `{run}`  "), (HEAD, "3", f"**Generated:** {generated}  "),
        (HEAD, "4", f"**Vertical:** {vertical}  "), (HEAD, "6", ""), (NOTE, "0", "---"), (NOTE, "1", DISCLAIMER),
    ]
    count = analyzed.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(HEAD).alias("section_no"), F.lit("5").alias("sort_key"),
        F.concat(F.lit("**Sources Analyzed:** "), F.col("n").cast("string"), F.lit("  ")).alias("line"),
    )
    bodies = [
        rows.select(F.lit(no).alias("section_no"), F.concat(F.lit("."), "sort_key").alias("sort_key"), "line") for no, rows in sections.items()
    ]
    # every section is computed once, then asked whether it has rows
    body = materialize(reduce(DataFrame.unionByName, bodies), "report-lines")
    filled = body.select("section_no").distinct()
    named = []
    for no in sections:
        named += [(no, " 0", "---"), (no, " 1", TITLES[no]), (no, " 2", ""), (no, "~", "")]
        heads = {MATRIX: MATRIX_HEAD, CHANGES: CHANGES_HEAD}.get(no, ())
        named += [(no, f" {i + 3}", line) for i, line in enumerate(heads)]
    whole = spark.createDataFrame(head, schema).unionByName(count).unionByName(body)
    whole = whole.unionByName(spark.createDataFrame(named, schema).join(filled, "section_no", "left_semi"))
    if MATRIX in sections:
        nothing = spark.createDataFrame([(MATRIX, " 0", "---"), (MATRIX, " 1", TITLES[MATRIX]), (MATRIX, " 2", ""), (MATRIX, " 3", NO_MATRIX), (MATRIX, "~", "")], schema)
        whole = whole.unionByName(nothing.join(filled, "section_no", "left_anti"))
    return whole.select(F.lit(run).alias("pipeline_id"), "section_no", "sort_key", "line")
