"""One whole run: from captured pages to stage tables and a report.

Each stage is written as a table under ``out`` and read back by the next, so a
lost executor repeats one stage, and the next run finds its history there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom import schemas
from marketloom.functions import prices as P
from marketloom.functions import text as T
from marketloom.operators import admission, deltas, extraction, grounding, matrix, reports, skew, strategy
from marketloom.sources import sinks
from marketloom.sources.tables import enabled_sources

ANSWER_TIERS = schemas.ANSWER.split("pricing_tiers ")[1]
MONEY = (
    "input_price_per_m_tokens", "output_price_per_m_tokens", "cache_read_price_per_m_tokens",
    "fixed_monthly_price", "base_price_monthly", "seat_price_monthly",
)


#: Counts in the row of a run, which a failed run leaves empty.
COUNTED = ("attempted", "scraped", "extracted", "records", "flagged", "deltas", "recommendations")
#: Sources linked in a line of advice; all are rows of the insights.
SOURCES_SHOWN = 20


@dataclass(frozen=True)
class Run:
    """Names and settings of a run; ``previous`` is the folder of the run before it."""

    run_id: str
    out: str
    generated: str
    previous: str | None = None
    user_agent: str = "loombot/1.0"
    threshold: float = grounding.THRESHOLD
    vertical: str = "B2B AI Developer Platforms"

    def table(self, name: str) -> str:
        return f"{self.out}/{name}"


def _stage(df: DataFrame, run: Run, name: str) -> DataFrame:
    df.write.mode("overwrite").parquet(run.table(name))
    return df.sparkSession.read.schema(df.schema).parquet(run.table(name))


def admit_sources(sources: DataFrame, robots: DataFrame, run: Run) -> DataFrame:
    """Enabled sources with verdict, robots decision and delay."""
    wanted = enabled_sources(sources).withColumnRenamed("target_url", "url")
    policy = admission.host_policy(admission.robots_rules(robots), run.user_agent)
    return admission.apply_robots(admission.admit(wanted), policy)


def documents(checked: DataFrame, captures: DataFrame) -> DataFrame:
    """Clean, masked and hashed text of the best capture of each admitted source.

    ``captures``: id, tier_rank, status_code, html.
    """
    allowed = checked.filter((F.col("verdict") == admission.APPROVED) & F.col("robots_allowed"))
    ranks = F.create_map(*[F.lit(v) for kv in admission.TIER_RANKS.items() for v in kv])
    preferred = F.coalesce(F.try_element_at(ranks, F.col("preferred_tier")), F.lit(1))
    rows = captures.join(allowed.select("id", "url", "host", preferred.alias("preferred_rank")), "id")
    best = admission.best_capture(rows.withColumn("content", T.clean_html(F.col("html"))), "id")
    found = best.filter(F.col("tier_rank").isNotNull()).join(allowed.select("id", "url", F.col("host").alias("domain")), "id")
    return (
        found.withColumn("pii", T.pii_counts(F.col("content"))["total"])
        .withColumn("content_markdown", T.scrub_pii(F.col("content")))
        .withColumn("content_hash", T.content_hash(F.col("content_markdown")))
        .drop("content")
    )


def changed_documents(spark: SparkSession, docs: DataFrame, run: Run) -> DataFrame:
    """Documents whose hash the previous run did not record for the url: the rest needs no model."""
    if run.previous is None:
        return docs
    known = spark.read.parquet(f"{run.previous}/raw_documents").select("url", "content_hash")
    return docs.join(known, ["url", "content_hash"], "left_anti")


def typed_records(answers: DataFrame, docs: DataFrame) -> DataFrame:
    """Model answers joined to their page as typed records; prices normalised."""

    def typed(t: Column) -> Column:
        out = t
        for field in MONEY:
            out = out.withField(field, P.amount(t[field]))
        return out

    parsed = answers.withColumn("a", F.from_json("payload", schemas.ANSWER)).select("id", "attempt", "error", "a.*")
    tiers = F.coalesce("pricing_tiers", F.from_json(F.lit("[]"), ANSWER_TIERS))
    return parsed.withColumn("pricing_tiers", F.transform(tiers, typed).cast(f"array<{schemas.TIER}>")).join(
        docs.select("id", F.col("url").alias("source_url"), "domain", F.col("content_markdown").alias("source_text")), "id"
    )


def answer_error(answer: Column, text: Column) -> Column:
    """What is wrong with an answer as a record, or null: a rule of the record's shape that it breaks."""
    stated = answer["extraction_confidence"]
    unsound = F.array_compact(
        F.array(
            F.when(F.coalesce(F.length(F.trim(answer["company_name"])), F.lit(0)) == 0, "company_name_missing"),
            F.when((stated < 0) | (stated > 1), "confidence_out_of_range"),
        )
    )
    return F.when(F.size(unsound) > 0, F.concat(F.lit("not a sound record: "), F.array_join(unsound, ", ")))


def judged_records(records: DataFrame, run: Run) -> DataFrame:
    """Decoded, grounded, calibrated, validated; ``reason`` says why a record is set aside."""
    calibrated = grounding.calibrate(grounding.ground(grounding.decode(records)))
    gated = grounding.gate(grounding.validate(calibrated, run.threshold), run.threshold)
    failed = F.concat(F.lit("Extraction failed: "), F.col("error"))
    return gated.withColumn("reason", F.coalesce(F.when(F.col("error").isNotNull(), failed), "reason"))


def unique_offers(records: DataFrame) -> DataFrame:
    """One row per company and tier; a repeated tier counts as its last listing, by page and place on it."""
    flat = matrix.flatten(records, "place")
    return skew.latest(flat, ["company_name", "tier_name"], ["source_url", "place"]).drop("place")


def carried_records(spark: SparkSession, docs: DataFrame, fresh: DataFrame, run: Run, columns: list[str]) -> DataFrame | None:
    """Records of the previous run whose page was captured again and has not changed."""
    if run.previous is None:
        return None
    same = docs.join(fresh.select("id"), "id", "left_anti").select(F.col("url").alias("source_url")).distinct()
    return spark.read.parquet(f"{run.previous}/extracted_records").select(*columns).join(same, "source_url", "left_semi")


def insights(records: DataFrame, offers: DataFrame, changes: DataFrame) -> DataFrame:
    """Corroborated trends and isolated moves, one row per source, and advice from the changes with the sources shown."""
    trends = strategy.price_drop_signal(changes)
    for more in (strategy.enterprise_signal(records), strategy.feature_signal(records)):
        trends = trends.unionByName(more)
    advice = strategy.rule_based(offers, changes).select(
        F.lit("advice").alias("scope"), "category", "title", "rationale", "actionable_next_step",
        F.explode_outer("corroborating_sources").alias("source"), "corroboration_count",
    )
    return strategy.with_equilibrium(trends, records).unionByName(advice)


def execute(
    spark: SparkSession,
    run: Run,
    sources: DataFrame,
    captures: DataFrame,
    robots: DataFrame,
    model: extraction.ModelFactory,
) -> DataFrame:
    """Run every stage and return the run's row of metrics; a run that fails leaves a FAILED row with the error.

    Pages that did not change are not read again: their records are carried over from the
    previous run, so that offers, matrix and changes are of all pages. Only the
    synthesis looks at companies with new records alone, or at all if none has any.
    """
    try:
        return _execute(spark, run, sources, captures, robots, model)
    except Exception as error:
        none = [F.lit(None).cast("bigint").alias(c) for c in COUNTED]
        row = spark.range(1).select(F.lit(run.run_id).alias("pipeline_id"), F.lit("FAILED").alias("status"), *none, F.lit(str(error)).alias("error"))
        row.write.mode("overwrite").parquet(run.table("runs"))
        raise


def _execute(
    spark: SparkSession,
    run: Run,
    sources: DataFrame,
    captures: DataFrame,
    robots: DataFrame,
    model: extraction.ModelFactory,
) -> DataFrame:
    checked = _stage(admit_sources(sources, robots, run), run, "checked")
    docs = _stage(documents(checked, captures), run, "documents")
    audited = checked.join(docs.select("id", F.col("pii").alias("pii_scrubbed_count")), "id", "left").fillna(0, ["pii_scrubbed_count"])
    audits = _stage(admission.audits(audited, run.run_id), run, "compliance_audits")
    _stage(sinks.raw_documents(docs, run.run_id), run, "raw_documents")

    fresh = changed_documents(spark, docs, run).select("id", "url", F.col("content_markdown").alias("text"))
    answers = extraction.extract(fresh, model, "id", check=answer_error)
    judged = _stage(judged_records(typed_records(answers, docs), run), run, "judged_records")
    read = judged.filter(F.col("reason").isNull()).drop("source_text", "error", "reason")
    carried = carried_records(spark, docs, fresh, run, read.columns)
    records = _stage(read if carried is None else read.unionByName(carried), run, "extracted_records")
    flagged = judged.filter(F.col("reason").isNotNull())

    offers = _stage(unique_offers(records), run, "offers")
    if run.previous is None:
        history = offers.limit(0)
    else:
        history = spark.read.parquet(f"{run.previous}/offers")
    changes = _stage(deltas.tier_diff(history, offers), run, "deltas")
    unchanged = records.select("company_name").distinct().join(read.select("company_name").distinct(), "company_name", "left_anti")
    found = _stage(insights(deltas.changed_only(records, unchanged), offers, changes), run, "insights")

    lines = report_lines(records, offers, changes, found, run)
    sinks.report(lines, run.table("report"), F.lit(run.generated[:10]).cast("date"))
    return _stage(metrics(run, audits, docs, read, records, flagged, changes, found), run, "runs")


def report_lines(records: DataFrame, offers: DataFrame, changes: DataFrame, found: DataFrame, run: Run) -> DataFrame:
    # the confidence shown for a company is its best record's
    confidence = records.groupBy("company_name").agg(F.max("extraction_confidence").alias("extraction_confidence"))
    shown = skew.join(offers, confidence, ["company_name"])
    advice = ["category", "title", "rationale", "actionable_next_step", "corroboration_count"]
    few = skew.top_n(found.filter("source IS NOT NULL"), advice, [F.col("source")], SOURCES_SHOWN)
    linked = found.select(*advice).distinct().join(
        few.groupBy(F.struct(*advice).alias("k")).agg(F.array_sort(F.collect_list("source")).alias("corroborating_sources")),
        F.struct(*advice) == F.col("k"), "left",
    )
    sections = {
        reports.SUMMARY: strategy.executive_lines(records, changes).select(F.concat_ws(" ", F.when(F.col("kind") == "summary", "0").otherwise("1"), "line").alias("sort_key"), "line"),
        reports.MATRIX: reports.matrix_lines(shown).select(F.concat_ws(" ", "company_name", "tier_name").alias("sort_key"), "line"),
        reports.CHANGES: reports.change_lines(changes).select(F.concat_ws(" ", "competitor_name", "metric_name").alias("sort_key"), "line"),
        reports.ADVICE: reports.advice_lines(linked).select(reports.numbered_key(F.col("number"), F.col("line_no")).alias("sort_key"), "line"),
        reports.CARDS: reports.card_lines(strategy.cards(offers)).select(
            F.concat_ws(" ", "competitor", reports.numbered_key(F.col("line_no"))).alias("sort_key"), "line"
        ),
        reports.CITATIONS: reports.citation_lines(records, "id", run.generated).select(reports.numbered_key(F.col("idx")).alias("sort_key"), "line"),
    }
    return reports.report(run.run_id, "# Competitive Intelligence Report", sections, run.generated, run.vertical, records)


def metrics(
    run: Run, audits: DataFrame, docs: DataFrame, read: DataFrame, records: DataFrame, flagged: DataFrame, changes: DataFrame, found: DataFrame
) -> DataFrame:
    """The run's row: one count per stage table; ``extracted`` counts the records read in this run, ``records`` those carried over too."""
    counted = {"scraped": docs, "extracted": read, "records": records, "flagged": flagged, "deltas": changes, "recommendations": found}
    row = audits.agg(F.count(F.lit(1)).alias("attempted"))
    for name, stage in counted.items():
        row = row.withColumn(name, stage.agg(F.count(F.lit(1))).scalar())
    return row.select(F.lit(run.run_id).alias("pipeline_id"), F.lit("COMPLETED").alias("status"), *COUNTED, F.lit(None).cast("string").alias("error"))
