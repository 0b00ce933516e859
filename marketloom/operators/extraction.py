"""User-model extraction with repair passes, and model price lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from marketloom import schemas
from marketloom.functions import text as T
from marketloom.operators import skew
from marketloom.session import scratch_path

# ---- fixed values ----
MAX_REPAIRS = 2
TOKENS_PER_PRICE = 1_000_000
MODEL_HUB = ("OpenRouter", "https://openrouter.ai/")
RECENT_HEAD = "RECENT ACTIONS:\n"
# Characters that two passages of a page share, so that a listing at a cut is whole in one of them.
OVERLAP = 500
# ---- end of fixed values ----

EXTRACT_TEMPLATE = """Read the page below and state the company's products and prices as one JSON object.
Give null for a price the page does not state.

Page address: {source_url}

{markdown_content}
"""

REPAIR_TEMPLATE = """The step {agent_name} failed.

Input:
{input_excerpt}

Error:
{error_trace}

{recent_actions}
Say in one JSON object what was wrong (critique, root_cause, remedy) and give corrected_output.
"""


def extraction_prompt(text: Column, url: Column, template: str = EXTRACT_TEMPLATE) -> Column:
    return T.render(template, source_url=url, markdown_content=T.budget(text, T.PROMPT_CHARS))


def repair_prompt(agent: Column, text: Column, error: Column, recent: Column | None = None, template: str = REPAIR_TEMPLATE) -> Column:
    """``recent`` is a text of the agent's last actions, left out where it is null or empty."""
    said = F.lit("") if recent is None else F.when(F.length(recent) > 0, F.concat(F.lit(RECENT_HEAD), recent, F.lit("\n"))).otherwise("")
    return T.render(
        template,
        agent_name=agent,
        recent_actions=said,
        error_trace=T.budget(error, T.ERROR_CHARS),
        input_excerpt=T.budget(text, T.EXCERPT_CHARS),
    )


OBJECT = r"^\s*\{"
ABOUT = ("critique", "root_cause", "remedy")

ModelFactory = Callable[[], Callable[[pd.Series, int], pd.Series]]


def call_model(df: DataFrame, factory: ModelFactory, attempt: int) -> DataFrame:
    """Add ``response``: the user's model over Arrow batches of prompts, its client built once per task.

    Only the prompts travel to Python. The function counts as nondeterministic,
    so Spark never calls the model twice for one row of a stage.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for prompts in batches:
            yield model(prompts, attempt)

    ask = F.pandas_udf(run, "string").asNondeterministic()
    return df.withColumn("response", ask("prompt"))


def passages(df: DataFrame, chars: int) -> DataFrame:
    """One row per passage of at most ``chars`` characters of ``text``; ``start`` moves on to the passage's place in the page."""
    text = F.coalesce("text", F.lit(""))
    last = F.greatest(F.length(text) - OVERLAP - 1, F.lit(0))
    cut = df.withColumn("__at", F.explode(F.sequence(F.lit(0), last, F.lit(chars - OVERLAP))))
    part = F.substr("text", F.col("__at") + 1, F.lit(chars))
    # half a line at the beginning is whole in the passage before
    part = F.when(F.col("__at") > 0, F.regexp_replace(part, rf"^[^\n]{{0,{OVERLAP // 2}}}\n", "")).otherwise(part)
    return cut.withColumn("start", F.col("start") + F.col("__at")).withColumn("text", part).drop("__at")


def united(payloads: Column, answer: StructType) -> Column:
    """One JSON object of a page's passages in order, read by the type of an answer.

    Lists are joined, and an element that repeats counts where it is listed last; a flag is true where any
    passage says so; of other values the first that says something counts.
    """
    read = F.transform(payloads, lambda p: F.from_json(p, answer))

    def one(field: StructField) -> Column:
        values = F.transform(read, lambda r: r[field.name])
        if isinstance(field.dataType, ArrayType):
            every = F.flatten(F.filter(values, lambda v: v.isNotNull()))
            whole = F.reverse(F.array_distinct(F.reverse(every)))
            return F.when(F.exists(values, lambda v: v.isNotNull()), whole)
        if isinstance(field.dataType, BooleanType):
            return F.array_max(values)
        says = F.filter(values, lambda v: v.isNotNull() & (v.cast("string") != "") if isinstance(field.dataType, StringType) else v.isNotNull())
        return F.try_element_at(says, F.lit(1))

    return F.to_json(F.struct(*[one(f).alias(f.name) for f in answer.fields]))


def _whole_pages(results: DataFrame, key: str, answer: StructType) -> DataFrame:
    """One row per page. A page with a passage that failed keeps what the others gave, and its error."""
    part = F.struct("start", "attempt", "payload", "error", "root_cause", "remedy")
    pages = results.groupBy("__page", key).agg(F.sort_array(F.collect_list(part)).alias("parts"))
    read = F.filter("parts", lambda p: p["payload"].isNotNull())

    def lines(name: str) -> Column:
        said = F.filter(F.transform("parts", lambda p: p[name]), lambda x: x.isNotNull())
        return F.when(F.size(said) > 0, F.array_join(F.array_distinct(said), "\n"))

    return pages.select(
        key,
        F.array_max(F.transform("parts", lambda p: p["attempt"])).alias("attempt"),
        F.when(F.size(read) > 1, united(F.transform(read, lambda p: p["payload"]), answer)).otherwise(F.try_element_at(read, F.lit(1))["payload"]).alias("payload"),
        lines("error").alias("error"), lines("root_cause").alias("root_cause"), lines("remedy").alias("remedy"),
    )


def extract(
    pages: DataFrame,
    factory: ModelFactory,
    key: str,
    max_repairs: int = MAX_REPAIRS,
    agent: str = "analyst",
    answer: str = schemas.ANSWER,
    check: Callable[[Column, Column], Column] | None = None,
    recent: Column | None = None,
) -> DataFrame:
    """Ask the model about each passage of each page and ask again, with the error, where the answer is no JSON object or is not sound.

    ``answer`` is the type of an answer. ``check`` is a column of the answer, as a struct of that type, and the passage's text: null
    where the answer is sound, else what is wrong with it, which the next prompt says. ``recent`` is a text of the agent's last
    actions for repair prompts. An answer that stays unsound after the last round counts as it is, with its error.

    A repaired answer counts by its ``corrected_output``; an answer that only speaks
    about the error is another failure. Its root cause and remedy are kept either way.

    A page longer than a prompt's budget is asked about in passages that overlap, one that failed
    in passages of the repair prompt's budget, so all of a page is read; the answers are united per page.

    Input: key, url, text. Every pass is written to the shared folder, so a row
    that succeeded never reaches the model again, also after executors are lost;
    only failed rows enter the next pass. Result: key, attempt, payload, error, root_cause, remedy.
    """
    spark = pages.sparkSession
    path, shape = scratch_path(spark, "extract"), StructType.fromDDL(answer)
    # rows of one key stay apart
    named = pages.select(key, "url", "text", F.expr("uuid()").alias("__page"), F.lit(0).alias("start"))
    todo = passages(named, T.PROMPT_CHARS).select("__page", "start", key, "url", "text", extraction_prompt(F.col("text"), F.col("url")).alias("prompt"))
    results = None
    for attempt in range(max_repairs + 1):
        answered = call_model(todo, factory, attempt)
        body = T.embedded_json(F.col("response"))
        whole = F.when(F.try_parse_json(body).isNotNull() & body.rlike(OBJECT), body)
        if attempt:
            mended = F.get_json_object(whole, "$.corrected_output")
            speaks = F.coalesce(*[F.get_json_object(whole, f"$.{name}") for name in ABOUT]).isNotNull()
            found = F.when(mended.rlike(OBJECT), mended).when(~speaks & mended.isNull(), whole)
        else:
            found = whole
        no_object = F.concat(F.lit("no JSON object: "), F.coalesce("response", F.lit("")))
        wrong = F.lit(None).cast("string") if check is None else check(F.from_json(F.col("__found"), shape), F.col("text"))
        last = attempt == max_repairs
        judged = (
            answered.withColumn("__found", found)
            .withColumn("error", F.when(F.col("__found").isNull(), no_object).otherwise(wrong))
            .withColumn("payload", F.when(F.col("error").isNull() | F.lit(last), F.col("__found"))).drop("__found")
            .withColumn("root_cause", F.get_json_object(whole, "$.root_cause") if attempt else F.lit(None).cast("string"))
            .withColumn("remedy", F.get_json_object(whole, "$.remedy") if attempt else F.lit(None).cast("string"))
        )
        # the text is needed again only where the answer failed
        slim = judged.withColumn("text", F.when(F.col("payload").isNull(), F.col("text"))).drop("prompt", "response")
        slim.write.mode("overwrite").parquet(f"{path}/{attempt}")
        done = spark.read.parquet(f"{path}/{attempt}")
        failed = done.filter("payload IS NULL")
        kept = (done if last else done.filter("payload IS NOT NULL")).select(
            "__page", "start", key, F.lit(attempt).cast("bigint").alias("attempt"), "payload", "error", "root_cause", "remedy"
        )
        results = kept if results is None else results.unionByName(kept)
        todo = passages(failed, T.EXCERPT_CHARS).select(
            "__page", "start", key, "url", "text", repair_prompt(F.lit(agent), F.col("text"), F.col("error"), recent).alias("prompt")
        )
    return _whole_pages(results, key, shape)


def repair_history(attempts: DataFrame, key: str, max_repairs: int = MAX_REPAIRS) -> DataFrame:
    """One text per key from ``attempt_number, root_cause, remedy``: every attempt with its whole remedy."""
    line = F.concat(
        F.lit("  Attempt "), F.col("attempt_number").cast("string"), F.lit(": Root cause = "),
        F.coalesce("root_cause", F.lit("N/A")), F.lit(", Remedy = "),
        F.coalesce("remedy", F.lit("N/A")),
    )
    grouped = (
        attempts.groupBy(key)
        .agg(F.sort_array(F.collect_list(F.struct("attempt_number", line.alias("line")))).alias("lines"))
    )
    head = F.concat(
        F.lit("Previous repair attempts ("), F.size("lines").cast("string"), F.lit(f"/{max_repairs}):\n")
    )
    return grouped.select(
        key, F.concat(head, F.array_join(F.transform("lines", lambda e: e["line"]), "\n")).alias("history")
    )


def model_price_list(models: DataFrame, position: str, per_company: int | None = None) -> DataFrame:
    """Price list rows (``id, prompt, completion`` per token) to tiers, numbered per company by the number ``position``.

    All models are kept, or the first ``per_company`` of each company.
    """
    parts = F.split("id", "/", 2)
    provider = parts[0]
    company = F.concat(F.upper(F.substring(provider, 1, 1)), F.lower(F.substr(provider, F.lit(2))))

    def per_million(price: Column) -> Column:
        return F.when(price > 0, F.round(price * TOKENS_PER_PRICE, 3))

    named = models.filter(F.contains("id", F.lit("/"))).select(
        company.alias("company_name"),
        parts[1].alias("tier_name"),
        per_million(F.col("prompt").cast("double")).alias("input_price"),
        per_million(F.col("completion").cast("double")).alias("output_price"),
        F.col(position),
    )
    hub, address = MODEL_HUB
    if per_company is None:
        kept = skew.numbered(named, ["company_name"], [position], "tier_no")
    else:
        kept = skew.top_n(named, ["company_name"], [F.col(position)], per_company, "tier_no")
    return kept.select(
        "*",
        F.concat("company_name", F.lit(" LLM Endpoints")).alias("product_name"),
        F.concat(F.lit(address), F.lower("company_name")).alias("source_url"),
        F.lit(f"{hub} normalized proxy routing").alias("rate_limits_summary"),
        F.concat("company_name", F.lit(f" pricing verified via {hub} catalog.")).alias("citation_text"),
    )
