"""Readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom import schemas

LOG_LINE = (
    "timestamp string, level string, logger string, message string, agent string, step string, "
    "source_url string, confidence double"
)
MODEL_DUMP = "data array<struct<id:string,pricing:struct<prompt:string,completion:string>>>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """Landed pages: page_id, url, html."""
    return table(spark, folder, "pages")


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as vec_id, company, embedding."""
    return table(spark, folder, "embeddings").select(
        "vec_id", F.col("label").cast("string").alias("company"), "embedding"
    )


def enabled_sources(sources: DataFrame) -> DataFrame:
    """Source list with defaults filled; an unset ``enabled`` counts as true."""
    defaults = {"category": "LLM_INFERENCE", "preferred_tier": "httpx", "check_frequency": "weekly"}
    out = sources
    for name, value in defaults.items():
        current = F.coalesce(F.col(name), F.lit(value)) if name in sources.columns else F.lit(value)
        out = out.withColumn(name, current)
    return out.filter(F.coalesce("enabled", F.lit(True)))


def source_list(spark: SparkSession, path: str) -> DataFrame:
    """Source list from JSON files of one array of objects each."""
    return enabled_sources(spark.read.schema(schemas.SOURCE).option("multiLine", True).json(path))


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """Golden catalog: JSON records with nested tiers."""
    return spark.read.schema(schemas.RECORD).option("multiLine", True).json(path)


def model_dump(spark: SparkSession, path: str) -> DataFrame:
    """Model list dumps (``{"data": [...]}``) as id, prompt, completion rows."""
    return explode_models(spark.read.schema(MODEL_DUMP).option("multiLine", True).json(path), F.col("data"))


def explode_models(df: DataFrame, data: Column) -> DataFrame:
    return df.select(F.explode(data).alias("m")).select(
        F.col("m.id").alias("id"), F.col("m.pricing.prompt").alias("prompt"),
        F.col("m.pricing.completion").alias("completion"),
    )


def nested_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Replace a JSON text column by its typed value; null where it does not fit."""
    return df.withColumn(column, F.from_json(column, schema))


def log_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Structured log lines; a line that is no JSON object is kept in ``bad_line``."""
    parsed = F.from_json(column, LOG_LINE)
    return lines.withColumn("r", parsed).withColumn(
        "bad_line", F.when(F.try_parse_json(column).isNull(), F.col(column))
    ).select(*[c for c in lines.columns if c != column], "r.*", "bad_line")


def log_files(spark: SparkSession, path: str) -> DataFrame:
    return log_lines(spark.read.text(path))
