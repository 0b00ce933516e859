"""Writers. Tables are append-only; a later row replaces an earlier one on reading."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marketloom import schemas
from marketloom.functions.prices import row_id
from marketloom.operators import skew
from marketloom.sources import report_files


def append(df: DataFrame, path: str, by: str | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(by) if by else writer).parquet(path)


#: The tables of a pipeline's store, with the columns they are written with.
TABLES = {
    "runs": schemas.RUN, "compliance_audits": schemas.AUDIT, "raw_documents": schemas.RAW_DOC,
    "extracted_records": schemas.RECORD, "insights": schemas.INSIGHT, "reports": schemas.REPORT,
}


def append_to(rows: DataFrame, path: str, name: str, run: str) -> None:
    """Append a run's rows to a table of the store, in the table's own columns and types.

    Columns that the rows lack are null, others are left out; partitioned by run, so a run's rows are read alone.
    """
    typed = []
    for field in StructType.fromDDL(TABLES[name]).fields:
        if field.name == "pipeline_id":
            typed.append(F.lit(run).alias("pipeline_id"))
        elif field.name in rows.columns:
            typed.append(F.col(field.name).cast(field.dataType).alias(field.name))
        else:
            typed.append(F.lit(None).cast(field.dataType).alias(field.name))
    append(rows.select(*typed), f"{path}/{name}", by="pipeline_id")


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    columns = StructType.fromDDL(TABLES[name]).names
    return spark.read.schema(TABLES[name]).parquet(f"{path}/{name}").select(*columns)


def raw_documents(documents: DataFrame, run: str) -> DataFrame:
    """Rows of the raw document table: the length of the text, not the text."""
    return documents.select(
        F.lit(run).alias("pipeline_id"), "url", "domain", "content_hash",
        F.length("content_markdown").cast("bigint").alias("content_length"),
    )


def current_rows(log: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """Newest row per key of an append-only log."""
    return skew.latest(log, keys, version)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def unique_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key."""
    return skew.latest(df, keys, order, newest=False)


def as_json(*columns: str) -> list[Column]:
    """Nested columns as JSON text for stores without nested types."""
    return [F.to_json(c).alias(f"{c}_json") for c in columns]


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def csv(df: DataFrame, path: str) -> None:
    """Header, quoted strings with quotes doubled, other values bare, empty for null."""

    def cell(name: str, kind: str) -> Column:
        value = F.col(f"`{name}`")
        if kind == "string":
            value = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.coalesce(value.cast("string"), F.lit(""))

    # whole lines as one column: the writer itself would quote either all values or only some strings
    line = F.concat_ws(",", *[cell(name, kind) for name, kind in df.dtypes]).alias(",".join(df.columns))
    bare = {"quote": "", "sep": "\u0001", "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.select(line).write.mode("overwrite").options(header=True, **bare).csv(path)


def report_file_name(run: Column, generated: Column) -> Column:
    return F.concat(F.lit("report_"), F.date_format(generated, "yyyyMMdd"), F.lit("_"), F.substring(run, 1, 8), F.lit(".md"))


def report(lines: DataFrame, path: str, generated: Column) -> None:
    """One Markdown file per run in the folder ``path``, named by the day and the run.

    A range partitioning on the reading order splits long reports over many tasks; ``report_files`` puts the sorted
    stretches together. Runs with one and the same name share a file, one after the other.
    """
    lines.sparkSession.dataSource.register(report_files.ReportFiles)
    named = lines.withColumn("file", report_file_name(F.col("pipeline_id"), generated))
    order = ["file", "pipeline_id", "section_no", "sort_key", "line"]
    ranged = named.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.select("file", "line").write.format("report_files").mode("append").save(path)


def report_digests(spark: SparkSession, path: str) -> DataFrame:
    """(file, lines, text_md5) of the reports in a folder; final line ends do not count. No text is held whole."""
    spark.dataSource.register(report_files.ReportFiles)
    return spark.read.format("report_files").load(path)


def payload(run: Column, generated: Column, parts: dict[str, DataFrame]) -> DataFrame:
    """The payload of a run as rows (report_id, part, payload): a head, and one JSON document per element.

    ``parts`` are tables by name, such as competitors, market_deltas, recommendations and battlecards; each row becomes a
    document of all its columns, nulls included.
    """
    spark = next(iter(parts.values())).sparkSession

    def documents(part: str, rows: DataFrame) -> DataFrame:
        body = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
        return rows.select(row_id("rpt_", run).alias("report_id"), F.lit(part).alias("part"), body.alias("payload"))

    head = spark.range(1).select(run.alias("pipeline_id"), generated.alias("generated_at"))
    whole = documents("head", head)
    for part, rows in parts.items():
        whole = whole.unionByName(documents(part, rows))
    return whole


def vectors(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
