"""What several operators share: storing an intermediate table, Arrow batches, token rules."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.session import materialize

#: Fixed value: a word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Batches to Python end at this many bytes, so very long texts cannot fill a worker.
BATCH_BYTES = "16m"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back; later steps do not compute it again."""
    return materialize(df, label)


def limit_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def training_fold(doc_id: Column, parts: int, held: int) -> Column:
    """True for held-out rows: crc32 of the id as text leaves ``held``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts == held


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null is the empty text."""
    return [t or "" for t in batch.column(name).to_pylist()]


def words(text: str) -> list[bytes]:
    """Words of a text as UTF-8 with A-Z lower-cased; ``bytes`` knows exactly the ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def emit(columns: dict, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
