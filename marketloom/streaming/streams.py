"""Structured Streaming counterparts of the batch operators.

All streams run on a checkpoint and a sink in the shared folder, and state that
outlives a micro-batch is Spark's own. Results that change while a stream runs go
to an epoch log: each micro-batch overwrites its own ``epoch=n`` folder, so a
repeated batch leaves the same rows, and readers take the newest row per key.

Where the order of events decides (health, price before), see ``ordered``: state per
key, in which late events are put into their place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom import schemas
from marketloom.functions import prices as P
from marketloom.functions import text as T
from marketloom.operators import activity, skew
from marketloom.session import scratch_path
from marketloom.streaming import ordered

WATERMARK = "1 hour"
#: How late an event may come where the order of events decides.
LATENESS = "7 days"


def table_stream(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """A parquet table as a stream; the pattern fits a single file and a folder of files alike."""
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Events as they land; a missing time is filled with the time of arrival."""
    raw = table_stream(spark, folder, "events", schemas.EVENTS_TABLE)
    return raw.withColumn("ts", F.coalesce(F.col("ts").cast("timestamp"), F.current_timestamp()))


def _finish(writer, checkpoint: str) -> None:
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def append_files(stream: DataFrame, path: str) -> None:
    """Append what has arrived since the last call to a parquet table at ``path/data``."""
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/data")
    _finish(writer, f"{path}/checkpoint")


def appended(stream: DataFrame, label: str) -> DataFrame:
    path = scratch_path(stream.sparkSession, label)
    append_files(stream, path)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/data")


def epoch_log(stream: DataFrame, path: str) -> None:
    """Write each micro-batch of an updating result to its own epoch folder."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/data/epoch={epoch}")

    _finish(stream.writeStream.outputMode("update").foreachBatch(write), f"{path}/checkpoint")


def newest(stream: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Run an updating stream to the end of its input and return its current rows."""
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    epoch_log(stream, path)
    log = spark.read.parquet(f"{path}/data")
    return skew.latest(log, keys, ["epoch"]).drop("epoch").select(*stream.columns)


# ------------------------------------------------------------------ windows
def _window_columns(df: DataFrame) -> DataFrame:
    bounds = [F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end")]
    return df.select(*bounds, *[c for c in df.columns if c != "window"])


def tumbling_counts(events: DataFrame, key: str, width: str = "1 day") -> DataFrame:
    windows = events.withWatermark("ts", WATERMARK).groupBy(F.window("ts", width), key)
    return _window_columns(windows.agg(F.count(F.lit(1)).alias("events")))


def sliding_error_rate(events: DataFrame, failed: Column, width: str = "1 day", slide: str = "6 hours") -> DataFrame:
    windows = events.withWatermark("ts", WATERMARK).groupBy(F.window("ts", width, slide))
    counted = windows.agg(F.count(F.lit(1)).alias("events"), F.count_if(failed).alias("errors"))
    return _window_columns(counted.withColumn("error_rate", F.round(F.col("errors") / F.col("events"), 6)))


def sessions(events: DataFrame, key: str, gap: str = "6 hours") -> DataFrame:
    """Closed sessions per key; a session is emitted once the watermark passes its end."""
    grouped = events.withWatermark("ts", WATERMARK).groupBy(F.session_window("ts", gap).alias("window"), key)
    return _window_columns(grouped.agg(F.count(F.lit(1)).alias("events")))


def all_sessions(events: DataFrame, key: str, gap: str = "6 hours") -> DataFrame:
    """Closed sessions and, marked ``open``, those that the end of the input leaves open.

    The stream emits the closed ones; the events after each key's last closed session make the others.
    """
    log = appended(events.select(key, "ts"), "session-events")
    closed = appended(sessions(events, key, gap), "sessions")
    ends = closed.groupBy(key).agg(F.max("window_end").alias("__end"))
    rest = skew.join(log, ends, [key]).filter(F.col("__end").isNull() | (F.col("ts") >= F.col("__end")))
    grouped = rest.groupBy(F.session_window("ts", gap).alias("window"), key).agg(F.count(F.lit(1)).alias("events"))
    return closed.withColumn("open", F.lit(False)).unionByName(_window_columns(grouped).withColumn("open", F.lit(True)))


# -------------------------------------------------------------- across batches
def rolling_buffer(
    events: DataFrame, key: str, n: int, order: Sequence[str] = ("ts", "event_id"), path: str | None = None
) -> DataFrame:
    """The newest ``n`` rows per key so far, read from the stream's state; a call with the same ``path`` goes on.

    State holds ``n`` rows per key, however long the stream runs; keys without new rows are not touched.
    """
    spark = events.sparkSession
    path = path or scratch_path(spark, "buffer")
    return ordered.newest_rows(events, path, key, n, order)


def _streak(failures: int, failed: bool) -> tuple[int, tuple[int, bool]]:
    failures = failures + 1 if failed else 0
    return failures, (failures, failures < activity.FAILURES_TO_UNHEALTHY)


def health(
    events: DataFrame, key: str, failed: Column, order: Sequence[str] = ("ts", "event_id"),
    path: str | None = None, lateness: str = LATENESS,
) -> DataFrame:
    """Failures in a row and health after every event so far; a call with the same ``path`` goes on where the last one ended.

    An event may come up to ``lateness`` after the newest one; those after it are then judged anew.
    """
    path = path or scratch_path(events.sparkSession, "health")
    schema, _ = ordered.fold(
        events, path, [key], order[0], order[1:], failed, _streak, 0, "bigint",
        "consecutive_failures bigint, healthy boolean", lateness, days=7,
    )
    rows = ordered.read(events.sparkSession, path, schema)
    return rows.select(key, F.timestamp_micros("__us").alias(order[0]), *order[1:], "consecutive_failures", "healthy")


def new_content(
    docs: DataFrame, text: str, path: str, keep: Sequence[str] = (), time: str | None = None, within: str = "1 hour"
) -> None:
    """Append content that has not come before to the history at ``path``: (content_hash, *keep).

    Copies that come ``within`` a time are settled in Spark's state, which forgets them after it; a copy of older
    content is found in the history, by an anti-join with the hash buckets the micro-batch touches. So state is bounded, and
    nothing comes out twice. ``time`` is when a row came, by default when it is read; rows older than the watermark are dropped.
    Of copies in one micro-batch any may stand for the others. A repeated micro-batch writes its folder again.
    """
    came = F.current_timestamp() if time is None else F.col(time).cast("timestamp")
    hashed = docs.select(T.content_hash(F.col(text)).alias("content_hash"), *keep, came.alias("__time"))
    first = hashed.withWatermark("__time", within).dropDuplicatesWithinWatermark(["content_hash"]).drop("__time")

    def write(batch: DataFrame, epoch: int) -> None:
        batch = batch.withColumn("bucket", F.conv(F.substring("content_hash", 1, 2), 16, 10).cast("int")).persist()
        fresh = batch
        if epoch:
            touched = [r.bucket for r in batch.select("bucket").distinct().collect()]  # 256 at most
            seen = history(batch.sparkSession, path).filter((F.col("epoch") < epoch) & F.col("bucket").isin(touched))
            fresh = batch.join(seen.select("bucket", "content_hash"), ["bucket", "content_hash"], "left_anti")
        # a bucket lies in one task, so an epoch has a file per bucket and not one per bucket and task
        fresh.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/epoch={epoch}")
        batch.unpersist()

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in first.schema)

    def history(spark: SparkSession, path: str) -> DataFrame:
        return spark.read.schema(f"{columns}, epoch bigint, bucket int").parquet(f"{path}/data")

    _finish(first.writeStream.foreachBatch(write), f"{path}/checkpoint")


def first_seen(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct content with its smallest id: an updating aggregate in Spark's state store."""
    seen = docs.groupBy(T.content_hash(F.col(text)).alias("content_hash")).agg(F.min(key).alias(key))
    return newest(seen, ["content_hash"], "seen")


def price_changes(
    rows: DataFrame, keys: Sequence[str], price: str, order: Sequence[str], path: str | None = None, lateness: str = LATENESS
) -> DataFrame:
    """Every row so far with the price before it in ``order`` and the grade of the change; a call with the same ``path`` goes on.

    A row may come up to ``lateness`` after the newest one; the row after it then has a new price before it.
    """
    path = path or scratch_path(rows.sparkSession, "prices")
    schema = ordered.previous(
        rows, path, keys, order[0], order[1:], F.col(price).cast("double"), "previous_price", lateness, days=90
    )
    found = ordered.read(rows.sparkSession, path, schema).withColumn(price, F.col("__value"))
    before = F.col("previous_price")
    columns = dict.fromkeys([*keys, order[0], *order[1:], price])
    return found.withColumn(order[0], F.timestamp_micros("__us")).select(
        *columns, before, F.when(before.isNotNull(), P.severity(before, F.col(price))).alias("severity")
    )
