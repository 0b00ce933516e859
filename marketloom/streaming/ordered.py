"""Streams whose result hangs on the order of events: state per key with a tail that late events may still change.

Spark keeps, for every key, what the events up to the watermark came to, and the events
after it in order. An event that comes late is put into its place there; the events after it
are folded again and go out once more. What the watermark has passed can no longer change, so
it is folded into the carry, by a timer where no new events come. Events behind
the watermark are dropped by Spark: the allowed lateness decides how long a tail is kept.

Results go to slices of time. A micro-batch writes the slices it touches as a whole, with the rows
it changed replaced, next to a list of where each slice now lies; readers
read each slice once. A repeated micro-batch writes the same folders again.

Where all that counts is the value before an event, no step in Python is needed: the tail of all keys is a table of
the same kind, sliced by a hash of the key, and a micro-batch scans the slices it touches with a window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"

#: Slices by hash that the tail of all keys lies in.
TAILS = 256

#: (carry, value) -> (carry after it, what goes out with the event)
Step = Callable[[object, object], tuple[object, tuple]]


def _place(event: tuple) -> tuple:
    """Sort key of (time, other order columns..., value): nulls first; the value does not count."""
    return tuple((x is not None, x) for x in event[:-1])


class Tail(StatefulProcessor):
    """Folds a key's events in order; late ones change what comes after them."""

    def __init__(self, keys: Sequence[str], order: Sequence[str], outputs: Sequence[str], step: Step, start: object, state: str) -> None:
        self.keys, self.order, self.outputs = list(keys), list(order), list(outputs)
        self.step, self.start, self.state = step, start, state

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", self.state)

    def _load(self) -> tuple[object, list[tuple]]:
        if not self.kept.exists():
            return self.start, []
        carry, tail = self.kept.get()
        return carry, [tuple(e) for e in tail]

    def _settle(self, carry: object, tail: list[tuple], watermark_ms: int) -> None:
        """Fold what can no longer change into the carry; a row with no time is as old as can be."""
        done = 0
        while done < len(tail) and (tail[done][0] is None or tail[done][0] <= watermark_ms * 1000):
            carry, _ = self.step(carry, tail[done][-1])
            done += 1
        self.kept.update((carry, tail[done:]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        carry, tail = self._load()
        new = [tuple(row[c] for c in ("__us", *self.order, "__value")) for row in rows]
        first = min(map(_place, new))
        tail = sorted(tail + new, key=_place)
        now = carry
        for event in tail:
            now, out = self.step(now, event[-1])
            if _place(event) >= first:
                named = dict(zip(self.keys, key)) | dict(zip(self.order, event[1:-1])) | dict(zip(self.outputs, out))
                yield Row(**named, __us=event[0], __value=event[-1])
        if tail[-1][0] is not None:
            self.handle.registerTimer(tail[-1][0] // 1000 + 1)
        self._settle(carry, tail, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.kept.exists():
            self._settle(*self._load(), timerValues.getCurrentWatermarkInMs())
        return iter(())

    def close(self) -> None:
        pass


class Newest(StatefulProcessor):
    """Keeps the newest rows of a key."""

    def __init__(self, columns: Sequence[str], order: Sequence[str], n: int, state: str) -> None:
        self.columns, self.n, self.state = list(columns), n, state
        self.at = [self.columns.index(c) for c in order]

    def init(self, handle) -> None:
        self.kept = handle.getValueState("newest", self.state)

    def _age(self, row: tuple) -> tuple:
        return tuple((row[i] is not None, row[i]) for i in self.at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        kept = [tuple(r) for r in self.kept.get()[0]] if self.kept.exists() else []
        for row in rows:
            kept.append(tuple(row[c] for c in self.columns))
            if len(kept) >= 4 * self.n + 64:  # a key with many rows at once is cut on the way
                kept = sorted(kept, key=self._age)[-self.n :]
        self.kept.update((sorted(kept, key=self._age)[-self.n :],))
        return iter(())

    def close(self) -> None:
        pass


def newest_rows(stream: DataFrame, path: str, key: str, n: int, order: Sequence[str]) -> DataFrame:
    """The newest ``n`` rows per key of all that has arrived, as they lie in the state of the stream at ``path``."""
    spark = stream.sparkSession
    plain = [f.name for f in stream.schema if f.dataType.simpleString() in ("timestamp", "timestamp_ntz")]
    # state keeps times as numbers
    packed = stream.select(*[F.unix_micros(F.col(c).cast("timestamp")).alias(c) if c in plain else F.col(c) for c in stream.columns])
    fields = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in packed.schema)
    processor = Newest(packed.columns, order, n, f"rows array<struct<{fields}>>")
    kept = packed.groupBy(key).transformWithState(statefulProcessor=processor, outputStructType="done boolean", outputMode="Update", timeMode="None")
    with rocks(spark):
        query = kept.writeStream.outputMode("update").format("noop").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        state = spark.read.format("statestore").option("path", f"{path}/checkpoint").option("stateVarName", "newest").load()
        rows = state.select(F.inline("value.rows"))
    return rows.select(*[
        F.timestamp_micros(c).cast(stream.schema[c].dataType).alias(c) if c in plain else F.col(c) for c in stream.columns
    ])


@contextmanager
def rocks(spark: SparkSession):
    """State with timers needs this store; other streams of the session keep theirs.

    What the watermark passed is folded with the next rows that come, without a micro-batch of its own.
    """
    wanted = {PROVIDER: ROCKS, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


# ------------------------------------------------------------- slices of time
def _slices(spark: SparkSession, path: str, before: int | None = None) -> dict:
    """{slice: epoch that wrote it last}, of epochs before one."""
    listed = spark.read.schema("slice bigint, written bigint, epoch bigint").parquet(f"{path}/slices")
    if before is not None:
        listed = listed.filter(F.col("epoch") < before)
    # one row per slice of time
    return {r["slice"]: r.written for r in listed.groupBy("slice").agg(F.max("written").alias("written")).collect()}


def _read(spark: SparkSession, path: str, schema: StructType, slices: dict) -> DataFrame:
    parts = [f"{path}/data/epoch={written}/slice={'__HIVE_DEFAULT_PARTITION__' if s is None else s}" for s, written in slices.items()]
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*parts)


def _list(spark: SparkSession, path: str, touched: Sequence[int | None], epoch: int) -> None:
    listed = spark.createDataFrame([(s, epoch) for s in touched], "slice bigint, written bigint")
    listed.coalesce(1).write.mode("overwrite").parquet(f"{path}/slices/epoch={epoch}")


def write_slices(path: str, schema: StructType, row_key: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """A sink of micro-batches with a column ``slice``: rows of the same ``row_key`` replace earlier ones."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        touched = [r["slice"] for r in batch.select("slice").distinct().collect()]
        known = _slices(spark, path, epoch) if epoch and touched else {}
        old = _read(spark, path, schema, {s: known[s] for s in touched if s in known})
        same = reduce(lambda a, b: a & b, [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in row_key])
        kept = old.alias("o").join(batch.alias("n"), same, "left_anti")
        rows = kept.select(*schema.names, _slice_of(kept)).unionByName(batch.select(*schema.names, "slice"))
        rows.write.mode("overwrite").partitionBy("slice").parquet(f"{path}/data/epoch={epoch}")
        _list(spark, path, touched, epoch)
        batch.unpersist()

    def _slice_of(rows: DataFrame) -> Column:
        return time_slice(F.col("__us"), write.days).alias("slice")

    return write


def time_slice(us: Column, days: int) -> Column:
    return F.floor(us / (days * 86_400_000_000)).cast("bigint")


def fold(
    stream: DataFrame, path: str, keys: Sequence[str], time: str, order: Sequence[str], value: Column,
    step: Step, start: object, carry: str, outputs: str, lateness: str, days: int,
) -> tuple[StructType, dict | None]:
    """Read what has arrived since the last call, fold each key's events by ``time`` and ``order``, and store the results at ``path``.

    ``order`` tells events of one time apart. ``carry`` is the type of the carry, ``outputs`` the columns that ``step`` gives.
    A key's events of one micro-batch go through one task, its state is read and written once; other keys are not touched.
    Returns the schema for ``read`` and Spark's last progress report.
    """
    spark = stream.sparkSession
    taken = stream.select(
        *keys, *[c for c in order if c not in keys], F.col(time).cast("timestamp").alias("__time"), value.alias("__value")
    ).withWatermark("__time", lateness).withColumn("__us", F.unix_micros("__time"))
    types = {f.name: f.dataType.simpleString() for f in taken.schema}
    event = ", ".join(f"`{c}`: {types[c]}" for c in ("__us", *order, "__value"))
    named = [p.split()[0] for p in outputs.split(", ")]
    result = StructType.fromDDL(", ".join([f"`{c}` {types[c]}" for c in (*keys, *order)] + [outputs, f"`__us` bigint, `__value` {types['__value']}"]))
    processor = Tail(keys, order, named, step, start, f"carry {carry}, tail array<struct<{event}>>")
    folded = taken.groupBy(*keys).transformWithState(
        statefulProcessor=processor, outputStructType=result, outputMode="Update", timeMode="EventTime"
    ).withColumn("slice", time_slice(F.col("__us"), days))
    write = write_slices(path, result, ["__us", *keys, *order])
    write.days = days
    with rocks(spark):
        query = folded.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    return result, query.lastProgress


def previous(
    stream: DataFrame, path: str, keys: Sequence[str], time: str, order: Sequence[str], value: Column,
    output: str, lateness: str, days: int,
) -> StructType:
    """As ``fold``, for the value of the event before; returns the schema for ``read``.

    Kept are, per key, the events after the watermark and the last one that it passed. They lie in ``TAILS`` slices by a hash of the
    key, of which a micro-batch reads and writes those that its keys fall into. As with Spark's own state, an event counts as
    late by the watermark one micro-batch back.
    """
    spark = stream.sparkSession
    taken = stream.select(
        *keys, *[c for c in order if c not in keys], F.unix_micros(F.col(time).cast("timestamp")).alias("__us"), value.alias("__value")
    )
    types = {f.name: f.dataType.simpleString() for f in taken.schema}
    named = ", ".join(f"`{c}` {types[c]}" for c in (*keys, *[c for c in order if c not in keys]))
    result = StructType.fromDDL(f"{named}, `{output}` {types['__value']}, `__us` bigint, `__value` {types['__value']}")
    tail = StructType.fromDDL(f"{named}, `__us` bigint, `__value` {types['__value']}, `__settled` boolean")
    write = write_slices(path, result, ["__us", *dict.fromkeys([*keys, *order])])
    write.days = days
    place = F.struct("__us", *order)

    def scan(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("slice", F.pmod(F.xxhash64(*keys), F.lit(TAILS))).persist()
        late, passed = (_watermark(spark, path, epoch - n) for n in (2, 1))
        newest = batch.agg(F.max("__us")).first()[0]
        now = passed if newest is None else max(passed, spark.range(1).select(F.unix_millis(F.timestamp_micros(F.lit(newest)) - F.expr(f"interval {lateness}"))).first()[0])
        came = batch.filter(F.col("__us").isNull() | (F.col("__us") > late * 1000))
        touched = [r["slice"] for r in came.select("slice").distinct().collect()]  # TAILS at most
        known = _slices(spark, f"{path}/tail", epoch) if epoch and touched else {}
        kept = _read(spark, f"{path}/tail", tail, {s: known[s] for s in touched if s in known})
        kept = kept.withColumn("slice", F.pmod(F.xxhash64(*keys), F.lit(TAILS))).withColumn("__new", F.lit(False))
        both = kept.unionByName(came.withColumns({"__settled": F.lit(False), "__new": F.lit(True)})).repartition("slice")
        key = Window.partitionBy("slice", *keys)
        # what the watermark passed comes before all others
        in_order = key.orderBy(F.desc("__settled"), *[F.asc_nulls_first(c) for c in ("__us", *order)], "__new")
        first = F.min(F.when(F.col("__new"), place)).over(key)
        passes = F.col("__us").isNull() | (F.col("__us") <= passed * 1000)
        scanned = (
            both.withColumn(output, F.lag("__value").over(in_order)).withColumn("__out", ~F.col("__settled") & (place >= first))
            .withColumn("__passed", F.col("__settled") | passes).withColumn("__last", ~F.coalesce(F.lead(F.col("__passed")).over(in_order), F.lit(False)))
        )
        scanned = scanned.persist()
        rest = scanned.filter(~F.col("__passed") | F.col("__last")).withColumn("__settled", F.col("__passed"))
        rest.select(*tail.names, "slice").repartition("slice").write.mode("overwrite").partitionBy("slice").parquet(f"{path}/tail/data/epoch={epoch}")
        _list(spark, f"{path}/tail", touched, epoch)
        write(scanned.filter("__out").select(*result.names, time_slice(F.col("__us"), days).alias("slice")), epoch)
        spark.range(1).select(F.lit(now).cast("bigint").alias("ms")).write.mode("overwrite").parquet(f"{path}/watermark/epoch={epoch}")
        scanned.unpersist()
        batch.unpersist()

    query = taken.writeStream.foreachBatch(scan).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return result


def _watermark(spark: SparkSession, path: str, epoch: int) -> int:
    """The watermark after a micro-batch, in milliseconds; Spark starts at zero."""
    return 0 if epoch < 0 else spark.read.schema("ms bigint").parquet(f"{path}/watermark/epoch={epoch}").first().ms


def read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The present rows: every slice of time from the folder that holds it now."""
    return _read(spark, path, schema, _slices(spark, path))
