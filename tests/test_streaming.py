"""Streams over several micro-batches equal the batch operators on the whole input."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from marketloom import schemas
from marketloom.operators import activity
from marketloom.session import scratch_path
from marketloom.streaming import ordered, streams


def made_stream(spark, late):
    """Four files, read one per micro-batch; with ``late`` every fifth row comes in another file than its time says."""
    rng = random.Random(9)
    start = dt.datetime(2024, 1, 1)
    folder = scratch_path(spark, "arrivals")
    rows = []
    for i in range(800):
        rows.append((i, start + dt.timedelta(minutes=10 * i), rng.choice([1, 1, 1, 2, 3]), rng.choice(["error", "error", "ok"]), rng.random(), "{}"))
    for part in range(4):
        mixed = [rows[(i + 200 * (late and i % 5 == 0)) % 800] for i in range(part * 200, part * 200 + 200)]
        chunk = spark.createDataFrame(mixed, schemas.EVENTS_TABLE.replace("timestamp_ntz", "timestamp"))
        chunk.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(folder)
    batch = spark.read.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    stream = (
        spark.readStream.schema(schemas.EVENTS_TABLE).option("maxFilesPerTrigger", 1).parquet(folder)
        .withColumn("ts", F.col("ts").cast("timestamp"))
    )
    return stream, batch.cache()


@pytest.fixture(scope="module")
def arrivals(spark):
    return made_stream(spark, late=False)


@pytest.fixture(scope="module")
def disordered(spark):
    return made_stream(spark, late=True)


def rows(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


def test_health(disordered):
    stream, batch = disordered
    failed = F.col("event_type") == "error"
    got = streams.health(stream, "user_id", failed)
    columns = ["event_id", "consecutive_failures", "healthy"]
    assert rows(got, *columns) == rows(activity.health(batch, "user_id", failed), *columns)


def test_buffer(disordered):
    stream, batch = disordered
    got = streams.rolling_buffer(stream, "user_id", 7)
    assert rows(got, "event_id") == rows(activity.last_n(batch, "user_id", ["ts", "event_id"], 7), "event_id")


def test_counts(arrivals):
    stream, batch = arrivals
    got = streams.newest(streams.tumbling_counts(stream, "event_type"), ["window_start", "event_type"], "counts")
    day = F.date_trunc("day", "ts").alias("window_start")
    expected = batch.groupBy(day, "event_type").agg(F.count(F.lit(1)).alias("events"))
    assert rows(got, "window_start", "event_type", "events") == rows(expected, "window_start", "event_type", "events")


def test_price_changes(disordered):
    stream, batch = disordered
    got = streams.price_changes(stream, ["user_id"], "value", ["ts", "event_id"])
    from pyspark.sql import Window

    lag = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    assert rows(got, "event_id", "previous_price") == rows(batch.withColumn("previous_price", lag), "event_id", "previous_price")


def test_first_seen(disordered):
    stream, batch = disordered
    got = streams.first_seen(stream, "event_id", "event_type")
    expected = batch.groupBy(F.sha2("event_type", 256).alias("content_hash")).agg(F.min("event_id").alias("event_id"))
    assert rows(got, "content_hash", "event_id") == rows(expected, "content_hash", "event_id")


def test_second_trigger_adds_nothing(spark, arrivals):
    stream, batch = arrivals
    path = scratch_path(spark, "daily")
    streams.append_files(stream.select("event_id"), path)
    streams.append_files(stream.select("event_id"), path)
    assert spark.read.parquet(f"{path}/data").count() == batch.count()


START = dt.datetime(2024, 3, 1)


def put(spark, folder, rows, schema="event_id bigint, ts timestamp, user_id bigint, event_type string"):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).parquet(folder)


def event(i, hours, user, kind):
    return (i, START + dt.timedelta(hours=hours), user, kind)


def test_late_events_change_the_stored_tail_and_touch_no_other_key(spark):
    folder, path = scratch_path(spark, "late"), scratch_path(spark, "late-health")
    failed = F.col("event_type") == "error"
    first = [event(i, i, user, "error") for i in range(4) for user in (1, 2, 3)]
    again = [(r[0] * 10 + r[2], *r[1:]) for r in first]
    streams.health(put(spark, folder, again), "user_id", failed, path=path, lateness="3 hours")
    # user 1: a success between the first two failures, which makes the two after it the first of a new row
    stream = put(spark, folder, [event(900, 0.5, 1, "ok")])
    got = streams.health(stream, "user_id", failed, path=path, lateness="3 hours")
    everything = spark.createDataFrame(again + [event(900, 0.5, 1, "ok")], "event_id bigint, ts timestamp, user_id bigint, event_type string")
    columns = ["event_id", "consecutive_failures", "healthy"]
    assert rows(got, *columns) == rows(activity.health(everything, "user_id", failed), *columns)
    # the watermark is at 0:00 (3:00 less three hours); the newest event moves it to 7:00, and once that has passed older ones are dropped
    for new in ([event(901, 10, 2, "error")], [event(904, 10.2, 2, "error")], [event(902, 2.5, 1, "ok"), event(903, 11, 1, "error")]):
        got = streams.health(put(spark, folder, new), "user_id", failed, path=path, lateness="3 hours")
    known = everything.collect() + [event(901, 10, 2, "error"), event(904, 10.2, 2, "error"), event(903, 11, 1, "error")]
    kept = spark.createDataFrame(known, everything.schema)
    assert rows(got, *columns) == rows(activity.health(kept, "user_id", failed), *columns)
    with ordered.rocks(spark):
        state = spark.read.format("statestore").option("path", f"{path}/checkpoint").option("stateVarName", "kept").load()
        tails = {r.key.user_id: (r.value.carry, len(r.value.tail)) for r in state.collect()}
    # what the watermark passed is one number per key: user 3's tail was folded by its timer
    assert tails[3] == (4, 0) and tails[2] == (4, 2) and tails[1] == (3, 1)


def test_only_touched_keys_are_written(spark):
    folder, path = scratch_path(spark, "touched"), scratch_path(spark, "touched-health")
    failed = F.col("event_type") == "error"
    schema = put(spark, folder, [event(i, 0, i, "error") for i in range(300)])

    def run(stream):
        return ordered.fold(stream, path, ["user_id"], "ts", ["event_id"], failed, streams._streak, 0, "bigint", "consecutive_failures bigint, healthy boolean", "9 days", 7)

    run(schema)
    _, progress = run(put(spark, folder, [event(1000, 1, 7, "error")]))
    assert progress["stateOperators"][0]["numRowsUpdated"] <= 6


def test_new_content_comes_out_once(spark):
    schema = "event_id bigint, ts timestamp, text string"
    folder, path = scratch_path(spark, "texts"), scratch_path(spark, "content")

    def arrive(*texts, hours):
        made = [(0, START + dt.timedelta(hours=hours), t) for t in texts]
        streams.new_content(put(spark, folder, made, schema), "text", path, time="ts", within="1 hour")
        return sorted(r.content_hash for r in spark.read.parquet(f"{path}/data").collect())

    import hashlib

    def hashes(*texts):
        return sorted(hashlib.sha256(t.encode()).hexdigest() for t in texts)

    assert arrive("a", "b", "a", hours=0) == hashes("a", "b")
    assert arrive("b", "c", hours=0.5) == hashes("a", "b", "c")
    # the watermark passes a, b and c; they are known from the history, not from state
    assert arrive("d", hours=40) == hashes("a", "b", "c", "d")
    assert arrive("a", "c", "e", "e", hours=50) == hashes("a", "b", "c", "d", "e")
    state = spark.read.format("statestore").option("path", f"{path}/checkpoint").load()
    assert state.count() <= 4


def test_new_content_has_a_file_per_bucket(spark):
    folder, path = scratch_path(spark, "many-texts"), scratch_path(spark, "many-content")
    spark.range(4000).select(F.concat(F.lit("text "), "id").alias("text")).repartition(8).write.parquet(folder)
    streams.new_content(spark.readStream.schema("text string").parquet(folder), "text", path)
    kept = spark.read.parquet(f"{path}/data")
    assert kept.count() == 4000
    assert kept.select(F.input_file_name()).distinct().count() == kept.select("bucket").distinct().count()


def test_a_micro_batch_is_many_files_of_a_large_table(spark, monkeypatch):
    from marketloom.plans import event_queries

    folder, path = scratch_path(spark, "tables"), scratch_path(spark, "dealt")
    spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text")).repartition(12).write.parquet(f"{folder}/documents.parquet")
    monkeypatch.setattr(event_queries, "scratch_path", lambda *_: path)
    stream = event_queries.disordered(spark, folder, "documents", ["doc_id", "text"])
    sizes = [r["count"] for r in spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 3000 and max(sizes) < 500
    query = stream.writeStream.format("noop").option("checkpointLocation", scratch_path(spark, "dealt-checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert len(query.recentProgress) == 4


def test_price_changes_keep_a_tail_of_rows_and_drop_late_ones(spark):
    folder, path = scratch_path(spark, "offers"), scratch_path(spark, "late-prices")
    schema = "id bigint, ts timestamp, tier bigint, price double"

    def arrive(*new):
        stream = put(spark, folder, [(i, None if h is None else START + dt.timedelta(hours=h), t, p) for i, h, t, p in new], schema)
        got = streams.price_changes(stream, ["tier"], "price", ["ts", "id"], path, "3 hours")
        return {r.id: r.previous_price for r in got.collect()}

    assert arrive((1, 0, 1, 10.0), (2, 2, 1, None), (3, 1, 2, 5.0), (4, None, 2, 4.0), (5, 1, None, 7.0)) == {1: None, 2: 10.0, 3: 4.0, 4: None, 5: None}
    # between two known rows, and the same row again
    assert arrive((6, 1, 1, 11.0), (3, 1, 2, 5.0), (7, 3, None, 8.0)) == {1: None, 6: 10.0, 2: 11.0, 3: 5.0, 4: None, 5: None, 7: 7.0}
    arrive((8, 10, 1, 12.0))
    # the watermark is at 7:00 and passed all but the last one; a micro-batch later it counts
    arrive((9, 20, 1, 13.0))
    got = arrive((10, 2.5, 1, 99.0), (11, 21, 1, 14.0), (12, 21, 2, 6.0))
    assert got[8] is None and got[9] == 12.0 and 10 not in got and got[11] == 13.0 and got[12] == 5.0
    tail = spark.read.schema("id bigint, tier bigint, __settled boolean").parquet(f"{path}/tail/data/epoch=4").collect()
    assert sorted((r.id, r["__settled"]) for r in tail if r.tier == 1) == [(8, True), (9, False), (11, False)]
    assert sorted((r.id, r["__settled"]) for r in tail if r.tier == 2) == [(3, True), (12, False)]
