"""Sliced scans give what plain windows give, also when one key holds most rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from marketloom.operators import activity, deltas, skew


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(5)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(3000):
        key = 1 if rng.random() < 0.5 else rng.choice([2, 3, None])
        state = rng.choice(["error", "error", "ok", "idle"])
        rows.append((i, start + dt.timedelta(minutes=rng.randint(0, 6000)), key, state, rng.random()))
    return spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, state string, value double").cache()


ORDER = ["ts", "event_id"]


def plain():
    return Window.partitionBy("user_id").orderBy(*ORDER)


FAILED = "error"


def same(a, b, columns):
    left = sorted(map(str, a.select(*columns).collect()))
    assert left == sorted(map(str, b.select(*columns).collect()))
    assert left


def sliced(log):
    return log.withColumn("slice", skew.hour_slice(F.col("ts")))


def test_numbered(log):
    got = skew.numbered(log, ["user_id"], ORDER, "n")
    assert got.columns == [*log.columns, "n"]
    same(got, log.withColumn("n", F.row_number().over(plain()).cast("bigint")), ["event_id", "n"])


@pytest.mark.parametrize("kind", ["sparse", "one price", "all null", "two prices and nulls", "empty"])
def test_whole_tables_are_numbered_in_many_ranges(spark, kind):
    price = {
        "sparse": F.pow(F.lit(1.7), F.col("id") % 60), "one price": F.lit(5.0), "all null": F.lit(None).cast("double"),
        "two prices and nulls": F.when(F.col("id") % 3 == 0, 1.0).when(F.col("id") % 3 == 1, 2.0), "empty": F.lit(1.0),
    }[kind]
    rows = spark.range(0 if kind == "empty" else 5000).select((F.col("id") * F.col("id") * 7919).alias("row_id"), price.alias("price"))
    order = [F.col("price").asc_nulls_last(), F.col("row_id")]
    # small partitions would be put together
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = skew.numbered(rows, [], order, "n")
        ranges = skew.range_slices(rows, [], order)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    expected = rows.withColumn("n", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))
    if kind != "empty":
        spread = ranges.groupBy("slice").count().agg(F.count("*"), F.max("count")).first()
        assert spread[0] > 1 and spread[1] < 5000 * 0.6


def test_sums_over_ranges(log):
    got = skew.prefix(skew.range_slices(log, ["user_id"], ORDER), ["user_id"], ORDER, "slice", F.col("event_id"), "before")
    before = plain().rowsBetween(Window.unboundedPreceding, -1)
    same(got, log.withColumn("before", F.coalesce(F.sum("event_id").over(before), F.lit(0))), ["event_id", "before"])


def test_prefix_max(log):
    got = skew.prefix(sliced(log), ["user_id"], ORDER, "slice", F.col("value"), "m", how="max")
    before = plain().rowsBetween(Window.unboundedPreceding, -1)
    same(got, log.withColumn("m", F.max("value").over(before)), ["event_id", "m"])


def test_previous(log):
    got = skew.with_previous(sliced(log), ["user_id"], ORDER, "slice", {"old": "state"})
    same(got, log.withColumn("old", F.lag("state").over(plain())), ["event_id", "old"])


def naive_streaks(log, start=None):
    out, running = {}, dict(start or {})
    for r in sorted(log.collect(), key=lambda r: (r["ts"], r["event_id"])):
        running[r["user_id"]] = running.get(r["user_id"], 0) + 1 if r["state"] == FAILED else 0
        out[r["event_id"]] = running[r["user_id"]]
    return out


def test_streak(log):
    got = activity.health(log, "user_id", F.col("state") == FAILED)
    assert {r["event_id"]: r["consecutive_failures"] for r in got.collect()} == naive_streaks(log)


def test_streak_with_start(spark, log):
    initial = spark.createDataFrame([(1, 4), (3, 2)], "user_id bigint, consecutive_failures bigint")
    got = activity.health(log, "user_id", F.col("state") == FAILED, initial=initial)
    expected = naive_streaks(log, {1: 4, 3: 2})
    assert {r["event_id"]: r["consecutive_failures"] for r in got.collect()} == expected


def test_three_failures_then_success(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(hours=2 * i), 7, s) for i, s in enumerate(["error", "error", "error", "ok"])]
    log = spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, state string")
    got = activity.health(log, "user_id", F.col("state") == FAILED).orderBy("event_id").collect()
    assert [r["healthy"] for r in got] == [True, True, False, True]


def walked(log, minutes):
    """One event after another; skipped ones leave the state as it is."""
    state, out = {}, {}
    for r in sorted(log.collect(), key=lambda r: (r["ts"], r["event_id"])):
        streak, opened = state.get(r["user_id"], (0, None))
        skipped = opened is not None and r["ts"] < opened + dt.timedelta(minutes=minutes)
        if not skipped:
            streak = streak + 1 if r["state"] == FAILED else 0
        out[r["event_id"]] = (streak, opened, skipped)
        state[r["user_id"]] = (0, r["ts"]) if streak == 3 else (streak, opened)
    return out


@pytest.mark.parametrize("minutes, hours", [(60, 1), (60, 48), (7, 6), (3000, 1), (0, 2)])
def test_breaker(log, minutes, hours):
    got = activity.breaker(log, "user_id", F.col("state") == FAILED, minutes=minutes, hours=hours)
    assert {r["event_id"]: (r["consecutive_failures"], r["opened_at"], r["skipped"]) for r in got.collect()} == walked(log, minutes)


def test_a_pause_is_not_prolonged_or_reset_inside(spark):
    start = dt.datetime(2024, 1, 1)
    states = ["error"] * 3 + ["ok", "error", "error"] + ["error", "ok"]
    minutes = [0, 1, 2, 10, 20, 30, 62, 63]
    rows = [(i, start + dt.timedelta(minutes=m), 7, s) for i, (m, s) in enumerate(zip(minutes, states))]
    log = spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, state string")
    got = activity.breaker(log, "user_id", F.col("state") == FAILED).orderBy("event_id").collect()
    assert [r["skipped"] for r in got] == [False] * 3 + [True] * 3 + [False] * 2
    assert [r["consecutive_failures"] for r in got] == [1, 2, 3, 0, 0, 0, 1, 0]


def test_breaker_of_null_and_text_keys(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(minutes=i // 2), None if i % 3 else "h", "error") for i in range(60)] + [(99, None, "h", "error")]
    log = spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id string, state string")
    got = activity.breaker(log, "user_id", F.col("state") == FAILED)
    assert {r["event_id"]: (r["consecutive_failures"], r["opened_at"], r["skipped"]) for r in got.collect()} == walked(log.filter("ts IS NOT NULL"), 60)
    assert activity.breaker(log.limit(0), "user_id", F.col("state") == FAILED).count() == 0


def test_buffer_evicts_and_nests(log):
    small = {tuple(r) for r in activity.last_n(log, "user_id", ORDER, 3).select("event_id").collect()}
    large = {tuple(r) for r in activity.last_n(log, "user_id", ORDER, 4).select("event_id").collect()}
    assert small < large


def test_errors_within_buffer(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(minutes=i), 1, s) for i, s in enumerate(["ok", "error", "ok"])]
    log = spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, state string")
    assert activity.last_errors(log, "user_id", ORDER, F.col("state") == FAILED, 5).count() == 1
    assert activity.last_errors(log, "user_id", ORDER, F.col("state") == FAILED, 5, buffer=1).count() == 0


def test_top_n_is_limited_before_the_shuffle(log):
    plan = skew.top_n(log, ["user_id"], [F.col("ts").desc()], 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_repeated(log):
    got = deltas.repeated(log.select("event_id", "user_id", "state"), ["user_id", "state"], "event_id")
    spec = Window.partitionBy("user_id", "state").orderBy("event_id")
    same(got, log.withColumn("unchanged", F.row_number().over(spec) > 1), ["event_id", "unchanged"])
