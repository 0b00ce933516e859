"""Event-log operators: recent actions, health, breakers, stages, tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.operators import breakers, skew

# ---- fixed values ----
BUFFER_SIZE = 20
FAILURES_TO_UNHEALTHY = 3
BREAKER_MINUTES = 60
CONTEXT_HEADER = "Recent pipeline actions:"
OK_ICON, BAD_ICON = "✅", "❌"
EMPTY_CONTEXT = "No recent actions recorded."
# ---- end of fixed values ----


def _newest(order: Sequence[str]) -> list[Column]:
    return [F.col(c).desc() for c in order]


def last_n(events: DataFrame, key: str, order: Sequence[str], n: int = BUFFER_SIZE) -> DataFrame:
    """The ``n`` newest rows of each key, with ``age`` 1 for the newest."""
    return skew.top_n(events, [key], _newest(order), n, "age")


def last_errors(
    events: DataFrame, key: str, order: Sequence[str], failed: Column, n: int, buffer: int = BUFFER_SIZE
) -> DataFrame:
    """The ``n`` newest failures among the rows the buffer still holds."""
    kept = last_n(events, key, order, buffer).filter(failed)
    return skew.top_n(kept, [key], [F.col("age")], n, "error_age")


def context_text(
    keys: DataFrame, events: DataFrame, key: str, order: Sequence[str], failed: Column, n: int
) -> DataFrame:
    """One text per key: the last ``n`` actions, oldest first.

    ``events`` has agent, action and optionally source_url and error.
    """
    line = F.concat(
        F.lit("  "), F.when(failed, BAD_ICON).otherwise(OK_ICON), F.lit(" ["), F.col("agent"), F.lit("] "),
        F.col("action"),
    )
    if "source_url" in events.columns:
        line = F.concat(line, F.coalesce(F.concat(F.lit(" @ "), F.col("source_url")), F.lit("")))
    if "error" in events.columns:
        line = F.concat(line, F.coalesce(F.concat(F.lit(" — Error: "), F.col("error")), F.lit("")))
    recent = last_n(events, key, order, n).select(key, F.struct((-F.col("age")).alias("pos"), line.alias("line")).alias("entry"))
    lines = recent.groupBy(key).agg(F.sort_array(F.collect_list("entry")).alias("entries"))
    body = F.array_join(F.transform("entries", lambda e: e["line"]), "\n")
    text = F.when(F.col("entries").isNull(), EMPTY_CONTEXT).otherwise(F.concat(F.lit(CONTEXT_HEADER + "\n"), body))
    return keys.join(lines, key, "left").select(key, text.alias("context"))


def health(
    events: DataFrame, key: str, failed: Column, order: Sequence[str] = ("ts", "event_id"),
    initial: DataFrame | None = None,
) -> DataFrame:
    """Failures in a row and the health flag after every event of the key."""
    sliced = events.withColumn("time_slice", skew.hour_slice(F.col(order[0])))
    scanned = skew.streak(sliced, [key], order, "time_slice", failed, "consecutive_failures", initial)
    return scanned.drop("time_slice").withColumn(
        "healthy", F.col("consecutive_failures") < FAILURES_TO_UNHEALTHY
    )


def breaker(
    events: DataFrame, key: str, failed: Column, order: Sequence[str] = ("ts", "event_id"),
    minutes: int = BREAKER_MINUTES, failures: int = FAILURES_TO_UNHEALTHY, hours: int = 6,
) -> DataFrame:
    """(key, *order, consecutive_failures, opened_at, skipped): which events a breaker holds back, see ``breakers.decide``."""
    rows = events.select(
        key, *order, F.unix_micros(F.col(order[0]).cast("timestamp")).alias("us"), F.coalesce(failed, F.lit(False)).alias("failed")
    )
    decided = breakers.decide(rows, key, order[1:], minutes * 60_000_000, failures, hours)
    time = events.schema[order[0]].dataType
    return decided.select(
        key, F.timestamp_micros("us").cast(time).alias(order[0]), *order[1:], "consecutive_failures",
        F.timestamp_micros("opened_us").cast(time).alias("opened_at"), "skipped",
    )


def state_changes(
    events: DataFrame, key: str, state: str, order: Sequence[str] = ("ts", "event_id")
) -> DataFrame:
    """Rows where the state differs from the one before; ``old_state`` is null at the start."""
    sliced = events.withColumn("time_slice", skew.hour_slice(F.col(order[0])))
    paired = skew.with_previous(sliced, [key], order, "time_slice", {"old_state": state})
    return paired.filter(~F.col(state).eqNullSafe(F.col("old_state"))).drop("time_slice")


def latest_state(events: DataFrame, key: str, order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    return skew.latest(events, [key], order)


def active_stage(
    events: DataFrame, key: str, started: Column, ended: Column, stage: str,
    order: Sequence[str] = ("ts", "event_id"),
) -> DataFrame:
    """The stage last started on each key, or null if the run ended after it."""
    signal = events.filter(started | ended).withColumn("is_start", started)
    last = F.max_by(F.struct("is_start", F.col(stage).alias("stage")), F.struct(*order))
    return signal.groupBy(key).agg(last.alias("last")).select(
        key, F.when(F.col("last.is_start"), F.col("last.stage")).alias("active_stage")
    )


def stage_progress(
    events: DataFrame, keys: Sequence[str], started: Column, completed: Column, failed: Column, ts: str = "ts"
) -> DataFrame:
    """First start, last completion, duration and failure flag per key."""
    begin, end = F.min(F.when(started, F.col(ts))), F.max(F.when(completed, F.col(ts)))
    return events.groupBy(*keys).agg(
        begin.alias("started_at"), end.alias("completed_at"), F.max(failed).alias("has_failed")
    ).withColumn(
        "duration_seconds",
        F.round(
            (F.unix_micros(F.col("completed_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp")))
            / 1e6,
            3,
        ),
    )


def newest_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """Top ``n`` of the whole table, newest first (no full sort)."""
    return df.orderBy(*_newest(order)).limit(n)
