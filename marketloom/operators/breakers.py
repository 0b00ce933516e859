"""A breaker that pauses a key after failures in a row, decided over slices of time.

Whether an event is attempted hangs on all attempts before it, so the decision is sequential. But what a
slice of events does to the breaker is a function of the state the breaker enters it with: how many
failures in a row there were, or until when it is paused. The function of each slice is made
by itself, from its end backward; entering states follow from one function to the next; then each slice is
decided by itself. A key may hold a third of all events: only the functions of its slices, a few
numbers each, pass through one task, one after another.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: A state is (failures in a row, when the breaker last opened or None); an exit has None if it did not open in the slice.
State = tuple[int, int | None]


def slice_function(us: np.ndarray, failed: np.ndarray, pause: int, failures: int) -> tuple[list[State], list[tuple[int, int, int | None]]]:
    """(exits by failures at the first event, steps) of events in order.

    A breaker paused until T first attempts the first event at or after T, without failures. ``steps`` hold
    (latest T, failures, opened): the exit for T up to that time, in order; beyond the last, the state passes through.
    """
    n = len(us)
    # the first event after a pause that opens here
    back = np.maximum(np.searchsorted(us, us + pause, "left"), np.arange(1, n + 1)).tolist()
    times, bad = us.tolist(), failed.tolist()
    after: list[State] = [(c, None) for c in range(failures)]
    fresh: list[State] = [(0, None)] * (n + 1)
    for j in range(n - 1, -1, -1):
        if bad[j]:
            streak, opened = fresh[back[j]]
            after = [*after[1:], (streak, times[j] if opened is None else opened)]
        else:
            after = [after[0]] * failures
        fresh[j] = after[0]
    steps: list[tuple[int, int, int | None]] = []
    for j in range(n):
        if steps and steps[-1][1:] == fresh[j]:
            steps[-1] = (times[j], *fresh[j])
        elif not steps or steps[-1][0] < times[j]:
            steps.append((times[j], *fresh[j]))
    return after, steps


def simulate(us: Sequence[int], failed: Sequence[bool], pause: int, failures: int, state: State) -> tuple[list[tuple], State]:
    """Per event (failures in a row after it, when the breaker opened before it or None, skipped), and the state after all."""
    streak, opened = state
    out = []
    for now, bad in zip(us, failed):
        skipped = opened is not None and now < opened + pause
        before = opened
        if not skipped:
            streak = streak + 1 if bad else 0
        out.append((streak, before, skipped))
        if streak == failures:
            streak, opened = 0, now
    return out, (streak, opened)


def slices(batches: Iterator[pa.RecordBatch], columns: Sequence[str]) -> Iterator[tuple[tuple, list[list]]]:
    """((key, slice), values per column) of rows that come sorted by key and slice; one slice is held at a time."""
    now, held = None, [[] for _ in columns]
    for batch in batches:
        lists = [batch.column(c).to_pylist() for c in columns]
        places = list(zip(batch.column("key").to_pylist(), batch.column("slice").to_pylist()))
        begin = 0
        while begin < len(places):
            end = begin + 1
            while end < len(places) and places[end] == places[begin]:
                end += 1
            if now is not None and places[begin] != now:
                yield now, held
                held = [[] for _ in columns]
            now = places[begin]
            for values, new in zip(held, lists):
                values += new[begin:end]
            begin = end
    if now is not None:
        yield now, held


def _written(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


#: Rows that leave a task at once, about.
ROWS = 5_000


def _functions(pause: int, failures: int, key_type: pa.DataType):
    numbers = pa.list_(pa.int64())
    schema = pa.schema(
        [("key", key_type), ("slice", pa.int64()), ("first_us", pa.int64()), ("streaks", numbers), ("openings", numbers),
         ("until", numbers), ("step_streaks", numbers), ("step_openings", numbers)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = []
        for place, (us, failed) in slices(batches, ("us", "failed")):
            exits, steps = slice_function(np.array(us, np.int64), np.array(failed, bool), pause, failures)
            ready.append((*place, us[0], [e[0] for e in exits], [e[1] for e in exits], *[[s[i] for s in steps] for i in range(3)]))
            if len(ready) >= ROWS:
                yield _written(ready, schema)
                ready = []
        if ready:
            yield _written(ready, schema)

    return run


def _marks(pause: int, failures: int, ids: Sequence[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple] = []
        for (key, _), (us, failed, streak, opened, *rest) in slices(batches, ("us", "failed", "streak", "entered_us", *ids)):
            marked, _ = simulate(us, failed, pause, failures, (streak[0], opened[0]))
            ready += [(key, now, *given, *mark) for now, given, mark in zip(us, zip(*rest) if rest else [()] * len(us), marked)]
            if len(ready) >= ROWS:
                yield _written(ready, schema)
                ready = []
        if ready:
            yield _written(ready, schema)

    return run


def _entries(pause: int, key_type: pa.DataType):
    schema = pa.schema([("key", key_type), ("slice", pa.int64()), ("streak", pa.int64()), ("opened_us", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, now, state = False, None, (0, None)
        for batch in batches:
            entered = []
            for row in batch.to_pylist():
                if not begun or row["key"] != now:
                    begun, now, state = True, row["key"], (0, None)
                entered.append((row["key"], row["slice"], *state))
                streak, opened = state
                if opened is not None and opened + pause > row["first_us"]:
                    at = int(np.searchsorted(row["until"], opened + pause, "left"))
                    if at == len(row["until"]):
                        continue  # the pause outlasts the slice
                    streak, new = row["step_streaks"][at], row["step_openings"][at]
                else:
                    streak, new = row["streaks"][streak], row["openings"][streak]
                state = (streak, opened if new is None else new)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*entered), schema)], schema=schema)

    return run


def decide(events: DataFrame, key: str, ids: Sequence[str], pause: int, failures: int, hours: int) -> DataFrame:
    """(key, us, *ids, consecutive_failures, opened_us, skipped) of events with key, us, ids and failed.

    After ``failures`` failures in a row the breaker opens: events less than ``pause`` microseconds later are
    skipped, are no attempts, and count for nothing. The first one after the pause is attempted without failures before it.
    ``opened_us`` is when the breaker last opened before the event. Events are taken by ``us`` and ``ids``, in slices of ``hours``. An event without
    a time is as if it never was and does not come out. Null keys are one key.
    """
    types = {c: events.schema[c].dataType for c in (key, *ids)}
    key_ddl, key_type = types[key].simpleString(), to_arrow_type(types[key])
    cut = events.filter("us IS NOT NULL").select(
        F.col(key).alias("key"), F.floor(F.col("us") / (hours * 3_600_000_000)).cast("bigint").alias("slice"), "us", *ids, "failed"
    )
    arrays = "streaks array<bigint>, openings array<bigint>, until array<bigint>, step_streaks array<bigint>, step_openings array<bigint>"
    place = F.struct("key", "slice")  # a hot key is dealt by its slices
    placed = cut.repartition(place).sortWithinPartitions("key", "slice", "us", *ids)
    functions = placed.select("key", "slice", "us", "failed").mapInArrow(
        _functions(pause, failures, key_type), f"key {key_ddl}, slice bigint, first_us bigint, {arrays}"
    )
    entries = functions.repartition("key").sortWithinPartitions("key", "slice").mapInArrow(
        _entries(pause, key_type), f"key {key_ddl}, slice bigint, streak bigint, opened_us bigint"
    )
    entered = cut.withColumn("place", place).join(
        entries.select(place.alias("place"), "streak", F.col("opened_us").alias("entered_us")), "place"
    )
    out = pa.schema(
        [(key, key_type), ("us", pa.int64()), *[(c, to_arrow_type(types[c])) for c in ids],
         ("consecutive_failures", pa.int64()), ("opened_us", pa.int64()), ("skipped", pa.bool_())]
    )
    ddl = ", ".join([f"`{key}` {key_ddl}", "us bigint", *[f"`{c}` {types[c].simpleString()}" for c in ids]])
    return (
        entered.repartition("place").sortWithinPartitions("key", "slice", "us", *ids).drop("place")
        .mapInArrow(_marks(pause, failures, ids, out), f"{ddl}, consecutive_failures bigint, opened_us bigint, skipped boolean")
    )
