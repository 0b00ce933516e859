"""Joins and ordered scans that never put one key into one task.

A key may hold a third of all rows, so a plain window over the key is unsafe.
The rows of a key are cut into slices that follow the order (an hour of a time
line, a range of the order found by a sample). Each slice is scanned on its own,
the slices are summed up to one row each, and the scan over those few rows is
joined back. ``slice_col`` must never fall while the order rises.

Key and slice travel as one struct. Rows that happen to be partitioned by the
key alone are then partitioned anew, where separate columns would let Spark
keep a hot key together; the struct also pairs null keys, and scan and join
share its partitioning. The input is read twice, the second time only for key,
order and value: write an expensive input to a stage table first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.session import materialize


def hour_slice(ts: Column, hours: int = 1) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / (hours * 3_600_000_000)).cast("bigint")


def _ranged(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Rows dealt to partitions by ranges of keys and order, which Spark finds by a sample, and sorted there.

    Whatever the values are, sparse, all null or all the same but for the last column of a total order,
    the ranges hold about equally many rows.
    """
    places = [F.asc_nulls_first(k) for k in keys] + [c if isinstance(c, Column) else F.col(c) for c in order]
    return df.repartitionByRange(*places).sortWithinPartitions(*places)


def range_slices(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "slice") -> DataFrame:
    """``df``, stored, with a slice for the scans of this module: the number of the range a row fell into."""
    cut = _ranged(df, keys, order).withColumn(name, F.spark_partition_id().cast("bigint"))
    return materialize(cut, "range-slices")


def join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join on a struct of the keys, keeping the left key columns; null keys pair.

    The result counts as partitioned by the struct, not by the keys, so a later
    step on the keys shuffles anew and the adaptive skew join may split hot keys.
    """
    mine = left.withColumn("__join", F.struct(*keys))
    theirs = right.select(F.struct(*keys).alias("__join"), *[c for c in right.columns if c not in keys])
    return mine.join(theirs, "__join", how).drop("__join")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str], newest: bool = True) -> DataFrame:
    """One whole row per key, the last (or first) in ``order``; combined on the map side."""
    pick = F.max_by if newest else F.min_by
    rest = [c for c in df.columns if c not in keys]
    row = pick(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(row).select(*keys, "__row.*")


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    """First ``n`` rows of each key.

    Spark limits each group before the shuffle when it sees this filter, so a
    hot key ships at most n rows per map task.
    """
    spec = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(spec)).filter(F.col(name) <= n)


def _cut(df: DataFrame, keys: Sequence[str], slice_col: str) -> DataFrame:
    return df.withColumn("__key", F.struct(*keys, slice_col))


def _over_slices(keys: Sequence[str], slice_col: str):
    key = F.col("__key")
    return Window.partitionBy(*[key[k] for k in keys]).orderBy(key[slice_col].asc_nulls_first())


def prefix(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    slice_col: str,
    value: Column,
    name: str,
    how: str = "sum",
) -> DataFrame:
    """Sum or maximum of ``value`` over the rows of the key strictly before this one."""
    fold = {"sum": F.sum, "max": F.max}[how]
    cut = _cut(df.withColumn("__value", value), keys, slice_col)
    before = Window.partitionBy("__key").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumn("__local", fold("__value").over(before))
    slices = cut.groupBy("__key").agg(fold("__value").alias("__total"))
    earlier = _over_slices(keys, slice_col).rowsBetween(Window.unboundedPreceding, -1)
    carry = slices.select("__key", fold("__total").over(earlier).alias("__carry"))
    joined = local.join(carry, "__key", "left")
    if how == "sum":
        zero = F.lit(0).cast(cut.schema["__value"].dataType)
        result = F.coalesce("__local", zero) + F.coalesce("__carry", zero)
    else:
        result = F.greatest("__local", "__carry")
    return joined.withColumn(name, result).drop("__key", "__value", "__local", "__carry")


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str) -> DataFrame:
    """1-based position of each row within its key; without keys, within the table. The order must be total.

    One shuffle: rows are dealt by sampled ranges of key and order and numbered where they lie. Rows per
    partition are summed up to give each partition its first number, and a key's first number is taken off.
    """
    local = F.monotonically_increasing_id()  # partition and place in it
    placed = materialize(_ranged(df, keys, order).withColumn("__at", local), "numbered")
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    counts = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__rows"))
    offsets = counts.select("__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset"))
    whole = placed.withColumn("__part", part).join(offsets, "__part").withColumn(name, F.col("__offset") + place + 1)
    whole = whole.drop("__part", "__offset", "__at")
    if keys:
        first = whole.groupBy(*keys).agg(F.min(name).alias("__first"))
        whole = join(whole, first, keys).withColumn(name, F.col(name) - F.col("__first") + 1).drop("__first")
    return whole.select(*df.columns, F.col(name).cast("bigint").alias(name))


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slice_col: str,
    values: dict[str, str],
    initial: DataFrame | None = None,
) -> DataFrame:
    """Columns of the row before this one within the key: ``{new name: source column}``.

    ``initial`` (keys plus the new names) stands in for the row before the first.
    """
    row = F.struct(*[F.col(src).alias(new) for new, src in values.items()])
    cut = _cut(df, keys, slice_col)
    local = cut.withColumn("__prev", F.lag(row).over(Window.partitionBy("__key").orderBy(*order)))
    ends = cut.groupBy("__key").agg(F.max_by(row, F.struct(*order)).alias("__end"))
    carry = ends.select("__key", F.lag("__end").over(_over_slices(keys, slice_col)).alias("__carry"))
    joined = local.join(carry, "__key", "left").drop("__key")
    sources = ["__prev", "__carry"]
    if initial is not None:
        joined = join(joined, initial.select(*keys, F.struct(*values).alias("__start")), keys)
        sources.append("__start")
    whole = F.coalesce(*sources)
    return joined.select(*df.columns, *[whole[new].alias(new) for new in values])


def streak(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slice_col: str,
    failed: Column,
    name: str,
    initial: DataFrame | None = None,
) -> DataFrame:
    """Number of failures in a row up to and with this row; a success sets it to zero.

    ``initial`` (keys plus ``name``) holds the streak each key starts with.
    """
    scan = Window.partitionBy("__key").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = (
        _cut(df.withColumn("__fail", failed.cast("bigint")), keys, slice_col)
        .withColumn("__cum", F.sum("__fail").over(scan))
        .withColumn("__base", F.max(F.when(F.col("__fail") == 0, F.col("__cum"))).over(scan))
        .withColumn("__streak", F.col("__cum") - F.coalesce("__base", F.lit(0)))
    )
    ends = local.groupBy("__key").agg(
        F.max_by("__streak", F.struct(*order)).alias("__tail"),
        F.min("__fail").alias("__all_failed"),
    )
    if initial is not None:
        # a slice before all others that carries the starting streak
        before = F.lit(None).cast(df.schema[slice_col].dataType).alias(slice_col)
        start = initial.select(
            F.struct(*keys, before).alias("__key"),
            F.col(name).cast("bigint").alias("__tail"),
            F.lit(1).cast("bigint").alias("__all_failed"),
        )
        ends = ends.unionByName(start)
    upto = _over_slices(keys, slice_col)
    running = upto.rowsBetween(Window.unboundedPreceding, 0)
    carry = (
        ends.withColumn("__sum", F.sum("__tail").over(running))
        .withColumn(
            "__reset",
            F.max(F.when(F.col("__all_failed") == 0, F.col("__sum") - F.col("__tail"))).over(running),
        )
        .withColumn("__after", F.col("__sum") - F.coalesce("__reset", F.lit(0)))
        .select("__key", F.lag("__after", 1, 0).over(upto).alias("__carry"))
    )
    joined = local.join(carry, "__key", "left")
    total = F.col("__streak") + F.when(F.col("__base").isNull(), F.coalesce("__carry", F.lit(0))).otherwise(0)
    return joined.withColumn(name, total.cast("bigint")).select(*df.columns, name)
