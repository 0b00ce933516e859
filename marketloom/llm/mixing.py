"""Mix sources to target weights by systematic sampling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.common import WORD, stored

#: Weights by place in the order of sources, the share of all words, the largest repeat.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0

#: A run of rows that agree in source and size is cut into slices of about this many rows.
SLICE_ROWS = 65_536


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _key(source: Column) -> Column:
    """A source as a text that is never null, in the same order, null last."""
    return F.coalesce(F.concat(F.lit("a"), source), F.lit("b"))


def offset(key: Column, seed: int) -> Column:
    """The random offset of a source in [0, 1): a function of seed and source, so reruns agree."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Words to take of each source, from rows (key, source_size): (key, source_size, target, rate).

    Each source gets ``min(most * its size, level * its weight)``; the level is the
    one at which all targets sum to ``share`` of all words, which is where handing
    the excess of full sources to the others by weight ends. One row per source.
    """
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy("ratio", "key")
    weight = F.array(*[F.lit(float(w)) for w in weights])
    placed = (
        sizes.withColumn("place", F.row_number().over(Window.orderBy("key")) - 1)
        .withColumn("weight", F.get(weight, F.col("place") % len(weights)))
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(whole) * F.lit(float(share)))
        .withColumn("full", F.sum("cap").over(by_ratio) - F.col("cap"))
        .withColumn("left", F.sum("weight").over(whole) - F.sum("weight").over(by_ratio) + F.col("weight"))
        .withColumn("level", (F.col("total") - F.col("full")) / F.col("left"))
    )
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(whole)
    return placed.withColumn("found", level).select(
        "key",
        "source_size",
        F.least("cap", F.coalesce(F.col("weight") * F.col("found"), F.col("cap"))).alias("target"),
    ).withColumn("rate", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)))


def mix(
    rows: DataFrame,
    sized: DataFrame | None = None,
    size: str = "size",
    seed: int = 17,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Give every row of ``rows`` its number of copies: adds ``source_size, target, copies``.

    A document's expected copies are its source's target over its source's words.
    They are summed up over the source's documents in order of size, one random
    offset is added, and a document is emitted once per whole number crossed. As
    the order follows size, the words taken miss the target by less than the
    largest document (never more than ``most`` copies of one document).

    ``rows`` needs doc_id, source and the column named by ``size``; ``sized`` is the
    same rows with only these columns, stored, if ``rows`` is costly to read.
    A hot source is no single group: the running sum is taken over (source, size)
    groups first, a group of many equal sizes is cut into slices by id, and only
    inside a slice are rows numbered.

    Null source: a source of its own, last in order. Null doc_id: first in its
    slice. Repeated rows count each. Size 0: counts as a document, takes no words.
    Empty input: empty output. A column of ``rows`` named like an added one is replaced.
    """
    narrow = sized if sized is not None else stored(rows.select("doc_id", "source", size), "mix-sizes")
    narrow = narrow.select("doc_id", _key(F.col("source")).alias("key"), F.col(size).alias("size"))
    counts = stored(narrow.groupBy("key", "size").agg(F.count("*").alias("n")), "mix-counts")
    rates = targets(
        counts.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).cast("bigint").alias("source_size")),
        weights, share, most,
    )
    parts = counts.select("key", "size", F.ceil(F.col("n") / slice_rows).cast("bigint").alias("parts"))
    salt = F.pmod(F.xxhash64("doc_id"), "parts")
    # only sizes with several slices need a second count
    several = narrow.join(parts.filter("parts > 1"), ["key", "size"]).withColumn("slice", salt)
    slices = (
        several.groupBy("key", "size", "slice").agg(F.count("*").alias("n"))
        .unionByName(counts.filter(F.col("n") <= slice_rows).withColumn("slice", F.lit(0).cast("bigint")))
    )
    in_source = Window.partitionBy("key").orderBy("size", "slice")
    starts = slices.select("key", "size", "slice", (F.sum("n").over(in_source) - F.col("n")).alias("before"))
    plan = stored(
        starts.join(rates, "key").join(parts, ["key", "size"])
        .select(F.struct("key", "size", "slice").alias("__slice"), "parts", "before", "source_size", "target", "rate"),
        "mix-plan",
    )
    by_size = plan.groupBy(F.struct("__slice.key", "__slice.size").alias("__group")).agg(F.max("parts").alias("__parts"))

    added = ("source_size", "target", "copies")
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in added]
    group = F.struct(_key(F.col("source")).alias("key"), F.col(size).alias("size"))
    # the caller's columns travel in one struct, so their names meet no other
    tagged = rows.select(F.struct(*kept).alias("__kept"), F.col("doc_id").alias("__doc"), group.alias("__group")).join(by_size, "__group")
    slice_of = F.struct("__group.key", "__group.size", F.pmod(F.xxhash64("__doc"), "__parts").alias("slice"))
    numbered = tagged.withColumn("__slice", slice_of).withColumn(
        "__nth", F.row_number().over(Window.partitionBy("__slice").orderBy("__doc"))
    )
    end = F.col("before") + F.col("__nth")
    shift = offset(F.col("__group.key"), seed)
    crossed = F.floor(F.col("rate") * end + shift) - F.floor(F.col("rate") * (end - 1) + shift)
    return numbered.join(plan.drop("parts"), "__slice").withColumn("copies", crossed.cast("bigint")).select("__kept.*", *added)


#: The same mix in SQL.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, coalesce('a' || source, 'b') AS key,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
sources AS (
  SELECT key, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY key),
placed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY key) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0 ELSE 2.0 END AS weight,
         source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total FROM sources),
levels AS (
  SELECT *, cap / weight AS ratio,
         (total - (sum(cap) OVER (ORDER BY cap / weight, key) - cap))
         / (sum(weight) OVER () - sum(weight) OVER (ORDER BY cap / weight, key) + weight) AS level
  FROM placed),
found AS (SELECT max(level) AS found FROM levels WHERE level <= ratio),
goal AS (
  SELECT key, source_size, least(cap, weight * found) AS target,
         CASE WHEN source_size > 0 THEN least(cap, weight * found) / source_size ELSE 0 END AS rate,
         CAST('0x' || substr(md5('17:' || key), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS shift
  FROM levels, found),
placed_docs AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY size, doc_id NULLS FIRST) AS nth FROM sized)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate * nth + shift) - floor(rate * (nth - 1) + shift)) AS BIGINT) AS taken
FROM placed_docs JOIN goal USING (key)
"""


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, all columns as they are, whatever their names.

    Rows are numbered once and stored with their numbers, so a repeated task reads the same ones; the mix is made on
    numbers and sizes alone, and the texts move once. Null texts and empty ones have no words to take; a null source
    is a source; null ids and repeated rows are rows like others. Empty: empty.
    """
    numbered = stored(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("number")), "mix-numbered")
    sized = stored(numbered.select("number", "row.doc_id", "row.source", word_count(F.col("row.text")).alias("size")), "mix-rows")
    taken = stored(mix(sized, sized, size="size", **options).filter("copies > 0").select("number", "copies"), "mix-copies")
    once_each = F.sequence(F.lit(1).cast("bigint"), F.col("copies"))
    # the same join at every size: rows and numbers are both dealt by number
    repeated = numbered.join(taken.hint("merge"), "number").withColumn("copy", F.explode(once_each))
    return repeated.select("row.*")
