"""Duplicate check and nearest records over embedding columns."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions import vectors as V
from marketloom.operators import skew
from marketloom.session import materialize

# ---- fixed values ----
DUPLICATE_SIMILARITY = 0.995
MOST_BANDS = 512
CROWDED = 2000
SKETCH_BITS = 63  # of each of the two numbers of a sketch
EMBEDDING_DIM = 384
# ---- end of fixed values ----


def text_vector(text: str, dim: int = EMBEDDING_DIM) -> np.ndarray:
    """Unit vector drawn from a generator seeded by the text's hash: equal texts, equal vectors."""
    seed = int.from_bytes(hashlib.sha256(text.encode()).digest()[:4], "big")
    vector = np.random.default_rng(seed).standard_normal(dim).astype(np.float32)
    return vector / np.linalg.norm(vector)


def embed(
    df: DataFrame, column: str, factory: Callable[[], Callable[[pd.Series], list]], name: str = "embedding"
) -> DataFrame:
    """Add the user's embedding of a text column; the model is built once per task."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in batches:
            yield pd.Series(list(model(texts)))

    vectors = F.pandas_udf(run, "array<float>").asNondeterministic()
    return df.withColumn(name, vectors(column))


def hashed_texts() -> Callable[[pd.Series], list]:
    """Factory of the fallback embedding for :func:`embed`."""
    return lambda texts: [text_vector(t) for t in texts]


def _signs(dim: int, groups: int, bits: int, seed: Sequence[int]) -> Callable[[pd.Series], pd.Series]:
    """``groups`` numbers per vector, each of the signs of ``bits`` random directions."""

    def keys(vectors: pd.Series) -> pd.Series:
        planes = np.random.default_rng(list(seed)).standard_normal((dim, groups * bits))
        rows = np.stack(vectors.to_numpy()).astype(np.float64)
        signs = (rows @ planes > 0).reshape(len(rows), groups, bits)
        packed = signs.astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))
        return pd.Series(list(packed))

    return keys


def _verified(pairs: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """Ids of ``vec_id`` whose cosine with ``other``, of the same company, reaches the threshold."""
    mine = vectors.select("vec_id", F.col("embedding").alias("a"), F.col("company").alias("of_a"))
    theirs = vectors.select(F.col("vec_id").alias("other"), F.col("embedding").alias("b"), F.col("company").alias("of_b"))
    near = F.col("of_a").eqNullSafe(F.col("of_b")) & (V.cosine(F.col("a"), F.col("b")) >= threshold)
    return pairs.join(mine, "vec_id").join(theirs, "other").filter(near).select("vec_id").distinct()


def bands_for(threshold: float, bits: int, miss: float, most: int = MOST_BANDS) -> int:
    """Groups of ``bits`` signs that leave a pair at the threshold without a common bucket with a chance of ``miss`` at most."""
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    bands = math.ceil(math.log(miss) / math.log1p(-meet)) if meet < 1 else 1
    if bands > most:
        raise ValueError(f"a similarity of {threshold} needs {bands} bands of {bits} bits; take fewer bits")
    return bands


def sketch_limit(threshold: float, miss: float, bits: int = 2 * SKETCH_BITS) -> int:
    """Differing signs of ``bits`` that a pair at the threshold exceeds with a chance of ``miss`` at most."""
    p = math.acos(threshold) / math.pi
    limit, beyond = bits, 0.0
    while limit and (beyond := beyond + math.comb(bits, limit) * p**limit * (1 - p) ** (bits - limit)) <= miss:
        limit -= 1
    return limit


def _alike(left: tuple[str, str], right: tuple[str, str], limit: int) -> Column:
    """Two sketches differ in ``limit`` signs at most."""
    return sum((F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(left, right)), F.lit(0)) <= limit


def _settle(members: DataFrame, same: DataFrame, threshold: float, limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members of buckets of several, with the bucket's size; ids settled by the earliest member; probes still open)."""
    earliest = [F.min_by(c, "vec_id").alias(f"hub_{c}") for c in ("a", "b")]
    sizes = members.groupBy("bucket").agg(F.min("vec_id").alias("hub"), *earliest, F.count(F.lit(1)).alias("n")).filter("n > 1")
    tried = F.col("probe") & (F.col("vec_id") != F.col("hub"))
    like_hub = tried & _alike(("a", "b"), ("hub_a", "hub_b"), limit)
    # an id may come with several vectors, and only those of one sketch were compared as the earliest
    is_hub = F.expr("vec_id = hub AND a = hub_a AND b = hub_b")
    rows = members.join(sizes, "bucket").withColumn("like_hub", like_hub).withColumn("is_hub", is_hub)
    shared = materialize(rows.drop("hub_a", "hub_b"), "buckets")
    first = shared.filter("like_hub").select("vec_id", F.col("hub").alias("other")).distinct()
    settled = materialize(_verified(first, same, threshold), "settled")
    still = shared.filter(tried).join(settled, "vec_id", "left_anti")
    return shared, settled, still


def _pairs(still: DataFrame, shared: DataFrame, most: int, limit: int) -> DataFrame:
    """Open probes with the earlier members of their buckets whose sketches are alike. A bucket of more than ``most`` members is dealt to tiles of that size."""
    tiles = F.ceil(F.col("n") / most).cast("int")
    # of two members one is the earliest, which was tried
    probes = still.filter("n > 2").select("bucket", "vec_id", "a", "b", F.explode(F.sequence(F.lit(0), tiles - 1)).alias("tile"))
    others = shared.filter("n > 2 AND NOT is_hub").select(
        "bucket", F.col("vec_id").alias("other"), F.col("a").alias("c"), F.col("b").alias("d"), F.pmod(F.xxhash64("vec_id"), tiles).cast("int").alias("tile")
    )
    near = (F.col("other") < F.col("vec_id")) & _alike(("a", "b"), ("c", "d"), limit)
    return probes.join(others, ["bucket", "tile"]).filter(near).select("vec_id", "other").distinct()


def near_duplicates(
    vectors: DataFrame, dim: int, threshold: float = DUPLICATE_SIMILARITY, bits: int = 14, miss: float = 1e-9, seed: int = 11,
    crowded: int = CROWDED, deeper: int = 10, levels: int = 3,
) -> DataFrame:
    """Add ``is_duplicate``: an earlier vector of the same company has at least this cosine.

    Input: vec_id, company, embedding. Copies are settled by an aggregate. The rest meet in buckets of random
    hyperplane signs, a forest of sign prefixes, and are verified exactly. In each bucket everyone is first compared with its earliest
    member, which settles dense clusters in linear work. Where more than ``crowded`` members are left with
    open ones among them, the bucket grows: its members get further signs and part ways, in as many branches as
    keep a near pair together. Buckets that are still crowded after ``levels`` such steps hold vectors near the threshold
    of each other, and are compared in tiles of ``crowded``. Numbers of bands and branches
    follow from the threshold: two vectors at it miss each other with a chance of ``miss`` at most per level, closer ones less.
    Only pairs whose sketches, further signs that members carry, are alike meet their vectors; one at the threshold is not alike
    with that same chance at most. So pairs that merely share a bucket, whose number grows with its square, are never shuffled.
    """
    same = materialize(vectors.groupBy("company", "embedding").agg(F.min("vec_id").alias("vec_id")), "distinct-vectors")
    hashed = F.pandas_udf(_signs(dim, bands_for(threshold, bits, miss), bits, [seed]), "array<bigint>")
    sketched = F.pandas_udf(_signs(dim, 2, SKETCH_BITS, [seed, 0]), "array<bigint>")
    limit = sketch_limit(threshold, miss)
    signed = same.select("company", "vec_id", hashed("embedding").alias("bands"), sketched("embedding").alias("sketch")).select(
        "company", "vec_id", F.col("sketch")[0].alias("a"), F.col("sketch")[1].alias("b"), F.posexplode("bands").alias("band", "signs")
    )
    members = signed.select(F.xxhash64("company", "band", "signs").alias("bucket"), "vec_id", F.lit(True).alias("probe"), "a", "b")
    found = None
    for level in range(levels + 1):
        shared, settled, still = _settle(members, same, threshold, limit)
        large = F.col("n") > crowded
        if level == levels or still.filter(large).isEmpty():
            new = settled.unionByName(_verified(_pairs(still, shared, crowded, limit), same, threshold))
            found = new if found is None else found.unionByName(new)
            break
        new = settled.unionByName(_verified(_pairs(still.filter(~large), shared.filter(~large), crowded, limit), same, threshold))
        found = new if found is None else found.unionByName(new)
        # only buckets with open probes grow; all their members stay partners
        growing = still.filter(large).select("bucket").distinct()
        opened = still.filter(large).select("bucket", "vec_id", F.lit(True).alias("open"))
        grown = shared.filter(large).join(growing, "bucket", "left_semi").join(opened, ["bucket", "vec_id"], "left")
        more = F.pandas_udf(_signs(dim, bands_for(threshold, deeper, miss), deeper, [seed, level + 1]), "array<bigint>")
        branches = same.join(grown.select("vec_id").distinct(), "vec_id", "left_semi").select("vec_id", more("embedding").alias("signs"))
        members = grown.join(branches, "vec_id").select(
            "bucket", "vec_id", "a", "b", F.coalesce("open", F.lit(False)).alias("probe"), F.posexplode("signs").alias("branch", "signs")
        ).select(F.xxhash64("bucket", "branch", "signs").alias("bucket"), "vec_id", "probe", "a", "b")
    near = found.distinct().withColumn("near", F.lit(True))
    originals = same.select("vec_id", F.lit(True).alias("original"))
    return (
        vectors.join(originals, "vec_id", "left")
        .join(near, "vec_id", "left")
        .withColumn("is_duplicate", F.col("original").isNull() | F.coalesce("near", F.lit(False)))
        .drop("original", "near")
    )


def company_centroids(vectors: DataFrame) -> DataFrame:
    """Mean vector per company: one partial aggregate per company and dimension."""
    cells = vectors.select("company", F.posexplode("embedding").alias("pos", "x"))
    means = cells.groupBy("company", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("company").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda c: c["x"]).alias("query")
    )


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` vectors most like each company's query vector, ties by id.

    The company is matched first, so this is an equi-join with one query row
    per company, and Spark keeps k rows per company before the shuffle.
    """
    scored = skew.join(vectors, queries, ["company"], "inner").select(
        "company", "vec_id", F.round(V.cosine(F.col("embedding"), F.col("query")), 9).alias("similarity")
    )
    return skew.top_n(scored, ["company"], [F.col("similarity").desc(), F.col("vec_id")], k)


def nearest_to(vectors: DataFrame, query: list[float], k: int = 5) -> DataFrame:
    """The ``k`` vectors most like one given vector: a scan with a local top k."""
    q: Column = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.withColumn("similarity", V.cosine(F.col("embedding"), q))
    return scored.orderBy(F.col("similarity").desc_nulls_last(), "vec_id").limit(k)
