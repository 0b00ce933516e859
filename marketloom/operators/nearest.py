"""The most similar vectors of a whole store for a table of queries, exactly.

The store is cut into shards. Each shard gets pivots, spread over it by always
taking the vector farthest from those already taken; every vector is
kept in the ball of its nearest pivot, with the angle to it. The angle between query
and pivot then bounds the angle between query and member from below (angles obey the
triangle inequality), so a ball, or a part of it, that cannot beat the k-th answer is
not scored. Shards meet blocks of queries by an equi-join on (shard, block), keep k
answers per query, and the answers of all shards are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.operators import skew
from marketloom.session import materialize

SHARD_ROWS = 20_000
BLOCK_ROWS = 2_000
PIVOTS = 256
#: Answers are told apart by their similarity to this many digits, then by id.
DIGITS = 9
#: Angles and similarities are bounds up to this much rounding.
SLACK = 2e-8

INDEX = "shard bigint, vec_id bigint, embedding array<double>, pivot int, angle double"
FOUND = "query_id bigint, vec_id bigint, similarity double, scored bigint"


def unit_rows(column) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have a direction, their unit vectors): null, zero and non-finite vectors have none."""
    rows = [np.asarray(v, np.float64) if v is not None else np.zeros(0) for v in column]
    width = max((len(r) for r in rows), default=0)
    kept = [i for i, r in enumerate(rows) if len(r) == width and np.isfinite(r).all() and np.any(r != 0)]
    if not kept:
        return np.zeros(0, np.int64), np.zeros((0, width))
    matrix = np.stack([rows[i] for i in kept])
    matrix /= np.abs(matrix).max(axis=1, keepdims=True)
    return np.array(kept), matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def spread_pivots(vectors: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pivots, nearest pivot of each vector, angle to it); the next pivot is the vector farthest from all before."""
    count = max(1, min(most, int(np.sqrt(len(vectors)) * 2)))
    chosen = [0]
    nearest = np.zeros(len(vectors), np.int32)
    angle = angles(vectors, vectors[:1])[:, 0]
    while len(chosen) < count:
        far = int(angle.argmax())
        if angle[far] <= 0:
            break
        new = angles(vectors, vectors[far : far + 1])[:, 0]
        closer = new < angle
        nearest[closer], angle[closer] = len(chosen), new[closer]
        chosen.append(far)
    return np.array(chosen), nearest, angle


def index(vectors: DataFrame, shard_rows: int = SHARD_ROWS, pivots: int = PIVOTS) -> DataFrame:
    """(shard, vec_id, embedding, pivot, angle) of vec_id and embedding; pivots come as rows without an id.

    Shards are dealt by a hash of the id, so that each has about ``shard_rows`` rows whatever
    the ids are; vectors without a direction are left out. Vectors of a shard lie in the order
    of their ball and angle.
    """
    shards = max(1, -(-vectors.count() // shard_rows))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        kept, unit = unit_rows(frame["embedding"])
        if not len(kept):
            return pd.DataFrame({"shard": [], "vec_id": [], "embedding": [], "pivot": [], "angle": []})
        chosen, nearest, angle = spread_pivots(unit, pivots)
        order = np.lexsort((angle, nearest))
        ids = pd.array(frame["vec_id"].to_numpy()[kept][order], dtype="Int64")
        shard = int(frame["shard"].iloc[0])
        members = pd.DataFrame({"vec_id": ids, "embedding": list(unit[order]), "pivot": nearest[order], "angle": angle[order]})
        heads = pd.DataFrame({"vec_id": pd.array([None] * len(chosen), dtype="Int64"), "embedding": list(unit[chosen]), "pivot": np.arange(len(chosen)), "angle": np.zeros(len(chosen))})
        out = pd.concat([heads, members], ignore_index=True)
        out.insert(0, "shard", shard)
        return out

    dealt = vectors.filter("vec_id IS NOT NULL").select(
        F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"), F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>")
    )
    return dealt.groupBy("shard").applyInPandas(build, INDEX)


class Shard:
    """Vectors in balls around pivots, searched for the ``k`` most similar ones."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, ball: np.ndarray, angle: np.ndarray, pivots: np.ndarray) -> None:
        order = np.lexsort((angle, ball))
        self.ids, self.vectors, self.angle = ids[order], vectors[order], angle[order]
        self.pivots = pivots
        self.start = np.searchsorted(ball[order], np.arange(len(pivots) + 1))
        full = self.start[1:] > self.start[:-1]
        self.low = np.where(full, self.angle[np.minimum(self.start[:-1], len(ids) - 1)], np.inf)
        self.high = np.where(full, self.angle[np.maximum(self.start[1:], 1) - 1], -np.inf)

    def search(self, queries: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """Per query (ids, similarities to ``DIGITS``, vectors scored): the best ``k`` by similarity and then id."""
        to_pivots = angles(queries, self.pivots)
        bounds = np.maximum(0.0, np.maximum(to_pivots - self.high, self.low - to_pivots))
        for query, near, bound in zip(queries, to_pivots, bounds):
            ids, similar = np.zeros(0, np.int64), np.zeros(0)
            reach, scored = np.inf, 0
            for ball in np.argsort(bound):
                if bound[ball] > reach:
                    break
                first, last = self.start[ball], self.start[ball + 1]
                if np.isfinite(reach):  # only members at angles that can be near enough
                    part = self.angle[first:last]
                    first, last = first + np.searchsorted(part, near[ball] - reach), first + np.searchsorted(part, near[ball] + reach, "right")
                if first >= last:
                    continue
                scored += int(last - first)
                ids = np.concatenate([ids, self.ids[first:last]])
                similar = np.concatenate([similar, np.round(self.vectors[first:last] @ query, DIGITS)])
                if len(ids) >= k:
                    best = np.lexsort((ids, -similar))[:k]
                    ids, similar = ids[best], similar[best]
                    reach = np.arccos(np.clip(similar[-1] - SLACK, -1.0, 1.0)) + SLACK
            best = np.lexsort((ids, -similar))[:k]
            yield ids[best], similar[best], scored


def _tile(k: int):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        pivot, ids = left.column("pivot").to_numpy(), left.column("vec_id").to_pandas()
        out = {"query_id": [], "vec_id": [], "similarity": [], "scored": []}
        if left.num_rows and right.num_rows:
            flat = left.column("embedding").combine_chunks()
            matrix = flat.flatten().to_numpy().reshape(left.num_rows, -1)
            head = ids.isna().to_numpy()
            order = np.argsort(pivot[head], kind="stable")
            member = ~head
            shard = Shard(
                ids[member].to_numpy(np.int64), matrix[member], pivot[member], left.column("angle").to_numpy()[member], matrix[head][order]
            )
            kept, queries = unit_rows(right.column("embedding").to_pylist())
            names = right.column("query_id").to_numpy()[kept]
            if len(kept) and queries.shape[1] == matrix.shape[1]:
                for name, (found, similar, scored) in zip(names, shard.search(queries, k)):
                    out["query_id"].append(np.full(len(found), name))
                    out["vec_id"].append(found)
                    out["similarity"].append(similar)
                    out["scored"].append(np.full(len(found), scored))
        whole = [np.concatenate(v) if v else np.zeros(0) for v in out.values()]
        types = [pa.int64(), pa.int64(), pa.float64(), pa.int64()]
        return pa.table([pa.array(v).cast(t) for v, t in zip(whole, types)], names=list(out))

    return run


def candidates(
    vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, pivots: int = PIVOTS
) -> DataFrame:
    """(query_id, vec_id, similarity, scored): the best ``k`` of each shard for each query, and how many of it were scored."""
    store = materialize(index(vectors, shard_rows, pivots), "vector-index")
    asked = materialize(queries.select(F.col("query_id").cast("bigint"), F.col("embedding").cast("array<double>")), "vector-queries")
    blocks = max(1, -(-asked.count() // block_rows))
    shards = store.select("shard").distinct()
    # every shard meets every block of queries; a row goes to as many tiles as there are on the other side
    left = store.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    numbers = F.array_sort(F.collect_set("shard"))
    right = (
        asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
        .join(F.broadcast(shards.agg(numbers.alias("shards"))))  # one row
        .select(F.explode("shards").alias("shard"), "block", "query_id", "embedding")
    )
    return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(_tile(k), FOUND)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, **options) -> DataFrame:
    """(query_id, vec_id, similarity, rank): the ``k`` vectors of the whole store most like each query, ties by id.

    ``vectors`` has vec_id and embedding, ``queries`` query_id and embedding. Similarity is the cosine in double
    precision to nine digits. Vectors and queries without a direction find and are found by nothing;
    a repeated query_id must not occur, and repeated vectors are as many answers.
    """
    found = candidates(vectors, queries, k, **options).drop("scored")
    return skew.top_n(found, ["query_id"], [F.col("similarity").desc(), F.col("vec_id")], k)
