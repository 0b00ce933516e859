"""Whole-store search against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.operators import nearest


def brute(ids, vectors, query, k):
    with np.errstate(invalid="ignore", divide="ignore"):
        similar = [round(float(np.dot(v, query) / (np.linalg.norm(v) * np.linalg.norm(query))), 9) for v in vectors]
    return sorted(zip(ids, similar), key=lambda p: (-p[1], p[0]))[:k]


def clustered(rng, n, dim, centres, spread=0.08):
    heads = rng.standard_normal((centres, dim))
    heads /= np.linalg.norm(heads, axis=1, keepdims=True)
    # a third of all vectors lie in the first cluster
    of = np.where(rng.random(n) < 1 / 3, 0, rng.integers(0, centres, n))
    return heads[of] + spread * rng.standard_normal((n, dim)) / np.sqrt(dim)


@pytest.mark.parametrize("kind", ["clusters", "noise", "copies"])
def test_answers_are_those_of_all_pairs(spark, kind):
    rng = np.random.default_rng(3)
    n, dim, k = 900, 12, 7
    vectors = clustered(rng, n, dim, 20) if kind == "clusters" else rng.standard_normal((n, dim))
    if kind == "copies":
        vectors = vectors[np.where(rng.random(n) < 1 / 3, 0, rng.integers(0, 30, n))] * rng.uniform(0.5, 2, (n, 1))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    store = spark.createDataFrame(rows + [(2000, [0.0] * dim), (2001, None), (None, rows[0][1]), (2002, [float("nan")] * dim)], "vec_id bigint, embedding array<double>")
    asked = [(i, rows[i][1]) for i in range(0, n, 50)] + [(5000, [0.0] * dim), (5001, None)]
    queries = spark.createDataFrame(asked, "query_id bigint, embedding array<double>")
    got = {}
    for r in nearest.nearest(store, queries, k, shard_rows=250, block_rows=6, pivots=16).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.similarity)
    assert set(got) == {i for i, _ in asked if i < 5000}
    for i, query in asked[:-2]:
        want = brute(range(n), vectors, np.array(query), k)
        found = [got[i][r] for r in range(1, k + 1)]
        assert [f[0] for f in found] == [w[0] for w in want]
        assert np.allclose([f[1] for f in found], [w[1] for w in want], atol=2e-9)


def test_far_balls_are_not_scored(spark):
    rng = np.random.default_rng(5)
    vectors = clustered(rng, 4000, 16, 60)
    store = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")
    queries = store.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = nearest.candidates(store, queries, 5, shard_rows=2000)
    scored = found.groupBy("query_id").agg(F.sum_distinct("scored").alias("n")).agg(F.sum("n")).first()[0]
    # a third of the vectors share one cluster, which its own queries must look through
    assert scored / (80 * 4000) < 0.35


def test_empty_tables(spark):
    none = spark.createDataFrame([], "vec_id bigint, embedding array<double>")
    one = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id bigint, embedding array<double>")
    ask = one.withColumnRenamed("vec_id", "query_id")
    assert nearest.nearest(none, ask).count() == 0
    assert nearest.nearest(one, ask.limit(0)).count() == 0
    assert [(r.vec_id, r.similarity) for r in nearest.nearest(one, ask).collect()] == [(1, 1.0)]
