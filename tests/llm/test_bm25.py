"""Pruned search against scoring everything, over several shards and query blocks."""

import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marketloom.llm import bm25
from marketloom.llm.common import words


def plain(docs, queries, k):
    counts = [(i, Counter((t or "").encode().lower().split())) for i, t in docs]
    n, mean = len(docs), sum(sum(c.values()) for _, c in counts) / len(docs)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for q, text in queries:
        terms = sorted(set((text or "").encode().lower().split()))
        scored = []
        for i, c in counts:
            length = sum(c.values())
            s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * length / mean)) for t in terms if t in c)
            if s:
                scored.append((-round(s, 6), i is None, i or 0))
        out += [(q, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return out


@pytest.mark.parametrize("shard_docs, at_once", [(8192, 1024), (70, 7)])
def test_against_scoring_everything(spark, shard_docs, at_once):
    rng = random.Random(2)
    vocabulary = [f"w{int(rng.paretovariate(0.7)) % 500}" for _ in range(3000)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 120)))) for i in range(600)]
    docs += [(600, docs[3][1]), (601, docs[3][1].upper()), (602, None), (603, ""), (None, docs[3][1]), (604, "w1 " * 20_000), (605, "é日本")]
    docs += [(700, docs[4][1]), (700, docs[4][1])]
    queries = [(i, t) for i, t in docs if i is not None and i % 20 == 3][:40] + [(-1, None), (-2, "nowhere"), (-3, "w1 w1 w2"), (-4, "é日本 w3")]
    frame = spark.createDataFrame([(i, t, 1.0) for i, t in docs], "doc_id bigint, text string, score double").repartition(3)
    asked = spark.createDataFrame([*queries, (None, "w1")], "query_id bigint, text string")
    rows = bm25.top_k(frame, asked, 10, shard_docs, at_once).collect()
    got = sorted((r.query_id, r["rank"], str(r.doc_id), r.score) for r in rows)
    want = sorted((q, r, str(i), s) for q, r, i, s in plain(docs, queries, 10))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(math.isclose(g[3], w[3], abs_tol=2e-6) for g, w in zip(got, want))


def test_no_rows(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    queries = docs.select(F.col("doc_id").alias("query_id"), "text")
    assert bm25.top_k(docs.limit(0), queries).count() == 0
    assert bm25.top_k(docs, queries.limit(0)).count() == 0


def test_a_reader_holds_one_shard(spark):
    docs = spark.createDataFrame([(i, f"a b{i} c{i % 7}") for i in range(100)], "doc_id bigint, text string").coalesce(1)
    index = bm25.build_index(docs, 30)
    assert index.count() == len(index.inputFiles()) == 4


@pytest.mark.parametrize("limits", [{"CELLS": 0}, {"CELLS": 700, "POSTINGS": 50, "TOGETHER": 3}, {"COMMON": 1000, "BLOCK": 4}, {"SHARD_WORDS": 200, "WORDS_AT_ONCE": 300}])
def test_matrix_and_postings_score_alike(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(bm25, name, value)
    rng = random.Random(3)
    docs = [(i, " ".join(f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(rng.randint(0, 60)))) for i in range(250)]
    docs += [(300 + i, docs[i][1]) for i in range(30)]
    queries = [(i, t) for i, t in docs if i % 9 == 0]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(2)
    rows = bm25.top_k(frame, spark.createDataFrame(queries, "query_id bigint, text string"), 5).collect()
    got = sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in rows)
    want = sorted(plain(docs, queries, 5))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(math.isclose(g[3], w[3], abs_tol=2e-6) for g, w in zip(got, want))


@pytest.mark.parametrize("limits", [{"GROUP_DOCS": 20, "FIRST": 2, "PIECE": 7}, {"GROUP_DOCS": 30, "COMMON": 3, "WORDS_BY_DRIVER": 90, "WORDS_AT_ONCE": 900}])
def test_groups_and_pieces_score_alike(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(bm25, name, value)
    rng = random.Random(5)
    docs = [(i, " ".join(f"{'ab'[i % 2]}{int(rng.paretovariate(0.6)) % 300}" for _ in range(rng.randint(0, 60)))) for i in range(250)]
    # a word of every document weighs next to nothing, and is all that some share
    docs = [(i, f"{t} every") for i, t in docs] + [(300 + i, docs[i][1]) for i in range(30)] + [(400 + i, "every") for i in range(5)]
    queries = [(i, t) for i, t in docs if i % 9 == 0] + [(-1, "every")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(2)
    rows = bm25.top_k(frame, spark.createDataFrame(queries, "query_id bigint, text string"), 5, 60).collect()
    got = sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in rows)
    want = sorted(plain(docs, queries, 5))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(math.isclose(g[3], w[3], abs_tol=2e-6) for g, w in zip(got, want))


def test_most_shards_answer_with_few_documents(spark, monkeypatch):
    found, stored = [], bm25.stored

    def kept(df, label):
        out = stored(df, label)
        found.extend([out] * (label == "bm25-found"))
        return out

    monkeypatch.setattr(bm25, "stored", kept)
    rng = random.Random(7)
    docs = [(i, " ".join(f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(40))) for i in range(960)]
    queries = docs[::48]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(32)
    rows = bm25.top_k(frame, spark.createDataFrame(queries, "query_id bigint, text string"), 5).collect()
    assert sorted((r.query_id, r["rank"], r.doc_id) for r in rows) == [w[:3] for w in sorted(plain(docs, queries, 5))]
    # 32 shards with five documents for each query would be 160 of them
    assert sum(f.count() for f in found) < 90 * len(queries)


def test_words_are_split_alike():
    odd = "".join(map(chr, range(1, 128)))
    some = [odd, "", None, "  ", " a  B\tc\n", "\x1ca b\x85c", "\u00c9t\u00c9 \u00e9\u00a0X", *(f"{chr(c)}a{chr(c) * 2}B{chr(c)}" for c in range(1, 256))]
    assert bm25.split(pa.array(some)).to_pylist() == [words(t or "") for t in some]
    assert bm25.split(pa.array(some).slice(2, 4)).to_pylist() == [words(t or "") for t in some[2:6]]
