"""The mix against plain sums, also where sizes are cut into slices."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from marketloom.llm import mixing


def plain_targets(sizes):
    """Share out by weight, hand the excess of full sources to the rest, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total = 1.5 * sum(sizes.values())
    full = set()
    while True:
        left = total - sum(2 * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in order if s not in full)
        goal = {s: 2.0 * sizes[s] if s in full else left * weight[s] / open_weight for s in order}
        above = {s for s in order if s not in full and goal[s] > 2 * sizes[s]}
        if not above:
            return goal
        full |= above


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    names = ["hot", "b", "é", None, "tiny", "z", "none"]
    out = [(i, rng.choices(names, [600, 100, 80, 60, 2, 200, 0])[0], rng.choice([5, 5, 5, 40, rng.randint(1, 3000)])) for i in range(3000)]
    return out + [(None, "b", 7), (None, "b", 7), (1, "b", 9), (1, "b", 9), (5000, "none", 0)]


@pytest.mark.parametrize("slice_rows", [65_536, 40])
def test_mix_against_plain_sums(spark, rows, slice_rows):
    frame = spark.createDataFrame([(i, s, n, 1.0) for i, s, n in rows], "doc_id bigint, source string, size bigint, target double")
    got = mixing.mix(frame, slice_rows=slice_rows).collect()
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n
        largest[s] = max(largest[s], n)
    goal = plain_targets(sizes)
    assert len(got) == len(rows)
    for r in got:
        assert math.isclose(r.target, goal[r.source], rel_tol=1e-9, abs_tol=1e-9) and r.source_size == sizes[r.source]
        assert 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= largest[s] + 1e-6
    again = mixing.mix(frame, slice_rows=slice_rows).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_empty(spark):
    frame = spark.createDataFrame([], "doc_id bigint, source string, size bigint")
    assert mixing.mix(frame).count() == 0
    docs = spark.createDataFrame([], "doc_id bigint, source string, text string, size int")
    assert mixing.mix_documents(docs).columns == docs.columns


def test_only_empty_texts(spark):
    docs = spark.createDataFrame([(1, "a", None), (2, None, "")], "doc_id bigint, source string, text string")
    assert mixing.mix_documents(docs).count() == 0


def test_columns_of_any_name(spark):
    rows = [(1, "a b c d", "s", 1, 2, 3, 4, 5), (2, "a b", None, 1, 2, 3, 4, 5), (None, None, "s", 1, 2, 3, 4, 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, rate int, before int, __row int, number int, copy int")
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert set(map(tuple, mixed.collect())) <= set(rows) and mixed.count() > 0
    sized = docs.withColumn("size", mixing.word_count(F.col("text")))
    assert mixing.mix(sized).columns == [*sized.columns, "source_size", "target", "copies"]
