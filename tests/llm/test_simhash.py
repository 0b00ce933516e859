"""SimHash against brute force, also where buckets are cut into tiles."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from marketloom.llm import simhash
from marketloom.llm.components import components


def plain_fingerprint(text):
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    shingles = [b" ".join(tokens[i : i + 3]) for i in range(max(1, len(tokens) - 2))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    label = dict(prints)
    ids = list(prints)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x in range(len(ids)):
        for y in range(x):
            if (label[ids[x]] ^ label[ids[y]]).bit_count() <= 3:
                a, b = sorted((root(ids[x]), root(ids[y])))
                parent[b] = a
    return {i: root(i) for i in ids}


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(400)]
    made = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 200))) for _ in range(60)]
    for base in list(made[:20]):
        for _ in range(6):
            tokens = base.split()
            tokens[rng.randrange(len(tokens))] = rng.choice(vocabulary)
            made.append(" ".join(tokens))
    made += [made[0].upper(), "", None, " \t\n", "é É x", "one two", "x " * 70_000]
    return list(enumerate(made))


def test_against_brute_force(spark, docs):
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, fingerprint string")
    rows = simhash.near_duplicates(frame).collect()
    prints = {i: plain_fingerprint(t) for i, t in docs}
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r.doc_id: r.component_id for r in rows} == plain_components(prints)
    assert sum(r.kept for r in rows) == len({r.component_id for r in rows})


@pytest.mark.parametrize("tile", [3, 50, 4096])
def test_dense_group_in_tiles(spark, tile):
    rng = random.Random(2)
    prints = {0}
    while len(prints) < 300:
        prints.add(rng.choice(list(prints)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    while len(prints) < 400:
        prints.add(rng.getrandbits(64))
    values = sorted(prints)
    frame = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "simhash bigint")
    found = simhash.links(frame, tile=tile).collect()
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for r in found:
        a, b = (int(np.int64(x).view(np.uint64)) for x in (r.a, r.b))
        assert (a ^ b).bit_count() <= 3
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {v: root(v) for v in values} == plain_components({v: v for v in values})


def test_masks_meet_every_close_pair():
    masks = simhash.block_masks(3, 6)
    assert len(masks) == 20
    rng = random.Random(3)
    for _ in range(2000):
        change = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(change & m == 0 for m in masks)
    with pytest.raises(ValueError):
        simhash.block_masks(3, 3)


def test_nulls_repeats_and_empty(spark):
    frame = spark.createDataFrame([(None, "a b c"), (7, "a b c"), (7, "a b c"), (None, None)], "doc_id bigint, text string")
    rows = simhash.near_duplicates(frame).collect()
    assert sorted(str((r.doc_id, r.component_id)) for r in rows) == sorted(map(str, [(None, 7), (7, 7), (7, 7), (None, None)]))
    assert simhash.near_duplicates(frame.limit(0)).count() == 0


def test_components_of_chain_star_and_loops(spark):
    chain = [(i, i + 1) for i in range(0, 200)]
    star = [(1000, i) for i in range(1001, 1400)]
    frame = spark.createDataFrame([*chain, *star, (5, 5), (None, 3)], "a bigint, b bigint")
    got = {r.node: r.component for r in components(frame).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{i: 1000 for i in range(1000, 1400)}}
    assert components(frame.filter(F.lit(False))).count() == 0


def test_one_of_each_keeps_columns_of_any_name(spark):
    rows = [(1, "a b c", 7, 8, 9), (2, "a b c", 1, 2, 3), (None, None, 4, 5, 6), (None, "", 4, 5, 6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, __row int, number int, row int")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(tuple(r)[2:] for r in kept.collect()) == [(4, 5, 6), (7, 8, 9)]
