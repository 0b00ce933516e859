"""Held-out accuracy on invented texts, misspelt insults included, and odd inputs."""

import random
import zlib

import pytest

from marketloom.llm import toxicity

INSULTS = "trash pathetic idiot disgusting worthless stupid clown loser scum moron".split()


def made(rng, toxic, spoil=0.0):
    syllables = "on er th ing re en at ou st nd ti ha ed ly an es wh or".split()
    words = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(20, 150))]
    if toxic:
        for _ in range(max(2, len(words) // 25)):
            word = rng.choice(INSULTS)
            words.insert(rng.randrange(len(words)), toxicity.misspell(word, rng) if rng.random() < spoil else word)
    return " ".join(words)


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(8)
    return [(i, made(rng, i % 4 == 0), int(i % 4 == 0)) for i in range(1600)]


def test_held_out_rows_and_misspellings(spark, labelled):
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t, _ in labelled], "doc_id bigint, text string, toxic string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in labelled], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels, sample={1: 400, 0: 800})
    rows = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [(rows[i].predicted, y) for i, _, y in labelled if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(rows[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in labelled)
    assert sum(p == y for p, y in held) / len(held) > 0.95
    rng = random.Random(9)
    rate = toxicity.scorer(model)
    spoilt = rate([made(rng, True, 0.3) for _ in range(100)])
    assert sum(s >= 0.3 for s in spoilt) > 70
    kept = toxicity.clean(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if not r.predicted}
    odd = spark.createDataFrame([(None, "a b"), (1, ""), (2, None), (2, None), (3, "x " * 100_000)], "doc_id bigint, text string")
    got = toxicity.score(odd, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.clean(odd, model).count() == sum(r.score < 0.3 for r in got)


def test_no_labels_or_one_class(spark, labelled):
    docs = spark.createDataFrame([(1, "a"), (4, None)], "doc_id bigint, text string")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id bigint, toxic int")
    assert [r.predicted for r in toxicity.score(docs, toxicity.train(docs, none)).collect()] == [0, 0]
    ones = spark.createDataFrame([(1, 1), (4, 1)], "doc_id bigint, toxic int")
    assert [r.predicted for r in toxicity.score(docs, toxicity.train(docs, ones)).collect()] == [1, 1]
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), none)).count() == 0


def test_grams_are_those_of_each_word():
    words = [b"ab", "né".encode(), b""]
    bucket, owner = toxicity.grams(words)
    marked = [b"<" + w + b">" for w in words]
    assert [sum(owner == i) for i in range(3)] == [sum(max(0, len(w) - n + 1) for n in toxicity.GRAMS) for w in marked]
    alone = toxicity.grams(words[:1])[0]
    assert sorted(alone) == sorted(bucket[owner == 0])
