"""Substring search over tables against looking into every text."""

import random

import numpy as np
import pytest

from marketloom.operators import substrings


def brute(texts, needles):
    return {(n, h) for n, needle in needles for h, text in texts if needle and text and needle in text}


@pytest.fixture(params=["sent", "joined"], autouse=True)
def way(request, monkeypatch):
    """Both ways to meet: needles sent to the texts, and places joined with them."""
    if request.param == "joined":
        monkeypatch.setattr(substrings.containing, "__defaults__", (0,))


def found(spark, texts, needles):
    hay = spark.createDataFrame(texts, "hay_id bigint, text string")
    asked = spark.createDataFrame(needles, "needle_id bigint, needle string")
    rows = substrings.containing(hay, asked).collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


@pytest.mark.parametrize("seed", range(3))
def test_needles_of_every_length(spark, seed):
    chosen = random.Random(seed)
    alphabet = "ab" if seed == 0 else "abcdé 中𝄞"
    texts = [(i, "".join(chosen.choices(alphabet, k=chosen.randint(0, 300)))) for i in range(150)] + [(999, None), (998, "")]
    needles = []
    for i in range(300):
        text = chosen.choice(texts)[1] or "x"
        size = chosen.choice([1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 30, 47, 48, 49, 120])
        at = chosen.randint(0, max(0, len(text) - size))
        needle = text[at : at + size]
        if chosen.random() < 0.3:
            needle = needle[:-1] + chosen.choice(alphabet)
        needles.append((i, needle))
    needles += [(1000, None), (1001, ""), (1002, needles[0][1])]
    assert found(spark, texts, needles) == brute(texts, needles)


def test_a_very_common_needle_and_a_third_of_equal_texts(spark):
    texts = [(i, "of the best" if i % 3 == 0 else f"text {i} of the day") for i in range(600)]
    needles = [(1, "of the"), (2, "of the best"), (3, "t"), (4, "text 7 of"), (5, "of the worst"), (6, " ")]
    assert found(spark, texts, needles) == brute(texts, needles)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == set()
    assert found(spark, [(1, "a")], []) == set()


@pytest.mark.parametrize("level", range(len(substrings.CLASSES)))
def test_a_text_chooses_what_its_parts_choose(level):
    least, gram, window = substrings.CLASSES[level]
    assert gram + window - 1 <= least
    rng = np.random.default_rng(level)
    text = rng.integers(97, 100, 400).astype(np.uint32)
    _, whole = substrings.chosen(text, np.array([400]), level)
    for at in range(0, 400 - least):
        _, part = substrings.chosen(text[at : at + least], np.array([least]), level)
        assert len(part) and set(part.tolist()) <= set(whole.tolist())


def test_few_keys_of_a_text_are_looked_up(monkeypatch):
    rng = np.random.default_rng(5)
    keys, own = rng.integers(0, 1 << 64, 50_000, np.uint64), rng.random(50_000) < 0.8
    listed = np.unique(np.concatenate([keys[::500], rng.integers(0, 1 << 64, 300, np.uint64)]).view(np.int64))
    looked, search = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *rest: looked.append(len(v)) or search(a, v, *rest))
    places, at = substrings._listed(keys, own, listed, substrings._marks(listed))
    assert sum(looked) < 0.05 * len(keys)
    assert places.tolist() == np.flatnonzero(own & np.isin(keys.view(np.int64), listed)).tolist()
    assert (listed[at] == keys[places].view(np.int64)).all()


@pytest.mark.parametrize("level", range(len(substrings.CLASSES)))
def test_grams_of_short_and_empty_texts(level):
    """Texts in a row choose what each would choose alone."""
    rng = np.random.default_rng(level)
    texts = [rng.integers(97, 100, n).astype(np.uint32) for n in (0, 3, 1, 0, 0, 70, 2, 16, 49, 48, 0, 5, 200, 1, 0)]
    ends = np.cumsum([len(t) for t in texts])
    want = [(p + end - len(t), k) for t, end in zip(texts, ends) for p, k in zip(*substrings.chosen(t, np.array([len(t)]), level))]
    places, keys = substrings.chosen(np.concatenate(texts), ends, level)
    assert list(zip(places.tolist(), keys.tolist())) == want
