"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import emit, texts, training_fold, words

#: Rows to learn from, at most, of each class; the bound on what the driver gathers.
SAMPLE = {1: 2000, 0: 4000}
#: Passages to learn from, at most, of each sampled document, and words in a passage.
PASSAGES = 4
WIDTH = 128

BUCKETS = 1 << 17
DIM = 8
GRAMS = (3, 4, 5, 6)
EPOCHS = 6
BATCH = 64
RATE = 3.0
#: A text's mean is taken as if it had this many more words that say nothing, so that a few odd words are no verdict.
QUIET = 8
#: Share of the words that are misspelt anew in each pass.
MISSPELT = 0.5
#: An n-gram in fewer batches than this, in the mean of all passes, is not learned.
SEEN = 0.5
CUTOFF = 0.3
#: Scored words that a task keeps, and words that are scored at once.
CACHE = 400_000
AT_ONCE = 10_000

#: Signs that stand for letters in disguised words.
LEET = {"a": "@4", "e": "3", "i": "1!", "o": "0", "s": "$5", "t": "7", "l": "1"}


def grams(vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word number) of every character n-gram of every word, word ends marked; on UTF-8 bytes, without a loop over words."""
    data = np.frombuffer(b"".join([b"<%b>" % w for w in vocabulary]), np.uint8).astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in vocabulary], np.int64)
    owner = np.repeat(np.arange(len(vocabulary)), lengths)
    buckets, owners = [], []
    for n in GRAMS:
        if len(data) < n:
            continue
        inside = np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :])
        value = np.full(len(inside), n, np.uint64)
        for k in range(n):
            value = (value ^ data[inside + k]) * np.uint64(0x100000001B3)
        value ^= value >> np.uint64(29)
        buckets.append((value % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(owner[inside])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(owners)


def misspell(word: str, rng: random.Random) -> str:
    if len(word) < 4:
        return word
    at = rng.randrange(1, len(word) - 1)
    how = rng.randrange(5)
    if how == 0:
        return word[:at] + word[at + 1 :]
    if how == 1:
        return word[:at] + word[at] + word[at:]
    if how == 2:
        return word[:at] + word[at + 1] + word[at] + word[at + 2 :]
    if how == 3:
        return word[:at] + rng.choice("*.-_") + word[at + rng.randrange(2) :]
    return "".join(rng.choice(LEET[c]) if c in LEET and rng.random() < 0.6 else c for c in word)


def passages(count: int, width: int = WIDTH) -> np.ndarray:
    """First words of the passages of a text of ``count`` words; the last passage is a full one where the text has that many."""
    starts = np.arange(0, max(count, 1), width)
    starts[-1] = max(0, min(starts[-1], count - width))
    return starts


@dataclass
class Model:
    """The trained model, folded: a text's log odds are the mean of its words' scores, drawn towards 0 in short texts, plus ``bias``.

    A word's score is the mean of its n-grams' embeddings times the difference of
    the two softmax rows. ``scale`` and ``shift`` turn log odds into the probability.
    """

    gram: np.ndarray
    bias: float = 0.0
    scale: float = 0.0
    shift: float = -30.0

    def word_scores(self, vocabulary: list[bytes]) -> np.ndarray:
        scores = np.zeros(len(vocabulary))
        for at in range(0, len(vocabulary), AT_ONCE):
            part = vocabulary[at : at + AT_ONCE]
            bucket, owner = grams(part)
            total = np.bincount(owner, self.gram[bucket], len(part))
            scores[at : at + len(part)] = total / np.maximum(np.bincount(owner, minlength=len(part)), 1)
        return scores

    def odds(self, scores: np.ndarray) -> float:
        """Log odds of a text with these word scores."""
        return float(scores.sum()) / (len(scores) + QUIET) + self.bias

    def probability(self, odds: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.scale * odds + self.shift, -40, 40))))


def _learn_passages(
    rows: list[np.ndarray], target: np.ndarray, vocabulary: list[bytes], seed: int, epochs: int = EPOCHS, misspelt: float = MISSPELT
) -> tuple[np.ndarray, float]:
    """Embeddings and softmax rows by stochastic gradient descent; returns each n-gram's score and the bias."""
    rng, chance = np.random.default_rng(seed), random.Random(seed)
    embed = rng.normal(0, 0.1, (BUCKETS, DIM))
    soft = np.zeros((2, DIM))
    soft[1], soft[0] = rng.normal(0, 1, (2, DIM))
    bias = np.zeros(2)
    squares = np.full(BUCKETS, 1e-4)
    seen = np.zeros(BUCKETS, np.int64)
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            flat = np.concatenate([rows[i] for i in chosen])
            of_row = np.repeat(np.arange(len(chosen)), [len(rows[i]) for i in chosen])
            kinds, inverse = np.unique(flat, return_inverse=True)
            spelt = [vocabulary[k] for k in kinds]
            spelt = [misspell(w.decode(), chance).encode() if chance.random() < misspelt else w for w in spelt]
            bucket, owner = grams(spelt)
            used, place = np.unique(bucket, return_inverse=True)
            # weight of each used n-gram in each word, then of each word in each passage: both are means
            per_word = 1.0 / np.maximum(np.bincount(owner, minlength=len(spelt)), 1)
            vectors = embed[used]
            word = np.stack([np.bincount(owner, vectors[place, d], len(spelt)) for d in range(DIM)], axis=1) * per_word[:, None]
            sizes = np.bincount(of_row, minlength=len(chosen))[:, None]
            hidden = np.stack([np.bincount(of_row, word[inverse, d], len(chosen)) for d in range(DIM)], axis=1) / sizes
            odds = hidden @ soft.T + bias
            share = np.exp(odds - odds.max(axis=1, keepdims=True))
            share /= share.sum(axis=1, keepdims=True)
            error = share
            error[np.arange(len(chosen)), target[chosen]] -= 1
            down = error @ soft / sizes
            back_word = np.stack([np.bincount(inverse, down[of_row, d], len(spelt)) for d in range(DIM)], axis=1) * per_word[:, None]
            back = np.stack([np.bincount(place, back_word[owner, d], len(used)) for d in range(DIM)], axis=1)
            soft -= 0.05 * rate * (error.T @ hidden) / len(chosen) * WIDTH
            bias -= 0.2 * rate * error.mean(axis=0)
            seen[used] += 1
            squares[used] += (back**2).mean(axis=1)
            embed[used] -= rate * back / np.sqrt(squares[used])[:, None]
    return np.where(seen >= SEEN * epochs, embed @ (soft[1] - soft[0]), 0.0), float(bias[1] - bias[0])


def _fit_scale(odds: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one number, by Newton steps with a little shrinkage."""
    design = np.stack([odds, np.ones(len(odds))], axis=1)
    beta = np.array([1.0, -2.0])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (weight * (p - target)) + np.array([1e-2 * (beta[0] - 1.0), 1e-3 * beta[1]])
        curve = (design * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ design + np.diag([1e-2, 1e-3])
        step = np.linalg.solve(curve, slope)
        beta -= step * min(1.0, 4.0 / np.abs(step).max())
    return max(float(beta[0]), 1e-3), float(beta[1])


def fit(rows: list[tuple[str, int]], totals: dict[int, int], seed: int = 5) -> Model:
    """Train on (text, label) rows; ``totals`` are the classes' counts among all labelled rows.

    Four fifths of the rows train the embeddings and the softmax on passages, each
    with its document's label. The rest of the rows set how the mean over a document maps
    to a probability, weighted so that the sample stands for all rows. A class
    without rows gives a model that always answers the other one, no rows at all 0.
    """
    labels = {label for _, label in rows}
    if labels != {0, 1}:
        return Model(np.zeros(BUCKETS), shift=30.0 if labels == {1} else -30.0)
    chance = random.Random(seed)
    index: dict[bytes, int] = {}
    tokens = [np.array([index.setdefault(w, len(index)) for w in words(t)], np.int32) for t, _ in rows]
    vocabulary = list(index)
    order = list(range(len(rows)))
    chance.shuffle(order)
    held = set(order[: len(order) // 5])
    train, target = [], []
    for i, (_, label) in enumerate(rows):
        if i in held or not len(tokens[i]):
            continue
        starts = passages(len(tokens[i])).tolist()
        for s in starts if len(starts) <= PASSAGES else chance.sample(starts, PASSAGES):
            train.append(tokens[i][s : s + WIDTH])
            target.append(label)
    if not train:
        return Model(np.zeros(BUCKETS), shift=float(np.log((totals[1] + 0.5) / (totals[0] + 0.5))))
    model = Model(*_learn_passages(train, np.array(target), vocabulary, seed))
    scores = model.word_scores(vocabulary)
    fitted = [i for i in range(len(rows)) if i in held] if len(rows) >= 200 else list(range(len(rows)))
    odds = np.array([model.odds(scores[tokens[i]]) for i in fitted])
    truth = np.array([rows[i][1] for i in fitted])
    count = np.maximum(np.bincount(truth, minlength=2), 1)
    weight = np.array([totals[0] / count[0], totals[1] / count[1]])[truth]
    model.scale, model.shift = _fit_scale(odds, truth, weight * len(fitted) / weight.sum())
    return model


def train(docs: DataFrame, labels: DataFrame, seed: int = 5, sample: dict[int, int] | None = None) -> Model:
    """Fit on labelled documents whose crc32(doc_id as text) leaves other than 2 by 4.

    At most ``sample`` rows of each class, in an order given by a hash of the id, come to the
    driver with their whole texts. A document with several labels counts as toxic if any says so;
    null labels and ids are passed over.
    """
    sample = sample or SAMPLE
    known = (
        labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
        .filter(~training_fold(F.col("doc_id"), 4, 2))
    )
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    chosen = None
    for label, most in sample.items():
        part = known.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(chosen, "doc_id").dropDuplicates(["doc_id"])
    got = sorted((r["doc_id"], r["text"] or "", r["toxic"]) for r in rows.collect())
    return fit([(t, y) for _, t, y in got], {0: totals.get(0, 0), 1: totals.get(1, 0)}, seed)


def scorer(model: Model):
    """A function from texts to probabilities that keeps the scores of words it has seen, at most ``CACHE`` of them."""
    cache: dict[bytes, float] = {}

    def score(batch: list[str]) -> list[float]:
        split = [words(t) for t in batch]
        new = list({w for tokens in split for w in tokens if w not in cache})
        if len(cache) + len(new) > CACHE:
            cache.clear()
            new = list({w for tokens in split for w in tokens})
        cache.update(zip(new, model.word_scores(new).tolist() if new else []))
        return [model.probability(model.odds(np.array([cache[w] for w in tokens]))) for tokens in split]

    return score


def score(docs: DataFrame, model: Model, cutoff: float = CUTOFF) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, from its whole text alone.

    Null and empty texts get the score of a text whose words say nothing. Repeated
    rows and rows without an id are scored like others; extra columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = scorer(model)
        for batch in batches:
            yield from emit({"doc_id": batch.column("doc_id"), "score": rate(texts(batch))}, schema)

    rated = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, score double")
    return rated.select(
        "doc_id", training_fold(F.col("doc_id"), 4, 2).alias("held_out"), "score",
        (F.col("score") >= cutoff).cast("int").alias("predicted"),
    )


def clean(docs: DataFrame, model: Model, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``docs`` that score below ``cutoff``, all columns as they are."""

    @F.pandas_udf("double")
    def rated(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rate = scorer(model)
        for column in batches:
            yield pd.Series(rate([t or "" for t in column]))

    return docs.filter(rated(F.coalesce("text", F.lit(""))) < cutoff)
