"""Language-model scores: the marginal likelihood of a text over all segmentations of its words into pieces."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import emit, stored, texts, training_fold, words
from marketloom.llm.lattice import Trie, arcs, marginal, read_pieces
from marketloom.llm.pieces import BLANK, BYTE, NORMAL

#: Every task holds the words that are at least one in so many of all tokens. There cannot be more than this
#: many (in natural text far fewer), and no word that is left to shuffle is hot.
HEAD = 1 << 19
#: Word counts that a task gathers before it passes them on, and words whose lattices are summed at once.
GATHER = 300_000
AT_ONCE = 20_000
#: Shares of the vocabulary's probability for bytes and for the end of a text.
BYTE_SHARE, END_SHARE = 0.01, 0.001


class Vocabulary:
    """An existing vocabulary as unigram weights.

    The file's scores order its pieces (minus the rank); a piece weighs one over its
    rank. Pieces whose score rules them out stay out. A character without a piece is
    spelt in bytes, which share ``BYTE_SHARE`` evenly.
    """

    def __init__(self, model: bytes) -> None:
        pieces, _, _ = read_pieces(model)
        usable = [(t, s) for t, s, kind in pieces if kind == NORMAL and s > -1e8]
        self.trie = Trie({t: i for i, (t, _) in enumerate(usable)})
        weight = 1.0 / (2.0 - np.array([s for _, s in usable] or [0.0]))
        self.log = np.log(weight / weight.sum() * (1 - BYTE_SHARE - END_SHARE))
        self.byte = np.log(BYTE_SHARE / max(1, sum(kind == BYTE for _, _, kind in pieces)))

    def marginals(self, vocabulary: list[str]) -> np.ndarray:
        """Natural log of each word's probability, summed over all its segmentations, the blank before it included."""
        lattice = arcs(self.trie, [BLANK + w for w in vocabulary])
        weight = self.log[lattice.piece]
        bare = np.flatnonzero(lattice.piece < 0)
        code = lattice.chars[lattice.start[bare]]
        size = 1 + (code >= 0x80).astype(int) + (code >= 0x800) + (code >= 0x10000)
        weight[bare] = size * self.byte
        return marginal(lattice, weight)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, learned, total): how often each word is in the training rows and in all rows."""
    schema = pa.schema([("word", pa.binary()), ("learned", pa.int64()), ("total", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> Iterator[pa.RecordBatch]:
            learned, held = seen
            both = list(learned.keys() | held.keys())
            for at in range(0, len(both), 50_000):
                part = both[at : at + 50_000]
                yield from emit({"word": part, "learned": [learned[w] for w in part], "total": [learned[w] + held[w] for w in part]}, schema)
            learned.clear()
            held.clear()

        for batch in batches:
            for text, out in zip(texts(batch), batch.column("held_out").to_pylist()):
                seen[out].update(words(text))
                if len(seen[0]) + len(seen[1]) > GATHER:
                    yield from flush()
        yield from flush()

    rows = docs.select("text", "held_out").mapInArrow(run, "word binary, learned bigint, total bigint")
    return rows.groupBy("word").agg(F.sum("learned").alias("learned"), F.sum("total").alias("total"))


def with_marginals(counts: DataFrame, model: bytes) -> DataFrame:
    """``counts`` with ``pieces``: log10 of the word's marginal probability under the vocabulary."""
    shared = counts.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("word", pa.binary()), ("learned", pa.int64()), ("total", pa.int64()), ("pieces", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(shared.value)
        for batch in batches:
            some = [w.decode("utf-8", "surrogatepass") for w in batch.column("word").to_pylist()]
            made = [vocabulary.marginals(some[at : at + AT_ONCE]) for at in range(0, len(some), AT_ONCE)]
            value = np.concatenate(made) / np.log(10) if made else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], pa.array(value)], schema=schema)

    return counts.select("word", "learned", "total").mapInArrow(run, "word binary, learned bigint, total bigint, pieces double")


def score(docs: DataFrame, model: bytes, parts: int = 5, held: int = 1, head: int = HEAD) -> DataFrame:
    """One row per document: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, piece_score).

    The model is learned from rows whose crc32(doc_id as text) leaves other than ``held`` by ``parts``. A text is
    its words (A-Z lower-cased) and one end. ``piece_score`` is log10 of its probability summed
    over all segmentations into the existing vocabulary's pieces; no piece reaches from one word into the
    next, so the sum is the product of the words' sums, each by forward recursion in log space. ``score`` has in
    every lattice one arc more, from the word's start to its end, which the training rows
    weigh: with N tokens and V distinct ones learned, a word seen c times has c/(N+V) there and the pieces share V/(N+V).
    ``base_score`` is the sum of log10((c+0.5)/(N+0.5*(V+1))).

    Word sums are computed once per distinct word. Words that are at least one in ``head`` of all tokens, of which there are no more than ``head``, are
    looked up where the texts are read; the others are joined by a shuffle, in which no word can be hot.
    Null and empty texts: the end alone. Null doc_id: crc32 of the empty text. Repeated rows are each
    scored and counted. Extra columns are ignored. Empty input: empty output.
    """
    spark = docs.sparkSession
    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", training_fold(F.col("doc_id"), parts, held).alias("held_out"))
    types = stored(with_marginals(word_counts(read), model), "lm-words")
    sums = types.agg(F.sum("learned").alias("n"), F.sum("total").alias("all"), F.count_if(F.col("learned") > 0).alias("v")).first()
    ends = read.filter(~F.col("held_out")).count()
    tokens, kinds = (sums["n"] or 0) + ends, sums["v"] + (ends > 0)
    base_all = log10(tokens + 0.5 * (kinds + 1))
    new = kinds / (tokens + kinds) if tokens else 1.0

    known, base, mixed = _columns(tokens, kinds)
    frequent = types.filter(F.col("total") * head >= (sums["all"] or 0))
    rated = frequent.select("word", known.cast("int").alias("k"), base.alias("b"), mixed.alias("s"), "pieces")
    table = spark.sparkContext.broadcast({bytes(r["word"]): (r["k"], r["b"], r["s"], r["pieces"]) for r in rated.collect()})

    end_base = log10(ends + 0.5)
    end_mixed = log10(ends / (tokens + kinds) + new * END_SHARE if tokens else END_SHARE)
    end_sums = (int(ends > 0), end_base, end_mixed, log10(END_SHARE))
    tail = pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int64())]))
    schema = pa.schema([
        ("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n", pa.int64()), ("k", pa.int64()),
        ("b", pa.float64()), ("s", pa.float64()), ("p", pa.float64()), ("tail", tail),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = table.value.get
        for batch in batches:
            out: dict[str, list] = {name: [] for name in ("n", "k", "b", "s", "p", "tail")}
            for text in texts(batch):
                tokens_of = Counter(words(text))
                n, (k, b, s, p), rest = 1, end_sums, []
                for word, times in tokens_of.items():
                    n += times
                    found = look(word)
                    if found is None:
                        rest.append({"word": word, "times": times})
                    else:
                        k += times * found[0]
                        b += times * found[1]
                        s += times * found[2]
                        p += times * found[3]
                for name, value in zip(out, (n, k, b, s, p, rest)):
                    out[name].append(value)
            yield from emit(out | {c: batch.column(c) for c in ("row", "doc_id", "held_out")}, schema)

    numbered = read.withColumn("row", F.monotonically_increasing_id())
    rows = stored(
        numbered.mapInArrow(
            run,
            "row bigint, doc_id bigint, held_out boolean, n bigint, k bigint, b double, s double, p double,"
            " tail array<struct<word:binary,times:bigint>>",
        ),
        "lm-rows",
    )
    rare = rows.select("row", F.inline("tail"))
    values = types.select("word", known.cast("int").alias("k1"), base.alias("b1"), mixed.alias("s1"), F.col("pieces").alias("p1"))
    more = (
        rare.join(values, "word").groupBy("row")
        .agg(*[F.sum(F.col("times") * F.col(f"{c}1")).alias(f"{c}1") for c in "kbsp"])
    )

    def total(name: str):
        return F.col(name) + F.coalesce(f"{name}1", F.lit(0))

    return rows.drop("tail").join(more, "row", "left").select(
        "doc_id", "held_out",
        F.col("n").alias("n_tokens"), total("k").cast("bigint").alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        (total("b") - F.col("n") * F.lit(base_all)).alias("base_score"),
        total("s").alias("score"), total("p").alias("piece_score"),
    )


def _columns(tokens: int, kinds: int):
    """Known or not, base and mixed log10 terms of a word row."""
    learned = F.col("learned")
    known = learned > 0
    base = F.log10(learned + F.lit(0.5))
    if not tokens:
        return known, base, F.col("pieces")
    share = F.lit(float(tokens + kinds))
    # 10 ** pieces may be too small for a double; then the pieces' logarithm alone is right
    new = F.lit(log10(kinds / (tokens + kinds)))
    mixed = F.when(known, F.log10(learned / share + F.pow(F.lit(10.0), F.col("pieces") + new))).otherwise(F.col("pieces") + new)
    return known, base, mixed
