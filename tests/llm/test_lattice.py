"""Lattices against all segmentations by brute force, the codec against the public library, scores against plain sums."""

import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from marketloom.llm import lm, pieces
from marketloom.llm.lattice import Trie, arcs, marginal, shortest

PIECES = ["a", "b", "ab", "abc", "c", "bc", "▁", "▁a", "ca", "é", "▁▁"]


def segmentations(word, known):
    if not word:
        yield []
        return
    for n in range(1, len(word) + 1):
        head = word[:n]
        if head in known or (n == 1):
            for rest in segmentations(word[n:], known):
                yield [head, *rest]


def test_marginal_and_shortest_against_all_paths():
    rng = random.Random(1)
    known = {p: i for i, p in enumerate(PIECES)}
    weights = np.array([-rng.random() * 5 for _ in PIECES] + [-7.0])
    words = ["", *["".join(rng.choices("abc▁éx", k=rng.randint(0, 9))) for _ in range(300)], ""]
    lattice = arcs(Trie(known), words)
    sums = marginal(lattice, weights[lattice.piece])
    used, bounds = shortest(lattice, weights[lattice.piece])
    paths = [used[a:b] for a, b in zip(bounds, bounds[1:])]
    assert len(paths) == len(words)
    for word, total, path in zip(words, sums, paths):
        all_paths = [[weights[known.get(p, -1)] for p in way] for way in segmentations(word, known)]
        assert math.isclose(total, math.log(sum(math.exp(sum(w)) for w in all_paths)), abs_tol=1e-9)
        assert math.isclose(sum(weights[lattice.piece[path]]), max(map(sum, all_paths)), abs_tol=1e-9)
        got = [(int(lattice.start[a]), int(lattice.end[a])) for a in path]
        assert [b for _, b in got][:-1] == [a for a, _ in got][1:]


def test_long_word_does_not_underflow():
    known = {p: i for i, p in enumerate(PIECES)}
    weights = np.full(len(PIECES) + 1, -8.0)
    lattice = arcs(Trie(known), ["ab" * 5000])
    assert np.isfinite(marginal(lattice, weights[lattice.piece])).all()


@pytest.fixture(scope="module")
def model():
    with open(f"{pieces.FOLDER}/{pieces.MODEL}", "rb") as file:
        return file.read()


def as_unigram(model):
    """The same file with its type set to unigram: the library then takes the best path by score."""
    at = model.index(struct.pack("BB", 0x18, 2), len(model) - 4000)
    return model[: at + 1] + b"\x01" + model[at + 2 :]


def path_score(codec, ids):
    """Sum of scores; a character in bytes counts once."""
    total = 0.0
    for i in ids:
        raw = codec.raw[i]
        if i in codec.bytes.values():
            total += codec.weight[-1] if raw[0] & 0xC0 != 0x80 else 0.0
        else:
            total += codec.weight[i]
    return total


def best_score(codec, known, text):
    best = [0.0]
    for end in range(1, len(text) + 1):
        ways = [best[s] + known[text[s:end]] for s in range(max(0, end - 16), end) if text[s:end] in known]
        if text[end - 1] not in known:
            ways.append(best[end - 1] + codec.weight[-1])
        best.append(max(ways))
    return best[-1]


TEXTS = [
    "Hello world", "  two  blanks ", "", None, "line\none\ttwo\r\n", "naïve café 日本語 🙂 \x00", "x" * 300, "▁", "a​b", "Ends with blank ",
]


def test_codec_against_the_library(model):
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_proto=as_unigram(model))
    codec = pieces.Codec(model)
    encode = codec.encoder()
    spelt = set(codec.bytes.values())
    known = {raw.decode().replace(" ", pieces.BLANK): codec.weight[i] for i, raw in enumerate(codec.raw) if raw and i not in spelt and i > 2}
    rng = random.Random(3)
    made = ["".join(rng.choices("the or ing é\n#!0123abcABC日", k=rng.randint(1, 60))) for _ in range(400)]
    for text in [t for t in TEXTS if t] + made:
        ids = np.frombuffer(encode([text])[0], "<i4").tolist()
        assert path_score(codec, ids) == best_score(codec, known, codec.normalise(text)), text
        theirs = library.encode(text)  # sums in single precision, so it may miss the best path, but never beats it
        assert path_score(codec, theirs) <= path_score(codec, ids)
        assert codec.decode(ids) == library.decode(ids)


def test_codec_over_tables(spark, model):
    docs = spark.createDataFrame([(i, t, "q") for i, t in enumerate(TEXTS)] + [(None, "x y", "q"), (1, "z", None), (1, "z", None)], "doc_id bigint, text string, ids string")
    coded = pieces.encode(docs, model)
    rows = coded.collect()
    assert len(rows) == len(TEXTS) + 3
    assert all(r.round_trip for r in rows if r.doc_id is None or TEXTS[r.doc_id] != "▁")
    assert all(len(r.ids) == r.n_pieces for r in rows)
    back = {r.doc_id: r.text for r in pieces.decode(coded, model).collect()}
    assert back[0] == "Hello world" and back[5] == TEXTS[5] and back[2] == "" and back[3] == ""
    assert pieces.encode(docs.limit(0), model).count() == 0


def plain_scores(docs, vocabulary):
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in docs}
    split = [(i, (t or "").encode().lower().split()) for i, t in docs]
    counts = Counter(w for i, ws in split if not held[i] for w in ws)
    ends = sum(not held[i] for i, _ in split)
    n, v = sum(counts.values()) + ends, len(counts) + (ends > 0)
    out = []
    for i, ws in split:
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws) + math.log10((ends + 0.5) / (n + 0.5 * (v + 1)))
        sums = dict(zip(set(ws), vocabulary.marginals([w.decode() for w in set(ws)]))) if ws else {}
        score = sum(math.log10(counts[w] / (n + v) + v / (n + v) * math.exp(sums[w])) for w in ws)
        score += math.log10(ends / (n + v) + v / (n + v) * lm.END_SHARE)
        out.append((str(i), held[i], len(ws) + 1, sum(counts[w] > 0 for w in ws) + (ends > 0), n, round(base, 6), round(score, 6)))
    return sorted(out)


@pytest.mark.parametrize("head", [0, 5, 1000])
def test_scores_against_plain_sums(spark, model, head):
    rng = random.Random(5)
    vocabulary = ["the", "Of", "thonnd", "é", "日本", "x1", "ering"] + [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 30)))) for i in range(80)]
    docs += [(None, "the the"), (90, None), (91, "  "), (92, "the " * 20_000), (93, "same"), (93, "same")]
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id bigint, text string, row int, n int")
    rows = lm.score(frame, model, head=head).collect()
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in rows)
    for mine, theirs in zip(got, plain_scores(docs, lm.Vocabulary(model)), strict=True):
        assert mine[:5] == theirs[:5]
        assert mine[5:] == pytest.approx(theirs[5:], rel=1e-9, abs=1e-5)


def test_no_rows(spark, model):
    assert lm.score(spark.createDataFrame([], "doc_id bigint, text string"), model).count() == 0


def test_vocabulary_is_a_distribution(model):
    vocabulary = lm.Vocabulary(model)
    assert math.isclose(np.exp(vocabulary.log).sum() + lm.BYTE_SHARE + lm.END_SHARE, 1.0, rel_tol=1e-9)
