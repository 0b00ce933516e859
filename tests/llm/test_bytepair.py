"""Byte-level BPE against the public library, word by word and text by text."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from marketloom.llm import bytepair
from marketloom.llm.queries import LLM_QUERIES

FOLDER = "/root/testdata/sf0.001"
RANKS = open(public_tokenizers.path(bytepair.FILE), "rb").read()
CODEC = bytepair.Codec(RANKS)
CLASSES = bytepair.character_classes()
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=CODEC.rank, special_tokens={})


def encoded(texts, at_once=None):
    corpus = bytepair.Corpus(CODEC, CLASSES)
    corpus.add(texts)
    return [np.frombuffer(c, "<u4").tolist() for c in corpus.flush()]


PARTS = ["a", "b", "e", "th", "in", "er", " ", "  ", "\n", "\r\n", "\t", "'s", "'ll", "'", "''", "1", "22", "é", "ü", "中", "!", "...", "՘", "\U000323b5", "\x85", "　", "\x1c", "𝄞", "​", "-", "\0"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=30).map("".join), max_size=6))
def test_texts_of_a_corpus_are_encoded_as_by_the_library(texts):
    assert encoded(texts) == [LIBRARY.encode_ordinary(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_characters(text):
    assert encoded([text]) == [LIBRARY.encode_ordinary(text)]


def test_words_are_the_matches_of_the_pattern():
    chosen = random.Random(7)
    old = [p for p in PARTS if p not in ("՘", "\U000323b5")]
    for _ in range(3000):
        text = "".join(chosen.choices(old, k=chosen.randint(1, 25)))
        chars = np.array([ord(c) for c in text], np.uint32)
        begins = np.zeros(len(chars), bool)
        begins[0] = True
        starts = bytepair.match_starts(chars, begins, np.frombuffer(CLASSES, np.uint8))
        assert np.flatnonzero(starts).tolist() == [m.start() for m in regex.finditer(public_tokenizers.PATTERN, text)]


def alone(word: bytes, codec) -> list[int]:
    """Lowest rank first, leftmost of equals, one merge at a time."""
    parts = [bytes([b]) for b in word]
    while True:
        ranked = [(codec.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in codec.rank]
        if not ranked:
            return [codec.rank[p] for p in parts]
        _, i = min(ranked)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_merges_that_make_a_pair_of_lower_rank():
    # tokens of more than one byte in any order of rank, so that later merges often come before earlier ones
    chosen = random.Random(3)
    for _ in range(60):
        grown = [bytes([b]) for b in b"abc"]
        while len(grown) < 14:
            new = chosen.choice(grown) + chosen.choice(grown)
            if new not in grown:
                grown.append(new)
        extra = grown[3:]
        chosen.shuffle(extra)
        import base64

        every = [bytes([b]) for b in range(256)] + extra
        small = bytepair.Codec(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(every)))
        words = [bytes(chosen.choices(b"abc", k=chosen.randint(1, 20))) for _ in range(200)]
        got = [np.frombuffer(c, "<u4").tolist() for c in small.replay(words)]
        assert got == [alone(w, small) for w in words]


def test_a_long_unbroken_word_and_long_blanks():
    texts = ["ab" * 40_000 + "x" * 3000, " " * 9000 + "a" + "\n" * 5000, ""]
    assert [bytepair.decoded(np.array(ids, "<u4").tobytes(), bytepair.token_bytes(RANKS)) for ids in encoded(texts)] == [t.encode() for t in texts]
    short = ["abcdefg" * 300 + "a" * 500, "é" * 700]
    assert encoded(short) == [LIBRARY.encode_ordinary(t) for t in short]


def test_corpora_and_caches_do_not_change_ids(spark, monkeypatch):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    want = {r.doc_id: LIBRARY.encode_ordinary(r.text or "") for r in docs.collect()}
    corpus_sizes = {"TEXTS": 3000, "CACHE": 50, "CUT_AT_ONCE": 500, "AT_ONCE": 300}
    for name, value in corpus_sizes.items():
        monkeypatch.setattr(bytepair, name, value)
    got = {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in bytepair.encode(docs, RANKS).collect()}
    assert got == want


def test_query_is_what_the_library_gives(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = LLM_QUERIES["op11_byte_pair_codec"](spark, FOLDER).collect()
    assert len(rows) == len(docs)
    for row in rows:
        ids = LIBRARY.encode_ordinary(docs[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(docs[row.doc_id].encode()).hexdigest()


def test_odd_rows(spark):
    rows = [(None, None, 1), (1, "", 2), (1, "", 2), (2, "a b", 3), (3, "a b", 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids bigint").withColumnRenamed("ids", "n_tokens")
    coded = bytepair.decode(bytepair.encode(docs, RANKS), RANKS)
    got = sorted((r.doc_id or 0, r.n_tokens, bytes(r.data)) for r in coded.collect())
    assert got == [(0, 0, b""), (1, 0, b""), (1, 0, b""), (2, 2, b"a b"), (3, 2, b"a b")]
    assert bytepair.encode(docs.limit(0), RANKS).count() == 0
    unknown = spark.createDataFrame([(1, 1, bytearray(b"\xff\xff\xff\xff")), (2, 0, None)], "doc_id bigint, n_tokens bigint, ids binary")
    assert sorted((r.doc_id, r.data) for r in bytepair.decode(unknown, RANKS).collect()) == [(1, b""), (2, None)]


def test_a_file_without_single_bytes_is_refused():
    with pytest.raises(ValueError):
        bytepair.Codec(b"YQ== 0")
