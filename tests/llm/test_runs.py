"""Periodic runs against a search by every period, and the query against the same by hand."""

import hashlib
import random
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from marketloom.llm import runs
from marketloom.llm.queries import LLM_QUERIES

FOLDER = "/root/testdata/sf0.001"


def plain(words, least=6, periods=4):
    """Every period, every maximal stretch; those of a smaller period are passed over."""
    n, out = len(words), []
    for q in range(1, n):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            smaller = any(all(words[k] == words[k + p] for k in range(i, i + length - p)) for p in range(1, q))
            if length >= max(least, periods * q) and not smaller:
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


pieces = st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=1, max_size=7)
documents = st.lists(st.tuples(pieces, st.integers(0, 12)).map(lambda t: t[0] * t[1]), max_size=5).map(lambda parts: sum(parts, []))


@settings(max_examples=400, deadline=None)
@given(st.lists(documents, max_size=4), st.sampled_from([(6, 4), (4, 2), (1, 3), (9, 5)]))
def test_runs_are_those_of_every_period(rows, bounds):
    assert runs.find(rows, *bounds) == [plain(r, *bounds) for r in rows]


def test_copies_of_a_text_do_not_meet():
    row = [b"a", b"b", b"c", b"d", b"e", b"f", b"g"]
    assert runs.find([row, row, row]) == [[], [], []]


def test_long_runs_and_many_runs():
    assert runs.find([[b"a"] * 60_000]) == [[(0, 60_000, 1)]]
    assert runs.find([[b"x"] + [b"a", b"b", b"c"] * 20_000]) == [[(1, 60_000, 3)]]
    many = sum([[b"%d" % i] + [b"a", b"b"] * 5 for i in range(4000)], [])
    assert runs.find([many]) == [[(11 * i + 1, 10, 2) for i in range(4000)]]


def test_text_without_the_repetitions():
    words = b"say la la la la la la now".split()
    assert runs.collapsed(words, runs.find([words])[0]) == b"say la now"
    assert runs.collapsed([], []) == b""


def edited(doc_id, words):
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    words = edited(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    found = plain(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    return (
        doc_id, len(found), *best, None if best[0] is None else 1000 * best[1] // best[2],
        hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(),
        hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()).hexdigest(),
    )


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_query_is_the_plain_search(spark, tmp_path):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    # the plain search takes the square of a text; whole short texts are enough beside the property test
    short = [r for r in rows if len((r.text or "").split()) < 400]
    assert len(short) > 100
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in LLM_QUERIES["op12_periodic_runs"](spark, FOLDER).collect()}
    assert len(got) == len(rows)
    assert [got[r.doc_id] for r in short] == [expected(r.doc_id, r.text) for r in short]
    assert any(v[1] for v in got.values())


def test_odd_rows(spark):
    rows = [(None, None, 1), (5, "", 2), (5, "", 2), (6, "z " * 30 + "\x1c \x85", 3), (None, "q " * 9, 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs int")
    found = runs.digest(runs.scan(docs, runs.repeat_words))
    got = sorted([tuple(r[c] for c in COLUMNS) for r in found.collect()], key=str)
    assert got == sorted([expected(r[0], r[1]) for r in rows], key=str)
    assert runs.scan(docs.limit(0)).count() == 0


def test_small_corpora_change_nothing(spark, monkeypatch):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    want = {r.doc_id: (r.runs, r.collapsed) for r in runs.scan(docs, runs.repeat_words).collect()}
    monkeypatch.setattr(runs, "CHARS", 2000)
    monkeypatch.setattr(runs, "ROWS", 1)
    assert {r.doc_id: (r.runs, r.collapsed) for r in runs.scan(docs, runs.repeat_words).collect()} == want


def test_edit_is_that_of_the_contract():
    chosen = random.Random(2)
    for doc_id in range(400):
        words = [b"%d" % i for i in range(chosen.randint(0, 40))]
        assert runs.repeat_words(doc_id, words) == edited(doc_id, words)
