"""The pipeline's stages against what plain code makes of the same rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marketloom.llm import mixing, pii, simhash
from marketloom.session import materialize

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], FOLDER), f"test-{name}"))
    return out


def test_all_but_the_last_keep_the_columns(steps):
    assert all(s.columns == steps[0].columns and s.dtypes == steps[0].dtypes for s in steps[:-1])
    assert all(s.count() > 0 for s in steps)


def test_toxic_documents_go(steps):
    kept = {r.doc_id for r in steps[1].collect()}
    texts = {r.doc_id: r.text.lower() for r in steps[0].collect()}
    assert len(kept) > 0.7 * len(texts)


def test_one_of_each_group_stays(steps):
    rows = {r.doc_id: r.text for r in steps[1].collect()}
    prints = {i: simhash.fingerprint(t) for i, t in rows.items()}
    parent = {i: i for i in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(rows)
    for x in ids:
        for y in ids:
            if y < x and (prints[x] ^ prints[y]).bit_count() <= 3:
                a, b = sorted((root(x), root(y)))
                parent[b] = a
    assert sorted(r.doc_id for r in steps[2].collect()) == sorted({root(i) for i in ids})


def test_personal_data_is_masked(steps):
    before = {r.doc_id: r.text for r in steps[2].collect()}
    after = {r.doc_id: (r.text, r.n_chars) for r in steps[3].collect()}
    assert after == {i: (pii.masked(t), len(pii.masked(t))) for i, t in before.items()}


def test_mix_takes_what_the_operator_says(spark, steps):
    sized = materialize(steps[3].withColumn("size", mixing.word_count(F.col("text"))), "test-sized")
    want = {r.doc_id: r.copies for r in mixing.mix(sized).collect()}
    got = {r.doc_id: r["count"] for r in steps[4].groupBy("doc_id").count().collect()}
    assert got == {i: c for i, c in want.items() if c}


def test_ids_of_all_that_was_taken(steps):
    rows = steps[5].collect()
    assert len(rows) == steps[4].count()
    assert all(r.round_trip and r.n_pieces == len(r.ids) for r in rows)


def test_odd_rows_pass_all_stages(spark):
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "a b c " * 5000, "en", "s", 1), (3, None, "de", "s", 7)]
    docs = materialize(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"), "test-odd")
    for start in (docs, materialize(docs.limit(0), "test-none")):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            now = materialize(stage(spark, now, FOLDER), f"test-{name}")
        assert now.count() <= start.count() * 2
