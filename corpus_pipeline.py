"""A training corpus from ``documents``: drop toxic texts, keep one of each near-duplicate group, mask personal data, mix sources, encode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marketloom.llm import mixing, pieces, pii, simhash, toxicity
from marketloom.llm.common import limit_batches, stored, table
from marketloom.session import prepare


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, does not reject.

    Null texts are empty ones; repeated rows go or stay together; other columns pass as they are. Empty: empty.
    """
    ready(spark)
    return toxicity.clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints of three-word shingles link at three or fewer differing bits.

    The smallest doc_id of a group stays, once; a row without an id only where no other has one. Null texts are
    empty ones, which are one group. All columns pass as they are. Empty: empty.
    """
    ready(spark)
    return simhash.one_of_each(docs, distance=3, width=3)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts with personal data masked and characters counted anew.

    Null texts are empty ones; repeated rows, null ids and other columns stay. Empty: empty.
    """
    ready(spark)
    return pii.mask(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; some not at all, some twice.

    Null sources are a source of their own; empty texts have no words to take. Rows pass as they are. Empty: empty.
    """
    ready(spark)
    return mixing.mix_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text: (doc_id, n_pieces, ids, round_trip). Null and empty texts have none; rows stay as many as they are."""
    ready(spark)
    return pieces.encode(docs, pieces.read_model(spark))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("mix", mix_sources),
    ("encode", encode_pieces),
]

#: Trained models, fingerprints and transducers are no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def ready(spark: SparkSession) -> None:
    prepare(spark)
    limit_batches(spark)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each is written before the next reads it, so a lost executor costs one stage at most."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


PIPELINE_QUERIES = {"pipeline": run}
PIPELINE_SQL = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
