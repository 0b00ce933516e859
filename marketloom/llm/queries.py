"""The operators of this subpackage over the tables, one query each, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import bm25, bytepair, caps, licences, lm, mixing, pieces, pii, repair, runs, secrets, simhash, toxicity
from marketloom.llm.common import limit_batches, stored, table
from marketloom.session import prepare

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            prepare(spark)
            limit_batches(spark)
            return fn(spark, folder)

        LLM_QUERIES[key] = run
        if sql is not None:
            LLM_SQL[key] = sql
        return fn

    return register


@query("op7_mix_sources", mixing.MIX_SQL)
def op7_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Words the mix takes of each document; see ``mixing.mix``."""
    docs = table(spark, folder, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    sized = stored(docs, "mix-sizes")
    mixed = mixing.mix(sized, sized)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op1_simhash_near_duplicates")
def op1_simhash_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate classes of all documents; see ``simhash.near_duplicates``."""
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query("op10_secret_scan")
def op10_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every whole text; see ``secrets.scan``."""
    found = secrets.scan(table(spark, folder, "documents"))
    return secrets.digest(found, tuple(r.kind for r in secrets.BASE))


@query("op3_personal_data")
def op3_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every whole text; see ``pii.scan``."""
    return pii.digest(pii.scan(table(spark, folder, "documents")))


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every whole text; see ``toxicity.score``."""
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, folder, "labels")))


@query("op4_lattice_scores")
def op4_lattice_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Log probabilities of all whole texts; see ``lm.score``."""
    return lm.score(table(spark, folder, "documents"), pieces.read_model(spark))


@query("op8_piece_codec")
def op8_piece_codec(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of all whole texts, decoded and compared; see ``pieces.encode``."""
    return pieces.encode(table(spark, folder, "documents"), pieces.read_model(spark))


@query("op5_embedding_near_duplicates")
def op5_embedding_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of all vectors; see ``caps.near_duplicates``."""
    return caps.near_duplicates(table(spark, folder, "embeddings"))


@query("op2_licence_scan", licences.LICENCE_SQL)
def op2_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licences named or quoted in every whole text; see ``licences.scan``."""
    return licences.scan(table(spark, folder, "documents"))


@query("op9_top_k_search", bm25.SQL)
def op9_top_k_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents for every document whose id is divisible by 50, its whole text the query; see ``bm25.top_k``."""
    docs = table(spark, folder, "documents")
    queries = docs.filter(F.col("doc_id") % 50 == 0).select(F.col("doc_id").alias("query_id"), "text")
    return bm25.top_k(docs, queries)


@query("op11_byte_pair_codec")
def op11_byte_pair_codec(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of all whole texts and the bytes they stand for, as digests; see ``bytepair.encode`` and ``bytepair.decode``."""
    ranks = bytepair.read_ranks(spark)
    coded = bytepair.decode(bytepair.encode(table(spark, folder, "documents"), ranks), ranks)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Periodic runs of words of all whole texts, one in ten with a passage repeated, as digests; see ``runs.scan``."""
    return runs.digest(runs.scan(table(spark, folder, "documents"), runs.repeat_words))


@query("op13_repair_conversations")
def op13_repair_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """Faults of all damaged conversations and their cheapest repair, as digests; see ``repair.repair``."""
    turns = table(spark, folder, "conversations")
    return repair.digest(*repair.repair(repair.damage(turns), turns))
