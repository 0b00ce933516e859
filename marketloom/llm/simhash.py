"""SimHash near duplicates: fingerprints, pigeonhole blocks, verified Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from marketloom.llm.common import emit, stored, texts, words
from marketloom.llm.components import components

BITS = 64
#: Hashes that are counted at once; bounds the memory that a very long text takes.
CHUNK = 1 << 16
#: A bucket with more members is cut into tiles of about this many, so that no task holds a whole hot bucket.
TILE = 4096


def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    """SimHash of a text's word shingles: a bit is set if it is set in over half of their XXH64.

    Shingles are ``width`` words (A-Z lower-cased) joined by a space, repeats
    included; fewer words make one shingle; no words give zero.
    """
    tokens = words(text)
    if not tokens:
        return 0
    if len(tokens) < width:
        return xxh64_intdigest(b" ".join(tokens), seed)
    shingles = map(b" ".join, zip(*[tokens[i:] for i in range(width)]))
    counts, seen = np.zeros(BITS, np.int64), 0
    while True:
        chunk = np.fromiter((xxh64_intdigest(s, seed) for s, _ in zip(shingles, range(CHUNK))), "<u8")
        if not len(chunk):
            break
        counts += np.unpackbits(chunk.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        seen += len(chunk)
    bits = (2 * counts > seen).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, simhash bigint) of every row; the bits of an unsigned number in a signed one. Null text counts as empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("simhash", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t, width, seed) for t in texts(batch)], np.uint64).view(np.int64)
            yield from emit({"doc_id": batch.column("doc_id"), "simhash": made}, schema)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, simhash bigint")


def block_masks(distance: int, blocks: int) -> list[int]:
    """One mask for each choice of ``blocks - distance`` blocks.

    Fingerprints that differ in at most ``distance`` bits differ in at most as many
    blocks, so they agree in all bits of at least one mask.
    """
    if not distance < blocks <= BITS:
        raise ValueError(f"{distance} differing bits need more than {distance} blocks and at most {BITS}")
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    block = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [sum(chosen) for chosen in combinations(block, blocks - distance)]


def signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def spanning(keys: np.ndarray, prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect, in every run of equal ``keys``, what pairs within ``distance`` connect.

    All pairs of a run are compared, a shift at a time in numpy, and only a spanning forest
    of the links found is returned: no more links than members.
    """
    prints = prints.view(np.uint64)  # of a signed number, bits of its absolute value would be counted
    parent = np.arange(len(keys))
    kept: list[tuple[np.ndarray, np.ndarray]] = []

    def roots(x: np.ndarray) -> np.ndarray:
        while True:
            up = parent[x]
            if (up == x).all():
                return x
            parent[x] = parent[up]
            x = up

    at = np.arange(len(keys))
    for shift in range(1, len(keys)):
        at = at[at + shift < len(keys)]
        at = at[keys[at] == keys[at + shift]]
        if not len(at):
            break
        left = at[np.bitwise_count(prints[at] ^ prints[at + shift]) <= distance]
        right = left + shift
        while len(left):
            a, b = roots(left), roots(right)
            apart = a != b
            left, right, a, b = left[apart], right[apart], a[apart], b[apart]
            if not len(left):
                break
            low, high = np.minimum(a, b), np.maximum(a, b)
            _, first = np.unique(high, return_index=True)  # one link per root at a time
            parent[high[first]] = low[first]
            kept.append((left[first], right[first]))
    if not kept:
        return at[:0], at[:0]
    return np.concatenate([k[0] for k in kept]), np.concatenate([k[1] for k in kept])


def _links_of_sorted(distance: int):
    """Links of a partition sorted by bucket; a bucket's rows may spread over several batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def found(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            rows = np.concatenate(parts, axis=1)
            # buckets are told apart by a change in any key column
            new = (rows[:-1, 1:] != rows[:-1, :-1]).any(axis=0)
            run_of = np.concatenate([[0], np.cumsum(new)])
            left, right = spanning(run_of, rows[-1], distance)
            if len(left):
                yield from emit({"a": rows[-1][left], "b": rows[-1][right]}, schema)

        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)])
            ends = np.flatnonzero((rows[:-1, 1:] != rows[:-1, :-1]).any(axis=0)) + 1
            if held and (rows[:-1, 0] != held[-1][:-1, -1]).any():
                yield from found(held)
                held = []
            cut = ends[-1] if len(ends) else 0
            if cut:
                yield from found([*held, rows[:, :cut]])
                held = []
            held.append(rows[:, cut:])
        if held:
            yield from found(held)

    return run


def links(prints: DataFrame, distance: int = 3, blocks: int = 6, tile: int = TILE) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all pairs at ``distance`` or fewer differing bits.

    ``prints`` holds distinct non-null values in ``simhash``. Each goes to one bucket per mask
    of ``block_masks``; pairs of a bucket are verified. A bucket larger than ``tile`` is
    cut into tiles, and every two tiles of it meet in a task of their own, so no
    task holds more than two tiles of a bucket and no pair is lost.
    """
    masks = [signed(m) for m in block_masks(distance, blocks)]
    buckets = F.array(*[F.struct(F.lit(i).alias("mask"), F.col("simhash").bitwiseAND(F.lit(m)).alias("bucket")) for i, m in enumerate(masks)])
    keyed = prints.select("simhash", F.inline(buckets))
    large = (
        keyed.groupBy("mask", "bucket").agg(F.count("*").alias("n")).filter(F.col("n") > tile)
        .select("mask", "bucket", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    )
    tiled = keyed.join(large, ["mask", "bucket"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    mine = F.pmod(F.xxhash64("simhash"), "tiles").cast("int")
    met = F.transform(
        F.sequence(F.lit(0), F.col("tiles") - 1),
        lambda other: F.struct(F.least(mine, other).alias("low"), F.greatest(mine, other).alias("high")),
    )
    rows = tiled.select(
        F.col("mask").cast("bigint"), "bucket", F.inline(met), "simhash"
    ).select("mask", "bucket", F.col("low").cast("bigint"), F.col("high").cast("bigint"), "simhash")
    key = ["mask", "bucket", "low", "high"]
    return (
        rows.repartition(*key).sortWithinPartitions(*key)
        .mapInArrow(_links_of_sorted(distance), "a bigint, b bigint")
    )


def near_duplicates(docs: DataFrame, distance: int = 3, blocks: int = 6, width: int = 3, seed: int = 42) -> DataFrame:
    """One row per document: (doc_id, fingerprint, component_id, kept).

    Fingerprints link at ``distance`` or fewer differing bits; the component is the
    smallest doc_id reachable, and ``kept`` marks the document that stands for it.
    Documents of equal fingerprint are one node, so copies cost one row each and
    make no pairs. Candidates come from fingerprints that agree in ``blocks -
    distance`` of ``blocks`` blocks; more blocks make longer keys and fewer false
    candidates, but more rows per fingerprint.

    Null and empty texts have fingerprint 0 and link like any other. A null doc_id is
    never an id of a component, unless no document of it has one. Repeated rows
    stay, each with the same answer. Extra columns are ignored. Empty: empty.
    """
    prints = stored(fingerprints(docs, width, seed), "simhash")
    nodes = stored(prints.groupBy("simhash").agg(F.min("doc_id").alias("doc_id")), "simhash-nodes")
    joined = components(links(nodes.select("simhash"), distance, blocks))
    # components are in terms of fingerprints; the smallest doc_id of each follows
    of_node = nodes.join(joined, nodes["simhash"] == joined["node"], "left").select(
        "simhash", "doc_id", F.coalesce("component", "simhash").alias("component")
    )
    named = of_node.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    classes = stored(of_node.join(named, "component").select(F.struct("simhash").alias("k"), "component_id"), "simhash-classes")
    return (
        prints.withColumn("k", F.struct("simhash")).join(classes, "k")
        .select(
            "doc_id",
            F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"),
            "component_id",
            F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"),
        )
    )


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stand for their near-duplicate group, all columns as they are, whatever their names.

    Of each group the row with the smallest doc_id stays; a row without an id stays only
    where no other has one; of repeated rows one stays. Null and empty texts are one group. Empty: empty.
    Rows are numbered once and stored with their numbers, so a repeated task reads the same ones.
    """
    numbered = stored(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("number")), "simhash-rows")
    classes = near_duplicates(numbered.select(F.col("number").alias("doc_id"), "row.text"), **options)
    groups = classes.select(F.col("doc_id").alias("number"), F.col("component_id").alias("group"))
    ids = numbered.select("number", F.col("row.doc_id").alias("id"))
    first = F.min_by("number", F.struct(F.col("id").isNull(), "id", "number")).alias("number")
    chosen = stored(ids.join(groups, "number").groupBy("group").agg(first).select("number"), "simhash-kept")
    # the same join at every size: rows and numbers are both dealt by number
    return numbered.join(chosen.hint("merge"), "number", "left_semi").select("row.*")
