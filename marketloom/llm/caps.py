"""Embedding near duplicates by spherical-cap filters: random product codes, list decoding, verified cosine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import emit, stored
from marketloom.llm.components import components

#: A filter is one codeword of each of two blocks, in one of several codes, each after a rotation of its own:
#: ``CODES * WORDS ** 2`` filters. Several codes even out how many filters a vector gets.
CODES = 16
BLOCKS = 2
WORDS = 128
#: Share of the pairs exactly at the threshold that are to meet in a filter; closer pairs meet more often.
RECALL = 0.985
TRIALS = 400
#: Filters with more members are cut into tiles of about this many.
TILE = 2048
#: Runs up to this many members are compared shift by shift, all at once; longer ones by matrix products.
SHORT = 48


class Codes:
    """Random product codes for vectors of one width, and the cap height at which pairs at ``cosine`` meet with ``recall``."""

    def __init__(self, width: int, cosine: float, recall: float, seed: int = 11) -> None:
        rng = np.random.default_rng([seed, width])
        self.padded = -(-max(width, BLOCKS) // BLOCKS) * BLOCKS
        part = self.padded // BLOCKS
        # few dimensions hold few directions: more codewords would be the same ones again
        self.words = min(WORDS, 4**part)
        turn = [np.linalg.qr(rng.normal(size=(self.padded, self.padded)))[0] for _ in range(CODES)]
        code = rng.normal(size=(CODES, BLOCKS, self.words, part))
        code /= np.linalg.norm(code, axis=3, keepdims=True) * np.sqrt(BLOCKS)
        # rotation and codewords in one matrix: (code, block, codeword) by input component
        turned = [turn[c][:, b * part : (b + 1) * part] @ code[c, b].T for c in range(CODES) for b in range(BLOCKS)]
        self.matrix = np.concatenate(turned, axis=1)[:width]
        x = _unit(rng.normal(size=(TRIALS, width)))
        z = rng.normal(size=(TRIALS, width))
        z = _unit(z - (z * x).sum(axis=1, keepdims=True) * x)
        y = cosine * x + np.sqrt(1 - cosine**2) * (z if width > 1 else 0 * z)
        meet = [
            max(np.minimum(a[c, 0][:, None] + a[c, 1], b[c, 0][:, None] + b[c, 1]).max() for c in range(CODES))
            for a, b in zip(self.halves(x), self.halves(y))
        ]
        self.height = float(np.quantile(meet, 1 - recall))

    def halves(self, unit: np.ndarray) -> np.ndarray:
        """Inner products with all codewords of each block: (vector, code, block, codeword)."""
        return (unit @ self.matrix).reshape(len(unit), CODES, BLOCKS, self.words)

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """Sorted numbers of all filters whose cap holds each vector; halves that cannot reach the height are not paired."""
        out = []
        for at in range(0, len(unit), 128):
            scores = self.halves(unit[at : at + 128])
            numbers, owners = [], []
            for c in range(CODES):
                left, right = scores[:, c, 0], scores[:, c, 1]
                row, first = np.nonzero(left >= (self.height - right.max(axis=1))[:, None])
                pair, second = np.nonzero(right[row] >= (self.height - left[row, first])[:, None])
                numbers.append((c * self.words + first[pair]) * self.words + second)
                owners.append(row[pair])
            number, owner = np.concatenate(numbers), np.concatenate(owners)
            order = np.lexsort((number, owner))
            out += np.split(number[order], np.searchsorted(owner[order], np.arange(1, len(scores))))
        return out


def _unit(vectors: np.ndarray) -> np.ndarray:
    largest = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = vectors / np.where(largest > 0, largest, 1)
    norm = np.linalg.norm(scaled, axis=1, keepdims=True)
    return scaled / np.where(norm > 0, norm, 1)


def _padded(vectors: pa.Array) -> np.ndarray:
    """Unit vectors in double precision; shorter ones end in zeros, which changes no product with their like."""
    width = vectors.value_lengths().to_numpy()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(width), width.max()))
    out[np.arange(out.shape[1]) < width[:, None]] = flat
    return _unit(out)


def usable(vector: Column) -> Column:
    """True for vectors without null or non-finite components that are not zero."""
    return F.coalesce(
        F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0),
        F.lit(False),
    )


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole runs of equal ``key``; the last run of a batch waits for the next one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key")
        if held and held[-1].column("key")[-1] != key[0]:
            yield pa.Table.from_batches(held)
            held = []
        change = np.flatnonzero(pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False)) + 1
        if len(change):
            cut = int(change[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
            batch = batch.slice(cut)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _close_pairs(unit: np.ndarray, runs: np.ndarray, lists: np.ndarray, number: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j, of each run whose cosine reaches the threshold and that share no smaller filter, in pieces."""
    bounds = np.concatenate([runs, [len(unit)]])
    size = np.diff(bounds)
    run_of = np.repeat(np.arange(len(runs)), size)
    at = np.flatnonzero(size[run_of] <= SHORT)
    for shift in range(1, SHORT):
        at = at[at + shift < len(unit)]
        at = at[run_of[at] == run_of[at + shift]]
        if not len(at):
            break
        for part in range(0, len(at), 50_000):
            i = at[part : part + 50_000]
            i = i[np.einsum("nk,nk->n", unit[i], unit[i + shift]) >= cosine]
            i = i[_least_common(lists, i, i + shift) == number[i]]
            yield i, i + shift
    for r in np.flatnonzero(size > SHORT):
        low, high = bounds[r], bounds[r + 1]
        mine = lists[low:high]
        row, place = np.nonzero((mine >= 0) & (mine < number[low]))
        kinds, column = np.unique(mine[row, place], return_inverse=True)
        has = np.zeros((high - low, len(kinds)), np.float32)
        has[row, column] = 1
        for start in range(low, high, 512):
            stop = min(start + 512, high)
            near = unit[start:stop] @ unit[start:high].T >= cosine
            near &= has[start - low : stop - low] @ has[start - low :].T == 0
            i, j = np.nonzero(near)
            keep = j > i
            yield i[keep] + start, j[keep] + start


def _least_common(lists: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest number that rows i and j of the padded lists share."""
    out = np.empty(len(i), np.int64)
    step = max(1, 4_000_000 // max(1, lists.shape[1] ** 2))
    for at in range(0, len(i), step):
        a, b = lists[i[at : at + step]], lists[j[at : at + step]]
        shared = ((a[:, :, None] == b[:, None, :]) & (a >= 0)[:, :, None]).any(axis=2)
        out[at : at + step] = np.where(shared, a, np.iinfo(np.int64).max).min(axis=1)
    return out


def _verify(cosine: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_runs(batches):
            table = table.combine_chunks()
            key = table.column("key").combine_chunks()
            change = pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False)
            runs = np.concatenate([[0], np.flatnonzero(change) + 1])
            if len(runs) == len(key):
                continue
            # only members of runs of at least two
            size = np.diff(np.append(runs, len(key)))
            take = np.flatnonzero(np.repeat(size, size) > 1)
            table = table.take(pa.array(take))
            runs = np.concatenate([[0], np.cumsum(size[size > 1])[:-1]])
            node, weight, tile, number = (table.column(c).to_numpy() for c in ("node", "copies", "tile", "filter"))
            apart = table.column("apart").to_numpy()
            unit = _padded(table.column("vector").combine_chunks())
            listed = table.column("filters").combine_chunks()
            counts = listed.value_lengths().to_numpy()
            lists = np.full((len(node), counts.max()), -1, np.int64)
            lists[np.repeat(np.arange(len(node)), counts), np.concatenate([np.arange(c) for c in counts])] = listed.flatten().to_numpy()
            links = np.zeros(len(node), np.int64)
            parent = np.arange(len(node))
            edges: list[tuple[int, int]] = []

            def root(x: int) -> int:
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            for i, j in _close_pairs(unit, runs, lists, number, cosine):
                # tiles that meet for each other leave pairs of one tile to that tile's own task
                fresh = ~apart[i] | (tile[i] != tile[j])
                i, j = i[fresh], j[fresh]
                np.add.at(links, i, weight[j])
                np.add.at(links, j, weight[i])
                for x, y in zip(i.tolist(), j.tolist()):
                    p, q = root(x), root(y)
                    if p != q:
                        parent[max(p, q)] = min(p, q)
                        edges.append((x, y))
            some = np.flatnonzero(links)
            ends = np.array(edges, np.int64).reshape(-1, 2)
            for at in range(0, len(some), 50_000):
                part = some[at : at + 50_000]
                yield from emit({"a": node[part], "b": [None] * len(part), "links": links[part]}, schema)
            for at in range(0, len(ends), 50_000):
                part = ends[at : at + 50_000]
                yield from emit({"a": node[part[:, 0]], "b": node[part[:, 1]], "links": [None] * len(part)}, schema)

    return run


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, recall: float = RECALL, tile: int = TILE) -> DataFrame:
    """One row per vector: (vec_id, n_links, component_id, kept), from columns vec_id, embedding, label.

    Vectors of equal label and width link at a cosine of ``cosine`` or more, computed in
    double precision. Exact copies are one node with a weight, so they make no pairs. Each node is
    list-decoded to all filters whose cap holds it; nodes meet per filter, are
    verified there, and a pair counts in the first filter both share. A crowded
    filter is cut into tiles that meet two by two; a task passes on link counts and
    a spanning forest, never all pairs.

    The height of the caps is set so that a pair exactly at the threshold meets with
    a chance of about ``recall`` (set by simulation for the width at hand); no pair below it links.

    Null label, null or zero vectors, null or non-finite components: no links; the
    row's component is its own vec_id. A null vec_id can link but names no component
    that has another id, and is not kept. Repeated rows link to each other. Extra columns
    are ignored. Empty: empty.
    """
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    fit = usable(F.col("embedding")) & F.col("label").isNotNull()
    rows = rows.withColumn("fit", fit)
    classes = stored(
        rows.filter("fit").groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
        .withColumn("node", F.monotonically_increasing_id()),
        "caps-classes",
    )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, Codes] = {}  # by width, made once in a task
        for batch in batches:
            listed = batch.column("embedding")
            width = listed.value_lengths().to_numpy()
            filters: list = [None] * batch.num_rows
            for w in np.unique(width):
                of = np.flatnonzero(width == w)
                some = np.array(listed.take(pa.array(of)).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(of), w)
                if int(w) not in codes:
                    codes[int(w)] = Codes(int(w), cosine, recall)
                for i, found in zip(of, codes[int(w)].decode(_unit(some))):
                    filters[i] = found
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array([f.astype(np.int32) for f in filters], pa.list_(pa.int32()))],
                schema=pa.schema([("node", pa.int64()), ("filters", pa.list_(pa.int32()))]),
            )

    found = classes.select("node", "embedding").mapInArrow(decode, "node bigint, filters array<int>")
    listed = stored(
        classes.join(found, "node").select(
            "node", "copies", F.col("embedding").alias("vector"), "filters",
            F.concat_ws(":", F.size("embedding"), "label").alias("group"),
        ),
        "caps-filters",
    )
    short = listed.select("group", F.explode("filters").alias("filter"))
    crowded = short.groupBy("group", "filter").agg(F.count("*").alias("n")).filter(F.col("n") > tile).select(
        "group", "filter", F.ceil(F.col("n") / tile).cast("int").alias("tiles")
    )
    members = (
        listed.withColumn("filter", F.explode("filters")).join(crowded, ["group", "filter"], "left")
        .withColumn("tiles", F.coalesce("tiles", F.lit(1)))
        .withColumn("tile", F.pmod(F.xxhash64("node"), "tiles").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    )
    low, high = F.least("tile", "other"), F.greatest("tile", "other")
    met = members.select(
        F.concat_ws(":", F.col("filter"), low, high, F.col("group")).alias("key"),
        "node", "copies", "tile", "filter", (low != high).alias("apart"), "vector", "filters",
    )
    checked = stored(
        met.repartition("key").sortWithinPartitions("key").mapInArrow(_verify(cosine), "a bigint, b bigint, links bigint"), "caps-links"
    )
    counts = checked.filter("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    joined = components(checked.filter("b IS NOT NULL").select("a", "b"))
    named = classes.select("node", "first", "copies").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = named.groupBy("component").agg(F.min("first").alias("component_id"))
    answers = (
        named.join(names, "component").join(counts, "node", "left")
        .select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("bigint").alias("n_links"))
    )
    by_vector = stored(
        classes.join(answers, "node").select(F.struct("label", "embedding").alias("k"), "n_links", "component_id"), "caps-answers"
    )
    linked = rows.filter("fit").withColumn("k", F.struct("label", "embedding")).join(by_vector, "k").select("vec_id", "n_links", "component_id")
    alone = rows.filter("NOT fit").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
