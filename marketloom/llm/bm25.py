"""Exact top-k search: BM25 over an inverted index in shards, pruned by block maxima, merged with global statistics."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.common import stored, texts, words
from marketloom.session import materialize

K1, B = 1.2, 0.75
#: Documents of a shard and their words, at most (a longer text is a shard of its own); documents of a block.
SHARD_DOCS = 12288
SHARD_WORDS = 6_000_000
BLOCK = 16
#: Queries, and different words of all of them, that are sent to the shards at once.
QUERIES_AT_ONCE = 16384
WORDS_AT_ONCE = 4_000_000
#: Words of queries that the driver takes from the executors at once.
WORDS_BY_DRIVER = 1_000_000
#: Queries that a task scores together, and postings that it takes together, if a query has not more.
TOGETHER = 256
POSTINGS = 1 << 15
#: A shard's documents are cut into groups of this many at most, by their most frequent terms; no group is cut into less than a part.
GROUP_DOCS = 2048
GROUP_PART = 16
GROUP_TERMS = 256
#: Postings of a shard that are looked at together when it is made ready.
PIECE = 1 << 17
#: A term in more than one of so many documents of a group has its impacts there in a matrix, the others in postings.
COMMON = 24
#: Cells of a shard's matrices, at most.
CELLS = 1 << 23
#: One shard of so many is searched first, for the scores that the others' documents have to reach.
FIRST = 16
#: Scores are compared and returned to this many decimals, so that equal documents tie.
DECIMALS = 6
#: What a product in single precision may lose of a sum of positive numbers, for each number.
UNIT = 2.0**-23

INDEX = "shard bigint, docs bigint, words bigint, vocabulary binary, postings binary"
_INDEX = pa.schema([("shard", pa.int64()), ("docs", pa.int64()), ("words", pa.int64()), ("vocabulary", pa.binary()), ("postings", pa.binary())])


def _pack(**parts: pa.Array) -> bytes:
    """Arrays of any lengths and types as one value, which readers take as it is: no element is looked at on the way."""
    one = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in parts.values()], names=list(parts))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, one.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_batch(one)
    return sink.getvalue().to_pybytes()


def _unpack(value: bytes | pa.Buffer) -> dict[str, pa.Array]:
    one = pa.ipc.open_stream(value, options=pa.ipc.IpcReadOptions(use_threads=False)).read_next_batch()
    return {name: one.column(name)[0].values for name in one.schema.names}


def _least(values: np.ndarray) -> np.ndarray:
    """The same whole numbers in the narrowest type."""
    return values.astype(np.min_scalar_type(int(values.max()))) if len(values) else values


def split(text: pa.Array) -> pa.ListArray:
    """The words of texts, as ``words`` has them; null is the empty text."""
    text = pc.ascii_trim_whitespace(pc.ascii_lower(text.cast(pa.large_string()).fill_null("")))
    found = pc.ascii_split_whitespace(text)
    # the empty text is split into one empty word
    sizes = np.where(pc.binary_length(text).to_numpy() > 0, pc.list_value_length(found).to_numpy(), 0)
    one = found.flatten().cast(pa.large_binary())
    return pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]), one.filter(pc.greater(pc.binary_length(one), 0)))


def invert(ids: pa.Array, found: pa.Array, sizes: np.ndarray, shard: int) -> pa.RecordBatch:
    """One shard of documents with their words: documents by group, then length, so that they are alike; postings by term, then place."""
    coded = found.dictionary_encode()
    docs, terms = len(ids), len(coded.dictionary)
    key = np.repeat(np.arange(docs, dtype=np.int64) * terms, sizes) + coded.indices.to_numpy()
    key.sort()
    first = np.flatnonzero(np.diff(key, prepend=-1))
    times = np.diff(first, append=len(key))
    doc, term = np.divmod(key[first], max(1, terms))
    group = alike(doc, term, docs, terms)
    order = np.lexsort((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), sizes, group))
    place = np.empty(docs, np.int64)
    place[order] = np.arange(docs)
    key = term * docs + place[doc]
    by_term = np.argsort(key)
    vocabulary = _pack(terms=coded.dictionary.cast(pa.binary()), held=pa.array(np.bincount(term, minlength=terms), pa.int32()))
    postings = _pack(
        doc_ids=ids.take(pa.array(order)), lengths=pa.array(sizes[order], pa.int64()), groups=pa.array(np.bincount(group)),
        places=pa.array(_least((key % max(1, docs))[by_term])), times=pa.array(_least(times[by_term])),
    )
    one = [shard, docs, int(sizes.sum()), vocabulary, postings]
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(one, _INDEX)], schema=_INDEX)


def alike(doc: np.ndarray, term: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """A group for each document: the largest group is cut again and again where its documents differ most, along the first principal
    direction of the terms that most documents hold. Groups are for speed alone; any would do."""
    group, held = np.zeros(docs, np.int64), np.bincount(term, minlength=terms)
    often = np.argsort(-held, kind="stable")[:GROUP_TERMS]
    column = np.full(terms, -1, np.int32)
    column[often] = np.arange(len(often))
    kept = column[term] >= 0
    held_by = np.zeros((docs, len(often)), np.float32)
    held_by[doc[kept], column[term[kept]]] = 1
    held_by *= np.log1p(docs / np.maximum(held[often], 1)).astype(np.float32)
    norm = np.sqrt((held_by * held_by).sum(axis=1, keepdims=True))
    held_by /= np.where(norm > 0, norm, 1)
    open_, number = [np.arange(docs)], 1
    while open_:
        mine = open_.pop()
        if len(mine) <= GROUP_DOCS:
            continue
        rows = held_by[mine] - held_by[mine].mean(axis=0)
        way = rows[np.argmax((rows * rows).sum(axis=1))]
        for _ in range(12):
            way = rows.T @ (rows @ way)
            way /= max(float(np.sqrt(way @ way)), 1e-30)
        above = rows @ way > 0
        if min(above.sum(), len(mine) - above.sum()) * GROUP_PART < GROUP_DOCS:
            # nothing to tell them apart by: as they come
            above = np.arange(len(mine)) < len(mine) // 2
        group[mine[above]] = number
        number += 1
        open_ += [mine[~above], mine[above]]
    return group


def build_index(docs: DataFrame, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """The inverted index of all rows of ``docs``, stored, a row and a file per shard, so that a reader holds one. Rows stay in the task that reads them: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard = TaskContext.get().partitionId(), 0
        held: list[tuple[pa.Array, pa.LargeListArray]] = []
        docs = size = 0

        def closed() -> pa.RecordBatch:
            ids, found = pa.concat_arrays([i for i, _ in held]), pa.concat_arrays([w for _, w in held])
            held.clear()
            return invert(ids, found.flatten(), pc.list_value_length(found).to_numpy(), (part << 32) + shard)

        for batch in batches:
            ids, found = batch.column("doc_id"), split(batch.column("text"))
            low = 0
            for at, n in enumerate(pc.list_value_length(found).to_pylist()):
                if docs and (docs >= shard_docs or size + n > SHARD_WORDS):
                    held.append((ids.slice(low, at - low), found.slice(low, at - low)))
                    yield closed()
                    low, docs, size, shard = at, 0, 0, shard + 1
                docs, size = docs + 1, size + n
            held.append((ids.slice(low), found.slice(low)))
        if docs:
            yield closed()

    index = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, INDEX)
    # values are compressed already
    return materialize(index, "bm25-index", maxRecordsPerFile=1, compression="uncompressed")


def weighted_queries(queries: DataFrame, index: DataFrame, documents: int) -> DataFrame:
    """(query_id, terms, weights): the distinct words of each query with their inverse document frequencies over all shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("query_id", pa.int64()), ("term", pa.binary())])
        for batch in batches:
            found = [(i, t) for i, text in zip(batch.column("query_id").to_pylist(), texts(batch)) for t in set(words(text))]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([t for _, t in found], pa.binary())], schema=schema)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                own = _unpack(batch.column("vocabulary")[row].as_buffer())
                for at in range(0, len(own["terms"]), 1 << 16):
                    part = [own["terms"].slice(at, 1 << 16), own["held"].slice(at, 1 << 16).cast(pa.int64())]
                    yield pa.RecordBatch.from_arrays(part, names=["term", "n"])

    asked = queries.select(F.col("query_id").cast("bigint").alias("query_id"), "text").mapInArrow(run, "query_id bigint, term binary").distinct()
    per_shard = index.select("vocabulary").mapInArrow(counts, "term binary, n bigint")
    frequency = per_shard.groupBy("term").agg(F.sum("n").alias("df"))
    idf = F.log(1 + (documents - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return (
        asked.join(frequency, "term").withColumn("weight", idf).groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("q"))
        .select("query_id", F.col("q.term").alias("terms"), F.col("q.weight").alias("weights"))
    )


class Shard:
    """A shard ready to be searched for the ``terms`` of some queries.

    A posting's value is what its document gains by it: impact times weight. In each group of documents, terms that many of them hold have
    their values in a matrix, document by term, with the largest of each beside it; the others have them in postings. Both are in single
    precision and only tell which documents may be among the best; those are scored in double precision.
    """

    def __init__(self, row: dict[str, pa.Scalar], mean_length: float, terms: pa.Array, weights: np.ndarray) -> None:
        vocabulary, own = _unpack(row["vocabulary"].as_buffer()), _unpack(row["postings"].as_buffer())
        self.doc_ids = own["doc_ids"]
        lengths, held, groups, places, times = (x.to_numpy() for x in (own["lengths"], vocabulary["held"], own["groups"], own["places"], own["times"]))
        self.docs, self.ends = len(lengths), np.cumsum(groups)
        # of the shard's terms, those that are asked for are numbered anew
        at = pc.index_in(terms, value_set=vocabulary["terms"]).fill_null(-1).to_numpy()
        # what the look needed goes back before more is made
        pa.default_memory_pool().release_unused()
        weight = np.zeros(len(held))
        weight[at[at >= 0]] = weights[at >= 0]
        asked = np.zeros(len(held), bool)
        asked[at[at >= 0]] = True
        count_ = int(asked.sum())
        #: number here of each of ``terms``, or -1
        self.number = np.where(at >= 0, (np.cumsum(asked) - 1)[at], -1).astype(np.int32)
        kept, held = np.repeat(asked, held), held[asked]
        place, times, term = places[kept], times[kept], np.repeat(np.arange(count_, dtype=np.int32), held)
        self.base = K1 * (1 - B + B * lengths / mean_length) if mean_length else np.full(self.docs, K1)
        self.weight = (K1 + 1) * weight[asked]
        value = np.empty(len(place), np.float32)
        # here and below in pieces, as arrays of a number for each posting are large
        pieces = [slice(at, at + PIECE) for at in range(0, len(place), PIECE)]
        for p in pieces:
            value[p] = times[p] * self.weight[term[p]] / (times[p] + self.base[place[p]])
        # a document's postings together, for its score in full
        order = np.argsort(place, kind="stable")
        self.own_terms, self.own_times = term[order], times[order]
        del order, kept, places, times, own, vocabulary
        self.own_starts = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=self.docs))])
        room = CELLS // self.docs
        self.column = np.full((len(groups), count_), -1, np.int32)
        wide = np.zeros(len(groups), np.int64)
        for g, docs in enumerate(groups.tolist()):
            own = slice(self.own_starts[self.ends[g] - docs], self.own_starts[self.ends[g]])
            in_group = np.bincount(self.own_terms[own], minlength=count_)
            often = np.flatnonzero(in_group * COMMON > docs)
            often = often if len(often) <= room else often[np.argsort(-in_group[often], kind="stable")[:room]]
            self.column[g, often], wide[g] = np.arange(len(often)), len(often)
        self.in_matrix = (self.column >= 0).any(axis=0)
        first = np.concatenate([[0], np.cumsum(groups * wide)])
        cells, dense = np.zeros(first[-1], np.float32), np.zeros(len(place), bool)
        # where the row of a document begins
        group = np.repeat(np.arange(len(groups)), groups)
        begin = first[group] + (np.arange(self.docs) - (self.ends - groups)[group]) * wide[group]
        for p in pieces:
            column = self.column.ravel()[group[place[p]] * count_ + term[p]]
            dense[p] = here = column >= 0
            cells[begin[place[p][here]] + column[here]] = value[p][here]
        self.matrices = [cells[first[g] : first[g + 1]].reshape(docs, -1 if wide[g] else 0) for g, docs in enumerate(groups.tolist())]
        self.tops = [m.max(axis=0, initial=0) for m in self.matrices]
        # place and value of a posting beside each other, the value in steps and rounded up; a term's postings are one value, to be taken at once
        self.kind = np.dtype(np.uint16 if self.docs <= 1 << 16 else np.uint32)
        most = np.iinfo(self.kind).max
        self.held = held - np.bincount(term[dense], minlength=count_)
        place, value = place[~dense], value[~dense]
        del term, dense
        self.step = float(value.max(initial=0)) / most or 1.0
        posts = np.empty((len(place), 2), self.kind)
        posts[:, 0] = place
        for p in pieces:
            posts[p, 1] = np.clip(np.ceil(value[p].astype(np.float64) / self.step), 1, most)
        ends = np.concatenate([[0], np.cumsum(self.held)]) * (2 * self.kind.itemsize)
        self.posts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), count_, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(posts)])
        # values are rounded once, and sums of so many numbers at most
        self.loss = UNIT * (16 + max([0, *wide.tolist()]))

    def rare(self, starts: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of all documents by the terms in postings, queries by documents, and by how much each query's may be too high.

        The terms of query i are ``numbers`` from ``starts[i]`` to ``starts[i + 1]``.
        """
        kept = self.held[numbers] > 0
        mine, starts = numbers[kept], np.concatenate([[0], np.cumsum(kept)])[starts]
        ends = np.concatenate([[0], np.cumsum(self.held[mine])])[starts]
        score = np.zeros((len(starts) - 1, self.docs), np.float32)
        at = 0
        while at < len(score):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + POSTINGS, "right")) - 1)
            if ends[to] > ends[at]:
                taken = self.posts.take(pa.array(mine[starts[at] : starts[to]]))
                posts = np.frombuffer(taken.buffers()[2], self.kind, 2 * (ends[to] - ends[at])).reshape(-1, 2)
                for q in range(at, to):
                    own = posts[ends[q] - ends[at] : ends[q + 1] - ends[at]]
                    np.multiply(np.bincount(own[:, 0], own[:, 1], self.docs), self.step, out=score[q], casting="same_kind")
            at = to
        return score, np.diff(starts) * self.step

    def search(self, starts: np.ndarray, numbers: np.ndarray, k: int, bars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place, score) of the documents that may be among the best ``k`` of each query, given that ``k`` others reach its bar.

        Terms are given as in ``rare``. A group of documents is scored for the queries whose bound for it,
        what its best document has by the terms in postings and the largest values of the others, reaches their bar. Bars rise: in a
        group, the k-th of the largest scores of its blocks is reached by k documents.
        """
        queries = len(starts) - 1
        # half a unit of the last decimal: what rounds to a tie must be scored
        slack, bars = 10.0**-DECIMALS, bars.copy()
        score, high = self.rare(starts, numbers)
        of = np.repeat(np.arange(queries, dtype=np.int32), np.diff(starts))
        often = self.in_matrix[numbers]
        of, often = of[often], numbers[often]
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
        for g, matrix in enumerate(self.matrices):
            end = int(self.ends[g])
            rare, column = score[:, end - len(matrix) : end], self.column[g, often]
            here = column >= 0
            wanted = np.zeros((queries, matrix.shape[1]), np.float32)
            wanted[of[here], column[here]] = 1
            bound = rare.max(axis=1) + wanted @ self.tops[g]
            now = np.flatnonzero((bound > 0) & (bound * (1 + 2 * self.loss) + slack >= bars))
            if not len(now):
                continue
            whole = wanted[now] @ matrix.T
            whole += rare[now]
            blocks = -(-len(matrix) // BLOCK)
            some = whole.max(axis=1) >= self._least(bars[now])
            now, whole = now[some], whole[some]
            hits = np.flatnonzero(whole >= self._least(bars[now])[:, None])
            if len(hits) > 2 * k * len(now) and blocks >= k:
                best = np.maximum.reduceat(whole, np.arange(0, len(matrix), BLOCK), axis=1)
                bars[now] = np.maximum(bars[now], np.partition(best, blocks - k, axis=1)[:, -k] * (1 - self.loss) - high[now])
                hits = np.flatnonzero(whole >= self._least(bars[now])[:, None])
            q, at = np.divmod(hits, len(matrix))
            found.append((now[q], at + (end - len(matrix)), whole[q, at]))
        q, place, value = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((-value, q))
        q, place, value = q[order], place[order], value[order]
        kth = np.flatnonzero(np.arange(len(q)) - np.searchsorted(q, q) == k - 1)
        bars[q[kth]] = np.maximum(bars[q[kth]], value[kth] * (1 - self.loss) - high[q[kth]])
        keep = value >= self._least(bars[q])
        q, place = q[keep], place[keep]
        value = self.whole(q, place, starts, numbers)
        keep = (value > 0) & (value + slack >= bars[q])
        return q[keep], place[keep], value[keep]

    def _least(self, bars: np.ndarray) -> np.ndarray:
        """What a score in single precision is at least, if the document reaches its bar; over 0."""
        return np.maximum((bars - 10.0**-DECIMALS) * (1 - self.loss), np.finfo(np.float32).tiny).astype(np.float32)

    def whole(self, query: np.ndarray, place: np.ndarray, starts: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Scores of documents in double precision; ``query`` is in order."""
        out, weight = np.zeros(len(query)), np.zeros(len(self.held))
        cut = np.flatnonzero(np.diff(query, prepend=-1))
        for low, high in zip(cut.tolist(), [*cut[1:].tolist(), len(query)]):
            mine = numbers[starts[query[low]] : starts[query[low] + 1]]
            weight[mine] = self.weight[mine]
            for at in range(low, high):
                own = slice(self.own_starts[place[at]], self.own_starts[place[at] + 1])
                gain = weight[self.own_terms[own]]
                some = np.flatnonzero(gain)
                times = self.own_times[own][some]
                out[at] = (times * gain[some] / (times + self.base[place[at]])).sum()
            weight[mine] = 0
        return out


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10, shard_docs: int = SHARD_DOCS, at_once: int = QUERIES_AT_ONCE) -> DataFrame:
    """(query_id, rank, doc_id, score): the ``k`` best documents of each query by BM25, exactly.

    Words as everywhere here (runs of anything but ASCII white space, A-Z lower-cased); a
    query's repeated words count once. Document frequencies and the mean length are
    those of all documents. Each shard is searched with block-max pruning and each task's answers are
    merged; no document that could be among the best is left out. Scores are rounded to six
    decimals; ties go to the smaller doc_id. Only documents that share a word with the query are ranked.

    The queries go to the shards in blocks of about ``at_once`` or ``WORDS_AT_ONCE`` words, whichever is less, so what a task holds does not grow
    with their number. Each block is asked of one shard in ``FIRST`` first; documents of the others have to reach the k-th score found there.
    Null and empty texts match nothing; a null doc_id is ranked last among
    ties; repeated rows are ranked each; rows without a query_id are no queries. Extra columns are ignored.
    """
    spark = docs.sparkSession
    index = build_index(docs, shard_docs)
    total = index.agg(F.sum("docs").alias("n"), F.sum("words").alias("w")).first()
    documents = total["n"] or 0
    mean = (total["w"] or 0) / documents if documents else 0.0
    weighted = stored(weighted_queries(queries.filter(F.col("query_id").isNotNull()), index, documents), "bm25-queries")
    asked = weighted.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("terms")).alias("w")).first()
    parts = max(1, math.ceil(asked["n"] / at_once), math.ceil((asked["w"] or 0) / WORDS_AT_ONCE))
    pieces = max(1, math.ceil((asked["w"] or 0) / parts / WORDS_BY_DRIVER))
    files = sorted(map(unquote, index.inputFiles()))
    answers = None
    for part in range(parts):
        number = F.pmod(F.xxhash64("query_id"), parts * pieces)
        block = _packed(weighted.filter(number == part * pieces + piece).select("query_id", "terms", "weights").toArrow() for piece in range(pieces))
        shared, bars = spark.sparkContext.broadcast(block), None
        for some in (files[::FIRST], [f for n, f in enumerate(files) if n % FIRST]):
            if some:
                shards = spark.read.schema(index.schema).parquet(*some)
                found = stored(shards.mapInArrow(_searcher(shared, k, mean, bars), "query_id bigint, doc_id bigint, score double"), "bm25-found")
                answers = found if answers is None else answers.unionByName(found)
                bars = _bars(found, block, k) if bars is None and len(files) > len(some) else bars
        shared.unpersist()
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = answers.withColumn("rank", F.row_number().over(best)) if answers is not None else None
    if ranked is None:
        return spark.createDataFrame([], "query_id bigint, rank int, doc_id bigint, score double")
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def _bars(found: DataFrame, block: bytes, k: int) -> np.ndarray:
    """The k-th score of each query of the block among the answers so far, 0 if there are fewer."""
    kth = found.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), False).alias("s")).filter(F.size("s") >= k)
    rows = kth.select("query_id", F.element_at("s", k).alias("bar")).toArrow()
    asked = _unpack(block)["query"].to_numpy()
    order = np.argsort(asked, kind="stable")
    bars = np.zeros(len(asked))
    bars[order[np.searchsorted(asked[order], rows.column("query_id").to_numpy())]] = rows.column("bar").to_numpy()
    return bars


def _packed(tables: Iterable[pa.Table]) -> bytes:
    """A block of queries, which come in parts: each query's id and number of words, the number of each word, and the words' weights."""
    asked, sizes, coded, weights = [], [], [pa.array([], pa.binary()).dictionary_encode()], [np.zeros(0)]
    for table in tables:
        # those of few words first
        table = table.take(pc.sort_indices(pc.list_value_length(table.column("terms")))).combine_chunks()
        asked.append(table.column("query_id").to_numpy())
        sizes.append(pc.list_value_length(table.column("terms")).to_numpy())
        own = pa.concat_arrays([coded[0].dictionary, *[c.flatten() for c in table.column("terms").chunks]]).dictionary_encode()
        weight = np.zeros(len(own.dictionary))
        weight[own.indices.to_numpy()] = np.concatenate([c.flatten().to_numpy() for c in table.column("weights").chunks] or weights[:1])
        coded.append(own)
        weights.append(weight)
    number = pa.chunked_array(coded).unify_dictionaries()
    terms = number.chunk(0).dictionary
    weight = np.zeros(len(terms))
    for all_, own, w in zip(number.chunks[1:], coded[1:], weights[1:]):
        weight[all_.indices.to_numpy()] = w[own.indices.to_numpy()]
    return _pack(
        query=pa.array(np.concatenate(asked)), sizes=pa.array(np.concatenate(sizes), pa.int64()),
        number=pa.array(np.concatenate([c.indices.to_numpy() for c in number.chunks]), pa.int32()), terms=terms, weights=pa.array(weight),
    )


def _searcher(shared, k: int, mean: float, least: np.ndarray | None = None):
    """Searches the shards of a task for a block of queries; ``least`` has a score for each that ``k`` documents elsewhere reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _unpack(shared.value)
        asked, sizes, number, weights = (block[c].to_numpy() for c in ("query", "sizes", "number", "weights"))
        starts = np.concatenate([[0], np.cumsum(sizes)])
        # the best of all shards that this task has searched; the bar rises with them
        bars = np.zeros(len(asked)) if least is None else least.copy()
        query, ids, score = np.zeros(0, np.int64), pa.array([], pa.int64()), np.zeros(0)
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard({c: batch.column(c)[row] for c in ("vocabulary", "postings")}, mean, block["terms"], weights)
                hits = [(query[:0], query[:0], score[:0])]
                for low in range(0, len(asked), TOGETHER):
                    high = min(len(asked), low + TOGETHER)
                    mine = shard.number[number[starts[low] : starts[high]]]
                    here = mine >= 0
                    own = np.concatenate([[0], np.cumsum(here)])[starts[low : high + 1] - starts[low]]
                    q, place, value = shard.search(own, mine[here], k, bars[low:high])
                    hits.append((q + low, place, value))
                q, place, value = (np.concatenate(c) for c in zip(*hits))
                query, score = np.append(query, q), np.append(score, value)
                ids = pa.concat_arrays([ids, shard.doc_ids.take(pa.array(place, pa.int64()))])
                # by query, then rounded score, then id, nulls last
                names = ids.fill_null(0).to_numpy()
                order = np.lexsort((names, ids.is_null().to_numpy(zero_copy_only=False), -np.round(score, DECIMALS), query))
                rank = np.arange(len(order)) - np.searchsorted(query[order], query[order])
                order, rank = order[rank < k], rank[rank < k]
                query, score, ids = query[order], score[order], ids.take(pa.array(order))
                full = query[rank == k - 1]
                # the k-th score, or what rounds to it
                lowest = np.full(len(asked), np.inf)
                np.minimum.at(lowest, query, score)
                bars[full] = np.maximum(bars[full], lowest[full])
                # one shard at a time
                del shard
        yield pa.RecordBatch.from_arrays(
            [pa.array(asked[query], pa.int64()), ids, pa.array(np.round(score, DECIMALS))], names=["query_id", "doc_id", "score"]
        )

    return run


#: The same search in SQL: documents whose id is divisible by 50 as queries.
SQL = r"""
WITH tok AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT d.doc_id, coalesce(sum(tf), 0) AS dl FROM documents d LEFT JOIN tf USING (doc_id) GROUP BY ALL),
stats AS (SELECT count(*) AS n, sum(dl) / count(*) AS mean FROM dl),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT doc_id AS query_id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM tf JOIN df USING (term), stats WHERE doc_id % 50 = 0),
scored AS (
  SELECT query_id, doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score
  FROM q JOIN tf USING (term) JOIN dl USING (doc_id), stats GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
