"""Periodic runs of words by maximal pairs in the tree of common prefixes, and texts without the repetitions."""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import texts

#: A run has at least this many words, and at least this many periods.
WORDS = 6
PERIODS = 4
#: Characters of text that are worked on at once, or one longer text.
CHARS = 1 << 22
#: Rows that leave a task at once.
ROWS = 256

Edit = Callable[[object, list[bytes]], list[bytes]]


class Numbers(dict):
    """Numbers keys in the order they come."""

    def __missing__(self, key: bytes) -> int:
        number = self[key] = len(self)
        return number


class Suffixes:
    """Suffixes of several texts that share their first words with another suffix of their text.

    ``place`` holds their places in the order of a trie, and ``common`` how many words
    each shares with the one before it, fewer than ``depth`` where a tree ends. Both come from prefix
    doubling: places are ordered by their first ``depth`` words, and groups of equals
    by the group that follows. Suffixes that are like no other, and do not follow one that is, are left out.
    """

    def __init__(self, word: np.ndarray, text: np.ndarray, end: np.ndarray, depth: int) -> None:
        self.word, self.end, self.depth = word, end, depth
        place = self._repeated(text)
        follow = place[place + depth < end[place]] + depth
        place = np.union1d(place, follow)
        group = text[place].astype(np.int64)
        width = int(word.max(initial=0)) + 2
        for i in range(depth):  # nothing comes before any word
            here = place + i
            inside = here < end[place]
            _, group = np.unique(group * width + np.where(inside, word[np.where(inside, here, 0)] + 1, 0), return_inverse=True)
        self.slot = np.full(len(word) + 1, -1, np.int32)
        self.slot[place] = np.arange(len(place))
        self.levels: list[tuple[int, np.ndarray]] = []
        order = self._sort(place, group)
        self.place = place[order]
        self.common = self._common(place, order)

    def _repeated(self, text: np.ndarray) -> np.ndarray:
        """Places whose first words have the sum of some other place of their text."""
        size = len(self.word)
        places = np.flatnonzero(np.arange(size) + self.depth <= self.end)
        if not len(places):
            return places
        with np.errstate(over="ignore"):
            sums = text[places].astype(np.uint64)
            for i in range(self.depth):
                sums = (sums + self.word[places + i].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                sums ^= sums >> np.uint64(29)
        order = np.argsort(sums, kind="stable")
        same = np.concatenate([[False], sums[order][1:] == sums[order][:-1], [False]])
        return np.sort(places[order[same[1:] | same[:-1]]])

    def _sort(self, place: np.ndarray, group: np.ndarray) -> np.ndarray:
        size, depth = len(place), self.depth
        if not size:
            return np.zeros(0, np.int64)
        order = np.argsort(group, kind="stable")
        rank = np.zeros(size, np.int64)
        begins = np.concatenate([[True], np.diff(group[order]) != 0])
        rank[order] = np.maximum.accumulate(np.where(begins, np.arange(size), 0))
        # where in the order groups of several stand
        active = np.flatnonzero(~(begins & np.append(begins[1:], True)))
        while len(active):
            self.levels.append((depth, rank.astype(np.int32)))
            mine = order[active]
            follow = place[mine] + depth
            slot = np.where(follow < self.end[place[mine]], self.slot[np.minimum(follow, len(self.slot) - 1)], -1)
            after = np.where(slot >= 0, rank[slot], -1)
            sorted_ = np.lexsort((after, rank[mine]))
            mine, after = mine[sorted_], after[sorted_]
            order[active] = mine
            old = rank[mine]
            begins = np.concatenate([[True], (np.diff(old) != 0) | (np.diff(after) != 0)])
            rank = rank.copy()
            rank[mine] = active[np.maximum.accumulate(np.where(begins, np.arange(len(mine)), 0))]
            alone = begins & np.append(begins[1:], True)
            active = active[~alone]
            depth *= 2
        return order

    def _common(self, place: np.ndarray, order: np.ndarray) -> np.ndarray:
        common = np.zeros(len(order), np.int64)
        if not self.levels:
            return common
        first = self.levels[0][1]
        at = np.flatnonzero(first[order[1:]] == first[order[:-1]]) + 1
        a, b = place[order[at - 1]], place[order[at]]
        end_a, end_b = self.end[a], self.end[b]
        shared = np.zeros(len(at), np.int64)
        for depth, rank in reversed(self.levels):
            x, y = a + shared, b + shared
            inside = (x < end_a) & (y < end_b)
            x, y = self.slot[np.where(inside, x, len(self.word))], self.slot[np.where(inside, y, len(self.word))]
            both = inside & (x >= 0) & (y >= 0)
            both[both] = rank[x[both]] == rank[y[both]]
            shared[both] += depth
        open_ = np.ones(len(at), bool)
        for _ in range(self.depth):
            x, y = a + shared, b + shared
            open_ &= (x < end_a) & (y < end_b)
            open_[open_] = self.word[x[open_]] == self.word[y[open_]]
            shared[open_] += 1
        common[at] = shared
        return common


def pairs_of_tree(places: list[int], commons: list[int], lefts: list[int], words: int, periods: int) -> dict[tuple[int, int], int]:
    """Runs as {(start, end): period} from one tree of common prefixes.

    ``places`` are suffixes in the order of the tree, ``commons`` the words each shares with the one
    before, ``lefts`` the word before each place. The intervals of equal prefixes are
    closed bottom-up. Each holds its places in order and their left words; while
    intervals join, a place of the smaller meets the nearest places of the larger. Their common prefix ends
    with the interval's depth, so the two differ to the right; if their left words differ too,
    the pair is maximal. Such a pair at distance d is a run of period d where it shares
    (periods - 1) * d words: a place between the two would make a smaller period, so the nearest suffice, and
    a place farther away is a multiple with the same bounds. Intervals whose places all have one and the same
    left word are joined without a look.
    """
    found: dict[tuple[int, int], int] = {}

    def note(low: int, high: int, depth: int) -> None:
        distance = high - low
        if depth >= (periods - 1) * distance and depth + distance >= words:
            key = (low, high + depth)
            if found.get(key, distance) >= distance:
                found[key] = distance

    def join(one: tuple, two: tuple, depth: int) -> tuple:
        large, small = (one, two) if len(one[0]) >= len(two[0]) else (two, one)
        listed, left_of, only = large
        look = only is None or only != small[2]
        new = small[0]
        if look:
            for place in new:
                mine = small[1][place]
                at = bisect_left(listed, place)
                if at and left_of[listed[at - 1]] != mine:
                    note(listed[at - 1], place, depth)
                if at < len(listed) and left_of[listed[at]] != mine:
                    note(place, listed[at], depth)
            only = None
        left_of.update(small[1])
        if new[0] > listed[-1]:
            listed.extend(new)
        elif len(new) * 8 > len(listed):
            listed.extend(new)
            listed.sort()
        else:
            for place in new:
                listed.insert(bisect_left(listed, place), place)
        return listed, left_of, only

    # open intervals as (depth, what it holds so far); the next suffix joins the deepest
    stack: list[tuple[int, tuple]] = []
    last = ([places[0]], {places[0]: lefts[0]}, lefts[0])
    for place, common, left in zip(places[1:], commons[1:], lefts[1:]):
        while stack and stack[-1][0] > common:
            depth, interval = stack.pop()
            last = join(interval, last, depth)
        if stack and stack[-1][0] == common:
            last = join(stack.pop()[1], last, common)
        stack.append((common, last))
        last = ([place], {place: left}, left)
    while stack:
        depth, interval = stack.pop()
        last = join(interval, last, depth)
    return found


def find(rows: list[list[bytes]], words: int = WORDS, periods: int = PERIODS) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each list of words, by start and then period.

    A run is a stretch with smallest period q that no neighbouring word prolongs, of at least ``words``
    words and ``periods`` (two or more) times q. Two of its suffixes, q apart, share all but q words.
    """
    out: list[list[tuple[int, int, int]]] = [[] for _ in rows]
    lengths = np.array([len(r) for r in rows], np.int64)
    size = int(lengths.sum())
    if not size:
        return out
    number = Numbers()
    word = np.fromiter((number[w] for row in rows for w in row), np.int64, size)
    text = np.repeat(np.arange(len(rows)), lengths)
    ends = np.cumsum(lengths)
    # all periods q of runs share words - q or (periods - 1) q words at least
    depth = min(max(words - q, (periods - 1) * q) for q in range(1, max(words, 2)))
    tree = Suffixes(word, text, ends[text], depth)
    place, common = tree.place, tree.common
    if not len(place):
        return out
    begins = ends - lengths
    left = np.where(place == begins[text[place]], -1, word[place - 1])
    # one tree for each first words; those without near places or with one left word alone hold no maximal pair
    starts = np.flatnonzero(common < depth)
    tree_of = np.cumsum(common < depth) - 1
    reach = np.maximum.reduceat(common, starts) // (periods - 1)
    by_place = np.lexsort((place, tree_of))
    gap = np.diff(place[by_place])
    near = np.zeros(len(starts), bool)
    inner = np.diff(tree_of[by_place]) == 0
    near[tree_of[by_place][1:][inner & (gap <= reach[tree_of[by_place][1:]])]] = True
    mixed = np.minimum.reduceat(left, starts) != np.maximum.reduceat(left, starts)
    stops = np.append(starts[1:], len(place))
    for i in np.flatnonzero(near & mixed).tolist():
        part = slice(starts[i], stops[i])
        # a text's first word has no left word, which is like no other
        found = pairs_of_tree(place[part].tolist(), common[part].tolist(), left[part].tolist(), words, periods)
        of = int(text[place[starts[i]]])
        begin = int(begins[of])
        out[of] += [(low - begin, high - low, period) for (low, high), period in found.items()]
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by blanks, without those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    steps = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()])


def scan(docs: DataFrame, edit: Edit | None = None, words: int = WORDS, periods: int = PERIODS) -> DataFrame:
    """(doc_id, runs, collapsed): runs as (start, length, period) by start and period, and the text without their repetitions.

    Words are runs of anything but ASCII white space, numbered from 0, and compared as they are. ``edit`` may change the
    words of a document before. About four million characters are worked on at once; a longer text by itself, at
    about 200 bytes a word. Work grows with words, not with the square of a run. Null or empty text: no runs, empty text.
    Repeated rows and null doc_ids are kept; extra columns are ignored. Empty: empty.
    """
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(run_type)), ("collapsed", pa.string())])

    def work(ids: list, rows: list[list[bytes]]) -> pa.RecordBatch:
        found = find(rows, words, periods)
        listed = [[dict(zip(("start", "length", "period"), r)) for r in runs] for runs in found]
        kept = [collapsed(row, runs) for row, runs in zip(rows, found)]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(listed, pa.list_(run_type)), pa.array(kept, pa.string())], schema=schema
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                split = text.encode("utf-8", "surrogatepass").split()
                if ids and (size + len(text) > CHARS or len(ids) >= ROWS * 16):
                    yield work(ids, rows)
                    ids, rows, size = [], [], 0
                ids.append(doc_id)
                rows.append(edit(doc_id, split) if edit else split)
                size += len(text)
        if ids:
            yield work(ids, rows)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        run, "doc_id bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    )


def repeat_words(doc_id, words: list[bytes]) -> list[bytes]:
    """The words, of one document in ten with a passage repeated to the end; a null doc_id counts as the empty text."""
    key = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, rest = len(words), key // 10
    if key % 10 or not n:
        return words
    first = rest % n
    period = 1 + (n - first) // (3 + rest % 8)
    cycle = words[first : first + period]
    return words[:first] + (cycle * ((n - first) // period + 1))[: n - first]


def digest(found: DataFrame) -> DataFrame:
    """Number of runs, the longest one, and digests of all runs and of the collapsed text, from the rows of ``scan``."""
    runs = F.col("runs")
    # greatest length, then smallest start, then smallest period
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))

    def sha(text: Column) -> Column:
        return F.sha2(text.cast("binary"), 256)

    return found.withColumn("best", best).select(
        "doc_id",
        F.size(runs).cast("bigint").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.p")).alias("period"),
        F.floor(F.col("best.length") * 1000 / -F.col("best.p")).cast("bigint").alias("exponent_milli"),
        sha(F.array_join(lines, "")).alias("runs_sha256"),
        sha(F.col("collapsed")).alias("collapsed_sha256"),
    )
