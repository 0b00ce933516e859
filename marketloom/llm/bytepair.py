"""Byte-level BPE by replaying the merges over a corpus of words, and back."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.common import texts

FILE = "byte_bpe_multi_50k.tiktoken"
#: Words whose ids a task keeps.
CACHE = 400_000
#: Rows that leave a task at once.
ROWS = 256
#: Characters of text whose words are merged together.
TEXTS = 1 << 23
#: Characters whose words are cut at once.
CUT_AT_ONCE = 1 << 21
#: Bytes of different words that are merged together; one longer word is merged alone.
AT_ONCE = 1 << 20

#: Letters and numbers that came after Unicode 16, first and last code points. The
#: patterns of the rank files know Unicode 16, where these are neither; newer tables have them as \p{L} or \p{N}.
NEWER = """
558-558 58b-58c 88f-88f c5c-c5c cdc-cdc 208f-208f 209d-209f a7ce-a7cf a7d2-a7d2 a7d4-a7d4 a7dd-a7dd a7e2-a7e2
a7f1-a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a-11b0a 11db0-11ddb 11de0-11de9
11df1-11df1 1246f-1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda
18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168-1b168 1d6a6-1d6a6 1df1f-1df24 1df2b-1df81
1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f
2b81e-2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f
"""
LETTER, NUMBER, BLANK, OTHER = 0, 1, 2, 3
#: What the pattern keeps together after an apostrophe.
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")


def character_classes() -> bytes:
    """The class of every code point, as the pattern has them; made once on the driver."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x110000)))
    for kind, name in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        for found in regex.finditer(name, every):
            kinds[ord(found.group()[0]) : ord(found.group()[-1]) + 1] = kind
    for span in NEWER.split():
        first, last = (int(x, 16) for x in span.split("-"))
        kinds[first : last + 1] = OTHER
    return kinds.tobytes()


def match_starts(chars: np.ndarray, begins: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where the matches of ``public_tokenizers.PATTERN`` begin in code points of several texts in a row.

    ``begins`` marks the first character of each text. A match is a run of one class with
    a blank before it; of a run of blanks, the last one before another class is cut off, and
    joins what follows if it is the plain blank. An apostrophe that begins a match takes its suffix along.
    """
    size = len(chars)
    kind = classes[chars]
    blank = kind == BLANK
    last = np.append(begins[1:], True)  # last character of a text
    before = np.concatenate([[OTHER + 1], kind[:-1]])
    before[begins] = OTHER + 1
    after = np.append(kind[1:], OTHER + 1)
    after[last] = OTHER + 1
    joined = np.concatenate([[False], chars[:-1] == 32]) & ~begins
    start = begins | np.where(blank, (before != BLANK) | (after < BLANK) | (after == OTHER), (kind != before) & ~joined)
    quote = np.flatnonzero((chars == 39) & (before != OTHER) & ~joined)
    if len(quote):
        word = np.cumsum(begins)
        taken = np.zeros(len(quote), bool)
        for suffix in SUFFIXES:
            end = quote + len(suffix)
            fits = ~taken & (end < size)
            end = np.minimum(end, size - 1)
            fits &= word[end] == word[quote]
            for i, letter in enumerate(suffix, 1):
                fits &= chars[np.minimum(quote + i, size - 1)] == ord(letter)
            start[quote[fits] + 1] = False
            stop = end[fits] + 1
            start[stop[stop < size]] = True
            taken |= fits
    return start


def _is_text(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


class Codec:
    """A rank file compiled: the pairs of tokens that join."""

    def __init__(self, data: bytes) -> None:
        self.rank = {token: rank for rank, token in token_bytes(data).items()}
        if any(bytes([b]) not in self.rank for b in range(256)):
            raise ValueError("the rank file lacks single bytes")
        self.whole = {token.decode(): rank for token, rank in self.rank.items() if _is_text(token)}
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        # every way to join two tokens to a third
        self.joined: dict[int, int] = {}
        for token, rank in self.rank.items():
            for cut in range(1, len(token)):
                left, right = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if left is not None and right is not None:
                    self.joined[left << 32 | right] = rank
        self.pairs = np.array(sorted(self.joined) or [0], np.int64)
        self.products = np.array([self.joined[k] for k in self.pairs.tolist()] if self.joined else [-1], np.int64)
        self.of_bytes = np.full((256, 256), -1, np.int64)
        for token, rank in self.rank.items():
            if len(token) == 2:
                self.of_bytes[token[0], token[1]] = rank

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the tokens that pairs of tokens join to; -1 where they do not."""
        key = left << 32 | right
        place = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[place] == key, self.products[place], -1)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit numbers.

        All words lie in one row of tokens. The inverted index holds, for the rank of a
        pair of tokens, the places where such a pair begins. Ranks are taken in order;
        all places of a rank are merged together, their new neighbour pairs are looked up
        and entered, and nothing else is looked at again. Within a word the lowest
        rank and then the leftmost place comes first, as when each word is merged alone:
        where a merge would make a pair of a lower rank than the present one, that
        word is brought up to the present rank by itself.
        """
        data = b"".join(words)
        ends = np.cumsum([len(w) for w in words])
        plain = np.frombuffer(data, np.uint8)
        size = len(data)
        token = self.byte[plain]
        after = np.arange(1, size + 1)
        before = np.arange(-1, size - 1)
        after[ends - 1] = -1
        before[ends[:-1]] = -1
        pair = np.full(size, -1, np.int64)  # rank of the pair that begins at a place
        pair[:-1] = self.of_bytes[plain[:-1], plain[1:]]
        pair[ends - 1] = -1
        index: dict[int, list] = {}
        queue: list[int] = []

        def enter(places: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for rank, part in zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(places, cuts)):
                if rank in index:
                    index[rank].append(part)
                else:
                    index[rank] = [part]
                    heapq.heappush(queue, rank)

        def catch_up(place: int, rank: int) -> None:
            """Merge in the word at ``place`` until no pair ranks ``rank`` or lower."""
            while before[place] >= 0:
                place = int(before[place])
            head, todo = place, []
            while place >= 0:
                if 0 <= pair[place] <= rank:
                    todo.append((int(pair[place]), place))
                place = int(after[place])
            heapq.heapify(todo)
            while todo:
                now, place = heapq.heappop(todo)
                if pair[place] != now:
                    continue
                right = int(after[place])
                far, left = int(after[right]), int(before[place])
                token[place], token[right], pair[right], after[place] = now, -1, -1, far
                pair[place] = self.joined.get(now << 32 | int(token[far]), -1) if far >= 0 else -1
                if far >= 0:
                    before[far] = place
                if left >= 0:
                    pair[left] = self.joined.get(int(token[left]) << 32 | now, -1)
                for here in (left, place):
                    if here >= 0 and 0 <= pair[here] <= rank:
                        heapq.heappush(todo, (int(pair[here]), here))
            while head >= 0:
                if pair[head] > rank:
                    enter(np.array([head]), pair[head : head + 1])
                head = int(after[head])

        begun = np.flatnonzero(pair >= 0)
        if len(begun):
            enter(begun, pair[begun])
        while queue:
            rank = heapq.heappop(queue)
            parts = index.pop(rank)
            here = parts[0]
            if len(parts) > 1:
                here = np.concatenate(parts)
                here.sort()
                here = here[np.concatenate([[True], here[1:] != here[:-1]])]
            here = here[pair[here] == rank]
            if not len(here):
                continue
            right = after[here]
            if len(here) > 1 and (right[:-1] == here[1:]).any():
                # places that overlap: the leftmost of a chain and every second one after it
                first = np.concatenate([[True], right[:-1] != here[1:]])
                number = np.arange(len(here))
                taken = (number - np.maximum.accumulate(np.where(first, number, 0))) % 2 == 0
                here, right = here[taken], right[taken]
            far, left = after[right], before[here]
            # a merge right after another one sees it on its left, and is not yet seen by it
            joins = np.concatenate([[False], far[:-1] == here[1:]])
            with_far = np.where(far >= 0, self.ranks_of(np.full(len(here), rank), token[far]), -1)
            with_left = np.where(left >= 0, self.ranks_of(np.where(joins, rank, token[left]), np.full(len(here), rank)), -1)
            low = ((with_far >= 0) & (with_far < rank)) | ((with_left >= 0) & (with_left < rank))
            if low.any():
                word = np.searchsorted(ends, here, "right")
                alone = np.unique(word[low])
                firsts = here[np.searchsorted(word, alone)]
                rest = ~np.isin(word, alone)
                for place in firsts.tolist():
                    catch_up(place, rank)
                here, right, far, left, joins = here[rest], right[rest], far[rest], left[rest], joins[rest]
                with_far, with_left = with_far[rest], with_left[rest]
                if not len(here):
                    continue
            token[here], token[right], pair[right], after[here] = rank, -1, -1, far
            goes_on = far >= 0
            before[far[goes_on]] = here[goes_on]
            pair[here] = with_far
            # the left neighbour of a joining merge is the place of the merge before it
            left = np.where(joins, np.concatenate([[-1], here[:-1]]), left)
            led = left >= 0
            pair[left[led]] = with_left[led]
            touched = np.concatenate([here, left[led]])
            touched = touched[pair[touched] >= 0]
            if len(touched):
                enter(touched, pair[touched])
        alive = token >= 0
        count = np.cumsum(alive)[ends - 1]
        packed = token[alive].astype("<u4").tobytes()
        stops = (4 * count).tolist()
        return [packed[a:b] for a, b in zip([0, *stops[:-1]], stops)]

    def merged(self, words: list[str]) -> list[bytes]:
        """Ids of different words; a word that is a token is that token, the others are merged together."""
        out: dict[str, bytes] = {}
        some: list[str] = []
        coded: list[bytes] = []
        size = 0

        def flush() -> None:
            nonlocal size
            out.update(zip(some, self.replay(coded)))
            some.clear()
            coded.clear()
            size = 0

        for word in words:
            whole = self.whole.get(word)
            if whole is not None:
                out[word] = whole.to_bytes(4, "little")
                continue
            data = word.encode("utf-8", "surrogatepass")
            if some and size + len(data) > AT_ONCE:
                flush()
            some.append(word)
            coded.append(data)
            size += len(data)
        if some:
            flush()
        return [out[word] for word in words]


def token_bytes(data: bytes) -> dict[int, bytes]:
    """The bytes of every id of a rank file."""
    lines = (line.split() for line in data.splitlines() if line.strip())
    return {int(rank): base64.b64decode(token) for token, rank in lines}


def decoded(ids: bytes, raw: dict[int, bytes]) -> bytes:
    """The bytes of ids; an id that the file does not have gives nothing."""
    numbers = np.frombuffer(ids, "<u4").tolist()
    try:
        return b"".join([raw[i] for i in numbers])
    except KeyError:
        return b"".join([raw.get(i, b"") for i in numbers])


class Numbers(dict):
    """Numbers keys in the order they come."""

    def __missing__(self, key: str) -> int:
        number = self[key] = len(self)
        return number


class Corpus:
    """Texts gathered until there are ``TEXTS`` characters of them; their new words are then merged together.

    A text is kept as the numbers of its words. Words that came in an earlier corpus
    are not merged again, until there are more than ``CACHE`` of them.
    """

    def __init__(self, codec: Codec, classes: bytes) -> None:
        self.codec = codec
        self.classes = np.frombuffer(classes, np.uint8)
        self.rows: list[np.ndarray] = []
        self.size = 0
        self.number, self.ids = Numbers(), []

    def add(self, texts: list[str]) -> None:
        """Cut texts into words, a bounded number of characters at a time, or one longer text."""
        begin = 0
        while begin < len(texts):
            end, size = begin, 0
            while end < len(texts) and (end == begin or size + len(texts[end]) <= CUT_AT_ONCE):
                size += len(texts[end])
                end += 1
            self._add(texts[begin:end], size)
            begin = end

    def _add(self, texts: list[str], size: int) -> None:
        self.size += size
        row = "".join(texts)
        lengths = np.array([len(t) for t in texts])
        ends = np.cumsum(lengths)
        if not size:
            self.rows += [np.zeros(0, np.int32)] * len(texts)
            return
        begins = np.zeros(size, bool)
        begins[(ends - lengths)[lengths > 0]] = True
        chars = np.frombuffer(row.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.flatnonzero(match_starts(chars, begins, self.classes))
        cuts = starts.tolist()
        cuts.append(size)
        words = map(row.__getitem__, map(slice, cuts, cuts[1:]))
        numbers = np.fromiter(map(self.number.__getitem__, words), np.int32, len(starts))
        self.rows += np.split(numbers, np.searchsorted(starts, ends[:-1]))

    def flush(self) -> list[bytes]:
        """Ids of the texts added since the last time, as bytes."""
        self.ids += self.codec.merged(list(self.number)[len(self.ids) :])
        of = self.ids.__getitem__
        out = [b"".join(map(of, row.tolist())) for row in self.rows]
        self.rows, self.size = [], 0
        if len(self.ids) > CACHE:
            self.number, self.ids = Numbers(), []
        return out


def read_ranks(spark: SparkSession, path: str | None = None) -> bytes:
    """The bytes of a rank file: of a local path on the driver, or of any path that Spark reads."""
    path = path or public_tokenizers.path(FILE)
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).first()["content"])
    with open(path, "rb") as file:
        return file.read()


def encode(docs: DataFrame, ranks: bytes) -> DataFrame:
    """(doc_id, n_tokens, ids): the ids of every whole text as little-endian unsigned 32-bit numbers.

    Each match of ``public_tokenizers.PATTERN`` is encoded by itself, without special tokens. About eight million
    characters are one corpus, whose different words are merged together, see ``Codec.replay``. Memory hangs on
    that, on the two bounded caches and on the longest text; one unbroken word takes about 60 bytes per byte.
    Null or empty text: no ids. Repeated rows and null doc_ids are kept; extra columns are ignored. Empty: empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast((ranks, character_classes()))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, classes = shared.value
        corpus = Corpus(Codec(ranks), classes)
        held: list[pa.Array] = []

        def emit() -> Iterator[pa.RecordBatch]:
            coded, at = corpus.flush(), 0
            for doc_ids in held:
                some = coded[at : at + len(doc_ids)]
                at += len(doc_ids)
                counts = pa.array([len(c) // 4 for c in some], pa.int64())
                yield pa.RecordBatch.from_arrays([doc_ids, counts, pa.array(some, pa.binary())], schema=schema)
            held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                corpus.add(texts(some))
                held.append(some.column("doc_id"))
                if corpus.size > TEXTS:
                    yield from emit()
        yield from emit()

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary")


def decode(encoded: DataFrame, ranks: bytes) -> DataFrame:
    """The rows of ``encoded`` with a column ``data``, the bytes that ``ids`` stand for; null ids give null.

    Needs doc_id, n_tokens and ids; other columns are ignored. Bytes of a text's ids are its UTF-8.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = token_bytes(shared.value)
        for batch in batches:
            made = [None if ids is None else decoded(ids, raw) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_tokens"), batch.column("ids"), pa.array(made, pa.binary())], schema=schema
            )

    return encoded.select(F.col("doc_id").cast("bigint"), F.col("n_tokens").cast("bigint"), "ids").mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids binary, data binary"
    )
