"""Which texts contain which needles, for tables of both, without shuffling the texts' grams.

A needle is looked for by one gram of it. Texts and needles choose grams by the same rule: of
every ``window`` neighbouring grams the one with the least hash. A text that contains a needle chose
what the needle chose, so a text offers a few keys per window instead of all its grams. Needles
come in classes by length, and a class has the longest grams and windows its shortest needle has room for.

Two passes over the texts, both without a shuffle of them: the first counts, in a sketch of fixed size, how
often the needles' keys occur; each needle then waits under its rarest one. In the second, needles
of a measured, bounded size are looked for where their keys occur; beyond it, the places whose key is in a Bloom filter
are let out with the text around them, meet the needles by an equi-join on the key, and the text around decides. Sketch and
filter have fixed sizes, whatever the tables hold.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from marketloom.session import materialize

#: Shortest needle, gram and window of each class; a needle belongs to the last class it is long enough for.
CLASSES = ((1, 1, 1), (2, 2, 1), (4, 3, 2), (8, 5, 4), (16, 8, 9), (48, 16, 33))
FILTER_BITS = 1 << 24
ROWS, CELLS = 4, 1 << 14
#: Needles of this many bytes are sent to every task; more are joined.
NEEDLE_BYTES = 8 << 20
#: Characters that are looked at together; their keys stay in a processor's cache.
CHARS = 1 << 16
#: Least and most cells of the table that says which keys may be a needle's, and cells for each key.
MARKS, CELLS_A_KEY = (1 << 16, 1 << 24), 64

PRIME = np.uint64(0x9E3779B97F4A7C15)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(29))


def _grams(chars: np.ndarray, ends: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all grams of a class, and which of them texts choose."""
    _, gram, window = CLASSES[level]
    size = len(chars) - gram + 1
    if size <= 0 or size - window + 1 <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    with np.errstate(over="ignore"):
        one = chars.astype(np.uint64)
        sums, have = one, 1
        while 2 * have <= gram:  # two grams make one of twice the length
            sums = sums[:-have] * PRIME ** np.uint64(have) + sums[have:]
            have *= 2
        for _ in range(gram - have):
            sums = sums[:-1] * PRIME + one[have:]
            have += 1
        keys = _mixed(sums + np.uint64(level + 1) * PRIME)
    # grams that reach from one text into the next are no grams
    whole = _apart(size, ends, gram)
    if window == 1:
        return keys, whole
    least = _over(keys, window, np.minimum)
    least[~_apart(len(least), ends, gram + window - 1)] = 0
    # a gram is the least of some window if none of its windows has a lesser one only
    padded = np.concatenate([np.zeros(window - 1, np.uint64), least, np.zeros(window - 1, np.uint64)])
    whole &= _over(padded, window, np.maximum) == keys
    return keys, whole


def _apart(size: int, ends: np.ndarray, length: int) -> np.ndarray:
    """True where ``length`` characters from a place on do not reach over the end of a text."""
    apart = np.ones(size, bool)
    over = (ends[:, None] - np.arange(1, length)).ravel()
    apart[over[(over >= 0) & (over < size)]] = False
    return apart


def chosen(chars: np.ndarray, ends: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, keys) that texts choose at a class. ``chars`` are the code points of several texts in a row, ``ends`` where each ends."""
    keys, own = _grams(chars, ends, level)
    places = np.flatnonzero(own)
    return places, keys[places]


def _over(values: np.ndarray, window: int, pick: np.ufunc) -> np.ndarray:
    """Least or greatest of every ``window`` neighbours, by doubling."""
    have = 1
    while have < window:
        step = min(have, window - have)
        values = pick(values[: len(values) - step], values[step:])
        have += step
    return values


def _texts(column: pa.Array) -> Iterator[tuple[int, list[str], np.ndarray, np.ndarray]]:
    """(first row, texts, code points, ends) of parts of a column; null is the empty text."""
    texts = [t or "" for t in column.to_pylist()]
    begin = 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (end == begin or size + len(texts[end]) <= CHARS):
            size += len(texts[end])
            end += 1
        part = texts[begin:end]
        chars = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
        yield begin, part, chars, np.cumsum([len(t) for t in part])
        begin = end


def _cells(keys: np.ndarray) -> np.ndarray:
    """The cell of each key in each row of the sketch."""
    shifts = np.arange(ROWS, dtype=np.uint64) * np.uint64(15)
    return ((keys[:, None] >> shifts) % np.uint64(CELLS)).astype(np.int64) + np.arange(ROWS) * CELLS


def _bits(keys: np.ndarray) -> np.ndarray:
    return (keys % np.uint64(FILTER_BITS)).astype(np.int64)


def _level(length: int) -> int:
    return max(i for i, (least, _, _) in enumerate(CLASSES) if length >= least)


def needle_keys(needles: DataFrame) -> DataFrame:
    """(needle_id, needle, level, key): every key that a needle chooses; distinct ones."""
    id_type = to_arrow_type(needles.schema["needle_id"].dataType)
    schema = pa.schema([("needle_id", id_type), ("needle", pa.string()), ("level", pa.int32()), ("key", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column("needle_id").to_pylist(), []
            for name, needle in zip(ids, batch.column("needle").to_pylist()):
                chars = np.frombuffer(needle.encode("utf-32-le", "surrogatepass"), np.uint32)
                level = _level(len(needle))
                _, keys = chosen(chars, np.array([len(chars)]), level)
                rows += [(name, needle, level, key) for key in np.unique(keys.view(np.int64)).tolist()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    kept = needles.filter(F.length("needle") > 0).select("needle_id", "needle")
    return kept.mapInArrow(run, f"needle_id {needles.schema['needle_id'].dataType.simpleString()}, needle string, level int, key bigint")


def key_filter(keys: DataFrame) -> bytes:
    """A Bloom filter of ``FILTER_BITS`` bits of a table's keys; at most that many bits come to the driver."""
    bit = F.col("key").bitwiseAND(F.lit(FILTER_BITS - 1))
    parts = keys.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / 32768).cast("int").alias("part")).agg(
        F.bitmap_construct_agg(F.pmod("bit", F.lit(32768))).alias("bits")
    )
    whole = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in parts.collect():
        whole[row.part * 4096 : (row.part + 1) * 4096] = np.frombuffer(bytes(row.bits), np.uint8)
    return whole.tobytes()


def _has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = _bits(keys)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def key_counts(haystacks: DataFrame, bits: bytes, levels: Sequence[int]) -> np.ndarray:
    """A count-min sketch of the keys of all texts that the filter lets through."""
    shared = haystacks.sparkSession.sparkContext.broadcast(bits)
    schema = pa.schema([("cell", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(shared.value, np.uint8)
        counts = np.zeros(ROWS * CELLS, np.int64)
        for batch in batches:
            for _, _, chars, ends in _texts(batch.column("text")):
                for level in levels:
                    keys, own = _grams(chars, ends, level)
                    own &= _has(known, keys)
                    keys = keys[own]
                    if len(keys):
                        counts += np.bincount(_cells(keys).ravel(), minlength=len(counts))
        cells = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(counts[cells])], schema=schema)

    total = np.zeros(ROWS * CELLS, np.int64)
    for row in haystacks.select("text").mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        total[row.cell] = row.n
    return total


def rarest(keyed: DataFrame, counts: np.ndarray) -> DataFrame:
    """One key per needle, that which the sketch counts least; needles of which a key does not occur are left out."""
    shared = keyed.sparkSession.sparkContext.broadcast(counts)
    id_type = to_arrow_type(keyed.schema["needle_id"].dataType)
    schema = pa.schema([("needle_id", id_type), ("needle", pa.string()), ("level", pa.int32()), ("key", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy().view(np.uint64)
            estimate = shared.value[_cells(keys)].min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(estimate, pa.int64())], schema=schema)

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keyed.schema)
    rated = keyed.mapInArrow(run, f"{ddl}, n bigint")
    best = rated.groupBy("needle_id", "needle", "level").agg(F.min(F.struct("n", "key")).alias("best"))
    return best.filter("best.n > 0").select("needle_id", "needle", "level", F.col("best.key").alias("key"))


def _places(haystacks: DataFrame, bits: bytes, reach: dict[int, int]) -> DataFrame:
    """(hay_id, key, piece): places whose key the filter knows, with as many characters before and after as the longest needle of the class.

    Equal pieces of a text come once; around short needles most are equal.
    """
    shared = haystacks.sparkSession.sparkContext.broadcast(bits)
    id_type = to_arrow_type(haystacks.schema["hay_id"].dataType)
    schema = pa.schema([("hay_id", id_type), ("key", pa.int64()), ("piece", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            ids = batch.column("hay_id").to_pylist()
            for begin, part, chars, ends in _texts(batch.column("text")):
                starts = np.concatenate([[0], ends[:-1]])
                for level, far in reach.items():
                    places, keys = chosen(chars, ends, level)
                    hit = _has(known, keys)
                    places, keys = places[hit], keys[hit].view(np.int64)
                    of = np.searchsorted(ends, places, "right")
                    local = (places - starts[of]).tolist()
                    found = dict.fromkeys(
                        (t, key, part[t][max(0, p - far) : p + far]) for t, key, p in zip(of.tolist(), keys.tolist(), local)
                    )
                    rows = list(found)
                    for at in range(0, len(rows), 4096):
                        texts, keyed, pieces = zip(*rows[at : at + 4096])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([ids[begin + t] for t in texts], id_type), pa.array(keyed, pa.int64()), pa.array(pieces, pa.string())],
                            schema=schema,
                        )

    return haystacks.select("hay_id", "text").mapInArrow(run, f"hay_id {haystacks.schema['hay_id'].dataType.simpleString()}, key bigint, piece string")


def _marks(listed: np.ndarray) -> np.ndarray:
    """A table, small where few keys are listed, that says by a key's last bits whether it may be one of them."""
    cells = min(MARKS[1], max(MARKS[0], 1 << (CELLS_A_KEY * len(listed)).bit_length()))
    marks = np.zeros(cells, bool)
    marks[listed & (cells - 1)] = True
    return marks


def _listed(keys: np.ndarray, own: np.ndarray, listed: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, numbers) of the keys among ``own`` that are in the sorted list; only those that the table marks are looked up."""
    places = np.flatnonzero(own & marks[(keys & np.uint64(len(marks) - 1)).view(np.int64)])
    mine = keys[places].view(np.int64)
    at = np.minimum(np.searchsorted(listed, mine), len(listed) - 1)
    hit = listed[at] == mine
    return places[hit], at[hit]


def _held(haystacks: DataFrame, waiting: list[tuple[str, int]], levels: Sequence[int]) -> DataFrame:
    """Distinct (hay_id, needle) by looking for the needles, a bounded list, where their keys occur."""
    of_key: dict[int, list[str]] = {}
    for needle, key in waiting:
        of_key.setdefault(key, []).append(needle)
    listed = np.array(sorted(of_key), np.int64)
    shared = haystacks.sparkSession.sparkContext.broadcast((listed, _marks(listed), [of_key[k] for k in listed.tolist()]))
    id_type = to_arrow_type(haystacks.schema["hay_id"].dataType)
    schema = pa.schema([("hay_id", id_type), ("needle", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, marks, needles_of = shared.value
        for batch in batches:
            ids = batch.column("hay_id").to_pylist()
            for begin, part, chars, ends in _texts(batch.column("text")):
                rows = []
                for level in levels:
                    keys, own = _grams(chars, ends, level)
                    places, at = _listed(keys, own, known, marks)
                    # each key once per text
                    met = np.unique(np.searchsorted(ends, places, "right") * len(known) + at)
                    for text, key in zip((met // len(known)).tolist(), (met % len(known)).tolist()):
                        rows += [(ids[begin + text], needle) for needle in needles_of[key] if needle in part[text]]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return haystacks.select("hay_id", "text").mapInArrow(run, f"hay_id {haystacks.schema['hay_id'].dataType.simpleString()}, needle string")


def containing(haystacks: DataFrame, needles: DataFrame, most: int = NEEDLE_BYTES) -> DataFrame:
    """Distinct (needle_id, hay_id) where the text holds the needle as it stands.

    ``haystacks`` has hay_id and text, ``needles`` needle_id and needle. Empty and null needles are held by nothing, null
    texts hold nothing. Equal needles share one look. A very common needle meets as many texts as hold it,
    which is the answer's own size; its key is joined as a struct, so the adaptive skew join may split it.
    Needles of up to ``most`` bytes, measured, are sent to the texts and looked for where their keys occur; more of them
    meet the places by a join, where a place carries twice the longest needle of its class around it.
    """
    named = needles.filter(F.length("needle") > 0).select("needle_id", "needle")
    keyed = materialize(needle_keys(named.select(F.col("needle").alias("needle_id"), "needle").distinct()), "needle-keys")
    reach = {r.level: r.reach for r in keyed.groupBy("level").agg(F.max(F.length("needle")).alias("reach")).collect()}  # a row per class
    pairs = f"needle_id {needles.schema['needle_id'].dataType.simpleString()}, hay_id {haystacks.schema['hay_id'].dataType.simpleString()}"
    if not reach:
        return haystacks.sparkSession.createDataFrame([], pairs)
    waiting = materialize(rarest(keyed, key_counts(haystacks, key_filter(keyed), sorted(reach))), "needles")
    size = waiting.agg(F.sum(4 * F.length("needle") + 16)).first()[0]
    if not size:
        return haystacks.sparkSession.createDataFrame([], pairs)
    if size <= most:
        met = _held(haystacks, [(r.needle, r.key) for r in waiting.collect()], sorted(reach))
    else:
        places = _places(haystacks, key_filter(waiting), reach)
        key = F.struct("key").alias("k")
        met = places.select("hay_id", key, "piece").join(waiting.select("needle", key), "k").filter(F.contains("piece", F.col("needle")))
    found = met.select("hay_id", F.struct("needle").alias("n")).distinct()
    return found.join(named.select("needle_id", F.struct("needle").alias("n")), "n").select("needle_id", "hay_id").distinct()
