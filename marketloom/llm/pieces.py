"""SentencePiece encoding and decoding as the shortest path through a weighted transducer."""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.common import texts
from marketloom.llm.lattice import Trie, arcs, read_pieces, shortest

#: Where the public tokenizer files lie, and the file used unless another is named.
FOLDER = "/opt/tokenizers"
MODEL = "piece_bpe_32k.model"

BLANK = "▁"
NORMAL, UNKNOWN, OWN, BYTE = 1, 2, 4, 6  # kinds of pieces in the file
#: An unknown character costs this much more than the worst piece.
PENALTY = 10.0
#: Chunks whose paths a task keeps, and chunks that are worked on at once.
CACHE = 300_000
AT_ONCE = 20_000
#: Rows that leave a task at once.
ROWS = 512


class Codec:
    """A model file compiled: normaliser, piece transducer and byte fallback, ready to compose with texts.

    Composition is per chunk: texts are cut where no piece of the vocabulary can
    reach across, so that the shortest path of the text is the shortest paths of
    its chunks in a row, and a chunk that comes again is not searched again.
    """

    def __init__(self, data: bytes) -> None:
        pieces, _, normaliser = read_pieces(data)
        self.rule = (normaliser.get(1) or [b""])[0].decode()
        if self.rule not in ("", "identity", "nfkc") or (self.rule == "identity" and (normaliser.get(2) or [b""])[0]):
            raise ValueError(f"normaliser {self.rule} is not supported")
        self.prefix = bool((normaliser.get(3) or [1])[0])
        self.squeeze = bool((normaliser.get(4) or [1])[0])
        text_of = {i: t for i, (t, _, kind) in enumerate(pieces) if kind in (NORMAL, OWN)}
        self.trie = Trie({t: i for i, t in text_of.items()})
        scores = np.array([s for _, s, _ in pieces] or [0.0])
        worst = min((pieces[i][1] for i in text_of), default=0.0)
        # the last weight is that of an unknown character
        self.weight = np.append(scores, worst - PENALTY)
        self.bytes = {int(t[3:5], 16): i for i, (t, _, kind) in enumerate(pieces) if kind == BYTE}
        self.unknown = next((i for i, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN), 0)
        self.raw = [b""] * len(pieces)
        for i, (t, _, kind) in enumerate(pieces):
            if kind in (NORMAL, OWN):
                self.raw[i] = t.replace(BLANK, " ").encode()
            elif kind == UNKNOWN:
                self.raw[i] = " ⁇ ".encode()
        for value, i in self.bytes.items():
            self.raw[i] = bytes([value])
        inside = {t[i : i + 2] for t in text_of.values() for i in range(len(t) - 1)}
        letters = {c for t in text_of.values() for c in t}
        alone = "".join(re.escape(c) for c in "\n\t\r" if c not in letters)
        # blanks only begin pieces in most vocabularies; otherwise a line is one chunk
        starts = not any(b == BLANK and a != BLANK for a, b in inside)
        body = f"{BLANK}*[^{BLANK}{alone}]+|{BLANK}+" if starts else f"[^{alone}]+" if alone else r"(?s:.+)"
        self.chunk = re.compile(f"[{alone}]|{body}" if alone else body)

    def normalise(self, text: str) -> str:
        if self.rule == "nfkc":
            text = unicodedata.normalize("NFKC", text)
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (BLANK if self.prefix else "") + text.replace(" ", BLANK)

    def paths(self, chunks: list[str]) -> list[bytes]:
        """Ids of the best path of each chunk, as the bytes of int32 numbers."""
        lattice = arcs(self.trie, chunks)
        used, bounds = shortest(lattice, self.weight[lattice.piece])
        ids = lattice.piece[used]
        data, cut = ids.astype("<i4").tobytes(), (4 * bounds).tolist()
        out = [data[a:b] for a, b in zip(cut, cut[1:])]
        for i in set((np.searchsorted(bounds, np.flatnonzero(ids < 0), "right") - 1).tolist()):
            arcs_of = used[bounds[i] : bounds[i + 1]]
            spelt = [([p] if p >= 0 else self._spell(c)) for p, c in zip(lattice.piece[arcs_of], lattice.chars[lattice.start[arcs_of]])]
            out[i] = np.array([x for part in spelt for x in part], "<i4").tobytes()
        return out

    def _spell(self, char: int) -> list[int]:
        if len(self.bytes) < 256:
            return [self.unknown]
        return [self.bytes[b] for b in chr(char).encode("utf-8", "surrogatepass")]

    def encoder(self):
        """A function from texts to id bytes that keeps the paths of chunks it has seen, at most ``CACHE`` of them."""
        cache: dict[str, bytes] = {}

        def encode(batch: list[str]) -> list[bytes]:
            split = [self.chunk.findall(self.normalise(text)) for text in batch]
            new = list({c for chunks in split for c in chunks if c not in cache})
            if len(cache) + len(new) > CACHE:
                cache.clear()
                new = list({c for chunks in split for c in chunks})
            for at in range(0, len(new), AT_ONCE):
                part = new[at : at + AT_ONCE]
                cache.update(zip(part, self.paths(part)))
            return [b"".join([cache[c] for c in chunks]) for chunks in split]

        return encode

    def decode(self, ids, check: bool = True) -> str:
        """Text of ids; bytes that are no UTF-8 become replacement characters, ids outside the vocabulary nothing.

        Without ``check`` all ids must be in the vocabulary, as those of ``encoder`` are.
        """
        raw = self.raw
        if check:
            ids = [i for i in ids if i is not None and 0 <= i < len(raw)]
        text = b"".join([raw[i] for i in ids])
        text = text.decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def read_model(spark: SparkSession, path: str | None = None) -> bytes:
    """The bytes of a model file: of a local path on the driver, or of any path that Spark reads."""
    path = path or os.path.join(FOLDER, MODEL)
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).first()["content"])
    with open(path, "rb") as file:
        return file.read()


def encode(docs: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, n_pieces, ids, round_trip): the best segmentation of every whole text.

    The best path has the largest sum of piece scores; a character without a
    piece is spelt in bytes. Where the scores are merge ranks, as in the default file,
    this is the best path by rank, not the order of merges. ``round_trip`` says that
    decoding gives the normalised text back; it fails only for texts that hold the blank sign itself or
    unpaired surrogates. Null or empty text: no ids. Repeated rows and null doc_ids are kept;
    extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids", pa.list_(pa.int32())), ("round_trip", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        work = codec.encoder()
        for batch in batches:
            rows = texts(batch)
            for at in range(0, len(rows), ROWS):
                some = rows[at : at + ROWS]
                coded = work(some)
                values = np.frombuffer(b"".join(coded), "<i4")
                offsets = np.concatenate([[0], np.cumsum([len(c) // 4 for c in coded])]).astype(np.int32)
                lists = values.tolist()
                same = []
                for i, text in enumerate(some):
                    plain = codec.normalise(text).replace(BLANK, " ")
                    plain = plain[1:] if codec.prefix and plain else plain
                    same.append(codec.decode(lists[offsets[i] : offsets[i + 1]], check=False) == plain)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, ROWS), pa.array(np.diff(offsets), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), pa.array(same),
                    ],
                    schema=schema,
                )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        run, "doc_id bigint, n_pieces bigint, ids array<int>, round_trip boolean"
    )


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, text) from rows with doc_id and ids; null ids give null, ids outside the vocabulary are passed over."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in batches:
            made = [None if ids is None else codec.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.string())], schema=schema)

    return encoded.select(F.col("doc_id").cast("bigint"), "ids").mapInArrow(run, "doc_id bigint, text string")
