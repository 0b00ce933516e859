"""Secret scan: all rules in one automaton, one pass over the bytes of a text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.automata import Automaton, any_case, backwards, parse
from marketloom.llm.common import emit, texts


@dataclass(frozen=True)
class Rule:
    """A kind of secret: ``head`` (in either case if ``fold``) and ``tail``, and how long a match must be.

    The combined automaton looks for the head alone where there is one, so that
    counted repeats of a tail, which would multiply its states, are left to the
    rule's own automaton; ``whole`` rules are looked for with their tail. ``least`` counts the bytes of the last run of ``tail_set`` bytes in a match; a
    shorter match is dropped, and what it covered is not searched again. ``run``
    are the bytes of a rule's first part, if a head may lie inside it: where a match fails from one head,
    it fails from all later ones in the same run of them, which are not tried.
    """

    kind: str
    head: str
    tail: str
    fold: bool = False
    least: int = 0
    tail_set: str = ""
    whole: bool = False
    run: str = ""


#: The three kinds whose spans are the base, in this order.
BASE = (
    Rule(
        "assign", "(password|passwd|secret|token|api_?key)", r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
        True, 6, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-", True,
    ),
    Rule("access", "AKIA", "[A-Z0-9]{16,}"),
    Rule("hex", "", "[0-9a-f]{24,}", whole=True),
)

#: Published token formats that the base does not know as such.
MORE = (
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-", "[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza", "[A-Za-z0-9_-]{35}"),
    Rule("stripe", "[sr]k_(live|test)_", "[A-Za-z0-9]{16,}"),
    Rule(
        "jwt", "eyJ", r"[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
        run="ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-",
    ),
    Rule("key", "-----BEGIN ", "([A-Z]+ )*PRIVATE KEY-----"),
    Rule("bearer", "bearer ", "[A-Za-z0-9._~+/=-]{16,}", True),
    Rule("url", "://[A-Za-z0-9._-]+:", r"""[^\x00-\x20@/"':]{3,}@"""),
)


class Scanner:
    """Rules compiled once: one automaton that finds where matches end, and per rule one each way for their bounds."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = rules
        heads = [any_case(parse(r.head)) if r.fold else parse(r.head) for r in rules]
        whole = [h + parse(r.tail) for h, r in zip(heads, rules)]
        sought = [w if r.whole else h for w, h, r in zip(whole, heads, rules)]
        self.all = Automaton(sought, anywhere=True)
        self.forward = [Automaton([w], anywhere=False) for w in whole]
        self.backward = [Automaton([backwards(w)], anywhere=False) for w in sought]
        self.tails = [frozenset(r.tail_set.encode()) for r in rules]
        self.runs = [re.compile(b"[" + re.escape(r.run.encode()) + b"]*+") if r.run else None for r in rules]

    def hits(self, data: bytes) -> list[tuple[int, int]]:
        """(end, rules that end there) of the bytes at which a match of any rule may end."""
        table, state, first_end, ends = self.all.table, self.all.start, self.all.first_end, self.all.ends
        found = []
        for at, byte in enumerate(data, 1):
            state = table[state | byte]
            if state >= first_end:
                found.append((at, ends[state >> 8]))
        return found

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule) in bytes: leftmost, longest, not overlapping within a rule."""
        out = []
        done = [0] * len(self.rules)
        for end, which in self.hits(data):
            while which:
                i = (which & -which).bit_length() - 1
                which &= which - 1
                if end <= done[i]:
                    continue
                start = self.backward[i].furthest_back(data, end, done[i])
                if start < 0:
                    continue
                stop = self.forward[i].longest(data, start)
                if stop < 0:
                    if self.runs[i]:
                        done[i] = self.runs[i].match(data, start).end()
                    continue
                done[i] = stop
                if self._long_enough(data, start, stop, i):
                    out.append((start, stop, i))
        return sorted(out)

    def _long_enough(self, data: bytes, start: int, stop: int, i: int) -> bool:
        least, tail = self.rules[i].least, self.tails[i]
        if not least:
            return True
        head = self._tail_start(data, start, stop, tail)
        return stop - head >= least

    @staticmethod
    def _tail_start(data: bytes, start: int, stop: int, tail: frozenset) -> int:
        """Where the value begins: after the first ':' or '=' that follows the name, blanks and a quote skipped."""
        at = start
        while data[at] not in b":=":
            at += 1
        at += 1
        while at < stop and data[at] not in tail:
            at += 1
        return at


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """(doc_id, found array<struct<kind, start, end, place>>) of every row.

    Offsets are in code points, the end exclusive; spans are sorted by start, then
    rule order, which is ``place``. All rules run in one pass over the UTF-8 bytes of the whole text; where
    the pass says that a match ends, two small automata walk back to its first
    byte and on to its last. Null or empty text: no spans. Rows that repeat or
    lack an id are scanned like others; extra columns are ignored.
    """
    scanner = Scanner(rules)
    kinds = [r.kind for r in rules]
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("place", pa.int32())])
    schema = pa.schema([("doc_id", pa.int64()), ("found", pa.list_(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in texts(batch):
                data = text.encode("utf-8", "surrogatepass")
                rows, at, chars = [], 0, 0
                for start, end, i in scanner.spans(data):
                    chars += len(data[at:start].decode("utf-8", "replace"))
                    at = start
                    rows.append((kinds[i], chars, chars + len(data[start:end].decode("utf-8", "replace")), i))
                found.append([dict(zip(("kind", "start", "end", "place"), r)) for r in rows])
            yield from emit({"doc_id": batch.column("doc_id"), "found": found}, schema)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        run, "doc_id bigint, found array<struct<kind:string,start:bigint,end:bigint,place:int>>"
    )


def joined(spans):
    """kind:start:end of an array of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _is(value: int):
    return lambda place: place == value


def digest(found: DataFrame, base: tuple[str, ...]) -> DataFrame:
    """Counts, hash and list of spans from rows (doc_id, found).

    ``n_`` counts and ``base_sha256`` are of the base kinds' base spans; ``spans``
    holds these and all others.
    """
    of_base = F.filter("found", lambda s: s["place"] < len(base))
    return found.select(
        "doc_id",
        *[
            F.size(F.filter(F.transform("found", lambda s: s["place"]), _is(i))).cast("bigint").alias(f"n_{kind}")
            for i, kind in enumerate(base)
        ],
        F.sha2(joined(of_base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )
