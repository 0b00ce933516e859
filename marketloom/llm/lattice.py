"""Piece lattices of many words at once, in numpy: a trie finds all arcs, a semiring sums up the paths."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

NEVER = -1e30


def read_pieces(data: bytes) -> tuple[list[tuple[str, float, int]], dict[int, list], dict[int, list]]:
    """(text, score, type) of the pieces of a sentence-piece model file, and its trainer's and normaliser's fields by number."""
    import struct

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value, at

    def fields(at: int, end: int) -> Iterator[tuple[int, object]]:
        while at < end:
            key, at = number(at)
            kind = key & 7
            if kind == 0:
                value, at = number(at)
            elif kind == 2:
                size, at = number(at)
                value, at = (at, at + size), at + size
            elif kind == 5:
                value, at = struct.unpack("<f", data[at : at + 4])[0], at + 4
            else:
                value, at = data[at : at + 8], at + 8
            yield key >> 3, value

    pieces, trainer, normaliser = [], {}, {}
    for field, value in fields(0, len(data)):
        if field == 1:
            of = dict(fields(*value))
            pieces.append((data[slice(*of[1])].decode(), float(of.get(2, 0.0)), int(of.get(3, 1))))
        elif field in (2, 3):
            into = trainer if field == 2 else normaliser
            for f, v in fields(*value):
                into.setdefault(f, []).append(data[slice(*v)] if isinstance(v, tuple) else v)
    return pieces, trainer, normaliser


class Trie:
    """Pieces over code points. ``edges`` are sorted (state, character) keys, ``ends`` the piece that ends in a state or -1."""

    def __init__(self, pieces: dict[str, int]) -> None:
        child: list[dict[str, int]] = [{}]
        ends = [-1]
        for text, number in pieces.items():
            at = 0
            for c in text:
                to = child[at].get(c)
                if to is None:
                    to = child[at][c] = len(child)
                    child.append({})
                    ends.append(-1)
                at = to
            ends[at] = number
        keys = [((s << 21) | ord(c), to) for s, row in enumerate(child) for c, to in row.items()]
        keys.sort()
        self.keys = np.array([k for k, _ in keys], np.int64)
        self.to = np.array([t for _, t in keys], np.int64)
        self.ends = np.array(ends, np.int64)
        # the first character, the most frequent step, without a search
        self.first = np.zeros(0x110000 if not keys else max(ord(c) for c in child[0]) + 1 if child[0] else 1, np.int64)
        for c, to in child[0].items():
            self.first[ord(c)] = to

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Next states; 0 where there is none."""
        if not len(self.keys):
            return np.zeros_like(state)
        key = (state << 21) | char
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], 0)


@dataclass
class Arcs:
    """Arcs of the lattices of a batch of words, in order of their end. Positions are those of the joined words."""

    chars: np.ndarray
    begin: np.ndarray  # first position of each word, and the end of the last
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray  # -1: a single character that is no piece


def arcs(trie: Trie, vocabulary: list[str]) -> Arcs:
    lengths = np.array([len(w) for w in vocabulary], np.int64)
    begin = np.concatenate([[0], np.cumsum(lengths)])
    chars = np.frombuffer("".join(vocabulary).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    stop = np.repeat(begin[1:], lengths)
    start = np.arange(len(chars))
    state = np.where(chars < len(trie.first), trie.first[np.minimum(chars, len(trie.first) - 1)], 0)
    single = np.zeros(len(chars), bool)
    found = []
    at, length = start, 1
    while len(at):
        live = state > 0
        at, state = at[live], state[live]
        piece = trie.ends[state]
        hit = piece >= 0
        found.append((at[hit], at[hit] + length, piece[hit]))
        if length == 1:
            single[at[hit]] = True
        more = at + length < stop[at]
        at, state = at[more], state[more]
        state = trie.step(state, chars[at + length]) if len(at) else state
        length += 1
    bare = np.flatnonzero(~single)
    found.append((bare, bare + 1, np.full(len(bare), -1)))
    s, e, p = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((s, e))
    return Arcs(chars, begin, s[order], e[order], p[order])


def _waves(lattice: Arcs) -> Iterator[np.ndarray]:
    """Arcs grouped by how far into their words they end, nearest first; within a group, arcs to one position are neighbours."""
    word = np.searchsorted(lattice.begin, lattice.end, "left") - 1
    depth = lattice.end - lattice.begin[word]
    order = np.argsort(depth, kind="stable")
    edges = np.flatnonzero(np.diff(depth[order])) + 1
    return iter(np.split(order, edges)) if len(order) else iter(())


def marginal(lattice: Arcs, weight: np.ndarray) -> np.ndarray:
    """Log of the summed probability of all paths of each word: the forward recursion in log space."""
    # a word's first position shares its number with the end of the word before, so ends are kept apart
    reached = np.full(len(lattice.chars) + 1, NEVER)
    first = np.zeros(len(lattice.chars) + 1, bool)
    first[lattice.begin[:-1]] = True
    for wave in _waves(lattice):
        start, end = lattice.start[wave], lattice.end[wave]
        value = np.where(first[start], 0.0, reached[start]) + weight[wave]
        cut = np.concatenate([[0], np.flatnonzero(np.diff(end)) + 1])
        top = np.maximum.reduceat(value, cut)
        spread = np.exp(value - np.repeat(top, np.diff(np.append(cut, len(end)))))
        reached[end[cut]] = top + np.log(np.add.reduceat(spread, cut))
    return np.where(np.diff(lattice.begin) > 0, reached[lattice.begin[1:]], 0.0)


def shortest(lattice: Arcs, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Arcs of the best paths, word after word, and where each word's begin: the tropical semiring.

    Of equal paths the one whose last pieces start first wins. The second array has one number more than there are words.
    """
    reached = np.full(len(lattice.chars) + 1, NEVER)
    came = np.zeros(len(lattice.chars) + 1, np.int64)
    first = np.zeros(len(lattice.chars) + 1, bool)
    first[lattice.begin[:-1]] = True
    for wave in _waves(lattice):
        start, end = lattice.start[wave], lattice.end[wave]
        value = np.where(first[start], 0.0, reached[start]) + weight[wave]
        cut = np.concatenate([[0], np.flatnonzero(np.diff(end)) + 1])
        top = np.maximum.reduceat(value, cut)
        group = np.repeat(np.arange(len(cut)), np.diff(np.append(cut, len(end))))
        best = np.flatnonzero(value == top[group])
        # the first of equals in each group
        keep = np.concatenate([[True], np.diff(group[best]) > 0])
        reached[end[cut]] = top
        came[end[cut]] = wave[best[keep]]
    # all words walk back together
    words, where = np.arange(len(lattice.begin) - 1), lattice.begin[1:].copy()
    live = where > lattice.begin[:-1]
    owner, used = [], []
    words, where = words[live], where[live]
    while len(words):
        arc = came[where]
        owner.append(words)
        used.append(arc)
        where = lattice.start[arc]
        live = where > lattice.begin[words]
        words, where = words[live], where[live]
    if not owner:
        return np.zeros(0, np.int64), np.zeros(len(lattice.begin), np.int64)
    owner, used = np.concatenate(owner), np.concatenate(used)
    order = np.lexsort((lattice.start[used], owner))
    return used[order], np.searchsorted(owner[order], np.arange(len(lattice.begin)))
