"""Combined deterministic automata over bytes: subset construction and minimisation of regular expressions."""

from __future__ import annotations

from re import _constants as C
from re import _parser as parser

#: States per automaton; a rule that needs more is refused rather than cut.
MOST_STATES = 60_000
ALL = frozenset(range(256))


class Nfa:
    """Edges by state: (set of bytes, next state); empty edges apart."""

    def __init__(self) -> None:
        self.edges: list[list[tuple[frozenset, int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def add(self, parsed, start: int) -> int:
        """Append what ``parsed`` matches after ``start``; returns the state at its end."""
        for op, arg in parsed:
            start = self._one(op, arg, start)
        return start

    def _one(self, op, arg, start: int) -> int:
        end = self.state()
        if op is C.LITERAL:
            self.edges[start].append((frozenset([arg]), end))
        elif op is C.IN:
            self.edges[start].append((byte_set(arg), end))
        elif op is C.ANY:
            self.edges[start].append((ALL - {10}, end))
        elif op is C.SUBPATTERN:
            self.empty[self.add(arg[3], start)].append(end)
        elif op is C.BRANCH:
            for branch in arg[1]:
                at = self.state()
                self.empty[start].append(at)
                self.empty[self.add(branch, at)].append(end)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, body = arg
            for _ in range(low):
                start = self.add(body, start)
            if high is C.MAXREPEAT:
                loop = self.state()
                self.empty[start].append(loop)
                self.empty[self.add(body, loop)].append(loop)
                self.empty[loop].append(end)
            else:
                for _ in range(high - low):
                    self.empty[start].append(end)
                    start = self.add(body, start)
                self.empty[start].append(end)
        else:
            raise ValueError(f"{op} is not regular or not supported")
        return end

    def closure(self, states) -> frozenset:
        found, todo = set(states), list(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in found:
                    found.add(x)
                    todo.append(x)
        return frozenset(found)


def byte_set(items) -> frozenset:
    chosen: set[int] = set()
    negate = False
    for op, arg in items:
        if op is C.NEGATE:
            negate = True
        elif op is C.LITERAL:
            chosen.add(arg)
        elif op is C.RANGE:
            chosen.update(range(arg[0], arg[1] + 1))
        else:
            raise ValueError(f"{op} is not supported in a set")
    return ALL - chosen if negate else frozenset(chosen)


def any_case(parsed):
    """Letters A-Z and a-z of a parsed pattern in either case."""
    out = []
    for op, arg in parsed:
        if op is C.LITERAL and chr(arg).isascii() and chr(arg).isalpha():
            out.append((C.IN, [(C.LITERAL, ord(chr(arg).lower())), (C.LITERAL, ord(chr(arg).upper()))]))
        elif op is C.SUBPATTERN:
            out.append((op, (*arg[:3], any_case(arg[3]))))
        elif op is C.BRANCH:
            out.append((op, (arg[0], [any_case(b) for b in arg[1]])))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            out.append((op, (*arg[:2], any_case(arg[2]))))
        else:
            out.append((op, arg))
    return out


def backwards(parsed):
    """The parsed pattern read from its end."""
    out = []
    for op, arg in reversed(list(parsed)):
        if op is C.SUBPATTERN:
            arg = (*arg[:3], backwards(arg[3]))
        elif op is C.BRANCH:
            arg = (arg[0], [backwards(b) for b in arg[1]])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            arg = (*arg[:2], backwards(arg[2]))
        out.append((op, arg))
    return out


def parse(pattern: str):
    return list(parser.parse(pattern.encode()))


def determinise(nfa: Nfa, starts: list[int], marks: dict[int, int], anywhere: bool) -> tuple[list[list[int]], list[int]]:
    """Subset construction: transitions and, for each state, a bit set of the rules that end there.

    ``anywhere``: a match may begin at any byte. State 0 is the start; a state
    from which nothing can follow stays as a state of its own.
    """
    begin = nfa.closure(starts)
    number, table, accepts, todo = {begin: 0}, [], [], [begin]
    while todo:
        now = todo.pop(0)
        accepts.append(sum(1 << marks[s] for s in now if s in marks))
        edges = [e for s in now for e in nfa.edges[s]]
        row, made = [], {}
        reach: list[list[int]] = [[] for _ in range(256)]
        for chosen, to in edges:
            for b in chosen:
                reach[b].append(to)
        for b in range(256):
            key = frozenset(reach[b])
            if key not in made:
                made[key] = nfa.closure(key | begin) if anywhere else nfa.closure(key)
            to = made[key]
            if to not in number:
                if len(number) >= MOST_STATES:
                    raise ValueError(f"the rules need more than {MOST_STATES} states")
                number[to] = len(number)
                todo.append(to)
            row.append(number[to])
        table.append(row)
    return table, accepts


def minimise(table: list[list[int]], accepts: list[int]) -> tuple[list[list[int]], list[int]]:
    """Merge states that no input tells apart, by refining classes until they are stable; the start stays 0."""
    kinds: dict = {}
    of = [kinds.setdefault(a, len(kinds)) for a in accepts]
    count = len(kinds)
    while True:
        seen: dict = {}
        of = [seen.setdefault((of[s], tuple([of[t] for t in row])), len(seen)) for s, row in enumerate(table)]
        if len(seen) == count:
            break
        count = len(seen)
    small: list = [None] * count
    ends = [0] * count
    for s, row in enumerate(table):
        small[of[s]] = [of[t] for t in row]
        ends[of[s]] = accepts[s]
    return small, ends


class Automaton:
    """Transition array of a set of rules: ``table[state | byte]``, states being multiples of 256.

    Plain states come first, so ``state >= first_end`` says that some rule ends here.
    """

    def __init__(self, rules: list, anywhere: bool) -> None:
        nfa = Nfa()
        start, marks = nfa.state(), {}
        for i, rule in enumerate(rules):
            marks[nfa.add(rule, start)] = i
        table, ends = minimise(*determinise(nfa, [start], marks, anywhere))
        order = sorted(range(len(table)), key=lambda s: ends[s] > 0)
        place = {s: i for i, s in enumerate(order)}
        self.start = place[0] << 8
        self.first_end = sum(e == 0 for e in ends) << 8
        self.table = [place[t] << 8 for s in order for t in table[s]]
        self.ends = [ends[s] for s in order]
        # states that only lead back to themselves without an end
        self.dead = {place[s] << 8 for s in range(len(table)) if not ends[s] and all(t == s for t in table[s])}

    def longest(self, data: bytes, start: int) -> int:
        """End of the longest match that begins at ``start``; -1 if none does."""
        state, end = self.start, -1
        for at in range(start, len(data)):
            state = self.table[state | data[at]]
            if state >= self.first_end:
                end = at + 1
            elif state in self.dead:
                break
        return end

    def furthest_back(self, data: bytes, end: int, floor: int) -> int:
        """Smallest start, not below ``floor``, of a match that ends at ``end``, for an automaton of reversed rules."""
        state, start = self.start, -1
        for at in range(end - 1, floor - 1, -1):
            state = self.table[state | data[at]]
            if state >= self.first_end:
                start = at
            elif state in self.dead:
                break
        return start
