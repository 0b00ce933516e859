"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marketloom.llm import repair
from marketloom.llm.queries import LLM_QUERIES

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
BLOCKS = repair.Blocks()


def cheapest(turns):
    """Least (cost, audit, repaired turns) of turns (role, text, fault); the grammar is a regular expression."""
    grammar = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}

    # inserts: relax up to three in a row at every place, from the end
    table = {}
    for i in range(len(turns), -1, -1):
        for state in range(4):
            options = []
            if i == len(turns) and state in (0, 3):
                options.append((0, "", ()))
            if i < len(turns):
                role, text, fault = turns[i]
                extra = 3 if fault == "truncated" else 0
                steps = [("D", 4, state, ())]
                if fault not in ("blank", "duplicate"):
                    if role[:1] in grammar[state]:
                        steps.append(("K", extra, grammar[state][role[:1]], (f"{role}:{text}",)))
                    steps += [("R", 3 + extra, grammar[state][n[0]], (f"{n}:{text}",)) for n in ("user", "assistant") if n[0] in grammar[state]]
                for letter, cost, after, line in steps:
                    rest = table[i + 1, after]
                    options.append((cost + rest[0], letter + rest[1], line + rest[2]))
            table[i, state] = min(options, key=lambda o: o[:2], default=(10**9, "", ()))
        for _ in range(4):
            for state in range(4):
                for name in ("user", "assistant"):
                    if name[0] in grammar[state]:
                        rest = table[i, grammar[state][name[0]]]
                        new = (3 + rest[0], "I" + rest[1], (f"{name}:",) + rest[2])
                        if new[:2] < table[i, state][:2]:
                            table[i, state] = new
    return table[0, 0]


def judged(turns):
    seen, out = set(), []
    for role, text in turns:
        shown = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def expected(rows):
    """The contract by hand, from (conv_id, turn, role, text)."""
    conversations = {}
    for conv_id, turn, role, text in rows:
        kept = conversations.setdefault(conv_id, [])
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv_id, kept in conversations.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        turns = judged([r[1:] for r in kept])
        known = [r[0] for r in kept if r[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        roles = [r[0][:1] for r in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
        cost, audit, lines = cheapest(tuple(turns))
        count = [sum(t[2] == f for t in turns) for f in ("blank", "duplicate", "truncated")]
        out.append((conv_id, gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def collected(df):
    return sorted([tuple(r[c] for c in COLUMNS) for r in df.collect()], key=str)


turn = st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "u"]), st.sampled_from(["Yes.", "No", "", "Why?", " \n", "x."]))


@settings(max_examples=400, deadline=None)
@given(st.lists(turn, max_size=25))
def test_tables_find_the_cheapest_and_least_edits(turns):
    faulty = judged(turns)
    symbols = bytes(
        repair.MUST_GO if f in ("blank", "duplicate") else 2 * ("sua".find(r[0]) if r and r[0] in "sua" else 3) + (f == "truncated")
        for r, _, f in faulty
    )
    cost, parts = BLOCKS.repair(symbols)
    assert (cost, "".join(p[2] for p in parts)) == cheapest(tuple(faulty))[:2]


def test_a_table_has_every_block():
    assert BLOCKS.after.shape == (len(BLOCKS.vectors), repair.SYMBOLS**repair.BLOCK)
    assert len(BLOCKS.vectors) < 200 and all(min(v) == 0 for v in BLOCKS.vectors)


def test_query_is_the_plain_search(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert collected(LLM_QUERIES["op13_repair_conversations"](spark, FOLDER)) == expected(rows)


def made(seed, conversations=40, turns=60):
    chosen = random.Random(seed)
    rows = []
    for _ in range(conversations * 10):
        rows.append(
            (chosen.choice([None, *range(conversations)]), chosen.choice([None, *range(turns)]),
             chosen.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]),
             chosen.choice(["Yes.", "No", "", None, "Why?", "  ", "On and on. And on", f"{chosen.random()}."]))
        )
    return rows + rows[::7]


@pytest.mark.parametrize("part", [1 << 16, 8, 1])
def test_nulls_ties_copies_and_many_parts(spark, monkeypatch, part):
    monkeypatch.setattr(repair, "PART", part)
    rows = made(part) + [(1, t, "user" if t % 2 else "assistant", f"turn {t % 50}.") for t in range(300)]
    turns = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], "conv_id bigint, turn bigint, role string, text string, position int, copies string")
    assert collected(repair.digest(*repair.repair(repair.damage(turns), turns))) == expected(rows)


def test_empty_table_and_turns_that_are_all_dropped(spark):
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    turns = spark.createDataFrame([(dropped, 0, "user", "Hi.")], "conv_id bigint, turn bigint, role string, text string")
    assert collected(repair.digest(*repair.repair(repair.damage(turns), turns))) == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    none = turns.limit(0)
    summary, repaired = repair.repair(none)
    assert summary.count() == 0 and repaired.count() == 0


def test_repaired_turns_are_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "user", "Well?"), (1, 3, "assistant", "Yes.")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    summary, repaired = repair.repair(turns)
    assert [(r.cost, r.audit) for r in summary.collect()] == [(7, "KDIKK")]
    assert [tuple(r) for r in repaired.orderBy("position").collect()] == [
        (1, 0, "user", "Hi."), (1, 1, "assistant", ""), (1, 2, "user", "Well?"), (1, 3, "assistant", "Yes.")]
