"""Conversation repair against trying out all edits, and against a plain search on a table."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from ferry.llm import conversations
from ferry.llm.shared import table
from tests.conftest import SMALL

LEGAL = re.compile(r"(s?(ua)+)?\Z")
SCHEMA = "conv_id long, turn long, role string, text string"


def damage(rows):
    """(conv_id, turn, role, text) after the contract's damage, in order."""
    found = []
    for conv_id, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        found += [(turn, role, text)] * (2 if kind == 3 else 1)
    return sorted(found, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))


def faults(rows):
    seen, found = set(), []
    for _, role, text in rows:
        solid = re.sub("[ \t-\r]", "", text)
        found.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return found


def apply(rows, audit):
    """Roles and texts after the edits; an inserted or reroled row takes the role that its place asks for."""
    source, made = iter(rows), []
    for letter in audit:
        row = None if letter == "I" else next(source)
        if letter == "D":
            continue
        made.append((row[1], row[2]) if letter == "K" else (None, "" if row is None else row[2]))
    lead = 1 if made and made[0][0] is not None and made[0][0][:1] == "s" else 0
    return [(role if role is not None else ("user", "assistant")[(i - lead) % 2], text) for i, (role, text) in enumerate(made)]


def cheapest(rows):
    """The least (cost, audit) of all edits with at most two inserts between two rows."""
    found, best = faults(rows), None
    inserts = ["", "I", "II"] if len(rows) <= 3 else [""]
    for letters in itertools.product("KRD", repeat=len(rows)):
        if any(f in ("blank", "duplicate") and x != "D" for f, x in zip(found, letters)):
            continue
        cost = sum({"K": 0, "R": 1, "D": 2}[x] + 5 * (f == "truncated" and x != "D") for f, x in zip(found, letters))
        for gaps in itertools.product(inserts, repeat=len(rows) + 1):
            audit = gaps[0] + "".join(x + g for x, g in zip(letters, gaps[1:]))
            whole = (cost + 5 * audit.count("I"), audit)
            if (best is None or whole < best) and LEGAL.match("".join(r[:1] or "?" for r, _ in apply(rows, audit))):
                best = whole
    return best


def expected(rows, edits):
    found, turns = faults(rows), sorted({t for t, _, _ in rows if t is not None})
    initials = [r[:1] for _, r, _ in rows]
    repaired = "\n".join(f"{r}:{t}" for r, t in apply(rows, edits[1]))
    return (
        turns[-1] - turns[0] + 1 - len(turns) if turns else 0,
        *[found.count(f) for f in ("blank", "duplicate", "truncated")],
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        *edits,
        hashlib.sha256(repaired.encode()).hexdigest(),
    )


def by_table(rows):
    """The least (cost, audit) with texts as audits: one pass from the back, three edits and up to two inserts a row."""
    turn = {0: 2, 1: 2, 3: 2, 2: 3}
    best = {0: (0, ""), 3: (0, ""), 2: (5, "I"), 1: (10, "II")}
    for (_, role, _), fault in reversed(list(zip(rows, faults(rows)))):
        late, edited = 5 * (fault == "truncated"), {}
        for state in range(4):
            ways = [(2 + best[state][0], "D" + best[state][1])]
            if fault not in ("blank", "duplicate"):
                after = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(role[:1], {}).get(state)
                if after is not None:
                    ways.append((late + best[after][0], "K" + best[after][1]))
                ways.append((1 + late + best[turn[state]][0], "R" + best[turn[state]][1]))
            edited[state] = min(ways)
        best = edited
        for _ in range(2):
            best = {s: min(edited[s], (5 + best[turn[s]][0], "I" + best[turn[s]][1])) for s in range(4)}
    return best[0]


def report(spark, rows, schema=SCHEMA):
    found = conversations.repair_report(spark.createDataFrame(rows, schema)).collect()
    return {r.conv_id: tuple(r)[1:] for r in found}, len(found)


def grouped(rows):
    return {c: damage([r for r in rows if r[0] == c]) for c in {r[0] for r in rows}}


def test_all_edits_of_small_conversations(spark):
    dice = random.Random(5)
    roles, texts = ["system", "user", "assistant", "tool", "", None], ["Yes.", "No!", "cut", " \t", "", "é?", None]
    rows = []
    for c in range(150):
        for turn in range(dice.randint(1, 3 if c < 60 else 6)):
            rows.append((c, dice.choice([turn, turn, turn, turn * 3, None, 0]), dice.choice(roles), dice.choice(texts)))
    found, n = report(spark, rows)
    cases = grouped(rows)
    assert n == len(cases)
    for c, damaged in cases.items():
        assert found[c] == expected(damaged, cheapest(damaged)), (c, damaged)


@pytest.mark.parametrize("segment", [1, 3, 128])
def test_given_table(spark, monkeypatch, segment):
    monkeypatch.setattr(conversations, "SEGMENT", segment)
    given = table(spark, SMALL, "conversations")
    rows = [tuple(r) for r in given.select("conv_id", "turn", "role", "text").collect()]
    found, n = report(spark, rows)
    cases = grouped(rows)
    assert n == len(cases) and found == {c: expected(d, by_table(d)) for c, d in cases.items()}


def test_long_conversation_among_short_ones(spark):
    """One conversation holds most rows, over many segments and tasks, with a text of two million characters."""
    dice = random.Random(2)
    rows = [(7, t, dice.choice(["user", "assistant", "assistant", "system"]), dice.choice(["a.", "b"]) + str(t) + dice.choice([".", ""])) for t in range(3000)]
    rows += [(7, 3000, "user", "long " * 400_000 + "."), (None, None, "user", "x."), (None, 1, "assistant", "y.")]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"{c} {t}.") for c in range(100, 130) for t in range(4)]
    dice.shuffle(rows)
    found, n = report(spark, rows)
    cases = grouped(rows)
    assert n == len(cases) and found == {c: expected(d, by_table(d)) for c, d in cases.items()}


def test_weights_of_a_segment():
    at = lambda cells, start, end: cells[4 * start + end]
    rows = [("s", False, False), ("a", False, False), ("a", False, False)]
    assert at(conversations.segment_weights(rows), conversations.START, conversations.CLOSED) == (1, "KRK")
    # Where no cheaper way leads to the end state an insert is taken.
    one = conversations.segment_weights([("a", False, False)])
    assert at(one, conversations.START, conversations.CLOSED) == (5, "IK")
    assert at(one, conversations.CLOSED, conversations.START) is None


def test_empty_table_dropped_rows_and_other_columns(spark):
    assert report(spark, [])[1] == 0
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = spark.createDataFrame([(dropped, 0, "user", "x.", 1)], "conv_id long, turn long, role string, text string, copies int")
    [row] = conversations.repair_report(rows.withColumn("first", F.lit(1))).collect()
    assert tuple(row)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repeated_rows_stand_together(spark):
    rows = [(1, 0, "user", "same."), (1, 0, "user", "same."), (1, 1, "assistant", "ok."), (1, 0, "user", "other.")]
    damaged = damage(rows)
    assert report(spark, rows)[0] == {1: expected(damaged, by_table(damaged))}
