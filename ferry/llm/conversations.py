"""Conversation structure repair: cheapest edits by integer weights on a graph without cycles.

One integer is the weight of a way to repair some rows: its high digits are the cost, its
low digits the letters of the audit, first letter highest, in a field of fixed width that
ends in zeros. The smaller integer is so the cheaper way, and of equal costs the one whose
audit comes first in ASCII order. Only integers are compared.

The states are what the roles so far can be followed by: nothing yet, one system row, an
open user row, a closed pair. A row range is summed up by the least weight from each state
to each state, so a long conversation is cut into segments that run in many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferry.llm.shared import stored

START, SYSTEM, OPEN, CLOSED = range(4)
#: What a user or assistant row leads to, and what a kept row does.
TURNS = {START: (OPEN, "user"), SYSTEM: (OPEN, "user"), CLOSED: (OPEN, "user"), OPEN: (CLOSED, "assistant")}
KEEPS = {"s": {START: SYSTEM}, "u": {START: OPEN, SYSTEM: OPEN, CLOSED: OPEN}, "a": {OPEN: CLOSED}}
LEGAL_PAIRS = ("su", "ua", "au")

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Audit letters as digits of three bits, in ASCII order; zero is padding.
LETTERS = " DIKR"
DIGIT = {letter: i for i, letter in enumerate(LETTERS)}
BITS = 3
#: Before a row at most two inserts pay: a third would come back to an earlier state.
INSERTS = 2
#: Rows of a segment.
SEGMENT = 128


def _letters(code: int, bits: int) -> str:
    """The audit in a field of ``bits``: digits down to the padding."""
    found = []
    while bits > 0 and code:
        bits -= BITS
        found.append(LETTERS[code >> bits])
        code &= (1 << bits) - 1
    return "".join(found)


class _Weights:
    """Weights whose audit field has room for ``letters`` letters."""

    def __init__(self, letters: int):
        self.bits = BITS * letters
        self.mask = (1 << self.bits) - 1

    def step(self, cost: int, letter: str) -> int:
        return (cost << self.bits) + (DIGIT[letter] << (self.bits - BITS))

    def later(self, weight: int) -> int:
        """The same way with its audit moved one place on, to put a letter before it."""
        return (weight >> self.bits << self.bits) + ((weight & self.mask) >> BITS)

    def read(self, weight: int) -> tuple[int, str]:
        return weight >> self.bits, _letters(weight & self.mask, self.bits)


def segment_weights(rows: list[tuple[str, bool, bool]]) -> list[tuple[int, str] | None]:
    """Cost and audit of the cheapest way through ``rows`` (initial, must go, truncated)
    from each state to each state: sixteen entries, null where there is no way."""
    w = _Weights(len(rows) * (INSERTS + 1))
    insert, delete = w.step(INSERT, "I"), w.step(DELETE, "D")
    keep = (w.step(KEEP, "K"), w.step(KEEP + TRUNCATED, "K"))
    rerole = (w.step(REROLE, "R"), w.step(REROLE + TRUNCATED, "R"))
    found: list[tuple[int, str] | None] = [None] * 16
    for end in range(4):
        best: list[int | None] = [0 if state == end else None for state in range(4)]
        for initial, must_go, truncated in reversed(rows):
            after = [None if v is None else w.later(v) for v in best]
            edited = [None if v is None else v + delete for v in after]
            if not must_go:
                kept = KEEPS.get(initial, {})
                for state in range(4):
                    ways = [edited[state]]
                    if state in kept and after[kept[state]] is not None:
                        ways.append(after[kept[state]] + keep[truncated])
                    if after[TURNS[state][0]] is not None:
                        ways.append(after[TURNS[state][0]] + rerole[truncated])
                    edited[state] = min((v for v in ways if v is not None), default=None)
            best = edited
            for _ in range(INSERTS):
                best = _least(edited, [None if best[TURNS[s][0]] is None else w.later(best[TURNS[s][0]]) + insert for s in range(4)])
        for state, weight in enumerate(best):
            found[4 * state + end] = None if weight is None else w.read(weight)
    return found


def _least(left: list[int | None], right: list[int | None]) -> list[int | None]:
    return [b if a is None else a if b is None else min(a, b) for a, b in zip(left, right)]


class _Suffix:
    """Least weights from each state to the end, grown segment by segment from the back."""

    def __init__(self):
        w = _Weights(INSERTS)
        self.bits = w.bits
        one = w.step(INSERT, "I")
        self.best: list[int | None] = [0, w.later(one) + one, one, 0]

    def put_before(self, cells: list[tuple[int, str] | None], rows: int) -> None:
        bits = self.bits + BITS * rows * (INSERTS + 1)
        wider = [None if v is None else (v >> self.bits, (v & ((1 << self.bits) - 1)) << (bits - self.bits)) for v in self.best]
        best: list[int | None] = [None] * 4
        for state in range(4):
            for end in range(4):
                cell, rest = cells[4 * state + end], wider[end]
                if cell is None or rest is None:
                    continue
                cost, audit = cell
                room = BITS * len(audit)
                code = 0
                for letter in audit:
                    code = code << BITS | DIGIT[letter]
                weight = ((cost + rest[0]) << bits) + (code << (bits - room)) + (rest[1] >> room)
                best[state] = weight if best[state] is None else min(best[state], weight)
        self.best, self.bits = best, bits

    def read(self) -> tuple[int, str]:
        weight = self.best[START]
        return weight >> self.bits, _letters(weight & ((1 << self.bits) - 1), self.bits)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows after the contract's damage, by the crc32 of
    ``conv_id:turn`` modulo 20. A dropped row has no copies. Nulls are one space, in that
    key as well as in role and text."""
    or_space = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(or_space(F.col("conv_id")), F.lit(":"), or_space(F.col("turn"))).cast("binary")) % 20
    text, role = or_space(F.col("text")), or_space(F.col("role"))
    return conversations.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def _mark(text: Column) -> Column:
    """Stands for the text wherever only equality and a fixed order are asked for."""
    return F.unhex(F.sha2(text, 256))


def _facts(rows: DataFrame) -> DataFrame:
    """Distinct rows with the number of their copies, without texts: (conv_id, turn, role,
    mark, copies, blank, truncated, first). ``first``: role and text were not seen earlier."""
    last = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\f\r")), -1, 1)
    facts = rows.where(F.col("copies") > 0).select(
        "conv_id", "turn", "role", _mark(F.col("text")).alias("mark"), "copies", (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("truncated")
    )
    whole = ["conv_id", "turn", "role", "mark", "blank", "truncated"]
    facts = stored(facts.groupBy(*whole).agg(F.sum("copies").alias("copies")), "facts")
    seen = facts.groupBy("conv_id", "role", "mark").agg(F.bool_or(F.col("turn").isNull()).alias("none"), F.min("turn").alias("least"))
    firsts = seen.select("conv_id", F.when(~F.col("none"), F.col("least")).alias("turn"), "role", "mark", F.lit(True).alias("_first")).alias("b")
    a = facts.alias("a")
    same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & F.col("a.turn").eqNullSafe(F.col("b.turn")) & (F.col("a.role") == F.col("b.role")) & (F.col("a.mark") == F.col("b.mark"))
    return a.join(firsts, same, "left").select("a.*", F.coalesce("_first", F.lit(False)).alias("first"))


class _Segment:
    """What is told of consecutive rows of one conversation."""

    def __init__(self, conv_id):
        self.conv_id, self.rows, self.initials, self.turns = conv_id, [], [], []
        self.counts = [0, 0, 0]

    def add(self, turn, role: str, fault: int | None) -> None:
        self.rows.append((role[:1], fault in (0, 1), fault == 2))
        self.initials.append(role[:1])
        self.turns.append(turn)
        if fault is not None:
            self.counts[fault] += 1

    def record(self, part: int, place: int) -> tuple:
        cells = segment_weights(self.rows)
        dated = [t for t in self.turns if t is not None]
        illegal = sum(a + b not in LEGAL_PAIRS for a, b in zip(self.initials, self.initials[1:]))
        return (
            self.conv_id, part, place, len(self.rows), *self.counts, illegal, self.initials[0], self.initials[-1],
            dated[0] if dated else None, dated[-1] if dated else None, len(set(dated)),
            [c and c[0] for c in cells], [c and c[1] for c in cells],
        )


def _segments(facts: DataFrame) -> DataFrame:
    """Segments of all conversations, in order of (part, place). Rows are dealt by range, so
    that a conversation of any length spreads over tasks."""
    conv, turn = facts.schema["conv_id"].dataType, facts.schema["turn"].dataType
    long, text = T.LongType(), T.StringType()
    fields = {"conv_id": conv, "part": long, "place": long, "rows": long, "blank": long, "duplicate": long, "truncated": long, "illegal": long}
    fields |= {"first_initial": text, "last_initial": text, "first_turn": turn, "last_turn": turn, "turns": long}
    fields |= {"costs": T.ArrayType(long), "audits": T.ArrayType(text)}
    schema = T.StructType([T.StructField(n, t) for n, t in fields.items()])
    order = ["conv_id", "turn", "role", "mark"]
    names = ["conv_id", "turn", "role", "copies", "blank", "truncated", "first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, now, done = TaskContext.get().partitionId(), 0, None, []
        for batch in batches:
            for conv_id, turn, role, copies, blank, truncated, first in zip(*[batch.column(n).to_pylist() for n in names]):
                for copy in range(copies):
                    if now is not None and (now.conv_id != conv_id or len(now.rows) == SEGMENT):
                        done.append(now.record(part, place))
                        now, place = None, place + 1
                    now = now or _Segment(conv_id)
                    now.add(turn, role, 0 if blank else 1 if copy or not first else 2 if truncated else None)
                    if len(done) >= 500:
                        yield _batch(done, fields)
                        done = []
        if now is not None:
            done.append(now.record(part, place))
        if done:
            yield _batch(done, fields)

    return facts.repartitionByRange(*order).sortWithinPartitions(*order).select(*names).mapInArrow(run, schema)


def _batch(records: list[tuple], fields: dict[str, T.DataType]) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_type

    columns = [pa.array(values, to_arrow_type(kind)) for values, kind in zip(zip(*records), fields.values())]
    return pa.RecordBatch.from_arrays(columns, names=list(fields))


def _grouped(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(n).to_pylist() for n in names])


def _composed(segments: DataFrame) -> DataFrame:
    """One row for each conversation: its counts, and the cost and audit of its repair. The
    segments come last first; a task keeps four weights."""
    conv, long = segments.schema["conv_id"].dataType, T.LongType()
    names = segments.columns
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    fields = {"conv_id": conv} | {n: long for n in counts} | {"audit": T.StringType()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, done = None, []
        for row in _grouped(batches, names):
            r = dict(zip(names, row))
            if at is None or at["conv_id"] != r["conv_id"]:
                if at is not None:
                    done.append(_told(at))
                at = r | {"suffix": _Suffix()}
            else:
                at["illegal"] += r["illegal"] + (r["last_initial"] + at["first_initial"] not in LEGAL_PAIRS)
                at["turns"] += r["turns"] - (r["last_turn"] is not None and r["last_turn"] == at["first_turn"])
                at["first_initial"] = r["first_initial"]
                at["first_turn"] = at["first_turn"] if r["first_turn"] is None else r["first_turn"]
                for n in ("blank", "duplicate", "truncated"):
                    at[n] += r[n]
            at["suffix"].put_before([None if c is None else (c, a) for c, a in zip(r["costs"], r["audits"])], r["rows"])
            if len(done) >= 500:
                yield _batch(done, fields)
                done = []
        if at is not None:
            done.append(_told(at))
        if done:
            yield _batch(done, fields)

    dealt = segments.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("place"))
    return dealt.mapInArrow(run, T.StructType([T.StructField(n, t) for n, t in fields.items()]))


def _told(at: dict) -> tuple:
    gaps = 0 if at["last_turn"] is None else at["last_turn"] - at["first_turn"] + 1 - at["turns"]
    return (at["conv_id"], gaps, at["blank"], at["duplicate"], at["truncated"], at["illegal"], *at["suffix"].read())


def repaired_rows(rows: Iterator[tuple[str, str]], audit: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired conversation, from its damaged rows and the audit."""
    state = START
    for letter in audit:
        role, text = (None, "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter == "K":
            state = KEEPS[role[:1]][state]
        else:
            state, role = TURNS[state]
        yield role, text


def repair(rows: DataFrame) -> DataFrame:
    """Repairs the conversations of ``rows`` (conv_id, turn, role, text, copies).

    One row for each conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256. Rows are taken by turn, nulls first; rows of one turn by role and then
    by the sha256 of the text, so that repeated rows stand together. A null conv_id is one
    conversation; role and text must not be null. A row without copies counts for nothing
    but its conv_id. An empty role is no legal role. No rows: no conversations. Very long
    texts are read whole, one at a time; other columns are not read.

    The hash takes the texts of a conversation in order, so one task streams them; it
    keeps the audit and one text at a time.
    """
    conv, long = rows.schema["conv_id"].dataType, T.LongType()
    facts = _facts(rows)
    told = _composed(stored(_segments(facts), "segments"))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    fields = {"conv_id": conv} | {n: long for n in counts} | {"audit": T.StringType(), "repaired_sha256": T.StringType()}
    heads = told.withColumn("_head", F.lit(True))
    body = rows.select("conv_id", "turn", "role", "text", "copies", F.lit(False).alias("_head"), F.when(F.col("copies") > 0, _mark(F.col("text"))).alias("_mark"))
    body = body.withColumn("text", F.when(F.col("copies") > 0, F.col("text")))
    both = heads.unionByName(body, allowMissingColumns=True)
    names = ["conv_id", "_head", *counts, "audit", "role", "text", "copies"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = []
        stream = _grouped(batches, names)
        row = next(stream, None)
        while row is not None:
            conv_id, head = row[0], row[1:9] if row[1] else (False, *[0] * 6, "")

            def copies():
                nonlocal row
                while row is not None and row[0] == conv_id:
                    if not row[1]:
                        for _ in range(row[11]):
                            yield row[9], row[10]
                    row = next(stream, None)

            if row[1]:
                row = next(stream, None)
            rest = copies()
            digest, joint = hashlib.sha256(), b""
            for role, text in repaired_rows(rest, head[7]):
                digest.update(joint + role.encode() + b":" + text.encode())
                joint = b"\n"
            for _ in rest:
                pass
            done.append((conv_id, *head[1:8], digest.hexdigest()))
            if len(done) >= 500:
                yield _batch(done, fields)
                done = []
        if done:
            yield _batch(done, fields)

    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("_head"), "turn", "role", "_mark").select(*names)
    return dealt.mapInArrow(run, T.StructType([T.StructField(n, t) for n, t in fields.items()]))


def repair_report(conversations: DataFrame) -> DataFrame:
    return repair(damaged(conversations))
