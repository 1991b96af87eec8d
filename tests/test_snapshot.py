"""A load woven into the change log: any order of spans and changes gives one result."""

import random

import pytest
from pyspark.sql import functions as F

from ferry.plans.copy import CopyPlan, ranged_plan, read_held
from ferry.schemas import CHANGE_EVENT
from ferry.session import fresh_dir
from ferry.sources import target
from ferry.streaming import changes, snapshot
from tests.conftest import rows

ROW = "id bigint, value double, k int"
AT = "2024-01-01 00:00:00"


def history(seed, keys=12, length=40):
    """Events on a table of these keys, and the table after each of them: moves of a row
    to another key, deletes and new rows among them."""
    draw = random.Random(seed)
    state = {i: (float(i), 0) for i in range(0, keys, 2)}
    found, states = [], [dict(state)]
    for n in range(1, length + 1):
        key, free = draw.randrange(keys), [i for i in range(keys) if i not in state]
        image = lambda k, n=n: f'{{"id":{k},"value":{n},"k":{n}}}'
        if key not in state:
            operation, before, after = "INSERT", None, key
        elif draw.random() < 0.3:
            operation, before, after = "DELETE", key, None
        else:
            operation, before, after = "UPDATE", key, draw.choice(free) if free and draw.random() < 0.4 else key
        if before is not None:
            del state[before]
        if after is not None:
            state[after] = (float(n), n)
        old = None if before is None else f'{{"id":{before}}}'
        new = None if after is None else image(after)
        found.append((n, 1, operation, "t", f"{n // 16:X}/{n % 16:X}", None, old, new, "PENDING", 0, None, None))
        states.append(dict(state))
    return found, states


def table(spark, state):
    return spark.createDataFrame([(k, v, n) for k, (v, n) in state.items()], ROW)


@pytest.mark.parametrize("seed", [1, 3])
def test_any_interleaving_gives_the_table_at_the_end(spark, seed):
    found, states = history(seed)
    draw = random.Random(seed + 100)
    load, into = fresh_dir(spark, "load"), fresh_dir(spark, "replica")
    plan = CopyPlan(1, "t", "id", 2)
    spans = snapshot.key_spans(table(spark, states[0]), plan, 3)
    left = found[:]
    draw.shuffle(left)
    low = 0
    for i, span in enumerate(spans):
        # The span is read at some moment after its mark was noted.
        low = draw.randint(low, len(found))
        read = draw.randint(low, len(found))
        mark = found[low - 1][4] if low else None
        snapshot.load_span(spark, table(spark, states[read]), load, plan, span, mark, AT)
        if draw.random() < 0.6:
            snapshot.apply_load(spark, load, into, ["id"], f"load-{i}", buckets=2)
        # Any changes may have arrived by now, in any order.
        batch, left = left[:10], left[10:]
        changes.apply_changes(spark, into, spark.createDataFrame(batch, CHANGE_EVENT), ROW, "id", f"c{i}", buckets=2)
    snapshot.apply_load(spark, load, into, ["id"], "load-all", buckets=2)
    changes.apply_changes(spark, into, spark.createDataFrame(left or found[:1], CHANGE_EVENT), ROW, "id", "rest", buckets=2)
    assert rows(target.read_target(spark, into)) == rows(table(spark, states[-1]))


def test_a_second_run_keeps_complete_chunks_and_their_marks(spark):
    plan, load = CopyPlan(1, "t", "id", 10), fresh_dir(spark, "load")
    first = spark.range(0, 40).select("id", F.lit(1.0).alias("value"), F.lit(1).alias("k"))
    told = iter(["0/1", "0/2", "0/3", "0/4"])
    seen = []
    spans = snapshot.key_spans(first, plan, 2)
    assert spans == [(None, 19), (20, None)]
    snapshot.load_spans(spark, first, load, plan, spans[:1], lambda: next(told), AT, seen.append)
    later = spark.range(-5, 60).select("id", F.lit(2.0).alias("value"), F.lit(2).alias("k"))
    snapshot.load_spans(spark, later, load, plan, spans, lambda: next(told), AT, seen.append)
    got = snapshot.loaded_rows(spark, load).groupBy("value", "_lsn").agg(F.min("id"), F.max("id"), F.count("*"))
    base = -(2**63)
    # Chunks 0 and 10 are those of the first run; keys beyond both old ends are loaded too.
    assert rows(got.selectExpr("value", "_lsn - (%d)" % base, "`min(id)`", "`max(id)`", "`count(1)`")) == [(1.0, 1, 0, 19, 20), (2.0, 2, -5, -1, 5), (2.0, 3, 20, 59, 40)]
    assert seen == [spans[0], *spans]


def test_text_keys_null_keys_and_an_empty_table(spark):
    source = spark.createDataFrame([(f"k{i:02}", i) for i in range(30)] + [(None, 99)], "name string, n int")
    load, into = fresh_dir(spark, "load"), fresh_dir(spark, "replica")
    plan = ranged_plan(spark, source, load, CopyPlan(1, "t", "name", 1, keys=("name",)), chunks=5)
    spans = snapshot.key_spans(source, plan, 3)
    snapshot.load_spans(spark, source, load, plan, spans, lambda: None, AT)
    snapshot.apply_load(spark, load, into, ["name"], "load")
    assert rows(target.read_target(spark, into)) == [(f"k{i:02}", i) for i in range(30)]
    assert rows(read_held(spark, load), "n") == [(99,)]
    empty = spark.createDataFrame([], ROW)
    assert snapshot.key_spans(empty, CopyPlan(1, "t", "id", 5), 3) == [(None, None)]
    assert snapshot.last_position(spark.createDataFrame([], CHANGE_EVENT)) is None
