"""Silence of workers: each told once, in a batch and over the runs of a stream."""

import random
from datetime import datetime, timedelta

import pytest

from ferry.streaming import changes, silence
from tests.conftest import rows

BEATS = "worker_id long, seen_at timestamp_ntz"
START = datetime(2024, 1, 1)


def at(second):
    return START + timedelta(seconds=second)


def by_hand(beats, clock, limit):
    """Each gap of each worker, one by one."""
    found, width = [], timedelta(seconds=limit)
    for worker in {w for w, _ in beats}:
        times = sorted({t for w, t in beats if w == worker})
        for a, b in zip(times[:-1], times[1:]):
            if b - a > width:
                found += [(worker, "SILENT", a, a + width), (worker, "BACK", a, b)]
        if clock - times[-1] > width:
            found.append((worker, "SILENT", times[-1], times[-1] + width))
    return sorted(found)


def watch(spark, parts, folder, checkpoint, root, limit, delay=0):
    for part in parts:
        if part:
            spark.createDataFrame(part, BEATS).write.mode("append").parquet(folder)
        stream = changes.change_source(spark, folder, schema=spark.createDataFrame([], BEATS).schema)
        silence.start_silence_watch(stream, root, checkpoint, limit, delay).awaitTermination()
    return sorted(tuple(r) for r in silence.read_notices(spark, root).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_batch_stream_and_hand_agree(spark, tmp_path, seed):
    draw = random.Random(seed)
    # Gaps of exactly the limit are no silence; times before 1970 and repeated beats occur.
    beats = [(draw.randrange(5), at(draw.choice([1, 10, 60]) * draw.randrange(60))) for _ in range(80)]
    beats += [*beats[:5], (7, at(0)), (7, at(60)), (7, at(121)), (8, at(-1_800_000_000)), (8, at(-1_799_999_940))]
    beats.sort(key=lambda b: b[1])
    clock = beats[-1][1]
    expect = by_hand(beats, clock, 60)
    whole = spark.createDataFrame([*beats, (None, at(5)), (3, None)], BEATS)
    assert sorted(tuple(r) for r in silence.silence_notices(whole, clock, 60).collect()) == expect
    cuts = sorted(draw.sample(range(1, len(beats)), 2))
    parts = [beats[: cuts[0]], beats[cuts[0] : cuts[1]], beats[cuts[1] :]]
    folder, root = str(tmp_path / "beats"), str(tmp_path / "watch")
    assert watch(spark, parts, folder, str(tmp_path / "first"), root, 60) == expect
    # A checkpoint made anew reads all beats again and tells nothing new.
    assert watch(spark, [[]], folder, str(tmp_path / "second"), root, 60) == expect


def test_late_beats_and_the_delay(spark, tmp_path):
    folder = str(tmp_path / "beats")
    parts = [[(1, at(0)), (2, at(100))], [(1, at(30)), (1, at(-5))], [(2, at(300))]]
    told = watch(spark, parts, folder, str(tmp_path / "a"), str(tmp_path / "x"), 60)
    # Told too early by a clock that does not wait; the late beat ends it.
    assert told == [
        (1, "BACK", at(0), at(30)), (1, "SILENT", at(0), at(60)), (1, "SILENT", at(30), at(90)),
        (2, "BACK", at(100), at(300)), (2, "SILENT", at(100), at(160)),
    ]
    slow = watch(spark, parts, str(tmp_path / "later"), str(tmp_path / "b"), str(tmp_path / "y"), 60, delay=50)
    assert slow == [(1, "SILENT", at(30), at(90)), (2, "BACK", at(100), at(300)), (2, "SILENT", at(100), at(160))]


def test_no_beats(spark):
    assert rows(silence.silence_notices(spark.createDataFrame([], BEATS), "2024-01-01 00:00:00", 60)) == []
