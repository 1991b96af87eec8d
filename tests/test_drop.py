"""Streams over dropped files: no file, and so no task, grows with the events."""

from pyspark.sql import functions as F

from ferry.queries import replicating
from ferry.sources import target as store
from tests.conftest import rows


def test_more_events_make_more_files_not_larger_ones(spark, t, monkeypatch):
    monkeypatch.setattr(replicating, "EVENTS_PER_FILE", 100, raising=False)
    seen, whole = [], rows(replicating.cdc_apply(t))
    source = replicating.changes.change_source
    monkeypatch.setattr(replicating.changes, "change_source", lambda s, folder, **how: seen.append(folder) or source(s, folder, **how))
    for query in (replicating.cdc_apply, replicating.cdc_source, replicating.progress_feed):
        query(t)
    total = t.change_events.count()
    assert len(seen) == 3
    for folder in seen:
        written = spark.read.parquet(folder)
        sizes = [r["count"] for r in written.groupBy(F.input_file_name()).count().collect()]
        assert sum(sizes) == total and max(sizes) <= 200
    # Still two batches, and nothing lost: as from files that hold all events.
    roots = []
    begun = replicating.changes.start_apply
    monkeypatch.setattr(replicating.changes, "start_apply", lambda stream, root, *how: roots.append(root) or begun(stream, root, *how))
    monkeypatch.setattr(replicating, "EVENTS_PER_FILE", 10**9)
    assert rows(replicating.cdc_apply(t)) == whole
    monkeypatch.setattr(replicating, "EVENTS_PER_FILE", 100)
    assert rows(replicating.cdc_apply(t)) == whole
    for root in roots:
        assert [b.rsplit("-", 1)[1] for _, b in store.versions(spark, root)] == ["load", "0", "1"]
