"""The progress feed over restarts and new checkpoints."""

from pyspark.sql import functions as F

from ferry.schemas import CHANGE_EVENT
from ferry.streaming import changes
from tests.conftest import rows


def test_a_new_checkpoint_does_not_go_back(spark, t, tmp_path):
    events = t.change_events.select(*[F.col(f.name).cast(f.dataType) for f in CHANGE_EVENT.fields])
    folder, feed = str(tmp_path / "events"), str(tmp_path / "feed")
    cut = events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1")

    def follow(checkpoint, files_per_batch=None):
        stream = changes.change_source(spark, folder, files_per_batch=files_per_batch)
        changes.start_progress_feed(stream, feed, str(tmp_path / checkpoint)).awaitTermination()
        return rows(changes.read_feed(spark, feed))

    cut[0].coalesce(2).write.mode("append").parquet(folder)
    follow("first")
    cut[1].coalesce(2).write.mode("append").parquet(folder)
    whole = rows(changes.change_counts(events))
    assert follow("first") == whole
    # One file of four in its first batch: lower counts, under batch numbers that start over.
    stream = changes.change_source(spark, folder, files_per_batch=1)
    query = changes.start_progress_feed(stream.where("event_id % 4 = 0"), feed, str(tmp_path / "second"))
    query.awaitTermination()
    assert rows(changes.read_feed(spark, feed)) == whole
    assert follow("third", 1) == whole
    compact = str(tmp_path / "compact")
    changes.compact_feed(spark, feed, compact)
    assert rows(changes.read_feed(spark, compact)) == whole
    assert spark.read.parquet(compact).count() == len(whole)
