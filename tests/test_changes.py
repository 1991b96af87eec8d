import random

import pytest
from pyspark.sql import functions as F, types as T

from ferry.functions import convert
from ferry.operators import drift
from ferry.schemas import CHANGE_EVENT
from ferry.session import fresh_dir
from ferry.sources import files, sinks, tables, target
from ferry.streaming import changes
from tests.conftest import rows

ROW = "id bigint, value double, k int"


def event(n, operation, before=None, after=None, lsn=None):
    return (n, 1, operation, "t", lsn or f"0/{n:X}", None, before, after, "PENDING", 0, None, None)


def events(spark, *found):
    return spark.createDataFrame(list(found), CHANGE_EVENT)


def state(spark, root):
    return rows(target.read_target(spark, root))


def test_any_split_of_the_batches_gives_one_result(spark, t):
    all_events = t.change_events
    whole = fresh_dir(spark, "replica")
    changes.apply_changes(spark, whole, all_events, ROW, "id", "all")
    expect = state(spark, whole)
    random.seed(5)
    numbers = list(range(0, 1000, 130))
    random.shuffle(numbers)
    parts = fresh_dir(spark, "replica")
    for low in numbers:
        part = all_events.where((F.col("event_id") >= low) & (F.col("event_id") < low + 130))
        changes.apply_changes(spark, parts, part, ROW, "id", f"p{low}")
    assert state(spark, parts) == expect


def test_applying_twice_is_applying_once(spark, t):
    root = fresh_dir(spark, "replica")
    changes.apply_changes(spark, root, t.change_events, ROW, "id", "one")
    first = state(spark, root)
    changes.apply_changes(spark, root, t.change_events, ROW, "id", "one")
    changes.apply_changes(spark, root, t.change_events, ROW, "id", "other-name")
    assert state(spark, root) == first


def test_order_is_by_number_not_text(spark):
    root = fresh_dir(spark, "replica")
    batch = events(spark, event(1, "INSERT", after='{"id":1,"value":1,"k":1}', lsn="0/9"), event(2, "UPDATE", after='{"id":1,"value":2,"k":2}', lsn="0/10"))
    changes.apply_changes(spark, root, batch, ROW, "id", "b")
    assert state(spark, root) == [(1, 2.0, 2)]


def test_update_that_moves_a_row_and_late_events(spark):
    root = fresh_dir(spark, "replica")
    changes.apply_changes(spark, root, events(spark, event(1, "INSERT", after='{"id":1,"value":1,"k":1}'), event(5, "UPDATE", '{"id":1}', '{"id":2,"value":5,"k":5}')), ROW, "id", "b1")
    assert state(spark, root) == [(2, 5.0, 5)]
    late = events(spark, event(3, "UPDATE", after='{"id":1,"value":3,"k":3}'), event(4, "INSERT", after='{"id":7,"value":4,"k":4}'))
    held = target.read_target(spark, root, control=True)
    assert rows(changes.late_changes(late, held, ROW, "id")) == [(3, "SKIPPED")]
    changes.apply_changes(spark, root, late, ROW, "id", "b2")
    assert state(spark, root) == [(2, 5.0, 5), (7, 4.0, 4)]


def test_delete_takes_the_key_from_either_image(spark):
    root = fresh_dir(spark, "replica")
    changes.apply_changes(spark, root, events(spark, *[event(i, "INSERT", after=f'{{"id":{i},"value":1,"k":1}}') for i in (1, 2, 3)]), ROW, "id", "b1")
    gone = events(spark, event(10, "DELETE", '{"id":1}'), event(11, "DELETE", None, '{"id":2}'), event(12, "DELETE"))
    changes.apply_changes(spark, root, gone, ROW, "id", "b2")
    assert state(spark, root) == [(3, 1.0, 1)]
    assert rows(changes.keyless_changes(gone, ROW, "id"), "event_id") == [(12,)]


def test_tables_have_targets_of_their_own_and_nothing_is_lost(spark):
    root = fresh_dir(spark, "replicas")
    image = '{"id":5,"value":1,"k":1}'
    found = [
        (1, 1, "INSERT", "users", "1764594785/1", None, None, image, "PENDING", 0, None, None),
        (2, 1, "INSERT", "orders", "1764594785/2", None, None, image, "PENDING", 0, None, None),
        (3, 1, "DELETE", "products", "1764594785/3", None, '{"id":5}', None, "PENDING", 0, None, None),
        (4, 1, "UPDATE", "users", "1764594785/4", None, None, '{"value":2}', "PENDING", 0, None, None),
        (5, 1, "UPDATE", "users", "1764594785/5", None, None, '{"id":5,"value":"much"}', "PENDING", 0, None, None),
        (6, 1, "UPDATE", "users", "1764594785/99999999999", None, None, image, "PENDING", 0, None, None),
        (7, 1, "UPDATE", "users", None, None, None, image, "PENDING", 0, None, None),
        (8, 1, "INSERT", None, "1/1", None, None, image, "PENDING", 0, None, None),
        (9, 1, None, "users", "1/1", None, None, '{"id":', "PENDING", 0, None, None),
    ]
    wanted = {name: (ROW, "id") for name in ("users", "orders", "products")}
    for _ in range(2):
        changes.apply_table_changes(spark, root, events(spark, *found), wanted, "b1", base=10)
    for name, expect in (("users", [(5, 1.0, 1)]), ("orders", [(5, 1.0, 1)]), ("products", [])):
        assert state(spark, changes.table_root(root, name)) == expect
    held = spark.read.parquet(f"{root}/quarantine").select("event_id", F.array_join("reasons", "; "))
    assert rows(held) == [
        (4, "no key"), (5, "after image does not fit"), (6, "bad log position"), (7, "bad log position"),
        (8, "unknown table"), (9, "unknown operation; bad after image"),
    ]


def test_a_load_with_its_position_is_not_touched_by_older_events(spark):
    load = spark.createDataFrame([(1, 9.0, 9)], ROW)
    old = events(spark, event(3, "UPDATE", after='{"id":1,"value":3,"k":3}'), event(4, "INSERT", after='{"id":2,"value":4,"k":4}'))
    root = fresh_dir(spark, "replica")
    assert rows(changes.replicate(spark, root, "FULL_LOAD_AND_CDC", load, [old], ROW, "id", load_lsn="0/8")) == [(1, 9.0, 9), (2, 4.0, 4)]


def test_fields_from_before_a_delete_do_not_return(spark):
    found = events(
        spark, event(1, "INSERT", after='{"id":1,"value":1,"k":1}'), event(2, "DELETE", '{"id":1}'),
        event(3, "INSERT", after='{"id":1,"k":3}'), event(4, "INSERT", after='{"id":2,"value":4}'), event(5, "DELETE", None, '{"id":2}'),
    )
    assert rows(changes.collapse_partial_changes(found, "id")) == [("1", "id", "1"), ("1", "k", "3")]


def test_deleted_marks_can_be_purged(spark):
    root = fresh_dir(spark, "replica")
    changes.apply_changes(spark, root, events(spark, event(1, "INSERT", after='{"id":1,"value":1,"k":1}'), event(2, "DELETE", '{"id":2}'), event(9, "DELETE", '{"id":3}')), ROW, "id", "b1")
    target.purge_deleted(spark, root, "0/5", "purge")
    assert rows(target.read_target(spark, root, control=True), "id", "_deleted") == [(1, False), (3, True)]
    assert state(spark, root) == [(1, 1.0, 1)]


def test_modes(spark, t):
    load = t.customer.selectExpr("c_custkey as id", "c_acctbal as value", "0 as k")
    only_load = changes.replicate(spark, fresh_dir(spark, "r"), "FULL_LOAD", load, [t.change_events], ROW, "id")
    assert rows(only_load) == rows(load)


def test_stream_resumes_without_loss_or_repeat(spark, t):
    folder, root, checkpoint = (fresh_dir(spark, n) for n in ("drop", "replica", "stream"))
    straight = fresh_dir(spark, "replica")
    changes.apply_changes(spark, straight, t.change_events, ROW, "id", "all")
    seen = []
    for low in (0, 400, 800):
        t.change_events.where(f"event_id >= {low} and event_id < {low + 400}").coalesce(1).write.mode("append").parquet(folder)
        stream = changes.change_source(spark, folder)
        changes.start_apply(stream, root, checkpoint, ROW, "id", on_batch=lambda b, i: seen.append(b.count())).awaitTermination()
    assert state(spark, root) == state(spark, straight)
    assert sum(seen) == t.change_events.count()


def test_a_new_checkpoint_on_an_old_target_loses_nothing(spark, t):
    root = fresh_dir(spark, "replica")
    for low in (0, 500):
        folder = fresh_dir(spark, "drop")
        t.change_events.where(f"event_id >= {low} and event_id < {low + 500}").coalesce(1).write.parquet(folder)
        changes.start_apply(changes.change_source(spark, folder), root, fresh_dir(spark, "stream"), ROW, "id").awaitTermination()
    straight = fresh_dir(spark, "replica")
    changes.apply_changes(spark, straight, t.change_events, ROW, "id", "all")
    assert state(spark, root) == state(spark, straight)


def test_a_checkpoint_made_anew_at_the_same_path_loses_nothing(spark, t):
    """Batch numbers start over with it; its batches are new ones all the same."""
    root, checkpoint, straight = fresh_dir(spark, "replica"), fresh_dir(spark, "stream"), fresh_dir(spark, "replica")
    named = {name: (ROW, "id") for name in sorted(r.table_name for r in t.change_events.select("table_name").distinct().collect())}
    unknown = t.change_events.withColumn("table_name", F.when(F.col("event_id") % 100 == 0, "elsewhere").otherwise(F.col("table_name")))
    for low in (0, 500):
        folder = fresh_dir(spark, "drop")
        unknown.where(f"event_id >= {low} and event_id < {low + 500}").coalesce(1).write.parquet(folder)
        for _ in range(2):  # a restart on the same checkpoint repeats nothing
            changes.start_apply(changes.change_source(spark, folder), root, checkpoint, tables=named).awaitTermination()
        files.discard(spark, checkpoint)
    changes.apply_table_changes(spark, straight, unknown.where("event_id < 1000"), named, "all")
    for name in named:
        assert state(spark, changes.table_root(root, name)) == state(spark, changes.table_root(straight, name))
    held = spark.read.parquet(f"{root}/quarantine")
    assert rows(held, "event_id") == rows(spark.read.parquet(f"{straight}/quarantine"), "event_id") and held.where("table_name = 'elsewhere'").count() > 1


def test_stream_stops_after_failures_in_a_row(spark, t, monkeypatch):
    folder = fresh_dir(spark, "drop")
    t.change_events.coalesce(1).write.parquet(folder)
    tries = []
    monkeypatch.setattr(changes, "apply_changes", lambda *a, **k: tries.append(1) or (_ for _ in ()).throw(RuntimeError("down")))
    query = changes.start_apply(changes.change_source(spark, folder), fresh_dir(spark, "r"), fresh_dir(spark, "s"), ROW, "id", max_errors=3, back_off=0)
    with pytest.raises(Exception, match="down"):
        query.awaitTermination()
    assert len(tries) == 3


def test_stream_dedupe_and_windows_equal_batch(spark, t):
    folder, out = fresh_dir(spark, "drop"), fresh_dir(spark, "out")
    doubled = t.change_events.unionByName(t.change_events.where("event_id % 2 = 0"))
    doubled.coalesce(1).write.parquet(folder)
    stream = changes.dedupe_changes(changes.change_source(spark, folder), "60 days")
    stream.writeStream.format("parquet").option("checkpointLocation", fresh_dir(spark, "s")).trigger(availableNow=True).start(out).awaitTermination()
    assert spark.read.parquet(out).count() == t.change_events.count()
    counted = changes.event_rate_windows(changes.change_source(spark, folder), "1 day")
    counted.writeStream.outputMode("complete").format("memory").queryName("daily").trigger(availableNow=True).start().awaitTermination()
    batch = changes.event_rate_windows(doubled, "1 day")
    assert sorted((r.operation, r.events) for r in spark.table("daily").collect()) == sorted((r.operation, r.events) for r in batch.collect())


def test_snapshot_documents_can_be_read_back(spark, t):
    documents = drift.snapshot_documents(t.columns_after, t.indexes_after, "TARGET", "2024-01-20 10:11:12")
    assert documents.first().snapshot_name == "snapshot_target_20240120_101112"
    columns, indexes = drift.read_documents(documents)
    names = ["migration_id", "table_name", "column_name", "type_text"]
    assert rows(columns, *names) == rows(drift.typed(t.columns_after), *names)
    both = t.indexes_after.join(t.columns_after.select("migration_id", "table_name").distinct(), ["migration_id", "table_name"], "left_semi")
    assert rows(indexes) == rows(both)


def test_drift_parts_equal_the_whole(t):
    before, after = drift.typed(t.columns_before), drift.typed(t.columns_after)
    parts = drift.table_drift(before, after).unionByName(drift.column_drift(before, after)).unionByName(
        drift.index_drift(t.indexes_before, t.indexes_after, t.columns_before, t.columns_after)
    )
    assert rows(drift.drift_between(before, after, t.indexes_before, t.indexes_after)) == rows(parts)
    assert drift.column_drift(before, before, strict=True).count() == 0


def test_ddl_for_both_engines(spark):
    schema = "migration_id int, table_name string, ordinal int, column_name string, column_type string, nullable boolean, primary_key boolean, max_length int, num_precision int, num_scale int, column_default string, auto_increment boolean"
    one = spark.createDataFrame([(1, "t", 2, "v", "varchar", True, False, 9, None, None, "'x'", False), (1, "t", 1, "id", "integer", False, True, None, None, None, None, True), (1, "t", 3, "n", "decimal", True, False, None, 8, 0, None, False)], schema)
    assert drift.create_table_ddl(one).first().ddl == "CREATE TABLE `t` (\n    `id` integer NOT NULL AUTO_INCREMENT PRIMARY KEY,\n    `v` varchar(9) DEFAULT 'x',\n    `n` decimal(8,0)\n)"
    assert '"id" integer NOT NULL GENERATED BY DEFAULT AS IDENTITY PRIMARY KEY' in drift.create_table_ddl(one, "POSTGRESQL").first().ddl
    assert '"id" integer GENERATED BY DEFAULT AS IDENTITY NOT NULL PRIMARY KEY' in drift.create_table_ddl(one, "ORACLE").first().ddl
    assert "CREATE TABLE [t] (\n    [id] integer NOT NULL IDENTITY(1,1) PRIMARY KEY" in drift.create_table_ddl(one, "SQL_SERVER").first().ddl


def test_same_engine_is_not_converted(t):
    assert convert.convert_columns(t.labels, {"quality": "boolean"}, "mysql", "MYSQL").schema == t.labels.schema


def test_json_text_keeps_what_is_not_json(spark):
    df = spark.createDataFrame([('{"a": 1}',), ("{no",), (None,)], "j string").select(convert.json_text(F.col("j")).alias("j"))
    assert [r.j for r in df.collect()] == ['{"a":1}', "{no", None]


def test_target_table_is_made_once(spark, t):
    path = fresh_dir(spark, "made")
    assert sinks.create_target_if_missing(spark, "made_once", t.orders.schema, path)
    assert not sinks.create_target_if_missing(spark, "made_once", t.orders.schema, path)
    spark.sql("drop table made_once")


def test_columns_come_in_catalog_order(t):
    assert tables.scan_columns(t.orders, ["o_orderdate", "o_orderkey"]).columns == ["o_orderkey", "o_orderdate"]
    with pytest.raises(ValueError):
        tables.scan_columns(t.orders, ["nope"])


def test_csv_rows_split_alike_whatever_is_selected(spark):
    folder = fresh_dir(spark, "csv")
    lines = ['a,b,c', '1,x,2', 'one,y,3', '4,z', '5,"two\nlines ""q""",', '6,w,7,8']
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(folder)
    good, bad = tables.scan_csv(spark, folder, T.StructType.fromDDL("a int, b string, c int"))
    assert rows(good) == [(1, "x", 2), (5, 'two\nlines "q"', None)]
    assert good.count() == 2 and bad.count() == 3
    assert rows(good, "b") == [('two\nlines "q"',), ("x",)] and good.select("a").count() == 2
    assert bad.select("b").count() == 3
    assert rows(bad, "_corrupt_record") == [("4,z",), ("6,w,7,8",), ("one,y,3",)]
