from pyspark.sql import functions as F

from ferry.operators import approval, explore, metrics, notify, verify
from tests.conftest import rows


def test_table_equals_itself(t):
    found = rows(verify.diff_tables(t.orders, t.orders, ["o_orderkey"]).groupBy("diff_status").count())
    assert found == [("MATCH", t.orders.count())]
    assert verify.diff_keyless(t.lineitem, t.lineitem).count() == 0


def test_checksum_ignores_row_order_and_sees_one_cell(t):
    one = verify.table_checksum(t.orders).first()
    assert verify.table_checksum(t.orders.orderBy(F.rand(1)).repartition(7)).first() == one
    changed = t.orders.withColumn("o_custkey", F.when(F.col("o_orderkey") == 3, -1).otherwise(F.col("o_custkey")))
    other = verify.table_checksum(changed).first()
    assert other.row_count == one.row_count and other.checksum != one.checksum
    assert verify.fast_checksum(t.orders).first() == verify.fast_checksum(t.orders.repartition(5)).first()


def test_checksum_of_chunks_adds_up(t):
    whole = verify.table_checksum(t.orders).first()
    parts = verify.table_checksum(t.orders.withColumn("c", F.col("o_orderkey") % 7), ["c"], t.orders.columns).collect()
    summed = [sum(map(int, column)) for column in zip(*[p.checksum.split("-") for p in parts], strict=True)]
    assert summed == list(map(int, whole.checksum.split("-"))) and len(summed) == 4
    assert sum(p.row_count for p in parts) == whole.row_count


def test_row_text_cannot_be_spelled_two_ways(spark):
    df = spark.createDataFrame([("a|1:b", "c"), ("a", "1:b|c"), (None, "-"), ("-", None), ("", None), (None, None)], "x string, y string")
    assert df.select(verify.row_text(df).alias("r")).distinct().count() == 6


def test_checksum_of_nothing(spark):
    row = verify.table_checksum(spark.createDataFrame([], "a int")).first()
    assert (row.row_count, row.checksum) == (0, "0-0-0-0")


def test_diff_sees_nulls_and_names_columns(spark):
    schema = "k int, a string, b double"
    left = spark.createDataFrame([(1, "x", 1.0), (2, None, 2.0), (3, None, None), (4, "x", 1.0)], schema)
    right = spark.createDataFrame([(1, "y", 1.5), (2, "", 2.0), (3, None, None), (5, "x", 1.0)], schema)
    assert rows(verify.diff_tables(left, right, ["k"])) == [
        (1, "CHANGED", "a,b"), (2, "CHANGED", "a"), (3, "MATCH", ""), (4, "MISSING_IN_TARGET", ""), (5, "EXTRA_IN_TARGET", ""),
    ]


def test_null_keys_and_groups_are_matched(spark):
    left = spark.createDataFrame([(None, 1), (1, 1)], "k int, v int")
    assert rows(verify.diff_tables(left, left, ["k"])) == [(None, "MATCH", ""), (1, "MATCH", "")]
    assert rows(verify.compare_row_counts(left, left, ["k"]), "k", "mismatch") == [(None, False), (1, False)]


def test_sort_puts_nulls_last_both_ways(spark):
    df = spark.createDataFrame([(1, None), (2, "b"), (3, "a")], "id int, v string")
    assert [r.id for r in explore.sort_nulls_last(df, "v").collect()] == [3, 2, 1]
    assert [r.id for r in explore.sort_nulls_last(df, "v", descending=True).collect()] == [2, 3, 1]


def test_keyset_page_continues_the_offset_page(t):
    order = [F.col("occurred_at").desc(), F.col("audit_id").desc()]
    audit = t.audit.select("audit_id", "occurred_at")
    first = explore.page_rows(audit, order, 50, 0).collect()
    second = explore.page_rows(audit, order, 50, 50).collect()
    last = (first[-1].occurred_at, first[-1].audit_id)
    assert explore.page_after(audit, "occurred_at", "audit_id", last, 50).collect() == second


def test_blank_filters_and_searches_keep_all(t):
    assert explore.filter_equals(t.audit, severity="", event_type=None).count() == t.audit.count()
    assert explore.search_any_column(t.jobs, "  ").count() == t.jobs.count()


def test_health_score(spark):
    jobs = spark.createDataFrame([("COMPLETED",)] * 5 + [("RUNNING",)] + [("PENDING",)] * 4, "status string")
    row = metrics.health_score(jobs).first()
    assert (row.health_score, row.success_rate) == (80, 50)
    empty = metrics.health_score(jobs.limit(0), api_healthy=False).first()
    assert (empty.health_score, empty.success_rate) == (20, 0)


def test_bulk_approval_by_risk(spark):
    drift = spark.createDataFrame([(i, 1, r, "DETECTED") for i, r in enumerate(["SAFE", "MODERATE", "HIGH", "CRITICAL", "ODD"])], "event_id int, migration_id int, risk_level string, status string")
    assert [r.risk_level for r in approval.bulk_approve_by_risk(drift, "MODERATE", "x").orderBy("event_id").collect()] == ["SAFE", "MODERATE"]
    assert approval.bulk_approve_by_risk(drift, "CRITICAL", "x").count() == 4


def test_fan_out_by_brute_force(spark):
    alerts = spark.createDataFrame([(1, "MIGRATION_FAILED"), (2, "WORKER_FAILURE")], "alert int, event_type string")
    subs = spark.createDataFrame(
        [(1, "EMAIL", True, "[]"), (2, "SLACK", True, '["MIGRATION_FAILED","MIGRATION_FAILED"]'), (3, "EMAIL", False, "[]"), (4, "EMAIL", True, None), (5, "EMAIL", True, '["LAMBDA_FAILED"]')],
        "config_id int, notification_type string, enabled boolean, subscribed_events string",
    )
    assert rows(notify.fan_out(alerts, subs), "config_id", "alert") == [(1, 1), (1, 2), (2, 1), (4, 1), (4, 2)]
    assert "CartesianProduct" not in notify.fan_out(alerts, subs)._jdf.queryExecution().toString()


def test_throughput_keeps_zero_days(spark):
    jobs = spark.createDataFrame([("COMPLETED", "2024-01-05 10:00:00", "2024-01-06 10:00:00"), ("FAILED", "2024-01-01 00:00:00", "2024-01-07 23:59:59")], "status string, created_at string, completed_at string")
    jobs = jobs.select("status", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("created_at", "completed_at")])
    found = rows(metrics.daily_throughput(jobs, "2024-01-08 12:00:00"), "started", "completed", "failed", "day")
    assert len(found) == 7 and sum(r[0] for r in found) == 1 and sum(r[1] for r in found) == 1 and sum(r[2] for r in found) == 1


def test_fast_checksum_tells_repeated_rows_apart(spark):
    a, b = (spark.createDataFrame([(v,) for v in rows], "v string") for rows in ("AAB", "CCB"))
    assert verify.fast_checksum(a).first() != verify.fast_checksum(b).first()


def test_nested_values_count_with_what_they_hold(spark):
    df = spark.sql("select array(1.0d, 2.0d) as a, named_struct('x', 'abc', 'y', 1) as s, map('k', array(1, 2)) as m, array('ab', null) as t, cast(null as array<int>) as n")
    assert verify.size_estimate({"t": df}, 10).first().estimated_bytes == 16 + 7 + 9 + 2


def test_checksum_sees_every_bit_of_a_double(spark):
    values = [1.001, 1.004, 0.1, 0.1 + 2**-56, 1e-30, 2e-30, -1e-30, 5e-324, 1e300, 2.0**53, 2.0**53 + 2, float("nan"), float("inf"), None, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert df.select(verify.row_text(df).alias("r")).distinct().count() == len(values)
    one, other = df.where("v = 1.001"), df.where("v = 1.004")
    assert verify.diff_keyless(one, other).count() == 2 and verify.table_checksum(one).first() != verify.table_checksum(other).first()


def test_nested_values_are_told_apart(spark):
    lists = spark.createDataFrame([(v,) for v in (["a, b"], ["a", "b"], [None], ["null"], [], None, ["-"], ["a|1:b"])], "v array<string>")
    assert lists.select(verify.row_text(lists).alias("r")).distinct().count() == 8
    left = spark.sql("select 1 as k, map('a', 1, 'b', 2) as m, named_struct('x', 1.5d) as s")
    same = spark.sql("select 1 as k, map('b', 2, 'a', 1) as m, named_struct('x', 1.5d) as s")
    other = spark.sql("select 1 as k, map('b', 3, 'a', 1) as m, named_struct('x', 1.5d) as s")
    assert verify.table_checksum(left).first() == verify.table_checksum(same).first()
    assert rows(verify.diff_tables(left, same, ["k"])) == [(1, "MATCH", "")]
    assert rows(verify.diff_tables(left, other, ["k"])) == [(1, "CHANGED", "m")]


def test_row_text_by_projections_spells_the_same(spark):
    import random

    dice = random.Random(1)
    odd = [0.0, -0.0, 1.5, -2.25, 1e-320, 5e-324, 1e300, -1e22, 2.0**53, 2.0**53 - 0.5, 0.1, 1 / 3, 123456.789, float("nan"), float("inf"), float("-inf"), None]
    data = [(v, f"t|{i}", i if i % 3 else None) for i, v in enumerate(odd + [dice.uniform(-1, 1) * 10 ** dice.randint(-40, 40) for _ in range(300)])]
    df = spark.createDataFrame(data, "d double, `a b` string, n int").withColumn("f", F.col("d").cast("float")).withColumn("l", F.array("d", "f"))
    both = verify.with_row_text(df.withColumn("_plain", verify.row_text(df)), "_text", df.columns)
    assert both.where(~F.col("_plain").eqNullSafe(F.col("_text"))).count() == 0
