import pytest
from pyspark.sql import functions as F

from ferry import session
from ferry.functions import numbers
from ferry.operators import ledger, ordered, quality
from ferry.plans import chunks, copy
from ferry.session import fresh_dir
from ferry.sources import files, jdbc, target
from tests.conftest import rows


def tables(spark, **counts):
    return spark.createDataFrame(list(counts.items()), "table_name string, row_count bigint")


def test_plan_chunks(spark):
    found = rows(chunks.plan_chunks(tables(spark, big=25000, none=0, few=500), F.lit(7)), "table_name", "chunk_id", "start_row", "end_row", "estimated_rows")
    big = [r for r in found if r[0] == "big"]
    assert len(big) == 10 and ("big", "7-big-9", 22500, 24999, 2500) in big
    assert ("none", "7-none-0", 0, 0, 0) in found
    assert ("few", "7-few-0", 0, 499, 500) in found


def test_plan_chunks_fixed(spark):
    found = rows(chunks.plan_chunks_fixed(tables(spark, a=2500, none=0), F.lit(1), 1000), "row_offset", "row_limit")
    assert found == [(0, 1000), (1000, 1000), (2000, 500)]
    many = chunks.plan_chunks_fixed(tables(spark, a=25_001), F.lit(1), 1)
    assert (many.count(), many.agg(F.sum("row_limit")).first()[0]) == (25_001, 25_001)


@pytest.mark.parametrize("asked, size", [(None, 10000), (0, 10000), (99999, 50000), (-5, 1), (1234, 1234)])
def test_fixed_size_clamp(spark, asked, size):
    df = spark.createDataFrame([(asked,)], "n bigint")
    assert df.select(numbers.fixed_chunk_rows(F.col("n"))).first()[0] == size


@pytest.mark.parametrize("lsn, base, number", [("16/B374D848", 16, 97500059720), ("0/10", 16, 16), ("0/9", 16, 9), ("1700000000/12", 10, 1700000000 * 2**32 + 12), ("FFFFFFFF/FFFFFFFF", 16, 2**64 - 1)])
def test_lsn_number(spark, lsn, base, number):
    df = spark.createDataFrame([(lsn,)], "l string")
    row = df.select(numbers.lsn_number(F.col("l"), base), numbers.lsn_rank(F.col("l"), base)).first()
    assert (int(row[0]), row[1]) == (number, number - 2**63)


@pytest.mark.parametrize("done, total, copy_percent, chunk_percent", [(5, 10, 50.0, 50.0), (20, 10, 100.0, 100.0), (0, 0, 100.0, 0.0)])
def test_progress_percent(spark, done, total, copy_percent, chunk_percent):
    df = spark.createDataFrame([(done, total)], "d bigint, t bigint")
    found = df.select(numbers.progress_percent(F.col("d"), F.col("t")), numbers.progress_percent(F.col("d"), F.col("t"), 0.0)).first()
    assert tuple(found) == (copy_percent, chunk_percent)


def in_range(key, low, high):
    test = F.lit(True) if low is None else F.col(key) >= low
    return test if high is None else test & (F.col(key) < high)


@pytest.mark.parametrize("n", [1, 4, 64])
def test_key_ranges_are_disjoint_and_cover_all(spark, t, n):
    # A dense stretch holds a third of all keys.
    keys = t.orders.select((F.col("o_orderkey") * 1000).alias("k")).unionByName(t.orders.where("o_orderkey < 700").select(F.col("o_orderkey").alias("k")))
    bounds = chunks.range_bounds(chunks.plan_key_ranges(keys, "k", n))
    assert bounds[0][0] is None and bounds[-1][1] is None
    assert [b[1] for b in bounds[:-1]] == [b[0] for b in bounds[1:]]
    counts = [keys.where(in_range("k", *b)).count() for b in bounds]
    assert sum(counts) == keys.count()
    assert max(counts) <= 3 * keys.count() / len(bounds) + 10


def test_key_ranges_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "k bigint")
    assert chunks.range_bounds(chunks.plan_key_ranges(empty, "k", 4)) == [(None, None)]


def test_jdbc_predicates_leave_no_row_out():
    assert jdbc.key_predicates("id", [(None, 10), (10, 20), (20, None)], "MYSQL") == ["(`id` < 10 OR `id` IS NULL)", "`id` >= 10 AND `id` < 20", "`id` >= 20"]
    assert jdbc.key_predicates("id", [(None, None)], "POSTGRESQL") == ["1 = 1"]
    assert jdbc.quote('a"b', "POSTGRESQL") == '"a""b"'


def test_jdbc_bounds_are_spelled_by_type():
    import datetime

    day, name = datetime.date(2024, 1, 2), "O'Neil"
    assert jdbc.key_predicates("d", [(None, day), (day, None)], "POSTGRESQL")[1] == "\"d\" >= DATE '2024-01-02'"
    assert jdbc.key_predicates("d", [(None, day), (day, None)], "SQL_SERVER")[1] == "[d] >= '2024-01-02'"
    assert jdbc.key_predicates("n", [(None, name), (name, None)], "MYSQL")[0] == "(`n` < 'O''Neil' OR `n` IS NULL)"
    assert jdbc.literal("a\\'b", "MYSQL") == "'a\\\\''b'" and jdbc.literal(True, "ORACLE") == "1"
    assert jdbc.literal(datetime.datetime(2024, 1, 2, 3, 4, 5), "ORACLE") == "TIMESTAMP '2024-01-02 03:04:05'"
    assert jdbc.quote_table("public.orders", "POSTGRESQL") == '"public"."orders"' and jdbc.quote_table(["a.b"], "MYSQL") == "`a.b`"


def test_jdbc_predicates_of_composite_keys_part_the_rows():
    import duckdb

    con = duckdb.connect()
    con.execute("create table t as select a, b from (values (1), (2), (3), (null)) x(a), (values ('p'), ('q'), (null)) y(b)")
    bounds = [(None, (1, "q")), ((1, "q"), (3, "p")), ((3, "p"), None)]
    asked = jdbc.key_predicates(["a", "b"], bounds, "POSTGRESQL")
    found = [con.execute(f"select a, b from t where {p}").fetchall() for p in asked]
    whole = [sorted(r for r in rows_ if None not in r) for rows_ in found]
    assert whole == [[(1, "p")], [(1, "q"), (2, "p"), (2, "q")], [(3, "p"), (3, "q")]]
    seen = [r for part in found for r in part]
    assert all((None, b) in found[0] for b in ("p", "q", None)) and set(seen) == set(con.execute("select a, b from t").fetchall())


def test_shared_folder_comes_from_the_session():
    class Cluster:
        def __init__(self, folder, master):
            settings = {"spark.checkpoint.dir": folder}
            self.conf = type("Conf", (), {"get": staticmethod(lambda k, d=None: settings.get(k) or d)})
            plain = type("Plain", (), {"get": staticmethod(lambda k, d=None: None)})
            self.sparkContext = type("Context", (), {"master": master, "getConf": staticmethod(lambda: plain)})

    assert session.fresh_dir(Cluster("s3a://b/tmp/", "yarn"), "x").startswith("s3a://b/tmp/x-")
    with pytest.raises(RuntimeError):
        session.shared_dir(Cluster(None, "yarn"))


def test_every_engine_answers_the_same_questions():
    for engine, asked in jdbc.CATALOG_QUERIES.items():
        assert {"tables", "columns", "primary_keys", "foreign_keys", "indexes", "row_estimates"} <= set(asked), engine


def test_scan_chunk_reaches_the_scan(t):
    from ferry.sources.tables import scan_chunk

    plan = scan_chunk(t.orders, "o_orderkey", 100, 200)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(o_orderkey,100)" in plan and "LessThan(o_orderkey,200)" in plan


def test_positions_match_a_global_sort_even_with_a_hot_key(spark):
    hot = spark.range(300).select(F.lit(5).alias("k"), F.col("id").alias("tie"))
    rest = spark.range(600).select((F.col("id") % 37).cast("int").alias("k"), (F.col("id") + 1000).alias("tie"))
    found = ordered.row_positions(hot.unionByName(rest), ["k", "tie"], blocks=7)
    expect = sorted((r.k, r.tie) for r in hot.unionByName(rest).collect())
    assert [(r.k, r.tie) for r in found.orderBy("position").collect()] == expect
    assert sorted(r.position for r in found.collect()) == list(range(900))


def test_running_errors_against_a_loop(spark):
    import random

    random.seed(3)
    polls = [(0 if i % 3 else i % 5, i, random.choice(["ERROR", "ERROR", "ERROR", "EMPTY", "APPLIED"])) for i in range(600)]
    df = spark.createDataFrame(polls, "m int, b int, outcome string")
    found = {(r.m, r.b): (r.error_run, r.tripped) for r in ordered.consecutive_errors(df, "m", ["m", "b"], "outcome", 4).collect()}
    run = {}
    for m, b, outcome in sorted(polls):
        run[m] = 0 if outcome == "APPLIED" else run.get(m, 0) + (outcome == "ERROR")
        assert found[(m, b)] == (run[m], run[m] >= 4)


def test_a_null_group_keeps_its_rows(spark):
    df = spark.createDataFrame([(m, i, "ERROR", 2) for i in range(20) for m in (None, 1)], "m int, b int, outcome string, n int")
    runs = ordered.consecutive_errors(df, "m", ["m", "b"], "outcome", 5)
    assert rows(runs.groupBy("m").agg(F.max("error_run"))) == [(None, 20), (1, 20)]
    summed = ordered.cumulative_progress(df, "m", ["m", "b"], "n")
    assert rows(summed.groupBy("m").agg(F.max("rows_so_far"), F.max("percent_so_far"))) == [(None, 40, 100.0), (1, 40, 100.0)]


def orders_plan(**more):
    return copy.CopyPlan(migration_id=1, table="orders", key="o_orderkey", stride=100, **more)


def test_copying_again_changes_nothing(spark, t):
    root = fresh_dir(spark, "copy")
    copy.copy_table(spark, t.orders, root, orders_plan(), "2024-01-01 00:00:00", "run-1")
    first = rows(copy.read_copy(spark, root))
    copy.copy_table(spark, t.orders, root, orders_plan(), "2024-01-02 00:00:00", "run-2")
    assert rows(copy.read_copy(spark, root)) == first and len(first) == t.orders.count()


def test_stopped_and_resumed_copy_equals_a_straight_one(spark, t):
    straight, resumed = fresh_dir(spark, "copy"), fresh_dir(spark, "copy")
    copy.copy_table(spark, t.orders, straight, orders_plan(), "2024-01-01 00:00:00")
    copy.copy_pending_chunks(spark, t.orders.where("o_orderkey < 500"), resumed, orders_plan(), "run-1", "2024-01-01 00:00:00")
    seen = copy.copy_pending_chunks(spark, t.orders, resumed, orders_plan(), "run-2", "2024-01-02 00:00:00")
    assert rows(copy.read_copy(spark, resumed)) == rows(copy.read_copy(spark, straight))
    assert seen.where("status = 'COMPLETED'").groupBy("chunk_id").count().where("count > 1").count() == 0


def test_the_same_batch_name_still_copies_new_chunks(spark, t):
    root = fresh_dir(spark, "copy")
    copy.copy_table(spark, t.orders.where("o_orderkey < 300"), root, orders_plan(), "2024-01-01 00:00:00")
    copy.copy_table(spark, t.orders, root, orders_plan(), "2024-01-02 00:00:00")
    assert copy.read_copy(spark, root).count() == t.orders.count()


def test_copy_quarantines_and_counts_what_was_stored(spark, t):
    root = fresh_dir(spark, "copy")
    plan = copy.CopyPlan(1, "customer", "c_custkey", 50, order="copy_no", rules=(quality.not_null("c_name"),))
    progress = copy.copy_table(spark, t.dirty, root, plan, "2024-01-01 00:00:00").first()
    stored = copy.read_copy(spark, root).count()
    bad = copy.read_held(spark, root).count()
    assert progress.rows_copied == stored and stored + bad == t.dirty.count()
    [saved] = spark.read.parquet(f"{root}/checkpoints").collect()
    assert saved.checkpoint_name == f"checkpoint_customer_{stored}"


def test_rows_without_a_key_are_quarantined(spark):
    root = fresh_dir(spark, "copy")
    source = spark.createDataFrame([(1, "a"), (None, "b"), (250, "c"), (None, "d")], "o_orderkey bigint, v string")
    copy.copy_table(spark, source, root, orders_plan(), "2024-01-01 00:00:00")
    assert rows(copy.read_copy(spark, root), "o_orderkey", "v") == [(1, "a"), (250, "c")]
    assert rows(copy.read_held(spark, root), "v") == [("b",), ("d",)]


def test_one_bad_chunk_fails_alone_and_is_copied_by_the_next_run(spark, t):
    root, plan = fresh_dir(spark, "copy"), orders_plan(waves=3)
    bad = F.when(F.col("o_orderkey") == 777, F.raise_error(F.lit("torn page")).cast("string")).otherwise(F.col("o_orderstatus"))
    progress = copy.copy_table(spark, t.orders.withColumn("o_orderstatus", bad), root, plan, "2024-01-01 00:00:00").first()
    assert progress.chunks_failed == 1 and progress.chunks_completed == progress.chunks_total - 1
    lost = t.orders.where("floor(o_orderkey / 100) = 7").count()
    assert progress.rows_copied == t.orders.count() - lost == copy.read_copy(spark, root).count()
    assert progress.total_rows == t.orders.count() and progress.progress_percent < 100
    found = copy.read_ledger(spark, f"{root}/ledger")
    now = {r.chunk_id: r for r in ledger.current_ledger(found).collect()}
    assert now["1#orders#700"].status == "FAILED" and "torn page" in now["1#orders#700"].error
    assert {r.status for r in found.where("chunk_id = '1#orders#700'").collect()} == {"PENDING", "RUNNING", "FAILED"}
    again = copy.copy_table(spark, t.orders, root, plan, "2024-01-01 00:00:00").first()
    assert (again.chunks_failed, again.progress_percent, again.rows_copied) == (0, 100.0, t.orders.count())
    assert copy.read_copy(spark, root).count() == t.orders.count()


def test_quarantine_of_an_earlier_run_stays(spark):
    root, plan = fresh_dir(spark, "copy"), copy.CopyPlan(1, "t", "k", 100, rules=(quality.not_null("v"),))
    first = spark.createDataFrame([(1, "a"), (2, None)], "k bigint, v string")
    copy.copy_table(spark, first, root, plan, "2024-01-01 00:00:00")
    more = first.unionByName(spark.createDataFrame([(101, "c"), (102, None)], "k bigint, v string"))
    progress = copy.copy_table(spark, more, root, plan, "2024-01-02 00:00:00").first()
    assert rows(copy.read_held(spark, root), "k") == [(102,), (2,)]
    assert (progress.rows_copied, progress.total_rows, progress.progress_percent) == (2, 4, 50.0)


def test_an_empty_source_copies_nothing(spark):
    found = copy.copy_pending_chunks(spark, spark.createDataFrame([], "o_orderkey bigint"), fresh_dir(spark, "copy"), orders_plan(), "b", "2024-01-01 00:00:00")
    assert found.count() == 0


def test_a_finished_copy_has_nothing_left_to_read(spark, t):
    root = fresh_dir(spark, "copy")
    first = copy.copy_pending_chunks(spark, t.orders, root, orders_plan(), "run-1", "2024-01-01 00:00:00").count()
    again = copy.copy_pending_chunks(spark, t.orders, root, orders_plan(), "run-2", "2024-01-01 00:00:00").count()
    assert again == first


def test_added_columns_are_copied_and_other_types_refused(spark):
    root, plan = fresh_dir(spark, "copy"), copy.CopyPlan(1, "t", "k", 100)
    copy.copy_table(spark, spark.createDataFrame([(1, "a")], "k bigint, v string"), root, plan, "2024-01-01 00:00:00")
    copy.copy_table(spark, spark.createDataFrame([(1, "a", 0), (101, "b", 7)], "k bigint, v string, more int"), root, plan, "2024-01-02 00:00:00")
    assert rows(copy.read_copy(spark, root), "k", "v", "more") == [(1, "a", None), (101, "b", 7)]
    with pytest.raises(ValueError):
        copy.copy_table(spark, spark.createDataFrame([(201, 5)], "k bigint, v int"), root, plan, "2024-01-03 00:00:00")


def test_many_bad_chunks_cost_no_good_one(spark):
    """Every tenth chunk cannot be read; the others are copied, each written once."""
    root, plan = fresh_dir(spark, "copy"), copy.CopyPlan(1, "t", "k", 10)
    torn = F.when((F.col("k") % 100) == 55, F.raise_error(F.lit("torn page")).cast("string")).otherwise(F.lit("v"))
    progress = copy.copy_table(spark, spark.range(1000).select(F.col("id").alias("k")).withColumn("v", torn), root, plan, "2024-01-01 00:00:00").first()
    assert (progress.chunks_failed, progress.chunks_completed, progress.rows_copied) == (10, 90, 900)
    assert copy.read_copy(spark, root).count() == 900


def test_an_unfinished_try_is_not_read_and_leaves_nothing(spark):
    root, plan = fresh_dir(spark, "copy"), copy.CopyPlan(1, "t", "k", 10, rules=(quality.not_null("v"),))
    source = spark.createDataFrame([(1, "a"), (11, None)], "k bigint, v string")
    copy.copy_table(spark, source, root, plan, "2024-01-01 00:00:00")
    dead = spark.createDataFrame([(21, "old", None, False, "1#t#20"), (22, None, ["x"], True, "1#t#20")], "k bigint, v string, reasons array<string>, _held boolean, _chunk_id string")
    dead.write.mode("append").partitionBy("_held", "_chunk_id").parquet(f"{root}/rows")
    assert rows(copy.read_copy(spark, root), "k") == [(1,)]
    more = source.unionByName(spark.createDataFrame([(21, "new")], "k bigint, v string"))
    copy.copy_table(spark, more, root, plan, "2024-01-02 00:00:00")
    assert rows(copy.read_copy(spark, root), "k", "v") == [(1, "a"), (21, "new")]
    assert rows(copy.read_held(spark, root), "k") == [(11,)]


KEYS = {
    "text": ("k string", [(v,) for v in ["", "a", "ab", "b", "Z", "é", "日本", "hot", "hot", "hot"] + [f"n{i:03}" for i in range(200)]]),
    "date and number": ("k date, j int", None),
    "number and text": ("k bigint, j string", [(i % 7, f"t{i % 50}") for i in range(300)] + [(3, "hot")] * 200),
}


@pytest.mark.parametrize("kind", KEYS)
@pytest.mark.parametrize("n", [1, 5, 40])
def test_ranges_of_any_key_cover_every_row_once(spark, kind, n):
    import datetime

    schema, data = KEYS[kind]
    data = data or [(datetime.date(2024, 1, 1) + datetime.timedelta(days=i % 90), i % 11) for i in range(400)]
    keys = [c.split()[0] for c in schema.split(", ")]
    df = spark.createDataFrame([*data, *[(None, *d[1:]) for d in data[:3]]], schema)
    bounds = chunks.row_bounds(chunks.plan_row_ranges(df, keys, n))
    assert bounds == sorted(set(bounds)) and len(bounds) < max(n, 1)
    tagged = df.withColumn("no", chunks.range_chunk(df, keys, bounds))
    expect = sorted((*d, sum(b <= d for b in bounds)) for d in data)
    assert sorted(tuple(r) for r in tagged.where("no is not null").collect()) == expect and tagged.where("no is null").count() == 3
    half = len(bounds) // 2
    spans = [(0, half), (half + 1, len(bounds))][: 1 + (half < len(bounds))]
    assert sorted(tuple(r) for span in spans for r in chunks.in_row_ranges(df, keys, bounds, *span).collect()) == sorted(data)


def test_copy_by_ranges_of_a_composite_key(spark):
    root = fresh_dir(spark, "copy")
    data = [(f"g{i % 9}", i, f"v{i}") for i in range(500)] + [(None, 1, "x"), ("g1", None, "y")]
    source = spark.createDataFrame(data, "a string, b int, v string")
    torn = F.when(F.col("b") == 250, F.raise_error(F.lit("torn page")).cast("string")).otherwise(F.col("v"))
    plan = copy.ranged_plan(spark, source, root, copy.CopyPlan(1, "t", "a", 1, keys=("a", "b")), 10)
    assert len(plan.bounds) == 9
    first = copy.copy_table(spark, source.withColumn("v", torn), root, plan, "2024-01-01 00:00:00").first()
    assert first.chunks_failed == 1 and 400 < first.rows_copied < 500
    again = copy.ranged_plan(spark, source.limit(3), root, copy.CopyPlan(1, "t", "a", 1, keys=("a", "b")), 10)
    assert again == plan
    copy.copy_table(spark, source, root, again, "2024-01-02 00:00:00")
    assert rows(copy.read_copy(spark, root), "a", "b", "v") == sorted(data[:500], key=lambda r: tuple((True, str(v)) for v in r))
    assert rows(copy.read_held(spark, root), "v") == [("x",), ("y",)]


def test_upsert_last_row_wins_and_rollback_restores(spark):
    root = fresh_dir(spark, "target")
    schema = "k int, v string, seq int"
    one = target.upsert(spark, root, spark.createDataFrame([(1, "a", 0), (2, "b", 0), (None, "n", 0)], schema), ["k"], "b1")
    before = rows(target.read_target(spark, root))
    target.upsert(spark, root, spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "c", 0), (None, "m", 1)], schema), ["k"], "b2", order=["seq"])
    assert rows(target.read_target(spark, root), "k", "v") == [(None, "m"), (1, "a"), (2, "y"), (3, "c")]
    again = target.upsert(spark, root, spark.createDataFrame([(1, "zzz", 9)], schema), ["k"], "b2")
    assert again == 2 and target.read_target(spark, root).where("v = 'zzz'").count() == 0
    target.roll_back(spark, root, one, "undo")
    assert rows(target.read_target(spark, root)) == before
    assert rows(target.read_target(spark, root, as_of=2), "k", "v") == [(None, "m"), (1, "a"), (2, "y"), (3, "c")]


def test_a_failed_try_leaves_the_target_readable(spark):
    root = fresh_dir(spark, "target")
    target.upsert(spark, root, spark.range(20).selectExpr("id", "'old' as v"), ["id"], "b1")
    spark.range(20).selectExpr("id", "'half' as v", "0 as _bucket", "'b2-dead' as _batch").write.mode("append").partitionBy("_bucket", "_batch").parquet(f"{root}/data")
    assert target.read_target(spark, root).where("v = 'old'").count() == 20
    target.upsert(spark, root, spark.range(5).selectExpr("id", "'new' as v"), ["id"], "b2")
    assert rows(target.read_target(spark, root).groupBy("v").count()) == [("new", 5), ("old", 15)]


def test_target_keeps_its_bucket_count_in_another_session_setting(spark):
    root = fresh_dir(spark, "target")
    target.upsert(spark, root, spark.range(100).selectExpr("id", "1 as v"), ["id"], "b1", buckets=3)
    target.upsert(spark, root, spark.range(50, 150).selectExpr("id", "2 as v"), ["id"], "b2")
    assert rows(target.read_target(spark, root).groupBy("v").count()) == [(1, 50), (2, 100)]
    assert target._State(spark, root).buckets == 3


def test_an_unfinished_commit_does_not_count(spark):
    root = fresh_dir(spark, "target")
    target.upsert(spark, root, spark.range(5).selectExpr("id", "1 as v"), ["id"], "b1")
    spark.createDataFrame([(0, "nowhere", 4)], "_bucket int, _folder string, buckets int").coalesce(1).write.option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false"
    ).parquet(f"{root}/commits/{2:012d}~dead")
    assert target.versions(spark, root) == [(1, "b1")]
    assert target.upsert(spark, root, spark.range(3).selectExpr("id", "2 as v"), ["id"], "b2") == 2
    assert rows(target.read_target(spark, root).groupBy("v").count()) == [(1, 2), (2, 3)]


def test_forgetting_versions_keeps_the_current_rows(spark):
    root = fresh_dir(spark, "target")
    for i in range(4):
        target.upsert(spark, root, spark.range(i, i + 30).selectExpr("id", f"{i} as v"), ["id"], f"b{i}")
    spark.range(3).selectExpr("id", "9 as v", "0 as _bucket", "'dead' as _batch").write.mode("append").partitionBy("_bucket", "_batch").parquet(f"{root}/data")
    before, earlier = rows(target.read_target(spark, root)), rows(target.read_target(spark, root, as_of=3))
    target.forget_versions(spark, root, keep=2)
    assert target.versions(spark, root) == [(3, "b2"), (4, "b3")]
    assert rows(target.read_target(spark, root)) == before and rows(target.read_target(spark, root, as_of=3)) == earlier
    with pytest.raises(ValueError):
        target.read_target(spark, root, as_of=2)
    assert not files.folders(spark, f"{root}/data/_bucket=*/_batch=dead")


def test_batch_names_are_checked(spark):
    with pytest.raises(ValueError):
        target.upsert(spark, fresh_dir(spark, "target"), spark.range(3), ["id"], "a/b")


def test_rollback_of_rows_by_chunk(spark):
    rows_ = spark.createDataFrame([(1, "c1"), (2, "c2"), (3, "c1")], "id int, _chunk_id string")
    kept = spark.createDataFrame([("c1",)], "chunk_id string")
    assert rows(ledger.roll_back_rows(rows_, kept), "id") == [(1,), (3,)]


def test_duplicate_key_keeps_the_first_row(spark):
    df = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (2, 0), (None, 0), (None, 1)], "k int, seq int")
    good, bad = quality.split_rows(quality.check_rows(df, [quality.not_null("k")], "k", "seq"))
    assert rows(good) == [(1, 0), (2, 0)]
    assert rows(bad, "k", "seq") == [(None, 0), (None, 1), (1, 1), (1, 2)]


def test_rules_come_before_copies_and_ties_are_held(spark):
    schema = "k int, v string, seq int"
    data = [
        (1, None, 0), (1, "good", 1),  # the first copy is bad, the second is loaded
        (2, "a", 0), (2, "b", 0), (2, "c", 1),  # two tie for the first place
        (3, "a", None), (3, "b", None),  # nothing orders them
        (4, "a", None), (4, "b", 5),  # one has an order
        (5, "only", None),
    ]
    checked = quality.check_rows(spark.createDataFrame(data, schema), [quality.not_null("v")], "k", "seq")
    good, bad = quality.split_rows(checked)
    assert rows(good, "k", "v") == [(1, "good"), (4, "b"), (5, "only")]
    held = rows(bad.select("k", "v", F.array_join("reasons", ",")))
    assert held == [
        (1, None, "v is null"), (2, "a", "ambiguous copy"), (2, "b", "ambiguous copy"), (2, "c", "duplicate key"),
        (3, "a", "ambiguous copy"), (3, "b", "ambiguous copy"), (4, "a", "duplicate key"),
    ]
    assert checked.columns == ["k", "v", "seq", "reasons"]


def test_rollback_to_a_forgotten_version_is_refused(spark):
    root = fresh_dir(spark, "target")
    one = target.upsert(spark, root, spark.createDataFrame([(1, "a")], "k int, v string"), ["k"], "b1")
    target.upsert(spark, root, spark.createDataFrame([(2, "b")], "k int, v string"), ["k"], "b2")
    target.forget_versions(spark, root, 1)
    with pytest.raises(ValueError):
        target.roll_back(spark, root, one, "undo")
    assert target.read_target(spark, root).count() == 2


def test_names_are_escaped_in_table_text(spark):
    from ferry.operators import drift

    schema = "migration_id int, database_name string, table_name string, column_name string, column_type string, ordinal int, nullable boolean, column_default string, auto_increment boolean, primary_key boolean, max_length int, num_precision int, num_scale int"
    rows_ = [(1, "d", "we`ird", "c`1", "int", 1, True, None, False, False, None, None, None)]
    names = {f: rows_[0][i] for i, f in enumerate(n.split()[0] for n in schema.split(", "))}
    df = spark.createDataFrame(rows_, schema)
    for key in drift.TABLE:
        if key not in names:
            df = df.selectExpr("*", f"'x' as {key}")
    assert "`we``ird`" in drift.create_table_ddl(df).first().ddl and "`c``1`" in drift.create_table_ddl(df).first().ddl


def test_many_newest_rows_are_those_of_a_sort(spark):
    df = spark.range(0, 9000, 1, 9).select((F.col("id") % 2).alias("k"), F.hash("id").alias("v"), "id")
    found = ordered.newest_n(df, ["k"], [F.col("v").desc(), F.col("id").asc()], 1500)
    assert found.columns == ["k", "v", "id", "row_rank"]
    expect = []
    for k in (0, 1):
        mine = sorted((r for r in df.collect() if r.k == k), key=lambda r: (-r.v, r.id))[:1500]
        expect += [(k, r.v, r.id, i) for i, r in enumerate(mine, 1)]
    assert rows(found) == sorted(expect, key=lambda r: tuple((v is not None, str(v)) for v in r))
