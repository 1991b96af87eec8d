"""References of several columns and notifications of hot topics, against plain loops."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ferry.operators import notify, quality
from tests.conftest import rows

KEYS = st.lists(st.tuples(st.sampled_from([None, 1, 2]), st.sampled_from([None, "a", "b"])), max_size=12)


@settings(max_examples=8, deadline=None)
@given(KEYS, KEYS)
def test_composite_references(spark, children, parents):
    child = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(children)], "i int, a int, b string")
    parent = spark.createDataFrame(parents, "a int, b string")
    known = {p for p in parents if None not in p}
    simple = [(i, *c) for i, c in enumerate(children) if None not in c and c not in known]
    partly = [(i, *c) for i, c in enumerate(children) if (c[0] is None) != (c[1] is None)]
    order = lambda found: sorted(found, key=str)
    assert order(rows(quality.referential_violations(child, ["a", "b"], parent, ["a", "b"]))) == order(simple)
    assert order(rows(quality.referential_violations(child, ["a", "b"], parent, ["a", "b"], full=True))) == order(simple + partly)


def test_references_of_unequal_length(spark):
    one = spark.range(1)
    with pytest.raises(ValueError):
        quality.referential_violations(one, ["id"], one, ["id", "id"])


@pytest.mark.parametrize("salts", [1, 5])
def test_fan_out_of_hot_topics(spark, salts):
    told = [("LAG", 1), ("LAG", 1), ("DRIFT", 2), (None, 3), ("*", 4)]
    lists = [(1, "[]", True), (2, '["LAG"]', True), (3, '["LAG","DRIFT","LAG"]', True), (4, "[]", False), (5, None, True)]
    alerts = spark.createDataFrame(told, "event_type string, n int")
    subscriptions = spark.createDataFrame([(i, "MAIL", e, on) for i, e, on in lists], "config_id int, notification_type string, subscribed_events string, enabled boolean")
    found = rows(notify.fan_out(alerts, subscriptions, salts), "config_id", "event_type", "n")
    wanted = [(i, e, n) for e, n in told for i, l, on in lists if on and (l in (None, "[]") or (e is not None and f'"{e}"' in l))]
    assert sorted(found, key=str) == sorted(wanted, key=str)


def test_a_hot_topic_is_dealt_evenly(spark):
    alerts = spark.range(2000).selectExpr("'LAG' as event_type", "id as n")
    subscriptions = spark.createDataFrame([(1, "MAIL", "[]", True)], "config_id int, notification_type string, subscribed_events string, enabled boolean")
    salt = notify.F.pmod(notify.F.xxhash64("event_type", "n"), notify.F.lit(16))
    sizes = [r["count"] for r in alerts.groupBy(salt.alias("salt")).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * 2000 / 16
    assert notify.fan_out(alerts, subscriptions, 16).count() == 2000
