"""Notifications as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ferry.functions.images import topics

EVERY_TOPIC = "*"


def fan_out(alerts: DataFrame, subscriptions: DataFrame, salts: int = 1) -> DataFrame:
    """One notification per alert and enabled subscription to its type.

    An empty or null list subscribes to all types: it becomes the topic ``*``, and every
    alert is offered under its own type and under ``*``. That makes it one equi-join.
    There are few topics and all alerts meet ``*``, so with ``salts`` alerts are dealt by
    their content over as many parts of each topic, and each part meets a copy of the
    topic's subscriptions: no task gets more than its share of a hot topic. Alerts
    without a type reach those who subscribe to all types; repeated alerts are told as
    often as they come.
    """
    listed = topics(F.col("subscribed_events"))
    wanted = F.when(F.size(listed) > 0, F.array_distinct(listed)).otherwise(F.array(F.lit(EVERY_TOPIC)))
    subscribed = subscriptions.where(F.col("enabled")).select("config_id", "notification_type", F.explode(wanted).alias("_topic"))
    subscribed = subscribed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = alerts.withColumn("_salt", F.pmod(F.xxhash64(*alerts.columns), F.lit(salts)).cast("int"))
    offered = dealt.withColumn("_topic", F.explode(F.array_distinct(F.array(F.col("event_type"), F.lit(EVERY_TOPIC)))))
    return offered.join(subscribed, ["_topic", "_salt"]).select(
        "config_id", "notification_type", *alerts.columns, F.lit("PENDING").alias("status")
    )


def notification_history(notifications: DataFrame, subscriptions: DataFrame, user_id: int | None = None) -> DataFrame:
    """Notifications with the user they went to, newest first."""
    owners = subscriptions.select("config_id", "user_id")
    if user_id is not None:
        owners = owners.where(F.col("user_id") == user_id)
    return notifications.join(owners, "config_id").orderBy(F.col("created_at").desc(), F.col("notification_id").desc())
