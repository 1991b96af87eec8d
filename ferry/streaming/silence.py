"""Workers that fall silent and come back, each told once.

Beats are first reduced to one row per worker and stretch of ``limit`` seconds: no silence
fits into a stretch, so its first and last beat are all that matters, and a worker with
very many beats costs a row per stretch and task.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from ferry.sources import files
from ferry.streaming.changes import _checkpoint_id


def _at() -> Column:
    return F.col("seen_at").cast("timestamp_ntz")


def _longer(since: Column, until: Column, limit: int) -> Column:
    return F.timestamp_diff("MICROSECOND", since, until) > limit * 1_000_000


def _stretches(beats: DataFrame, limit: int) -> DataFrame:
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), _at())
    start = micros - F.pmod(micros, F.lit(limit * 1_000_000))
    known = beats.where(F.col("worker_id").isNotNull() & F.col("seen_at").isNotNull())
    return known.groupBy("worker_id", start.alias("stretch")).agg(F.min(_at()).alias("first"), F.max(_at()).alias("last"))


def _notice(rows: DataFrame, kind: str, told_at: Column, since: str) -> DataFrame:
    return rows.select("worker_id", F.lit(kind).alias("notice"), F.col(since).alias("since"), told_at.alias("told_at"))


def _advance(beats: DataFrame, state: DataFrame, limit: int, clock: datetime | None) -> tuple[DataFrame, DataFrame]:
    """(notices, state) after these beats, where the state is (worker_id, last_seen, told):
    each worker's last beat, and whether its silence since then was told."""
    over = lambda since: F.col(since) + F.expr(f"interval {int(limit)} seconds")
    told_before = F.coalesce("told", F.lit(False))
    new = _stretches(beats, limit).join(state, "worker_id", "left").where(F.col("last_seen").isNull() | (F.col("last") > F.col("last_seen")))
    before = F.lag("last").over(Window.partitionBy("worker_id").orderBy("stretch"))
    linked = new.select("worker_id", "first", "last", F.coalesce(before, "last_seen").alias("prev"), (before.isNull() & told_before).alias("told"))
    gap = F.coalesce(_longer(F.col("prev"), F.col("first"), limit), F.lit(False))
    linked = linked.withColumn("gap", gap)
    # A beat that comes late may lie in the stretch of the last one known before.
    back_at = F.when(F.col("first") > F.col("prev"), F.col("first")).otherwise(F.col("last"))
    notices = _notice(linked.where("gap and not told"), "SILENT", over("prev"), "prev").unionByName(_notice(linked.where("gap or told"), "BACK", back_at, "prev"))
    both = state.join(new.groupBy("worker_id").agg(F.max("last").alias("seen")), "worker_id", "full_outer")
    last = both.select("worker_id", F.coalesce("seen", "last_seen").alias("last_seen"), (F.col("seen").isNull() & told_before).alias("told"))
    due = F.lit(False) if clock is None else _longer(F.col("last_seen"), F.lit(clock).cast("timestamp_ntz"), limit)
    silent = _notice(last.where(~F.col("told") & due), "SILENT", over("last_seen"), "last_seen")
    return notices.unionByName(silent), last.withColumn("told", F.col("told") | due)


def _no_state(beats: DataFrame) -> DataFrame:
    return beats.where(F.lit(False)).select("worker_id", _at().alias("last_seen"), F.lit(False).alias("told"))


def silence_notices(beats: DataFrame, asof: str | datetime, limit: int) -> DataFrame:
    """(worker_id, notice, since, told_at) for given beats (worker_id, seen_at): SILENT once
    ``limit`` seconds have passed since the beat ``since``, BACK at the beat that ends it.
    Beats without a worker or a time tell nothing; equal beats count once."""
    at = datetime.fromisoformat(asof) if isinstance(asof, str) else asof
    return _advance(beats, _no_state(beats), limit, at)[0]


def start_silence_watch(
    stream: DataFrame, root: str, checkpoint: str, limit: int, delay: int = 0, once: bool = True, every: str = "1 minute"
) -> StreamingQuery:
    """Watch a stream of beats; ``read_notices`` gives what was told so far.

    The clock is the latest beat of any worker less ``delay`` seconds, so silence is told
    while others are heard. Each micro-batch writes its notices and one row per worker, in
    folders named by the checkpoint's identity and the batch: one delivered again writes
    the same. A beat not later than its worker's last one changes nothing; one that comes
    after its silence was told ends it.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        name = _checkpoint_id(spark, checkpoint)
        folder = lambda what, n: f"{root}/{what}/part={name}-{n}"
        batch.persist()
        try:
            state = spark.read.parquet(folder("state", batch_id - 1)) if batch_id else _no_state(batch)
            ends = [batch.agg(F.max(_at())).first()[0], state.agg(F.max("last_seen")).first()[0]]
            latest = max((at for at in ends if at is not None), default=None)
            notices, after = _advance(batch, state, limit, latest and latest - timedelta(seconds=delay))
            notices.write.mode("overwrite").parquet(folder("notices", batch_id))
            after.write.mode("overwrite").parquet(folder("state", batch_id))
        finally:
            batch.unpersist()
        if batch_id > 1:
            files.discard(spark, folder("state", batch_id - 2))

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def read_notices(spark: SparkSession, root: str) -> DataFrame:
    """All notices once: a checkpoint made anew tells the same ones again."""
    return spark.read.parquet(f"{root}/notices").drop("part").distinct()
