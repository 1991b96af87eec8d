"""An upsertable target on plain Parquet.

Rows lie in ``data/_bucket=K/_batch=FOLDER``. A batch writes new folders for the
buckets it touches and then one small file under ``commits/VERSION~BATCH`` that
names, for every bucket, the folder to read. Every try has a folder name of its
own, so a failed one leaves folders no commit names; a batch that is already
committed is skipped. Older commits stay readable, which is what rollback uses,
until ``forget_versions``. One writer per target at a time.

Where the session's catalog supports MERGE INTO, use ``merge_into`` instead.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ferry.functions.numbers import lsn_rank
from ferry.operators.ordered import latest_per_key
from ferry.session import fresh_dir, parallelism
from ferry.sources import files

_COMMIT = "_bucket int, _folder string, buckets int"
_NAME = re.compile(r"[A-Za-z0-9_.-]+")
BUCKET_BYTES = 256 << 20
MIN_BUCKETS = 8
CONTROL = ("_lsn", "_event_id", "_deleted")


def _commits(spark: SparkSession, root: str) -> dict[int, tuple[str, str]]:
    """Finished commits: version → (batch, path). Only folder names are read."""
    tried: dict[int, list[tuple[str, str]]] = {}
    for path in files.folders(spark, f"{root}/commits/*~*"):
        version, batch = path.rsplit("/", 1)[1].split("~", 1)
        tried.setdefault(int(version), []).append((batch, path))
    last, found = max(tried, default=0), {}
    for version, commits in tried.items():
        # A writer that died leaves its commit unfinished: the last one, or one
        # whose version the next writer took.
        if version == last or len(commits) > 1:
            commits = [c for c in commits if files.exists(spark, f"{c[1]}/_SUCCESS")]
        if commits:
            found[version] = commits[0]
    return found


class _State:
    """What is current, or was at a version: folder per bucket, bucket count. Reads
    one file of at most one row per bucket, however many commits there are."""

    def __init__(self, spark: SparkSession, root: str, as_of: int | None = None, batch: str | None = None):
        if batch is not None and not _NAME.fullmatch(batch):
            raise ValueError(f"batch name may hold letters, digits, '_', '.' and '-': {batch!r}")
        self.folders: dict[int, str] = {}
        self.buckets = 0
        found = _commits(spark, root)
        self.committed = any(batch == b for b, _ in found.values())
        self.version = max((v for v in found if as_of is None or v <= as_of), default=0)
        if self.version:
            for r in spark.read.schema(_COMMIT).parquet(found[self.version][1]).collect():
                self.buckets = r.buckets
                if r._folder:
                    self.folders[r._bucket] = r._folder


def _read_folders(spark: SparkSession, root: str, folders: dict[int, str]) -> DataFrame:
    paths = [f"{root}/data/_bucket={b}/_batch={f}" for b, f in sorted(folders.items())]
    base = spark.read.option("basePath", f"{root}/data")
    return base.schema(base.parquet(paths[0]).schema).parquet(*paths)


def read_target(spark: SparkSession, root: str, as_of: int | None = None, control: bool = False) -> DataFrame:
    """Current rows, or the rows as of an earlier version. Rows marked deleted and
    control columns are left out unless ``control`` is set."""
    state = _State(spark, root, as_of)
    if not state.folders:
        raise ValueError(f"nothing committed under {root}")
    rows = _read_folders(spark, root, state.folders).drop("_bucket", "_batch")
    if control:
        return rows
    if "_deleted" in rows.columns:
        rows = rows.where(~F.col("_deleted"))
    return rows.drop(*CONTROL)


def _commit(spark: SparkSession, root: str, folders: dict[int, str], version: int, batch: str, buckets: int) -> None:
    """The whole map of a version as one small file; it counts once it is finished."""
    rows = [{"_bucket": b, "_folder": f, "buckets": buckets} for b, f in sorted(folders.items())]
    rows = rows or [{"_bucket": -1, "_folder": None, "buckets": buckets}]
    listed = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{_COMMIT}>>")
    path = f"{root}/commits/{version:012d}~{batch}"
    spark.range(0, 1, 1, 1).select(F.inline(listed)).write.mode("overwrite").parquet(path)


def _bucket_count(rows: DataFrame) -> int:
    """Buckets for a new target: by the planner's size estimate of its first load,
    at most as many as the session shuffles into."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(parallelism(rows.sparkSession), max(MIN_BUCKETS, -(-size // BUCKET_BYTES)))


def _by_bucket(rows: DataFrame) -> DataFrame:
    """Bring a bucket's rows together for the write. Adaptive execution splits a
    big bucket over tasks and puts small ones together."""
    return rows.hint("rebalance", "_bucket")


def _same_key(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def _values(rows: DataFrame, columns: Sequence[str]) -> Column:
    return F.struct(*[rows[c] for c in columns])


def upsert(
    spark: SparkSession,
    root: str,
    rows: DataFrame,
    keys: Sequence[str],
    batch: str,
    order: Sequence[str] = (),
    guard: Sequence[str] = (),
    buckets: int | None = None,
) -> int:
    """Insert rows, or overwrite all columns where the key exists.

    ``order`` picks the row that wins when a batch repeats a key; without it the
    keys must be unique in the batch. ``buckets`` is fixed by the first load, from
    its size unless given. ``guard`` names columns that must be
    greater than the stored ones, else the stored row stays. ``batch`` names the
    content: a name that is already committed is skipped. Returns the version.
    """
    keys = list(keys)
    state = _State(spark, root, batch=batch)
    if state.committed:
        return state.version
    count = state.buckets or buckets or _bucket_count(rows)
    if order:
        rows = latest_per_key(rows, keys, list(order))
    rows = rows.withColumn("_bucket", F.pmod(F.hash(*keys), F.lit(count)))
    # The bucket number is Spark's own hash partitioning of the keys: picking the
    # winners has already shuffled by it when the partition counts agree.
    if not order or count != parallelism(spark):
        rows = _by_bucket(rows)
    folder = f"{batch}-{uuid.uuid4().hex[:8]}"
    if not state.folders:
        made = _write(rows, root, folder)
    else:
        made = _merge(spark, root, rows, keys, list(guard), state.folders, folder, count)
    _commit(spark, root, state.folders | {b: folder for b in made}, state.version + 1, batch, count)
    return state.version + 1


def _merge(
    spark: SparkSession, root: str, rows: DataFrame, keys: list[str], guard: list[str], current: dict[int, str], folder: str, count: int
) -> list[int]:
    """Rewrite the buckets the batch touches: stored rows without a successor, and
    the batch. Only the stored keys of those buckets meet the batch in a join."""
    path = fresh_dir(spark, "staged")
    rows.write.partitionBy("_bucket").parquet(path)
    touched = _bucket_numbers(files.folders(spark, f"{path}/_bucket=*"))
    if not touched:
        return []
    staged = spark.read.schema(rows.schema).parquet(path)
    old = {b: current[b] for b in touched if b in current}
    if old:
        stored = _read_folders(spark, root, old).drop("_batch")
        same = _same_key(stored, staged, keys)
        if guard:
            # Either the stored row or its successor goes, never both and never none.
            wins = F.coalesce(_values(staged, guard) > _values(stored, guard), F.lit(False))
            kept = stored.join(staged.select(*keys, *guard), same & wins, "left_anti")
            staged = staged.join(stored.select(*keys, *guard), same & ~wins, "left_anti")
        else:
            kept = stored.join(staged.select(*keys), same, "left_anti")
        staged = kept.unionByName(staged)
        if count != parallelism(spark):
            staged = _by_bucket(staged)
    made = _write(staged, root, folder)
    files.discard(spark, path)
    return made


def _write(rows: DataFrame, root: str, folder: str) -> list[int]:
    """Write the folders of one try and return the buckets that got rows."""
    rows.withColumn("_batch", F.lit(folder)).write.mode("append").partitionBy("_bucket", "_batch").parquet(f"{root}/data")
    return _bucket_numbers(files.folders(rows.sparkSession, f"{root}/data/_bucket=*/_batch={folder}"))


def _bucket_numbers(paths: list[str]) -> list[int]:
    return sorted(int(re.search(r"_bucket=(\d+)", p).group(1)) for p in paths)


def versions(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """Committed versions with their batch names, oldest first."""
    return sorted((v, batch) for v, (batch, _) in _commits(spark, root).items())


def roll_back(spark: SparkSession, root: str, to_version: int, batch: str) -> int:
    """Make an earlier version current again by committing its map."""
    now = _State(spark, root, batch=batch)
    if now.committed:
        return now.version
    if to_version not in dict(versions(spark, root)):
        raise ValueError(f"version {to_version} is not kept any more")
    _commit(spark, root, _State(spark, root, to_version).folders, now.version + 1, batch, now.buckets)
    return now.version + 1


def forget_versions(spark: SparkSession, root: str, keep: int) -> None:
    """Remove commits but the newest ``keep`` and the folders only they name.
    What is left of failed tries goes too, so run it from the target's writer."""
    found = _commits(spark, root)
    kept = sorted(found)[-keep:]
    named = {(b, f) for v in kept for b, f in _State(spark, root, v).folders.items()}
    for version in sorted(set(found) - set(kept)):
        files.discard(spark, found[version][1])
    for path in files.folders(spark, f"{root}/data/_bucket=*/_batch=*"):
        bucket, folder = re.search(r"_bucket=(\d+)/_batch=(.+)$", path).groups()
        if (int(bucket), folder) not in named:
            files.discard(spark, path)


def purge_deleted(spark: SparkSession, root: str, before_lsn: str, batch: str, base: int = 16) -> int:
    """Drop rows marked deleted before a log position: no event that old can come
    again, so their marks are not needed any more. Files are filtered in place of
    their bucket, without a shuffle."""
    state = _State(spark, root, batch=batch)
    if state.committed or not state.folders:
        return state.version
    rows = _read_folders(spark, root, state.folders).drop("_batch")
    kept = rows.where(~(F.col("_deleted") & (F.col("_lsn") < lsn_rank(F.lit(before_lsn), base))))
    folder = f"{batch}-{uuid.uuid4().hex[:8]}"
    made = _write(kept, root, folder)
    _commit(spark, root, {b: folder for b in made}, state.version + 1, batch, state.buckets)
    return state.version + 1


def merge_into(spark: SparkSession, table: str, rows: DataFrame, keys: Sequence[str], deleted: str | None = None) -> None:
    """The same upsert for a catalog whose tables take MERGE INTO."""
    rows.createOrReplaceTempView("_ferry_incoming")
    match = " and ".join(f"t.`{k}` <=> s.`{k}`" for k in keys)
    values = [c for c in rows.columns if c != deleted]
    sets = ", ".join(f"t.`{c}` = s.`{c}`" for c in values)
    names, sources = ", ".join(f"`{c}`" for c in values), ", ".join(f"s.`{c}`" for c in values)
    drop = f"when matched and s.`{deleted}` then delete " if deleted else ""
    keep = f" and not s.`{deleted}`" if deleted else ""
    spark.sql(
        f"merge into {table} t using _ferry_incoming s on {match} {drop}"
        f"when matched then update set {sets} when not matched{keep} then insert ({names}) values ({sources})"
    )
