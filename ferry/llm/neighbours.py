"""Nearest neighbours by learned partitions of a neighbour graph.

A bounded sample's neighbour graph is cut into parts of about equal size, and a small
network learns which parts a vector's neighbours lie in. All vectors are filed under
their likeliest part; a query is routed to its several likeliest parts and their
vectors are ranked by exact distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferry.llm.shared import stored

#: Vectors that the index is fitted on, at most; parts; neighbours in the graph.
SAMPLE, PARTS, LINKS = 4096, 32, 10
#: Part of the sample's neighbours that the routed parts must hold. Queries are routed to
#: as many parts as that takes, the same number for all.
RECALL = 0.97
HIDDEN, STEPS, BATCH, RATE = 128, 1500, 256, 0.003
#: Vectors and queries that one task compares, about.
BLOCK, QUERY_BLOCK = 4096, 1024


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) without vectors that are null, zero or hold null or non-finite
    components, and without those of another length than most have."""
    x = F.col("embedding")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    good = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & x.isNotNull() & F.coalesce(whole, F.lit(False)) & F.exists(x, lambda v: v != 0))
    most = good.groupBy(F.size(x).alias("n")).agg(F.count("*").alias("k")).orderBy(F.desc("k"), "n").limit(1).collect()
    return good.where(F.size(x) == (most[0].n if most else -1))


def graph(x: np.ndarray) -> np.ndarray:
    """The nearest neighbours of every sampled vector."""
    size = (x**2).sum(axis=1)
    out = []
    for lo in range(0, len(x), 512):
        d = size[None, :] - 2 * x[lo : lo + 512] @ x.T
        d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
        out.append(np.argpartition(d, min(LINKS, d.shape[1] - 1) - 1, axis=1)[:, :LINKS])
    return np.concatenate(out)


def balanced(x: np.ndarray, near: np.ndarray, parts: int) -> np.ndarray:
    """Parts of equal size: halves along the widest direction, then moves that keep more
    links inside a part while no part grows over a twentieth more than its share."""
    part = np.zeros(len(x), dtype=int)
    n = 1
    while n < parts:
        for p in range(n):
            mine = np.flatnonzero(part == p)
            centred = x[mine] - x[mine].mean(axis=0)
            direction = np.linalg.svd(centred, full_matrices=False)[2][0]
            part[mine[np.argsort(centred @ direction, kind="stable")[len(mine) // 2 :]]] = n + p
        n *= 2
    room = int(np.ceil(len(x) / n * 1.05))
    sizes = np.bincount(part, minlength=n)
    back: list[list[int]] = [list(row) for row in near]
    for i, row in enumerate(near):
        for j in row:
            back[j].append(i)
    for _ in range(8):
        moved = 0
        for i in range(len(x)):
            votes = np.bincount(part[back[i]], minlength=n)
            votes[(sizes >= room) & (np.arange(n) != part[i])] = -1
            to = int(votes.argmax())
            if votes[to] > votes[part[i]]:
                sizes[part[i]] -= 1
                sizes[to] += 1
                part[i] = to
                moved += 1
        if not moved:
            break
    return part


def train(x: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, ...]:
    """One hidden layer, cross-entropy to each vector's share of neighbours per part (Adam)."""
    rng = np.random.default_rng(0)
    n = target.shape[1]
    w = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, (HIDDEN, n)), np.zeros(n)]
    m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    for step in range(1, STEPS + 1):
        rows = rng.integers(0, len(x), min(BATCH, len(x)))
        a = np.maximum(x[rows] @ w[0] + w[1], 0)
        e = chances((*w,), x[rows]) - target[rows]
        back = (e @ w[2].T) * (a > 0)
        slopes = [x[rows].T @ back / len(rows), back.mean(axis=0), a.T @ e / len(rows), e.mean(axis=0)]
        for p, s, mm, vv in zip(w, slopes, m, v, strict=True):
            mm += 0.1 * (s - mm)
            vv += 0.001 * (s * s - vv)
            p -= RATE * (1 - step / (STEPS + 1)) * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8)
    return tuple(w)


def chances(w: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    out = np.maximum(x @ w[0] + w[1], 0) @ w[2] + w[3]
    out = np.exp(out - out.max(axis=1, keepdims=True))
    return out / out.sum(axis=1, keepdims=True)


def fit(x: np.ndarray) -> tuple[tuple[np.ndarray, ...], int]:
    """The router, and how many parts a query must visit on the sample for ``RECALL``."""
    scale = max(float(np.abs(x).mean()), 1e-30)
    if len(x) < 4 * LINKS:
        return (np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)), 1
    near = graph(x)
    parts = 1 << max(0, min(int(np.log2(PARTS)), int(np.log2(len(x) / (2 * LINKS)))))
    part = balanced(x, near, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), near.shape[1]), part[near].ravel()), 1 / (near.shape[1] + 1))
    target[np.arange(len(x)), part] += 1 / (near.shape[1] + 1)
    # The last fifth is not learned from: it shows how far queries must look.
    seen = max(1, len(x) * 4 // 5)
    w = list(train(x[:seen] / scale, target[:seen]))
    w[0] = w[0] / scale
    likely = chances(tuple(w), x)
    filed = likely.argmax(axis=1)
    order = np.argsort(-likely[seen:], axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    reached = np.sort(np.take_along_axis(place, filed[near[seen:]], axis=1).ravel())
    visits = int(reached[min(len(reached) - 1, int(np.ceil(RECALL * len(reached))))]) + 1
    return tuple(w), visits


def _filed(vectors: DataFrame, w: tuple[np.ndarray, ...], visits: int, name: str) -> DataFrame:
    """Adds the ``visits`` likeliest parts of every vector, one row for each."""
    shared = vectors.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                column = batch.column("embedding")
                x = column.flatten().to_numpy().astype(float).reshape(batch.num_rows, -1)
                order = np.argsort(-chances(shared.value, x), axis=1, kind="stable")[:, :visits]
                rows = np.repeat(np.arange(batch.num_rows), order.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), column.take(pa.array(rows)), pa.array(order.ravel().astype(np.int32))], names=[name, "embedding", "part"])

    return vectors.select(F.col("vec_id").cast("long").alias(name), F.col("embedding").cast("array<double>")).mapInArrow(run, T.StructType([T.StructField(name, T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("part", T.IntegerType())]))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest of each query's routed parts, by
    Euclidean distance in double precision, ties to the smaller id.

    Both inputs have (vec_id, embedding); a query's own id is no candidate. Of equal
    vectors only the ``k + 1`` smallest ids can be an answer, so the others are left out:
    no part is swamped by one vector. Parts are split into blocks of bounded size on both
    sides. Queries always visit parts that hold ``k`` candidates, if there are so many.
    Unusable vectors take no part (see ``usable``); an empty table gives no rows.
    """
    spark = vectors.sparkSession
    copies = Window.partitionBy("embedding").orderBy("vec_id")
    distinct = stored(usable(vectors).dropDuplicates(["vec_id", "embedding"]).withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1), "vectors")
    sample = distinct.where("copy = 1").orderBy(F.xxhash64("embedding"), "vec_id").limit(SAMPLE).collect()
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    x = np.array([r.embedding for r in sample], dtype=float)
    w, visits = fit(x)
    index = stored(_filed(distinct, w, 1, "vec_id"), "index")
    asked = usable(queries).where(F.size("embedding") == x.shape[1]).dropDuplicates(["vec_id"])
    # One row per part.
    sizes = {r.part: r.n for r in index.groupBy("part").agg(F.count("*").alias("n")).collect()}
    parts = w[3].shape[0]
    held = np.cumsum(sorted(sizes.get(p, 0) for p in range(parts)))
    visits = min(parts, max(visits, int(np.searchsorted(held, k + 1)) + 1))
    routed = stored(_filed(asked, w, visits, "query_id"), "routed")
    asked_of = {r.part: r.n for r in routed.groupBy("part").agg(F.count("*").alias("n")).collect()}
    blocks = lambda counts, size: F.create_map(*[F.lit(v) for p in range(parts) for v in (p, -(-counts.get(p, 0) // size) or 1)])[F.col("part")]
    rows, asks = blocks(sizes, BLOCK), blocks(asked_of, QUERY_BLOCK)
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = index.select("part", F.pmod(F.xxhash64("vec_id"), rows).cast("int").alias("rb"), upto(asks).alias("qb"), F.lit(0).alias("side"), F.col("vec_id").alias("id"), "embedding")
    right = routed.select("part", upto(rows).alias("rb"), F.pmod(F.xxhash64("query_id"), asks).cast("int").alias("qb"), F.lit(1).alias("side"), F.col("query_id").alias("id"), "embedding")

    def ranked(group: pa.Table) -> pa.Table:
        side, ids = group.column("side").to_numpy(), group.column("id").to_numpy()
        v = group.column("embedding").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        candidates, cv = ids[side == 0], v[side == 0]
        for q, qv in zip(ids[side == 1], v[side == 1], strict=True):
            gap = cv - qv
            score = np.sqrt((gap * gap).sum(axis=1))
            score[candidates == q] = np.inf
            best = np.lexsort((candidates, score))[:k]
            best = best[candidates[best] != q]
            found.append((np.full(len(best), q), candidates[best], score[best]))
        columns = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, float))]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    near = left.unionByName(right).groupBy("part", "rb", "qb").applyInArrow(ranked, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours_report(vectors: DataFrame) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 100, among all others."""
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10)
