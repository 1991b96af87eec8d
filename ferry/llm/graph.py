"""Connected components of a graph of any size, by local union-find and contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferry.llm.shared import stored

#: Edges that a task joins before it tells what it found; bounds its memory.
JOINED = 200_000


def find(parent: dict[int, int], x: int) -> int:
    root = x
    while parent.get(root, root) != root:
        root = parent[root]
    while parent.get(x, x) != root:
        parent[x], x = root, parent[x]
    return root


def union(parent: dict[int, int], a: int, b: int) -> None:
    """The smaller root becomes the root of both."""
    low, high = sorted((find(parent, a), find(parent, b)))
    parent[low], parent[high] = low, low


def forest(edges: DataFrame) -> DataFrame:
    """Edges (a, b) replaced by (node, smallest node its task links it to): as many rows as
    nodes, at most, for each run of edges that a task joins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def told() -> pa.RecordBatch:
            nodes = [x for x in parent if find(parent, x) != x]
            return pa.RecordBatch.from_arrays([pa.array([find(parent, x) for x in nodes], pa.int64()), pa.array(nodes, pa.int64())], names=["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                union(parent, a, b)
            if len(parent) > JOINED:
                yield told()
                parent.clear()
        yield told()

    return edges.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of an edge (a, b) can reach.

    Each round hangs every node on its smallest neighbour, follows those links to their
    roots, and goes on with the edges between different roots; a group shrinks to one
    node in a logarithm of its size of rounds. Every round is written to the shared folder.
    """
    links = stored(forest(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")), "edges")
    rounds: list[DataFrame] = []
    while not links.isEmpty():
        both = links.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("near")))
        up = both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("up"))
        up = stored(up, "up")
        while True:
            jumped = up.alias("x").join(up.where("node <> up").alias("y"), F.col("x.up") == F.col("y.node"), "left")
            jumped = jumped.select("x.node", F.coalesce("y.up", "x.up").alias("up"), (F.col("y.up").isNotNull()).alias("moved"))
            jumped = stored(jumped, "up")
            moved = not jumped.where("moved").isEmpty()
            up = jumped.select("node", "up")
            if not moved:
                break
        rounds.append(up)
        ends = links.join(up.select(F.col("node").alias("a"), F.col("up").alias("ua")), "a").join(up.select(F.col("node").alias("b"), F.col("up").alias("ub")), "b")
        links = stored(ends.select(F.col("ua").alias("a"), F.col("ub").alias("b")).where("a <> b").distinct(), "edges")
    if not rounds:
        return edges.sparkSession.createDataFrame([], "node long, component long")
    found = rounds[0].withColumnRenamed("up", "component")
    for later in rounds[1:]:
        moved = later.select(F.col("node").alias("component"), F.col("up").alias("top"))
        found = found.join(moved, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    return found
