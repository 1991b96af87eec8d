"""Near-duplicate documents: SuperMinHash signatures, banding, exact checks, components.

SuperMinHash gives every element a permutation of the places of the signature and a
random fraction per place; a place keeps the smallest rank plus fraction. Ranks of one
element are a permutation, so the places are correlated and vary less than independent
hashes would. Elements are taken rank by rank, and a text is done as soon as all its
places are filled: later ranks are larger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferry.llm.arrays import Words, blocks, mixed
from ferry.llm.graph import components, find, union
from ferry.llm.shared import stored

SHINGLE, SIMILAR = 5, 75
#: Places of a signature: a prime, so that an element's steps over them are a permutation.
#: Bands of four places: at a similarity of 0.75 a pair shares none in 4 of a million cases.
PLACES, BANDS, ROWS = 131, 32, 4

_U = np.uint64
_FRACTION = float(2**-53)


def signature(elements: np.ndarray) -> np.ndarray:
    """The places of one set of 64-bit hashes; each is a rank plus a fraction below 1."""
    out = np.full(PLACES, np.inf)
    start = (mixed(elements + _U(0x632BE59BD9B4E019)) % _U(PLACES)).astype(np.int64)
    step = (mixed(elements + _U(0x8CB92BA72F3D8DD7)) % _U(PLACES - 1)).astype(np.int64) + 1
    for rank in range(PLACES):
        fraction = (mixed(elements + _U((rank + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) >> _U(11)) * _FRACTION
        np.minimum.at(out, (start + rank * step) % PLACES, rank + fraction)
        if out.max() < rank + 1:
            break
    return out


def bands(elements: np.ndarray) -> np.ndarray:
    """One 64-bit value for each band."""
    places = signature(elements)[: BANDS * ROWS].view(np.uint64).reshape(BANDS, ROWS)
    total = np.arange(BANDS, dtype=np.uint64) + _U(1)
    for k in range(ROWS):
        total = mixed(total * _U(0xD6E8FEB86659FD93) + places[:, k])
    return total.view(np.int64)


def profiles(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, bands) of every document. d1 and d2 stand for the set:
    documents with the same three values have the same shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, ends in blocks(batch.column("text")):
                sets = list(Words(data, ends).shingles(SHINGLE))
                signed = [bands(s) if len(s) else None for s in sets]
                columns = [
                    batch.column("doc_id").slice(lo, hi - lo),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(np.array([mixed(s).sum(dtype=np.uint64) for s in sets], dtype=np.uint64).view(np.int64)),
                    pa.array(np.array([mixed(s * _U(0x9E3779B97F4A7C15) + _U(7)).sum(dtype=np.uint64) for s in sets], dtype=np.uint64).view(np.int64)),
                    pa.array(signed, pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "d1", "d2", "bands"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, shingles): the sorted set of every document's shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, ends in blocks(batch.column("text")):
                sets = [s.view(np.int64) for s in Words(data, ends).shingles(SHINGLE)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "shingles"])

    return docs.mapInArrow(run, "doc_id long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough. Sets that are too different in size
    are not looked at."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * shared >= SIMILAR * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def _right_size(na: Column, nb: Column) -> Column:
    return 100 * F.least(na, nb) >= SIMILAR * F.greatest(na, nb)


#: Documents and shingles of a block of an open family, at most about.
BLOCK_DOCS, BLOCK_SHINGLES = 2048, 1_000_000


def _compared(rows: pa.Table) -> pa.Table:
    """Links between the documents of side 0 and side 1 that lie in different components:
    one for each two components that meet. Every pair is compared on its full sets."""
    side = rows.column("side").to_numpy()
    lists = rows.column("shingles").combine_chunks()
    sizes = lists.value_lengths().to_numpy().astype(np.int64)
    _, codes = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    ids, groups = rows.column("doc_id").to_numpy(), rows.column("component").to_numpy()
    right = np.flatnonzero(side == 1)
    links: list[tuple[int, int]] = []
    if len(right):
        flat = np.concatenate([codes[ends[j] : ends[j + 1]] for j in right])
        starts = np.concatenate(([0], np.cumsum(sizes[right])))[:-1]
        held = np.zeros(codes.max() + 1, dtype=np.int32)
        parent: dict[int, int] = {}
        for i in np.flatnonzero(side == 0):
            mine = codes[ends[i] : ends[i + 1]]
            held[mine] = 1
            shared = np.add.reduceat(held[flat], starts)
            held[mine] = 0
            alike = (100 * shared >= SIMILAR * (sizes[right] + sizes[i] - shared)) & (groups[right] != groups[i])
            for j in right[alike]:
                if find(parent, int(groups[i])) != find(parent, int(groups[j])):
                    union(parent, int(groups[i]), int(groups[j]))
                    links.append((int(ids[i]), int(ids[j])))
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


def open_links(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that are still missing between components which share a band value.

    ``placed`` has (band, rep, component). Components that meet in a band form a family;
    its documents outside the largest component are compared, block by block, with all
    its documents. No pair leaves a task but the links.
    """
    meeting = placed.groupBy("band").agg(F.min("component").alias("a"), F.max("component").alias("z")).where("a < z").select("band", "a")
    still = stored(placed.join(meeting, "band").select("rep", "component", "a").distinct(), "open")
    families = components(still.select("a", F.col("component").alias("b")).distinct()).select(F.col("node").alias("component"), F.col("component").alias("family"))
    docs = still.select("rep", "component").distinct().join(families.union(families.select("family", "family")).distinct(), "component")
    docs = docs.join(sets.select(F.col("doc_id").alias("rep"), "shingles"), "rep").withColumn("n", F.size("shingles"))
    docs = stored(docs, "open")
    size = docs.groupBy("family", "component").agg(F.count("*").alias("k"), F.sum("n").alias("s"))
    blocks = lambda k, s: F.ceil(F.greatest(k / BLOCK_DOCS, s / BLOCK_SHINGLES, F.lit(1))).cast("int")
    top = F.max(F.struct("k", "component", "s"))
    sized = size.groupBy("family").agg(top.alias("top"), F.sum("k").alias("k"), F.sum("s").alias("s")).select(
        "family",
        F.col("top.component").alias("largest"),
        blocks(F.col("top.k"), F.col("top.s")).alias("inner"),
        blocks(F.col("k") - F.col("top.k"), F.col("s") - F.col("top.s")).alias("outer"),
    )
    known = docs.join(sized, "family").withColumn("outside", F.col("component") != F.col("largest"))
    known = known.withColumn("block", F.pmod(F.xxhash64("rep"), F.when(F.col("outside"), F.col("outer")).otherwise(F.col("inner"))).cast("int"))
    upto = lambda lo, n: F.when(n > lo, F.sequence(lo, n - 1)).otherwise(F.array().cast("array<int>"))
    zero, own = F.lit(0), F.col("block")
    partners = F.concat(
        F.transform(upto(own, F.col("outer")), lambda j: F.struct(F.lit(True).alias("out"), j.alias("yb"))),
        F.transform(upto(zero, F.col("inner")), lambda j: F.struct(F.lit(False).alias("out"), j.alias("yb"))),
    )
    what = [F.col("rep").alias("doc_id"), "component", "shingles"]
    left = known.where("outside").select("family", own.alias("xb"), F.explode(partners).alias("y"), F.lit(0).alias("side"), *what).select("family", "xb", "y.out", "y.yb", "side", "doc_id", "component", "shingles")
    wanted = F.when(F.col("outside"), F.sequence(zero, own)).otherwise(upto(zero, F.col("outer")))
    right = known.select("family", F.explode(wanted).alias("xb"), F.col("outside").alias("out"), own.alias("yb"), F.lit(1).alias("side"), *what)
    return left.unionByName(right).groupBy("family", "xb", "out", "yb").applyInArrow(_compared, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest id that a document reaches over links.

    1. Documents with equal sets become one (counted before the shuffle, so the largest
       group costs a row per task); the smallest id stands for them.
    2. Each band value's documents are linked to the smallest of them, after a check of the
       full sets. Components of these links are found.
    3. Where a band value still holds several components, ``open_links`` compares what is
       left. After that no two documents that share a band value are left unchecked in
       different components.

    Texts without words, null ones included, are linked with nothing, and so are rows
    without an id. Repeated rows come back as often; rows with one id and different texts
    stand for one node of the graph. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = stored(profiles(docs), "profiles")
    real = found.where("n_shingles > 0 and doc_id is not null")
    same = ["n_shingles", "d1", "d2"]
    groups = real.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"))
    copies = real.join(groups.where("rep < last"), same).where("doc_id <> rep").select(F.col("doc_id").alias("copy"), "rep").distinct()
    copies = stored(copies, "copies")
    reps = real.join(copies.select(F.col("copy").alias("doc_id")).distinct(), "doc_id", "left_anti")
    reps = reps.select(F.col("doc_id").alias("rep"), "n_shingles", "bands")
    keyed = reps.select("rep", F.explode("bands").alias("band"))
    buckets = keyed.groupBy("band").agg(F.min("rep").alias("centre"), F.max("rep").alias("last")).where("centre < last").select("band", "centre")
    members = stored(keyed.join(buckets, "band"), "members")
    sizes = reps.select("rep", "n_shingles").distinct()
    of = lambda c: sizes.select(F.col("rep").alias(c), F.col("n_shingles").alias(f"n{c}"))
    pairs = members.where("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
    pairs = pairs.join(of("a"), "a").join(of("b"), "b").where(_right_size(F.col("na"), F.col("nb"))).select("a", "b")
    involved = members.select(F.col("rep").alias("doc_id")).distinct()
    sets = stored(shingle_sets(docs.join(involved, "doc_id", "left_semi")).distinct(), "sets")
    links = stored(confirmed(pairs, sets), "links")
    joined = stored(components(links), "joined")
    placed = members.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("band", "rep", F.coalesce("component", "rep").alias("component"))
    more = stored(open_links(placed, sets), "links")
    every = links.unionByName(more).unionByName(copies.select(F.col("rep").alias("a"), F.col("copy").alias("b")))
    labels = components(every)
    return found.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def duplicates_report(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_duplicates(docs: DataFrame) -> DataFrame:
    """One document of every group, with all its columns: the one with the smallest id.
    Rows that repeat an id whole become one."""
    gone = duplicates_report(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.dropDuplicates(["doc_id", "text"]).join(gone, "doc_id", "left_anti").select(*docs.columns)
