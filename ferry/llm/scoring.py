"""What the learned document scores share: labelled samples and per-text features in tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferry.llm.shared import remainder


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, label) of the documents that a model may learn from: ids whose crc32
    leaves a remainder by 5, the ``most`` first by hash. A document with several labels
    gets the smallest; null labels and ids do not count."""
    one = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    allowed = one.where(remainder(F.col("doc_id"), 5) != 0)
    first = allowed.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(most)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(first), "doc_id")


def with_features(docs: DataFrame, features: Callable[[str], np.ndarray], carry: tuple[str, ...]) -> DataFrame:
    """Adds ``features``, an array of doubles, to every row. Null texts are empty."""
    columns = list(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py() or "") for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(found, pa.list_(pa.float64()))], names=[*columns, "features"])

    inner = docs.select(*columns, F.col("text").cast("string").alias("_text"))
    return inner.mapInArrow(run, T.StructType([docs.schema[c] for c in columns] + [T.StructField("features", T.ArrayType(T.DoubleType()))]))


def scored(docs: DataFrame, score: Callable[[list[str]], np.ndarray], carry: tuple[str, ...]) -> DataFrame:
    """Adds ``score`` (0 to 1) to every row; ``score`` takes the texts of a batch."""
    columns = list(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                found = score([t.as_py() or "" for t in part.column("_text")])
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], pa.array(np.clip(found, 0, 1), pa.float64())], names=[*columns, "score"])

    inner = docs.select(*columns, F.col("text").cast("string").alias("_text"))
    return inner.mapInArrow(run, T.StructType([docs.schema[c] for c in columns] + [T.StructField("score", T.DoubleType())]))


def collected(sample: DataFrame, features: Callable[[str], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a bounded sample, in an order that does not depend on tasks."""
    rows = sorted((r.doc_id, tuple(r.features), r.label) for r in with_features(sample, features, ("doc_id", "label")).collect())
    return np.array([r[1] for r in rows], dtype=float), np.array([r[2] for r in rows], dtype=float)


def report(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
