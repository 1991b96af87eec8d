"""Language by string kernels: presence of byte n-grams, Nyström landmarks, ridge regression.

The kernel of two texts is the number of n-gram buckets they share over the root of the
product of their bucket counts (n-grams of one to four bytes, upper case folded). It is
an inner product of sparse 0/1 vectors, so a text's kernel values with all landmarks are
one matrix product, and so is their product with the regression weights. Both matrices
are multiplied once, which leaves one weight per bucket and language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferry.llm.arrays import LOWER, blocks
from ferry.llm.shared import remainder

#: n-grams are counted present in 2 ** BITS buckets.
BITS = 14
GRAMS = (1, 2, 3, 4)
#: Labelled documents that the model is fitted on, at most, per language and in all, and
#: the kernel's landmarks among them. The fit is a classifier's; scoring covers every text.
TRAINING, MOST, LANDMARKS, RIDGE = 704, 4000, 256, 1e-2
#: A language's documents are ranked in so many parts, which share its number evenly.
PARTS = 16
UNDETERMINED = "und"
#: Rows of the fit that are dense at once.
DENSE = 128


def presence(data: np.ndarray) -> np.ndarray:
    """Buckets of the n-grams of one text's bytes, each once."""
    there = np.zeros(1 << BITS, dtype=bool)
    folded = LOWER[data].astype(np.uint32)
    code = np.zeros(len(folded), dtype=np.uint32)
    for n in range(1, max(GRAMS) + 1):
        code = (code[:-1] if n > 1 else code) * np.uint32(257) + folded[n - 1 :] + np.uint32(1) if len(folded) >= n else code[:0]
        if n in GRAMS and len(code):
            there[(code * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(32 - BITS)] = True
    return np.flatnonzero(there)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # buckets x languages
    bias: np.ndarray

    def predict(self, buckets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Place of the best language and its score, for each text's buckets."""
        sizes = np.array([len(b) for b in buckets])
        flat = np.concatenate(buckets) if len(buckets) else np.zeros(0, np.int64)
        sums = np.zeros((len(buckets), len(self.languages)))
        full = sizes > 0
        if full.any():
            at = np.concatenate(([0], np.cumsum(sizes)))[:-1][full]
            sums[full] = np.add.reduceat(self.weights[flat], at, axis=0)
        raw = sums / np.sqrt(np.maximum(sizes, 1))[:, None] + self.bias
        best = raw.argmax(axis=1)
        odds = np.exp(4 * (raw - raw.max(axis=1, keepdims=True)))
        return best, 1 / odds.sum(axis=1)


def _rows(buckets: list[np.ndarray]) -> np.ndarray:
    """One row of unit length for each text."""
    rows = np.zeros((len(buckets), 1 << BITS), dtype=np.float32)
    for row, b in zip(rows, buckets, strict=True):
        row[b] = 1 / np.sqrt(max(len(b), 1))
    return rows


def fit(buckets: list[np.ndarray], languages: list[str]) -> Model:
    """One-versus-rest kernel ridge regression on Nyström features."""
    names = sorted(set(languages))
    target = np.array([[1.0 if name == mine else -1.0 for name in names] for mine in languages])
    chosen = np.linspace(0, len(buckets) - 1, min(LANDMARKS, len(buckets))).astype(int)
    marks = _rows([buckets[i] for i in chosen])
    among = (marks @ marks.T).astype(float)
    # Only a few rows are dense at a time; what stays are the kernel values.
    kernel = np.concatenate([_rows(buckets[lo : lo + DENSE]) @ marks.T for lo in range(0, len(buckets), DENSE)]).astype(float)
    values, vectors = np.linalg.eigh(among)
    kept = values > 1e-8 * values.max()
    root = vectors[:, kept] / np.sqrt(values[kept])
    features = kernel @ root
    mean, bias = features.mean(axis=0), target.mean(axis=0)
    centred = features - mean
    solved = np.linalg.solve(centred.T @ centred + RIDGE * len(buckets) * np.eye(centred.shape[1]), centred.T @ (target - bias))
    return Model(names, marks.T.astype(float) @ (root @ solved), bias - mean @ solved)


def training_sample(docs: DataFrame, per_language: int = TRAINING, most: int = MOST) -> DataFrame:
    """The labelled documents that come first by hash in each of ``PARTS`` parts of each
    language, ``per_language`` and ``most`` in all at most, among those whose id's crc32
    leaves a remainder by 5. A row that repeats counts once."""
    labelled = docs.select("doc_id", "text", "lang", F.xxhash64("doc_id", "text").alias("key")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id"), 5) != 0))
    order = Window.partitionBy("lang", F.pmod("key", F.lit(PARTS))).orderBy("key")
    # The rank limit runs on each partition before the shuffle as well.
    keys = labelled.select("lang", "doc_id", "key").withColumn("rank", F.row_number().over(order))
    first = keys.where(F.col("rank") <= max(1, per_language // PARTS)).orderBy("rank", "lang", "key").limit(most).select("doc_id", "lang", "key").distinct()
    return labelled.join(F.broadcast(first), ["doc_id", "lang", "key"]).dropDuplicates(["doc_id", "lang", "key"]).drop("key")


def train(docs: DataFrame) -> Model:
    """Fits on the sample's n-gram buckets; texts stay on the executors."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, ends in blocks(batch.column("text")):
                got = [presence(data[ends[i] : ends[i + 1]]).astype(np.int16) for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("lang").slice(lo, hi - lo), pa.array([g.tobytes() for g in got], pa.binary())], names=["doc_id", "lang", "buckets"])

    sample = training_sample(docs)
    id_type = sample.schema["doc_id"].dataType
    rows = sample.mapInArrow(found, T.StructType([T.StructField("doc_id", id_type), T.StructField("lang", T.StringType()), T.StructField("buckets", T.BinaryType())]))
    known = sorted(rows.collect(), key=lambda r: (r.doc_id, r.buckets))
    known = [r for r in known if len(r.buckets)]
    if not known:
        return Model([], np.zeros((1 << BITS, 0)), np.zeros(0))
    return fit([np.frombuffer(r.buckets, np.int16) for r in known], [r.lang for r in known])


def classify(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds lang_pred and score to every row; of the input only ``carry`` and text are read.

    Null texts, texts without a letter, and all texts when nothing could be learned, get
    ``und`` and score 0. Ties go to the language that sorts first. Repeated rows stay,
    an empty table gives no rows, texts of any length are read whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights, model.bias))
    columns = list(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = Model(*shared.value)
        for batch in batches:
            texts = batch.column("_text")
            for lo, hi, data, ends in blocks(texts):
                best, score = ["und"] * (hi - lo), np.zeros(hi - lo)
                if learned.languages:
                    place, sure = learned.predict([presence(data[ends[i] : ends[i + 1]]) for i in range(hi - lo)])
                    lettered = np.array([t is not None and any(map(str.isalpha, t)) for t in texts.slice(lo, hi - lo).to_pylist()])
                    best = [learned.languages[p] if ok else UNDETERMINED for p, ok in zip(place, lettered, strict=True)]
                    score = np.where(lettered, sure, 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(lo, hi - lo) for c in columns] + [pa.array(best, pa.string()), pa.array(score, pa.float64())], names=[*columns, "lang_pred", "score"])

    inner = docs.select(*columns, F.col("text").cast("string").alias("_text"))
    schema = T.StructType([docs.schema[c] for c in columns] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return inner.mapInArrow(run, schema)


def language_report(docs: DataFrame) -> DataFrame:
    """Predictions for all documents by a model learned from the other four fifths."""
    found = classify(docs, train(docs))
    return found.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def with_known_language(docs: DataFrame) -> DataFrame:
    """Documents whose text has a language; those without a letter go."""
    columns = docs.columns
    # Under names of their own, no column can clash with what is added.
    numbered = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(columns)], F.col("text").alias("text"))
    found = classify(numbered, train(docs), carry=tuple(f"_c{i}" for i in range(len(columns))))
    return found.where(F.col("lang_pred") != UNDETERMINED).select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(columns)])
