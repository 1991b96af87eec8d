"""A blocked Bloom filter over 64-bit hashes, as rows of Spark and as an array of numpy.

A hash names one block of 256 bits by its low bits and sets eight bits there, two in each
of four 64-bit words, by its high bits. The number of blocks follows the number of keys
up to a fixed most, so the filter has a proven size; beyond it more keys pass by mistake,
and none is ever lost.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits given to a key while the filter may grow, and the most blocks (32 MiB of bits).
BITS_A_KEY, MOST_BLOCKS = 16, 1 << 20
_WORDS = 4


def blocks_for(keys: int) -> int:
    """A power of two that gives every key its bits, within the most blocks."""
    wanted = max(1, -(-keys * BITS_A_KEY // 256))
    return min(1 << (wanted - 1).bit_length(), MOST_BLOCKS)


def _block(key: Column, blocks: int) -> Column:
    return key.bitwiseAND(F.lit(blocks - 1).cast("long"))


def _masks(key: Column) -> list[Column]:
    def bit(i: int) -> Column:
        place = F.shiftrightunsigned(key, 16 + 6 * i).bitwiseAND(F.lit(63).cast("long"))
        return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))

    return [bit(2 * i).bitwiseOR(bit(2 * i + 1)) for i in range(_WORDS)]


def filter_rows(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, w0, w1, w2, w3): one row for each block that holds a key."""
    parts = keys.select(_block(F.col(key), blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(_masks(F.col(key)))])
    return parts.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(_WORDS)])


def marked(df: DataFrame, key: str, name: str, bloom: DataFrame, blocks: int) -> DataFrame:
    """Adds the boolean ``name``: false means that the filter cannot hold the key (a null
    key: false). The filter is broadcast; it has at most ``MOST_BLOCKS`` rows."""
    here = bloom.select(F.col("block").alias("_block"), *[F.col(f"w{i}").alias(f"_w{i}") for i in range(_WORDS)])
    joined = df.join(F.broadcast(here), _block(F.col(key), blocks) == F.col("_block"), "left")
    holds = [F.col(f"_w{i}").bitwiseAND(mask) == mask for i, mask in enumerate(_masks(F.col(key)))]
    passes = F.coalesce(holds[0] & holds[1] & holds[2] & holds[3], F.lit(False))
    return joined.withColumn(name, passes).drop("_block", *[f"_w{i}" for i in range(_WORDS)])


def filter_array(bloom: DataFrame, blocks: int) -> np.ndarray:
    """The filter as ``blocks`` rows of four words; the driver gets at most its fixed size."""
    words = np.zeros((blocks, _WORDS), dtype=np.int64)
    found = bloom.toArrow()
    if found.num_rows:
        at = found.column("block").to_numpy()
        for i in range(_WORDS):
            words[at, i] = found.column(f"w{i}").to_numpy()
    return words.view(np.uint64)


def may_hold(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For every key (uint64) whether the filter may hold it."""
    rows = (keys & np.uint64(len(words) - 1)).astype(np.int64)
    passes = np.ones(len(keys), dtype=bool)
    for i in range(_WORDS):
        mask = np.zeros(len(keys), dtype=np.uint64)
        for j in (2 * i, 2 * i + 1):
            mask |= np.uint64(1) << ((keys >> np.uint64(16 + 6 * j)) & np.uint64(63))
        passes &= words[rows, i] & mask == mask
    return passes
