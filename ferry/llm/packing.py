"""Documents packed into token sequences, shortest pack first over the length histogram."""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferry.llm.shared import stored

#: Tokens of a sequence, and the id that ends a document.
SEQUENCE, END = 2048, 1
#: Pieces that one task ranks, about: hot lengths are split over more salts as data grows.
RANKED = 10_000
#: Share of padding above which pieces are cut to fill gaps.
PADDING = 0.01

# How byte-level vocabularies cut text into pieces, and the bytes that
# they spell as themselves (all others are spelled from code point 256 on).
CUT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PLAIN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]

_BEYOND_LATIN = re.compile("[^\x00-ɏ]")
#: tiktoken's pattern engine runs out of stack in a white-space run of about a million.
_LONG_BLANK = re.compile(r"(?<!\s)\s{100000}")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Token ids of a vocabulary file. Its ids are read by the tokenizers library; texts of
    Latin script go through tiktoken with the same vocabulary, which gives the same ids
    about five times as fast but cannot take very long runs of white space or added tokens. A probe checks that, else all texts take the first way."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        spelled = {chr(b): b for b in PLAIN_BYTES} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in PLAIN_BYTES)}
        with open(path, encoding="utf-8") as file:
            given = json.load(file)
        model, added = given["model"], [t["content"] for t in given.get("added_tokens") or []]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        ranks = {bytes(spelled[c] for c in word): i for word, i in model["vocab"].items() if all(c in spelled for c in word) and not re.fullmatch(r"<\|.*\|>", word)}
        self.fast = tiktoken.Encoding("given", pat_str=CUT, mergeable_ranks=ranks, special_tokens={})
        probe = "Don't  pack 1234 naïve cafés,\n\n  <|endof text|> x_y!!  \tüber-große ñandú's \x00 ÀÉ"
        self.same = self.fast.encode_ordinary(probe) == self.exact.encode(probe, add_special_tokens=False).ids

    def __call__(self, text: str) -> np.ndarray:
        long = len(text) >= 100_000 and _LONG_BLANK.search(text)
        if self.same and not long and not _BEYOND_LATIN.search(text) and not (self.added and self.added.search(text)):
            ids = self.fast.encode_ordinary(text)
        else:
            ids = self.exact.encode(text, add_special_tokens=False).ids
        return np.array([*ids, END], dtype="<u4")


def tokenize(docs: DataFrame, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: all full ones and what is left, (doc_id, start, length,
    ids_crc32, doc_tokens) and on request the ids themselves. The ids of a text end with
    ``END``, so null and empty texts are one token long."""
    path = tokenizer or default_tokenizer()
    kind = docs.schema["doc_id"].dataType
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for batch in batches:
            encode = encode or Encoder(path)
            out: dict[str, list] = {n: [] for n in names}
            texts = batch.column("text")
            for i in range(batch.num_rows):
                ids = encode(texts[i].as_py() or "")
                for start in range(0, len(ids), SEQUENCE):
                    piece = ids[start : start + SEQUENCE]
                    row = (i, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), piece.astype(np.int32))
                    for n, v in zip(names, row, strict=False):
                        out[n].append(v)
            taken = batch.column("doc_id").take(pa.array(out["doc_id"], pa.int32()))
            longs = [pa.array(out[n], pa.int64()) for n in names[1:5]]
            lists = [pa.array(out["ids"], pa.list_(pa.int32()))] if with_ids else []
            yield pa.RecordBatch.from_arrays([taken, *longs, *lists], names=names)

    fields = [T.StructField("doc_id", kind)] + [T.StructField(n, T.LongType()) for n in names[1:5]]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, T.StructType(fields))


#: A part of a pattern: (length of the piece, rank of the first such piece, start in the
#: piece, ids taken). A pattern that stands for n packs holds n pieces of each part, with
#: ranks in a row.
Part = tuple[int, int, int, int]


class Packs:
    """Patterns with counts, by the space left. Its size follows the number of different
    lengths, not of documents."""

    def __init__(self):
        self.by_space: dict[int, list[tuple[tuple[Part, ...], int]]] = defaultdict(list)

    def add(self, parts: tuple[Part, ...], count: int, space: int) -> None:
        if count:
            self.by_space[space].append((parts, count))

    def take(self, space: int, most: int) -> tuple[tuple[Part, ...], int]:
        """Removes up to ``most`` packs of one pattern."""
        parts, count = self.by_space[space].pop()
        n = min(count, most)
        self.add(tuple((length, rank + n, start, taken) for length, rank, start, taken in parts), count - n, space)
        if not self.by_space[space]:
            del self.by_space[space]
        return parts, n

    def widest(self, least: int) -> int | None:
        space = max(self.by_space, default=0)
        return space if space >= least else None

    def tightest(self, least: int) -> int | None:
        return min((s for s in self.by_space if s >= least), default=None)

    def gaps(self) -> int:
        return sum(space * n for space, held in self.by_space.items() for _, n in held)


def shortest_pack_first(histogram: dict[int, int]) -> Packs:
    """Lengths longest first, each into the pack that holds least so far, if it fits there."""
    packs = Packs()
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left and (space := packs.widest(length)) is not None:
            parts, n = packs.take(space, left)
            packs.add((*parts, (length, rank, 0, length)), n, space - length)
            rank, left = rank + n, left - n
        packs.add(((length, rank, 0, length),), left, SEQUENCE - length)
    return packs


def fill_gaps(packs: Packs, tokens: int) -> None:
    """Takes the emptiest packs apart and puts their pieces into the gaps of the others:
    whole where one fits, else cut. As many as it takes to bring the gaps down to
    ``PADDING`` of all tokens; lengths that pack well by themselves are never cut."""
    loose: list[tuple[Part, int]] = []
    apart = max(0, packs.gaps() - int(PADDING * tokens)) // SEQUENCE
    while apart:
        parts, n = packs.take(packs.widest(1), apart)
        loose += [(part, n) for part in parts]
        apart -= n
    loose.sort(key=lambda x: x[0][3])
    while loose:
        (length, rank, start, size), left = loose.pop()
        while left:
            space = packs.tightest(size) or packs.widest(1)
            parts, n = packs.take(space, left)
            taken = min(size, space)
            packs.add((*parts, (length, rank, start, taken)), n, space - taken)
            if taken < size:
                loose.append(((length, rank, start + taken, size - taken), n))
            rank, left = rank + n, left - n


def plan(histogram: dict[int, int]) -> list[tuple[int, ...]]:
    """Slots (length, first, last, part_start, part_length, sequence, offset): piece ``first + i``
    of that length puts those of its ids into sequence ``sequence + i`` from ``offset`` on."""
    packs = shortest_pack_first(histogram)
    fill_gaps(packs, sum(length * n for length, n in histogram.items()))
    slots, sequence = [], 0
    for space in sorted(packs.by_space):
        for parts, n in packs.by_space[space]:
            offset = 0
            for length, rank, start, taken in parts:
                slots.append((length, rank, rank + n, start, taken, sequence, offset))
                offset += taken
            sequence += n
    return slots


SLOTS = "length long, first long, last long, part_start long, part_length long, sequence long, offset long"
KEY = ["doc_id", "start", "ids_crc32", "doc_tokens"]


def ranked(pieces: DataFrame, total: int) -> DataFrame:
    """Adds ``rank``, from 0 without gaps within each length. Pieces of a length are ranked
    in salts, and a salt's first rank is the number of pieces in the salts before it."""
    salts = max(1, total // RANKED)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(*KEY), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    firsts = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy(*KEY)
    return salted.withColumn("place", F.row_number().over(within)).join(firsts, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("place") - 1).drop("salt", "before", "place")


def pack(docs: DataFrame, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents in sequences of ``SEQUENCE`` ids: doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset, and on request ids.

    Texts are tokenized once and the pieces stored. Their lengths are counted, the plan is
    made from the counts (at most ``SEQUENCE`` rows), and pieces find their slot by rank.
    Texts of cut pieces, and all if ids are asked for, are tokenized once more; where the
    plan cuts nothing, no text is read twice.

    Null and empty texts are one piece of one id; repeated rows are packed as often as they
    come; equal lengths are ranked by id; an empty table gives no rows; columns other
    than doc_id and text are not read.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    pieces = stored(tokenize(docs, tokenizer), "pieces")
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    planned = plan(histogram)
    slots = spark.createDataFrame(planned, SLOTS)
    p, s = ranked(pieces, sum(histogram.values())).alias("p"), F.broadcast(slots).alias("s")
    there = (F.col("p.length") == F.col("s.length")) & (F.col("p.rank") >= F.col("s.first")) & (F.col("p.rank") < F.col("s.last"))
    placed = p.join(s, there).select(*[F.col(f"p.{c}") for c in KEY], F.col("p.length").alias("whole"), "part_start", "part_length", (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")
    named = [F.col("doc_id"), (F.col("start") + F.col("part_start")).alias("start"), F.col("part_length").alias("length")]
    rest = [F.col("doc_tokens"), F.col("sequence_id"), F.col("offset")]
    if not with_ids and all(length == taken for length, _, _, _, taken, _, _ in planned):
        return placed.select(*named, "ids_crc32", *rest)
    placed = stored(placed, "placed")
    cut = F.lit(True) if with_ids else F.col("part_length") < F.col("whole")
    again = placed.where(cut)
    wanted = again.select(F.col("doc_id").alias("_id")).distinct()
    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    ids = tokenize(texts, tokenizer, with_ids=True).dropDuplicates(KEY)
    same = F.lit(True)
    for c in KEY:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"i.{c}"))
    parts = again.alias("a").join(ids.alias("i"), same).select("a.*", F.slice("i.ids", F.col("part_start").cast("int") + 1, F.col("part_length").cast("int")).alias("ids"))
    # Ids as little-endian 32-bit values: the bytes of the big-endian hex text, turned.
    byte = lambda x, k: F.substring(F.lpad(F.hex(x), 8, "0"), 7 - 2 * k, 2)
    spelled = F.array_join(F.transform("ids", lambda x: F.concat(*[byte(x, k) for k in range(4)])), "")
    parts = parts.select(*named, F.crc32(F.unhex(spelled)).alias("ids_crc32"), *rest, *[F.col("ids")] * with_ids)
    if with_ids:
        return parts
    return placed.where(~cut).select(*named, "ids_crc32", *rest).unionByName(parts)
