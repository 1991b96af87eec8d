"""Phrase collocations by Rabin-Karp fingerprints.

Tasks hash every run of one to four words with prefix polynomials over whole buffers of
text; the shuffle adds up fingerprints with pointers to occurrences. Only what is frequent
is spelled out, from the texts that the pointers name.

A phrase cannot be frequent unless its parts are, so the lengths are counted one after
the other, and a filter of fixed size tells which parts may be frequent. What passes by
mistake costs shuffle, nothing else: the counts themselves are exact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferry.llm import blooms
from ferry.llm.shared import LOWER, UPPER, stored
from ferry.operators.ordered import newest_n

#: Words of the longest phrase, the least occurrences, and the rows told of each language.
LONGEST, FREQUENT, TOP = 4, 30, 2000
#: A phrase is dropped if a longer one holds it in this percentage of its occurrences.
COVERED = 80
SCALE = 2_000_000
UNKNOWN = "und"
PIECE_BREAKS, BLANKS = ".,;:!?\n\x0b\x0c\r", " \t"
#: Bytes of text hashed at once. A longer text is hashed alone.
CHUNK = 1 << 20
#: Bits of a fingerprint; tests lower it to make fingerprints collide.
FINGERPRINT_BITS = 64

_KINDS = np.zeros(256, dtype=np.uint8)
_KINDS[[ord(c) for c in BLANKS]] = 1
_KINDS[[ord(c) for c in PIECE_BREAKS]] = 2
_END_OF_TEXT = np.uint8(0xFF)  # no byte of UTF-8
_KINDS[_END_OF_TEXT] = 2
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[ord("A") : ord("Z") + 1] += 32
_WORD = rb"[^ \t.,;:!?\n\x0b\x0c\r]+"
_SEPARATOR = re.compile(rb"[ \t.,;:!?\n\x0b\x0c\r]")
_TAIL = re.compile(rb"[ \t]*(?:" + _WORD + rb"[ \t]*){0,%d}" % (LONGEST - 1))
_RUNS = {n: re.compile(_WORD + (rb"(?:[ \t]+" + _WORD + rb"){%d}" % (n - 1))) for n in range(1, LONGEST + 1)}
#: Odd bases of the two polynomials over bytes and over words, modulo 2 ** 64.
_BASES = ((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93), (0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over the whole number, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1); kept for the next chunk unless it is a rare long one."""
    found = _POWERS.get(base)
    if found is None or len(found) < n:
        found = np.full(n + n // 8, base, dtype=np.uint64)
        found[:1] = 1
        np.multiply.accumulate(found, dtype=np.uint64, out=found)
        if n <= 2 * CHUNK:
            _POWERS[base] = found
    return found[:n]


class _Polynomial:
    """Hashes of any range of a sequence from one prefix sum: (P[hi] - P[lo]) / base ** lo."""

    def __init__(self, values: np.ndarray, base: int):
        self.prefix = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * _powers(base, len(values)), dtype=np.uint64, out=self.prefix[1:])
        self.inverse = pow(base, -1, 1 << 64)

    def ranges(self, lo: np.ndarray, hi: np.ndarray, inverses: np.ndarray) -> np.ndarray:
        return (self.prefix[hi] - self.prefix[lo]) * inverses[lo]


class Slice(NamedTuple):
    """Bytes of a text from ``base`` on. Runs that begin in the first ``owned`` bytes count here."""

    key: int
    body: bytes
    base: int
    owned: int


def slices(key: int, text: bytes) -> Iterator[Slice]:
    """The whole text, or cuts between words, each followed by the words that its last runs
    reach into."""
    base = 0
    while len(text) - base > 2 * CHUNK:
        cut = _SEPARATOR.search(text, base + CHUNK)
        if cut is None:
            break
        yield Slice(key, text[base : _TAIL.match(text, cut.start()).end()], base, cut.start() - base)
        base = cut.start()
    yield Slice(key, text[base:] if base else text, base, len(text) - base)


class Tokens(NamedTuple):
    """The words of several slices in one buffer: where they begin and end, the piece and
    the slice that they stand in, and their place in the whole text, -1 where not owned."""

    buffer: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    piece: np.ndarray
    text: np.ndarray
    at: np.ndarray


def tokens(parts: list[Slice]) -> Tokens:
    buffer = _SMALL[np.frombuffer(b"\xff".join([*[p.body for p in parts], b""]), dtype=np.uint8)]
    kinds = _KINDS[buffer]
    inside = np.zeros(len(buffer) + 2, dtype=np.int8)
    inside[1:-1] = kinds == 0
    edges = np.diff(inside)
    lo, hi = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    text = np.cumsum(buffer == _END_OF_TEXT, dtype=np.int64)[lo]
    begins = np.cumsum([0, *[len(p.body) + 1 for p in parts[:-1]]])
    here = lo - begins[text]
    at = np.where(here < np.array([p.owned for p in parts])[text], here + np.array([p.base for p in parts])[text], -1)
    return Tokens(buffer, lo, hi, np.cumsum(kinds == 2, dtype=np.int64)[lo], text, at)


class Grams:
    """Fingerprints of the word runs of one language's texts."""

    def __init__(self, found: Tokens, lang: str, seconds: bool = False):
        self.tokens, self.words = found, []
        name = np.frombuffer(lang.encode(), dtype=np.uint8).astype(np.uint64) + np.uint64(1)
        for over_bytes, over_words in _BASES[: 1 + seconds]:
            letters = _Polynomial(found.buffer.astype(np.uint64) + np.uint64(1), over_bytes)
            inverses = _powers(letters.inverse, len(found.buffer) + 1)
            hashes = _mixed(letters.ranges(found.lo, found.hi, inverses) + (found.hi - found.lo).astype(np.uint64))
            of_lang = _mixed(_Polynomial(name, over_bytes).prefix[-1:])
            words = _Polynomial(hashes, over_words)
            self.words.append((words, _powers(words.inverse, len(hashes) + 1), of_lang))

    def starts(self, length: int) -> np.ndarray:
        """Owned words that begin a run of ``length`` words within one piece."""
        at = np.arange(max(0, len(self.tokens.lo) - length + 1))
        return at[(self.tokens.piece[at] == self.tokens.piece[at + length - 1]) & (self.tokens.at[at] >= 0)]

    def fingerprints(self, at: np.ndarray, length: int, which: int = 0) -> np.ndarray:
        words, inverses, of_lang = self.words[which]
        found = _mixed(words.ranges(at, at + length, inverses) + of_lang * np.uint64(2 * length + 1))
        return found & np.uint64((1 << FINGERPRINT_BITS) - 1) if which == 0 and FINGERPRINT_BITS < 64 else found

    def candidates(self, length: int, parts: np.ndarray | None) -> np.ndarray:
        """Starts of the runs whose two longest parts may be frequent."""
        at = self.starts(length)
        if parts is None or not len(at):
            return at
        at = at[blooms.may_hold(parts, self.fingerprints(at, length - 1))]
        return at[blooms.may_hold(parts, self.fingerprints(at + 1, length - 1))]

    def phrase(self, at: int, length: int) -> str:
        t = self.tokens
        return " ".join(t.buffer[t.lo[i] : t.hi[i]].tobytes().decode() for i in range(at, at + length))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[Slice]]]:
    """Slices of one language each, in chunks of about ``CHUNK`` bytes. At most four chunks
    stay open, however many languages there are."""
    opened: dict[str, list[Slice]] = {}
    sizes: dict[str, int] = {}
    for batch in batches:
        for lang, key, text in zip(*[batch.column(n) for n in ("lang", "key", "text")]):
            lang = lang.as_py()
            for part in slices(key.as_py(), text.as_py()):
                opened.setdefault(lang, []).append(part)
                sizes[lang] = sizes.get(lang, 0) + len(part.body) + 1
                if sizes[lang] >= CHUNK or sum(sizes.values()) >= 4 * CHUNK:
                    fullest = max(sizes, key=lambda n: sizes[n])
                    del sizes[fullest]
                    yield fullest, opened.pop(fullest)
    yield from opened.items()


def _texts(docs: DataFrame) -> DataFrame:
    """(lang, key, text) of the texts that are not empty, as bytes. ``key`` is the hash of
    the text: rows of one text hold the same runs, so any of them serves a pointer."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN))
    text = F.make_valid_utf8(F.col("text").cast("string"))
    return docs.select(lang.alias("lang"), F.xxhash64(text).alias("key"), text.cast("binary").alias("text")).where(F.coalesce(text, F.lit("")) != "")


def _sorted(grams: Grams, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints in order, their starts, and where each distinct one begins."""
    fps = grams.fingerprints(at, length)
    order = np.argsort(fps, kind="stable")
    fps = fps[order]
    return fps.view(np.int64), at[order], np.flatnonzero(np.concatenate([[True], fps[1:] != fps[:-1]]))


def _records(lang: str, columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    rows = len(next(iter(columns.values())))
    for lo in range(0, rows, 100_000):
        parts = [pa.array(c[lo : lo + 100_000]) for c in columns.values()]
        langs = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(parts[0]), np.int32)), [lang]).cast(pa.string())
        yield pa.RecordBatch.from_arrays([langs, *parts], names=["lang", *columns])


def _counted(docs: DataFrame, length: int, parts: np.ndarray | None) -> DataFrame:
    """(lang, fp, n): occurrences of every fingerprint of ``length`` words whose parts may be
    frequent."""
    sent = None if parts is None else docs.sparkSession.sparkContext.broadcast(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, chunk in _chunks(batches):
            grams = Grams(tokens(chunk), lang)
            at = grams.candidates(length, None if sent is None else sent.value)
            if len(at):
                fps, _, heads = _sorted(grams, at, length)
                yield from _records(lang, {"fp": fps[heads], "n": np.diff(np.append(heads, len(fps)))})

    return _texts(docs).mapInArrow(run, "lang string, fp long, n long").groupBy("lang", "fp").agg(F.sum("n").alias("n"))


def _pointed(docs: DataFrame, frequent: list[np.ndarray]) -> DataFrame:
    """(lang, length, fp, low, high, first_key, first_at, last_key, last_at): of the
    fingerprints that may be frequent, the least and the greatest second fingerprint, and
    pointers (text, byte) to two occurrences."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, chunk in _chunks(batches):
            grams = Grams(tokens(chunk), lang, seconds=True)
            keys = np.array([p.key for p in chunk], dtype=np.int64)
            for length, parts in enumerate(sent.value, 1):
                at = grams.starts(length)
                at = at[blooms.may_hold(parts, grams.fingerprints(at, length))]
                if not len(at):
                    continue
                fps, at, heads = _sorted(grams, at, length)
                second, first = grams.fingerprints(at, length, 1).view(np.int64), at[heads]
                yield from _records(lang, {
                    "length": np.full(len(heads), length, np.int32), "fp": fps[heads],
                    "low": np.minimum.reduceat(second, heads), "high": np.maximum.reduceat(second, heads),
                    "key": keys[grams.tokens.text[first]], "at": grams.tokens.at[first],
                })

    partial = _texts(docs).mapInArrow(run, "lang string, length int, fp long, low long, high long, key long, at long")
    return partial.groupBy("lang", "length", "fp").agg(
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.min("key").alias("first_key"),
        F.min_by("at", "key").alias("first_at"),
        F.max("key").alias("last_key"),
        F.max_by("at", "key").alias("last_at"),
    )


def _filter_of(keys: DataFrame) -> np.ndarray:
    blocks = blooms.blocks_for(keys.count())
    return blooms.filter_array(blooms.filter_rows(keys, "fp", blocks), blocks)


def _spelled(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    """(lang, length, fp, n, low, high, phrase, other): the frequent fingerprints with the
    words that stand at their two pointers. Only texts that pointers name are shuffled."""
    ends = F.array(F.struct(F.col("first_key").alias("key"), F.col("first_at").alias("at")), F.struct(F.col("last_key").alias("key"), F.col("last_at").alias("at")))
    pointers = frequent.select("lang", "length", "fp", F.explode(ends).alias("p")).select("lang", "length", "fp", "p.*").distinct()
    wanted = stored(pointers.groupBy("lang", "key").agg(F.collect_set(F.struct("length", "fp", "at")).alias("wanted")), "wanted")
    blocks = blooms.blocks_for(wanted.count())
    # Copies of a text are one text, before the join already.
    named = blooms.marked(_texts(docs), "key", "_named", blooms.filter_rows(wanted, "key", blocks), blocks).where("_named")
    texts = named.select("lang", "key", "text").distinct().join(wanted, ["lang", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text, wanted in zip(*[batch.column(n) for n in ("lang", "text", "wanted")]):
                lang, body, rows = lang.as_py(), text.as_py(), wanted.as_py()
                for length in range(1, LONGEST + 1):
                    asked = [r for r in rows if r["length"] == length]
                    runs = [_RUNS[length].match(body, r["at"]) for r in asked]
                    found = [(r["fp"], m.group()) for r, m in zip(asked, runs) if m]
                    if not found:
                        continue
                    grams = Grams(tokens([Slice(0, m, 0, len(m)) for _, m in found]), lang)
                    first = np.arange(len(found)) * length
                    # A text whose key another text shares does not hold the run that is asked for.
                    same = grams.fingerprints(first, length).view(np.int64) == np.array([fp for fp, _ in found])
                    phrases = [grams.phrase(int(i), length) for i in first[same]]
                    n = len(phrases)
                    fps = pa.array([fp for (fp, _), ok in zip(found, same) if ok], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([length] * n, pa.int32()), fps, pa.array(phrases, pa.string())], names=["lang", "length", "fp", "phrase"])

    read = texts.mapInArrow(run, "lang string, length int, fp long, phrase string")
    spelled = read.groupBy("lang", "length", "fp").agg(F.min("phrase").alias("phrase"), F.max("phrase").alias("other"))
    return frequent.join(spelled, ["lang", "length", "fp"]).select("lang", "length", "fp", "n", "low", "high", "phrase", "other")


def _recounted(docs: DataFrame, collided: DataFrame) -> DataFrame:
    """(lang, length, phrase, n) of the fingerprints that stand for several phrases, counted
    by their words. The scan sends only runs that a filter of these fingerprints passes."""
    parts = docs.sparkSession.sparkContext.broadcast(_filter_of(collided))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, parts_here in _chunks(batches):
            grams = Grams(tokens(parts_here), lang)
            for length in range(1, LONGEST + 1):
                at = grams.starts(length)
                at = at[blooms.may_hold(parts.value, grams.fingerprints(at, length))] if len(at) else at
                fps = grams.fingerprints(at, length).view(np.int64)
                for lo in range(0, len(at), 10_000):
                    phrases = [grams.phrase(int(i), length) for i in at[lo : lo + 10_000]]
                    n = len(phrases)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * n), pa.array([length] * n, pa.int32()), pa.array(fps[lo : lo + n]), pa.array(phrases)], names=["lang", "length", "fp", "phrase"])

    runs = _texts(docs).mapInArrow(run, "lang string, length int, fp long, phrase string")
    counts = runs.groupBy("lang", "length", "fp", "phrase").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(collided, ["lang", "length", "fp"], "left_semi").select("lang", "length", "phrase", "n")


def frequent_phrases(docs: DataFrame, least: int = FREQUENT) -> tuple[DataFrame, DataFrame]:
    """(lang, length, phrase, n) of all phrases of one to four words with ``least``
    occurrences or more in a language, and (lang, words) with the words of each language."""
    levels, filters, sizes = [], [], None
    for length in range(1, LONGEST + 1):
        counted = _counted(docs, length, filters[-1] if filters else None)
        if length == 1:
            # All words once: their number per language comes from the same counts.
            counted = stored(counted, "words")
            sizes = counted.groupBy("lang").agg(F.sum("n").alias("words"))
        level = stored(counted.where(F.col("n") >= least).withColumn("length", F.lit(length)), "level")
        levels.append(level)
        filters.append(_filter_of(level))
    frequent = levels[0]
    for level in levels[1:]:
        frequent = frequent.unionByName(level)
    frequent = stored(frequent.join(_pointed(docs, filters), ["lang", "length", "fp"]), "frequent")
    spelled = stored(_spelled(docs, frequent), "spelled")
    one = (F.col("low") == F.col("high")) & (F.col("phrase") == F.col("other"))
    whole = spelled.where(one).select("lang", "length", "phrase", "n")
    collided = spelled.where(~one).select("lang", "length", "fp")
    if not collided.isEmpty():
        whole = whole.unionByName(_recounted(docs, collided).where(F.col("n") >= least))
    return stored(whole, "phrases"), sizes


def _cuts(candidates: DataFrame, phrases: DataFrame) -> DataFrame:
    """Every candidate with l, r and score of its lowest cut. Scores are whole numbers of
    any size: decimals, divided without a fraction."""
    words = F.split("phrase", " ")
    k = F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k")
    each = candidates.select("lang", "length", "phrase", "a", k, words.alias("w"))
    each = each.select("lang", "length", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice("w", F.col("k") + 1, F.col("length")), " ").alias("tail"))
    part = phrases.select("lang", F.col("phrase").alias("_part"), F.col("n").alias("_n"))
    each = each.join(part.withColumnsRenamed({"_part": "head", "_n": "l"}), ["lang", "head"])
    each = each.join(part.withColumnsRenamed({"_part": "tail", "_n": "r"}), ["lang", "tail"])
    score = F.call_function("div", F.col("a").cast("decimal(20,0)") * F.lit(SCALE), F.col("l").cast("decimal(20,0)") + F.col("r").cast("decimal(20,0)"))
    cut = F.min(F.struct(score.cast("long").alias("score"), "k", "l", "r")).alias("cut")
    return each.groupBy("lang", "length", "phrase", "a").agg(cut).select("lang", "length", "phrase", "a", "cut.l", "cut.r", "cut.score")


def _inside(candidates: DataFrame) -> DataFrame:
    """(lang, phrase, most): phrases within longer candidates, with the most occurrences of one."""
    longer = candidates.where(F.col("length") > 2).select("lang", "length", F.col("a").alias("n"), F.split("phrase", " ").alias("w"))
    spans = F.expr("flatten(transform(sequence(2, length - 1), m -> transform(sequence(1, length - m + 1), i -> array_join(slice(w, i, m), ' '))))")
    held = longer.select("lang", "n", F.explode(F.array_distinct(spans)).alias("phrase"))
    return held.groupBy("lang", "phrase").agg(F.max("n").alias("most"))


def collocations(docs: DataFrame, least: int = FREQUENT, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """The ``top`` collocations of each language: lang, rank, phrase, a, l, r, n, score.

    ``a`` counts the phrase, ``l`` and ``r`` the parts of its lowest-scoring cut, ``n`` the
    words of the language. A null language is ``und``; null and empty texts have no words;
    repeated rows count as often as they stand; a very long text is read whole, in one
    task; equal scores go by ``a``, then by the phrase's bytes. An empty table, or one
    without a frequent phrase, gives no rows. Columns other than text and lang are not read.
    """
    phrases, sizes = frequent_phrases(docs, least)
    candidates = phrases.where(F.col("length") > 1).withColumnRenamed("n", "a")
    kept = _cuts(candidates, phrases).join(_inside(candidates), ["lang", "phrase"], "left")
    kept = kept.where(F.coalesce(100 * F.col("most").cast("decimal(20,0)") < covered * F.col("a").cast("decimal(20,0)"), F.lit(True)))
    first = newest_n(kept.drop("most", "length"), ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top)
    return first.join(sizes, "lang").select("lang", F.col("row_rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("words").alias("n"), "score")


def report_sql() -> str:
    """The same rows by counting every run of words as text."""
    split = f"regexp_split_to_array(translate(text, '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')"
    runs = f"""select lang, length, array_to_string(w[i:i + length - 1], ' ') as phrase
            from (select lang, w, length, unnest(range(1, len(w) - length + 2)) as i from pieces, (select unnest(range(1, {LONGEST + 1})) as length) where len(w) >= length)"""
    return f"""
        with texts as (select coalesce(lang, '{UNKNOWN}') as lang, unnest({split}) as piece from documents),
        pieces as (select lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') as w from texts),
        sizes as (select lang, sum(len(w))::bigint as n from pieces group by lang),
        f as materialized (select lang, length, phrase, count(*) as a from ({runs}) group by all having count(*) >= {FREQUENT}),
        cuts as (select lang, length, phrase, a, unnest(range(1, length)) as k, string_split(phrase, ' ') as w from f where length > 1),
        scored as (select c.lang, c.length, c.phrase, c.a, x.a as l, y.a as r, ({SCALE}::hugeint * c.a) // (x.a::hugeint + y.a) as score,
                row_number() over (partition by c.lang, c.phrase order by ({SCALE}::hugeint * c.a) // (x.a::hugeint + y.a), k) as place
            from cuts c join f x on x.lang = c.lang and x.phrase = array_to_string(w[1:k], ' ')
                join f y on y.lang = c.lang and y.phrase = array_to_string(w[k + 1:], ' ')),
        spans as (select distinct lang, phrase, a, array_to_string(w[i:i + m - 1], ' ') as part
            from (select lang, phrase, a, w, m, unnest(range(1, length - m + 2)) as i
                from (select *, string_split(phrase, ' ') as w, unnest(range(2, length)) as m from f where length > 2))),
        most as (select lang, part as phrase, max(a) as most from spans group by all),
        kept as (select s.*, row_number() over (partition by s.lang order by score desc, a desc, phrase) as rank
            from scored s left join most m using (lang, phrase) where place = 1 and (most is null or 100::hugeint * most < {COVERED}::hugeint * a))
        select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score
        from kept join sizes using (lang) where rank <= {TOP}"""
