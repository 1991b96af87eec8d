"""Log-likelihood of whole documents under a gated recurrent language model.

Words are counted over all training documents. The most frequent ones are the model's
vocabulary; every other word is one of a few rare tokens (by its first two bytes), and
its own probability within that token comes from the counts, so that every text has a
probability. The output is factored: a class, then a token of the class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferry.llm.arrays import Words, blocks, mixed
from ferry.llm.shared import remainder, stored

#: Hidden units; classes and tokens in each; rare tokens among them.
HIDDEN, CLASSES, WIDTH, RARE = 16, 32, 64, 64
VOCABULARY = CLASSES * WIDTH
#: Most frequent words whose counts every task gets, at most. Others are joined.
KNOWN = 200_000
#: Every training document trains the network in one of ``ROUNDS`` rounds: each task trains on its own documents, and parameters are averaged by tokens.
ROUNDS, RATE = 2, 0.01
#: Tokens of a document that one state runs over in training; longer documents are cut
#: there, so that their parts train side by side. Scoring never cuts.
SPAN = 1024
#: Documents side by side, steps of truncated back-propagation, steps of a scoring window.
BATCH, STEPS, WINDOW, SIDE_BY_SIDE = 256, 16, 32, 512
SMOOTH = 0.1
#: Counted distinct words are told after so many tokens; bounds a task's memory.
COUNTED = 4_000_000
END_HASH = 0


def rare_token(words: Words, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
    """1 to RARE, from the first two bytes of each word, or of the words in ``rows``."""
    start, end = words.start[rows], words.end[rows]
    first = words.data[start].astype(np.uint64)
    second = np.where(end - start > 1, words.data[np.minimum(start + 1, max(len(words.data) - 1, 0))], 0).astype(np.uint64)
    return (mixed(first * np.uint64(256) + second) % np.uint64(RARE)).astype(np.int64) + 1


def count_words(docs: DataFrame) -> DataFrame:
    """(word, rare, n) over all texts: ``word`` is a 64-bit hash, END_HASH ends a document.
    Tasks count before they tell, so a word costs a row per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rares: list[np.ndarray] = []
        ends = 0

        def told() -> pa.RecordBatch:
            word = np.concatenate([*held, np.zeros(0, np.uint64)])
            # Any place of a word will do, so the sort need not be stable.
            order = np.argsort(word)
            word = word[order]
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1])[: len(word)])
            n = np.diff(np.append(first, len(word)))
            word, rare = word[first], np.concatenate([*rares, np.zeros(0, np.int64)])[order[first]]
            return pa.RecordBatch.from_arrays([pa.array(np.append(word.view(np.int64), END_HASH)), pa.array(np.append(rare, 0)), pa.array(np.append(n, ends))], names=["word", "rare", "n"])

        for batch in batches:
            for _, _, data, offsets in blocks(batch.column("text")):
                words = Words(data, offsets)
                held.append(words.hashes())
                rares.append(rare_token(words))
                ends += len(offsets) - 1
                if sum(map(len, held)) > COUNTED:
                    yield told()
                    held, rares, ends = [], [], 0
        yield told()

    return docs.select("text").mapInArrow(run, "word long, rare long, n long").groupBy("word", "rare").agg(F.sum("n").alias("n")).where("n > 0")


@dataclass
class Vocabulary:
    """Counts that every task needs. ``word`` is sorted as unsigned; token 0 ends a document,
    1 to RARE are the rare ones, others are words."""

    word: np.ndarray
    count: np.ndarray
    token: np.ndarray
    total: int
    distinct: int
    ends: int
    rare_total: np.ndarray
    rare_distinct: np.ndarray
    unigram: np.ndarray

    def __post_init__(self):
        # Hashes are spread evenly, so their top bits lead to about one word.
        self.top = 64 - max(4, int(len(self.word)).bit_length())
        self.first = np.searchsorted(self.word, np.arange(1 << (64 - self.top), dtype=np.uint64) << np.uint64(self.top))
        self.first = np.append(self.first, len(self.word))

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """Place in ``word`` of each hash, or -1."""
        if not len(self.word):
            return np.full(len(hashes), -1)
        bucket = (hashes >> np.uint64(self.top)).astype(np.int64)
        at, end = self.first[bucket], self.first[bucket + 1]
        # The first word of the bucket is the one for most; an empty bucket leads to a word
        # of a later one, or to the last, which has another hash.
        here = np.minimum(at, len(self.word) - 1)
        same = self.word[here] == hashes
        found = np.where(same, here, -1)
        open_rows = np.flatnonzero(~same & (at + 1 < end))
        at, end, hashes = at[open_rows] + 1, end[open_rows], hashes[open_rows]
        while len(open_rows):
            same = self.word[at] == hashes
            found[open_rows[same]] = at[same]
            still = ~same & (at + 1 < end)
            open_rows, at, end, hashes = open_rows[still], at[still] + 1, end[still], hashes[still]
        return found

    def tokens(self, words: Words, place: np.ndarray) -> np.ndarray:
        found = np.where(place >= 0, self.token[place], 0) if len(self.word) else np.zeros(len(place), np.int64)
        rare = np.flatnonzero(found == 0)
        found[rare] = rare_token(words, rare)
        return found

    def fields(self) -> tuple:
        return (self.word, self.count, self.token, self.total, self.distinct, self.ends, self.rare_total, self.rare_distinct, self.unigram)


def make_vocabulary(counts: DataFrame) -> tuple[Vocabulary, int]:
    """The vocabulary, and the count from which words are in it. The cut is found on a
    histogram of counts, a few hundred rows."""
    level = F.floor(F.log2("n") * 16)
    words = counts.where(F.col("word") != END_HASH)
    levels = words.groupBy(level.alias("level")).agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.min("n").alias("least")).orderBy(F.desc("level")).collect()
    ends = sum(r.n for r in counts.where(F.col("word") == END_HASH).collect())
    total, distinct, taken, least = sum(r.n for r in levels) + ends, sum(r.k for r in levels) + (ends > 0), 0, 1 << 62
    for r in levels:
        if taken + r.k > KNOWN:
            break
        taken, least = taken + r.k, r.least
    # The network's own words by rank, also where the first level alone is too many.
    network = words.orderBy(F.desc("n"), "word").limit(VOCABULARY - RARE - 1)
    known = words.where(F.col("n") >= least).unionByName(network).distinct().toArrow()
    word, count, rare = (known.column(c).to_numpy() for c in ("word", "n", "rare"))
    order = np.argsort(word.view(np.uint64))
    word, count, rare = word.view(np.uint64)[order], count[order], rare[order]
    top = np.lexsort((word, -count))[: VOCABULARY - RARE - 1]
    token = np.zeros(len(word), dtype=np.int64)
    token[top] = np.arange(len(top)) + RARE + 1
    sums = {r.rare: (r.n, r.k) for r in words.groupBy("rare").agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect()}
    rare_total, rare_distinct = (np.array([sums.get(b, (0, 0))[i] for b in range(RARE + 1)], dtype=float) for i in (0, 1))
    np.subtract.at(rare_total, rare[top], count[top])
    np.subtract.at(rare_distinct, rare[top], 1)
    unigram = np.full(VOCABULARY, 0.0)
    unigram[0], unigram[1 : RARE + 1], unigram[token[top]] = ends, rare_total[1:], count[top]
    return Vocabulary(word, count, token, total, distinct, ends, rare_total, rare_distinct, (unigram + SMOOTH) / (unigram + SMOOTH).sum()), least


def begin(unigram: np.ndarray, seat: np.ndarray) -> dict[str, np.ndarray]:
    """Parameters that give the unigram distribution before any training."""
    rng = np.random.default_rng(0)
    share = np.zeros(VOCABULARY)
    share[seat] = unigram
    share = share.reshape(CLASSES, WIDTH)
    return {
        "x": rng.normal(0, 0.1, (VOCABULARY, 3 * HIDDEN)).astype(np.float32),
        "u": rng.normal(0, HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN)).astype(np.float32),
        "b": np.zeros(3 * HIDDEN, np.float32),
        "c": np.zeros((HIDDEN, CLASSES), np.float32),
        "cb": np.log(share.sum(axis=1)).astype(np.float32),
        "w": np.zeros((CLASSES, HIDDEN, WIDTH), np.float32),
        "wb": np.log(share / share.sum(axis=1, keepdims=True)).astype(np.float32),
    }


def seats(unigram: np.ndarray) -> np.ndarray:
    """Where each token sits: class * WIDTH + place. Tokens are dealt out by frequency, so
    that classes weigh about the same."""
    order = np.argsort(-unigram, kind="stable")
    seat = np.empty(VOCABULARY, dtype=np.int64)
    rank = np.arange(VOCABULARY)
    seat[order] = (rank % CLASSES) * WIDTH + rank // CLASSES
    return seat


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.exp(np.negative(x, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


def step(p: dict[str, np.ndarray], token: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, tuple]:
    """The next state of each document, and what back-propagation needs."""
    a, u = p["x"].take(token, axis=0), h @ p["u"]
    a += p["b"]
    zr = _sigmoid(a[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
    z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
    un = u[:, 2 * HIDDEN :]
    n = np.tanh(a[:, 2 * HIDDEN :] + r * un)
    return n + z * (h - n), (token, h, z, r, un, n)


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=-1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=-1, keepdims=True))


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums of short rows: a product is several times as fast as a reduction."""
    return x @ np.ones(x.shape[1], x.dtype)


def _must_shift(w: np.ndarray, b: np.ndarray) -> bool:
    """Whether ``h @ w + b`` may be too large for exp. States lie between -1 and 1, which
    bounds the logits; where the bound is small no shift is needed before exp."""
    return bool(np.abs(w).sum(axis=-2).max() + np.abs(b).max() > 60)


def _softmax(x: np.ndarray, shift: bool, whole: float) -> np.ndarray:
    """In place; each row sums to ``whole``."""
    if shift:
        x -= x.max(axis=-1, keepdims=True)
    np.exp(x, out=x)
    x *= (whole / _sums(x))[:, None]
    return x


def _picked(h: np.ndarray, w: np.ndarray, b: np.ndarray, place: np.ndarray, shift: bool) -> np.ndarray:
    """Log-softmax of ``h @ w + b`` at one place per row."""
    x = h @ w
    x += b
    if shift:
        return _log_softmax(x)[np.arange(len(x)), place]
    chosen = x[np.arange(len(x)), place]
    return chosen - np.log(_sums(np.exp(x, out=x)))


def token_scores(p: dict[str, np.ndarray], h: np.ndarray, seat: np.ndarray) -> np.ndarray:
    """Natural log probability of the token that sits there, for each state. States are
    taken class by class, so the products are dense."""
    group, place = seat // WIDTH, seat % WIDTH
    out = _picked(h, p["c"], p["cb"], group, _must_shift(p["c"], p["cb"]))
    order = np.argsort(group.astype(np.int8), kind="stable")
    ends = np.searchsorted(group[order], np.arange(CLASSES + 1))
    shift = _must_shift(p["w"], p["wb"])
    for c in range(CLASSES):
        rows = order[ends[c] : ends[c + 1]]
        if len(rows):
            out[rows] += _picked(h.take(rows, axis=0), p["w"][c], p["wb"][c], place[rows], shift)
    return out


def slopes(p: dict[str, np.ndarray], saved: list[tuple], states: np.ndarray, seat: np.ndarray, real: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradient of the mean loss over a window, back to its first step. That of the input
    table has the rows of the tokens that occur, which come second."""
    steps, batch = real.shape
    wanted = np.flatnonzero(real.reshape(-1))
    group = seat.reshape(-1)[wanted] // WIDTH
    order = np.argsort(group.astype(np.int8), kind="stable")
    wanted, group = wanted[order], group[order]
    # Tokens in the order of their classes, so that a class is a slice.
    h, place = states.reshape(-1, HIDDEN).take(wanted, axis=0), seat.reshape(-1)[wanted] % WIDTH
    n, rows = max(len(wanted), 1), np.arange(len(wanted))
    g = {k: np.zeros_like(v) for k, v in p.items() if k != "x"}
    e = h @ p["c"]
    e += p["cb"]
    e = _softmax(e, _must_shift(p["c"], p["cb"]), 1 / n)
    e[rows, group] -= 1 / n
    g["c"], g["cb"] = h.T @ e, _sums(e.T)
    dh = e @ p["c"].T
    e = np.empty((len(wanted), WIDTH), h.dtype)
    ends = np.searchsorted(group, np.arange(CLASSES + 1)).tolist()
    there = [(c, slice(lo, hi)) for c, (lo, hi) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if lo < hi]
    for c, mine in there:
        np.matmul(h[mine], p["w"][c], out=e[mine])
        e[mine] += p["wb"][c]
    e = _softmax(e, _must_shift(p["w"], p["wb"]), 1 / n)
    e[rows, place] -= 1 / n
    for c, mine in there:
        np.matmul(h[mine].T, e[mine], out=g["w"][c])
        dh[mine] += e[mine] @ p["w"][c].T
        g["wb"][c] = _sums(e[mine].T)
    down = np.zeros((steps * batch, HIDDEN), h.dtype)
    down[wanted] = dh
    down = down.reshape(steps, batch, HIDDEN)
    tokens, before, z, r, un, new = (np.stack(x) for x in zip(*saved, strict=True))
    to_n, to_z, to_r = (1 - z) * (1 - new * new), (before - new) * z * (1 - z), un * r * (1 - r)
    da, du = (np.empty((steps, batch, 3 * HIDDEN), h.dtype) for _ in range(2))
    back, turned = np.zeros((batch, HIDDEN), h.dtype), p["u"].T
    for t in range(steps - 1, -1, -1):
        d = down[t] + back
        dn = da[t, :, 2 * HIDDEN :] = d * to_n[t]
        np.multiply(d, to_z[t], out=du[t, :, :HIDDEN])
        np.multiply(dn, to_r[t], out=du[t, :, HIDDEN : 2 * HIDDEN])
        np.multiply(dn, r[t], out=du[t, :, 2 * HIDDEN :])
        back = d * z[t] + du[t] @ turned
    da[:, :, : 2 * HIDDEN] = du[:, :, : 2 * HIDDEN]
    da = da.reshape(-1, 3 * HIDDEN)
    g["u"], g["b"] = before.reshape(-1, HIDDEN).T @ du.reshape(-1, 3 * HIDDEN), _sums(da.T)
    tokens = tokens.reshape(-1)
    order = np.argsort(tokens.astype(np.int16), kind="stable")
    tokens = tokens[order]
    first = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
    g["x"] = np.add.reduceat(da.take(order, axis=0), first, axis=0)
    return g, tokens[first]


def _adam(x: np.ndarray, mean: np.ndarray, square: np.ndarray, slope: np.ndarray, k: int) -> None:
    """Moves ``x``, ``mean`` and ``square`` in place."""
    mean += 0.1 * (slope - mean)
    change = slope * slope
    change -= square
    change *= 0.005
    square += change
    np.multiply(square, 1 / (1 - 0.995**k), out=change)
    np.sqrt(change, out=change)
    change += 1e-6
    np.divide(mean, change, out=change)
    change *= RATE / (1 - 0.9**k)
    x -= change


def train_task(p: dict[str, np.ndarray], texts: list[np.ndarray], seat: np.ndarray) -> int:
    """Trains ``p`` in place on token lists (Adam); state is carried over the windows of a
    span. Returns the number of tokens."""
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    # Each span with the token before it.
    spans = [(ids[lo - 1] if lo else 0, ids[lo : lo + SPAN]) for ids in texts for lo in range(0, len(ids), SPAN)]
    spans.sort(key=lambda span: len(span[1]))
    done, k = 0, 0
    for lo in np.random.default_rng(0).permutation(np.arange(0, len(spans), BATCH)):
        group = [ids for _, ids in spans[lo : lo + BATCH]]
        lengths = np.array([len(ids) for ids in group])
        flat, starts = np.concatenate(group), np.cumsum(lengths) - lengths
        longest = int(lengths.max())
        h = np.zeros((len(group), HIDDEN), np.float32)
        last = np.array([before for before, _ in spans[lo : lo + BATCH]])
        for t in range(0, longest, STEPS):
            # Lengths rise: documents that have ended are the first ones.
            live = int(np.searchsorted(lengths, t, side="right"))
            first = live - (len(group) - len(h))
            h, last, saved, states = h[first:], last[first:], [], []
            # A window of the tokens; the longest document is never padded as a whole.
            place = t + np.arange(min(STEPS, longest - t))[:, None]
            real = place < lengths[None, live:]
            target = np.where(real, flat[np.minimum(starts[None, live:] + place, len(flat) - 1)], 0)
            for ids in target:
                h, keep = step(p, last, h)
                states.append(h)
                saved.append(keep)
                last = ids
            g, seen = slopes(p, saved, np.stack(states), seat[target], real)
            k += 1
            for name, x in p.items():
                if name == "x":
                    # Only the input rows of tokens in the window move.
                    part = [y["x"][seen] for y in (p, m, v)]
                    _adam(*part, g["x"], k)
                    for y, rows in zip((p, m, v), part, strict=True):
                        y["x"][seen] = rows
                else:
                    _adam(x, m[name], v[name], g[name], k)
        done += len(flat)
    return done


def train(docs: DataFrame, vocabulary: Vocabulary) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Rounds of local training and averaging. Averages are made by Spark, place by place;
    the driver gets one set of parameters whatever the number of tasks."""
    seat = seats(vocabulary.unigram)
    p = begin(vocabulary.unigram, seat)
    shapes = {k: x.shape for k, x in p.items()}
    if not vocabulary.total:
        return p, seat
    context = docs.sparkSession.sparkContext
    for turn in range(ROUNDS):
        given = context.broadcast((vocabulary.fields(), p, seat))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fields, start, places = given.value
            known, mine = Vocabulary(*fields), {k: x.copy() for k, x in start.items()}
            texts: list[np.ndarray] = []
            tokens = 0

            def learned() -> int:
                n = train_task(mine, texts, places)
                texts.clear()
                return n

            for batch in batches:
                for _, _, data, offsets in blocks(batch.column("text")):
                    words = Words(data, offsets)
                    ids = known.tokens(words, known.look_up(words.hashes()))
                    texts += [np.append(ids[lo:hi], 0) for lo, hi in zip(words.at[:-1], words.at[1:], strict=True)]
                    if sum(map(len, texts)) > COUNTED:
                        tokens += learned()
            tokens += learned() if texts else 0
            if tokens:
                flat = np.concatenate([x.ravel() for x in mine.values()]).astype(float)
                for lo in range(0, len(flat), 20_000):
                    part = flat[lo : lo + 20_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + len(part))), pa.array(part * tokens), pa.array(np.full(len(part), float(tokens)))], names=["place", "value", "weight"])

        part = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS)) == turn)
        told = part.select("text").mapInArrow(run, "place long, value double, weight double")
        mean = told.groupBy("place").agg((F.sum("value") / F.sum("weight")).alias("value")).toArrow().sort_by("place")
        if mean.num_rows:
            flat, at = mean.column("value").to_numpy().astype(np.float32), 0
            for k, shape in shapes.items():
                n = int(np.prod(shape))
                p[k], at = flat[at : at + n].reshape(shape).copy(), at + n
    return p, seat


def score_tokens(p: dict[str, np.ndarray], seat: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each token list. Lists of like length run side by side,
    and their states go on from window to window until the list ends."""
    out = np.zeros(len(texts))
    order = np.argsort([-len(t) for t in texts], kind="stable")
    for lo in range(0, len(order), SIDE_BY_SIDE):
        mine = order[lo : lo + SIDE_BY_SIDE]
        lengths = np.array([len(texts[i]) for i in mine])
        longest = int(lengths[0])
        h = np.zeros((len(mine), HIDDEN), np.float32)
        last = np.zeros(len(mine), np.int64)
        for t in range(0, longest, WINDOW):
            width = min(WINDOW, longest - t)
            live = int((lengths > t).sum())
            target = np.zeros((width, live), np.int64)
            for i in range(live):
                piece = texts[mine[i]][t : t + width]
                target[: len(piece), i] = piece
            h, last = h[:live], last[:live]
            states = np.empty((width, live, HIDDEN), np.float32)
            for s in range(width):
                h, _ = step(p, last, h)
                states[s], last = h, target[s]
            real = (t + np.arange(width))[:, None] < lengths[:live][None, :]
            found = np.zeros(real.shape)
            found[real] = token_scores(p, states[real], seat[target[real]])
            out[mine[:live]] += found.sum(axis=0)
    return out


def score_texts(docs: DataFrame) -> DataFrame:
    """Adds to every document (doc_id, text): held_out, n_tokens, n_known, train_tokens,
    base_score and score, both log10 probabilities of the whole text.

    Tasks score what they know: the network's tokens and the counts of the ``KNOWN`` most
    frequent words. Other words go by hash to a join with the counts; they are rare, so
    no key is hot. Null and empty texts are one token, the end. Without training documents
    counts are 0 and the network is uniform. Repeated rows stay; an empty table
    gives no rows; other columns are not read. Very long texts are read whole, window by
    window. A task trains on its own documents and parameters are averaged by tokens, so
    ``score`` depends on how the table is cut into tasks; all other columns do not.
    """
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(remainder(F.col("doc_id"), 10) == 0, F.lit(False)).alias("held_out"))
    training = docs.where(~F.col("held_out"))
    counts = stored(count_words(training), "counts")
    vocabulary, least = make_vocabulary(counts)
    p, seat = train(training, vocabulary)
    given = docs.sparkSession.sparkContext.broadcast((vocabulary.fields(), p, seat))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("row", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("model", T.DoubleType()), T.StructField("others", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields, weights, places = given.value
        known = Vocabulary(*fields)
        row = TaskContext.get().partitionId() << 33
        floor = known.total + SMOOTH * (known.distinct + 1)
        within = np.log10(known.rare_total + SMOOTH * (known.rare_distinct + 1))
        for batch in batches:
            texts, columns = [], {k: [] for k in ("n_known", "base", "model", "others")}
            for _, _, data, offsets in blocks(batch.column("text")):
                words = Words(data, offsets)
                hashes = words.hashes()
                place = known.look_up(hashes)
                there = place >= 0
                count = np.where(there, known.count[place], 0) if len(known.word) else np.zeros(len(hashes))
                ids = known.tokens(words, place)
                hashes = hashes.view(np.int64)
                # A word that no task knows adds its count's part after the join.
                own = np.where(there, np.log10(count + SMOOTH), 0.0)
                model = np.where(ids <= RARE, own - within[np.minimum(ids, RARE)], 0.0)
                for lo, hi in zip(words.at[:-1], words.at[1:], strict=True):
                    texts.append(np.append(ids[lo:hi], 0))
                    columns["n_known"].append(int(there[lo:hi].sum()) + (known.ends > 0))
                    columns["base"].append(float(own[lo:hi].sum() + np.log10(known.ends + SMOOTH) - (hi - lo + 1) * np.log10(floor)))
                    columns["model"].append(float(model[lo:hi].sum()))
                    columns["others"].append(hashes[lo:hi][~there[lo:hi]])
            found = score_tokens(weights, places, texts) / np.log(10) if texts else np.zeros(0)
            rows = np.arange(row, row + len(texts))
            row += len(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(rows, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(columns["n_known"], pa.int64()), pa.array(columns["base"], pa.float64()), pa.array(np.array(columns["model"]) + found, pa.float64()), pa.array(columns["others"], pa.list_(pa.int64()))],
                names=schema.names,
            )

    scored = stored(docs.select("doc_id", "held_out", "text").mapInArrow(run, schema), "scored")
    others = scored.select("row", F.explode("others").alias("word"))
    rest = counts.where((F.col("n") < least) & (F.col("word") != END_HASH)).select("word", "n")
    found = others.join(rest, "word", "left").groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + SMOOTH)).alias("more"), F.count("n").alias("known"))
    more = F.coalesce("more", F.lit(0.0))
    return scored.join(found, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(int(vocabulary.total)).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("model") + more).alias("score"),
    )
