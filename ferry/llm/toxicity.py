"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferry.llm.scoring import collected, labelled, report, scored
from ferry.llm.shared import words

#: Labelled documents to learn from, at most; entries of the learned lexicon, at most.
TRAINING, ENTRIES = 12_000, 4000
#: A lexicon entry stands in so many toxic documents and is so much likelier there.
LEAST_DOCS, LEAST_ODDS = 4, 2.0
#: Beginnings of words that may be entries of their own, in letters.
STEMS = (4, 5, 6)
TREES, DEPTH, RATE, BINS, LEAF, RIDGE = 60, 3, 0.2, 32, 4, 1.0
#: Words within which a second person counts as near.
NEAR = 4
THRESHOLD = 0.5

# Second person in the languages of the corpus, and signs used for letters.
SECOND_PERSON = "you your yours yourself du dich dir dein deine tu te toi ton ta vous votre usted tú ti tus vosotros".split()
SIGNS = str.maketrans("013457@$!", "oieastasi")

_WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
_DISGUISED = re.compile(r"[^\W\d_][0-9@$!*]+[^\W\d_]")
_A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_PERSON = frozenset(SECOND_PERSON)


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Log odds of words and word beginnings (written with ``^``) that mark toxic documents.

    Document counts by Spark over the bounded sample; the entries with the largest lower
    bound of their odds reach the driver, ``ENTRIES`` at most."""
    found = sample.select("label", F.array_distinct(words(F.col("text"))).alias("w"))

    def stems(n: int):
        return F.transform(F.filter("w", lambda x: F.length(x) > n), lambda x: F.concat(F.lit("^"), F.substring(x, 1, n)))

    tokens = found.select("label", F.explode(F.array_distinct(F.concat("w", *[stems(n) for n in STEMS]))).alias("token"))
    totals = {r.label: r.n for r in found.groupBy("label").agg(F.count("*").alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        return {}
    counts = tokens.groupBy("token").agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good")).where(F.col("bad") >= min(LEAST_DOCS, max(2, bad // 2)))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    sure = odds - F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    kept = counts.select("token", odds.alias("odds"), sure.alias("sure")).where(F.col("odds") >= LEAST_ODDS).orderBy(F.desc("sure"), "token").limit(ENTRIES)
    return {r.token: r.odds for r in kept.collect()}


def features(text: str, lexicon: dict[str, float]) -> np.ndarray:
    """Lexicon densities, closeness to a second person, capitals, marks and disguises."""
    lowered = text.translate(_A_TO_Z)
    found = _WORD.findall(lowered)
    n = max(len(found), 1)
    full = [(i, lexicon[w]) for i, w in enumerate(found) if w in lexicon]
    begun = []
    for k in STEMS:
        begun += [(i, lexicon[s]) for i, w in enumerate(found) if len(w) > k and (s := "^" + w[:k]) in lexicon]
    person = np.array([i for i, w in enumerate(found) if w in _PERSON])
    hits = full + begun
    close = 0
    if len(person) and hits:
        at = np.array([i for i, _ in hits])
        k = np.searchsorted(person, at)
        gap = np.minimum(np.abs(person[np.minimum(k, len(person) - 1)] - at), np.abs(person[np.maximum(k - 1, 0)] - at))
        close = int((gap <= NEAR).sum())
    disguised = _DISGUISED.findall(lowered)
    plain = [w.translate(SIGNS) for w in disguised] if disguised else []
    capitals = sum(1 for c in text if "A" <= c <= "Z") if len(text) < 2000 else len(text) - len(re.sub("[A-Z]", "", text))
    weights = [v for _, v in hits]
    values = [
        len(full), len(full) / n, max((v for _, v in full), default=0), sum(v for _, v in full) / n,
        len(begun), len(begun) / n, max((v for _, v in begun), default=0), sum(v for _, v in begun) / n,
        len({i for i, _ in hits}), max(weights, default=0), sum(weights), sum(1 for v in weights if v > 4),
        close, close / n, len(person) / n, capitals / max(len(text), 1), text.count("!") / n, text.count("?") / n,
        len(disguised) / n, sum(w in lexicon for w in plain), np.log1p(n), sum(map(len, found)) / n,
    ]
    return np.array(values, dtype=float)


class Trees:
    """Boosted regression trees for the logistic loss. Each tree is complete: a feature and
    a threshold per inner node, a value per leaf."""

    def __init__(self, start: float, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray):
        self.start, self.feature, self.threshold, self.value = start, feature, threshold, value

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), dtype=int)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    raw, inner = np.full(len(y), start), 2**DEPTH - 1
    all_features, all_thresholds, all_values = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        slope, weight = y - p, p * (1 - p)
        feature, threshold = np.zeros(inner, dtype=int), np.full(inner, np.inf)
        node = np.zeros(len(y), dtype=int)
        for depth in range(DEPTH):
            first = 2**depth - 1
            for k in range(first, 2 * first + 1):
                mine = np.flatnonzero(node == k)
                g, h = slope[mine].sum(), weight[mine].sum()
                best = 1e-9
                for f, e in enumerate(edges):
                    if not len(e) or len(mine) < 2 * LEAF:
                        continue
                    b = binned[mine, f]
                    count = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
                    left = np.cumsum(np.bincount(b, slope[mine], len(e) + 1))[:-1]
                    heavy = np.cumsum(np.bincount(b, weight[mine], len(e) + 1))[:-1]
                    gain = left**2 / (heavy + RIDGE) + (g - left) ** 2 / (h - heavy + RIDGE) - g**2 / (h + RIDGE)
                    gain[(count < LEAF) | (len(mine) - count < LEAF)] = 0
                    if gain.max() > best:
                        best, feature[k], threshold[k] = gain.max(), f, e[int(gain.argmax())]
                node[mine] = 2 * k + 1 + (x[mine, feature[k]] > threshold[k])
        leaf = node - inner
        top = np.bincount(leaf, slope, 2**DEPTH)
        value = RATE * top / (np.bincount(leaf, weight, 2**DEPTH) + RIDGE)
        raw += value[leaf]
        all_features.append(feature)
        all_thresholds.append(threshold)
        all_values.append(value)
    return Trees(start, np.array(all_features), np.array(all_thresholds), np.array(all_values))


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps (score, chance) that rise: neighbours out of order are pooled. One pseudo-row
    of each label at the ends keeps chances off 0 and 1."""
    order = np.argsort(raw, kind="stable")
    points, first = np.unique(raw[order], return_index=True)
    sums, counts = np.add.reduceat(y[order], first), np.diff([*first, len(raw)]).astype(float)
    sums[-1], counts[-1], counts[0] = sums[-1] + 1, counts[-1] + 1, counts[0] + 1
    pooled: list[list[float]] = []
    for x, s, c in zip(points, sums, counts, strict=True):
        pooled.append([s, c, x, x])
        while len(pooled) > 1 and pooled[-2][0] / pooled[-2][1] >= pooled[-1][0] / pooled[-1][1]:
            s1, c1, _, hi = pooled.pop()
            pooled[-1] = [pooled[-1][0] + s1, pooled[-1][1] + c1, pooled[-1][2], hi]
    xs = np.array([v for p in pooled for v in (p[2], p[3])])
    return xs, np.array([p[0] / p[1] for p in pooled for _ in range(2)])


def fit(x: np.ndarray, y: np.ndarray):
    """Trees on all rows; the calibration is learned from scores of rows that the trees
    which scored them had not seen (three folds)."""
    if not (y == 1).any() or not (y == 0).any():
        return None
    unseen, fold = np.zeros(len(y)), np.arange(len(y)) % 3
    for k in range(3):
        rest = fold != k
        unseen[~rest] = boost(x[rest], y[rest]).raw(x[~rest]) if len(set(y[rest])) == 2 else 0.0
    return boost(x, y), isotonic(unseen, y)


def score_toxicity(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds ``score``, the calibrated chance that a whole text is toxic, to every row.

    Empty and null texts have no hits and a low score. Without labels of both kinds all
    scores are 0. Repeated rows stay, an empty table gives no rows, and only ``carry`` and
    text are read.
    """
    sample = labelled(docs, labels, "toxic", TRAINING)
    lexicon = learn_lexicon(sample)
    x, y = collected(sample, lambda text: features(text, lexicon))
    model = fit(x, y)

    def score(texts: list[str]) -> np.ndarray:
        if model is None:
            return np.zeros(len(texts))
        trees, (xs, ys) = model
        return np.interp(trees.raw(np.array([features(t, lexicon) for t in texts])), xs, ys)

    return scored(docs, score, carry)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return report(score_toxicity(docs, labels), THRESHOLD)
