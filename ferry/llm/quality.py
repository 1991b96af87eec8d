"""Document quality by Bradley-Terry ranking: preferences between documents, not labels alone.

A document with label 1 is preferred to one with label 0. The score is linear in the
features; the chance that one document is preferred to another is the logistic
function of the difference of their scores.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ferry.llm.arrays import Words
from ferry.llm.scoring import collected, labelled, report, scored

#: Labelled documents to learn from, at most; preference pairs a step, steps and step size.
TRAINING, PAIRS, STEPS, RATE, DECAY = 8000, 2000, 600, 0.05, 1e-3
#: Words of the windows in which the worst stretch of a text is looked for.
WINDOW = 24
THRESHOLD = 0.3

_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, dtype=bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[33, 63]] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[[b for b in range(33, 127) if chr(b) in "#$%&*+/<=>@\\^_`{|}~[]"]] = True
_POINT = np.zeros(256, dtype=bool)
_POINT[[44, 46, 58, 59]] = True


def _windows(flag: np.ndarray) -> tuple[float, float]:
    """Share of words with the flag, in the whole text and in the worst window."""
    total = np.concatenate(([0], np.cumsum(flag)))
    width = min(WINDOW, len(flag))
    return total[-1] / len(flag), float((total[width:] - total[:-width]).max()) / width


def features(text: str) -> np.ndarray:
    """Size, vocabulary, case, marks and repetition of a whole text; empty gives zeros."""
    data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    words = Words(data, np.array([0, len(data)]))
    n = len(words.start)
    if n == 0:
        return np.zeros(SIZE)
    sums = {k: np.concatenate(([0], np.cumsum(t[data]))) for k, t in (("upper", _UPPER), ("lower", _LOWER), ("digit", _DIGIT), ("stop", _STOP), ("mark", _MARK), ("point", _POINT))}
    each = {k: s[words.end] - s[words.start] for k, s in sums.items()}
    length = words.end - words.start
    hashes = words.hashes()
    _, counts = np.unique(hashes, return_counts=True)
    again = np.concatenate(([False], hashes[1:] == hashes[:-1]))
    three = hashes[:-2] * np.uint64(3) + hashes[1:-1] * np.uint64(5) + hashes[2:] * np.uint64(7)
    letters = max(int(each["upper"].sum() + each["lower"].sum()), 1)
    size = float(length.sum())
    values = [np.log1p(n), np.log1p(len(data)), size / n, float(length.std()), float(length.max() > 25), counts.max() / n, len(counts) / n, len(counts) / np.sqrt(n), 1 - len(np.unique(three)) / max(len(three), 1)]
    values += [each["upper"].sum() / letters, *(float(each[k].sum()) / size for k in ("digit", "stop", "mark", "point"))]
    shout = (each["upper"] >= 2) & (each["lower"] == 0)
    for flag in (shout, each["stop"] >= 2, each["mark"] >= 1, each["mark"] >= 3, again, each["point"] >= 1, each["digit"] >= 3, (each["mark"] == 1) & (length == 1)):
        values += _windows(flag)
    return np.array(values, dtype=float)


SIZE = 9 + 5 + 2 * 8


def spread(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """Each feature and its excess over the knots, so that a linear score can bend."""
    parts = [x] + [np.maximum(x - k, 0) for k in knots]
    return np.concatenate(parts, axis=1)


class Ranking:
    """Scores by preference; ``theta`` is the score at the learned quantile."""

    def __init__(self, knots, mean, scale, weights, theta, slope):
        self.knots, self.mean, self.scale, self.weights, self.theta, self.slope = knots, mean, scale, weights, theta, slope

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((spread(x, self.knots) - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, with ``THRESHOLD`` at the quantile."""
        odds = np.clip(self.slope * (self.raw(x) - self.theta), -40, 40) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-odds))


def fit(x: np.ndarray, y: np.ndarray) -> Ranking | None:
    """Logistic loss on feature differences of random pairs (Adam); then the quantile of the
    scores at which a cut tells the two labels apart best. None without both labels."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return None
    knots = np.quantile(x, [0.25, 0.5, 0.75, 0.9, 0.97], axis=0)
    z = spread(x, knots)
    mean, scale = z.mean(axis=0), z.std(axis=0)
    scale[scale < 1e-9] = 1
    z = (z - mean) / scale
    rng = np.random.default_rng(0)
    w, m, v = np.zeros(z.shape[1]), np.zeros(z.shape[1]), np.zeros(z.shape[1])
    for step in range(1, STEPS + 1):
        difference = z[rng.choice(good, PAIRS)] - z[rng.choice(bad, PAIRS)]
        lost = 1 / (1 + np.exp(np.clip(difference @ w, -40, 40)))
        slope = DECAY * w - difference.T @ lost / PAIRS
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        w -= RATE * (1 - step / (STEPS + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    raw = z @ w
    levels = np.unique(np.quantile(raw, np.linspace(0, 1, 401)))
    cuts = (levels[1:] + levels[:-1]) / 2 if len(levels) > 1 else levels
    right = [(raw[good] >= c).mean() + (raw[bad] < c).mean() for c in cuts]
    best = np.flatnonzero(np.array(right) >= max(right) - 1e-9)
    return Ranking(knots, mean, scale, w, float(cuts[best[len(best) // 2]]), 1.0)


def score_quality(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds ``score`` to every row: the higher, the likelier label 1.

    Texts are read whole. Empty and null texts have the features' zeros and a score like
    any other. Without labels of both kinds all scores are 0.5. Repeated rows stay, an
    empty table gives no rows, and only ``carry`` and text are read.
    """
    x, y = collected(labelled(docs, labels, "quality", TRAINING), features)
    model = fit(x, y)

    def score(texts: list[str]) -> np.ndarray:
        return np.full(len(texts), 0.5) if model is None else model.score(np.array([features(t) for t in texts]))

    return scored(docs, score, carry)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return report(score_quality(docs, labels), THRESHOLD)
