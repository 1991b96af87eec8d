"""The network's scores and its training on long texts, against one token at a time."""

import numpy as np

from ferry.llm import recurrent


def start(seed):
    rng = np.random.default_rng(seed)
    unigram = rng.random(recurrent.VOCABULARY)
    unigram /= unigram.sum()
    seat = recurrent.seats(unigram)
    p = {k: (x + rng.normal(0, 0.2, x.shape)).astype(np.float32) for k, x in recurrent.begin(unigram, seat).items()}
    return rng, p, seat


def one_by_one(p, seat, ids):
    """Log probability by the gates' formulas, in double precision."""
    p = {k: x.astype(float) for k, x in p.items()}
    size, width = recurrent.HIDDEN, recurrent.WIDTH
    h, last, total = np.zeros(size), 0, 0.0
    logistic = lambda x: 1 / (1 + np.exp(-x))
    for token in ids:
        a, u = p["x"][last] + p["b"], h @ p["u"]
        z, r = logistic(a[:size] + u[:size]), logistic(a[size : 2 * size] + u[size : 2 * size])
        new = np.tanh(a[2 * size :] + r * u[2 * size :])
        h = z * h + (1 - z) * new
        group, place = divmod(int(seat[token]), width)
        for logits, chosen in ((h @ p["c"] + p["cb"], group), (h @ p["w"][group] + p["wb"][group], place)):
            total += logits[chosen] - np.log(np.exp(logits).sum())
        last = token
    return total


def test_scores_of_whole_texts():
    rng, p, seat = start(1)
    texts = [rng.integers(0, recurrent.VOCABULARY, n) for n in (1, 2, 31, 32, 33, 700, 64)]
    found = recurrent.score_tokens(p, seat, texts)
    assert np.allclose(found, [one_by_one(p, seat, t) for t in texts], rtol=1e-4)


def test_a_long_text_trains_in_bounded_windows(monkeypatch):
    """Every token counts, cut into spans or not; a text of 300,000 words is no dense matrix."""
    rng, p, seat = start(2)
    texts = [rng.integers(0, 50, n) for n in (1, 40, 300_000, 17)]
    mine = {k: x.copy() for k, x in p.items()}
    assert recurrent.train_task(mine, texts, seat) == sum(map(len, texts))
    held = [rng.integers(0, 50, 400)]
    assert recurrent.score_tokens(mine, seat, held)[0] > recurrent.score_tokens(p, seat, held)[0]


def test_one_count_level_above_the_known_words(spark, monkeypatch):
    """If the most frequent level alone is too large, the network still has its words."""
    monkeypatch.setattr(recurrent, "KNOWN", 10)
    docs = spark.createDataFrame([(i, " ".join(f"w{i}" for i in range(40))) for i in range(3)], "doc_id long, text string")
    vocabulary, _ = recurrent.make_vocabulary(recurrent.count_words(docs))
    assert (vocabulary.token > recurrent.RARE).sum() == 40
