"""The network's softmax: cheap where logits are small, safe where they are not."""

import time

import numpy as np
import pytest

from ferry.llm import recurrent


def shifted(x):
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def test_no_row_maximum_where_logits_are_small():
    x = np.random.default_rng(0).normal(size=(4096, recurrent.WIDTH)).astype(np.float32)
    assert np.allclose(recurrent._softmax(x.copy(), False, 0.5), shifted(x) / 2, rtol=1e-5)

    def least(run):
        spent = []
        for _ in range(30):
            y, begun = x.copy(), time.thread_time()
            run(y)
            spent.append(time.thread_time() - begun)
        return min(spent)

    assert least(lambda y: recurrent._softmax(y, False, 1.0)) < 0.8 * least(shifted)


@pytest.mark.parametrize("constant", (100.0, -300.0))
def test_large_logits_are_shifted(constant):
    """A constant on all logits changes no probability and no slope, nor overflows."""
    rng = np.random.default_rng(3)
    unigram = np.full(recurrent.VOCABULARY, 1 / recurrent.VOCABULARY)
    seat = recurrent.seats(unigram)
    p = {k: (x + rng.normal(0, 0.1, x.shape)).astype(np.float64) for k, x in recurrent.begin(unigram, seat).items()}
    far = p | {"cb": p["cb"] + constant, "wb": (p["wb"] + constant).astype(np.float32).astype(float)}
    target, h, saved, states = rng.integers(0, recurrent.VOCABULARY, (4, 3)), np.zeros((3, recurrent.HIDDEN)), [], []
    for ids in target:
        h, keep = recurrent.step(p, ids, h)
        states.append(h)
        saved.append(keep)
    states, real = np.stack(states), np.ones((4, 3), bool)
    (near, seen), (found, also) = (recurrent.slopes(q, saved, states, seat[target], real) for q in (p, far))
    assert (seen == also).all()
    for name, slope in near.items():
        assert np.allclose(found[name], slope, rtol=1e-3, atol=1e-6), name
    flat = states.reshape(-1, recurrent.HIDDEN)
    scores = [recurrent.token_scores(q, flat, seat[target].ravel()) for q in (p, far)]
    assert np.allclose(*scores, atol=1e-3)


def test_words_are_hashed_in_pieces_that_stay_small():
    """A block's numbers are not all held at once; a word of any length hashes as a whole."""
    import tracemalloc

    from ferry.llm import arrays

    def by_hand(word):
        whole = 0
        for k, c in enumerate(word):
            whole += (c + 1) * pow(arrays._BASE, k, 1 << 64)
        return int(arrays.mixed(np.array([whole % (1 << 64)], np.uint64))[0])

    texts = [b"a " * 40_000, b"", b"Bc" * 30_000 + b" d", b"x" * arrays.PIECE, b"x" * (arrays.PIECE + 1), b" e "]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    words = arrays.Words(data, offsets)
    wanted = [w for t in texts for w in t.lower().split()]
    told = {w: by_hand(w) for w in set(wanted)}
    assert words.hashes().tolist() == [told[w] for w in wanted]
    many = np.frombuffer(b"word " * (arrays.BLOCK // 5), np.uint8)
    words = arrays.Words(many, np.array([0, len(many)]))
    tracemalloc.start()
    words.hashes()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 8 * len(many)
