"""The recurrent network learns from every training document."""

import numpy as np

from ferry.llm import recurrent
from ferry.llm.arrays import Words


def test_every_training_document_trains(spark):
    words = [f"word{i}" for i in range(60)]
    rows = [(None if i == 7 else i % 50, f"{w} " * 60) for i, w in enumerate(words)] + [(3, "word3 " * 60)] * 5
    # Input rows move from a document's second window on: the output starts at zero.
    assert len(rows[0][1].split()) > 2 * recurrent.STEPS
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    vocabulary, _ = recurrent.make_vocabulary(recurrent.count_words(docs))
    p, seat = recurrent.train(docs, vocabulary)
    data = [w.encode() for w in words]
    cut = Words(np.frombuffer(b"".join(data), np.uint8), np.concatenate(([0], np.cumsum([len(d) for d in data]))))
    tokens = vocabulary.tokens(cut, vocabulary.look_up(cut.hashes()))
    assert len(set(tokens.tolist())) == len(words)
    moved = np.abs(p["x"] - recurrent.begin(vocabulary.unigram, seat)["x"]).max(axis=1)
    assert (moved[tokens] > 1e-4).all()
