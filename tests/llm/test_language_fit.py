"""The language kernel against its definition, letters, and repeated rows."""

import numpy as np
from pyspark.sql import functions as F

from ferry.llm import language


def buckets(text):
    return language.presence(np.frombuffer(text.encode(), np.uint8))


def test_kernel_scores_against_the_dense_form(monkeypatch):
    texts = [f"the {w} and the {w}ing of it" for w in "abcdefgh"] + [f"der {w} und die {w}ung von" for w in "abcdefgh"]
    names = ["en"] * 8 + ["de"] * 8
    sets = [set(buckets(t).tolist()) for t in texts]
    kernel = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    values, vectors = np.linalg.eigh(kernel)
    kept = values > 1e-8 * values.max()
    features = kernel @ (vectors[:, kept] / np.sqrt(values[kept]))
    target = np.array([[1.0 if n == mine else -1.0 for n in ("de", "en")] for mine in names])
    centred = features - features.mean(axis=0)
    solved = np.linalg.solve(centred.T @ centred + language.RIDGE * 16 * np.eye(centred.shape[1]), centred.T @ (target - target.mean(axis=0)))
    raw = centred @ solved + target.mean(axis=0)
    for dense in (3, 128):
        monkeypatch.setattr(language, "DENSE", dense)
        model = language.fit([buckets(t) for t in texts], names)
        best, score = model.predict([buckets(t) for t in texts])
        assert model.languages == ["de", "en"] and (best == raw.argmax(axis=1)).all()
        odds = np.exp(4 * (raw - raw.max(axis=1, keepdims=True)))
        assert np.allclose(score, 1 / odds.sum(axis=1), atol=1e-3)


def test_numbers_and_signs_are_no_letters(spark):
    rows = [(i, f"the words of number {i} and more", "en") for i in range(40)] + [(100 + i, t, None) for i, t in enumerate(["²", "½ ①", "٣", "5_6", "é", "日本"])]
    found = language.language_report(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("doc_id >= 100").orderBy("doc_id").collect()
    assert [r.lang_pred for r in found] == ["und"] * 4 + ["en"] * 2


def test_a_row_that_repeats_fills_no_sample(spark):
    docs = spark.range(5000).select(F.lit(2).alias("doc_id"), F.lit("the same text").alias("text"), F.lit("en").alias("lang"))
    other = spark.createDataFrame([(i, f"text {i}", "en") for i in range(30)], "doc_id int, text string, lang string")
    assert language.training_sample(docs.unionByName(other)).count() <= 31
