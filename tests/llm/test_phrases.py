"""Collocations against counting every run of words as text."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from ferry.llm import phrases
from ferry.llm.shared import table
from tests.conftest import SMALL, rows

SCHEMA = "doc_id long, text string, lang string"


def expected(docs, least, top, covered):
    counts, sizes = defaultdict(Counter), Counter()
    for _, text, lang in docs:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for m in range(1, 5):
                counts[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    found = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        kept = []
        for p, a in candidates.items():
            held = (b for q, b in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))))
            if any(100 * b >= covered * a for b in held):
                continue
            score, k = min((phrases.SCALE * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((score, a, " ".join(p), f[p[:k]], f[p[k:]]))
        kept.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        found += [(lang, i + 1, p, a, l, r, sizes[lang], s) for i, (s, a, p, l, r) in enumerate(kept[:top])]
    return sorted(found, key=lambda r: tuple((v is not None, str(v)) for v in r))


def made(seed, n):
    dice = random.Random(seed)
    words = ["a", "B", "b", "ça", "long-word", "x\u00a0y", "İ", "c", "d", "e"]
    marks = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r", ":"]
    docs = []
    for i in range(n):
        text = "".join(dice.choice(words) + dice.choice(marks) for _ in range(dice.randrange(0, 60)))
        docs.append((dice.choice([i, 1, None]), dice.choice([text, text, text, None, ""]) if i % 9 == 0 else text, dice.choice(["en", "fr", None])))
    return docs + docs[:30] + [(5, "one two three four. " * 40, "en"), (6, "Ünï cödé " * 50, "")]


def check(spark, docs, least=5, top=40, covered=80):
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], SCHEMA + ", phrase string, n int")
    got = phrases.collocations(df, least, top, covered)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert rows(got) == expected(docs, least, top, covered)


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SMALL}/documents.parquet'")
    cursor = con.execute(phrases.report_sql())
    names = [d[0] for d in cursor.description]
    want = sorted(cursor.fetchall(), key=lambda r: tuple((v is not None, str(v)) for v in r))
    assert rows(phrases.collocations(table(spark, SMALL, "documents")), *names) == want and want


@pytest.mark.parametrize("seed, covered", [(1, 80), (2, 30)])
def test_every_run_is_counted(spark, seed, covered):
    check(spark, made(seed, 300), covered=covered)


@pytest.mark.parametrize("bits", [1, 6, 12])
def test_fingerprints_that_collide(spark, monkeypatch, bits):
    """Few bits give different phrases one fingerprint; the words tell them apart."""
    monkeypatch.setattr(phrases, "FINGERPRINT_BITS", bits)
    check(spark, made(bits, 150))


@pytest.mark.parametrize("chunk", [16, 200])
def test_long_texts_in_slices(spark, monkeypatch, chunk):
    """Texts longer than a chunk are cut between words; no run is lost or counted twice."""
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    check(spark, made(4, 80))


def test_slices_own_every_byte_once():
    text = ("alpha beta. gamma\t" * 90 + "x" * 500 + " tail of it").encode()
    phrases_chunk, phrases.CHUNK = phrases.CHUNK, 64
    try:
        parts = list(phrases.slices(1, text))
    finally:
        phrases.CHUNK = phrases_chunk
    assert b"".join(p.body[: p.owned] for p in parts) == text and len(parts) > 5
    assert all(text[p.base :].startswith(p.body) for p in parts)


def test_a_text_of_six_million_characters(spark):
    text = "the long text goes on and on, as ever so often. " * 125_000
    docs = [(1, text, "en"), (2, "the long text", "en")]
    check(spark, docs, least=30)


def test_empty_tables(spark):
    check(spark, [])
    check(spark, [(1, None, "en"), (2, "", None), (3, " .,", "en"), (4, "only once here", "en")])


def test_products_past_64_bits(spark):
    f = spark.createDataFrame([("en", 2, "a b", 9 * 10**18), ("en", 1, "a", 9 * 10**18), ("en", 1, "b", 9 * 10**18 + 5)], "lang string, length int, phrase string, n long")
    cut = phrases._cuts(f.where("length = 2").withColumnRenamed("n", "a"), f).first()
    assert cut["score"] == phrases.SCALE * 9 * 10**18 // (18 * 10**18 + 5)
