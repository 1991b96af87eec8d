"""License scan by a positional index of rare words."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferry.llm.shared import literal_words, sql_strings, words


@dataclass(frozen=True)
class Template:
    """Words of a license text. ``start`` and ``length`` mark the key phrase that must
    stand word for word; the words around it only raise the score."""

    label: str
    text: str
    start: int = 0
    length: int | None = None
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key(self) -> list[str]:
        return self.words[self.start :][: self.length]


# Phrases and labels that every scan reports.
BASE = (
    Template("gpl", "gnu general public license", base=True),
    Template("apache", "apache license", base=True),
    Template("cc-by", "cc by", base=True),
    Template("mit", "mit license", base=True),
)
#: Labels of this scan's own: versions, variants and licenses the base list lacks.
MORE = (
    Template("gpl-3.0", "licensed under the gnu general public license version 3", 3, 6),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", 3, 6),
    Template("lgpl", "under the terms of the gnu lesser general public license", 5, 5),
    Template("agpl", "under the terms of the gnu affero general public license", 5, 5),
    Template("apache-2.0", "licensed under the apache license version 2 0", 3, 5),
    Template("cc-by-nc", "licensed under cc by nc 4 0", 2, 3),
    Template("cc-by-sa", "licensed under cc by sa 4 0", 2, 3),
    Template("cc-by-nd", "licensed under cc by nd 4 0", 2, 3),
    Template("cc0", "creative commons cc0 1 0 universal", 2, 3),
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy", 2, 5),
    Template("bsd", "redistribution and use in source and binary forms with or without modification", 4, 4),
    Template("mpl", "subject to the terms of the mozilla public license", 6, 3),
    Template("epl", "made available under the terms of the eclipse public license", 7, 3),
    Template("proprietary", "all rights reserved", 0, 3),
)
TEMPLATES = BASE + MORE
#: Rare words of a key phrase whose postings are intersected.
ANCHORS = 2


def word_counts(docs: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Documents, and documents that hold each license word. One row per word of the
    templates reaches the driver, however many documents there are."""
    found = docs.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect(words(F.col("text")), literal_words(vocabulary)))).alias("word"))
    counts = {r.word: r.n for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return counts.get("", 0), counts


def rarest(template: Template, idf: dict[str, float]) -> list[tuple[str, int]]:
    """The key phrase's rarest words with their places in it."""
    places = sorted(range(len(template.key)), key=lambda i: (-idf[template.key[i]], i))
    return [(template.key[i], i) for i in sorted(places[:ANCHORS])]


def _starts(hits: Column, anchors: list[tuple[str, int]]) -> Column:
    """Starts of the key phrase on which the postings of all its anchors agree."""

    def posting(word: str, at: int) -> Column:
        return F.transform(F.filter(hits, lambda h: h.w == word), lambda h: h.i - F.lit(at))

    postings = [posting(word, at) for word, at in anchors]
    agreed = postings[0]
    for other in postings[1:]:
        agreed = F.array_intersect(agreed, other)
    return agreed


def _verified(starts: Column, text: Column, key: list[str]) -> Column:
    return F.filter(starts, lambda s: (s >= 0) & (F.slice(text, F.greatest(s, F.lit(0)) + 1, F.lit(len(key))) == literal_words(key)))


def _score(starts: Column, text: Column, template: Template) -> Column:
    """Greatest share of the template's words that stand at their place."""
    full = literal_words(template.words)

    def share(s: Column) -> Column:
        same = F.filter(F.sequence(F.lit(0), F.lit(len(template.words) - 1)), lambda j: F.get(text, s - F.lit(template.start) + j) == F.get(full, j))
        return F.size(same) / F.lit(float(len(template.words)))

    return F.coalesce(F.array_max(F.transform(starts, share)), F.lit(0.0))


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """License phrases of every document (doc_id, text): one row for each input row.

    Two scans and no shuffle of texts. The first counts the documents that hold each
    template word; the second looks up each document's occurrences of the rarest words,
    intersects their postings by relative position and verifies the key phrases.
    Column ``hits`` holds all places: (label, base, start).

    Null or empty text: no words, no labels, null places, score 0. Texts of any length
    are scanned whole; repeated rows give repeated rows, an empty table no rows, and
    columns other than doc_id and text are not read.
    """
    docs = docs.select("doc_id", "text")
    vocabulary = sorted({w for t in templates for w in t.key})
    total, counts = word_counts(docs, vocabulary)
    idf = {w: math.log((total + 1) / (counts.get(w, 0) + 1)) for w in vocabulary}
    anchors = {t: rarest(t, idf) for t in templates}
    rare = sorted({w for found in anchors.values() for w, _ in found})
    # Both later selects read each array many times, so Catalyst keeps them apart.
    split = docs.select("doc_id", words(F.col("text")).alias("words"))
    text = F.col("words")
    none = F.array().cast("array<struct<w:string,i:int>>")
    postings = F.filter(F.transform(text, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: h.w.isin(rare))
    looked_up = split.select("doc_id", F.size(text).alias("n_words").cast("long"), "words", F.when(F.arrays_overlap(text, literal_words(rare)), postings).otherwise(none).alias("postings"))
    found = looked_up.select("doc_id", "n_words", "words", *[_verified(_starts(F.col("postings"), anchors[t]), text, t.key).alias(f"at_{k}") for k, t in enumerate(templates)])
    at = [F.col(f"at_{k}") for k in range(len(templates))]

    def places(k: int, t: Template) -> Column:
        return F.transform(at[k], lambda s: F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), s.cast("long").alias("start")))

    return found.select(
        "doc_id",
        "n_words",
        F.flatten(F.array(*[places(k, t) for k, t in enumerate(templates)])).alias("hits"),
        F.greatest(F.lit(0.0), *[_score(at[k], text, t) for k, t in enumerate(templates)]).alias("score"),
    )


def license_report(docs: DataFrame) -> DataFrame:
    """Digest of ``scan_licenses``: counts, first and last place and labels."""
    found = scan_licenses(docs)
    base = F.transform(F.filter("hits", lambda h: h.base), lambda h: h.start)
    labels = lambda hits: F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h.label))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base).alias("first_word"),
        F.array_max(base).alias("last_word"),
        labels(F.filter("hits", lambda h: h.base)).alias("base_labels"),
        labels(F.col("hits")).alias("labels"),
        "score",
    )


def report_sql(templates: tuple[Template, ...] = TEMPLATES) -> str:
    """The same rows by comparing every place of every text with every key phrase."""
    at, hits, base, score = [], [], [], []
    for k, t in enumerate(templates):
        key, full = sql_strings(t.key), sql_strings(t.words)
        at.append(f"list_filter(range(1, len(w) + 1), lambda i: w[i:i + {len(t.key) - 1}] = {key}) as at_{k}")
        hits.append(f"case when len(at_{k}) > 0 then ['{t.label}'] else [] end")
        if t.base:
            base.append(k)
        score.append(
            f"coalesce(list_max(list_transform(at_{k}, lambda i: len(list_filter(range(1, {len(t.words) + 1}), "
            f"lambda j: i - {t.start} + j > 1 and w[i - {t.start + 1} + j] = {full}[j])) / {len(t.words)}.0::double)), 0)"
        )
    all_base = " || ".join(f"at_{k}" for k in base)
    labels = lambda names: f"array_to_string(list_sort(list_distinct({names})), ',')"
    return f"""
        with split as (
            select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w
            from documents),
        found as (select doc_id, w, {', '.join(at)} from split)
        select doc_id, len(w)::bigint as n_words, len({all_base})::bigint as n_base,
            list_min({all_base}) - 1 as first_word, list_max({all_base}) - 1 as last_word,
            {labels(' || '.join(hits[k] for k in base))} as base_labels, {labels(' || '.join(hits))} as labels,
            greatest({', '.join(score)})::double as score
        from found"""
