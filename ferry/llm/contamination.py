"""Benchmark passages in documents, by a prefix-filtered join over windows of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferry.llm.shared import stored, words

#: Words of a window. Shorter items are one window each.
WINDOW = 13
#: An index of at most so many windows is broadcast (under 400 bytes each), and at most
#: so many anchor words are looked up inside the scan. Larger ones go through shuffles.
BROADCAST_WINDOWS, ANCHORS_IN_SCAN = 50_000, 20_000
#: A benchmark vocabulary of at most so many words is broadcast to count its words.
BROADCAST_WORDS = 200_000
#: Repeated rows listed from one array.
COPIES = 4096


def item_windows(items: DataFrame) -> DataFrame:
    """(item_id, window): distinct windows of every item that has words."""
    split = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - WINDOW, F.lit(0)))
    return split.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, F.lit(WINDOW)))).alias("window")).distinct()


def window_index(windows: DataFrame, docs: DataFrame) -> DataFrame:
    """(window_id, window, anchor, offset): each window filed under its rarest word.

    Rarity is the number of documents that hold the word, over all documents; a window
    can only occur where its rarest word stands, so that word alone is its prefix.
    """
    distinct = windows.select("window").distinct().withColumn("window_id", F.xxhash64("window"))
    places = distinct.select("window_id", "window", F.posexplode("window").alias("offset", "anchor"))
    vocabulary = stored(places.select("anchor").distinct(), "vocabulary")
    if vocabulary.count() <= BROADCAST_WORDS:
        vocabulary = F.broadcast(vocabulary)
    held = docs.select(F.explode(F.array_distinct(words(F.col("text")))).alias("anchor"))
    frequency = held.join(vocabulary, "anchor", "left_semi").groupBy("anchor").agg(F.count("*").alias("n"))
    ranked = places.join(frequency, "anchor", "left").withColumn("rank", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "anchor", "offset"))
    rarest = ranked.groupBy("window_id", "window").agg(F.min("rank").alias("rarest"))
    return rarest.select("window_id", "window", F.col("rarest.anchor").alias("anchor"), F.col("rarest.offset").alias("offset"))


def _agrees(text: Column, first: Column, n_words: Column) -> Column:
    """The window fits into the document where its anchor puts it, and stands there
    word for word. ``text`` holds the document's words from place ``first`` on."""
    start, length = F.col("at") - F.col("offset"), F.size("window")
    return (start >= 0) & (start + length <= n_words) & (F.slice(text, F.greatest(start - first, F.lit(0)) + 1, length) == F.col("window"))


def _occurrences(docs: DataFrame, index: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_words, start, length, window_id, is_row): every occurrence, and for
    every row of ``docs`` one more line with ``is_row`` and without a window."""
    index = stored(index, "windows")
    n_windows = index.count()
    anchors = index.select("anchor").distinct()
    body = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("words"))
    here = F.col("words")
    start = (F.col("at") - F.col("offset")).alias("start")
    columns = ["doc_id", "text_key", "n_words", start, F.size("window").alias("length"), "window_id"]
    if n_windows <= BROADCAST_WINDOWS and anchors.count() <= ANCHORS_IN_SCAN:
        wanted = [r.anchor for r in anchors.collect()]
        hits = F.filter(F.transform(here, lambda w, i: F.struct(w.alias("anchor"), i.alias("at"))), lambda h: h.anchor.isin(wanted))
        around = F.transform(hits, lambda h: F.struct(h.anchor.alias("anchor"), h["at"].alias("at"), F.greatest(h["at"] - (WINDOW - 1), F.lit(0)).alias("first")))
        with_text = F.transform(around, lambda h: F.struct(h.anchor.alias("anchor"), h["at"].alias("at"), h["first"].alias("first"), F.slice(here, h["first"] + 1, F.lit(2 * WINDOW - 1)).alias("near")))
        # The line of the row itself: no window has a null anchor.
        itself = F.array(F.struct(F.lit(None).cast("string").alias("anchor"), F.lit(-1).alias("at"), F.lit(0).alias("first"), F.array().cast("array<string>").alias("near")))
        rows = body.select("doc_id", "text_key", F.size(here).alias("n_words"), F.concat(itself, with_text).alias("hits"))
        # Never empty; ``explode`` would add a filter that cuts the text anew for every hit.
        rows = rows.select("doc_id", "text_key", "n_words", F.explode_outer("hits").alias("hit")).select("doc_id", "text_key", "n_words", "hit.*")
        d, x = rows.alias("d"), F.broadcast(index).alias("x")
        same = (F.col("d.anchor") == F.col("x.anchor")) & _agrees(F.col("near"), F.col("first"), F.col("n_words"))
        return d.join(x, same, "left").select(*columns, (F.col("at") == -1).alias("is_row"))
    places = body.select("doc_id", "text_key", F.posexplode("words").alias("at", "anchor"))
    # Rows that repeat name each candidate once, so a repeated row meets it once.
    candidates = places.join(index, "anchor").select("doc_id", "text_key", "at", "offset", "window", "window_id").distinct()
    full = body.withColumn("n_words", F.size(here))
    same = (F.col("d.doc_id").eqNullSafe(F.col("c.doc_id"))) & (F.col("d.text_key") == F.col("c.text_key")) & _agrees(F.col("d.words"), F.lit(0), F.col("n_words"))
    found = full.alias("d").join(candidates.alias("c"), same).select("d.doc_id", "d.text_key", *columns[2:], F.lit(False).alias("is_row"))
    none = F.lit(None)
    itself = full.select("doc_id", "text_key", "n_words", none.cast("int").alias("start"), none.cast("int").alias("length"), none.cast("long").alias("window_id"), F.lit(True).alias("is_row"))
    return found.unionByName(itself)


def _hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``find_contamination`` with one line for rows that repeat both id and text, and
    their number as ``copies``."""
    docs, items = docs.select("doc_id", "text"), items.select(F.col("item_id"), "text")
    windows = stored(item_windows(items).withColumn("window_id", F.xxhash64("window")), "items")
    found = _occurrences(docs, window_index(windows, docs))
    place = F.when(F.col("window_id").isNotNull(), F.struct("start", "length", "window_id"))
    each = found.groupBy("doc_id", "text_key", "n_words").agg(F.sort_array(F.collect_set(place)).alias("places"), F.count_if("is_row").alias("copies"))
    # The union of the places, taken in order of their start.
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def step(acc: Column, p: Column) -> Column:
        end = p["start"] + p["length"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], p["start"]))).alias("n"))

    covered = F.aggregate("places", zero, step, lambda acc: acc["n"])
    counted = stored(
        each.select(
            "doc_id",
            "text_key",
            "copies",
            F.col("n_words").cast("long").alias("n_words"),
            covered.cast("long").alias("n_hit"),
            F.transform("places", lambda p: p["start"]).alias("starts"),
            F.array_distinct(F.transform("places", lambda p: p["window_id"])).alias("window_ids"),
        ),
        "contamination",
    )
    named = counted.where(F.size("window_ids") > 0).select("doc_id", "text_key", F.explode("window_ids").alias("window_id"))
    named = named.join(windows.select("window_id", F.col("item_id").cast("string").alias("item")), "window_id")
    named = named.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("item")).alias("items")).alias("i")
    c = counted.alias("c")
    whole = c.join(named, (F.col("c.doc_id").eqNullSafe(F.col("i.doc_id"))) & (F.col("c.text_key").eqNullSafe(F.col("i.text_key"))), "left")
    return whole.select("c.doc_id", "n_words", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"), "starts", F.col("c.text_key").alias("text_key"), "copies")


def find_contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Benchmark windows in every document: doc_id, n_words, n_hit, items, starts, text_key.

    ``n_hit`` counts words inside any occurrence, ``items`` are the ids (as strings,
    sorted) of items with occurring windows, ``starts`` the places of the occurrences.
    One row for every row of ``docs``, null ids and repeated rows included. Null or empty
    texts have no words and no hits; a text of any length is read whole, and what is kept
    of it grows with its occurrences; items without words are ignored; an empty benchmark
    gives no hits; columns other than doc_id, text and item_id, text are not read.
    """
    found = _hits(docs, items)
    # Copies are listed in two steps, so that no array is long.
    runs = F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / COPIES).cast("long")))
    listed = found.select("*", runs.alias("run"))
    listed = listed.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(COPIES).cast("long"), F.col("copies") - F.col("run") * COPIES))).alias("copy"))
    return listed.drop("run", "copy", "copies")


def is_contaminated() -> Column:
    """A twentieth of the words, or more, stand in benchmark windows."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def contamination_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    return find_contamination(docs, items).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents that are not contaminated, with all their columns."""
    bad = _hits(docs, items).where(is_contaminated()).select(F.col("doc_id").alias("_bad"), F.col("text_key").alias("_bad_key"))
    same = F.col("doc_id").eqNullSafe(F.col("_bad")) & F.xxhash64("text").eqNullSafe(F.col("_bad_key"))
    return docs.join(bad, same, "left_anti").select(*docs.columns)


def report_sql() -> str:
    """The same rows by comparing the words at every place with every window. Rows are
    numbered, so null and repeated ids are rows like others."""
    split = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    return f"""
        with i as (select item_id, {split} as w from benchmark),
        windows as (select distinct item_id, least(len(w), {WINDOW}) as n, unnest(list_transform(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1), lambda k: array_to_string(w[k:k + {WINDOW - 1}], ' '))) as body
            from i where len(w) > 0),
        d as materialized (select row_number() over () as r, doc_id, {split} as w from documents),
        spots as (select r, n, w, unnest(range(1, len(w) - n + 2)) as k from d, (select distinct n from windows) where len(w) >= n),
        found as (select distinct a.r, a.k, a.n, item_id from spots a join windows x on x.n = a.n and x.body = array_to_string(a.w[a.k:a.k + a.n - 1], ' ')),
        hit as (select r, count(distinct p) as n_hit from (select r, unnest(range(k, k + n)) as p from found) group by r),
        named as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item_id::varchar as item from found) group by r)
        select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
            sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
        from d left join hit using (r) left join named using (r)"""
