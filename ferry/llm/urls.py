"""URL rules and lists: a blocked Bloom filter passes possible hits to an exact hash join."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferry.llm import blooms
from ferry.llm.shared import LOWER, UPPER, stored


class Rule(NamedTuple):
    """``verdict`` for ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str


#: The base rules.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))
#: Hosts whose pages make the query's list, by one of their labels.
LISTED_LABELS = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
#: A key that is asked for by a thousandth of the possible hits or more is looked up in a
#: broadcast table, which so has at most a thousand rows.
HEAVY_SHARE = 1000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower
    case; path: what follows up to ``?``, ``#`` or the end. Both empty without ``://``."""
    url = url.cast("string")
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def canonical(host: Column, path: Column) -> tuple[Column, Column]:
    """One spelling for one page: no default port, no final dot, no leading ``www.``, no
    repeated or final slash. Null where there is no host."""
    plain = F.regexp_replace(F.regexp_replace(host, r":(80|443)?\z", ""), r"\.+\z", "")
    plain = F.regexp_replace(plain, r"^www\.", "")
    short = F.regexp_replace(F.regexp_replace(path, r"/+", "/"), r"/\z", "")
    return F.when(plain != "", plain), F.when(plain != "", F.when(short == "", "/").otherwise(short))


def listed_urls(urls: DataFrame) -> DataFrame:
    """(list_host, list_path): the distinct canonical forms of ``url``."""
    host, path = canonical(*host_and_path(F.col("url")))
    return urls.select(host.alias("list_host"), path.alias("list_path")).where(F.col("list_host").isNotNull()).distinct()


def _shapes(rules: Sequence[Rule]) -> list[tuple[int, int]]:
    """(labels of the host, length of the path) of the rules: a page is asked one key each."""
    return sorted({(rule.host.count(".") + 1, len(rule.path)) for rule in rules})


def _rule_column(rules: Sequence[Rule], shapes: list[tuple[int, int]]) -> Column:
    """The best of the rules that a page's possible hits really spell: an exact look-up by
    shape, host and path, the longest rule first, then the longer host, then block."""
    fits = []
    for i, shape in enumerate(shapes):
        of_shape = [r for r in rules if (r.host.count(".") + 1, len(r.path)) == shape]
        for r in of_shape:
            same = F.col(f"_maybe{i}") & (F.col(f"_host{i}") == r.host) & (F.col(f"_path{i}") == r.path)
            found = F.struct(F.lit(len(r.host) + len(r.path)), F.lit(len(r.host)), F.lit(r.verdict).alias("verdict"), F.lit(r.host + r.path).alias("rule"))
            fits.append(F.when(same, found))
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<a:int,b:int,verdict:string,rule:string>")


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Every page with host, path, rule (or null), listed and verdict.

    ``listed`` holds ``url``s of any number; a page is listed if its canonical URL equals
    that of a listed one. ``rules`` is a short policy in the program. A page takes the
    verdict of the longest rule that fits; without one, block if it is listed, else allow.
    One filter of fixed size holds the listed URLs and the rules. What cannot be in it is
    decided in the scan; the rest goes to the exact join.

    A null URL, and one without ``://``, has an empty host and path, no rule, and is not
    listed. Repeated rows stay repeated; null and repeated entries of ``listed`` count
    once; an empty list or empty pages give no hits; very long URLs are read whole.
    Columns of ``pages`` other than page_id and url are not read.
    """
    entries = stored(listed_urls(listed), "listed")
    shapes = _shapes(rules)
    spark = pages.sparkSession
    keyed = entries.select(F.xxhash64("list_host", "list_path").alias("key"))
    if rules:
        keyed = keyed.unionByName(spark.createDataFrame([(r.host, r.path) for r in rules], "h string, p string").select(F.xxhash64("h", "p").alias("key")))
    blocks = blooms.blocks_for(entries.count() + len(rules))
    bloom = stored(blooms.filter_rows(keyed, "key", blocks), "bloom")

    host, path = host_and_path(F.col("url"))
    asked = pages.select("page_id", host.alias("host"), path.alias("path"))
    own_host, own_path = canonical(F.col("host"), F.col("path"))
    asked = asked.withColumns({"list_host": own_host, "list_path": own_path})
    asked = asked.withColumn("_key", F.when(F.col("list_host").isNotNull(), F.xxhash64("list_host", "list_path")))
    asked = blooms.marked(asked, "_key", "_maybe", bloom, blocks)
    for i, (labels, length) in enumerate(shapes):
        asked = asked.withColumns({f"_host{i}": F.substring_index("host", ".", -labels), f"_path{i}": F.substring("path", 1, length)})
        asked = blooms.marked(asked.withColumn(f"_key{i}", F.xxhash64(f"_host{i}", f"_path{i}")), f"_key{i}", f"_maybe{i}", bloom, blocks)
    ruled = asked.withColumn("_rule", _rule_column(rules, shapes))
    # Written once: what follows reads it three times.
    kept = stored(ruled.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.col("_rule.verdict").alias("_verdict"), "list_host", "list_path", "_maybe"), "asked")
    decided = kept.where(~F.col("_maybe")).withColumn("listed", F.lit(False)).unionByName(_exact(kept.where("_maybe"), entries))
    verdict = F.coalesce("_verdict", F.when(F.col("listed"), "block").otherwise("allow"))
    return decided.select("page_id", "host", "path", "rule", "listed", verdict.alias("verdict"))


def _exact(hits: DataFrame, entries: DataFrame) -> DataFrame:
    """``listed`` for every possible hit, by an exact join on the canonical URL. Popular
    URLs are looked up in a broadcast table, so that none fills a task of the join."""
    key = ["list_host", "list_path"]
    counted = stored(hits.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), "hits")
    known = counted.join(entries.withColumn("_in", F.lit(True)), key, "left").select(*key, "n", F.coalesce("_in", F.lit(False)).alias("listed"))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    is_heavy = F.col("n") * HEAVY_SHARE >= F.lit(total)
    heavy = known.where(is_heavy).select(*key, F.col("listed").alias("_heavy"))
    light = known.where(~is_heavy & F.col("listed")).select(*key, F.col("listed").alias("_light"))
    seen = hits.join(F.broadcast(heavy), key, "left")
    popular = seen.where(F.col("_heavy").isNotNull()).withColumn("listed", F.col("_heavy")).drop("_heavy")
    rest = seen.where(F.col("_heavy").isNull()).drop("_heavy").join(light, key, "left")
    return popular.unionByName(rest.withColumn("listed", F.coalesce("_light", F.lit(False))).drop("_light"))


def on_listed_hosts(pages: DataFrame) -> DataFrame:
    """The query's list: URLs of the table whose host has one of ``LISTED_LABELS``."""
    host, _ = host_and_path(F.col("url"))
    return pages.where(F.arrays_overlap(F.split(host, r"\."), F.array(*[F.lit(v) for v in LISTED_LABELS]))).select("url")


def verdict_report(pages: DataFrame) -> DataFrame:
    return filter_urls(pages, on_listed_hosts(pages)).select("page_id", "host", "path", "rule", "verdict", "listed")


def report_sql() -> str:
    """The same rows by comparing every URL with every rule and the whole list."""
    fits = " union all ".join(f"select '{r.verdict}' as v, '{r.host}' as h, '{r.path}' as p" for r in RULES)
    labels = ", ".join(f"'{v}'" for v in LISTED_LABELS)
    bare = r"regexp_replace(regexp_replace(regexp_replace(host, ':(80|443)?\z', ''), '\.+\z', ''), '^www\.', '')"
    short = r"regexp_replace(regexp_replace(path, '/+', '/', 'g'), '/\z', '')"
    one = f"case when {bare} <> '' then {bare} || case when {short} = '' then '/' else {short} end end"
    return f"""
        with rules as ({fits}),
        cut as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
        named as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw from cut),
        parts as (select page_id, translate(raw, '{UPPER}', '{LOWER}') as host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from named),
        own as (select *, {one} as spelled from parts),
        listing as (select distinct spelled from own where list_has_any(string_split(host, '.'), [{labels}]) and spelled is not null),
        ruled as (select host, path, arg_max(struct_pack(v := v, r := h || p), (length(h || p), length(h), v)) as best
            from (select distinct host, path from parts) join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by host, path)
        select page_id, host, path, best.r as rule, spelled is not null and spelled in (select spelled from listing) as listed,
            coalesce(best.v, case when spelled in (select spelled from listing) then 'block' else 'allow' end) as verdict
        from own left join ruled using (host, path)"""
