"""URL rules and lists against comparing every URL with everything."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ferry.llm import blooms, urls
from ferry.llm.shared import table
from tests.conftest import SMALL, rows

SCHEMA = "page_id long, url string"


def split(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[end:]
    stop = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), tail[:stop]


def spelled(host, path):
    for port in (":80", ":443", ":"):
        if host.endswith(port):
            host = host[: -len(port)]
            break
    host = host.rstrip(".").removeprefix("www.")
    while "//" in path:
        path = path.replace("//", "/")
    return (host, path.removesuffix("/") or "/") if host else None


def expected(pages, listed, rules):
    known = {spelled(*split(u)) for u in listed} - {None}
    found = []
    for page_id, url in pages:
        host, path = split(url)
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: (len(r.host + r.path), len(r.host), r.verdict), default=None)
        on_list = spelled(host, path) in known
        found.append((page_id, host, path, best and best.host + best.path, on_list, best.verdict if best else "block" if on_list else "allow"))
    return sorted(found, key=lambda r: tuple((v is not None, str(v)) for v in r))


def check(spark, pages, listed, rules=urls.RULES):
    df = spark.createDataFrame(pages, SCHEMA).withColumn("host", F.lit("clash")).withColumn("_key", F.lit(1))
    got = rows(urls.filter_urls(df, spark.createDataFrame([(u,) for u in listed], "url string"), rules))
    assert got == expected(pages, listed, rules)


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SMALL}/pages.parquet'")
    cursor = con.execute(urls.report_sql())
    names = [d[0] for d in cursor.description]
    want = sorted(cursor.fetchall(), key=lambda r: tuple((v is not None, str(v)) for v in r))
    found = urls.verdict_report(table(spark, SMALL, "pages"))
    assert rows(found, *names) == want and {r[names.index("verdict")] for r in want} == {"allow", "block"}


def test_edges(spark):
    long = "http://long.example.com/" + "a/" * 600_000
    pages = [
        (1, None), (2, ""), (3, "no scheme.net/"), (4, "://"), (5, "http://net"), (6, "http://NET/"), (7, "HTTP://a.Net/x?y#z"), (7, "HTTP://a.Net/x?y#z"),
        (8, "http://notnet/"), (9, "http://example.net/en/1"), (10, "http://x.example.net/en"), (11, "http://x.example.com/de/?q"), (12, "http://example.org/fr/"),
        (13, "http://.net/"), (14, "http://a.net?x=/"), (15, "ftp://a.net#/"), (16, "http://www.bad.com//x//"), (17, "http://bad.com:80/x#f"), (18, "http://bad.com./x/"),
        (19, "http://bad.com/X"), (20, "http://bad.com:8080/x"), (21, long), (22, "http://a://b.net/"), (None, "http://bad.com/x"), (23, "http://É.net/"), (24, "http://bad.com"),
    ]
    listed = ["https://bad.com/x", "https://bad.com/x/", None, "", "://", long + "?", "http://www.bad.com/", "http://y.net/"]
    check(spark, pages, listed)
    check(spark, pages, [])
    check(spark, pages, listed, ())
    check(spark, [], listed)


def test_many_urls_a_hot_one_and_a_full_filter(spark, monkeypatch):
    dice = random.Random(3)
    hosts = [f"{a}{b}" for a in ("", "www.", "m.") for b in ("a.net", "b.com", "example.com", "example.net", "c.org")]
    pages = [(i, f"http://{dice.choice(hosts)}/{dice.choice(['en', 'de', 'fr'])}/{dice.randrange(300)}") for i in range(1500)]
    pages += [(5000 + i, "http://hot.com/listed") for i in range(700)] + [(9000 + i, "http://hot.com/not") for i in range(700)]
    listed = [u for _, u in dice.sample(pages[:1500], 200)] + ["http://hot.com/listed"]
    rules = (*urls.RULES, urls.Rule("allow", "b.com", "/e"), urls.Rule("block", "m.b.com", "/en/"), urls.Rule("allow", "a.b.com", "/"))
    check(spark, pages, listed, rules)
    # One block: nearly everything passes the filter, and the exact join decides the same.
    monkeypatch.setattr(blooms, "MOST_BLOCKS", 1)
    check(spark, pages, listed, rules)


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_filter_loses_no_key_and_both_forms_agree(spark, n):
    keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, n, dtype=np.int64)
    others = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 20_000, dtype=np.int64)
    blocks = blooms.blocks_for(n)
    rows_of = blooms.filter_rows(spark.createDataFrame([(int(k),) for k in keys], "key long"), "key", blocks)
    words = blooms.filter_array(rows_of, blocks)
    assert blooms.may_hold(words, keys.view(np.uint64)).all()
    passed = blooms.may_hold(words, others.view(np.uint64))
    assert passed.mean() < 0.01
    asked = spark.createDataFrame([(int(k),) for k in others], "key long")
    assert blooms.marked(asked, "key", "may", rows_of, blocks).where("may").count() == passed.sum()
