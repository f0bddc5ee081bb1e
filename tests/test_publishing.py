"""Queries on the write path, streams, shop pages and published data against their SQL, and the helpers they brought."""

import gzip

import duckdb
import pytest
from pyspark.sql import functions as F

from epochal.operators import rawchecks
from epochal.plans import publishing, registry
from epochal.sources import sitemaps
from epochal.streaming import history as streaming

from .conftest import DATA

SF = f"{DATA}/sf0.001"
NAMES = [n for n, f in registry.QUERIES.items() if f.__module__ == publishing.__name__]


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([columns[i] for i in order]), sorted(str([r[i] for i in order]) for r in found)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    got = registry.QUERIES[name](spark, SF)
    with duckdb.connect() as con:
        for t in ("part", "supplier", "nation", "lineitem", "events"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
        want = con.execute(registry.ORACLES[name])
        assert rows(got.columns, got.collect()) == rows([d[0] for d in want.description], want.fetchall())


def test_the_last_batch_settles_a_point(spark):
    found = spark.createDataFrame([("a", 1, "A", True, 0), ("a", 5, "B", True, 0), ("a", 5, "B", False, 1), ("a", 3, "B", True, 1), ("b", 2, "A", False, 0), ("b", 2, "A", True, 2)], "key string, t long, state string, added boolean, batch int")
    assert sorted(map(tuple, streaming.settled(found, ["key"], "t").collect())) == [("a", 1, "A"), ("a", 3, "B"), ("b", 2, "A")]


def test_bodies_and_indexes_of_sitemaps(spark):
    index = "<sitemap><loc> https://x/a?b=1&amp;c=2 </loc><lastmod>2026-01-02</lastmod></sitemap><sitemap><lastmod>2026-09-09</lastmod></sitemap><sitemap>\n<loc>https://x/b</loc></sitemap>"
    bodies = spark.createDataFrame([(1, gzip.compress(index.encode())), (2, index.encode()), (3, b""), (4, None)], "k int, body binary")
    found = sitemaps.index_entries(bodies.select("k", sitemaps.body_text("body").alias("xml")), "k", "xml")
    got = sorted(map(tuple, found.collect()))
    want = [(0, "https://x/a?b=1&c=2", "2026-01-02"), (2, "https://x/b", None)]
    assert got == [(k, *w) for k in (1, 2) for w in want]
    assert sorted(map(tuple, sitemaps.newest(found, "k").collect())) == [(1, "2026-01-02"), (2, "2026-01-02")]


@pytest.mark.parametrize(("url", "want"), [
    ("https://x/catalog/g/g12/", ("product", "12")), ("https://x/catalog/g/g1234567890123", None), ("https://x/catalog/c/abc_p3/", ("category", "abc")), ("https://x/catalog/r/abc", ("genre", "abc")), ("https://x/catalog/c/-a", None),
    ("https://x/products/a%20b", ("unsupported", "a b")), ("https://x/products/%E8%B5%A4/", ("handle", "赤")), ("https://x/products/%E8", None), ("https://x/products/a?b", None), ("https://x/y/products/a", None), ("", None), (None, None),
])
def test_what_addresses_name(spark, url, want):
    got = sitemaps.addressed(spark.createDataFrame([(url,), (url,)], "url string"), "url").collect()
    assert [tuple(r) for r in got] == ([(*want, 2)] if want else [])


def test_a_doubt_makes_a_full_crawl(spark):
    shops = spark.createDataFrame([("a", True, False, ["c", "r"], 1, 3), ("b", None, False, ["c", "r"], 1, 3), ("c", True, False, ["c", "r"], None, 3), ("d", True, False, ["r", "c"], 1, 3)], "shop string, configured boolean, named boolean, families array<string>, age long, every_days int")
    planned = spark.createDataFrame([("a", "c/x", 2), ("a", "r/y", 1), ("d", "c/x", 2)], "shop string, id string, pages long")
    known = spark.createDataFrame([("a", "c/x"), ("a", "r/y"), ("d", "c/z")], "shop string, id string")
    got = rawchecks.crawl_choice(shops.withColumn("wanted", F.array(F.lit("r"), F.lit("c"))), planned, known, "shop")
    assert sorted(map(tuple, got.collect())) == [("a", "cover", None, 2, 3), ("b", "full", "not configured", 0, 0), ("c", "full", "dated ahead", 0, 0), ("d", "full", "listings gone", 1, 2)]
