"""Page readers, codes and publication checks."""

import pytest
from pyspark.sql import functions as F

from epochal.operators import codes, publication
from epochal.plans import checks, pages
from epochal.sources import html as html_source
from epochal.sources import shoppages
from epochal.sources import stockpages as P


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("html", "want"), [("<p>在庫数: 12</p>", 12), ("在庫数：100+", 100), ("在庫数: 7+", None), ("在庫数: 1 在庫数: 2", None), ("none", None)])
def test_single_count(spark, html, want):
    assert one(spark, P.single_count(F.lit(html), 100)) == want


SCRIPT = """<script>
  _SIConfig.product = {"handle":"h","variants":[{"id":11},{"id":12}]};
  _SIConfig.product.variants[0]['inventory_quantity'] = 5;
  _SIConfig.product.variants[1]['inventory_quantity'] = -2;
</script><option value="11" data-inventory="5">a</option>"""


@pytest.mark.parametrize(
    ("old", "new", "want"),
    [
        ("", "", {"11": 5, "12": None}), ('value="11" data-inventory="5"', 'value="99" data-inventory="3"', {"11": 5, "12": None}), ('data-inventory="5"', 'data-inventory="6"', "script and option disagree"), ('"handle":"h"', '"handle":"other"', "page of another product"),
        ("variants[1]", "variants[4]", "count beyond the variants"), ("variants[1]", "variants[0]", "variant counted twice"), ('{"id":12}', "{}", "variant without id"), ('[{"id":11},{"id":12}]', "[]", "script without variants"), ("]};", "],};", "script is no JSON"),
        ('value="11"', 'value="x"', "unknown option"), ("inventory_quantity", "other", "script without counts"), ("_SIConfig.product = ", "product = ", {"11": 5}),
    ],
)
def test_counts_of_scripts_and_options(old, new, want):
    page = SCRIPT.replace(old, new) if old else SCRIPT
    if isinstance(want, str):
        with pytest.raises(shoppages.Refused, match=want):
            shoppages.counts(page, "h")
    else:
        assert shoppages.counts(page, "h") == want


def test_pages_without_counts_are_refused():
    for page, why in (("", "no counts"), ('<option value="1" data-inventory="3"><option value="1" data-inventory="3">', "variant listed twice"), ("<option value='1'>", "no counts")):
        with pytest.raises(shoppages.Refused, match=why):
            shoppages.counts(page, "h")


def test_table_functions_take_null_and_odd_pages(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "<"), (4, "<p>&#99999999;&x;" + "<b>" * 2000)], "k int, html string")
    assert pages.lateralJoin(shoppages.StockCounts(F.col("html").outer(), F.lit("h"))).where("refused = 'no counts'").count() == 4
    assert pages.lateralJoin(shoppages.ListingItems(F.col("html").outer())).where("refused = 'no header'").count() == 4
    assert pages.lateralJoin(shoppages.CategoryTree(F.col("html").outer(), F.lit(1))).where("refused = 'no main area'").count() == 4
    assert pages.lateralJoin(shoppages.CategoryListing(F.col("html").outer())).where("refused = 'no counter'").count() == 4


def test_a_branch_lists_nothing_and_a_listing_ends_where_its_items_do():
    assert shoppages.listing('<h1 class="h1 block-category-list--header">A &amp; B</h1>') == (("A & B", "none", 0, 1, 1, None), [])
    item = '<dl class="block-cart-i--goods x"><div class="block-cart-i--goods-name"><a href="/catalog/g/g101/">N</a></div><div class="block-cart-i--code"><strong>c</strong>101</div>'
    html = f'<h1 class="block-genre-page--header">G</h1><span class="pager-count"><span>1</span></span><ul>{item}</dl></ul></div><div class="block-cart-i--stock-info-a">later</div>'
    (head, items) = shoppages.listing(html)
    assert head == ("G", "card", 1, 1, 1, None) and [(x[0], x[1], x[7], x[9]) for x in items] == [("101", "N", "", ["no price block", "no stock status"])]


def test_listing_items(spark):
    item = '<div class="block-cart-i--item"><div class="block-cart-i--goods-name"> <a href="/catalog/g/g{0}/" data-category="x">Part &amp; more</a></div><div class="block-cart-i--code"><strong>c</strong> {1}</div><div class="block-cart-i--price price">¥1,200(税込)</div><div class="block-cart-i--stock-info-a">在庫</div></div>'
    pages = spark.createDataFrame([(1, "<h1>x</h1>" + item.format(101, 101) + item.format(102, "??") + item.format(103, 104)), (2, "nothing")], "k int, html string")
    got = [(r.code, r.name, r.price, r.status, r.purchasable, r.issues) for r in P.listing_items(pages, "k", "html").orderBy("pos").collect()]
    assert got == [("101", "Part & more", 1200, "在庫", False, []), ("102", "Part & more", 1200, "在庫", False, ["unusable code text"]), ("104", "Part & more", 1200, "在庫", False, ["code disagrees with link"])]


def test_category_tree():
    a = lambda cid, name: f'<a href="/mod/sgk_cart/search.php?cid={cid}">{name}</a>'
    menu = "".join(f'<div class="category_sub" data-parent-cid="7">{a(c, "x")}</div>' for c in (1, 4))
    html = f'{menu}<div id="main"><div class="category_class">{a(1, "A　a")}</div><div class="category_lv0">■{a(2, "B")}</div><p>・{a(3, "C")}</p><div class="category_class">{a(4, "D")}</div></div>'
    assert shoppages.category_tree(html, 7) == [(1, "A　a", 1, None), (2, "B", 2, 1), (3, "C", 3, 2), (4, "D", 1, None)]
    for old, new, why in ((menu, "", "disagree"), ("cid=4", "cid=1", "twice"), ('<div class="category_lv0">■', "<p>", "before its parent"), (">B<", "> <", "unreadable"), ('id="main"', "", "no main area")):
        with pytest.raises(shoppages.Refused, match=why):
            shoppages.category_tree(html.replace(old, new), 7)


@pytest.mark.parametrize(
    ("values", "store", "maker", "want"),
    [(["M5STACK-K033"], "akizuki", "", ["K033"]), (["M5STACK-K033"], "x", "M5Stack", ["K033"]), (["RPI-SC1677"], "x", "Raspberry Pi Trading", ["SC1677"]), (["ARDUINO-ABX00162", "", None], "x", "Arduino", ["ABX00162"]), (["SKU:123456"], "akizuki", "", ["123456"]), (["SKU:123456"], "x", "", ["SKU:123456"])],
)
def test_identity_codes(spark, values, store, maker, want):
    assert one(spark, codes.identity_codes(F.array(*[F.lit(v) for v in values]).cast("array<string>"), F.lit(store), F.lit(maker))) == want


@pytest.mark.parametrize(
    ("own", "store", "vendor", "want"),
    [
        (["TC74HC138AP(F)"], "x", "", ["TC74HC138AP"]), (["PIM185/PIM208"], "x", "", ["PIM185", "PIM208"]), (["PIC16F84A-20I/SS"], "x", "", []), (["LMC660CN/NOPB"], "x", "", ["LMC660CN"]), (["SFE-BOB-11083"], "x", "", ["BOB-11083"]),
        (["ADA6044"], "pimoroni", "Adafruit", ["ADA-6044"]), (["POLOLU-3424"], "x", "", []), (["SEEED-113990234"], "x", "", ["113990234"]), (["114020161/114020163"], "akizuki", "", ["114020161", "114020163"]),
    ],
)
def test_derived_codes(spark, own, store, vendor, want):
    assert sorted(one(spark, codes.derived_codes(F.array(*map(F.lit, own)), F.lit(store), F.lit(vendor)))) == sorted(want)


def test_references_and_tags(spark):
    assert tuple(one(spark, codes.resale_reference(F.lit("SSCI-012164/1216")))) == ("SSCI-012164", "1216")
    assert one(spark, codes.resale_reference(F.lit("123/1216"))) is None
    assert one(spark, codes.page_reference(F.lit("shop"), F.lit("12 a"))) == "SHOP/12A"
    assert one(spark, codes.tag_value(F.array(F.lit("code:prefix:x"), F.lit("code:K1")), "code:")) == "K1"


def test_dictionary_round_trip_and_shards(spark):
    rel = spark.createDataFrame([("b", "a"), ("b", "c"), ("x", "y"), ("p", "q"), ("q", "r")], "a string, b string")
    rows, table = publication.encode(rel, ["a", "b"])
    assert {r.s: r.i for r in table.collect()}["b"] == 0
    assert sorted(map(tuple, publication.decode(rows, table, ["a", "b"]).select("a", "b").collect())) == sorted(map(tuple, rel.collect()))
    got = publication.shards(rel, 2).collect()
    assert len({r.shard for r in got if r.component == "a"}) == 1 and {r.shard for r in got} == {0, 1}
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(60) if i % 7 and i % 5], "a string, b string")
    got = publication.shards(chain, 3).collect()
    assert len({(r.component, r.shard) for r in got}) == len({r.component for r in got}) and {r.shard for r in got} == {0, 1, 2}


def test_shards_are_filled_like_the_heaviest_first():
    import random

    from epochal.operators import graph

    rng = random.Random(5)
    for _ in range(200):
        counts = {rng.randrange(1, 40): rng.randrange(1, 30) for _ in range(rng.randrange(1, 8))}
        n = rng.randrange(1, 9)
        load = [0] * n
        for w in sorted(counts, reverse=True):
            for _ in range(counts[w]):
                load[min(range(n), key=lambda j: (load[j], j))] += w
        got = [0] * n
        for w, spots in graph.fill_shards(counts, n).items():
            assert sum(k for _, k, _ in spots) == counts[w]
            for _, k, i in spots:
                got[i] += k * w
        assert sorted(got) == sorted(load)


def test_dataset_checks(spark):
    good = [(1, "exact", 5, 5), (2, "unavailable", None, None), (3, "range", 5, 6)]
    row = lambda k, v, prices: ("s", k, v, [("o", [(prices, [(1, True)])])])
    schema = "store string, product string, version string, offers array<struct<offer:string,segments:array<struct<prices:array<struct<t:int,state:string,low:int,high:int>>,presence:array<struct<t:int,present:boolean>>>>>>"
    bad = [row("a", "v", good), row("b", "w", good), row("c", "v", good[::-1]), row("d", "v", [(1, "exact", 5, 6)]), row("a", "v", good)]
    got = {r.issue: r.n for r in publication.dataset_issues(spark.createDataFrame(bad, schema), "v").collect()}
    assert got == {"repeated key": 2, "another version": 1, "times do not rise": 1, "amounts do not fit": 1}


@pytest.mark.parametrize("query", [checks.price_lines, pages.product_pages])
def test_pages_are_read_by_many_tasks(spark, query):
    assert query(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    assert str(html_source.price_lines(F.col("block"))).count("split(") == 1
