"""Registered queries on shop pages in the shops' own formats. Parts and suppliers stand for products and pages; faults are put in at fixed keys, and each must be refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import html as H
from ..sources import shoppages, stockpages
from ..sources.tables import spread, table
from .registry import query

COUNT_CAP = 100
CARDS, ROWS_A_PAGE = 2, 20


def _text(n: Column) -> Column:
    return n.cast("string")


def _read(pages: DataFrame, reader) -> DataFrame:
    """Pages with what a table function says of each."""
    return pages.lateralJoin(reader)


def _product_page(n: Column, size: Column) -> Column:
    """A product page: its script with two variants, and an option of the first."""
    handle = F.when(n % 13 == 1, "another").otherwise(F.concat(F.lit("h"), _text(n)))
    ids = F.when(n % 13 == 2, "[]").when(n % 13 == 3, '[{"id":11},{"sku":"x"}]').otherwise('[{"id":11},{"id":12}]')
    product = F.concat(F.lit('  _SIConfig.product = {"handle":"'), handle, F.lit('","variants":'), ids, F.when(n % 13 == 4, ",};\n").otherwise("};\n"))
    one = lambda i, count: F.concat(F.lit(f"  _SIConfig.product.variants[{i}]['inventory_quantity'] = "), count, F.lit(";\n"))
    second = F.when(n % 13 == 5, one(4, F.lit("3"))).when(n % 13 == 6, one(0, F.lit("3"))).when(n % 13 == 7, "").otherwise(one(1, F.lit("-2")))
    counted = F.when(n % 13 == 7, "").otherwise(one(0, _text(size)))
    script = F.when(n % 13 >= 10, "").otherwise(F.concat(F.lit("<script>\n"), product, counted, second, F.lit("</script>")))
    option = lambda variant, count: F.concat(F.lit(f'<option value="{variant}" data-inventory="'), count, F.lit('">one</option>'))
    options = F.when(n % 13 == 8, option(11, _text(size + 1))).when(n % 13 == 9, F.concat(option(11, _text(size)), option(99, F.lit("7")))).when(n % 13 == 10, F.concat(option(5, _text(size)), option(5, F.lit("1"))))
    options = options.when(n % 13 == 11, option("x", F.lit("1"))).when(n % 13 == 12, "<option value='7'>none</option>").otherwise(option(11, _text(size)))
    return F.concat(F.lit("<html><body>"), script, F.lit("<select>"), options, F.lit("</select></body></html>"))


@query("product_pages", """WITH p AS (SELECT p_partkey AS n, p_partkey % 13 AS k, p_size::BIGINT AS size FROM part),
r AS (SELECT n, CASE k WHEN 1 THEN 'page of another product' WHEN 2 THEN 'script without variants' WHEN 3 THEN 'variant without id' WHEN 4 THEN 'script is no JSON' WHEN 5 THEN 'count beyond the variants' WHEN 6 THEN 'variant counted twice' WHEN 7 THEN 'script without counts'
 WHEN 8 THEN 'script and option disagree' WHEN 10 THEN 'variant listed twice' WHEN 11 THEN 'unknown option' WHEN 12 THEN 'no counts' END AS refused FROM p)
SELECT n AS part, NULL AS variant, NULL AS quantity, refused FROM r WHERE refused IS NOT NULL UNION ALL SELECT n, '11', size, NULL FROM p WHERE k IN (0, 9) UNION ALL SELECT n, '12', NULL, NULL FROM p WHERE k IN (0, 9)""")
def product_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by variant of product pages with a script and options; every way in which a page may be unfit is there, and refuses it. A script alone decides."""
    n = F.col("p_partkey")
    pages = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").select(n.alias("part"), _product_page(n, F.col("p_size")).alias("html"), F.concat(F.lit("h"), _text(n)).alias("handle"))
    return _read(pages, shoppages.StockCounts(F.col("html").outer(), F.col("handle").outer())).select("part", "variant", "quantity", "refused")


@query("page_counts", f"""SELECT p_partkey AS part, CAST(CASE p_partkey % 6 WHEN 0 THEN p_size WHEN 1 THEN {COUNT_CAP} END AS BIGINT) AS shown, CASE WHEN p_partkey % 6 = 3 THEN '11=' || p_size || ',12=?' WHEN p_partkey % 12 = 11 THEN '1=' || p_size || ',2=?' END AS counts,
CASE WHEN p_partkey % 6 < 3 THEN 'no counts' WHEN p_partkey % 6 = 4 THEN 'script and option disagree' WHEN p_partkey % 12 = 5 THEN 'variant listed twice' END AS refused FROM part""")
def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts as a line of text, in a script, as options, in both, and pages whose signs contradict each other."""
    n, size = F.col("p_partkey"), _text(F.col("p_size"))
    script = F.concat(F.lit('_SIConfig.product = {"handle":"h","variants":[{"id":11},{"id":12}]};\n_SIConfig.product.variants[0][\'inventory_quantity\'] = '), size, F.lit(";\n_SIConfig.product.variants[1]['inventory_quantity'] = -2;\n"))
    option = lambda value, count: F.concat(F.lit(f'<option value="{value}" data-inventory="'), count, F.lit('">'))
    html = (
        F.when(n % 6 == 0, F.concat(F.lit("<p>在庫数: "), size, F.lit("</p>"))).when(n % 6 == 1, f"在庫数：{COUNT_CAP}+").when(n % 6 == 2, "在庫数: 7+")
        .when(n % 6 == 3, F.concat(script, option(11, size))).when(n % 6 == 4, F.concat(script, option(11, _text(F.col("p_size") + 1))))
        .when(n % 12 == 5, F.concat(option(1, size), option(1, size))).otherwise(F.concat(option(1, size), option(2, F.lit("-1"))))
    )
    pages = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").select(n.alias("part"), html.alias("html"))
    read = _read(pages, shoppages.StockCounts(F.col("html").outer(), F.lit("h"))).withColumn("shown", stockpages.single_count(F.col("html"), COUNT_CAP))
    each = F.when(F.col("variant").isNotNull(), F.concat_ws("=", "variant", F.coalesce(_text(F.col("quantity")), F.lit("?"))))
    return read.groupBy("part").agg(F.first("shown").alias("shown"), F.nullif(F.array_join(F.array_sort(F.collect_list(each)), ","), F.lit("")).alias("counts"), F.max("refused").alias("refused"))


def _product(n: Column, cards: bool) -> Column:
    """A product of a listing, as a card or as a row of the table, with what some of them lack."""
    c, t = (shoppages.CARD if cards else shoppages.TABLE), _text(n)
    written = F.when(n % 17 == 1, "??").when(n % 19 == 1, _text(n + 1)).otherwise(t)
    link = F.when(n % 17 == 1, F.concat(F.lit("/catalog/g/g"), t, F.lit("/"))).when(n % 23 == 1, "/elsewhere/").otherwise(F.concat(F.lit("/catalog/g/g"), t, F.lit("/")))
    title = F.concat(F.lit(f'<div class="{c}goods-name"><a href="'), link, F.lit('" title="x" class="js-enhanced-ecommerce-goods-name" data-category="Kind('), _text(n % 5), F.lit(')" data-brand="">'), "p_name", F.lit(" &amp; <b>co</b></a></div>\n"))
    code = F.concat(F.lit(f'<div class="{c}code"><strong>販売コード：</strong>'), written, F.lit("</div>\n"))
    yen = F.format_number(F.floor("p_retailprice"), 0)
    price = F.concat(F.lit(f'<div class="{c}price-items2">\n<div class="{c}price-qty">\n  1個\n</div>\n<div class="{c}price price js-enhanced-ecommerce-goods-price">￥'), yen, F.lit(("" if cards else "～") + '<span class="tax">(税込)</span></div>\n</div>'))
    price = F.when(n % 7 == 1, "").otherwise(price)
    status = F.when(n % 5 == 1, "").otherwise('<div class="block-cart-i--stock-info-green">在庫あり</div>\n<div class="block-cart-i--stock-info-blue">取寄 &lt;3日&gt;</div>\n')
    model = F.concat(F.lit("SYN-"), t)
    if not cards:
        cells = F.concat(F.lit('<td class="x">'), status, F.lit('</td><td class="block-goods-list-l--goods-name-items">'), title, code, F.lit(f'</td><td class="{c}price-infos">'), price, F.lit(f'</td><td class="{c}model_number">\n<p>'), F.when(n % 3 == 1, "").otherwise(model), F.lit("</p>\n</td>"))
        return F.concat(F.lit('<tr class="js-enhanced-ecommerce-item ">\n'), cells, F.lit("</tr>\n"))
    own = F.when(n % 3 == 1, "").otherwise(F.concat(F.lit(f'<div class="{c}model_number"><strong>型番：</strong>'), model, F.lit("</div>\n")))
    cart = F.concat(F.lit(f'<dl class="{c}available_purchase"><dt>通販購入可能数：</dt><dd>'), _text(F.col("p_size")), F.lit(f'個</dd></dl>\n<dl class="{c}purchase_qty"><dt>数量：</dt><dd><input name="q" data-purchasable-qty="1"></dd></dl>\n'))
    return F.concat(F.lit('<dl class="block-cart-i--goods js-enhanced-ecommerce-item goods-">\n<dd class="block-cart-i--goods-description">\n'), title, own, code, price, status, F.when(n % 4 == 1, "").otherwise(cart), F.lit("</dd>\n</dl>\n"))


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page, html): parts by 20, in cards or in a table; some pages have no header, no total, no products, or say that the shop is closed."""
    n = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(F.floor(n / ROWS_A_PAGE).alias("page"), n.alias("n"), F.when(F.floor(n / ROWS_A_PAGE) % 3 == CARDS, _product(n, False)).otherwise(_product(n, True)).alias("item"))
    p = F.col("page")
    pages = rows.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "item"))), lambda x: x["item"]), "").alias("body"))
    cards = F.concat(F.lit('<div class="block-cart-i">\n<ul class="block-cart-i--items">\n<li>'), "body", F.lit("</li></ul>\n</div>"))
    rows_ = F.concat(F.lit('<div class="block-goods-list-l">\n<table class="block-goods-list-l--table">\n<thead><tr><th>x</th></tr></thead>\n<tbody>\n'), "body", F.lit("</tbody>\n</table></div>"))
    list_ = F.when(p % 31 == 3, "").when(p % 3 == CARDS, rows_).otherwise(cards)
    head = F.when(p % 31 == 1, "").otherwise(F.concat(F.when(p % 2 == 0, '<h1 class="h1 block-category-list--header">').otherwise('<h1 class="h1 block-genre-page--header">'), F.lit("List &amp; "), _text(p), F.lit("</h1>")))
    count = F.when(p % 31 == 2, "").otherwise('<span class="pager-count"><span>1,234</span>件あります</span><ul class="pagination"><li class="pager-current"><span>2</span></li><li><a href="/catalog/c/x_p9/">9</a></li></ul><a rel="next" href="/catalog/c/x_p3/">次</a>')
    index = F.concat(F.lit('<h1 class="h1 block-category-list--header">Branch</h1><ul><li><a href="/catalog/c/y/">y</a></li></ul>'))
    html = F.when(p % 31 == 4, '<div class="block-custom-error-403"><p>closed</p></div>').when(p % 31 == 5, index).otherwise(F.concat(head, count, list_, F.when(p % 31 == 2, "").otherwise('<div class="pager-total"><span class="pager-count"><span>1,234</span></span></div>')))
    return pages.select("page", html.alias("html"))


@query("shop_listings", f"""WITH b AS (SELECT p_partkey AS n, p_partkey // {ROWS_A_PAGE} AS page, p_name, p_size, CAST(floor(p_retailprice) AS BIGINT) AS y, (p_partkey // {ROWS_A_PAGE}) % 3 = {CARDS} AS t FROM part),
k AS (SELECT DISTINCT page, t, page % 31 AS f FROM b),
i AS (SELECT *, CAST(row_number() OVER (PARTITION BY page ORDER BY n) AS INTEGER) AS pos, CASE WHEN n % 17 <> 1 AND n % 19 = 1 THEN n + 1 ELSE n END::VARCHAR AS code FROM b WHERE page % 31 NOT IN (1, 2, 3, 4, 5))
SELECT page, CASE WHEN t THEN 'table' ELSE 'card' END AS layout, 9 AS last_page, NULL AS refused, pos, code, p_name || ' & co' AS name, 'Kind(' || n % 5 || ')' AS category, CASE WHEN n % 3 <> 1 THEN 'SYN-' || n END AS model, CASE WHEN n % 7 <> 1 THEN y END AS price,
CASE WHEN NOT t AND n % 4 <> 1 THEN p_size END::BIGINT AS quantity, CASE WHEN NOT t AND n % 4 <> 1 THEN '個' END AS unit, CASE WHEN n % 5 = 1 THEN '' ELSE '在庫あり / 取寄 <3日>' END AS status, CASE WHEN NOT t THEN n % 4 <> 1 END AS purchasable,
concat_ws('; ', CASE WHEN n % 17 = 1 THEN 'unusable sales code' WHEN n % 19 = 1 AND n % 23 <> 1 THEN 'code disagrees with link' END, CASE WHEN n % 7 = 1 THEN 'no price block' END, CASE WHEN n % 5 = 1 THEN 'no stock status' END) AS issues FROM i
UNION ALL SELECT page, CASE WHEN f = 5 THEN 'none' END, CASE WHEN f = 5 THEN 1 END, CASE f WHEN 1 THEN 'no header' WHEN 2 THEN 'products without a total' WHEN 3 THEN 'no products' WHEN 4 THEN 'maintenance' END, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM k WHERE f IN (1, 2, 3, 4, 5)""")
def shop_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of listings in both layouts, each with what is amiss with it; pages that are refused, and branches without products, are a row each."""
    read = _read(listing_pages(spark, sf_dir), shoppages.ListingItems(F.col("html").outer()))
    return read.select("page", "layout", "last_page", "refused", "pos", "code", "name", "category", "model", F.get("prices", F.lit(0))["amount"].alias("price"), "quantity", "unit", "status", "purchasable", F.when(F.col("pos").isNotNull(), F.array_join("issues", "; ")).alias("issues"))


_TREE = """c AS (SELECT s_suppkey AS supplier, s_suppkey % 23 AS f, i, j, k, 100 * i + 10 * j + k AS cid FROM supplier, generate_series(1, 3) a(i), generate_series(0, 2) b(j), generate_series(0, 1) d(k)
 WHERE i <= s_suppkey % 3 + 1 AND j <= s_suppkey % 2 + 1 AND (k = 0 OR j > 0))"""


@query("category_trees", f"""WITH {_TREE} SELECT supplier, CAST(row_number() OVER (PARTITION BY supplier ORDER BY cid) - 1 AS INTEGER) AS pos, cid, 'Kind & ' || cid AS name, CAST(CASE WHEN j = 0 THEN 1 WHEN k = 0 THEN 2 ELSE 3 END AS INTEGER) AS level,
CASE WHEN j = 0 THEN NULL WHEN k = 0 THEN 100 * i ELSE 100 * i + 10 * j END AS parent, NULL AS refused FROM c WHERE f NOT IN (1, 2, 3, 4, 5, 6)
UNION ALL SELECT s_suppkey, NULL, NULL, NULL, NULL, NULL, CASE s_suppkey % 23 WHEN 1 THEN 'no main area' WHEN 2 THEN 'menu and main area disagree' WHEN 3 THEN 'category twice' WHEN 4 THEN 'category before its parent' WHEN 5 THEN 'unreadable category' ELSE 'no categories' END
FROM supplier WHERE s_suppkey % 23 IN (1, 2, 3, 4, 5, 6)""")
def category_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page a supplier: categories of three levels in its main area, the first level in its side menu too. Pages whose parts disagree are refused."""
    s = F.col("s_suppkey")
    f = s % 23
    link = lambda cid, name="Kind &amp;  ", page="search": F.concat(F.lit(f'<a href="/mod/sgk_cart/{page}.php?cid='), _text(cid), F.lit(f'"> {name}'), _text(cid) if name else F.lit(""), F.lit("</a>"))
    upto = lambda m: F.sequence(F.lit(1).cast("long"), (s % m + 1).cast("long"))
    third = lambda c: F.concat(F.lit("<p>・"), link(c), F.lit("</p>"))
    under = lambda i: F.transform(upto(2), lambda j: F.concat(F.lit('<div class="category_lv0">■'), link(i * 100 + j * 10), F.lit("</div>"), third(i * 100 + j * 10 + 1)))
    body = F.transform(upto(3), lambda i: F.concat(F.lit('<div class="category_class">'), link(i * 100, page="category"), F.lit("</div>"), F.array_join(under(i), "\n")))
    menu = F.transform(upto(3), lambda i: F.concat(F.lit('<div class="category_sub" data-parent-cid="9">'), link(i * 100), F.lit("</div>")))
    menu = F.array_join(F.when(f == 2, F.slice(menu, 2, 9)).otherwise(menu), "\n")
    extra = F.when(f == 3, F.concat(F.lit('<div class="category_lv0">■'), link(F.lit(110)), F.lit("</div>"))).when(f == 5, F.concat(F.lit("<p>・"), link(F.lit(111), ""), F.lit("</p>"))).otherwise("")
    main = F.when(f == 6, "").when(f == 4, F.concat(third(F.lit(7)), F.array_join(body, "\n"))).when(f == 5, F.concat(F.lit('<div class="category_class">'), link(F.lit(100)), F.lit('</div><div class="category_lv0">■'), link(F.lit(110)), F.lit("</div>"), extra)).otherwise(F.concat(F.array_join(body, "\n"), extra))
    html = F.concat(F.lit('<div class="category_sub" data-parent-cid="8">'), link(F.lit(9)), F.lit("</div>"), menu, F.when(f == 1, "<div>").otherwise('<div id="main">'), main, F.lit("</div>"))
    pages = table(spark, sf_dir, "supplier").select(s.alias("supplier"), html.alias("html"))
    return _read(pages, shoppages.CategoryTree(F.col("html").outer(), F.lit(9))).select("supplier", "pos", "cid", "name", "level", "parent", "refused")


@query("category_listings", f"""WITH b AS (SELECT p_partkey AS n, p_partkey // {ROWS_A_PAGE} AS page, p_name, p_size::BIGINT AS s, CAST(floor(p_retailprice) AS BIGINT) AS y, (p_partkey // {ROWS_A_PAGE}) % 29 AS f FROM part), g AS (SELECT page, f, max(n) AS top FROM b GROUP BY ALL),
i AS (SELECT *, CAST(row_number() OVER (PARTITION BY page ORDER BY n) - 1 AS INTEGER) AS pos FROM b WHERE f NOT IN (1, 2, 3, 4, 5))
SELECT page, 1234 AS total, pos, 'EE-' || n AS code, p_name AS name, CASE WHEN n % 3 <> 0 THEN 'Maker' END AS maker, 'M ' || n AS model, CASE WHEN n % 7 = 0 THEN 1 ELSE 2 END AS n_lines, CASE WHEN n % 7 <> 0 THEN y END AS low, n % 5 = 0 AS out_of_stock, CASE WHEN n % 5 = 0 THEN '×' ELSE '在庫 ○' END AS mark, NULL AS refused FROM i
UNION ALL SELECT page, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, CASE f WHEN 1 THEN 'no counter' WHEN 2 THEN 'no listing table' WHEN 3 THEN 'price heading changed' WHEN 4 THEN 'cells of different products' ELSE 'unexpected code' END FROM g WHERE f IN (1, 2, 3, 4, 5)""")
def category_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a category shop's listings, parts by 20; descriptions hold markup of their own. Listings that have lost their shape are refused as a whole."""
    n = F.col("p_partkey")
    f = F.floor(n / ROWS_A_PAGE) % 29
    code = F.concat(F.when(f == 5, "ee-").otherwise("EE-"), _text(n))
    href = F.concat(F.lit("./detail.php?code="), code)
    lines = F.when(n % 7 == 0, "価格お見積り&nbsp;¥0<br>").otherwise(F.concat(F.lit("【数量1個〜】単価&nbsp;¥"), F.format_number(F.floor("p_retailprice"), 0), F.lit("<br>\n【数量10個〜】まとめ単価&nbsp;&yen;9<br />")))
    row = F.concat(
        F.lit('<tr class="item_list_row"><td class="item_list1_image"><a class="item '), F.when(n % 5 == 0, "outofstock").otherwise("x"), F.lit('" href="'), href, F.lit('"><img src="i.png" alt="M '), _text(n), F.lit('"></a></td><td class="item_list1_name">'),
        F.when(n % 3 != 0, "<span>Maker</span><br>").otherwise(""), F.lit('<a href="'), href, F.lit('">'), "p_name", F.lit('</a><br><div class="item_list1_description">said <b>so</b></div><div class="item_list1_price">'), lines, F.lit('</div></td><td class="item_list1_detail"><a href="'),
        F.when(f == 4, "./detail.php?code=OTHER").otherwise(href), F.when(n % 5 == 0, '">×</a>').otherwise('">在庫</a>&nbsp;○'), F.lit("</td></tr>\n"),
    )
    rows = table(spark, sf_dir, "part").select(F.floor(n / ROWS_A_PAGE).alias("page"), n.alias("n"), row.alias("row"))
    p = F.col("page") % 29
    pages = spread(rows, "page").groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "row"))), lambda x: x["row"]), "").alias("body"))
    counter = F.when(p == 1, "").otherwise('<div class="item_nums"> 1件～40件(全1,234件) </div>')
    heading = F.concat(F.lit('<tr class="item_list_row"><th>'), F.when(p == 3, "価格").otherwise(shoppages.TAX_HEADING), F.lit("</th></tr>"))
    html = F.concat(counter, F.when(p == 2, "<table>").otherwise('<table class="t item_list_table" border="0">'), heading, "body", F.lit("</table>"))
    read = _read(pages.select("page", html.alias("html")), shoppages.CategoryListing(F.col("html").outer()))
    priced = H.price_lines(F.col("price_block"))
    return read.select("page", "total", "pos", "code", "name", "maker", "model", F.when(F.col("code").isNotNull(), F.size(priced)).alias("n_lines"), F.array_max(F.transform(priced, lambda x: x["amount"])).alias("low"), "out_of_stock", "mark", "refused")
