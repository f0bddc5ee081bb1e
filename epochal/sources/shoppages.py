"""Shop pages as table functions: a page in, typed rows out, or one row that says why the page is refused. A page that isn't as expected is never guessed at.

A page is read once into a flat list of what opens, what closes and what text stands between; the readers look for classes in it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import functions as F

# Entities by name; what a shop writes before its product and its counts; classes of both layouts of a listing; addresses of categories.
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "yen": "¥"}
PRODUCT, COUNT_OF, COUNT_IS = "_SIConfig.product", "_SIConfig.product.variants[", "]['inventory_quantity'] = "
CARD, TABLE = "block-cart-i--", "block-goods-list-l--"
CARD_ITEM, TABLE_ITEM, REFUSAL = "block-cart-i--goods", "js-enhanced-ecommerce-item", "block-custom-error-403"
HEADERS = ("block-genre-page--header", "block-category-list--header")
CATEGORY_PATHS = ("/mod/sgk_cart/category.php?cid=", "/mod/sgk_cart/search.php?cid=")
TAX_HEADING = "通販価格(税込)"

OPEN, CLOSE, TEXT = 0, 1, 2


class _Reader(HTMLParser):
    def __init__(self, keep_references: bool):
        super().__init__(convert_charrefs=False)
        self.found: list[tuple[int, str, dict]] = []
        self.raw = keep_references

    def handle_starttag(self, tag, attrs):
        self.found.append((OPEN, tag, {k: v or "" for k, v in reversed(attrs)}))

    def handle_endtag(self, tag):
        self.found.append((CLOSE, tag, {}))

    def handle_data(self, data):
        self.found.append((TEXT, data, {}))

    def handle_entityref(self, name):
        self.found.append((TEXT, f"&{name};" if self.raw else NAMED.get(name.lower(), f"&{name};"), {}))

    def handle_charref(self, name):
        n = int(name[1:], 16) if name[0] in "xX" else int(name)
        self.found.append((TEXT, chr(n) if 0 < n <= 0x10FFFF else f"&#{name};", {}))


class Page:
    """What opens, closes and stands in a page."""

    def __init__(self, html: str, keep_references: bool = False):
        reader = _Reader(keep_references)
        reader.feed(html)
        reader.close()
        self.parts = reader.found

    def opens(self, a: int = 0, b: int | None = None, tag: str | None = None, cls: str | None = None, starts: str | None = None) -> Iterator[int]:
        """Where elements of a tag and class (or of a class that starts so) open."""
        for i in range(a, len(self.parts) if b is None else b):
            kind, name, attrs = self.parts[i]
            if kind == OPEN and tag in (None, name):
                own = attrs.get("class", "").split()
                if (cls is None or cls in own) and (starts is None or any(c.startswith(starts) for c in own)):
                    yield i

    def first(self, a: int = 0, b: int | None = None, **what) -> int | None:
        return next(self.opens(a, b, **what), None)

    def end(self, i: int, b: int | None = None) -> int:
        """Where the element that opens at i ends."""
        tag, depth = self.parts[i][1], 0
        for j in range(i, len(self.parts) if b is None else b):
            kind, name, _ = self.parts[j]
            if name == tag and kind != TEXT:
                depth += 1 if kind == OPEN else -1
                if not depth:
                    return j
        return len(self.parts) if b is None else b

    def text(self, a: int, b: int, gap: str = "", without: str | None = None) -> str:
        """The text between two places, `gap` for each tag, without what elements of a tag hold."""
        out, i = [], a
        while i < b:
            kind, name, _ = self.parts[i]
            if kind == OPEN and name == without:
                i = self.end(i, b)
            out.append(name if kind == TEXT else gap)
            i += 1
        return "".join(out)

    def inner(self, i: int | None, b: int | None = None, **how) -> str | None:
        """The text of the element that opens at i."""
        return None if i is None else self.text(i + 1, self.end(i, b), **how)

    def attr(self, i: int | None, name: str) -> str | None:
        return None if i is None else self.parts[i][2].get(name)


def collapsed(text: str | None) -> str:
    return " ".join((text or "").split())


def ascii_collapsed(text: str | None) -> str:
    """Runs of ASCII white space become a space; full-width spaces inside stay."""
    return re.sub("[\t\n\r ]+", " ", text or "").strip()


def number(text: str | None) -> int | None:
    """Digits with commas between them at the start of a text."""
    digits = re.match("[0-9][0-9,]*", text or "")
    return int(digits[0].replace(",", "")) if digits else None


# ---- counts of a product page ----------------------------------------------------------------------------------------


class Refused(ValueError):
    pass


def script_counts(html: str, handle: str) -> dict[str, int] | None:
    """Counts by variant that the page's script sets, None without a script."""
    lines = (line.strip(" \t\r") for line in html.split("\n"))
    line = next((x for x in lines if x.startswith(f"{PRODUCT} = {{") and x.endswith("};")), None)
    if line is None:
        return None
    try:
        product = json.loads(line[len(PRODUCT) + 3 : -1])
    except ValueError:
        raise Refused("script is no JSON") from None
    if product.get("handle") != handle:
        raise Refused("page of another product")
    variants = product.get("variants")
    if not isinstance(variants, list) or not variants:
        raise Refused("script without variants")
    ids = [v.get("id") if isinstance(v, dict) else None for v in variants]
    if not all(isinstance(x, int) and not isinstance(x, bool) for x in ids):
        raise Refused("variant without id")
    counts: dict[str, int] = {}
    for piece in html.split(COUNT_OF)[1:]:
        index, told, rest = piece.partition(COUNT_IS)
        value, ended, _ = rest.partition(";")
        if not told or not ended or not re.fullmatch("[0-9]+", index) or not re.fullmatch("-?[0-9]+", value):
            continue
        if int(index) >= len(ids):
            raise Refused("count beyond the variants")
        if str(ids[int(index)]) in counts:
            raise Refused("variant counted twice")
        counts[str(ids[int(index)])] = int(value)
    if not counts:
        raise Refused("script without counts")
    return counts


def option_counts(html: str) -> dict[str, int]:
    """Counts by variant of the page's options that tell one."""
    page, counts = Page(html), {}
    for i in page.opens(tag="option"):
        told, variant = page.attr(i, "data-inventory"), page.attr(i, "value")
        if told is None:
            continue
        if not re.fullmatch("[0-9]+", variant or "") or not re.fullmatch("-?[0-9]+", told):
            raise Refused("unknown option")
        if variant in counts:
            raise Refused("variant listed twice")
        counts[variant] = int(told)
    return counts


def counts(html: str, handle: str) -> dict[str, int | None]:
    """Counts by variant: the script's, with which every option that names its variant must agree, or without a script the options'. Below 0 is no count that shows."""
    script, options = script_counts(html, handle), option_counts(html)
    if any(script is not None and k in script and script[k] != n for k, n in options.items()):
        raise Refused("script and option disagree")
    found = options if script is None else script
    if not found:
        raise Refused("no counts")
    return {k: n if n >= 0 else None for k, n in found.items()}


@F.udtf(returnType="variant string, quantity long, refused string", useArrow=True)
class StockCounts:
    """(html, handle) -> a row a variant with its count, or one row that says why the page is refused."""

    def eval(self, html: str, handle: str):
        try:
            for variant, n in counts(html or "", handle).items():
                yield variant, n, None
        except Refused as why:
            yield None, None, str(why)


# ---- listings of cards or of a table ---------------------------------------------------------------------------------


def _item(page: Page, a: int, b: int, prefix: str) -> tuple:
    """(code, name, category, model, prices, quantity, unit, status, purchasable, issues) of one product block; code is None if there is none."""
    issues = []
    title = page.first(a, b, cls=f"{prefix}goods-name")
    link = None if title is None else page.first(title, min(page.end(title, b), b), tag="a")
    linked = re.search("/catalog/g/g([0-9]+)/", page.attr(link, "href") or "")
    written = (page.inner(page.first(a, b, cls=f"{prefix}code"), b, without="strong") or "").strip()
    usable = bool(re.fullmatch("[0-9]{1,12}", written))
    code = written if usable else linked[1] if linked and len(linked[1]) <= 12 else None
    if code is None:
        return (None, None, None, None, [], None, None, None, None, ["no sales code"])
    if not usable:
        issues.append("unusable sales code")
    elif linked and linked[1] != code:
        issues.append("code disagrees with link")
    name = collapsed(page.inner(link, b))
    if not name:
        issues.append("empty name")
    model_at = page.first(a, b, cls=f"{prefix}model_number")
    if prefix == TABLE and model_at is not None:
        model_at = page.first(model_at, page.end(model_at, b), tag="p")
    model = collapsed(page.inner(model_at, b, without="strong"))
    prices = []
    for q in page.opens(a, b, cls=f"{prefix}price-qty"):
        nearby = page.first(page.end(q, b), b, tag="div")
        if nearby is None or f"{prefix}price" not in page.attr(nearby, "class").split():
            continue
        shown = re.sub(r"\s+\(", "(", collapsed(page.inner(nearby, b)))
        digits = re.search("[0-9]", shown)
        prices.append((number(shown[digits.start() :]) if digits else None, collapsed(page.inner(q, b)), "税込" in shown))
    if not prices:
        issues.append("no price block")
    told = [t for i in page.opens(a, b, starts=f"{CARD}stock-info-") if (t := collapsed(page.inner(i, b)))]
    if not told:
        issues.append("no stock status")
    able = page.first(a, b, cls=f"{CARD}available_purchase")
    shown = collapsed(page.inner(None if able is None else page.first(able, b, tag="dd"), b))
    quantity = number(shown)
    unit = re.sub("^[0-9][0-9,]*", "", shown).strip() if quantity is not None else ""
    cart = None if prefix == TABLE else any("data-purchasable-qty" in x[2] for x in page.parts[a:b] if x[0] == OPEN) or page.first(a, b, starts=f"{CARD}add_cart") is not None
    return code, name, collapsed(page.attr(link, "data-category")) or None, model or None, prices, quantity, unit or None, " / ".join(told), cart, issues


def _blocks(page: Page, tag: str, cls: str, over: tuple[str, ...]) -> list[tuple[int, int]]:
    """Where product blocks begin and end; the last ends where the tags in `over` close, one right after the other."""
    starts = list(page.opens(tag=tag, cls=cls))
    if not starts:
        return []
    inked = [i for i in range(starts[-1], len(page.parts)) if page.parts[i][0] != TEXT or page.parts[i][1].strip()]
    ends = (inked[k] for k in range(len(inked) - len(over) + 1) if all(page.parts[inked[k + n]][:2] == (CLOSE, t) for n, t in enumerate(over)))
    return list(zip(starts, [*starts[1:], next(ends, len(page.parts))]))


def _counter(page: Page, cls: str) -> int | None:
    """The number in the span inside an element of a class."""
    i = page.first(cls=cls)
    return None if i is None else number((page.inner(page.first(i + 1, page.end(i), tag="span")) or "").strip())


ITEM = "pos int, code string, name string, category string, model string, prices array<struct<amount:bigint,quantity:string,tax:boolean>>, quantity long, unit string, status string, purchasable boolean, issues array<string>"
LISTING = f"listing string, layout string, total long, page_number int, last_page int, next string, refused string, {ITEM}"


def listing(html: str) -> tuple[tuple, list[tuple]]:
    """((listing, layout, total, page, last page, next), items) of a listing page; a branch that only links to others has the layout `none`."""
    page = Page(html)
    if page.first(cls=REFUSAL) is not None:
        raise Refused("maintenance")
    head = next((i for i in page.opens(tag="h1") if set(page.attr(i, "class").split()) & set(HEADERS)), None)
    if head is None:
        raise Refused("no header")
    name = collapsed(page.inner(head))
    cards, rows = _blocks(page, "dl", CARD_ITEM, ("ul", "div")), []
    if not cards and page.first(tag="table", starts=f"{TABLE}table") is not None:
        rows = _blocks(page, "tr", TABLE_ITEM, ("tbody",))
    total = _counter(page, "pager-count")
    if total is None:
        if cards or rows:
            raise Refused("products without a total")
        return (name, "none", 0, 1, 1, None), []
    if total and not cards and not rows:
        raise Refused("no products")
    here = _counter(page, "pager-current") or 1
    hrefs = [page.attr(i, "href") or "" for i in page.opens(tag="a")]
    pages = [int(m[1]) for h in hrefs if (m := re.fullmatch("/catalog/[rc]/[A-Za-z0-9_-]+_p([0-9]+)/", h))]
    following = next((page.attr(i, "href") for t in ("a", "link") for i in page.opens(tag=t) if page.attr(i, "rel") == "next"), None)
    following = following and re.sub("^https?://[^/]+", "", following)
    items = [_item(page, a, b, TABLE if rows else CARD) for a, b in cards or rows]
    return (name, "table" if rows else "card", total, here, max([here, *pages]), following), items


@F.udtf(returnType=LISTING, useArrow=True)
class ListingItems:
    """html -> a row a product of a listing page, with what the page says of itself; a page without products, or that is refused, is one row."""

    def eval(self, html: str):
        try:
            head, items = listing(html or "")
        except Refused as why:
            yield (*[None] * 6, str(why), *[None] * 11)
            return
        for pos, item in enumerate(items):
            yield (*head, None, pos + 1, *item)
        if not items:
            yield (*head, None, *[None] * 11)


# ---- the category shop -----------------------------------------------------------------------------------------------


def _cid(page: Page, i: int, paths: tuple[str, ...]) -> int | None:
    href = page.attr(i, "href") or ""
    rest = next((href[len(p) :] for p in paths if href.startswith(p)), "")
    return int(rest) if re.fullmatch("[0-9]+", rest) else None


def category_tree(html: str, root: int) -> list[tuple[int, str, int, int | None]]:
    """(cid, name, level, parent) of the categories under `root` in a page's main area, three levels deep. The side menu lists the first level too, and must agree."""
    page = Page(html)
    main = next((i for i in page.opens(tag="div") if page.attr(i, "id") == "main"), None)
    if main is None:
        raise Refused("no main area")
    menu = {c for i in page.opens(0, main, tag="div", cls="category_sub") if page.attr(i, "data-parent-cid") == str(root) and page.parts[i + 1][1] == "a" and (c := _cid(page, i + 1, CATEGORY_PATHS[1:])) is not None}
    out: list[tuple[int, str, int, int | None]] = []
    above: list[int | None] = [None, None, None, None]
    for i in page.opens(main, tag="a"):
        before = page.parts[i - 1]
        mark, holder = (before[1], page.parts[i - 2]) if before[0] == TEXT else ("", before)
        cls = holder[2].get("class", "") if holder[0] == OPEN else ""
        level = {("div", "category_class", ""): 1, ("div", "category_lv0", "■"): 2, ("p", "", "・"): 3}.get((holder[1], cls, mark))
        end = page.end(i)
        if level is None or (c := _cid(page, i, CATEGORY_PATHS if level == 1 else CATEGORY_PATHS[1:])) is None or page.parts[min(end + 1, len(page.parts) - 1)][:2] != (CLOSE, holder[1]):
            continue
        name = ascii_collapsed(page.text(i + 1, end, " "))
        if c < 1 or not name:
            raise Refused("unreadable category")
        if any(c == x[0] for x in out):
            raise Refused("category twice")
        if level > 1 and above[level - 1] is None:
            raise Refused("category before its parent")
        out.append((c, name, level, above[level - 1]))
        above[level:] = [c, *[None] * (3 - level)]
    roots = [x[0] for x in out if x[2] == 1]
    if not roots:
        raise Refused("no categories")
    if menu != set(roots):
        raise Refused("menu and main area disagree")
    return out


@F.udtf(returnType="pos int, cid long, name string, level int, parent long, refused string", useArrow=True)
class CategoryTree:
    """(html, root) -> a row a category, or one row that says why the page is refused."""

    def eval(self, html: str, root: int):
        try:
            for pos, row in enumerate(category_tree(html or "", root)):
                yield (pos, *row, None)
        except Refused as why:
            yield (*[None] * 5, str(why))


def _code(page: Page, i: int | None) -> str | None:
    """The product that a link shows."""
    found = re.match(r"\./detail\.php\?code=([^&]+)", page.attr(i, "href") or "")
    return found[1] if found else None


def category_listing(html: str) -> tuple[tuple[int, int, int], list[tuple]]:
    """((first, last, total), (code, name, maker, model, price block, out of stock, mark) of the rows) of a category shop's listing."""
    page = Page(html, keep_references=True)
    plain = lambda t: ascii_collapsed(re.sub("&([a-z]+);", lambda m: NAMED.get(m[1], m[0]), t or ""))
    at = page.first(tag="div", cls="item_nums")
    shown = re.fullmatch(r"([0-9,]+)件[～〜~]([0-9,]+)件\(全([0-9,]+)件\)", (page.inner(at) or "").strip())
    if shown is None:
        raise Refused("no counter")
    table = page.first(tag="table", cls="item_list_table")
    if table is None:
        raise Refused("no listing table")
    over = page.end(table)
    if TAX_HEADING not in page.text(table, over):
        raise Refused("price heading changed")
    rows = []
    for i in page.opens(table, over, tag="tr", cls="item_list_row"):
        end = page.end(i, over)
        if page.first(i, end, tag="th") is not None:
            continue  # the heading
        cell = {c: page.first(i, end, tag="td", cls=f"item_list1_{c}") for c in ("image", "name", "detail")}
        if None in cell.values():
            raise Refused("row without a cell")
        link, price = page.first(cell["name"], end, tag="a"), page.first(cell["name"], end, tag="div", cls="item_list1_price")
        code = _code(page, link)
        if code is None or price is None:
            raise Refused("row without a product or price")
        if not re.fullmatch("[0-9A-Z]{1,12}(-[0-9A-Z]{1,12}){0,3}", code):
            raise Refused("unexpected code")
        image = page.first(cell["image"], page.end(cell["image"], end), tag="a")
        if code != _code(page, image) or code != _code(page, page.first(cell["detail"], page.end(cell["detail"], end), tag="a")):
            raise Refused("cells of different products")
        name = plain(page.inner(link, end, gap=" "))
        if not name:
            raise Refused("empty name")
        picture = page.first(cell["image"], page.end(cell["image"], end), tag="img")
        lines = "".join("<br>" if x[0] == OPEN and x[1] == "br" else x[1] if x[0] == TEXT else "" for x in page.parts[price + 1 : page.end(price, end)])
        mark = plain(page.inner(cell["detail"], end, gap=" "))
        rows.append((code, name, plain(page.text(cell["name"] + 1, link, " ")) or None, plain(page.attr(picture, "alt")) or None, lines, "outofstock" in page.attr(image, "class").split(), mark or None))
    return tuple(number(x) for x in shown.groups()), rows


@F.udtf(returnType="first long, last long, total long, pos int, code string, name string, maker string, model string, price_block string, out_of_stock boolean, mark string, refused string", useArrow=True)
class CategoryListing:
    """html -> a row a product of a category shop's listing, with its counter; the price block is left to `html.price_lines`."""

    def eval(self, html: str):
        try:
            counter, rows = category_listing(html or "")
        except Refused as why:
            yield (*[None] * 11, str(why))
            return
        for pos, row in enumerate(rows):
            yield (*counter, pos, *row, None)
        if not rows:
            yield (*counter, *[None] * 9)
