"""HTML extraction by tree scoring: paragraphs give points to their ancestors, link density discounts them, the best container and its siblings are kept."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Element names of HTML, by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas xmp noembed noframes".split())
DROPPED = frozenset("head nav header footer aside form button select option dialog menu noscript template iframe svg math object canvas audio video map fieldset label input dd-menu".split())
BLOCK = frozenset("address article blockquote body center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr html li main ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
PARAGRAPH = frozenset("p pre td blockquote li dd dt".split())
CLOSES_P = BLOCK - {"html", "body", "summary", "caption", "thead", "tbody", "tfoot", "tr", "td", "th"} | {"form", "nav", "header", "footer", "aside", "fieldset", "menu"}
UNLIKELY = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|sponsor\w*|promo\w*|comments?|disqus|respond|replies|cookies?|consent|gdpr|notice|notices|alert|newsletter|subscribe|popup|modal|overlay|"
    r"sidebar|side|aside|widget\w*|related|recommend\w*|more-?stories|menu|nav|navbar|navigation|breadcrumbs?|pagination|pager|footer|foot|header|masthead|topbar|toolbar|share|sharing|social|"
    r"tags|meta|byline|login|signup|search|skip|legal|copyright|disclaimer)(?:$|[\s_-])", re.I)  # fmt: skip
LIKELY = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|hentry|main|page|post|text|story|blog)(?:$|[\s_-])", re.I)
SPACE = re.compile(r"\s+")
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|$)", re.S)
ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?", re.I)
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|$)", re.I) for name in RAW}


#: Names that end one of their like, up to what holds them.
ALIKE = ((("li",), ("ul", "ol", "menu")), (("dt", "dd"), ("dl",)), (("td", "th"), ("tr", "table")), (("tr",), ("table",)), (("option",), ("select",)))
TABLE_PARTS = frozenset("td th tr tbody thead tfoot table".split())


def unlikely(name: str, marks: str) -> bool:
    """Whether an element holds none of the text, by its name, or by a class, id or role that says so. One that names text alone, as `post` does, outweighs a
    word inside another (`post with-sidebar`), but not a whole class (`post comments`); a compound that says what it is of the text goes (`post-comments`)."""
    if name in DROPPED or name in RAW:
        return True
    if not marks or name in ("body", "article", "main", "html", "p", "h1") or not UNLIKELY.search(marks):
        return False
    own = marks.lower().split()
    return any(UNLIKELY.fullmatch(x) for x in own) or not any(LIKELY.fullmatch(x) for x in own)


class Node:
    __slots__ = ("name", "parent", "depth", "children", "marks", "score", "text", "chars", "commas", "linked", "own", "bad", "gone")

    def __init__(self, name: str, parent: Node | None, marks: str = "", bad: bool = False):
        self.name, self.parent, self.marks, self.bad = name, parent, marks, bad
        self.depth, self.gone = 0 if parent is None else parent.depth + 1, unlikely(name, marks)
        self.children: list[Node | str] = []
        self.score, self.own, self.text, self.chars, self.commas, self.linked = 0.0, 0.0, 0, 0, 0, 0


class Open:
    """The elements that are open, by name and in order of depth: what an end tag or a new element closes is found without climbing."""

    def __init__(self, root: Node):
        self.node, self.by_name, self.walls = root, {}, [root]

    def last(self, *names: str) -> Node | None:
        """The deepest open element of these names."""
        return max((x[-1] for n in names if (x := self.by_name.get(n))), key=lambda n: n.depth, default=None)

    def enter(self, n: Node) -> None:
        self.node = n
        self.by_name.setdefault(n.name, []).append(n)
        if n.name in BLOCK or n.name in DROPPED:
            self.walls.append(n)

    def close(self, x: Node) -> None:
        """Closes x and all that is open in it."""
        while self.node.depth >= x.depth:
            n = self.node
            self.by_name[n.name].pop()
            if self.walls[-1] is n:
                self.walls.pop()
            self.node = n.parent


def parse(source: str) -> Node:
    """A forgiving tree: unknown end tags are skipped, a block ends an open paragraph, list items and cells end their like, what is open at the end is closed. Every
    element is opened and closed once, whatever stands in between: time is in proportion to the page."""
    root = Node("html", None)
    at, size, now = 0, len(source), Open(root)
    while at < size:
        lt = source.find("<", at)
        if lt < 0:
            now.node.children.append(source[at:])
            break
        if lt > at:
            now.node.children.append(source[at:lt])
        m = TOKEN.match(source, lt)
        if not m:
            now.node.children.append("<")
            at = lt + 1
            continue
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                now.node.children.append(m[0][9:].removesuffix("]]>"))
            continue
        name = m[2].lower()
        if m[1]:
            x = now.last(name)
            if x is not None and name not in TABLE_PARTS and (name in BLOCK or name == "p"):
                cell = now.last("td", "th", "table")
                x = None if cell is not None and cell.depth > x.depth else x  # an end tag from outside doesn't close a cell
            if x is not None:
                now.close(x)
            continue
        if name in CLOSES_P and now.walls[-1].name == "p":
            now.close(now.walls[-1])
        for like, stop in ALIKE:
            if name in like and (x := now.last(*like, *stop)) is not None and x.name in like:
                now.close(x)
        attrs = {a[0].lower(): a[1] or a[2] or a[3] for a in ATTR.findall(m[3])} if m[3].strip(" /") else {}
        marks = " ".join(v for k, v in attrs.items() if k in ("class", "id", "role"))
        hidden = "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()
        new = Node(name, now.node, marks, hidden)
        now.node.children.append(new)
        if name in RAW:
            end = RAW_END[name].search(source, at)
            at = end.start() if end else size
            if end:
                at = source.find(">", end.start()) + 1 or size
            new.bad = True
        elif name not in VOID and (name in BLOCK or not m[3].endswith("/")):
            now.enter(new)
    return root


def _measure(root: Node) -> list[Node]:
    """Nodes in an order in which ancestors come first, without what is dropped; of each, the characters, commas and linked characters of the text below it."""
    order, stack = [], [(root, False)]
    while stack:
        n, link = stack.pop()
        link = link or n.name == "a"
        order.append(n)
        for c in n.children:
            if isinstance(c, str):
                k = len(c.strip())
                n.text += k
                n.chars += len(c)
                n.commas += c.count(",") + c.count("，")
                n.linked += k if link else 0
            elif not (c.bad or dropped(c)):
                stack.append((c, link))
    for n in reversed(order):
        if n.parent is not None:
            n.parent.text += n.text
            n.parent.chars += n.chars
            n.parent.commas += n.commas
            n.parent.linked += n.linked
    return order


def dropped(n: Node) -> bool:
    return n.gone


def density(n: Node) -> float:
    return n.linked / n.text if n.text else 0.0


def own_text(n: Node) -> str:
    parts, stack = [], [n]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            parts.append(x)
        elif x is n or not (x.bad or dropped(x)):
            stack.extend(reversed(x.children))
    return "".join(parts)


def best_container(order: list[Node]) -> Node | None:
    """The node with most points. A paragraph gives one point, one for each comma and one for each 100 characters (3 at most) to its parent, half of that to
    the next ancestor and a third of what the one below got to each further one, up to the root; loose text in a block counts as a paragraph. Points are
    discounted by link density."""
    for n in order:
        loose = "".join(c for c in n.children if isinstance(c, str)) if n.name in BLOCK and n.name not in PARAGRAPH else ""
        if loose.strip():
            n.own += (1 + loose.count(",") + loose.count("，") + min(len(loose) // 100, 3)) * (1 - density(n))
        elif n.name in PARAGRAPH and n.text and n.parent is not None:
            n.parent.own += (1 + n.commas + min(n.chars // 100, 3)) * (1 - density(n))
    for n in reversed(order):  # a node's score is its own points and what rises from below: half of the children's own, a third of what they were given
        n.score += n.own
        if n.parent is not None:
            n.parent.score += n.own / 2 + (n.score - n.own) / 3
    best, most = None, 0.0
    for n in order:
        s = n.score * (1 - density(n)) * (1.25 if n.name in ("article", "main") or LIKELY.search(n.marks or "") else 1.0)
        if n.name in ("ul", "ol", "table", "tbody", "tr", "dl"):
            s *= 0.6
        if s > most:
            best, most = n, s
    return best


def kept_nodes(best: Node) -> list[Node | str]:
    """The best container and those of its siblings that read like parts of the text: with a fifth of its points, or paragraphs that are long or whole sentences."""
    while best.parent is not None and best.name not in ("article", "main", "body", "html") and best.parent.name in ("article", "main") and not best.parent.bad:
        best = best.parent  # a part of an article stands for the article
    if best.parent is None or best.name in ("article", "main", "body", "html"):
        if best.parent is not None and best.name == "article":
            return [c for c in best.parent.children if c is best or (not isinstance(c, str) and c.name == "article" and c.score >= best.score * 0.2)]
        return [best]
    least = max(10.0, best.score * 0.2)
    out: list[Node | str] = []
    for c in best.parent.children:
        if c is best:
            out.append(c)
        elif not isinstance(c, str) and not (c.bad or dropped(c)):
            d = density(c)
            if c.score * (1 - d) >= least or c.name in PARAGRAPH and (c.text > 80 and d < 0.25 or 0 < c.text <= 80 and d == 0 and re.search(r"[.!?。](\s|$)", own_text(c))) or c.name in ("h1", "h2", "h3"):
                out.append(c)
    return out


def blocks(nodes: list[Node | str]) -> list[str]:
    """Text by block in page order; white space within a block is one space."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            t = SPACE.sub(" ", entities.unescape("".join(run))).strip()
            if t:
                out.append(t)
            run.clear()

    stack: list = list(reversed(nodes))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            run.append(x)
        elif x is None:
            flush()
        elif x.bad or dropped(x):
            continue
        elif x.name == "br":
            run.append(" ")
        elif x.name in BLOCK:
            flush()
            stack.append(None)
            stack.extend(reversed(x.children))
        else:
            stack.extend(reversed(x.children))
    flush()
    return out


def extract(source: str | None) -> str:
    """The main text of a page: empty for null, for a page without text and for one of menus only."""
    if not source:
        return ""
    root = parse(source)
    best = best_container(_measure(root))
    return "\n".join(blocks(kept_nodes(best))) if best is not None else ""


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row; repeated rows come out alike, null and empty pages have an empty text, other columns are left behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(x.as_py()) for x in b.column(2)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page of `pages`: its main text and the text's length."""
    return extract_pages(table(spark, sf_dir, "pages"))
