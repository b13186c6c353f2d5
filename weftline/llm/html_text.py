"""Main text of web pages by composite text density.

A tolerant tokenizer builds a DOM: open elements close as HTML's rules imply (a new block
ends a paragraph, the end of a parent ends its children). For every node

    density(n) = C / T * log_b(C / LC * T / LT),   b = ln(LB / CB * C + LC / NC * C + e)

with C characters of text, T tags, LC and LT those within links, NC = C - LC, and LB, CB of
the body. The log discounts link-heavy nodes ("link-adjusted characters per tag"). A node's
score is the sum of its children's densities. The threshold is the least density on the
path from the node of the largest score up to the body: from the body down, each node that
reaches it keeps its subtree of the largest score; blocks in none of these are left out.

Elements that are never content (scripts, styles, navigation, headers, footers, asides,
forms) leave the DOM first, and so do those whose class, id or role names an advert, notice,
menu, header, footer, sidebar or reader comment. Whatever else stands beside the article, only
densities tell. One page is one row: pages are read, scored and returned in one narrow pass,
in time proportional to the page; a table of few row groups is dealt over the cores first.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Element names of the HTML standard.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
DROPPED = {"script", "style", "noscript", "template", "head", "title", "nav", "footer", "aside", "form", "button", "select", "option", "textarea", "iframe", "noembed", "noframes", "xmp", "object", "embed", "svg", "math", "canvas", "audio", "video", "dialog", "menu", "input", "label", "fieldset"}
BLOCKS = {"address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: A start tag on the left closes an open element on the right, up to the nearest bound.
P_CLOSERS = BLOCKS - {"body", "caption", "html", "legend", "tbody", "td", "tfoot", "th", "thead", "tr"} | {"nav", "aside", "footer", "form", "menu", "dialog"}
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
#: The rules above by number, first that of paragraphs; a tag on the left of RULE follows it.
CLOSES = [({"p"}, {"td", "th", "table", "button", "html"})]
for _rule in IMPLIED.values():
    if _rule not in CLOSES:
        CLOSES.append(_rule)
RULE = {tag: CLOSES.index(rule) for tag, rule in IMPLIED.items()}
#: Words of class, id or role that name a part which the main text leaves out (adverts, notices,
#: menus, headers, footers, sidebars, reader comments), and what a name starts with where it
#: only says that such a part exists or is missing.
BOILERPLATE = {
    *("ad", "ads", "advert", "adverts", "advertisement", "advertisements", "sponsor", "sponsored", "promo"),
    *("banner", "notice", "cookie", "cookies", "consent", "popup"),
    *("menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs"),
    *("masthead", "footer", "contentinfo", "sidebar", "complementary"),
    *("comment", "comments", "commentlist", "replies", "respond", "disqus"),
}
HEADERS = {"".join(x) for x in product(("", "site", "page", "global", "top", "main"), ("", "-", "_"), ("header",))}
ABOUT = {"no", "has", "with", "without", "is", "js"}
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
PLAIN = re.compile(r"[^>\"']*")
LABELS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|aria-hidden\s*=\s*[\"']?(true)|=\s*(?:\"[^\"]*\"|'[^']*')|(?:^|\s)(hidden)(?=[\s=/]|$)", re.IGNORECASE)
HEADING = re.compile("h[1-6]")


class Node:
    __slots__ = ("tag", "parent", "children", "dropped", "outer", "chars", "tags", "link_chars", "link_tags", "density", "score")

    def __init__(self, tag: str, parent: Node | None, dropped: bool):
        self.tag, self.parent, self.dropped = tag, parent, dropped
        self.children: list[Node | str] = []
        # By rule: the outermost open element that it closes, inside the nearest bound.
        self.outer: list[Node | None] = parent.outer if parent else [None] * len(CLOSES)
        if tag in CHANGES:
            self.outer = self.outer.copy()
            for rule, bound in CHANGES[tag]:
                if bound or self.outer[rule] is None:
                    self.outer[rule] = None if bound else self
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.score = 0.0


#: What a tag changes: numbers of rules, and whether it is a bound there.
CHANGES = {tag: [(k, tag in bounds) for k, (tags, bounds) in enumerate(CLOSES) if tag in tags | bounds] for tag in set().union(*(tags | bounds for tags, bounds in CLOSES))}


class Scanner:
    """Markup of a page, in one pass forward: (text before it, closing, name, attributes), with
    no name for comments and declarations. Quotes hide ``>`` until one of them doesn't end;
    from there on they are plain characters, so no part of a page is searched again and again."""

    def __init__(self, page: str):
        self.page, self.at, self.quotes = page, 0, True

    def __iter__(self) -> Iterator[tuple[str, bool, str | None, str]]:
        page, n, text, seek = self.page, len(self.page), 0, 0
        while True:
            start = page.find("<", seek)
            if start < 0 or start + 1 >= n:
                break
            closing = page.startswith("/", start + 1)
            name = NAME.match(page, start + 1 + closing)
            if name:
                end = self._end(name.end())
                if end < 0:  # no markup can end any more
                    break
                attributes = page[name.end() : end]
            elif page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                end, attributes = (n if end < 0 else end + 2), ""
            elif page[start + 1] in "!?":
                end = page.find(">", start)
                end, attributes = (n if end < 0 else end), ""
            else:
                seek = start + 1
                continue
            self.at = min(n, end + 1)
            yield page[text:start], closing, name and name[0].lower(), attributes
            text = seek = self.at
        if text < n:
            self.at = n
            yield page[text:], False, None, ""

    def _end(self, at: int) -> int:
        """Where the tag ends whose attributes start here; -1 if it doesn't."""
        page, start = self.page, at
        while self.quotes:
            at = PLAIN.match(page, at).end()
            if at < len(page) and page[at] == ">":
                return at
            at = page.find(page[at], at + 1) + 1 if at < len(page) else 0
            self.quotes = at > 0
        return page.find(">", start)

    def raw(self, tag: str) -> str:
        """What stands before the end tag of the element just met; the scan goes on after it."""
        start, found = self.at, re.compile(f"</{tag}", re.IGNORECASE).search(self.page, self.at)
        close = self.page.find(">", found.end()) if found else -1
        self.at = len(self.page) if close < 0 else close + 1
        return self.page[start : found.start() if found and close >= 0 else len(self.page)]


def parse(page: str) -> Node:
    """The DOM of a page, however broken: end tags without a start are ignored, elements
    left open end with their parent. Comments and declarations leave no node. Work is in
    proportion to the page: what a tag closes is known without climbing to it."""
    root = now = Node("html", None, False)
    opened: Counter[str] = Counter()

    def leave(node: Node) -> None:
        """Close ``node`` and all that is open in it."""
        nonlocal now
        while True:
            one, now = now, now.parent
            opened[one.tag] -= 1
            if one is node:
                return

    scanner = Scanner(page)
    for text, closing, tag, labels in scanner:
        if text:
            now.children.append(text)
        if tag is None or tag == "html":
            continue
        if closing:
            if opened[tag] > 0:
                up = now
                while up.tag != tag:
                    up = up.parent
                leave(up)
            continue
        if tag in P_CLOSERS and now.outer[0] is not None:
            leave(now.outer[0])
        if tag in RULE and now.outer[RULE[tag]] is not None:
            leave(now.outer[RULE[tag]])
        bad = tag in DROPPED or (tag == "header" and not opened["article"] and not opened["main"])
        if not bad and labels and tag != "body":
            bad = any(x[3] or x[4] or _names_other(x[0] or x[1] or x[2]) for x in LABELS.findall(labels))
        node = Node(tag, now, bad)
        now.children.append(node)
        if tag in RAW:
            node.children.append(scanner.raw(tag))
        elif tag not in VOID and not labels.rstrip().endswith("/") or tag == "a":
            now = node
            opened[tag] += 1
    return root


def _names_other(names: str) -> bool:
    """Whether one of the names has a boilerplate word among its parts."""
    for name in names.lower().split():
        parts = name.replace("_", "-").split("-")
        if (name in HEADERS or not BOILERPLATE.isdisjoint(parts)) and ABOUT.isdisjoint(parts[:-1]):
            return True
    return False


def _words(text: str) -> list[str]:
    """What white space parts; NUL counts as such."""
    return text.replace("\0", " ").split()


def _kept(node: Node) -> list[Node]:
    """Nodes that stay, parents first."""
    order, todo = [], [node]
    while todo:
        one = todo.pop()
        order.append(one)
        todo.extend(c for c in reversed(one.children) if not isinstance(c, str) and not c.dropped)
    return order


def _measure(body: Node) -> list[Node]:
    """Characters, tags, densities and scores of all nodes under the body, parents first."""
    order = _kept(body)
    for node in reversed(order):
        for c in node.children:
            if isinstance(c, str):
                node.chars += len("".join(_words(c)))
            elif not c.dropped:
                node.chars += c.chars
                node.tags += 1 + c.tags
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags + 1
    share = body.link_chars / max(1, body.chars)
    for node in order:
        c, t = node.chars, max(1, node.tags)
        if c:
            base = math.log(share * c + node.link_chars * c / max(1, c - node.link_chars) + math.e)
            node.density = c / t * math.log(max(1.0, c / max(1, node.link_chars) * t / max(1, node.link_tags)) + 1) / max(base, 1e-9)
    for node in reversed(order):
        node.score = sum(c.density for c in node.children if not isinstance(c, str) and not c.dropped)
    return order


def content(body: Node) -> Node:
    """The body, without the blocks that the threshold leaves out: from the body down, each
    node whose density reaches it keeps its subtree of the largest score, and its children
    are looked at alike. Inline elements go with the text around them; headings beside what
    is kept stay. On the path to the node of the largest score, link lists go too."""
    order = _measure(body)
    blocky: set[Node] = set()  # blocks, and what holds one
    rank: dict[Node, float] = {}  # scores of what holds blocks: a bold word makes no article of its paragraph
    most: dict[Node, Node] = {}  # the node of the largest rank in each subtree
    for node in reversed(order):
        own = _children(node)
        holds = any(c in blocky for c in own)
        if holds or node.tag in BLOCKS:
            blocky.add(node)
        rank[node] = node.score if holds else 0.0
        most[node] = max([node, *(most[c] for c in own)], key=rank.__getitem__)
    best = most[body]
    if not rank[best]:
        return body
    path, up = [best], best
    while up is not body:
        up = up.parent
        path.append(up)
    threshold = min(x.density for x in path)
    whole, held, todo = set(), set(), [body]
    while todo:
        node = todo.pop()
        if node.density < threshold or node in whole:
            continue
        up = most[node]
        whole.add(up)
        if up is not node:
            todo.extend(_children(node))
        while up is not body and up.parent not in held:
            up = up.parent
            held.add(up)
    for node in held - whole:
        for c in _children(node):
            if c in blocky and c not in held and c not in whole and not HEADING.fullmatch(c.tag):
                c.dropped = True
    for inner, node in zip(path, path[1:], strict=False):
        for c in _children(node):
            if c is not inner and 2 * c.link_chars > c.chars and not HEADING.fullmatch(c.tag) and c.tag in BLOCKS:
                c.dropped = True
    return body


def _children(node: Node) -> list[Node]:
    return [c for c in node.children if not isinstance(c, str) and not c.dropped]


def blocks(node: Node) -> list[str]:
    """Texts of the blocks under a node, in page order; white space runs are one space."""
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        text = " ".join(_words(html.unescape("".join(line))))
        line.clear()
        if text:
            out.append(text)

    todo: list[tuple[Node | str, bool]] = [(node, False)]
    while todo:
        one, leave = todo.pop()
        if isinstance(one, str):
            line.append(one)
        elif leave:
            end()
        elif not one.dropped:
            if one.tag == "br":
                line.append(" ")
            if one.tag in BLOCKS:
                end()
                todo.append((one, True))
            todo.extend((c, False) for c in reversed(one.children))
    end()
    return out


def main_text(page: str) -> str:
    """The article's blocks, joined by newlines; empty for a page without text."""
    root = parse(page)
    body = next((c for c in root.children if not isinstance(c, str) and c.tag == "body"), root)
    return "\n".join(blocks(content(body)))


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(page, text): the row as it came without its html, and its main text. Null html is
    empty and gives empty text; repeated rows each return."""
    common.tune(pages.sparkSession)

    @F.arrow_udf("string")
    def extracted(found: pa.Array) -> pa.Array:
        return pa.array([main_text(x.as_py()) for x in found], pa.string())

    return common.spread(pages).select(F.struct(*[F.col(f"`{c}`") for c in pages.columns if c != html_col]).alias("page"), extracted(common.whole_text(html_col)).alias("text"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = extract(common.table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page.page_id", "page.url", "text", F.length("text").cast("long").alias("n_chars"))
