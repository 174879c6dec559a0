"""The main text of web pages by composite text density.

A page becomes a tree of block elements and links; tags that only style letters are no nodes. For every node the
characters per tag are adjusted for its share of link text against the page's (the composite text density), and the
densities of its children are summed. The node with the largest sum holds the article. The least density on the path
from it up to the body is the threshold: beside the article, in the section that it stands in, subtrees of at least
that density whose own sums are a fair part of the article's are kept too, and so are headings right before kept parts.
An ``article`` element on that path is the article as a whole.

Before that, elements that are furniture by their tag, role or name are taken out: menus, page headers, footers,
sidebars, notices, adverts, forms, reader comments. Pages stream through tasks one by one; a page's tree is all that
is held.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Element names of HTML by what they mean here, and names that pages give their furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object svg math select option".split())
STYLING = frozenset(
    "abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small"
    " span strike strong sub sup time tt u var wbr".split()
)
FURNITURE_TAGS = frozenset("nav footer aside form dialog button menu head".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
FURNITURE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies"
    " consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup sidebar aside menu nav"
    " navbar navigation breadcrumb breadcrumbs footer masthead topbar share sharing social related recommended"
    " comment comments commentlist disqus reply replies respond widget toolbar pagination pager login search".split()
)
HEADER_NAMES = frozenset("header pageheader siteheader".split())
WHOLE = frozenset("html body main article".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an open paragraph or item ends at.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}

_TAG = re.compile(r"""<(?:(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']++|"[^"]*"|'[^']*'|["'])*+)>|!--|[!?/])""")
_ATTRIBUTE = re.compile(r"""\s(class|id|role|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.IGNORECASE)
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: The share of the article's density sum that another part needs to be kept beside it.
PART = 0.5


class _Node:
    __slots__ = ("chars", "children", "density", "furniture", "inside", "link_chars", "link_tags", "parent", "parts", "sum", "tag", "tags")

    def __init__(self, tag: str, parent: _Node | None, furniture: bool, inside: bool = False):
        self.tag, self.parent, self.furniture, self.inside = tag, parent, furniture, inside
        self.children: list[_Node] = []
        #: Texts and child nodes in page order.
        self.parts: list[str | _Node] = []


def _is_furniture(tag: str, attributes: str, inside: bool) -> bool:
    if tag in WHOLE:
        return False
    if tag in FURNITURE_TAGS or tag == "header" and not inside:
        return True
    if "=" not in attributes:
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        value = value.strip("\"'")
        if name.lower() == "role":
            if value.lower() in FURNITURE_ROLES:
                return True
        elif name.lower() in ("class", "id"):
            for one in value.split():
                names = [x.lower() for x in _NAMES.findall(one)]
                if not {"has", "with", "no", "without"} & set(names) and (FURNITURE_NAMES & set(names) or not inside and HEADER_NAMES & set(names)):
                    return True
    return False


def tree(page: str) -> _Node:
    """The page's nodes, as lenient as browsers: open paragraphs and items end where the next begins, end tags that
    match nothing are passed over, and what is open at the end ends there."""
    root = at = _Node("html", None, False)
    opened: Counter[str] = Counter()
    place, size = 0, len(page)

    def closed(to: _Node) -> _Node:
        """The node around ``to``, which ends with all that is open in it."""
        node = at
        while node is not to.parent:
            opened[node.tag] -= 1
            node = node.parent
        return node

    while place < size:
        found = _TAG.search(page, place)
        text = page[place : found.start() if found else size]
        if text:
            at.parts.append(text)
        if not found:
            break
        place = found.end()
        end, tag, attributes = found.groups()
        if tag is None:
            mark = "-->" if found[0] == "<!--" else ">"
            close = page.find(mark, place)
            place = size if close < 0 else close + len(mark)
            continue
        tag = tag.lower()
        if tag in STYLING:
            if tag in ("br", "img", "wbr"):
                at.parts.append(" ")
            continue
        if end:
            if opened[tag]:
                node = at
                while node.tag != tag:
                    node = node.parent
                at = closed(node)
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.IGNORECASE).search(page, place)
            place = size if close is None else close.end()
            continue
        if tag in VOID:
            at.parts.append(" ")
            continue
        if tag in ("html", "body"):
            if tag == "body":
                at = root
            continue
        if tag == "head":
            continue
        if tag in CLOSES:
            if any(opened[t] for t in CLOSES[tag]):
                node = at
                while node.parent is not None and node.tag not in STOPS[tag] and node.tag not in CLOSES[tag]:
                    node = node.parent
                if node.tag in CLOSES[tag]:
                    at = closed(node)
        elif tag != "a":
            node = at
            while node.tag == "a":
                node = node.parent
            if node.tag == "p" or node.tag in HEADINGS and tag in HEADINGS:
                at = closed(node)
        child = _Node(tag, at, _is_furniture(tag, attributes, at.inside), at.inside or tag in ("article", "main"))
        at.children.append(child)
        at.parts.append(child)
        if not attributes.endswith("/") or tag == "a":
            at = child
            opened[tag] += 1
    return root


def _without_furniture(root: _Node) -> list[_Node]:
    """The kept nodes, parents first. A named element that holds an article or the main part stays."""
    order = [root]
    for node in order:
        order.extend(node.children)
    holds = set()
    for node in reversed(order):
        if node.tag in ("article", "main") or id(node) in holds:
            node.furniture = node.furniture and node.tag in FURNITURE_TAGS
            if node.parent is not None:
                holds.add(id(node.parent))
    kept = [root]
    for node in kept:
        node.children = [c for c in node.children if not c.furniture]
        kept.extend(node.children)
    return kept


def _measured(nodes: list[_Node]) -> None:
    """Characters, tags and link characters of every subtree, composite densities and their sums over children."""
    for node in reversed(nodes):
        own = sum(len("".join(p.split())) for p in node.parts if isinstance(p, str))
        node.chars = own + sum(c.chars for c in node.children)
        node.tags = sum(c.tags + 1 for c in node.children)
        node.link_chars = node.chars if node.tag == "a" else sum(c.link_chars for c in node.children)
        node.link_tags = sum(c.link_tags + (c.tag == "a") for c in node.children)
    body = nodes[0]
    share = body.link_chars / max(body.chars, 1)
    for node in reversed(nodes):
        chars, tags = node.chars, max(node.tags, 1)
        node.density = chars / tags
        if chars and share:
            base = math.log(math.log(chars * node.link_chars / max(chars - node.link_chars, 1) + share * chars + math.e))
            odds = chars * tags / (max(node.link_chars, 1) * max(node.link_tags, 1))
            node.density *= max(math.log(odds), 0) / base if odds > 0 else 0
        node.sum = sum(c.density for c in node.children) if node.children else node.density


def _chosen(nodes: list[_Node]) -> list[_Node]:
    """The roots of the kept parts, in page order."""
    best = max(nodes, key=lambda n: n.sum)
    path, node = [best], best
    while node.parent is not None:
        node = node.parent
        path.append(node)
    threshold = min(n.density for n in path)
    if marked := [n for n in path if n.tag == "article"]:
        return marked[-1:]
    section = next((n for n in path if n.tag == "main"), path[-1])
    chosen = [best]

    def kept(siblings: list[_Node]) -> list[_Node]:
        return [n for n in siblings if n.children and n.density >= threshold and n.sum >= PART * best.sum]

    def with_heading(siblings: list[_Node], part: _Node) -> list[_Node]:
        """The part, after the headings right before it."""
        at = low = next(i for i, n in enumerate(siblings) if n is part)
        while low and siblings[low - 1].tag in HEADINGS:
            low -= 1
        return siblings[low : at + 1]

    for node, around in zip(path, path[1:], strict=False):
        if node is section:
            break
        siblings = around.children
        at = next(i for i, n in enumerate(siblings) if n is node)
        before = [x for n in kept(siblings[:at]) for x in with_heading(siblings, n)]
        after = [x for n in kept(siblings[at + 1 :]) for x in with_heading(siblings, n)]
        chosen = before + with_heading(siblings, node)[:-1] + chosen + after
    return chosen


def _blocks(roots: list[_Node]) -> Iterator[str]:
    """The text of the roots' blocks, white space turned into one space; a link is part of its block."""
    run: list[str] = []
    stack: list = list(reversed(roots))
    end = object()
    while stack:
        part = stack.pop()
        if isinstance(part, str):
            run.append(part)
            continue
        if part is not end and part.furniture:
            continue
        if part is end or part.tag != "a":
            if block := " ".join(html.unescape("".join(run)).split()):
                yield block
            run = []
        if part is not end:
            if part.tag != "a":
                stack.append(end)
            stack.extend(reversed(part.parts))
    if block := " ".join(html.unescape("".join(run)).split()):
        yield block


def main_text(page: str | None) -> str:
    """The article's blocks in page order, one on each line; empty for a page without text."""
    if not page:
        return ""
    nodes = _without_furniture(tree(page))
    _measured(nodes)
    if not nodes[0].chars:
        return ""
    return "\n".join(_blocks(_chosen(nodes)))


def extracted(pages: DataFrame, *, id: str, url: str, page: str) -> DataFrame:
    """(id, url, text, n_chars) of every row. A null or empty page has an empty text; nulls in the other columns stay,
    repeated rows are judged each, and other columns are dropped. Whole pages are read, however long."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                some = batch.slice(low, 256)
                texts = [main_text(x.as_py()) for x in some.column(2)]
                columns = [some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[id, url, "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (id, url)]
    return pages.select(id, url, page).mapInArrow(each, f"`{id}` {kinds[0]}, `{url}` {kinds[1]}, text string, n_chars long")
