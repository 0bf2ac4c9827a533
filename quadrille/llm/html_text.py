"""Main text of web pages by tree scoring.

A page is parsed into a tree of elements and blocks of text.  Each block gives
points for its length and commas to its ancestors, less the farther they are;
a container's points are discounted by its link density.  The best container's
blocks are the text, with those of siblings that score enough themselves.
What is marked as something other than the article (menus, headers, footers,
sidebars, notices, adverts, forms, comments) is out before scoring.

One map-only Arrow pass; a page is held alone.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import map_arrow, table

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|<(?=[a-zA-Z/!?])[^>]*\Z", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title noscript template iframe noembed noframes xmp".split())
_INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike"
    " strong sub sup time tt u var wbr br img".split()
)
#: A start tag ends an open element of these, looked for no farther than the given boundary.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
_P_BOUNDARY = set("table td th button caption object".split())

#: Elements that are never part of an article.
_OUT_TAGS = set("head nav footer aside form button select dialog menu svg canvas audio video object math fieldset".split())
_OUT_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
#: Parts of class names and ids that mark something other than the article.
_OUT_NAMES = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side aside menu nav navbar"
    " navigation breadcrumb breadcrumbs footer foot masthead comment comments commentlist respond disqus reply replies discussion"
    " cookie cookies consent gdpr notice notices alert popup modal overlay subscribe subscription newsletter signup login share sharing"
    " social related recommended widget toolbar pagination pager skip hidden".split()
)
_ABOUT_OTHERS = set("has with no without is".split())
_HEADER_NAMES = {"header", "topbar", "top"}
_ARTICLE_TAGS = {"article", "main"}
_ARTICLE_NAMES = set("article content main post entry story body text".split())

MIN_LINK_DENSITY = 0.5


class Node:
    """An element, and what is known of it from its ancestors, so that none of them is looked up again.

    ``inside`` says whether it or an ancestor is an article, ``anchors`` counts
    the links around it, ``block`` is the nearest element that is not inline,
    and ``in_p`` whether a paragraph is open that a block ends.
    """

    __slots__ = ("anchors", "block", "in_p", "inside", "link", "links", "names", "out", "parent", "score", "size", "tag")

    def __init__(self, tag: str, parent: Node | None, out: bool, names: set[str]):
        self.tag, self.parent, self.out, self.names = tag, parent, out, names
        self.inside = tag in _ARTICLE_TAGS or (parent is not None and parent.inside)
        self.anchors = (tag == "a") + (parent.anchors if parent else 0)
        self.block = parent.block if parent and tag in _INLINE else self
        self.in_p = tag == "p" or (parent is not None and parent.in_p and tag not in _P_BOUNDARY)
        self.score = 0.0
        self.size = self.link = self.links = 0


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)} if raw else {}


def _names(raw: str) -> set[str]:
    """Parts of class names and ids; names like has-sidebar say something about the page, not about the element."""
    out: set[str] = set()
    for name in raw.split():
        parts = [x.lower() for x in _NAME_PART.findall(name)]
        if parts and parts[0] not in _ABOUT_OTHERS:
            out.update(parts)
    return out


def _open(tag: str, raw: str, parent: Node) -> Node:
    names: set[str] = set()
    out = parent.out or tag in _OUT_TAGS
    if raw and not raw.isspace():
        a = _attributes(raw)
        names = _names(f"{a.get('class', '')} {a.get('id', '')}")
        style = a.get("style", "").replace(" ", "").lower()
        out = out or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in style or a.get("role", "").lower() in _OUT_ROLES
    if not out and tag not in ("html", "body"):
        header = tag == "header" or names & _HEADER_NAMES
        if tag not in _ARTICLE_TAGS:
            out = bool(names & _OUT_NAMES) or bool(header and not parent.inside)
    return Node(tag, parent, out, names)


def blocks(page: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """All elements, parents first, and each block of text with the element it stands in, in page order.

    Time and memory are in proportion to the page, however deep its elements are nested.
    """
    root = Node("#root", None, False, set())
    stack, nodes = [root], [root]
    opened: Counter[str] = Counter()
    found: list[tuple[Node, str]] = []
    parts: list[str] = []
    linked = 0
    links = 0
    owner = root

    def flush() -> None:
        nonlocal linked, links
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        parts.clear()
        if text and not owner.out:
            found.append((owner, text))
            owner.size += len(text)
            owner.link += min(linked, len(text))
            owner.links += links
        linked = links = 0

    def close(upto: int) -> None:
        nonlocal owner
        if any(n.tag not in _INLINE for n in stack[upto:]):
            flush()
        opened.subtract(n.tag for n in stack[upto:])
        del stack[upto:]
        owner = stack[-1].block

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else end]
        if text and not stack[-1].out:
            parts.append(text)
            if stack[-1].anchors:
                linked += len(text.strip())
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if opened[tag] > 0:
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
        else:
            if tag in ("br", "hr", "img", "input"):
                parts.append(" ")
                if tag == "hr":
                    flush()
                continue
            if tag in _VOID:
                continue
            if tag in _RAW:
                # its content is no markup; without an end tag it is the rest
                stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = stop.end() if stop else end
                continue
            if tag not in _INLINE:
                if stack[-1].in_p:
                    close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == "p"))
                if tag in _ENDS and any(opened[x] > 0 for x in _ENDS[tag][0]):
                    ends, boundary = _ENDS[tag]
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k].tag in boundary:
                            break
                        if stack[k].tag in ends:
                            close(k)
                            if tag != "tr":
                                break
                flush()
            if m[3].endswith("/") and tag not in _INLINE and tag in ("svg", "path"):
                continue
            node = _open(tag, m[3], stack[-1])
            stack.append(node)
            nodes.append(node)
            opened[tag] += 1
            if tag == "a":
                links += 1
            if tag not in _INLINE:
                owner = node
    flush()
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.size += node.size
            node.parent.link += node.link
            node.parent.links += node.links
    return nodes, found


def _linky(node: Node) -> bool:
    """A list or box made of links."""
    return node.links >= 2 and node.link > MIN_LINK_DENSITY * node.size and node.tag not in ("p", "h1", "h2", "h3", "h4", "h5", "h6")


def main_text(page: str | None) -> str:
    """The article of a page; empty if there is none."""
    nodes, found = blocks(page or "")
    for node, text in found:
        points = 1 + text.count(",") + text.count("，") + min(len(text) / 100, 3)
        up, share = node if node.tag not in ("p", "pre", "blockquote", "li", "td") else node.parent, 1.0
        while up is not None and share > 0.05:
            up.score += points * share
            up, share = up.parent, share / 2
    candidates: dict[Node, float] = {}
    for node, _ in found:
        up: Node | None = node
        while up is not None and up not in candidates:
            bonus = 25 if up.tag in _ARTICLE_TAGS else 5 if up.names & _ARTICLE_NAMES else 0
            candidates[up] = (up.score + bonus * (up.size > 0)) * (1 - up.link / max(1, up.size))
            up = up.parent
    if not candidates:
        return ""
    best = max(candidates, key=candidates.get)  # the first of equals, which is the innermost
    if candidates[best] <= 0:
        return ""
    # siblings that score enough, or are text themselves
    least = max(10.0, 0.2 * candidates[best])
    kept = {best}
    if best.tag not in _ARTICLE_TAGS:
        for node, value in candidates.items():
            if node.parent is best.parent and node is not best:
                text = node.tag == "p" and node.size > 80 and node.link < 0.25 * node.size
                if value >= least or text or node.tag in ("h1", "h2"):
                    kept.add(node)
    taken: dict[Node, bool | None] = {}  # of an element: whether its text counts; None outside of what is kept
    for node in nodes:
        around = taken.get(node.parent) if node.parent else None
        taken[node] = True if node in kept else None if around is None else around and not _linky(node)
    return " ".join(text for node, text in found if taken[node])


def _extract(batches):
    for batch in batches:
        if batch.num_rows:
            texts = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )


def extract(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text, n_chars (code points).

    Null and empty pages give an empty text.  Character references are decoded,
    white space inside a block is one space, and blocks are joined in page order
    by one space.  A page of any length is taken whole, in time and memory in
    proportion to it.  Ids and urls are only carried, so nulls and repeats of
    them don't matter, and repeated rows are extracted each; other columns,
    whatever their names, are ignored.  An empty table gives an empty result.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    return map_arrow(
        pages.select("page_id", "url", "html"), _extract, f"page_id {kind}, url string, text string, n_chars long"
    )


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op8_html_extraction": op8_html_extraction}
ORACLE_SQL: dict[str, str] = {}
