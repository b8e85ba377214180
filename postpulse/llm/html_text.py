"""Main text of web pages by tree scoring.

The page becomes a tree.  Boilerplate subtrees are set aside by element and by the
words of their class, id and role.  Every paragraph then has points: one, one per
comma and up to three for its length.  They pass to all ancestors, the farther
the less; a container's sum is discounted by the share of its text that lies in
links.  The container with the best score and those of its siblings that read
like text are kept; if it lies in an article or main element, that element is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postpulse.llm.tables import slices

# Elements and attribute words.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset(
    "script style noscript template head title svg math iframe object canvas audio video map textarea select button datalist option".split()
)
BOILERPLATE = frozenset("nav footer aside form dialog menu fieldset".split())
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr legend li main menu nav ol p pre search section summary table caption tbody td tfoot th thead tr ul".split()
)
CLOSES_PARAGRAPH = BLOCKS - frozenset("tbody td tfoot th thead tr caption html body legend".split())
PARAGRAPH_SCOPE = frozenset("html table td th caption object template button".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LIMITS = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond responses".split())
STRONG_WORDS = COMMENT_WORDS | frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promoted cookie cookies "
    "consent gdpr newsletter subscribe subscription signup popup modal overlay disclaimer notice notices notification paywall share sharing social "
    "related recommended recommendations login".split()
)
LAYOUT_WORDS = frozenset(
    "banner sidebar sidebars side menu menus nav navbar navigation navi breadcrumb breadcrumbs header masthead topbar footer foot bottombar alert "
    "widget widgets toolbar pagination pager search form copyright legal skip hidden tags".split()
)
CONTENT_WORDS = frozenset("article articles body content contents main page post entry story text wrapper container layout column has with".split())

_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_COMMAS = re.compile(r"[,،、，]")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "attributes", "children", "parent", "score", "size", "linked", "dropped")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Node | None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[Node | str] = []
        self.score, self.size, self.linked, self.dropped = 0.0, 0, 0, False


class _Tree(HTMLParser):
    """Builds the tree with the usual repairs: implied ends, stray ends ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {}, None)
        self.stack = [self.root]

    def _open(self, tags: tuple[str, ...], limits) -> int | None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                return i
            if self.stack[i].tag in limits:
                return None
        return None

    def handle_starttag(self, tag, attributes):
        if tag in ("html", "body") and any(n.tag == tag for n in self.stack[:3]):
            return
        if tag in CLOSES_PARAGRAPH and (at := self._open(("p",), PARAGRAPH_SCOPE)):
            del self.stack[at:]
        if tag in CLOSED_BY and (at := self._open(CLOSED_BY[tag], LIMITS[tag])):
            del self.stack[at:]
        if tag == "body" and (at := self._open(("head",), ())):
            del self.stack[at:]
        node = Node(tag, {k: v or "" for k, v in attributes}, self.stack[-1])
        self.stack[-1].children.append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag, attributes):
        # the slash is only meaningful on void elements; elsewhere the element stays open
        self.handle_starttag(tag, attributes)

    def handle_endtag(self, tag):
        limits = ("table",) if tag not in ("table", "body", "html") and tag in BLOCKS | {"a", "b", "i", "span", "em", "strong"} else ()
        if at := self._open((tag,), limits if tag not in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption") else ()):
            del self.stack[at:]

    def handle_data(self, data):
        self.stack[-1].children.append(data)


def parse(html: str) -> Node:
    # a comment without end hides the rest of the page, but not one inside a script
    at, low = html.rfind("<!--"), html.lower()
    if at >= 0 and html.find("-->", at) < 0 and low.rfind("<script", 0, at) <= low.rfind("</script", 0, at):
        html = html[:at]
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def _names(node: Node) -> set[str]:
    a = node.attributes
    found = f"{a.get('class', '')} {a.get('id', '')}"
    return {w.lower() for w in _WORDS.findall(found)}


def is_boilerplate(node: Node, inside_article: bool) -> bool:
    tag, a = node.tag, node.attributes
    if tag in UNSEEN or tag in BOILERPLATE or "hidden" in a or a.get("aria-hidden") == "true" or _HIDDEN.search(a.get("style", "")):
        return True
    if tag in ("html", "body", "main"):
        return False
    if a.get("role", "").lower() in ROLES or (tag == "header" and not inside_article):
        return True
    names = _names(node)
    if tag == "article":
        return bool(names & COMMENT_WORDS)
    if names & STRONG_WORDS:
        return True
    if tag in HEADINGS or (tag == "header" and inside_article):
        return False
    return bool(names & LAYOUT_WORDS) and not names & CONTENT_WORDS


def _mark(root: Node) -> list[Node]:
    """All nodes that are not set aside, parents before children."""
    seen, todo = [], [(root, False)]
    while todo:
        node, inside = todo.pop()
        node.dropped = node.tag != "#root" and is_boilerplate(node, inside)
        if node.dropped:
            continue
        seen.append(node)
        inside = inside or node.tag in ("article", "main")
        todo.extend((c, inside) for c in node.children if isinstance(c, Node))
    return seen


def _measure(nodes: list[Node]) -> None:
    for node in reversed(nodes):
        own = sum(len(c.strip()) for c in node.children if isinstance(c, str))
        kids = [c for c in node.children if isinstance(c, Node) and not c.dropped]
        node.size = own + sum(k.size for k in kids)
        node.linked = node.size if node.tag == "a" else sum(k.linked for k in kids)


def _own_text(node: Node) -> str:
    """Text of a block's inline content, without that of blocks inside it."""
    parts, todo = [], list(reversed(node.children))
    while todo:
        child = todo.pop()
        if isinstance(child, str):
            parts.append(child)
        elif not child.dropped and child.tag not in BLOCKS:
            todo.extend(reversed(child.children))
    return _SPACE.sub(" ", "".join(parts)).strip()


def density(node: Node) -> float:
    return node.linked / node.size if node.size else 0.0


def _score(nodes: list[Node]) -> Node | None:
    best = None
    for node in nodes:
        if node.tag in BLOCKS and node.tag not in HEADINGS and (text := _own_text(node)):
            points = (1 + len(_COMMAS.findall(text)) + min(len(text) / 100, 3)) * min(1.0, len(text) / 25) * (1 - density(node))
            # a paragraph supports its container; bare text supports the block it stands in
            up = node.parent if node.tag in ("p", "pre", "li", "td", "dd", "dt", "blockquote", "figcaption") else node
            step = 1
            while up is not None and up.tag != "#root":
                up.score += points / step
                up, step = up.parent, 2 if step == 1 else step + 2
    for node in nodes:
        if node.tag in BLOCKS and node.tag != "html" and node.score > 0:
            names = _names(node)
            node.score *= (1 - density(node)) * (1.25 if names & CONTENT_WORDS or node.tag in ("article", "main") else 1.0)
            if best is None or node.score > best.score:
                best = node
    return best


def _kept(best: Node) -> list[Node]:
    """The best container with siblings that read like text, or the article that it lies in."""
    chain, node = [], best
    while node is not None:
        chain.append(node)
        node = node.parent
    for tag in ("article", "main"):
        if outer := [n for n in chain if n.tag == tag]:
            return [outer[-1]]
    if best.parent is None or best.tag == "body":
        return [best]
    kept = []
    for sibling in best.parent.children:
        if isinstance(sibling, str) or sibling.dropped:
            continue
        text_like = sibling.size and density(sibling) < 0.3 and (sibling.tag in HEADINGS or sibling.tag in ("p", "pre", "blockquote") or sibling.score >= 0.2 * best.score)
        if sibling is best or text_like:
            kept.append(sibling)
    return kept


def _is_link_list(node: Node) -> bool:
    return node.tag in ("ul", "ol", "table") and density(node) > 0.9 and sum(isinstance(c, Node) for c in node.children) >= 3


def _blocks(nodes: list[Node]) -> list[str]:
    """Texts of all blocks in page order; white space inside a block becomes one blank."""
    blocks, parts = [], []

    def end():
        text = _SPACE.sub(" ", "".join(parts)).strip()
        if text:
            blocks.append(text)
        parts.clear()

    todo: list[Node | str | None] = list(reversed(nodes))
    while todo:
        item = todo.pop()
        if item is None:
            end()
        elif isinstance(item, str):
            parts.append(item)
        elif item.dropped or _is_link_list(item):
            end()
        elif item.tag == "br":
            parts.append(" ")
        else:
            block = item.tag in BLOCKS
            if block:
                end()
                todo.append(None)
            todo.extend(reversed(item.children))
    end()
    return blocks


def main_text(html: str | None) -> str:
    """The text of the article in a page; empty for null, empty and text-free pages."""
    if not html:
        return ""
    root = parse(html)
    nodes = _mark(root)
    _measure(nodes)
    best = _score(nodes)
    if best is None:
        # no paragraph at all: headings alone are the text
        article = next((n for n in nodes if n.tag in ("article", "main", "body")), root)
        return "\n".join(_blocks([article]))
    return "\n".join(_blocks(_kept(best)))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 200):
        texts = [main_text(h) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["row", "text", "n_chars"]
        )


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html).

    Every page is read whole in the task that scans it.  Null ids and urls are
    passed on, repeated rows stay repeated, other columns are ignored.
    """
    rows = pages.select(F.struct(F.col("`page_id`").alias("page_id"), F.col("`url`").alias("url")).alias("row"), F.col("`html`").cast("string").alias("html"))
    row = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(_extract, f"row {row}, text string, n_chars long").select("row.*", "text", "n_chars")
