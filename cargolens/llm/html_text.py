"""Main text of HTML pages by tag-path ratios.

Every text node has the path of tags from the root. Over all nodes of a path, the text length per node and
the punctuation per node are taken; both series are smoothed in page order and multiplied, and nodes above the
threshold (the series' standard deviation) are content. The article is the smallest container around the
content. Of it, blocks that are mostly links go unless their paths are content, and so do subtrees that are marked as
something else. A mark is only a hint: the ratios are first taken over all text nodes, and a marked subtree that holds most of the
content stays. In an ``article`` or ``main`` element links stay, as the page itself says what belongs to it.

Time and memory grow with the page alone, however deep its elements are nested or left open.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cargolens.llm.common import lean_batches, need

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</(?![a-zA-Z])[^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*+)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_SPACE = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、！？¿¡]")
_WORDS = re.compile(r"[^a-z0-9]+")

# Elements of the HTML standard by how they are read.
RAW = frozenset("script style title textarea noscript template iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table "
                   "tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("html body div section article main center table tbody tr td blockquote span font".split())
#: Elements that are no part of an article; those that can wrap a page stay where they hold most of the content.
OUTSIDE = frozenset("head nav aside footer form button select option optgroup svg math object canvas audio video dialog menu search datalist".split())
WRAPPERS = frozenset("form dialog search object canvas".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar form".split())
MARKS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
                  "sidebar aside widget footer header masthead cookie cookies consent notice alert popup modal overlay comment comments reply replies respond "
                  "disqus share sharing social related recommended newsletter subscribe subscription signup login search pagination pager toolbar".split())
#: Words that make a class one of a layout ("with-sidebar"), or a header the article's own ("entry-header").
LAYOUT = frozenset("with without no has have hide show is not".split())
OWN_HEADER = frozenset("entry post article story content hentry".split())
#: Part of the content that a marked subtree has to hold to stay; part of a block's text in links above which it is a menu's.
MOST, LINKS = 0.5, 0.5
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class _Node:
    __slots__ = ("name", "up", "path", "marked", "out", "order", "core", "title", "article", "link", "kept")

    def __init__(self, name: str, up: _Node | None, path: int, marked: bool, order: int):
        self.name, self.up, self.path, self.marked, self.order = name, up, path, marked, order
        self.out, self.core, self.title, self.article = False, 0.0, False, False
        self.link, self.kept = name == "a" or up is not None and up.link, False

    def stays(self, core: float) -> bool:
        """Whether a marked element stays that holds more of the content than ``core``; a footer or the like only around an article."""
        return self.core > core and (self.article or self.name not in OUTSIDE or self.name in WRAPPERS)


def _names_other(value: str) -> bool:
    """Whether one of the names in a class or id says that the element is no part of an article."""
    for token in value.split():
        words = set(_WORDS.split(token))
        marks = words & MARKS
        if words & OWN_HEADER:
            marks = marks - {"header"}
        if marks and not words & LAYOUT:
            return True
    return False


def _is_marked(name: str, rest: str, in_article: bool) -> bool:
    if name in OUTSIDE or (name == "header" and not in_article):
        return True
    if not rest or name in ("html", "body", "article", "main"):
        return False
    for m in _ATTRIBUTE.finditer(rest):
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if key in ("class", "id") and _names_other(value):
            return True
        if key == "role" and value in ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


#: Elements that an open element looks for when it may end others, and those at which it stops looking.
_BORDERS = frozenset("table ul ol dl div article section body".split())
_LOOKED_AT = _BORDERS | {"p"} | frozenset(x for v in CLOSES.values() for x in v)


class _Stack:
    """Open elements; ``open`` counts them by name, ``seen`` holds the places of those that others look for."""

    def __init__(self, root: _Node):
        self.nodes, self.open, self.seen = [root], {}, []

    def push(self, node: _Node) -> None:
        if node.name in _LOOKED_AT:
            self.seen.append(len(self.nodes))
        self.nodes.append(node)
        self.open[node.name] = self.open.get(node.name, 0) + 1

    def cut(self, place: int) -> None:
        for node in self.nodes[place:]:
            self.open[node.name] -= 1
        del self.nodes[place:]
        while self.seen and self.seen[-1] >= place:
            self.seen.pop()

    def end(self, name: str) -> None:
        """The innermost open element of that name ends, with all inside it."""
        if self.open.get(name, 0):
            place = len(self.nodes) - 1
            while self.nodes[place].name != name:
                place -= 1
            self.cut(place)

    def end_before(self, ends: set[str]) -> None:
        """An element begins that can't be inside the nearest of ``ends``."""
        for place in reversed(self.seen):
            if self.nodes[place].name in ends:
                self.cut(place)
                return
            if self.nodes[place].name in _BORDERS:
                return


def _read(page: str) -> tuple[list[_Node], list[tuple[_Node, int, str]]]:
    """Elements, and text nodes as (parent, block number, text). Open elements end where the next one can't be inside."""
    root = _Node("", None, 0, False, 0)
    stack, nodes, texts, block = _Stack(root), [root], [], 0
    paths: dict[tuple[int, str], int] = {}
    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        text = m["text"]
        if text is not None:
            texts.append((stack.nodes[-1], block, text))
            continue
        name = m["name"] or m["name2"]
        if name is None:
            continue
        name = name.lower()
        closing = m["end"] or m["end2"]
        if name in BLOCKS:
            block += 1
        if closing:
            stack.end(name)
            continue
        if m["name"] is None and at == end:
            break  # a tag that the page's end cuts off
        rest = m["rest"] or m["rest2"] or ""
        if name in BLOCKS and name != "br":
            stack.end_before({"p"} | CLOSES.get(name, set()))
        if name in RAW:
            found = re.compile(f"</{name}\\b[^>]*>?", re.I).search(page, at)
            at = found.end() if found else end
            continue
        if name in VOID:
            continue
        up = stack.nodes[-1]
        inside = bool(stack.open.get("article") or stack.open.get("main")) if name == "header" else False
        node = _Node(name, up, paths.setdefault((up.path, name), len(paths) + 1), _is_marked(name, rest, inside), len(nodes))
        nodes.append(node)
        if name in ("article", "main"):
            x = up
            while x is not None and not x.article:
                x.article = True
                x = x.up
        if not rest.endswith("/") or name in BLOCKS:
            stack.push(node)
    return nodes, texts


def _ratios(texts: list[tuple[_Node, int, str]]) -> tuple[np.ndarray, set[int]]:
    """Smoothed product of the path ratios of every text node, 0 below the threshold; the paths that are above it in the mean."""
    paths: dict[int, list[float]] = {}
    for node, _, text in texts:
        own = paths.setdefault(node.path, [0, 0, 0, 0])
        own[0] += 1
        own[1] += len(text.strip())
        own[2] += len(_PUNCTUATION.findall(text))
    length = np.array([paths[n.path][1] / paths[n.path][0] for n, _, _ in texts])
    points = np.array([paths[n.path][2] / paths[n.path][0] for n, _, _ in texts])
    kernel = np.exp(-0.5 * np.arange(-2, 3) ** 2)
    kernel /= kernel.sum()
    smooth = lambda x: np.convolve(np.pad(x, 2, "edge"), kernel, "valid")
    fused = smooth(length) * (smooth(points) + 0.1)
    for (node, _, _), value in zip(texts, fused):
        paths[node.path][3] += value
    least = fused.std()
    return np.where(fused >= least, fused, 0), {k for k, own in paths.items() if own[3] / own[0] >= least}


def _weigh(nodes: list[_Node], said: list[tuple[_Node, int, str]]) -> set[int]:
    """Length of the content in every element; returns the paths of the content."""
    for node in nodes:
        node.core = 0.0
    values, paths = _ratios(said) if said else ((), set())
    for (node, _, text), value in zip(said, values):
        if value > 0:
            node.core += len(text)
    for node in reversed(nodes[1:]):  # children come after their parents
        node.up.core += node.core
    return paths


def extract(page: str) -> str:
    nodes, texts = _read(page)
    said = [x for x in texts if x[2].strip()]
    if not said:
        return ""
    paths = _weigh(nodes, said)
    if any(node.marked for node in nodes):
        whole = nodes[0].core
        for node in nodes[1:]:  # parents first
            node.out = node.up.out or node.marked and not node.stays(MOST * whole)
        if all(x[0].out for x in said):  # several marked parts share the content: they are all there is
            for node in nodes[1:]:
                node.out = node.up.out or node.marked and not node.stays(0)
        texts = [x for x in texts if not x[0].out]
        said = [x for x in said if not x[0].out]
        paths = _weigh(nodes, said)
    for node in nodes:
        if node.name == "h1" and not node.out:
            while node is not None and not node.title:
                node.title = True
                node = node.up
    # From the root towards the content, as long as one container holds nearly all of it.
    children: dict[int, list[_Node]] = {}
    for node in nodes[1:]:
        children.setdefault(node.up.order, []).append(node)
    here, whole = nodes[0], nodes[0].core
    while here.core:
        best = max(children.get(here.order, []), key=lambda x: x.core, default=None)
        if best is None or best.core < 0.9 * whole or best.name not in CONTAINERS or here.name in ("article", "main"):
            break
        if here.title and not best.title:
            break  # the headline stands beside it
        here = best
    here.kept = True
    for node in nodes[here.order + 1:]:
        node.kept = node.up.kept
    blocks: dict[int, list[str]] = {}
    facts: dict[int, list] = {}
    for node, block, text in texts:
        if node.kept:
            blocks.setdefault(block, []).append(html.unescape(text) if "&" in text else text)
            own = facts.setdefault(block, [0, 0, False])
            size = len(text.strip())
            own[0] += size
            own[1] += size if node.link else 0
            own[2] = own[2] or size > 0 and node.path in paths
    if here.name not in ("article", "main"):
        blocks = {k: v for k, v in blocks.items() if facts[k][2] or facts[k][1] <= LINKS * facts[k][0]}
    joined = (_SPACE.sub(" ", "".join(parts)).strip() for _, parts in sorted(blocks.items()))
    return " ".join(x for x in joined if x)


def text_column(column: Column) -> Column:
    @F.arrow_udf(T.StringType())
    def apply(pages: pa.Array) -> pa.Array:
        return pa.array([extract(p) if p else "" for p in pages.to_pylist()], pa.string())

    return apply(column)


def main_text(pages: DataFrame, html_column: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with the main text of each page in ``into`` (an input column of that name is replaced).

    Null, empty and textless pages give an empty text. Pages are handled one by one and whole, so repeated
    rows agree and an empty table stays empty.
    """
    need(pages, html_column)
    lean_batches(pages.sparkSession)
    return pages.withColumn(into, text_column(F.col(html_column).cast("string")))
