"""Main text of web pages by composite text density (Sun, Song and Liao, 2011).

A page becomes a tree of elements. Each has a density: its characters for each tag in it, adjusted by
how many of both are in links. Of all elements the one whose children's densities sum to most holds the
main text; the least density on the way from the body to it is the threshold that a part below it must reach.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshlark.llm.spread import fresh

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)
_SPACE = re.compile(r"[ \t\n\r\f\v]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that never hold the article's text.
AWAY = frozenset("script style noscript template head title nav header footer aside form button select textarea input iframe object embed svg math canvas audio video map menu dialog noembed noframes xmp datalist dir fieldset".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul br".split())
#: An opening tag ends these open elements, up to the nearest of the second set.
_ENDS = {
    "li": ({"li", "p"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th", "p"}, {"table"}), "td": ({"td", "th", "p"}, {"tr", "table"}), "th": ({"td", "th", "p"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
_P_ENDERS = BLOCK - {"br", "body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: Landmark roles of elements that are not the article.
_ROLES = frozenset("banner complementary contentinfo dialog alertdialog form menu menubar navigation search toolbar".split())


class Node:
    """An element. ``parts``: its texts and child elements in order."""

    __slots__ = ("away", "chars", "density", "links", "linked", "parts", "tag", "tags", "total", "up")

    def __init__(self, tag: str, up: Node | None, away: bool):
        self.tag, self.up, self.away = tag, up, away
        self.parts: list[str | Node] = []
        self.chars = self.tags = self.linked = self.links = 0
        self.density = self.total = 0.0


def parse(page: str) -> Node:
    """The page's tree below a root; never fails, whatever is unclosed, crossed or cut off."""
    root = here = Node("html", None, False)
    at, low = 0, None
    n = len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            here.parts.append(page[at:])
            break
        if m.start() > at:
            here.parts.append(page[at : m.start()])
        at = m.end()
        if m.group(2) is None:
            continue
        tag = m.group(2).lower()
        if m.group(1):
            if tag == "br":
                here.parts.append(Node("br", here, False))
                continue
            if tag in ("html", "body"):
                continue
            x = here
            while x is not None and x.tag != tag:
                if tag in _INLINE and x.tag in BLOCK:  # a stray end of an inline element closes no block
                    x = None
                    break
                x = x.up
            if x is not None and x.up is not None:
                here = x.up
            continue
        if tag == "html" or tag == "body":
            if tag == "body" and here.tag in ("head", "html"):
                x = here.up if here.tag == "head" and here.up is not None else here
                here = Node("body", x, False)
                x.parts.append(here)
            continue
        if tag in _P_ENDERS:
            x = here
            while x is not None and (x.tag == "p" or x.tag in _INLINE):
                if x.tag == "p":
                    here = x.up
                    break
                x = x.up
        if tag in _ENDS:
            ends, until = _ENDS[tag]
            x = here
            while x is not None and x.tag not in until:
                if x.tag in ends and x.up is not None:
                    here = x.up
                x = x.up
        away = tag in AWAY
        if not away and m.group(3):
            for a in _ATTRIBUTE.finditer(m.group(3)):
                name = a.group(1).lower()
                value = a.group(2) or a.group(3) or a.group(4) or ""
                if name == "hidden" or name == "role" and value.strip().lower() in _ROLES or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                    away = True
        node = Node(tag, here, away)
        here.parts.append(node)
        if tag in VOID or m.group(3).endswith("/") and tag not in RAW and tag not in BLOCK:
            continue
        if tag in RAW:
            low = page.lower() if low is None else low
            end = low.find(f"</{tag}", at)
            at = n if end < 0 else end
            close = page.find(">", at)
            at = n if close < 0 else close + 1
            continue
        here = node
    return root


def _measure(root: Node) -> list[Node]:
    """Counts characters, tags and those in links from the leaves up; the elements in page order."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack += [p for p in reversed(x.parts) if isinstance(p, Node) and not p.away]
    for x in reversed(order):
        for p in x.parts:
            if isinstance(p, str):
                x.chars += len(_SPACE.sub("", p))
            elif not p.away:
                x.chars += p.chars
                x.tags += 1 + p.tags
                x.linked += p.chars if p.tag == "a" else p.linked
                x.links += 1 + p.links if p.tag == "a" else p.links
    body = next((x for x in order if x.tag == "body"), root)
    share = body.linked / body.chars if body.chars else 0.0
    for x in order:
        if x.chars:
            tags, plain = max(1, x.tags), max(1, x.chars - x.linked)
            base = math.log(x.chars / plain * x.linked + share * x.chars + math.e)
            x.density = x.chars / tags * math.log(max(x.chars / max(1, x.linked) * tags / max(1, x.links), 1.0), base) if base > 1 + 1e-9 else x.chars / tags * math.log(max(x.chars * tags, 1.0))
    for x in order:
        x.total = sum(p.density for p in x.parts if isinstance(p, Node) and not p.away)
    return order


def blocks(page: str | None) -> list[str]:
    """The blocks of the main text in page order; white space inside each is one space, none is empty.

    Of elements whose sums tie, the first on the page is taken. Names of classes and ids decide nothing.
    """
    if not page:
        return []
    root = parse(page)
    order = _measure(root)
    body = next((x for x in order if x.tag == "body"), root)
    inner = order[order.index(body) :]
    top = max(inner, key=lambda x: x.total, default=body)
    way = top
    while way is not None and way.tag not in ("article", "main"):
        way = way.up
    if way is not None:
        top = way
    bound, x = math.inf, top
    while x is not None:
        if x.chars:
            bound = min(bound, x.density)
        x = None if x is body else x.up
    if not top.total:
        bound = 0.0
    found: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(line))).replace("\x00", "").strip(" ")
        line.clear()
        if text := _SPACE.sub(" ", text).strip():
            found.append(text)

    stack: list[str | Node | None] = [top]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            line.append(x)
        elif x.away:
            continue
        else:
            # a part that is mostly links and thinner than the threshold is a list of links, not text
            if x is not top and x.tag in BLOCK and x.density < bound and x.linked * 2 > x.chars:
                flush()
                continue
            if x.tag in BLOCK:
                flush()
                stack.append(None)
            stack += reversed(x.parts)
    flush()
    return found


def main_text(page: str | None) -> str:
    """The blocks of a page joined by one space; empty if there are none."""
    return " ".join(blocks(page))


def extract(pages: DataFrame, page: str = "html") -> tuple[DataFrame, str]:
    """``pages`` with a struct of text and blocks, and that column's name. Null and empty pages have neither; every page is read whole."""
    name = fresh(pages.columns, "main")

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            got = [blocks(x) for x in part]
            yield pd.DataFrame({"text": [" ".join(b) for b in got], "blocks": got})

    kind = T.StructType([T.StructField("text", T.StringType()), T.StructField("blocks", T.ArrayType(T.StringType()))])
    return pages.withColumn(name, F.pandas_udf(run, kind)(F.col(page))), name
