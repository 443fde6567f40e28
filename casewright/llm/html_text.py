"""HTML extraction by minimum cut: which blocks of a page are its main text.

A page becomes blocks of text. A linear classifier gives each block a cost of being boilerplate and
a cost of being content, from its ancestors, their class names, its links and its words; these are
the capacities of its edges to source and sink. Neighbouring blocks, and blocks below one element,
are joined by smoothness edges. The maximum flow separates content from boilerplate.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML elements by their part in a page.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var wbr img picture source svg path br".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("head title script style template noscript iframe object svg math canvas audio video textarea select option".split())
BOILERPLATE = {"nav": 6.0, "footer": 6.0, "aside": 6.0, "form": 6.0, "menu": 6.0, "dialog": 6.0, "header": 5.0, "button": 5.0}
CONTENT = {"article": 5.0, "main": 4.0}
BOILERPLATE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices alert "
    "popup modal newsletter subscribe subscription signup login sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer "
    "header masthead comment comments reply replies respond disqus social share sharing related recommended widget toolbar pagination "
    "pager search copyright disclaimer".split()
)
CONTENT_NAMES = frozenset("article content post entry story main body text".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|iframe)\b[^>]*+>.*?(?:</\1\b[^>]*+>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>|<[!?/a-zA-Z][^>]*+\Z",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b\s*+(?:=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?", re.I)
_PART = re.compile(r"[a-z]+")


class Block(NamedTuple):
    text: str
    linked: int  # characters inside links
    parent: int  # number of the element around the block's own
    content: float
    boilerplate: float
    heading: bool


class Open(NamedTuple):
    tag: str
    number: int
    content: float
    boilerplate: float
    silent: bool


def _evidence(tag: str, attributes: str, inside: Open) -> tuple[float, float]:
    """Weights of an element for content and for boilerplate."""
    content, boilerplate = CONTENT.get(tag, 0.0), BOILERPLATE.get(tag, 0.0)
    if tag == "header" and inside.content >= CONTENT["article"]:
        boilerplate = 0.0
    if attributes and tag not in ("html", "body"):
        names: set[str] = set()
        for name, value in _NAMED.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
                boilerplate = 6.0
            elif name in ("class", "id", "role"):
                names.update(_PART.findall(value))
        good, bad = not names.isdisjoint(CONTENT_NAMES), not names.isdisjoint(BOILERPLATE_NAMES)
        if bad and not good:
            boilerplate = 6.0
        elif good and not bad:
            content = max(content, 2.0)
    return content, boilerplate


def blocks_of(html: str) -> list[Block]:
    """Blocks of text in page order, character references decoded and white space made single."""
    root = Open("", 0, 0.0, 0.0, False)
    stack, opened, blocks = [root], {}, []
    pieces: list[str] = []
    links: list[str] = []
    numbers, at = 0, 0

    def close() -> None:
        nonlocal pieces, links
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            if text:
                holder = len(stack) - 1
                while holder > 0 and stack[holder].tag in INLINE:
                    holder -= 1
                own = stack[holder]
                linked = len(" ".join(unescape(" ".join(links)).split())) if links else 0
                blocks.append(Block(text, linked, stack[max(holder - 1, 0)].number, own.content, own.boilerplate, own.tag[:1] == "h"))
        pieces, links = [], []

    def pop(tag: str) -> None:
        while True:
            gone = stack.pop()
            opened[gone.tag] -= 1
            if gone.tag == tag:
                return

    for token in _TOKEN.finditer(html):
        if token.start() > at and not stack[-1].silent:
            text = html[at: token.start()]
            pieces.append(text)
            if opened.get("a"):
                links.append(text)
        at = token.end()
        tag = token[3] or token[6]
        if tag is None:
            continue
        tag, end, attributes = tag.lower(), token[2] or token[5], token[4] or token[7] or ""
        inline = tag in INLINE
        if tag == "br" or tag in ("td", "th"):
            pieces.append(" ")
        if not inline and tag not in ("td", "th"):
            close()
        if end:
            if opened.get(tag):
                pop(tag)
            continue
        if not inline and opened.get("p"):
            # A block ends an open paragraph that only inline elements separate it from.
            for held in reversed(stack):
                if held.tag == "p":
                    pop("p")
                    break
                if held.tag not in INLINE:
                    break
        if tag == "li" and opened.get("li"):
            for held in reversed(stack):
                if held.tag == "li":
                    pop("li")
                    break
                if held.tag in ("ul", "ol", "menu"):
                    break
        if tag == "body" and opened.get("head"):
            pop("head")
        if tag in VOID or attributes.endswith("/") and inline:
            continue
        inside = stack[-1]
        content, boilerplate = _evidence(tag, attributes, inside)
        numbers += 1
        # Boilerplate inside the article is not made better by it.
        content = 0.0 if boilerplate else max(content, inside.content)
        stack.append(Open(tag, numbers, content, max(boilerplate, inside.boilerplate), inside.silent or tag in SILENT))
        opened[tag] = opened.get(tag, 0) + 1
    if at < len(html) and not stack[-1].silent:
        pieces.append(html[at:])
        if opened.get("a"):
            links.append(html[at:])
    close()
    return blocks


def costs(block: Block) -> tuple[float, float]:
    """Costs of calling the block boilerplate, and of calling it content."""
    words = block.text.count(" ") + 1
    density = min(1.0, block.linked / len(block.text))
    sentence = block.text[-1] in ".!?:;\"”»…"
    content = block.content + 0.1 * min(words, 40) * (1 - density) + 0.5 * sentence + 0.5 * block.heading
    return content, block.boilerplate + 0.5 + 4.0 * density


def content_side(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source in a minimum cut (those that flow can still reach)."""
    n = len(source)
    excess = [a - b for a, b in zip(source, sink)]  # what is left when each node's own path is full
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    supply = [max(x, 0.0) for x in excess]
    demand = [max(-x, 0.0) for x in excess]
    while True:
        came = {i: -1 for i in range(n) if supply[i] > 1e-12}
        queue, goal = deque(came), -1
        while queue and goal < 0:
            i = queue.popleft()
            for j, room in near[i].items():
                if room > 1e-12 and j not in came:
                    came[j] = i
                    if demand[j] > 1e-12:
                        goal = j
                        break
                    queue.append(j)
        if goal < 0:
            return [i in came for i in range(n)]
        path = [goal]
        while came[path[-1]] >= 0:
            path.append(came[path[-1]])
        flow = min(demand[goal], supply[path[-1]], *(near[b][a] for a, b in zip(path, path[1:])))
        demand[goal] -= flow
        supply[path[-1]] -= flow
        for a, b in zip(path, path[1:]):
            near[b][a] -= flow
            near[a][b] = near[a].get(b, 0.0) + flow


def main_text(html: str | None) -> str:
    """Main text of a page, its blocks joined by line feeds; empty if there is none."""
    blocks = blocks_of(html) if html else []
    if not blocks:
        return ""
    pairs = [costs(b) for b in blocks]
    source, sink = [p[0] for p in pairs], [p[1] for p in pairs]
    edges = [(i, i + 1, 0.6 if a.parent == b.parent else 0.2) for i, (a, b) in enumerate(zip(blocks, blocks[1:]))]
    # An element is a node of its own that ties the blocks below it together.
    holders: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if b.parent not in holders:
            holders[b.parent] = len(source)
            source.append(0.0)
            sink.append(0.0)
        edges.append((i, holders[b.parent], 0.4))
    side = content_side(source, sink, edges)
    return "\n".join(b.text for b, keep in zip(blocks, side) if keep)


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: key, url, text, n_chars (code points of the text).

    The whole page is read. A null or empty page, or one without content blocks, has an empty text.
    Markup that is broken or cut off is read as far as it goes. Rows with equal keys keep a row
    each; null keys and urls stay null. Other columns are not read.
    """
    schema = pa.schema([("key", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                # Broken surrogates that character references make cannot be stored.
                texts = [main_text(x.as_py()).encode("utf-8", "replace").decode() for x in part.column("html")]
                yield pa.record_batch([part.column("key"), part.column("url"), pa.array(texts, pa.string())], schema=schema)

    chosen = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    found = chosen.mapInArrow(run, "key long, url string, text string")
    return found.select(F.col("key").alias(key), F.col("url").alias(url), "text", F.char_length("text").cast("long").alias("n_chars"))
