"""Main-text extraction from HTML by minimum-cut labelling.

A page is cut into text blocks. A linear classifier gives each block log odds for content: its length, its share of
linked text, whether it ends as a sentence, its tag, and what its ancestors' tags and names say. They are the
capacities of its arcs to the two terminals. Blocks that follow each other, and blocks of the same parent, are joined
by arcs of up to SMOOTH whose capacity falls with their distance in the DOM, so that a heading or a short line goes
with the text around it and a sentence among links with the links. The minimum cut (by maximum flow) is the labelling
of least total cost.
"""

from __future__ import annotations

import html
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impactlake.llm.common import bounded_batches

_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|$))|<(/?)([a-zA-Z][^\s>/]*)((?>=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)>|<[!?][^>]*>|<[a-zA-Z/!?][^>]*$", re.S)
_NAME = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not page text.
DROPPED = set("script style noscript template svg iframe object canvas textarea select button head title audio video map".split())
#: What a head may hold; any other tag or text ends it.
IN_HEAD = set("base basefont bgsound link meta title noscript noframes style script template head".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption hr".split())
BOILER_TAGS = set("nav footer aside menu dialog".split())
CONTENT_TAGS = {"article", "main"}
#: Words in class, id or role that speak for a label.
BOILER_WORDS = set(
    "ad ads advert advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead comment comments disqus reply replies respond response responses cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended recommendations widget pagination pager toolbar copyright legal disclaimer skip contentinfo complementary dialog outbrain taboola".split()
)
CONTENT_WORDS = set("article content main post story entry body".split())
#: The classifier's weights: inside a boilerplate tag, inside a content tag or name, outside of it where the page has one.
BOILER, CONTENT, OUTSIDE = -6.0, 3.0, -3.0
#: An ancestor whose name is made of boilerplate words ("cookie-notice"), or has one among others ("has-sidebar").
NAMED, HINTED = 8.0, 4.0
#: Fifteen words, all of the text linked, the end of a sentence, a start that every block has to make up for.
WORDS, LINKED, SENTENCE, START = 1.0, -4.0, 0.6, -0.9
TAGS = {"p": 0.4, "blockquote": 0.4, "pre": 0.4, **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), 0.6), **dict.fromkeys(("li", "td", "th", "dd", "dt"), -0.3)}
#: The most that two neighbouring blocks with different labels cost, and the same for blocks of one parent that are not neighbours.
SMOOTH, SIBLING = 3.0, 0.5


class _Element:
    __slots__ = ("tag", "parent", "depth", "boiler", "content", "dropped", "link", "name", "above", "held", "held_content")

    def __init__(self, tag: str, parent: _Element | None, attributes: str):
        self.tag, self.parent = tag, parent
        up = parent or self
        self.depth = parent.depth + 1 if parent else 0
        self.boiler, self.content, self.dropped, self.link = (bool(parent) and getattr(up, k) for k in ("boiler", "content", "dropped", "link"))
        self.dropped |= tag in DROPPED
        self.link |= tag == "a"
        self.boiler |= tag in BOILER_TAGS
        words, named, hinted, hidden = _names(attributes) if "=" in attributes or "hidden" in attributes else (set(), False, False, False)
        outer = tag in ("html", "body", "article", "main")
        if hidden and not outer:
            self.boiler = True
        if tag == "header":  # of the page; an article's own holds its title
            self.boiler |= not self.content
        elif "header" in words and not self.content:
            named, hinted = named or len(words) == 1, True
        self.name = 0.0 if outer else NAMED if named or tag == "form" else HINTED if hinted else 0.0
        self.held = self.held_content = 0  # characters of text inside
        above = parent.above if parent else ()  # elements with a name's cost, from here to the top
        if tag == "main":
            above = ()
        elif tag == "article":  # hints of wrappers end here, and those of comments and the like do not
            above = tuple(e for e in above if e.name == NAMED)
        self.above = (self, *above) if self.name else above
        self.content |= tag in CONTENT_TAGS or (tag in ("div", "section", "td") and not CONTENT_WORDS.isdisjoint(words))


def _names(attributes: str) -> tuple[set[str], bool, bool, bool]:
    """The words of class, id and role; whether all words of one of their tokens, or some, speak for boilerplate; whether the element is hidden."""
    words: set[str] = set()
    named = hinted = hidden = False
    for name, value in _NAME.findall(attributes):
        name = name.lower()
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value) or name == "aria-hidden" and "true" in value:
            hidden = True
        elif name in ("class", "id", "role"):
            for token in value.strip("\"'").split():
                parts = {p.lower() for p in _PART.findall(token)}
                words |= parts
                named |= bool(parts) and parts <= BOILER_WORDS
                hinted |= not parts.isdisjoint(BOILER_WORDS)
    return words, named, hinted, hidden


class Block:
    __slots__ = ("text", "parent", "linked")

    def __init__(self, text: str, parent: _Element, linked: int):
        self.text, self.parent, self.linked = text, parent, linked


def blocks(page: str) -> list[Block]:
    """Text blocks in page order: white space collapsed, character references decoded."""
    out: list[Block] = []
    top = _Element("#page", None, "")
    parts: list[str] = []
    linked = 0
    owner = top  # innermost block element

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, owner, linked))
        parts.clear()
        linked = 0

    def block_of(e: _Element) -> _Element:
        while e.parent and e.tag not in BLOCK:
            e = e.parent
        return e

    here, at, size = top, 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else size]
        if here.tag == "head" and text.strip():
            here = here.parent
            owner = block_of(here)
        if text and not here.dropped:
            text = html.unescape(text)
            parts.append(text)
            if here.link:
                linked += len(text.strip())
        if not m:
            break
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:  # an end tag closes up to its start, if that is open
            e = here
            while e.parent and e.tag != tag:
                e = e.parent
            if e.parent:
                if tag in BLOCK or block_of(here) is not block_of(e.parent):
                    close()
                here = e.parent
                owner = block_of(here)
            continue
        if here.tag == "head" and tag not in IN_HEAD:
            here = here.parent
            owner = block_of(here)
        if here.dropped and tag in BLOCK:  # a block ends an image that was left open
            e = here
            while e.parent and e.tag not in ("svg", "foreignobject"):
                e = e.parent
            if e.tag == "svg":
                here = e.parent
                owner = block_of(here)
        if tag == "br" or tag == "hr":
            parts.append(" ")
        if tag in VOID:
            continue
        if tag in BLOCK:
            close()
            e = here  # a block ends an open paragraph; an item ends the item before
            ends = {"p"} | ({"li"} if tag == "li" else {"dt", "dd"} if tag in ("dt", "dd") else {"td", "th"} if tag in ("td", "th") else {"tr", "td", "th"} if tag == "tr" else set())
            stop = {"ul", "ol", "dl", "table", "div", "article", "section", "main", "body", "nav", "aside", "footer", "header", "form", "blockquote"} - {tag}
            while e.parent and e.tag not in stop:
                if e.tag in ends:
                    here = e.parent
                e = e.parent
        if tag in ("script", "style", "noscript", "template", "textarea", "iframe", "title"):  # raw up to the end tag
            end = re.compile(f"</{tag}\\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if m[3].endswith("/") and tag not in BLOCK:
            continue
        if tag == "head" and here.tag == "head":
            here = here.parent
        here = _Element(tag, here, m[3])
        owner = block_of(here)
    close()
    return out


def weigh(found: list[Block]) -> None:
    """Count the text that named elements hold."""
    for b in found:
        for e in b.parent.above:
            e.held += len(b.text)
            if b.parent.content and not b.parent.boiler:
                e.held_content += len(b.text)


def name_cost(e: _Element, size: int, content: int) -> float:
    """The greatest cost of the names above; a wrapper of half of the page's text or more costs nothing, if no content is outside it."""
    return max((x.name for x in e.above if 2 * x.held < size or x.held_content < content and x.name == NAMED), default=0.0)


def score(block: Block, has_main: bool, cost: float = 0.0) -> float:
    """The classifier's log odds for content."""
    e = block.parent
    words = block.text.count(" ") + 1
    own = START + WORDS * min(1.5, words / 15) + LINKED * min(1.0, block.linked / len(block.text)) + TAGS.get(e.tag, 0.0) - cost
    if block.text[-1] in ".!?:;\"'”»…":
        own += SENTENCE
    return own + (BOILER if e.boiler else CONTENT if e.content else OUTSIDE if has_main else 0.0)


def distance(a: _Element, b: _Element) -> int:
    """Steps between two elements in the DOM."""
    n = 0
    while a is not b:
        if a.depth < b.depth:
            a, b = b, a
        a = a.parent
        n += 1
    return n


def min_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The labelling that minimizes the sum of gain over False nodes with gain > 0, of -gain over True ones with gain < 0, and of the weights of cut edges: the source side of a minimum cut (Dinic's algorithm)."""
    n = len(gain)
    s, t = n, n + 1
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def arc(a: int, b: int, c: float, back: float) -> None:
        graph[a].append(len(to))
        to.append(b)
        room.append(c)
        graph[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, g in enumerate(gain):
        arc(*((s, i) if g > 0 else (i, t)), abs(g), 0.0)
    for a, b, w in edges:
        arc(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in graph[a]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        here = s
        while True:
            if here == t:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                path.clear()
                here = s
            while at[here] < len(graph[here]):
                e = graph[here][at[here]]
                if room[e] > 1e-9 and level[to[e]] == level[here] + 1:
                    break
                at[here] += 1
            else:
                if here == s:
                    break
                level[here] = -1
                e = path.pop()
                here = to[e ^ 1]
                continue
            path.append(e)
            here = to[e]


def main_text(page: str | None, smooth: float = 1.0) -> str:
    """The main text of a page; empty for null, empty or all-boilerplate pages. smooth scales all arcs between blocks."""
    found = blocks(page) if page else []
    if not found:
        return ""
    weigh(found)
    size, content = sum(len(b.text) for b in found), sum(len(b.text) for b in found if b.parent.content and not b.parent.boiler)
    costs = [name_cost(b.parent, size, content) for b in found]
    has_main = any(b.parent.content and not b.parent.boiler and c < NAMED for b, c in zip(found, costs))
    edges, last = [], {}
    for i, b in enumerate(found):
        before = last.get(id(b.parent.parent))
        if i:
            edges.append((i - 1, i, smooth * SMOOTH / (1 + distance(found[i - 1].parent, b.parent))))
        if before is not None and before < i - 1:
            edges.append((before, i, smooth * SIBLING))
        last[id(b.parent.parent)] = i
    keep = min_cut([score(b, has_main, c) for b, c in zip(found, costs)], edges)
    return " ".join(b.text for b, k in zip(found, keep) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Null and empty html and pages without content give an empty text; repeated rows are kept; an empty table
    gives no rows; other columns are ignored, whatever their names. Pages are handled one by one, so nothing is
    shuffled; a very long page is cut as a whole, in time that grows with its blocks.
    """
    bounded_batches(pages.sparkSession, 1000)

    def run(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return own.mapInArrow(run, f"page_id {own.schema[0].dataType.simpleString()}, url string, text string, n_chars long")
