"""Main text of web pages by a minimum cut: classifier costs at the terminals, smoothness along page and DOM."""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyhouse.llm.ship import ship

ARROW_ROWS = 256

# Elements of HTML by their role.
UNSHOWN = ("script style noscript template head title svg math select option button textarea iframe object canvas audio video map "
           "datalist").split()
CONTAINERS = set((
    "html body main article section div nav header footer aside form ul ol dl table tbody thead tfoot tr td th figure figcaption "
    "details summary dialog fieldset blockquote menu center").split())
BREAKS = CONTAINERS | set("p h1 h2 h3 h4 h5 h6 br hr li dt dd pre address legend caption label input img".split())
BOILERPLATE = set("nav header footer aside form menu dialog fieldset".split())
MAIN = set("article main".split())
# Elements that hold the page or its article: words in their names tell of a state, not of what they are.
HOLDERS = set("html body main".split())
# Words in class, id, role or label attributes that mark what is not the article, and what is.
BAD_NAMES = set((
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored promo promoted promotion banner "
    "sidebar side rail menu nav navbar navigation navigate breadcrumb breadcrumbs topbar masthead header footer foot cookie cookies consent "
    "gdpr notice notices alert warning popup modal overlay comment comments commentlist reply replies respond disqus discussion share "
    "sharing social related recommended recommendations newsletter subscribe subscription signup login search searchbox form widget "
    "pagination pager toolbar skip copyright legal disclaimer tags meta byline contentinfo complementary").split())
GOOD_NAMES = set("article articlebody content main story post entry text body hentry".split())
# A class that begins with one of these tells what an element has, not what it is.
HAVING = set("has with without no".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<(?P<raw>script|style|noscript|template|svg|textarea|title|select|iframe|object|canvas)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"
    r".*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[/!?a-zA-Z][^>]*>", re.S | re.I)
NAMES = re.compile(r"\b(?:class|id|role|aria-label|itemprop|data-role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Weights of the classifier, in nats, and of the smoothness edges.
PRIOR, PER_LOG_WORD, PER_LINK, IN_MAIN, IN_BOILERPLATE, GOOD, BAD, HEADING = -1.2, 0.8, -4.0, 3.0, -8.0, 1.5, -8.0, 0.8
NEXT_BLOCK, SAME_PARENT, PER_STEP = 0.6, 1.2, 0.6


@dataclass
class Element:
    tag: str
    parent: Element | None
    depth: int
    main: bool
    boilerplate: bool
    names: float
    hidden: bool
    inside: bool = False
    articles: int = 0
    h1: bool = False


@dataclass
class Block:
    parent: Element
    heading: bool
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _names(rest: str) -> float:
    """What the attributes' words say: BAD, GOOD or nothing."""
    good = False
    for m in NAMES.finditer(rest):
        for name in m.group(1).split():
            words = [w.lower() for w in PART.findall(name)]
            if words and words[0] not in HAVING and any(w in BAD_NAMES for w in words):
                return BAD
            good |= any(w in GOOD_NAMES for w in words)
    return GOOD if good else 0.0


def _hidden(rest: str) -> bool:
    """Whether an attribute hides the element: `hidden`, `aria-hidden`, or a style that does not show it."""
    for m in ATTRIBUTE.finditer(rest):
        name, value = m.group(1).lower(), (m.group(2) or "").strip("\"'").strip()
        if (name == "hidden" and value.lower() != "false" or name == "aria-hidden" and value.lower() == "true"
                or name == "style" and UNSEEN.search(value)):
            return True
    return False


def _name(elements: list[Element]) -> None:
    """Let bad names count for what stands below, but not those of an element that holds the page's article.

    That is one with all articles of the page below it, and either there is one only or a first heading is among them.
    """
    total = sum(e.tag == "article" and not e.inside for e in elements)
    for e in reversed(elements):
        e.parent.articles += e.articles + (e.tag == "article" and not e.inside)
        e.parent.h1 |= e.h1
    for e in elements:
        if e.names == BAD and total and e.articles == total and (total == 1 or e.h1):
            e.names = 0.0
        if e.parent.names == BAD and e.tag != "main":
            e.names = BAD


def blocks_of(html: str) -> list[Block]:
    """The blocks of text in page order, each with the container it stands in."""
    root = Element("", None, 0, False, False, 0.0, False)
    here, out, links, unshown, at = root, [], 0, None, 0
    block = Block(root, False)
    elements: list[Element] = []

    def flush(heading: bool = False) -> Block:
        nonlocal block
        if block.parts:
            block.text = " ".join("".join(block.parts).split())
            if block.text:
                out.append(block)
        block = Block(here, heading)
        return block

    def add(raw: str) -> None:
        if unshown is None and raw:
            text = unescape(raw) if "&" in raw else raw
            block.parts.append(text)
            if links:
                block.linked += len(text.strip())

    for m in TOKEN.finditer(html):
        add(html[at:m.start()])
        at = m.end()
        tag = m.group("tag")
        if tag is None:
            if m.group().startswith("<![CDATA["):
                add(m.group()[9:-3])
            continue
        tag, end, rest = tag.lower(), bool(m.group("end")), m.group("rest")
        if unshown is not None:
            if end and tag == unshown:
                unshown = None
            elif tag == "body":
                unshown = None
            else:
                continue
        if tag in UNSHOWN:
            if not end and not rest.endswith("/"):
                unshown = tag
            flush(block.heading)
        elif tag == "a":
            links = max(0, links + (-1 if end else 1))
        elif tag in CONTAINERS:
            if end:
                found = here
                while found is not None and found.tag != tag:
                    found = found.parent
                if found is not None and found.parent is not None:
                    here = found.parent
            else:
                inside = here.main or tag in MAIN
                here = Element(
                    tag, here, here.depth + 1, inside,
                    here.boilerplate or (tag in BOILERPLATE and not (tag == "header" and here.main)),
                    _names(rest), here.hidden or _hidden(rest), here.inside or here.tag == "article")
                if tag in HOLDERS or tag == "article" and not here.inside:
                    here.names = max(here.names, 0.0)
                elements.append(here)
                links = 0
            flush()
        elif tag in BREAKS:
            if tag[0] == "h" and len(tag) == 2 and tag[1].isdigit():
                links = 0
                here.h1 |= tag == "h1"
                flush(not end)
            else:
                flush(block.heading and tag == "br")
            if not end and rest and tag in ("p", "li", "dt", "dd", "pre", "address") and _names(rest) == BAD:
                block.parent = Element(tag, here, here.depth + 1, here.main, here.boilerplate, BAD, here.hidden)
    add(html[at:])
    flush()
    _name(elements)
    return [b for b in out if not b.parent.hidden]


def cost(block: Block) -> float:
    """The classifier's log odds that a block belongs to the article."""
    size = len(block.text)
    words = block.text.count(" ") + 1
    odds = PRIOR + PER_LOG_WORD * math.log1p(words) + PER_LINK * min(1.0, block.linked / size)
    odds += IN_MAIN * block.parent.main + IN_BOILERPLATE * block.parent.boilerplate + block.parent.names
    return odds + (HEADING if block.heading else 0.0)


def _steps(a: Element, b: Element) -> int:
    """The number of edges between two elements in the DOM."""
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        n += 1
    return n


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between blocks that should be labelled alike: neighbours on the page, and neighbours in the same container."""
    edges, last = [], {}
    for i, block in enumerate(blocks):
        if i:
            edges.append((i - 1, i, NEXT_BLOCK * math.exp(-PER_STEP * _steps(blocks[i - 1].parent, block.parent))))
        before = last.get(id(block.parent))
        if before is not None:
            edges.append((before, i, SAME_PARENT))
        last[id(block.parent)] = i
    return edges


def minimum_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """For each node whether it stays on the source's side of a minimum cut.

    A node of positive odds is tied to the source with that capacity, one of negative odds to the sink. Maximal flow by
    Dinic's method: levels by breadth-first search, then augmenting paths along the levels.
    """
    n = len(odds)
    source, sink = n, n + 1
    ends: list[int] = []
    caps: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def tie(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(ends))
        ends.append(b)
        caps.append(there)
        out[b].append(len(ends))
        ends.append(a)
        caps.append(back)

    for i, value in enumerate(odds):
        if value > 0:
            tie(source, i, value, 0.0)
        elif value < 0:
            tie(i, sink, -value, 0.0)
    for a, b, weight in edges:
        tie(a, b, weight, weight)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source], queue = 0, deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if caps[e] > tiny and level[ends[e]] < 0:
                    level[ends[e]] = level[a] + 1
                    queue.append(ends[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        arc, path, a = [0] * (n + 2), [], source
        while True:
            if a == sink:
                flow = min(caps[e] for e in path)
                for e in path:
                    caps[e] -= flow
                    caps[e ^ 1] += flow
                cut = next(k for k, e in enumerate(path) if caps[e] <= tiny)
                a = ends[path[cut] ^ 1]
                del path[cut:]
                continue
            while arc[a] < len(out[a]):
                e = out[a][arc[a]]
                if caps[e] > tiny and level[ends[e]] == level[a] + 1:
                    break
                arc[a] += 1
            if arc[a] < len(out[a]):
                path.append(out[a][arc[a]])
                a = ends[path[-1]]
            elif path:
                level[a] = -1
                a = ends[path.pop() ^ 1]
            else:
                break


def main_text(html: str) -> str:
    """The blocks on the content side of the cut, joined by a space."""
    blocks = blocks_of(html)
    if not blocks:
        return ""
    kept = minimum_cut([cost(b) for b in blocks], smoothness(blocks))
    return " ".join(b.text for b, keep in zip(blocks, kept) if keep)


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """`pages` with `text` in place of the column `html`: the article's text of each page.

    Character references are decoded, white space in a block becomes one space, blocks are joined in page order by one. Nothing else
    is dropped, and pages are read whole. Costs come from the words, links and names around a block; the cut then labels neighbours
    alike unless their costs stand against it. A page is worked on alone, so nothing is shuffled.

    NULL and empty pages give an empty text, as pages without an article do. Repeated rows come out alike. An empty table gives none.
    A column `text` is replaced.
    """
    spark = ship(pages.sparkSession)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    read = pages.drop("text") if html != "text" else pages
    names = read.columns
    kept = [c for c in names if c != html]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h or "") for h in batch.column(names.index(html)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(names.index(c)) for c in kept), pa.array(texts, pa.string())], [*kept, "text"])

    fields = [read.schema[names.index(c)] for c in kept]
    return read.mapInArrow(run, T.StructType([*fields, T.StructField("text", T.StringType())]))
