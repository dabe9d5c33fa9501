"""Main-text extraction from HTML by minimum-cut labelling.

A page is read into text blocks (the text between block-level tags) with the open elements around
each; an inline advert cuts its paragraph into pieces that are joined again if they stay. A linear classifier over tag, class, link and
text features gives each block an integer score: a positive score becomes the capacity of its edge from the content terminal, a
negative one that of its edge to the boilerplate terminal. Neighbouring blocks are tied by smoothness
edges, stronger the closer they are in the DOM, and so are consecutive blocks of one parent.
The minimum cut labels all blocks of the page at once: a short paragraph goes with the article it
stands in, a text-like notice with the bar it stands in. Blocks that the cut leaves free are content.

One narrow pass over the pages, one page at a time: no shuffle, memory bounded by a page.

Defined cases: null or empty html, or a page without content, gives the empty text; unclosed and
crossed tags are closed as they are met; an unclosed comment, script or style runs to the end, also one written with a slash; ``<br>``
is white space inside a block; deeply nested pages cost memory by their elements; repeated rows are repeated; null ids are kept; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+)>")
_ATTR = re.compile(r"(?:^|\s)(class|id|role|aria-label|hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_WORDS = re.compile(r"[a-z]+")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style template textarea title iframe noembed noframes svg".split())
BLOCK = set("""address article aside blockquote body button caption center dd details dialog div dl dt fieldset
    figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav
    ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul xmp""".split())
#: an opening tag of the key closes an open element of the value, up to the nearest container
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"},
          "tfoot": {"tbody", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}
#: elements that are no running text wherever they stand
CHROME_TAGS = set("nav footer aside form button select option dialog menu fieldset label legend search head".split())
CHROME_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
CHROME_WORDS = set("""ad ads advert adverts advertisement advertising adbox adsense sponsor sponsored promo promotion banner
    sidebar menu nav navbar navigation breadcrumb breadcrumbs masthead footer cookie cookies consent gdpr notice
    notices notification alert popup modal overlay newsletter subscribe subscription signup share sharing social related
    recommended comment comments respond replies reply disqus widget widgets toolbar pagination pager login
    copyright legal disclaimer skip tagcloud""".split())
HEADER_WORDS = {"header"}
CONTENT_WORDS = set("article content post entry story body main text maincontent".split())

#: class words that say a wrapper is merely laid out around such a part
LAYOUT_WORDS = set("with has no without page wrapper layout wrap container site".split())
REMARK_WORDS = set("comment comments respond replies reply disqus".split())

#: words that name a part of the page or, next to a word that names no part ("related-work"), a subject of the article
SUBJECT_WORDS = set("related menu legal notice notices social sharing recommended alert promotion".split())
PART_WORDS = set("""area articles bar block body bottom box btn button buttons card cards col column content group icon icons inner item items
    left link links list main more news outer page panel post posts right row section sections site stories story text title top wrap wrapper""".split())
#: words of adverts that stand inside a line
ADVERT_WORDS = set("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo".split())

HARD, NAMED, SOFT = 60, 50, 20      # boilerplate marks: by element, by class word, by a mixed class
REMARK, FIRM = 1, 2                 # marks that an article inside does not lift: by remark words (the page's first article does), by element or role
NEAR, SIBLING = 12, 8


@dataclass(slots=True, eq=False)
class _Node:
    """A block-level element."""
    key: int                        # number of the element on the page
    above: _Node | None
    depth: int


@dataclass(slots=True)
class _Open:
    tag: str
    node: _Node                     # the innermost block-level element
    in_article: bool
    chrome: int                     # strongest boilerplate mark on the way down, 0 if none
    firm: int
    content: bool
    hidden: bool
    link: bool
    heading: bool
    advert: bool = False            # inside a line


@dataclass(slots=True)
class Block:
    text: str
    node: _Node
    in_article: bool
    chrome: int
    content: bool
    heading: bool
    link_chars: int
    line: int = 0                   # pieces of one line have the same number
    raw: str = ""                   # the text before white space is trimmed


def _mark(words: set[str], named: list[set[str]], in_article: bool) -> int:
    """How much the class words speak for boilerplate."""
    hits = words & CHROME_WORDS
    if in_article and hits <= SUBJECT_WORDS and not words & HEADER_WORDS and all(
            n - CHROME_WORDS - PART_WORDS for n in named if n & hits):
        return SOFT
    return NAMED if in_article or not words & CONTENT_WORDS else SOFT


def _open(tag: str, attrs: str, key: int, above: _Open, first: bool = True) -> _Open:
    in_article = above.in_article or tag in ("article", "main")
    chrome, firm, content, hidden = above.chrome, above.firm, above.content, above.hidden
    if tag in ("article", "main") and not above.in_article and (firm == 0 or firm == REMARK and first):
        chrome = firm = 0            # a form or a wrapper named after a part of it still holds the article
    words: set[str] = set()
    named: list[set[str]] = []      # words of each class
    if attrs:
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
            if name in ("class", "id"):
                named += [set(_WORDS.findall(v)) for v in value.split()]
                words = words.union(*named)
            elif name == "role" and value in CHROME_ROLES:
                chrome, firm = HARD, FIRM
            elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                hidden = True
    if tag in CHROME_TAGS or tag == "header" and not in_article:
        chrome, firm = HARD, firm if tag == "form" else FIRM
    if words and tag not in ("body", "html", "article", "main"):
        if words & REMARK_WORDS and not words & LAYOUT_WORDS:
            chrome, firm = HARD, max(firm, REMARK)
        elif (words & CHROME_WORDS or words & HEADER_WORDS and not in_article) and not words & LAYOUT_WORDS:
            chrome = max(chrome, _mark(words, named, in_article))
        elif words & CONTENT_WORDS:
            content = True
    elif words and tag == "article" and words & REMARK_WORDS and not words & LAYOUT_WORDS:
        chrome = HARD
    inline = tag not in BLOCK
    advert = inline and (above.advert or bool(words & ADVERT_WORDS and not words & LAYOUT_WORDS))
    return _Open(tag, above.node if inline else _Node(key, above.node, above.node.depth + 1), in_article, chrome, firm, content, hidden,
                 above.link or tag == "a", above.heading or tag in ("h1", "h2", "h3", "h4", "h5", "h6"), advert)


def blocks(html: str) -> list[Block]:
    """The page's text blocks in page order; markup, comments and raw-text elements are gone."""
    stack = [_Open("", _Node(0, None, 0), False, 0, 0, False, False, False, False)]
    out: list[Block] = []
    parts: list[tuple[str, bool, bool]] = []        # text, whether of an advert, whether of a link
    key = 0
    lines = 0
    first = True                    # no article or main so far

    def flush():
        nonlocal parts, lines
        top = stack[-1]
        if parts and not top.hidden:
            lines += 1
            for advert, run in groupby(parts, key=lambda part: part[1]):
                run = list(run)
                raw = "".join(chunk for chunk, _, _ in run)
                if text := " ".join(raw.split()):
                    out.append(Block(text, top.node, top.in_article, max(top.chrome, NAMED) if advert else top.chrome, top.content, top.heading,
                                     sum(len(chunk) for chunk, _, link in run if link), lines, raw))
        parts = []

    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt != at:
            chunk = unescape(html[at:lt if lt >= 0 else n])
            top = stack[-1]
            if not top.hidden:
                parts.append((chunk, top.advert, top.link))
            if lt < 0:
                break
        nxt = html[lt + 1:lt + 2]
        if nxt in ("!", "?"):
            if html.startswith("<!--", lt):
                end = html.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            else:
                end = html.find("]]>" if html.startswith("<![CDATA[", lt) else ">", lt)
                at = n if end < 0 else end + (3 if html.startswith("<![CDATA[", lt) else 1)
            continue
        m = _TAG.match(html, lt)
        if not m:
            if not stack[-1].hidden:
                parts.append(("<", stack[-1].advert, False))
            at = lt + 1
            continue
        at, tag = m.end(), m[1].lower()
        if nxt == "/":
            if tag in BLOCK:
                flush()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    if tag in BLOCK or not any(e.tag in BLOCK for e in stack[i + 1:]):
                        del stack[i:]
                    else:
                        del stack[i]
                    break
            continue
        if tag in RAW:
            # of these only an svg can end with its own slash; others written so are taken at their word if nothing closes them
            closed = m[2].endswith("/")
            if not (closed and tag == "svg"):
                end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, at)
                if end is not None:
                    at = html.find(">", end.end() - 1) + 1 or n
                elif not closed or tag in ("script", "style"):
                    at = n
            continue
        if tag == "br":
            parts.append((" ", stack[-1].advert, False))
            continue
        if tag in BLOCK:
            flush()
            closes, scope = CLOSES.get(tag), SCOPE.get(tag, {"table"})
            if tag not in ("td", "th", "li", "dd", "dt", "button", "label") or closes:
                for i in range(len(stack) - 1, 0, -1):      # an open paragraph ends at the next block
                    t = stack[i].tag
                    if t == "p":
                        del stack[i:]
                        break
                    if t in BLOCK:
                        break
            if closes:
                last = len(stack)
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in scope or stack[i].tag in ("ul", "ol", "dl", "table", "select"):
                        break
                    if stack[i].tag in closes:
                        last = i
                del stack[last:]
        if tag not in VOID and not (m[2].endswith("/") and tag not in BLOCK and tag != "a"):
            key += 1
            stack.append(_open(tag, m[2], key, stack[-1], first))
            first = first and tag not in ("article", "main")
    flush()
    return out


def score(b: Block) -> int:
    """Classifier score in tenths: above 0 content, below 0 boilerplate."""
    n = len(b.text)
    s = -10 + min(n // 8, 20) + (8 if b.text[-1] in ".!?:;\"'»”…。" else 0)
    s -= min(40, 40 * b.link_chars // max(n, 1))
    if b.text[0] == "©" or "©" in b.text[:40] and n < 200:
        s -= 20
    if b.heading:
        s += 10
    if b.in_article:
        s += 40
    elif b.content:
        s += 15
    return s - 2 * b.chrome


def _near(a: _Node, b: _Node) -> int:
    """Smoothness between page neighbours: halves with each level up to the common element."""
    x, y, reach = a, b, NEAR.bit_length()
    while x is not y:
        if x.depth >= y.depth:
            x = x.above
        else:
            y = y.above
        if a.depth - x.depth > reach or b.depth - y.depth > reach:
            return 0
    return NEAR >> max(a.depth - x.depth, b.depth - x.depth, 1) - 1


def edges(bs: list[Block]) -> list[tuple[int, int, int]]:
    """Smoothness edges: page neighbours, and consecutive blocks under one parent."""
    out = []
    last: dict[int, int] = {}
    for i, b in enumerate(bs):
        if i and (w := _near(bs[i - 1].node, b.node)):
            out.append((i - 1, i, w))
        parent = (b.node.above or b.node).key
        j = last.get(parent)
        if j is not None and j != i - 1:
            out.append((j, i, SIBLING))
        last[parent] = i
    return out


def min_cut(scores: list[int], ties: list[tuple[int, int, int]]) -> list[bool]:
    """True for blocks on the content side of a minimum cut (the largest content side of all).

    Positive scores are capacities from the content terminal, negative ones to the boilerplate
    terminal, ties both-way capacities. Maximum flow by shortest augmenting levels (Dinic); what
    cannot reach the boilerplate terminal in the residual graph is content."""
    n = len(scores)
    to: list[int] = []
    cap: list[int] = []
    adj: list[list[int]] = [[] for _ in range(n)]
    for a, b, w in ties:
        adj[a].append(len(to))
        to.append(b)
        cap.append(w)
        adj[b].append(len(to))
        to.append(a)
        cap.append(w)
    src = [max(s, 0) for s in scores]
    sink = [max(-s, 0) for s in scores]
    while True:
        # distance to the boilerplate terminal, backwards from blocks with room to it
        dist = [-1] * n
        queue = deque(i for i in range(n) if sink[i] > 0)
        for i in queue:
            dist[i] = 1
        while queue:
            v = queue.popleft()
            for e in adj[v]:
                u = to[e]
                if dist[u] < 0 and cap[e ^ 1] > 0:
                    dist[u] = dist[v] + 1
                    queue.append(u)
        starts = [i for i in range(n) if src[i] > 0 and dist[i] > 0]
        if not starts:
            return [d < 0 for d in dist]
        turn = [0] * n
        for s in starts:
            path: list[int] = []
            v = s
            while src[s] > 0:
                if sink[v] > 0 and dist[v] == 1:
                    flow = min(src[s], sink[v], *[cap[e] for e in path]) if path else min(src[s], sink[v])
                    src[s] -= flow
                    sink[v] -= flow
                    for e in path:
                        cap[e] -= flow
                        cap[e ^ 1] += flow
                    path, v = [], s
                    continue
                while turn[v] < len(adj[v]):
                    e = adj[v][turn[v]]
                    if cap[e] > 0 and dist[to[e]] == dist[v] - 1:
                        path.append(e)
                        v = to[e]
                        break
                    turn[v] += 1
                else:
                    if not path:
                        break
                    e = path.pop()
                    v = to[e ^ 1]
                    turn[v] += 1
        # the next round sees longer ways only


def extract(html: str | None) -> str:
    bs = blocks(html or "")
    if not bs:
        return ""
    keep = min_cut([score(b) for b in bs], edges(bs))
    lines = []
    for _, line in groupby((b for b, k in zip(bs, keep) if k), key=lambda b: b.line):
        pieces = list(line)
        lines.append(pieces[0].text if len(pieces) == 1 else " ".join("".join(b.raw for b in pieces).split()))
    return "\n".join(lines)


def _extract_batches(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            b = whole.slice(at, rows)
            texts = [extract(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    src = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return src.mapInArrow(_extract_batches,
                          f"page_id {src.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint")
