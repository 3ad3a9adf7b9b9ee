"""Main text of web pages by a minimum cut between content and boilerplate blocks.

A page's markup is read into blocks: stretches of text between block-level tags, each with its path of open elements.  A
linear classifier with stated weights gives each block the log-odds of being content, from its length, sentence ends,
share of link text, and the tags, classes, ids and roles on its path.  The log-odds become terminal capacities: to the
source where positive, to the sink where negative.  Blocks that follow one another are joined by edges that weaken with
their distance in the tree, and so are the next blocks under one parent.  The minimum cut is the labelling of least total
cost; a paragraph too short to tell goes with its neighbours, an advert between two paragraphs does not.

Nodes whose terminal outweighs all their edges are settled first, which never changes the minimum; maximum flow by
shortest augmenting paths settles the others.  Pages are independent: one pass, no shuffle, a row at a time in memory.

Defined cases: a null or empty page, and one without blocks, has an empty text; comments, scripts, styles, form controls,
titles and markup never become text; unclosed elements end with their parents, unterminated comments and scripts at the
end of the page; pages of any length are read whole; ties go to boilerplate; rows that are equal get equal results; other
columns pass through, and where one has the name of a new one, that gets underscores before it; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtrace.llm.common import free_name

TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>="']++|=\s*+(?:"[^"]*+"|'[^']*+'|)|["'])*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=>"'/]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?""")

#: Elements by what they do to text.
DROPPED = set("script style noscript template iframe title textarea select button object canvas audio video svg xmp noembed noframes datalist".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr caption ul".split()
)
#: Open elements that a start tag ends, up to the elements that hold them.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}
HOLDS_P = {"td", "th", "table", "caption", "body", "html"}
#: Levels of the tree; texts of deeper elements are kept, on this level.
DEEPEST = 512
#: What wraps whole pages: only a class that says it outright counts there.
LAYOUT = {"html", "body", "main", "article"}

#: Log-odds of content for what stands on a block's path.  An element's worst word counts, or else its best.
TAGS = {"nav": -12.0, "footer": -12.0, "aside": -12.0, "form": -12.0, "menu": -12.0, "dialog": -12.0, "search": -12.0, "fieldset": -8.0, "header": -9.0, "article": 7.0, "main": 5.0}
ROLES = {"navigation": -12.0, "banner": -9.0, "contentinfo": -12.0, "complementary": -12.0, "search": -12.0, "form": -12.0, "alert": -12.0, "dialog": -12.0, "alertdialog": -12.0, "menu": -12.0, "menubar": -12.0, "status": -12.0, "main": 5.0, "article": 7.0}
WORDS = {
    **dict.fromkeys("nav navbar navigation navi menu menus submenu breadcrumb breadcrumbs crumbs pagination pager skiplink toolbar".split(), -12.0),
    **dict.fromkeys("footer foot masthead topbar bottombar colophon copyright imprint".split(), -12.0),
    **dict.fromkeys("sidebar side aside rail widget widgets blogroll".split(), -12.0),
    **dict.fromkeys("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion promoted banner commercial".split(), -12.0),
    **dict.fromkeys("cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup paywall toast disclaimer".split(), -12.0),
    **dict.fromkeys("comment comments commentlist reply replies respond responses disqus discussion".split(), -12.0),
    **dict.fromkeys("share sharing social related recommended recommendations trending teaser teasers".split(), -9.0),
    **dict.fromkeys("form login search searchbox contactform hidden".split(), -9.0),
    "header": -9.0,
    **dict.fromkeys("article content entry post story main prose maintext".split(), 3.0),
}
#: Words of a class that make `header` in it a heading of the article.
OWN_HEADER = {"article", "entry", "post", "story"}
#: Weights of the text itself: constant, logarithm of words, sentence end, share of link text, heading, list item, no article around where the page has one.
CONSTANT, LONG, SENTENCE, LINKS, HEADING, ITEM, OUTSIDE = -2.2, 0.9, 1.0, -6.0, 1.2, -0.8, -4.0
#: Capacity between neighbours at distance 1 in the tree, and between next blocks under one parent.
ADJACENT, SIBLING = 3.0, 1.0
SENTENCE_END = re.compile(r"[.!?…。！？][\"'”’»)\]]*$")
BLOCK = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("tag", T.StringType()), T.StructField("content", T.BooleanType())]))
SCALE = 1000  # capacities are whole thousandths, so that sums are exact


@lru_cache(maxsize=4096)
def _evidence(tag: str, attributes: str) -> float:
    """Log-odds that an element's tag and attributes speak of content; 0 if they say nothing."""
    got = {}
    for name, *values in ATTRIBUTE.findall(attributes):
        got.setdefault(name.lower(), unescape("".join(values)))
    if "hidden" in got or got.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", got.get("style", ""), re.I):
        return -12.0
    found = [TAGS.get(tag, 0.0), ROLES.get(got.get("role", "").lower(), 0.0)]
    for name in f"{got.get('class', '')} {got.get('id', '')}".split():
        words = [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", name)]
        if tag in LAYOUT:
            # Layout says what a page has; a part of it is named after that alone.
            words = words if len(words) == 1 or words[0] == "comment" else []
        values = [WORDS.get(w, 0.0) for w in words if w != "header" or not OWN_HEADER.intersection(words)]
        found += values
    return min(found) if min(found) < 0 else max(found)


class Element:
    __slots__ = ("tag", "parent", "depth", "evidence", "wraps", "inside")

    def __init__(self, tag: str, parent: Element | None, evidence: float):
        if parent and parent.depth >= DEEPEST:
            parent = parent.parent  # what is nested deeper stands beside its parent
        self.tag, self.parent, self.evidence = tag, parent, evidence
        self.depth = parent.depth + 1 if parent else 0
        self.wraps = False  # holds an article, a main part or a first heading
        self.inside = tag in ("article", "main") or bool(parent and parent.inside)


class Block:
    __slots__ = ("element", "text", "linked")

    def __init__(self, element: Element, text: str, linked: float):
        self.element, self.text, self.linked = element, text, linked


@lru_cache(maxsize=64)
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I)


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order, white space made single spaces and character references decoded."""
    top = Element("html", None, 0.0)
    stack, out = [top], []
    parts: list[str] = []
    links, linked, at = 0, 0, 0
    opened = Counter()

    def block() -> Element:
        return next(e for e in reversed(stack) if e.tag in BLOCKS)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(block(), text, min(1.0, linked / len(text))))
            parts.clear()
            linked = 0

    def say(text: str) -> None:
        nonlocal linked
        text = unescape(text)
        parts.append(text)
        if links:
            linked += len(" ".join(text.split()))

    def close(upto: int, below: int | None = None) -> None:
        nonlocal links
        for e in stack[upto:below]:
            opened[e.tag] -= 1
            links -= e.tag == "a"
        del stack[upto:below]

    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCKS:
                flush()
            elif tag == "br":
                parts.append(" ")
            # An end tag ends its element and all in it, an inline one itself alone; cells hold what is inside them.
            for i in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[i].tag == tag:
                    close(i, None if tag in BLOCKS else i + 1)
                    break
                if stack[i].tag in ("td", "th") and tag not in HOLDS_P and tag not in ENDS:
                    break
            continue
        if tag in DROPPED:
            if tag != "svg" or not m[3].endswith("/"):
                end = _end_of(tag).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in BLOCKS:
            flush()
            for i in range(len(stack) - 1, 0, -1) if opened["p"] else ():
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in HOLDS_P:
                    break
            ended, until = ENDS.get(tag, ((), ()))
            for i in range(len(stack) - 1, 0, -1) if any(opened[x] for x in ended) else ():
                if stack[i].tag in until:
                    break
                if stack[i].tag in ended:
                    close(i)
        elif tag == "br":
            parts.append(" ")
        elif tag == "a" and links:
            i = max(i for i, e in enumerate(stack) if e.tag == "a")
            close(i, i + 1)  # links do not nest
        if tag in VOID:
            continue
        value = _evidence(tag, m[3]) if m[3] or tag in TAGS else 0.0
        element = Element(tag, stack[-1], value)
        if (tag in ("article", "main") and value > 0) or (tag == "h1" and not _within(element, "header")):
            for e in stack:
                e.wraps = True
        links += tag == "a"
        opened[tag] += 1
        stack.append(element)
    flush()
    return out


def _within(element: Element, tag: str) -> bool:
    while element.parent:
        element = element.parent
        if element.tag == tag:
            return True
    return False


def score(block: Block, has_article: bool) -> float:
    """Log-odds that a block is content."""
    text, e = block.text, block.element
    out = CONSTANT + LONG * _log2(text.count(" ") + 1) + LINKS * block.linked
    if SENTENCE_END.search(text):
        out += SENTENCE
    if e.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        out += HEADING
    elif e.tag == "li":
        out += ITEM
    if has_article and not e.inside:
        out += OUTSIDE
    worst, best = 0.0, 0.0
    while e is not None:
        if e.evidence > 0:
            best = max(best, e.evidence)
        elif e.evidence < 0 and not (e.wraps and e.tag not in ("nav", "footer", "aside")) and not (e.tag == "header" and e.evidence == TAGS["header"] and e.parent and e.parent.inside):
            worst = min(worst, e.evidence)
        e = e.parent
    return out + (worst if worst < 0 else best)


@lru_cache(maxsize=4096)
def _log2(n: int) -> float:
    return (n.bit_length() - 1) + (n / (1 << (n.bit_length() - 1)) - 1)  # straight between the powers of two


def distance(a: Element, b: Element) -> int:
    """Steps between two elements by way of the lowest one that holds both."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def neighbours(blocks: list[Block]) -> dict[tuple[int, int], int]:
    """Capacities between blocks: next in the page, and next under one parent."""
    out: dict[tuple[int, int], int] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            out[i - 1, i] = int(SCALE * ADJACENT / max(1, distance(blocks[i - 1].element, b.element)))
        held = id(b.element.parent)
        if held in last:
            pair = (last[held], i)
            out[pair] = out.get(pair, 0) + int(SCALE * SIBLING)
        last[held] = i
    return out


def min_cut(terminal: list[int], edges: dict[tuple[int, int], int]) -> list[bool]:
    """Which nodes lie on the source's side of the smallest minimum cut; terminal capacities are to the source where positive."""
    around: list[dict[int, int]] = [{} for _ in terminal]
    for (a, b), w in edges.items():
        around[a][b] = around[a].get(b, 0) + w
        around[b][a] = around[b].get(a, 0) + w
    value, side = list(terminal), [None] * len(terminal)
    todo = deque(range(len(terminal)))
    held = [sum(x.values()) for x in around]
    while todo:
        i = todo.popleft()
        if side[i] is not None or not (value[i] > held[i] or -value[i] >= held[i]):
            continue
        side[i] = value[i] > held[i]
        for j, w in around[i].items():
            if side[j] is None:
                value[j] += w if side[i] else -w
                held[j] -= w
                todo.append(j)
    left = [i for i, s in enumerate(side) if s is None]
    if left:
        for i, reached in zip(left, _flow(left, value, around), strict=True):
            side[i] = reached
    return side


def _flow(nodes: list[int], value: list[int], around: list[dict[int, int]]) -> list[bool]:
    """Maximum flow by blocking flows in levels; which of `nodes` the source still reaches."""
    place = {i: k for k, i in enumerate(nodes)}
    n = len(nodes)
    source, sink = n, n + 1
    rest: list[dict[int, int]] = [{} for _ in range(n + 2)]
    for i, k in place.items():
        for j, w in around[i].items():
            if j in place:
                rest[k][place[j]] = w
        if value[i] > 0:
            rest[source][k], rest[k][source] = value[i], 0
        elif value[i] < 0:
            rest[k][sink], rest[sink][k] = -value[i], 0
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            u = queue.popleft()
            for v, w in rest[u].items():
                if w > 0 and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if sink not in level:
            return [k in level for k in range(n)]
        ahead = {u: [v for v in rest[u] if level.get(v) == level[u] + 1] for u in level}
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                least = min(rest[a][b] for a, b in zip(path, path[1:], strict=False))
                for a, b in zip(path, path[1:], strict=False):
                    rest[a][b] -= least
                    rest[b][a] += least
                path = [source]
                continue
            while ahead[u] and rest[u][ahead[u][-1]] <= 0:
                ahead[u].pop()
            if ahead[u]:
                path.append(ahead[u][-1])
            else:
                path.pop()
                if path:
                    ahead[path[-1]].pop()


def labelled(page: str) -> list[tuple[str, str, bool]]:
    """(text, tag, content) of each block of a page."""
    blocks = blocks_of(page)
    has_article = any(b.element.inside for b in blocks)
    terminal = [int(SCALE * score(b, has_article)) for b in blocks]
    return [(b.text, b.element.tag, kept) for b, kept in zip(blocks, min_cut(terminal, neighbours(blocks)), strict=True)]


@F.arrow_udf(BLOCK)
def blocks(html: pa.Array) -> pa.Array:
    """Labelled blocks of each page."""
    kind = pa.list_(pa.struct([("text", pa.string()), ("tag", pa.string()), ("content", pa.bool_())]))
    return pa.array([[dict(zip(("text", "tag", "content"), x, strict=True)) for x in labelled(page.as_py() or "")] for page in html], kind)


def main_text(labels: Column) -> Column:
    return F.array_join(F.transform(F.filter(labels, lambda b: b["content"]), lambda b: b["text"]), "\n")


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """`pages` with `text`, the main text, and `blocks`, all blocks with their labels; both last."""
    found, text = free_name(pages, "blocks"), free_name(pages, "text")
    done = pages.withColumn(found, blocks(F.col(html)))
    return done.select(*pages.columns, main_text(F.col(found)).alias(text), found)
