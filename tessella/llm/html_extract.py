"""Main text of HTML pages by minimum-cut labelling of their blocks and regions.

A page is cut into blocks of text. Blocks lie in regions: elements that are or are named like content, or like boilerplate.
The graph has a node for each block and each region. Its terminal capacities are the costs of two logistic classifiers
trained on labelled samples made by seeded rules: one of blocks, which sees only a block's own text (length, links,
heading), and one of regions, which sees their kind and links and counts once for each of their blocks. Neither tells the
labels apart alone: headings and asides have short texts, readers' comments long ones. Smoothness edges join adjacent
blocks, blocks that follow each other in one DOM container, weaker the farther apart their containers are, and each block
with its region (DOM proximity). The minimum cut is the cheapest labelling: most blocks follow their region, and blocks
without one their neighbours, unless their own text says otherwise more strongly.

Nodes whose terminal capacity outweighs all their edges are settled first (they have that label in some minimum cut); the
rest go through max-flow.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append, table

#: Elements that bound blocks.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table "
    "tbody td textarea tfoot th thead title tr ul button iframe".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page: skipped up to their end tag.
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas audio video xmp noembed noframes".split())
#: Elements that are never main text.
CHROME = frozenset("nav header footer aside form menu button select dialog head fieldset search".split())
CONTENT = frozenset(("article", "main"))
#: A start tag of the key closes an open element of the value, up to the nearest container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words of class, id and role names that mark boilerplate, and those that mark content.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner banners sponsor sponsored promo promotion promos cookie cookies consent "
    "gdpr notice notices newsletter subscribe subscription sidebar side menu menus nav navbar navigation breadcrumb breadcrumbs "
    "footer header masthead comment comments commentlist disqus respond reply replies discussion social share sharing related "
    "recommended recommendations popup popups modal overlay widget widgets pagination pager login signin signup search toolbar "
    "skip copyright legal complementary contentinfo alert alertdialog".split()
)
CONTENT_HINTS = frozenset("article content post entry story main body text".split())

_TAG = re.compile(r"""<(?:!--(?:>|->|.*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*(?:>|\Z)))""", re.S)
_NAMES = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

#: Capacities of the edges between adjacent blocks, between following blocks of one container, and from a block to its region.
ADJACENT, SIBLING, REGION = 0.6, 0.4, 5.0
#: Most that a block's own text counts, in nats.
OWN = 3.0
KINDS = ("content", "hint", "chrome")


class Block:
    """A block of text. region: its element's number (-1: none), which is of the given kind, an index into KINDS."""

    __slots__ = ("container", "depth", "heading", "kind", "linked", "region", "text")


def blocks(page: str) -> list[Block]:
    """Blocks of a page in order. Unclosed elements end with their container, stray end tags are ignored.

    A block's region is the outermost boilerplate element around it, else the outermost content element. Elements named by
    a hint word are boilerplate, but not those around the page's article or main: of the articles and mains, those
    inside the fewest hinted elements are the page's, and only hints inside them count.
    """
    out: list[Block] = []
    # Of each open element: name, number of the outermost chrome (-1: none), hinted elements around it, number of the
    # outermost content, container number, the hinted elements around its outermost article or main (-1: in none), and
    # the numbers of the outermost hinted element and of the outermost one inside that article or main.
    stack: list[tuple[str, int, int, int, int, int, int, int]] = [("", -1, 0, -1, 0, -1, -1, -1)]
    told: list[tuple[int, int, int, int, int]] = []
    elements = 0
    parts: list[str] = []
    linked = links = heading = 0
    containers, at = 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
            if text:
                b = Block()
                b.text, b.linked, b.heading = text, min(1.0, linked / len(text)), bool(heading)
                _, chrome, _, content, b.container, base, outer, inner = stack[-1]
                told.append((chrome, content, -1 if chrome >= 0 else base, outer, inner))
                b.depth = len(stack)
                out.append(b)
            parts.clear()
        linked = 0

    def pop_to(i: int) -> None:
        nonlocal links, heading
        for name, *_ in stack[i:]:
            links -= name == "a"
            heading -= name in ("h1", "h2", "h3", "h4", "h5", "h6")
        del stack[i:]

    def said(piece: str) -> None:
        nonlocal linked
        parts.append(piece)
        if links:
            linked += len(piece)

    size = len(page)
    while at < size:
        m = _TAG.search(page, at)
        if m is None:
            said(page[at:])
            break
        if m.start() > at:
            said(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        block = name in BLOCK
        if name == "br":
            said(" ")
            continue
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    if block:
                        flush()
                    pop_to(i)
                    break
            else:
                if block:
                    flush()
            continue
        if name in RAW:
            if block:
                flush()
            if not m[3].endswith("/>"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else size
            continue
        if block:
            flush()
            if stack[-1][0] == "p" or any(e[0] == "p" for e in stack[-4:]):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == "p":
                        pop_to(i)
                        break
                    if stack[i][0] in BLOCK:
                        break
            closes = CLOSES.get(name)
            if closes:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in closes:
                        pop_to(i)
                        break
                    if stack[i][0] in ("ul", "ol", "dl", "table", "select", "div"):
                        break
        if name in VOID or (m[3].endswith("/>") and not block):
            continue
        _, chrome, level, content, container, base, outer, inner = stack[-1]
        hint, around, elements = False, level, elements + 1
        if name == "body":
            chrome = -1
        hidden, named = name in CHROME, name in CONTENT
        attributes = m[3]
        if len(attributes) > 1 and block:
            for key, *values in _NAMES.findall(attributes):
                key, value = key.lower(), "".join(values)
                if key in ("class", "id", "role"):
                    words = {w.lower() for w in _WORDS.findall(value)}
                    hint = hint or (name not in ("body", "html", "article", "main") and not words.isdisjoint(HINTS))
                    named = named or not words.isdisjoint(CONTENT_HINTS)
                elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
                    hidden = True
                elif key == "style" and "display:none" in value.replace(" ", "").lower():
                    hidden = True
        level += hint
        if hidden and chrome < 0:
            chrome = elements
        if named and content < 0:
            content = elements
        if name in CONTENT and base < 0:
            base, inner = around, -1
        if hint:
            outer, inner = (elements if outer < 0 else outer), (elements if inner < 0 else inner)
        if block and name not in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "dt", "dd", "tr"):
            containers += 1
            container = containers
        links += name == "a"
        heading += name in ("h1", "h2", "h3", "h4", "h5", "h6")
        stack.append((name, chrome, level, content, container, base, outer, inner))
    flush()
    least = min((base for _, _, base, _, _ in told if base >= 0), default=-1)
    for b, (chrome, content, base, outer, inner) in zip(out, told, strict=True):
        hint = inner if base == least and base >= 0 else outer
        b.region, b.kind = (chrome, 2) if chrome >= 0 else (hint, 1) if hint >= 0 else (content, 0)
    return out


def features(b: Block, marked: bool) -> tuple[float, ...]:
    """Of a block's own text. marked: the page marks its content somewhere, so that a block outside of any region is suspect."""
    return (1.0, min(len(b.text), 1000) / 250, b.linked, float(b.heading), float(marked and b.region < 0))


def region_features(kind: int, linked: float) -> tuple[float, ...]:
    """linked: the share of the region's text that is links."""
    return (*(float(kind == k) for k in range(len(KINDS))), linked)


def block_samples(n: int = 4000, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Features of n labelled blocks (1: content). The labels overlap: content has short blocks, boilerplate long ones."""
    rng = random.Random(seed)
    x, y = [], []
    for _ in range(n):
        content = rng.random() < 0.5
        short = rng.random() < (0.25 if content else 0.65)
        linked = rng.choice((0, 0, 0, rng.random() ** 2)) if content else rng.choice((0, rng.uniform(0.5, 1)))
        x.append((1.0, (rng.uniform(2, 60) if short else rng.uniform(60, 1000)) / 250, linked, float(rng.random() < (0.12 if content else 0.08)), float(rng.random() < (0.04 if content else 0.5))))
        y.append(float(content))
    return np.array(x), np.array(y)


def region_samples(n: int = 4000, seed: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Features of n labelled regions (1: content). A few content regions are named like boilerplate, and conversely."""
    rng = random.Random(seed)
    x, y = [], []
    for _ in range(n):
        content = rng.random() < 0.5
        kind = rng.choices(range(len(KINDS)), (99, 0.6, 0.4) if content else (2, 49, 49))[0]
        x.append(region_features(kind, rng.random() * (0.3 if content else 1) if rng.random() < 0.5 else 0.0))
        y.append(float(content))
    return np.array(x), np.array(y)


def _weights(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression (Newton steps, ridge 0.1)."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-x @ w))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w -= np.linalg.solve(hessian, x.T @ (p - y) + 0.1 * w)
    return tuple(w.tolist())


@lru_cache(maxsize=1)
def classifiers() -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Weights for blocks and for regions."""
    return _weights(*block_samples()), _weights(*region_samples())


def graph(found: list[Block]) -> tuple[list[float], dict[tuple[int, int], float]]:
    """Gains of content over boilerplate, of the blocks in order and then of their regions, and the capacities of all edges."""
    own, whole = classifiers()
    marked = any(b.kind == 0 and b.region >= 0 for b in found)
    gain = [max(-OWN, min(OWN, sum(x * y for x, y in zip(own, features(b, marked), strict=True)))) for b in found]
    links = edges(found)
    nodes: dict[tuple[int, int], int] = {}
    members: list[list[Block]] = []
    for i, b in enumerate(found):
        if b.region >= 0:
            r = nodes.setdefault((b.region, b.kind), len(nodes))
            if r == len(members):
                members.append([])
            members[r].append(b)
            links[(i, len(found) + r)] = REGION
    for (_, kind), mine in zip(nodes, members, strict=True):
        linked = sum(b.linked * len(b.text) for b in mine) / sum(len(b.text) for b in mine)
        gain.append(len(mine) * sum(x * y for x, y in zip(whole, region_features(kind, linked), strict=True)))
    return gain, links


def edges(found: list[Block]) -> dict[tuple[int, int], float]:
    """Smoothness capacities: neighbours, and the next block of the same container."""
    out: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            a = found[i - 1]
            near = 1.0 if a.container == b.container else 1 / (2 + abs(a.depth - b.depth))
            out[(i - 1, i)] = ADJACENT * near
        j = last.get(b.container)
        if j is not None:
            out[(j, i)] = out.get((j, i), 0.0) + SIBLING
        last[b.container] = i
    return out


def min_cut(gain: list[float], links: dict[tuple[int, int], float]) -> list[bool]:
    """Labels x that minimise sum of |gain| over blocks labelled against their gain's sign and of capacities over edges cut.

    Ties go to content (True).
    """
    n, gain = len(gain), list(gain)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), w in links.items():
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    weight = [sum(x.values()) for x in near]
    while queue:
        i = queue.popleft()
        if label[i] is None and (gain[i] >= weight[i] or -gain[i] > weight[i]):
            label[i] = gain[i] >= weight[i]
            for j, w in near[i].items():
                if label[j] is None:
                    gain[j] += w if label[i] else -w
                    weight[j] -= w
                    queue.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        content_side = _max_flow(rest, gain, near)
        for i in rest:
            label[i] = i in content_side
    return [bool(x) for x in label]


def _max_flow(rest: list[int], gain: list[float], near: list[dict[int, float]]) -> set[int]:
    """The nodes that can't reach the sink (boilerplate) in the residual graph of a maximum flow from content.

    Flow is pushed along shortest paths, all those of one length in a phase, so that pages of many blocks take few phases.
    """
    source, sink, at = 0, 1, {i: k + 2 for k, i in enumerate(rest)}
    ends: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(len(rest) + 2)]

    def join(a: int, b: int, there: float, back: float) -> None:
        for x, y, w in ((a, b, there), (b, a, back)):
            out[x].append(len(ends))
            ends.append(y)
            room.append(w)

    for i in rest:
        join(source, at[i], max(gain[i], 0.0), 0.0)
        join(at[i], sink, max(-gain[i], 0.0), 0.0)
        for j, w in near[i].items():
            if j in at and i < j:
                join(at[i], at[j], w, w)
    tiny = 1e-9

    def levels(start: int, backwards: bool) -> list[int]:
        level = [-1] * len(out)
        level[start], queue = 0, deque([start])
        while queue:
            x = queue.popleft()
            for e in out[x]:
                if room[e ^ 1 if backwards else e] > tiny and level[ends[e]] < 0:
                    level[ends[e]] = level[x] + 1
                    queue.append(ends[e])
        return level

    while (level := levels(source, False))[sink] >= 0:
        turn, path, x = [0] * len(out), [], source
        while True:
            if x == sink:
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                first = next(k for k, e in enumerate(path) if room[e] <= tiny)
                x = ends[path[first] ^ 1]
                del path[first:]
            elif turn[x] < len(out[x]):
                e = out[x][turn[x]]
                if room[e] > tiny and level[ends[e]] == level[x] + 1:
                    path.append(e)
                    x = ends[e]
                else:
                    turn[x] += 1
            elif path:
                x = ends[path.pop() ^ 1]
                turn[x] += 1
            else:
                break
    reach = levels(sink, True)
    return {i for i in rest if reach[at[i]] < 0}


def extract(page: str | None) -> str:
    """Main text: content blocks in page order, one on each line. Null, empty or textless page: empty."""
    found = blocks(page or "")
    if not found:
        return ""
    return "\n".join(b.text for b, keep in zip(found, min_cut(*graph(found)), strict=False) if keep)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for every page, from its whole html, however long; repeated rows get equal texts.

    Null or empty html: empty text. Empty table: no rows. Other columns are ignored, whatever their names.
    """
    slim = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).alias("__html"))

    def kernel(batch: pa.RecordBatch) -> list:
        texts = [extract(h) for h in batch.column("__html").to_pylist()]
        return [texts, [len(t) for t in texts]]

    return append(slim, kernel, "text string, n_chars bigint").drop("__html")


def op8(spark, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
