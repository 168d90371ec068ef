"""Block trees of HTML pages and their alignment by simple tree matching, for use inside tasks."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter

import numpy as np

# Elements of HTML by how they are parsed.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript template svg math object canvas".split())
PLAIN = frozenset("title textarea".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that end by themselves where the named ones start.
CLOSED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option", "optgroup"]),
    "tr": frozenset(["tr", "tbody", "thead", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
}
#: Elements beyond which such an end doesn't reach.
SCOPES = frozenset("ul ol dl table select div article section main aside nav body html".split())

# Elements that are no part of an article, and words of classes, ids and roles that say so.
ASIDE = frozenset("nav footer aside form button select dialog menu head fieldset legend".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice alert "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side aside complementary header masthead footer contentinfo "
    "comment comments respond replies disqus share sharing social related recommended newsletter subscribe subscription signup login "
    "search popup modal toolbar pagination pager skip hidden".split()
)
ARTICLE_WORDS = frozenset(["articlebody", "main"])

#: Blocks deeper than this count as children of the block at this depth.
DEEPEST = 60
#: Pairs of siblings that are held against each other at once.
CELLS = 1_000_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</?(?P<tag>[A-Za-z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|</?(?P<cut>[A-Za-z][^\s/>]*)(?P<rest>[^>]*)(?:>|\Z)"  # quotes that never end, or the page does
    r"|</[^>]*(?:>|\Z)",
    re.S,
)
_MARKS = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_PIECES = re.compile(r"[a-z]+")


class Tree:
    """A page's blocks in page order: tag, class mark, parent (-1 at the top), text and what is said of it.

    A block is an element that isn't inline, or a run of text beside such elements. `aside` tells that
    the block lies in a menu, header, footer or the like, `inside` that it lies in an article, and
    `linked` how many characters of its text are in links.
    """

    def __init__(self):
        self.tag: list[str] = []
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.text: list[str] = []
        self.aside: list[bool] = []
        self.inside: list[bool] = []
        self.linked: list[int] = []

    def add(self, tag: str, parent: int, aside: bool, inside: bool) -> int:
        while parent >= 0 and self.depth[parent] >= DEEPEST:
            parent = self.parent[parent]
        self.tag.append(tag)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.text.append("")
        self.aside.append(aside)
        self.inside.append(inside)
        self.linked.append(0)
        return len(self.tag) - 1


def _marks(attributes: str) -> tuple[set[str], bool]:
    """Words of class, id, role and itemprop, and whether the element is hidden."""
    words, hidden = set(), False
    for name, value in _MARKS.findall(attributes):
        value = value.strip("\"'").lower()
        if name.lower() == "hidden" or (name.lower() == "aria-hidden" and value == "true"):
            hidden = True
        else:
            words.update(_PIECES.findall(value))
    return words, hidden


def parse(page: str) -> Tree:
    """The block tree of a page. Unclosed, stray and cut-off tags are taken as browsers take them."""
    tree = Tree()
    #: Open elements: tag, block that holds their text, whether aside, in an article, in a header. Of inline
    #: elements only links and those aside (and those of the same name in them) are kept.
    stack: list[tuple[str, int, bool, bool, bool]] = [("", -1, False, False, False)]
    opened: Counter[str] = Counter()
    current, links, at, size = -1, 0, 0, len(page)
    buffer: list[str] = []

    def flush() -> None:
        nonlocal current
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                _, block, aside, inside, _ = stack[-1]
                own = current if current >= 0 else tree.add("#", block, aside, inside)
                tree.text[own] = f"{tree.text[own]} {text}" if tree.text[own] else text
            buffer.clear()
        current = -1

    def say(raw: str) -> None:
        nonlocal current
        if not raw:
            return
        if current < 0 and not raw.isspace():
            _, block, aside, inside, _ = stack[-1]
            # An element's first text is its own; text after a block inside it is a block beside that.
            fresh = block >= 0 and block == len(tree.tag) - 1 and tree.aside[block] == aside
            current = block if fresh else tree.add("#", block, aside, inside)
        text = html.unescape(raw)
        buffer.append(text)
        if links and current >= 0:
            tree.linked[current] += len(text.strip())

    def close(depth: int) -> None:
        nonlocal links
        for tag, *_ in stack[depth:]:
            links -= tag == "a"
            opened[tag] -= 1
        del stack[depth:]

    while at < size:
        m = _TOKEN.search(page, at)
        start = m.start() if m else size
        say(page[at:start])
        if not m:
            break
        at = m.end()
        tag, attributes = (m["tag"] or m["cut"] or "").lower(), m["attributes"] or m["rest"] or ""
        if not tag or (at == size and page[-1] != ">"):
            continue
        if page[start + 1] == "/":
            depth = next(d for d in range(len(stack) - 1, -1, -1) if stack[d][0] == tag) if opened[tag] else 0
            if tag == "p" or (depth and (tag not in INLINE or stack[depth][2] != stack[depth - 1][2])):
                flush()
            if depth and not (tag in INLINE and any(s[0] not in INLINE for s in stack[depth + 1 :])):
                close(depth)
            continue
        if tag in RAW or tag in PLAIN:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at) if not attributes.endswith("/") else None
            at = end.end() if end else at if attributes.endswith("/") else size
            if tag not in ("svg", "math", "canvas"):
                flush()
            continue
        if tag == "br":
            buffer.append(" ")
            continue
        if tag in VOID:
            if tag not in INLINE:
                flush()
            continue
        top, block, aside, inside, header = stack[-1]
        words, hidden = _marks(attributes) if attributes else (set(), False)
        if tag in INLINE:
            if hidden or words & ASIDE_WORDS:
                flush()
                aside = True
            if tag == "a" or tag == top or aside != stack[-1][2]:
                links += tag == "a"
                opened[tag] += 1
                stack.append((tag, block, aside, inside, header))
            continue
        flush()
        if any(opened[t] for t in ("p", *CLOSED_BY)):
            for d in range(len(stack) - 1, 0, -1):
                if stack[d][0] == "p" or tag in CLOSED_BY.get(stack[d][0], ()):
                    close(d)
                    break
                if stack[d][0] in SCOPES:
                    break
        _, block, aside, inside, header = stack[-1]
        # Of a header inside an article, the headings stay.
        aside = aside or hidden or tag in ASIDE or (tag == "header" and not inside) or (header and tag not in HEADINGS)
        if tag not in ("html", "body") and not (tag == "header" and inside):
            aside = aside or bool(words & ASIDE_WORDS and not words & ARTICLE_WORDS)
        inside = inside or tag in ("article", "main") or bool(words & ARTICLE_WORDS)
        mark = ".".join(sorted(words)[:3])
        own = tree.add(f"{tag}.{mark}" if mark else tag, block, aside, inside)
        opened[tag] += 1
        stack.append((tag, own, aside, inside, header or tag == "header"))
    flush()
    return tree


def skeleton(tag: list[str], parent: list[int]) -> str:
    """The tree's tags with runs of like siblings taken as one, so that pages of one template agree."""
    children: list[list[int]] = [[] for _ in range(len(tag) + 1)]
    for node, p in enumerate(parent):
        children[p].append(node)
    said = [""] * len(tag)
    for node in range(len(tag) - 1, -1, -1):  # children follow their parents
        said[node] = f"{tag[node]}({_runs(children[node], said)})" if children[node] else tag[node]
    return _runs(children[-1], said)


def _runs(nodes: list[int], said: list[str]) -> str:
    return ",".join(said[n] for i, n in enumerate(nodes) if not i or said[n] != said[nodes[i - 1]])


def match(tag: list[str], parent: list[int], text: list[int], tag2: list[str], parent2: list[int], text2: list[int]) -> list[int]:
    """For each node of the first tree the node of the second that simple tree matching pairs with it, or -1.

    Nodes match under matched parents, in order, where tags agree; the matching has the most nodes,
    a node whose text agrees too counting twice. Work is at most the product of both sizes; runs of
    siblings whose product is over CELLS are cut first, where a node is alone of its tag and text in both.
    """
    kids, kids2 = _children(parent), _children(parent2)
    number = {t: i for i, t in enumerate(dict.fromkeys([*tag, *tag2]))}
    tags, tags2 = np.array([number[t] for t in tag], np.int64), np.array([number[t] for t in tag2], np.int64)
    texts, texts2 = np.array(text, np.int64), np.array(text2, np.int64)
    full, full2 = np.array([bool(k) for k in kids[:-1]], bool), np.array([bool(k) for k in kids2[:-1]], bool)
    value: dict[tuple[int, int], float] = {}

    def order(a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray]:
        same = tags[a][:, None] == tags2[b]
        w = same * (1.0 + (texts[a][:, None] == texts2[b]))
        for i, j in np.argwhere(same & full[a][:, None] & full2[b]):
            w[i, j] += under(a[i], b[j])
        best = np.zeros((len(a) + 1, len(b) + 1))
        for i in range(len(a)):
            best[i + 1, 1:] = np.maximum.accumulate(np.maximum(best[i, 1:], best[i, :-1] + w[i]))
        return w, best

    def under(x: int, y: int) -> float:
        if (x, y) not in value:
            value[x, y] = sum(order(a, b)[1][-1, -1] for a, b in _runs_of(kids[x], kids2[y], tags, texts, tags2, texts2))
        return value[x, y]

    out = [-1] * len(tag)
    todo = [(kids[-1], kids2[-1])]
    while todo:
        for a, b in _runs_of(*todo.pop(), tags, texts, tags2, texts2):
            best = order(a, b)[1]
            i, j = len(a), len(b)
            while i and j:
                if best[i, j] == best[i - 1, j]:
                    i -= 1
                elif best[i, j] == best[i, j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    out[a[i]] = b[j]
                    todo.append((kids[a[i]], kids2[b[j]]))
    return out


def _runs_of(a: list[int], b: list[int], tags: np.ndarray, texts: np.ndarray, tags2: np.ndarray, texts2: np.ndarray) -> list[tuple[list[int], list[int]]]:
    """Runs of siblings to align with each other, of at most CELLS pairs each (or of one node on a side)."""
    if len(a) * len(b) <= CELLS:
        return [(a, b)] if a and b else []
    said, said2 = list(zip(tags[a], texts[a], strict=True)), list(zip(tags2[b], texts2[b], strict=True))
    count, place = Counter(said), {k: j for j, k in enumerate(said2)}
    alone = Counter(said2)
    found = [(i, place[k]) for i, k in enumerate(said) if count[k] == 1 and alone[k] == 1]
    ends, chain, back = [], [], {}
    for i, j in found:  # the longest increasing run of places
        n = bisect_left(ends, j)
        back[i, j] = chain[n - 1] if n else None
        ends[n:], chain[n:] = [j, *ends[n + 1 :]], [(i, j), *chain[n + 1 :]]
    cut, at = [], chain[-1] if chain else None
    while at:
        cut.append(at)
        at = back[at]
    out, i0, j0 = [], 0, 0
    for i, j in [*reversed(cut), (len(a), len(b))]:
        pieces = max(1, int(np.ceil(np.sqrt((i - i0) * (j - j0) / CELLS))))
        edges = [[lo + (hi - lo) * k // pieces for k in range(pieces + 1)] for lo, hi in ((i0, i), (j0, j))]
        out += [(a[p:q], b[r:t]) for p, q, r, t in zip(edges[0], edges[0][1:], edges[1], edges[1][1:], strict=False) if p < q and r < t]
        if i < len(a):
            out.append(([a[i]], [b[j]]))
        i0, j0 = i + 1, j + 1
    return out


def _children(parent: list[int]) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(len(parent) + 1)]
    for node, p in enumerate(parent):
        out[p].append(node)
    return out
