"""Lenient HTML to a small tree, tree skeletons, and simple tree matching."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# Element names by their part in a page.
BLOCKS = set(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th "
    "caption figure figcaption address hr header footer nav aside form fieldset details summary center dialog menu hgroup".split()
)
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style noscript template iframe textarea title svg math select button object canvas".split())
BOILERPLATE_TAGS = set("head nav header footer aside form dialog menu fieldset".split())
BOILERPLATE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notices alert popup modal overlay sidebar side comment comments commentlist disqus respond reply replies nav navbar navigation "
    "menu breadcrumb breadcrumbs footer header masthead share sharing social related newsletter subscribe subscription signup login "
    "search widget pagination pager skip toolbar contentinfo complementary".split()
)
CLOSES_PARAGRAPH = BLOCKS - {"html", "body"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
FENCES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)>", re.DOTALL
)
_ATTRIBUTE = re.compile(r"""([\w:-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_DIGITS = re.compile(r"\d+")
_WORD = re.compile(r"[a-z]+")


@dataclass
class Node:
    tag: str
    key: str
    parent: int
    own: bool = False  # boilerplate by its own tag or attributes
    blocks: list[str] = field(default_factory=list)
    children: list[int] = field(default_factory=list)


def _describe(tag: str, rest: str) -> tuple[str, bool]:
    """(key, boilerplate): the key names an element across pages: tag, class and id words."""
    if not rest.strip(" /"):
        return tag, tag in BOILERPLATE_TAGS
    values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(rest)}
    named = " ".join(html.unescape(values.get(k, "")) for k in ("class", "id", "role")).lower()
    spaced = re.sub(r"([a-z])([A-Z])", r"\1 \2", " ".join(values.get(k, "") for k in ("class", "id", "role"))).lower()
    style = values.get("style", "").replace(" ", "").lower()
    hidden = "hidden" in values or values.get("aria-hidden", "").lower() == "true" or "display:none" in style
    junk = tag in BOILERPLATE_TAGS or hidden or not BOILERPLATE_WORDS.isdisjoint(_WORD.findall(spaced))
    key = ".".join([tag, *sorted(set(_DIGITS.sub("", named).split()))])
    return key, junk and tag not in ("html", "body")


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """(nodes in page order, blocks in page order as (node, text)).  Node 0 is the root.

    A block is the text of one block element up to the next beginning or end of one; inline
    elements do not end it, a line break in it is white space."""
    nodes = [Node("#", "#", -1)]
    blocks: list[tuple[int, str]] = []
    stack = [0]
    parts: list[str] = []

    def end_block() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                nodes[stack[-1]].blocks.append(text)
                blocks.append((stack[-1], text))

    def close_down_to(depth: int) -> None:
        end_block()
        del stack[depth:]

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCKS:
                for depth in range(len(stack) - 1, 0, -1):
                    if nodes[stack[depth]].tag == tag:
                        close_down_to(depth)
                        break
                    if nodes[stack[depth]].tag in ("article", "main", "body") and tag in ("p", "div", "li", "span"):
                        break
            continue
        if tag in RAW and not m[3].rstrip().endswith("/"):
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(page, at)
            at = close.end() if close else (n if tag in ("script", "style") else at)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in BLOCKS:
            continue
        if tag in CLOSES_PARAGRAPH and nodes[stack[-1]].tag == "p":
            close_down_to(len(stack) - 1)
        for depth in range(len(stack) - 1, 0, -1):
            t = nodes[stack[depth]].tag
            if t in SIBLINGS.get(tag, ()):
                close_down_to(depth)
                break
            if t in FENCES.get(tag, ()) or tag not in SIBLINGS:
                break
        end_block()
        if tag in VOID:
            continue
        key, junk = _describe(tag, m[3])
        nodes.append(Node(tag, key, stack[-1], junk))
        nodes[stack[-1]].children.append(len(nodes) - 1)
        stack.append(len(nodes) - 1)
    end_block()
    return nodes, blocks


def boilerplate(nodes: list[Node]) -> list[bool]:
    """Whether each node is boilerplate, by itself or inside one.  If that leaves no article or
    main element of a page that has one, the names of the elements around it do not count."""

    def spread(exempt: list[bool]) -> list[bool]:
        out = [False] * len(nodes)
        for i in range(1, len(nodes)):
            out[i] = out[nodes[i].parent] or (nodes[i].own and not exempt[i])
        return out

    marked = [i for i, x in enumerate(nodes) if x.tag in ("article", "main")]
    out = spread([False] * len(nodes))
    if not marked or any(not out[i] for i in marked):
        return out
    around = [False] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        if around[i] or (nodes[i].tag in ("article", "main") and not nodes[i].own):
            around[nodes[i].parent] = True
    return spread(around)


Tree = tuple[tuple[str, ...], tuple[int, ...]]  # keys and sizes of the subtrees, depth first


def is_boilerplate(key: str) -> bool:
    """Whether a key names a kind of element that is boilerplate."""
    tag, *named = key.split(".")
    return tag in BOILERPLATE_TAGS or not BOILERPLATE_WORDS.isdisjoint(_WORD.findall(" ".join(named)))


def skeleton(nodes: list[Node]) -> tuple[Tree, list[int]]:
    """(tree of keys, place in it of every node).  Siblings with the same key are one node of
    the skeleton: repeated items are an iteration, whose length varies."""
    keys, kids, place = ["#"], [{}], [0] * len(nodes)
    for i in range(1, len(nodes)):
        above = place[nodes[i].parent]
        got = kids[above].get(nodes[i].key)
        if got is None:
            got = len(keys)
            keys.append(nodes[i].key)
            kids.append({})
            kids[above][nodes[i].key] = got
        place[i] = got
    order, rank, open_ = [], [0] * len(keys), [0]
    while open_:  # depth first, whatever the depth
        s = open_.pop()
        rank[s] = len(order)
        order.append(s)
        open_.extend(reversed(kids[s].values()))
    sizes = [1] * len(keys)
    for s in reversed(order):
        sizes[rank[s]] = 1 + sum(sizes[rank[k]] for k in kids[s].values())
    return (tuple(keys[s] for s in order), tuple(sizes)), [rank[s] for s in place]


def children(tree: Tree, place: int) -> list[int]:
    out, at, end = [], place + 1, place + tree[1][place]
    while at < end:
        out.append(at)
        at += tree[1][at]
    return out


def match(a: Tree, b: Tree) -> dict[int, int]:
    """Simple tree matching: the largest order-keeping matching of `a` and `b` that pairs nodes
    of equal key whose parents are paired.  Nodes by their depth-first places."""
    if a[0][0] != b[0][0]:
        return {}
    pairs = [(0, 0)]
    below: list[tuple[list[int], list[int]]] = []
    for x, y in pairs:  # grows: pairs that may be matched, parents first
        xs, ys = children(a, x), children(b, y)
        below.append((xs, ys))
        pairs += [(u, v) for u in xs for v in ys if a[0][u] == b[0][v]]
    weight: dict[tuple[int, int], int] = {}
    tables: dict[tuple[int, int], list[list[int]]] = {}
    for pair, (xs, ys) in zip(reversed(pairs), reversed(below)):
        best = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
        for i, u in enumerate(xs):
            for j, v in enumerate(ys):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + weight.get((u, v), 0))
        tables[pair], weight[pair] = best, 1 + best[-1][-1]
    found, open_, kids = {}, [(0, 0)], dict(zip(pairs, below))
    while open_:
        pair = open_.pop()
        found[pair[0]] = pair[1]
        (xs, ys), best = kids[pair], tables[pair]
        i, j = len(xs), len(ys)
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                open_.append((xs[i - 1], ys[j - 1]))
                i, j = i - 1, j - 1
    return found
