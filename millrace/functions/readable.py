"""The main part of a web page (F24): a linear scan of its HTML to a flat table of nodes, and scores of blocks by text and links.

A node is (tag, parent, depth, start, end, chars, linked, commas, out): its place in the flat table of its page is its number, start and end
are offsets of what it holds, chars counts visible signs in it (runs of white space once), linked those inside links, and out tells that it
is no content by its tag or the words of its class and id, or lies in such a node.

Blocks of text give points to the nodes above them: 1, one for each comma, and one for each hundred signs up to three; in whole to the
parent, a half to the one above, and 1 / (3 n) to the n-th above that (64 nodes at most). A node's score is its points times the share of its signs that
lie outside links. The best node's content, without the nodes in it that are out, is the main part; a page without a block has none.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

#: Elements without content, elements whose content is no text, and what an opening tag closes before it.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript textarea title template svg iframe".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Blocks that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: What a closing tag does not reach through, unless it closes a table or the page; and what an opening tag does not.
WALLS = frozenset("table td th body html".split())
_THROUGH_WALLS = frozenset("table tbody thead body html".split())
_BLOCK_WALLS = WALLS | frozenset("ul ol dl div article section".split())
TEXT_BLOCKS = frozenset("p pre blockquote td dd li".split())
OUT_TAGS = frozenset("nav footer aside form menu button select dialog head".split())
OUT_WORDS = frozenset("ad ads advert advertisement banner breadcrumb breadcrumbs comment comments cookie footer menu nav navbar pagination popup promo related share sidebar social sponsor sponsored widget".split())
KEPT_WORDS = frozenset("article body content entry main post text".split())
LEAST_CHARS = 25
#: Nodes above a block that it gives points to.
LEVELS = 64

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WHITE = re.compile(r"[ \t\n\r\f\v]+")


class Node(NamedTuple):
    tag: str
    parent: int
    depth: int
    start: int
    end: int
    chars: int
    linked: int
    commas: int
    out: bool


def _is_out(tag: str, attributes: str) -> bool:
    if tag in OUT_TAGS:
        return True
    if tag in ("article", "main", "body", "html") or not attributes:
        return False
    words = {w for m in _NAMES.finditer(attributes) for w in re.split(r"[^a-z]+", (m[1] or m[2] or m[3] or "").lower())}
    return bool(words & OUT_WORDS) and not words & KEPT_WORDS


def scan(html: str) -> list[Node]:
    """The nodes of a page in the order in which they open, the page itself first. Linear in the page's length and the depth of what is open."""
    nodes: list[list] = [["", -1, 0, 0, len(html), 0, 0, 0, False]]
    open_nodes, held, at = [0], Counter(), 0

    def text(piece: str) -> None:
        flat = _WHITE.sub(" ", piece).strip(" ")
        if flat:
            here = nodes[open_nodes[-1]]
            here[5] += len(flat)
            here[6] += len(flat) if held["a"] else 0
            here[7] += flat.count(",") + flat.count("，") + flat.count("、")

    def close(tags: tuple[str, ...], walls: frozenset[str], end: int) -> None:
        """Closes the innermost open node of these tags, and those in it, unless a wall is in between. What they hold counts for those above."""
        if not any(held[t] for t in tags):
            return
        upto = len(open_nodes) - 1
        while nodes[open_nodes[upto]][0] not in tags:
            if nodes[open_nodes[upto]][0] in walls:
                return
            upto -= 1
        shut(upto, end)

    def shut(upto: int, end: int) -> None:
        while len(open_nodes) > upto:
            node = nodes[open_nodes.pop()]
            held[node[0]] -= 1
            node[4] = end
            above = nodes[node[1]]
            if not node[8] or above[8]:
                for i in (5, 6, 7):
                    above[i] += node[i]

    while m := _TAG.search(html, at):
        text(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            close((tag,), frozenset() if tag in _THROUGH_WALLS else WALLS, m.start())
        elif m[3].endswith("/") or tag in VOID:
            continue
        elif tag in RAW:
            over = re.compile(f"</{tag}[^>]*>", re.I).search(html, at)
            at = over.end() if over else len(html)
        else:
            close(CLOSES.get(tag, ("p",) if tag in ENDS_P else ()), _BLOCK_WALLS, m.start())
            parent = open_nodes[-1]
            nodes.append([tag, parent, len(open_nodes), m.end(), len(html), 0, 0, 0, nodes[parent][8] or _is_out(tag, m[3])])
            open_nodes.append(len(nodes) - 1)
            held[tag] += 1
    text(html[at:])
    shut(1, len(html))
    return [Node(*n) for n in nodes]


def points(node: Node) -> int:
    """What a block of text gives to those above it; 0 if it is none."""
    if node.out or node.tag not in TEXT_BLOCKS or node.chars < LEAST_CHARS:
        return 0
    return 1 + node.commas + min(3, node.chars // 100)


def best(nodes: list[Node]) -> int | None:
    """The number of the node with the highest score, the first of those with one score; null without any block."""
    score = [0.0] * len(nodes)
    for node in nodes:
        given, above, level = points(node), node.parent, 0
        while given and above >= 0 and level < LEVELS:
            score[above] += given / (1, 2)[level] if level < 2 else given / (3 * (level - 1))
            above, level = nodes[above].parent, level + 1
    score = [s * (1 - n.linked / n.chars) if n.chars and not n.out else 0.0 for s, n in zip(score, nodes, strict=True)]
    top = max(range(len(nodes)), key=lambda i: (round(score[i], 9), -i))
    return top if score[top] > 0 else None


def main_html(html: str) -> str | None:
    """The HTML of the main part."""
    nodes = scan(html)
    top = best(nodes)
    if top is None:
        return None
    parts, at, end = [], nodes[top].start, nodes[top].end
    for node in nodes[top + 1 :]:
        if node.start >= end:
            break
        if node.out and node.start >= at:
            # From before the opening tag to behind the closing one.
            parts.append(html[at : html.rfind("<", at, node.start)])
            close = html.find(">", node.end)
            at = close + 1 if html.startswith("</", node.end) and close >= 0 else node.end
    parts.append(html[at:end])
    return "".join(parts)
