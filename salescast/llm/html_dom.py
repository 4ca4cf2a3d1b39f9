"""A small tolerant HTML reader: a page as a tree of block elements with their text."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    # A quote opens a value only after "=", as in HTML; one that never closes opens none.
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*))*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")

# Element names by their part in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "html head body article section main nav header footer aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd "
    "table thead tbody tfoot tr td th caption blockquote pre form fieldset legend figure figcaption details "
    "summary address hgroup dialog menu center".split()
)
CLOSES_P = BLOCK - frozenset(["html", "head", "body"]) | {"hr"}
# An opening tag ends an open element of these names, unless a wall stands between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}


@dataclass
class Node:
    """A block element. ``runs`` are its own stretches of text, each with the number of children before it."""

    tag: str
    names: str
    parent: int
    depth: int
    place: int
    children: list[int] = field(default_factory=list)
    runs: list[tuple[int, str]] = field(default_factory=list)
    link_chars: int = 0
    inline_tags: int = 0


def clean(text: str) -> str:
    """References decoded, each stretch of white space one space, ends trimmed."""
    if "&" in text:
        text = html.unescape(text)
    return " ".join(text.split())


def names_of(attributes: str) -> str:
    """The words of class, id, role and the like, in lower case."""
    if "=" not in attributes:
        return ""
    found = [
        (m[2] or m[3] or m[4] or "")
        for m in ATTRIBUTE.finditer(attributes)
        if m[1].lower() in ("class", "id", "role", "itemprop", "aria-label")
    ]
    return " ".join(found).lower()


def parse(page: str) -> list[Node]:
    """The block elements of a page in page order; the first is the root.

    Tags that HTML lets one leave out are implied. Text of scripts, styles and the like
    is not text. An inline element only adds to the block it is in.
    """
    nodes = [Node("#root", "", -1, 0, 0)]
    stack: list[tuple[str, int]] = [("#root", 0)]  # every open element, with its nearest block
    pieces: list[str] = []
    links = 0
    at, size = 0, len(page)

    def end_run() -> None:
        if pieces:
            text = clean("".join(pieces))
            pieces.clear()
            if text:
                node = nodes[stack[-1][1]]
                node.runs.append((len(node.children), text))

    def close_to(depth: int) -> None:
        nonlocal links
        if any(name in BLOCK for name, _ in stack[depth:]):
            end_run()
        for name, _ in stack[depth:]:
            links -= name == "a"
        del stack[depth:]

    def close_implied(names: set[str] | frozenset[str], walls: set[str]) -> None:
        cut = 0
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in walls:
                break
            if stack[i][0] in names:
                cut = i
        if cut:
            close_to(cut)

    while at < size:
        found = TOKEN.search(page, at)
        text = page[at : found.start() if found else size]
        if text:
            pieces.append(text)
            if links > 0:
                nodes[stack[-1][1]].link_chars += len(text)
        if not found:
            break
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            if found[0].startswith("<![CDATA["):
                pieces.append(html.escape(found[0][9:].removesuffix("]]>")))
            continue
        if found[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    close_to(i)
                    break
            continue
        if name in CLOSES_P:
            close_implied({"p"}, {"table", "td", "th", "button", "object"})
        if name in ENDS:
            close_implied(*ENDS[name])
        if name in ("br", "hr"):
            pieces.append(" ")
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(page, at)
            close = page.find(">", end.end()) if end else -1
            at = size if close < 0 else close + 1
            continue
        if name in VOID:
            nodes[stack[-1][1]].inline_tags += 1
            continue
        own = stack[-1][1]
        if name in BLOCK:
            end_run()
            parent = nodes[own]
            nodes.append(Node(name, names_of(found[3]), own, parent.depth + 1, len(parent.children)))
            own = len(nodes) - 1
            parent.children.append(own)
        else:
            nodes[own].inline_tags += 1
            links += name == "a"
        stack.append((name, own))
    end_run()
    return nodes
