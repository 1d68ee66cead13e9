"""A small, forgiving HTML reader: a tree of structural elements with their text blocks."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

#: Fixed values of HTML: elements without content, with raw content, inline elements, and what closes an open element.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object canvas select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big button cite code data del dfn em font i ins kbd label mark meter output progress q s samp small span strike strong sub sup time tt u var wbr".split())
CONTROLS = frozenset("button label meter output progress".split())
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"),
}
ENDS_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
SCOPES = frozenset("ul ol dl table body article section div aside nav header footer main form td th".split())

CLOSED = frozenset(t for tags in CLOSES.values() for t in tags)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|([^<]+|<)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAMES = re.compile(r"[a-z]+")


@dataclass(slots=True)
class Node:
    tag: str
    parent: Node | None
    tokens: tuple[str, ...] = ()
    flat: bool = False  # stands inside a block of its parent
    children: list = field(default_factory=list)  # nodes and (text, in a link) in page order
    inline: int = 0
    links: int = 0
    same: int = 0  # open inline elements of the same tag that aren't nodes, inside a flat node
    open_p: Node | None = None  # the nearest open paragraph in scope, or itself
    item: Node | None = None  # the nearest open element in scope that others may close, or itself

    def __post_init__(self) -> None:
        inside = None if self.tag in SCOPES or self.parent is None else self.parent
        self.open_p = self if self.tag == "p" else inside and inside.open_p
        self.item = self if self.tag in CLOSED else inside and inside.item


def attribute_tokens(source: str) -> tuple[str, ...]:
    out: list[str] = []
    for m in _ATTRIBUTE.finditer(source):
        name = m[1].lower()
        if name in ("class", "id", "role", "itemprop", "aria-label"):
            out += _NAMES.findall(next((g for g in m.groups()[1:] if g), "").lower())
        elif name in ("hidden",) or name == "aria-hidden" and (m[2] or m[3] or m[4]) == "true":
            out.append("hidden")
    return tuple(out)


def parse(html: str, marked: frozenset[str] = frozenset()) -> Node:
    """The tree of structural elements, with controls and inline elements that have a marked attribute token as flat nodes.

    Other inline elements melt into their parents; raw elements keep no text. The time is in proportion to the input:
    every element is closed once, and what a start tag closes is found by links to the open elements in scope.
    """
    root = Node("#root", None)
    at, pos, n, links = root, 0, len(html), 0
    opened: Counter[str] = Counter()

    def shut(upto: Node) -> Node:
        node = at
        while node is not upto:
            opened[node.tag] -= 1
            node = node.parent
        opened[upto.tag] -= 1
        return upto.parent

    while pos < n:
        m = _TOKEN.match(html, pos)
        if m is None:  # cannot be: a lone < is a token
            break
        pos = m.end()
        text, tag = m[4], m[2]
        if text is not None:
            at.children.append((unescape(text) if "&" in text else text, links > 0))
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in VOID:
                if tag == "br":
                    at.children.append((" ", False))
                continue
            if tag in INLINE:
                up = at
                while up.flat and up.tag != tag:
                    up = up.parent
                if tag == "a":
                    links = max(0, links - 1)
                if up.flat and up.same:
                    up.same -= 1
                elif up.flat:
                    at = shut(up)
                continue
            if opened[tag] > 0:
                up = at
                while up.tag != tag:
                    up = up.parent
                at, links = shut(up), 0
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, pos)
            at.children.append(Node(tag, at, attribute_tokens(m[3]), True))
            pos = close.end() if close else n
            continue
        if tag in INLINE:
            at.inline += 1
            if tag == "a":
                links += 1
                at.links += 1
            tokens = attribute_tokens(m[3]) if tag in CONTROLS or m[3] else ()
            if tag in CONTROLS or not marked.isdisjoint(tokens):
                node = Node(tag, at, tokens, True)
                at.children.append(node)
                at = node
                opened[tag] += 1
            elif at.flat and at.tag == tag:
                at.same += 1
            continue
        if tag in ("br", "wbr", "input") or tag in VOID and tag != "hr":
            if tag == "br":
                at.children.append((" ", False))
            elif tag == "input":
                at.children.append(Node(tag, at, (), True))
            continue
        if tag in ENDS_P and at.open_p:
            at = shut(at.open_p)
        while tag in CLOSES:
            up = at.item
            while up is not None and up.tag not in CLOSES[tag]:
                up = up.parent.item if up.tag not in SCOPES and up.parent is not None else None
            if up is None:
                break
            at = shut(up)
        node = Node(tag, at, attribute_tokens(m[3]))
        at.children.append(node)
        if tag != "hr":
            at, links = node, 0
            opened[tag] += 1
    return root


def clean(text: str) -> str:
    """White space folded."""
    return " ".join(text.split())
