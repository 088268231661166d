"""A forgiving HTML reader: blocks of a page as a tree, with the figures that the extractor's trees look at."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

#: Element names by the role that HTML gives them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes template noscript svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: An element's start ends an open one of these, unless one of the second group lies between.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody")}
WALLS = frozenset("ul ol dl table html body article section div select".split())
NEVER_TEXT = frozenset("head script style textarea title xmp iframe noembed noframes template noscript svg math select option button input object canvas audio video".split())

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    depth: int
    names: tuple[str, ...] = ()
    kids: list[int] = field(default_factory=list)
    #: Text runs and child nodes in page order: str, or the index of a child; None is a line's break.
    parts: list = field(default_factory=list)
    chars: int = 0
    link_chars: int = 0
    tags: int = 0
    blocks: int = 0
    paragraphs: int = 0
    links: int = 0
    stops: int = 0


def attribute_names(raw: str) -> tuple[str, ...]:
    """Words of class, id, role and the like, lower-cased, plural s removed."""
    out = []
    for m in ATTRIBUTE.finditer(raw):
        if m[1].lower() in ("class", "id", "role", "itemprop", "aria-label"):
            for w in NAMES.findall(m[2] or m[3] or m[4] or ""):
                w = w.lower()
                out.append(w[:-1] if len(w) > 3 and w.endswith("s") else w)
    return tuple(dict.fromkeys(out))


def parsed(page: str) -> list[Node]:
    """Nodes in page order; node 0 is the page. Inline elements without attribute names belong to their block."""
    nodes = [Node("#page", -1, 0)]
    open_: list[tuple[str, int]] = [("#page", 0)]
    at, end = 0, len(page)

    def close(tags: tuple[str, ...], walls: frozenset) -> None:
        for i in range(len(open_) - 1, 0, -1):
            if open_[i][0] in tags:
                del open_[i:]
                return
            if open_[i][0] in walls:
                return

    def add(text: str) -> None:
        if text:
            i = open_[-1][1]
            nodes[i].parts.append(html.unescape(text) if "&" in text else text)
            if any(t == "a" for t, _ in open_[-3:]):
                nodes[i].link_chars += len(text)

    for m in iter(lambda: MARKUP.search(page, at), None):
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:-3])
            continue
        if m[1] or m[4]:
            for i in range(len(open_) - 1, 0, -1):
                if open_[i][0] == tag:
                    del open_[i:]
                    break
                if tag in INLINE and open_[i][0] not in INLINE:
                    break
            continue
        raw = m[3] if m[2] else m[6]
        if tag in ENDS_P:
            close(("p",), frozenset(("table", "#page", "button")))
        if tag in ENDS:
            for _ in range(3):
                n = len(open_)
                close(ENDS[tag], WALLS)
                if len(open_) == n:
                    break
        own = open_[-1][1]
        nodes[own].tags += 1
        if tag in ("br", "hr"):
            nodes[own].parts.append(" ")
        if tag == "a":
            nodes[own].links += 1
        if tag in VOID:
            continue
        if tag in RAW:
            low = page.find(f"</{tag}", at)
            if low < 0:
                found = re.compile(f"</{tag}", re.I).search(page, at)
                low = found.start() if found else end
            gt = page.find(">", low)
            at = end if gt < 0 else gt + 1
            continue
        names = attribute_names(raw) if "=" in raw else ()
        if tag in INLINE and not names:
            open_.append((tag, own))
            continue
        i = len(nodes)
        nodes.append(Node(tag, own, nodes[own].depth + 1, names))
        nodes[own].kids.append(i)
        nodes[own].parts.append(i)
        if not raw.endswith("/") or tag not in INLINE:
            open_.append((tag, i))
        if at >= end:
            break
    add(page[at:])
    for i in range(len(nodes) - 1, -1, -1):
        x = nodes[i]
        for t in x.parts:
            if isinstance(t, str):
                n = len(t) if not t.isspace() else 0
                x.chars += n
                x.stops += t.count(".") + t.count(",")
        if x.tag == "a":
            x.link_chars, x.links = x.chars, x.links + 1
        if x.parent >= 0:
            up = nodes[x.parent]
            for name in ("chars", "link_chars", "tags", "links", "stops"):
                setattr(up, name, getattr(up, name) + getattr(x, name))
            up.blocks += x.blocks + 1
            up.paragraphs += x.paragraphs + (x.tag == "p")
    return nodes
