"""Main text of web pages by gradient-boosted trees over the nodes of the DOM.

The trees tell three kinds of node apart: all of its text is main text, none is, or some. Features are the subtree's
density of text, links and tags, the words of attributes (own and inherited), depth, and statistics of siblings. A
page is then decoded from the root down by dynamic programming over the tree: below a node that is all main or
none, everything is the same, so ancestor and descendant never contradict each other; only below a mixed node do
children choose anew.

The trees are trained here, on pages that this module makes up from a seed: layouts of many kinds whose text is
labelled by construction.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.llm.common import texts, tune
from terrasift.llm.dom_tree import INLINE, NEVER_TEXT, Node, parsed

MAIN, NONE, MIXED = 0, 1, 2
TRAIN_PAGES, ROUNDS, DEPTH, BINS, RATE = 320, 24, 3, 16, 0.3
TAGS = ("p", "div", "li", "ul", "ol", "h1", "h2", "h3", "nav", "header", "footer", "aside", "article", "section", "main", "form", "table", "tr", "td", "blockquote", "pre", "body", "html", "figure", "span", "a", "dl", "dialog", "menu", "label")
MOST_NAMES = 120

# Training pages

_SYLLABLES = "the on er th re in ti at or an en es ou ed is it al ar st to nt ng se ha as io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split()


class PageMaker:
    """Pages with labelled blocks. Every block of text is a span of the page whose truth is known."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.r
        out = ["".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
        for i in range(len(out)):
            if r.random() < 0.12:
                out[i] += r.choice(",.")
        if r.random() < 0.1:
            out = [w + r.choice(("###", "%%%", "!!")) for w in out]
        return " ".join(out).capitalize() + r.choice((".", ".", "", "&hellip;"))

    def attr(self, names: list[str], chance: float = 0.85) -> str:
        r = self.r
        if r.random() > chance:
            return ""
        name = r.choice(names)
        extra = f" {r.choice(('wide', 'x', 'row', 'box', 'inner', 'col'))}" if r.random() < 0.3 else ""
        return f' {r.choice(("class", "class", "id"))}="{name}{extra}"'

    def links(self, n: int) -> str:
        return "".join(f'<li><a href="/{i}">{self.words(1, 3)}</a></li>' for i in range(n))

    # Each returns HTML; `y` marks main text with data-main, which the parser's features don't see.
    def paragraph(self, y: int) -> str:
        r = self.r
        text = self.words(1, 90) if r.random() < 0.8 else self.words(1, 4)
        if r.random() < 0.2:
            text = f"<b>{text}" + ("</b>" if r.random() < 0.5 else "<br>")
        if r.random() < 0.15:
            text += f' <a href="#">{self.words(1, 4)}</a> {self.words(1, 20)}'
        return f'<p data-main="{y}">{text}' + ("</p>" if r.random() < 0.8 else "")

    def body_blocks(self) -> str:
        r, out = self.r, []
        for _ in range(r.randint(1, 12)):
            kind = r.random()
            if kind < 0.78:
                out.append(self.paragraph(1))
            elif kind < 0.86:
                out.append(f'<h{(n := r.randint(2, 3))} data-main="1">{self.words(1, 8)}</h{n}>')
            elif kind < 0.91:
                out.append('<ul data-main="1">' + "".join(f'<li data-main="1">{self.words(3, 20)}</li>' for _ in range(r.randint(2, 6))) + "</ul>")
            elif kind < 0.94:
                out.append(f'<blockquote data-main="1">{self.paragraph(1)}</blockquote>')
            elif kind < 0.96:
                out.append('<table data-main="1">' + "".join(f'<tr data-main="1"><td data-main="1">{self.words(1, 3)}</td><td data-main="1">{self.words(1, 3)}</td></tr>' for _ in range(3)) + "</table>")
            elif kind < 0.98:
                out.append(f'<pre data-main="1">{self.words(5, 30)}</pre>')
            else:
                out.append(self.advert())
        return "".join(out)

    def advert(self) -> str:
        t = self.r.choice(("div", "div", "aside", "section"))
        inner = self.words(2, 25) if self.r.random() < 0.6 else self.paragraph(0)
        return f'<{t} data-main="0"{self.attr(["ad", "ads", "advert", "advertisement", "banner", "sponsored", "promo", "ad-slot"], 1)}>{inner}</{t}>'

    def menu(self) -> str:
        r = self.r
        t = r.choice(("nav", "nav", "div", "ul"))
        links = self.links(r.randint(2, 12))
        names = ["nav", "menu", "navbar", "navigation", "topnav", "breadcrumbs", "main-menu"]
        if t == "ul":
            return f'<ul data-main="0"{self.attr(names, 1)}>{links}</ul>'
        return f'<{t} data-main="0"{self.attr(names, 0.5 if t == "nav" else 1)}><ul data-main="0">{links}</ul></{t}>'

    def notice(self) -> str:
        r = self.r
        return f'<div data-main="0"{self.attr(["cookie-notice", "cookie", "consent", "notice", "gdpr-banner", "alert", "newsletter", "subscribe", "popup", "modal", "disclaimer", "warning", "paywall"], 1)}>{self.paragraph(0)}<button>OK</button></div>'

    def form(self) -> str:
        r = self.r
        return f'<form data-main="0"{self.attr(["search", "login", "signup", "contact-form", "subscribe"], 0.7)}><label data-main="0" class="label">{self.words(1, 4)}</label><input name="q"><p data-main="0">{self.words(2, 15)}</p><select><option>{self.words(1, 2)}</option></select><button>{self.words(1, 2)}</button></form>'

    def comments(self) -> str:
        r = self.r
        each = "".join(f'<div data-main="0"{self.attr(["comment", "reply", "comment-body"], 0.8)}><h4 data-main="0">{self.words(1, 3)}</h4>{self.paragraph(0)}</div>' for _ in range(r.randint(1, 6)))
        t = r.choice(("section", "div", "div", "ol"))
        return f'<{t} data-main="0"{self.attr(["comments", "comment-list", "discussion", "responses", "disqus", "user-comments", "reader-comments"], 1)}><h3 data-main="0">{self.words(1, 3)}</h3>{each}</{t}>'

    def sidebar(self) -> str:
        r = self.r
        t = r.choice(("aside", "aside", "div"))
        inner = f'<h3 data-main="0">{self.words(1, 4)}</h3>' + (f'<ul data-main="0">{self.links(r.randint(2, 8))}</ul>' if r.random() < 0.6 else self.paragraph(0))
        return f'<{t} data-main="0"{self.attr(["sidebar", "side", "widget", "related", "rail", "recommended", "teaser", "share", "social", "tags"], 0.5 if t == "aside" else 1)}>{inner}</{t}>'

    def header(self) -> str:
        r = self.r
        t = r.choice(("header", "header", "div"))
        inner = f'<h{(n := r.choice((1, 2)))} data-main="0">{self.words(1, 4)}</h{n}>' if r.random() < 0.5 else f'<p data-main="0">{self.words(1, 12)}</p>'
        return f'<{t} data-main="0"{self.attr(["header", "site-header", "masthead", "topbar", "logo", "branding"], 0.4 if t == "header" else 1)}>{inner}{self.menu() if r.random() < 0.5 else ""}</{t}>'

    def footer(self) -> str:
        r = self.r
        t = r.choice(("footer", "footer", "div"))
        inner = f'&copy; {self.words(1, 12)} &middot; {self.words(1, 6)}' if r.random() < 0.6 else f'<p data-main="0">{self.words(2, 30)}</p><ul data-main="0">{self.links(3)}</ul>'
        return f'<{t} data-main="0"{self.attr(["footer", "site-footer", "copyright", "legal", "bottom"], 0.3 if t == "footer" else 1)}>{inner}</{t}>'

    def article(self) -> str:
        r = self.r
        title = f'<h1 data-main="1">{self.words(2, 12)}</h1>' if r.random() < 0.85 else ""
        if title and r.random() < 0.15:
            title = f'<header data-main="1">{title}</header>'
        kind = r.random()
        names = ["content", "article", "post", "entry-content", "article-body", "story", "main", "main-content", "text", "page-content"]
        inner = title + self.body_blocks()
        if kind < 0.6:
            return f'<article data-main="2"{self.attr(names, 0.3)}>{inner}</article>'
        if kind < 0.7:
            return f"<main data-main=\"2\"{self.attr(names, 0.3)}>{inner}</main>"
        if kind < 0.95:
            return f'<{(t := r.choice(("div", "div", "section", "td")))} data-main="2"{self.attr(names, 1)}>{inner}</{t}>'.replace("<td", "<div").replace("</td", "</div") if kind < 0.85 else f'<main data-main="2"><article data-main="2">{inner}</article></main>'
        return inner

    def page(self) -> str:
        r = self.r
        maybe = lambda f, p: f() if r.random() < p else ""
        before = [maybe(self.header, 0.4), maybe(self.menu, 0.6), maybe(self.notice, 0.25), maybe(self.advert, 0.45), maybe(self.form, 0.15), maybe(self.sidebar, 0.15)]
        after = [maybe(self.advert, 0.2), maybe(self.comments, 0.3), maybe(self.sidebar, 0.3), maybe(self.form, 0.15), maybe(self.notice, 0.15)]
        r.shuffle(before)
        r.shuffle(after)
        inner = "".join(before) + self.article() + "".join(after) + maybe(self.footer, 0.8)
        if r.random() < 0.35:
            inner = f'<div data-main="2"{self.attr(["container", "wrapper", "page", "site", "layout"], 0.9)}>{inner}</div>'
        return f"<html><head><title>{self.words(1, 5)}</title><style>p{{margin:0}}</style></head><body>{inner}</body></html>"


def truths(nodes: list[Node], marks: list[int | None]) -> list[int]:
    """MAIN, NONE or MIXED of each node from the marks of its subtree's text."""
    seen = [[0, 0] for _ in nodes]
    for i in range(len(nodes) - 1, -1, -1):
        if marks[i] in (0, 1) and any(isinstance(p, str) and p.strip() for p in nodes[i].parts):
            seen[i][marks[i]] += 1
        if nodes[i].parent >= 0:
            for k in (0, 1):
                seen[nodes[i].parent][k] += seen[i][k]
    return [MIXED if a and b else MAIN if b else NONE for a, b in seen]


# Features


def names_of(nodes: list[Node]) -> set[str]:
    return {w for x in nodes for w in x.names}


class Features:
    def __init__(self, names: list[str]) -> None:
        self.tag = {t: i for i, t in enumerate(TAGS)}
        self.name = {w: i for i, w in enumerate(names)}
        self.width = 22 + 2 * (len(TAGS) + len(names))

    def rows(self, nodes: list[Node]) -> np.ndarray:
        n, tags, names = len(nodes), len(self.tag), len(self.name)
        out = np.zeros((n, self.width), np.float32)
        total = max(1, nodes[0].chars)
        plain = []
        for i, x in enumerate(nodes):
            up = nodes[x.parent] if x.parent >= 0 else x
            kids = up.kids
            own = sum(1 for p in x.parts if isinstance(p, str) and not p.isspace())
            plain.append((
                x.depth, x.chars, x.chars / total, x.chars / (1 + x.tags), x.link_chars / (1 + x.chars), x.tags, x.blocks, x.paragraphs, x.links,
                x.stops / (1 + x.chars), len(x.kids), own, len(kids), up.chars, up.link_chars / (1 + up.chars), x.chars / (1 + up.chars), up.paragraphs,
                len(x.names), up.chars / total, up.tags, x.stops, x.tag in INLINE,
            ))
            if (t := self.tag.get(x.tag)) is not None:
                out[i, 22 + t] = 1
            # What the ancestors are is inherited, nearest first in weight of one.
            if x.parent >= 0:
                out[i, 22 + tags : 22 + 2 * tags] = np.maximum(out[x.parent, 22 : 22 + tags], out[x.parent, 22 + tags : 22 + 2 * tags])
                low = 22 + 2 * tags
                out[i, low + names :] = np.maximum(out[x.parent, low : low + names], out[x.parent, low + names :])
            for w in x.names:
                if (t := self.name.get(w)) is not None:
                    out[i, 22 + 2 * tags + t] = 1
        out[:, :22] = plain
        return out


# Gradient-boosted trees


class Boosted:
    """Softmax boosting with trees of equal depth on binned features, stored as flat arrays."""

    def __init__(self, x: np.ndarray, y: np.ndarray, kinds: int = 3) -> None:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
        used = np.flatnonzero([len(np.unique(binned[:, j])) > 1 for j in range(x.shape[1])])
        binned = binned[:, used].astype(np.int64)
        n, score = len(y), np.zeros((len(y), kinds))
        goal = np.eye(kinds)[y]
        self.feature, self.cut, self.leaf = [], [], []
        for _ in range(ROUNDS):
            p = np.exp(score - score.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            for k in range(kinds):
                g, h = p[:, k] - goal[:, k], p[:, k] * (1 - p[:, k])
                node = np.zeros(n, np.int64)
                feature, cut = [], []
                for level in range(DEPTH):
                    size = 1 << level
                    flat = (node[:, None] * len(used) + np.arange(len(used))) * BINS + binned
                    shape = (size, len(used), BINS)
                    gs = np.bincount(flat.ravel(), np.repeat(g, len(used)), size * len(used) * BINS).reshape(shape).cumsum(2)
                    hs = np.bincount(flat.ravel(), np.repeat(h, len(used)), size * len(used) * BINS).reshape(shape).cumsum(2)
                    gt, ht = gs[:, :1, -1:], hs[:, :1, -1:]
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1)
                    gain[(hs < 0.5) | (ht - hs < 0.5)] = 0
                    best = gain.reshape(size, -1).argmax(1)
                    f, c = best // BINS, best % BINS
                    feature.append(used[f])
                    cut.append([edges[used[a]][b] if b < len(edges[used[a]]) else np.inf for a, b in zip(f, c, strict=True)])
                    node = 2 * node + (binned[np.arange(n), f[node]] > c[node])
                gs, hs = np.bincount(node, g, 1 << DEPTH), np.bincount(node, h, 1 << DEPTH)
                leaf = -RATE * gs / (hs + 1)
                score[:, k] += leaf[node]
                self.feature.append(np.concatenate(feature))
                self.cut.append(np.concatenate(cut))
                self.leaf.append(leaf)
        self.kinds = kinds

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        score, rows = np.zeros((len(x), self.kinds)), np.arange(len(x))
        for t, (f, c, leaf) in enumerate(zip(self.feature, self.cut, self.leaf, strict=True)):
            node = np.zeros(len(x), np.int64)
            for level in range(DEPTH):
                at = (1 << level) - 1 + node
                node = 2 * node + (x[rows, f[at]] > c[at])
            score[:, t % self.kinds] += leaf[node]
        score -= score.max(1, keepdims=True)
        return score - np.log(np.exp(score).sum(1, keepdims=True))


class Extractor:
    def __init__(self, seed: int = 5, pages: int = TRAIN_PAGES) -> None:
        maker, sets, marks = PageMaker(seed), [], []
        import re

        for _ in range(pages):
            page = maker.page()
            # The marks travel as an attribute word, read here and then taken out again.
            nodes = parsed(re.sub(r'data-main="(\d)"', lambda m: f'role="zzmark{"abc"[int(m[1])]}"', page))
            own = []
            for x in nodes:
                m = [w for w in x.names if w.startswith("zzmark")]
                own.append("abc".index(m[0][-1]) if m else None)
                x.names = tuple(w for w in x.names if not w.startswith("zzmark"))
            for i, x in enumerate(nodes):
                if own[i] is None and x.parent >= 0 and own[x.parent] in (0, 1):
                    own[i] = own[x.parent]
            sets.append(nodes)
            marks.append(truths(nodes, own))
        seen = Counter(w for nodes in sets for w in names_of(nodes))
        self.features = Features([w for w, n in seen.most_common(MOST_NAMES) if n >= 3])
        x = np.concatenate([self.features.rows(nodes) for nodes in sets])
        y = np.concatenate([np.array(m) for m in marks])
        self.trees = Boosted(x, y)

    def chosen(self, nodes: list[Node], log_p: np.ndarray) -> list[int]:
        """The kind of each node of the best labelling without contradictions."""
        n = len(nodes)
        w = np.array([1.0 if any(isinstance(p, str) and not p.isspace() for p in x.parts) or x.kids else 0.0 for x in nodes])
        same = log_p[:, :2] * w[:, None]
        mixed_ = log_p[:, MIXED] * w
        for i in range(n - 1, 0, -1):
            same[nodes[i].parent] += same[i]
            mixed_[nodes[i].parent] += max(same[i, 0], same[i, 1], mixed_[i] if nodes[i].kids else -np.inf)
        out = [MIXED] * n
        for i, x in enumerate(nodes):
            above = out[x.parent] if x.parent >= 0 else MIXED
            if above != MIXED:
                out[i] = above
            else:
                best = int(same[i].argmax())
                out[i] = best if not x.kids or same[i, best] >= mixed_[i] else MIXED
        return out

    def text(self, nodes: list[Node], kinds: list[int], log_p: np.ndarray) -> str:
        blocks: list[str] = []
        run: list[str] = []

        def end() -> None:
            if line := " ".join("".join(run).split()):
                blocks.append(line)
            run.clear()

        # Depth first without recursion: pages may nest as deep as they like.
        stack: list[tuple[int, int]] = [(0, 0)]
        while stack:
            i, at = stack.pop()
            x = nodes[i]
            block = x.tag not in INLINE
            if at == 0 and block:
                end()
            if x.tag in NEVER_TEXT:
                continue
            main = kinds[i] == MAIN or kinds[i] == MIXED and log_p[i, MAIN] > log_p[i, NONE]
            while at < len(x.parts):
                part = x.parts[at]
                at += 1
                if isinstance(part, int):
                    stack.append((i, at))
                    stack.append((part, 0))
                    break
                if main:
                    run.append(part)
            else:
                if block:
                    end()
        end()
        return "\n".join(blocks)

    def extract(self, pages: list[str]) -> list[str]:
        sets = [parsed(p) for p in pages]
        if not sets:
            return []
        log_p = self.trees.log_probabilities(np.concatenate([self.features.rows(nodes) for nodes in sets]))
        out, at = [], 0
        for nodes in sets:
            own = log_p[at : at + len(nodes)]
            at += len(nodes)
            out.append(self.text(nodes, self.chosen(nodes, own), own))
        return out


_extractor: Extractor | None = None


def extractor() -> Extractor:
    """Trained once a process, from the seed: the same everywhere."""
    global _extractor
    if _extractor is None:
        _extractor = Extractor()
    return _extractor


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text (empty if none), n_chars of each row of pages (page_id, url, html).

    A null html is an empty page. Repeated rows have a result each; null ids and urls stay null; an empty table
    gives no rows; other columns are not read. Pages are decoded whole, however long or deeply nested.
    """
    tune(pages.sparkSession)
    model = pages.sparkSession.sparkContext.broadcast(extractor())

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            raw = texts(b, "html")
            out = []
            # Nodes of a few pages at a time are scored together.
            for i in range(0, len(raw), 32):
                out += model.value.extract([t.decode("utf-8", "replace") for t in raw[i : i + 32]])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(work, "page_id long, url string, text string, n_chars long")
