"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page becomes a tree of elements (start and end tags, void elements, implied ends of p, li, td and the like). Each
block element is a node with features: its depth, the text of its subtree and the shares of it inside links, forms and
child blocks, attribute tokens, its tag, what it has beside itself, and the same of its parent. Trees boosted on the
logistic loss give the probability that a node belongs to the article.

Decoding is hierarchical. From the root down, each node is judged keep, drop or open: the choice that maximises the
summed log-odds of the text it decides over, given that a dropped node's descendants are dropped as well. So no text is
kept inside a dropped node, and no choice contradicts one above it.

The trees are grown on the driver from a small labelled table of pages that `labelled_pages` lays out (invented words,
common layouts of articles, menus, adverts, comments and the like). Pages are extracted in Arrow batches; nothing is
shuffled.

Blocks. Text is cut at block elements and line breaks, white space inside a block becomes one space, blocks are trimmed
and joined by one space in page order. Character references are decoded. Scripts, styles, templates, frames, drawings, the
insides of form fields and comments of the markup never hold text; what stands in for a script, an object or a canvas does.

Each page is parsed in time and memory in proportion to its length, and features are made for at most NODES_AT_ONCE nodes at
a time.

Defined results: null or empty html gives an empty text; a null page_id or url stays null; markup that ends early counts as ending there; repeated rows
repeat; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from parley.llm.common import table

# Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose content is raw text that no reader sees as text.
RAW = frozenset("script style template iframe svg title textarea select option".split())
# Elements that part blocks of text.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul br".split()
)
# A start tag of the first kind ends an open element of the second kinds, up to the nearest of the third.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tr", "td", "th", "tbody", "thead", "tfoot"}, {"table"}),
    "body": ({"head"}, set()),
}
#: Block elements that end an open paragraph.
_ENDS_P = BLOCKS - {"br", "button"}
#: Nodes whose features are held at once.
NODES_AT_ONCE = 8192

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(?:![^>]*|\?[^>]*)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_ATTRIBUTE = re.compile(r"([A-Za-z_:][-A-Za-z0-9_:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_TOKEN = re.compile(r"[a-z]+|[A-Z][a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("children", "depth", "end", "index", "link", "name", "own", "parent", "place", "start", "tokens", "total")

    def __init__(self, name: str, parent: Node | None, tokens: tuple[str, ...]):
        self.name, self.parent, self.tokens = name, parent, tokens
        self.depth = parent.depth + 1 if parent else 0
        self.children: list[Node] = []
        self.own = self.link = self.total = 0
        self.start = self.end = 0  # its texts: a range of the page's
        self.index = 0  # its place among the page's nodes


@dataclass
class Page:
    nodes: list[Node]  # block elements in page order; the first is the root
    texts: list[tuple[str, Node, bool]]  # decoded text, its nearest block, whether a block begins before it


def attribute_tokens(source: str) -> tuple[str, ...]:
    """Words of the attributes that name a purpose."""
    if "=" not in source:
        return ()
    out: list[str] = []
    for name, a, b, c in _ATTRIBUTE.findall(source):
        if name.lower() in ("class", "id", "role", "itemprop", "aria-label", "data-role", "name", "property"):
            out += [x.lower() for x in _TOKEN.findall(a or b or c)]
        elif name.lower() in ("hidden", "aria-hidden"):
            out.append("hidden")
    return tuple(out)


class Open:
    """The open elements of a page, each with its nearest block, and where each name is open: every question about them is
    answered without a walk, so that a page costs time in proportion to its length."""

    def __init__(self, root: Node):
        self.stack: list[tuple[str, Node]] = [("#root", root)]
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = [0]  # places of blocks other than paragraphs

    @property
    def block(self) -> Node:
        return self.stack[-1][1]

    def push(self, name: str, block: Node) -> None:
        k = len(self.stack)
        self.stack.append((name, block))
        self.at.setdefault(name, []).append(k)
        if name in BLOCKS and name != "p":
            self.blocks.append(k)

    def pop(self) -> tuple[str, Node]:
        name, block = self.stack.pop()
        k = len(self.stack)
        if k:
            self.at[name].pop()
        if self.blocks and self.blocks[-1] == k:
            self.blocks.pop()
        return name, block

    def last(self, names) -> int:
        """The place of the innermost open element of one of the names; 0 for none."""
        return max((self.at[x][-1] for x in names if self.at.get(x)), default=0)

    def first_after(self, names, place: int) -> int:
        """The place of the outermost open element of one of the names inside a place; 0 for none."""
        found = [self.at[x][k] for x in names if self.at.get(x) and (k := bisect_right(self.at[x], place)) < len(self.at[x])]
        return min(found, default=0)


def parse(source: str) -> Page:
    """The block elements of a page with their texts."""
    root = Node("#root", None, ())
    nodes, texts = [root], []
    opened = Open(root)
    at, links, fresh = 0, 0, True
    last = source.rfind(">") + 1  # no tag ends after that

    def add(piece: str) -> None:
        nonlocal fresh
        if not piece:
            return
        block = opened.block
        shown = html.unescape(piece) if "&" in piece else piece
        texts.append((shown, block, fresh))
        n = len(shown.strip())
        block.own += n
        if links:
            block.link += n
        fresh = False

    def close(to: int) -> None:
        """Closes the element at a place and all inside it; nothing at place 0."""
        nonlocal links, fresh
        while to and len(opened.stack) > to:
            name, block = opened.pop()
            if name == "a":
                links -= 1
            if name in BLOCKS:
                block.end, fresh = len(texts), True

    while m := _TAG.search(source, at, last):
        add(source[at : m.start()])
        at = m.end()
        end_tag, name = m[1], m[2]
        if name is None:
            continue
        name = name.lower()
        if end_tag:
            place = opened.last((name,))
            if name in BLOCKS or place > opened.blocks[-1]:  # an inline end tag does not end a block
                close(place)
            continue
        foreign = name == "svg" or opened.last(("svg", "math")) > 0
        empty = m[3].endswith("/") and foreign  # elsewhere a slash closes nothing; it may end an unquoted value
        if name in RAW and not empty:
            end = re.compile(rf"</{name}\s*+>", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        if name in ("br", "hr"):
            fresh = True
        if name in VOID or empty:
            continue
        if name in _ENDS_P and opened.block.name == "p":
            close(opened.last(("p",)))
        if name in IMPLIED:
            ends, limits = IMPLIED[name]
            limit = opened.last(limits)
            # a row or a body of rows ends all that is open in the table, anything else the innermost
            close(opened.first_after(ends, limit) if name in ("tr", "tbody") else end if (end := opened.last(ends)) > limit else 0)
        block = opened.block
        if name in BLOCKS:
            node = Node(name, block, attribute_tokens(m[3]))
            node.start = node.end = len(texts)
            node.place, node.index = len(block.children), len(nodes)
            block.children.append(node)
            nodes.append(node)
            block, fresh = node, True
        elif name == "a":
            links += 1
        opened.push(name, block)
    tail = source[at:]
    cut = re.search(r"</?[A-Za-z]|<!--", tail)  # a tag that the page's end cuts off
    add(tail[: cut.start()] if cut else tail)
    close(1)
    root.end = len(texts)
    return Page(nodes, texts)


# Features.

# Attribute words and tags that get a column each.
TOKENS = (
    "nav", "menu", "navbar", "breadcrumb", "breadcrumbs", "header", "masthead", "banner", "top", "footer", "bottom", "copyright", "legal", "sidebar", "side", "aside", "widget", "rail", "ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo",
    "promotion", "cookie", "consent", "notice", "gdpr", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "form", "search", "login", "share", "social", "related", "recommended", "more", "comment", "comments", "reply", "replies", "discussion",
    "respond", "disqus", "thread", "review", "reviews", "article", "post", "entry", "story", "content", "main", "body", "text", "copy", "page", "blog", "news", "wrapper", "container", "title", "headline", "byline", "author", "meta", "tags", "pagination", "skip", "hidden", "toolbar", "teaser", "outbrain", "user", "links",
)
TAGS = (
    "#root", "html", "body", "main", "article", "section", "div", "p", "h1", "h2", "h3", "h4", "ul", "ol", "li", "nav", "header", "footer", "aside", "form", "fieldset", "button", "dialog", "blockquote", "pre", "table", "tr", "td", "th", "figure", "figcaption", "dl", "dt", "dd", "details", "address",
)
_TOKEN_AT = {t: k for k, t in enumerate(TOKENS)}
_TAG_AT = {t: k for k, t in enumerate(TAGS)}
N_BASE = 16
N_OWN = N_BASE + len(TAGS) + len(TOKENS)
#: Columns of a node: its own, then its parent's tag and words, then the words and tags of all above.
N_COLUMNS = N_OWN + 2 * (len(TAGS) + len(TOKENS))


def parents(pages: list[Page]) -> tuple[np.ndarray, np.ndarray]:
    """The parent of each node of all pages, a root's being itself, and the place of each page's root."""
    roots = np.concatenate([[0], np.cumsum([len(p.nodes) for p in pages])])[:-1]
    parent = [at + (x.parent.index if x.parent else 0) for p, at in zip(pages, roots.tolist(), strict=True) for x in p.nodes]
    return np.array(parent, np.int64), roots


_MARKS = len(TAGS) + len(TOKENS)
_MARK_BYTES = -(-_MARKS // 8)


def marks(node: Node) -> int:
    """The tag and the attribute words of a node, a bit each."""
    out = 1 << _TAG_AT[node.name] if node.name in _TAG_AT else 0
    for t in node.tokens:
        if t in _TOKEN_AT:
            out |= 1 << (len(TAGS) + _TOKEN_AT[t])
    return out


def _unpacked(bits: list[int]) -> np.ndarray:
    flat = np.frombuffer(b"".join(x.to_bytes(_MARK_BYTES, "little") for x in bits), np.uint8).reshape(len(bits), _MARK_BYTES)
    return np.unpackbits(flat, axis=1, bitorder="little")[:, :_MARKS]


def feature_blocks(pages: list[Page], at_once: int = NODES_AT_ONCE) -> Iterator[np.ndarray]:
    """One row for each block element of each page, at most `at_once` rows at a time."""
    nodes = [x for p in pages for x in p.nodes]
    n = len(nodes)
    parent, roots = parents(pages)
    root = np.repeat(roots, [len(p.nodes) for p in pages])
    n_texts = np.repeat([max(1, len(p.texts)) for p in pages], [len(p.nodes) for p in pages])
    # sums over subtrees: children come after their parents
    sums = [[x.own, x.link, 1, x.name == "p", x.name in ("form", "button", "fieldset")] for x in nodes]
    own_marks, above = [marks(x) for x in nodes], [0] * n
    up = parent.tolist()
    for k in range(n - 1, -1, -1):
        if up[k] != k:
            into, x = sums[up[k]], sums[k]
            for j in range(5):
                into[j] += x[j]
    for k in range(n):
        if up[k] != k:
            above[k] = above[up[k]] | own_marks[up[k]]
    total, linked, count, paragraphs, forms = np.array(sums, float).reshape(n, 5).T
    own = np.array([x.own for x in nodes], float)
    depth = np.array([x.depth for x in nodes], float)
    siblings = np.array([len(x.parent.children) if x.parent else 1 for x in nodes], float)
    place = np.array([x.place if x.parent else 0 for x in nodes], float)
    start = np.array([x.start for x in nodes], float)
    base = [
        depth, np.log1p(own), np.log1p(total), total / np.maximum(total[root], 1), linked / np.maximum(total, 1), own / np.maximum(total, 1), np.log1p(total / count),
        np.log1p(count), paragraphs / count, np.minimum(forms, 5), siblings, place / np.maximum(siblings - 1, 1),
        total / np.maximum(total[parent], 1), np.log1p(total[parent]), linked[parent] / np.maximum(total[parent], 1), start / n_texts,
    ]
    for a in range(0, n, at_once):
        b = min(n, a + at_once)
        out = np.empty((b - a, N_COLUMNS), np.float32)
        out[:, :N_BASE] = np.stack([x[a:b] for x in base], axis=1)
        out[:, N_BASE:N_OWN] = _unpacked(own_marks[a:b])
        out[:, N_OWN : N_OWN + _MARKS] = _unpacked([own_marks[p] for p in up[a:b]])
        out[:, N_OWN + _MARKS :] = _unpacked(above[a:b])
        yield out


def features(pages: list[Page]) -> np.ndarray:
    """One row for each block element of each page, all at once."""
    return np.concatenate(list(feature_blocks(pages)))


# Boosted trees.


@dataclass
class Trees:
    """Complete binary trees of one depth, as arrays: column and cut of each inner node, value of each leaf."""

    column: np.ndarray  # trees x inner
    cut: np.ndarray
    value: np.ndarray  # trees x leaves
    start: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        out = np.full(len(x), self.start)
        depth = int(np.log2(self.value.shape[1]))
        for column, cut, value in zip(self.column, self.cut, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, column[at]] > cut[at])
            out += value[at - (len(value) - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, n_trees: int = 80, depth: int = 5, rate: float = 0.2, l2: float = 1.0, bins: int = 16) -> Trees:
    """Gradient boosting on the logistic loss with Newton leaves; cuts are quantiles of each column."""
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) if x[:, k].any() else np.zeros(0) for k in range(x.shape[1])]
    cuts = [np.unique(np.append(c, 0.5)) if len(np.unique(x[:, k])) == 2 else c for k, c in enumerate(cuts)]
    used = [k for k, c in enumerate(cuts) if len(c)]
    code = np.stack([np.searchsorted(cuts[k], x[:, k], "left") for k in used], axis=1)  # code > j exactly where x > cut j
    most = max(len(cuts[k]) for k in used) + 1
    p0 = np.clip((weight * y).sum() / weight.sum(), 0.01, 0.99)
    start = float(np.log(p0 / (1 - p0)))
    score = np.full(len(y), start)
    inner, leaves = 2**depth - 1, 2**depth
    column, cut, value = np.zeros((n_trees, inner), np.int64), np.full((n_trees, inner), np.inf), np.zeros((n_trees, leaves))
    offset = np.arange(len(used)) * most
    for t in range(n_trees):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (y - p), weight * np.maximum(p * (1 - p), 1e-6)
        at = np.zeros(len(y), np.int64)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            if len(rows) >= 2:
                flat = (code[rows] + offset).ravel()
                gs = np.bincount(flat, np.repeat(g[rows], len(used)), len(used) * most).reshape(len(used), most).cumsum(axis=1)
                hs = np.bincount(flat, np.repeat(h[rows], len(used)), len(used) * most).reshape(len(used), most).cumsum(axis=1)
                G, H = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + l2) + (G - gs) ** 2 / (H - hs + l2) - G**2 / (H + l2)
                gain[(hs < 1e-3) | (H - hs < 1e-3)] = 0
                k, j = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[k, j] > 1e-6 and j < len(cuts[used[k]]):
                    column[t, node], cut[t, node] = used[k], cuts[used[k]][j]
            at[rows] = 2 * node + 1 + (x[rows, column[t, node]] > cut[t, node])
        leaf = at - inner
        gl, hl = np.bincount(leaf, g, leaves), np.bincount(leaf, h, leaves)
        value[t] = rate * gl / (hl + l2)
        score += value[t][leaf]
    return Trees(column, cut, value, start)


# The labelled table.


def labelled_pages(pages: int = 400, seed: int = 5) -> list[tuple[str, str]]:
    """(html, main text) of invented pages in common layouts."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    chance = lambda p: rng.random() < p

    def words(a: int, b: int) -> str:
        n = int(rng.integers(a, b + 1))
        out = " ".join("".join(pick("abcdefghijklmnoprstuvwéüñ") for _ in range(int(rng.integers(2, 9)))) for _ in range(n))
        return out.capitalize() + pick([".", ".", "", "!", "?"])

    def attrs(names: list[str]) -> str:
        if chance(0.2):
            return ""
        name = pick(names) + pick(["", "", "-" + pick(["box", "area", "wrap", "block", "1", "inner"])])
        return f' {pick(["class", "class", "id"])}="{name}"' + pick(["", ' data-x="1"'])

    def link_list(tag: str = "ul") -> str:
        return f"<{tag}>" + "".join(f'<li><a href="/{k}">{words(1, 3)}</a></li>' for k in range(int(rng.integers(2, 9)))) + f"</{tag}>"

    def junk(kind: str) -> str:
        if kind == "menu":
            return pick([f"<nav{attrs(['nav', 'menu', 'main-nav'])}>{link_list()}</nav>", f"<div{attrs(['menu', 'navbar', 'breadcrumbs', 'nav'])}>{link_list()}</div>", f"<ul{attrs(['menu', 'nav-links'])}>" + link_list()[4:]])
        if kind == "header":
            return f"<header{attrs(['header', 'site-header', 'masthead', 'banner'])}>{pick(['', '<h1>' + words(1, 3) + '</h1>'])}<p>{words(2, 8)}</p>{pick(['', link_list()])}</header>"
        if kind == "footer":
            inner = pick([f"&copy; {words(2, 8)} &middot; {words(2, 10)}", f"<p>{words(3, 20)}</p>{link_list()}", f"<div>{words(3, 12)}</div>"])
            return pick([f"<footer{attrs(['footer', 'site-footer'])}>{inner}</footer>", f"<div class=\"{pick(['footer', 'page-footer', 'copyright'])}\">{inner}</div>"])
        if kind == "aside":
            inner = pick([f"<h3>{words(1, 4)}</h3>{link_list()}", f"<p>{words(5, 40)}</p>", f"<h2>{words(1, 3)}</h2><p>{words(4, 25)}</p><p>{words(4, 25)}</p>"])
            return pick([f"<aside{attrs(['sidebar', 'widget'])}>{inner}</aside>", f"<div class=\"{pick(['sidebar', 'side', 'widget', 'related', 'rail right', 'recommended'])}\">{inner}</div>"])
        if kind == "ad":
            return f"<{(t := pick(['div', 'div', 'section', 'p']))} class=\"{pick(['ad', 'ads', 'advert', 'ad-banner', 'sponsored', 'promo', 'advertisement'])}\">{pick(['', '<p>' * (t != 'p')])}{words(3, 30)}</{t}>"
        if kind == "notice":
            return f"<{(t := pick(['div', 'div', 'section', 'dialog']))} {pick(['class', 'id'])}=\"{pick(['cookie', 'cookie-notice', 'consent', 'gdpr-banner', 'notice', 'alert', 'popup', 'newsletter', 'subscribe'])}\"><p>{words(5, 30)}</p>{pick(['', '<button>' + words(1, 2) + '</button>'])}</{t}>"
        if kind == "form":
            return f"<form{attrs(['search', 'login', 'signup', 'contact'])}><label>{words(1, 4)}</label><input type=\"text\"><p>{words(2, 12)}</p><button>{words(1, 2)}</button></form>"
        if kind == "share":
            return f"<div class=\"{pick(['share', 'social', 'tags', 'share-buttons', 'toolbar'])}\">{pick([link_list(), words(1, 6)])}</div>"
        # readers' comments: whole sentences in paragraphs
        each = [f"<{(t := pick(['div', 'li', 'article']))} class=\"{pick(['comment', 'comment-body', 'reply', 'comment user'])}\"><p>{words(1, 2)}</p><p>{words(4, 50)}</p></{t}>" for _ in range(int(rng.integers(1, 6)))]
        return f"<{(t := pick(['section', 'div', 'div', 'ol']))} {pick(['class', 'id'])}=\"{pick(['comments', 'comment-list', 'discussion', 'replies', 'responses comments', 'disqus_thread'])}\">{pick(['', '<h3>' + words(1, 3) + '</h3>'])}{''.join(each)}</{t}>"

    kinds = ["menu", "header", "footer", "aside", "ad", "notice", "form", "share", "comments"]
    out = []
    for _ in range(pages):
        main: list[str] = []

        def text(a: int, b: int, main: list[str] = main) -> str:
            t = words(a, b)
            main.append(t)
            return t

        title = words(3, 12)
        parts = []
        if chance(0.85):
            main.append(title)
            parts.append(pick([f"<h1>{title}</h1>", f"<header><h1>{title}</h1></header>", f'<h1 class="title">{title}</h1>', f"<h2>{title}</h2>"]))
        small = chance(0.35)
        for _ in range(int(rng.integers(1, 4)) if small else int(rng.integers(1, 14))):
            kind = rng.random()
            if kind < 0.68 or small:
                t = text(1, 8) if chance(0.5 if small else 0.15) else text(8, 120)
                parts.append(pick([f"<p>{t}</p>", f"<p>{t}</p>", f"<p>{t}", f"<div>{t}</div>" if chance(0.2) else f"<p>{t}</p>", f"<p><b>{t}</b></p>"]))
                if chance(0.1):
                    parts.append(f"<p><b>{text(2, 30)}<br>")
            elif kind < 0.78:
                parts.append(f"<{(h := pick(['h2', 'h3']))}>{text(1, 8)}</{h}>")
            elif kind < 0.86:
                parts.append(f"<{(t := pick(['ul', 'ol']))}>" + "".join(f"<li>{text(3, 25)}</li>" for _ in range(int(rng.integers(2, 6)))) + f"</{t}>")
            elif kind < 0.91:
                parts.append(f"<blockquote><p>{text(5, 40)}</p></blockquote>")
            elif kind < 0.94:
                parts.append("<table>" + "".join(f"<tr><td>{text(1, 5)}</td><td>{text(1, 8)}</td></tr>" for _ in range(3)) + "</table>")
            elif kind < 0.96:
                parts.append(f"<pre>{text(3, 30)}</pre>")
            else:
                parts.append(junk(pick(["ad", "share", "aside", "form", "notice"])))
        inside = "".join(parts)
        trailing = junk("comments") if chance(0.15) else ""
        article = pick(
            [
                f"<article>{inside}{trailing}</article>", f"<article class=\"{pick(['post', 'entry', 'story'])}\"><div class=\"{pick(['content', 'entry-content', 'body'])}\">{inside}</div>{trailing}</article>",
                f"<main>{inside}{trailing}</main>", f"<main><article>{inside}</article>{trailing}</main>", f"<div class=\"{pick(['content', 'main', 'post', 'article-body', 'story'])}\">{inside}{trailing}</div>",
                f"<div id=\"{pick(['content', 'main'])}\"><div class=\"{pick(['post', 'text', 'entry'])}\">{inside}</div>{trailing}</div>", f"<div>{inside}</div>{trailing}", f"<article>{inside}</article>", f"<article>{inside}</article>",
            ]
        )
        before = [junk(pick(["menu", "header", "ad", "notice", "form", "aside", "menu"])) for _ in range(int(rng.integers(0, 5)))]
        after = [junk(pick(kinds)) for _ in range(int(rng.integers(0, 5)))] + [junk("footer")] * chance(0.8)
        page = "".join([*before, article, *after])
        if chance(0.3):
            page = f"<div class=\"{pick(['wrapper', 'container', 'page'])}\">{page}</div>"
        out.append((f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>{page}</body></html>", " ".join(main)))
    return out


def node_labels(page: Page, main: str) -> tuple[np.ndarray, np.ndarray]:
    """Whether most of each block's subtree is main text, and its weight (0: no text)."""
    kept, at = np.zeros(len(page.texts)), 0
    flat = main.replace(" ", "")
    for k, (t, _, _) in enumerate(page.texts):
        want = "".join(t.split())
        if want and flat.startswith(want, at):
            kept[k], at = 1, at + len(want)
    size = np.array([len(t.strip()) for t, _, _ in page.texts], float)
    both, whole = np.concatenate([[0], np.cumsum(kept * size)]), np.concatenate([[0], np.cumsum(size)])
    good = np.array([both[n.end] - both[n.start] for n in page.nodes])
    every = np.array([whole[n.end] - whole[n.start] for n in page.nodes])
    share = good / np.maximum(every, 1)
    weight = np.where((every > 0) & ((share > 0.95) | (share < 0.05)), 1.0, 0.0)
    return (share > 0.5).astype(float), weight


@lru_cache(maxsize=1)
def trained() -> Trees:
    """The trees, from the labelled table."""
    rows = []
    for source, main in labelled_pages():
        page = parse(source)
        y, weight = node_labels(page, main)
        some = weight > 0
        rows.append((features([page])[some], y[some], weight[some]))
    return boost(*(np.concatenate(x) for x in zip(*rows, strict=True)))


# Decoding.


def kept_nodes(page: Page, logit: np.ndarray) -> list[bool]:
    """For each block, whether its own text is kept: the best consistent choice.

    A node is open, or dropped with all below it. Its log-odds, weighed by its own text, are gained where it is open and lost
    where it is dropped; a node without text of its own speaks once for what is below it. The best of both is found from
    the leaves up, and taken from the root down.
    """
    parent = [x.parent.index if x.parent else 0 for x in page.nodes]
    value = [v * (math.log1p(x.own) if x.own else 1.0) for v, x in zip(np.clip(logit, -6, 6).tolist(), page.nodes, strict=True)]
    opened, dropped = list(value), [-v for v in value]
    for k in range(len(parent) - 1, 0, -1):
        opened[parent[k]] += max(opened[k], dropped[k])
        dropped[parent[k]] += dropped[k]
    keep = [True] * len(parent)
    for k in range(1, len(parent)):
        keep[k] = keep[parent[k]] and opened[k] >= dropped[k]
    return keep


def _page_text(page: Page, logit: np.ndarray) -> str:
    keep = kept_nodes(page, logit)
    blocks: list[list[str]] = []
    last = None
    for t, node, fresh in page.texts:
        # text right below a page's outermost elements is judged by their own log-odds
        if keep[node.index] and not (node.name in ("#root", "html", "body") and logit[node.index] < 0):
            if fresh or last is not node or not blocks:
                blocks.append([])
            blocks[-1].append(t)
            last = node
        else:
            last = None
    joined = (_SPACE.sub(" ", "".join(b)).strip() for b in blocks)
    return " ".join(b for b in joined if b)


def main_texts(sources: Iterable[str | None], trees: Trees, at_once: int = NODES_AT_ONCE) -> Iterator[str]:
    """The main text of each page. Pages are taken together until they have `at_once` nodes."""
    pages: list[Page] = []
    held = 0

    def extracted() -> Iterator[str]:
        logit = np.concatenate([trees.logit(x) for x in feature_blocks(pages, at_once)])
        at = 0
        for page in pages:
            yield _page_text(page, logit[at : at + len(page.nodes)]) if page.texts else ""
            at += len(page.nodes)

    for source in sources:
        pages.append(parse(source or ""))
        held += len(pages[-1].nodes)
        if held >= at_once:
            yield from extracted()
            pages, held = [], 0
    if pages:
        yield from extracted()


def main_text(source: str | None, trees: Trees) -> str:
    return next(main_texts([source], trees))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages."""
    shared = pages.sparkSession.sparkContext.broadcast(trained())  # a few thousand numbers

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {name: batch.column(batch.schema.get_field_index(name)) for name in ("page_id", "url", "html")}
            texts = list(main_texts((x.as_py() for x in column["html"]), shared.value))
            yield pa.RecordBatch.from_arrays(
                [column["page_id"], column["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    return pages.select("page_id", "url", "html").mapInArrow(rows, "page_id long, url string, text string, n_chars long")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
