"""Main text of web pages by a tree-structured graphical model.

The block elements of a page form a tree; each is content or not. Unary
potentials weigh an element's tag, the words of its class and id, its own text
and its links; parent-child potentials tie neighbours, by kind of child.
Sum-product messages upward and downward give every element's marginal
probability; text of elements at one half or more is kept. Weights are fitted by
gradient ascent on the likelihood of labelled pages, where the same messages
give the expectations. All pages of a batch are one forest, worked by depth.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lattica.llm.htmllabels import labelled_pages

NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"[>\"']")
NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Never text of a page, whatever stands around.
DROPPED = frozenset("script style noscript template textarea select button svg iframe object head title canvas audio video math".split())
RAW = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe")}
#: An open element of the set is closed by the tag.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
NO_P_CLOSE = frozenset("html body caption tbody td tfoot th thead tr".split())

TAGS = {t: i for i, t in enumerate(sorted(BLOCKS))}
#: Parts of class names and ids, by what they tell.
CUES = {
    "navigation": "nav menu breadcrumb crumb pager pagination toolbar topbar tabs",
    "side": "sidebar side aside widget rail",
    "advert": "ad ads advert advertisement sponsor sponsored promo banner",
    "notice": "cookie consent gdpr notice alert popup modal overlay",
    "frame": "header footer masthead foot copyright legal colophon",
    "comment": "comment comments reply replies discussion disqus respond",
    "social": "share social related recommended more newsletter subscribe signup tags",
    "form": "form search login contact field input",
    "content": "content article post entry story body text main prose page",
    "title": "title headline heading",
}
CUE = {word: i for i, (_, parts) in enumerate(CUES.items()) for word in parts.split()}

N_TEXT, N_LINK = 6, 4
N_UNARY = len(TAGS) + len(CUES) + N_TEXT + N_LINK + 3
#: Kinds of parent-child pairs, by the child: paragraph-like, sectioning, other.
KIND = {t: 0 for t in "p h1 h2 h3 h4 h5 h6 li dd dt td th blockquote pre figcaption caption tr tbody thead ul ol dl table".split()}
KIND |= {t: 1 for t in "nav aside footer header form section article main menu fieldset dialog details".split()}


class Scanner:
    """Tags of a page, forward only: no part of it is searched twice for the same thing."""

    def __init__(self, html: str):
        self.html = html
        self.gone: dict[str, int] = {}  # no such string from there on
        self.dead: set[int] = set()  # from these quotes on no tag ends outside quotes

    def find(self, what: str, at: int) -> int:
        if at >= self.gone.get(what, len(self.html)):
            return -1
        found = self.html.find(what, at)
        if found < 0:
            self.gone[what] = at
        return found

    def _end(self, at: int) -> int:
        """Of a tag whose attributes begin at ``at``: its ``>`` outside quotes, else its first one, else -1."""
        first = self.find(">", at)
        if first < 0:
            return -1
        passed: list[int] = []
        here = at
        while True:
            stop = STOP.search(self.html, here)
            if stop and stop[0] == ">":
                return stop.start()
            if not stop or stop.start() in self.dead:
                break
            passed.append(stop.start())
            close = self.find(stop[0], stop.end())
            if close < 0:
                break
            here = close + 1
        self.dead.update(passed)
        return first

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """Start, end, closing, name and attributes of the next tag; comments and declarations have no name."""
        html = self.html
        while True:
            start = self.find("<", at)
            if start < 0:
                return None
            if html.startswith("<!--", start):
                end = self.find("-->", start + 4)
                return start, len(html) if end < 0 else end + 3, False, "", ""
            if html[start + 1 : start + 2] in ("!", "?"):
                end = self.find(">", start)
                return start, len(html) if end < 0 else end + 1, False, "", ""
            m = NAME.match(html, start)
            end = self._end(m.end()) if m else -1
            if end >= 0:
                return start, end + 1, bool(m[1]), m[2].lower(), html[m.end() : end]
            at = start + 1


CONTAINERS = ("ul", "ol", "dl", "table", "menu", "div", "section", "article")


class Stack:
    """Open elements, with the places of each tag, so that none is searched for."""

    def __init__(self, tree: Tree):
        self.tree = tree
        self.open: list[int] = []
        self.places: dict[str, list[int]] = {}

    def push(self, element: int) -> None:
        self.places.setdefault(self.tree.tags[element], []).append(len(self.open))
        self.open.append(element)

    def cut(self, place: int) -> None:
        """Close everything from ``place`` on."""
        for element in self.open[place:]:
            self.places[self.tree.tags[element]].pop()
        del self.open[place:]

    def last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def close(self, tag: str) -> None:
        place = self.last((tag,))
        if place > 0:
            self.cut(place)

    def close_for(self, tag: str) -> None:
        """What an opening ``tag`` ends: the nearest open one of its set within its list or table; a row ends cells up to its row."""
        closes = CLOSES[tag]
        floor = max(0, self.last([t for t in CONTAINERS if t not in closes]))
        place = self.last(closes if tag != "tr" else ("tr",))
        if tag == "tr" and place <= floor:
            cells = [p[bisect(p, floor)] for p in (self.places.get(t, []) for t in ("td", "th")) if p and p[-1] > floor]
            place = min(cells, default=-1)
        if place > floor:
            self.cut(place)


@dataclass
class Tree:
    """Block elements of one page in document order; ``pieces`` are (element, text, starts a block) in page order."""

    tags: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    pieces: list[tuple[int, str, int]] = field(default_factory=list)
    chars: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)


def parse(html: str) -> Tree:
    """Elements and text; tolerant of unclosed and stray tags, in time proportional to the page."""
    tree = Tree()
    stack = Stack(tree)
    scanner = Scanner(html)

    def open_(tag: str, attrs: str) -> None:
        parent = stack.open[-1] if stack.open else -1
        tree.tags.append(tag)
        tree.names.append(" ".join(a or b or c for a, b, c in NAMES.findall(attrs)).lower() if "=" in attrs else "")
        tree.parents.append(parent)
        tree.depth.append(tree.depth[parent] + 1 if parent >= 0 else 0)
        tree.chars.append(0)
        tree.linked.append(0)
        stack.push(len(tree.tags) - 1)

    def raw_end(tag: str, at: int) -> int:
        if at >= scanner.gone.get(tag, len(html) + 1):
            return len(html)
        r = RAW[tag].search(html, at)
        if not r:
            scanner.gone[tag] = at
        return r.end() if r else len(html)

    open_("body", "")
    at, block, dropped, link = 0, 0, "", False
    end = len(html)
    while at < end:
        found = scanner.next(at)
        text = html[at : found[0] if found else end]
        if text and not dropped:
            text = unescape(text) if "&" in text else text
            here = stack.open[-1]
            tree.pieces.append((here, text, block))
            n = len(text) - text.count(" ")
            tree.chars[here] += n
            if link:
                tree.linked[here] += n
        if not found:
            break
        _, at, closing, tag, attrs = found
        if not tag:
            continue
        if dropped:
            if closing and (tag == dropped or (dropped == "head" and tag == "html")) or (dropped == "head" and tag == "body"):
                dropped = ""
            elif tag in RAW and not closing:
                at = raw_end(tag, at)
            continue
        if tag in DROPPED:
            if closing:
                continue
            if tag in RAW:
                at = raw_end(tag, at)
            elif not attrs.endswith("/"):
                dropped = tag
            continue
        if tag in BLOCKS:
            block += 1
            link = link and not closing
            if closing:
                stack.close(tag)
                continue
            if tag in ("html", "body"):
                continue
            if tag not in NO_P_CLOSE and tree.tags[stack.open[-1]] == "p":
                stack.cut(len(stack.open) - 1)
            if tag in CLOSES:
                stack.close_for(tag)
            if tag not in VOID:
                open_(tag, attrs)
        elif tag == "a":
            link = not closing
        elif tag == "br":
            tree.pieces.append((stack.open[-1], " ", block))
    return tree


def _features(tree: Tree) -> list[tuple[int, int]]:
    """(element, feature) of all that hold."""
    out = []
    base_cue, base_text = len(TAGS), len(TAGS) + len(CUES)
    base_link, base_end = base_text + N_TEXT, base_text + N_TEXT + N_LINK
    stop = [False] * len(tree.tags)
    for e, text, _ in tree.pieces:
        last = text.rstrip()[-1:]
        if last:
            stop[e] = last in ".!?"
    for e, tag in enumerate(tree.tags):
        out.append((e, TAGS[tag]))
        if tree.names[e]:
            for word in set(re.split(r"[^a-z]+", tree.names[e])):
                if word in CUE:
                    out.append((e, base_cue + CUE[word]))
        n = tree.chars[e]
        out.append((e, base_text + (0 if n == 0 else min(N_TEXT - 1, 1 + int(np.log2(n) / 2)))))
        share = tree.linked[e] / n if n else 0
        out.append((e, base_link + (0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.8 else 3)))
        if n and stop[e]:
            out.append((e, base_end))
        if e == 0:
            out.append((e, base_end + 1))
        out.append((e, base_end + 2))
    return out


@dataclass
class Forest:
    """Pages side by side: features as index pairs, parents, child kinds, elements by depth."""

    row: np.ndarray
    col: np.ndarray
    parents: np.ndarray
    kind: np.ndarray
    levels: list[np.ndarray]


def forest(trees: list[Tree]) -> Forest:
    row, col, parents, kind, depth, base = [], [], [], [], [], 0
    for t in trees:
        for e, f in _features(t):
            row.append(base + e)
            col.append(f)
        parents += [base + p if p >= 0 else -1 for p in t.parents]
        kind += [KIND.get(tag, 2) for tag in t.tags]
        depth += t.depth
        base += len(t.tags)
    level = np.array(depth, np.int64)
    order = np.argsort(level, kind="stable")
    cut = np.searchsorted(level[order], np.arange(level.max() + 2 if len(level) else 1))
    return Forest(*(np.array(x, np.int64) for x in (row, col, parents, kind)), [order[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)])


@dataclass
class Model:
    unary: np.ndarray  # log-odds of content by feature
    pair: np.ndarray  # (kind, parent state, child state)


def messages(f: Forest, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Sum-product: log beliefs (n, 2), not normalised, and for each element its log pair belief (n, 2, 2) with the parent."""
    n = len(f.parents)
    local = np.zeros((n, 2))
    local[:, 1] = np.bincount(f.row, model.unary[f.col], n)
    up = np.zeros((n, 2))  # to the parent's states
    inward = local.copy()  # local and all children's messages
    for level in reversed(f.levels[1:]):
        m = np.logaddexp(*np.moveaxis(inward[level][:, None, :] + model.pair[f.kind[level]], 2, 0))
        m -= m.max(axis=1, keepdims=True)
        up[level] = m
        np.add.at(inward, f.parents[level], m)
    belief = inward.copy()
    pair = np.zeros((n, 2, 2))
    for level in f.levels[1:]:
        p = f.parents[level]
        joint = (belief[p] - up[level])[:, :, None] + model.pair[f.kind[level]]
        pair[level] = joint + inward[level][:, None, :]
        down = np.logaddexp(joint[:, 0], joint[:, 1])
        belief[level] = inward[level] + down - down.max(axis=1, keepdims=True)
    return belief, pair


def marginals(f: Forest, model: Model) -> np.ndarray:
    belief, _ = messages(f, model)
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500)))


def train(pages: list[str], steps: int = 150, rate: float = 0.1, decay: float = 2e-3) -> Model:
    """Fit on pages whose content elements carry the attribute class word ``y1`` (features don't see it)."""
    trees = [parse(p) for p in pages]
    y = np.array([int("y1" in names.split()) for t in trees for names in t.names])
    f = forest(trees)
    model = Model(np.zeros(N_UNARY), np.zeros((3, 2, 2)))
    child = np.concatenate(f.levels[1:])
    true_pair = np.zeros((len(y), 2, 2))
    true_pair[child, y[f.parents[child]], y[child]] = 1
    m1, m2 = np.zeros(N_UNARY + 12), np.zeros(N_UNARY + 12)
    w = np.zeros(N_UNARY + 12)
    for step in range(1, steps + 1):
        model = Model(w[:N_UNARY], w[N_UNARY:].reshape(3, 2, 2))
        belief, pair = messages(f, model)
        p = 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500)))
        q = np.exp(pair[child] - pair[child].max(axis=(1, 2), keepdims=True))
        q /= q.sum(axis=(1, 2), keepdims=True)
        off = true_pair[child] - q
        g_pair = np.zeros((3, 2, 2))
        np.add.at(g_pair, f.kind[child], off)
        g = np.append(np.bincount(f.col, (y - p)[f.row], N_UNARY), g_pair.ravel()) / len(trees) - decay * w
        m1 += 0.1 * (g - m1)
        m2 += 0.01 * (g * g - m2)
        w = w + rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    return Model(w[:N_UNARY], w[N_UNARY:].reshape(3, 2, 2))


def main_texts(htmls: list[str], model: Model) -> list[str]:
    trees = [parse(h) for h in htmls]
    keep = marginals(forest(trees), model) >= 0.5
    out, base = [], 0
    for t in trees:
        blocks: list[str] = []
        current: list[str] = []
        at = -1
        for e, text, block in t.pieces:
            if block != at:
                blocks.append("".join(current))
                current, at = [], block
            if keep[base + e]:
                current.append(text)
        blocks.append("".join(current))
        out.append("\n\n".join(x for x in (" ".join(b.split()) for b in blocks) if x))
        base += len(t.tags)
    return out


def extract(pages: DataFrame, model: Model | None = None, at_once: int = 64) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for each row of ``pages(page_id, url, html)``.

    The whole html counts, of any length, in time proportional to it, also where
    tags, quotes or comments stay open; null is empty. No content: empty text, 0
    characters. Each of several equal rows is given, null ids and urls stay null,
    an empty table gives no rows; other columns are ignored, whatever their names.
    """
    model = model or train(labelled_pages())
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), at_once):
                part = batch.slice(i, at_once)
                texts = main_texts([h or "" for h in part.column(2).to_pylist()], shared.value)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), part.column(1).cast(pa.string()), pa.array(texts), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    return pages.select("page_id", "url", "html").mapInArrow(work, "page_id long, url string, text string, n_chars long")
