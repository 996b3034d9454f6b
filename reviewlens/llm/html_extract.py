"""Main-text extraction: boosted trees over DOM nodes, decoded on the tree.

Every page is read into a tree of block elements. A node is described by its
tag, the tokens of its class, id and role, the same of its ancestors, depth
and place among its siblings, and the density of text, links and paragraphs
below it. Gradient-boosted trees give each node the probability that its text
belongs to the article.

Decoding chooses for every node one of three states: its whole subtree is
kept, its whole subtree is dropped, or it is mixed and its children choose. A
dynamic program over the tree maximises the sum of the text-weighted log odds,
so no node is kept below a dropped one or dropped below a kept one.

Training pages come from the table itself, a sample of a fixed number by a hash
of id and page, whatever their size: text inside ``article`` or ``main`` is
labelled as content, and the texts (of a page without these marks, all outside
menus, notices and the like) are laid out anew with other tags, class names, sidebars, notices, forms
and comments, so that the trees do not rest on one template. Executors turn the
pages into features of at most ``TRAIN_ROWS`` nodes for the driver. Scripts, styles
and the like are never text.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, materialize, prepare

SAMPLE_PAGES = 300
#: training takes at most so many nodes in all, and of a page or a layout
TRAIN_ROWS, PAGE_ROWS = 120_000, 400
#: texts around the content that layouts draw from, characters of each, and tasks that read the sample
CHROME_TEXTS, CHROME_CHARS, SAMPLE_TASKS = 200, 2000, 16
TREES, DEPTH, RATE, LEAF = 40, 4, 0.2, 20
#: a mixed node must gain this much, so that trees stay undivided without a reason
SPLIT_COST = 0.5

# fixed values: elements by their role in HTML
SILENT = frozenset("script style noscript template svg math iframe object head title select option textarea button canvas audio video map".split())
RAW = frozenset("script style textarea title noscript iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead
tr ul""".split())
CLOSES_P = BLOCKS - {"body", "html", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
#: what may stand in an open head; any other element or text ends it, for its end tag may be left out
HEAD = frozenset("head html base basefont bgsound link meta title style script noscript template".split())
NEVER = frozenset(("nav", "aside", "footer", "form", "dialog", "menu"))   # by their meaning no part of the article, see _open_frames
FRAMES = frozenset(("nav", "form", "menu"))              # that pages also wrap around everything
CONTENT_TAGS = frozenset(("article", "main"))
#: an element that ends an open one of these, up to the given container
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}),
           "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
           "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "tr", "td", "th"}, {"table"})}

_MARK = re.compile(r"""<(?:(?P<comment>!--)|(?P<other>[!?])|(?P<end>/)?(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']|"[^"]*+"|'[^']*+')*+)>)""")
_ATTR = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_TOKEN = re.compile(r"[a-z]+")


@dataclass
class Node:
    tag: str
    tokens: frozenset
    parent: int
    depth: int
    sibling: int
    silent: bool
    children: list[int] = field(default_factory=list)
    texts: list[tuple[int, str, bool]] = field(default_factory=list)   # (order, text, in a link)
    siblings: int = 0
    ended: bool = False                                    # by an end tag of its own


def parse(page: str) -> list[Node]:
    """Block elements of a page in document order; node 0 is the root."""
    nodes = [Node("#root", frozenset(), -1, 0, 0, False)]
    stack: list[tuple[str, int]] = [("#root", 0)]         # open elements and their block node
    at, order, links = 0, 0, 0

    def add_text(s: str) -> None:
        nonlocal order
        if stack[-1][0] == "head" and s.strip():
            close(len(stack) - 1)
        node = nodes[stack[-1][1]]
        if s and not node.silent and not any(t in SILENT for t, _ in stack[-3:]):
            node.texts.append((order, html.unescape(s) if "&" in s else s, links > 0))
        order += 1

    def close(i: int) -> None:
        nonlocal links
        links -= sum(t == "a" for t, _ in stack[i:])
        del stack[i:]

    def close_implied(tags: set, stop: set) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in stop:
                return
            if stack[i][0] in tags:
                close(i)
                return

    while True:
        m = _MARK.search(page, at)
        if m is None:
            rest = page[at:]
            cut = re.search(r"<[a-zA-Z/!?]", rest)         # an unfinished tag at the end is no text
            add_text(rest[:cut.start()] if cut else rest)
            break
        add_text(page[at:m.start()])
        at = m.end()
        if m["comment"]:
            end = page.find("-->", at)
            at = len(page) if end < 0 else end + 3
            continue
        if m["other"]:
            end = page.find(">", at)
            at = len(page) if end < 0 else end + 1
            continue
        tag = m["tag"].lower()
        if stack[-1][0] == "head" and tag not in HEAD:
            close(len(stack) - 1)
        if m["end"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    if tag in BLOCKS:
                        nodes[stack[i][1]].ended = True
                    close(i)
                    break
            if tag in BLOCKS:
                order += 1
            continue
        if tag == "br":
            add_text(" ")
            continue
        if tag in CLOSES_P:
            close_implied({"p"}, BLOCKS - {"p"})
        if tag in IMPLIED:
            close_implied(*IMPLIED[tag])
        if tag in VOID:
            continue
        attrs = m["attrs"]
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}", re.I).search(page, at)
            at = len(page) if end is None else page.find(">", end.end()) + 1 or len(page)
            continue
        if tag in BLOCKS or tag in SILENT:
            parent = stack[-1][1]
            tokens = frozenset(_TOKEN.findall(" ".join(_ATTR.findall(attrs)).lower())) if attrs and "=" in attrs else frozenset()
            nodes.append(Node(tag, tokens, parent, nodes[parent].depth + 1, len(nodes[parent].children),
                              nodes[parent].silent or tag in SILENT))
            nodes[parent].children.append(len(nodes) - 1)
            stack.append((tag, len(nodes) - 1))
            order += 1
        else:
            links += tag == "a"
            stack.append((tag, stack[-1][1]))
    nodes = _open_frames(nodes)
    for n in nodes:
        for c in n.children:
            nodes[c].siblings = len(n.children)
    return nodes


def _open_frames(nodes: list[Node]) -> list[Node]:
    """The nodes without elements of ``NEVER`` that cannot mean what their tag
    says; their children go to the parent, and one with own text becomes a
    plain ``div``, so the trees judge the parts one by one. These are an open one without an end
    tag (a footer may end with the page), and one around the content, which is
    every ``article`` and ``main`` of the page, or without these an ``h1`` or
    most of the text outside links (``aside``, ``footer`` and ``dialog``: all
    marks and most of the text)."""
    if not any(n.tag in NEVER for n in nodes):
        return nodes
    marks = [int(n.tag in CONTENT_TAGS and not n.silent) for n in nodes]
    heads = [int(n.tag == "h1" and not n.silent) for n in nodes]
    plain = [sum(len(t.strip()) for _, t, k in n.texts if not k) for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):                 # children come after their parents
        p = nodes[i].parent
        marks[p] += marks[i]
        heads[p] += heads[i]
        plain[p] += plain[i]
    gone = set()
    for i, n in enumerate(nodes):
        if n.tag not in NEVER:
            continue
        most = 2 * plain[i] > plain[0]
        marked = marks[0] > 0 and marks[i] == marks[0]
        if n.tag in FRAMES:
            around = marked or not marks[0] and (heads[i] > 0 or most)
        else:
            around = marked and most
        if around or not n.ended and n.tag != "footer":
            n.tag, n.tokens = "div", frozenset()
            if not any(t.strip() for _, t, _ in n.texts):
                gone.add(i)
    if not gone:
        return nodes
    at, out = [0] * len(nodes), []                         # new place of each node, or that of its parent
    for i, n in enumerate(nodes):
        parent = at[n.parent] if i else -1
        if i in gone:
            at[i] = parent
            continue
        at[i] = len(out)
        out.append(n)
        n.parent, n.children = parent, []
        if i:
            n.depth, n.sibling = out[parent].depth + 1, len(out[parent].children)
            out[parent].children.append(at[i])
    return out


def text_blocks(nodes: list[Node], keep: list[bool]) -> list[str]:
    """Texts of the kept nodes in page order; white space inside a block is one blank.

    Text of a node that stands between its child elements makes a block of its own."""
    first = [n.texts[0][0] if n.texts else np.inf for n in nodes]      # order of the first text of each subtree
    for i in range(len(nodes) - 1, 0, -1):                 # children come after their parents
        first[nodes[i].parent] = min(first[nodes[i].parent], first[i])
    runs: list[tuple[int, str]] = []
    for i, n in enumerate(nodes):
        if not keep[i] or not n.texts:
            continue
        below = [first[c] for c in n.children if first[c] < np.inf]    # ascending, as children are in page order
        begin, last, parts = n.texts[0][0], None, []
        for order, text, _ in n.texts:
            # a child lies between two texts whole or not at all
            if last is not None and order - last > 1 and bisect_right(below, last) < bisect_left(below, order):
                runs.append((begin, "".join(parts)))
                begin, parts = order, []
            parts.append(text)
            last = order
        runs.append((begin, "".join(parts)))
    runs.sort(key=lambda r: r[0])
    cleaned = [" ".join(t.split()) for _, t in runs]
    return [t for t in cleaned if t]


# words that pages use for the parts of a layout; whether and how they count is learned
HINTS = ("article content main post entry story body text nav menu header footer sidebar side aside ad ads advert sponsor promo "
         "banner notice cookie consent popup modal alert share social related recommend comment comments reply discussion form "
         "search login subscribe newsletter breadcrumb pagination copyright legal widget").split()
_TAGS = ("p", "div", "section", "article", "main", "nav", "aside", "header", "footer", "form", "ul", "ol", "li", "table", "tr", "td",
         "blockquote", "pre", "figure", "h1", "h2", "h3")
_HINT = {h: i for i, h in enumerate(HINTS)}
_TAG = {t: i for i, t in enumerate(_TAGS)}
N_FEATURES = 2 * (len(HINTS) + len(_TAGS)) + 14


def features(nodes: list[Node]) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, features) and the number of characters of each node's own text."""
    n = len(nodes)
    own = np.array([sum(len(t) for _, t, _ in x.texts) for x in nodes], dtype=float)
    link = np.array([sum(len(t) for _, t, k in x.texts if k) for x in nodes], dtype=float)
    stops = np.array([sum(t.count(".") + t.count(",") for _, t, _ in x.texts) for x in nodes], dtype=float)
    paragraphs = np.array([x.tag == "p" for x in nodes], dtype=float)
    total, link_all, stop_all, p_all, size = own.copy(), link.copy(), stops.copy(), paragraphs.copy(), np.ones(n)
    for i in range(n - 1, 0, -1):                          # children come after their parents
        p = nodes[i].parent
        total[p] += total[i]
        link_all[p] += link_all[i]
        stop_all[p] += stop_all[i]
        p_all[p] += p_all[i]
        size[p] += size[i]
    before = np.cumsum(own) - own
    k = len(HINTS) + len(_TAGS)
    x = np.zeros((n, N_FEATURES))
    for i, node in enumerate(nodes):
        row = x[i]
        if node.parent >= 0:                               # what the ancestors are
            np.maximum(x[node.parent, :k], x[node.parent, k:2 * k], out=row[k:2 * k])
        for t in node.tokens:
            if t in _HINT:
                row[_HINT[t]] = 1
        if node.tag in _TAG:
            row[len(HINTS) + _TAG[node.tag]] = 1
    parent = np.array([max(v.parent, 0) for v in nodes])
    whole = max(total[0], 1)
    x[:, 2 * k:] = np.column_stack([
        [v.depth for v in nodes], [v.sibling for v in nodes], [v.siblings for v in nodes],
        [v.siblings - v.sibling for v in nodes], np.log1p(own), np.log1p(total), link_all / np.maximum(total, 1),
        stop_all / np.maximum(total, 1), np.log1p(p_all), total / size, total / whole, before / whole,
        total[parent] / whole, size])
    return x, own


@dataclass
class BoostedTrees:
    """Trees as arrays: feature, threshold, left child (right is the next), value."""
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, child, value in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                step = child[at] + (x[rows, feature[at]] > threshold[at])
                at = np.where(child[at] > 0, step, at)
            out += value[at]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int = 2) -> BoostedTrees:
    """Newton boosting of regression trees on the logistic loss."""
    if not len(y) or y.min() == y.max():
        return BoostedTrees(base=(4.0 if len(y) and y[0] else -4.0))
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 34)[1:-1])) for j in range(x.shape[1])]
    codes = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    mean = float((weight * y).sum() / weight.sum())
    model = BoostedTrees(base=float(np.log(mean / (1 - mean))))
    score = np.full(len(y), model.base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (y - p), weight * p * (1 - p)
        columns = np.flatnonzero(rng.random(x.shape[1]) < 0.5)   # no single mark carries every tree
        feature, threshold, child, value = [0], [0.0], [0], [0.0]
        level = [(0, np.arange(len(y)))]
        for depth in range(DEPTH + 1):
            nxt = []
            for node, rows in level:
                gs, hs = g[rows].sum(), h[rows].sum()
                value[node] = RATE * gs / (hs + 1.0)
                if depth == DEPTH or len(rows) < 2 * LEAF:
                    score[rows] += value[node]
                    continue
                best = (1e-3, -1, 0)
                for j in columns:
                    m = len(edges[j]) + 1
                    c = codes[rows, j]
                    gl, hl = np.bincount(c, g[rows], m).cumsum()[:-1], np.bincount(c, h[rows], m).cumsum()[:-1]
                    nl = np.bincount(c, minlength=m).cumsum()[:-1]
                    ok = (nl >= LEAF) & (len(rows) - nl >= LEAF)
                    if ok.any():
                        gain = np.where(ok, gl ** 2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1), 0) - gs ** 2 / (hs + 1)
                        k = int(gain.argmax())
                        if gain[k] > best[0]:
                            best = (float(gain[k]), int(j), k)
                if best[1] < 0:
                    score[rows] += value[node]
                    continue
                _, j, k = best
                feature[node], threshold[node], child[node] = j, float(edges[j][k]), len(feature)
                for part in (rows[codes[rows, j] <= k], rows[codes[rows, j] > k]):
                    nxt.append((len(feature), part))
                    feature.append(0)
                    threshold.append(0.0)
                    child.append(0)
                    value.append(0.0)
            level = nxt
        model.trees.append((np.array(feature), np.array(threshold), np.array(child), np.array(value)))
    return model


def decode(nodes: list[Node], odds: np.ndarray, own: np.ndarray) -> list[bool]:
    """The best consistent choice of whole kept and dropped subtrees."""
    # long texts count more, but not in proportion, and short ones count
    worth = np.clip(odds, -6, 6) * np.where(own > 0, 2 + np.sqrt(own), 0)
    n = len(nodes)
    kept, dropped = worth.copy(), -worth                   # value of keeping, of dropping the whole subtree
    children = np.zeros(n)                                 # best of the children, each for itself
    state = [""] * n
    for i in range(n - 1, -1, -1):
        node = nodes[i]
        if node.silent:
            state[i], best = "drop", 0.0                   # no text, and no say in what its parent does
            kept[i] = dropped[i] = 0.0
        elif node.tag in NEVER:
            state[i], best = "drop", dropped[i]
            kept[i] = -np.inf if own[i] or dropped[i] else 0.0
        else:
            mixed = children[i] + abs(worth[i]) - SPLIT_COST if node.children else -np.inf
            options = {"keep": kept[i], "drop": dropped[i], "mixed": mixed}
            state[i] = max(options, key=lambda s: options[s])
            best = options[state[i]]
        if node.parent >= 0:
            kept[node.parent] += kept[i]
            dropped[node.parent] += dropped[i]
            children[node.parent] += best
    keep = [False] * n
    for i, node in enumerate(nodes):                       # from the root down
        above = state[node.parent] if node.parent >= 0 else "mixed"
        if above in ("keep", "drop") and not node.silent:
            state[i] = above
        keep[i] = not node.silent and (state[i] == "keep" or state[i] == "mixed" and worth[i] > 0)
    return keep


def main_text(page: str | None, model: BoostedTrees) -> str:
    nodes = parse(page or "")
    x, own = features(nodes)
    return "\n\n".join(text_blocks(nodes, decode(nodes, model.log_odds(x), own)))


CHROME_TAGS = frozenset(("nav", "aside", "footer", "form", "header", "menu", "dialog"))
CHROME_HINTS = frozenset(HINTS[HINTS.index("nav"):])


def weak_labels(nodes: list[Node]) -> np.ndarray:
    """1 inside ``article`` or ``main`` and outside menus, notices and the like, else 0."""
    y = np.zeros(len(nodes))
    for i, n in enumerate(nodes):
        if n.silent or n.tag in CHROME_TAGS or n.tokens & CHROME_HINTS:
            y[i] = 0
        elif n.tag in CONTENT_TAGS:
            y[i] = 1
        else:
            y[i] = y[n.parent] if n.parent >= 0 else 0
    return y


def lay_out(blocks: list[str], chrome: list[str], rng: np.random.Generator) -> str:
    """A page with these content blocks in a random layout."""
    out: list[str] = []
    pick = lambda *a: a[int(rng.integers(len(a)))]         # noqa: E731
    esc = html.escape
    text = lambda: esc(pick(*chrome)) if chrome else "more"
    links = lambda k: "".join(f'<li><a href="#">{text()[:30]}</a></li>' for _ in range(k))
    chances = rng.random(8)
    if chances[0] < 0.7:
        out.append(pick(f"<nav><ul>{links(6)}</ul></nav>", f'<div class="menu"><ul>{links(5)}</ul></div>',
                        f'<header class="site-header"><p>{text()}</p></header>', f'<div id="header"><div class="nav">{links(4)}</div></div>'))
    if chances[1] < 0.4:
        out.append(pick(f'<div class="cookie-notice"><p>{text()}</p></div>', f'<div class="alert banner">{text()}</div>',
                        f'<div role="dialog" class="popup"><p>{text()}</p><form><p>{text()}</p></form></div>'))
    if chances[2] < 0.6:
        out.append(pick(f'<div class="ad">{text()}</div>', f'<div class="advert"><p>{text()}</p></div>', f'<aside class="promo"><p>{text()}</p></aside>'))
    if chances[3] < 0.5:
        out.append(pick(f'<aside><h3>{text()[:40]}</h3><ul>{links(4)}</ul></aside>',
                        f'<div class="sidebar"><p>{text()}</p><ul>{links(3)}</ul></div>'))
    opening, closing = pick(("<article>", "</article>"), ("<main>", "</main>"), ('<div class="post-content">', "</div>"),
                            ('<div id="content"><div class="entry">', "</div></div>"), ('<section class="story">', "</section>"),
                            ("<main><article>", "</article></main>"), ('<div class="article-body">', "</div>"), ("<div>", "</div>"), ("", ""))
    head = pick("h1", "h1", "h2", "h3")
    body = [f"<{head}>{esc(blocks[0])}</{head}>"] + [f"<{t}>{esc(b)}</{t}>" for b in blocks[1:]
                                             for t in (pick("p", "p", "p", "p", "p", "blockquote", "h2", "li", "div"),)]
    if chances[4] < 0.5:
        body.insert(int(rng.integers(1, len(body) + 1)), pick(
            f'<div class="ad">{text()}</div>', f'<aside class="related"><p>{text()}</p></aside>',
            f'<div class="newsletter"><p>{text()}</p><form><p>{text()}</p></form></div>', f'<div class="share"><ul>{links(3)}</ul></div>'))
    out.append(opening + "".join(body) + closing)
    if chances[5] < 0.6:
        own = "".join(f'<div class="comment"><p>{text()}</p></div>' for _ in range(int(rng.integers(1, 5))))
        out.append(pick(f'<section id="comments">{own}</section>', f'<div class="comments"><h3>{text()[:20]}</h3>{own}</div>',
                        f'<ol class="discussion">{own.replace("div", "li")}</ol>'))
    if chances[6] < 0.3:
        out.append(pick(f'<form><p>{text()}</p></form>', f'<div class="subscribe"><p>{text()}</p></div>', f'<div class="related"><ul>{links(5)}</ul></div>'))
    if chances[7] < 0.8:
        out.append(pick(f"<footer>&copy; {text()}</footer>", f'<div class="footer"><p>{text()}</p></div>',
                        f'<div id="copyright">{text()}</div>'))
    return f"<html><body>{''.join(out)}</body></html>"


def _layout_labels(nodes: list[Node]) -> np.ndarray:
    """Labels of a page of :func:`lay_out`: its content stands below the known openings."""
    content = {"post", "entry", "story", "content", "body"}
    y = np.zeros(len(nodes))
    for i, n in enumerate(nodes):
        if n.tag in CHROME_TAGS or n.tokens & CHROME_HINTS or n.silent:
            y[i] = 0
        elif n.tag in CONTENT_TAGS or n.tokens & content:
            y[i] = 1
        elif n.parent >= 0:
            top = nodes[n.parent].tag == "body" and not n.tokens and n.tag not in ("ul", "ol", "table")
            y[i] = 1 if top else y[n.parent]
    return y


def page_blocks(page: str) -> tuple[bool, list[str], list[str]]:
    """Whether a page marks its content, the content blocks and the others.

    Without a mark, the blocks outside menus, notices and the like stand for
    content, or all blocks if there are no such."""
    nodes = parse(page)
    y = weak_labels(nodes) > 0
    content = text_blocks(nodes, y.tolist())
    marked = bool(content)
    if not marked:
        for i, n in enumerate(nodes):                      # not in such a part, nor below one
            chrome = n.silent or n.tag in CHROME_TAGS or bool(n.tokens & CHROME_HINTS)
            y[i] = not chrome and (i == 0 or y[n.parent])
        content = text_blocks(nodes, y.tolist())
        if not content:
            y[:] = True
            content = text_blocks(nodes, y.tolist())
    return marked, content, [t for t in text_blocks(nodes, (~y).tolist()) if len(t) > 3]


def training_rows(page: str, chrome: list[str], rows: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and weights of nodes of a page as it is, if it marks its
    content, and of three new layouts of its texts; at most ``rows`` nodes of each."""
    rng = np.random.default_rng(seed)
    xs, ys, ws = [np.zeros((0, N_FEATURES))], [np.zeros(0)], [np.zeros(0)]

    def learn(nodes: list[Node], y: np.ndarray) -> None:
        x, own = features(nodes)
        use = np.flatnonzero([not n.silent for n in nodes])
        if len(use) > rows:
            use = np.sort(rng.choice(use, rows, replace=False))
        xs.append(x[use])
        ys.append(y[use])
        ws.append(0.2 + np.log1p(own[use]))
    marked, content, other = page_blocks(page)
    if content:
        if marked:
            nodes = parse(page)
            learn(nodes, weak_labels(nodes))
        foreign = other[:20] + chrome + [t[:300] for t in content[-2:]]   # articles' own words as adverts and comments too
        for _ in range(3):
            laid = parse(lay_out(content, foreign, rng))
            learn(laid, _layout_labels(laid))
    return np.vstack(xs), np.concatenate(ys), np.concatenate(ws)


def some_chrome(others: list[list[str]], seed: int) -> list[str]:
    """At most ``CHROME_TEXTS`` of the texts that pages have around their content."""
    found = [t for texts in others for t in texts]
    return [found[i] for i in np.random.default_rng(seed).permutation(len(found))[:CHROME_TEXTS]]


def fit_extractor(pages: list[str], seed: int = 4) -> BoostedTrees:
    """Trees on pages as they are and on three new layouts of each."""
    chrome = some_chrome([page_blocks(p)[2] for p in pages], seed)
    rows = [training_rows(p, chrome, PAGE_ROWS, seed + i) for i, p in enumerate(pages)]
    return _fit_rows(rows)


def _fit_rows(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> BoostedTrees:
    if not sum(len(y) for _, y, _ in rows):                # not one page has a text
        return BoostedTrees(base=4.0)
    return fit_trees(*(np.concatenate(part) for part in zip(*rows)))


def fit_sample(sample: DataFrame, sample_pages: int, seed: int = 4) -> BoostedTrees:
    """As :func:`fit_extractor` for ``sample(key, html)``, pages of any size: the
    executors read them, and the driver gets short texts and node rows only."""
    def others(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for key, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = page_blocks(page)[2]
                found = [found[i][:CHROME_CHARS] for i in np.random.default_rng(abs(key)).permutation(len(found))[:8]]
                yield pa.record_batch([pa.array([key], pa.int64()), pa.array([found], pa.list_(pa.string()))], names=["key", "texts"])
    found = sample.mapInArrow(others, "key long, texts array<string>").collect()         # at most 8 short texts a page
    chrome = some_chrome([r["texts"] for r in sorted(found, key=lambda r: r["key"])], seed)
    most = min(PAGE_ROWS, max(TRAIN_ROWS // (4 * max(sample_pages, 1)), 1))

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for key, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y, w = training_rows(page, chrome, most, abs(key))
                yield pa.record_batch([pa.array([key], pa.int64()), pa.array([x.astype(np.float32).tobytes()], pa.binary()),
                                       pa.array([y.tobytes()], pa.binary()), pa.array([w.tobytes()], pa.binary())],
                                      names=["key", "x", "y", "w"])
    got = sample.mapInArrow(rows, "key long, x binary, y binary, w binary").collect()   # at most TRAIN_ROWS nodes
    return _fit_rows([(np.frombuffer(r["x"], np.float32).reshape(-1, N_FEATURES).astype(float), np.frombuffer(r["y"]), np.frombuffer(r["w"]))
                      for r in sorted(got, key=lambda r: r["key"])])


def extract_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """One row per input row: page_id, url, text, n_chars.

    A null or empty page, or one without main text, has an empty text. The
    trees learn from ``sample_pages`` pages of any size, chosen by hash; a page
    that marks no article gives layouts of its texts only. Repeated rows and null ids are extracted one by one; an empty
    table gives an empty result; other columns are ignored.
    """
    spark = df.sparkSession
    prepare(spark)
    pages = df.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"),
                      F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"))
    # training pages are the first by a hash, of any size; keys are chosen first, so that only these pages travel
    keyed = pages.filter(F.col("html") != "").select("html", F.xxhash64("page_id", "html").alias("key"))
    keys = keyed.select("key").distinct().orderBy(F.xxhash64("key"), "key").limit(sample_pages)
    sample = materialize(keyed.join(F.broadcast(keys), "key").groupBy("key").agg(F.first("html").alias("html"))
                         .repartition(SAMPLE_TASKS, "key"))       # at most sample_pages rows
    model = spark.sparkContext.broadcast(fit_sample(sample, sample_pages))
    free(sample)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            texts = _batch_texts(batch.column(2).to_pylist(), model.value)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                   pa.array([len(t) for t in texts], pa.int64())],
                                  names=["page_id", "url", "text", "n_chars"])
    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def _batch_texts(pages: list[str], model: BoostedTrees, size: int = 200) -> list[str]:
    """Main texts, the nodes of ``size`` pages scored together."""
    out = []
    for at in range(0, len(pages), size):
        trees = [parse(p) for p in pages[at:at + size]]
        found = [features(t) for t in trees]
        odds = model.log_odds(np.vstack([x for x, _ in found])) if found else np.zeros(0)
        end = 0
        for nodes, (x, own) in zip(trees, found):
            begin, end = end, end + len(x)
            out.append("\n\n".join(text_blocks(nodes, decode(nodes, odds[begin:end], own))))
    return out
