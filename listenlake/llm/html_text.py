"""Main text of web pages by gradient-boosted trees over DOM nodes.

Boosted trees give every node (element or run of text) the log-odds of holding article text.
Hierarchical decoding then picks the likeliest labelling in which a dropped node has no kept
descendant. The trees are fitted on a bounded sample of pages (SAMPLE_PAGES). Pages carry no
labels, so a teacher reads them off the sample's own markup: what is inside ``article`` (or
``main``) is the text, all else is not. As real layouts differ, each sample page also lends
its texts to invented layouts, with other wrappers, sidebars, notices, forms and comments,
whose labels are known because they are built here.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listenlake.llm import dom
from listenlake.llm.common import settings, slices

SAMPLE_PAGES = 300
PAGE_BYTES = 1 << 20  # of pages decoded at once
SAMPLE_BYTES = 20_000  # longer pages are not taken into the sample
LAYOUTS = 4  # invented layouts for each sample page
TREES, DEPTH, RATE, BINS, LEAST = 60, 5, 0.2, 24, 8


@dataclass
class Trees:
    """Complete binary trees: for each tree the features and borders of its inner nodes, and its leaves' values."""

    features: np.ndarray
    borders: np.ndarray
    leaves: np.ndarray
    prior: float = 0.0

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        row = np.arange(len(x))
        for f, b, v in zip(self.features, self.borders, self.leaves, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[row, f[at]] > b[at])
            out += v[at - (2**DEPTH - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
    """Newton boosting of the logistic loss on binned features."""
    n, k = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(k)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    inner = 2**DEPTH - 1
    rate = float(np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3))
    trees = Trees(np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, inner + 1)), np.log(rate / (1 - rate)))
    score = np.full(n, trees.prior)
    cell = binned + np.arange(k) * BINS
    for t in range(TREES):
        p = 1 / (1 + np.exp(-score))
        slope, bend = weight * (y - p), weight * p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            place = ((at - first)[:, None] * (k * BINS) + cell).ravel()
            sums = [
                np.bincount(place, np.repeat(v, k), width * k * BINS).reshape(width, k, BINS)
                for v in (slope, bend, np.ones(n))
            ]
            left = [np.cumsum(s, axis=2)[:, :, :-1] for s in sums]
            whole = [s.sum(axis=2, keepdims=True) for s in sums]
            right = [w - s for w, s in zip(whole, left, strict=True)]
            gain = left[0] ** 2 / (left[1] + 1) + right[0] ** 2 / (right[1] + 1) - whole[0] ** 2 / (whole[1] + 1)
            gain[(left[2] < LEAST) | (right[2] < LEAST)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            j, b = best // (BINS - 1), best % (BINS - 1)
            good = gain.reshape(width, -1)[np.arange(width), best] > 1e-6
            for i in np.flatnonzero(good):
                trees.features[t, first + i] = j[i]
                trees.borders[t, first + i] = edges[j[i]][b[i]] if b[i] < len(edges[j[i]]) else np.inf
            node = at - first
            at = 2 * at + 1 + (good[node] & (binned[np.arange(n), j[node]] > b[node]))
        leaf = at - inner
        top, low = np.bincount(leaf, slope, inner + 1), np.bincount(leaf, bend, inner + 1)
        trees.leaves[t] = RATE * top / (low + 1)
        score += trees.leaves[t][leaf]
    return trees


def decode(nodes: list[dom.Node], odds: np.ndarray) -> np.ndarray:
    """The likeliest labels under which every kept node's parent is kept.

    ``best[i]`` is the gain of node i's subtree over dropping it whole.
    """
    best = np.zeros(len(nodes))
    own = odds.tolist()
    gains = [0.0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        best[i] = max(0.0, own[i] + gains[i])
        if nodes[i].parent >= 0:
            gains[nodes[i].parent] += best[i]
    kept = np.zeros(len(nodes), bool)
    for i, node in enumerate(nodes):
        kept[i] = best[i] > 0 and (node.parent < 0 or kept[node.parent])
    return kept


def text_of(nodes: list[dom.Node], kept: np.ndarray) -> str:
    """Kept runs, whole within their block, white space made single, blocks joined by a space."""
    blocks: dict[int, list[str]] = {}
    for node, k in zip(nodes, kept.tolist(), strict=True):
        if k and node.tag == "#text":
            blocks.setdefault(node.block, []).append(node.text)
    return " ".join(x for x in (" ".join("".join(b).split()) for b in blocks.values()) if x)


def extract_pages(pages: list[str], trees: Trees) -> list[str]:
    """The main text of each page."""
    parsed = [dom.parse(page) for page in pages]
    if not parsed:
        return []
    odds = trees.log_odds(np.array([row for nodes in parsed for row in dom.features(nodes)], np.float32))
    cuts = np.cumsum([len(nodes) for nodes in parsed])[:-1]
    return [text_of(nodes, decode(nodes, own)) for nodes, own in zip(parsed, np.split(odds, cuts), strict=True)]


def _labels(nodes: list[dom.Node], is_main) -> np.ndarray:
    """1 for every node with article text in it. ``is_main`` tells roots of article text."""
    inside = np.zeros(len(nodes), bool)
    held = np.zeros(len(nodes), bool)
    for i, node in enumerate(nodes):
        inside[i] = is_main(i, node) or (node.parent >= 0 and inside[node.parent])
        held[i] = inside[i] and node.tag == "#text"
    for i in range(len(nodes) - 1, 0, -1):
        held[nodes[i].parent] |= held[i]
    return held


def _teacher(nodes: list[dom.Node]) -> np.ndarray | None:
    roots = {i for tag in ("article", "main") for i, node in enumerate(nodes) if node.tag == tag}
    articles = {i for i in roots if nodes[i].tag == "article"}
    return _labels(nodes, lambda i, _: i in (articles or roots)) if roots else None


MARK = "\ue000"  # opens every text run that an invented layout keeps


def _invent(draw: random.Random, prose: list[str], other: list[str], words: list[str]) -> str:
    """A page with known labels: the texts of one sample page in an invented layout."""

    def some(low: int, high: int) -> str:
        return " ".join(draw.choice(words) for _ in range(draw.randint(low, high)))

    def link(text: str) -> str:
        return f'<a href="/{draw.randint(1, 99)}">{text}</a>'

    def attributes(names: str) -> str:
        name = draw.choice(names.split())
        return draw.choice((f' class="{name}"', f' id="{name}"', f' class="{name} box-{draw.randint(1, 9)}"', f' class="x-{name}"'))

    def links(tag: str) -> str:
        items = "".join(f"<li>{link(some(1, 3))}</li>" for _ in range(draw.randint(3, 9)))
        inner = f"<ul>{items}</ul>" if draw.random() < 0.7 else " | ".join(link(some(1, 2)) for _ in range(draw.randint(3, 9)))
        return tag.replace("@", inner)

    sentence = lambda: draw.choice(other)
    paragraph = lambda: f"<p>{sentence()}</p>"
    nav = lambda: links(draw.choice(("<nav>@</nav>", f"<div{attributes('nav menu navbar breadcrumb pagination tabs')}>@</div>", f"<ul{attributes('menu nav')}>@</ul>")))
    header = lambda: draw.choice((f"<header><h1>{some(1, 4)}</h1>{nav()}</header>", f"<header>{link(some(1, 3))}<p>{some(3, 8)}</p></header>", f"<div{attributes('header masthead topbar logo')}>{some(1, 5)}</div>"))
    footer = lambda: draw.choice((f"<footer>&copy; {some(1, 3)} &middot; {sentence()}</footer>", f"<footer><p>{some(3, 9)}</p>{nav()}</footer>", f"<div{attributes('footer copyright legal bottom')}>{sentence()}</div>"))
    sidebar = lambda: draw.choice((f"<aside><h3>{some(1, 3)}</h3>{paragraph()}</aside>", links("<aside>@</aside>"), f"<div{attributes('sidebar widget related recommended trending more-stories')}><h3>{some(1, 3)}</h3>{paragraph()}{links('<div>@</div>')}</div>", f"<section{attributes('related sidebar widget')}>{paragraph()}</section>"))
    advert = lambda: f"<{(t := draw.choice(('div', 'aside', 'section', 'p')))}{attributes('ad ads advert sponsored promo banner ad-slot')}>{sentence()}</{t}>"
    notice = lambda: f"<{(t := draw.choice(('div', 'section', 'p', 'dialog')))}{attributes('cookie cookie-notice consent notice alert gdpr newsletter subscribe popup modal')}>{sentence()}{draw.choice(('', f'<button>{some(1, 2)}</button>'))}</{t}>"
    form = lambda: f"<form{draw.choice(('', attributes('search signup newsletter login')))}><label>{some(1, 3)}</label><input type=text>{draw.choice(('', paragraph()))}<select><option>{some(1, 2)}</option><option>{some(1, 2)}</option></select><button>{some(1, 2)}</button></form>"

    def comments() -> str:
        item = draw.choice(("div", "li", "article"))
        each = "".join(f"<{item}{attributes('comment reply comment-body')}><b>{some(1, 2)}</b><p>{sentence()}</p></{item}>" for _ in range(draw.randint(1, 5)))
        outer = draw.choice(("div", "section", "ul" if item == "li" else "div"))
        return f"<{outer}{attributes('comments comment-list discussion disqus responses')}>{draw.choice(('', f'<h3>{some(1, 2)}</h3>'))}{each}</{outer}>"

    share = lambda: f"<div{attributes('share social follow')}>{link(some(1, 1))} {link(some(1, 1))}</div>"

    def body() -> str:
        out = [f"<{(h := draw.choice(('h1', 'h1', 'h2')))}>{MARK}{some(3, 9)}</{h}>"] if draw.random() < 0.85 else []
        for text in prose:
            kind = draw.random()
            if kind < 0.72:
                out.append(f"<p>{MARK}{text}{draw.choice(('</p>', '</p>', ''))}")
            elif kind < 0.78:
                out.append(f"<h2>{MARK}{some(2, 6)}</h2><p>{MARK}{text}</p>")
            elif kind < 0.84:
                out.append("<ul>" + "".join(f"<li>{MARK}{some(3, 12)}</li>" for _ in range(draw.randint(2, 5))) + "</ul>")
            elif kind < 0.88:
                out.append(f"<blockquote><p>{MARK}{text}</p></blockquote>")
            elif kind < 0.91:
                out.append(f"<div>{MARK}{text}</div>")
            elif kind < 0.94:
                out.append(f"<p>{MARK}{some(2, 8)} {link(some(1, 3))} {some(4, 12)}.</p>")
            elif kind < 0.96:
                out.append("<table>" + "".join(f"<tr><td>{MARK}{some(1, 4)}</td><td>{MARK}{some(1, 6)}</td></tr>" for _ in range(3)) + "</table>")
            elif kind < 0.98:
                out.append(f"<figure><img src=x><figcaption>{MARK}{some(3, 9)}</figcaption></figure>")
            else:
                out.append(f"<pre>{MARK}{text}</pre>")
            if draw.random() < 0.06:
                out.append(draw.choice((advert, notice, share, sidebar, form))())
        return "".join(out)

    wrap = draw.choice(("<article>@</article>",) * 4 + ("<main><article>@</article></main>", "<main>@</main>", f"<div{attributes('content article post-content entry-content story main')}>@</div>", "<section>@</section>", "<div>@</div>", f"<article{attributes('post entry story')}><div{attributes('body content text')}>@</div></article>"))
    main = wrap.replace("@", body())
    if draw.random() < 0.25 and "</article>" in main:
        main = main[: -len("</article>")] + comments() + main[-len("</article>") :] if main.endswith("</article>") else main
    top = [p() for p in (header, nav, notice, advert) if draw.random() < 0.5]
    side = [p() for p in (sidebar, form, share, advert) if draw.random() < 0.35]
    end = [p() for p in (share, comments, sidebar, form, notice) if draw.random() < 0.35] + ([footer()] if draw.random() < 0.9 else [])
    draw.shuffle(top)
    inner = "".join(top) + ("".join(side) + main if draw.random() < 0.5 else main + "".join(side)) + "".join(end)
    if draw.random() < 0.3:
        inner = f"<div{draw.choice(('', attributes('page wrapper container site')))}>{inner}</div>"
    return f"<!DOCTYPE html><html><head><title>{some(3, 6)}</title></head><body>{inner}</body></html>"


def fit_pages(pages: list[str], seed: int = 5) -> Trees:
    """Fit trees on sample pages and on layouts invented from their texts."""
    draw = random.Random(seed)
    rows, labels, weights, texts, words = [], [], [], [], []

    def take(nodes: list[dom.Node], y: np.ndarray):
        rows.extend(dom.features(nodes))
        labels.append(y)
        is_text = np.array([n.tag == "#text" for n in nodes])
        weights.append(np.where(is_text, 1.0, 0.7))

    for html in pages:
        nodes = dom.parse(html)
        y = _teacher(nodes)
        runs = [n.text.strip() for n in nodes if n.tag == "#text" and n.text.strip()]
        long = [r for r in runs if len(r) >= 40]
        texts.append(long)
        words += [w for r in runs for w in r.split()[:20]]
        if y is not None and y.any():
            take(nodes, y)
    plain = lambda s: s.replace("&", "&amp;").replace("<", "&lt;")
    words = [plain(w) for w in words] or ["text"]
    every = [plain(t[:400]) for own in texts for t in own] or ["Some text."]
    for own in texts:
        for _ in range(LAYOUTS):
            prose = [plain(t) for t in draw.sample(own, min(len(own), draw.randint(1, 8)))] or [draw.choice(every)]
            others = [draw.choice(every)[: draw.choice((40, 80, 160, 400))] for _ in range(12)]
            nodes = dom.parse(_invent(draw, prose, others, words))
            marked = {i for i, n in enumerate(nodes) if MARK in n.text}
            for n in nodes:
                n.text = n.text.replace(MARK, "")
            take(nodes, _labels(nodes, lambda i, _, m=marked: i in m))
    if not rows:
        return Trees(np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 1)))
    return fit_trees(np.array(rows, np.float32), np.concatenate(labels).astype(float), np.concatenate(weights))


def fit(pages: DataFrame, key: str = "page_id", html: str = "html") -> Trees:
    """Fit on at most SAMPLE_PAGES rows, chosen by a hash of their key; null pages are left out."""
    fitting = pages.select(key, html).where(F.octet_length(html).between(1, SAMPLE_BYTES))
    # Keys are chosen first, so that no task sends pages that others outdo.
    chosen = fitting.select(F.col(key).alias("_chosen")).distinct().orderBy(F.xxhash64("_chosen"), "_chosen").limit(SAMPLE_PAGES)
    same = F.col(key).eqNullSafe(F.col("_chosen"))
    rows = fitting.join(F.broadcast(chosen), same, "left_semi").orderBy(key, html).limit(SAMPLE_PAGES).collect()  # bounded
    return fit_pages([r[html] for r in rows])


def _extract(carried: list[str], html: str, trees: Trees):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, html, PAGE_BYTES):
                texts = extract_pages([x.as_py() or "" for x in part.column(html)], trees)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in carried), pa.array(texts, pa.string())], names=[*carried, "text"]
                )

    return run


def extract(pages: DataFrame, trees: Trees, html: str = "html") -> DataFrame:
    """All columns of ``pages`` but ``html``, and ``text``: each page's main text.

    A null or empty page, and one without article text, has an empty text. Repeated rows are
    read each; very long pages are read whole; a column named ``text`` is replaced.
    """
    settings(pages.sparkSession)
    carried = [c for c in pages.columns if c not in (html, "text")]
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in carried)
    return pages.select(*carried, html).mapInArrow(_extract(carried, html, trees), f"{schema}, text string".lstrip(", "))
