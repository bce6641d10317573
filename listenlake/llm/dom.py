"""A tolerant reader of HTML: a tree of block nodes and text runs with features for each.

Inline markup without attributes of its own is not a node; its text belongs to the run of the
block around it. A run knows its block, so that text a paragraph holds in several runs is put
together again without spaces.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from html import unescape

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("script style template noscript head title textarea iframe noembed noframes object svg math".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
# A start tag that ends an open paragraph, and those that end an open element of the same kind.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
ENDS_LIKE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
             "th": ("td", "th"), "option": ("option",)}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"),
          "th": ("tr", "table"), "option": ("select",)}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|</?[a-zA-Z][^>]*(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|aria-label|hidden|style|type)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_TOKEN = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SENTENCE = re.compile(r"[.!?…]")

TAG_GROUPS = (
    ("nav", "menu"), ("header",), ("footer",), ("aside",),
    ("form", "fieldset", "button", "select", "label", "input", "option", "legend"),
    ("article",), ("main",), ("section",), ("div",), ("p",), ("h1",), ("h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "dl"),
    ("li", "dt", "dd"), ("table", "tbody", "thead", "tr", "td", "th"), ("pre", "blockquote"), ("figure", "figcaption"),
    ("body", "html"), ("#text",), ("dialog",),
)
TOKEN_GROUPS = (
    "ad ads advert advertisement advertising adsense sponsor sponsored promo promotion banner",
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc skip tabs",
    "sidebar side aside widget related recommended recommendations trending popular rail more",
    "footer foot copyright legal colophon bottom",
    "header masthead logo topbar brand site top",
    "comment comments commentlist reply replies respond disqus discussion responses feedback reader",
    "cookie cookies notice consent gdpr alert warning popup modal overlay privacy banner message toast",
    "newsletter subscribe subscription signup login register search form",
    "share sharing social follow tags meta byline author",
    "content article post entry story main body text prose copy",
    "hidden none",
)
_GROUP_OF: dict[str, set[int]] = {}
for _i, _words in enumerate(TOKEN_GROUPS):
    for _w in _words.split():
        _GROUP_OF.setdefault(_w, set()).add(_i)
_TAG_OF = {tag: i for i, tags in enumerate(TAG_GROUPS) for tag in tags}


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    depth: int
    tokens: frozenset[int] = frozenset()
    children: list[int] = field(default_factory=list)
    text: str = ""
    block: int = -1
    links: int = 0
    place: int = 0  # among its siblings


def _tokens(attributes: str) -> tuple[frozenset[int], bool]:
    """Groups of an element's attribute words, and whether it has any attribute that names it."""
    found, named = set(), False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none", value)):
            found.add(len(TOKEN_GROUPS) - 1)
            named = True
        elif name not in ("style", "type"):
            named = True
            for word in _TOKEN.findall(_CAMEL.sub(" ", value).lower()):
                found |= _GROUP_OF.get(word, set())
    return frozenset(found), named


def parse(html: str) -> list[Node]:
    """All nodes in page order; the first is the root. Scripts, styles and the like leave nothing."""
    nodes = [Node("html", -1, 0)]
    stack: list[tuple[str, int]] = [("html", 0)]  # inline elements are open but have their block's node
    opened: dict[str, list[int]] = {}  # places in the stack of the open elements of each name
    blocks: list[int] = [0]  # and of those that are not inline
    pieces: dict[int, list[str]] = {}  # of text nodes
    block, run, hidden, links = 0, -1, 0, 0
    at, n = 0, len(html)

    def add(node: Node) -> int:
        family = nodes[node.parent].children
        node.place = len(family)
        family.append(len(nodes))
        nodes.append(node)
        return len(nodes) - 1

    def add_text(raw: str):
        nonlocal run
        if hidden or not raw:
            return
        text = unescape(raw)
        if run < 0:
            if not text.strip():
                if nodes[-1].tag == "#text" and nodes[-1].block == block:
                    pieces[len(nodes) - 1].append(text)
                    return
            parent = stack[-1][1]
            run = add(Node("#text", parent, nodes[parent].depth + 1, block=block))
            pieces[run] = []
        pieces[run].append(text)
        if links:
            nodes[run].links += len(text)

    def close(down_to: int):
        nonlocal hidden, links, run, block
        while len(stack) > down_to:
            tag, own = stack.pop()
            opened[tag].pop()
            hidden -= tag in UNSEEN
            links -= tag == "a"
            if tag not in INLINE:
                blocks.pop()
                block += 1
                run = -1
            elif own != stack[-1][1]:
                run = -1

    def last(tags: tuple[str, ...]) -> int:
        """Place of the innermost open element of some names; 0 if there is none."""
        return max((opened[t][-1] for t in tags if opened.get(t)), default=0)

    def close_like(tags: tuple[str, ...], scope: tuple[str, ...]):
        found = last(tags)
        if found and found >= last(scope):
            close(found)

    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            add_text(html[at:])
            break
        add_text(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag, attributes = m[2].lower(), m[3] or ""
        if m[1]:
            found = last((tag,))
            # An inline end tag does not reach out of its block.
            if found and (tag not in INLINE or found > blocks[-1]):
                close(found)
            if tag == "br":
                block, run = block + 1, -1
            continue
        if tag in ("html", "body"):
            if tag == "html" or opened.get("body"):
                continue
            close_like(("head",), ())
        if tag in ENDS_P:
            close_like(("p",), ("button", "table", "td", "th", "caption", "object"))
        if tag in ENDS_LIKE:
            close_like(ENDS_LIKE[tag], SCOPES[tag])
        if tag in ("br", "hr"):
            block, run = block + 1, -1
        if tag in VOID:
            continue
        tokens, named = _tokens(attributes) if attributes else (frozenset(), False)
        if tag in INLINE:
            own = stack[-1][1]
            if named and tokens and tag != "a":
                own = add(Node(tag, own, nodes[own].depth + 1, tokens))
                run = -1
        else:
            own = stack[-1][1]
            own = add(Node(tag, own, nodes[own].depth + 1, tokens))
            block, run = block + 1, -1
        opened.setdefault(tag, []).append(len(stack))
        if tag not in INLINE:
            blocks.append(len(stack))
        stack.append((tag, own))
        hidden += tag in UNSEEN
        links += tag == "a"
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])|\Z", re.I).search(html, at)
            at = end.start()
    for i, own in pieces.items():
        nodes[i].text = "".join(own)
    return nodes


N_TAGS, N_TOKENS = len(TAG_GROUPS), len(TOKEN_GROUPS)
N_FEATURES = 2 * N_TAGS + 2 * N_TOKENS + 16


def features(nodes: list[Node]) -> list[list[float]]:
    """One row of N_FEATURES for each node."""
    n = len(nodes)
    chars, links, stops, tags, paragraphs = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        node = nodes[i]
        if node.tag == "#text":
            chars[i] = len(node.text.strip())
            links[i] = min(node.links, chars[i])
            stops[i] = len(_SENTENCE.findall(node.text))
        else:
            tags[i] += 1
            paragraphs[i] += node.tag == "p"
        if node.parent >= 0:
            for sums in (chars, links, stops, tags, paragraphs):
                sums[node.parent] += sums[i]
    before, total = 0, max(1, chars[0])
    above: list[tuple[list[float], list[float]]] = []
    rows = []
    for i, node in enumerate(nodes):
        own_tag, own_tokens = [0.0] * N_TAGS, [0.0] * N_TOKENS
        if node.tag in _TAG_OF:
            own_tag[_TAG_OF[node.tag]] = 1.0
        for t in node.tokens:
            own_tokens[t] = 1.0
        if node.parent < 0:
            up_tags, up_tokens, place, siblings, parent_chars = [0.0] * N_TAGS, [0.0] * N_TOKENS, 0, 1, total
            previous = following = 0
        else:
            up_tags, up_tokens = above[node.parent]
            family = nodes[node.parent].children
            place, siblings, parent_chars = node.place, len(family), max(1, chars[node.parent])
            previous = chars[family[place - 1]] if place else 0
            following = chars[family[place + 1]] if place + 1 < siblings else 0
        above.append(([max(a, b) for a, b in zip(up_tags, own_tag, strict=True)], [max(a, b) for a, b in zip(up_tokens, own_tokens, strict=True)]))
        size = chars[i]
        rows.append(
            own_tag + up_tags + own_tokens + up_tokens
            + [
                math.log1p(size), links[i] / max(1, size), stops[i] / max(1, size) * 100, size / (1 + tags[i]),
                float(tags[i]), float(paragraphs[i]), float(node.depth), float(place), float(siblings), place / siblings,
                math.log1p(previous), math.log1p(following), size / parent_chars, size / total, before / total,
                float(stops[i]),
            ]
        )
        if node.tag == "#text":
            before += size
    return rows
