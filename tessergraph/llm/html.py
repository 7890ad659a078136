"""HTML extraction by a tree-structured graphical model.

A page becomes a tree of block elements with its text blocks as leaves. Each node is content or not; a node's own evidence
(tag, class words, length, link share) is a logistic score, and parent-child potentials tie labels together. Sum-product
messages, first upward and then downward, give every text block's marginal. The weights and potentials are trained on
labelled pages that ``labelled_page`` lays out in many ways.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from math import exp, log1p

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tessergraph.llm.common import bounded_batches, plain_id, restored, table

#: Labelled pages the model is trained on.
TRAIN_PAGES = 600
_OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/<>]*))")
_MARK = re.compile("[>\"']")
_HINT = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+")
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements whose text is never shown as text of the page.
UNSEEN = RAW | {"head", "svg", "math", "select", "option", "button", "object", "canvas", "audio", "video", "datalist"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu",
    "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}, "option": {"option"}}
_TABLE_PARTS = {"table", "tr", "tbody", "thead", "tfoot", "td", "th"}
WALLS = {"table", "ul", "ol", "dl", "menu", "body", "html", "select", "td", "th"}


class Node:
    __slots__ = ("tag", "hints", "parent", "chars", "linked", "parts", "label")

    def __init__(self, tag: str, hints: tuple[str, ...], parent: int):
        self.tag, self.hints, self.parent = tag, hints, parent
        self.chars = self.linked = 0
        self.parts: list[str] | None = None  # the text of a leaf
        self.label = False


def _tag_ends(html: str) -> tuple[list[int], list[int]]:
    """The places of ``>`` and quotes, and for each where a tag ends whose attributes are read from there; -1: nowhere.

    Read from the back: ``>`` ends a tag, and a quote sends it on to what follows the next quote of its kind.
    """
    places = [m.start() for m in _MARK.finditer(html)]
    ends, following = [-1] * len(places), {'"': -1, "'": -1}
    for k in range(len(places) - 1, -1, -1):
        mark = html[places[k]]
        if mark == ">":
            ends[k] = places[k]
        else:
            after = following[mark]
            ends[k] = ends[after + 1] if 0 <= after < len(places) - 1 else -1
            following[mark] = k
    return places, ends


def _tokens(html: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, slash, name, attributes) of comments, declarations (without a name) and tags; linear in the page.

    A ``<`` that begins nothing, or a tag that never ends, is text. Elements of raw text are one token with their inside.
    """
    places, ends = _tag_ends(html)
    at = k = 0
    while m := _OPEN.search(html, at):
        if m.group(1):
            close = html.find("-->", m.end())
            at = close + 3 if close >= 0 else len(html)
            yield m.start(), at, "", "", ""
        elif m.group(2):
            close = html.find(">", m.end())
            at = close + 1 if close >= 0 else len(html)
            yield m.start(), at, "", "", ""
        else:
            while k < len(places) and places[k] < m.end():
                k += 1
            end = ends[k] if k < len(places) else -1
            if end < 0:
                at = m.end()
                continue
            at, name = end + 1, m.group(4).lower()
            if name in RAW and not m.group(3):  # up to its own end tag, or to the page's end
                close = _raw_end(name).search(html, at)
                close_end = html.find(">", close.end()) if close else -1
                at = close_end + 1 if close_end >= 0 else len(html)
            yield m.start(), at, m.group(3), name, html[m.end() : end]


@lru_cache(32)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I)


class _Stack:
    """Open elements with their node, or their block's for inline ones, and where each tag stands, the innermost last."""

    def __init__(self) -> None:
        self.held: list[tuple[str, int]] = []
        self.places: dict[str, list[int]] = {}

    def push(self, tag: str, node: int) -> None:
        self.places.setdefault(tag, []).append(len(self.held))
        self.held.append((tag, node))

    def pop(self) -> str:
        tag, _ = self.held.pop()
        self.places[tag].pop()
        return tag

    def innermost(self, tag: str) -> int:
        """Its place, 0 if it is not open above the root."""
        own = self.places.get(tag)
        return own[-1] if own else 0


def parse(html: str) -> list[Node]:
    """The page's nodes, parents before children; text blocks are leaves with tag ``#``, in page order.

    Takes time in proportion to the page, however broken or deep its markup is.
    """
    nodes = [Node("html", (), -1)]
    stack = _Stack()
    stack.push("html", 0)
    leaf: Node | None = None
    links = unseen = 0
    text_from, end = 0, len(html)

    def add(piece: str) -> None:
        nonlocal leaf
        if leaf is None:
            if not piece.strip():
                return
            leaf = Node("#", (), stack.held[-1][1])
            leaf.parts = []
            nodes.append(leaf)
        leaf.parts.append(piece)
        if links:
            leaf.linked += len(piece)

    def pop(to: int) -> None:
        nonlocal leaf, links, unseen
        while len(stack.held) > to:
            tag = stack.pop()
            links -= tag == "a"
            unseen -= tag in UNSEEN
            if tag in BLOCKS:
                leaf = None

    for start, stop, slash, tag, attributes in _tokens(html):
        if start > text_from and not unseen:
            add(unescape(html[text_from:start]))
        text_from = stop
        if not tag:
            continue
        if slash:
            k = stack.innermost(tag)
            wall = 0 if tag in _TABLE_PARTS or tag in BLOCKS else max(map(stack.innermost, ("table", "td", "th")))
            if k and k >= wall:  # an inline element does not end beyond its cell
                pop(k)
            if tag in BLOCKS:
                leaf = None
            continue
        if tag == "br" or tag == "wbr":
            if leaf is not None and tag == "br":
                leaf.parts.append(" ")
            continue
        if tag in VOID:
            if tag in BLOCKS:
                leaf = None
            continue
        if tag in ("html", "body") and len(stack.held) > 1 and (tag == "html" or stack.innermost(tag)):
            continue
        if tag in BLOCKS:  # a block ends an open paragraph; list items and cells end their like
            ended = max(map(stack.innermost, ("p", *CLOSES.get(tag, ()))))
            wall = max(map(stack.innermost, WALLS - {"td", "th"} if tag in ("tr", "tbody", "tfoot") else WALLS))
            k = max(ended, stack.innermost("head"))
            if k and (k > wall or k == ended == wall):
                pop(k)
            leaf = None
            hints = tuple(w for h in _HINT.findall(attributes) for w in _PART.findall("".join(h).lower())) if attributes else ()
            nodes.append(Node(tag, hints, stack.held[-1][1]))
            stack.push(tag, len(nodes) - 1)
        elif tag in RAW:
            continue
        elif not attributes.endswith("/"):
            stack.push(tag, stack.held[-1][1])
        else:
            continue
        links += tag == "a"
        unseen += tag in UNSEEN
    if text_from < end and not unseen:
        add(unescape(html[text_from:]))
    for node in reversed(nodes):
        if node.parts is not None:
            node.chars = sum(map(len, node.parts))
        if node.parent >= 0:
            nodes[node.parent].chars += node.chars
            nodes[node.parent].linked += node.linked
    return nodes


#: Elements that say what their whole inside is for.
SECTIONS = {"article", "main", "nav", "aside", "header", "footer", "form", "dialog", "menu", "search", "section", "body"}


def contexts(nodes: list[Node]) -> list[tuple[str, ...]]:
    """For each node what its nearest ancestors that say something say: a section's tag, and class words.

    Nodes of one surrounding share one tuple.
    """
    out: list[tuple[str, ...]] = []
    said: list[tuple[str, tuple[str, ...]]] = []
    for node in nodes:
        section, hints = said[node.parent] if node.parent >= 0 else ("none", ())
        same = node.tag not in SECTIONS and not node.hints and node.parent >= 0
        section, hints = (node.tag, node.hints) if node.tag in SECTIONS else (section, node.hints or hints)
        said.append((section, hints))
        out.append(out[node.parent] if same else (f"within {section}", *[f"under {h}" for h in dict.fromkeys(hints)]))
    return out


def features(node: Node, context: tuple[str, ...]) -> list[str]:
    """Names of what a node shows, and what it stands in."""
    share = node.linked / node.chars if node.chars else 0
    kind = "leaf" if node.parts is not None else "block"
    out = [
        *context,
        f"{kind} chars {min(node.chars.bit_length(), 13) // 2}",
        f"{kind} links {0 if not node.linked else 1 if share < 0.3 else 2 if share < 0.7 else 3}",
    ]
    if node.parts is None:
        out.append(f"tag {node.tag}")
        out += [f"hint {h}" for h in dict.fromkeys(node.hints)]
    return out


class Model:
    """bias and weights of the logistic score, and the log potentials of (parent, child) labels by kind of child."""

    def __init__(self, weights: dict[str, float], ties: dict[str, tuple[float, float, float, float]]):
        self.weights, self.ties = weights, ties

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Log odds of content of every node, by sum-product: children to parents, then parents to children."""
        weight = self.weights.get
        around: dict[int, float] = {}  # the score of each surrounding, by its tuple
        own, surroundings = [], contexts(nodes)
        for node, context in zip(nodes, surroundings):
            if id(context) not in around:
                around[id(context)] = sum([weight(f, 0.0) for f in context], weight("bias", 0.0))
            own.append(sum([weight(f, 0.0) for f in features(node, ())], around[id(context)]))
        up = [0.0] * len(nodes)
        total = own[:]  # own score and the children's messages
        for k in range(len(nodes) - 1, 0, -1):
            node = nodes[k]
            up[k] = _message(total[k], self.ties["#" if node.parts is not None else "b"])
            total[node.parent] += up[k]
        for k in range(1, len(nodes)):
            node = nodes[k]
            t00, t01, t10, t11 = self.ties["#" if node.parts is not None else "b"]
            total[k] += _message(total[node.parent] - up[k], (t00, t10, t01, t11))
        return total


def _message(odds: float, tie: tuple[float, float, float, float]) -> float:
    """The log odds that a neighbour of these log odds sends: tie holds log potentials of (receiver, sender)."""
    t00, t01, t10, t11 = tie
    return _log_sum(t10, t11 + odds) - _log_sum(t00, t01 + odds)


def _log_sum(a: float, b: float) -> float:
    return a + log1p(exp(b - a)) if a >= b else b + log1p(exp(a - b))


def block_text(node: Node) -> str:
    return " ".join("".join(node.parts).split())


def extract(html: str | None, model: Model) -> str:
    """The main text: blocks whose odds favour content, in page order, joined by two line ends."""
    if not html:
        return ""
    nodes = parse(html)
    odds = model.marginals(nodes)
    texts = [block_text(n) for n, o in zip(nodes, odds) if n.parts is not None and o > 0]
    return "\n\n".join(t for t in texts if t)


# Training.

_CONTENT_HINTS = ["content", "post", "entry", "article", "story", "main", "body", "text", "page"]
_OTHER_HINTS = {
    "nav": ["nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "toc", "pagination"],
    "head": ["header", "masthead", "top", "logo", "branding"],
    "foot": ["footer", "bottom", "copyright", "legal", "colophon"],
    "side": ["sidebar", "side", "aside", "widget", "related", "recommended", "trending", "popular"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner"],
    "note": ["cookie", "cookies", "notice", "consent", "gdpr", "alert", "popup", "modal", "overlay", "paywall"],
    "form": ["form", "subscribe", "newsletter", "signup", "login", "search", "contact"],
    "talk": ["comments", "comment", "discussion", "replies", "reply", "responses", "disqus"],
    "share": ["share", "social", "sharing", "tags", "meta", "byline"],
}


def labelled_page(draw: random.Random) -> str:
    """A page whose content text is marked with a leading U+0001 in every block."""

    def words(low: int, high: int) -> str:
        mark = draw.choice(["", "", "", "", " |", "***", "%%%", " &amp;"])
        out = " ".join("".join(draw.choice("abcdeilmnorstuhé") for _ in range(draw.randint(1, 9))) + mark for _ in range(draw.randint(low, high)))
        return out + draw.choice([".", ".", "", "!"])

    def menu() -> str:
        return "<ul>" + "".join(f'<li><a href="/x">{words(1, 3)}</a></li>' for _ in range(draw.randint(2, 9))) + "</ul>"

    def plain() -> str:
        return draw.choice([words(2, 12), f"<p>{words(4, 60)}</p>", f"<p>{words(3, 20)}</p><p>{words(3, 40)}</p>", f"<h3>{words(1, 4)}</h3><p>{words(3, 30)}</p>"])

    def other(kind: str) -> str:
        hint = draw.choice(_OTHER_HINTS[kind])
        attribute = f' {draw.choice(["class", "id"])}="{hint}{draw.choice(["", "-1", " box", "-wrap"])}"'
        tag = {"nav": ["nav", "nav", "div"], "head": ["header", "header", "div"], "foot": ["footer", "footer", "div"], "side": ["aside", "div"], "form": ["form", "div"], "talk": ["section", "div", "div"]}.get(kind, ["div", "section"])
        tag = draw.choice(tag)
        if tag in ("nav", "header", "footer", "aside", "form") and draw.random() < 0.5:
            attribute = ""
        inner = {
            "nav": menu, "head": lambda: draw.choice([menu(), f"<div>{words(1, 5)}</div>", f"<p>{words(1, 8)}</p>" + menu()]),
            "foot": lambda: draw.choice([f"&copy; {words(1, 12)}", f"<p>{words(2, 25)}</p>", menu() + f"<p>{words(2, 12)}</p>"]),
            "side": lambda: draw.choice([f"<h3>{words(1, 4)}</h3>" + menu(), plain()]),
            "form": lambda: f"<label>{words(1, 4)}</label><input name=q><button>ok</button>" + draw.choice(["", f"<p>{words(3, 20)}</p>"]),
            "talk": lambda: "".join(f"<div class=comment><p>{words(2, 50)}</p></div>" if draw.random() < 0.5 else f"<p>{words(2, 60)}</p>" for _ in range(draw.randint(1, 6))),
            "share": lambda: draw.choice([menu(), words(1, 6), f"<a href=x>{words(1, 2)}</a> <a href=y>{words(1, 2)}</a>"]),
        }.get(kind, plain)()
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def content() -> str:
        kind = draw.random()
        if kind < 0.66:
            low = draw.choice([1, 1, 5, 20, 60])
            body = f"\1{words(low, low * 6)}"
            return draw.choice([f"<p>{body}</p>", f"<p>{body}</p>", f"<p><b>{body}<br>", f"<p>{body} <a href=x>{words(1, 4)}</a> {words(1, 9)}</p>"])
        if kind < 0.76:
            return f"<h{draw.randint(2, 4)}>\1{words(1, 8)}</h2>"
        if kind < 0.84:
            return "<ul>" + "".join(f"<li>\1{words(2, 20)}</li>" for _ in range(draw.randint(1, 6))) + "</ul>"
        if kind < 0.9:
            return f"<blockquote><p>\1{words(5, 40)}</p></blockquote>"
        if kind < 0.95:
            return "<table>" + "".join(f"<tr><td>\1{words(1, 3)}</td><td>\1{words(1, 3)}</td></tr>" for _ in range(draw.randint(1, 5))) + "</table>"
        return f"<div>\1{words(5, 40)}</div>"

    inside = [f"<h1>\1{words(1, 12)}</h1>"] if draw.random() < 0.9 else []
    inside += [content() for _ in range(draw.choice([1, 2, 4, 8, 16, 30]))]
    for kind in ("ad", "share", "form", "talk", "side", "note"):
        if draw.random() < 0.3:
            inside.insert(draw.randint(min(1, len(inside)), len(inside)), other(kind))
    body = "".join(inside)
    shape = draw.random()
    hint = f' {draw.choice(["class", "id"])}="{draw.choice(_CONTENT_HINTS)}"'
    if shape < 0.45:
        body = f"<article{draw.choice(['', hint])}>{body}</article>"
    elif shape < 0.6:
        body = f"<main>{body}</main>"
    elif shape < 0.8:
        body = f"<div{hint}>{body}</div>"
    else:
        body = f"<main><article>{body}</article></main>" if shape < 0.9 else f"<section{hint}>{body}</section>"
    before = [other(k) for k in ("head", "nav", "note", "ad", "side", "form") if draw.random() < 0.5]
    after = [other(k) for k in ("share", "talk", "side", "ad", "form", "note", "foot") if draw.random() < 0.45]
    draw.shuffle(before)
    if draw.random() < 0.3:
        body = f"<div{draw.choice(['', ' id=wrapper', ' class=container'])}>{''.join(before)}{body}{''.join(after)}</div>"
        before, after = [], []
    return f"<html><head><title>x</title></head><body>{''.join(before)}{body}{''.join(after)}</body></html>"


def label(nodes: list[Node]) -> None:
    """A leaf is content if marked; a block is if most of its text is."""
    marked = [0] * len(nodes)
    for k in range(len(nodes) - 1, -1, -1):
        node = nodes[k]
        if node.parts is not None and "\1" in "".join(node.parts):
            marked[k] = node.chars
        node.label = 2 * marked[k] > node.chars
        if node.parent >= 0:
            marked[node.parent] += marked[k]


@lru_cache(1)
def train(pages: int = TRAIN_PAGES, seed: int = 11) -> Model:
    """Logistic weights by gradient steps on all nodes of the labelled pages, and potentials from counted label pairs."""
    draw = random.Random(seed)
    rows, labels, pairs = [], [], Counter()
    for _ in range(pages):
        nodes = parse(labelled_page(draw))
        label(nodes)
        for node, context in zip(nodes, contexts(nodes)):
            rows.append(["bias", *features(node, context)])
            labels.append(node.label)
            if node.parent >= 0:
                pairs["#" if node.parts is not None else "b", nodes[node.parent].label, node.label] += 1
    counts = Counter(f for r in rows for f in r)
    names = {f: k for k, f in enumerate(sorted(f for f, c in counts.items() if c >= 3))}
    at = np.array([(i, names[f]) for i, r in enumerate(rows) for f in r if f in names])
    y, w = np.array(labels, float), np.zeros(len(names))
    pace = np.zeros(len(names))
    for _ in range(400):  # full-batch steps, each weight at its own pace
        score = np.bincount(at[:, 0], w[at[:, 1]], len(y))
        slope = np.bincount(at[:, 1], ((1 / (1 + np.exp(-score))) - y)[at[:, 0]], len(w)) / len(y) + 1e-5 * w
        pace += slope**2
        w -= 0.3 * slope / (np.sqrt(pace) + 1e-9)
    ties = {}
    for kind in "#b":
        table_ = np.array([[pairs[kind, bool(a), bool(b)] + 1.0 for b in (0, 1)] for a in (0, 1)])
        joint = table_ / table_.sum()
        tie = np.log(joint / joint.sum(1, keepdims=True) / joint.sum(0, keepdims=True))
        ties[kind] = tuple(tie.ravel().tolist())
    return Model({f: float(w[k]) for f, k in names.items()}, ties)


def extract_pages(pages: DataFrame, model: Model | None = None, html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page, from its whole html; a null html gives an empty text.

    Repeated rows give repeated results, an empty table none; a null id or url stays null (as does the one id -2**63). Pages
    of any length and depth take time in proportion to their length. Other columns are not read.
    """
    model = model or train()
    weights, ties = model.weights, model.ties

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Model(weights, ties)
        for batch in batches:
            texts = [extract(h, own) for h in batch["html"].tolist()]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": np.array([len(t) for t in texts], np.int64)})

    bounded_batches(pages)
    picked = pages.select(plain_id(pages["page_id"]).alias("page_id"), "url", pages[html_col].alias("html"))
    return restored(picked.mapInPandas(run, "page_id long, url string, text string, n_chars long"), "page_id")


def query(spark, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
