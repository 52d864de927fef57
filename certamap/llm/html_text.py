"""Main text of web pages by minimum cut.

A page becomes a graph of its text blocks and of the elements around them. Two linear classifiers give the terminal
capacities: one sees a block's own text (length, links, punctuation, the tag it stands in), one an element's tag,
names and role. Smoothness edges tie a block to its element, an element to the one around it, and blocks that follow
one another, the more loosely the further apart they are in the document tree. The maximum flow separates content from boilerplate:
a short line goes with its article, a long sentence with its advert.

Both classifiers are fitted on pages that `labelled_pages` writes, FIT_PAGES of them.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from certamap.llm.common import table

#: Fixed lists. Elements whose text is never shown (the first two hold no markup and end the page if they are not closed); that are boilerplate by themselves; that start a block; that have no end tag.
CODE = frozenset("script style".split())
RAW = CODE | frozenset("template noscript textarea iframe svg math object title".split())
BOILER = frozenset("head nav footer aside form menu button select option label dialog".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul button label".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that an opening tag of the same group ends.
ENDS_SELF = {"p": ("p",), "li": ("li",), "option": ("option",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
BAD_NAMES = frozenset("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent notice notices alert popup modal overlay nav navbar navigation navigational menu menubar breadcrumb breadcrumbs sidebar sidebars aside widget widgets footer foot masthead topbar toolbar comment comments commentlist disqus reply replies respond share sharing social related recommended recommendations newsletter subscribe subscription signup login search pagination pager tags copyright legal disclaimer skip hidden".split())
GOOD_NAMES = frozenset("article content post entry story main body text".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
#: After these a name says what a page has, not what an element is (with-sidebar).
HAS = frozenset("with has no without".split())

#: Pages that the classifiers are fitted on, the seed they are written with, and the ridge of the fit.
FIT_PAGES, SEED, RIDGE = 300, 7, 1.0
#: Strength of an edge from a block to its element, and for each block under it from an element to the one around it; of one between blocks that follow one another, and its decay with every step between them.
TIE, NEXT, DECAY = 3.0, 1.5, 0.7
#: Steps beyond which blocks count as this far apart.
FAR = 20

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_CLOSE = {tag: re.compile(rf"</{tag}\s*>|(?=</head\s*>|<body[\s>])" if tag == "title" else rf"</{tag}\s*>", re.I) for tag in RAW}
_ATTR = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
_END = re.compile(r"[.!?…:;][\"'”»)\]]*$")
#: Capacity that counts as none.
_LEAST = 1e-9
_STOPS = re.compile(r"[.,;!?](?:\s|$)")


@dataclass(eq=False)
class Node:
    """An element. evidence: 1 for what holds of boiler tag, bad name, bad role or hidden, article, main, good name, page header."""

    tag: str
    depth: int
    parent: Node | None
    evidence: tuple[int, ...]
    bad: bool  # it or an element around it speaks for boilerplate
    inside: bool  # it or an element around it is an article or the main part
    blocks: int = 0  # under it


@dataclass(eq=False)
class Block:
    text: str
    links: int
    node: Node


def _node(tag: str, attrs: str, up: Node | None) -> Node:
    got = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)} if attrs.strip() else {}
    listed = [x.lower() for x in _NAME.findall(f"{got.get('class', '')} | {got.get('id', '')}")] if got and tag not in ("html", "body") else []
    names = {x for k, x in enumerate(listed) if not k or listed[k - 1] not in HAS}
    role = got.get("role", "").lower()
    shut = role in BAD_ROLES or "hidden" in got or got.get("aria-hidden") == "true" or "display:none" in got.get("style", "").replace(" ", "")
    under, inside = bool(up and up.bad), bool(up and up.inside)
    against = (tag in BOILER, bool(names & BAD_NAMES), shut, tag == "header" and not inside)
    # what an element in a menu, an advert or the comments calls itself says nothing for it
    good = (False, False, False) if under else (tag == "article", tag == "main" or role == "main", bool(names & GOOD_NAMES))
    return Node(tag, up.depth + 1 if up else 0, up, tuple(map(int, (*against[:3], *good, against[3]))), under or any(against), inside or good[0] or good[1])


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, with white space collapsed and character references decoded.

    What is never shown ends at its end tag; where that is missing, script and style run to the end of the page as in a
    browser, and of other elements the tag alone goes. A head ends where a body or any block starts.
    """
    out: list[Block] = []
    here = _node("html", "", None)
    text: list[str] = []
    unclosed: set[str] = set()
    links = in_link = at = 0

    def close() -> None:
        nonlocal links
        if text:
            if got := _SPACE.sub(" ", html.unescape("".join(text))).strip():
                out.append(Block(got, min(links, len(got)), here))
            text.clear()
        links = 0

    def say(part: str) -> None:
        nonlocal links
        text.append(part)
        if in_link:
            links += len(part)

    while m := _TOKEN.search(page, at):
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag in RAW:
            if not m["end"] and not m[0].endswith("/>") and tag not in unclosed:
                if ends := _CLOSE[tag].search(page, at):
                    at = ends.end()
                elif tag in CODE:
                    at = len(page)
                else:
                    unclosed.add(tag)
        elif tag == "a":
            in_link = 0 if m["end"] else 1
        elif tag == "br":
            say(" ")
        elif tag in BLOCK:
            close()
            in_link = 0
            if not m["end"]:
                ends = ENDS_SELF.get(tag, ("p",))
                up: Node | None = here
                while up and up.tag in ("p", "li", "option", "dt", "dd", "tr", "td", "th", "head"):
                    if up.tag in ends or up.tag == "head":
                        here = up.parent or here
                        break
                    up = up.parent
                if tag not in VOID:
                    here = _node(tag, m["attrs"] or "", here)
            else:
                up = here
                while up and up.tag != tag:
                    up = up.parent
                if up and up.parent:
                    here = up.parent
    if at < len(page):
        say(page[at:])
    close()
    return out


def seen(b: Block) -> list[float]:
    """What the first classifier sees of a block: its own text and tag, nothing of what is around it."""
    n, t = len(b.text), b.node.tag
    words = b.text.count(" ") + 1
    return [
        min(math.log1p(n) / 3, 2.5),
        b.links / n,
        float(bool(_END.search(b.text))),
        min(1.0, 4.0 * len(_STOPS.findall(b.text)) / words),
        float(words < 4),
        float("©" in b.text),
        float(t in ("p", "blockquote", "pre")),
        float(t in ("h1", "h2", "h3")),
        float(t in ("li", "option", "button", "label")),
    ]


def apart(a: Node, b: Node) -> int:
    """Steps between two nodes of the document tree, FAR at the most."""
    steps = 0
    while a is not b and steps < FAR:
        if a.depth >= b.depth and a.parent:
            a = a.parent
        elif b.parent:
            b = b.parent
        else:
            break
        steps += 1
    return steps


def min_cut(odds: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: content) of least total cost: -odds for content where odds is negative, odds for boilerplate, and a tie's strength where its ends differ."""
    n = len(odds)
    label: list[bool | None] = [None] * n
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for a, b, c in ties:
        near[a].append((b, c))
        near[b].append((a, c))
    own, loose = list(odds), [sum(c for _, c in x) for x in near]
    queue = deque(range(n))
    while queue:  # a block whose own cost outweighs all its open ties keeps that label in any minimum cut
        i = queue.popleft()
        if label[i] is None and abs(own[i]) > loose[i]:
            label[i] = own[i] > 0
            for j, c in near[i]:
                if label[j] is None:
                    own[j] += c if label[i] else -c
                    loose[j] -= c
                    queue.append(j)
    free = [i for i in range(n) if label[i] is None]
    at = {i: k for k, i in enumerate(free)}
    s, t = len(free), len(free) + 1
    arcs: list[list[int]] = [[] for _ in range(len(free) + 2)]
    head: list[int] = []
    cap: list[float] = []

    def join(a: int, b: int, there: float, back: float) -> None:
        arcs[a].append(len(head))
        arcs[b].append(len(head) + 1)
        head.extend((b, a))
        cap.extend((there, back))

    for i in free:
        if own[i] > 0:
            join(s, at[i], own[i], 0.0)
        elif own[i] < 0:
            join(at[i], t, -own[i], 0.0)
    for a, b, c in ties:
        if a in at and b in at:
            join(at[a], at[b], c, c)
    while True:  # blocking flows by distance from the source; an arc that leads nowhere is not tried again
        far = [-1] * len(arcs)
        far[s] = 0
        line = deque([s])
        while line:
            a = line.popleft()
            for e in arcs[a]:
                if cap[e] > _LEAST and far[head[e]] < 0:
                    far[head[e]] = far[a] + 1
                    line.append(head[e])
        if far[t] < 0:
            break
        tried, path, a = [0] * len(arcs), [], s
        while True:
            if a == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                cut_at = next(k for k, e in enumerate(path) if cap[e] <= _LEAST)
                a = head[path[cut_at] ^ 1]
                del path[cut_at:]
            while tried[a] < len(arcs[a]):
                e = arcs[a][tried[a]]
                if cap[e] > _LEAST and far[head[e]] == far[a] + 1:
                    break
                tried[a] += 1
            else:
                if a == s:
                    break
                e = path.pop()
                a = head[e ^ 1]
                tried[a] += 1
                continue
            path.append(e)
            a = head[e]
    for i in free:
        label[i] = far[at[i]] >= 0
    return [bool(x) for x in label]


@dataclass(frozen=True)
class Weights:
    """Log-odds of content: a constant and a weight for each thing that is seen of a block, and of an element."""

    block: tuple[float, ...]
    element: tuple[float, ...]

    def of_block(self, b: Block) -> float:
        return self.block[0] + sum(w * x for w, x in zip(self.block[1:], seen(b), strict=True))

    def of_element(self, n: Node) -> float:
        return sum(w for w, x in zip(self.element, n.evidence, strict=True) if x)


def graph(got: list[Block], weights: Weights) -> tuple[list[float], list[tuple[int, int, float]]]:
    """(log-odds, edges) of the blocks, then of the elements that have evidence or several blocks. An element's log-odds count for each block under it."""
    elements: dict[int, Node] = {}
    for b in got:
        b.node.blocks += 1
        n: Node | None = b.node
        while n and id(n) not in elements:
            elements[id(n)] = n
            n = n.parent
    order = sorted(elements.values(), key=lambda n: n.depth)
    for n in reversed(order):
        if n.parent:
            n.parent.blocks += n.blocks
    odds, ties, at = [weights.of_block(b) for b in got], [], {}
    for n in order:  # at: the node of the graph that an element is, or that is around it
        out = at.get(id(n.parent))
        if any(n.evidence) or n.blocks > 1 and n.tag not in ("html", "body"):
            if out is not None:
                ties.append((len(odds), out, TIE * n.blocks))
            out = len(odds)
            odds.append(weights.of_element(n) * n.blocks)
        at[id(n)] = out
    for i, b in enumerate(got):
        if at[id(b.node)] is not None:
            ties.append((i, at[id(b.node)], TIE))
        if i:
            ties.append((i - 1, i, NEXT * DECAY ** apart(got[i - 1].node, b.node)))
    return odds, ties


def labelled(page: str, weights: Weights) -> list[tuple[Block, float, bool]]:
    """(block, its own log-odds, whether the cut has it as content) for the blocks of a page."""
    got = blocks(page)
    odds, ties = graph(got, weights)
    return list(zip(got, odds, min_cut(odds, ties), strict=False))


def main_text(page: str | None, weights: Weights | None = None) -> str:
    """The content blocks of a page, joined by line ends; empty if there are none."""
    return "\n".join(b.text for b, _, keep in labelled(page or "", weights or fitted()) if keep)


def labelled_pages(n: int, seed: int) -> Iterator[tuple[str, frozenset[str]]]:
    """(page, the texts of its content blocks): pages as sites make them, some without any telling tag or name."""
    rng = np.random.default_rng(seed)
    size = lambda lo, hi: int(rng.integers(lo, hi))
    chance = lambda p: rng.random() < p
    one = lambda xs: xs[size(0, len(xs))]
    bad, roles = sorted(BAD_NAMES), sorted(BAD_ROLES)
    letters = list("aeiounrstlmdéäñ")
    word = lambda: "".join(rng.choice(letters, size(2, 10)))
    sentence = lambda k: " ".join([word().title(), *(word() + ("," if chance(0.1) else "") for _ in range(k))]) + one(".....?!")
    prose = lambda: " ".join(sentence(size(3, 14)) for _ in range(size(1, 7)))
    title = lambda: " ".join(word() for _ in range(size(2, 9)))
    link = lambda t: f'<a href="/{word()}">{t}</a>'
    div = lambda names, inner: f"<div {names}>{inner}</div>" if names else f"<div>{inner}</div>"

    def content() -> tuple[str, list[str]]:
        parts, texts = [], []

        def put(tag: str, text: str, linked: str = "") -> None:
            parts.append(f"<{tag}>{text}{linked and ' ' + link(linked)}</{tag}>")
            texts.append(f"{text} {linked}".strip())

        put("h1", title() + ("." if chance(0.3) else ""))
        for _ in range(size(1, 8)):
            kind = rng.random()
            if kind < 0.6:
                put("p", prose(), word() if chance(0.2) else "")
            elif kind < 0.72:
                put("p", " ".join(word() for _ in range(size(1, 5))) + one(["", ".", ""]))
            elif kind < 0.82:
                put(one(["h2", "h3"]), *(("", title()) if chance(0.2) else (title(),)))
            elif kind < 0.9:
                put("blockquote", prose())
            else:
                items = [title() + one(["", "."]) for _ in range(size(2, 6))]
                linked = chance(0.2)
                parts.append("<ul>" + "".join(f"<li>{link(x) if linked else x}</li>" for x in items) + "</ul>")
                texts.extend(items)
        return "".join(parts), texts

    def boilerplate() -> str:
        kind, how = size(0, 8), rng.random()
        name = f'class="{one(bad)}"' if how < 0.75 else f'role="{one(roles)}"' if how < 0.85 else ""
        if kind == 0:
            inner = "<ul>" + "".join(f"<li>{link(title())}</li>" for _ in range(size(3, 9))) + "</ul>"
            return f"<nav>{inner}</nav>" if chance(0.6) else div(name, inner)
        if kind == 1:
            return div(name, prose() if chance(0.7) else link(title()))
        if kind == 2:
            return f"<footer>&copy; {word()}.example.com &middot; {prose() if chance(0.5) else title()}</footer>" if chance(0.7) else div(name, f"&copy; {title()} <a href='/'>{title()}</a>")
        if kind == 3:
            return f"<aside><h3>{title()}</h3><p>{prose()}</p></aside>" if chance(0.6) else div(name, f"<h3>{title()}</h3><p>{link(title())}</p>")
        if kind == 4:
            return f"<form><label>{title()}</label><input><button>{word()}</button></form>"
        if kind == 5:
            each = "".join((f"<article><p>{prose()}</p></article>" if chance(0.3) else f"<p>{prose()}</p>") for _ in range(size(1, 5)))
            return f'<section id="{one(["comments", "respond", "disqus"])}">{each}</section>'
        if kind == 6:
            return f"<header><p>{title()}</p></header>"
        return div(name, "<p>" + " | ".join(link(word()) for _ in range(size(3, 9))) + "</p>")

    for _ in range(n):
        inner, texts = content()
        middle = boilerplate() if chance(0.2) else ""
        kind = rng.random()
        if kind < 0.45:
            body = f"<article>{inner}{middle}</article>"
        elif kind < 0.6:
            body = f"<main>{inner}{middle}</main>"
        elif kind < 0.8:
            body = div(one(['class="post-content"', 'id="entry"', 'class="story-body"', 'class="article-text"']), inner + middle)
        else:
            body = div("", inner) + middle if chance(0.5) else inner + middle
        before, after = ("".join(boilerplate() for _ in range(size(0, 4))) for _ in range(2))
        yield f"<!DOCTYPE html><html><head><title>{title()}</title></head><body>{before}{body}{after}</body></html>", frozenset(texts)


def _logistic(x: np.ndarray, y: np.ndarray, free: int) -> tuple[float, ...]:
    """Weights of a logistic regression with a ridge on all but the first `free` columns."""
    w, ridge = np.zeros(x.shape[1]), np.where(np.arange(x.shape[1]) < free, 1e-6, RIDGE)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
    return tuple(float(v) for v in w)


@functools.cache
def fitted(pages: int = FIT_PAGES, seed: int = SEED) -> Weights:
    """Both classifiers, fitted on generated pages: blocks by their labels, elements with evidence by those of the blocks under them."""
    x, y, ex, ey = [], [], [], []
    for page, texts in labelled_pages(pages, seed):
        for b in blocks(page):
            good = b.text in texts
            x.append([1.0, *seen(b)])
            y.append(good)
            n: Node | None = b.node
            while n and not any(n.evidence):
                n = n.parent
            if n:
                ex.append(n.evidence)
                ey.append(good)
    return Weights(_logistic(np.array(x), np.array(y, float), 1), _logistic(np.array(ex, float), np.array(ey, float), 0))


def extract(pages: DataFrame, html_col: str = "html", out: str = "main_text", weights: Weights | None = None) -> DataFrame:
    """`pages` with one more column: the main text of every whole page.

    Nulls and pages without content give an empty text; other columns pass through (one named `out` is replaced);
    repeated rows are treated alike; an empty table stays empty.
    """
    rest, weights = pages.drop(out), weights or fitted()
    at = rest.columns.index(html_col)
    schema = T.StructType([*rest.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = pa.array([main_text(x, weights) for x in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, got], names=schema.names)

    return rest.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return got.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))
