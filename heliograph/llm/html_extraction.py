"""Main text of web pages by a tree-structured graphical model.

Block elements of a page form a tree, and so do their labels, article or not. A
node has a potential from its tag, the words in its class, id and role, its
text and its links; a parent and child have one for each pair of labels. One
sum-product pass upward and one downward give each node's exact marginal, and text
in nodes with a marginal of 0.5 or more is the article's. Weights are trained as
a conditional random field, by gradient ascent with those marginals, on labelled pages.

Passes run over all nodes of a batch of pages at once, level by level.

Defined results: null and empty html give empty text; html is never rejected:
unclosed, crossed and stray tags are read as browsers roughly do; scripts, styles,
comments and other markup hold no text; a very deep tree costs a step a level; null
ids and urls pass through; repeated rows each get a row; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_pages import labelled_pages
from .shared import python_workers

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html iframe ins label legend li main menu nav object ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template textarea title svg math canvas audio video iframe object noembed noframes xmp".split())
FORMS = frozenset("button input select option optgroup datalist output progress meter".split())
#: An element that opens closes these if they are open in the same container.
CLOSES = {t: frozenset(["p"]) for t in BLOCKS} | {"li": frozenset(["p", "li"]), "dt": frozenset(["p", "dt", "dd"]), "dd": frozenset(["p", "dt", "dd"]), "tr": frozenset(["p", "td", "th", "tr"]), "td": frozenset(["p", "td", "th"]), "th": frozenset(["p", "td", "th"]), "option": frozenset(["option"]), "tbody": frozenset(["tr", "td", "th", "tbody", "thead"]), "ins": frozenset()}
SCOPE = frozenset("html body div article section main aside nav header footer form table ul ol dl blockquote figure td th".split())
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
NAMES = re.compile(r"(?:\b(?:class|id|role|itemprop))\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPACE = re.compile(r"\s+")

_raw_end: dict[str, re.Pattern] = {}


class Tree(NamedTuple):
    parent: list[int]
    features: list[list[str]]
    segments: list[tuple[int, str]]  # (node, text) in page order
    starts: list[int]  # where in the html each node begins


def parse(page: str | None) -> Tree:
    page = page or ""
    parent, tags, names, starts = [-1], ["#page"], [()], [0]
    chars, links = [0], [0]
    segments: list[tuple[int, str]] = []
    stack = [0]
    pieces: list[str] = []
    linked = in_link = 0
    skip: list[str] = []  # open form controls and inline-level svg-like elements

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = SPACE.sub(" ", "".join(pieces)).strip()
            pieces.clear()
            if text:
                segments.append((stack[-1], text))
                chars[stack[-1]] += len(text)
                links[stack[-1]] += min(linked, len(text))
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw and not skip:
            text = html.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if in_link:
                linked += len(text.strip())

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        m = TOKEN.match(page, lt)
        if m is None:
            say(page[at : lt + 1])
            at = lt + 1
            continue
        say(page[at:lt])
        at = m.end()
        tag = m.group(2)
        if tag is None:
            if m.group().startswith("<![CDATA["):
                say(html.escape(m.group()[9:].removesuffix("]]>")))
            continue
        tag = tag.lower()
        if m.group(1):
            if tag == "a":
                in_link = 0
            elif tag in FORMS:
                if tag in skip:
                    del skip[skip.index(tag) :]
            elif tag in BLOCKS:
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] == tag or tag in HEADINGS and tags[stack[k]] in HEADINGS:
                        flush()
                        del stack[k:]
                        in_link = 0
                        break
                    if tag == "p" and tags[stack[k]] in SCOPE:
                        break
            continue
        if tag in RAW:
            if not m.group(3).rstrip().endswith("/") or tag not in ("svg", "math"):
                if tag not in _raw_end:
                    _raw_end[tag] = re.compile(rf"</{tag}\b[^>]*(?:>|$)", re.I)
                end = _raw_end[tag].search(page, at)
                at = end.end() if end else n
            if not skip:
                pieces.append(" ")
            continue
        if tag in FORMS:
            if tag not in ("input",):
                skip.append(tag)
            continue
        if tag in BLOCKS:
            flush()
            skip.clear()
            in_link = 0
            shut = CLOSES[tag]
            if shut:
                for k in range(len(stack) - 1, 0, -1):
                    t = tags[stack[k]]
                    if t in shut:
                        del stack[k:]
                        shut -= {t}
                    elif t in SCOPE and not (t in ("td", "th") and tag == "tr"):
                        break
            if tag == "hr":
                continue
            node = len(parent)
            parent.append(stack[-1])
            tags.append(tag)
            attrs = m.group(3)
            names.append(tuple({x.lower() for g in NAMES.findall(attrs) for x in NAME.findall("".join(g))}) if "=" in attrs else ())
            chars.append(0)
            links.append(0)
            starts.append(lt)
            stack.append(node)
        elif tag == "a":
            in_link = 1
        elif tag in ("br", "img", "wbr"):
            if tag != "wbr" and not skip:
                pieces.append(" ")
    flush()
    own = list(chars)
    for k in range(len(parent) - 1, 0, -1):  # children come after their parent
        chars[parent[k]] += chars[k]
        links[parent[k]] += links[k]
    features = []
    for k in range(len(parent)):
        f = ["1", "t:" + tags[k], f"n:{_bucket(chars[k])}", f"o:{_bucket(own[k])}", f"l:{-1 if not chars[k] else min(3, 4 * links[k] // chars[k])}"]
        f += ["c:" + x for x in names[k]]
        features.append(f)
    return Tree(parent, features, segments, starts)


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def _bucket(n: int) -> int:
    return 0 if not n else 1 if n < 25 else 2 if n < 80 else 3 if n < 300 else 4


class Model(NamedTuple):
    weights: dict[str, float]
    pair: np.ndarray  # log potential by the parent's and the child's label


def _levels(parent: np.ndarray) -> list[np.ndarray]:
    """Nodes by depth, the roots (parent -1) first."""
    depth = np.zeros(len(parent), np.int64)
    for k in np.flatnonzero(parent >= 0).tolist():
        depth[k] = depth[parent[k]] + 1
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(order) else []


def sum_product(parent: np.ndarray, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(marginal of label 1 of each node, joint marginals of parent's and own label of each node that has a parent).

    parent: of each node, before it, or -1; unary: log potential of label 1 over label 0.
    """
    n, levels = len(parent), _levels(parent)
    up = np.zeros((n, 2))  # own potential and the messages of all children
    up[:, 1] = unary
    message = np.zeros((n, 2))  # from a node to its parent, by the parent's label
    for nodes in levels[:0:-1]:
        x = pair[None] + up[nodes][:, None, :]
        m = np.logaddexp(x[..., 0], x[..., 1])
        message[nodes] = m - m.max(1, keepdims=True)
        for s in (0, 1):
            up[:, s] += np.bincount(parent[nodes], message[nodes, s], n)
    down = np.zeros((n, 2))
    joint = np.zeros((n, 2, 2))
    for nodes in levels[1:]:
        p = parent[nodes]
        rest = up[p] + down[p] - message[nodes]
        x = rest[:, :, None] + pair[None]
        m = np.logaddexp(x[:, 0], x[:, 1])
        down[nodes] = m - m.max(1, keepdims=True)
        j = x + up[nodes][:, None, :]
        j = np.exp(j - j.max((1, 2), keepdims=True))
        joint[nodes] = j / j.sum((1, 2), keepdims=True)
    belief = up + down
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -60, 60))), joint


def train(pages: list[list[tuple[bool, str]]] | None = None, *, steps: int = 120, rate: float = 0.15, decay: float = 2e-3) -> Model:
    """pages: runs of html and whether each is of the article, as labelled_pages() gives them."""
    parent, label, features = [], [], []
    for runs in pages if pages is not None else labelled_pages():
        edges, at = [], 0
        for good, run in runs:
            edges.append((at, good))
            at += len(run)
        t = parse("".join(run for _, run in runs))
        base = len(parent)
        at = np.array([e[0] for e in edges])
        for k, p in enumerate(t.parent):
            parent.append(base + p if p >= 0 else -1)
            # Empty runs share their place with the next one, which holds what begins there.
            label.append(k > 0 and edges[int(np.searchsorted(at, t.starts[k], side="right")) - 1][1])
            features.append(t.features[k])
    parent_, y = np.array(parent), np.array(label, float)
    index = {f: i for i, f in enumerate(sorted({f for fs in features for f in fs}))}
    node = np.repeat(np.arange(len(features)), [len(f) for f in features])
    column = np.array([index[f] for fs in features for f in fs])
    has = parent_ >= 0
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[parent_[has]].astype(int), y[has].astype(int)), 1)
    w, pair = np.zeros(len(index)), np.zeros((2, 2))
    gw, gp = np.full(len(index), 1e-8), np.full((2, 2), 1e-8)
    for _ in range(steps):
        unary = np.bincount(node, w[column], len(parent_))
        marginal, joint = sum_product(parent_, unary, pair)
        dw = np.bincount(column, (y - marginal)[node], len(index)) / len(y) - decay * w / 10
        dp = (seen - joint[has].sum(0)) / len(y) - decay * pair / 10
        gw += dw * dw
        gp += dp * dp
        w += rate * dw / np.sqrt(gw) * 2
        pair = pair + rate * dp / np.sqrt(gp)
    return Model({f: float(w[i]) for f, i in index.items()}, pair)


def extract(pages: list[str | None], model: Model) -> list[str]:
    trees = [parse(p) for p in pages]
    sizes = np.array([len(t.parent) for t in trees], np.int64)
    first = np.cumsum(sizes) - sizes
    parent = np.array([p + b if p >= 0 else -1 for t, b in zip(trees, first.tolist(), strict=True) for p in t.parent], np.int64)
    weight = model.weights.get
    unary = np.array([sum(weight(f, 0.0) for f in fs) for t in trees for fs in t.features])
    good = sum_product(parent, unary, model.pair)[0] >= 0.5
    return ["\n".join(text for node, text in t.segments if good[b + node]) for t, b in zip(trees, first.tolist(), strict=True)]


def main_text(pages: DataFrame, model: Model | None = None, *, html_column: str = "html") -> DataFrame:
    """page_id and url, where pages have them, and text and n_chars; one row a page."""
    python_workers(pages.sparkSession)
    model = model or train()
    keep = [c for c in ("page_id", "url") if c in pages.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = extract(part.column(len(keep)).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in keep)
    return pages.select(*keep, F.col(html_column).alias("h")).mapInArrow(run, f"{kinds}, text string, n_chars long")
