"""Main text of web pages by a tree-structured graphical model of their DOM.

A page's blocks and runs of text are the nodes of a tree, each with a hidden state: main text or not. A node's features (tag, names, length, links,
sentences, place) are its unary potential, and each edge has a potential of the states of parent and child, by the tag of the child. Sum-product
messages go from the leaves to the root and back, level by level for many pages at once, and give the exact marginal of each node. The text
of the runs whose marginal is HALF or more is the page's main text.

The weights maximise the likelihood of labelled pages: every state is known there, so the gradient is what is observed less what the messages expect.
Labelled pages are layouts drawn around texts of SAMPLE_PAGES pages of the table (labelled_pages.py), and some of these pages as they are, where they mark
one article themselves, with and without telling tags. The sample is of the lowest hash among pages of SAMPLE_BYTES or less, so it is bounded; it is
learned from in one task. Every page is then extracted, of any length, in one map pass without a shuffle.

A block is a run of text that no block element starts or ends in. Scripts, styles, markup, titles and what stands in fields and buttons are not text. Character
references are read, white space in a block is one space, blocks stand in page order with an empty line between.

Null, empty and blank html give the empty text, and so does a page without main text. Broken markup is read as browsers do. Repeated rows and ids
give a row each; a null id stays null. Pages that are all alike give the same text. Only the named columns are read, whatever else there is. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.markup import INLINE, VOID, Nesting, attributes, marks, plain_text
from tessera.llm.common import mapped_with_id
from tessera.llm.labelled_pages import LABEL, labelled_pages

SAMPLE_PAGES, SAMPLE_BYTES = 300, 1 << 16
DRAWN, OWN = 900, 60
STEPS, RATE, RIDGE = 250, 0.12, 1e-5
#: Features on fewer labelled nodes than this are not learned.
LEAST_SEEN = 4
HALF = 0.5
#: Nodes of pages that are scored at once.
GROUP_NODES = 50_000

#: Text in these is no text of the page.
UNREAD = frozenset(("button", "select", "template", "svg", "math", "object", "canvas", "audio", "video"))
CONTROLS = frozenset(("input", "select", "textarea", "button", "label"))
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_STOPS = re.compile(r"[.!?…。！？](?=\s|$|[\"'”»)])")
_NAMES = {"class", "id", "role"}


class Page:
    """A page's tree. Node 0 is the page; text is None for elements."""

    def __init__(self, source: str | None):
        self.parent, self.tag, self.names, self.text, self.links, self.controls, self.main = [-1], ["page"], [()], [None], [0], [0], [False]
        path, nesting, unread, held, linked, anchors = [0], Nesting(), [], [], 0, 0
        for kind, name, rest in marks(source or ""):
            if kind == "text":
                if not unread:
                    held.append(rest)
                    if anchors:
                        linked += len(rest.strip())
                continue
            if kind == "raw":
                continue
            if name in INLINE or name in VOID:
                if name in CONTROLS and kind == "start":
                    self.controls[path[-1]] += 1
                if name in UNREAD:
                    if kind == "start":
                        unread.append(len(path))
                    elif unread:
                        unread.pop()
                elif name == "a":
                    anchors = 1 if kind == "start" else 0
                elif name == "br":
                    held.append(" ")
                if name != "hr":
                    continue
            self._run(path[-1], held, linked)
            held, linked, anchors = [], 0, 0
            ended = nesting.start(name) if kind == "start" else nesting.end(name)
            if ended:
                del path[-len(ended) :]
                while unread and unread[-1] > len(path):
                    unread.pop()
            if kind == "start" and name not in VOID:
                found = attributes(rest) if rest else {}
                words = {w.lower() for key in _NAMES & found.keys() for w in _WORD.findall(found[key])} if found else ()
                mark = found.get(LABEL) if found else None
                path.append(self._node(path[-1], name, tuple(sorted(words)), None, 0, self.main[path[-1]] if mark is None else mark == "1"))
        self._run(path[-1], held, linked)

    def _node(self, parent: int, tag: str, names: tuple[str, ...], text: str | None, links: int, main: bool) -> int:
        for column, value in ((self.parent, parent), (self.tag, tag), (self.names, names), (self.text, text), (self.links, links), (self.controls, 0), (self.main, main)):
            column.append(value)
        return len(self.parent) - 1

    def _run(self, parent: int, held: list[str], linked: int) -> None:
        text = " ".join("".join(held).split())
        if text:
            self._node(parent, "#text", (), text, linked, self.main[parent])


def size_class(n: float) -> int:
    return min(9, int(math.log2(n + 1)))


def share_class(part: float, whole: float) -> int:
    share = part / whole if whole else 0.0
    return 0 if share < 0.02 else 1 if share < 0.3 else 2 if share < 0.7 else 3


def features(page: Page) -> list[list[str]]:
    """Names of the features of each node."""
    n = len(page.parent)
    chars, links, controls, runs, long, at = [0] * n, list(page.links), list(page.controls), [0] * n, [0] * n, [0] * n
    leaves, before = [], 0
    for i, text in enumerate(page.text):
        at[i] = before
        if text is not None:
            words = text.count(" ") + 1
            chars[i], runs[i] = len(text), 1
            long[i] = int(words >= 10 and page.links[i] < 0.5 * len(text))
            before += len(text)
            leaves.append((i, words))
    for i in range(n - 1, 0, -1):  # children come after their parents
        p = page.parent[i]
        chars[p] += chars[i]
        links[p] += links[i]
        controls[p] += controls[i]
        runs[p] += runs[i]
        long[p] += long[i]
    total = max(1, before)
    out: list[list[str]] = [[] for _ in range(n)]
    for i in range(n):
        if page.text[i] is None:
            tag, start, end = page.tag[i], 4 * at[i] // total, 4 * (at[i] + chars[i]) // total
            big = size_class(chars[i] / 8)
            f = [f"tag {tag}", f"links {share_class(links[i], chars[i])} {big}", f"long {min(3, long[i])}", f"share {share_class(chars[i], total)} {tag in ('body', 'html', 'page')}"]
            f += [f"mean {size_class(chars[i] / max(1, runs[i]) / 4)}", f"place {start} {end}", f"controls {min(2, controls[i])} {min(3, long[i])}", f"before {share_class(sum(long[page.parent[i] : i]) and 1, 1)}"]
            out[i] = f + [f"name {w}" for w in page.names[i]]
    kinds = [(size_class(w), share_class(page.links[i], len(page.text[i]))) for i, w in leaves]
    for k, (i, _) in enumerate(leaves):
        text, (size, link) = page.text[i], kinds[k]
        stops = len(_STOPS.findall(text))
        parent = page.tag[page.parent[i]]
        f = [f"run {size} {link}", f"stops {min(3, stops)} {min(size, 5)}", f"in {parent}", f"run in {parent} {min(size, 4)}", f"at {min(7, 8 * at[i] // total)}"]
        f.append(f"last {text[-1] if text[-1] in '.!?:…»|' else 'w' if text[-1].isalpha() else '-'}")
        for name, j in (("previous", k - 1), ("next", k + 1)):
            f.append(f"{name} {kinds[j][0] // 2} {kinds[j][1]}" if 0 <= j < len(kinds) else f"{name} none")
        if "©" in text or "(c)" in text[:20].lower():
            f.append(f"rights {min(size, 4)}")
        if size <= 2 and any(map(str.isdigit, text)):
            f.append(f"digits {size}")
        out[i] = f
    return out


class Forest:
    """Pages side by side: parents, levels, and features and kinds of edges as numbers."""

    def __init__(self, pages: Sequence[Page], known: dict[str, int], kinds: dict[str, int]):
        parents, depth, nodes, feats, edge = [], [], [], [], []
        for page in pages:
            first = len(parents)
            for i, names in enumerate(features(page)):
                p = page.parent[i]
                parents.append(p + first if p >= 0 else -1)
                depth.append(depth[p + first] + 1 if p >= 0 else 0)
                edge.append(kinds.get(page.tag[i], 0))
                for name in names:
                    k = known.get(name)
                    if k is None and name.startswith("name ") and len(name) > 10:
                        k = next((known[f"name {w}"] for w in _parts(name[5:]) if f"name {w}" in known), None)
                    if k is not None:
                        nodes.append(first + i)
                        feats.append(k)
        self.n = len(parents)
        self.parent, self.edge = np.array(parents, np.int64), np.array(edge, np.int64)
        self.nodes, self.feats = np.array(nodes, np.int64), np.array(feats, np.int64)
        depth = np.array(depth, np.int64)
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if self.n else []
        #: Where another parent's children begin in a level; pages are walked in depth, so a parent's children are side by side there.
        self.first = [np.flatnonzero(np.diff(self.parent[level], prepend=-2)) for level in self.levels]

    def marginals(self, w: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n, 2) marginals of nodes and (n, 2, 2) of edges [parent's state, child's state], by messages up and down."""
        own = np.zeros((self.n, 2))
        own[:, 1] = np.bincount(self.nodes, weights=w[self.feats], minlength=self.n) if len(self.nodes) else 0.0
        pair = edges[self.edge]
        up = np.zeros((self.n, 2))
        for level, first in zip(self.levels[:0:-1], self.first[:0:-1], strict=True):
            up[level] = log_sum(pair[level] + own[level][:, None, :], 2)
            own[self.parent[level[first]]] += np.add.reduceat(up[level], first)
        down = np.zeros((self.n, 2))
        joint = np.full((self.n, 2, 2), -np.inf)
        for level in self.levels[1:]:
            parent = self.parent[level]
            without = own[parent] + down[parent] - up[level]
            both = without[:, :, None] + pair[level] + own[level][:, None, :]
            joint[level] = both - log_sum(log_sum(both, 2), 1)[:, None, None]
            down[level] = log_sum(without[:, :, None] + pair[level], 1)
            down[level] -= down[level].max(1, keepdims=True)
        belief = own + down
        return np.exp(belief - log_sum(belief, 1)[:, None]), np.exp(joint)


def _parts(word: str) -> Iterator[str]:
    """Beginnings and ends of a word, longest first, of four letters and more."""
    for size in range(len(word) - 1, 3, -1):
        yield word[:size]
        yield word[-size:]


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    """Logarithm of the sum over two states."""
    return np.logaddexp(*np.moveaxis(x, axis, 0))


class Model:
    def __init__(self, known: dict[str, int], kinds: dict[str, int], w: np.ndarray, edges: np.ndarray):
        self.known, self.kinds, self.w, self.edges = known, kinds, w, edges

    def marginals(self, pages: Sequence[Page]) -> list[np.ndarray]:
        """Marginal of main text of each node of each page."""
        forest = Forest(pages, self.known, self.kinds)
        held = forest.marginals(self.w, self.edges)[0][:, 1] if forest.n else np.empty(0)
        return np.split(held, np.cumsum([len(p.parent) for p in pages])[:-1])

    def texts(self, sources: Sequence[str | None]) -> Iterator[str]:
        group, nodes = [], 0
        for source in sources:
            page = Page(source)
            group.append(page)
            nodes += len(page.parent)
            if nodes >= GROUP_NODES:
                yield from self._texts(group)
                group, nodes = [], 0
        yield from self._texts(group)

    def _texts(self, pages: list[Page]) -> Iterator[str]:
        for page, held in zip(pages, self.marginals(pages) if pages else [], strict=True):
            yield "\n\n".join(t for t, p in zip(page.text, held, strict=True) if t is not None and p >= HALF)


def train(sources: Sequence[str], steps: int = STEPS) -> Model:
    """The model of most likelihood for labelled pages, with a ridge."""
    pages = [Page(s) for s in sources]
    seen = Counter(name for page in pages for names in features(page) for name in set(names))
    known = {name: k for k, name in enumerate(sorted(n for n, c in seen.items() if c >= LEAST_SEEN))}
    kinds = {tag: k for k, tag in enumerate(["", *sorted({t for page in pages for t in page.tag})])}
    forest = Forest(pages, known, kinds)
    state = np.array([m for page in pages for m in page.main], np.int64)
    w, edges = np.zeros(len(known)), np.zeros((len(kinds), 2, 2))
    if not forest.n:
        return Model(known, kinds, w, edges)
    linked = np.flatnonzero(forest.parent >= 0)
    flat = (forest.edge[linked] * 2 + state[forest.parent[linked]]) * 2 + state[linked]
    seen_edges = np.bincount(flat, minlength=edges.size).reshape(edges.shape).astype(float)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, edges)]
    often = np.maximum(1.0, np.bincount(forest.feats, minlength=len(w)))
    for step in range(1, steps + 1):
        p, joint = forest.marginals(w, edges)
        expected = np.zeros_like(edges)
        np.add.at(expected, forest.edge[linked], joint[linked])
        slope = np.bincount(forest.feats, weights=(state - p[:, 1])[forest.nodes], minlength=len(w))
        many = np.maximum(1.0, seen_edges.sum((1, 2)))[:, None, None]
        for x, g, m in zip((w, edges), (slope / often**0.5 - RIDGE * often**0.5 * w, (seen_edges - expected) / many**0.5 - RIDGE * many**0.5 * edges), moments, strict=True):
            m[0] += 0.1 * (g - m[0])
            m[1] += 0.01 * (g * g - m[1])
            x += RATE * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
    return Model(known, kinds, w, edges)


_ONE_ARTICLE = re.compile(r"<(article|main)(?=[\s>])", re.I)
_NOT_MAIN = re.compile(r"<(nav|aside|footer|header|form)(?=[\s>])", re.I)
_TELLING = re.compile(r"<(/?)(?:article|main|nav|aside|footer|header|section)(?=[\s>])", re.I)


def own_labels(source: str) -> list[str]:
    """A page that marks one article itself, labelled by that, as it is and with div for telling tags; none otherwise."""
    if len(_ONE_ARTICLE.findall(source)) != 1:
        return []
    labelled = _NOT_MAIN.sub(rf'<\1 {LABEL}="0"', _ONE_ARTICLE.sub(rf'<\1 {LABEL}="1"', source))
    return [labelled, _TELLING.sub(r"<\1div", labelled)]


def learned(sample: Sequence[str | None], drawn: int = DRAWN) -> Model:
    """A model from the html of some pages."""
    sample = [s for s in sample if s]
    lines = [line for s in sample for line in (plain_text(s) or "").split("\n")]
    prose = sorted({x for x in lines if len(x.split()) >= 12})
    shorts = sorted({x for x in lines if 0 < len(x.split()) <= 5})
    own = [x for s in sample[:OWN] for x in own_labels(s)]
    return train(labelled_pages(prose, shorts, drawn) + own)


def fitted(pages: DataFrame, html_col: str = "html") -> Model:
    """learned() from the sample of the table's pages, in one task."""
    html = F.col(html_col)
    sample = pages.select(html.alias("html")).where(html.isNotNull() & (F.octet_length(html) <= SAMPLE_BYTES))
    sample = sample.orderBy(F.xxhash64("html"), "html").limit(SAMPLE_PAGES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = learned(sorted(s for batch in batches for s in batch.html))
        rows = [(0, name, [float(model.w[k])]) for name, k in model.known.items()]
        rows += [(1, tag, model.edges[k].reshape(-1).tolist()) for tag, k in model.kinds.items()]
        yield pd.DataFrame(rows, columns=["part", "name", "weights"])

    found = sample.repartition(1).mapInPandas(run, "part int, name string, weights array<double>").collect()  # a row for each feature of the sample
    named = [[r for r in found if r.part == part] for part in (0, 1)]
    known, kinds = ({r.name: k for k, r in enumerate(rows)} for rows in named)
    if not kinds:  # no page, no task
        return learned([], 0)
    order = sorted(named[1], key=lambda r: r.name != "")  # the kind of unknown tags is number 0
    kinds = {r.name: k for k, r in enumerate(order)}
    return Model(known, kinds, np.array([r.weights[0] for r in named[0]]), np.array([r.weights for r in order]).reshape(-1, 2, 2))


def extracted(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    model = fitted(pages, html_col) if model is None else model

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = list(model.texts(batch.html.tolist()))
            yield pd.DataFrame({"page_id": batch.page_id, "url": batch.url, "text": texts, "n_chars": [len(t) for t in texts]})

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return mapped_with_id(rows, "page_id", run, "url string, text string, n_chars long")
