"""Main text of HTML pages by boosted trees over DOM nodes.

A page becomes a tree of block elements and of the text runs between them.  Each
node has features: subtree density, links, punctuation, attribute tokens, depth
and siblings.  Gradient-boosted trees, fitted on a bounded sample of pages
(`max_pages`, `max_nodes` a page), score how likely a node is main text.  Given the
documents that the pages were made from, a text run is labelled by whether its
document holds it, and a container by most of its labelled characters, so that no label
follows from a feature; without documents the pages' own markup labels them (article
against nav, footer, ad and the like).  Half of the training is the nodes without
their markup, so that density and siblings carry pages whose markup says nothing, a
quarter the nodes as they are and a quarter the nodes as if
under marked other content.  Decoding is
hierarchical: over all choices in which nothing below a dropped node is kept,
the one of the greatest summed score is taken, bottom up.

Defined results: null or empty html has empty text; broken, truncated or
unclosed markup is closed as browsers do in the common cases; repeated rows are
each extracted; very long html is one page in memory of one task; of equal sums
decoding keeps less; white space is what `str.split` takes for it, no-break space
included; an empty table gives an empty result.
"""

from __future__ import annotations

import html as html_lib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .url_filter import document_number

BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol option p pre section select "
    "summary table tbody td textarea tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the page.
SILENT = frozenset("script style noscript template iframe svg canvas object title head select textarea button".split())
RAW = frozenset("script style textarea title iframe".split())
#: Start tags that may stand in head; any other, or text, closes it.
HEAD = frozenset("html head base basefont bgsound link meta title noscript noframes style script template".split())
CONTENT_TAGS = frozenset(["article", "main"])
OTHER_TAGS = frozenset("nav header footer aside form menu dialog fieldset".split())
CONTENT_TOKENS = frozenset("article main content post entry story body".split())
OTHER_TOKENS = frozenset(
    "ad ads advert advertisement advertising alert aside banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "copyright disqus disclaimer footer form header login masthead menu modal nav navbar navigation newsletter notice "
    "pagination popup promo promoted recommended related replies reply search share sharing sidebar signup social sponsor "
    "sponsored subscribe toolbar widget".split())
#: What a start tag closes if it is open, and at which elements the search for it ends.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
          "option": ({"option"}, {"select"})}
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TOKEN = re.compile(r"[a-z]+")
FEATURES = ["chars", "links", "per_element", "punctuation", "depth", "place_among", "siblings", "sibling_chars",
            "content_mark", "other_mark", "nearest_mark", "under_other", "heading", "paragraph", "item", "run"]
MARKUP = [FEATURES.index(x) for x in ("content_mark", "other_mark", "nearest_mark", "under_other")]


class Page:
    """The tree: per node its tag, parent, mark (1 main, -1 other, 0 none) and, for runs, text and link characters."""

    def __init__(self, source: str):
        self.tag, self.parent, self.mark, self.text, self.link = ["#page"], [-1], [0], [""], [0]
        stack, silent, at, run, links = ["#page"], 0, 0, [], 0
        blocks, anchors, opened = [0], 0, {}  # node of each open block, open links, open elements by name

        def flush():
            nonlocal run, links
            words = html_lib.unescape("".join(run)).split()
            if words:
                text = " ".join(words)
                self._node("#run", blocks[-1], 0, text, min(links, len(text)))
            run, links = [], 0

        def add(text):
            nonlocal links
            if stack[-1] == "head" and text.strip(" \t\n\f\r"):
                pop()
            if text and not silent:
                run.append(text)
                links += len(text) if anchors else 0

        def pop():
            nonlocal silent, anchors
            name = stack.pop()
            if name in BLOCK:
                flush()
                blocks.pop()
            opened[name] -= 1
            silent -= name in SILENT
            anchors -= name == "a"

        size = len(source)
        while at < size:
            m = _TAG.search(source, at)
            if m is None:
                add(source[at:])
                break
            add(source[at:m.start()])
            at = m.end()
            if m[2] is None or (at == size and source[-1] != ">"):
                continue
            name = m[2].lower()
            if m[1]:
                if opened.get(name):
                    while stack[-1] != name:
                        pop()
                    pop()
                elif name == "br" or name in BLOCK:
                    add(" ")
                continue
            if opened.get("head"):
                if name == "head":
                    continue
                if name == "body":
                    self._close(stack, {"head"}, {"template"}, pop)
                elif stack[-1] == "head" and name not in HEAD:
                    pop()
            if name in BLOCK:
                if opened.get("p") and name not in ("button", "label", "option"):
                    self._close(stack, {"p"}, {"button", "td", "th", "li", "div", "article", "section"} if name != "p" else {"td", "th", "li"}, pop)
                if name in CLOSES:
                    self._close(stack, *CLOSES[name], pop)
                flush()
            if name in VOID:
                add(" ")
                continue
            if name in BLOCK:
                blocks.append(self._node(name, blocks[-1], self._mark(name, m[3]), "", 0))
            stack.append(name)
            opened[name] = opened.get(name, 0) + 1
            silent += name in SILENT
            anchors += name == "a"
            if name in RAW:
                end = re.compile(f"</{name}(?=[\\s/>])", re.I).search(source, at)
                add(source[at:end.start()] if end else source[at:])
                at = end.start() if end else size
        flush()

    def _node(self, *row):
        for column, value in zip((self.tag, self.parent, self.mark, self.text, self.link), row, strict=True):
            column.append(value)
        return len(self.tag) - 1

    @staticmethod
    def _close(stack, names, until, pop):
        for n in reversed(stack):
            if n in names:
                while stack[-1] not in names:
                    pop()
                pop()
                return
            if n in until:
                return

    @staticmethod
    def _mark(name: str, attributes: str) -> int:
        tokens = {t for a in _ATTR.findall(attributes) for t in _TOKEN.findall("".join(a).lower())} if attributes else set()
        if name in OTHER_TAGS or tokens & OTHER_TOKENS:
            return -1
        return int(name in CONTENT_TAGS or bool(tokens & CONTENT_TOKENS))

    def features(self) -> np.ndarray:
        n, parent = len(self.tag), self.parent
        own = [len(t) for t in self.text]
        chars, links, elements, marks = own[:], self.link[:], [1] * n, [0] * n
        points = [t.count(",") + t.count(".") + t.count(";") if t else 0 for t in self.text]
        children, kid_chars, place = [0] * n, [0] * n, [0] * n
        depth, nearest, under = [0] * n, [0] * n, [0] * n
        for i in range(n - 1, 0, -1):
            p = parent[i]
            for column in (chars, links, elements, points):
                column[p] += column[i]
            kid_chars[p] += chars[i]
        for i in range(n):
            p = parent[i]
            if p >= 0:
                place[i] = children[p]
                children[p] += 1
                depth[i] = depth[p] + 1
                nearest[i] = self.mark[i] or nearest[p]
                under[i] = under[p] or self.mark[i] == -1
        col = [np.log1p(chars), np.divide(links, np.maximum(chars, 1)), np.log1p(np.divide(chars, elements)),
               np.divide(points, np.maximum(chars, 1)), depth, place, [children[p] if p >= 0 else 1 for p in parent],
               np.log1p([kid_chars[p] / children[p] if p >= 0 else 0 for p in parent]),
               [m > 0 for m in self.mark], [m < 0 for m in self.mark], nearest, under, [t[0] == "h" and t[1:].isdigit() for t in self.tag],
               [t == "p" for t in self.tag], [t == "li" for t in self.tag], [t == "#run" for t in self.tag]]
        return np.stack([np.asarray(c, np.float32) for c in col], axis=1)

    def decode(self, score: np.ndarray) -> list[str]:
        """Texts of the kept runs: the greatest summed score with nothing kept below a dropped node."""
        n = len(self.tag)
        size = np.array([len(t) for t in self.text], np.float64)
        gain = (score * np.sqrt(size)).tolist()
        best = [0.0] * n
        for i in range(n - 1, 0, -1):
            value = best[i] + gain[i]
            if self.text[i] or self.tag[i] not in ("html", "body"):
                # a container votes with a tenth of what its best part is worth, at most
                value += 0.0 if self.text[i] else float(np.clip(score[i], -4, 4)) / 40 * best[i]
            best[i] = max(0.0, value)
            best[self.parent[i]] += best[i]
        kept = [True] + [False] * (n - 1)
        for i in range(1, n):
            kept[i] = kept[self.parent[i]] and best[i] > 0
        return [t for t, k in zip(self.text, kept, strict=True) if t and k]


class Trees:
    """Gradient-boosted trees of fixed depth for a 0/1 target, on binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, rate: float = 0.3, bins: int = 24):
        self.depth, self.base = depth, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        self.feature, self.cut, self.leaf = [], [], []
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
        score = np.full(len(y), self.base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, p * (1 - p) + 1e-6
            node = np.zeros(len(y), np.int64)
            feature, cut = np.zeros(2 ** depth - 1, np.int64), np.full(2 ** depth - 1, np.inf)
            for level in range(depth):
                first, wide = 2 ** level - 1, 2 ** level
                best = np.full(wide, 1e-9)
                pick = np.zeros((wide, 2), np.int64) - 1
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    slot = (node - first) * (len(e) + 1) + binned[:, f]
                    g = np.bincount(slot, grad, wide * (len(e) + 1)).reshape(wide, -1).cumsum(axis=1)
                    h = np.bincount(slot, hess, wide * (len(e) + 1)).reshape(wide, -1).cumsum(axis=1)
                    gl, hl, gt, ht = g[:, :-1], h[:, :-1], g[:, -1:], h[:, -1:]
                    win = gl ** 2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt ** 2 / (ht + 1)
                    at = win.argmax(axis=1)
                    value = win[np.arange(wide), at]
                    better = value > best + 1e-12
                    best[better], pick[better] = value[better], np.stack([np.full(wide, f), at], axis=1)[better]
                for k in range(wide):
                    if pick[k, 0] >= 0:
                        feature[first + k], cut[first + k] = pick[k, 0], edges[pick[k, 0]][pick[k, 1]]
                node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
            at = node - (2 ** depth - 1)
            leaf = rate * np.bincount(at, grad, 2 ** depth) / (np.bincount(at, hess, 2 ** depth) + 1)
            score += leaf[at]
            self.feature.append(feature)
            self.cut.append(cut)
            self.leaf.append(leaf)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of the target."""
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - (2 ** self.depth - 1)]
        return out


def markup_labels(page: Page, f: np.ndarray, text: str | None) -> np.ndarray:
    """1 main text, 0 other, -1 unknown, of each node by the nearest mark above it."""
    mark = f[:, FEATURES.index("nearest_mark")]
    if 1 not in page.mark:
        return np.full(len(f), -1)
    return np.where(mark == 0, -1, (mark > 0) & (f[:, FEATURES.index("under_other")] == 0))


def aligned_labels(page: Page, f: np.ndarray, text: str | None, min_words: int = 3) -> np.ndarray:
    """1 main text, 0 other, -1 unknown: a run by whether the document's text holds it (unknown, if
    it is found but under `min_words` words), a container by most of its labelled characters."""
    if not text:
        return np.full(len(f), -1)
    words = " ".join(text.split())
    label = np.array([-1 if not t else 0 if t not in words else 1 if t.count(" ") >= min_words - 1 else -1 for t in page.text])
    size = np.array([len(t) for t in page.text])
    main, known = np.where(label == 1, size, 0), np.where(label >= 0, size, 0)
    for i in range(len(label) - 1, 0, -1):
        main[page.parent[i]] += main[i]
        known[page.parent[i]] += known[i]
    return np.where(size > 0, label, np.where(known > 0, 2 * main > known, -1))


def training_nodes(pages: DataFrame, documents: DataFrame | None = None, max_pages: int = 500,
                   max_nodes: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the sample: at most `max_pages` pages (those of the smallest hash of
    page_id; of a repeated page_id one) and `max_nodes` labelled nodes of each, so the driver gets
    a bounded number of rows.  A page's document is the one that its url names."""
    chosen = pages.select(F.col("page_id").alias("_id")).where("_id is not null").distinct().orderBy(F.xxhash64("_id"), "_id").limit(max_pages)
    rows = pages.join(F.broadcast(chosen), F.col("page_id") == F.col("_id"))
    rows = rows.groupBy("_id").agg(F.min(F.struct(F.col("html").cast("string").alias("html"), document_number(F.col("url")).alias("doc"))).alias("p"))
    rows, labels = rows.select("p.html", "p.doc"), markup_labels
    if documents is not None:
        labels = aligned_labels
        named = [r[0] for r in rows.select("doc").where("doc is not null").distinct().collect()]  # one a sampled page at most
        texts = documents.where(F.col("doc_id").isin(named)).groupBy(F.col("doc_id").cast("long").alias("doc")).agg(
            F.min(F.col("text").cast("string")).alias("text"))
        rows = rows.join(texts, "doc").select("html", "text")
    else:
        rows = rows.select("html", F.lit(None).cast("string").alias("text"))

    def run(batches):
        for b in batches:
            x, y = [], []
            for source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                page = Page(source or "")
                f = page.features()
                label = labels(page, f, text)
                at = np.flatnonzero(label >= 0)[:max_nodes]
                x.append(f[at])
                y += label[at].tolist()
            if y:
                yield pa.RecordBatch.from_arrays([pa.array(list(np.concatenate(x)), pa.list_(pa.float32())), pa.array(y, pa.int32())], ["x", "y"])

    got = rows.mapInArrow(run, "x array<float>, y int").toArrow().combine_chunks()
    if not got.num_rows:
        return np.empty((0, len(FEATURES)), np.float32), np.empty(0)
    x = np.array(got.column("x").to_pylist(), np.float32)
    y = got.column("y").to_numpy().astype(np.float64)
    order = np.lexsort([*x.T, y])  # the same fit whatever order the tasks end in
    return x[order], y[order]


def fit(pages: DataFrame, documents: DataFrame | None = None, max_pages: int = 500, max_nodes: int = 400) -> Trees | None:
    """The trees, or None if the sample has nothing to learn from.  Where no sampled page names
    a document with text, labels are those of the markup."""
    x, y = training_nodes(pages, documents, max_pages, max_nodes)
    if documents is not None and not 0 < y.sum() < len(y):
        x, y = training_nodes(pages, None, max_pages, max_nodes)
    if not len(y):
        return None
    plain, other = x.copy(), x.copy()
    plain[:, MARKUP] = 0
    other[:, MARKUP] = (0, 0, -1, 1)  # whatever stands in a marked notice or the like is not main text
    return Trees(np.concatenate([x, plain, plain, other]), np.concatenate([y, y, y, 0 * y]))


def extract_texts(sources: list[str | None], model: Trees | None) -> list[str]:
    """Main texts of some pages, whose nodes are scored together."""
    pages = [Page(s or "") for s in sources]
    if not pages:
        return []
    f = np.concatenate([p.features() for p in pages])

    def plain(f):  # nothing to go by but marks and links
        mark = f[:, FEATURES.index("nearest_mark")]
        return np.where(mark != 0, 4 * mark, 1 - 4 * f[:, FEATURES.index("links")]) - 8 * f[:, FEATURES.index("under_other")]

    ends = np.cumsum([len(p.tag) for p in pages])[:-1]
    scores = np.split(plain(f) if model is None else model.score(f), ends)
    kept = [p.decode(x) for p, x in zip(pages, scores, strict=True)]
    bare = [not k and not any(p.mark) for k, p in zip(kept, pages, strict=True)]  # a page without any marked node
    return ["\n\n".join(p.decode(plain(x)) if no else k) for k, p, x, no in zip(kept, pages, np.split(f, ends), bare, strict=True)]


def extract(pages: DataFrame, model: Trees | None, keep: list[str], name: str = "text") -> DataFrame:
    """`keep` and the main text of each page."""
    rows = pages.select(*[pages[c] for c in keep], pages["html"].cast("string").alias("__html"))
    schema = rows.drop("__html").withColumn(name, F.lit("")).schema

    def run(batches):
        for b in batches:
            texts, held, size = [], [], 0
            for s in b.column(len(keep)):
                held.append(s.as_py())
                size += len(held[-1] or "")
                if size > 1 << 19:  # bounded memory: the trees of about half a million characters
                    texts += extract_texts(held, model)
                    held, size = [], 0
            texts += extract_texts(held, model)
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array(texts, pa.string())], [*keep, name])

    return rows.mapInArrow(run, schema)
