"""Operator 6: main-text extraction by a tree-structured graphical model.

A page becomes a tree of block elements; inline elements belong to the block around them.  Each block has a hidden
state, content or boilerplate.  Its own potential is linear in features of the block (tag, words of class and id, length
and link density of its text); an edge potential ties a block to its parent, by the kind of the child.  Messages go up
from the leaves and down from the root (sum-product), which gives exact marginals; blocks whose marginal for content is
over one half give their text.

Weights are fitted here by gradient ascent on the log-likelihood of labelled pages, its gradient being observed minus
expected features, the expectation from the same two passes.  The labelled pages are written by a generator in this
package that varies layouts, element names and class names, since the `pages` table has no labels; its size and seed
are parameters.

Defined cases: null or empty html gives an empty text; unclosed elements are closed by their parent's end, options also
by the next one, a head by the first text or element that can't stand in it; text outside
any element counts as the body's; comments, scripts, styles, templates and titles have no text; character references
are decoded; rows pass through in number, repeated rows get equal answers; columns other than html are not read.
"""

from __future__ import annotations

import html as html_lib
import math
import random
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragscore.llm.shipping import shipped

TRAINING_PAGES = 600
#: Element names by their part in the parse.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = frozenset("script style template noscript title iframe object svg math canvas audio video head textarea select option datalist".split())
_RAW = frozenset("script style title textarea iframe noscript template".split())
#: Start tags that leave a head open, and those that end a select.
_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
_ENDS_SELECT = frozenset("select input textarea table caption tbody thead tfoot tr td th".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark meter output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li tr td th dt dd body html".split())
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_LIMIT = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
#: Kinds of element, each a feature and an edge type.
_KINDS = {
    "article main": "article", "section div body html center": "box", "p": "p", "h1 h2 h3 h4 h5 h6": "heading", "li dt dd": "item", "ul ol dl menu": "list",
    "table tbody thead tfoot tr td th caption": "table", "nav": "nav", "header": "header", "footer": "footer", "aside": "aside",
    "form fieldset button legend input": "form", "blockquote pre figure figcaption address details summary": "quote", "dialog": "dialog",
}
_KIND = {tag: kind for tags, kind in _KINDS.items() for tag in tags.split()}
KINDS = [*dict.fromkeys(_KINDS.values()), "other"]
#: Words in class, id and role that speak for and against content.
_FOR = "article articles content entry main post posts story body text prose blogpost maintext bodytext article-body articlebody postcontent".split()
_AGAINST = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs topbar toolbar pagination pager tabs sitemap skip",
    "edge": "header footer masthead foot bottom copyright legal credits colophon topnav",
    "side": "sidebar side aside rail widget widgets related recommended recommendations more popular trending tags archive secondary complementary",
    "advert": "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted affiliate adsense adslot adbox",
    "notice": "cookie cookies consent notice notices gdpr alert popup modal overlay newsletter subscribe subscription signup paywall disclaimer toast dialog",
    "comment": "comment comments commentlist reply replies disqus respond discussion reactions feedback",
    "form": "form search searchbox login signin register contact input",
    "social": "share sharing social follow likes buttons byline meta author-box",
}
_WORD = {w: k for k, words in _AGAINST.items() for w in words.split()} | {w: "for" for w in _FOR}
WORDS = ["for", *_AGAINST]
#: One attribute after another, so that neither a part of a name nor a value counts as a name.
_ATTRS = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_TOKEN = re.compile(r"""<!--(?:.*?--!?>|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|[^<]+|<""", re.S)
_SPLIT = re.compile(r"[^a-z]+")
_RAW_END = {t: re.compile(rf"</{t}\s*(?:>|(?=[\s/>]))", re.I) for t in _RAW}

FEATURES = ["bias", *[f"kind {k}" for k in KINDS], *[f"word {w}" for w in WORDS], "hidden", "text", "length", "long", "short", "links", "sentence", "deep links", "items", "inside", "free article", "most text", "most text inside", "long box", "linked box"]
_AT = {n: i for i, n in enumerate(FEATURES)}
_OUTER = frozenset(("nav", "footer", "aside", "form", "dialog"))
_SPEAKS = frozenset(_AT["word " + w] for w in _AGAINST)


class Block:
    __slots__ = ("attrs", "children", "kind", "links", "parent", "parts", "tag")

    def __init__(self, tag: str, attrs: str, parent: Block | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.kind = _KIND.get(tag, "other")
        self.children: list[Block] = []
        #: Runs of text and the blocks between them, in page order.
        self.parts: list[str | Block] = []
        self.links = 0


def parse(page: str) -> Block:
    """The tree of block elements under a body that always exists."""
    root = now = Block("body", "", None)
    silent: list[str] = []  # the open element without text and all that is open inside it
    in_link, at, size = 0, 0, len(page)
    while at < size:
        m = _TOKEN.match(page, at)
        at = m.end()
        name = m[2]
        if name is None:
            text = m[0]
            if silent == ["head"] and not text.startswith(("<!", "<?")) and text.strip():
                silent.clear()
            if silent or text.startswith(("<!", "<?")):
                continue
            now.parts.append(text)
            if in_link:
                now.links += len(text)
            continue
        tag = name.lower()
        if m[1]:
            if tag == "a":
                in_link = 0
            if tag in silent:
                while silent.pop() != tag:
                    pass
                continue
            if tag in _SILENT or tag in _INLINE:
                continue
            back = now
            while back is not None and back.tag != tag:
                back = back.parent
            if back is not None and back is not root:
                if "object" not in silent:  # an object alone is closed by nothing around it
                    silent.clear()
                now = back.parent
            continue
        if tag == "a":
            in_link = 1
        if silent and (tag == "body" or silent == ["head"] and tag not in _HEAD or silent == ["option"] and tag in _CLOSES_P):
            silent.clear()
        if "select" in silent and tag in _ENDS_SELECT:
            while silent.pop() != "select":
                pass
            if tag == "select":
                continue
        if tag in _RAW and not m[3].endswith("/"):
            end = _RAW_END[tag].search(page, at)
            if end is None:
                break
            close = page.find(">", end.start())
            at = size if close < 0 else close + 1
            continue
        if tag in _SILENT:
            if not m[3].endswith("/"):
                if tag == "option" and silent and silent[-1] == "option":
                    silent.pop()
                silent.append(tag)
            continue
        if silent:
            if tag not in _VOID and tag != "html" and not m[3].endswith("/"):
                silent.append(tag)
            continue
        if tag in ("br", "hr"):
            now.parts.append(" ")
            if tag == "br":
                continue
        if tag in _INLINE or tag in _VOID:
            continue
        if tag in ("html", "body"):
            if m[3]:
                root.attrs += m[3]
            continue
        if tag in _CLOSES_P and now.tag == "p":
            now = now.parent
        if tag in _SAME:
            back = now
            while back is not root and back.tag not in _LIMIT.get(tag, ()):
                if back.tag in _SAME[tag]:
                    now = back.parent
                    if tag != "tr":
                        break
                back = back.parent
        child = Block(tag, m[3], now)
        now.children.append(child)
        now.parts.append(child)
        in_link = in_link if tag not in _CLOSES_P else 0
        now = child
    return root


@lru_cache(maxsize=20_000)
def _attribute_features(attrs: str) -> tuple[int, ...]:
    found = set()
    for name, a, b, c in _ATTRS.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            found.add(_AT["hidden"])
        elif name == "style":
            if "display:none" in value.replace(" ", ""):
                found.add(_AT["hidden"])
        elif name in ("class", "id", "role"):
            for w in _SPLIT.split(value):
                if w in _WORD:
                    found.add(_AT["word " + _WORD[w]])
    return tuple(found)


class Page:
    """Blocks in document order, with parents, features and texts."""

    def __init__(self, page: str):
        self.blocks: list[Block] = []
        self.parent: list[int] = []
        stack = [(parse(page), -1)]
        while stack:
            block, up = stack.pop()
            i = len(self.blocks)
            self.blocks.append(block)
            self.parent.append(up)
            stack.extend((c, i) for c in reversed(block.children))
        n = len(self.blocks)
        own = [[p for p in b.parts if isinstance(p, str)] for b in self.blocks]
        self.own = ["".join(o).strip() for o in own]
        total, linked = [len(o) for o in self.own], [b.links for b in self.blocks]
        for i in range(n - 1, 0, -1):
            total[self.parent[i]] += total[i]
            linked[self.parent[i]] += linked[i]
        most = [2 * (total[i] - linked[i]) > total[0] - linked[0] > 0 for i in range(n)]  # of the page's unlinked text
        self.kind = [KINDS.index(b.kind) for b in self.blocks]
        self.active: list[list[tuple[int, float]]] = []
        against = [False] * n  # the block or one around it speaks against content
        for i, b in enumerate(self.blocks):
            f = [(_AT["bias"], 1.0), (_AT["kind " + b.kind], 1.0)]
            if b.attrs:
                f += [(k, 1.0) for k in _attribute_features(b.attrs)]
            inside = i > 0 and against[self.parent[i]]
            against[i] = inside or b.kind in _OUTER or bool(b.attrs) and any(k in _SPEAKS for k in _attribute_features(b.attrs))
            if i and most[i] and b.kind != "nav":
                f.append((_AT["most text"], 1.0))
            if i and most[self.parent[i]]:
                f.append((_AT["most text inside"], 1.0))
            if inside:
                f.append((_AT["inside"], 1.0))
            elif b.kind == "article" and not against[i]:
                f.append((_AT["free article"], 1.0))
            text = self.own[i]
            if text:
                size = len(text)
                f += [(_AT["text"], 1.0), (_AT["length"], min(1.0, math.log1p(size) / 7))]
                f.append((_AT["long"], 1.0) if size > 120 else (_AT["short"], 1.0 if size < 40 else 0.0))
                if b.kind == "box":
                    f.append((_AT["linked box"], 1.0) if b.links * 2 > size else (_AT["long box"], 1.0 if size > 120 else 0.0))
                if b.links * 2 > size:
                    f.append((_AT["links"], 1.0))
                if text[-1] in ".!?…»”\"":
                    f.append((_AT["sentence"], 1.0))
            if total[i] and linked[i] * 2 > total[i]:
                f.append((_AT["deep links"], 1.0))
            if b.kind == "list" and total[i] < 40 * max(1, len(b.children)):
                f.append((_AT["items"], 1.0))
            self.active.append(f)

    def texts(self, content: list[bool]) -> list[str]:
        """Texts of content blocks in page order; a block inside a text parts it."""
        out: list[str] = []
        index = {id(b): i for i, b in enumerate(self.blocks)}
        stack: list[tuple[int, int]] = [(0, 0)]
        run: list[str] = []

        def close():
            text = " ".join(html_lib.unescape("".join(run)).split())
            if text:
                out.append(text)
            run.clear()

        while stack:
            i, k = stack.pop()
            parts = self.blocks[i].parts
            while k < len(parts) and isinstance(parts[k], str):
                if content[i]:
                    run.append(parts[k])
                k += 1
            close()
            if k < len(parts):
                stack.append((i, k + 1))
                stack.append((index[id(parts[k])], 0))
        return out


class TreeModel:
    """weights: for each feature; edges: for each kind of child and pair of states (parent, child)."""

    def __init__(self):
        self.weights = np.zeros(len(FEATURES))
        self.edges = np.zeros((len(KINDS), 2, 2))

    def marginals(self, page: Page, pairs: bool = False):
        """P(content) of each block, and of each edge the joint table where asked for."""
        w, n, parent = self.weights, len(page.blocks), page.parent
        own = [math.exp(max(-40.0, min(40.0, sum(w[k] * v for k, v in f)))) for f in page.active]
        table = self.table
        up0, up1 = [1.0] * n, own[:]  # products of messages from the children and the own potential
        message = [(1.0, 1.0)] * n
        for i in range(n - 1, 0, -1):
            (a, b), (c, d) = table[page.kind[i]]
            m0, m1 = a * up0[i] + b * up1[i], c * up0[i] + d * up1[i]
            s = m0 + m1
            message[i] = m0, m1 = m0 / s, m1 / s
            p = parent[i]
            up0[p] *= m0
            up1[p] *= m1
            s = up0[p] + up1[p]
            up0[p] /= s
            up1[p] /= s
        out = [0.0] * n
        belief: list[tuple[float, float]] = [(0.0, 0.0)] * n
        joint = np.zeros((n, 2, 2)) if pairs else None
        s = up0[0] + up1[0]
        belief[0] = up0[0] / s, up1[0] / s
        out[0] = belief[0][1]
        for i in range(1, n):
            b0, b1 = belief[parent[i]]
            m0, m1 = message[i]
            q0, q1 = b0 / max(m0, 1e-300), b1 / max(m1, 1e-300)  # the parent's belief without this child
            (a, b), (c, d) = table[page.kind[i]]
            t = (q0 * a * up0[i], q0 * b * up1[i], q1 * c * up0[i], q1 * d * up1[i])
            s = sum(t)
            belief[i] = (t[0] + t[2]) / s, (t[1] + t[3]) / s
            out[i] = belief[i][1]
            if pairs:
                joint[i] = np.array(t).reshape(2, 2) / s
        return (out, joint) if pairs else out

    def prepared(self) -> TreeModel:
        self.table = [((math.exp(e[0, 0]), math.exp(e[0, 1])), (math.exp(e[1, 0]), math.exp(e[1, 1]))) for e in self.edges]
        self.weights = self.weights.tolist() if isinstance(self.weights, np.ndarray) else self.weights
        return self

    def fit(self, pages: list[tuple[Page, list[int]]], epochs: int = 12, rate: float = 0.15, ridge: float = 1e-3) -> TreeModel:
        weights, edges = np.zeros(len(FEATURES)), np.zeros_like(self.edges)
        squares, edge_squares = np.full(len(FEATURES), 1e-6), np.full(edges.shape, 1e-6)
        rng = random.Random(5)
        pages = list(pages)
        for _ in range(epochs):
            rng.shuffle(pages)
            for s in range(0, len(pages), 8):
                self.weights, self.edges = weights, np.clip(edges, -8, 8)
                self.prepared()
                g, h = -ridge * weights, -ridge * edges
                for page, labels in pages[s : s + 8]:
                    p, joint = self.marginals(page, True)
                    for i, f in enumerate(page.active):
                        d = labels[i] - p[i]
                        for k, v in f:
                            g[k] += d * v
                        if i:
                            h[page.kind[i]] -= joint[i]
                            h[page.kind[i], labels[page.parent[i]], labels[i]] += 1
                squares += g * g
                edge_squares += h * h
                weights = weights + rate * g / np.sqrt(squares)
                edges = edges + rate * h / np.sqrt(edge_squares)
        self.weights, self.edges = weights, np.clip(edges, -8, 8)
        return self

    def extract(self, html: str | None) -> list[str]:
        if not html:
            return []
        page = Page(html)
        return page.texts([p > 0.5 for p in self.marginals(page)])


def trained(pages: int = TRAINING_PAGES, seed: int = 17) -> TreeModel:
    from ragscore.llm.labelled_pages import labelled_page

    rng = random.Random(seed)
    made = []
    for _ in range(pages):
        page = Page(labelled_page(rng))
        labels = []
        for i, b in enumerate(page.blocks):
            m = re.search(r'data-label="(\d)"', b.attrs)
            up = labels[page.parent[i]] if i else 0
            labels.append(int(m[1]) if m else up)
        made.append((page, labels))
    return TreeModel().fit(made)


def _extractor(model: TreeModel) -> Callable[[Column], Column]:
    get = shipped(model, TreeModel.prepared)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = get()
        for batch in batches:
            yield pa.array([m.extract(x) for x in batch.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")


def extract_text(pages: DataFrame, model: TreeModel | None = None, html_col: str = "html", into: str = "blocks") -> DataFrame:
    """The input with ``into`` (array<string>): the texts of content blocks in page order. A column of that name gives way."""
    return pages.withColumn(into, _extractor(model or trained())(F.col(html_col).cast("string")))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    text = F.array_join("blocks", "\n\n").alias("text")
    return out.select("page_id", "url", text).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
