"""Main text of HTML pages: gradient-boosted trees over DOM nodes, and a decoding that respects the tree.

A page is read into a tree of its block elements (broken markup too). Each node has features: tag, attribute tokens,
depth, density of text and links in its subtree, and how it compares with its siblings. Trees give the probability that a
node belongs to the main text. Decoding picks the likeliest labelling in which a node belongs to it only if its parent
does, so an advert's paragraph can't be kept without the advert, nor a paragraph without the article around it.

The trees are fitted in numpy on TRAIN_PAGES pages of known structure, written by a seeded generator of site layouts (no
labelled pages are given). They are fitted on the driver and sent to tasks; their size is fixed.

An element that holds no text of the page (RAW) is left out with its content; where it has no end tag, only its tag is, but
for scripts, styles and the like, which run to the page's end. A quote that isn't closed ends with its tag.

Character references are decoded, white space inside a block becomes one space, blocks are joined in page order by a
line feed. Null and empty pages, and pages without main text, give an empty text. Very long pages are whole; a page's tree
must fit in memory, and depth is bounded only by the page. Pages are handled one by one, so ties and repeated rows don't
matter; an empty table gives an empty result. Other columns pass through; columns named like a result are replaced.
"""

from __future__ import annotations

import functools
import html as html_module
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cistern.llm.frames import with_fields

# Elements of HTML by what they do to blocks.
BLOCKS = (
    "html body div section article main header footer nav aside form p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th "
    "blockquote pre figure figcaption fieldset address details summary title button select textarea label"
).split()
VOID = set("br hr img input meta link area base col embed source track wbr".split())
RAW = set("script style textarea title noscript iframe template svg select".split())
#: Of those, the ones that run to the end of the page where they aren't closed, and the ones that may hold their like.
TO_THE_END, NESTED = set("script style textarea title".split()), {"svg", "template"}
DROPPED = set("script style noscript iframe template svg textarea select head title".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
ENDS_P = set("div section article main header footer nav aside form p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset address details".split())

TAGS = "div section article main header footer nav aside form p h1 h2 h3 ul ol li table tr td blockquote pre figure button body".split()
# Parts of attribute tokens that hint at what an element holds.
HINTS = {
    "main": "article content main post entry story text body".split(),
    "ad": "ad ads advert advertisement promo sponsor sponsored banner".split(),
    "nav": "nav menu navbar breadcrumb breadcrumbs pagination toc tags".split(),
    "edge": "header footer top bottom masthead copyright site logo".split(),
    "side": "sidebar side aside related widget recommended popular trending more".split(),
    "talk": "comment comments reply replies discussion disqus respond".split(),
    "notice": "cookie consent notice alert popup modal newsletter subscribe signup warning".split(),
    "share": "share social follow print".split(),
    "form": "form search login".split(),
}
# A value in quotes may hold anything if a space or the tag's end follows; other quotes are plain characters of the tag, which
# ends at the next >.
TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*\"[^\"]*\"(?=\s|/?>)|=\s*'[^']*'(?=\s|/?>)|[^>=]+|=)*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
ATTRIBUTES = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")
_WORDS = re.compile(r"\w+")


class Node:
    __slots__ = ("tag", "hints", "parent", "children", "depth", "own", "words", "links", "size", "marks", "order")

    def __init__(self, tag: str, hints: tuple[int, ...], parent: Node | None):
        self.tag, self.hints, self.parent = tag, hints, parent
        self.children: list[Node] = []
        self.depth = parent.depth + 1 if parent else 0
        self.own: list[tuple[int, str]] = []  # (place in the page, text) of its own runs of text
        self.words = self.links = self.size = self.marks = self.order = 0


@functools.lru_cache(maxsize=4096)
def _hints(attributes: str) -> tuple[int, ...]:
    found = " ".join(a or b or c for a, b, c in ATTRIBUTES.findall(attributes))
    tokens = {t.lower() for t in re.split(r"[^A-Za-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", found))}
    return tuple(int(any(t in tokens for t in words)) for words in HINTS.values())


@functools.lru_cache(maxsize=64)
def _tags(tag: str) -> re.Pattern:
    return re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])[^>]*>", re.I)


def _ends(page: str, tag: str) -> dict[int, int]:
    """Where each element of the tag begins that has an end, and where it ends; one pass over the page."""
    out: dict[int, int] = {}
    open_: list[int] = []
    for m in _tags(tag).finditer(page):
        if m[1]:
            if open_:
                out[open_.pop()] = m.end()
        elif tag in NESTED:
            if not m[0].endswith("/>"):
                open_.append(m.start())
        elif tag in TO_THE_END:
            open_ = open_ or [m.start()]
        else:
            open_ = [m.start()]  # opened again: the one before was never closed
    return out


def _behind(page: str, start: int, at: int, tag: str, attributes: str, ends: dict[str, dict[int, int]]) -> int:
    """Where the page goes on behind an element whose content isn't read; right behind its tag if it isn't closed."""
    if attributes.rstrip().endswith("/") and tag not in TO_THE_END:
        return at
    if tag not in ends:
        ends[tag] = _ends(page, tag)
    return ends[tag].get(start, len(page) if tag in TO_THE_END else at)


def parse(page: str) -> list[Node]:
    """Block elements of a page, each before its children; the first is the page itself."""
    root = Node("html", _hints(""), None)
    nodes, node, at, place, link = [root], root, 0, 0, 0
    run: list[str] = []
    linked = 0
    ends: dict[str, dict[int, int]] = {}

    def flush() -> None:
        nonlocal place, linked
        if run:
            text = " ".join(html_module.unescape("".join(run)).split())
            run.clear()
            if text:
                node.own.append((place, text))
                place += 1
                node.words += len(text)
                node.links += min(linked, len(text))
                node.marks += sum(map(text.count, ".,;:!?"))
        linked = 0

    n = len(page)
    while at < n:
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else n]
        if text:
            run.append(text)
            if link:
                linked += len(text)
        if not m:
            break
        at, tag, attributes = m.end(), (m[2] or m[5] or "").lower(), m[3] or m[6] or ""
        if not tag:
            continue
        if not (m[1] or m[4]):
            if tag == "br" or tag == "hr":
                run.append(" ")
            if tag == "a":
                link += 1
            if tag in RAW:
                at = _behind(page, m.start(), at, tag, attributes, ends)
                continue
            if tag not in _BLOCKS:
                continue
            if tag in ("html", "body") and tag == "html":
                continue
            flush()
            if tag in ENDS_P:
                node = _up(node, {"p"}, {"div", "td", "article", "section", "li", "body", "blockquote"})
            if tag in CLOSES:
                node = _up(node, CLOSES[tag], {"ul", "ol", "dl", "table", "div", "article", "section"})
            child = Node(tag, _hints(attributes) if attributes else _NO_HINTS, node)
            node.children.append(child)
            nodes.append(child)
            node, link = child, 0
        elif tag == "a":
            link = max(0, link - 1)
        elif tag in _BLOCKS:
            flush()
            up = node
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                node, link = up.parent, 0
    flush()
    return nodes


_BLOCKS = set(BLOCKS) | {"body"}
_NO_HINTS = _hints("")


def _up(node: Node, closes: set[str], stops: set[str]) -> Node:
    """The parent of the nearest element that is closed, if none of `stops` is nearer."""
    up = node
    while up.parent and up.tag not in closes:
        if up.tag in stops:
            return node
        up = up.parent
    return up.parent if up.parent else node


NAMES = [*TAGS, *HINTS, *(f"within_{h}" for h in HINTS), "within_nav_tag", "within_aside", "within_article", "depth", "log_words", "log_own", "link_share", "mark_share",
         "per_node", "share_of_page", "place", "siblings", "same_tag", "sibling_words", "sibling_links", "last"]


def features(nodes: list[Node]) -> np.ndarray:
    """A row for each node. Sums over subtrees come from the last node to the first."""
    n = len(nodes)
    index = {id(x): i for i, x in enumerate(nodes)}
    parent = np.array([index[id(x.parent)] if x.parent else -1 for x in nodes])
    sums = np.array([(x.words, x.links, x.marks, 1) for x in nodes], float)
    own = sums[:, 0].copy()
    for i in range(n - 1, 0, -1):
        sums[parent[i]] += sums[i]
    out = np.zeros((n, len(NAMES)), np.float32)
    t, h = len(TAGS), len(HINTS)
    total = max(1.0, sums[0, 0])
    for i, x in enumerate(nodes):
        row = out[i]
        if x.tag in _TAG:
            row[_TAG[x.tag]] = 1
        row[t : t + h] = x.hints
        p = parent[i]
        if p >= 0:
            row[t + h : t + 2 * h + 3] = out[p, t + h : t + 2 * h + 3]
        row[t + h : t + 2 * h] = np.maximum(row[t + h : t + 2 * h], x.hints)
        if x.tag in ("nav", "header", "footer", "form"):
            row[t + 2 * h] = 1
        if x.tag == "aside":
            row[t + 2 * h + 1] = 1
        if x.tag in ("article", "main"):
            row[t + 2 * h + 2] = 1
    b = t + 2 * h + 3
    words, links, marks, count = sums.T
    out[:, b] = [x.depth for x in nodes]
    out[:, b + 1] = np.log1p(words)
    out[:, b + 2] = np.log1p(own)
    out[:, b + 3] = links / np.maximum(words, 1)
    out[:, b + 4] = 10 * marks / np.maximum(words, 1)
    out[:, b + 5] = np.log1p(words / count)
    out[:, b + 6] = words / total
    for i, x in enumerate(nodes):
        if x.children:
            kids = [index[id(c)] for c in x.children]
            k = len(kids)
            w, a = words[kids], links[kids]
            out[kids, b + 7] = np.arange(k) / k
            out[kids, b + 8] = np.log1p(k)
            tags = [c.tag for c in x.children]
            many = {tag: tags.count(tag) for tag in set(tags)}
            out[kids, b + 9] = [many[tag] / k for tag in tags]
            rest = max(k - 1, 1)
            out[kids, b + 10] = np.log1p((w.sum() - w) / rest)
            out[kids, b + 11] = (a.sum() - a) / np.maximum(w.sum() - w, 1)
            out[kids[-1], b + 12] = 1
    return out


_TAG = {tag: i for i, tag in enumerate(TAGS)}


# --- boosted trees

TREES, LEVELS, SHRINK, BINS, LEAST = 40, 4, 0.25, 24, 12
TRAIN_PAGES = 800


class Trees:
    """Boosted regression trees of LEVELS binary splits, for the logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
        share = y.mean()
        self.base = float(np.log(share / (1 - share)))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        z = np.full(len(y), self.base)
        width = BINS + 1
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-z))
            g, hess = y - p, p * (1 - p)
            place = np.zeros(len(y), np.int64)
            feature, cut = np.full(2**LEVELS - 1, 0), np.full(2**LEVELS - 1, np.inf)
            for level in range(LEVELS):
                first = 2**level - 1
                best = [(1e-6, 0, np.inf)] * 2**level
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    key = (place - first) * width + binned[:, f]
                    gs = np.bincount(key, g, 2**level * width).reshape(-1, width)
                    hs = np.bincount(key, hess, 2**level * width).reshape(-1, width)
                    ns = np.bincount(key, minlength=2**level * width).reshape(-1, width)
                    gl, hl, nl = gs.cumsum(1), hs.cumsum(1), ns.cumsum(1)
                    gt, ht, nt = gl[:, -1:], hl[:, -1:], nl[:, -1:]
                    gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                    gain[(nl < LEAST) | (nt - nl < LEAST)] = 0
                    gain = gain[:, : len(e)]
                    for k, b in enumerate(gain.argmax(axis=1)):
                        if gain[k, b] > best[k][0]:
                            best[k] = (gain[k, b], f, e[b])
                for k, (_, f, c) in enumerate(best):
                    feature[first + k], cut[first + k] = f, c
                place = 2 * place + 1 + (x[np.arange(len(y)), feature[place]] > cut[place])
            leaf = place - (2**LEVELS - 1)
            value = SHRINK * np.bincount(leaf, g, 2**LEVELS) / (np.bincount(leaf, hess, 2**LEVELS) + 1)
            z += value[leaf]
            self.trees.append((feature, cut, value))

    def logits(self, x: np.ndarray) -> np.ndarray:
        z, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.trees:
            place = np.zeros(len(x), np.int64)
            for _ in range(LEVELS):
                place = 2 * place + 1 + (x[rows, feature[place]] > cut[place])
            z += value[place - (2**LEVELS - 1)]
        return z


def decode(nodes: list[Node], logits: np.ndarray) -> np.ndarray:
    """The likeliest labels in which a node is kept only if its parent is.

    Of a node that is kept, each child's subtree is labelled as is best for it; of one that isn't, nothing is kept. What
    counts is how much better than "nothing" the best labelling with the node kept is: its logit, and for each child the
    same if that is above zero.
    """
    gain = logits.copy()
    index = {id(x): i for i, x in enumerate(nodes)}
    for i in range(len(nodes) - 1, 0, -1):
        if gain[i] > 0:
            gain[index[id(nodes[i].parent)]] += gain[i]
    kept = np.zeros(len(nodes), bool)
    kept[0] = gain[0] > 0
    for i in range(1, len(nodes)):
        kept[i] = kept[index[id(nodes[i].parent)]] and gain[i] > 0
    return kept


def text_of(nodes: list[Node], kept: np.ndarray) -> str:
    runs = [r for x, k in zip(nodes, kept, strict=True) if k for r in x.own]
    return "\n".join(t for _, t in sorted(runs))


# --- pages of known structure

_SYLLABLES = "ba co de fi gu la me no pi ra so tu ve xi ya zo ter lin mar on est".split()


def layout(draw: random.Random, names: dict[str, list[str]] = HINTS) -> str:
    """A page in which main text consists of words that begin with "k"; all other words begin with other letters.

    names: what elements of each kind may be called.
    """

    def word(main: bool) -> str:
        return ("k" if main else "") + "".join(draw.choice(_SYLLABLES) for _ in range(draw.randint(1, 4)))

    def sentence(main: bool, lo: int = 3, hi: int = 18) -> str:
        return " ".join(word(main) for _ in range(draw.randint(lo, hi))) + draw.choice([".", ".", ".", "?", "!", ""])

    def prose(main: bool, most: int = 7) -> str:
        return " ".join(sentence(main) for _ in range(draw.randint(1, most)))

    def named(tag: str, kind: str, inner: str, always: bool = False) -> str:
        own = draw.choice(names[kind]) if kind in names else kind
        extra = draw.choice(["", "-wrap", " block", "_1", " widget"])
        attribute = f' {draw.choice(["class", "id", "class"])}="{own}{extra}"' if always or draw.random() < 0.6 else ""
        end = f"</{tag}>" if draw.random() < 0.98 or tag != "p" else ""
        return f"<{tag}{attribute}>{inner}{end}"

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{word(False)}">{sentence(False, 1, 3)}</a>' + draw.choice(["</li>", "</li>", ""]) for _ in range(n)) + "</ul>"

    def paragraph() -> str:
        inner = prose(True)
        style = draw.random()
        if style < 0.1:
            return f"<p><b>{sentence(True)}<br>" + f"<p>{inner}</p>"
        if style < 0.2:
            return f'<p>{inner} <a href="/x">{sentence(True, 1, 4)}</a> {sentence(True)}</p>'
        return f"<p>{inner}" + draw.choice(["</p>", "</p>", "</p>", ""])

    def content() -> str:
        parts = [f"<h1>{sentence(True, 1, 10)}</h1>"] if draw.random() < 0.8 else []
        for _ in range(draw.choice([1, 1, 2, 3, 5, 8, 14])):
            kind = draw.random()
            if kind < 0.75:
                parts.append(paragraph())
            elif kind < 0.82:
                parts.append(f"<h2>{sentence(True, 1, 6)}</h2>")
            elif kind < 0.88:
                parts.append("<ul>" + "".join(f"<li>{sentence(True)}</li>" for _ in range(draw.randint(1, 6))) + "</ul>")
            elif kind < 0.92:
                parts.append(f"<blockquote><p>{prose(True, 3)}</p></blockquote>")
            elif kind < 0.95:
                parts.append("<table>" + "".join(f"<tr><td>{sentence(True, 1, 4)}</td><td>{sentence(True, 1, 4)}</td></tr>" for _ in range(draw.randint(1, 5))) + "</table>")
            elif kind < 0.97:
                parts.append(f"<pre>{prose(True, 2)}</pre>")
            else:
                parts.append(f"<div>{prose(True, 3)}</div>")
            if draw.random() < 0.05:
                parts.append(advert())
            if draw.random() < 0.03:
                parts.append(named("div", "share", links(draw.randint(2, 4)), True))
            if draw.random() < 0.03:
                parts.append(named("aside", "side", f"<h3>{sentence(False, 1, 4)}</h3>" + links(3)))
        return "".join(parts)

    def advert() -> str:
        return named(draw.choice(["div", "section", "aside", "p", "div"]), "ad", draw.choice([sentence(False), f"<p>{prose(False, 3)}</p>", f'<a href="/b">{sentence(False)}</a>']), True)

    def comments() -> str:
        one = lambda: named(draw.choice(["div", "li", "article"]), "talk", f"<h4>{word(False)}</h4><p>{prose(False, 4)}</p>", draw.random() < 0.7)
        inner = f"<h3>{sentence(False, 1, 3)}</h3>" + "".join(one() for _ in range(draw.randint(1, 6)))
        return named(draw.choice(["section", "div", "aside"]), "talk", inner, True)

    def some(share: float, make) -> str:
        return make() if draw.random() < share else ""

    tag = draw.choice(["article"] * 5 + ["div", "div", "main", "section"])
    body = named(tag, "main", content(), tag == "div")
    if draw.random() < 0.3:
        body = named(draw.choice(["main", "div"]), "main", body + some(0.4, comments) + some(0.3, advert))
    aside = lambda: named(draw.choice(["aside", "div"]), "side", f"<h3>{sentence(False, 1, 3)}</h3>" + draw.choice([links(draw.randint(2, 8)), f"<p>{prose(False, 4)}</p>"]), True)
    notice = lambda: named(draw.choice(["div", "section", "p"]), "notice", draw.choice([sentence(False), f"<p>{prose(False, 2)}</p><button>{word(False)}</button>"]), True)
    form = lambda: f'<form action="/s"><label>{word(False)}</label><p>{sentence(False)}</p><button>{word(False)}</button></form>'
    nav = lambda: named("nav", "nav", links(draw.randint(2, 9))) if draw.random() < 0.8 else named("div", "nav", links(draw.randint(3, 9)), True)
    head = lambda: named("header", "edge", draw.choice([f"<h1>{sentence(False, 1, 4)}</h1>", f"<p>{sentence(False)}</p>", links(3)]))
    foot = lambda: named("footer", "edge", draw.choice([f"&copy; {sentence(False)}", f"<p>{prose(False, 2)}</p>", links(4), f"<div>{prose(False, 2)}</div>"]))
    before = some(0.35, head) + some(0.8, nav) + some(0.5, advert) + some(0.2, notice) + some(0.15, form) + some(0.2, aside)
    after = some(0.3, aside) + some(0.25, comments) + some(0.2, advert) + some(0.1, form) + some(0.1, notice) + some(0.8, foot)
    start = '<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>x</title><style>p{}</style><script>var t="</p>";</script></head><body>'
    page = start + before + body + after + draw.choice(["</body></html>", ""])
    return page if draw.random() < 0.95 else page[: int(len(page) * draw.uniform(0.6, 1))]


def labelled(pages: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the nodes of generated pages: 1 where a node or one below it has a word of the main text."""
    draw, xs, ys = random.Random(seed), [], []
    for _ in range(pages):
        nodes = parse(layout(draw))
        has = [any(w[0] == "k" for _, t in x.own for w in _WORDS.findall(t)) for x in nodes]
        index = {id(x): i for i, x in enumerate(nodes)}
        for i in range(len(nodes) - 1, 0, -1):
            if has[i]:
                has[index[id(nodes[i].parent)]] = True
        xs.append(features(nodes))
        ys.append(np.array(has, float))
    return np.concatenate(xs), np.concatenate(ys)


@functools.lru_cache(maxsize=1)
def model() -> Trees:
    return Trees(*labelled(TRAIN_PAGES, 5))


def main_text(page: str | None, trees: Trees) -> str:
    if not page:
        return ""
    nodes = parse(page)
    return text_of(nodes, decode(nodes, trees.logits(features(nodes))))


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """pages with the main text, and n_chars (its code points), but without the html."""
    sent = pages.sparkSession.sparkContext.broadcast(model())
    rest = [c for c in pages.columns if c not in (html, text, "n_chars")]
    pages = pages.select(*rest, html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = sent.value
        for batch in batches:
            for i in range(0, len(batch), 128):
                part = batch.slice(i, 128)
                trees_of = [parse(p or "") for p in part.column(len(rest)).to_pylist()]
                z = trees.logits(np.concatenate([features(t) for t in trees_of]))
                cut = np.cumsum([0, *map(len, trees_of)])
                out = [text_of(t, decode(t, z[a:b])) for t, a, b in zip(trees_of, cut, cut[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(out, pa.string())], [*rest, text])

    out = pages.mapInArrow(run, with_fields(pages.drop(html), **{text: StringType()}))
    return out.withColumn("n_chars", F.char_length(text).cast("long"))
