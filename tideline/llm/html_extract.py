"""HTML main-text extraction by a tree-structured graphical model.

A page becomes the tree of its block elements; text of inline elements belongs to the block
around it. Each block has a binary state, article or not. A log-linear potential scores a
block by tag, class and id words, text length and link density; another scores each pair of
parent and child state by the child's tag. Sum-product messages go up to the root and down
again, which gives exact marginals, and blocks with a marginal over one half are kept.

The weights maximise the likelihood of labelled pages: their gradient is observed minus
expected feature counts, the latter by the same message passing. The pages come from
html_pages, a bounded number of them (N_TRAIN), with a fixed seed.

Output: character references decoded, white space inside a block made one space, trimmed,
blocks in page order joined by one space. Dropped with their content are scripts, styles, frames,
drawings (svg), text fields and the title; formulas and what object, video, canvas, noscript and
the like hold count as text of the block around them.

Scale: one pass over the pages without any shuffle; the model (some hundred weights) is
broadcast. Defined cases: null html is empty; a page without an article gives '' and 0; pages of
any length are taken whole; rows with equal page_id are extracted one by one; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.html_pages import labelled_pages
from tideline.session import ship

N_TRAIN, EPOCHS, RATE, SHRINK, SEED = 500, 4, 0.3, 1e-5, 7
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
UNFINISHED = re.compile(r"</?[a-zA-Z]|<[!?]")
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|data-y|hidden|aria-hidden)(?=[\s=/]|$)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
#: Elements dropped with their content; of the first ones no end tag means up to the end of the page.
RAW = {"script", "style", "iframe", "svg", "noembed", "noframes", "textarea", "title"}
#: A slash at the end of a tag that is no part of a value without quotes.
SELF_CLOSED = re.compile(r"""(?:^|[\s"'])/\s*$|^[^=]*/\s*$|\s[^\s=]+/\s*$""")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr", "mspace", "mprescripts", "malignmark", "maligngroup", "mglyph", "none"}
BREAKS = {"br", "hr"}
#: A formula is part of the text around it.
MATH = {"math", "mi", "mn", "mo", "ms", "mtext", "mrow", "mfrac", "msqrt", "mroot", "mstyle", "merror", "mpadded", "mphantom", "mfenced", "menclose", "msub", "msup", "msubsup", "munder", "mover", "munderover", "mmultiscripts", "mtable", "mtr", "mlabeledtr", "mtd", "maction", "semantics", "annotation", "annotation-xml"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "input"} | MATH | {"object", "video", "audio", "canvas", "noscript", "template"}
#: Start tags that end an open element of the listed kinds, up to the nearest boundary.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
BOUNDARY = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "tbody": {"table"}}
P_BOUNDARY = {"button", "td", "th", "caption", "object", "html", "body", "table"}
#: Names of one letter are prefixes without a meaning.
WORD = re.compile(r"[a-z]{2,}")


class Block:
    __slots__ = ("tag", "parent", "names", "text", "links", "label")

    def __init__(self, tag, parent, names, label):
        self.tag, self.parent, self.names, self.label = tag, parent, names, label
        self.text, self.links = [], 0


def blocks_of(page: str, labelled: bool = True) -> tuple[list[Block], list[tuple[int, str]]]:
    """Block elements in page order (0 is the root), and the text pieces with their block's number.

    labelled: pages of html_pages, whose attribute data-y is a block's state; on others it means nothing.
    """
    out = [Block("#root", -1, (), None)]
    pieces: list[tuple[int, str]] = []
    stack = [("#root", 0)]  # open elements: tag, and the block that holds their text
    at, links, end = 0, 0, len(page)
    endless: set[str] = set()  # raw elements without an end from here on
    last = page.rfind(">") + 1  # no tag is complete beyond it

    def put(text: str) -> None:
        if text:
            k = stack[-1][1]
            pieces.append((k, text))
            out[k].text.append(len(text) - text.count(" "))
            if links:
                out[k].links += len(text) - text.count(" ")

    for m in iter(lambda: TOKEN.search(page, at, last), None):
        if m.start() > at:
            put(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                at = end
            continue
        closing, tag, attrs = m[1] or m[4], tag.lower(), m[3] if m[2] else m[6]
        if closing:
            if tag == "a":
                links = max(0, links - 1)
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    if tag not in INLINE:
                        links = 0
                    del stack[k:]
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break
            if tag not in INLINE:
                pieces.append((stack[-1][1], " "))
            continue
        if tag in RAW:
            if not (tag == "svg" and SELF_CLOSED.search(attrs)) and tag not in endless:
                stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                if stop is None:
                    endless.add(tag)
                at = stop.end() if stop else (end if tag in ("script", "style") else at)
            continue
        if tag == "xmp":  # shown as it stands
            stop = re.compile(r"</xmp\s*>", re.I).search(page, at)
            put(f" {html.escape(page[at : stop.start() if stop else end])} ")
            at = stop.end() if stop else end
            continue
        if tag in VOID:
            if tag in BREAKS:
                pieces.append((stack[-1][1], " "))
            continue
        if tag in INLINE:
            links += tag == "a"
            stack.append((tag, stack[-1][1]))
            continue
        links = 0
        pieces.append((stack[-1][1], " "))
        for k in range(len(stack) - 1, 0, -1):  # an open p ends before a block
            if stack[k][0] == "p":
                del stack[k:]
                break
            if stack[k][0] not in INLINE:
                break
        while len(stack) > 1 and stack[-1][0] in INLINE:
            stack.pop()
        if tag in CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in BOUNDARY[tag]:
                    break
                if stack[k][0] in CLOSES[tag]:
                    del stack[k:]
                    break
        names, label = [], None
        if attrs.strip():
            for a in ATTRIBUTE.finditer(attrs):
                name, value = a[1].lower(), (a[2] or "").strip("\"'")
                if name == "data-y":
                    label = int(value) if labelled else None
                elif name in ("hidden", "aria-hidden"):
                    if value.lower() != "false":
                        names.append("hidden")
                else:
                    names += WORD.findall(value.lower())
        out.append(Block(tag, stack[-1][1], tuple(names), label))
        stack.append((tag, len(out) - 1))
    if at < end:
        cut_off = UNFINISHED.search(page, max(at, last))
        put(page[at : cut_off.start() if cut_off else end])
    return out, pieces


def features(b: Block, parent: Block | None) -> list[str]:
    size = sum(b.text)
    density = 0 if not size else min(3, int(4 * b.links / size))
    out = ["bias", f"t:{b.tag}", f"n:{min(8, size.bit_length())}", f"l:{density}"]
    if size:
        out.append(f"l:{density}:{'long' if size > 60 else 'short'}")
    if parent is not None:
        out.append(f"t:{b.tag}<{parent.tag}")
    out += [f"c:{x}" for x in set(b.names)]
    if b.names:
        out.append("named")
    return out


def pair_keys(b: Block, parent: Block) -> tuple[str, ...]:
    named = "named" if b.names else "plain"
    return "p:*", f"p:{b.tag}:{named}", f"p:{b.tag}<{parent.tag}:{named}", f"p:<{parent.tag}:{'named' if parent.names else 'plain'}"


class Tree:
    """Exact inference on a page's blocks, states 0 and 1."""

    def __init__(self, nodes: list[Block], weights: dict[str, float], pairs: dict[str, list[float]]):
        self.names = [features(b, nodes[b.parent] if b.parent >= 0 else None) for b in nodes]
        self.keys = [pair_keys(b, nodes[b.parent]) for b in nodes]
        self.parent = [b.parent for b in nodes]
        self.weigh(weights, pairs)

    def weigh(self, weights: dict[str, float], pairs: dict[str, list[float]]) -> None:
        """Sets the potentials from weights."""
        zero = (0.0, 0.0, 0.0, 0.0)
        self.unary = [sum([weights.get(f, 0.0) for f in names]) for names in self.names]
        self.pair = []
        for k1, k2, k3, k4 in self.keys:
            a, b, c, d = pairs.get(k1, zero), pairs.get(k2, zero), pairs.get(k3, zero), pairs.get(k4, zero)
            self.pair.append((a[0] + b[0] + c[0] + d[0], a[1] + b[1] + c[1] + d[1], a[2] + b[2] + c[2] + d[2], a[3] + b[3] + c[3] + d[3]))

    def run(self) -> None:
        """Messages are log-odds free: normalised pairs for states 0 and 1."""
        n, exp, log1p = len(self.unary), math.exp, math.log1p

        def lse(x, y):
            return x + log1p(exp(y - x)) if x > y else y + log1p(exp(x - y))

        up0, up1 = [0.0] * n, list(self.unary)  # belief of a subtree by its root's state
        msg0, msg1 = [0.0] * n, [0.0] * n  # message to the parent by the parent's state
        for k in range(n - 1, 0, -1):
            p00, p01, p10, p11 = self.pair[k]
            m0, m1 = lse(p00 + up0[k], p01 + up1[k]), lse(p10 + up0[k], p11 + up1[k])
            msg0[k], msg1[k] = m0, m1
            up0[self.parent[k]] += m0
            up1[self.parent[k]] += m1
        all0, all1 = list(up0), list(up1)  # belief of the whole tree by a node's state
        down = [(0.0, 0.0)] * n
        for k in range(1, n):
            q = self.parent[k]
            a0, a1 = all0[q] - msg0[k], all1[q] - msg1[k]
            p00, p01, p10, p11 = self.pair[k]
            d0, d1 = lse(a0 + p00, a1 + p10), lse(a0 + p01, a1 + p11)
            shift = max(d0, d1)
            all0[k], all1[k] = up0[k] + d0 - shift, up1[k] + d1 - shift
            down[k] = (a0, a1)
        self.up0, self.up1, self.down = up0, up1, down
        self.marginal = [1 / (1 + exp(min(700.0, all0[k] - all1[k]))) for k in range(n)]

    def pair_marginals(self, k: int) -> list[float]:
        a0, a1 = self.down[k]
        p = self.pair[k]
        s = [a0 + p[0] + self.up0[k], a0 + p[1] + self.up1[k], a1 + p[2] + self.up0[k], a1 + p[3] + self.up1[k]]
        top = max(s)
        e = [math.exp(x - top) for x in s]
        z = sum(e)
        return [x / z for x in e]


def truth(nodes: list[Block]) -> list[int]:
    """States of a labelled page: a block without a label follows most of the text below it."""
    good, every = [0] * len(nodes), [0] * len(nodes)
    for k in range(len(nodes) - 1, -1, -1):
        size = sum(nodes[k].text)
        good[k] += size * (nodes[k].label or 0)
        every[k] += size
        if k:
            good[nodes[k].parent] += good[k]
            every[nodes[k].parent] += every[k]
    return [b.label if b.label is not None else int(2 * good[k] > every[k]) for k, b in enumerate(nodes)]


Model = tuple[dict[str, float], dict[str, list[float]]]


def train(pages: list[str]) -> Model:
    """Stochastic gradient ascent on the likelihood, with AdaGrad steps."""
    weights: dict[str, float] = {}
    pairs: dict[str, list[float]] = {"p:*": [0.0] * 4}
    seen: dict[str, float] = {}

    def step(key: str, old: float, g: float) -> float:
        seen[key] = seen.get(key, 1e-6) + g * g
        return (old + RATE * g / math.sqrt(seen[key])) * (1 - SHRINK)

    data = [(nodes, truth(nodes), Tree(nodes, weights, pairs)) for nodes in (blocks_of(p)[0] for p in pages)]
    for _ in range(EPOCHS):
        for nodes, y, tree in data:
            tree.weigh(weights, pairs)
            tree.run()
            grad: dict[str, float] = {}
            pair_grad: dict[str, list[float]] = {}
            for k, b in enumerate(nodes):
                g = y[k] - tree.marginal[k]
                for f in tree.names[k]:
                    grad[f] = grad.get(f, 0.0) + g
                if k:
                    e = tree.pair_marginals(k)
                    e[2 * y[b.parent] + y[k]] -= 1
                    for key in tree.keys[k]:
                        sums = pair_grad.get(key)
                        if sums is None:
                            pair_grad[key] = [-x for x in e]
                        else:
                            for i in range(4):
                                sums[i] -= e[i]
            for f, g in grad.items():
                weights[f] = step(f, weights.get(f, 0.0), g)
            for key, g in pair_grad.items():
                old = pairs.get(key, [0.0] * 4)
                pairs[key] = [step(f"{key}{i}", old[i], g[i]) for i in range(4)]
    return weights, pairs


@functools.cache
def default_model() -> Model:
    """The model of the fixed training pages; the same in every process."""
    return train(labelled_pages(N_TRAIN, SEED))


def main_text(page: str | None, model: Model) -> str:
    if not page:
        return ""
    nodes, pieces = blocks_of(page, labelled=False)
    tree = Tree(nodes, *model)
    tree.run()
    kept, last = [], None
    for k, text in pieces:
        if tree.marginal[k] > 0.5:
            if last is not None and last != k:
                kept.append(" ")
            kept.append(text)
            last = k
    return " ".join(html.unescape("".join(kept)).split())


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) per row of pages."""
    ship(pages.sparkSession)
    held = pages.sparkSession.sparkContext.broadcast(model or default_model())

    def run(batches):
        for batch in batches:
            texts = [main_text(x, held.value) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
