"""Main text of web pages: a tree-structured graphical model over DOM nodes.

A page becomes a tree of elements. Every element has a hidden state, content or not; a node
potential reads its features (tag, class and id words, text and link lengths, place among its
ancestors) and an edge potential couples it with its parent. Sum-product messages go up and down
the tree once, which is exact on a tree, and leave every node's content marginal. A block of text
belongs to the main text if the marginal of its element is at least one half.

The weights are trained by gradient ascent on the exact log-likelihood (expected counts from the
same messages) of labelled pages: small pages written from the layouts of ``LAYOUTS``, whose
elements carry the label. The layouts vary tags, class names, order and lengths, so
that neither tags nor names alone decide.

Scripts, styles, comments and the like never hold text. Blocks are the stretches between
block-level tags; white space inside one is one blank, character references are decoded, blocks
are joined by a line feed. Broken markup is read as browsers do in the common cases: a paragraph
ends at the next block, a list item at the next item, an unknown end tag is ignored.

Nulls: a null or empty html has the empty text; a page of bare text is one block of its root.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template noscript iframe svg annotation annotation-xml object canvas audio video select textarea button head title datalist".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
RAW = ("script", "style", "textarea", "title", "template", "noscript", "iframe", "svg")
# Elements whose start ends an open element of these names.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HEADS = ("p", "h1", "h2", "h3", "h4", "h5", "h6")
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
NAMES = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s\"'>]+)))?")
CONCEALS = re.compile(r"hidden|style", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Words of class, id and role names, by what they tell. The model learns what each group is worth.
CUES = {
    "main": "article main content post story entry body text blogpost hentry prose",
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs toc pagination pager tabs skip",
    "frame": "header footer masthead banner top bottom copyright legal colophon foot head logo brand",
    "side": "sidebar aside side widget related recommended popular trending tags share social follow author bio promo more",
    "ad": "ad ads advert advertisement adsense sponsor sponsored promoted outbrain taboola",
    "notice": "cookie cookies consent notice alert popup modal overlay gdpr privacy newsletter subscribe signup banner paywall",
    "comment": "comment comments reply replies respond discussion disqus reader response thread",
    "form": "form search login signin register input",
}
CUE_OF = {w: g for g, ws in CUES.items() for w in ws.split()}
TAGS = ("article", "main", "section", "div", "p", "h", "li", "ul", "nav", "header", "footer", "aside", "form", "td", "table", "blockquote", "pre", "figure", "body", "other")


def hides(attributes: str) -> bool:
    """Whether an element says itself that it is not shown; of a repeated attribute the first counts,
    of a repeated declaration the last."""
    if not CONCEALS.search(attributes):
        return False
    own: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attributes):
        own.setdefault(m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or ""))
    if "hidden" in own or own.get("aria-hidden", "").strip().lower() == "true":
        return True
    style = dict(d.lower().split(":", 1) for d in own.get("style", "").split(";") if ":" in d)
    style = {k.strip(): v.replace("!important", "").strip() for k, v in style.items()}
    return style.get("display") == "none" or style.get("visibility") == "hidden"


class Node:
    __slots__ = ("tag", "parent", "cues", "text", "links", "hidden", "children")

    def __init__(self, tag: str, parent: int, attributes: str):
        self.tag, self.parent, self.text, self.links, self.children = tag, parent, 0, 0, 0
        self.hidden = bool(attributes) and hides(attributes)
        self.cues = frozenset(
            CUE_OF[w] for m in NAMES.finditer(attributes) for w in map(str.lower, WORD.findall(m[1] or m[2] or m[3] or "")) if w in CUE_OF
        ) if attributes else frozenset()


def parse(page: str):
    """Nodes in order of their starts (parents before children), and the pieces (node, text) of
    visible text; None marks a block's end."""
    nodes, pieces, stack = [Node("root", -1, "")], [], [0]
    at, silent, opened = 0, 0, Counter()

    def say(text: str):
        if text and not silent:
            # References end with the piece: markup inside one keeps it from being one.
            pieces.append((stack[-1], entities.unescape(text)))

    def close(k: int):
        nonlocal silent
        for i in stack[k:]:
            silent -= nodes[i].tag in SILENT or nodes[i].hidden
            opened[nodes[i].tag] -= 1
        if any(nodes[i].tag in BLOCK for i in stack[k:]):
            pieces.append(None)
        del stack[k:]

    while m := TOKEN.search(page, at):
        say(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            # Looking is paid for by what closes; an end without an open element looks nowhere.
            if opened[name]:
                k = len(stack) - 1
                while nodes[stack[k]].tag != name:
                    k -= 1
                close(k)
            elif name in BLOCK:
                pieces.append(None)
            continue
        if name in BLOCK:
            pieces.append(None)
            if nodes[stack[-1]].tag == "head":
                close(len(stack) - 1)
            # A paragraph, with what is open in it, ends where a block starts.
            for k in range(len(stack) - 1, 0, -1) if any(opened[t] for t in HEADS) else ():
                tag = nodes[stack[k]].tag
                if tag == "p" or re.fullmatch("h[1-6]", tag) and re.fullmatch("h[1-6]", name):
                    close(k)
                    break
                if tag in BLOCK:
                    break
        if name in ENDS:
            for k in range(len(stack) - 1, 0, -1) if any(opened[t] for t in ENDS[name]) else ():
                tag = nodes[stack[k]].tag
                if tag in ENDS[name]:
                    close(k)
                    break
                if tag in ("ul", "ol", "table", "dl", "select"):
                    break
        if name in VOID:
            if name in ("br", "hr"):
                say(" ")
            continue
        attributes = m[3] or ""
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if attributes.rstrip().endswith("/") and name not in BLOCK:
            continue
        nodes.append(Node(name, stack[-1], attributes))
        nodes[stack[-1]].children += 1
        stack.append(len(nodes) - 1)
        opened[name] += 1
        silent += name in SILENT or nodes[-1].hidden
    say(page[at:])
    return nodes, pieces


def measured(nodes: list[Node], pieces) -> None:
    """Text and link-text characters below every node."""
    inside = [False] * len(nodes)
    for i, n in enumerate(nodes):
        inside[i] = n.tag == "a" or (n.parent >= 0 and inside[n.parent])
    for piece in pieces:
        if piece:
            size = len(piece[1].strip())
            nodes[piece[0]].text += size
            nodes[piece[0]].links += size * inside[piece[0]]
    for i in range(len(nodes) - 1, 0, -1):
        nodes[nodes[i].parent].text += nodes[i].text
        nodes[nodes[i].parent].links += nodes[i].links


def _tag(name: str) -> str:
    if re.fullmatch("h[1-6]", name):
        return "h"
    if name in ("ul", "ol", "dl"):
        return "ul"
    if name in ("li", "dt", "dd"):
        return "li"
    if name in ("td", "th", "tr"):
        return "td"
    if name in TAGS:
        return name
    return "other"


FEATURES = [*(f"tag {t}" for t in TAGS), *(f"cue {c}" for c in CUES), "links", "no links", "short", "long", "very long", "share", "plain", "plain text", "under tag", "under cue", "under main", "links under main", "one"]
PLACE = {f: i for i, f in enumerate(FEATURES)}


def blocks_of(nodes: list[Node]) -> list[int]:
    """The block of every node: itself if it is the root or block-level, else its nearest ancestor that
    is. The model's tree has the blocks only; what is inline belongs to the block around it."""
    out = [0] * len(nodes)
    for i, n in enumerate(nodes[1:], 1):
        out[i] = i if n.tag in BLOCK else out[n.parent]
    return out


def tree(nodes: list[Node]) -> tuple[list[int], list[int], np.ndarray]:
    """The blocks (as node numbers), their parents (as places in that list) and their features."""
    block = blocks_of(nodes)
    own = [i for i, b in enumerate(block) if i == b]
    place = {i: k for k, i in enumerate(own)}
    parents = [-1, *(place[block[nodes[i].parent]] for i in own[1:])]
    return own, parents, features([nodes[i] for i in own], parents)


ASIDE_TAGS = frozenset(("nav", "footer", "aside", "form", "header", "dialog"))
ASIDE_CUES = frozenset(("menu", "side", "ad", "notice", "comment", "form"))


def features(nodes: list[Node], parents: list[int]) -> np.ndarray:
    x = np.zeros((len(nodes), len(FEATURES)))
    whole = max(1, nodes[0].text)
    # A page that marks no part as its main one.
    plain = not any(n.tag in ("article", "main", "section") or "main" in n.cues for n in nodes)
    for i, n in enumerate(nodes):
        row = x[i]
        if not i:
            continue  # the root is no element
        above = nodes[parents[i]]
        row[PLACE["under tag"]] = x[parents[i], PLACE["under tag"]] or above.tag in ASIDE_TAGS
        row[PLACE["under cue"]] = x[parents[i], PLACE["under cue"]] or bool(above.cues & ASIDE_CUES)
        row[PLACE[f"tag {_tag(n.tag)}"]] = 1
        for c in n.cues:
            row[PLACE[f"cue {c}"]] = 1
        share = n.links / n.text if n.text else 0.0
        row[PLACE["links"]] = share > 0.5
        row[PLACE["no links"]] = n.text > 0 and share < 0.1
        # Below an article and no aside of it: links may well be part of the text.
        aside = row[PLACE["under tag"]] or row[PLACE["under cue"]]
        row[PLACE["under main"]] = not aside and (x[parents[i], PLACE["under main"]] or above.tag in ("article", "main") or "main" in above.cues)
        row[PLACE["links under main"]] = row[PLACE["links"]] and row[PLACE["under main"]]
        row[PLACE["short"]] = n.text < 30
        row[PLACE["long"]] = n.text >= 120
        row[PLACE["very long"]] = n.text >= 600
        row[PLACE["share"]] = n.text / whole
        row[PLACE["plain"]] = plain
        row[PLACE["plain text"]] = plain and _tag(n.tag) in ("p", "h", "li", "ul", "blockquote", "pre")
        row[PLACE["one"]] = 1
    return x


# ------------------------------------------------------------------------- the tree model


def _log_sum(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


class TreeModel:
    """Weights of node features for the state "content", and log potentials parent x child."""

    def __init__(self):
        self.w = np.zeros(len(FEATURES))
        self.edge = np.zeros((2, 2))

    def marginals(self, parent: list[int], x: np.ndarray):
        """Content marginals of the nodes, summed edge marginals (parent state, child state), log Z."""
        n = len(parent)
        (e00, e01), (e10, e11) = self.edge.tolist()
        up0, up1 = [0.0] * n, (x @ self.w).tolist()
        to0, to1 = [0.0] * n, [0.0] * n
        for i in range(n - 1, 0, -1):  # children come after their parents
            # The message of i to its parent, for each state of the parent.
            to0[i], to1[i] = _log_sum(e00 + up0[i], e01 + up1[i]), _log_sum(e10 + up0[i], e11 + up1[i])
            up0[parent[i]] += to0[i]
            up1[parent[i]] += to1[i]
        z = _log_sum(up0[0], up1[0])
        down0, down1, node = [0.0] * n, [0.0] * n, [0.0] * n
        node[0] = math.exp(up1[0] - z)
        pairs = [0.0] * 4
        for i in range(1, n):
            p = parent[i]
            # All that the parent knows but from i.
            rest0, rest1 = down0[p] + up0[p] - to0[i], down1[p] + up1[p] - to1[i]
            joint = [math.exp(v - z) for v in (rest0 + e00 + up0[i], rest0 + e01 + up1[i], rest1 + e10 + up0[i], rest1 + e11 + up1[i])]
            pairs = [a + b for a, b in zip(pairs, joint)]
            down0[i], down1[i] = _log_sum(rest0 + e00, rest1 + e10), _log_sum(rest0 + e01, rest1 + e11)
            node[i] = joint[1] + joint[3]
        return np.array(node), np.array(pairs).reshape(2, 2), z

    def train(self, pages: list[tuple[list[int], np.ndarray, np.ndarray]], steps: int = 300, rate: float = 1.0, decay: float = 1e-5) -> list[float]:
        """Adagrad on the mean log-likelihood per node; ``pages``: parents, features, labels."""
        sums = [np.full_like(self.w, 1e-6), np.full_like(self.edge, 1e-6)]
        total, out = sum(len(p) for p, _, _ in pages), []
        for _ in range(steps):
            gw, ge, value = np.zeros_like(self.w), np.zeros_like(self.edge), 0.0
            for parent, x, y in pages:
                node, pairs, z = self.marginals(parent, x)
                gw += x.T @ (y - node)
                ge -= pairs
                above = y[np.array(parent[1:], int)]
                np.add.at(ge, (above, y[1:]), 1.0)
                value += (x @ self.w)[y == 1].sum() + self.edge[above, y[1:]].sum() - z
            for g, s, v in ((gw / total - decay * self.w, sums[0], self.w), (ge / total - decay * self.edge, sums[1], self.edge)):
                s += g * g
                v += rate * g / np.sqrt(s)
            out.append(value / total)
        return out


# Labelled pages are written from these layouts: "+" opens a content element, "-" one that is not,
# "~" an element whose children decide (labelled like the page's frame, not content).
LAYOUTS = (
    "~body(-header(logo) -nav(links) +article(h paras) -footer(small))",
    "~body(-nav(links) -div.ad(text) +article(h paras) -footer(text))",
    "~body(-div.header(logo links) ~div.wrapper(+div.content(h paras list) -div.sidebar(h links line)) -div.footer(h small))",
    "~body(-header(logo -nav(links)) +main(h paras quote) -aside(h line links) -section.comments(h remark remark remark) -footer(small links))",
    "~body(-div.cookie-notice(line) ~div.page(+div.post(h paras) -div.related(h links) -div.comments(h remark remark)) -footer(small))",
    "~body(-ul.menu(links) ~div(~div(+div(h paras text table))) -form(line) -div.copyright(text))",
    "~body(-div.alert(para) -nav(links) +main(+article(h paras list) -div.share(links) -aside(text) -div.newsletter(para)) -footer(para small))",
    "~body(+section(h paras) +section(h text) -aside.promo(h para) -div.advert(para) -footer(small))",
    "~body(-header(h links) +div.entry-content(paras h paras) -div.author-bio(para) -ol.commentlist(h remark remark remark) -form.search(line))",
    "~body(-table(links) ~table(-td(links) +td(h paras)) -p(small))",
    "~body(-aside(links) +article(-header(small) h paras -footer(links)) -section.recommended(line line) -dialog(para))",
    "~body(+div(paras))",
    "~body(h paras)",
    "~body(-header(logo) +article(h paras -div.ad(line) paras -section.comments(h remark remark remark) -div.related(h links)) -footer(small))",
    "~body(-nav(links) +main(h paras -aside.sidebar(h links para) -form(line) -div.cookie-banner(para)) -footer(small))",
    "~body(-div.topnav(links) ~div.container(+div.post-content(h paras -div.advertisement(para) paras -div.share(links) list) -div.comments-area(h remark remark)))",
    "~body(-header(logo links) ~div.layout(-div.sidebar(h links para h line) +div.story(h paras quote) -div.widget(links)) -div.notice(text) -footer(links small))",
    "~body(-nav(links) ~section(+article(h paras list -div.comments(h remark remark)) -aside(text)) -div.newsletter-signup(line) -footer(small))",
    "~body(-nav(links) +article(h paras captioned paras linklist -footer.entry-meta(text)) -footer(small links))",
    "~body(-header(logo -nav(links)) +main(h linklist details terms address paras) -footer(para))",
    "~body(-div.header(logo links) ~div.wrap(+div.content(h captioned linklist details paras -footer(para)) -div.sidebar(h links)) -div.footer(small))",
    "~body(-nav(links) +main(+article(-header(small) h paras details -footer.meta(line)) -nav.pager(links) -aside(h linklist)) -footer(links))",
    "~body(-header(logo links) +div.entry(terms para captioned paras linklist) -div.related(h linklist) -div.comments(h remark remark) -footer(small))",
    "~body(-ul.nav(links) +article(h para linklist address terms -div.tags(links) -form.subscribe(line)) -section.related(captioned linklist) -footer(address para))",
    "~body(-div.banner(line) -div.breadcrumbs(links) +div.article-body(h para) -div.sponsored(para line) -div.disqus(remark para))",
)
PART = re.compile(r"([+\-~]?)([a-z0-9]+)((?:\.[a-z-]+)?)(\(?)|(\))|\s+")


def labelled_page(layout: str, rng: np.random.Generator) -> tuple[str, list[int]]:
    """A page of the layout, and the label of every element in order of the starts (root first)."""
    whole = int("+" not in layout)
    out, labels, stack = [], [whole], [("", whole)]
    bare = rng.random() < 0.3  # without a body element

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 9))) for _ in range(rng.integers(low, high)))

    def element(tag: str, text: str, y: int):
        out.append(f"<{tag}>{text}</{tag}>")
        labels.append(y)

    def leaf(kind: str, y: int):
        if kind == "h":
            element(f"h{rng.integers(1, 4)}", words(2, 12), y)
        elif kind in ("paras", "para"):
            for _ in range(1 if kind == "para" else rng.integers(1, 7)):
                long = rng.random()
                element("p", words(1, 90) if long < 0.6 else words(90, 400) if long < 0.75 else words(1, 6), y)
        elif kind == "list":
            out.append("<ul>")
            labels.append(y)
            for _ in range(rng.integers(2, 6)):
                element("li", words(3, 25), y)
            out.append("</ul>")
        elif kind == "links":
            out.append("<ul>")
            labels.append(y)
            for _ in range(rng.integers(3, 9)):
                out.append("<li>")
                labels.append(y)
                element("a", words(1, 3), y)
                out.append("</li>")
            out.append("</ul>")
        elif kind == "linklist":
            name = "ol" if rng.random() < 0.5 else "ul"
            out.append(f"<{name}>")
            labels.append(y)
            for _ in range(rng.integers(2, 8)):
                out.append("<li>")
                labels.append(y)
                element("a", words(2, 9), y)
                out.append("</li>")
            out.append(f"</{name}>")
        elif kind == "captioned":
            out.append('<figure><img src="x.png">')
            labels.append(y)
            element("figcaption", words(2, 16), y)
            out.append("</figure>")
        elif kind == "details":
            out.append("<details>")
            labels.append(y)
            element("summary", words(1, 6), y)
            element("p", words(3, 120), y)
            out.append("</details>")
        elif kind == "terms":
            out.append("<dl>")
            labels.append(y)
            for _ in range(rng.integers(1, 5)):
                element("dt", words(1, 4), y)
                element("dd", words(2, 25), y)
            out.append("</dl>")
        elif kind == "address":
            element("address", words(2, 12), y)
        elif kind == "remark":
            out.append('<div class="comment">')
            labels.append(y)
            element("p", words(2, 60), y)
            out.append("</div>")
        elif kind == "quote":
            out.append("<blockquote>")
            labels.append(y)
            element("p", words(5, 40), y)
            out.append("</blockquote>")
        elif kind == "table":
            out.append("<table>")
            labels.append(y)
            for _ in range(rng.integers(2, 4)):
                out.append("<tr>")
                labels.append(y)
                element("td", words(1, 6), y)
                element("td", words(1, 6), y)
                out.append("</tr>")
            out.append("</table>")
        elif kind == "text":
            out.append(words(3, 40))
        elif kind == "logo":
            element("a", words(1, 3), y)
        else:  # line, small
            element("p" if rng.random() < 0.5 else "span", words(2, 14), y)

    for m in PART.finditer(layout):
        if m[5]:
            tag = stack.pop()[0]
            out.append("" if bare and tag == "body" else f"</{tag}>")
        elif m[2]:
            mark, tag, name, opens = m[1], m[2], m[3][1:], m[4]
            if opens:
                y = {"+": 1, "-": 0, "~": whole}[mark]
                if bare and tag == "body":
                    stack.append((tag, y))
                    continue
                # Some names are left out, so that they are no more than a hint.
                out.append(f'<{tag} class="{name}">' if name and rng.random() < 0.85 else f"<{tag}>")
                labels.append(y)
                stack.append((tag, y))
            else:
                leaf(tag, stack[-1][1])
    return "".join(out), labels


@cache
def trained(copies: int = 7, seed: int = 5) -> TreeModel:
    """The model of the labelled pages: ``copies`` of every layout."""
    rng, pages = np.random.default_rng(seed), []
    for layout in LAYOUTS * copies:
        page, labels = labelled_page(layout, rng)
        nodes, pieces = parse(page)
        measured(nodes, pieces)
        own, parents, x = tree(nodes)
        pages.append((parents, x, np.array(labels)[own]))
    model = TreeModel()
    model.train(pages)
    return model


def main_text(page: str | None, model: TreeModel) -> str:
    if not page:
        return ""
    nodes, pieces = parse(page)
    measured(nodes, pieces)
    own_block, (tops, parents, x) = blocks_of(nodes), tree(nodes)
    content = dict(zip(tops, (model.marginals(parents, x)[0] >= 0.5).tolist()))
    blocks, parts, own = [], [], []

    def end():
        text = " ".join("".join(parts).split())
        if text and own and sum(own) * 2 >= len(own):
            blocks.append(text)
        parts.clear()
        own.clear()

    for piece in pieces:
        if piece is None:
            end()
            continue
        parts.append(piece[1])
        if piece[1].strip():
            own.append(content[own_block[piece[0]]] or len(nodes) == 1)
    end()
    return "\n".join(blocks)


def extract(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches):
        for b in batches:
            text = [main_text(p, shared.value) for p in b["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(text, pa.string())], ["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string")
    return rows.withColumn("n_chars", F.length("text").cast("long"))
