"""Main text of web pages: boosted trees over DOM-node features, decoded along the tree.

A page is parsed into block elements and their runs of text. Each block element gets features: depth,
position, text and link density of its subtree, tag counts, attribute tokens of itself and its ancestors,
and what its siblings are like. Boosted trees give the log-odds that it belongs to the article. Decoding
then chooses the most likely consistent states top-down along the tree: outside an article a node may stay
outside, become the article or be excluded; inside an article it stays inside or is excluded; what is below
an excluded node is excluded. So no node contradicts an ancestor.

The trees are fitted on SAMPLE_PAGES made-up pages of varied layout with known article (``made_up_page``), and on
BARE_PAGES whose article stands directly in the body, or in the page where it has none; so the body and the root can be
the article too. Attribute tokens (words of class, id, role and the like) count by weights learned on a sample of their own:
the log-odds that an element with the token is in the article. A node's features have the highest and the lowest of its tokens.

Parsing takes time linear in the page: open elements are found by name through lists of their places, never by a
walk over the stack, and what follows the last '>' is not searched for tags.
Text is taken from all blocks inside the article, whole and in page order: character references decoded,
white space in a block as one space, ends trimmed, blocks joined by line ends. Null and empty html gives the
empty text; a page without tags is one block of text in the root, judged like any other.
Rows with equal ids are all kept; extra columns are left aside; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting
from .common import map_arrow

SAMPLE_PAGES = 500
BARE_PAGES = 150
TOKEN_PAGES = 500
RARE = 4  # attribute tokens in fewer elements than this have no weight
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<svg(?=[\s/>])(?:[^>\"'/]++|\"[^\"]*+\"|'[^']*+'|/(?!>))*+/>|<(script|style|noscript|template|svg|textarea|select|iframe)(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>|<[!?/][^>]*+>|[^<]++|<", re.S | re.I)
ATTR = re.compile(r"(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
KEEPS_P = frozenset("body html head title".split())
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
KIND = {t: n for n, tags in enumerate(("article main", "nav menu", "aside", "footer", "header", "form fieldset dialog", "head title", "body html", "section div", "ul ol dl", "li dt dd", "h1 h2 h3 h4 h5 h6", "p pre blockquote", "table tbody thead tr td th")) for t in tags.split()}
FLAGS = (0, 1, 2, 3, 4, 5, 6, 7)


class Node:
    __slots__ = ("tag", "parent", "depth", "tokens", "kids", "start", "chars", "links", "tags", "stops")

    def __init__(self, tag: str, parent: int, depth: int, marks: str, start: int):
        self.tag, self.parent, self.depth, self.start = tag, parent, depth, start
        self.tokens = {x.lower() for x in WORD.findall(marks)} if marks else ()
        self.kids, self.chars, self.links, self.tags, self.stops = 0, 0, 0, 0, 0


class _Open:
    """The open elements: their stack, the places of each name in it, and the block elements among them."""

    def __init__(self):
        self.stack: list[str] = ["#root"]
        self.at: dict[str, list[int]] = {}
        self.blocks: list[tuple[int, int]] = [(0, 0)]  # (place in the stack, node)
        self.links = 0

    def push(self, tag: str, node: int | None = None) -> None:
        self.at.setdefault(tag, []).append(len(self.stack))
        if node is not None:
            self.blocks.append((len(self.stack), node))
        self.links += tag == "a"
        self.stack.append(tag)

    def cut(self, place: int) -> None:
        """Close the element at this place of the stack and all within it."""
        while len(self.stack) > place:
            tag = self.stack.pop()
            self.at[tag].pop()
            self.links -= tag == "a"
        while self.blocks[-1][0] >= place:
            self.blocks.pop()

    def top(self) -> int:
        return self.blocks[-1][1]


def _tokens(page: str) -> Iterator[re.Match | str]:
    """What TOKEN finds, and the text behind the last '>', where no tag can end."""
    end, m = page.rfind(">") + 1, None
    for m in TOKEN.finditer(page, 0, end):
        yield m
    if m is not None and m[0].startswith("<!--"):
        inside = len(m[0]) < 7 or not m[0].endswith("-->")
    else:
        inside = m is not None and m[1] is not None and not m[0][:-1].rstrip().lower().endswith(f"</{m[1].lower()}")
    if end < len(page) and not inside:  # else it is within a comment or element that is never closed
        yield page[end:].partition("<!--")[0]


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block elements in page order (the first is the root) and the blocks of text, each with its element."""
    nodes, there, blocks = [Node("#root", -1, 0, "", 0)], _Open(), []
    run: list[str] = []
    top = 0

    def flush() -> None:
        if run:
            text = " ".join(entities.unescape("".join(run)).split())
            run.clear()
            if text:
                blocks.append((top, text))
                node = nodes[top]
                node.chars += len(text)
                node.stops += sum(map(text.count, ".,;!?"))

    for m in _tokens(page):
        shown = m if isinstance(m, str) else m[0]
        tag = None if isinstance(m, str) else m[3]
        if tag is None:
            if shown[:1] != "<" or shown == "<" or isinstance(m, str):
                run.append(shown)
                if there.links:
                    nodes[top].links += len(shown.strip())
            continue
        tag = tag.lower()
        block = tag in BLOCKS
        if m[2]:
            if there.at.get(tag):
                if block:
                    flush()
                there.cut(there.at[tag][-1])
                top = there.top()
            continue
        if not block:
            if tag == "br":
                run.append(" ")
            nodes[top].tags += 1
            if tag not in VOID and not m[4].endswith("/"):
                there.push(tag)
            continue
        flush()
        closing = CLOSES.get(tag, ())
        while len(there.blocks) > 1:
            place = there.blocks[-1][0]
            t = there.stack[place]
            if not ((t == "p" and tag not in KEEPS_P) or t in closing):
                break
            there.cut(place)
            if t not in ("td", "th"):
                break
        top = there.top()
        if tag in VOID:
            nodes[top].tags += 1
            continue
        marks = " ".join(x[2] or x[3] or x[4] or "" for x in ATTR.finditer(m[4])) if m[4] else ""
        nodes[top].kids += 1
        nodes.append(Node(tag, top, nodes[top].depth + 1, marks, len(blocks)))
        top = len(nodes) - 1
        there.push(tag, top)
    flush()
    return nodes, blocks


def node_features(nodes: list[Node], blocks: list[tuple[int, str]], weights: dict[str, float]) -> np.ndarray:
    """A row of features for each node; weights are those of attribute tokens."""
    n = len(nodes)
    parent = np.array([x.parent for x in nodes])
    own = np.array([[x.chars, x.links, x.tags + 1, x.tag in ("p", "pre", "blockquote"), x.stops, x.tag == "li"] for x in nodes], float)
    sub = own.copy()
    for i in range(n - 1, 0, -1):
        sub[parent[i]] += sub[i]
    up = np.maximum(parent, 0)
    kind = np.array([KIND.get(x.tag, 14) for x in nodes])
    good = np.array([max((weights.get(t, 0.0) for t in x.tokens), default=0.0) for x in nodes])
    bad = np.array([-min((weights.get(t, 0.0) for t in x.tokens), default=0.0) for x in nodes])
    flags = [(kind == k).astype(float) for k in FLAGS]
    above = np.stack([good, bad, *flags[:6]], 1)
    for i in range(1, n):
        above[i] = np.maximum(above[i], above[parent[i]])
    kids = np.array([x.kids for x in nodes], float)
    total = max(sub[0, 0], 1.0)
    first = np.array([x.start for x in nodes], float) / max(len(blocks), 1)
    same = {}
    for x in nodes:
        same[x.parent, x.tag] = same.get((x.parent, x.tag), 0) + 1
    alike = np.array([same[x.parent, x.tag] for x in nodes], float)
    chars = sub[:, 0]
    density = chars / sub[:, 2]
    direct = own[:, 0] / np.maximum(chars, 1)
    return np.stack(
        [np.array([x.depth for x in nodes], float), kind, good, bad, *above.T, chars, chars / total, density, sub[:, 1] / np.maximum(chars, 1), sub[:, 3], sub[:, 5], sub[:, 4] / np.maximum(chars, 1), kids, kids[up], alike, first, chars[up] / total, density[up], (sub[:, 1] / np.maximum(chars, 1))[up], sub[:, 3][up], direct], 1
    )


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """For each node whether it is inside the article, in the best consistent choice of states."""
    odds = np.clip(odds, -4, 4)
    n = len(nodes)
    out = np.zeros(n)  # best gain of a subtree whose root is outside, and inside; excluded subtrees gain nothing
    inside = odds.astype(float)
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        out[p] += max(out[i], inside[i], 0.0)
        inside[p] += max(inside[i], 0.0)
    state = [0] * n  # 0 outside, 1 inside, 2 excluded
    state[0] = 1 if inside[0] > max(out[0], 0.0) else 0
    for i in range(1, n):
        up = state[nodes[i].parent]
        if up == 0:
            state[i] = 1 if inside[i] > max(out[i], 0.0) else 0
        elif up == 1:
            state[i] = 1 if inside[i] > 0 else 2
        else:
            state[i] = 2
    return np.array(state) == 1


class Model(NamedTuple):
    weights: dict[str, float]
    trees: boosting.Boosted


def extract(pages: list[str | None], model: Model) -> list[str]:
    """The main text of each page."""
    parsed = [parse(p or "") for p in pages]
    if not parsed:
        return []
    margins = model.trees.margin(np.concatenate([node_features(*x, model.weights) for x in parsed]))
    out, at = [], 0
    for nodes, blocks in parsed:
        inside = decode(nodes, margins[at : at + len(nodes)])
        at += len(nodes)
        out.append("\n".join(text for node, text in blocks if inside[node]))
    return out


def made_up_page(r: random.Random, bare: bool = False) -> tuple[str, str]:
    """A page and its main text; boilerplate in many forms around and inside an article, which has no element of its own if bare."""
    syllables = "tion an er the re heit ung que ment ción ing ver os eau lo mi".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    def prose(n: int) -> str:
        return " ".join(word() + (r.choice([".", ",", ""]) if r.random() < 0.2 else "") for _ in range(n)).capitalize() + "."

    some = lambda names: r.choice(names.split())
    links = lambda k: "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(k))
    attr = lambda names: r.choice([f' class="{some(names)}"', f' id="{some(names)}"', f' class="{word()} {some(names)}"'])

    def nav() -> str:
        inner = f"<ul>{links(r.randint(3, 9))}</ul>"
        return r.choice([f"<nav>{inner}</nav>", f"<div{attr('menu navbar nav nav-main topmenu breadcrumbs navigation site-nav main-menu toolbar pager pagination tabs')}>{inner}</div>", f"<div>{inner}</div>"])

    def aside() -> str:
        inner = f"<h3>{word()}</h3>" + r.choice([f"<ul>{links(r.randint(2, 6))}</ul>", f"<p>{prose(r.randint(5, 25))}</p>"])
        return r.choice([f"<aside>{inner}</aside>", f"<div{attr('sidebar side-column widget related promo aside secondary related-posts tag-cloud tags share social recommended popular')}>{inner}</div>"])

    def ad() -> str:
        inner = prose(r.randint(4, 30))
        return f"<div{attr('ad ads advert ad-slot sponsored banner promo advertisement ad-unit sponsor adbox promotion')}>{r.choice([inner, f'<p>{inner}</p>'])}</div>"

    def notice() -> str:
        inner = f"<p>{prose(r.randint(6, 30))}</p>" + r.choice(["", "<button>OK</button>"])
        return f"<div{attr('cookie-notice notice consent alert newsletter popup subscribe cookies cookie-bar message modal overlay paywall subscription')}>{inner}</div>"

    def form() -> str:
        return f'<form{r.choice(["", attr("login search contact signup search-form register")])}><label>{word()}</label><input name="q"><p>{prose(r.randint(3, 12))}</p><button>{word()}</button></form>'

    def comments() -> str:
        inner = "".join(f"<div{attr('comment reply comment-body')}><p>{prose(r.randint(4, 40))}</p></div>" for _ in range(r.randint(1, 5)))
        return r.choice([f"<section{attr('comments discussion-comments disqus discussion responses reader-comments')}><h3>{word()}</h3>{inner}</section>", f"<div{attr('comments comment-list replies commentlist thread')}>{inner}</div>"])

    def footer() -> str:
        inner = r.choice([f"&copy; {word()}.example.com &middot; {prose(3)}", f"<p>&copy; 2024 {prose(r.randint(3, 15))}</p>", f"<ul>{links(4)}</ul>"])
        return r.choice([f"<footer>{inner}</footer>", f"<div{attr('footer page-footer copyright legal site-footer colophon bottom imprint foot')}>{inner}</div>"])

    def header() -> str:
        inner = r.choice([f"<a href='/'>{word()}</a>", f"<h2>{word()} {word()}</h2><p>{prose(r.randint(2, 6))}</p>"])
        return r.choice([f"<header>{inner}</header>", f"<div{attr('header masthead top-header site-header head branding logo topbar')}>{inner}</div>"])

    if bare:
        lines = [prose(r.choice([3, 8, 20, 40, 80])) for _ in range(r.choice([1, 2, 3, 5, 8]))]
        shown = [r.choice(["{}", "<b>{}</b>", "<i>{}</i>", '<a href="/x">{}</a>', "<span>{}</span>"]).format(x.split(" ", 1)[0]) + x[len(x.split(" ", 1)[0]) :] if r.random() < 0.4 else x for x in lines]
        texts, body = [" ".join(lines)], r.choice(["<br>", "<br/><br/>\n", "\n", " "]).join(shown)
        for _ in range(r.choice([0, 0, 0, 1, 3])):
            texts.append(prose(r.choice([8, 20, 40])))
            body += f"<p>{texts[-1]}</p>"
        if r.random() < 0.5:
            around = [[x for f, p in ((header, 0.3), (nav, 0.5), (ad, 0.2), (footer, 0.5)) if r.random() < p for x in [f()]] for _ in range(2)]
            body = "".join(around[0]) + body + "".join(around[1])
        head = f"<head><title>{prose(4)}</title></head>"
        return r.choice(["{}", "<html>{}</html>", f"<!DOCTYPE html><html>{head}<body>{{}}</body></html>", "<body>{}</body>"]).format(body), "\n".join(texts)

    parts, texts = [], []

    def put(tag: str, text: str) -> None:
        texts.append(text)
        shown = entities.escape(text, quote=False)
        style = r.random()
        if tag == "p" and style < 0.15:
            parts.append(f"<p><b>{shown}<br>")
        elif tag == "p" and style < 0.25:
            parts.append(f"<p>{shown}")
        else:
            parts.append(f"<{tag}>{shown}</{tag}>")

    if r.random() < 0.9:
        put("h1", r.choice([prose(r.randint(2, 10)), " ".join(word() for _ in range(r.randint(1, 14)))[: r.randint(10, 70)].strip()]))
    for _ in range(r.choice([0, 1, 2, 3, 5, 8, 13, 21])):
        what = r.random()
        if what < 0.8:
            put("p", prose(r.choice([1, 3, 8, 20, 40, 80])) + r.choice(["", "", " a & b", "&&&"]))
        elif what < 0.87:
            put("h2", prose(3))
        elif what < 0.9:
            put("blockquote", prose(12))
        elif what < 0.93:
            for k in range(r.randint(2, 4)):
                parts.append("<ul>" * (k == 0))
                put("li", prose(r.randint(3, 12)))
            parts.append("</ul>")
        elif texts:
            parts.append(r.choice([ad, aside, notice, form])())
    inner = "".join(parts)
    plain = ("<div>", "</div>")
    wraps = [("<article>", "</article>")] * 5 + [("<main>", "</main>"), (f"<div{attr('content article post-body entry-content story-text main-content post entry story main blog-post page-content article-text body-copy')}>", "</div>"), (f"<section{attr('post article-body content story entry hentry main')}>", "</section>")]
    a, b = r.choice(wraps)
    if len("".join(texts)) > 500 and r.random() < 0.1:
        a, b = plain
    body = a + inner + b
    if r.random() < 0.25:
        body = f"<div{r.choice(['', attr('wrapper container page content-wrap')])}>{body}{r.choice(['', aside(), comments()])}</div>"
    before = [x for f, p in ((header, 0.4), (nav, 0.8), (notice, 0.3), (ad, 0.6), (form, 0.15), (aside, 0.2)) if r.random() < p for x in [f()]]
    after = [x for f, p in ((comments, 0.35), (aside, 0.3), (ad, 0.2), (form, 0.15), (footer, 0.9)) if r.random() < p for x in [f()]]
    if r.random() < 0.3:
        r.shuffle(before)
    head = f'<head><meta charset="utf-8"><title>{prose(4)}</title><style>p{{margin:0}}</style><script>var t="</p>";track({r.randint(0, 99)});</script></head>'
    page = f"<!DOCTYPE html><html>{head}<body>{''.join(before)}<!-- {word()} -->{body}{''.join(after)}</body></html>"
    return page, "\n".join(texts)


def labelled(page: str, text: str) -> tuple[list[Node], list[tuple[int, str]], np.ndarray]:
    """Labels of a made-up page's nodes: inside where all text below is of the article, and some is."""
    nodes, blocks = parse(page)
    wanted: dict[str, int] = {}
    for line in text.split("\n"):
        wanted[line] = wanted.get(line, 0) + 1
    yes, no = np.zeros(len(nodes)), np.zeros(len(nodes))
    for node, block in blocks:
        (yes if wanted.get(block, 0) else no)[node] += len(block)
    own = yes > 0
    for i in range(len(nodes) - 1, 0, -1):
        yes[nodes[i].parent] += yes[i]
        no[nodes[i].parent] += no[i]
    total = max(yes[0], 1)
    label = own.copy()
    # the smallest element that holds all of the article's text is its root
    root = max((i for i in range(len(nodes)) if yes[i] == total), default=0)
    chain = root
    while nodes[chain].tag in ("h1", "p") and nodes[chain].parent > 0:
        chain = nodes[chain].parent
    label[chain] = True
    for i in range(1, len(nodes)):
        if not label[i] and label[nodes[i].parent] and yes[i] > 0 and no[i] == 0:
            label[i] = True
    return nodes, blocks, label


def token_weights(pages: Iterable[tuple[str, str]]) -> dict[str, float]:
    """The log-odds of attribute tokens: how much more often elements with the token are in the article than without."""
    inside, outside, total = Counter(), Counter(), [1, 1]
    for page in pages:
        nodes, _, label = labelled(*page)
        for node, yes in zip(nodes, label.tolist()):
            total[yes] += 1
            (inside if yes else outside).update(node.tokens)
    prior = math.log(total[1] / total[0])
    return {t: math.log((inside[t] + 0.5) / (outside[t] + 0.5)) - prior for t in inside | outside if inside[t] + outside[t] >= RARE}


@cache
def model(pages: int = SAMPLE_PAGES, seed: int = 5, bare: int = BARE_PAGES) -> Model:
    r = random.Random(seed + 1)
    weights = token_weights(made_up_page(r) for _ in range(TOKEN_PAGES))
    r = random.Random(seed)
    xs, ys = [], []
    for n in range(pages + bare):
        nodes, blocks, label = labelled(*made_up_page(r, n >= pages))
        xs.append(node_features(nodes, blocks, weights))
        ys.append(label)
    return Model(weights, boosting.fit(np.concatenate(xs), np.concatenate(ys), trees=40, depth=4))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each page."""
    held = pages.sparkSession.sparkContext.broadcast(model())  # of a fixed number of trees

    def run(batch: pa.RecordBatch):
        for a in range(0, batch.num_rows, 50):
            texts = extract(batch.column(2)[a : a + 50].to_pylist(), held.value)
            yield pa.RecordBatch.from_arrays([batch.column(0)[a : a + 50], batch.column(1)[a : a + 50], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return map_arrow(rows, run, "page_id long, url string, text string, n_chars long")


def op9_main_text(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
