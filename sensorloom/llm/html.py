"""Main text of web pages by a tree-structured graphical model.

Every element and every text of a page is a node that is content or not. A node's
own evidence (tag, words in class, id and role, length and link share of its text)
and the potentials between parents and children make up the model; both are
counted on labelled pages. Sum-product messages pass from the leaves up and from
the root down, so each node's marginal depends on the whole page. Texts with a
marginal above one half are the main text.

Parsing follows what browsers do with sloppy pages as far as text is concerned:
unknown and unclosed tags, paragraphs that end where the next block begins, raw
text in scripts and styles, comments, character references. All loops are flat,
so deep nesting is no problem, and linear in the page.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.base import query, table

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style iframe noembed noframes xmp title textarea".split())
#: Not shown if they end; one without an end is an ordinary element.
HIDDEN = frozenset("template noscript".split())
#: Within these "/>" ends an element. Texts of drawings are no text of a page; a block or a picture ends an open one.
FOREIGN = frozenset("svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body caption dd dt head html legend li option optgroup tbody td tfoot th thead tr".split())
#: Elements that divide a page; other blocks belong to what they stand in.
REGION = frozenset("article aside body dialog div footer form header html main menu nav section table tbody td tr".split())
#: An open element of the first kind ends where one of the others begins, unless an element of the last kind is between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "tfoot": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
}
SCOPE = frozenset("table td th caption button object html body".split())

# Parts of class, id and role names.
CONTENT_WORDS = frozenset("article articlebody content main post entry story text body page blog news prose".split())
OTHER_WORDS = frozenset(
    "ad ads advert advertisement banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs header masthead footer copyright "
    "sidebar side aside widget related recommended cookie cookies consent notice alert popup modal overlay comment comments reply replies disqus "
    "share sharing social subscribe newsletter signup login search form toolbar pager pagination tags meta byline skip legal disclaimer".split()
)

_OPEN = re.compile(r"""<(?:!--(?:.*?--!?>|.*\Z)|[!?][^>]*+>?|/([a-zA-Z][^\s/>]*+)[^>]*+>?|([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|([a-zA-Z][^\s/>]*+)([^>]*+)>?)""", re.S)
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[a-z]+")


#: Weight of the features of a node, which repeat one another in part.
EVIDENCE = 0.4


@dataclass
class Page:
    """Nodes in document order; ``tag`` is '#text' for texts. ``flow``: node numbers of texts, -1 where a block begins or ends. ``marks``: labels."""

    tag: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    flow: list[int] = field(default_factory=list)
    marks: dict[int, int] = field(default_factory=dict)


def parse(html: str) -> Page:
    page, stack, at, n = Page(), [0], 0, len(html)
    drawing = foreign = 0  # places on the stack of an open svg, and of an open svg or math
    no_end: set[str] = set()
    page.tag.append("#root")
    page.names.append("")
    page.parent.append(-1)
    page.text.append("")

    def node(tag: str, names: str, text: str) -> int:
        page.tag.append(tag)
        page.names.append(names)
        page.parent.append(stack[-1])
        page.text.append(text)
        return len(page.tag) - 1

    def words(text: str) -> None:
        if text and not drawing:
            page.flow.append(node("#text", "", unescape(text)))

    def cut(k: int) -> None:
        nonlocal drawing, foreign
        del stack[k:]
        drawing, foreign = drawing if drawing < k else 0, foreign if foreign < k else 0

    def close(names, stop) -> None:
        for k in range(len(stack) - 1, 0, -1):
            tag = page.tag[stack[k]]
            if tag in names:
                cut(k)
                return
            if tag in stop:
                return

    while at < n:
        low = html.find("<", at)
        if low < 0:
            words(html[at:])
            break
        found = _OPEN.match(html, low)
        if not found:
            words(html[at : low + 1])
            at = low + 1
            continue
        words(html[at:low])
        at = found.end()
        if found[1]:
            tag = found[1].lower()
            if drawing and tag in BLOCK:
                cut(drawing)
            if tag in BLOCK:
                page.flow.append(-1)
            if tag == "p" or tag not in BLOCK:
                close({tag}, SCOPE if tag == "p" else BLOCK)
            elif tag not in ("html", "body"):
                close({tag}, ())
            continue
        tag = (found[2] or found[4] or "").lower()
        if not tag:
            continue
        raw = found[3] or found[5] or ""
        if foreign and raw.endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW or (tag in HIDDEN and tag not in no_end):
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(html, at)
            if end or tag in RAW:
                at = n if end is None else (html.find(">", end.end()) + 1 or n)
                continue
            no_end.add(tag)  # none from here on either
        if drawing and (tag in BLOCK or tag in ("img", "br")):
            cut(drawing)
        if tag in CLOSES_P:
            close({"p"}, SCOPE)
        if tag in ENDS:
            close(*ENDS[tag])
        if tag in BLOCK or tag == "br":
            page.flow.append(-1)
        if tag in VOID or (tag in FOREIGN and raw.endswith("/")):
            continue
        stack.append(node(tag, " ".join(a or b or c for a, b, c in _NAMES.findall(raw)).lower(), ""))
        if tag in FOREIGN:
            foreign = foreign or len(stack) - 1
            drawing = drawing or (len(stack) - 1 if tag == "svg" else 0)
        if "data-main" in raw or "data-skip" in raw:
            page.marks[stack[-1]] = int("data-main" in raw)
    return page


def _kind(tag: str) -> str:
    """How a child hangs on its parent."""
    return "text" if tag == "#text" else "region" if tag in REGION else "block" if tag in BLOCK else "inline"


def _level(x: float, steps: tuple) -> int:
    return sum(x >= s for s in steps)


def evidence(page: Page) -> list[list[tuple]]:
    """What is seen at each node, one value for each feature."""
    n = len(page.tag)
    chars, linked = [len(t.strip()) for t in page.text], [0] * n
    in_link = [False] * n
    for v in range(1, n):
        in_link[v] = page.tag[v] == "a" or in_link[page.parent[v]]
        linked[v] = chars[v] if in_link[v] else 0
    for v in range(n - 1, 0, -1):
        chars[page.parent[v]] += chars[v]
        linked[page.parent[v]] += linked[v]
    out = []
    for v in range(n):
        found = set(_WORDS.findall(page.names[v]))
        hint = ("other" if found & OTHER_WORDS else "content" if found & CONTENT_WORDS else "none") if page.tag[v] != "#text" else "text"
        share = linked[v] / chars[v] if chars[v] else 0
        out.append([("tag", page.tag[v]), ("hint", hint), ("links", page.tag[v] == "#text", _level(share, (0.05, 0.3, 0.7))), ("chars", _kind(page.tag[v]), _level(chars[v], (1, 20, 80, 300)))])
    return out


@dataclass(frozen=True)
class Model:
    """Log potentials: of a value seen at a node, and of (parent, child) labels by the child's kind."""

    seen: dict
    unseen: dict
    pair: dict


def labels(page: Page) -> list[int]:
    """1 within an element marked as content, 0 elsewhere and within one marked as none."""
    out = [0] * len(page.tag)
    for v in range(1, len(page.tag)):
        out[v] = page.marks.get(v, out[page.parent[v]])
    return out


def train(pages: list[str], smooth: float = 0.5) -> Model:
    """Counts over labelled pages: ``data-main`` marks an element whose texts are content, ``data-skip`` one within it whose texts are not."""
    seen: Counter = Counter()
    total: Counter = Counter()
    pair: Counter = Counter()
    values: dict[str, set] = {}
    for html in pages:
        page = parse(html)
        label = labels(page)
        for v in range(1, len(page.tag)):
            pair[_kind(page.tag[v]), label[page.parent[v]], label[v]] += 1
        for v, features in enumerate(evidence(page)):
            for f in features:
                seen[f, label[v]] += 1
                total[f[0], label[v]] += 1
                values.setdefault(f[0], set()).add(f)
    score = {f: np.log([(seen[f, x] + smooth) / (total[f[0], x] + smooth * (len(values[f[0]]) + 1)) for x in (0, 1)]) for f in {f for f, _ in seen}}
    unseen = {name: np.log([smooth / (total[name, x] + smooth * (len(values[name]) + 1)) for x in (0, 1)]) for name in values}
    edges = {}
    for kind in ("text", "inline", "block", "region"):
        counts = np.array([[pair[kind, x, y] + smooth for y in (0, 1)] for x in (0, 1)])
        edges[kind] = counts / counts.sum(axis=1, keepdims=True)
    return Model({f: tuple(x.tolist()) for f, x in score.items()}, {k: tuple(x.tolist()) for k, x in unseen.items()}, {k: x.tolist() for k, x in edges.items()})


def marginals(page: Page, model: Model) -> list[float]:
    """Probability of content at each node, by messages up and down the tree."""
    from math import exp

    n = len(page.tag)
    own = []
    for features in evidence(page):
        d = 0.0
        for f in features:
            a, b = model.seen.get(f) or model.unseen[f[0]]
            d += b - a
        d = max(-30.0, min(30.0, EVIDENCE * d))
        own.append((1.0, exp(d)) if d < 0 else (exp(-d), 1.0))
    pairs = [model.pair[_kind(t)] for t in page.tag]
    # up[v]: message of v to its parent; below[v]: evidence at v with all messages from its children.
    below0, below1 = [a for a, _ in own], [b for _, b in own]
    up = [(1.0, 1.0)] * n
    for v in range(n - 1, 0, -1):
        e, a, b = pairs[v], below0[v], below1[v]
        m0, m1 = e[0][0] * a + e[0][1] * b, e[1][0] * a + e[1][1] * b
        s = m0 + m1
        up[v] = (m0 / s, m1 / s)
        p = page.parent[v]
        x, y = below0[p] * m0 / s, below1[p] * m1 / s
        below0[p], below1[p] = x / (x + y), y / (x + y)
    out = [0.0] * n
    full0, full1 = below0[:], below1[:]
    for v in range(1, n):
        p, e = page.parent[v], pairs[v]
        # What the parent knows without this child.
        a, b = full0[p] / up[v][0], full1[p] / up[v][1]
        d0, d1 = a * e[0][0] + b * e[1][0], a * e[0][1] + b * e[1][1]
        x, y = below0[v] * d0, below1[v] * d1
        s = x + y
        full0[v], full1[v] = max(x / s, 1e-300), max(y / s, 1e-300)
        out[v] = y / s
    return out


def blocks(page: Page, content: list[bool]) -> list[str]:
    """Content texts by block, white space as single blanks."""
    out, held = [], []
    for v in [*page.flow, -1]:
        if v >= 0:
            if content[v]:
                held.append(page.text[v])
        elif held:
            text = " ".join("".join(held).split())
            held = []
            if text:
                out.append(text)
    return out


def _words(k: int, n: int) -> str:
    """``n`` made-up words, different for each ``k``."""
    return " ".join(("lorem", "dolor", "sit", "tempor", "magna", "quis", "nulla", "culpa", "est", "labore")[(k * 7 + i * (k % 9 + 1)) % 10] for i in range(n))


def labelled_pages() -> list[str]:
    """Pages with marked content: an article among menus, adverts and the rest, in several layouts and lengths."""
    out = []
    link = lambda k, n: "".join(f'<li><a href="/{i}">{_words(k + i, 1 + i % 2)}</a></li>' for i in range(n))
    for k in range(84):
        paragraphs = "".join(f"<p>{'<b>' if i % 5 == 4 else ''}{_words(k + i, (3, 18, 60, 9, 34)[(k + i) % 5])}{'</b>' if i % 10 == 4 else ''}{'<br>' if i % 5 == 4 else '</p>'}" for i in range(1 + k % 7))
        paragraphs += "".join(f'<p>{_words(k + i, 12)} <a href="/x{i}">{_words(k + i, 2 + i)}</a> {_words(k + 2, 9)} <a href="/y">{_words(i, 1)}</a></p>' for i in range(1 + k % 3))
        if k % 4 == 1:
            paragraphs += f'<p><a href="/w">{_words(k, 5)}</a></p><ul><li>{_words(k, 8)}</li><li>{_words(k + 1, 11)}</li></ul>'
        if k % 4 == 2:
            paragraphs += f"<h2>{_words(k, 3)}</h2><blockquote>{_words(k, 20)}</blockquote><pre>{_words(k, 10)}</pre><table><tr><td>{_words(k, 2)}</td><td>{_words(k, 4)}</td></tr></table>"
        title = f"<h1>{_words(k, 5)}</h1>"
        inner = ("", f'<div class="ad" data-skip>{_words(k, 6)}</div>', f'<aside class="related" data-skip><ul>{link(k, 4)}</ul></aside>', f'<form data-skip><label>{_words(k, 2)}</label><button>{_words(k, 1)}</button></form>')[k % 4]
        comments = f'<section class="comments" id="comments" data-skip><h3>{_words(k, 1)}</h3><div class="comment"><p>{_words(k, 14)}</p></div><article class="comment"><p>{_words(k + 3, 25)}</p></article></section>' if k % 3 == 0 else ""
        body = paragraphs + inner + (comments if k % 2 else "")
        main = (
            f"<article data-main>{title}{body}</article>", f"<main data-main>{title}{body}</main>", f'<div class="post content" data-main>{title}{body}</div>',
            f'<main><article class="entry" data-main>{title}<div class="entry-content">{body}</div></article></main>', f'<section><article data-main>{title}{body}</article></section>', f'<div id="main"><div class="article-body" data-main>{body}</div></div>',
            f'<div class="wrapper"><div class="post" data-main>{title}<div class="byline meta" data-skip>{_words(k, 2)}</div><p>{_words(k, 14)}</p><p>{_words(k, 2)}</p><ul><li>{_words(k, 3)}</li><li>{_words(k, 2)}</li></ul>{inner}</div><div class="sidebar"><h4>{_words(k, 1)}</h4><ul>{link(k, 3)}</ul></div></div>',
        )[k % 7]
        head = f"<html><head><title>{_words(k, 4)}</title></head><body>"
        top = (f"<nav><ul>{link(k, 6)}</ul></nav>", f'<header><a href="/">{_words(k, 2)}</a><nav>{link(k, 4)}</nav></header>', f'<div class="menu navbar"><ul>{link(k, 8)}</ul></div>', f'<header class="masthead"><h2>{_words(k, 3)}</h2><p>{_words(k, 6)}</p></header><nav>{link(k, 3)}</nav>')[k % 4]
        advert = ("", f'<div class="ad">{_words(k, 12)}.</div>', f'<div class="banner cookie notice"><p>{_words(k, 22)}</p><button>{_words(k, 1)}</button></div>', f'<div class="ads sponsored"><a href="/z">{_words(k, 7)}</a></div>')[(k // 2) % 4]
        side = ("", f'<aside class="sidebar"><h3>{_words(k, 2)}</h3><ul>{link(k, 5)}</ul></aside>', f'<div class="sidebar widget"><p>{_words(k, 15)}</p></div>', f'<form class="newsletter"><p>{_words(k, 9)}</p><input name="q"><button>{_words(k, 1)}</button></form>')[(k // 3) % 4]
        foot = (f"<footer>&copy; {_words(k, 3)} &middot; {_words(k, 9)}</footer>", f'<div class="footer legal"><p>{_words(k, 16)}</p></div>', f"<footer><ul>{link(k, 4)}</ul><p>{_words(k, 8)}</p></footer>")[k % 3]
        out.append(head + top + advert + main + side + ("" if k % 2 else comments.replace(" data-skip", "")) + foot + "</body></html>")
    return out


@lru_cache(1)
def default_model() -> Model:
    return train(labelled_pages())


def main_text(html: str | None, model: Model) -> list[str]:
    page = parse(html or "")
    return blocks(page, [m > 0.5 for m in marginals(page, model)])


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text (empty if none), n_chars, blocks (array). Null html gives an empty text; other columns are ignored, rows that repeat stay."""
    held = model or default_model()

    def texts(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                found = [main_text(h.as_py(), held) for h in part.column("html")]
                joined = [" ".join(x) for x in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id").cast(pa.int64()), part.column("url"), pa.array(joined, pa.string()), pa.array([len(x) for x in joined], pa.int64()), pa.array(found, pa.list_(pa.string()))],
                    names=["page_id", "url", "text", "n_chars", "blocks"],
                )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(texts, "page_id long, url string, text string, n_chars long, blocks array<string>")


@query("op7_tree_model_text")
def op7(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
