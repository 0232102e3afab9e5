"""Main text of web pages by a tree-structured graphical model over the DOM.

Each element is content or not. A log-linear node potential reads its tag, class, id and role words, link share, text
length and punctuation; a pairwise potential ties it to its parent. Sum-product messages go up and then down the tree
and give each node's content marginal; text of nodes above one half is kept. Potentials are trained on labelled pages:
generated ones (labelled_pages), whose every element carries its label, in many layouts; other labelled pages, marked
with the attribute LABEL, may be given instead.

Defined results: a null or empty page has the empty text; an unclosed tag is text, an unclosed comment, script or style
runs to the page's end, and a tag with an unclosed quote ends at the next ">"; a page is read in one pass; repeated rows give repeated results; very long pages are read whole; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import math
import random
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentlake.llm._util import fresh, tidied

#: Attribute with a training page's label of an element and what is below it: 1 content, 0 not.
LABEL = "data-label"
#: Pages that are generated for training, and its passes.
TRAIN_PAGES, PASSES = 400, 300

#: A whole tag, with quoted values; no part of it is tried twice.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[a-z]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose body is no text of the page: up to their end tag. Without one, the first three run to the page's end
#: and the others are as if they weren't there.
_RAW = frozenset("script style title textarea select template iframe svg head".split())
_TO_END = frozenset("script style title".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html "
    "legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())
#: Which open elements a start tag ends, and at which ancestors the search for them stops.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_STOPS = frozenset({"table", "td", "th", "button", "html"})


class Page:
    """A parsed page: parent, tag, words and label of each element in document order; runs of text with their element."""

    __slots__ = ("attrs", "last_gt", "parent", "runs", "source", "tags", "unclosed")

    def __init__(self, source: str):
        self.parent, self.tags, self.attrs = [-1], ["html"], [""]
        self.runs: list[tuple[int, str, bool]] = []  # element, text, in a link; element -1: a block ends
        self.source, self.last_gt, self.unclosed = source, source.rfind(">"), set()
        stack, links, at, lt = [0], 0, 0, 0
        parent, tags, attrs, runs = self.parent, self.tags, self.attrs, self.runs
        open_at: dict[str, list[int]] = {}  # places in the stack of the open elements of each tag

        def cut(k: int) -> bool:
            """End the elements from place k of the stack on; whether one of them was a block."""
            nonlocal links
            block = False
            for x in stack[k:]:
                open_at[tags[x]].pop()
                links -= tags[x] == "a"
                block = block or tags[x] in _BLOCK
            del stack[k:]
            return block

        last = lambda names: max((open_at[t][-1] for t in names if open_at.get(t)), default=0)
        while True:
            lt = source.find("<", lt)
            found = self._markup(lt) if lt >= 0 else (len(source), None, "", "")
            if found is None:  # a mere character
                lt += 1
                continue
            end, tag, close, own = found
            if text := source[at : lt if lt >= 0 else len(source)]:
                runs.append((stack[-1], text, links > 0))
            if lt < 0:
                break
            at = lt = end
            if tag is None:
                continue
            if close:
                block = tag in _BLOCK
                if open_at.get(tag):
                    block = cut(open_at[tag][-1]) or block
                if block:
                    runs.append((-1, "", False))
                continue
            if tag == "br":
                runs.append((stack[-1], " ", links > 0))
                continue
            if tag in _VOID:
                if tag == "hr":
                    runs.append((-1, "", False))
                continue
            if tag in _RAW:
                if not own.endswith("/"):
                    at = lt = self._behind(tag, at)
                continue
            if tag == "html":
                attrs[0] = own
                continue
            if tag in _BLOCK:
                runs.append((-1, "", False))
                what, stop = _ENDS.get(tag, ({"p"}, _STOPS))
                if (k := last(what)) > last(stop):
                    cut(k)
            links += tag == "a"
            parent.append(stack[-1])
            tags.append(tag)
            attrs.append(own)
            open_at.setdefault(tag, []).append(len(stack))
            stack.append(len(tags) - 1)

    def _markup(self, lt: int) -> tuple[int, str | None, str, str] | None:
        """(end, tag or None for a comment, "/" of an end tag, attributes) of what begins at a "<"; None if it is text.
        A tag with a quote that never ends, ends at the next ">"."""
        source = self.source
        if source.startswith("<!--", lt):
            end = source.find("-->", lt + 4)
            return (len(source) if end < 0 else end + 3), None, "", ""
        if lt > self.last_gt:
            return None
        if m := _TAG.match(source, lt):
            return m.end(), m[2].lower(), m[1], m[3]
        mark = source[lt + 1 : lt + 2]
        name = None if mark in ("!", "?") else _NAME.match(source, lt)
        if name is None and mark not in ("!", "?"):
            return None
        gt = source.find(">", lt)
        return (gt + 1, None, "", "") if name is None else (gt + 1, name[2].lower(), name[1], source[name.end() : gt])

    def _behind(self, tag: str, at: int) -> int:
        """The place behind the body of an element that is no text."""
        source = self.source
        if tag == "head":
            close = None if tag in self.unclosed else re.compile(r"</head\s*>|<body\b", re.I).search(source, at)
            if close is not None:
                return close.start() if close[0][1] != "/" else close.end()
        else:
            close = None if tag in self.unclosed else re.compile(rf"</{tag}\s*>", re.I).search(source, at)
            if close is not None:
                return close.end()
        self.unclosed.add(tag)
        return len(source) if tag in _TO_END else at

    def features(self) -> list[list[str]]:
        """Of each element, the names of what its node potential reads."""
        n = len(self.tags)
        size, linked, marks, own = [0] * n, [0] * n, [0] * n, [0] * n
        for e, text, link in self.runs:
            if e >= 0:
                k = len(text) - text.count(" ")
                size[e] += k
                own[e] += k
                linked[e] += k * link
                marks[e] += text.count(",") + text.count(".")
        for e in range(n - 1, 0, -1):
            p = self.parent[e]
            size[p] += size[e]
            linked[p] += linked[e]
            marks[p] += marks[e]
        out = []
        for e in range(n):
            tag = self.tags[e]
            f = [f"t={tag}", f"n={min(12, size[e].bit_length())}", f"o={min(12, own[e].bit_length())}", f"l={4 * linked[e] // size[e] if size[e] else -1}", f"m={min(6, marks[e].bit_length())}"]
            if e and self.attrs[e]:
                words = set()
                for name, a, b, c in _ATTR.findall(self.attrs[e]):
                    name = name.lower()
                    if name in ("class", "id", "role", "itemprop"):
                        words.update(_WORD.findall(re.sub("([a-z])([A-Z])", r"\1 \2", a or b or c).lower()))
                    elif name in ("hidden", "aria-hidden") or name == "style" and "display:none" in (a or b or c).replace(" ", ""):
                        words.add("hidden")
                f += [f"w={w}" for w in words]
            out.append(f)
        return out

    def text(self, content: list[bool]) -> str:
        """The kept text: blocks parted by two line ends, white space inside a block one space."""
        done, now = [], []
        for e, text, _ in self.runs:
            if e < 0:
                if now:
                    done.append(now)
                    now = []
            elif content[e]:
                now.append(text)
        done.append(now)
        blocks = (" ".join(html.unescape("".join(b)).split()) for b in done)
        return "\n\n".join(b for b in blocks if b)

    def top(self) -> list[bool]:
        """Which elements are the page itself or its body."""
        return [t in ("html", "body") for t in self.tags]

    def labels(self) -> list[int]:
        """Labels of a training page: an element's own mark, or its parent's."""
        out = [1]
        for e in range(1, len(self.tags)):
            m = re.search(rf'{LABEL}="([01])"', self.attrs[e])
            out.append(int(m[1]) if m else out[self.parent[e]])
        return out


@dataclass(frozen=True)
class Model:
    """Weights of node features (log odds of content beside the prior), and pairwise potentials: by whether the parent is
    the page itself or its body, [parent][child]."""

    weights: dict[str, float]
    bias: float
    pair: tuple[tuple, tuple]
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


def marginals(parent: list[int], unary: list[float], pair: tuple, top: list[bool]) -> list[float]:
    """Content marginal of each node of a tree (parents first), by sum-product messages up and then down."""
    n = len(parent)
    ties = [pair[t] for t in top]
    up0, up1, to0, to1 = [1.0] * n, [math.exp(max(-30.0, min(30.0, u))) for u in unary], [1.0] * n, [1.0] * n
    for e in range(n - 1, 0, -1):
        a, b = up0[e], up1[e]
        s = a + b
        a, b = a / s, b / s
        up0[e], up1[e] = a, b
        p = parent[e]
        (p00, p01), (p10, p11) = ties[p]
        m0, m1 = p00 * a + p01 * b, p10 * a + p11 * b
        s = m0 + m1
        to0[e], to1[e] = m0, m1 = m0 / s, m1 / s
        x, y = up0[p] * m0, up1[p] * m1
        s = x + y
        up0[p], up1[p] = x / s, y / s
    s = up0[0] + up1[0]
    b0, b1 = [up0[0] / s] * n, [up1[0] / s] * n
    for e in range(1, n):
        p = parent[e]
        (p00, p01), (p10, p11) = ties[p]
        x, y = b0[p] / max(to0[e], 1e-300), b1[p] / max(to1[e], 1e-300)
        a, b = up0[e] * (x * p00 + y * p10), up1[e] * (x * p01 + y * p11)
        s = a + b
        b0[e], b1[e] = a / s, b / s
    return b1


def train(pages: Iterable[str] | None = None) -> Model:
    """Fit the potentials on labelled pages (generated ones if none are given) by logistic regression and pair counts."""
    feats, ys, pairs = [], [], Counter()
    for source in labelled_pages() if pages is None else pages:
        page = Page(source)
        y = page.labels()
        page.attrs = [re.sub(rf'\s*{LABEL}="[01]"', "", a) for a in page.attrs]
        feats += page.features()
        ys += y
        top = page.top()
        pairs.update((top[page.parent[e]], y[page.parent[e]], y[e]) for e in range(1, len(y)))
    seen = Counter(f for x in feats for f in x)
    names = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= 3))}
    rows = np.array([i for i, x in enumerate(feats) for f in x if f in names])
    cols = np.array([names[f] for x in feats for f in x if f in names])
    y, w, b = np.array(ys, float), np.zeros(len(names)), 0.0
    speed, square = np.bincount(cols, minlength=len(names)) + 5.0, len(ys)
    for _ in range(PASSES):
        z = np.bincount(rows, w[cols], len(y)) + b
        off = y - 1 / (1 + np.exp(-z))
        w += (np.bincount(cols, off[rows], len(w)) - 0.3 * w) / speed
        b += off.sum() / square
    prior = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    rate = lambda t, p, c: (pairs[t, p, c] + 1) / (pairs[t, p, 0] + pairs[t, p, 1] + 2)
    pair = tuple(tuple(tuple(rate(t, p, c) for c in (0, 1)) for p in (0, 1)) for t in (False, True))
    return Model({f: float(w[i]) for f, i in names.items()}, float(b) - prior, pair)


def main_text(source: str, model: Model) -> str:
    """The main text of one page."""
    page = Page(source)
    weights, bias = model.weights, model.bias
    unary = [bias + sum([weights.get(f, 0.0) for f in x]) for x in page.features()]
    return page.text([p > 0.5 for p in marginals(page.parent, unary, model.pair, page.top())])


def extract(pages: DataFrame, model: Model, html_col: str = "html") -> DataFrame:
    """pages with main_text, a column of that name being replaced."""
    base = pages.drop(*[c for c in pages.columns if c.lower() == "main_text"])
    (source,) = fresh(base, "source_html")
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            n = batch.num_columns - 1
            texts = [main_text(x, model) if x else "" for x in batch.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(texts, pa.string())], [*batch.schema.names[:n], "main_text"])

    schema = type(base.schema)([*base.schema.fields]).add("main_text", "string")
    return base.withColumn(source, F.col(html_col)).mapInArrow(tidied(read), schema)


def labelled_pages(n: int = TRAIN_PAGES, seed: int = 7) -> Iterator[str]:
    """Generated pages of many layouts; each element of a layout carries its label."""
    r = random.Random(seed)
    syllables = [a + b for a in "b d f g k l m n p r s t v".split() for b in "a e i o u ai en or".split()]
    word = lambda: "".join(r.choices(syllables, k=r.randint(1, 4)))
    some = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    mark = lambda y: f' {LABEL}="{y}"'

    def named(*words: str) -> str:
        w = r.choice(words)
        w = r.choice([w, w + "-" + r.choice(["box", "wrapper", "area", "block", "inner"]), r.choice(["site", "main", "page", "top"]) + "-" + w])
        return f' {r.choice(["class", "class", "id"])}="{w}"'

    def prose(a: int = 3, b: int = 60) -> str:
        out = []
        for _ in range(r.randint(1, 5)):
            s = some(a, b)
            s = s.replace(" ", ", ", r.randint(0, 2))
            if r.random() < 0.2:
                s += f" <a href='/{word()}'>{some(1, 3)}</a> {some(1, 5)}"
            if r.random() < 0.2:
                s = f"<{(t := r.choice(['b', 'em', 'i', 'strong', 'span', 'code']))}>{s}</{t}>"
            out.append(s.capitalize() + r.choice([".", ".", "!", "?"]))
        return " ".join(out)

    def links(k: int) -> str:
        return "<ul>" + "".join(f"<li><a href='/{word()}'>{some(1, 3)}</a>" + r.choice(["</li>", ""]) for _ in range(k)) + "</ul>" if r.random() < 0.7 else " | ".join(f"<a href='#'>{some(1, 2)}</a>" for _ in range(k))

    def article() -> str:
        parts = [f"<h1>{some(2, 12)}</h1>"] if r.random() < 0.8 else []
        if r.random() < 0.3:
            parts.append(f"<p><b>{prose()}<br>")
        for _ in range(r.choice([1, 2, 3, 5, 8, 12])):
            k = r.random()
            if k < 0.1:
                parts.append(f"<p>{some(1, 2).capitalize()}.</p>")
            elif k < 0.68:
                parts.append(f"<p>{prose(1, r.choice([4, 15, 60]))}" + r.choice(["</p>", "</p>", "</p>", ""]))
            elif k < 0.76:
                parts.append(f"<h{(h := r.randint(2, 4))}>{some(1, 8)}</h{h}>")
            elif k < 0.84:
                parts.append((t := r.choice(["ul", "ol"])) and f"<{t}>" + "".join(f"<li>{prose(2, 10)}</li>" for _ in range(r.randint(2, 6))) + f"</{t}>")
            elif k < 0.88:
                parts.append(f"<blockquote><p>{prose()}</p></blockquote>")
            elif k < 0.91:
                parts.append(f"<pre><code>{some(3, 30)}</code></pre>")
            elif k < 0.94:
                parts.append("<table>" + "".join(f"<tr><td>{some(1, 3)}</td><td>{some(1, 3)}</td></tr>" for _ in range(r.randint(2, 5))) + "</table>")
            elif k < 0.97:
                parts.append(f"<figure><img src='/{word()}.jpg'><figcaption>{some(3, 12)}</figcaption></figure>")
            else:
                parts.append(f"<div>{prose()}</div>")
        if r.random() < 0.25:
            parts.insert(r.randint(0, len(parts)), junk())
        body = "".join(parts)
        k = r.random()
        if k < 0.45:
            return f"<article{mark(1)}>{body}</article>"
        if k < 0.55:
            return f"<main{mark(1)}>{body}</main>"
        if k < 0.65:
            return f"<main{mark(1)}><article>{body}</article></main>"
        if k < 0.95:
            return f"<{(t := r.choice(['div', 'div', 'section']))}{named('content', 'article', 'post', 'entry', 'story', 'text', 'body')}{mark(1)}>{body}</{t}>"
        return f"<div{mark(1)}>{body}</div>"

    def junk() -> str:
        k, y = r.choice("nav header footer aside ad ad notice form comments share related crumbs".split()), mark(0)
        if k == "nav":
            return r.choice([f"<nav{y}>{links(r.randint(3, 9))}</nav>", f"<div{named('nav', 'menu', 'navbar', 'navigation')}{y}>{links(r.randint(3, 9))}</div>"])
        if k == "header":
            return f"<header{y}><a href='/'>{some(1, 3)}</a><p>{some(2, 9)}</p></header>" if r.random() < 0.6 else f"<div{named('header', 'masthead', 'banner')}{y}>{some(1, 9)}</div>"
        if k == "footer":
            text = r.choice([f"&copy; {word()}.example.org &middot; {prose(2, 20)}", f"{some(1, 4)} {links(3)}", f"&copy; 2020 {some(2, 8)}", f"<p>{prose(2, 30)}</p>"])
            return f"<footer{y}>{text}</footer>" if r.random() < 0.7 else f"<div{named('footer', 'bottom', 'copyright')}{y}>{text}</div>"
        if k == "aside":
            inner = r.choice([f"<h3>{some(1, 4)}</h3>{links(4)}", f"<p>{prose(3, 30)}</p>", prose(2, 20)])
            return f"<aside{y}>{inner}</aside>" if r.random() < 0.6 else f"<div{named('sidebar', 'widget', 'rail')}{y}>{inner}</div>"
        if k == "ad":
            return f"<{(t := r.choice(['div', 'div', 'section', 'p', 'span']))}{named('ad', 'ad', 'ads', 'advert', 'advertisement', 'sponsored', 'sponsor', 'promo', 'promotion', 'banner')}{y}>{r.choice([some(2, 20), prose(3, 25), links(1)])}</{t}>"
        if k == "notice":
            return f"<div{named('cookie', 'cookies', 'consent', 'notice', 'gdpr', 'alert', 'popup', 'modal', 'newsletter', 'paywall', 'subscribe')}{y}><p>{prose(3, 20)}</p><button>{word()}</button></div>"
        if k == "form":
            return f"<form action='/{word()}'{y}><label>{some(1, 3)}</label><input name='{word()}'><p>{some(2, 12)}</p><button>{word()}</button></form>"
        if k == "comments":
            each = "".join(f"<{(t := r.choice(['div', 'li', 'article']))} class='comment'><b>{word()}</b><p>{prose(2, 30)}</p></{t}>" for _ in range(r.randint(1, 5)))
            return f"<{(t := r.choice(['section', 'div', 'div']))}{named('comments', 'comment', 'discussion', 'responses', 'disqus', 'replies')}{y}><h3>{some(1, 2)}</h3>{each}</{t}>"
        if k == "share":
            return f"<div{named('share', 'social', 'sharing', 'tags', 'meta', 'byline', 'author')}{y}>{links(r.randint(2, 4))}</div>"
        if k == "related":
            return f"<{(t := r.choice(['section', 'div']))}{named('related', 'recommended', 'more', 'trending', 'popular')}{y}><h3>{some(1, 3)}</h3>{links(5)}</{t}>"
        return f"<div{named('breadcrumb', 'breadcrumbs', 'pagination', 'pager', 'skip')}{y}>{links(3)}</div>"

    for _ in range(n):
        parts = [junk() for _ in range(r.randint(1, 4))] + [article()] + [junk() for _ in range(r.randint(1, 4))]
        body = "".join(parts)
        if r.random() < 0.3:
            body = f"<{(t := r.choice(['div', 'div', 'section', 'form']))}{r.choice(['', named('wrapper', 'container', 'page', 'layout', 'root')])}{mark(1)}>{body}</{t}>"
        yield f"<html><head><title>{some(1, 8)}</title><style>p{{}}</style></head><body{mark(1)}><!-- {word()} --><script>x='</p>'</script>{body}</body></html>"
