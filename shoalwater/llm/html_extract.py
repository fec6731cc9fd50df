"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page is parsed to its block elements. Trees score each by its tag, attribute tokens, depth,
subtree density, links and siblings. Decoding then keeps or drops whole subtrees so that the
decisions fit together: below a dropped node nothing is kept.

The trees are trained here, on a bounded sample of pages that mark their article by tag, on the
same pages with the article cut short, and on variants of them: the same blocks laid out anew
with other containers and with menus, sidebars, notices, adverts, forms and comments around and
inside the article.
"""

from __future__ import annotations

import html as html_
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import blocks_of, table

#: Bound of the sample: pages, and characters of a page, that train the trees.
SAMPLE, SAMPLE_CHARS = 300, 60_000
VARIANTS = 5
TREES, LEVELS, RATE, BINS = 80, 5, 0.3, 24
#: Added to a leaf's second derivatives: a handful of training nodes moves a score little.
CALM = 2.0

# HTML's elements by role, and words that sites use in class, id and role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg annotation".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var object math mrow mi mo mn ms mtext mspace mstyle msup msub msubsup mfrac msqrt mroot mover munder munderover semantics".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
TAGS = ("p", "h", "li", "div", "article", "main", "section", "nav", "header", "footer", "aside", "form", "table", "list", "quote", "control", "other")
TAG_GROUP = {"p": "p", **{f"h{i}": "h" for i in range(1, 7)}, "li": "li", "div": "div", "article": "article", "main": "main", "section": "section", "nav": "nav", "menu": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "table": "table", "tr": "table", "td": "table", "th": "table", "tbody": "table", "ul": "list", "ol": "list", "dl": "list", "blockquote": "quote", "pre": "quote", "figure": "quote", "button": "control", "select": "control", "option": "control", "fieldset": "control", "dialog": "control"}
#: Elements that hold a part of a page, as tag groups.
BOXES = frozenset(("article", "main", "div", "section", "nav", "header", "footer", "aside", "form"))
TOKENS = (
    ("menu", "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs toolbar skip"),
    ("head", "header masthead topbar logo brand hero"),
    ("foot", "footer foot copyright colophon legal bottom"),
    ("side", "sidebar side aside widget rail related recommended recommendations popular trending archive tags share social sharing author"),
    ("advert", "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner"),
    ("notice", "cookie cookies consent gdpr notice notification alert popup modal newsletter subscribe subscription paywall overlay disclaimer warning"),
    ("comment", "comment comments disqus reply replies respond discussion reactions feedback"),
    ("form", "form search login signup signin register contact"),
    ("content", "article content post entry story main body text blog prose page"),
)
GROUP_OF = {w: g for g, (_, words) in enumerate(TOKENS) for w in words.split()}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_QUOTE_OR_END = re.compile(r"""[>"']""")
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAMED = frozenset(("class", "id", "role", "aria-label"))
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
_STOPS = re.compile(r"[.,;:!?]")
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}


def markup(source: str) -> Iterator[tuple[str, str, str]]:
    """A page as ("", text, ""), ("<", tag, attributes) and ("/", tag, "") in order, in linear time.

    A tag ends at the first ``>`` outside its quoted values; a quote opens a value only after ``=``, and if it never
    closes, the first ``>`` ends the tag. A ``<`` that no letter, ``/``, ``!`` or ``?`` follows is text. Comments,
    declarations and a last tag that never ends are left out. Of the elements in ``RAW`` nothing comes but, if such an element
    is never closed and is no script or style, what follows its start.
    """
    at, n, gone = 0, len(source), set()

    def seek(what: str, start: int) -> int:
        """Where ``what`` comes next; what does not occur any more is not searched for again."""
        if what in gone:
            return -1
        i = source.find(what, start)
        if i < 0:
            gone.add(what)
        return i

    def tag_end(start: int) -> int:
        p = start
        while m := _QUOTE_OR_END.search(source, p):
            q = m.start()
            if m[0] == ">":
                return q
            p, j = q + 1, q - 1
            while j >= start and source[j].isspace():
                j -= 1
            if j >= start and source[j] == "=":
                close = seek(m[0], p)
                if close < 0:
                    return seek(">", start)
                p = close + 1
        return -1

    while at < n:
        lt = seek("<", at)
        if lt < 0:
            yield "", source[at:], ""
            return
        close = source[lt + 1 : lt + 2] == "/"
        name = _NAME.match(source, lt + 1 + close)
        if not (name or close or source[lt + 1 : lt + 2] in ("!", "?")):
            yield "", source[at : lt + 1], ""
            at = lt + 1
            continue
        if lt > at:
            yield "", source[at:lt], ""
        if source.startswith("<!--", lt):
            end = seek(">", lt) - 2 if source.startswith(("<!-->", "<!--->"), lt) else seek("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if not name:
            at = seek(">", lt) + 1 or n
            continue
        end = tag_end(name.end())
        if end < 0:
            return
        tag, at = name[0].lower(), end + 1
        if close:
            yield "/", tag, ""
        elif tag not in RAW:
            yield "<", tag, source[name.end() : end]
        elif source[end - 1] != "/":
            found = None if tag in gone else _END[tag].search(source, at)
            if found:
                at = found.end()
            elif tag in ("script", "style"):
                return
            else:
                gone.add(tag)


def attribute_groups(attributes: str) -> frozenset:
    """The groups of ``TOKENS`` that the words of class, id, role and aria-label belong to."""
    values = (a[2] or a[3] or a[4] for a in _ATTR.finditer(attributes) if a[1].lower() in _NAMED)
    words = (w.lower() for v in values if v for w in _PART.findall(v))
    return frozenset(GROUP_OF[w] for w in words if w in GROUP_OF)


class Page:
    """Block elements of a page in page order, with their runs of text."""

    def __init__(self, source: str):
        self.tag, self.parent, self.depth, self.groups = ["html"], [-1], [0], [frozenset()]
        self.runs: list[tuple[int, str, int]] = []  # node, text, characters inside links
        self._parse(source)

    def _parse(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("html", 0)]  # open elements; inline ones share their block's node
        blocks, opened = [0], {"html": [0]}  # places in the stack: of block elements, and of each tag
        buffer: list[str] = []
        linked, links = 0, 0

        def flush() -> None:
            nonlocal linked
            text = _SPACE.sub(" ", html_.unescape("".join(buffer))).strip() if buffer else ""
            if text:
                self.runs.append((stack[blocks[-1]][1], text, min(linked, len(text))))
            buffer.clear()
            linked = 0

        def push(tag: str, node: int) -> None:
            opened.setdefault(tag, []).append(len(stack))
            stack.append((tag, node))

        def pop_to(i: int) -> None:
            nonlocal links
            while len(stack) > i:
                tag = stack[-1][0]
                if tag and tag not in INLINE:
                    flush()
                    blocks.pop()
                if tag:
                    opened[tag].pop()
                    links -= tag == "a"
                stack.pop()

        for kind, tag, rest in markup(source):
            if not kind:
                buffer.append(tag)
                if links:
                    linked += len(tag)
            elif kind == "/":
                places = opened.get(tag)
                if not places or places[-1] == 0:
                    continue
                if tag in INLINE and places[-1] < blocks[-1]:  # it began outside of this block, which stays open
                    links -= tag == "a"
                    stack[places.pop()] = ("", 0)
                else:
                    pop_to(places[-1])
            elif tag in VOID:
                if tag in ("br", "hr"):
                    buffer.append(" ")
            elif tag in INLINE:
                push(tag, 0)
                links += tag == "a"
            else:
                shut = SAME.get(tag, ())
                if shut or tag in CLOSES_P:
                    for i in reversed(blocks):
                        open_ = stack[i][0]
                        if i and (open_ in shut or (open_ == "p" and tag in CLOSES_P)):
                            pop_to(i)
                            break
                        if open_ != "p" and not (shut and open_ in ("td", "th", "dd")):
                            break
                flush()
                up = stack[blocks[-1]][1]
                self.tag.append(tag)
                self.parent.append(up)
                self.depth.append(self.depth[up] + 1)
                self.groups.append(attribute_groups(rest) if rest else frozenset())
                blocks.append(len(stack))
                push(tag, len(self.tag) - 1)
        flush()
        pop_to(1)
        flush()

    def features(self) -> np.ndarray:
        n = len(self.tag)
        parent = self.parent
        own, link, stops, runs = (np.zeros(n) for _ in range(4))
        for node, text, linked in self.runs:
            own[node] += len(text)
            link[node] += linked
            stops[node] += len(_STOPS.findall(text))
            runs[node] += 1
        sub, sub_link, sub_stops, nodes, paragraphs = own.copy(), link.copy(), stops.copy(), np.ones(n), np.array([t == "p" for t in self.tag], float)
        children, index = np.zeros(n), np.zeros(n)
        flags = np.zeros((n, len(TOKENS)))
        for i, g in enumerate(self.groups):
            for k in g:
                flags[i, k] = 1
        kinds = [TAG_GROUP.get(t, "other") for t in self.tag]
        above = np.zeros((n, len(TOKENS) + 6))
        special = [k in kinds_ for kinds_ in (("nav",), ("header",), ("footer",), ("aside",), ("form", "control"), ("article", "main")) for k in kinds]
        here = np.concatenate((flags, np.array(special, float).reshape(6, n).T), axis=1)
        for i in range(1, n):
            p = parent[i]
            index[i] = children[p]
            children[p] += 1
            above[i] = np.maximum(above[p], here[p])
        for i in range(n - 1, 0, -1):
            p = parent[i]
            sub[p] += sub[i]
            sub_link[p] += sub_link[i]
            sub_stops[p] += sub_stops[i]
            nodes[p] += nodes[i]
            paragraphs[p] += paragraphs[i]
        up = np.maximum(np.array(parent), 0)
        box = [0] * n  # the nearest container above a node
        for i in range(1, n):
            box[i] = parent[i] if kinds[parent[i]] in BOXES else box[parent[i]]
        outer = np.array(box)[box]
        kin: dict[tuple, int] = {}  # siblings of one tag and the same attribute groups
        kind = np.array([kin.setdefault((parent[i], self.tag[i], self.groups[i]), len(kin)) for i in range(n)])
        alike = np.bincount(kind)
        mean, mean_link = np.bincount(kind, sub) / alike, np.bincount(kind, sub_link) / np.maximum(1, np.bincount(kind, sub))
        total = max(1.0, sub[0])
        start = np.arange(n) / n
        tags = np.zeros((n, len(TAGS)))
        tags[np.arange(n), [TAGS.index(k) for k in kinds]] = 1
        dense = np.stack([np.array(self.depth, float), np.log1p(own), np.log1p(sub), sub / total, sub[up] / total, sub_link / np.maximum(1, sub), sub_stops / np.maximum(1, sub), sub / nodes, np.log1p(nodes), np.log1p(paragraphs), paragraphs[up], index, children[up], (index + 1) / np.maximum(1, children[up]), start, sub / np.maximum(1, sub[up]), runs, sub_link[up] / np.maximum(1, sub[up]), *(f for b in (np.array(box), outer) for f in (np.log1p(sub[b]), sub[b] / total, sub_link[b] / np.maximum(1, sub[b]), sub_stops[b] / np.maximum(1, sub[b]), paragraphs[b], sub[b] / nodes[b])), own / np.maximum(1, sub[box]), np.log1p(alike[kind]), np.log1p(mean[kind]), mean_link[kind]], axis=1)
        return np.concatenate((dense, tags, flags, above), axis=1)

    def text(self, keep_logit: np.ndarray) -> str:
        """Blocks that the decoding keeps, joined by a space.

        A node is dropped with all below it or kept; of all such choices the likeliest is taken,
        nodes weighing with their own text.
        """
        n = len(self.tag)
        own = np.zeros(n)
        for node, text, _ in self.runs:
            own[node] += len(text)
        weight = 0.1 + np.log1p(own)
        yes, no = -np.logaddexp(0, -keep_logit) * weight, -np.logaddexp(0, keep_logit) * weight
        yes[own == 0] = 0.0  # an empty container is kept where something below it is worth it
        kept, dropped = yes.copy(), no.copy()
        for i in range(n - 1, 0, -1):
            kept[self.parent[i]] += max(kept[i], dropped[i])
            dropped[self.parent[i]] += dropped[i]
        live = np.zeros(n, bool)
        live[0] = True
        for i in range(1, n):
            live[i] = live[self.parent[i]] and kept[i] > dropped[i]
        return " ".join(text for node, text, _ in self.runs if live[node] and (node or keep_logit[0] > 0))


def marked_content(page: Page) -> np.ndarray | None:
    """1 for blocks of the page's article or main element, without what is marked as other; else None."""
    n, inside = len(page.tag), np.zeros(len(page.tag), bool)
    if not {"article", "main"} & set(page.tag):
        return None
    article = "article" if "article" in page.tag else "main"
    other = {"nav", "footer", "aside", "form", "button", "dialog", "header"}
    for i in range(1, n):
        p = page.parent[i]
        wrong = page.tag[i] in other or (page.groups[i] - {GROUP_OF["content"], GROUP_OF["header"]} and page.tag[i] != article)
        inside[i] = (inside[p] or page.tag[i] == article) and not wrong and (inside[p] or page.tag[i] == article)
    return inside


def variant(page: Page, content: np.ndarray, rng: np.random.Generator) -> tuple[str, list[str]]:
    """The page's blocks in another layout: html, and the texts of its content blocks."""
    esc = html_.escape
    blocks = [(page.tag[i], t) for i, t, _ in page.runs if content[i]]
    if rng.random() < 0.4:
        blocks = [(tag, t[: int(rng.integers(8, 120))].strip() or t) for tag, t in blocks[: int(rng.integers(1, 4))]]
    elif blocks and rng.random() < 0.06:  # a very long page: what a block's share of the page is tells little
        blocks = (blocks * 400)[: int(rng.integers(60, 400))]
    words = " ".join(t for _, t, _ in page.runs).split() or ["a"]

    def some(low: int, high: int) -> str:
        n = int(rng.integers(low, high))
        at = int(rng.integers(0, max(1, len(words) - n)))
        return esc(" ".join(words[at : at + n]))

    def pick(*options):
        return options[int(rng.integers(len(options)))]

    def wrap(opening: str, inner: str) -> str:
        return f"<{opening}>{inner}</{opening.split()[0]}>"

    def items() -> str:
        n = int(rng.integers(3, 10))
        shape = rng.random()
        if shape < 0.15:
            return "<table>" + "".join(f'<tr><td><a href="/{k}">{some(1, 5)}</a></td><td>{some(1, 3)}</td></tr>' for k in range(n)) + "</table>"
        if shape < 0.3:
            return "".join(f'<div><a href="/{k}">{some(1, 6)}</a></div>' for k in range(n))
        if shape < 0.4:
            return "<dl>" + "".join(f'<dt>{some(1, 3)}</dt><dd><a href="/{k}">{some(1, 5)}</a></dd>' for k in range(n)) + "</dl>"
        return "<ul>" + "".join(f'<li><a href="/{k}">{some(1, 5)}</a></li>' for k in range(int(rng.integers(3, 10)))) + "</ul>"

    def para(low: int, high: int, most: int) -> str:
        tag = pick("p", "p", "div", "li")
        return "".join(f"<{tag}>{some(low, high)}</{tag}>" for _ in range(int(rng.integers(1, most))))

    menu = lambda: wrap(pick("nav", 'div class="menu"', 'div id="navbar"', 'nav class="main-nav"', 'ul class="breadcrumbs"'), items())
    head = lambda: wrap(pick("header", 'div class="header"', 'div id="masthead"'), f"<h1>{some(1, 6)}</h1>" * int(rng.integers(0, 2)) + pick(menu(), f"<p>{some(2, 12)}</p>"))
    side = lambda: wrap(pick("aside", 'div class="sidebar"', 'div id="right-rail"', 'div class="related-posts"', 'section class="widget"'), f"<h3>{some(1, 4)}</h3>" + pick(items(), para(5, 40, 4)))
    advert = lambda: wrap(pick('div class="ad"', 'div class="ads-box"', 'div class="sponsored"', 'div id="promo-banner"', 'aside class="advertisement"'), pick(some(3, 40), para(3, 30, 3)))
    notice = lambda: wrap(pick('div class="cookie-notice"', 'div id="consent"', 'div class="newsletter"', 'div role="alert"', 'section class="popup"'), pick(some(8, 50), para(8, 40, 3)) + pick("", f"<button>{some(1, 3)}</button>"))
    form = lambda: f"<form action='/go'><label>{some(1, 4)}</label><input name=q>{pick('', '<p>' + some(3, 15) + '</p>')}<button>{some(1, 3)}</button></form>"
    comments = lambda: wrap(pick('section class="comments"', 'div id="comments"', 'div class="comment-list"', 'div id="disqus_thread"'), f"<h3>{some(1, 4)}</h3>" + "".join(wrap(pick('div class="comment"', 'article class="comment"', "li"), para(5, 60, 3)) for _ in range(int(rng.integers(1, 5)))))
    foot = lambda: wrap(pick("footer", 'div class="footer"', 'div id="colophon"'), pick(f"&copy; {some(3, 30)}", para(4, 30, 3), items()))

    texts: list[str] = []

    def say(t: str) -> str:
        texts.append(t)
        return esc(t)

    def short(t: str, least: int, most: int, times: int) -> list[str]:
        """Up to ``times`` fragments of a text, of so many words."""
        w, out = t.split(), []
        while w and len(out) < times:
            n = int(rng.integers(least, most))
            out.append(" ".join(w[:n]))
            w = w[n:]
        return out

    def blocks_of_text(group: list[tuple[str, str]], usual: str) -> str:
        return "".join(f"<{tag}>{say(t)}</{tag}>" for tag, t in ((tag if re.fullmatch(r"h[1-6]|blockquote|pre", tag) else usual, t) for tag, t in group))

    def laid(group: list[tuple[str, str]], usual: str) -> str:
        """Some neighbouring blocks of the article in one of the shapes that articles have, whole or in fragments."""
        t = [x for _, x in group]
        shape = int(rng.integers(9))
        if shape < 4 and rng.random() < 0.8:  # cells and items are mostly short
            t = [y for x in t for y in short(x, 1, int(rng.integers(4, 24)), int(rng.integers(2, 9)))]
        if shape == 0:
            return wrap(pick("ul", "ol"), "".join(f"<li>{say(x)}</li>" for x in t))
        if shape in (1, 2):
            row, cell = int(rng.integers(1, 4)), pick("td", "td", "th")
            rows_ = [t[i : i + row] for i in range(0, len(t), row)]
            inner_ = "".join("<tr>" + "".join(f"<{(c := 'th' if k == 0 and cell == 'th' else 'td')}>{say(x)}</{c}>" for k, x in enumerate(r)) + "</tr>" for r in rows_)
            return wrap("table", pick(inner_, wrap("tbody", inner_)))
        if shape == 3:
            return wrap("dl", "".join(f"<{('dt', 'dd')[i % 2]}>{say(x)}</{('dt', 'dd')[i % 2]}>" for i, x in enumerate(t)))
        head = short(t[0], 2, 9, 1) or [t[0]]
        if shape == 4:
            return blocks_of_text([(usual, x) for x in t[1:]], usual) + f"<figure><img src=x><figcaption>{say((short(t[0], 4, 22, 1) or head)[0])}</figcaption></figure>"
        if shape == 5:
            return f"<details><summary>{say(head[0])}</summary>{blocks_of_text([(usual, x) for x in t], usual)}</details>"
        if shape == 6:
            inner_ = f"<{(h := pick('h2', 'h3', 'h4'))}>{say(head[0])}</{h}>" + blocks_of_text([(usual, x) for x in t], usual)
            return pick(inner_, wrap(pick("section", "div"), inner_))
        if shape == 7:
            return "".join(pick(f"<blockquote>{(y := say(x))}</blockquote>", f"<blockquote><p>{y}</p></blockquote>", f"<pre><code>{y}</code></pre>") for x in t)
        return blocks_of_text([("div", x) for x in t], "div")

    inner: list[str] = []
    usual, mixed, i = pick("p", "p", "div"), rng.random() < 0.65, 0
    while i < len(blocks):
        group = blocks[i : i + int(rng.integers(1, 4))]
        i += len(group)
        if rng.random() < 0.25 and (title := short(group[0][1], 1, 9, 1)):
            inner.append(f"<{(h := pick('h1', 'h2', 'h3', 'h4'))}>{say(title[0])}</{h}>")
        inner.append(laid(group, usual) if mixed and rng.random() < 0.5 else blocks_of_text(group, usual))
        if rng.random() < 0.2:
            inner.append(pick(advert(), advert(), side(), form()))
    if rng.random() < 0.3:
        inner.append(pick(comments(), side(), wrap('div class="share"', items())))
    body = wrap(pick("article", "main", 'div class="post-content"', 'div id="content"', 'section class="entry"', 'div role="main"', 'div class="story-body"', "div"), "".join(inner))
    if rng.random() < 0.5:
        body = wrap(pick("main", "div", 'div class="container"', 'div id="wrapper"', 'div class="page"'), body)
    before = [f() for f, p in ((notice, 0.3), (head, 0.7), (menu, 0.6), (advert, 0.4), (form, 0.2), (side, 0.2)) if rng.random() < p]
    after = [f() for f, p in ((comments, 0.4), (side, 0.5), (advert, 0.2), (form, 0.2), (foot, 0.8), (notice, 0.2)) if rng.random() < p]
    if rng.random() < 0.3:
        body = wrap("div", body + side())
    if rng.random() < 0.1:  # a bare fragment
        return pick("", "<body>") + "".join(f"<p>{esc(t)}</p>" if k or rng.random() < 0.5 else esc(t) for k, (_, t) in enumerate(blocks)), [t for _, t in blocks]
    return "<html><body>" + "".join(before) + body + "".join(after) + "</body></html>", texts


class Trees:
    """Gradient-boosted trees of fixed depth for a logistic loss, on binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if len(c) else c for c in x.T]
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rate = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
        self.bias = float(np.log(rate / (1 - rate)))
        b, f, rng = self._binned(x), np.full(len(x), self.bias), np.random.default_rng(5)
        for _ in range(TREES if len(x) else 0):
            p = 1 / (1 + np.exp(-f))
            some = np.sort(rng.permutation(x.shape[1])[: -(-x.shape[1] // 2)])  # half of the features, drawn anew for each tree
            feature, cut, value = self._grow(b[:, some], p - y, p * (1 - p))
            tree = some[feature], cut, value
            self.trees.append(tree)
            f += self._leaf(tree, b)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T)], axis=1).astype(np.uint8)

    @staticmethod
    def _grow(b: np.ndarray, g: np.ndarray, h: np.ndarray):
        n, m = b.shape
        at, inner = np.zeros(n, np.int64), (1 << LEVELS) - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, 255, np.int64)
        for level in range(LEVELS):
            first, width = (1 << level) - 1, 1 << level
            slot = (at - first)[:, None] * (m * BINS) + np.arange(m) * BINS + b
            shape = (width, m, BINS)
            sg = np.bincount(slot.ravel(), np.repeat(g, m), width * m * BINS).reshape(shape).cumsum(axis=2)
            sh = np.bincount(slot.ravel(), np.repeat(h, m), width * m * BINS).reshape(shape).cumsum(axis=2)
            tg, th = sg[:, :, -1:], sh[:, :, -1:]
            gain = sg**2 / (sh + CALM) + (tg - sg) ** 2 / (th - sh + CALM) - tg**2 / (th + CALM)
            gain[(sh < 1e-3) | (th - sh < 1e-3)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            top = gain.reshape(width, -1).max(axis=1)
            feature[first : first + width] = best // BINS
            cut[first : first + width] = np.where(top > 1e-6, best % BINS, 255)
            at = 2 * at + 1 + (b[np.arange(n), feature[at]] > cut[at])
        leaf = at - inner
        size = 1 << LEVELS
        value = -RATE * np.bincount(leaf, g, size) / (np.bincount(leaf, h, size) + CALM)
        return feature, cut, value

    @staticmethod
    def _leaf(tree, b: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        at, rows = np.zeros(len(b), np.int64), np.arange(len(b))
        for _ in range(LEVELS):
            at = 2 * at + 1 + (b[rows, feature[at]] > cut[at])
        return value[at - len(feature)]

    def logits(self, x: np.ndarray) -> np.ndarray:
        b, f = self._binned(x), np.full(len(x), self.bias)
        for tree in self.trees:
            f += self._leaf(tree, b)
        return f


def train(pages: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees from about ``sample`` pages, chosen by a hash, and ``VARIANTS`` layouts of each."""
    rows = pages.where(F.col("html").isNotNull() & (F.length("html") <= SAMPLE_CHARS))
    n = max(1, rows.count())
    hashed = F.xxhash64(F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    share = F.pmod(hashed, F.lit(1_000_000)) < max(1, int(sample * 1_000_000 / n))
    return learn([(r["page_id"], r["html"]) for r in rows.where(share).select("page_id", "html").orderBy(hashed, "page_id", "html").limit(2 * sample).collect()])


def learn(sample: list[tuple[int | None, str]]) -> Trees:
    """Trees from pages (page_id, html); those that do not mark their article by tag teach nothing."""
    xs, ys = [], []
    for page_id, source in sample:
        page = Page(source)
        content = marked_content(page)
        if content is None:
            continue
        xs.append(page.features())
        ys.append(content)
        rng = np.random.default_rng([11, abs(page_id or 0)])
        first = [k for k, (node, _, _) in enumerate(page.runs) if content[node]][: int(rng.integers(1, 4))]
        most = int(rng.integers(4, 60))
        page.runs = [(node, t[:most], min(links, most)) if content[node] else (node, t, links) for k, (node, t, links) in enumerate(page.runs) if k in first or not content[node]]
        full = Page(source)
        xs.append(page.features())
        ys.append(content)
        for _ in range(VARIANTS):
            laid, texts = variant(full, content, rng)
            other, at = Page(laid), 0
            good = np.zeros(len(other.tag), bool)
            for node, text, _ in other.runs:  # content blocks come in their order; the rest does not match
                if at < len(texts) and text == texts[at]:
                    good[node], at = True, at + 1
            for i in range(len(other.tag) - 1, 0, -1):
                good[other.parent[i]] |= good[i]
            xs.append(other.features())
            ys.append(good)
    if not xs:  # nothing to learn from: every block is as likely as not
        return Trees(np.zeros((0, Page("").features().shape[1])), np.zeros(0))
    return Trees(np.concatenate(xs), np.concatenate(ys).astype(float))


def extract(pages: DataFrame, trees: Trees) -> DataFrame:
    """page_id, url, text, n_chars of every row; a null or empty html gives the empty text.

    Whole pages of any length; repeated rows give repeated results; where keeping and dropping a block are equally likely, it
    goes. An empty table gives an empty one; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sources = b.column(2).to_pylist()
            # by size, too: a page's features take about as many bytes as its html times a small factor
            for a, z in ((i, min(i + 200, z)) for a, z in blocks_of([s or "" for s in sources], 2_000_000) for i in range(a, z, 200)):
                parsed = [Page(s or "") for s in sources[a:z]]
                x = [p.features() for p in parsed]
                scores = np.split(trees.logits(np.concatenate(x)), np.cumsum([len(m) for m in x])[:-1])
                texts = [p.text(s) for p, s in zip(parsed, scores)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, len(texts)), b.column(1).slice(a, len(texts)), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op6_html_text(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, train(pages))
