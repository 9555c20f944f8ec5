"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page is parsed into a tree of block elements (inline markup only adds to the
text of its block; scripts, styles and other raw elements are skipped); loose
text beside child elements is a node of its own. Each node is described by its
tag, the words of its class, id and role, those of its ancestors, its depth,
place among its siblings, and the text, link and tag density of its subtree. A
boosted sum of symmetric trees gives each node the log-odds of belonging to the
article.

Decoding is hierarchical: a node can be kept only if all its ancestors are, and
the kept set maximises the sum of the nodes' log-odds. Taken from the leaves
up, a subtree is worth what its node and its worthwhile children add up to, or
nothing, so no menu survives inside the article and no paragraph outside it.

The trees are fitted on at most ``sample`` pages. Their labels come from the
pages' own containers (an article or main element, or else the element that
holds most of the running text, against navigation, footers, asides, forms and
elements named as adverts or the like); each sampled
page is also learned from in altered forms, where containers become plainly
named or unnamed ``div`` elements and sidebars, notices, forms and reader
comments made of other pages' sentences are put around and into the article, so
that the decision does not rest on one site's tags. Scoring reads all pages'
whole html.

Defined results: null or empty html, and html without text, give an empty
text; unclosed, crossed or stray tags and quotes are tolerated (``Tags``), in
time linear in the page; a page may be of any length; without any sampled page
that has running text nothing is learned and all text is kept; rows are treated one by one, so repeated pages need no
rule; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendpace.llm.common import first_by_hash, pick

_OPEN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
#: One step inside a tag: blanks, or an attribute's name and how its value begins.
_STEP = re.compile(r"[\s/]+|([^\s=>/][^\s=>/]*|=[^\s=>/]*)(?:\s*=\s*([\"']?))?")
_BARE = re.compile(r"[^\s>]*")
_LABEL = re.compile(r' data-k="([bc])"')
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

RAW = frozenset("script style template title iframe svg textarea".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
GROUPS = {name: i for i, names in enumerate((
    "#text", "article main", "p", "h1", "h2 h3 h4 h5 h6", "ul ol dl menu", "li dt dd", "nav", "header", "footer", "aside",
    "form fieldset label select option button input legend", "table thead tbody tfoot tr td th caption",
    "section div center noscript object", "html body", "blockquote pre figure figcaption address details summary dialog")) for name in names.split()}
#: An open element of the key's kind ends where one of the value begins.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

BAD_WORDS = frozenset("""ad ads adv advert adverts advertisement adsense adslot banner promo promotion sponsor sponsored sidebar side rail
menu nav navbar navigation navi breadcrumb breadcrumbs crumbs footer foot header masthead topbar toolbar cookie cookies consent gdpr notice
notices notification alert popup modal overlay newsletter subscribe subscription signup signin login register search searchbox share sharing
social related recommended recommendations widget comment comments commentlist reply replies respond discussion disqus feedback form pagination
pager tagcloud copyright legal disclaimer skip hidden outbrain taboola""".split())
GOOD_WORDS = frozenset("article content main post entry story body text prose page copy column primary".split())
BAD_TAGS = frozenset("nav footer aside form header".split())


class Node:
    __slots__ = ("tag", "parent", "depth", "words", "kids", "text", "links", "mark", "has")

    def __init__(self, tag, parent, depth, words=frozenset(), mark=None):
        self.tag, self.parent, self.depth, self.words, self.mark = tag, parent, depth, words, mark
        self.kids, self.text, self.links, self.has = 0, "", 0, False


def _blank(text: str) -> str:
    return " ".join(entities.unescape(text).split())


class Tags:
    """The tags of a page in order, by the rules of HTML: a quoted value ends at
    its quote, an unquoted one at a blank or ``>``. Linear in the page: what is
    known to have no end is not looked for again. A value whose quote never
    closes ends at the next ``>``; a ``<`` whose tag never ends is text, and so
    is all after it; a comment that never ends is dropped."""

    def __init__(self, page: str):
        self.page, self.end = page, len(page)
        self.last = {c: page.rfind(c) for c in "\"'>"}
        self.unclosed: set[str] = set()

    def after(self, tag: str, at: int) -> int | None:
        """The place behind the next closing ``tag``, if there is one."""
        if tag not in self.unclosed:
            close = re.compile(rf"</{tag}(?![a-zA-Z0-9:-])[^>]*>", re.I).search(self.page, at)
            if close:
                return close.end()
            self.unclosed.add(tag)
        return None

    def next(self, at: int):
        """(start, end, closing, name, attributes) of the next tag at or after
        ``at``; the name is empty for comments and declarations. None at the
        end."""
        page = self.page
        while (start := page.find("<", at)) >= 0 and start < self.last[">"]:
            if page.startswith("<!--", start):
                stop = page.find("-->", start + 4)
                return start, (stop + 3 if stop >= 0 else self.end), "", "", {}
            m = _OPEN.match(page, start)
            if m:
                stop, attrs = self._inside(m.end())
                if stop is None:
                    return None
                return start, stop, m[1], m[2].lower(), attrs
            if page[start + 1:start + 2] in ("!", "?", "/"):
                return start, page.find(">", start) + 1, "", "", {}
            at = start + 1
        if start >= 0 and page.startswith("<!--", start):
            return start, self.end, "", "", {}
        return None

    def _inside(self, at: int):
        """The end of the tag whose attributes begin at ``at``, and those that
        name what an element is; a trailing slash is the attribute "/"."""
        page, attrs = self.page, {}
        while at < self.end:
            if page[at] == ">":
                if page[at - 1] == "/":
                    attrs["/"] = ""
                return at + 1, attrs
            m = _STEP.match(page, at)
            at, quote, value = m.end(), m[2], ""
            if quote and self.last[quote] >= at:
                stop = page.find(quote, at)
                value, at = page[at:stop], stop + 1
            elif quote:
                stop = page.find(">", at)
                value, at = page[at:stop if stop >= 0 else self.end], stop if stop >= 0 else self.end
            elif quote is not None:
                bare = _BARE.match(page, at)
                value, at = bare[0], bare.end()
            if m[1] and (name := m[1].lower()) in _TELLING:
                attrs.setdefault(name, value)
        return None, attrs


_TELLING = frozenset(("class", "id", "role", "aria-label", "data-k"))


def parse(page: str, marked: bool = False) -> list[Node]:
    """The page's nodes in page order; nodes with text hold it decoded, with
    single spaces. Only in ``marked`` pages, those ``altered`` made, is the
    label attribute read: pages may use that name for their own ends."""
    nodes = [Node("html", -1, 0)]
    stack, piece, linked, link = [0], [], 0, 0
    at, end, tags = 0, len(page), Tags(page)

    def flush():
        nonlocal piece, linked
        if piece:
            text = _blank("".join(piece))
            if text:
                leaf = Node("#text", stack[-1], nodes[stack[-1]].depth + 1)
                leaf.text, leaf.links = text, min(linked, len(text))
                nodes.append(leaf)
            piece, linked = [], 0

    while at < end:
        found = tags.next(at)
        stop = found[0] if found else end
        if stop > at:
            piece.append(page[at:stop])
            linked += (stop - at) * (link > 0)
        if not found:
            break
        _, at, closing, tag, attrs = found
        if not tag:
            continue
        if tag in RAW:
            # an element of this kind that is never closed: of scripts and styles
            # the rest of the page is theirs, of others only the tag goes
            if not closing and "/" not in attrs:
                at = tags.after(tag, at) or (end if tag in ("script", "style") else at)
            continue
        if tag == "br":
            piece.append(" ")
        elif tag == "a":
            link = 0 if closing else 1
        elif tag in ("html", "head", "body"):
            flush()
            if not closing and tag == "body":
                nodes[0].words |= _words(attrs)
        elif tag in GROUPS or tag == "hr":
            flush()
            link = 0
            if closing:
                for k in range(len(stack) - 1, 0, -1):
                    if nodes[stack[k]].tag == tag:
                        del stack[k:]
                        break
                continue
            if tag == "hr":
                continue
            if nodes[stack[-1]].tag == "p":
                stack.pop()
            ends = next((k for k in range(len(stack) - 1, max(0, len(stack) - 4), -1) if tag in _ENDS.get(nodes[stack[k]].tag, ())), 0)
            if ends:
                del stack[ends:]
            if tag in VOID:
                continue
            mark = attrs.get("data-k") if marked else None
            nodes.append(Node(tag, stack[-1], nodes[stack[-1]].depth + 1, _words(attrs) if attrs else frozenset(), mark))
            if "/" not in attrs:
                stack.append(len(nodes) - 1)
    flush()
    for i in range(len(nodes) - 1, 0, -1):
        nodes[nodes[i].parent].kids += 1
    # text that is all an element holds is the element's own
    out, place = [], {}
    for i, n in enumerate(nodes):
        if n.tag == "#text" and nodes[n.parent].kids == 1 and n.parent:
            own = out[place[n.parent]]
            own.text, own.links, own.kids = n.text, n.links, 0
            continue
        n.parent = place.get(n.parent, -1)
        place[i] = len(out)
        out.append(n)
    return out


def _words(attrs: dict[str, str]) -> frozenset:
    return frozenset(w.lower() for name, value in attrs.items() if name != "data-k" for w in _NAME.findall(value))


N_FEATURES = len(set(GROUPS.values())) + 24


def features(nodes: list[Node]) -> np.ndarray:
    n, groups = len(nodes), N_FEATURES - 24
    chars, links, tags, paras, stops = [0] * n, [0] * n, [1] * n, [0] * n, [0] * n
    for i, x in enumerate(nodes):
        if x.text:
            chars[i], links[i] = len(x.text), x.links
            stops[i] = x.text.count(". ") + x.text.count(",") + x.text.endswith(".")
        if x.tag == "p":
            paras[i] = 1
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        chars[p] += chars[i]
        links[p] += links[i]
        tags[p] += tags[i]
        paras[p] += paras[i]
        stops[p] += stops[i]
    total = max(1, chars[0])
    rows = np.zeros((n, N_FEATURES), np.float32)
    above = [(0, 0, 0, 0, 99)] * n  # bad and good words and tags above, distance to the nearest bad one
    seen = [0] * n
    extra = []
    for i, x in enumerate(nodes):
        p = x.parent
        bad, good = len(x.words & BAD_WORDS), len(x.words & GOOD_WORDS)
        btag, gtag = x.tag in BAD_TAGS, x.tag == "article" or x.tag == "main"
        ab, ag, tb, tg, far = above[p] if p >= 0 else (0, 0, 0, 0, 99)
        above[i] = (ab + (bad > 0), ag + (good > 0), tb + btag, tg + gtag, 0 if bad or btag else min(far + 1, 99))
        place = 0
        if p >= 0:
            place = seen[p]
            seen[p] += 1
        text = x.text
        up = nodes[p] if p >= 0 else x
        extra.append((bad, good, ab, ag, tb, tg, min(far, 20), x.depth, x.kids, place, up.kids - place, chars[i], links[i] / (chars[i] or 1),
                      chars[i] / tags[i], tags[i], paras[i], stops[i] / (chars[i] / 100 + 1), chars[i] / total, chars[p] / total if p >= 0 else 1,
                      GROUPS.get(up.tag, 13), "©" in text, bool(text) and text[-1] in ".!?:…\"", len(up.words & BAD_WORDS), min(i / n, 1)))
        rows[i, GROUPS.get(x.tag, 13)] = 1
    rows[:, groups:] = extra
    return rows


class Trees:
    """Boosted symmetric trees for a binary outcome: each level of a tree asks
    one question of all its leaves, so a tree is a few comparisons per node."""

    def __init__(self, start: float = 0.0):
        self.start, self.trees = start, []

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for splits, leaves in self.trees:
            at = np.zeros(len(x), np.int64)
            for f, cut in splits:
                at = at * 2 + (x[:, f] > cut)
            out += leaves[at]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 24, ridge: float = 2.0) -> Trees:
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = Trees(float(np.log(share / (1 - share))))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = [np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)]
    raw = np.full(len(y), model.start)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        at, splits = np.zeros(len(y), np.int64), []
        for level in range(depth):
            best = (-1.0, 0, 0)
            for f, c in enumerate(cuts):
                k = len(c) + 1
                cell = at * k + binned[f]
                gs = np.bincount(cell, g, (1 << level) * k).reshape(-1, k).cumsum(1)
                hs = np.bincount(cell, h, (1 << level) * k).reshape(-1, k).cumsum(1)
                gl, hl = gs[:, :-1], hs[:, :-1]
                gr, hr = gs[:, -1:] - gl, hs[:, -1:] - hl
                gain = (gl ** 2 / (hl + ridge) + gr ** 2 / (hr + ridge)).sum(0)
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), f, int(gain.argmax()))
            _, f, b = best
            splits.append((f, float(cuts[f][b]) if len(cuts[f]) else np.inf))
            at = at * 2 + (binned[f] > b)
        leaves = rate * np.bincount(at, g, 1 << depth) / (np.bincount(at, h, 1 << depth) + ridge)
        model.trees.append((splits, leaves))
        raw += leaves[at]
    return model


def decode(nodes: list[Node], logit: np.ndarray) -> list[bool]:
    """The best set of nodes that holds every kept node's ancestors."""
    worth = logit.tolist()
    worth[0] += 1e6  # the page itself
    for i in range(len(nodes) - 1, 0, -1):
        if worth[i] > 0:
            worth[nodes[i].parent] += worth[i]
    keep = [True] * len(nodes)
    for i, n in enumerate(nodes):
        keep[i] = worth[i] > 0 and (n.parent < 0 or keep[n.parent])
    return keep


def extract(pages: list[str], model: Trees) -> list[str]:
    parsed = [parse(p) for p in pages]
    out, at = [], 0
    logits = model.logits(np.concatenate([features(n) for n in parsed])) if parsed else []
    for nodes in parsed:
        keep = decode(nodes, logits[at:at + len(nodes)])
        at += len(nodes)
        out.append("\n".join(n.text for n, k in zip(nodes, keep) if k and n.text))
    return out


# ---- learning -----------------------------------------------------------

def _seeded(nodes: list[Node]) -> bool:
    """Mark the page's own containers; whether it has a main one. Without an
    article or main element the main one is the deepest element that holds most
    of the page's running text (text outside links and outside the containers
    marked so far)."""
    main = False
    for n in nodes:
        if n.mark is None:
            if n.tag in ("article", "main"):
                n.mark, main = "c", True
            elif n.tag in ("nav", "footer", "aside", "form") or n.words & BAD_WORDS and not n.words & GOOD_WORDS:
                n.mark = "b"
            elif n.tag == "header" and n.words.isdisjoint(GOOD_WORDS):
                n.mark = "b"
        main = main or n.mark == "c"
    return main or _densest(nodes)


def _densest(nodes: list[Node]) -> bool:
    running, kids = [0] * len(nodes), [[] for _ in nodes]
    for i in range(len(nodes) - 1, -1, -1):
        n = nodes[i]
        running[i] = 0 if n.mark == "b" else running[i] + len(n.text) - n.links
        if i:
            running[n.parent] += running[i]
            kids[n.parent].append(i)
    if not running[0]:
        return False
    at = 0
    while True:
        inner = max((k for k in kids[at] if nodes[k].kids), key=running.__getitem__, default=None)
        if inner is None or running[inner] < 0.6 * running[at]:
            break
        at = inner
    nodes[at].mark = "c"
    return True


def examples(page: str, marked: bool = False):
    """(features, labels) of a page's nodes: a text belongs to the article if
    its nearest marked ancestor does, an element if it holds such text."""
    nodes = parse(page, marked)
    if not _seeded(nodes):
        return None
    side, label = ["b"] * len(nodes), np.zeros(len(nodes))
    for i, n in enumerate(nodes):
        side[i] = n.mark or (side[n.parent] if n.parent >= 0 else "b")
        label[i] = side[i] == "c" and bool(n.text)
    for i in range(len(nodes) - 1, 0, -1):
        label[nodes[i].parent] = max(label[nodes[i].parent], label[i])
    return features(nodes), label


def altered(page: str, others: list[str], rng: random.Random) -> str:
    """The page with its containers named otherwise and with more around and
    inside the article; ``data-k`` carries the labels along."""
    def some(a=1, b=3, short=False):
        """Sentences of other pages."""
        out = []
        for _ in range(rng.randint(a, b)):
            words = rng.choice(others).split()
            k = rng.randint(0, max(0, len(words) - 2))
            out.append(" ".join(words[k:k + (rng.randint(1, 6) if short else rng.randint(4, 60))]))
        return out

    def p(texts):
        return "".join(f"<p>{entities.escape(t)}</p>" for t in texts)

    def items(texts, linked):
        return "<ul>" + "".join(f'<li><a href="/x">{entities.escape(t)}</a></li>' if linked else f"<li>{entities.escape(t)}</li>" for t in texts) + "</ul>"

    def box(kind, inner):
        tag, names = kind
        name = rng.choice(names)
        attr = rng.choice(["class", "class", "id"])
        return f'<{tag} {attr}="{name}" data-k="b">{inner}</{tag}>' if name else f'<{tag} data-k="b">{inner}</{tag}>'

    side = [("aside", ["", "sidebar", "related", "widget"]), ("div", ["sidebar", "side-bar", "widget-area", "right-rail", "related-posts", "recommended"])]
    notice = [("div", ["cookie-notice", "notice", "consent-banner", "alert", "gdpr", "newsletter-popup", "subscribe-box"]), ("section", ["notice", "cookie-bar"])]
    advert = [("div", ["ad", "ads", "advert", "ad-slot", "sponsored", "promo", "banner"]), ("section", ["advertisement", "promo"]), ("aside", ["ad", "promo"])]
    comment = [("section", ["comments", "comment-list", "discussion"]), ("div", ["comments", "comment", "replies", "disqus_thread"]), ("ul", ["commentlist"])]
    menu = [("nav", ["", "menu", "main-nav"]), ("div", ["menu", "navbar", "navigation", "breadcrumbs"]), ("ul", ["nav", "menu"])]
    head = [("header", ["", "site-header", "masthead"]), ("div", ["header", "topbar", "site-header"])]
    foot = [("footer", ["", "site-footer"]), ("div", ["footer", "site-info", "copyright"])]
    form = [("form", ["", "search-form", "signup", "contact"])]

    def thread():
        one = lambda: f'<div class="{rng.choice(["comment", "reply", "comment-body", ""])}">' + p(some(1, 2)) + "</div>"
        return "<h3>" + rng.choice(["Comments", "Replies", "3 comments", "Discussion"]) + "</h3>" + "".join(one() for _ in range(rng.randint(1, 5)))

    def around():
        kind = rng.choice(["side", "notice", "advert", "menu", "head", "foot", "form", "comment"])
        if kind == "menu":
            return box(rng.choice(menu), items(some(2, 8, True), rng.random() < 0.9))
        if kind == "head":
            return box(rng.choice(head), rng.choice([p(some(1, 2, True)), f"<h1>{some(1, 1, True)[0]}</h1>", items(some(2, 5, True), True)]))
        if kind == "foot":
            return box(rng.choice(foot), rng.choice(["&copy; ", "Copyright ", ""]) + rng.choice([p(some(1, 2)), some(1, 1)[0], items(some(2, 5, True), True)]))
        if kind == "form":
            return box(form[0], f"<label>{some(1, 1, True)[0]}</label><input name=q><select><option>{some(1, 1, True)[0]}</option></select><button>Send</button>" + p(some(0, 1)))
        if kind == "comment":
            return box(rng.choice(comment), thread())
        return box(rng.choice({"side": side, "notice": notice, "advert": advert}[kind]),
                   rng.choice([p(some(1, 4)), entities.escape(some(1, 1)[0]), items(some(2, 6, True), rng.random() < 0.7), "<h3>" + some(1, 1, True)[0] + "</h3>" + p(some(1, 2))]))

    m = re.search(r"<(article|main)\b[^>]*>(.*)</\1>", page, re.S | re.I)
    if not m:
        return page
    inner = m[2]
    if rng.random() < 0.5:  # something inside the article
        breaks = [x.start() for x in re.finditer(r"<p\b|</?h2", inner)] or [len(inner)]
        cut = rng.choice(breaks + [len(inner)])
        inner = inner[:cut] + around() + inner[cut:]
    if rng.random() < 0.3:  # things an article may hold besides paragraphs
        more = rng.choice([items(some(2, 5), False), "<blockquote>" + p(some(1, 2)) + "</blockquote>", "<h2>" + some(1, 1, True)[0] + "</h2>" + p(some(1, 3)),
                           "<pre>" + entities.escape(some(1, 1)[0]) + "</pre>", "<table><tr>" + "".join(f"<td>{t}</td>" for t in some(2, 4, True)) + "</tr></table>",
                           "<header><h1>" + some(1, 1, True)[0] + "</h1></header>", "<figure><figcaption>" + some(1, 1, True)[0] + "</figcaption></figure>"])
        inner = inner + more if rng.random() < 0.7 else more + inner
    tag = rng.choice(["article", "article", "main", "div", "div", "section"])
    name = "" if tag in ("article", "main") and rng.random() < 0.6 else rng.choice(
        ["content", "post", "entry-content", "article-body", "main", "story", "post-content", "page-content", "text"])
    body = f'<{tag} {rng.choice(["class", "id"])}="{name}" data-k="c">{inner}</{tag}>' if name else f'<{tag} data-k="c">{inner}</{tag}>'
    before, after = page[:m.start()], page[m.end():]
    if rng.random() < 0.5:
        before = re.sub(r"<nav>(.*?)</nav>", lambda x: box(rng.choice(menu[1:]), x[1]), before, flags=re.S)
        after = re.sub(r"<footer>(.*?)</footer>", lambda x: box(foot[1], x[1]), after, flags=re.S)
    for _ in range(rng.randint(0, 3)):
        before += around()
    for _ in range(rng.randint(0, 3)):
        after = around() + after
    if rng.random() < 0.4:
        body = f'<div class="{rng.choice(["wrapper", "container", "layout", "row", "page"])}">{body}{around()}</div>'
    return before + body + after


def lessons(pages: list[str], forms: int = 4, seed: int = 11, nodes: int = 500):
    """(features, labels) of sampled pages and altered forms of them; of a page
    with more than ``nodes`` nodes that many at random."""
    rng = random.Random(seed)
    texts = [t for t in (" ".join(n.text for n in parse(p) if n.tag == "p" and n.text) for p in pages) if t] or ["none"]
    for page in pages:
        page = _LABEL.sub("", page)
        for form in [page, *(altered(page, texts, rng) for _ in range(forms))]:
            got = examples(form, True)
            if got is not None:
                x, y = got
                if len(y) > nodes:
                    some = sorted(random.Random(seed).sample(range(len(y)), nodes))
                    x, y = x[some], y[some]
                yield x, y


def learn(taught) -> Trees:
    """Trees from ``lessons``."""
    taught = list(taught)
    if not taught:
        return Trees(1.0)
    return fit_trees(np.concatenate([x for x, _ in taught]).astype(float), np.concatenate([y for _, y in taught]))


def main_text(pages: DataFrame, sample: int = 300) -> DataFrame:
    """Per page: page_id, url, text, n_chars. The trees are fitted on at most
    ``sample`` pages of any length, the first by a hash of the id; their nodes'
    features are made in a task, and at most 500 nodes of each form of a page
    reach the driver."""
    import pyarrow as pa

    rows = pick(pages, "page_id", "url", "html").withColumn("html", F.coalesce("html", F.lit("")))

    def teach(batches):
        for b in batches:
            for x, y in lessons(b.column("html").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array([x.astype("<f4").tobytes()]), pa.array([y.astype("<f4").tobytes()])], ["x", "y"])

    some = first_by_hash(rows, sample, "page_id", "html").select("html").mapInArrow(teach, "x binary, y binary").collect()
    model = learn((np.frombuffer(r["x"], "<f4").reshape(-1, N_FEATURES), np.frombuffer(r["y"], "<f4")) for r in some)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                text = extract(part.column("html").to_pylist(), model)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(text, pa.string()),
                                                  pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
