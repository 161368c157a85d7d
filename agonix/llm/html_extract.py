"""Main text of web pages by a tree-structured graphical model.

Every DOM element is a binary variable: content or not. Node potentials come from what the element shows by itself (its
tag, the words of its class, id and role, its text length, links and punctuation); parent-child potentials from how
labels follow each other for the kinds of parent and child. Sum-product messages go upward from the leaves and downward
from the root and give every element's exact content marginal; text whose element is content with at least 0.5 stays.

Both potentials are trained, piecewise, from labelled pages: a bounded sample of the given pages (``sample``, by hash of
their id) whose semantic elements label them, and a few dozen labelled pages of other layouts written here.

Names count as boilerplate's only as a whole ("ad-banner", not "author-bio" or "search-methods"); ids of headings and
paragraphs, and of anything but sections and divs within an article, name passages and count for nothing.

A block is what block elements separate; white space inside it, line breaks included, becomes one space. Blocks are
joined in page order by one line feed.

Defined cases: a null or empty html has an empty text; broken markup is read as browsers do roughly (open paragraphs and
items end where the next begins, stray end tags are dropped); repeated rows are read each for itself; an empty table
gives no rows; other columns are kept, ``text`` is replaced.
"""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import with_column
from .common import small_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
SILENT = frozenset("script style noscript template iframe svg canvas object".split())  # never text
_OFF = frozenset("nav footer aside form head title button select textarea dialog menu fieldset label option noscript".split())
_ON = frozenset("article main".split())
_HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
_BAD = frozenset("nav navbar navigation menu foot footer bottom head header masthead topbar top side sidebar aside widget widgets ad ads adv advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay subscribe newsletter signup login signin register form search share sharing social related recommended recommendations more comment comments commentlist reply replies respond discussion disqus breadcrumb breadcrumbs crumbs pagination pager copyright legal tags toolbar skip hidden complementary contentinfo dialog author meta".split())
_GOOD = frozenset("article content main post entry story body text page maincontent articlebody prose".split())
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_STOP = re.compile(r"[.!?;:,]")
_CLOSES = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
_SCOPE = frozenset("ul ol dl table body html article section div main td th blockquote aside footer header nav form".split())
KINDS = ("off", "on", "head", "para", "item", "cell", "inline", "box")
#: Words that may stand beside boilerplate's in its name and leave it what it is.
_PLAIN = frozenset("area bar block body box button buttons by column col container group holder inner item items left link links list outer panel panels post posts primary reader right secondary section site skyscraper slot top unit user wrap wrapper main page global header label links".split())
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th blockquote pre figcaption a b i em strong span".split())
_SPECIAL = re.compile(r">|=\s*[\"']")
_OPENING = re.compile(r"<!--|<[!?]|</|<(?=[A-Za-z])")
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_COMMENT_END = re.compile(r"--!?>|(?<=<!)-->|(?<=<!)--->")
_ATTRIBUTE = re.compile(r"([^\s/>=][^\s/>=]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")
#: Elements whose text holds no markup.
_RAW = frozenset("script style xmp iframe noembed noframes title textarea".split())
_CUES: dict[str, tuple[int, int]] = {}


def _name_cue(name: str) -> tuple[int, int]:
    """Of one name: whether it is boilerplate's, wholly made of its words and of plain ones, and whether it has a content word."""
    if name not in _CUES:
        if len(_CUES) > 50_000:
            _CUES.clear()
        own = {w.lower() for w in _TOKEN.findall(name)}
        _CUES[name] = (int(bool(own & _BAD) and own <= _BAD | _PLAIN), int(bool(own & _GOOD)))
    return _CUES[name]


def _cue(attributes: dict[str, str]) -> tuple[int, int]:
    """Whether class, id and role name boilerplate or content: each name of a class list counts by itself."""
    cues = [_name_cue(name) for k, v in attributes.items() for name in ([v] if k == "aria-label" else v.split())]
    return max((b for b, _ in cues), default=0), max((g for _, g in cues), default=0)


def _kind(tag: str) -> int:
    if tag in _OFF:
        return 0
    if tag in _ON:
        return 1
    if tag in _HEADS:
        return 2
    if tag in ("p", "blockquote", "pre", "figcaption"):
        return 3
    if tag in ("li", "dd", "dt"):
        return 4
    if tag in ("td", "th"):
        return 5
    return 7 if tag in BLOCKS else 6


class Tags:
    """The markup of a page in one pass, in time linear in its length whatever it holds.

    A tag ends at the first > outside its quoted attribute values; where those never end, at the first > of all. Without
    any > left, a < is text. A quoted value that led to the end of the page once isn't tried again: what a quote opens
    doesn't depend on where the tag began."""

    def __init__(self, html: str):
        self.html, self.last = html, html.rfind(">")
        self.dead: set[int] = set()
        self.next = (0, -1, -1)  # from where, the next > or quoted value, its quote

    def _special(self, at: int) -> tuple[int, int]:
        """Where the next > or quoted value from ``at`` on is, and its quote (-1 for >)."""
        since, where, quote = self.next
        if not since <= at <= where:
            m = _SPECIAL.search(self.html, at)
            where, quote = (m.start(), m.end() - 1 if m[0] != ">" else -1) if m else (len(self.html), -1)
            self.next = (at, where, quote)
        return where, quote

    def end(self, at: int) -> int:
        """Where the tag that begins at ``at`` ends, -1 if nowhere."""
        if at > self.last:
            return -1
        html, tried, p = self.html, [], at
        while p <= self.last:
            where, quote = self._special(p)
            if quote < 0:
                if where <= self.last:
                    return where
                break
            if quote in self.dead:
                break
            tried.append(quote)
            close = html.find(html[quote], quote + 1)
            if close < 0:
                break
            p = close + 1
        self.dead.update(tried)
        return html.find(">", at)

    def events(self) -> Iterator[tuple[str, str, str]]:
        """("start", tag, attributes), ("end", tag, "") and ("text", "", text) in order."""
        html, n, at, text = self.html, len(self.html), 0, []
        ended: set[str] = set()  # raw elements that nothing closes any more
        while at < n:
            lt = html.find("<", at)
            if lt < 0 or lt > self.last and not html.startswith("<!--", lt):
                text.append(html[at:])
                break
            if lt > at:
                text.append(html[at:lt])
            m = _OPENING.match(html, lt)
            if not m:
                text.append("<")
                at = lt + 1
                continue
            if text and m[0] != "</":
                yield "text", "", unescape("".join(text))
                text.clear()
            if m[0] == "<!--":
                close = _COMMENT_END.search(html, lt + 2)
                at = close.end() if close else n
            elif m[0] in ("<!", "<?", "</"):
                name = _NAME.match(html, lt + 2) if m[0] == "</" else None
                at = (self.end(lt) if name else html.find(">", lt)) + 1
                if name:
                    if text:
                        yield "text", "", unescape("".join(text))
                        text.clear()
                    yield "end", name[0].lower(), ""
            else:
                tag, stop = _NAME.match(html, lt + 1)[0].lower(), self.end(lt)
                yield "start", tag, html[lt + 1 + len(tag) : stop]
                at = stop + 1
                if tag in _RAW:
                    close = None if tag in ended else re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
                    if tag not in ended and not close:
                        ended.add(tag)
                    stop = close.start() if close else n
                    if stop > at:
                        yield "text", "", unescape(html[at:stop]) if tag in ("title", "textarea") else html[at:stop]
                    at = stop
        if text:
            yield "text", "", unescape("".join(text))


class Tree:
    """The elements of a page in order, and its text segments (element, block, text)."""

    def read(self, html: str) -> "Tree":
        self.parent, self.kind, self.bad, self.good, self.link, self.label = [-1], [7], [0], [0], [0], [None]
        self.inside, self.under = [0], [0]  # whether an element is in one that is, or names itself, an article; boilerplate
        self.open, self.tags = [0], [""]
        self.at: dict[str, list[int]] = defaultdict(list)  # places of each open tag, and of open scopes and silent elements
        self.block = 0
        self.segments: list[tuple[int, int, str]] = []
        for what, tag, rest in Tags(html).events():
            if what == "text":
                if not self.silent:
                    self.segments.append((self.open[-1], self.block, rest))
            elif what == "start":
                self._start(tag, rest)
            else:
                self._end(tag)
        return self

    @property
    def silent(self) -> int:
        """How many open elements never show their text."""
        return len(self.at["silent"])

    def _place(self, tag: str) -> int:
        """Where the innermost open element of this tag is, 0 if there is none."""
        return self.at[tag][-1] if self.at[tag] else 0

    def _close(self, place: int) -> None:
        """Close the elements from ``place`` on; each is closed once."""
        while len(self.tags) > place:
            tag = self.tags.pop()
            self.open.pop()
            for kind in (tag, "scope" if tag in _SCOPE else None, "silent" if tag in SILENT else None):
                if kind:
                    self.at[kind].pop()

    def _start(self, tag: str, rest: str) -> None:
        if tag in BLOCKS:
            self.block += 1
            place = max(self._place(t) for t in _CLOSES.get(tag, ("p",)))
            if place and place >= max(self._place("scope"), self._place("silent")):  # what is in a silent element closes nothing around it
                self._close(place)
        if tag in VOID:
            if tag == "br":
                self.segments.append((self.open[-1], self.block, " "))
            return
        own, label = {}, None
        for m in _ATTRIBUTE.finditer(rest):
            k, v = m[1].lower(), (m[2] or "").strip("\"'")
            if v and k in ("class", "id", "role", "aria-label") and k not in own:
                own[k] = unescape(v)
            elif k == "data-label":
                label = v == "1"
        up = self.open[-1]
        if tag in _PROSE or self.inside[up] and tag not in ("div", "section"):
            own.pop("id", None)  # there an id is the address of a passage
        bad, good = _cue(own)
        self.parent.append(up)
        self.kind.append(_kind(tag))
        self.bad.append(bad or int(tag == "header" and self.kind[up] != 1))
        self.good.append(good)
        self.link.append(int(tag == "a" or self.link[up]))
        self.label.append(label)
        bad = self.bad[-1]
        self.under.append(int(tag not in _ON and bool(bad or self.kind[-1] == 0 or self.under[up])))
        self.inside.append(int(tag in _ON or not self.under[-1] and (good or self.inside[up])))
        self.open.append(len(self.parent) - 1)
        for kind in (tag, "scope" if tag in _SCOPE else None, "silent" if tag in SILENT else None):
            if kind:
                self.at[kind].append(len(self.tags))
        self.tags.append(tag)

    def _end(self, tag: str) -> None:
        if tag in BLOCKS:
            self.block += 1
        place = self._place(tag)
        if place and (tag in BLOCKS or place >= self._place("scope")):
            self._close(place)

    def features(self) -> np.ndarray:
        """One row per element."""
        n = len(self.parent)
        own, linked, stops, whole = [0] * n, [0] * n, [0] * n, [0] * n
        for at, _, text in self.segments:
            size = len(text) - text.count(" ")
            if size > 1:
                own[at] += size
                linked[at] += size * self.link[at]
                stops[at] += len(_STOP.findall(text))
                whole[at] += "©" in text
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            linked[p] += linked[i]
            if self.kind[i] == 6:  # inline text belongs to the element around it
                stops[p] += stops[i]
                own[p] += own[i]
                whole[p] += whole[i]
        x = np.zeros((n, len(KINDS) + 11))
        x[np.arange(n), self.kind] = 1
        own = np.array(own, dtype=float)
        k = len(KINDS)
        x[:, k], x[:, k + 1] = self.bad, self.good
        x[:, k + 2] = np.minimum(np.log1p(own), 6)
        x[:, k + 3] = np.minimum(np.array(linked) / np.maximum(own, 1), 1)
        x[:, k + 4] = np.minimum(np.log1p(np.array(stops)), 3)
        x[:, k + 5] = np.minimum(whole, 1)
        x[:, k + 6] = (own > 0) & (own < 25)
        x[:, k + 7] = x[:, k] * x[:, k + 1]
        x[:, k + 8] = self.inside
        x[:, k + 9] = x[:, k + 8] * x[:, k + 3]
        x[:, k + 10] = self.under
        return x

    def groups(self) -> list[int]:
        """The kind of each parent-child edge: by the cues of parent and child; inline children are one kind. An element
        without a cue of its own shows that of boilerplate around it."""
        cue: list[int] = []
        for b, g, k, p in zip(self.bad, self.good, self.kind, self.parent, strict=True):
            cue.append(1 if b or k == 0 else 2 if g or k == 1 else int(p >= 0 and cue[p] == 1))
        return [9 if k == 6 else 3 * cue[p] + c for p, c, k in zip(self.parent, cue, self.kind, strict=True)]

    def text(self, stays: list[bool]) -> str:
        blocks: list[str] = []
        last, parts = None, []
        for at, block, text in [*self.segments, (0, None, "")]:
            if block != last:
                if parts and (whole := " ".join("".join(parts).split())):
                    blocks.append(whole)
                last, parts = block, []
            if stays[at]:
                parts.append(text)
        return "\n".join(blocks)


class Model:
    """Node weights and a 2x2 table per kind of edge; exact marginals by messages up and down the tree."""

    def __init__(self, weights: np.ndarray, edges: np.ndarray):
        self.weights, self.edges = weights, [tuple(e.ravel().tolist()) for e in edges]

    def marginals(self, tree: Tree) -> list[float]:
        """Log-odds of content of every element."""
        exp, log = math.exp, math.log
        belief = np.clip(tree.features() @ self.weights, -25, 25).tolist()
        parent, edges = tree.parent, [self.edges[g] for g in tree.groups()]
        up = [0.0] * len(belief)
        for i in range(len(belief) - 1, 0, -1):
            a, b, c, d = edges[i]
            e = exp(min(30.0, max(-30.0, belief[i])))
            up[i] = log((c + d * e) / (a + b * e))
            belief[parent[i]] += up[i]
        for i in range(1, len(belief)):
            a, b, c, d = edges[i]
            e = exp(min(30.0, max(-30.0, belief[parent[i]] - up[i])))
            belief[i] += log((b + d * e) / (a + c * e))
        return belief

    def extract(self, html: str) -> str:
        tree = Tree().read(html)
        return tree.text([b >= 0 for b in self.marginals(tree)])


def _labels(tree: Tree) -> np.ndarray:
    """1 where all text below an element is content; without text, the parent's. data-label on an element holds below it."""
    n = len(tree.parent)
    told, has, good = [False] * n, [0] * n, [0] * n
    for i in range(1, n):
        told[i] = told[tree.parent[i]] if tree.label[i] is None else tree.label[i]
    for at, _, text in tree.segments:
        if text.strip():
            has[at] += 1
            good[at] += told[at]
    for i in range(n - 1, 0, -1):
        has[tree.parent[i]] += has[i]
        good[tree.parent[i]] += good[i]
    return np.array([told[i] if not has[i] else good[i] == has[i] for i in range(n)], dtype=float)


def train(trees: list[Tree]) -> Model:
    """Node weights by ridge logistic regression, edge tables by smoothed counts."""
    labels = [_labels(t) for t in trees]
    x, y = np.concatenate([t.features() for t in trees]), np.concatenate(labels)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w)), x.T @ (p - y) + 0.5 * w)
        w -= np.clip(step, -3, 3)
    counts = np.full((10, 2, 2), 0.5)
    counts[:, [0, 1], [0, 1]] += 0.5
    for t, own in zip(trees, labels, strict=True):
        for i, g in enumerate(t.groups()):
            if i:
                counts[g, int(own[t.parent[i]]), int(own[i])] += 1
    edges = counts / counts.sum(2, keepdims=True)
    # The node weights hold the share of content once; taken out of the edges, it isn't counted twice.
    share = np.clip(y.mean(), 0.05, 0.95)
    return Model(w, edges / np.array([1 - share, share]))


_PARTS = {  # boilerplate by semantic element, and by class or id
    "nav": ("nav", "nav", "navbar", "main-menu", "site-navigation", "menu", "breadcrumbs"),
    "header": ("header", "header", "site-header", "masthead", "topbar"),
    "footer": ("footer", "footer", "site-footer", "copyright", "page-footer"),
    "aside": ("aside", "sidebar", "side", "widget-area", "related-posts", "right-sidebar"),
    "ad": ("div", "ad", "ads", "advert", "sponsored", "ad-banner", "promo"),
    "notice": ("div", "cookie-notice", "notice", "consent-banner", "alert", "popup"),
    "comments": ("section", "comments", "comment-list", "reader-comments", "discussion", "replies"),
    "form": ("form", "newsletter-form", "search-form", "signup", "login-form", "subscribe"),
    "share": ("div", "share", "social-links", "share-buttons", "tags"),
}


def layouts(many: int = 120, seed: int = 3) -> list[str]:
    """Labelled pages of several layouts; content is marked with data-label, which no feature sees."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(r.randint(2, 9)))
    say = lambda a, b: " ".join(word() for _ in range(r.randint(a, b))).capitalize()
    prose = lambda: " ".join(say(6, 18) + r.choice([".", ".", "?", ", " + word() + "."]) for _ in range(r.randint(1, 5)))
    links = lambda: "<ul>" + "".join(f'<li><a href="/{word()}">{say(1, 3)}</a></li>' for _ in range(r.randint(3, 8))) + "</ul>"
    inside = {
        "nav": links, "header": lambda: f'<a href="/">{say(1, 3)}</a><p>{say(2, 6)}</p>' + r.choice([links(), ""]),
        "footer": lambda: r.choice([f"&copy; {word()} {say(3, 12)}.", f"<p>&copy; {say(4, 16)}.</p>", f"<p>{prose()}</p>{links()}"]),
        "aside": lambda: f"<h3>{say(1, 3)}</h3>" + r.choice([links(), f"<p>{prose()}</p>"]), "ad": lambda: r.choice([say(4, 12) + ".", f"<p>{prose()}</p>", f'<a href="/x">{say(3, 8)}</a>']),
        "notice": lambda: r.choice([f"<p>{prose()}</p><button>OK</button>", say(8, 20) + "."]), "share": lambda: links(),
        "comments": lambda: f"<h3>{say(1, 2)}</h3>" + "".join(f'<div class="{r.choice(["comment", "reply", "c"])}"><b>{word()}</b><p>{prose()}</p></div>' for _ in range(r.randint(1, 5))),
        "form": lambda: f"<label>{say(1, 3)}</label><input name=q><button>{word()}</button><p>{say(3, 10)}.</p>",
    }

    def part(name: str, semantic: bool) -> str:
        tag, *names = _PARTS[name]
        plain = tag in ("div", "section") or not semantic or name == "form" and r.random() < 0.3
        attr = f' {r.choice(["class", "class", "id"])}="{r.choice(names)}"' if plain or r.random() < 0.4 else ""
        tag = r.choice(["div", "section", "div"]) if not semantic and tag != "form" else tag
        return f'<{tag}{attr} data-label="0">{inside[name]()}</{tag}>'

    def block(named: bool) -> str:
        kind = r.random()
        if kind < 0.68:
            return f"<p>{prose().replace(' ', ' <b>', 1) + '</b>' if r.random() < 0.15 else prose()}</p>"
        if kind < 0.78:
            return f"<h2>{say(2, 6)}</h2>"
        if kind < 0.88:
            return "<ul>" + "".join(f"<li>{say(4, 14)}.</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        if kind < 0.92 and named:  # references: in an article a list of links that nothing names a menu is content
            return r.choice([links(), f'<ol><li><a href="/{word()}">{say(1, 4)}</a></li><li><a href="/{word()}">{say(1, 4)}</a></li></ol>', f'<p><a href="/{word()}">{say(1, 5)}</a></p>'])
        if kind < 0.95:
            return f"<blockquote><p>{prose()}</p></blockquote>"
        return f"<table><tr><td>{say(1, 4)}</td><td>{say(1, 4)}</td></tr></table>"

    out = []
    for _ in range(many):
        semantic = r.random() < 0.5
        names = r.sample([*_PARTS], r.randint(2, 7))
        before = [n for n in names if n in ("nav", "header", "notice", "ad")]
        inner = [n for n in names if n in ("ad", "share", "aside") and r.random() < 0.3]
        after = [n for n in names if n not in before]
        tag, attr = r.choice([("article", ""), ("main", ""), ("div", ' class="content"'), ("div", ' id="main"'), ("div", ' class="post-body"'), ("div", ' class="entry"'), ("section", ""), ("div", ""), ("td", "")])
        body = [block(bool(attr) or tag in _ON) for _ in range(r.randint(1, 9))]
        body.insert(0, f"<h1>{say(3, 9)}</h1>")
        for n in inner:
            body.insert(r.randint(1, len(body)), part(n, semantic))
        core = f'<{tag}{attr} data-label="1">{"".join(body)}</{tag}>'
        core = f"<table><tr>{core}</tr></table>" if tag == "td" else core
        if r.random() < 0.4:
            core = f'<div{r.choice(["", " class=wrapper", " id=page", " class=container"])}>{core}{"".join(part(n, semantic) for n in after)}</div>'
            after = []
        out.append(f"<html><head><title>{say(3, 8)}</title><style>x{{}}</style></head><body>{''.join(part(n, semantic) for n in before)}{core}{''.join(part(n, semantic) for n in after)}</body></html>")
    return out


def _silver(html: str) -> Tree | None:
    """A page that its own one article or main element labels, but for parts in it that are boilerplate by their element or
    by their class, id or role; None for others."""
    found = re.findall(r"<(article|main)\b", html)
    if len(found) != 1:
        return None
    tree = Tree().read(re.sub(r"<(article|main)\b", r'<\1 data-label="1"', html, count=1))
    for i, (kind, bad, good) in enumerate(zip(tree.kind, tree.bad, tree.good, strict=True)):
        if tree.label[i] is None and (kind == 0 or bad and not good):
            tree.label[i] = False
    return tree


def fit(pages: DataFrame, sample: int = 200) -> Model:
    """Train on at most ``sample`` of the pages, by hash, and on layouts(). Only the hashes are ordered; whole pages come to the
    driver for the chosen ones alone."""
    hashed = pages.where("html is not null").select(F.xxhash64("page_id", "html").alias("h"), "html")
    chosen = [r["h"] for r in hashed.select("h").orderBy("h").limit(sample).collect()]
    rows = hashed.where(F.col("h") <= F.lit(chosen[-1])).limit(sample).collect() if chosen else []
    silver = [t for t in (_silver(r["html"]) for r in rows) if t is not None]
    return train(silver + [Tree().read(h) for h in layouts()])


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """The pages with ``text``, their main text."""
    pages = pages.drop("text")
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            htmls = batch.column(batch.schema.names.index("html")).to_pylist()
            yield with_column(batch, "text", pa.array([model.extract(h) if h else "" for h in htmls], pa.string()))

    return pages.mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField("text", T.StringType())]))
