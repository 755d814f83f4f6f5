"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A tolerant parser cuts a page into leaf blocks, each with the tags, classes, ids and roles of
its ancestors. A two-label chain (content or not) is trained on labelled pages that a seeded
generator writes in many layouts, and a page is decoded by Viterbi. Nothing is capped: every
block of the whole page is judged and every content block is returned whole.

Pages are rows of their own: one scan, no shuffle, a model of a few thousand weights.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.llm.words import arrow_rows
from siftwork.session import SMALL_BATCHES, own_session, table

#: Fixed values of HTML: elements without content, without markup inside, left out where they are closed, that don't break a line, and that close each other.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
APART = frozenset("svg template iframe select".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img object canvas noscript"
    " math mi mn mo ms mtext mspace mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mpadded semantics annotation".split()
)
CLOSES = {
    "li": ("li", ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": ("option", ("select",)),
}
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'<]++|\"[^\"<]*+\"|'[^'<]*+')*+)>|<[!?/][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>?|[^<]++|<",
    re.S,
)
_ATTR = re.compile(r"\b(class|id|role|data-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME = re.compile(r"[a-z]+")
_PLAIN = frozenset(("html", "body", "div", "p"))  # elements that tell nothing
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW}
_APART = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({'|'.join(sorted(RAW))})(?=[\s/>])[^>]*>.*?(?:</\1(?=[\s/>])|\Z)|<(/?)({'|'.join(sorted(APART))})(?=[\s/>])[^>]*>", re.S | re.I
)


@dataclass
class Block:
    """A leaf block: its text, the features of the open elements above it, and how much of it is link text."""

    text: str
    above: tuple
    linked: int
    label: int | None = None


@dataclass
class _Open:
    tag: str
    features: list
    label: int | None = None


@dataclass
class _Page:
    """The open elements. Each tag's places and each feature's count are kept, so that no step walks down the stack."""

    known: frozenset | None = None
    labelled: bool = False
    stack: list = field(default_factory=list)
    places: dict = field(default_factory=dict)
    active: dict = field(default_factory=dict)
    solid: list = field(default_factory=list)
    blocks: list = field(default_factory=list)
    parts: list = field(default_factory=list)
    now: tuple | None = None
    above: tuple | None = None
    label: int | None = None
    linked: int = 0
    links: int = 0

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append(Block(text, self.above or (), min(self.linked, len(text)), self.label))
            self.parts, self.above, self.linked, self.label = [], None, 0, None

    def add(self, raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        if self.above is None and text.strip():
            if self.now is None:
                own = (f"own={self.stack[-1].tag if self.stack else ''}", f"leaf={self.solid[-1] if self.solid else ''}")
                self.now = (*own, *self.active)
            self.above = self.now
            if self.labelled:
                self.label = next((o.label for o in reversed(self.stack) if o.label is not None), None)
        self.parts.append(text)
        if self.links:
            self.linked += len(text.strip())

    def push(self, tag: str, names: str, label: int | None) -> None:
        own = {f"name={n}" for n in _NAME.findall(names)} if names else set()
        if tag not in INLINE:
            self.solid.append(tag)
            if tag not in _PLAIN:
                own.add(f"in={tag}")
        features = sorted(f for f in own if self.known is None or f in self.known)
        for f in features:
            self.active[f] = self.active.get(f, 0) + 1
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append(_Open(tag, features, label))
        self.links += tag == "a"
        self.now = None

    def pop_to(self, at: int) -> None:
        for o in reversed(self.stack[at:]):
            self.places[o.tag].pop()
            self.links -= o.tag == "a"
            if o.tag not in INLINE:
                self.solid.pop()
            for f in o.features:
                if self.active[f] == 1:
                    del self.active[f]
                else:
                    self.active[f] -= 1
        del self.stack[at:]
        self.now = None

    def innermost(self, tags) -> int:
        """Place of the innermost open element among tags; -1 for none."""
        return max((own[-1] for t in tags if (own := self.places.get(t))), default=-1)

    def close(self, tags, until=()) -> None:
        """Close the innermost open element among tags, unless one of until is nearer."""
        at = self.innermost(tags)
        if at >= 0 and at >= self.innermost(until):
            self.pop_to(at)


def _ends_apart(page: str) -> dict[int, int]:
    """Where each element of APART ends, by where it starts. One that is never closed is not among them."""
    out, started = {}, {t: [] for t in APART}
    for m in _APART.finditer(page):
        if m[3]:
            own = started[m[3].lower()]
            if not m[2]:
                if not m[0].endswith("/>"):
                    own.append(m.start())
            elif own:
                out[own.pop()] = m.end()
    return out


def leaf_blocks(page: str, labelled: bool = True, known: frozenset | None = None) -> list[Block]:
    """The page's text in leaf blocks, in page order. Scripts, styles and comments are left out.

    So are closed elements of APART; where one is not closed, what follows it is parsed like the rest.

    labelled: data-label is read, as training pages carry it; on any other page it means nothing.
    known: features of elements to note; all of them if None.
    """
    state, at, n, apart = _Page(known, labelled), 0, len(page), None
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            if page[m.start()] != "<" or m.end() - m.start() == 1:
                state.add(m[0])
            continue
        tag, ending, attrs = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag not in INLINE:
            state.flush()
        if ending:
            state.close((tag,))
            continue
        if tag in RAW:
            if not attrs.rstrip().endswith("/"):
                end = _RAW_END[tag].search(page, at)
                at = end.end() if end else n
            continue
        if tag in APART:
            apart = _ends_apart(page) if apart is None else apart
            at = apart.get(m.start(), at)
            continue
        if tag in ENDS_P:
            state.close(("p",), ("table", "td", "th", "button", "caption", "object"))
        if tag in CLOSES:
            state.close(*[(x,) if isinstance(x, str) else x for x in CLOSES[tag]])
        if tag in VOID:
            continue
        names, label = "", None
        if "=" in attrs:
            for name, *value in _ATTR.findall(attrs):
                value = "".join(value)
                if name.lower() == "data-label":
                    label = int(value) if labelled else None
                else:
                    names += " " + value.lower()
        state.push(tag, names, label)
    state.flush()
    return state.blocks


def _bucket(x: float, edges: tuple) -> int:
    return sum(x >= e for e in edges)


def text_features(block: Block) -> list[str]:
    """Features of a block's own text. Where it stands tells nothing that its elements and neighbours don't."""
    text = block.text
    words = text.count(" ") + 1
    return [
        f"words={_bucket(words, (2, 4, 8, 16, 32, 64))}",
        f"link={_bucket(block.linked / len(text), (0.01, 0.3, 0.7, 0.95))}",
        f"end={text[-1] if text[-1] in '.!?:;,' else 'x'}",
        f"commas={_bucket(text.count(',') / words, (0.01, 0.1))}",
        f"copyright={'©' in text}",
    ]


@dataclass
class Chain:
    """Weights of content against not content for each feature, and of the steps between labels."""

    weights: dict
    steps: np.ndarray

    def __post_init__(self) -> None:
        self.known = frozenset(f for f in self.weights if f.startswith(("in=", "name=")))

    def score(self, blocks: list[Block]) -> list[float]:
        get = self.weights.get
        return [sum(get(f, 0.0) for f in b.above) + sum(get(f, 0.0) for f in text_features(b)) for b in blocks]

    def decode(self, blocks: list[Block]) -> list[int]:
        """The most probable labels, by Viterbi."""
        (s00, s01), (s10, s11) = self.steps.tolist()
        a, b, back = 0.0, 0.0, []
        for i, e in enumerate(self.score(blocks)):
            if i:
                to0, to1 = (0 if a + s00 >= b + s10 else 1), (0 if a + s01 > b + s11 else 1)
                a, b = max(a + s00, b + s10), max(a + s01, b + s11)
                back.append((to0, to1))
            b += e
        out = [int(b > a)]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]


def train(pages: list[list[Block]], rounds: int = 200, rate: float = 0.1, decay: float = 1e-3) -> Chain:
    """Maximum conditional likelihood by Adam, with exact gradients from forward and backward sums."""
    index: dict[str, int] = {}
    rows, cols, longest = [], [], max(len(p) for p in pages)
    gold = np.full((len(pages), longest), -1)
    for r, blocks in enumerate(pages):
        for t, b in enumerate(blocks):
            gold[r, t] = b.label or 0
            for f in (*b.above, *text_features(b)):
                rows.append(r * longest + t)
                cols.append(index.setdefault(f, len(index)))
    rows, cols = np.array(rows), np.array(cols)
    real = gold >= 0
    w, first, second = np.zeros(len(index) + 4), np.zeros(len(index) + 4), np.zeros(len(index) + 4)
    total = real.sum()
    for k in range(1, rounds + 1):
        emit = np.bincount(rows, w[cols], len(pages) * longest).reshape(len(pages), longest)
        steps = w[-4:].reshape(2, 2)
        e = np.stack((np.zeros_like(emit), emit), 2)
        ahead, behind = np.zeros_like(e), np.zeros_like(e)
        ahead[:, 0] = e[:, 0]
        for t in range(1, longest):
            new = np.logaddexp(ahead[:, t - 1, :1] + steps[0], ahead[:, t - 1, 1:] + steps[1]) + e[:, t]
            ahead[:, t] = np.where(real[:, t, None], new, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            nxt = e[:, t + 1] + behind[:, t + 1]
            new = np.logaddexp(steps[:, 0] + nxt[:, :1], steps[:, 1] + nxt[:, 1:])
            behind[:, t] = np.where(real[:, t + 1, None], new, 0)
        norm = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        one = np.exp(ahead[:, :, 1] + behind[:, :, 1] - norm[:, None]) * real
        error = ((gold == 1) - one) * real
        grad = np.zeros_like(w)
        grad[:-4] = np.bincount(cols, error.ravel()[rows], len(index))
        pair = real[:, 1:] & real[:, :-1]
        for i in range(2):
            for j in range(2):
                p = np.exp(ahead[:, :-1, i] + steps[i, j] + e[:, 1:, j] + behind[:, 1:, j] - norm[:, None]) * pair
                grad[len(index) + 2 * i + j] = ((gold[:, :-1] == i) & (gold[:, 1:] == j) & pair).sum() - p.sum()
        grad = grad / total - decay * w / 10
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
        w += rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
    return Chain({f: float(w[i]) for f, i in index.items()}, w[-4:].reshape(2, 2).copy())


_SYLLABLES = "an ber ch con de den er est fa ga ha in ker la men no or pe qui ra se tion ur ver wo ya zu".split()


class _Writer:
    """Writes labelled pages: data-label on an element holds for the blocks below it."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.marked = 0.85  # how often a name is written; always inside of content, where nothing else tells

    def word(self) -> str:
        return "".join(self.r.choices(_SYLLABLES, k=self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentence(self) -> str:
        text = self.words(1, 18).capitalize()
        return (text.replace(" ", ", ", 1) if self.r.random() < 0.4 else text) + self.r.choice(".....?!")

    def prose(self, low: int, high: int) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(low, high)))

    def el(self, tag: str, body: str, names: str = "", label: int | None = None) -> str:
        kind = self.r.choice(("class", "class", "id"))
        mark = f' {kind}="{names}"' if names and self.r.random() < self.marked else ""
        return f"<{tag}{mark}" + (f' data-label="{label}"' if label is not None else "") + f">{body}</{tag}>"

    def links(self, low: int, high: int) -> str:
        items = [f'<a href="/{self.word()}">{self.words(1, 4)}</a>' for _ in range(self.r.randint(low, high))]
        return self.el("ul", "".join(f"<li>{i}</li>" for i in items)) if self.r.random() < 0.7 else self.r.choice((" | ", " ", "<br>")).join(items)

    def pick(self, text: str) -> str:
        return self.r.choice(text.split())

    def menu(self) -> str:
        tag, names = self.r.choice((("nav", ""), ("nav", self.pick("menu nav navbar")), ("div", self.pick("menu nav navbar navigation topnav breadcrumb breadcrumbs main-menu nav-links"))))
        return self.el(tag, self.links(3, 8), names, 0)

    def header(self) -> str:
        body = self.el(self.pick("div p span h2 h1"), self.words(1, 5)) + (self.menu() if self.r.random() < 0.4 else "") + (f"<p>{self.sentence()}</p>" if self.r.random() < 0.5 else "")
        tag, names = self.r.choice((("header", ""), ("header", "site-header"), ("div", self.pick("header site-header masthead banner logo top topbar branding"))))
        return self.el(tag, body, names, 0)

    def footer(self) -> str:
        body = self.r.choice((f"&copy; {self.word()}.example &middot; {self.prose(1, 3)}", f"<p>{self.prose(1, 3)}</p>{self.links(2, 5)}", f"<p>Copyright {self.words(1, 4)}</p>", self.prose(1, 2)))
        tag, names = self.r.choice((("footer", ""), ("footer", "site-footer"), ("div", self.pick("footer site-footer copyright legal bottom colophon"))))
        return self.el(tag, body, names, 0)

    def aside(self) -> str:
        body = f"<{self.pick('h2 h3 h4')}>{self.words(1, 3)}</h3>" + self.r.choice((self.links(3, 7), f"<p>{self.prose(1, 4)}</p>", f"<p>{self.prose(1, 2)}</p>" + self.links(2, 4)))
        tag, names = self.r.choice((("aside", ""), ("aside", self.pick("sidebar related widget")), ("div", self.pick("sidebar side widget related rail recommended popular trending teaser more-stories author-bio"))))
        return self.el(tag, body, names, 0)

    def advert(self) -> str:
        body = self.r.choice((self.prose(1, 3), f"<p>{self.prose(1, 3)}</p>", f'<a href="/{self.word()}">{self.prose(1, 2)}</a>', f"<p>{self.words(2, 8)}</p>" + self.links(1, 3)))
        return self.el(self.pick("div div div aside section ins p"), body, self.pick("ad ad ads advert advertisement adbox sponsored sponsor promo promotion banner-ad ad-slot ad-banner"), 0)

    def notice(self) -> str:
        body = self.r.choice((f"<p>{self.prose(1, 3)}</p>", self.prose(1, 2), f"<p>{self.prose(1, 2)}</p><button>{self.words(1, 2)}</button>"))
        return self.el(self.pick("div div section aside p dialog"), body, self.pick("notice cookie cookies cookie-notice consent gdpr alert warning popup modal overlay banner message disclaimer paywall subscribe-notice toast"), 0)

    def form(self) -> str:
        body = f"<{self.pick('p label h3')}>{self.words(1, 8)}</label><input type=text><button>{self.words(1, 2)}</button>" + (f"<p>{self.prose(1, 2)}</p>" if self.r.random() < 0.5 else "")
        form = self.el("form", body, self.pick("search login newsletter subscribe signup contact"), 0)
        return form if self.r.random() < 0.7 else self.el("div", form, self.pick("newsletter subscribe signup search-box"), 0)

    def comments(self) -> str:
        one = lambda: self.el(self.pick("div li article p"), f"<b>{self.word()}</b> {self.prose(1, 3)}" if self.r.random() < 0.5 else f"<p>{self.words(1, 2)}</p><p>{self.prose(1, 4)}</p>", self.pick("comment comment comment-body reply"))
        body = f"<h3>{self.words(1, 3)}</h3>" + "".join(one() for _ in range(self.r.randint(1, 5)))
        return self.el(self.pick("div section section ol ul aside"), body, self.pick("comments comments comment-list discussion responses comment-section disqus replies reader-comments"), 0)

    def share(self) -> str:
        return self.el(self.pick("div ul p"), self.links(2, 5), self.pick("share social sharing tags tag-list byline meta post-meta pagination pager"), 0)

    def block(self) -> str:
        kind = self.r.random()
        if kind < 0.66:
            body = self.prose(1, 6) if self.r.random() < 0.8 else self.words(1, 3).capitalize() + "."
            if self.r.random() < 0.2:  # rows, shouting and noise are content too
                body = self.r.choice((" | ".join(body.split()), body.upper(), body.replace(" ", "## "), " ".join(body.split()[:1] * 9)))
            if self.r.random() < 0.2:
                body = f'<a href="/x">{self.words(1, 3)}</a> ' + body
            if self.r.random() < 0.2:
                body = f"<b>{body}"
            return f"<p>{body}" + self.r.choice(("</p>", "</p>", "</p>", "", "<br>"))
        if kind < 0.76:
            return f"<{(h := self.pick('h2 h3 h4'))}>{self.words(1, 6)}</{h}>"
        if kind < 0.84:
            return "<ul>" + "".join(f"<li>{self.prose(1, 2) if self.r.random() < 0.6 else self.words(1, 5)}</li>" for _ in range(self.r.randint(2, 5))) + "</ul>"
        if kind < 0.9:
            return f"<blockquote>{self.prose(1, 3)}</blockquote>"
        if kind < 0.94:
            return f"<pre>{self.words(3, 20)}</pre>"
        if kind < 0.97:
            return f"<figure><img src=x><figcaption>{self.sentence()}</figcaption></figure>"
        return "<table>" + "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 3)}</td></tr>" for _ in range(3)) + "</table>"

    def junk(self) -> str:
        return self.r.choice((self.menu, self.aside, self.advert, self.notice, self.form, self.share, self.comments))()

    def page(self) -> str:
        inner = [f"<h1>{self.words(2, 10)}</h1>"] if self.r.random() < 0.8 else []
        for _ in range(self.r.randint(1, 10)):
            inner.append(self.block())
            if self.r.random() < 0.08:
                self.marked = 1.0
                inner.append(self.r.choice((self.advert, self.aside, self.share, self.form, self.notice))())
                self.marked = 0.85
        if self.r.random() < 0.2:
            self.marked = 1.0
            inner.append(self.comments())
            self.marked = 0.85
        tag, names = self.r.choice((("article", ""), ("article", ""), ("main", ""), ("article", "post"), ("div", self.pick("content article post entry entry-content article-body story post-content main body-text page-content")), ("section", self.pick("content article story"))))
        body = self.el(tag, "".join(inner), names, 1)
        if self.r.random() < 0.3:
            body = self.el(self.pick("main div"), body, self.pick("content main container wrapper page"))
        before = [x() for x in (self.header, self.menu, self.advert, self.notice, self.form, self.aside) if self.r.random() < 0.4]
        after = [x() for x in (self.comments, self.aside, self.advert, self.share, self.form, self.notice) if self.r.random() < 0.3]
        self.r.shuffle(before)
        self.r.shuffle(after)
        if self.r.random() < 0.85:
            after.append(self.footer())
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title></head><body>{''.join(before)}{body}{''.join(after)}</body></html>"


def labelled_pages(n: int, seed: int) -> list[str]:
    """Pages whose elements carry data-label, 1 for content and 0 for the rest."""
    writer = _Writer(seed)
    return [writer.page() for _ in range(n)]


#: Labelled pages the chain is trained on.
TRAINING_PAGES, TRAINING_SEED = 1200, 11


@lru_cache(maxsize=1)
def default_chain() -> Chain:
    return train([b for p in labelled_pages(TRAINING_PAGES, TRAINING_SEED) if (b := leaf_blocks(p))])


def main_text(page: str | None, chain: Chain) -> str:
    """Content blocks in page order, joined by one space."""
    blocks = leaf_blocks(page, labelled=False, known=chain.known) if page else []
    return " ".join(b.text for b, y in zip(blocks, chain.decode(blocks), strict=True) if y) if blocks else ""


def extract_text(pages: DataFrame, html_col: str = "html", out_col: str = "text", chain: Chain | None = None) -> DataFrame:
    """Add out_col (main text) and n_chars (its code points); input columns of these names are replaced.

    A null or empty page, and one without content, gives an empty text and 0. White space in a
    block is one space; blocks are joined by one space. One row out for each row in.
    """
    model = pages.sparkSession.sparkContext.broadcast(chain or default_chain())  # a few thousand weights

    @F.arrow_udf("string")
    def text(column: pa.Array) -> pa.Array:
        return pa.array([main_text(x.as_py(), model.value) for x in column], pa.string())

    names = {out_col, "n_chars"}
    base = pages.withColumn("__text", text(F.col(html_col)))
    return base.select(
        *[F.col(c) for c in pages.columns if c not in names], F.col("__text").alias(out_col), F.length("__text").cast("long").alias("n_chars")
    )


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_text(table(own_session(spark, **SMALL_BATCHES), sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
