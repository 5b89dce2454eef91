"""Invented page layouts for the block labeller to learn from.

A layout is a tree of containers with labelled blocks.  Most containers have invented names, the
others customary ones; menus, notices, sidebars, adverts, forms, reader comments and footers stand
around an article, which has headings, lists and quotes of its own.  So the labeller has to judge
by place, length, links and repetition, and by names only where they are customary.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from random import Random

import numpy as np

#: Names that page parts customarily have; the content's aren't among the labeller's own.
CUSTOMARY = {
    "content": ("article", "content", "post", "entry", "story", "main", "text", "body", "prose", "page"),
    "menu": ("menu", "nav", "navbar", "navigation", "topnav", "links"), "head": ("header", "masthead", "top", "banner", "brand", "logo"),
    "notice": ("cookie", "notice", "consent", "alert", "banner", "popup"), "crumbs": ("breadcrumb", "breadcrumbs", "path", "trail"),
    "search": ("search", "login", "form", "signup"), "side": ("sidebar", "side", "aside", "widget", "rail", "column"),
    "ad": ("ad", "ads", "advert", "sponsored", "promo", "sponsor"), "related": ("related", "more", "recommended", "next", "tags"),
    "share": ("share", "social", "sharing", "toolbar"), "news": ("newsletter", "subscribe", "signup"),
    "comments": ("comments", "discussion", "responses", "replies", "thread", "feedback"), "comment": ("comment", "reply", "response", "message"),
    "foot": ("footer", "bottom", "colophon", "copyright", "legal", "imprint"),
}
#: Tags of page parts; the more frequent ones more than once.
TAGS = {
    "content": ("div", "div", "div", "div", "article", "main", "section", "td"), "menu": ("nav", "div", "div", "ul"), "head": ("header", "div", "div"), "notice": ("div", "div", "section", "aside", "dialog"),
    "crumbs": ("div", "nav", "ol", "p"), "search": ("form", "form", "div"), "side": ("aside", "div", "div", "section", "td"), "ad": ("div", "div", "aside", "section"), "related": ("div", "aside", "section", "ul"),
    "share": ("div", "ul"), "news": ("form", "div", "section"), "comments": ("section", "div", "div", "ol", "ul"), "comment": ("div", "li", "article", "div"), "foot": ("footer", "div", "div"),
}
SYLLABLES = ("ba", "ko", "ri", "tu", "ne", "mo", "sa", "ple", "gra", "do", "vi", "xe", "lu", "fa", "ster", "in", "ol", "qua", "ze", "wy")

Texts = Callable[[Sequence[str]], np.ndarray]


class Layout:
    """Containers and labelled blocks under way; has what a page has, with measures in place of texts."""

    def __init__(self, rng: Random, measured: Texts, words: Sequence[str]):
        self.rng, self.measure, self.words = rng, measured, words
        self.parents: list[int] = []
        self.names: list[tuple[str, ...]] = []
        self.at: list[int] = []
        self.links: list[float] = []
        #: Of each block: its text, or its measures.
        self.given: list[str | np.ndarray] = []
        self.labels: list[float] = []

    def open(self, parent: int, *names: str) -> int:
        self.parents.append(parent)
        self.names.append(names)
        return len(self.names) - 1

    def part(self, parent: int, kind: str, tag: str | None = None) -> int:
        """A container of a kind, with a customary name, an invented one, or none."""
        r, prefix = self.rng.random(), self.rng.choice(("#", ".", "."))
        invented = lambda: prefix + "".join(self.rng.choice(SYLLABLES) for _ in range(self.rng.randint(1, 4)))
        own = (prefix + self.rng.choice(CUSTOMARY[kind]),) if r < 0.3 else tuple(invented() for _ in range(self.rng.choice((1, 1, 2)))) if r < 0.85 else ()
        return self.open(parent, tag or self.rng.choice(TAGS[kind]), *own)

    def text(self, least: int, most: int, stops: float = 0.0) -> str:
        n = round(least * (most / least) ** self.rng.random())
        return " ".join(self.rng.choice(self.words) + (self.rng.choice(".,.,:!?") if self.rng.random() < stops else "") for _ in range(n))

    def put(self, at: int, text: str | np.ndarray, label: int = 0, link: float = 0.0) -> None:
        self.at.append(at)
        self.given.append(text)
        self.links.append(link)
        self.labels.append(label)

    def measures(self) -> np.ndarray:
        """The measures of all blocks."""
        texts = iter(self.measure([x for x in self.given if isinstance(x, str)]))
        return np.stack([next(texts) if isinstance(x, str) else x for x in self.given])

    def links_in(self, at: int, n: int, most: int = 4, tag: str = "li") -> None:
        """A list of links."""
        if tag == "li" and self.names[at][0] not in ("ul", "ol"):
            at = self.open(at, self.rng.choice(("ul", "ul", "ol")))
        for _ in range(n):
            self.put(self.open(at, tag), self.text(1, most), link=self.rng.choice((1.0, 1.0, 1.0, 0.8)))

    def maybe(self, share: float) -> bool:
        return self.rng.random() < share

    # --- parts of a page ---

    def menu(self, up: int) -> None:
        at = self.part(up, "menu")
        if self.maybe(0.7):
            self.links_in(at, self.rng.randint(2, 12))
        elif self.maybe(0.5):
            self.links_in(at, self.rng.randint(2, 8), tag="div")
        else:
            self.put(at, self.text(3, 12), link=self.rng.uniform(0.6, 1.0))

    def head(self, up: int) -> None:
        at = self.part(up, "head")
        self.put(self.open(at, self.rng.choice(("h1", "h2", "div", "p"))), self.text(1, 5), link=self.rng.choice((0.0, 1.0)))
        if self.maybe(0.4):
            self.put(self.open(at, self.rng.choice(("p", "div"))), self.text(2, 12, 0.1))

    def notice(self, up: int) -> None:
        at = self.part(up, "notice")
        self.put(self.open(at, "p") if self.maybe(0.6) else at, self.text(4, 40, 0.1), link=self.rng.choice((0.0, 0.0, 0.2)))
        if self.maybe(0.4):
            self.put(self.open(at, "button"), self.text(1, 2))

    def crumbs(self, up: int) -> None:
        at = self.part(up, "crumbs")
        if self.names[at][0] == "ol" or self.maybe(0.3):
            self.links_in(at, self.rng.randint(2, 4), 2)
        else:
            self.put(at, self.text(2, 9), link=self.rng.uniform(0.2, 0.9))

    def search(self, up: int) -> None:
        at = self.part(up, "search")
        for _ in range(self.rng.randint(1, 3)):
            self.put(self.open(at, self.rng.choice(("label", "button", "div", "p"))), self.text(1, 6))

    def side(self, up: int) -> None:
        at = self.part(up, "side")
        for _ in range(self.rng.randint(1, 3)):
            own = self.part(at, "side", "div") if self.maybe(0.5) else at
            if self.maybe(0.7):
                self.put(self.open(own, self.rng.choice(("h2", "h3", "h4"))), self.text(1, 4))
            if self.maybe(0.5):
                self.links_in(own, self.rng.randint(2, 8), 9)
            else:
                for _ in range(self.rng.randint(1, 4)):
                    self.put(self.open(own, self.rng.choice(("p", "p", "div"))), self.text(3, 45, 0.12), link=self.rng.choice((0.0, 0.0, 0.3)))

    def ad(self, up: int) -> None:
        at = self.part(up, "ad")
        for _ in range(self.rng.choice((1, 1, 1, 2))):
            self.put(at if self.maybe(0.5) else self.open(at, "p"), self.text(2, 25, 0.1), link=self.rng.choice((0.0, 0.0, 1.0)))

    def related(self, up: int) -> None:
        at = self.part(up, "related")
        if self.maybe(0.7) and self.names[at][0] != "ul":
            self.put(self.open(at, self.rng.choice(("h2", "h3", "p"))), self.text(1, 4))
        if self.names[at][0] == "ul" or self.maybe(0.6):
            self.links_in(at, self.rng.randint(1, 6), 10)
        else:
            for _ in range(self.rng.randint(1, 4)):
                own = self.part(at, "related", "div")
                self.put(self.open(own, self.rng.choice(("h3", "h4"))), self.text(2, 10), link=1.0)
                self.put(self.open(own, "p"), self.text(6, 30, 0.12))

    def share(self, up: int) -> None:
        at = self.part(up, "share")
        self.links_in(at, self.rng.randint(2, 5), 2, "li" if self.names[at][0] == "ul" else self.rng.choice(("li", "div")))

    def news(self, up: int) -> None:
        at = self.part(up, "news")
        self.put(self.open(at, self.rng.choice(("p", "h3", "label"))), self.text(3, 20, 0.1))
        if self.maybe(0.6):
            self.put(self.open(at, self.rng.choice(("button", "label"))), self.text(1, 2))

    def comments(self, up: int) -> None:
        at = self.part(up, "comments")
        listed, plain = self.names[at][0] in ("ol", "ul"), self.maybe(0.3)
        if self.maybe(0.6) and not listed:
            self.put(self.open(at, self.rng.choice(("h2", "h3", "p", "div"))), self.text(1, 4))
        if not listed and self.maybe(0.4):
            at, listed = self.open(at, self.rng.choice(("ul", "ol"))), True
        shape, own_tag = self.part(-1, "comment", "li" if listed else self.rng.choice(TAGS["comment"])), self.rng.choice(("p", "p", "div"))
        own_names, signed = self.names[shape], self.rng.choice(("p", "div", "span", ""))
        for _ in range(self.rng.choice((1, 2, 2, 3, 4, 6, 9))):
            own = at if plain and not listed else self.open(at, *own_names)
            if signed and not plain:
                self.put(own if signed == "span" else self.open(own, signed), self.text(1, 6), link=self.rng.choice((0.0, 0.0, 0.5)))
            for _ in range(self.rng.choice((1, 1, 1, 2))):
                self.put(own if listed and plain else self.open(own, own_tag), self.text(3, 70, 0.13))
            if not plain and self.maybe(0.3):
                self.put(self.open(own, self.rng.choice(("p", "div", "button"))), self.text(1, 2), link=1.0)
        if self.maybe(0.3):
            self.search(at)

    def foot(self, up: int) -> None:
        at = self.part(up, "foot")
        if self.maybe(0.35):
            self.links_in(at, self.rng.randint(2, 8), 3)
        for _ in range(self.rng.choice((1, 1, 2))):
            self.put(at if self.maybe(0.5) else self.open(at, self.rng.choice(("p", "div"))), self.text(2, 25, 0.08), link=self.rng.choice((0.0, 0.0, 0.3)))

    def invented_body(self) -> list[tuple[str, str]]:
        """(tag, text) of an article's blocks."""
        made = [(self.rng.choice(("h1", "h1", "h2")), self.text(2, 14))] if self.maybe(0.8) else []
        long = self.rng.choice((25, 60, 60, 120))
        for _ in range(round(1 * 24**self.rng.random())):
            made.append(("p", self.text(max(3, long // 8), 2 * long, 0.12)))
        return made

    def data(self, own: int) -> None:
        """A table, a list of terms, a figure, or a list of links that belong to the article."""
        kind = self.rng.choice(("table", "table", "table", "terms", "figure", "links"))
        if kind == "table":
            table = self.open(own, "table")
            if self.maybe(0.3):
                self.put(self.open(table, "caption"), self.text(2, 12), 1)
            inner = self.open(table, "tbody") if self.maybe(0.4) else table
            columns, longest, para = self.rng.randint(2, 5), self.rng.choice((2, 4, 12)), self.maybe(0.1)
            for k in range(self.rng.randint(2, 9)):
                row = self.open(inner, "tr")
                for _ in range(columns):
                    cell = self.open(row, "th" if k == 0 and longest < 12 else "td")
                    text = str(self.rng.randint(0, 99_999)) if self.maybe(0.3) else self.text(1, longest)
                    self.put(self.open(cell, "p") if para else cell, text, 1, self.rng.choice((0.0, 0.0, 0.0, 0.0, 1.0)))
        elif kind == "terms":
            listed = self.open(own, "dl")
            for _ in range(self.rng.randint(2, 6)):
                self.put(self.open(listed, "dt"), self.text(1, 4), 1)
                self.put(self.open(listed, "dd"), self.text(2, 30, 0.1), 1)
        elif kind == "figure":
            self.put(self.open(self.open(own, "figure"), "figcaption"), self.text(3, 25, 0.08), 1)
        else:
            listed = self.open(own, self.rng.choice(("ul", "ol")))
            for _ in range(self.rng.randint(2, 6)):
                self.put(self.open(listed, "li"), self.text(1, 9), 1, 1.0)

    def article(self, up: int, body: Sequence[tuple[str, str | np.ndarray]]) -> None:
        """The article's blocks, with lists, quotes and subheads among them, and strange parts put in."""
        at = self.part(up, "content")
        for _ in range(self.rng.choice((0, 0, 0, 1, 2))):
            at = self.part(at, "content", "div")
        style = self.rng.choice(("p", "p", "p", "p", "div", "sections"))
        own, strange = at, self.rng.choice((0, 0.05, 0.12, 0.2))
        for k, (tag, text) in enumerate(body):
            if tag[0] == "h" and k == 0 and self.maybe(0.2):
                self.put(self.open(self.open(at, "header"), tag), text, 1)
                continue
            if style == "sections" and k and k % 4 == 0:
                own = self.part(at, "content", self.rng.choice(("section", "div")))
            if k and self.maybe(0.08):
                self.put(self.open(own, self.rng.choice(("h2", "h3"))), self.text(1, 8), 1)
            self.put(self.open(own, "div" if style == "div" and tag == "p" else tag), text, 1, self.rng.choice((0.0, 0.0, 0.0, 0.05, 0.2)))
            if self.maybe(0.12):
                listed = self.open(own, self.rng.choice(("ul", "ul", "ol")))
                for _ in range(self.rng.randint(2, 7)):
                    item, shown = self.open(listed, "li"), self.maybe(0.2)
                    self.put(self.open(item, "p") if shown else item, self.text(1, 30, 0.1), 1, self.rng.choice((0.0, 0.0, 0.0, 0.3, 1.0)))
            elif self.maybe(0.06):
                quote = self.open(own, self.rng.choice(("blockquote", "pre", "figcaption")))
                self.put(self.open(quote, "p") if self.names[quote][0] == "blockquote" and self.maybe(0.6) else quote, self.text(4, 40, 0.1), 1)
            elif self.maybe(0.05):
                self.data(own)
            if self.rng.random() < strange:
                self.rng.choice((self.ad, self.ad, self.related, self.share, self.news))(own)
        if self.maybe(0.15):
            self.rng.choice((self.comments, self.comments, self.related, self.share, self.news))(at)


def layout(rng: Random, measured: Texts, words: Sequence[str], body: Sequence[tuple[str, np.ndarray]] | None = None) -> Layout:
    """A page around ``body`` ((tag, measures) of an article's blocks), or around an invented article."""
    made = Layout(rng, measured, words)
    own = made.invented_body() if body is None else body
    up = made.open(made.open(-1, "html"), "body")
    for _ in range(rng.choice((0, 0, 1, 1, 2))):
        up = made.part(up, "content", "div")
    some = lambda *parts: [p for p, share in parts if rng.random() < share]
    before = some((made.notice, 0.25), (made.head, 0.5), (made.menu, 0.6), (made.search, 0.25), (made.crumbs, 0.3), (made.ad, 0.2), (made.side, 0.15))
    after = some((made.share, 0.15), (made.related, 0.25), (made.comments, 0.55), (made.side, 0.25), (made.news, 0.15), (made.ad, 0.1), (made.foot, 0.75), (made.notice, 0.15))
    if rng.random() < 0.2:
        rng.shuffle(before)
    if rng.random() < 0.2:
        rng.shuffle(after)
    for p in before:
        p(up)
    inner = made.part(up, "content", "div") if rng.random() < 0.3 else up
    made.article(inner, own)
    for p in after:
        p(inner if rng.random() < 0.2 else up)
    return made
