"""Labelled web pages for training and testing the extractor: random layouts with the usual furniture.

Every page is a function of its seed.  Words are random syllables, so that nothing is learnt from vocabulary;
layouts vary in element names, class names, nesting, order, and in how carelessly tags are closed.
"""

from __future__ import annotations

import random

_SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe ri so tu va we xi yo zu ar en il or un ast ent ing ion".split()


class _Page:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.blocks: list[tuple[str, bool]] = []  # expected text, whether it is main text
        self.html: list[str] = []

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def words(self, lo: int, hi: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(lo, hi))).capitalize()

    def sentence(self, lo: int = 4, hi: int = 18) -> str:
        return self.words(lo, hi) + self.r.choice("....?!")

    def block(self, tag: str, text: str, main: bool, attrs: str = "", link: bool = False) -> None:
        r = self.r
        body = text
        if link:
            body = f'<a href="/{self.word()}">{body}</a>'
        elif r.random() < 0.15 and " " in text:
            a, b = text.split(" ", 1)
            body = f"<b>{a}</b> {b}" if r.random() < 0.5 else f'{a} <a href="#">{b.split(" ")[0]}</a>' + b[len(b.split(" ")[0]) :]
        if r.random() < 0.1:
            body = body.replace(" ", "\n  ", 1)
        close = "" if tag in ("p", "li") and r.random() < 0.1 else f"</{tag}>"
        self.html.append(f"<{tag}{attrs}>{body}{close}")
        self.blocks.append((text, main))

    def named(self, *names: str) -> str:
        r = self.r
        n = r.choice(names)
        form = r.choice((n, n, f"{n}-{self.word()}", f"{self.word()}-{n}", f"{self.word()} {n}", f"{n}_{self.word()}"))
        return f' {r.choice(("class", "class", "id"))}="{form}"'

    def wrap(self, tag: str, attrs: str, inside) -> None:
        self.html.append(f"<{tag}{attrs}>")
        inside()
        self.html.append(f"</{tag}>")

    def links(self, lo: int = 3, hi: int = 8) -> None:
        def items():
            for _ in range(self.r.randint(lo, hi)):
                self.block("li", self.words(1, 3), False, link=True)

        if self.r.random() < 0.8:
            self.wrap("ul", "", items)
        else:
            for _ in range(self.r.randint(2, 5)):
                self.block("div", self.words(1, 3), False, link=True)

    def maybe(self, p: float, f) -> None:
        if self.r.random() < p:
            f()

    # furniture
    def menu(self):
        r = self.r
        self.wrap(*r.choice((("nav", ""), ("nav", self.named("nav", "menu")), ("div", self.named("menu", "nav", "breadcrumb", "navbar")), ("div", ' role="navigation"'))), self.links)

    def head(self):
        def inside():
            self.block(self.r.choice(("div", "p", "h1", "span")), self.words(1, 4), False, self.named("logo", "brand", "tagline") if self.r.random() < 0.5 else "", link=self.r.random() < 0.5)
            self.maybe(0.5, self.menu)

        self.wrap(*self.r.choice((("header", ""), ("header", self.named("header", "masthead")), ("div", self.named("header", "masthead", "topbar")))), inside)

    def foot(self):
        def inside():
            self.maybe(0.5, lambda: self.links(2, 5))
            text = self.r.choice((f"© {self.word()}.example {self.sentence()}", f"Copyright 2020 {self.words(1, 4)}", self.sentence(3, 10), f"{self.words(1, 2)} | {self.words(1, 2)}"))
            self.block(self.r.choice(("p", "div", "small")), text, False) if self.r.random() < 0.6 else self._loose(text, False)

        self.wrap(*self.r.choice((("footer", ""), ("footer", ""), ("footer", self.named("footer")), ("div", self.named("footer", "copyright", "legal")))), inside)

    def _loose(self, text: str, main: bool) -> None:
        self.html.append(text)
        self.blocks.append((text, main))

    def side(self):
        def inside():
            self.block(self.r.choice(("h2", "h3", "h4", "div")), self.words(1, 4), False)
            self.maybe(0.7, self.links)
            self.maybe(0.5, lambda: self.block("p", self.sentence(), False))

        self.wrap(*self.r.choice((("aside", ""), ("aside", self.named("sidebar", "related")), ("div", self.named("sidebar", "widget", "related", "recommended")))), inside)

    def advert(self):
        def inside():
            text = " ".join(self.sentence() for _ in range(self.r.randint(1, 3)))
            self.block("p", text, False) if self.r.random() < 0.5 else self._loose(text, False)

        self.wrap(*self.r.choice((("div", self.named("ad", "ads")), ("div", self.named("ad", "ads", "advert", "sponsored", "promo")), ("aside", self.named("ad", "advertisement")), ("section", self.named("promo", "sponsored")))), inside)

    def notice(self):
        def inside():
            self.block("p", " ".join(self.sentence() for _ in range(self.r.randint(1, 2))), False)
            self.maybe(0.5, lambda: self.block("button", self.words(1, 2), False))

        self.wrap(self.r.choice(("div", "section", "dialog")), self.named("cookie", "consent", "notice", "alert", "newsletter", "popup", "subscribe", "modal"), inside)

    def form(self):
        def inside():
            for _ in range(self.r.randint(1, 3)):
                self.block(self.r.choice(("label", "p", "div")), self.words(1, 5), False)
            self.maybe(0.6, lambda: self.block("button", self.words(1, 2), False))

        self.wrap("form", self.r.choice(("", self.named("search", "login", "contact"))), inside)

    def comments(self):
        def one():
            self.maybe(0.6, lambda: self.block(self.r.choice(("div", "h4", "cite")), self.words(1, 3), False, self.named("author", "meta") if self.r.random() < 0.5 else ""))
            for _ in range(self.r.randint(1, 2)):
                self.block("p", " ".join(self.sentence() for _ in range(self.r.randint(1, 3))), False)

        def inside():
            self.maybe(0.7, lambda: self.block("h3", self.words(1, 3), False))
            tag = self.r.choice(("div", "li", "article"))
            for _ in range(self.r.randint(1, 5)):
                self.wrap(tag, self.named("comment", "reply") if self.r.random() < 0.7 else "", one)

        self.wrap(self.r.choice(("div", "section", "ol")), self.named("comments", "commentlist", "discussion", "responses", "replies"), inside)

    def share(self):
        self.wrap("div", self.named("share", "social", "follow"), lambda: [self.block("div", self.words(1, 2), False, link=True) for _ in range(self.r.randint(2, 4))])

    # the article
    def article(self):
        r = self.r

        def title():
            self.block("h1", self.words(2, 10) + r.choice(("", "", ".")), True)

        def paragraph():
            self.block("p", " ".join(self.sentence() for _ in range(r.choice((1, 1, 2, 3, 5, 8)))), True)

        def section():
            self.maybe(0.8, lambda: self.block(r.choice(("h2", "h3")), self.words(1, 6), True))
            for _ in range(r.randint(1, 4)):
                paragraph()

        def part():
            x = r.random()
            if x < 0.72:
                paragraph()
            elif x < 0.78:
                self.block("p", self.sentence(1, 3), True)
            elif x < 0.84:
                self.block(r.choice(("h2", "h3")), self.words(1, 6), True)
            elif x < 0.9:
                self.wrap(r.choice(("ul", "ol")), "", lambda: [self.block("li", self.sentence(2, 12), True) for _ in range(r.randint(2, 5))])
            elif x < 0.92:
                self.wrap("section", "", section)
            elif x < 0.94:
                self.wrap("blockquote", "", paragraph)
            elif x < 0.96:
                self.block("pre", self.words(3, 10), True)
            else:
                self.wrap("table", "", lambda: [self.wrap("tr", "", lambda: [self.block("td", self.words(1, 4), True) for _ in range(r.randint(2, 3))]) for _ in range(r.randint(1, 3))])

        def inside():
            if r.random() < 0.2:
                self.wrap("header", "", title)
            else:
                self.maybe(0.9, title)
            inner = r.random() < 0.2
            if inner:
                self.html.append(f"<div{self.named('content', 'entry', 'body', 'text')}>")
            for _ in range(r.choice((1, 2, 4, 6, 10, 15))):
                part()
                self.maybe(0.06, self.advert)
                self.maybe(0.02, self.notice)
                self.maybe(0.02, self.side)
            if inner:
                self.html.append("</div>")
            self.maybe(0.12, self.share)
            self.maybe(0.12, self.comments)
            self.maybe(0.05, self.foot)

        return inside

    def build(self) -> str:
        r = self.r
        self.html.append(f'<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title><style>.{self.word()} {{ width: 9em }}</style><script>go("<{r.choice(("b", "div", "/li", "section"))}>")</script></head><body>')
        self.maybe(0.5, self.head)
        self.maybe(0.7, self.menu)
        self.maybe(0.2, self.notice)
        self.maybe(0.5, self.advert)
        self.maybe(0.15, self.form)
        self.maybe(0.2, self.side)
        shape = r.random()
        inside = self.article()
        if shape < 0.5:
            self.wrap("article", r.choice(("", self.named("post", "article", "entry"))), inside)
        elif shape < 0.65:
            self.wrap("main", "", lambda: self.wrap("article", "", inside))
        elif shape < 0.75:
            self.wrap("main", "", inside)
        elif shape < 0.95:
            self.wrap("div", self.named("content", "post", "article", "story", "entry", "main"), inside)
        else:
            self.wrap("div", "", inside)
        self.maybe(0.2, self.comments)
        self.maybe(0.3, self.side)
        self.maybe(0.2, self.advert)
        self.maybe(0.1, self.form)
        self.maybe(0.8, self.foot)
        if r.random() < 0.85:
            self.html.append("</body></html>")
        return "".join(self.html)


def labelled_page(seed: int) -> tuple[str, list[tuple[str, bool]]]:
    """(html, [(block text, whether it is main text)])."""
    p = _Page(seed)
    return p.build(), p.blocks
