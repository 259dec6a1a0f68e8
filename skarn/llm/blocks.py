"""Leaf blocks of an HTML page: the text between block-level tags, with features of its ancestors and itself.

The scanner is forgiving: unclosed, misnested and truncated mark-up gives the blocks that can be seen.
Character references are decoded, white space becomes single spaces, and the content of scripts, styles,
text fields, frames, drawings (svg), templates, comments and the head is no text.  A drawing or template
without an end ends with its parent, a drawing also at a block-level tag of its own; a head ends at the first
tag or text that belongs to the body; an unclosed style, title, text field or frame ends at the next tag, and an
unclosed script at the end of the page, as in a browser.  Elements go by their whole name: <title-bar> is no title.
"""

from __future__ import annotations

import html
import re

# HTML element names by role.
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style iframe textarea title".split())
#: Inline boxes: what stands before and behind them is not one word.
_APART = frozenset("button iframe input select textarea".split())
#: Elements whose content is no text, and what a head may hold.
_SKIP = frozenset(("svg", "template", "head"))
_IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
_TAGS = "nav header footer aside article main section form ul ol li table a h1 h2 h3 h4 h5 h6 p blockquote pre figure figcaption button label select fieldset details dialog dl div center address span".split()
# Words of class, id and role attributes, by what they tell about a block.
_WORDS = {
    "ad": "ad ads adbox adsense adunit advert adverts advertisement advertising sponsor sponsored sponsors promo promoted promotion promotions commercial dfp gpt outbrain taboola affiliate",
    "nav": "nav navbar navigation menu menubar submenu breadcrumb breadcrumbs crumbs pagination pager pages toc skip links tabs",
    "side": "sidebar side aside widget widgets related recommended recommendations rail trending popular complementary teaser teasers latest",
    "foot": "footer foot bottom copyright legal colophon contentinfo imprint credits disclaimer",
    "head": "header masthead topbar branding brand logo top hero banner tagline",
    "notice": "cookie cookies consent notice notices alert alerts popup modal gdpr subscribe subscription newsletter paywall overlay toast warning message privacy announcement",
    "comment": "comment comments commentlist reply replies discussion disqus respond responses thread reader readers feedback reviews",
    "share": "share sharing social follow twitter facebook buttons toolbar tools",
    "form": "form search searchbox login signin signup register contact input survey poll",
    "meta": "byline author meta date time timestamp tags tag category categories",
    "main": "article content post entry story main body text articlebody prose maincontent primary reading",
}
_CATEGORY = {w: c for c, words in _WORDS.items() for w in words.split()}
_TEXT = ("w<3", "w<8", "w<20", "w<50", "w>=50", "no link", "some link", "mostly link", "all link", "ends", "no end", "rights", "bars", "capitals", "heading", "first", "colon", "many digits", "bare")
_PAIRS = (("header", "article"), ("footer", "article"), ("ul", "article"), ("section", "article"), ("div", "article"), ("header", "main"), ("aside", "article"))
NAMES = [*(f"in {t}" for t in _TAGS), *(f"named {c}" for c in _WORDS), *(f"under {t}" for t in _TAGS), "hidden", *(f"{a} in {b}" for a, b in _PAIRS), "plain", "main or article", "bias", *_TEXT]
INDEX = {n: i for i, n in enumerate(NAMES)}

_NAME = re.compile(r"[a-zA-Z][^\s/<>]*")
_ATTR = re.compile(r"""[\s/]*([^\s/>=]+|=[^\s/>=]*)?(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_SPLIT = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")


def _tokens(page: str):
    """(start, end, closing, tag, attributes, self-closed) of every tag and, without a tag, of every stretch that is no text.

    One pass: what is looked for and not there is looked for once.  Quotes hold a value only behind an equals sign; a
    tag whose quotes run on to the end of the page ends at the first >, and quotes count no more from there.
    """
    at, size, quotes = 0, len(page), True
    missing: set[str] = set()
    ahead: dict[str, int] = {}  # where a mark was found last, perhaps behind another that came first

    def find(what: str, start: int) -> int:
        k = -1 if what in missing else ahead[what] if ahead.get(what, -1) >= start else page.find(what, start)
        if k < 0:
            missing.add(what)
        ahead[what] = k
        return k

    def comment_end(start: int) -> int:
        """Behind a comment: <!--> and <!---> are whole ones, and --!> ends one as --> does."""
        for whole in ("<!-->", "<!--->"):
            if page.startswith(whole, start):
                return start + len(whole)
        ends = [k + len(mark) for mark in ("-->", "--!>") if (k := find(mark, start + 4)) >= 0]
        return min(ends, default=size)

    while (lt := page.find("<", at)) >= 0:
        kind = page[lt + 1 : lt + 2]
        if kind in ("!", "?") or kind == "/" and not page[lt + 2 : lt + 3].isascii() or kind == "/" and not page[lt + 2 : lt + 3].isalpha():
            if page.startswith("<!--", lt):
                at = comment_end(lt)
            else:
                k = find(">", lt)
                at = size if k < 0 else k + 1
            yield lt, at, False, None, (), False
            continue
        closing = kind == "/"
        name = _NAME.match(page, lt + 1 + closing)
        if name is None:
            at = lt + 1  # a sign in the text
            continue
        tag, p, attrs = name[0].lower(), name.end(), []
        while quotes and p < size and page[p] != ">":
            m = _ATTR.match(page, p)
            if m.end() == p:
                p += 1
                continue
            if m[1]:
                attrs.append((m[1].lower(), next((v for v in m.groups()[1:] if v is not None), "")))
            p = m.end()
        if p >= size or not quotes:
            quotes, attrs = False, []
            p = find(">", lt)
            if p < 0:
                k = page.find("<", lt + 1)
                at = size if k < 0 else k
                yield lt, at, False, None, (), False
                continue
        at = p + 1
        bare = page[p - 1] == "/" and not (attrs and attrs[-1][1].endswith("/"))
        if closing or tag not in _RAW:
            yield lt, at, closing, tag, attrs, bare
            continue
        if not bare:
            end = None if tag in missing else re.compile(f"</{tag}(?=[\\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
            if end:
                at = end.end()
            else:
                missing.add(tag)
                k = -1 if tag == "script" else page.find("<", at)
                at = size if k < 0 else k
        yield lt, at, False, tag if tag in _APART else None, (), True


def _bits(tag: str, attrs: list[tuple[str, str]]) -> int:
    """Features that an element passes on to the blocks in it."""
    mask = 1 << INDEX[f"in {tag}"] if f"in {tag}" in INDEX else 0
    for name, value in attrs:
        if name == "hidden" or name == "style" and "display:none" in value.replace(" ", "").lower():
            mask |= 1 << INDEX["hidden"]
        elif name in ("class", "id", "role"):
            for w in _SPLIT.split(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower()):
                if w in _CATEGORY:
                    mask |= 1 << INDEX[f"named {_CATEGORY[w]}"]
    return mask


def _closes(open_tag: str, new: str) -> bool:
    """Whether a new start tag ends an open element that has no end tag yet."""
    if open_tag == "p":
        return new in _BLOCK
    return open_tag == new == "li" or open_tag in ("dt", "dd") and new in ("dt", "dd") or open_tag in ("td", "th") and new in ("td", "th", "tr") or open_tag == new == "tr" or open_tag == new == "option"


_BOUND = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "td": ("table",), "th": ("table",), "tr": ("table",), "option": ("select",)}


def leaf_blocks(page: str) -> list[tuple[str, int]]:
    """(text, feature bits) of every leaf block with text, in page order."""
    stack: list[tuple[str, int]] = [("", 0)]
    out: list[tuple[str, int]] = []
    text: list[str] = []
    linked = 0  # characters inside links
    links = 0
    skipped = 0  # open elements whose content is no text

    def flush() -> None:
        nonlocal linked
        if text:
            s = " ".join(html.unescape("".join(text)).split())
            if s:
                tag = next((t for t, _ in reversed(stack) if t in _BLOCK), "")
                out.append((s, _block_bits(s, stack[-1][1], tag, linked, not out)))
            text.clear()
        linked = 0

    def add(s: str) -> None:
        nonlocal linked
        if stack[-1][0] == "head" and s.strip():
            drop(len(stack) - 1)
        if skipped:
            return
        text.append(s)
        if links:
            linked += len(s.strip())

    def drop(k: int) -> None:
        """Ends the open elements from the k-th on."""
        nonlocal links, skipped
        links -= sum(t == "a" for t, _ in stack[k:])
        skipped -= sum(t in _SKIP for t, _ in stack[k:])
        del stack[k:]

    def leave(tag: str) -> None:
        """Ends a head or a drawing that a start tag cannot be in."""
        for k in range(len(stack) - 1, 0, -1):
            t = stack[k][0]
            if tag == "body" and t == "head" or t == "head" and tag not in _IN_HEAD or t == "svg" and tag in _BLOCK:
                drop(k)
                return
            if tag != "body" and t in ("template", "foreignobject"):
                return

    at = 0
    for start, end, closing, tag, attrs, bare in _tokens(page):
        if start > at:
            add(page[at:start])
        at = end
        if tag is None:
            continue
        if tag in _APART:
            add(" ")
        if closing:
            if tag in _BLOCK and not skipped:
                flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    ended = skipped
                    drop(k)
                    if tag in _BLOCK and ended and not skipped:
                        flush()
                    break
                if tag not in _BLOCK and tag not in _SKIP and stack[k][0] in _BLOCK:
                    break
            continue
        if skipped:
            leave(tag)
        if tag == "br":
            add(" ")
            continue
        if tag in _BLOCK:
            if not skipped:
                flush()
            for k in range(len(stack) - 1, 0, -1):
                if _closes(stack[k][0], tag):
                    drop(k)
                    break
                if stack[k][0] in _SKIP or stack[k][0] in _BLOCK and stack[k][0] not in ("p",) and not (tag in _BOUND and stack[k][0] not in _BOUND[tag]):
                    break
        if tag in _VOID:
            continue
        if not bare:
            stack.append((tag, stack[-1][1] | _bits(tag, attrs)))
            links += tag == "a"
            skipped += tag in _SKIP
    if at < len(page):
        add(page[at:])
    flush()
    return out


_ENDS = tuple(".!?…:;\"”»)")


def _block_bits(s: str, mask: int, tag: str, linked: int, first: bool) -> int:
    on = ["bias"]
    if f"under {tag}" in INDEX:
        on.append(f"under {tag}")
    has = lambda n: mask >> INDEX[n] & 1
    for a, b in _PAIRS:
        if has(f"in {a}") and has(f"in {b}"):
            on.append(f"{a} in {b}")
    if has("in article") or has("in main") or has("named main"):
        on.append("main or article")
        if not any(has(f"named {c}") for c in _WORDS if c not in ("main", "meta", "head")) and not any(has(f"in {t}") for t in ("nav", "aside", "form", "footer", "dialog")):
            on.append("plain")
    n = s.count(" ") + 1
    on.append("w<3" if n < 3 else "w<8" if n < 8 else "w<20" if n < 20 else "w<50" if n < 50 else "w>=50")
    share = linked / max(1, len(s))
    on.append("no link" if linked == 0 else "some link" if share < 0.4 else "mostly link" if share < 0.9 else "all link")
    on.append("ends" if s.endswith(_ENDS) else "no end")
    low = s.lower()
    if "©" in s or "copyright" in low or "all rights" in low:
        on.append("rights")
    if " | " in s or " · " in s or " » " in s:
        on.append("bars")
    if n > 2 and s.isupper():
        on.append("capitals")
    if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        on.append("heading")
    if first:
        on.append("first")
    if s.endswith(":"):
        on.append("colon")
    if sum(c.isdigit() for c in s[:200]) * 4 > len(s[:200]):
        on.append("many digits")
    if not mask:
        on.append("bare")
    for name in on:
        mask |= 1 << INDEX[name]
    return mask
