"""Tokens and text blocks of an HTML page."""

from __future__ import annotations

import html
import re
from functools import lru_cache
from typing import NamedTuple

import xxhash

_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

# Element names by what they do (fixed values).
RAW = frozenset("script style title textarea noscript template iframe svg annotation annotation-xml object select audio video canvas xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html body p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd div section article main blockquote pre table caption thead tbody tfoot tr td th "
    "figure figcaption hr address header footer nav aside form fieldset details summary center dialog menu hgroup search head".split()
)
#: A start tag of the key ends the open element of the value, if it is the innermost block.
ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"td", "th", "tr", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
#: Elements, and words of class, id or role, that mark what is not the article.
ASIDE_TAGS = frozenset("nav footer aside form fieldset button dialog menu search head".split())
ASIDE_WORDS = frozenset(
    "nav navbar navigation menu header masthead footer sidebar aside complementary contentinfo ad ads advert adverts advertisement advertising adsense banner promo promotion "
    "sponsor sponsored cookie cookies consent gdpr notice notices notification alert popup modal overlay subscribe subscription newsletter signup login share sharing social "
    "related recommended comment comments commentlist disqus respond replies reply breadcrumb breadcrumbs pagination pager widget widgets search copyright skip toolbar".split()
)
#: Words that a name may hold beside those and still be a name of that kind ("site-footer").
NEUTRAL_WORDS = frozenset("site page global top bottom left right primary secondary list section area box wrapper container block bar inner outer posts links form".split())
#: Marks that stay, however many words they hold.
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond replies reply".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN_WORDS = frozenset("article main content post entry story body text".split())
#: Elements that part a page.
BOXES = frozenset("html body div section article main table td th blockquote center details header footer nav aside form fieldset dialog menu search".split())

# What a token is, and what is said of the element that it starts.
TEXT, START, END = 0, 1, 2
ARTICLE, MAIN, NAMED, BOX, WHOLE, ASIDE = 4, 8, 16, 32, 64, 128

_STRICT = re.compile(r"<(/?)([a-zA-Z][\w:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][\w:-]*+)([^>]*+)>")


class Block(NamedTuple):
    at: int  # place among the tokens
    box: int  # that of the start of the innermost element that parts a page, or -1
    text: str
    aside: bool


class Page(NamedTuple):
    """Tokens by key, kind and link (of a start its end, of a text the start of its element, or
    -1), and the blocks of text."""

    keys: list[int]
    kinds: bytearray
    links: list[int]
    blocks: list[Block]


class Mark:
    """An element marked as aside: ``wraps`` if it may turn out to be the page's wrapper."""

    __slots__ = ("above", "wraps", "comments", "words", "articles", "dropped")

    def __init__(self, above: int, wraps: bool, comments: bool):
        self.above, self.wraps, self.comments, self.words, self.articles, self.dropped = above, wraps, comments, 0, 0, False


@lru_cache(maxsize=4096)
def _marks(name: str) -> bool:
    """Whether a class name, id or role as a whole names what is not the article."""
    words = {w.lower() for w in _WORD.findall(name)} if name else set()
    return not words.isdisjoint(ASIDE_WORDS) and words <= ASIDE_WORDS | NEUTRAL_WORDS


@lru_cache(maxsize=16384)
def _element(tag: str, attributes: str, inside: bool) -> tuple[str, int, bool, bool, bool]:
    """Of a start tag: its label, kind, whether it is marked as aside, and such a mark's
    ``wraps`` and ``comments``; ``inside``: in an article."""
    names = {k.lower(): a or b or c for k, a, b, c in _NAMED.findall(attributes)} if attributes else {}
    if tag in HEADINGS:
        names.pop("id", None)  # an anchor's name
    # Numbers are left out of ids, and long ones everywhere: they name the page's content.
    words = {w.lower() for k, v in names.items() for w in _WORD.findall(v) if not w.isdigit() or k != "id" and len(w) < 3}
    main = tag == "main" or names.get("role") == "main"
    asides = [v for k, vs in names.items() for v in (vs.split() if k != "id" else [vs]) if _marks(v) and not (inside and v.lower() == "header")]  # its own header
    named = bool(asides) and not main and tag not in ("article", "html", "body")
    if inside:
        words.discard("header")
    label = tag + "".join(sorted(f".{w}" for w in words))
    kind = START | ARTICLE * (tag == "article") | MAIN * main | BOX * (tag in BOXES) | WHOLE * (tag in ("html", "body"))
    if tag in BOXES and not MAIN_WORDS.isdisjoint(words):
        kind |= NAMED
    aside = tag in ASIDE_TAGS or tag == "header" and not inside or named
    wraps = tag in ("form", "fieldset", "dialog") or tag not in ASIDE_TAGS and tag != "header"
    return label, kind, aside, wraps, any(w.lower() in COMMENT_WORDS for v in asides for w in _WORD.findall(v))


@lru_cache(maxsize=65536)
def _key(above: int, label: str) -> int:
    return xxhash.xxh64_intdigest(label, seed=above) >> 1 & ~1


class _Parser:
    """One pass over a page, in time and memory that grow with its length whatever it holds."""

    def __init__(self, page: str):
        self.out = Page([], bytearray(), [], [])
        self.marks: list[Mark] = []
        self.marked: list[int] = []  # the mark of each token
        # tag, key, place of the start token, mark, in an article, box
        self.stack: list[tuple[str, int, int, int, bool, int]] = [("", 0, -1, -1, False, -1)]
        self.open: dict[str, int] = {}
        self.parts: list[str] = []
        self.articles = 0
        self._walk(page)
        self._flush()
        while len(self.stack) > 1:
            self._pop()
        self._judge()

    def _put(self, key: int, kind: int, link: int, mark: int) -> None:
        self.out.keys.append(key)
        self.out.kinds.append(kind)
        self.out.links.append(link)
        self.marked.append(mark)

    def _pop(self) -> str:
        tag, key, at, mark, _, _ = self.stack.pop()
        self.open[tag] -= 1
        self.out.links[at] = len(self.out.keys)
        self._put(key | 1, END, at, mark)
        return tag

    def _flush(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            self.parts.clear()
            if text:
                _, above, at, mark, _, box = self.stack[-1]
                if mark >= 0:
                    self.marks[mark].words += text.count(" ") + 1
                self.out.blocks.append(Block(len(self.out.keys), box, text, False))
                self._put(xxhash.xxh64_intdigest(text, seed=above + 1) >> 1 & ~1, TEXT, at, mark)

    def _walk(self, page: str) -> None:
        at, end, last, tags = 0, len(page), page.rfind(">"), _STRICT
        while (lt := page.find("<", at)) >= 0:
            if lt > at:
                self.parts.append(page[at:lt])
            if page.startswith("<!--", lt):
                at = page.find("-->", lt + 4) + 3
                if at == 2:
                    return
                continue
            if lt > last:
                at = lt
                break
            if page[lt + 1] in "!?":
                at = page.find(">", lt) + 1
                continue
            m = tags.match(page, lt)
            if not m and tags is _STRICT and (m := _LOOSE.match(page, lt)):
                tags = _LOOSE  # a quote is never closed: from here on the first ">" ends a tag
            if not m:
                self.parts.append("<")
                at = lt + 1
                continue
            at, tag = m.end(), m[2].lower()
            if m[1]:
                self._end(tag)
            elif tag in RAW:
                if not m[3].endswith("/"):
                    close = re.compile(f"</{tag}\\b", re.IGNORECASE).search(page, at)
                    at = page.find(">", close.end()) + 1 if close else end
                    at = at or end
                self.parts.append(" ")
            else:
                self._start(tag, m[3])
        self.parts.append(page[at:])

    def _end(self, tag: str) -> None:
        if tag in BLOCK or tag == "button":
            self._flush()
            if self.open.get(tag):
                while self._pop() != tag:
                    pass

    def _start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.parts.append(" ")
        if tag not in BLOCK and tag != "button":
            return
        self._flush()
        while self.stack[-1][0] in ENDS.get(tag, ()) or self.stack[-1][0] == "p" and tag in BLOCK:
            self._pop()
        if tag in VOID:
            return
        _, above, _, mark, inside, box = self.stack[-1]
        label, kind, aside, wraps, comments = _element(tag, attributes, inside)
        if kind & (ARTICLE | MAIN):
            self.articles += 1
            if mark >= 0:
                self.marks[mark].articles += 1
            inside = True
        if aside:
            self.marks.append(Mark(mark, wraps, comments))
            mark = len(self.marks) - 1
        key, at = _key(above, label), len(self.out.keys)
        self._put(key, kind, 0, mark)
        self.open[tag] = self.open.get(tag, 0) + 1
        self.stack.append((tag, key, at, mark, inside, at if kind & BOX else box))

    def _judge(self) -> None:
        """Say which tokens and blocks are in a marked element.  One that holds all of the page's
        article and main elements or, where there are none, most of its words, is its wrapper."""
        total = sum(b.text.count(" ") + 1 for b in self.out.blocks)
        for m in reversed(self.marks):
            if m.above >= 0:
                self.marks[m.above].words += m.words
                self.marks[m.above].articles += m.articles
        for m in self.marks:
            own = not m.wraps or (m.articles < self.articles if self.articles else m.comments or 2 * m.words <= total)
            m.dropped = own or m.above >= 0 and self.marks[m.above].dropped
        for at, mark in enumerate(self.marked):
            if mark >= 0 and self.marks[mark].dropped:
                self.out.kinds[at] |= ASIDE
        self.out.blocks[:] = [b._replace(aside=bool(self.out.kinds[b.at] & ASIDE)) for b in self.out.blocks]


def parse(page: str) -> Page:
    return _Parser(page).out


def blocks(page: str) -> tuple[list[Block], list[int]]:
    """The text blocks of a page in order, and the keys of its tokens."""
    found = parse(page)
    return found.blocks, found.keys
