"""Pages as tokens: tags with their place in the page, and blocks of text between them.

A token of a tag stands for its path of element names, each with its first class or id;
a token of a block for its path and its text. Both are numbers, so that deep pages cost no more. Pages of one host share a template, whose tokens
occur equally often on the same pages; what is left between them are slots.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass
from urllib.parse import urlsplit

import xxhash

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page: it is skipped up to the closing tag.
RAW = frozenset("script style textarea title template iframe select".split())
#: Of these, the ones that last to the end of the page if nothing closes them.
UNENDING = frozenset("script style textarea title".split())
#: Elements of XML inside a page: in them a tag that ends in / is closed, whatever its name.
FOREIGN = frozenset(["svg", "math"])
#: Elements in them that are about the drawing and not shown.
NOTES = frozenset(["desc", "metadata"])
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr img".split()
)
# An element of the left kind ends when one of the right kinds begins inside it.
ENDED_BY = {
    "p": frozenset(
        "p div ul ol dl table article section aside header footer nav main form h1 h2 h3 h4 h5 h6 pre blockquote "
        "hr figure address fieldset".split()
    ),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr"]),
    "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]),
    "option": frozenset(["option"]),
    "head": frozenset(["body"]),
}
# Elements that close again only what they hold themselves.
SCOPES = frozenset("table td th ul ol dl article section aside nav footer header main body html div form".split())

#: For each kind the open elements that it may end.
ENDS: dict[str, list[str]] = {}
for _open, _kinds in ENDED_BY.items():
    for _kind in _kinds:
        ENDS.setdefault(_kind, []).append(_open)

MAIN = frozenset(["article", "main"])
#: Elements whose text is never main text, wherever they are.
BESIDE = frozenset("head nav footer aside form button fieldset dialog menu".split())
#: Words in classes, ids and roles that mark such parts.
BESIDE_WORDS = frozenset(
    "ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner sidebar side menu nav navbar "
    "navigation breadcrumb breadcrumbs footer cookie cookies consent notice notices notification alert popup modal "
    "overlay comment comments respond replies reply disqus discussion share sharing social related recommended "
    "recommendations newsletter subscribe subscription signup login search pagination pager skip toolbar widget "
    "copyright contentinfo complementary masthead topbar".split()
)
#: Words that may stand beside these in a name: 'main-nav', 'cookie-bar'. Any other word makes it another name.
PLAIN_WORDS = frozenset(
    "site main page global primary secondary top bottom left right box bar bars container wrapper wrap inner outer "
    "section block area list item items link links button buttons unit slot post posts article form text title "
    "header body content".split()
)
#: Words that are headings or parts of many articles and say nothing inside one.
ARTICLE_WORDS = frozenset("discussion related side search share sharing overlay reply replies respond".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Also beside the main text, unless they are inside an article.
BESIDE_OUTSIDE = frozenset(["header", "noscript"])

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)"
    r"((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)",
    re.DOTALL,
)
_MARK = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")


@dataclass
class Block:
    path: int
    text: str
    main: bool  # inside an article or main element
    beside: bool  # inside a part that is not main text
    wrapped: bool = False  # inside an article or main element that is inside a part with such a name

    @property
    def token(self) -> int:
        return number(self.path, self.text)


#: The path outside all elements.
OUTSIDE = 0


def number(parent: int, name: str) -> int:
    """A signed long for a token below ``parent``."""
    n = xxhash.xxh64_intdigest(name.encode("utf-8", "replace"), parent & 0xFFFFFFFFFFFFFFFF)
    return n - (1 << 64) if n >> 63 else n


def host(url: str | None) -> str:
    """Lower-case host of an address; empty if there is none."""
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _marked(value: str, but: frozenset[str] = frozenset()) -> bool:
    """Whether one of the names in a class, id or role is made of words for parts beside the text, and plain ones."""
    for name in value.lower().split():
        words = set(_WORD.findall(name))
        beside = (words & BESIDE_WORDS) - but
        if beside and not words - BESIDE_WORDS - PLAIN_WORDS:
            return True
    return False


class _Open:
    """An element that is open: its name, its path and what it says about its text."""

    __slots__ = ("name", "path", "main", "article", "beside", "wrapped", "foreign", "block")

    def __init__(self, name: str, attributes: str, parent: _Open | None):
        marks = _MARK.findall(attributes) if "=" in attributes else []
        values = [(k.lower(), a or b or c) for k, a, b, c in marks]
        shown = next((v.split()[0] for k, v in values if k in ("class", "id") and v.split()), "")
        self.name = name
        self.path = number(parent.path if parent else OUTSIDE, f"{name}.{shown}")
        inside = bool(parent and parent.main)
        self.main = inside or name in MAIN
        self.article = bool(parent and parent.article) or name == "article"
        if name in MAIN or name in HEADINGS or name in ("html", "body"):
            marked = False
        elif self.article:
            # An id inside an article is a place to link to.
            marked = any(_marked(v, ARTICLE_WORDS) for k, v in values if k != "id")
        else:
            marked = any(_marked(v) for _, v in values)
        self.foreign = bool(parent and parent.foreign) or name in FOREIGN
        below = bool(parent and parent.beside)
        self.beside = (
            below or name in BESIDE or marked or (name in BESIDE_OUTSIDE and not inside)
            or (name in NOTES and self.foreign)
        )
        # Only the names of parts around an article or main element count against it.
        named = bool(parent and parent.wrapped) or (marked and not below and not inside)
        self.wrapped = named and not (name in BESIDE or (marked and inside) or (below and not parent.wrapped))
        # The innermost element that is not inline: text in here belongs to it.
        self.block = self if name not in INLINE else parent.block if parent else None


class _Parser:
    """Reads a page once; every step is bounded by the text and the elements it closes."""

    def __init__(self) -> None:
        self.tags: Counter = Counter()
        self.parents: dict[int, int] = {}
        self.blocks: list[Block] = []
        self.opened: list[_Open] = []
        self.names: Counter = Counter()
        self.closings: dict[str, re.Match | None] = {}
        self.parts: list[str] = []
        self.owner: _Open | None = None

    def text(self, text: str) -> None:
        if text:
            if not self.parts:
                self.owner = self.opened[-1].block if self.opened else None
            self.parts.append(html.unescape(text) if "&" in text else text)

    def end_block(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts.clear()
        if text:
            at = self.owner
            path = at.path if at else OUTSIDE
            self.blocks.append(
                Block(path, text, bool(at and at.main), bool(at and at.beside), bool(at and at.main and at.wrapped))
            )

    def _close_from(self, k: int) -> None:
        for element in self.opened[k:]:
            self.names[element.name] -= 1
        del self.opened[k:]

    def close(self, name: str) -> None:
        if name == "br" or name not in INLINE:
            self.end_block()
        if not self.names[name]:
            return
        for k in range(len(self.opened) - 1, -1, -1):
            element = self.opened[k].name
            if element == name:
                self._close_from(k)
                return
            if (name in INLINE and element not in INLINE) or (name not in SCOPES and element in SCOPES):
                return

    def open(self, name: str, attributes: str) -> None:
        if name not in INLINE:
            self.end_block()
        if any(self.names[ended] for ended in ENDS.get(name, ())):
            for k in range(len(self.opened) - 1, -1, -1):
                if name in ENDED_BY.get(self.opened[k].name, ()):
                    self._close_from(k)
                    break
                if self.opened[k].name in SCOPES:
                    break
        parent = self.opened[-1] if self.opened else None
        element = _Open(name, attributes, parent)
        self.tags[element.path] += 1
        self.parents[element.path] = parent.path if parent else OUTSIDE
        if name not in RAW and name not in VOID and not attributes.rstrip().endswith("/"):
            self.opened.append(element)
            self.names[name] += 1

    def closing(self, page: str, at: int, name: str) -> re.Match | None:
        """The next closing tag of this name; each part of the page is searched once for a name."""
        found = self.closings.get(name)
        if name not in self.closings or (found and found.start() < at):
            found = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            self.closings[name] = found
        return found

    def after_raw(self, page: str, at: int, name: str, closed: bool) -> int:
        """Where reading goes on after the start tag of a raw element; ``closed`` if it ends in /."""
        if closed and (name not in UNENDING or (self.opened and self.opened[-1].foreign)):
            return at
        found = self.closing(page, at, name)
        return found.end() if found else len(page) if name in UNENDING else at

    def read(self, page: str) -> None:
        at = 0
        while found := _TOKEN.search(page, at):
            self.text(page[at : found.start()])
            at = found.end()
            name = (found[2] or "").lower()
            if name and found[1]:
                self.close(name)
            elif name and (name != "noscript" or self.closing(page, at, name)):
                self.open(name, found[3] or "")
                if name in RAW:
                    at = self.after_raw(page, at, name, (found[3] or "").rstrip().endswith("/"))
        self.text(page[at:])
        self.end_block()


def parse(page: str | None) -> _Parser:
    """Occurrences of tag tokens with their parents, and all blocks with text in page order."""
    parser = _Parser()
    parser.read(page or "")
    return parser


def shown(blocks: list[Block]) -> int:
    """A number of the texts of a page that may be main text; copies of a page have the same."""
    return number(OUTSIDE, "\n".join(b.text for b in blocks if not b.beside))


def main_text(page: str | None, template: frozenset[int]) -> str:
    """Text of the slots: blocks that are neither beside the main text nor part of the host's template.

    ``template`` holds numbers of tag and block tokens; a block inside an article or main
    element is never part of it. Where the page has such an element with text, only slots
    inside it count.
    """
    blocks = parse(page).blocks
    slots = [b for b in blocks if not b.beside and (b.main or b.token not in template)]
    # Where all articles lie inside a part with a telling name, it is the name of their wrapper.
    inside = [b for b in slots if b.main] or [b for b in blocks if b.wrapped]
    return " ".join(b.text for b in (inside or slots))
