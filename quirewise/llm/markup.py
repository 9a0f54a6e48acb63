"""Tolerant reading of one page of HTML into tags, their places, and blocks of text."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import xxhash

# Element names of the HTML standard, by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
CONTAINERS = frozenset(
    "html head body div section article main nav header footer aside form ul ol dl li dt dd table caption thead tbody tfoot tr td th "
    "blockquote figure figcaption details summary dialog fieldset address center menu search hgroup template noscript select svg math object button".split()
)
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 pre hr option legend optgroup".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: An open element of the key ends where one of the values starts, unless a list or table of its own lies between.
ENDED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th", "tr"), "th": ("td", "th", "tr"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table menu".split())
#: Elements that never hold main text; those of the second set are left again where an article starts inside.
NEVER = frozenset("head nav footer aside dialog noscript template select button svg math object menu search".split())
UNLESS_ARTICLE = frozenset("form fieldset header".split())
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words in names of classes and ids that mark something other than main text.
MARKS = frozenset(
    "nav navbar navigation navigator menu submenu breadcrumb breadcrumbs masthead topbar header banner footer colophon sidebar sidebars "
    "aside rail widget widgets ad ads advert adverts advertisement advertising adsense adsbygoogle adslot sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login signin "
    "search searchbox share sharing social related recommended recommendations comment comments commentlist disqus reply replies respond "
    "pagination pager toolbar skiplink copyright form".split()
)
#: An article's own names are less telling: only these, as first words, mark one that is not the page's.
ARTICLE_MARKS = frozenset("ad ads advert advertisement sponsored promo widget related comment comments reply".split())
#: Elements that do not end an open head.
IN_HEAD = frozenset("meta link script style title base noscript template".split())
#: Words before a mark that turn it round ("has-sidebar").
NOT_MARKED = frozenset("has have no without with".split())

PLAIN, MAIN, ARTICLE = 1, 2, 3

_TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|)|[\"'])*+)>"
    r"|<[!?/][^>]*+>"
    r"|<[a-zA-Z!?/][^>]*+\Z",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DIGITS = re.compile(r"\d+")


class Place(NamedTuple):
    """Containers around a text: hash of their names, the hashes from the page down, what they mean."""

    path: int
    lineage: tuple[int, ...]
    zone: int
    dropped: bool
    headings_only: bool


class Block(NamedTuple):
    place: Place
    tag: int  # number of tags before it
    words: list[str]
    linked: int  # words inside links


class Page(NamedTuple):
    tags: list[int]
    blocks: list[Block]


def _signed(data: str) -> int:
    value = xxhash.xxh3_64_intdigest(data.encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >> 63 else value


class _Bounded(dict):
    """Remembers up to a number of values, then starts anew."""

    def __init__(self, make, bound: int = 50_000):
        super().__init__()
        self.make, self.bound = make, bound

    def __missing__(self, key):
        if len(self) >= self.bound:
            self.clear()
        self[key] = value = self.make(*key)
        return value


def _marked(element: str, names: str) -> bool:
    for name in names.split():
        words = [w.lower() for w in _NAME.findall(name)]
        if element == "article":
            if words and words[0] in ARTICLE_MARKS:
                return True
            continue
        if any(w in MARKS and not (i and words[i - 1] in NOT_MARKED) for i, w in enumerate(words)):
            return True
    return False


def _meaning(name: str, attributes: str) -> tuple[str, bool, bool, bool]:
    """Label of the path, whether it is dropped for good, dropped unless an article starts in it, and main."""
    found = {}
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        found.setdefault(key.lower(), a or b or c)
    classes = html.unescape(found.get("class", ""))
    role = found.get("role", "").strip().lower()
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I)
    never = name in NEVER or role in NEVER_ROLES or bool(hidden)
    soft = name in UNLESS_ARTICLE or (name not in ("html", "body", "main") and _marked(name, f"{classes} {found.get('id', '')}"))
    label = ".".join([name, *sorted({_DIGITS.sub("#", c) for c in classes.split()})])
    return label, never, soft, name == "main" or role == "main"


_MEANING = _Bounded(_meaning)
_TOKEN = _Bounded(lambda path, label: _signed(f"{path}\0{label}"))
_TOP = Place(0, (), PLAIN, False, False)


class _Open(NamedTuple):
    name: str
    place: Place
    never: bool
    soft: bool


def word_token(path: int, word: str) -> int:
    return _signed(f"{path}\1{word}")


class _Reader:
    def __init__(self):
        self.tags: list[int] = []
        self.blocks: list[Block] = []
        self.stack: list[_Open] = []
        self.place = _TOP
        self.parts: list[str] = []
        self.links: list[str] = []
        self.begun = 0
        self.leaf = ""  # the open p, h1 and so on
        self.leaf_dropped = False
        self.inline: list[str] = []  # open inline elements from a dropped one on
        self.linking = False
        self.enclosed = False

    def flush(self) -> None:
        if self.parts:
            words = "".join(self.parts).split()
            if words:
                linked = len("".join(self.links).split())
                self.blocks.append(Block(self.place, self.begun, words, linked))
            self.parts, self.links = [], []

    def text(self, raw: str) -> None:
        if self.place.dropped or self.leaf_dropped or self.inline or (self.place.headings_only and self.leaf not in HEADINGS):
            return
        if not self.parts:
            self.begun = len(self.tags)
        raw = html.unescape(raw) if "&" in raw else raw
        self.parts.append(raw)
        if self.linking:
            self.links.append(raw)

    def settle(self) -> None:
        """What holds at the top of the stack."""
        self.flush()
        self.place = self.stack[-1].place if self.stack else _TOP
        self.leaf, self.leaf_dropped, self.inline = "", False, []

    def close(self, name: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].name == name:
                del self.stack[i:]
                break
        self.settle()

    def enclose(self) -> None:
        """The page's first article or main starts: menus and the like left open end, and names around it mark nothing."""
        if self.enclosed:
            return
        for i, o in enumerate(self.stack):
            if o.name in ("nav", "header", "footer"):
                del self.stack[i:]
                break
        if not any(o.never for o in self.stack):
            self.enclosed = True
            self.stack = [o._replace(soft=False, place=o.place._replace(dropped=False, headings_only=False)) for o in self.stack]

    def start(self, name: str, attributes: str) -> None:
        if self.stack and self.stack[-1].name == "head" and name not in IN_HEAD:
            self.close("head")
        if name in CONTAINERS:
            label, never, soft, main = _MEANING[name, attributes if "=" in attributes or "hidden" in attributes else ""]
            if (name == "article" or main) and not (soft or never) and self.place.zone < ARTICLE:
                self.enclose()
            for open_name in ENDED_BY:
                if name in ENDED_BY[open_name]:
                    for i in range(len(self.stack) - 1, -1, -1):
                        if self.stack[i].name in SCOPES or self.stack[i].name in ("article", "main", "body"):
                            break
                        if self.stack[i].name == open_name:
                            del self.stack[i:]
                            break
            self.settle()
            around = self.place
            path = _TOKEN[around.path, label]
            zone = ARTICLE if name == "article" else max(around.zone, MAIN) if main else around.zone
            only = around.headings_only
            if around.zone == ARTICLE and soft and not never and (name == "header" or "header" in label):
                only, soft = True, False
            self.place = Place(path, (*around.lineage, path), zone, around.dropped or never or soft, only)
            self.stack.append(_Open(name, self.place, never, soft))
            self.tags.append(path)
            return
        self.tags.append(_TOKEN[self.place.path, name])
        if name in LEAVES:
            self.flush()
            self.leaf, self.inline = name, []
            _, never, soft, _ = _MEANING[name, attributes if "=" in attributes or "hidden" in attributes else ""]
            self.leaf_dropped = never or soft
        elif name == "br":
            self.text(" ")
        elif name not in VOID:
            if self.inline:
                self.inline.append(name)
            elif "=" in attributes or "hidden" in attributes:
                plain = name == "a" and not re.search(r"(?i)class|id\s*=|role|hidden|style", attributes)
                _, never, soft, _ = ("", False, False, False) if plain else _MEANING[name, attributes]
                if never or soft:
                    self.inline = [name]
            if name == "a":
                self.linking = True

    def end(self, name: str) -> None:
        if name in CONTAINERS:
            self.tags.append(_TOKEN[self.place.path, "/" + name])
            self.close(name)
            return
        self.tags.append(_TOKEN[self.place.path, "/" + name])
        if name in LEAVES:
            self.flush()
            self.leaf, self.leaf_dropped, self.inline = "", False, []
        elif self.inline and name in self.inline:
            while self.inline.pop() != name:
                pass
        if name == "a":
            self.linking = False


def read_page(source: str | None) -> Page:
    """Tags and blocks of a page in order; nothing for null or empty ones.

    Comments, scripts, styles and text under elements that hold no main text give
    no blocks.  Tags without an end are ended where the standard or the enclosing
    element ends them; an unfinished tag at the end of the page is left out.
    """
    reader, at, source = _Reader(), 0, source or ""
    find = _TAG.search
    while tag := find(source, at):
        if tag.start() > at:
            reader.text(source[at : tag.start()])
        at = tag.end()
        name = tag[2]
        if name is None:
            continue
        name = name.lower()
        if tag[1]:
            reader.end(name)
        else:
            reader.start(name, tag[3])
            if name in RAW and not tag[3].endswith("/"):
                closing = re.compile(f"</{name}(?=[\\s/>])", re.I).search(source, at)
                at = closing.start() if closing else len(source)
    if at < len(source):
        reader.text(source[at:])
    reader.flush()
    return Page(reader.tags, reader.blocks)
