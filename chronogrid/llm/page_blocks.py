"""Blocks of text of one HTML page, with the element that holds each, by one pass over its tags."""

from __future__ import annotations

import functools
import html
import re

import xxhash

#: A comment, a section of plain characters, a declaration, an element whose content is no markup, or a tag.
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*+>?"
    r"|<((?i:script|style|textarea|title|iframe|noembed|noframes))(?=[\s/>])([^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+)>?.*?(?:</(?i:\2)(?=[\s/>]|\Z)[^>]*+>?|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+)>?",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*+(?:=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s\"'>]*+)))?")
#: What of a tag tells whether its text counts, or tells its path from others.
TELLING = re.compile(r"\b(?:class|id|role|hidden|style)\b", re.I)
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
P, KEEPS_P = frozenset(["p"]), frozenset("button table td th".split())
#: An element that ends an open one of these kinds, unless one of the second kinds lies between.
ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table")}
ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}

#: Elements, roles and words of class and id that hold no article text.
NEVER = frozenset("aside button canvas datalist dialog footer form head iframe input map math menu nav noscript object script select style svg template textarea title video audio".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NAMES = frozenset("ad ads advert advertisement advertisements adverts alert banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promotion recommended related replies respond reviews search share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar".split())
#: Of these, what stays out even if it holds an element named article.
READERS = frozenset("comment comments disqus recommended related replies respond reviews teaser".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Block:
    """Text between two block tags, references decoded; ``article``: within article or main; ``kept``: outside all that is never article text."""

    __slots__ = ("article", "kept", "path", "pieces")

    def __init__(self, path: int, article: bool, kept: bool):
        self.path, self.article, self.kept, self.pieces = path, article, kept, []

    @property
    def words(self) -> list[str]:
        """The words of the text; white space of any kind and length lies between them."""
        return "".join(self.pieces).split()


class _Open:
    __slots__ = ("article", "heading", "headings_only", "inline", "name", "path", "skip")

    def __init__(self, name: str, path: int, skip: int, article: bool, headings_only: bool, heading: bool, inline: bool):
        self.name, self.path, self.skip, self.article, self.headings_only, self.heading, self.inline = name, path, skip, article, headings_only, heading, inline


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)} if text.strip("/ \t\n\r\f") else {}


def _skipped(name: str, attributes: dict[str, str], in_article: bool) -> int:
    """2: no article text at all; 1: none unless an article or main element comes in it; 0: as its parent."""
    if name in NEVER or "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return 2
    if attributes and name not in ("html", "body", "main") and not (name in HEADINGS):
        parts = {p.lower() for c in ("class", "id") if c in attributes for p in NAME_PARTS.findall(attributes[c])}
        if parts & READERS:
            return 2
        if name != "article" and (attributes.get("role") in ROLES or parts & NAMES):
            return 0 if in_article and "header" in parts and not (parts & NAMES) - {"header"} else 1
    return 1 if name == "header" and not in_article else 0


@functools.lru_cache(maxsize=1 << 16)
def _opened(name: str, text: str, path: int, skip: int, article: bool, headings_only: bool, heading: bool) -> _Open:
    """The element that a tag opens under one with the other values."""
    attributes = _attributes(text)
    inline = name in INLINE
    if not inline:
        path = xxhash.xxh3_64_intdigest(f"{path} {name} {attributes.get('class', '')} {attributes.get('id', '')}")
    own = _skipped(name, attributes, article)
    headings_only = headings_only or (name == "header" and article)
    if name in ("article", "main") and own < 2 and skip < 2:
        own, article = 0, True
    else:
        own = max(own, skip)
    return _Open(name, path, own, article, headings_only, heading or name in HEADINGS, inline)


def blocks(page: str) -> tuple[list[Block], list[int]]:
    """Blocks in page order, and the path numbers of all tags that open an element of their own line.

    A path number stands for the names, classes and ids of the block elements around; what is inline has none.
    """
    found: list[Block] = []
    tags: list[int] = []
    top = _Open("", 0, 0, False, False, False, False)
    stack = [top]
    block: Block | None = None
    at = 0

    def add(text: str, decode: bool = True) -> None:
        nonlocal block
        keep = not top.skip and (top.heading or not top.headings_only)
        if block is None or block.kept != keep:
            if text.isspace():
                return
            block = Block(top.path, top.article, keep)
            found.append(block)
        block.pieces.append(html.unescape(text) if decode and "&" in text else text)

    def close(k: int) -> None:
        nonlocal block, top
        if not all(o.inline for o in stack[k:]):
            block = None
        del stack[k:]
        top = stack[-1]

    def close_last(names: frozenset[str], outer: frozenset[str]) -> bool:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in outer:
                return False
            if stack[k].name in names:
                close(k)
                return True
        return False

    for m in TAG.finditer(page):
        plain, raw, raw_text, end, name, text = m.groups()
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if name is None:
            if plain is not None:
                add(plain, decode=False)
            elif raw is not None:
                block = None
                tags.append(_opened(raw.lower(), raw_text if TELLING.search(raw_text) else "", top.path, top.skip, top.article, top.headings_only, top.heading).path)
            continue
        name = name.lower()
        if end:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    close(k)
                    break
            else:
                if name not in INLINE:
                    block = None
            continue
        if name == "br":
            if block is not None:
                block.pieces.append(" ")
            continue
        if name in CLOSES_P:
            close_last(P, KEEPS_P)
        if name in ENDS:
            ends, outer = ENDS[name]
            while close_last(ends, outer) and name == "tr":
                pass
        opened = _opened(name, text if text and TELLING.search(text) else "", top.path, top.skip, top.article, top.headings_only, top.heading)
        if not opened.inline:
            block = None
            tags.append(opened.path)
        if name not in VOID:
            stack.append(opened)
            top = opened
    if at < len(page):
        add(page[at:])
    return found, tags
