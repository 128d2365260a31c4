"""Leaf blocks of an HTML page: runs of text between block-level tags, with the tags, classes and ids above them.

The page is walked once from left to right, and each step takes time in proportion to what it consumes, so that no markup,
however broken, takes more than time in proportion to its length. White space is what Python's ``str.split`` takes for it:
that of ASCII, the no-break space and the other space characters of Unicode.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

# Element groups of the HTML standard.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup; it is skipped.
RAW = frozenset("script style title textarea iframe".split())
#: Of these, where the end tag is missing the rest of the page is code.
CODE = frozenset("script style".split())
FOREIGN = frozenset("svg math".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that no implied end tag reaches out of.
FENCES = frozenset("ul ol dl table div section article main body td th".split())
#: Deeper elements count as text of the element at this depth, as in browsers; nothing of their text is lost.
DEEPEST = 512

_OPENS = re.compile(r"<(?=[A-Za-z/!?])")
_NAME = re.compile(r"</?([A-Za-z][^\s/>]*+)")
#: Attributes up to the tag's end; an angle bracket within a quoted value doesn't end it, an apostrophe within an unquoted one is no quote.
_REST = re.compile(r"((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)*+)>")
_END_OF = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
_NAMES = re.compile(r"\b(?:class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))", re.I)
_PART = re.compile(r"[a-z]++|[0-9]++")
_LONG_NUMBER = re.compile(r"&#(?:0++(?=[0-9])|[1-9][0-9]{7,}+;?)")


class Block(NamedTuple):
    text: str
    linked: int  # code points inside links
    tags: tuple[str, ...]  # from the outermost element to the own one
    names: frozenset[str]  # words of class, id and role of all elements above


def decoded(text: str) -> str:
    """Character references as characters; a number beyond Unicode is U+FFFD, however many digits it has."""
    if "&" not in text:
        return text
    return html.unescape(_LONG_NUMBER.sub(lambda m: "&#" if m[0].endswith("0") and m[0].strip("&#0") == "" else "�", text))


class _Stack:
    """The open elements, with the places of each tag and of the fences, so that no lookup walks down the stack."""

    def __init__(self) -> None:
        self.open: list[tuple[str, frozenset[str]]] = []
        self.places: dict[str, list[int]] = {}
        self.fences: list[int] = []

    def push(self, tag: str, names: frozenset[str]) -> None:
        if len(self.open) < DEEPEST:
            self.places.setdefault(tag, []).append(len(self.open))
            if tag in FENCES:
                self.fences.append(len(self.open))
            above = self.open[-1][1] if self.open else frozenset()
            self.open.append((tag, above | names if names else above))

    def cut(self, place: int) -> None:
        while len(self.open) > place:
            tag, _ = self.open.pop()
            self.places[tag].pop()
            if tag in FENCES:
                self.fences.pop()

    def last(self, tags) -> int:
        """The place of the innermost open element of these tags, or -1."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def fence(self) -> int:
        return self.fences[-1] if self.fences else -1


def blocks(page: str, known: frozenset[str] | None = None) -> list[Block]:
    """The blocks with text, in page order. Any string is a page; end tags may be missing or wrong.

    A script, style or comment that isn't closed reaches to the end of the page; any other element gives the text that follows.
    Where quotes are open to the end of the page, tags from there on end at the next angle bracket; what has none is text.
    ``known``: the only words of class, id and role to be kept.
    """
    out: list[Block] = []
    stack = _Stack()
    text: list[str] = []
    linked = in_link = at = 0
    quotes = True
    unclosed: set[str] = set()  # elements of RAW without an end tag from here on

    def close() -> None:
        nonlocal linked
        if text:
            clean = " ".join("".join(text).split())
            if clean:
                out.append(Block(clean, min(linked, len(clean)), tuple(t for t, _ in stack.open), stack.open[-1][1] if stack.open else frozenset()))
            text.clear()
        linked = 0

    def words(end: int) -> None:
        nonlocal linked
        if end > at:
            piece = decoded(page[at:end])
            text.append(piece)
            linked += len(piece) if in_link else 0

    begin = 0  # where to look for the next tag; behind ``at`` by text that only looked like one
    while at < len(page):
        opening = _OPENS.search(page, begin)
        if not opening:
            words(len(page))
            break
        a = opening.start()
        if page.startswith("<!--", a):
            words(a)
            end = page.find("-->", a + 4)
            at = begin = end + 3 if end >= 0 else len(page)
            continue
        name = _NAME.match(page, a)
        if not name:
            end = page.find(">", a) if page[a + 1] in "!?" else -1
            if end >= 0:
                words(a)
                at = begin = end + 1
            else:
                begin = a + 1
                if page[a + 1] in "!?" and end < 0:
                    words(len(page))
                    break
            continue
        rest = _REST.match(page, name.end()) if quotes else None
        if rest:
            attributes, end = rest[1], rest.end()
        else:
            quotes = False
            end = page.find(">", name.end()) + 1
            if not end:
                words(len(page))
                break
            attributes = page[name.end() : end - 1]
        words(a)
        at = begin = end
        tag, ends = name[1].lower(), page[a + 1] == "/"
        if tag == "br":
            text.append(" ")
        elif tag in INLINE:
            if tag == "a":
                in_link = int(not ends)
        elif ends:
            close()
            in_link = 0
            place = stack.last((tag,))
            if place >= 0:
                stack.cut(place)
        elif tag in RAW and not (attributes.endswith("/") and stack.last(FOREIGN) >= 0):
            if tag not in unclosed:
                over = _END_OF[tag].search(page, at)
                end = page.find(">", over.end()) if over else -1
                if end >= 0:
                    at = begin = end + 1
                elif tag in CODE:
                    at = begin = len(page)
                else:
                    unclosed.add(tag)
        else:
            close()
            in_link = 0
            place = stack.last(CLOSES.get(tag, ()))
            if place >= 0 and place >= stack.fence():
                stack.cut(place)
            if tag not in VOID and not (tag in FOREIGN and attributes.rstrip().endswith("/")):
                own = frozenset(w for m in _NAMES.finditer(attributes) for w in _PART.findall((m[1] or m[2] or m[3] or "").lower()) if known is None or w in known) if attributes else frozenset()
                stack.push(tag, own)
    close()
    return out
