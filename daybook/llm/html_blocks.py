"""Leaf blocks of an HTML page with their tag paths, and the vectors the block labeller reads."""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

#: Fixed values (HTML standard): elements that never stand inside a line of text.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option optgroup p pre search section select "
    "summary table tbody td tfoot th thead tr ul button textarea label".split()
)
#: Fixed values (HTML standard): elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page, up to their end tag.
RAW = "script|style|noscript|template|title|svg|math|iframe|object|canvas"
#: An opening tag ends open elements of these names, up to the given container.
CLOSES = {
    "li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)),
    "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",)),
}

_RAW = re.compile(rf"<({RAW})\b", re.I)
_RAW_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW.split("|")}
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_SPACE = re.compile(r"\s+")

PATH, WORDS, PLAIN = 96, 48, 8
WIDTH = PATH + WORDS + PLAIN
#: How much less an element says about a block than the element right inside it.
FADE = 0.75
#: A mark in a made-up page that is no element of it.
MARK = "data-main"


class _Ahead:
    """The next place of a pattern, looked up in rising places: a look-up inside the last gap costs nothing."""

    def __init__(self, page: str, pattern: str) -> None:
        self.page, self.search, self.low, self.at = page, re.compile(pattern).search, 0, -1

    def __call__(self, place: int) -> int:
        if not self.low <= place <= self.at:
            m = self.search(self.page, place)
            self.low, self.at = place, m.start() if m else len(self.page)
        return self.at


class _Tags:
    """Where tags end, each place of a page looked at a few times however many tags never end."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.name_end, self.first = _Ahead(page, r"[\s/>]"), _Ahead(page, "[>\"']")
        self.next, self.close = re.compile("[>\"']").search, _Ahead(page, ">")
        self.dead: set[int] = set()

    def end(self, place: int) -> int:
        """The > that ends a tag whose attributes begin at place, not counting those in quotes; -1 if there is none.

        What follows a mark outside quotes does not depend on where the tag began, so the marks met by a tag without an
        end are dead for all later tags."""
        at, met = self.first(place), []
        while at < len(self.page) and at not in self.dead:
            if self.page[at] == ">":
                return at
            met.append(at)
            shut = self.page.find(self.page[at], at + 1)
            if shut < 0:
                break
            m = self.next(self.page, shut + 1)
            at = m.start() if m else len(self.page)
        self.dead.update(met)
        return -1


def _tokens(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, whether it is an end tag, attributes) of every tag; name is empty for what is no text of the page."""
    tags, at = _Tags(page), page.find("<")
    while at >= 0:
        mark, stop, found = page[at + 1 : at + 2], -1, ("", False, "")
        raw = _RAW.match(page, at)
        if page.startswith("<!--", at):
            stop = page.find("-->", at + 4) + 3
            stop = stop if stop > 2 else len(page)
        elif raw and (shut := tags.close(raw.end())) < len(page):
            m = _RAW_ENDS[raw[1].lower()].search(page, shut + 1)
            stop = m.end() if m else len(page)
        else:
            begin = at + 1 + (mark == "/")
            if page[begin : begin + 1].isascii() and page[begin : begin + 1].isalpha():
                name = tags.name_end(begin)
                end = tags.end(name) if name < len(page) else -1
                if end >= 0:
                    stop, found = end + 1, (page[begin:name].lower(), mark == "/", page[name:end])
            if stop < 0 and mark and mark in "!?/" and (shut := tags.close(at + 2)) < len(page):
                stop = shut + 1
        if stop >= 0:
            yield (at, stop, *found)
        at = page.find("<", max(stop, at + 1))


class Element:
    """An open element: its name, the words of its class, id and role, and the element around it.

    What a block needs of its whole path is summed up here, element by element, so a path costs its last element only:
    the hashed words (nearer ones heavier), whether a link is open, and whether it is inside a MARK."""

    __slots__ = ("above", "link", "marked", "name", "vector", "words")

    def __init__(self, name: str, words: tuple[str, ...], above: Element | None) -> None:
        self.name, self.words, self.above = name, words, above
        self.link = name == "a" or (above is not None and above.link)
        self.marked = name == MARK or (above is not None and above.marked)
        self.vector: np.ndarray | None = None

    def path_vector(self) -> np.ndarray:
        """Made when a block asks for it, from the nearest element above that has one."""
        open_, at = [], self
        while at is not None and at.vector is None:
            open_.append(at)
            at = at.above
        vector = np.zeros(PATH, np.float32) if at is None else at.vector
        for element in reversed(open_):
            if element.name != MARK:
                vector = vector * np.float32(FADE)
                for word in (f"<{element.name}>", *element.words):
                    vector[_hash(word, PATH)] += 1
            element.vector = vector
        return vector


@dataclass
class Block:
    text: str
    inside: Element | None
    linked: int
    main: int = field(default=-1)


class _Open:
    """The open elements, with the places of each name among them, so that no step looks through them all."""

    def __init__(self) -> None:
        self.elements: list[Element] = []
        self.places: dict[str, list[int]] = {}

    def last(self, names: tuple[str, ...]) -> int:
        """The place of the innermost open element of these names, -1 if there is none."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def push(self, element: Element) -> None:
        self.places.setdefault(element.name, []).append(len(self.elements))
        self.elements.append(element)

    def cut(self, place: int) -> None:
        while len(self.elements) > place:
            self.places[self.elements.pop().name].pop()

    def end(self, names: tuple[str, ...], until: tuple[str, ...]) -> None:
        """End the innermost element of these names unless an open container stands nearer."""
        place = self.last(names)
        if place > self.last(until):
            self.cut(place)


def blocks(page: str | None) -> list[Block]:
    """The page's leaf blocks in order: runs of text without a block element's edge inside.

    References are decoded, white space becomes single spaces, and empty blocks are left out.  Unclosed and stray
    tags are taken as browsers do for the common cases (a paragraph ends at the next block, an item at the next item).
    The work is linear in the page, however deep its elements stand in each other and however many tags never end.
    """
    page, out, held, linked, at = page or "", [], [], 0, 0
    stack = _Open()
    here = lambda: stack.elements[-1] if stack.elements else None

    def flush() -> None:
        nonlocal linked
        if held:
            text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
            if text:
                out.append(Block(text, here(), min(linked, len(text))))
            held.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        held.append(text)
        if stack.elements and stack.elements[-1].link:
            linked += len(text)

    for start, stop, name, ends, attributes in _tokens(page):
        if start > at:
            say(page[at:start])
        at = stop
        if not name:
            continue
        if name == "br":
            held.append(" ")
            continue
        if name in BLOCK:
            flush()
        if ends:
            place = stack.last((name,))
            if place >= 0:
                stack.cut(place)
            continue
        if name in VOID:
            continue
        if name in BLOCK and name not in ("label", "button"):
            stack.end(("p",), ("table", "td", "th", "body"))
        if name in CLOSES:
            ended, until = CLOSES[name]
            stack.end(tuple(ended.split()), until)
        if not attributes.rstrip().endswith("/") or name in BLOCK:
            stack.push(Element(name, _names(attributes), here()))
    if at < len(page):
        say(page[at:])
    flush()
    return out


def _names(attributes: str) -> tuple[str, ...]:
    parts = [a or b or c for a, b, c in _NAMES.findall(attributes)] if "=" in attributes else []
    return tuple(p.lower() for part in parts for p in _PART.findall(part))


def _hash(token: str, width: int) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % width


def _word_vector(text: str) -> np.ndarray:
    """All words of the block, hashed, as shares of their number."""
    words = text.lower().split()
    places = np.fromiter((_hash(w, WORDS) for w in words), np.int64, len(words))
    return np.bincount(places, minlength=WORDS).astype(np.float32) / max(4, len(words))


def vectors(page: list[Block]) -> np.ndarray:
    """One row of WIDTH numbers per block: hashed path, hashed words, and length, links, place and marks."""
    out = np.zeros((len(page), WIDTH), np.float32)
    for i, b in enumerate(page):
        out[i, :PATH] = b.inside.path_vector() if b.inside else 0
        out[i, PATH : PATH + WORDS] = _word_vector(b.text)
        n = len(b.text)
        out[i, PATH + WORDS :] = (
            np.log1p(n) / 5, b.linked / n, i / len(page), (len(page) - 1 - i) / len(page), min(1, len(page) / 50),
            b.text.count(". ") / 5, b.text[-1] in ".!?:\"'”", any(x in b.text for x in "©·|»"),
        )
    return out
