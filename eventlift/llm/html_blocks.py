"""HTML cut into leaf blocks: the text between two block tags, with the path of tags above it."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import defaultdict
from typing import NamedTuple

#: Tags that end a line of text, tags without content, and tags whose content is no text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "iframe label legend li main menu nav noframes ol optgroup option p pre search section select "
    "summary table tbody td textarea tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT_TAGS = frozenset("noscript script style svg template math object".split())
#: Tags that an opening tag of the same group closes.
CLOSED_BY = {"p": "p", "li": "li", "dd": "dd dt", "dt": "dd dt", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}

_OPENS = re.compile(r"<(?:(?P<comment>!--)|(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]{0,63})|(?P<other>[!?/]))")
_SPECIAL = re.compile("[>\"']")
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_WORDS = re.compile(r"[a-z]+")
#: Elements of a path that are kept: so many from the top, and the nearest ones.
OUTER, NEAREST = 16, 48
_ENDS = {tag: re.compile(rf"</{tag}[\s/>]", re.IGNORECASE) for tag in SILENT_TAGS}


class Block(NamedTuple):
    """A leaf's text, the names on its path from the top, and the characters inside links."""

    text: str
    path: tuple[str, ...]
    linked: int


def _names(tag: str, rest: str) -> tuple[str, ...]:
    """The tag, and the words of its class, id, role and itemprop."""
    if "=" not in rest:
        return (f"<{tag}",)
    words = [w for found in _NAMES.findall(rest) for w in _WORDS.findall("".join(found).lower())]
    return (f"<{tag}", *words[:8])


class _Reader:
    """Open elements, and for each tag (and all block tags) where they stand, the last one last."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.open: list[tuple[str, tuple[str, ...]]] = []
        self.places: defaultdict[str, list[int]] = defaultdict(list)
        self.block_places: list[int] = []
        self.pieces: list[str] = []
        self.linked = 0

    def text(self, raw: str) -> None:
        if raw:
            # Piece by piece: a reference does not go on behind a tag.
            self.pieces.append(html.unescape(raw) if "&" in raw else raw)
            if self.places["a"]:
                self.linked += len(raw)

    def end_block(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                own = self.open if len(self.open) <= OUTER + NEAREST else [*self.open[:OUTER], *self.open[-NEAREST:]]
                path = tuple(n for _, names in own for n in names)
                self.blocks.append(Block(text, path, min(self.linked, len(text))))
        self.pieces, self.linked = [], 0

    def start(self, tag: str, rest: str) -> None:
        if tag == "br" or tag not in BLOCK_TAGS and tag in VOID_TAGS:
            self.text(" ")
            return
        if tag in BLOCK_TAGS:
            self.end_block()
        if tag in VOID_TAGS:
            return
        if tag in CLOSED_BY:
            for closed in CLOSED_BY[tag].split():
                self._close_near(closed)
        self.places[tag].append(len(self.open))
        if tag in BLOCK_TAGS:
            self.block_places.append(len(self.open))
        self.open.append((tag, _names(tag, rest)))

    def _close_near(self, tag: str) -> None:
        """Close an open tag unless another block lies between."""
        places = self.places[tag]
        if places and (not self.block_places or places[-1] >= self.block_places[-1]):
            self._pop_to(places[-1])

    def end(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            self.end_block()
            if self.places[tag]:
                self._pop_to(self.places[tag][-1])
        else:
            self._close_near(tag)

    def _pop_to(self, at: int) -> None:
        while len(self.open) > at:
            name, _ = self.open.pop()
            self.places[name].pop()
            if name in BLOCK_TAGS:
                self.block_places.pop()


class _TagEnds:
    """Where a tag that begins at a place ends: at the next ``>`` outside quotes.

    From a quote on, the end is that from behind its partner on, so all ends are known after one
    walk from the back, however many tags never end.
    """

    def __init__(self, page: str):
        self.places = [m.start() for m in _SPECIAL.finditer(page)]
        self.ends = [-1] * (len(self.places) + 1)
        partner = {}
        for i in range(len(self.places) - 1, -1, -1):
            mark = page[self.places[i]]
            if mark == ">":
                self.ends[i] = self.places[i]
            else:
                self.ends[i] = self.ends[partner[mark] + 1] if mark in partner else -1
                partner[mark] = i

    def after(self, place: int) -> int:
        return self.ends[bisect_left(self.places, place)]


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order; broken markup is read as far as it goes.

    A ``<`` that begins no tag, or one that never ends, is text. Time is linear in the page. Of a path
    with more than ``OUTER`` + ``NEAREST`` elements the middle is left out.
    """
    reader, ends, last = _Reader(), _TagEnds(page), page.rfind(">")
    at = seen = 0  # text is read up to ``at``, no tag begins between there and ``seen``
    while found := _OPENS.search(page, seen):
        start, seen = found.span()
        tag, end = found["tag"], 0
        if found["comment"]:
            stop = page.find("-->", seen)
            end = len(page) if stop < 0 else stop + 3
        elif tag and (stop := ends.after(seen)) >= 0:
            end = stop + 1
        elif (found["close"] or found["other"]) and seen <= last:
            tag, end = None, page.find(">", seen) + 1
        if not end:
            seen = start + 1
            continue
        reader.text(page[at:start])
        rest = page[seen : end - 1]
        at = seen = end
        if not tag:
            continue
        tag = tag.lower()
        if found["close"]:
            reader.end(tag)
        elif tag in SILENT_TAGS:
            if not rest.endswith("/") or tag in ("script", "style"):
                over = _ENDS[tag].search(page, at)
                stop = page.find(">", over.start()) if over else -1
                at = seen = stop + 1 if stop >= 0 else len(page)
        else:
            reader.start(tag, rest)
    reader.text(page[at:])
    reader.end_block()
    return reader.blocks
