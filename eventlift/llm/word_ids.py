"""Token ids of whole texts by the tokenizers library, looked up by chunk.

The tokenizer here drops white space and none of its rules reaches across it, so a text's ids
are those of its runs of other characters, one after the other. The library's model is asked once for
each part of them that it treats on its own (a pre-token), and the answer remembered. The parts are
normalized and cut already, which in the library takes more time than the model.

Chunks are known by 64-bit hashes of at most 64 bytes, their ids lie one after the other in an array.
A memory has two generations: when the young one is full it becomes the old one, and what is asked for
again moves to the new young one. So frequent chunks stay, and rare ones go.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from functools import lru_cache
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
import regex

from eventlift.llm.tasks import BEYOND_LATIN, WHITE_SPACE
from eventlift.llm.token_counts import byte_symbols
from eventlift.llm.words import Words

if TYPE_CHECKING:
    from tokenizers.models import Model

#: Chunks and pre-tokens that a generation remembers at most; a worker holds two of each.
MAX_CHUNKS, MAX_PIECES = 800_000, 80_000
LONGEST_CACHED = 64
BORDER = 0xFFFFFFFF
#: What the library has to see as it is.
_ODD = re.compile(rf"<\||[{BEYOND_LATIN}-{chr(0x10FFFF)}]")
#: White space beyond ASCII, which parts chunks as a space does.
_OTHER_SPACE = re.compile("[" + WHITE_SPACE.replace("\t-\r ", "") + "]")


class _Chunks:
    """One generation: places by sorted hash, and the ids at each place."""

    def __init__(self):
        self.hashes, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 14, np.int32)  # of place p at p + 1
        self.used = 0

    def add(self, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        total, places = int(self.ends[self.used]), self.used + len(sizes)
        while len(self.ends) <= places:
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        while len(self.ids) < total + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[total : total + len(ids)] = ids
        self.ends[self.used + 1 : places + 1] = total + np.cumsum(sizes)
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        self.hashes = np.insert(self.hashes, at, hashes[order])
        self.places = np.insert(self.places, at, (self.used + order).astype(np.int32))
        self.used = places

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 if it is not known."""
        if not self.used:
            return np.full(len(hashes), -1, np.int64)
        order = np.argsort(hashes)
        at = np.minimum(np.searchsorted(self.hashes, hashes[order]), self.used - 1)
        found = np.empty(len(hashes), np.int64)
        found[order] = np.where(self.hashes[at] == hashes[order], self.places[at], -1)
        return found

    def gathered(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids at these places one after the other, and how many each place has."""
        starts = self.ends[places].astype(np.int64)
        sizes = self.ends[places + 1] - starts
        ends = np.cumsum(sizes)
        at = np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        return self.ids[at], sizes


class _Pieces(dict):
    """Packed ids by pre-token; missing ones are looked up in the old generation or asked for."""

    def __init__(self, model: Model):
        super().__init__()
        self._tokenize = model.tokenize
        self._bytes = str.maketrans({chr(b): symbol for b, symbol in enumerate(byte_symbols())})
        self._old: dict[str, bytes] = {}
        self[" "] = array("I", [BORDER]).tobytes()

    def __missing__(self, piece: str) -> bytes:
        ids = self._old.get(piece)
        if ids is None:
            plain = piece.isascii() and piece.isprintable()
            symbols = piece if plain else piece.encode().decode("latin-1").translate(self._bytes)
            ids = array("I", [t.id for t in self._tokenize(symbols)]).tobytes()
        if len(piece) <= LONGEST_CACHED:
            if len(self) >= MAX_PIECES:
                border = self[" "]
                self._old = dict(self)
                self.clear()
                self[" "] = border
            self[piece] = ids
        return ids


class WordIds:
    """Packed ids (little-endian unsigned 32-bit) of texts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        rules = json.loads(self._library.pre_tokenizer.__getstate__())  # the file's own, without its vocabulary
        split = rules["pretokenizers"][0]["pattern"]["Regex"]
        self._pretokens = regex.compile(split.replace(r"[^\s", f"[^{WHITE_SPACE}") + "| ").findall
        self._young, self._old = _Chunks(), _Chunks()
        self._pieces = _Pieces(self._library.model)

    def _asked(self, texts: list[str]) -> list[bytes]:
        found = self._library.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _of_pieces(self, chunks: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks (with a space between), and how many each has, from those of their pre-tokens."""
        pieces = self._pretokens(unicodedata.normalize("NFC", chunks).lower())
        packed = np.frombuffer(b"".join(map(self._pieces.__getitem__, pieces)), "<u4")
        borders = packed == BORDER
        at = np.concatenate([[-1], np.flatnonzero(borders), [len(packed)]])
        return packed[~borders], np.diff(at) - 1

    def _learned(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """New chunks in the order in which their ids come, ids, and how many each has.

        A chunk that may hold a special token's string, or letters beyond the Latin blocks,
        where Unicode tables differ between libraries, goes to the library as it is.
        """
        joined = " ".join(chunks)
        found = [m.start() for m in _ODD.finditer(joined)]
        if not found:
            return np.arange(len(chunks)), *self._of_pieces(joined)
        ends = np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)) + 1)
        is_odd = np.zeros(len(chunks), bool)
        is_odd[np.searchsorted(ends, found, "right")] = True
        plain, odd = (~is_odd).nonzero()[0], is_odd.nonzero()[0]
        ids, sizes = [], []
        if len(plain):
            found, counts = self._of_pieces(" ".join([chunks[i] for i in plain.tolist()]))
            ids.append(found)
            sizes.append(counts)
        whole = self._asked([chunks[i] for i in odd.tolist()])
        ids.append(np.frombuffer(b"".join(whole), "<u4"))
        sizes.append(np.array([len(w) // 4 for w in whole], np.int64))
        return np.concatenate([plain, odd]), np.concatenate(ids), np.concatenate(sizes)

    def _chunks_of(self, words: Words, at: np.ndarray) -> list[str]:
        raw, starts, ends = words.bytes.data, words.start[at].tolist(), words.end[at].tolist()
        return [str(raw[s:e], "utf-8") for s, e in zip(starts, ends, strict=True)]

    def _places(self, words: Words) -> np.ndarray:
        """The place among the young of every chunk; chunks too long to keep have -1."""
        places = np.full(len(words.hash), -1, np.int64)
        short = np.flatnonzero(words.end - words.start <= LONGEST_CACHED)
        code, hashes = pd.factorize(words.hash[short])
        found = self._young.find(hashes)
        if self._young.used + np.count_nonzero(found < 0) > MAX_CHUNKS:
            self._old, self._young = self._young, _Chunks()
            found[:] = -1
        missing = np.flatnonzero(found < 0)
        before = self._old.find(hashes[missing])
        back = missing[before >= 0]
        found[back] = self._young.used + np.arange(len(back))
        self._young.add(hashes[back], *self._old.gathered(before[before >= 0]))
        new = missing[before < 0]
        if len(new):
            first = np.zeros(len(hashes), np.int64)
            first[code[::-1]] = short[::-1]
            order, ids, sizes = self._learned(self._chunks_of(words, first[new]))
            found[new[order]] = self._young.used + np.arange(len(new))
            self._young.add(hashes[new[order]], ids, sizes)
        places[short] = found[code]
        return places

    def texts(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text."""
        texts = [t if t.isascii() or not _OTHER_SPACE.search(t) else _OTHER_SPACE.sub(" ", t) for t in texts]
        words = Words([t.encode() for t in texts])
        if not len(words.hash):
            return [b""] * len(texts)
        places = self._places(words)
        known, long = places >= 0, np.flatnonzero(places < 0)
        ids, some = self._young.gathered(places[known])
        sizes = np.zeros(len(places), np.int64)
        sizes[known] = some
        if len(long):
            order, more, counts = self._learned(self._chunks_of(words, long))
            sizes[long[order]] = counts
            rank = np.concatenate([np.flatnonzero(known), long[order]])
            pieces = np.split(np.concatenate([ids, more]), np.cumsum(np.concatenate([some, counts]))[:-1])
            ids = np.concatenate([pieces[i] for i in np.argsort(rank).tolist()])
        ends = np.concatenate([[0], np.cumsum(sizes)])
        borders = ends[np.searchsorted(words.doc, np.arange(len(texts) + 1))].tolist()
        packed = ids.astype("<u4", copy=False)
        return [packed[s:e].tobytes() for s, e in zip(borders, borders[1:])]


@lru_cache(2)
def load(path: str) -> WordIds:
    """The ids of a tokenizer file; one per worker process."""
    return WordIds(path)


def grouped(texts: list[str], limit: int = 1 << 20) -> list[tuple[int, int]]:
    """Ranges of texts with about so many characters each, to bound what is held at once."""
    ranges, start, held = [], 0, 0
    for at, text in enumerate(texts):
        held += len(text)
        if held >= limit:
            ranges.append((start, at + 1))
            start, held = at + 1, 0
    if start < len(texts):
        ranges.append((start, len(texts)))
    return ranges
