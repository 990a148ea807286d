"""Token counts without token ids (operator 4).

A pre-token is a linked list of symbols and a heap of its adjacent pairs by rank. The pair of
lowest rank is popped and merged until none is left; the count is the number of symbols at
the start less the number of merges. No identifier is ever looked up.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache, partial
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlift.llm.tasks import (
    BEYOND_LATIN,
    ONLY_PYTHON_SPLITS,
    WHITE_SPACE,
    Batches,
    arrow_map,
    batch_of,
    texts_of,
)

#: Pre-tokens and chunks a worker remembers at most; each starts anew beyond it.
MAX_CACHED = 500_000
LONGEST_CACHED = 64


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next free one from 256."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in printable]
    return [chr(b) if b in printable else chr(256 + hidden.index(b)) for b in range(256)]


class MergeCounter(dict):
    """Counts by chunk, a run of characters without white space; missing ones are counted."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self._ranks = {(a, b): rank for rank, (a, b) in enumerate(pairs)}
        self._end = model["end_of_word_suffix"] or ""
        self._symbols = byte_symbols()
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self._pretokens = regex.compile(split.replace(r"[^\s", f"[^{WHITE_SPACE}")).findall
        self._special = {t["content"] for t in spec["added_tokens"]}
        self._at_special = re.compile("(" + "|".join(map(re.escape, sorted(self._special))) + ")")
        self._chunks = re.compile(f"[^{WHITE_SPACE}]+").findall
        self._known: dict[str, int] = {}

    def text(self, text: str) -> int:
        if ONLY_PYTHON_SPLITS.isdisjoint(text):
            chunks = text.split()
        else:
            chunks = self._chunks(text)
        if len(self) > MAX_CACHED:
            self.clear()
        return sum(map(self.__getitem__, chunks))

    def __missing__(self, chunk: str) -> int:
        count = 0
        for part in self._at_special.split(chunk) if "<|" in chunk else [chunk]:
            if part in self._special:
                count += 1
                continue
            for pretoken in self._split(part):
                known = self._known.get(pretoken)
                count += self.pretoken(pretoken) if known is None else known
        if len(chunk) <= LONGEST_CACHED:
            self[chunk] = count
        return count

    def _split(self, part: str) -> list[str]:
        """Pre-tokens, each written with one character for each byte."""
        plain = unicodedata.normalize("NFC", part)
        if plain.isascii():
            return self._pretokens(plain.lower())
        if max(plain) >= BEYOND_LATIN:
            plain = self._library.normalizer.normalize_str(part)
            return [p for p, _ in self._library.pre_tokenizer.pre_tokenize_str(plain)]
        symbols = self._symbols
        return ["".join([symbols[b] for b in p.encode()]) for p in self._pretokens(plain.lower())]

    def pretoken(self, pretoken: str) -> int:
        """Symbols left of a pre-token after all merges."""
        count = self._merged(list(pretoken))
        if len(pretoken) <= LONGEST_CACHED:
            if len(self._known) > MAX_CACHED:
                self._known.clear()
            self._known[pretoken] = count
        return count

    def _merged(self, symbols: list[str | None]) -> int:
        """Symbols left when no pair has a rank any more."""
        size = len(symbols)
        symbols[-1] += self._end
        rank_of = self._ranks.get
        before, after = list(range(-1, size - 1)), list(range(1, size + 1))
        heap = []
        for at in range(size - 1):
            rank = rank_of((symbols[at], symbols[at + 1]))
            if rank is not None:
                heap.append((rank, at))
        heapify(heap)
        merges = 0
        while heap:
            rank, left = heappop(heap)
            if symbols[left] is None:
                continue
            right = after[left]
            # An entry is out of date once either of its symbols has been merged.
            if right >= size or rank_of((symbols[left], symbols[right])) != rank:
                continue
            symbols[left] += symbols[right]
            symbols[right] = None
            after[left] = following = after[right]
            merges += 1
            if following < size:
                before[following] = left
                new = rank_of((symbols[left], symbols[following]))
                if new is not None:
                    heappush(heap, (new, left))
            if before[left] >= 0:
                new = rank_of((symbols[before[left]], symbols[left]))
                if new is not None:
                    heappush(heap, (new, before[left]))
        return size - merges


@lru_cache(2)
def load(path: str) -> MergeCounter:
    """The counter of a tokenizer file; one per worker process."""
    return MergeCounter(path)


def _counted(batches: Batches, path: str, schema: pa.Schema) -> Batches:
    counter = load(path)
    for batch in batches:
        ids, sizes, texts = batch.columns
        yield batch_of(schema, [ids, sizes, [counter.text(t) for t in texts.to_pylist()]])


def count_tokens(
    docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text.

    ``path`` is a BPE file of the tokenizers library with word ends, which every executor has.
    Strings of its special tokens count one each, as in the library's default. A null text is
    empty and counts 0; repeated rows and null ids stay.
    """
    fields = [pa.int64()] * 3
    schema = pa.schema(list(zip(["doc_id", "n_bytes", "n_tokens"], fields, strict=True)))
    texts = texts_of(docs, id_col, text_col)
    sized = texts.select("id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    task = partial(_counted, path=path, schema=schema)
    counted = arrow_map(sized, task, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
