"""Stretches of words that repeat with a period, and texts without the repeats.

A run is a stretch of words with smallest period q, of at least ``exponent`` * q and ``min_words``
words, that no neighbouring word extends. Words are runs of characters other than ASCII white space.

Periods are searched an octave [P, 2P) at a time, in tiles that overlap by six times P. A tile has a
boundary every P words. The Z-function of a boundary b says for a shift q how many words from b
on equal those from b + q on; here it is asked for all q of the octave at once whether it reaches P,
by hashes of P words (hashes only choose, every stretch found is compared word by word). Three
periods of a run hold two boundaries in a row with the same q; stretches of these are followed
to their ends or those of the tile.

A document that fits into a tile is one, and is solved where it is read. Of longer documents the
tiles of all octaves become rows, dealt out among tasks, and what each finds of a period (fragments
of the places i with word i = word i + q) is shuffled by document and period and stitched: fragments
of one run overlap, those of two never touch. Work is n log n words whatever they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlift.llm.tasks import Batches, arrow_map, batch_of, texts_of
from eventlift.llm.words import mixed
from eventlift.sources.workspace import Workspace

#: Words of a tile besides its overlap, unless the octave needs more.
TILE_WORDS = 1 << 14
BATCH_BYTES, BATCH_ROWS = 2 << 20, 4096
PLAIN, WHOLE, FRAGMENT, TILE = range(4)
_BASE = np.uint64(0x9E3779B97F4A7C15)

_FOUND = pa.schema(
    [("row", pa.int64()), ("id", pa.int64()), ("kind", pa.int32()), ("n_words", pa.int64()),
     ("period", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("words", pa.binary()),
     ("digest", pa.string())]
)
_FOUND_SQL = "row long, id long, kind int, n_words long, period long, start long, stop long, words binary, digest string"
_RUN = pa.struct([("start", pa.int64()), ("period", pa.int64()), ("length", pa.int64())])
_ENDED = pa.schema(
    [("id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("text", pa.string()), ("digest", pa.string())]
)
_ENDED_SQL = "id long, n_words long, runs array<struct<start: bigint, period: bigint, length: bigint>>, text string, digest string"

_smallest = np.arange(2)


def _smallest_factors(size: int) -> np.ndarray:
    """The smallest prime factor of each number below ``size``."""
    global _smallest
    if len(_smallest) < size:
        size = max(size, 2 * len(_smallest))
        _smallest = np.arange(size)
        for p in range(2, int(size**0.5) + 1):
            if _smallest[p] == p:
                multiples = _smallest[p * p :: p]
                multiples[multiples == np.arange(p * p, size, p)] = p
    return _smallest


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))


def _primitive(h: np.ndarray, at: np.ndarray, q: np.ndarray, p: int) -> np.ndarray:
    """Whether the q words from ``at`` on have no period that divides q."""
    whole, rest = np.ones(len(q), bool), q.copy()
    factors = _smallest_factors(int(q.max(initial=1)) + 1)
    while (open_ := rest > 1).any():
        f = np.where(open_, factors[rest], 1)
        d = np.where(open_, q // f, 0)
        last = at + q - p
        whole &= ~(open_ & (h[at] == h[at + d]) & (h[last] == h[last + d]))
        rest //= f
    return whole


def solved(words: np.ndarray, least: int, below: int, longest: int) -> Iterator[tuple[int, int, int]]:
    """Fragments (q, start, stop) of a tile for the octaves from ``least`` up to ``below``.

    Word i equals word i + q for i from start to stop, and not for the neighbours within the tile.
    No period is beyond ``longest``, and none is a multiple of a smaller one.
    """
    size = len(words)
    h = mixed(words.astype(np.uint64) + np.uint64(1))
    p = 1
    while p < below and 3 * p <= size and p <= longest:
        if p >= least:
            rows = size // p - 1  # boundaries with room for the shift p
            ahead = np.zeros((rows + 1) * p, np.uint64)
            held = h[p : p + len(ahead)]
            ahead[: len(held)] = held
            z = ahead[: rows * p].reshape(rows, p) == h[: rows * p : p][:, None]
            row, shift = np.nonzero(z[:-1] & z[1:])
            if len(row):
                yield from _followed(words, h, p, row, shift + p, longest)
        if len(h) <= p:
            break
        h = mixed(h[:-p] * _BASE + h[p:])
        p *= 2


def _followed(
    words: np.ndarray, h: np.ndarray, p: int, row: np.ndarray, q: np.ndarray, longest: int
) -> Iterator[tuple[int, int, int]]:
    """Boundaries in a row with the same shift as one stretch, followed to its ends."""
    size = len(words)
    order = np.lexsort((row, q))
    row, q = row[order], q[order]
    fresh = np.concatenate([[True], (q[1:] != q[:-1]) | (row[1:] != row[:-1] + 1)])
    heads = np.flatnonzero(fresh)
    tails = np.concatenate([heads[1:], [len(row)]]) - 1
    first, last, q = row[heads] * p, row[tails] * p + 2 * p, q[heads]
    good = (q <= longest) & _primitive(h, first, q, p)
    for s, e, shift in zip(first[good].tolist(), last[good].tolist(), q[good].tolist()):
        low, high = max(0, s - p), min(e + p, size - shift)
        other = np.flatnonzero(words[low:high] != words[low + shift : high + shift])
        edges = np.concatenate([[-1], other, [high - low]])
        for k in np.flatnonzero(np.diff(edges) > 2 * p).tolist():
            yield shift, low + int(edges[k]) + 1, low + int(edges[k + 1])


def tiles(words: np.ndarray, tile_words: int, exponent: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Octave, start and words of the overlapping tiles of a long document."""
    size, p = len(words), 1
    while exponent * p <= size:
        core = -(-max(tile_words, 8 * p) // p) * p
        for start in range(0, size, core):
            begin = max(0, start - p)
            yield p, begin, words[begin : start + core + 5 * p]
        p *= 2


class _Rows:
    """Rows of a schema, given out in batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, row: tuple, size: int = 0) -> Batches:
        self.rows.append(row)
        self.size += size
        if self.size >= BATCH_BYTES or len(self.rows) >= BATCH_ROWS:
            yield from self.rest()

    def rest(self) -> Batches:
        if self.rows:
            yield batch_of(self.schema, list(zip(*self.rows)))
            self.rows, self.size = [], 0


def _cut(tile_words: int, exponent: int, min_words: int, texts: bool):
    """A task over documents: those of one tile are solved, longer ones become tiles."""

    def cut(batches: Batches) -> Batches:
        out = _Rows(_FOUND)
        for batch in batches:
            for at, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                split = text.encode().split()
                n, found = len(split), []
                if n > tile_words:
                    numbers = word_numbers(split)
                    for p, start, part in tiles(numbers, tile_words, exponent):
                        yield from out.add((at, key, TILE, n, p, start, None, part.tobytes(), None), part.nbytes)
                elif n >= max(min_words, exponent):
                    # all places of a run are in this tile, so that short stretches go at once
                    for q, start, stop in solved(word_numbers(split), 1, n, n // exponent):
                        if stop - start >= max((exponent - 1) * q, min_words - q):
                            found.append((at, key, FRAGMENT, n, q, start, stop, None, None))
                    for row in found:
                        yield from out.add(row)
                joined = b" ".join(split)
                if found or n > tile_words:
                    yield from out.add((at, key, WHOLE, n, None, None, None, joined, None), len(joined))
                else:
                    digest = hashlib.sha256(joined).hexdigest()
                    held = joined if texts else None
                    yield from out.add((at, key, PLAIN, n, None, None, None, held, digest), len(held or b""))
        yield from out.rest()

    return cut


def _solve_tiles(exponent: int):
    def solve(batches: Batches) -> Batches:
        out = _Rows(_FOUND)
        for batch in batches:
            for tile in batch.to_pylist():
                words = np.frombuffer(tile["words"], np.int32)
                p, longest = tile["period"], tile["n_words"] // exponent
                for q, start, stop in solved(words, p, p + 1, longest):
                    at = tile["start"]
                    row = (tile["row"], tile["id"], FRAGMENT, tile["n_words"], q, at + start, at + stop, None, None)
                    yield from out.add(row)
        yield from out.rest()

    return solve


def _collapsed(texts: bool):
    """A task that drops the repeats; a run keeps its first period."""

    def collapse(batches: Batches) -> Batches:
        out = _Rows(_ENDED)
        for batch in batches:
            for key, n, runs, joined in zip(*(c.to_pylist() for c in batch.columns)):
                words = joined.split()
                edges = np.zeros(n + 1, np.int32)
                for run in runs or []:
                    edges[run["start"] + run["period"]] += 1
                    edges[run["start"] + run["length"]] -= 1
                dropped = np.cumsum(edges[:-1]) > 0
                kept = b" ".join(w for w, d in zip(words, dropped.tolist()) if not d)
                text = kept.decode() if texts else None
                row = (key, n, runs or [], text, hashlib.sha256(kept).hexdigest())
                yield from out.add(row, len(text or ""))
        yield from out.rest()

    return collapse


def stitched(fragments: DataFrame, exponent: int, min_words: int) -> DataFrame:
    """Runs ``row, start, length, period`` of fragments of places, shuffled by document and period."""
    before = Window.partitionBy("row", "period").orderBy("start", "stop")
    reach = F.max("stop").over(before.rowsBetween(Window.unboundedPreceding, -1))
    apart = fragments.withColumn("fresh", F.when(F.col("start") > reach, 1).otherwise(0))
    whole = (
        apart.withColumn("run", F.sum("fresh").over(before.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("row", "period", "run")
        .agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    )
    least = f"stop - start >= greatest({exponent - 1} * period, {min_words} - period)"
    return whole.where(least).selectExpr("row", "start", "stop - start + period AS length", "period")


def collapse_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    exponent: int = 4,
    min_words: int = 6,
    tile_words: int = TILE_WORDS,
    texts: bool = True,
) -> DataFrame:
    """``id, n_words, runs, text, digest`` of each row.

    ``runs`` are structs of start (a word's number), length and period, by start, then period.
    ``text`` holds the words that no run contains after its first period, joined by one space (null
    with ``texts=False``), ``digest`` its SHA-256 in UTF-8. A null text is empty, a text without
    words has no runs. Rows that share an id, or are equal, are documents of their own; a null id
    stays null. Other columns, whatever their names, are left out. ``exponent`` is 4 or more.
    """
    if exponent < 4:
        raise ValueError("three periods must hold two boundaries: exponent is 4 or more")
    workspace = Workspace(docs.sparkSession)
    rows = texts_of(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("row"), "id", "text")
    found = workspace.stage(arrow_map(rows, _cut(tile_words, exponent, min_words, texts), _FOUND_SQL), "found")
    dealt = found.where(f"kind = {TILE}").repartition("row", "period", "start")
    of_tiles = arrow_map(dealt, _solve_tiles(exponent), _FOUND_SQL)
    fragments = found.where(f"kind = {FRAGMENT}").unionAll(of_tiles).select("row", "period", "start", "stop")
    runs = stitched(fragments, exponent, min_words)
    lists = runs.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    whole = found.where(f"kind = {WHOLE}").select("row", "id", "n_words", "words")
    joined = whole.join(lists, "row", "left").select("id", "n_words", "runs", "words")
    plain = found.where(f"kind = {PLAIN}").selectExpr(
        "id", "n_words", "CAST(array() AS array<struct<start: bigint, period: bigint, length: bigint>>) AS runs",
        "CAST(words AS STRING) AS text", "digest",
    )
    return arrow_map(joined, _collapsed(texts), _ENDED_SQL).unionAll(plain)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Numbers and checksums of ``collapse_runs``; the longest run (least start, then period)."""
    found = collapse_runs(docs, id_col, text_col, texts=False)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumns({"best": best, "listed": F.array_join(listed, "")}).selectExpr(
        f"id AS {id_col}", "CAST(size(runs) AS BIGINT) AS n_runs", "-best.col2 AS start", "best.length",
        "-best.col3 AS period", "CAST(1000 * best.length DIV -best.col3 AS BIGINT) AS exponent_milli",
        "sha2(listed, 256) AS runs_sha256", "digest AS collapsed_sha256",
    )
