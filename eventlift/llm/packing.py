"""Best-fit packing of token sequences by linear grouping (operator 10).

A packing depends on lengths alone, and no length exceeds the capacity. So the plan is made
from a histogram of at most ``capacity`` numbers, in intervals of the documents in order of
their length, and applied to the rows without a shuffle:

1. Pieces longer than a part of the capacity are large. In descending order they are cut
   into groups of equal cardinality, and each is rounded up to the longest of its group.
2. Over these few sizes, configurations are chosen one after the other: the largest size left,
   completed by the subset of sizes that fills the sequence best, as often as the groups allow.
3. The actual pieces take the places of the rounded ones, and the true room left is known.
4. Small pieces, in descending order, go where they leave least room; only if none has room
   is a sequence opened.

A plan takes milliseconds, so a few group counts and bounds of smallness are tried and the plan
with the fewest sequences is kept.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlift import Workspace
from eventlift.llm import word_ids
from eventlift.llm.tasks import Batches, arrow_map, batch_of, texts_of

#: Group counts, and parts of the capacity up to which a piece is small, that are tried.
GROUPS = (16, 128, 1024)
SMALL_PARTS = (3, 4, 8)
#: The digits that monotonically_increasing_id() leaves for the row within a partition.
ROW_DIGITS = 33


class Run(NamedTuple):
    """``count`` pieces from ``first`` on (descending by length), ``per`` to a sequence."""

    first: int
    count: int
    sequence: int
    offset: int
    length: int
    per: int


def _pieces_of(packed: bytes, end_id: int, capacity: int) -> list[bytes]:
    data = packed + int(end_id).to_bytes(4, "little")
    return [data[i : i + 4 * capacity] for i in range(0, len(data), 4 * capacity)]


def _cut(
    batches: Batches, path: str, end_id: int, capacity: int, with_ids: bool, schema: pa.Schema
) -> Batches:
    tokenizer = word_ids.load(path)
    for batch in batches:
        ids, texts = (c.to_pylist() for c in batch.columns)
        for start, stop in word_ids.grouped(texts):
            columns: list[list] = [[] for _ in schema]
            for doc, packed in zip(ids[start:stop], tokenizer.texts(texts[start:stop]), strict=True):
                for number, piece in enumerate(_pieces_of(packed, end_id, capacity)):
                    row = (doc, number, number * capacity, len(piece) // 4, zlib.crc32(piece))
                    for column, value in zip(columns, (*row, piece), strict=False):
                        column.append(value)
            yield batch_of(schema, columns)


def cut_pieces(
    docs: DataFrame,
    path: str,
    end_id: int,
    capacity: int,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Every text's ids and the end id, cut into pieces of at most ``capacity``."""
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
    schema = pa.schema(list(zip(names, types, strict=True))[: 6 if with_ids else 5])
    task = partial(
        _cut, path=path, end_id=end_id, capacity=capacity, with_ids=with_ids, schema=schema
    )
    spelled = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return arrow_map(
        texts_of(docs, id_col, text_col), task, spelled + ", ids binary" * with_ids
    )


# -- the plan, from a histogram -------------------------------------------------------------


def _best_subset(sizes: list[int], left: list[int], room: int) -> list[int]:
    """Indices (with repeats, as often as ``left`` allows) of sizes that fill ``room`` best."""
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for index, size in enumerate(sizes):
        for _ in range(min(left[index], room // size)):
            wider = (reach | reach << size) & mask
            if wider == reach:
                break
            steps.append((index, reach))
            reach = wider
    total, chosen = reach.bit_length() - 1, []
    for index, before in reversed(steps):
        if not before >> total & 1:
            chosen.append(index)
            total -= sizes[index]
    return chosen


def configurations(
    sizes: list[int], counts: list[int], capacity: int
) -> list[tuple[list[int], int]]:
    """Configurations (indices of sizes) and how often each is used, until nothing is left."""
    left, chosen = list(counts), []
    for largest in range(len(sizes)):
        while left[largest]:
            left[largest] -= 1
            rest = _best_subset(sizes, left, capacity - sizes[largest])
            left[largest] += 1
            one = [largest, *rest]
            need = {i: one.count(i) for i in one}
            times = min(left[i] // n for i, n in need.items())
            for i, n in need.items():
                left[i] -= n * times
            chosen.append((one, times))
    return chosen


class _Lengths:
    """Lengths by place in descending order, piecewise constant."""

    def __init__(self, histogram: np.ndarray):
        self.lengths = np.nonzero(histogram)[0][::-1]
        self.ends = np.cumsum(histogram[self.lengths])

    def at(self, place: int) -> tuple[int, int]:
        """The length at a place, and the place where a shorter one begins."""
        k = int(np.searchsorted(self.ends, place, "right"))
        return int(self.lengths[k]), int(self.ends[k])


def sequences_of(runs: list[Run]) -> int:
    return max((r.sequence + -(-r.count // r.per) for r in runs), default=0)


def plan(histogram: np.ndarray, capacity: int) -> list[Run]:
    """Runs that place every piece; ``histogram[n]`` is the number of pieces of length n.

    There are at most a few runs for each length and configuration, whatever the counts.
    """
    ids = int((histogram * np.arange(len(histogram))).sum())
    least = max(-(-ids // capacity), int(histogram[capacity // 2 + 1 :].sum()))
    best: list[Run] | None = None
    for small_part in SMALL_PARTS:
        for groups in GROUPS:
            runs = grouped_plan(histogram, capacity, groups, small_part)
            if best is None or sequences_of(runs) < sequences_of(best):
                best = runs
            if sequences_of(best) <= least:
                return best
    return best or []


def grouped_plan(histogram: np.ndarray, capacity: int, groups: int, small_part: int) -> list[Run]:
    """One plan: large pieces in so many groups, small ones up to a part of the capacity."""
    lengths = _Lengths(histogram)
    small = capacity // small_part
    n_large = int(histogram[small + 1 :].sum())
    cardinality = max(1, -(-n_large // groups))
    starts = list(range(0, n_large, cardinality))
    sizes = [lengths.at(s)[0] for s in starts]
    counts = [min(cardinality, n_large - s) for s in starts]
    runs: list[Run] = []
    rooms = _Rooms()
    sequences = 0
    taken = list(starts)
    for chosen, times in configurations(sizes, counts, capacity):
        firsts = []
        for group in chosen:
            firsts.append(taken[group])
            taken[group] += times
        done = 0
        while done < times:  # a stretch over which no place changes its length
            found = [lengths.at(first + done) for first in firsts]
            step = min(times - done, *(end - f - done for (_, end), f in zip(found, firsts, strict=True)))
            offset = 0
            for first, (length, _) in zip(firsts, found, strict=True):
                runs.append(Run(first + done, step, sequences, offset, length, 1))
                offset += length
            rooms.add(capacity - offset, sequences, step)
            sequences += step
            done += step
    place, total = n_large, int(histogram.sum())
    while place < total:
        length, end = lengths.at(place)
        room, sequence, available = rooms.take(length) or (capacity, sequences, None)
        per = room // length
        count = min(end - place, per * available) if available else end - place
        used, partly = divmod(count, per)
        touched = used + (partly > 0)
        if available is None:
            sequences += touched
        elif touched < available:
            rooms.add(room, sequence + touched, available - touched)
        runs.append(Run(place, count, sequence, capacity - room, length, per))
        rooms.add(room - per * length, sequence, used)
        if partly:
            rooms.add(room - partly * length, sequence + used, 1)
        place += count
    return sorted(runs)


class _Rooms:
    """Stretches of sequences by the room left in them."""

    def __init__(self):
        self._rooms: list[int] = []
        self._stretches: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def add(self, room: int, sequence: int, count: int) -> None:
        if room <= 0 or count <= 0:
            return
        if not self._stretches[room]:
            insort(self._rooms, room)
        self._stretches[room].append((sequence, count))

    def take(self, length: int) -> tuple[int, int, int] | None:
        """The stretch with the least room that still holds ``length``."""
        at = bisect_left(self._rooms, length)
        if at == len(self._rooms):
            return None
        room = self._rooms[at]
        sequence, count = self._stretches[room].pop()
        if not self._stretches[room]:
            del self._rooms[at]
        return room, sequence, count


# -- the plan applied to the rows -----------------------------------------------------------


def _placed(
    batches: Batches, before: dict[int, int], total: int, runs: np.ndarray, schema: pa.Schema
) -> Batches:
    for batch in batches:
        marks = batch.column(batch.num_columns - 1).to_numpy()
        parts, rows = marks >> ROW_DIGITS, marks & ((1 << ROW_DIGITS) - 1)
        offsets = np.array([before[p] for p in parts.tolist()], np.int64)
        place = total - 1 - (offsets + rows)  # rows ascend by length, places descend
        run = runs[np.searchsorted(runs[:, 0], place, "right") - 1]
        inside = place - run[:, 0]
        sequence = run[:, 2] + inside // run[:, 5]
        offset = run[:, 3] + inside % run[:, 5] * run[:, 4]
        yield batch_of(schema, [*batch.columns[:-1], sequence, offset])


def pack(
    docs: DataFrame,
    path: str,
    end_id: int = 1,
    capacity: int = 4096,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
    workspace: Workspace | None = None,
) -> DataFrame:
    """One row for each piece: ``doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset``.

    ``path`` is a tokenizer file that every executor has. A null text is empty and becomes a
    piece of the end id alone. Repeated rows are packed each for itself, a null id like any
    other. No row, no sequence. The driver sees a number for each length and each partition.
    """
    spark = docs.sparkSession
    workspace = workspace or Workspace(spark)
    cut = cut_pieces(docs, path, end_id, capacity, with_ids, id_col, text_col)
    pieces = workspace.stage(cut, "pieces")
    by_length = pieces.repartitionByRange("length", "doc_id", "piece").sortWithinPartitions("length")
    ordered = workspace.stage(by_length.withColumn("_mark", F.monotonically_increasing_id()), "ordered")
    in_part = ordered.groupBy(F.shiftright("_mark", ROW_DIGITS).alias("part"))
    sizes = sorted((r["part"], r["n"]) for r in in_part.agg(F.count("*").alias("n")).collect())
    before = dict(zip([p for p, _ in sizes], np.cumsum([0, *(n for _, n in sizes)]).tolist(), strict=False))
    histogram = np.zeros(capacity + 1, np.int64)
    for row in ordered.groupBy("length").agg(F.count("*").alias("n")).collect():
        histogram[row["length"]] = row["n"]
    runs = np.array(plan(histogram, capacity), np.int64).reshape(-1, 6)
    fields = ordered.drop("_mark").schema
    types = {"long": pa.int64(), "integer": pa.int32(), "binary": pa.binary()}
    schema = pa.schema(
        [(f.name, types[f.dataType.typeName()]) for f in fields]
        + [("sequence_id", pa.int64()), ("offset", pa.int64())]
    )
    task = partial(_placed, before=before, total=int(histogram.sum()), runs=runs, schema=schema)
    spelled = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    return arrow_map(ordered, task, f"{spelled}, sequence_id long, offset long")
