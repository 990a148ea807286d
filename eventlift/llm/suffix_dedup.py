"""Repeated byte strings across documents (operator 5).

A byte goes if a string of 100 bytes that covers it also starts earlier in the corpus. Each
such string is represented by one of its substrings, the one of least hash, so that equal
strings have equal representatives. Substrings seen once need no further look. The stretches
of text around the others are brought together by the substring's hash; of equal ones the first
stands for all, and those that differ are sorted there by bucket-pointer refinement: suffixes start in buckets of equal 8-grams; a bucket is refined by
the bucket numbers found 8, 16, 32 bytes further on, and the refined numbers serve the next
round, until strings of one bucket agree in all 100 bytes. Suffixes alone in their bucket
drop out at once.

A substring too frequent for that (if it is so within some texts, its places never meet at its hash)
stands for few strings at a time, grouped by all the bytes
these have in common; and equal stretches met in one task are reduced to the first of them. If
even those groups are too large, every string of theirs goes alone: equal strings of a batch
are reduced to the first, the rest meet by a hash of all their bytes and are read in order, so
that none but the first has to be held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlift import Workspace
from eventlift.llm.tasks import Batches, arrow_map, batch_of, same_rows, unused
from eventlift.llm.words import BASE, _tables, groups, mixed

LENGTH = 100
GRAM = 24
FIRST_GRAM = 8
#: Places of a substring up to which the strings it stands for are taken together, and how
#: many of them are taken together beyond.
HOT = 1000
HOT_STRINGS = 8
#: Tasks among which the stretches of one group are dealt out while it is looked up how many they are.
SPREAD = 16
CHUNK_BYTES = 1 << 18
#: Texts among some half a megabyte of them that have a substring, beyond which it is hot at once; so
#: it is if it has more than ``HOT`` places there.
LOCAL_HOT = 32
#: In the column of places: that a substring is hot, without a place.
IS_HOT = -(1 << 31)
#: Documents without an id are numbered from here on by their text's hash.
AFTER_ALL = 1 << 62


class Strings:
    """The representatives of all strings of ``length`` bytes in some texts.

    ``text, place, hash`` of each, and ``first``/``last``, the starts of the strings it stands
    for; places are bytes from the text's start.
    """

    def __init__(self, texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
        sizes = np.array([len(t) for t in texts], np.int64)
        begins = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(texts), np.uint8)
        width = length - gram + 1
        empty = np.zeros(0, np.int64)
        self.text = self.place = self.first = self.last = empty
        self.hash = empty.astype(np.uint64)
        if len(data) < length:
            return
        powers, inverses = _tables(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=total[1:])
        hashes = mixed((total[gram:] - total[:-gram]) * inverses[: len(data) - gram + 1])
        del total
        least = hashes >> np.uint64(32)
        least <<= np.uint64(32)
        least |= np.arange(len(hashes), dtype=np.uint64)
        span = 1
        while span * 2 <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if width > span:
            least = np.minimum(least[: len(least) - width + span], least[width - span :])
        chosen = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        valid = np.zeros(len(data) + 1, np.int64)
        long = sizes >= length
        np.add.at(valid, begins[long], 1)
        np.add.at(valid, (begins + sizes - length + 1)[long], -1)
        starts = np.nonzero(np.cumsum(valid)[: len(chosen)] > 0)[0]
        chosen = chosen[starts]
        text = np.searchsorted(begins + sizes, starts, "right")
        new = np.nonzero(np.append(True, (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])))[0]
        ends = np.append(new[1:], len(starts)) - 1
        self.text = text[new]
        self.place = chosen[new] - begins[self.text]
        self.hash = hashes[chosen[new]]
        self.first = starts[new] - begins[self.text]
        self.last = starts[ends] - begins[self.text]


def _hash_of(piece: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(piece, digest_size=8).digest(), "little", signed=True)


def _represented(batches: Batches, length: int, local_hot: int, most: int, schema: pa.Schema) -> Batches:
    """``hash, id, place`` of the representatives of all strings.

    Places of a substring that is hot among the texts at hand do not meet at its hash: they come
    as -1 - place under a number of their own, and one row that says ``IS_HOT`` goes to the hash.
    """
    for batch in batches:
        ids, texts = batch.column(0).to_numpy(), batch.column(1).cast(pa.binary()).to_pylist()
        for start, stop in groups(texts):
            s = Strings(texts[start:stop], length)
            key, doc, place = s.hash.copy(), ids[start:stop][s.text], s.place.astype(np.int32)
            ordered = np.sort(key)
            often = np.unique(ordered[local_hot:][ordered[local_hot:] == ordered[:-local_hot]])
            if len(often):
                code = np.minimum(np.searchsorted(often, key), len(often) - 1)
                among = often[code] == key
                # a line that a text repeats some times is not hot for that
                pairs = np.unique(code[among] * len(texts) + s.text[among])
                is_hot = np.bincount(pairs // len(texts), minlength=len(often)) > local_hot
                is_hot |= np.bincount(code[among], minlength=len(often)) > most
                hot, marks = among & is_hot[code], often[is_hot]
                key[hot] = mixed(doc[hot].astype(np.uint64) * np.uint64(BASE) + place[hot].astype(np.uint64))
                place[hot] = -1 - place[hot]
                key, doc = np.concatenate([key, marks]), np.concatenate([doc, np.zeros(len(marks), doc.dtype)])
                place = np.concatenate([place, np.full(len(marks), IS_HOT, np.int32)])
            yield batch_of(schema, [key.view(np.int64), doc, place])


def _runs_by_key(batches: Batches) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Pieces of a table ordered by its first column, each with whether its first key goes on."""
    last = None
    for batch in batches:
        if batch.num_rows:
            keys = batch.column(0).to_numpy()
            yield batch, last is not None and keys[0] == last
            last = keys[-1]


def _repeated(batches: Batches, most: int, schema: pa.Schema) -> Batches:
    """Places whose hash occurs again; ``hot`` if it does so more than ``most`` times, or is said to be.

    Of a hash at most ``most`` places are held until it is known which it is.
    """
    key, held, count, said = None, [], 0, False

    def given(rows: pa.RecordBatch, hot: np.ndarray) -> pa.RecordBatch:
        places = rows.column(2).to_numpy()
        real = places != IS_HOT
        return batch_of(schema, [rows.column(1).to_numpy()[real], places[real], hot[real]])

    def decided(hot: bool) -> pa.RecordBatch:
        rows = pa.concat_batches(held)
        return given(rows, np.full(rows.num_rows, hot))

    def met(rows: Batches) -> Batches:
        for batch in rows:
            places = batch.column(2).to_numpy()
            alone = (places < 0) & (places != IS_HOT)
            if alone.any():
                passed.append(batch_of(schema, [batch.column(1).to_numpy()[alone], -1 - places[alone], alone[alone]]))
                batch = batch.filter(pa.array(~alone))
            yield batch

    passed: list[pa.RecordBatch] = []
    for batch, _ in _runs_by_key(met(batches)):
        yield from passed
        passed.clear()
        keys, marks = batch.column(0).to_numpy(), batch.column(2).to_numpy() == IS_HOT
        edges = np.append(np.nonzero(np.append(True, keys[1:] != keys[:-1]))[0], len(keys))
        sizes, marked = np.diff(edges), np.maximum.reduceat(marks, edges[:-1])
        # Hashes that begin and end in this batch are decided at once.
        inner = np.ones(len(sizes), bool)
        inner[-1] = False
        inner[0] &= key is None or keys[0] != key
        picked = np.repeat(inner & (sizes > 1), sizes)
        if picked.any():
            yield given(batch.filter(pa.array(picked)), np.repeat((sizes > most) | marked, sizes)[picked])
        for at in sorted({0, len(sizes) - 1}):
            if inner[at]:
                continue
            part, value = batch.slice(edges[at], sizes[at]), int(keys[edges[at]])
            if value != key:
                if held and 1 < count:
                    yield decided(False)
                key, held, count, said = value, [], 0, False
            count += part.num_rows
            held.append(part)
            said |= bool(marked[at])
            if count > most or said:
                yield decided(True)
                held = []
    yield from passed
    if held and 1 < count:
        yield decided(False)


def _stretches(batches: Batches, length: int, schema: pa.Schema) -> Batches:
    """Text around repeated representatives: ``key, id, start, bytes``, and whether these are hot.

    A stretch equal to one met just before is not sent; if it comes later in the corpus, its
    strings are repeated and leave as ``start, stop`` of a run, with no bytes.
    """
    common = length - HOT_STRINGS + 1
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
        places, hots = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        for begin, end in groups(texts):
            s = Strings(texts[begin:end], length)
            hot_of = {
                i << 32 | p: hot
                for i in range(end - begin)
                for p, hot in zip(places[begin + i], hots[begin + i], strict=True)
            }
            codes = s.text << 32 | s.place
            wanted = np.nonzero(np.isin(codes, np.fromiter(hot_of, np.int64, len(hot_of))))[0]
            columns = (codes, s.text, s.place, s.hash.view(np.int64), s.first, s.last)
            rows: list[tuple[int, int, bytes, int, bool]] = []
            for code, text, place, key, first, last in zip(*(c[wanted].tolist() for c in columns), strict=True):
                data, doc = texts[begin + text], ids[begin + text]
                if not hot_of[code]:
                    rows.append((doc, first, data[first : last + length], key, False))
                    continue
                # Strings go by how far in front of the representative they start, some at a
                # time; those have all but a few bytes in common.
                for near in range((place - last) // HOT_STRINGS, (place - first) // HOT_STRINGS + 1):
                    latest = place - near * HOT_STRINGS
                    a, b = max(first, latest - HOT_STRINGS + 1), min(last, latest)
                    shared = data[latest : latest + common] + near.to_bytes(2, "little")
                    rows.append((doc, a, data[a : b + length], _hash_of(shared), True))
            yield from _first_of_equal(rows, length, schema)


def _first_of_equal(rows: list[tuple[int, int, bytes, int, bool]], length: int, schema: pa.Schema) -> Batches:
    rows.sort(key=lambda r: (r[0], r[1]))
    seen, sent, runs = {}, [], []
    for doc, start, data, key, hot in rows:
        mark = (key, data)
        if mark in seen and seen[mark] != (doc, start):
            runs.append((doc, start, start + len(data) - length + 1))
        elif mark not in seen:
            seen[mark] = (doc, start)
            sent.append((key, doc, start, data, hot))
    if sent:
        key, doc, start, data, hot = zip(*sent, strict=True)
        yield batch_of(schema, [key, doc, start, [0] * len(sent), data, hot])
    if runs:
        doc, start, stop = zip(*runs, strict=True)
        nothing = [None] * len(runs)
        yield batch_of(schema, [nothing, doc, start, stop, nothing, [False] * len(runs)])


# -- strings that go alone ------------------------------------------------------------------


def _strings(batches: Batches, length: int, schema: pa.Schema) -> Batches:
    """The strings of some stretches: two halves of a hash of all their bytes, ``id, start``.

    Of equal strings in a batch only the first is sent; the others leave as ``start, stop`` of
    a run, without a hash. So a string has at most one row for each batch.
    """
    for batch in batches:
        rows = sorted(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
        seen: dict[bytes, tuple[int, int]] = {}
        runs: list[tuple[int, int, int]] = []
        for doc, begin, data in rows:
            for start in range(begin, begin + len(data) - length + 1):
                string = data[start - begin : start - begin + length]
                if seen.setdefault(string, (doc, start)) == (doc, start):
                    continue
                if runs and runs[-1][0] == doc and runs[-1][2] == start:
                    runs[-1] = (doc, runs[-1][1], start + 1)
                else:
                    runs.append((doc, start, start + 1))
        if seen:
            digests = b"".join(hashlib.blake2b(string, digest_size=16).digest() for string in seen)
            halves = np.frombuffer(digests, np.int64).reshape(-1, 2)
            doc, start = zip(*seen.values(), strict=True)
            yield batch_of(schema, [halves[:, 0], halves[:, 1], doc, start, [0] * len(seen)])
        if runs:
            doc, start, stop = zip(*runs, strict=True)
            nothing = [None] * len(runs)
            yield batch_of(schema, [nothing, nothing, doc, start, stop])


def _later(batches: Batches, schema: pa.Schema) -> Batches:
    """Runs of the strings but the first of each hash, from rows ordered by hash, id and start."""
    head = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)], 1)
        if head is not None:
            rows = np.concatenate([head, rows])
        new = np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(1))
        heads = rows[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
        again = rows[(heads[:, 2:] != rows[:, 2:]).any(1)]
        head = heads[-1:]
        if len(again):
            yield batch_of(schema, [again[:, 2], again[:, 3], again[:, 3] + 1])


# -- bucket-pointer refinement --------------------------------------------------------------


def refined(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """A number for the string of ``length`` bytes at each start, equal for equal strings."""
    padded = np.concatenate([data, np.zeros(2 * length, np.uint8)]).astype(np.uint64)
    gram = padded[: len(data)]
    depth = 1
    grams = padded
    while depth < FIRST_GRAM:
        grams = grams[:-depth] << np.uint64(8 * depth) | grams[depth:]
        depth *= 2
    gram = grams[: len(data)]
    _, bucket, counts = np.unique(gram, return_inverse=True, return_counts=True)
    pointer = np.zeros(len(data) + 2 * length, np.int64)
    pointer[: len(data)] = bucket
    shared = np.nonzero(counts[bucket] > 1)[0]  # suffixes not alone in their bucket
    numbers = len(counts)
    while depth < length:
        step = min(depth, length - depth)
        if depth + step == length:  # the last round needs the starts alone
            shared = starts[np.isin(starts, shared, assume_unique=True)]
        pairs = pointer[shared] * np.int64(numbers) + pointer[shared + step]
        _, bucket, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        pointer[shared] = numbers + bucket
        numbers += len(counts)
        shared = shared[counts[bucket] > 1]
        depth += step
    return pointer[starts]


def _again(
    ids: np.ndarray, begins: np.ndarray, stretches: list[bytes], length: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (document, start, stop) of strings in the stretches that also start earlier."""
    sizes = np.array([len(s) for s in stretches], np.int64)
    offsets = np.cumsum(sizes) - sizes
    strings = sizes - length + 1
    row = np.repeat(np.arange(len(sizes)), strings)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(strings) - strings, strings)
    number = refined(np.frombuffer(b"".join(stretches), np.uint8), offsets[row] + inside, length)
    doc, start = ids[row], begins[row] + inside
    order = np.lexsort((start, doc, number))
    new = np.append(True, number[order][1:] != number[order][:-1])
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    again = np.zeros(len(row), bool)
    again[order] = (doc[head] != doc[order]) | (start[head] != start[order])
    edge = np.append(True, (row[1:] != row[:-1]) | (again[1:] != again[:-1]))
    first = np.nonzero(edge)[0]
    last = np.append(first[1:], len(row)) - 1
    first, last = first[again[first]], last[again[first]]
    return doc[first], start[first], start[last] + 1


def _first_stretches(
    keys: np.ndarray, ids: np.ndarray, begins: np.ndarray, stretches: pa.Array, length: int
) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Which stretches are to be refined, and runs (document, start, stop) of strings known to start earlier.

    All strings of a stretch also start in the first of those equal to it, which alone stands for
    them. Equal strings have their representative at the same distance, so those of one
    stretch all differ, and a key whose stretches are all equal needs no refinement.
    """
    code = stretches.dictionary_encode().indices.to_numpy()
    order = np.lexsort((begins, ids, code, keys))
    key, code, doc, start = keys[order], code[order], ids[order], begins[order]
    new = np.append(True, (key[1:] != key[:-1]) | (code[1:] != code[:-1]))
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    again = np.nonzero((doc[head] != doc) | (start[head] != start))[0]
    stop = start[again] + pc.binary_length(stretches).to_numpy()[order[again]] - length + 1
    first, key = order[new], key[new]
    edge = np.concatenate([[True], key[1:] != key[:-1], [True]])
    return first[~(edge[1:] & edge[:-1])], (doc[again], start[again], stop)


def _compared(batches: Batches, length: int, schema: pa.Schema) -> Batches:
    """Runs of repeated strings from stretches ordered by key; keys are compared whole.

    No key has more stretches than a substring may have places before it is hot.
    """

    def flushed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.concat_batches(held)
        keys, ids, begins = (rows.column(i).to_numpy() for i in range(3))
        begins = begins.astype(np.int64)
        first, found = _first_stretches(keys, ids, begins, rows.column(4), length)
        if len(first):
            more = _again(ids[first], begins[first], rows.column(4).take(pa.array(first)).to_pylist(), length)
            found = [np.concatenate(pair) for pair in zip(found, more, strict=True)]
        return batch_of(schema, list(found))

    held: list[pa.RecordBatch] = []
    size = 0
    for batch, goes_on in _runs_by_key(batches):
        keys = batch.column(0).to_numpy()
        if size >= CHUNK_BYTES:
            border = int(np.searchsorted(keys, keys[0], "right")) if goes_on else 0
            if border < len(keys):
                yield flushed([*held, batch.slice(0, border)])
                held, size, batch = [], 0, batch.slice(border)
        held.append(batch)
        size += batch.nbytes
        if size >= CHUNK_BYTES:
            keys = batch.column(0).to_numpy()
            border = int(np.searchsorted(keys, keys[-1], "left"))
            if border:
                yield flushed([*held[:-1], batch.slice(0, border)])
                held = [batch.slice(border)]
                size = held[0].nbytes
    if held:
        yield flushed(held)


# -- the whole ------------------------------------------------------------------------------


def covered(starts: list[int], stops: list[int], length: int) -> list[tuple[int, int]]:
    """Maximal stretches of bytes covered by strings that start in the runs."""
    spans: list[tuple[int, int]] = []
    for start, stop in sorted(zip(starts, stops, strict=True)):
        end = stop - 1 + length
        if spans and start <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(end, spans[-1][1]))
        else:
            spans.append((start, end))
    return spans


def _cut(batches: Batches, length: int, schema: pa.Schema) -> Batches:
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
        rows = []
        for doc, data, starts, stops in zip(ids, texts, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            spans = covered(starts or [], stops or [], length)
            kept, at = [], 0
            for start, end in spans:
                kept.append(data[at:start])
                at = end
            rows.append((doc, len(data), sum(e - s for s, e in spans), len(spans), b"".join([*kept, data[at:]])))
        if rows:
            yield batch_of(schema, list(zip(*rows, strict=True)))


def repeated_runs(
    texts: DataFrame, length: int, workspace: Workspace, hot: int = HOT, local_hot: int = LOCAL_HOT
) -> DataFrame:
    """``id, start, stop``: runs of starts whose strings also start earlier; ``texts`` has id, text."""
    prints = texts.where(F.octet_length("text") >= length).select(
        "id", F.md5("text").alias("print"), F.octet_length("text").alias("bytes")
    )
    prints = workspace.stage(prints, "prints")
    earliest = prints.groupBy("print").agg(F.min("id").alias("earliest"))
    copies = prints.join(earliest, "print").where("id > earliest").select("id", F.lit(0).alias("start"), (F.col("bytes") - length + 1).alias("stop"))
    copies = workspace.stage(copies, "copies")

    place_schema = pa.schema([("hash", pa.int64()), ("id", pa.int64()), ("place", pa.int32())])
    task = partial(_represented, length=length, local_hot=local_hot, most=hot, schema=place_schema)
    represented = arrow_map(texts, task, "hash long, id long, place int")
    by_hash = represented.repartition("hash").sortWithinPartitions("hash")
    again_schema = pa.schema([("id", pa.int64()), ("place", pa.int32()), ("hot", pa.bool_())])
    again = arrow_map(by_hash, partial(_repeated, most=hot, schema=again_schema), "id long, place int, hot boolean")
    again = workspace.stage(again, "again")
    # A copy's strings all start earlier, and none of them is the first of its kind.
    places = again.join(copies.select("id"), "id", "left_anti").groupBy("id")
    places = places.agg(F.collect_list(F.struct("place", "hot")).alias("p"))
    beside = texts.join(places, "id").select("id", "text", "p.place", "p.hot")
    names = ["key", "id", "start", "stop", "bytes", "hot"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()]
    schema = pa.schema(list(zip(names, types, strict=True)))
    task = partial(_stretches, length=length, schema=schema)
    spelled = "key long, id long, start int, stop int, bytes binary, hot boolean"
    stretches = workspace.stage(arrow_map(beside, task, spelled), "stretches")
    run_schema = pa.schema([("id", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])
    spelled = "id long, start int, stop int"

    # Groups of a hot substring that are themselves too large to meet in a task.
    from_hot = stretches.where("hot AND key IS NOT NULL")
    large = from_hot.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("key")
    large = workspace.stage(large.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))), "large")
    dealt = from_hot.withColumn("part", F.pmod(F.xxhash64("id", "start"), F.lit(SPREAD)).cast("int"))
    alone = dealt.join(large, ["key", "part"], "left_semi").select("id", "start", "bytes")
    names = ["p", "q", "id", "start", "stop"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    task = partial(_strings, length=length, schema=pa.schema(list(zip(names, types, strict=True))))
    strings = workspace.stage(arrow_map(alone, task, "p long, q long, id long, start int, stop int"), "strings")
    by_string = strings.where("p IS NOT NULL").select("p", "q", "id", "start")
    by_string = by_string.repartition("p", "q").sortWithinPartitions("p", "q", "id", "start")
    later = arrow_map(by_string, partial(_later, schema=run_schema), spelled)

    rest = dealt.join(large, ["key", "part"], "left_anti").select(*stretches.columns)
    by_key = stretches.where("NOT hot AND key IS NOT NULL").unionAll(rest)
    by_key = by_key.drop("hot").repartition("key").sortWithinPartitions("key")
    found = arrow_map(by_key, partial(_compared, length=length, schema=run_schema), spelled)
    local = stretches.where("key IS NULL").select("id", "start", "stop")
    local = local.unionAll(strings.where("p IS NULL").select("id", "start", "stop"))
    return workspace.stage(found.unionAll(later).unionAll(local).unionAll(copies), "runs")


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id`` and ``text`` without nulls, and the row itself."""
    after = F.xxhash64(docs[text_col]).bitwiseAND(F.lit(AFTER_ALL - 1)) + F.lit(AFTER_ALL)
    return docs.select(
        F.coalesce(docs[id_col].cast("long"), after).alias("id"),
        F.coalesce(docs[text_col], F.lit("")).alias("text"),
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"),
    )


def remove_repeats(
    docs: DataFrame,
    length: int = LENGTH,
    id_col: str = "doc_id",
    text_col: str = "text",
    workspace: Workspace | None = None,
    hot: int = HOT,
    local_hot: int = LOCAL_HOT,
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (the bytes that stay) for every row.

    A byte goes if ``length`` bytes that cover it, within its document, also start earlier: in
    a document of smaller id, or further left in the same. Null texts are empty, texts shorter
    than ``length`` stay whole. An id, below 2**62, names one text: a repeated row stays like
    the first. Rows without an id come after all others, in the order of their texts' hashes.
    """
    workspace = workspace or Workspace(docs.sparkSession)
    texts = _numbered(docs, id_col, text_col).select("id", "text")
    runs = repeated_runs(texts, length, workspace, hot, local_hot)
    per_doc = runs.groupBy("id").agg(F.collect_list(F.struct("start", "stop")).alias("r"))
    beside = texts.join(per_doc, "id", "left").select("id", "text", "r.start", "r.stop")
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept"]
    schema = pa.schema(list(zip(names, [pa.int64()] * 4 + [pa.binary()], strict=True)))
    task = partial(_cut, length=length, schema=schema)
    cut = arrow_map(beside, task, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    doc_id = F.when(F.col("id") < AFTER_ALL, F.col("id"))
    return cut.select(doc_id.alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")


def _cut_rows(batches: Batches, length: int, text_at: int) -> Batches:
    """Rows with their texts cut; the last two columns, starts and stops of runs, become null."""
    for batch in batches:
        starts, stops = (batch.column(batch.num_columns - k).to_pylist() for k in (2, 1))
        texts = batch.column(text_at).cast(pa.binary()).to_pylist()
        out = []
        for data, first, last in zip(texts, starts, stops, strict=True):
            for start, end in reversed(covered(first, last, length)) if first else ():
                data = data[:start] + data[end:]
            out.append(data if data is None else data.decode("utf-8", "ignore"))
        columns = list(batch.columns)
        columns[text_at] = pa.array(out, batch.schema.field(text_at).type)
        for k in (2, 1):
            columns[-k] = pa.nulls(batch.num_rows, batch.schema.field(batch.num_columns - k).type)
        yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)


def without_repeats(
    docs: DataFrame,
    length: int = LENGTH,
    id_col: str = "doc_id",
    text_col: str = "text",
    workspace: Workspace | None = None,
) -> DataFrame:
    """``docs`` with what ``remove_repeats`` removes cut out of the texts.

    Of a character cut in part nothing stays. Null texts stay null.
    """
    workspace = workspace or Workspace(docs.sparkSession)
    numbered = _numbered(docs, id_col, text_col)
    runs = repeated_runs(numbered.select("id", "text"), length, workspace)
    per_doc = runs.groupBy("id").agg(F.collect_list(F.struct("start", "stop")).alias("r"))
    beside = numbered.drop("text").join(per_doc, "id", "left")
    start, stop = (unused(name, docs.columns) for name in ("start", "stop"))
    flat = beside.select(
        *[F.col(f"row.`{c}`").alias(c) for c in docs.columns], F.col("r.start").alias(start), F.col("r.stop").alias(stop)
    )
    cut = same_rows(flat, partial(_cut_rows, length=length, text_at=docs.columns.index(text_col)))
    return cut.select(*[f"`{c}`" for c in docs.columns])
