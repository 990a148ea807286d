"""Token-id files by an adaptive context-mixing range coder (operator 2).

A file holds blocks of about half a million ids. Each block starts from an empty model and
carries checksums, so it can be read alone. Inside a block the ids are cut into lanes that
are coded in step, one id of each lane at a time, by one model they share: it predicts from
what all lanes held in earlier steps, which the decoder knows as well.

The model predicts an id from the two before it (order 2), one from the one before (order 1),
and a frequency for every id (order 0). Whether the first prediction holds is coded with a
probability mixed in the logistic domain from the confidence of all three orders; then
whether another order-1 prediction holds that did so before; what is left is coded by the order-0
frequencies, or an escape, behind which an id not seen before stands in a list of its own. Predictions
learn at every step, chances and frequencies every few. All arithmetic is on integers, so every
machine decodes alike.

Blocks are rows of a Parquet table, which gives the files Spark's commit protocol and works
on any store that Spark can write.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlift import Workspace
from eventlift.llm import word_ids
from eventlift.llm.tasks import Batches, arrow_map, batch_of, texts_of

MAGIC = b"IDCM2\n"
STEPS = 128
BLOCK_IDS = 1 << 19
WORD = 24  # bits moved at once between a lane's range and its stream
FLOOR = np.uint64(1 << WORD)
FULL = np.uint64(1 << 2 * WORD)
LOW = np.uint64((1 << WORD) - 1)
BITS, HALF = np.uint64(WORD), np.uint64(16)
CONTEXT_BITS = 20
FIRST, SECOND = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
SURE_BITS = 3
CONFIDENT = (1 << SURE_BITS) - 1
MIXED = (16, 16, 8)  # confidences of orders 0, 1 (and whether it predicts the same id) and 2
ODDS = np.int32(1 << 2 * SURE_BITS)
# How often in a row a prediction held changes by how often it had: halved if it is wrong, one more if right.
RIGHT = np.int32(1 << SURE_BITS)
CHANGES = np.array([*(-(n + 1 >> 1) for n in range(CONFIDENT + 1)), *[1] * CONFIDENT, 0], np.int32)
REBUILT_EVERY = 8
FORGOTTEN_AT = 1 << 17  # symbols coded by frequency, whose counts are then halved
LARGEST = 1 << 24  # all ids are below
BLOCK_SCHEMA = (
    "part int, number int, start long, n_docs int, n_tokens long, cut boolean, block binary"
)


class DamagedBlock(ValueError):
    """A block whose checksum does not hold."""


# -- range coder over lanes -----------------------------------------------------------------


class LaneEncoder:
    """One range coder for each lane; a carry is added to the words before it at the end.

    ``lanes`` is a slice from the first lane on or an array of distinct lanes.
    """

    def __init__(self, lanes: int):
        self.low = np.zeros(lanes, np.uint64)
        self.range = np.full(lanes, FULL, np.uint64)
        self.sent: list[tuple[np.ndarray, np.ndarray]] = []  # lanes, a word for each
        self.escaped = [np.zeros(0, np.int32)]

    def _narrow(self, lanes: slice | np.ndarray, low: np.ndarray, width: np.ndarray) -> None:
        small = (width < FLOOR).nonzero()[0]
        if len(small):
            out = low[small]
            self.sent.append((small if isinstance(lanes, slice) else lanes[small], out >> BITS))
            low[small] = (out & LOW) << BITS
            width[small] <<= BITS
        self.low[lanes], self.range[lanes] = low, width

    def bits(self, lanes: slice | np.ndarray, ones: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """Code a bit for each lane, ``ones`` of 65,536 being the chance of a one."""
        width = self.range[lanes]
        edge = (width >> HALF) * ones
        self._narrow(lanes, self.low[lanes] + edge * ~bits, np.where(bits, edge, width - edge))
        return bits

    def symbols(self, lanes: np.ndarray, order0: _Frequencies, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code an id by its frequency, or the escape; gives the ids and where an escape stands for them."""
        unit = self.range[lanes] >> order0.bits
        below, wide = order0.shares_of(ids)
        self._narrow(lanes, self.low[lanes] + unit * below, unit * wide)
        return ids, (below == 0).nonzero()[0]

    def new(self, ids: np.ndarray) -> None:
        """Note ids for which an escape stands."""
        self.escaped.append(ids)

    def streams(self) -> tuple[np.ndarray, np.ndarray, bytes]:
        """Ids behind escapes, words in each lane, and all words as three bytes each."""
        every = np.arange(len(self.low))
        self.sent += [(every, self.low >> BITS), (every, self.low & LOW)]
        lanes, words = (np.concatenate(column) for column in zip(*self.sent, strict=True))
        order = np.argsort(lanes.astype(np.uint16) if len(every) <= 1 << 16 else lanes, kind="stable")
        words = words.astype(np.uint32)[order]
        while (over := words >> np.uint32(WORD)).any():  # never from a lane's first word
            words &= np.uint32(LOW)
            words[:-1] += over[1:]
        packed = np.ascontiguousarray(words.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:]).tobytes()
        return np.concatenate(self.escaped), np.bincount(lanes, minlength=len(every)), packed


class LaneDecoder:
    def __init__(self, escaped: np.ndarray, used: np.ndarray, data: bytes):
        self.escaped, self.known = escaped, 0
        wide = np.zeros((len(data) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(data, np.uint8).reshape(-1, 3)
        self.words = np.append(wide.view(">u4").ravel().astype(np.uint32), np.zeros(3, np.uint32))
        self.at = np.cumsum(used) - used
        self.range = np.full(len(used), FULL, np.uint64)
        self.code = self.words[self.at].astype(np.uint64) << BITS | self.words[self.at + 1]
        self.at += 2

    def _narrow(self, lanes: slice | np.ndarray, code: np.ndarray, width: np.ndarray) -> None:
        small = (width < FLOOR).nonzero()[0]
        if len(small):
            which = small if isinstance(lanes, slice) else lanes[small]
            at = self.at[which]
            code[small] = code[small] << BITS | self.words[at]
            self.at[which] = at + 1
            width[small] <<= BITS
        self.code[lanes], self.range[lanes] = code, width

    def bits(self, lanes: slice | np.ndarray, ones: np.ndarray, _: None) -> np.ndarray:
        width, code = self.range[lanes], self.code[lanes]
        edge = (width >> HALF) * ones
        bits = code < edge
        self._narrow(lanes, code - edge * ~bits, np.where(bits, edge, width - edge))
        return bits

    def symbols(self, lanes: np.ndarray, order0: _Frequencies, _: None) -> tuple[np.ndarray, np.ndarray]:
        unit, code = self.range[lanes] >> order0.bits, self.code[lanes]
        ids = order0.ids_at(code // unit)
        below, wide = order0.shares_of(ids)
        self._narrow(lanes, code - unit * below, unit * wide)
        return ids, (below == 0).nonzero()[0]

    def new(self, n: int) -> np.ndarray:
        """The next ``n`` ids for which an escape stands."""
        self.known += n
        return self.escaped[self.known - n : self.known]


# -- model ----------------------------------------------------------------------------------


@lru_cache(1)
def _logistic() -> tuple[np.ndarray, np.ndarray]:
    """Tables of ln(p / (1 - p)) by p in 4,096ths and of its inverse, as integers."""
    stretch = [round(256 * math.log((p + 0.5) / (4095.5 - p))) for p in range(4096)]
    squash = [round(65536 / (1 + math.exp(-x / 256))) for x in range(-2047, 2048)]
    return np.array(stretch, np.int64), np.clip(np.array(squash, np.int64), 48, 65536 - 48)


def _learnt(ones: np.ndarray, seen: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Chances of a one, in 65,536ths, after so many bits and ones in each context."""
    return ones + (hits * 65535 - seen * ones) // (seen + 16)


class _Mixed:
    """The chance that the first prediction holds, by the confidence of all three orders.

    It is mixed for every combination of confidences at once, whenever it has learnt.
    """

    def __init__(self):
        self.weight = np.full(3, 24000, np.int64)
        self.chances = [np.full(n, 32768, np.int64) for n in MIXED]
        self._mix()

    def _mix(self) -> None:
        stretch, squash = _logistic()
        self.inputs = [stretch[c >> 4] for c in self.chances]
        one, two, three = (w * i for w, i in zip(self.weight.tolist(), self.inputs, strict=True))
        summed = one[:, None, None] + two[:, None] + three
        self.ones = squash[np.clip(summed >> 16, -2047, 2047) + 2047]
        self.edges = self.ones.astype(np.uint64).ravel()

    def learn(self, coded: np.ndarray, steps: int) -> None:
        """``coded`` are the combinations of ``steps`` steps, times two, plus one where the prediction held."""
        counted = np.bincount(coded, minlength=2 * self.ones.size)
        hits = counted[1::2].reshape(MIXED)
        seen = counted[::2].reshape(MIXED) + hits
        sums = np.stack([(hits << 16) - seen * self.ones, seen, hits])
        others = sums.sum(1)
        for i, (error, n, ones) in enumerate([sums.reshape(3, MIXED[0], -1).sum(2), others.sum(2), others.sum(1)]):
            self.weight[i] += steps * int(error @ self.inputs[i]) // len(coded) >> 10
            self.chances[i] = _learnt(self.chances[i], n, ones)
        self._mix()


class _Frequencies:
    """Order 0: the ids seen, by how often, and an escape for the others; they share a power of two."""

    def __init__(self, size: int):
        self.size = size
        self.counts, self.total = np.zeros(size, np.int64), 0
        self.level = np.zeros(size, np.int32)
        self.shares = np.zeros(size + 1, np.int64)  # start and width; ids not seen have the escape's
        self._share(1, 0)

    def _share(self, escapes: int, symbols: int) -> None:
        self.seen = (self.counts > 0).nonzero()[0]
        counts = self.counts[self.seen]
        bits = min(max(16, (4 * len(counts)).bit_length()), WORD)
        escape = min((1 << bits) * (escapes + 1) // (symbols + 2) + 1, 1 << bits - 1)
        scale = ((1 << bits) - escape - len(counts) << 32) // max(self.total, 1)
        self.freq = (counts * scale >> 32) + 1
        ends = np.cumsum(self.freq)
        self.escape = (1 << bits) - int(self.freq.sum())
        self.shares.fill(self.escape)
        self.shares[self.seen] = self.escape + ends - self.freq << 32 | self.freq
        self.level[self.seen] = np.minimum(np.frexp(counts.astype(np.float64))[1], MIXED[0] - 1) << 2 * SURE_BITS + 1
        self.bits = np.uint64(bits)
        self._table = None

    def ids_at(self, places: np.ndarray) -> np.ndarray:
        if self._table is None:
            shares = np.concatenate([[self.escape], self.freq])
            self._table = np.repeat(np.concatenate([[self.size], self.seen]).astype(np.int32), shares)
        return self._table.take(places.view(np.int64), mode="clip")

    def shares_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the share of each id begins, 0 for the escape, and how wide it is."""
        shares = self.shares.take(ids).view(np.uint64)
        return shares >> np.uint64(32), shares & np.uint64(0xFFFFFFFF)

    def learn(self, ids: np.ndarray, escapes: int) -> None:
        """``ids`` coded by frequency, and how many of them were escapes."""
        self.counts += np.bincount(ids, minlength=self.size)
        self.total += len(ids)
        if self.total > FORGOTTEN_AT:
            self.counts = self.counts + 1 >> 1
            self.total = int(self.counts.sum())
        self._share(escapes, len(ids))


def _code(coder: LaneEncoder | LaneDecoder, n: int, size: int, ids: np.ndarray | None) -> np.ndarray:
    """Run the model over a block of ``n`` ids below ``size``; encodes ``ids`` or decodes.

    Lanes go on by one id in each step; those whose prediction fails are coded as a subset.
    """
    lanes = -(-n // STEPS)
    out = np.zeros((STEPS, lanes), np.int32)
    if ids is not None:
        padded = np.zeros(lanes * STEPS, np.int32)
        padded[:n] = ids
        out[:] = padded.reshape(lanes, STEPS).T
    mixed, order0 = _Mixed(), _Frequencies(size)
    second = np.full(CONFIDENT + 1, 32768, np.int64)
    second_edges = second.astype(np.uint64)
    predictions = np.zeros(size + (1 << CONTEXT_BITS), np.int32)  # of order 1, then of order 2
    last = last_two = np.zeros(lanes, np.int32)
    kinds, held, tried, shared, since, escapes = [], [], [], [], 0, 0
    for step in range(STEPS):
        k = lanes if (lanes - 1) * STEPS + step < n else lanes - 1
        if not k:
            break
        if step - since > min(step // 3, REBUILT_EVERY - 1):
            mixed.learn(np.concatenate(kinds) << 1 | np.concatenate(held), step - since)
            if shared:
                order0.learn(np.concatenate(shared), escapes)
            if tried:
                counted = np.bincount(np.concatenate(tried), minlength=2 * len(second)).reshape(-1, 2)
                second = _learnt(second, counted.sum(1), counted[:, 1])
                second_edges = np.clip(second, 48, 65536 - 48).astype(np.uint64)
            kinds, held, tried, shared, since, escapes = [], [], [], [], step, 0
        real = out[step, :k] if ids is not None else None
        last, last_two = last[:k], last_two[:k]
        context = last.view(np.uint32) * FIRST + last_two.view(np.uint32) * SECOND >> np.uint32(32 - CONTEXT_BITS)
        at = np.empty((2, k), np.int64)
        at[0] = last
        np.add(context, size, out=at[1])
        predicted = predictions.take(at)
        ids_of, sure_of = predicted >> SURE_BITS, predicted & CONFIDENT
        id1, id2, sure1, sure2 = ids_of[0], ids_of[1], sure_of[0], sure_of[1]
        guess = np.where(sure2 > 0, id2, id1)
        differ = id1 != guess
        kind = order0.level.take(guess) | differ * ODDS | sure1 << SURE_BITS | sure2
        hits = coder.bits(slice(0, k), mixed.edges.take(kind), None if real is None else real == guess)
        kinds.append(kind)
        held.append(hits)
        missed = ~hits
        other = (missed & differ & (sure1 > 1)).nonzero()[0]
        found = guess if real is None else real
        if len(other):
            sure, also = sure1[other], id1[other]
            hits = coder.bits(other, second_edges[sure], None if real is None else real[other] == also)
            tried.append(sure << 1 | hits)
            right = other[hits]
            missed[right] = False
            if real is None:
                found[right] = also[hits]
        rest = missed.nonzero()[0]
        if len(rest):
            symbol, new = coder.symbols(rest, order0, None if real is None else real[rest])
            escapes += len(new)
            if real is None:
                symbol[new] = coder.new(len(new))
                found[rest] = symbol
            else:
                coder.new(symbol[new])
            shared.append(symbol)
        if real is None:
            out[step, :k] = found
        right = ids_of == found
        after = predicted + CHANGES.take(right * RIGHT | sure_of)
        np.copyto(after, found << SURE_BITS | 1, where=~right & (sure_of <= 1))
        predictions[at] = after
        last, last_two = found, last
    return out.T.reshape(-1)[:n]


def _planes(numbers: np.ndarray) -> bytes:
    """All lowest bytes, then all next ones, and so on, which compress better."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _of_planes(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def pack_block(ids: np.ndarray) -> bytes:
    """One block: magic, counts, checksums, words of each lane, ids behind escapes, streams."""
    size = int(ids.max()) + 1 if len(ids) else 1
    if size > LARGEST:
        raise ValueError(f"ids have to be below {LARGEST}")
    coder = LaneEncoder(-(-len(ids) // STEPS))
    _code(coder, len(ids), size, ids)
    escaped, used, streams = coder.streams()
    body = zlib.compress(_planes(np.concatenate([used, escaped])), 6)
    head = struct.pack("<QIII", len(ids), size, zlib.crc32(ids.astype("<u4").tobytes()), len(body))
    sealed = head + body + streams
    return MAGIC + struct.pack("<I", zlib.crc32(sealed)) + sealed


def unpack_block(block: bytes) -> np.ndarray:
    """The ids of a block; raises ``DamagedBlock`` if they are not those written."""
    sealed = block[len(MAGIC) + 4 :]
    if block[: len(MAGIC)] != MAGIC or struct.unpack_from("<I", block, len(MAGIC))[0] != zlib.crc32(sealed):
        raise DamagedBlock("the block's checksum does not hold")
    n, size, wanted, long = struct.unpack_from("<QIII", sealed)
    at = struct.calcsize("<QIII")
    used, escaped = np.split(_of_planes(zlib.decompress(sealed[at : at + long])), [-(-n // STEPS)])
    coder = LaneDecoder(escaped.astype(np.int32), used.astype(np.int64), sealed[at + long :])
    ids = _code(coder, n, size, None)
    if zlib.crc32(ids.astype("<u4").tobytes()) != wanted:
        raise DamagedBlock("the ids' checksum does not hold")
    return ids


# -- files ----------------------------------------------------------------------------------


class Piece(NamedTuple):
    """Packed ids of a document, all of it or a stretch: so many ids lie before it, so many are in all."""

    doc: int | None
    packed: bytes
    offset: int
    total: int


def _directory(pieces: list[Piece]) -> bytes:
    """What a block holds, in order."""
    known = np.array([p.doc is not None for p in pieces], np.uint8)
    names = np.array([p.doc or 0 for p in pieces], "<i8")
    numbers = [np.array(column, "<i8") for column in ([len(p.packed) // 4 for p in pieces], [p.offset for p in pieces], [p.total for p in pieces])]
    body = zlib.compress(b"".join([known.tobytes(), np.diff(names, prepend=0).tobytes(), *(n.tobytes() for n in numbers)]), 6)
    return struct.pack("<II", len(pieces), len(body)) + struct.pack("<I", zlib.crc32(body)) + body


def _read_directory(block: bytes) -> tuple[list, list[np.ndarray], bytes]:
    """Documents; sizes, offsets and totals; the coded ids."""
    n, long, wanted = struct.unpack_from("<III", block)
    body = block[12 : 12 + long]
    if zlib.crc32(body) != wanted:
        raise DamagedBlock("the directory's checksum does not hold")
    raw = zlib.decompress(body)
    names = np.cumsum(np.frombuffer(raw, "<i8", n, n)).tolist()
    docs = [d if known else None for d, known in zip(names, raw[:n], strict=True)]
    return docs, [np.frombuffer(raw, "<i8", n, n + 8 * n * k) for k in (1, 2, 3)], block[12 + long :]


def _cut(stream: Iterator[tuple[int | None, bytes]], block_ids: int) -> Iterator[Piece]:
    """Documents in pieces of at most ``block_ids`` ids."""
    for doc, packed in stream:
        total = len(packed) // 4
        for at in range(0, total, block_ids):
            yield Piece(doc, packed[4 * at : 4 * (at + block_ids)], at, total)


def _blocks(stream: Iterator[tuple[int | None, bytes]], block_ids: int) -> Iterator[tuple[int, int, int, bool, bytes]]:
    """(start, pieces, ids, whether any is not a whole document, block), less than twice ``block_ids`` each."""
    pieces, held, start = [], 0, 0
    for piece in _cut(stream, block_ids):
        pieces.append(piece)
        held += len(piece.packed) // 4
        if held >= block_ids:
            yield start, len(pieces), held, *_sealed(pieces)
            start += held
            pieces, held = [], 0
    if pieces:
        yield start, len(pieces), held, *_sealed(pieces)


def _sealed(pieces: list[Piece]) -> tuple[bool, bytes]:
    ids = np.frombuffer(b"".join(p.packed for p in pieces), "<u4")
    cut = any(len(p.packed) // 4 < p.total for p in pieces)
    return cut, _directory(pieces) + pack_block(ids)


def _written(batches: Batches, path: str, end_id: int, block_ids: int, schema: pa.Schema) -> Batches:
    tokenizer, end = word_ids.load(path), int(end_id).to_bytes(4, "little")

    def stream() -> Iterator[tuple[int | None, bytes]]:
        for batch in batches:
            ids, texts = (c.to_pylist() for c in batch.columns[:2])
            for start, stop in word_ids.grouped(texts):
                for doc, packed in zip(ids[start:stop], tokenizer.texts(texts[start:stop]), strict=True):
                    yield doc, packed + end

    part = TaskContext.get().partitionId()
    for number, (start, n_docs, n_tokens, cut, block) in enumerate(_blocks(stream(), block_ids)):
        yield batch_of(schema, [[part], [number], [start], [n_docs], [n_tokens], [cut], [block]])


def write_ids(
    docs: DataFrame,
    files: str,
    path: str,
    end_id: int = 1,
    block_ids: int = BLOCK_IDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encode every text with the tokenizer at ``path`` and write the files, in order of ids.

    ``files`` is a folder on a store all executors share. Each file holds a range of
    documents; of equal ids the text's hash decides, and null ids come first. A null text is
    empty and holds the end id alone. A document of more than ``block_ids`` ids goes on in the next
    block, so that no block grows with its texts. An empty table gives files without blocks.
    """
    texts = texts_of(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    ranged = texts.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie")
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()]
    names = ["part", "number", "start", "n_docs", "n_tokens", "cut", "block"]
    schema = pa.schema(list(zip(names, types, strict=True)))
    task = partial(_written, path=path, end_id=end_id, block_ids=block_ids, schema=schema)
    blocks = arrow_map(ranged.select("id", "text"), task, BLOCK_SCHEMA)
    blocks.write.option("compression", "none").parquet(files)


def _read(batches: Batches, before: dict[int, int], kind: str, schema: pa.Schema) -> Batches:
    for batch in batches:
        for row in batch.to_pylist():
            docs, (sizes, offsets, totals), block = _read_directory(row["block"])
            ids = unpack_block(block).astype("<u4")
            ends = np.cumsum(sizes)
            starts = before[row["part"]] + row["start"] + ends - sizes - offsets
            parts = [ids[e - s : e].tobytes() for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
            if kind == "pieces":
                yield batch_of(schema, [docs, starts, totals, offsets, parts])
                continue
            columns = [docs, starts, sizes, [zlib.crc32(p) for p in parts], parts]
            yield batch_of(schema, columns[: len(schema)])


def _joined(batches: Batches, schema: pa.Schema) -> Batches:
    """Documents of their pieces."""
    for batch in batches:
        for row in batch.to_pylist():
            ids = b"".join(p["ids"] for p in row["pieces"])
            if len(ids) != 4 * row["n_tokens"]:
                raise DamagedBlock("a piece of a document is missing")
            yield batch_of(schema, [[v] for v in (row["doc_id"], row["start"], row["n_tokens"], zlib.crc32(ids), ids)][: len(schema)])


def read_ids(docs_of: DataFrame, with_ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32[, ids]`` of the files that ``docs_of`` reads.

    Blocks that hold whole documents are read as they are; pieces of others are put together by the
    place where their document starts. The driver sees one count for each file.
    """
    counted = docs_of.groupBy("part").agg(F.sum("n_tokens").alias("n"), F.max("cut").alias("cut")).orderBy("part").collect()
    ends = np.cumsum([0, *(r["n"] for r in counted)]).tolist()
    before = dict(zip([r["part"] for r in counted], ends, strict=False))
    types = [pa.int64()] * 4 + [pa.binary()]
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
    schema = pa.schema(list(zip(names, types, strict=True))[: 5 if with_ids else 4])
    spelled = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    # One block at a time: a block is some megabytes of ids.
    blocks = docs_of.select("part", "start", "block", "cut")
    task = partial(_read, before=before, kind="documents", schema=schema)
    found = arrow_map(blocks.where("NOT cut").drop("cut"), task, spelled)
    if not any(r["cut"] for r in counted):
        return found
    names = ["doc_id", "start", "n_tokens", "offset", "ids"]
    task = partial(_read, before=before, kind="pieces", schema=pa.schema(list(zip(names, types, strict=True))))
    pieces = arrow_map(blocks.where("cut").drop("cut"), task, "doc_id long, start long, n_tokens long, offset long, ids binary")
    listed = F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("pieces")
    whole = pieces.groupBy("doc_id", "start", "n_tokens").agg(listed)
    return found.unionAll(arrow_map(whole, partial(_joined, schema=schema), spelled))


def round_trip(docs: DataFrame, path: str, end_id: int = 1, workspace: Workspace | None = None) -> DataFrame:
    """Write the files of ``docs`` into the workspace and read them back."""
    spark = docs.sparkSession
    files = (workspace or Workspace(spark)).new_path("ids")
    write_ids(docs, files, path, end_id)
    return read_ids(spark.read.schema(BLOCK_SCHEMA).parquet(files), with_ids=False)
