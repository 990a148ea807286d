"""Byte-level BPE encoding and decoding (operator 1).

The merges are compiled into a transducer that reads a pre-token byte by byte. After each
byte exactly one token can be the last one of the prefix read so far: the one that ends
there and may stand behind the last token of the prefix it leaves. So a state is the set of
pending tokens, each a place in the vocabulary's trie with the last token in front of it.
States are made when they are first reached, transitions are looked up after that, and both
tables are emptied when they outgrow a bound. A token is emitted as soon as all pending
tokens descend from it.

Decoding joins token bytes and runs an incremental UTF-8 state machine over them.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from eventlift.llm.tasks import WHITE_SPACE, Batches, arrow_map, batch_of, texts_of

NEVER = 1 << 62
#: Transitions, and cached texts of either kind, a worker holds at most; each starts anew beyond it.
MAX_TRANSITIONS = 1_000_000
MAX_CACHED = 400_000
LONGEST_CACHED = 64
PENDING = -1
#: Unemitted bytes after which a run looks for a token that all pending tokens descend from.
LOOKAHEAD = 512
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Transducer:
    """The lazily determinised machine of one table of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self._children: list[dict[int, int]] = [{}]
        self._token_at: list[int] = [-1]
        self._depth: list[int] = [0]
        for token, rank in ranks.items():
            self._add(token, rank)
        self._right: dict[int, list[tuple[bytes, int]]] = {}
        self._left: dict[int, list[tuple[bytes, int]]] = {}
        self._forget()

    def _add(self, token: bytes, rank: int) -> None:
        node = 0
        for byte in token:
            below = self._children[node].get(byte)
            if below is None:
                below = self._children[node][byte] = len(self._children)
                self._children.append({})
                self._token_at.append(-1)
                self._depth.append(self._depth[node] + 1)
            node = below
        self._token_at[node] = rank

    def _forget(self) -> None:
        self._rows: dict[tuple, dict] = {}
        self._made = 0
        self._start = self._row(((0, -1),))

    def _row(self, pending: tuple) -> dict:
        """The transitions known from a state, by byte; under PENDING the state itself."""
        row = self._rows.get(pending)
        if row is None:
            row = self._rows[pending] = {PENDING: pending}
        return row

    # -- which token may stand behind which ------------------------------------------------

    def _halves(self, token: bytes) -> tuple[bytes, bytes]:
        """The two parts whose merge makes ``token``."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            pairs = [self.ranks.get(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
            at = min(range(len(pairs)), key=pairs.__getitem__)
            if pairs[at] == NEVER:
                raise ValueError(f"no merges lead to the token {token!r}")
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts[0], parts[1]

    def _edge(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """The pieces at one edge of a token while it grows, with the rank that ends each."""
        piece, until, pieces = self.bytes_of[token], NEVER, []
        while True:
            pieces.append((piece, until))
            if len(piece) == 1:
                return pieces[::-1]
            until = self.ranks[piece]
            piece = self._halves(piece)[side]

    def may_follow(self, first: int, second: int) -> bool:
        """Whether no merge ever crosses the border between the two tokens.

        Both tokens grow merge by merge, in the order of ranks; a pair that spans the border
        must at no time come before the next merge on either side. Of equal ranks the
        leftmost pair merges first.
        """
        left = self._right.get(first)
        if left is None:
            left = self._right[first] = self._edge(first, 1)
        right = self._left.get(second)
        if right is None:
            right = self._left[second] = self._edge(second, 0)
        i = j = 0
        while True:
            (a, until_a), (b, until_b) = left[i], right[j]
            across = self.ranks.get(a + b, NEVER)
            if across < until_a and across <= until_b:
                return False
            if until_a == until_b == NEVER:
                return True
            if until_a <= until_b:
                i += 1
            else:
                j += 1

    # -- running ---------------------------------------------------------------------------

    def _step(self, row: dict, byte: int) -> tuple[dict, int, int]:
        """The next state's row, the last token of the prefix read, and that token's length."""
        pending, last, size = [], -1, 0
        for node, before in row[PENDING]:
            below = self._children[node].get(byte)
            if below is None:
                continue
            token = self._token_at[below]
            if token >= 0 and last < 0 and (before < 0 or self.may_follow(before, token)):
                last, size = token, self._depth[below]
            if self._children[below]:
                pending.append((below, before))
        if last < 0:
            raise ValueError("the ranks do not cover every byte")
        pending.append((0, last))
        step = row[byte] = (self._row(tuple(pending)), last, size)
        self._made += 1
        return step

    def ids(self, data: bytes) -> list[int]:
        """The ids of one pre-token."""
        if len(data) > LOOKAHEAD:
            return list(self.run(data))
        if self._made > MAX_TRANSITIONS:
            self._forget()
        row, ends = self._start, []
        for byte in data:
            step = row.get(byte) or self._step(row, byte)
            row = step[0]
            ends.append(step)
        return _chain(ends, len(ends))

    def run(self, data: Iterable[int]) -> Iterator[int]:
        """The ids of one pre-token of any length, each after a bounded look ahead."""
        if self._made > MAX_TRANSITIONS:
            self._forget()
        row, ends = self._start, []
        for byte in data:
            step = row.get(byte) or self._step(row, byte)
            row = step[0]
            ends.append(step)
            if len(ends) % LOOKAHEAD == 0:
                settled = self._settled(row, ends)
                yield from _chain(ends, settled)
                del ends[:settled]
        yield from _chain(ends, len(ends))

    def _settled(self, row: dict, ends: list) -> int:
        """How many of the bytes held lie before every pending token's last common border."""
        places = {len(ends) - self._depth[node] for node, _ in row[PENDING]}
        while len(places) > 1:
            latest = max(places)
            places.remove(latest)
            places.add(latest - ends[latest - 1][2])
        return max(places.pop(), 0)


def _chain(ends: list, upto: int) -> list[int]:
    ids = []
    while upto > 0:
        _, token, size = ends[upto - 1]
        ids.append(token)
        upto -= size
    ids.reverse()
    return ids


class Utf8Machine:
    """Decodes UTF-8 fed in pieces of any size.

    The state is the bytes of a character that has begun but not ended. Only the last bytes
    of a piece can be such a beginning, so the machine walks those and leaves the rest of
    the piece to the codec. Bytes that are no UTF-8 become U+FFFD.
    """

    def __init__(self):
        self._begun = b""

    def feed(self, piece: bytes) -> str:
        data = self._begun + piece
        keep = 0
        for back in range(1, min(4, len(data) + 1)):
            byte = data[-back]
            if byte < 0x80:
                break
            if byte >= 0xC0:
                wanted = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                keep = back if back < wanted else 0
                break
        cut = len(data) - keep
        self._begun = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        rest, self._begun = self._begun, b""
        return rest.decode("utf-8", "replace")


class ByteBpe:
    """Whole texts to ids and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.machine = Transducer(ranks)
        # The class of white space is spelled out: ``regex`` counts other characters to it.
        spelled = pattern.replace(r"[^\s", f"[^{WHITE_SPACE}")
        spelled = spelled.replace(r"\s", f"[{WHITE_SPACE}]").replace(r"\S", f"[^{WHITE_SPACE}]")
        self._pretokens = regex.compile(spelled).findall
        # No match runs from other characters into white space, so such chunks are encoded alone.
        self._chunks = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+").findall
        self._known: dict[str, bytes] = {}  # by chunk
        self._packed: dict[str, bytes] = {}  # by pre-token
        self._size = max(self.machine.bytes_of) + 1
        self._table = [self.machine.bytes_of.get(i, b"") for i in range(self._size)]

    def _pretoken(self, pretoken: str) -> bytes:
        packed = np.array(self.machine.ids(pretoken.encode()), "<u4").tobytes()
        if len(pretoken) <= LONGEST_CACHED:
            if len(self._packed) > MAX_CACHED:
                self._packed.clear()
            self._packed[pretoken] = packed
        return packed

    def _chunk(self, chunk: str) -> bytes:
        known = self._packed.get
        packed = b"".join([known(p) or self._pretoken(p) for p in self._pretokens(chunk)])
        if len(chunk) <= LONGEST_CACHED:
            if len(self._known) > MAX_CACHED:
                self._known.clear()
            self._known[chunk] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        known = self._known.get
        return b"".join([known(c) or self._chunk(c) for c in self._chunks(text)])

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self._table.__getitem__, ids))

    def decode_stream(self, ids: np.ndarray, step: int = 8192) -> Iterator[str]:
        """The text in pieces, none of which ends inside a character."""
        machine = Utf8Machine()
        for at in range(0, len(ids), step):
            yield machine.feed(self.decode(ids[at : at + step].tolist()))
        yield machine.end()


@lru_cache(2)
def load(path: str, pattern: str) -> ByteBpe:
    """The coder of a rank file; one per worker process."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return ByteBpe(ranks, pattern)


def _encoded(batches: Batches, path: str, pattern: str, schema: pa.Schema) -> Batches:
    bpe = load(path, pattern)
    for batch in batches:
        ids = [bpe.encode(t) for t in batch.column(1).to_pylist()]
        yield batch_of(schema, [batch.column(0), ids])


def encode(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id`` and ``ids``, the token ids as little-endian unsigned 32-bit integers.

    ``path`` is a rank file that every executor has. A null text is empty and has no ids; rows
    keep their count and order, repeated rows and null ids included.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
    task = partial(_encoded, path=path, pattern=pattern, schema=schema)
    return arrow_map(texts_of(docs, id_col, text_col), task, "doc_id long, ids binary")


def _decoded(batches: Batches, path: str, pattern: str, schema: pa.Schema) -> Batches:
    bpe = load(path, pattern)
    for batch in batches:
        texts = [
            "".join(bpe.decode_stream(np.frombuffer(ids, "<u4"))) for ids in batch.column(1).to_pylist()
        ]
        yield batch_of(schema, [batch.column(0), texts])


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``text`` of what ``encode`` returns."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    task = partial(_decoded, path=path, pattern=pattern, schema=schema)
    return arrow_map(encoded.select("doc_id", "ids"), task, "doc_id long, text string")


def _round_trip(batches: Batches, path: str, pattern: str, schema: pa.Schema) -> Batches:
    bpe = load(path, pattern)
    for batch in batches:
        counts, sums, decoded = [], [], []
        for text in batch.column(1).to_pylist():
            packed = bpe.encode(text)
            back = hashlib.sha256()
            for piece in bpe.decode_stream(np.frombuffer(packed, "<u4")):
                back.update(piece.encode())
            counts.append(len(packed) // 4)
            sums.append(hashlib.sha256(packed).hexdigest())
            decoded.append(back.hexdigest())
        yield batch_of(schema, [batch.column(0), counts, sums, decoded])


def round_trip(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode every text, decode the ids again, and return counts and digests of both."""
    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
    types = [pa.int64(), pa.string(), pa.string()]
    schema = pa.schema([("doc_id", pa.int64()), *zip(names, types, strict=True)])
    task = partial(_round_trip, path=path, pattern=pattern, schema=schema)
    return arrow_map(texts_of(docs, id_col, text_col), task, SCHEMA)
