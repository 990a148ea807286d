"""Ranked lexical search, exact, by blocks of each term's postings with summaries.

Documents become sparse vectors of impacts over the terms that the items ask for; a score is the
inner product of an item's weights with a document's impacts. A task reads its documents a shard of
some thousand at a time. Of each term's postings in the shard it makes blocks of documents that are
similar (by inner products with pivot documents that hold the term), and for each block a summary:
the greatest impact of every term in it, which bounds the score of all its documents.

Terms go from the weightiest to the lightest, each item's best documents are kept throughout the
task. A document that holds an earlier term of the item has been met in that term's postings, so the
bound of a block needs only the terms from its own on. A block is skipped only if its bound, an exact
whole number, is below the item's k-th score; all documents of other blocks are scored. The same bound
taken over the whole list, then over the whole shard, skips lists before they are cut into blocks.

No list of a term is gathered: a term that every document holds is spread over all shards, as the
documents are. A task passes on at most k rows for each item.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlift.llm.tasks import Batches, arrow_map, batch_of, texts_of
from eventlift.sources.workspace import Workspace

# Fixed values of the score.
IMPACT, TF_SCALE, LENGTH_SCALE, LENGTH_SHARE = 1_000_000_000, 1000, 8, 75
#: Documents of a shard, of a block, and pivots of a shard.
SHARD_DOCS, BLOCK_DOCS, PIVOTS = 2048, 32, 64
#: Items searched together: so many, or so many terms with repeats, at most (one item at least).
ITEMS, ITEM_TERMS = 4096, 1 << 18
#: Different terms of items scored together, and these times the items, which bound a task's matrices.
MATRIX_TERMS, MATRIX_CELLS = 4096, 1 << 22
EXACT = 1 << 53
BATCH_BYTES = 2 << 20
#: Bytes of terms as they are compared; all others part terms.
_FOLDED = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)

_VECTOR = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("terms", pa.binary()), ("tfs", pa.binary())])
_VECTOR_SQL = "id long, n long, terms binary, tfs binary"
_DF = pa.schema([("term", pa.int32()), ("df", pa.int64())])
_HIT = pa.schema([("place", pa.int64()), ("item", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])
_HIT_SQL = "place long, item long, id long, score long"


def terms_of(text: str) -> list[bytes]:
    """Maximal runs of letters, digits and characters beyond ASCII, only A-Z lower-cased."""
    return text.encode().translate(_FOLDED).split()


def _counted(numbers: dict[bytes, int]):
    """A task that counts the wanted terms of each text."""

    def count(batches: Batches) -> Batches:
        rows, size = [], 0
        for batch in batches:
            for key, text in zip(*(c.to_pylist() for c in batch.columns)):
                terms = terms_of(text)
                if not terms:
                    continue
                held = Counter(filter(None.__ne__, map(numbers.get, terms)))
                keys = np.fromiter(held.keys(), "<i4", len(held)).tobytes()
                values = np.fromiter(held.values(), "<i4", len(held)).tobytes()
                rows.append((key, len(terms), keys, values))
                size += 32 + 2 * len(keys)
                if size >= BATCH_BYTES:
                    yield batch_of(_VECTOR, list(zip(*rows)))
                    rows, size = [], 0
        if rows:
            yield batch_of(_VECTOR, list(zip(*rows)))

    return count


def _documents_with(size: int):
    """A task that counts the documents that hold each term."""

    def count(batches: Batches) -> Batches:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for terms in batch.column(0).to_pylist():
                total[np.frombuffer(terms, "<i4")] += 1  # a term is listed once
        held = np.flatnonzero(total)
        yield batch_of(_DF, [held.astype(np.int32), total[held]])

    return count


class Plan:
    """Items searched together: their terms by descending weight, and a matrix of weights.

    A column's weight is the term's, the entries multiply it by how often the item has the term.
    """

    def __init__(self, items: list[tuple[int, int, dict[int, int]]], weight: dict[int, int]):
        terms = sorted({t for *_, held in items for t in held}, key=lambda t: (-weight[t], t))
        self.items = [key for *key, _ in items]
        self.column = {t: i for i, t in enumerate(terms)}
        self.weights = np.zeros((len(items), len(terms)), np.int64)
        for row, (*_, held) in enumerate(items):
            for t, times in held.items():
                self.weights[row, self.column[t]] = times * weight[t]
        # whole numbers in doubles are exact as long as no sum reaches 2**53
        most = int(self.weights.sum(axis=1).max(initial=0)) * (IMPACT // TF_SCALE)
        self.kind = np.float64 if most < EXACT else np.int64
        self.weights = self.weights.astype(self.kind)
        self.asked = [np.flatnonzero(self.weights[:, j]) for j in range(len(terms))]
        self.lookup = np.full(max(self.column, default=-1) + 1, -1, np.int32)
        self.lookup[terms] = np.arange(len(terms), dtype=np.int32)


class Best:
    """The k best documents of each item so far, of equal scores those of least id."""

    def __init__(self, size: int, k: int):
        self.k, self.held = k, [[] for _ in range(size)]
        self.least = np.ones(size, np.int64)  # what a document must reach

    def offer(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.least[item]
        if not good.any():
            return
        rows = self.held[item] + [(-s, i) for s, i in zip(scores[good].tolist(), ids[good].tolist())]
        self.held[item] = sorted(rows, key=lambda r: (r[0], r[1] is None, r[1]))[: self.k]
        if len(self.held[item]) == self.k:
            self.least[item] = -self.held[item][-1][0]


class Shard:
    """Documents of a shard as a matrix of impacts, and blocks of their postings."""

    def __init__(self, plan: Plan, impacts: np.ndarray, ids: np.ndarray):
        self.plan, self.ids = plan, ids
        self.impacts = impacts
        pivots = np.linspace(0, len(ids) - 1, min(PIVOTS, len(ids))).astype(int)
        self.pivots = impacts[pivots]
        like = impacts.astype(np.float32)
        self.alike = like @ like[pivots].T  # only decides who shares a block

    def blocks(self, docs: np.ndarray, column: int) -> tuple[np.ndarray, np.ndarray]:
        """The list's documents by cluster, and where each block of them begins."""
        if len(docs) <= BLOCK_DOCS:
            return docs, np.zeros(1, np.int64)
        own = np.flatnonzero(self.pivots[:, column])
        alike = self.alike[docs][:, own] if len(own) else self.alike[docs]
        cluster, near = alike.argmax(axis=1), alike.max(axis=1)
        order = np.lexsort((-near, cluster))
        cluster = cluster[order]
        fresh = np.concatenate([[True], cluster[1:] != cluster[:-1]])
        starts = np.flatnonzero(fresh)
        sizes = np.diff(np.append(starts, len(docs)))
        place = np.arange(len(docs)) - np.repeat(starts, sizes)
        return docs[order], np.flatnonzero(place % BLOCK_DOCS == 0)

    def search(self, best: Best) -> tuple[int, int]:
        """Offer all documents that may be among the best; returns blocks seen and skipped."""
        plan, size = self.plan, len(self.ids)
        tops = self.impacts.max(axis=0).astype(plan.kind)
        # what documents can still reach that hold none of the columns before
        ahead = np.cumsum((plan.weights * tops)[:, ::-1], axis=1)[:, ::-1]
        seen = np.zeros((len(plan.items), size), bool)
        blocks = skipped = 0
        for column, asked in enumerate(plan.asked):
            if not tops[column]:
                continue
            asked = asked[ahead[asked, column] >= best.least[asked]]
            if not len(asked):
                continue
            docs = np.flatnonzero(self.impacts[:, column])
            # only coordinates that these items ask for
            wanted = column + np.flatnonzero(plan.weights[asked, column:].any(axis=0))
            part, weights = self.impacts[np.ix_(docs, wanted)], plan.weights[np.ix_(asked, wanted)]
            whole = weights @ part.max(axis=0).astype(plan.kind)
            open_ = whole >= best.least[asked]
            asked, weights = asked[open_], weights[open_]
            if not len(asked):
                continue
            order, starts = self.blocks(docs, column)
            summaries = np.maximum.reduceat(part[np.searchsorted(docs, order)], starts, axis=0)
            bounds = weights @ summaries.astype(plan.kind).T
            ends = np.append(starts[1:], len(order))
            for row in range(len(asked)):
                item = asked[row]
                by_bound = np.argsort(-bounds[row], kind="stable")
                blocks += len(starts)
                for at in range(0, len(by_bound), 8):  # the best blocks first, some at a time
                    chosen = by_bound[at : at + 8]
                    chosen = chosen[bounds[row, chosen] >= best.least[item]]
                    if not len(chosen):
                        skipped += len(by_bound) - at
                        break
                    members = np.concatenate([order[starts[b] : ends[b]] for b in chosen])
                    members = members[~seen[item, members]]
                    if len(members):
                        seen[item, members] = True
                        columns = np.flatnonzero(plan.weights[item])
                        scores = self.impacts[np.ix_(members, columns)].astype(plan.kind) @ plan.weights[item, columns]
                        best.offer(item, scores.astype(np.int64), self.ids[members])
        return blocks, skipped


def _matrix(plan: Plan, rows: list[tuple], documents: int, words: int) -> np.ndarray:
    """Impacts of a shard's documents on the plan's terms."""
    lengths = np.array([r[1] for r in rows], np.int64)
    m = 100 - LENGTH_SHARE + (LENGTH_SHARE * lengths * documents) // words
    counts = [len(r[2]) // 4 for r in rows]
    terms = np.frombuffer(b"".join(r[2] for r in rows), "<i4")
    tfs = np.frombuffer(b"".join(r[3] for r in rows), "<i4").astype(np.int64)
    doc = np.repeat(np.arange(len(rows)), counts)
    known = terms < len(plan.lookup)
    column = np.where(known, plan.lookup[np.where(known, terms, 0)] if len(plan.lookup) else -1, -1)
    here = column >= 0
    doc, column, tfs = doc[here], column[here], tfs[here]
    impacts = np.zeros((len(rows), len(plan.column)), np.int32)
    impacts[doc, column] = (IMPACT * tfs) // (TF_SCALE * tfs + LENGTH_SCALE * m[doc])
    return impacts


def _searched(groups: list[list[tuple]], weight: dict[int, int], k: int, documents: int, words: int):
    """A task that searches its documents a shard at a time; best documents are kept on the way."""

    def search(batches: Batches) -> Batches:
        plans = [Plan(group, weight) for group in groups]
        best = [Best(len(p.items), k) for p in plans]
        for rows in _shards(batches):
            ids = np.array([r[0] for r in rows], object)
            for plan, kept in zip(plans, best):
                impacts = _matrix(plan, rows, documents, words)
                some = np.flatnonzero(impacts.any(axis=1))
                if len(some):
                    Shard(plan, impacts[some], ids[some]).search(kept)
        for plan, kept in zip(plans, best):
            hits = [(*key, i, -s) for key, held in zip(plan.items, kept.held) for s, i in held]
            if hits:
                yield batch_of(_HIT, list(zip(*hits)))

    return search


def _shards(batches: Batches) -> Iterator[list[tuple]]:
    rows = []
    for batch in batches:
        rows += zip(*(c.to_pylist() for c in batch.columns))
        while len(rows) >= SHARD_DOCS:
            yield rows[:SHARD_DOCS]
            rows = rows[SHARD_DOCS:]
    if rows:
        yield rows


def _blocks_of_items(items: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple]]:
    """Items with their terms, so many at a time as one search takes."""
    held, size = [], 0
    for place, (item, text) in enumerate(texts_of(items, item_col, text_col).toLocalIterator()):
        terms = Counter(terms_of(text))
        if not terms:
            continue
        held.append((place, item, terms))
        size += sum(terms.values())
        if len(held) >= ITEMS or size >= ITEM_TERMS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _grouped(items: list[tuple], numbers: dict[bytes, int]) -> list[list[tuple]]:
    """Items whose matrix is bounded (one item at least)."""
    groups, group, known = [], [], set()
    for place, item, terms in items:
        held = {numbers[t]: times for t, times in terms.items()}
        size = len(known | held.keys())
        if group and (size > MATRIX_TERMS or size * (len(group) + 1) > MATRIX_CELLS):
            groups.append(group)
            group, known = [], set()
        group.append((place, item, held))
        known |= held.keys()
    return [*groups, group] if group else groups


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``item, rank, id, score`` of the k best documents of each item, scores above 0.

    Equal scores go by ascending id, a null id last. Rows that share an id are documents of their
    own, rows of items that share an id items of their own. A null text has no term; a document
    without terms does not count, an item without terms has no result, nor has an empty table. Other
    columns, whatever their names, are left out. Items are searched some thousand at a time, each
    time against all documents; only they, and a count for each of their terms, reach the driver.
    """
    spark = docs.sparkSession
    workspace = Workspace(spark)
    texts = texts_of(docs, id_col, text_col)
    found = spark.createDataFrame([], "item long, rank int, id long, score long")
    for block in _blocks_of_items(items, item_col, item_text_col):
        numbers = {t: i for i, t in enumerate(sorted({t for _, _, terms in block for t in terms}))}
        vectors = workspace.stage(arrow_map(texts, _counted(numbers), _VECTOR_SQL), "vectors")
        documents, words = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        counts = arrow_map(vectors.select("terms"), _documents_with(len(numbers)), "term int, df long")
        df = dict(counts.groupBy("term").agg(F.sum("df")).collect())
        weight = {
            t: math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(t, 0) + 1))) for t in numbers.values()
        }
        task = _searched(_grouped(block, numbers), weight, k, documents, words)
        hits = arrow_map(vectors, task, _HIT_SQL)
        order = Window.partitionBy("place").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found = found.unionAll(ranked.select("item", "rank", "id", "score"))
    return found
