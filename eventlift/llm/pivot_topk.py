"""Exact top-k by pivot-table elimination (operator 3).

Vectors are turned into whole numbers and compared by inner product. Since

    2 <q, x> = |q|^2 + |x|^2 - |q - x|^2,

a lower bound on the distance bounds the score from above, and by the triangle inequality
every pivot gives one: | |q - p| - |x - p| |. The distances of all rows to the pivots are
computed once. Rows lie in the cell of their nearest pivot. A query is first answered in its
own cell, which gives a score to beat; it goes on only to cells whose ranges of pivot
distances leave room for that. There candidates lie in slices, ordered by the distance to the
cell's pivot; each slice's ranges of pivot distances bound its scores, and slices are evaluated in
the order of their bounds, for some queries at once, while they may reach a query's k-th score.

Cells are cut into blocks and a cell's queries into batches, each pair of which is one task's
work at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlift import Workspace
from eventlift.llm.hyperminhash import _groups_of
from eventlift.llm.tasks import Batches, arrow_map, batch_of

PIVOTS = 48
#: Rows from which pivots are chosen, those of the lowest hash.
SAMPLE = 2000
BLOCK_ROWS = 8192
BATCH_QUERIES = 2048
#: Rows that share a bound, slices evaluated at once, and queries they are evaluated for.
SLICE_ROWS, SLICES, QUERIES = 32, 32, 256
#: Whole numbers up to here are exact in floating point.
EXACT = float(1 << 53)
NO_SCORE = -(1 << 63)


def whole_numbers(batch_column: pa.Array, scale: float) -> list[np.ndarray | None]:
    """floor(scale * x) of each vector; None if it or a component is null or not finite."""
    out: list[np.ndarray | None] = []
    for start in range(0, len(batch_column), 4096):
        for vector in batch_column.slice(start, 4096):
            values = vector.values
            if values is None or values.null_count or not len(values):
                out.append(None)
                continue
            x = np.floor(scale * values.to_numpy(zero_copy_only=False).astype(np.float64))
            out.append(x.astype(np.int64) if np.isfinite(x).all() else None)
    return out


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances between the rows of two tables."""
    square = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)
    return np.sqrt(np.maximum(square, 0))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Rows far from each other: each the farthest from those already chosen."""
    chosen = [0]
    nearest = distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(count, len(sample)):
        farthest = int(nearest.argmax())
        if nearest[farthest] == 0:
            break
        chosen.append(farthest)
        nearest = np.minimum(nearest, distances(sample, sample[farthest : farthest + 1])[:, 0])
    return sample[chosen]


Pivots = dict[int, np.ndarray]


def _prepared(batches: Batches, scale: float, schema: pa.Schema) -> Batches:
    for batch in batches:
        ids = batch.column(0).to_pylist()
        rows = [(i, len(v), v.tobytes()) for i, v in zip(ids, whole_numbers(batch.column(1), scale), strict=True) if v is not None and i is not None]
        if rows:
            yield batch_of(schema, list(zip(*rows, strict=True)))


def _table(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, dim)


def _by_dim(batch: pa.RecordBatch, dims: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for dim in np.unique(dims).tolist():
        yield dim, np.nonzero(dims == dim)[0]


def _distance_table(batches: Batches, pivots: Pivots, schema: pa.Schema) -> Batches:
    """Vectors with their distances to all pivots of their length, and the cell of the nearest."""
    for batch in batches:
        dims = batch.column(1).to_numpy()
        cells, away = np.zeros(len(dims), np.int32), [b""] * len(dims)
        for dim, at in _by_dim(batch, dims):
            if dim in pivots:
                found = distances(_table(batch.column(2).take(pa.array(at)), dim).astype(np.float64), pivots[dim])
                cells[at] = found.argmin(1)
                for i, row in zip(at.tolist(), found, strict=True):
                    away[i] = row.tobytes()
        yield batch_of(schema, [batch.column(0), batch.column(1), cells, batch.column(2), away])


def _distances_of(column: pa.Array) -> np.ndarray:
    """The stored distances of vectors of one length, a row each."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _cell_ranges(batches: Batches, schema: pa.Schema) -> Batches:
    """For each cell met and each pivot: rows, greatest norm, least and greatest distance."""
    found: dict[tuple[int, int], list] = {}
    for batch in batches:
        dims, cells = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        for dim, at in _by_dim(batch, dims):
            x = _table(batch.column(3).take(pa.array(at)), dim).astype(np.float64)
            away = _distances_of(batch.column(4).take(pa.array(at)))
            norm = (x * x).sum(1)
            for cell in np.unique(cells[at]).tolist():
                own = cells[at] == cell
                new = [int(own.sum()), float(norm[own].max()), away[own].min(0), away[own].max(0)]
                old = found.get((dim, cell))
                if old:
                    new = [old[0] + new[0], max(old[1], new[1]), np.minimum(old[2], new[2]), np.maximum(old[3], new[3])]
                found[dim, cell] = new
    rows = [
        (dim, cell, pivot, n if pivot < 0 else 0, most, *((0.0, 0.0) if pivot < 0 else (float(low[pivot]), float(high[pivot]))))
        for (dim, cell), (n, most, low, high) in found.items()
        for pivot in range(-1, len(low))
    ]
    if rows:
        yield batch_of(schema, list(zip(*rows, strict=True)))


def _slack(*squares: np.ndarray | float) -> np.ndarray | float:
    """More than rounding can have moved a bound."""
    return 1.0 + 1e-9 * sum(squares)


def upper_bounds(q: np.ndarray, x: np.ndarray, q_away: np.ndarray, x_away: np.ndarray) -> np.ndarray:
    """No score of a query (rows) with a candidate (columns) exceeds its bound."""
    x_norm = (x * x).sum(1)
    return _slice_bounds((q * q).sum(1), q_away, x_norm, x_norm, x_away, x_away)


def _slice_bounds(
    q_norm: np.ndarray, q_away: np.ndarray, least: np.ndarray, most: np.ndarray, low: np.ndarray, high: np.ndarray
) -> np.ndarray:
    """No score of a query (rows) with a candidate of a slice (columns) exceeds its bound.

    ``least`` and ``most`` are the slices' squared norms, ``low`` and ``high`` their pivot distances.
    """
    root = np.sqrt(q_norm)[:, None]
    gap = np.maximum(np.sqrt(least)[None, :] - root, root - np.sqrt(most)[None, :])  # the origin as a pivot
    np.maximum(gap, 0, out=gap)
    for p in range(q_away.shape[1]):
        np.maximum(gap, low[None, :, p] - q_away[:, p, None], out=gap)
        np.maximum(gap, q_away[:, p, None] - high[None, :, p], out=gap)
    both = q_norm[:, None] + most[None, :]
    return (both - gap * gap) / 2 + _slack(both)


class _Slices:
    """The candidates of a block, in slices of rows at like distance from a pivot."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, away: np.ndarray, pivot: int):
        order = np.argsort(away[:, pivot], kind="stable") if away.shape[1] else np.arange(len(x))
        self.x, self.ids = x[order], ids[order]
        self.starts = np.arange(0, len(x), SLICE_ROWS)
        away, square = away[order], (self.x.astype(np.float64) ** 2).sum(1)
        self.least, self.most = (f.reduceat(square, self.starts) for f in (np.minimum, np.maximum))
        self.low, self.high = (f.reduceat(away, self.starts) for f in (np.minimum, np.maximum))

    def rows(self, slices: np.ndarray) -> np.ndarray:
        at = (self.starts[slices][:, None] + np.arange(SLICE_ROWS)).ravel()
        return at[at < len(self.x)]


def _best(q: np.ndarray, own: np.ndarray, away: np.ndarray, beat: np.ndarray, block: _Slices, k: int) -> tuple[np.ndarray, ...]:
    """Query number, id and score of the k best of each query among candidates whose score reaches ``beat``."""
    qf = q.astype(np.float64)
    q_norm = (qf * qf).sum(1)
    exact = np.sqrt(q_norm.max() * block.most.max()) < EXACT
    kind = np.float64 if exact else np.int64
    q, x = q.astype(kind), block.x.astype(kind)
    bounds = _slice_bounds(q_norm, away, block.least, block.most, block.low, block.high)
    order = np.argsort(-bounds.max(0), kind="stable")
    top = np.full((len(q), k), NO_SCORE, kind)  # the best scores so far
    reach = beat.astype(kind)
    found: list[tuple[np.ndarray, ...]] = []
    for start in range(0, len(order), SLICES):
        part = order[start : start + SLICES]
        able = bounds[:, part] >= reach[:, None]
        asking, slices = np.flatnonzero(able.any(1)), part[able.any(0)]
        if not len(asking):
            continue
        rows = block.rows(slices)
        scores = q[asking] @ x[rows].T
        scores[own[asking, None] == block.ids[rows][None, :]] = NO_SCORE
        better = np.flatnonzero((scores > top[asking].min(1)[:, None]).any(1))
        if len(better):
            at = asking[better]
            top[at] = np.partition(np.concatenate([top[at], scores[better]], 1), -k, 1)[:, -k:]
            reach[at] = np.maximum(reach[at], top[at].min(1))
        who, which = np.nonzero((scores >= reach[asking, None]) & (scores > NO_SCORE))
        found.append((asking[who], block.ids[rows[which]], scores[who, which].astype(np.int64)))
    if not found:
        return tuple(np.zeros((3, 0), np.int64))
    who, ids, scores = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((ids, -scores, who))
    who, ids, scores = who[order], ids[order], scores[order]
    first = np.searchsorted(who, who)
    kept = np.arange(len(who)) - first < k
    return who[kept], ids[kept], scores[kept]


def _answered(batches: Batches, k: int, schema: pa.Schema) -> Batches:
    """Best candidates of each query of a batch in a block."""
    for group in _groups_of(batches, by=4):
        dim = int(group.column(0)[0].as_py())
        asks = group.column(4).to_numpy(zero_copy_only=False)
        ids, beat = group.column(5).to_numpy(), group.column(6).to_numpy()
        vectors = _table(group.column(7), dim)
        x, x_ids = vectors[~asks], ids[~asks]
        q, q_ids, q_beat = vectors[asks], ids[asks], beat[asks]
        if not len(x) or not len(q):
            continue
        away = _distances_of(group.column(8))
        block, q_away = _Slices(x, x_ids, away[~asks], int(group.column(1)[0].as_py())), away[asks]
        for start in range(0, len(q), QUERIES):
            part = slice(start, start + QUERIES)
            who, found, scores = _best(q[part], q_ids[part], q_away[part], q_beat[part], block, k)
            if len(who):
                yield batch_of(schema, [q_ids[part][who], found, scores])


def _sent_on(batches: Batches, ranges: dict, schema: pa.Schema) -> Batches:
    """Queries with each other cell that may hold a score they have not beaten."""
    for batch in batches:
        dims, homes = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        beat = batch.column(5).to_numpy()
        for dim, at in _by_dim(batch, dims):
            q = _table(batch.column(3).take(pa.array(at)), dim).astype(np.float64)
            away, norm = _distances_of(batch.column(4).take(pa.array(at))), (q * q).sum(1)
            reach = np.where(beat[at] == NO_SCORE, -np.inf, beat[at])
            for cell, (most, low, high) in ranges.get(dim, {}).items():
                gap = np.maximum(low[None, :] - away, away - high[None, :]).max(1, initial=0.0)
                gap = np.maximum(gap, np.sqrt(norm) - np.sqrt(most))
                bound = (norm + most - gap * gap) / 2 + _slack(norm, most)
                go = at[(bound >= reach) & (homes[at] != cell)]
                if len(go):
                    picked = batch.take(pa.array(go))
                    others = [picked.column(i) for i in (3, 4, 5)]
                    yield batch_of(schema, [picked.column(0), picked.column(1), np.full(len(go), cell), *others])


def _parts(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def _met(queries: DataFrame, rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Batches of queries and blocks of candidates, sent to one place for each pair.

    ``cells`` has the number of blocks and batches of every cell, at most one row for each
    pivot and dimension.
    """

    def share(parts: str) -> Column:
        return F.pmod(F.xxhash64("id"), F.col(parts)).cast("int")

    def every(parts: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))

    small = F.broadcast(cells)
    asks = queries.join(small, ["dim", "cell"]).select(
        "dim", "cell", every("blocks").alias("block"), share("batches").alias("part"), F.lit(True).alias("asks"), "id", "beat", "vector", "away"
    )
    held = rows.join(small, ["dim", "cell"]).select(
        "dim", "cell", share("blocks").alias("block"), every("batches").alias("part"), F.lit(False).alias("asks"), "id", F.lit(NO_SCORE).alias("beat"), "vector", "away"
    )
    keys = ["dim", "cell", "block", "part"]
    return asks.unionAll(held).repartition(*keys).sortWithinPartitions(*keys)


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    scale: float = 64.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    workspace: Workspace | None = None,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest inner products of floor(scale * x).

    Every row with ``is_query`` is answered from all rows but those of its own id; ties go to the
    smaller id; with fewer candidates than k all are returned. Null vectors, empty ones, those
    with null or non-finite components and rows without an id take no part. Vectors are
    compared with those of their own length. Scores have to fit into a long.
    """
    spark = vectors.sparkSession
    workspace = workspace or Workspace(spark)
    plain = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("vector"), is_query.alias("asks"))
    spelled = {"id": pa.int64(), "dim": pa.int32(), "vector": pa.binary(), "cell": pa.int32(), "away": pa.binary()}

    def schema_of(*names: str) -> pa.Schema:
        return pa.schema([(n, spelled[n]) for n in names])

    task = partial(_prepared, scale=scale, schema=schema_of("id", "dim", "vector"))
    prepared = workspace.stage(arrow_map(plain.select("id", "vector"), task, "id long, dim int, vector binary"), "vectors")
    sample: dict[int, list] = {}
    for row in prepared.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect():
        sample.setdefault(row["dim"], []).append(np.frombuffer(row["vector"], np.int64))
    pivots = {d: choose_pivots(np.stack(v).astype(np.float64), PIVOTS) for d, v in sample.items()}

    # the pivot table: a row's distances are computed once and go with it
    task = partial(_distance_table, pivots=pivots, schema=schema_of("id", "dim", "cell", "vector", "away"))
    rows = workspace.stage(arrow_map(prepared, task, "id long, dim int, cell int, vector binary, away binary"), "cells")
    names = ["dim", "cell", "pivot", "n", "norm", "low", "high"]
    types = [pa.int32()] * 3 + [pa.int64()] + [pa.float64()] * 3
    task = partial(_cell_ranges, schema=pa.schema(list(zip(names, types, strict=True))))
    met = arrow_map(rows, task, "dim int, cell int, pivot int, n long, norm double, low double, high double")
    met = met.groupBy("dim", "cell", "pivot").agg(F.sum("n").alias("n"), F.max("norm").alias("norm"), F.min("low").alias("low"), F.max("high").alias("high"))
    ranges: dict[int, dict] = {}
    blocks: dict[tuple[int, int], int] = {}
    by_cell: dict[tuple[int, int], list] = {}
    for r in sorted(met.collect()):  # a row for each cell and pivot, the one before the first pivot counts
        if r["pivot"] < 0:
            blocks[r["dim"], r["cell"]] = r["n"]
        by_cell.setdefault((r["dim"], r["cell"]), []).append((r["norm"], r["low"], r["high"]))
    for (dim, cell), found in by_cell.items():
        low, high = (np.array([f[i] for f in found[1:]]) for i in (1, 2))
        ranges.setdefault(dim, {})[cell] = (found[0][0], low, high)

    asking = plain.where("asks AND id IS NOT NULL").select("id").distinct()
    queries = workspace.stage(rows.join(asking, "id", "left_semi").withColumn("beat", F.lit(NO_SCORE)), "queries")

    def with_parts(asked: DataFrame) -> DataFrame:
        counts = asked.groupBy("dim", "cell").agg(F.count("*").alias("n")).collect()
        sizes = [(r["dim"], r["cell"], _parts(blocks[r["dim"], r["cell"]], BLOCK_ROWS), _parts(r["n"], BATCH_QUERIES)) for r in counts]
        return spark.createDataFrame(sizes, "dim int, cell int, blocks int, batches int")

    answer_schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    answer = partial(_answered, k=k, schema=answer_schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def answers(asked: DataFrame, name: str) -> DataFrame:
        found = arrow_map(_met(asked, rows, with_parts(asked)), answer, "query_id long, vec_id long, score long")
        return workspace.stage(found, name)

    at_home = answers(queries, "at-home")
    reached = at_home.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k)
    reached = reached.select(F.col("query_id").alias("id"), F.col("score").alias("reached"))
    aware = queries.join(reached, "id", "left").select("id", "dim", "cell", "vector", "away", F.coalesce("reached", "beat").alias("beat"))
    sent_schema = pa.schema([*schema_of("id", "dim", "cell", "vector", "away"), ("beat", pa.int64())])
    task = partial(_sent_on, ranges=ranges, schema=sent_schema)
    sent = workspace.stage(arrow_map(aware, task, "id long, dim int, cell int, vector binary, away binary, beat long"), "sent")
    found = at_home.unionAll(answers(sent, "elsewhere")).distinct()
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
