"""Connected components of a graph given as rows of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlift import Workspace


def _is_flat(edges: DataFrame) -> bool:
    """Whether every id hangs on one other that hangs on none."""
    parents = edges.groupBy("u").agg(F.count("*").alias("n"))
    deep = edges.select(F.col("v").alias("u")).distinct().join(parents.select("u"), "u", "left_semi")
    return parents.where("n > 1").limit(1).isEmpty() and deep.limit(1).isEmpty()


def _lowest(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame, workspace: Workspace) -> DataFrame:
    """``id`` and ``component``, the least id reached, for every id on an edge (``u``, ``v``).

    Rounds of large stars and small stars: each node's larger neighbours, then its smaller
    ones, are hung on the least neighbour, until every tree is a star. A node's neighbours are
    never gathered; a hot node's edges meet its minimum in a join. Every round is written.
    """
    ordered = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    current = workspace.stage(ordered.distinct(), "edges")
    while not _is_flat(current):
        both = current.unionAll(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.join(_lowest(both), "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .distinct()
        )
        lowest = _lowest(large)
        small = large.join(lowest, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        hung = small.unionAll(lowest.select("u", F.col("m").alias("v"))).distinct()
        current = workspace.stage(hung, "edges")
    roots = current.select(F.col("v").alias("id")).distinct()
    return current.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(
        roots.select("id", F.col("id").alias("component"))
    )
