"""Folded join keys and a left lookup that survives hot NULL keys."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Stage = Callable[[DataFrame, str], DataFrame]

NULL_KEY_SPREAD = 1024
#: Rows of the right side under one key up to which they meet the left side in one task.
KEY_ROWS = 1 << 15
#: Keys that a sketch reports and tracks: none with more than some 1 / ``TRACKED_KEYS`` of the rows is missed.
HEAVY_KEYS, TRACKED_KEYS = 1000, 16_384


def column(name: str) -> Column:
    """The column of exactly that name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fold(key: str | Column, blank_as_null: bool = False) -> Column:
    """Case-fold and strip ASCII spaces, the form in which identities are compared."""
    folded = F.lower(F.trim(column(key) if isinstance(key, str) else key))
    return F.nullif(folded, F.lit("")) if blank_as_null else folded


def left_lookup(
    left: DataFrame, right: DataFrame, on: list[str], only_wanted: bool = False
) -> DataFrame:
    """Left equi-join on ``on``; the key columns of ``right`` are not kept.

    A NULL key never matches, yet a plain join sends all of them to one task. Here
    each NULL-keyed row gets one of many spread numbers inside a struct key, so those
    rows are shuffled evenly; rows with a full key carry 0 and match as usual.
    Hot non-NULL keys are left to AQE, which may split the left side of a left join;
    ``spread_lookup`` also splits the right.

    ``only_wanted`` first reduces ``right`` to the keys of ``left``, as ``only_for`` does, by the
    same key, so that ``right`` is shuffled once for both.
    """
    missing = reduce(or_, [F.col(c).isNull() for c in on])
    spread = F.when(
        missing, F.pmod(F.xxhash64(*map(column, left.columns)), F.lit(NULL_KEY_SPREAD)) + 1
    ).otherwise(F.lit(0).cast("bigint"))
    keyed = left.withColumn("_key", F.struct(*on, spread.alias("spread")))
    wanted = right.dropna(subset=on).select(
        F.struct(*on, F.lit(0).cast("bigint").alias("spread")).alias("_key"),
        *[c for c in right.columns if c not in on],
    )
    if only_wanted:
        wanted = wanted.join(keyed.where(~missing).select("_key"), "_key", "left_semi")
    return keyed.join(wanted, "_key", "left").drop("_key")


def spread_lookup(
    left: DataFrame, right: DataFrame, on: list[str], wanted: DataFrame, stage: Stage | None = None
) -> DataFrame:
    """``left_lookup`` of wanted rows, those under one key of ``right`` dealt out among tasks.

    ``wanted`` holds the keys of ``left``, others too. Keys with more than ``KEY_ROWS`` rows on the
    right are joined apart: their right rows are dealt out by a hash, as many parts as the key
    needs, and their left rows repeated for each part. Such a key has partners, so that an
    inner join keeps all of its left rows.

    With ``stage`` the wanted right rows are written once, and a sketch of the most frequent keys is
    taken of these; the driver sees the heaviest few. Without it all keys are counted first.
    """
    if stage is None:
        counts = right.dropna(subset=on).groupBy(*on).agg(F.count("*").alias("_rows"))
        counts = only_for(counts, wanted, on)
        if (counts.agg(F.max("_rows")).first()[0] or 0) <= KEY_ROWS:
            return left_lookup(left, right, on, only_wanted=True)
        hot = counts.where(F.col("_rows") > KEY_ROWS)
    else:
        right = stage(only_for(right.dropna(subset=on), wanted, on), "wanted_accounts")
        heaviest = F.expr(f"approx_top_k(xxhash64({', '.join(on)}), {HEAVY_KEYS}, {TRACKED_KEYS})")
        heavy = [(k["item"], k["count"]) for k in right.agg(heaviest).first()[0] if k["count"] > KEY_ROWS]
        if not heavy:
            return left_lookup(left, right, on)
        counted = right.sparkSession.createDataFrame(heavy, "_hash long, _rows long")
        keys = right.withColumn("_hash", F.xxhash64(*on)).join(counted, "_hash")
        hot = keys.groupBy(*on).agg(F.max("_rows").alias("_rows"))
    parts = hot.select(*on, F.ceil(F.col("_rows") / KEY_ROWS).cast("int").alias("_parts"))
    values = [c for c in right.columns if c not in on]
    columns = [column(c) for c in left.columns]
    cold = left_lookup(
        left.join(parts, on, "left_anti").select(*columns),
        right.join(parts, on, "left_anti").select(*right.columns),
        on,
        only_wanted=True,
    )
    dealt = right.join(parts, on).withColumn("_part", F.pmod(F.xxhash64(*values), F.col("_parts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    repeated = left.join(parts, on).withColumn("_part", every).select(*columns, "_part")
    met = repeated.join(dealt.select(*on, "_part", *values), [*on, "_part"])
    return cold.unionAll(met.select(*columns, *values))


def only_for(rows: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` whose key occurs in ``wanted``, to be applied before a left join.

    A left join cannot broadcast its left side, so a few guests would have every account
    shuffled. If the wanted keys are small enough for Spark to broadcast, this drops the
    other rows as they are scanned, below an aggregation too (the optimizer pushes a semi
    join there exactly if it can be broadcast). Otherwise it shares the shuffle of the
    join that follows.
    """
    return rows.join(wanted.select(*on).distinct(), on, "left_semi")
