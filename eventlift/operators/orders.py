"""Valid, valued orders of a period."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlift.functions.periods import Period

#: Marks that tell how many orders a range of ids holds.
QUANTILES = 1000

ORDER_COLUMNS = ["user_id", "order_delivery_id", "delivered_date_pt", "zone_id", "express"]


# Delivered, finalised and not deleted.
IS_VALID = "delivery_state = 'delivered' AND delivery_finalized_ind = 'Y' AND deleted_ind = 'N'"


def of_users(orders: DataFrame, users: DataFrame) -> DataFrame:
    """Orders of the given users, who should come as one row each."""
    return orders.join(users.select("user_id"), "user_id", "left_semi")


def not_of_users(orders: DataFrame, users: DataFrame) -> DataFrame:
    """Orders of everybody else. As with NOT IN, an order without a user is not kept."""
    known = orders.where("user_id IS NOT NULL")
    return known.join(users.select("user_id"), "user_id", "left_anti")


def valid_orders(
    deliveries: DataFrame,
    values: DataFrame,
    period: Period,
    users: DataFrame | None = None,
    stage: Callable[[DataFrame, str], DataFrame] | None = None,
    filter_items: int | None = None,
) -> DataFrame:
    """Valid orders delivered in ``period`` that have a value row.

    ``users`` keeps only these users' orders. The restricted orders are written first
    (``stage``): if they are few, Spark sees so and streams the value table past a
    broadcast of them, below any aggregation inside it, instead of shuffling it whole;
    if they are many, everything is shuffled on the order id once.

    ``filter_items`` is for spans of more orders than one Bloom filter of the session can tell
    apart (``session.FILTER_ITEMS``): the join is cut into ranges of ids with about so many orders
    each, see ``joined_by_range``.
    """
    orders = deliveries.where(f"{IS_VALID} AND {period.contains('delivered_date_pt')}")
    orders = orders.select(*ORDER_COLUMNS)
    if users is not None:
        orders = of_users(orders, users)
        if stage is not None:
            # Few rows survive out of each of very many scan tasks: not one file per task.
            orders = stage(orders.hint("rebalance", "order_delivery_id"), "orders_of_users")
        values = values.join(
            orders.select("order_delivery_id"), "order_delivery_id", "left_semi"
        )
    if filter_items is not None and stage is not None:
        return joined_by_range(orders, values, "order_delivery_id", filter_items, stage)
    return orders.join(values, "order_delivery_id")


def joined_by_range(
    orders: DataFrame, values: DataFrame, key: str, filter_items: int, stage: Callable[[DataFrame, str], DataFrame]
) -> DataFrame:
    """The inner join on a whole-numbered key, cut into ranges of it.

    A Bloom filter that has been given many times the ids it is made for lets everything pass, and
    billions of them fit into none that can be sent around. Where the files of ``values`` lie apart
    by key, as they do if ids ascend in time, they are grouped into ranges with about ``filter_items``
    orders each. Every range is a join of its own, with Spark's own filter of its own orders, and
    reads its own files only, so that each file is read once. Files that overlap stay in one range;
    if all do, the join is the plain one. Files beyond all orders are not read.

    The orders are written sorted by the key, so that a range reads its part of them. The driver
    sees two numbers for each file and ``QUANTILES`` for the orders.
    """
    files = file_ranges(values, key)
    if files is None or not isinstance(orders.schema[key].dataType, T.IntegralType):
        return orders.join(values, key)
    orders = stage(orders.repartitionByRange(key).sortWithinPartitions(key), "orders_by_id")
    shares = [i / QUANTILES for i in range(QUANTILES + 1)]
    total, marks = orders.agg(F.count(key), F.percentile_approx(key, shares, 10 * QUANTILES)).first()
    ranges = grouped_ranges(files, marks or [], total, filter_items)
    if len(ranges) < 2:
        return orders.join(values, key)
    joins = []
    for low, high, paths in ranges:
        inside = F.col(key).between(low, high)
        part = values.where(F.col("_metadata.file_path").isin(paths)).where(inside)
        joins.append(orders.where(inside).join(part, key))
    return reduce(DataFrame.unionAll, joins)


def file_ranges(values: DataFrame, key: str) -> list[tuple[int, int, str]] | None:
    """Least and greatest key of each file of a table; None if it is not read straight from files."""
    try:
        read = values.select(key, F.col("_metadata.file_path").alias("_path"))
    except AnalysisException:
        return None
    rows = read.groupBy("_path").agg(F.min(key).alias("low"), F.max(key).alias("high")).where("low IS NOT NULL")
    return sorted((r["low"], r["high"], r["_path"]) for r in rows.collect())


def grouped_ranges(
    files: list[tuple[int, int, str]], marks: list[int], total: int, filter_items: int
) -> list[tuple[int, int, list[str]]]:
    """Ranges (low, high, files) that do not overlap, with about ``filter_items`` orders each.

    ``marks`` are evenly spaced quantiles of the orders' keys, ``total`` how many orders there are.
    """
    if not marks:
        return []

    def below(key: int) -> float:
        return total * bisect_left(marks, key) / len(marks)

    ranges: list[tuple[int, int, list[str]]] = []
    open_to = None  # the last range's files overlap up to here
    for low, high, path in files:
        if high < marks[0] or low > marks[-1]:
            continue
        start, end, paths = ranges[-1] if ranges else (None, None, [])
        apart = open_to is None or low > open_to
        if not ranges or (apart and below(high + 1) - below(start) > filter_items):
            ranges.append((low, high, [path]))
        else:
            ranges[-1] = (start, max(end, high), [*paths, path])
        open_to = high if open_to is None else max(open_to, high)
    return ranges


def first_orders(deliveries: DataFrame, before: Period) -> DataFrame:
    """``user_id, first_order_date`` of users with a valid order before ``before`` starts.

    Valued or not. One table serves every window that starts no later.
    """
    earlier = f"delivered_date_pt < DATE '{before.start}'"
    orders = deliveries.where(f"{IS_VALID} AND {earlier} AND user_id IS NOT NULL")
    return orders.groupBy("user_id").agg(F.min("delivered_date_pt").alias("first_order_date"))
