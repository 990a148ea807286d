"""Membership at points in time, and how it changes between them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlift.functions.keys import only_for
from eventlift.functions.rates import percent

START = "subscription_start_date_time_pt"
END = "subscription_end_date_time_pt"
MEMBER, NON_MEMBER = "Member", "Non-member"


def active_at(day: date) -> str:
    """SQL: the interval holds at midnight of ``day``; both ends count, no end is open."""
    at = f"DATE '{day}'"
    return f"({START} <= {at} AND ({END} >= {at} OR {END} IS NULL))"


def status_at(users: DataFrame, intervals: DataFrame, dates: dict[str, date]) -> DataFrame:
    """A 0/1 column per named date for every user.

    Intervals are reduced to one row per user before the join: only those that hold at
    some date are read on, and a user with very many costs one row per task.
    """
    names = [f"member_{n}" for n in dates]
    active = dict(zip(names, map(active_at, dates.values())))
    held = (
        intervals.where(" OR ".join(active.values()))
        .groupBy("user_id")
        .agg(*[F.expr(f"max(CASE WHEN {a} THEN 1 ELSE 0 END) AS {n}") for n, a in active.items()])
    )
    return (
        users.select("user_id")
        .join(only_for(held, users, ["user_id"]), "user_id", "left")
        .fillna(0, names)
        .select("user_id", *names)
    )


def status_penetration(status: DataFrame, dates: dict[str, date]) -> DataFrame:
    """Number and percentage of members at each date."""
    members = {n: F.sum(f"member_{n}") for n in dates}
    return status.agg(
        F.count("*").alias("total_users"),
        *[m.alias(f"member_{n}") for n, m in members.items()],
        *[percent(m, F.count("*"), 1).alias(f"pct_{n}") for n, m in members.items()],
    )


def status_transitions(
    status: DataFrame,
    dates: dict[str, date],
    labels: tuple[str, str] = (MEMBER, NON_MEMBER),
) -> DataFrame:
    """Users per path through the dates, most frequent first.

    The total runs over the grouped rows, of which there are at most 2**dates.
    """
    member, other = labels
    names = [f"status_{n}" for n in dates]
    paths = status.groupBy(
        *[
            F.when(F.col(f"member_{n}") == 1, member).otherwise(other).alias(f"status_{n}")
            for n in dates
        ]
    ).agg(F.count("*").alias("user_count"))
    total = F.sum("user_count").over(Window.partitionBy())
    return paths.withColumn("pct_of_total", percent(F.col("user_count"), total, 1)).orderBy(
        F.desc("user_count"), *names
    )


def status_conversion(
    status: DataFrame,
    start: str,
    end: str,
    label: str = "New signups (post-event)",
) -> DataFrame:
    """Users without membership at ``start`` who have it at ``end``."""
    base = F.count_if(F.col(f"member_{start}") == 0)
    converted = F.count_if((F.col(f"member_{start}") == 0) & (F.col(f"member_{end}") == 1))
    return status.agg(
        F.lit(label).alias("metric"),
        converted.alias("user_count"),
        base.alias(f"non_member_on_{start}"),
        percent(converted, base, 1).alias("conversion_rate_pct"),
    )
