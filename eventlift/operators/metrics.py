"""Value and order counts per period, and their totals."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlift.functions.keys import only_for
from eventlift.functions.periods import EventSpec, Period
from eventlift.functions.rates import money, percent_change


def _exprs(texts: Iterable[str]) -> list[Column]:
    return [F.expr(t) for t in texts]


def metric_columns(periods: list[Period]) -> list[str]:
    return [f"gtv_{p.name}" for p in periods] + [f"orders_{p.name}" for p in periods]


def zone_totals(
    orders: DataFrame, periods: list[Period], flags: dict[str, str] | None = None
) -> DataFrame:
    """Per user and zone: value and distinct orders of each period, and any-flags.

    ``own_*`` counts an order that has rows in several zones in one of them only, so that
    it adds up to the user's distinct orders. Orders come partitioned by their id from the
    join with their values; the steps per order stay in that stage, and only sums, combined
    on the map side, are shuffled. A user with a third of all orders costs a row per task.

    ``flags`` maps a column name to a condition that any order of the key may meet.
    """
    flags = flags or {}
    names = [p.name for p in periods]
    inside = {p.name: p.contains("delivered_date_pt") for p in periods}
    per_order = orders.groupBy("user_id", "zone_id", "order_delivery_id").agg(
        *_exprs(f"sum(CASE WHEN {inside[n]} THEN gtv_amt_usd END) AS gtv_{n}" for n in names),
        *_exprs(f"max(CASE WHEN {inside[n]} THEN 1 ELSE 0 END) AS orders_{n}" for n in names),
        *_exprs(f"max(CASE WHEN {on} THEN 1 ELSE 0 END) AS {flag}" for flag, on in flags.items()),
    )
    so_far = "OVER (PARTITION BY user_id, order_delivery_id ORDER BY zone_id ROWS UNBOUNDED PRECEDING)"
    counted_once = per_order.selectExpr(
        "*", *[f"IF(sum(orders_{n}) {so_far} = 1, orders_{n}, 0) AS own_{n}" for n in names]
    )
    return counted_once.groupBy("user_id", "zone_id").agg(
        *_exprs(f"max({flag}) AS {flag}" for flag in flags),
        *_exprs(f"CAST(coalesce(sum(gtv_{n}), 0) AS DECIMAL(28,2)) AS gtv_{n}" for n in names),
        *_exprs(f"sum({kind}_{n}) AS {kind}_{n}" for kind in ("orders", "own") for n in names),
    )


def user_totals(totals: DataFrame, periods: list[Period]) -> DataFrame:
    """Per user: value and distinct orders of each period, from ``zone_totals``."""
    names = [p.name for p in periods]
    return totals.groupBy("user_id").agg(
        *_exprs(f"CAST(sum(gtv_{n}) AS DECIMAL(28,2)) AS gtv_{n}" for n in names),
        *_exprs(f"sum(own_{n}) AS orders_{n}" for n in names),
    )


def metrics_of(entities: DataFrame, totals: DataFrame, periods: list[Period]) -> DataFrame:
    """Every entity row with its user's metrics, zero where there were no orders."""
    names = metric_columns(periods)
    wanted = only_for(totals.where("user_id IS NOT NULL"), entities, ["user_id"])
    joined = entities.join(user_totals(wanted, periods), "user_id", "left")
    return joined.fillna(0, names).select(*entities.columns, *names)


def window_metrics(
    entities: DataFrame, orders: DataFrame, periods: list[Period]
) -> DataFrame:
    """``metrics_of`` straight from orders."""
    return metrics_of(entities, zone_totals(orders, periods), periods)


def guest_users(linked: DataFrame) -> DataFrame:
    """Distinct identities with an account; one account under two names is two rows."""
    return (
        linked.where("user_id IS NOT NULL")
        .select("user_id", "first_name", "last_name", "email")
        .distinct()
    )


def window_summary(metrics: DataFrame, spec: EventSpec) -> DataFrame:
    """One row of totals, changes and averages over all metric rows."""
    users = F.count("*")
    columns = [users.alias("total_matched_guests")]
    for n in spec.lengths:
        pre, post = F.sum(f"gtv_{n}d_pre"), F.sum(f"gtv_{n}d_post")
        columns += [
            pre.cast("double").alias(f"total_gtv_{n}d_pre"),
            post.cast("double").alias(f"total_gtv_{n}d_post"),
            (post - pre).cast("double").alias(f"gtv_{n}d_change"),
            percent_change(pre, post).alias(f"gtv_{n}d_pct_change"),
        ]
    columns += [F.sum(f"orders_{p.name}").alias(f"total_orders_{p.name}") for p in spec.periods]
    columns += [
        money(F.try_divide(F.sum(f"gtv_{p.name}").cast("double"), users)).alias(
            f"avg_gtv_{p.name}_per_user"
        )
        for p in spec.periods
    ]
    return metrics.agg(*columns)


# The report labels.
TREATMENT_LABEL = "Treatment (Event Attendees)"
CONTROL_LABEL = "Control (Matched Non-Attendees)"


def group_totals(metrics: DataFrame, label: str, spec: EventSpec) -> DataFrame:
    """One labelled row of totals and changes."""
    columns = [F.count("*").alias("users")]
    for n in spec.lengths:
        pre, post = F.sum(f"gtv_{n}d_pre"), F.sum(f"gtv_{n}d_post")
        columns += [
            money(pre).alias(f"total_gtv_{n}d_pre"),
            money(post).alias(f"total_gtv_{n}d_post"),
            money(post - pre).alias(f"gtv_{n}d_change"),
            percent_change(pre, post).alias(f"gtv_{n}d_pct_change"),
        ]
    totals = metrics.agg(*columns)
    return totals.select(F.lit(label).alias("group_name"), *totals.columns)


def compare_groups(treatment: DataFrame, control: DataFrame, spec: EventSpec) -> DataFrame:
    """Treatment and control totals, always two rows."""
    return group_totals(treatment, TREATMENT_LABEL, spec).unionByName(
        group_totals(control, CONTROL_LABEL, spec)
    )
