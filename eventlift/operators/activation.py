"""Did people who were inactive before the event order after it?"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlift.functions.keys import only_for
from eventlift.functions.periods import EventSpec, Period
from eventlift.functions.rates import money, percent
from eventlift.operators.metrics import CONTROL_LABEL, TREATMENT_LABEL

#: Hexadecimal digits of a digest that place it among all.
DIGITS = 10
DIGESTS = 16**DIGITS
BUCKETS = 1 << 16
#: Accounts drawn for each one wanted, and how many times more each further round draws.
DRAWN, DRAWN_MORE = 64, 16


def inactive(metrics: DataFrame, days: int) -> DataFrame:
    """Rows without value in the window before the event.

    Judged by value, so someone with only valueless orders counts as inactive.
    """
    return metrics.where(F.col(f"gtv_{days}d_pre") == 0)


def _ordered(days: int) -> Column:
    return F.col(f"orders_{days}d_post") > 0


def activation_overall(metrics: DataFrame, days: int = 91) -> DataFrame:
    """Inactive people, how many ordered afterwards, and what they spent."""
    value = F.col(f"gtv_{days}d_post")
    activated = F.count_if(_ordered(days))
    spent = F.sum(F.when(_ordered(days), value)).cast("double")
    return inactive(metrics, days).agg(
        F.count("*").alias("total_no_pre_activity"),
        activated.alias("activated_post_event"),
        percent(activated, F.count("*"), 1).alias("activation_rate_pct"),
        money(F.sum(value)).alias("total_gtv_from_activated"),
        F.round(F.try_divide(spent, activated), 2).alias("avg_gtv_per_activated"),
        F.sum(f"orders_{days}d_post").alias("total_orders_from_activated"),
    )


def activation_by_window(metrics: DataFrame, spec: EventSpec) -> DataFrame:
    """The same inactive people, activated within each window length."""
    return inactive(metrics, max(spec.lengths)).agg(
        F.count("*").alias("total_inactive_pre"),
        *[F.count_if(_ordered(n)).alias(f"activated_{n}d_post") for n in spec.lengths],
        *[money(F.sum(f"gtv_{n}d_post")).alias(f"gtv_{n}d_post") for n in spec.lengths],
    )


def with_user_type(people: DataFrame, first: DataFrame, before: Period) -> DataFrame:
    """``dormant`` if the user's first order lies before the window, else ``new``.

    ``first`` is ``first_orders`` of a window that starts no earlier.
    """
    earlier = first.where(f"first_order_date < DATE '{before.start}'")
    earlier = only_for(earlier, people, ["user_id"]).select(F.col("user_id").alias("_earlier"))
    joined = people.join(earlier, people["user_id"] == earlier["_earlier"], "left")
    return joined.withColumn(
        "user_type", F.when(F.col("_earlier").isNotNull(), "dormant").otherwise("new")
    ).drop("_earlier")


def _rates(days: int, total_name: str) -> list[Column]:
    activated = F.count_if(_ordered(days))
    return [
        F.count("*").alias(total_name),
        activated.alias("activated"),
        percent(activated, F.count("*"), 1).alias("activation_rate_pct"),
        money(F.sum(f"gtv_{days}d_post")).alias("total_gtv"),
    ]


def activation_by_type(typed: DataFrame, control: DataFrame, days: int) -> DataFrame:
    """Treatment and control rows for new and dormant users.

    Both inputs carry ``user_type`` and hold inactive people only.
    """

    def rows(people: DataFrame, label: str) -> DataFrame:
        per_type = people.groupBy("user_type").agg(*_rates(days, "total_users"))
        return per_type.select(F.lit(label).alias("group_name"), *per_type.columns)

    return rows(typed, "Treatment").unionByName(rows(control, "Control")).orderBy(
        "user_type", "group_name"
    )


def activation_summary(metrics: DataFrame, control: DataFrame, days: int) -> DataFrame:
    """Treatment and control rows over all inactive people."""

    def row(people: DataFrame, label: str) -> DataFrame:
        total = people.agg(*_rates(days, "total_inactive"))
        return total.select(F.lit(label).alias("group_name"), *total.columns)

    return row(inactive(metrics, days), TREATMENT_LABEL).unionByName(
        row(control, CONTROL_LABEL)
    )


def activation_lift(by_type: DataFrame) -> DataFrame:
    """Treatment rate minus control rate in percentage points, per type and overall.

    Rates are taken from the counts, not from the rounded rates.
    """

    def of(group: str, column: str) -> Column:
        return F.sum(F.when(F.col("group_name") == group, F.col(column)))

    def rate(group: str) -> Column:
        part, whole = of(group, "activated"), of(group, "total_users")
        return F.try_divide(part.cast("double") * 100, whole.cast("double"))

    overall = F.grouping("user_type") == 1
    return (
        by_type.rollup("user_type")
        .agg(
            F.when(overall, "overall").otherwise(F.col("user_type")).alias("_type"),
            F.round(rate("Treatment"), 1).alias("treatment_rate_pct"),
            F.round(rate("Control"), 1).alias("control_rate_pct"),
            F.round(rate("Treatment") - rate("Control"), 1).alias("lift_pp"),
        )
        .drop("user_type")
        .withColumnRenamed("_type", "user_type")
    )


def _inactive_of(
    accounts: DataFrame, linked_users: DataFrame, totals: DataFrame, first: DataFrame, before: Period
) -> DataFrame:
    """``user_id, digest, user_type`` of the accounts without a guest and without value in ``before``."""
    drawn = accounts.distinct()
    spent = (
        only_for(totals, drawn, ["user_id"])
        .groupBy("user_id")
        .agg(F.sum(f"gtv_{before.name}").alias("value"))
        .where("value != 0")
    )
    pool = drawn.join(linked_users.select("user_id"), "user_id", "left_anti")
    return with_user_type(pool.join(spent.select("user_id"), "user_id", "left_anti"), first, before)


def _lowest(typed: DataFrame, quotas: dict[str, int], limit: int) -> DataFrame:
    """Of each type as many rows as its quota, those of the lowest digest.

    No type is ever sorted as a whole: rows are counted per bucket of the digests below ``limit``, whole
    buckets below the quota are taken, and only rows inside a bucket are ranked. The bucket
    table has at most ``BUCKETS`` rows per type.
    """
    quota = F.coalesce(*[F.when(F.col("user_type") == t, F.lit(q)) for t, q in quotas.items()])
    spread = typed.withColumn("bucket", F.floor(_place() * BUCKETS / F.lit(limit)))
    earlier = Window.partitionBy("user_type").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    buckets = (
        spread.groupBy("user_type", "bucket")
        .agg(F.count("*").alias("n"))
        .withColumn("taken_before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .withColumn("quota", quota)
        .where("taken_before < quota")
        .select("user_type", "bucket", "taken_before", "quota")
    )
    in_bucket = Window.partitionBy("user_type", "bucket").orderBy("digest", "user_id")
    return (
        spread.join(F.broadcast(buckets), ["user_type", "bucket"])
        .withColumn("rank", F.row_number().over(in_bucket))
        .where(F.col("taken_before") + F.col("rank") <= F.col("quota"))
        .select("user_id", "user_type")
    )


def _place() -> Column:
    """Where a digest lies among all, as a whole number below ``DIGESTS``."""
    return F.conv(F.substring("digest", 1, DIGITS), 16, 10).cast("bigint")


def stratified_inactive_control(
    users: DataFrame,
    linked_users: DataFrame,
    typed_treatment: DataFrame,
    totals: DataFrame,
    first: DataFrame,
    before: Period,
    stage: Callable[[DataFrame, str], DataFrame],
) -> DataFrame:
    """As many inactive non-attendees of each type as there are inactive attendees.

    The pool is every account without a guest and without value in ``before``, judged by
    ``totals``, the ``zone_totals`` of valid orders; ``first`` tells new from dormant. Within
    a type the users with the lowest MD5 of their id are taken, so the choice is random
    with respect to behaviour and the same on every run.

    The pool is never built. Accounts are drawn by a threshold on the digest in the scan, some for
    each one wanted, and only these are looked up. Of a type with enough of them the lowest
    are those of the pool; for other types the threshold is raised until there are, or all
    accounts are drawn. The driver sees the number of accounts and two numbers a type and round.
    """
    counted = typed_treatment.groupBy("user_type").agg(F.count("*").alias("quota"))
    wanted = {r["user_type"]: r["quota"] for r in counted.collect()}
    accounts = users.select(F.col("id").alias("user_id")).where("user_id IS NOT NULL")
    accounts = accounts.withColumn("digest", F.md5(F.col("user_id").cast("string")))
    chosen = accounts.where(F.lit(False)).select("user_id", F.lit("").alias("user_type"))
    share = DRAWN * sum(wanted.values()) / max(1, accounts.count())
    limit = min(DIGESTS, int(share * DIGESTS) + 1)
    while wanted:
        drawn = accounts.where(_place() < limit) if limit < DIGESTS else accounts
        pool = _inactive_of(drawn, linked_users, totals, first, before)
        typed = stage(pool.where(F.col("user_type").isin(list(wanted))), "inactive_drawn")
        found = {r["user_type"]: r["count"] for r in typed.groupBy("user_type").count().collect()}
        enough = {t: q for t, q in wanted.items() if limit == DIGESTS or found.get(t, 0) >= q}
        if enough:
            chosen = chosen.unionAll(_lowest(typed.where(F.col("user_type").isin(list(enough))), enough, limit))
        wanted = {t: q for t, q in wanted.items() if t not in enough}
        limit = min(DIGESTS, limit * DRAWN_MORE)
    return chosen
