"""Resolving guests to accounts, and how well each way of matching does."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlift.functions.keys import column, fold, left_lookup, only_for, spread_lookup
from eventlift.functions.rates import percent

EMAIL = ("email",)
NAME = ("first_name", "last_name")
EMAIL_AND_NAME = EMAIL + NAME


@dataclass(frozen=True)
class Strategy:
    """Key sets tried in order; a later one only serves guests not matched before."""

    label: str
    steps: tuple[tuple[str, ...], ...]
    one_account_per_key: bool = False


# The report labels.
STRATEGIES = {
    "email": Strategy("Email Only", (EMAIL,)),
    "name": Strategy("First + Last Name Only", (NAME,)),
    "all": Strategy("Email + First + Last Name", (EMAIL_AND_NAME,)),
    "cascade": Strategy("Email OR Name (Cascading)", (EMAIL, NAME)),
    "priority": Strategy("Union: Email priority, then Name", (EMAIL, NAME), True),
}


def status_is(status: str, column: str = "status") -> Column:
    """Case-insensitive, without trimming; a NULL status does not pass."""
    return F.lower(column) == status.lower()


def _accounts(
    users: DataFrame, keys: tuple[str, ...], blank_as_null: bool, one_per_key: bool
) -> DataFrame:
    folded = users.select(
        F.col("id").alias("_id"), *[fold(k, blank_as_null).alias(f"_{k}") for k in keys]
    )
    if not one_per_key:
        return folded
    return folded.groupBy(*[f"_{k}" for k in keys]).agg(F.min("_id").alias("_id"))


def link_identity(
    guests: DataFrame,
    users: DataFrame,
    strategy: str = "email",
    status: str | None = None,
    dedupe: str | None = None,
    blank_as_null: bool = False,
    stage: Callable[[DataFrame, str], DataFrame] | None = None,
) -> DataFrame:
    """``user_id`` followed by every guest column, guests without an account included.

    Several accounts under one key give one row each, and a blank key equals a blank
    key, unless ``dedupe="min_id"`` or ``blank_as_null`` says otherwise. With ``stage`` the accounts
    of the guests' keys are written, and hot keys are found among these (``spread_lookup``).
    """
    if dedupe not in (None, "min_id"):
        raise ValueError(f"unknown dedupe {dedupe!r}")
    if "user_id" in map(str.lower, guests.columns):
        raise ValueError("the guest list has a column user_id, which is the name of the result")
    plan = STRATEGIES[strategy]
    one_per_key = plan.one_account_per_key or dedupe == "min_id"
    kept = guests.where(status_is(status)) if status else guests
    columns = [column(c) for c in guests.columns]
    linked = kept.withColumn("_user", F.lit(None).cast(users.schema["id"].dataType))
    for keys in plan.steps:
        on = [f"_{k}" for k in keys]
        folded = {f"_{k}": fold(k, blank_as_null) for k in keys}
        accounts = _accounts(users, keys, blank_as_null, one_per_key)
        # A guest who already has an account gets NULL keys: no match, no hot key, and no
        # account is looked up for them.
        open_guest = F.col("_user").isNull()
        named = linked.withColumns({n: F.when(open_guest, c) for n, c in folded.items()})
        if one_per_key:
            found = left_lookup(named, accounts, on, only_wanted=True)
        else:
            wanted = kept.select(*[c.alias(n) for n, c in folded.items()])
            found = spread_lookup(named, accounts, on, wanted, stage)
        linked = found.select(*columns, F.coalesce("_user", "_id").alias("_user"))
    return linked.select(F.col("_user").alias("user_id"), *columns)


def match_stats(linked: DataFrame) -> DataFrame:
    """Total, matched, not matched and match rate of a linked guest list."""
    total, matched = F.count("*"), F.count("user_id")
    return linked.agg(
        total.alias("total_checked_in_guests"),
        matched.alias("matched_with_userid"),
        (total - matched).alias("not_matched"),
        percent(matched, total, 2).alias("match_rate_pct"),
    )


def match_report(
    guests: DataFrame,
    users: DataFrame,
    strategies: tuple[str, ...] = tuple(STRATEGIES),
    blank_as_null: bool = False,
    stage: Callable[[DataFrame, str], DataFrame] | None = None,
) -> DataFrame:
    """One labelled row per strategy, counted without building the joined rows.

    Guests and accounts are first counted per key, so a key that a third of both
    sides share meets as one row with one row; the size of the fan-out is then the
    product of the two counts. With ``stage`` the counted guests are written, so that the
    guest list is read once, not once for each key set.
    """
    chosen = [STRATEGIES[s] for s in strategies]
    key_sets = list(dict.fromkeys(keys for s in chosen for keys in s.steps))
    columns = list(dict.fromkeys(k for keys in key_sets for k in keys))
    keyed = (
        guests.select(*[fold(k, blank_as_null).alias(f"_{k}") for k in columns])
        .groupBy(*[f"_{k}" for k in columns])
        .agg(F.count("*").alias("_guests"))
    )
    keyed = stage(keyed, "guest_keys") if stage else keyed

    # Every key set is a row of its own, tagged, so that the accounts are read and shuffled once.
    def tagged(rows: DataFrame, *others: str) -> DataFrame:
        sets = [
            F.struct(
                F.lit(i).alias("_tag"),
                *[(F.col(f"_{c}") if c in keys else F.lit("")).alias(f"_k{j}") for j, c in enumerate(columns)],
            )
            for i, keys in enumerate(key_sets)
        ]
        return rows.select(*others, F.inline(F.array(*sets)))

    on = ["_tag", *[f"_k{j}" for j in range(len(columns))]]
    names = [f"_{k}" for k in columns]
    wanted = tagged(keyed, *names, "_guests")
    accounts = tagged(users.select(F.col("id").alias("_id"), *[fold(k, blank_as_null).alias(f"_{k}") for k in columns]), "_id")
    per_key = (
        only_for(accounts.dropna(subset=on), wanted, on)
        .groupBy(*on)
        .agg(F.count("*").alias("_rows"), F.count("_id").alias("_ids"))
    )
    of = lambda i, n: F.max(F.when(F.col("_tag") == i, F.col(n)))
    counted = left_lookup(wanted, per_key, on).groupBy(*names, "_guests").agg(
        *[of(i, "_rows").alias(f"rows_{'_'.join(keys)}") for i, keys in enumerate(key_sets)],
        *[of(i, "_ids").alias(f"ids_{'_'.join(keys)}") for i, keys in enumerate(key_sets)],
    )

    sums, rows = [], []
    for i, plan in enumerate(chosen):
        # Joined rows of one guest so far: those with an account, those without.
        have, without = F.lit(0), F.lit(1)
        for keys in plan.steps:
            tag = "_".join(keys)
            n_rows = F.coalesce(F.col(f"rows_{tag}"), F.lit(0))
            n_ids = F.coalesce(F.col(f"ids_{tag}"), F.lit(0))
            if plan.one_account_per_key:
                n_rows, n_ids = F.least(n_rows, F.lit(1)), F.least(n_ids, F.lit(1))
            have = have + without * n_ids
            without = without * (F.greatest(n_rows, F.lit(1)) - n_ids)
        guests_n = F.col("_guests")
        sums.append(F.coalesce(F.sum(guests_n * (have + without)), F.lit(0)).alias(f"total_{i}"))
        sums.append(F.coalesce(F.sum(guests_n * have), F.lit(0)).alias(f"matched_{i}"))
        total, matched = F.col(f"total_{i}"), F.col(f"matched_{i}")
        rows.append(
            F.struct(
                F.lit(plan.label).alias("join_strategy"),
                total.alias("total_guests"),
                matched.alias("matched"),
                (total - matched).alias("not_matched"),
                percent(matched, total, 2).alias("match_rate_pct"),
            )
        )
    return counted.agg(*sums).select(F.inline(F.array(*rows)))
