"""Pre-event features of attendees and of everybody else."""

from __future__ import annotations

from pyspark.sql import DataFrame

from eventlift.functions.keys import only_for
from eventlift.functions.periods import EventSpec
from eventlift.operators.metrics import zone_totals

BLOCK = ["zone_id", "is_express"]


def feature_columns(spec: EventSpec) -> list[str]:
    """The columns a distance is taken over, in the order in which it is summed."""
    names = [p.name for p in spec.pre_periods]
    return [f"gtv_{n}" for n in names] + [f"orders_{n}" for n in names] + ["account_age_days"]


def _metric_order(spec: EventSpec) -> list[str]:
    return [c for p in spec.pre_periods for c in (f"orders_{p.name}", f"gtv_{p.name}")]


def order_flags(spec: EventSpec) -> dict[str, str]:
    """What ``zone_totals`` has to note for the features."""
    return {"is_express": f"express = 'Y' AND {spec.before.contains('delivered_date_pt')}"}


def feature_totals(orders: DataFrame, spec: EventSpec) -> DataFrame:
    """Totals over the days before the event alone."""
    before = orders.where(spec.before.contains("delivered_date_pt"))
    return zone_totals(before, spec.pre_periods, order_flags(spec))


def _zone_features(totals: DataFrame, spec: EventSpec) -> DataFrame:
    """Per user and zone ordered from (no zone is a zone of its own) before the event."""
    return totals.where(f"orders_{spec.before.name} > 0").select(
        "user_id", "zone_id", "is_express", *_metric_order(spec)
    )


def _account_age(spec: EventSpec) -> str:
    return f"datediff(DATE '{spec.event_date}', activation_date_pt) AS account_age_days"


def treatment_features(
    users: DataFrame, totals: DataFrame, dim_user: DataFrame, spec: EventSpec
) -> DataFrame:
    """One row per attendee and zone ordered from; one row if there were no orders.

    ``totals`` are ``zone_totals`` with the flags of ``order_flags``.
    """
    features = only_for(_zone_features(totals, spec), users, ["user_id"])
    dims = dim_user.select("user_id", "activation_date_pt", "activation_zone_id")
    dims = only_for(dims, users, ["user_id"])
    joined = users.select("user_id").join(dims, "user_id", "left").join(features, "user_id", "left")
    measures = ["is_express", *_metric_order(spec)]
    return joined.fillna(0, measures).selectExpr(
        "user_id",
        "activation_date_pt",
        _account_age(spec),
        "coalesce(zone_id, activation_zone_id) AS zone_id",
        *measures,
        "'treatment' AS group_type",
    )


def candidate_pool(totals: DataFrame, dim_user: DataFrame, spec: EventSpec) -> DataFrame:
    """The same features for the users of the given totals, where value was positive."""
    features = _zone_features(totals, spec).where(f"gtv_{spec.before.name} > 0")
    dims = dim_user.select("user_id", "activation_date_pt", "activation_zone_id")
    return features.join(dims, "user_id", "left").selectExpr(
        "user_id",
        "activation_date_pt",
        _account_age(spec),
        "coalesce(zone_id, activation_zone_id) AS zone_id",
        "is_express",
        *_metric_order(spec),
    )


def scale_name(feature: str) -> str:
    return "std_account_age" if feature == "account_age_days" else f"std_{feature.removesuffix('_pre')}"


def feature_scales(treatment: DataFrame, spec: EventSpec) -> DataFrame:
    """Sample standard deviation of every feature over the treatment rows."""
    return treatment.selectExpr(
        *[f"stddev_samp(CAST({c} AS DOUBLE)) AS {scale_name(c)}" for c in feature_columns(spec)]
    )
