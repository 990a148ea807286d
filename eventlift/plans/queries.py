"""Registered queries: every operator over the whole of the given tables.

Each query is a study of its own, so it builds every step it needs and shares nothing
with the query before it.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlift.functions.periods import EventSpec
from eventlift.functions.rates import as_doubles
from eventlift.operators import identity
from eventlift.plans.study import EventStudy
from eventlift.sources import ingest
from eventlift.sources.fixtures import EVENT, FixtureTables, guest_export, load
from eventlift.sources.history import FirstOrderHistory
from eventlift.sources.session import tune
from eventlift.sources.workspace import Workspace

Query = Callable[[SparkSession, str], DataFrame]


def _study(spark: SparkSession, sf_dir: str, **options: bool | int) -> EventStudy:
    return EventStudy(FixtureTables(tune(spark), sf_dir), EVENT, Workspace(spark), **options)


def _of_study(build: Callable[[EventStudy], DataFrame], **options: bool | int) -> Query:
    return lambda spark, sf_dir: as_doubles(build(_study(spark, sf_dir, **options)))


def _before(build: Callable[[EventStudy], DataFrame], **options: bool | int) -> Query:
    return _of_study(build, before_only=True, **options)


def _of_export(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(guest_export(load(spark, sf_dir, "customer")))


def _link(strategy: str, dedupe: str | None = None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = FixtureTables(tune(spark), sf_dir)
        return identity.link_identity(t.guestlist, t.users, strategy, dedupe=dedupe, stage=Workspace(spark).stage)

    return run


def _match_rate(*strategies: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = FixtureTables(tune(spark), sf_dir)
        return identity.match_report(t.guestlist, t.users, strategies, stage=Workspace(spark).stage)

    return run


def _ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export written as CSV files, then loaded into a table with clean headers."""
    export = guest_export(load(spark, sf_dir, "customer"))
    root = Workspace(spark).root
    options = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    export.write.options(**options).csv(f"{root}/export")
    return ingest.ingest(spark, f"{root}/export", f"{root}/guestlist", schema=export.schema)


def _by_range(spark: SparkSession, sf_dir: str) -> EventStudy:
    """A study whose values lie in files by order id and are joined a range of ids at a time."""
    study = _study(spark, sf_dir, filter_items=500)
    values = study.tables.values.repartitionByRange(8, "order_delivery_id")
    study.tables.values = study.workspace.stage(values, "values")
    return study


def _kept_history(spark: SparkSession, sf_dir: str) -> EventStudy:
    """A study whose history of first orders was begun by two earlier studies and is extended here."""
    study = _study(spark, sf_dir)
    history = FirstOrderHistory(spark, f"{study.workspace.root}/first-orders", settle_days=30)
    for days in (400, 91):
        earlier = EventSpec(EVENT.event_date - timedelta(days=days))
        history.before(study.tables.deliveries, earlier.before)
    study.history = history
    return study


def _first_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = _kept_history(spark, sf_dir).first_orders
    return first.select("user_id", F.col("first_order_date").cast("string").alias("first_order_date"))


def _with_text_date(df: DataFrame) -> DataFrame:
    return df.withColumn("activation_date_pt", F.col("activation_date_pt").cast("string"))


def _rounded_scales(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) for c in df.columns])


def _rounded_distance(df: DataFrame) -> DataFrame:
    return df.withColumn("match_distance", F.round("match_distance", 6))


LINK_COLUMNS = ["user_id", "first_name", "last_name", "email", "status"]

QUERIES: dict[str, Query] = {
    "ingest_profile": _of_export(ingest.profile),
    "ingest_headers": _of_export(ingest.header_report),
    "ingest_table": _ingested,
    "ingest_sample": lambda spark, sf_dir: ingest.sample(
        _ingested(spark, sf_dir), 5, ["guest_id"]
    ),
    "ingest_row_count": lambda spark, sf_dir: ingest.row_count(_ingested(spark, sf_dir)),
    "identity_link": _of_study(lambda s: s.linked),
    "identity_sample": _of_study(
        lambda s: ingest.sample(s.linked, 10, ["guest_id", "user_id"], LINK_COLUMNS)
    ),
    "identity_match_stats": _of_study(lambda s: identity.match_stats(s.linked)),
    "identity_link_name": _link("name"),
    "identity_link_all": _link("all"),
    "identity_link_cascade": _link("cascade"),
    "identity_link_priority": _link("priority"),
    "identity_link_one_account": _link("email", dedupe="min_id"),
    "match_rate_email": _match_rate("email"),
    "match_rate_name": _match_rate("name"),
    "match_rate_all": _match_rate("all"),
    "match_rate_cascade": _match_rate("cascade"),
    "match_rate_priority": _match_rate("priority"),
    "match_strategy_report": _match_rate(*identity.STRATEGIES),
    "event_window_metrics": _of_study(lambda s: s.metrics),
    "event_window_sample": _of_study(
        lambda s: ingest.sample(s.metrics, 10, ["user_id", "first_name", "last_name", "email"])
    ),
    "event_window_summary": _of_study(lambda s: s.summary()),
    "event_window_summary_by_range": lambda spark, sf_dir: as_doubles(_by_range(spark, sf_dir).summary()),
    "treatment_features": _before(lambda s: _with_text_date(s.treatment_features)),
    "candidate_pool": _before(lambda s: _with_text_date(s.candidate_pool)),
    "feature_scales": _before(lambda s: _rounded_scales(s.feature_scales())),
    "control_group": _before(lambda s: _rounded_distance(s.control_group)),
    "control_group_tiled": _before(lambda s: _rounded_distance(s.control_group), tile_rows=16),
    "control_window_metrics": _of_study(lambda s: _rounded_distance(s.control_metrics)),
    "treatment_control_comparison": _of_study(lambda s: s.comparison()),
    "activation_overall": _of_study(lambda s: s.activation_overall()),
    "activation_by_window": _of_study(lambda s: s.activation_by_window()),
    "first_orders_kept": _first_orders,
    "activation_by_type_91d_kept": lambda spark, sf_dir: as_doubles(
        _kept_history(spark, sf_dir).activation_by_type(91)
    ),
    "membership_status": _of_study(lambda s: s.membership),
    "membership_penetration": _of_study(lambda s: s.membership_penetration()),
    "membership_transitions": _of_study(lambda s: s.membership_transitions()),
    "membership_conversion": _of_study(lambda s: s.membership_conversion()),
}
for _n in EVENT.lengths:
    QUERIES |= {
        f"inactive_control_{_n}d": _of_study(lambda s, n=_n: s.inactive_control(n)),
        f"activation_by_type_{_n}d": _of_study(lambda s, n=_n: s.activation_by_type(n)),
        f"activation_summary_{_n}d": _of_study(lambda s, n=_n: s.activation_summary(n)),
        f"activation_lift_{_n}d": _of_study(lambda s, n=_n: s.activation_lift(n)),
    }
