"""An event study: the operators chained over one set of source tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache, cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlift.functions.periods import EventSpec
from eventlift.operators import activation, features, identity, matching, membership, metrics
from eventlift.operators.orders import first_orders, not_of_users, valid_orders
from eventlift.sources.history import FirstOrderHistory
from eventlift.sources.workspace import Workspace


@dataclass(frozen=True)
class StudyTables:
    """The source tables; see the README for their columns.

    Any object with these attributes will do.
    """

    guestlist: DataFrame
    users: DataFrame
    deliveries: DataFrame
    values: DataFrame
    dim_user: DataFrame
    subscriptions: DataFrame

    @classmethod
    def from_columns(cls, names: dict[str, dict[str, str]], **tables: DataFrame) -> StudyTables:
        """Tables whose columns have other names: ``names[table][expected]`` is the one they have.

        Columns that are not named keep theirs. A column that is not there, or whose expected name another
        column of the table has already, is an error.
        """
        unknown = names.keys() - tables.keys()
        if unknown:
            raise ValueError(f"names for tables that are not given: {sorted(unknown)}")
        return cls(**{table: _renamed(table, df, names.get(table, {})) for table, df in tables.items()})


def _renamed(table: str, df: DataFrame, names: dict[str, str]) -> DataFrame:
    actual = {a: e for e, a in names.items()}
    missing = sorted(actual.keys() - set(df.columns))
    columns = [actual.get(c, c) for c in df.columns]
    clashes = sorted(c for c in set(columns) if columns.count(c) > 1)
    if missing or clashes:
        raise ValueError(f"{table}: columns missing {missing}, names twice {clashes}")
    return df.toDF(*columns)


class EventStudy:
    """Steps as properties. A step that several others read is written once per study.

    Orders are valued once, for everybody, and kept as totals per user and zone. A study
    that only looks at the days before the event (features, candidates, the matched group)
    says so with ``before_only`` and values no others. With a ``history`` of first orders, only
    days that it does not cover yet are read for them. ``filter_items`` cuts the join of orders
    and values into ranges of ids with about so many orders each.
    """

    def __init__(
        self,
        tables: StudyTables,
        spec: EventSpec,
        workspace: Workspace,
        status: str = "checked in",
        tile_rows: int = matching.TILE_ROWS,
        before_only: bool = False,
        history: FirstOrderHistory | None = None,
        filter_items: int | None = None,
    ):
        self.tables = tables
        self.spec = spec
        self.workspace = workspace
        self.status = status
        self.tile_rows = tile_rows
        self.before_only = before_only
        self.history = history
        self.filter_items = filter_items
        self.inactive_control = cache(self._inactive_control)

    # Identity

    @cached_property
    def linked(self) -> DataFrame:
        """Guests of the wanted status with their account."""
        t = self.tables
        linked = identity.link_identity(t.guestlist, t.users, status=self.status, stage=self.workspace.stage)
        return self.workspace.create_or_replace(linked, "guestlist_with_userid")

    @cached_property
    def attendees(self) -> DataFrame:
        """Distinct linked accounts."""
        found = self.linked.where(F.col("user_id").isNotNull())
        return self.workspace.stage(found.select("user_id").distinct(), "attendees")

    # Spend before and after

    @cached_property
    def totals(self) -> DataFrame:
        """Everybody's value and orders per zone and period, from one pass over the values."""
        t, spec = self.tables, self.spec
        period, periods = (spec.before, spec.pre_periods) if self.before_only else (spec.span, spec.periods)
        stage = self.workspace.stage
        orders = valid_orders(t.deliveries, t.values, period, stage=stage, filter_items=self.filter_items)
        table = metrics.zone_totals(orders, periods, features.order_flags(spec))
        return self.workspace.stage(table, "totals")

    def _metrics_of(self, entities: DataFrame) -> DataFrame:
        if self.before_only:
            raise ValueError("this study has no totals of the days after the event")
        return metrics.metrics_of(entities, self.totals, self.spec.periods)

    @cached_property
    def metrics(self) -> DataFrame:
        """Value and orders per attendee identity and period."""
        table = self._metrics_of(metrics.guest_users(self.linked))
        return self.workspace.create_or_replace(table, "gtv_analysis")

    def summary(self) -> DataFrame:
        return metrics.window_summary(self.metrics, self.spec)

    # Matched control group

    @cached_property
    def treatment_features(self) -> DataFrame:
        table = features.treatment_features(
            self.attendees, self.totals, self.tables.dim_user, self.spec
        )
        return self.workspace.create_or_replace(table, "treatment_features")

    @cached_property
    def candidate_pool(self) -> DataFrame:
        others = not_of_users(self.totals, self.attendees)
        table = features.candidate_pool(others, self.tables.dim_user, self.spec)
        return self.workspace.create_or_replace(table, "candidate_pool")

    def feature_scales(self) -> DataFrame:
        return features.feature_scales(self.treatment_features, self.spec)

    @cached_property
    def control_group(self) -> DataFrame:
        candidates = self.candidate_pool
        table = matching.match_nearest(
            self.treatment_features,
            candidates,
            self.spec,
            self.workspace.stage,
            tile_rows=self.tile_rows,
        )
        return self.workspace.create_or_replace(table, "control_group")

    @cached_property
    def control_metrics(self) -> DataFrame:
        """Value and orders of every matched control, once per treatment user it serves."""
        controls = self.control_group.select("user_id", "treatment_user_id", "match_distance")
        return self.workspace.create_or_replace(self._metrics_of(controls), "control_metrics")

    def comparison(self) -> DataFrame:
        control = self.control_metrics
        return metrics.compare_groups(self.metrics, control, self.spec)

    # Activation

    @cached_property
    def first_orders(self) -> DataFrame:
        """Everybody's first valid order, from the kept history or one pass over all of it."""
        latest = self.spec.pre(min(self.spec.lengths))
        if self.history is not None:
            return self.history.before(self.tables.deliveries, latest)
        return self.workspace.stage(first_orders(self.tables.deliveries, latest), "first_orders")

    def _typed_inactive(self, days: int) -> DataFrame:
        people = activation.inactive(self.metrics, days)
        return activation.with_user_type(people, self.first_orders, self.spec.pre(days))

    def _inactive_control(self, days: int) -> DataFrame:
        chosen = self.workspace.stage(
            activation.stratified_inactive_control(
                self.tables.users,
                self.attendees,
                self._typed_inactive(days),
                self.totals,
                self.first_orders,
                self.spec.pre(days),
                self.workspace.stage,
            ),
            f"inactive_users_{days}d",
        )
        name = f"control_inactive_{days}d_matched"
        return self.workspace.create_or_replace(self._metrics_of(chosen), name)

    def activation_overall(self) -> DataFrame:
        return activation.activation_overall(self.metrics, max(self.spec.lengths))

    def activation_by_window(self) -> DataFrame:
        return activation.activation_by_window(self.metrics, self.spec)

    def activation_by_type(self, days: int) -> DataFrame:
        control = self.inactive_control(days)
        return activation.activation_by_type(self._typed_inactive(days), control, days)

    def activation_summary(self, days: int) -> DataFrame:
        control = self.inactive_control(days)
        return activation.activation_summary(self.metrics, control, days)

    def activation_lift(self, days: int) -> DataFrame:
        return activation.activation_lift(self.activation_by_type(days))

    # Membership

    @cached_property
    def membership(self) -> DataFrame:
        table = membership.status_at(
            self.attendees, self.tables.subscriptions, self.spec.status_dates
        )
        return self.workspace.create_or_replace(table, "membership_status")

    def membership_penetration(self) -> DataFrame:
        return membership.status_penetration(self.membership, self.spec.status_dates)

    def membership_transitions(self) -> DataFrame:
        return membership.status_transitions(self.membership, self.spec.status_dates)

    def membership_conversion(self) -> DataFrame:
        *_, start, end = self.spec.status_dates
        return membership.status_conversion(self.membership, start, end)
