import hashlib
from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from eventlift.operators import activation
from eventlift.operators.activation import (
    activation_by_type,
    activation_by_window,
    activation_lift,
    activation_overall,
    activation_summary,
    stratified_inactive_control,
)
from eventlift.operators.membership import (
    status_at,
    status_conversion,
    status_penetration,
    status_transitions,
)
from eventlift.operators.metrics import zone_totals
from eventlift.operators.orders import first_orders, valid_orders
from test_orders_and_metrics import DELIVERY, VALUE, order

METRICS = (
    "user_id bigint, gtv_28d_pre decimal(28,2), gtv_28d_post decimal(28,2), gtv_91d_pre decimal(28,2),"
    " gtv_91d_post decimal(28,2), orders_28d_post bigint, orders_91d_post bigint"
)


def test_activation_rows(spark, spec):
    zero, ten = Decimal(0), Decimal(10)
    metrics = spark.createDataFrame(
        [
            (1, zero, ten, zero, ten * 3, 1, 3),
            (2, zero, zero, zero, ten, 0, 1),
            (3, zero, zero, zero, zero, 0, 0),
            (4, zero, zero, zero, zero, 0, 1),
            (5, zero, ten, ten, ten, 1, 1),
        ],
        METRICS,
    )
    row = activation_overall(metrics).first()
    assert tuple(row) == (4, 3, 75.0, 40.0, 13.33, 5)
    assert tuple(activation_by_window(metrics, spec).first()) == (4, 1, 3, 10.0, 40.0)
    rows = activation_summary(metrics, metrics.where("user_id < 3"), 28).collect()
    assert [r.total_inactive for r in rows] == [5, 2]
    nobody = metrics.where("gtv_91d_pre > 100")
    assert tuple(activation_overall(nobody).first()) == (0, 0, None, None, None, None)
    assert [tuple(r)[1:] for r in activation_summary(nobody, nobody, 91).collect()] == [(0, 0, None, None)] * 2


# Recorded counts (inactive, activated) and the rates and lifts they give.
RECORDED = {
    91: {"overall": (10.7, 2.1, 8.6), "new": (6.3, 0.0, 6.3), "dormant": (15.8, 4.6, 11.2)},
    28: {"overall": (8.1, 1.7, 6.4), "new": (4.1, 0.0, 4.1), "dormant": (11.9, 3.3, 8.6)},
}
COUNTS = {
    91: [("Treatment", "new", 320, 20), ("Treatment", "dormant", 285, 45), ("Control", "new", 320, 0),
         ("Control", "dormant", 285, 13)],
    28: [("Treatment", "new", 320, 13), ("Treatment", "dormant", 337, 40), ("Control", "new", 320, 0),
         ("Control", "dormant", 337, 11)],
}


@pytest.mark.parametrize("days", [28, 91])
def test_recorded_lifts(spark, days):
    by_type = spark.createDataFrame(
        COUNTS[days], "group_name string, user_type string, total_users bigint, activated bigint"
    )
    assert {r[0]: tuple(r)[1:] for r in activation_lift(by_type).collect()} == RECORDED[days]


def test_types_in_order(spark):
    rows = [(i, *[Decimal(0)] * 4, 0, i % 2, "new" if i < 3 else "dormant") for i in range(6)]
    people = spark.createDataFrame(rows, METRICS + ", user_type string")
    found = activation_by_type(people, people, 91).collect()
    assert [(r.user_type, r.group_name, r.activated) for r in found] == [
        ("dormant", "Control", 2), ("dormant", "Treatment", 2), ("new", "Control", 1), ("new", "Treatment", 1),
    ]


@pytest.mark.parametrize("drawn,more,rounds", [(64, 16, 1), (0.25, 2, 3)])
def test_stratified_control(spark, spec, workspace, monkeypatch, drawn, more, rounds):
    monkeypatch.setattr(activation, "DRAWN", drawn)
    monkeypatch.setattr(activation, "DRAWN_MORE", more)
    stages = []
    before = spec.pre(28)
    earlier, within = before.start - timedelta(days=40), before.start
    deliveries, values = [], []
    for i in range(1, 401):
        if i % 3 == 0:
            deliveries.append(order(i, i, earlier))
        if i % 10 == 0:
            deliveries.append(order(i, 1000 + i, within))
            values.append((1000 + i, Decimal(0 if i % 20 == 0 else 5)))
    users = [(i, f"u{i}", "f", "l") for i in range(1, 401)]
    deliveries = spark.createDataFrame(deliveries, DELIVERY)
    linked = list(range(1, 41))
    treatment = [(i, "dormant" if i % 3 == 0 else "new") for i in linked]
    chosen = stratified_inactive_control(
        spark.createDataFrame(users, "id bigint, email string, first_name string, last_name string"),
        spark.createDataFrame([(i,) for i in linked], "user_id bigint"),
        spark.createDataFrame(treatment, "user_id bigint, user_type string"),
        zone_totals(
            valid_orders(deliveries, spark.createDataFrame(values, VALUE), spec.span), spec.periods
        ),
        first_orders(deliveries, before),
        before,
        lambda df, name: stages.append(workspace.stage(df, name)) or stages[-1],
    )
    assert len(stages) >= rounds
    pool = [i for i in range(41, 401) if not (i % 10 == 0 and i % 20 != 0)]
    expected = set()
    for kind, rest in (("dormant", lambda i: i % 3 == 0), ("new", lambda i: i % 3 != 0)):
        quota = sum(k == kind for _, k in treatment)
        ranked = sorted((hashlib.md5(str(i).encode()).hexdigest(), i) for i in pool if rest(i))
        expected |= {(i, kind) for _, i in ranked[:quota]}
    assert {tuple(r) for r in chosen.collect()} == expected


def test_few_accounts_are_looked_up(spark, spec, workspace):
    """Of 300,000 accounts only those under the threshold are joined with anything."""
    before = spec.pre(28)
    stages = []
    users = spark.range(300_000)
    treatment = spark.createDataFrame([(1, "new"), (2, "new")], "user_id bigint, user_type string")
    none = spark.createDataFrame([], f"user_id bigint, first_order_date date, gtv_{before.name} decimal(28,2)")
    chosen = stratified_inactive_control(
        users, treatment, treatment, none, none, before,
        lambda df, name: stages.append(workspace.stage(df, name)) or stages[-1],
    )
    digests = sorted((hashlib.md5(str(i).encode()).hexdigest(), i) for i in range(300_000) if i not in (1, 2))
    assert {r.user_id for r in chosen.collect()} == {i for _, i in digests[:2]}
    assert [s.count() < 1000 for s in stages] == [True]


def test_membership(spark, spec):
    dates = spec.status_dates
    at = datetime(2025, 9, 4)
    intervals = spark.createDataFrame(
        [
            (1, at - timedelta(days=200), None),
            (2, at - timedelta(days=200), at),
            (3, at + timedelta(hours=10), None),
            (4, at - timedelta(days=5), at - timedelta(seconds=1)),
            (5, at, at),
            (5, at - timedelta(days=300), at - timedelta(days=50)),
            (99, at - timedelta(days=5), None),
        ],
        "user_id bigint, subscription_start_date_time_pt timestamp_ntz, subscription_end_date_time_pt timestamp_ntz",
    )
    users = spark.createDataFrame([(i,) for i in range(1, 7)], "user_id bigint")
    status = status_at(users, intervals, dates)
    found = {r.user_id: tuple(r)[1:] for r in status.collect()}
    assert found == {1: (1, 1, 1), 2: (1, 1, 0), 3: (0, 0, 1), 4: (0, 0, 0), 5: (1, 1, 0), 6: (0, 0, 0)}
    assert tuple(status_penetration(status, dates).first()) == (6, 3, 3, 2, 50.0, 50.0, 33.3)
    paths = status_transitions(status, dates).collect()
    assert sum(p.user_count for p in paths) == 6
    assert [p.user_count for p in paths] == sorted((p.user_count for p in paths), reverse=True)
    assert paths[0].pct_of_total == 33.3
    converted = status_conversion(status, "event_day", "3m_after").first()
    assert tuple(converted) == ("New signups (post-event)", 1, 3, 33.3)
    everyone = status.where("member_event_day = 1")
    assert status_conversion(everyone, "event_day", "3m_after").first().conversion_rate_pct is None
