from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from eventlift import EventSpec
from eventlift.functions.periods import add_months
from eventlift.operators.features import (
    candidate_pool,
    feature_scales,
    feature_totals,
    treatment_features,
)
from eventlift.operators.activation import with_user_type
from eventlift.operators.metrics import (
    compare_groups,
    guest_users,
    user_totals,
    window_metrics,
    window_summary,
    zone_totals,
)
from eventlift.operators.orders import first_orders, grouped_ranges, joined_by_range, not_of_users, valid_orders

DELIVERY = (
    "user_id bigint, order_delivery_id bigint, delivered_date_pt date, zone_id int, express string,"
    " delivery_state string, delivery_finalized_ind string, deleted_ind string"
)
VALUE = "order_delivery_id bigint, gtv_amt_usd decimal(18,2)"
DIM = "user_id bigint, activation_date_pt date, activation_zone_id int"
OK = ("delivered", "Y", "N")
EVENT = date(2025, 9, 4)


def order(user, number, day, zone=1, express="N", valid=OK):
    return (user, number, day, zone, express, *valid)


@pytest.fixture(scope="module")
def tables(spark):
    deliveries = spark.createDataFrame(
        [
            order(1, 100, date(2025, 6, 5), express="Y"),
            order(1, 101, date(2025, 9, 3), zone=2),
            order(1, 102, EVENT),
            order(1, 103, date(2025, 9, 5)),
            order(1, 104, date(2025, 10, 2)),
            order(1, 105, date(2025, 10, 3)),
            order(1, 106, date(2025, 12, 4)),
            order(1, 107, date(2025, 12, 5)),
            order(1, 108, date(2025, 6, 4)),
            order(1, 109, date(2025, 8, 6)),
            order(2, 200, date(2025, 9, 1), valid=("pending", "Y", "N")),
            order(2, 201, date(2025, 9, 1), valid=("delivered", "N", "N")),
            order(2, 202, date(2025, 9, 1), valid=("delivered", "Y", "Y")),
            order(2, 203, date(2025, 9, 1)),
            order(3, 300, date(2025, 9, 1), zone=None, express="Y"),
            order(None, 400, date(2025, 9, 1)),
            order(4, 500, date(2025, 9, 1)),
        ],
        DELIVERY,
    )
    values = spark.createDataFrame(
        [(n, Decimal(10)) for n in [100, 101, 102, 103, 104, 105, 106, 107, 108, 109, 200, 201, 202, 400]]
        + [(300, Decimal(7)), (300, Decimal(5)), (500, Decimal(0))],
        VALUE,
    )
    return deliveries, values


def test_periods(spec):
    assert [(p.name, p.start.isoformat(), p.end.isoformat()) for p in spec.periods] == [
        ("28d_pre", "2025-08-07", "2025-09-03"),
        ("28d_post", "2025-09-05", "2025-10-02"),
        ("91d_pre", "2025-06-05", "2025-09-03"),
        ("91d_post", "2025-09-05", "2025-12-04"),
    ]
    assert not any(p.start <= EVENT <= p.end for p in spec.periods)
    assert [d.isoformat() for d in spec.status_dates.values()] == ["2025-06-04", "2025-09-04", "2025-12-04"]
    assert add_months(date(2024, 3, 31), -1) == date(2024, 2, 29)
    assert add_months(date(2025, 11, 30), 3) == date(2026, 2, 28)
    assert EventSpec(EVENT, (7,)).span.start == date(2025, 8, 28)


def test_valid_orders(spark, tables, spec, workspace):
    deliveries, values = tables
    users = spark.createDataFrame([(1,), (2,), (3,)], "user_id bigint")
    found = valid_orders(deliveries, values, spec.span, users=users, stage=workspace.stage)
    numbers = sorted(r.order_delivery_id for r in found.collect())
    assert numbers == [100, 101, 102, 103, 104, 105, 106, 109, 300, 300]
    others = not_of_users(valid_orders(deliveries, values, spec.before), users)
    assert [r.order_delivery_id for r in others.collect()] == [500]


def test_history_needs_no_value(tables, spec):
    deliveries, _ = tables
    before = first_orders(deliveries, spec.pre(28))
    assert [tuple(r) for r in before.collect()] == [(1, date(2025, 6, 4))]
    later = first_orders(deliveries, EventSpec(date(2026, 9, 4)).pre(28))
    assert sorted(r.user_id for r in later.collect()) == [1, 2, 3, 4]
    people = deliveries.select("user_id").where("user_id IS NOT NULL").distinct()
    first = deliveries.groupBy("user_id").agg(F.min("delivered_date_pt").alias("first_order_date"))
    typed = with_user_type(people, first, spec.pre(91))
    assert {r.user_id: r.user_type for r in typed.collect()} == {1: "dormant", 2: "new", 3: "new", 4: "new"}


def test_an_order_in_two_zones_counts_once_for_its_user(spark, spec):
    rows = [(1, 100, date(2025, 9, 1), z, "N", Decimal(v)) for z, v in ((1, 3), (2, 4), (None, 5), (1, 1))]
    rows.append((1, 100, date(2025, 9, 10), 0, "Y", Decimal(2)))
    rows.append((1, 101, date(2025, 9, 10), 2, "N", None))
    schema = (
        "user_id bigint, order_delivery_id bigint, delivered_date_pt date, zone_id int, express string,"
        " gtv_amt_usd decimal(18,2)"
    )
    totals = zone_totals(spark.createDataFrame(rows, schema), spec.periods)
    found = {r.zone_id: (r.gtv_28d_pre, r.orders_28d_pre, r.orders_28d_post) for r in totals.collect()}
    assert found == {1: (4, 1, 0), 2: (4, 1, 1), None: (5, 1, 0), 0: (0, 0, 1)}
    user = user_totals(totals, spec.periods).first()
    assert (user.gtv_28d_pre, user.orders_28d_pre, user.gtv_91d_post, user.orders_91d_post) == (13, 1, 2, 2)


def test_window_metrics(spark, tables, spec):
    deliveries, values = tables
    linked = spark.createDataFrame(
        [(1, "a", "b", "c"), (1, "a", "b", "c"), (1, "alias", "b", "c"), (9, None, None, None), (3, "x", "y", "z"),
         (None, "q", "q", "q")],
        "user_id bigint, first_name string, last_name string, email string",
    )
    orders = valid_orders(deliveries, values, spec.span)
    rows = window_metrics(guest_users(linked), orders, spec.periods).orderBy("user_id", "first_name").collect()
    assert [(r.user_id, r.first_name) for r in rows] == [(1, "a"), (1, "alias"), (3, "x"), (9, None)]
    for r in rows[:2]:
        assert (r.gtv_28d_pre, r.gtv_91d_pre, r.gtv_28d_post, r.gtv_91d_post) == (10, 30, 20, 40)
        assert (r.orders_28d_pre, r.orders_91d_pre, r.orders_28d_post, r.orders_91d_post) == (1, 3, 2, 4)
    # Two value rows of one order: both count as value, once as an order.
    assert (rows[2].gtv_28d_pre, rows[2].orders_28d_pre) == (12, 1)
    assert tuple(rows[3])[4:] == (0,) * 8


def test_summary_of_nothing(spark, tables, spec):
    deliveries, values = tables
    nobody = spark.createDataFrame([], "user_id bigint, first_name string, last_name string, email string")
    metrics = window_metrics(nobody, valid_orders(deliveries, values, spec.span), spec.periods)
    row = window_summary(metrics, spec).first()
    assert row.total_matched_guests == 0 and row.gtv_28d_pct_change is None
    assert [r.users for r in compare_groups(metrics, metrics, spec).collect()] == [0, 0]


def test_features(spark, tables, spec):
    deliveries, values = tables
    dim = spark.createDataFrame(
        [(1, date(2025, 9, 1), 5), (3, None, 6), (7, date(2025, 1, 1), 8)], DIM
    )
    users = spark.createDataFrame([(1,), (3,), (7,), (8,)], "user_id bigint")
    orders = feature_totals(valid_orders(deliveries, values, spec.span, users=users), spec)
    rows = {
        (r.user_id, r.zone_id): r for r in treatment_features(users, orders, dim, spec).collect()
    }
    assert set(rows) == {(1, 1), (1, 2), (3, 6), (7, 8), (8, None)}
    assert rows[1, 1].account_age_days == 3
    assert (rows[1, 1].is_express, rows[1, 2].is_express, rows[3, 6].is_express, rows[8, None].is_express) == (1, 0, 1, 0)
    assert (rows[1, 1].orders_91d_pre, rows[1, 1].gtv_91d_pre, rows[1, 1].orders_28d_pre) == (2, 20, 0)
    assert rows[3, 6].account_age_days is None and rows[8, None].gtv_28d_pre == 0
    scales = feature_scales(treatment_features(users, orders, dim, spec), spec).first()
    assert scales.std_orders_91d == pytest.approx(0.8366600265)


def test_candidates_need_value(spark, tables, spec):
    deliveries, values = tables
    dim = spark.createDataFrame([(3, date(2025, 9, 1), 6)], DIM)
    attendees = spark.createDataFrame([(1,)], "user_id bigint")
    orders = not_of_users(valid_orders(deliveries, values, spec.span), attendees)
    rows = candidate_pool(feature_totals(orders, spec), dim, spec).collect()
    assert [(r.user_id, r.zone_id, r.gtv_91d_pre) for r in rows] == [(3, 6, 12)]


def test_ranges_hold_whole_files_and_do_not_overlap():
    files = [(0, 9, "a"), (10, 19, "b"), (15, 30, "c"), (31, 31, "d"), (40, 60, "e"), (900, 950, "far")]
    marks = list(range(0, 61, 6))
    assert grouped_ranges(files, marks, 110, 1) == [
        (0, 9, ["a"]), (10, 30, ["b", "c"]), (31, 31, ["d"]), (40, 60, ["e"]),
    ]
    assert grouped_ranges(files, marks, 110, 10**6) == [(0, 60, ["a", "b", "c", "d", "e"])]
    assert grouped_ranges(files, [], 0, 5) == []
    assert grouped_ranges([(0, 99, "a"), (1, 2, "b"), (50, 70, "c")], marks, 110, 1) == [(0, 99, ["a", "b", "c"])]


@pytest.mark.parametrize("items", [1, 40, 10**6])
def test_join_by_ranges_equals_the_plain_join(spark, workspace, items):
    orders = spark.range(0, 300, 3).selectExpr("id AS order_delivery_id", "id % 7 AS user_id")
    more = spark.createDataFrame([(None, 5), (9, 6), (10**9, 7)], "order_delivery_id bigint, user_id bigint")
    orders = orders.union(more)
    values = spark.range(250).selectExpr("nullif(id, 6) AS order_delivery_id", "id AS v")
    path = f"{workspace.root}/values-{items}"
    values.repartitionByRange(9, "order_delivery_id").write.parquet(path)
    values = spark.read.parquet(path)
    plain = orders.join(values, "order_delivery_id")
    cut = joined_by_range(orders, values, "order_delivery_id", items, workspace.stage)
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, plain.collect()))
    derived = joined_by_range(orders, values.distinct(), "order_delivery_id", items, workspace.stage)
    assert derived.count() == plain.count()
    nothing = joined_by_range(orders.limit(0), values, "order_delivery_id", items, workspace.stage)
    assert nothing.count() == 0
