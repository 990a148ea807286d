"""The kept table of first orders against one pass over all deliveries."""

import shutil
from datetime import date, timedelta

import pytest

from eventlift import EventSpec, EventStudy
from eventlift.operators.orders import first_orders
from eventlift.sources.fixtures import EVENT, FixtureTables
from eventlift.sources.history import FirstOrderHistory
from conftest import DATA, plan_of

START = date(2025, 1, 1)


@pytest.fixture()
def deliveries(spark, tmp_path):
    """Three orders a day, a folder for each day; some are not valid, some have no user."""
    days = spark.range(360).selectExpr(
        "id AS order_delivery_id",
        "CASE WHEN id % 17 = 0 THEN NULL ELSE id * 7 % 101 END AS user_id",
        f"date_add(DATE '{START}', CAST(id DIV 3 AS INT)) AS delivered_date_pt",
        "IF(id % 5 = 0, 'pending', 'delivered') AS delivery_state",
        "'Y' AS delivery_finalized_ind",
        "'N' AS deleted_ind",
    )
    path = str(tmp_path / "deliveries")
    days.withColumn("day", days["delivered_date_pt"]).write.partitionBy("delivered_date_pt").parquet(path)
    return path


def read(spark, path):
    return spark.read.parquet(path)


def rows(df):
    return sorted(map(tuple, df.collect()))


def event(day):
    return EventSpec(START + timedelta(days=day + 28)).pre(28)


@pytest.mark.parametrize("settle_days", [0, 5])
def test_studies_one_after_the_other(spark, tmp_path, deliveries, settle_days):
    history = FirstOrderHistory(spark, str(tmp_path / "kept"), settle_days)
    for day in (30, 31, 70, 50, 70, 119):
        all_days = read(spark, deliveries)
        assert rows(history.before(all_days, event(day))) == rows(first_orders(all_days, event(day)))
    assert history.covered() == event(119).start - timedelta(days=1 + settle_days)


def test_a_second_study_reads_no_old_day(spark, tmp_path, deliveries):
    history = FirstOrderHistory(spark, str(tmp_path / "kept"))
    expected = rows(first_orders(read(spark, deliveries), event(100)))
    history.before(read(spark, deliveries), event(60)).collect()
    for day in range(60):
        shutil.rmtree(f"{deliveries}/delivered_date_pt={START + timedelta(days=day)}")
    assert rows(FirstOrderHistory(spark, str(tmp_path / "kept")).before(read(spark, deliveries), event(100))) == expected
    # days that are covered need no deliveries at all
    shutil.rmtree(f"{deliveries}/delivered_date_pt={START + timedelta(days=70)}")
    last = history.before(read(spark, deliveries), event(100))
    assert rows(last) == expected and "delivery_state" not in plan_of(last)


def test_two_sessions_at_once(spark, tmp_path, deliveries):
    one, two = (FirstOrderHistory(spark, str(tmp_path / "kept")) for _ in range(2))
    all_days = read(spark, deliveries)
    late = tmp_path / "kept" / "_late"
    two._new(all_days, event(40).start).write.parquet(str(late))
    one.extend(all_days, event(20).start)
    late.rename(tmp_path / "kept" / f"from-start-to-{event(40).start}")
    (tmp_path / "kept" / "_left-by-a-killed-driver").mkdir()
    assert rows(one.before(all_days, event(60))) == rows(first_orders(all_days, event(60)))


def test_study_with_a_kept_history(spark, workspace):
    tables = FixtureTables(spark, f"{DATA}/sf0.01")
    history = FirstOrderHistory(spark, f"{workspace.root}/kept")
    history.before(tables.deliveries, EventSpec(EVENT.event_date - timedelta(days=200)).before)
    study = EventStudy(tables, EVENT, workspace, history=history)
    plain = EventStudy(tables, EVENT, workspace)
    assert rows(study.first_orders) == rows(plain.first_orders)
