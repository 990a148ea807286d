"""The plans the operators are written for."""

import re

import pytest
from conftest import DATA, plan_of
from pyspark.sql import functions as F

from eventlift.operators import identity, membership, metrics
from eventlift.operators.matching import match_nearest
from eventlift.operators.orders import valid_orders
from eventlift.sources.fixtures import EVENT, FixtureTables
from eventlift.plans.study import EventStudy
from eventlift.sources.session import tune
from eventlift.sources.workspace import Workspace



def physical(df) -> str:
    return plan_of(df).split("== Physical Plan ==")[1]


@pytest.fixture(autouse=True)
def tuned(spark):
    tune(spark)


@pytest.fixture()
def tables(spark):
    return FixtureTables(spark, f"{DATA}/sf0.001")


@pytest.fixture()
def attendees(spark):
    return spark.range(0, 150, 5).withColumnRenamed("id", "user_id")


@pytest.fixture()
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_orders_are_filtered_in_the_scan(tables):
    plan = physical(valid_orders(tables.deliveries, tables.values, EVENT.span))
    scan = next(line for line in plan.splitlines() if "FileScan parquet [o_" in line)
    assert "GreaterThanOrEqual(o_orderdate,1995-06-05" in scan
    assert "o_totalprice" not in scan
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double>" in plan


def test_few_orders_are_broadcast_below_the_value_aggregation(tables, attendees, workspace):
    orders = valid_orders(
        tables.deliveries, tables.values, EVENT.span, users=attendees, stage=workspace.stage
    )
    plan = physical(orders)
    aggregation, semi = plan.index("HashAggregate"), plan.index("LeftSemi")
    assert aggregation < semi and "SortMergeJoin" not in plan


def test_many_orders_are_shuffled_on_the_order_id_once(tables, attendees, no_broadcast):
    orders = valid_orders(tables.deliveries, tables.values, EVENT.span)
    plan = physical(metrics.zone_totals(orders, EVENT.periods))
    assert "Expand" not in plan
    # Customer to nation, orders to customer: two each. Then orders and lines on the order
    # id, and the totals on user and zone. The steps per order add none.
    assert len(re.findall(r"Exchange hashpartitioning\(", plan)) == 7
    assert len(re.findall(r"hashpartitioning\((?:order_delivery_id|l_orderkey)", plan)) == 2


def test_values_are_filtered_before_they_are_summed(spark, tables, workspace, no_broadcast):
    deliveries = workspace.stage(tables.deliveries, "deliveries")
    options = {"applicationSideScanSizeThreshold": "0", "creationSideThreshold": "1TB"}
    names = {f"spark.sql.optimizer.runtime.bloomFilter.{k}": v for k, v in options.items()}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        plan = physical(valid_orders(deliveries, tables.values, EVENT.before))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    filters = [i for i, line in enumerate(plan.splitlines()) if "might_contain" in line]
    aggregation = next(i for i, line in enumerate(plan.splitlines()) if "partial_sum" in line)
    assert filters and filters[0] > aggregation


def scans(plans: list[str], column: str) -> int:
    return sum(len(re.findall(rf"FileScan parquet \[[^\]]*\b{column}", p.split("== Physical Plan ==")[1])) for p in plans)


@pytest.fixture()
def written(monkeypatch):
    plans, stage = [], Workspace.stage

    def recorded(self, df, name):
        plans.append(plan_of(df))
        return stage(self, df, name)

    monkeypatch.setattr(Workspace, "stage", recorded)
    return plans


def test_a_study_reads_values_once_and_orders_twice(spark, tables, workspace, written):
    study = EventStudy(tables, EVENT, workspace)
    study.summary().collect()
    study.comparison().collect()
    assert scans(written, "l_extendedprice") == 1
    for days in EVENT.lengths:
        study.activation_lift(days).collect()
    assert scans(written, "l_extendedprice") == 1 and scans(written, "o_orderkey") == 2


def test_candidates_value_the_days_before_alone(spark, tables, workspace, written):
    study = EventStudy(tables, EVENT, workspace, before_only=True)
    assert study.candidate_pool.count() > 0
    (totals,) = [p for p in written if "l_extendedprice" in p]
    assert "1995-09-03" in totals and "1995-12" not in totals
    with pytest.raises(ValueError, match="after the event"):
        study.metrics  # noqa: B018


def rows_past_filters(df):
    """Rows that the runtime Bloom filters of an executed plan have let pass, and the filters."""
    passed, filters, open_ = 0, 0, [df._jdf.queryExecution().executedPlan()]
    while open_:
        node = open_.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            open_.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            open_.append(node.plan())
        elif kind == "FilterExec" and "might_contain" in node.condition().toString():
            passed += node.metrics().get("numOutputRows").get().value()
            filters += 1
        children = node.children()
        open_ += [children.apply(i) for i in range(children.size())]
    return passed, filters


def test_values_are_pruned_beyond_the_ids_of_one_filter(spark, workspace, no_broadcast):
    """20,000 orders among 200,000 values, filters made for 1,000: one alone lets nearly all pass."""
    options = {
        "applicationSideScanSizeThreshold": "0",
        "creationSideThreshold": "1GB",
        "expectedNumItems": "1000",
        "maxNumItems": "1000",
        "numBits": "8192",
        "maxNumBits": "8192",
    }
    names = {f"spark.sql.optimizer.runtime.bloomFilter.{k}": v for k, v in options.items()}
    before = {k: spark.conf.get(k) for k in names}
    path = f"{workspace.root}/values"
    spark.range(200_000).selectExpr("id AS order_delivery_id", "CAST(id AS DECIMAL(18,2)) AS gtv_amt_usd").repartitionByRange(
        40, "order_delivery_id"
    ).write.parquet(path)
    values = spark.read.parquet(path)
    days = spark.range(200_000).selectExpr(
        "id AS user_id", "id AS order_delivery_id",
        "date_add(DATE '1995-08-01', IF(hash(id) % 10 = 0, 0, -400)) AS delivered_date_pt", "1 AS zone_id",
        "'N' AS express", "'delivered' AS delivery_state", "'Y' AS delivery_finalized_ind", "'N' AS deleted_ind",
    )
    deliveries = workspace.stage(days, "deliveries")
    expected = deliveries.where("delivered_date_pt >= DATE '1995-08-01'").count()
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        found = {}
        for items in (None, 1000):
            orders = valid_orders(deliveries, values, EVENT.span, stage=workspace.stage, filter_items=items)
            assert len(orders.collect()) == expected
            found[items] = rows_past_filters(orders)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found[None][1] == 1 and found[None][0] > 150_000
    assert found[1000][1] > 15 and found[1000][0] < 1.2 * expected


def test_memberships_are_reduced_before_the_join(tables, attendees):
    status = membership.status_at(attendees, tables.subscriptions, EVENT.status_dates)
    plan = physical(status)
    assert plan.index("LeftOuter") < plan.index("partial_max") < plan.index("LeftSemi")


def test_accounts_are_dropped_in_the_scan(tables):
    plan = physical(identity.link_identity(tables.guestlist, tables.users))
    assert "LeftSemi, BuildRight" in plan


def test_accounts_are_shuffled_once_for_each_link(tables, no_broadcast):
    plan = physical(identity.link_identity(tables.guestlist, tables.users))
    # Accounts once, for both joins; guests for the lookup; their keys for the reduction.
    assert len(re.findall(r"Exchange hashpartitioning\(", plan)) == 3


def test_hot_keys_are_found_without_another_pass_over_the_accounts(spark, workspace, tables, written):
    """Accounts are scanned once for a link, and no job counts them by key."""
    users = workspace.stage(tables.users.withColumnRenamed("id", "account_no"), "u").withColumnRenamed("account_no", "id")
    guests = workspace.stage(tables.guestlist, "g")
    del written[:]
    linked = identity.link_identity(guests, users, stage=workspace.stage)
    assert len(written) == 1 and scans([*written, plan_of(linked)], "account_no") == 1
    assert "partial_count" not in written[0] + plan_of(linked)


def test_accounts_are_read_and_shuffled_once_for_all_key_sets(spark, workspace, tables, no_broadcast):
    users = workspace.stage(tables.users.withColumnRenamed("id", "account_no"), "u").withColumnRenamed("account_no", "id")
    guests = workspace.stage(tables.guestlist, "g")
    plan = plan_of(identity.match_report(guests, users, stage=workspace.stage))
    assert scans([plan], "account_no") == 1
    counted = plan.split("== Physical Plan ==")[1]
    assert len(re.findall(r"partial_count\(1\)|partial_count\(_id", counted)) <= 2


@pytest.mark.parametrize("staged", [False, True])
@pytest.mark.parametrize("strategy", ["email", "name", "all", "cascade"])
def test_accounts_of_a_hot_key_are_dealt_out(spark, workspace, no_broadcast, strategy, staged):
    """A third of the accounts under one key, at default thresholds of skew joins."""
    people = lambda k: [f"{k} AS {c}" for c in ("email", "first_name", "last_name")]
    users = spark.range(360_000).selectExpr("id", *people("IF(id % 3 = 0, '', concat('k', id))"))
    guests = [(1, ""), (2, " "), (3, "K4"), (4, "gone"), (5, None), (5, None)]
    guests = spark.createDataFrame(guests, "guest_id int, k string").selectExpr("guest_id", *people("k"))
    coalescing = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(coalescing)
    spark.conf.set(coalescing, "false")
    try:
        stage = workspace.stage if staged else None
        linked = identity.link_identity(guests, users, strategy, stage=stage)
        rows = linked.select("guest_id", "user_id", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.set(coalescing, before)
    expected = [(g, u) for g in (1, 2) for u in range(0, 360_000, 3)] + [(3, 4), (4, None), (5, None), (5, None)]
    assert sorted(((r.guest_id, r.user_id or 0) for r in rows)) == sorted((g, u or 0) for g, u in expected)
    assert len({r.task for r in rows if r.guest_id == 1}) > 1


def test_hot_tile_is_split(spark, workspace, spec, no_broadcast):
    """One block with nearly all of the treatment is shared out among tasks."""
    options = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    before = {k: spark.conf.get(k) for k in options}
    for k, v in options.items():
        spark.conf.set(k, v)

    def people(rows, first):
        return spark.range(first, first + rows, 1, 8).selectExpr(
            "id AS user_id",
            "IF(id % 10 = 0, CAST(id % 7 AS INT), 1) AS zone_id",
            "0 AS is_express",
            "CAST(id % 97 AS DECIMAL(28,2)) AS gtv_28d_pre",
            "CAST(id % 1009 AS DECIMAL(28,2)) AS gtv_91d_pre",
            "id % 3 AS orders_28d_pre",
            "id % 11 AS orders_91d_pre",
            "CAST(id % 501 AS INT) AS account_age_days",
        )

    try:
        treatment = workspace.stage(people(20_000, 0), "t")
        candidates = workspace.stage(people(300, 50_000), "c")
        matched = match_nearest(treatment, candidates, spec, workspace.stage)
        assert len(matched.collect()) == 20_000
        assert re.search(r"(SortMergeJoin|ShuffledHashJoin)\(skew=true\)", physical(matched))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
