"""Study tables derived from the provided parquet tables, as FIXTURES.md defines them."""

from __future__ import annotations

from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlift.functions.periods import EventSpec

EVENT = EventSpec(date(1995, 9, 4))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _guests(customer: DataFrame, which: str, guest_id: str) -> DataFrame:
    keyed = customer.selectExpr("c_custkey AS k", "c_custkey DIV 5 AS g", "c_mktsegment AS seg")
    main = keyed.where(which).selectExpr(
        f"{guest_id} AS guest_id",
        "CASE WHEN g % 7 = 3 THEN NULL WHEN g % 7 = 5 THEN concat('g', k, '@nomatch.example')"
        " ELSE concat(' U', k, '@Example.COM ') END AS email",
        "concat(' ', lower(seg)) AS first_name",
        "CASE WHEN g % 11 IN (3, 5) THEN 'zz' ELSE concat('l', k % 997, ' ') END AS last_name",
        "CASE WHEN g % 4 = 1 THEN 'Registered' ELSE 'Checked In' END AS status",
    )
    aliases = keyed.where("k % 70 = 0").selectExpr(
        "1000000 + g AS guest_id",
        "concat('u', k, '@example.com') AS email",
        "'alias' AS first_name",
        "'dup' AS last_name",
        "'CHECKED IN' AS status",
    )
    return main.unionByName(aliases)


def _guestlist(customer: DataFrame) -> DataFrame:
    return _guests(customer, "k % 5 = 0", "g")


def guest_export(customer: DataFrame) -> DataFrame:
    """A raw export with every customer as a guest, under the headers of such a file."""
    return _guests(customer, "TRUE", "k").toDF(
        "Guest-ID", " Email ", "First Name", "Last Name", "STATUS"
    )


class FixtureTables:
    """The tables of a study, each derived when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    @cached_property
    def _customer(self) -> DataFrame:
        return load(self.spark, self.sf_dir, "customer")

    @cached_property
    def _orders(self) -> DataFrame:
        return load(self.spark, self.sf_dir, "orders")

    @cached_property
    def _located(self) -> DataFrame:
        """Customers with their region."""
        nation = load(self.spark, self.sf_dir, "nation")
        return self._customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
            "c_custkey", "n_regionkey"
        )

    @cached_property
    def guestlist(self) -> DataFrame:
        return _guestlist(self._customer)

    @cached_property
    def users(self) -> DataFrame:
        return self._customer.selectExpr(
            "c_custkey AS id",
            "concat('u', c_custkey - IF(c_custkey % 50 = 1, 1, 0), '@example.com') AS email",
            "c_mktsegment AS first_name",
            "concat('L', c_custkey % 997) AS last_name",
        )

    @cached_property
    def deliveries(self) -> DataFrame:
        located = self._orders.join(self._located, F.col("o_custkey") == F.col("c_custkey"))
        return located.selectExpr(
            "o_orderkey AS order_delivery_id",
            "o_custkey AS user_id",
            "CAST(o_orderdate AS DATE) AS delivered_date_pt",
            "CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'delivered' END AS delivery_state",
            "CASE WHEN o_orderkey % 50 = 7 THEN 'N' ELSE 'Y' END AS delivery_finalized_ind",
            "CASE WHEN o_orderkey % 50 = 9 THEN 'Y' ELSE 'N' END AS deleted_ind",
            "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Y' ELSE 'N' END AS express",
            "CASE WHEN o_orderkey % 101 = 0 THEN NULL WHEN o_orderkey % 9 = 0 THEN 4 - n_regionkey"
            " ELSE n_regionkey END AS zone_id",
        )

    @cached_property
    def values(self) -> DataFrame:
        lineitem = load(self.spark, self.sf_dir, "lineitem")
        price = F.col("l_extendedprice").cast("decimal(18,2)")
        return lineitem.groupBy(F.col("l_orderkey").alias("order_delivery_id")).agg(
            F.sum(price).cast("decimal(18,2)").alias("gtv_amt_usd")
        )

    @cached_property
    def dim_user(self) -> DataFrame:
        return self._located.where("c_custkey % 113 != 0").selectExpr(
            "c_custkey AS user_id",
            "CASE WHEN c_custkey % 97 = 0 THEN NULL"
            " ELSE date_add(DATE '1994-01-01', CAST(c_custkey % 600 AS INT)) END AS activation_date_pt",
            "n_regionkey AS activation_zone_id",
        )

    @cached_property
    def subscriptions(self) -> DataFrame:
        started = self._orders.where("o_orderpriority = '5-LOW'").selectExpr(
            "o_custkey AS user_id",
            "o_orderkey AS n",
            "o_orderdate + make_dt_interval(0, CAST(o_orderkey % 24 AS INT)) AS started",
        )
        return started.selectExpr(
            "user_id",
            "started AS subscription_start_date_time_pt",
            "CASE WHEN n % 3 = 0 THEN NULL"
            " ELSE started + make_dt_interval(CAST(30 + n % 200 AS INT)) END"
            " AS subscription_end_date_time_pt",
        )
