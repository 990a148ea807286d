"""First orders of all users, kept between studies and extended day by day.

A study asks who had ordered before its window. Reading all history for that grows with every
year; here the answer is a table, in parts that each cover a stretch of days and hold the users
whose first valid order lies in it. A study reads the deliveries of days that no part covers yet,
looks their users up among those known, and adds a part. Old days are never read again.
"""

from __future__ import annotations

import re
import uuid
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlift.functions.periods import Period
from eventlift.operators.orders import IS_VALID
from eventlift.sources.workspace import Folder

_SCHEMA = "user_id {0}, first_order_date date"
_PART = re.compile(r"from-(start|\d{4}-\d{2}-\d{2})-to-(\d{4}-\d{2}-\d{2})")


class FirstOrderHistory:
    """The table under ``root``, a folder that all executors share.

    A part is written aside and renamed when whole; a reader follows the chain of parts from the start,
    each beginning where the one before ends, and takes the longest where two sessions have
    added one at once. ``settle_days`` are the last days before a study that may still change: they are
    read every time and not kept. Deliveries of kept days that change later are not seen; a new
    root starts anew.
    """

    def __init__(self, spark: SparkSession, root: str, settle_days: int = 0):
        self.spark = spark
        self.folder = Folder(spark, root)
        self.settle_days = settle_days

    def _chain(self) -> list[tuple[str, date]]:
        """Names and last days of the parts that count."""
        by_start: dict[str, list[tuple[date, str]]] = {}
        for name in self.folder.names():
            if found := _PART.fullmatch(name):
                by_start.setdefault(found[1], []).append((date.fromisoformat(found[2]), name))
        chain, at = [], "start"
        while at in by_start:
            end, name = max(by_start.pop(at))
            chain.append((name, end))
            at = end.isoformat()
        return chain

    def covered(self) -> date | None:
        """The last day that the table covers."""
        chain = self._chain()
        return chain[-1][1] if chain else None

    def _kept(self, deliveries: DataFrame) -> DataFrame | None:
        paths = [f"{self.folder.path}/{name}" for name, _ in self._chain()]
        kind = deliveries.schema["user_id"].dataType.simpleString()
        return self.spark.read.schema(_SCHEMA.format(kind)).parquet(*paths) if paths else None

    def _new(self, deliveries: DataFrame, through: date) -> DataFrame:
        """Users first seen after the covered days, up to ``through``."""
        last, known = self.covered(), self._kept(deliveries)
        days = f"delivered_date_pt <= DATE '{through}'"
        if last is not None:
            days += f" AND delivered_date_pt > DATE '{last}'"
        orders = deliveries.where(f"{IS_VALID} AND {days} AND user_id IS NOT NULL")
        first = orders.groupBy("user_id").agg(F.min("delivered_date_pt").alias("first_order_date"))
        return first if known is None else first.join(known.select("user_id"), "user_id", "left_anti")

    def extend(self, deliveries: DataFrame, through: date) -> None:
        """Cover the days up to ``through``, if they are not covered yet."""
        last = self.covered()
        if last is not None and through <= last:
            return
        name = f"from-{last or 'start'}-to-{through}"
        aside = f"_{uuid.uuid4().hex}"
        self._new(deliveries, through).write.parquet(f"{self.folder.path}/{aside}")
        if not self.folder.rename(aside, name):  # another session was first, with the same rows
            self.folder.delete(aside)

    def before(self, deliveries: DataFrame, period: Period) -> DataFrame:
        """``first_orders`` of ``deliveries`` before ``period`` starts."""
        eve = period.start - timedelta(days=1)
        self.extend(deliveries, eve - timedelta(days=self.settle_days))
        kept = self._kept(deliveries).where(f"first_order_date < DATE '{period.start}'")
        if self.covered() >= eve:
            return kept
        return kept.unionByName(self._new(deliveries, eve))
