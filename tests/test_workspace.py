"""Steps that outlive a driver, and folders that do not."""

import os
import time

import pytest
from conftest import DATA

from eventlift import EventStudy, StudyTables, Workspace
from eventlift.sources.fixtures import EVENT, FixtureTables
from eventlift.sources.workspace import fingerprint, sweep


def written(folder):
    return {p: p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_a_killed_study_goes_on_where_it_was(spark, tmp_path):
    def study():
        return EventStudy(FixtureTables(spark, f"{DATA}/sf0.001"), EVENT, Workspace(spark, str(tmp_path), keep="one"))

    first = study()
    expected = [sorted(map(tuple, first.totals.collect())), sorted(map(tuple, first.attendees.collect()))]
    before = written(tmp_path)
    again = study()  # what a new driver finds
    assert [sorted(map(tuple, again.totals.collect())), sorted(map(tuple, again.attendees.collect()))] == expected
    assert written(tmp_path) == before
    summary = [tuple(r) for r in again.summary().collect()]
    assert set(before) < set(written(tmp_path))
    plain = EventStudy(FixtureTables(spark, f"{DATA}/sf0.001"), EVENT, Workspace(spark, str(tmp_path)))
    assert summary == [tuple(r) for r in plain.summary().collect()]


def test_a_step_that_was_cut_short_is_written_again(spark, tmp_path):
    table = Workspace(spark, str(tmp_path), keep="one").stage(spark.range(5), "t")
    (path,) = (p for p in (tmp_path / "kept-one").iterdir() if p.name.startswith("t-"))
    (path / "_SUCCESS").unlink()
    for part in path.glob("*.parquet"):
        part.unlink()
    again = Workspace(spark, str(tmp_path), keep="one").stage(spark.range(5), "t")
    assert again.count() == 5 and table.schema == again.schema


def test_other_inputs_are_another_step(spark, tmp_path):
    path = str(tmp_path / "input")
    spark.range(3).write.parquet(path)
    workspace = Workspace(spark, str(tmp_path), keep="one")

    def total(extra=0):
        return workspace.stage(spark.read.parquet(path).selectExpr(f"id + {extra} AS n"), "t").groupBy().sum().first()[0]

    assert (total(), total(), total(1)) == (3, 3, 6)
    spark.range(10, 13).write.mode("overwrite").parquet(path)
    assert (total(), total(1)) == (33, 36)
    # rows from the driver are not told apart, so such a step is never taken for another
    made = [workspace.stage(spark.createDataFrame([(i,)], "a int"), "made").first()[0] for i in (1, 2)]
    assert made == [1, 2] and fingerprint(spark.createDataFrame([(1,)], "a int")) is None


def test_many_columns_are_told_apart(spark):
    names = [f"id + {i} AS c{i}" for i in range(60)]
    one, two = spark.range(2).selectExpr(*names), spark.range(2).selectExpr(*names[:-1], "id + 7 AS c59")
    assert fingerprint(one) == fingerprint(spark.range(2).selectExpr(*names)) != fingerprint(two)


@pytest.mark.parametrize("keep", [None, "one"])
def test_a_sweep_removes_abandoned_runs(spark, tmp_path, keep):
    old, live = Workspace(spark, str(tmp_path), keep=keep), Workspace(spark, str(tmp_path), keep=keep and "two")
    for workspace in (old, live):
        workspace.stage(spark.range(1), "t")
    (tmp_path / "other").mkdir()
    past = time.time() - 30 * 3600
    os.utime(f"{old.root}/_lease", (past, past))
    assert sweep(spark, str(tmp_path)) == [old.root.rpartition("/")[2]]
    assert sorted(p.name for p in tmp_path.iterdir()) == sorted(["other", live.root.rpartition("/")[2]])


def test_tables_with_other_column_names(spark, workspace):
    plain = FixtureTables(spark, f"{DATA}/sf0.001")
    tables = {t: getattr(plain, t) for t in ("guestlist", "users", "deliveries", "values", "dim_user", "subscriptions")}
    names = {
        "deliveries": {"user_id": "Customer.No", "delivered_date_pt": "day", "order_delivery_id": "order"},
        "values": {"order_delivery_id": "order", "gtv_amt_usd": "amount"},
        "subscriptions": {"user_id": "member"},
    }
    other = {}
    for table, df in tables.items():
        actual = names.get(table, {})
        other[table] = df.toDF(*[actual.get(c, c) for c in df.columns])
    found = EventStudy(StudyTables.from_columns(names, **other), EVENT, workspace)
    expected = EventStudy(StudyTables(**tables), EVENT, workspace)
    for result in ("summary", "membership_transitions"):
        assert [tuple(r) for r in getattr(found, result)().collect()] == [tuple(r) for r in getattr(expected, result)().collect()]
    with pytest.raises(ValueError, match="missing"):
        StudyTables.from_columns({"values": {"gtv_amt_usd": "nothing"}}, **tables)
    with pytest.raises(ValueError, match="twice"):
        StudyTables.from_columns({"values": {"gtv_amt_usd": "order_delivery_id"}}, **(tables | {"values": tables["values"].withColumnRenamed("order_delivery_id", "x").selectExpr("*", "x AS order_delivery_id")}))
    with pytest.raises(ValueError, match="not given"):
        StudyTables.from_columns({"other": {}}, **tables)
