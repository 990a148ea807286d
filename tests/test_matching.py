"""Matching against a comparison of all pairs, on inputs small enough for that."""

import math
import random
import statistics
from decimal import Decimal

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from eventlift.operators.features import feature_columns
from eventlift.operators import matching
from eventlift.operators.matching import match_nearest
from eventlift.plans.study import EventStudy
from eventlift.sources.fixtures import EVENT, FixtureTables

SCHEMA = (
    "user_id bigint, zone_id int, is_express int, gtv_28d_pre decimal(28,2), gtv_91d_pre decimal(28,2),"
    " orders_28d_pre bigint, orders_91d_pre bigint, account_age_days int"
)
FEATURES = ["gtv_28d_pre", "gtv_91d_pre", "orders_28d_pre", "orders_91d_pre", "account_age_days"]


def brute_force(treatment, candidates):
    """All pairs, straight from the definition."""
    stds = []
    for i in range(3, 8):
        values = [float(t[i]) for t in treatment if t[i] is not None]
        stds.append(statistics.stdev(values) if len(values) > 1 else None)
    best = {}
    for t in treatment:
        for c in candidates:
            if None in t[1:3] or t[1:3] != c[1:3]:
                continue
            if not all(stds) or None in t[3:] or None in c[3:]:
                distance = None
            else:
                distance = math.sqrt(
                    sum((float(a - b) / s) ** 2 for a, b, s in zip(t[3:], c[3:], stds))
                )
            rank = (distance is None, distance or 0.0, c[:3], tuple(-1 if x is None else x for x in c[3:]))
            if t[0] not in best or rank < best[t[0]][0]:
                best[t[0]] = (rank, c[0], distance)
    return {k: (c, d) for k, (_, c, d) in best.items()}


def run(spark, workspace, spec, treatment, candidates, tile_rows):
    result = match_nearest(
        spark.createDataFrame(treatment, SCHEMA),
        spark.createDataFrame(candidates, SCHEMA),
        spec,
        workspace.stage,
        tile_rows=tile_rows,
    )
    return {r.treatment_user_id: (r.user_id, r.match_distance) for r in result.collect()}, result


def same(found, expected):
    assert found.keys() == expected.keys()
    for k, (control, distance) in expected.items():
        assert found[k][0] == control, k
        assert found[k][1] == pytest.approx(distance, abs=1e-9) if distance is not None else found[k][1] is None


def people(n, seed, first_id=0, hot=0.35, null_age=0.05):
    """A third in one block and, of these, a third with the same vector."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        zone, express = (1, 0) if rnd.random() < hot else (rnd.choice([1, 2, 3, None]), rnd.randint(0, 1))
        if rnd.random() < hot:
            rows.append((first_id + i, zone, express, Decimal(0), Decimal("12.50"), 0, 1, 100))
            continue
        o91 = rnd.randint(1, 9)
        o28 = rnd.randint(0, o91)
        g91 = Decimal(rnd.randint(1, 300000)) / 100
        g28 = g91 * o28 // o91 if o28 else Decimal(0)
        age = None if rnd.random() < null_age else int(rnd.expovariate(1 / 200))
        rows.append((first_id + i, zone, express, g28.quantize(Decimal("0.01")), g91, o28, o91, age))
    return rows


@pytest.mark.parametrize("tile_rows", [3, 17, 1024])
def test_equals_all_pairs(spark, workspace, spec, tile_rows):
    treatment, candidates = people(150, 1), people(700, 2, first_id=10_000)
    found, _ = run(spark, workspace, spec, treatment, candidates, tile_rows)
    same(found, brute_force(treatment, candidates))


def test_attendee_far_outside_the_candidates(spark, workspace, spec):
    treatment = people(20, 3) + [(900, 1, 0, Decimal(10**7), Decimal(10**7), 500, 900, 9000)]
    candidates = people(300, 4, first_id=10_000)
    found, _ = run(spark, workspace, spec, treatment, candidates, 5)
    same(found, brute_force(treatment, candidates))


def test_equal_candidates_go_to_the_lowest_id(spark, workspace, spec):
    treatment = people(30, 5, null_age=0)
    twins = [(i, 1, 0, Decimal(0), Decimal("12.50"), 0, 1, 100) for i in range(5000, 5200)]
    found, _ = run(spark, workspace, spec, treatment, twins, 4)
    assert set(c for c, _ in found.values()) == {5000}


def test_ties_on_either_side(spark, workspace, spec):
    treatment = [
        (1, 1, 0, Decimal(10), Decimal(10), 1, 1, 50),
        (2, 1, 0, Decimal(30), Decimal(30), 2, 3, 80),
    ]
    candidates = [
        (71, 1, 0, Decimal("10.10"), Decimal(10), 1, 1, 50),
        (70, 1, 0, Decimal("9.90"), Decimal(10), 1, 1, 50),
    ]
    found, _ = run(spark, workspace, spec, treatment, candidates, 1)
    assert found[1][0] == 70


def test_without_a_deviation_any_candidate_will_do(spark, workspace, spec):
    same_age = [(i, 1, 0, Decimal(i), Decimal(i), i, i, 40) for i in range(1, 6)]
    candidates = people(50, 6, first_id=100)
    found, _ = run(spark, workspace, spec, same_age, candidates, 8)
    expected = brute_force(same_age, candidates)
    assert all(d is None for _, d in expected.values())
    same(found, expected)


def test_no_candidate_no_row(spark, workspace, spec):
    treatment = people(30, 7)
    candidates = [(1, 99, 0, Decimal(1), Decimal(1), 1, 1, 1)]
    found, _ = run(spark, workspace, spec, treatment, candidates, 8)
    assert found == {}


def test_cut_blocks_on_the_fixtures(spark, workspace):
    tables = FixtureTables(spark, f"{DATA}/sf0.01")
    study = EventStudy(tables, EVENT, workspace)
    whole = study.control_group.drop("group_type")
    cut = match_nearest(
        study.treatment_features, study.candidate_pool, EVENT, workspace.stage, tile_rows=6
    ).drop("group_type")
    rounded = [df.withColumn("match_distance", F.round("match_distance", 9)) for df in (whole, cut)]
    assert rounded[0].exceptAll(rounded[1]).isEmpty() and rounded[1].exceptAll(rounded[0]).isEmpty()
    attendees = study.attendees.withColumnRenamed("user_id", "a")
    assert whole.join(attendees, whole.user_id == attendees.a, "left_semi").isEmpty()


def test_active_only(spark, workspace, spec):
    treatment = [(1, 1, 0, Decimal(0), Decimal(0), 0, 0, 50), *people(20, 8, first_id=50, null_age=0)]
    candidates = people(50, 9, first_id=1000)
    df = match_nearest(
        spark.createDataFrame(treatment, SCHEMA),
        spark.createDataFrame(candidates, SCHEMA),
        spec,
        workspace.stage,
        active_only=True,
    )
    assert df.where("treatment_user_id = 1").isEmpty()


def test_feature_order(spec):
    assert feature_columns(spec) == FEATURES


def heavy_tailed(spark, rows, first, seed):
    return spark.range(first, first + rows, 1, 8).selectExpr(
        "id AS user_id",
        "1 AS zone_id",
        "0 AS is_express",
        f"CAST(exp(3 + 1.5 * randn({seed})) AS DECIMAL(28,2)) AS gtv_28d_pre",
        f"CAST(exp(4 + 1.5 * randn({seed + 1})) AS DECIMAL(28,2)) AS gtv_91d_pre",
        f"CAST(exp(randn({seed + 2})) AS BIGINT) AS orders_28d_pre",
        f"CAST(exp(1 + randn({seed + 3})) AS BIGINT) AS orders_91d_pre",
        f"CAST(3000 * rand({seed + 4}) AS INT) AS account_age_days",
    )


def test_few_tiles_are_visited_in_a_heavy_tailed_block(spark, workspace, spec):
    written = []

    def stage(df, name):
        df = workspace.stage(df, name)
        written.append((name, df))
        return df

    treatment = workspace.stage(heavy_tailed(spark, 2_000, 0, 1), "t")
    candidates = workspace.stage(heavy_tailed(spark, 400_000, 10_000, 11), "c")
    match_nearest(treatment, candidates, spec, stage)
    visits = [df for name, df in written if name == "visits"][-1]
    per_vector = visits.groupBy(*[f"x{i}" for i in range(5)]).count()
    n, mean, high = per_vector.agg(F.count("*"), F.mean("count"), F.percentile("count", F.lit(0.99))).first()
    print("tiles per vector:", n, mean, high)
    assert n > 1_900 and mean <= 5 and high <= 50


def test_rows_of_a_hot_tile_are_dealt_out(spark, spec):
    features = feature_columns(spec)
    points = heavy_tailed(spark, 100, 0, 1)
    space = matching._Space(points.schema, features, dict.fromkeys(features, 1.0))
    tile = [F.lit("").alias("tile"), *space.coordinates()]
    points = points.select(F.col("user_id").alias("control_user_id"), "zone_id", *tile)
    visits = heavy_tailed(spark, 20_000, 1_000, 2).select("zone_id", *tile)
    options = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in options}
    try:
        for k, v in options.items():
            spark.conf.set(k, v)
        met = matching._compared(visits, points, space, ["zone_id"]).groupBy(F.spark_partition_id()).count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(r["count"] for r in met) == 20_000 * 100
    assert len(met) > 1
