"""Nearest-neighbour control group inside exact blocks.

Comparing every treatment row with every candidate of its block does not scale: a
block may hold a third of both. Instead the candidates of a block are cut into tiles
of at most ``tile_rows`` distinct feature vectors. A tile that is too big is cut along the
feature that is most spread out in it, measured between its tenth and ninetieth percentile
in the units of the distance, so that tiles become round where the candidates are dense
and a few outliers do not decide.

A treatment vector is compared with its home tile, which bounds its nearest distance. The tree
of tiles is then walked down to those whose bounding box lies within the bound, and they are
visited nearest first, in rounds of growing size, until the next one lies beyond the bound. The
result equals the full comparison, ties included. A tile that many vectors visit is split by a
hash of theirs.

A block that fits into one tile is never cut, so small inputs run as one plain join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlift.functions.keys import left_lookup
from eventlift.functions.periods import EventSpec
from eventlift.operators.features import (
    BLOCK,
    feature_columns,
    feature_scales,
    scale_name,
)

TILE_ROWS = 1024
#: Parts of a tile that is cut.
WAYS = 16
#: Vectors that one task compares with a tile.
TILE_VISITS = 4096
#: Tiles that a vector visits in the first round after its home tile; each round visits as many
#: times more.
FIRST_VISITS, MORE_VISITS = 1, 4

Stage = Callable[[DataFrame, str], DataFrame]


class _Space:
    """Feature vectors as whole numbers of units (cents, orders, days).

    Whole numbers make every difference exact, so two candidates at the same distance
    are a true tie; the unit is divided out again before scaling.
    """

    def __init__(self, schema: T.StructType, features: list[str], scales: dict[str, float]):
        self.features = features
        self.names = [f"x{i}" for i in range(len(features))]
        self.types = [schema[f].dataType for f in features]
        self.units = [10**t.scale if isinstance(t, T.DecimalType) else 1 for t in self.types]
        if not all(isinstance(t, (T.DecimalType, T.IntegralType)) for t in self.types):
            raise TypeError("features must be decimals or whole numbers")
        self.scales = [scales[f] for f in features]

    def coordinates(self) -> list[Column]:
        return [
            F.expr(f"CAST({f} * {u} AS BIGINT) AS {n}")
            for f, u, n in zip(self.features, self.units, self.names)
        ]

    def original(self) -> list[Column]:
        return [
            F.expr(f"CAST(CAST({n} AS DECIMAL(20,0)) / {u} AS {t.simpleString()}) AS {f}")
            for f, n, u, t in zip(self.features, self.names, self.units, self.types)
        ]

    def length(self, gaps: list[str]) -> Column:
        exact = [f"CAST({g} AS DOUBLE)" for g in gaps]
        plain = [f"{g} / {float(u)}D" if u > 1 else g for g, u in zip(exact, self.units)]
        scaled = [f"({g} / {s!r}D)" for g, s in zip(plain, self.scales)]
        return F.expr(f"sqrt({' + '.join(f'{z} * {z}' for z in scaled)})")

    def distance(self) -> Column:
        """From the row's own vector to that of the point joined to it."""
        return self.length([f"({n} - p_{n})" for n in self.names])

    def distance_to_box(self) -> Column:
        """Never more than the distance to a point of the box, rounding included."""
        return self.length([f"greatest(lo_{n} - {n}, {n} - hi_{n}, 0L)" for n in self.names])

    def spread(self, low: str, high: str) -> str:
        """How far apart two values of each feature are, as an array in the order of features."""
        gaps = [
            f"({high.format(n)} - {low.format(n)}) / {float(u)}D / {s!r}D"
            for n, u, s in zip(self.names, self.units, self.scales)
        ]
        return f"array({', '.join(gaps)})"

    def complete(self) -> str:
        return " AND ".join(f"{f} IS NOT NULL" for f in self.features)


def _tiles(points: DataFrame, space: _Space, block: list[str]) -> DataFrame:
    """Every tile with its parent, number of points, bounding box and quantiles of each feature.

    Quantiles come from mergeable sketches; they place the cuts and decide nothing else.
    """
    shares = [0.1, 0.9, *[i / WAYS for i in range(1, WAYS)]]
    return points.groupBy(*block, "parent", "tile").agg(
        F.count("*").alias("n"),
        *[F.min(n).alias(f"lo_{n}") for n in space.names],
        *[F.max(n).alias(f"hi_{n}") for n in space.names],
        *[F.percentile_approx(n, shares, 1000).alias(f"q_{n}") for n in space.names],
    )


def _cuts(tiles: DataFrame, tile_rows: int, space: _Space, block: list[str]) -> DataFrame:
    """For each tile that is too big the feature to cut along (``dim``) and the cut values.

    A cut leaves points on either side, so a tile splits: its points are distinct, hence some
    feature varies. Where the quantiles of a feature are all its maximum, the minimum is the cut.
    """
    pick = lambda kind: f"array({', '.join(kind.format(n) for n in space.names)})[dim]"
    parts = f"least(CAST(ceil(n / {tile_rows}) AS INT), {WAYS})"
    wanted = (
        f"filter(slice(q, 3, {WAYS - 1}), (c, i) -> c < top AND"
        f" (i + 1) * {parts} DIV {WAYS} > i * {parts} DIV {WAYS})"
    )
    measured = tiles.where(F.col("n") > tile_rows).selectExpr(
        "*", f"{space.spread('q_{0}[0]', 'q_{0}[1]')} AS inner", f"{space.spread('lo_{0}', 'hi_{0}')} AS whole"
    )
    chosen = measured.selectExpr(
        "*", "CASE WHEN array_max(inner) > 0 THEN inner ELSE whole END AS spreads"
    ).selectExpr("*", "CAST(array_position(spreads, array_max(spreads)) AS INT) - 1 AS dim")
    along = chosen.selectExpr(
        *block, "tile", "n", "dim", f"{pick('q_{0}')} AS q", f"{pick('lo_{0}')} AS low", f"{pick('hi_{0}')} AS top"
    )
    return along.selectExpr(*block, "tile", "dim", "low", f"array_distinct({wanted}) AS cuts").selectExpr(
        *block, "tile", "dim", "CASE WHEN size(cuts) = 0 THEN array(low) ELSE cuts END AS cuts"
    )


def _descend(rows: DataFrame, cuts: DataFrame, space: _Space, block: list[str]) -> DataFrame:
    """Move rows from a cut tile into its parts; rows of other tiles stay, and are not ``fresh``."""
    value = F.expr(f"array({', '.join(space.names)})[dim]")
    below = F.size(F.filter("cuts", lambda c: c < value))
    part = F.concat_ws("/", "tile", below.cast("string"))
    return (
        rows.drop("parent", "fresh")
        .join(cuts, [*block, "tile"], "left")
        .withColumns(
            {
                "parent": F.col("tile"),
                "fresh": F.col("cuts").isNotNull(),
                "tile": F.when(F.col("cuts").isNull(), F.col("tile")).otherwise(part),
            }
        )
        .drop("cuts", "dim")
    )


def _compared(
    visits: DataFrame, points: DataFrame, space: _Space, block: list[str], few: bool = False
) -> DataFrame:
    """Each row with every point of its tile, at most ``tile_rows`` of them.

    The joined rows feed the aggregation in the same stage and are never shuffled. What a
    task compares is bounded by pairs, not bytes: the rows of a tile are dealt out by a hash
    of their vectors, and its points repeated for each part. ``few`` says that all rows together
    are no more than a task takes.
    """
    tile = [*block, "tile"]
    other = points.selectExpr(*tile, "control_user_id", *[f"{n} AS p_{n}" for n in space.names])
    if few:
        return visits.join(other, tile).withColumn("distance", space.distance())
    parts = visits.groupBy(*tile).agg(F.ceil(F.count("*") / TILE_VISITS).cast("int").alias("parts"))
    repeated = other.join(parts, tile).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = visits.join(parts, tile).withColumn("part", F.pmod(F.hash(*space.names), "parts"))
    joined = dealt.drop("parts").join(repeated.drop("parts"), [*tile, "part"]).drop("part")
    return joined.withColumn("distance", space.distance())


def _grown(
    points: DataFrame, space: _Space, block: list[str], tile_rows: int, stage: Stage
) -> tuple[DataFrame, list[tuple[DataFrame, DataFrame]]]:
    """Points in tiles that are small enough, and the tree: cuts and tiles of each level."""
    tiles = stage(_tiles(points, space, block), "tiles")
    levels = []
    while (tiles.agg(F.max("n")).first()[0] or 0) > tile_rows:
        cuts = _cuts(tiles, tile_rows, space, block)
        points = stage(_descend(points, cuts, space, block), "points")
        fresh = _tiles(points.where("fresh"), space, block)
        settled = tiles.where(F.col("n") <= tile_rows).withColumn("parent", F.col("tile"))
        tiles = stage(fresh.unionByName(settled), "tiles")
        levels.append((cuts, tiles))
    return points, levels


def _nearest_vectors(
    queries: DataFrame,
    points: DataFrame,
    space: _Space,
    block: list[str],
    tile_rows: int,
    stage: Stage,
) -> DataFrame:
    """For every distinct treatment vector the nearest point of its block as ``best``.

    The search for the nearest distance is hash aggregations of plain numbers; only the tiles
    that reach it are then read for the points that do.
    """
    root = {"parent": F.lit(""), "tile": F.lit(""), "fresh": F.lit(True)}
    vector = [*block, *space.names]
    points = stage(points.withColumns(root), "points")
    queries = stage(queries.withColumn("tile", F.lit("")), "queries")
    few = queries.count() <= TILE_VISITS
    points, levels = _grown(points, space, block, tile_rows, stage)

    home = queries
    for cuts, _ in levels:
        home = _descend(home, cuts, space, block)
    if levels:
        home = stage(home.select(*vector, "tile"), "home")
    reached = _reached(home, points, space, block, few)
    if levels:
        reached = _visited(stage(reached, "reached"), levels, points, space, block, few, stage)
    bound = reached.groupBy(*vector).agg(F.min("reached").alias("bound"))
    nearest = reached.join(bound, vector).where("reached = bound").select(*vector, "tile", "bound")
    return (
        _compared(nearest, points, space, block, few)
        .where("distance <= bound")
        .groupBy(*vector)
        .agg(
            F.expr(
                "min(named_struct('distance', distance, 'control_user_id', control_user_id, "
                + ", ".join(f"'{n}', p_{n}" for n in space.names)
                + ")) AS best"
            )
        )
    )


def _reached(visits: DataFrame, points: DataFrame, space: _Space, block: list[str], few: bool) -> DataFrame:
    """The nearest distance of each vector in each tile it visits."""
    met = _compared(visits, points, space, block, few).groupBy(*block, *space.names, "tile")
    return met.agg(F.min("distance").alias("reached"))


def _visited(
    reached: DataFrame,
    levels: list[tuple[DataFrame, DataFrame]],
    points: DataFrame,
    space: _Space,
    block: list[str],
    few: bool,
    stage: Stage,
) -> DataFrame:
    """All tiles that the vectors visit, home tiles included, with the distance reached there.

    Best first: a round visits the nearest tiles of each vector that still lie within its bound, then
    drops those beyond the new bound. Most vectors need none after their home tile. Vectors far from the
    bulk start with a wide bound, which the first tiles bring down before the others are visited.
    """
    vector = [*block, *space.names]
    ahead = reached.select(*vector, F.col("reached").alias("bound"), F.col("tile").alias("home"), F.lit("").alias("tile"))
    for _, tiles in levels:
        boxes = [f"{kind}_{n}" for kind in ("lo", "hi") for n in space.names]
        children = tiles.select(*block, "parent", F.col("tile").alias("child"), *boxes)
        ahead = (
            ahead.withColumnRenamed("tile", "parent")
            .join(children, [*block, "parent"])
            .withColumn("gap", space.distance_to_box())
            .where("gap <= bound")
            .select(*vector, "bound", "home", "gap", F.col("child").alias("tile"))
        )
    nearest_first = Window.partitionBy(*vector).orderBy("gap", "tile")
    ahead = ahead.where("tile != home").drop("home").withColumn("place", F.row_number().over(nearest_first))
    ahead = stage(ahead, "ahead")
    rounds, size, upto = [reached], FIRST_VISITS, FIRST_VISITS
    while not ahead.isEmpty():
        chosen = ahead.where(F.col("place") <= upto).select(*vector, "tile")
        met = stage(_reached(chosen, points, space, block, few and size == 1), "reached")
        rounds.append(met)
        better = met.groupBy(*vector).agg(F.min("reached").alias("better"))
        left = ahead.where(F.col("place") > upto).join(better, vector)
        left = left.withColumn("bound", F.least("bound", "better")).where("gap <= bound").drop("better")
        ahead = stage(left, "ahead")
        size *= MORE_VISITS
        upto += size
    visits = rounds[0]
    for met in rounds[1:]:
        visits = visits.unionByName(met)
    return stage(visits, "visits")


def match_nearest(
    treatment: DataFrame,
    candidates: DataFrame,
    spec: EventSpec,
    stage: Stage,
    block: list[str] = BLOCK,
    active_only: bool = False,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """The nearest candidate of every treatment user, with replacement.

    Distance is Euclidean over the features, each divided by its standard deviation in
    the treatment. A user with rows in several blocks gets the best of all. Without a
    distance (a missing feature, a deviation of zero) a candidate is taken only if
    there is no other. Ties go to the lowest user id, then to the lowest features.

    Both inputs are read several times and should be materialised; ``stage`` writes
    the steps of cutting large blocks.
    """
    if active_only:
        treatment = treatment.where(f"gtv_{spec.before.name} > 0")
    features = feature_columns(spec)
    stds = feature_scales(treatment, spec).first()
    scales = {f: stds[scale_name(f)] for f in features}
    space = _Space(candidates.schema, features, scales)

    in_block = " AND ".join(f"{b} IS NOT NULL" for b in block)
    candidates = candidates.where(in_block)
    people = treatment.select(
        F.col("user_id").alias("treatment_user_id"), *block, *space.coordinates()
    )

    # What is left when nothing can be measured: the lowest id of the block.
    lowest = candidates.groupBy(*block).agg(F.min("user_id").alias("user_id"))
    fallback = (
        candidates.join(lowest, [*block, "user_id"], "left_semi")
        .select(*block, F.struct(F.col("user_id").alias("control_user_id"), *space.coordinates()).alias("c"))
        .groupBy(*block)
        .agg(F.min("c").alias("fallback"))
    )
    on_block = people.join(stage(fallback, "fallback"), block)
    measurable = all(scales.values())
    if measurable:
        # Equal vectors are one query and one point: only the lowest id can win.
        points = (
            candidates.where(space.complete())
            .select("user_id", *block, *space.coordinates())
            .groupBy(*block, *space.names)
            .agg(F.min("user_id").alias("control_user_id"))
        )
        queries = (
            treatment.where(f"{in_block} AND {space.complete()}")
            .select(*block, *space.coordinates())
            .distinct()
        )
        nearest = _nearest_vectors(queries, points, space, block, tile_rows, stage)
        # People with a missing feature have a NULL in their key, which is no one's partner.
        joined = left_lookup(on_block, nearest, [*block, *space.names])
        distance, source = "best.distance", "coalesce(best.{0}, fallback.{0})"
    else:
        joined = on_block
        distance, source = "CAST(NULL AS DOUBLE)", "fallback.{0}"

    fields = {
        "unmeasured": f"{distance} IS NULL",
        "distance": distance,
        **{c: source.format(c) for c in ["control_user_id", *space.names]},
    }
    order = ["unmeasured", "distance", "control_user_id", *block, *space.names]
    ranked = joined.selectExpr(
        "treatment_user_id",
        f"named_struct({', '.join(f"'{c}', {fields.get(c, c)}" for c in order)}) AS m",
    )
    best = ranked.groupBy("treatment_user_id").agg(F.min("m").alias("m"))
    row = best.select("treatment_user_id", "m.*")
    metrics = [c for p in spec.pre_periods for c in (f"orders_{p.name}", f"gtv_{p.name}")]
    return row.select(
        F.col("control_user_id").alias("user_id"),
        "treatment_user_id",
        *block,
        *space.original(),
        F.col("distance").alias("match_distance"),
        F.lit("control").alias("group_type"),
    ).select(
        "user_id",
        "treatment_user_id",
        *block,
        *metrics,
        "account_age_days",
        "match_distance",
        "group_type",
    )
