"""Candidate population pairs: within a distance, among the nearest, or all."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftway.functions.checks import require_columns
from driftway.functions.rates import EARTH_RADIUS_KM, haversine_km, unit_vector
from driftway.operators.ranking import linear_quantiles
from driftway.session import broadcast_if_small, materialize, parts_of

# Grid levels halve the cell side from 2 (the whole unit sphere) to about 25 m.
_LEVELS = 19
_ALL_BLOCKS = 16
# A few bytes of points make many pairs, so tasks are dealt by pairs and points, and not by shuffled bytes.
_PAIRS_PER_TASK = 8_000_000
_POINTS_PER_TASK = 2_000


def _positioned(coordinates: DataFrame) -> DataFrame:
    """Coordinates with input order and position on the unit sphere."""
    require_columns(coordinates, ("population", "latitude", "longitude"), "coordinates")
    if coordinates.groupBy("population").count().filter("count > 1").limit(1).count():
        raise ValueError("each population may have one row only; names must be unique.")
    order = F.col("ord") if "ord" in coordinates.columns else F.col("population")
    x, y, z = unit_vector(F.col("latitude"), F.col("longitude"))
    return coordinates.select(
        order.alias("ord"), F.col("population").cast("string"), "latitude", "longitude",
        x.alias("x"), y.alias("y"), z.alias("z"),
    )


def _cell(axis: str, side: Column) -> Column:
    return F.floor((F.col(axis) + 1.0) / side).cast("long")


def _around(level: Column, side: Column) -> Column:
    """The 27 cells around a point, to explode."""
    steps = F.sequence(F.lit(-1), F.lit(1))
    return F.flatten(
        F.transform(
            steps,
            lambda dx: F.flatten(
                F.transform(
                    steps,
                    lambda dy: F.transform(
                        steps,
                        lambda dz: F.struct(
                            level.alias("level"),
                            (_cell("x", side) + dx).alias("cx"),
                            (_cell("y", side) + dy).alias("cy"),
                            (_cell("z", side) + dz).alias("cz"),
                        ),
                    ),
                )
            ),
        )
    )


def _side(name: str, points: DataFrame) -> DataFrame:
    return points.select(
        F.col("ord").alias(f"ord_{name}"),
        F.col("population").alias(f"population_{name}"),
        F.col("latitude").alias(f"lat_{name}"),
        F.col("longitude").alias(f"lon_{name}"),
        *[F.col(axis).alias(f"{axis}_{name}") for axis in "xyz"],
        *[c for c in points.columns if c not in ("ord", "population", "latitude", "longitude", "x", "y", "z")],
    )


def _near(reach: Column) -> Column:
    """Whether the chord of p and q is at most ``reach``, with some room for rounding: cheap, before the distance."""
    square = sum(((F.col(f"{a}_p") - F.col(f"{a}_q")) * (F.col(f"{a}_p") - F.col(f"{a}_q")) for a in "xyz"), F.lit(0.0))
    bound = (reach + 1e-12) * (1 + 1e-9)
    return square <= bound * bound


def _distance() -> Column:
    return haversine_km(F.col("lat_p"), F.col("lon_p"), F.col("lat_q"), F.col("lon_q"))


def _ordered(candidates: DataFrame) -> DataFrame:
    """One row per unordered pair; the population first in input order is ``a``."""
    flip = F.col("ord_p") > F.col("ord_q")
    return candidates.select(
        F.when(flip, F.col("population_q")).otherwise(F.col("population_p")).alias("population_a"),
        F.when(flip, F.col("population_p")).otherwise(F.col("population_q")).alias("population_b"),
        "distance_km",
    )


def pairs_within(points: DataFrame, max_distance_km: float) -> DataFrame:
    """Pairs no further apart than the limit, found through a grid with cells of that size."""
    reach = min(max_distance_km / EARTH_RADIUS_KM, math.pi)
    side = max(2 * math.sin(reach / 2), 1e-9) * (1 + 1e-9)
    cells = [_cell(axis, F.lit(side)) for axis in "xyz"]
    homes = points.select("*", *[c.alias(n) for c, n in zip(cells, ("cx", "cy", "cz"))])
    # own cell, and of every two opposite ones around it one: each pair of cells meets once
    own = (_cell(axis, F.lit(side)) for axis in "xyz")
    half = F.filter(_around(F.lit(0), F.lit(side)), lambda c: F.struct(c["cx"], c["cy"], c["cz"]) >= F.struct(*own))
    seekers = points.select("*", *[c.alias(f"o{n}") for c, n in zip(cells, ("cx", "cy", "cz"))], F.explode(half).alias("at"))
    seekers = seekers.select("*", "at.cx", "at.cy", "at.cz").drop("at")
    cell = ["cx", "cy", "cz"]
    at_home = F.expr("ocx = cx AND ocy = cy AND ocz = cz")
    seekers = seekers.withColumn("own", at_home).drop("ocx", "ocy", "ocz")
    # a cell with many pairs is met in several parts of its homes
    work = homes.groupBy(*cell).agg(F.count("*").alias("_homes")).join(seekers.groupBy(*cell).agg(F.count("*").alias("_seekers")), cell)
    blocks = F.ceil(F.col("_homes") * F.col("_seekers") / _PAIRS_PER_TASK).alias("_blocks")
    work = materialize(work.select(*cell, blocks, (F.col("_homes") * F.col("_seekers")).alias("_pairs")))
    total = work.agg(F.sum("_pairs"), F.count("*")).first()
    parts = max(parts_of(2 * (total[0] or 0), _PAIRS_PER_TASK), parts_of(total[1], 10 * _POINTS_PER_TASK))
    split = broadcast_if_small(work.select(*cell, "_blocks"))
    dealt = F.pmod(F.xxhash64("ord"), F.col("_blocks")).alias("_block")
    homes = homes.join(split, cell).select(*homes.columns, dealt).repartition(parts, *cell, "_block")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_block")
    seekers = seekers.join(split, cell).select(*seekers.columns, every).repartition(parts, *cell, "_block")
    met = _side("p", seekers).join(_side("q", homes).hint("shuffle_hash"), [*cell, "_block"])
    met = met.filter(_near(F.lit(side)) & (~F.col("own") | (F.col("ord_p") < F.col("ord_q"))))
    measured = met.withColumn("distance_km", _distance())
    return _ordered(measured.filter(F.col("distance_km") <= max_distance_km))


def nearest(points: DataFrame, k: int) -> DataFrame:
    """The k nearest others of every population with their rank, ties in pair order.

    A cell holding more than k populations bounds how far the k-th neighbour can
    be, so each population searches only the 27 cells of its finest such grid
    level. Of populations at one identical position only the first k + 1 can be
    anyone's neighbour; the rest of a heap is left out as candidates.
    """
    heap = Window.partitionBy("latitude", "longitude").orderBy("ord")
    leaders = points.withColumn("_heap", F.row_number().over(heap)).filter(F.col("_heap") <= k + 1).drop("_heap")

    levels = F.explode(F.sequence(F.lit(0), F.lit(_LEVELS - 1))).alias("level")
    side = F.pow(F.lit(2.0), 1 - F.col("level")) * (1 + 1e-9)
    cell = ["level", "cx", "cy", "cz"]

    def on_grid(df: DataFrame) -> DataFrame:
        spread = df.select("*", levels)
        return spread.select("*", *[_cell(axis, side).alias(f"c{axis}") for axis in "xyz"])

    gridded = on_grid(leaders)
    # Own cell with more than k candidates: the k-th neighbour is within its diagonal.
    parts = parts_of(points.count(), _POINTS_PER_TASK)
    crowded = gridded.groupBy(*cell).agg(F.count("*").alias("n")).filter(F.col("n") > k).drop("n")
    finest = on_grid(points).join(crowded, cell, "left_semi").groupBy("ord").agg(F.max("level").alias("fine"))
    # One level coarser the side exceeds that diagonal, so 27 cells are enough.
    level = F.greatest(F.coalesce(F.col("fine"), F.lit(0)) - 1, F.lit(0))
    # the k-th neighbour lies in the own cell of that finest level, so no farther than its diagonal
    reach = F.coalesce(math.sqrt(3) * F.pow(F.lit(2.0), 1 - F.col("fine")), F.lit(4.0)).alias("reach")
    placed = points.join(finest, "ord", "left").withColumns({"level": level, "reach": reach}).drop("fine")
    seekers = placed.select("*", F.explode(_around(F.col("level"), side)).alias("at")).drop("level")
    seekers = seekers.select("*", "at.*").drop("at")
    seekers, gridded = seekers.repartition(parts, *cell), gridded.repartition(parts, *cell)
    met = _side("p", seekers).join(_side("q", gridded).hint("shuffle_hash"), cell).filter(F.col("ord_p") != F.col("ord_q"))
    measured = met.filter(_near(F.col("reach"))).withColumn("distance_km", _distance()).drop("reach", *cell)
    by_distance = Window.partitionBy("ord_p").orderBy("distance_km", "ord_q")
    ranked = measured.withColumn("neighbor_rank", F.row_number().over(by_distance))
    return ranked.filter(F.col("neighbor_rank") <= k)


def all_pairs(points: DataFrame) -> DataFrame:
    """Every unordered pair, as an equi-join over pairs of blocks that splits evenly."""
    block = F.pmod(F.xxhash64("population"), F.lit(_ALL_BLOCKS)).cast("int")
    blocks = F.sequence(F.lit(0), F.lit(_ALL_BLOCKS - 1))
    blocked = points.withColumn("_mine", block).withColumn("_theirs", F.explode(blocks))
    left = _side("p", blocked).withColumnsRenamed({"_mine": "_one", "_theirs": "_two"})
    right = _side("q", blocked).withColumnsRenamed({"_mine": "_two", "_theirs": "_one"})
    met = left.join(right, ["_one", "_two"]).filter("ord_p < ord_q")
    return _ordered(met.withColumn("distance_km", _distance()))


def candidate_pairs(
    coordinates: DataFrame, *, max_distance_km: float | None = None, k_nearest: int | None = None
) -> DataFrame:
    """Sparse undirected pairs kept by either rule; every pair when neither is given.

    Input order decides which population is ``a``: the ``ord`` column if present,
    else the name.
    """
    if max_distance_km is not None and max_distance_km <= 0:
        raise ValueError("max_distance_km has to be above zero.")
    if k_nearest is not None and k_nearest < 1:
        raise ValueError("k_nearest is below 1.")
    points = _positioned(coordinates)
    if max_distance_km is None and k_nearest is None:
        return all_pairs(points)
    if k_nearest is None:
        return pairs_within(points, max_distance_km)
    kept = _ordered(nearest(points, k_nearest))
    if max_distance_km is not None:
        kept = kept.unionByName(pairs_within(points, max_distance_km))
    # A pair can be found from either end; both times the distance may differ in the last bit.
    return kept.groupBy("population_a", "population_b").agg(F.min("distance_km").alias("distance_km"))


def graph_options(coordinates: DataFrame, neighbors: tuple[int, ...] = (2, 3, 4, 5)) -> DataFrame:
    """Pair count, median and largest distance of the k-nearest graph for several k."""
    size = coordinates.count()
    options = sorted({k for k in neighbors if k < size})
    if not options:
        return coordinates.sparkSession.createDataFrame(
            [], "neighbors int, candidate_pairs long, median_distance_km double, max_distance_km double"
        )
    ranked = nearest(_positioned(coordinates), max(options))
    flip = F.col("ord_p") > F.col("ord_q")
    pairs = ranked.groupBy(
        F.when(flip, F.col("ord_q")).otherwise(F.col("ord_p")).alias("first"),
        F.when(flip, F.col("ord_p")).otherwise(F.col("ord_q")).alias("second"),
    ).agg(F.min("neighbor_rank").alias("best_rank"), F.min("distance_km").alias("distance_km"))
    # A pair belongs to the graph of every k from the better of its two ranks on.
    per_k = pairs.select(
        F.explode(F.filter(F.array(*[F.lit(k) for k in options]), lambda k: k >= F.col("best_rank"))).alias(
            "neighbors"
        ),
        "distance_km",
    )
    totals = per_k.groupBy("neighbors").agg(
        F.count("*").alias("candidate_pairs"), F.max("distance_km").alias("max_distance_km")
    )
    medians = linear_quantiles(per_k, ["neighbors"], "distance_km", {"median_distance_km": 0.5})
    return totals.join(medians, "neighbors").select(
        "neighbors", "candidate_pairs", "median_distance_km", "max_distance_km"
    )


def recommend_neighbors(populations: int) -> int:
    """A starting number of neighbours for a number of populations."""
    if populations <= 3:
        return max(1, populations - 1)
    return 3 if populations <= 10 else 4
