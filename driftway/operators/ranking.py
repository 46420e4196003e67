"""Ranks and quantiles whose windows stay narrow however many rows a key has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Slots of a key's values; a slot holds about one of so many parts of its distinct values.
BUCKETS = 64


def bucketed_rank(
    df: DataFrame,
    keys: list[str],
    bucket: list[Column],
    order: list[Column],
    name: str = "rank",
) -> DataFrame:
    """1-based row number per key, ordered by ``bucket`` then ``order``.

    Rows are numbered inside (key, bucket); bucket totals, a few rows per key,
    supply the offsets. A key with most of the data is spread over its buckets.
    """
    slots = [f"_slot{i}" for i in range(len(bucket))]
    placed = df.withColumns(dict(zip(slots, bucket)))
    sizes = placed.groupBy(*keys, *slots).agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*keys).orderBy(*slots).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, *slots, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy(*keys, *slots).orderBy(*order))
    ranked = placed.withColumn("_inside", inside).join(offsets, [*keys, *slots])
    return ranked.withColumn(name, F.col("_offset") + F.col("_inside")).drop("_offset", "_inside", *slots)


def linear_quantiles(
    df: DataFrame, keys: list[str], value: str, wanted: dict[str, float], buckets: int = BUCKETS
) -> DataFrame:
    """Exact linearly interpolated quantiles per key, for groups of any size.

    Equal values collapse to one row with a multiplicity first. The rest is
    cumulated inside slots between approximate quantiles of a key's distinct
    values, so neither a hot key, a hot value nor an outlier fills one task.
    """
    tallies = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    shares = [k / buckets for k in range(1, buckets)]
    spans = tallies.groupBy(*keys).agg(
        F.percentile_approx(value, shares, 20 * buckets).alias("_edges"), F.sum("_n").alias("_total")
    )
    slot = F.size(F.filter("_edges", lambda edge: edge < F.col(value)))
    placed = tallies.join(spans, keys).withColumn("_slot", slot).drop("_edges")
    sizes = placed.groupBy(*keys, "_slot").agg(F.sum("_n").alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_slot", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    running = F.sum("_n").over(Window.partitionBy(*keys, "_slot").orderBy(value))
    cumulated = placed.withColumn("_upto", running).join(offsets, [*keys, "_slot"])
    upto = F.col("_offset") + F.col("_upto")
    ends = []
    for name, q in wanted.items():
        place = (F.col("_total") - 1) * F.lit(float(q))
        ends.append(F.min(F.when(upto >= F.floor(place) + 1, F.col(value))).alias(f"_lo_{name}"))
        ends.append(F.min(F.when(upto >= F.ceil(place) + 1, F.col(value))).alias(f"_hi_{name}"))
    found = cumulated.groupBy(*keys).agg(F.max("_total").alias("_total"), *ends)
    results = []
    for name, q in wanted.items():
        place = (F.col("_total") - 1) * F.lit(float(q))
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        results.append((low + (high - low) * (place - F.floor(place))).alias(name))
    return found.select(*keys, *results)


def median(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    return linear_quantiles(df, keys, value, {name: 0.5})
