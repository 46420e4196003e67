"""Minimum data regimes: which sample sizes and marker counts meet the targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftway.functions.checks import (
    DIRECTIONAL_LABELS,
    as_number,
    enforce,
    require_columns,
    require_unit_interval,
)

# Default targets.
MIN_DIRECTION_ACCURACY = 0.90
MAX_FALSE_DIRECTION_RATE = 0.05
MIN_SUCCESS_RATE = 0.95

REGIME = ["chromosomes", "segregating_sites"]


def data_regimes(
    summary: DataFrame,
    *,
    min_direction_accuracy: float = MIN_DIRECTION_ACCURACY,
    max_false_direction_rate: float = MAX_FALSE_DIRECTION_RATE,
    min_success_rate: float = MIN_SUCCESS_RATE,
) -> DataFrame:
    """Worst success, accuracy and false-direction rate per regime, and whether it passes.

    A regime passes only if all three are known and within target.
    """
    require_unit_interval(
        min_direction_accuracy=min_direction_accuracy,
        max_false_direction_rate=max_false_direction_rate,
        min_success_rate=min_success_rate,
    )
    rates = ("success_rate", "direction_accuracy", "false_directional_positive_rate")
    require_columns(summary, [*REGIME, "scenario", "expected_direction", *rates], "recovery grid summary")
    label = F.col("expected_direction")
    known = label.isin("symmetric", *DIRECTIONAL_LABELS)
    rows = enforce(summary, [(known, "unknown expected_direction labels.")]).select(
        *[F.col(c).cast("long").alias(c) for c in REGIME], label.alias("label"),
        *[as_number(summary, c).alias(c) for c in rates],
    )
    symmetric = F.col("label") == "symmetric"
    table = rows.groupBy(*REGIME).agg(
        F.min("success_rate").alias("minimum_success_rate"),
        F.min(F.when(~symmetric, F.col("direction_accuracy"))).alias("minimum_direction_accuracy"),
        F.max(F.when(symmetric, F.col("false_directional_positive_rate"))).alias("maximum_false_direction_rate"),
    )
    passes = (
        (F.col("minimum_success_rate") >= min_success_rate)
        & (F.col("minimum_direction_accuracy") >= min_direction_accuracy)
        & (F.col("maximum_false_direction_rate") <= max_false_direction_rate)
    )
    return table.withColumn("passes_targets", F.coalesce(passes, F.lit(False)))


# Ranges of marker counts in which running minima are taken.
_RANGES = 64


def pareto_minimum(regimes: DataFrame) -> DataFrame:
    """Passing regimes that no other passing regime beats on one axis and matches on the other.

    Per marker count only the smallest sample size can survive, and it does iff
    every smaller marker count needs more chromosomes. The running minimum is
    taken inside ranges of about equally many marker counts, with the minima of
    the lower ranges carried in, so no window spans the table.
    """
    require_columns(regimes, [*REGIME, "passes_targets"], "regime table")
    passing = regimes.filter("passes_targets")
    per_sites = passing.groupBy("segregating_sites").agg(F.min("chromosomes").alias("chromosomes"))
    numbered = per_sites.withColumn("_sites", F.col("segregating_sites").cast("double"))
    edges = sorted(set(numbered.approxQuantile("_sites", [k / _RANGES for k in range(1, _RANGES)], 1 / (8 * _RANGES))))
    placed = numbered.withColumn("_range", sum((F.when(F.col("_sites") > e, 1).otherwise(0) for e in edges), F.lit(0)))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range.
    carried = placed.groupBy("_range").agg(F.min("chromosomes").alias("_least")).select(
        "_range", F.min("_least").over(earlier).alias("_carried")
    )
    inside = Window.partitionBy("_range").orderBy("segregating_sites").rowsBetween(Window.unboundedPreceding, -1)
    least = F.least(F.min("chromosomes").over(inside), F.col("_carried"))
    front = placed.join(F.broadcast(carried), "_range").withColumn("_before", least)
    front = front.filter(F.col("_before").isNull() | (F.col("chromosomes") < F.col("_before")))
    return passing.join(front.select(*REGIME), REGIME, "left_semi")


def recommend_requirements(regimes: DataFrame, minima: DataFrame) -> DataFrame:
    """One row: regimes tested and passing, the Pareto minima and a status."""
    counts = regimes.agg(
        F.count("*").alias("tested_regimes"), F.count_if("passes_targets").alias("passing_regimes")
    ).withColumn("_k", F.lit(1))
    listed = minima.agg(
        F.sort_array(F.collect_list(F.struct("segregating_sites", "chromosomes"))).alias("minima")
    ).withColumn("_k", F.lit(1))
    swapped = F.transform(
        "minima", lambda m: F.struct(m["chromosomes"].alias("chromosomes"), m["segregating_sites"].alias("segregating_sites"))
    )
    status = F.when(F.size("minima") > 0, F.lit("recommendations_available")).otherwise(
        F.lit("no_tested_regime_met_targets")
    )
    return counts.join(listed, "_k").select(
        "tested_regimes", "passing_regimes", swapped.alias("pareto_minimum_regimes"), status.alias("status")
    )
