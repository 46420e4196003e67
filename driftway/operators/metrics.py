"""Accuracy metrics of migration estimates against known truth, per group of rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftway.functions.checks import enforce, is_finite, is_rate, require_unit_interval
from driftway.functions.rates import asymmetry_index

# Fixed value: default asymmetry at which an estimate counts as directional.
ASYMMETRY_THRESHOLD = 0.25


# Aggregate expressions; ``only`` restricts the rows they look at.


def _when(only: Column | None, value: Column) -> Column:
    return value if only is None else F.when(only, value)


def bias(truth: Column, estimate: Column, only: Column | None = None) -> Column:
    return F.avg(_when(only, estimate - truth))


def rmse(truth: Column, estimate: Column, only: Column | None = None) -> Column:
    error = estimate - truth
    return F.sqrt(F.avg(_when(only, error * error)))


def share(condition: Column, only: Column | None = None) -> Column:
    """Fraction of rows for which the condition holds."""
    return F.avg(_when(only, condition.cast("double")))


def covered(truth: Column, lower: Column, upper: Column) -> Column:
    return (truth >= lower) & (truth <= upper)


def direction_sign(m_ab: Column, m_ba: Column, tolerance: float = 0.0) -> Column:
    gap = m_ab - m_ba
    return F.when(F.abs(gap) <= tolerance, F.lit(0)).otherwise(F.signum(gap).cast("int"))


def same_direction(
    true_ab: Column, true_ba: Column, est_ab: Column, est_ba: Column, tolerance: float = 0.0
) -> Column:
    return direction_sign(true_ab, true_ba, tolerance) == direction_sign(est_ab, est_ba, tolerance)


def calls_direction(est_ab: Column, est_ba: Column, threshold: float = ASYMMETRY_THRESHOLD) -> Column:
    """A directional call: the asymmetry reaches (not only exceeds) the threshold."""
    return F.abs(asymmetry_index(est_ab, est_ba)) >= threshold


# Grouped tables.


def _grouped(df: DataFrame, keys: list[str], *measures: Column) -> DataFrame:
    table = df.groupBy(*keys).agg(F.count("*").alias("_n"), *measures)
    return enforce(table, [(F.col("_n") > 0, "there are no rows to validate.")]).drop("_n")


def parameter_errors(df: DataFrame, keys: list[str], truth: str, estimate: str) -> DataFrame:
    """Bias and root mean squared error."""
    t, e = F.col(truth), F.col(estimate)
    checked = enforce(df, [(is_finite(t) & is_finite(e), "a truth or estimate is not a finite number.")])
    return _grouped(checked, keys, bias(t, e).alias("bias"), rmse(t, e).alias("rmse"))


def interval_coverage(df: DataFrame, keys: list[str], truth: str, lower: str, upper: str) -> DataFrame:
    """Share of truths inside their interval, ends included."""
    t, low, high = F.col(truth), F.col(lower), F.col(upper)
    finite = is_finite(t) & is_finite(low) & is_finite(high)
    checked = enforce(
        df,
        [
            (finite, "a truth or an interval end is not a finite number."),
            (low <= high, "an interval ends below its start."),
        ],
    )
    return _grouped(checked, keys, share(covered(t, low, high)).alias("interval_coverage"))


def direction_accuracy(
    df: DataFrame,
    keys: list[str],
    columns: tuple[str, str, str, str] = (
        "truth_m_a_to_b", "truth_m_b_to_a", "estimated_m_a_to_b", "estimated_m_b_to_a",
    ),
    tolerance: float = 0.0,
) -> DataFrame:
    """Share of rows whose estimated direction equals the true one."""
    if not math.isfinite(tolerance) or tolerance < 0:
        raise ValueError("tolerance must be a finite number, zero or more.")
    values = [F.col(c) for c in columns]
    finite = is_finite(values[0])
    for value in values[1:]:
        finite = finite & is_finite(value)
    checked = enforce(df, [(finite, "a rate whose direction is asked for is not a finite number.")])
    return _grouped(checked, keys, share(same_direction(*values, tolerance)).alias("direction_accuracy"))


def false_direction_rate(
    df: DataFrame,
    keys: list[str],
    estimates: tuple[str, str] = ("estimated_m_a_to_b", "estimated_m_b_to_a"),
    threshold: float = ASYMMETRY_THRESHOLD,
) -> DataFrame:
    """Share of directional calls; meant for rows whose truth is symmetric."""
    require_unit_interval(asymmetry_threshold=threshold)
    ab, ba = (F.col(c) for c in estimates)
    checked = enforce(
        df,
        [
            (is_finite(ab) & is_finite(ba), "an estimated rate is not a finite number."),
            (is_rate(ab) & is_rate(ba), "an estimated rate is below zero."),
        ],
    )
    rate = share(calls_direction(ab, ba, threshold))
    return _grouped(checked, keys, rate.alias("false_directional_positive_rate"))
