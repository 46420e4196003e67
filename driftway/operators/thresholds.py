"""Calibration of decision thresholds against known truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftway.functions.checks import (
    DIRECTIONAL_LABELS,
    NULL_LABELS,
    as_number,
    enforce,
    is_finite,
    require_columns,
    require_unit_interval,
    strict_bool,
)

# Default grid of thresholds.
MODEL_WEIGHTS = (0.50, 0.60, 0.70, 0.80, 0.90)
DIRECTIONAL_SUPPORTS = (0.90, 0.95, 0.975, 0.99)
ASYMMETRIES = (0.10, 0.20, 0.25, 0.30, 0.40)
MAX_FALSE_DIRECTION = 0.05

THRESHOLDS = ("min_model_weight", "min_directional_support", "min_abs_asymmetry")
_NUMBERS = ("asymmetric_model_weight", "directional_support", "asymmetry_index")
_FLAGS = ("optimizer_stable", "interval_separated")
_LABELS = ("truth_direction", "preferred_direction")


def validate_evidence(evidence: DataFrame) -> DataFrame:
    """Evidence with strict types; incomplete or out-of-range rows fail the job, none are dropped."""
    require_columns(evidence, [*_LABELS, *_NUMBERS, *_FLAGS], "calibration table")
    typed = evidence.withColumns({name: as_number(evidence, name) for name in _NUMBERS})
    complete = F.lit(True)
    for name in (*_LABELS, *_NUMBERS, *_FLAGS):
        complete = complete & F.col(name).isNotNull()
    allowed = (*NULL_LABELS, *DIRECTIONAL_LABELS)
    rules = [(complete, "an evidence row lacks a value.")]
    for name in ("asymmetric_model_weight", "directional_support"):
        rules.append((F.col(name).between(0, 1), f"{name} is outside 0 to 1."))
    rules.append((F.abs("asymmetry_index") <= 1, "asymmetry_index is outside -1 to 1."))
    for name in _LABELS:
        rules.append((F.col(name).isin(*allowed), f"{name} has a label other than the known ones."))
    checked = enforce(typed, rules)
    return checked.withColumns({name: strict_bool(evidence, name) for name in _FLAGS})


def scan_thresholds(
    evidence: DataFrame,
    *,
    model_weights: tuple[float, ...] = MODEL_WEIGHTS,
    directional_supports: tuple[float, ...] = DIRECTIONAL_SUPPORTS,
    asymmetries: tuple[float, ...] = ASYMMETRIES,
) -> DataFrame:
    """Error rates of every threshold combination, from one pass over the evidence.

    A row only matters through how many values of each threshold list it reaches,
    so rows collapse to at most a few thousand such profiles map-side; the grid
    is laid over the profiles, not over the evidence.
    """
    lists = [sorted(set(map(float, values))) for values in (model_weights, directional_supports, asymmetries)]
    for name, values in zip(THRESHOLDS, lists):
        for value in values:
            require_unit_interval(**{name: value})
    clean = validate_evidence(evidence)
    measured = (F.col("asymmetric_model_weight"), F.col("directional_support"), F.abs("asymmetry_index"))
    reached = [
        sum(((value >= t).cast("int") for t in values), F.lit(0)).alias(f"reached_{k}")
        for k, (value, values) in enumerate(zip(measured, lists))
    ]
    directional_truth = F.col("truth_direction").isin(*DIRECTIONAL_LABELS)
    callable_row = (
        F.col("optimizer_stable")
        & F.col("interval_separated")
        & F.col("preferred_direction").isin(*DIRECTIONAL_LABELS)
    )
    profiles = (
        clean.select(
            directional_truth.alias("directional"),
            callable_row.alias("open"),
            (F.col("preferred_direction") == F.col("truth_direction")).alias("correct"),
            *reached,
        )
        .groupBy("directional", "open", "correct", "reached_0", "reached_1", "reached_2")
        .agg(F.count("*").alias("rows"))
    )
    gridded = profiles
    for k, values in enumerate(lists):
        steps = F.array(*[F.struct(F.lit(v).alias("at"), F.lit(i + 1).alias("need")) for i, v in enumerate(values)])
        gridded = gridded.withColumn(f"g{k}", F.explode(steps))
    called = F.col("open")
    for k in range(3):
        called = called & (F.col(f"reached_{k}") >= F.col(f"g{k}.need"))
    n, directional = F.col("rows"), F.col("directional")

    def total(condition):
        return F.sum(F.when(condition, n).otherwise(0))

    grouped = gridded.groupBy(
        *[F.col(f"g{k}.at").alias(name) for k, name in enumerate(THRESHOLDS)]
    ).agg(
        total(~directional).alias("null_rows"),
        total(directional).alias("directional_rows"),
        F.sum("rows").alias("evaluated_rows"),
        total(called).alias("_called"),
        total(called & ~directional).alias("_false"),
        total(called & directional).alias("_called_directional"),
        total(called & directional & F.col("correct")).alias("_right"),
    )

    def ratio(top: str, bottom: str):
        return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom))

    return grouped.select(
        *THRESHOLDS,
        ratio("_false", "null_rows").alias("false_directional_positive_rate"),
        ratio("_right", "directional_rows").alias("directional_sensitivity"),
        ratio("_right", "_called_directional").alias("direction_accuracy_when_called"),
        ratio("_called", "evaluated_rows").alias("called_fraction"),
        "evaluated_rows",
        "null_rows",
        "directional_rows",
    )


def evaluate_thresholds(
    evidence: DataFrame, min_model_weight: float, min_directional_support: float, min_abs_asymmetry: float
) -> DataFrame:
    """Error rates of one threshold combination."""
    return scan_thresholds(
        evidence,
        model_weights=(min_model_weight,),
        directional_supports=(min_directional_support,),
        asymmetries=(min_abs_asymmetry,),
    )


def select_thresholds(scan: DataFrame, max_false_direction: float = MAX_FALSE_DIRECTION) -> DataFrame:
    """The most sensitive combination within the false-direction target, as one row.

    Ties go to higher accuracy when called, then to the stricter support,
    asymmetry and weight.
    """
    require_unit_interval(max_false_directional_positive_rate=max_false_direction)
    kept = (
        *THRESHOLDS, "false_directional_positive_rate", "directional_sensitivity",
        "direction_accuracy_when_called", "called_fraction", "evaluated_rows",
    )
    require_columns(scan, kept, "threshold scan")
    rate = F.col("false_directional_positive_rate")
    eligible = scan.filter(
        (rate <= max_false_direction)
        & is_finite(F.col("directional_sensitivity"))
        & (as_number(scan, "called_fraction") > 0)
    )
    preference = F.struct(
        F.col("directional_sensitivity").alias("o1"),
        F.coalesce("direction_accuracy_when_called", F.lit(-1.0)).alias("o2"),
        F.col("min_directional_support").alias("o3"),
        F.col("min_abs_asymmetry").alias("o4"),
        F.col("min_model_weight").alias("o5"),
    )
    best = eligible.agg(F.max_by(F.struct(*kept), preference).alias("best"))
    none = (
        "no combination of thresholds both met the requested false-direction target and produced at least "
        "one directional call; expand the threshold grid or relax the target."
    )
    return enforce(best, [(F.col("best").isNotNull(), none)]).select("best.*")


def calibrate_thresholds(evidence: DataFrame, max_false_direction: float = MAX_FALSE_DIRECTION, **grid) -> tuple[DataFrame, DataFrame]:
    """(selected row, full scan)."""
    scan = scan_thresholds(evidence, **grid)
    return select_thresholds(scan, max_false_direction), scan


