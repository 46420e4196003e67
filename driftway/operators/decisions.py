"""Evidence rules for migration direction, and the tables made from their verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftway.functions.checks import enforce, in_unit_interval, is_rate, require_columns, require_unit_interval
from driftway.functions.rates import asymmetry_index, intervals_separate, preferred_arrow

# Default thresholds, statuses and reasons.
MIN_MODEL_WEIGHT = 0.70
MIN_DIRECTIONAL_SUPPORT = 0.95
MIN_ABS_ASYMMETRY = 0.25
STATUSES = ("supported", "ambiguous", "unsupported")
NO_SIGNAL = "no migration signal"
WEAK_MODEL = "asymmetric model support below threshold"
ALL_MET = "all directional evidence criteria satisfied"
UNSTABLE = "optimizer instability"
LOW_SUPPORT = "directional support below threshold"
LOW_ASYMMETRY = "asymmetry below threshold"
OVERLAP = "uncertainty intervals overlap or are unavailable"

BOUNDS = ("forward_lower", "forward_upper", "reverse_lower", "reverse_upper")


def classify_direction(
    evidence: DataFrame,
    *,
    min_model_weight: float | Column = MIN_MODEL_WEIGHT,
    min_directional_support: float | Column = MIN_DIRECTIONAL_SUPPORT,
    min_abs_asymmetry: float | Column = MIN_ABS_ASYMMETRY,
    require_interval_separation: bool = False,
    keep: list[str] | None = None,
) -> DataFrame:
    """Supported, ambiguous or unsupported, with the preferred direction and the reason.

    Thresholds may be columns, so that every row can carry its own. ``keep`` names
    extra columns to pass through.
    """
    thresholds = {
        "min_model_weight": min_model_weight,
        "min_directional_support": min_directional_support,
        "min_abs_asymmetry": min_abs_asymmetry,
    }
    require_unit_interval(**{k: v for k, v in thresholds.items() if not isinstance(v, Column)})
    needed = [
        "source", "destination", "migration_forward", "migration_reverse", "directional_support",
        "asymmetric_model_weight", "optimizer_stable",
    ]
    require_columns(evidence, needed + (list(BOUNDS) if require_interval_separation else []), "evidence table")

    forward, reverse = F.col("migration_forward"), F.col("migration_reverse")
    support, weight = F.col("directional_support"), F.col("asymmetric_model_weight")
    rules = [
        (is_rate(forward), "migration_forward has a value that is not a finite number from 0 up."),
        (is_rate(reverse), "migration_reverse has a value that is not a finite number from 0 up."),
        (in_unit_interval(support), "directional_support is outside 0 to 1."),
        (in_unit_interval(weight), "asymmetric_model_weight is outside 0 to 1."),
    ]
    separated = F.lit(True)
    if require_interval_separation:
        fl, fu, rl, ru = (F.col(name) for name in BOUNDS)
        unknown = fl.isNull() | fu.isNull() | rl.isNull() | ru.isNull()
        finite = is_rate(fl) & is_rate(fu) & is_rate(rl) & is_rate(ru)
        rules.append((unknown | finite, "an interval end is not a finite number from 0 up."))
        rules.append(
            (unknown | ((fl <= fu) & (rl <= ru)), "an interval ends below its start.")
        )
        separated = intervals_separate(fl, fu, rl, ru)

    index = asymmetry_index(forward, reverse)
    unmet = F.array_compact(
        F.array(
            F.when(~F.col("optimizer_stable"), F.lit(UNSTABLE)),
            F.when(support < min_directional_support, F.lit(LOW_SUPPORT)),
            F.when(F.abs(index) < min_abs_asymmetry, F.lit(LOW_ASYMMETRY)),
            F.when(~separated, F.lit(OVERLAP)),
        )
    )
    silent = (forward == 0) & (reverse == 0)
    weak = weight < min_model_weight
    met = F.size(unmet) == 0
    return enforce(evidence, rules).select(
        *(keep or []),
        "source",
        "destination",
        F.when(silent | weak, F.lit("unsupported"))
        .when(met, F.lit("supported"))
        .otherwise(F.lit("ambiguous"))
        .alias("status"),
        preferred_arrow(F.col("source"), F.col("destination"), forward, reverse).alias("preferred_direction"),
        forward.alias("migration"),
        reverse.alias("reverse_migration"),
        index.alias("asymmetry_index"),
        "directional_support",
        "asymmetric_model_weight",
        "optimizer_stable",
        F.when(silent, F.lit(NO_SIGNAL))
        .when(weak, F.lit(WEAK_MODEL))
        .when(met, F.lit(ALL_MET))
        .otherwise(F.concat_ws("; ", unmet))
        .alias("reason"),
    )


def provisional_direction(
    fits: DataFrame,
    *,
    min_model_weight: float = MIN_MODEL_WEIGHT,
    min_abs_asymmetry: float = MIN_ABS_ASYMMETRY,
) -> DataFrame:
    """Labels without bootstrap evidence: candidate, ambiguous or unsupported.

    Adds ``status``, ``preferred_direction`` and ``asymmetry_index`` to rows with
    the pair, both rates, the model weight and the stability flag.
    """
    index = asymmetry_index(F.col("m_a_to_b"), F.col("m_b_to_a"))
    preferred = preferred_arrow(
        F.col("population_a"), F.col("population_b"), F.col("m_a_to_b"), F.col("m_b_to_a")
    )
    weak = F.col("asymmetric_model_weight") < min_model_weight
    clear = F.col("optimizer_stable") & (F.abs(index) >= min_abs_asymmetry) & preferred.isNotNull()
    return fits.select(
        "*",
        F.when(weak, F.lit("unsupported"))
        .when(clear, F.lit("candidate"))
        .otherwise(F.lit("ambiguous"))
        .alias("status"),
        F.when(~weak, preferred).alias("preferred_direction"),
        index.alias("asymmetry_index"),
    )


def decisions_to_flows(decisions: DataFrame, *, include_ambiguous: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Edges along the larger rate from classified decisions."""
    shown = ["supported", "ambiguous"] if include_ambiguous else ["supported"]
    used = decisions.filter(F.col("status").isin(shown) & F.col("preferred_direction").isNotNull())
    forward = F.col("migration") >= F.col("reverse_migration")
    return used.select(
        *(keep or []),
        F.when(forward, F.col("source")).otherwise(F.col("destination")).alias("source"),
        F.when(forward, F.col("destination")).otherwise(F.col("source")).alias("destination"),
        F.when(forward, F.col("migration")).otherwise(F.col("reverse_migration")).alias("migration"),
        F.col("directional_support").alias("support"),
        "status",
        "asymmetry_index",
        F.col("asymmetric_model_weight").alias("model_weight"),
        "reason",
    )


def pairwise_to_flows(pairwise: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Edges of a pairwise result table, supported and ambiguous ones alike."""
    along = F.col("preferred_direction") == F.concat("population_a", F.lit("->"), "population_b")
    against = F.col("preferred_direction") == F.concat("population_b", F.lit("->"), "population_a")
    used = pairwise.filter(F.col("status").isin("supported", "ambiguous") & (along | against))
    return used.select(
        *(keep or []),
        F.when(along, F.col("population_a")).otherwise(F.col("population_b")).alias("source"),
        F.when(along, F.col("population_b")).otherwise(F.col("population_a")).alias("destination"),
        F.when(along, F.col("m_a_to_b_scaled")).otherwise(F.col("m_b_to_a_scaled")).alias("migration"),
        F.col("directional_support").alias("support"),
        "status",
        "asymmetry_index",
        F.col("asymmetric_model_weight").alias("model_weight"),
    )


def status_counts(pairwise: DataFrame) -> DataFrame:
    """Rows per final status; statuses that do not occur count 0."""
    if "status" not in pairwise.columns:
        pairwise = pairwise.withColumn("status", F.lit(None).cast("string"))
    counted = pairwise.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])
    pairs = F.array(*[F.struct(F.lit(s).alias("status"), F.col(s).alias("pairs")) for s in STATUSES])
    return counted.select(F.explode(pairs).alias("c")).select("c.*")
