"""Scenario summaries of known-truth replicate tables.

Each is one grouped aggregate; extra ``by`` columns (grid cells) join the group
key instead of a loop over cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftway.functions.checks import (
    DIRECTIONAL_LABELS,
    as_number,
    enforce,
    is_rate,
    require_columns,
    require_unit_interval,
    strict_bool,
)
from driftway.functions.rates import asymmetry_index, nearly_equal, preferred_label
from driftway.operators import metrics
from driftway.operators.decisions import MIN_ABS_ASYMMETRY, MIN_DIRECTIONAL_SUPPORT, MIN_MODEL_WEIGHT

RATES = ("a_to_b", "b_to_a")


def _success_columns(ok: Column) -> list[Column]:
    return [
        F.count("*").alias("attempted_replicates"),
        F.count_if(ok).alias("successful_replicates"),
        (F.count_if(ok) / F.count("*")).alias("success_rate"),
    ]


def summarize_recovery(
    replicates: DataFrame,
    *,
    by: list[str] | None = None,
    asymmetry_threshold: float = metrics.ASYMMETRY_THRESHOLD,
) -> DataFrame:
    """Recovery accuracy per scenario; the truth must be the same within a scenario.

    Metrics cover successful replicates. The false-direction rate is given for
    symmetric truth only.
    """
    by = by or []
    needed = ["scenario", "success"] + [f"{kind}_m_{r}" for kind in ("true", "estimated") for r in RATES]
    require_columns(replicates, [*by, *needed], "benchmark results")
    require_unit_interval(asymmetry_threshold=asymmetry_threshold)
    stable = strict_bool(replicates, "optimizer_stable") if "optimizer_stable" in replicates.columns else F.lit(None)
    expected = F.col("expected_direction") if "expected_direction" in replicates.columns else F.lit(None)
    rows = replicates.select(
        *by, "scenario", strict_bool(replicates, "success").alias("ok"),
        *[as_number(replicates, f"true_m_{r}").alias(f"t_{r}") for r in RATES],
        *[as_number(replicates, f"estimated_m_{r}").alias(f"e_{r}") for r in RATES],
        stable.cast("boolean").alias("stable"),
        expected.cast("string").alias("expected"),
    )
    rules = [(is_rate(F.col(f"t_{r}")), f"true_m_{r} has a value that is not a finite number from 0 up.") for r in RATES]
    rules += [
        (
            ~F.col("ok") | is_rate(F.col(f"e_{r}")),
            f"estimated_m_{r} of a successful fit is not a finite number from 0 up.",
        )
        for r in RATES
    ]
    t_ab, t_ba, e_ab, e_ba, ok = (F.col(c) for c in ("t_a_to_b", "t_b_to_a", "e_a_to_b", "e_b_to_a", "ok"))
    label = F.when(nearly_equal(t_ab, t_ba), F.lit("symmetric")).otherwise(preferred_label(t_ab, t_ba))
    rows = enforce(rows, rules).withColumn("label", label)
    table = rows.groupBy(*by, "scenario").agg(
        F.min("label").alias("expected_direction"),
        *_success_columns(ok),
        metrics.bias(t_ab, e_ab, ok).alias("bias_m_a_to_b"),
        metrics.rmse(t_ab, e_ab, ok).alias("rmse_m_a_to_b"),
        metrics.bias(t_ba, e_ba, ok).alias("bias_m_b_to_a"),
        metrics.rmse(t_ba, e_ba, ok).alias("rmse_m_b_to_a"),
        metrics.share(metrics.same_direction(t_ab, t_ba, e_ab, e_ba), ok).alias("direction_accuracy"),
        metrics.share(F.col("stable"), ok).alias("optimizer_stable_rate"),
        metrics.share(metrics.calls_direction(e_ab, e_ba, asymmetry_threshold), ok & (F.col("label") == "symmetric")).alias(
            "false_directional_positive_rate"
        ),
        F.max("label").alias("_label"),
        *[F.min(f"t_{r}").alias(f"_low_{r}") for r in RATES],
        *[F.max(f"t_{r}").alias(f"_high_{r}") for r in RATES],
        F.min("expected").alias("_expected_low"),
        F.max("expected").alias("_expected_high"),
    )
    direction = F.col("expected_direction")
    constant = (direction == F.col("_label")) & nearly_equal(F.col("_high_a_to_b"), F.col("_low_a_to_b"))
    constant = constant & nearly_equal(F.col("_high_b_to_a"), F.col("_low_b_to_a"))
    agrees = F.col("_expected_low").isNull() | (
        (F.col("_expected_low") == direction) & (F.col("_expected_high") == direction)
    )
    table = enforce(
        table,
        [
            (constant, "the replicates of a scenario have different truths."),
            (agrees, "expected_direction disagrees with the numerical migration truth."),
        ],
    )
    return table.drop(*[c for c in table.columns if c.startswith("_")])


def summarize_stress(replicates: DataFrame, *, by: list[str] | None = None) -> DataFrame:
    """Model selection, direction recovery and false-signal rates per scenario."""
    by = by or []
    flags = ("success", "correct_model_selected", "provisional_directional_signal")
    require_columns(
        replicates, [*by, "scenario", "expected_direction", "preferred_direction", *flags], "stress benchmark results"
    )
    rows = replicates.select(
        *by, "scenario", "expected_direction", "preferred_direction",
        *[strict_bool(replicates, c).alias(c) for c in flags],
    )
    ok, signal = F.col("success"), F.col("provisional_directional_signal")
    table = rows.groupBy(*by, "scenario").agg(
        F.min("expected_direction").alias("_expected"),
        *_success_columns(ok),
        metrics.share(F.col("correct_model_selected"), ok).alias("correct_model_selection_rate"),
        metrics.share(signal, ok).alias("provisional_directional_signal_rate"),
        metrics.share(
            signal & F.coalesce(F.col("preferred_direction") == F.col("expected_direction"), F.lit(False)), ok
        ).alias("_recovered"),
    )
    directional = F.col("_expected").isin(*DIRECTIONAL_LABELS)
    return table.select(
        *[c for c in table.columns if not c.startswith("_")],
        F.when(directional, F.col("_recovered")).alias("direction_recovery_rate"),
        F.when(~directional, F.col("provisional_directional_signal_rate")).alias("false_direction_signal_rate"),
    )


def summarize_forward_stress(replicates: DataFrame, *, by: list[str] | None = None) -> DataFrame:
    """False-signal rate and how often each directional model wins, per scenario."""
    by = by or []
    require_columns(
        replicates, [*by, "scenario", "success", "provisional_directional_signal", "best_model"], "forward stress results"
    )
    rows = replicates.select(
        *by, "scenario", F.coalesce("best_model", F.lit("")).alias("best_model"),
        strict_bool(replicates, "success").alias("ok"),
        strict_bool(replicates, "provisional_directional_signal").alias("signal"),
    )
    ok = F.col("ok")
    return rows.groupBy(*by, "scenario").agg(
        *_success_columns(ok),
        metrics.share(F.col("signal"), ok).alias("false_direction_signal_rate"),
        metrics.share(F.col("best_model") == "asymmetric_migration", ok).alias("asymmetric_model_selected_rate"),
        metrics.share(F.col("best_model") == "secondary_contact_asymmetric", ok).alias(
            "secondary_contact_selected_rate"
        ),
    )


def summarize_linkage(replicates: DataFrame, *, by: list[str] | None = None) -> DataFrame:
    """Coverage, interval width and support rates per scenario and resampling method.

    Serves both the correlated-block and the recombining-genealogy suites; for
    the grid of the latter give the cell columns as ``by``.
    """
    by = by or []
    flags = ("coverage_a_to_b", "coverage_b_to_a", "strong_directional_support")
    widths = ("interval_width_a_to_b", "interval_width_b_to_a")
    require_columns(
        replicates, [*by, "scenario", "method", "success", "expected_direction", *flags, *widths], "linkage results"
    )
    given = strict_bool(replicates, "success")
    rows = replicates.select(
        *by, "scenario", "method", "expected_direction", given.alias("ok"),
        # Failed replicates have no flags.
        *[F.when(given, strict_bool(replicates, c)).alias(c) for c in flags],
        *[as_number(replicates, c).alias(c) for c in widths],
    )
    ok = F.col("ok")
    table = rows.groupBy(*by, "scenario", "method").agg(
        F.min("expected_direction").alias("_expected"),
        *_success_columns(ok),
        metrics.share(F.col("coverage_a_to_b"), ok).alias("coverage_a_to_b"),
        metrics.share(F.col("coverage_b_to_a"), ok).alias("coverage_b_to_a"),
        F.avg(F.when(ok, F.col("interval_width_a_to_b"))).alias("mean_interval_width_a_to_b"),
        F.avg(F.when(ok, F.col("interval_width_b_to_a"))).alias("mean_interval_width_b_to_a"),
        metrics.share(F.col("strong_directional_support"), ok).alias("strong_directional_support_rate"),
    )
    false = F.when(F.col("_expected") == "symmetric", F.col("strong_directional_support_rate"))
    return table.withColumn("false_directional_support_rate", false).drop("_expected")


def coverage_rows(
    bootstraps: DataFrame,
    *,
    support_threshold: float = MIN_DIRECTIONAL_SUPPORT,
    asymmetry_threshold: float = MIN_ABS_ASYMMETRY,
    reference_size: Column | None = None,
) -> DataFrame:
    """Coverage, width and strong-support columns of bootstrap rows that carry their truth.

    With ``reference_size`` the true per-generation rates are first scaled by
    twice that size.
    """
    scale = F.lit(1.0) if reference_size is None else 2.0 * reference_size
    truths = {r: F.col(f"true_m_{r}") * scale for r in RATES}
    index = asymmetry_index(F.col("m_a_to_b_mean"), F.col("m_b_to_a_mean"))
    strong = (F.col("preferred_direction_support") >= support_threshold) & (F.abs(index) >= asymmetry_threshold)
    return bootstraps.select(
        "*",
        *[
            metrics.covered(truths[r], F.col(f"m_{r}_lower"), F.col(f"m_{r}_upper")).alias(f"coverage_{r}")
            for r in RATES
        ],
        *[(F.col(f"m_{r}_upper") - F.col(f"m_{r}_lower")).alias(f"interval_width_{r}") for r in RATES],
        index.alias("estimated_asymmetry"),
        strong.alias("strong_directional_support"),
    )


def provisional_signal(
    winners: DataFrame, *, min_model_weight: float = MIN_MODEL_WEIGHT, min_abs_asymmetry: float = MIN_ABS_ASYMMETRY
) -> DataFrame:
    """Estimates, preferred direction and provisional signal of each winning model.

    Needs ``directional_model`` (NULL when the winner is not directional), the
    winner's rates, weight and stability. Without a directional model the rates,
    the weight and the asymmetry are 0, the direction is ``none`` and there is no
    signal.
    """
    require_unit_interval(min_model_weight=min_model_weight, min_abs_asymmetry=min_abs_asymmetry)
    directional = F.col("directional_model").isNotNull()
    ab = F.when(directional, F.col("m_a_to_b")).otherwise(0.0)
    ba = F.when(directional, F.col("m_b_to_a")).otherwise(0.0)
    weight = F.when(directional, F.col("best_weight")).otherwise(0.0)
    stable = directional & F.col("stable")
    index = asymmetry_index(ab, ba)
    signal = (weight >= min_model_weight) & stable & (F.abs(index) >= min_abs_asymmetry)
    return winners.select(
        *[c for c in winners.columns if c not in ("m_a_to_b", "m_b_to_a", "best_weight", "stable")],
        weight.alias("asymmetric_model_weight"),
        ab.alias("estimated_m_a_to_b"),
        ba.alias("estimated_m_b_to_a"),
        index.alias("estimated_asymmetry"),
        F.when(directional, preferred_label(ab, ba)).otherwise(F.lit("none")).alias("preferred_direction"),
        stable.alias("asymmetric_optimizer_stable"),
        signal.alias("provisional_directional_signal"),
    )


# Figure data.


def recovery_grid_curves(summary: DataFrame) -> DataFrame:
    """Mean accuracy of directional scenarios and mean false-direction rate of the symmetric one, per grid cell."""
    symmetric = F.col("scenario") == "symmetric"
    return summary.groupBy("chromosomes", "segregating_sites").agg(
        F.avg(F.when(~symmetric, F.col("direction_accuracy"))).alias("direction_accuracy"),
        F.avg(F.when(symmetric, F.col("false_directional_positive_rate"))).alias("false_directional_positive_rate"),
    )


def coverage_pivot(summary: DataFrame, measure: str, methods: list[str] | None = None) -> DataFrame:
    """Scenarios by resampling method for one coverage measure."""
    grouped = summary.groupBy("scenario")
    pivoted = grouped.pivot("method", methods) if methods else grouped.pivot("method")
    return pivoted.agg(F.first(measure, ignorenulls=True))


def worst_block_cells(summary: DataFrame, cell: list[str]) -> DataFrame:
    """Worst coverage and worst symmetric false-support rate over block methods, per grid cell."""
    blocks = summary.filter(F.col("method").startswith("block_"))
    false = F.when(F.col("scenario") == "symmetric", F.col("false_directional_support_rate"))
    return blocks.groupBy(*cell).agg(
        F.min(F.least("coverage_a_to_b", "coverage_b_to_a")).alias("minimum_coverage"),
        F.max(false).alias("maximum_false_support_rate"),
    )
