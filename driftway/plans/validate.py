"""Validation jobs from files to files: calibration, data requirements, method comparison, release review.

Each job reads tables, runs its operator and writes tables below a folder. The folders that ``review`` looks for in a
campaign have the names of the studies, so the jobs can write straight into one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from driftway.operators import comparison, gates, regimes, thresholds
from driftway.session import materialize
from driftway.sources import sinks, tables


def _record(df: DataFrame, folder: str, name: str) -> None:
    """One row as one JSON file below ``folder/name``."""
    sinks.write_table(df.coalesce(1), folder, name, fmt="json")


@dataclass
class Calibration:
    selected: DataFrame
    scan: DataFrame


def calibrate(
    spark: SparkSession, evidence_path: str, output_folder: str, *,
    max_false_direction: float = thresholds.MAX_FALSE_DIRECTION, **grid,
) -> Calibration:
    """Thresholds from an evidence table: ``threshold_scan.csv``, ``selected_thresholds.csv`` and ``.json``.

    The record can be given to ``tables.load_thresholds`` and so to an inference run.
    """
    evidence = tables.read_replicates(spark, evidence_path)
    scan = materialize(thresholds.scan_thresholds(evidence, **grid))  # a few thousand rows at most
    selected = materialize(thresholds.select_thresholds(scan, max_false_direction))
    sinks.write_table(scan.orderBy(*thresholds.THRESHOLDS), output_folder, "threshold_scan.csv", fmt="csv")
    sinks.write_table(selected.coalesce(1), output_folder, "selected_thresholds.csv", fmt="csv")
    _record(selected, output_folder, "selected_thresholds.json")
    return Calibration(selected, scan)


@dataclass
class Requirements:
    regimes: DataFrame
    minima: DataFrame
    recommendation: DataFrame


def data_requirements(spark: SparkSession, summary_path: str, output_folder: str, **targets: float) -> Requirements:
    """Data regimes from a recovery-grid summary: ``data_regimes.csv``, ``minimum_regimes.csv``, ``data_requirements.json``."""
    table = materialize(regimes.data_regimes(tables.read_replicates(spark, summary_path), **targets))
    minima = materialize(regimes.pareto_minimum(table))
    recommendation = materialize(regimes.recommend_requirements(table, minima))
    sinks.write_table(table.orderBy(*regimes.REGIME), output_folder, "data_regimes.csv", fmt="csv")
    sinks.write_table(minima.orderBy(*regimes.REGIME), output_folder, "minimum_regimes.csv", fmt="csv")
    _record(recommendation, output_folder, "data_requirements.json")
    return Requirements(table, minima, recommendation)


@dataclass
class Comparison:
    results: DataFrame
    summary: DataFrame
    metadata: DataFrame


def compare_methods(
    spark: SparkSession, paths: dict[str, str], output_folder: str, *, direction_only: bool = False,
    require_complete_match: bool = True, benchmark: tuple[str, ...] = (), estimand: str = "scaled_migration",
) -> Comparison:
    """Methods on matched replicates: ``method_comparison.csv``, its summary, and ``comparison_metadata.json``.

    Tables named in ``benchmark`` have the columns of a recovery benchmark and are brought into the common form.
    """
    read = {name: tables.read_replicates(spark, path) for name, path in paths.items()}
    own = {name: comparison.standardize_benchmark(df, estimand=estimand) if name in benchmark else df for name, df in read.items()}
    results = materialize(comparison.combine_methods(own))
    comparison.matched_comparison(
        results, require_complete_match=require_complete_match, allow_mixed_estimands=direction_only
    )
    summary = materialize(comparison.summarize_methods(results, direction_only=direction_only))
    metadata = materialize(
        comparison.comparison_metadata(results, direction_only=direction_only, require_complete_match=require_complete_match)
    )
    sinks.write_table(results, output_folder, "method_comparison.csv", fmt="csv")
    sinks.write_table(summary.orderBy("method", "scenario"), output_folder, "method_comparison_summary.csv", fmt="csv")
    _record(metadata, output_folder, "comparison_metadata.json")
    return Comparison(results, summary, metadata)


@dataclass
class Review:
    checks: DataFrame
    overall: DataFrame


def review(
    spark: SparkSession, campaign_folder: str, output_folder: str, *, criteria: gates.Criteria | None = None,
    own_method: str = "driftway",
) -> Review:
    """Gates over the studies of a campaign: ``release_checks.csv`` and ``release_review.json``."""
    checks, _ = gates.review_campaign(spark, campaign_folder, criteria, own_method)
    checks = materialize(checks)  # a few dozen rows
    overall = materialize(gates.overall(checks))
    sinks.write_table(checks.coalesce(1).sortWithinPartitions("section", "metric"), output_folder, "release_checks.csv", fmt="csv")
    _record(overall, output_folder, "release_review.json")
    return Review(checks, overall)
