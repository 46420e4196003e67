"""Allele counts from genotype calls that are already rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftway.functions.checks import require_columns
from driftway.operators.spectra import LOCUS


def count_calls(calls: DataFrame, min_called_chromosomes: int = 1) -> DataFrame:
    """Counts per locus and population from calls (locus, population, alt_n, called).

    A call that could not be read has NULL in both numbers. Populations without a
    readable call, or with fewer called chromosomes than asked for, have no row.
    """
    if min_called_chromosomes < 1:
        raise ValueError("min_called_chromosomes is below 1.")
    require_columns(calls, [*LOCUS, "population", "alt_n", "called"], "genotype calls")
    readable = F.col("alt_n").isNotNull() & F.col("called").isNotNull()
    summed = calls.groupBy(*LOCUS, "population").agg(
        F.sum(F.when(readable, F.col("alt_n"))).cast("long").alias("alt_count"),
        F.sum(F.when(readable, F.col("called"))).cast("long").alias("called_chromosomes"),
    )
    return summed.filter(F.col("called_chromosomes") >= min_called_chromosomes).select(
        *LOCUS, "population",
        (F.col("called_chromosomes") - F.col("alt_count")).alias("ref_count"),
        "alt_count", "called_chromosomes",
    )
