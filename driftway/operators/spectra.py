"""Joint site-frequency spectra of many population pairs in one job.

Loci enter the pairwise work once, as one row per locus with the populations
seen there. They leave it as *configurations* (n_a, x_a, n_b, x_b) with a locus
count. Every later step - exact and projected spectra, sample-size modes,
retention, locus bootstrap - works on that table, whose size is set by the
sample sizes and not by the number of loci.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftway.functions.checks import first_values, require_columns
from driftway.functions.special import project_side
from driftway.session import BROADCAST_ROWS

LOCUS = ["chrom", "pos", "ref", "alt"]
PAIR = ["population_a", "population_b"]
CONFIGURATION = ["n_a", "x_a", "n_b", "x_b"]

# Populations a locus row may hold before pairs are formed by joining instead.
_MAX_POPULATIONS = 2_000


def first_counts(counts: DataFrame, order: str | None = "line_no") -> DataFrame:
    """One row per locus and population: the first in ``order`` when a locus key repeats.

    Only long aggregates are used, so duplicates fold map-side and one locus with
    a large share of the rows stays harmless. Without an order column the row with
    fewest alternate, then fewest called alleles wins.
    """
    require_columns(
        counts, (*LOCUS, "population", "alt_count", "called_chromosomes"), "counts table"
    )
    if order is None or order not in counts.columns:
        packed = F.min(F.shiftleft(F.col("alt_count").cast("long"), 31) + F.col("called_chromosomes"))
        folded = counts.groupBy(*LOCUS, "population").agg(packed.alias("packed"))
        return folded.select(
            *LOCUS,
            "population",
            F.shiftright("packed", 31).alias("alt_count"),
            F.col("packed").bitwiseAND(F.lit((1 << 31) - 1)).alias("called_chromosomes"),
        )
    return counts.groupBy(*LOCUS, "population").agg(
        F.min_by("alt_count", order).cast("long").alias("alt_count"),
        F.min_by("called_chromosomes", order).cast("long").alias("called_chromosomes"),
    )


def check_pairs(counts: DataFrame, pairs: DataFrame) -> None:
    """Both members of every pair must differ and occur in the counts."""
    if pairs.filter("population_a = population_b").limit(1).count():
        raise ValueError("a pair takes two populations, not one twice.")
    named = pairs.select(F.explode(F.array(*PAIR)).alias("population")).distinct()
    absent = named.join(counts.select("population").distinct(), "population", "left_anti")
    names = first_values(absent, "population")
    if names:
        raise ValueError(
            "requested populations are absent from the counts table: " + ", ".join(row[0] for row in names)
        )


def shared_loci(firsts: DataFrame, pairs: DataFrame, *, max_pairs: int = BROADCAST_ROWS) -> DataFrame:
    """(pair, locus, n_a, x_a, n_b, x_b) for every locus counted in both populations of a pair.

    ``firsts`` has one row per (locus, population). A pair list of checked size is
    broadcast and each locus row, which holds its populations, forms its pairs in
    place. A longer list is joined from both ends on (locus, pair) instead.
    """
    pairs = pairs.select(*PAIR)
    size = pairs.limit(max_pairs + 1).select(F.explode(F.array(*PAIR)).alias("p")).agg(
        F.count("*").alias("ends"), F.count_distinct("p").alias("populations")
    ).first()
    if size["ends"] <= 2 * max_pairs and size["populations"] <= _MAX_POPULATIONS:
        # Only listed populations are gathered, so a locus row never holds more than the guard allows.
        listed = pairs.select(F.explode(F.array(*PAIR)).alias("population")).distinct()
        entry = F.struct("population", F.struct(F.col("called_chromosomes").alias("n"), F.col("alt_count").alias("x")))
        wide = firsts.join(F.broadcast(listed), "population", "left_semi").groupBy(*LOCUS).agg(
            F.map_from_entries(F.collect_list(entry)).alias("seen")
        )
        ends = wide.select(*LOCUS, "seen", F.explode("seen").alias("population_a", "a"))
        met = ends.join(F.broadcast(pairs), "population_a").withColumn("b", F.try_element_at("seen", F.col("population_b")))
        return met.filter(F.col("b").isNotNull()).select(
            *PAIR, *LOCUS,
            F.col("a.n").alias("n_a"), F.col("a.x").alias("x_a"),
            F.col("b.n").alias("n_b"), F.col("b.x").alias("x_b"),
        )

    def end(side: str) -> DataFrame:
        renamed = firsts.select(
            *LOCUS,
            F.col("population").alias(f"population_{side}"),
            F.col("called_chromosomes").alias(f"n_{side}"),
            F.col("alt_count").alias(f"x_{side}"),
        )
        return renamed.join(pairs, f"population_{side}")

    return end("a").join(end("b"), [*LOCUS, *PAIR]).select(*PAIR, *LOCUS, *CONFIGURATION)


def configurations(shared: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Number of loci per pair and configuration (and per further column, e.g. a block)."""
    return shared.groupBy(*PAIR, *(by or []), *CONFIGURATION).agg(F.count("*").alias("loci"))


def candidate_loci(firsts: DataFrame, pairs: DataFrame, configs: DataFrame) -> DataFrame:
    """Loci seen in either population of each pair, by inclusion and exclusion."""
    each = firsts.groupBy("population").agg(F.count("*").alias("loci"))
    both = configs.groupBy(*PAIR).agg(F.sum("loci").alias("both"))
    sides = pairs.select(*PAIR)
    for side in ("a", "b"):
        sides = sides.join(
            each.select(F.col("population").alias(f"population_{side}"), F.col("loci").alias(f"_{side}")),
            f"population_{side}",
            "left",
        )
    either = F.coalesce(F.col("_a"), F.lit(0)) + F.coalesce(F.col("_b"), F.lit(0))
    return sides.join(both, PAIR, "left").select(
        *PAIR, (either - F.coalesce(F.col("both"), F.lit(0))).alias("loci_either")
    )


def modal_sizes(configs: DataFrame) -> DataFrame:
    """Most frequent called number per pair and side over shared loci; the smaller wins a tie."""

    def mode(side: str) -> DataFrame:
        tallies = configs.groupBy(*PAIR, f"n_{side}").agg(F.sum("loci").alias("loci"))
        best = F.max(F.struct(F.col("loci"), (-F.col(f"n_{side}")).alias("smaller")))
        return tallies.groupBy(*PAIR).agg((-best["smaller"]).alias(f"chromosomes_{side}"))

    return mode("a").join(mode("b"), PAIR)


def exact_spectra(
    configs: DataFrame, chromosomes_a: int | None = None, chromosomes_b: int | None = None
) -> DataFrame:
    """Unfolded cells from loci called in exactly n_a and n_b chromosomes.

    A size that is not given is the pair's modal size.
    """
    if any(n is not None and n < 1 for n in (chromosomes_a, chromosomes_b)):
        raise ValueError("a sample size is below 1.")
    sized = configs
    if chromosomes_a is None or chromosomes_b is None:
        sized = sized.join(modal_sizes(configs), PAIR)
    for side, fixed in (("a", chromosomes_a), ("b", chromosomes_b)):
        if fixed is not None:
            sized = sized.withColumn(f"chromosomes_{side}", F.lit(fixed).cast("long"))
    usable = sized.filter(
        (F.col("n_a") == F.col("chromosomes_a"))
        & (F.col("n_b") == F.col("chromosomes_b"))
        & F.col("x_a").between(0, F.col("chromosomes_a"))
        & F.col("x_b").between(0, F.col("chromosomes_b"))
    )
    return usable.groupBy(
        *PAIR, "chromosomes_a", "chromosomes_b", F.col("x_a").alias("i"), F.col("x_b").alias("j")
    ).agg(F.sum("loci").alias("mass"))


def project(configs: DataFrame, chromosomes_a: int, chromosomes_b: int, by: list[str], weight: str = "loci") -> DataFrame:
    """Project weighted configurations to fixed sample sizes: (by, i, j, mass).

    One side at a time: the a-side is summed away before the b-side expands, so
    the widest intermediate has one projected dimension, never the full grid per
    configuration.
    """
    if chromosomes_a < 1 or chromosomes_b < 1:
        raise ValueError("a projection size is below 1.")
    usable = configs.filter((F.col("n_a") >= chromosomes_a) & (F.col("n_b") >= chromosomes_b))
    side_a = project_side(usable, "n_a", "x_a", chromosomes_a, "i", "p")
    half = side_a.groupBy(*by, "i", "n_b", "x_b").agg(F.sum(F.col(weight) * F.col("p")).alias("mass"))
    side_b = project_side(half, "n_b", "x_b", chromosomes_b, "j", "p")
    return side_b.groupBy(*by, "i", "j").agg(F.sum(F.col("mass") * F.col("p")).alias("mass"))


def projected_spectra(configs: DataFrame, chromosomes_a: int, chromosomes_b: int) -> DataFrame:
    """Projected cells; every usable locus contributes a total mass of 1."""
    return project(configs, chromosomes_a, chromosomes_b, PAIR)


def spectrum_stats(configs: DataFrame, candidates: DataFrame, usable: Column) -> DataFrame:
    """loci_used and loci_skipped per pair, given which configurations are usable."""
    used = configs.groupBy(*PAIR).agg(F.sum(F.when(usable, F.col("loci")).otherwise(0)).alias("loci_used"))
    joined = candidates.join(used, PAIR, "left").withColumn("loci_used", F.coalesce("loci_used", F.lit(0)))
    return joined.select(*PAIR, "loci_used", (F.col("loci_either") - F.col("loci_used")).alias("loci_skipped"))


def dense_cells(cells: DataFrame, chromosomes_a: int, chromosomes_b: int, keys: list[str] = PAIR) -> DataFrame:
    """Add the zero cells of each spectrum."""
    grid = cells.select(*keys).distinct()
    grid = grid.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chromosomes_a).cast("long"))).alias("i"))
    grid = grid.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chromosomes_b).cast("long"))).alias("j"))
    return grid.join(cells, [*keys, "i", "j"], "left").withColumn("mass", F.coalesce("mass", F.lit(0.0)))


def fold_spectra(
    cells: DataFrame,
    chromosomes_a: int,
    chromosomes_b: int,
    keys: list[str] = PAIR,
    *,
    value: str = "mass",
    polarized: bool = False,
) -> DataFrame:
    """Cells ready for likelihoods: corners masked and, unless polarised, folded.

    Folding moves each cell beyond half of the total allele number to its mirror;
    a cell exactly at half shares its mass equally with its mirror.
    """
    total = chromosomes_a + chromosomes_b
    i, j = F.col("i"), F.col("j")
    corner = ((i == 0) & (j == 0)) | ((i == chromosomes_a) & (j == chromosomes_b))
    inner = cells.filter(~corner)
    if polarized:
        return inner.select(*keys, "i", "j", value)
    here = F.struct(i.alias("i"), j.alias("j"))
    mirror = F.struct((chromosomes_a - i).alias("i"), (chromosomes_b - j).alias("j"))
    targets = (
        F.when(2 * (i + j) > total, F.array(mirror))
        .when(2 * (i + j) == total, F.array(here, mirror))
        .otherwise(F.array(here))
    )
    moved = inner.select(*keys, (F.col(value) / F.size(targets)).alias(value), F.explode(targets).alias("to"))
    return moved.groupBy(*keys, F.col("to.i").alias("i"), F.col("to.j").alias("j")).agg(
        F.sum(value).alias(value)
    )


def validate_spectra(cells: DataFrame, keys: list[str] = PAIR) -> DataFrame:
    """Masses must be finite and not negative, with a positive total per spectrum."""
    from driftway.functions.checks import enforce, is_rate

    checked = enforce(
        cells, [(is_rate(F.col("mass")), "a spectrum has a mass that is not a finite number from 0 up.")]
    )
    total = F.sum("mass").over(Window.partitionBy(*keys))
    return enforce(
        checked.withColumn("_total", total),
        [(F.col("_total") > 0, "a spectrum has no mass at all.")],
    ).drop("_total")


def nonzero_cells(cells: DataFrame, keys: list[str] = PAIR) -> DataFrame:
    """Observation count of each spectrum: its cells with mass."""
    return cells.groupBy(*keys).agg(F.count_if(F.col("mass") != 0).alias("observations"))
