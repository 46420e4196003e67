"""Dataset inspection: how many loci each projection size keeps, and dataset totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftway.operators.ranking import linear_quantiles
from driftway.operators.spectra import LOCUS, PAIR
from driftway.session import materialize


def population_pairs(counts: DataFrame) -> DataFrame:
    """Every unordered pair of the populations in the counts, by name.

    One sorted array of names, at most a few thousand, is unrolled in place.
    """
    names = counts.select("population").distinct().agg(F.sort_array(F.collect_list("population")).alias("names"))
    ends = names.select("names", F.posexplode("names").alias("at", "population_a"))
    later = F.slice("names", F.col("at") + 2, F.size("names"))
    return ends.select("population_a", F.explode(later).alias("population_b"))


def projection_retention(
    firsts: DataFrame, configs: DataFrame, pairs: DataFrame, max_chromosomes: int | None = None
) -> DataFrame:
    """Jointly usable loci of the worst and the median pair for every even projection size.

    ``configs`` covers ``pairs``, which is every pair of populations. A pair is
    usable at a size when both sides have at least that many called chromosomes.
    """
    if max_chromosomes is None:
        largest = firsts.agg(F.max("called_chromosomes")).first()[0]
        if largest is None:
            raise ValueError("the calls give no allele count at all.")
        max_chromosomes = int(largest)
    if max_chromosomes < 2:
        raise ValueError(
            "fewer than two called chromosomes are available; a pairwise jSFS projection cannot be recommended."
        )
    if not pairs.limit(1).count():
        raise ValueError("pairs need two populations or more.")

    sizes = F.sequence(*[F.lit(n).cast("long") for n in (2, max_chromosomes, 2)])
    smaller = F.least("n_a", "n_b")
    reached = (
        configs.groupBy(*PAIR, smaller.alias("smaller"))
        .agg(F.sum("loci").alias("loci"))
        .filter("smaller >= 2")
        .select(*PAIR, "loci", F.explode(F.sequence(F.lit(2).cast("long"), F.col("smaller"), F.lit(2).cast("long"))).alias("size"))
        .groupBy(*PAIR, "size")
        .agg(F.sum("loci").alias("pair_loci"))
    )
    grid = pairs.select(*PAIR, F.explode(sizes).alias("size"))
    filled = grid.join(reached, [*PAIR, "size"], "left").select(
        "size", F.coalesce("pair_loci", F.lit(0)).alias("pair_loci")
    )
    filled = materialize(filled)  # pairs by sizes
    totals = filled.groupBy("size").agg(
        F.count("*").alias("population_pairs"), F.min("pair_loci").alias("minimum_pair_loci")
    )
    medians = linear_quantiles(filled, ["size"], "pair_loci", {"median_pair_loci": 0.5})
    loci = firsts.select(*LOCUS).distinct().count()
    share = F.lit(float(loci))
    return totals.join(medians, "size").select(
        F.col("size").alias("projection_chromosomes"),
        F.lit(loci).cast("long").alias("total_loci"),
        "population_pairs",
        "minimum_pair_loci",
        "median_pair_loci",
        (F.col("minimum_pair_loci") / share).alias("minimum_pair_retention"),
        (F.col("median_pair_loci") / share).alias("median_pair_retention"),
    )


def recommend_projection(summary: DataFrame, retention_target: float = 0.80) -> DataFrame:
    """The largest size whose worst pair keeps the target share, else the smallest size."""
    size = F.col("projection_chromosomes")
    kept = F.max(F.when(F.col("minimum_pair_retention") >= retention_target, size))
    empty = F.raise_error(F.lit("there is no projection to summarise.")).cast("long")
    return summary.agg(
        F.when(F.count("*") == 0, empty).otherwise(F.coalesce(kept, F.min(size))).alias("recommended_projection")
    )


def dataset_totals(counts: DataFrame, popmap: DataFrame) -> DataFrame:
    """Samples, populations and distinct loci."""
    people = popmap.agg(F.count("*").alias("samples"), F.count_distinct("population").alias("populations"))
    loci = counts.select(*LOCUS).distinct().agg(F.count("*").alias("loci"))
    # One row each; a constant key joins them.
    return people.withColumn("_k", F.lit(1)).join(loci.withColumn("_k", F.lit(1)), "_k").drop("_k")
