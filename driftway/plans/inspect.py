"""Inspection of a dataset before inference."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from driftway.operators import geography, inspection, spectra
from driftway.session import materialize
from driftway.sources import sinks, tables, vcf


@dataclass
class Inspection:
    totals: DataFrame
    projection_summary: DataFrame
    recommended_projection: DataFrame
    graph_summary: DataFrame
    recommended_neighbors: int


def inspect_counts(
    counts: DataFrame, popmap: DataFrame, coordinates: DataFrame, *, retention_target: float = 0.80
) -> Inspection:
    """Totals, projection retention and neighbour-graph options of counted data."""
    firsts = materialize(spectra.first_counts(counts))
    pairs = inspection.population_pairs(firsts)
    configs = materialize(spectra.configurations(spectra.shared_loci(firsts, pairs)))
    summary = inspection.projection_retention(firsts, configs, pairs)
    populations = popmap.select("population").distinct()
    mapped = coordinates.join(populations, "population", "left_semi")
    return Inspection(
        totals=inspection.dataset_totals(firsts, popmap),
        projection_summary=summary,
        recommended_projection=inspection.recommend_projection(summary, retention_target),
        graph_summary=geography.graph_options(mapped),
        recommended_neighbors=geography.recommend_neighbors(populations.count()),
    )


def inspect_dataset(
    spark: SparkSession,
    vcf_path: str | list[str],
    popmap_path: str,
    coordinates_path: str,
    *,
    output_folder: str | None = None,
    retention_target: float = 0.80,
    partitions: int | None = None,
) -> Inspection:
    """Inspect files; the two option tables are written when a folder is given."""
    popmap = tables.read_popmap(spark, popmap_path)
    coordinates = tables.read_coordinates(spark, coordinates_path)
    tables.missing_coordinates(popmap, coordinates)
    counts = vcf.allele_counts_from_vcf(spark, vcf_path, popmap, partitions=partitions)
    found = inspect_counts(counts, popmap, coordinates, retention_target=retention_target)
    if output_folder is not None:
        sinks.write_table(found.projection_summary, output_folder, "projection_recommendations")
        sinks.write_table(found.graph_summary, output_folder, "graph_options")
    return found
