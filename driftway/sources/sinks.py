"""Writers of stage, spectrum and validation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_table(df: DataFrame, folder: str, name: str, *, fmt: str = "parquet", partition_by: tuple[str, ...] = ()) -> str:
    """Write one table to ``folder/name`` and return that path."""
    path = f"{folder.rstrip('/')}/{name}"
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


def write_allele_counts(counts: DataFrame, folder: str) -> str:
    """Counts in files that each hold a range of (chrom, pos).

    Ranges give even files even when one chromosome holds a large share of the rows, and each file's minimum and maximum
    let readers skip it. Identifiers stay ordinary columns: as folder names they would come back as other types.
    """
    ranged = counts.repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos")
    return write_table(ranged, folder, "allele_counts")


def write_spectra(cells: DataFrame, folder: str) -> str:
    """Spectrum cells, sorted by population pair, so that a reader of one pair skips most files."""
    spread = cells.repartitionByRange("population_a", "population_b").sortWithinPartitions("population_a", "population_b", "i", "j")
    return write_table(spread, folder, "spectra")


def write_tables(tables: dict[str, DataFrame], folder: str, *, fmt: str = "parquet") -> dict[str, str]:
    """Write several named tables, e.g. the raw and summary tables of a validation suite."""
    return {name: write_table(df, folder, name, fmt=fmt) for name, df in tables.items()}
